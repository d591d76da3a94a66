"""Sources and sinks: landed calendars, page dumps, programme entries, evaluation records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORK = (
    "struct<seq:int,rawText:string,composer:string,composerConfidence:double,composerRaw:string,composerKo:string,workTitle:string,workTitleKo:string,"
    "opus:string,`key`:string,movements:array<string>,soloist:string,isEncore:boolean,afterIntermission:boolean>"
)
ENTRY = (
    "sn string, date string, endDate string, title string, venue string, genre string, genreConfidence double, introLines int, performers array<string>, "
    f"parseConfidence double, blockMethod string, programRaw string, perfText string, works array<{WORK}>, _corrupt_record string"
)
RECORD = (
    "meta struct<file:string,repeatIndex:int,model:string,promptHash:string,schemaHash:string,genConfigHash:string,imageHash:string,resize:int,bytes:bigint,ranAt:string>, "
    "latencyMs bigint, attempts int, usage struct<promptTokenCount:bigint,candidatesTokenCount:bigint,thoughtsTokenCount:bigint,totalTokenCount:bigint>, "
    "parseError string, error string, output string, _corrupt_record string"
)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Programme entries, one JSON object a line; unreadable lines are kept in _corrupt_record."""
    return spark.read.schema(ENTRY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def calendar(spark: SparkSession, path: str, skip: str = "result") -> DataFrame:
    """A calendar that maps keys to lists of events: every list but one, an event a row."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"), F.col("_metadata.file_name").alias("file"))
    lists = raw.select("file", F.explode(F.map_filter("m", lambda k, v: k != skip)).alias("day", "events"))
    return lists.select("file", "day", F.posexplode(F.from_json("events", "array<map<string,string>>")).alias("at", "event")).filter("event IS NOT NULL")


def nested_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A calendar of weeks of days with lists of times; null days are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\uFEFF", "").alias("value"), F.col("_metadata.file_name").alias("file"))
    weeks = raw.select("file", F.from_json(F.get_json_object("value", "$.Tag.Weeks"), "array<array<struct<Date:string,Times:array<map<string,string>>>>>").alias("weeks"))
    days = weeks.select("file", F.posexplode("weeks").alias("week", "days")).select("file", "week", F.explode("days").alias("day")).filter("day IS NOT NULL")
    return days.select("file", "week", "day.Date", F.posexplode("day.Times").alias("at", "event"))


def pages(spark: SparkSession, path: str, pattern: str = "*.html.gz") -> DataFrame:
    """Page dumps (id from the file name, whole text); Spark reads the compressed form itself."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("id"), F.col("value").alias("html"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records of a folder tree, without names that begin with _ or a dot; run is the number before .json."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    name = F.col("_metadata.file_name")
    return raw.select("*", F.coalesce(F.regexp_extract(name, r"\.r(\d+)\.json$", 1).try_cast("int"), F.lit(0)).alias("run"), name.alias("name")).filter(~F.col("name").rlike("^[_.]"))


def truth_items(spark: SparkSession, path: str) -> DataFrame:
    """Labelled items of a truth file: at, file, difficulty, truth (JSON), unreadable, problems.

    What is wrong with an item is listed and does not stop the load: no file, no truth,
    or unreadable fields that are no list. A file without a list of items is an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "items array<string>")["items"].alias("items"))
    listed = raw.select(F.posexplode(F.coalesce("items", F.raise_error(F.lit("the truth file has no list of items")).cast("array<string>"))).alias("at", "item"))
    get = lambda name: F.get_json_object("item", f"$.{name}")
    odd = get("unreadable_fields")
    falsy = odd.isNull() | odd.isin("", "false", "0", "null")
    no_list = ~falsy & ~F.startswith(odd, F.lit("["))
    wrong = [(F.coalesce(get("file"), F.lit("")) == "", "no file"), (F.coalesce(get("truth"), F.lit("")).isin("", "null"), "no truth"), (no_list, "unreadable fields are no list")]
    problems = F.filter(F.array(*[F.when(rule, F.lit(name)) for rule, name in wrong]), lambda x: x.isNotNull())
    unreadable = F.when(F.startswith(odd, F.lit("[")), F.from_json(odd, "array<string>"))
    return listed.select("at", get("file").alias("file"), get("difficulty").alias("difficulty"), F.when(~get("truth").isin("", "null"), get("truth")).alias("truth"), unreadable.alias("unreadable"), problems.alias("problems"))


def labelled(found: DataFrame, truths: DataFrame) -> DataFrame:
    """Records (with meta) of files that have a truth, with model, file and run in front; the others do not count."""
    own = found.select(F.col("meta.model").alias("model"), F.col("meta.file").alias("file"), "*")
    return own.join(truths.filter("truth IS NOT NULL").select("file").distinct(), "file", "left_semi")


def runs_by_model(found: DataFrame, truths: DataFrame) -> DataFrame:
    """Per model: files, records, and records of files without a truth."""
    known = truths.filter("truth IS NOT NULL").select(F.col("file").alias("_file")).distinct()
    own = found.select(F.col("meta.model").alias("model"), F.col("meta.file").alias("file"), "run").join(known, F.col("file") == F.col("_file"), "left")
    has = F.col("_file").isNotNull()
    per = own.groupBy("model", "file").agg(F.count("*").alias("n"), F.max(has).alias("has"))
    return per.groupBy("model").agg(F.count_if("has").alias("files"), F.sum(F.when(F.col("has"), F.col("n")).otherwise(0)).alias("records"), F.sum(F.when(~F.col("has"), F.col("n")).otherwise(0)).alias("unlabelled"))


def pick(output: Column, names: list[str], containers: tuple[str, ...] = ("fields", "data", "result", "ocr")) -> Column:
    """The first present alias in the record or one of its containers; {value, confidence} is unwrapped."""
    found = []
    for c in ("$", *[f"$.{c}" for c in containers]):
        for n in names:
            x = F.get_json_object(output, f"{c}.{n}")
            found.append(F.coalesce(F.get_json_object(x, "$.value"), F.when(~x.startswith("{"), x)))
    return F.coalesce(*found)


def missing_or_extra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Problem list: keys of one side that the other lacks."""
    from cadenza.operators.evaluation import anti_audit

    return anti_audit(left, right, key)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = " / ") -> None:
    """CSV with a header; arrays become one cell."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), sep).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, bar: str | None = None, limit: int = 50) -> str:
    """A report table of at most limit rows; bar names a percent column drawn as half a block a percent."""
    rows = df.limit(limit).collect()
    head = [*df.columns, *(["bar"] if bar else [])]
    body = [[*[str(v) for v in r], *(["█" * int(r[bar] / 2)] if bar else [])] for r in rows]
    return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * len(head), *body])


def report(title: str, sections: Sequence[tuple[str, DataFrame | str]], bars: Mapping[str, str] | None = None, limit: int = 50) -> str:
    """A Markdown report of sections in order: texts as they are, tables by markdown(); bars names a percent column for a section."""
    parts = [f"# {title}"]
    for name, body in sections:
        parts.append(f"## {name}\n\n" + (body if isinstance(body, str) else markdown(body, (bars or {}).get(name), limit)))
    return "\n\n".join(parts) + "\n"
