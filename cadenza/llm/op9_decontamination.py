"""Benchmark decontamination by SimHash of item-sized windows.

1. Texts become hashes of shingles of five words. A window that is similar to 0.8
   holds over 0.8 of its item's weight, so it holds one of the item's rarest shingles
   that make up 0.2 of it. Documents meet the items by those alone; no window that
   could reach 0.8 is lost, and shingles that many items share are not looked up.
2. For each (document, item) found, every window of the item's size between the
   first and the last place where 0.8 of its weight can stand gets a 64-bit SimHash,
   whatever the order of the shingles in it. Windows are clipped at the text's ends.
3. A multi-index joins windows with the items of their size: fingerprints within
   Hamming radius 17 differ by at most one bit in one of nine blocks, and items are
   entered under each block as it is and with each bit flipped, so the join misses
   none of them. A window of similarity 0.8 differs in 9.7 bits on average, in more
   than 17 in 0.4 % of cases.
4. For each item found in a document all windows of step 2 are compared exactly: the
   sum of least over the sum of greatest weighted counts. A shingle weighs log(1 +
   items / items with it), and one that the item lacks log(1 + items).

All of it is DataFrame functions. Bits are counted in packed lanes: a hash gives its
64 bits to 16 longs of four lanes, so a step of a window is 16 additions.

Words are lower-cased and lose ASCII punctuation. Defined results: a null text has
no window; a null id is an id of its own; an item without words is never found, one
of fewer than five words is found where as many words equal it and the document has
no others; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, ids, maybe_broadcast, null_id, words

NAME = "op9_simhash_windows"
ORACLE = None

SHINGLE, RADIUS, BLOCKS = 5, 17, 9
#: First bit and number of bits of each block of a fingerprint.
SPANS = tuple((7 * b, 8 if b == BLOCKS - 1 else 7) for b in range(BLOCKS))
#: Bits of a lane: a count of up to a quarter of its range is compared without overflow.
LANES = (16, 32)


def plain_words(text: Column) -> Column:
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]+", ""))


def shingle_hashes(w: Column) -> Column:
    """array<long>: the hash of each run of five words; of the whole if there are fewer."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def with_hashes(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with its text column replaced by the shingle hashes.

    The words are a column of their own first: inside the lambda they would be made
    anew for every shingle.
    """
    others = [c for c in df.columns if c != text]
    return df.select(*others, plain_words(F.col(text)).alias("_words")).select(*others, shingle_hashes(F.col("_words")).alias(name))


def simhash(hashes: Column, most: int) -> Column:
    """The fingerprint of an array of at most ``most`` hashes: bits that at least half of them have."""
    lane = next(x for x in LANES if most < 1 << (x - 2))
    ones = sum(1 << i for i in range(0, 64, lane))
    names = [f"l{i}" for i in range(lane)]

    def step(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[n] + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(ones))).alias(n) for i, n in enumerate(names)])

    def bits(acc: Column) -> Column:
        # adding 2^(lane - 2) less half the number carries into that bit where the count reaches the half
        lift = (F.lit(1 << (lane - 2)) - F.ceil(F.size(hashes) / 2)) * F.lit(ones)
        out = F.lit(0).cast("long")
        for i, n in enumerate(names):
            hit = (acc[n] + lift).bitwiseAND(F.lit(ones << (lane - 2)))
            out = out.bitwiseOR(F.shiftrightunsigned(hit, lane - 2 - i) if i <= lane - 2 else F.shiftleft(hit, 1))
        return out

    return F.aggregate(hashes, F.struct(*[F.lit(0).cast("long").alias(n) for n in names]), step, bits)


def block_keys(fingerprint: Column, flips: bool) -> Column:
    """The block keys of a fingerprint, each with its block's number in it; with flips also those one bit away."""
    keys = []
    for b, (first, size) in enumerate(SPANS):
        value = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << size) - 1)).cast("int")
        keys += [value.bitwiseXOR(F.lit(x)) + F.lit(b << 8) for x in [0, *([1 << i for i in range(size)] if flips else [])]]
    return F.array(*keys)


def benchmark_items(items: DataFrame, item_id: str, text_col: str, least: float, scratch: Scratch) -> DataFrame:
    """(item, size, hashes, weight, shingles, held, worth), saved: shingles is array<struct<h, c, w, rare>> of distinct ones.

    weight is the sum over all shingles, rare marks the rarest that make up more
    than 1 - least of it.
    """
    base = scratch.save(with_hashes(items.select(F.col(item_id).alias("item"), F.col(text_col).alias("text")), "text", "hashes").withColumn("size", F.size("hashes")).filter("size > 0"), "hashed-items")
    counted = base.select("item", F.explode("hashes").alias("h")).groupBy("item", "h").agg(F.count("*").cast("int").alias("c"))
    spread = counted.groupBy("h").agg(F.count("*").alias("df"))
    total = base.count()
    rarest = Window.partitionBy("item").orderBy(F.desc("w"), "h")  # an item's own shingles
    weighed = counted.join(spread, "h").withColumn("w", F.log(1 + F.lit(total) / F.col("df")))
    before = F.coalesce(F.sum(F.col("c") * F.col("w")).over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum(F.col("c") * F.col("w")).over(Window.partitionBy("item"))
    # a hair more than needed, against rounding
    weighed = weighed.select("item", "h", "c", "w", whole.alias("weight"), (before <= (1 - least + 1e-9) * whole).alias("rare"))
    weighed = weighed.groupBy("item", "weight").agg(F.collect_list(F.struct("h", "c", "w", "rare")).alias("shingles"))
    weighed = weighed.select("*", F.col("shingles.h").alias("held"), F.col("shingles.w").alias("worth"))
    return scratch.save(base.join(weighed, "item").withColumn("items", F.lit(total)), "items")


def starts(hashes: Column, held: Column, worth: Column, weight: Column, size: Column, least: float) -> Column:
    """array<int>: the starts of all windows of the size that can hold least of the weight.

    held and worth are an item's hashes and their weights. Nested arrays of one
    element bind a value that is used twice.
    """
    need = weight * (least - 1e-9)

    def walk(total: Column):
        def step(acc: Column, w: Column) -> Column:
            through = acc["sum"] + w
            return F.struct(
                (acc["at"] + 1).alias("at"), through.alias("sum"),
                F.when(acc["end"].isNull() & (through >= need), acc["at"]).otherwise(acc["end"]).alias("end"),  # first place by which enough has stood
                F.when(total - acc["sum"] >= need, acc["at"]).otherwise(acc["begin"]).alias("begin"),  # last place from which enough stands
            )

        return step

    def between(acc: Column) -> Column:
        lo, hi = F.greatest(acc["end"] - size + 1, 1 - size), acc["begin"]
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.expr("CAST(array() AS array<int>)"))

    none = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("int").alias("begin"))
    weights = F.transform(hashes, lambda x: F.coalesce(F.try_element_at(worth, F.nullif(F.array_position(held, x), F.lit(0)).cast("int")), F.lit(0.0)))
    found = F.transform(F.array(weights), lambda ws: F.element_at(F.transform(F.array(F.aggregate(ws, F.lit(0.0), lambda x, w: x + w)), lambda total: F.aggregate(ws, none, walk(total), between)), 1))
    return F.element_at(found, 1)


def window(hashes: Column, start: Column, size: Column) -> Column:
    """The window of the size from start on, clipped at both ends of the text."""
    lo = F.greatest(start, F.lit(0))
    return F.slice(hashes, lo + 1, F.greatest(F.least(start + size, F.size(hashes)) - lo, F.lit(0)))


def similarity(seen: Column, shingles: Column, items: Column) -> Column:
    """Weighted Jaccard of a window's hashes with an item's shingles."""
    length = F.size(seen)

    def step(acc: Column, s: Column) -> Column:
        k = length - F.size(F.array_remove(seen, s["h"]))
        return F.struct((acc["both"] + s["w"] * F.least(s["c"], k)).alias("both"), (acc["either"] + s["w"] * F.greatest(s["c"], k)).alias("either"), (acc["known"] + k).alias("known"))

    zero = F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("either"), F.lit(0).alias("known"))
    return F.aggregate(shingles, zero, step, lambda acc: acc["both"] / (acc["either"] + F.log(1 + items) * (length - acc["known"])))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (id, item) with similarity and start (in shingles) of the most similar window of at least that similarity."""
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    rows = docs.select(ids(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    items = benchmark_items(benchmark, item_id, item_text, least, scratch)
    rare = items.select("item", F.explode("shingles").alias("s")).filter("s.rare").select(F.col("s.h").alias("h"), "item")
    rare = maybe_broadcast(scratch.save(rare, "rare"))
    # explode_outer: for explode, a filter on the array's size would make all words once more for every shingle
    shingles = with_hashes(rows, "text", "hashes").select("id", "tag", F.explode_outer("hashes").alias("h"))
    pairs = scratch.save(shingles.join(rare, "h").select("id", "tag", "item").distinct(), "met")
    # the texts that met an item are read again, the others not
    wanted = maybe_broadcast(scratch.save(pairs.select("id", "tag").distinct(), "wanted"))
    texts = scratch.save(with_hashes(rows.join(wanted, ["id", "tag"], "left_semi"), "text", "doc_hashes").dropDuplicates(["id", "tag"]), "texts")
    known = maybe_broadcast(items.drop("hashes"), 20_000)

    def placed(pairs: DataFrame) -> DataFrame:
        at = starts(F.col("doc_hashes"), F.col("held"), F.col("worth"), F.col("weight"), F.col("size"), least)
        return pairs.join(texts, ["id", "tag"]).join(known, "item").select("id", "tag", "item", "size", "items", "shingles", "doc_hashes", at.alias("starts"))

    # windows, fingerprints and the multi-index
    most = items.agg(F.max("size")).first()[0] or 1
    prints = F.transform(F.transform("starts", lambda s: window(F.col("doc_hashes"), s, F.col("size"))), lambda w: simhash(w, most))
    windows = scratch.save(placed(pairs).select("id", "tag", "size", F.explode_outer(F.array_distinct(prints)).alias("print")).filter("print IS NOT NULL").distinct(), "windows")
    index = items.select("item", "size", simhash(F.col("hashes"), most).alias("item_print"))
    index = maybe_broadcast(scratch.save(index.select("item", "size", "item_print", F.explode(block_keys(F.col("item_print"), True)).alias("block")), "index"))
    near = windows.select("*", F.explode(block_keys(F.col("print"), False)).alias("block")).join(index, ["size", "block"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    found = scratch.save(near.select("id", "tag", "item").distinct(), "found")

    # exact comparison of all windows where an item was found; written between, so that no step is done twice
    seen = F.transform("starts", lambda s: F.struct(F.greatest(s, F.lit(0)).alias("at"), window(F.col("doc_hashes"), s, F.col("size")).alias("seen")))
    opened = scratch.save(placed(found).select("id", "item", F.explode_outer(seen).alias("w")), "opened")
    value = similarity(F.col("w.seen"), F.col("shingles"), F.col("items"))
    scored = opened.join(known, "item").select("id", "item", F.struct(value.alias("similarity"), (-F.col("w.at")).alias("back")).alias("best"))
    scored = scored.groupBy("id", "item").agg(F.max("best").alias("best")).filter(F.col("best.similarity") >= least - 1e-9)  # a tie is enough, however it is rounded
    return scored.select(null_id("id").alias(id_col), F.col("item").alias(item_id), F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("similarity", F.round("similarity", 6))
