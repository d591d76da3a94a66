"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text by the base patterns and by patterns of
further credential formats. Each candidate's value is hashed, and the hashes are
counted over distinct repositories and distinct owners: a value seen under many of
them is a widely copied example, one that stays with a single owner and looks
random is taken as live. An owner holds repositories, so a value in several of one
owner's repositories is still that owner's. The value of a PEM block is its body without white space,
so the header that all keys share counts for nothing, and a header alone is no key.
Base spans always stay; a span of a further format is added only if it is live.

Defined results: a null text is empty; a null repository or owner counts as one of
its own; repeated rows are each scanned and count once for frequency; spans that
begin together stand in the order of the kinds; texts are scanned whole, however
long; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, match_spans

NAME = "op5_secret_ownership"
ORACLE = None

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A block through its END line; without one, the header and the runs of base64 after it.
PEM_END = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
PEM = rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----((?:[^-]*+(?:-(?!----)[^-]*+)*+(?={PEM_END}))|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{16,}}+)*+)(?:{PEM_END})?"
#: kind, pattern, group of the value, least length of the value, whether it is a
#: base kind. A maximal run that is too short never hides a longer one, so least
#: lengths of single-class runs are part of the pattern.
KINDS = (
    ("assign", ASSIGN, 2, 6, True),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    ("pem", PEM, 1, 1, False),
)
RANK = {kind: i for i, (kind, *_) in enumerate(KINDS)}


def entropy(value: Column) -> Column:
    """Bits a character of a short string."""
    chars = F.split(value, "", -1)
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    return F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc - (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n * F.log2(F.greatest((F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n, F.lit(1e-9))),
    )


def candidates(text: Column) -> Column:
    """array<struct<start, rank, kind, end, value, base>> of one text, unordered."""

    def of(kind: str, pattern: str, group: int, least: int, base: bool) -> Column:
        def typed(s: Column) -> Column:
            value = F.regexp_extract(s["hit"], pattern, group) if group else s["hit"]
            value = F.regexp_replace(value, r"\s|\\[nr]", "") if kind == "pem" else value  # one key, however its lines are broken
            return F.struct(s["start"].alias("start"), F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), value.alias("value"), F.lit(base).alias("base"))

        return F.filter(F.transform(match_spans(text, pattern), typed), lambda s: F.length(s["value"]) >= least)

    return F.concat(*[of(*kind) for kind in KINDS])


def ownership(found: DataFrame) -> DataFrame:
    """found(digest, repo, owner) to (digest, repos, owners).

    Distinct pairs are made first and counted with map-side sums, so a value that
    a third of all rows holds reaches no task as a group.
    """
    pairs = found.groupBy("digest", "repo", "owner").agg(F.count("*").alias("k"))
    repos = pairs.groupBy("digest", "repo").agg(F.count("*").alias("k")).groupBy("digest").agg(F.count("*").alias("repos"))
    owners = pairs.groupBy("digest", "owner").agg(F.count("*").alias("k")).groupBy("digest").agg(F.count("*").alias("owners"))
    return repos.join(owners, "digest")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str = "repository", owner: str = "owner", copied_repos: int = 5, copied_owners: int = 3, least_entropy: float = 2.5, scratch: Scratch | None = None) -> DataFrame:
    """Every row with its spans.

    Returns id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied and
    secrets: array<struct<start, rank, kind, end, value, base, repos, owners, copied, live>>.
    A value is copied if it has at least copied_repos repositories or copied_owners
    owners; it is live if it is not copied and has least_entropy bits a character.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(repo).cast("string"), F.lit("\0")).alias("repo"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    flat = rows.filter("size(found) > 0").select("row", "repo", "owner", F.explode("found").alias("s")).withColumn("digest", F.sha2(F.col("s.value"), 256))
    owned = ownership(flat.select("digest", "repo", "owner"))
    copied = (F.col("repos") >= copied_repos) | (F.col("owners") >= copied_owners)
    judged = flat.join(owned, "digest").select("row", F.struct("s.*", "repos", "owners", copied.alias("copied"), (~copied & (entropy(F.col("s.value")) >= least_entropy)).alias("live")).alias("s"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    out = rows.select("row", "id").join(per_row, "row", "left")
    secrets = F.coalesce(F.col("secrets"), F.array())

    def listed(keep) -> Column:
        return F.array_join(F.transform(F.filter(secrets, keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(keep) -> Column:
        return F.size(F.filter(secrets, keep)).cast("long")

    return out.select(
        F.col("id").alias(id_col),
        number(lambda s: s["kind"] == "assign").alias("n_assign"),
        number(lambda s: s["kind"] == "access").alias("n_access"),
        number(lambda s: s["kind"] == "hex").alias("n_hex"),
        F.sha2(listed(lambda s: s["base"]), 256).alias("base_sha256"),
        listed(lambda s: s["base"] | s["live"]).alias("spans"),
        number(lambda s: s["live"]).alias("n_live"),
        number(lambda s: s["copied"]).alias("n_copied"),
        F.col("secrets"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the owner is the source, its repositories are its languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repository"))
    return scan_secrets(docs, repo="repository", owner="source").drop("secrets")
