"""Personal data by weak supervision.

Regex patterns propose candidate spans: those of the base rules, and wider ones -
written-out addresses, phone numbers without a plus - that no base rule takes. Six
labelers vote on each (1, 0 or -1 for abstain): strict form, check digits or ranges,
a gazetteer of top-level domains, prefixes and codes, context words before the span,
free-standing borders, and variety of digits. Each labeler judges wide candidates by
the same question as base ones. Votes are counted per pattern of votes over the whole
corpus - at most 4 * 3^6 patterns - and expectation-maximisation over those counts
estimates each labeler's reliability and each kind's share of true spans. The
posteriors then train a naive-Bayes span classifier on the span's kind, length, digit
share, context, border and gazetteer entry, which has the last word: it learns from
the many base candidates what a wide one is worth, and adds it where it is sure.

All work on rows is DataFrame operations; only the bounded counts of patterns
reach the driver. The gazetteer is a table (kind, key) of checked size.

Defined results: a null text is empty; no candidates at all give empty spans;
repeated rows are judged alike, each in its own row; spans that begin together stand
in the order of the kinds; texts are scanned whole, however long, but a span of more
than LONGEST_FORM characters has no strict form; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, match_spans

NAME = "op10_pii_weak_supervision"
ORACLE = None

# The guards (?:\G|(?<!..)) and the possessive quantifiers change no match of the
# base patterns: a run of one class either matches from its first free character
# or from none. They keep every pattern linear on long runs and off Java's stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){7,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Outside the base rules: written-out addresses and phone numbers without a plus.
WORDY_EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,12}+){1,3}+"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-]*[0-9])"
KIND_RANK = {"email": 0, "ip": 1, "card": 2, "phone": 3}
SOURCES = (("email", EMAIL, True), ("ip", IP, True), ("card", CARD, True), ("phone", PHONE, True), ("email", WORDY_EMAIL, False), ("phone", LOCAL_PHONE, False))
#: Context words by kind, in the languages of the corpus.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|courriel|correo|kontakt|write to)\b[^\n]{0,12}$",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|serveur|addr)\b[^\n]{0,12}$",
    "card": r"(?i)\b(?:card|visa|mastercard|carte|karte|tarjeta|payment)\b[^\n]{0,12}$",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|t.l.phone|tel.fono)\b[^\n]{0,12}$",
}
#: The strict form of a kind, whatever rule proposed the span.
FORM = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)*(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z]{2,12}$",
    "ip": r"^(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$",
    "card": r"^(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}$",
}
#: No strict form is longer; the patterns would recurse on longer spans.
LONGEST_FORM = 320
#: What of a span is looked up in the gazetteer: its last letters, first number, or first digits.
KEY = {"email": (r"([A-Za-z]{1,20})$", 1), "ip": (r"^0*([0-9]+)", 1), "card": (r"^([0-9])", 1), "phone": (r"^(\+[1-9]|\(?[2-9])", 1)}
#: Common top-level domains, first octets in use, card issuers' first digits, starts of phone numbers.
GAZETTEER = (
    *(("email", x) for x in ("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "io")),
    *(("ip", str(x)) for x in range(1, 224) if x != 127),
    *(("card", x) for x in "23456"),
    *(("phone", f"+{x}") for x in range(1, 10)),
    *(("phone", f"{p}{x}") for p in ("(", "") for x in range(2, 10)),
)
#: Rows that a gazetteer may have: it becomes a literal of the plan.
MOST_KEYS = 20_000
LABELERS = ("form", "check", "gazetteer", "context", "border", "variety")
SPACE_BEFORE = 40


def gazetteer_keys(table: DataFrame | None) -> dict[str, list[str]]:
    """Keys by kind, lower-cased, of a table (kind, key) of checked size; of GAZETTEER without one."""
    rows = GAZETTEER if table is None else [tuple(r) for r in table.select("kind", "key").distinct().limit(MOST_KEYS + 1).collect()]
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} gazetteer rows")
    return {kind: sorted({k.lower() for x, k in rows if x == kind and k is not None}) for kind in KIND_RANK}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds; from the right, every second digit is doubled."""
    def worth(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), "", -1), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The base rule's condition on a match."""
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(hit)
        return F.length(d).between(12, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def proposals(text: Column, keys: dict[str, list[str]]) -> Column:
    """array<struct<start, rank, kind, end, base, votes, feature>> of one text."""

    def of(kind: str, pattern: str, base: bool) -> Column:
        def judged(s: Column) -> Column:
            before = F.substring(text, F.greatest(s["start"] - SPACE_BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(SPACE_BEFORE)))
            around = F.concat(F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(F.lit(" ")), F.substring(text, s["end"] + 1, F.lit(1)))
            good = passes(kind, s["hit"])
            digits = _digits(s["hit"])
            in_context = before.rlike(CONTEXT[kind])
            known = F.lower(F.regexp_extract(F.right(s["hit"], F.lit(21)) if kind == "email" else s["hit"], *KEY[kind])).isin(*keys[kind]) if keys[kind] else F.lit(False)
            free = ~around.rlike("[A-Za-z0-9]")
            bit = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
            votes = F.concat_ws(
                ",",
                bit(F.when(F.length(s["hit"]) <= LONGEST_FORM, s["hit"].rlike(FORM[kind])).otherwise(F.lit(False))),
                F.lit("-1") if kind == "email" else bit(good),
                bit(known),
                F.when(in_context, F.lit("1")).otherwise(F.lit("-1")),
                bit(free),
                F.when(F.length(digits) < 3, F.lit("-1")).otherwise(bit(F.size(F.array_distinct(F.split(digits, "", -1))) > 2)),
            )
            length = F.least(F.floor(F.length(s["hit"]) / 6), F.lit(6)).cast("string")
            share = F.floor(F.length(digits) * 4 / F.greatest(F.length(s["hit"]), F.lit(1))).cast("string")
            feature = F.concat_ws("|", F.lit(kind), length, share, bit(in_context), bit(free), bit(known))
            return F.struct(s["start"].alias("start"), F.lit(KIND_RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), (good if base else F.lit(False)).alias("base"), votes.alias("votes"), feature.alias("feature"))

        return F.transform(match_spans(text, pattern), judged)

    return F.concat(*[of(*source) for source in SOURCES])


def estimate(counts: list[tuple[str, str, int]], rounds: int = 30) -> dict[tuple[str, str], float]:
    """Posterior that a span is personal data, by (kind, votes), from pattern counts.

    Two-class EM with one true- and one false-class probability of a 1 for each
    labeler, shared by all kinds, and one prior for each kind. It starts from
    labelers that are right three times in four, so the classes cannot swap, and
    Beta(2, 1)-like pseudo-counts keep every probability inside (0, 1).
    """
    rows = [(kind, [int(v) for v in votes.split(",")], n) for kind, votes, n in sorted(counts)]
    yes, no = [0.75] * len(LABELERS), [0.25] * len(LABELERS)
    prior = {kind: 0.5 for kind, _, _ in rows}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, votes, _ in rows:
            log = math.log(prior[kind]) - math.log(1 - prior[kind])
            for j, v in enumerate(votes):
                if v >= 0:
                    log += math.log(yes[j] if v else 1 - yes[j]) - math.log(no[j] if v else 1 - no[j])
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, log)))))
        for j in range(len(LABELERS)):
            a = [(p * n, v, n) for p, (_, votes, n) in zip(post, rows) if (v := votes[j]) >= 0]
            yes[j] = (3 + sum(w for w, v, _ in a if v)) / (4 + sum(w for w, _, _ in a))
            no[j] = (1 + sum(n - w for w, v, n in a if v)) / (4 + sum(n - w for w, _, n in a))
        for kind in prior:
            n = sum(r[2] for r in rows if r[0] == kind)
            prior[kind] = (1 + sum(p * r[2] for p, r in zip(post, rows) if r[0] == kind)) / (2 + n)
    return {(kind, ",".join(map(str, votes))): p for p, (kind, votes, _) in zip(post, rows)}


def train(weighted: list[tuple[str, float, float]]) -> Callable[[str], float]:
    """Naive Bayes over the fields of the features: the probability that a span of a feature is personal data.

    weighted: feature, expected true spans, expected false spans. Values count from
    one, so that none is impossible.
    """
    t, f = 1 + sum(x[1] for x in weighted), 1 + sum(x[2] for x in weighted)
    tables: list[dict[str, float]] = []
    for i in range(max((len(x[0].split("|")) for x in weighted), default=0)):
        by: dict[str, list[float]] = {}
        for feature, a, b in weighted:
            cell = by.setdefault(feature.split("|")[i], [1.0, 1.0])
            cell[0] += a
            cell[1] += b
        tables.append({v: math.log(a / t) - math.log(b / f) for v, (a, b) in by.items()})

    def probability(feature: str) -> float:
        log = math.log(t / f) + sum(tables[i][v] for i, v in enumerate(feature.split("|")))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))

    return probability


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.95, gazetteer: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Every row with its spans: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts are of base spans. A candidate outside the base rules is added if the
    classifier gives it at least the probability sure; gazetteer(kind, key) replaces
    the default one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    rows = scratch.save(docs.select(F.col(id_col).alias("id"), proposals(F.coalesce(F.col(text_col), F.lit("")), gazetteer_keys(gazetteer)).alias("found")), "candidates")
    flat = rows.filter("size(found) > 0").select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.feature").count()
    # bounded: a few kinds x 3^6 votes x a few hundred features, whatever the corpus
    cells = [(r["kind"], r["votes"], r["feature"], r["count"]) for r in flat.collect()]
    by_votes: dict[tuple[str, str], int] = {}
    for kind, votes, _, n in cells:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    posterior = estimate([(k, v, n) for (k, v), n in by_votes.items()])
    probability = train(sorted((feature, posterior[kind, votes] * n, (1 - posterior[kind, votes]) * n) for kind, votes, feature, n in cells))
    accepted = sorted({feature for _, _, feature, _ in cells if probability(feature) >= sure})
    added = lambda s: F.lit(False) if not accepted else ~s["base"] & F.array_contains(F.array(*map(F.lit, accepted)), s["feature"])

    def overlaps_base(s: Column) -> Column:
        return F.exists(F.col("found"), lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def listed(keep) -> Column:
        return F.array_join(F.transform(F.array_sort(F.filter(F.col("found"), keep)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(F.col("found"), lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    extra = lambda s: added(s) & ~overlaps_base(s)
    return rows.select(
        F.col("id").alias(id_col), *[number(kind) for kind in KIND_RANK], F.sha2(listed(lambda s: s["base"]), 256).alias("base_sha256"),
        listed(lambda s: s["base"] | extra(s)).alias("spans"), F.size(F.filter(F.col("found"), extra)).cast("long").alias("n_added"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
