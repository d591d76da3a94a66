"""Full work records, cross coverage, means of scores, and checks of runs and redactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.forms import canon_form, mapped
from cadenza.functions.text import similarity
from cadenza.operators import evaluation as E
from cadenza.operators import programmes as P
from cadenza.operators import selection as S
from cadenza.operators.frequency import work_records as records
from cadenza.plans.analytics import REGIONAL, regional
from cadenza.plans.catalogue import register
from cadenza.plans.evaluation import r4
from cadenza.session import table


@register("work_records", """
WITH o AS (SELECT p_partkey AS work, l_orderkey AS concert, CAST(o_orderdate AS DATE) AS d, p_name || ' ' || l_returnflag || l_linestatus AS raw, l_linenumber = 7 AS encore, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS pos, CASE WHEN l_suppkey % 3 = 0 THEN 'op.' || (l_suppkey % 50) END AS opus
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
i AS (SELECT work, count(*) AS n, count(DISTINCT concert) AS concerts, count(*) FILTER (encore) AS encores, min(d) AS first_date, max(d) AS last_date, arg_min(opus, pos) FILTER (opus IS NOT NULL) AS opus FROM o GROUP BY 1),
l AS (SELECT work, raw, row_number() OVER (PARTITION BY work ORDER BY count(*) DESC, min(pos)) AS r FROM o GROUP BY work, raw),
a AS (SELECT work, max(raw) FILTER (r = 1) AS label, coalesce(string_agg(raw, ' / ' ORDER BY r) FILTER (r IN (2, 3)), '') AS alt_labels FROM l GROUP BY 1),
m AS (SELECT work, string_agg(month || ':' || k, ',' ORDER BY month) AS months FROM (SELECT work, month(d) AS month, count(*) AS k FROM o GROUP BY ALL) GROUP BY 1)
SELECT i.*, label, alt_labels, months FROM i JOIN a USING (work) JOIN m USING (work)""")
def work_records(spark, sf_dir):
    """The frequency index with encores, spellings, months and the first known catalogue number."""
    nights = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    occ = table(spark, sf_dir, "lineitem").join(nights, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("work"), F.col("l_orderkey").alias("concert"), "d", F.concat("p_name", F.lit(" "), "l_returnflag", "l_linestatus").alias("raw"), (F.col("l_linenumber") == 7).alias("encore"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("pos"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("op."), (F.col("l_suppkey") % 50).cast("string"))).alias("opus"),
    )
    out = records(occ, "work", "concert", "d", "raw", "encore", "pos", ["opus"])
    months = F.array_join(F.transform("months", lambda m: F.concat(m["month"].cast("string"), F.lit(":"), m["n"].cast("string"))), ",")
    return out.withColumns({"alt_labels": F.array_join("alt_labels", " / "), "months": months})


@register("corpus_cross_coverage", REGIONAL + """, n AS (SELECT work, count(*) FILTER (corpus = 'ASIA') AS na, count(*) FILTER (corpus = 'EUROPE') AS nb FROM o GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY na DESC, work) AS ra, row_number() OVER (ORDER BY nb DESC, work) AS rb FROM n)
SELECT floor(1000.0 * sum(nb) FILTER (ra <= 100) / sum(nb)::DOUBLE + 0.5) / 10.0 AS b_in_top_a, floor(1000.0 * sum(na) FILTER (rb <= 100) / sum(na)::DOUBLE + 0.5) / 10.0 AS a_in_top_b FROM r""")
def corpus_cross_coverage(spark, sf_dir):
    """How much of each corpus the other one's hundred most played works cover."""
    return P.cross_coverage(regional(spark, sf_dir), "corpus", "work", "ASIA", "EUROPE")


@register("field_means", f"""
WITH p AS (SELECT p_type AS field, p_size % 9 = 0 AS nt, list_distinct(string_split(p_name, ' ')) AS t, list_distinct([split_part(p_name, ' ', 1), CASE WHEN p_size % 2 = 0 THEN 'red' ELSE lower(p_type) END]) AS q, p_name AS a, split_part(p_name, ' ', 1) || ' ' || lower(p_type) AS b FROM part),
s AS (SELECT field, nt, len(list_intersect(t, q)) AS hit, len(t) AS nt_, len(q) AS nq, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS similarity FROM p),
m AS (SELECT *, hit / nq::DOUBLE AS precision, hit / nt_::DOUBLE AS recall FROM s)
SELECT field, {r4('avg(similarity) FILTER (NOT nt)')} AS similarity, {r4('avg(precision) FILTER (NOT nt)')} AS precision, {r4('avg(recall) FILTER (NOT nt)')} AS recall,
  {r4('avg(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END) FILTER (NOT nt)')} AS f1 FROM m GROUP BY 1""")
def field_means(spark, sf_dir):
    """Means of similarity, precision, recall and F1 per field."""
    first = F.substring_index("p_name", " ", 1)
    guess = F.array(first, F.when(F.col("p_size") % 2 == 0, "red").otherwise(F.lower("p_type")))
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("field"), (F.col("p_size") % 9 == 0).alias("nt"), similarity(F.col("p_name"), F.concat(first, F.lit(" "), F.lower("p_type"))).alias("similarity"), E.set_score(F.split("p_name", " "), guess).alias("s"))
    return E.field_means(p.select("field", "nt", "similarity", "s.precision", "s.recall", "s.f1"), "field", "nt", ["similarity", "precision", "recall", "f1"])


@register("fields_of_all_runs", """
WITH a AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), w AS (SELECT conv_id, turn, regexp_split_to_array(t, '[^a-z]+') AS x FROM a),
f AS (SELECT conv_id, min(turn) AS t0, count(*) AS runs FROM w GROUP BY 1), e AS (SELECT DISTINCT conv_id, turn, unnest(x) AS v FROM w), n AS (SELECT conv_id, v, count(*) AS k FROM e GROUP BY ALL),
o AS (SELECT w.conv_id, generate_subscripts(x, 1) AS i, unnest(x) AS v, runs FROM w JOIN f ON f.conv_id = w.conv_id AND turn = t0), d AS (SELECT conv_id, v, min(i) AS i, min(runs) AS runs FROM o GROUP BY ALL)
SELECT f.conv_id, coalesce(string_agg(d.v, ' ' ORDER BY d.i) FILTER (k = d.runs), '') AS fields FROM f LEFT JOIN d USING (conv_id) LEFT JOIN n USING (conv_id, v) GROUP BY 1""")
def fields_of_all_runs(spark, sf_dir):
    """Words that all turns of a conversation hold, in the order of the first turn."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+", -1))
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", words.alias("w")))), lambda s: s["w"]).alias("runs"))
    return runs.select("conv_id", F.array_join(S.in_all(F.col("runs")), " ").alias("fields"))


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "digits": "[0-9]{7,}", "bracket": r"\[email\]"}


@register("unclean_redactions", r"""WITH m AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '[email]', 'g') AS t FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') THEN 'email' END, CASE WHEN regexp_matches(t, '[0-9]{7,}') THEN 'digits' END, CASE WHEN contains(t, '[email]') THEN 'bracket' END) AS kinds FROM m""")
def unclean_redactions(spark, sf_dir):
    """What a redaction of addresses alone leaves in each text."""
    t = S.masked(F.col("text"), {"email": KINDS["email"]})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.left_over(t, KINDS), ",").alias("kinds"))


#: An invented map of forms to the instrument that plays alone.
SOLO = {"piano concerto": "piano", "violin sonata": "violin", "prelude": "piano"}


@register("form_soloists", """SELECT p_partkey, ['symphony', 'piano concerto', NULL, 'violin sonata', 'prelude', NULL][p_partkey % 6 + 1] AS form, [NULL, 'piano', NULL, 'violin', 'piano', NULL][p_partkey % 6 + 1] AS solo FROM part""")
def form_soloists(spark, sf_dir):
    """Titles to forms, and forms to instruments."""
    title = F.element_at(F.array(*map(F.lit, ["Symphony No. 1", "피아노 협주곡 2번", "Aufschwung", "Violin Sonata", "24 Préludes / prelude", "untitled"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    form = canon_form(F.concat(title, F.lit(" "), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", form.alias("form"), mapped(form, SOLO).alias("solo"))
