"""Quality rules with suffix-array repetition.

Each text's words become ranks, and a suffix array with its longest-common-prefix
array gives the intervals of maximal repeated substrings. Spans of repeats of at
least ``window`` words are united; a document is rejected if the united spans cover
too large a share of its words or one repeat is too long. Short documents, and
ones without a repeated window by hash, need no suffix array: no interval of theirs
reaches the least length.

Defined results: a null text has no words and fails; repeated rows are judged each;
a text of any length is judged whole; no other rows matter, so ties cannot arise;
extra columns are left out unless they are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Hashes, short_batches, slices

NAME = "op8_suffix_repetition"

WINDOW, LEAST_WORDS, SHARE, LONGEST = 8, 20, 30, 100
_STEP = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an array of small integers, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n and rank[order[-1]] < n - 1 and step < n:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        step *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order (Kasai's walk)."""
    n, text, at = len(codes), codes.tolist(), order.tolist()
    place = [0] * n
    for i, p in enumerate(at):
        place[p] = i
    out, k = [0] * n, 0
    for p in range(n):
        if place[p] == 0:
            k = 0
            continue
        q = at[place[p] - 1]
        while p + k < n and q + k < n and text[p + k] == text[q + k]:
            k += 1
        out[place[p]] = k
        k = max(0, k - 1)
    return np.array(out, np.int64)


def repetition(codes: np.ndarray, window: int = WINDOW) -> tuple[int, int]:
    """Words in the united spans of repeats of at least window words, and the longest repeat."""
    n = len(codes)
    if n <= window:
        return 0, 0
    order = suffix_array(codes)
    lcp = common_prefixes(codes, order)
    reach = np.zeros(n, np.int64)  # of each suffix, its longest repeat
    reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest = int(reach.max())
    if longest < window:
        return 0, longest
    at = np.flatnonzero(reach >= window)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + reach[at], -1)
    return int((np.cumsum(edge[:n]) > 0).sum()), longest


def may_repeat(hashes: np.ndarray, window: int) -> bool:
    """False only if no window of words occurs twice."""
    n = len(hashes) - window + 1
    if n < 2:
        return False
    h = hashes[:n].copy()
    for i in range(1, window):
        h *= _STEP
        h += hashes[i : i + n]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def measure(text: str | None, hashes: Hashes, window: int) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    repeat, longest = 0, 0
    if may_repeat(values, window):
        numbers: dict[bytes, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        repeat, longest = repetition(codes, window)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, longest


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS, share: int = SHARE, longest: int = LONGEST, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its measures, base_failed and kept; carry names further columns to pass on.

    share is the largest percentage of words in repeats, longest the most words of
    one repeat. A carried column may not have the name of a result.
    """
    results = {id_col, *FIELDS, "base_failed", "kept"}
    if results & set(carry):
        raise ValueError(f"carried columns clash with results: {sorted(results & set(carry))}")
    short_batches(docs.sparkSession)
    named = {c: "_text" if c == text_col else f"_carry{i}" for i, c in enumerate(carry)}
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(n) for c, n in named.items() if n != "_text"])
    fields = [f.name for f in kept.schema.fields if f.name != "_text" or "_text" in named.values()]
    schema = ", ".join(f"{n} {kept.schema[n].dataType.simpleString()}" for n in fields) + ", " + ", ".join(f"{n} long" for n in FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches):
            rows = np.array([measure(t, hashes, window) for t in batch.column("_text").to_pylist()], np.int64).reshape(-1, len(FIELDS))
            columns = [batch.column(n) for n in fields] + [pa.array(rows[:, i]) for i in range(len(FIELDS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, *FIELDS])

    out = kept.mapInArrow(run, schema)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > share * F.col("n_words"))
    return out.select(
        F.col("_id").alias(id_col), *[F.col(n).alias(c) for c, n in named.items()], *FIELDS, failed.alias("base_failed"), (~failed & (F.col("longest_repeat") <= longest)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("longest_repeat")


#: A repeat longer than 100 words is a window of 101 words that occurs twice.
ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
q AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM q, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY 1),
b AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(ws[i:i + 100], ' ')) AS h FROM (SELECT w.doc_id, ws, unnest(generate_series(1, len(ws) - 100)) AS i FROM w JOIN v ON v.doc_id = w.doc_id WHERE len(ws) >= 102)) GROUP BY doc_id, h HAVING count(*) > 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, b.doc_id IS NOT NULL AS long
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN v ON v.doc_id = w.doc_id LEFT JOIN b ON b.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT long AS kept FROM m
"""
