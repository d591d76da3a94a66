"""Substring dedup by line or paragraph hashing.

Every text is cut into units, which are normalised (A-Z lower-cased, words with one
space between) and hashed to 128 bits. Digests are grouped over the corpus with a
map-side minimum, so no group is collected; the earliest ranked occurrence of each
digest is kept and all others are removed. What is removed is given by its offsets
in the original.

Units are all lines with a word, or paragraphs between blank lines, and each whole
text; ``least_words`` can ask for longer ones. With ``passage`` words given, passages
inside units are found as well, wherever they begin and end: a text is also cut at
content-defined places, where a shingle of 8 words has the least hash of w shingles
about it, and the words from one such place to the end of the next one's shingle are
a unit. Equal runs are cut alike wherever they stand. With w = (passage - core) / 2
+ 1, units of the same cuts cover at least ``core`` words of any run of ``passage``
words. Cuts that go are united, and only spans of at least ``core`` words are
removed, so a run loses all but fewer than w words at either end.

Rank is the id, ascending, then the position in the text; each unit stays where it
has its least rank. Digests that very many units share are few, at most HOT_SHARE of
a corpus whatever its size, and are joined by broadcast; all others by shuffle.

Defined results: a null text is empty; a null id ranks before all others; rows that
share an id count as one document for ranking, so equal rows all keep their units;
a unit repeated inside one document is removed after its first occurrence; lines
without a word are no units and stay unless the whole text goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, ids, null_id, short_batches, slices
from cadenza.llm.wordcodes import Runs, Words, parts

NAME = "op3_unit_hashing"
ORACLE = None

#: Line ends between two words that end a unit.
UNITS = {"line": 1, "paragraph": 2}
SHINGLE = 8
#: Least words of a line or paragraph; of a run that is found wherever it stands; and of what such a run loses.
LEAST_WORDS, PASSAGE, CORE = 1, 50, 16
#: A digest is hot if more than one in HOT_SHARE units has it, so fewer than that many are.
HOT_SHARE = 100_000
DIGEST = ["h1", "h2"]
_LINE_END = np.uint8(10)


def line_units(words: Words, breaks: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) word of each unit with enough words, and its bytes with the ends of its lines."""
    ends = np.flatnonzero(words.data == _LINE_END)
    before = np.searchsorted(ends, words.start)
    opens = np.append(True, (words.text[1:] != words.text[:-1]) | (before[1:] - before[:-1] >= breaks))
    lo = np.flatnonzero(opens)
    hi = np.append(lo[1:], len(words))
    enough = hi - lo >= least_words
    lo, hi = lo[enough], hi[enough]
    around = np.concatenate([[-1], ends, [len(words.data)]])
    start = np.maximum(around[before[lo]] + 1, words.edges[words.text[lo]])
    stop = np.minimum(around[before[hi - 1] + 1], words.edges[words.text[lo] + 1])
    return lo, hi, start, stop


def shingle_values(runs: Runs, n: int) -> np.ndarray:
    """The hash of the shingle that begins at each word; the last few have none."""
    at = np.arange(max(0, n - SHINGLE + 1))
    return runs.digest(at, at + SHINGLE, 0)


def cuts(words: Words, values: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) word of each content-defined unit.

    A shingle is a cut if it is the least of some w neighbours in its text.
    """
    none = np.zeros(0, np.int64)
    n = len(values) - w + 1
    if n <= 0:
        return none, none
    least, reach = values, 1
    while reach < w:  # minima of 2, 4, ... and then w neighbours
        step = min(reach, w - reach)
        least, reach = np.minimum(least[: len(least) - step], least[step:]), reach + step
    within = words.text[:n] == words.text[n_last(n, w)]
    least = np.where(within, least, np.uint64(0))
    # the greatest of those minima over the windows that hold a shingle is its own value if it is a cut
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    most, reach = padded, 1
    while reach < w:
        step = min(reach, w - reach)
        most, reach = np.maximum(most[: len(most) - step], most[step:]), reach + step
    at = np.flatnonzero(most == values)
    same = words.text[at[1:]] == words.text[at[:-1]]
    return at[:-1][same], at[1:][same] + SHINGLE


def n_last(n: int, w: int) -> slice:
    """The last word of each window of w shingles, for the first n windows."""
    return slice(w + SHINGLE - 2, w + SHINGLE - 2 + n)


def unit_digests(docs: DataFrame, unit: str, least_words: int, passage: int, core: int) -> DataFrame:
    """docs(id, tag, text) to (id, tag, start, stop, soft, first, h1, h2), one row for each unit.

    Offsets are code points, stop exclusive; soft marks units of content-defined
    cuts, first a digest's first unit in its document.
    """
    w = (passage - core) // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                words = Words(part.column("text"))
                runs = Runs(words)
                lo, hi, start, stop = line_units(words, UNITS[unit], least_words)
                kinds = [(lo, hi, start, stop, 1)]
                first = np.flatnonzero(np.append(True, words.text[1:] != words.text[:-1])) if len(words) else np.zeros(0, np.int64)
                own = words.text[first]
                kinds.append((first, np.append(first[1:], len(words))[: len(first)], words.edges[own], words.edges[own + 1], 2))
                if passage:
                    lo, hi = cuts(words, shingle_values(runs, len(words)), w)
                    kinds.append((lo, hi, words.start[lo], words.stop[hi - 1], 3))
                at = np.concatenate([words.text[k[0]] for k in kinds])
                begin, end = (np.concatenate([k[j] for k in kinds]) for j in (2, 3))
                soft = np.repeat([k[4] == 3 for k in kinds], [len(k[0]) for k in kinds])
                h1, h2 = (np.concatenate([runs.digest(k[0], k[1], k[4], which) for k in kinds]) for which in (0, 1))
                order = np.lexsort((begin, h2, h1, at))
                again = (at[order][1:] == at[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                new = np.ones(len(at), bool)
                new[order[1:][again]] = False
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("tag").take(rows), pa.array(words.characters(begin, at), pa.int32()), pa.array(words.characters(end, at), pa.int32()),
                     pa.array(soft, pa.bool_()), pa.array(new, pa.bool_()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=["id", "tag", "start", "stop", "soft", "first", "h1", "h2"],
                )

    return docs.mapInArrow(run, "id long, tag long, start int, stop int, soft boolean, first boolean, h1 long, h2 long")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans made one, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def removed(text: str, spans: list[dict], core: int) -> list[tuple[int, int]]:
    """The spans of one text that go: all hard ones, and united soft ones with enough words."""
    soft = united([(s["start"], s["stop"]) for s in spans if s["soft"]])
    long = [(a, b) for a, b in soft if len(text[a:b].encode("utf-8", "surrogatepass").split()) >= core]
    return united([(s["start"], s["stop"]) for s in spans if not s["soft"]] + long)


def without(docs: DataFrame, core: int) -> DataFrame:
    """docs(id, text, spans) to (id, removed, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gone, kept = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                text = text or ""
                cut = removed(text, spans, core) if spans else []
                edges = [0, *[x for s in cut for x in s], len(text)]
                kept.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if cut else text)
                gone.append([{"start": a, "stop": b} for a, b in cut])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(gone, kind), pa.array(kept, pa.string())], names=["id", "removed", "kept_text"])

    return docs.select("id", "text", "spans").mapInArrow(run, "id long, removed array<struct<start:int,stop:int>>, kept_text string")


def elsewhere(units: DataFrame, scratch: Scratch) -> DataFrame:
    """The (saved) units that an earlier document holds too."""
    firsts = units.filter("first").groupBy(*DIGEST).agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"))
    owners = scratch.save(firsts.filter("owner < last"), "owners")
    hot = F.col("n") > units.count() // HOT_SHARE + 1000
    slim = units.select("id", "tag", "start", "stop", "soft", *DIGEST)
    hottest = F.broadcast(owners.filter(hot).select(*DIGEST, "owner"))  # fewer than HOT_SHARE rows
    common = slim.join(hottest, DIGEST).filter("id <> owner")
    others = slim.join(hottest.select(*DIGEST), DIGEST, "left_anti").join(owners.filter(~hot).select(*DIGEST, "owner").hint("merge"), DIGEST).filter("id <> owner")
    return common.unionByName(others)


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", least_words: int = LEAST_WORDS, passage: int = 0, core: int = CORE, scratch: Scratch | None = None) -> DataFrame:
    """Every row with n_removed, removed (array<struct<start, stop>>, original offsets) and kept_text.

    kept_text is the original without the removed spans; a removed line leaves its
    line end. passage is the number of words from which any repeated run is found;
    0 looks for none.
    """
    scratch = scratch or Scratch(docs.sparkSession, "units")
    short_batches(docs.sparkSession)
    rows = docs.select(ids(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    units = scratch.save(unit_digests(rows, unit, least_words, passage, core), "units")
    # later documents lose the unit; within a document, all but its first occurrence
    span = ["id", "tag", F.struct("start", "stop", "soft").alias("span")]
    lost = elsewhere(units, scratch).select(*span).unionByName(units.filter("NOT first").select(*span))
    gone = scratch.save(lost.groupBy("id", "tag").agg(F.collect_set("span").alias("spans")), "gone")
    scratch.drop("units")
    out = without(rows.join(gone.hint("merge"), ["id", "tag"], "left"), core)
    return out.select(null_id("id").alias(id_col), F.size("removed").cast("long").alias("n_removed"), "removed", "kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by all lines and by passages of 50 words."""
    out = dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), passage=PASSAGE)
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select("doc_id", "n_removed", spans.alias("removed_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))
