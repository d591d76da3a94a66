"""Packing: concatenate and cut.

Pass 1 tokenises every whole text once and stores the ids with the writing task's
number and each document's start inside that task's output. Pass 2 sums the task
totals - one row for each task - into global starts, cuts the one long sequence of
ids at every multiple of the window, and gives a boundary record for each piece.
Only the last sequence is short, so padding is less than one window in all.

Tokens are stored before the cut, so a task that runs again after a lost executor
cannot move any boundary: the committed output of pass 1 is what pass 2 reads.

Defined results: a null text is empty and gives the end id alone; empty tables
give no pieces; repeated rows, and rows that share an id or have none, are packed
each, in the order in which they are read; a text of any length is packed whole, over
as many sequences as it needs; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, maybe_broadcast, short_batches, slices

NAME = "op4_concatenate_and_cut"
ORACLE = None

#: Characters for which splitting by PIECE and lower-casing equals the tokenizer's
#: own normaliser and splitter: printable ASCII, line ends and Latin letters that
#: have no combining marks and lower-case to one character. Other texts, and those
#: with a special token's string, go to the tokenizer whole.
PLAIN = r"[\t\n\r\x20-\x7E\u00A1-\u012F\u0132-\u0148\u014A-\u017E\u2013\u2014\u2018-\u201E\u2026\u20AC]*"
#: The normalizers and the splitting pattern of the vocabulary file.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers, some 300 bytes each; beyond it, the less used half goes.
REMEMBERED = 400_000


class Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Encoder:
    """Ids of whole texts by a public byte-level BPE vocabulary with word ends.

    No piece of the splitting pattern holds white space and BPE works inside a
    piece, so the ids of a text are those of its words, which repeat and are
    remembered. It holds for vocabularies with that splitting pattern; for others,
    and for texts that are not plain, the whole text goes to the tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        shape = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = [s["pattern"].get("Regex") for s in steps if s.get("type") == "Split"] == [PIECE] and shape == NORMALIZERS
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(special) or "(?!)")
        self.plain, self.piece = regex.compile(PLAIN), regex.compile(PIECE)
        self.symbols = dict(enumerate(byte_symbols()))
        self._keep(Numbers(), np.zeros(1, np.int64), np.zeros(0, np.int32))

    def _keep(self, known: Numbers, starts: np.ndarray, pool: np.ndarray) -> None:
        self.known, self.starts, self.pool = known, starts, pool
        self.uses = np.zeros(len(known), np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _word(self, word: str) -> list[int]:
        tokenize = self.tokenizer.model.tokenize
        symbols = self.symbols
        return [t.id for p in self.piece.findall(word) for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(symbols))]

    def _learn(self) -> None:
        found = [self._word(w) for w in self.known.fresh]
        self.known.fresh.clear()
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in found for i in x), np.int32)])

    def _forget(self) -> None:
        """Keeps the half of the words that were met most since the last time."""
        kept = np.sort(np.argsort(self.uses, kind="stable")[-(REMEMBERED // 2) :])
        lo, n = self.starts[kept], self.starts[kept + 1] - self.starts[kept]
        pool, uses = self._gather(lo, n), self.uses[kept] // 2
        order = list(self.known)  # by number
        known = Numbers()
        known.update(zip(map(order.__getitem__, kept.tolist()), range(len(kept))))
        self._keep(known, np.concatenate([[0], np.cumsum(n)]), pool)
        self.uses = uses

    def _gather(self, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.pool[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, equal to the tokenizer's without special tokens added."""
        if len(self.known) > REMEMBERED:
            self._forget()
        number = self.known.__getitem__
        at: list[np.ndarray | None] = []
        for text in texts:
            if self.by_word and self.plain.fullmatch(text) and not self.special.search(text):
                words = text.lower().split()
                at.append(np.fromiter(map(number, words), np.int64, len(words)))
            else:
                at.append(None)
        if self.known.fresh:
            self._learn()
        plain = [x for x in at if x is not None]
        if plain:
            used = np.bincount(np.concatenate(plain), minlength=len(self.known))
            used[: len(self.uses)] += self.uses
            self.uses = used
        out = []
        for text, x in zip(texts, at):
            out.append(self._whole(text) if x is None else self._gather(self.starts[x], self.starts[x + 1] - self.starts[x]))
        return out


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters that a worker encodes at once.
CHUNK_CHARS = 2_000_000


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, task, local_start, n, ids): ids are little-endian unsigned 32-bit, end_id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, at = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_CHARS):
                    size += len(texts[hi])
                    hi += 1
                ids = [np.append(x, end_id).astype("<u4") for x in encoder.encode(texts[lo:hi])]
                n = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array([task] * (hi - lo), pa.int32()), pa.array(starts), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["id", "task", "local_start", "n", "ids"],
                )
                lo = hi

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, task int, local_start long, n long, ids binary")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Boundary records: one row for each piece of a document in a sequence.

    Returns id, start (ids of its document before it), length, ids (of the piece),
    doc_tokens, sequence_id, offset (in its sequence) and padding (of its sequence,
    0 for a full one).
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    short_batches(docs.sparkSession)
    tokens = scratch.save(tokenise(docs, path, end_id, id_col, text_col), "tokens")
    # one row for each task of pass 1, so the window and the broadcast are of that size
    totals = tokens.groupBy("task").agg(F.sum("n").alias("size"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy()).alias("corpus"))
    placed = tokens.join(maybe_broadcast(starts), "task").withColumn("at", F.col("base") + F.col("local_start"))

    def piece(k):
        lo = F.greatest(k * window, F.col("at"))
        hi = F.least((k + 1) * window, F.col("at") + F.col("n"))
        return F.struct(
            (lo - F.col("at")).alias("start"), (hi - lo).alias("length"), F.substring("ids", ((lo - F.col("at")) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"),
            k.alias("sequence_id"), (lo - k * window).alias("offset"), F.greatest((k + 1) * window - F.col("corpus"), F.lit(0)).alias("padding"),
        )

    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n") - 1) / window)
    pieces = F.transform(F.sequence(first.cast("long"), last.cast("long")), piece)
    return placed.select("id", F.col("n").alias("doc_tokens"), F.explode(pieces).alias("p")).select(F.col("id").alias(id_col), "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", "p.padding")


def vocabulary() -> str:
    """The path of the contract's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, vocabulary()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
