"""Shared parts of the corpus operators: input columns, words as hashes, written tables.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. The numpy helpers work
on slices of an Arrow batch (a few megabytes of text, one text at least), so a task's
memory follows the slice and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path

__all__ = ["WORD", "Words", "count_words", "dataset", "documents", "even_parts", "fold_ascii", "materialise", "mix",
           "scratch_path", "slices", "text_bytes", "words_of", "words_sql"]

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
LONG_WORD = 48

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under its own names; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_sql(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def count_words(text: Column) -> Column:
    """Number of words, by JVM expressions: separators become spaces, then word starts are counted."""
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     "))
    return F.regexp_count(spaced, F.lit(" [^ ]")).cast("long")


def even_parts(df: DataFrame, rows_each: int) -> int:
    """Number of equal parts for a written table; grows with the table."""
    return max(1, -(-df.count() // rows_each))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int | str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most ``limit`` bytes, or one row."""
    rows = batch.num_rows
    if not rows:
        return
    lengths = np.diff(text_bytes(batch.column(column))[1])
    ends = np.cumsum(lengths)
    start = 0
    while start < rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offset where each begins (and the end)."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    count = len(texts)
    if count == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(count + 1, np.int64)
    kind = np.int64 if wide else np.int32
    where = np.frombuffer(offsets, kind, count + 1 + texts.offset)[texts.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[where[0]:where[-1]], where - where[0]


def fold_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _FOLD[raw]


class Words:
    """Words of several texts: where each starts and ends, its hash, and each text's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.raw, self.offsets, self._docs = raw, offsets, None
        solid = ~_SPACE[raw]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        finish = solid.copy()
        finish[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begin[inner] = solid[inner]
        finish[inner - 1] = solid[inner - 1]
        self.solid = solid
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash() if hashed else None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        if self._docs is None:
            self._docs = np.repeat(np.arange(len(self.offsets) - 1), self.counts)
        return self._docs

    def _hash(self) -> np.ndarray:
        lengths = self.ends - self.starts
        h = np.full(len(lengths), 0x51ED270B9F5B2D4D, np.uint64)
        order = np.argsort(np.minimum(lengths, LONG_WORD + 1), kind="stable")[::-1]
        sizes = lengths[order]
        long = int(np.searchsorted(-sizes, -LONG_WORD, side="left"))
        for i in order[:long]:
            h[i] = xxhash.xxh3_64_intdigest(self.raw[self.starts[i]:self.ends[i]].tobytes())
        short, sizes = order[long:], sizes[long:]
        at, value = self.starts[short], h[short]
        for j in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -j, side="left"))
            value[:live] = (value[:live] + _TABLE[self.raw[at[:live] + j]]) * _ODD
            value[:live] ^= value[:live] >> np.uint64(29)
        h[short] = value
        return mix(h + lengths.astype(np.uint64))

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows inside one text, and the index of each window's first word."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.full(total - n + 1, seed, np.uint64)
        for i in range(n):
            h = (h + self.hashes[i:total - n + 1 + i]) * _ODD
            h ^= h >> np.uint64(32)
        doc = self.doc_of_word()
        at = np.flatnonzero(doc[:total - n + 1] == doc[n - 1:])
        return mix(h[at]), at


def words_of(texts: pa.Array, fold: bool = False, hashed: bool = True) -> Words:
    raw, offsets = text_bytes(texts)
    return Words(fold_ascii(raw) if fold else raw, offsets, hashed)
