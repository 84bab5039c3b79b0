"""Substring deduplication by seed and extend.

A passage is repeated where ``window`` consecutive words also start earlier. Winnowing with
anchors of ``anchor`` words picks, in every window of ``window`` words, the last of the smallest
anchor hashes. Equal windows pick the same anchor at the same place, so only seeds with
the same anchor can hold equal windows, and every window belongs to exactly one seed.

1. Seeds: each task finds the anchors of its texts. A seed carries, for each window that picked it,
   a fingerprint of the anchor extended left and right to the window. Within a slice of
   texts, windows seen before are settled at once and only the first of each goes on: the
   pre-aggregation that keeps a passage shared by a third of all documents from meeting in one task.
2. Join and extend: seeds meet by anchor, ordered by document and position. A seed's
   extension that agrees with an earlier seed's is a match of ``window`` words at least. The stream
   over a partition keeps the extensions of one anchor, one entry per different text
   around it, however often it occurs.
3. Maximal repeats: matches of a document that overlap or touch are merged, and their words removed.

Windows are compared by 64 bits of their anchor and 40 bits of themselves.

Defined results: a null text has no words; documents are ordered by id (null first), rows
with one id are one document for the question which starts earlier, and equal rows get equal results; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents, mix, slices, text_bytes

WINDOW, ANCHOR = 20, 6
PRINT_BYTES = 5
_SEEDS = "anchor long, doc_id long, text_key long, at long, extensions binary, settled boolean"
_SPANS = "doc_id long, text_key long, start long, length long"


def _picked(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes: the position of the last smallest."""
    count = len(hashes) - width + 1
    best, where = hashes[:count].copy(), np.arange(count)
    for i in range(1, width):
        here = hashes[i:i + count]
        lower = here <= best
        best[lower] = here[lower]
        where[lower] = np.flatnonzero(lower) + i
    return where


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(starts, append=len(values))


def _narrow(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PRINT_BYTES].tobytes()


def _wide(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // PRINT_BYTES, 8), np.uint8)
    out[:, :PRINT_BYTES] = raw.reshape(-1, PRINT_BYTES)
    return out.reshape(-1).view("<u8")


def _doc_order(ids: pa.Array) -> np.ndarray:
    """Rank of each id, null first, equal ids alike."""
    values, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((values, valid))
    changed = np.concatenate([[0], (np.diff(values[order]) != 0) | (np.diff(valid[order].astype(int)) != 0)]) if len(order) else []
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(changed)
    return rank


def _seeds_of(part: pa.RecordBatch, window: int, anchor: int) -> pa.RecordBatch | None:
    texts = Words(*text_bytes(part.column("text")))
    whole, at = texts.grams(window, seed=1)
    if not len(at):
        return None
    cores, core_at = texts.grams(anchor, seed=2)
    by_word = np.zeros(len(texts.starts), np.uint64)
    by_word[core_at] = cores
    # a window's anchors start at its first window - anchor + 1 words
    width = window - anchor + 1
    picked = _picked(by_word, width)[at]
    doc = texts.doc_of_word()[at]
    rank = _doc_order(part.column("doc_id"))[doc]
    place = at - texts.first[doc]
    order = np.lexsort((place, rank, whole))
    same = np.concatenate([[False], whole[order][1:] == whole[order][:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(at), dtype=bool)
    later[order] = same & ((rank[order] != rank[order][head]) | (place[order] != place[order][head]))
    out = []
    for settled in (False, True):
        keep = np.flatnonzero(later == settled)
        # windows in a row that picked one anchor make a seed; settled ones need only their place
        new = np.ones(len(keep), dtype=bool)
        new[1:] = (np.diff(at[keep]) != 1) | (np.diff(doc[keep]) != 0)
        if not settled:
            new[1:] |= np.diff(picked[keep]) != 0
        starts, sizes = _runs(np.cumsum(new))
        first = keep[starts]
        prints = _narrow(sizes.astype(np.uint64) if settled else whole[keep])
        bounds = np.arange(len(starts) + 1) if settled else np.concatenate([starts, [len(keep)]])
        payload = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((bounds * PRINT_BYTES).astype(np.int32)), pa.py_buffer(prints)])
        key = mix(whole[first]) if settled else by_word[picked[first]]
        out.append((key, doc[first], place[first], payload, np.full(len(first), settled)))
    columns = [np.concatenate([out[0][i], out[1][i]]) for i in (0, 1, 2, 4)]
    ext = pa.concat_arrays([out[0][3], out[1][3]])
    take = pa.array(columns[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0].view(np.int64)), part.column("doc_id").take(take), part.column("text_key").take(take),
         pa.array(columns[2]), ext, pa.array(columns[3])], [p.split(" ")[0] for p in _SEEDS.split(", ")])


def seeds(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Anchors with their windows' fingerprints, and windows settled inside a slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = _seeds_of(part, window, anchor)
                if found is not None:
                    yield found

    keyed = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, _SEEDS)


def matches(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of words (doc_id, text_key, start, length) that lie in windows which also start earlier."""
    names = [p.split(" ")[0] for p in _SPANS.split(", ")]
    ordered = found.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_first(), "at")

    def run(batches):
        seen_anchor, seen = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = text_bytes(batch.column("extensions"))
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            first, sizes = offsets[:-1] // PRINT_BYTES, np.diff(offsets) // PRINT_BYTES
            words = _wide(raw)
            seed = np.repeat(np.arange(batch.num_rows), sizes)
            step = np.arange(len(words)) - np.repeat(first, sizes)
            anchors = batch.column("anchor").to_numpy()
            at = batch.column("at").to_numpy()
            rank = _doc_order(batch.column("doc_id"))
            # the first of equal extensions of one anchor; rows come in order of document and position
            live = np.flatnonzero(~settled[seed])
            key = mix(anchors[seed[live]].view(np.uint64)) ^ words[live]
            order = np.lexsort((live, key))
            same = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(order) else np.zeros(0, bool)
            head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
            place = at[seed] + step
            a, b = live[order], live[head]
            later = np.zeros(len(words), dtype=bool)
            later[a] = same & ((rank[seed[a]] != rank[seed[b]]) | (place[a] != place[b]))
            # the anchor that goes on over the end of a batch
            if seen_anchor is not None and anchors[0] == seen_anchor:
                for i in live[anchors[seed[live]] == seen_anchor].tolist():
                    before = seen.get(int(words[i]))
                    if before is not None and before != (batch.column("doc_id")[int(seed[i])].as_py(), int(place[i])):
                        later[i] = True
            if seen_anchor is None or anchors[-1] != seen_anchor:
                seen_anchor, seen = anchors[-1], {}
            for i in live[anchors[seed[live]] == seen_anchor].tolist():
                if int(words[i]) not in seen:
                    seen[int(words[i])] = (batch.column("doc_id")[int(seed[i])].as_py(), int(place[i]))
            hit = np.flatnonzero(later)
            new = np.concatenate([[True], (np.diff(seed[hit]) != 0) | (np.diff(place[hit]) != 1)]) if len(hit) else np.zeros(0, bool)
            starts, lengths = _runs(np.cumsum(new))
            rows = np.concatenate([seed[hit[starts]], np.flatnonzero(settled)])
            begin = np.concatenate([place[hit[starts]], at[settled]])
            size = np.concatenate([lengths, words[first[settled]].astype(np.int64)]) + window - 1
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), batch.column("text_key").take(pa.array(rows)),
                                                  pa.array(begin), pa.array(size)], names)

    return ordered.mapInArrow(run, _SPANS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, repeats (maximal, in words), kept text if wanted.

    The kept words are joined by one space.
    """
    spans = (matches(seeds(docs, window, anchor, id_col, text_col), window).groupBy("doc_id", "text_key")
             .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans")))
    keyed = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    joined = keyed.alias("d").join(spans.alias("f"), same, "left").select("d.doc_id", "text", "spans.start", "spans.length")
    schema = ("doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:bigint,length:bigint>>"
              + ", kept string" * with_text)
    names = [part.split(" ")[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, starts, lengths in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = text.encode().split()
                whole: list[list[int]] = []
                for start, length in zip(starts or (), lengths or ()):
                    if whole and start <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], start + length)
                    else:
                        whole.append([start, start + length])
                left, at = [], 0
                for lo, hi in whole:
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                kept = b" ".join(left)
                row = (doc, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), [{"start": lo, "length": hi - lo} for lo, hi in whole])
                rows.append((*row, kept.decode()) if with_text else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return joined.mapInArrow(run, schema)
