"""Packing token sequences: best fit, then swap-based local search.

1. Every text is tokenised whole, in its own task; only texts longer than a sequence are
   cut. What goes on is one narrow row per piece (place, length, checksum), written once.
2. Pieces are dealt by a hash into groups of about ``group_pieces``; the number of groups
   grows with the table and a group's size does not. Best fit decreasing packs a group.
3. Local search then tries to empty the group's least filled sequence: its pieces move to
   gaps, or are exchanged one for one, one for two or two for one with smaller pieces of
   fuller sequences. Every step raises the sum of squared fills, so it ends; it goes on
   with the next sequence, and with all of them again whenever one was emptied, until the
   lower bound is met, none can be emptied or the room left proves that.

Independent groups cost at most about one part-filled sequence each, of some thousands.

Words are tokenised through a memory of word -> ids with two generations, which is exact:
the tokenizer's pre-tokenizer never crosses ASCII white space, and drops it; it also lowers
letters first and keeps punctuation apart from the letters before it.

Defined results: a null text is empty and gives the single end id; equal rows are packed
each; a null id stays null; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, even_parts, materialise, slices

END_ID = b"\0\0\0\0"
REMEMBERED = 600_000
LONGEST = 64
TOGETHER = 64


def _bare(word: bytes) -> bytes:
    """``word`` without the signs at its end, if a letter or digit comes before them: the pre-tokenizer cuts there as well."""
    bare = word.rstrip(b".,;:!?*#$%&|()[]\"-+=/")
    if not bare or len(bare) == len(word) or not (bare[-1:].isalnum() or bare[-1] > 127 and bare.decode()[-1].isalpha()):
        return word
    return bare


class _Ids(dict):
    """word bytes -> little-endian 32-bit ids; the older of two generations is forgotten.

    New words of letters only go to the tokenizer many at a time, separated by spaces: each is one piece there,
    so the ids that end a piece tell them apart.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None and (bare := _bare(word)) != word:
            ids = self[bare] + self[word[len(bare):]]
        if ids is None:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def learn(self, words: set[bytes]) -> None:
        bare = {_bare(w) for w in words if w not in self}
        fresh = [w for w in (w.decode() for w in bare if len(w) <= LONGEST and w not in self and w not in self.older) if w.isalpha()]
        chunks = [fresh[i:i + TOGETHER] for i in range(0, len(fresh), TOGETHER)]
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(chunk) and ends[-1] == len(ids):  # else they are asked for one by one
                start = 0
                for word, end in zip(chunk, ends.tolist()):
                    self[word.encode()] = ids[start:end].tobytes()
                    start = end

    def of_all(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        split = []
        for text in texts:
            raw = text.encode()
            split.append((raw if b"<|" in raw else raw.lower()).split())  # special tokens are told apart by case
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, words)) + END_ID for words in split]

    def of(self, text: str) -> bytes:
        return self.of_all([text])[0]


_IDS: dict[str, _Ids] = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer lies on this machine; a cluster has it at the same place everywhere."""
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and an end id, cut only where too long."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        if tokenizer_path not in _IDS:
            _IDS[tokenizer_path] = _Ids(tokenizer_path)
        for part in (part for batch in batches for part in slices(batch)):
            rows: list[tuple] = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), _IDS[tokenizer_path].of_all(part.column("text").to_pylist())):
                view = memoryview(ids)
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = view[at:at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(piece) // 4, zlib.crc32(piece)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the fullest bin that still takes it."""
    bins = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i] = b
        open_bins[room - length].append(b)
        mask |= 1 << (room - length)
    return bins


def _exchange(own: np.ndarray, lengths: np.ndarray, bins: np.ndarray, gap: np.ndarray, others: np.ndarray) -> tuple[list[int], list[int]] | None:
    """The pieces that leave the bin and those that come back for them, from one other bin; None if no exchange helps.

    ``others`` are the pieces of the other bins with room; ``gap`` is the room of each bin.
    """
    wide = np.argmax(gap)
    fitting = own[lengths[own] <= gap[wide]]
    if len(fitting):  # a move
        return [int(fitting[np.argmax(lengths[fitting])])], [int(wide)]
    size, room = lengths[others], gap[bins[others]]
    order = own[np.argsort(-lengths[own])]
    pairs = [[int(a), int(b)] for i, a in enumerate(order) for b in order[i + 1:]]
    for leave in [[int(x)] for x in order] + pairs:  # one for one, two for one
        gain = int(lengths[leave].sum()) - size
        good = (gain > 0) & (gain <= room)
        if good.any():
            return leave, [-1, int(others[np.argmax(np.where(good, gain, 0))])]
    by_bin = others[np.argsort(bins[others], kind="stable")]
    bin_of, size = bins[by_bin], lengths[by_bin]
    pairs_of = []
    for step in range(1, len(by_bin)):  # pieces of one bin stand together
        near = np.flatnonzero(bin_of[step:] == bin_of[:-step])
        if not len(near):
            break
        pairs_of.append((near, near + step))
    if pairs_of:
        one, two = (np.concatenate(side) for side in zip(*pairs_of))
        sums, room = size[one] + size[two], gap[bin_of[one]]
        for x in order:  # one for two
            gain = lengths[x] - sums
            good = (gain > 0) & (gain <= room)
            if good.any():
                best = int(np.argmax(np.where(good, gain, 0)))
                return [int(x)], [-1, int(by_bin[one[best]]), int(by_bin[two[best]])]
    return None


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """``bins`` after exchanges that raise the sum of squared fills, with the emptied bins gone."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    tried = np.zeros(len(fill), bool)  # could not be emptied since a sequence last was
    while (fill > 0).sum() > least:
        donor = int(np.argmin(np.where((fill > 0) & ~tried, fill, capacity)))
        if fill[donor] in (0, capacity) or tried[donor]:
            break
        gap = np.where((fill > 0) & (fill >= fill[donor]), capacity - fill, 0)
        gap[donor] = 0
        if gap.sum() < fill[donor]:  # it cannot be emptied, nor can a fuller one
            break
        others = np.flatnonzero(gap[bins] > 0)
        own = np.flatnonzero(bins == donor)
        while len(own) and (found := _exchange(own, lengths, bins, gap, others)):
            leave, back = found
            come = back[1:]
            target = back[0] if not come else int(bins[come[0]])
            gain = int(lengths[leave].sum() - lengths[come].sum())
            bins[leave], bins[come] = target, donor
            fill[donor] -= gain
            fill[target] += gain
            gap[target] -= gain
            own = np.flatnonzero(bins == donor)
            others = np.flatnonzero(gap[bins] > 0)
        tried[donor] = len(own) > 0
        if not len(own):
            tried[:] = False
    return np.unique(bins, return_inverse=True)[1]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, group_pieces: int = 50_000,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies in which sequence."""
    cut = materialise(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    groups = even_parts(cut, group_pieces)

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        frame["sequence_id"] = (frame["part"].to_numpy(np.int64) << 40) + bins
        ends = frame.assign(bins=bins).groupby("bins")["length"].cumsum()
        frame["offset"] = ends - frame["length"]
        return frame.drop(columns="part")

    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    return cut.withColumn("part", part).groupBy("part").applyInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
