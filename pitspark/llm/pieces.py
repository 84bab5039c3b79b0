"""SentencePiece ids of whole texts by a table of distinct marked words.

In the models this operator accepts no piece holds a white-space marker after another sign, so
pieces never cross the start of a marked word (a run of markers and what follows it), and a
text's ids are the ids of its marked words, joined.

1. A task cuts blocks of about ``BLOCK_BYTES`` of text into marked words. A block becomes its
   list of distinct words, dealt over buckets by their hash, and its texts as positions in that
   list. Both are written once; positions take about half the space of compressed text.
2. A bucket meets the words of all blocks, gives each distinct one to the library once, and
   answers every block in the order asked.
3. A block's answers and positions meet again, and ids and decoded text are gathered by position.

The number of buckets grows with the bytes of text, so a bucket's memory does not; a word found
everywhere is one entry per block. A text longer than a block is a block of its own.

Defined results: a null text is empty and gives the end id alone; equal rows are encoded each; a
null id stays null; an empty table gives an empty table; other columns are not read. A model that
rewrites texts, or whose pieces cross markers, is refused.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise

BLOCK_BYTES = 32 << 20
#: text bytes per bucket; about a fifth of them are distinct words of some block
BUCKET_BYTES = 64 << 20
FREQUENT = 4096
SHARED = 8
TOGETHER = 20_000
OUT_IDS = 1 << 20
_CHUNK = re.compile(" +[^ ]*")
_CROSSING = re.compile("[^▁]▁")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """Where a public model lies on this machine; a cluster has it at the same place everywhere."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Model:
    """A model of the library, checked for what the distinct-word table needs."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.library = library = SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        if library.normalize("ﬁ  x ") != "▁ﬁ▁▁x▁":
            raise ValueError("the model rewrites texts, so marked words cannot be cut from them")
        if any(_CROSSING.search(library.id_to_piece(i)) for i in range(size)):
            raise ValueError("the model's pieces cross white-space markers")
        self.end = library.eos_id()
        self.surfaces = [b"" if library.is_control(i) else
                         bytes([int(library.id_to_piece(i)[1:-1], 16)]) if library.is_byte(i) else
                         library.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.lone_marker = library.encode("x ")[len(library.encode("x")):]

    def of_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words; the library sets the first marker itself."""
        found = self.library.encode([w[1:] for w in words], num_threads=1)
        return [ids if word != " " else self.lone_marker for word, ids in zip(words, found)]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def marked_words(text: str) -> list[str]:
    """The text's marked words in order, markers written as spaces; joined, they are a marker and the text."""
    return _CHUNK.findall(" " + text.replace("▁", " ")) if text else []


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, compressed: the bit lengths of all, then per length the other bits, byte plane by byte plane."""
    values = np.asarray(values, np.int64)
    length = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    parts = [len(values).to_bytes(8, "little"), length.tobytes()]
    for n in range(2, 33):
        rest = (values[length == n] - (1 << (n - 1))).astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.ascontiguousarray(rest.T[:(n + 6) // 8]).tobytes())
    settings = zstandard.ZstdCompressionParameters.from_level(3, window_log=25, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=settings).compress(b"".join(parts))


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(data), np.uint8)
    count = int.from_bytes(raw[:8].tobytes(), "little")
    length, at = raw[8:8 + count], 8 + count
    values = (length > 0).astype(np.int64)
    for n, times in enumerate(np.bincount(length, minlength=33).tolist()):
        if n >= 2 and times:
            planes = (n + 6) // 8
            rest = np.zeros((times, 4), np.uint8)
            rest[:, :planes] = raw[at:at + planes * times].reshape(planes, times).T
            values[length == n] = rest.view("<u4").ravel().astype(np.int64) + (1 << (n - 1))
            at += planes * times
    return values


def _fold(starts: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many leading pieces each word shares with the word before it (``SHARED`` at most), and all other pieces."""
    shared = np.zeros(len(starts) - 1, np.int64)
    live = np.arange(1, len(shared))
    for n in range(SHARED):
        live = live[(starts[live] + n < starts[live + 1]) & (starts[live - 1] + n < starts[live])]
        live = live[pieces[starts[live] + n] == pieces[starts[live - 1] + n]]
        shared[live] += 1
    kept = np.ones(len(pieces), bool)
    kept[_gather(np.stack([starts[:-1], starts[:-1] + shared], 1).ravel(), 2 * np.arange(len(shared)))] = False
    return shared, pieces[kept]


def _unfold(sizes: np.ndarray, shared: np.ndarray, rest: np.ndarray) -> np.ndarray:
    starts, own = _starts(sizes), _starts(sizes - shared)
    pieces = np.empty(starts[-1], np.int64)
    first = starts[:-1] + shared
    pieces[_gather(np.stack([first, starts[1:]], 1).ravel(), 2 * np.arange(len(sizes)))] = rest
    for n in range(int(shared.max()) if len(shared) else 0):
        # the last word before that says its own piece at this place
        says = np.maximum.accumulate(np.where(shared <= n, np.arange(len(shared)), 0))
        mine = np.flatnonzero(shared > n)
        pieces[starts[mine] + n] = rest[own[says[mine]] + n - shared[says[mine]]]
    return pieces


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _gather(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the items of runs ``which``, where run i lies at starts[i]:starts[i + 1]."""
    sizes = starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    return np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Block:
    """Texts of one block on the way in."""

    def __init__(self):
        self.ids, self.counts, self.codes, self.size = [], [], [], 0
        self.seen: dict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__

    def add(self, doc: int | None, text: str) -> None:
        words = marked_words(text)
        self.ids.append(doc)
        self.counts.append(len(words))
        self.codes.append(np.fromiter(map(self.seen.__getitem__, words), np.uint32, len(words)))
        self.size += len(text)

    def rows(self, block: int, buckets: int):
        """One row of positions, and one row of words per bucket.

        The list of words is in order of (bucket, word). A position is written as the rank of a
        frequent word or, behind those, as its place in the list.
        """
        words = pa.array(list(self.seen), pa.large_string())
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in self.seen), np.int64, len(self.seen))
        order = pc.sort_indices(pa.table({"b": bucket, "w": words}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        often = np.argsort(-np.bincount(codes, minlength=len(order)), kind="stable")[:FREQUENT]
        written = place + len(often)
        written[often] = np.arange(len(often))
        yield (block, -1, _pack(written[codes]), _pack(place[often]), self.ids, _pack(np.array(self.counts, np.int64)))
        bucket = bucket[order]
        for b in np.unique(bucket).tolist():
            mine = words.take(order[slice(*np.searchsorted(bucket, [b, b + 1]))])
            yield (block, b, zstandard.ZstdCompressor(3).compress("".join(mine.to_pylist()).encode()),
                   _pack(pc.binary_length(mine).to_numpy()), None, None)


_BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary()), ("extra", pa.binary()),
                     ("ids", pa.list_(pa.int64())), ("counts", pa.binary())])
_BLOCK_COLUMNS = "block long, bucket int, body binary, extra binary, ids array<long>, counts binary"


def _blocks(docs: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, _Block()

        def flush():
            for row in held.rows(number, buckets):
                yield pa.RecordBatch.from_pylist([dict(zip(_BLOCKS.names, row))], _BLOCKS)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.add(doc, text.as_py())
                if held.size >= block_bytes:
                    yield from flush()
                    number, held = number + 1, _Block()
        if held.ids:
            yield from flush()

    return docs.mapInArrow(run, _BLOCK_COLUMNS)


def _answers(blocks: DataFrame, path: str) -> DataFrame:
    """(block, bucket, sizes, shared, pieces): ids of each block's words; every distinct word of a bucket is segmented once."""
    def run(table: pa.Table) -> pa.Table:
        asked, counts = [], []
        for body, lengths in zip(table.column("body").to_pylist(), table.column("extra").to_pylist()):
            ends = _starts(_unpack(lengths))
            raw = pa.py_buffer(zstandard.ZstdDecompressor().decompress(body))
            asked.append(pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), raw]))
            counts.append(len(ends) - 1)
        coded = pa.chunked_array(asked, pa.large_string()).combine_chunks().dictionary_encode()
        known, sizes, pieces = coded.dictionary, [], []
        for at in range(0, len(known), TOGETHER):
            found = model(path).of_words(known.slice(at, TOGETHER).to_pylist())
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            pieces.append(np.fromiter((i for ids in found for i in ids), np.int64, int(sizes[-1].sum())))
        sizes, pieces = np.concatenate(sizes), np.concatenate(pieces)
        starts, rows, at = _starts(sizes), [], 0
        for n in counts:
            which = coded.indices.slice(at, n).to_numpy().astype(np.int64)
            shared, rest = _fold(_starts(sizes[which]), pieces[_gather(starts, which)])
            rows.append((_pack(sizes[which]), _pack(shared), _pack(rest)))
            at += n
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in enumerate(("sizes", "shared", "pieces"))}})

    asked = blocks.filter("bucket >= 0").select("block", "bucket", "body", "extra")
    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, sizes binary, shared binary, pieces binary")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES, out_ids: int = OUT_IDS) -> DataFrame:
    """doc_id, n_tokens, ids (with the end id), decoded: each text's ids, and the text these ids decode to.

    ``block_bytes`` bounds a block of texts and ``out_ids`` the ids of a batch of results; one text may exceed both.
    """
    docs = documents(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = materialise(_blocks(docs, max(8, -(-size // BUCKET_BYTES)), block_bytes), "pieces_blocks")

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        known = model(model_path)
        row = {name: mine.column(name)[0].as_py() for name in mine.column_names}
        parts = [tuple(_unpack(answer[name]) for name in ("sizes", "shared", "pieces")) for answer in answers.sort_by("bucket").to_pylist()]
        none = [np.zeros(0, np.int64)]
        sizes = np.concatenate([p[0] for p in parts] or none)
        pieces = np.concatenate([_unfold(*p) for p in parts] or none)
        starts = _starts(sizes)
        top, codes, first = _unpack(row["extra"]), _unpack(row["body"]), _starts(_unpack(row["counts"]))
        codes = np.concatenate([top, np.arange(len(sizes))])[codes]
        before = _starts(sizes[codes])[first]  # ids before each text
        surface = np.frombuffer(b"".join(known.surfaces), np.uint8)
        at = _starts(np.fromiter(map(len, known.surfaces), np.int64, len(known.surfaces)))
        out, low = [], 0
        while low < len(row["ids"]):
            high = max(low + 1, int(np.searchsorted(before, before[low] + out_ids, side="right")) - 1)
            ids = pieces[_gather(starts, codes[first[low]:first[high]])]
            ends = before[low:high + 1] - before[low]
            size = _starts(at[ids + 1] - at[ids])[ends]
            # the marker that the library set before a text is no part of it
            leading = size[:-1][size[1:] > size[:-1]]
            text = np.delete(surface[_gather(at, ids)], leading)
            size = size - np.searchsorted(leading, size, side="left")
            whole = np.insert(ids, ends[1:], known.end).astype(np.int32)
            tokens = ends + np.arange(len(ends))
            out.append(pa.RecordBatch.from_arrays([
                pa.array(row["ids"][low:high], pa.int64()), pa.array(np.diff(tokens)),
                pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(whole)),
                pa.Array.from_buffers(pa.string(), high - low, [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(text)])], schema=_OUT))
            low = high
        return pa.Table.from_batches(out, _OUT)

    texts = blocks.filter("bucket < 0").select("block", "body", "extra", "ids", "counts")
    return texts.groupBy("block").cogroup(_answers(blocks, model_path).groupBy("block")).applyInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, decoded string")
