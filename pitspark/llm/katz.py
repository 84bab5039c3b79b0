"""A Katz back-off n-gram model of any order, counted and evaluated over whole tables.

``P(w | h) = d(c) c(h, w) / D(h)`` where the n-gram is kept (seen ``MIN_COUNT`` times in
training), else ``alpha(h) P(w | h')`` with the history h' that is one word shorter, down to
``P(w) = d(c) c(w) / N``, and one unknown word holds the rest. Before a text stand end tokens.
``d`` are Good-Turing discounts of each order up to count ``K``, and alpha(h) is what the kept n-grams leave of
the history's mass, divided by what their words leave of the mass of the shorter history: for every
history the probabilities add up to one.

Texts are coded in blocks of a few megabytes, one row per block: the block's distinct words
(64-bit hashes), and every text as places in that list. Blocks ask, and tables
partitioned by key answer:

1. ``coded``: the blocks.
2. ``count_shortest``: each block sends its distinct words and bigrams (a 48-bit code within the bucket), already
   counted, to the bucket of each key, and gets the corpus counts back in the same order. A frequent word or
   n-gram is one entry per block, and n-grams spread by all their words, so no bucket is hot.
3. ``backoff_sums``, once for each order from 2 on: the first block that holds an n-gram in training adds what its
   discount frees and the probability of its shorter n-gram to its history; sums per history, in the history's bucket,
   give alpha and D. They are told and asked for only where the n-grams of one block do not settle them. On the
   same way go the n-grams one longer, except those whose history or end is not in training or is found once in all texts:
   their count follows.
4. Each block evaluates its texts token by token: the longest kept n-gram, else alpha times the shorter one.

D(h) is how often h was seen, or 0.5 above its mass where the discounts free less than that: most blocks know it from
their own n-grams. Alpha is needed where an n-gram is not kept. The shuffle files of a step are removed when its table is written.

The number of buckets grows with the table; blocks and buckets keep their size.

Defined results: a null text is empty and has the end token only; a null id counts as the empty text
for the fold; equal rows are scored alike and counted each; without training rows every word is the
unknown one, with probability 1; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_removed
from .common import Words, documents, fold_ascii, materialise, mix, slices, text_bytes

K, MIN_COUNT = 5, 1
BLOCK_BYTES = 8 << 20
CODE_BYTES = 6
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_CODED = "block long, words binary, ids binary, doc_ids array<bigint>, lengths binary, train binary"
_QUESTIONS = "kind int, block long, bucket long, keys binary, counts binary, sums binary, alone long"
_ANSWERS = "kind int, block long, bucket long, counts binary, stats array<double>"


def _names(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ")]


def code_blocks(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of texts; ``training`` is a condition over doc_id."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                raw, offsets = text_bytes(part.column("text"))
                words = Words(fold_ascii(raw), offsets)
                tokens = np.insert(words.hashes, words.first[1:], END)
                distinct, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                yield pa.RecordBatch.from_arrays([
                    pa.array([task << 32 | number], pa.int64()), pa.array([distinct[order].tobytes()], pa.binary()),
                    pa.array([_pack(rank[ids])], pa.binary()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([(words.counts + 1).astype("<u4").tobytes()], pa.binary()),
                    pa.array([part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary())], _names(_CODED))
                number += 1

    return documents(docs, id_col, text_col).select("doc_id", "text", training.alias("train")).mapInArrow(run, _CODED)


def _joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(history) * np.uint64(0x9E3779B97F4A7C15) + word)


def _runs(sorted_values: np.ndarray):
    edges = np.flatnonzero(np.diff(sorted_values, prepend=-1, append=-1))
    return zip(edges[:-1], edges[1:])


def _narrow(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // CODE_BYTES, 8), np.uint8)
    out[:, :CODE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, CODE_BYTES)
    return out.reshape(-1).view("<u8")


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueeze(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0, all their lowest bytes first, then the next ones, as far as the largest goes."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _squeeze(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unsqueeze(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.reshape(-1).view("<i8")


class _Level:
    """The distinct n-grams of a block: hashes, counts in training, whether other texts have them, the gram of each token,
    and of each gram its history (a place in the level below, or the place behind its last for the start of a text) and
    its end of n - 1 words."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, learned: np.ndarray, history: np.ndarray | None = None, suffix: np.ndarray | None = None):
        self.hashes, self.of, self.history, self.suffix = hashes, of, history, suffix
        self.counts = np.bincount(of[learned], minlength=len(hashes))
        self.other = np.bincount(of, minlength=len(hashes)) > self.counts


class _Histories(NamedTuple):
    """Of a level's histories: how often each was seen; what its n-grams here free of it and their sum in the shorter history, of all
    and of those first held here; which are asked for, which are told; their hashes."""

    seen: np.ndarray
    freed: np.ndarray
    lower: np.ndarray
    told_sums: np.ndarray
    asked: np.ndarray
    told: np.ndarray
    hashes: np.ndarray


class _Block:
    """A coded block, its distinct n-grams, and what is known of them so far: corpus counts, then probabilities."""

    def __init__(self, row: dict, buckets: int):
        self.number, self.buckets = row["block"], buckets
        words = np.frombuffer(row["words"], "<u8")
        self.ids = _unpack(row["ids"])
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.learned = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), self.lengths)
        self.end = int(np.flatnonzero(words == END)[0])
        self.levels, self.pads = {1: _Level(words, self.ids, self.learned)}, {1: np.array([END])}
        self.counts: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}  # this block is the first that holds the n-gram in training
        self.held: dict[int, np.ndarray] = {}  # a text outside training has the n-gram
        self.p = np.zeros(0)

    def level(self, n: int) -> _Level:
        if n not in self.levels:
            lower, words = self.level(n - 1), self.levels[1].hashes
            before = np.empty_like(lower.of)
            before[1:] = lower.of[:-1]
            before[self.starts] = self.end if n == 2 else len(lower.hashes)  # before a text stand ends
            grams, place = np.unique(before * len(words) + self.ids, return_inverse=True)
            history, suffix = grams // len(words), np.empty_like(grams)
            suffix[place] = lower.of
            self.levels[n] = _Level(_joined(self.below(n)[history], words[grams - history * len(words)]), place, self.learned, history, suffix)
        return self.levels[n]

    def below(self, n: int) -> np.ndarray:
        """Hashes of the histories of n-grams."""
        if n == 2:
            return self.levels[1].hashes
        if n - 1 not in self.pads:
            self.pads[n - 1] = _joined(self.below(n - 1)[-1:] if n > 3 else self.pads[1], self.pads[1])
        return np.concatenate([self.level(n - 1).hashes, self.pads[n - 1]])

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)

    def _dealt(self, hashes: np.ndarray):
        """(bucket, from, to) of hashes in ascending order."""
        bucket = self._bucket(hashes)
        return ((int(bucket[lo]), lo, hi) for lo, hi in _runs(bucket))

    def _settled(self, n: int) -> np.ndarray:
        """N-grams whose count follows from their history or end: not in training, or found this once in all texts."""
        level = self.level(n)
        if n < 3:
            return np.zeros(len(level.hashes), bool)
        shorter = (self.counts[n - 1] == 0) | (self.counts[n - 1] == 1) & ~self.held[n - 1]
        return np.append(shorter, False)[level.history] | shorter[level.suffix]

    def _asked(self, n: int) -> np.ndarray:
        asked = np.flatnonzero(~self._settled(n))
        return asked[np.argsort(self.level(n).hashes[asked])]

    def questions(self, n: int) -> list[tuple]:
        """Rows of ``_QUESTIONS``: the n-grams of each bucket, and how many were settled here with a count of one."""
        level, asked = self.level(n), self._asked(n)
        hashes, values = level.hashes[asked], level.counts[asked] << 1 | level.other[asked]
        rows = [(n, self.number, bucket, hashes[lo:hi].astype("<u8").tobytes() if n == 1 else _narrow(hashes[lo:hi]), _pack(values[lo:hi]), None, 0)
                for bucket, lo, hi in self._dealt(hashes)]
        if alone := int(level.counts.sum() - level.counts[asked].sum()):
            rows.append((n, self.number, 0, None, None, None, alone))
        return rows

    def take(self, n: int, found: dict[int, list]) -> None:
        """The corpus counts of this block's n-grams."""
        level, asked = self.level(n), self._asked(n)
        value = level.counts << 2 | 2  # settled ones are known here
        if len(asked):
            value[asked] = np.concatenate([_unpack(raw) for _, raw in sorted(found[n])])
        self.counts[n], self.first[n], self.held[n] = value >> 2, value & 2 > 0, value & 1 > 0

    def histories(self, n: int, model: _Model) -> _Histories:
        level, count, hashes = self.level(n), self.counts[n], self.below(n)
        seen, held = self.counts[n - 1], self.held[n - 1]
        if n > 2:  # a text starts as often as one ends
            seen, held = np.append(seen, self.counts[1][self.end]), np.append(held, True)

        def sums(values):
            return np.bincount(level.history, weights=values, minlength=len(hashes))

        kept = count >= MIN_COUNT
        each, shorter = count - model.mass(n, count), np.where(kept, self.p[level.suffix], 0.0)
        freed, lower, mine = sums(each), sums(shorter), self.first[n] & (count > 0)
        whole = sums(count) == seen  # whatever follows it in training follows it here
        shared = held | (sums(level.counts) < seen)  # other blocks may have it
        asked = ~whole & ((sums(~kept) > 0) | (sums(kept) > 0) & (freed < 0.5))
        backs_off = held | (MIN_COUNT > 1)
        told = (sums(mine) > 0) & shared & (backs_off | (seen >= model.least(n)))
        return _Histories(seen, freed, lower, np.stack([sums(each * mine), np.where(backs_off, sums(shorter * mine), 0.0)]), asked, told, hashes)

    def tell(self, n: int, model: _Model) -> list[tuple]:
        """Rows of ``_QUESTIONS``: sums over the n-grams first held here, for histories that other blocks may ask for, and which are asked for."""
        of = self.histories(n, model)
        at = np.flatnonzero(of.asked | of.told)
        at = at[np.argsort(of.hashes[at])]
        hashes, asked, sums = of.hashes[at], of.asked[at], (of.told_sums * of.told)[:, at].astype("<f8")
        return [(-n, self.number, bucket, _narrow(hashes[lo:hi]), _pack(asked[lo:hi]), _squeeze(sums[:, lo:hi].tobytes()), 0) for bucket, lo, hi in self._dealt(hashes)]

    def weigh(self, n: int, model: _Model, found: dict[int, list]) -> None:
        """P of this block's n-grams: the kept ones' own, else alpha times that of their last n - 1 words."""
        if n == 1:
            self.p = model.p_word(self.counts[1])
            return
        of, level, count = self.histories(n, model), self.level(n), self.counts[n]
        at = np.flatnonzero(of.asked)
        at = at[np.argsort(of.hashes[at])]
        if len(at):
            of.freed[at], of.lower[at] = np.concatenate([np.frombuffer(_unsqueeze(raw), "<f8").reshape(2, -1) for _, raw in sorted(found[-n])], axis=1)
        total = of.seen + np.maximum(0.0, 0.5 - of.freed)
        with np.errstate(all="ignore"):  # of histories that nothing here backs off from
            alpha = np.where(of.seen > of.freed, (total - of.seen + of.freed) / total / (1.0 - of.lower), 1.0)
            self.p = np.where(count >= MIN_COUNT, model.mass(n, count) / total[level.history], alpha[level.history] * self.p[level.suffix])


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=_names(_QUESTIONS))


def _counted(kind: int, rows: list[dict]) -> tuple[list[bytes], list[float]]:
    """The corpus counts of a bucket's n-grams for each row, and its counts of counts, distinct n-grams and occurrences."""
    sent = [_unpack(r["counts"]) for r in rows]
    values = np.concatenate([*sent, np.zeros(0, np.int64)])
    raw = b"".join(r["keys"] for r in rows)
    inverse = np.unique(np.frombuffer(raw, "<u8") if kind == 1 else _wide(raw), return_inverse=True)[1]
    total = np.bincount(inverse, weights=values >> 1).astype(np.int64)
    learned = np.flatnonzero(values >> 1)
    first = np.zeros(len(total), np.int64)
    first[inverse[learned[::-1]]] = learned[::-1]
    held = np.zeros(len(total), bool)
    held[inverse[values & 1 > 0]] = True
    stats = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1:K + 2].tolist() + [int((total > 0).sum()), int(total.sum())]
    reply = (total << 2 | held)[inverse]
    reply[first[total > 0]] |= 2
    ends = np.cumsum([len(v) for v in sent])
    return [_pack(reply[hi - len(v):hi]) for v, hi in zip(sent, ends)], stats


def _summed(rows: list[dict]) -> list[bytes | None]:
    """What all blocks tell of the histories that a row asks for, in its order."""
    asked = [_unpack(r["counts"]) > 0 for r in rows]
    _, inverse = np.unique(_wide(b"".join(r["keys"] for r in rows)), return_inverse=True)
    told = np.concatenate([np.frombuffer(_unsqueeze(r["sums"]), "<f8").reshape(2, -1) for r in rows], axis=1)
    sums = np.stack([np.bincount(inverse, weights=v) for v in told])
    ends = np.cumsum([len(a) for a in asked])
    return [_squeeze(sums[:, inverse[hi - len(a):hi][a]].astype("<f8").tobytes()) if a.any() else None for a, hi in zip(asked, ends)]


def _answer(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    kind, bucket, alone, stats = rows[0]["kind"], rows[0]["bucket"], sum(r["alone"] for r in rows), None
    rows = [r for r in rows if r["keys"] is not None]
    if kind > 0:
        replies, stats = _counted(kind, rows)
        for i in (0, K + 1, K + 2):  # seen once, distinct, occurrences
            stats[i] += alone
    else:
        replies = _summed(rows)
    out = [(r["block"], reply, None) for r, reply in zip(rows, replies) if reply is not None] + [(None, None, stats)] * (stats is not None)
    columns = list(zip(*out)) or [()] * 3
    return pa.table([pa.array([kind] * len(out), pa.int32()), pa.array(columns[0], pa.int64()), pa.array([bucket] * len(out), pa.int64()),
                     pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.float64()))], names=_names(_ANSWERS))


def _answered(questions: DataFrame, label: str) -> DataFrame:
    return materialise(questions.groupBy("kind", "bucket").applyInArrow(_answer, _ANSWERS), label)


def count_shortest(coded: DataFrame, buckets: int, order: int) -> DataFrame:
    """Every block's words and bigrams."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1).to_pylist()[0], buckets)
                for n in range(1, min(order, 2) + 1):
                    yield from _table(block.questions(n)).to_batches()

    return coded.mapInArrow(ask, _QUESTIONS)


def good_turing(counts_of_counts: list[float], lowest: int = 1) -> np.ndarray:
    """Discounts d[0..K+1]: Katz's for counts up to K, nothing above; below ``lowest`` a count is as good as none."""
    n = [0.0, *counts_of_counts]
    d = np.ones(K + 2)
    d[:lowest] = 0.0
    cut = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(max(1, lowest), K + 1):
        ratio = (r + 1) * n[r + 1] / (n[r] * r) if n[r] else 0.0
        value = (ratio - cut) / (1.0 - cut) if cut != 1.0 else 0.0
        d[r] = value if 0.0 < value < 1.0 else 1.0 - 0.5 / r  # few counts give no usable estimate
    return d


class _Model:
    """The numbers all tasks need: discounts and totals."""

    def __init__(self, stats: dict[int, list[float]]):
        *of_words, self.distinct, self.total = stats[1]
        self.d_word, self.d = good_turing(of_words), {n: good_turing(found[:K + 1], MIN_COUNT) for n, found in stats.items()}
        # mass of the seen words, counted from the counts of counts: above K nothing is discounted
        freed = sum(n * r * (1.0 - self.d_word[r]) for r, n in enumerate(of_words[:K], start=1))
        self.unknown = freed / self.total if self.total else 1.0

    def p_word(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        floor = 0.5 / (self.total + 0.5)
        unknown = self.unknown if self.unknown > 0 else floor
        seen = 1.0 if self.unknown > 0 else 1.0 - floor  # every word seen often: take the unknown's mass from all
        p = seen * self.d_word[np.minimum(counts, K + 1)] * counts / self.total
        return np.where(counts > 0, p, unknown)

    def least(self, n: int) -> int:
        """The smallest count at which an n-gram's discount frees less than what a history keeps for unseen words at least."""
        return next((r for r in range(1, K + 1) if r * (1.0 - self.d[n][r]) < 0.5), K + 1)

    def mass(self, n: int, counts: np.ndarray) -> np.ndarray:
        return self.d[n][np.minimum(counts, K + 1)] * counts


def _known(row: dict, answered: pa.Table, buckets: int, model: _Model, n: int, weighed: int) -> _Block:
    """A block with the corpus counts of its n-grams up to n, and its probabilities up to ``weighed``."""
    found: dict[int, list] = {}
    for kind, bucket, counts in zip(*(answered.column(c).to_pylist() for c in ("kind", "bucket", "counts"))):
        found.setdefault(kind, []).append((bucket, counts))
    block = _Block(row, buckets)
    for i in range(1, n + 1):
        block.take(i, found)
    for i in range(1, weighed + 1):
        block.weigh(i, model, found)
    return block


def backoff_sums(coded: DataFrame, answers: DataFrame, model: _Model, buckets: int, n: int, order: int) -> DataFrame:
    """Every block's sums and questions over the histories of its n-grams, kind -n, and its n-grams that are one longer. ``answers`` has what came before."""

    def ask(block_rows: pa.Table, answered: pa.Table) -> pa.Table:
        rows = []
        for row in block_rows.to_pylist():
            block = _known(row, answered, buckets, model, n, n - 1)
            rows += block.tell(n, model) + (block.questions(n + 1) if n < order else [])
        return _table(rows)

    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, _QUESTIONS)


def evaluate(coded: DataFrame, answers: DataFrame, model: _Model, buckets: int, order: int) -> DataFrame:
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def run(block_rows: pa.Table, answered: pa.Table) -> pa.Table:
        if not block_rows.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=_names(schema))
        row = block_rows.to_pylist()[0]
        block = _known(row, answered, buckets, model, order, order)
        word = block.counts[1]
        log_gram = np.log10(block.p)
        log_base = np.log10((word + 1.0) / (model.total + model.distinct + 1.0))

        def per_text(values):
            return np.add.reduceat(values, block.starts)

        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(block.lengths), pa.array(per_text((word > 0)[block.ids].astype(np.int64))),
                         pa.array(per_text(log_base[block.ids])), pa.array(per_text(log_gram[block.level(order).of]))], names=_names(schema))

    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _stats(answers: DataFrame, kind: int) -> list[float]:
    """Sums over all buckets of the counts of counts, the distinct keys and the occurrences: one row."""
    stats = answers.filter((F.col("kind") == kind) & F.col("block").isNull())
    return list(stats.agg(*(F.coalesce(F.sum(F.element_at("stats", i + 1)), F.lit(0.0)) for i in range(K + 3))).first())


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", texts_each: int = 4000, order: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score of every row of ``docs``."""
    with shuffles_removed(docs.sparkSession):
        coded = materialise(code_blocks(docs, training, id_col, text_col), "coded")
        buckets = max(8, -(-docs.count() // texts_each))
        answers = _answered(count_shortest(coded, buckets, order), "counts")
        stats = {n: _stats(answers, n) for n in range(1, min(order, 2) + 1)}
        model = _Model(stats)
        for n in range(2, order + 1):
            replies = answers.filter(F.col("block").isNotNull()).drop("stats")
            answers = answers.unionByName(_answered(backoff_sums(coded, replies, model, buckets, n, order), f"backoff{n}"))
            if n < order:
                stats[n + 1] = _stats(answers, n + 1)
                model = _Model(stats)
    replies = answers.filter(F.col("block").isNotNull()).drop("stats")
    return evaluate(coded, replies, model, buckets, order).withColumn("train_tokens", F.lit(int(model.total)))
