"""Hard negatives by exact inner products, scored with subset-sum tables.

Vectors are whole numbers here. A candidate's components are cut into bit planes, and eight
components of a plane are one byte. For an anchor and eight of its components a table holds the
sums of all 256 subsets, so a byte of a plane looks up what those eight bits add to the score;
planes are shifted and added, the sign plane taken away. Scores are exact at any size that
64 bits hold, and a block whose scores might not fit is refused.

1. Candidates are packed once into blocks of ``BLOCK_ROWS`` rows (ids, labels, bit planes), in
   order of id. Anchors keep their whole components.
2. Anchors are dealt into strips of about ``STRIP`` by hash and candidate blocks into salts. A
   cell is one strip and the blocks of one salt: its anchors come first, its blocks after them
   one by one, and it keeps a best list per anchor. Memory is a strip and a block. All rows meet
   all anchors in blocks; only best lists leave a cell.
3. The first pass finds each anchor's positives, the second, given their scores, the best other
   rows inside each positive's range.

Equal scores go by the smaller id, a null id last.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part; a shorter vector counts as padded with zeros, an empty one scores zero; a repeated row is
another row; a row with a null id is never an anchor but may be found; no anchor, no positive or no
row in range gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK_ROWS = 4096
STRIP = 16_384
BLOCKS_PER_SALT = 64
TOGETHER = 64
NOTHING = -(1 << 63) + 1
LARGEST = float(1 << 53)


def scaled(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as whole numbers."""
    too_large = F.raise_error(F.lit("a component is too large to be scored in whole numbers"))
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < LARGEST, F.floor(x.cast("double") * scale)).otherwise(too_large.cast("long")))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(bodies: list[bytes]) -> np.ndarray:
    """Rows of whole numbers, the shorter ones padded with zeros."""
    wide = max(map(len, bodies), default=0)
    return np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in bodies), "<i8").reshape(len(bodies), wide // 8)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of a matrix in two's complement; the last plane is the sign."""
    bits = int(np.where(values < 0, ~values, values).max(initial=0)).bit_length() + 1
    planes = [np.packbits(((values >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(bits)]
    return np.ascontiguousarray(planes, np.uint8).reshape(bits, values.shape[1] // 8, len(values))


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """(groups, 256, anchors): the sum of every subset of each eight components."""
    groups = anchors.shape[1] // 8
    parts = anchors.T.reshape(groups, 8, len(anchors)).astype(kind)
    sums = np.zeros((groups, 256, len(anchors)), kind)
    for i in range(8):
        np.add(sums[:, :1 << i], parts[:, i:i + 1], out=sums[:, 1 << i:2 << i])
    return sums


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products of whole anchors and rows given as bit planes."""
    bits, groups, rows = planes.shape
    most = int(np.abs(anchors).sum(1).max(initial=0)) << (bits - 1)
    if most >= 1 << 62:
        raise ValueError("inner products may leave 64 bits")
    kind = np.int32 if most < 1 << 30 else np.int64
    sums = subset_sums(anchors, kind)
    total, part = np.zeros((rows, len(anchors)), kind), np.empty((rows, len(anchors)), kind)
    for p in range(bits - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(sums[g], planes[p, g], axis=0, out=part, mode="clip")
            if p == bits - 1:
                total -= part
            else:
                total += part
    return total


def _packed(vectors: DataFrame) -> DataFrame:
    """One row per block of candidates (``at`` -1), and one per anchor with its block and place there."""
    columns = "block long, at int, vec_id long, label long, body binary, ids binary, labels binary, bits int"

    def rows(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("vec_id")  # nulls last
        ids, labels = table.column("vec_id").combine_chunks(), table.column("label").to_numpy()
        vectors = table.column("vector").combine_chunks()
        sizes = pc.list_value_length(vectors).to_numpy()
        values = np.zeros((len(table), -(-int(sizes.max()) // 8) * 8), "<i8")
        values[np.arange(values.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
        planes = bit_planes(values)
        at = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        block = {"block": number, "at": -1, "vec_id": len(table) - ids.null_count, "label": len(table), "body": planes.tobytes(),
                 "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "bits": len(planes)}
        mine = [{"block": number, "at": i, "vec_id": ids[i].as_py(), "label": int(labels[i]), "body": values[i].tobytes()} for i in at.tolist()]
        return pa.RecordBatch.from_pylist([block, *mine], schema)

    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("body", pa.binary()),
                        ("ids", pa.binary()), ("labels", pa.binary()), ("bits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, BLOCK_ROWS - size), batch.slice(min(BLOCK_ROWS - size, batch.num_rows))
                held.append(part)
                size += part.num_rows
                if size == BLOCK_ROWS:
                    yield rows(number, held)
                    number, held, size = number + 1, [], 0
        if size:
            yield rows(number, held)

    return vectors.mapInArrow(run, columns)


class _Block:
    def __init__(self, row: dict):
        self.block, self.rows, self.known = row["block"], row["label"], row["vec_id"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.planes = np.frombuffer(row["body"], np.uint8).reshape(row["bits"], -1, self.rows).astype(np.intp)


class _Strip:
    """Anchors of one cell and, per anchor and range, the best rows so far."""

    def __init__(self, cell: int, rows: pa.Table, best: int, same_label: bool):
        self.cell, self.best, self.same = cell, best, same_label
        self.block, self.at = rows.column("block").to_numpy(), rows.column("at").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.values = _matrix(rows.column("body").to_pylist())
        ranges = rows.column("ranges").to_pylist()
        self.slots = max(map(len, ranges), default=0)
        self.low, self.high = np.full((2, len(rows), self.slots), 0, np.int64)
        self.high -= 1  # an empty range
        for i, own in enumerate(ranges):
            for j, span in enumerate(own):
                self.low[i, j], self.high[i, j] = span["low"], span["high"]
        shape = (len(rows), self.slots, best)
        self.score, self.id, self.null = np.full(shape, NOTHING), np.zeros(shape, np.int64), np.zeros(shape, bool)

    def meet(self, block: _Block) -> None:
        groups = max(block.planes.shape[1], self.values.shape[1] // 8)
        planes = np.pad(block.planes, ((0, 0), (0, groups - block.planes.shape[1]), (0, 0)))
        for start in range(0, len(self.values), TOGETHER):
            some = slice(start, start + TOGETHER)
            anchors = self.values[some]
            anchors = np.pad(anchors, ((0, 0), (0, 8 * groups - anchors.shape[1])))
            found = scores(anchors, planes).astype(np.int64)
            fits = (block.labels[:, None] == self.labels[some]) == self.same
            own = np.flatnonzero(self.block[some] == block.block)
            fits[self.at[some][own], own] = False
            for j in range(self.slots):
                allowed = fits & (found >= self.low[some, j]) & (found <= self.high[some, j])
                if allowed.any():
                    self._merge(some, j, np.where(allowed, found, NOTHING), block)

    def _merge(self, some: slice, j: int, found: np.ndarray, block: _Block) -> None:
        columns = np.arange(found.shape[1])
        scores, ids, nulls = [self.score[some, j]], [self.id[some, j]], [self.null[some, j]]
        for _ in range(min(self.best, len(found))):
            top = found.argmax(0)  # the first of equals, so the smallest id
            scores.append(found[top, columns][:, None])
            ids.append(block.ids[top][:, None])
            nulls.append((top >= block.known)[:, None])
            found[top, columns] = NOTHING
        score, ident, null = (np.concatenate(x, 1) for x in (scores, ids, nulls))
        order = np.lexsort((ident, null, -score), axis=1)[:, :self.best]
        self.score[some, j], self.id[some, j], self.null[some, j] = (np.take_along_axis(x, order, 1) for x in (score, ident, null))

    def result(self) -> pa.RecordBatch:
        anchor, slot, place = np.nonzero(self.score > NOTHING)
        ids = pa.array(self.id[anchor, slot, place], mask=self.null[anchor, slot, place])
        return pa.RecordBatch.from_arrays([
            pa.array(self.block[anchor]), pa.array(self.at[anchor]), pa.array(slot.astype(np.int32)), ids, pa.array(self.score[anchor, slot, place])],
            ["block", "at", "slot", "vec_id", "score"])


def _best(asks: DataFrame, blocks: DataFrame, strips: int, salts: int, best: int, same_label: bool) -> DataFrame:
    """(block, at, slot, vec_id, score): per anchor and range the best rows of each cell.

    ``asks`` holds anchors with ``ranges``, an array of (low, high) scores.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, anchors, cell = None, [], None
        for batch in batches:
            cells, at = batch.column("cell").to_numpy(), batch.column("at").to_numpy()
            starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1)).tolist()
            for low, high in zip(starts, [*starts[1:], len(cells)]):
                if cells[low] != cell:
                    if strip is not None:
                        yield strip.result()
                    strip, anchors, cell = None, [], cells[low]
                first = low + int(np.argmax(at[low:high] < 0)) if (at[low:high] < 0).any() else high
                if first > low:
                    anchors.append(batch.slice(low, first - low))
                for row in batch.slice(first, high - first).select(["block", "label", "vec_id", "ids", "labels", "body", "bits"]).to_pylist():
                    if not anchors:
                        break  # a strip that got no anchors
                    if strip is None:
                        strip = _Strip(cell, pa.Table.from_batches(anchors), best, same_label)
                    strip.meet(_Block(row))
        if strip is not None:
            yield strip.result()

    ranges = "array<struct<low:long,high:long>>"
    anchors = asks.withColumn("strip", F.pmod(F.hash("block", "at"), F.lit(strips))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    others = blocks.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).withColumn("salt", F.pmod(F.hash("block"), F.lit(salts)))
    # sorted by place descending, so that a cell's anchors come before its blocks
    cells = anchors.unionByName(others.withColumn("ranges", F.lit(None).cast(ranges))).withColumn("cell", F.col("strip") * salts + F.col("salt"))
    dealt = cells.drop("strip", "salt").repartitionById(strips * salts, "cell").sortWithinPartitions("cell", F.desc("at"), "block")
    return dealt.mapInArrow(run, "block long, at int, slot int, vec_id long, score long")


def _first(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("block", "at", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: Column | None = None,
                   high: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of the same label. For each, the
    ``negatives`` best rows of another label whose scores lie between ``low`` and ``high``, columns
    over ``score``, the positive's score; half of it and 95 % of it if not given. Vectors hold whole
    numbers, or are floored.
    """
    spark = vectors.sparkSession
    low = F.expr("-shiftright(-score, 1)") if low is None else low
    high = F.expr("score - (score + pmod(-score, 20L)) div 20L") if high is None else high
    clean = vectors.filter(F.col(label_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        scaled(F.col(vector_col), 1.0).alias("vector"), (F.coalesce(is_anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("asks"))
    packed = materialise(_packed(clean), "negatives_packed")
    blocks, anchors = packed.filter("at < 0"), packed.filter("at >= 0")
    sizes = packed.agg(F.count_if(F.col("at") < 0), F.count_if(F.col("at") >= 0)).first()
    strips = max(1, -(-sizes[1] // STRIP))
    wanted = max(-(-sizes[0] // BLOCKS_PER_SALT), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // strips))
    salts = max(1, min(sizes[0], wanted))
    everything = F.array(F.struct(F.lit(NOTHING + 1).alias("low"), F.lit((1 << 63) - 1).alias("high")))
    near = materialise(_first(_best(anchors.withColumn("ranges", everything), blocks, strips, salts, positives, True), positives), "negatives_positives")
    bounds = near.select("block", "at", F.struct("rank", low.cast("long").alias("low"), high.cast("long").alias("high")).alias("range"))
    bounds = bounds.groupBy("block", "at").agg(F.sort_array(F.collect_list("range")).alias("ranges"))
    ranges = F.transform("ranges", lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high")))
    asks = anchors.join(bounds.select("block", "at", ranges.alias("ranges")), ["block", "at"])
    found = _first(_best(asks, blocks, strips, salts, negatives, False), negatives)
    named = near.join(anchors.select("block", "at", F.col("vec_id").alias("anchor_id")), ["block", "at"]).select(
        "block", "at", (F.col("rank") - 1).alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(found.select("block", "at", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")),
                      ["block", "at", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
