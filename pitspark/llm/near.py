"""Near-duplicate detection with SetSketch registers.

A document is its set of distinct word shingles. Its sketch (Ertl 2021) has ``registers``
values: with h the least of exponentially distributed hashes of the set,
``floor(1 - log_b h)`` cut to 0..q+1. Registers of a union are the larger ones, and equal
registers tell of a large Jaccard similarity.

1. One row per document: set size, a 128-bit fingerprint of the set and the registers, written once.
   Documents with one set are one class from here on (combined map-side), so copies, however
   many, cost one row each and are never paired.
2. Classes meet where all registers of a band agree. The class that meets most others is each class's first
   candidate.
3. For each pair the similarity is estimated from the counts of larger, smaller and equal registers
   and both set sizes, by maximum likelihood; pairs five standard errors below the threshold go.
   The others are verified on the full sets.
4. Verified links give components (least labels with pointer jumping). In buckets that still hold more than one, a
   drawn member of the largest is tried with one of each other. What is left, the classes of buckets
   with several components, are paired across components on their rarest shingles, which loses no link
   and keeps apart the many texts that share one frequent passage.

A link at the threshold is missed only if no band agrees: for 32 bands of 4 and 0.75,
in 5 of 1,000,000 cases.

Defined results: a text with fewer words than a shingle is one shingle, one without words has an
empty set and no links; a null text is empty; a null id never becomes a component's id; equal rows belong to one
component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, documents, fold_ascii, materialise, mix, slices, text_bytes

REGISTERS, BAND = 128, 4
BASE, RATE, MOST = 1.001, 20.0, (1 << 16) - 2
_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: Words, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    grams, at = texts.grams(width, seed=3)
    bounds = np.searchsorted(at, texts.first)
    sets = []
    for i, (lo, hi, words) in enumerate(zip(bounds[:-1], bounds[1:], texts.counts)):
        if 0 < words < width:
            h = np.full(1, words, np.uint64)
            for w in texts.hashes[texts.first[i]:texts.first[i + 1]]:
                h = mix(h * np.uint64(31) + w)
            sets.append(h)
        else:
            sets.append(np.unique(grams[lo:hi]))
    return sets


def _registers(sets: list[np.ndarray], registers: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), registers), "<u2")
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for i in range(registers):
            least = np.minimum.reduceat(values * _FACTORS[i], starts)
            h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
            out[full, i] = np.clip(np.floor(1.0 - np.log(np.maximum(h, 1e-300)) / math.log(BASE)), 0, MOST + 1)
    return out


def _parse(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    raw, offsets = text_bytes(part.column("text"))
    return shingle_sets(Words(fold_ascii(raw), offsets), width)


def _set_keys(sets: list[np.ndarray]) -> pa.Array:
    """A 128-bit fingerprint of each set: its size and elements, in two independent sums."""
    keys = np.zeros((len(sets), 2), "<u8")
    for i, s in enumerate(sets):
        n = np.full(1, len(s), np.uint64)
        keys[i, 0] = mix(mix(s).sum(keepdims=True) + n)[0]
        keys[i, 1] = mix(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(keepdims=True) + n)[0]
    return pa.array([k.tobytes() for k in keys], pa.binary())


def sketches(docs: DataFrame, width: int = 5, registers: int = REGISTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, sketch (little-endian 16-bit registers)."""
    schema = "doc_id long, text_key long, n_shingles long, set_key binary, sketch binary"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = _parse(part, width)
                values = _registers(sets, registers)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), _set_keys(sets),
                     pa.array([v.tobytes() for v in values], pa.binary())], names)

    keyed = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, schema)


def likelihood_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair of sketches (rows), given the set sizes."""
    u = (size_a / (size_a + size_b))[:, None]
    v = 1.0 - u
    larger, smaller = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - larger - smaller
    j = np.linspace(0.0, 1.0, steps + 1)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.maximum(x, 0.0) * (BASE - 1) / BASE) / math.log(BASE)

    p_larger, p_smaller = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    value = (larger * np.log(np.maximum(p_larger, tiny)) + smaller * np.log(np.maximum(p_smaller, tiny))
             + equal * np.log(np.maximum(1.0 - p_larger - p_smaller, tiny)))
    return j[np.arange(len(j)), np.argmax(value, axis=1)]


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float, registers: int) -> DataFrame:
    """The (a, b) whose estimate is not far below the threshold."""
    least = threshold - 5.0 * math.sqrt(threshold * (1.0 - threshold) / registers)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                    pa.array(likelihood_similarity(a, b, n, m) >= least))

    side = classes.select("set_key", "n_shingles", "sketch")
    both = (pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
            .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"))
    return both.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) with 100 * intersection >= percent * union, on the full sets."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the same label for all nodes that the links (a, b) connect."""
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = materialise(stepped.join(jump, stepped.label == jump.at, "left")
                            .select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label != old").isEmpty():
            return labels


def _relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after further links: only the graph of labels that they connect is gone through."""
    if links.isEmpty():
        return label
    if label is None:
        return components(links)

    def named(side: str) -> DataFrame:
        return label.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))

    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    between = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a != b").distinct()
    moved = components(between).toDF("from", "to")
    known = label.unionByName(moved.select(F.col("from").alias("node"), F.col("from").alias("label")).join(label.select("node"), "node", "left_anti"))
    return materialise(known.join(moved, known.label == moved["from"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _open(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """(bucket, set_key, label) of the buckets that still hold more than one component."""
    if label is None:
        placed = shared.select("bucket", "set_key", F.col("set_key").alias("label"))
    else:
        placed = shared.join(label, shared.set_key == label.node, "left").select("bucket", "set_key", F.coalesce("label", "set_key").alias("label"))
    bucket = Window.partitionBy("bucket")
    several = placed.withColumn("low", F.min("label").over(bucket)).withColumn("high", F.max("label").over(bucket)).filter("low != high")
    return materialise(several.select("bucket", "set_key", "label"), "open")


def _drawn(seats: DataFrame, draws: int = 2) -> DataFrame:
    """Pairs (a, b): in each bucket drawn members of the largest component with one of every other component."""
    lots = [F.min(F.struct(F.xxhash64("bucket", "set_key", F.lit(i)).alias("h"), "set_key")).alias(f"d{i}") for i in range(draws)]
    groups = seats.groupBy("bucket", "label").agg(F.count("*").alias("n"), *lots)
    main = F.max(F.struct("n", "label", *(f"d{i}" for i in range(draws)))).over(Window.partitionBy("bucket"))
    others = groups.withColumn("main", main).filter(F.col("label") != F.col("main.label"))
    return others.select(F.explode(F.array(*(F.col(f"main.d{i}.set_key") for i in range(draws)))).alias("a"), F.col("d0.set_key").alias("b")).distinct()


def _by_rare_shingles(seats: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that can still be similar, exactly.

    Order every set by rarity. Of two similar sets the larger then shares a shingle of its first n - ceil(t n) + 1 with
    the first n - ceil(2t / (1 + t) n) + 1 of the smaller, and what follows both places must suffice for the overlap. So
    texts that have one frequent passage in common, but not their rare shingles, never meet.
    """
    wanted = seats.select("set_key", "label").distinct()
    schema = "set_key binary, label binary, n int, shingle long"

    def run(batches):
        for batch in batches:
            for key, label, raw in zip(*(batch.column(c) for c in ("set_key", "label", "elements"))):
                values = np.frombuffer(raw.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(values), pa.binary()), pa.array([label.as_py()] * len(values), pa.binary()),
                                                  pa.array(np.full(len(values), len(values), np.int32)), pa.array(values)], ["set_key", "label", "n", "shingle"])

    every = sets.join(wanted, "set_key").select("set_key", "label", "elements").mapInArrow(run, schema)
    common = every.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).filter("df > 1")
    rarest = Window.partitionBy("set_key").orderBy("df", "shingle")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("set_key"))  # those of one class only stand first and match nothing
    n, t = F.col("n").cast("long"), percent

    def up(top, bottom):
        return F.ceil(top / bottom).cast("long")

    prefix = (common.withColumn("place", F.row_number().over(rarest) + alone)
              .withColumn("first", F.col("place") <= n - up(2 * t * n, F.lit(100 + t)) + 1)
              .filter(F.col("place") <= n - up(t * n, F.lit(100)) + 1))
    per = Window.partitionBy("shingle", "label")
    biggest = F.max(F.struct(F.col("members"), F.col("label"))).over(Window.partitionBy("shingle"))["label"]
    low, high = F.min("label").over(Window.partitionBy("shingle")), F.max("label").over(Window.partitionBy("shingle"))
    meeting = materialise(prefix.withColumn("members", F.count("*").over(per)).withColumn("main", F.col("label") == biggest)
                          .withColumn("several", low != high).filter("several").select("shingle", "set_key", "label", "n", "place", "first", "main"), "meeting")
    names = ["shingle", "key", "label", "n", "place", "first", "main"]
    x = meeting.toDF("shingle", *(f"{c}_a" for c in names[1:])).filter("first_a")
    y = meeting.toDF("shingle", *(f"{c}_b" for c in names[1:]))
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b")))
    needed = up(t * (F.col("n_a") + F.col("n_b")).cast("long"), F.lit(100 + t))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    fits = order & (F.col("label_a") != F.col("label_b")) & (100 * F.col("n_a") >= t * F.col("n_b")) & (left >= needed)
    # members of the largest component of a shingle do not meet each other
    pairs = x.filter("not main_a").join(y, "shingle").filter(fits).select("key_a", "key_b").unionByName(
        x.filter("main_a").join(y.filter("not main_b"), "shingle").filter(fits).select("key_a", "key_b"))
    return pairs.toDF("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, registers: int = REGISTERS, band: int = BAND,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id (smallest id reachable), kept."""
    found = _components(docs, percent, width, registers, band, id_col, text_col)
    return found.select("doc_id", "text_key", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _components(docs: DataFrame, percent: int, width: int, registers: int, band: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, label (its component's, null where the set is empty), component_id."""
    threshold = percent / 100
    found = materialise(sketches(docs, width, registers, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    classes = materialise(found.filter("n_shingles > 0").groupBy("set_key", "n_shingles").agg(first.alias("first"), F.min("sketch").alias("sketch"))
                          .select("set_key", "n_shingles", "first.doc_id", "first.text_key", "sketch"), "classes")
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 2 * band * i + 1, 2 * band)) for i in range(registers // band)))
    bucket = Window.partitionBy("bucket")
    shared = materialise(classes.select("set_key", F.explode(keys).alias("bucket")).withColumn("size", F.count("*").over(bucket))
                         .filter("size > 1"), "buckets")
    needed = materialise(classes.join(shared.groupBy("set_key").agg(F.sum("size").alias("met")), "set_key"), "needed")
    sets = materialise(_sets(docs, needed, width, id_col, text_col), "sets")
    # the class that meets most others stands in the middle of its group: everybody's first candidate
    seats = shared.join(needed.select("set_key", "met"), "set_key")
    pairs = (seats.withColumn("centre", F.max(F.struct("met", "set_key")).over(bucket)).groupBy(F.col("set_key").alias("b"))
             .agg(F.max("centre").alias("c")).select(F.col("c.set_key").alias("a"), "b").filter("a != b"))
    label = _relabelled(None, materialise(_verified(_plausible(pairs, needed, threshold, registers), sets, percent), "verified"))
    for candidates in (_drawn, lambda seats: _by_rare_shingles(seats, sets, percent)):
        pairs = candidates(_open(shared, label))
        label = _relabelled(label, materialise(_verified(_plausible(pairs, needed, threshold, registers), sets, percent), "verified"))
    if label is None:
        label = classes.select(F.col("set_key").alias("node"), F.col("set_key").alias("label")).limit(0)
    members = classes.join(label, classes.set_key == label.node, "left").select("set_key", "doc_id", F.coalesce("label", "set_key").alias("label"))
    smallest = members.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    answer = members.join(smallest, "label").select("set_key", "component_id", "label")
    linked = F.col("n_shingles") > 0
    return (found.select("doc_id", "text_key", "n_shingles", "set_key").join(answer, "set_key", "left")
            .select("doc_id", "text_key", "n_shingles", F.when(linked, F.col("label")).alias("label"),
                    F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def _sets(docs: DataFrame, needed: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(set_key, elements) of the classes in ``needed``, from the text of each class's first document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = _parse(part, width)
                yield pa.RecordBatch.from_arrays([part.column("set_key"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                                                 ["set_key", "elements"])

    keyed = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    n = needed.alias("n")
    rows = keyed.join(n, F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.text_key") == F.col("n.text_key"))).select("n.set_key", "d.text")
    return rows.mapInArrow(run, "set_key binary, elements binary").dropDuplicates(["set_key"])


def keep_rows(docs: DataFrame, percent: int = 75, width: int = 5, registers: int = REGISTERS, band: int = BAND,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, with all its columns.

    The smallest id stays, a null id coming last; then the text with the smaller hash; of rows
    equal in both the one whose other columns sort first as text. Texts without words are
    linked with nothing and all stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    found = materialise(_components(docs, percent, width, registers, band, id_col, text_col).select("doc_id", "text_key", "label"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    chosen = found.filter("label is not null").groupBy("label").agg(first).select("first.doc_id", "first.text_key", F.lit(True).alias("linked"))
    kept = chosen.unionByName(found.filter("label is null").select("doc_id", "text_key", F.lit(False).alias("linked")).distinct())
    times = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    same = F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.text_key") == F.col("t.text_key"))
    keep = kept.alias("k").join(times.alias("t"), same).select("k.doc_id", "k.text_key", (F.col("linked") & (F.col("times") > 1)).alias("tied"))
    plain = docs.toDF(*names).withColumn("text_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    here = F.col(f"p.{key}").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.col("p.text_key") == F.col("k.text_key"))
    rows = plain.alias("p").join(keep.alias("k"), here).select("p.*", "k.tied")
    # only rows that are equal in id and text are ordered at all
    order = Window.partitionBy(key, "text_key").orderBy(F.to_json(F.struct(*names)))
    single = rows.filter("tied").withColumn("place", F.row_number().over(order)).filter("place = 1").select(*names)
    return rows.filter("not tied").select(*names).unionByName(single).toDF(*names).select(*(F.col(n).alias(f.name) for n, f in zip(names, docs.schema)))
