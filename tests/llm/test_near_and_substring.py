import hashlib
import re

import numpy as np
from pitspark.llm import near, substring
from pyspark.sql import functions as F
from rows import clashing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(texts):
    """{doc: kept words} by a dictionary of all windows."""
    words = {d: WORD.findall(t) for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            first.setdefault(tuple(words[d][i:i + 20]), (d, i))
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i:i + 20])] != (d, i) for j in range(i, i + 20)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def random_texts(seed, docs, vocabulary):
    """Texts glued from a few passages, so windows repeat within and across them, in many contexts."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"t{x}" for x in rng.integers(0, vocabulary, rng.integers(5, 60))) for _ in range(12)]
    return {d: " ".join(passages[i] for i in rng.integers(0, 12, rng.integers(1, 9))) for d in range(docs)}


def test_same_windows_go(spark):
    for seed, vocabulary in ((1, 1000), (2, 2), (3, 30)):
        texts = random_texts(seed, 40, vocabulary)
        docs = clashing(spark, [(d, t, "s") for d, t in texts.items()]).repartition(5)
        for batch in ("3", "10000"):  # the extensions of one anchor run over several batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect()}
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            assert got == plain_repeats(texts), (seed, batch)


def test_kept_text_and_spans(spark, awkward, nothing):
    rows = {r.doc_id: r for r in substring.remove_repeats(awkward).collect()}
    assert rows[12].kept == "x" and rows[11].kept == "and again" and rows[10].n_removed == 0
    assert [(s["start"], s["length"]) for s in rows[11].repeats] == [(0, 60)]
    assert rows[3].kept == "" and rows[4].n_words == 0 and rows[13].kept == "a b c d\xa0e ß É"
    assert rows[9].n_removed == 6000 and rows[8].n_removed < 6000
    assert substring.remove_repeats(nothing).count() == 0


def plain_components(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.lower())
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {d: d for d in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            least = min(low[a], low[b])
            moved |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    return {d: (len(s), low[d]) for d, s in sets.items()}


def test_components(spark):
    """Chains whose ends are not alike, stars, copies, short and empty texts."""
    rng = np.random.default_rng(5)
    base = [f"u{i}" for i in range(120)]
    texts, words = {}, list(base)
    for d in range(30):  # each differs a little from the one before
        texts[d] = " ".join(words)
        words[int(rng.integers(0, 120))] = f"new{d}"
    for d in range(30, 60):
        some = [f"v{i}" for i in range(100)]
        for i in rng.integers(0, 100, 3):
            some[i] = f"edit{d}"
        texts[d] = " ".join(some).upper() if d % 2 else " ".join(some)
    texts |= {60: "", 61: "", 62: "a b", 63: "A  b", 64: texts[3], 65: " ".join(f"alone{i}" for i in range(50))}
    docs = clashing(spark, [(d, t, "s") for d, t in texts.items()])
    rows = near.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = near.keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_awkward_rows(spark, awkward, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(awkward).collect()}
    assert got == plain_components({r.doc_id: r.text or "" for r in awkward.collect()})
    with_null = awkward.unionByName(awkward.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    rows = near.near_duplicates(with_null).collect()
    assert [r.component_id for r in rows if r.doc_id is None] == [8] and len(rows) == awkward.count() + 1
    assert near.near_duplicates(nothing).count() == 0 and near.keep_rows(nothing).count() == 0


def test_one_row_stays_of_each_component(spark):
    """Copies without id, equal rows, and rows of one id with different texts."""
    base = [f"w{i}" for i in range(60)]
    close = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(4)]
    rows = [(None, close[0]), (None, close[1]), (5, close[2]), (7, close[3]), (7, close[3]), (None, "alone without id but long enough"), (9, ""), (9, ""), (None, None),
            (3, "equal rows of five words here"), (3, "equal rows of five words here"), (11, "one id two texts of words a"), (11, "quite another text under that id b")]
    docs = spark.createDataFrame([(i, t, n, "k", 1) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int, label string, times int")
    kept = near.keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [2, 5, 6, 7, 8, 10, 11, 12]  # 10 sorts before 9 as text
    nameless = [r.text for r in near.keep_rows(docs.filter("doc_id is null")).collect()]
    assert len(nameless) == 3 and sum(t in close for t in nameless) == 1


def test_joint_estimate():
    rng = np.random.default_rng(11)
    errors = []
    for size, wanted in ((400, 0.75), (400, 0.2), (2000, 0.9), (50, 0.5)):
        for _ in range(20):
            common = int(2 * size * wanted / (1 + wanted))
            pool = rng.integers(1, 1 << 63, 2 * size - common, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[size - common:])
            k = near._registers([a, b], 128).astype(np.int64)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(near.likelihood_similarity(k[:1], k[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_registers_merge():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 1 << 63, 300, dtype=np.uint64), rng.integers(1, 1 << 63, 500, dtype=np.uint64)
    one, two, both = near._registers([a, b, np.union1d(a, b)], 64)
    assert (np.maximum(one, two) == both).all()
