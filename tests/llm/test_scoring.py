import itertools
import math
import pathlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pitspark.llm import katz, toxicity
from pitspark.llm.common import dataset
from pitspark.session import shared_folder
from pyspark.sql import functions as F
from rows import clashing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def held(doc, folds, fold_):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % folds == fold_


class PlainKatz:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            tokens = [*WORD.findall(fold(t)), None]
            self.uni.update(tokens)
            self.bi.update(zip([None, *tokens], tokens))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        of = lambda c: [float(sum(x == r for x in c.values())) for r in range(1, katz.K + 2)]
        self.du, self.db = katz.good_turing(of(self.uni)), katz.good_turing(of(self.bi), katz.MIN_COUNT)
        self.kept = {k: c for k, c in self.bi.items() if c >= katz.MIN_COUNT}
        self.unknown = 1.0 - sum(self.du[min(c, katz.K + 1)] * c / self.n for c in self.uni.values()) if self.n else 1.0
        self.mass, self.words = Counter(), Counter()
        for (h, w), c in self.kept.items():
            self.mass[h] += self.db[min(c, katz.K + 1)] * c
            self.words[h] += self.p(w)

    def p(self, w):
        c = self.uni.get(w, 0)
        return self.du[min(c, katz.K + 1)] * c / self.n if c else self.unknown

    def given(self, h, w):
        total = max(self.uni[h], self.mass[h] + 0.5)
        if (h, w) in self.kept:
            c = self.kept[h, w]
            return self.db[min(c, katz.K + 1)] * c / total
        if h not in self.mass:
            return self.p(w)
        return (1 - self.mass[h] / total) / (1 - self.words[h]) * self.p(w)

    def score(self, text):
        tokens = [*WORD.findall(fold(text)), None]
        base = sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in tokens)
        return len(tokens), sum(self.uni[w] > 0 for w in tokens), base, sum(math.log10(self.given(h, w)) for h, w in zip([None, *tokens], tokens))


def agrees(docs, rows, monkeypatch, block=1 << 14):
    texts = [(r.doc_id, r.text or "") for r in rows]
    model = PlainKatz([t for d, t in texts if not held(d, 7, 2)])
    monkeypatch.setattr(katz, "BLOCK_BYTES", block)
    got = katz.score(docs, ~toxicity.in_fold(F.col("doc_id"), 7, 2), texts_each=10).collect()
    want = sorted(((d, *model.score(t)) for d, t in texts), key=repr)
    assert len(got) == len(want)
    for r, (d, n, known, base, score) in zip(sorted(got, key=lambda r: repr((r.doc_id, r.n_tokens))), sorted(want, key=lambda w: repr(w[:2]))):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (d, n, known, model.n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
    return model


def test_katz_same_as_plain(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = agrees(docs, docs.select("doc_id", "text").collect(), monkeypatch)
    words = [*model.uni, "never seen"]
    for h in [None, *list(model.uni)[:40]]:  # every history's probabilities add up to one
        assert math.isclose(sum(model.given(h, w) for w in words), 1.0, rel_tol=1e-9)


def test_katz_awkward_rows(spark, awkward, nothing, monkeypatch):
    agrees(awkward.repartition(3), awkward.collect(), monkeypatch, 64)
    assert katz.score(nothing, F.lit(True)).count() == 0
    got = katz.score(awkward, F.lit(False)).collect()
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in got} == {(0.0, 0.0, 0, 0)}


class PlainBackoff(PlainKatz):
    """Any order, recursively."""

    def __init__(self, texts, order):
        super().__init__(texts)
        self.order, self.grams = order, {n: Counter() for n in range(2, order + 1)}
        for t in texts:
            for n, h, w in self.walk(t):
                self.grams[n][h, w] += 1
        self.d, self.seen, self.out, self.sums = {}, Counter(), Counter(), Counter()
        for n, found in self.grams.items():
            self.d[n] = katz.good_turing([float(sum(x == r for x in found.values())) for r in range(1, katz.K + 2)])
            for (h, w), c in found.items():
                self.seen[h] += c
                self.out[h] += self.d[n][min(c, katz.K + 1)] * c
            for h, w in found:
                self.sums[h] += self.of(h[1:], w)

    def walk(self, text):
        tokens = [None] * (self.order - 1) + [*WORD.findall(fold(text)), None]
        return [(n, tuple(tokens[i - n + 1:i]), tokens[i]) for i in range(self.order - 1, len(tokens)) for n in range(2, self.order + 1)]

    def of(self, h, w):
        if not h:
            return self.p(w)
        n, total = len(h) + 1, max(self.seen[h], self.out[h] + 0.5)
        if c := self.grams[n].get((h, w)):
            return self.d[n][min(c, katz.K + 1)] * c / total
        return ((1 - self.out[h] / total) / (1 - self.sums[h]) if h in self.out else 1.0) * self.of(h[1:], w)

    def score(self, text):
        return *super().score(text)[:3], sum(math.log10(self.of(h, w)) for n, h, w in self.walk(text) if n == self.order)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_of_any_order_same_as_plain(spark, awkward, monkeypatch, order):
    words = [*"a b c d e f g".split(), *(f"rare{i}" for i in range(60))]
    rng = np.random.default_rng(order)
    rows = [(d, " ".join(words[min(int(i), 66)] for i in rng.geometric(0.15, rng.integers(0, 30))), "s") for d in range(100, 180)]
    docs = awkward.unionByName(clashing(spark, rows)).repartition(3)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    model = PlainBackoff([t for d, t in texts if not held(d, 7, 2)], order)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 256)
    got = katz.score(docs, ~toxicity.in_fold(F.col("doc_id"), 7, 2), texts_each=10, order=order).collect()
    want = sorted(((d, *model.score(t)) for d, t in texts), key=repr)
    assert len(got) == len(want)
    for r, (d, n, known, base, score) in zip(sorted(got, key=lambda r: repr((r.doc_id, r.n_tokens))), sorted(want, key=lambda w: repr(w[:2]))):
        assert (r.doc_id, r.n_tokens, r.n_known) == (d, n, known) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
    for _, h, _ in model.walk("a b c rare1 a") + model.walk(texts[-1][1]):
        assert math.isclose(sum(model.of(h, w) for w in [*model.uni, "never seen"]), 1.0, rel_tol=1e-9)


def test_a_bigram_seen_once_counts(spark):
    texts = ["one two three"] + [f"{a} {b}" for a in ("one", "two", "three") for b in ("x", "y")] * 3 + ["one three two"]
    rows = katz.score(clashing(spark, [(d, t, "s") for d, t in enumerate([*texts, "one two three"])]), F.col("doc_id") < len(texts), order=3).collect()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[len(texts)] == scores[0] and 10 ** scores[0] > 0.003


def test_katz_beats_single_words_on_held_out_texts(spark, sf_dir):
    docs = dataset(spark, sf_dir, "documents")
    rows = katz.score(docs, ~toxicity.in_fold(F.col("doc_id"), 7, 2)).collect()
    out = [r for r in rows if held(r.doc_id, 7, 2)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_katz_leaves_little_on_disk(spark):
    """Shuffle files of its steps go with them, and what n-grams of one block settle is neither sent nor written."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.3, 400) % 20_000) for _ in range(200)]
    docs = clashing(spark, [(d, t, "s") for d, t in enumerate(texts)]).repartition(4)

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before, there = shuffled(), set(folder.glob("*"))
    rows = katz.score(docs, ~toxicity.in_fold(F.col("doc_id"), 7, 2), order=3)
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    written = sum(p.stat().st_size for d in set(folder.glob("*")) - there for p in d.rglob("*.parquet"))
    assert not left and written < 5 * 401 * len(texts) and rows.count() == len(texts)


ENGLISH = "the idiot and moron went with a stupid clown to this worthless trash place where people there are for that other thing".split()


def chars():
    grams = Counter()
    for w in ENGLISH:
        for i in range(len(w) + 1):
            grams[f"^^{w}^"[i:i + 3]] += 5
    return toxicity.CharModel(dict(grams))


def test_doubled_letters_are_settled_pair_by_pair():
    model, other = chars(), toxicity.CharModel({"^^a": 5, "^aa": 3, "aab": 2, "abb": 4, "bb^": 1, "ab^": 3, "^ab": 1})
    for letters in itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(9)):
        word = "".join(letters)
        if not re.search(r"(.)\1\1", word):
            assert toxicity.undoubled(word, other) == toxicity.restore(word, other)
    for word in ("iidiioot", "mooron", "stuupiid", "ttrraasshh", "committee", "book", "aardvark", "éétéé", "a", ""):
        assert toxicity.undoubled(word, model) == toxicity.restore(word, model)


@pytest.mark.parametrize("written, meant", [
    ("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"),
    ("idiiiiot", "idiot"), ("cl0wn!!", "clown"), ("the", "the"), ("people,", "people"), ("12", "12"), ("***", "")])
def test_restored(written, meant):
    assert toxicity.restored(written, chars()) == ([meant] if meant else [])


def test_long_disguises_are_restored():
    letters = " ".join("theidiotandthemoronwentwithastupidclowntothistrashplace")  # 55 letters, one by one
    (run,) = (t for t in toxicity.tokens(f"see {letters.upper()} there") if " " in t)
    assert {"idiot", "moron", "clown", "trash"} <= set(toxicity.restored(run, chars()))
    for written, meant in (("st" + "u" * 60 + "pid", "stupid"), ("m" + "." * 50 + "o.r.o.n", "moron"), ("1d10t-" * 20, "idiot")):
        assert meant in "".join(toxicity.restored(written, chars()))


def test_settled_prefixes_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("idiotmrnsupe 1034$.-"), 150)) for _ in range(60)]
    early = [toxicity.restore(t, chars()) for t in texts]
    monkeypatch.setattr(toxicity, "SETTLED", 1 << 30)
    assert early == [toxicity.restore(t, chars()) for t in texts]


@pytest.mark.parametrize("written, meant", [
    ("iidiioot", "idiot"), ("mooron", "moron"), ("stuupiid", "stupid"), ("cloown", "clown"), ("worthless", "worthless"), ("@n", "an")])
def test_doubled_letters_and_short_words_are_restored(written, meant):
    words = Counter({f"^^{w}^"[i:i + 3]: 5 for w in [*ENGLISH, "an"] for i in range(len(w) + 1)})
    assert toxicity.restored(written, toxicity.CharModel(dict(words + Counter(chars().trigrams)))) == [meant]


def exhaustive(token, model):
    """The likeliest reading of a token among all there are, scored from the start for each."""
    options, before = [], ""
    for c in token:
        options.append(toxicity.readings(c, before))
        if c != " ":
            before = c if c not in toxicity.SEPARATORS else before
    best = None
    for chosen in itertools.product(*options):
        text, score = "".join(letter for letter, _ in chosen), sum(cost for _, cost in chosen)
        for word in text.split(" "):
            padded = f"^^{word}^"
            score += sum(model.logp(*padded[i:i + 3]) for i in range(len(word) + 1))
        if best is None or score > best[0]:
            best = (score, text)
    return best


def test_the_decoder_finds_the_best_of_all_readings():
    rng, model = np.random.default_rng(8), chars()
    for _ in range(300):
        token = "".join(rng.choice(list("idotmrn10$ .s"), rng.integers(1, 8)))
        score, text = exhaustive(token, model)
        found = toxicity.restore(token, model)
        assert found == text or _score_of(token, found, model) == pytest.approx(score), token


def _score_of(token, wanted, model):
    """The best score of one reading."""
    options, before = [], ""
    for c in token:
        options.append(toxicity.readings(c, before))
        if c != " ":
            before = c if c not in toxicity.SEPARATORS else before
    costs = [sum(cost for _, cost in chosen) for chosen in itertools.product(*options) if "".join(letter for letter, _ in chosen) == wanted]
    letters = sum(model.logp(*f"^^{w}^"[i:i + 3]) for w in wanted.split(" ") for i in range(len(w) + 1))
    return max(costs) + letters


@pytest.mark.parametrize("written", ["s t u p i d", "s  t u\tp  i d", "s   t   u   p   i   d", "s\nt\nu\np\ni\nd"])
def test_any_spacing_makes_one_run(written):
    (run,) = (t for t in toxicity.tokens(f"what a {written} thing") if " " in t and "t u" in t)
    assert "stupid" in "".join(toxicity.restored(run, chars()))


def training(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for d in range(400):
        toxic = d % 4 == 0
        words = [ENGLISH[i] for i in rng.integers(9, len(ENGLISH), 12) if ENGLISH[i] not in ("worthless", "trash", "clown")]
        words += ["idiot", "moron"] if toxic else []
        rng.shuffle(words)
        rows.append((d, " ".join(words), "s"))
        labels.append((d, int(toxic)))
    return rows, labels


def test_toxic_texts_are_found_also_when_disguised(spark):
    rows, labels = training(spark)
    rows += [(1000, "there people 1d10t for that m0r0n thing", "s"), (1001, "this i d i o t place m.o.r.o.n", "s"), (1002, "where people are there", "s"),
             (1003, "", "s"), (1004, None, "s"), (None, "that idiot moron", "s")]
    docs = clashing(spark, rows)
    marks = spark.createDataFrame([*labels, (7, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, toxicity.in_fold(F.col("doc_id"), 3, 1))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    truth = dict(labels)
    assert all((got[d] >= 0.7) == bool(t) for d, t in truth.items() if held(d, 3, 1))
    assert got[1000] >= 0.7 and got[1001] >= 0.7 and got[None] >= 0.7 and max(got[1002], got[1003], got[1004]) < 0.3


def test_characters_come_from_all_allowed_rows(spark):
    rows, labels = training(spark)
    outside = {held(d, 3, 1): d for d in range(5000, 5020)}
    rows += [(outside[False], "qxqx", "s"), (outside[True], "wkwk", "s")]  # neither is labelled
    model = toxicity.fit(clashing(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.in_fold(F.col("doc_id"), 3, 1), max_labelled=50)
    assert model.chars.trigrams["qxq"] == 1 and "wkw" not in model.chars.trigrams
    assert sum(n for g, n in model.chars.trigrams.items() if g.startswith("^^")) > 50 * 14


def test_held_out_labels_do_not_matter(spark):
    rows, labels = training(spark, 1)
    docs = clashing(spark, rows)
    condition = toxicity.in_fold(F.col("doc_id"), 3, 1)
    flipped = [(d, 1 - t if held(d, 3, 1) else t) for d, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"), condition) for x in (labels, flipped))
    assert (a.lexicon, a.bias, a.slope) == (b.lexicon, b.bias, b.slope)


def test_without_labels_or_rows(spark, awkward, nothing):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(awkward, marks, toxicity.in_fold(F.col("doc_id"), 3, 1))
    assert {round(r.score, 9) for r in toxicity.score(awkward, model).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0
