"""Toxicity by noisy-channel deobfuscation.

The channel turns a word into what is read: letters become look-alike digits and signs, get
repeated, or get separators between them. A read token gives a lattice of letters; Viterbi
finds the path with the best sum of channel costs and a trigram character language model
of the corpus. Tokens without any mark of the channel (a sign or a doubled character) have one path, themselves.

Training, all on rows the caller allows:

1. the character model: trigram counts over all words of all these rows, labelled or not;
2. the lexicon: for every restored word its start of 4 and of 6 letters and, if short, the
   whole word; document counts in either class; a feature is kept if its log-likelihood ratio is
   significant after Bonferroni's correction for all features tested, and it speaks for
   toxicity. Its weight is the log odds ratio.
3. the score: logistic regression on the sum over a text's distinct words of each word's largest weight.

Bounds, all parameters: at most ``max_labelled`` labelled rows (taken by hash, spread over
all ids, so the table of labels may be broadcast), ``max_features`` lexicon entries and
``max_trigrams`` character trigrams (the model goes to every task). Scoring reads every text whole.

Defined results: null and empty texts score the rate of texts without any evidence; a row
without id is a training row if labelled; an id labelled more than once is toxic if any
label says so; without labels every score is 0; equal texts score alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise

#: Signs read as letters.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z",
             "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'\"/\\,"
EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_~`/\\"
FRONT = EDGE.replace("$", "")  # a sign in front may be a letter
SUBSTITUTED, SEPARATED, REPEATED, KEPT_SIGN = -1.5, -0.5, -2.0, -12.0
REMEMBERED, REMEMBERED_LENGTH = 200_000, 40  # tokens kept with their result; longer ones are restored each time
SETTLED = 64
_MARKED = re.compile(r"[0-9@$!|+€£.\-_*~'\"/\\,]|(.)\1")
_DOUBLED, _TRIPLED = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_TWO_SINGLES = re.compile(r"\s\S\s+\S(?!\S)")


@dataclass
class CharModel:
    """log P(c | a, b) from trigram counts, linearly interpolated with bigrams, unigrams and a floor."""
    trigrams: dict[str, int]

    def __post_init__(self):
        self.two, self.one, self.pairs, self.singles = Counter(), Counter(), Counter(), Counter()
        for gram, n in self.trigrams.items():
            self.two[gram[:2]] += n
            self.pairs[gram[1:]] += n
            self.one[gram[1]] += n
            self.singles[gram[2]] += n
        self.total = sum(self.singles.values()) or 1
        self.memo: dict[str, float] = {}
        self.meant: dict[str, bool] = {}

    def logp(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        found = self.memo.get(key)
        if found is None:
            p = 1e-5 + 0.05 * self.singles[c] / self.total
            if self.one[b]:
                p += 0.25 * self.pairs[b + c] / self.one[b]
            if self.two[a + b]:
                p += 0.70 * self.trigrams.get(key, 0) / self.two[a + b]
            found = self.memo[key] = math.log(min(p, 1.0))
        return found

    def doubled(self, a: str, b: str, c: str) -> bool:
        """Whether of ``a b b c`` both letters are meant, not one that the channel repeated."""
        key = a + b + c
        found = self.meant.get(key)
        if found is None:
            found = self.meant[key] = self.logp(a, b, b) + self.logp(b, b, c) >= REPEATED + self.logp(a, b, c)
        return found


def readings(c: str, before: str) -> list[tuple[str, float]]:
    """What the sign ``c`` can stand for behind the sign ``before``, with the channel's log cost."""
    found = [(x, SUBSTITUTED) for x in LOOKALIKE.get(c, "")]
    if c in SEPARATORS:
        found += [("", SEPARATED), (" ", SEPARATED)] if c == " " else [("", SEPARATED)]
    elif c.isalpha():
        found.append((c, 0.0))
    else:
        found.append((c, KEPT_SIGN))
    if c == before:
        found.append(("", REPEATED))
    return found


def restore(token: str, model: CharModel) -> str:
    """The likeliest word behind ``token`` (lower case), or words if its separators are spaces."""
    paths: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    before, settled, longest = "", [], 0
    for c in token:
        reached: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (score, text) in paths.items():
            for letter, cost in readings(c, before):
                if not letter:
                    to, gain, out = (a, b), score + cost, text
                elif letter == " ":
                    to, gain, out = ("^", "^"), score + cost + model.logp(a, b, "^"), text + " "
                else:
                    to, gain, out = (b, letter), score + cost + model.logp(a, b, letter), text + letter
                if to not in reached or reached[to][0] < gain:
                    reached[to] = (gain, out)
        paths, longest = reached, longest + 1
        if longest >= SETTLED:  # what all paths have in common is certain and need not be carried on
            common = commonprefix([text for _, text in paths.values()])
            settled.append(common)
            paths = {to: (score, text[len(common):]) for to, (score, text) in paths.items()}
            longest = max(len(text) for _, text in paths.values())
        if c != " ":
            before = c if c not in SEPARATORS else before
    return "".join(settled) + max((score + model.logp(a, b, "^"), text) for (a, b), (score, text) in paths.items())[1]


def undoubled(word: str, model: CharModel) -> str:
    """:func:`restore` of a word of letters, none more than twice in a row.

    Behind the sign after a doubled letter both its paths are in one state, so the best path
    is found pair by pair.
    """
    found, at = [], 0
    for pair in _DOUBLED.finditer(word):
        i = pair.start()
        if not model.doubled(word[i - 1] if i else "^", word[i], word[i + 2:i + 3] or "^"):
            found.append(word[at:i + 1])
            at = i + 2
    return "".join(found) + word[at:]


def restored(token: str, model: CharModel) -> list[str]:
    """The words behind one token: itself, unless it bears marks of the channel."""
    if " " in token:
        return restore(token, model).split()
    word = token.rstrip(EDGE).lstrip(FRONT)
    if not word.isdecimal() and _MARKED.search(word):
        if word.isalpha() and not _TRIPLED.search(word):
            return [undoubled(word, model)]
        return restore(word, model).split()
    return [word] if word else []


def features(word: str) -> list[str]:
    size = len(word)
    if size <= 4:
        return [word + "$"]
    if size <= 6:
        return [word + "$", word[:4]]
    return [word + "$", word[:4], word[:6]] if size <= 8 else [word[:4], word[:6]]


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text, and its runs of single characters as one token each."""
    low = text.lower()
    found = set(low.split())
    if _TWO_SINGLES.search(low):  # every run has them, few texts do, and they are found faster
        found.update(re.sub(r"\s+", " ", m.group()) for m in _SPACED.finditer(low))
    return found


class _Features(dict):
    """token -> features of the words behind it, for a batch of texts."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> list[str]:
        found = [f for w in restored(token, self.model) for f in features(w)]
        if len(token) <= REMEMBERED_LENGTH:
            self[token] = found
        return found


class _Evidence(dict):
    """token -> largest weight of the words behind it; each distinct token of usual length is restored once."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        weight_of = self.model.lexicon.get
        weight = 0.0
        for word in dict.fromkeys(restored(token, self.model.chars)):
            weight += max([weight_of(f, 0.0) for f in features(word)])
        if len(token) <= REMEMBERED_LENGTH:
            self[token] = weight
        return weight

    def of(self, text: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, tokens(text)))


@dataclass
class ToxicityModel:
    chars: CharModel
    lexicon: dict[str, float]
    bias: float = -50.0
    slope: float = 0.0
    most: float = 20.0

    def probability(self, evidence: float) -> float:
        z = self.bias + self.slope * min(evidence, self.most)
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def in_fold(ident: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    text = F.coalesce(ident.cast("long").cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds) == fold


def _counted(train: DataFrame, schema: str, count) -> DataFrame:
    """Sums of what ``count(texts, toxic)`` returns per Arrow batch: {key: (n, ...)}."""
    names = [part.split(" ")[0] for part in schema.split(", ")]
    types = [pa.string()] + [pa.int64()] * (len(names) - 1)

    def run(batches):
        for batch in batches:
            found = count(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())
            if found:
                columns = [list(found), *map(list, zip(*found.values()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return train.mapInArrow(run, schema).groupBy(names[0]).agg(*(F.sum(n).alias(n) for n in names[1:]))


def _char_counts(texts, toxic):
    words = Counter(chain.from_iterable(map(str.split, map(str.lower, texts))))
    grams: dict[str, int] = {}
    for word, n in words.items():
        word = word.strip(EDGE)
        if word.isalpha():
            padded = f"^^{word}^"
            for gram in map("".join, zip(padded, padded[1:], padded[2:])):
                grams[gram] = grams.get(gram, 0) + n
    return {k: (v,) for k, v in grams.items()}


def _feature_counts(chars: CharModel):
    def count(texts, toxic):
        memo, sides = _Features(chars), [Counter(), Counter()]
        for text, label in zip(texts, toxic):
            sides[label].update(set().union(*map(memo.__getitem__, tokens(text))))
        return {k: (sides[1][k], sides[0][k]) for k in sides[0].keys() | sides[1].keys()}
    return count


def _bin_counts(model: ToxicityModel):
    def count(texts, toxic):
        evidence = _Evidence(model)
        bins: dict[str, list[int]] = {}
        for text, label in zip(texts, toxic):
            bins.setdefault(str(int(2 * min(evidence.of(text), model.most))), [0, 0])[1 - label] += 1
        return bins
    return count


def _logistic(bins: list[tuple[float, int, int]], ridge: float = 0.01) -> tuple[float, float]:
    """Bias and slope by Newton's method on (x, positives, negatives)."""
    bias = slope = 0.0
    for _ in range(100):
        g0, g1, h00, h01, h11 = 0.0, -ridge * slope, 1e-9, 0.0, ridge
        for x, pos, neg in bins:
            p = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, bias + slope * x))))
            n = pos + neg
            g0 += pos - n * p
            g1 += (pos - n * p) * x
            h00 += n * p * (1 - p)
            h01 += n * p * (1 - p) * x
            h11 += n * p * (1 - p) * x * x
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 5.0 / max(abs(d0), abs(d1), 1e-12))
        bias, slope = bias + step * d0, slope + step * d1
        if max(abs(d0), abs(d1)) < 1e-9:
            break
    return bias, slope


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, max_labelled: int = 100_000, max_features: int = 20_000,
        max_trigrams: int = 50_000) -> ToxicityModel:
    """Learn from the labelled rows of ``docs`` for which ``held_out`` (over doc_id) is false."""
    train_labels = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
                    .filter(~held_out & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                    .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    sides = {r["toxic"]: r["n"] for r in train_labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    wanted = F.broadcast(train_labels.withColumnRenamed("doc_id", "id"))  # at most max_labelled rows of 12 bytes
    plain = documents(docs)
    train = materialise(plain.join(wanted, plain.doc_id.eqNullSafe(F.col("id"))).select("text", "toxic"), "labelled")
    allowed = plain.filter(~held_out).select("text", F.lit(0).alias("toxic"))  # labels do not matter here
    grams = _counted(allowed, "gram string, n long", _char_counts).orderBy(F.desc("n"), "gram").limit(max_trigrams).collect()
    model = ToxicityModel(CharModel({r["gram"]: r["n"] for r in grams}), {})
    n1, n0 = float(sides.get(1, 0)), float(sides.get(0, 0))
    if not n1:
        return model
    counted = materialise(_counted(train, "feature string, pos long, neg long", _feature_counts(model.chars)), "features")
    tested = counted.filter("pos + neg > 1").count()
    total, seen = n1 + n0, F.col("pos") + F.col("neg")

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    ratio = 2 * (term(F.col("pos"), seen * n1 / total) + term(F.col("neg"), seen * n0 / total)
                 + term(n1 - F.col("pos"), (total - seen) * n1 / total) + term(n0 - F.col("neg"), (total - seen) * n0 / total))
    weight = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    strong = (counted.filter("pos > 1").withColumn("ratio", ratio).withColumn("weight", weight)
              .filter((F.col("weight") > 0) & (F.col("ratio") > 2 * math.log(20.0 * max(tested, 1))))
              .orderBy(F.desc("ratio"), "feature").limit(max_features).collect())
    model.lexicon = {r["feature"]: r["weight"] for r in strong}
    bins = _counted(train, "bin string, pos long, neg long", _bin_counts(model)).collect()  # at most 2 * most + 1 rows
    model.bias, model.slope = _logistic([(int(r["bin"]) / 2, r["pos"], r["neg"]) for r in bins])
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, evidence and score of every row."""

    def run(batches):
        evidence = _Evidence(model)
        for batch in batches:
            found = [evidence.of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64()), pa.array([model.probability(e) for e in found], pa.float64())],
                ["doc_id", "evidence", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, evidence double, score double")
