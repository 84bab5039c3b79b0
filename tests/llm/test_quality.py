import re
from collections import Counter

from pitspark.llm import quality
from rows import LONG

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, rules=quality.Rules()):
    """The same measures, by strings and sets."""
    words = WORD.findall(text)
    n = len(words)
    grams = Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            dup_chars += len(line) * (line in seen)
            seen.add(line)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = n < 50 or 100 * len(covered) > 50 * n
    good = symbols <= rules.symbols_per_word * n and dup_chars / max(len(text), 1) <= rules.line_coverage
    for k, most in rules.coverage.items():
        known, later = set(), set()
        for i in range(n - k + 1):
            gram = tuple(words[i:i + k])
            if gram in known:
                later.update(range(i, i + k))
            known.add(gram)
        good &= sum(len(words[j]) for j in later) / max(chars, 1) <= most
    return n, chars, symbols, dup, len(covered), failed, not failed and good


def test_same_as_plain(spark, sf_dir, awkward):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for frame in (docs, awkward):
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        for r in quality.quality_rules(frame).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
            assert got == plain(texts[r.doc_id]), r.doc_id


def test_keep_rows_is_the_same_verdict(spark, awkward, nothing):
    good = {r.doc_id for r in quality.quality_rules(awkward).collect() if r.kept}
    kept = quality.keep_rows(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == good and 8 in good
    assert [r.text for r in kept.collect() if r.doc_id == 8] == [LONG]
    assert quality.quality_rules(nothing).count() == 0 and quality.keep_rows(nothing).count() == 0


def test_labelled_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality_rules(docs).join(labels, "doc_id").filter("not base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(clean) >= 0.97 * len(clean)
