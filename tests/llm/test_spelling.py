"""Spelling variants against plain one-edit neighbourhoods."""

import random
import re
import zlib
from collections import Counter

import pytest
from pitspark.llm import spelling
from rows import ROWS, clashing


def _edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}) - {word}


def _plain(rows, least=2, times=10):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= least}
    letters, out, form = {c for w in words for c in w}, {}, {}
    for w, n in words.items():
        near = sorted((x for x in _edits(w, letters) if x in words), key=lambda x: (-words[x], x))
        form[w] = near[0] if near and words[near[0]] >= times * n else None
        out[w] = len(near)
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, out[w], words.get(form[w])) for w, n in words.items())


def _texts(seed, stems):
    draw = random.Random(seed)
    letters, rows = "abcdeféÿ×", []
    words = ["".join(draw.choices(letters, k=draw.randint(7, 11))) for _ in range(stems)]
    for _ in range(stems):
        word = draw.choice(words)
        at = draw.randrange(len(word))
        words.append(word[:at] + draw.choice(["", draw.choice(letters), word[at] + draw.choice(letters)]) + word[at + 1:])
    for i in range(60):
        text = [w for w in draw.choices(words, weights=[1 / (1 + j % 40) ** 2 for j in range(len(words))], k=80)]
        rows.append((i, " ".join(w.upper() if draw.random() < .1 else w for w in text), "a"))
    return rows


def _got(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


@pytest.mark.parametrize("crowd", [spelling.CROWD, 2, 0])
def test_against_plain_neighbourhoods(spark, crowd):
    rows = _texts(3, 150)
    got = _got(spelling.spelling_variants(clashing(spark, rows), crowd=crowd))
    assert got == _plain(rows)
    assert sum(r[4] for r in got) > 60 and sum(r[1] is not None for r in got) > 5


def test_awkward_rows_and_a_missing_id(spark):
    rows = ROWS + [(None, "unbekannt Unbekannt unbekannf ÉÉÉÉÉÉÉ ÉÉÉÉÉÉÉ", "a")] * 2
    assert _got(spelling.spelling_variants(clashing(spark, rows))) == _plain(rows)


def test_empty_table(spark, nothing):
    assert spelling.spelling_variants(nothing).collect() == []


def test_symbols_grow_with_the_vocabulary():
    assert [spelling.alphabet(n) for n in (0, 1, 10 ** 4, 10 ** 6, 10 ** 9)] == [3, 3, 4, 8, 20]
