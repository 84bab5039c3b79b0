"""Quality rules by repetition coverage.

For each text, rolling hashes of several n-gram lengths find every n-gram that occurs
twice or more in the text; the rule looks at the share of characters that lie inside
such n-grams (each character once, however many n-grams cover it) and inside lines equal
to an earlier line. Only repeats after the first occurrence count, so a text that shows
one heading twice is not rejected for it. A text is measured whole, in one task; texts do
not meet, so nothing is shuffled and no group can be hot.

Defined results: a null or empty text has no words and fails the base rule; equal rows
get equal rows; an empty table gives an empty table; columns other than id and text are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents, slices, text_bytes

#: n-gram length and the largest share of a text's word characters inside later repeats of it.
COVERAGE = {n: 0.25 for n in range(5, 11)}
LINE_COVERAGE = 0.25
SYMBOLS_PER_WORD = 0.10
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    coverage: dict[int, float] = field(default_factory=lambda: dict(COVERAGE))
    line_coverage: float = LINE_COVERAGE
    symbols_per_word: float = SYMBOLS_PER_WORD
    min_words: int = 50
    repeat_share: float = 0.50


def _repeated(texts: Words, n: int, first_too: bool = False) -> np.ndarray:
    """Per word of the slice: whether an n-word window that its text has seen before covers it.

    With ``first_too`` the first of the equal windows counts as well.
    """
    covered = np.zeros(len(texts.starts) + 1, np.int32)
    keys, at = texts.grams(n)
    doc = texts.doc_of_word()[at] if len(at) else at
    keys = keys ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if not len(keys):
        return np.zeros(len(texts.starts), dtype=bool)
    order = np.argsort(keys)
    ordered = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if len(begin) < len(keys):
        size = np.diff(begin, append=len(keys))
        again = np.repeat(size > 1, size)
        hit = at[order[again]]
        if not first_too:
            hit = np.setdiff1d(hit, at[np.minimum.reduceat(order, begin)[size > 1]], assume_unique=True)
        covered[hit] += 1
        covered[hit + n] -= 1
    return np.cumsum(covered[:-1]) > 0


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _lines(raw: np.ndarray, offsets: np.ndarray, solid: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the characters in them."""
    count, chars = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    words_before = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        seen: set[bytes] = set()
        at = lo
        for line in raw[lo:hi].tobytes().split(b"\n"):
            end = at + len(line)
            if words_before[end] > words_before[at]:
                if line in seen:
                    count[i] += 1
                    chars[i] += points[end] - points[at]
                else:
                    seen.add(line)
            at = end + 1
    return count, chars


def measure(batch: pa.RecordBatch, rules: Rules) -> dict[str, np.ndarray]:
    raw, offsets = text_bytes(batch.column("text"))
    texts = Words(raw, offsets)
    head = (raw & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(head, dtype=np.int64)])
    solid_points = np.concatenate([[0], np.cumsum(head & texts.solid, dtype=np.int64)])
    lengths = solid_points[texts.ends] - solid_points[texts.starts]
    n_words = texts.counts.astype(np.int64)
    word_chars = _per_text(lengths, texts.first)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw], dtype=np.int64)])
    dup_lines, line_chars = _lines(raw, offsets, texts.solid, points)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup_lines, "n_repeat_words": _per_text(_repeated(texts, 3, first_too=True), texts.first),
    }
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > 100 * rules.repeat_share * n_words)
    verdict = out["n_symbols"] <= rules.symbols_per_word * n_words
    chars = np.maximum(points[offsets[1:]] - points[offsets[:-1]], 1)
    out["line_share"] = line_chars / chars
    verdict &= out["line_share"] <= rules.line_coverage
    for n, most in rules.coverage.items():
        share = _per_text(lengths * _repeated(texts, n), texts.first) / np.maximum(word_chars, 1)
        out[f"share_{n}"] = share
        verdict &= share <= most
    out["kept"] = ~out["base_failed"] & verdict
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the measures, the covered shares, and whether it stays."""
    shares = ["line_share", *(f"share_{n}" for n in rules.coverage)]
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, " + ", ".join(f"{s} double" for s in shares))
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                got = measure(part, rules)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(got[n]) for n in names[1:])], names)

    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Only the text and a row's other columns, as one struct, go through the task; the text is
    not sent twice.
    """
    schema = docs.schema
    names = [f"c{i}" for i in range(len(schema))]
    text = names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                view = pa.RecordBatch.from_arrays([part.column(text)], ["text"])
                yield part.filter(pa.array(measure(view, rules)["kept"]))

    return plain.mapInArrow(run, plain.schema).select(*(F.col(n).alias(f.name) for n, f in zip(names, schema)))
