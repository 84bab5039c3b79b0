"""Awkward rows that every operator must handle."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(30))
#: ids and texts with nulls, empty and long texts, repeated rows, ties, one-word texts and odd white space
ROWS = [
    (1, "one two three four five six", "b"), (2, "one two three four five six", None), (3, "", "a"), (4, None, "a"), (5, " \t\n ", "c"),
    (6, "word", "a"), (7, "Word", "a"), (8, LONG, "b"), (9, LONG + " tail", "b"), (10, f"before it {PASSAGE} after it", "c"),
    (11, f"{PASSAGE} {PASSAGE} and again", None), (12, f"x {PASSAGE}", "d"), (13, "a\x0bb\x0cc d\xa0e ß É", "d"), (13, "a\x0bb\x0cc d\xa0e ß É", "d"),
    (14, "x " * 300, "a"), (15, "nul\\l [INST] </s> it's 12 <|endoftext|> <|ENDOFTEXT|>", "b"), (16, "la " * 60 + "\nline one\nline one\nline one", "a"),
]
SCHEMA = "doc_id long, text string, source string, digest string, until long, text_key string, part int, kept string, c0 string, row string, n long"


def clashing(spark, rows):
    """Documents whose other columns carry names the operators use inside."""
    full = [(i, t, s, "d", 1, "k", 2, "no", "c", "r", 3) for i, t, s in rows]
    return spark.createDataFrame(full, T._parse_datatype_string(SCHEMA))
