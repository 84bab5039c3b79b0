"""Ids and decoded texts against the library itself."""

import hashlib

import numpy as np
import pytest
from pitspark.llm import pieces
from pitspark.llm.queries import QUERIES
from rows import ROWS, clashing

ODD = ["  ", " a", "a ", "a  b  ", "▁x ▁", "\0z", "日本 🎉x y", "\n\n a\r\n", "a▁", "𐍈𐍈 ", "</s> <s> <unk> <0x41>", "▁", " " * 40 + "x" + " " * 17]


@pytest.fixture(scope="module")
def library():
    return pieces.model(pieces.model_file()).library


def _plain(library, rows):
    for row in rows:
        ids = library.encode(row[1] or "", add_eos=True)
        yield row[0], len(ids), ids, library.decode(ids)


def _got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_every_text_as_the_library_encodes_and_decodes_it(spark, library):
    rows = ROWS + [(100 + i, t, "a") for i, t in enumerate(ODD)] + [(None, "no id", "a"), (None, None, None)]
    got = _got(pieces.encode(clashing(spark, rows), pieces.model_file()))
    assert got == sorted(_plain(library, rows), key=repr)


def test_several_blocks_and_batches(spark, library):
    rows = ROWS * 3
    found = pieces.encode(clashing(spark, rows).repartition(2), pieces.model_file(), block_bytes=500, out_ids=50)
    assert _got(found) == sorted(_plain(library, rows), key=repr)


def test_empty_table(spark, nothing):
    assert pieces.encode(nothing, pieces.model_file()).collect() == []


def test_packed_numbers_come_back():
    for values in ([], [0], [5, 4_000_000_000, 7, 65536], [1, 1, 0, 255, 256, 2, 3]):
        assert pieces._unpack(pieces._pack(np.array(values, np.int64))).tolist() == values


def test_folded_pieces_come_back():
    draw = np.random.default_rng(5)
    for words in (0, 1, 40):
        sizes = draw.integers(0, 13, words)
        starts, ids = np.concatenate([[0], np.cumsum(sizes)]), draw.integers(0, 2, int(sizes.sum()))
        folded = pieces._fold(starts, ids)
        assert len(folded[1]) <= len(ids)
        assert pieces._unfold(sizes, *folded).tolist() == ids.tolist()


def test_models_that_do_not_fit_are_refused(monkeypatch):
    monkeypatch.setattr(pieces, "_CROSSING", __import__("re").compile("▁"))
    with pytest.raises(ValueError, match="cross"):
        pieces.Model(pieces.model_file())


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(doc, n, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            for doc, n, ids, text in _plain(library, docs)}
    assert {tuple(r) for r in QUERIES["op13_pieces"](spark, sf_dir).collect()} == want
