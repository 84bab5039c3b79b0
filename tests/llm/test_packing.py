import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pitspark.llm import packing
from tokenizers import Tokenizer

PATH = packing.tokenizer_file()


def check(frame, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    for doc, pieces in frame.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0], "<u4")
        copies = int((pieces["piece"] == 0).sum())
        pieces = pieces.drop_duplicates("piece").sort_values("piece")
        assert copies >= 1
        assert pieces["start"].tolist() == list(range(0, len(ids), capacity))
        for p in pieces.itertuples():
            part = ids[p.start:p.start + p.length]
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
        assert pieces["length"].sum() == len(ids)
    for _, group in frame.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == (group["length"].cumsum() - group["length"]).tolist()
        assert group["length"].sum() <= capacity


def test_awkward_rows(spark, awkward, nothing):
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    for group_pieces in (50_000, 4):
        check(packing.pack(awkward, PATH, group_pieces=group_pieces).toPandas(), texts)
    assert packing.pack(nothing, PATH).count() == 0


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame = packing.pack(docs, PATH).toPandas()
    check(frame, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    lengths = frame["length"]
    least = max(-(-int(lengths.sum()) // 2048), int((2 * lengths > 2048).sum()))
    assert frame["sequence_id"].nunique() <= 1.02 * least + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_search_never_overfills_or_adds(lengths):
    lengths = np.array(lengths, np.int64)
    first = packing.best_fit(lengths, 100)
    after = packing.local_search(lengths, first, 100)
    assert np.bincount(after, weights=lengths).max() <= 100
    assert after.max() <= first.max() and after.max() + 1 >= -(-lengths.sum() // 100)


@pytest.mark.parametrize("lengths, start, bins", [
    ([60, 40, 30], [0, 1, 2], 2),                          # a move
    ([45, 50, 40, 50], [0, 1, 2, 1], 2),
    ([70, 25, 65, 35, 5], [0, 0, 1, 1, 2], 2),             # fits nowhere whole before an exchange
])
def test_bins_are_emptied(lengths, start, bins):
    assert packing.local_search(np.array(lengths), np.array(start), 100).max() + 1 == bins


def test_memory_of_words_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    ids = packing._Ids(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    for text in ("A b, c. d! e", "b c A Ünï cöde", "<|endoftext|> <|ENDOFTEXT|> x.", "it's 3a. 12,", ""):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert ids.of(text) == want


def fewest(lengths, room):
    """Fewest sequences by trying every way to place pieces, the largest first."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in sorted(range(len(bins)), key=lambda j: bins[j]):
            if bins[j] + lengths[i] <= room and bins[j] not in bins[:j]:
                place(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1:])
        place(i + 1, bins + [lengths[i]])

    place(0, [])
    return best[0]


def test_small_inputs_against_the_optimum():
    draw, over = np.random.default_rng(6), 0
    for _ in range(150):
        lengths = np.sort(draw.integers(5, 60, draw.integers(3, 12)))[::-1].astype(np.int64)
        used = packing.local_search(lengths, packing.best_fit(lengths, 100), 100).max() + 1
        least = fewest(lengths.tolist(), 100)
        assert least <= used <= least + 1
        over += used - least
    assert over <= 3


def test_search_goes_on_behind_a_bin_that_cannot_be_emptied():
    """The least filled sequence fits nowhere; the next one can be emptied all the same."""
    lengths = np.array([50, 97, 2, 97, 2, 51, 2, 1], np.int64)
    start = np.array([0, 1, 1, 2, 2, 3, 4, 4], np.int64)
    after = packing.local_search(lengths, start, 100)
    assert np.bincount(after, weights=lengths).max() <= 100 and after.max() + 1 <= 4
