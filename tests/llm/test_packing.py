import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelayer.llm import packing
from tidelayer.llm.packing import OpenBins, WordTokens, pack, pack_pieces, sequences, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = " \n\t\x1c\x85\xa0aAbéÉΣσ'sltd1½!<|>endoftxİ́​　한"


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def odd_texts(count=400):
    random.seed(1)
    latin = ["".join(random.choices(" \nabÉéßÿ×÷µº½'.,!-_7sT<|>\xa0\x85", k=random.randint(0, 60))) for _ in range(count)]
    return ["", "  ", "it's I'LL 's", "<|startoftext|>x <| y", "a<|endoftext|>b", "A<|ENDOFTEXT|>", "e\u0301. É'S", *latin] + ["".join(random.choices(ALPHABET, k=random.randint(0, 60))) for _ in range(count)]


def test_words_give_the_ids_of_the_tokenizer():
    texts, library = odd_texts(), Tokenizer.from_file(PATH)
    for text, ids in zip(texts, WordTokens(PATH, most=300).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_long_text_is_taken_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "LONG", 100)
    monkeypatch.setattr(packing, "slices", lambda texts: [(i, i + 1) for i in range(len(texts))])
    text = " ".join(odd_texts())
    assert np.frombuffer(next(WordTokens(PATH).encode([text])), "<u4").tolist() == whole(text)[:-1]


def test_pieces_and_places(awkward):
    placed = pack(awkward, PATH, length=64).collect()
    assert sum(r.length for r in placed) == sum(len(whole(r.text)) for r in awkward.select("text").collect())
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    texts = {r.doc_id: r.text for r in awkward.select("doc_id", "text").collect() if r.doc_id is not None}
    ids = {k: whole(t) for k, t in texts.items()}
    for r in placed:
        if r.doc_id is not None:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert r.start == 64 * r.piece and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_sequences_give_the_tokens_back(awkward):
    docs = awkward.where("doc_id < 5").dropDuplicates(["doc_id"])
    pieces = token_pieces(docs, PATH, 64, keep_ids=True)
    got = sequences(pieces, pack_pieces(pieces, 64)).collect()
    assert sum(len(r.ids) // 4 for r in got) == sum(len(whole(r.text)) for r in docs.collect())


def test_empty_table(nothing):
    assert pack(nothing, PATH).count() == 0


def test_the_fullest_bin_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 4, 3)] == [(0, 0), (1, 0), (0, 6), (1, 7)]  # best fit
    bins = OpenBins(10, 2)
    first = [bins.place(n) for n in (9, 6, 8)]  # the third open bin closes the first, which is the fullest
    assert [p[0] for p in first] == [0, 1, 2] and bins.place(1)[0] == 2
    with pytest.raises(ValueError):
        bins.place(11)


def test_few_sequences():
    random.seed(2)
    sizes = sorted((random.randint(1, 4096) for _ in range(3000)), reverse=True)
    bins = OpenBins(4096, 65_536)
    for n in sizes:
        bins.place(n)
    assert bins.made <= 1.01 * sum(sizes) / 4096 + 1


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "some words"), ("b", "more"), (None, None)], "doc_id STRING, text STRING")
    got = pack(docs, PATH).collect()
    assert sorted((r.doc_id or "", r.offset >= 0) for r in got) == [("", True), ("a", True), ("b", True)]
    struct = pack(docs.selectExpr("struct(doc_id) AS doc_id", "text"), PATH)
    assert {r.doc_id.doc_id for r in struct.collect()} == {"a", "b", None}
