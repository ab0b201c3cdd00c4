import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_packing import odd_texts
from tidelayer.llm import tokens
from tidelayer.llm.tokens import RankedMerges, TokenCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library():
    texts = [*odd_texts(), " a  b\n\n c <|endoftext|> d<|endoftext|>", "\x1c x\x1c!", "aaaaaaaaaa" * 50, "ab" * 77, "  \n", "!!!\x1c!! 12 345"]
    library = Tokenizer.from_file(PATH)
    for text, n in zip(texts, TokenCounter(PATH, most=500).counts(texts), strict=True):
        assert n == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_a_long_text_is_taken_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 100)
    monkeypatch.setattr(tokens, "slices", lambda texts: [(i, i + 1) for i in range(len(texts))])
    text = " ".join(odd_texts())
    assert TokenCounter(PATH).counts([text]) == [expected(text)]


def test_merging_of_runs():
    merges = RankedMerges(PATH)
    assert merges.counts([]).tolist() == []
    assert merges.counts([b"a"]).tolist() == [1]
    assert merges.counts([b"aaaa", b"the", b"zqzq"]).tolist() == [expected("aaaa"), expected("the"), expected("zqzq")]


def test_table(awkward, nothing):
    got = count_tokens(awkward, PATH).collect()
    assert len(got) == awkward.count()
    texts = {r.doc_id: r.text or "" for r in awkward.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id]
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), expected(text)) and r.over_limit == (r.n_tokens > 512)
    assert count_tokens(nothing, PATH).count() == 0
