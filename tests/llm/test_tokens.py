import random

import pytest
from tokenizers import Tokenizer

from ledgerlight.llm import tokens

TEXTS = ["", " ", "plain words, and more.", "don't we'll I've 12.5% <|endoftext|> x", "tabs\tand\n\n  spaces   ", "naïve café – “q” 日本語 🙂👩‍🌾 Привет", "a​b­   \x00\x1c\x85 end", "x" * 20_000, "é" * 3000 + " ", "٣٤٥ ① Ⅷ ﬁ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_like_the_library(library):
    rng = random.Random(3)
    more = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x1F300, 0x1FAFF), 32, 10])) for _ in range(rng.randrange(200))) for _ in range(400)]
    for text in TEXTS + more:
        want = library.encode(text, add_special_tokens=False)
        assert tokens.encode(text) == want.ids
        assert tokens.Decoder().feed(want.ids, True) == text


def test_offsets():
    for text in TEXTS:
        ids = tokens.encode(text)
        starts, ends = tokens.spans(text, ids)
        assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends, strict=True))
        assert sorted({k for a, b in zip(starts, ends, strict=True) for k in range(a, b)}) == list(range(len(text)))


def test_decoder_keeps_split_characters():
    ids = tokens.encode("日本語🙂")
    d = tokens.Decoder()
    assert "".join(d.feed([i]) for i in ids) + d.feed([], True) == "日本語🙂"
    assert "�" in tokens.Decoder().feed(ids[:-1], True)


def test_frame(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "hi", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode_corpus(df, offsets=True).collect()
    assert [(r.doc_id, list(r.ids)) for r in got] == [(1, tokens.encode("hello world"))] * 2 + [(2, []), (3, []), (None, tokens.encode("hi"))]
    assert got[0].starts == [0, 5] and got[0].ends == [5, 11]
    back = tokens.decode_ids(spark.createDataFrame([(1, tokens.encode("hé")), (2, None), (3, []), (4, [999_999, None])], "doc_id long, ids array<int>"))
    assert [r.text for r in back.orderBy("doc_id").collect()] == ["hé", None, "", "��"]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_other_vocabularies_are_an_error():
    """One that splits or normalizes text in another way would silently give other ids."""
    with pytest.raises(ValueError, match="word_bpe_49k"):
        tokens.encode("text", "/opt/tokenizers/word_bpe_49k.json")
