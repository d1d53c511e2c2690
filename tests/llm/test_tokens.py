"""Token counts and SentencePiece ids against the libraries."""
import os
import random

import pytest

from lexicor.llm import spm, tokencount
from lexicor.llm.queries import COUNT_TOKENIZER, PIECE_MODEL, tokenizer_path

ODD = [None, "", " ", "  two  blanks ", "tab\there\nline\r\nend", "éé ́x ﬁ Ⅷ", "\U0001F600 emoji‍", "▁ mark▁x",
       "日本語 テキスト", "don't we'll I'M <|endoftext|> x<|startoftext|>y", "a" * 70, "x1y2 3.14 1,000", "\x00\x01 a", "http://a.b/c?d=e",
       "def f(x):\n    return x ** 2  # ok\n\n\n", "!!! ... --- ???!?", "Ω ΣΑΣ. ΣΑΣ", "a b c"]


def texts():
    rng = random.Random(9)
    alphabet = "abcdeéß \n.,!▁3日'\t"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(150)]


@pytest.mark.parametrize("slice_chars", [1 << 20, 13])
def test_counts_equal_the_library(spark, monkeypatch, slice_chars):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokencount, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(tokencount, "MEMORY_PIECES", 50)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(tokenizer_path(COUNT_TOKENIZER))
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokencount.count_tokens(docs, tokenizer_path(COUNT_TOKENIZER), limit=20)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    for _, text, n_bytes, n_tokens, over in got.collect():
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        assert (n_bytes, n_tokens, over) == (len((text or "").encode()), n, n > 20), text
    assert tokencount.count_tokens(docs.limit(0), tokenizer_path(COUNT_TOKENIZER)).count() == 0


@pytest.mark.parametrize("slice_chars", [1 << 20, 13])
def test_ids_equal_the_library(spark, monkeypatch, slice_chars):
    import sentencepiece

    monkeypatch.setattr(spm, "SLICE_CHARS", slice_chars)
    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a b", None), (1, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = tokenizer_path(PIECE_MODEL)
    got = spm.decode(spm.encode(docs, path, decoded_col="same", remember=40), path)
    assert got.columns == ["doc_id", "text", "ids", "same", "decoded"]
    for _, text, ids, same, decoded in got.collect():
        assert ids == own.encode(text or ""), text
        assert decoded == own.decode(ids), text
        assert same == (decoded == (text or ""))
        assert same or "▁" in text
    assert spm.encode(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("text", ["x" * 5_000, "x" * 200_000, "ab" * 30_000, "日本語中文" * 3_000, "中" * 6_000, "的" * 50_000,
                                  "ACGTTGCA" * 4_000, "กขคง" * 2_500], ids=lambda t: f"{t[:2]}{len(t)}")
def test_long_runs_of_letters_equal_the_library(text):
    import sentencepiece

    path = tokenizer_path(PIECE_MODEL)
    machine = spm.Transducer(path)
    ids = machine.encode(text)
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    assert machine.decode(ids) == text
    assert sum(len(k) + len(v) for k, v in machine.heads.items()) < 10_000


def test_random_long_words_equal_the_library():
    import sentencepiece

    rng = random.Random(3)
    path = tokenizer_path(PIECE_MODEL)
    machine, own = spm.Transducer(path, remember=200), sentencepiece.SentencePieceProcessor(model_file=path)
    for alphabet in ("etaoinshr", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "的一是不了人我在有他"):
        for n in (63, 64, 65, 68, 300, 7_000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert machine.encode(text).tolist() == own.encode(text)


def test_cheapest_path_without_joints():
    m = spm.Transducer(tokenizer_path(PIECE_MODEL))
    m.merges = False
    m.weight = {"a": 1.0, "b": 1.0, "ab": 3.0, "abc": 2.5, "c": 1.0, "bc": 0.5}
    m.id = {p: i for i, p in enumerate(m.weight)}
    m.starts = {p[:k] for p in m.weight for k in range(1, len(p) + 1)}
    assert m.path("abc") == [m.id["a"], m.id["bc"]]
    assert m.path("aéb") == [m.id["a"], m.byte[0xC3], m.byte[0xA9], m.id["b"]]
    assert m.path("") == []
