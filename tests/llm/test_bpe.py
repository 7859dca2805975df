import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewheel.llm.bpe import BpeCodec, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")


FULL = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH) as f:
        return BpeCodec(f.read(), leaf=16)


def library(codec, text):
    return FULL.encode(text, add_special_tokens=False).ids


def test_tree_equals_library(codec):
    rnd = random.Random(3)
    alphabets = [["ab", "th", "e", "er", "a", "aa", "in"], list("ab"), ["x"], list("abcdefghijklmnopqrstuvwxyzéñ你")]
    for k in range(200):
        text = "".join(rnd.choice(alphabets[k % 4]) for _ in range(rnd.randint(17, 3000)))
        assert codec.encode(text) == library(codec, text)


def test_any_text_equals_library(codec):
    rnd = random.Random(5)
    pieces = ["abc", "é", "Σ", "İ", "don't", "'re", "''s", "<|startoftext|>", "<|endoftext|>", "  ", "\x1c", "\x85", "\xa0", "½", "²", "ª", "ʰ", "你好", "😀", "_-", "1234", "́", "ﬁ", "\x7f", "\xad", "ǅ", "ẞ", "\x00"]
    for _ in range(1500):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        ids = library(codec, text)
        n, got, decoded = codec.encode_strings(text)
        assert (n, got) == (len(ids), " ".join(map(str, ids)))
        assert decoded == codec.decode(ids) == FULL.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text_leaf", [1, 2, 7, 40])
def test_any_cut_equals_library(codec, text_leaf):
    rnd = random.Random(9 + text_leaf)
    pieces = ["abc", "r", "e", "'", "'re", "''s", "'l", "l", "don't", " ", "  ", "\n", "12", "3", "!", "?!", "-", "Ä", "x" * 30, "\t"]
    odd = [*pieces, "Σ", "İ", "\x1c", "\x85", "\xa0", "½", "ʰ", "你好", "😀", "\u0301", "ﬁ", "<|endoftext|>"]
    small = BpeCodec.__new__(BpeCodec)
    small.__dict__ = codec.__dict__ | {"text_leaf": text_leaf, "joins": {"text": 0, "word": 0}}
    for k in range(400):
        text = "".join(rnd.choice(pieces if k % 2 else odd) for _ in range(rnd.randint(0, 60)))
        assert small.encode(text) == library(codec, text), text
    assert small.joins["text"] > 400


def test_documents_go_through_the_tree(spark):
    with open(PATH) as f:
        codec = BpeCodec(f.read())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text in texts:
        assert codec.encode(text) == library(codec, text)
    assert codec.joins["text"] >= sum(len(t) // 2048 for t in texts) > 500
    assert codec.encode("ab" * 5000) == library(codec, "ab" * 5000) and codec.joins["word"] > 10


def test_memory_is_bounded_by_bytes(codec, monkeypatch):
    from tidewheel.llm import bpe

    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    small = BpeCodec.__new__(BpeCodec)
    small.__dict__ = codec.__dict__ | {"memo": {}, "memo_bytes": 0}
    for k in range(50):
        text = " ".join(f"{chr(97 + k % 26)}{chr(97 + i % 26)}{'z' * (i % 90)}" for i in range(40))
        assert small.encode(text) == library(codec, text)
    assert 0 < len(small.memo) < 200 and all(len(w) <= bpe.MEMO_WORD for w in small.memo)


def test_operator(make, odd, codec):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(bpe_encode(make(odd), PATH, with_ids=True).collect(), key=repr)
    want = []
    for i, text, *_ in odd:
        ids = library(codec, text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(FULL.decode(ids, skip_special_tokens=False)), ids))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: repr(r).replace("(", "Row(doc_id=", 1)) or sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe_encode(make([]), PATH).count() == 0
