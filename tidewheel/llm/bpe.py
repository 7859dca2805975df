"""Byte-pair encoding and decoding by tree concatenation.

``BpeCodec`` gives the ids that the tokenizers library gives for a BPE vocabulary with
word ends (no special tokens added), and decodes as that library does where a
vocabulary has no decoder.

A text longer than ``text_leaf`` characters isn't encoded whole.  It is cut in halves, and these again, wherever the
cuts fall; the leaves are encoded in one batch, and neighbours are joined up the tree: what lies around a join is
encoded again, over a window that doubles until its first word is the left side's and its last
word the right side's.  Splitting reads a text from left to right and sees at most three characters
from where a word starts, so from a place where both sides agree that a word starts, and that is far enough from the cut, they agree on all that follows.

A word longer than ``leaf`` bytes isn't given to the merge loop whole either.  It is cut into
leaves that are encoded in parallel, and pairs of neighbours are joined up a tree: the
tokens around a join are encoded again, over a window that doubles until its first
token is the left side's and its last token the right side's.  A sequence of BPE tokens
is the encoding of its text if and only if each two neighbours are the encoding of
theirs; both sides and the window have that property and they share a token at each
end, so the joined sequence is exact.

Words are remembered during a task, up to ``MEMO_BYTES``; long ones aren't.

Null and empty texts have no tokens.  Repeated rows give repeated rows; only ``doc_id``
and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import over_batches

#: Longest run of bytes that one merge loop gets, longest text that is encoded whole.
LEAF_BYTES, TEXT_LEAF = 256, 1024
#: Bytes of remembered words in a task, about; longest word remembered.
MEMO_BYTES, MEMO_WORD = 48 << 20, 64
#: Characters from the start of a word that splitting looks at; words, and tokens, on each side of a window at first.
LOOK, WINDOW, TOKENS = 3, 2, 4

#: A word of a text: itself, number of ids, ids in decimal, tokens.
Piece = tuple[str, int, str, str]

#: Characters on which normalisation is only lower-casing: printable ASCII, white space,
#: Latin letters without U+0130, some punctuation.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xac\xae-įı-ſ‐-‧€]*")


def _class(kind: str) -> str:
    """The characters of ``_PLAIN`` of a Unicode category, for a character class."""
    low = [*range(0x20, 0x180), *range(0x2010, 0x2028), 0x20AC]
    return "".join(re.escape(chr(c)) for c in low if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class BpeCodec:
    def __init__(self, vocabulary: str, leaf: int = LEAF_BYTES, text_leaf: int = TEXT_LEAF):
        """vocabulary: the JSON text of a tokenizer file."""
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.leaf, self.text_leaf = leaf, text_leaf
        self.joins = {"text": 0, "word": 0}  # done so far
        vocab = spec["model"]["vocab"]
        # normalisation and splitting need no vocabulary
        self.rules = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self._bare = spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        # many words at once: only a word's last token has the end mark
        self.lines = Tokenizer.from_str(json.dumps(self._bare | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
        numbered = sorted({**vocab, **{t["content"]: t["id"] for t in spec["added_tokens"]}}.items(), key=lambda x: x[1])
        self.tokens = [t for t, _ in numbered]
        self.ends = [t.endswith("</w>") for t in self.tokens]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letter, number = _class("L"), _class("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+").findall
        self.letters = _byte_letters()
        self.memo: dict[str, Piece] = {}
        self.memo_bytes = 0

    # -- words

    @cached_property
    def end(self):
        """For the end of a long word; made when there is one."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self._bare))

    @cached_property
    def mid(self):
        """For the other leaves of a long word: no token is the last."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self._bare | {"model": self._bare["model"] | {"end_of_word_suffix": None}}))

    def forget(self) -> None:
        """Leave the remembered words."""
        self.memo.clear()
        self.memo_bytes = 0

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Words in byte letters."""
        short = [w for w in words if len(w) <= self.leaf]
        got, ids = [], self.lines.encode(" ".join(short), add_special_tokens=False).ids
        a, ends = 0, self.ends
        for b, x in enumerate(ids, 1):
            if ends[x]:
                got.append(ids[a:b])
                a = b
        each = iter(got)
        return [next(each) if len(w) <= self.leaf else self.encode_long(w) for w in words]

    def encode_long(self, word: str) -> list[int]:
        """A long word in byte letters, by tree concatenation."""
        n, cuts = len(word), [0]
        parts = 1 << max(1, (n // self.leaf).bit_length())
        cuts = sorted({n * k // parts for k in range(parts + 1)})
        spans = list(zip(cuts, cuts[1:], strict=False))
        leaves = [e.ids for e in self.mid.encode_batch_fast([word[a:b] for a, b in spans[:-1]], add_special_tokens=False)]
        leaves.append(self.end.encode(word[spans[-1][0] :], add_special_tokens=False).ids)
        while len(leaves) > 1:
            nxt, at = [], []
            for k in range(0, len(leaves) - 1, 2):
                (a, m), (_, b) = spans[k], spans[k + 1]
                nxt.append(self._join(word, a, m, b, leaves[k], leaves[k + 1]))
                at.append((a, b))
            if len(leaves) % 2:
                nxt.append(leaves[-1])
                at.append(spans[-1])
            leaves, spans = nxt, at
        return leaves[0]

    def _width(self, i: int, last: bool) -> int:
        """Bytes that a token covers; the word's last token has the end mark."""
        t = self.tokens[i]
        return len(t) - 4 if last and t.endswith("</w>") else len(t)

    def _join(self, word: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of word[a:b] from those of word[a:m] and word[m:b]."""
        is_end, k = b == len(word), TOKENS
        self.joins["word"] += 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            start = m - sum(self._width(x, False) for x in left[i:])
            stop = m + sum(self._width(x, is_end and y == len(right) - 1) for y, x in enumerate(right[:j]))
            at_end = is_end and stop == b
            window = (self.end if at_end else self.mid).encode(word[start:stop], add_special_tokens=False).ids
            agree_left = start == a or (i < len(left) and window[0] == left[i])
            agree_right = stop == b or window[-1] == right[j - 1]
            if agree_left and agree_right:
                return left[:i] + window + right[j:]
            k *= 2

    def _encoded(self, words: list[str]) -> list[Piece]:
        """The pieces of words of a text."""
        memo = self.memo
        try:
            return [memo[w] for w in words]
        except KeyError:
            pass
        if self.memo_bytes > MEMO_BYTES:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in memo]
        letters = self.letters
        coded = [w if w.isascii() and w.isprintable() else "".join([letters[x] for x in w.encode()]) for w in new]
        long = {}
        for w, ids in zip(new, self._encode_words(coded), strict=True):
            piece = (w, len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))
            if len(w) > MEMO_WORD:
                long[w] = piece
            else:
                memo[w] = piece
                self.memo_bytes += 400 + len(w) + len(piece[2]) + len(piece[3])
        return [long[w] if w in long else memo[w] for w in words]

    # -- texts

    def _split(self, text: str) -> list[str]:
        """The words of a normalised text that isn't plain."""
        return [text[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(text) if a < b]

    def _pieces(self, text: str) -> list[Piece]:
        """The pieces of a text without special tokens, by tree concatenation."""
        if _PLAIN.fullmatch(text):
            text, split = text.lower(), self.words
        else:
            text, split = self.rules.normalizer.normalize_str(text), self._split
        n = len(text)
        parts = 1 << (max(0, n - 1) // self.text_leaf).bit_length()  # halves of halves
        cuts = sorted({n * k // parts for k in range(parts + 1)})
        spans = list(zip(cuts, cuts[1:], strict=False))
        words = [split(text[a:b]) for a, b in spans]
        flat = self._encoded([w for leaf in words for w in leaf] if len(words) > 1 else words[0] if words else [])
        nodes, at_ = [], 0
        for leaf in words:
            nodes.append(flat[at_ : at_ + len(leaf)])
            at_ += len(leaf)
        while len(nodes) > 1:
            joined, at = [], []
            for k in range(0, len(nodes) - 1, 2):
                (a, m), (_, b) = spans[k], spans[k + 1]
                joined.append(self._join_texts(text, split, a, m, b, nodes[k], nodes[k + 1]))
                at.append((a, b))
            if len(nodes) % 2:
                joined.append(nodes[-1])
                at.append(spans[-1])
            nodes, spans = joined, at
        return nodes[0] if nodes else []

    def _join_texts(self, text: str, split: Callable[[str], list[str]], a: int, m: int, b: int, left: list[Piece], right: list[Piece]) -> list[Piece]:
        """The pieces of text[a:b] from those of text[a:m] and text[m:b]."""
        self.joins["text"] += 1
        k = WINDOW
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            start, stop, last = m, m, b
            for piece in reversed(left[i:]):  # between words there is only white space
                start = text.rindex(piece[0], a, start)
            for piece in right[:j]:
                last = text.index(piece[0], stop, b)
                stop = last + len(piece[0])
            if i == 0:
                start = a
            if j == len(right):
                stop = b
            window = self._encoded(split(text[start:stop]))
            agree_left = i == 0 or (m - start >= LOOK and bool(window) and window[0] == left[i])
            if agree_left and j == len(right):
                return left[:i] + window
            if agree_left and stop - last >= LOOK and len(window) > 1 and window[-1] == right[j - 1] and text.rindex(window[-1][0], start, stop) == last:
                return left[:i] + window + right[j:]
            k *= 2

    def encode_strings(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal, decoded text, of a whole text."""
        if self.at_special and any(s in text for s in self.special):
            got = []
            for part in self.at_special.split(text):
                got += [(part, 1, str(self.special[part]), part)] if part in self.special else self._pieces(part)
        else:
            got = self._pieces(text)
        if not got:
            return 0, "", ""
        _, n, ids, decoded = zip(*got, strict=True)
        return sum(n), " ".join(ids), " ".join(decoded)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_strings(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def bpe_encode(docs: DataFrame, vocabulary_path: str, *, with_ids: bool = False, leaf: int = LEAF_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every document.

    The vocabulary file is read on the driver and broadcast: its size is that of the file, a few MB.
    Each task encodes the rows that it has read; nothing is shuffled.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(vocabulary.value, leaf)  # a fifth of a second; workers live on for other stages' tasks, so nothing is kept
        for batch in batches:
            rows: list[tuple] = []
            held = start = 0
            for at, text in enumerate(batch.column(1), 1):
                n, ids, decoded = codec.encode_strings(text.as_py() or "")
                row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, np.array(ids.split(), np.int32)) if with_ids else row)
                held += n
                if at == batch.num_rows or with_ids and held > 1_000_000:  # bounds what a task holds
                    cols = list(zip(*rows, strict=True))
                    arrays = [batch.column(0).slice(start, at - start), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                    if with_ids:
                        ends = np.cumsum([0, *cols[0]]).astype(np.int32)
                        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[3]))))
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])
                    rows, held, start = [], 0, at

    return over_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text")), run, schema + (", ids array<int>" if with_ids else "")
    )
