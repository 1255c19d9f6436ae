"""Encoding of texts with a public byte-level BPE tokenizer.

Method: dynamic programming over prefixes. Every piece of pre-tokenized text is matched by an automaton
whose failure links are the suffix links of the vocabulary, giving all tokens that end at each byte. Of
these exactly one is the last token of the encoding of that prefix: the one that is compatible with the
last token of the prefix before it. Two tokens are compatible if byte-pair merging of their joined bytes
gives the two back, which the table of merges answers without merging. The tokens of the whole piece
follow from back-pointers.

Defined results: a null or empty text has the empty list; strings that look like special tokens are
ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import over_rows, spread

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"
# The public pre-tokenization pattern of this vocabulary, a fixed value.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES = 400_000
CUT_BYTES = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PrefixEncoder:
    """Exact BPE encoding of one piece at a time; pieces already seen come from a bounded memory."""

    def __init__(self, path: str = TOKENIZER_FILE):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.pattern = regex.compile(PRETOKENS)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for at, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[a + b]
            self.parts[token] = (vocab[a], vocab[b])
            self.joined[vocab[a], vocab[b]] = token
            self.rank[token] = at + 1
        self.machine = ahocorasick.Automaton()
        for letters, token in vocab.items():
            if all(c in to_byte for c in letters) and (len(letters) == 1 or token in self.parts):
                own = "".join(chr(to_byte[c]) for c in letters)
                self.machine.add_word(own, (len(own), token))
        self.machine.make_automaton()
        self.seen: dict[str, tuple[int, ...]] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` directly followed by ``b`` survives byte-pair merging.

        Walks both tokens' merge histories backwards from the latest merge. A merge across the seam
        that ranks before the merge that formed the side facing it would have happened instead.
        """
        rank, joined, parts = self.rank, self.joined, self.parts
        bound = len(rank) + 2
        while True:
            across = joined.get((a, b))
            if across is not None and rank[across] < bound:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if ra == 0 and rb == 0:
                return True
            # the later of the two merges is undone first; equal ranks: the left one was made first
            if ra > rb:
                bound, a = ra, parts[a][1]
            else:
                bound, b = rb + 1, parts[b][0]

    def piece(self, text: str) -> tuple[int, ...]:
        got = self.seen.get(text)
        if got is not None:
            return got
        data = text.encode("utf-8").decode("latin-1")
        n = len(data)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        fits = self.fits
        for end, (size, token) in self.machine.iter(data):
            stop = end + 1
            if last[stop] < 0:
                begin = stop - size
                if begin == 0 or fits(last[begin], token):
                    last[stop], back[stop] = token, begin
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        ids = tuple(reversed(out))
        if len(self.seen) >= KEPT_PIECES:
            self.seen.clear()
        if n <= 64:
            self.seen[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for m in self.pattern.finditer(text or ""):
            ids.extend(self.piece(m.group()))
        return ids


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER_FILE) -> PrefixEncoder:
    """One encoder for each Python worker."""
    return PrefixEncoder(path)


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER_FILE) -> DataFrame:
    """(id, ids) for every row; one pass, no shuffle but the spreading of inputs smaller than the cluster."""

    def rows(c: dict[str, list]) -> Iterable[tuple]:
        enc = encoder(path)
        for key, text in zip(c["key"], c["text"]):
            yield key, enc.encode(text)

    out = over_rows(spread(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))), "key long, ids array<int>", rows, batch=512)
    return out.select(F.col("key").alias(id_col), "ids")
