"""Evaluation items that occur, in whole or in part, in a corpus.

Method: latent semantic retrieval. Corpus passages get TF-IDF vectors over hashed words with document
frequencies of the whole corpus; a randomised low-rank factorisation of their Gram matrix, summed in one
distributed pass over all texts, gives the latent space. Two searches run in it by cosine:

* every run of ``BLOCK`` corpus words against the items' blocks (``NEAR``). Blocks are laid out so that every
  run of 12 item words holds a whole one, and equal passages have cosine 1 in any latent space, so the search
  loses no exact leak. A document leaks an item exactly if it holds all words of the item in order without a
  gap, or 12 successive ones, compared without case, punctuation, white space, markup and invisible characters;
* passages about as long as the items against whole items (``ALIKE``). These are paraphrases if they hold the
  item's answer (all its numbers and ``ANSWER_SHARE`` of its ``ANSWER_WORDS`` rarest words) and most of its
  words in order (longest common subsequence).

Defined results: null, empty and wordless items never leak; items that say the same all count; null and
empty documents leak nothing; a document or item id on several rows counts once, each of its texts being
checked. The items are the stated query set: their number is bounded (checked), the corpus is not.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded, over_parts, over_rows, spread

BLOCK = 6
RUN = 12
PASSAGE = 2 * BLOCK
FEATURES = 4096
RANK = 48
NEAR, ALIKE = 0.95, 0.75
ANSWER_WORDS, ANSWER_SHARE = 4, 0.75
ITEMS_MOST = 20_000
TILE, SEGMENT = 4096, 1 << 15
SEED = 20_260_101

TAGS = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
TARGETS = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|!?\[([^\[\]]*)\](?:\([^()\s]*\)|\[[^\[\]]*\])|\[\^[^\]]*\]:?|\{\{[^{}]*\}\}")
COMMANDS = re.compile(r"\\(?:begin|end|label|ref|cite)\{[^{}]*\}|\\[A-Za-z]+\*?")
WORD = re.compile(r"[^\W_]+")


class _Visible(dict):
    """Character -> itself, or nothing for invisible ones and marks."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = code if unicodedata.category(c) not in ("Cf", "Mn") or c.isalnum() else None
        return self[code]


VISIBLE = _Visible()


def _kept(m: re.Match) -> str:
    return f" {m.group(1) or m.group(2) or ''} "


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup and invisible characters."""
    if not text:
        return []
    text = html.unescape(text) if "&" in text else text
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(VISIBLE)
    if "<" in text:
        text = TAGS.sub(" ", text)
    if "[" in text or "{{" in text:
        text = TARGETS.sub(_kept, text)
    if "\\" in text:
        text = COMMANDS.sub(" ", text)
    return WORD.findall(text.lower())


def feature(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % FEATURES


def blocks_of(n: int) -> list[tuple[int, int]]:
    """Start and end of the query blocks of an item of n words."""
    if n <= BLOCK:
        return [(0, n)] if n else []
    return [(s, s + BLOCK) for s in range(0, n - BLOCK + 1, BLOCK)]


def must_hold(words: list[str]) -> list[str]:
    """The joined word runs of which a leaking document holds at least one."""
    n = min(RUN, len(words))
    return ["".join(words[k : k + n]) for k in range(len(words) - n + 1)] if n else []


class Stream:
    """The words of a text run together, since white space does not count, and where they begin and end."""

    def __init__(self, words: list[str]):
        self.text = "".join(words)
        self.bounds = {0, *accumulate(map(len, words))}

    def holds(self, run: str) -> bool:
        """Whether the run is there from the beginning of a word to the end of one."""
        at = self.text.find(run)
        while at >= 0:
            if at in self.bounds and at + len(run) in self.bounds:
                return True
            at = self.text.find(run, at + 1)
        return False


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, a whole row at a time as bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def passage_size(n: int) -> int:
    """The size of corpus passages that an item of n words is compared with: steps of a half more."""
    size = RUN
    while size * 1.25 < n:
        size = size * 3 // 2
    return size


def _word_rows(words: list[str], cache: dict[str, int]) -> np.ndarray:
    out = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        f = cache.get(w)
        if f is None:
            f = cache[w] = feature(w)
        out[i] = f
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def corpus_sketch(docs: DataFrame, rank: int = RANK) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(document frequencies, texts, Y, O) of the whole corpus by one pass, summed in each task before anything is sent.

    With T the word counts of all non-overlapping passages and O a random test matrix, every task adds its
    share of Y = T'T O and counts in how many texts each hashed word occurs.
    """
    test = np.random.default_rng(SEED).standard_normal((FEATURES, rank)).astype(np.float32)

    def rows(parts: Iterator[dict[str, list]]) -> Iterator[tuple]:
        cache: dict[str, int] = {}
        share, seen, n = np.zeros((FEATURES, rank)), np.zeros(FEATURES, np.int64), 0
        for part in parts:
            held, size = [], 0
            for text in [*part["text"], None]:
                if text is not None:
                    at = _word_rows(plain_words(text), cache)
                    if len(at):
                        seen[np.unique(at)] += 1
                        n += 1
                        for k in range(0, len(at), TILE):
                            held.append(at[k : k + TILE])
                            size += len(held[-1])
                if size and (text is None or size >= TILE):
                    _add_passages(held, test, share)
                    held, size = [], 0
        for f in np.flatnonzero(seen):
            yield int(f), int(seen[f]), share[f].tolist()
        yield -1, n, None

    parts = over_parts(docs.select("text"), "feature int, n long, y array<double>", rows)
    sums = parts.groupBy("feature").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("y")[k]) for k in range(rank)]).alias("y"))
    df, total, y = np.zeros(FEATURES), 0, np.zeros((FEATURES, rank))
    for r in collect_bounded(sums, FEATURES + 1, "hashed words"):
        if r.feature < 0:
            total = r.n
        else:
            df[r.feature], y[r.feature] = r.n, r.y
    return df, total, y, test.astype(np.float64)


def _add_passages(held: list[np.ndarray], test: np.ndarray, share: np.ndarray) -> None:
    """Adds T'T O of the passages of ``PASSAGE`` words into which each row of words is cut."""
    words = np.concatenate(held)
    first = np.concatenate([np.arange(len(x)) % PASSAGE == 0 for x in held])
    passage = np.cumsum(first) - 1
    sums = np.add.reduceat(test[words], np.flatnonzero(first), axis=0)
    order = np.argsort(words, kind="stable")
    found, begin = np.unique(words[order], return_index=True)
    share[found] += np.add.reduceat(sums[passage[order]], begin, axis=0)


def latent_space(y: np.ndarray, test: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Singular vectors (features x rank) of all TF-IDF passages A = T D by a one-pass randomised method.

    D is diagonal and positive, so O = D^-1 (test matrix) is as random as the test matrix itself, and
    A'A O = D T'T (test matrix) needs no second pass; then A'A ~ Y (O'Y)^-1 Y', whose eigenvectors span the space.
    """
    rank = test.shape[1]
    core = test.T @ y
    core = (core + core.T) / 2 + 1e-9 * max(1.0, np.abs(core).max()) * np.eye(rank)
    w, u = np.linalg.eigh(core)
    keep = w > w.max() * 1e-10 if w.max() > 0 else np.zeros_like(w, bool)
    if not keep.any():
        return np.random.default_rng(SEED).standard_normal((FEATURES, rank)) / np.sqrt(FEATURES)
    vectors, _, _ = np.linalg.svd((y * idf[:, None]) @ (u[:, keep] / np.sqrt(w[keep])), full_matrices=False)
    return vectors


class Blocks:
    """Unit vectors of queries, searched for all within a cosine of given vectors.

    The vectors lie in balls around centres. One ball is left out for a vector only where the angle to its
    centre exceeds the wanted angle plus the ball's own, so nothing is missed. Both sides are read in tiles:
    memory does not grow with the number of queries times that of passages.
    """

    def __init__(self, vectors: np.ndarray, near: float):
        self.near = near
        n = len(vectors)
        rng = np.random.default_rng(SEED)
        centres = vectors[np.sort(rng.choice(n, max(1, round(n**0.5)), replace=False))] if n else vectors
        nearest = np.zeros(n, np.int64)
        for _ in range(4 if n else 0):
            nearest = np.concatenate([(vectors[k : k + TILE] @ centres.T).argmax(axis=1) for k in range(0, n, TILE)])
            centres = _unit(np.array([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))], np.float32))
        nearest = np.concatenate([(vectors[k : k + TILE] @ centres.T).argmax(axis=1) for k in range(0, n, TILE)]) if n else nearest
        self.members = [np.flatnonzero(nearest == c) for c in range(len(centres))]
        self.vectors = [np.ascontiguousarray(vectors[m].T) for m in self.members]
        wide = [np.arccos(np.clip((centres[c] @ v).min(), -1, 1)) if v.shape[1] else 0.0 for c, v in enumerate(self.vectors)]
        angle = np.arccos(near) + np.array(wide)
        self.centres, self.least = centres, np.where(angle >= np.pi, -2.0, np.cos(np.minimum(angle, np.pi))) - 1e-4

    def hits(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, cosine) of all pairs that reach the wanted cosine."""
        for k in range(0, len(found), TILE):
            tile = found[k : k + TILE]
            close = tile @ self.centres.T >= self.least
            for c in np.flatnonzero(close.any(axis=0)):
                rows = np.flatnonzero(close[:, c])
                for q in range(0, self.vectors[c].shape[1], TILE):
                    cosines = tile[rows] @ self.vectors[c][:, q : q + TILE]
                    r, at = np.nonzero(cosines >= self.near)
                    if len(r):
                        yield rows[r] + k, self.members[c][q + at], cosines[r, at]


def _passages(total: np.ndarray, at: list[int], lengths: list[int], size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, segment, start in it) of the runs of ``size`` words of segments that lie one after another.

    ``total`` are the running sums of the words' vectors. Runs begin every ``stride`` words, the last one ends
    with its segment; a segment without room for one is a run by itself.
    """
    starts = [np.append(np.arange(0, n - size, stride), max(0, n - size)) for n in lengths]
    segment = np.repeat(np.arange(len(lengths)), [len(x) for x in starts])
    local = np.concatenate(starts)
    begin = np.asarray(at)[segment] + local
    end = begin + np.minimum(size, np.asarray(lengths)[segment])
    return _unit(total[end] - total[begin]).astype(np.float32), segment, local


class Search:
    """Everything a task needs to find the items in a text; its size is that of the items, not of the corpus."""

    def __init__(self, known: list[tuple[int, list[str]]], space: np.ndarray, idf: np.ndarray):
        self.known, self.space = known, space
        cache: dict[str, int] = {}
        at = [_word_rows(words, cache) for _, words in known]
        self.owner, vectors = [], []
        for k, rows in enumerate(at):
            for s, e in blocks_of(len(rows)):
                self.owner.append(k)
                vectors.append(space[rows[s:e]].sum(axis=0))
        self.owner = np.array(self.owner)
        self.blocks = Blocks(_unit(np.array(vectors, np.float32)), NEAR)
        self.short = sorted({len(w) for _, w in known if len(w) < BLOCK})
        self.runs = [must_hold(w) for _, w in known]
        # an item's answer: its numbers and its rarest words
        self.answers = []
        for (_, words), rows in zip(known, at):
            ranked = sorted(dict(zip(words, idf[rows])).items(), key=lambda x: (-x[1], x[0]))
            self.answers.append(({w for w in words if w[:1].isdigit()}, {w for w, _ in ranked[:ANSWER_WORDS]}))
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(known):
            if len(words) >= RUN:
                by_size[passage_size(len(words))].append(k)
        self.whole = {size: (np.array(ks), Blocks(_unit(np.array([space[at[k]].sum(axis=0) for k in ks], np.float32)), ALIKE)) for size, ks in by_size.items()}

    def in_texts(self, texts: Iterable[list[str]], paraphrase: float) -> Iterator[tuple[int, int, str, float, float]]:
        """(index of the text, item_id, kind, cosine, shared) of the items that the texts hold; many texts at a time."""
        cache: dict[str, int] = {}
        overlap = 2 * max([RUN, *self.whole])
        held: list[tuple[int, list[str], int, np.ndarray]] = []
        size = 0
        for i, words in enumerate(texts):
            rows = _word_rows(words, cache)
            for k in range(0, max(1, len(rows) - overlap), SEGMENT):
                held.append((i, words, k, rows[k : k + SEGMENT + overlap]))
                size += len(held[-1][3])
                if size >= SEGMENT:
                    yield from self._in_segments(held, paraphrase)
                    held, size = [], 0
        if held:
            yield from self._in_segments(held, paraphrase)

    def _in_segments(self, held: list[tuple[int, list[str], int, np.ndarray]], paraphrase: float) -> Iterator[tuple[int, int, str, float, float]]:
        lengths = [len(rows) for *_, rows in held]
        at = [0, *accumulate(lengths)][:-1]
        total = np.vstack([np.zeros((1, self.space.shape[1])), np.cumsum(self.space[np.concatenate([rows for *_, rows in held])], axis=0, dtype=np.float64)])
        best: dict[tuple[int, int], float] = {}
        for size in (BLOCK, *self.short):
            vectors, segment, _ = _passages(total, at, lengths, size, 1)
            for rows, queries, cosines in self.blocks.hits(vectors):
                for key in zip(segment[rows].tolist(), self.owner[queries].tolist(), cosines.tolist()):
                    best[key[:2]] = max(best.get(key[:2], 0.0), key[2])
        exact: set[tuple[int, int]] = set()
        streams: dict[int, Stream] = {}
        for (g, k), c in best.items():
            i, words, begin, rows = held[g]
            if g not in streams:
                streams[g] = Stream(words[begin : begin + len(rows)])
            if any(streams[g].holds(run) for run in self.runs[k]):
                exact.add((i, k))
                yield i, self.known[k][0], "exact", c, 1.0
        for size, (items, blocks) in self.whole.items():
            room = [g for g, n in enumerate(lengths) if n * 2 >= size]
            if not room:
                continue
            vectors, segment, starts = _passages(total, [at[g] for g in room], [lengths[g] for g in room], size, max(1, size // 4))
            near: dict[tuple[int, int], list[tuple[float, int]]] = defaultdict(list)
            sets: dict[tuple[int, int], set[str]] = {}
            for rows, queries, cosines in blocks.hits(vectors):
                for r, k, c in zip(rows.tolist(), items[queries].tolist(), cosines.tolist()):
                    g = room[segment[r]]
                    if (held[g][0], k) not in exact:
                        near[g, k].append((c, held[g][2] + int(starts[r])))
            for (g, k), found in near.items():
                i, words = held[g][:2]
                share, c = max((self._shared(k, i, words, max(0, s - size // 2), s + size + size // 2, sets), c) for c, s in found)
                if share >= paraphrase:
                    yield i, self.known[k][0], "paraphrase", c, share

    def _shared(self, k: int, text: int, words: list[str], start: int, end: int, sets: dict[tuple[int, int], set[str]]) -> float:
        """The share of the item's words that the passage holds in order; 0 where it does not hold the item's answer."""
        item, (numbers, rare) = self.known[k][1], self.answers[k]
        held = sets.get((text, start))  # all passages of one size: many items ask for the same
        if held is None:
            held = sets[text, start] = set(words[start:end])
        if not numbers <= held or len(rare & held) < ANSWER_SHARE * len(rare):
            return 0.0
        return longest_common(item, words[start:end]) / len(item)


LEAKS = "doc_id long, item_id long, kind string, cosine double, shared double"


def leaks(docs: DataFrame, items: DataFrame, paraphrase: float = 0.8) -> DataFrame:
    """(doc_id, item_id, kind, cosine, shared): kind 'exact' or 'paraphrase', the share of item words held in order."""
    known = [(r.item_id, plain_words(r.text)) for r in collect_bounded(items.select("item_id", "text").where(F.col("text") != "").distinct(), ITEMS_MOST, "evaluation items")]
    known = sorted((i, w) for i, w in known if w)
    if not known:
        return docs.sparkSession.createDataFrame([], LEAKS)
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text") != ""))
    df, total, y, test = corpus_sketch(texts)
    idf = np.log((1 + total) / (1 + df)) + 1
    space = (latent_space(y, test, idf) * idf[:, None]).astype(np.float32)
    send = texts.sparkSession.sparkContext.broadcast(Search(known, space, idf))

    def rows(c: dict[str, list]) -> Iterator[tuple]:
        for i, *found in send.value.in_texts(map(plain_words, c["text"]), paraphrase):
            yield c["doc_id"][i], *found

    found = over_rows(texts, LEAKS, rows)
    return found.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"), F.max("cosine").alias("cosine"), F.max("shared").alias("shared"))
