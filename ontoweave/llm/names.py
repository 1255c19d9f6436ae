"""Variant spellings of person and organisation names, linked to the entity they mean.

Method: the words of the names get MinHash signatures over padded q-grams; banding brings similar words
together, its bands set from the collision curve for a wanted recall. Two names are candidates if they share a
word or have similar ones and, beside it, a letter of another word: persons of the given name (of every form a
nickname stands for), firms of any other word. Candidates are verified by Monge-Elkan similarity (mean over the
words of one name of the best likeness in the other), whose likeness of words knows typing errors, initials,
nicknames and abbreviations. Links are clustered by star clustering.

What words mean is learnt from the table, on top of short lists of common ones (``Lexicon``): words that say
what kind of firm it is stand beside many others in names with a legal form; nicknames stand in quotes within a
name, or share rare surnames with one given name again and again; whether a name is a person's is what most of
its rows are labelled, where they are.

A word with a letter that more than ``BLOCK_MOST`` names share is a block that is split, for speed only: each name
asks for the words that a like name must have beside it (``block_keys``), and words meet where the verification
takes them for alike (``seeds_alike``). All pairs that pass the verification are in some part, so the links are
the same whether a block is split or not.

Defined results: null, empty and signless names are in no pair; names of one word are linked only where they
differ in case, accents or signs; equal spellings count once; every name is in one star, so no entity is
merged through a chain of doubtful links. Stars are emitted as pairs because the result is defined so.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_bounded, cut_lineage, over_rows, spread

GRAM, ROWS, WANTED, AT_LIKENESS = 2, 3, 0.97, 0.40
BLOCK_MOST = 300  # names of a block that is not split further
LEAST = 0.90  # likeness of a link; the parts of a split block hold all pairs from here on
FRONT = 10  # letters at the front of a word whose deletions are keys
KIND_SHARE, KIND_PARTNERS = 0.01, 5  # of the names with a legal form; different words beside it
GIVEN_SHARE = 0.0005  # of the persons
QUOTED_LEAST, SHARED_LEAST, NICK_SHARE, NICK_TRUST = 2, 2, 0.0002, 0.6
LABELS_LEAST = 5
GIVENS_OF_RARE = 6  # given names beside a surname that is rare enough to teach nicknames
HASHES = 1 << 31

# Words that say under which law a firm is, and titles.
LEGAL = {"inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd", "llc": "llc", "gmbh": "gmbh", "sa": "sa", "ag": "ag", "plc": "plc", "bv": "bv", "oy": "oy", "ab": "ab", "srl": "srl", "spa": "spa", "kg": "kg"}
TITLES = set("dr prof mr mrs ms miss sir dame rev hon herr frau mme mlle m.d phd ph.d jr sr".split())
SMALL = {"of", "and", "the", "for", "und", "et"}
# Common words for kinds of organisation, known before any table is read.
COMMON_KINDS = """
academy agency airlines association authority bakery bank breweries capital centre charity chemicals church clinic college commission committee consulting construction council
data department development electric energy engineering enterprises estate exchange farms federation finance foods forum foundation fund gallery garage group guild health holdings hospital
hotel house industries institute instruments insurance international investments laboratories laboratory labs library logistics machinery management manufacturing media metals mills mining
ministry motors museum networks office orchestra partners pharma pharmacy plastics power press products productions properties publishing railways records research resources
restaurant school schools services shipping society software solutions steel stores studios supplies systems technical technologies technology telecom textiles theatre trading transport trust
union university utilities ventures water works
"""
# Common nicknames, known before any table is read: each line a given name and what it is called.
COMMON_NICKNAMES = """
albert al bert|alejandro ale alex|alexander alex sascha sasha xander|alfred alf fred freddie|andrew andy drew|anna anya annie|anthony tony|antonio toni tonio|barbara barb babs|benjamin ben benny|bernard bernie
catherine cathy kate katie|charles charlie chuck|christine chris chrissie|christopher chris kit|daniel dan danny|david dave davy|deborah deb debbie|dmitri dima mitya|dorothy dot dottie dolly|edward ted ed eddie ned teddy
ekaterina katya kate|eleanor nell ellie nora|elizabeth beth liz lizzy eliza betty|eugene gene|ferdinand ferdi nando|florence flo florrie|frances fran frankie|francis frank|francisco paco pancho kiko curro|frederick fred freddie fritz
friedrich fritz fred|gabriel gabe|gennady gena|george georgie|gerald gerry jerry|giuseppe beppe pino peppe|gregory greg|guillermo memo|helena lena|henry harry hank|ignacio nacho|isabella bella isa|ivan vanya|jacob jake
jacqueline jackie|james jim jimmy jamie|jennifer jen jenny|johann hans|johannes hannes johan hans jan|john jack johnny|jonathan jon|jose pepe|joseph joe joey|josephine jo josie|joshua josh|katherine kate kathy kat katie kitty
kenneth ken kenny|lawrence larry|leonard len lenny leo|leopold poldi leo|lillian lily|louis lou louie|ludwig lutz|manuel manolo|margaret peggy meg maggie greta marge|maria masha|martin marty|matthew matt|maximilian max
michael mike mick mickey|mikhail misha|natalia natasha|nathaniel nat nate|nicholas nick nicky|nikolai kolya nick|olga olya|pamela pam|patricia pat patty tricia|patrick pat paddy|peter pete|philip phil pip|rachel rae
raymond ray|rebecca becky|richard dick rick richie|robert bob rob bobby bert|ronald ron ronnie|rosemary rosie|samuel sam sammy|sebastian seb basti|sergei seryozha|stephen steve|susan sue susie|svetlana sveta|tatiana tanya
theodore ted teddy theo|theresa tess terry|thomas tom tommy|timothy tim timmy|ursula uschi ulla|valentina valya tina val|victor vic|victoria vicky|vincent vince vinny|vladimir vova volodya|walter walt wally|wilhelm willi
william will bill liam billy|winifred winnie|yevgeny zhenya eugene|zachary zach
"""


QUOTED = re.compile(r"[\"“”„«]([^\"“”„«»]+)[\"“”»]")


def fold(text: str) -> str:
    """Lower case without accents and invisible characters."""
    text = unicodedata.normalize("NFKD", text.casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae").replace("œ", "oe"))
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def bands_for(likeness: float = AT_LIKENESS, rows: int = ROWS, wanted: float = WANTED) -> int:
    """Bands at which words of the given Jaccard likeness meet with the wanted probability: 1-(1-s^r)^b."""
    return math.ceil(math.log(1 - wanted) / math.log(1 - likeness**rows))


BANDS = bands_for()


def grams(word: str, q: int = GRAM) -> set[str]:
    padded = "^" * (q - 1) + word + "$" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


@lru_cache(maxsize=1)
def _mixers() -> list[tuple[int, int]]:
    import random

    r = random.Random(7)
    return [(r.randrange(1, HASHES) | 1, r.randrange(HASHES)) for _ in range(BANDS * ROWS)]


def band_keys(word: str) -> list[int]:
    """One key for each band of the word's MinHash signature."""
    base = [zlib.crc32(g.encode("utf-8")) for g in grams(word)]
    least = [min((a * x + b) & 0x7FFFFFFF for x in base) for a, b in _mixers()]
    return [hash((i, *least[i * ROWS : (i + 1) * ROWS])) & 0x7FFFFFFFFFFFFFFF for i in range(BANDS)]


def edits(a: str, b: str, most: int = 3) -> int:
    """Typing errors between two words: insertions, deletions, replacements, swaps of neighbours."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(now[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        before, row = row, now
        if min(row) > most:
            return most + 1
    return row[-1]


def typo(a: str, b: str) -> bool:
    short = min(len(a), len(b))
    return edits(a, b, 2) <= (2 if short >= 8 else 1 if short >= 4 else 0)


def abbreviates(short: str, full: str) -> bool:
    """``hldgs`` for ``holdings``: the first letter and others in order; prefixes from three letters on."""
    if len(short) >= len(full) or len(short) < 2 or short[0] != full[0]:
        return False
    if len(short) >= 4 and short[-1] == "s" and full.startswith(short[:-1]):
        return True
    if full.startswith(short):
        return len(short) >= 3
    it = iter(full)
    return len(short) >= 3 and all(c in it for c in short)


def _legal_letters(m: re.Match) -> str:
    """``S.A.`` as one word after a name; before one the letters are initials."""
    joined = re.sub(r"\W", "", m.group(1))
    return f" {joined} " if joined in LEGAL and m.string[: m.start()].strip() else m.group(1)


class Lexicon:
    """What words mean in names: kinds of firm, the letters such words are shortened to, nicknames, given names."""

    def __init__(self, kinds: Iterable[str] = (), shorts: Iterable[str] = (), nicks: Iterable[tuple[str, str]] = (), given: Iterable[str] = ()):
        self.kinds = frozenset(COMMON_KINDS.split()) | frozenset(kinds)
        self.shorts = frozenset(shorts)
        self.nicks = nick_table(nicks)
        self.given = frozenset(given) | frozenset(self.nicks) | frozenset(g for v in self.nicks.values() for g in v)

    @cached_property
    def _known(self) -> dict[str, bool]:
        return {}

    @cached_property
    def by_letter(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for k in sorted(self.kinds):
            out.setdefault(k[0], []).append(k)
        return out

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("kinds", "shorts", "nicks", "given")}

    def kind_word(self, word: str) -> bool:
        """Whether a word, perhaps mistyped or abbreviated, says what kind of firm it is."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = self._known[word] = self._is_kind(word)
        return found

    def _is_kind(self, word: str) -> bool:
        if word in self.shorts or word in self.kinds:
            return True
        if len(word) < 3 or word in self.given:
            return False
        bare = not re.search("[aeiou]", word[1:])
        if len(word) >= 5 and any(typo(word, k) for k in self.kinds if abs(len(k) - len(word)) <= 2):
            return True
        for k in self.by_letter.get(word[0], ()):
            if len(word) in (4, 5) and word[-1] == "s" and k.startswith(word[:-1]) or len(word) <= 8 and (bare or len(word) <= 6 and k.startswith(word)) and abbreviates(word, k):
                return True
        return False

    def apart(self, word: str) -> tuple[str, ...]:
        """Two words run together, one of them small or both kinds, with at most one wrong sign between."""
        for i in range(2, len(word) - 3):
            if word[:i] in SMALL or word[:i] in self.kinds:
                for j in (i, i + 1):
                    if word[j:] in self.kinds:
                        return word[:i], word[j:]
        return (word,)


class Name:
    """A name taken apart. kind: 'person', 'firm', 'other' or ''; ``typed`` is what its rows are labelled, '' if nothing."""

    __slots__ = ("kind", "legal", "words", "initials", "nicks", "first_initial", "comma", "folded", "cut_short", "sure")

    def __init__(self, text: str, lexicon: Lexicon, typed: str = ""):
        low = fold(text)
        self.folded = re.sub(r"[\W_]+", "", low)
        self.nicks = [re.sub(r"\W+", "", x) for x in QUOTED.findall(low)]
        low = re.sub(r"[\"“”„«][^\"“”„«»]+[\"“”»]", " ", low)
        low = re.sub(r"(?<!\w)((?:\w\.\s?){2,})(?=\W|$)", _legal_letters, low)
        low = re.sub(r"(?<!\w)g\.m\.b\.h\.?", " gmbh ", low)
        self.comma = bool(re.match(r"\s*[\w'’\- ]+,\s*\S", low))
        self.cut_short = bool(re.search(r"[^\W\d_]{2,6}\.\s*$", low))
        lettered = bool(re.search(r"\w\W.*(?<!\w)\w\s?&\s?\w(?!\w)", low))  # letters for kinds, as in P&P
        low = re.sub(r"(?<!\w)(\w)\s?&\s?(\w)(?!\w)", r" \1\2 ", low)
        low = re.sub(r"(?<=\w)['’\-‐‑](?=\w)", "", low)
        tokens = [t for x in re.findall(r"[^\W_]+", low) for t in lexicon.apart(x) if t not in SMALL]
        if len(tokens) >= 3 and any(lexicon.kind_word(t) for t in tokens):  # mistyped small words
            tokens = [t for t in tokens if not (2 <= len(t) <= 4 and t not in lexicon.shorts and t not in LEGAL and min(edits(t, "and", 1), edits(t, "of", 1) if len(t) <= 3 else 2) <= 1)]
        self.legal = next((LEGAL[t] for t in tokens if t in LEGAL and len(tokens) > 1), "")
        self.words = [t for t in tokens if len(t) > 1 and t not in TITLES and not (t in LEGAL and len(tokens) > 1)]
        self.initials = [t for t in tokens if len(t) == 1]
        brackets = re.findall(r"\((\w{1,5})\)", low)
        # a person's surname may look like a kind of firm, so what rows say goes before words, but not before the law
        firm = bool(self.legal) or bool(brackets) or lettered or (typed == "firm" if typed else (self.words[:1] != [] and self.words[0] in lexicon.kinds) or any(lexicon.kind_word(t) for t in self.words[1:]))
        parts = len(self.words) + len(self.initials) + len(self.nicks)
        self.kind = "" if not self.words else "firm" if firm and (parts >= 2 or self.legal) else "person" if parts >= 2 else "other"
        self.sure = bool(self.legal or typed)
        if self.kind == "firm":
            self.words += [t for t in self.initials if t in brackets]
        self.first_initial = self.initials[0] if self.initials else ""


def nick_table(extra: Iterable[tuple[str, str]] = ()) -> dict[str, frozenset[str]]:
    """nickname -> given names."""
    table: dict[str, set[str]] = {}
    for row in COMMON_NICKNAMES.replace("\n", "|").split("|"):
        given, *nicks = row.split() or [""]
        for n in nicks:
            table.setdefault(n, set()).add(given)
    for nick, given in extra:
        table.setdefault(nick, set()).add(given)
    return {k: frozenset(v) for k, v in table.items()}


def given_likeness(a: str, b: str, nicks: dict[str, frozenset[str]]) -> float:
    """Likeness of two given names, either of which may be an initial or a nickname."""
    if a == b:
        return 1.0
    full_a, full_b = nicks.get(a, frozenset()) | {a}, nicks.get(b, frozenset()) | {b}
    if len(a) == 1 or len(b) == 1:
        return 0.9 if {x[0] for x in full_a} & {x[0] for x in full_b} else 0.0
    if full_a & full_b:
        return 0.95
    if typo(a, b) and a[0] == b[0] or min(len(a), len(b)) >= 5 and edits(a, b, 1) <= 1:
        return 0.9
    if any(typo(x, y) for x in full_a for y in full_b if len(x) > 4 and len(y) > 4):
        return 0.9
    return 0.0


def firm_likeness(a: str, b: str, lexicon: Lexicon) -> float:
    if a == b:
        return 1.0
    if typo(a, b):
        return 0.95
    if abbreviates(a, b) or abbreviates(b, a):
        return 0.92
    return 0.9 if a[:5] == b[:5] and lexicon.kind_word(a) and lexicon.kind_word(b) else 0.0


def monge_elkan(a: list, b: list, likeness) -> float:
    """Mean over the words of ``a`` of the best likeness to a word of ``b``."""
    return sum(max((likeness(x, y) for y in b), default=0.0) for x in a) / len(a) if a else 0.0


def _firm_readings(words: list[str], lexicon: Lexicon) -> list[list[str]]:
    """The words as they are, and with two neighbours that name no kind joined (a name typed in two)."""
    out = [words]
    for i in range(len(words) - 1):
        if not lexicon.kind_word(words[i]) and not lexicon.kind_word(words[i + 1]):
            out.append([*words[:i], words[i] + words[i + 1], *words[i + 2 :]])
    return out


def firms_alike(a: Name, b: Name, lexicon: Lexicon) -> float:
    if a.legal and b.legal and a.legal != b.legal:
        return 0.0
    return max(_words_alike(x, y, lexicon) for x in _firm_readings(a.words, lexicon) for y in _firm_readings(b.words, lexicon))


def _words_alike(a: list[str], b: list[str], lexicon: Lexicon) -> float:
    alike = lambda x, y: firm_likeness(x, y, lexicon)
    both_ways = lambda x, y: min(monge_elkan(x, y, alike), monge_elkan(y, x, alike))
    if len(a) == 1 or len(b) == 1:
        return both_ways(a, b) if len(a) == len(b) else 0.0
    best = both_ways(a, b)
    for x, y in ((a, b), (b, a)):
        kinds = [w for w in y if lexicon.kind_word(w)]
        core = [w for w in y if w not in kinds]
        for t in x:
            # first letters in place of the words that name the kind
            if core and len(t) <= 3 and "".join(w[0] for w in kinds) == t:
                best = max(best, both_ways([w for w in x if w is not t], core))
    return best


def _surnames(n: Name) -> list[tuple[str, list[str], list[str], bool]]:
    """(surname, its given name or initial, all given names, whether it stands where surnames do) for every way to read a person's name.

    A surname stands last, or first before a comma or a single given name; either may have been typed in two.
    """
    w, out = n.words, []
    for i, j in dict.fromkeys(((len(w) - 1, len(w)), (0, 1), (len(w) - 2, len(w)), (0, 2))):
        if 0 <= i < j <= len(w) and (j == len(w) or n.comma or len(w) - j == 1):
            given = w[:i] + w[j:]
            out.append(("".join(w[i:j]), given[:1] or n.initials[:1] or n.nicks[:1], given, i == 0 if n.comma else j == len(w)))
    return out


def _ranked(n: Name, lexicon: Lexicon) -> list[tuple[str, list[str], list[str], bool]]:
    """The readings of a name, each with whether it is a likely one.

    Likely is a surname where surnames stand, whatever the word, and elsewhere a word that is no given name or
    stands beside one. No reading is dropped: an unlikely one only needs more of the given name.
    """
    return [(s, first, given, usual or len(s) >= 3 and s not in lexicon.given) for s, first, given, usual in _surnames(n)]


def persons_alike(a: Name, b: Name, lexicon: Lexicon) -> float:
    """Monge-Elkan likeness of two persons' names, the best over the ways to read them.

    The words of a reading are its surname, its first given name with the nicknames, and the initials after
    them; a word that the other name leaves out counts for nothing, a surname is only like a surname.
    """
    best = 0.0
    for s, first_a, given_a, likely_a in _ranked(a, lexicon):
        for t, first_b, given_b, likely_b in _ranked(b, lexicon):
            if not first_a or not first_b:
                continue
            d = edits(s, t, 2)
            if d > 2 or d == 2 and min(len(s), len(t)) < 7 or d and min(len(s), len(t)) < 3:
                continue
            # an initial or a nickname proves nothing where the surname itself is doubtful
            if not (likely_a and likely_b) and not (given_a and given_b and given_likeness(given_a[0], given_b[0], {})):
                continue
            x = [("surname", (s,)), ("given", (*first_a, *a.nicks))]
            y = [("surname", (t,)), ("given", (*first_b, *b.nicks))]
            if given_a and a.initials and given_b and b.initials:
                x.append(("middle", (a.initials[0],)))
                y.append(("middle", (b.initials[0],)))
            best = max(best, min(monge_elkan(x, y, lambda v, w: _part_likeness(v, w, lexicon)), monge_elkan(y, x, lambda v, w: _part_likeness(v, w, lexicon))))
    return best


def _part_likeness(x: tuple[str, tuple[str, ...]], y: tuple[str, tuple[str, ...]], lexicon: Lexicon) -> float:
    if x[0] != y[0]:
        return 0.0
    if x[0] == "surname":
        return 1 - 0.03 * edits(x[1][0], y[1][0], 2)
    if x[0] == "middle":
        return 1.0 if x[1] == y[1] else 0.7
    return max((given_likeness(v, w, lexicon.nicks) for v in x[1] for w in y[1]), default=0.0)


def likeness(x: str, y: str, lexicon: Lexicon | None = None, typed: tuple[str, str] = ("", "")) -> float:
    """Monge-Elkan likeness of two names; 0 where they are of different kinds or contradict each other."""
    lexicon = lexicon or Lexicon()
    return _alike(Name(x, lexicon, typed[0]), Name(y, lexicon, typed[1]), lexicon)


def _alike(a: Name, b: Name, lexicon: Lexicon) -> float:
    if not a.folded or not b.folded:
        return 0.0
    if a.folded == b.folded:
        return 1.0
    if a.kind != b.kind:
        # a name that ends in a word cut short is no person's for sure
        doubtful = {a.kind, b.kind} == {"firm", "person"} and any(n.kind == "person" and n.cut_short and not n.sure for n in (a, b))
        return firms_alike(a, b, lexicon) if doubtful else 0.0
    if a.kind == "firm":
        return firms_alike(a, b, lexicon)
    if a.kind == "person":
        return persons_alike(a, b, lexicon)
    return 0.0


def key_words(n: Name, lexicon: Lexicon) -> list[tuple[str, list[str]]]:
    """(word, the others) by which a name may be found: no titles, initials, kinds of firm or legal forms; two neighbours also as one."""
    w = n.words
    at = [i for i in range(len(w)) if (len(w[i]) >= 3 or n.kind == "person") and not (n.kind == "firm" and lexicon.kind_word(w[i]))] or list(range(len(w)))
    groups = [(i,) for i in at] + list(zip(at, at[1:]))
    return [("".join(w[i] for i in g), [x for i, x in enumerate(w) if i not in g]) for g in groups]


def fewer(word: str, two_from: int) -> set[str]:
    """The front of a word, and all that is left of it without one letter, or two in words of ``two_from`` letters or more.

    Words that many typing errors apart share one of them: leaving out the letters in error makes them equal, and
    where the fronts lose unequally many, the one that lost fewer may lose its last letters too.
    """
    out = last = {word[:FRONT]}
    for _ in range(2 if len(word) >= two_from else 1):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def inner_letters(word: str) -> set[str]:
    """The first letter with any two that follow it in order: the first three letters of all that abbreviates the word."""
    first, last = {}, {}
    for i, c in enumerate(word[1:]):
        first.setdefault(c, i)
        last[c] = i
    return {word[0] + x + y for x, i in first.items() for y, j in last.items() if i < j}


def seed_keys(seed: str, asks: bool) -> set[str]:
    """Keys of which two seeds share one if ``seeds_alike``."""
    tag, _, word = seed.partition(" ")
    if tag not in ("given", "surname", "firm"):
        return {seed}
    word = word.replace("+", "")
    out = {f"{tag} {v}" for v in fewer(word, 7 if tag == "surname" else 8)}
    if tag == "firm" and len(word) >= 3:
        short, full = ("short", "full") if asks else ("full", "short")  # which of the two asks
        out |= {f"{short} {word[:3]}"} | {f"{full} {v}" for v in inner_letters(word)}
    return out


def seeds_alike(x: str, y: str) -> bool:
    """Whether the verification may take the word asked for and another for alike; it does no others.

    A word read as one with the one before it (``before+word``) does not ask for that one, which is often the block's.
    """
    if x == y:
        return True
    (tag, _, a), (other, _, b) = x.partition(" "), y.partition(" ")
    if tag != other:
        return False
    if tag == "given":
        return typo(a, b)
    if tag == "surname":
        return edits(a, b, 2) <= (2 if min(len(a), len(b)) >= 7 else 1 if min(len(a), len(b)) >= 3 else 0)
    before, joined, _ = a.partition("+")
    if tag != "firm" or joined and before == b:
        return False
    a = a.replace("+", "")
    return typo(a, b) or abbreviates(a, b) or abbreviates(b, a)


def _given_seeds(given: str, lexicon: Lexicon) -> tuple[set[str], set[str]]:
    """Initials ask for every name of their letter, and full names for initials; full names meet in a form that is alike."""
    forms = lexicon.nicks.get(given, frozenset()) | {given}
    words, initials, named = ({f"{tag} {x}" for x in some} for tag, some in (("given", forms), ("initial", {f[0] for f in forms}), ("named", {f[0] for f in forms})))
    return (words | initials | named, words | initials) if len(given) == 1 else (words | initials, words | named)


def _firm_seeds(words: list[str], block: str, lexicon: Lexicon) -> tuple[set[str], set[str]]:
    """A firm asks for one of its words, best one that is not the block's, and is found by all of them.

    In firms that are alike each word has its like, or is the letters of the other's kinds, or one of the kinds
    that are letters there. From ten words on some may have none, so more are asked for; two may be read as one.
    Where the words asked for, read as one with those before them, are only like the latter, both names have both of those.
    """
    n = len(words)
    readings = _firm_readings(words, lexicon)
    tokens = {w for r in readings for w in r}
    letters = {k for r in readings if 0 < len(k := "".join(w[0] for w in r if lexicon.kind_word(w))) <= 3}
    order = sorted(range(n), key=lambda i: (words[i] in block, lexicon.kind_word(words[i]), -len(words[i]), i))
    asked, befores = set(), set()
    for i in order[: n // 10 + 2 if n >= 10 else 1]:
        asked |= {words[i]} | ({words[i] + words[i + 1]} & tokens if i + 1 < n else set())
        if i and words[i - 1] + words[i] in tokens:
            asked.add(f"{words[i - 1]}+{words[i]}")
            befores |= {(words[i - 1], x) for x in [*words[: i - 1], words[i - 1] + words[i], *words[i + 1 :]]}
    asks = {f"firm {w}" for w in asked} | {f"before {w} {x}" for w, x in befores}
    found = {f"firm {w}" for w in tokens} | {f"before {x} {w}" for w, x in befores}
    plain = {w.replace("+", "") for w in asked}
    asks |= {f"kinds {w}" for w in plain if len(w) <= 3}
    found |= {f"kinds {k}" for k in letters} | {f"letters {w}" for w in tokens if len(w) <= 3} | {f"stem {w[:5]}" for w in tokens if lexicon.kind_word(w)}
    if stems := {f"stem {w[:5]}" for w in plain if lexicon.kind_word(w)}:
        asks |= stems | {f"letters {k}" for k in letters}
    return asks, found


def block_keys(n: Name, lexicon: Lexicon) -> dict[tuple[str, str], tuple[set[str], set[str]]]:
    """(word, letter) -> (seeds by which the name asks, seeds by which it is found) within a block that is split.

    Given names that may be alike have the same first letter as an initial or under one of their full forms, or,
    mistyped in it, the same last letter. Of two names that are alike and in one block, in whatever way they came
    there, one asks for a seed that is alike to one by which the other is found: persons for the given name where
    the block is of both surnames, else for the surname.
    """
    at: set[tuple[str, str]] = set()
    readings = [(s, [*first, *n.nicks]) for s, first, _, _ in _surnames(n) if first] if n.kind == "person" else []
    for s, given in readings:
        for full in {f for x in given for f in lexicon.nicks.get(x, frozenset()) | {x}}:
            at |= {(s, f"^{full[0]}")} | ({(s, f"{full[-1]}$")} if len(full) >= 5 else set())
    firm = n.kind == "firm" or n.kind == "person" and n.cut_short and not n.sure
    if firm:
        # a short word may be one word cut short or the letters of several
        for w, rest in key_words(n, lexicon):
            for x in rest or [""]:
                at |= {(w, letter) for letter in {f"^{c}" for c in (x if len(x) <= 3 else x[0])} | ({f"{x[-1]}$"} if len(x) >= 5 else set()) or {"^"}}
    out: dict[tuple[str, str], tuple[set[str], set[str]]] = {(n.folded, "="): ({"="}, {"="})} if n.folded else {}
    for word in {w for w, _ in at}:
        asks, found = _firm_seeds(n.words, word, lexicon) if firm else (set(), set())
        found |= {f"surname {s}" for s, _ in readings}
        for s, given in readings:
            if s != word:
                asks.add(f"surname {s}")
            else:
                for x in given:
                    for held, more in zip((asks, found), _given_seeds(x, lexicon)):
                        held |= more
        out |= {(w, letter): (asks, found) for w, letter in at if w == word}
    return out


def quoted_nickname(text: str, lexicon: Lexicon, typed: str = "") -> tuple[str, str] | None:
    """(nickname, given name) of a person's name that quotes one; the given name's place is sure or there is none.

    It stands first before the quotes if a surname follows them, after the comma, or first after leading quotes.
    """
    n, low = Name(text, lexicon, typed), fold(text)
    m = QUOTED.search(low)
    if not m or n.kind != "person" or len(n.nicks[0]) < 2:
        return None
    before, after = low[: m.start()], low[m.end() :]
    words = lambda x: Name(x, lexicon).words
    if n.comma:
        given = words((before + " " + after).partition(",")[2])
    elif words(before):
        given = words(before) if words(after) else []
    else:
        given = words(after)[:-1]
    return (n.nicks[0], given[0]) if given else None


def distinct_names(frames: list[DataFrame]) -> DataFrame:
    """(name, n, typed) of every spelling in the given frames of a name and, if they have it, its label.

    typed is 'person' or 'firm' (any other label) if most of the labelled rows of the spelling say so, else ''; fewer
    than ``LABELS_LEAST`` labelled rows say nothing, since single labels are often wrong.
    """
    rows = None
    for f in frames:
        label = F.col(f.columns[1]) if len(f.columns) > 1 else F.lit(None).cast("string")
        part = f.select(F.col(f.columns[0]).alias("name"), label.alias("label"))
        rows = part if rows is None else rows.unionByName(part)
    person = F.avg((F.col("label") == "PERSON").cast("double"))
    typed = F.when(F.count("label") < LABELS_LEAST, "").when(person > 0.5, "person").when(person < 0.5, "firm").otherwise("")
    return rows.where(F.trim("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("n"), typed.alias("typed"))


FACTS = "what string, a string, b string, name string"


def learn(names: DataFrame) -> Lexicon:
    """What the names teach about their words. Everything learnt has a least share of the names, so its size is bounded by that share."""
    start = Lexicon()

    def facts(c: dict[str, list]) -> Iterable[tuple]:
        for name, typed in zip(c["name"], c["typed"]):
            n = Name(name, start, typed)
            if n.legal:
                yield "legal", "", "", name
                for w in n.words:
                    for x in n.words:
                        if x != w:
                            yield "beside", w, x, name
            if n.kind == "person":
                if pair := quoted_nickname(name, start, typed):
                    yield "quoted", *pair, n.folded
                if len(n.words) == 2 and not n.initials:
                    given, surname = n.words[::-1] if n.comma else n.words
                    yield "person", surname, given, name

    known = cut_lineage(over_rows(spread(names.select("name", "typed")), FACTS, facts))
    count = {r.what: r.n for r in known.groupBy("what").agg(F.countDistinct("name").alias("n")).collect()}
    beside = known.where("what = 'beside'").groupBy("a").agg(F.countDistinct("name").alias("n"), F.countDistinct("b").alias("partners"))
    beside = beside.where((F.col("n") >= KIND_SHARE * count.get("legal", 0)) & (F.col("partners") >= KIND_PARTNERS))
    # a name has few words, so no more than (words a name) / share of them pass
    kinds = [r.a for r in collect_bounded(beside.select("a"), int(50 / KIND_SHARE), "kinds of firm")]

    people = known.where("what = 'person'").select(F.col("a").alias("surname"), F.col("b").alias("given")).distinct()
    surnames = Window.partitionBy("surname")
    rare = people.withColumn("n", F.count(F.lit(1)).over(surnames)).where(F.col("n").between(2, GIVENS_OF_RARE))
    together = rare.alias("x").join(rare.alias("y"), "surname").where(F.col("x.given") < F.col("y.given")).groupBy(F.col("x.given").alias("g1"), F.col("y.given").alias("g2")).agg(F.count(F.lit(1)).alias("n"))
    total = people.select("surname").distinct().count()
    beside_given = people.groupBy("given").agg(F.count(F.lit(1)).alias("of"))
    together = together.where(F.col("n") >= F.greatest(F.lit(SHARED_LEAST), F.lit(NICK_SHARE * total)))
    for g, o in (("g1", "o1"), ("g2", "o2")):
        together = together.join(beside_given.select(F.col("given").alias(g), F.col("of").alias(o)), g)
    # the rarer of the two is the nickname: it hardly ever stands beside a surname that the other does not
    together = together.where(F.col("n") >= NICK_TRUST * F.least("o1", "o2"))
    shared = [(r.g1, r.g2) if r.o1 <= r.o2 else (r.g2, r.g1) for r in collect_bounded(together, int(GIVENS_OF_RARE**2 / NICK_SHARE), "nicknames by surnames")]
    quoted = known.where("what = 'quoted'").groupBy("a", "b").agg(F.countDistinct("name").alias("n"))
    quoted = quoted.where(F.col("n") >= F.greatest(F.lit(QUOTED_LEAST), F.lit(NICK_SHARE * count.get("quoted", 0))))
    said = [(r.a, r.b) for r in collect_bounded(quoted, int(1 / NICK_SHARE) + 1, "quoted nicknames")]
    # words that are given names far more often than surnames
    given = beside_given.where(F.col("of") >= F.greatest(F.lit(3.0), F.lit(GIVEN_SHARE * total))).join(people.groupBy(F.col("surname").alias("given")).agg(F.count(F.lit(1)).alias("as_surname")), "given", "left")
    given = given.where(F.col("of") >= 2 * F.coalesce("as_surname", F.lit(0))).select("given")
    first = [r.given for r in collect_bounded(given, int(50 * GIVENS_OF_RARE / GIVEN_SHARE), "given names")]

    taught = Lexicon(kinds)
    # letters that stand for two kinds which follow each other in some name
    short = known.where("what = 'beside'").where(F.length("a").between(2, 3)).groupBy("a").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= 1)
    pairs = _kind_letters(names, taught)
    shorts = [r.a for r in collect_bounded(short.join(pairs, F.col("a") == F.col("letters"), "left_semi").select("a"), 26**3, "letters for kinds")]
    return Lexicon(kinds, shorts, [*shared, *said], first)


def _kind_letters(names: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(letters): the first letters of all the kinds that some name has."""

    def letters(c: dict[str, list]) -> Iterable[tuple]:
        for name, typed in zip(c["name"], c["typed"]):
            kinds = [w for w in Name(name, lexicon, typed).words if w in lexicon.kinds]
            if len(kinds) >= 2:
                yield ("".join(w[0] for w in kinds),)

    return over_rows(spread(names.select("name", "typed")), "letters string", letters).distinct()


BLOCK_ROWS = "name string, word string, letter string, asks array<string>, found array<string>"


def blocks(names: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(name, word, letter, asks, found): the blocks of every name, and its seeds there."""
    send = names.sparkSession.sparkContext.broadcast(lexicon)

    def rows(c: dict[str, list]) -> Iterable[tuple]:
        for name, typed in zip(c["name"], c["typed"]):
            for (word, letter), (asks, found) in block_keys(Name(name, send.value, typed), send.value).items():
                yield name, word, letter, sorted(asks), sorted(found)

    return over_rows(spread(names.select("name", "typed")), BLOCK_ROWS, rows)


def similar_words(words: DataFrame) -> DataFrame:
    """(w1, w2), w1 < w2, of words that share a band of their MinHash signatures and are few typing errors apart."""

    def banded(c: dict[str, list]) -> Iterable[tuple]:
        for w in c["word"]:
            if len(w) >= 4:
                for i, k in enumerate(band_keys(w)):
                    yield w, i, k

    bands = over_rows(spread(words), "word string, band int, key long", banded)
    left, right = bands.alias("l"), bands.alias("r")
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.word") < F.col("r.word")))
    met = met.select(F.col("l.word").alias("w1"), F.col("r.word").alias("w2"))
    return met.where(F.levenshtein("w1", "w2") <= F.when(F.least(F.length("w1"), F.length("w2")) >= 7, 4).otherwise(2)).distinct()


def met_seeds(asks: DataFrame, found: DataFrame) -> DataFrame:
    """(ask, seed) of the given columns of seeds that are alike."""

    def keyed(of: DataFrame, name: str) -> DataFrame:
        def rows(c: dict[str, list]) -> Iterable[tuple]:
            return ((x, key) for x in c[name] for key in seed_keys(x, name == "ask"))

        return over_rows(spread(of.distinct()), f"{name} string, key string", rows)

    def alike(c: dict[str, list]) -> Iterable[tuple]:
        return ((x, y) for x, y in zip(c["ask"], c["seed"]) if seeds_alike(x, y))

    return over_rows(spread(keyed(asks, "ask").join(keyed(found, "seed"), "key").select("ask", "seed").distinct()), "ask string, seed string", alike)


def candidates(rows: DataFrame, most: int = BLOCK_MOST) -> DataFrame:
    """(name_a, name_b) of names that meet in a block; blocks of more than ``most`` names are split, which keeps all pairs of a likeness from ``LEAST`` on."""
    rows = cut_lineage(rows)
    sizes = rows.groupBy("word", "letter").agg(F.count(F.lit(1)).alias("n"))
    near = similar_words(rows.where("letter <> '='").select("word").distinct())
    one, two = sizes.select(F.col("word").alias("w1"), "letter", F.col("n").alias("n1")), sizes.select(F.col("word").alias("w2"), "letter", F.col("n").alias("n2"))
    apart = near.join(one.where("letter <> '='"), "w1").join(two, ["w2", "letter"]).select("w1", "w2", "letter", "n1", "n2")
    same = sizes.where("n > 1").select(F.col("word").alias("w1"), F.col("word").alias("w2"), "letter", F.col("n").alias("n1"), F.col("n").alias("n2"))
    met = cut_lineage(apart.unionByName(same))
    small = F.greatest("n1", "n2") <= most
    a, b = rows.select(F.col("name").alias("na"), F.col("word").alias("w1"), "letter", "asks"), rows.select(F.col("name").alias("nb"), F.col("word").alias("w2"), "letter", "found")
    keys = ["w1", "w2", "letter"]
    whole = met.where(small).select(*keys).join(a.drop("asks"), ["w1", "letter"]).join(b.drop("found"), ["w2", "letter"]).select("na", "nb")
    big = met.where(~small).select(*keys)
    big = big.unionByName(big.where("w1 <> w2").select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "letter"))
    asked = big.join(a, ["w1", "letter"]).select("na", "w2", "letter", F.explode("asks").alias("ask"))
    held = b.join(big.select("w2", "letter").distinct(), ["w2", "letter"], "left_semi").select("nb", "w2", "letter", F.explode("found").alias("seed"))
    seeds = met_seeds(asked.select("ask"), held.select("seed"))
    parts = asked.join(seeds, "ask").join(held, ["w2", "letter", "seed"]).select("na", "nb")
    return whole.unionByName(parts).where(F.col("na") != F.col("nb")).select(F.least("na", "nb").alias("name_a"), F.greatest("na", "nb").alias("name_b")).distinct()


def link_names(names: DataFrame, least: float = LEAST, lexicon: Lexicon | None = None) -> DataFrame:
    """(name_a, name_b, score) of verified links between spellings, name_a < name_b. ``names``: (name, n, typed)."""
    lexicon = lexicon or learn(names)
    # a split need not hold pairs that are less alike
    pairs = candidates(blocks(names, lexicon), BLOCK_MOST if least >= LEAST else sys.maxsize)
    typed = names.where("typed <> ''").select(F.col("name").alias("of"), "typed")
    for side in ("a", "b"):
        pairs = pairs.join(typed.select(F.col("of").alias(f"name_{side}"), F.col("typed").alias(f"typed_{side}")), f"name_{side}", "left")
    send = names.sparkSession.sparkContext.broadcast(lexicon)

    def verified(c: dict[str, list]) -> Iterable[tuple]:
        known, parsed = send.value, {}
        for x, y, p, q in zip(c["name_a"], c["name_b"], c["typed_a"], c["typed_b"]):
            for t, kind in ((x, p), (y, q)):
                if t not in parsed:
                    parsed[t] = Name(t, known, kind or "")
            score = _alike(parsed[x], parsed[y], known)
            if score >= least:
                yield x, y, score

    return over_rows(spread(pairs), "name_a string, name_b string, score double", verified)


def stars(names: DataFrame, links: DataFrame) -> DataFrame:
    """(name, centre): star clustering. The best linked free name becomes a centre, its free neighbours its satellites.

    Every round all names that outrank their free neighbours become centres at once, which gives the same
    stars as taking names one by one in the order of rank (no initials, links, rows, name).
    """
    both = links.select("name_a", "name_b", "score").unionByName(links.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "score"))
    # a name with an initial may stand for several given names, so it is a centre only where nothing better is near
    whole = (~F.col("name_a").rlike(r"(?:^|[^\p{L}])\p{L}(?:[^\p{L}]|$)")).cast("int").alias("whole")
    rank = both.groupBy("name_a").agg(F.count(F.lit(1)).alias("deg")).join(names.select(F.col("name").alias("name_a"), "n"), "name_a")
    rank = rank.select(F.col("name_a").alias("name"), F.struct(whole, "deg", "n", F.col("name_a").alias("name")).alias("rank"))
    edges = both.join(rank.select(F.col("name").alias("name_b"), F.col("rank").alias("rank_b")), "name_b").join(rank.select(F.col("name").alias("name_a"), F.col("rank").alias("rank_a")), "name_a")
    free = cut_lineage(edges.select("name_a", "name_b", "rank_a", "rank_b", "score"))
    out: list[DataFrame] = []
    while not free.isEmpty():  # every round takes at least the best ranked name
        centres = free.groupBy("name_a").agg(F.max(F.col("rank_b") > F.col("rank_a")).alias("beaten")).where(~F.col("beaten")).select(F.col("name_a").alias("centre"))
        held = free.join(centres, free.name_b == centres.centre).groupBy("name_a").agg(F.max_by("name_b", F.struct("score", "rank_b")).alias("centre"))
        got = cut_lineage(held.select(F.col("name_a").alias("name"), "centre").unionByName(centres.select(F.col("centre").alias("name"), "centre")))
        out.append(got)
        taken = got.select(F.col("name").alias("gone"))
        free = cut_lineage(free.join(taken, free.name_a == taken.gone, "left_anti").join(taken, free.name_b == taken.gone, "left_anti"))
    result = links.select(F.col("name_a").alias("name"), F.col("name_a").alias("centre")).limit(0)
    for more in out:
        result = result.unionByName(more)
    return result


def star_pairs(members: DataFrame) -> DataFrame:
    """(name_a, name_b) of all spellings of one star."""
    a, b = members.select(F.col("name").alias("name_a"), "centre"), members.select(F.col("name").alias("name_b"), "centre")
    return a.join(b, "centre").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()
