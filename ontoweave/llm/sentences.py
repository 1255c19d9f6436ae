"""Sentence units of texts in any language and script, with offsets.

Method: a pushdown automaton reads the marks of a paragraph in order. List marks at the beginning of lines
push a level where they are set in further, and pop those they are set in less than; every item of a list is
read by itself. Within it opening quotes and brackets are pushed, closing ones popped (pairs without a partner
are ignored), and a terminator ends a sentence only at depth 0. Which marks terminate depends on the script of the paragraph; full stops are checked against
tries of abbreviations read backwards from the stop, against initials, ordinals, decimals and file names.
After a closing quote that holds a terminator, what follows decides whether the sentence goes on.

Defined results: null and blank texts have no sentences; a blank line ends a unit, a line break alone does
not; a text without terminators is one unit per paragraph; every item of a list begins a unit, its mark is part
of it and no sentence, and marks make a list only where at least two of a kind follow each other on one level
(numbers and letters one after the other), so that a line that happens to begin with one ends nothing; Thai sentences end at white space unless a
Latin letter or digit is next to it. Of rows with one id each distinct text is cut once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import over_rows, spread

# Abbreviations that are always followed by more of the sentence.
ABBR_INNER = (
    "mr mrs ms dr prof st lt col gen sgt capt rev hon fr mme mlle pr sr sra dra srta ud uds vs cf e.g i.e viz ca approx "
    "p pp fig figs eq eqs sec ch vol vols no nos art app ed eds nr abb tab bzgl bzw z.b d.h u.a s o.ä v evtl ggf inkl "
    "pág págs núm aprox env n° ex al mt ft op est "
    "стр рис см г ул проф им ок акад гр тов "
    "κ δρ π.χ σελ σχ βλ κα αρ "
    "د أ م "
    "डॉ पं प्रो श्री कु "
    "ዶ.ር አቶ "
    # letters of abbreviations that are set apart, as in "z. B."
    "b u z e d"
).split()
# Words of organisations' names cut short; with a capital letter they are followed by more of the name.
ABBR_NAMES = "dept univ inst instr res lab labs tech eng netw sys found fndn assn assoc mfg mgmt natl intl bio log hldg hldgs".split()
# Abbreviations that may also be the last word of a sentence.
ABBR_EITHER = (
    "etc usw ff inc corp co ltd llc l.l.c bros s.a g.m.b.h gmbh a.m p.m u.k u.s u.s.a ph.d m.d b.c a.d jr h min mo "
    "jan feb mar apr jun jul aug sep sept oct nov dec т.д т.п др пр т.е e.v"
).split()
# Month names that follow an ordinal.
MONTHS = set("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Frequent words by which German is told from other languages in Latin letters.
GERMAN = set("der die das und den dem des ein eine einen einem mit ist im am zum vom bei für nach ohne seit auf nicht wer hat".split())
OTHER_LATIN = set("the of and to in a is that for was with on el la los de que en un una le les et est des du une".split())
# Verbs of saying after which a quotation is part of its sentence, in scripts without case.
SPEECH = re.compile("قال|قالت|سأل|سألت|صرخ|صاح|ने कहा|ने पूछा|बोला|बोली|说|說|问|問|喊|叫|道|と|አለ|ጠየቀ|กล่าว|ถาม")

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "«": "»", "„": "“", "“": "”", "‹": "›", "‚": "‘"}
CLOSE = set(OPEN.values()) | {'"', "'", "’"}
STOPS = ".!?…。！？｡।॥።፧؟۔‼⁇⁈⁉;;"
EVENT = re.compile("[" + re.escape("".join(OPEN) + "".join(set(OPEN.values())) + '"' + "'’" + STOPS) + "]")
CLAUSE_END = re.compile("[" + re.escape(STOPS) + "\n]")
LIST_MARK = re.compile(r"(?:(?<=\n)|\A|(?<=\r))([ \t]*)(?:([-*+•–—·◦▪‣])|\(?(?:(\d{1,4})|([A-Za-z]))[.)])[ \t]+(?=\S)")
PARAGRAPH = re.compile(r"(?:[^\S\n]*\r?\n){2,}[^\S\n]*|\r(?!\n)[^\S\n]*\r|\u2029")
CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
THAI = re.compile("[฀-๿]")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
LETTER = re.compile(r"[^\W\d_]")
FILE_TAIL = re.compile(r"[A-Za-z]\w*\.[a-z]\w*")


def _trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        at = root
        for c in reversed(word):
            at = at.setdefault(c, {})
        at[""] = True
    return root


INNER, EITHER, NAMES = _trie(ABBR_INNER), _trie(ABBR_EITHER), _trie(ABBR_NAMES)


def _in_trie(trie: dict, text: str, stop: int, floor: int) -> bool:
    """Whether a whole word of the trie ends right before ``stop``."""
    at, i = trie, stop - 1
    while True:
        if "" in at and (i < floor or not (text[i].isalnum() or text[i] in ".'’" or unicodedata.category(text[i])[0] == "M")):
            return True
        if i < floor or (nxt := at.get(text[i].lower())) is None:
            return False
        at, i = nxt, i - 1


class Script:
    """What the automaton has to know about the writing of a paragraph."""

    def __init__(self, text: str, german: bool):
        cjk, thai, greek = len(CJK.findall(text)), len(THAI.findall(text)), len(GREEK.findall(text))
        cased = sum(1 for c in text if c.lower() != c.upper())
        letters = sum(1 for c in text if c.isalpha())
        self.cjk = cjk * 6 > letters
        self.thai = thai * 3 > letters
        self.greek = greek * 3 > letters
        self.cased = cased * 2 > letters
        self.german = german
        if not self.cased and not self.cjk and not self.thai:
            own = sum(1 for c in text if c.isalpha() and c.lower() == c.upper())
            self.cased = own * 5 < letters


def is_german(text: str, lang: str | None) -> bool:
    if lang:
        return lang.lower()[:2] in ("de", "ge")
    words = re.findall(r"\w+", text.lower())
    return sum(w in GERMAN for w in words) > sum(w in OTHER_LATIN for w in words)


def pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Opening mark -> its closing mark, by a stack; marks without a partner are left out."""
    stack: list[tuple[str, int]] = []
    found: dict[int, int] = {}
    for m in EVENT.finditer(text, start, end):
        c, i = m.group(), m.start()
        before = text[i - 1] if i > start else " "
        after = text[i + 1] if i + 1 < end else " "
        depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
        if c == "“" and not (stack and stack[-1][0] == "“"):
            depth = None
        if c in "'’" and (before.isalnum() and after.isalnum() or depth is None and (c == "’" or before.isalnum())):
            continue
        if c in "\"'" and depth is not None and (before.isspace() or before in "([{—–«“") and not after.isspace():
            depth = None
        if depth is not None:
            found[stack[depth][1]] = i
            del stack[depth:]
        elif c in OPEN:
            stack.append((OPEN[c], i))
        elif c in "\"'" and not after.isspace():
            stack.append((c, i))
    return found


def _goes_on(text: str, i: int, end: int, begin: int, opened_at: int | None, script: Script) -> bool:
    """Whether the sentence continues at ``i``, after a quotation that holds a terminator."""
    j = i
    while j < end and text[j].isspace():
        j += 1
    if j >= end:
        return False
    c = text[j]
    if c in ",;:，、；،؛—–-·":
        return True
    if opened_at is not None and text[opened_at] in "([{（［":
        return False
    if c in "とはがをにのってだでもや" and CJK.match(c):
        return True
    if opened_at is not None and text[begin:opened_at].strip() == "":
        stop = CLAUSE_END.search(text, j, end)
        if SPEECH.search(text, j, stop.start() if stop else end):
            return True
    return c.islower()


def boundary_ends(text: str, start: int, end: int, script: Script) -> list[int]:
    """The ends of the sentences of one paragraph (its own end not among them)."""
    ends: list[int] = []
    match = pairs(text, start, end)
    closing = {v: k for k, v in match.items()}
    depth, begin, i = 0, start, start
    if script.thai:
        for m in re.finditer(r"\s+", text[start:end]):
            a, b = start + m.start(), start + m.end()
            if not (re.match(r"[A-Za-z0-9À-ɏ]", text[a - 1]) if a > start else True) and not (b < end and re.match(r"[A-Za-z0-9À-ɏ]", text[b])):
                ends.append(a)
        return ends
    while m := EVENT.search(text, i, end):
        c, i = m.group(), m.start()
        if i in match:
            depth += 1
            i += 1
            continue
        if i in closing:
            depth -= 1
            i += 1
            continue
        if c not in STOPS or c in ";;" and not script.greek:
            i += 1
            continue
        j = i
        while j < end and (text[j] in STOPS and (text[j] not in ";;" or script.greek) and j not in closing):
            j += 1
        run = text[i:j]
        # closers after the terminator, also after a blank as French sets them
        k, opened_at, level = j, None, depth
        while k < end:
            if k in closing:
                opened_at, level = closing[k], level - 1
                k += 1
            elif text[k].isspace() and level > 0 and (s := _skip_blank(text, k, end)) in closing and s - k <= 2 and text[s] in "»”":
                k = s
            else:
                break
        if level > 0:
            i = j
            continue
        quoted = opened_at is not None
        if quoted and text[opened_at] in "([{（" and text[begin:opened_at].strip():
            # a bracket inside a sentence: its terminator does not end the outer sentence
            depth, i = level, k
            continue
        stop = _ends_here(text, i, j, k, end, begin, run, script)
        if stop and quoted:
            stop = not _goes_on(text, k, end, begin, opened_at, script)
        depth, i = level, k if stop else max(j, k)
        if stop:
            ends.append(k)
            begin = k
    return ends


def _skip_blank(text: str, k: int, end: int) -> int:
    while k < end and text[k] in " \u00a0\u202f":
        k += 1
    return k


def _ends_here(text: str, i: int, j: int, k: int, end: int, begin: int, run: str, script: Script) -> bool:
    n = k
    while n < end and text[n].isspace():
        n += 1
    follows = text[n] if n < end else ""
    spaced = n > k or n >= end
    if n >= end:
        return True
    if run[0] in "。！？｡।॥።፧؟۔‼⁇⁈⁉":
        return True
    if "…" in run or run.startswith(".."):
        if any(c in "!?。！？" for c in run):
            return True
        if run == "..":  # an abbreviation that ends its sentence
            return spaced
        if script.cjk and not script.cased and not spaced:
            return False
        return not follows.islower() and (spaced or follows.isupper())
    if any(c in "!?" for c in run):
        after = re.match(r"\s*[—–-]\s?\w", text[k : k + 5])
        if after and after.group()[-1].islower():
            return False
        return spaced or follows.isalpha() or follows in "¿¡«“„\"'(—"
    if run[0] in ";;":
        return spaced or follows.isalpha()
    # full stop
    if script.cjk:
        return False
    if not spaced and k == j:
        if not (follows.isupper() and i > begin and (text[i - 1].islower() or text[i - 1].isdigit() or text[i - 1] in "»”\"%)")):
            return follows in "¿¡«“„" and i > begin and text[i - 1].isalnum()
        if FILE_TAIL.match(text, j) or _in_trie(INNER, text, i, begin):
            return False
        nxt = text[n + 1] if n + 1 < end else " "
        return (nxt.islower() or nxt.isspace() or nxt in "’'" or nxt.isdigit() and False) and not _initials(text, i, begin)
    if k > j:
        return True
    if re.search(r"т\.\s?[дп]$", text[max(begin, i - 5) : i]):
        return _starts(follows)
    if _initial(text, i, begin) and not (text[i - 1].islower() and _in_trie(EITHER, text, i, begin) and text[i - 2 : i - 1] != "."):
        letters = re.search(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]$", text[max(begin, i - 12) : i])
        if not letters or not _in_trie(EITHER, text, i, begin):
            return False
        # capital letters that could be hours or years are initials, and so are letters that begin the sentence
        clock = letters.group() != letters.group().lower() and letters.group().lower() in ("a.m", "p.m", "b.c", "a.d")
        return not clock and bool(text[begin : max(begin, i - len(letters.group()))].strip(" \n\"'“„«(")) and _starts(follows)
    if _in_trie(EITHER, text, i, begin):
        word = re.search(r"[^\W\d_]+\.?[^\W\d_]*$", text[max(begin, i - 12) : i])
        if word and word.group().lower() in ("h", "min", "mo") and not re.search(r"\d\s*\w+$", text[max(begin, i - 12) : i]):
            return False
        return _starts(follows) or not script.cased
    if _in_trie(NAMES, text, i, begin) and re.search(r"(?<![^\W_])[^\W\d_]+$", text[max(begin, i - 6) : i]).group()[0].isupper():
        return False
    if _in_trie(INNER, text, i, begin):
        if re.search(r"(?:^|\s)no$", text[max(begin, i - 3) : i], re.I) and not follows.isdigit():
            return True
        return False
    if text[i - 1 : i].isdigit() and script.german:
        number = re.search(r"(?<![\d.,:])\d{1,2}$", text[max(begin, i - 4) : i])
        if number and (follows.islower() or re.match(r"\w+", text[n:end]) and re.match(r"\w+", text[n:end]).group() in MONTHS):
            return False
    return True


def _starts(c: str) -> bool:
    """Whether a character may begin a sentence after an abbreviation that may end one."""
    return c.isupper() or c in "¿¡«“„\"'([—–" or (c.isalpha() and c.lower() == c.upper())


def _initial(text: str, i: int, begin: int) -> bool:
    """A single letter (with its marks) before the stop."""
    j = i - 1
    while j >= begin and unicodedata.category(text[j])[0] == "M":
        j -= 1
    if j < begin or not text[j].isalpha():
        return False
    return j == begin or not (text[j - 1].isalnum() or unicodedata.category(text[j - 1])[0] == "M")


def _initials(text: str, i: int, begin: int) -> bool:
    return _initial(text, i, begin) and i - 2 >= begin and text[i - 2] in ". "


def list_items(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(where the item begins, where its text begins) of the items of lists in a paragraph.

    A level is (indent, kind of mark, its number, whether a sibling made it a list). A mark that is no sibling
    of the level it stands at begins a level of its own there.
    """
    levels: list[list] = []
    found: list[tuple[int, int, list]] = []
    for m in LIST_MARK.finditer(text, start, end):
        indent = len(m.group(1).expandtabs(4))
        at = int(m.group(3)) if m.group(3) else ord(m.group(4)) if m.group(4) else 0
        kind = m.group(2) or m.group()[m.end(3) - m.start() if m.group(3) else m.end(4) - m.start()] + ("1" if m.group(3) else "a")
        while levels and levels[-1][0] > indent:
            levels.pop()
        if levels and levels[-1][0] == indent:
            level = levels[-1]
            if level[1] == kind and (m.group(2) or at == level[2] + 1):
                level[2], level[3] = at, True
            else:
                level = levels[-1] = [indent, kind, at, False]
        else:
            level = [indent, kind, at, False]
            levels.append(level)
        found.append((m.start() + len(m.group(1)), m.end(), level))
    return [(begin, body) for begin, body, level in found if level[3]]


def sentences_of(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, without surrounding white space."""
    if not text:
        return []
    german = is_german(text, lang)
    out = []
    at = 0
    bounds = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)] + [(len(text), len(text))]
    for stop, after in bounds:
        if stop > at:
            script = Script(text[at:stop], german)
            items = list_items(text, at, stop)
            cuts = [(at, at), *items]
            for (begin, body), ahead in zip(cuts, [*(b for b, _ in items), stop]):
                last = begin
                for e in [*boundary_ends(text, body, ahead, script), ahead]:
                    s, t = last, e
                    while s < t and _blank(text[s]):
                        s += 1
                    while t > s and _blank(text[t - 1]):
                        t -= 1
                    if t > s:
                        out.append((s, t))
                    last = e
        at = after
    return out


def _blank(c: str) -> bool:
    return c.isspace() or c in "\ufeff\u200b"


def split_texts(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(id, start_char, end_char, sentence) of every sentence; rows that repeat each other are cut once."""
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    texts = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), lang.alias("lang")).where(F.col("text") != "")

    def rows(c: dict[str, list]) -> Iterable[tuple]:
        for key, text, lang in zip(c["key"], c["text"], c["lang"]):
            for s, e in sentences_of(text, lang):
                yield key, s, e, text[s:e]

    one = texts.groupBy("key", "text").agg(F.max("lang").alias("lang"))
    out = over_rows(spread(one), "key long, start_char long, end_char long, sentence string", rows)
    return out.withColumnRenamed("key", id_col)
