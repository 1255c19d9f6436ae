"""Markup residue in sentences and headings: found by a trained tree model, removed with its structure kept.

Method: a sentence is a tree: its root, one node for its text and for each step of its heading path, and
below them one node for each sign that may be markup, nested as the signs enclose each other; pairs of signs that
overlap compete. A node's own potential comes from a logistic model of the sign and its surroundings, edge
potentials from how often parent and child are markup together; both are trained from pages labelled sign by
sign, once, before any task runs. Sum-product message passing, upward and
then downward, gives every sign's marginal probability of being markup rather than content.

Defined results: null and empty texts and paths hold nothing; of rows with one sentence_id the one parsed last
counts (ties: the greater text); signs that were torn from their partner by sentence splitting are judged like
any other.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import over_rows, spread

FAMILIES = ("html", "markdown", "wiki", "latex")
# Names of HTML elements.
ELEMENTS = set("a abbr address article aside audio b base blockquote body br button caption cite code col dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li link main mark math meta nav nobr object ol option p param pre q ref s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var video wbr center big nowiki gallery".split())

# Names that programs write between double underscores.
SPECIAL_NAMES = set("init main name file doc all dict class call new del str repr len iter next getitem setitem enter exit eq hash version author slots module".split())

# (family, sign, pattern); where spans overlap the earlier pattern wins unless one encloses the other
SIGNS: list[tuple[str, str, re.Pattern]] = [
    (f, s, re.compile(p, re.S))
    for f, s, p in (
        ("html", "comment", r"<!--.*?(?:-->|$)|-->"),
        ("html", "tag", r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|<!DOCTYPE[^>]*>"),
        ("html", "reference", r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"),
        ("html", "torn tag", r"<[A-Za-z][\w-]*\s[\w-]+=[^<>]*$"),
        ("wiki", "link", r"\[\[[^\[\]]*\]\]|\[\[|\]\](?!\()"),
        ("wiki", "outer link", r"\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]]*)?\]"),
        ("wiki", "template", r"\{\{[^{}]*\}\}|\{\{|\}\}"),
        ("wiki", "table", r"\{\||\|\}|^\|-+"),
        ("wiki", "quotes", r"'{5}|'{3}|'{2}"),
        ("wiki", "heading", r"^\s*(={1,6})[^=\n].*?\1\s*$|^\s*={2,6}\s|\s={2,6}\s*$"),
        ("latex", "math", r"\$\$[^$]+\$\$|\$[^$\n]{1,200}\$|\\\(.*?\\\)|\\\[.*?\\\]"),
        ("latex", "environment", r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
        ("latex", "command", r"\\[A-Za-z]+\*?(?:\[[^\[\]]*\])?(?:\{[^{}]*\})?|\\[,;:!%&_#$]"),
        ("latex", "group", r"\{\\[A-Za-z]+[^{}]*\}"),
        ("latex", "braces", r"\{[^{}]*\}|\{|\}"),
        ("markdown", "task", r"^\s*(?:[-*+]\s+)?\[[ xX]\]\s"),
        ("markdown", "list", r"^\s*(?:[-*+]|\d{1,3}[.)])\s+(?=\S)"),
        ("markdown", "quote", r"^\s*>+\s?"),
        ("markdown", "row", r"^\s*\|.*\||^\s*\|\s|\|\s*$"),
        ("markdown", "heading", r"^\s*#{1,6}\s+(?=\S)"),
        ("markdown", "fence", r"^\s*(?:```|~~~)\S*"),
        ("markdown", "image", r"!\[[^\[\]]*\](?:\([^()]*\)|\[[^\[\]]*\])"),
        ("markdown", "link", r"(?<![!\]])\[[^\[\]^][^\[\]]*\](?:\([^()\s]*(?:\s\"[^\"]*\")?\)|\[[^\[\]]*\])"),
        ("markdown", "footnote", r"\[\^[^\]\s]+\]:?"),
        ("markdown", "brackets", r"(?<!\[)\[[^\[\]^]+\](?![\[(])"),
        ("markdown", "code", r"``.+?``|`[^`]+`|`+"),
        ("markdown", "strike", r"~~[^~]+~~|~~"),
        ("markdown", "tilde", r"(?<!~)~(?!~)"),
        ("markdown", "stars", r"\*{1,3}(?=\S)[^*]*?\S\*{1,3}|\*{1,3}"),
        ("markdown", "unders", r"(?<![^\W_])__?(?=[^\s_])[^_]*?[^\s_]__?(?![^\W_])|__"),
        ("markdown", "escape", r"\\[*_`\[\]{}()#+.!|>~-]"),
        ("markdown", "bar", r"\|"),
        ("markdown", "autolink", r"<(?:https?|mailto)[^<>\s]+>"),
        ("markdown", "hash", r"#"),
        ("html", "angle", r"[<>]"),
        ("html", "ampersand", r"&"),
        ("latex", "dollar", r"\$"),
        ("latex", "caret", r"\^"),
    )
]
SIGN_NAMES = sorted({f"{f} {s}" for f, s, _ in SIGNS})
FLAGS = ("whole", "tight", "starts", "digits", "inner blank", "known name", "in word", "pathlike", "closes only", "math inside", "spaced")
HINTS = re.compile(r"[&<>\[\]{}$*_`~#|\\^=']|^\s*(?:[-+]|\d{1,3}[.)])\s")


class Mark:
    __slots__ = ("start", "end", "family", "sign", "flags", "parent", "marginal")

    def __init__(self, start: int, end: int, family: str, sign: str, flags: tuple[int, ...]):
        self.start, self.end, self.family, self.sign, self.flags = start, end, family, sign, flags
        self.parent, self.marginal = -1, 0.0


def _flags(text: str, start: int, end: int, sign: str) -> tuple[int, ...]:
    own = text[start:end]
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    core = own.strip("*_`~[](){}<>$'=|\\#!^&; ")
    name = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", own)
    known = bool(name and name.group(1).lower() in ELEMENTS) or sign == "reference" and html.unescape(own) != own or sign == "unders" and core in SPECIAL_NAMES
    return (
        int(len(own) > 3 and bool(core)),
        int(not (own[:1].isspace() or own[-1:].isspace()) and (not before.isspace() or not after.isspace())),
        int(not text[:start].strip()),
        int(bool(re.search(r"\d", before + after)) or bool(core) and bool(re.fullmatch(r"[\d.,]+( \w+)* ?", core))),
        int(bool(re.search(r"\s", own.strip()))),
        int(known),
        int((before.isalnum() or before == "_") and (after.isalnum() or after == "_")),
        int(sign in ("command", "escape") and (before in ":\\/" or before.isalnum() and bool(re.search(r"[A-Za-z]:\\?\S*$|\\\S*$", text[:start])))),
        int(len(own.strip()) <= 2 and not core),
        int(bool(re.search(r"[\\=<>^_+]|^\$\\?[A-Za-z]{1,2}\$$", own.strip())) if sign == "math" else 0),
        int(before.isspace() and after.isspace()),
    )


def find_marks(text: str, wanted: set[tuple[int, int]] | None = None) -> list[Mark]:
    """Every sign that may be markup, outermost first, each knowing the index of the one that encloses it.

    A pair of signs whose closing one opens another pair competes with that pair: the better own potential wins,
    in labelled text the pair that is ``wanted``.
    """
    if not HINTS.search(text):
        return []
    taken: list[tuple[int, int]] = []
    marks: list[Mark] = []
    for family, sign, pattern in SIGNS:
        for s, e in _spans(text, family, sign, pattern, wanted):
            if any(s < b and a < e and not (a <= s and e <= b and (a, b) != (s, e) and b - a > e - s + 1 and sign in NESTED) and not (s < a and b < e and sign in OUTER) for a, b in taken):
                continue
            taken.append((s, e))
            marks.append(Mark(s, e, family, sign, _flags(text, s, e, sign)))
    marks.sort(key=lambda x: (x.start, -x.end))
    stack: list[int] = []
    for i, x in enumerate(marks):
        while stack and marks[stack[-1]].end < x.end:
            stack.pop()
        x.parent = stack[-1] if stack else -1
        stack.append(i)
    return marks


def _spans(text: str, family: str, sign: str, pattern: re.Pattern, wanted: set[tuple[int, int]] | None) -> Iterator[tuple[int, int]]:
    at = 0
    while m := pattern.search(text, at):
        s, e = m.span()
        at = max(e, s + 1)
        if s == e:
            continue
        if sign in RIVALS and (closer := RIVALS[sign].search(m.group())):
            other = pattern.match(text, s + closer.start())
            if other and other.end() > e and RIVALS[sign].search(other.group()):
                kind = f"{family} {sign}"
                if other.span() in wanted if wanted is not None else _own_potential(kind, _flags(text, *other.span(), sign)) > _own_potential(kind, _flags(text, s, e, sign)):
                    at = s + closer.start()
                    continue
        yield s, e


# signs that come in pairs of equals, and how the closing one is found
RIVALS = {"math": re.compile(r"(?<=[^$])\$$"), "stars": re.compile(r"(?<=[^*])\*{1,3}$"), "unders": re.compile(r"(?<=[^_])__?$"), "code": re.compile(r"(?<=[^`])`$"), "strike": re.compile(r"(?<=[^~])~~$")}
# signs that may lie inside others, and signs that may enclose others
NESTED = {"reference", "tag", "stars", "unders", "code", "link", "command", "quotes", "template", "math"}
OUTER = {"link", "image", "stars", "unders", "quotes", "heading", "row", "strike", "command", "braces"}


Model = tuple[np.ndarray, np.ndarray, np.ndarray]
LABELLED = re.compile(r"⟦(\w+):(.*?)⟧", re.S)
EDGE_SCALES = (0.0, 0.1, 0.3, 1.0)
FOLDS = 4


def labelled_signs() -> list[tuple[list[Mark], list[int]]]:
    """(signs, whether each is markup) of every labelled line; lines label each sign by the regions set in brackets, or all of them."""
    from .markup_pages import MIXED, PAGES

    out = []
    for families, text in PAGES:
        marks = find_marks(text, set())
        out.append((marks, [int(x.family in families) for x in marks]))
    for text in MIXED:
        plain, regions, at = "", [], 0
        for m in LABELLED.finditer(text):
            plain += text[at : m.start()]
            regions.append((len(plain), len(plain) + len(m.group(2)), m.group(1)))
            plain, at = plain + m.group(2), m.end()
        plain += text[at:]
        marks = find_marks(plain, {(a, b) for a, b, _ in regions})
        out.append((marks, [int(any(a <= x.start and x.end <= b and f == x.family for a, b, f in regions)) for x in marks]))
    return out


def fit(lines: list[tuple[list[Mark], list[int]]]) -> Model:
    """(sign biases, flag weights by sign, edge log-potentials) from labelled lines."""
    at = {n: i for i, n in enumerate(SIGN_NAMES)}
    edges = np.ones((2, 2))
    for marks, labels in lines:
        for x, y in zip(marks, labels):
            edges[labels[x.parent] if x.parent >= 0 else int(any(labels)), y] += 1
    x = np.array([m.flags for marks, _ in lines for m in marks], float)
    k = np.array([at[f"{m.family} {m.sign}"] for marks, _ in lines for m in marks])
    y = np.array([y for _, labels in lines for y in labels], float)
    bias, weights, shared = np.zeros(len(SIGN_NAMES)), np.zeros((len(SIGN_NAMES), len(FLAGS))), np.zeros(len(FLAGS))
    for _ in range(1500):
        z = bias[k] + (weights[k] * x).sum(axis=1) + x @ shared
        gap = y - 1 / (1 + np.exp(-z))
        gb, gw = np.zeros_like(bias), np.zeros_like(weights)
        np.add.at(gb, k, gap)
        np.add.at(gw, k, gap[:, None] * x)
        bias += 0.3 * (gb - 0.01 * bias)
        weights += 0.3 * (gw - 0.02 * weights)
        shared += 0.003 * (gap @ x)
    return bias, weights + shared, np.log(edges / edges.sum(axis=1, keepdims=True) / (edges.sum(axis=0) / edges.sum()))


def held_out(scale: float, lines: list[tuple[list[Mark], list[int]]] | None = None) -> tuple[float, float]:
    """(mean log-likelihood, share right) of signs of lines that the model was not fitted on, each fold left out once."""
    lines = lines or labelled_signs()
    total, right, n = 0.0, 0, 0
    for fold in range(FOLDS):
        bias, weights, edge = fit([x for i, x in enumerate(lines) if i % FOLDS != fold])
        known = (bias, weights, scale * edge)
        for marks, labels in (x for i, x in enumerate(lines) if i % FOLDS == fold):
            infer([marks], known)
            for x, y in zip(marks, labels):
                total += math.log(max(1e-9, x.marginal if y else 1 - x.marginal))
                right += int((x.marginal > 0.5) == bool(y))
                n += 1
    return total / max(1, n), right / max(1, n)


_model: Model | None = None


def model() -> Model:
    """The model fitted from all labelled pages, its edges weighted by what lines left out say."""
    global _model
    if _model is None:
        lines = labelled_signs()
        bias, weights, edge = fit(lines)
        scale = max(EDGE_SCALES, key=lambda x: held_out(x, lines)[0])
        use_model((bias, weights, scale * edge))
    return _model


def use_model(known: Model) -> None:
    """Takes a model that was fitted elsewhere, so that tasks need not fit it again."""
    global _model
    if _model is not known:
        _model = known
        _own_potential.cache_clear()


@lru_cache(maxsize=200_000)
def _own_potential(kind: str, flags: tuple[int, ...]) -> float:
    return _potential(model(), kind, flags)


def _potential(known: Model, kind: str, flags: tuple[int, ...]) -> float:
    i = SIGN_NAMES.index(kind)
    return float(known[0][i] + known[1][i] @ np.array(flags, float))


def infer(segments: list[list[Mark]], known: Model | None = None) -> None:
    """Sum-product over the tree of one sentence: root, segments, marks. Fills in the marginals.

    The root ties the text to its headings by the same edge potentials, so that markup in one makes it
    likelier in the others.
    """
    if not any(segments):
        return
    edge = (known or model())[2]
    parents, own = [-1], [(0.0, 0.0)]
    nodes: list[Mark | None] = [None]
    for marks in segments:
        seg = len(parents)
        parents.append(0)
        own.append((0.0, 0.0))
        nodes.append(None)
        first = len(parents)
        for x in marks:
            parents.append(seg if x.parent < 0 else first + x.parent)
            kind = f"{x.family} {x.sign}"
            own.append((0.0, _potential(known, kind, x.flags) if known else _own_potential(kind, x.flags)))
            nodes.append(x)
    n = len(parents)
    up = [[0.0, 0.0] for _ in range(n)]  # message to the parent
    inside = [list(o) for o in own]
    for i in range(n - 1, 0, -1):  # children come after their parents
        for p in (0, 1):
            up[i][p] = _logsum(edge[p][0] + inside[i][0], edge[p][1] + inside[i][1])
            inside[parents[i]][p] += up[i][p]
    belief = [None] * n
    belief[0] = inside[0]
    for i in range(1, n):
        rest = [belief[parents[i]][p] - up[i][p] for p in (0, 1)]
        down = [_logsum(rest[0] + edge[0][c], rest[1] + edge[1][c]) for c in (0, 1)]
        belief[i] = [inside[i][c] + down[c] for c in (0, 1)]
        if nodes[i] is not None:
            d = belief[i][0] - belief[i][1]
            nodes[i].marginal = 1 / (1 + math.exp(min(d, 700)))


def _logsum(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def judge(text: str | None, path: list[str] | None = None) -> list[list[Mark]]:
    """The marks of a text and of each step of its path, with marginals."""
    segments = [find_marks(t) if t else [] for t in [text, *(path or [])]]
    infer(segments)
    return segments


def families_in(text: str | None, path: list[str] | None, least: float = 0.5) -> list[str]:
    found = {x.family for marks in judge(text, path) for x in marks if x.marginal > least}
    return [f for f in FAMILIES if f in found]


# What in a wiki file link says how it is set, and is no caption.
FILE_SETTINGS = re.compile(r"(?:thumb(?:nail)?|frame(?:d|less)?|border|left|right|cent(?:er|re)|none|upright|baseline|middle|top|bottom|\d*x?\d+px|(?:alt|link|class|lang|page)=.*)$", re.I)
HEADING_COMMANDS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph")
KEY_COMMANDS = ("label", "ref", "eqref", "pageref", "cite", "citep", "citet", "begin", "end", "documentclass", "usepackage", "includegraphics", "input", "bibliography")


class _Cleaner:
    """Renders the tree of a text: markup is removed, what it holds is cleaned in turn."""

    def __init__(self, text: str, marks: list[Mark], least: float):
        self.text, self.block = text, "text"
        self.codes: list[str] = []
        self.formulas: list[str] = []
        held = [i for i, x in enumerate(marks) if x.marginal > least]
        self.children: dict[int, list[Mark]] = {}
        self.number = {id(marks[i]): i for i in held}
        kept = set(held)
        for i in held:
            up = marks[i].parent
            while up >= 0 and up not in kept:
                up = marks[up].parent
            self.children.setdefault(up, []).append(marks[i])

    def render(self, start: int, end: int, owner: int = -1) -> str:
        """The text from start to end with the marks in it, those below ``owner``, rendered."""
        out, at = [], start
        for x in self.children.get(owner, ()):
            if at <= x.start and x.end <= end:
                out += [self.text[at : x.start], self.put(x)]
                at = x.end
        return "".join([*out, self.text[at:end]])

    def inner(self, x: Mark, lead: int, tail: int) -> str:
        return self.render(x.start + lead, max(x.start + lead, x.end - tail), self.number[id(x)])

    def put(self, x: Mark) -> str:
        own = self.text[x.start : x.end]
        kind = f"{x.family} {x.sign}"
        if x.sign in ("list", "task", "quote"):
            self.block = "quote" if x.sign == "quote" else "list item"
            return ""
        if x.sign == "row":
            self.block = "row"
            return " ".join(self.inner(x, 0, 0).replace("|", " ").split())
        if x.sign == "heading":
            self.block = "heading"
            lead = re.match(r"\s*[#=]*\s*", own).end()
            tail = len(own) - len(re.sub(r"\s*=+\s*$", "", own)) if x.family == "wiki" else 0
            return self.inner(x, lead, tail) if lead + tail <= len(own) else ""
        if x.sign == "code":
            inner = own.strip("` ")
            if inner:
                self.codes.append(inner)
            return inner
        if x.sign == "math":
            self.formulas.append(own)
            return own
        if kind == "html reference":
            return html.unescape(own)
        if x.sign == "tag":
            name = re.match(r"</?([A-Za-z][A-Za-z0-9]*)|<!", own).group(1) or ""
            self.block = "heading" if re.fullmatch("h[1-6]", name.lower()) else "list item" if name.lower() == "li" else self.block
            return "\n" if name.lower() == "br" else ""
        if x.sign == "command":
            return self.command(x, own)
        if x.sign == "group":
            return self.inner(x, re.match(r"\{\\[A-Za-z]+\s*", own).end(), 1)
        if x.sign == "braces":
            return self.inner(x, 1, 1) if len(own) > 1 else ""
        if x.sign in ("stars", "unders", "strike", "quotes"):
            lead, tail = len(own) - len(own.lstrip("*_~'")), len(own) - len(own.rstrip("*_~'"))
            return self.inner(x, lead, tail) if lead < len(own) else ""
        if kind in ("markdown link", "markdown image"):
            m = re.match(r"!?\[([^\[\]]*)\]", own)
            return self.inner(x, m.start(1), len(own) - m.end(1))
        if x.sign == "brackets":
            return self.inner(x, 1, 1)
        if kind == "wiki link":
            return self.wiki_link(x, own)
        if x.sign == "outer link":
            m = re.search(r"\s", own)
            return self.inner(x, m.end(), 1) if m else ""
        if x.sign == "template":
            # what a template is given without a name is content: {{small|Anna}}, but not {{cn}} or |date=June
            parts = [p.strip() for p in self.inner(x, 2, 2).split("|")[1:]] if len(own) > 2 else []
            return " ".join(p for p in parts if p and not re.match(r"[\w\- ]+=", p))
        if x.sign == "escape":
            return own[1:]
        return own[1:-1] if x.sign == "autolink" else ""

    def command(self, x: Mark, own: str) -> str:
        head = re.match(r"\\([A-Za-z]*)", own).group(1)
        if not head:
            return " " if own in ("\\,", "\\;", "\\:") else "" if own == "\\!" else own[1:]
        if head in HEADING_COMMANDS:
            self.block = "heading"
        elif head == "item":
            self.block = "list item"
        m = re.search(r"\{([^{}]*)\}$", own)
        if head in KEY_COMMANDS or not m:
            return {"ldots": "…", "dots": "…"}.get(head, "")
        inner = self.inner(x, m.start(1), 1)
        return {"ldots": "…", "dots": "…"}.get(head, "") + inner if head != "footnote" else f" ({inner})"

    def wiki_link(self, x: Mark, own: str) -> str:
        if len(own) <= 2 or re.match(r"\[\[\s*Category:", own, re.I):
            return ""
        parts = self.inner(x, 2, 2).split("|")
        if re.match(r"\s*(?:File|Image):", parts[0], re.I):
            captions = [p.strip() for p in parts[1:] if p.strip() and not FILE_SETTINGS.match(p.strip())]
            return captions[-1] if captions else ""
        return parts[-1]


def clean(text: str | None, marks: list[Mark], least: float = 0.5) -> tuple[str, str, list[str], list[str]]:
    """(clean text, block, code pieces, formulas): markup removed, headings, lists, code and formulas kept as such.

    What markup holds is kept: link texts, captions, footnotes, what templates and commands are given.
    """
    if not text:
        return text or "", "text", [], []
    c = _Cleaner(text, marks, least)
    out = c.render(0, len(text))
    return re.sub(r"[ \t]{2,}", " ", out).strip(), c.block, c.codes, c.formulas


def _latest(sentences: DataFrame) -> DataFrame:
    rows = sentences.select("sentence_id", "text", "heading_path", "parsed_at")
    newest = F.max_by(F.struct("text", "heading_path"), F.struct("parsed_at", "text"))
    return rows.groupBy("sentence_id").agg(newest.alias("s")).select("sentence_id", "s.text", "s.heading_path")


def markup_found(sentences: DataFrame) -> DataFrame:
    """(sentence_id, markup): one row for each family of markup that a sentence or its heading path holds."""

    known = model()

    def rows(c: dict[str, list]) -> Iterable[tuple]:
        use_model(known)
        for sid, text, path in zip(c["sentence_id"], c["text"], c["heading_path"]):
            for family in families_in(text, path):
                yield sid, family

    return over_rows(spread(_latest(sentences)), "sentence_id string, markup string", rows)


def clean_sentences(sentences: DataFrame) -> DataFrame:
    """(sentence_id, clean_text, block, codes, formulas, clean_path) of every sentence."""
    schema = "sentence_id string, clean_text string, block string, codes array<string>, formulas array<string>, clean_path array<string>"

    known = model()

    def rows(c: dict[str, list]) -> Iterable[tuple]:
        use_model(known)
        for sid, text, path in zip(c["sentence_id"], c["text"], c["heading_path"]):
            segments = judge(text, path)
            body, block, codes, formulas = clean(text, segments[0])
            steps = [clean(p, m)[0] for p, m in zip(path or [], segments[1:])]
            yield sid, body if text is not None else None, block, codes, formulas, steps

    return over_rows(spread(_latest(sentences)), schema, rows)


def region_kinds(regions: DataFrame, docs: DataFrame) -> DataFrame:
    """Masked regions with one spelling of each kind and with the end of the text for those never closed."""
    # fixed values: how the kinds are named
    kind = F.lower(F.trim(F.col("kind")))
    named = F.when(kind.isin("code", "fence", "fenced"), "fence").when(kind.isin("table", "math", "comment", "frontmatter"), kind)
    ends = docs.select(F.col("document_id").alias("of"), F.length("text").alias("n_text"))
    return (
        regions.select("document_id", "region_no", "start_char", "end_char", named.alias("region_kind")).distinct()
        .join(ends, F.col("document_id") == F.col("of"), "left")
        .select("document_id", "region_no", "start_char", F.coalesce("end_char", "n_text").cast("int").alias("end_char"), F.coalesce("region_kind", F.lit("unknown")).alias("region_kind"))
    )
