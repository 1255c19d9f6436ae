"""The ontology: kinds of name, legal links between them and listed names, as checked dimension tables.

The limits below bound every dimension table but the gazetteer, whose size is checked where it is
broadcast; a gazetteer may also be an ordinary DataFrame of any size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits and labels of the data model.
MOST_OPTIONS, MOST_TYPES, MOST_EDGES = 26, 50, 100
NOT_ENTITY, NO_RELATION = "NOT_ENTITY", "NONE"
NOT_ENTITY_TEXT = "Not a named entity of this ontology, or a pronoun, or noise."
DEFAULT_COLOR, UNKNOWN_COLOR = "#64748b", "#94a3b8"


def group_of(kind_no: Column, room: int = MOST_OPTIONS - 1) -> Column:
    """The group of a kind when there are too many kinds for one question."""
    return F.floor(kind_no / room).cast("int")


class OntologyError(ValueError):
    """The ontology breaks one of its rules."""


def as_id(text: str) -> str:
    return str(text).strip().upper().replace(" ", "_")


@dataclass(frozen=True)
class Kind:
    id: str
    description: str
    aliases: tuple[str, ...] = ()
    color: str = DEFAULT_COLOR


@dataclass(frozen=True)
class Link:
    id: str
    description: str
    domain: tuple[str, ...]
    range: tuple[str, ...]
    symmetric: bool = False


@dataclass(frozen=True)
class Ontology:
    id: str
    kinds: tuple[Kind, ...]
    links: tuple[Link, ...]
    listed: dict[str, str] = field(default_factory=dict)
    version: int = 1
    title: str = ""

    def __post_init__(self) -> None:
        problems = list(self.problems())
        if problems:
            raise OntologyError("; ".join(problems))

    def problems(self):
        """What is wrong with the ontology, in plain words."""
        ids = [k.id for k in self.kinds]
        if not 2 <= len(ids) <= MOST_TYPES:
            yield f"an ontology has 2 to {MOST_TYPES} kinds of name, this one {len(ids)}"
        for what, names in (("kinds", ids), ("links", [x.id for x in self.links])):
            twice = sorted({n for n in names if names.count(n) > 1})
            if twice:
                yield f"{what} with one id: {', '.join(twice)}"
        for kind in self.kinds:
            if not kind.id or not kind.id.replace("_", "").isalnum():
                yield f"bad kind id {kind.id!r}"
        for link in self.links:
            for side, names in (("starts from", link.domain), ("points at", link.range)):
                for name in names:
                    if name not in ids:
                        yield f"{link.id} {side} {name}, which is no kind"
        edges = sum(len(x.domain) * len(x.range) for x in self.links)
        if edges > MOST_EDGES:
            yield f"{edges} kind-to-kind pairs, more than {MOST_EDGES}"
        for name, kind in self.listed.items():
            if kind not in ids:
                yield f"listed name {name!r} is a {kind}, which is no kind"

    @cached_property
    def signatures(self) -> list[tuple[str, str, str, int]]:
        """(source kind, target kind, link, order) of every legal edge; symmetric links hold both ways."""
        found: dict[tuple[str, str, str], int] = {}
        for order, link in enumerate(self.links):
            for a in link.domain:
                for b in link.range:
                    found.setdefault((a, b, link.id), order)
                    if link.symmetric:
                        found.setdefault((b, a, link.id), order)
        return [(*k, v) for k, v in found.items()]

    def needs_groups(self) -> bool:
        return len(self.kinds) + 1 > MOST_OPTIONS

    def groups(self) -> list[tuple[Kind, ...]]:
        room = MOST_OPTIONS - 1
        return [self.kinds[i : i + room] for i in range(0, len(self.kinds), room)]

    def color_of(self, kind: str) -> str:
        return next((k.color for k in self.kinds if k.id == kind), UNKNOWN_COLOR)

    def describe(self) -> dict[str, Any]:
        by_pair = sorted(self.signatures, key=lambda s: ([k.id for k in self.kinds].index(s[0]), [k.id for k in self.kinds].index(s[1]), s[3]))
        return {
            "id": self.id, "title": self.title or self.id, "types": [{"id": k.id, "description": k.description} for k in self.kinds],
            "relations": [{"id": x.id, "description": x.description, "domain": list(x.domain), "range": list(x.range)} for x in self.links],
            "legal_pairs": [f"{a} -[{r}]-> {b}" for a, b, r, _ in by_pair], "listed_names": len(self.listed),
        }

    # dimension tables

    def kind_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, k.id, k.description, list(k.aliases), k.color, k.id.lower(), i // (MOST_OPTIONS - 1)) for i, k in enumerate(self.kinds)]
        return spark.createDataFrame(rows, "ord int, id string, description string, aliases array<string>, color string, encoder_label string, group_no int")

    def link_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, x.id, x.description, list(x.domain), list(x.range), x.symmetric) for i, x in enumerate(self.links)]
        return spark.createDataFrame(rows, "ord int, id string, description string, domain array<string>, range array<string>, symmetric boolean")

    def signature_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.signatures, "src_type string, tgt_type string, relation string, ord int")

    def gazetteer(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(self.listed.items())], "name string, type string, ord int")

    def options(self, spark: SparkSession, null_label: bool = True, grouped: bool = False) -> DataFrame:
        """The options of the kind question in order: kinds, or groups of kinds, and the null label last."""
        if grouped:
            rows = [(f"GROUP_{i}", ", ".join(k.id for k in g)) for i, g in enumerate(self.groups())]
        else:
            rows = [(k.id, k.description) for k in self.kinds]
        if null_label:
            rows.append((NOT_ENTITY, NOT_ENTITY_TEXT))
        if not 2 <= len(rows) <= MOST_OPTIONS:
            raise OntologyError(f"a question has 2 to {MOST_OPTIONS} options, this one {len(rows)}")
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, label string, description string")


def from_dict(data: dict[str, Any]) -> Ontology:
    """An ontology from the shape of its YAML files; a kind may be a bare name."""
    kinds = []
    for item in data.get("types") or []:
        if isinstance(item, str):
            item = {"id": item, "description": item.replace("_", " ").title()}
        kinds.append(Kind(as_id(item["id"]), item["description"], tuple(item.get("aliases") or ()), item.get("color") or DEFAULT_COLOR))
    links = [
        Link(as_id(x["id"]), x["description"], tuple(map(as_id, x["domain"])), tuple(map(as_id, x["range"])), bool(x.get("symmetric", False)))
        for x in data.get("relations") or []
    ]
    listed = {str(n).strip(): as_id(k) for n, k in (data.get("gazetteer") or {}).items()}
    return Ontology(str(data.get("id") or "unnamed"), tuple(kinds), tuple(links), listed, int(data.get("version") or 1), str(data.get("title") or ""))


def bundled_names() -> list[str]:
    return sorted(p.stem for p in (Path(__file__).parent / "ontologies").glob("*.yaml"))


def load(name_or_path: str | Path) -> Ontology:
    """A bundled ontology by name, or one of the user's from a YAML file."""
    path = Path(name_or_path)
    if not path.exists():
        path = Path(__file__).parent / "ontologies" / f"{name_or_path}.yaml"
    if not path.exists():
        raise FileNotFoundError(f"no ontology {str(name_or_path)!r}; there are {', '.join(bundled_names())}, or give the path of a YAML file")
    try:
        import yaml
    except ImportError:
        data = read_simple_yaml(path.read_text(encoding="utf-8"))
    else:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise OntologyError("an ontology file holds a mapping")
    return from_dict(data)


def read_simple_yaml(text: str) -> dict[str, Any]:
    """The part of YAML that ontology files use: nested maps, lists of maps, flow lists and plain scalars."""
    rows = []
    for raw in text.splitlines():
        bare = re.sub(r"(^|\s)#(?![0-9a-fA-F]{6}).*$", "", raw) if '"' not in raw else raw
        if bare.strip():
            rows.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def scalar(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
            return s[1:-1]
        if s in ("true", "false"):
            return s == "true"
        return int(s) if re.fullmatch(r"-?\d+", s) else None if s in ("", "null", "~") else s

    def block(i: int, depth: int):
        if i < len(rows) and rows[i][1].startswith("- "):
            items = []
            while i < len(rows) and rows[i][0] == depth and rows[i][1].startswith("- "):
                inner = rows[i][1][2:]
                if re.match(r"[^\"'\[]+?:(\s|$)", inner):
                    rows[i] = (depth + 2, inner)
                    value, i = block(i, depth + 2)
                else:
                    value, i = scalar(inner), i + 1
                items.append(value)
            return items, i
        found: dict[str, Any] = {}
        while i < len(rows) and rows[i][0] == depth and not rows[i][1].startswith("- "):
            key, _, rest = rows[i][1].partition(":")
            if rest.strip():
                found[key.strip().strip("\"'")], i = scalar(rest), i + 1
            elif i + 1 < len(rows) and rows[i + 1][0] > depth:
                found[key.strip().strip("\"'")], i = block(i + 1, rows[i + 1][0])
            else:
                found[key.strip().strip("\"'")], i = None, i + 1
        return found, i

    return block(0, rows[0][0])[0] if rows else {}


STARTER = """id: mine
version: 1
title: Mine
types:
  - id: PERSON
    description: Somebody with a name.
  - id: ORGANIZATION
    description: A group of people with a name.
relations:
  - id: WORKS_AT
    description: The person has a job in the organization.
    domain: [PERSON]
    range: [ORGANIZATION]
gazetteer: {}
"""


def write_starter(path: str | Path) -> Path:
    """A small ontology to begin with; an existing file is never overwritten."""
    out = Path(path)
    if out.exists():
        raise FileExistsError(f"{out} is there already")
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(STARTER, encoding="utf-8")
    return out


def add_listed(ontology: Ontology, name: str, kind: str) -> Ontology:
    """The ontology with one more listed name."""
    return Ontology(ontology.id, ontology.kinds, ontology.links, {**ontology.listed, name.strip(): as_id(kind)}, ontology.version, ontology.title)
