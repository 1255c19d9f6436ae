"""Schema drift between the files of a feed: a report of every change and one consistent table.

Method: each file's fields are profiled (types, counts, a bottom-k sketch of value hashes); files are
compared with the one before them in their feed; fields that end and fields of the same type that
begin under the same parent are matched by a maximum-weight bipartite assignment over name and
value-sketch similarity (a match is always made where one is possible, the weights only choose
among partners); matched columns are then unified under their newest name, in rows that keep their place
in every array and give one typed table for each kind of element (``element_table``). Each JSON is read once
for the report and once for the table.

Defined results: unreadable, null and empty records do not count, a file without readable records is
no file; the first file of a feed has no changes; a field with values of several types in one file
has the type most of its values have (ties: the smaller name); empty tables give no changes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_walk import KINDS, MISSING, OBJECTS, as_elements, element_rows, opened, own_fields, read_json, safe, typed_fields
from ..session import collect_bounded, cut_lineage, over_rows, spread
from .nested import SCHEMA_PATHS_MOST, array_schema

MAP_FIELDS, ENTRIES = frozenset({"answers", "probabilities", "legend"}), frozenset({"answers"})
SKETCH_SIZE = 16
CHANGE_SCHEMA = "feed string, file_no int, change string, field string, new_field string"


def _hash(value) -> int:
    return int.from_bytes(hashlib.blake2b(repr(value).encode("utf-8", "replace"), digest_size=7).digest(), "big")


PART = "feed string, file_no int, path string, type string, n long, sketch array<long>"


def profile_files(df: DataFrame, json_col: str) -> DataFrame:
    """(feed, file_no, path, type, n, sketch) for each field of each file; summed in each task before the shuffle."""

    def rows(cols: dict[str, list]) -> Iterable[tuple]:
        seen: dict[tuple, list] = defaultdict(lambda: [0, set()])
        for feed, no, text in zip(cols["feed"], cols["file_no"], cols["body"]):
            value = read_json(text)
            if value is MISSING:
                continue
            seen[feed, no, "", "file"][0] += 1
            for path, kind, scalar in typed_fields(value, MAP_FIELDS):
                at = seen[feed, no, path, kind]
                at[0] += 1
                if scalar is not None:
                    at[1].add(_hash(scalar))
                    if len(at[1]) > 8 * SKETCH_SIZE:
                        at[1] = set(sorted(at[1])[:SKETCH_SIZE])
        for (feed, no, path, kind), (n, sketch) in seen.items():
            yield feed, no, safe(path), kind, n, sorted(sketch)[:SKETCH_SIZE]

    records = df.select("feed", F.col("file_no").cast("int").alias("file_no"), F.col(json_col).alias("body"))
    by_type = cut_lineage(_merged(over_rows(spread(records), PART, rows)))
    arrays = frozenset(r.path for r in collect_bounded(by_type.where(F.col("type") == OBJECTS).select("path").distinct(), SCHEMA_PATHS_MOST, "paths of arrays"))
    while (more := frozenset(as_elements(p, arrays) for p in arrays) | arrays) != arrays:
        arrays = more

    def elements(cols: dict[str, list]) -> Iterable[tuple]:
        for feed, no, path, kind, n, sketch in zip(*cols.values()):
            path = as_elements(path, arrays)
            yield feed, no, path, "array" if kind == "object" and path in arrays else kind, n, sketch

    by_type = _merged(over_rows(by_type.where(F.col("type") != OBJECTS), PART, elements))
    main = F.min_by(F.struct("type", "sketch"), F.struct(-F.col("n"), F.col("type")))
    return by_type.groupBy("feed", "file_no", "path").agg(main.alias("m"), F.sum("n").alias("n")).select("feed", "file_no", "path", "m.type", "n", "m.sketch")


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each feed, file, path and type, with the k smallest of all hashes: first of every few parts, so that no file gathers all its sketches in one row."""
    keys = ("feed", "file_no", "path", "type")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH_SIZE)
    few = parts.withColumn("_few", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy(*keys, "_few").agg(F.sum("n").alias("n"), least.alias("sketch"))
    return few.groupBy(*keys).agg(F.sum("n").alias("n"), least.alias("sketch"))


def _grams(name: str) -> set[str]:
    text = f"^{name.lower()}$"
    return {text[i : i + 2] for i in range(len(text) - 1)}


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def best_assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """A maximum-weight assignment of rows to columns covering min(rows, columns) (Hungarian method)."""
    n, m = len(weights), len(weights[0]) if weights else 0
    if n > m:
        return [(r, c) for c, r in best_assignment([list(col) for col in zip(*weights)])]
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -weights[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], back[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def parent_of(path: str) -> str:
    return path.rpartition(".")[0]


def _beneath(path: str, tops: set[str]) -> bool:
    while "." in path:
        path = parent_of(path)
        if path in tops or path.rstrip("[]") in tops:
            return True
    return False


def compare(ended: list[tuple], began: list[tuple], retyped: list[str]) -> list[tuple[str, str, str]]:
    """(change, field, new_field) between two files. ended/began: (path, type, sketch)."""
    out = [("retyped", p, "") for p in retyped]
    tops = {p for p, *_ in ended} | {p for p, *_ in began} | set(retyped)
    ended = [x for x in ended if not _beneath(x[0], tops)]
    began = [x for x in began if not _beneath(x[0], tops)]
    out = [x for x in out if not _beneath(x[1], tops - {x[1]})]
    groups: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    for side, fields in enumerate((ended, began)):
        for path, kind, sketch in sorted(fields, key=lambda x: x[0]):
            groups[parent_of(path), kind][side].append((path, set(sketch if sketch is not None else ())))
    for old, new in groups.values():
        pairs = []
        if old and new:
            likeness = [[_jaccard(_grams(a.rpartition(".")[2]), _grams(b.rpartition(".")[2])) + _jaccard(s, t) for b, t in new] for a, s in old]
            pairs = best_assignment(likeness)
        out += [("renamed", old[i][0], new[j][0]) for i, j in pairs]
        out += [("removed", p, "") for i, (p, _) in enumerate(old) if i not in {i for i, _ in pairs}]
        out += [("added", p, "") for j, (p, _) in enumerate(new) if j not in {j for _, j in pairs}]
    return out


def changes(profiles: DataFrame) -> DataFrame:
    """The change report. Only the few fields that differ between neighbouring files meet in one group."""
    files = profiles.select("feed", "file_no").distinct()
    order = Window.partitionBy("feed").orderBy("file_no")
    step = files.select("feed", "file_no", F.lag("file_no").over(order).alias("before"), F.lead("file_no").over(order).alias("after"))
    fields = profiles.where(F.col("path") != "").join(step, ["feed", "file_no"])
    now = fields.where(F.col("before").isNotNull()).select("feed", "file_no", "path", F.col("type").alias("t1"), F.col("sketch").alias("s1"))
    old = fields.where(F.col("after").isNotNull()).select("feed", F.col("after").alias("file_no"), "path", F.col("type").alias("t0"), F.col("sketch").alias("s0"))
    differ = now.join(old, ["feed", "file_no", "path"], "full_outer").where(~F.col("t0").eqNullSafe(F.col("t1")))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        ended = [(r.path, r.t0, r.s0) for r in pdf.itertuples() if pd.isna(r.t1)]
        began = [(r.path, r.t1, r.s1) for r in pdf.itertuples() if pd.isna(r.t0)]
        retyped = sorted(r.path for r in pdf.itertuples() if not pd.isna(r.t0) and not pd.isna(r.t1))
        rows = [(pdf.feed.iloc[0], pdf.file_no.iloc[0], *x) for x in compare(ended, began, retyped)]
        return pd.DataFrame(rows, columns=["feed", "file_no", "change", "field", "new_field"])

    return differ.groupBy("feed", "file_no").applyInPandas(match, CHANGE_SCHEMA)


def drift_report(df: DataFrame, json_col: str) -> DataFrame:
    """All changes between neighbouring files of each feed of a table with feed, file_no and a JSON column."""
    return changes(profile_files(df, json_col))


NEWEST = "feed string, file_no int, old array<string>, newest array<string>"


def newest_names(files: DataFrame, report: DataFrame) -> DataFrame:
    """(feed, file_no, old, newest): for each file the fields of it that are renamed later, and what they are called in the end.

    ``files`` has feed and file_no. A feed is walked backwards from its last file; what meets there is one row a
    file and one a rename, not the records.
    """
    steps = report.where(F.col("change") == "renamed").select("feed", "file_no", F.col("field").alias("old"), F.col("new_field").alias("new"))
    rows = files.select("feed", "file_no", F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")).distinct().unionByName(steps)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, str] = {}
        out = []
        for no, part in sorted(pdf.groupby("file_no"), key=lambda x: -x[0]):
            if known and part["old"].isna().any():
                out.append((pdf.feed.iloc[0], no, list(known), list(known.values())))
            renamed = {r.old: newest(r.new, known) for r in part.itertuples() if not pd.isna(r.old)}
            known = {k: v for k, v in known.items() if k not in renamed.values()} | renamed
        return pd.DataFrame(out, columns=["feed", "file_no", "old", "newest"])

    return rows.groupBy("feed").applyInPandas(walk, NEWEST)


def newest(path: str, known: dict[str, str]) -> str:
    """A field under its newest name: its own, or that of the nearest field above it which has one."""
    at = path
    while at:
        if at in known:
            return known[at] + path[len(at) :]
        if at.endswith("[]"):
            at = at[:-2]
        else:
            at = at.rpartition(".")[0]
    return path


UNIFIED = "feed string, file_no int, record string, place string, ordinals array<int>, map_key string, fields map<string,string>, kinds map<string,string>"


def unified(df: DataFrame, json_col: str, report: DataFrame, record: list[str]) -> DataFrame:
    """``UNIFIED``: every record's root, elements of arrays and entries of maps as rows, under the newest names their feed has.

    ``record`` names the columns that tell records apart within a file; rows that repeat each other count once.
    ``place`` is where a row stands (``entities[]``, ``answers.*``, '' for the root), ``ordinals`` its index at each
    level above it, so that its parent is the row with one ordinal less; ``map_key`` its key in a map.
    """
    arrays = array_schema(df, json_col, MAP_FIELDS)
    while (more := frozenset(as_elements(p, arrays) for p in arrays) | arrays) != arrays:
        arrays = more
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in record])
    rows = df.select("feed", F.col("file_no").cast("int").alias("file_no"), key.alias("record"), F.col(json_col).alias("body")).where(F.col("body") != "").distinct()
    names = newest_names(rows.select("feed", "file_no").distinct(), report)
    rows = rows.alias("r").join(names.alias("n"), F.col("r.feed").eqNullSafe(F.col("n.feed")) & (F.col("r.file_no") == F.col("n.file_no")), "left").select("r.*", "old", "newest")

    def elements(cols: dict[str, list]) -> Iterable[tuple]:
        for feed, no, record, text, old, new in zip(*(cols[c] for c in ("feed", "file_no", "record", "body", "old", "newest"))):
            value = read_json(text)
            value = opened(value) if value is not MISSING else None
            if value is None:
                continue
            known = dict(zip(old or (), new or ()))
            root = value if isinstance(value, dict) else {} if isinstance(value, list) and "" in arrays else {"value": value}
            for place, at, map_key, obj in (("", (), None, root), *((p, o, k, x) for p, _, _, o, k, x in element_rows(value, arrays, ENTRIES))):
                fields = own_fields(obj, arrays, place, ENTRIES, MAP_FIELDS)
                # a field's newest name is looked up by its whole path, then cut at the row's own place
                here = newest(place, known) if place else ""
                named = {}
                for f, v in fields.items():
                    full = newest(f"{place}.{f}" if place else f, known)
                    named[full[len(here) + 1 :] if here and full.startswith(here + ".") else full] = v
                yield feed, no, record, safe(here), list(at), safe(map_key) if map_key is not None else None, [(safe(k), v) for k, (_, v) in named.items()], [(safe(k), t) for k, (t, _) in named.items()]

    return over_rows(spread(rows), UNIFIED, elements)


def element_table(rows: DataFrame, place: str) -> DataFrame:
    """The typed table of all the elements of one place: feed, file_no, record, ordinals, map_key and a column for each field.

    A field that has several types in the feeds' history is a string, whole numbers among others are double.
    """
    own = rows.where(F.col("place") == place)
    pairs = own.select(F.explode("kinds").alias("field", "kind")).distinct()
    seen: dict[str, set[str]] = defaultdict(set)
    for r in collect_bounded(pairs, SCHEMA_PATHS_MOST, "fields of the unified table"):
        seen[r.field].add(KINDS[r.kind] if r.kind != "z" else "")
    taken = {"feed", "file_no", "record", "ordinals", "map_key"}
    columns = []
    for field, types in sorted(seen.items()):
        types -= {""}
        kind = next(iter(types)) if len(types) == 1 else "double" if types == {"bigint", "double"} else "string"
        name = field.replace(".", "_")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append((F.col("fields")[field] if kind == "string" else F.col("fields")[field].try_cast(kind)).alias(name))
    return own.select("feed", "file_no", "record", "ordinals", "map_key", *columns)


def values(rows: DataFrame) -> DataFrame:
    """(feed, file_no, record, place, ordinals, map_key, field, kind, value): the unified rows with one field each, nulls left out."""
    out = rows.select("feed", "file_no", "record", "place", "ordinals", "map_key", "kinds", F.explode("fields").alias("field", "value")).where(F.col("value").isNotNull())
    return out.select("feed", "file_no", "record", "place", "ordinals", "map_key", "field", F.col("kinds")[F.col("field")].alias("kind"), "value")
