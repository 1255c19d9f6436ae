"""Deeply nested JSON records to related flat tables.

Method: one pass infers the merged schema (which paths hold arrays of objects anywhere in the data),
a second explodes every array level of every record into rows that carry the record's key, a
surrogate key, the parent row's surrogate key and the ordinal in the array. Every record has a root row,
the parent of its first level. The schema is bounded by the shape of the records, not by their number, and its
size is checked before it is sent to tasks. ``child_table`` gives the typed flat table of one place.

Defined results: null, empty and unreadable JSON gives no rows; a record without arrays of objects
gives its root row only; nothing of a record is lost, what cannot be a column of its row stays as JSON; of rows with one id only the latest counts (ties: the greater text); an empty
table gives empty tables; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_walk import KINDS, MISSING, array_paths, element_rows, opened, own_fields, read_json, safe
from ..session import collect_bounded, over_rows, spread

SCHEMA_PATHS_MOST = 20_000
NODE_SCHEMA = "record_id string, place string, child string, parent string, ordinal int, fields map<string,string>, kinds map<string,string>"


def latest_json(df: DataFrame, id_col: str, json_col: str, at_col: str) -> DataFrame:
    """(record_id, body): of each id the text of the row with the greatest ``at_col``."""
    rows = df.select(F.col(id_col).alias("record_id"), F.col(json_col).alias("body"), F.col(at_col).alias("at"))
    newest = F.max_by(F.struct("body"), F.struct(F.col("at"), F.col("body")))
    return rows.groupBy("record_id").agg(newest.alias("b")).select("record_id", F.col("b.body").alias("body"))


def array_schema(df: DataFrame, json_col: str, maps: frozenset[str] = frozenset()) -> frozenset[str]:
    """The paths at which any record holds an array of objects; one scan, no shuffle of records."""

    def paths(cols: dict[str, list]) -> Iterable[tuple]:
        seen: set[str] = set()
        for text in cols["body"]:
            value = read_json(text)
            if value is not MISSING:
                seen |= array_paths(value, maps)
        return [(safe(p),) for p in seen]

    found = over_rows(df.select(F.col(json_col).alias("body")).where(F.col("body") != ""), "path string", paths).distinct()
    return frozenset(r.path for r in collect_bounded(found, SCHEMA_PATHS_MOST, "paths of arrays in the merged schema"))


def explode_arrays(records: DataFrame, arrays: frozenset[str], entries: frozenset[str] = frozenset(), kept: frozenset[str] = frozenset(), with_fields: bool = True) -> DataFrame:
    """One row for each record (its root, with place '' and no parent), for each object that is an element of an array, at any depth, and for each entry of the ``entries`` maps (``NODE_SCHEMA``).

    ``records`` has record_id and body. Each array level becomes the rows of one ``place``.
    """

    def rows(cols: dict[str, list]) -> Iterable[tuple]:
        for rid, text in zip(cols["record_id"], cols["body"]):
            value = read_json(text)
            if value is MISSING:
                continue
            value = opened(value)
            if value is None:
                continue
            if with_fields:
                root = own_fields(value if isinstance(value, dict) else {} if isinstance(value, list) and "" in arrays else value, arrays, "", entries, kept)
                yield rid, "", "", None, 0, *_maps(root)
            else:
                yield rid, "", "", None, 0, None, None
            for place, child, parent, at, _, obj in element_rows(value, arrays, entries):
                fields = _maps(own_fields(obj, arrays, place, entries, kept)) if with_fields else (None, None)
                yield rid, safe(place), safe(child), safe(parent), at[-1], *fields

    return over_rows(spread(records.select(F.col("record_id").cast("string"), "body")), NODE_SCHEMA, rows)


def _maps(fields: dict[str, tuple[str, str | None]]) -> tuple[list, list]:
    return [(k, v) for k, (_, v) in fields.items()], [(k, t) for k, (t, _) in fields.items()]


def surrogate(record: Column, path: Column) -> Column:
    """The surrogate key of a row: stable over runs, so that tables written apart still join."""
    return F.xxhash64(record, path)


def with_keys(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        surrogate(F.col("record_id"), F.col("child")).alias("row_key"),
        F.when(F.col("parent").isNotNull(), surrogate(F.col("record_id"), F.col("parent"))).alias("parent_key"),
        *nodes.columns,
    )


def field_schema(nodes: DataFrame) -> dict[str, dict[str, str]]:
    """The merged schema: place -> field -> SQL type. Fields of several types are strings, whole numbers among others double."""
    pairs = nodes.select("place", F.explode("kinds").alias("field", "kind")).distinct()
    seen: dict[tuple[str, str], set[str]] = {}
    for r in collect_bounded(pairs, SCHEMA_PATHS_MOST, "fields of the merged schema"):
        seen.setdefault((r.place, r.field), set()).add(r.kind)
    out: dict[str, dict[str, str]] = {}
    for (place, field), kinds in sorted(seen.items()):
        types = {KINDS[k] for k in kinds - {"z"}}
        out.setdefault(place, {})[field] = types.pop() if len(types) == 1 else "double" if types == {"bigint", "double"} else "string"
    return out


def child_table(nodes: DataFrame, place: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one place with a typed column for each field of the merged schema (whole numbers beyond 64 bits are null)."""
    keyed = with_keys(nodes.where(F.col("place") == place))
    taken = {"row_key", "parent_key", "record_id", "ordinal"}
    columns = []
    for field, kind in fields.items():
        name = field.replace(".", "_")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append((F.col("fields")[field] if kind == "string" else F.col("fields")[field].try_cast(kind)).alias(name))
    return keyed.select("row_key", "parent_key", "record_id", "ordinal", *columns)
