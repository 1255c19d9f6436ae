"""Nested records and schema drift on small fixtures."""

from __future__ import annotations

import datetime
import itertools
import json
import random

from pyspark.sql import functions as F

from ontoweave.functions.json_walk import MISSING, read_json
from ontoweave.operators import drift, nested

AT = datetime.datetime(2024, 1, 1)
RUNS = "run_id string, result_json string, finished_at timestamp, record_id string, body string"  # the last two clash with inner names


def runs(spark, rows):
    return spark.createDataFrame([(i, j, AT + datetime.timedelta(days=n), "x", "y") for i, j, n in rows], RUNS)


def nodes(spark, rows):
    df = runs(spark, rows)
    found = nested.explode_arrays(nested.latest_json(df, "run_id", "result_json", "finished_at"), nested.array_schema(df, "result_json"))
    return {(r.record_id, r.child, r.parent) for r in found.where("place <> ''").collect()}


def test_paths_and_parents(spark):
    body = {"a": {"b": [{"c": [{"d": 1}, {"d": 2}]}]}, "e": [1, 2], "f": []}
    assert nodes(spark, [("r", json.dumps(body), 0)]) == {("r", "a.b[0]", ""), ("r", "a.b[0].c[0]", "a.b[0]"), ("r", "a.b[0].c[1]", "a.b[0]")}


def test_latest_run_counts_and_unreadable_gives_nothing(spark):
    rows = [("r", '{"a":[{"x":1}]}', 0), ("r", '{"a":[{"x":1},{"x":2}]}', 1), ("s", '{"a":[{"x"', 0), ("t", None, 0), ("u", "", 0), ("v", "null", 0), (None, '{"a":[{}]}', 0)]
    assert nodes(spark, rows) == {("r", "a[0]", ""), ("r", "a[1]", ""), (None, "a[0]", "")}


def test_held_json_and_lone_objects(spark):
    rows = [("r", json.dumps({"a": json.dumps([{"x": 1}])}), 0), ("s", '{"a":{"x":1,"b":[{"y":2}]}}', 0), ("t", '{"a":"[sic]"}', 0), ("u", json.dumps(json.dumps({"a": [{}]})), 0)]
    assert nodes(spark, rows) == {("r", "a[0]", ""), ("s", "a[0]", ""), ("s", "a[0].b[0]", "a[0]"), ("u", "a[0]", "")}


def test_repeats_ties_empty_table_and_depth(spark):
    one = ("r", '{"a":[{"x":1}]}', 0)
    assert nodes(spark, [one, one, one]) == {("r", "a[0]", "")}
    assert nodes(spark, []) == set()
    deep = '{"a":[' * 200 + "{}" + "]}" * 200
    assert len(nodes(spark, [("r", deep, 0)])) == 200
    assert read_json("[" * 100_000) is MISSING
    assert read_json('{"a": NaN}') is MISSING


def test_child_tables_join_to_their_parents(spark):
    df = runs(spark, [("r", '{"k":3,"m":{"t":1.5},"a":[{"n":"x","b":[{"v":1,"ok":true},{"v":2}]},{"n":"y","b":[],"ordinal":"z"}]}', 0), ("s", '{"k":4.5,"a":[{"n":7}]}', 0)])
    found = nested.explode_arrays(nested.latest_json(df, "run_id", "result_json", "finished_at"), nested.array_schema(df, "result_json"))
    schema = nested.field_schema(found)
    assert schema == {"": {"k": "double", "m.t": "double"}, "a[]": {"b": "string", "n": "string", "ordinal": "string"}, "a[].b[]": {"ok": "boolean", "v": "bigint"}}
    roots, parents, children = (nested.child_table(found, place, schema[place]) for place in ("", "a[]", "a[].b[]"))
    joined = children.join(parents.select(F.col("row_key").alias("k"), "n"), F.col("parent_key") == F.col("k"))
    assert sorted((r.n, r.v, r.ok, r.ordinal) for r in joined.collect()) == [("x", 1, True, 0), ("x", 2, None, 1)]
    above = parents.join(roots.select(F.col("row_key").alias("root_key"), "k", F.col("parent_key").alias("none")), F.col("parent_key") == F.col("root_key"))
    assert sorted((r.k, r.m_t if "m_t" in above.columns else None, r.n, r.ordinal_) for r in above.collect()) == [(3.0, None, "x", None), (3.0, None, "y", "z"), (4.5, None, "7", None)]
    assert {r.none for r in above.collect()} == {None}


def rebuilt(rows):
    """A record from its rows: each element put in its place."""
    root = {}
    for r in sorted(rows, key=lambda r: (r.child.count("["), r.child)):
        own = {}
        for name, text in r.fields.items():
            at, steps = own, name.split(".")
            for step in steps[:-1]:
                at = at.setdefault(step, {})
            at[steps[-1]] = text if r.kinds[name] == "s" else None if text is None else json.loads(text)
        if not r.child:
            root = own
            continue
        at = root
        steps = r.child.replace("]", "").replace("[", ".#").split(".")
        for k, step in enumerate(steps):
            last = k == len(steps) - 1
            if step[0] == "#":
                n = int(step[1:])
                at.extend([None] * (n + 1 - len(at)))
                if last:
                    at[n] = own
                elif at[n] is None:
                    at[n] = [] if steps[k + 1][0] == "#" else {}
                at = at[n]
            else:
                at = at.setdefault(step, [] if steps[k + 1][0] == "#" else {})
    return root


def random_object(r, depth, least=0):
    """Keys begin with what they hold, so that no lone object stands where others have an array."""
    kinds = [r.choice("sinbzoaam" if depth else "sinbz") for _ in range(r.randint(least, 3))]
    return {f"{k}{r.choice('abc')}": random_value(r, k, depth) for k in kinds}


def random_value(r, kind, depth):
    if kind == "o":
        return random_object(r, depth - 1)
    if kind == "a":
        return [random_object(r, depth - 1, 1) for _ in range(r.randint(0, 3))]
    if kind == "m":
        return [random_value(r, r.choice("sinbz"), 0) for _ in range(r.randint(0, 3))] if r.random() < 0.5 else [[r.randint(0, 9)] * r.randint(0, 2) for _ in range(2)]
    return {"s": r.choice(["", "x", "[sic", "é"]), "i": r.randint(-9, 9), "n": 0.25, "b": True, "z": None}[kind]


def test_records_can_be_rebuilt_from_their_rows(spark):
    r = random.Random(8)
    bodies = []
    for k in range(120):
        bodies.append(random_object(r, 3, 1) if k % 2 else {"e": [{"x": k, "y": [[1, 2], [3]], "m": [1, {"deep": [{"v": "1"}]}, "s"]}], "t": {"u": [], "w": {}}})
    df = runs(spark, [(str(k), json.dumps({f"r{k}": b}), 0) for k, b in enumerate(bodies)])
    found = nested.explode_arrays(nested.latest_json(df, "run_id", "result_json", "finished_at"), nested.array_schema(df, "result_json"))
    rows = {}
    for x in found.collect():
        rows.setdefault(x.record_id, []).append(x)
    for k, b in enumerate(bodies):
        assert rebuilt(rows[str(k)]) == {f"r{k}": b}, b


def test_answers(spark):
    df = spark.createDataFrame([("k", '{"m":1,"answers":{"a.b":{"noul":1,"probabilities":{"X":1},"why":[{"s":1},{"s":2}]},"c":2}}'), ("l", '{"answers":[1]}'), ("m", None), ("n", "[]"), (None, '{"answers":"{\\"z\\":{}}"}')], "record_id string, body string")
    found = nested.explode_arrays(df, nested.array_schema(df, "body", drift.MAP_FIELDS), drift.ENTRIES, drift.MAP_FIELDS)
    rows = {(r.record_id, r.place, r.child, r.parent, tuple(sorted(r.fields.items()))) for r in found.collect()}
    assert rows == {
        ("k", "", "", None, (("m", "1"),)), ("k", "answers.*", "answers.a.b", "", (("noul", "1"), ("probabilities", '{"X":1}'))), ("k", "answers.*.why[]", "answers.a.b.why[0]", "answers.a.b", (("s", "1"),)),
        ("k", "answers.*.why[]", "answers.a.b.why[1]", "answers.a.b", (("s", "2"),)), ("k", "answers.*", "answers.c", "", (("value", "2"),)), ("l", "", "", None, (("answers", "[1]"),)), ("n", "", "", None, (("value", "[]"),)),
        (None, "", "", None, ()), (None, "answers.*", "answers.z", "", ()),
    }


FILES = "feed string, file_no int, body string, path string, type string"


def report(spark, files, feed="f"):
    rows = [(feed, no, b if b is None or isinstance(b, str) else json.dumps(b), "p", "t") for no, bodies in files.items() for b in bodies]
    found = drift.drift_report(spark.createDataFrame(rows, FILES), "body")
    return sorted((r.file_no, r.change, r.field, r.new_field) for r in found.collect())


def test_each_change(spark):
    files = {1: [{"a": 1, "b": [{"c": "x", "d": 1}]}], 3: [{"a": "1", "b": [{"e": "x", "d": 1}]}], 4: [{"a": "1", "b": [{"e": "x", "d": 1}], "g": None, "h": {"i": 1}}], 5: [{"a": "1", "b": [{"e": "x", "d": 1}]}]}
    assert report(spark, files) == [(3, "renamed", "b[].c", "b[].e"), (3, "retyped", "a", ""), (4, "added", "h", ""), (5, "removed", "h", "")]


def test_beneath_a_change_and_maps(spark):
    files = {1: [{"t": "X", "answers": {"q1": {"noul": 1}}, "m": {"answers": [{"p": 1}]}}], 2: [{"t": {"id": "X"}, "answers": {"q9": {"p_true": 1}}, "m": {"answers": [{"p": 1}]}}]}
    assert report(spark, files) == [(2, "renamed", "answers.*.noul", "answers.*.p_true"), (2, "retyped", "t", "")]
    assert report(spark, {1: [{"entities": [{"n": 1}]}], 2: [{"nodes": [{"n": 1, "k": 2}]}]}) == [(2, "renamed", "entities", "nodes")]


def test_lone_objects_under_map_keys(spark):
    files = {1: [{"answers": {"q1": {"x": [{"p": 1}]}}}], 2: [{"answers": {"q2": {"x": {"p": 1}}}}]}
    assert report(spark, files) == []


def test_optional_fields_unreadable_files_and_empty(spark):
    assert report(spark, {1: [{"a": 1}, {"b": 1}], 2: [None, "", '{"a"'], 3: [{"a": 1, "b": 2}, {}]}) == []
    assert report(spark, {1: []}) == []
    assert report(spark, {1: [{"a": 1}] * 50, 2: [{"a": 1}]}) == []
    assert report(spark, {1: [{"a": 1}, {"a": 1}, {"a": "x"}], 2: [{"a": 1}, {"a": "x"}, {"a": "x"}]}) == [(2, "retyped", "a", "")]


def test_assignment_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        n, m = r.randint(1, 4), r.randint(1, 4)
        w = [[r.random() for _ in range(m)] for _ in range(n)]
        got = drift.best_assignment(w)
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(w[a][b] if n <= m else w[b][a] for a, b in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert abs(sum(w[i][j] for i, j in got) - best) < 1e-9


UNIFIED = "feed string, file_no int, id string, body string, record string, ordinals string"


def unified_of(spark, rows):
    df = spark.createDataFrame([(f, n, i, b if b is None or isinstance(b, str) else json.dumps(b), "x", "y") for f, n, i, b in rows], UNIFIED)
    return drift.unified(df, "body", drift.drift_report(df, "body"), ["id"])


def test_unified_follows_renames(spark):
    rows = [("f", 1, "p", {"a": 1, "b": [{"c": "x"}, {"c": "v"}]}), ("f", 2, "p", {"n": 1, "b": [{"c": "y"}]}), ("f", 2, "p", {"n": 1, "b": [{"c": "y"}]}), ("f", 3, "q", {"n": 1, "d": {"z": "y"}}), ("f", 4, "q", {"n": 1, "d": [{"z": "w"}]}), ("f", 5, "r", None), ("f", 5, "r", '{"a"')]
    got = {(r.file_no, r.record, r.place, tuple(r.ordinals), r.field, r.value) for r in drift.values(unified_of(spark, rows)).collect()}
    assert got == {(1, "p", "", (), "n", "1"), (1, "p", "d[]", (0,), "c", "x"), (1, "p", "d[]", (1,), "c", "v"), (2, "p", "", (), "n", "1"), (2, "p", "d[]", (0,), "c", "y"), (3, "q", "", (), "n", "1"), (3, "q", "d[]", (0,), "z", "y"), (4, "q", "", (), "n", "1"), (4, "q", "d[]", (0,), "z", "w")}


def test_names_that_change_again_and_return(spark):
    assert drift.newest("a[].b.c", {"a": "x"}) == "x[].b.c" and drift.newest("a[].b.c", {"a": "x", "a[].b": "x[].q"}) == "x[].q.c" and drift.newest("ab", {"a": "x"}) == "ab"
    rows = [("f", 1, "p", {"a": 1}), ("f", 2, "p", {"b": 2}), ("f", 3, "p", {"c": 3}), ("f", 4, "p", {"a": 4}), ("g", 1, "p", {"a": "s"}), (None, 1, "p", {"a": "t"})]
    got = {(r.feed, r.file_no, r.field, r.value) for r in drift.values(unified_of(spark, rows)).collect()}
    assert got == {("f", 1, "a", "1"), ("f", 2, "a", "2"), ("f", 3, "a", "3"), ("f", 4, "a", "4"), ("g", 1, "a", "s"), (None, 1, "a", "t")}


def test_element_tables_are_typed_and_keep_map_keys(spark):
    rows = [("f", 1, "p", {"answers": {"q1": {"noul": 1, "ok": True, "record": "r"}, "q.2": {"noul": 0.5, "probabilities": {"X": 1}}}}), ("f", 1, "o", {"answers": {"q1": 3}})]
    out = drift.element_table(unified_of(spark, rows), "answers.*")
    assert dict(out.dtypes) == {"feed": "string", "file_no": "int", "record": "string", "ordinals": "array<int>", "map_key": "string", "noul": "double", "ok": "boolean", "probabilities": "string", "record_": "string", "value": "bigint"}
    assert {(r.record, r.map_key, r.noul, r.ok, r.record_, r.probabilities, r.value) for r in out.collect()} == {("p", "q1", 1.0, True, "r", None, None), ("p", "q.2", 0.5, None, None, '{"X":1}', None), ("o", "q1", None, None, None, None, 3)}
    assert unified_of(spark, []).count() == 0
