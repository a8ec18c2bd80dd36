"""Nested records against a plain walk over parsed JSON."""

import json
import random

import pytest

from passagelake.operators import nested
from passagelake.operators.nested import flatten_lists

ROOTS = ("program_info", "curriculum", "modules")


def _as_list(v):
    if isinstance(v, str) and v.strip().startswith("["):
        try:
            w = json.loads(v)
            return w if isinstance(w, list) else v
        except ValueError:
            return v
    return v


def walk(rows):
    """The specification: lists are found over all rows, then every row is walked."""
    lists, objects, out = set(), [], []
    for i, t in rows:
        try:
            o = json.loads(t)
        except (TypeError, ValueError):
            continue
        if isinstance(o, dict):
            objects.append((i, o))

    def scan(path, v):
        v = _as_list(v)
        if isinstance(v, list):
            lists.add(path)
        for x in v if isinstance(v, list) else [v]:
            if isinstance(x, dict):
                for k, w in x.items():
                    scan(f"{path}.{k}", w)

    def go(i, path, pos, v):
        v = _as_list(v)
        if v is None:
            return
        if isinstance(v, list) or path in lists:
            for k, x in enumerate(v if isinstance(v, list) else [v]):
                if x is not None:
                    out.append((i, path, "/".join([*pos, str(k)])))
                    if isinstance(x, dict):
                        for a, w in x.items():
                            go(i, f"{path}.{a}", [*pos, str(k)], w)
        elif isinstance(v, dict):
            for a, w in v.items():
                go(i, f"{path}.{a}", pos, w)

    for _, o in objects:
        for k in ROOTS:
            if k in o:
                scan(k, o[k])
    for i, o in objects:
        for k in ROOTS:
            if k in o:
                go(i, k, [], o[k])
    return out


def _value(r, depth):
    kind = r.randrange(10)
    if depth > 4 or kind < 3:
        return r.choice([None, 1, -2.5e3, True, "", "text", 'quo"te\\', "[1, 2", "ä😀\n", "[]{},:"])
    if kind < 6:
        return [_value(r, depth + 2) if not r.randrange(3) else {"a": _value(r, depth + 1), "b": _value(r, depth + 1)} for _ in range(r.randrange(4))]
    if kind < 7:
        return json.dumps([{"a": 1}, None, "x"], ensure_ascii=bool(r.randrange(2)))
    return {k: _value(r, depth + 1) for k in r.sample(["a", "b", "c d", 'k"q', "é"], r.randrange(4))}


def _no_lists_in_lists(v):
    """Lists directly inside lists have no path of their own and are left out of the comparison."""
    if isinstance(v, list):
        return [_no_lists_in_lists(x) for x in v if not isinstance(x, list)]
    if isinstance(v, dict):
        return {k: _no_lists_in_lists(x) for k, x in v.items()}
    return v


def test_against_walk(spark):
    r = random.Random(11)
    rows = []
    for i in range(600):
        o = {k: _no_lists_in_lists(_value(r, 0)) for k in r.sample([*ROOTS, "other"], r.randrange(5))}
        t = json.dumps(o, indent=r.choice([None, 2]), ensure_ascii=bool(r.randrange(2)))
        if not i % 17:
            t = t[: r.randrange(len(t) + 1)]
        rows.append((i, t))
    rows += [(1000, None), (1001, ""), (1002, "[1]"), (1003, "{} x"), (1004, '{"modules": [1,]}'), (1005, '{"modules": {"a" 1}}'), (1006, "nul"), (1007, '{"modules": [01]}'), (1008, '{"modules": ["\\x"]}'), (1009, '{"modules": ["a\tb"]}'), (1010, '{"modules": [1], "modules": [5, 6]}'), (None, '{"modules": [7]}')]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id long, raw_json string, child_path string")
    got = [tuple(x) for x in flatten_lists(df, "id", "raw_json", ROOTS, values=False).collect()]
    want = walk(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 500


def test_values_and_parents(spark):
    t = '{"modules": [{"code": "A", "parts": "[{\\"n\\": 1}]"}, null, {"code": "B", "parts": {"n": 2}}]}'
    got = {(r["child_path"], r["child_pos"]): r for r in flatten_lists(spark.createDataFrame([(1, t)], "id int, raw_json string"), "id", "raw_json", ROOTS).collect()}
    assert set(got) == {("modules", "0"), ("modules", "2"), ("modules.parts", "0/0"), ("modules.parts", "2/0")}
    assert got["modules.parts", "2/0"]["parent_path"] == "modules" and got["modules.parts", "0/0"]["parent_pos"] == "0"
    assert json.loads(got["modules.parts", "0/0"]["value_json"]) == {"n": 1}


def test_long_deep_and_empty(spark):
    deep = '{"modules": ' + '[{"a": ' * 150 + "1" + "}]" * 150 + "}"
    long = json.dumps({"modules": [{"t": "x" * 1000}] * 9000})
    df = spark.createDataFrame([(1, deep), (2, long)], "id int, raw_json string")
    n = {r["id"]: r["count"] for r in flatten_lists(df, "id", "raw_json", ROOTS, values=False).groupBy("id").count().collect()}
    assert n == {1: 150, 2: 9000}
    assert flatten_lists(df.limit(0), "id", "raw_json", ROOTS).count() == 0


def test_many_paths_are_written_not_sent(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_SHIPPED_PATHS", 3)
    rows = [(i, json.dumps({"modules": {f"k{i % 7}": [1, 2] if i % 2 else 3}})) for i in range(40)]
    rows += [(100 + i, json.dumps({"modules": {"a.b": {'q"t': v}}, "curriculum": json.dumps([{"x y": v, "z.w": {"k": v}}])})) for i, v in enumerate(([1], 2, [3, None], "4"))]
    df = spark.createDataFrame(rows, "id long, raw_json string")
    assert sorted(tuple(r) for r in flatten_lists(df, "id", "raw_json", ROOTS, values=False).collect()) == sorted(walk(rows))


@pytest.mark.parametrize("name", ["site_objects"])
def test_on_the_tables(spark, data, name):
    df = spark.read.parquet(f"{data}/{name}.parquet").where("object_type IN ('degree_program', 'curriculum_page')").select("id", "raw_json")
    got = [tuple(r) for r in flatten_lists(df, "id", "raw_json", ROOTS, values=False).collect()]
    assert sorted(got) == sorted(walk([tuple(r) for r in df.collect()]))
