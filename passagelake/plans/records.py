"""Problem 1: the nested records of degree programmes and curriculum pages as linked flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import flatten_lists
from ..session import table
from .registry import query

ROOTS = ("program_info", "curriculum", "modules")
TYPES = ("degree_program", "curriculum_page")
#: Child table -> (last step of the list's path, scalar fields of its members).
CHILDREN = {
    "tracks": (("tracks",), ("name", "ects")),
    "partners": (("partners",), ("name", "exchange.places")),
    "semesters": (("semesters",), ("number",)),
    "modules": (("modules", "core_modules"), ("code", "title", "credits", "ects", "description")),
    "assessments": (("assessments",), ("kind", "weight")),
    "assessment_parts": (("parts",), ("label", "minutes")),
    "offerings": (("offerings",), ("semester",)),
    "offering_groups": (("groups",), ("label", "room.building", "room.seats")),
    "slots": (("slots",), ("day", "start")),
}


# The members of all lists by DuckDB's own JSON functions: lists given as text are opened, lone values of list fields get position 0.
_MEMBERS = r"""
    r AS (SELECT id, raw_json::JSON AS j FROM site_objects WHERE object_type IN ('degree_program', 'curriculum_page') AND json_valid(raw_json) AND json_type(raw_json) = 'OBJECT'),
    t0 AS (SELECT r.id, x.fullkey AS k, x.type AS type, x.value AS v FROM r, json_tree(r.j) x WHERE regexp_matches(x.fullkey, '^\$\.(program_info|curriculum|modules)([.\[]|$)')),
    s0 AS (SELECT id, k, CASE WHEN type = 'VARCHAR' AND NOT ends_with(k, ']') AND regexp_matches(v->>'$', '^\s*\[[\s\S]*\]\s*$') AND json_valid(v->>'$') THEN v->>'$' END AS inner_, type, v FROM t0),
    t1 AS (SELECT id, k, type, v FROM s0 WHERE inner_ IS NULL UNION ALL SELECT s0.id, s0.k || substr(x.fullkey, 2), x.type, x.value FROM (SELECT * FROM s0 WHERE inner_ IS NOT NULL) s0, json_tree(s0.inner_::JSON) x),
    l AS (SELECT list(DISTINCT regexp_replace(substr(k, 3), '\[[0-9]+\]', '', 'g')) AS lists FROM t1 WHERE type = 'ARRAY'),
    n AS (SELECT id, type, v, string_split(substr(k, 3), '.') AS steps, l.lists FROM t1, l),
    m AS (SELECT id, type, v, list_transform(range(1, len(steps) + 1), lambda i: CASE WHEN NOT contains(steps[i], '[') AND (i < len(steps) OR type <> 'ARRAY') AND list_contains(lists, array_to_string(list_transform(steps[1:i], lambda s: regexp_replace(s, '\[.*$', '')), '.')) THEN steps[i] || '[0]' ELSE steps[i] END) AS steps FROM n),
    members AS (SELECT id, v, list_transform(steps, lambda s: regexp_replace(s, '\[.*$', '')) AS names, regexp_extract_all(array_to_string(steps, '.'), '\[([0-9]+)\]', 1) AS pos,
      list_max(list_filter(range(0, len(steps)), lambda i: i = 0 OR ends_with(steps[i], ']'))) AS up FROM m WHERE ends_with(steps[-1], ']') AND type NOT IN ('NULL', 'ARRAY'))"""


def _child_sql(name: str) -> str:
    lists, fields = CHILDREN[name]
    value = lambda f: f"v->>'$.{f}' AS {f.replace('.', '_')}"
    return f"""
    WITH {_MEMBERS}
    SELECT id AS object_row, array_to_string(names, '.') AS child_path, array_to_string(pos, '/') AS child_pos, array_to_string(names[1:up], '.') AS parent_path, array_to_string(pos[1:len(pos) - 1], '/') AS parent_pos,
      {", ".join(value(f) for f in fields)} FROM members WHERE names[-1] IN ({", ".join(f"'{x}'" for x in lists)})"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "site_objects").where(F.col("object_type").isin(*TYPES)).select("id", "raw_json")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All list members below the roots, linked to their parents."""
    return flatten_lists(_records(spark, sf_dir), "id", "raw_json", ROOTS)


def child_table(all_members: DataFrame, name: str) -> DataFrame:
    """One flat table of CHILDREN: site_objects.id, own and parent's path and position, and the members' fields as text."""
    lists, fields = CHILDREN[name]
    last = F.element_at(F.split("child_path", r"\."), -1)
    return all_members.where(last.isin(*lists)).select(
        F.col("id").alias("object_row"), "child_path", "child_pos", "parent_path", "parent_pos",
        *(F.get_json_object("value_json", f"$.{f}").alias(f.replace(".", "_")) for f in fields),
    )


@query("p1_found", f"WITH {_MEMBERS} SELECT id, array_to_string(names, '.') AS child_path, array_to_string(pos, '/') AS child_pos FROM members")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_lists(_records(spark, sf_dir), "id", "raw_json", ROOTS, values=False)


@query("p1_programmes", """
    SELECT id AS object_row, object_id, raw_json->>'$.program_info.name' AS name, raw_json->>'$.program_info.degree_type' AS degree_type,
           raw_json->>'$.program_info.language' AS language
    FROM (SELECT * FROM site_objects WHERE object_type = 'degree_program' AND json_valid(raw_json))
    WHERE json_type(raw_json, '$.program_info') = 'OBJECT'""")  # fmt: skip
def p1_programmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top table: one row per degree programme whose record can be read and has a program_info object."""
    so = table(spark, sf_dir, "site_objects").where(F.col("object_type") == "degree_program")
    v = F.expr("try_parse_json(raw_json)")
    info = F.get_json_object("raw_json", "$.program_info")
    at = lambda f: F.get_json_object("raw_json", f"$.program_info.{f}").alias(f)
    return so.where(v.isNotNull() & F.startswith(F.ltrim(info), F.lit("{"))).select(F.col("id").alias("object_row"), "object_id", at("name"), at("degree_type"), at("language"))


def _child(name: str):
    @query(f"p1_{name}", _child_sql(name))
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return child_table(members(spark, sf_dir), name)

    plan.__doc__ = f"The flat table of {name}."
    return plan


for _name in CHILDREN:
    _child(_name)
