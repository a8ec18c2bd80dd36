"""Richer facts of documents as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as X
from ..session import table
from .registry import query

_A = "list_transform(regexp_extract_all(text, '(?:EUR|€) ?([0-9]{1,6}(?:[.,][0-9]{2})?)', 1), lambda x: CAST(replace(x, ',', '.') AS DOUBLE))"


@query("amount_summary", f"WITH a AS (SELECT doc_id, {_A} AS a FROM documents) SELECT doc_id, len(a)::INTEGER AS n, list_min(a) AS least, list_max(a) AS most, round(list_sum(a), 2) AS total FROM a")
def amount_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.amount_summary("text").alias("a")).select("doc_id", "a.*")


@query("credit_range", """
    WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(text, '([0-9]{1,3}) (?:ECTS|credits|Leistungspunkte|Punkten)', 1), lambda x: x::INTEGER) AS c FROM documents)
    SELECT doc_id, list_min(c) AS least, list_max(c) AS most FROM c""")  # fmt: skip
def credit_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.credit_range("text").alias("c")).select("doc_id", "c.*")


@query("language_levels", """
    SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all('Needs B2, or C1 (not C1.3); ' || coalesce(title, '') || ' A' || (id % 2 + 1), '(?:^|[^A-Za-z0-9])([ABC][12])(?:[^A-Za-z0-9.]|$)', 1))), ',') AS v FROM site_objects""")  # fmt: skip
def language_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels in a line built from each title."""
    t = F.concat(F.lit("Needs B2, or C1 (not C1.3); "), F.coalesce("title", F.lit("")), F.lit(" A"), (F.col("id") % 2 + 1).cast("string"))
    return table(spark, d, "site_objects").select("id", F.array_join(X.language_levels(t), ",").alias("v"))


@query("deadlines", """
    SELECT doc_id, nullif(regexp_extract(text, '(?:before|until|by|ab dem|Bis zum|bis zum|Nach dem) ([0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS date,
      nullif(regexp_extract(text, '(?:winter|summer) semester [0-9]{2,4}(?:/[0-9]{2})?', 0), '') AS semester FROM documents""")  # fmt: skip
def deadlines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.deadline("text").alias("x")).select("doc_id", "x.*")


@query("numbered_steps", """
    WITH l AS (SELECT doc_id, list_filter(string_split(text, E'\\n'), lambda s: regexp_matches(s, '^[ \\t]*[0-9]+[.)][ \\t]')) AS l FROM documents), s AS (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS n FROM l)
    SELECT doc_id, n::INTEGER AS step_number, trim(regexp_replace(s, '^[ \\t]*[0-9]+[.)][ \\t]+', '')) AS title, nullif(regexp_extract(s, '[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}', 0), '') AS date FROM s""")  # fmt: skip
def numbered_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(X.steps("text")))


@query("fee_breakdown", f"""
    WITH m AS (SELECT doc_id, regexp_extract_all(text, '{X.FEE}', 1) AS a, regexp_extract_all(text, '{X.FEE}', 2) AS b FROM documents), r AS (SELECT doc_id, unnest(a) AS label, unnest(b) AS amount FROM m)
    SELECT doc_id, lower(label) AS label, CAST(replace(amount, ',', '.') AS DOUBLE) AS amount FROM r WHERE CAST(replace(amount, ',', '.') AS DOUBLE) > 0 AND CAST(replace(amount, ',', '.') AS DOUBLE) <= 100000""")  # fmt: skip
def fee_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with what they are of."""
    return table(spark, d, "documents").select("doc_id", F.inline(X.fee_breakdown("text")))


@query("test_details", f"""
    WITH t AS (SELECT id, 'IELTS at least 6,5 or TOEFL ' || (80 + id % 20) || '; ' || coalesce(title, '') AS t FROM site_objects), r AS (SELECT id, unnest(regexp_extract_all(t, '{X.TEST}', 1)) AS test, unnest(regexp_extract_all(t, '{X.TEST}', 2)) AS score FROM t)
    SELECT id, test, CAST(replace(score, ',', '.') AS DOUBLE) AS score FROM r""")  # fmt: skip
def test_details(spark: SparkSession, d: str) -> DataFrame:
    """Tests and scores in a line built from each title."""
    t = F.concat(F.lit("IELTS at least 6,5 or TOEFL "), (F.col("id") % 20 + 80).cast("string"), F.lit("; "), F.coalesce("title", F.lit("")))
    return table(spark, d, "site_objects").select("id", F.inline(X.test_details(t)))


@query("contact_persons", f"""
    WITH r AS (SELECT request_id, unnest(regexp_extract_all(email_text, '{X.PERSON}', 1)) AS name, unnest(regexp_extract_all(email_text, '{X.PERSON}', 2)) AS email FROM email_requests)
    SELECT request_id, name, lower(email) AS email FROM r WHERE NOT regexp_matches(name, 'Office|Team|Desk|Büro|Service')""")  # fmt: skip
def contact_persons(spark: SparkSession, d: str) -> DataFrame:
    """Persons with their addresses in mails."""
    return table(spark, d, "email_requests").select("request_id", F.inline(X.contact_persons("email_text")))


@query("requirement_lines", """
    WITH p AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(text, '([.!?]) ', '\\1\n', 'g'), '\n'), lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g')) AS p FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_filter(p, lambda x: length(x) BETWEEN 15 AND 200 AND regexp_matches(lower(x), 'required|must|need|muss|müssen|vorliegen'))[1:10], lambda x: regexp_replace(x, '^[-•*] *', '')), ' | ') AS v FROM p""")  # fmt: skip
def requirement_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines and sentences that ask for something, ten a text."""
    return table(spark, d, "documents").select("doc_id", F.array_join(X.requirement_lines("text"), " | ").alias("v"))
