"""From evidence to an answer: selection, references, prompts, quality. Text is assembled, not generated; words are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .upsert import numbered


def programme_score(title: Column, url: Column, text: Column, aliases: Column, others: Column, weak: Column, target: Column | None = None) -> Column:
    """Points of a document for a programme: an alias found in the URL counts 6, in the title 5, in the text 4, the programme's own page (URL `target` or below it) 10; a weak section takes 5, clues to other programmes 6. aliases, others: arrays of lower-case strings."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (url, title, text)]

    def found(c: Column) -> Column:
        return F.size(F.filter(aliases, lambda a: F.contains(c, a)))

    hits = found(low[0]) * 6 + found(low[1]) * 5 + found(low[2]) * 4
    other = F.exists(others, lambda o: F.contains(low[1], o) | F.contains(low[0], o))
    own = F.when(F.startswith(low[0], F.lower(target)), 10).otherwise(0) if target is not None else F.lit(0)
    return (hits + own - F.when(weak, 5).otherwise(0) - F.when(other, 6).otherwise(0)).cast("int")


def select_evidence(df: DataFrame, group: str, score: str, order: str, strong: int = 3, keep: int = 5) -> DataFrame:
    """Of each group the documents with a score of `strong` or more, filled up in order to `keep`; with position (from 1).

    order: a whole-number column, unique in its group. Strong rows are counted and numbered by ranges of it, weak ones cut
    to `keep` a group before the shuffle, so no task sees all rows of a group. Null scores are weak, null groups a group.
    """
    is_strong = F.coalesce(F.col(score) >= strong, F.lit(False))
    first = numbered(df.where(is_strong), group, order, "position").withColumn("position", F.col("position").cast("int"))
    weak = df.where(~is_strong).withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__at") <= keep)
    n = df.groupBy(F.col(group).alias("__group")).agg(F.count_if(is_strong).alias("__strong"))
    fill = weak.join(n, F.col(group).eqNullSafe(F.col("__group"))).where(F.col("__at") + F.col("__strong") <= keep)
    return first.unionByName(fill.withColumn("position", (F.col("__at") + F.col("__strong")).cast("int")).drop("__at", "__group", "__strong"))


def best_citation(df: DataFrame, group: str, score: str, position: str, keyword: Column) -> DataFrame:
    """Of each group the document to cite: the best-scored one from 3 points on, else the first with a keyword, else number 1."""
    strong = F.min(F.when(F.col(score) >= 3, F.struct((-F.col(score)).alias("s"), F.col(position).alias("p"))))
    first = F.min(F.when(keyword, F.col(position)))
    return df.groupBy(group).agg(strong.alias("_s"), first.alias("_k")).select(group, F.coalesce("_s.p", "_k", F.lit(1)).cast("int").alias("citation"))


def reference_lines(cited: Column, urls: Column) -> Column:
    """Lines `[Doc N] url` of the cited documents that have a URL, each once, in order of citation. cited: array<int>; urls: array<string>."""
    return F.array_join(F.array_compact(F.transform(F.array_distinct(cited), lambda c: F.when(F.get(urls, c - 1).isNotNull(), F.concat(F.lit("[Doc "), c.cast("string"), F.lit("] "), F.get(urls, c - 1))))), "\n")


def with_topic_links(lines: Column, topics: Column, links: dict[str, tuple[str, ...]]) -> Column:
    """Reference lines (array<string>) and, for each of `topics` (array<string>), its links as lines of their own; every line once, in this order."""
    more = [F.when(F.array_contains(topics, t), F.array(*(F.lit(f"- {u}") for u in us))).otherwise(F.array().cast("array<string>")) for t, us in links.items()]
    return F.array_distinct(F.concat(lines, *(F.coalesce(m, F.array().cast("array<string>")) for m in more)))


def renumber_citations(draft: Column, order: Column) -> Column:
    """`[Doc N]` rewritten where document N now stands in `order` (array<int> of old numbers); numbers not in it are dropped."""
    pieces = F.split(draft, r"\[Doc [0-9]+\]")
    nums = F.transform(F.regexp_extract_all(draft, F.lit(r"\[Doc ([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))
    new = F.transform(nums, lambda n: F.when(F.array_position(order, n) > 0, F.concat(F.lit("[Doc "), F.array_position(order, n).cast("string"), F.lit("]"))).otherwise(""))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.coalesce(F.when(i > 0, F.get(new, i - 1)), F.lit("")), p)), "")


def weighted_quality(parts: dict[str, tuple[Column, float]], caps: list[tuple[Column, float]]) -> Column:
    """struct<score, label>: weighted parts (each from 0 to 1), limited by the caps whose conditions hold, and a label."""
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))
    for cond, cap in caps:
        total = F.when(cond, F.least(total, F.lit(cap))).otherwise(total)
    s = F.round(total, 2)
    return F.struct(s.alias("score"), F.when(s >= 85, "good").when(s >= 70, "mostly_good").when(s >= 50, "partial").otherwise("review").alias("label"))


def prompt(profile: dict[str, Column], topics: Column, evidence: Column, rules: str, most: int = 1400) -> Column:
    """The text for a generator: known facts, topics, numbered evidence of at most `most` characters each, rules. topics, evidence: arrays of strings."""
    facts = F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c)) for k, c in profile.items()))
    docs = F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("[Doc "), (i + 1).cast("string"), F.lit("] "), F.substring(e, 1, most))), "\n")
    return F.concat_ws("\n\n", facts, F.concat(F.lit("Topics: "), F.array_join(topics, ", ")), docs, F.lit(rules))


def guarded_rewrite(draft: Column, topics: Column, guarded: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """`draft` with what matches `pattern` replaced where its topics (array<string>) have one of `guarded`; else, and without topics, as it is."""
    return F.when(F.coalesce(F.arrays_overlap(topics, F.array(*map(F.lit, guarded))), F.lit(False)), F.regexp_replace(draft, pattern, replacement)).otherwise(draft)


def with_note(response: Column, level: Column, notes: dict[str, str]) -> Column:
    """The response with the note of its level of confidence behind it, if there is one for that level."""
    out = None
    for k, note in notes.items():
        out = F.when(level == k, F.concat(response, F.lit(note))) if out is None else out.when(level == k, F.concat(response, F.lit(note)))
    return response if out is None else out.otherwise(response)


def block(head: str, lines: dict[str, Column], tail: str = "") -> Column:
    """`head`, a line `- label: value` for every value that is there, and `tail`; null if none is."""
    got = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {k}: "), c)) for k, c in lines.items())))
    return F.when(F.size(got) > 0, F.concat_ws("\n", F.lit(head), F.array_join(got, "\n"), *([F.lit(tail)] if tail else [])))


def lines_where(rules: list[tuple[Column, str]]) -> Column:
    """The lines whose conditions hold, in the order of the rules."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in rules))), "\n")


def ordered_topics(found: Column, order: tuple[str, ...], merges: dict[str, str], discards: list[tuple[tuple[str, ...], str]], most: int, fallback: str) -> Column:
    """Topics merged into others, without those that the presence of others makes needless, in order of priority, at most `most`; [fallback] if none is left.

    found: array<string>; merges: from -> into; discards: (any of these, what then goes). Topics out of `order` are dropped.
    """
    def merged(c: Column, a: str, b: str) -> Column:
        return F.transform(c, lambda x: F.when(x == a, F.lit(b)).otherwise(x))

    into = found
    for a, b in merges.items():
        into = merged(into, a, b)
    kept = into
    for those, gone in discards:
        kept = F.when(F.arrays_overlap(into, F.array(*map(F.lit, those))), F.array_remove(kept, gone)).otherwise(kept)
    out = F.slice(F.filter(F.array(*map(F.lit, order)), lambda t: F.array_contains(kept, t)), 1, most)
    return F.when(F.coalesce(F.size(out), F.lit(0)) > 0, out).otherwise(F.array(F.lit(fallback)))


def bad_phrases(draft: Column, phrases: tuple[str, ...], disclaimer: str | None = None) -> Column:
    """The phrases of a table that a draft has, without case, after a disclaimer at its end is taken off. The table is the caller's."""
    body = F.lower(F.regexp_replace(draft, rf"(?s)\s*{disclaimer}.*\z", "") if disclaimer else draft)
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(body, p))
