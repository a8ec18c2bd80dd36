"""Labels from rule tables, matches of names in texts, scores of drafts. Rules are data: a caller gives its own tables."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import all_matches, match_form, url_path
from .retrieval import read_blocks


def labels_by_rules(text: Column, rules: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """Sorted labels of which any pattern occurs in the lower-case text; [default] if there is none. One alternation a label."""
    low = F.lower(text)
    hit = [F.when(F.regexp_like(low, F.lit("|".join(f"(?:{p})" for p in ps))), F.lit(label)) for label, ps in rules.items()]
    got = F.array_sort(F.array_compact(F.array(*hit)))
    return F.when(F.size(got) == 0, F.array(F.lit(default))).otherwise(got) if default else got


def first_label(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def _any(c: Column, *parts: str) -> Column:
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


# Classes of pages by parts of their paths, in the order in which they are tried. A row is one class: groups of
# parts of each of which one must occur, the class, its confidence.
PAGE_RULES: tuple[tuple[tuple[tuple[str, ...], ...], str, str], ...] = (
    ((("/search/", "/sitemap", "/login", "/newsletter"),), "exclude", "high"),
    ((("/english-language-study-programmes/",), ("/elective", "/core-courses", "/modules", "/course")), "curriculum_page", "high"),
    ((("/english-language-study-programmes/",), ("-bachelor", "-master", "/bachelor", "/master")), "degree_program", "high"),
    ((("/english-language-study-programmes/",),), "degree_program", "medium"),
    ((("/studies/applications/",), ("uni-assist", "uniassist", "uni_assis")), "application_route_rule", "high"),
    ((("/studies/applications/",), ("deadline", "period")), "deadline_rule", "medium"),
    ((("/studies/applications/",), ("/master", "masters")), "application_process", "high"),
    ((("/studies/applications/",),), "application_process", "medium"),
    ((("/studies/degree-programmes/",), ("/faq",)), "faq_support", "high"),
    ((("/studies/degree-programmes/",),), "overview_navigation", "medium"),
    ((("/fees", "/cost", "/semester-fee", "/semester-contribution", "/contribution"),), "fees_funding_rule", "medium"),
    ((("/language", "/english", "/german"),), "language_proof_rule", "medium"),
    ((("/international/",), ("/apply", "/application", "/admission", "/requirements")), "application_process", "medium"),
)
# Where pages are classified at all, the class of those elsewhere and of those no rule knows.
PAGE_SCOPE, OUT_OF_SCOPE, NO_RULE = "/en/", ("exclude_non_en", "high"), ("needs_review", "low")


def classify_page(url: Column, rules: tuple = PAGE_RULES, scope: str = PAGE_SCOPE, outside: tuple[str, str] = OUT_OF_SCOPE, default: tuple[str, str] = NO_RULE) -> Column:
    """struct<page_class, confidence> of a page by the first of `rules` that its path meets; `outside` where the path doesn't begin with `scope`."""
    p = F.lower(url_path(url))
    label = lambda kind, sure: F.struct(F.lit(kind).alias("page_class"), F.lit(sure).alias("confidence"))
    out = F.when(~F.startswith(p, F.lit(scope)), label(*outside))
    for groups, kind, sure in rules:
        out = out.when(reduce(Column.__and__, (_any(p, *parts) for parts in groups)), label(kind, sure))
    return out.otherwise(label(*default))


def relevance(text: Column, url: Column, keywords: tuple[str, ...], paths: tuple[str, ...], critical: tuple[str, ...]) -> Column:
    """Two points a keyword found in the text, ten for a path, fifteen for a critical word in the URL."""
    from ..functions.text import count_of

    low, u = F.lower(text), F.lower(url)
    return (sum((count_of(low, k) * 2 for k in keywords), F.lit(0)) + F.when(_any(u, *paths), 10).otherwise(0) + F.when(_any(u, *critical), 15).otherwise(0)).cast("int")


def topic_points(low: dict[str, Column], terms: tuple[str, ...], bonus: tuple[tuple[str, str, int], ...] = (), weights: tuple[tuple[str, int], ...] = (("title", 5), ("url", 5), ("text", 2))) -> Column:
    """Points of a page for a topic: `weights` for each term found in a part of the page, and `bonus` (part, pattern, points). low: the parts in lower case."""
    plain = (F.when(F.contains(low[part], F.lit(t)), n).otherwise(0) for t in terms for part, n in weights)
    more = (F.when(F.regexp_like(low[part], F.lit(p)), n).otherwise(0) for part, p, n in bonus)
    return sum((*plain, *more), F.lit(0)).cast("int")


def _named(texts: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """key and the columns of `aliases` of every alias that stands as whole words in a text, each once.

    texts: key, _t (words with single spaces); aliases: _a, alike. An equi-join on the whole alias: every text offers its
    runs of as many words as some alias has, so no text travels with its words and no pair is looked at in vain.
    """
    sizes = [r[0] for r in aliases.select(F.size(F.split("_a", " "))).distinct().collect()]  # a handful: the numbers of words of aliases
    runs = lambda w: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array(*(F.array_join(F.slice(w, i, F.lit(n)), " ") for n in sorted(sizes))))))
    if not sizes:
        return texts.select(key).limit(0).join(aliases, F.lit(True))
    own = texts.where("_t <> ''").select(key, F.explode(F.get(F.transform(F.array(F.split("_t", " ")), runs), F.lit(0))).alias("_a"))
    return own.join(aliases, "_a")


def exact_matches(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, score: the best name that stands as whole words in each text; longer than four letters scores 1, shorter 0.92.

    names: name, alias, ord (order of preference). Null and blank texts and aliases match nothing.
    """
    t = texts.select(key, match_form(text, True).alias("_t"))
    a = names.select("name", "ord", match_form("alias", True).alias("_a")).where("_a <> ''")
    score = F.when(F.char_length("_a") > 4, 1.0).otherwise(0.92)
    best = _named(t, a, key).groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("ord")).alias("o"), "name")).alias("b"))
    return best.select(key, "b.name", "b.score")


def longest_matches(texts: DataFrame, names: DataFrame, key: str, text: str, least: int = 4) -> DataFrame:
    """key, name, score: the name with the longest alias in each text; upper-case abbreviations score 100 more. names as in exact_matches."""
    t = texts.select(key, match_form(text).alias("_t"))
    upper = (F.upper("alias") == F.col("alias")) & F.regexp_like("alias", F.lit("[A-Z]"))
    a = names.select("name", "ord", upper.alias("_upper"), match_form("alias").alias("_a")).where(F.char_length("_a") >= least)
    score = F.char_length("_a") + F.when(F.col("_upper"), 100).otherwise(0)
    best = _named(t, a, key).groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("ord")).alias("o"), "name")).alias("b"))
    return best.select(key, "b.name", "b.score")


def contained(inner: DataFrame, outer: DataFrame, length: int = 6) -> DataFrame:
    """Distinct (inner, outer) of which the one is part of the other, at any place. An equi-join on the first letters, which every place of the outer text offers."""
    a = inner.where("inner <> ''").distinct().withColumn("_k", F.substring("inner", 1, length))
    at = F.sequence(F.lit(1), F.char_length("outer"))
    cuts = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda n: F.substring(F.col("outer"), i, n))))
    b = outer.where("outer <> ''").distinct().select("outer", F.explode(F.array_distinct(cuts)).alias("_k"))
    return a.join(b, "_k").where(F.contains("outer", F.col("inner"))).select("inner", "outer").distinct()


def page_matches(pages: DataFrame, programmes: DataFrame) -> DataFrame:
    """id, programme of the pages of each programme: of its name, with a name that contains it or is part of it, with an alias that is part of its name, or on its host.

    pages: id, title, url, aliases (array<string>); programmes: programme, url. A union of equi-joins.
    """
    p = programmes.select("programme", match_form("programme").alias("_p"), F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("_h")).distinct()
    s = pages.select("id", match_form(F.coalesce("title", F.lit(""))).alias("_t"), F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("_h"), "aliases")
    names, titles = p.select(F.col("_p").alias("inner")), s.select(F.col("_t").alias("outer"))
    around = contained(names, titles).select(F.col("inner").alias("_p"), F.col("outer").alias("_t"))
    within = contained(titles.toDF("inner"), names.toDF("outer")).select(F.col("outer").alias("_p"), F.col("inner").alias("_t"))
    named = s.select("id", "_t").join(around.unionAll(within).distinct(), "_t").select("id", "_p")
    alias = s.select("id", F.explode("aliases").alias("_a")).select("id", match_form("_a").alias("_a"))
    called = alias.join(contained(alias.select(F.col("_a").alias("inner")), names.toDF("outer")).toDF("_a", "_p"), "_a").select("id", "_p")
    by_name = named.unionAll(called).distinct().join(p.select("_p", "programme").distinct(), "_p").select("id", "programme")
    by_host = s.where("_h IS NOT NULL").select("id", "_h").join(p.where("_h IS NOT NULL").select("_h", "programme").distinct(), "_h").select("id", "programme")
    return by_name.unionAll(by_host).distinct()


_LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789äöüß"
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))


def _coded(t: str) -> np.ndarray:
    return _CODE[np.frombuffer(t.encode("utf-32-le"), np.uint32)]


class Catalogue:
    """Letter pairs, letter counts and lengths of aliases, for bounds on their likeness to runs of words."""

    def __init__(self, aliases: list[str]):
        n = len(_LETTERS)
        codes = [_coded(a) for a in aliases]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.counts = np.array([np.bincount(c, minlength=n) for c in codes], np.int32).reshape(-1, n)
        self.pairs = np.zeros((len(codes), n * n), np.int8)
        for i, c in enumerate(codes):
            self.pairs[i, c[:-1] * n + c[1:]] = 1

    def near(self, t: str, least: float, step: int = 1000, some: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Aliases, begins, ends and bounds of the runs of 3 to 9 words of `t` whose likeness may reach `least`; none that does is left out.

        Of two texts of together s letters of which m match, the blocks of matching letters are s - 2m + 1 at most, so
        3m - s - 1 letter pairs at least are shared; and no more letters match than both have.
        """
        c = _coded(t)
        gaps = np.flatnonzero(c == 0)
        begins, ends = np.r_[0, gaps + 1], np.r_[gaps, len(c)]
        n = len(begins)
        pair = c[:-1] * len(_LETTERS) + c[1:]
        for first in range(0, n, step):
            runs = [(begins[i], ends[i + k - 1]) for k in range(3, min(9, n) + 1) if len(i := np.arange(first, min(first + step, n - k + 1)))]
            if not runs:
                continue
            b, e = (np.concatenate(x) for x in zip(*runs))
            low, high = b[0], int(e.max())
            letters = np.zeros((high - low + 1, len(_LETTERS)), np.int32)
            letters[np.arange(1, high - low + 1), c[low:high]] = 1
            letters = letters.cumsum(0, dtype=np.int32)
            for at in range(0, len(self.lengths), some):
                own = slice(at, at + some)
                seen = np.zeros((len(self.lengths[own]), high - low), np.int32)
                np.cumsum(self.pairs[own][:, pair[low : high - 1]], axis=1, dtype=np.int32, out=seen[:, 1:])
                total = self.lengths[own][:, None] + (e - b)[None, :]
                m = np.ceil(least * total / 2 - 1e-9)
                i, r = np.nonzero((seen[:, e - 1 - low] - seen[:, b - low] >= 3 * m - total - 1) & (np.minimum(self.lengths[own][:, None], (e - b)[None, :]) >= m))
                for part in range(0, len(i), 1 << 16):
                    x, y = i[part : part + (1 << 16)], r[part : part + (1 << 16)]
                    bound = 2 * np.minimum(self.counts[own][x], letters[e[y] - low] - letters[b[y] - low]).sum(1) / total[x, y]
                    ok = bound >= least - 1e-9
                    yield x[ok] + at, b[y[ok]], e[y[ok]], bound[ok]


def fuzzy_matches(texts: DataFrame, names: DataFrame, key: str, text: str | Column, least: float = 0.78) -> DataFrame:
    """key, name, score: the alias of two or more words most like a run of 3 to 9 words of each text.

    names: name, alias, ord: a catalogue of any size; a small one is sent with the tasks, the blocks of a larger one are
    read by them from the shared folder. Every run is held against every alias by bounds that leave out none of the
    likeness asked for; ratios are those of matching blocks, ties go to the least ord, name and alias.
    """
    read = read_blocks(names.select("ord", "name", match_form("alias", True).alias("a")).where("a LIKE '% %'"))
    schema = T.StructType([texts.schema[key], T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[list[tuple], Catalogue]] = []
        for batch in it:
            texts_ = [t or "" for t in batch.column(1).to_pylist()]
            best: list[tuple[float, tuple] | None] = [None] * len(texts_)
            matcher = SequenceMatcher(None, "", "", autojunk=True)
            for n, block in enumerate(read()):
                if n < len(known):
                    aliases, catalogue = known[n]
                else:
                    aliases = sorted(zip(*(c.to_pylist() for c in block.columns), strict=True))
                    catalogue = Catalogue([a for _, _, a in aliases])
                    if n == len(known) < 4:  # so many blocks are kept between batches
                        known.append((aliases, catalogue))
                for row, t in enumerate(texts_):
                    top = best[row]
                    for near, begins, ends, bounds in catalogue.near(t, least):
                        tried = set()
                        for j in np.lexsort((near, -bounds)).tolist():  # the best bound first
                            if top and bounds[j] < top[0] - 1e-9:
                                break
                            i, own = int(near[j]), t[begins[j] : ends[j]]
                            if (i, own) in tried:
                                continue
                            tried.add((i, own))
                            matcher.set_seqs(aliases[i][2], own)
                            if (r := matcher.ratio()) >= least and (top is None or r > top[0] or r == top[0] and aliases[i] < top[1]):
                                top = (r, aliases[i])
                    best[row] = top
            at = [i for i, b in enumerate(best) if b]
            got = [best[i][1][1] for i in at]
            scores = [round(best[i][0], 6) for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(got, pa.string()), pa.array(scores, pa.float64())], names=schema.fieldNames())

    return texts.select(key, match_form(text, True).alias("_t")).mapInArrow(run, schema)


# What is said of a draft without topics, without documents, without citations, with wrong ones, and the
# weights of documents, topics, citations and right citations in the confidence.
DRAFT_REASONS = ("No topics detected", "No evidence documents retrieved", "No citations in draft", "Draft contains invalid citation numbers")
DRAFT_WEIGHTS = (0.35, 0.2, 0.25, 0.2)


def check_draft(draft: Column, n_docs: Column, n_topics: Column, unsupported: tuple[str, ...], claim_reason: str = "Draft contains an unsupported statement") -> Column:
    """struct of a draft's checks: citation_count, citations_valid, is_grounded, confidence, review_reason."""
    cited = F.array_distinct(F.transform(all_matches(draft, r"\[Doc ([0-9]+)\]", 1), lambda x: x.cast("int")))
    some = F.size(cited) > 0
    valid = some & F.forall(cited, lambda c: (c >= 1) & (c <= n_docs))
    claims = F.exists(F.array(*map(F.lit, unsupported)), lambda p: F.contains(F.lower(draft), p))
    wrong = (n_topics == 0, n_docs == 0, ~some, some & ~valid, claims)
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in zip(wrong, (*DRAFT_REASONS, claim_reason), strict=True))))
    conf = sum((F.when(c, F.lit(w)).otherwise(0.0) for c, w in zip((n_docs > 0, n_topics > 0, some, valid), DRAFT_WEIGHTS, strict=True)), F.lit(0.0))
    return F.struct(F.size(cited).alias("citation_count"), valid.alias("citations_valid"), ((n_docs > 0) & valid).alias("is_grounded"), F.round(conf, 2).alias("confidence"), F.array_join(reasons, "; ").alias("review_reason"))


def rewrite_references(text: Column, urls: Column) -> Column:
    """`(source web - N)` as the N-th URL in brackets; unknown numbers stay. urls: array<string>.

    Built from the pieces between the references, without Python.
    """
    pattern = r"(?i)\(source\s+web\s*-\s*([0-9]+)\)"
    pieces, refs, nums = F.split(text, pattern), all_matches(text, pattern), all_matches(text, pattern, 1)
    named = F.transform(nums, lambda n, i: F.coalesce(F.concat(F.lit("("), F.get(urls, n.cast("int") - 1), F.lit(")")), F.get(refs, i)))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.coalesce(F.when(i > 0, F.get(named, i - 1)), F.lit("")), p)), "")
