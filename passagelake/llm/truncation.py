"""Problem 10: texts cut off by field limits or in transfer.

Lengths are recomputed as other encodings and escapings would have stored them; a length at which one source has a spike
is a hidden limit, and so is one below which the texts that go on with a mark of a cut pile up. A text at a limit whose
ending is open was cut there, whatever its last words. The endings of all others are inspected: after whatever was put
behind a cut is taken off, an ending without a final mark is held against how often, over all texts, a line of its kind
ends or goes on after the same words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

#: What programs put after a cut.
MARKER = r"(?:\[(?:…|\.{3}|more|mehr|weiter(?:lesen)?|truncated|gekürzt|cut)\]?|\((?:…|\.{3}|more|mehr|weiter(?:lesen)?)\)|(?:…|\.{3})\s*(?:\(?(?:more|mehr|weiterlesen|read more|read on)\)?)?|\b(?:read more|read on|show more|continue reading|weiterlesen|mehr lesen|mehr anzeigen|weiter lesen)(?:\s*(?:…|\.{3}|»|>>?))?|<[A-Za-z/!][^<>\n]{0,30}>?|<|&#?[A-Za-z0-9]{0,8};?|�)$"
#: Marks that end a sentence, with closing quotes and brackets behind them.
TERMINAL = r"[.!?…][\"'”“»«’)\]]*$"
#: Final points that end no sentence: ordinals, abbreviations and split numbers.
OPEN_POINT = r"(?:(?:\b(?:am|vom|zum|ab|bis|dem|den|der|um|von|zwischen|und|between|from|at|until|EUR|Euro|insgesamt|Modul|Module|module|version|Version)\s+[A-Z]?\d{1,3}|\b(?:Mr|Mrs|Ms|Dr|Prof|Nr|No|Str|bzw|ca|z\.\s?B|d\.\s?h|e\.g|i\.e|vgl|inkl|St))\.)$"
#: A line that is complete as it stands: an address on the web, or a remark in brackets behind a finished sentence.
CLOSED_LINE = r"(?:^\s*(?:https?://|www\.)\S+$)|(?:[.!?][\"'”“»)]*\s+\([^()\n]{1,60}\)$)"


#: No single marker is longer; there may be any number of them.
_LONGEST = 64
#: So many keys of copies are broadcast at most, after they are counted.
BROADCAST_KEYS = 500_000
#: Counts are handed on from a task when it holds so many.
_HELD = 400_000
_MARKER, _TERMINAL, _OPEN_POINT, _CLOSED = re.compile(MARKER, re.I), re.compile(TERMINAL), re.compile(OPEN_POINT), re.compile(CLOSED_LINE)
_DIGITS = re.compile("[0-9]+")
_ITEM = re.compile(r"\s*(?:[-*•»>–]|\d+[.)])\s")
_SENTENCES = re.compile(r"[.!?][\"”)]?\s+\S")
_BASE = 0x100000001B3
#: A program that cuts between words stops within so many characters of its limit.
REACH = 16
MEASURES = ("chars", "bytes", "utf16", "html", "html_bytes", "html_named", "json", "json_utf8", "crlf", "crlf_bytes")


def lengths(t: str) -> list[int]:
    """Lengths of a text as different storages would count it, in the order of MEASURES."""
    chars, byte = len(t), len(t.encode("utf-8", "surrogatepass"))
    utf16 = len(t.encode("utf-16-le", "surrogatepass")) // 2
    amp, angle, quote = t.count("&"), t.count("<") + t.count(">"), t.count('"')
    html = chars + 4 * amp + 3 * angle + 5 * quote
    breaks = t.count("\n") - t.count("\r\n")
    escapes = quote + t.count("\\") + t.count("\n") + t.count("\r") + t.count("\t")
    wide = chars - len(t.encode("ascii", "ignore"))
    named = 5 * sum(map(t.count, "äöüÄÖÜ")) + 6 * t.count("ß")
    return [chars, byte, utf16, html, byte + html - chars, html + named, chars + escapes + 5 * wide, byte + escapes, chars + breaks, byte + breaks]


def without_marker(t: str) -> str:
    """The text without white space at its end and what programs put behind a cut, taken off from the end one by one."""
    end = len(t)
    while True:
        while end and t[end - 1].isspace():
            end -= 1
        if not (m := _MARKER.search(t, max(0, end - _LONGEST), end)) or m.start() == end:
            return t[:end]
        end = m.start()


def kind_of(line: str) -> str:
    """T: a table's row; L: a list item; S: a line with a finished sentence; P: any other."""
    return "T" if " | " in line else "L" if _ITEM.match(line) else "S" if _SENTENCES.search(line) else "P"


def prefix_hashes(word: str) -> np.ndarray:
    """64-bit hashes of the word's prefixes of 1, 2, ... letters, the last of the whole word, in time linear in its length."""
    c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power = np.full(len(c), _BASE, np.uint64)
    if len(c):
        power[0] = 1
    h = np.cumsum((c + np.uint64(1)) * np.cumprod(power)) + np.arange(1, len(c) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _prefixes(words: DataFrame) -> DataFrame:
    """wh: hashes of all proper prefixes of the words of a frame of one column."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 4096):
                own = [prefix_hashes(w)[:-1] for w in b.column(0).slice(at, 4096).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)))], ["wh"])

    return words.mapInArrow(run, "wh long").distinct()


def endings(docs: DataFrame, key: str) -> DataFrame:
    """One row a text: `key`, source, h (hash of the text), open_end, what its last line is and ends with, marked, lens (by MEASURES).

    open_end: without what follows a cut, the text does not end with a final mark or a line that is complete as it stands.
    marked: the characters before what follows a cut, null if nothing does.
    """
    text = T.StringType()
    schema = T.StructType([docs.schema[key], T.StructField("source", text), T.StructField("h", T.BinaryType()), T.StructField("open_end", T.BooleanType()), T.StructField("kind", text), T.StructField("w2", text), T.StructField("w1", text), T.StructField("wh", T.LongType()), T.StructField("head", text), T.StructField("split_point", T.BooleanType()), T.StructField("bracket", T.BooleanType()), T.StructField("marked", T.IntegerType()), T.StructField("lens", T.ArrayType(T.IntegerType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple] = []
            for t in b.column(2).to_pylist():
                body = without_marker(t)
                last = body.rpartition("\n")[2]
                point = bool(_OPEN_POINT.search(last))
                open_ = bool(body) and not (_TERMINAL.search(last) and not point) and not _CLOSED.search(last)
                marked = len(body) if len(body) < len(t.rstrip()) else None
                h, lens = xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass")), lengths(t)
                if open_:
                    w = _DIGITS.sub("0", last).split()
                    rows.append((h, True, kind_of(last), w[-2] if len(w) > 1 else "^", w[-1] if w else "", int(prefix_hashes(w[-1])[-1]) if w else 0, " ".join(w[:2]), point, last.count("(") > last.count(")"), marked, lens))
                else:
                    rows.append((h, False, None, None, None, None, None, False, False, marked, lens))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 11
            kinds = [pa.binary(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=schema.fieldNames())

    return docs.where("text IS NOT NULL").select(key, "source", "text").mapInArrow(run, schema)


def word_ends(texts: DataFrame) -> DataFrame:
    """kind, w2, w1, n_on, n_end, n_last over `texts` (one column, text): per kind of line and pair of neighbouring words how often the second goes on, ends a line inside a text, or ends the text.

    Rows of kind H hold in w2 the first two words of lines of kind P inside a text: n_end lines without, n_last with a final mark.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, Counter] = defaultdict(Counter)
        ends: dict[str, Counter] = defaultdict(Counter)
        lasts: dict[str, Counter] = defaultdict(Counter)
        opened: Counter = Counter()
        closed: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(k, a, b, n - ends[k][a, b] - lasts[k][a, b], ends[k][a, b], lasts[k][a, b]) for k, c in pairs.items() for (a, b), n in c.items()]
            rows += [("H", h, "", 0, opened[h], closed[h]) for h in opened.keys() | closed.keys()]
            for c in (pairs, ends, lasts, opened, closed):
                c.clear()
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], k) for c, k in zip(cols, [pa.string()] * 3 + [pa.int64()] * 3, strict=True)], names=["kind", "w2", "w1", "n_on", "n_end", "n_last"])

        for b in it:
            for t in b.column(0).to_pylist():
                lines = [x for x in _DIGITS.sub("0", without_marker(t)).split("\n") if x.strip()]
                for i, line in enumerate(lines):
                    k, w = kind_of(line), line.split()
                    pairs[k].update(zip(["^", *w[:-1]], w, strict=True))
                    pair = (w[-2] if len(w) > 1 else "^", w[-1])
                    if i == len(lines) - 1:
                        lasts[k][pair] += 1
                    else:
                        ends[k][pair] += 1
                        if k == "P":
                            (closed if _TERMINAL.search(line.rstrip()) else opened)[" ".join(w[:2])] += 1
            if sum(map(len, pairs.values())) > _HELD:
                yield from flush()
        yield from flush()

    counts = texts.select("text").mapInArrow(run, "kind string, w2 string, w1 string, n_on long, n_end long, n_last long")
    return counts.groupBy("kind", "w2", "w1").agg(*(F.sum(c).alias(c) for c in ("n_on", "n_end", "n_last")))


def _limits(ends: DataFrame, least: int, share: float) -> DataFrame:
    m = F.arrays_zip(F.array(*map(F.lit, MEASURES)).alias("measure"), F.col("lens").alias("len"))
    one = ends.groupBy("source", "h").agg(F.any_value("lens").alias("lens"), F.max("open_end").alias("open_end"), F.any_value("marked").alias("marked"))
    sizes = one.groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    per = one.select("source", "open_end", F.explode(F.array_append(F.transform(m, lambda x: F.struct(x["measure"].alias("measure"), x["len"].alias("len"))), F.when(F.col("marked").isNotNull(), F.struct(F.lit("before_mark").alias("measure"), F.col("marked").alias("len"))))).alias("x")).where("x IS NOT NULL")
    per = per.groupBy("source", F.col("x.measure").alias("measure"), F.col("x.len").alias("len")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("open_end").alias("open_docs"))
    w = Window.partitionBy("source", "measure").orderBy("len")  # as many rows as a source has lengths
    within = lambda a, b, c="n_docs": F.coalesce(F.sum(c).over(w.rangeBetween(a, b)), F.lit(0))
    soft = F.col("measure") == "before_mark"
    per = per.select(
        "source", "measure", F.col("len").alias("limit_len"),
        F.when(soft, within(1 - REACH, 0)).otherwise(F.col("n_docs")).alias("n_docs"),
        F.when(soft, within(1 - REACH, 0, "open_docs")).otherwise(F.col("open_docs")).alias("open_docs"),
        F.when(soft, within(1 - 2 * REACH, REACH)).otherwise(within(-10, 10)).alias("around"))
    near = per.where((F.col("n_docs") >= least) & (F.col("open_docs") * 2 > F.col("n_docs")) & (F.col("n_docs") * 2 > F.col("around")))
    return near.join(sizes, near["source"].eqNullSafe(sizes["source"])).where(F.col("n_docs") >= share * F.col("texts")).select(near["source"], "measure", "limit_len", "n_docs", "open_docs")


def hidden_limits(docs: DataFrame, key: str = "doc_id", least: int = 5, share: float = 0.01) -> DataFrame:
    """source, measure, limit_len, n_docs, open_docs: lengths that at least `least` distinct texts and `share` of a source's have exactly, most of them without an end and more than have the 20 lengths around it.

    Measure before_mark: lengths within REACH below which so many texts stop, before a mark of a cut, as programs cut that
    spare whole words; more than in twice the reach around.
    """
    return _limits(endings(docs, key), least, share)


def truncated(docs: DataFrame, key: str = "doc_id", ends: float = 0.3, least: int = 5, share: float = 0.01) -> DataFrame:
    """`key`, source and at_limit of the documents whose text was cut.

    docs: `key` (unique), source, text. A text is cut if it ends without a final mark at a hidden limit of its source
    (least, share: see hidden_limits), or if, without what programs put behind a cut, it ends in a word no other text has
    that starts a longer known word, or after words with which fewer than `ends` of the lines of its kind end. Null and
    blank texts are no cases; sources may be null; copies are counted once in the statistics and each reported; extra
    columns are ignored.
    """
    d = docs.select(key, "source", "text").where("text IS NOT NULL")
    own = cut(endings(d, key))  # small rows; the texts are read once more, for the counts
    limits = _limits(own, least, share).where("source IS NOT NULL").groupBy("source").agg(F.collect_list(F.struct("measure", F.col("limit_len").alias("len"))).alias("limits"))  # at most 1 / share a measure
    order = F.array(*map(F.lit, MEASURES))
    at = F.exists("limits", lambda x: F.when(x["measure"] == "before_mark", F.coalesce(F.col("marked").between(x["len"] + 1 - REACH, x["len"]), F.lit(False))).otherwise(F.get(F.col("lens"), (F.array_position(order, x["measure"]) - 1).cast("int")) == x["len"]))
    open_ = cut(own.where("open_end").join(limits, "source", "left").withColumn("at_limit", F.coalesce(at, F.lit(False))).drop("limits", "lens", "marked", "open_end"))
    by_limit, rest = open_.where("at_limit"), open_.where("NOT at_limit")

    copies = own.groupBy("h").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = cut(own.select(key, "h").join(copies.select("h", "first"), "h").where(F.col(key) != F.col("first")).select(key))
    n = again.count()
    distinct = d if not n else d.join(F.broadcast(again) if n <= BROADCAST_KEYS else again, key, "left_anti")  # beyond that the texts are shuffled
    stats = cut(word_ends(distinct))
    heads = stats.where("kind = 'H'").select(F.col("w2").alias("head"), F.col("n_end").alias("n_open"), F.col("n_last").alias("n_closed"))
    stats = stats.where("kind <> 'H'")
    single = stats.groupBy("kind", "w1").agg(F.sum("n_on").alias("u_on"), F.sum("n_end").alias("u_end"), F.sum("n_last").alias("u_last"))
    known = single.groupBy("w1").agg((F.sum("u_on") + F.sum("u_end")).alias("inside"))
    longer = known.where("inside >= 2").select(F.regexp_replace("w1", r"[\p{P}\p{S}]+$", "").alias("w1")).where(F.char_length("w1") > 1)
    prefixes = _prefixes(longer).withColumn("is_prefix", F.lit(True))
    what = ["kind", "w2", "w1", "wh", "head", "split_point", "bracket"]
    forms = rest.groupBy(*what).agg(F.count(F.lit(1)).alias("_n")).drop("_n")  # endings, each once
    j = forms.join(stats, ["kind", "w2", "w1"], "left").join(single, ["kind", "w1"], "left").join(known, "w1", "left").join(prefixes, "wh", "left").join(heads, "head", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    pair, alone = z("n_on") + z("n_end"), z("u_on") + z("u_end")
    begun = z("n_open") + z("n_closed")
    headless = (F.col("kind") == "P") & (begun >= 3) & (z("n_open") < 0.1 * begun)  # lines that begin so are sentences
    heading = (F.col("kind") == "P") & (begun >= 3) & (z("n_closed") < 0.1 * begun)  # lines that begin so never are
    of_word = F.when(alone >= 3, z("u_end") / alone).when(F.col("kind") == "S", 0.0).otherwise(0.5)
    mixed = (z("n_end") + 2 * of_word) / (pair + 2)
    own_word = F.col("is_prefix").isNull() | ~F.regexp_like("w1", F.lit(r"\p{L}"))
    chance = (
        F.when(F.col("split_point") | F.col("bracket"), 0.0)
        .when((pair == 0) & own_word & ((z("n_last") >= 5) | (z("inside") == 0) & (z("u_last") >= 5)), 1.0)
        .when((F.col("kind") == "T") & (z("n_on") == 0) & own_word, 1.0)  # the last cell of a row
        .when(headless, 0.0)
        .when((pair == 0) & (F.col("w2") == "^") & (F.col("kind") == "P") & own_word & (z("inside") >= 2), 1.0)  # a known word on a line of its own, as signers' names are
        .when((z("inside") >= 2) & (heading | (F.col("kind") == "T")), F.least(F.lit(1.0), 4 * mixed))
        .when((pair > 0) | (z("inside") >= 2), mixed)
        .when(~own_word | (F.col("kind") == "S"), 0.0)
        .otherwise(1.0)
    )
    unfinished = j.where(chance < ends).select(*what)
    by_ending = rest.join(unfinished, what, "left_semi")  # none of these is null in an open ending
    return by_limit.select(key, "source", "at_limit").unionAll(by_ending.select(key, "source", "at_limit"))


def truncation_by_source(docs: DataFrame, found: DataFrame) -> DataFrame:
    """source, docs, truncated, share; a null source is a group of its own."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    c = found.groupBy("source").agg(F.count(F.lit(1)).alias("truncated"))
    return n.join(c, n["source"].eqNullSafe(c["source"]), "left").select(n["source"], "docs", F.coalesce("truncated", F.lit(0)).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("docs")).alias("share"))
