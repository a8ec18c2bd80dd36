"""Problem 5: the main body of a page, by a recurrent block labeller.

Every non-blank line of a page is a block. A bidirectional LSTM, written in numpy, reads for each block a vector of its
layout path (bullet, indent, separators, case, blank lines around it; the texts have no tags left), all its hashed words and
a few measures, and labels all blocks of the page with the whole page as context. It is trained on a bounded sample of
pages that a seed labeller has marked: words of consent, law, sharing and the like, lines repeated on the site, menus
learned from separator lines, and titles told from list items by their words. The lexicons of the seed labeller are no
input of the network, which knows a block by its words, its layout and its neighbours only. The words of menus, titles and
items are counted over all pages. No page or block is cut for reading or labelling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import bounded_sample

SAMPLE = 1500  # pages the labeller is trained on at most
WORDS, PATHS, EMBED, HIDDEN, DENSE = 4096, 512, 16, 20, 12
ODDS = 1 << 16  # buckets of the words of titles and items

# Words of page furniture in English and German.
_CHROME = re.compile(
    r"^\W*(?:(?:skip|jump) to|zum (?:inhalt|hauptinhalt|menü)|zur (?:navigation|startseite)|back to top|nach oben|seitenanfang|toggle navigation|menu|menü|navigation|print(?: version| this page)?|druck(?:version|ansicht|en)|"
    r"(?:de|en|fr|es)(?:\W+(?:de|en|fr|es))+$|deutsch\W+english|english\W+deutsch|"
    r"(?:we|wir|this (?:web)?site|diese (?:web)?seite|diese website|your (?:choice|privacy)|ihre (?:wahl|privatsphäre))\b.{0,60}\b(?:cookies?|store|speicher\w*|statisti\w+|small files|tracking|improve these|diese seite zu verbessern)|.{0,40}\bcookies? (?:settings|policy|einstellungen|richtlinie)|accept(?: all| cookies)?$|alle (?:akzeptieren|cookies)|akzeptieren$|only necessary|nur notwendige|mehr erfahren$|learn more$|settings$|einstellungen$|ok,? (?:got it|verstanden)|agree\b.{0,12}decline|ablehnen\b.{0,12}zustimmen|got it$|embedded (?:video|content|map)|eingebettet\w+ |load (?:video|map|content)|video laden|by loading it|"
    r"imprint|impressum|privacy|datenschutz(?:erklärung)?$|accessibility\W*$|barrierefreiheit$|legal notice|terms of|nutzungsbedingungen|agb$|©|\(c\) ?\d|copyright|all rights reserved|alle rechte|no liability|keine haftung|alle angaben|all information without|es gilt die jeweils|"
    r"share (?:this|on)|shared \d|seite (?:teilen|empfehlen|drucken)|artikel (?:empfehlen|teilen|drucken)|teilen(?:\W|$)|like what you|tell your friends|send by (?:e-?)?mail|link kopieren|was this (?:page|article) helpful|war diese seite hilfreich|follow us|folgen sie uns|facebook|instagram|twitter|linkedin|"
    r"(?:subscribe|sign up)\b.*newsletter|newsletter\b|(?:phone|tel|telefon|fax|e-?mail)\b[.:]?\s*[+(\d]|contact (?:the|us)\b|kontakt(?:ieren)?\b.{0,30}$|contact$|"
    r"(?:last (?:updated|modified|edited|changed)|updated (?:on|by)|edited\s+by|page maintained\s+by|zuletzt (?:geändert|aktualisiert)|letzte (?:änderung|aktualisierung)|aktualisiert am|stand)\b|(?:photo|foto|image|bild|text|redaktion|author|autor(?:in)?|credits?|quelle)\s*:|by the .{0,30}(?:desk|team|unit)|von der redaktion|(?:tags?|schlagw\w+|keywords|topics|themen)\s*:|"
    r"(?:sie sind hier|you are here|breadcrumb)\b)",
    re.I,
)
_TEASER_HEAD = re.compile(r"^\W*(?:related (?:pages|links|topics|content|articles)|more on this topic|more (?:news|topics|links)|see also|siehe auch|weitere (?:themen|links|seiten|informationen|meldungen|artikel)|weiterführende\b.*|quick ?links?|mehr zum thema|ähnliche (?:seiten|themen)|das könnte sie.*|you (?:may|might) also.*|upcoming (?:dates|events)|aktuelle(?:s| meldungen| termine| nachrichten)?|(?:latest |current )?news(?: box)?|neuigkeiten|meldungen|termine|veranstaltungen|events|dates|read more|links)\W*$", re.I)
_TEASER_MARK = re.compile(r"^\s*(?:[>»›→]|read on\b|weiterlesen\b|mehr:|lesen sie)\s*:?", re.I)
_DATE = r"(?:\d{4}-\d\d?-\d\d?|\d{1,2}\.\d{1,2}\.(?:\d{2,4})?|\d{1,2}(?:\.|st|nd|rd|th)?\s+[A-Za-zä]{3,9}(?:\s+\d{4})?|[A-Z][a-zä]{2,8}\s+\d{1,2}(?:,?\s+\d{4})?)"
_NEWS = re.compile(rf"^\s*{_DATE}\s*[:–-]?\s+\S.*")
_MORE = re.compile(r"(?:\.\.\.|…|\[)\s*(?:more|mehr|read more|weiterlesen)\]?\s*$", re.I)
_SITE = re.compile(r"\b(?:university|universität|hochschule|college|institute|akademie|academy)\b.{0,40}(?:[-–,]\s|\d{4,5}\b)|\b\d{5} [A-ZÄÖÜ]\w+\s*$", re.I)
_SEP = re.compile(r"\s+[|·/>»›•–-]\s+|\s{2,}|\t")
_BULLET = re.compile(r"^\s*(?:([-*•–])|\d+[.)])\s+")
_PROSE_END = re.compile(r"[.!?][\"”“»)]?\s*$")


_BLANKS = re.compile(r"[\s\x85\xA0]+")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def _norm(s: str | None) -> str:
    return " ".join((s or "").split()).lower()


def _words(s: str) -> list[str]:
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(s.lower())]


class _Crcs(dict):
    """crc32 and bytes of words, kept until there are too many."""

    def __missing__(self, w: str) -> tuple[int, bytes]:
        if len(self) > 200_000:
            self.clear()
        b = w.encode()
        self[w] = out = (crc32(b), b" " + b)
        return out


_CRC = _Crcs()
_FIRST = crc32(b"^")


@dataclass
class Seeds:
    """What is learned from all pages: words of menus, and log-odds of words in titles against list items, in ODDS hash buckets."""

    menu: frozenset[str]
    odds: np.ndarray


def _title_buckets(w: list[str], s: str) -> set[int]:
    """Hash buckets of the words of a line, its pairs of words, its first word, and whether it has a comma or a colon."""
    known = [_CRC[x] for x in w]
    out = {crc % ODDS for crc, _ in known}
    out.update([crc32(b, crc) % ODDS for (crc, _), (_, b) in zip(known, known[1:])])
    out.add(crc32(known[0][1][1:], _FIRST) % ODDS if known else _FIRST % ODDS)
    if "," in s:
        out.add(crc32(b",") % ODDS)
    if ": " in s:
        out.add(crc32(b":") % ODDS)
    return out


def titleness(s: str, seeds: Seeds) -> float:
    """Log-odds that a short line is a page's title and no list item."""
    return float(sum([seeds.odds[k] for k in _title_buckets(_words(s), s)]))


def _key_column(c: Column) -> Column:
    """_title_keys as hash buckets, each once."""
    low = F.regexp_replace(F.lower(c), "[0-9]+", "0")
    one = lambda w: F.concat(F.transform(w, lambda x: x), F.array(F.concat(F.lit("^"), F.coalesce(F.get(w, F.lit(0)), F.lit("")))), F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)), F.array(F.when(F.contains(c, F.lit(",")), ","), F.when(F.contains(c, F.lit(": ")), ":")))
    keys = F.get(F.transform(F.array(F.regexp_extract_all(low, F.lit(r"\p{L}+|[0-9]+"), F.lit(0))), one), F.lit(0))
    return F.array_distinct(F.transform(F.array_compact(keys), lambda k: F.pmod(F.crc32(k.cast("binary")), F.lit(ODDS))))


def learn_seeds(df: DataFrame, text: str, heading: str, rare: float = 1e-5) -> Seeds:
    """Counts over all pages, by Spark: parts of separator lines standing in at least three lines and `rare` of all pages, and words of titles and items. To the driver come at most 2 * ODDS numbers and some 1 / rare parts."""
    pages = df.select(F.col(text).alias("_t"), F.col(heading).alias("_h"))
    n = pages.count()
    lines = pages.select(F.explode(F.split("_t", "\n")).alias("x")).select(F.trim(F.regexp_replace("x", r"\r$", "")).alias("x"))
    parts = F.filter(F.split("x", _SEP.pattern), lambda p: F.trim(p) != "")
    menus = lines.where(F.regexp_like("x", F.lit(r"(?:[|·/>»›•–-]|  |\t).*(?:[|·/>»›•–-]|  |\t).*(?:[|·/>»›•–-]|  |\t)")) & ~F.regexp_like("x", F.lit("[0-9,]"))).select(parts.alias("p"))
    menus = menus.where((F.size("p") >= 5) & F.forall("p", lambda p: F.char_length(p) <= 25)).select(F.explode(F.array_distinct(F.transform("p", lambda p: F.lower(F.regexp_replace(F.trim(p), r"\s+", " "))))).alias("p"))
    menu = [r["p"] for r in menus.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 3) & (F.col("n") >= rare * n)).collect()]
    items = lines.where(F.startswith("x", F.lit("*")) | F.startswith("x", F.lit("•"))).select(F.lit(1).alias("k"), F.explode(_key_column(F.regexp_replace("x", r"^[*•]\s+", ""))).alias("b"))
    titles = pages.where("_h IS NOT NULL").select(F.lit(0).alias("k"), F.explode(_key_column(F.col("_h"))).alias("b"))
    counts = np.zeros((2, ODDS))
    for r in titles.unionAll(items).groupBy("k", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["k"], r["b"]] = r["n"]
    odds = np.log((counts[0] + 0.5) / (counts[0].sum() + 1)) - np.log((counts[1] + 0.5) / (counts[1].sum() + 1))
    return Seeds(frozenset(menu), np.where(counts.sum(0) >= 3, odds, 0.0))


def seed_labels(blocks: list[str], heading: str | None, repeated: list[bool], seeds: Seeds) -> list[int]:
    """1 for blocks taken as main content, from lexicons, repetition and a walk down the page."""
    n, title = len(blocks), _norm(heading)
    kinds = []
    for x, rep in zip(blocks, repeated, strict=True):
        s, low = x.strip(), _norm(x)
        parts = [p for p in _SEP.split(s) if p]
        prose = len(s) >= 40 and bool(_PROSE_END.search(s))
        if title and low == title:
            kinds.append("title")
        elif _TEASER_HEAD.match(s):
            kinds.append("head")
        elif _CHROME.match(s) or low in seeds.menu or len(parts) >= 3 and all(_norm(p) in seeds.menu for p in parts[:2]) or _SITE.search(s) and not prose:
            kinds.append("chrome")
        elif title and len(parts) >= 2 and _norm(parts[-1]) == title:
            kinds.append("chrome")
        elif _TEASER_MARK.match(s):
            kinds.append("teaser")
        elif _MORE.search(s):
            kinds.append("news")
        elif rep:
            kinds.append("chrome")
        elif prose:
            kinds.append("prose")
        elif (m := _BULLET.match(s)) and m[1] != "-" and m[1] != "–":
            kinds.append("item")
        elif len(s.split(" | ")) >= 2:
            kinds.append("row")
        elif _NEWS.match(s) and titleness(re.sub(rf"^\s*{_DATE}", "", s), seeds) > 0:
            kinds.append("dated")
        else:
            kinds.append("dash" if _BULLET.match(s) else "short")
    out, state, body = [0] * n, "out", ("prose", "item", "row")
    for i, k in enumerate(kinds):
        if k in ("title", "prose", "item", "row"):
            out[i], state = 1, "main"
        elif k in ("chrome", "teaser", "news"):
            if k != "chrome":
                state = "teaser"
        elif k == "head":
            state = "teaser"
        elif k == "dated":
            out[i] = int(state == "main")
        else:
            score = titleness(_BULLET.sub("", blocks[i]), seeds)
            nearest = kinds[i + 1] if i + 1 < n else "end"
            last = kinds[i - 1] if i else "start"
            following = next((kinds[j] for j in range(i + 1, n) if kinds[j] not in ("short", "dash")), "end")
            listed = bool(re.search(r",|\d|\(", blocks[i]))
            if state == "teaser":
                # a title without a mark before the body goes on is a teaser more often than a heading
                out[i] = int(score < -2 and (listed or nearest in body))
            elif k == "dash":
                out[i] = int(state == "main" or nearest in body or following in body)
            elif nearest in body or nearest in ("short", "dash") and following in body:  # a heading, or an item before others
                out[i] = 1
            else:
                out[i] = int(state == "main" and (listed or "short" in (last, nearest) or last in ("item", "row", "dash")))
            state = "main" if out[i] else state
    return out


def form_hash(x: str) -> int:
    """The hash under which sitelines counts a line, as Spark has it."""
    f = re.sub("[0-9]+", "0", _BLANKS.sub(" ", x).strip(" ").lower())
    h = xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class Reader:
    """Turns pages into what the network reads. What a line shows by itself is kept for as many lines as fit, as the same ones come again."""

    def __init__(self, seeds: Seeds, most: int = 65_536):
        self.seeds, self.most, self.odds = seeds, most, seeds.odds.tolist()
        self.seen: dict[str, int] = {}
        self.lows: list[str] = []
        self.sets: list[frozenset[str]] = []
        self.words: list[np.ndarray] = []
        self.rows: list[tuple[float, ...]] = []
        self.forms: list[int | None] = []
        self.paths: list[tuple[int, int]] = []

    def _add(self, x: str) -> int:
        s = x.strip()
        low = _norm(s)
        found = _WORD.findall(low)
        digits = 0
        w = []
        for t in found:
            if t[0].isdigit():
                digits += len(t)
                t = "0"
            w.append(t)
        m = _BULLET.match(s)
        bare = s[m.end() :] if m else s
        own = w if not m or m[1] else w[1:]  # without the number of a numbered item
        self.lows.append(low)
        self.sets.append(frozenset(w))
        self.forms.append(form_hash(x) if len(w) > w.count("0") else None)
        self.words.append(np.array([_CRC[t][0] % WORDS for t in w] + [(crc32(_CRC[w[0]][1][1:], _FIRST) if w else _FIRST) % WORDS], np.int64))
        n = len(s)
        odds = self.odds
        self.rows.append((
            float(np.log1p(n) / 5), float(np.log1p(len(w)) / 3), float(bool(_PROSE_END.search(s))), float(bool(m)), float(" | " in s), digits / max(n, 1), float(s.isupper()),
            float(np.tanh(sum([odds[k] for k in _title_buckets(own, bare)]) / 4)), float(low in self.seeds.menu)))
        front = f"{'t' if x[:1] == chr(9) else ' ' if x[:1] == ' ' else ''}/{(m[1] or '1') if m else s[:1] if not s[:1].isalnum() else 'w'}/{min(len(_SEP.findall(s)), 3)}/{'U' if s.isupper() else 'l' if s.islower() else 'm'}/"
        back = f"/{s[-1:] if s[-1:] in '.:!?,)]' else ''}/{min(n // 20, 5)}"
        self.paths.append((crc32(front.encode()), crc32(back.encode())))
        self.seen[x] = len(self.lows) - 1
        return len(self.lows) - 1

    def read(self, pages: list[tuple[list[str], str | None, list[bool] | frozenset[int], list[bool]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Blocks, heading, repeated (of each block, or the hashes of what is repeated on the site) and blank_before of each page; out come, of the blocks of all pages in a row: measures, hashed words (all in a row) with their number a block, paths, then the number of each block's line among those kept, and the blocks a page."""
        if len(self.seen) > self.most:
            self.__init__(self.seeds, self.most)
        at: list[int] = []
        same: list[float] = []
        again: list[bool] = []
        shared: list[float] = []
        for blocks, heading, rep, _ in pages:
            own = [i if (i := self.seen.get(x)) is not None else self._add(x) for x in blocks]
            title = _norm(heading)
            tw = frozenset(_words(title))
            at += own
            again += [self.forms[i] in rep for i in own] if isinstance(rep, frozenset) else rep
            same += [float(bool(title) and self.lows[i] == title) for i in own]
            shared += [len(tw & self.sets[i]) / len(tw) for i in own] if tw else [0.0] * len(own)
        sizes = [len(p[0]) for p in pages]
        n, ids = len(at), np.array(at, np.int64)
        dense = np.zeros((n, DENSE), np.float32)
        if n:
            used, where = np.unique(ids, return_inverse=True)
            dense[:, :9] = np.array([self.rows[i] for i in used], np.float32)[where]
            dense[:, 9], dense[:, 10] = same, shared
            dense[:, 11] = again
            codes = np.array([self.paths[i] for i in used], np.uint64)[where]
            blank = np.concatenate([np.asarray(p[3], np.uint64) for p in pages])
            follows = np.concatenate([np.r_[np.asarray(p[3][1:], np.uint64), np.uint64(1)] for p in pages if p[3]])
            mix = codes[:, 0] * np.uint64(0x9E3779B1) + codes[:, 1] * np.uint64(0x85EBCA77) + (blank * np.uint64(2) + follows) * np.uint64(0xC2B2AE3D)
            paths = ((mix >> np.uint64(16)) % np.uint64(PATHS)).astype(np.int64)
            words = [self.words[i] for i in used]
        else:
            used, where, paths, words = np.zeros(0, np.int64), ids, np.zeros(0, np.int64), []
        return dense, where, paths, words, sizes


class Labeller:
    """A bidirectional LSTM over blocks; numpy only."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = DENSE + 2 * EMBED, HIDDEN
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": f(WORDS, EMBED) * 8, "P": f(PATHS, EMBED) * 4, "out": f(2 * h + d, 1)[:, 0], "b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"x{k}": f(d, 4 * h), f"h{k}": f(h, 4 * h), f"c{k}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)].astype(np.float32)}

    def _means(self, words: list[np.ndarray] | list[list[int]]) -> np.ndarray:
        """The mean word vector of every block; each has at least one word."""
        if not words:
            return np.zeros((0, EMBED), np.float32)
        sizes = np.array([len(w) for w in words])
        flat = np.concatenate([np.asarray(w, np.int64) for w in words])
        return np.add.reduceat(self.p["W"][flat], np.r_[0, sizes.cumsum()[:-1]], 0) / sizes[:, None].astype(np.float32)

    def _inputs(self, dense: np.ndarray, words: list[list[int]], paths: np.ndarray) -> np.ndarray:
        return np.concatenate([dense, self._means(words), self.p["P"][paths]], 1)

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        h = z.shape[-1] // 4
        s = 1 / (1 + np.exp(-np.clip(z[..., : 3 * h], -30, 30)))
        return s[..., :h], s[..., h : 2 * h], s[..., 2 * h : 3 * h], np.tanh(z[..., 3 * h :])

    def _run(self, x: np.ndarray, mask: np.ndarray, k: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """x: steps, pages, features. Hidden states, and what the way back needs."""
        t, n = mask.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        zx = x @ self.p[f"x{k}"] + self.p[f"c{k}"]
        hs, kept = np.zeros((t, n, HIDDEN), np.float32), []
        for s in range(t) if k == "f" else range(t - 1, -1, -1):
            i, f, o, g = self._gates(zx[s] + h @ self.p[f"h{k}"])
            m = mask[s][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                kept.append((s, i, f, o, g, h, c, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            hs[s] = h
        return hs, kept

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        hf, kf = self._run(x, mask, "f", keep)
        hb, kb = self._run(x, mask, "b", keep)
        z = np.concatenate([hf, hb, x], 2)
        return z @ self.p["out"] + self.p["b"], (z, kf, kb)

    def predict(self, dense: np.ndarray, words: list[list[int]], paths: np.ndarray) -> np.ndarray:
        """Probability of main content of every block of one page."""
        if not len(words):
            return np.zeros(0)
        x = self._inputs(dense, words, paths)[:, None, :]
        return 1 / (1 + np.exp(-self.logits(x, np.ones((len(words), 1), np.float32))[0][:, 0]))

    def predict_all(self, dense: np.ndarray, where: np.ndarray, paths: np.ndarray, words: list[np.ndarray], sizes: list[int], batch: int = 64) -> np.ndarray:
        """Probabilities of all blocks of many pages, as Reader gives them; pages of like length are run together, padded to the longest of them."""
        every = np.concatenate([dense, self._means(words)[where], self.p["P"][paths]], 1)
        out = np.zeros(len(every))
        begins = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        order = sorted((i for i in range(len(sizes)) if sizes[i]), key=sizes.__getitem__)
        at = 0
        while at < len(order):
            n = sizes[order[at]]
            end = at + 1
            while end < len(order) and end - at < batch and sizes[order[end]] <= n + 8 + n // 8:
                end += 1
            own = order[at:end]
            t = sizes[own[-1]]
            x, mask = np.zeros((t, len(own), every.shape[1]), np.float32), np.zeros((t, len(own)), np.float32)
            for j, i in enumerate(own):
                x[: sizes[i], j], mask[: sizes[i], j] = every[begins[i] : begins[i + 1]], 1
            p = 1 / (1 + np.exp(-np.clip(self.logits(x, mask, keep=False)[0], -30, 30)))
            for j, i in enumerate(own):
                out[begins[i] : begins[i + 1]] = p[: sizes[i], j]
            at = end
        return out

    def train(self, pages: list[tuple[np.ndarray, list[list[int]], np.ndarray]], labels: list[list[int]], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        by_length = sorted(range(len(pages)), key=lambda i: (len(labels[i]), i))
        groups = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
        for epoch in range(epochs):
            rate = rate if epoch < epochs - 2 else rate / 3
            for g in r.permutation(len(groups)):
                at = [i for i in groups[g] if labels[i]]
                if not at:
                    continue
                t, n = max(len(labels[i]) for i in at), len(at)
                x, mask, y = np.zeros((t, n, DENSE + 2 * EMBED), np.float32), np.zeros((t, n), np.float32), np.zeros((t, n), np.float32)
                for j, i in enumerate(at):
                    k = len(labels[i])
                    x[:k, j], mask[:k, j], y[:k, j] = self._inputs(*pages[i]), 1, labels[i]
                z, (cat, kf, kb) = self.logits(x, mask)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()
                grads = {"out": np.einsum("tn,tnd->d", err, cat), "b": np.array([err.sum()], np.float32)}
                dz = err[..., None] * self.p["out"]
                dx = dz[..., 2 * HIDDEN :].copy()
                for k, kept, dh_all in (("f", kf, dz[..., :HIDDEN]), ("b", kb, dz[..., HIDDEN : 2 * HIDDEN])):
                    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
                    gx, gh, gc = np.zeros_like(self.p[f"x{k}"]), np.zeros_like(self.p[f"h{k}"]), np.zeros_like(self.p[f"c{k}"])
                    for s, i, f, o, g_, h0, c0, tc, m in reversed(kept):
                        dh = dh + dh_all[s]
                        do, dct = m * dh * tc * o * (1 - o), m * dc + m * dh * o * (1 - tc * tc)
                        da = np.concatenate([dct * g_ * i * (1 - i), dct * c0 * f * (1 - f), do, dct * i * (1 - g_ * g_)], 1)
                        gx += x[s].T @ da
                        gh += h0.T @ da
                        gc += da.sum(0)
                        dx[s] += da @ self.p[f"x{k}"].T
                        dh = da @ self.p[f"h{k}"].T + (1 - m) * dh
                        dc = dct * f + (1 - m) * dc
                    grads |= {f"x{k}": gx, f"h{k}": gh, f"c{k}": gc}
                gw, gp = np.zeros_like(self.p["W"]), np.zeros_like(self.p["P"])
                for j, i in enumerate(at):
                    words, paths = pages[i][1], pages[i][2]
                    sizes = [len(w) for w in words]
                    np.add.at(gw, np.concatenate([np.asarray(w) for w in words]), np.repeat(dx[: len(words), j, DENSE : DENSE + EMBED] / np.array(sizes, np.float32)[:, None], sizes, axis=0))
                    np.add.at(gp, paths, dx[: len(words), j, DENSE + EMBED :])
                grads |= {"W": gw, "P": gp}
                step += 1
                for k, v in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)


def _page(text: str, repeated: list[int] | frozenset[int] | None) -> tuple[list[int], list[str], list[bool] | frozenset[int], list[bool]]:
    """Line numbers (from 1) of the blocks, the blocks, whether each is repeated on its site (or the hashes of what is), whether a blank line precedes it."""
    rep = repeated if isinstance(repeated, frozenset) else set(repeated or ())
    no, blocks, before, gap = [], [], [], True
    for i, x in enumerate(text.split("\n"), 1):
        if x.strip():
            no.append(i)
            blocks.append(x.rstrip("\r"))
            before.append(gap)
            gap = False
        else:
            gap = True
    return no, blocks, rep if isinstance(rep, frozenset) else [i in rep for i in no], before


def fit(pages: list[tuple[str, str | None, list[int] | frozenset[int]]], seeds: Seeds, epochs: int = 8) -> Labeller:
    """A labeller from sample pages (text, heading, numbers or hashes of lines repeated on the site)."""
    cut = [(*_page(text, repeated)[1:], heading) for text, heading, repeated in pages]
    dense, where, paths, words, sizes = Reader(seeds).read([(blocks, h, rep, before) for blocks, rep, before, h in cut])
    ends = np.cumsum(sizes)
    inputs = [(dense[e - n : e], [words[i] for i in where[e - n : e]], paths[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
    model = Labeller()
    model.train(inputs, [seed_labels(blocks, h, (dense[e - n : e, 11] > 0).tolist(), seeds) for (blocks, _, _, h), n, e in zip(cut, sizes, ends, strict=True)], epochs)
    return model


def label_pages(df: DataFrame, key: str, text: str, heading: str, repeated: str, sample: int = SAMPLE, epochs: int = 8, corpus: DataFrame | None = None, site: str | None = None) -> DataFrame:
    """`key`, the numbers (from 1) of the non-blank lines that are no main content, and main_text with the others in order.

    corpus: the same texts and headings as they are before `repeated` is found, where that takes a join. repeated: column with the numbers of lines repeated on the page's site (null for none), or
    with the hashes (bigint) of all lines repeated there; site: then the site, whose hashes are taken up once a task. Trained on at most `sample`
    pages, chosen by their hash. Null texts give null and no numbers, blank ones an empty main_text; keys may be null or
    repeated; other columns are ignored; rows are independent once the model is fitted.
    """
    hashed = df.schema[repeated].dataType.elementType == T.LongType()
    cols = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(heading).alias("_h"), (F.col(site) if site else F.lit(None).cast("string")).alias("_s"), F.col(repeated).alias("_r"))
    known = cols.where("_t IS NOT NULL")
    every = known if corpus is None else corpus.select(F.col(text).alias("_t"), F.col(heading).alias("_h")).where("_t IS NOT NULL")
    seeds = learn_seeds(every, "_t", "_h")
    pages = [(r["_t"], r["_h"], frozenset(r["_r"] or ()) if hashed else r["_r"]) for r in bounded_sample(known.select("_t", "_h", "_r"), sample, on=("_t", "_h"), rows=every.count())]
    model = fit(pages, seeds, epochs)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("other_lines", T.ArrayType(T.IntegerType())), T.StructField("main_text", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seeds)
        sets: dict[str | None, frozenset[int]] = {}

        def repeated_on(site_: str | None, column: pa.Array, i: int) -> frozenset[int] | list[int] | None:
            if not hashed:
                return column[i].as_py()
            if site_ is None or site_ not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[site_] = frozenset(column[i].as_py() or ())
            return sets[site_]

        for whole in it:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts, heads, sites = (c.to_pylist() for c in b.columns[1:4])
                pages = [None if t is None else (*_page(t, repeated_on(s, b.column(4), i)), h) for i, (t, h, s) in enumerate(zip(texts, heads, sites, strict=True))]
                p = model.predict_all(*reader.read([(x[1], x[4], x[2], x[3]) for x in pages if x is not None]))
                main_ = p >= 0.5
                other: list[list[int]] = []
                main: list[str | None] = []
                k = 0
                for x in pages:
                    if x is None:
                        other.append([])
                        main.append(None)
                        continue
                    keep = main_[k : k + len(x[0])].tolist()
                    k += len(x[0])
                    other.append([n for n, y in zip(x[0], keep, strict=True) if not y])
                    main.append("\n".join([t for t, y in zip(x[1], keep, strict=True) if y]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(other, pa.list_(pa.int32())), pa.array(main, pa.string())], names=schema.fieldNames())

    return cols.mapInArrow(run, schema)
