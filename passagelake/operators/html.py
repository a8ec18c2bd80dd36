"""Structure of web pages: main area, text, headings, lists, tables, links, sections, head data. One Arrow function over the standard parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SILENT = {"script", "style", "template", "noscript"}
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_STR, _LIST = T.StringType(), T.ArrayType


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMA = _struct(
    title=_STR, description=_STR, keywords=_STR, main_text=_STR,
    headings=_LIST(_struct(level=T.IntegerType(), text=_STR)), lists=_LIST(_struct(type=_STR, items=_LIST(_STR))), tables=_LIST(_struct(headers=_LIST(_STR), rows=_LIST(_LIST(_STR)))),
    links=_LIST(_struct(text=_STR, url=_STR)), sections=_LIST(_struct(heading=_STR, level=T.IntegerType(), content=_STR)),
)


@dataclass
class Element:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(x for x in reversed(e.children) if isinstance(x, Element))

    def text(self, sep: str = "") -> str:
        """Stripped pieces of text, without scripts and styles."""
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                if e.strip():
                    out.append(e.strip())
            elif e.name not in _SILENT:
                stack.extend(reversed(e.children))
        return sep.join(out)


class _Tree(HTMLParser):
    """A tree of elements; unclosed and stray tags are forgiven."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].name in ("ul", "ol", "table", "div", "dl") and self.open[k].name not in _CLOSES[tag]:
                    break
                if self.open[k].name in _CLOSES[tag]:
                    del self.open[k:]
                    break
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def main_area(root: Element) -> Element:
    """<main>, else an element with main or content in its id, else in its class, else the body, else everything."""
    named = re.compile("main|content", re.I)
    for wanted in (lambda e: e.name == "main", lambda e: named.search(e.attrs.get("id", "")), lambda e: named.search(e.attrs.get("class", "")), lambda e: e.name == "body"):
        if e := next((x for x in root.walk() if wanted(x)), None):
            return e
    return root


def _tables(area: Element) -> list[dict]:
    out = []
    for t in (e for e in area.walk() if e.name == "table"):
        cells = lambda r, names: [c.text() for c in r.walk() if c.name in names]
        head = next((e for e in t.walk() if e.name == "thead"), None)
        first = next((e for e in head.walk() if e.name == "tr"), None) if head else None
        body = next((e for e in t.walk() if e.name == "tbody"), t)
        rows = [r for e in body.walk() if e.name == "tr" and (r := cells(e, ("td", "th")))]
        if rows:
            out.append({"headers": cells(first, ("td", "th")) if first else [], "rows": rows})
    return out


def _sections(area: Element) -> list[dict]:
    """Headings with the paragraphs, lists, tables and blocks that follow among their siblings."""
    out = []
    for parent in area.walk():
        kids = [c for c in parent.children if isinstance(c, Element)]
        for i, h in enumerate(kids):
            if h.name not in _HEADINGS:
                continue
            own = []
            for s in kids[i + 1 :]:
                if s.name in _HEADINGS:
                    break
                if s.name in ("p", "ul", "ol", "table", "div"):
                    own.append(s.text())
            if content := " ".join(own):
                out.append({"heading": h.text(), "level": int(h.name[1]), "content": content})
    return out


def extract(html: str, base_url: str = "", link_part: str = "/en/") -> dict:
    """All parts of one page, as in SCHEMA. Broken markup is read as far as it goes."""
    root = parse(html)
    area = main_area(root)
    meta = {e.attrs.get("name", "").lower(): e.attrs.get("content") for e in root.walk() if e.name == "meta"}
    title = next((e for e in root.walk() if e.name == "title"), None)
    links = [{"text": x, "url": h if h.startswith("http") else base_url + h} for e in area.walk() if e.name == "a" and (h := e.attrs.get("href")) and (link_part in h or h.startswith("/")) and (x := e.text())]
    lists = [{"type": e.name, "items": items} for e in area.walk() if e.name in ("ul", "ol") and (items := [c.text() for c in e.children if isinstance(c, Element) and c.name == "li"])]
    heads = sorted(({"level": int(e.name[1]), "text": e.text()} for e in area.walk() if e.name in _HEADINGS), key=lambda h: h["level"])
    return {"title": title.text() if title else None, "description": meta.get("description"), "keywords": meta.get("keywords"), "main_text": re.sub(r"\s+", " ", area.text(" ")).strip(), "headings": heads, "lists": lists, "tables": _tables(area), "links": links, "sections": _sections(area)}


# What headings of requirements, procedures and sections of questions say.
REQUIREMENTS = r"requirement|prerequisite|eligibility|qualification"
PROCEDURES = r"how to|steps|procedure|process|guide"
QUESTIONS = r"frequently asked questions|faq"

GUIDANCE = _struct(
    body_text=_STR, requirements=_LIST(_STR), procedures=_LIST(_struct(title=_STR, steps=_LIST(_STR))),
    faqs=_LIST(_struct(question=_STR, answer=_STR)), useful_links=_LIST(_struct(url=_STR, text=_STR)),
)


def body_text(root: Element) -> str:
    """The text of <main>, else of a block of class content, else of the body, without navigation, head and foot; one line."""
    area = next((e for e in root.walk() if e.name == "main"), None) or next((e for e in root.walk() if e.name == "div" and "content" in e.attrs.get("class", "").split()), None) or next((e for e in root.walk() if e.name == "body"), None)
    if area is None:
        return ""
    out, stack = [], [area]
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            out += e.split()
        elif e.name not in _SILENT | {"nav", "footer", "header"}:
            stack.extend(reversed(e.children))
    return " ".join(out)


def guidance(html: str, keywords: tuple[str, ...], base_url: str = "", items: int = 10, steps: int = 15, answer_chars: int = 500, links: int = 20) -> dict:
    """What a page tells its readers to do, as in GUIDANCE.

    Requirements are the first `items` of a list right behind a heading of REQUIREMENTS, procedures the first `steps` of an
    ordered list behind one of PROCEDURES. In a block that names QUESTIONS, itself or in a heading, each heading of level 3
    or 4 or bold text with what stands right behind it is a question with its answer. Useful links are web addresses whose
    text has one of the keywords.
    """
    root = parse(html)
    behind: dict[int, Element] = {}
    holder: dict[int, Element] = {}
    for e in root.walk():
        kids = [c for c in e.children if isinstance(c, Element)]
        behind |= {id(a): b for a, b in zip(kids, kids[1:])}
        holder |= {id(c): e for c in kids}
    own = lambda e, n: [c.text() for c in e.walk() if c.name == "li"][:n]
    need: list[str] = []
    how: list[dict] = []
    asked: list[dict] = []
    useful: list[dict] = []
    seen: set[int] = set()
    for e in root.walk():
        if e.name in ("h2", "h3", "h4"):
            title, nxt = e.text(), behind.get(id(e))
            if nxt is not None and nxt.name in ("ul", "ol") and re.search(REQUIREMENTS, title, re.I):
                need += own(nxt, items)
            if nxt is not None and nxt.name == "ol" and re.search(PROCEDURES, title, re.I):
                how.append({"title": title, "steps": own(nxt, steps)})
        if e.name not in _SILENT and any(isinstance(c, str) and re.search(QUESTIONS, c, re.I) for c in e.children):
            block = holder.get(id(e), e) if e.name in _HEADINGS else e
            if id(block) not in seen:
                seen.add(id(block))
                for q in [x for x in block.walk() if x.name in ("h3", "h4", "strong", "b")][:items]:
                    if (a := behind.get(id(q))) is not None:
                        asked.append({"question": q.text(), "answer": a.text()[:answer_chars]})
        if e.name == "a" and (h := e.attrs.get("href")) and any(k in e.text().lower() for k in keywords):
            url = urljoin(base_url, h)
            if url.startswith(("http://", "https://")) and len(useful) < links:
                useful.append({"url": url, "text": e.text()[:100]})
    return {"body_text": body_text(root), "requirements": need, "procedures": how, "faqs": asked, "useful_links": useful}


def extract_guidance(df: DataFrame, keys: list[str], html: str, keywords: tuple[str, ...], base_url: str = "") -> DataFrame:
    """Columns `keys` and `page`, the struct of GUIDANCE; null for a null text, empty lists where there is nothing. Rows are independent."""
    return _by_page(df, keys, html, GUIDANCE, lambda s: guidance(s, keywords, base_url))


def _by_page(df: DataFrame, keys: list[str], html: str, kind: T.StructType, read: Callable[[str], dict]) -> DataFrame:
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("page", kind)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for b in it:
            pages = [None if s is None else read(s) for s in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pages, arrow)], names=schema.fieldNames())

    return df.select(*keys, F.col(html).alias("_html")).mapInArrow(run, schema)


def extract_pages(df: DataFrame, keys: list[str], html: str, base_url: str = "") -> DataFrame:
    """Columns `keys` and `page`, the struct of SCHEMA; null for a null text. Rows are independent."""
    return _by_page(df, keys, html, SCHEMA, lambda s: extract(s, base_url))
