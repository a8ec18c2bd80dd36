"""Problem 7: e-mails as layout trees; only the newly written nodes are kept.

    mail      := (authored | closing | signature | notice | quote | forward)*
    quote     := intro? prefixed-line+          the prefix is stripped and the inside is a mail again
    forward   := (rule? headers | intro) mail   unprefixed: runs to the end of the enclosing mail
    closing   := formula name?                  newly written; what follows without a prefix is the signature
    signature := separator? line*
    notice    := paragraph that software or a legal department appends

The grammar is applied by descent: `parse` gives the nodes of one mail, with the lines of the mails inside them, and `tree`
goes on inside. What a sender has newly written is never inside a quote or forward, so `new_lines` serialises the authored and
closing nodes of the outermost mail and leaves what is inside unparsed; `mail_nodes` gives every node of the whole tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_DEPTH = 40  # quotes nested deeper stay one node of the tree unless a caller says otherwise

_MONTH = r"(?:jan(?:uary|uar)?|feb(?:ruary|ruar)?|m(?:arch|ar|ärz|rz)|apr(?:il)?|ma[iy]|june?i?|july?i?|aug(?:ust)?|sep(?:t|tember)?|o[ck]t(?:ober)?|nov(?:ember)?|de[cz](?:ember)?)"
_DATE = rf"(?:\d{{4}}-\d\d?-\d\d?|\d{{1,2}}\.\d{{1,2}}\.(?:\d{{2,4}})?|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}(?:st|nd|rd|th|\.)?\s+{_MONTH}\.?(?:,?\s+\d{{4}})?|{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?)"
_TIME = r"(?:,?\s+(?:at\s+|um\s+)?\d{1,2}[:.]\d\d(?:\s*(?:am|pm|uhr))?)?"
_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?|mo|di|mi|do|fr|sa|so|(?:mon|diens|donners|frei|sams|sonn)tag|mittwoch)[,.]*\s+"
_WHO = r"[^\n:]{2,}?"
_I = re.IGNORECASE
_INTROS = [
    re.compile(rf"^(?:on|am)\s+(?:{_DAY})?{_DATE}{_TIME},?\s+(?:hat\s+|schrieb\s+)?{_WHO}(?:\s+wrote|\s+geschrieben)?\s*:$", _I),
    re.compile(rf"^{_WHO}\s+(?:wrote|schrieb)\s+(?:on|am)\s+(?:{_DAY})?{_DATE}{_TIME}\s*:$", _I),
    re.compile(rf"^(?:in reply to|replying to|(?:als )?antwort auf|zu)\s+{_WHO}\s*\((?:{_DAY})?{_DATE}{_TIME}\)\s*:$", _I),
    re.compile(rf"^(?:in reply to|(?:als )?antwort auf)\s+{_WHO}<[^<>]+@[^<>]+>[^:]*:$", _I),
    re.compile(rf"^(?:{_DAY})?{_DATE}{_TIME},\s*{_WHO}\s*:$", _I),
    re.compile(rf"^{_WHO},\s*(?:{_DAY})?{_DATE}{_TIME}\s*:$", _I),
    re.compile(rf"^{_WHO}<[^<>]+@[^<>]+>\s*(?:wrote|schrieb)\s*:$", _I),
]
_RULE_TEXT = re.compile(r"^[-_=\s]*(?:begin\s+)?(?:original(?:\s+message|nachricht)|ursprüngliche\s+(?:nachricht|e-?mail)|forwarded\s+(?:message|mail|by.*)|weitergeleitete\s+(?:nachricht|e-?mail)|anfang der weitergeleiteten.*)\s*:?[-_=\s]*$", _I)
_RULE = re.compile(r"^\s*_{20,}\s*$")
_HEADER = re.compile(r"^\s*\*?(from|von|sent|gesendet|to|an|subject|betreff|date|datum|cc|kopie|reply-to|antwort an)\s*(?::\*|\*\s*:|:)\s*(.*)$", _I)
_TELLING = {"sent", "gesendet", "subject", "betreff", "date", "datum"}
_SEPARATOR = re.compile(r"^\s*(?:--|—|-{3,}|_{3,}|~{3,}|={3,}|\*(?:\s?\*){2,}|(?:-\s){2,}-)\s*$")
_FORMULA = r"(?:(?:(?:many|warm|best|kind|with best|with kind|all the best|sincere|warmest)\s+)?(?:regards|wishes|greetings)|best|cheers|all the best|(?:many\s+)?thanks(?:\s+(?:a lot|in advance|again|so much|and .{2,25}))?|thank you(?:\s+(?:very much|in advance|again))?|many thanks(?: in advance)?|yours(?:\s+(?:sincerely|faithfully|truly))?|sincerely(?:\s+yours)?|respectfully|mit\s+(?:freundlichen|besten|herzlichen|vielen|lieben)\s+gr(?:ü|ue)(?:ß|ss)en?|(?:viele|liebe|beste|herzliche|freundliche|schöne|sonnige|lg und viele)\s+gr(?:ü|ue)(?:ß|ss)e|(?:besten|vielen|herzlichen)\s+dank(?:\s+(?:im voraus|und .{2,25}))?|danke(?:\s+(?:und|im voraus|schon mal).{0,25})?|gr(?:u|ü|ue)(?:ß|ss)e?|mfg|lg|vg|bg|hochachtungsvoll|ihr|ihre|dein|deine)"
_NAME_PART = r"(?:[^\W\d_]\.|(?:von|van|de|der|den|zu|el|al|bin|da|di)\b|[^\W\d_][^\W\d_’']*(?:[-’'][^\W\d_]+)*)"
_NAME = re.compile(rf"^(?:(?:dr|prof|dipl|ing|mag)\.?\s+)*{_NAME_PART}(?:,?\s+{_NAME_PART}){{0,3}}[.,]?$", _I)
_CLOSING = re.compile(rf"^{_FORMULA}\s*[,!.]*(?:\s*[,\-–]\s*(?P<name>.{{2,60}}))?$", _I)
_ROLE = re.compile(r"\b(?:coordination|coordinator|assistant|assistenz|student(?:in|en)?|office|büro|unit|desk|centre|center|team|department|abteilung|referat|institut|faculty|fakultät|university|universität|hochschule|college|koordination|professor|lecturer|secretary|sekretariat|head of|leiter(?:in)?|manager|gmbh|hiwi|tutor(?:in)?|b\.?\s?sc|m\.?\s?sc|b\.?\s?a\.|m\.?\s?a\.)\b", _I)
_CONTACT = re.compile(r"^(?:\W*(?:(?:tel(?:efon)?|phone|mobile?|mobil|fon|fax|t|m|f|e-?mail|mail|mailto|web|www|url|skype)\b\s*[.:]*\s*))?(?:<?\S+@\S+\.\S+>?|https?://\S+|www\.\S+|[+(]?\d[\d\s()/.+-]{5,})\s*$", _I)
_NOTICE = re.compile(
    r"^\W*(?:sent (?:from|with|via|by) (?:my|a|an|the)?\b.*|(?:von|aus) unterwegs (?:gesendet|geschickt)|gesendet (?:von|mit|aus|via|über)\b.*|von mein\w+ .{2,40} gesendet.*|get (?:the )?.{2,40} (?:app\b|for (?:ios|android)).*|hol dir .* app.*|diese (?:nachricht|e-?mail|mail)\b.*(?:vertraulich|bestimmt|virus|viren|geprüft|enthält|kann|gesendet)?.*|this (?:e-?mail|message|communication)\b.*(?:confidential|intended|privileged|virus|addressee|may contain|is meant|was sent|scanned).*|confidentiality (?:note|notice)\b.*|legal (?:note|notice)\b.*|disclaimer\b.*|(?:virus-?free|virenfrei)\b.*|(?:checked|scanned|geprüft|überprüft) (?:by|for|von|durch|auf)\b.*|.{0,80}\bprocesses personal data\b.*|.{0,80}\bverarbeitet personenbezogene daten\b.*|please (?:consider|think of|save)\b.*(?:environment|trees|print\w*|paper)\b.*|bitte (?:denken|prüfen) sie .*(?:umwelt|ausdruck).*|der inhalt dieser (?:e-?mail|nachricht)\b.*|vertraulichkeitshinweis\b.*|rechtlicher hinweis\b.*|haftungsausschluss\b.*|(?:automatic(?:ally)?|automatisch) (?:generated|reply|erzeugt|erstellt|generiert|antwort)\b.*|this is an automat.*|dies ist eine automat.*)$",
    _I,
)
_NO_NOTICE = re.compile(r"\b(?:is|are|ist|sind)\s+(?:not|nicht|kein\w*)\s+(?:confidential|vertraulich|privileged)\b", _I)
#: A first line of an unseparated signature: a post, a course of study or an office, and no sentence.
_POST = re.compile(r"^(?:office of\s|büro\s|(?:student(?:ische)?|research|teaching|wissenschaftliche\w*)\s+(?:assistant|assistent\w*|hilfskraft|mitarbeiter\w*)|(?:programme?|course|programm|studien\w*)[ -]?(?:coordinat\w+|koordinat\w+)|(?:[bm]\.?\s?(?:sc|a|eng)\.?|phd|master|bachelor)\s+(?:student\w*|candidate)|student(?:in)?,|doktorand\w*|head of\s|leit(?:er|ung)\w*\s|secretary|sekretariat|professor\b|lecturer)[^.?!]*$", _I)
_PREFIX = re.compile(r"^(?: ?[>|]){1}(?: |$|(?=[>|]))|^ ?>")
_INDENT = re.compile(r"^(?: {4,}|\t)")
#: A sentence that starts with "more than": a mark that quotes nothing.
_MORE_THAN = re.compile(r"^>\s?\d[\d.,]*\s?(?:%|€|\w).*[.?!]$")


@dataclass
class Node:
    """A node of the tree: kind, its line numbers (from 0) in the mail it was found in, the lines of a mail inside it without their prefix, and that mail's nodes."""

    kind: str
    lines: list[int]
    held: list[str] | None = None
    inside: list[Node] = field(default_factory=list)


def _intro(lines: list[str], i: int) -> int:
    """How many lines from i on are an introducing line; 0 if none is."""
    one = lines[i].strip()
    if not one:
        return 0
    joined = one
    for n in (1, 2, 3):
        if joined.endswith(":") and any(p.match(joined) for p in _INTROS):
            return n
        if i + n >= len(lines) or not lines[i + n].strip() or one.endswith((".", "?", "!", ":")):
            return 0
        more = lines[i + n].strip()
        if more.endswith(":") and any(p.match(more) for p in _INTROS):  # introduces by itself; what stands before it is no part of it
            return 0
        joined += " " + more
    return 0


def _headers(lines: list[str], i: int, ruled: bool) -> int:
    """How many lines from i on are the header lines of an earlier mail; 0 if they are none."""
    n, names, mail = 0, set(), False
    while i + n < len(lines) and (m := _HEADER.match(lines[i + n])):
        names.add(m[1].lower())
        mail |= "@" in m[2]
        n += 1
    first = _HEADER.match(lines[i]) if i < len(lines) else None
    if not n or first[1].lower() not in ("from", "von", "sent", "gesendet", "date", "datum", "subject", "betreff", "to", "an"):
        return 0
    if ruled or (n >= 2 and names & {"from", "von"} and (names & _TELLING or mail)):
        return n
    return 0


def _notice(s: str) -> bool:
    return bool(_NOTICE.match(s)) and not _NO_NOTICE.search(s)


def _signature(lines: list[str], i: int) -> int:
    """How many lines from i on are a signature that no separator or closing announces: a post, then contact lines up to the end of what was written."""
    if len(lines[i].strip()) > 70 or not _POST.match(lines[i].strip()):
        return 0
    b = i + 1
    while b < len(lines) and (x := lines[b].strip()):
        if _PREFIX.match(lines[b]) or _notice(x) or _intro(lines, b) or _headers(lines, b, False) or _RULE_TEXT.match(x) or _RULE.match(x):
            break
        if len(x) > 70 or re.search(r"[?!]$|[^\W\d]{3}\.$", x) or not (_CONTACT.match(x) or re.search(r"\d|@|://| at .* dot ", x)):
            return 0
        b += 1
    return b - i


def _next(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i].strip():
        i += 1
    return i


def parse(lines: list[str]) -> list[Node]:
    """The nodes of a mail given by its lines; those of the mails inside it are not looked for."""
    out: list[Node] = []
    state, i, n = "body", 0, len(lines)
    introduced = any(_intro(lines, k) for k in range(n) if lines[k].rstrip().endswith(":") or lines[k].strip()[:3].lower() in ("on ", "am ", "in "))

    def add(kind: str, a: int, b: int) -> None:
        if out and out[-1].kind == kind and kind in ("authored", "signature", "notice"):
            out[-1].lines.extend(range(a, b))
        else:
            out.append(Node(kind, list(range(a, b))))

    def quoted(a: int, indented: bool) -> int:
        """The end of the prefixed block that starts at a."""
        b = a
        mark = lines[a].lstrip()[:1]
        is_in = (lambda s: bool(_INDENT.match(s))) if indented else (lambda s: bool(_PREFIX.match(s)) and s.lstrip()[:1] == mark)
        while b < n:
            if is_in(lines[b]):
                b += 1
            elif not lines[b].strip() and (c := _next(lines, b)) < n and is_in(lines[c]) and not (c - b >= 1 and _MORE_THAN.match(lines[c])):
                b = c
            else:
                break
        return b

    def enclose(kind: str, a: int, b: int) -> None:
        """What an earlier mail's introduction at a..b is followed by."""
        nonlocal i, state
        c = _next(lines, b)
        if c < n and _PREFIX.match(lines[c]):
            e = quoted(c, False)
            strip = lambda s: _PREFIX.sub("", s, count=1)
        elif c < n and _INDENT.match(lines[c]):
            e = quoted(c, True)
            strip = lambda s: _INDENT.sub("", s, count=1)
        else:
            e, strip = n, str
            kind = "forward"
        out.append(Node("intro", list(range(a, b))))
        if c < e:
            out.append(Node(kind, list(range(b, e)), [strip(s) for s in lines[b:e]]))
        i, state = e, "body"

    while i < n:
        s = lines[i].strip()
        if not s:
            i += 1
            continue
        # a rule, then headers or an introduction
        if _RULE_TEXT.match(s) or _RULE.match(s):
            c = _next(lines, i + 1)
            h = _headers(lines, c, bool(_RULE_TEXT.match(s)))
            if h or _RULE_TEXT.match(s) and re.search(r"[-_=:]", s):
                enclose("forward", i, c + h if h else i + 1)
                continue
        if h := _headers(lines, i, False):
            enclose("forward", i, i + h)
            continue
        if k := _intro(lines, i):
            enclose("quote", i, i + k)
            continue
        if _PREFIX.match(lines[i]):
            e = quoted(i, False)
            lone = s.startswith(">") and _MORE_THAN.match(s) and (e == i + 1 and not any(x.kind == "intro" for x in out) or i and not lines[i - 1].strip())
            if lone:
                add("authored", i, i + 1)
                i += 1
                continue
            if s.startswith(">") or introduced or e > i + 1:
                out.append(Node("quote", list(range(i, e)), [_PREFIX.sub("", x, count=1) for x in lines[i:e]]))
                i, state = e, "body"
                continue
        if _notice(s):
            e = i + 1
            if len(s) > 40:  # a wrapped paragraph; one-liners of mail programs stand alone
                while e < n and lines[e].strip() and not _PREFIX.match(lines[e]) and not _intro(lines, e) and not _headers(lines, e, False) and not _RULE.match(lines[e]) and not _RULE_TEXT.match(lines[e].strip()):
                    e += 1
            add("notice", i, e)
            i = e
            continue
        if _SEPARATOR.match(s):
            c = _next(lines, i + 1)
            if _headers(lines, c, False) and c < n:
                enclose("forward", i, c + _headers(lines, c, False))
                continue
            add("signature", i, i + 1)
            state = "signature"
            i += 1
            continue
        if state == "signature":
            add("signature", i, i + 1)
            i += 1
            continue
        if len(s) < 90 and (m := _CLOSING.match(s)) and (m["name"] is None or _NAME.match(m["name"])):
            e = i + 1
            if m["name"] is None:
                c = e
                if c < n and not lines[c].strip():
                    c = _next(lines, c) if _next(lines, c) == c + 1 else c
                if c < n and _NAME.match(lines[c].strip()) and not _ROLE.search(lines[c]) and not _CLOSING.match(lines[c].strip()) and not _notice(lines[c].strip()):
                    e = c + 1
            add("closing", i, e)
            i, state = e, "signature"
            continue
        if _CONTACT.match(s) and all(_CONTACT.match(x.strip()) or not x.strip() for x in lines[i : min(n, i + 2)]) and i and not lines[i - 1].strip():
            add("signature", i, i + 1)
            i += 1
            continue
        if k := _signature(lines, i):
            add("signature", i, i + k)
            i, state = i + k, "signature"
            continue
        add("authored", i, i + 1)
        i += 1
    return out


def tree(lines: list[str], depth: int = MAX_DEPTH) -> list[Node]:
    """The nodes of a mail with those of the mails inside them, and so on down to `depth`; without recursion, so that no depth is too deep."""
    top = parse(lines)
    level = top
    for _ in range(depth):
        below: list[Node] = []
        for node in level:
            if node.held is not None:
                node.inside = parse(node.held)
                below += node.inside
        if not below:
            break
        level = below
    return top


def lines_of(text: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]


def new_lines(text: str) -> set[int]:
    """Numbers (from 0) of the lines the sender has just written; blank lines belong to none."""
    return {k for node in parse(lines_of(text)) if node.kind in ("authored", "closing") for k in node.lines}


def old_lines(text: str) -> list[int]:
    """Numbers (from 0) of the non-blank lines that are not newly written."""
    new = new_lines(text)
    return [k for k, x in enumerate(lines_of(text)) if x.strip() and k not in new]


def mail_nodes(df: DataFrame, keys: list[str], text: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Columns `keys` and every node of every mail's tree: node (positions from the outermost mail inwards, from 0, joined by `/`), depth, kind, first_line (from 1, in the whole text), n_lines.

    Nested deeper than `depth` is one node. Null and blank texts have no nodes; keys may be null or repeated; other columns
    are ignored; no shuffle.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("node", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("first_line", T.IntegerType()), T.StructField("n_lines", T.IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, rows = [], []
            for i, t in enumerate(b.column(b.num_columns - 1)):
                stack = [("", 0, 0, x, n) for n, x in enumerate(tree(lines_of(t.as_py() or ""), depth))]
                while stack:
                    above, level, offset, x, n = stack.pop()
                    name = f"{above}/{n}" if above else str(n)
                    at.append(i)
                    rows.append((name, level, x.kind, offset + x.lines[0] + 1, len(x.lines)))
                    stack += [(name, level + 1, offset + x.lines[0], y, m) for m, y in enumerate(x.inside)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.fieldNames())

    return df.select(*keys, df[text].alias("_text")).mapInArrow(run, schema)


def reduce_mails(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Columns `keys`, the numbers (from 1) of the lines not newly written, and new_text, every row by itself.

    new_text keeps the new lines in order, with runs of blank lines between them as one. Null texts give null and no
    numbers, empty ones an empty text; keys may be null or repeated; other columns are ignored; no shuffle.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("old_lines", T.ArrayType(T.IntegerType())), T.StructField("new_text", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            old: list[list[int]] = []
            new: list[str | None] = []
            for t in b.column(b.num_columns - 1):
                s = t.as_py()
                if s is None:
                    old.append([])
                    new.append(None)
                    continue
                ls, keep = lines_of(s), new_lines(s)
                old.append([k + 1 for k, x in enumerate(ls) if x.strip() and k not in keep])
                kept = ["" if not x.strip() else x for k, x in enumerate(ls) if k in keep or not x.strip()]
                new.append(re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(old, pa.list_(pa.int32())), pa.array(new, pa.string())], names=schema.fieldNames())

    return df.select(*keys, df[text].alias("_text")).mapInArrow(run, schema)
