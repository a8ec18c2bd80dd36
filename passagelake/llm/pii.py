"""Problem 3: personal information in free text, by weak supervision.

Patterns propose spans, widely: every run of capitalised words and every longer number is one. Labelers built on formats,
gazetteers and contexts vote on each, for or against. Expectation-maximisation estimates, from their agreements alone, how
reliable every labeler is and with it each span's probability, and on these a final span classifier (logistic regression
over hashed features of the span and its surroundings) is trained, which decides. Fitting uses a bounded sample; every text
is searched whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 2000  # texts of each group that the classifier is fitted on at most
DIM = 1 << 15
TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

# Common given names to begin with; a caller may pass others, and the texts teach more.
GIVEN = frozenset(
    "Aaron Adam Adrian Ahmed Alexander Ali Alice Amina Ana Andrea Andreas Anna Anne Anton Antonia Arthur Astrid Ayse Barbara Ben Benjamin Bernd Birgit Björn Bruno Carla Carlos Carolin Charlotte Christian Christina Christoph Clara Claudia Daniel Daniela David Diana Dieter Dirk Dominik Dorothea Elena Elias Elif Elisabeth Elizabeth Emil Emily Emma Emre Erik Eva Fabian Fatma Felix Finn Florian Frank Franz Franziska Gabriele George Gerd Greta Hannah Hans Harald Heike Helga Helena Henry Holger Ibrahim Ida Ines Ingrid Irina Isabel Ivan Jack Jakob James Jan Jana Jane Jens Jessica Johanna Johannes John Jonas Josef Judith Julia Julian Jürgen Kai Karin Karl Katharina Kerstin Klaus Kristina Lars Laura Lea Leon Lena Lina Linda Lisa Louis Luca Lucas Lukas Magdalena Manfred Marc Marco Maria Marie Mario Mark Markus Martin Mary Matthias Max Mehmet Melanie Mia Michael Michelle Mohamed Monika Moritz Mustafa Nadine Nicole Niklas Nils Nina Noah Nora Ole Olga Oliver Olivia Omar Oskar Otto Patrick Paul Paula Peter Petra Philipp Piotr Rebecca Richard Robert Roland Rosa Ruth Sabine Samuel Sandra Sara Sarah Sebastian Simon Sofia Sophie Stefan Stephan Susanne Sven Tanja Thomas Tim Tobias Tom Ulrich Ute Vera Victoria Volker Walter Wei William Wolfgang Yusuf".split()
)
# Capitalised words that greet, date or name offices and are no names of persons.
COMMON = set(
    "Team Damen Herren Sir Madam All Everyone Everybody Alle Kollegen Kolleginnen Herr Herrn Frau Mr Mrs Ms Dr Prof Professor Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag January February March April May June July August September October November December Januar Februar März Mai Juni Juli Oktober Dezember "
    "The This That These Those There Thanks Thank Best Kind Regards Yours Sincerely Many Hello Hi Dear Good Guten Tag Morgen Sehr Liebe Lieber Liebes Viele Grüße Danke Gruß Mit Beste Herzliche Please Bitte Do Can Is Are Why Who How When Where What Whoever Wer Wie Was Warum Kann Gilt Ein Eine Der Die Das Den Dem Im Am Zum Zur Bis Seit Nach Für Auf An Aus Bei Von Vom Und Oder Ich Sie Wir Es Ihr Mein Meine My I You We They It Our Your If On At In For From To Sent Subject Betreff Gesendet Date Datum Cc "
    "MfG LG VG BG Gruß Grüße Grüßen Dank Voraus Regards Wishes Cheers Sincerely Hochachtungsvoll "
    "Student Studentin Studierende Office Building Haus Gebäude Raum Room Module Modul Unit Desk Centre Center Counter Service Büro University Universität Hochschule College Programme Studiengang Phone Tel Mobil Mail Fwd Re AW WG RE".split()
)
# Words with which names of prizes, buildings and firms end.
THINGS = frozenset("Prize Award Medal Fellowship Scholarship Preis Hall House Building Library Auditorium Wing Lecture Theatre Stiftung Foundation Institut Institute Saal Bau Haus Company Group Verlag Press Street Road Lane University".split())
_PARTICLES = frozenset("von van de der den zu el al bin da di".split())
_W = r"[^\W\d_]"
_CAP = rf"(?:[A-ZÄÖÜÀ-ÞČŠŽŁŚĆ]{_W}*(?:[-’']{_W}+)*)"
_GAP = r"(?:[ \t]+|[ \t]*\r?\n[>| \t]*)"
_SEQ = rf"(?:(?:[A-ZÄÖÜ]\.|{_CAP})(?:[ \t]+(?:[A-ZÄÖÜ]\.|{_CAP}|(?:von|van|de|der|den|zu|el|al|bin|da|di)(?=[ \t]+[A-ZÄÖÜ]))){{0,3}})"
_SEQW = rf"(?:(?:[A-ZÄÖÜ]\.|{_CAP})(?:{_GAP}(?:[A-ZÄÖÜ]\.|{_CAP}|(?:von|van|de|der|den|zu|el|al|bin|da|di)(?={_GAP}[A-ZÄÖÜ]))){{0,3}})"
_LAST_FIRST = rf"(?:{_CAP},{_GAP}{_CAP}(?:{_GAP}{_CAP})?)"
_LINE = r"(?:^|\n)[>| \t]*"
_TITLE = r"(?:Herrn?|Frau|Fr\.|Hr\.|Mrs?\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Professor(?:in)?)"
_FORMULA = r"(?:(?:(?:many|warm|best|kind|with best|with kind|all the best)\s+)?(?:regards|wishes)|best|cheers|(?:many\s+)?thanks(?:\s+(?:a lot|in advance|again|so much))?|thank you(?: very much| in advance)?|yours(?:\s+(?:sincerely|faithfully|truly))?|sincerely|mit\s+(?:freundlichen|besten|herzlichen|vielen|lieben)\s+gr(?:ü|ue)(?:ß|ss)en?|(?:viele|liebe|beste|herzliche|freundliche|schöne)\s+gr(?:ü|ue)(?:ß|ss)e|(?:besten|vielen|herzlichen)\s+dank(?:\s+im voraus)?|danke(?:\s+(?:und|im voraus|schon mal).{0,20})?|gr(?:u|ü)(?:ß|ss)e?|mfg|lg|vg|bg)"
_MONTHS = r"(?:jan|feb|m[aä]r|apr|ma[iy]|jun|jul|aug|sep|o[ck]t|nov|de[cz])\w*\.?"
_D = rf"(?:\d{{4}}-\d\d?-\d\d?|\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}}|\d{{1,2}}\.?\s+{_MONTHS}(?:\s+\d{{4}})?|{_MONTHS}\s+\d{{1,2}}(?:,?\s+\d{{4}})?)"

#: Anchors of names: the context around group 1. Each is a labeler that votes for what it finds.
_ANCHORS: dict[str, re.Pattern] = {
    "title": re.compile(rf"\b{_TITLE}{_GAP}(?:(?:Dr|Prof|Dipl|Ing|Mag)\.?-?{_GAP}?)*({_SEQW})"),
    "greeting": re.compile(rf"(?i:hallo|hi|hello|hey|dear|liebe[rs]?|good (?:morning|day|afternoon|evening)|guten (?:tag|morgen|abend)|moin)[ \t]+({_SEQ})[ \t]*[,!:]?[ \t]*(?=\r?\n|$)"),
    "closing": re.compile(rf"(?i:{_FORMULA})[ \t]*[,!.]*[ \t]*(?:(?<=,)[ \t]*|(?:\r?\n[>| \t]*){{1,2}})({_SEQ})[ \t]*(?=\r?\n|$)"),
    "header": re.compile(rf"\*?(?:From|Von|To|An|Cc|Kopie)(?::\*|\*?[ \t]*:)\*?[ \t]*({_SEQ}|{_LAST_FIRST})[ \t]*(?=<|\r?\n|$)"),
    "wrote": re.compile(rf"(?:\b(?:hat|schrieb){_GAP}({_SEQW})(?:{_GAP}<[^>]*>)?(?:{_GAP}geschrieben)?[ \t]*:)|(?:\b(?i:in reply to|antwort auf){_GAP}({_SEQW}))"),
    "dated": re.compile(rf"(?:(?i:{_D})(?:,?[ \t]+\d\d?:\d\d)?,{_GAP}({_SEQ})(?:{_GAP}<[^>]*>)?[ \t]*:[ \t]*(?=\r?\n|$))|(?:({_SEQ})(?:{_GAP}<[^>]*>)?,{_GAP}(?i:{_D})(?:,?[ \t]+\d\d?:\d\d)?[ \t]*:[ \t]*(?=\r?\n|$))"),
    "self": re.compile(rf"\b(?:I|Ich){_GAP}\(({_LAST_FIRST}|{_SEQW})[,)]"),
}
#: What a text must hold for an anchor to be there.
_HINTS = {"title": ("Herr", "Frau", "Fr.", "Hr.", "Mr", "Ms", "Miss", "Dr", "Prof"), "wrote": ("hat ", "hat\n", "hat\r", "hat\t", "schrieb", "eply to", "EPLY TO", "ntwort auf", "NTWORT AUF", "eply To", "ntwort Auf"), "self": ("(",)}
#: Anchors that start at a line's first character behind quote marks, and the letters with which a closing may begin.
_OF_LINES = {"greeting", "closing", "header", "dated"}
_GREETERS = frozenset("hHdDlLgGmM")
_CLOSERS = frozenset("mwbkarctysvlhfdgMWBKARCTYSVLHFDG")
#: Anchors that stand behind the name: first what is looked for, then what must end there.
_BEHIND: dict[str, re.Pattern] = {
    "mailbox": re.compile(r"<[^<>\s@]+@[^<>\s]+>"),
    "wrote_by": re.compile(r"wrote\b|schrieb\b"),
    "from_office": re.compile(rf"(?:from|aus|vom){_GAP}(?:(?:the|dem|der){_GAP})?(?:{_CAP}{_GAP}){{0,3}}(?:Office|Desk|Unit|Centre|Center|Counter|Team|Büro|\w+(?:büro|stelle|zentrum|service|beratung))\b"),
}
_SPACES = " \t\r\n>|"
_NONSPACE, _INITIAL = re.compile(r"[^\s,]+"), re.compile(r"[A-ZÄÖÜ]\.")
_LOWERS, _UPPERS, _DIGIT = re.compile("[a-zäöüß]+"), re.compile("[A-ZÄÖÜ]+"), re.compile(r"\d")
_ID_DATE, _PHONE_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d\d?\.\d\d?\.\d{2,4}"), re.compile(r"\(?(?:\d{4}-\d\d?-\d\d?|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{1,2}/\d{1,2}/\d{2,4})(?!\d)")
_ID_FORM, _ID_SHAPE = re.compile(r"[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d"), re.compile(r"[A-Z]{1,2}\d[\dA-Z ]{6,}|[a-z]\d{6,8}|\d{2} \d{3} \d{3} \d{3}|\d{6,8}")
_ENDS_IN_NAME = re.compile(rf"(?:^|(?<![\w@.-]))({_LAST_FIRST}|{_SEQW})$")
_FAMILY_BEFORE = re.compile(rf"(?<![\w@.-])({_CAP}),{_GAP}$")
_FAMILY_AFTER = re.compile(rf"({_GAP})(?:[A-ZÄÖÜ]\.{_GAP})?({_CAP})(?![\w@]|-[a-z])")
#: A name all in lower case, where the line or a verb of writing ends it.
_LOWER_PAIR = re.compile(rf"(?<![\w@.+-])([a-zäöüéèë]{{3,15}}(?:-[a-zäöüéèë]+)?) ([a-zäöüß]{{4,25}}(?:-[a-zäöüß]+)?)(?=[ \t]*(?:[<(,:]|\r?\n|$)|[ \t]+(?:wrote|schrieb|hat|geschrieben|has|from|aus|on|am)\b)(?![@.]\w)")
#: What may stand between the words of a run.
_JOINS = frozenset(f" {x}" for x in ("", *(f"{w} " for w in sorted(_PARTICLES))))
_TOKEN = re.compile(rf"(?<![\w@.-]){_CAP}(?![\w@]|-[a-z])")
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_HIDDEN_MAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]+\s?(?:\((?:at|@)\)|\[(?:at|@)\]|\{(?:at|@)\}|<at>|\(a\)|\[ät\]|\(ät\))\s?[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\(punkt\)|\[punkt\])\s?)[\w-]+)+"
    r"|(?<![\w.+-])[\w.+-]+ (?:at|AT|ät) [\w-]+(?:(?:\.[\w-]+)* (?:dot|DOT|punkt|Punkt) [\w-]+)+|(?<![\w.+-])[\w.+-]+ @ [\w-]+(?: ?\. ?[\w-]+)+|(?<![\w.+-])[\w.+-]+(?:-at-|_at_)[\w-]+(?:(?:-dot-|_dot_|\.)[\w-]+)+(?=\W|$)"
)
_MAY_HIDE = re.compile(r"[(\[{<](?:at|a|ät|@)[)\]}>]| (?:dot|DOT|punkt|Punkt) | @ |[-_]at[-_]")
_PHONE = re.compile(r"(?<![\w/.+-])(?:\+|\(\+?)?\d(?:[\d()/.\-]|[ \u00a0](?=[\d(/-])){5,24}\d(?![\w])")
_ID_LABEL = r"(?:personalausweis\w*|ausweis(?:nummer|nr)?|id[ -]?card|identity card|reisepass\w*|passport|pass(?:nummer|nr)|matr(?:ikel)?\w*|student(?:en)?(?: |-)?(?:id|number|no|nummer|nr)|studierendennummer|bewerber\w*|applicant(?: |-)?(?:id|number|no)?|application (?:number|id)|steuer\w*(?:-id\w*|-nr|nummer)?|tax\b|tin\b|insurance|\w*versicher\w*|sv-\w+|kv-\w+)"
_ID = re.compile(r"\d(?:(?<=(?<![\w.@/+-])\d)|(?<=(?<![\w.@/+-])[A-Za-z]\d)|(?<=(?<![\w.@/+-])[A-Za-z]{2}\d)|(?<=(?<![\w.@/+-])[A-Za-z]{3}\d))(?:[\dA-Z]|[ /-](?=[\dA-Z]{2,})){4,15}(?![\w@])(?!\.\d)")  # behind up to three letters
_LABEL_BEFORE = re.compile(rf"(?i){_ID_LABEL}[\s>|.:#-]*(?:(?:id|number|no|nr|nummer|card)\b[\s>|.:#-]*)?(?:(?:is|ist|lautet|was|war)\b[\s>|:]*)?$")
_OTHER_BEFORE = re.compile(r"(?i)(?:order|parcel|receipt|bestell\w*|paket\w*|sendung\w*|rechnung\w*|invoice|beleg|module?\b.{0,12}|room|raum|EUR|€|version|error|fehler|code|katalog\w*|vorgang|aushang|aktenzeichen|likes?|got|isbn|konto\w*|iban)[\s>|.:#-]*$")
_PHONE_BEFORE = re.compile(r"(?i)(?:tel(?:efon)?|phone|mobile?|mobil|fon|handy|call(?: me)?|reach me (?:under|at|on)|erreichen (?:sie )?mich unter|unter|rückruf.{0,15}|ruf.{0,15}|fax|\bT|whatsapp|number)[\s>|.:]*$")
_STREET_DE = rf"[A-ZÄÖÜ][\wäöüß]*(?:-[A-ZÄÖÜ]?[\wäöüß]+)*(?:[ -])?(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Ww]eg|[Aa]llee|[Gg]asse|[Pp]latz|[Uu]fer|[Rr]ing|[Dd]amm|[Cc]haussee|[Ss]teig|[Pp]fad|[Ww]all|[Pp]romenade){_GAP}\d{{1,4}}(?:[ ]?[a-z](?!\w))?(?![\w:]|[./]\d)"
_STREET_AM = rf"(?:Am|An der|An den|Im|In der|Zum|Zur|Unter den|Auf dem|Auf der|Hinter dem|Vor dem){_GAP}(?:{_CAP}{_GAP}){{1,2}}\d{{1,4}}(?:[ ]?[a-z](?!\w))?(?![\w:%]|[./]\d|\.? ?(?:{_MONTHS}|Uhr))"
_STREET_EN = rf"(?<![\w.,/:-])\d{{1,4}}[a-z]?{_GAP}(?:{_CAP}{_GAP}){{1,3}}(?:Road|Street|Lane|Close|Row|Avenue|Way|Court|Drive|Place|Terrace|Gardens|Square|Hill|Crescent|Walk|Mews|Grove|Rd|St|Ave)\b"
_DE, _EN, _AM = re.compile(_STREET_DE), re.compile(_STREET_EN), re.compile(_STREET_AM)
#: What a text must hold for a street to be in it: a house number behind such an ending, before one of these words, or behind one of these.
_HOUSE = re.compile(r"[ \n\r\t>|]\d{1,4}(?:[ ]?[a-z])?(?![\w:]|[./]\d)")
_DE_ENDS = ("aße", "asse", "tr.", "weg", "Weg", "lee", "latz", "fer", "ing", "Ring", "amm", "see", "teig", "fad", "all", "ade", "Ufer", "Wall")
_NUMBERED = re.compile(r"\d[a-z]?[ \t\r\n>|]+[A-ZÄÖÜÀ-ÞČŠŽŁŚĆ]")
_EN_WORDS = ("Road", "Street", "Lane", "Close", "Row", "Avenue", "Way", "Court", "Drive", "Place", "Terrace", "Gardens", "Square", "Hill", "Crescent", "Walk", "Mews", "Grove", "Rd", "St ", "St\n", "St\r", "St,", "St.", "St;", "St)", "Ave")
_AM_WORDS = ("Am", "An de", "Im", "In der", "Zum", "Zur", "Unter den", "Auf de", "Hinter dem", "Vor dem")
_LABEL_HINTS = ("ausweis", "card", "pass", "matr", "stud", "bewerb", "applic", "steuer", "tax", "tin", "insur", "versicher", "sv-", "kv-")
#: Words after which a name may follow, and what may stand between; they are looked up in the lower-case text.
_PHRASE_WORDS = frozenset(("flatmate", "roommate", "classmate", "housemate", "mitbewohner", "kommiliton", "colleague", "kolleg", "friend", "freund", "tutor", "spoke", "talked", "wrote", "write", "letter", "brief", "sprach", "gesprochen", "telefonat", "met", "called", "ask", "named", "namens", "name is", "heiße", "signed", "contact", "ansprechpartner"))
_PHRASE_TAIL = re.compile(rf"\w*(?:{_GAP}(?:to|with|an|mit|is|ist))?{_GAP}({_LAST_FIRST}|{_SEQW})")
_CITY_AFTER = re.compile(rf"^,?[\s>|]*(?:(?:Flat|Apt|Apartment|Wohnung|Whg)\.?[ ]\w+,?[\s>|]*)?(?:\d{{4,5}}[ ]{_CAP}|{_CAP}\b)")
_ZIP_AFTER = re.compile(rf"^,?[\s>|]*\d{{4,5}}[ ]{_CAP}")
_ADDRESS_BEFORE = re.compile(r"(?i)(?:address(?: is)?|anschrift(?: lautet| ist)?|adresse(?: lautet| ist)?|wohne?(?:n|t)?(?: in| an)?(?: der)?|live at|letter to .{2,50},|brief an .{2,50},)[\s>|:]*$")
_PREFIX, _AT_LINE, _AM_FORM = re.compile(r"\+|00[1-9]|\(?0[1-9]"), re.compile(r"\n[>| ]*$"), re.compile(r"(?:Am|An|Im|In|Zum|Zur|Unter|Auf|Hinter|Vor)\b")
_LINE_BEFORE, _LINE_AFTER = re.compile(r"(?:^|\n)[>| \t]*$"), re.compile(r",?[ \t]*(?:\r?\n|$|\d|Flat)")
_TLD, _TLD_SPLIT = re.compile(r"[A-Za-z]{2,12}"), re.compile(r"[.\s)\]}_-]")
_THING_AFTER = re.compile(r"^(?:-[\wäöüß]+|[\s>|]+(?:GmbH|AG|KG|UG|SE|Ltd\.?|Inc\.?|LLC|e\.V\.|& (?:Co|Sons|Partner|Söhne)\w*|(?:[Pp]rize|[Aa]ward|[Mm]edal|[Ff]ellowship|[Ss]cholarship|Preis|Hall|House|Building|Library|Auditorium|[Ww]ing|Lecture|Theatre|Stiftung|Foundation|Institut\w*|Saal|Bau|Haus|Company|Group|Verlag|Press|Street|Road|Lane|University)\b))")
_THING_BEFORE = re.compile(r"(?:\b(?:[Tt]he|[Dd]er|[Dd]en|[Dd]em|[Dd]as|[Dd]ie|[Ii]m|Haus|Building|Gebäude|Raum|[Rr]oom|Hotel|Firma|[Cc]ompany)[ ]|[\wäöüß]-)$")
_PLACE_BEFORE = re.compile(r"(?:\b(?:in|aus|nach|at|from|bei|Haus|Standort|Campus|near|between|and|und|of|the)[ ]|\d{4,5} )$")


@dataclass
class Span:
    kind: str
    start: int
    end: int
    votes: dict[str, int]
    value: str = ""


@dataclass
class Model:
    """Learned gazetteers and, per type, labeler reliabilities and classifier weights; a few hundred kB at most."""

    names: frozenset[str]
    places: frozenset[str]
    reliability: dict[str, dict[str, float]]
    weights: list[float]
    bias: dict[str, float]


_THING_WORD = re.compile(r"-(?:Saal|Haus|Bau|Preis|Platz|Straße|Strasse|Str|Schule|Stiftung|Institut|Halle|Zentrum|Gymnasium|Brücke|Turm|Weg|Allee|Ring|Stipendium|Medaille|Archiv|Bibliothek|Gesellschaft|Universität|Hall|House|Prize|Award|Building|Street|Road)\\b".replace("\\\\", "\\"))


def _trim_seq(text: str, a: int, b: int, names: frozenset[str]) -> tuple[int, int]:
    """A run of capitalised words without titles and words that are no names at its ends."""
    words = [(m.start() + a, m.end() + a) for m in _NONSPACE.finditer(text[a:b])]
    bare = lambda s, e: text[s:e].strip(".")
    while words and (bare(*words[0]) in COMMON or len(words) > 2 and _INITIAL.fullmatch(text[slice(*words[0])]) and text[slice(*words[1])].split("-")[0] in names or text[words[0][0] : words[0][1]].lower() in ("dr.", "prof.", "mr.", "mrs.", "ms.")):
        words.pop(0)
    for k, (s, e) in enumerate(words):
        if k and bare(s, e) in COMMON:
            words = words[:k]
            break
    while words and (text[words[-1][0] : words[-1][1]].islower() and not text[words[0][0] : words[0][1]].islower() or _INITIAL.fullmatch(text[words[-1][0] : words[-1][1]])):
        words.pop()
    return (words[0][0], words[-1][1]) if words else (a, a)


@lru_cache(maxsize=8)
def _finder(words: frozenset[str]) -> ahocorasick.Automaton:
    """Finds all of the words, in lower case, in one pass over a text; gives where they end and their lengths."""
    out = ahocorasick.Automaton()
    for w in {w.lower() for w in words if w.lower().capitalize() in words or w.islower()}:
        out.add_word(w, len(w))
    if len(out) == 0:
        out.add_word("\0", 1)
    out.make_automaton()
    return out


def _may_hide(t: str) -> bool:
    """Whether a text has any of what _MAY_HIDE looks for; literal searches are far quicker than the pattern."""
    return (
        "(at" in t or "[at" in t or "{at" in t or "<at" in t or "(a)" in t or "[a]" in t or "(ät" in t or "[ät" in t or "(@" in t or "[@" in t or "{@" in t
        or " dot " in t or " DOT " in t or " punkt " in t or " Punkt " in t or " @ " in t or "-at" in t or "_at" in t)


def candidates(text: str, names: frozenset[str], places: frozenset[str]) -> list[Span]:
    """All proposed spans of `text` with their labelers' votes (1 for, -1 against)."""
    out: list[Span] = []
    near = lambda a, n=60: text[max(0, a - n) : a]

    def some(hints: tuple[str, ...]) -> bool:
        for h in hints:
            if h in text:
                return True
        return False

    mails = list(_EMAIL.finditer(text)) if "@" in text else []
    if _may_hide(text) and _MAY_HIDE.search(text):
        mails += [m for m in _HIDDEN_MAIL.finditer(text) if not any(m.start() < o.end() and o.start() < m.end() for o in mails)]
    for m in mails:
        v = m[0].rstrip(".-")
        tld = _TLD_SPLIT.split(v)[-1]
        out.append(Span("email", m.start(), m.start() + len(v), {"format": 1 if "@" in v and " " not in v else 0, "tld": 1 if _TLD.fullmatch(tld) else -1, "obfuscated": 0 if "@" in v else 1}))
    taken = [(s.start, s.end) for s in out]
    free = lambda a, b: not any(a < y and x < b for x, y in taken)
    for m in _ID.finditer(text):
        a, e = m.span()
        while a and m.start() - a < 3 and text[a - 1].isascii() and text[a - 1].isalpha():
            a -= 1
        if e - a < 6 or not free(a, e):
            continue
        b = near(a, 45)
        low = b.lower()
        label = any(h in low for h in _LABEL_HINTS) and bool(_LABEL_BEFORE.search(b))
        out.append(Span("id_number", a, e, {"label": 1 if label else -1, "other": -1 if _OTHER_BEFORE.search(b) else 0, "date": -1 if _ID_DATE.match(text, a, e) else 0, "shape": 1 if _ID_SHAPE.fullmatch(text, a, e) else 0}))
        if label:
            taken.append((a, e))
    for m in _PHONE.finditer(text):
        a, e = m.span()
        if not free(a, e):
            continue
        v, b = m[0], near(a, 40)
        n = sum(c.isdigit() for c in v)
        if n < 7 or n > 16 or v.count("(") != v.count(")") or _PHONE_DATE.match(v):
            continue
        out.append(Span("phone", a, e, {"prefix": 1 if _PREFIX.match(v) else -1, "length": 1 if n >= 9 else -1, "context": 1 if _PHONE_BEFORE.search(b) else 0, "line": 1 if _AT_LINE.search(b) or not b else 0, "other": -1 if _OTHER_BEFORE.search(b) or _LABEL_BEFORE.search(b) else 0}))
        taken.append((a, e))
    houses = [m.start() for m in _HOUSE.finditer(text)]
    streets: list[re.Match] = []
    if houses and any(text[max(0, k - 12) : k].rstrip(_SPACES).endswith(_DE_ENDS) for k in houses):
        streets += _DE.finditer(text)
    if _NUMBERED.search(text) and some(_EN_WORDS):
        streets += _EN.finditer(text)
    if houses and some(_AM_WORDS):
        streets += _AM.finditer(text)
    for m in streets:
        a, e = m.span()
        if not free(a, e):
            continue
        v, b, after = m[0], near(a, 70), text[e : e + 60]
        am = bool(_AM_FORM.match(v))
        if am and re.search(rf"\b(?:\w*(?:tag|mittwoch|semester|jahr|monat|uhr|modul|raum|abend|morgen)|{_MONTHS})\s+\d", v, re.I):
            continue
        line = bool(_LINE_BEFORE.search(b))
        out.append(Span("street_address", a, e, {"form": 0 if am else 1, "city": 1 if _ZIP_AFTER.match(after) or _CITY_AFTER.match(after) and not am else 0, "context": 1 if _ADDRESS_BEFORE.search(b) else 0, "line": 1 if line and _LINE_AFTER.match(after) else 0, "loose": -1 if am and not line and not _ZIP_AFTER.match(after) and not _ADDRESS_BEFORE.search(b) else 0}))
        taken.append((a, e))
    found: dict[int, Span] = {}

    def name(a: int, e: int, by: str, back: bool = False) -> None:
        while (k := text.find("\n", a, e)) >= 0 and k - text.rfind("\n", 0, k) - 1 < 45:  # no wrapped line
            if back:
                a = k + 1 + len(re.match(r"[>| \t]*", text[k + 1 : e])[0])
            else:
                e = k
        a, e = _trim_seq(text, a, e, names)
        if a >= e or e - a < 2 or not free(a, e):
            return
        for s in found.values():
            if s.start < e and a < s.end:  # one mention: the widest of what its anchors see
                if e - a > s.end - s.start and not (by == "gazetteer" and any(v == 1 for v in s.votes.values())):
                    del found[s.start]
                    s.start, s.end = a, e
                    found[a] = s
                s.votes[by] = 1
                return
        found[a] = Span("person_name", a, e, {by: 1})

    low = text.lower()
    if len(low) == len(text):
        for last, size in _finder(_PHRASE_WORDS).iter(low):
            k = last + 1 - size
            if (not k or not low[k - 1].isalnum()) and (m := _PHRASE_TAIL.match(text, last + 1)):
                name(m.start(1), m.end(1), "phrase")
    at, lines = 0, []
    for x in text.split("\n"):
        y = x.lstrip(">| \t")
        if y:
            end = at + len(x)
            lines.append((end - len(y), end, y[0], y.rstrip()[-1:] == ":"))
        else:
            lines.append((at, at, "", False))
        at += len(x) + 1
    colons = {i - d for i, x in enumerate(lines) if x[3] for d in range(3)}
    for i, (k, end, c, _) in enumerate(lines):
        if k >= end:
            continue
        for by, maybe in (("greeting", c in _GREETERS), ("closing", end - k < 90 and c in _CLOSERS), ("header", c in "*FVTACK"), ("dated", i in colons)):
            if maybe and (m := _ANCHORS[by].match(text, k)):
                g = next((n for n in range(1, (m.lastindex or 0) + 1) if m[n]), 0)
                if g and not (by in ("header", "dated") and m[g] in places):
                    name(m.start(g), m.end(g), by)
    for by, rx in _ANCHORS.items():
        if by in _OF_LINES or not some(_HINTS[by]):
            continue
        for m in rx.finditer(text):
            g = next((k for k in range(1, (m.lastindex or 0) + 1) if m[k]), 0)
            if g and not (by in ("header", "dated") and m[g] in places):
                name(m.start(g), m.end(g), by)
    for by, rx in _BEHIND.items():
        for m in rx.finditer(text):
            b = near(m.start(), 80)
            c = b.rstrip(" \t\r\n>|")
            if len(c) == len(b):
                continue
            tail = c[-60:].rsplit(None, 5)  # a name has no more words
            from_ = max(0, len(c) - 60) + (len(tail[0]) if len(tail) == 6 else 0)
            if n := _ENDS_IN_NAME.search(c, from_):
                name(m.start() - len(b) + n.start(1), m.start() - len(b) + len(c), by, True)
    for last, size in _finder(names).iter(text):
        k = last + 1 - size
        if text[last + 1 : last + 2] in (" ", "-") and (not k or not (text[k - 1].isalnum() or text[k - 1] in "_@.+-")) and (m := _LOWER_PAIR.match(text, k)):
            name(m.start(1), m.end(2), "lowercase")
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    last = 0
    for a, e in tokens:
        w = text[a:e]
        if w not in names:
            if "-" in w:
                w = w.split("-")[0]
            if len(w) > 1 and w[1].isupper():
                w = w.capitalize()
            if w not in names:
                continue
        if a < last:
            continue
        j = a - 1
        while j >= 0 and text[j] in _SPACES:
            j -= 1
        if 0 <= j < a - 1 and text[j] == "," and (n := _FAMILY_BEFORE.search(near(a, 40))) and n[1] not in COMMON and n[1] not in names and n[1] not in places:
            a = a - len(near(a, 40)) + n.start(1)
        elif n := _FAMILY_AFTER.match(text, e):
            line = text[text.rfind("\n", 0, e) + 1 : e]
            if n[2] not in COMMON and n[2] not in places and ("\n" not in n[1] or len(line) >= 45):
                e = n.end()
        last = e
        name(a, e, "gazetteer")
    taken += [(s.start, s.end) for s in found.values()]
    i = 0
    while i < len(tokens):  # two to four capitalised words side by side, whatever they are
        j = i
        while j + 1 < len(tokens) and j - i < 3 and text[tokens[j][1] : tokens[j + 1][0]] in _JOINS:
            j += 1
        if j > i:
            a, e = _trim_seq(text, tokens[i][0], tokens[j][1], names)
            if " " in text[a:e] and free(a, e):
                found[a] = Span("person_name", a, e, {"bare": -1})  # no context speaks for it
        i = j + 1
    for s in found.values():
        words = [w.strip(".,") for w in _NONSPACE.findall(text[s.start : s.end])]
        behind = text[s.end : s.end + 24]
        thing = _THING_AFTER.match(behind) or "-" in text[s.start : s.end] and _THING_WORD.search(text[s.start : s.end])
        hyphen = len(words) > 1 and behind[:1] == "-" and _THING_BEFORE.search(near(s.start, 24))  # what a thing's name goes on with
        s.votes.pop("gazetteer", None)
        s.votes["thing"] = -1 if thing or hyphen or len(words) > 1 and words[-1] in THINGS else 0
        s.votes["article"] = -1 if _THING_BEFORE.search(near(s.start, 24)) else 0
        s.votes["place"] = -1 if any(w in places for w in words) and not any(w in names for w in words) else 0
        s.votes["common"] = -1 if any(w in COMMON or w.islower() and w not in _PARTICLES for w in words) else 0
        s.votes["given"] = 1 if any(w.split("-")[0].capitalize() in names for w in words) else 0
        out.append(s)
    for s in out:
        s.value = text[s.start : s.end]
    return out


def _place(kind: str, feature: str) -> int:
    return crc32(f"{kind}|{feature}".encode()) % DIM


@lru_cache(maxsize=65_536)
def _look(kind: str, value: str) -> tuple[int, ...]:
    """What a span shows by itself."""
    shape = _LOWERS.sub("a", _UPPERS.sub("A", _DIGIT.sub("0", value)))
    words = value.split()
    fs = (f"s{shape}", f"n{len(words)}", f"x{words[-1][-4:] if words else ''}", f"p{words[0][:3] if words else ''}", f"w{words[0] if words else ''}")
    return tuple(_place(kind, f) for f in fs)


@lru_cache(maxsize=65_536)
def _votes(kind: str, votes: tuple[tuple[str, int], ...]) -> tuple[int, ...]:
    said = ",".join(f"{n}{v}" for n, v in sorted(votes) if v)
    return _place(kind, f"v{said}"), _place(kind, f"u{len(votes)}")


@lru_cache(maxsize=65_536)
def _around(kind: str, first: str, second: str, after: str) -> tuple[int, ...]:
    return _place(kind, f"b{second}"), _place(kind, f"bb{first} {second}"), _place(kind, f"a{after}")


def _features(text: str, s: Span) -> tuple[int, ...]:
    """Hashed features of a span and its surroundings; a fixed number of them."""
    before = text[max(0, s.start - 40) : s.start]
    words = before.rsplit(None, 2)
    line = "\n" if "\n" in before[len(before.rstrip(" \t>|\r\n")) :] else ""
    after = text[s.end : s.end + 30].split(None, 1)
    first, second = (words[-2] if len(words) > 1 else "", words[-1] if words else "")
    return (*_votes(s.kind, tuple(s.votes.items())), *_around(s.kind, first, second + line, after[0] if after else ""), *_look(s.kind, s.value))


def estimate(votes: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over labelers' votes (1, -1, 0 for none): probability of each span, reliability of each labeler.

    How often a labeler votes for true and for other spans is counted for each kind of vote by itself, so that one who is
    right against may be wrong for. Abstentions tell nothing, and a vote never tells the contrary: at worst its labeler has
    no weight left. Nothing is known of the labelers to begin with; two observations smooth each count.
    """
    kinds = ((votes == 1).astype(float), (votes == -1).astype(float))
    cast = sum(k.sum(0) for k in kinds)
    q = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    for _ in range(rounds):
        prior = float(np.clip(q.mean(), 0.02, 0.98))
        out = np.full(len(votes), np.log(prior / (1 - prior)))
        for k, low, high in ((kinds[0], 0.0, 6.0), (kinds[1], -6.0, 0.0)):
            true, other = (k.T @ q + 2 / 3) / (q.sum() + 2), (k.T @ (1 - q) + 2 / 3) / ((1 - q).sum() + 2)
            out += k @ np.clip(np.log(true / other), low, high)
        q = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
    return q, (kinds[0].T @ q + kinds[1].T @ (1 - q) + 1) / (cast + 2)


_GREETING = re.compile(_LINE + _ANCHORS["greeting"].pattern)
_WORD, _MAILBOX, _PLACE = re.compile(rf"(?<![\w@.-]){_CAP}(?![\w@])"), re.compile(rf"({_CAP})(?:[ \t]+{_CAP})[ \t]+<[^>]+@"), re.compile(rf"\b(?:in|aus|nach|at|from|Standort|Haus)[ ]({_CAP})")


def _count(t: str, first: Counter[str], place: Counter[str], total: Counter[str]) -> None:
    """Adds the words of a text as given names in mailboxes and greetings, as words behind prepositions of place, and at all."""
    total.update(_WORD.findall(t))
    if "<" in t:
        first.update(m[1].split("-")[0] for m in _MAILBOX.finditer(t))
    first.update(m[1].split("-")[0] for m in _GREETING.finditer(t) if " " not in m[1].strip())
    place.update(m[1] for m in _PLACE.finditer(t))


def _gazetteers(first: Counter[str], place: Counter[str], total: Counter[str], given: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    names = {w for w, c in first.items() if c >= 3 and w not in COMMON and c >= 0.05 * total[w] and len(w) > 1 and not w.isupper()}
    places = {w for w, c in place.items() if c >= 3 and c >= 0.25 * total[w]} - names - given
    return frozenset(given | names), frozenset(places)


def _learned(texts: list[str], given: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Gazetteers learned from texts: given names seen in mailboxes and greetings, and words that stand after prepositions of place."""
    first, place, total = Counter(), Counter(), Counter()
    for t in texts:
        _count(t, first, place, total)
    return _gazetteers(first, place, total, given)


def learned_on(df: DataFrame, text: str, given: frozenset[str] = GIVEN) -> tuple[frozenset[str], frozenset[str]]:
    """The gazetteers of all texts of a column, counted by the tasks; only words that may be in one come to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter(), Counter()
        for b in it:
            for s in b.column(0).to_pylist():
                if s:
                    _count(s, *counts)
            if sum(map(len, counts)) > 300_000:
                yield packed(*counts)
                counts = Counter(), Counter(), Counter()
        yield packed(*counts)

    def packed(first: Counter[str], place: Counter[str], total: Counter[str]) -> pa.RecordBatch:
        words = sorted({*first, *place, *total})
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (first, place, total))], names=["w", "first", "place", "total"])

    sums = df.select(text).mapInArrow(run, "w string, first long, place long, total long").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("first", "place", "total")))
    rows = sums.where("(first >= 3 AND first >= 0.05 * total) OR (place >= 3 AND place >= 0.25 * total)").collect()
    return _gazetteers(*(Counter({r["w"]: r[c] for r in rows}) for c in ("first", "place", "total")), given)


def fit(texts: list[str], rounds: int = 80, given: frozenset[str] = GIVEN, learned: tuple[frozenset[str], frozenset[str]] | None = None) -> Model:
    """Reliabilities and the final classifier from a sample of texts, without labels; gazetteers from it as well where they aren't given as `learned`."""
    names, places = learned or _learned(texts, given)
    spans = [(t, s) for t in texts for s in candidates(t, names, places)]
    weights, bias, rel = np.zeros(DIM), {}, {}
    for kind in TYPES:
        own = [(t, s) for t, s in spans if s.kind == kind]
        if not own:
            bias[kind], rel[kind] = 0.0, {}
            continue
        lf = sorted({n for _, s in own for n in s.votes})
        votes = np.array([[s.votes.get(n, 0) for n in lf] for _, s in own], float)
        q, acc = estimate(votes)
        rel[kind] = dict(zip(lf, acc.round(3).tolist(), strict=True))
        ids = np.array([_features(t, s) for t, s in own])
        b, g2 = 0.0, np.full(DIM, 1e-6)
        w, gb = np.zeros(DIM), 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(w[ids].sum(1) + b, -30, 30)))
            err = (p - q) / len(q)
            g = np.bincount(ids.ravel(), np.repeat(err, ids.shape[1]), DIM) + 1e-5 * w
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
            gb += err.sum() ** 2
            b -= 0.3 * err.sum() / np.sqrt(gb)
        weights += w
        bias[kind] = float(b)
    return Model(names, places, rel, weights.tolist(), bias)


def find(text: str, model: Model) -> list[Span]:
    """The accepted spans of a text, in order and without overlaps."""
    w = model.weights
    out = [s for s in candidates(text, model.names, model.places) if sum([w[i] for i in _features(text, s)]) + model.bias.get(s.kind, 0.0) > 0]
    if len(out) < 2:
        return out
    out.sort(key=lambda s: s.start)
    if all(a.end <= b.start for a, b in zip(out, out[1:])):
        return out
    kept: list[Span] = []
    for s in sorted(out, key=lambda s: (TYPES.index(s.kind), s.start)):  # of spans that overlap the first type stays
        if not any(s.start < k.end and k.start < s.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def replace(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def fit_on(df: DataFrame, group: str, text: str, sample: int = SAMPLE, total: int = 4 * SAMPLE) -> Model:
    """A model with gazetteers of all texts, fitted on distinct texts of every group, chosen by their hash: at most `sample` of each, and at most `total` over however many groups there are."""
    rows = df.select(F.col(group).alias("_g"), F.col(text).alias("_t")).where("_t <> ''")
    sizes = rows.groupBy("_g").agg(F.approx_count_distinct(F.xxhash64("_t"), 0.02).alias("n"))
    own = {r["_g"]: r["n"] for r in sizes.limit(1001).collect()}
    if len(own) > 1000:  # a share of each would be a dozen texts: one share of all
        own, n = {}, rows.agg(F.approx_count_distinct(F.xxhash64("_t"), 0.02)).first()[0]
    each = max(1, min(sample, total // max(len(own), 1))) if own else total
    part = F.lit(min(1.0, 1.3 * total / max(n, 1)) if not own else 1.0)
    for g, n in own.items():
        part = F.when(F.col("_g").eqNullSafe(F.lit(g)), min(1.0, 1.3 * each / n)).otherwise(part)
    h = F.pmod(F.xxhash64("_t"), F.lit(1 << 30))
    got = rows.withColumn("_h", h).where(F.col("_h") <= part * (1 << 30)).select(F.when(F.lit(bool(own)), F.col("_g")).alias("_g"), "_h", "_t").distinct().limit(4 * total).collect()
    taken: Counter[object] = Counter()
    texts: list[str] = []
    for r in sorted(got, key=lambda r: (r["_h"], str(r["_g"]), r["_t"])):
        taken[r["_g"]] += 1
        if taken[r["_g"]] <= each and len(texts) < total:
            texts.append(r["_t"])
    return fit(texts, learned=learned_on(df, text))


def detect(df: DataFrame, keys: list[str], text: str, model: Model, clean: bool = False) -> DataFrame:
    """Columns `keys` and, per mention, pii_type, start_pos (from 1) and end_pos; with `clean` one row a text and clean_text.

    Null texts give no mentions and a null clean_text, empty ones an empty one; keys may be null or repeated; rows are
    independent, so nothing is shuffled; other columns are ignored.
    """
    base = [df.schema[k] for k in keys]
    extra = [T.StructField("clean_text", T.StringType())] if clean else [T.StructField("pii_type", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]
    schema = T.StructType([*base, *extra])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(b.num_columns - 1).to_pylist()
            if clean:
                done = [None if s is None else replace(s, find(s, model)) for s in texts]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(done, pa.string())], names=schema.fieldNames())
                continue
            at, kind, start, end = [], [], [], []
            for i, s in enumerate(texts):
                if s:
                    for x in find(s, model):
                        at.append(i)
                        kind.append(x.kind)
                        start.append(x.start + 1)
                        end.append(x.end)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=schema.fieldNames())

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)
