"""Personal information in free text, by a skip-chain conditional random field.

The variables of a document are its candidate spans (mail addresses, long figures, street addresses,
pairs of capitalised words); their labels are O, email, phone, id_number, address and name. Unary
potentials come from features of the span's shape and of the words around it, chain edges join
neighbouring spans of a line, and skip edges join distant spans that share a surname or the whole
wording. Loopy belief propagation makes labels of one entity agree across the document: a name that is
told to be a founder in one sentence is no private person in the next.

The weights are learned here, from all documents and without labels. First, evidence beside a span labels it: a
title, a mail address that holds its name, a telephone number on its line, a label word before a figure; no
dictionary of sentences is used. A classifier of the context alone is fitted to these
labels, fills in those that have none and corrects those it surely contradicts. Then all weights are fitted at
once by pseudo-likelihood: unary weights and the potentials of chain and skip edges, each span given the
labels of its neighbours. Candidates are written once, with the features of each; words, features and equal rows
of both fits are counted over them where they are, and what reaches the driver is bounded. Words beyond all candidates
have no potential but O and need no variable; a document in which no message can outweigh any variable's margin
for O keeps O.
"""

from __future__ import annotations

import gc
import marshal
import pickle
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, count, repeat
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.session import broadcast_if_small, cut, scratch, spread

#: Size of a trial sample, and bound of the feature table of a fit and kind.
SAMPLE_DOCUMENTS = 4000
MOST_FEATURES = 20_000
#: So many different rows of a fit are summed up on the driver, more of them where they are.
MOST_ROWS = 500_000
#: Shares of copies add up to whole numbers but for so much.
EXACT = 1e-6
ROUNDS = 60
#: Messages are passed until none changes by more than the tolerance, at most so often.
PASSES, TOLERANCE = 50, 1e-3
#: So many words and wordings of names are remembered by a reader.
MOST_KEPT = 1 << 17
MOST_GIVEN = 5_000_000
LABELS = ["O", "email", "phone", "id_number", "address", "name"]
ALLOWED = {"email": [0, 1], "figure": [0, 2, 3], "address": [0, 4], "name": [0, 5]}

_D = "0-9０-９٠-٩۰-۹০-৯๐-๙"
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:['’\-][A-ZÀ-ÖØ-Þa-zà-öø-ÿ][a-zà-öø-ÿ]*)*"
_UP = r"[A-ZÀ-ÖØ-Þ]{2,}(?:['’\-][A-ZÀ-ÖØ-Þ]+)*"
_INI = r"[A-ZÀ-ÖØ-Þ]\."
#: A mail address is found from its at sign (or a word for it) outwards.
_AT = re.compile(r"[@＠]|\s?[(\[](?:at|AT|At)[)\]]\s?|\sAT\s")
_PLAIN_AT = re.compile("[@＠]")
_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*$")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]*[A-Za-z][A-Za-z0-9\-]*)+")
_SPELT = re.compile(r"[A-Za-z0-9\-]+(?:\s?(?:[(\[](?:dot|DOT|Dot)[)\]]|(?<=\s)DOT(?=\s))\s?[A-Za-z0-9\-]+|\.[A-Za-z0-9\-]*[A-Za-z][A-Za-z0-9\-]*)+")
FIGURE = re.compile(
    rf"(?<![\w@.,/－\-])(?:[+＋]\s?|[(（])?(?:[A-Z]{{1,2}}[ \-]?)?[{_D}](?:(?:[ .\-/－– ]|[)）]\s?|\s?[(（])?[{_D}]|[A-Z]{{1,2}}(?=[{_D}])|[ \-]?[A-Z](?![\w'’])(?<![{_D}][{_D}][{_D}][{_D}] [A-Z]))*"
)
#: Six digits with nothing between them but what a figure may hold, and all of that behind them: no other place
#: of a text has a figure of so many digits. Patterns begin with a set of characters where they can, which is searched fast.
_RUN = re.compile(rf"[{_D}](?<![{_D}][{_D}])(?:[ .\-/－–\xa0()（）\sA-Z+＋]*[{_D}]){{5,}}[ .\-/－–\xa0()（）\sA-Z+＋]*")
#: Words of street addresses.
_TOWN = rf"(?:{_CAP}(?:[ \-]{_CAP})?)"
ADDRESSES = [
    # flat, number, street, town, code
    (rf"[0-9](?<!\w[0-9])[0-9]{{0,4}}[A-Za-z]?\s+(?:{_CAP}\s+){{1,3}}(?:Street|Road|Lane|Avenue|Drive|Close|Way|Square|Terrace|Court|Place|Crescent|Row|Hill|Boulevard|St\.|Rd\.|Ave\.)", rf"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite|Room)\s+\w{{1,5}},\s+)?\b[0-9]{{1,5}}[A-Za-z]?\s+(?:{_CAP}\s+){{1,3}}(?:Street|Road|Lane|Avenue|Drive|Close|Way|Square|Terrace|Court|Place|Crescent|Row|Hill|Boulevard|St\.|Rd\.|Ave\.)(?:,\s+{_TOWN}(?:\s+[0-9]{{4,6}})?)?"),
    # street with its kind as the last part, number, code, town
    (r"(?:weg|stra(?:ß|ss)e|Straße|str\.|gasse|Gasse|platz|Platz|allee|Allee|ring|damm|ufer|Weg)\s+[0-9]", rf"(?:{_CAP}(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer)|{_CAP}\s+(?:Straße|Weg|Platz|Allee|Gasse))\s+[0-9]{{1,4}}\s?[a-z]?\b(?:,\s+(?:[0-9]{{4,5}}\s+)?{_TOWN})?"),
    # behind a bare preposition only with code and town: else "Im Jahr 1840" would do
    (r"[0-9]\s?[a-z]?,\s+[0-9]{4}", rf"\b(?:Am|An\s+der|Im|Zum|Zur|Auf\s+der|Unter\s+den)\s+{_CAP}\s+[0-9]{{1,4}}\s?[a-z]?,\s+[0-9]{{4,5}}\s+{_TOWN}"),
    # number, kind and name of the street
    (None, rf"[0-9](?<!\w[0-9])[0-9]{{0,3}}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|square)\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s*)*{_TOWN}(?:,\s+(?:[0-9]{{5}}\s+)?{_TOWN})?"),
    # kind and name of the street, number
    (r"[ACPR](?<!\w[ACPR])(?:alle|/|amino|arretera|vda\.|venida|v\.|laza|aseo|onda)", rf"\b(?:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Paseo|Camino|Carretera|Ronda)\s*(?:(?:de|del|la|las|los|el)\s+)*{_TOWN},?\s+(?:n\.?\s?[ºo°]\.?\s*)?[0-9]{{1,4}}(?:\s?[a-z]\b)?(?:,\s+[0-9]{{1,2}}\.?[ºª](?:\s?[A-Z]\b)?)?(?:,\s+(?:[0-9]{{5}}\s+)?{_TOWN})?"),
    # kind and name of the road, number
    (r"[BMN](?:arabara|taa|jia)\s", rf"\b(?:Barabara|Mtaa|Njia)\s+(?:ya|wa|la)\s+{_TOWN}\s+[0-9]{{1,4}}[a-z]?(?:,\s+{_TOWN})?"),
]
#: What the first four of these have to hold, and what the others.
_ANY_ADDRESS = [
    re.compile(
        r"[0-9](?:(?<!\w[0-9])(?:(?<=[egmrz.\s]\s[0-9])(?<=(?:[wW]eg|aße|sse|tr\.|atz|lee|ing|amm|fer|[\s\S][\s\S]\s)\s[0-9])"
        r"|[0-9]{0,4}+(?:(?:\s?(?:bis|ter|quater))?,?\s++(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|square)"
        rf"|[A-Za-z]?\s++(?:{_CAP}\s+){{1,3}}(?:Street|Road|Lane|Avenue|Drive|Close|Way|Square|Terrace|Court|Place|Crescent|Row|Hill|Boulevard|St\.|Rd\.|Ave\.)))|\s?[a-z]?,\s+[0-9]{{4}})"
    ),
    re.compile(r"[ABCMNPR](?:alle|/|amino|arretera|vda\.|venida|v\.|laza|aseo|onda|arabara|taa|jia)"),
]
#: A cheap pattern that has to occur, and the address itself.
ADDRESSES = [(quick and re.compile(quick), re.compile(full)) for quick, full in ADDRESSES]
#: Words that begin with a capital, and words in capitals, behind their first letter.
_CAP_REST, _UP_REST = r"[a-zà-öø-ÿ]++(?:['’\-][A-ZÀ-ÖØ-Þa-zà-öø-ÿ][a-zà-öø-ÿ]*+)*+", r"[A-ZÀ-ÖØ-Þ]++(?:['’\-][A-ZÀ-ÖØ-Þ]++)*+"
#: Pairs of capitalised words: word, initial and word; initial and word; word, comma and word or initial.
NAME = re.compile(
    rf"[A-ZÀ-ÖØ-Þ](?<![\w@.\-'’][A-ZÀ-ÖØ-Þ])(?:{_CAP_REST}(?:\s++(?:{_INI}\s++)?{_CAP}|,\s++(?:{_CAP}|{_INI})(?:\s+{_INI})?)|\.\s++(?:{_CAP}|{_UP})|{_UP_REST}(?:\s++(?:{_INI}\s++)?{_UP}|,\s++{_UP}))(?![\w@])"
)
_WORD = re.compile(r"[^\W\d_]+|[@:：<(（,.\-–—?!。\n]")
_LETTERS = re.compile(r"[^\W\d_]+")
_ANY_DIGIT = re.compile(f"[{_D}]")

#: Titles, and words that start a line of contact without being a name.
TITLES = set("dr mr mrs ms miss prof professor sir madam frau herr m mme mlle monsieur madame sra sr srta don doña señor señora bi bw bwana mzee".split())
STARTS = set(
    "signed contact contacto call mail deliveries for reported my send post fragen ansprechpartner para pour pièce el kwa wasiliana tuma kitambulisho the letters flat social ruf mi"
    " appelez adresser enviar die der das den tel phone dear from to attn cc re in on at since after before de du des le la les los las un una une und and with mit bei note".split()
)
#: Label words of figures, by what they announce.
CUES = {
    "phone": "phone ring tel telephone mobile cell call fax tél téléphone teléfono móvil telefon ruf anrufen appelez número llame simu piga nambari 电话 電話 手机 携帯 โทร โทรศัพท์ ফোন মোবাইল الهاتف هاتف جوال اتصل",
    "id": "passport id identity ssn social security licence license national ausweisnummer ausweis steuernummer personalausweis reisepass pièce identité passeport sécurité documento dni nie pasaporte kitambulisho pasipoti 身份证 护照 パスポート หนังสือเดินทาง บัตรประชาชน পাসপোর্ট جواز هوية",
    "other": "isbn issn catalogue inventory version shelf marks",
}
_FIGURE_CUE = {w: kind for kind, words in CUES.items() for w in words.split()}
#: Honorifics that stand behind a name in scripts without capital letters.
_EAST_NAME = re.compile(r"(?:[ァ-ヺー]{2,}・[ァ-ヺー]{2,}|[㐀-鿿]{2,6}·[㐀-鿿]{2,6}|[㐀-鿿]{2,4})(?=\s?(?:様|さん|氏|女士|小姐))")
_HONORIFICS = "様 さん 氏 女士 小姐".split()
_HONORIFIC = re.compile("|".join(_HONORIFICS))
_HONORIFIC_FIRST = {w[0] for w in _HONORIFICS}
_ADDRESS_WORDS = set("flat apartment apt unit suite room calle avda avenida plaza paseo camino am im zum zur rue avenue barabara mtaa njia".split())
_TITLE_M = re.compile(rf"M\.\s+(?:{_CAP}\s+(?:{_INI}\s+)?{_CAP}|{_CAP},\s+({_CAP})|{_INI}\s+{_CAP}|{_UP}\s+(?:{_INI}\s+)?{_UP}|{_UP},\s+{_UP}|{_INI}\s+{_UP})")
_CUE_TEXT = re.compile("电话|電話|手机|携帯|โทร|ফোন|মোবাইল|الهاتف|هاتف|جوال")


@dataclass(slots=True)
class Span:
    start: int
    end: int
    kind: str
    text: str
    values: list = field(default_factory=list)  # one per slot, None where it has none
    joined: bool = False  # to the span before it, on the same line


def mails(text: str) -> list[tuple[int, int]]:
    """Start and end of the mail addresses in a text, plain or spelt out."""
    out = []
    spelt = "at)" in text or "at]" in text or "AT" in text or "At)" in text or "At]" in text
    if spelt or "@" in text or "＠" in text:
        for m in (_AT if spelt else _PLAIN_AT).finditer(text):
            local = _LOCAL.search(text, max(0, m.start() - 64), m.start())
            domain = (_DOMAIN if m.group() in "@＠" else _SPELT).match(text, m.end()) if local else None
            if domain and (not out or local.start() >= out[-1][1]):
                out.append((local.start(), domain.end()))
    return out


def _has(words: list[str], text: str) -> bool:
    for w in words:
        if w in text:
            return True
    return False


class Kept(dict):
    """What ``make`` gives for a text, made once; emptied when it grows beyond its bound."""

    def __init__(self, make: Callable[[str], object]):
        self.make = make

    def __missing__(self, text: str):
        if len(self) >= MOST_KEPT:
            self.clear()
        out = self[text] = self.make(text)
        return out


class Reader:
    """Finds the candidate spans of a text and their features. ``common``: frequent
    capitalised words, a feature of the spans that hold them; ``given``: known given names, lower case."""

    def __init__(self, given: set[str], common: set[str]):
        self.given, self.common = given, common
        self.names, self.words = Kept(self._name), Kept(_split)

    def __reduce__(self):
        return Reader, (self.given, self.common)

    def _name(self, text: str) -> tuple[int, int, tuple, list[str], str]:
        """What a name's wording tells: how far to go on where it is none, where it may begin anew, its features (written
        how, whether a word is a given name, its last frequent word), its words of some length, and these in order."""
        given, common = self.given, self.common
        ws = [w.casefold() for w in _LETTERS.findall(text)]
        frequent = next((w for w in reversed(ws) if w in common and w not in given), None)
        form = "comma" if "," in text else "upper" if text.isupper() else "pair"
        words = [w for w in ws if len(w) > 1]
        first = words[0] if words else ""
        skip = second = 0
        if first in TITLES or first in STARTS:
            skip = _LETTERS.match(text).end()
        elif any(w in TITLES or w in _ADDRESS_WORDS for w in words[1:]):
            skip = 1 + len(first)
        elif first in common and first not in given:  # a frequent word before a pair is no part of it
            second = _LETTERS.match(text).end()
            while second < len(text) and text[second].isspace():
                second += 1
            second %= len(text)
        words = [w for w in words if len(w) > 2]
        return skip, second, (any(w in given for w in ws), frequent is not None, form, frequent), words, " ".join(sorted(words))

    def spans(self, text: str) -> list[Span]:
        starts: list[int] = []  # of the spans taken, in order, and their ends
        ends: list[int] = []
        out: list[Span] = []

        def add(start: int, end: int, kind: str) -> None:
            at = bisect(starts, start)
            if (not at or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
                starts.insert(at, start)
                ends.insert(at, end)
                out.append(Span(start, end, kind, text[start:end], self._values(kind, start, end, text)))

        for start, end in mails(text):
            add(start, end, "email")
        for quick, full in ADDRESSES[0 if _ANY_ADDRESS[0].search(text) else 4 : 6 if _ANY_ADDRESS[1].search(text) else 4]:
            if quick is None or quick.search(text):
                for m in full.finditer(text):
                    add(m.start(), m.end(), "address")
        for m in _figures(text):
            if m.end() - m.start() < 7:
                continue
            s = m.group()
            n = len(_ANY_DIGIT.findall(s))
            if n < 6:
                continue
            end = m.start() + len(s.rstrip(" .-/－–(（ "))
            s = text[m.start() : end]
            start = m.start()
            if s[0] in "(（" and not re.search("[)）]", s):
                start, s = start + 1, s[1:]
            if s[-1:] in ")）" and not re.search("[(（]", s):
                end, s = end - 1, s[:-1]
            if n >= 7 or re.search("[A-Z]", s):
                add(start, end, "figure")
        names, others = self.names, bool(out)
        at = 0
        while at >= 0:
            for m in NAME.finditer(text, at):
                wording = m[0]
                start, end = m.span()
                skip, second, *_ = name = names[wording]
                if wording.startswith("M.") and (title := _TITLE_M.match(text, start)) and (title[1] or "").casefold() not in _ADDRESS_WORDS:
                    at = start + 2
                    break
                if skip:
                    at = start + skip
                    break
                if second and NAME.match(text, start + second):
                    at = start + second
                    break
                if others:
                    add(start, end, "name")
                else:  # those before it end where it may begin
                    out.append(Span(start, end, "name", wording, self._values_of_name(name, start, end, text)))
            else:
                at = -1
        if _has(_HONORIFICS, text):
            if not others:
                starts, ends, others = [s.start for s in out], [s.end for s in out], True
            for m in _EAST_NAME.finditer(text):
                add(m.start(), m.end(), "name")
        if others:
            out.sort(key=lambda s: s.start)
        for a, b in zip(out, out[1:]):  # what stands beside it on the same line
            if b.start - a.end < 40 and text.find("\n", a.end, b.start) < 0:
                b.joined = True
                a.values[NEXT], b.values[PREV] = b.kind, a.kind
                if a.kind != b.kind and (a.kind == "email" and b.kind == "name" or a.kind == "name" and b.kind == "email"):
                    e, n = (a, b) if a.kind == "email" else (b, a)
                    if any(w.casefold() in e.text.casefold() for w in _LETTERS.findall(n.text) if len(w) > 3):
                        n.values[MAIL] = True
            elif b.start - a.end < 4 and not text[a.end : b.start].strip() and a.values[NEXT] is None:
                a.values[NEXT] = f"below {b.kind}"  # a line of its own above the next one
        return out

    def _values(self, kind: str, start: int, end: int, text: str) -> list:
        if kind == "name":
            return self._values_of_name(self.names[text[start:end]], start, end, text)
        v: list = [None] * SLOTS + [""]  # the last stands for what all have
        if kind == "figure":
            left, words, v[:FORM] = self._beside(10, 64, start, end, text)
            s = text[start:end]
            form = _UPPER.sub("A", _ANY_DIGIT.sub("9", s))
            v[FORM], v[9], v[10] = form, _NINES.sub("9", form), min(16, form.count("9"))
            v[11] = "plus" if s[0] in "+＋" else "open" if s[0] in "(（" else "zero" if s[:2] == "00" else "plain"
            cue = "phone" if _CUE_TEXT.search(text, max(left, start - 16), start) else next((_FIGURE_CUE[w] for w in words if w in _FIGURE_CUE), None)
            v[EVIDENCE] = cue  # the nearest one speaks
        return v

    def _values_of_name(self, name: tuple, start: int, end: int, text: str) -> list:
        _, words, v = self._beside(4, 44, start, end, text)
        v += name[2]
        behind = v[5]
        if not TITLES.isdisjoint(words[:2]) or behind and behind[0] in _HONORIFIC_FIRST and _HONORIFIC.match(text[end : end + 28].lstrip()):
            v.append("title")
        else:
            v.append(None)
        v += _REST
        return v

    def _beside(self, most: int, reach: int, start: int, end: int, text: str) -> tuple[int, list[str], list]:
        """Where what is looked at before a span begins, its words beginning with the nearest, and the slots of the
        words on both sides."""
        left, right = start - reach if start > reach else 0, end + 28
        line = text.rfind("\n", left, start)
        if line >= 0:
            left = line + 1
        line = text.find("\n", end, right)
        if line >= 0:
            right = line
        split, words, behind = self.words, [], []
        for piece in reversed(text[left:start].split()):
            words += split[piece][0]
            if len(words) >= most:
                break
        for piece in text[end:right].split():
            behind += split[piece][1]
            if len(behind) >= 3:
                break
        del words[most:], behind[3:]
        if len(words) < 4 or len(behind) < 3:
            return left, words, [*words[:4], *_NONE[len(words) : 4], " ".join(words[:2]), *behind, *_NONE[len(behind) : 3]]
        return left, words, [*words[:4], f"{words[0]} {words[1]}", *behind]


def _split(piece: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and marks of what stands between spaces, from its end and from its beginning."""
    words = tuple(w.casefold() for w in _WORD.findall(piece))
    return words[::-1], words


def _figures(text: str) -> Iterator[re.Match]:
    end = 0
    for run in _RUN.finditer(text):  # what may stand before the first digit is shorter than six characters
        yield from FIGURE.finditer(text, max(end, run.start() - 6), run.end() + 1)
        end = run.end()


#: Slots of a span's features: four words before it, the nearest two as one, three words behind; what it is
#: made of (8 to 11); evidence beside it: a title or label word, the kinds of its neighbours, a mail address.
GIVEN = FORM = 8
EVIDENCE, NEXT, PREV, MAIL = 12, 13, 14, 15
SLOTS = 16
_NONE, _REST = [None] * 4, [None] * 3 + [""]
CONTEXT = (*range(8), 9, 10, 11)
_UPPER, _NINES = re.compile("[A-Z]+"), re.compile("9+")
_DATE = re.compile(r"[0-9]{4}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}")


_NEAR = {"email", "figure", "address", "below email", "below address"}


def evidence(s: Span) -> int:
    """The label that stands beside a span; -1 where nothing speaks."""
    v = s.values
    if s.kind == "email":
        return 1
    if s.kind == "address":
        return 4
    if s.kind == "figure":
        cue = "other" if _DATE.fullmatch(s.text) else "phone" if v[11] == "plus" else v[EVIDENCE]
        return {"phone": 2, "id": 3, "other": 0, None: -1}[cue]
    near = v[NEXT] in _NEAR or v[PREV] in _NEAR
    if v[EVIDENCE] or v[MAIL] or v[GIVEN] and near:
        return 5
    return 0 if not near and (v[9] or not v[GIVEN]) else -1


def similar(spans: list[Span], reader: Reader) -> list[tuple[int, int, str]]:
    """Edges of a document: ``chain`` between neighbours on a line, ``same`` between distant spans of one
    wording (equal digits of figures), ``alike`` between names that share a surname."""
    edges: list[tuple[int, int, str]] = [(i, i + 1, "chain") for i, b in enumerate(spans[1:]) if b.joined]
    wholes: dict[str, int] = {}
    holds: dict[str, int] = {}  # the last name that holds a word
    figures: dict[str, int] = {}
    given, names = reader.given, reader.names
    for i, s in enumerate(spans):
        if s.kind == "name":
            *_, words, whole = names[s.text]
            if whole in wholes:
                edges.append((wholes[whole], i, "same"))
            else:
                for w in words:  # a shared surname, where the wording differs
                    if w in holds and w not in given:
                        edges.append((holds[w], i, "alike"))
                        break
            wholes[whole] = i
            for w in words:
                holds[w] = i
        elif s.kind == "figure":
            digits = "".join(_ANY_DIGIT.findall(s.text))
            if digits in figures:
                edges.append((figures[digits], i, "same"))
            figures[digits] = i
    return edges


def _parts(starts: list[int], edges: list[tuple[int, int, str]]) -> list[tuple[list[int], list[tuple[int, int, str]]]]:
    """The connected parts that hold any of ``starts``: their variables and edges."""
    beside: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    for e in edges:
        beside[e[0]].append(e)
        beside[e[1]].append(e)
    out, seen = [], set()
    for start in starts:
        if start not in seen:
            members, inside = [start], {}
            seen.add(start)
            for i in members:
                for e in beside[i]:
                    inside[e] = None
                    other = e[0] + e[1] - i
                    if other not in seen:
                        seen.add(other)
                        members.append(other)
            out.append((members, list(inside)))
    return out


EDGES = ("chain", "same", "alike")
Tables = dict[str, list[list[float]]]


class Model:
    """Weights of the field. ``weights``: kind → slot → value → one weight per label the kind allows, that of
    O being 0; ``tables``: edge kind → potentials of label pairs."""

    def __init__(self, weights: dict[str, list[dict]], tables: Tables, given: set[str], common: set[str]):
        self.weights, self.tables = weights, tables
        self.reader = Reader(given, common)
        self.tables_of: dict[str, list[tuple[dict, np.ndarray]]] = defaultdict(list)  # value → row of weights, by kind and slot
        # what one message can add to a label against O, whatever the neighbour is
        self.most = {k: max(t[y][x] - t[y][0] for y in range(len(LABELS)) for x in range(len(LABELS))) for k, t in tables.items()}

    def unary(self, s: Span) -> list[float]:
        slots = self.weights[s.kind]
        if s.kind == "name":
            total = 0.0
            for table, v in zip(slots, s.values):
                if v is not None:
                    w = table.get(v)
                    if w:
                        total += w[1]
            return [0.0, total]
        out = [0.0] * len(ALLOWED[s.kind])
        if len(out) == 2:  # mail and street addresses have no other reading
            out[1] = 1e3
            return out
        for table, v in zip(slots, s.values):
            w = table.get(v)
            if w:
                for k, x in enumerate(w):
                    out[k] += x
        return out

    def scores(self, flat: Flat) -> np.ndarray:
        """``unary`` of many spans at once, one row each."""
        if not self.tables_of:
            for kind in FITTED:
                for table in self.weights[kind]:
                    rows = np.array([*table.values(), [0.0] * len(ALLOWED[kind])])
                    self.tables_of[kind].append(({v: i for i, v in enumerate(table)}, rows))
        out = np.full((len(flat.ys), max(map(len, ALLOWED.values()))), -np.inf)
        out[:, :2] = 0.0, 1e3
        for kind, columns in flat.columns.items():
            most = np.zeros((len(columns[0]), len(ALLOWED[kind])))
            for column, (table, rows) in zip(columns, self.tables_of[kind]):
                most += rows[np.fromiter(map(table.get, column, repeat(len(table))), np.int32, len(most))]
            out[flat.at[kind], : most.shape[1]] = most
        return out

    def __reduce__(self):
        return Model, (self.weights, self.tables, self.reader.given, self.reader.common)

    def label(self, spans: list[Span]) -> list[int]:
        return self.decided([self.unary(s) for s in spans], [ALLOWED[s.kind] for s in spans], similar(spans, self.reader))

    def decided(self, scores: list[list[float]], kinds: list[list[int]], edges: Edges) -> list[int]:
        out = [k[0] if u[0] >= max(u) else k[u.index(max(u))] for k, u in zip(kinds, scores)]
        gain: dict[int, float] = {}
        for a, b, kind in edges:
            gain[a] = gain.get(a, 0.0) + self.most[kind]
            gain[b] = gain.get(b, 0.0) + self.most[kind]
        # where no message can outweigh the margin of any variable of a connected part, all of it is O
        doubtful = [i for i, g in gain.items() if scores[i][0] <= max(scores[i][1:]) + g]
        for members, edges in _parts(doubtful, edges) if doubtful else ():
            place = {i: n for n, i in enumerate(members)}
            near = [kinds[i] for i in members]
            for i, k, u in zip(members, near, self._beliefs([scores[i] for i in members], near, [(place[a], place[b], e) for a, b, e in edges])):
                out[i] = k[u.index(max(u))]
        return out

    def labels(self, read: list[Packed]) -> Iterator[tuple[int, list[int]]]:
        """Those documents of many of which a span is an entity, and the labels of their spans."""
        flat = Flat((1.0, p) for p in read)
        scores = self.scores(flat)
        gain = np.array([self.most[e] for e in EDGES])[flat.e]
        ends = np.r_[flat.a, flat.b]
        margin = scores[:, 1:].max(axis=1) + EXACT  # beyond what the order of a sum can change
        margin += np.maximum(0.0, np.bincount(ends, weights=np.r_[gain, gain], minlength=len(margin)))
        # in all others every span is O, whatever the messages
        kinds = [ALLOWED[KINDS[k]] for k in range(len(KINDS))]
        for d in np.unique(flat.of[margin >= 0]).tolist():
            first, of, edges = int(flat.first[d]), read[d][0], zip(*read[d][4:6], map(EDGES.__getitem__, read[d][6]))
            own = [kinds[k] for k in of]
            labels = self.decided([u[: len(k)] for u, k in zip(scores[first : first + len(of)].tolist(), own)], own, list(edges))
            if any(labels):
                yield d, labels

    def _beliefs(self, scores: list[list[float]], kinds: list[list[int]], edges: list[tuple[int, int, str]]) -> list[list[float]]:
        """Loopy sum-product in the log domain until the messages stand still; damped where there are loops,
        exact where there are none."""
        keep = 0.5 if len(edges) >= len(scores) else 0.0
        ways = []  # (source, target, potentials of their allowed labels, the message back)
        for a, b, kind in edges:
            t = self.tables[kind]
            n = len(ways)
            ways.append((a, b, [[t[y][x] for y in kinds[a]] for x in kinds[b]], n + 1))
            ways.append((b, a, [[t[x][y] for y in kinds[b]] for x in kinds[a]], n))
        messages = [[0.0] * len(kinds[b]) for _, b, _, _ in ways]
        belief = [list(u) for u in scores]
        for _ in range(PASSES):
            new, change = [], 0.0
            for (a, _, table, back), old in zip(ways, messages):
                if len(table) == 2 and len(belief[a]) == 2:  # as below, for two labels on both sides
                    (x, y), (less, more) = belief[a], messages[back]
                    x, y, ((s, t), (u, v)) = x - less, y - more, table
                    s, t, u, v = x + s, y + t, x + u, y + v
                    low = s + log(1.0 + exp(t - s)) if s >= t else t + log(exp(s - t) + 1.0)
                    high = u + log(1.0 + exp(v - u)) if u >= v else v + log(exp(u - v) + 1.0)
                    m = [0.0, (1 - keep) * (high - low) + keep * old[1]]
                    moved = abs(m[1] - old[1])
                else:
                    f = [x - y for x, y in zip(belief[a], messages[back])]
                    m = []
                    for row in table:
                        z = [x + y for x, y in zip(f, row)]
                        top = max(z)
                        m.append(top + log(sum(exp(x - top) for x in z)))
                    m = [(1 - keep) * (x - m[0]) + keep * y for x, y in zip(m, old)]
                    moved = max(abs(x - y) for x, y in zip(m, old))
                if moved > change:
                    change = moved
                new.append(m)
            messages = new
            belief = [list(u) for u in scores]
            for (_, b, _, _), m in zip(ways, messages):
                for k, x in enumerate(m):
                    belief[b][k] += x
            if change < TOLERANCE:
                break
        return belief

    def entities(self, text: str) -> list[tuple[str, str, int, int]]:
        """Type, wording, start and end of the spans that are entities."""
        spans = self.reader.spans(text)
        return [(LABELS[k], s.text, s.start, s.end) for s, k in zip(spans, self.label(spans)) if k]


FITTED = ("name", "figure")  # mail and street addresses have no other reading
#: Slots of the two fits: the context alone (and a figure's form), then all.
USED = {("context", "name"): CONTEXT, ("context", "figure"): tuple(range(12)), ("joint", "name"): tuple(range(SLOTS)), ("joint", "figure"): tuple(range(SLOTS))}
BIAS = (-1, "")
_CAPITALISED = re.compile(rf"[A-ZÀ-ÖØ-Þ](?<![\w'’][A-ZÀ-ÖØ-Þ])(?:{_CAP_REST}|{_UP_REST})")

Edges = list[tuple[int, int, str]]
KINDS = tuple(ALLOWED)
_KIND, _EDGE = {k: i for i, k in enumerate(KINDS)}, {e: i for i, e in enumerate(EDGES)}
#: What the fits need of a text: kinds of its spans (one byte each), their labels by evidence and 1, columns of the
#: values of its names and figures, both ends of its edges and their kinds.
Packed = tuple[bytes, bytes, tuple, tuple, tuple, tuple, bytes]
#: The share of a text (a page of n copies counts one n-th in each) and the text as packed.
Read = tuple[float, Packed]
#: Kind → feature (slot and value) → row of the weights.
Index = dict[str, dict[tuple, int]]


BESIDE = [(e, y) for e in EDGES for y in range(len(LABELS))]


class Flat:
    """The spans of many texts side by side: their columns of values by kind, labels by evidence, shares and
    edges."""

    def __init__(self, read: Iterable[Read]):
        shares, packed = zip(*rows) if (rows := list(read)) else ((), ())
        kinds, ys, names, figures, a, b, e = zip(*packed) if packed else ((),) * 7
        sizes = np.fromiter(map(len, kinds), np.int64, len(kinds))
        self.first = np.cumsum(sizes) - sizes
        self.of, self.share = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.array(shares, dtype=float), sizes)
        self.ys = np.frombuffer(b"".join(ys), np.uint8).astype(np.int64) - 1
        self.e = np.frombuffer(b"".join(e), np.uint8).astype(np.int64)
        start = np.repeat(self.first, np.fromiter(map(len, e), np.int64, len(e)))
        self.a, self.b = (start + np.fromiter(chain.from_iterable(x), np.int64, len(start)) for x in (a, b))
        of = np.frombuffer(b"".join(kinds), np.uint8)
        self.at = {kind: np.flatnonzero(of == _KIND[kind]) for kind in FITTED}
        self.columns = {kind: [list(chain.from_iterable(c)) for c in zip(*filter(None, own))] for kind, own in (("name", names), ("figure", figures)) if any(own)}

    def matrices(self, kind: str, indexes: dict[str, Index]) -> dict[str, np.ndarray]:
        """For each fit the rows of the weights of each span of a kind, that of the bias last; one behind all where it
        has none."""
        columns, places = self.columns[kind], {i: {} for i in USED["joint", kind]}
        for index in indexes.values():
            for slot, v in index[kind]:
                if slot in places:
                    places[slot].setdefault(v, len(places[slot]))
        out: dict[str, list[np.ndarray]] = {use: [] for use in indexes}
        rows = {}
        for use, index in indexes.items():
            for slot in USED[use, kind]:
                rows[use, slot] = np.full(len(places[slot]) + 1, len(index[kind]), dtype=np.int32)
            for (slot, v), n in index[kind].items():
                if (use, slot) in rows:
                    rows[use, slot][places[slot][v]] = n
        for slot, place in places.items():
            own = [use for use in indexes if (use, slot) in rows]
            if own:
                at = np.fromiter(map(place.get, columns[slot], repeat(len(place))), np.int32, len(columns[slot]))
                for use in own:
                    out[use].append(rows[use, slot][at])
        return {use: np.stack([*m, np.full(len(columns[0]), indexes[use][kind][BIAS], dtype=np.int32)], axis=1) for use, m in out.items()}

    def beside(self, ys: np.ndarray) -> np.ndarray:
        """How often each label stands beside a span along each kind of edge."""
        n, most = len(ys), len(LABELS)
        flat = np.bincount(np.r_[self.a, self.b] * len(BESIDE) + np.r_[self.e, self.e] * most + ys[np.r_[self.b, self.a]], minlength=n * len(BESIDE))
        return flat.reshape(n, len(BESIDE)).astype(np.int32)


@dataclass
class Block:
    """Equal rows of one kind told once: rows of the weights, counts of the labels beside it (none in the fit of the
    context), the column of its label and how often it comes up."""

    m: np.ndarray
    beside: np.ndarray
    y: np.ndarray
    n: np.ndarray

    @cached_property
    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and count of the few labels beside."""
        rows, columns = np.nonzero(self.beside)
        return rows, columns, self.beside[rows, columns].astype(float)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        z = _sums(w, self.m)
        rows, columns, counts = self.near
        behind = len(w) - self.beside.shape[1]
        for k in range(1, w.shape[1]):
            z[:, k] += np.bincount(rows, weights=counts * w[behind + columns, k], minlength=len(z))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(z)), self.y] -= 1.0
        p *= self.n[:, None]
        grad = np.zeros(w.shape)
        for k in range(1, w.shape[1]):
            own = np.ascontiguousarray(p[:, k])
            for column in self.m.T:
                grad[:, k] += np.bincount(column, weights=own, minlength=len(w) + 1)[:-1]
            grad[behind:, k] += np.bincount(columns, weights=counts * p[rows, k], minlength=self.beside.shape[1])
        return grad


def _sums(w: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of each row, one column per allowed label."""
    z = np.zeros((len(m), w.shape[1]))
    for k in range(1, w.shape[1]):
        own, total = np.append(w[:, k], 0.0), np.zeros(len(m))
        for column in m.T:  # no table of all weights is made
            total += own[column]
        z[:, k] = total
    return z


def _descent(index: Index, total: dict[str, float], gradient: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Weights of a multinomial logistic model per kind over sparse features: one row per feature, one column
    per allowed label, that of the first (O) being 0. ``gradient``: its sum over all rows."""
    w = {k: np.zeros((len(index[k]), len(ALLOWED[k]))) for k in index}
    g2 = {k: np.full(x.shape, 1e-6) for k, x in w.items()}
    for _ in range(ROUNDS if total else 0):
        for k, g in gradient(w).items():
            grad = (g / total[k] + 1e-5 * w[k])[:, 1:]
            g2[k][:, 1:] += grad * grad
            w[k][:, 1:] -= 0.5 * grad / np.sqrt(g2[k][:, 1:])
    return w


def _whole(blocks: Iterable[tuple[str, Block]]) -> dict[str, Block]:
    by: dict[str, list[Block]] = defaultdict(list)
    for kind, b in blocks:
        by[kind].append(b)
    return {k: Block(np.asfortranarray(np.concatenate([b.m for b in bs])), *(np.concatenate([getattr(b, f) for b in bs]) for f in ("beside", "y", "n"))) for k, bs in by.items()}


def _gradients(blocks: dict[str, Block], w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: b.gradient(w[k]) for k, b in blocks.items()}


def _words(texts: Iterable[tuple[str, float]]) -> dict[str, list[float]]:
    """In how many texts a capitalised word stands, and in how many in a mail address; "" for all texts."""
    out: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    seen: dict[float, Counter] = defaultdict(Counter)
    folded = Kept(str.casefold)
    for t, share in texts:
        seen[share].update({folded[w] for w in set(_CAPITALISED.findall(t))})
        for w in {w.casefold() for a, b in mails(t) for w in _LETTERS.findall(re.split("[@＠]|\\s|[(\\[]", t[a:b])[0])}:
            out[w][1] += share
        out[""][0] += share
    for share, words in seen.items():
        for w, n in words.items():
            out[w][0] += share * n
    return out


def _least_common(texts: float) -> float:
    """A feature only: with few texts a name may be frequent by chance."""
    return max(8, 0.008 * texts) - EXACT


def _common(words: Iterable[tuple[str, float, float]]) -> set[str]:
    """Of the words that stand in enough texts, those that are no part of mail addresses."""
    return {w for w, seen, mailed in words if w and not (mailed >= 3 - EXACT and len(w) > 2 and 20 * mailed >= seen - EXACT)}


def _counts(read: Iterable[Read]) -> dict[tuple, list[float]]:
    """How often a feature (kind, slot, value) comes up in spans that evidence labels, and in all."""
    flat, out = Flat(read), {}
    for kind, columns in flat.columns.items():
        at = flat.at[kind]
        weights = flat.share[at]
        known = weights * (flat.ys[at] >= 0)
        for i in USED["joint", kind]:
            place: dict[object, int] = defaultdict(count().__next__)
            rows = np.fromiter(map(place.__getitem__, columns[i]), np.int64, len(at))
            for v, *n in zip(place, np.bincount(rows, known).tolist(), np.bincount(rows, weights).tolist()):
                if v is not None:
                    out[kind, i, v] = n
    return out


def _least_seen(sizes: dict[int, int]) -> int:
    """From how often on a feature has a weight: twice, or as often as leaves at most ``MOST_FEATURES`` of
    them. ``sizes``: how many features come up so often."""
    least, n = max(sizes, default=1) + 1, 0
    for often in sorted(sizes, reverse=True):
        n += sizes[often]
        if often < 2 or n > MOST_FEATURES:
            break
        least = often
    return least


def _index(use: str, features: Iterable[tuple[str, int, object]]) -> Index:
    """Rows of the weights of the features (kind, slot, value), of the bias and of the labels of neighbours."""
    out: Index = {}
    for kind in FITTED:
        own = sorted(((i, v) for k, i, v in features if k == kind), key=lambda f: (f[0], str(f[1])))
        out[kind] = {f: n for n, f in enumerate([*own, BIAS, *(BESIDE if use == "joint" else ())])}
    return out


def _rows(read: Iterable[Read], indexes: dict[str, Index], context: dict[str, np.ndarray] | None) -> Counter:
    """Equal rows of a fit: kind; rows of the weights, labels beside it and the column of its label in one. Without
    ``context`` those of the spans that evidence labels, by their context; with it those of all spans."""
    use = "joint" if context else "context"
    flat, out = Flat(read), Counter()
    matrices = {kind: flat.matrices(kind, indexes if context else {use: indexes[use]}) for kind in flat.columns}
    ys = _completed(flat, {kind: m["context"] for kind, m in matrices.items()}, context) if context else flat.ys
    beside = flat.beside(ys) if context else np.empty((len(ys), 0), dtype=np.int32)
    for kind in flat.columns:
        at = flat.at[kind]
        column = np.full(len(LABELS) + 1, -1)
        column[ALLOWED[kind]] = range(len(ALLOWED[kind]))  # the last, of no evidence, has none
        y = column[ys[at]]
        rows = np.hstack([matrices[kind][use], beside[at], y[:, None]]).astype(np.int32)
        share = flat.share[at]
        for part in np.unique(share).tolist():
            own = np.ascontiguousarray(rows[(y >= 0) & (share == part)])
            for row, n in Counter(own.view(f"V{4 * own.shape[1]}").ravel().tolist()).items():
                out[kind, row] += part * n
    return out


def _completed(flat: Flat, matrices: dict[str, np.ndarray], context: dict[str, np.ndarray]) -> np.ndarray:
    """Labels by evidence and, where it is silent, by the context alone; evidence against a name that the
    context surely contradicts is turned."""
    out = flat.ys.copy()
    for kind in flat.columns:
        at = flat.at[kind]
        z = _sums(context[kind], matrices[kind])
        best, top = z.argmax(axis=1), z.max(axis=1)
        sure = 1 / np.exp(z - top[:, None]).sum(axis=1) > 0.95
        told = out[at]
        turned = (told < 0) | (kind == "name") & (told == 0) & (best > 0) & sure
        out[at] = np.where(turned, np.array(ALLOWED[kind])[best], told)
    return out


def _weights(index: Index, w: dict[str, np.ndarray]) -> tuple[dict[str, list[dict]], Tables]:
    """The field's weights and potentials out of those of the joint fit."""
    weights: dict[str, list[dict]] = {k: [{} for _ in range(SLOTS + 1)] for k in ALLOWED}
    sums = {k: np.zeros((len(LABELS), len(LABELS))) for k in EDGES}
    for kind, features in index.items():
        for f, i in features.items():
            row = w[kind][i]
            if f == BIAS:
                weights[kind][SLOTS][""] = row.tolist()
            elif isinstance(f[0], str):  # potentials of this kind's labels beside a neighbour's
                for k, label in enumerate(ALLOWED[kind]):
                    sums[f[0]][f[1], label] += row[k]
            elif np.abs(row).max() > 1e-3:
                weights[kind][f[0]][f[1]] = row.tolist()
    # an edge is seen from both of its ends
    return weights, {k: ((t + t.T) / 2).tolist() for k, t in sums.items()}


def _block(kind: str, rows: list[bytes], n: list[float], use: str) -> Block:
    width, own = len(rows[0]) // 4, len(USED[use, kind]) + 1
    m = np.frombuffer(b"".join(rows), dtype=np.int32).reshape(len(rows), width)
    return Block(np.asfortranarray(m[:, :own]), np.ascontiguousarray(m[:, own:-1]), m[:, -1].astype(np.int64), np.array(n, dtype=float))


def fit(texts: list[str], given: set[str]) -> Model:
    """The field fitted to a list of texts, as ``trained`` does to a frame."""
    texts = list(dict.fromkeys(texts))  # copies of a page count once
    words = _words((t, 1.0) for t in texts)
    least = _least_common(len(texts))
    reader = Reader(given, _common((w, *n) for w, n in words.items() if n[0] >= least))
    read: list[Read] = [(1.0, _packed(spans, similar(spans, reader))) for t in texts if (spans := reader.spans(t))]
    counts = _counts(read)
    indexes: dict[str, Index] = {}
    for use in ("context", "joint"):
        kept = []
        for kind in FITTED:
            own = {f: n[use == "joint"] for f, n in counts.items() if f[0] == kind and f[1] in USED[use, kind]}
            least = _least_seen(Counter(int(n) for n in own.values()))
            kept += [f for f, n in own.items() if n >= least]
        indexes[use] = _index(use, kept)

    def solved(use: str, context: dict | None) -> dict[str, np.ndarray]:
        by: dict[str, list] = defaultdict(list)
        for (kind, row), n in _rows(read, indexes, context).items():
            by[kind].append((row, n))
        blocks = {kind: _block(kind, *zip(*rows), use) for kind, rows in by.items()}
        return _descent(indexes[use], {k: float(b.n.sum()) for k, b in blocks.items()}, lambda w: _gradients(blocks, w))

    return Model(*_weights(indexes["joint"], solved("joint", solved("context", None))), given, reader.common)


def sample(documents: DataFrame, most: int = SAMPLE_DOCUMENTS) -> list[str]:
    """At most ``most`` texts for trials; ``trained`` doesn't use it. Those whose hash of doc_id falls below the
    share that ``most`` is of all rows (a tenth more, then cut by hash order)."""
    share = min(1.0, 1.1 * most / max(1, documents.count()))
    of = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = documents.select("doc_id", "text", of.alias("h")).filter(F.col("text").isNotNull() & (F.length("text") > 0) & (F.col("h") < F.lit(ceil(share * (1 << 30)))))
    return [r["text"] for r in sorted(rows.collect(), key=lambda r: (r["h"], str(r["doc_id"])))[:most]]


def _usable(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") > 0))


def _kept(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` without searches for cycles, which there are none of among the many small lists of a batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return wrapped


def _shared(documents: DataFrame) -> DataFrame:
    """doc_id, text, share: what a text counts, so that all copies of a page count as one. Only digests move."""
    texts = _usable(documents).withColumn("key", F.unhex(F.md5("text")))
    copies = cut(texts.groupBy("key").count().filter("count > 1"))
    once = texts.join(broadcast_if_small(copies, copies.count()), "key", "left")
    return spread(once.select("doc_id", "text", (F.lit(1.0) / F.coalesce("count", F.lit(1))).alias("share")))


def _reader(shared: DataFrame, given_names: DataFrame) -> Reader:
    """Given names as they are, frequent words as counted over all texts."""
    names = given_names.select(F.lower(F.trim("given_name")).alias("n")).filter("n IS NOT NULL AND n <> ''").distinct()
    n = names.count()
    if n > MOST_GIVEN:
        raise ValueError(f"{n} given names are more than {MOST_GIVEN}")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _words(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([x[i] for x in found.values()], pa.float64()) for i in (0, 1))], ["word", "seen", "mailed"])

    told = shared.select("text", "share").mapInArrow(_kept(words), "word string, seen double, mailed double")
    told = cut(told.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("mailed").alias("mailed")).filter((F.col("seen") >= _least_common(0)) | (F.col("word") == "")))
    texts = sum(r["seen"] for r in told.filter(F.col("word") == "").collect())
    frequent = told.filter(F.col("seen") >= _least_common(texts)).collect()  # few: a text holds few words
    return Reader({r["n"].casefold() for r in names.toLocalIterator()}, _common(map(tuple, frequent)))


def _packed(spans: list[Span], edges: list[tuple[int, int, str]]) -> Packed:
    a, b, e = zip(*edges) if edges else ((), (), ())
    return (
        bytes([_KIND[s.kind] for s in spans]),
        bytes([evidence(s) + 1 for s in spans]),
        *(tuple(zip(*[s.values for s in spans if s.kind == kind])) for kind in FITTED),
        a,
        b,
        bytes([_EDGE[x] for x in e]),
    )


def spans_of(shared: DataFrame, reader: Reader) -> DataFrame:
    """doc_id, share, spans, places: the candidates of every text that has any and their edges, written once for the
    fits and the labels, and where they stand; without a share the counts of their features, one row per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "share", "spans", "places"]
        for b in batches:
            texts = b.column(1).to_pylist()
            found = {}
            for t in dict.fromkeys(texts):  # copies of a page are read once
                spans = reader.spans(t)
                if spans:
                    found[t] = _packed(spans, similar(spans, reader)), marshal.dumps([(s.start, s.end, s.text) for s in spans])
            counts = _counts((share, found[t][0]) for t, share in zip(texts, b.column(2).to_pylist()) if t in found)
            packed = {t: (marshal.dumps(f), places) for t, (f, places) in found.items()}
            own = [packed.get(t, (None, None)) for t in texts]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([x[i] for x in own], pa.binary()) for i in (0, 1))], names)
            yield out.filter(out.column(2).is_valid())
            if counts:
                rows = [(*f, *n) for f, n in counts.items()]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column(0).type), pa.nulls(1, pa.float64()), pa.array([marshal.dumps(rows)], pa.binary()), pa.nulls(1, pa.binary())], names)

    spark = shared.sparkSession
    path = scratch(spark, "pii-spans")
    shared.mapInArrow(_kept(run), f"doc_id {dict(shared.dtypes)['doc_id']}, share double, spans binary, places binary").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _read(b: pa.RecordBatch) -> Iterator[Read]:
    return zip(b.column(0).to_pylist(), map(marshal.loads, b.column(1).to_pylist()))


def _indexes(written: DataFrame) -> dict[str, Index]:
    """The features that have a weight, counted over all spans: at most ``MOST_FEATURES`` per fit and kind."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0).to_pylist():
                kind, slot, value, context, joint = zip(*marshal.loads(packed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(slot, pa.int32()), pa.array([marshal.dumps(v, 2) for v in value], pa.binary()), pa.array(context, pa.float64()), pa.array(joint, pa.float64())],
                    ["kind", "slot", "value", "context", "joint"],
                )

    told = written.filter("share IS NULL").select("spans").mapInArrow(counts, "kind string, slot int, value binary, context double, joint double").groupBy("kind", "slot", "value")
    told = cut(told.agg(*(F.floor(F.sum(use) + EXACT).alias(use) for use in ("context", "joint"))).filter("joint >= 2"))
    in_context = F.lit(False)
    for kind in FITTED:
        in_context |= (F.col("kind") == kind) & F.col("slot").isin(*USED["context", kind])
    told = told.withColumn("context", F.when(in_context, F.col("context")).otherwise(0))
    told = told.select("kind", "slot", "value", F.explode(F.create_map(F.lit("context"), "context", F.lit("joint"), "joint")).alias("use", "n")).filter("n >= 2")
    sizes: dict[tuple, dict[int, int]] = defaultdict(dict)
    for r in told.groupBy("use", "kind", "n").agg(F.count(F.lit(1)).alias("k")).collect():
        sizes[r["use"], r["kind"]][r["n"]] = r["k"]
    kept = F.lit(False)
    for (use, kind), own in sizes.items():
        kept |= (F.col("use") == use) & (F.col("kind") == kind) & (F.col("n") >= _least_seen(own))
    features: dict[str, list[tuple]] = defaultdict(list)
    for r in told.filter(kept).collect():
        features[r["use"]].append((r["kind"], r["slot"], marshal.loads(r["value"])))
    return {use: _index(use, features[use]) for use in ("context", "joint")}


def _solved(spans: DataFrame, indexes: dict[str, Index], context: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """The weights of one fit over all spans. Equal rows are told once; up to ``MOST_ROWS`` of them are summed
    up here, more where they are, round by round: the sums are the same."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _rows(_read(b), indexes, context)
            if found:
                kind, row = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(row, pa.binary()), pa.array(list(found.values()), pa.float64())], ["kind", "row", "n"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind in FITTED:
                own = b.filter(pc.equal(b.column(0), kind))
                if own.num_rows:
                    block = _block(kind, own.column(1).to_pylist(), own.column(2).to_pylist(), use)
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([own.num_rows]), pa.array([float(block.n.sum())]), pa.array([pickle.dumps(block)], pa.binary())], ["kind", "rows", "n", "block"])

    use = "joint" if context else "context"
    index = indexes[use]
    told = spans.select("share", "spans").mapInArrow(_kept(rows), "kind string, row binary, n double").groupBy("kind", "row").agg(F.sum("n").alias("n"))
    told = cut(told.mapInArrow(blocks, "kind string, rows long, n double, block binary"))
    sums = told.groupBy("kind").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n")).collect()
    total = {r["kind"]: r["n"] for r in sums}
    if sum(r["rows"] for r in sums) <= MOST_ROWS:
        here = _whole((r["kind"], pickle.loads(r["block"])) for r in told.select("kind", "block").toLocalIterator())
        return _descent(index, total, lambda w: _gradients(here, w))
    there = told.select("kind", "block").rdd.map(lambda r: (r[0], bytes(r[1])))

    def gradient(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        known = spans.sparkSession.sparkContext.broadcast(w)

        def summed(part: Iterator[tuple[str, bytes]]) -> Iterator[dict[str, np.ndarray]]:
            out = {k: np.zeros(x.shape) for k, x in known.value.items() if k in total}
            for kind, block in part:
                out[kind] += pickle.loads(block).gradient(known.value[kind])
            yield out

        found = there.mapPartitions(summed).treeReduce(lambda a, b: {k: a[k] + b[k] for k in a})
        known.destroy()
        return found

    return _descent(index, total, gradient)


def _fitted(written: DataFrame, reader: Reader) -> Model:
    indexes, spans = _indexes(written), _with_spans(written)
    return Model(*_weights(indexes["joint"], _solved(spans, indexes, _solved(spans, indexes, None))), reader.given, reader.common)


def _with_spans(written: DataFrame) -> DataFrame:
    return spread(written.filter("share IS NOT NULL"))


def trained(documents: DataFrame, given_names: DataFrame) -> Model:
    """The field fitted to all documents. ``given_names``: given_name, a dictionary that every executor
    holds; its size is checked, more than ``MOST_GIVEN`` names are an error."""
    shared = _shared(documents)
    reader = _reader(shared, given_names)
    return _fitted(spans_of(shared, reader), reader)


def found(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """``entities`` by the field fitted to the same documents; each text is searched once for both."""
    shared = _shared(documents)
    reader = _reader(shared, given_names)
    written = spans_of(shared, reader)
    model = _fitted(written, reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [marshal.loads(packed) for packed in b.column(1).to_pylist()]
            ids, places, rows = b.column(0), b.column(2), []
            for d, labels in model.labels(read):
                own = ids[d].as_py()
                rows += [(own, LABELS[k], text, start, end) for k, (start, end, text) in zip(labels, marshal.loads(places[d].as_py())) if k]
            if rows:
                yield _entity_batch(rows, b.schema.field(0).type)

    return _with_spans(written).select("doc_id", "spans", "places").mapInArrow(_kept(run), _entity_schema(documents))


def _entity_schema(documents: DataFrame) -> str:
    return f"doc_id {dict(documents.dtypes)['doc_id']}, pii_type string, pii_text string, start int, length int"


def _entity_batch(rows: list[tuple], doc_id: pa.DataType) -> pa.RecordBatch:
    ids, kinds, texts, starts, ends = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, doc_id), pa.array(kinds), pa.array(texts), pa.array(starts, pa.int32()), pa.array([e - s for s, e in zip(starts, ends)], pa.int32())],
        ["doc_id", "pii_type", "pii_text", "start", "length"],
    )


def entities(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, pii_type, pii_text, start, length: every entity as it stands in the text (positions are
    0-based code points). Null and empty texts have none; extra columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            told = {t: model.entities(t) for t in dict.fromkeys(texts)}  # copies of a page are read once
            rows = [(d, *e) for d, t in zip(b.column(0).to_pylist(), texts) for e in told[t]]
            if rows:
                yield _entity_batch(rows, b.schema.field(0).type)

    return spread(_usable(documents)).mapInArrow(run, _entity_schema(documents))


def masked(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text with each entity replaced by ``<TYPE>``; the rest stays as it is. Null stays
    null, empty stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                if t:
                    parts, at = [], 0
                    for kind, _, start, end in model.entities(t):
                        parts += [t[at:start], f"<{kind.upper()}>"]
                        at = end
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, text string")
