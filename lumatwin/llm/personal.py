"""Personal details in free text: found by anchors, expanded by local parsers.

A text is folded to plain lower-case letters (accents, odd blanks and hyphens, combining marks and doubly encoded letters
undone) with a map back to its own characters. One Aho-Corasick pass over the folded text finds the anchors: at-signs and
their spelled-out forms, schemes (mailto:, tel:), cues of identity numbers, digits, street words, and the words that can be names. Each
anchor is expanded by a deterministic parser of its kind. A number is one of a person if it has a listed shape and no cue of another kind of number
stands before it, or, whatever its shape, if a cue of identity numbers does. Spans don't overlap: addresses of mail come
first, then street addresses, identity numbers, phone numbers, names.

The words that can be names are learned from the list of known people: each known name is cut where its two parts are
most common among all of them, and a stem and an ending that both occur often make a name also where nobody of that name is listed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.stage import Stage, spread
from lumatwin.tables import table

KINDS = ("email", "address", "id_number", "phone", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "name": "[NAME]"}
#: Different names that are sent to every task. Beyond, the words of each text are joined with those that can be names: the result is the same.
MOST_NAMES = 100_000

# --- folding -----------------------------------------------------------------------------------------------------------

_ODD = re.compile("[̀-ͯ­​-‏⁠﻿]|[ÂÃÄÅ][\u0080-¿ŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")
_SPACES, _HYPHENS = "  ᠎           　", "‐‑‒–—−"


def _plain(c: str) -> str:
    """One character for one: without accents and case."""
    if c in _SPACES:
        return " "
    if c in _HYPHENS:
        return "-"
    base = unicodedata.normalize("NFKD", c)
    base = "".join(x for x in base if not unicodedata.combining(x)).lower()
    return base if len(base) == 1 else (c.lower() if len(c.lower()) == 1 else c)


class _Table(dict):
    def __missing__(self, code: int) -> int:
        self[code] = out = ord(_plain(chr(code)))
        return out


_TABLE = _Table({ord("’"): ord("'"), ord("‘"): ord("'"), ord("＠"): ord("@")})


def fold(text: str) -> tuple[str, list[int] | None]:
    """The folded text, and for each of its characters the place in the text (None: the same place)."""
    if text.isascii():
        return text.lower(), None
    if not _ODD.search(text):
        return text.translate(_TABLE), None
    out, at, k = [], [], 0
    while k < len(text):
        c, step = text[k], 1
        if c in "ÂÃÄÅ" and k + 1 < len(text):
            pair = text[k : k + 2]
            for encoding in ("cp1252", "latin-1"):
                try:
                    c, step = pair.encode(encoding).decode("utf-8"), 2
                    break
                except UnicodeError:
                    pass
        if not (unicodedata.combining(c) or c in "­​‌‍‎‏⁠﻿"):
            out.append(c)
            at.append(k)
        k += step
    at.append(len(text))
    return "".join(out).translate(_TABLE), at


def fold_word(word: str) -> str:
    return fold(unicodedata.normalize("NFC", word))[0]


# --- words that can be names -------------------------------------------------------------------------------------------


class NameWords(NamedTuple):
    """Words that can be names: listed ones, and those made of a stem and an ending."""

    whole: frozenset[str]
    stems: frozenset[str]
    endings: frozenset[str]


def name_words(names: list[str], least: int = 4) -> NameWords:
    """The folded names, and the stems and endings that each occur in at least ``least`` of them."""
    words = {w for n in names if n for w in re.split(r"[\s\-]+", fold_word(n)) if w.isalpha() and len(w) > 2}
    stems, endings = Counter(), Counter()
    cuts = lambda w: range(3, len(w) - 1)
    for w in words:
        stems.update(w[:k] for k in cuts(w))
        endings.update(w[k:] for k in cuts(w))
    best_stems, best_endings = Counter(), Counter()
    for w in words:
        if len(w) > 4:
            k = max(cuts(w), key=lambda k: (stems[w[:k]] * endings[w[k:]], k))
            best_stems[w[:k]] += 1
            best_endings[w[k:]] += 1
    often = lambda c: frozenset(x for x, n in c.items() if n >= least)
    return NameWords(frozenset(words), often(best_stems), often(best_endings))


# --- anchors -----------------------------------------------------------------------------------------------------------

#: Fixed words: how an at-sign is written, and street words of the languages at hand (before or after the name of the street).
_AT = ("@", "(at)", "[at]", "{at}", " at ")
_STREET_LAST = ("street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "quay", "close", "drive", "court", "square", "terrace", "gardens", "way", "hill", "place")
_STREET_JOINED = ("straße", "strasse", "gasse", "weg", "allee", "platz", "ufer", "damm", "ring")
_STREET_FIRST = ("rue", "impasse", "place", "chemin", "avenue", "boulevard", "allee", "quai", "route", "calle", "avenida", "plaza", "paseo", "camino", "carrera", "via", "piazza")
_SCHEMES = ("mailto:", "tel:", "sms:")
#: Fixed words: what numbers of a person are called in the languages at hand, folded.
_ID_CUES = (
    "identity card", "identity no", "identity number", "id card", "id no", "id number", "national id", "passport", "social security", "ssn", "national insurance", "ni number", "nino", "tax id",
    "personalausweis", "ausweisnummer", "reisepass", "passnummer", "sozialversicherungsnummer", "steuer-id", "carte d'identite", "passeport", "securite sociale", "numero fiscal",
    "dni", "nif", "pasaporte", "documento de identidad", "seguridad social", "codice fiscale", "carta d'identita", "passaporto", "henkilotunnus", "henkilokortti",
)

_G = r"[ \t\r\n]{1,3}"  # a gap between words that belong together
_G0 = r"[ \t\r\n]{0,3}"
_NOT_PERSONAL = re.compile(rf"(?:serial|s/n|seriennummer|device|order|invoice|file|album|ticket|model|version|scan)(?:{_G}(?:no|number|nr|id)\b)?\.?{_G0}[:#]?{_G0}$")
#: Characters that a match of _NOT_PERSONAL, _HOUSE_BEFORE, _INITIALS or _BETWEEN can have at most: none lies farther back.
_LONGEST = 48
#: What stands between a cue and its number, and a number of any shape: at least five digits in one word, perhaps with hyphens, that are no date.
_AFTER_CUE = re.compile(rf"(?:{_G}(?:no|nr|num|number|numero|nummer|card)(?![a-z]))?\.?{_G0}[:#]?{_G0}(?![0-9]{{1,4}}-[0-9]{{1,2}}-[0-9]{{1,4}}(?![0-9]))(?=(?:[a-z\-]*[0-9]){{5}})([a-z0-9]+(?:-[a-z0-9]+)*)(?![a-z0-9_]|[/.@][a-z0-9])")
_LOCAL = re.compile(r"[a-z0-9](?:[a-z0-9._+\-]*[a-z0-9])?$")
_LABEL = r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|\(dot\)|\[dot\]|\{{dot\}}){_LABEL})*(?:\.|\(dot\)|\[dot\]|\{{dot\}})[a-z]{{2,24}}(?![a-z0-9])")
_DOMAIN_WORDS = re.compile(rf"{_LABEL}(?:{_G}dot{_G}{_LABEL})*{_G}dot{_G}[a-z]{{2,24}}(?![a-z0-9])")

_UNIT = rf"(?:(?:,{_G}|{_G})(?:(?:flat|apt|apartment|unit|suite|app(?:artement|t)?|whg|wohnung|piso|puerta|bat)\.?{_G}[0-9]{{1,5}}[a-z]?|#[ ]?[0-9]{{1,5}}[a-z]?)(?![a-z0-9]))?"
_POST = rf"(?:,?{_G}(?:[a-z]{{2}}{_G}[0-9]{{5}}|[a-z]{{2}}[0-9]{{1,2}}{_G}[0-9][a-z]{{2}}|[0-9]{{5}})(?![a-z0-9\-/:.]*[0-9a-z]| [0-9]{{3}} [0-9]{{3}}))?"
_NUMBER_FIRST = re.compile(rf"(?<![a-z0-9.\-/#])[0-9]{{1,4}}[a-z]?{_G}((?:[a-z][a-z']*(?:-[a-z']+)*{_G}){{1,3}})$")
_ARTICLE = re.compile(r"(?:the|a|an|my|our|your|this|that)\s")
_AFTER_STREET = re.compile(_UNIT)
_TOWN_POST = re.compile(rf"(,{_G}|{_G}|[ ]?\r?\n)([a-z]+(?:[\-'][a-z]+)*)((?:[ ][a-z]+(?:[\-'][a-z]+)*)?)")
_POST_ONLY = re.compile(_POST)
#: What follows a street without being its town: a floor, an article, a state's or postal code, the name of a field; and what ends a phrase.
_FLOOR = re.compile(rf"(?:ground|first|second|third|fourth|fifth|top|upper|lower|[0-9]{{1,2}}(?:st|nd|rd|th)){_G}floor(?![a-z])|floor(?![a-z])")
_ARTICLES = ("the", "a", "an")
_CODE = re.compile(rf"[a-z]{{1,2}}(?:[0-9]|{_G}[0-9]{{5}}(?![0-9]))")
_FIELD = re.compile(r":|[ ](?:no\.?|id)\b|[ ]?(?:no\.?|number|nr\.?)[ ]?:")
_PHRASE_END = re.compile(r"[ ]?(?:[\r\n;,.!?)]|$)")
_POST_TOWN = re.compile(rf",?{_G}[0-9]{{5}}{_G}([a-z]+(?:[\-'][a-z]+)*)((?:{_G}[a-z]+(?:[\-'][a-z]+)*)?)")
_HOUSE_AFTER = re.compile(rf"{_G}[0-9]{{1,4}}(?:[ ]?[a-z])?(?![a-z0-9])")
_FIRST_STREET = re.compile(rf"({_G}(?:(?:de|des|du|la|le|les|del|de la|de los|de las|l'|d'|los|las|el){_G}?){{0,3}}[a-z'\-]+(?:{_G}[a-z'\-]+)??)(,{_G}[0-9]{{1,4}}[a-z]?(?![a-z0-9])|(?=,{_G}[0-9]{{5}}(?![0-9])|[.;\n]|,|$))")
_HOUSE_BEFORE = re.compile(rf"(?<![a-z0-9.\-/])([0-9]{{1,4}}(?:[ ]?(?:bis|ter|[a-z]))?,?{_G})$")
_SPANISH_UNIT = re.compile(rf",{_G}(?:bajo|atico|entresuelo|[0-9]{{1,2}}\.?[oaºª]?\.?(?:{_G}(?:[a-z]|izq\.?|dcha\.?|[0-9]{{1,2}}\.?[oaºª]?))?)(?=,|[ ]|\.|$)")

_IDS = re.compile(
    r"(?<![a-z0-9\-_./])(?:[0-9]{3}([\- ])[0-9]{2}\1[0-9]{4}|[a-z]{2}[0-9]{7}|[0-9]{8}[a-z]|[0-9]{6}[\-+a][0-9]{3}[0-9a-z]|[a-z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[a-d]|[a-z]{2}[0-9]{2}[a-z][0-9]{4}[a-z][0-9])(?![a-z0-9_]|[\-/.][0-9a-z])"
)
_PHONES = re.compile(
    rf"(?<![a-z0-9_.\-/:#])(?:"
    rf"(?P<cc>\+|00)(?P<country>1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{{2}})(?:[ \-.](?:\([0-9]{{1,4}}\)[ \-]?)?|\([0-9]{{1,4}}\)[ \-]?)[0-9]{{1,6}}(?:[ \-./][0-9]{{2,8}}){{1,6}}"
    rf"|\([0-9]{{2,5}}\)[ \-]?[0-9]{{3,4}}[ \-][0-9]{{3,4}}"
    rf"|[2-9][0-9]{{2}}([.\-])[0-9]{{3}}\3[0-9]{{4}}"
    rf"|0[0-9]{{2,4}}/[0-9]{{5,9}}"
    rf"|0[0-9](?:([ .])[0-9]{{2}})(?:\4[0-9]{{2}}){{3}}"
    rf"|0[0-9]{{4}} [0-9]{{3}} [0-9]{{3}}"
    rf"|[2-9][0-9]{{2}}-[0-9]{{4}}"
    rf")(?![0-9a-z_]|[\-/.:][0-9])"
)
#: After a scheme the number needs no shape.
_PHONES_AFTER_SCHEME = re.compile(r"\+?[0-9](?:[ \-.()]{0,2}[0-9]){5,14}(?![0-9a-z_])")
#: Digits of a whole number with its country code, where they are fixed.
_LENGTH = {"1": 11, "33": 11, "34": 11, "44": 12, "7": 11}
_PARTICLES = r"(?:van der|van den|van de|van|von der|von|vom|de la|de los|de|del|della|di|da|dos|du|le|la|ter|ten|zu|af|av|bin|ben|al|el)"
_COMMA = re.compile(rf",{_G}")
_INITIALS = re.compile(rf"(?<![a-z0-9_.'\-@])(?:[a-z]\.[ \t\r\n]{{0,2}}){{1,3}}(?:{_PARTICLES}{_G})?$")
_BETWEEN = re.compile(rf"{_G}(?:(?:[a-z]\.{_G}?){{1,3}})?(?:{_PARTICLES}{_G})?$")


class Finder:
    """Finds the spans of one text; built once per process from the words that can be names."""

    def __init__(self, given: NameWords, family: NameWords) -> None:
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        self.words = {"given": given, "family": family}
        self.longest = {k: max(map(len, w.endings), default=0) for k, w in self.words.items()}
        anchors: dict[str, set[str]] = {}
        listed = (
            (_AT, "at"), (_SCHEMES, "scheme"), (_ID_CUES, "cue"), ("0123456789", "digit"), (_STREET_LAST, "last"), ([_plain_word(w) for w in _STREET_JOINED], "joined"), (_STREET_FIRST, "first"),
            (given.whole, "given"), (family.whole, "family"), (given.stems, "given+"), (family.stems, "family+"),
        )
        for words, kind in listed:
            for w in words:
                anchors.setdefault(w, set()).add(kind)
        for w, kinds in anchors.items():
            self.anchors.add_word(w, (len(w), tuple(kinds)))
        self.anchors.make_automaton()

    def _anchors(self, t: str) -> dict[str, list[tuple[int, int]]]:
        """(start, stop) of the anchors of each kind, in order; stems are completed to words."""
        out: dict[str, dict[int, int]] = {k: {} for k in ("at", "scheme", "cue", "digit", "last", "joined", "first", "given", "family")}
        for end, (n, kinds) in self.anchors.iter(t):
            start, stop = end - n + 1, end + 1
            begins = not (start and t[start - 1].isalpha())
            ends = not (stop < len(t) and t[stop].isalpha())
            for kind in kinds:
                if kind == "digit":
                    if not (start and t[start - 1].isdigit()):
                        out[kind][start] = stop
                elif kind == "at" or (kind == "scheme" and begins) or (ends and (begins or kind == "joined")):
                    if kind in out:
                        out[kind][start] = stop
                if begins and not ends and kind in ("given+", "family+"):
                    kind, last = kind[:-1], stop
                    while last < len(t) and t[last].isalpha() and last - stop <= self.longest[kind]:
                        last += 1
                    if t[stop:last] in self.words[kind].endings:
                        out[kind][start] = last
        return {k: sorted(v.items()) for k, v in out.items()}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the details in a text, in order, none overlapping."""
        t, at = fold(text)
        anchors = self._anchors(t)
        self.text, self.t, self.at = text, t, at
        taken = bytearray(len(t))
        out: list[tuple[int, int, str]] = []

        def take(span: tuple[int, int] | None, kind: str) -> None:
            if span and not any(taken[span[0] : span[1]]):
                taken[span[0] : span[1]] = b"\1" * (span[1] - span[0])
                out.append((*span, kind))

        for start, stop in anchors["at"]:
            take(self._mail(start, stop), "email")
        for kind, parse in (("last", self._number_first), ("joined", self._joined), ("first", self._first)):
            for start, stop in anchors[kind]:
                take(parse(start, stop), "address")
        done = 0
        for start, _ in anchors["digit"]:  # a shape begins with the digits, or with two letters before them
            if start >= done and (m := _IDS.match(t, max(0, start - 3)) or _IDS.match(t, max(0, start - 2)) or _IDS.match(t, start)):
                done = m.end()
                if not self._labelled(m.start()):
                    take(m.span(), "id_number")
        for start, stop in anchors["cue"]:
            if not self._labelled(start) and (m := _AFTER_CUE.match(t, stop)):
                take(m.span(1), "id_number")
        schemes, done = {stop for _, stop in anchors["scheme"]}, 0
        for start, _ in anchors["digit"]:
            begin = start - 1 if start and t[start - 1] in "+(" else start
            if begin >= done and (m := _PHONES.match(t, begin) or _PHONES.match(t, start) or (_PHONES_AFTER_SCHEME.match(t, begin) if begin in schemes else None)):
                done = m.end()
                take(self._phone(m), "phone")
        for span in self._names(anchors["given"], anchors["family"], taken):
            take(span, "name")
        back = (lambda a, b: (at[a], at[b])) if at else (lambda a, b: (a, b))
        return sorted((*back(a, b), kind) for a, b, kind in out)

    def _labelled(self, k: int) -> bool:
        """Whether a cue of numbers that aren't personal stands right before a place."""
        return bool(_NOT_PERSONAL.search(self.t, max(0, k - _LONGEST), k))

    def _own(self, k: int) -> str:
        """The character of the text itself at a place of the folded one."""
        return self.text[self.at[k] if self.at else k]

    def _mail(self, start: int, stop: int) -> tuple[int, int] | None:
        t = self.t
        words = t[start:stop] == " at "
        left = start
        if t[start:stop] == "@":  # blanks on both sides or on none
            if start and t[start - 1].isspace():
                if not t[stop : stop + 1].isspace():
                    return None
                left, stop = start - 1, stop + 1
        elif not words:
            while left and t[left - 1].isspace() and start - left < 2:
                left -= 1
            while stop < len(t) and t[stop].isspace() and stop - start < 8:
                stop += 1
        begin = left
        while begin and (t[begin - 1].isalnum() or t[begin - 1] in "._+-") and self._own(begin - 1).isascii():
            begin -= 1
        while begin < left and not t[begin].isalnum():
            begin += 1
        if begin == left or not _LOCAL.match(t[begin:left]):
            return None
        domain = (_DOMAIN_WORDS.match(t, stop) or _DOMAIN.match(t, stop)) if not words else _DOMAIN_WORDS.match(t, stop)
        if not domain or domain.end() - begin > 254:
            return None
        end = stop
        while end < domain.end() and self._own(end).isascii():
            end += 1
        return (begin, end) if end == domain.end() or "." in t[stop:end] else None

    def _upper(self, k: int) -> bool:
        return self._own(k).isupper()

    def _town(self, end: int) -> int:
        """The end of a town and postal code that follow at end, or end."""
        t = self.t
        m = _TOWN_POST.match(t, end)
        if m and self._upper(m.start(2)) and not _FLOOR.match(t, m.start(2)) and m[2] not in _ARTICLES:
            last = m.end(2)
            if m[3] and self._upper(m.start(3) + 1) and m[3][1:] not in _ARTICLES and not _CODE.match(t, m.start(3) + 1) and (not self._shouted(m.start(2), last) or _PHRASE_END.match(t, _POST_ONLY.match(t, m.end(3)).end())):
                last = m.end(3)
            post = _POST_ONLY.match(t, last)
            if _FIELD.match(t, post.end()):  # the name of a field of a form, not a town
                return end
            if post.end() > last or "\n" not in m[1] or _PHRASE_END.match(t, post.end()):
                return post.end()
            return end
        return _POST_ONLY.match(t, end).end()

    def _shouted(self, a: int, b: int) -> bool:
        """Whether a word is in capitals throughout, so that capitals tell nothing of the next one."""
        own = [self._own(k) for k in range(a, b)]
        return len(own) > 1 and all(c.isupper() for c in own if c.isalpha())

    def _number_first(self, start: int, stop: int) -> tuple[int, int] | None:
        m = _NUMBER_FIRST.search(self.t, self._words_before(start, 4), start)
        words = [m.start(1) + w.start() for w in re.finditer(r"[a-z'\-]+", m[1])] if m else []
        if not m or not self._upper(start) or not all(self._upper(k) for k in words) or _ARTICLE.match(m[1]):
            return None
        if self.t[stop : stop + 1] == "." and self.t[start:stop] in ("st", "rd", "ave", "ln"):
            stop += 1
        return m.start(), self._town(_AFTER_STREET.match(self.t, stop).end())

    def _words_before(self, k: int, most: int) -> int:
        """The start of up to so many words before a place, each set off by a gap."""
        t = self.t
        for _ in range(most):
            gap = k
            while gap and k - gap < 3 and t[gap - 1] in " \t\r\n":
                gap -= 1
            if gap == k:
                break
            k = gap
            while k and t[k - 1] not in " \t\r\n":
                k -= 1
        return k

    def _joined(self, start: int, stop: int) -> tuple[int, int] | None:
        t, begin = self.t, start
        while begin and (t[begin - 1].isalpha() or t[begin - 1] == "-"):
            begin -= 1
        house = _HOUSE_AFTER.match(t, stop)
        if begin == start or not house:
            return None
        post = _POST_TOWN.match(t, house.end())
        return begin, self._post_town(post) if post else house.end()

    def _post_town(self, m: re.Match) -> int:
        """The end of a town after its postal code: a second word only if it's written with a capital too."""
        if m[2] and self._upper(m.end(2) - len(m[2].lstrip())) and "\n" not in m[2]:
            return m.end(2)
        return m.end(1)

    def _first(self, start: int, stop: int) -> tuple[int, int] | None:
        t = self.t
        street = _FIRST_STREET.match(t, stop)
        before = _HOUSE_BEFORE.search(t, max(0, start - _LONGEST), start)
        if not street or not (before or street[2]):
            return None
        if not before and not self._upper(start):
            return None
        end, begin = street.end(), before.start() if before else start
        if not before:
            unit = _SPANISH_UNIT.match(t, end)
            if unit and not re.match(rf",{_G}[0-9]{{5}}", t[end:]):
                end = unit.end()
        else:
            unit = _AFTER_STREET.match(t, end)
            end = unit.end()
        post = _POST_TOWN.match(t, end)
        return begin, self._post_town(post) if post else end

    def _phone(self, m: re.Match) -> tuple[int, int] | None:
        t, (a, b) = self.t, m.span()
        digits = lambda x: sum(c.isdigit() for c in x)
        if m.re is _PHONES and m["cc"]:
            extra = 2 if m["cc"] == "00" else 0
            most = _LENGTH.get(m["country"], 15) + extra + t[a:b].count("(0)")
            while digits(t[a:b]) > most and re.search(r"[ \-./][0-9]+$", t[a:b]):
                b = a + re.search(r"[ \-./][0-9]+$", t[a:b]).start()
            if digits(t[a:b]) < 8 + extra:
                return None
        return None if self._labelled(a) else (a, b)

    def _names(self, given: list[tuple[int, int]], family: list[tuple[int, int]], taken: bytearray) -> list[tuple[int, int]]:
        """Names as written together: given [initials] [particle] family[-family]; initials family; family, given; or one word alone."""
        t, out = self.t, []
        free = lambda spans: {a: b for a, b in spans if not taken[a] and t[a - 1 : a] not in ("@", "_", "#") and t[b : b + 1] not in ("@", "_")}
        g, f = free(given), free(family)
        for a in [a for a in g if a in f]:  # a word of both kinds: a family name after a given one
            (f if any(b == a - 1 for b in g.values()) else g).setdefault(a, (g if any(b == a - 1 for b in g.values()) else f).pop(a))
        heads = sorted({*g, *f})
        done = 0
        for a in heads:
            if a < done:
                continue
            if a in g:
                end = self._family_after(g[a], f) or g[a]
                out.append((a, end))
            else:
                end = self._doubled(a, f)
                before = _INITIALS.search(t, max(0, a - _LONGEST), a)
                begin = before.start() if before and not any(taken[before.start() : a]) else a
                if begin == a:
                    comma = _COMMA.match(t, end)
                    if comma and comma.end() in g and not self._family_after(g[comma.end()], f):
                        end = g[comma.end()]
                out.append((begin, end))
            done = out[-1][1]
        alone = lambda a, b: b - a == len(t[a:b].split()[0]) and not self._upper(a)
        return [(a, b) for a, b in out if not alone(a, b)]

    def _family_after(self, end: int, f: dict[int, int]) -> int | None:
        """The end of a family name that follows a given one, if one does."""
        t = self.t
        for a in range(end + 1, min(end + _LONGEST, len(t))):
            if a in f and _BETWEEN.match(t[end:a]):
                return self._doubled(a, f)
        return None

    def _doubled(self, a: int, f: dict[int, int]) -> int:
        end = f[a]
        while self.t[end : end + 1] == "-" and end + 1 in f:
            end = f[end + 1]
        return end


def _plain_word(word: str) -> str:
    return fold(word)[0]


@lru_cache(maxsize=2)
def finder(given: tuple[str, ...], family: tuple[str, ...]) -> Finder:
    return Finder(name_words(list(given)), name_words(list(family)))


def known_names(people: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """The given and family names of the list of people; None if there are more than MOST_NAMES different ones."""
    both = people.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("given_name").alias("n")), F.struct(F.lit(1).alias("k"), F.col("family_name").alias("n")))).alias("x"))
    rows = both.select("x.*").where("n <> ''").distinct().limit(MOST_NAMES + 1).collect()
    return None if len(rows) > MOST_NAMES else tuple(tuple(sorted(r.n for r in rows if r.k == k)) for k in (0, 1))


def _name_tables(people: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """name_words for a list of any length: tables (kind, word), (kind, stem) and (kind, ending); kind is 0 for given and 1 for family names."""
    names = people.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("given_name").alias("name")), F.struct(F.lit(1).alias("kind"), F.col("family_name").alias("name")))).alias("x")).select("x.*").where("name <> ''").distinct()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(k, w) for k, n in zip(x["kind"].to_pylist(), x["name"].to_pylist()) for w in re.split(r"[\s\-]+", fold_word(n)) if w.isalpha() and len(w) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.string())], ["kind", "word"])

    stage = Stage(people.sparkSession, "names")
    words = stage.write(spread(names).mapInArrow(folded, "kind int, word string").distinct(), "words")
    n = F.length("word")
    cuts = words.where(n > 4).select("kind", "word", F.explode(F.sequence(F.lit(3), n - 2)).alias("at"))
    cuts = stage.write(cuts.select("kind", "word", "at", F.substring("word", F.lit(1), F.col("at")).alias("stem"), F.expr("substring(word, at + 1)").alias("ending")), "cuts")
    count = lambda c: cuts.groupBy("kind", c).agg(F.count("*").alias(f"n_{c}"))
    rated = cuts.join(count("stem"), ["kind", "stem"]).join(count("ending"), ["kind", "ending"])
    best = stage.write(rated.groupBy("kind", "word").agg(F.max_by(F.struct("stem", "ending"), F.struct(F.col("n_stem") * F.col("n_ending"), "at")).alias("b")).select("kind", "b.*"), "best")
    often = lambda c: best.groupBy("kind", c).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("kind", c)
    return words, often("stem"), often("ending")


def _with_names(df: DataFrame, people: DataFrame, text: str) -> DataFrame:
    """df with the words of each text that can be names, as arrays _given and _family: for lists too long to be sent to every task."""
    stage = Stage(df.sparkSession, "texts")
    listed, stems, endings = _name_tables(people)
    longest = 2 * (listed.agg(F.max(F.length("word"))).first()[0] or 0)  # a stem and an ending are parts of listed words
    key = F.sha2(F.col(text), 256)
    texts = spread(df.where(F.col(text) != "").select(key.alias("_key"), F.col(text).alias("_text")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(k, w) for k, t in zip(x["_key"].to_pylist(), x["_text"].to_pylist()) for w in {*"".join(c if c.isalpha() else " " for c in fold(t)[0]).split()} if 2 < len(w) <= longest]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], ["_key", "word"])

    found = stage.write(texts.mapInArrow(words, "_key string, word string").distinct(), "words")
    different = found.select("word").distinct()
    parts = different.where(F.length("word") > 3).select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 1)).alias("at")).select("word", F.substring("word", F.lit(1), F.col("at")).alias("stem"), F.expr("substring(word, at + 1)").alias("ending"))
    made = parts.join(stems, "stem").join(endings, ["kind", "ending"]).select("kind", "word")
    can = listed.join(different, "word", "left_semi").select("kind", "word").union(made).distinct()
    per = found.join(can, "word").groupBy("_key").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("word"))).alias(n) for k, n in ((0, "_given"), (1, "_family"))])
    return df.withColumn("_key", key).join(per, "_key", "left").drop("_key")


def _prepared(df: DataFrame, people: DataFrame, text: str):
    """df, perhaps with columns of names, and a function that gives the finder of a row of a batch."""
    names = known_names(people)
    if names is not None:
        return df, lambda x: (lambda k: finder(*names))
    empty = frozenset()

    def of(x: pa.RecordBatch):
        given, family = x["_given"].to_pylist(), x["_family"].to_pylist()
        return lambda k: Finder(*[NameWords(frozenset(w[k] or ()), empty, empty) for w in (given, family)])

    return _with_names(df, people, text), of


def found(df: DataFrame, people: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, value): the distinct details of each text, exactly as they stand in it. Null and empty texts have none."""
    rows, finders = _prepared(df.select(key, text), people, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            of = finders(x)
            rows = [(i, kind, v) for k, (i, t) in enumerate(zip(x[key].to_pylist(), x[text].to_pylist())) if t for kind, v in dict.fromkeys((kind, t[a:b]) for a, b, kind in of(k).spans(t))]
            ids, kinds, values = ([r[n] for r in rows] for n in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids, x[key].type), pa.array(kinds, pa.string()), pa.array(values, pa.string())], [key, "kind", "value"])

    return spread(rows).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, value string")


def redacted(df: DataFrame, people: DataFrame, text: str = "text") -> DataFrame:
    """df with typed placeholders in place of the details, texts otherwise unchanged; null stays null."""
    columns = df.columns
    rows, finders = _prepared(df, people, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            of, out = finders(x), []
            for k, t in enumerate(x[text].to_pylist()):
                parts, last = [], 0
                for a, b, kind in of(k).spans(t) if t else ():
                    parts += [t[last:a], PLACEHOLDERS[kind]]
                    last = b
                out.append(None if t is None else "".join([*parts, t[last:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else x[c] for c in columns], columns)

    return spread(rows).mapInArrow(run, df.schema)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "people"))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "people"))
