"""Problem 3: personal information in free text, by offset-preserving deobfuscation.

1. Gate: on flat arrays of a whole batch, texts without digits enough, at-signs, cue words, digit words or signatures are let
   through unread; no finding is possible in them.
2. Transducers: letter-like characters of other scripts and full-width forms become plain ones, odd spaces and dashes
   plain ones, invisible characters vanish, bracketed or written at/dot become signs, runs of five or more digit words (five languages) become
   digits. Each keeps, for every character it puts out, the place of the source character.
3. Detection on the normalised text: e-mail addresses; numbers by shape and by the cue words before them (telephone or identity);
   postal addresses by street words of five languages with house numbers, and post boxes; names of two to four capitalised words after or before cue words.
4. Spans are mapped back, overlaps resolved (e-mail, identity, telephone, address, name), and replaced by [EMAIL], [ID_NUMBER],
   [PHONE], [ADDRESS], [NAME].

Defined results: rows with a NULL id take no part in findings; NULL and empty texts have no findings and stay as they are;
rows with one id and text count once; long texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

KINDS = ("email", "id_number", "phone", "address", "name")

#: Words for the digits 0 to 9.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "không": "0", "một": "1", "hai": "2", "ba": "3", "bốn": "4", "năm": "5", "sáu": "6", "bảy": "7", "tám": "8", "chín": "9",
}
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТУХІЈЅαοιρνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTYXIJSaoipvABEZHIKMNOPTYX"))
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)

#: Words that stand before (or, for a few, behind) the full name of a private person.
RELATIVES = (
    r"(?:cousins?|neighbou?rs?|teacher|brother|sister|friend|colleague|boss|uncle|aunt|nephew|niece|classmate|flatmate|roommate|husband|wife|mother|father|dad|mum|mom|son|daughter|coworker|co-worker|landlord|landlady|mate|buddy|partner|girlfriend|boyfriend|grandmother|grandfather|tutor|dentist|doctor"
    r"|cousine|nachbar(?:in)?|lehrer(?:in)?|bruder|schwester|freund(?:in)?|kolleg(?:e|in|en)|onkel|tante|mann|frau|mitbewohner(?:in)?"
    r"|prim[oa]|vecin[oa]|profesora?|herman[oa]|amig[oa]|compañer[oa]|tí[oa]|jef[ea]|espos[oa]|marido"
    r"|voisine?|frère|sœur|soeur|amie?|collègue|oncle|patronn?e?|professeure?|prof|mari|femme"
    r"|hàng xóm(?: nhà tôi| của tôi| tôi)?|(?:anh|chị|em) họ(?: của)?(?: tôi)?|thầy giáo(?: cũ)?(?: của tôi| tôi)?|cô giáo(?: cũ)?(?: của tôi| tôi)?|bạn(?: thân)?(?: của)? tôi|đồng nghiệp(?: của)?(?: tôi)?)"
)
SIGNED = r"(?:signed(?:\s+by)?|review(?:ed)?\s+by|care of|rezensiert von|reseña de|critique de|(?:posted|written|sent)\s+(?:on behalf of|by|for)|on behalf of|yours(?:\s+truly)?|regards|cheers|best wishes|sincerely|my name is|i am called|thanks to|gezeichnet|gez\.|im namen von|mein name ist|ich heiße|grüße von|danke an|firmado(?:\s+por)?|fdo\.|en nombre de|me llamo|mi nombre es|gracias a|saludos de|signé(?:\s+par)?|au nom de|je m['’]appelle|mon nom est|merci à|người viết|ký tên|viết thay(?: cho)?|đăng (?:hộ|thay)(?: cho)?|tôi tên(?: là)?|tên tôi là|cảm ơn|nguoi viet)"
TITLE = r"(?:(?:dr|mr|mrs|ms|prof|sr|sra|m|mme|herr|frau|señora?|monsieur|madame)\.?\s+)?"
HERE = r"(?:here|hier|aquí|ici|đây)\b|from (?:my|our) (?:office|work|school|class|building|street|gym|choir)\b"

PHONE_CUE = r"(?:call|reach|phone|tel|telephone|whatsapp|text|sms|ring|dial|mobile|number|cell|nummer|ruft?|anruf\w*|telefon|handy|teléfono|tel[eé]fono|ll[aá]m\w*|m[oó]vil|appel\w*|num[eé]ro|portable|t[eé]l[eé]phone|joindre|điện thoại|gọi|nhắn tin|liên lạc|dien thoai|goi)"
ID_CUE = r"(?:passports?|licen[cs]e|social security|ssn|national id|national identity|id card|identity card|identity number|id number|id no|insurance number|tax id|reisepass|pass|ausweis\w*|personalausweis\w*|führerschein\w*|sozialversicherung\w*|steuernummer|pasaporte|documento de identidad|dni|nie|carn[eé] de conducir|permiso de conducir|seguridad social|c[eé]dula|passeport|carte d['’ ]identit[eé]|permis de conduire|s[eé]curit[eé] sociale|hộ chiếu|căn cước|chứng minh|cmnd|cccd|bằng lái|giấy phép lái|bảo hiểm xã hội|ho chieu|can cuoc)"
#: Numbers of another meaning.
OTHER_CUE = r"(?:catalogue|catalog|disc|isbn|issn|serial|reel|order|item|mã đĩa|ma dia|budget|katalog|catálogo|art\.?|screen|row)"

STREET = r"(?:street|lane|road|avenue|terrace|drive|close|court|place|square|boulevard|crescent|gardens|parade|st|ln|rd|ave|dr|blvd|ter|sq|ct|pl)"
EMAIL = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*\s?@\s?(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}(?![\p{L}\p{N}])")
NUMBER = regex.compile(r"(?<![\p{L}\p{N}+(.,:/-])(?:\+|\(\+?|[A-Z]{1,3}[ -]?)?\d(?:[ .()/-]{0,2}\d){5,17}(?:-?[A-Z](?![\p{L}\p{N}]))?(?![\p{L}\p{N}]|[.,:]\d)")
ADDRESS = regex.compile(
    r"(?:(?:flat|apt|apartment|unit|suite)\.?\s*\d+[a-z]?,\s*)?(?<![\p{L}\p{N}.,/-])\d{1,5}\s?[a-z]?,?\s+(?:[\p{L}'’-]+\s+){1,3}?" + STREET + r"\b\.?(?:,?\s*(?:flat|apt|apartment|unit|suite)\.?\s*\d+[a-z]?)?(?:,\s*(?-i:\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?)(?:\s\d{5})?)?"
    r"|p\.?\s?o\.?\s?box\s+\d+(?:,\s*(?-i:\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?))?"
    r"|\b(?-i:\p{Lu})[\p{L}-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm)\s+\d{1,4}\s?[a-z]?\b(?:,\s*(?:\d{5}\s+)?(?-i:\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?))?"
    r"|(?<![\p{L}\p{N}.,/-])\d{1,4}(?:\s*(?:bis|ter|quater))?,?\s+(?:rue|avenue|allée|boulevard|place|chemin|impasse|quai|route|cours)\s+(?:(?:de\s+la|de\s+l['’]|du|des|de|d['’])\s*)?[\p{L}'’-]+(?:,\s*(?:\d{5}\s+)?(?-i:\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?))?"
    r"|\b(?:calle|avenida|avda\.?|plaza|paseo|camino|carretera|travesía|ronda)\s+(?:de\s+(?:la\s+|los\s+|las\s+|el\s+)?|del\s+)?[\p{L}'’-]+(?:\s(?-i:\p{Lu})[\p{L}'’-]+)?,?\s+(?:n\.?º?\s*)?\d{1,4}(?:,\s*\d{1,2}\.?º\s*\p{L})?(?:,\s*(?:\d{5}\s+)?(?-i:\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)?))?"
    r"|\b(?:(?:số|so)\s+)?\d{1,4}(?:/\d{1,4})*[a-z]?,?\s+(?:đường|ngõ|phố|hẻm|ngách|duong|hem|ngo|pho)\s+(?-i:\p{Lu})[\p{L}]*(?:\s(?-i:\p{Lu})\p{L}*){0,3}(?:,\s*(?:(?:phường|quận|phuong|quan)\s+)?(?-i:\p{Lu})\p{L}*(?:\s(?-i:\p{Lu})\p{L}*){0,2})?",
    regex.I,
)
WORD = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"
FULL = rf"(?:{WORD}(?:\s(?:\p{{Lu}}\.\s)?{WORD}){{1,3}}|{WORD},\s{WORD})"
NAME_AFTER = regex.compile(rf"(?i:\b(?:{RELATIVES}|{SIGNED})(?![\p{{L}}])(?:\s+(?:là|is|was|named|called|namens|llamad[oa]))?[,:]?\s+{TITLE}(?:tôi là\s+)?)({FULL})(?![\p{{L}}])")
NAME_BEFORE = regex.compile(rf"(?<![\p{{L}}\p{{N}}'’-])({FULL})\s*,?\s+(?i:{HERE})")
#: Words that begin a title or a sentence, not a name.
ARTICLE = r"(?:the|a|an|this|that|what|how|der|die|das|ein|eine|el|la|los|las|un|una|le|les|une|des|một|những|các)"
NAME_DASH = regex.compile(
    rf"(?:(?<=[\s.!?>])|^)(?:-|—|--|~)\s?(?i:{TITLE})({FULL})(?=\s*(?:[.!]|$|<))"
    rf"|(?:(?<=[^\s][ \t])|^)(?:-|—|--|~)\s?(?i:{TITLE})(?!(?i:{ARTICLE})\s)({WORD}(?:\s\p{{Lu}}\.)?\s{WORD})(?=\s\p{{Lu}}\p{{Ll}})",
    regex.M,
)
AT = regex.compile(r"\s*[\[({<]\s*(?:at|@|ät|arroba|a còng|a cong)\s*[\])}>]\s*", regex.I)
DOT = regex.compile(r"\s*[\[({<]\s*(?:dot|\.|punkt|punto|point|chấm|cham)\s*[\])}>]\s*", regex.I)
SPOKEN = regex.compile(r"(?<=[\p{L}\p{N}])\s+(?:at|ät|arroba|chez|a còng|a cong)\s+([\p{L}\p{N}-]+(?:\s+(?:dot|punkt|punto|point|chấm|cham)\s+[\p{L}\p{N}-]+)+)", regex.I)
SPOKEN_DOT = regex.compile(r"\s+(?:dot|punkt|punto|point|chấm|cham)\s+", regex.I)
DIGITS = regex.compile(r"(?<![\p{L}\p{N}])(?:(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")(?:[\s,.-]{1,3}|(?![\p{L}\p{N}]))){5,}", regex.I)
DIGIT_WORD = regex.compile("|".join(sorted(DIGIT_WORDS, key=len, reverse=True)), regex.I)
CUES = regex.compile(rf"(?<![\p{{L}}])(?:(?P<phone>{PHONE_CUE})|(?P<id>{ID_CUE})|(?P<other>{OTHER_CUE}))(?![\p{{L}}])", regex.I)


def spellings(pattern: str) -> list[str]:
    """All texts that a pattern without unbounded parts matches, in lower case; a run of spaces counts as one."""

    def of(parsed) -> list[str]:
        out = [""]
        for op, arg in parsed:
            match str(op):
                case "LITERAL":
                    every = [chr(arg)]
                case "IN":
                    every = [chr(x) if str(o) == "LITERAL" else " " for o, x in arg]
                case "SUBPATTERN":
                    every = of(arg[3])
                case "BRANCH":
                    every = [x for part in arg[1] for x in of(part)]
                case "MAX_REPEAT":
                    once = of(arg[2])
                    every = ([""] if arg[0] == 0 else []) + once
                case "AT":
                    every = [""]
                case _:
                    raise ValueError(f"{op} in {pattern}")
            out = [x + y for x in out for y in every]
        return out

    return [x.lower() for x in of(re._parser.parse(pattern))]


@cache
def _name_words() -> str:
    """The longest word of each way to write a cue of a name: a name has one of them near it, and few other places have."""
    return " ".join(sorted({max(re.findall(r"[^\W_]+", x), key=len) for p in (RELATIVES, SIGNED, HERE) for x in spellings(p)}))


#: Words and word ends that let a text through the gate.
AT_WORDS, AT_LAST, DOT_WORDS = "at ät arroba còng cong chez", "còng cong", "dot punkt punto point chấm cham"
STREET_WORDS = "street lane road avenue terrace drive close court place square boulevard crescent gardens parade st ln rd ave dr blvd ter sq ct pl box rue allée chemin impasse quai route cours calle avenida avda plaza paseo camino carretera travesía ronda đường ngõ phố hẻm ngách duong hem ngo pho"
STREET_TAILS = "aße sse str weg atz lee fer amm"


@cache
def _alike() -> tuple[np.ndarray, np.ndarray]:
    out = np.arange(0x110000, dtype=np.uint32)
    for a, b in ALIKE.items():
        out[ord(a)] = ord(b)
    out[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
    for zero in (0x660, 0x6F0, 0x966):
        out[zero : zero + 10] = np.arange(48, 58)
    for a in range(0x1D7CE, 0x1D800):
        out[a] = 48 + (a - 0x1D7CE) % 10
    out[[0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000]] = 32
    out[[0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63]] = 45
    gone = np.zeros(0x110000, bool)
    gone[list(INVISIBLE)] = True
    return out, gone


@cache
def _spaces() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x3001) if regex.match(r"\s", chr(c))]] = True
    return out


@cache
def _hashes(words: str) -> np.ndarray:
    cps, offs = ta.decode(pa.array(words.split(), pa.string()))
    start, end, _ = ta.words(cps, offs)
    return np.sort(ta.word_hashes(cps, start, end))


def _among(h: np.ndarray, words: str) -> np.ndarray:
    known = _hashes(words)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _near(mark: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Whether mark holds anywhere from back places before to ahead places behind."""
    total = np.concatenate([[0], np.cumsum(mark)])
    at = np.arange(len(mark))
    return total[np.minimum(at + ahead + 1, len(mark))] > total[np.maximum(at - back, 0)]


#: The steps that a text may need.
SIGNS, SPEECH, WRITTEN, NUMBERS, PLACES, NAMES = 1, 2, 4, 8, 16, 32


def suspects(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text which steps may find something there, as a sum of SIGNS to NAMES."""
    table, gone = _alike()
    plain, drop = table[cps], gone[cps]
    if drop.any():
        plain, offs = plain[~drop], offs - np.concatenate([[0], np.cumsum(drop)])[offs]
    n = len(offs) - 1
    out = np.zeros(n, np.int64)
    start, end, first = ta.words(plain, offs)
    if not len(start):
        return out
    h = ta.word_hashes(plain, start, end)
    text = np.repeat(np.arange(n), np.diff(first))

    def flag(step: int, texts: np.ndarray) -> None:
        out[np.unique(texts)] |= step

    def of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(offs, places, "right") - 1

    flag(SIGNS, of(np.flatnonzero(plain == 64)))
    # the last character before and the first behind each place that is no space; brackets around at and dot, as signs or words
    space = _spaces()[plain]
    place = np.arange(len(plain))
    last = np.concatenate([[0], np.maximum.accumulate(np.where(space, 0, place))])
    then = np.append(np.minimum.accumulate(np.where(space, len(plain) - 1, place)[::-1])[::-1], len(plain) - 1)
    open_ = np.isin(plain, (40, 91, 123, 60))
    close = np.isin(plain, (41, 93, 125, 62))
    sign = np.flatnonzero((plain == 64) | (plain == 46))
    flag(SPEECH | SIGNS, of(sign[open_[last[sign]] & close[then[sign + 1]]]))
    spoken, dot = _among(h, AT_WORDS), _among(h, DOT_WORDS)
    inner = open_[last[start]]
    two = np.zeros(len(h), bool)
    two[:-1] = inner[:-1] & _among(h, AT_LAST)[1:]
    flag(SPEECH | SIGNS, text[(spoken | dot) & inner | two])
    # an at-word, one stretch without spaces, a dot-word
    stretch = np.cumsum(space & ~np.concatenate([[False], space[:-1]]))[start]
    flag(SPEECH | SIGNS, text[dot & (_near(spoken, 6, 0) | np.isin(stretch - 2, stretch[spoken]))])
    number = _among(h, " ".join(DIGIT_WORDS))
    five = np.zeros(len(h), bool)
    if len(h) > 4:
        five[:-4] = number[:-4] & number[1:-3] & number[2:-2] & number[3:-1] & number[4:] & (text[:-4] == text[4:])
    flag(WRITTEN | NUMBERS, text[five])
    digit = (plain >= 48) & (plain <= 57)
    total = np.concatenate([[0], np.cumsum(digit)])
    reach = np.minimum(np.arange(len(plain)) + 26, len(plain))
    flag(NUMBERS, of(np.flatnonzero(digit & (total[reach] - total[:-1] >= 6))))
    figure = digit[start] | (number & np.isin(text, text[five]))
    tail = ta.span_hash(ta.prefix(ta.lower(plain)), np.maximum(end - 3, start), end)
    flag(PLACES, text[_among(h, STREET_WORDS) & _near(figure, 8, 7)])
    flag(PLACES, text[_among(tail, STREET_TAILS) & _near(figure, 0, 1)])
    upper = plain != ta.lower(plain)
    capital = upper[start]
    pair = np.zeros(len(h), bool)
    pair[:-1] = capital[:-1] & capital[1:] & (start[1:] - end[:-1] <= 3)
    flag(NAMES, text[_among(h, _name_words()) & _near(pair, 7, 11)])
    dash = (plain == 45) | (plain == 0x2014) | (plain == 126)
    flag(NAMES, text[pair & (dash[np.maximum(start - 1, 0)] | dash[np.maximum(start - 2, 0)])])
    return out


class Transduced:
    """A text with the place of the source character of each of its characters (None: they are the same)."""

    def __init__(self, text: str):
        self.text, self.place = text, None
        if not text.isascii():
            cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            table, gone = _alike()
            out = table[cps]
            drop = gone[cps]
            if drop.any():
                self.place = np.flatnonzero(~drop)
                out = out[~drop]
            self.text = out.tobytes().decode("utf-32-le", "replace")

    def replace(self, pattern, value) -> None:
        """Puts value(match) for each match; its characters get the places of the match's beginning, the last one that of its end."""
        parts, places, at = [], [], 0
        old = self.place
        for m in pattern.finditer(self.text):
            new = value(m)
            if old is None:
                old = np.arange(len(self.text))
            parts += [self.text[at : m.start()], new]
            own = np.minimum(old[m.start()] + np.arange(len(new)), old[m.end() - 1])
            own[-1:] = old[m.end() - 1]
            places += [old[at : m.start()], own]
            at = m.end()
        if parts:
            self.text = "".join(parts) + self.text[at:]
            self.place = np.concatenate([*places, old[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.place is None else (int(self.place[a]), int(self.place[b - 1]) + 1)


def _spoken(m) -> str:
    return "@" + SPOKEN_DOT.sub(".", m.group(1))


def _written(m) -> str:
    out = "".join(DIGIT_WORDS[w.lower()] for w in DIGIT_WORD.findall(m.group()))
    return out + (" " if m.group()[-1].isspace() else "")


def _number(text: str, m) -> tuple[str, int, int] | None:
    """What a number is and where, if it is of a kind sought. Letters before it that are a cue word are no part of it."""
    begin, head = m.start(), re.match(r"[A-Z]+(?=[ -])", m.group())
    if head and any(c.end() == begin + head.end() for c in CUES.finditer(text, max(0, begin - 30), begin + head.end())):
        begin += head.end() + 1
    kind = _number_kind(text, begin, m.end())
    return (kind, begin + (text[begin] == "(" and text.count("(", begin, m.end()) > text.count(")", begin, m.end())), m.end()) if kind else None


def _number_kind(text: str, begin: int, end: int) -> str | None:
    """What a number is, by the nearest cue before it (within 60 characters, not behind another number) and its shape."""
    shape = text[begin:end]
    digits = re.sub(r"\D", "", shape)
    letter = shape[0].isalpha() or shape[-1].isalpha()
    before = text[max(0, begin - 60) : begin]
    if (cut := re.search(r"\d{5}(?!.*\d{5})", before, re.S)) is not None:
        before = before[cut.end() :]
    cue = None
    for c in CUES.finditer(before):
        cue = c.lastgroup if not (c.lastgroup == "phone" and cue == "id" and c.group().lower() in ("number", "nummer", "text")) else cue
    if cue == "id" and len(digits) >= 6:
        return "id_number"
    if cue == "other" or letter:
        return "id_number" if letter and len(digits) >= 6 and re.match(r"[\s,:(]*(?:is|was)?\s*(?:my|as)?\s*" + ID_CUE, text[end : end + 30], re.I) else None
    n = len(digits)
    if shape.startswith(("+", "(+")) and 8 <= n <= 15:
        return "phone"
    if regex.fullmatch(r"(?:1[ .-]?)?(?:\(\d{3}\)\s?|\d{3}[ .-])\d{3}[ .-]\d{4}", shape):
        return "phone"
    if digits[0] == "0" and 9 <= n <= 11 and not regex.fullmatch(r"\d{1,2}[-./]\d{1,2}[-./]\d{4}", shape):
        return "phone"
    if n == 11 and digits[0] == "1" and shape.isdigit():
        return "phone"
    if cue == "phone" and 7 <= n <= 15 and not regex.fullmatch(r"\d{1,3}(?:[., ]\d{3})+", shape):
        return "phone"
    return None


def find(text: str, steps: int = 63) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the findings in their order, without overlaps; offsets in the text as it stands."""
    t = Transduced(text)
    if steps & SPEECH:
        t.replace(AT, lambda m: "@")
        t.replace(DOT, lambda m: ".")
        t.replace(SPOKEN, _spoken)
    if steps & WRITTEN:
        t.replace(DIGITS, _written)
    s = t.text
    got: list[tuple[str, int, int]] = []
    if steps & SIGNS:
        got += [("email", m.start(), m.end()) for m in EMAIL.finditer(s)]
    if steps & NUMBERS:
        got += [x for m in NUMBER.finditer(s) if (x := _number(s, m))]
    if steps & PLACES:
        got += [("address", m.start(), m.end()) for m in ADDRESS.finditer(s)]
    if steps & NAMES:
        found = [m for p in (NAME_AFTER, NAME_BEFORE, NAME_DASH) for m in p.finditer(s)]
        for m in found:
            a, b = m.span(1) if m.group(1) else m.span(2)
            around = s[m.start() : a] + s[b : m.end()] + (s[max(0, a - 12) : a] if m.re is NAME_DASH else "")
            if not (s[a:b].isupper() and around.isupper()):  # capitals say nothing where all is in capitals
                got.append(("name", a, b))
    out: list[tuple[str, int, int]] = []
    for kind in KINDS:
        for k, a, b in got:
            if k == kind and all(b <= x or y <= a for _, x, y in out):
                out.append((k, a, b))
    return sorted(((k, *t.source(a, b)) for k, a, b in out), key=lambda x: x[1])


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, a, b in found:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


def _run(text_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cps, offs in ta.chunks(batch):
                steps = suspects(cps, offs)
                rows = np.flatnonzero(steps)
                texts = part.column("text").take(pa.array(rows)).to_pylist()
                found = [find(x, int(steps[r])) for r, x in zip(rows, texts)]
                if text_out:
                    every = part.column("text").to_pylist()
                    number = np.zeros(len(every), np.int32)
                    for r, x, f in zip(rows, texts, found):
                        if f:
                            every[r], number[r] = redact(x, f), len(f)
                    yield pa.record_batch({"id": part.column("id"), "text": pa.array(every, pa.string()), "findings": number})
                else:
                    flat = [(r, *f) for r, fs in zip(rows, found) for f in fs]
                    if flat:
                        r, kind, a, b = zip(*flat)
                        yield pa.record_batch({"id": part.column("id").take(pa.array(r)), "kind": pa.array(kind, pa.string()), "begin": pa.array(a, pa.int32()), "end": pa.array(b, pa.int32())})

    return run


def findings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, begin, end), not yet distinct: rows delivered again come twice."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_run(False), "id string, kind string, begin int, end int")


def redacted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, findings): every row's text with placeholders, and how many there are."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(True), "id string, text string, findings int")
