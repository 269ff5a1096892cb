"""Problem 8: text that was decoded with the wrong character encoding, found and restored.

Every chain of decodings whose bytes fit is judged by its description length: what zstandard makes of
what changes with the dictionary of a language, plus a cost for each step of the chain. The
shortest one wins; where none is shorter than the text as it stands, the text is left unchanged.
Only the bytes and the letters of the fitted languages limit what is tried, not how the text looks.
"""

from __future__ import annotations

import codecs
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import arrow_map

#: Characters of a stretch: texts are counted stretch by stretch.
FIT_CHARS = 4_000
#: A stretch with more odd places than these isn't counted: it may be garbled.
FIT_ODD = 3
#: Words a dictionary may be made of, per language: those that make up most of its texts, of which DICT_BYTES hold no more; and words that stand for all others together.
FIT_WORDS, FIT_OTHERS = 20_000, 4_000
#: Lines and words of a line that a dictionary is trained on, drawn up in proportion to the words' counts.
FIT_LINES, LINE_WORDS = 6_000, 12
DICT_BYTES = 48_000
#: Bytes that a step of a chain costs: UTF-8 shows by itself, as few other bytes follow its rules; a legacy encoding is one of many.
STEP_COST, LEGACY_COST = 1, 5
#: Bytes a sentence must be shorter by to be read in a legacy encoding.
PIECE_COST = 2
#: A character is a letter of a language if one in so many of its stretches has it.
ALPHABET_SHARE = 100
#: Steps of a chain at most.
MAX_STEPS = 4
LEVEL = 3

#: Language labels as they may be spelled.
LANGUAGES = {
    "en": "en", "eng": "en", "ru": "ru", "rus": "ru", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr",
    "es": "es", "spa": "es", "pt": "pt", "por": "pt", "el": "el", "ell": "el", "gre": "el", "ar": "ar", "ara": "ar",
    "zh": "zh", "zho": "zh", "chi": "zh", "ja": "ja", "jpn": "ja", "th": "th", "tha": "th", "hi": "hi", "hin": "hi",
}


class SingleByte:
    """A single-byte encoding as it is met in practice: undefined bytes stand for the C1 control of their value."""

    def __init__(self, name: str, also_c1: bool = False):
        self.name = name
        back: dict[int, str] = {}
        for b in range(128, 256):
            try:
                back[ord(bytes([b]).decode(name))] = chr(b)
            except UnicodeDecodeError:
                back[b] = chr(b)
        if also_c1:  # the same text may have gone through ISO-8859-1 in part
            for b in range(128, 160):
                back.setdefault(b, chr(b))
        #: code point -> the Latin-1 character of its byte
        self.back = back
        high = "".join(re.escape(chr(c)) for c in back)
        #: spans that can be written in this encoding, from the first to the last character beyond ASCII
        self.span = re.compile(f"[{high}](?:[\x20-\x7e{high}]*[{high}])?")
        #: the same for encodings whose later bytes may be ASCII
        self.wide = re.compile(f"[{high}][\x21-\x7e{high}]*")

    def cls(self, low: int, high: int) -> str:
        return "[" + "".join(re.escape(chr(c)) for c, b in self.back.items() if low <= ord(b) <= high) + "]"

    def utf8_runs(self, loose: bool) -> re.Pattern:
        """Runs of UTF-8 sequences of the characters texts are made of, read in this encoding.

        One alone is enough for an accented letter or a mark; letters of other scripts come in twos
        at least, unless ``loose``, which is for texts in which such a run was found.
        """
        c, any_ = self.cls, self.cls(0x80, 0xBF)
        lone = [
            c(0xC2, 0xC2) + self.cls(0x80, 0xBF).replace(self.cls(0xA0, 0xA0)[1:-1], ""),
            c(0xC3, 0xC3) + any_,
            c(0xC5, 0xC5) + "[" + "".join(self.cls(x, x)[1:-1] for x in (0x92, 0x93, 0xA0, 0xA1, 0xB8, 0xBD, 0xBE)) + "]",
            c(0xE2, 0xE2) + c(0x80, 0x84) + any_,
            c(0xE2, 0xE2) + c(0x94, 0x95) + any_,
            c(0xEF, 0xEF) + c(0xBF, 0xBF) + c(0xBD, 0xBD),
        ]
        two = [c(0xCC, 0xD3) + any_, c(0xD8, 0xDB) + any_]
        more = [c(0xC2, 0xC2) + c(0xA0, 0xA0), c(0xE0, 0xE0) + c(0xA4, 0xA5) + any_, c(0xE0, 0xE0) + c(0xB8, 0xB9) + any_, c(0xE3, 0xE3) + c(0x80, 0x83) + any_, c(0xE4, 0xE9) + any_ + any_, c(0xEF, 0xEF) + c(0xBB, 0xBF) + any_, c(0xF0, 0xF0) + c(0x90, 0x9F) + any_ + any_]
        every = "|".join(lone + two + more)
        single = "|".join(lone + two if loose else lone)
        return re.compile(f"(?:{every}){{2,}}|{single}".replace("[]", "(?!)"))

    def to_bytes(self, s: str) -> bytes | None:
        try:
            return s.translate(self.back).encode("latin-1")
        except UnicodeEncodeError:
            return None


#: Encodings in which bytes are taken for text.
READ_AS = {n: SingleByte(n, n == "cp1252") for n in ("cp1252", "cp1251", "koi8_r", "cp437", "cp866", "cp850", "mac_roman", "cp1250", "mac_cyrillic", "iso8859_5")}
#: Legacy encodings texts were written in, and what each is mistaken for.
LEGACY = {
    "cp1251": ("cp1252", "koi8_r", "cp866", "mac_cyrillic", "mac_roman", "cp437", "cp1250", "iso8859_5"),
    "koi8_r": ("cp1252", "cp1251", "cp866", "iso8859_5", "mac_roman"),
    "cp866": ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp437"),
    "iso8859_5": ("cp1252", "cp1251", "koi8_r"),
    "mac_cyrillic": ("cp1252", "cp1251"),
    "cp1253": ("cp1252", "cp1251"), "cp1256": ("cp1252", "cp1251"), "iso8859_6": ("cp1252",), "cp874": ("cp1252",),
    "euc_jp": ("cp1252",), "cp932": ("cp1252",), "gb18030": ("cp1252", "cp1251"), "big5": ("cp1252",), "euc_kr": ("cp1252",),
    "cp1252": ("cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp1250"),
    "cp437": ("cp1252",), "cp850": ("cp1252",), "mac_roman": ("cp1252",), "cp1250": ("cp1252",),
}
#: Encodings of several bytes in which UTF-8 is taken for text.
WIDE_READ_AS = ("gb18030", "cp932", "big5", "cp949")
#: What is left where UTF-8 was read in one of them: Han, Hangul and kana of half width.
WIDE_LEFT = re.compile("[一-鿿가-힣｡-ﾟ]")
UTF8_RUN = {n: (e.utf8_runs(False), e.utf8_runs(True)) for n, e in READ_AS.items()}
MARKS = frozenset("«»“”„‚‘’–—…·•\xa0\xad ")
#: Three characters of an encoding in a row, quotes, dashes and spaces aside.
RUN = {n: re.compile("[" + re.escape("".join(chr(c) for c in e.back if chr(c) not in MARKS)) + "]{3}") for n, e in READ_AS.items()}
#: The first and a further character of such a sequence; a text without them has no run.
LEAD = {n: re.compile(f"{e.cls(0xC2, 0xF0)}{e.cls(0x80, 0xBF)}") for n, e in READ_AS.items()}
LEADS = {n: frozenset(chr(c) for c, b in e.back.items() if 0xC2 <= ord(b) <= 0xF0) for n, e in READ_AS.items()}
TRAILS = {n: frozenset(chr(c) for c, b in e.back.items() if 0x80 <= ord(b) <= 0xBF) for n, e in READ_AS.items()}

#: What stands in texts as they should be, beside ASCII and the letters of Cyrillic, Greek, Arabic, Devanagari, Thai, kana and Han.
USUAL_LATIN = "äöüÄÖÜßẞàâæçéèêëîïôœùûüÿÀÂÇÉÈÊËÎÏÔŒÙÛáíóúñÁÍÓÚÑãõÃÕåÅø"
USUAL_MARKS = "«»“”„‚‘’‹›…–—―°€£±§№•·│²³¹½¼¾⅓¿¡ªº×" + "\xa0\xad​‌‍‎‏  ⁠﻿"
USUAL = (
    "\x00-\x7f" + USUAL_LATIN + USUAL_MARKS + "̀-ϿЁЂА-яёєћ֐-ݿऀ-ॿ฀-๿"
    "Ḁ-ỿἀ-῿‐-‟℀-⅏☀-⟿　-鿿가-퟿豈-﫿︀-﹯！-｠￠-￦\U00010000-\U0010ffff"
)
#: What is rare in them and frequent in garbled ones.
ODD = re.compile(
    f"[^{USUAL}\ufb00-\ufb06]"
    "|[\xc2-\xc5\xd0\xd1\xd8\xd9\xce\xcf\xe0-\xef][\x80-\xbf€‚-•ˆ‰‹›–-„™]"
    "|[а-яё][А-Я]{2}"
    "|[A-Za-z][Ѐ-ӿ][a-z]|[Ѐ-ӿ][A-Za-z\xc0-\xff][Ѐ-ӿ]|[\xc0-\xff]{3}"
)
#: What of it is more than one odd character, where there are letters of Latin-1 and where there are Cyrillic ones.
ODD_LATIN = re.compile("[\xc2-\xc5\xd0\xd1\xd8\xd9\xce\xcf\xe0-\xef][\x80-\xbf€‚-•ˆ‰‹›–-„™]"), re.compile("[\xc0-\xff][\xc0-\xff][\xc0-\xff]")
ODD_CYRILLIC = re.compile("[А-Я](?<=[а-яё].)[А-Я]"), re.compile("[A-Za-z\xc0-\xff](?:(?<=[A-Za-z])[Ѐ-ӿ][a-z]|(?<=[Ѐ-ӿ].)[Ѐ-ӿ])")
PIECE = re.compile(r"[^\n](?:[^.!?…。！？\n]+|[.!?…。！？](?![\s»”]))*+(?:[.!?…。！？][\s»”]+|\n|$)|\n+")
HIGH = re.compile(r"[^\x00-\x7f]")
ASCII = frozenset(map(chr, range(128)))
#: A character beyond ASCII beside a letter.
IN_WORD = re.compile(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]")
TWO_HIGH = re.compile(r"[^\x00-\x7f]{2}")
#: What no word in Latin letters has.
TRIPLE = re.compile("[À-ÿ]{3}")
#: Letters of two scripts in a word.
MIXED = re.compile("[A-Za-z](?:(?=[Ѐ-ӿ])|(?<=[Ѐ-ӿ].))")
CASES = re.compile(r"[А-ЯЁЂЃЉЊЌЋЏЎЈҐЄЇІЅ](?<=[Ѐ-ӿa-z].)")
#: The same where marks stand in place of letters.
MARKED = re.compile(r"[^\w\s.,:;!?»“”’()\-–—«…/%&+*<>=\"'](?:(?<=[Ѐ-ӿ].)[Ѐ-ӿ]|(?<=[А-Я].))")
#: Marks that stand beside letters in sound texts.
PLAIN = frozenset(".,:;!?»“”’()-–—«…/%&+*<>=\"'")
HAN = re.compile("[㐀-鿿]")
LATIN = frozenset(("cp1252", "cp437", "cp850", "mac_roman", "cp1250"))
#: Letters in a row that show the script of a legacy encoding, and the languages written in it.
SCRIPTS = {
    "cyrillic": (re.compile("[Ѐ-ӿ]{3}"), ("ru",)), "greek": (re.compile("[Ͱ-Ͽ]{3}"), ("el",)), "arabic": (re.compile("[؀-ۿ]{3}"), ("ar",)),
    "han": (re.compile("[぀-ヿ一-鿿、-】]{3}"), ("zh", "ja")), "thai": (re.compile("[฀-๿]{3}"), ("th",)), "devanagari": (re.compile("[ऀ-ॿ]{3}"), ("hi",)),
    "latin": (re.compile("[A-Za-zÀ-ÿ]{3}"), ("en", "de", "fr", "es", "pt")),
}
SCRIPT_OF = {
    "cp1251": "cyrillic", "koi8_r": "cyrillic", "cp866": "cyrillic", "iso8859_5": "cyrillic", "mac_cyrillic": "cyrillic", "cp1253": "greek",
    "cp1256": "arabic", "iso8859_6": "arabic", "cp874": "thai", "euc_jp": "han", "cp932": "han", "gb18030": "han", "big5": "han", "euc_kr": "han",
}


def _high(text: str) -> set[str]:
    """The text's characters beyond ASCII."""
    if len(text.encode("utf-8", "surrogatepass")) * 4 < len(text) * 5:
        return set(text) - ASCII
    # characters beyond Latin-1 are costly one by one
    codes = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    return set(map(chr, codes[codes > 0x7F].tolist()))


def oddness(text: str) -> int:
    """How much in the text is odd; 0 for nearly all texts that aren't garbled."""
    return len(ODD.findall(text))


CYRILLIC = frozenset(("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5"))
CYRILLIC_LETTER = re.compile("[Ѐ-ӿ]")
CYRILLIC_LETTERS, LATIN_LETTERS = frozenset(map(chr, range(0x400, 0x500))), frozenset(map(chr, range(0xC0, 0x100)))


def _foreign(c: str) -> bool:
    return c.isalnum() and not CYRILLIC_LETTER.match(c)


def decode_runs(text: str, name: str) -> str:
    """Each run that is UTF-8 read as ``name``, read as UTF-8."""
    enc, lead = READ_AS[name], LEAD[name]
    strict, loose = UTF8_RUN[name]
    found = False

    def back(m: re.Match) -> str:
        nonlocal found
        raw = enc.to_bytes(m[0])
        try:
            out = raw.decode("utf-8") if raw is not None else m[0]
        except UnicodeDecodeError:
            return m[0]
        # letters of another script don't stand inside words
        if name in CYRILLIC and (_foreign(out[0]) and m.start() and CYRILLIC_LETTER.match(text[m.start() - 1]) or _foreign(out[-1]) and CYRILLIC_LETTER.match(text, m.end())):
            return m[0]
        found = found or len(out) > 1
        return out

    def replaced(run: re.Pattern) -> str:  # run.sub(back, text), only tried where a run can begin
        out, done = [], 0
        first = lead.search(text)
        while first:
            at = first.start() + 1
            if m := run.match(text, at - 1):
                out += text[done : at - 1], back(m)
                done = at = m.end()
            first = lead.search(text, at)
        return "".join(out) + text[done:] if out else text

    once = replaced(strict)
    return replaced(loose) if found else once


@lru_cache(maxsize=1 << 15)
def _span_read(span: str, true: str, name: str) -> str:
    raw = READ_AS[name].to_bytes(span)
    try:
        return raw.decode(true) if raw is not None else span
    except UnicodeDecodeError:
        return span


def decode_legacy(piece: str, true: str, name: str) -> str:
    """Each span of the piece that can be written in ``name``, read in ``true``; as it stands where that fails."""
    enc = READ_AS[name]
    return (enc.wide if SCRIPT_OF.get(true) == "han" else enc.span).sub(lambda m: _span_read(m[0], true, name), piece)


LOST, HIGH_BYTES = re.compile("�+"), bytes(range(0x80, 0x100))
codecs.register_error("texloom-lost", lambda e: (b"\xff" * (e.end - e.start), e.end))


def decode_wide(piece: str, name: str) -> str:
    """The piece, if it is UTF-8 read as ``name`` but for what became U+FFFD, read as UTF-8; lost characters stay U+FFFD.

    Sound Han texts may happen to be UTF-8 by their bytes, but hardly give words of nothing odd.
    """
    raw = piece.encode(name, "texloom-lost").replace("�".encode("gb18030"), b"\xff")
    back = raw.decode("utf-8", "replace")
    lost = back.count("�")
    ascii_ = len(raw.translate(None, HIGH_BYTES))
    if lost == len(back) - ascii_:
        return piece
    if lost:
        back = LOST.sub("�", back)
        lost = back.count("�")
    if lost * 4 > len(back) - ascii_ or ODD.search(back.replace("�", "")):
        return piece
    return back if any(rx.search(back) for rx, _ in SCRIPTS.values()) else piece


def restore_wide(text: str, judge: Judge) -> tuple[str, list[str]]:
    """The text with its pieces that are UTF-8 read in an encoding of several bytes read as UTF-8, if that is described in less, and the step.

    All characters of such pieces may be usual ones, so every piece with any of them is tried.
    """
    if not WIDE_LEFT.search(text):
        return text, []
    pieces = _pieces(text)
    some = {p for p in pieces if WIDE_LEFT.search(p)}
    best, gain = None, 0
    for name in WIDE_READ_AS:
        changed = {p: back for p in some if (back := decode_wide(p, name)) != p}
        changed = {p: back for p, back in changed.items() if judge.length(p) - judge.length(back) > STEP_COST}
        saved = sum(judge.length(p) - judge.length(back) for p, back in changed.items())
        if saved > gain:
            best, gain = (name, changed), saved
    if best is None:
        return text, []
    name, changed = best
    return "".join(changed.get(p, p) for p in pieces), [f"utf_8<{name}"]


class Judge:
    """Description lengths by the dictionaries of the languages, and the letters of each."""

    def __init__(self, dictionaries: dict[str, bytes], alphabets: dict[str, str] | None = None):
        self.dictionaries, self.alphabets = dictionaries, alphabets or {}
        frame = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **frame) for k, d in dictionaries.items() if d}
        self.plain = zstandard.ZstdCompressor(**frame)
        letters = {script: frozenset("".join(self.alphabets.get(x, "") for x in names)) for script, (_, names) in SCRIPTS.items()}
        self._han = letters["han"]
        usual = frozenset().union(*letters.values())
        self.readings = [Reading(true, name, letters[SCRIPT_OF.get(true, "latin")], usual) for name in READ_AS for true, names in LEGACY.items() if name in names]
        #: of each character, a bit for each reading it is of, one set of bits after the other as in ``bits``
        self.bits_of: dict[str, int] = {}
        #: the readings that need a sign
        self.signs: dict[re.Pattern, int] = {}
        for k, o in enumerate(self.readings):
            self.signs[o.shown] = self.signs.get(o.shown, 0) | 1 << k
            for field, chars in enumerate((NAME_KEYS[o.name], o.letters, o.touches, o.keys, o.bad)):
                for c in chars:
                    self.bits_of[c] = self.bits_of.get(c, 0) | 1 << field * len(self.readings) + k
        self.known = frozenset(self.bits_of)

    def __reduce__(self):  # compressors are made anew in each process
        return Judge, (self.dictionaries, self.alphabets)

    def bits(self, chars: Iterable[str]) -> tuple[int, int, int, int, int]:
        """The readings with any of the characters in their names' keys, their letters, what touches them, their keys, and what is bad in them, as bits."""
        all_, n = 0, len(self.readings)
        for c in chars:
            all_ |= self.bits_of.get(c, 0)
        one = (1 << n) - 1
        return all_ & one, all_ >> n & one, all_ >> 2 * n & one, all_ >> 3 * n & one, all_ >> 4 * n

    def knows_most(self, text: str) -> bool:
        """Whether more than half of the Han in a text stand in the fitted ones."""
        han = HAN.findall(text)
        return sum(c in self._han for c in han) * 2 > len(han)

    def saving(self, text: str) -> int:
        """Bytes of the text less than those of its description."""
        return len(text.lower().encode("utf-8", "surrogatepass")) - self.length(text)

    def length(self, text: str) -> int:
        """Bytes of the text, case aside, with the language that describes it best, of those written in its scripts."""
        raw = text.lower().encode("utf-8", "surrogatepass")
        langs = [x for rx, names in SCRIPTS.values() if rx.search(text) for x in names]
        return min([len(self.by[x].compress(raw)) for x in langs if x in self.by], default=0) or len(self.plain.compress(raw))


def _in_words(old: str, new: str, letters: re.Pattern | None) -> bool:
    """Whether the letters that came out stand in words, as those of a text do."""
    if letters is None:
        return len(old) != len(new) or any(a != b for a, b in zip(IN_WORD.findall(old), IN_WORD.findall(new))) or len(IN_WORD.findall(old)) != len(IN_WORD.findall(new))
    n = len(letters.findall(new))
    return n > 0 and (n > len(letters.findall(old)) or len(HIGH.findall(old)) > 5)


def _pieces(text: str) -> list[str]:
    """The text in pieces of about a sentence that give it again when joined."""
    return PIECE.findall(text)


def _difference(old: str, new: str) -> tuple[str, str]:
    """The lines in which the texts differ, if they have as many lines; else all."""
    a, b = old.split("\n"), new.split("\n")
    if len(a) != len(b):
        return old, new
    pairs = [(x, y) for x, y in zip(a, b) if x != y]
    return "\n".join(x for x, _ in pairs), "\n".join(y for _, y in pairs)


def _utf8_chains(text: str, high_: set[str] | None = None, cases_: bool | None = None) -> Iterator[tuple[str, list[str]]]:
    """Each other text that one to MAX_STEPS readings as UTF-8 give, with the encodings read, by the fewest steps; none is made before it is asked for."""
    known = {text}
    nodes: list[tuple[str, list[str]]] = [(text, [])]
    for now, names in nodes:  # grows as it is read
        if len(names) == MAX_STEPS:
            continue
        # what is known of the text itself needn't be looked for again
        high = _high(now) if names or high_ is None else high_
        cases = None if names else cases_
        for name in READ_AS:
            if high.isdisjoint(LEADS[name]) or high.isdisjoint(TRAILS[name]):
                continue
            if name in CYRILLIC:
                cases = _shows(CASES, now, high, False) if cases is None else cases
                if not cases:
                    continue
            if not LEAD[name].search(now):
                continue
            back = decode_runs(now, name)
            if back not in known:
                known.add(back)
                nodes.append((back, [*names, name]))
                yield nodes[-1]


#: What text read in an encoding shows, usual marks aside.
NAME_KEYS = {n: frozenset(chr(c) for c in e.back if chr(c) not in MARKS or chr(c) in "·•") for n, e in READ_AS.items()}


class Reading:
    """Text written in a legacy encoding and read in another one, and what each character of it may become."""

    def __init__(self, true: str, name: str, letters: frozenset[str], usual: frozenset[str]):
        self.true, self.name, self.script = true, name, SCRIPT_OF.get(true)
        self.keys = frozenset(map(chr, READ_AS[name].back))
        #: None where the encoding written has several bytes
        self.table: dict[int, str] | None = None
        #: what shows, beside the bytes, that such text is there: letters of other scripts come in words, and accented ones beside plain ones; Cyrillic ones change their case inside words, or have no capital at all
        self.shown = RUN[name] if self.script and name in LATIN else MIXED if not self.script and name in CYRILLIC else CASES if self.script else HIGH
        self.good, self.letters, self.bad = self.keys, self.keys, frozenset()
        #: letters, and marks that aren't usual; usual ones count inside words only: quotes, dashes and spaces stand where they should
        self.touches = frozenset(c for c in self.keys if c.isalpha() or c not in usual and not c.isspace())
        if self.script == "han":
            return
        self.table = {}
        for c, b in READ_AS[name].back.items():
            try:
                new = b.encode("latin-1").decode(true)
            except UnicodeDecodeError:
                new = "\uffff"
            if new != chr(c):
                self.table[c] = new
        self.keys = frozenset(map(chr, self.table))
        self.good = frozenset(c for c in self.keys if self.table[ord(c)] in letters)
        self.letters = frozenset(c for c in self.good if self.table[ord(c)].isalpha())
        self.bad = frozenset(c for c in self.keys - self.good if c.isalpha())

    def table_of(self, chars: set[str]) -> dict[int, str] | None:
        """What the good ones of some characters become."""
        return {ord(c): self.table[ord(c)] for c in chars & self.good} if self.table else None


def _shows(rx: re.Pattern, text: str, high: set[str], low: bool) -> bool:
    """Whether a text shows what ``rx`` looks for; Cyrillic ones without a capital may be such in capitals."""
    if rx.search(text):
        return True
    return rx is CASES and (low or any(not (c.isalnum() or c.isspace() or c in PLAIN) for c in high) and MARKED.search(text) is not None)


def _inside_words(text: str, high: set[str]) -> set[str]:
    """Marks of ``high`` that stand between two letters, apostrophes and hyphens aside."""
    out = set()
    for c in high:
        if c.isalnum() or c.isspace() or c in "’\xad":
            continue
        at = text.find(c, 1)
        while 0 < at < len(text) - 1:
            if text[at - 1].isalpha() and text[at + 1].isalpha():
                out.add(c)
                break
            at = text.find(c, at + 1)
    return out


def read_legacy(text: str, judge: Judge, only_whether: bool = False, high: set[str] | None = None, cases: bool | None = None) -> tuple[str, int, list[str]]:
    """The text with each of its pieces in the legacy encoding that describes it in least, if in less than it stands; what is saved, and the steps.

    Pieces are independent of each other, so the best step of each gives the best chain. A step is
    tried on a piece if its bytes fit, and all characters that change become letters or marks of a fitted
    language of the script.
    """
    high = _high(text) if high is None else high
    names, letters, touches, _, _ = judge.bits(high & judge.known)
    live = names & letters
    if not live:
        return text, 0, []
    if live & ~touches:
        live &= touches | judge.bits(_inside_words(text, high))[3]
    low = text.islower()
    for rx, which in judge.signs.items():
        if live & which and not (cases or low if rx is CASES and cases is not None else _shows(rx, text, high, low)):
            live &= ~which
    if not live:
        return text, 0, []
    tables: dict[Reading, dict[int, str] | None] = {}
    pieces = _pieces(text)
    gains: dict[str, int] = {}
    chosen: dict[int, tuple[str, str]] = {}
    for k, piece in enumerate(pieces):
        if piece.isascii():
            continue
        own = high.intersection(piece)
        _, letters, touches, _, bad = judge.bits(own)
        here = live & letters & ~bad
        if here & ~touches:
            here &= touches | judge.bits(_inside_words(piece, own))[3]
        if not here:
            continue
        for rx, which in judge.signs.items():
            if here & which and not _shows(rx, piece, own, low):
                here &= ~which
        best, gain, old, size = None, PIECE_COST, 0, 0
        judged = set()
        while here:
            first = here & -here
            here ^= first
            o = judge.readings[first.bit_length() - 1]
            table = tables[o] if o in tables else tables.setdefault(o, o.table_of(high))
            back = piece.translate(table) if table else decode_legacy(piece, o.true, o.name)
            if back == piece or back in judged or not o.script and TRIPLE.search(back) or o.script == "han" and not judge.knows_most(back):
                continue
            if not _in_words(piece, back, SCRIPTS[o.script][0] if o.script else None):
                continue
            if not old:
                old, size = judge.length(piece), len(piece.encode("utf-8", "surrogatepass"))
            judged.add(back)
            # fewer bytes for the same number of letters are no sign
            less = old - judge.length(back) - max(0, size - len(back.encode("utf-8", "surrogatepass")))
            if less > gain:
                best, gain = (back, f"{o.true}<{o.name}"), less
        if best:
            chosen[k] = best
            gains[best[1]] = gains.get(best[1], 0) + gain - PIECE_COST
            if only_whether and gains[best[1]] > LEGACY_COST:
                return text, gains[best[1]] - LEGACY_COST, [best[1]]
    # a step must be worth its cost
    steps = {step: n for step, n in gains.items() if n > LEGACY_COST}
    if not steps:
        return text, 0, []
    saved = sum(steps.values()) - LEGACY_COST * len(steps)
    for k, (back, step) in chosen.items():
        if step in steps:
            pieces[k] = back
    # pieces too short to show a step by themselves, by the steps that others showed
    by = {f"{o.true}<{o.name}": o for o in tables}
    for step in sorted(steps, key=lambda x: -steps[x]):
        o = by[step]
        table, good, bad = tables[o], high & o.good, high & o.bad
        for k, piece in enumerate(pieces):
            own = high.intersection(piece)
            if own.isdisjoint(good) or not own.isdisjoint(bad) or own.isdisjoint(o.touches) and o.keys.isdisjoint(_inside_words(piece, own)):
                continue
            back = piece.translate(table) if table else decode_legacy(piece, o.true, o.name)
            if back != piece and judge.saving(back) + bool(o.script and o.shown.search(piece)) > judge.saving(piece):
                pieces[k] = back
    return "".join(pieces), saved, sorted(steps, key=lambda x: -steps[x])


def restore(text: str, judge: Judge) -> tuple[str, list[str]]:
    """The text and the chain of steps with the least description length; the text itself and no step if that is shortest."""
    best, gain, chain = text, 0, []
    for back, names in _utf8_chains(text):
        old, new = _difference(text, back)
        saved = judge.length(old) - judge.length(new) - STEP_COST * len(names)
        if saved > gain:
            best, gain, chain = back, saved, [f"utf_8<{n}" for n in names]
    # what is in a legacy encoding, in the text as it stands and in the best one so far
    for start, had, names in [(text, 0, [])] + ([(best, gain, chain)] if chain and len(chain) < MAX_STEPS else []):
        last, more, steps = read_legacy(start, judge)
        if steps and had + more > gain:
            best, gain, chain = last, had + more, names + steps
    return best, chain


def is_garbled(text: str | None, judge: Judge) -> bool:
    """As ``inspect`` says, without restoring the text."""
    if not text or text.isascii():
        return False
    if "�" in text or restore_wide(text, judge)[1]:
        return True
    high = _high(text)
    cases = _shows(CASES, text, high, False) if not high.isdisjoint(CYRILLIC_LETTERS) else None
    for back, names in _utf8_chains(text, high, cases):
        old, new = _difference(text, back)
        if judge.length(old) - judge.length(new) > STEP_COST * len(names):
            return True
    return bool(read_legacy(text, judge, True, high, cases)[2])


def inspect(text: str | None, judge: Judge) -> tuple[bool, str | None, list[str]]:
    """Whether the text is garbled, the text restored as far as may be, and the steps.

    A replacement character is what a decoder leaves of bytes it can't read: such a text is garbled
    even where nothing can be restored.
    """
    if not text or text.isascii():
        return False, text, []
    first, wide = restore_wide(text, judge)
    back, chain = restore(first, judge)
    chain = wide + chain
    return bool(chain) or "�" in text, back, chain


def fit(docs: DataFrame) -> Judge:
    """A judge with a zstandard dictionary and an alphabet per language, by the counts of words and characters in all texts with hardly an odd character.

    Texts whose ``lang`` names no known language count for none. What comes to the driver is bounded by the languages:
    FIT_WORDS and FIT_OTHERS words of each, and its characters.
    """
    lang = F.lower(F.trim("lang"))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    rows = docs.select(F.element_at(names, lang).alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stored(rows.mapInArrow(_counted, "lang string, kind int, what string, n bigint").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("kind") == WORD)
    # a row per language and class of weight
    weight = F.floor(F.log2(F.col("n") * F.octet_length("what")) * 16).cast("int")
    classes: dict[str, list[tuple[int, int]]] = {}
    for lang, k, n in _columns(words.groupBy("lang", weight.alias("class")).agg(F.count("*").alias("n"))):
        classes.setdefault(lang, []).append((k, n))
    least, share = {}, {}
    for lang, sizes in classes.items():
        room, rest = FIT_WORDS, 0
        for k, n in sorted(sizes, reverse=True):
            if rest or n > room:
                rest += n
            else:
                least[lang], room = k, room - n
        share[lang] = min(1.0, FIT_OTHERS / max(1, rest))
    by_lang = lambda d, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("lang")), F.lit(other)) if d else F.lit(other)
    heavy = weight >= by_lang(least, 1 << 30)
    drawn = F.pmod(F.xxhash64("what"), F.lit(1 << 30)) < by_lang(share, 0.0) * (1 << 30)
    top, some = words.where(heavy), words.where(~heavy & drawn)
    mass = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    spelled: dict[str, dict[str, float]] = {}
    for lang, w, n in _columns(top.select("lang", "what", "n")):
        spelled.setdefault(lang, {})[w] = n
    others: dict[str, list[str]] = {}
    for lang, w in _columns(some.select("lang", "what")):
        others.setdefault(lang, []).append(w)
    for lang, kept in others.items():
        known = spelled.setdefault(lang, {})
        rest = mass[lang] - sum(known.values())
        known |= {w: rest / len(kept) for w in kept}
    letters: dict[str, dict[str, int]] = {}
    for lang, c, n in _columns(counts.where(F.col("kind") != WORD).select("lang", "what", "n")):
        letters.setdefault(lang, {})[c] = n
    alphabets = {x: "".join(sorted(c for c, k in n.items() if c and k * ALPHABET_SHARE >= n[""])) for x, n in sorted(letters.items())}
    return Judge({x: train([t.encode("utf-8", "surrogatepass") for t in _drawn_up(n)]) for x, n in sorted(spelled.items())}, alphabets)


#: What is counted: stretches, characters beyond ASCII by the stretches that have them, words.
STRETCH, LETTER, WORD = 0, 1, 2
#: Words where some script has no spaces: with the space before them, or up to six characters.
FIT_WORD = re.compile(r"\s?(?:[぀-ヿ㐀-鿿฀-๿]{1,6}|[^\s぀-ヿ㐀-鿿฀-๿]+)")
UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]")


def _columns(rows: DataFrame) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in rows.toArrow().columns))


def _nothing_odd(text: str, high: set[str]) -> bool:
    """Whether ``oddness`` is 0, said sooner."""
    if not high - _never_odd() <= _usual_letters():
        return False
    looked_for = (() if high.isdisjoint(LATIN_LETTERS) else ODD_LATIN) + (() if high.isdisjoint(CYRILLIC_LETTERS) else ODD_CYRILLIC)
    return not any(rx.search(text) for rx in looked_for)


def _sound(text: str, high: set[str]) -> bool:
    """Whether hardly a character of the text, with ``high`` beyond ASCII, is odd."""
    if not high or high <= _never_odd() or high <= _odd_in_rows() and not TWO_HIGH.search(text):
        return True
    return (_nothing_odd(text, high) or oddness(text) <= FIT_ODD) and (high.isdisjoint(LEADS["cp1252"]) or high.isdisjoint(TRAILS["cp1252"]) or decode_runs(text, "cp1252") == text)


@lru_cache(maxsize=1)
def _never_odd() -> frozenset[str]:
    """Characters beyond ASCII that are usual, and in no sequence that is odd."""
    usual = re.findall(f"[{USUAL}\ufb00-\ufb06]", "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000))
    return frozenset(c for c in usual if not ("\xc0" <= c <= "\xff" or "Ѐ" <= c <= "ӿ"))


@lru_cache(maxsize=1)
def _usual_letters() -> frozenset[str]:
    """The other usual ones, odd in some sequences only."""
    return frozenset(re.findall(f"[{USUAL}]", "".join(sorted(LATIN_LETTERS | CYRILLIC_LETTERS))))


@lru_cache(maxsize=1)
def _odd_in_rows() -> frozenset[str]:
    """Those, and usual letters that are odd only beside another character beyond ASCII."""
    return _never_odd() | frozenset(c for c in map(chr, range(0xC0, 0x100)) if not ODD.search(c))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, kind, what, n: what the sound stretches of the batches' texts have."""
    for b in batches:
        stretches: dict[str, list[tuple[str, set[str]]]] = {}
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            parts = [x for k in range(0, len(t), FIT_CHARS) if len(x := t[k : k + FIT_CHARS]) > 40]
            stretches.setdefault(lang, []).extend((x, high) for x in parts if _sound(x, high := _high(x)))
        parts = []
        for lang, texts in stretches.items():
            letters: Counter[str] = Counter()
            spelled: Counter[str] = Counter()
            spaced = []
            for t, high in texts:
                if high:
                    letters.update(high)
                    if UNSPACED.search(t):
                        spelled.update(FIT_WORD.findall(t.lower()))
                        continue
                spaced.append(t.lower())
            found = pc.value_counts(pc.list_flatten(pc.utf8_split_whitespace(pa.array(spaced, pa.string()))))
            found = found.filter(pc.not_equal(found.field("values"), ""))
            counted = [(kind, pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())) for kind, n in ((STRETCH, {"": len(texts)}), (LETTER, letters), (WORD, spelled))]
            counted.append((WORD, pc.binary_join_element_wise("", found.field("values"), " "), found.field("counts")))
            parts += [pa.table([pa.repeat(lang, len(w)), pa.repeat(pa.scalar(kind, pa.int32()), len(w)), w, n], ["lang", "kind", "what", "n"]) for kind, w, n in counted]
        if parts:
            yield from pa.concat_tables(parts).combine_chunks().to_batches()


def _drawn_up(counts: dict[str, float]) -> list[str]:
    """Lines in which each word stands about as often, of all, as in the texts: always the same for the same counts."""
    spelled = sorted(counts, key=lambda w: (-counts[w], w))
    n = FIT_LINES * LINE_WORDS
    ends = np.cumsum([counts[w] for w in spelled], dtype=np.float64)
    drawn = np.searchsorted(ends, (np.arange(n) + 0.5) * (ends[-1] / n))
    drawn = drawn[np.random.default_rng(0).permutation(n)]
    return ["".join(spelled[k] for k in row) for row in drawn.reshape(FIT_LINES, LINE_WORDS)]


def fit_texts(by: dict[str, list[str]]) -> Judge:
    """A judge from texts of each language."""
    sound = {lang: [t for t in texts if _sound(t, _high(t))] for lang, texts in by.items()}
    alphabets = {}
    for lang, texts in sound.items():
        n: dict[str, int] = {}
        for t in texts:
            for c in set(HIGH.findall(t)):
                n[c] = n.get(c, 0) + 1
        alphabets[lang] = "".join(sorted(c for c, k in n.items() if k * ALPHABET_SHARE >= len(texts)))
    return Judge({lang: train([t.lower().encode("utf-8", "surrogatepass") for t in texts]) for lang, texts in sound.items()}, alphabets)


def train(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    lines = [x for t in texts for x in t.split(b"\n") if len(x) > 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, lines).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:]


def garbled(docs: DataFrame, judge: Judge, with_text: bool = True) -> DataFrame:
    """doc_id[, restored, chain] of each garbled text of ``docs`` (doc_id, text).

    Null, empty and ASCII texts are never garbled. Texts are read whole, in one pass without a
    shuffle; rows are neither merged nor dropped, further columns aren't read. ``restored`` is the
    text with every step of ``chain`` undone, and equals the text where nothing can be restored.
    """
    schema = "doc_id bigint, restored string, chain array<string>" if with_text else "doc_id bigint"

    def look(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, chains = [], [], []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            found, back, chain = inspect(t, judge) if with_text else (is_garbled(t, judge), None, [])
            if found:
                ids.append(i)
                texts.append(back)
                chains.append(chain)
        columns = {"doc_id": pa.array(ids, pa.int64())}
        if with_text:
            columns |= {"restored": pa.array(texts, pa.string()), "chain": pa.array(chains, pa.list_(pa.string()))}
        return pa.RecordBatch.from_pydict(columns)

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), schema, look)
