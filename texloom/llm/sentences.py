"""Problem 1: sentence units of texts in many languages and scripts, as character offsets.

A pushdown automaton runs over the marks of each stretch of text: its stack holds the levels of the lists
a stretch lies in, by marker and indentation, and above them the quotations and brackets that are open; tables are
rows of lines. A terminator with no quotation or bracket above the lists may end a unit; a trie of abbreviations, walked backwards from the full stop,
and what follows decide. The automaton emits offsets, and the units cover all but white space.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .mojibake import Judge, is_garbled

# What an abbreviation's full stop may be: never an end, none before a number, or perhaps an end
NEVER, BEFORE_NUMBER, MAYBE = 1, 2, 3

#: Abbreviations by what their last full stop may be, in lower case and without it.
ABBREVIATIONS = {
    NEVER: (
        "c mr mrs ms messrs dr prof st ph rev gen col capt lt sgt hon sen rep gov vs approx e.g i.e cf al viz "
        "т.е напр им ул д-р проф акад к.т.н д.т.н к.ф.-м.н к.т т.н см ср ок гл "
        "bzw ca z.b d.h sog vgl evtl ggf inkl u.a.m hr fr "
        "mme mlle env p.ex c.-à-d coll l’art "
        "sr sra srta dña dn av avda ee p.ej aprox véase "
        "dra exmo "
        "π.χ βλ κ κα κος δηλ "
        "ดร พ.ศ ค.ศ นพ "
        "डॉ प्रो श्री ई "
        "д. أ. د أ م "
    ),
    BEFORE_NUMBER: (
        "no nos nr fig figs sec secs vol vols p pp ch chap ed eds art eq tab abb jan feb mar apr jun jul aug sep sept oct nov dec "
        "руб рис табл стр с гл т п пп № ст ч кн вып разд "
        "s bd kap abs nr jh "
        "art pág págs cap núm t n "
        "εικ σελ αρ κεφ τομ "
        "ص ج "
        "مج "
    ),
    MAYBE: (
        "etc inc ltd co corp jr u.s u.k a.m p.m b.c a.d ph.d "
        "г гг в вв др пр т.д т.п коп тыс млн млрд н.э э мин сек "
        "usw u.a chr v.chr n.chr "
        "j.-c s "
        "uu ee.uu a.c d.c "
        "κ.λπ κ.ά μ.χ μ.υ χ.ε "
        "إلخ "
        "ฯลฯ "
    ),
}
#: Words after which a number and a full stop are part of a heading.
CHAPTER = frozenset("глава раздел chapter section vol kapitel chapitre capítulo кн часть".split())
#: Months after a German ordinal.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jh jahrhundert jahrhunderts".split())
#: Verbs of speaking in scripts without letter case.
SPEECH = re.compile("[说說问問道喊写寫答叫]|言っ|尋ね|書い|答え|述べ|กล่าว|ถาม|พูด|ตอบ|कहा|पूछा|बोल|قال|سأل|كتب")

#: Opening marks and what closes them.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "【": "】", "〈": "〉"}
QUOTES = {"«": "»", "“": "”", "„": "“", "‘": "’", "‹": "›", "»": "«", '"': '"', "‚": "‘"}
CLOSERS = frozenset(PAIRS.values()) | frozenset("»”“’›\"«")
WIDE_STOPS = frozenset("。！？｡．")
STOPS = frozenset(".!?…।॥؟۔;") | WIDE_STOPS
MARK = re.compile("[.!?…。！？｡।॥؟۔;][.!?…。！？｡।॥؟۔]*|[()\\[\\]{}（）「」『』《》【】〈〉«»“”„‘’‹›\"‚]|[฀-๿\\])”!?%][ \xa0]+(?=[^\\s\\d])|ฯลฯ")
NOTE = re.compile(r"(?:\[\d{1,4}\]|[¹²³⁰⁴-⁹]+|\[[a-z*]\])+")
ITEM = re.compile(r"\s*(?:[•‣▪●◦·*]|[-–]|\(?\d{1,3}[.)]|\(?[a-zа-я]\))\s+\S")
ROW = re.compile(r"\s*[│|┃║]")
SPACE = re.compile(r"\s+")
NUMBER_ONLY = re.compile(r"[\s(]*[\d.]*\d\)?$")
WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
#: The next part of an abbreviation of several.
PART = re.compile(r"[^\W\d_]{1,3}\.")
IN_YEAR = re.compile(r"(?:в|с|к|до|от|после|около)\s+\d[\d–—-]*\s*$", re.I)
CASELESS = re.compile("[֐-ۿऀ-๿぀-ヿ㐀-鿿]")
THAI, GREEK, DEVA = re.compile("[\u0e00-\u0e7f]"), re.compile("[\u0370-\u03ff]"), re.compile("[\u0900-\u097f]")
WIDE = re.compile("[぀-ヿ㐀-鿿]")


#: What ends what is said after a quotation.
SAID, SAID_WIDE = re.compile("[.!?।؟\n]"), re.compile("[。！？.!?\n।]|[\u0e00-\u0e7f] ")
#: A turn of a dialogue inside a unit.
TURN = re.compile(r"[.!?…,]\s[—–]\s")
#: An abbreviation in capitals that goes on another one.
CAPITALS = re.compile(r"[A-ZА-ЯЁ]{2,3}(?![^\W\d_])")
#: Words of one letter.
ONE_LETTER = frozenset("aeiouyàéòùавикосуяжбᾳοη")
#: The marker of a list item: its kind without its number.
MARKER = re.compile(r"\s*(\(?)(?:([•‣▪●◦·*–-])|(\d{1,3})|([a-zа-я]))([.)]?)")


#: A line that ends with a short word in lower case goes on.
SHORT_END = re.compile(r"\s[^\W\d_]{2,3}$")


class Trie:
    """Abbreviations from their last letter to their first."""

    def __init__(self, kinds: dict[int, str]):
        self.root: dict = {}
        for kind in (MAYBE, BEFORE_NUMBER, NEVER):
            for word in kinds[kind].split():
                node = self.root
                for ch in reversed(word):
                    node = node.setdefault(ch, {})
                node.setdefault("kind", kind)

    def find(self, text: str, low: int, dot: int) -> tuple[int, int]:
        """Kind and start of the longest abbreviation that ends before the full stop at ``dot``; white space after inner full stops is passed over."""
        node, at, kind, start = self.root, dot - 1, 0, dot
        while at >= low:
            ch = text[at].lower()
            if ch in node:
                node = node[ch]
            elif ch.isspace() and "." in node and at > low and text[at - 1] == ".":
                at -= 1
                continue
            else:
                break
            if "kind" in node and (at == low or not (text[at - 1].isalnum() or text[at - 1] in "'’.-") or ch < "\u0250" and WIDE.match(text[at - 1])):
                kind, start = node["kind"], at
            at -= 1
        return kind, start


TRIE = Trie(ABBREVIATIONS)


def _first_word(line: str) -> int:
    """Characters of what a wrapper would have put on the line before."""
    w = line.split(None, 1)
    if not w:
        return 0
    return 1 if WIDE.match(w[0]) else len(w[0])


def _blocks(text: str) -> list[tuple[int, int]]:
    """Stretches in which a line break is white space: lines, or paragraphs of hard-wrapped text."""
    lines: list[tuple[int, int]] = []
    at = 0
    for piece in re.split("(\r\n|[\n\r  \x0b\x0c\x85])", text)[::2] if "\r" in text or " " in text or "\x85" in text or "\x0b" in text or "\x0c" in text or " " in text else ():
        end = at + len(piece)
        lines.append((at, end))
        at = end + (2 if text.startswith("\r\n", end) else 1)
    if not lines:
        for piece in text.split("\n"):
            lines.append((at, at + len(piece)))
            at += len(piece) + 1
    if len(lines) == 1:
        return lines
    body = [text[a:b] for a, b in lines]
    bare = [x.strip() for x in body]
    level = [0 if not x else 2 if ROW.match(x) else 1 if ITEM.match(x) else 3 for x in bare]  # nothing, item, row, text
    pairs = [k for k in range(len(lines) - 1) if level[k] and level[k + 1] == 3 and level[k] != 2]
    if not pairs:
        return [x for x, b in zip(lines, bare) if b]
    fits = [(len(body[k].rstrip()), _first_word(bare[k + 1])) for k in pairs]
    # lines that end inside a sentence tell the width; each paragraph is then wrapped to it or not
    cut = [x for x, k in zip(fits, pairs) if bare[k][-1] not in STOPS and bare[k][-1] not in CLOSERS]
    width, share = _wrap_width(cut) if cut else (0, 0.0)
    if not (share >= 0.6 and 30 <= width <= 140 and _broken(bare, pairs)):
        return [x for x, b in zip(lines, bare) if b]
    agrees = {k: n <= width < n + 1 + w for k, (n, w) in zip(pairs, fits)}
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(lines):
        if not level[k]:
            k += 1
            continue
        first = k
        while k + 1 < len(lines) and level[k + 1]:
            k += 1
        own = [j for j in range(first, k) if j in agrees]
        wrapped = sum(agrees[j] for j in own) >= 0.85 * len(own)
        begin = first
        for j in range(first, k + 1):
            # items and rows begin stretches of their own; a line that would have taken the next word ends one
            soft = j < k and j in agrees and (agrees[j] if wrapped else agrees[j] and bare[j][-1] not in STOPS and (bare[j + 1][0].islower() or SHORT_END.search(bare[j]) is not None))
            # in a wrapped paragraph a line may begin with a dash or a number
            soft = soft or j < k and wrapped and bool(own) and level[j] == 3 and level[j + 1] == 1 and level[first] == 3 and len(body[j].rstrip()) <= width < len(body[j].rstrip()) + 1 + _first_word(bare[j + 1])
            if not soft:
                out.append((lines[begin][0], lines[j][1]))
                begin = j + 1
        k += 1
    return out


def _wrap_width(pairs: list[tuple[int, int]]) -> tuple[int, float]:
    """The width most line breaks agree with, and the share of those that do.

    A wrapper breaks a line of n characters before a word of w where n <= width < n + 1 + w.
    """
    steps: dict[int, int] = {}
    for n, w in pairs:
        steps[n] = steps.get(n, 0) + 1
        steps[n + w + 1] = steps.get(n + w + 1, 0) - 1
    best = width = held = 0
    for at in sorted(steps):
        held += steps[at]
        if held > best:
            best, width = held, at
    return width, best / len(pairs)


def _broken(bare: list[str], pairs: list[int]) -> bool:
    """Whether lines end inside sentences: some without a terminator before one that goes on in lower case."""
    open_ = [k for k in pairs if bare[k][-1] not in STOPS and bare[k][-1] not in CLOSERS]
    low = sum(1 for k in open_ if bare[k + 1][0].islower() or CASELESS.match(bare[k + 1]) or SHORT_END.search(bare[k]))
    return low > 0 and (len(pairs) > 3 and low * 4 >= len(open_) or len(open_) * 2 >= len(pairs))


class Automaton:
    """Ends of units in one text."""

    def __init__(self, text: str):
        self.text = text
        #: no letter case to go by: all in lower case
        self.flat = text.islower() and not text.isupper()
        self.caps = text.isupper()
        plain = text.isascii()
        # the scripts a third of the characters are of
        self.wide = not plain and len(WIDE.findall(text)) * 3 > len(text)
        self.thai, self.greek, self.deva = (not plain and not self.wide and len(x.findall(text)) * 3 > len(text) for x in (THAI, GREEK, DEVA))

        #: the lists that are open: indentation and kind of marker
        self.lists: list[tuple[int, str]] = []
        #: how many lists each unit lies in
        self.depths: list[int] = []

    def units(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for low, high in _blocks(self.text):
            self._list_level(low, high)
            if ROW.match(self.text, low, high):
                self._emit(out, low, high)
            else:
                self._run(out, low, high)
        return out

    def _list_level(self, low: int, high: int) -> None:
        """Open and close lists as the stretch's indentation and marker say.

        A marker of another kind opens a list inside the item above, unless a list of its kind is
        open there; text that stands no deeper than a marker ends its list.
        """
        indent = self._next(low, high) - low
        if not ITEM.match(self.text, low, high):
            while self.lists and self.lists[-1][0] >= indent:
                self.lists.pop()
            return
        m = MARKER.match(self.text, low, high)
        kind = m[1] + (m[2] or ("1" if m[3] else "a")) + m[5]
        while self.lists and self.lists[-1][0] > indent:
            self.lists.pop()
        if (indent, kind) in self.lists:
            while self.lists[-1] != (indent, kind):
                self.lists.pop()
        else:
            self.lists.append((indent, kind))

    def _emit(self, out: list[tuple[int, int]], a: int, b: int) -> None:
        t = self.text
        while a < b and t[a].isspace():
            a += 1
        while b > a and t[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
            self.depths.append(len(self.lists))

    def _run(self, out: list[tuple[int, int]], low: int, high: int) -> None:
        text = self.text
        start = self._next(low, high)
        # lists lie below: what closes, and where it was opened
        stack: list[tuple[str, int]] = [("", low)] * len(self.lists)
        base = len(stack)
        open_: dict[str, int] = {}  # how often each closing mark is due
        ahead: dict[str, int] = {}  # the next place of a closing mark
        self.turns = (start, start, 0)
        done = low
        m = ITEM.match(text, low, high)
        if m:  # the marker's own full stop
            done = m.end() - 1
        for mark in MARK.finditer(text, low, high):
            at = mark.start()
            if at < done:
                continue
            ch = text[at]
            if ch in STOPS:
                if len(stack) > base:
                    continue
                end = self._after(mark.end(), high)
                if self._ends(start, at, mark.end(), end, high):
                    end = self._beyond(start, end, high)
                    if end is None:
                        continue
                    self._emit(out, start, end)
                    start = done = self._next(end, high)
                else:
                    done = mark.end()
                continue
            if "฀" <= ch <= "๿" or ch in ")]”!?%" and len(mark[0]) > 1:
                closed = False
                if ch in ")]”" and len(stack) > base and stack[-1][0] == ch:
                    opened = self._pop(stack, open_)
                    closed = True
                if self.thai and len(stack) == base and self._thai_end(start, at, mark.end(), high):
                    self._emit(out, start, mark.end())
                    start = done = mark.end()
                    continue
                if ch not in ")]”" or closed is False and ch not in ")]”":
                    continue
                if closed:
                    end = self._closed(start, at, opened, high, ch) if len(stack) == base else None
                    if end:
                        self._emit(out, start, end)
                        start = done = self._next(end, high)
                continue
            top = stack[-1][0] if len(stack) > base else ""
            if ch == top:
                if ch == "’" and at + 1 < high and text[at + 1].isalpha() and at > low and text[at - 1].isalpha():
                    continue
                opened = self._pop(stack, open_)
                if len(stack) == base:
                    end = self._closed(start, at, opened, high, ch)
                    if end:
                        self._emit(out, start, end)
                        start = done = self._next(end, high)
                continue
            if open_.get(ch) and ch not in "’\"":
                while stack[-1][0] != ch:
                    self._pop(stack, open_)
                opened = self._pop(stack, open_)
                if len(stack) == base:
                    end = self._closed(start, at, opened, high, ch)
                    if end:
                        self._emit(out, start, end)
                        start = done = self._next(end, high)
                continue
            close = PAIRS.get(ch) or QUOTES.get(ch)
            if not close or not self._opens(ch, at, low, high):
                continue
            if not self._ahead(ahead, close, at, high) and not (ch == "„" and self._ahead(ahead, "”", at, high)):
                continue
            if ch == "„" and not self._ahead(ahead, "“", at, high):
                close = "”"
            if ch == "[" and NOTE.match(text, at):
                continue
            stack.append((close, at))
            open_[close] = open_.get(close, 0) + 1
        self._emit(out, start, high)

    def _pop(self, stack: list[tuple[str, int]], open_: dict[str, int]) -> int:
        close, opened = stack.pop()
        open_[close] -= 1
        return opened

    def _ahead(self, known: dict[str, int], close: str, at: int, high: int) -> bool:
        """Whether a mark comes later in the stretch; each place is looked for once."""
        if known.get(close, at) <= at:
            found = self.text.find(close, at + 1, high)
            known[close] = found if found >= 0 else len(self.text) + 1
        return known[close] < high

    def _opens(self, ch: str, at: int, low: int, high: int) -> bool:
        """Whether a mark that may stand for either side stands for the opening one here."""
        if ch in PAIRS:
            return True
        before = self.text[at - 1] if at > low else " "
        after = self.text[at + 1] if at + 1 < high else " "
        if ch in "«“„":
            return True
        if ch in "»\"‘‚‹":
            free = before.isspace() or before in "([{—–-«“„:.,。，：！？、" or WIDE.match(before)
            return bool(free) and not after.isspace()
        return False

    def _after(self, at: int, high: int) -> int:
        """The place behind closing marks without an opening one, and behind note marks."""
        text = self.text
        while at < high:
            if m := NOTE.match(text, at, high):
                at = m.end()
            elif text[at] in CLOSERS and text[at] not in "«“\"":
                at += 1
            elif text[at] in "\"“" and (at + 1 == high or text[at + 1].isspace()):
                at += 1
            else:
                break
        return at

    def _next(self, at: int, high: int) -> int:
        m = SPACE.match(self.text, at, high)
        return m.end() if m else at

    def _ends(self, start: int, at: int, stop: int, end: int, high: int) -> bool:
        """Whether the terminator at ``at`` .. ``stop`` ends the unit; ``end``: behind closing marks."""
        text = self.text
        ch = text[at]
        if end >= high:
            return True
        nxt = self._next(end, high)
        if nxt >= high:
            return True
        spaced = nxt > end
        follow = text[nxt]
        if ch == ";" and not (self.greek and spaced and at > start and "Ͱ" <= text[at - 1] <= "Ͽ" and not follow.islower()):
            return False
        if ch in WIDE_STOPS:
            return True
        last = text[stop - 1]
        if ch != "." or stop - at > 1 or end > stop:
            # several marks, or other than a full stop
            if not spaced:
                return bool(WIDE.match(follow)) or (end > stop and not follow.islower() and not follow.isdigit() and follow not in ",;:") or (ch in "!?…।" and (follow in "«“„¿¡»（「『《【" or self.wide and follow.isupper())) or ch in "।॥"
            if follow in ",;:)":
                return False
            if ch in "।॥؟۔":
                return True
            if follow in "—–-" and ch != "." and not self._dash_starts(start, nxt):
                return False
            if follow.islower() and not self._odd_start(nxt, high) and not self.flat:
                return False
            if self.flat and stop - at > 1 and ch in ".…":
                return False
            if CASELESS.match(follow) and text[at:stop] == "..." and at > start and not text[at - 1].isspace() and CASELESS.match(text[at - 1]) and not WIDE.match(text[at - 1]):
                return False
            if ch == "." and stop - at == 1:
                return self._full_stop(start, at, nxt, high, True)
            return True
        return self._full_stop(start, at, nxt, high, spaced)

    def _dash_starts(self, start: int, at: int) -> bool:
        """Whether a dash after a terminator begins a unit of its own."""
        text = self.text
        k = at + 1
        while k < len(text) and text[k] in " \xa0":
            k += 1
        return k < len(text) and (text[k].isupper() or text[k] in "¿¡") and text[start] not in "—–"

    def _odd_start(self, at: int, high: int) -> bool:
        """Words that begin a sentence in lower case: pH, a Greek letter before a hyphen, a lone symbol."""
        text = self.text
        a = text[at]
        b = text[at + 1] if at + 1 < high else " "
        if b.isupper() or "Ͱ" <= a <= "Ͽ" and not self.greek and b == "-":
            return True
        return a.isascii() and a.isalpha() and a not in ONE_LETTER and b == " "  # a symbol

    def _full_stop(self, start: int, at: int, nxt: int, high: int, spaced: bool) -> bool:
        text = self.text
        follow = text[nxt]
        before = text[at - 1] if at > start else " "
        if not spaced:
            if WIDE.match(follow):
                return before.isalpha() or before in CLOSERS or before.isdigit()
            if before.isalpha() and (at - start < 2 or text[at - 2].isalpha()):
                if (self.wide or self.thai) and (follow.isupper() or follow in "»«“„(") and (follow.isupper() is False or at - start > 3):
                    return TRIE.find(text, start, at)[0] == 0
                if self.wide and follow.isdigit():
                    m = re.match(r"\d+", text[nxt : nxt + 12])
                    return bool(m) and bool(WIDE.match(text[nxt + m.end() : nxt + m.end() + 1]))
            return False
        if follow in ",;:)":
            return False
        if before.isspace() and follow.isdigit():
            return False
        kind, from_ = TRIE.find(text, start, at)
        word_at = at
        while word_at > start and text[word_at - 1].isalpha():
            word_at -= 1
        word = text[word_at:at]
        if len(word) == 1 and word.isupper() and not self.caps and not WIDE.match(word) and (word_at == start or not text[word_at - 1].isalnum()):
            prior = text[word_at - 1] if word_at > start else " "
            if kind != MAYBE or prior != "." and not (from_ < word_at and text[from_].islower()):
                return False  # an initial
        if self.deva and "ऀ" <= before <= "ॿ":
            return False
        if "؀" <= before <= "ۿ" and len(word) == 1:
            return False
        if kind == NEVER or (len(word) == 1 and word.islower() or len(word) == 2 and word[0] == word[1] and word.isupper()) and PART.match(text, nxt, high):
            return False
        if before.isdigit():
            if NUMBER_ONLY.match(text, start, at):
                return False  # an enumerator
            head = WORD.findall(text[start : min(at, start + 40)])
            if head and head[0].lower() in CHAPTER and len(head) == 1:
                return False
            m = WORD.match(text, nxt, high)
            if m and m[0].lower() in MONTHS:
                return False
        if kind == BEFORE_NUMBER and (follow.isdigit() or follow in "IVXLC" or follow.islower() or len(word) == 1):
            return False
        if follow in "—–":
            return self._dialog(start, nxt, high)
        if follow.islower():
            if self._odd_start(nxt, high):
                return kind == 0
            return self.flat and kind == 0 and len(word) > 1
        if kind == MAYBE:
            if word.lower() in ("г", "гг", "в", "вв"):
                lead = text[max(start, word_at - 14) : word_at].rstrip()
                if not lead or not lead[-1].isdigit():
                    return False
                if IN_YEAR.match(text, start, word_at):
                    return False
            if not self.caps and CAPITALS.match(text, nxt, high):
                return False
            return not (self.caps and word.lower() in ("k", "s") and "." in text[max(start, at - 3) : at])
        return True

    def _dialog(self, start: int, dash: int, high: int) -> bool:
        """Whether a dash after a full stop begins another unit: in a dialogue the speech goes on after its attribution."""
        text = self.text
        k = self._next(dash + 1, high)
        if k < high and text[k].islower():
            return False
        if text[start] not in "—–":
            return True
        # speech, attribution, speech: the dashes so far tell which one ended
        _, upto, parts = self.turns if self.turns[0] == start else (start, start, 0)
        for m in TURN.finditer(text, upto, dash):
            upto, parts = m.end(), parts + 1
        self.turns = (start, upto, parts)
        return not (parts % 2 == 1 and k < high and "Ѐ" <= text[k] <= "ӿ")

    def _beyond(self, start: int, end: int, high: int) -> int | None:
        """The end of the unit, moved behind an attribution in dashes; None where the unit goes on."""
        text = self.text
        nxt = self._next(end, high)
        if nxt < high and text[nxt] in "—–" and text[start] in "—–":
            k = self._next(nxt + 1, high)
            if k < high and text[k].islower():
                return None
        return end

    def _closed(self, start: int, at: int, opened: int, high: int, ch: str) -> int | None:
        """The end of the unit if it ends with the closing mark at ``at``."""
        text = self.text
        inner = at - 1
        while inner > start and text[inner].isspace():
            inner -= 1
        if text[inner] not in STOPS or text[inner] == ";" and not self.greek:
            return None
        end = self._after(at + 1, high)
        nxt = self._next(end, high)
        if nxt >= high:
            return end
        follow = text[nxt]
        whole = self._next(start, opened) >= opened
        if follow in ",;:—–-.!?。，、)" or follow in "」』”»" or self._next(at + 1, high) < high and text[at + 1] in "，、":
            if not (follow in "—–" and self._dash_starts(start, nxt) and whole):
                return None
        if ch in ")]}）】":
            return end if whole else None
        if ch in "」』”" and (WIDE.match(follow) or self.thai or CASELESS.match(follow) or nxt == end):
            if follow == "と":
                return None
            if whole:
                stop = SAID_WIDE.search(text, nxt, high)
                return None if SPEECH.search(text, nxt, stop.start() + 1 if stop else high) else end
            lead = text[opened - 1] if opened > start else ""
            return end if lead in "：:，," or nxt > end else None
        if follow.islower() and not self._odd_start(nxt, high):
            return None
        if nxt == end and not WIDE.match(follow) and not (self.wide and follow.isupper()):
            return None
        if CASELESS.match(follow) and whole:
            stop = SAID.search(text, nxt, high)
            return None if SPEECH.search(text, nxt, stop.start() + 1 if stop else high) else end
        return end

    def _thai_end(self, start: int, at: int, after: int, high: int) -> bool:
        """Whether a space in a Thai text parts two units."""
        text = self.text
        if "฀" <= text[at] <= "๿" and TRIE.find(text, start, at + 1)[0] == NEVER:
            return False
        follow = text[after] if after < high else " "
        if follow in ",;:)]%—–-" or follow.isdigit():
            return False
        if text.startswith("ฯลฯ", after):
            return False
        return True


def list_depths(text: str) -> list[int]:
    """How many lists each unit of ``sentence_units`` lies in."""
    if not text or text.isspace():
        return []
    automaton = Automaton(text)
    automaton.units()
    return automaton.depths


def sentence_units(text: str) -> list[tuple[int, int]]:
    """Start and end of each unit of the text, in order; none for an empty or blank one."""
    return Automaton(text).units() if text and not text.isspace() else []


def split_sentences(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """doc_id, start_pos, end_pos of each sentence unit of ``docs`` (doc_id, text), in code points.

    Null, empty and blank texts have no unit. With a ``judge``, texts that are garbled by their
    encoding have none either. One pass without a shuffle; texts are read whole, and a very long one
    is still one row, whose work grows with its length. Repeated rows give repeated units; further
    columns aren't read.
    """

    def split(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, starts, ends = [], [], []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if not t or judge and is_garbled(t, judge):
                continue
            for a, e in sentence_units(t):
                ids.append(i)
                starts.append(a)
                ends.append(e)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start_pos": pa.array(starts, pa.int32()), "end_pos": pa.array(ends, pa.int32())})

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id bigint, start_pos int, end_pos int", split)
