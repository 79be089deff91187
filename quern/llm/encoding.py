"""Text that was decoded with the wrong character encoding.

For pairs (true encoding, wrong encoding) the garbled forms are computed from the codecs themselves and put into one
multi-pattern automaton. A text is scanned once; where a pattern stands in the right surroundings the span is replaced
by what it was, and nothing else is touched, so correct text beside it stays. Spans that were garbled several times
come out by scanning again, until nothing is found.

Kinds of pair, by what can be told:

* *UTF-8 read with a single-byte encoding* (``WRONG``). One character became two to four, in combinations that don't occur
  in writing. Characters of two and three bytes of the common repertoire are patterns themselves. All others – every
  script, and characters of four bytes – come by rule: the patterns are the first two characters of their garbled forms, and
  what follows must complete the bytes of one character. They count where several stand together, four bytes also alone.
* *UTF-8 read with a multi-byte encoding* (``WIDE``). Letters became ideographs, kana or Hangul; they count beside Latin letters
  or where a whole run turns into one other script, and only if the text has no such character that doesn't turn.
* *one single-byte encoding read with another* (``SINGLE``). One character became one, which shows only by its
  neighbours: a Cyrillic or Greek letter, a symbol, or a capital, inside a word in Latin letters. Which pair it
  was is decided by the word, then by the line and the text.
* *Cyrillic encodings for each other* (``CYRILLIC``): small letters became capitals and the other way round.
* *a multi-byte encoding read as a single-byte one* (``BYTES``): runs of accented letters and symbols that are ideographs or
  Hangul of the common range, pair by pair.

Characters lost on the way (U+FFFD inside words, combinations cut short) can't be restored, nor can a span that two
encodings explain differently and equally well; the text is reported with ``restored`` false. Garbled characters quoted on
purpose – in quotation marks that are themselves intact, or standing alone for what is being spoken of – are no case.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings with which UTF-8 is wrongly read, the likelier first (parameter of the tables).
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "iso8859_15", "iso8859_2", "cp1253", "koi8_r", "cp866", "cp852")
#: Pairs of single-byte encodings: (true, wrong).
SINGLE = tuple((t, w) for t in ("cp1252", "mac_roman", "cp850", "cp437") for w in ("cp1251", "cp437", "mac_roman", "cp850", "cp1252", "cp1250", "koi8_r", "cp866") if t != w)
#: Multi-byte encodings with which UTF-8 is wrongly read; Cyrillic pairs (true, wrong); multi-byte encodings read as a
#: single-byte one: (true, wrong).
WIDE = ("gbk", "big5", "cp932", "cp949")
CYRILLIC = (("koi8_r", "cp1251"), ("cp1251", "koi8_r"))
BYTES = tuple((t, w) for t in ("gbk", "euc_kr") for w in ("latin-1", "cp1252"))

#: Characters (ranges) whose garbled forms are looked for.
_REPERTOIRE = ((0x80, 0x180), (0x192, 0x193), (0x2BC, 0x2BD), (0x2C6, 0x2C8), (0x2D8, 0x2DE), (0x370, 0x400), (0x400, 0x460), (0x900, 0x980), (0x2010, 0x2040), (0x20A0, 0x20C0), (0x2116, 0x2117), (0x2122, 0x2123), (0x2190, 0x2194), (0x2200, 0x2270), (0x2310, 0x2322), (0x2500, 0x25A1), (0xFB01, 0xFB03), (0xFFFD, 0xFFFE))
#: Letters expected in words that were garbled one to one.
_LETTERS = "éèêëàâäáãåçñöôóòõœßüùúûîïíìÉÈÊÀÂÄÁÃÅÇÑÖÔÓÕÜÚÛÎÍØøæÆšžŠŽÿć"
#: Punctuation restored on lines that a single-byte pair has been found for.
_MARKS = "“”„‘’‚–—«»•…"
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")
_OPEN, _CLOSE = "“‘\"'«‹„‚(`", "”’\"'»›“‘)`"
#: Question marks in the place of characters that the wrong encoding lacked; looked for where it garbled others.
_ASKED = re.compile(r"(?<![^\s(|])\?(?=\d)|(?<=[a-zß-ÿ])\?(?=[a-zß-ÿ:;,)|])")
#: Words with which a text speaks of a character (fixed list).
_SPEAKING = re.compile(r"(?i)\b(writes?|shows?|prints?|displays?|sign|symbol|character|glyph|zeichen|schreibt|zeigt|caract[eè]re|signe|affiche|escribe|muestra|signo|car[aá]cter|चिह्न|अक्षर)\b")


def read_as(data: bytes, encoding: str) -> str | None:
    """``data`` decoded with a single-byte encoding; bytes it leaves undefined come out as control characters, as
    browsers do it for the Windows encodings. None where another encoding has no such character."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            if not encoding.startswith("cp125"):
                return None
            out.append(chr(b))
    return "".join(out)


def written_in(char: str, encoding: str) -> bytes | None:
    try:
        return char.encode(encoding)
    except UnicodeEncodeError:
        return bytes([ord(char)]) if encoding.startswith("cp125") and 0x80 <= ord(char) <= 0x9F else None


def _script(char: str) -> str:
    """The script of a character, as its name begins; empty for what is unassigned, private or a control."""
    if unicodedata.category(char) in ("Cn", "Co", "Cs", "Cc"):
        return ""
    name = unicodedata.name(char, "")
    word = name.split(" ")[0].split("-")[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK", "IDEOGRAPHIC": "CJK", "FULLWIDTH": "CJK"}.get(word, word)


class Tables:
    """Garbled forms, made by rule from the codecs."""

    def __init__(self):
        common = [range(a, b) for a, b in _REPERTOIRE]
        self.common = frozenset(chr(c) for r in common for c in r)
        self.bytes_of = {w: {seen: n for n in range(0x80, 0x100) if (seen := read_as(bytes([n]), w))} for w in WRONG}
        heads: dict[str, list[str]] = {}  # the first two characters of a garbled form -> wrong encodings
        for wrong in WRONG:
            for lead in range(0xC6, 0xF5):
                for cont in range(0x80, 0xC0):
                    seen = read_as(bytes([lead, cont]), wrong)
                    if seen:
                        heads.setdefault(seen, []).append(wrong)
        self.heads = heads
        #: Every pattern lies within a run of characters that stand for bytes from 128 on; the others needn't be scanned.
        high = {c for table in self.bytes_of.values() for c in table}
        self.run = re.compile("[" + "".join(re.escape(c) for c in sorted(high)) + "]{2,}|\ufffd")
        self.multi: dict[str, dict[str, str]] = {}  # garbled -> {wrong encoding: character}
        for a, b in _REPERTOIRE:
            for c in range(a, b):
                char = chr(c)
                for wrong in WRONG:
                    seen = read_as(char.encode(), wrong)
                    if seen and seen != char and not seen.isascii():
                        self.multi.setdefault(seen, {})[wrong] = char
        self.cut: set[str] = set()  # first two of three: what is left when the last byte was dropped
        for char in "’₹कऀि":
            for wrong in ("cp1252", "mac_roman", "cp437", "cp850"):
                seen = read_as(char.encode(), wrong)
                if seen and len(seen) == 3:
                    self.cut.add(seen[:2])
        self.automaton = ahocorasick.Automaton()
        for s in self.multi:
            self.automaton.add_word(s, s)
        for s in self.cut:
            if s not in self.multi:
                self.automaton.add_word(s, s)
        for s in self.heads:
            if s not in self.multi and s not in self.cut:
                self.automaton.add_word(s, s)
        self.automaton.add_word("�", "�")
        self.automaton.make_automaton()
        self.single: dict[tuple[str, str], dict[str, str]] = {}
        for true, wrong in SINGLE:
            table = {}
            for char in _LETTERS:
                data = written_in(char, true)
                seen = read_as(data, wrong) if data else None
                if seen and seen != char and not seen.isascii():
                    table[seen] = char
            self.single[true, wrong] = table
        self.marks: dict[tuple[str, str], dict[str, str]] = {}
        for true, wrong in SINGLE:
            data = {m: written_in(m, true) for m in _MARKS}
            self.marks[true, wrong] = {seen: m for m, x in data.items() if x and (seen := read_as(x, wrong)) and seen != m and not seen.isascii()}
        odd = {c for t in self.single.values() for c in t}
        strange = {c for c in odd if not _LATIN.match(c)}
        capital = {c for c in odd if c.isupper() and _LATIN.match(c)}
        letters = "A-Za-zß-öø-ÿāăąćčďđēęěğıłńňőœřśşšťůűźżž"
        cls = lambda s: "[" + "".join(re.escape(c) for c in sorted(s)) + "]"
        cyrillic = {c for c in strange if _CYRILLIC.match(c)}
        other = {c for c in strange if c.isalpha()} - cyrillic
        #: Symbols that stand inside words in correct text, and quotation marks and dashes that may.
        plain = set("·…–—-’‘“”„«»‹›/×°•\xa0\xad€$%§©®™")
        symbols = {c for c in strange if not c.isalpha()} - plain
        self.weak = strange & plain
        self.odd_char = re.compile(cls(cyrillic | other | symbols | capital))
        self.odd = ahocorasick.Automaton()
        for c in cyrillic | other | symbols | capital:
            self.odd.add_word(c, c)
        self.odd.make_automaton()
        self.odd_word = re.compile(
            rf"(?<=[{letters}]){cls(cyrillic | other)}|{cls(cyrillic)}(?=[a-zß-ÿ])|(?<=[{letters}]){cls(symbols)}(?=[a-zß-ÿ])|(?<=[a-zß-ÿ]{{2}}){cls(capital)}(?![A-Z])"
        )


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


_OPENING, _CLOSING = re.compile(rf"[\s{re.escape(_OPEN)}]"), re.compile(rf"[\s{re.escape(_CLOSE)}]")


class _Stops:
    """Where words of a text begin and end: at white space and quotation marks."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def open(self) -> list[int]:
        return [m.start() for m in _OPENING.finditer(self.text)]

    @cached_property
    def close(self) -> list[int]:
        return [m.start() for m in _CLOSING.finditer(self.text)]

    def quoted(self, start: int, end: int) -> bool:
        """Whether a span is named rather than used: its word stands alone between intact quotation marks."""
        a, b = bisect_left(self.open, start) - 1, bisect_left(self.close, end)
        if a < 0 or b >= len(self.close):
            return False
        before, after = self.text[self.open[a]], self.text[self.close[b]]
        return before in _OPEN and after in _CLOSE and before != "("

    def line(self, start: int, end: int) -> str:
        stop = self.text.find("\n", end)
        return self.text[self.text.rfind("\n", 0, start) + 1 : stop if stop >= 0 else len(self.text)]


def _allowed(text: str, start: int, end: int, seen: str, wrong: str) -> bool:
    """Whether the surroundings admit that this combination is garbled rather than written."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if wrong in ("cp1251", "koi8_r", "cp866", "cp1253"):
        if len(seen) > 2:  # inside a word no capital follows a small letter
            return not seen.isalpha() or seen[0].islower() and any(c.isupper() for c in seen[1:])
        left, right = text[max(0, start - 3) : start].rstrip()[-1:], text[end : end + 3].lstrip()[:1]
        if not seen.isalpha() and _LATIN.match(left) and _LATIN.match(right):
            return True
        return bool(_LATIN.match(before) or _LATIN.match(after)) and not (_CYRILLIC.match(before) and _CYRILLIC.match(after))
    if len(seen) == 2 and seen[1] in "“”‘’„‚«»‹›" and (before in [*"“‘«„‚‹\"'("] or seen[0] not in "ÃÂ" and not before.strip()):
        return False  # a single capital between quotation marks
    if len(seen) == 2 and seen.isalpha() and seen[1].islower() == seen[0].islower() and not (_LATIN.match(before) or _LATIN.match(after) or ord(seen[0]) > 0x250):
        return seen[0] in "ÃÂÅÄ"
    return True


def _ruled(text: str, start: int) -> dict[str, tuple[int, str]]:
    """What stands at ``start`` by the rule of bytes: wrong encoding -> (end, character), characters of the common repertoire
    apart."""
    t, out = tables(), {}
    for wrong in t.heads.get(text[start : start + 2], ()):
        table = t.bytes_of[wrong]
        lead = table[text[start]]
        width = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            char = bytes(table.get(c, 0) for c in text[start : start + width]).decode()
        except UnicodeDecodeError:
            continue
        if len(char) == 1 and char not in t.common and _script(char):
            out[wrong] = start + width, char
    return out


def _chains(spans: list[tuple[int, int, str]]) -> list[list[tuple[int, int, str]]]:
    """Spans that follow each other without a gap, their characters being of one script."""
    chains: list[list[tuple[int, int, str]]] = []
    for s in spans:
        if chains and chains[-1][-1][1] == s[0] and _script(chains[-1][-1][2]) == _script(s[2]):
            chains[-1].append(s)
        elif not chains or s[0] >= chains[-1][-1][1]:
            chains.append([s])
    return chains


def multi_spans(text: str) -> list[tuple[int, int, dict[str, str] | None]]:
    """Spans of multi-byte pairs: start, end, and what they can stand for (None: cut short or lost).

    A candidate counts if its surroundings admit it. Those that could be writing as well count where three letters of one
    script follow each other, as no language has that, and in lines in which the same encoding has garbled more.
    """
    t = tables()
    found: list[tuple[int, int, str, dict[str, str] | None]] = []
    votes: Counter = Counter()
    doubtful: dict[str, list[tuple[int, int, str]]] = {}  # wrong encoding -> candidates that may be writing
    ruled: dict[str, list[tuple[int, int, str]]] = {}  # the same, by the rule of bytes

    def take(wrong: str, spans: list[tuple[int, int, str]]) -> None:
        votes[wrong] += sum(b - a for a, b, _ in spans)
        found.extend((a, b, text[a:b], {wrong: c}) for a, b, c in spans)

    for last, seen in (hit for run in t.run.finditer(text) for hit in t.automaton.iter(text, *run.span())):
        start, end = last + 1 - len(seen), last + 1
        if seen in t.heads:
            for wrong, (stop, char) in _ruled(text, start).items():
                ruled.setdefault(wrong, []).append((start, stop, char))
        if seen == "�":
            found.append((start, end, seen, None))
            continue
        all_options = t.multi.get(seen, {})
        options = {w: c for w, c in all_options.items() if _allowed(text, start, end, seen, w)}
        for wrong in all_options.keys() - options.keys():
            doubtful.setdefault(wrong, []).append((start, end, all_options[wrong]))
        if options:
            votes.update({w: len(seen) for w in options})
            found.append((start, end, seen, options))
        elif seen in t.cut:
            found.append((start, end, seen, None))
    for wrong, spans in doubtful.items():
        for chain in _chains([s for s in spans if s[2].isalpha()]):
            if len(chain) >= 3:
                take(wrong, chain)
    for wrong, spans in ruled.items():
        for chain in _chains(spans):
            fit = sum(_allowed(text, a, b, text[a:b], wrong) for a, b, _ in chain)
            if len(chain) >= 3 or len(chain) == fit == 2 or chain[0][1] - chain[0][0] == 4:
                take(wrong, chain)
            else:
                doubtful.setdefault(wrong, []).extend(chain)
    if votes and doubtful:
        feeds = [m.start() for m in re.finditer("\n", text)]
        in_line: Counter = Counter()
        for start, _, _, options in found:
            in_line.update((bisect_left(feeds, start), w) for w in options or ())
        there = {(x[0], x[1]) for x in found if x[3]}
        for wrong, spans in doubtful.items():
            take(wrong, [s for s in spans if in_line[bisect_left(feeds, s[0]), wrong] >= 2 and (s[0], s[1]) not in there])
    # Where spans overlap, the encoding that explains most of the text comes first, and the longer of its spans.
    rank = {w: (-votes[w], i) for i, w in enumerate(WRONG)}
    place = lambda x: (min(rank[w] for w in x[3]) if x[3] else (0, len(WRONG)), x[0] - x[1], x[0])
    taken = bytearray(len(text))
    spans: dict[tuple[int, int], dict[str, str] | None] = {}
    for start, end, _, options in sorted(found, key=place):
        if (start, end) in spans:  # the same span by another encoding
            spans[start, end] = {**(options or {}), **(spans[start, end] or {})} or None
        elif not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            spans[start, end] = options
    return [(a, b, options) for (a, b), options in sorted(spans.items())]


#: Ideographs, kana, Hangul and what multi-byte encodings hold beside them.
_WIDE_RUN = re.compile(r"[\u2E80-\u9FFF\uAC00-\uD7A3\uF900-\uFAFF\uFF00-\uFFEF\uE000-\uF8FF]+")
_LATIN_TEXT = re.compile(r"[\u00A0-\u024F\u2010-\u203A\u20A0-\u20BF\u2122A-Za-z]+")


def wide_spans(text: str) -> list[tuple[int, int, dict[str, str]]]:
    """Runs that a multi-byte encoding made of UTF-8; none if some run of the text is no such one."""
    runs = [m.span() for m in _WIDE_RUN.finditer(text)]
    if not runs:
        return []
    for wrong in WIDE:
        spans, sure, scripts = [], False, set()
        for a, b in runs:
            try:
                was = text[a:b].encode(wrong).decode()
            except (UnicodeEncodeError, UnicodeDecodeError):
                break
            scripts |= {_script(c) for c in was if c.isalpha()}
            if len(scripts) > 1 or scripts & {"CJK", "HANGUL", ""} or scripts == {"LATIN"} and not _LATIN_TEXT.fullmatch(was):
                break
            beside = _LATIN.match(text[a - 1 : a]) or _LATIN.match(text[b : b + 1])
            sure |= bool(beside) if scripts <= {"LATIN"} else len(was) >= 3
            spans.append((a, b, {wrong: was}))
        if sure and len(spans) == len(runs):
            return spans
    return []


_HIGH_RUN = re.compile(r"[\u00A1-\u00FF\u0152-\u0178\u017D\u017E\u0192\u02C6\u02DC\u2013-\u203A\u20AC\u2122]{4,}")


def _is_utf8(run: str) -> bool:
    """Whether some single-byte encoding has the bytes of UTF-8 for a run."""
    for table in tables().bytes_of.values():
        try:
            bytes(table.get(c, 0xFF) for c in run).decode()
            return True
        except UnicodeDecodeError:
            pass
    return False


def byte_spans(text: str) -> list[tuple[int, int, dict[tuple[str, str], str]]]:
    """Runs of accented letters and symbols that are common ideographs or Hangul, pair by pair; four such characters at
    least in the text, and symbols among them, as a list of accented letters has none."""
    spans = []
    for m in _HIGH_RUN.finditer(text):
        options: dict[tuple[str, str], str] = {}
        if _is_utf8(m[0]):
            continue
        for true, wrong in BYTES:
            try:
                data = m[0].encode(wrong)
                was = data.decode(true)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            top = 0xC8 if true == "euc_kr" else 0xD7
            common = [0xB0 <= x <= top for x in data[::2]]
            fit = all(ok or x <= 0xA3 for ok, x in zip(common, data[::2])) and sum(common) >= 0.6 * len(common) and all(x >= 0xA1 for x in data[1::2])
            if len(was) * 2 == len(data) and fit and was not in options.values():
                options[true, wrong] = was
        if options and any(not c.isalpha() for c in m[0]):
            spans.append((m.start(), m.end(), options))
    return spans if sum(b - a for a, b, _ in spans) >= 8 else []


_SWAPPED = re.compile(r"(?<![Ѐ-ӿ])[а-яё][А-ЯЁ]{2,}(?![Ѐ-ӿ])")
_CAPITALS = re.compile(r"[А-ЯЁ]{2,}")
_VOWELS = frozenset("аеёиоуыэюя")


def cyrillic_lines(text: str) -> list[tuple[int, int, str]]:
    """Lines in which small and capital letters are swapped, as one Cyrillic encoding makes of another: start, end, the
    line as it was. The pair whose words have the vowels of a language is the one."""
    out, at = [], 0
    if not _SWAPPED.search(text):
        return []
    for line in text.split("\n"):
        if _SWAPPED.search(line) and len("".join(_CAPITALS.findall(line))) > 0.6 * sum(c.isalpha() for c in line):
            rated = []
            for true, wrong in CYRILLIC:
                try:
                    was = line.encode(wrong).decode(true)
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                letters = [c for c in was.lower() if _CYRILLIC.match(c)]
                share = sum(c in _VOWELS for c in letters) / max(1, len(letters))
                if 0.3 <= share <= 0.6 and not _SWAPPED.search(was):
                    rated.append((abs(share - 0.42), was))
            if rated:
                out.append((at, at + len(line), min(rated)[1]))
        at += len(line) + 1
    return out


def single_spans(text: str) -> list[tuple[int, int, dict[tuple[str, str], str]]]:
    """Words garbled one to one: start, end, and the word as each pair of encodings would have it."""
    t = tables()
    spans: list[tuple[int, int, dict]] = []
    if not t.odd_char.search(text):
        return spans
    for last, _ in t.odd.iter(text):
        if spans and last < spans[-1][1] or not (hit := t.odd_word.match(text, last)):
            continue
        a, b = hit.start(), hit.end()
        while a > 0 and not text[a - 1].isspace() and text[a - 1] not in "“\"(-|":
            a -= 1
        while b < len(text) and not text[b].isspace() and text[b] not in "”\")-|":
            b += 1
        word = text[a:b]
        options = {}
        for pair, table in t.single.items():
            out = "".join(table.get(c, c) for c in word)
            if out == word or t.odd_word.search(out) or any(not _LATIN.match(c) and c.isalpha() for c in out):
                continue
            # Capitals only where capitals can be.
            if any(x.islower() and y.isupper() and not y.isascii() for x, y in zip(out, out[1:])):
                continue
            options[pair] = out
        if options:
            spans.append((a, b, options))
    return spans


def _real(text: str, stops: _Stops, start: int, end: int, lost: bool) -> bool:
    """Whether a span is a case: not quoted and, if it is only a lost character, not one that is spoken of."""
    if stops.quoted(start, end):
        return False
    if lost and text[start:end] == "�":
        near = text[start - 1 : start] + text[end : end + 1]
        if not near.strip():
            return not _SPEAKING.search(stops.line(start, end))
    return True


def _marks_restored(line: str, marks: dict[str, str], letters: dict[str, str]) -> str:
    """What else a line garbled one to one holds: letters where only quotation marks, dashes and bullets can stand,
    and marks between two letters."""
    out = []
    for i, c in enumerate(line):
        before, after = line[i - 1 : i] or " ", line[i + 1 : i + 2] or " "
        alone = before.isspace() and (after.isspace() or after.isupper())
        closing = not after.isalnum() and (before in ".,;!?" or not c.isalpha() and before.isalnum())
        within = not c.isalpha() and c in letters and _LATIN.match(before) and _LATIN.match(after) and after.islower()
        out.append(letters[c] if within else marks[c] if c in marks and (alone or closing) else c)
    return "".join(out)


def _replaced(text: str, find) -> tuple[str, int, int]:
    """The text with what ``find`` finds replaced, the number of spans, and that of those with several readings."""
    stops = _Stops(text)
    spans = [s for s in find(text) if _real(text, stops, s[0], s[1], False)]
    for start, end, options in reversed(spans):
        text = text[:start] + next(iter(options.values())) + text[end:]
    return text, len(spans), sum(len(set(options.values())) > 1 for _, _, options in spans)


def restore(text: str) -> tuple[str, int, int]:
    """``(text, spans restored, spans lost)``; the text itself and zeros where nothing is garbled."""
    fixed = lost = unsure = 0
    text, n, m = _replaced(text, byte_spans)
    fixed, unsure = fixed + n, unsure + m
    while True:  # each time the text gets shorter
        stops = _Stops(text)
        spans = [s for s in multi_spans(text) if _real(text, stops, s[0], s[1], s[2] is None)]
        usable = [s for s in spans if s[2]]
        lost = len(spans) - len(usable)
        if not usable:
            break
        votes = Counter(w for _, _, options in usable for w in options)
        rank = {w: (-votes[w], i) for i, w in enumerate(WRONG)}
        out, at = [], 0
        for start, end, options in usable:
            best = min(options, key=rank.__getitem__)
            # Another encoding that explains as much of the text says otherwise.
            unsure += any(votes[w] == votes[best] and c != options[best] for w, c in options.items())
            out += [text[at:start], options[best]]
            at = end
        text = "".join(out) + text[at:]
        fixed += len(usable)
    text, n, m = _replaced(text, wide_spans)
    fixed, unsure = fixed + n, unsure + m
    swapped = cyrillic_lines(text)
    for start, end, was in reversed(swapped):
        text = text[:start] + was + text[end:]
    fixed += len(swapped)
    stops = _Stops(text)
    singles = [s for s in single_spans(text) if _real(text, stops, s[0], s[1], False)]
    if singles:
        everywhere = Counter(p for _, _, options in singles for p in options)
        feeds = [m.start() for m in re.finditer("\n", text)]
        line_of = lambda start: bisect_left(feeds, start)
        lines: dict[int, Counter] = {}
        for start, _, options in singles:
            lines.setdefault(line_of(start), Counter()).update(list(options))
        place = {p: i for i, p in enumerate(SINGLE)}
        out, at = [], 0
        chosen: dict[int, tuple[str, str]] = {}
        for start, end, options in singles:
            number = line_of(start)
            line = lines[number]
            pair = min(options, key=lambda p: (-line[p], -everywhere[p], place[p]))
            chosen.setdefault(number, pair)
            out += [text[at:start], options[pair]]
            at = end
        text = "".join(out) + text[at:]
        fixed += len(singles)
        lost += len(_ASKED.findall(text))
        rows = text.split("\n")
        for number, pair in chosen.items():
            rows[number] = _marks_restored(rows[number], tables().marks[pair], tables().single[pair])
        text = "\n".join(rows)
    return text, fixed, lost + unsure


_SCHEMA = "doc_id long, n_restored int, n_lost int, restored boolean, text string"


def _repair(batches):
    for b in batches:
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if text.isascii():
                continue
            out, fixed, lost = restore(text)
            if fixed or lost:
                rows.append((doc, fixed, lost, lost == 0, out))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_restored", "n_lost", "restored", "text"])


def garbled(documents: DataFrame) -> DataFrame:
    """Documents of which some part was decoded wrongly: ``doc_id, n_restored, n_lost, restored, text``.

    ``text`` is the document with every span replaced that could be; ``n_lost`` counts what could not, and
    ``restored`` is true if that is nothing. Rows with a null id or text give nothing, an empty text is correct;
    rows come out as often as they go in, and other columns are ignored. Texts are taken whole, however long.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return texts.mapInArrow(_repair, _SCHEMA)
