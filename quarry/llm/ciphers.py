"""Code-page swaps as substitution ciphers: candidate readings of a line and their likelihood by letter pairs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Code pages that text was read with, or should have been read with.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic", "iso8859-5", "cp1254", "iso8859-15", "cp932", "gbk")
MEANT = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1254", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic", "iso8859-5", "cp932", "euc-jp")

WIDE = ("cp932", "gbk", "euc-jp", "utf-8")
ALPHABET = 640
LOST = "�"
HIGH = re.compile(r"[^\x00-\x7f]+")
#: A question mark in a letter's place: what a reader writes for bytes it can't place.
GAP = re.compile(r"(?:(?<=\s)|^)\?(?=[^\W\d_])|(?<=[^\W\d_])\?(?=[^\W\d_])")
LINK = re.compile(r"\S*(?:://|\]\()\S*|\S+\?\S+=\S*")
MEMO = 200_000
CONTEXTS = 20_000
SWAPS = {f"{w}>{m}": k for k, (w, m) in enumerate((w, m) for w in READ_AS for m in MEANT if m != w and not (w in WIDE and m != "utf-8"))}
NAMES = list(SWAPS)


def to_bytes(run: str, page: str) -> bytes | None:
    """Bytes that give the run when read with the page; bytes the page doesn't define may stand as controls."""
    try:
        return run.encode(page)
    except UnicodeError:
        if not page.startswith("cp125"):
            return None
    out = bytearray()
    for ch in run:
        if "\x80" <= ch <= "\x9f":
            out.append(ord(ch))
            continue
        try:
            out += ch.encode(page)
        except UnicodeError:
            return None
    return bytes(out)


_readings: dict[str, dict[str, str]] = {}


def readings(run: str) -> dict[str, str]:
    """For each swap (page read with, page meant) the text the run should have been, if it can be one."""
    known = _readings.get(run)
    if known is None:
        if len(_readings) > MEMO:
            _readings.clear()
        known = {}
        for w in READ_AS:
            data = to_bytes(run, w)
            if data is None:
                continue
            for m in MEANT:
                if m == w or (w in WIDE and m != "utf-8"):
                    continue
                try:
                    text = data.decode(m)
                except UnicodeError:
                    continue
                if text != run and LOST not in text and not any(unicodedata.category(c) in ("Cc", "Co", "Cn") and c not in "\r\n\t" for c in text):
                    known[f"{w}>{m}"] = text
        _readings[run] = known
    return known


CONTROL = re.compile("[\x80-\x9f]")
HURT = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


@lru_cache(MEMO)
def _utf8_run(run: str) -> bool:
    return any(s.endswith(">utf-8") for s in readings(run))


def disguised(line: str) -> bool:
    """The line holds what can't have been meant: lost or control characters, or UTF-8 read with a code page."""
    if LOST in line or CONTROL.search(line):
        return True
    return any(len(run) > 1 and _utf8_run(run) for run in HIGH.findall(line))


def damaged(text: str) -> bool:
    """Characters were lost in a wrong reading, or left as controls."""
    if HURT.search(text):
        return True
    return "?" in text and any(GAP.search(LINK.sub(" ", line)) for line in text.split("\n") if "?" in line)


def line_reading(line: str, swap: str) -> str:
    """Every run of high characters that the swap can read is replaced."""
    return HIGH.sub(lambda m: readings(m[0]).get(swap, m[0]), line)


LEARNT = "learnt"


def translation(swap: str, runs: list[str], letters: dict[str, str]) -> dict[int, str] | None:
    """The swap as a table for str.translate, over the characters of the runs: what was learnt, else what the code
    pages say. None for multi-byte code pages."""
    if set(swap.split(">")) & set(WIDE):
        return None
    table = {ord(ch): text for ch in set("".join(runs)) if (text := readings(ch).get(swap)) is not None and len(text) == 1}
    return table | {ord(ch): text for ch, text in letters.items()}


def other_class(ch: str) -> int:
    if "\x80" <= ch <= "\x9f":
        return 0
    kind = unicodedata.category(ch)
    if kind[0] == "L":
        name = unicodedata.name(ch, "")
        return 1 if name.startswith("LATIN") else 2 if name.startswith("CYRILLIC") else 3 if name.startswith(("CJK", "HIRAGANA", "KATAKANA")) else 4
    return {"P": 5, "S": 6, "Z": 7}.get(kind[0], 8)


OTHER = 9


class LetterPairs:
    """Log-probabilities of letter pairs for each language, over an alphabet of bounded size."""

    def __init__(self, alphabet: list[str], languages: list[str], counts: np.ndarray):
        self.alphabet, self.languages, self.counts = alphabet, languages, counts
        self.index = {c: k + OTHER for k, c in enumerate(alphabet)}
        #: Letters of small alphabets that the counts of no language hold.
        small = np.array([False] * OTHER + [c > "\x7f" and other_class(c) in (1, 2) for c in alphabet])
        self.strange = small & (counts.sum((0, 1)) == 0)
        self._high: dict[int, list[str]] = {}
        self._code: dict[str, int] = {}
        self._chances: dict[int, np.ndarray] = {}
        self.table = np.full(0x110000, -1, np.int16)
        self.contexts: dict[tuple[str, str, str], tuple[np.ndarray, np.ndarray]] = {}
        single = counts.sum(1).astype(np.float64)
        p = (single + 0.05) / (single.sum(1, keepdims=True) + 0.05 * single.shape[1])
        ahead = counts.sum(2)[:, :, None]
        self.logp = np.log((counts + 6.0 * p[:, None, :]) / (ahead + 6.0)).astype(np.float32).transpose(1, 2, 0).copy()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("alphabet", "languages", "counts")}

    def __setstate__(self, state):
        self.__init__(**state)

    def encode(self, line: str) -> np.ndarray:
        """Codes of the line's letters, small, with a blank at either end."""
        points = np.frombuffer(f" {line} ".encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.table[points]
        if codes.min() < 0:
            for p in np.unique(points[codes < 0]).tolist():
                ch = chr(p).lower()[0]
                self.table[p] = self.index.get("0" if ch.isdigit() else ch, other_class(ch))
            codes = self.table[points]
        return codes

    def survey(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of many lines at once: codes, the first and last code of each line, and its likeliest language."""
        codes = self.encode("  ".join(lines))
        size = np.array([len(x) + 2 for x in lines])
        first = np.cumsum(size) - size
        found = self.logp[codes[:-1], codes[1:]]
        found[(first + size - 1)[:-1]] = 0.0
        return codes, first, first + size - 1, np.add.reduceat(found, first, axis=0).argmax(1)

    def count(self, lines: list[str], into: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds the letter pairs of the lines, each under its likeliest language, but for those with a strange letter;
        of these the numbers of the line, of the cell and of the letter are given back."""
        codes, first, last, best = self.survey(lines)
        inside = np.ones(len(codes) - 1, bool)
        inside[last[:-1]] = False
        line = np.repeat(np.arange(len(lines)), last - first + 1)[:-1]
        owner, a, b = best[line], codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        odd = inside & (self.strange[a] | self.strange[b])
        cells = (owner * into.shape[1] + a) * into.shape[2] + b
        np.add.at(into.reshape(-1), cells[inside & ~odd], 1)
        return line[odd], cells[odd], np.where(self.strange[a], a, b)[odd]

    def doubtful(self, lines: list[str], floor: float = -6.5) -> tuple[np.ndarray, np.ndarray]:
        """Which lines have a pair with a high character that is improbable in their likeliest language, and that language."""
        codes, first, last, best = self.survey(lines)
        high = np.frombuffer(f" {'  '.join(lines)} ".encode("utf-32-le", "surrogatepass"), "<u4") > 127
        at = np.flatnonzero(high[:-1] | high[1:])
        owner = np.searchsorted(first, at, side="right") - 1
        low = self.logp[codes[at], codes[at + 1], best[owner]] < floor
        return np.bincount(owner[low], minlength=len(lines)) > 0, best

    def score(self, line: str) -> np.ndarray:
        c = self.encode(line)
        return self.logp[c[:-1], c[1:]].sum(0) - 3.0 * case_slips(line)

    def proper(self, line: str, reading: str, floor: float = -6.5) -> bool:
        """Most high characters of the reading, those that differ if it is letter by letter, are likely after the one before."""
        c = self.encode(reading)
        best = int(self.logp[c[:-1], c[1:]].sum(0).argmax())
        same = len(line) == len(reading)
        at = [i for i, ch in enumerate(reading) if ch > "\x7f" and not (same and line[i] == ch)]
        return 2 * np.count_nonzero(self.logp[c[:-1], c[1:], best][at] >= floor) > len(at)

    def codes(self, letters: list[str]) -> np.ndarray:
        out = []
        for x in letters:
            if x not in self._code:
                self._code[x] = int(self.encode(x)[1])
            out.append(self._code[x])
        return np.array(out, np.int64)

    def pair_chances(self, lang: int) -> np.ndarray:
        if lang not in self._chances:
            self._chances[lang] = np.exp(self.logp[:, :, lang])
        return self._chances[lang]

    def high_letters(self, lang: int, most: int) -> list[str]:
        """The language's commonest letters outside ASCII."""
        if lang not in self._high:
            n = self.counts[lang].sum(0)
            order = sorted((-int(n[k]), c) for c, k in self.index.items() if c > "\x7f" and c.isalpha() and n[k])
            self._high[lang] = [c for _, c in order[:most]]
        return self._high[lang]

    def changes(self, before: str, run: str, after: str) -> tuple[np.ndarray, np.ndarray]:
        """Swaps that can read a run, and what each adds to the line's score in every language."""
        key = (before, run, after)
        known = self.contexts.get(key)
        if known is None:
            if len(self.contexts) > CONTEXTS:
                self.contexts.clear()
            own = self.local(before + run + after)
            swaps, rows, seen = [], [], {}
            lone = not (before.isalpha() or after.isalpha() or any(map(str.isalpha, run)))
            for swap, text in readings(run).items():
                if lone and any(map(str.isalpha, text)):
                    continue  # a sign that stands alone is no letter
                if text not in seen:
                    seen[text] = self.local(before + text + after) - own
                swaps.append(SWAPS[swap])
                rows.append(seen[text])
            known = self.contexts[key] = (np.array(swaps, np.int64), np.array(rows, np.float32).reshape(-1, len(self.languages)))
        return known

    def local(self, text: str) -> np.ndarray:
        c = self.encode(text)[1:-1]
        return self.logp[c[:-1], c[1:]].sum(0) - 3.0 * case_slips(text)


def stretches(lines: list, most: int = 100_000, text=lambda x: x):
    """The lines in lists of bounded size."""
    part, held = [], 0
    for x in lines:
        part.append(x)
        held += len(text(x)) + 2
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


def case_slips(line: str) -> int:
    """Capitals after small letters inside a word, high symbols between two letters, signs and numerals after one."""
    n, last = 0, len(line) - 1
    for m in HIGH.finditer(line):
        for i in range(*m.span()):
            ch, before, after = line[i], line[i - 1] if i else " ", line[i + 1] if i < last else " "
            if ch.isalpha():
                n += (ch.isupper() and before.islower()) + (ch.islower() and after.isupper())
            elif ch not in "’·" and before.isalpha() and (after.isalpha() or unicodedata.category(ch) in ("No", "So", "Sm")):
                n += 1
    return n


def touches_letter(line: str) -> bool:
    """Some run of high characters stands next to a plain letter."""
    return re.search(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]", line) is not None


def gains(model: LetterPairs, line: str) -> np.ndarray:
    """What each swap's reading gains over the line as it stands, each in its likeliest language.

    A line whose high characters all stand alone says little about letters, so its gain counts half.
    """
    own = model.score(line)
    weight = 1.0 if touches_letter(line) or len("".join(HIGH.findall(line))) > 0.3 * len(line) else 0.5
    total = np.zeros((len(SWAPS), len(own)), np.float32)
    padded = f" {line} "
    for m in HIGH.finditer(padded):
        swaps, added = model.changes(padded[m.start() - 1], m[0], padded[m.end()])
        total[swaps] += added
    return weight * ((own[None] + total).max(1) - own.max())


def best_reading(model: LetterPairs, line: str, least: float = 2.5):
    """[(swap, gain)] of readings likelier than the line as it stands by at least `least`, likeliest first."""
    if line.isascii():
        return []
    gain = gains(model, line)
    good = [(NAMES[k], float(gain[k])) for k in np.flatnonzero(gain >= least).tolist()]
    return sorted(good, key=lambda x: (-round(x[1], 3), SWAPS[x[0]]))


def suspicion(model: LetterPairs, line: str, least: float) -> tuple[str | None, bool]:
    """(swap, sure): the likeliest swap that reads better than the line, null if none does; sure if it gains `least`
    and makes proper letters of what it changes."""
    found = best_reading(model, line, 0.1)
    for swap, gain in found:
        if gain >= least and model.proper(line, line_reading(line, swap)):
            return swap, True
    return (found[0][0], False) if found else (None, False)
