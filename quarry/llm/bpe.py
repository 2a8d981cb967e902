"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word the encoding ends in one definite token. Among the vocabulary's tokens that are
suffixes of the prefix (all found in one pass of a suffix automaton), it is the one that stands alone or is
compatible with the last token of the prefix before it; two tokens are compatible if encoding their joined
bytes gives just these two. Following the back-pointers from the whole word gives its ids.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import regex

#: The vocabulary's published pattern for words.
WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACE_RUN = regex.compile(r" \s|\s | $")
MEMO = 1_000_000


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line)}


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (r, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.stands: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[list[int]] = []

    def merged(self, data: bytes) -> list[int]:
        """Encoding by merging the lowest-ranked neighbours; only for strings of one or two tokens."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        if token not in self.stands:
            self.stands[token] = self.merged(self.bytes_of[token]) == [token]
        return self.stands[token]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > MEMO:
                self.fits.clear()
            known = self.fits[pair] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None and self.alone(whole):
            return [whole]
        last, size, done = [-1] * (len(data) + 1), [0] * (len(data) + 1), -1
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            if end == done:
                continue
            before = end + 1 - n
            if self.alone(token) if before == 0 else self.compatible(last[before], token):
                last[end + 1], size[end + 1], done = token, n, end
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _segment(self, text: str) -> int:
        k = self.index.get(text)
        if k is None:
            out: list[int] = []
            for w in WORDS.findall(text):
                out += self.word(w)
            k = self.index[text] = len(self.ids)
            self.ids.append(out)
        return k

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[1].tolist()

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the concatenated ids; null and empty texts have none.

        A word never reaches over a blank that follows and precedes a non-blank, so texts without runs of
        white space are cut there, and each distinct segment is encoded once.
        """
        if len(self.index) > MEMO:
            self._reset()
        used, counts, index, segment = [], [], self.index, self._segment
        for t in texts:
            if not t:
                counts.append(0)
                continue
            n = len(used)
            for part in [t] if len(t) > 200_000 else WORDS_OR_LINES(t):
                k = index.get(part)
                used.append(segment(part) if k is None else k)
            counts.append(len(used) - n)
        lens = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        starts = np.concatenate([[0], np.cumsum(lens)])
        flat = np.fromiter((i for ids in self.ids for i in ids), np.int32, int(starts[-1]))
        use = np.array(used, np.int64)
        size = lens[use] if len(use) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - size, size) + np.repeat(starts[use] if len(use) else use, size)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return bounds.astype(np.int64), flat[at]


def WORDS_OR_LINES(text: str) -> list[str]:
    """Cut at single blanks where that can't change a word; otherwise into the pattern's own words."""
    if SPACE_RUN.search(text):
        return WORDS.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]
