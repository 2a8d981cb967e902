"""Word shingles as 64-bit hashes, in batches of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

TOKEN = re.compile(r"\w+")
MEMO = 2_000_000
_codes: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def text_key(words: list[str]) -> int:
    """Signed 64-bit key of a token sequence."""
    k = xxhash.xxh3_64_intdigest("\n".join(words).encode())
    return k - (1 << 64) if k >> 63 else k


def batch_shingles(token_lists: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every distinct shingle of n words, sorted by text and hash."""
    if len(_codes) > MEMO:
        _codes.clear()
    flat: list[int] = []
    get = _codes.get
    for words in token_lists:
        for w in words:
            c = get(w)
            if c is None:
                c = _codes[w] = xxhash.xxh3_64_intdigest(w.encode())
            flat.append(c)
    sizes = np.fromiter(map(len, token_lists), np.int64, len(token_lists))
    code = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(code) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - n + 1 + k])
    inside = owner[: len(h)] == owner[n - 1 :]
    h, owner = h[inside], owner[: len(h)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]
