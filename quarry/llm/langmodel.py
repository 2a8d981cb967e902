"""Language model of averaged hashed subword embeddings with a linear softmax, trained in numpy."""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
MEMO = 400_000


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of the word's letter sequences of 1 to 4, with its edges marked, and of the whole word."""
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)} | set(word)
    return [zlib.crc32(g.encode()) % buckets for g in sorted(grams)]


class LanguageModel:
    """scores: one row of class logits for each bucket (embedding times softmax weights, folded after training)."""

    def __init__(self, languages: list[str], scores: np.ndarray, temperature: float, floor: float):
        self.languages, self.scores, self.temperature, self.floor = languages, scores, temperature, floor
        self.buckets = len(scores)
        self.index: dict[str, int] = {}
        self._sums, self._n, self._stacked = [], [], None

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("languages", "scores", "temperature", "floor")}

    def __setstate__(self, state):
        self.__init__(**state)

    def _add(self, word: str) -> int:
        use = subwords(word, self.buckets)
        k = self.index[word] = len(self._sums)
        self._sums.append(self.scores[use].sum(0))
        self._n.append(len(use))
        self._stacked = None
        return k

    def logits(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every line, and its number of letters; lines without words have zeros."""
        if len(self.index) > MEMO:
            self.index, self._sums, self._n, self._stacked = {}, [], [], None
        used, counts, letters, index = [], [], [], self.index
        for line in lines:
            words = WORD.findall(line.lower())
            for w in words:
                k = index.get(w)
                used.append(self._add(w) if k is None else k)
            counts.append(len(words))
            letters.append(sum(map(len, words)))
        out = np.zeros((len(lines), len(self.languages)))
        if used:
            if self._stacked is None:
                self._stacked = np.array(self._sums, np.float32), np.array(self._n, np.float32)
            use, counts = np.array(used), np.array(counts)
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            sums = np.add.reduceat(self._stacked[0][use], starts, axis=0)
            n = np.add.reduceat(self._stacked[1][use], starts)
            out[some] = sums / n[:, None]
        return out, np.array(letters)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, str]], dim: int = 16, buckets: int = 1 << 15, epochs: int = 30, rate: float = 0.5, seed: int = 1) -> LanguageModel:
    """Fit on (text, language) pairs. Every fifth sample is held out; on these the softmax temperature is
    calibrated, and the rejection floor set to the confidence under which held-out pieces start to go wrong."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    known = {lang: k for k, lang in enumerate(languages)}

    def pieces(rows):
        out = []
        for text, lang in rows:
            words = WORD.findall(text.lower())
            for size in (len(words), 12, 6, 3):
                for a in range(0, max(1, len(words) - size + 1), max(1, size)):
                    if use := [s for w in words[a : a + size] for s in subwords(w, buckets)]:
                        out.append((np.array(use), known[lang]))
        return out

    held = pieces(samples[::5])
    fit = pieces([s for i, s in enumerate(samples) if i % 5])
    embed = rng.normal(0, 1 / dim, (buckets, dim))
    weight = np.zeros((dim, len(languages)))
    for epoch in range(epochs):
        order = rng.permutation(len(fit))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), 32):
            batch = [fit[i] for i in order[at : at + 32]]
            sizes = np.array([len(u) for u, _ in batch])
            use = np.concatenate([u for u, _ in batch])
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(embed[use], starts, axis=0) / sizes[:, None]
            z = mean @ weight
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), [y for _, y in batch]] -= 1
            back = p @ weight.T / sizes[:, None]
            weight -= step * mean.T @ p / len(batch) * 4
            np.add.at(embed, use, -step * 8 * np.repeat(back, sizes, axis=0))
    scores = (embed @ weight).astype(np.float32)
    z = np.array([scores[u].mean(0) for u, _ in held])
    y = np.array([y for _, y in held])

    def loss(t):
        q = z / t - (z / t).max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    model = LanguageModel(languages, scores, float(temperature), 0.0)
    p = model.probabilities(z)
    wrong = p.argmax(1) != y
    model.floor = float(np.quantile(p.max(1)[wrong], 0.9)) if wrong.any() else 0.5
    model.held_out = (len(y), float(1 - wrong.mean()))
    return model
