"""Line features of crawled pages and the model that tells lines of the site from lines of the article."""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import numpy as np

SITE = "⌂"
LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
SEPARATOR = re.compile(r"\s[|·•/>–-]\s|\s{2,}")
BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
HEADING = re.compile(r"^\s*#{1,6}\s")
TABLE = re.compile(r"^\s*\|.*\|\s*$")
END = re.compile(r"[.!?…:;。！？][\"'”’»“)\]]*\s*$")
WORD = re.compile(r"[^\W_]+|⌂|[|·•/>©:–?!]")
BITS = 17


class LineEvents(HTMLParser):
    """Streams a page's parser events and keeps, for each line, characters of text and the number of tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: dict[int, int] = {}
        self.tags: dict[int, int] = {}

    def _at(self, table: dict[int, int], n: int) -> None:
        row = self.getpos()[0] - 1
        table[row] = table.get(row, 0) + n

    def handle_starttag(self, tag, attrs):
        self._at(self.tags, 1)

    def handle_endtag(self, tag):
        self._at(self.tags, 1)

    def handle_data(self, data):
        row = self.getpos()[0] - 1
        for k, part in enumerate(data.split("\n")):
            self.text[row + k] = self.text.get(row + k, 0) + len(part.strip())


def text_to_tag(content: str) -> list[float]:
    """Characters of text for each tag of every line; links and separators of plain-text pages count as tags."""
    if "<" not in content and "&" not in content and "](" not in content:  # no event but text
        return [len(x) / (1 + (0 if TABLE.match(x) else len(SEPARATOR.findall(x)))) for x in map(str.strip, content.split("\n"))]
    marked = LINK.sub(lambda m: f"<a>{m[1]}</a>", content) if "](" in content else content
    parser = LineEvents()
    parser.feed(marked)
    parser.close()
    out = []
    for k, line in enumerate(content.split("\n")):
        tags = parser.tags.get(k, 0) + (0 if TABLE.match(line) else len(SEPARATOR.findall(line.strip())))
        out.append(parser.text.get(k, 0) / (1 + tags))
    return out


def site_name(source: str | None) -> str:
    """Letters that begin the registered name of the page's host."""
    m = re.match(r"https?://(?:www\.)?([^\W\d_]+)", source or "")
    return m[1].lower() if m else ""


def masked(line: str, site: str) -> str:
    line = line.strip().lower()
    if site:
        line = re.sub(rf"(?<![^\W_]){re.escape(site)}(?:-\d+)?(?![^\W_])", SITE, line)
    return re.sub(r"\d+(?:[.,]\d+)*", "0", line)


def features(line: str, ratio: float, site: str, title: str) -> list[int]:
    """Hashed features: words and pairs of words, the whole template, and the line's shape."""
    m = BULLET.sub("", masked(line, site))
    words = WORD.findall(m)
    plain = LINK.sub(r"\1", line).strip()
    heading, bullet, table = bool(HEADING.match(line)), bool(BULLET.match(line)), bool(TABLE.match(line))
    bare = BULLET.sub("", HEADING.sub("", plain)).strip().lower()
    shape = f"{heading:d}{bullet:d}{table:d}{bool(END.search(plain)):d}"
    seps = 0 if table else len(SEPARATOR.findall(plain))
    names = [f"t:{m}", f"s:{shape}", f"r:{int(np.log2(ratio + 1))}:{shape}", f"n:{min(len(words), 12) // 2}:{shape}", f"p:{min(seps, 4)}:{shape}"]
    names += [f"l:{min(len(LINK.findall(line)), 3)}", f"u:{plain.isupper()}"]
    if title:
        low = title.lower().strip()
        names.append(f"title:{'is' if bare == low else 'ends' if bare.endswith(low) and seps else 'no'}:{heading:d}")
    names += [f"w:{w}" for w in set(words)] + [f"b:{a} {b}" for a, b in zip(["^", *words], [*words, "$"])]
    return [zlib.crc32(x.encode()) >> (32 - BITS) for x in names]


MEMO = 200_000


def title_kind(line: str, title: str) -> str:
    """What of a line's features the title decides."""
    low, bare = title.lower().strip(), BULLET.sub("", HEADING.sub("", LINK.sub(r"\1", line).strip())).strip().lower()
    return "" if not title else "is" if bare == low else "ends" if bare.endswith(low) else "no"


class LineModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self._known: dict[tuple, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(**state)

    def line_scores(self, lines: list[str], ratios: list[float], site: str, title: str) -> np.ndarray:
        """Scores of a page's lines; a line that a site has on many pages is weighed once."""
        if len(self._known) > MEMO:
            self._known.clear()
        keys = [(site, line, int(np.log2(r + 1)), title_kind(line, title) if title else "") for line, r in zip(lines, ratios)]
        new = {k: i for i, k in enumerate(keys) if k not in self._known}
        if new:
            scores = self.scores([features(lines[i], ratios[i], site, title) for i in new.values()])
            self._known.update(zip(new, scores.tolist()))
        return np.array([self._known[k] for k in keys])

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Log-odds that a line is of the site, 0 where it is as likely in clean articles."""
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(r) for r in rows])
        flat = self.weights[np.concatenate([np.array(r) for r in rows])]
        return np.add.reduceat(flat, np.cumsum(sizes) - sizes) + self.bias


def train(pages: list[list[list[int]]], clean: list[list[list[int]]], least_lines: int = 4, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> LineModel:
    """Logistic regression of lines of pages against lines of clean articles, both groups weighed alike.

    Features of fewer than least_lines lines are left out. What only pages have gets high odds; what articles have as well, their own lines, stays near the prior.
    """
    rows = [f for doc in pages for f in doc] + [f for doc in clean for f in doc]
    n_pages = sum(map(len, pages))
    y = np.r_[np.ones(n_pages), np.zeros(len(rows) - n_pages)]
    weight = np.where(y == 1, len(y) / (2 * max(n_pages, 1)), len(y) / (2 * max(len(y) - n_pages, 1)))
    rng = np.random.default_rng(seed)
    w, g2, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0
    rows = [np.array(r) for r in rows]
    often = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=1 << BITS) >= least_lines
    rows = [r[often[r]] if often[r].any() else r[:1] for r in rows]
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 256):
            at = order[a : a + 256]
            sizes = np.array([len(rows[i]) for i in at])
            use = np.concatenate([rows[i] for i in at])
            z = np.add.reduceat(w[use], np.cumsum(sizes) - sizes) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at]
            grad = np.repeat(err, sizes)
            sums = np.bincount(use, weights=grad, minlength=1 << BITS)
            hit = np.unique(use)
            g = sums[hit] / len(at) * 64 + decay * w[hit]
            g2[hit] += g * g
            w[hit] -= rate * g / np.sqrt(g2[hit])
            bias -= 0.01 * err.mean()
    return LineModel(w, bias)
