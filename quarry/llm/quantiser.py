"""Cells and four-bit score-aware codes for vectors of unit length, in numpy."""

from __future__ import annotations

import numpy as np


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of unit length; empty cells restart at the worst-served vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(1)
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=cells)
        starts = np.cumsum(count) - count
        sums = np.zeros_like(c)
        some = count > 0
        sums[some] = np.add.reduceat(x[order], starts[some], axis=0)
        empty = np.flatnonzero(~some)
        sums[empty] = x[np.argsort(s.max(1))[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


class ScoreAwareCodes:
    """Product quantisation of residuals, 16 code words for each pair of coordinates.

    The loss weighs the part of the error that is parallel to the vector by eta = (d - 1) T^2 / (1 - T^2), for
    inner products from T on: errors at right angles hardly move the large products that decide the nearest.
    Code words are fitted by alternating assignment (coordinate descent over the subspaces, as the parallel error
    couples them) with the closed-form minimum of the weighted loss.
    """

    def __init__(self, dim: int, threshold: float = 0.6, width: int = 2):
        self.dim, self.width, self.parts = dim, width, dim // width
        self.eta = (dim - 1) * threshold**2 / (1 - threshold**2)
        self.words = np.zeros((self.parts, 16, width), np.float32)

    def fit(self, residual: np.ndarray, vector: np.ndarray, rounds: int = 6, seed: int = 3) -> ScoreAwareCodes:
        rng = np.random.default_rng(seed)
        pick = rng.integers(0, len(residual), 16)
        self.words = residual[pick].reshape(16, self.parts, self.width).transpose(1, 0, 2).copy()
        self.words += rng.normal(0, 1e-3, self.words.shape).astype(np.float32)
        for _ in range(rounds):
            codes = self.encode(residual, vector, sweeps=1)
            err = residual - self.decode(codes)
            parallel = (err * vector).sum(1)
            for m in range(self.parts):
                cols = slice(m * self.width, (m + 1) * self.width)
                r, v = residual[:, cols], vector[:, cols]
                other = parallel - (err[:, cols] * v).sum(1)
                target = other + (r * v).sum(1)
                a = np.eye(self.width)[None] + (self.eta - 1) * v[:, :, None] * v[:, None, :]
                b = r + (self.eta - 1) * target[:, None] * v
                left, right = np.zeros((16, self.width, self.width)), np.zeros((16, self.width))
                for i in range(self.width):
                    right[:, i] = np.bincount(codes[:, m], b[:, i], 16)
                    for j in range(self.width):
                        left[:, i, j] = np.bincount(codes[:, m], a[:, i, j], 16)
                used = np.bincount(codes[:, m], minlength=16) > 0
                self.words[m, used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
                err[:, cols] = r - self.words[m, codes[:, m]]
                parallel = other + (err[:, cols] * v).sum(1)
        return self

    def encode(self, residual: np.ndarray, vector: np.ndarray, sweeps: int = 1) -> np.ndarray:
        n = len(residual)
        codes = np.zeros((n, self.parts), np.uint8)
        err = residual.copy()
        for m in range(self.parts):
            cols = slice(m * self.width, (m + 1) * self.width)
            r, w = residual[:, cols], self.words[m]
            codes[:, m] = ((w * w).sum(1)[None] - 2 * r @ w.T).argmin(1)
            err[:, cols] = r - w[codes[:, m]]
        parallel = (err * vector).sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                cols = slice(m * self.width, (m + 1) * self.width)
                r, v, w = residual[:, cols], vector[:, cols], self.words[m]
                other = parallel - (err[:, cols] * v).sum(1)
                along = (other + (r * v).sum(1))[:, None] - v @ w.T
                loss = (w * w).sum(1)[None] - 2 * r @ w.T + (self.eta - 1) * along * along
                k = loss.argmin(1)
                codes[:, m] = k
                err[:, cols] = r - w[k]
                parallel = along[np.arange(n), k]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(self.parts)[None], codes].reshape(len(codes), self.dim)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two codes in a byte."""
        if self.parts % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, asks: np.ndarray) -> np.ndarray:
        """For each byte of a packed code its 256 values' parts of the products with the asking vectors."""
        product = np.einsum("qmw,mkw->mkq", asks.reshape(len(asks), self.parts, self.width), self.words).astype(np.float32)
        if self.parts % 2:
            product = np.concatenate([product, np.zeros((1, 16, len(asks)), np.float32)])
        return (product[::2, :, None] + product[1::2, None]).reshape(-1, 256, len(asks))


class CellIndex:
    """Cells and code words. Coarse centres number at most COARSE; beyond, each coarse cell is cut by the same
    fine centres of the residuals, so an index for n vectors holds COARSE + n / (cell_size * COARSE) centres."""

    COARSE = 4096
    CODE_SAMPLE = 16_384
    #: Products of asking and coded vectors that one search of a cell takes on.
    BLOCK_WORK = 64_000_000

    def __init__(self, sample: np.ndarray, total: int, cell_size: int, copies: int, threshold: float):
        x = sample.astype(np.float32)
        wanted = max(1, round(total / cell_size))
        coarse = min(wanted, self.COARSE, len(x))
        self.centres = even_cells(x, coarse)
        residual = x - self.centres[(x @ self.centres.T).argmax(1)]
        fine = min(max(1, round(wanted / len(self.centres))), len(x)) if wanted > self.COARSE else 1
        self.fines = nearest_means(residual, fine) if fine > 1 else np.zeros((1, x.shape[1]), np.float32)
        self.copies = min(copies, len(self.centres))
        self.cells = len(self.centres) * len(self.fines)
        near = np.concatenate([self._near(x[a : a + 4096])[0] for a in range(0, len(x), 4096)])
        some = x[: self.CODE_SAMPLE]
        fit = some - self.centre(near[: len(some), 0])
        self.codes = ScoreAwareCodes(x.shape[1], threshold).fit(fit, some)
        # Blocks of asking vectors by the cells' shares of the sample.
        n = len(self.fines)
        share = np.bincount(near[:, 0] // n, minlength=len(self.centres)), np.bincount(near.ravel() // n, minlength=len(self.centres))
        scale = total / len(x) / n
        self.blocks = np.maximum(1, np.ceil(share[0] * scale * share[1] * scale / self.BLOCK_WORK)).astype(np.int64)
        self.margin = self._margin(some, near[:, 0], fit)

    def _margin(self, x: np.ndarray, home: np.ndarray, residual: np.ndarray, asks: int = 256) -> float:
        """By how much a score may fall short of the cosine, for all but three in 100 of the sample's nearest."""
        some = np.linspace(0, len(x) - 1, min(asks, len(x))).astype(int)
        s = x[some] @ x.T
        n = min(16, len(x))
        flat = np.argpartition(-s, n - 1, axis=1)[:, :n].ravel()
        said = self.codes.decode(self.codes.encode(residual[flat], x[flat])) + self.centre(home[flat])
        error = ((said - x[flat]) * np.repeat(x[some], n, axis=0)).sum(1)
        return float(np.quantile(-error, 0.97)) + 1e-3

    def centre(self, cells):
        return self.centres[cells // len(self.fines)] + self.fines[cells % len(self.fines)]

    def _near(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of each vector, the nearest first, and the residuals to their centres."""
        s = u @ self.centres.T
        top = np.argpartition(-s, self.copies - 1, axis=1)[:, : self.copies]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        residual = u[:, None] - self.centres[top]
        fine = np.zeros_like(top)
        if len(self.fines) > 1:
            half = 0.5 * (self.fines**2).sum(1)
            for j in range(self.copies):
                fine[:, j] = (residual[:, j] @ self.fines.T - half).argmax(1)
            residual = residual - self.fines[fine]
        return top * len(self.fines) + fine, residual

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of each vector, the home first, and its packed codes in each."""
        x = u.astype(np.float32)
        cells, residual = self._near(x)
        return cells, np.stack([self.codes.packed(self.codes.encode(residual[:, j], x)) for j in range(self.copies)], axis=1)

    def blocks_of(self, cells: np.ndarray) -> np.ndarray:
        return self.blocks[cells // len(self.fines)]

    def scan(self, cell: int, asks: np.ndarray, codes: np.ndarray, stretch: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all codes for all asking vectors in 16-bit steps: product = score / scale + low."""
        tables = self.codes.tables(asks.astype(np.float32))
        least = tables.min(1)
        span = np.maximum((tables.max(1) - least).sum(0), 1e-6)
        scale = (65535 - len(tables)) / span
        steps = np.rint((tables - least[:, None]) * scale).astype(np.uint16)
        total = np.empty((len(codes), len(asks)), np.uint16)
        part = np.empty((min(stretch, len(codes)), len(asks)), np.uint16)
        for a in range(0, len(codes), stretch):
            own = codes[a : a + stretch]
            sums, row = total[a : a + stretch], part[: len(own)]
            np.take(steps[0], own[:, 0], axis=0, out=sums, mode="clip")
            for m in range(1, len(steps)):
                np.take(steps[m], own[:, m], axis=0, out=row, mode="clip")
                sums += row
        low = least.sum(0) + asks.astype(np.float32) @ self.centre(np.int64(cell))
        return np.ascontiguousarray(total.T), low.astype(np.float64), scale.astype(np.float64)


def even_cells(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit length; cells of over three times the mean share are cut again."""
    centres = spherical_kmeans(x, cells)
    for _ in range(4):
        own = (x @ centres.T).argmax(1)
        size = np.bincount(own, minlength=len(centres))
        large = np.flatnonzero(size > 3 * len(x) / cells)
        if cells < 2 or not len(large):
            break
        keep = np.setdiff1d(np.arange(len(centres)), large)
        cut = [spherical_kmeans(x[own == c], max(2, round(size[c] * cells / len(x)))) for c in large]
        centres = np.concatenate([centres[keep], *cut])
    return centres


def nearest_means(x: np.ndarray, n: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Plain k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        count = np.bincount(own, minlength=n)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c
