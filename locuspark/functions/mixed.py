"""Variance components of y = Xb + u + e, u ~ (0, vg K), e ~ (0, ve I), on the driver.

Restricted likelihood is profiled over delta = ve / vg in the spectrum of K
seen through the residual space of X (Kang et al., 2008).  A random effect with
incidence Z is the same problem with Z K Z'.
"""

from __future__ import annotations

import math
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

from locuspark.session import MAX_SAMPLES


@dataclass(frozen=True)
class Components:
    reml: float
    delta: float
    vg: float
    ve: float

    @property
    def h2(self) -> float:
        return self.vg / (self.vg + self.ve) if self.vg + self.ve > 0 else 0.0


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues and basis of K in the space that X leaves; holds for every phenotype.

    In the other directions of that space, of ``dimension`` in all, K is zero.
    """

    values: np.ndarray
    basis: np.ndarray
    dimension: int


@dataclass(frozen=True)
class Factor:
    """A kinship of low rank by its spectrum: K = vectors diag(values) vectors', without an n x n matrix."""

    vectors: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, factor: np.ndarray) -> Factor:
        """K = factor factor'."""
        vectors, sigma, _ = np.linalg.svd(factor, full_matrices=False)
        keep = sigma > max(factor.shape) * np.finfo(float).eps * sigma.max(initial=0.0)
        return cls(vectors[:, keep], sigma[keep] ** 2)

    def __len__(self) -> int:
        return len(self.vectors)

    def times(self, b: np.ndarray) -> np.ndarray:
        return self.vectors @ (self.values[:, None] * (self.vectors.T @ b.reshape(len(b), -1))).reshape(len(self.values), *b.shape[1:])

    def solve(self, delta: float, b: np.ndarray) -> np.ndarray:
        """(K + delta I)^-1 b."""
        gain = 1 / (self.values + delta) - 1 / delta
        return b / delta + self.vectors @ (gain[:, None] * (self.vectors.T @ b.reshape(len(b), -1))).reshape(len(gain), *b.shape[1:])

    def block(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * self.values) @ self.vectors[columns].T


@dataclass(frozen=True)
class LowRankWhitener:
    """The symmetric W with W (K + delta I) W = I, for a kinship by its factor."""

    vectors: np.ndarray
    gain: np.ndarray
    scale: float

    @classmethod
    def of(cls, k: Factor, delta: float) -> LowRankWhitener:
        return cls(k.vectors, 1 / np.sqrt(k.values + delta) - 1 / math.sqrt(delta), 1 / math.sqrt(delta))

    def rows(self, g: np.ndarray) -> np.ndarray:
        """Vectors in rows, whitened."""
        return g * self.scale + ((g @ self.vectors) * self.gain) @ self.vectors.T


def require_full_rank(x: np.ndarray) -> None:
    n, q = x.shape
    if q == 0 or n <= q:
        raise ValueError("the design needs a column, and fewer columns than there are observations")
    if np.linalg.matrix_rank(x) < q:
        raise ValueError("the design's columns must be linearly independent")


def checked_kinship(k: np.ndarray, n: int) -> np.ndarray:
    """``k`` as a symmetric matrix, which must be finite, n x n and positive semidefinite up to rounding."""
    k = np.asarray(k, float)
    if k.shape != (n, n) or not np.isfinite(k).all() or not np.allclose(k, k.T, rtol=1e-10, atol=1e-12):
        raise ValueError("kinship must be finite, square and symmetric")
    k = 0.5 * (k + k.T)
    least, most = np.linalg.eigvalsh(k)[[0, -1]]
    if least < -n * np.finfo(float).eps * max(most, -least, 1.0):
        raise ValueError("kinship must be positive semidefinite")
    return k


def spectrum(k: np.ndarray, x: np.ndarray) -> Spectrum:
    n, q = x.shape
    if k.shape != (n, n):
        raise ValueError(f"kinship must be {n} x {n}; got {k.shape}")
    if n > MAX_SAMPLES:
        raise ValueError(f"{n} samples; dense mixed models take {MAX_SAMPLES} at most")
    require_full_rank(x)
    basis = np.linalg.qr(x, mode="complete")[0][:, q:]
    values, vectors = np.linalg.eigh(basis.T @ ((k + k.T) / 2.0) @ basis)
    return Spectrum(values, basis @ vectors, n - q)


def factor_spectrum(factor: np.ndarray, x: np.ndarray) -> Spectrum:
    """The spectrum of factor @ factor.T: as many values as the factor has columns, the others are zero."""
    n, q = x.shape
    if factor.shape[1] >= n - q:
        return spectrum(factor @ factor.T, x)
    require_full_rank(x)
    basis = np.linalg.qr(x)[0]
    vectors, sigma, _ = np.linalg.svd(factor - basis @ (basis.T @ factor), full_matrices=False)
    keep = sigma > max(factor.shape) * np.finfo(float).eps * sigma.max(initial=0.0)
    return Spectrum(sigma[keep] ** 2, vectors[:, keep], n - q)


def likelihood(log_delta: np.ndarray, values: np.ndarray, coords: np.ndarray, rest: float = 0.0, zeros: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Restricted log-likelihood and its slope at each log delta.

    ``rest`` is the sum of squares in ``zeros`` further directions, where the kinship is zero.
    """
    delta = np.exp(np.atleast_1d(log_delta))
    width = values + delta[:, None]
    n = len(coords) + zeros
    ratio = coords**2 / width
    sse = ratio.sum(axis=1) + rest / delta
    value = 0.5 * (n * (math.log(n / (2 * math.pi)) - 1 - np.log(sse)) - np.log(width).sum(axis=1) - zeros * np.log(delta))
    slope = 0.5 * delta * (n * ((ratio / width).sum(axis=1) + rest / delta**2) / sse - (1 / width).sum(axis=1) - zeros / delta)
    return value, slope


def reml(
    y: np.ndarray, x: np.ndarray, k: np.ndarray | None, grid: int = 100, low: float = -10.0, high: float = 10.0, tolerance: float = 1e-10, z: np.ndarray | None = None, known: Spectrum | None = None
) -> Components:
    """Best restricted fit: interior maxima between grid points, and the ends where the slope says so."""
    if z is not None:
        if z.shape[1] <= x.shape[1]:
            raise ValueError("incidence needs more columns than the fixed-effect design")
        k = z @ k @ z.T
    if known is None:
        known = factor_spectrum(k.vectors * np.sqrt(k.values), x) if isinstance(k, Factor) else spectrum(k, x)
    values, coords, zeros, rest = known.values, known.basis.T @ y, known.dimension - len(known.values), 0.0
    if zeros:
        rest = max(float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() - coords @ coords), 0.0)
    at = np.linspace(low, high, grid + 1)
    with np.errstate(all="ignore"):
        value, slope = likelihood(at, values, coords, rest, zeros)
    found: list[tuple[float, float]] = []
    if slope[0] < tolerance:
        found.append((value[0], low))
    if slope[-2] > -tolerance:  # the last but one grid point decides on the upper end
        found.append((value[-1], high))
    for i in np.nonzero((slope[:-1] > 0) & (slope[1:] < 0))[0]:
        root = _falling_root(lambda d: likelihood(d, values, coords, rest, zeros)[1][0], at[i], at[i + 1], tolerance)
        found.append((likelihood(root, values, coords, rest, zeros)[0][0], root))
    if not found:
        best = int(np.nanargmax(value))
        found.append((value[best], at[best]))
    best = max(range(len(found)), key=lambda i: found[i][0])
    log_likelihood, log_delta = found[best]
    delta = math.exp(log_delta)
    vg = float(((coords**2 / (values + delta)).sum() + rest / delta) / known.dimension)
    return Components(float(log_likelihood), delta, vg, vg * delta)


def given(y: np.ndarray, x: np.ndarray, k: np.ndarray | Factor, h2: float, z: np.ndarray | None = None, known: Spectrum | None = None) -> Components:
    """The fit at a heritability vg / (vg + ve) that is known: vg and likelihood follow from the data."""
    if not 0 < h2 < 1:
        raise ValueError("a given heritability must be between 0 and 1")
    if z is not None:
        k = z @ k @ z.T
    delta = (1 - h2) / h2
    if known is None:
        known = factor_spectrum(k.vectors * np.sqrt(k.values), x) if isinstance(k, Factor) else spectrum(k, x)
    coords, zeros = known.basis.T @ y, known.dimension - len(known.values)
    rest = max(float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() - coords @ coords), 0.0) if zeros else 0.0
    vg = float(((coords**2 / (known.values + delta)).sum() + rest / delta) / known.dimension)
    return Components(float(likelihood(math.log(delta), known.values, coords, rest, zeros)[0][0]), delta, vg, vg * delta)


def _falling_root(f, low: float, high: float, tolerance: float) -> float:
    """Where f, positive at low and negative at high, is zero."""
    while high - low > tolerance:
        mid = 0.5 * (low + high)
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return 0.5 * (low + high)


def minimum(f, low: float, high: float, tolerance: float = 1e-10) -> float:
    """Golden-section minimum of f."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance * max(1.0, abs(low) + abs(high)):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return 0.5 * (low + high)


def whitener(k: np.ndarray, delta: float) -> np.ndarray:
    """W with W (K + delta I) W' = I: a triangular inverse, or spectral where K is not positive definite."""
    n = len(k)
    v = (k + k.T) / 2.0
    v = v + delta * np.eye(n)
    try:
        return np.linalg.solve(np.linalg.cholesky(v), np.eye(n))
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh((k + k.T) / 2.0)
        return (vectors / np.sqrt(np.maximum(values, 0.0) + delta)).T


def generalised_fit(y: np.ndarray, x: np.ndarray, k: np.ndarray, delta: float, vg: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a generalised least squares fit and their standard errors."""
    precision = np.linalg.pinv(k + delta * np.eye(len(y)))
    inverse = np.linalg.pinv(x.T @ precision @ x)
    return inverse @ x.T @ precision @ y, np.sqrt(np.maximum(np.diag(inverse) * vg, 0.0))


def average_linkage(points: np.ndarray) -> np.ndarray:
    """Merges of average linkage on Euclidean distances, by height: rows of (a, b, height); n + i is merge i.

    Nearest-neighbour chains, quadratic in the number of points.
    """
    n = len(points)
    square = (points**2).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0.0))
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.nonzero(alive)[0][0])]
        while True:
            tip = chain[-1]
            near = int(np.argmin(d[tip]))
            if len(chain) > 1 and d[tip, chain[-2]] <= d[tip, near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((a, b, d[a, b]))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    return _tree(merges, n)


def _tree(merges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Merges by height, named by what they merge, from pairs of points that stand for their clusters."""
    merges.sort(key=lambda m: m[2])
    name, out = list(range(n)), []
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (a, b, height) in enumerate(merges):
        ra, rb = top(a), top(b)
        out.append((*sorted((name[ra], name[rb])), height))
        parent[rb] = ra
        name[ra] = n + i
    return np.array(out).reshape(-1, 3)


#: Bytes of distances that linkage by points holds, rows of distances that are made at once, points that one thread takes.
LINKAGE_BYTES, LINKAGE_ROWS, LINKAGE_PART = 1 << 28, 48, 4096

#: From so many points on, a cluster's row is held to the end, and no distances to its points are made.
LINKAGE_LARGE = 64


class _Distances:
    """Mean distances between clusters of weighted points; of the n x n numbers, some clusters' rows are held.

    A merge updates the rows held.  A row that was given up is made again from
    the cluster's points, so rows of small clusters are given up first.  As
    means are symmetric, what a held row says is not made again: points of
    large clusters, whose rows are always held, are left out of the work.  Points
    lie by cluster, and ``compact`` leaves out clusters that were merged since.
    """

    def __init__(self, points: np.ndarray, weight: np.ndarray, threads: ThreadPoolExecutor) -> None:
        n = len(points)
        self.points, self.square, self.weight = points, np.einsum("ij,ij->i", points, points), weight
        self.size, self.count, self.threads = weight.copy(), np.ones(n, int), threads
        self.name, self.members = np.arange(n), [[i] for i in range(n)]
        self.cells, self.line = np.empty(max(LINKAGE_BYTES // 8, self._lines(n) * n)), np.full(n, -1)
        self._lay(self._lines(n), n)
        self.turn, self.level, self.fresh = 0, 0.0, []
        self._begin(np.arange(n + 1))

    def _lay(self, lines: int, n: int) -> None:
        self.rows, self.top = self.cells[: lines * n].reshape(lines, n), 0
        self.owner, self.worth = np.full(lines, -1), np.full(lines, -1.0)

    @staticmethod
    def _lines(n: int) -> int:
        return min(n, max(16, LINKAGE_BYTES // (8 * n)))

    def _begin(self, first: np.ndarray) -> None:
        """``first`` has where the points of each cluster begin; clusters beyond it are the large ones."""
        n = len(self.size)
        self.first, self.pointed = first, len(first) - 1
        self.alive, self.into, self.parts_of = np.ones(n, bool), np.arange(n), [[i] for i in range(n)]
        self.gone, self.lost = np.zeros(n, int), 0
        cuts = np.searchsorted(first, np.arange(LINKAGE_PART, first[-1], LINKAGE_PART))
        self.cuts = np.unique(np.concatenate([[0], cuts, [self.pointed]]))

    def _sums(self, at: list[int]) -> np.ndarray:
        """Weighted distances of some points to those of each cluster, as clusters were when the points were laid out."""
        out, p, square = np.empty((len(at), self.pointed)), -2 * self.points[at], self.square[at][:, None]

        def part(k: int) -> None:
            low, high = self.cuts[k], self.cuts[k + 1]
            a, b = self.first[low], self.first[high]
            d = p @ self.points[a:b].T
            d += square
            d += self.square[a:b]
            np.maximum(d, 0.0, out=d)
            np.sqrt(d, out=d)
            d *= self.weight[a:b]
            out[:, low:high] = d if b - a == high - low else np.add.reduceat(d, self.first[low:high] - a, axis=1)

        if len(self.cuts) < 3:
            for k in range(len(self.cuts) - 1):
                part(k)
        else:
            list(self.threads.map(part, range(len(self.cuts) - 1)))
        return out

    def _means(self, sums: np.ndarray, cluster: int) -> np.ndarray:
        """Of sums over the clusters laid out, mean distances to those there are now."""
        gone, u = self.gone[: self.lost], self.pointed
        out = np.empty(len(self.size))
        out[:u] = sums
        if len(gone):
            merged = gone[gone < u]
            out += np.bincount(self.into[merged], sums[merged], len(out))
        out[:u] /= self.size[:u]
        out[u:] = self.rows[self.line[u:], cluster]
        out[gone] = np.inf
        out[cluster] = np.inf
        return out

    def _hold(self, cluster: int, row: np.ndarray) -> None:
        """Held until ``settle`` at least."""
        at = int(np.argmin(self.worth))
        if self.owner[at] >= 0:
            self.line[self.owner[at]], self.level = -1, max(self.level, self.worth[at])
        self.rows[at], self.owner[at], self.line[cluster], self.worth[at] = row, cluster, at, np.inf
        self.top = max(self.top, at + 1)
        self.fresh.append(cluster)

    def settle(self) -> None:
        """New rows may be given up from now on."""
        for c in self.fresh:
            if self.line[c] >= 0:
                self._used(c)
        self.fresh = []

    def _used(self, cluster: int) -> None:
        """A row is worth what it costs to make, over that of the last one given up: first to go are small clusters' rows that are not used."""
        self.turn += 1
        self.worth[self.line[cluster]] = np.inf if cluster >= self.pointed else self.level + self.count[cluster] + self.turn / (1 << 40)

    def make(self, clusters: list[int]) -> None:
        """Rows of some clusters, from their points' rows."""
        own = [(c, i) for c in dict.fromkeys(clusters) if self.line[c] < 0 for i in self.members[c]]
        total: np.ndarray | float = 0.0
        for k in range(0, len(own), LINKAGE_ROWS):
            part = own[k : k + LINKAGE_ROWS]
            for (c, i), sums in zip(part, self._sums([i for _, i in part])):
                # A cluster of one point may be named by it alone.
                total = sums if self.count[c] == 1 else total + self.weight[i] * sums
                if i == self.members[c][-1]:
                    self._hold(c, self._means(total if self.count[c] == 1 else total / self.size[c], c))
                    total = 0.0

    def row(self, cluster: int) -> np.ndarray:
        """Distances of a cluster to all."""
        if self.line[cluster] < 0:
            self.make([cluster])
        elif np.isfinite(self.worth[self.line[cluster]]):
            self._used(cluster)
        return self.rows[self.line[cluster]]

    def merge(self, a: int, b: int) -> int:
        """Both as one cluster, by the name of that with more points; a large one stays as it has no points laid out."""
        if (a >= self.pointed, self.count[a]) < (b >= self.pointed, self.count[b]):
            a, b = b, a
        self.make([a, b])
        first, second = self.row(a), self.row(b)
        whole = self.size[a] + self.size[b]
        share, other = self.size[a] / whole, self.size[b] / whole
        first *= share
        first += other * second
        held = self.rows[: self.top]
        held[:, a] = share * held[:, a] + other * held[:, b]
        held[:, b] = np.inf
        first[a] = np.inf
        gone = self.line[b]
        self.owner[gone], self.worth[gone], self.line[b] = -1, -1.0, -1
        self.size[a], self.size[b], self.alive[b] = whole, 1.0, False
        self.count[a] += self.count[b]
        self.into[self.parts_of[b]] = a
        self.parts_of[a] += self.parts_of[b]
        self.members[a] += self.members[b]
        self.members[b] = []
        self.gone[self.lost] = b
        self.lost += 1
        self._used(a)
        return a

    def compact(self) -> np.ndarray:
        """Leave out what was merged; the new place of each cluster."""
        large = self.alive & (self.count >= LINKAGE_LARGE) & (self.line >= 0)
        if large.sum() > len(self.rows) // 4:
            large[: self.pointed] = False
        few, many = np.nonzero(self.alive & ~large)[0], np.nonzero(large)[0]
        order = np.concatenate([few, many])
        place = np.full(len(self.size), -1)
        place[order] = np.arange(len(order))
        laid = np.array([i for c in few.tolist() for i in self.members[c]], int)
        first = np.concatenate([[0], np.cumsum(self.count[few])]).astype(int)
        self.points, self.square, self.weight = self.points[laid], self.square[laid], self.weight[laid]
        self.members = [list(range(a, b)) for a, b in zip(first[:-1].tolist(), first[1:].tolist())] + [[] for _ in many]
        self.size, self.count, self.name = self.size[order], self.count[order], self.name[order]
        held, rows = np.nonzero(self.owner >= 0)[0], self.rows
        owner, worth = place[self.owner[held]], self.worth[held]
        self._lay(max(self._lines(len(order)), len(held)), len(order))
        for i, at in enumerate(held.tolist()):
            self.rows[i] = rows[at][order]  # over cells that were read before
        self.top, self.line = len(held), np.full(len(order), -1)
        self.owner[: len(held)], self.worth[: len(held)], self.line[owner] = owner, worth, np.arange(len(held))
        self.fresh = []
        self._begin(first)
        for c in range(self.pointed, len(order)):
            self._used(c)
        return place


def average_linkage_of(points: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """``average_linkage`` without the n x n distances, over points that stand for ``weight`` equal ones each.

    Chains of nearest neighbours again: every cluster's row of distances is
    needed at least once, so the work is that of all distances, the memory is not.
    """
    n = len(points)
    weight = np.ones(n) if weight is None else np.asarray(weight, float)
    with ThreadPoolExecutor(min(8, os.cpu_count() or 1)) as threads:
        return _tree(_chained(_Distances(np.asarray(points, float), weight, threads)), n)


def _chained(d: _Distances) -> list[tuple[int, int, float]]:
    """Merges in the order they are found, between points that stand for their clusters.

    Many chains grow side by side, so that the rows they need next are made
    together.  A merge elsewhere makes no cluster a nearer neighbour of a third,
    so chains stay valid; they share no cluster.  One whose next neighbour is
    in another chain waits, unless both are each other's neighbours.
    """
    merges, chains, start, n = [], [], 0, len(d.size)
    of: dict[int, list[int]] = {}

    def joined(a: int, b: int, height: float, mine: list[int], other: list[int]) -> None:
        merges.append((int(d.name[a]), int(d.name[b]), height))
        for c, chain in ((a, mine), (b, other)):
            chain.pop()
            del of[c]
        whole = d.merge(a, b)
        for chain in (mine, other):
            if not chain:
                if whole not in of:
                    chain.append(whole)
                    of[whole] = chain
                elif of[whole] is not chain:
                    chains.remove(chain)

    def step(chain: list[int]) -> bool:
        """Whether the chain grew or a merge was found."""
        tip, last = chain[-1], chain[-2] if len(chain) > 1 else None
        row = d.row(tip)
        near = int(np.argmin(row))
        owner = of.get(near)
        # Rounding may lead back along the chain, among equal distances.
        if last is not None and (row[near] >= row[last] or owner is chain):
            joined(tip, last, float(row[last]), chain, chain)
        elif owner is None:
            chain.append(near)
            of[near] = chain
        elif owner[-1] == near and d.line[near] >= 0 and int(np.argmin(d.rows[d.line[near]])) == tip:
            joined(tip, near, float(row[near]), chain, owner)
        else:
            return False
        return True

    while len(merges) < n - 1:
        most = max(1, min(LINKAGE_ROWS, len(d.rows) // 12))
        while len(chains) < most:
            while start < len(d.size) and not (d.alive[start] and start not in of):
                start += 1
            if start == len(d.size):
                if chains:
                    break
                start = 0
                continue
            chains.append([start])
            of[start] = chains[-1]
        d.make([c[-1] for c in chains])
        moved = False
        for chain in list(chains):
            # On, as long as the next row is held.
            while len(merges) < n - 1 and chain and of.get(chain[-1]) is chain and d.line[chain[-1]] >= 0 and step(chain):
                moved = True
        d.settle()
        if not moved:
            del chains[1:]
            of = dict.fromkeys(chains[0], chains[0])
        if d.lost * 5 > len(d.size):
            place = d.compact()
            for chain in chains:
                chain[:] = place[chain].tolist()
            of, start = {c: chain for chain in chains for c in chain}, 0
    return merges


def cut_tree(merges: np.ndarray, n: int, groups: int) -> np.ndarray:
    """Cluster of each point at the lowest height that leaves ``groups`` clusters at most."""
    above = np.arange(n + len(merges))
    if groups < n:
        low = merges[: np.searchsorted(merges[:, 2], merges[n - groups - 1, 2], side="right"), :2].astype(int)
        above[low] = n + np.arange(len(low))[:, None]
        while not np.array_equal(top := above[above], above):
            above = top
    return np.unique(above[:n], return_inverse=True)[1]


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right, as a heat map shows them."""
    order, stack = [], [int(n + len(merges) - 1)] if len(merges) else list(range(n))
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            a, b, _ = merges[node - n]
            stack += [int(b), int(a)]
    return order
