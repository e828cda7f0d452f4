"""Numpy helpers for single series and for batches of pairs of series."""

from __future__ import annotations

import numpy as np

LENGTHS = np.geomspace(0.1, 10.0, 13)
RATIOS = np.geomspace(1e-8, 1e4, 61)


def _profile(total: np.ndarray, logs: np.ndarray, q2: np.ndarray, ratios: np.ndarray) -> tuple[float, float]:
    """Best log marginal likelihood over the noise ratio and the ratio; the signal variance follows from it."""
    n = len(total)
    fits = (q2[:, None] / total).sum(0)
    s2 = np.clip(fits / n, 1e-5, 1e5)
    fit = -0.5 * (fits / s2 + logs + n * np.log(s2))
    k = int(np.argmax(fit))
    return fit[k], ratios[k]


class _Kernel:
    """Eigenvectors of the squared-exponential kernel on the observed frames, by length scale, and what its likelihoods share."""

    def __init__(self, x: np.ndarray):
        self.d2, self.known, self.shared = (x[:, None] - x[None, :]) ** 2, {}, {}

    def at(self, length: float) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.known:
            d, q = np.linalg.eigh(np.exp(-0.5 * self.d2 / length**2))
            self.known[length] = np.maximum(d, 0), q
        return self.known[length]

    def totals(self, length: float, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Variances of the eigenvectors' parts by noise ratio, and the sums of their logs; those of RATIOS are kept."""
        if ratios is RATIOS and length in self.shared:
            return self.shared[length]
        total = self.at(length)[0][:, None] + ratios[None, :]
        found = total, np.log(total).sum(0)
        if ratios is RATIOS:
            self.shared[length] = found
        return found

    def size(self) -> int:
        n = len(self.d2)
        return 8 * n * (n + len(self.known) * (n + 1) + len(self.shared) * len(RATIOS))


class _Kernels:
    """The kernels of the sets of frames that a worker has met last, of `most` bytes at most or one: series with the same frames share them."""

    def __init__(self, most: int = 96 << 20):
        self.most, self.held, self.used, self.size = most, {}, set(), 0

    def of(self, x: np.ndarray) -> _Kernel:
        key = x.tobytes()
        self.held[key] = kernel, _ = self.held.pop(key, None) or (_Kernel(x), 0)
        self.used.add(key)
        return kernel

    def settle(self) -> None:
        """Count what the kernels have grown to, and let the longest unused go."""
        for key in self.used:
            kernel, counted = self.held[key]
            self.held[key] = kernel, kernel.size()
            self.size += kernel.size() - counted
        self.used.clear()
        while self.size > self.most and len(self.held) > 1:
            self.size -= self.held.pop(next(iter(self.held)))[1]


_kernels = _Kernels()


def _fit(kernel: _Kernel, y: np.ndarray) -> tuple[float, float]:
    """(length, noise ratio) of the likeliest kernel: by the grid of lengths, then between the neighbours of the best, twice."""
    q2, found = {}, {}

    def at(length: float, ratios: np.ndarray = RATIOS) -> None:
        if length not in q2:
            q2[length] = (kernel.at(length)[1].T @ y) ** 2
        found[length] = max(found.get(length, (-np.inf, 0.0)), _profile(*kernel.totals(length, ratios), q2[length], ratios))

    for length in LENGTHS:
        at(float(length))
    for _ in range(2):
        known = sorted(found)
        k = known.index(max(known, key=lambda x: found[x][0]))
        low, high = known[max(0, k - 1)], known[min(len(known) - 1, k + 1)]
        near = found[known[k]][1] * np.geomspace(0.5, 2.0, 13)
        for length in np.geomspace(low, high, 6)[1:-1]:
            at(float(length), near)
    best = max(found, key=lambda x: found[x][0])
    at(best, found[best][1] * np.geomspace(0.8, 1.25, 21))
    return best, found[best][1]


def gp_smooth(x: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Each column predicted at every x from its values, by the likeliest squared-exponential kernel with noise."""
    out = []
    for y in columns:
        known = ~np.isnan(y)
        if known.sum() < 2:
            out.append(np.where(known.any(), np.nansum(y), np.nan) * np.ones(len(y)))
            continue
        own = _kernels.of(x[known])
        mean, scale = y[known].mean(), y[known].std()
        if scale < 1e-12 * max(1.0, abs(mean)):
            out.append(np.full(len(y), mean))
            continue
        z = (y[known] - mean) / scale
        length, ratio = _fit(own, z)
        d, q = own.at(length)
        weights = q @ ((q.T @ z) / (d + ratio))
        out.append(np.exp(-0.5 * (x[:, None] - x[known][None, :]) ** 2 / length**2) @ weights * scale + mean)
    _kernels.settle()
    return out


def peaks(x: np.ndarray, distance: int, width: float) -> np.ndarray:
    """Places of the peaks of x: plateaus count at their middle; of peaks nearer than `distance` the higher stays; a peak
    must be `width` wide at half its prominence."""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(x)]])
    inner = [(s, e) for s, e in zip(starts, ends, strict=True) if 0 < s and e < len(x) and x[s - 1] < x[s] and x[e] < x[s]]
    at = np.array([(s + e - 1) // 2 for s, e in inner], np.int64)
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near] = False
    return np.array([p for p in at[keep] if _width(x, p) >= width], np.int64)


def _width(x: np.ndarray, p: int) -> float:
    higher_left, higher_right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
    low = higher_left[-1] + 1 if len(higher_left) else 0
    high = p + 1 + higher_right[0] if len(higher_right) else len(x)
    prominence = x[p] - max(x[low : p + 1].min(), x[p:high].min())
    level = x[p] - prominence / 2
    i, j = p, p
    while i > low and x[i] > level:
        i -= 1
    while j < high - 1 and x[j] > level:
        j += 1
    left = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
    right = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else float(j)
    return right - left


def dtw_many(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distances of pairs of series; pairs of equal lengths are worked on together, two rows of the table at a time."""
    out = np.full(len(a), np.nan)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (s, t) in enumerate(zip(a, b, strict=True)):
        if s is not None and t is not None and len(s) and len(t):
            groups.setdefault((len(s), len(t)), []).append(k)
    for (n, m), rows in groups.items():
        s, t = np.array([a[k] for k in rows], float), np.array([b[k] for k in rows], float)
        last = np.full((len(rows), m + 1), np.inf)
        last[:, 0] = 0
        for i in range(n):
            now = np.full_like(last, np.inf)
            cost = (s[:, i : i + 1] - t) ** 2
            reach = np.minimum(last[:, 1:], last[:, :-1])
            for j in range(m):
                now[:, j + 1] = cost[:, j] + np.minimum(reach[:, j], now[:, j])
            last = now
        out[rows] = np.sqrt(last[:, -1])
    return out


def ward(distances: np.ndarray) -> list[tuple[int, int, float, int, list[int]]]:
    """(a, b, height, size, leaves) of each merge, by Lance and Williams' update. Chains of nearest neighbours find the
    merges, each in time linear in the clusters left; they are numbered by height afterwards."""
    n = len(distances)
    d = distances.astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    size, alive, chain, found = np.ones(n), np.ones(n, bool), [], []
    while len(found) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        here = chain[-1]
        near = int(np.argmin(d[here]))
        if len(chain) < 2 or d[here, near] < d[here, chain[-2]]:
            chain.append(near)
            continue
        i, j = sorted((chain.pop(), chain.pop()))
        height, total = d[i, j], size[i] + size[j]
        found.append((height, i, j))
        alive[j] = False
        rest = alive.copy()
        rest[i] = False
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / (total + size)
        d[i, rest] = d[rest, i] = new[rest]
        d[j] = d[:, j] = np.inf
        size[i] = total
    of, name, leaves, out = list(range(n)), list(range(n)), [[k] for k in range(n)], []

    def cluster(k: int) -> int:
        while of[k] != k:
            of[k] = k = of[of[k]]
        return k

    for step, k in enumerate(np.argsort([f[0] for f in found], kind="stable").tolist()):
        height, i, j = found[k]
        first, second = sorted((cluster(i), cluster(j)), key=lambda c: name[c])
        leaves[first] = leaves[first] + leaves[second]
        out.append((name[first], name[second], float(np.sqrt(max(height, 0.0))), len(leaves[first]), leaves[first]))
        of[second], name[first], leaves[second] = first, n + step, []
    return out


#: Draws of a bootstrap at once.
DRAWS = 1 << 18


def bootstrap_sums(columns: np.ndarray, share: np.ndarray, runs: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
    """(run, column): the sums of runs[r] draws with replacement from the rows of columns, by how often each row is drawn.

    The counts of a run are multinomial, of which the counts of parts of the rows are a part: first how many draws fall to
    each part, then how they fall inside it. `share` is the chance of a row. Memory holds the counts of DRAWS rows and runs."""
    out = np.zeros((len(runs), columns.shape[1]))
    rest, left = runs.astype(np.int64).copy(), float(share.sum())
    step = max(1, DRAWS // max(1, len(runs)))
    for k in range(0, len(columns), step):
        own = share[k : k + step]
        here = rest if k + step >= len(columns) else rnd.binomial(rest, min(1.0, float(own.sum()) / left))
        out += rnd.multinomial(here, own / own.sum()) @ columns[k : k + step]
        rest, left = rest - here, left - float(own.sum())
    return out


def bootstrap_means(values: np.ndarray, mu: float, size: int, runs: int, rnd: np.random.Generator) -> np.ndarray:
    """mu minus the mean of `size` draws with replacement, `runs` times."""
    columns, share = np.asarray(values, float)[:, None], np.full(len(values), 1 / len(values))
    return mu - bootstrap_sums(columns, share, np.full(runs, size), rnd)[:, 0] / size


def bootstrap_angles(values: np.ndarray, mu: float, radius: float, size: int, runs: int, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """mu and radius minus the circular mean and the resultant length of the draws."""
    columns, share = np.column_stack([np.sin(values), np.cos(values)]), np.full(len(values), 1 / len(values))
    s, c = bootstrap_sums(columns, share, np.full(runs, size), rnd).T / size
    return mu - np.arctan2(s, c), radius - np.hypot(s, c)
