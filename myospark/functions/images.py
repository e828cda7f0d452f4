"""Numpy helpers for single frames."""

from __future__ import annotations

import numpy as np

#: ITU-R 709 weights of red, green and blue.
LUMA = (0.2125, 0.7154, 0.0721)


def gray(pixels: np.ndarray, weights: tuple[float, ...] = LUMA) -> np.ndarray:
    """(h, w, channels) as (h, w)."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    if pixels.shape[2] < 3:
        raise ValueError("a frame has one channel or at least three")
    return pixels[:, :, :3] @ np.array(weights)


def laplace(frame: np.ndarray) -> np.ndarray:
    """Four times a pixel minus its four neighbours; beyond the borders the frame is mirrored with its edge."""
    out = 4 * frame
    for own, other in ((out, frame), (out.T, frame.T)):
        own[1:] -= other[:-1]
        own[0] -= other[0]
        own[:-1] -= other[1:]
        own[-1] -= other[-1]
    return out


def gaussian(frame: np.ndarray, sigma: float) -> np.ndarray:
    """Blur by a kernel cut at four sigma; beyond the borders the nearest pixel goes on."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    k /= k.sum()
    h, w = frame.shape
    part = np.empty((h, w))
    p = np.concatenate([np.repeat(frame[:1], r, 0), frame, np.repeat(frame[-1:], r, 0)])
    out = k[0] * p[:h]
    for i in range(1, 2 * r + 1):
        out += np.multiply(p[i : i + h], k[i], out=part)
    p = np.concatenate([np.repeat(out[:, :1], r, 1), out, np.repeat(out[:, -1:], r, 1)], axis=1)
    out = k[0] * p[:, :w]
    for i in range(1, 2 * r + 1):
        out += np.multiply(p[:, i : i + w], k[i], out=part)
    return out


def filter_frame(pixels: np.ndarray, sigma: float) -> np.ndarray:
    return gaussian(laplace(gray(pixels)), sigma)


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The bin centre that parts the values with the largest variance between the classes."""
    low, high = values.min(), values.max()
    if low == high:
        return float(low)
    n, edges = np.histogram(values, bins, (low, high))
    centers = (edges[1:] + edges[:-1]) / 2
    w = np.cumsum(n)[:-1].astype(float)
    s = np.cumsum(n * centers)
    rest = n.sum() - w
    with np.errstate(invalid="ignore", divide="ignore"):
        between = np.where((w > 0) & (rest > 0), w * rest * (s[:-1] / w - (s[-1] - s[:-1]) / rest) ** 2, -1)
    return float(centers[int(np.argmax(between))])


def contours(frame: np.ndarray, level: float) -> list[np.ndarray]:
    """Lines of equal value through the grid, linear between pixels, as (row, column) points; closed ones repeat their first
    point. At a saddle the low corners are joined."""
    h, w = frame.shape
    up = frame > level
    cells = [(up[:-1, :-1], 1), (up[:-1, 1:], 2), (up[1:, :-1], 4), (up[1:, 1:], 8)]
    case = sum(c * k for c, k in cells)
    # sides of a cell: 0 top, 1 bottom, 2 left, 3 right
    sides = {1: [(0, 2)], 2: [(0, 3)], 3: [(2, 3)], 4: [(1, 2)], 5: [(0, 1)], 6: [(0, 3), (1, 2)], 7: [(1, 3)], 8: [(1, 3)], 9: [(0, 2), (1, 3)], 10: [(0, 1)], 11: [(1, 2)], 12: [(2, 3)], 13: [(0, 3)], 14: [(0, 2)]}
    size = h * w
    links: dict[int, list[int]] = {}
    for r, c in zip(*(x.tolist() for x in np.nonzero((case > 0) & (case < 15))), strict=True):
        at = r * w + c
        name = (at, at + w, size + at, size + at + 1)  # horizontal sides first, then vertical ones
        for a, b in sides[int(case[r, c])]:
            links.setdefault(name[a], []).append(name[b])
            links.setdefault(name[b], []).append(name[a])

    lines, seen = [], set()
    for start in sorted(links, key=lambda s: (len(links[s]) != 1, s)):  # open lines from their ends, then loops
        if start in seen:
            continue
        line, here = [start], start
        seen.add(start)
        while onward := [s for s in links[here] if s not in seen]:
            here = onward[0]
            seen.add(here)
            line.append(here)
        if len(links[start]) == 2 and start in links[here] and len(line) > 2:
            line.append(start)
        lines.append(line)
    if not lines:
        return []
    at = np.array([side for line in lines for side in line])
    r, c = np.divmod(at % size, w)
    level_side = at < size
    a, b = frame[r, c], frame[r + ~level_side, c + level_side]
    t = (level - a) / (b - a)
    points = np.stack([r + np.where(level_side, 0.0, t), c + np.where(level_side, t, 0.0)], axis=1)
    return np.split(points, np.cumsum([len(line) for line in lines])[:-1])


#: Up to so many points all distances are formed at once.
ALL_PAIRS = 128


def hull(points: np.ndarray) -> np.ndarray:
    """Numbers of the corners of the convex hull, anticlockwise; of equal points the first."""
    order = np.lexsort((np.arange(len(points)), points[:, 1], points[:, 0]))
    x, y = points[order, 0], points[order, 1]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    corners = list(zip(x[fresh].tolist(), y[fresh].tolist(), order[fresh].tolist(), strict=True))
    if len(corners) < 3:
        return np.array([k for *_, k in corners])
    found: list[int] = []
    for way in (corners, corners[::-1]):
        half: list[tuple[float, float, int]] = []
        for c in way:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (c[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (c[0] - half[-2][0]):
                half.pop()
            half.append(c)
        found += [k for *_, k in half[:-1]]
    return np.array(found)


def furthest(points: np.ndarray) -> tuple[int, int]:
    """The two points furthest apart, the first such pair in order. Of many points these are opposite corners of the convex hull,
    which a pair of parallel lines turning around it meets, so time follows the points and memory holds no pairs."""
    if len(points) <= ALL_PAIRS:
        d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2)
        i, j = np.unravel_index(int(np.argmax(d)), d.shape)
        return int(i), int(j)
    corners = hull(points)
    n = len(corners)
    if n < 3:
        return int(corners.min()), int(corners.max())
    own = points[corners].tolist()
    far, j = [], 1
    for i in range(n):
        (ax, ay), (bx, by) = own[i], own[(i + 1) % n]
        height = lambda k, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (own[k % n][1] - ay) - (by - ay) * (own[k % n][0] - ax)
        j = max(j, i + 1)
        while height(j + 1) > height(j):
            j += 1
        # the next corner is opposite too where the edges are parallel, or nearly so
        far += [(k, m % n) for k in (i, (i + 1) % n) for m in (j - 1, j, j + 1)]
    at = np.array(far)
    d = ((points[corners[at[:, 0]]] - points[corners[at[:, 1]]]) ** 2).sum(1)
    best = np.sort(corners[at[d == d.max()]], axis=1)
    i, j = best[np.lexsort((best[:, 1], best[:, 0]))[0]]
    return int(i), int(j)


def summary(points: np.ndarray) -> tuple[float, ...] | None:
    """Centre, and the two points furthest apart, the first such pair in order; None under three points."""
    if len(points) < 3:
        return None
    i, j = furthest(points)
    return (*points.mean(0), *points[i], *points[j])


def summaries(lines: list[np.ndarray]) -> np.ndarray:
    """A row of summary() for each line of three points or more; short lines of equal length are worked on together."""
    lines = [c for c in lines if len(c) >= 3]
    out, alike = np.empty((len(lines), 6)), {}
    for k, c in enumerate(lines):
        alike.setdefault(len(c), []).append(k)
    for n, rows in alike.items():
        if n > ALL_PAIRS:
            out[rows] = [summary(lines[k]) for k in rows]
            continue
        step = max(1, (1 << 18) // n**2)
        for at in (rows[s : s + step] for s in range(0, len(rows), step)):
            p = np.stack([lines[k] for k in at])
            d = ((p[:, :, None, :] - p[:, None, :, :]) ** 2).sum(3).reshape(len(at), n * n)
            i, j = np.divmod(d.argmax(1), n)
            own = np.arange(len(at))
            out[at] = np.concatenate([p.mean(1), p[own, i], p[own, j]], axis=1)
    return out
