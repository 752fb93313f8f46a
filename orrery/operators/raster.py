"""Raster kernels on whole frames (2-d arrays): filters, edges, segments, integration. One frame is one row of a table."""

from __future__ import annotations

import numpy as np

#: Place of each polarizer angle in the sensor's 2 x 2 tile (row, column).
ANGLES = {90: (0, 0), 45: (0, 1), 135: (1, 0), 0: (1, 1)}


def unpack12(data: bytes, width: int, height: int, stride: int) -> np.ndarray:
    """12-bit pixels of packed rows, by their format: every three bytes are one 24-bit word of four half bytes for the first
    pixel's upper part, four for the second's, then the second's low four bits and the first's."""
    if len(data) != height * stride:
        raise ValueError(f"{len(data)} bytes, not {height * stride}")
    image = np.empty((height, width), np.int32)
    for y in range(height):
        line = np.frombuffer(data, np.uint8, width * 3 // 2, y * stride)
        word = np.zeros(len(line) // 3, np.int32)
        for byte in range(3):
            word = word * 256 + line[byte::3]
        image[y, 1::2] = word // 16 % 4096
        image[y, ::2] = word // 65536 * 16 + word % 16
    return image


def pack12(image: np.ndarray, stride: int) -> bytes:
    """The inverse of unpack12; rows are padded with zeros."""
    a, b = image[:, 0::2].astype(np.int32), image[:, 1::2].astype(np.int32)
    out = np.zeros((len(image), stride), np.uint8)
    body = np.stack([a // 16, b // 16, a % 16 + b % 16 * 16], axis=-1)
    out[:, : body.shape[1] * 3] = body.reshape(len(image), -1)
    return out.tobytes()


def _correlate(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with mirrored borders (the border pixel itself is not repeated)."""
    kh, kw = kernel.shape
    padded = np.pad(a.astype(float), ((kh // 2,) * 2, (kw // 2,) * 2), mode="reflect")
    windows = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape)
    return np.einsum("ijkl,kl->ij", windows, kernel)


def blur(a: np.ndarray, sigma: float = 1.0, size: int = 5) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma * sigma))
    k /= k.sum()
    return _correlate(a, np.outer(k, k))


def laplacian(a: np.ndarray) -> np.ndarray:
    """Second-order kernel of aperture 3."""
    return _correlate(a, np.array([[2.0, 0.0, 2.0], [0.0, -8.0, 0.0], [2.0, 0.0, 2.0]]))


def polar_planes(mosaic: np.ndarray) -> dict[int, np.ndarray]:
    """The four sub-images of a polarization mosaic, as luminance: each 2 x 2 colour tile averaged over its neighbours, then blurred."""
    tile = np.array([[0.25, 0.5, 0.25], [0.5, 1.0, 0.5], [0.25, 0.5, 0.25]]) / 4
    return {angle: blur(_correlate(mosaic[r::2, c::2], tile)) for angle, (r, c) in ANGLES.items()}


def edge(normals: np.ndarray, limit: float = 0.26) -> np.ndarray:
    """True where the normals' second derivative, stretched to 0..1, is above limit; nowhere on a flat frame."""
    energy = sum(np.abs(laplacian(normals[..., i])) for i in range(3))
    spread = np.ptp(energy)
    return (energy - energy.min()) / spread > limit if spread > 0 else np.zeros(energy.shape, bool)


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected parts of a mask, numbered from 1 in reading order of their first pixel; union-find over row runs."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(rows))], int)
    _, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int64)
    for r, s, e, n in zip(rows, starts, ends, number):
        out[r, s:e] = n + 1
    return out, int(number.max()) + 1 if len(rows) else 0


def ridge(normals: np.ndarray, limit: float = 0.05, least: int = 4) -> np.ndarray:
    """Ridges of blurred normals, without specks of fewer than `least` pixels."""
    energy = sum(np.abs(laplacian(blur(normals[..., i], 1.1))) for i in range(3)) / 24.0
    parts, n = label(energy > limit)
    size = np.bincount(parts.ravel(), minlength=n + 1)
    return (parts > 0) & (size[parts] >= least)


def _extreme(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    padded = np.pad(mask, size // 2, constant_values=not grow)
    windows = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
    return windows.any(axis=(2, 3)) if grow else windows.all(axis=(2, 3))


def closing(mask: np.ndarray, size: int = 7) -> np.ndarray:
    return _extreme(_extreme(mask, size, True), size, False)


def segments(edges: np.ndarray, close: int = 7, least: int = 700, most: int = 200_000, extent: float = 0.05) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of the areas between closed edges that are neither tiny nor huge nor stringy."""
    parts, n = label(~closing(edges, close))
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(parts == i)
        w, h = int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        if least <= len(xs) <= most and len(xs) / (w * h) >= extent:
            out.append((int(xs.min()), int(ys.min()), w, h, len(xs)))
    return out


def outline(points: np.ndarray, per_span: int = 8) -> np.ndarray:
    """Closed smooth curve through corner points (Catmull-Rom)."""
    p = [np.roll(points, k, axis=0) for k in (1, 0, -1, -2)]
    t = (np.arange(per_span) / per_span)[None, :, None]
    a, b, c, d = (q[:, None, :] for q in p)
    return (0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t**2 + (3 * b - a - 3 * c + d) * t**3)).reshape(-1, points.shape[1])


#: Steps around a pixel, clockwise from the left.
AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def contour(mask: np.ndarray) -> np.ndarray:
    """(x, y) of the outer border pixels of the part that is met first in reading order, in order around it."""
    padded = np.pad(mask.astype(bool), 1)
    ys, xs = np.nonzero(padded)
    if not len(ys):
        return np.zeros((0, 2))
    at = start = (int(ys[0]), int(xs[0]))
    came, path = 0, [start]
    for _ in range(4 * len(ys) + 4):
        for turn in range(8):
            k = (came + 1 + turn) % 8
            to = (at[0] + AROUND[k][0], at[1] + AROUND[k][1])
            if padded[to]:
                break
        else:
            break  # a lone pixel
        came, at = (k + 4) % 8, to
        if at == start:
            break
        path.append(at)
    return np.array(path, float)[:, ::-1] - 1


def periodic_basis(t: np.ndarray, n: int) -> np.ndarray:
    """Values at t (0..1) of the n uniform cubic B-splines of a closed curve; each row sums to 1."""
    x = (t % 1.0) * n
    first, f = np.floor(x).astype(int), x - np.floor(x)
    weights = [(1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6]
    out = np.zeros((len(t), n))
    for k, w in enumerate(weights):
        np.add.at(out, (np.arange(len(t)), (first + k) % n), w)
    return out


def closed_spline(border: np.ndarray, controls: int = 16, samples: int = 64, most: float = 0.12) -> tuple[np.ndarray | None, float]:
    """A closed cubic B-spline nearest to a border by least squares, and how far the border lies from it, relative to its
    size; no curve where that is more than `most`, or where the border has fewer than 12 pixels."""
    if len(border) < 12:
        return None, float("inf")
    p = border[np.linspace(0, len(border) - 1, samples).astype(int)]
    steps = np.r_[0.0, np.cumsum(np.linalg.norm(np.diff(np.r_[p, p[:1]], axis=0), axis=1))]
    t = steps[:-1] / max(steps[-1], 1e-12)
    c, *_ = np.linalg.lstsq(periodic_basis(t, controls), p, rcond=None)
    curve = periodic_basis(np.linspace(0, 1, 200), controls) @ c
    off = np.sqrt(((p[:, None] - curve[None]) ** 2).sum(-1)).min(axis=1).mean() / max(np.ptp(border, axis=0).max(), 1.0)
    return (curve if off <= most else None), float(off)


def agreement(normals: np.ndarray) -> float:
    """Sum over neighbours of how much their x, y parts point the same way."""
    xy = normals[..., :2]
    return float((xy[1:] * xy[:-1]).sum() + (xy[:, 1:] * xy[:, :-1]).sum())


def relax(normals: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Turns ambiguous normals (x, y may both change sign) to agree with their blurred surroundings, a few times over."""
    n = normals.copy()
    for _ in range(rounds):
        turn = sum(n[..., i] * blur(n[..., i], 1.7, 9) for i in (0, 1)) < 0
        if not turn.any():
            break
        n[turn, :2] *= -1
    return n


def integrate(p: np.ndarray, q: np.ndarray, rounds: int = 2000, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Height whose differences are nearest to the slopes p (along x) and q (along y), mean 0, and its residual.

    Least squares on forward differences, solved by conjugate gradients.
    """
    h, w = p.shape

    def forward(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(z, axis=1), np.diff(z, axis=0)

    def back(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
        out = np.zeros((h, w))
        out[:, 1:] += gx
        out[:, :-1] -= gx
        out[1:] += gy
        out[:-1] -= gy
        return out

    target = back(p[:, :-1], q[:-1])
    z = np.zeros((h, w))
    r = target.copy()
    d, rr = r.copy(), float((r * r).sum())
    start = rr
    for _ in range(rounds):
        if rr <= tolerance * max(start, 1e-30):
            break
        ad = back(*forward(d))
        step = rr / float((d * ad).sum())
        z += step * d
        r -= step * ad
        new = float((r * r).sum())
        d, rr = r + new / rr * d, new
    gx, gy = forward(z)
    residual = float(np.sqrt((((gx - p[:, :-1]) ** 2).sum() + ((gy - q[:-1]) ** 2).sum()) / max(gx.size + gy.size, 1)))
    return z - z.mean(), residual
