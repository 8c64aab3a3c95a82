"""Dense kernels in numpy for one tile, slice or chunk at a time, and their grouped Spark forms.

Kernels take and give plain arrays; the grouped forms read long tables (key, y, x, z, value) and
run one kernel per chunk of bounded size: ``per_chunk`` cuts a volume of any size into chunks with halos as wide
as the kernel reaches and keeps the cores, so the result is that of the whole volume; what grows is the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .working import least_labels


def dense(pdf: pd.DataFrame, value: str = "value") -> tuple[np.ndarray, tuple[int, int, int]]:
    """(array, origin) of a long table's bounding box; absent voxels are 0."""
    at = pdf[["y", "x", "z"]].to_numpy()
    low = at.min(0)
    out = np.zeros(at.max(0) - low + 1)
    out[tuple((at - low).T)] = pdf[value].to_numpy()
    return out, tuple(int(v) for v in low)


def gaussian(volume: np.ndarray, sigma: float | tuple[float, ...]) -> np.ndarray:
    """Separable Gaussian smoothing, edges repeated, cut at three sigma."""
    sigmas = (sigma,) * volume.ndim if np.isscalar(sigma) else sigma
    out = volume.astype(float)
    for axis, s in enumerate(sigmas):
        if s <= 0:
            continue
        r = max(1, int(np.ceil(3 * s)))
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        k /= k.sum()
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode="edge")
        out = sum(w * np.take(padded, np.arange(i, i + out.shape[axis]), axis) for i, w in enumerate(k))
    return out


def median_filter(image: np.ndarray, radius: int = 1) -> np.ndarray:
    """Median of the (2r+1)^n box around each element, edges repeated."""
    padded = np.pad(image, radius, mode="edge")
    parts = [padded[tuple(slice(o, o + n) for o, n in zip(offset, image.shape, strict=True))] for offset in product(range(2 * radius + 1), repeat=image.ndim)]
    return np.median(np.stack(parts), 0)


def extreme(image: np.ndarray, radius: int, f: Callable = np.minimum) -> np.ndarray:
    """Erosion (minimum) or dilation (maximum) by a box, one axis after the other."""
    out = image
    for axis in range(image.ndim):
        padded = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
        acc = np.take(padded, np.arange(out.shape[axis]), axis)
        for k in range(1, 2 * radius + 1):
            acc = f(acc, np.take(padded, np.arange(k, k + out.shape[axis]), axis))
        out = acc
    return out


def opening(image: np.ndarray, radius: int) -> np.ndarray:
    return extreme(extreme(image, radius, np.minimum), radius, np.maximum)


def closing(image: np.ndarray, radius: int) -> np.ndarray:
    return extreme(extreme(image, radius, np.maximum), radius, np.minimum)


def without_background(image: np.ndarray, radius: int) -> np.ndarray:
    """What stands out over the smoothed opening; never below 0."""
    return np.maximum(image - gaussian(opening(image, radius), radius / 2), 0)


def difference_of_gaussians(image: np.ndarray, small: float, large: float, factor: float = 1.0) -> np.ndarray:
    return np.maximum(image + factor * (gaussian(image, small) - gaussian(image, large)), 0)


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold of the greatest between-class variance over ``bins`` equal bins."""
    v = np.asarray(values, float).ravel()
    if not len(v) or v.min() == v.max():
        return float(v[0]) if len(v) else 0.0
    n, edges = np.histogram(v, bins)
    mid = (edges[1:] + edges[:-1]) / 2
    w0 = np.cumsum(n)
    w1 = w0[-1] - w0
    m = np.cumsum(n * mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (m / w0 - (m[-1] - m) / w1) ** 2
    between[~np.isfinite(between)] = -1
    best = np.flatnonzero(between >= between.max() * (1 - 1e-12))
    return float(mid[best].mean())


def phase_correlation(reference: np.ndarray, moving: np.ndarray, peaks: int = 5, upsample: int = 10, most: float | None = None) -> tuple[float, float, float]:
    """(dy, dx, correlation) that moves ``moving`` onto ``reference``; the best of the strongest peaks, refined by an upsampled DFT."""
    a, b = (np.fft.fft2(x - x.mean()) for x in (reference, moving))
    cross = a * np.conj(b)
    unit = cross / np.maximum(np.abs(cross), 1e-12)
    surface = np.fft.ifft2(unit).real
    ny, nx = surface.shape
    best = (0.0, 0.0, -2.0)
    for k in np.argsort(-surface.ravel(), kind="stable")[:peaks]:
        dy, dx = (int(i) for i in np.unravel_index(k, surface.shape))
        dy, dx = dy - ny * (dy > ny // 2), dx - nx * (dx > nx // 2)
        if most is not None and max(abs(dy), abs(dx)) > most:
            continue
        c = overlap_correlation(reference, moving, dy, dx)
        if c > best[2]:
            best = (float(dy), float(dx), c)
    if upsample > 1 and best[2] > -2:
        steps = np.arange(-upsample, upsample + 1) / upsample
        fy, fx = np.fft.fftfreq(ny), np.fft.fftfreq(nx)
        rows = np.exp(2j * np.pi * np.outer(best[0] + steps, fy))
        cols = np.exp(2j * np.pi * np.outer(fx, best[1] + steps))
        fine = (rows @ unit @ cols).real
        i, j = np.unravel_index(fine.argmax(), fine.shape)
        best = (best[0] + float(steps[i]), best[1] + float(steps[j]), best[2])
    return best


def overlap_correlation(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> float:
    """Pearson correlation where ``b`` moved by (dy, dx) lies on ``a``."""
    ny, nx = a.shape
    p = a[max(0, dy) : ny + min(0, dy), max(0, dx) : nx + min(0, dx)].ravel()
    q = b[max(0, -dy) : ny + min(0, -dy), max(0, -dx) : nx + min(0, -dx)].ravel()
    if len(p) < 2 or p.std() == 0 or q.std() == 0:
        return -1.0
    return float(np.corrcoef(p, q)[0, 1])


def hessian_eigenvalues(volume: np.ndarray, sigma: float) -> np.ndarray:
    """Eigenvalues, ascending, of the scaled Hessian of a smoothed volume, shape (..., n)."""
    s = gaussian(volume, sigma)
    n = volume.ndim
    first = np.gradient(s)
    h = np.empty((*volume.shape, n, n))
    for i in range(n):
        second = np.gradient(first[i])
        for j in range(n):
            h[..., i, j] = second[j] * sigma * sigma
    return np.linalg.eigvalsh((h + np.swapaxes(h, -1, -2)) / 2)


def blob_seeds(volume: np.ndarray, sigmas: tuple[float, ...], level: float = 0.05, top: float | None = None) -> np.ndarray:
    """Voxels that look like blobs at every scale: all eigenvalues under ``-level * k`` for the k-th scale.

    ``top`` is the greatest value of the whole volume where ``volume`` is a part of it.
    """
    top = volume.max() if top is None else top
    unit = volume / top if top > 0 else volume
    out = np.ones(volume.shape, bool)
    for k, s in enumerate(sigmas, 1):
        out &= (hessian_eigenvalues(unit, s) < -level * k).all(-1)
    return out


def connected(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of connected voxels (26 or 6 neighbours in 3-D), in the order of their first voxel; by least labels and pointer jumping."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    offsets = [o for o in product((-1, 0, 1), repeat=mask.ndim) if o > (0,) * mask.ndim and (corners or sum(map(abs, o)) == 1)]
    pairs = []
    for o in offsets:
        a = label[tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, mask.shape, strict=True))]
        b = label[tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, mask.shape, strict=True))]
        both = (a > 0) & (b > 0)
        pairs.append(np.stack([a[both], b[both]], 1))
    edges = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
    up = np.arange(mask.size + 1)
    while True:
        a, b = up[edges[:, 0]], up[edges[:, 1]]
        if (a == b).all():
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(up, high, low)
        while not (up == up[up]).all():
            up = up[up]
    roots = up[label]
    names, place = np.unique(roots[mask], return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = place.reshape(-1) + 1 if len(names) else 0
    return out


def patch_features(patch: np.ndarray) -> dict[str, float]:
    """Eight measures of a square patch around a point."""
    patch = patch.astype(float)
    n = patch.shape[0]
    c, s = n // 2, max(1, round(n / 8))
    corners = np.concatenate([patch[:s, :s], patch[:s, -s:], patch[-s:, :s], patch[-s:, -s:]], None).mean()
    binary = patch > otsu(patch)
    inner = binary[c - s : c + s + 1, c - s : c + s + 1]
    y, x = np.nonzero(binary)
    away = float(np.hypot(y.mean() - c, x.mean() - c)) if len(y) else 0.0
    return {
        "Max": float(patch.max()), "Mean": float(patch.mean()), "Std": float(patch.std(ddof=1)) if patch.size > 1 else 0.0, "Middle": float(patch[c, c]),
        "MoC": float(patch[c, c] / corners) if corners else 0.0, "Solidity": float(inner.mean()), "FilledArea": float(binary.sum()), "CenDist": away,
    }


def flatfield(images: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(flat, dark) of a stack of slices (n, y, x): smooth rank-one shading fitted with weights that fade outliers; flat has mean 1."""
    x = images.astype(float)
    dark = np.full(x.shape[1:], np.quantile(x, 0.01) if x.size else 0.0)
    smooth = max(x.shape[1:]) / 8
    flat = np.ones(x.shape[1:])
    weight = np.ones_like(x)
    for _ in range(rounds):
        level = (weight * (x - dark) * flat).sum((1, 2)) / np.maximum((weight * flat * flat).sum((1, 2)), 1e-12)
        raw = (weight * (x - dark) * level[:, None, None]).sum(0) / np.maximum((weight * level[:, None, None] ** 2).sum(0), 1e-12)
        flat = gaussian(raw, smooth)
        flat /= flat.mean() if flat.mean() else 1.0
        rest = np.abs(x - dark - level[:, None, None] * flat)
        weight = 1 / (rest / (np.median(rest) + 1e-12) + 0.1)
    return flat, dark


#: Voxels of a chunk along y, x and z.
CHUNK = (256, 256, 64)


def _chunked(pixels: DataFrame, by: list[str], value: str, size: tuple[int, int, int], halo: tuple[int, int, int]) -> DataFrame:
    """by, cy, cx, cz, y, x, z, value, low_*, high_* (of the key's voxels), top: every voxel in its own chunk and in those whose halo it lies in."""
    span = pixels.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in "yxz" for n, f in (("low", F.min), ("high", F.max))], F.max(value).alias("top"))
    j = pixels.select(*by, "y", "x", "z", value).join(span, by)

    def homes(c: str, n: int, h: int) -> Column:
        at = F.col(c) - F.col(f"low_{c}")
        last = F.floor((F.col(f"high_{c}") - F.col(f"low_{c}")) / n)
        return F.sequence(F.greatest(F.floor((at - h) / n), F.lit(0)), F.least(F.floor((at + h) / n), last))

    for c, n, h in zip("yxz", size, halo, strict=True):
        j = j.withColumn(f"c{c}", F.explode(homes(c, n, h))).withColumn(f"c{c}", F.col(f"c{c}").cast("int"))
    return j


def _box(pdf: pd.DataFrame, value: str, size: tuple[int, int, int], halo: tuple[int, int, int]) -> tuple[np.ndarray, tuple[int, ...], tuple[slice, ...]]:
    """The chunk with its halo as far as the volume goes, where it begins, and where the core lies in it."""
    row, begin, core, shape = pdf.iloc[0], [], [], []
    for c, n, h in zip("yxz", size, halo, strict=True):
        low, high = int(row[f"low_{c}"]), int(row[f"high_{c}"])
        first = low + int(row[f"c{c}"]) * n
        a, b = max(low, first - h), min(high, first + n - 1 + h)
        begin.append(a)
        shape.append(b - a + 1)
        core.append(slice(first - a, min(first + n - 1, high) - a + 1))
    out = np.zeros(shape)
    out[tuple((pdf[c].to_numpy() - a) for c, a in zip("yxz", begin, strict=True))] = pdf[value].to_numpy()
    return out, tuple(begin), tuple(core)


def per_chunk(pixels: DataFrame, by: list[str], kernel: Callable[[np.ndarray, float], np.ndarray], size: tuple[int, int, int] = CHUNK, halo: int | tuple[int, int, int] = 0, value: str = "value") -> DataFrame:
    """Run a volume-to-volume kernel on chunks of each key; voxels that become 0 are left out.

    ``kernel`` gets the chunk with its halo, at least as wide as the kernel reaches, and the greatest value of the key.
    """
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    reach = (halo,) * 3 if np.isscalar(halo) else halo

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        volume, begin, core = _box(pdf, value, size, reach)
        out = kernel(volume, float(pdf.top.iloc[0]))[core]
        at = np.nonzero(out)
        head = {k: [pdf[k].iloc[0]] * len(at[0]) for k in by}
        return pd.DataFrame(head | {c: (i + o + s.start).astype(np.int32) for c, i, o, s in zip("yxz", at, begin, core, strict=True)} | {value: out[at].astype(float)})

    return _chunked(pixels, by, value, size, reach).groupBy(*by, "cy", "cx", "cz").applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in by) + f", y int, x int, z int, `{value}` double")


def components(pixels: DataFrame, by: list[str], corners: bool = True, size: tuple[int, int, int] = CHUNK) -> DataFrame:
    """by, y, x, z, label of the connected parts of each key's voxels above 0.

    Chunks that overlap by one voxel are labelled side by side; a voxel of two chunks ties its two labels, and
    tied labels take the least. A label is the number of the part's first voxel in the key's box, from 1, z running fastest.
    """
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    reach = (1, 1, 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        volume, begin, core = _box(pdf, "value", size, reach)
        local = connected(volume > 0, corners)
        at = np.nonzero(local)
        row = pdf.iloc[0]
        n = [int(row[f"high_{c}"]) - int(row[f"low_{c}"]) + 1 for c in "yxz"]
        place = [i.astype(np.int64) + o for i, o in zip(at, begin, strict=True)]
        y, x, z = (p - int(row[f"low_{c}"]) for p, c in zip(place, "yxz", strict=True))
        number = (y * n[1] + x) * n[2] + z + 1
        names = local[at]
        first = np.full(int(names.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, names, number)
        own = np.ones(len(names), bool)
        for i, s in zip(at, core, strict=True):
            own &= (i >= s.start) & (i < s.stop)
        return pd.DataFrame({k: [row[k]] * len(names) for k in by} | {c: p.astype(np.int32) for c, p in zip("yxz", place, strict=True)} | {"label": first[names], "own": own})

    found = _chunked(pixels.where("value > 0"), by, "value", size, reach).groupBy(*by, "cy", "cx", "cz").applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in by) + ", y int, x int, z int, label bigint, own boolean")
    ties = found.groupBy(*by, "y", "x", "z").agg(F.min("label").alias("a"), F.collect_set("label").alias("all")).where(F.size("all") > 1)  # a voxel is in eight chunks at most
    ties = ties.select(*by, "a", F.explode("all").alias("b")).where("a <> b").distinct()
    least = least_labels(ties, by).select(*by, F.col("id").alias("label"), F.col("label").alias("least"))
    return found.where("own").join(least, [*by, "label"], "left").select(*by, "y", "x", "z", F.coalesce("least", "label").alias("label"))


def seeds(pixels: DataFrame, by: list[str], sigmas: tuple[float, ...], level: float = 0.05, size: tuple[int, int, int] = CHUNK) -> DataFrame:
    """Centroids of blob seeds: by, label, y, x, z, size."""
    from .voxels import centroids

    halo = int(np.ceil(3 * max(sigmas))) + 2  # smoothing, then two differences
    bright = per_chunk(pixels, by, lambda v, top: blob_seeds(v, sigmas, level, top).astype(float), size, halo)
    return centroids(components(bright, by, size=size), [*by, "label"])


def align_pairs(pixels: DataFrame, by: list[str], reference: str, moving: str, most: float | None = None) -> DataFrame:
    """by, dy, dx, cc: translation of one channel's slice onto another's (column ``channel``)."""
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ny, nx = int(pdf.y.max()), int(pdf.x.max())
        a, b = (np.zeros((ny, nx)) for _ in range(2))
        for image, name in ((a, reference), (b, moving)):
            part = pdf[pdf.channel == name]
            image[part.y - 1, part.x - 1] = part.value
        dy, dx, cc = phase_correlation(a, b, most=most)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in by} | {"dy": dy, "dx": dx, "cc": cc}])

    return pixels.groupBy(*by).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in by) + ", dy double, dx double, cc double")


def features_of(patches: DataFrame, by: list[str]) -> DataFrame:
    """Eight measures of each patch given in long form (by, y, x, value; y and x from 1)."""
    types = {f.name: f.dataType.simpleString() for f in patches.schema.fields}
    # fixed values: the columns' names
    names = ("Max", "Mean", "Std", "Middle", "MoC", "Solidity", "FilledArea", "CenDist")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf.y.max(), pdf.x.max()))
        image = np.zeros((n, n))
        image[pdf.y - 1, pdf.x - 1] = pdf.value
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in by} | patch_features(image)])

    return patches.groupBy(*by).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in by) + "".join(f", {n} double" for n in names))
