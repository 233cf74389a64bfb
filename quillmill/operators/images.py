"""Raster heuristics on gray arrays, in numpy alone."""

from __future__ import annotations

from collections import Counter

import numpy as np

from quillmill.operators.redaction import components, parts


def _runs_at_least(mask: np.ndarray, length: int) -> np.ndarray:
    """Cells of each line that lie in a run of at least ``length``: an opening with a flat line."""
    out = np.zeros_like(mask)
    for y in np.flatnonzero(mask.any(axis=1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= length:
                out[y, a:b] = True
    return out


def table_grid(gray: np.ndarray, least_ratio: float = 0.3) -> dict:
    """Long lines across and down; two of each make a grid."""
    dark = gray < 200
    across = _runs_at_least(dark, max(1, int(gray.shape[1] * least_ratio)))
    down = _runs_at_least(dark.T, max(1, int(gray.shape[0] * least_ratio))).T
    h, v = len(components(across)), len(components(down))
    return {"has_grid": h >= 2 and v >= 2, "horizontal_lines": h, "vertical_lines": v, "cell_count": len(components(across & down))}


def blur_score(gray: np.ndarray | None) -> float | None:
    """Variance of the Laplacian; None for what is no image."""
    if gray is None or gray.ndim != 2 or min(gray.shape) < 3:
        return None
    g = gray.astype(np.float64)
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def histogram_facts(gray: np.ndarray) -> dict:
    share = np.bincount(gray.ravel().astype(np.int64), minlength=256)[:256] / max(1, gray.size)
    used = np.flatnonzero(share > 0.001)
    spread = (used[-1] - used[0]) / 255 if used.size else 0.0
    mid = share[1:-1]
    peaks = int(((mid > share[:-2]) & (mid > share[2:]) & (mid > 0.01)).sum())
    noise = float(share[:30].sum())
    return {"noise_floor": noise, "dynamic_range": float(spread), "peak_count": peaks, "is_scanned": bool(noise > 0.02 or (spread > 0.7 and peaks < 3))}


def otsu(gray: np.ndarray, compatible: bool = True) -> dict:
    """Threshold of the greatest variance between the classes.

    ``compatible`` keeps the ratio of raw-count variance to normalised one, by
    which nearly every image is bimodal and a two-valued one isn't; without it
    both are normalised.
    """
    count = np.bincount(gray.ravel().astype(np.int64), minlength=256)[:256].astype(float)
    total = count.sum()
    if total == 0:
        return {"threshold": 128, "variance_ratio": 0.0, "is_bimodal": False}
    level = np.arange(256)
    below = np.cumsum(count)
    above = total - below
    mass = np.cumsum(level * count)
    ok = (below > 0) & (above > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, below * above * (mass / below - (mass[-1] - mass) / above) ** 2, 0.0)
    t = int(between.argmax()) if between.max() > 0 else 0
    low, high = gray[gray <= t], gray[gray > t]
    within = (len(low) * (low.var() if len(low) else 0) + len(high) * (high.var() if len(high) else 0)) / total
    top = between.max() if compatible else between.max() / total**2
    ratio = float(top / within) if within > 0 else 0.0
    return {"threshold": t, "variance_ratio": ratio, "is_bimodal": ratio > 1.0}


def has_ruled_lines(gray: np.ndarray) -> bool:
    """Ten or more long lines, evenly spaced."""
    least = int(gray.shape[1] * 0.4)
    rows = np.flatnonzero(_runs_at_least(gray < 200, max(1, least)).sum(axis=1) > least * 0.5)
    if rows.size < 10:
        return False
    gaps = np.diff(rows)
    gaps = gaps[gaps > 15]
    return bool(gaps.size >= 5 and gaps.std() / gaps.mean() < 0.3)


def local_mean(gray: np.ndarray, size: int) -> np.ndarray:
    """Mean of the neighbourhood under a Gaussian of the given odd width."""
    at = np.arange(size) - size // 2
    weight = np.exp(-(at**2) / (2 * (0.3 * ((size - 1) * 0.5 - 1) + 0.8) ** 2))
    weight /= weight.sum()
    out = gray.astype(np.float64)
    for axis in (0, 1):
        pad = np.pad(out, [(size // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = out.shape[axis]
        out = sum(w * (pad[k : k + n] if axis == 0 else pad[:, k : k + n]) for k, w in enumerate(weight))
    return out


def local_dark(gray: np.ndarray, size: int = 21, offset: float = 10.0) -> np.ndarray:
    """Darker than the mean of the neighbourhood by more than ``offset``."""
    return gray < local_mean(gray, size) - offset


def glyph_regularity(gray: np.ndarray) -> float | None:
    """How many glyphs are about as high as most are, as a score; None for fewer than 50."""
    h, w = gray.shape
    heights = [b[3] for b in components(local_dark(gray)) if 5 <= b[3] <= h * 0.1 and 20 <= b[2] * b[3] and b[2] * b[3] <= h * w * 0.01 and 0.1 <= b[2] / b[3] <= 3]
    if len(heights) < 50:
        return None
    mode = Counter(heights).most_common(1)[0][0]
    near = np.abs(np.array(heights) - mode) <= max(mode * 0.25, 3)
    return float(min(1.0, max(0.0, (near.mean() - 0.3) / 0.4)))


#: Neighbours of a cell, clockwise from the right.
_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def outline(mask: np.ndarray, x: int, y: int) -> np.ndarray:
    """Border cells (x, y) of the part whose first cell is (x, y), clockwise."""
    h, w = mask.shape
    filled = lambda p: 0 <= p[0] < w and 0 <= p[1] < h and mask[p[1], p[0]]
    points, at, came = [(x, y)], (x, y), 5
    first = None
    while True:
        for k in range(8):
            d = (came + 1 + k) % 8
            to = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if filled(to):
                break
        else:
            return np.array(points)
        if at == (x, y):
            if first is None:
                first = d
            elif d == first:
                return np.array(points[:-1])
        points.append(to)
        at, came = to, (d + 4) % 8 + (1 if d % 2 else 0)
        came %= 8


def polygon_corners(points: np.ndarray, tolerance: float) -> int:
    """Corners that are left of a closed outline when it may move by ``tolerance``."""
    if len(points) < 3:
        return len(points)
    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    ring = np.concatenate([points, points[:1]]).astype(float)
    keep, todo = {0, far}, [(0, far), (far, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, rel = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        size = np.hypot(*line)
        off = np.abs(line[0] * rel[:, 1] - line[1] * rel[:, 0]) / size if size else np.hypot(rel[:, 0], rel[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return len(keep)


def contour_regularity(gray: np.ndarray, tolerance: float = 0.02) -> float:
    """Evenness of the glyph outlines' corner counts as a score; 0.5 for fewer than ten glyphs."""
    dark = local_dark(gray)
    found = parts(dark)
    corners = []
    for (_, y, _, _), x in found if len(found) >= 10 else []:
        ring = outline(dark, x, y)
        step = np.diff(np.concatenate([ring, ring[:1]]), axis=0)
        area = abs(float((ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]).sum())) / 2
        if 20 <= area <= gray.size * 0.01:
            corners.append(polygon_corners(ring, tolerance * float(np.hypot(step[:, 0], step[:, 1]).sum())))
    if len(corners) < 10:
        return 0.5
    n = np.array(corners, float)
    return float(min(1.0, max(0.0, 1 - (n.std() / n.mean() - 0.2) / 0.6)))


def text_photo_mask(gray: np.ndarray, block: int = 32, least_edges: float = 0.05, least_entropy: float = 5.0) -> np.ndarray:
    """True for blocks that look like photographs: many levels, few edges."""
    rows, cols = max(1, gray.shape[0] // block), max(1, gray.shape[1] // block)
    out = np.zeros((rows, cols), bool)
    g = gray.astype(np.int64)
    for y in range(rows):
        for x in range(cols):
            part = g[y * block : (y + 1) * block, x * block : (x + 1) * block]
            p = np.bincount(part.ravel(), minlength=256) / part.size
            p = p[p > 0]
            edges = (np.abs(np.diff(part, axis=1)) > 60).mean() if part.shape[1] > 1 else 0.0
            out[y, x] = -(p * np.log2(p)).sum() >= least_entropy and edges < least_edges
    return out


def find_lines(gray: np.ndarray, least: int = 100, gap: int = 10, votes: int = 100) -> list[tuple[float, float, float, float]]:
    """Straight segments within 45 degrees of level, the left end first.

    Edge cells vote for lines by angle (whole degrees) and distance; the line
    with most votes gives its cells, cut at gaps, until none has enough.
    """
    g = gray.astype(np.float64)
    if min(g.shape) < 3:
        return []
    down = np.abs(g[2:, 1:-1] - g[:-2, 1:-1]) * 2 + np.abs(g[2:, 2:] - g[:-2, 2:]) + np.abs(g[2:, :-2] - g[:-2, :-2])
    edge = down > 150
    edge[1:] &= ~(edge[:-1] & (down[:-1] >= down[1:]))  # one cell of a thick edge
    y, x = np.nonzero(edge)
    angles = np.radians(np.arange(-44, 45))
    wide = int(np.hypot(*g.shape)) + 2
    out = []
    while len(x) >= votes:
        rho = np.rint(y[None, :] * np.cos(angles)[:, None] - x[None, :] * np.sin(angles)[:, None]).astype(np.int64) + wide
        count = np.bincount((rho + np.arange(len(angles))[:, None] * 3 * wide).ravel(), minlength=len(angles) * 3 * wide)
        best = int(count.argmax())
        if count[best] < votes:
            break
        a, r = divmod(best, 3 * wide)
        on = np.abs(rho[a] - r) <= 1
        along = (x * np.cos(angles[a]) + y * np.sin(angles[a]))[on]
        order = np.argsort(along, kind="stable")
        sx, sy, along = x[on][order], y[on][order], along[order]
        cuts = np.flatnonzero(np.diff(along) > gap) + 1
        for i, j in zip([0, *cuts.tolist()], [*(cuts - 1).tolist(), len(along) - 1]):
            if along[j] - along[i] >= least:
                out.append((float(sx[i]), float(sy[i]), float(sx[j]), float(sy[j])))
        x, y = x[~on], y[~on]
    return out


def rotate(gray: np.ndarray, angle: float) -> np.ndarray:
    """Turned by ``angle`` degrees around the middle, in between by neighbours, white outside."""
    h, w = gray.shape
    cx, cy = w // 2, h // 2
    t = np.radians(angle)
    gy, gx = np.mgrid[0:h, 0:w]
    sx = np.cos(t) * (gx - cx) - np.sin(t) * (gy - cy) + cx
    sy = np.sin(t) * (gx - cx) + np.cos(t) * (gy - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    pad = np.pad(gray.astype(np.float64), 1, constant_values=255)
    at = lambda yy, xx: pad[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]
    fx, fy = sx - x0, sy - y0
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def gray_of(image: np.ndarray) -> np.ndarray:
    """A gray page of a raster with or without colours."""
    if image.ndim == 2:
        return image
    if image.shape[2] < 3:
        return image[..., 0]
    return np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def prepare_for_ocr(image: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(gray page, steps): straightened where it is askew, then left as it is if clean, else made black and white."""
    gray, steps = gray_of(image), []
    angle, confidence = skew_angle(find_lines(gray))
    if needs_deskew(angle, confidence):
        gray = rotate(gray, angle)
        steps.append("deskew")
    facts = histogram_facts(gray)
    if not facts["is_scanned"] and facts["dynamic_range"] > 0.1:
        return gray, [*steps, "binarise_skipped"]
    cut = otsu(gray)
    if cut["is_bimodal"]:
        return np.where(gray > cut["threshold"], 255, 0).astype(np.uint8), [*steps, "otsu_binarise"]
    return np.where(gray > local_mean(gray, 31) - 10, 255, 0).astype(np.uint8), [*steps, "adaptive_binarise"]


def _cross(mask: np.ndarray, every: bool) -> np.ndarray:
    """Erosion (``every``) or dilation by a cell and its four neighbours; nothing lies outside."""
    pad = np.pad(mask, 1, constant_values=every)
    shifts = (pad[1:-1, 1:-1], pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:])
    return np.logical_and.reduce(shifts) if every else np.logical_or.reduce(shifts)


def skeleton(mask: np.ndarray, compatible: bool = True, rounds: int = 10) -> np.ndarray:
    """``compatible``: what ten erosions leave, so strokes of ordinary width vanish; without it the cells that openings lose, which are the strokes' middles."""
    out, now = np.zeros_like(mask), mask
    for _ in range(rounds):
        thin = _cross(now, True)
        lost = now & ~_cross(thin, False)
        out |= lost
        now = thin
        if not lost.any():
            break
    return now if compatible else out


def distances(mask: np.ndarray, most: int = 32) -> np.ndarray:
    """Distance of each cell of the mask to the nearest cell outside it, right up to ``most``."""
    h, w = mask.shape
    rows = np.arange(h)[:, None]
    above = rows - np.maximum.accumulate(np.where(mask, -(10**6), rows), axis=0)
    below = np.minimum.accumulate(np.where(mask, 10**6, rows)[::-1], axis=0)[::-1] - rows
    g = np.minimum(above, below).astype(np.float64)
    best = g**2
    for d in range(1, min(most, w - 1) + 1):
        best[:, d:] = np.minimum(best[:, d:], g[:, :-d] ** 2 + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], g[:, d:] ** 2 + d * d)
    return np.where(mask, np.sqrt(np.minimum(best, 10.0**9)), 0.0)


def stroke_widths(gray: np.ndarray, compatible: bool = True) -> np.ndarray:
    """Distances to the background along the strokes' skeleton."""
    dark = local_dark(gray)
    return distances(dark)[skeleton(dark, compatible)]


def skew_angle(lines: list[tuple[float, float, float, float]]) -> tuple[float, float]:
    """(median angle, confidence) of line segments within 45 degrees; (0, 0) for fewer than five."""
    angles = np.array([np.degrees(np.arctan2(y1 - y0, x1 - x0)) for x0, y0, x1, y1 in lines])
    angles = angles[np.abs(angles) <= 45]
    if angles.size < 5:
        return 0.0, 0.0
    return float(np.median(angles)), float(min(1.0, max(0.0, 1 - angles.std() / 10)))


def needs_deskew(angle: float, confidence: float) -> bool:
    return abs(angle) > 0.5 and confidence > 0.3


def stroke_consistency(widths: np.ndarray) -> float | None:
    """Evenness of stroke widths; None for fewer than 100 of them."""
    w = widths[widths > 1.0]
    if w.size < 100:
        return None
    return float(min(1.0, max(0.0, 1 - (w.std() / w.mean() - 0.1) / 0.4)))
