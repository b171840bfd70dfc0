"""Page rasters: enhancement steps before recognition, in numpy on uint8 arrays (height x width, or x 3 in BGR order).

They follow the published formulas of common image libraries; no such library is installed here to compare pixels with.
"""

from __future__ import annotations

import math

import numpy as np

# --- neighbourhoods


def _padded(img: np.ndarray, by: int, mode: str) -> np.ndarray:
    return np.pad(img, by, mode=mode)


def _correlate(img: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    """Rows then columns by one symmetric kernel."""
    r = len(kernel) // 2
    wide = np.pad(img.astype(np.float64), ((0, 0), (r, r)), mode=mode)
    rows = sum(k * wide[:, i : i + img.shape[1]] for i, k in enumerate(kernel))
    tall = np.pad(rows, ((r, r), (0, 0)), mode=mode)
    return sum(k * tall[i : i + img.shape[0]] for i, k in enumerate(kernel))


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x * x) / (2 * sigma * sigma))
    return k / k.sum()


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


# --- steps


def grayscale(bgr: np.ndarray) -> np.ndarray:
    """0.114 B + 0.587 G + 0.299 R in 14-bit fixed point."""
    c = bgr.astype(np.int64)
    return ((c[..., 0] * 1868 + c[..., 1] * 9617 + c[..., 2] * 4899 + 8192) >> 14).astype(np.uint8)


def scale_choice(height: int, width: int, base: float = 2.5) -> float:
    """Small pages grow, very large ones shrink; a base of 1 switches scaling off."""
    if base == 1.0:
        return 1.0
    area = height * width
    return base if area < 1_000_000 else 0.7 if area > 8_000_000 else 1.2


def _cubic_weights(t: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    """Of four neighbours at distance t behind the second, by products from left to right: powers would round otherwise."""
    near = lambda d: (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = lambda d: a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def resize(img: np.ndarray, scale: float) -> np.ndarray:
    """Cubic: the sum over sixteen neighbours, line by line, of value times a line's weight times a column's; exact ties are common, so the order counts."""
    if scale == 1.0:
        return img
    n = [max(1, round(size * scale)) for size in img.shape[:2]]
    at = [(np.arange(k) + 0.5) / scale - 0.5 for k in n]
    base = [np.floor(x).astype(int) for x in at]
    wy, wx = (_cubic_weights(x - b) for x, b in zip(at, base, strict=True))
    place = lambda axis, k: np.clip(base[axis] + k - 1, 0, img.shape[axis] - 1)
    rest = (1,) * (img.ndim - 2)
    out = np.zeros((*n, *img.shape[2:]))
    for i in range(4):
        lines = img[place(0, i)] * wy[i].reshape(-1, 1, *rest)
        for j in range(4):
            out += lines[:, place(1, j)] * wx[j].reshape(-1, *rest)
    return _rounded(out)


def clahe(gray: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: one look-up table for each tile, blended between tiles."""
    h, w = gray.shape
    more = int(h % tiles > 0 or w % tiles > 0)  # either size that tiles don't divide makes both grow
    th, tw = h // tiles + more, w // tiles + more
    big = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")
    area = th * tw
    limit = max(1, int(clip * area / 256))
    tile = np.arange(th * tiles)[:, None] // th * tiles + np.arange(tw * tiles) // tw
    hist = np.bincount((tile * 256 + big).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    spare = np.maximum(hist - limit, 0).sum(axis=1)[:, None]
    # what is left of them goes to levels at equal steps from 0 on
    rest, level = spare % 256, np.arange(256)
    step = 256 // np.maximum(rest, 1)
    hist = np.minimum(hist, limit) + spare // 256 + ((level % step == 0) & (level // step < rest))
    tables = np.clip(np.rint(np.cumsum(hist, axis=1) * 255 / area), 0, 255).reshape(tiles, tiles, 256)

    def spots(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.arange(n) / size - 0.5
        a = np.floor(f).astype(int)
        return np.clip(a, 0, tiles - 1), np.clip(a + 1, 0, tiles - 1), f - a

    y0, y1, fy = spots(h, th)
    x0, x1, fx = spots(w, tw)
    at = lambda y, x: tables[y[:, None], x[None, :], gray]
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    bottom = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return _rounded(top * (1 - fy[:, None]) + bottom * fy[:, None])


def sharpen(gray: np.ndarray, sigma: float = 1.0, alpha: float = 1.5) -> np.ndarray:
    """Unsharp mask: (1 + alpha) image - alpha blur, saturated."""
    size = int(round(sigma * 6 + 1)) | 1
    blur = _rounded(_correlate(gray, gaussian_kernel(size, sigma), "reflect" if min(gray.shape) > size // 2 else "edge"))
    return _rounded((1 + alpha) * gray.astype(np.float64) - alpha * blur)


#: Pixels that denoising works on at a time, so that its arrays stay in a core's cache.
_AT_ONCE = 1 << 15


def _boxes(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size squares of the last two axes, of integers."""
    rows = sum(x[..., i : x.shape[-2] - size + 1 + i, :] for i in range(size))
    return sum(rows[..., i : x.shape[-1] - size + 1 + i] for i in range(size))


def denoise(gray: np.ndarray, h: float = 8.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: every pixel is the mean of its surroundings, weighted by how alike their patches are. One page, or several of one size along a first axis."""
    p, s = patch // 2, search // 2
    mode = "reflect" if min(gray.shape[-2:]) > p + s else "edge"
    wide = np.pad(gray.reshape(-1, *gray.shape[-2:]).astype(np.int32), ((0, 0), (p + s, p + s), (p + s, p + s)), mode=mode)
    rows, cols = gray.shape[-2:]
    out = np.empty((len(wide), rows, cols), np.uint8)
    tall = min(rows, max(1, _AT_ONCE // cols))
    pages = max(1, _AT_ONCE // (tall * cols))
    for i in range(0, len(wide), pages):
        for top in range(0, rows, tall):
            part = wide[i : i + pages, top : top + tall + 2 * (p + s)]
            out[i : i + pages, top : top + tall] = _denoised(part, h, patch, search)
    return out.reshape(gray.shape)


def _denoised(wide: np.ndarray, h: float, patch: int, search: int) -> np.ndarray:
    """The pixels that have their whole surroundings in wide."""
    p, s = patch // 2, search // 2
    rows, cols = (n - 2 * (p + s) for n in wide.shape[1:])
    total, weights = np.zeros((len(wide), rows, cols)), np.zeros((len(wide), rows, cols))
    centre = wide[:, s : s + rows + 2 * p, s : s + cols + 2 * p]
    for dy in range(search):
        for dx in range(search):
            other = wide[:, dy : dy + rows + 2 * p, dx : dx + cols + 2 * p]
            apart = centre - other
            w = np.exp(-(_boxes(apart * apart, patch) / patch**2) / (h * h))
            total += w * other[:, p : p + rows, p : p + cols]
            weights += w
    return _rounded(total / weights)


def adaptive_mean(gray: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    """White where a pixel is brighter than the mean around it less c."""
    r = block // 2
    wide = np.pad(gray.astype(np.int64), r, mode="edge")
    sums = np.pad(np.cumsum(np.cumsum(wide, axis=0), axis=1), ((1, 0), (1, 0)))
    total = sums[block:, block:] - sums[:-block, block:] - sums[block:, :-block] + sums[:-block, :-block]
    mean = np.rint(total / (block * block))
    return np.where(gray > mean - math.ceil(c), 255, 0).astype(np.uint8)


def adaptive_gaussian(gray: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    """The same with a Gaussian-weighted mean."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    mean = np.rint(_correlate(gray, gaussian_kernel(block, sigma), "edge"))
    return np.where(gray > mean - math.ceil(c), 255, 0).astype(np.uint8)


def otsu_level(gray: np.ndarray) -> int:
    """The level that separates dark from light pixels with the greatest variance between them; the least of equals."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(np.int64)
    n, total = int(hist.sum()), int((hist * np.arange(256)).sum())
    dark = np.cumsum(hist)
    sums = np.cumsum(hist * np.arange(256))
    light = n - dark
    # n^2 x variance between, times both sizes, over them: integers until the one division
    top = (sums * n - dark * total).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((dark > 0) & (light > 0), top * top / (dark * light).astype(np.float64), 0.0)
    return int(np.argmax(between))


def otsu(gray: np.ndarray) -> np.ndarray:
    return np.where(gray > otsu_level(gray), 255, 0).astype(np.uint8)


def combine_max(*binary: np.ndarray) -> np.ndarray:
    """Black only where all are black."""
    return np.maximum.reduce(binary)


def threshold(gray: np.ndarray) -> np.ndarray:
    return combine_max(adaptive_gaussian(gray), adaptive_mean(gray), otsu(gray))


def _extreme(img: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum over a size x size square whose anchor is at size // 2; beyond the border counts for nothing."""
    a = size // 2
    wide = np.pad(img, ((a, size - 1 - a), (a, size - 1 - a)), constant_values=255 if least else 0)
    parts = [wide[dy : dy + img.shape[0], dx : dx + img.shape[1]] for dy in range(size) for dx in range(size)]
    return np.minimum.reduce(parts) if least else np.maximum.reduce(parts)


def morphology(binary: np.ndarray) -> np.ndarray:
    """Open by 2 x 2, then close by 3 x 3 (white is foreground: the closing removes small black specks)."""
    opened = _extreme(_extreme(binary, 2, True), 2, False)
    return _extreme(_extreme(opened, 3, False), 3, True)


# --- skew


def edges(binary: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny: Sobel gradients, thinned along their direction, kept from high on, and from low on where they touch kept ones."""
    wide = np.pad(binary.astype(np.int64), 1, mode="edge")
    at = lambda dy, dx: wide[1 + dy : 1 + dy + binary.shape[0], 1 + dx : 1 + dx + binary.shape[1]]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    wide_size = np.pad(size, 1)
    near = lambda dy, dx: wide_size[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    steep = np.abs(gy) / np.maximum(np.abs(gx), 1e-9)
    flat, upright = steep < math.tan(math.pi / 8), steep > math.tan(3 * math.pi / 8)
    same = (gx >= 0) == (gy >= 0)
    first = np.where(flat, near(0, -1), np.where(upright, near(-1, 0), np.where(same, near(-1, -1), near(-1, 1))))
    second = np.where(flat, near(0, 1), np.where(upright, near(1, 0), np.where(same, near(1, 1), near(1, -1))))
    thin = (size > first) & (size >= second)
    strong, weak = thin & (size > high), thin & (size > low)
    while True:
        grown = weak & (_extreme(np.where(strong, 255, 0).astype(np.uint8), 3, False) > 0)
        if (grown == strong).all():
            return np.where(strong, 255, 0).astype(np.uint8)
        strong = grown | strong


def hough(edge: np.ndarray, votes: int) -> list[float]:
    """Angles (theta) of lines with more than so many votes that no neighbour outvotes, most votes first."""
    ys, xs = np.nonzero(edge)
    if len(ys) <= votes:  # no line has more votes than there are pixels
        return []
    theta = np.arange(180) * math.pi / 180
    far = edge.shape[0] + edge.shape[1]
    table = np.zeros((180 + 2, 2 * far + 3), dtype=np.int64)
    for t in range(180):
        rho = np.rint(xs * math.cos(theta[t]) + ys * math.sin(theta[t])).astype(int) + far + 1
        table[t + 1] += np.bincount(rho, minlength=table.shape[1])
    mid = table[1:-1, 1:-1]
    top = (mid > votes) & (mid > table[1:-1, :-2]) & (mid >= table[1:-1, 2:]) & (mid > table[:-2, 1:-1]) & (mid >= table[2:, 1:-1])
    t, r = np.nonzero(top)
    order = np.lexsort((r, t, -mid[t, r]))
    return [float(theta[i]) for i in t[order]]


def skew_of(angles: list[float], most: int = 50) -> float:
    """The median, in degrees, of the first lines' slopes within 30 degrees; 0 without any."""
    slopes = [x for x in (a * 180 / math.pi - 90 for a in angles[:most]) if -30 <= x <= 30]
    return float(np.median(slopes)) if slopes else 0.0


def estimate_skew(binary: np.ndarray) -> float:
    return skew_of(hough(edges(binary), max(100, binary.shape[1] // 10)))


def rotate(img: np.ndarray, angle: float) -> np.ndarray:
    """About the centre, counter-clockwise for positive degrees, same size; cubic, the border repeated."""
    h, w = img.shape[:2]
    cx, cy = w // 2, h // 2
    a = math.radians(angle)
    y, x = np.mgrid[0:h, 0:w]
    sx = math.cos(a) * (x - cx) - math.sin(a) * (y - cy) + cx
    sy = math.sin(a) * (x - cx) + math.cos(a) * (y - cy) + cy
    bx, by = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = _cubic_weights(sx - bx), _cubic_weights(sy - by)
    out = np.zeros(img.shape, dtype=np.float64)
    for i in range(4):
        for j in range(4):
            part = img[np.clip(by + i - 1, 0, h - 1), np.clip(bx + j - 1, 0, w - 1)].astype(np.float64)
            weight = wy[i] * wx[j]
            out += part * (weight[..., None] if img.ndim == 3 else weight)
    return _rounded(out)


def deskew(binary: np.ndarray, angle: float, least: float = 1.0) -> np.ndarray:
    return rotate(binary, angle) if abs(angle) > least else binary


def upright(img: np.ndarray, rotation: int) -> np.ndarray:
    """Undo a page's rotation (a multiple of 90 degrees, as an orientation detector gives it)."""
    return np.rot90(img, k=(-(rotation % 360) // 90) % 4) if rotation % 360 else img


def denoise_all(pages: list[np.ndarray]) -> list[np.ndarray]:
    """denoise of each; pages of one size together."""
    out: list[np.ndarray] = [None] * len(pages)
    for shape in {x.shape for x in pages}:
        at = [i for i, x in enumerate(pages) if x.shape == shape]
        for i, clear in zip(at, denoise(np.stack([pages[i] for i in at])), strict=True):
            out[i] = clear
    return out


def enhance_all(pages: list[np.ndarray], scale: float = 2.5) -> list[np.ndarray]:
    """All steps in order on each page; the binary pages that are recognised."""
    sharp = [sharpen(clahe(grayscale(resize(bgr, scale_choice(bgr.shape[0], bgr.shape[1], scale)))), 1.0, 0.3) for bgr in pages]
    binary = [morphology(threshold(gray)) for gray in denoise_all(sharp)]
    return [deskew(page, estimate_skew(page)) for page in binary]


def enhance(bgr: np.ndarray, scale: float = 2.5) -> np.ndarray:
    """All steps in order; the binary page that is recognised."""
    return enhance_all([bgr], scale)[0]
