import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from escriba.operators import image
from escriba.operators.engines import Recorded, recognise_page
from escriba.config import Options

RNG = np.random.default_rng(3)
GRAY = RNG.integers(0, 256, (40, 50), dtype=np.uint8)


def test_grayscale():
    assert image.grayscale(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8)).tolist() == [[29, 150, 76, 9]]


def test_adaptive_mean_by_hand():
    wide = np.pad(GRAY.astype(int), 5, mode="edge")
    want = [[255 if GRAY[y, x] > round(wide[y : y + 11, x : x + 11].mean()) - 2 else 0 for x in range(50)] for y in range(40)]
    assert image.adaptive_mean(GRAY).tolist() == want


def test_otsu_by_hand():
    best = max(range(256), key=lambda t: ((GRAY <= t).mean() * (GRAY > t).mean() * (GRAY[GRAY <= t].mean() - GRAY[GRAY > t].mean()) ** 2 if 0 < (GRAY <= t).sum() < GRAY.size else 0, -t))
    assert image.otsu_level(GRAY) == best
    assert image.otsu_level(np.full((4, 4), 7, np.uint8)) == 0


def test_morphology_removes_specks():
    page = np.full((20, 20), 255, np.uint8)
    page[10, 10] = 0  # a black speck goes
    assert (image.morphology(page) == 255).all()
    page[5:12, 5:12] = 0
    assert image.morphology(page)[8, 8] == 0


def test_scale_choice_and_resize():
    assert [image.scale_choice(*x) for x in ((10, 10), (1000, 1000), (4000, 2000), (4000, 2001))] == [2.5, 1.2, 1.2, 0.7]
    assert image.scale_choice(1, 1, 1.0) == 1.0
    assert image.resize(np.full((4, 6), 9, np.uint8), 2.5).shape == (10, 15)
    assert (image.resize(np.full((4, 6), 9, np.uint8), 2.5) == 9).all()


def smooth(h, w, seed=0):
    """A page with slopes, bars and noise, so that every step has something to do."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(120 + 60 * np.sin(x / 5) + 40 * np.cos(y / 4) + 70 * ((x // 7 + y // 9) % 2) - 60 + rng.normal(0, 6, (h, w)), 0, 255).astype(np.uint8)


def alike(got, want, most=0.002):
    """Equal but for pixels that rounding puts on either side of a half."""
    off = np.abs(got.astype(int) - np.array(want))
    return off.max() <= 1 and (off > 0).mean() <= most


def cubic(d, a=-0.75):
    d = abs(d)
    return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0


def spot(img, y, x):
    """The cubic value at a place between pixels."""
    h, w = img.shape
    near = lambda v, n: [(min(max(i, 0), n - 1), cubic(v - i)) for i in range(math.floor(v) - 1, math.floor(v) + 3)]
    return min(255, max(0, round(sum(int(img[i, j]) * a * b for i, a in near(y, h) for j, b in near(x, w)))))


@pytest.mark.parametrize("scale", [2.5, 1.2, 0.7])
def test_resize_by_hand(scale):
    img = smooth(21, 26)
    h, w = round(21 * scale), round(26 * scale)
    want = [[spot(img, (y + 0.5) / scale - 0.5, (x + 0.5) / scale - 0.5) for x in range(w)] for y in range(h)]
    assert alike(image.resize(img, scale), want)


@pytest.mark.parametrize("angle", [3.0, -17.5])
def test_rotate_by_hand(angle):
    img = smooth(24, 31)
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    want = [[spot(img, s * (x - 15) + c * (y - 12) + 12, c * (x - 15) - s * (y - 12) + 15) for x in range(31)] for y in range(24)]
    assert alike(image.rotate(img, angle), want)


@pytest.mark.parametrize("shape", [(64, 96), (50, 70), (48, 61), (5, 90)])
def test_clahe_by_hand(shape):
    img = smooth(*shape)
    h, w = shape
    th, tw = (h // 8, w // 8) if h % 8 == w % 8 == 0 else ((h + 8 - h % 8) // 8, (w + 8 - w % 8) // 8)
    mirror = lambda i, n: i if i < n else 2 * n - 2 - i
    tables = {}
    for i in range(8):
        for j in range(8):
            hist = [0] * 256
            for y in range(i * th, i * th + th):
                for x in range(j * tw, j * tw + tw):
                    hist[img[mirror(y, h), mirror(x, w)]] += 1
            most = max(1, int(3.0 * th * tw / 256))
            spare = sum(n - most for n in hist if n > most)
            hist = [min(n, most) + spare // 256 for n in hist]
            rest = spare % 256
            for k in range(rest):
                hist[k * max(256 // rest, 1)] += 1
            tables[i, j] = [min(255, round(sum(hist[: v + 1]) * 255 / (th * tw))) for v in range(256)]
    want = []
    for y in range(h):
        fy = y / th - 0.5
        row = []
        for x in range(w):
            fx = x / tw - 0.5
            total = 0.0
            for i, a in ((math.floor(fy), math.floor(fy) + 1 - fy), (math.floor(fy) + 1, fy - math.floor(fy))):
                for j, b in ((math.floor(fx), math.floor(fx) + 1 - fx), (math.floor(fx) + 1, fx - math.floor(fx))):
                    total += a * b * tables[min(max(i, 0), 7), min(max(j, 0), 7)][img[y, x]]
            row.append(total)
        want.append(row)
    assert np.abs(image.clahe(img) - np.array(want)).max() < 0.5 + 1e-9
    assert sum(hist) == th * tw


def test_denoise_by_hand():
    img = smooth(18, 20, 5)
    wide = np.pad(img.astype(float), 13, mode="reflect")
    want = np.zeros(img.shape)
    for y in range(18):
        for x in range(20):
            own = wide[y + 10 : y + 17, x + 10 : x + 17]
            top = below = 0.0
            for dy in range(21):
                for dx in range(21):
                    other = wide[y + dy : y + dy + 7, x + dx : x + dx + 7]
                    weight = math.exp(-((own - other) ** 2).mean() / 64)
                    top += weight * other[3, 3]
                    below += weight
            want[y, x] = round(top / below)
    got = image.denoise(img)
    assert alike(got, want) and not alike(got, img)


def test_denoise_of_several_pages_and_of_parts(monkeypatch):
    """Each as alone and whole."""
    pages = [smooth(30, 34, i) for i in range(5)]
    alone = [image.denoise(x) for x in pages]
    for at_once in (1, 34 * 7, 34 * 30 * 2):
        monkeypatch.setattr(image, "_AT_ONCE", at_once)
        assert (image.denoise(np.stack(pages)) == np.stack(alone)).all()
    mixed = [np.stack([x, x, x], axis=-1) for x in (pages[0], smooth(21, 26), pages[1])]
    assert all((a == image.enhance(b)).all() for a, b in zip(image.enhance_all(mixed), mixed, strict=True))


def test_enhance_is_dealt_to_all_tasks_and_spares_unusable_rasters(spark, monkeypatch):
    """F24 enhance: a file of vectors was one task's; pages of one size are denoised together, and one that fails costs only itself."""
    from escriba import registry
    from escriba.operators import rasters
    from escriba.plans import fixtures

    monkeypatch.setattr(fixtures, "RASTERS_A_TASK", 20)
    n = [r["count"] for r in registry._bgr(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) >= sum(n) / 20 and max(n) < 40
    raw = [smooth(8, 9, i).tobytes() for i in range(4)]
    rows = [(0, 8, 9, raw[0] * 3), (1, 8, 9, None), (2, 8, 9, raw[1]), (3, 8, 9, raw[2] * 3), (4, 0, 0, b""), (5, 9, 8, raw[3] * 3), (6, 8, None, raw[0])]
    frame = spark.createDataFrame(rows, "img long, height int, width int, pixels binary").coalesce(1)
    both = [sorted(map(tuple, rasters.map_pixels(frame, **how).collect())) for how in ({"f": image.enhance}, {"several": image.enhance_all})]
    assert both[0] == both[1] and [r[3] is None for r in both[0]] == [False, True, True, False, True, False, True]


def test_gaussian_steps_by_hand():
    img = smooth(30, 34, 2)
    gauss = lambda n, sigma: [math.exp(-((i - n // 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]

    def mean(y, x, n, sigma, mode):
        k = gauss(n, sigma)
        wide = np.pad(img.astype(float), n // 2, mode=mode)
        return round(sum(k[i] * k[j] * wide[y + i, x + j] for i in range(n) for j in range(n)) / sum(k) ** 2)

    at = [(y, x) for y in range(30) for x in range(34)]
    assert alike(image.sharpen(img, 1.0, 0.3).ravel(), [min(255, max(0, round(1.3 * int(img[p]) - 0.3 * mean(*p, 7, 1.0, "reflect")))) for p in at])
    assert image.adaptive_gaussian(img).ravel().tolist() == [255 if img[p] > mean(*p, 11, 2.0, "edge") - 2 else 0 for p in at]


def test_edges_by_hand():
    img = smooth(40, 44, 7)
    h, w = img.shape
    pixel = lambda y, x: int(img[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    slope = {}
    for y in range(h):
        for x in range(w):
            gx = sum(k * (pixel(y + d, x + 1) - pixel(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (pixel(y + 1, x + d) - pixel(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            slope[y, x] = gx, gy
    size = lambda y, x: sum(map(abs, slope.get((y, x), (0, 0))))
    thin = set()
    for (y, x), (gx, gy) in slope.items():
        tilt = math.degrees(math.atan2(abs(gy), abs(gx)))
        dy, dx = (0, 1) if tilt < 22.5 else (1, 0) if tilt > 67.5 else (1, 1) if (gx >= 0) == (gy >= 0) else (1, -1)
        if size(y - dy, x - dx) < size(y, x) >= size(y + dy, x + dx):
            thin.add((y, x))
    found = [p for p in thin if size(*p) > 150]
    kept = set(found)
    while found:
        y, x = found.pop()
        for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if p in thin and p not in kept and size(*p) > 50:
                kept.add(p)
                found.append(p)
    assert {tuple(p) for p in np.argwhere(image.edges(img)).tolist()} == kept and 0 < len(kept) < len(thin)


def test_flat_pages_stay_flat():
    flat = np.full((30, 30), 120, np.uint8)
    for f in (image.sharpen, image.denoise):
        assert (f(flat) == 120).all()
    assert len(np.unique(image.clahe(flat))) == 1


def test_skew_of():
    rad = lambda d: (d + 90) * np.pi / 180
    assert image.skew_of([rad(2), rad(4), rad(40)]) == pytest.approx(3)
    assert image.skew_of([]) == 0.0
    assert image.skew_of([rad(5)] * 50 + [rad(-20)] * 90) == pytest.approx(5)


def test_skew_of_a_tilted_page():
    page = np.full((300, 300), 255, np.uint8)
    for y in range(40, 280, 40):
        page[y : y + 4, 20:280] = 0
    tilted = image.rotate(page, -5.0)
    assert image.estimate_skew(tilted) == pytest.approx(5.0, abs=1.0)
    assert abs(image.estimate_skew(image.deskew(tilted, image.estimate_skew(tilted)))) <= 1.0
    assert image.deskew(page, 0.5) is page


def test_upright():
    img = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert image.upright(img, 0) is img and image.upright(img, 90).shape == (3, 2)
    assert (image.upright(np.rot90(img, 1), 90) == img).all()


def test_engine_survives_failures():
    class Broken(Recorded):
        def rotation(self, img):
            raise RuntimeError

        def words(self, img, language, segmentation, model):
            if segmentation == "4":
                raise RuntimeError
            return "t", [70.0]

    page = np.full((12, 12, 3), 200, np.uint8)
    assert recognise_page(page, Broken(), "spa", Options(), enhance=False) == ("t", False, 70.0)


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    from escriba.operators import rasters
    from escriba.sources.files import images

    (tmp_path / "a.png").write_bytes(png(np.array([[[255, 0, 0], [0, 255, 0]]], np.uint8)))
    (tmp_path / "b.png").write_bytes(png(np.array([[7, 8]], np.uint8)))
    (tmp_path / "c.png").write_bytes(b"no image")
    got = sorted(images(spark, str(tmp_path)).select("pixels").collect())
    assert [list(r.pixels) for r in got] == [[0, 0, 255, 0, 255, 0], [7, 7, 7, 8, 8, 8]]
    gray = rasters.map_pixels(images(spark, str(tmp_path)), image.grayscale).select("pixels").collect()
    assert sorted(list(r.pixels) for r in gray) == [[7, 8], [76, 150]]
