"""Image steps on pixels as rows against the same steps on whole pages."""

import numpy as np
import pytest

from escriba.operators import image, points

RASTERS = "img long, height int, width int, pixels array<int>"


def pages():
    """Gray pages of odd sizes: noise on a slope, a flat one, one of two levels, and one with bars."""
    rng = np.random.default_rng(4)
    noise = lambda h, w: np.clip(rng.normal(128, 40, (h, w)) + np.arange(w) * 2 - 40, 0, 255).astype(np.uint8)
    bars = np.full((60, 131), 255, np.uint8)
    bars[20:24], bars[40:43, 5:125], bars[10:50, 64] = 0, 90, 200
    return {1: noise(37, 53), 2: np.full((16, 24), 77, np.uint8), 3: np.where(noise(25, 31) > 128, 255, 0).astype(np.uint8), -4: bars, 2**40: noise(64, 8)}


@pytest.fixture(scope="module")
def rows(spark):
    return points.points_of(spark.createDataFrame([(k, *p.shape, p.ravel().tolist()) for k, p in pages().items()], RASTERS)).repartition(5, "x").cache()


def together(df):
    out = {}
    for img, part in df.select("img", "y", "x", "v").toPandas().groupby("img"):
        page = np.full((part.y.max() + 1, part.x.max() + 1), -1)
        page[part.y, part.x] = part.v
        assert len(part) == page.size and page.min() >= 0
        out[img] = page
    return out


@pytest.mark.parametrize(
    ("rowwise", "whole"),
    [
        (points.sharpen, lambda g: image.sharpen(g, 1.0, 0.3)),
        (points.adaptive_gaussian, image.adaptive_gaussian),
        (points.adaptive_mean, image.adaptive_mean),
        (points.otsu, image.otsu),
        (points.threshold, image.threshold),
        (points.morphology, image.morphology),
        (points.clahe, image.clahe),
        (lambda p: points.edges(p, 60, 300), lambda g: image.edges(g, 60, 300)),
        (points.edges, image.edges),
    ],
)
def test_steps(rows, rowwise, whole):
    got = together(rowwise(rows))
    for img, page in pages().items():
        want = whole(page).astype(int)
        assert got[img].shape == want.shape
        # sums in another order may round a tie the other way
        assert (got[img] != want).mean() <= 0.002


def test_edges_join_weak_pixels_over_any_distance(spark):
    """A long weak line with one strong spot is an edge, one without is none."""
    page = np.full((21, 200), 100, np.uint8)
    page[5:], page[15:] = 130, 160
    page[5:15, 190:] = 230
    want = image.edges(page, 100, 300)
    rows = points.points_of(spark.createDataFrame([(1, *page.shape, page.ravel().tolist())], RASTERS))
    got = together(points.edges(rows, 100, 300))[1]
    assert (got == want).all() and got[4:6, 20].any() and not got[:, 0:2][13:17].all()


def test_skew_of_pages(spark):
    pages, want = [], {}
    for k, slope in enumerate((-0.2, -0.05, 0.0, 0.03, 0.3)):
        y, x = np.mgrid[0:140, 0:220]
        page = np.where(np.abs(y - 70 - slope * (x - 110)) < 3, 0, 255).astype(np.uint8)
        pages.append((k, *page.shape, page.ravel().tolist()))
        want[k] = image.estimate_skew(page)
    pages.append((9, 20, 30, [255] * 600))
    got = {r.img: r.angle for r in points.skews(points.points_of(spark.createDataFrame(pages, RASTERS))).collect()}
    assert got.pop(9) == 0.0 and all(abs(got[k] - want[k]) < 1e-9 for k in want) and abs(got[4] - 17) < 2


def test_gray_of_colours(spark):
    rng = np.random.default_rng(2)
    page = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    rows = points.colours_of(spark.createDataFrame([(1, 5, 7, page.ravel().tolist())], RASTERS))
    assert (together(points.grayscale(rows))[1] == image.grayscale(page)).all()


def test_resize_rounds_exact_ties_as_its_sql():
    """Products and sums in the order of the query's SQL, in plain Python."""
    import math

    near, far = (lambda d: 1.25 * d * d * d - 2.25 * d * d + 1), (lambda d: -0.75 * d * d * d + 3.75 * d * d - 6 * d + 3)
    weights = lambda t: [far(t + 1), near(t), near(1 - t), far(2 - t)]
    for page in np.random.default_rng(11).integers(0, 256, (400, 8, 8)).astype(np.uint8):
        got, v = image.resize(page, 2.5), page.tolist()
        for y in range(2, 20, 5):  # halfway between two lines, so that ties are common
            for x in range(20):
                sy, sx = (y + 0.5) / 2.5 - 0.5, (x + 0.5) / 2.5 - 0.5
                by, bx, total = math.floor(sy), math.floor(sx), 0.0
                wy, wx = weights(sy - by), weights(sx - bx)
                for i in range(4):
                    for j in range(4):
                        total += v[max(0, min(7, by + i - 1))][max(0, min(7, bx + j - 1))] * wy[i] * wx[j]
                assert got[y, x] == max(0, min(255, round(total)))


def test_contrast_makes_no_rows_for_levels_that_no_pixel_has(rows):
    plan = points.clahe(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(0, 255" not in plan and "[0,1,2,3,4" not in plan and plan.count("Join") == 1


@pytest.mark.parametrize("step", [points.otsu, points.clahe, points.edges])
def test_no_pixels_go_through_the_driver(rows, step):
    """Small tables of pixels, too, are shuffled: their files say little of their rows."""
    done = step(rows)
    done.collect()
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
