"""Image steps on pixels as rows: img, height, width, y, x, v, one channel, for pages of any size.

Neighbourhoods are sliding frames of window functions along rows and columns, so a task holds a line and never a page; borders are rows, too (padded). Histograms are aggregations, look-up tables
running sums over them, and pixels find the tables of their image by a join. The formulas are those of operators.image, which works on a whole page in a task's memory; where pages fit, it is the
cheaper way.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..storage import keep
from .image import gaussian_kernel
from .rasters import as_points as points_of
from .rasters import levels, skew


def row() -> WindowSpec:
    """Along the pixels of a line."""
    return Window.partitionBy("img", "y").orderBy("x")


def column() -> WindowSpec:
    return Window.partitionBy("img", "x").orderBy("y")


def colours_of(rasters: DataFrame) -> DataFrame:
    """A row for each pixel of BGR rasters: b, g and r in place of v."""
    if dict(rasters.dtypes)["pixels"] == "binary":
        rasters = rasters.withColumn("pixels", levels(F.col("pixels")))
    at = lambda i, k: F.get("pixels", i * 3 + k)
    whole = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.struct(at(i, 0).alias("b"), at(i, 1).alias("g"), at(i, 2).alias("r")))
    cells = rasters.select("img", "height", "width", F.posexplode(whole).alias("pos", "c"))
    return cells.select("img", "height", "width", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).cast("int").alias("x"), "c.b", "c.g", "c.r")


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles. Spark knows tables of pixels by their compressed bytes, and would send millions of rows through the driver because they make few MB."""
    return left.join(right.hint("merge"), on, how)


def _byte(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(x))).cast("int")


def grayscale(colours: DataFrame) -> DataFrame:
    return colours.select("img", "height", "width", "y", "x", F.shiftright(F.col("b") * 1868 + F.col("g") * 9617 + F.col("r") * 4899 + 8192, 14).cast("int").alias("v"))


def _places(at: Column, size: Column, before: Column, after: Column, mode: str) -> Column:
    """Where a pixel at a place stands if a line of that size is continued by so many pixels on either side."""
    own = F.array(at)
    if mode == "edge":
        none = F.array().cast("array<int>")
        first = F.when((at == 0) & (before > 0), F.sequence(-before, F.lit(-1))).otherwise(none)
        last = F.when((at == size - 1) & (after > 0), F.sequence(size, size + after - 1)).otherwise(none)
        return F.concat(own, first, last)
    # mirrored, without the border itself
    mirrored = F.array(F.when((at >= 1) & (at <= before), -at), F.when((at <= size - 2) & (at >= size - 1 - after), 2 * (size - 1) - at))
    return F.concat(own, F.filter(mirrored, lambda p: p.isNotNull()))


def padded(points: DataFrame, top: int | Column, bottom: int | Column, left: int | Column, right: int | Column, mode: str) -> DataFrame:
    """points with rows for the pixels beyond the borders: the border's own (edge), or mirrored ones (reflect)."""
    col = lambda n: F.lit(n) if isinstance(n, int) else n
    tall = points.withColumn("y", F.explode(_places(F.col("y"), F.col("height"), col(top), col(bottom), mode)))
    return tall.withColumn("x", F.explode(_places(F.col("x"), F.col("width"), col(left), col(right), mode)))


def _in_row() -> Column:
    return (F.col("x") >= 0) & (F.col("x") < F.col("width"))


def _in_column() -> Column:
    return (F.col("y") >= 0) & (F.col("y") < F.col("height"))


def _near(name: str, k: int, window) -> Column:
    """The value k places on along a window."""
    return F.lead(name, k).over(window) if k > 0 else F.lag(name, -k).over(window) if k < 0 else F.col(name)


def blurred(points: DataFrame, kernel: list[float], mode: str, into: str) -> DataFrame:
    """points with a column of weighted means: rows, then columns, by one symmetric kernel."""
    r = len(kernel) // 2
    weigh = lambda name, window: reduce(Column.__add__, [F.lit(w) * _near(name, i - r, window) for i, w in enumerate(kernel)])
    wide = padded(points, r, r, r, r, mode).withColumn("_row", weigh("v", row())).where(_in_row())
    return wide.withColumn(into, weigh("_row", column())).where(_in_column()).drop("_row")


def sharpen(points: DataFrame, sigma: float = 1.0, alpha: float = 0.3) -> DataFrame:
    """Unsharp mask. Images have more lines and columns than half the kernel."""
    size = int(round(sigma * 6 + 1)) | 1
    soft = blurred(points, gaussian_kernel(size, sigma).tolist(), "reflect", "_blur")
    return soft.withColumn("v", _byte((1 + alpha) * F.col("v") - F.lit(alpha) * _byte(F.col("_blur")))).drop("_blur")


def adaptive_gaussian(points: DataFrame, block: int = 11, c: float = 2, into: str = "v") -> DataFrame:
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    soft = blurred(points, gaussian_kernel(block, sigma).tolist(), "edge", "_mean")
    return soft.withColumn(into, F.when(F.col("v") > F.rint("_mean") - math.ceil(c), 255).otherwise(0)).drop("_mean")


def adaptive_mean(points: DataFrame, block: int = 11, c: float = 2, into: str = "v") -> DataFrame:
    """Sums of a square by sums of a row's stretch, and of those along columns."""
    r = block // 2
    wide = padded(points, r, r, r, r, "edge").withColumn("_row", F.sum("v").over(row().rowsBetween(-r, r))).where(_in_row())
    summed = wide.withColumn("_sum", F.sum("_row").over(column().rowsBetween(-r, r))).where(_in_column())
    return summed.withColumn(into, F.when(F.col("v") > F.rint(F.col("_sum") / (block * block)) - math.ceil(c), 255).otherwise(0)).drop("_row", "_sum")


def otsu_levels(points: DataFrame) -> DataFrame:
    """img and level: of each image's histogram the least level that separates dark from light with the greatest variance between them."""
    histogram = points.groupBy("img", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img")
    sums = histogram.select("img", "v", F.sum("n").over(up).alias("dark"), F.sum(F.col("n") * F.col("v")).over(up).alias("of_dark"), F.sum("n").over(whole).alias("all"), F.sum(F.col("n") * F.col("v")).over(whole).alias("of_all"))
    apart = (F.col("of_dark") * F.col("all") - F.col("dark") * F.col("of_all")).cast("double")
    light = F.col("all") - F.col("dark")
    score = F.when(light > 0, apart * apart / (F.col("dark") * light).cast("double")).otherwise(F.lit(0.0))
    best = sums.groupBy("img").agg(F.max(F.struct(score.alias("score"), (-F.col("v")).alias("below"))).alias("best"))
    return best.select("img", F.when(F.col("best.score") > 0, -F.col("best.below")).otherwise(F.lit(0)).alias("level"))


def otsu(points: DataFrame, into: str = "v") -> DataFrame:
    return _met(points, otsu_levels(points), ["img"]).withColumn(into, F.when(F.col("v") > F.col("level"), 255).otherwise(0)).drop("level")


def threshold(points: DataFrame) -> DataFrame:
    """White where any of the three ways says so."""
    every = adaptive_gaussian(adaptive_mean(otsu(points, into="_otsu"), into="_mean_bit"), into="_gauss_bit")
    return every.withColumn("v", F.greatest("_otsu", "_mean_bit", "_gauss_bit")).drop("_otsu", "_mean_bit", "_gauss_bit")


def morphology(points: DataFrame) -> DataFrame:
    """Open by 2 x 2, close by 3 x 3: running extremes along rows and columns, in an order that leaves neighbouring steps on the same lines."""
    steps = [(F.min, row(), (-1, 0)), (F.min, column(), (-1, 0)), (F.max, column(), (-1, 0)), (F.max, row(), (-1, 0)), (F.max, row(), (-1, 1)), (F.max, column(), (-1, 1)), (F.min, column(), (-1, 1)), (F.min, row(), (-1, 1))]
    for extreme, line, frame in steps:
        points = points.withColumn("v", extreme("v").over(line.rowsBetween(*frame)))
    return points


# --- contrast by tiles


def clahe(points: DataFrame, clip: float = 3.0, tiles: int = 8) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation: a table for each of tiles x tiles tiles, and each pixel blended from the tables of the four tiles around it."""
    more = ((F.col("height") % tiles > 0) | (F.col("width") % tiles > 0)).cast("int")
    sized = points.withColumns({"th": F.floor(F.col("height") / tiles).cast("int") + more, "tw": F.floor(F.col("width") / tiles).cast("int") + more})
    big = padded(sized, 0, F.col("th") * tiles - F.col("height"), 0, F.col("tw") * tiles - F.col("width"), "reflect")
    tile = [F.floor(F.col("y") / F.col("th")).cast("int").alias("ty"), F.floor(F.col("x") / F.col("tw")).cast("int").alias("tx")]
    counted = big.groupBy("img", "th", "tw", *tile, "v").agg(F.count("*").alias("n"))
    keys = ["img", "ty", "tx"]
    area = (F.col("th") * F.col("tw")).cast("long")
    limit = F.greatest(F.lit(1), F.floor(F.lit(clip) * area / 256).cast("long"))
    # only levels that a tile has are rows; the sum of clipped counts stands still between them
    line = Window.partitionBy(*keys).orderBy("v")
    seen = F.sum(F.least(F.col("n"), limit)).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    levelled = counted.select(*keys, "v", area.alias("area"), F.greatest(F.col("n") - limit, F.lit(0)).alias("over"), seen.alias("seen"), F.lead("v", 1, 256).over(line).alias("next"))
    steps = F.array_sort(F.collect_list(F.struct("v", "seen", "next")))
    held = levelled.groupBy(*keys, "area").agg(F.sum("over").alias("spare"), steps.alias("steps"))
    # small tiles are read by their few steps, others by an array of all levels
    large = F.col("area") > 64
    levels_of = F.flatten(F.concat(F.array(F.array_repeat(F.lit(0), F.get("steps", F.lit(0))["v"])), F.transform("steps", lambda s: F.array_repeat(s["seen"], s["next"] - s["v"]))))
    tile_of = F.struct((F.col("ty") * tiles + F.col("tx")).alias("place"), "spare", F.when(~large, F.transform("steps", lambda s: F.struct(s["v"].alias("v"), s["seen"].alias("seen")))).alias("steps"), F.when(large, levels_of).alias("levels"))
    found = held.select("img", tile_of.alias("t")).groupBy("img").agg(F.array_sort(F.collect_list("t"), lambda a, b: a["place"] - b["place"]).alias("found"))
    every = F.transform(F.sequence(F.lit(0), F.lit(tiles * tiles - 1)), lambda i: F.get(F.filter("found", lambda t: t["place"] == i), F.lit(0)))
    tables = found.select("img", F.when(F.size("found") == tiles * tiles, F.col("found")).otherwise(every).alias("tables"))
    # the four tiles around a pixel, and how far it is between them
    spot = lambda at, size: F.col(at) / F.col(size) - 0.5
    within = lambda k: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), k)).cast("int")
    y, x = F.floor(spot("y", "th")), F.floor(spot("x", "tw"))

    def to(t: Column) -> Column:
        # what stood above the limit went to all levels alike, the rest to every so-manieth level
        rest = t["spare"] % 256
        step = F.greatest(F.lit(1), F.floor(256 / F.greatest(rest, F.lit(1))))
        extra = F.when(rest > 0, F.least(rest, F.floor(F.col("v") / step) + 1)).otherwise(F.lit(0))
        below = F.when(t["levels"].isNotNull(), F.get(t["levels"], F.col("v"))).otherwise(F.aggregate(t["steps"], F.lit(0), lambda a, s: F.when(s["v"] <= F.col("v"), s["seen"]).otherwise(a)))
        return _byte((below + (F.col("v") + 1) * F.floor(t["spare"] / 256) + extra) * 255 / area)

    around = F.array(*(within(y + i // 2) * tiles + within(x + i % 2) for i in range(4)))
    asked = _met(sized, tables, ["img"]).withColumns({"fy": spot("y", "th") - y, "fx": spot("x", "tw") - x, "c": F.transform(F.transform(around, lambda i: F.get("tables", i)), to)})
    c = lambda i: F.get("c", F.lit(i))
    top = c(0) * (1 - F.col("fx")) + c(1) * F.col("fx")
    low = c(2) * (1 - F.col("fx")) + c(3) * F.col("fx")
    return asked.select("img", "height", "width", "y", "x", _byte(top * (1 - F.col("fy")) + low * F.col("fy")).alias("v"))


# --- edges and skew


def gradients(points: DataFrame) -> DataFrame:
    """points with gx, gy (Sobel) and size, the sum of both."""
    wide = padded(points, 1, 1, 1, 1, "edge")
    across = wide.withColumns({"_d": _near("v", 1, row()) - _near("v", -1, row()), "_s": _near("v", -1, row()) + 2 * F.col("v") + _near("v", 1, row())}).where(_in_row())
    down = across.withColumns({"gx": _near("_d", -1, column()) + 2 * F.col("_d") + _near("_d", 1, column()), "gy": _near("_s", 1, column()) - _near("_s", -1, column())}).where(_in_column())
    return down.drop("_d", "_s").withColumn("size", F.abs("gx") + F.abs("gy"))


def thinned(points: DataFrame, low: float, high: float) -> DataFrame:
    """img, height, width, y, x and strong of the pixels whose gradient is above low and no smaller than its neighbours' along it."""
    size = gradients(points)
    tall = size.withColumns({"up": F.coalesce(_near("size", -1, column()), F.lit(0)), "down": F.coalesce(_near("size", 1, column()), F.lit(0))})
    beside = lambda name, k: F.coalesce(_near(name, k, row()), F.lit(0))
    around = tall.withColumns({f"{a}_{b}": beside(a, k) for a in ("size", "up", "down") for b, k in (("left", -1), ("right", 1))})
    steep = F.abs("gy") / F.greatest(F.abs(F.col("gx")).cast("double"), F.lit(1e-9))
    same = (F.col("gx") >= 0) == (F.col("gy") >= 0)
    along = lambda flat, upright, falling, rising: F.when(steep < math.tan(math.pi / 8), F.col(flat)).when(steep > math.tan(3 * math.pi / 8), F.col(upright)).when(same, F.col(falling)).otherwise(F.col(rising))
    thin = (F.col("size") > along("size_left", "up", "up_left", "up_right")) & (F.col("size") >= along("size_right", "down", "down_right", "down_left"))
    return around.where(thin & (F.col("size") > low)).select("img", "height", "width", "y", "x", (F.col("size") > high).alias("strong"))


def _least_reachable(links: DataFrame) -> DataFrame:
    """img, node and root for links (img, u, v, of numbers within an image): the least number reachable. Stars of ever more nodes, in rounds that grow as a logarithm."""
    now, seen = keep(links.select("img", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"), None
    while (state := now.agg(F.count("*"), F.bit_xor(F.xxhash64("img", "u", "v"))).first()) != seen:
        seen = state
        both = now.unionByName(now.select("img", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("img", "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # all larger neighbours of a node, and the node itself, to the least around it
        large = _met(both, least, ["img", "u"]).where("v > u").select("img", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("img", "u").agg(F.min("v").alias("m"))
        small = _met(large, own, ["img", "u"]).select("img", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("img", "u", F.col("m").alias("v")))
        now = keep(small.where("u <> v").select("img", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    return now.groupBy("img", F.col("u").alias("node")).agg(F.min("v").alias("root"))


def edge_pixels(points: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """img, height, width, y, x of the edges: strong pixels, and weak ones in a connected piece (in eight directions) with a strong one."""
    found = keep(thinned(points, low, high).withColumn("node", F.col("y").cast("long") * F.col("width") + F.col("x")), "edges")
    near = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    place = found.select("img", "y", "x", F.col("node").alias("v"), F.col("strong").alias("other"))
    asked = found.withColumn("n", F.explode(near)).select("img", (F.col("y") + F.col("n.dy")).alias("y"), (F.col("x") + F.col("n.dx")).alias("x"), F.col("node").alias("u"), "strong")
    # pieces of strong pixels only needn't be known
    links = _met(asked, place, ["img", "y", "x"]).where(~F.col("strong") | ~F.col("other")).select("img", "u", "v")
    rooted = _met(found, _least_reachable(links), ["img", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    good = rooted.groupBy("img", "root").agg(F.bool_or("strong").alias("kept")).where("kept").select("img", "root")
    return _met(rooted, good, ["img", "root"], "left_semi").select("img", "height", "width", "y", "x")


def edges(points: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """points with 255 on edges and 0 elsewhere."""
    marked = edge_pixels(points, low, high).select("img", "y", "x", F.lit(255).alias("_edge"))
    return _met(points, marked, ["img", "y", "x"], "left").select("img", "height", "width", "y", "x", F.coalesce("_edge", F.lit(0)).alias("v"))


def lines(edge: DataFrame, votes: Column) -> DataFrame:
    """img, theta (degrees), rho and n of straight lines through more edge pixels than votes, that no neighbouring line outvotes. edge: img, height, width, y, x."""
    waves = F.array(*(F.struct(F.lit(t).alias("theta"), F.lit(math.cos(t * math.pi / 180)).alias("c"), F.lit(math.sin(t * math.pi / 180)).alias("s")) for t in range(180)))
    cast = edge.withColumn("w", F.explode(waves)).select("img", "width", "w.theta", F.rint(F.col("x") * F.col("w.c") + F.col("y") * F.col("w.s")).cast("int").alias("rho"))
    tall = cast.groupBy("img", "width", "theta", "rho").agg(F.count("*").alias("n")).where(F.col("n") > votes).select("img", "theta", "rho", "n")
    # only other tall cells can outvote one: of the four around it, those after it may be as tall
    around = F.array(*(F.struct(F.lit(dt).alias("dt"), F.lit(dr).alias("dr"), F.lit(first).alias("first")) for dt, dr, first in ((0, -1, True), (0, 1, False), (-1, 0, True), (1, 0, False))))
    beside = tall.withColumn("a", F.explode(around)).select("img", (F.col("theta") - F.col("a.dt")).alias("theta"), (F.col("rho") - F.col("a.dr")).alias("rho"), F.col("n").alias("other"), F.col("a.first").alias("first"))
    beaten = _met(tall, beside, ["img", "theta", "rho"]).where((F.col("other") > F.col("n")) | (F.col("first") & (F.col("other") == F.col("n")))).select("img", "theta", "rho").distinct()
    return _met(tall, beaten, ["img", "theta", "rho"], "left_anti")


def skews(points: DataFrame, most: int = 50) -> DataFrame:
    """img and angle of binary images: the median slope of the tallest lines, 0 without any."""
    votes = F.greatest(F.lit(100), F.floor(F.col("width") / 10))
    found = lines(edge_pixels(points), votes).groupBy("img").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "theta", "rho"))).alias("found"))
    angle = skew(F.transform("found", lambda f: F.radians(f["theta"].cast("double"))), most)
    return _met(points.select("img").distinct(), found.select("img", angle.alias("angle")), ["img"], "left").select("img", F.coalesce("angle", F.lit(0.0)).alias("angle"))
