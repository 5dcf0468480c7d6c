"""Joins that Spark has no operator for: nearest in time, intervals, nearest in space, points in polygons.

All of them turn the condition into an equi-join on buckets, so that both sides are exchanged by key; none is a
cross join. Candidates of a bucket are reduced before anything else happens to them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .skew import hot_keys, salted_join

#: Targets that a query of nearest_points() compares itself with in one row, on average at most.
LISTED = 4096
#: So many rounds of upstream() are kept as one table.
MERGE_ROUNDS = 16


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, order: list[str], keep: list[str]) -> DataFrame:
    """left with `keep` of the right row of the same keys that is nearest in time; null without one.

    Ties go to the first by `order`. Both sides are first reduced to one row a key and day, so a key has no more
    rows than the calendar has days, however often it occurs; a window finds the last day before and the first
    after; the result is joined back.
    """
    day = lambda c: F.unix_date(F.col(c)).alias("__day")
    first = right.groupBy(*by, day(right_time)).agg(F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("kept"))).alias("__r"))
    asked = left.select(*by, day(left_time)).distinct().where("__day IS NOT NULL")
    both = asked.join(first, [*by, "__day"], "full")
    w = Window.partitionBy(*by).orderBy("__day")
    seen = F.when(F.col("__r").isNotNull(), F.struct(F.col("__day").alias("d"), F.col("__r").alias("r")))
    near = both.select(*by, "__day", F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first(seen, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.d") - F.col("__day")).alias("gap"), F.col(f"{c}.r").alias("r")))
    best = near.select(*by, "__day", F.array_min(F.array_compact(F.array(gap("a"), gap("b"))))["r"]["kept"].alias("__kept"))
    return left.withColumn("__day", F.unix_date(F.col(left_time))).join(best, [*by, "__day"], "left").select(*left.columns, *[F.col(f"__kept.{k}").alias(k) for k in keep])


def cascaded_match(left: DataFrame, right: DataFrame, levels: list[list[str]], left_time: str, right_time: str, order: list[str], keep: list[str]) -> DataFrame:
    """asof_nearest by the keys of the first level that has a match; `level` says which (1 the first), 0 if none.

    A last level without keys matches any row; its side must be a short reference list.
    """
    out = left.withColumn("level", F.lit(0))
    for n, by in enumerate(levels, 1):
        names = [f"__{n}_{k}" for k in keep]
        found = right.select(*[F.col(k) for k in dict.fromkeys([*by, right_time, *order])], *[F.col(k).alias(x) for k, x in zip(keep, names)])
        if not by:
            found, out, by = found.withColumn("__any", F.lit(1)), out.withColumn("__any", F.lit(1)), ["__any"]
        out = asof_nearest(out, found, by, left_time, right_time, order, names)
        hit = F.coalesce(*[F.col(x).isNotNull().cast("int") for x in names]) == 1
        out = out.withColumn("level", F.when((F.col("level") == 0) & hit, n).otherwise(F.col("level")))
    best = [F.coalesce(*[F.col(f"__{n}_{k}") for n in range(1, len(levels) + 1)]).alias(k) for k in keep]
    return out.select(*left.columns, *best, "level")


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, days: int, by: list[str] | None = None) -> DataFrame:
    """Pairs with start <= at <= end, dates. days: the bucket; a span is copied to the buckets that it meets."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days).cast("int")
    left = points.withColumn("__b", bucket(F.col(at)))
    right = spans.where(F.col(start) <= F.col(end)).withColumn("__b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return left.join(right, [*(by or []), "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__b")


def nearest_points(queries: DataFrame, targets: DataFrame, id_col: str, target_id: str, k: int = 1, cell: float | None = None, exclude: Column | None = None) -> DataFrame:
    """(id, target id, dist, nth) of the k nearest targets by (dist, target id); both have x and y.

    Grid buckets and rings: a query sees the targets within `radius` cells around its own; it is settled once its
    k-th distance is no more than the ring's reach, else it goes on to a ring twice as wide. exclude: a condition
    on (id, target id) of pairs that don't count. cell: the bucket's width; by default such that a bucket holds a
    few targets on average. If no ring of the targets' extent settles a query, it keeps the targets it has.
    With k = 1 and nothing excluded, it is the cells that queries lie in that look around, once each, and queries take
    the targets of their cell as a list: no row a pair is made, sorted or exchanged.
    """
    box = targets.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)]).first()
    if not box["n"]:
        return queries.select(id_col).limit(0).withColumns({target_id: F.lit(None).cast(dict(targets.dtypes)[target_id]), "dist": F.lit(0.0), "nth": F.lit(1)})
    extent = max(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"], 1e-9)
    area = max(box["max_x"] - box["min_x"], extent / 1000) * max(box["max_y"] - box["min_y"], extent / 1000)
    cell = cell or max(math.sqrt(area / box["n"] * 4 * k), extent / 4096)
    cx, cy = F.floor(F.col("x") / cell).cast("long"), F.floor(F.col("y") / cell).cast("long")
    alone = k == 1 and exclude is None
    if alone:  # of targets at one place only the first can be nearest
        targets = targets.groupBy("x", "y").agg(F.min(target_id).alias(target_id))
    spots = cut(targets.select(F.col(target_id), F.col("x").alias("__tx"), F.col("y").alias("__ty"), cx.alias("__gx"), cy.alias("__gy")))
    open_, done, radius = queries.select(F.col(id_col), "x", "y"), None, 1
    reach = math.ceil(extent / cell) + 1
    # queries outside the targets' box are moved to its edge for bucketing; the distance is the true one
    while True:
        qx = F.least(F.greatest(F.col("x"), F.lit(box["min_x"])), F.lit(box["max_x"]))
        qy = F.least(F.greatest(F.col("y"), F.lit(box["min_y"])), F.lit(box["max_y"]))
        gap = F.hypot(F.col("x") - qx, F.col("y") - qy)
        rings = F.sequence(F.lit(-radius), F.lit(radius))
        around = lambda d: d.withColumn("__dx", F.explode(rings)).withColumn("__dy", F.explode(rings)).withColumns({"__gx": F.col("__ox") + F.col("__dx"), "__gy": F.col("__oy") + F.col("__dy")}).join(spots, ["__gx", "__gy"])
        seen = open_.withColumns({"__gap": gap, "__ox": F.floor(qx / cell).cast("long"), "__oy": F.floor(qy / cell).cast("long")})
        d = lambda tx, ty: F.hypot(F.col("x") - tx, F.col("y") - ty).alias("dist")
        if alone:
            extents = [f(c).alias(f"__{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))]
            asked = ["__ox", "__oy", "__ax", "__bx", "__ay", "__by"]
            near = cut(around(seen.groupBy("__ox", "__oy").agg(*extents)).select(*asked, "__tx", "__ty", target_id))
            most = near.groupBy("__ox", "__oy").count().agg(F.max("count")).first()[0] or 0
            parts = -(-most // LISTED)
            lists = near.groupBy(*asked, F.pmod(F.xxhash64("__tx", "__ty"), F.lit(max(parts, 1))).alias("__part")).agg(F.collect_list(F.struct("__tx", "__ty", target_id)).alias("__near"))
            lists = _rivals(lists).select("__ox", "__oy", "__near")
            one = F.array_min(F.transform("__near", lambda t: F.struct(d(t["__tx"], t["__ty"]), t[target_id].alias(target_id))))
            best = seen.join(lists.hint("shuffle_hash"), ["__ox", "__oy"], "left").select(id_col, "x", "y", "__gap", one.alias("__one"))
            if parts > 1:
                best = best.groupBy(id_col, "x", "y", "__gap").agg(F.min("__one").alias("__one"))
            found = cut(best.select(id_col, "x", "y", "__gap", F.when(F.col("__one").isNotNull(), F.array("__one")).alias("__best")))
        else:
            pairs = around(seen)
            if exclude is not None:
                pairs = pairs.where(~exclude)
            one = F.struct(d(F.col("__tx"), F.col("__ty")), F.col(target_id).alias(target_id))
            first_k = pairs.select(id_col, one.alias("__o")).withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy("__o"))).where(F.col("__n") <= k)
            best = first_k.groupBy(id_col).agg(F.array_sort(F.collect_list("__o")).alias("__best"))
            found = cut(open_.join(best, id_col, "left").withColumn("__gap", gap))
        # a target outside the ring is further than radius cells from the moved point, and the way there makes an obtuse angle with the move
        limit = F.hypot(F.col("__gap"), F.lit(radius * cell))
        settled = (F.size("__best") >= k) & (F.get("__best", F.lit(k - 1))["dist"] <= limit) if radius < reach else F.lit(True)
        out = found.where(settled & F.col("__best").isNotNull()).select(id_col, F.posexplode("__best").alias("__p", "__n")).select(id_col, F.col(f"__n.{target_id}").alias(target_id), F.col("__n.dist").alias("dist"), (F.col("__p") + 1).alias("nth"))
        done = out if done is None else done.unionByName(out)
        if radius >= reach:
            return done
        open_ = found.where(~F.coalesce(settled, F.lit(False))).select(id_col, "x", "y")
        radius = min(radius * 2, reach)
        if open_.isEmpty():
            return done


def _rivals(lists: DataFrame) -> DataFrame:
    """lists with only those targets of `__near` that may be nearest to a place in the box from (__ax, __ay) to (__bx, __by).

    One target is nearest to the box's middle. Which of it and another is nearer changes along a straight line, so another
    that is further from all four corners is further everywhere in the box; what rounding could make equal is kept.
    """
    square = lambda at, t: (at[0] - t["__tx"]) * (at[0] - t["__tx"]) + (at[1] - t["__ty"]) * (at[1] - t["__ty"])
    middle = [(F.col(f"__a{c}") + F.col(f"__b{c}")) / 2 for c in "xy"]
    corners = [(F.col(f"__{i}x"), F.col(f"__{j}y")) for i in "ab" for j in "ab"]
    first = F.array_min(F.transform("__near", lambda t: F.struct(square(middle, t).alias("d"), t["__tx"].alias("__tx"), t["__ty"].alias("__ty"))))
    out = lists.withColumn("__first", first).withColumn("__reach", F.array(*[square(at, F.col("__first")) for at in corners]))
    slack = F.array_max("__reach") * 1e-12
    out = out.withColumn("__reach", F.transform("__reach", lambda d: d + slack))
    return out.withColumn("__near", F.filter("__near", lambda t: reduce(lambda a, b: a | b, [square(at, t) <= F.get("__reach", F.lit(i)) for i, at in enumerate(corners)])))


def line_distance(queries: DataFrame, segs: DataFrame, id_col: str, cell: float | None = None) -> DataFrame:
    """(id, dist): each query's distance from the nearest of all segments (x1, y1)-(x2, y2). Queries have x and y, and an id each.

    Segments stand in every grid cell that their box covers. Queries look at growing squares of cells around them; one leaves
    once its best distance lies within its square, the others go on with twice the radius. No segments: no rows.
    """
    box = segs.agg(F.count("*").alias("n"), *[f(g(f"{c}1", f"{c}2")).alias(f"{f.__name__}_{c}") for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))], F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length")).first()
    if not box["n"]:
        return queries.select(id_col).limit(0).withColumn("dist", F.lit(0.0))
    width, height = box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]
    extent = max(width, height, 1e-9)
    cell = cell or max(math.sqrt(max(width, extent / 1000) * max(height, extent / 1000) / box["n"] * 4), box["length"], extent / 4096)
    at = lambda c: F.floor(c / cell).cast("long")
    spots = segs.select("x1", "y1", "x2", "y2").distinct()
    spots = spots.withColumn("__gx", F.explode(F.sequence(at(F.least("x1", "x2")), at(F.greatest("x1", "x2"))))).withColumn("__gy", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    spots = cut(spots)
    qx, qy = (F.least(F.greatest(F.col(c), F.lit(box[f"min_{c}"])), F.lit(box[f"max_{c}"])) for c in "xy")
    open_ = queries.select(F.col(id_col), "x", "y").withColumns({"__gap": F.hypot(F.col("x") - qx, F.col("y") - qy), "__ox": at(qx), "__oy": at(qy)})
    done, radius, reach = None, 1, math.ceil(extent / cell) + 1
    while True:
        rings = F.sequence(F.lit(-radius), F.lit(radius))
        seen = open_.withColumn("__dx", F.explode(rings)).withColumn("__dy", F.explode(rings)).withColumns({"__gx": F.col("__ox") + F.col("__dx"), "__gy": F.col("__oy") + F.col("__dy")})
        best = seen.join(spots, ["__gx", "__gy"]).groupBy(id_col).agg(F.min(segment_distance(F.col("x"), F.col("y"))).alias("dist"))
        found = cut(open_.join(best, id_col, "left"))
        # what lies outside the square is further than radius cells from the point moved to the box, at an obtuse angle with the move
        settled = F.lit(True) if radius >= reach else F.col("dist") <= F.hypot(F.col("__gap"), F.lit(radius * cell))
        out = found.where(F.col("dist").isNotNull() & settled).select(id_col, "dist")
        done = out if done is None else done.unionByName(out)
        if radius >= reach:
            return done
        open_ = found.where(~F.coalesce(settled, F.lit(False))).drop("dist")
        radius = min(radius * 2, reach)
        if open_.isEmpty():
            return done


def segments(lines: DataFrame, id_col: str, points: str = "pts") -> DataFrame:
    """(id, part, x1, y1, x2, y2): the consecutive pairs of an array of points (x, y)."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: F.struct(i.alias("part"), F.get(points, i)["x"].alias("x1"), F.get(points, i)["y"].alias("y1"), F.get(points, i + 1)["x"].alias("x2"), F.get(points, i + 1)["y"].alias("y2")))
    return lines.where(F.size(points) >= 2).select(id_col, F.inline(pairs))


def densify(segs: DataFrame, id_col: str, step: float) -> DataFrame:
    """(id, x, y): points along segments, at most `step` apart, ends included."""
    n = F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / step), F.lit(1))
    along = segs.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    f = F.col("__i") / F.col("__n")
    return along.select(id_col, (F.col("x1") + (F.col("x2") - F.col("x1")) * f).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * f).alias("y")).distinct()


def segment_distance(px: Column, py: Column) -> Column:
    """Distance of a point from the segment (x1, y1)-(x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((px - F.col("x1")) * dx + (py - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - F.col("x1") - t * dx, py - F.col("y1") - t * dy)


def clip_segments(segs: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The parts of segments inside a box: the parameter range between the entering and the leaving edges."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for delta, gap in ((-dx, F.col("x1") - west), (dx, F.lit(east) - F.col("x1")), (-dy, F.col("y1") - south), (dy, F.lit(north) - F.col("y1"))):
        outside = outside | ((delta == 0) & (gap < 0))
        ratio = F.try_divide(gap, delta)
        enter.append(F.when(delta < 0, ratio).otherwise(0.0))
        leave.append(F.when(delta > 0, ratio).otherwise(1.0))
    cut = segs.withColumns({"__a": F.greatest(*enter), "__b": F.least(*leave), "__o": outside}).where(~F.col("__o") & (F.col("__a") < F.col("__b")))
    at = lambda t, o, d: o + F.col(t) * d
    ends = {"x1": at("__a", F.col("x1"), dx), "y1": at("__a", F.col("y1"), dy), "x2": at("__b", F.col("x1"), dx), "y2": at("__b", F.col("y1"), dy)}
    return cut.withColumns(ends).drop("__a", "__b", "__o")


def rasterize(polygons: DataFrame, id_col: str, ring: str = "ring") -> DataFrame:
    """(id, r, c) of the cells whose centre (c + 0.5, r + 0.5) lies inside a polygon, by the even-odd rule.

    ring: array of points (x, y) in grid units; it closes itself. Each edge meets the centre lines of the rows
    that it spans; along a row the sorted crossings pair up to runs of cells. Rows of a polygon are independent,
    so a large polygon spreads over tasks.
    """
    closed = polygons.withColumn("__p", F.concat(ring, F.slice(ring, 1, 1)))
    edges = segments(closed.select(id_col, "__p"), id_col, "__p").where("y1 != y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")
    rows = edges.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    x = F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    runs = rows.groupBy(id_col, "r").agg(F.array_sort(F.collect_list(x)).alias("__x"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__x") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.get("__x", i * 2) - 0.5).cast("int").alias("a"), (F.ceil(F.get("__x", i * 2 + 1) - 0.5) - 1).cast("int").alias("b")))
    spans = runs.where(F.size("__x") >= 2).select(id_col, "r", F.inline(pairs)).where("a <= b")
    return spans.select(id_col, "r", F.explode(F.sequence("a", "b")).alias("c"))


def upstream(tree: DataFrame, seeds: DataFrame, id_col: str = "id", down: str = "next_down") -> DataFrame:
    """The seeds and everything that drains to them, however far upstream.

    Every round joins the nodes that the last round found with the edges and keeps those that no round has found yet,
    until there are none; a cycle ends it too. Rounds are as many as the longest chain above a seed.
    """
    edges = cut(tree.select(F.col(id_col).alias("id"), F.col(down).alias("down")).where("id != down"))
    hot = hot_keys(edges.groupBy("down").agg(F.count("*").alias("n")), ["down"], "n")
    front = cut(seeds.select(F.col(id_col).alias("id")).distinct())
    found = [front]
    while True:
        met = salted_join(edges, front.select(F.col("id").alias("down")).where("down IS NOT NULL"), ["down"], hot, F.col("id")).select("id").distinct()
        for part in found:
            met = met.join(part, "id", "left_anti")
        front = cut(met)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(front)
        if len(found) == MERGE_ROUNDS:
            found = [cut(reduce(DataFrame.unionByName, found))]
