"""Composite plans: flood maps, label pools, inventories, imperviousness, scenarios, rankings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import components, focal, joins, resample, routing, sampling, stats
from ..operators import timeseries as T
from ..operators.grid import join_cells
from ..operators.lineage import cut
from ..operators.quality import audit, keep_rule, provenance


def route_flow(cells: DataFrame, dx: float, dy: float, basin: str | None = None) -> DataFrame:
    """cells (r, c, z) with zf, the filled surface, and acc_area, the area that drains through each."""
    filled = routing.priority_fill(cells, basin)
    return routing.accumulate(filled.withColumn("area", F.lit(dx * dy)), routing.flow_edges(filled, dx, dy), ["area"])


def flood_map(pair: DataFrame, wet: str, dry: str, steep: Column | None = None, low: float | None = None, high: float | None = None, least: int = 5) -> DataFrame:
    """(r, c, class) of two observations in decibels or linear units: 1 new water, 2 water in both, 0 dry, null unseen.

    Each image is smoothed and gets a threshold of its own; patches of new water below `least` cells are dry.
    """
    seen = cut(focal.preprocess(focal.preprocess(pair, wet), dry))  # read for two thresholds, the patches and the classes
    t_wet, t_dry = (stats.otsu(seen.select(F.col(x).alias("v")), "v", low, high).first()["threshold"] for x in (wet, dry))
    water, before = F.col(wet) < t_wet, F.col(dry) < t_dry
    ok = F.lit(True) if steep is None else ~steep
    new = seen.withColumns({"__new": F.coalesce(water & ~before & ok, F.lit(False)), "__ref": F.coalesce(water & before, F.lit(False)), "__valid": F.col(wet).isNotNull() & F.col(dry).isNotNull()})
    kept = components.without_small(new.where("__new").select("r", "c"), least).select("r", "c", F.lit(True).alias("__kept"))
    klass = F.when(~F.col("__valid"), F.lit(None)).when(F.col("__kept"), 1).when(F.col("__ref"), 2).otherwise(0)
    return join_cells(new, kept, "left").select("r", "c", klass.cast("int").alias("class"))


def label_pools(classes: DataFrame, envelope: DataFrame, least: int = 10, tolerance: int = 2) -> DataFrame:
    """(r, c, pool) of coarse cells: 'pos' confirmed flood, 'neg' surely dry, 'ref_only' seen by the reference alone.

    classes: fine cells (r, c, class) of flood_map; envelope: fine cells (r, c) of the reference. Shares are exact
    areas in coarse cells, of which two are as wide as three fine ones.
    """
    flood, water = classes.where("class = 1").select("r", "c"), classes.where("class = 2").select("r", "c")
    wide = focal.dilate(envelope, tolerance)
    layers = {
        "valid": classes.where("class IS NOT NULL").select("r", "c"), "flood": flood, "env": envelope, "env_tol": wide,
        "conf": components.without_small(flood, least).select("r", "c").join(wide, ["r", "c"], "left_semi"), "belt": focal.dilate(water, 3), "refw": water,
    }
    out = None
    for name, mask in layers.items():
        share = resample.fraction_three_in_two(mask, F.lit(1)).withColumnRenamed("f", name)
        out = share if out is None else out.join(share, ["r", "c"], "left")
    out = out.fillna(0.0, [n for n in layers if n != "valid"])
    near = focal.dilate(out.where("flood > 0").select("r", "c"), 2).withColumn("__near", F.lit(True))
    full = out.join(near, ["r", "c"], "left").where("valid >= 1 - 1e-6")
    dry = F.col("__near").isNull() & (F.col("belt") == 0) & (F.col("refw") == 0)
    pool = F.when(F.col("conf") >= 0.5, "pos").when(dry & (F.col("env_tol") == 0), "neg").when(dry & (F.col("env") >= 0.5), "ref_only")
    return full.select("r", "c", pool.alias("pool")).where("pool IS NOT NULL")


def event_windows(map_days: DataFrame, series: DataFrame, gap: int = 14, pad: int = 10, peaks: int = 10, apart: int = 15) -> DataFrame:
    """(event, kind, start, end, n_maps, peak_day, peak_mm, month_mm): sessions of mapped days, and rain peaks in none of them.

    map_days: (d); series: (d, mm) regular days. Of the `peaks` greatest three-day sums each belongs to the first window
    that held it, or a pad after it, when its turn came, windows of greater peaks included; else it opened its own. A
    window's peak is the greatest that belongs to it, else the greatest sum of its days and the five before.
    """
    days = map_days.select(F.lit(0).alias("k"), "d").where("d is not null").distinct()
    mapped = T.sessions(days, "d", ["k"], gap).groupBy("session").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n_maps"))
    maps = cut(mapped.select(F.concat(F.lit("map-"), F.date_format("a", "yyyyMMdd")).alias("event"), F.lit("map").alias("kind"), F.date_sub("a", pad).alias("start"), F.date_add("b", pad).alias("end"), "n_maps"))
    sums = cut(T.rolling_sum(series, "d", "mm", 3))
    top = T.declustered_peaks(sums, "d", "rolling", peaks, apart)
    in_map = joins.interval_join(top, maps.select("event", "start", F.date_add("end", pad).alias("until")), "d", "start", "until", days=32)
    belongs = cut(in_map.groupBy("nth", "d", "rolling").agg(F.min_by("event", F.struct("start", "event")).alias("event")))
    # the others in order of size, a list as long as the report: which of them open a window
    rest = top.join(belongs.select("nth"), "nth", "left_anti").agg(F.sort_array(F.collect_list(F.struct("nth", "d", "rolling"))).alias("rest"))
    within = lambda p: lambda o: (p["d"] >= F.date_sub(o["d"], 2 + pad)) & (p["d"] <= F.date_add(o["d"], 2 * pad))
    none = F.slice("rest", 1, 0)
    opened = rest.select(F.explode(F.aggregate("rest", none, lambda held, p: F.when(F.exists(held, within(p)), held).otherwise(F.concat(held, F.array(p))))).alias("p"))
    name = F.concat(F.lit("rain-"), F.date_format("p.d", "yyyyMMdd"))
    rain = opened.select(name.alias("event"), F.lit("rain").alias("kind"), F.date_sub("p.d", 2 + pad).alias("start"), F.date_add("p.d", pad).alias("end"), F.lit(0).cast("long").alias("n_maps"), F.col("p.d").alias("peak_day"), F.col("p.rolling").alias("own_mm"))
    first = belongs.groupBy("event").agg(F.min_by(F.struct(F.col("d").alias("peak_day"), F.col("rolling").alias("own_mm")), "nth").alias("peak")).select("event", "peak.*")
    events = maps.join(first, "event", "left").unionByName(rain)
    most = joins.interval_join(sums.select("d", "rolling"), events.select("event", F.date_sub("start", 5).alias("s"), F.col("end").alias("e")), "d", "s", "e", days=32).groupBy("event").agg(F.max("rolling").alias("most"))
    months = T.month_sums(series, "d", "mm").withColumnRenamed("mm", "month_mm")
    found = events.join(most, "event", "left").withColumn("month", F.trunc("start", "MM")).join(months, "month", "left")
    return found.select("event", "kind", "start", "end", "n_maps", "peak_day", F.coalesce("own_mm", "most").alias("peak_mm"), F.coalesce("month_mm", F.lit(0.0)).alias("month_mm"))


def event_scenes(events: DataFrame, scenes: DataFrame, dry_months: list[int], dry_target: str) -> DataFrame:
    """Each scene of each event's window with dry_day, the scene of its orbit in the dry months of the event's year nearest to
    the target day ('MM-dd'; of two equally near ones the earlier), null if there is none.

    events: event, kind, start, end; scenes: d, orbit and figures, one row a day and orbit.
    """
    seen = joins.interval_join(scenes, events.select("event", "kind", "start", "end"), "d", "start", "end", days=32).withColumn("year", F.year("start")).drop("start", "end")
    dry = scenes.where(F.month("d").isin(dry_months)).select("orbit", F.year("d").alias("year"), F.col("d").alias("dry"))
    off = F.abs(F.datediff("dry", F.to_date(F.concat_ws("-", "year", F.lit(dry_target)))))
    nearest = dry.groupBy("orbit", "year").agg(F.min_by("dry", F.struct(off, "dry")).alias("dry_day"))
    return seen.join(nearest, ["orbit", "year"], "left").drop("year")


def event_table(scenes: DataFrame, least_coverage: float, least_eta: float, least_area: float, least_agreement: float) -> DataFrame:
    """event_scenes with status and reason by the keep rule: figures coverage, eta, area, agreement (null: no map to hold it against)."""
    failures = {
        "no dry reference": F.col("dry_day").isNull(), "coverage": F.col("coverage") < least_coverage, "eta": F.col("eta") < least_eta, "area": F.col("area") < least_area,
        "agreement": F.coalesce(F.col("agreement") < least_agreement, F.lit(False)),
    }
    return keep_rule(scenes, failures, F.col("agreement").isNull())


def event_selection(events: DataFrame, table: DataFrame) -> DataFrame:
    """events with n_scenes, status and the scene selected: of those kept the one of best agreement (ties: day, orbit)."""
    of = table.groupBy("event").agg(
        F.count("*").alias("n_scenes"), F.min(F.when(F.col("status") == "kept", F.struct((-F.col("agreement")).alias("less"), "d", "orbit"))).alias("best"),
        F.max((F.col("status") == "unverified").cast("int")).alias("open"),
    )
    status = F.when(F.col("best").isNotNull(), "kept").when(F.col("open") == 1, "unverified").otherwise("rejected")
    return events.join(of, "event", "left").select(*events.columns, F.coalesce("n_scenes", F.lit(0)).cast("long").alias("n_scenes"), status.alias("status"), F.col("best.d").alias("selected_day"), F.col("best.orbit").alias("selected_orbit"))


def feature_stack(static: DataFrame, yearly: DataFrame, events: dict[str, int], base_year: int) -> DataFrame:
    """(event, r, c, static columns, v, since, klass): the layers of each event, one row a cell.

    static: (r, c, ...); yearly: (r, c, year, v, klass); events: name -> year. v: the year's value, since: its change from the
    base year (null where either is missing); klass: the year's class, of the nearest cell that has one where it is missing.
    """
    base = yearly.where(F.col("year") == base_year).select("r", "c", F.col("v").alias("__v0"))
    parts = []
    for name, year in events.items():
        cells = static.join(yearly.where(F.col("year") == year).select("r", "c", "v", "klass"), ["r", "c"], "left").join(base, ["r", "c"], "left")
        cells = cells.withColumn("since", F.col("v") - F.col("__v0")).drop("__v0")
        parts.append(resample.fill_nearest(cells, "klass", F.col("klass").isNotNull()).withColumn("event", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def stack_checks(stack: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(event, feature, gaps, out_of_range, passed): missing values, and values beyond what the feature may be."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for f, (a, b) in ranges.items()]))
    x = F.col("f.x")
    bad = x.isNull() | F.isnan(x)
    found = stack.select("event", each.alias("f")).groupBy("event", F.col("f.feature").alias("feature")).agg(
        F.count_if(bad).alias("gaps"), F.count_if(~bad & ((x < F.col("f.low")) | (x > F.col("f.high")))).alias("out_of_range")
    )
    return found.withColumn("passed", (F.col("gaps") == 0) & (F.col("out_of_range") == 0))


def label_dataset(pools: DataFrame, detailed: DataFrame, random_cells: DataFrame, layers: DataFrame, block: Column, folds: DataFrame) -> DataFrame:
    """(event, kind, src, r, c, layers, is_pos, block, fold): the labelled cells of all events.

    pools: (event, r, c, pool) with pool pos or neg; detailed: (event, r, c) of cells inside detailed reference polygons, positive
    too; random_cells: (event, r, c), flagged anew; layers: (event, r, c, ...); block: an expression over r and c; folds:
    (block, fold), unlisted blocks take the fold of the unseen. Of the negatives that are not in a polygon as many are drawn as
    the event has positives.
    """
    own = pools.where("pool = 'pos'").select("event", "r", "c").distinct()
    more = detailed.select("event", "r", "c").distinct().join(own, ["event", "r", "c"], "left_anti")
    positive = cut(own.withColumn("src", F.lit("pool")).unionByName(more.withColumn("src", F.lit("polygon"))))
    wanted = positive.groupBy("event").agg(F.count("*").alias("__n"))
    negative = pools.where("pool = 'neg'").select("event", "r", "c").distinct().join(positive.select("event", "r", "c"), ["event", "r", "c"], "left_anti")
    drawn = sampling.hash_ranks(negative, ["event", "r", "c"], ["event"]).join(wanted, "event").where(F.col("rank") <= F.col("__n"))
    flags = positive.select("event", "r", "c", F.lit(True).alias("is_pos"))
    again = random_cells.select("event", "r", "c").distinct().join(flags, ["event", "r", "c"], "left").withColumn("is_pos", F.coalesce("is_pos", F.lit(False)))
    rows = positive.select("event", "r", "c", F.lit("pos").alias("kind"), "src", F.lit(True).alias("is_pos"))
    rows = rows.unionByName(drawn.select("event", "r", "c", F.lit("neg").alias("kind"), F.lit("neg").alias("src"), F.lit(False).alias("is_pos")))
    rows = rows.unionByName(again.select("event", "r", "c", F.lit("rnd").alias("kind"), F.lit("rnd").alias("src"), "is_pos"))
    placed = rows.join(layers, ["event", "r", "c"], "left").withColumn("block", block).join(folds, "block", "left")
    return placed.withColumn("fold", F.coalesce("fold", sampling.fold_of_unseen(F.col("block"))))


def hybrid_imperviousness(anchor: DataFrame, cube: DataFrame, first: int, last: int, on: float) -> DataFrame:
    """(r, year, share): a yearly source, gaps filled and flickers voted out, scaled onto an anchor map (r, share)."""
    series = T.year_array(cube, ["r"], "year", "v", first, last)
    built = T.majority3(F.transform(T.fill_nearest_year("vals"), lambda x: x > on))
    long = series.select("r", F.posexplode(F.transform(built, lambda b: b.cast("double"))).alias("i", "b")).select("r", (F.col("i") + first).alias("year"), "b")
    base = long.where(F.col("year") == first).select("r", F.col("b").alias("b0"))
    joined = long.join(base, "r").join(anchor, "r")
    k = joined.where(F.col("year") == first).agg(F.try_divide(F.sum("share"), F.sum("b0")).alias("k")).first()["k"] or 0.0
    return joined.select("r", "year", S.hybrid_fraction(F.col("share"), F.col("b"), F.col("b0"), F.lit(k)).alias("share"))


def hotspots(cells: DataFrame, block: str, weight: str, value: str, least: float, top: int, towns: DataFrame, far: float) -> DataFrame:
    """(block, weight, median, place): the heaviest blocks of at least so much weight, named by a town nearby.

    cells: block, weight, value, x, y; towns: name, x, y.
    """
    b = cells.groupBy(block).agg(F.sum(weight).alias("weight"), F.percentile(value, 0.5).alias("median"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    best = b.where(F.col("weight") >= least).orderBy(F.desc("weight"), block).limit(top)
    near = joins.nearest_points(best.select(block, "x", "y"), towns, block, "name")
    return best.join(near, block, "left").select(block, "weight", "median", F.when(F.col("dist") <= far, F.col("name")).otherwise(F.format_string("%.3f, %.3f", "x", "y")).alias("place"))


def dual_impact(cells: DataFrame, susceptibility: str, base: str, scenario: str, breaks: list[float], more_water: float) -> DataFrame:
    """cells with pct_more_water, class and impact of a scenario; prone is class 4 and up."""
    floor_ = F.greatest(F.col(base), F.lit(1e-6))
    out = cells.withColumns({"pct_more_water": (F.col(scenario) - F.col(base)) * 100.0 / floor_, "class": S.digitise(F.col(susceptibility), breaks)})
    return out.withColumn("impact", S.impact_class(F.col("class") >= 4, F.col("pct_more_water") >= more_water))


def dataset_report(spark: SparkSession, demos: dict[str, tuple[Callable[[], DataFrame], str, str]]) -> DataFrame:
    """(name, status, n, valid, provenance): every dataset's reader run by itself, one that fails not stopping the others.

    demos: name: (reader, a column that should have values, what the reader said).
    """
    found, failed = {}, []
    for name, (read, column, _) in demos.items():
        try:
            df = read()
            df.select(column)
            found[name] = df, column
        except AnalysisException:
            failed.append(name)
    said = spark.createDataFrame([(n, x[2]) for n, x in demos.items()], "name string, log string")
    rows = spark.createDataFrame([(n, "failed", 0, None) for n in failed], "name string, status string, n long, valid double")
    if found:
        rows = rows.unionByName(audit(found).select("name", F.lit("ok").alias("status"), "n", "valid"))
    return rows.join(said, "name").select("name", "status", "n", "valid", provenance(F.col("log")).alias("provenance"))
