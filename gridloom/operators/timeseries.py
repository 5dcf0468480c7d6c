"""Series by day or year: regular steps, rolling sums, sessions, gap filling, declustering, scenario windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_days(df: DataFrame, day: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Every day from a series' first to its last, missing ones with 0."""
    by = by or []
    span = df.groupBy(*by).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    days = span.where("__a is not null").select(*by, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(day))
    return days.join(df.select(*by, day, value), [*by, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def rolling_sum(df: DataFrame, day: str, value: str, n: int, by: list[str] | None = None, name: str = "rolling") -> DataFrame:
    """df with the sum of n consecutive rows; null before there are n. A series is a group: bounded by its days."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(day).rowsBetween(1 - n, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def month_sums(df: DataFrame, day: str, value: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.trunc(day, "MM").alias("month")).agg(F.sum(value).alias(value))


def sessions(df: DataFrame, day: str, by: list[str], gap: int) -> DataFrame:
    """df with `session` 1, 2, ...: a new one where more than `gap` days have passed."""
    w = Window.partitionBy(*by).orderBy(day)
    new = F.coalesce((F.datediff(day, F.lag(day).over(w)) > gap).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def padded(df: DataFrame, start: str, end: str, before: int, after: int) -> DataFrame:
    return df.withColumns({start: F.date_sub(start, before), end: F.date_add(end, after)})


def trailing_windows(events: DataFrame, series: DataFrame, day: str, value: str, event_day: str, recent: int, antecedent: int) -> DataFrame:
    """events with recent_sum (the last `recent` days) and antecedent_sum (the `antecedent` days before those)."""
    keys = events.columns
    days = events.withColumn("__d", F.explode(F.sequence(F.date_sub(event_day, recent + antecedent - 1), F.col(event_day), F.expr("interval 1 day"))))
    joined = days.join(series.select(F.col(day).alias("__d"), F.col(value).alias("__v")), "__d", "left")
    is_recent = F.col("__d") > F.date_sub(event_day, recent)
    return joined.groupBy(*keys).agg(F.coalesce(F.sum(F.when(is_recent, F.col("__v"))), F.lit(0.0)).alias("recent_sum"), F.coalesce(F.sum(F.when(~is_recent, F.col("__v"))), F.lit(0.0)).alias("antecedent_sum"))


def declustered_peaks(df: DataFrame, day: str, value: str, n: int, apart: int) -> DataFrame:
    """(nth, day, value): the n greatest values, each at least `apart` days from those before it.

    One aggregation a peak: n is a short report's length, and the days left are filtered, never gathered. Ties go
    to the earlier day.
    """
    left, found = df.where(F.col(value).isNotNull()), []
    for nth in range(1, n + 1):
        best = left.agg(F.max_by(F.struct(day, value), F.struct(F.col(value), -F.unix_date(day))).alias("b")).first()["b"]
        if best is None:
            break
        found.append((nth, best[day], float(best[value])))
        left = left.where(F.abs(F.datediff(day, F.lit(best[day]))) >= apart)
    return df.sparkSession.createDataFrame(found, f"nth int, {day} date, {value} double")


def year_array(df: DataFrame, by: list[str], year: str, value: str, first: int, last: int) -> DataFrame:
    """(by, vals): one array a series with a place for every year, null where there is no value."""
    pairs = F.map_from_entries(F.collect_list(F.struct(year, value)))
    got = df.groupBy(*by).agg(pairs.alias("__m"))
    return got.select(*by, F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: F.try_element_at("__m", y)).alias("vals"))


def fill_nearest_year(vals: Column | str) -> Column:
    """Each gap takes the nearest year's own value, of two equally near ones the earlier; 0 if there is none."""
    v = F.col(vals) if isinstance(vals, str) else vals
    at = F.sequence(F.lit(0), F.size(v) - 1)
    known = F.filter(at, lambda i: F.get(v, i).isNotNull())

    def best(i: Column) -> Column:
        near = F.array_min(F.transform(known, lambda k: F.struct(F.abs(k - i).alias("d"), k.alias("k"))))
        return F.coalesce(F.get(v, i), F.get(v, near["k"]), F.lit(0.0))

    return F.transform(at, best)


def fill_cascading(vals: Column | str) -> Column:
    """As fill_nearest_year, but year by year in place: a gap filled before counts as a value for those after it."""
    v = F.col(vals) if isinstance(vals, str) else vals
    n = F.size(v)

    def step(out: Column, i: Column) -> Column:
        own = F.get(v, i)
        back = F.when(i > 0, F.element_at(out, -1))
        ahead = F.get(F.filter(F.transform(F.sequence(F.least(i + 1, n - 1), n - 1), lambda k: F.get(v, k)), lambda x: x.isNotNull()), F.lit(0))
        return F.concat(out, F.array(F.coalesce(own, back, ahead, F.lit(0.0))))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<double>"), step)


def majority3(vals: Column) -> Column:
    """Booleans replaced by the majority of three years; the ends stay."""
    at = F.sequence(F.lit(0), F.size(vals) - 1)
    three = lambda i: F.get(vals, i - 1).cast("int") + F.get(vals, i).cast("int") + F.get(vals, i + 1).cast("int")
    return F.transform(at, lambda i: F.when((i == 0) | (i == F.size(vals) - 1), F.get(vals, i)).otherwise(three(i) >= 2))


def median3(vals: Column) -> Column:
    """Values replaced by the median of three years; the ends stay."""
    at = F.sequence(F.lit(0), F.size(vals) - 1)
    mid = lambda i: F.get(F.array_sort(F.array(F.get(vals, i - 1), F.get(vals, i), F.get(vals, i + 1))), F.lit(1))
    return F.transform(at, lambda i: F.when((i == 0) | (i == F.size(vals) - 1), F.get(vals, i)).otherwise(mid(i)))


def true_runs(df: DataFrame, by: list[str], at: str, on: Column, close: int = 3) -> DataFrame:
    """(by, run, first, last, n): runs of true cells along `at`; up to `close` false ones between two do not part them."""
    w = Window.partitionBy(*by).orderBy(at)
    hit = df.where(on).withColumn("__new", F.coalesce((F.col(at) - F.lag(at).over(w) > close + 1).cast("int"), F.lit(1)))
    return hit.withColumn("run", F.sum("__new").over(w)).groupBy(*by, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
