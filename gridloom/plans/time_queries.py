"""Series and windows (WN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..operators import timeseries as T
from .registry import query, sql_with

R = lambda c, n, d=6: F.round(c, d).alias(n)
DAILY, CUBE, SCORED, DEM = (sql_with(x) for x in ("daily", "cube", "scored", "dem"))
_REG = ", reg AS (SELECT x.d::DATE AS d, coalesce(mm, 0) AS mm FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM daily) x LEFT JOIN daily y ON x.d::DATE = y.d)"
_R3 = _REG + ", r3 AS (SELECT d, mm, CASE WHEN count(*) OVER w = 3 THEN sum(mm) OVER w END AS s FROM reg WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"
YEARS = (1995, 2001)
_FULL = CUBE + ", yrs AS (SELECT r, y::INT AS year FROM (SELECT DISTINCT r FROM cube), range(1995, 2002) t(y)), full_ AS (SELECT r, year, v FROM yrs LEFT JOIN cube USING (r, year))"


def _reg(t):
    return T.regular_days(t.daily, "d", "mm")


def _series(t):
    return T.year_array(t.cube, ["r"], "year", "v", *YEARS)


def _unnest(df, name="v"):
    return df.select("r", F.posexplode("vals").alias("i", name)).select("r", (F.col("i") + YEARS[0]).alias("year"), name)


@query("wn01_rolling3", DAILY + _R3 + " SELECT d, round(s, 4) AS s3 FROM r3")
def wn01(t):
    return T.rolling_sum(_reg(t), "d", "mm", 3).select("d", R(F.col("rolling"), "s3", 4))


@query("wn02_regularise", DAILY + _REG + " SELECT d, round(mm, 4) AS mm FROM reg")
def wn02(t):
    return _reg(t).select("d", R(F.col("mm"), "mm", 4))


@query("wn03_month_sums", DAILY + " SELECT date_trunc('month', d)::DATE AS month, round(sum(mm), 4) AS mm FROM daily GROUP BY 1")
def wn03(t):
    return T.month_sums(t.daily, "d", "mm").withColumn("mm", F.round("mm", 4))


_EV = "WITH e AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'view'), g AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER w, d) <= 2 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY d)), s AS (SELECT user_id, d, sum(new) OVER (PARTITION BY user_id ORDER BY d) AS session FROM g) "


def _days(t):
    return t.events.where("event_type = 'view'").select("user_id", F.to_date("ts").alias("d")).distinct()


@query("wn04_sessions", _EV + "SELECT user_id, session::BIGINT AS session, min(d) AS first_day, max(d) AS last_day, count(*) AS n FROM s GROUP BY 1, 2")
def wn04(t):
    s = T.sessions(_days(t), "d", ["user_id"], 2)
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n"))


@query("wn05_event_window", _EV + "SELECT user_id, session::BIGINT AS session, (min(d) - 3)::DATE AS first_day, (max(d) + 3)::DATE AS last_day FROM s GROUP BY 1, 2")
def wn05(t):
    s = T.sessions(_days(t), "d", ["user_id"], 2).groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    return T.padded(s, "first_day", "last_day", 3, 3)


@query("wn06_max_in_window", DAILY + ", ev AS (SELECT event_id, ts::DATE AS d0 FROM events WHERE event_type = 'signup') SELECT event_id, round(max(mm), 4) AS peak FROM ev JOIN daily ON d BETWEEN d0 - 5 AND d0 + 2 GROUP BY 1")
def wn06(t):
    from ..operators.joins import interval_join

    ev = t.events.where("event_type = 'signup'").select("event_id", F.date_sub(F.to_date("ts"), 5).alias("s"), F.date_add(F.to_date("ts"), 2).alias("e"))
    return interval_join(t.daily, ev, "d", "s", "e", days=8).groupBy("event_id").agg(R(F.max("mm"), "peak", 4))


@query(
    "wn07_declustered_peaks",
    sql_with("daily", recursive=True) + _R3 + """, ok AS MATERIALIZED (SELECT d, s FROM r3 WHERE s IS NOT NULL),
pk AS (SELECT 1 AS nth, (SELECT [d] FROM ok ORDER BY s DESC, d LIMIT 1) AS ds UNION ALL
  SELECT nth + 1, list_append(ds, (SELECT d FROM ok WHERE len(list_filter(pk.ds, lambda x: abs(date_diff('day', x, ok.d)) < 15)) = 0 ORDER BY s DESC, d LIMIT 1)) FROM pk WHERE nth < 5)
SELECT nth::INT AS nth, ds[nth] AS d, round((SELECT s FROM ok WHERE ok.d = ds[nth]), 4) AS rolling FROM pk""",
)
def wn07(t):
    r3 = T.rolling_sum(_reg(t), "d", "mm", 3)
    return T.declustered_peaks(r3, "d", "rolling", 5, 15).withColumn("rolling", F.round("rolling", 4))


@query(
    "wn08_trailing_windows",
    DAILY + ", ev AS (SELECT event_id, ts::DATE AS d0 FROM events WHERE event_type = 'signup') SELECT event_id, d0, round(coalesce((SELECT sum(mm) FROM daily WHERE d BETWEEN d0 - 4 AND d0), 0), 4) AS recent_sum, round(coalesce((SELECT sum(mm) FROM daily WHERE d BETWEEN d0 - 34 AND d0 - 5), 0), 4) AS antecedent_sum FROM ev",
)
def wn08(t):
    ev = t.events.where("event_type = 'signup'").select("event_id", F.to_date("ts").alias("d0"))
    out = T.trailing_windows(ev, t.daily, "d", "mm", "d0", 5, 30)
    return out.withColumns({c: F.round(c, 4) for c in ("recent_sum", "antecedent_sum")})


@query(
    "wn09_majority3",
    _FULL + ", b AS (SELECT r, year, coalesce(v, 0) > 20 AS on_ FROM full_) SELECT r, year, CASE WHEN lag(on_) OVER w IS NULL OR lead(on_) OVER w IS NULL THEN on_ ELSE lag(on_) OVER w::INT + on_::INT + lead(on_) OVER w::INT >= 2 END AS on_ FROM b WINDOW w AS (PARTITION BY r ORDER BY year)".replace("lag(on_) OVER w::INT", "(lag(on_) OVER w)::INT").replace("lead(on_) OVER w::INT", "(lead(on_) OVER w)::INT"),
)
def wn09(t):
    on = F.transform("vals", lambda x: F.coalesce(x, F.lit(0.0)) > 20)
    return _unnest(_series(t).select("r", T.majority3(on).alias("vals")), "on_")


@query(
    "wn10_median3",
    _FULL + ", b AS (SELECT r, year, coalesce(v, 0) AS v FROM full_) SELECT r, year, round(CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN v ELSE list_sort([lag(v) OVER w, v, lead(v) OVER w])[2] END, 4) AS v FROM b WINDOW w AS (PARTITION BY r ORDER BY year)",
)
def wn10(t):
    v = F.transform("vals", lambda x: F.coalesce(x, F.lit(0.0)))
    return _unnest(_series(t).select("r", T.median3(v).alias("vals"))).withColumn("v", F.round("v", 4))


@query(
    "wn11_nearest_year_fill",
    _FULL + ", k AS (SELECT a.r, a.year, b.v, row_number() OVER (PARTITION BY a.r, a.year ORDER BY abs(a.year - b.year), b.year) AS nth FROM full_ a JOIN full_ b ON a.r = b.r AND b.v IS NOT NULL) SELECT f.r, f.year, round(coalesce(k.v, 0), 4) AS v FROM full_ f LEFT JOIN k ON k.r = f.r AND k.year = f.year AND nth = 1",
)
def wn11(t):
    return _unnest(_series(t).select("r", T.fill_nearest_year("vals").alias("vals"))).withColumn("v", F.round("v", 4))


@query(
    "wn12_cascading_fill",
    _FULL + " SELECT r, year, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY r ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY r ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 4) AS v FROM full_",
)
def wn12(t):
    return _unnest(_series(t).select("r", T.fill_cascading("vals").alias("vals"))).withColumn("v", F.round("v", 4))


@query("wn13_transitions", CUBE + ", b AS (SELECT r, year, v > 20 AS on_ FROM cube WHERE v IS NOT NULL) SELECT a.year, count(*) FILTER (WHERE a.on_ AND NOT b.on_) AS lost, count(*) FILTER (WHERE a.on_) AS was FROM b a JOIN b b ON a.r = b.r AND b.year = a.year + 1 GROUP BY 1")
def wn13(t):
    on = t.cube.where("v IS NOT NULL").select("r", "year", (F.col("v") > 20).alias("on"))
    later = on.select("r", (F.col("year") - 1).alias("year"), F.col("on").alias("then"))
    return on.join(later, ["r", "year"]).groupBy("year").agg(F.count_if(F.col("on") & ~F.col("then")).alias("lost"), F.count_if("on").alias("was"))


@query("wn14_since_base_year", CUBE + " SELECT r, year, round(v - first_value(v) OVER (PARTITION BY r ORDER BY year), 4) AS dv FROM cube")
def wn14(t):
    from pyspark.sql import Window

    return t.cube.select("r", "year", R(F.col("v") - F.first("v").over(Window.partitionBy("r").orderBy("year")), "dv", 4))


@query("wn15_percentile_rank", DEM + " SELECT r, c, round(100.0 * row_number() OVER (ORDER BY z, r, c) / count(*) OVER (), 6) AS pct FROM dem")
def wn15(t):
    return ranking.percentile_ranks(t.dem, "z", ["r", "c"]).select("r", "c", R(F.col("pct"), "pct"))


@query("wn16_percentile_against", "WITH ref AS (SELECT p_size * 1000.0 AS v FROM part WHERE p_partkey % 3 = 0) SELECT s_suppkey, round(100.0 * (SELECT count(*) FROM ref WHERE v <= s_acctbal) / (SELECT count(*) FROM ref), 6) AS pct FROM supplier")
def wn16(t):
    ref = t.part.where("p_partkey % 3 = 0").select((F.col("p_size") * 1000.0).alias("v"))
    return ranking.percentile_against(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", ref, "v").select("s_suppkey", R(F.col("pct"), "pct"))


@query("wn17_segment_lengths", "SELECT o_custkey, o_orderkey, round(sqrt((o_totalprice - lead(o_totalprice) OVER w) ** 2 + (o_orderkey - lead(o_orderkey) OVER w) ** 2), 4) AS len FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def wn17(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    d = F.hypot(F.col("o_totalprice") - F.lead("o_totalprice").over(w), F.col("o_orderkey") - F.lead("o_orderkey").over(w))
    return t.orders.select("o_custkey", "o_orderkey", R(d, "len", 4))


@query("wn18_runs", DEM + ", h AS (SELECT r, c, CASE WHEN c - lag(c) OVER w <= 4 THEN 0 ELSE 1 END AS new FROM dem WHERE z > 35 WINDOW w AS (PARTITION BY r ORDER BY c)), g AS (SELECT r, c, sum(new) OVER (PARTITION BY r ORDER BY c) AS run FROM h) SELECT r, run::BIGINT AS run, min(c) AS first, max(c) AS last, count(*) AS n FROM g GROUP BY 1, 2")
def wn18(t):
    return T.true_runs(t.dem, ["r"], "c", F.col("z") > 35).withColumn("run", F.col("run").cast("long"))


@query("wn19_lag_growth", CUBE + " SELECT r, year, round(v / nullif(lag(v) OVER (PARTITION BY r ORDER BY year), 0) - 1, 6) AS growth FROM cube")
def wn19(t):
    from pyspark.sql import Window

    return t.cube.select("r", "year", R(F.try_divide(F.col("v"), F.lag("v").over(Window.partitionBy("r").orderBy("year"))) - 1, "growth"))


@query("wn20_drops", CUBE + ", g AS (SELECT r, v < lag(v) OVER (PARTITION BY r ORDER BY year) AS drop_ FROM cube) SELECT r, count(*) FILTER (WHERE drop_) AS drops FROM g GROUP BY r")
def wn20(t):
    from pyspark.sql import Window

    d = t.cube.withColumn("d", F.col("v") < F.lag("v").over(Window.partitionBy("r").orderBy("year")))
    return d.groupBy("r").agg(F.count_if("d").alias("drops"))


@query("wn21_top_months", DAILY + " SELECT date_trunc('month', d)::DATE AS month, round(sum(mm), 4) AS mm FROM daily GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def wn21(t):
    return T.month_sums(t.daily, "d", "mm").withColumn("mm", F.round("mm", 4)).orderBy(F.desc("mm"), "month").limit(8)
