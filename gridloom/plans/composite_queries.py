"""Composite plans (CP) on the driver's tables, and streams over events (an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import agreement, focal, metrics, ranking
from ..operators import models as M
from ..operators import sampling as P
from ..operators.lineage import cut
from . import composites as C
from .registry import draw_sql, query, sql_with

R = lambda c, n=None, d=6: F.round(c, d).alias(n or c)
DEM = sql_with("dem")


def _pair(t):
    return t.img_pair.select("r", "c", (F.col("a") * 10 - 15).alias("wet"), (F.col("b") * 10 - 15).alias("dry"), "ref")


@query("cp01_label_pools")
def cp01(t):
    classes = t.dem.select("r", "c", F.when(F.col("z") > 40, 1).when(F.col("z") < 3, 2).otherwise(0).alias("class"))
    return C.label_pools(classes, t.dem.where("z > 44 OR z = 20").select("r", "c"), least=2).groupBy("pool").agg(F.count("*").alias("n"))


@query("cp02_flood_map")
def cp02(t):
    return C.flood_map(_pair(t), "wet", "dry").groupBy("class").agg(F.count("*").alias("n"))


#: Shipments of each cell and year: how much, which share came back, and the commonest line status, null in cells and years with few.
_YEARLY_SQL = "yearly AS (SELECT floor(l_partkey / 50)::INT AS r, (l_partkey % 50)::INT AS c, year(l_shipdate)::INT AS year, sum(l_quantity) AS v, round(avg((l_returnflag = 'R')::INT), 6) AS back, CASE WHEN count(*) > 2 THEN CASE WHEN max(l_linestatus) = 'O' THEN 1 ELSE 2 END + (sum(l_quantity) > 120)::INT END AS klass FROM lineitem GROUP BY 1, 2, 3)"


def _yearly(t):
    k = F.col("l_partkey")
    open_ = F.when(F.max("l_linestatus") == "O", 1).otherwise(2) + (F.sum("l_quantity") > 120).cast("int")
    return t.lineitem.groupBy(F.floor(k / 50).cast("int").alias("r"), F.pmod(k, F.lit(50)).cast("int").alias("c"), F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("v"), R(F.avg((F.col("l_returnflag") == "R").cast("int")), "back"), F.when(F.count("*") > 2, open_).alias("klass"))


@query("cp03_label_dataset", DEM + ", " + _YEARLY_SQL + f""", ev AS (SELECT 'e' || year AS event, r, c, v, back FROM yearly WHERE year IN (1996, 1998, 2000)),
  pool AS (SELECT event, r, c FROM ev WHERE back >= 0.5), more AS (SELECT event, r, c FROM ev WHERE v > 200 EXCEPT SELECT event, r, c FROM pool),
  pos AS (SELECT *, 'pool' AS src FROM pool UNION ALL SELECT *, 'polygon' FROM more),
  neg AS (SELECT event, r, c, row_number() OVER (PARTITION BY event ORDER BY {draw_sql('event', 'r', 'c')}, event, r, c) AS nth FROM (SELECT event, r, c FROM ev WHERE back = 0 EXCEPT SELECT event, r, c FROM pos)),
  rnd AS (SELECT event, r, c FROM ev JOIN dem USING (r, c) WHERE z > 45),
  al AS (SELECT event, r, c, 'pos' AS kind, src, true AS is_pos FROM pos UNION ALL SELECT n.event, r, c, 'neg', 'neg', false FROM neg n WHERE nth <= (SELECT count(*) FROM pos p WHERE p.event = n.event)
         UNION ALL SELECT event, r, c, 'rnd', 'rnd', (event, r, c) IN (SELECT (event, r, c) FROM pos) FROM rnd),
  pl AS (SELECT al.*, ev.v, floor(al.r / 10)::BIGINT || '_' || floor(al.c / 10)::BIGINT AS block FROM al LEFT JOIN ev USING (event, r, c))
  SELECT event, r, c, kind, src, is_pos, round(v, 4) AS v, block, CASE WHEN block IN ('0_0', '1_1') THEN 4 ELSE (split_part(block, '_', 1)::BIGINT + split_part(block, '_', 2)::BIGINT) % 5 END::INT AS fold FROM pl""")
def cp03(t):
    ev = cut(_yearly(t).where(F.col("year").isin(1996, 1998, 2000)).select(F.concat(F.lit("e"), "year").alias("event"), "r", "c", "v", "back"))
    pools = ev.select("event", "r", "c", F.when(F.col("back") >= 0.5, "pos").when(F.col("back") == 0, "neg").alias("pool"))
    block = F.concat_ws("_", F.floor(F.col("r") / 10).cast("string"), F.floor(F.col("c") / 10).cast("string"))
    folds = t.spark.createDataFrame([("0_0", 4), ("1_1", 4)], "block string, fold int")
    random_cells = ev.join(t.dem.where("z > 45").select("r", "c"), ["r", "c"], "left_semi")
    found = C.label_dataset(pools, ev.where("v > 200"), random_cells, ev.select("event", "r", "c", "v"), block, folds)
    return found.select("event", "r", "c", "kind", "src", "is_pos", R("v", d=4), "block", "fold")


@query("cp04_land_matrix", DEM + " SELECT r, c, z, p_retailprice AS price FROM dem JOIN part ON p_partkey = r * 50 + c WHERE z > 5")
def cp04(t):
    return t.dem.where("z > 5").join(t.ramp.withColumnRenamed("z", "price"), ["r", "c"])


@query("cp05_preprocess")
def cp05(t):
    return focal.preprocess(_pair(t).select("r", "c", F.when(F.col("ref"), F.col("wet")).alias("v")), "v").agg(F.count("v").alias("valid"), R(F.avg("v"), "mean", 4))


@query("cp06_route_flow")
def cp06(t):
    return C.route_flow(t.ramp, 30.0, 30.0).select("r", "c", R("acc_area", d=3))


@query("cp07_agreement", DEM + """, o AS (SELECT *, z > 44 AS f, z < 3 AS g FROM dem), n AS (SELECT o.*, EXISTS (SELECT 1 FROM dem x WHERE x.z < 3 AND abs(x.r - o.r) <= 2 AND abs(x.c - o.c) <= 2) AS near FROM o)
SELECT count(*) FILTER (WHERE f AND g) AS tp, count(*) FILTER (WHERE f AND NOT g) AS fp, count(*) FILTER (WHERE NOT f AND g) AS fn, round(count(*) FILTER (WHERE f AND near) / count(*) FILTER (WHERE f)::DOUBLE, 6) AS gti_tolerant, count(*) FILTER (WHERE f) * 1.0 AS found_area FROM n""")
def cp07(t):
    a = agreement.agreement(t.dem, F.col("z") > 44, F.col("z") < 3, F.lit(1.0), 2, 2)
    return a.select("tp", "fp", "fn", R("gti_tolerant"), "found_area")


@query("cp08_protocols")
def cp08(t):
    from .model_queries import _rows

    s = _rows(t).withColumn("fold", P.fold_of_unseen(F.col("block"), 2))
    out = M.run_protocols(s, M.plain(M.Recipe(("f1", "f2"), rounds=2, depth=2)), "y", "event", "fold", [1996], [1999], folds=2, which=("spatial", "strict"))
    return M.summary(out).select("protocol", R("auc_mean", d=4), R("auc_sd", d=4))


@query("cp09_model_factory")
def cp09(t):
    """The four kinds of models, each judged on rows of a later year."""
    from .model_queries import _rows

    s, r = _rows(t), M.Recipe(("f1", "f2"), rounds=2, depth=2)
    made = {"standard": M.plain(r), "naive": M.weighted_unlabelled(r), "labelled_share": M.labelled_share(r, "block"), "bagged": M.bagged_unlabelled(r, ["id"], 2)}
    parts = [metrics.classification(f(s.where("event < 1998"), s.where("event = 1999")), "score", F.col("y") == 1).select(F.lit(n).alias("kind"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), R("auc", d=4)) for n, f in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("cp10_hotspots", "WITH c AS (SELECT floor(c_custkey / 100)::BIGINT AS block, c_acctbal AS w FROM customer), b AS (SELECT block, sum(w) AS weight, quantile_cont(w, 0.5) AS median FROM c GROUP BY 1) SELECT block, round(weight, 2) AS weight, round(median, 4) AS median FROM b WHERE weight >= 1000 ORDER BY weight DESC, block LIMIT 12")
def cp10(t):
    cells = t.customer.select(F.floor(F.col("c_custkey") / 100).alias("block"), F.col("c_acctbal").alias("weight"), F.col("c_acctbal").alias("value"), F.pmod("c_custkey", F.lit(90)).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    towns = t.nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 4.0).alias("x"), F.col("n_nationkey").cast("double").alias("y"))
    return C.hotspots(cells, "block", "weight", "value", 1000, 12, towns, 20.0).select("block", R("weight", d=2), R("median", d=4))


#: Windows of mapped days and of peaks: peaks in order of size, a list that grows while each is held or opens a window.
_EVENTS_SQL = sql_with("daily", recursive=True) + """,
  reg AS (SELECT x.d::DATE AS d, coalesce(mm, 0) AS mm FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM daily) x LEFT JOIN daily y ON x.d::DATE = y.d),
  r3 AS (SELECT d, CASE WHEN count(*) OVER w = 3 THEN sum(mm) OVER w END AS s FROM reg WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), ok AS MATERIALIZED (SELECT d, s FROM r3 WHERE s IS NOT NULL),
  md AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08),
  ses AS (SELECT d, sum(CASE WHEN gap IS NULL OR gap > 14 THEN 1 ELSE 0 END) OVER (ORDER BY d) AS session FROM (SELECT d, date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM md)),
  maps AS (SELECT 'map-' || strftime(min(d), '%Y%m%d') AS event, 'map' AS kind, min(d) - 10 AS s, max(d) + 10 AS e, count(*) AS n_maps FROM ses GROUP BY session),
  pk AS (SELECT 1 AS nth, (SELECT [d] FROM ok ORDER BY s DESC, d LIMIT 1) AS ds UNION ALL
         SELECT nth + 1, list_append(ds, (SELECT d FROM ok WHERE len(list_filter(pk.ds, lambda x: abs(date_diff('day', x, ok.d)) < 15)) = 0 ORDER BY s DESC, d LIMIT 1)) FROM pk WHERE nth < 10),
  top AS (SELECT nth, ds[nth] AS d, ok.s AS mm FROM pk JOIN ok ON ok.d = ds[nth]),
  held AS (SELECT nth, t.d, t.mm, arg_min(m.event, (m.s, m.event)) AS event FROM top t JOIN maps m ON t.d BETWEEN m.s AND m.e + 10 GROUP BY ALL),
  lone AS (SELECT list(d ORDER BY nth) AS ds FROM top WHERE nth NOT IN (SELECT nth FROM held)),
  fold AS (SELECT 0 AS i, []::DATE[] AS opened UNION ALL
           SELECT i + 1, CASE WHEN len(list_filter(opened, lambda o: lone.ds[i + 1] BETWEEN o - 12 AND o + 20)) > 0 THEN opened ELSE list_append(opened, lone.ds[i + 1]) END FROM fold, lone WHERE i < len(lone.ds)),
  rain AS (SELECT unnest(opened) AS d FROM (SELECT opened FROM fold ORDER BY i DESC LIMIT 1)),
  own AS (SELECT event, arg_min(d, nth) AS peak_day, arg_min(mm, nth) AS mm FROM held GROUP BY event),
  ev0 AS (SELECT event, kind, s, e, n_maps, peak_day, mm FROM maps LEFT JOIN own USING (event)
          UNION ALL SELECT 'rain-' || strftime(r.d, '%Y%m%d'), 'rain', r.d - 12, r.d + 10, 0, r.d, ok.s FROM rain r JOIN ok ON ok.d = r.d),
  ev AS (SELECT event, kind, s, e, n_maps, peak_day, coalesce(mm, (SELECT max(s) FROM ok WHERE d BETWEEN ev0.s - 5 AND ev0.e)) AS peak_mm,
         coalesce((SELECT sum(mm) FROM reg WHERE date_trunc('month', d) = date_trunc('month', ev0.s)), 0) AS month_mm FROM ev0)"""

_SCENES_SQL = _EVENTS_SQL + """,
  sc AS (SELECT o_orderdate::DATE AS d, (o_custkey % 12)::INT AS orbit, count(*) AS n_frames, round(avg((o_orderkey % 10) / 9.0), 6) AS coverage, round(avg((o_orderkey * 7 % 10) / 9.0), 6) AS eta, sum(o_totalprice) AS area, round(avg((o_orderkey * 3 % 10) / 9.0), 6) AS agreement
         FROM orders GROUP BY 1, 2),
  dry AS (SELECT orbit, year(d) AS y, arg_min(d, (abs(date_diff('day', make_date(year(d), 2, 10), d)), d)) AS dry_day FROM sc WHERE month(d) IN (1, 2, 3) GROUP BY 1, 2),
  es AS (SELECT ev.event, ev.kind, sc.d, sc.orbit, n_frames, coverage, eta, area, CASE WHEN kind = 'map' THEN agreement END AS agreement, dry_day FROM ev JOIN sc ON sc.d BETWEEN ev.s AND ev.e LEFT JOIN dry ON dry.orbit = sc.orbit AND dry.y = year(ev.s)),
  why AS (SELECT *, concat_ws('; ', CASE WHEN dry_day IS NULL THEN 'no dry reference' END, CASE WHEN coverage < 0.3017 THEN 'coverage' END, CASE WHEN eta < 0.3017 THEN 'eta' END, CASE WHEN area < 50000 THEN 'area' END, CASE WHEN agreement < 0.5013 THEN 'agreement' END) AS reason FROM es),
  et AS (SELECT *, CASE WHEN reason <> '' THEN 'rejected' WHEN agreement IS NULL THEN 'unverified' ELSE 'kept' END AS status FROM why)"""


def _events(t):
    from ..operators.timeseries import regular_days

    days = t.lineitem.where("l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08").select(F.to_date("l_shipdate").alias("d"))
    return C.event_windows(days, regular_days(t.daily, "d", "mm"))


def _event_table(t, events):
    key = F.col("o_orderkey")
    share = lambda x: F.round(F.avg(F.pmod(x, F.lit(10)) / 9.0), 6)
    scenes = t.orders.groupBy(F.to_date("o_orderdate").alias("d"), F.pmod("o_custkey", F.lit(12)).cast("int").alias("orbit")).agg(
        F.count("*").alias("n_frames"), share(key).alias("coverage"), share(key * 7).alias("eta"), F.sum("o_totalprice").alias("area"), share(key * 3).alias("agreement"))
    seen = C.event_scenes(events, scenes, [1, 2, 3], "02-10").withColumn("agreement", F.when(F.col("kind") == "map", F.col("agreement")))
    return C.event_table(seen, 0.3017, 0.3017, 50000.0, 0.5013)


@query("cp11_event_windows", _EVENTS_SQL + " SELECT event, kind, s AS start, e AS \"end\", n_maps::BIGINT AS n_maps, peak_day, round(peak_mm, 4) AS peak_mm, round(month_mm, 4) AS month_mm FROM ev")
def cp11(t):
    return _events(t).withColumns({c: F.round(c, 4) for c in ("peak_mm", "month_mm")})


@query("cp11_event_table", _SCENES_SQL + " SELECT event, kind, d, orbit, n_frames, round(coverage, 6) AS coverage, dry_day, status, reason FROM et")
def cp11_table(t):
    return _event_table(t, _events(t)).select("event", "kind", "d", "orbit", "n_frames", R("coverage"), "dry_day", "status", "reason")


@query("cp11_event_selection", _SCENES_SQL + """ SELECT ev.event, count(et.d) AS n_scenes, CASE WHEN count(*) FILTER (WHERE status = 'kept') > 0 THEN 'kept' WHEN count(*) FILTER (WHERE status = 'unverified') > 0 THEN 'unverified' ELSE 'rejected' END AS status,
  arg_min(d, (-agreement, d, orbit)) FILTER (WHERE status = 'kept') AS selected_day, arg_min(orbit, (-agreement, d, orbit)) FILTER (WHERE status = 'kept') AS selected_orbit FROM ev LEFT JOIN et USING (event) GROUP BY ev.event""")
def cp11_selection(t):
    events = cut(_events(t))
    return C.event_selection(events, _event_table(t, events)).select("event", "n_scenes", "status", "selected_day", "selected_orbit")


@query("cp12_hybrid_imperviousness")
def cp12(t):
    anchor = t.nation.select(F.col("n_nationkey").alias("r"), (F.col("n_nationkey") / 25.0).alias("share"))
    return C.hybrid_imperviousness(anchor, t.cube, 1995, 2001, 20.0).select("r", "year", R("share"))


_STACK_SQL = DEM + ", " + _YEARLY_SQL + """, es AS (SELECT 'first' AS event, 1996 AS year UNION ALL SELECT 'second', 1999),
  st AS (SELECT event, d.r, d.c, d.z, y.v, y.v - b.v AS since, y.klass AS own FROM es CROSS JOIN dem d LEFT JOIN yearly y ON y.r = d.r AND y.c = d.c AND y.year = es.year LEFT JOIN yearly b ON b.r = d.r AND b.c = d.c AND b.year = 1995),
  nb AS (SELECT g.event, g.r, g.c, arg_min(o.own, (sqrt((g.r - o.r) ** 2 + (g.c - o.c) ** 2), o.r, o.c)) AS klass FROM st g JOIN st o ON o.event = g.event AND g.own IS NULL AND o.own IS NOT NULL GROUP BY 1, 2, 3),
  full_ AS (SELECT st.event, st.r, st.c, z, v, since, coalesce(own, nb.klass) AS klass FROM st LEFT JOIN nb ON nb.event = st.event AND nb.r = st.r AND nb.c = st.c)"""


def _stack(t):
    return C.feature_stack(t.dem, _yearly(t).drop("back"), {"first": 1996, "second": 1999}, 1995)


@query("cp13_feature_stack", _STACK_SQL + " SELECT event, r, c, z, round(v, 4) AS v, round(since, 4) AS since, klass FROM full_")
def cp13(t):
    return _stack(t).select("event", "r", "c", "z", R("v", d=4), R("since", d=4), "klass")


@query("cp13_stack_checks", _STACK_SQL + """, l AS (UNPIVOT (SELECT event, z::VARCHAR AS z, coalesce(v::VARCHAR, '') AS v, coalesce(since::VARCHAR, '') AS since, coalesce(klass::VARCHAR, '') AS klass FROM full_) ON z, v, since, klass INTO NAME feature VALUE x),
  k AS (SELECT event, feature, try_cast(x AS DOUBLE) AS x, CASE feature WHEN 'z' THEN 1 WHEN 'v' THEN 0 WHEN 'since' THEN -150 ELSE 0 END AS low, CASE feature WHEN 'z' THEN 50 WHEN 'v' THEN 300 WHEN 'since' THEN 150 ELSE 8 END AS high FROM l),
  s AS (SELECT event, feature, count(*) FILTER (WHERE x IS NULL) AS gaps, count(*) FILTER (WHERE x < low OR x > high) AS out_of_range FROM k GROUP BY 1, 2) SELECT *, gaps = 0 AND out_of_range = 0 AS passed FROM s""")
def cp13_checks(t):
    return C.stack_checks(_stack(t), {"z": (1, 50), "v": (0, 300), "since": (-150, 150), "klass": (0, 8)})


@query("cp14_dual_impact", DEM + ", x AS (SELECT r, c, z / 51 AS s, z AS base, z + c / 10.0 AS scen FROM dem), k AS (SELECT (1 + (s >= 0.2)::INT + (s >= 0.4)::INT + (s >= 0.6)::INT + (s >= 0.8)::INT) >= 4 AS prone, (scen - base) * 100 / greatest(base, 1e-6) >= 5 AS more_ FROM x) SELECT more_::INT * 2 + prone::INT AS impact, count(*) AS n FROM k GROUP BY 1")
def cp14(t):
    x = t.dem.select("r", "c", (F.col("z") / 51).alias("s"), F.col("z").alias("base"), (F.col("z") + F.col("c") / 10.0).alias("scen"))
    return C.dual_impact(x, "s", "base", "scen", [0.2, 0.4, 0.6, 0.8], 5.0).groupBy("impact").agg(F.count("*").alias("n"))


@query("cp15_town_risk", DEM + ", q AS (SELECT quantile_cont(z, 0.3) AS low FROM dem) SELECT CASE WHEN NOT c % 4 = 0 THEN 0 ELSE 1 + (z <= low)::INT + (c <= 20)::INT END AS risk, count(*) AS n FROM dem, q GROUP BY 1")
def cp15(t):
    low = ranking.quantiles(t.dem, "z", [0.3])[0]
    return t.dem.groupBy(S.growth_risk(F.col("c") % 4 == 0, F.col("z") <= low, F.col("c") <= 20).alias("risk")).agg(F.count("*").alias("n"))


@query("cp16_hazard_validation", DEM + ", h AS (SELECT 0.45 * (1 - least(greatest((z - 1) / 18, 0), 1)) + 0.35 * (1 - least(c * 12.0 / 600, 1)) + 0.2 * ((r * 7 + c) % 10) / 10.0 AS h, z < 12 AS f FROM dem) SELECT count(*) FILTER (WHERE h >= 0.35 AND f) AS tp, count(*) FILTER (WHERE h >= 0.35 AND NOT f) AS fp, count(*) FILTER (WHERE h < 0.35 AND f) AS fn, count(*) FILTER (WHERE h < 0.35 AND NOT f) AS tn FROM h")
def cp16(t):
    h = S.hazard_index(F.col("z"), F.lit(1.0), F.col("c") * 12.0, F.pmod(F.col("r") * 7 + F.col("c"), F.lit(10)) / 10.0)
    return metrics.contingency(t.dem, S.hazard_tier(h) >= 2, F.col("z") < 12)


@query(
    "cp17_dataset_report",
    "SELECT 'documents' AS name, 'ok' AS status, count(*) AS n, round(count(text) / count(*), 6) AS valid, 'live' AS provenance FROM documents UNION ALL SELECT 'events', 'ok', count(*), round(count(value) / count(*), 6), 'synthetic' FROM events "
    "UNION ALL SELECT 'pages', 'ok', count(*), round(count(html) / count(*), 6), 'unknown' FROM pages UNION ALL SELECT 'tides', 'failed', 0, NULL, 'unknown'",
)
def cp17(t):
    demos = {
        "documents": (lambda: t.documents, "text", "fetched 1 file"), "events": (lambda: t.events, "value", "no key: SYNTHETIC fallback"), "pages": (lambda: t.pages, "html", ""),
        "tides": (lambda: t.spark.read.parquet(f"{t.folder}/tides.parquet"), "level", ""),
    }
    return C.dataset_report(t.spark, demos).withColumn("valid", F.round("valid", 6))


@query("st_stream_windows", "SELECT event_type, date_trunc('day', ts)::DATE AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    from ..streaming.events import daily_counts, run_once

    return run_once(t.spark, t.folder, "events", daily_counts, ["event_type", "start"]).withColumn("start", F.to_date("start"))


@query(
    "st_user_sessions",
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e), "
    "k AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 2 DAY AS b, count(*) AS n FROM s GROUP BY user_id, nth) SELECT user_id, floor(epoch(a))::BIGINT AS start, n FROM k WHERE b <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
)
def stream_sessions(t):
    """Sessions that the watermark has closed."""
    from ..streaming.events import run_once, user_sessions

    return run_once(t.spark, t.folder, "events", user_sessions, ["user_id", "start"], "append").select("user_id", F.unix_timestamp("start").alias("start"), "n")
