"""Evaluation statistics from one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import auc, auc_of_counts, percentile_against, quantiles, value_counts


def contingency(df: DataFrame, found: Column, truth: Column, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn as counts, or as sums of a weight."""
    total = (lambda m: F.count_if(m)) if weight is None else (lambda m: F.sum(F.when(m, weight).otherwise(0.0)))
    cells = {"tp": found & truth, "fp": found & ~truth, "fn": ~found & truth, "tn": ~found & ~truth}
    return df.groupBy(*(by or [])).agg(*[total(m).alias(k) for k, m in cells.items()])


def ratios(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pod, far, csi, f1, oa, kappa, bias and prevalence of a contingency table; null where a ratio has no denominator."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, pod = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    oa = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    out = {
        "precision": precision, "pod": pod, "far": F.lit(1.0) - precision, "csi": F.try_divide(tp, tp + fp + fn), "f1": F.try_divide(precision * pod * 2.0, precision + pod),
        "oa": oa, "kappa": F.try_divide(oa - chance, F.lit(1.0) - chance), "bias": F.try_divide(tp + fp, tp + fn), "prevalence": F.try_divide(tp + fn, n),
    }
    return table.select(*(by or []), "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in out.items()])


def classification(df: DataFrame, score: str, label: Column, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision (0 if nothing is found), recall, f1, specificity and auc at a threshold."""
    by = by or []
    counted = cut(value_counts(df, score, by, pos=label, neg=~label))  # one pass over df for all that follows
    total = lambda found, n: F.coalesce(F.sum(F.when(found, F.col(n))), F.lit(0))
    found = F.col(score) >= threshold
    t = counted.groupBy(*by).agg(total(found, "pos").alias("tp"), total(found, "neg").alias("fp"), total(~found, "pos").alias("fn"), total(~found, "neg").alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, rec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.try_divide(tp, tp + fn)
    out = t.select(
        *by, F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), rec.alias("recall"),
        F.coalesce(F.try_divide(tp * 2.0, tp * 2.0 + fp + fn), F.lit(0.0)).alias("f1"), F.try_divide(tn, tn + fp).alias("specificity"), "tp", "fp", "fn", "tn",
    )
    area = auc_of_counts(counted, score, by).select(*by, "auc")
    return out.join(area, by) if by else out.withColumn("auc", F.lit(area.first()["auc"]))


def brier(df: DataFrame, score: str, label: Column) -> DataFrame:
    return briers(df, [score], label).select("brier")


def briers(df: DataFrame, scores: list[str], label: Column) -> DataFrame:
    """(method, brier) for several scores, from one pass."""
    each = df.agg(*[F.avg(F.pow(F.col(s) - label.cast("double"), F.lit(2.0))).alias(s) for s in scores])
    return each.select(F.inline(F.array(*[F.struct(F.lit(s).alias("method"), F.col(s).alias("brier")) for s in scores])))


def calibration_bins(df: DataFrame, score: str, label: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, mean_label) over quantile bins; values at an edge go up, the last bin is closed."""
    edges = [0.0 if e is None else e for e in quantiles(df, score, [k / bins for k in range(bins + 1)])]
    at = F.lit(-1)
    for e in edges:
        at = at + (F.col(score) >= e).cast("int")
    b = F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label.cast("double")).alias("mean_label"))


def expected_calibration_error(df: DataFrame, score: str, label: Column, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, score, label, bins)
    return b.agg((F.sum(F.abs(F.col("mean_score") - F.col("mean_label")) * F.col("n")) / F.sum("n")).alias("ece"))


def frequency_ratio(df: DataFrame, klass: str, flooded: Column, weight: Column) -> DataFrame:
    """(class, area_share, flood_share, frequency_ratio): the flood's share in a class over the class's share."""
    t = df.groupBy(klass).agg(F.sum(weight).alias("__a"), F.sum(F.when(flooded, weight).otherwise(0.0)).alias("__f"))
    s = t.agg(F.sum("__a").alias("a"), F.sum("__f").alias("f")).first()
    area, flood = F.try_divide(F.col("__a"), F.lit(s["a"])), F.try_divide(F.col("__f"), F.lit(s["f"]))
    return t.select(klass, area.alias("area_share"), flood.alias("flood_share"), F.try_divide(flood, area).alias("frequency_ratio"))


def event_evaluation(df: DataFrame, score: str, kind: str, is_positive: Column) -> DataFrame:
    """Map-level checks of one event from a random land sample (kind 'rnd') and labelled cells ('pos', 'neg').

    One row: the areas under the ROC curve against confident and against all other land, the shares of positives
    in the upper 40 and 20 per cent of the land, and the frequency ratio of each fifth.
    """
    ranked = percentile_against(df, score, df.where(F.col(kind) == "rnd").select(F.col(score).alias("__ref")), "__ref")
    pos = ranked.where(F.col(kind) == "pos")
    fifth = F.least(F.greatest(F.floor(F.col("pct") / 20), F.lit(0)), F.lit(4))
    shares = pos.agg(
        F.count("*").alias("n_pos"), F.avg((F.col("pct") >= 60).cast("double")).alias("pos_in_upper_40"), F.avg((F.col("pct") >= 80).cast("double")).alias("pos_in_upper_20"),
        *[(F.avg((fifth == k).cast("double")) / 0.2).alias(f"fr_{k + 1}") for k in range(5)],
    )
    strict = auc(df.where(F.col(kind).isin("pos", "neg")), score, F.col(kind) == "pos").first()["auc"]
    land = auc(df.where((F.col(kind) == "pos") | (F.col(kind) == "rnd") & ~is_positive), score, F.col(kind) == "pos").first()["auc"]
    return shares.withColumns({"auc_pos_vs_neg": F.lit(strict), "auc_pos_vs_all_land": F.lit(land)})
