"""Gradient-boosted trees grown leaf by leaf: ridge in the gain, monotone constraints, splits of categories, missing values.

Features are quantised once into a table of small integers. Each pass over it is one aggregate, the sums of gradients
and hessians by (node, feature, bin), and a window over those sums that gives every node's best split: what comes to the
driver is a row a node. Growth is best first, but a pass looks ahead: it sums for the children of every leaf that
may be split next, so a tree takes about as many passes as it is deep, not one a split, with the same result.

Gradients are summed as whole numbers, so a tree depends neither on how rows lie in partitions nor on a task run again.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import cut_points
from .sampling import draw

#: Gradients and hessians are summed in steps of 1 / SCALE.
SCALE = 1 << 24
#: Trees after which the scores so far are written out, so that expressions stay short.
WRITTEN = 8


@dataclass(frozen=True)
class Boosting:
    """What to fit: features, label, rounds, size of the trees and what splits have to keep to.

    monotone: feature -> 1 if the score must not fall as the feature grows, -1 if it must not rise. categorical: features
    whose values are unordered. l2: ridge on leaf values. least_rows, least_hessian: what each side of a split needs.
    bagging: share of rows drawn anew each tree, by hash of the keys.
    """

    features: tuple[str, ...]
    label: str = "y"
    rounds: int = 10
    leaves: int = 15
    rate: float = 0.1
    l2: float = 1.0
    least_rows: int = 20
    least_hessian: float = 1e-3
    least_gain: float = 0.0
    bins: int = 255
    monotone: dict[str, int] = field(default_factory=dict)
    categorical: tuple[str, ...] = ()
    weight: str | None = None
    bagging: float = 1.0
    keys: tuple[str, ...] = ()
    seed: int = 42


@dataclass
class Split:
    """feature and the bins that go left: up to `last`, or a set; missing values (bin 0) as `missing_left` says."""

    feature: int
    gain: float
    last: int
    bins_left: list[int] | None
    missing_left: bool


@dataclass
class Node:
    low: float
    high: float
    value: float
    split: Split | None = None
    known: bool = False
    children: tuple[int, int] | None = None


@dataclass
class Quantised:
    """Edges of the ordered features, values of the categories; a value's bin is 0 if missing or unseen."""

    edges: list[list[float] | None]
    values: list[list | None]


def _missing(x: Column, kind: str) -> Column:
    return x.isNull() | F.isnan(x) if kind in ("double", "float") else x.isNull()


def quantise(df: DataFrame, what: Boosting) -> Quantised:
    """Bin edges by exact quantiles (every distinct value where there are few), and the most frequent categories."""
    kinds = dict(df.dtypes)
    ordered = [f for f in what.features if f not in what.categorical]
    there = {f: F.when(~_missing(F.col(f), kinds[f]), F.col(f).cast("double")) for f in ordered}  # nulls and NaN are no part of an order
    edges = {f: found[:-1] for f, found in cut_points(df, there, what.bins).items()}
    values = {}
    for f in what.categorical:
        top = df.where(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("n")).orderBy(F.desc("n"), f).limit(what.bins)
        values[f] = sorted(r[f] for r in top.collect())
    return Quantised([edges.get(f) for f in what.features], [values.get(f) for f in what.features])


def binned(df: DataFrame, what: Boosting, q: Quantised, only: tuple[str, ...] | None = None) -> DataFrame:
    """df with __b0, __b1, ...: the bins of the features, or of some only."""
    kinds = dict(df.dtypes)

    def bin_of(k: int, f: str) -> Column:
        x = F.col(f)
        if f in what.categorical:
            return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in q.values[k]]), x), F.lit(0)).cast("int") if q.values[k] else F.lit(0)
        below = len(q.edges[k]) - F.col(f"__u{k}").cast("int") if q.edges[k] else F.lit(0)
        return F.when(_missing(x, kinds[f]), 0).otherwise(below + 1).cast("int")

    wanted = {k: f for k, f in enumerate(what.features) if only is None or f in only}
    searched = [k for k, f in wanted.items() if f not in what.categorical and q.edges[k]]
    if searched:  # by binary search: the edges below x are those that -x does not reach when all are negated
        df = df.withColumns({f"__v{k}": F.coalesce(F.lit(0.0) - F.col(wanted[k]).cast("double"), F.lit(float("nan"))) for k in searched})
        splits = [[float("-inf"), *[0.0 - e for e in reversed(q.edges[k])], float("inf")] for k in searched]
        df = Bucketizer(splitsArray=splits, inputCols=[f"__v{k}" for k in searched], outputCols=[f"__u{k}" for k in searched], handleInvalid="keep").transform(df)
    return df.withColumns({f"__b{k}": bin_of(k, f) for k, f in wanted.items()}).drop(*[f"__{c}{k}" for k in searched for c in "vu"])


def histograms(rows: DataFrame, node: Column, n_features: int, g: Column, h: Column, n: Column | None = None) -> DataFrame:
    """(node, feature, bin, g, h, n): sums over the rows of each node (null: of none), whole numbers; n: how many equal rows each stands for."""
    times = F.lit(1).cast("long") if n is None else n
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"__b{k}").alias("bin")) for k in range(n_features)]))
    each = rows.select(node.alias("node"), (F.round(g * SCALE).cast("long") * times).alias("g"), (F.round(h * SCALE).cast("long") * times).alias("h"), times.alias("n"), *[f"__b{k}" for k in range(n_features)])
    return each.where("node is not null").select("node", "g", "h", "n", bins.alias("x")).groupBy("node", "x.feature", "x.bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


def split_gains(hist: DataFrame, what: Boosting, low: str = "", high: str = "") -> DataFrame:
    """A row for each split that a node allows: node, feature, last (the last bin that goes left), missing_left, n_left,
    gain, left_value, right_value, and for categories bins_left.

    Categories are ordered by gradient over hessian within the node, which makes the best subset a prefix. low and high:
    SQL for the bounds of the node's leaf values. Splits against a constraint's sign are none.
    """
    unordered = [k for k, f in enumerate(what.features) if f in what.categorical]
    is_category = f"feature IN ({', '.join(map(str, unordered))})" if unordered else "false"
    no, l2 = f"(bin = 0 AND NOT {is_category})", f"{float(what.l2)!r}D"
    whole = "OVER (PARTITION BY node, feature)"
    order = f"CASE WHEN {is_category} THEN g / (h + 1e-6D) ELSE bin END"
    sums = hist.selectExpr(
        "node", "feature", "bin", f"{order} AS place", *[f"CASE WHEN {no} THEN 0 ELSE {c} END AS there_{c}" for c in "ghn"],
        *[f"sum({c}) {whole} AS all_{c}" for c in "ghn"], *[f"coalesce(sum(CASE WHEN {no} THEN {c} END) {whole}, 0) AS no_{c}" for c in "ghn"],
    )
    so_far = "OVER (PARTITION BY node, feature ORDER BY place, bin ROWS UNBOUNDED PRECEDING)"
    # missing values go to either side; the rows are doubled for that once the windows are done
    lefts = sums.selectExpr(
        "node", "feature", "bin AS last", *[f"all_{c}" for c in "ghn"], *[f"no_{c}" for c in "ghn"], *[f"sum(there_{c}) {so_far} AS l_{c}" for c in "ghn"],
        f"CASE WHEN {is_category} THEN collect_list(CASE WHEN {is_category} THEN bin END) {so_far} END AS bins_left",
    ).selectExpr("*", "explode(CASE WHEN no_n > 0 THEN array(true, false) ELSE array(true) END) AS missing_left")
    left = {c: f"(l_{c} + CASE WHEN missing_left THEN no_{c} ELSE 0 END)" for c in "ghn"}
    real = lambda c: f"/ {float(SCALE)!r}D" if c in "gh" else ""
    split = lefts.selectExpr(
        "node", "feature", "last", "missing_left", "bins_left", *[f"{left[c]} {real(c)} AS left_{c}" for c in "ghn"],
        *[f"(all_{c} - {left[c]}) {real(c)} AS right_{c}" for c in "ghn"], *[f"all_{c} {real(c)} AS node_{c}" for c in "gh"],
    )
    bounded = f"least(greatest(%s, {low}), {high})" if low else "%s"
    valued = split.selectExpr("*", *[f"{bounded % f'-{side}_g / ({side}_h + {l2})'} AS {side}_value" for side in ("left", "right", "node")])
    # what a node's rows lose less with their value than with 0, twice
    worth = [f"(2 * {side}_g + ({side}_h + {l2}) * {side}_value) * {side}_value" for side in ("left", "right", "node")]
    signs = " ".join(f"WHEN {k} THEN {what.monotone[f]}" for k, f in enumerate(what.features) if f in what.monotone)
    forbidden = f"(CASE feature {signs} ELSE 0 END) * (right_value - left_value) < 0" if signs else "false"
    enough = " AND ".join(f"{side}_n >= {max(1, what.least_rows)} AND {side}_h >= {float(what.least_hessian)!r}D" for side in ("left", "right"))
    return valued.where(f"{enough} AND NOT {forbidden}").selectExpr(
        "node", "feature", "last", "missing_left", "bins_left", "left_n AS n_left", f"{worth[2]} - {worth[0]} - {worth[1]} AS gain", "left_value", "right_value",
    )


def _route(nodes: list[Node], condition: Callable[[Split], str], leaf: Callable[[int], str], opened: set[int], at: int = 0) -> str:
    """SQL for what a row's node gives, following the splits of the opened nodes."""
    if at not in opened:
        return leaf(at)
    left, right = (_route(nodes, condition, leaf, opened, child) for child in nodes[at].children)
    return f"CASE WHEN {condition(nodes[at].split)} THEN {left} ELSE {right} END"


def _by_bin(s: Split) -> str:
    """SQL for whether a row's bin goes left."""
    b = f"__b{s.feature}"
    if s.bins_left is not None:
        return f"{b} IN ({', '.join(map(str, s.bins_left))})"
    return f"{b} <= {s.last}" if s.missing_left else f"{b} <= {s.last} AND {b} > 0"


def _number(x: float) -> str:
    """A double in SQL."""
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def grow(rows: DataFrame, what: Boosting, g: Column, h: Column, allowed: tuple[int, ...] | None = None, times: Column | None = None) -> tuple[list[Node], set[int]]:
    """(nodes, those that are split) of the tree that best-first growth makes of the rows' gradients.

    allowed: the features to choose from, all by default. times: how many equal rows each stands for, 1 by default.
    """
    nodes = [Node(float("-inf"), float("inf"), 0.0)]

    def look(ask: list[int]) -> None:
        """Best splits of nodes, from one aggregate; each gets children to be asked for later."""
        asked = set(ask)
        inner = {k for k, n in enumerate(nodes) if n.children}
        node = F.expr(f"int({_route(nodes, _by_bin, lambda k: str(k) if k in asked else 'null', inner)})")
        hist = histograms(rows, node, len(what.features), g, h, times)
        if allowed is not None:
            hist = hist.where(F.col("feature").isin(list(allowed)))
        bounds = [_bound(nodes, ask, end) for end in ("low", "high")] if what.monotone else []
        gains = split_gains(hist.repartition("node"), what, *bounds)  # a few rows a node; one exchange for all that follows
        best = gains.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("less"), "feature", "last", F.col("missing_left").alias("missing_left"), "left_value", "right_value", "bins_left")).alias("s")).collect()
        for k in ask:
            nodes[k].known = True
        for r in sorted(best, key=lambda r: r["node"]):
            n, s = nodes[r["node"]], r["s"]
            if -s["less"] <= what.least_gain:
                continue
            a, b = s["left_value"], s["right_value"]
            n.split = Split(s["feature"], -s["less"], s["last"], sorted(s["bins_left"]) if s["bins_left"] is not None else None, s["missing_left"])
            sign, middle = what.monotone.get(what.features[s["feature"]], 0), (a + b) / 2
            ends = [(n.low, n.high)] * 2 if not sign else [(n.low, middle), (middle, n.high)] if sign > 0 else [(middle, n.high), (n.low, middle)]
            n.children = (len(nodes), len(nodes) + 1)
            nodes.extend(Node(*e, v) for e, v in zip(ends, (a, b)))

    look([0])
    while True:
        opened, leaves = set(), [0]
        while len(leaves) < what.leaves:
            best = max((k for k in leaves if nodes[k].split), key=lambda k: (nodes[k].split.gain, -k), default=None)
            if best is None or not all(nodes[c].known for c in nodes[best].children):
                break
            opened.add(best)
            leaves.remove(best)
            leaves += nodes[best].children
        else:
            return nodes, opened
        if best is None:
            return nodes, opened
        # all leaves that may be among the next to be split
        likely = sorted((k for k in leaves if nodes[k].split), key=lambda k: (-nodes[k].split.gain, k))[: what.leaves - len(leaves)]
        if len(leaves) + 1 == what.leaves:  # the last split: its children are leaves whatever they hold
            for c in nodes[best].children:
                nodes[c].known = True
            continue
        look([c for k in likely for c in nodes[k].children if not nodes[c].known])


def _bound(nodes: list[Node], ask: list[int], end: str) -> str:
    """SQL for a bound of the leaf values, by node."""
    return "CASE node " + " ".join(f"WHEN {k} THEN {_number(getattr(nodes[k], end))}" for k in ask) + " END"


@dataclass
class Model:
    """Trees over the features' values; margin() and scores() are column expressions, so scoring is a projection."""

    what: Boosting
    quantised: Quantised
    base: float
    trees: list[tuple[list[Node], set[int]]]
    kinds: dict[str, str]

    def _by_value(self, s: Split) -> str:
        f = self.what.features[s.feature]
        if s.bins_left is not None:
            return f"__b{s.feature} IN ({', '.join(map(str, s.bins_left))})"
        x, edges = f"`{f}`", self.quantised.edges[s.feature]
        below = f"{x} <= {_number(edges[s.last - 1])}" if 0 < s.last <= len(edges) else str(s.last > 0)
        gone = f"{x} IS NULL" + (f" OR isnan({x})" if self.kinds[f] in ("double", "float") else "")
        return f"CASE WHEN {gone} THEN {s.missing_left} ELSE {below} END"

    def margin(self) -> Column:
        """The sum of the trees; categories are looked up as bins first."""
        trees = [_route(nodes, self._by_value, lambda k, n=nodes: _number(n[k].value * self.what.rate), opened) for nodes, opened in self.trees]
        return F.expr(" + ".join([_number(self.base), *trees]))

    def scores(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the probability of class 1."""
        bins = [f"__b{k}" for k, f in enumerate(self.what.features) if f in self.what.categorical]
        with_bins = binned(df, self.what, self.quantised, only=self.what.categorical) if bins else df
        return with_bins.withColumn(name, 1 / (1 + F.exp(-self.margin()))).drop(*bins)

    def gain_importance(self) -> dict[str, float]:
        """By feature the gains of its splits, summed, as shares."""
        total: dict[str, float] = dict.fromkeys(self.what.features, 0.0)
        for nodes, opened in self.trees:
            for k in opened:
                total[self.what.features[nodes[k].split.feature]] += nodes[k].split.gain
        whole = sum(total.values()) or 1.0
        return {f: v / whole for f, v in total.items()}


def fit(df: DataFrame, what: Boosting, written: bool = False) -> Model:
    """The model of logistic loss on df.

    Rows without a label are left out; missing values and unseen categories have a bin of their own, which goes to the
    side that gains more; repeated rows count each. Without rows, or of one class alone, the model is a constant.
    written: df reads a table as it is, so that its rows need no copy to be read twice.
    """
    return fits(df, [what], written)[0]


def fits(df: DataFrame, whats: list[Boosting], written: bool = False) -> list[Model]:
    """A model each; those that see the rows alike (all but rounds, trees and constraints equal) share one table of bins."""
    if any(set(what.monotone) & set(what.categorical) for what in whats):
        raise ValueError("categories have no order to be monotone in")
    seen: dict[tuple, tuple] = {}
    out = []
    for what in whats:
        key = (what.features, what.label, what.weight, what.bins, what.categorical, what.keys, what.bagging < 1)
        if key not in seen:
            seen[key] = _placed(df, what, written)
        out.append(_fit(*seen[key], what))
    return out


def _placed(df: DataFrame, what: Boosting, written: bool) -> tuple[DataFrame, Quantised, dict[str, str]]:
    """Rows of bins with their number, the bins, and the types of df."""
    needed = dict.fromkeys([*what.features, what.label, *([what.weight] if what.weight else []), *what.keys])
    df = df.where(F.col(what.label).isNotNull()).select(*[F.col(f"`{c}`") for c in needed])
    df = df if written else cut(df)  # read twice below
    w = F.col(what.weight).cast("double") if what.weight else F.lit(1.0)
    q = quantise(df, what)
    kept = [f"__b{k}" for k in range(len(what.features))]
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(what.keys)]
    placed = binned(df, what, q).select(*kept, F.col(what.label).cast("double").alias("__y"), w.alias("__w"), *keys)
    # rows alike in all that growth sees are one, with their number; it tells rows by their keys if it draws by them
    alike = placed.drop(*([] if what.bagging < 1 else [f"__k{i}" for i in range(len(keys))]))
    return cut(alike.groupBy(*alike.columns).agg(F.count("*").alias("__n")).withColumn("__s", F.lit(0.0))), q, dict(df.dtypes)


def _fit(rows: DataFrame, q: Quantised, kinds: dict[str, str], what: Boosting) -> Model:
    keys = what.keys
    share = rows.agg((F.sum(F.col("__w") * F.col("__y") * F.col("__n")) / F.sum(F.col("__w") * F.col("__n"))).alias("p")).first()["p"]
    one = share is None or share <= 0 or share >= 1
    base = 0.0 if share is None else math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    trees: list[tuple[list[Node], set[int]]] = []
    score = F.lit(base)
    for k in range(0 if one else what.rounds):
        p = 1 / (1 + F.exp(-(F.col("__s") + score)))
        part = rows.where(draw([f"__k{i}" for i in range(len(keys))], what.seed + k) < what.bagging) if what.bagging < 1 and keys else rows
        nodes, opened = grow(part, what, F.col("__w") * (p - F.col("__y")), F.col("__w") * p * (1 - p), times=F.col("__n"))
        if not opened:
            break
        trees.append((nodes, opened))
        score = score + F.expr(_route(nodes, _by_bin, lambda i, n=nodes: _number(n[i].value * what.rate), opened))
        if (k + 1) % WRITTEN == 0 and k + 1 < what.rounds:
            rows = cut(rows.withColumn("__s", F.col("__s") + score))
            score = F.lit(0.0)
    return Model(what, q, base, trees, kinds)
