"""Keyed second-order boosting (M3, M6, M12, M13): the trees of all keys grow together, level by level.

Every key (site, pond, target) has its own ensemble, but one job grows a level of all of them: gradients and
hessians are summed per (key, node, feature, bin) with map-side combining, running sums over the bins give each cut's
regularised gain, and ``max`` over the cuts picks each node's split. Jobs depend on the number of trees and their depth, not on
the number of keys or rows, and a key that holds a third of all rows is combined before the shuffle like any other.

Features are binned on quantiles of each key; blanks are a bin of their own, and a split sends them to the side where
they gain most. Squared error is minimised: a leaf's value is -G / (H + l2) times the learning rate, a split
needs a gain above ``gamma``. Columns are drawn per tree, rows per tree by a hash, both from the seed.

The ensemble is a table with one row per key, its trees as arrays in heap order, and is scored by column expressions.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pondflow.keys import as_keys
from pondflow.session import drop_stored, stored

# Capacity as configured in the reference (trees, depth, rate, row and column samples, least gain).
CALENDAR = dict(trees=200, depth=5, rate=0.05, rows=0.8, columns=0.8)
RECURSIVE = dict(trees=300, depth=6, rate=0.05, rows=0.9, columns=1.0)
RECURSIVE_KG = dict(trees=300, depth=6, rate=0.05, rows=0.8, columns=0.8, gamma=0.1)

DEFAULTS = dict(trees=200, depth=5, rate=0.05, rows=1.0, columns=1.0, l2=1.0, gamma=0.0, least_rows=1.0, bins=64, seed=42)
ACCURACY = 100_000  # of the quantiles that bins are cut at
LEAST_GAIN = 1e-9   # a gain above rounding


@dataclass
class Boosted:
    """A fitted ensemble: ``table`` has a row per key with ``base``, ``depth`` and ``ensemble``, an array of trees of
    (feature, cut, blanks_left, value) arrays in heap order; a node without a feature is a leaf."""
    keys: list[str]
    features: list[str]
    table: DataFrame

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)


def load_boosted(spark: SparkSession, path: str, keys, features: Sequence[str]) -> Boosted:
    return Boosted(as_keys(keys), list(features), spark.read.parquet(path))


def _number(name: str) -> Column:
    """The feature as a double, NaN as null."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def feature_cuts(df: DataFrame, keys, features: Sequence[str], bins: int = 64) -> DataFrame:
    """(keys…, cuts): for each feature its distinct quantiles, ascending; a cut c splits into x <= c and x > c. One aggregate."""
    share = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = [F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(_number(f), share, ACCURACY), F.array().cast("array<double>")))) for f in features]
    return df.groupBy(*as_keys(keys)).agg(*[c.alias(f"_c{i}") for i, c in enumerate(cuts)]).select(
        *as_keys(keys), F.array(*[f"_c{i}" for i in range(len(features))]).alias("cuts"))


def _drawn(features: int, share: float, tree: int, seed: int) -> list[int]:
    """The columns a tree may split on."""
    order = sorted(range(features), key=lambda f: hashlib.md5(f"{seed}|{tree}|{f}".encode()).hexdigest())
    return sorted(order[:max(1, round(share * features))])


def keyed(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``table`` (one row per key) at its rows."""
    other = table.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    cond = F.lit(True)
    for c in keys:
        cond = cond & df[c].eqNullSafe(other[f"_k_{c}"])
    if not keys:
        df, other = df.withColumn("_one", F.lit(1)), other.withColumn("_one2", F.lit(1))
        return df.join(other, F.col("_one") == F.col("_one2"), how).drop("_one", "_one2")
    return df.join(other, cond, how).drop(*[f"_k_{c}" for c in keys])


def best_splits(rows: DataFrame, keys: list[str], columns: Sequence[int], l2: float, gamma: float, least_rows: float) -> DataFrame:
    """(keys…, node, g, h, f, bin, blanks_left, gl, hl): the totals of every node and its best split; without one that gains
    more than ``gamma``, f is null. ``rows`` has (keys…, node, g, bins), blanks as bin -1."""
    node = [*keys, "node"]
    drawn = F.array_contains(F.lit(list(columns)), F.col("f"))
    sums = (rows.select(*node, "g", F.posexplode("bins").alias("f", "bin")).where(drawn)
            .groupBy(*node, "f", "bin").agg(F.sum("g").alias("g"), F.count("*").cast("double").alias("h")))
    whole = Window.partitionBy(*node, "f")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.col("bin") < 0
    spread = (sums.repartition(*[F.col(c) for c in keys or ["node"]])  # a key's cells: nodes times bins times features at most
              .withColumns({"gm": F.coalesce(F.sum(F.when(blank, F.col("g"))).over(whole), F.lit(0.0)),
                            "hm": F.coalesce(F.sum(F.when(blank, F.col("h"))).over(whole), F.lit(0.0)),
                            "gs": F.sum("g").over(whole), "hs": F.sum("h").over(whole), "ga": F.sum("g").over(upto), "ha": F.sum("h").over(upto)}))

    def side(left: bool) -> Column:
        gl = F.col("ga") if left else F.col("ga") - F.col("gm")
        hl = F.col("ha") if left else F.col("ha") - F.col("hm")
        gr, hr = F.col("gs") - gl, F.col("hs") - hl
        gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - F.col("gs") * F.col("gs") / (F.col("hs") + l2)
        # gains that differ by rounding only are equal: the lower feature and bin win, blanks go right
        fine = (~blank) & (hl >= least_rows) & (hr >= least_rows) & (gain > max(gamma, LEAST_GAIN))
        return F.when(fine, F.struct(gain.cast("float").alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"),
                                     F.lit(not left).alias("right"), gl.alias("gl"), hl.alias("hl")))

    best = F.max(F.greatest(side(True), side(False)))
    out = spread.groupBy(*node).agg(best.alias("x"), F.max(F.struct((-F.col("f")).alias("f"), "gs", "hs")).alias("t"))
    return out.select(*node, F.col("t.gs").alias("g"), F.col("t.hs").alias("h"), (-F.col("x.f")).alias("f"), (-F.col("x.bin")).alias("bin"),
                      (~F.col("x.right")).alias("blanks_left"), F.col("x.gl").alias("gl"), F.col("x.hl").alias("hl"))


#: From a row's bins to the number of the node its walk through ``tree`` (an array of nodes in heap order) ends in.
WALK = ("aggregate(sequence(1, {depth}), 0, (i, _) -> if(tree[i].f is null, i, 2 * i + if("
        "if(bins[tree[i].f] < 0, tree[i].blanks_left, bins[tree[i].f] <= tree[i].bin), 1, 2)))")


def _grow(rows: DataFrame, keys: list[str], columns: Sequence[int], drawn: Column, p: dict) -> DataFrame:
    """(keys…, tree): one tree of every key, grown level by level on ``rows`` (keys…, bins, y, pred, mark).

    After each level the trees so far are one small table, an array of nodes in heap order a key, and the next level finds the
    rows' nodes by walking them: every level has the same short plan.
    """
    def value(g, h):
        return -g / (h + p["l2"]) * p["rate"]

    none = F.lit(None)
    leaf = lambda n, v: F.struct(n.alias("node"), F.struct(none.cast("int").alias("f"), none.cast("int").alias("bin"),
                                                           none.cast("boolean").alias("blanks_left"), v.alias("value")).alias("x"))
    g, h, gl, hl = (F.col(c) for c in ("g", "h", "gl", "hl"))
    own = F.struct(F.col("node").alias("node"), F.struct("f", "bin", "blanks_left", value(g, h).alias("value")).alias("x"))
    kids = F.when(F.col("f").isNotNull(), F.array(leaf(2 * F.col("node") + 1, value(gl, hl)), leaf(2 * F.col("node") + 2, value(g - gl, h - hl))))
    found_nodes = F.concat(F.array(own), F.coalesce(kids, F.array()))
    size, trees = 2 ** (p["depth"] + 1) - 1, None
    for level in range(p["depth"]):
        at = rows.where(drawn)
        if trees is None:
            at = at.withColumn("node", F.lit(0))
        else:
            at = keyed(at, trees, keys).withColumn("node", F.expr(WALK.format(depth=p["depth"]))).where(F.col("node") >= 2 ** level - 1)
        grads = at.select(*keys, "node", (F.col("pred") - F.col("y")).alias("g"), "bins")
        found = best_splits(grads, keys, columns, p["l2"], p["gamma"], p["least_rows"])
        new = found.select(*keys, F.explode(found_nodes).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list("n")).alias("new"))
        if trees is None:
            new = new.withColumn("tree", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.element_at("new", i)))
            grown = stored(new.select(*keys, "tree"), "trees")
        else:
            # a key whose nodes are all closed has no new ones
            new = keyed(trees, new, keys, "left").withColumn("tree", F.expr("if(new is null, tree, transform(tree, (n, i) -> coalesce(new[i], n)))"))
            grown = stored(new.select(*keys, "tree"), "trees")
            drop_stored(trees)
        trees = grown
    return trees


def fit_boosted(df: DataFrame, keys, features: Sequence[str], label: str, params: dict | None = None) -> Boosted:
    """One boosted ensemble per key of ``df`` (``keys`` may be empty or hold nulls, which are a key of their own).

    Rows without a label (null, NaN) are not learned from; a key without any gets no ensemble. Blank features are allowed.
    Row samples go by the hash of the row's features and label, so equal rows are drawn alike.
    """
    p = {**DEFAULTS, **(params or {})}
    keys, features = as_keys(keys), list(features)
    known = df.select(*keys, *[_number(f).alias(f) for f in features], _number(label).alias("_y")).where("_y is not null")
    known = known.select(*keys, F.array(*features).alias("x"), F.col("_y").alias("y"))
    wide = known.select(*keys, "y", *[F.element_at("x", i + 1).alias(f) for i, f in enumerate(features)])
    cuts = stored(keyed(feature_cuts(wide, keys, features, p["bins"]), known.groupBy(*keys).agg(F.avg("y").alias("base")), keys), "cuts")
    bins = F.transform(F.arrays_zip("x", "cuts"), lambda z: F.when(z["x"].isNull(), -1).otherwise(F.size(F.filter(z["cuts"], lambda c: c < z["x"]))))
    rows = keyed(known, cuts, keys).select(*keys, bins.alias("bins"), "y", F.col("base").alias("pred"),
                                            F.xxhash64("x", "y", F.lit(p["seed"])).alias("mark"))
    rows, trees = stored(rows, "rows"), []
    for t in range(p["trees"]):
        drawn = F.pmod(F.xxhash64("mark", F.lit(str(t))), F.lit(10_000)) < round(p["rows"] * 10_000)
        tree = _grow(rows, keys, _drawn(len(features), p["columns"], t, p["seed"]), drawn, p)
        trees.append(tree)
        if t + 1 < p["trees"]:
            gain = F.coalesce(F.expr(f"tree[{WALK.format(depth=p['depth'])}].value"), F.lit(0.0))
            new = stored(keyed(rows, tree, keys, "left").select(*keys, "bins", "y", (F.col("pred") + gain).alias("pred"), "mark"), "rows")
            drop_stored(rows)
            rows = new
    drop_stored(rows)
    every = [x.withColumn("t", F.lit(t)) for t, x in enumerate(trees)]
    cut = "case when n.f is null then null when n.bin >= size(cuts[n.f]) then double('infinity') else get(cuts[n.f], n.bin) end"
    table = keyed(functools.reduce(DataFrame.unionByName, every), cuts, keys).withColumn("n", F.expr(
        f"transform(tree, n -> struct(n.f as feature, {cut} as cut, n.blanks_left as blanks_left, n.value as value))"))
    one = F.struct("t", *[F.col(f"n.{c}").alias(c) for c in ("feature", "cut", "blanks_left", "value")])
    table = table.groupBy(*keys).agg(F.first("base").alias("base"), F.sort_array(F.collect_list(one)).alias("ensemble"))
    table = stored(table.withColumn("depth", F.lit(p["depth"])), "ensemble")
    for x in [*trees, cuts]:
        drop_stored(x)
    return Boosted(keys, features, table)


def prediction(x: str = "_x", base: str = "base", depth: str = "depth", ensemble: str = "ensemble", as_text: bool = False) -> Column | str:
    """The ensemble's value at the feature array ``x``: base plus, for every tree, the value of the node its walk ends in."""
    goes_left = f"if(get({x}, t.feature[i]) is null, t.blanks_left[i], get({x}, t.feature[i]) <= t.cut[i])"
    walk = f"aggregate(sequence(1, {depth}), 0, (i, _) -> if(t.feature[i] is null, i, 2 * i + if({goes_left}, 1, 2)))"
    text = f"aggregate({ensemble}, {base}, (a, t) -> a + t.value[{walk}])"
    return text if as_text else F.expr(text)


def score_boosted(model: Boosted, df: DataFrame, out: str = "prediction") -> DataFrame:
    """``df`` with each row's prediction by its key's ensemble; null for keys that have none. One join on the keys, where adaptive
    skew joins split a hot key; the walk is a column expression."""
    x = F.array(*[_number(f) for f in model.features])
    rows = keyed(df.withColumn("_x", x), model.table.select(*model.keys, "base", "depth", "ensemble"), model.keys, "left")
    return rows.withColumn(out, prediction()).drop("_x", "base", "depth", "ensemble")
