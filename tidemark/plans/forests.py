"""Random forests of all folds grown together, level by level.

Every (series, horizon, fold) has its own forest, and every forest, tree and open node of a level is
split by one aggregation: histograms keyed by (fold, tree, node, feature, bin). The number of Spark
jobs follows from the depth, never from the folds, trees or series, and no fit runs on the driver.

Rows travel with their bins, their bootstrap weights and the node that each tree has put them in.
Test rows weigh nothing and travel along, so that the last level leaves their predictions. Targets are
counted in ten-thousandths as whole numbers: sums don't depend on the order of rows, and reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.basket import DAY
from tidemark.operators.folds import GROUP, fold_spans, interval_rows
from tidemark.session import scratch_folder
from tidemark.sources.tables import remove

FOLD = [*GROUP, "fold_index"]
UNIT = 10_000
#: Values of which percentile_approx gives exact ranks; beyond it the edges are approximate.
RANKS = 10_000


@dataclass(frozen=True)
class ForestSpec:
    """``bins`` bounds the thresholds tried per feature, ``depth`` the levels of splits."""

    trees: int = fixed.FOREST_TREES
    depth: int = fixed.FOREST_DEPTH
    bins: int = 128
    min_leaf: int = 1
    bootstrap: bool = True
    seed: int = fixed.MODEL_SEED

    def __post_init__(self) -> None:
        for name, low in (("trees", 1), ("depth", 0), ("bins", 2), ("min_leaf", 1)):
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be >= {low}, got {getattr(self, name)}")


def forest_guesses(
    matrix: DataFrame, features: list[str], folds: DataFrame, target: str, spec: ForestSpec = ForestSpec()
) -> DataFrame:
    """(series, horizon, fold, day, y, prediction) of every test row of ``folds``.

    A NULL feature counts as its lowest value; train rows without a target are left out; a tree
    whose bootstrap drew no row has no vote; a fold without train rows predicts NULL. Of equal splits
    the first feature and the lowest threshold count. A node whose best split changes nothing is a leaf.
    """
    spark, folder = matrix.sparkSession, scratch_folder(matrix.sparkSession)
    state, level = None, 0
    while state is None or (level <= spec.depth and not _finished(state)):
        if state is None:
            following = _start(matrix, features, folds, target, spec)
        else:
            following = _descend(state, _splits(state, spec, last=level == spec.depth), spec)
            level += 1
        path = f"{folder}/state-{level}-{'grown' if state is not None else 'new'}"
        following.write.parquet(path)
        if state is not None:
            remove(spark, before)
        state, before = spark.read.parquet(path), path
    guess = F.when(F.col("_votes") > 0, F.col("_sum") / F.col("_votes") / UNIT)
    return state.filter("role = 'test'").select(*FOLD, DAY, "y", guess.alias("prediction"))


def _start(
    matrix: DataFrame, features: list[str], folds: DataFrame, target: str, spec: ForestSpec
) -> DataFrame:
    """Rows of every fold with their bins by the quantiles of the fold's own train rows."""
    values = matrix.select(
        *GROUP, DAY, F.col(f"`{target}`").cast("double").alias("y"),
        F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_x"),
    )
    placed = interval_rows(values, fold_spans(folds)).filter("role = 'test' OR y IS NOT NULL")
    shares = F.array(*[F.lit(i / spec.bins) for i in range(1, spec.bins)])
    quantiles = [
        F.array_distinct(F.percentile_approx(F.get("_x", F.lit(i)), shares, RANKS)) for i in range(len(features))
    ]
    edges = placed.filter("role = 'train'").groupBy(*FOLD).agg(F.array(*quantiles).alias("_edges"))
    below = F.transform(
        F.arrays_zip("_x", "_edges"),
        lambda f: F.size(F.filter(f["_edges"], lambda e: e < f["_x"])),
    )
    return placed.join(edges, FOLD, "left").select(
        *FOLD, DAY, "role", "y", F.round(F.col("y") * UNIT).cast("long").alias("_target"),
        F.when(F.col("_edges").isNotNull(), below).alias("_bins"), _weights(spec).alias("_weights"),
        F.array_repeat(F.lit(0), spec.trees).alias("_slots"), F.lit(0.0).alias("_sum"), F.lit(0).alias("_votes"),
    )


def _weights(spec: ForestSpec) -> Column:
    """How often each tree draws the row: Poisson numbers of a hash, so every attempt draws alike."""
    trees = F.sequence(F.lit(0), F.lit(spec.trees - 1))
    if not spec.bootstrap:
        return F.transform(trees, lambda t: F.lit(1))
    share = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]

    def draw(tree: Column) -> Column:
        hashed = F.xxhash64(F.lit(spec.seed), tree, *GROUP, "row_index")
        point = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
        return sum(((point >= F.lit(c)).cast("int") for c in share[1:]), (point >= F.lit(share[0])).cast("int"))

    return F.transform(trees, draw)


def _splits(state: DataFrame, spec: ForestSpec, last: bool) -> DataFrame:
    """One row per fold: for each tree the array of its open nodes by slot, split or leaf."""
    node = [*FOLD, "tree", "slot"]
    drawn = state.filter("role = 'train'").select(
        *FOLD, "_target", "_bins", F.posexplode(F.arrays_zip("_slots", "_weights")).alias("tree", "_at")
    ).filter("_at._slots IS NOT NULL AND _at._weights > 0")
    weight = F.col("_at._weights").cast("long")
    cells = drawn.select(
        *FOLD, "tree", F.col("_at._slots").alias("slot"), weight.alias("_n"),
        (weight * F.col("_target")).alias("_s"), F.posexplode("_bins").alias("feature", "bin"),
    ).groupBy(*node, "feature", "bin").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    whole = Window.partitionBy(*node, "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = cells.select(
        *node, "feature", "bin", F.sum("_n").over(upto).alias("nl"), F.sum("_s").over(upto).alias("sl"),
        F.sum("_n").over(whole).alias("n"), F.sum("_s").over(whole).alias("s"),
    )
    left, right = F.col("nl"), F.col("n") - F.col("nl")
    apart = F.col("sl") / left - (F.col("s") - F.col("sl")) / F.when(right > 0, right)
    gain = left / F.col("n") * right * (apart * apart)
    allowed = (left >= spec.min_leaf) & (right >= spec.min_leaf) & (gain > 0) & F.lit(not last)
    rank = F.when(allowed, F.struct(gain.alias("g"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    best = scored.groupBy(*node).agg(
        F.max(rank).alias("_best"), (F.max("s") / F.max("n")).alias("leaf")
    )
    # Slots of a tree are dense: the k-th split of a level opens slots 2k and 2k + 1.
    order = Window.partitionBy(*FOLD, "tree").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.sum(F.col("_best").isNotNull().cast("int")).over(order)
    level = best.select(
        *node, (-F.col("_best.f")).alias("feature"), (-F.col("_best.b")).alias("bin"),
        (2 * (opened - 1)).cast("int").alias("opens"), "leaf",
    )
    trees = level.groupBy(*FOLD, "tree").agg(
        F.sort_array(F.collect_list(F.struct("slot", "feature", "bin", "opens", "leaf"))).alias("nodes")
    ).groupBy(*FOLD).agg(F.map_from_entries(F.collect_list(F.struct("tree", "nodes"))).alias("_trees"))
    by_tree = F.transform(F.sequence(F.lit(0), F.lit(spec.trees - 1)), lambda t: F.try_element_at("_trees", t))
    return trees.select(*FOLD, by_tree.alias("_trees"))


def _descend(state: DataFrame, splits: DataFrame, spec: ForestSpec) -> DataFrame:
    """Rows in the nodes of the next level; those that reached a leaf take its mean along."""
    at = state.join(splits, FOLD, "left").withColumn(
        "_nodes", F.transform("_slots", lambda slot, tree: F.get(F.get(F.col("_trees"), tree), slot))
    )
    split = F.transform("_nodes", lambda n: F.when(
        n["feature"].isNotNull(), n["opens"] + (F.get(F.col("_bins"), n["feature"]) > n["bin"]).cast("int")
    ))
    leaf = F.transform(
        F.filter("_nodes", lambda n: n["leaf"].isNotNull() & n["feature"].isNull()), lambda n: n["leaf"]
    )
    return at.withColumn("_leaves", leaf).select(
        *FOLD, DAY, "role", "y", "_target", "_bins", "_weights", split.alias("_slots"),
        F.aggregate("_leaves", F.col("_sum"), lambda a, v: a + v).alias("_sum"),
        (F.col("_votes") + F.size("_leaves")).alias("_votes"),
    )


def _finished(state: DataFrame) -> bool:
    return state.filter(F.exists("_slots", lambda s: s.isNotNull())).isEmpty()
