import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds as W
from tidemark.plans import models as M

SCHEMA = ("series_id string, as_of_date date, horizon_days int, spot_price_level double, u double, "
          "target_price_level double")


def frame(spark, sizes, seed=1):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    rows = [(f"s{n}", start + dt.timedelta(days=i), 30, round(rng.uniform(50, 90), 1), float(rng.randrange(4)), round(rng.uniform(1, 9), 2))
            for n in sizes for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def plain_tree(train, depth):
    """(x, y) rows to a function: the split with the largest drop of squared error, first feature, lowest value."""
    mean = sum(y for _, y in train) / len(train)
    best = None
    if depth > 0:
        for f in range(len(train[0][0])):
            for cut in sorted({x[f] for x, _ in train})[:-1]:
                left = [r for r in train if r[0][f] <= cut]
                right = [r for r in train if r[0][f] > cut]
                a, b = sum(y for _, y in left) / len(left), sum(y for _, y in right) / len(right)
                gain = len(left) / len(train) * len(right) * ((a - b) * (a - b))
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, cut, left, right)
    if best is None:
        return lambda x: mean
    _, f, cut, left, right = best
    low, high = plain_tree(left, depth - 1), plain_tree(right, depth - 1)
    return lambda x: low(x) if x[f] <= cut else high(x)


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_trees_of_all_folds_equal_plain_ones(spark, depth):
    rows, df = frame(spark, (2, 19, 41))
    settings = {"min_train": 15, "test_size": 8}
    spec = M.ForestSpec(trees=1, depth=depth, bins=256, bootstrap=False)
    got = {(r.series_id, r.fold_index, r.as_of_date): r.prediction
           for r in M.forest_predictions(df, ["spot_price_level", "u"], spec, **settings).collect()}
    want = {}
    for b in M.fold_bounds(df, **settings).collect():
        own = sorted(r for r in rows if r[0] == b.series_id)
        tree = plain_tree([((r[3], r[4]), r[5]) for r in own[:b.train_end]], depth)
        want |= {(b.series_id, b.fold_index, r[1]): tree((r[3], r[4])) for r in own[b.train_end:b.test_end]}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(got) == 29


def test_forest_is_the_same_in_any_partitioning(spark):
    _, df = frame(spark, (30,))
    spec = M.ForestSpec(trees=5, depth=3)
    run = lambda d: sorted(tuple(r) for r in M.forest_predictions(
        d, ["spot_price_level"], spec, min_train=20, test_size=5).collect())
    assert run(df) == run(df.repartition(3, "u"))


def test_number_of_jobs_does_not_follow_the_folds(spark):
    _, df = frame(spark, (60,))
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, test_size):
        spark.sparkContext.setJobGroup(name, name)
        try:
            spec = M.ForestSpec(trees=2, depth=1)
            n = M.forest_predictions(df, ["u"], spec, min_train=20, test_size=test_size).select("fold_index").distinct().count()
            return n, len(tracker.getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (few, a), (many, b) = jobs("few", 20), jobs("many", 2)
    assert (few, many) == (2, 20) and a == b


def test_edges_of_a_forest(spark):
    """Equal targets, missing features and targets, a train set without targets, no rows at all."""
    _, df = frame(spark, (12,))
    settings = {"min_train": 8, "test_size": 4}
    spec = M.ForestSpec(trees=3, depth=2)
    run = lambda d: M.forest_predictions(d, ["spot_price_level", "u"], spec, **settings).collect()
    assert {r.prediction for r in run(df.withColumn("target_price_level", F.lit(7.25)))} == {7.25}
    assert all(r.prediction is not None for r in run(df.withColumn("u", F.lit(None).cast("double"))))
    early = F.col("as_of_date") < dt.date(2024, 1, 9)
    blank = df.withColumn("target_price_level", F.when(~early, F.col("target_price_level")))
    assert [r.prediction for r in run(blank)] == [None] * 4
    assert run(df.limit(0)) == []
    with pytest.raises(ValueError):
        M.ForestSpec(bins=1)


@pytest.mark.parametrize("spec", [W.WalkForward(min_train=5), W.WalkForward(min_train=5, train_window=70, step_days=20)])
def test_members_and_totals_against_loops(spark, spec):
    rng = random.Random(4)
    rows = [(f"s{n}", d, h, rng.randrange(1000) if rng.random() < 0.9 else None, "clash") for n in (1, 3, 150) for h in (3, 40)
            for d in sorted(rng.sample([dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(300)], n))]
    df = spark.createDataFrame(rows, "series_id string, as_of_date date, horizon_days int, v long, role string")
    folds = W.walk_forward(df, spec).cache()
    want, totals = set(), {}
    for f in folds.collect():
        own = [r for r in rows if (r[0], r[2]) == (f.series_id, f.horizon_days)]
        for role, part in (("train", own[f.train_start:f.train_end]), ("test", [own[f.test_index]])):
            key = (f.series_id, f.horizon_days, f.fold_index, role)
            want |= {(*key, r[1]) for r in part}
            totals[key] = (len(part), sum(r[3] or 0 for r in part))
    assert {tuple(r) for r in W.members(df, folds).collect()} == want and len(want) > 200
    got = {tuple(r[:4]): (r.n_rows, r.total) for r in W.fold_totals(df, folds, {"total": F.col("v")}).collect()}
    assert got == totals
    plan = W.members(df, folds)._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan
    assert W.members(df.limit(0), folds.limit(0)).isEmpty()
