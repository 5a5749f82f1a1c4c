"""Baselines, rolling out-of-sample evaluation and feature importance."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.basket import DAY
from tidemark.operators.folds import GROUP, numbered, rolling_origin
from tidemark.plans.forests import ForestSpec, forest_guesses
from tidemark.plans.kpi import regression_metrics
from tidemark.session import cut_lineage

SPOT, TARGET = "spot_price_level", "target_price_level"


def fold_bounds(rows: DataFrame, **settings: int) -> DataFrame:
    sizes = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_rows"))
    return rolling_origin(sizes, **settings)


def test_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row with the fold it is tested in; tests of consecutive folds may overlap by step.

    A fold names the positions that it tests, so the join has as many rows as there are tests.
    """
    places = folds.select(
        *GROUP, "fold_index", "train_end", "test_end",
        F.explode(F.sequence("train_end", F.col("test_end") - 1)).alias("row_index"),
    )
    return numbered(rows).join(places, [*GROUP, "row_index"])


def naive_predictions(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Spot carried forward."""
    return _predictions(test_rows(rows, folds), fixed.NAIVE, F.col(SPOT))


def _predictions(tested: DataFrame, name: str, guess: Column) -> DataFrame:
    return tested.select(
        *GROUP,
        F.lit(name).alias("model_name"),
        "fold_index",
        DAY,
        F.col(TARGET).cast("double").alias("y"),
        guess.cast("double").alias("prediction"),
    )


def spot_line_predictions(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Least squares of target on spot, fitted on every fold's expanding train rows.

    Sums grow by row, so one running pass per series gives the fit at every train end; no fold's
    train set is copied. Values are centred on the series' first row to keep the sums small.
    """
    indexed = numbered(rows)
    first = Window.partitionBy(*GROUP).orderBy("row_index").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    x0, y0 = F.first(SPOT).over(first), F.first(TARGET).over(first)
    centred = indexed.select(
        *GROUP,
        "row_index",
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        (F.col(SPOT) - x0).cast("double").alias("_x"),
        (F.col(TARGET) - y0).cast("double").alias("_y"),
    )
    x, y = F.col("_x"), F.col("_y")
    sums = centred.select(
        *GROUP,
        "x0",
        "y0",
        (F.col("row_index") + 1).alias("train_end"),
        F.sum(x).over(first).alias("sx"),
        F.sum(y).over(first).alias("sy"),
        F.sum(x * x).over(first).alias("sxx"),
        F.sum(x * y).over(first).alias("sxy"),
    )
    n = F.col("train_end")
    spread = n * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(
        F.lit(0.0)
    )
    fits = sums.select(
        *GROUP, "train_end", "x0", "y0", slope.alias("slope"),
        ((F.col("sy") - slope * F.col("sx")) / n).alias("base"),
    )
    tested = test_rows(rows, folds).join(fits, [*GROUP, "train_end"])
    guess = F.col("y0") + F.col("base") + F.col("slope") * (F.col(SPOT) - F.col("x0"))
    return _predictions(tested, fixed.LINEAR, guess)


def baseline_predictions(
    rows: DataFrame, min_train: int = fixed.MIN_TRAIN_ROWS, test_size: int = fixed.TEST_ROWS,
    step: int | None = None,
) -> DataFrame:
    """Both baselines on every fold of ``rolling_origin``, with one shuffle of the rows.

    Rows are numbered once and the folds that test a row follow from its number. Running sums give
    the least-squares line at every position. A row is laid out as its sums, at the position behind
    it, and as its tests, each at the end of its fold's train rows, and one ordered pass hands each
    test the sums before it. All of it is partitioned by (series, horizon).
    """
    stride = step or test_size
    whole = Window.partitionBy(*GROUP)
    upto = whole.orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    i, n = F.col("row_index"), F.col("n_rows")
    x0, y0 = F.first(SPOT).over(upto), F.first(TARGET).over(upto)
    placed = rows.select(
        *GROUP, DAY, F.col(SPOT).cast("double").alias("_spot"), F.col(TARGET).cast("double").alias("_target"),
        (F.row_number().over(whole.orderBy(DAY)) - 1).alias("row_index"), F.count(F.lit(1)).over(whole).cast("int").alias("n_rows"),
        x0.cast("double").alias("_x0"), y0.cast("double").alias("_y0"),
        (F.col(SPOT) - x0).cast("double").alias("_x"), (F.col(TARGET) - y0).cast("double").alias("_y"),
    )
    x, y = F.col("_x"), F.col("_y")
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
    summed = placed.select("*", *[F.sum(c).over(upto).alias(name) for name, c in sums.items()])
    # Folds k with k * stride + min_train <= i < that + test_size, whole inside the rows.
    low = F.greatest(F.lit(0), F.ceil((i - (min_train + test_size - 1)) / stride).cast("int"))
    high = F.floor(F.least(i - min_train, n - (min_train + test_size)) / stride).cast("int")
    ends = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("fold"), (k * stride + min_train).alias("at"))))
    short_end = F.least(F.lit(min_train), n - 1)
    short = F.when((n >= 2) & (i >= short_end), F.array(F.struct(F.lit(0).alias("fold"), short_end.alias("at"))))
    tests = F.when(n < min_train + test_size, short).otherwise(ends)
    own = F.array(F.struct(F.lit(None).cast("int").alias("fold"), (i + 1).alias("at")))
    line = summed.withColumn("_place", F.explode(F.concat(own, F.coalesce(tests, F.array_except(own, own)))))
    known = F.when(F.col("_place.fold").isNull(), F.struct(*sums))
    # Sums stand before the tests of the same position.
    order = whole.orderBy("_place.at", F.col("_place.fold").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tested = line.withColumn("_fit", F.last(known, ignorenulls=True).over(order)).filter("_place.fold IS NOT NULL")
    size, fit = F.col("_place.at"), {name: F.col("_fit")[name] for name in sums}
    spread = size * fit["sxx"] - fit["sx"] * fit["sx"]
    slope = F.when(spread > 0, (size * fit["sxy"] - fit["sx"] * fit["sy"]) / spread).otherwise(F.lit(0.0))
    guess = F.col("_y0") + (fit["sy"] - slope * fit["sx"]) / size + slope * (F.col("_spot") - F.col("_x0"))
    both = F.array(
        F.struct(F.lit(fixed.NAIVE).alias("model_name"), F.col("_spot").alias("prediction")),
        F.struct(F.lit(fixed.LINEAR).alias("model_name"), guess.alias("prediction")),
    )
    return tested.select(
        *GROUP, F.col("_place.fold").alias("fold_index"), DAY, F.col("_target").alias("y"), F.inline(both)
    ).select(*GROUP, "model_name", "fold_index", DAY, "y", "prediction")


def least_squares_predictions(
    matrix: DataFrame, features: list[str], folds: DataFrame, name: str
) -> DataFrame:
    """Least squares of the target on ``features``, fitted on every fold's expanding train rows.

    One running pass per series sums the products of the features; the normal equations of every
    fold follow from the sums at its train end and are solved by elimination, column by column, in
    the plan. A feature that the train rows don't vary, or that others explain, gets no weight.
    """
    k = len(features)
    values = [F.col(f"`{f}`").cast("double") for f in features] + [F.col(TARGET).cast("double")]
    running = Window.partitionBy(*GROUP).orderBy("row_index").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    indexed = numbered(matrix)
    # Values are taken from the series' first row, which keeps the sums small.
    centred = indexed.select(
        *GROUP, "row_index",
        *[F.first(v).over(running).alias(f"o{i}") for i, v in enumerate(values)],
        *[(v - F.first(v).over(running)).alias(f"x{i}") for i, v in enumerate(values)],
    )
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    sums = centred.select(
        *GROUP, (F.col("row_index") + 1).alias("train_end"), *[f"o{i}" for i in range(k + 1)],
        *[F.sum(f"x{i}").over(running).alias(f"s{i}") for i in range(k + 1)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).over(running).alias(f"p{i}_{j}") for i, j in pairs],
    )
    ends = folds.select(*GROUP, "train_end").distinct()
    n = F.col("train_end")
    offsets = [f"o{i}" for i in range(k + 1)]
    means = [f"m{i}" for i in range(k + 1)]
    solved = sums.join(ends, [*GROUP, "train_end"], "left_semi").select(
        *GROUP, "train_end", *offsets,
        *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(k + 1)],
        *[
            (F.col(f"p{min(i, j)}_{max(i, j)}") - F.col(f"s{i}") * F.col(f"s{j}") / n).alias(f"a{i}_{j}")
            for i in range(k) for j in range(k + 1)
        ],
        *[F.col(f"p{i}_{i}").alias(f"d{i}") for i in range(k)],
    )
    scales = [f"d{i}" for i in range(k)]
    for pivot in range(k):
        top = F.col(f"a{pivot}_{pivot}")
        usable = top > 1e-10 * F.greatest(F.col(f"d{pivot}"), F.lit(1e-300))
        cells = []
        for i in range(k):
            for j in range(k + 1):
                own, row = F.col(f"a{i}_{j}"), F.col(f"a{pivot}_{j}")
                value = row / top if i == pivot else own - F.col(f"a{i}_{pivot}") * row / top
                cells.append(F.when(usable, value).otherwise(F.lit(0.0) if i == pivot else own).alias(f"a{i}_{j}"))
        solved = solved.select(*GROUP, "train_end", *offsets, *means, *scales, *cells)
    fits = solved.select(*GROUP, "train_end", *offsets, *means, *[F.col(f"a{i}_{k}").alias(f"b{i}") for i in range(k)])
    tested = test_rows(matrix, folds).join(fits, [*GROUP, "train_end"])
    guess = F.col(f"o{k}") + F.col(f"m{k}")
    for i, value in enumerate(values[:-1]):
        guess = guess + F.col(f"b{i}") * (value - F.col(f"o{i}") - F.col(f"m{i}"))
    return _predictions(tested, name, guess)


def forest(
    features: list[str], label: str = TARGET, depth: int = fixed.FOREST_DEPTH
) -> tuple[VectorAssembler, RandomForestRegressor]:
    """Distributed random forest with the fixed size and seed."""
    assembler = VectorAssembler(
        inputCols=features, outputCol="_features", handleInvalid="error"
    )
    model = RandomForestRegressor(
        featuresCol="_features", labelCol=label, numTrees=fixed.FOREST_TREES,
        seed=fixed.MODEL_SEED, maxDepth=depth, featureSubsetStrategy="all",
    )
    return assembler, model


def linear(features: list[str], label: str = TARGET) -> tuple[VectorAssembler, LinearRegression]:
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    return assembler, LinearRegression(
        featuresCol="_features", labelCol=label, solver="normal", regParam=0.0
    )


def dotless(matrix: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Feature columns renamed without dots, and the way back."""
    renamed = {f"f{i}": name for i, name in enumerate(features)}
    keep = [F.col(f"`{c}`") for c in matrix.columns if c not in features]
    return (
        matrix.select(*keep, *[F.col(f"`{n}`").cast("double").alias(k) for k, n in renamed.items()]),
        renamed,
    )


def forest_predictions(
    matrix: DataFrame, features: list[str], spec: ForestSpec = ForestSpec(), **settings: int
) -> DataFrame:
    """Out-of-sample forest predictions of every fold; all folds of all series grow together."""
    guesses = forest_guesses(matrix, features, fold_bounds(matrix, **settings), TARGET, spec)
    return guesses.select(
        *GROUP, F.lit(fixed.FOREST).alias("model_name"), "fold_index", DAY, "y", "prediction"
    )


def evaluation(predictions: DataFrame, mode: str = "database") -> DataFrame:
    """Pooled metrics per (series, horizon, model) with the number of folds."""
    metrics = regression_metrics(predictions, [*GROUP, "model_name"], distinct={"fold_count": "fold_index"})
    return metrics.withColumn("mode", F.lit(mode))


def fit_full(matrix: DataFrame, features: list[str], name: str, folder: str):
    """Fit on all rows and save the pipeline with its feature names."""
    from pyspark.ml import Pipeline

    staged, renamed = dotless(matrix.withColumn("_spot", F.col(SPOT)), features)
    stages = (forest if name == fixed.FOREST else linear)(list(renamed))
    fitted = Pipeline(stages=list(stages)).fit(staged)
    fitted.write().overwrite().save(f"{folder}/model")
    spark = matrix.sparkSession
    order = [(i, n) for i, n in enumerate(features)]
    spark.createDataFrame(order, "position int, name string").write.mode("overwrite").json(
        f"{folder}/features"
    )
    return fitted


def saved_features(spark, folder: str) -> list[str]:
    rows = spark.read.schema("position int, name string").json(f"{folder}/features")
    return [r["name"] for r in rows.orderBy("position").collect()]


def reuse_or_fit(matrix: DataFrame, features: list[str], folder: str) -> tuple[object, str]:
    """Saved forest when its feature names match, otherwise a fresh fit (and why)."""
    from pyspark.ml import PipelineModel
    from pyspark.errors import AnalysisException

    try:
        if saved_features(matrix.sparkSession, folder) == features:
            return PipelineModel.load(f"{folder}/model"), "saved_artifact"
        reason = "fitted_feature_mismatch"
    except AnalysisException:
        reason = "fitted"
    staged, renamed = dotless(matrix.withColumn("_spot", F.col(SPOT)), features)
    from pyspark.ml import Pipeline

    return Pipeline(stages=list(forest(list(renamed)))).fit(staged), reason


def importance_table(spark, importances: list[float], features: list[str]) -> DataFrame:
    rows = [(n, round(float(s), 10)) for n, s in zip(features, importances, strict=True)]
    return spark.createDataFrame(rows, "name string, score double")


def feature_importance(matrix: DataFrame, features: list[str], label: str) -> DataFrame:
    """Forest importances by feature name."""
    staged, renamed = dotless(matrix, features)
    assembler, model = forest(list(renamed), label)
    # Tree levels read the rows again and again; cut the plan behind them first.
    fitted = model.fit(assembler.transform(cut_lineage(staged)))
    return importance_table(
        matrix.sparkSession, fitted.featureImportances.toArray().tolist(), features
    )


def lineage_prefix(name: Column) -> Column:
    """Part before the first dot when it is a known agent prefix."""
    prefix = F.lower(F.substring_index(name, ".", 1))
    return F.when(name.contains(".") & prefix.isin(*fixed.LINEAGE_PREFIXES), prefix)


def by_lineage(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scores.withColumn("lineage", lineage_prefix(F.col("name"))).filter(
        F.col("lineage").isNotNull()
    )


def lineage_totals(scores: DataFrame) -> DataFrame:
    return by_lineage(scores).groupBy("lineage").agg(F.round(F.sum("score"), 10).alias("total"))


def top_per_lineage(scores: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` features per prefix by (-score, name); pruned per task before the shuffle."""
    order = Window.partitionBy("lineage").orderBy(F.col("score").desc(), "name")
    return (
        by_lineage(scores)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
    )
