"""Walk-forward re-optimisation and permutation tests: many backtests at once.

Trials and permutations are rows; each is folded by its own task, and what is best, or how many reach the actual
value, is an aggregate.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquet.operators import backtest, risk
from barquet.schemas import METRIC_NAMES


def draw(space: dict[str, tuple], rng: random.Random) -> dict[str, float]:
    """One random setting of each parameter, in the order of the space."""
    return {name: float(low + rng.randint(0, int((high - low) / step)) * step) for name, (low, high, step) in space.items()}


def metrics_of(events: DataFrame, runs: DataFrame, capital: float) -> DataFrame:
    """The ten metrics of each run of ``runs`` (``run_id``), wide, by ``run_id``."""
    ids = runs.select(F.col("run_id").alias("id"), F.lit(capital).alias("initial_capital"))
    wide = risk.risk_metrics(ids, backtest.closed_trades(events), backtest.equity_points(events))
    return wide.withColumnRenamed("backtest_id", "run_id")


def windows(bars: DataFrame, in_sample: int, out_of_sample: int, step: int) -> DataFrame:
    """``symbol, window, start, split, end``: bars [k*step, +in_sample) to fit, the next ``out_of_sample`` to test.

    ``start`` and ``end`` are the times of the first and last bar, ``split`` that of the first one tested.
    """
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp")) - 1
    w = Window.partitionBy("symbol").orderBy("timestamp")
    rows = bars.select("symbol", F.col("timestamp").alias("start"), n.alias("n"), F.lead("timestamp", in_sample).over(w).alias("split"), F.lead("timestamp", in_sample + out_of_sample - 1).over(w).alias("end"), F.lead("timestamp", in_sample - 1).over(w).alias("fitted"))
    return rows.where((F.col("n") % step == 0) & F.col("end").isNotNull()).select("symbol", (F.col("n") / step).cast("long").alias("window"), "start", "fitted", "split", "end")


def walk_forward(
    bars: DataFrame, strategy: str, in_sample: int, out_of_sample: int, step: int, trials: int, seed: int,
    metric: str = "sharpe_ratio", config: backtest.Config = backtest.Config(), sizer=None,
) -> DataFrame:
    """A row a symbol and window: ``symbol, window, split, end, trial, params, fitted_metric, oos_sharpe, scale``.

    ``trials`` settings are drawn from the strategy's space before anything runs, the same for every window, with one
    more as a fallback for windows in which no setting can run. The first of the best settings wins. ``scale``
    chains a window's equity to where the windows before it ended.
    """
    if metric not in METRIC_NAMES:
        raise ValueError(f"no metric {metric}")
    spark, rng = bars.sparkSession, random.Random(seed)
    drawn = [(k, draw(backtest.PARAMETER_SPACE[strategy], rng)) for k in range(trials + 1)]
    settings = spark.createDataFrame(drawn, "trial int, params map<string,double>")
    spans = windows(bars, in_sample, out_of_sample, step)
    name = lambda *of: F.concat_ws("|", "symbol", "window", *of)
    fits = spans.crossJoin(F.broadcast(settings.where(F.col("trial") < trials))).select(
        name("trial").alias("run_id"), F.lit(strategy).alias("strategy"), "symbol", "params", "start", F.col("fitted").alias("end"), "window", "trial"
    )
    spec = ("run_id", "strategy", "symbol", "params", "start", "end")
    fitted = metrics_of(backtest.run_backtests(bars, fits.select(*spec), config, sizer, window=True), fits, config.initial_capital)
    # A setting that the strategy refuses has no equity curve; it must not win with a metric of 0.
    valid = fits.where(_valid(strategy)).join(fitted.select("run_id", F.col(metric).alias("value")), "run_id")
    best = valid.groupBy("symbol", "window").agg(F.min_by(F.struct("trial", "value"), F.struct(-F.col("value"), F.col("trial"))).alias("best"))
    chosen = spans.join(best, ["symbol", "window"], "left").withColumn("trial", F.coalesce("best.trial", F.lit(trials))).join(F.broadcast(settings), "trial")
    tests = chosen.select(name().alias("run_id"), F.lit(strategy).alias("strategy"), "symbol", "params", F.col("split").alias("start"), "end", "window", "trial", "best.value")
    events = backtest.run_backtests(bars, tests.select(*spec), config, sizer, window=True)
    points = backtest.equity_points(events)
    ends = points.groupBy(F.col("backtest_id").alias("run_id")).agg(F.min_by("equity", "id").alias("first"), F.max_by("equity", "id").alias("last"))
    sharpe = risk.curve_metrics(points).select(F.col("backtest_id").alias("run_id"), "sharpe_ratio")
    out = tests.join(ends, "run_id", "left").join(sharpe, "run_id", "left")
    before = Window.partitionBy("symbol").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    earliest = F.first("first", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("window").rowsBetween(Window.unboundedPreceding, 0))
    growth = F.exp(F.sum(F.ln(F.col("last") / F.col("first"))).over(before))
    scale = F.when(growth.isNull(), 1.0).otherwise(F.try_divide(growth * earliest, F.col("first")))
    return out.select(
        "symbol", "window", F.col("start").alias("split"), "end", "trial", "params", F.col("value").alias("fitted_metric"),
        F.coalesce("sharpe_ratio", F.lit(0.0)).alias("oos_sharpe"), scale.alias("scale"),
    )


def _valid(strategy: str):
    """Settings that the strategy accepts, as a predicate on ``params``."""
    p = F.col("params")
    return p["fast_period"] < p["slow_period"] if strategy == "ma_crossover" else F.lit(True)


def stability(walked: DataFrame) -> DataFrame:
    """Deviation over mean of the out-of-sample Sharpe ratios of each symbol; infinite for mean 0, 0 for a single window."""
    sums = walked.groupBy("symbol").agg(F.count("*").alias("windows"), F.avg("oos_sharpe").alias("m"), F.stddev_pop("oos_sharpe").alias("d"))
    value = F.when(F.col("windows") <= 1, 0.0).when(F.col("m") == 0, float("inf")).otherwise(F.try_divide(F.col("d"), F.abs("m")))
    return sums.select("symbol", "windows", value.alias("stability"))


def permutation_test(
    bars: DataFrame, strategy: str, params: dict[str, float], permutations: int, seed: int,
    metric: str = "sharpe_ratio", config: backtest.Config = backtest.Config(), sizer=None,
) -> DataFrame:
    """A row a symbol: ``symbol, actual, permutations, p_value, is_significant, percentile``.

    Permutation i shuffles the log returns with seed ``seed + i`` and runs over flat bars of the prices they give,
    from the first price on. p is (1 + how many reach the actual metric) over (1 + permutations).
    """
    if metric not in METRIC_NAMES:
        raise ValueError(f"no metric {metric}")
    spark, size = bars.sparkSession, sizer or backtest.fixed_quantity()
    prepare = backtest.STRATEGIES[strategy]
    setting = F.map_from_arrays(F.array(*map(F.lit, params)), F.array(*(F.lit(float(v)) for v in params.values()))) if params else F.lit(None).cast("map<string,double>")
    real = bars.select("symbol").distinct().select(F.col("symbol").alias("run_id"), F.lit(strategy).alias("strategy"), "symbol", setting.alias("params"))
    actual = metrics_of(backtest.run_backtests(bars, real, config, sizer), real, config.initial_capital).select(F.col("run_id").alias("symbol"), F.col(metric).alias("actual"))
    numbers = spark.range(permutations).withColumnRenamed("id", "nth")
    series = bars.select("symbol", "timestamp", "adj_close").crossJoin(F.broadcast(numbers)).withColumn("run_id", F.concat_ws("|", "symbol", "nth"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp")
        price = rows["adj_close"].to_numpy(float)
        moves = np.diff(np.log(price))
        np.random.default_rng(seed + int(rows["nth"].iloc[0])).shuffle(moves)
        flat = price[0] * np.exp(np.concatenate([[0.0], np.cumsum(moves)]))
        frame = pd.DataFrame({"timestamp": rows["timestamp"], **{c: flat for c in ("open", "high", "low", "close", "adj_close")}})
        return backtest.fold(frame, prepare, params, config, size, rows["run_id"].iloc[0])

    events = series.groupBy("run_id").applyInPandas(run, backtest.EVENTS)
    runs = bars.select("symbol").distinct().crossJoin(F.broadcast(numbers)).select(F.concat_ws("|", "symbol", "nth").alias("run_id"), "symbol")
    values = metrics_of(events, runs.select("run_id"), config.initial_capital).join(runs, "run_id").select("symbol", F.col(metric).alias("value"))
    sums = values.join(F.broadcast(actual), "symbol").groupBy("symbol", "actual").agg(F.count("*").alias("permutations"), F.count_if(F.col("value") >= F.col("actual")).alias("reach"), F.count_if(F.col("value") < F.col("actual")).alias("below"))
    p = (F.col("reach") + 1) / (F.col("permutations") + 1)
    return sums.select("symbol", "actual", "permutations", p.alias("p_value"), (p < 0.05).alias("is_significant"), (F.col("below") * 100 / (F.col("permutations") + 1)).alias("percentile"))
