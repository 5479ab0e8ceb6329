"""The catalogued queries over the four run tables: four analyses and seven integrity checks.

Every query takes the tables as DataFrames by name. A parameter that is None selects everything. Children are reduced
to a row a run before they meet the runs, so joins never multiply rows, and all windows are partitioned by run or
cohort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.schemas import METRIC_NAMES

Tables = dict[str, DataFrame]
COHORT = ("symbol", "start_date", "end_date", "initial_capital", "commission_pct", "slippage_pct")


def _is_closed() -> Column:
    return F.col("exit_date").isNotNull() & F.col("exit_price").isNotNull() & F.col("pnl").isNotNull()


def _of(frame: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values; None wants nothing."""
    return reduce(lambda f, kv: f if kv[1] is None else f.where(F.col(kv[0]) == kv[1]), wanted.items(), frame)


def _scoped(frame: DataFrame, run_ids: list[str] | None, column: str = "backtest_id") -> DataFrame:
    return frame if run_ids is None else frame.where(F.col(column).isin(run_ids))


def _pivoted(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """A row a run with the largest value of each named metric."""
    one = lambda name, alias: F.max(F.when(F.col("metric_name") == name, F.col("metric_value"))).alias(alias)
    return metrics.groupBy("backtest_id").agg(*(one(n, a) for n, a in names.items()))


def latest_equity(equity: DataFrame) -> DataFrame:
    """Each run's equity at its last point: an aggregate, for which no rows need sorting."""
    return equity.groupBy("backtest_id").agg(F.max_by("equity", F.struct("date", "id")).alias("latest_equity"))


def _facts(tables: Tables, runs: DataFrame, names: dict[str, str], trade_sums: list[Column]) -> DataFrame:
    selected = runs.select(F.col("id").alias("run_id"), "strategy_name", *COHORT)
    ids = selected.select(F.col("run_id").alias("backtest_id"))
    child = lambda name: tables[name].join(ids, "backtest_id", "left_semi")
    parts = [_pivoted(child("metrics"), names), child("trades").groupBy("backtest_id").agg(*trade_sums), latest_equity(child("equity_curve"))]
    return reduce(lambda left, right: left.join(right.withColumnRenamed("backtest_id", "run_id"), "run_id", "left"), parts, selected)


def _derived_return() -> Column:
    return F.try_divide(F.col("latest_equity") - F.col("initial_capital"), F.col("initial_capital"))


def strategy_run_comparison(
    tables: Tables, symbol: str | None = None, start_date=None, end_date=None, strategy_name: str | None = None
) -> DataFrame:
    """A row a run with all its metrics, trade sums, latest equity, and its ranks among runs of the same cohort."""
    runs = _of(tables["backtest_runs"], symbol=symbol, start_date=start_date, end_date=end_date, strategy_name=strategy_name)
    names = {n: n for n in METRIC_NAMES} | {"total_trades": "metric_total_trades", "total_return": "reported_total_return"}
    done = _is_closed()
    won = F.col("exit_date").isNotNull() & F.col("exit_price").isNotNull() & (F.col("pnl") > 0)
    sums = [
        F.count_if(done).alias("closed_trade_count"),
        F.count_if(won).alias("winning_trade_count"),
        F.sum(F.when(done, F.col("pnl"))).alias("cumulative_trade_pnl"),
        F.sum(F.when(done, F.col("commission"))).alias("closed_trade_commission"),
    ]
    facts = _facts(tables, runs, names, sums).withColumn("derived_total_return", _derived_return())
    cohort = Window.partitionBy(*COHORT)
    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(cohort.orderBy(F.col(c).desc())).cast("long"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("closed_trade_count", "winning_trade_count")}
    filled |= {c: F.coalesce(c, F.lit(0.0)) for c in ("cumulative_trade_pnl", "closed_trade_commission")}
    return facts.withColumns(filled).select(
        "run_id", "strategy_name", *COHORT, *names.values(), *filled, "latest_equity", "derived_total_return",
        (F.col("derived_total_return") - F.col("reported_total_return")).alias("total_return_delta"),
        rank("derived_total_return").alias("return_rank"),
        rank("sharpe_ratio").alias("sharpe_rank"),
    )


def trade_sequence(tables: Tables, run_id: str | None = None) -> DataFrame:
    """Closed trades in order of exit with running sums, wins and the mean of the last five; ``run_id`` comes first."""
    order = Window.partitionBy("backtest_id").orderBy("exit_date", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    wins, nth = F.sum((F.col("pnl") > 0).cast("long")).over(upto), F.row_number().over(order).cast("long")
    return _of(tables["trades"], backtest_id=run_id).where(_is_closed()).select(
        F.col("backtest_id").alias("run_id"),
        F.col("id").alias("trade_id"),
        "exit_date",
        "pnl",
        nth.alias("trade_sequence"),
        F.sum("pnl").over(upto).alias("cumulative_pnl"),
        wins.alias("cumulative_wins"),
        (wins / nth).alias("cumulative_win_rate"),
        F.avg("pnl").over(order.rowsBetween(-4, 0)).alias("rolling_5_trade_avg_pnl"),
    )


def equity_drawdown_audit(tables: Tables, run_id: str | None = None, tolerance: float = 0.02) -> DataFrame:
    """Each equity point with its return and drawdown worked out again; ``run_id`` comes first."""
    order = Window.partitionBy("backtest_id").orderBy("date", "id")
    points = _of(tables["equity_curve"], backtest_id=run_id).select(
        F.col("backtest_id").alias("run_id"),
        F.col("id").alias("equity_point_id"),
        "date",
        "equity",
        F.col("drawdown_pct").alias("stored_drawdown_pct"),
        F.row_number().over(order).cast("long").alias("audit_sequence"),
        F.lag("equity").over(order).alias("prior_equity"),
        F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("running_peak"),
    )
    share = lambda now, base: F.try_divide(F.col(now) - F.col(base), F.col(base))
    off = F.abs(F.col("stored_drawdown_pct") - F.col("derived_drawdown_pct"))
    return (
        points.withColumn("point_return", share("equity", "prior_equity"))
        .withColumn("derived_drawdown_pct", share("equity", "running_peak"))
        .withColumn("drawdown_delta_abs", off)
        .withColumn("is_mismatch", F.coalesce(off > tolerance, F.lit(False)))
        .select(
            "run_id", "equity_point_id", "date", "equity", "stored_drawdown_pct", "audit_sequence", "prior_equity", "point_return",
            "running_peak", "derived_drawdown_pct", "drawdown_delta_abs", "is_mismatch",
        )
    )


def strategy_cohort_summary(tables: Tables, symbol: str | None = None, start_date=None, end_date=None, minimum_run_count: int = 1) -> DataFrame:
    """Means of the runs of each strategy and cohort, ranked within the cohort; dates are bounds here."""
    runs = _of(tables["backtest_runs"], symbol=symbol)
    runs = runs if start_date is None else runs.where(F.col("start_date") >= start_date)
    runs = runs if end_date is None else runs.where(F.col("end_date") <= end_date)
    names = {n: n for n in ("sharpe_ratio", "max_drawdown")}
    facts = _facts(tables, runs, names, [F.count_if(_is_closed()).alias("n_closed")]).withColumn("derived", _derived_return())
    means = facts.groupBy("strategy_name", *COHORT).agg(
        F.count("*").alias("run_count"),
        F.avg("derived").alias("average_derived_return"),
        F.avg("sharpe_ratio").alias("average_sharpe_ratio"),
        F.min("max_drawdown").alias("worst_drawdown"),
        F.coalesce(F.sum("n_closed"), F.lit(0)).alias("aggregate_closed_trade_count"),
    )
    rank = F.dense_rank().over(Window.partitionBy(*COHORT).orderBy(F.col("average_derived_return").desc()))
    return means.where(F.col("run_count") >= minimum_run_count).withColumn("return_rank", rank.cast("long"))


def integrity_table_counts(tables: Tables) -> DataFrame:
    count = lambda name: tables[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
    return reduce(DataFrame.unionByName, map(count, ("backtest_runs", "trades", "equity_curve", "metrics")))


def integrity_per_run_reconciliation(tables: Tables, run_ids: list[str] | None = None) -> DataFrame:
    """How many children each run has. A trade counts as closed here by its exit date alone."""
    known = F.col("metric_name").isin(*METRIC_NAMES)
    counts = {
        "trades": {"trade_count": F.count("*"), "closed_trade_count": F.count("exit_date"), "open_trade_count": F.count_if(F.col("exit_date").isNull())},
        "equity_curve": {"equity_count": F.count("*")},
        "metrics": {
            "metric_count": F.count("*"),
            "distinct_metric_count": F.count_distinct("metric_name"),
            "optional_metric_count": F.count_distinct(F.when(known, F.col("metric_name"))),
        },
    }
    out = _scoped(tables["backtest_runs"], run_ids, "id").select(F.col("id").alias("run_id"))
    for name, of in counts.items():
        part = tables[name].groupBy(F.col("backtest_id").alias("run_id")).agg(*(c.alias(a) for a, c in of.items()))
        out = out.join(part, "run_id", "left")
    return out.select("run_id", *(F.coalesce(a, F.lit(0)).alias(a) for of in counts.values() for a in of))


def _duplicates(frame: DataFrame, key: str, run_ids: list[str] | None) -> DataFrame:
    groups = _scoped(frame, run_ids).groupBy(F.col("backtest_id").alias("run_id"), F.col(key).cast("string").alias("duplicate_key"))
    return groups.agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")


def integrity_duplicate_metrics(tables: Tables, run_ids: list[str] | None = None) -> DataFrame:
    return _duplicates(tables["metrics"], "metric_name", run_ids)


def integrity_duplicate_equity(tables: Tables, run_ids: list[str] | None = None) -> DataFrame:
    return _duplicates(tables["equity_curve"], "date", run_ids)


def _defect(frame: DataFrame, code: str, name: str, run: str = "backtest_id") -> DataFrame:
    return frame.select(F.lit(code).alias("defect_code"), F.lit(name).alias("table_name"), F.col("id").cast("string").alias("record_id"), F.col(run).alias("run_id"))


def integrity_orphan_children(tables: Tables, run_ids: list[str] | None = None) -> DataFrame:
    ids = tables["backtest_runs"].select(F.col("id").alias("backtest_id"))
    codes = {"trades": "ORPHAN_TRADES", "equity_curve": "ORPHAN_EQUITY_POINTS", "metrics": "ORPHAN_METRICS"}
    lost = (_defect(_scoped(tables[n], run_ids).join(ids, "backtest_id", "left_anti"), code, n) for n, code in codes.items())
    return reduce(DataFrame.unionByName, lost)


def integrity_invalid_records(tables: Tables, run_ids: list[str] | None = None) -> DataFrame:
    """One pass over each table; a row gives as many defects as it has."""

    def broken(name: str, run: str, rules: dict[str, Column]) -> DataFrame:
        codes = F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())))
        rows = _scoped(tables[name], run_ids, run).withColumn("code", F.explode(codes))
        return rows.select(F.col("code").alias("defect_code"), F.lit(name).alias("table_name"), F.col("id").cast("string").alias("record_id"), F.col(run).alias("run_id"))

    c = F.col
    some = c("exit_price").isNotNull() | c("pnl").isNotNull() | c("pnl_pct").isNotNull()
    every = c("exit_price").isNotNull() & c("pnl").isNotNull() & c("pnl_pct").isNotNull()
    runs = {
        "INVALID_RUN_DATE_RANGE": c("start_date") > c("end_date"),
        "NONPOSITIVE_INITIAL_CAPITAL": c("initial_capital") <= 0,
        "NEGATIVE_COMMISSION_PCT": c("commission_pct") < 0,
        "NEGATIVE_SLIPPAGE_PCT": c("slippage_pct") < 0,
    }
    trades = {
        "NONPOSITIVE_TRADE_QUANTITY": c("quantity") <= 0,
        "INCONSISTENT_TRADE_CLOSE_FIELDS": F.when(c("exit_date").isNull(), some).otherwise(~every),
    }
    return broken("backtest_runs", "id", runs).unionByName(broken("trades", "backtest_id", trades))


def integrity_metric_reconciliation(tables: Tables, run_ids: list[str] | None = None, tolerance: float = 0.02) -> DataFrame:
    """Stored total returns and drawdowns that the equity curve doesn't bear out."""
    equity = _scoped(tables["equity_curve"], run_ids)
    stored = _pivoted(_scoped(tables["metrics"], run_ids), {"total_return": "stored"})
    runs = _scoped(tables["backtest_runs"], run_ids, "id").where("initial_capital > 0").withColumnRenamed("id", "backtest_id")
    met = runs.join(stored, "backtest_id").join(latest_equity(equity), "backtest_id")
    wrong = met.where(F.abs(F.col("stored") - (F.col("latest_equity") / F.col("initial_capital") - 1.0)) > tolerance)
    order = Window.partitionBy("backtest_id").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    deep = equity.withColumn("peak", F.max("equity").over(order)).where("peak > 0").where(F.abs(F.col("drawdown_pct") - (F.col("equity") / F.col("peak") - 1.0)) > tolerance)
    return _defect(wrong.withColumn("id", F.col("backtest_id")), "TOTAL_RETURN_MISMATCH", "metrics").unionByName(_defect(deep, "DRAWDOWN_MISMATCH", "equity_curve"))


#: Every catalogued query by its id.
CATALOGUE = {
    f.__name__: f
    for f in (
        strategy_run_comparison, trade_sequence, equity_drawdown_audit, strategy_cohort_summary, integrity_table_counts,
        integrity_per_run_reconciliation, integrity_duplicate_metrics, integrity_duplicate_equity, integrity_orphan_children,
        integrity_invalid_records, integrity_metric_reconciliation,
    )
}
