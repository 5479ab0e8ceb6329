"""The integrity report: 26 findings in a fixed order, each counted over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquet.operators import analytics
from barquet.schemas import METRIC_NAMES, TABLES, differences

SAMPLES = 20
#: Code, severity if observed, in the order of the report.
CODES = (
    ("SCHEMA_CHECK", "FAIL"), ("FOREIGN_KEY_CHECK", "FAIL"),
    ("TABLE_COUNT_BACKTEST_RUNS", "INFO"), ("TABLE_COUNT_TRADES", "INFO"), ("TABLE_COUNT_EQUITY_CURVE", "INFO"), ("TABLE_COUNT_METRICS", "INFO"),
    ("PER_RUN_CHILD_COUNTS", "INFO"), ("MISSING_REQUIRED_EQUITY_HISTORY", "FAIL"), ("NO_CLOSED_TRADES", "WARN"), ("MISSING_OPTIONAL_METRICS", "WARN"),
    ("METRIC_ROW_COUNT_RECONCILIATION", "FAIL"), ("SPARSE_EQUITY_HISTORY", "WARN"), ("OPEN_TRADES_EXCLUDED", "WARN"),
    ("DUPLICATE_METRIC_KEYS", "FAIL"), ("DUPLICATE_EQUITY_TIMESTAMPS", "FAIL"),
    ("ORPHAN_TRADES", "FAIL"), ("ORPHAN_EQUITY_POINTS", "FAIL"), ("ORPHAN_METRICS", "FAIL"),
    ("INVALID_RUN_DATE_RANGE", "FAIL"), ("NONPOSITIVE_INITIAL_CAPITAL", "FAIL"), ("NEGATIVE_COMMISSION_PCT", "FAIL"), ("NEGATIVE_SLIPPAGE_PCT", "FAIL"),
    ("NONPOSITIVE_TRADE_QUANTITY", "FAIL"), ("INCONSISTENT_TRADE_CLOSE_FIELDS", "FAIL"),
    ("TOTAL_RETURN_MISMATCH", "FAIL"), ("DRAWDOWN_MISMATCH", "FAIL"),
)


def report(tables: analytics.Tables, tolerance: float = 0.02, samples: int = SAMPLES, run_ids: list[str] | None = None) -> DataFrame:
    """``position, code, severity, observed_count, sample_ids``: severity PASS if nothing is observed.

    Findings that only inform have severity PASS and their count. Samples are the first ``samples`` (1 to 100) ids.
    With ``run_ids``, only these runs and their children are looked at, all of them.
    """
    if not 1 <= samples <= 100:
        raise ValueError("between 1 and 100 samples")
    spark = tables["backtest_runs"].sparkSession
    c = F.col
    per_run = analytics.integrity_per_run_reconciliation(tables, run_ids)
    states = {
        "PER_RUN_CHILD_COUNTS": F.lit(True),
        "MISSING_REQUIRED_EQUITY_HISTORY": c("equity_count") == 0,
        "NO_CLOSED_TRADES": c("closed_trade_count") == 0,
        "MISSING_OPTIONAL_METRICS": c("optional_metric_count") < len(METRIC_NAMES),
        "METRIC_ROW_COUNT_RECONCILIATION": c("metric_count") != c("distinct_metric_count"),
        "SPARSE_EQUITY_HISTORY": c("equity_count") == 1,
        "OPEN_TRADES_EXCLUDED": c("open_trade_count") > 0,
    }
    codes = F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in states.items())))
    child_states = per_run.select(F.explode(codes).alias("code"), c("run_id").alias("record"))
    twice = lambda frame, code: frame.select(F.lit(code).alias("code"), F.concat_ws(":", "run_id", "duplicate_key").alias("record"))
    defect = lambda frame: frame.select(c("defect_code").alias("code"), c("record_id").alias("record"))
    orphans = analytics.integrity_orphan_children(tables, run_ids)
    found = reduce(
        DataFrame.unionByName,
        [
            child_states,
            twice(analytics.integrity_duplicate_metrics(tables, run_ids), "DUPLICATE_METRIC_KEYS"),
            twice(analytics.integrity_duplicate_equity(tables, run_ids), "DUPLICATE_EQUITY_TIMESTAMPS"),
            orphans.select(F.explode(F.array("defect_code", F.lit("FOREIGN_KEY_CHECK"))).alias("code"), c("record_id").alias("record")),
            defect(analytics.integrity_invalid_records(tables, run_ids)),
            defect(analytics.integrity_metric_reconciliation(tables, run_ids, tolerance)),
        ],
    )
    # Rows are counted by id, and the ids of a code ranked within salted parts, so that no code's rows meet in one task and
    # nothing is computed twice.
    salt = F.pmod(F.xxhash64("record"), F.lit(64))
    nth = F.row_number().over(Window.partitionBy("code", "salt").orderBy("record"))
    ranked = found.groupBy("code", "record").agg(F.count("*").alias("n")).withColumn("salt", salt).withColumn("nth", nth)
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("nth") <= samples, F.col("record")))), 1, samples)
    counted = ranked.groupBy("code").agg(F.sum("n").alias("n"), first.alias("ids")).select("code", "n", "ids")
    counts = analytics.integrity_table_counts(tables).select(F.concat(F.lit("TABLE_COUNT_"), F.upper("table_name")).alias("code"), c("row_count").alias("n"), F.array().cast("array<string>").alias("ids"))
    wrong = [f"{n}: {d}" for n, pinned in TABLES.items() for d in differences(tables[n].schema, pinned)]
    schema = spark.createDataFrame([("SCHEMA_CHECK", len(wrong), wrong[:samples])], "code string, n long, ids array<string>")
    order = spark.createDataFrame([(i + 1, code, s) for i, (code, s) in enumerate(CODES)], "position long, code string, kind string")
    seen = counted.unionByName(counts).unionByName(schema)
    n = F.coalesce("n", F.lit(0)).cast("long")
    severity: Column = F.when((n > 0) & (c("kind") != "INFO"), c("kind")).otherwise("PASS")
    return order.join(seen, "code", "left").select("position", "code", severity.alias("severity"), n.alias("observed_count"), F.coalesce("ids", F.array().cast("array<string>")).alias("sample_ids"))


def failures(report: DataFrame) -> list[str]:
    """Codes that failed: what keeps a result from being published."""
    return [r.code for r in report.where("severity = 'FAIL'").orderBy("position").select("code").collect()]
