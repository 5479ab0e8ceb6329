"""Typed result contracts: a DataFrame is given the agreed types and checked in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"string": "string", "integer": "bigint", "float": "double", "datetime": "timestamp_ntz", "boolean": "boolean"}


class ContractError(ValueError):
    """The result isn't what was agreed."""


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str
    nullable: bool = False
    minimum: float | None = None
    above: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class Contract:
    columns: tuple[Spec, ...]
    unique_by: tuple[str, ...]


def validate(frame: DataFrame, contract: Contract) -> DataFrame:
    """The frame with the contract's types. Raises ContractError, naming all that is wrong."""
    names = [c.name for c in contract.columns]
    if frame.columns != names:
        raise ContractError(f"columns {frame.columns}, not {names}")
    kinds = dict(frame.dtypes)

    def typed(c: Spec) -> Column:
        value = F.col(c.name)
        if c.kind == "boolean" and kinds[c.name] != "boolean":
            return F.when(value == 1, True).when(value == 0, False)
        return value.try_cast(KINDS[c.kind])

    checks: dict[str, Column] = {}
    for c in contract.columns:
        raw, value = F.col(c.name), F.col(f"__{c.name}")
        checks[f"{c.name}: not of kind {c.kind}"] = raw.isNotNull() & value.isNull()
        if c.kind == "integer" and kinds[c.name] in ("double", "float"):
            checks[f"{c.name}: not integral"] = raw != F.floor(raw)
        if not c.nullable:
            checks[f"{c.name}: null"] = raw.isNull()
        if c.minimum is not None:
            checks[f"{c.name}: below {c.minimum}"] = value < c.minimum
        if c.above is not None:
            checks[f"{c.name}: not above {c.above}"] = value <= c.above
        if c.maximum is not None:
            checks[f"{c.name}: above {c.maximum}"] = value > c.maximum
    wide = frame.withColumns({f"__{c.name}": typed(c) for c in contract.columns})
    # Rows of a key first, so that no distinct count of whole rows is needed.
    keyed = wide.groupBy(*contract.unique_by).agg(F.count("*").alias("__n"), *(F.count_if(rule).alias(f"__c{i}") for i, rule in enumerate(checks.values())))
    found = keyed.agg(F.count_if(F.col("__n") > 1).alias("repeated"), *(F.sum(f"__c{i}").alias(f"c{i}") for i in range(len(checks)))).first()
    wrong = [f"{text} ({found[f'c{i}']} rows)" for i, text in enumerate(checks) if found[f"c{i}"]]
    if found["repeated"]:
        wrong.append(f"{found['repeated']} keys of {contract.unique_by} are repeated")
    if wrong:
        raise ContractError("; ".join(wrong))
    return wide.select(*(F.col(f"__{n}").alias(n) for n in names))


def _s(name: str, **limits) -> Spec:
    return Spec(name, "string", **limits)


def _i(name: str, **limits) -> Spec:
    return Spec(name, "integer", **limits)


def _f(name: str, **limits) -> Spec:
    return Spec(name, "float", **limits)


_COHORT = (
    _s("symbol"), Spec("start_date", "datetime"), Spec("end_date", "datetime"), _f("initial_capital", above=0.0),
    _f("commission_pct", minimum=0.0), _f("slippage_pct", minimum=0.0),
)
_DEFECT = Contract((_s("defect_code"), _s("table_name"), _s("record_id"), _s("run_id")), ("defect_code", "table_name", "record_id"))
_DUPLICATE = Contract((_s("run_id"), _s("duplicate_key"), _i("duplicate_count", above=1.0)), ("run_id", "duplicate_key"))
_COUNTS = ("trade_count", "closed_trade_count", "open_trade_count", "equity_count", "metric_count", "distinct_metric_count", "optional_metric_count")

#: The agreed columns of each catalogued query, in order.
CONTRACTS = {
    "strategy_run_comparison": Contract(
        (
            _s("run_id"), _s("strategy_name"), *_COHORT,
            *(_f(n, nullable=True) for n in ("sharpe_ratio", "sortino_ratio", "cagr", "max_drawdown", "max_drawdown_duration", "win_rate", "profit_factor", "calmar_ratio")),
            _f("metric_total_trades", nullable=True, minimum=0.0), _f("reported_total_return", nullable=True),
            _i("closed_trade_count", minimum=0.0), _i("winning_trade_count", minimum=0.0), _f("cumulative_trade_pnl"), _f("closed_trade_commission", minimum=0.0),
            _f("latest_equity", nullable=True), _f("derived_total_return", nullable=True), _f("total_return_delta", nullable=True),
            _i("return_rank", nullable=True, above=0.0), _i("sharpe_rank", nullable=True, above=0.0),
        ),
        ("run_id",),
    ),
    "trade_sequence": Contract(
        (
            _s("run_id"), _i("trade_id", above=0.0), Spec("exit_date", "datetime"), _f("pnl"), _i("trade_sequence", above=0.0), _f("cumulative_pnl"),
            _i("cumulative_wins", minimum=0.0), _f("cumulative_win_rate", minimum=0.0, maximum=1.0), _f("rolling_5_trade_avg_pnl"),
        ),
        ("run_id", "trade_id"),
    ),
    "equity_drawdown_audit": Contract(
        (
            _s("run_id"), _i("equity_point_id", above=0.0), Spec("date", "datetime"), _f("equity"), _f("stored_drawdown_pct"), _i("audit_sequence", above=0.0),
            _f("prior_equity", nullable=True), _f("point_return", nullable=True), _f("running_peak"), _f("derived_drawdown_pct"),
            _f("drawdown_delta_abs", minimum=0.0), Spec("is_mismatch", "boolean"),
        ),
        ("run_id", "equity_point_id"),
    ),
    "strategy_cohort_summary": Contract(
        (
            _s("strategy_name"), *_COHORT, _i("run_count", above=0.0), _f("average_derived_return", nullable=True), _f("average_sharpe_ratio", nullable=True),
            _f("worst_drawdown", nullable=True), _i("aggregate_closed_trade_count", minimum=0.0), _i("return_rank", above=0.0),
        ),
        ("strategy_name", "symbol", "start_date", "end_date", "initial_capital", "commission_pct", "slippage_pct"),
    ),
    "integrity_table_counts": Contract((_s("table_name"), _i("row_count", minimum=0.0)), ("table_name",)),
    "integrity_per_run_reconciliation": Contract((_s("run_id"), *(_i(n, minimum=0.0) for n in _COUNTS)), ("run_id",)),
    "integrity_duplicate_metrics": _DUPLICATE,
    "integrity_duplicate_equity": _DUPLICATE,
    "integrity_orphan_children": _DEFECT,
    "integrity_invalid_records": _DEFECT,
    "integrity_metric_reconciliation": _DEFECT,
}
