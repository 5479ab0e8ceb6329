"""``python -m barquet.cli compare|validate|queries``: catalogued queries over stored run tables.

Exit codes: 0 done, 1 failed, 2 wrong usage, 3 the result breaks its contract, 4 integrity failures, 5 no such data.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.errors import AnalysisException

from barquet.operators import analytics, artifacts, contracts, integrity
from barquet.session import local_session
from barquet.sources import store


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="barquet")
    commands = parser.add_subparsers(dest="command", required=True)
    compare = commands.add_parser("compare", help="compare the runs of a symbol and period")
    compare.add_argument("--tables", required=True)
    compare.add_argument("--symbol")
    compare.add_argument("--start", type=dt.datetime.fromisoformat)
    compare.add_argument("--end", type=dt.datetime.fromisoformat)
    compare.add_argument("--strategy")
    compare.add_argument("--csv", required=True)
    compare.add_argument("--json", required=True)
    compare.add_argument("--force", action="store_true")
    check = commands.add_parser("validate", help="run the integrity report")
    check.add_argument("--tables", required=True)
    check.add_argument("--tolerance", type=float, default=0.02)
    check.add_argument("--samples", type=int, default=integrity.SAMPLES)
    check.add_argument("--json")
    commands.add_parser("queries", help="name the registered queries")
    return parser


def main(args: list[str] | None = None) -> int:
    try:
        given = _parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if given.command == "queries":
        from barquet.plans import catalogue

        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = local_session()
    try:
        tables = store.load_runs(spark, given.tables)
        if given.command == "validate":
            rows = integrity.report(tables, given.tolerance, given.samples).orderBy("position").collect()
            findings = [r.asDict() for r in rows]
            if given.json:
                artifacts.write_json(given.json, {"findings": findings}, force=True)
            print("\n".join(f"{r.severity} {r.code} {r.observed_count}" for r in rows))
            return 4 if any(r.severity == "FAIL" for r in rows) else 0
        result = analytics.strategy_run_comparison(tables, given.symbol, given.start, given.end, given.strategy)
        checked = contracts.validate(result, contracts.CONTRACTS["strategy_run_comparison"])
        failed = integrity.failures(integrity.report(tables, run_ids=[r.run_id for r in artifacts.rows_of(checked.select("run_id"))]))
        if failed:
            print(f"integrity: {failed}", file=sys.stderr)
            return 4
        filters = {"symbol": given.symbol, "start": given.start, "end": given.end, "strategy": given.strategy}
        order = checked.orderBy("return_rank", "strategy_name", "run_id")
        print(artifacts.write_bundle(order, given.csv, given.json, {"query": "strategy_run_comparison", "filters": filters}, given.force))
        return 0
    except contracts.ContractError as e:
        print(e, file=sys.stderr)
        return 3
    except AnalysisException as e:
        print(artifacts.redact(str(e)), file=sys.stderr)
        return 5
    except (ValueError, OSError) as e:
        print(artifacts.redact(str(e)), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
