"""Results as files for people: CSV with JSON metadata, JSON documents, an HTML report of one run.

These are for small, bounded results (a comparison, a report); tables stay Parquet. Both files of a bundle appear, or
none does.
"""

from __future__ import annotations

import csv
import datetime as dt
import html
import json
import math
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 100_000

#: What must not get into files and logs.
SECRETS = (
    re.compile(r"(?i)\b(api[_-]?key|apikey|access[_-]?token|token|secret|password|passwd|authorization)(\s*[=:]\s*)([^\s&,;]+)"),
    re.compile(r"(?i)\b(bearer\s+)([A-Za-z0-9._~+/-]+=*)"),
    re.compile(r"(://)([^/\s:@]+:[^/\s@]+)(@)"),
)


def redact(text: str) -> str:
    """The text without credentials: named values, bearer tokens, user parts of addresses."""
    text = SECRETS[0].sub(r"\1\2[redacted]", text)
    text = SECRETS[1].sub(r"\1[redacted]", text)
    return SECRETS[2].sub(r"\1[redacted]\3", text)


def plain(value):
    """A value as JSON can hold it: times in ISO form, what isn't finite as null."""
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return redact(value) if isinstance(value, str) else value


def rows_of(frame: DataFrame) -> list:
    """The rows of a small result. ValueError if it isn't one."""
    rows = frame.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write a table instead")
    return rows


def _staged(target: Path, write) -> Path:
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        write(f)
        f.flush()
        os.fsync(f.fileno())
    return Path(name)


def write_json(path: str | Path, document, force: bool = False) -> None:
    """Sorted keys, two blanks of indent."""
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(path)
    os.replace(_staged(path, lambda f: f.write(json.dumps(plain(document), sort_keys=True, indent=2, allow_nan=False) + "\n")), path)


def write_bundle(frame: DataFrame, csv_path: str | Path, json_path: str | Path, metadata: dict, force: bool = False) -> int:
    """A result as CSV (null as nothing) and its metadata as JSON; returns the number of rows."""
    targets = Path(csv_path), Path(json_path)
    if targets[0].resolve() == targets[1].resolve():
        raise ValueError("the two files must differ")
    for t in targets:
        if t.exists() and not force:
            raise FileExistsError(t)
    rows = rows_of(frame)

    def table(f) -> None:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(frame.columns)
        out.writerows(["" if (v := plain(x)) is None else v for x in r] for r in rows)

    staged: list[Path] = []
    try:
        staged.append(_staged(targets[0], table))
        document = {**metadata, "columns": frame.columns, "row_count": len(rows)}
        staged.append(_staged(targets[1], lambda f: f.write(json.dumps(plain(document), sort_keys=True, indent=2) + "\n")))
        for s, t in zip(staged, targets, strict=True):
            os.replace(s, t)
    finally:
        for s in staged:
            s.unlink(missing_ok=True)
    return len(rows)


def html_report(title: str, metrics: dict[str, float], equity: list[tuple[dt.datetime, float]]) -> str:
    """One run as a page: its metrics, shares of one as percentages, and its equity curve as a drawing."""

    def shown(name: str, value: float) -> str:
        if any(part in name for part in ("rate", "drawdown", "cagr", "return")) and "duration" not in name:
            return f"{value:.2%}"
        return f"{value:.4f}"

    lines = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(shown(k, v))}</td></tr>" for k, v in metrics.items() if v is not None)
    values = [v for _, v in equity]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    scale = lambda i, v: f"{800 * i / max(len(values) - 1, 1):.1f},{200 - 200 * (v - low) / ((high - low) or 1):.1f}"
    points = " ".join(scale(i, v) for i, v in enumerate(values))
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
        f"<table>{lines}</table><svg viewBox='0 0 800 200' width='800' height='200'><polyline fill='none' stroke='black' points='{points}'/></svg></body></html>"
    )
