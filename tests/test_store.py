"""Generations of bars under writers that don't know of each other, and after crashes."""

import datetime as dt

import pytest

from barquet.schemas import BARS
from barquet.sources import store


def bars(spark, *rows):
    """Rows (symbol, day, close)."""
    made = [(dt.datetime(2023, 3, d), s, c, c + 1, c - 1, c, 10.0, c, 0.0, 1.0, "x") for s, d, c in rows]
    return spark.createDataFrame(made, BARS)


def seen(spark, path):
    return sorted((r.symbol, r.timestamp.day, r.close) for r in store.current_bars(spark, path).collect())


def test_two_writers_from_one_base(spark, tmp_path):
    path = str(tmp_path / "s")
    base = store.publish_bars(path, bars(spark, ("A", 1, 5.0), ("A", 2, 6.0), ("B", 1, 7.0)))
    store.publish_bars(path, bars(spark, ("A", 1, 5.0), ("A", 2, 6.5), ("B", 1, 7.0)), base)
    late = bars(spark, ("A", 1, 5.0), ("A", 2, 6.0), ("A", 3, 8.0), ("B", 1, 7.5))
    ranges = spark.createDataFrame([("A", dt.date(2023, 3, 3), dt.date(2023, 3, 4)), ("B", dt.date(2023, 3, 1), dt.date(2023, 3, 1))], "symbol string, start date, end date")
    store.publish_bars(path, late, base, ranges)
    assert seen(spark, path) == [("A", 1, 5.0), ("A", 2, 6.5), ("A", 3, 8.0), ("B", 1, 7.5)]  # both writers' rows
    store.publish_bars(path, bars(spark, ("A", 1, 9.0)), store.current_generation(spark, path))
    assert seen(spark, path) == [("A", 1, 9.0)]  # from the current base, the rows are the generation


def test_a_writer_in_between_is_merged(spark, tmp_path):
    path = str(tmp_path / "s")
    base = store.publish_bars(path, bars(spark, ("A", 1, 5.0)))
    calls = []

    def other(whole):
        calls.append(whole.count())
        if len(calls) == 1:
            store.publish_bars(path, bars(spark, ("A", 1, 5.0), ("C", 1, 3.0)), base)

    store.publish_bars(path, bars(spark, ("A", 1, 5.5)), base, check=other)
    assert calls == [1, 2] and seen(spark, path) == [("A", 1, 5.5), ("C", 1, 3.0)]


def test_conflicts_end_clearly(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    base = store.publish_bars(path, bars(spark, ("A", 1, 5.0)))
    monkeypatch.setattr(store, "_point", lambda *_: False)
    with pytest.raises(store.PublishConflict):
        store.publish_bars(path, bars(spark, ("A", 1, 6.0)), base)
    assert store.current_generation(spark, path) == base and seen(spark, path) == [("A", 1, 5.0)]


def test_crashes_leave_the_old_generation(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="nothing"):
        store.current_bars(spark, path)
    base = store.publish_bars(path, bars(spark, ("A", 1, 5.0)))

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_point", crash)  # after the rows, before the pointer
        with pytest.raises(KeyboardInterrupt):
            store.publish_bars(path, bars(spark, ("A", 1, 6.0)), base)
    assert seen(spark, path) == [("A", 1, 5.0)]
    (tmp_path / "s" / "_pointers" / "00000002").write_text("")  # while the pointer is written
    assert seen(spark, path) == [("A", 1, 5.0)]
    store.publish_bars(path, bars(spark, ("A", 1, 7.0)), base)
    assert seen(spark, path) == [("A", 1, 7.0)]

    def refuse(_):
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        store.publish_bars(path, bars(spark, ("A", 1, 8.0)), base, check=refuse)
    assert seen(spark, path) == [("A", 1, 7.0)]
