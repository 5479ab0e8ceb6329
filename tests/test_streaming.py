"""The streamed fold gives the events of the batch fold."""

from barquet.operators import backtest
from barquet.sources import market
from barquet.streaming.fold import stream_backtest


def test_same_events(spark, tmp_path):
    bars = market.bars(spark, "/root/testdata/sf0.001").checkpoint() if spark.sparkContext.getCheckpointDir() else market.bars(spark, "/root/testdata/sf0.001")
    params = {"fast_period": 3.0, "slow_period": 8.0}
    cuts = ["2024-01-10", "2024-01-20", "2025-01-01"]
    low, folder = "2000-01-01", str(tmp_path / "in")
    schema = bars.schema
    config = backtest.Config(initial_capital=1000.0)
    for i, high in enumerate(cuts):
        bars.where(f"timestamp >= '{low}' and timestamp < '{high}'").coalesce(1).write.mode("append").parquet(folder)
        low = high
        stream = stream_backtest(spark.readStream.schema(schema).parquet(folder), "ma_crossover", params, config)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    specs = spark.createDataFrame([(f"ma_crossover|{r.symbol}", "ma_crossover", r.symbol, params) for r in bars.select("symbol").distinct().collect()], "run_id string, strategy string, symbol string, params map<string,double>")
    want = backtest.run_backtests(bars, specs, config).where("note is null or note <> 'cancelled_end_of_data'")
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("run_id", "kind", "seq", "timestamp", "equity", "pnl", "note").collect())
    assert key(got) == key(want) and any(r[1] == "trade" for r in key(got))
