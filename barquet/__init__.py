"""Daily-bar backtest analytics and corpus preparation on Spark."""
