"""Tidemark: daily observation, signal and forecast-backtest analytics as Spark plans."""
