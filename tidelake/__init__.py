"""Time-series analytics on Spark: alignment, features, targets, rules, backtests, models."""
