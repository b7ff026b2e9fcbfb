"""Books, backtest, return metrics."""
