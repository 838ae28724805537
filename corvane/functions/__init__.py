"""Column expressions and the scalar helpers behind them."""
