"""Relational operators over bars: validity, reconciliation, windows, backtests, metrics, ledgers and orders."""
