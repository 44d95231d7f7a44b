"""Rebalance plans: which symbols to hold from which session on, and with which weight."""
