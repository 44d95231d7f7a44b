"""The library's queries and the SQL that gives the same rows, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.operators import anomaly, backtest, canonical, curves, evidence, intervals, ledger, orders, qualification, reconcile, report, research, review, tradeoffs, validate, validation, windows
from tapeline.plans import pending, rotation
from tapeline.shipping import ready
from tapeline.sources import files, listings, uploads, versions
from tapeline.streaming import outbox, quotes, replay

_MODULES = (windows, anomaly, validate, reconcile, backtest, curves, research, validation, review, canonical, evidence, qualification, report, tradeoffs, intervals, rotation, pending, ledger, orders, quotes, replay, outbox, files, listings, uploads, versions)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: ready(query) for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
