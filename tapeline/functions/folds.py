"""Path-dependent folds: rows are dealt by key, sorted within tasks and read as a stream that holds one state, so
that a key of any length is never gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """The rows in tasks that hold whole keys, for functions over a task's rows.

    They are dealt by a hash of the keys: a repartition by what the join below is dealt by already is left out of the plan,
    and then a task of that join may be split for its size, or read map by map, as such functions ask for no distribution."""
    by = F.xxhash64(*keys)
    return rows.repartition(parts, by) if parts else rows.repartition(by)


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], list], step: Callable[..., tuple], fields: str, *, last_only: bool = False) -> DataFrame:
    """keys, and for each row what step(state, *columns) returns; with last_only only that of a key's last row.

    `state` is a list that step changes in place. fields is the schema of what it returns. Rows equal in keys and
    order may come in any order; give a complete one where that matters."""
    names = [*keys, *(x.split()[0] for x in fields.split(", "))]
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, made = None, start(), None
        for batch in batches:
            out = []
            for own, row in zip(zip(*(batch[k] for k in keys), strict=True), zip(*(batch[c] for c in columns), strict=True), strict=True):
                if own != key:
                    if last_only and key is not None:
                        out.append((*key, *made))
                    key, state = own, start()
                made = step(state, *row)
                if not last_only:
                    out.append((*key, *made))
            yield pd.DataFrame(out, columns=names)
        if last_only and key is not None:
            yield pd.DataFrame([(*key, *made)], columns=names)

    wanted = list(dict.fromkeys([*keys, *order, *columns]))
    return dealt(rows.select(wanted), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
