"""A user's function for every configuration, over statistics that Spark has aggregated."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riffle.operators.joins import lookup
from riffle.session import materialize

# Configurations of one task.
GROUPS_PER_TASK = 200


def fit_each(
    frame: DataFrame, keys: Sequence[str], statistics: Mapping[str, Column], function: Callable[[dict[str, np.ndarray]], Mapping[str, Any] | None],
    result: str | T.StructType, cells: int = 1,
) -> DataFrame:
    """Calls ``function`` once per configuration; one row each with ``result``'s columns, ``status`` and ``error``.

    ``frame`` has the key columns, ``x`` and ``y``; any other columns may be used by ``statistics``, which names
    aggregates such as ``F.sum("y")``. They are taken over ``cells`` cells of equal width of the configuration's range
    of x (one cell: the whole of it), so a configuration of any size reaches the function as at most ``cells`` numbers
    of each name: a dict of arrays in order of ``cell``, which is given too. Cells without rows are left out; rows whose x
    is missing or not a number are left out. A null statistic is NaN.

    The function returns the result columns as a mapping; names it leaves out are NULL. A function that raises, or returns a
    value that does not fit its column, gives ``failed`` with the error's type and text for its configuration alone;
    None gives ``no_result``. Keys may be NULL. An empty frame gives no rows.
    """
    keys, names = list(keys), list(statistics)
    wanted = T._parse_datatype_string(result) if isinstance(result, str) else result
    taken = {*keys, "status", "error"} & set(wanted.names) | {"cell"} & set(names)
    if taken:
        raise ValueError(f"names in use twice: {sorted(taken)}")
    if cells < 1:
        raise ValueError("at least one cell")
    rows = frame.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    if cells > 1:
        ranges = materialize(rows.groupBy(*keys).agg(F.min("x").alias("x_low_"), F.max("x").alias("x_high_")), "ranges")
        rows = lookup(rows, ranges, keys, ranges.count())
        share = (F.col("x") - F.col("x_low_")) / F.nullif(F.col("x_high_") - F.col("x_low_"), F.lit(0.0))
        rows = rows.withColumn("cell", F.least(F.coalesce(F.floor(share * cells), F.lit(0)), F.lit(cells - 1)).cast("int"))
    else:
        rows = rows.withColumn("cell", F.lit(0))
    sums = materialize(rows.groupBy(*keys, "cell").agg(*[c.cast("double").alias(n) for n, c in statistics.items()]), "cells")
    groups = sums.select(*keys).distinct().count()
    # The tables are small and the function may be slow: tasks by the number of configurations, not by bytes.
    tasks = max(math.ceil(groups / GROUPS_PER_TASK), min(groups, sums.sparkSession.sparkContext.defaultParallelism), 1)
    out = T.StructType([*[sums.schema[k] for k in keys], *wanted.fields, T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    types = {f.name: to_arrow_type(f.dataType) for f in wanted.fields}

    def run(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("cell")
        given = {n: ordered.column(n).to_numpy().astype(float) for n in names}
        given["cell"] = ordered.column("cell").to_numpy()
        status, error, columns = "ok", None, {n: pa.nulls(1, t) for n, t in types.items()}
        try:
            found = function(given)
            if found is None:
                status = "no_result"
            else:
                columns = {n: pa.array([_plain(found.get(n))], t) for n, t in types.items()}
        except Exception as e:  # the user's function may raise anything; its configuration says so
            status, error = "failed", f"{type(e).__name__}: {e}"
        head = {k: ordered.column(k).slice(0, 1) for k in keys}
        return pa.table({**head, **columns, "status": pa.array([status], pa.string()), "error": pa.array([error], pa.string())})

    return sums.repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, out)


def _plain(value: Any) -> Any:
    return value.tolist() if isinstance(value, (np.generic, np.ndarray)) else value

