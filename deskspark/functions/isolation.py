"""Errors of a user's batch function kept to the rows that cause them.

A function that fails on a batch is called again on its halves, and on theirs, until what fails is a single row, which gets the error;
all other rows get their values. A batch of n rows with e bad ones costs about 2 * e * log2(n) calls more. A call that gives
back another number of values than it was given rows has failed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR_CHARS = 500


def bisected(fn: Callable[..., Sequence], columns: Sequence[Sequence]) -> tuple[list, list[str | None]]:
    """(values, errors) of fn over rows given as columns; of each row one of the two is None unless the value itself is."""
    n = len(columns[0])
    values, errors = [None] * n, [None] * n
    open_ = [(0, n)] if n else []
    while open_:
        start, stop = open_.pop()
        try:
            got = list(fn(*[c[start:stop] for c in columns]))
            if len(got) != stop - start:
                raise ValueError(f"{len(got)} values for {stop - start} rows")
            values[start:stop] = got
        except Exception as exc:  # noqa: BLE001  whatever a user's function raises
            if stop - start == 1:
                errors[start] = f"{type(exc).__name__}: {exc}"[:ERROR_CHARS]
            else:
                middle = (start + stop) // 2
                open_ += [(middle, stop), (start, middle)]
    return values, errors


def isolated(fn: Callable[..., Sequence], kind: str) -> Callable[..., Column]:
    """Column function of a batch function over lists: struct (value `kind`, error string), one row for each."""
    @F.pandas_udf(f"struct<value: {kind}, error: string>")
    def one(a: pd.Series) -> pd.DataFrame:
        values, errors = bisected(fn, [a.tolist()])
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": errors})

    @F.pandas_udf(f"struct<value: {kind}, error: string>")
    def two(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        values, errors = bisected(fn, [a.tolist(), b.tolist()])
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": errors})

    return lambda *columns: {1: one, 2: two}[len(columns)](*columns)


def isolated_answers(rows: DataFrame, fn: Callable[[pd.DataFrame], list[str]], out: str = "answer", error: str = "error_message") -> DataFrame:
    """Run a user's model function over Arrow batches of whole rows: its texts in `out`, what failed in `error`."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches):
        for pdf in batches:
            values, errors = bisected(lambda at: fn(pdf.iloc[at]), [list(range(len(pdf)))])
            yield pdf.assign(**{out: pd.Series(values, dtype=object, index=pdf.index), error: pd.Series(errors, dtype=object, index=pdf.index)})

    return rows.mapInPandas(run, schema)
