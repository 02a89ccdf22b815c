"""Extension points: batch scoring by a user's function, and errors kept as data."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def score(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``make`` is called once per task and returns a function over batches, so a model is loaded on the executor."""

    def run(batches):
        fn = make()
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def isolate(df: DataFrame, fn: Callable, column: str, kind: str = "string") -> DataFrame:
    """Adds value and error: ``fn`` of ``column``, or the text of the exception it raised; other rows go on."""

    def run(batches):
        for pdf in batches:
            value, error = [], []
            for x in pdf[column]:
                try:
                    value.append(fn(x))
                    error.append(None)
                except Exception as e:
                    value.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(value=value, error=error)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, value {kind}, error string")
