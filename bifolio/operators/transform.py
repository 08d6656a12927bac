"""The pluggable transformation of blocks, such as translation."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Translate = Callable[[str], str]


def transformed(pending: DataFrame, make: Callable[[], Translate], partitions: int | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """The rows with ``t``: each text through the function that ``make`` builds once in each task.

    ``settings`` are environment variables of the worker, such as the mode of a
    sentence segmenter, set before ``make`` is called.

    ``partitions`` deals the blocks out anew, so that one long document's are
    spread over the cluster.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ.update(settings or {})
        translate = make()
        for texts in batches:
            yield texts.map(translate)

    rows = pending.repartition(partitions) if partitions else pending
    return rows.withColumn("t", run("text"))
