"""Places where a user's model plugs in.

The function is called inside Spark tasks.  A failing input becomes a row with an ``error``
text, so it does not end the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.schemas import DIARIZATION
from cadenza.timeline import KEY


def map_chunks(
    manifest: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Run ``fn`` over ``manifest``, one Arrow batch of rows (a pandas frame) at a time.

    ``setup`` runs once per partition (load a model there); ``fn`` is then called as
    ``fn(rows, state)``.  If it raises, the rows of that batch are tried one by one, so that only
    those fail that cannot be done.  Every output row has ``error``, null on success; a failed
    manifest row keeps its key columns.
    """
    spark = manifest.sparkSession
    fields = spark.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]
    kept = [n for n in names if n in manifest.columns]

    def call(rows: pd.DataFrame, state: object) -> pd.DataFrame:
        out = fn(rows, state) if setup else fn(rows)
        return out.assign(error=None)[[*names, "error"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for batch in batches:
            try:
                yield call(batch, state)
            except Exception:  # some row of the batch fails
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1]
                    try:
                        yield call(one, state)
                    except Exception as e:  # a failed input is a row, not the end of the job
                        failed = one[kept].assign(error=f"{type(e).__name__}: {e}")
                        yield failed.reindex(columns=[*names, "error"])

    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in fields], T.StructField("error", T.StringType())])
    return manifest.mapInPandas(run, out)


def map_recordings(manifest: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], setup=None) -> DataFrame:
    """Run a user's diarizer over recordings; output rows are speaker turns."""
    return map_chunks(manifest, fn, DIARIZATION, setup)


def failure_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(KEY).agg(
        F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
