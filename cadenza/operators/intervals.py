"""Interval joins inside a recording.

Both sides are cut into time bins and joined on (recording, bin), so a long recording
spreads over many join keys.  A pair that shares several bins is kept only in the first
bin both touch, which makes a later ``distinct`` unnecessary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.timeline import KEY

BIN_MS = 30_000


def _binned(df: DataFrame, start: str, end: str, bin_ms: int, name: str) -> DataFrame:
    first = F.expr(f"`{start}` div {bin_ms}L")
    last = F.greatest(first, F.expr(f"(`{end}` - 1) div {bin_ms}L"))
    return df.withColumn(name, first).withColumn("_bin", F.explode(F.sequence(first, last)))


def interval_pairs(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str] = ("start_ms", "end_ms"),
    right_span: tuple[str, str] = ("start_ms_r", "end_ms_r"),
    bin_ms: int = BIN_MS,
    extra=None,
) -> DataFrame:
    """Pairs of rows of one recording whose spans strictly intersect."""
    a = _binned(left, *left_span, bin_ms, "_first_l")
    b = _binned(right, *right_span, bin_ms, "_first_r")
    hit = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(left_span[1]) > F.col(right_span[0]))
    hit = hit & (F.col("_bin") == F.greatest("_first_l", "_first_r"))
    if extra is not None:
        hit = hit & extra
    return a.join(b, [KEY, "_bin"]).where(hit).drop("_bin", "_first_l", "_first_r")
