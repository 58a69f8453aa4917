"""Quality rules by robust multivariate outliers.

Text statistics are transformed to be roughly symmetric; per language and source a minimum
covariance determinant estimate of their centre and scatter is found, and documents far away
by Mahalanobis distance are rejected.

The estimate covers all rows of a group.  It starts from coordinate-wise medians and spreads
(deterministic start) and takes concentration steps: distances of all rows, then the mean and
covariance of the half with the smallest ones.  A step is one aggregation: rows are counted
and summed by (group, distance class), with partial sums before the shuffle, so that a group
of any size is a few dozen small rows afterwards.  The class in which the half ends counts in
proportion.  Groups with too few rows are pooled by language, and if need be all together.  Statistics that
are constant in most texts would make the scatter singular; no spread is taken to be less than
what counting itself leaves open in a text of the group's typical length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WIDTH = 5
PRODUCTS = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
ESTIMATE = "pool long, centre array<double>, inverse array<double>"
STEPS = 4
#: Distance classes: each wider than the one before by a constant factor.
CLASSES = 40
LEAST = 0.02
RATIO = 0.25
#: A key with fewer rows has no estimate of its own.
SMALLEST = 100
#: Makes the scatter of the inner half of normal rows that of all: 0.5 / P(chi2_7 <= median of chi2_5).
CONSISTENT = 1.91
#: 0.999 quantile of chi-square with five degrees of freedom
CUTOFF = 20.515


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated three-word windows."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    repeated_lines = 0
    if b"\n" in data:
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeated_lines = len(lines) - len(set(lines))
    repeated_words = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pairs = at[:-1] * len(number) + at[1:]
        if len(np.unique(pairs)) < n - 1:
            pair = np.unique(pairs, return_inverse=True)[1]
            _, inverse, times = np.unique(pair[:-1] * len(number) + at[2:], return_inverse=True, return_counts=True)
            hit = np.flatnonzero(times[inverse] > 1)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[hit + k] = True
            repeated_words = int(covered.sum())
    return n, chars, symbols, repeated_lines, repeated_words


def measure(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds the statistics of the whole text to every row; null texts have none of anything."""

    def measured(text):
        return list(zip(*map(statistics, common.texts(text)), strict=True)) or [[]] * WIDTH

    return common.with_columns(df, measured, ["text"], STATISTICS, keep)


def transformed(df: DataFrame) -> DataFrame:
    """Adds x0 to x4, the statistics on scales where most documents spread evenly."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return df.withColumns({f"x{i}": c for i, c in enumerate(x)})


def pooled(df: DataFrame, keys: Sequence[str], smallest: int) -> DataFrame:
    """(keys, pool): the pool whose estimate the rows of a key take.

    A key with enough rows is its own pool.  The others pool by the first key column, and
    where that is still too small, all together.
    """
    first, *_ = keys
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    own = F.col("n") >= smallest
    rest = counts.where(~own).groupBy(F.col(first).alias("f")).agg((F.sum("n") >= smallest).alias("enough"))
    joined = counts.join(rest, F.col(first).eqNullSafe(F.col("f")), "left")
    pool = F.when(own, F.xxhash64(F.lit(0), *keys)).when(F.col("enough"), F.xxhash64(F.lit(1), first)).otherwise(F.xxhash64(F.lit(2)))
    return joined.select(*keys, pool.alias("pool"))


def distance() -> Column:
    """Squared Mahalanobis distance of x0 to x4 from ``centre`` under ``inverse``."""
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(WIDTH)]
    terms = [F.col("inverse")[i * WIDTH + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(WIDTH) for j in range(i, WIDTH)]
    return reduce(lambda a, b: a + b, terms)


def resolution(centre: np.ndarray) -> float:
    """Smallest spread that a transformed statistic is taken to have around ``centre``.

    In a text of n words one word more or less moves the square root of a rate, from none, by
    1 / sqrt(n), and a count of n, on the scale of logarithms, is uncertain by as much.
    """
    return 1 / math.sqrt(max(1.0, math.expm1(centre[0])))


def regular(scatter: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Inverse of the scatter with every spread raised to ``floor``."""
    return np.linalg.inv(scatter + np.diag(np.maximum(floor**2 - np.diag(scatter), 1e-9)))


def start(rows: pd.DataFrame) -> pd.DataFrame:
    """Medians and quartile spreads of one pool as centre and diagonal scatter."""
    low, middle, high = (np.array([rows[f"q{i}"].iloc[0][k] for i in range(WIDTH)], float) for k in range(3))
    scatter = np.diag(((high - low) / 1.349) ** 2)
    return pd.DataFrame({"pool": [rows["pool"].iloc[0]], "centre": [middle], "inverse": [regular(scatter, resolution(middle)).ravel()]})


def concentrated(rows: pd.DataFrame) -> pd.DataFrame:
    """Estimate of one pool from the half of its rows with the smallest distances.

    ``rows`` has one line per distance class: n, the sums s0.. and the sums of products p0..
    """
    rows = rows.sort_values("class")
    n = rows["n"].to_numpy(float)
    part = np.clip((n.sum() / 2 - (n.cumsum() - n)) / n, 0, 1)
    total = part @ n
    centre = part @ rows[[f"s{i}" for i in range(WIDTH)]].to_numpy(float) / total
    products = np.zeros((WIDTH, WIDTH))
    for k, (i, j) in enumerate(PRODUCTS):
        products[i, j] = products[j, i] = part @ rows[f"p{k}"].to_numpy(float) / total
    scatter = CONSISTENT * (products - np.outer(centre, centre))
    return pd.DataFrame({"pool": [rows["pool"].iloc[0]], "centre": [centre], "inverse": [regular(scatter, resolution(centre)).ravel()]})


def estimates(measured: DataFrame, keys: Sequence[str] = ("lang", "source"), smallest: int = SMALLEST, steps: int = STEPS) -> DataFrame:
    """(keys, pool, centre, inverse): the estimate that holds for each key of ``measured``, a table on disk."""
    x = transformed(measured)
    pools = common.stage(pooled(measured, keys, smallest), "pools")

    def joined(table: DataFrame) -> DataFrame:
        on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
        return x.alias("l").join(table.alias("r"), on).select(F.col("l.*"), *[F.col(f"r.{c}") for c in table.columns if c not in keys])

    quartiles = [F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(WIDTH)]
    found = joined(pools).groupBy("pool").agg(*quartiles).groupBy("pool").applyInPandas(start, ESTIMATE)
    sums = [
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(WIDTH)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{k}") for k, (i, j) in enumerate(PRODUCTS)],
    ]
    number = F.floor(F.log(F.greatest(distance(), F.lit(LEAST)) / LEAST) / RATIO)
    for _ in range(steps):
        now = common.stage(pools.join(found, "pool"), "estimates")
        classes = joined(now).withColumn("class", F.least(number, F.lit(CLASSES)))
        found = classes.groupBy("pool", "class").agg(*sums).groupBy("pool").applyInPandas(concentrated, ESTIMATE)
    return common.stage(pools.join(found, "pool"), "estimates")


def judge(measured: DataFrame, table: DataFrame, keys: Sequence[str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """Adds base_failed, distance (squared) and kept to ``measured``, by the estimates of ``table``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    near = transformed(measured).alias("l").join(table.alias("r"), on, "left")
    return near.select(
        *[F.col(f"l.{c}") for c in measured.columns],
        base.alias("base_failed"),
        F.coalesce(distance(), F.lit(0.0)).alias("distance"),
        (~base & (F.coalesce(distance(), F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def reject(df: DataFrame, keys: Sequence[str] = ("lang", "source")) -> DataFrame:
    """doc_id, the statistics, base_failed, distance and kept for every row of ``df`` (doc_id, text, keys).

    Null keys are a value of their own; other columns are left out; repeated rows stay and
    count; null and empty texts have no words and fail; an empty table stays empty.
    """
    measured = common.stage(measure(df, ["doc_id", *keys]), "statistics")
    return judge(measured, estimates(measured, keys), keys)
