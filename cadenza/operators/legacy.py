"""The older timing analysis: sample statistics, percentiles, anomaly severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import fixed, ratio
from cadenza.operators.buckets import BUCKETS_PER_SLICE
from cadenza.timeline import KEY, exact_percentiles, numbered, with_facts

PERCENTILES = (25, 50, 75, 90, 95, 99)


def sample_variance(total: Column, squares: Column, n: Column) -> Column:
    """ddof = 1, in s², from whole-millisecond sums; one value gives 0."""
    spread = F.greatest(F.lit(0.0), squares - total * (total / n))
    return F.when(n > 1, spread / (n - 1) / F.lit(1e6)).otherwise(F.lit(0.0))


def timing_buckets(cut: DataFrame) -> DataFrame:
    """Bucket metrics and sample gap statistics, folded map-side: a bucket may be very long."""
    spoken = F.col("end_ms") - F.col("start_ms")
    order = F.struct("sort_ms", "segment_id", "pos")
    sums = cut.groupBy(KEY, "bucket_index").agg(
        F.min("bucket_start_ms").alias("start_ms"),
        F.max_by("end_ms", order).alias("end_ms"),
        F.count(F.lit(1)).alias("word_count"),
        F.sum(spoken).alias("speech_ms"),
        F.sum(F.col("probability").cast("decimal(18,8)")).alias("_p"),
        F.count("gap_ms").alias("gap_count"),
        F.coalesce(F.sum("gap_ms"), F.lit(0)).alias("gap_sum"),
        F.coalesce(F.sum(F.col("gap_ms") * F.col("gap_ms")), F.lit(0)).alias("gap_squares"),
    )
    length = F.col("end_ms") - F.col("start_ms")
    n, s, q = F.col("gap_count"), F.col("gap_sum"), F.col("gap_squares")
    return sums.select(
        KEY,
        "bucket_index",
        "start_ms",
        "end_ms",
        "word_count",
        F.when(length > 0, F.col("word_count") / (length / 1000.0)).otherwise(F.lit(0.0)).alias("words_per_second"),
        (F.col("speech_ms") / 1000.0).alias("total_speech_time"),
        ((length - F.col("speech_ms")) / 1000.0).alias("total_silence_time"),
        (F.col("_p").cast("double") / F.col("word_count")).alias("confidence"),
        n.alias("word_gap_count"),
        ratio(s / 1000.0, n).alias("word_gap_mean"),
        sample_variance(s, q, n).alias("word_gap_var"),
        "gap_sum",
        "gap_squares",
    )


def gap_lists(cut: DataFrame) -> DataFrame:
    """All gaps of each bucket in order, in parts: one per slice that the bucket touches."""
    item = F.struct("sort_ms", "segment_id", "pos", "gap_ms")
    gaps = cut.where(F.col("gap_ms").isNotNull())
    return gaps.groupBy(KEY, "bucket_index", F.col("slice").alias("part_no")).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda w: w["gap_ms"]).alias("gaps_ms")
    )


def first_gaps(cut: DataFrame, gap_list_max: int) -> DataFrame:
    """First ``gap_list_max`` gaps of each bucket, in order.

    Words are numbered over the recording's slices; a bucket's first words are those with a
    small distance to its first number, so long buckets are never gathered.
    """
    order = ["sort_ms", "segment_id", "pos"]
    rows = numbered(cut.select(KEY, "slice", *order, "bucket_index", "gap_ms"), order, "_no")
    heads = rows.where(F.col("gap_ms").isNull()).groupBy(KEY, "bucket_index").agg(
        F.min("_no").alias("_head"), F.min("slice").alias("_from")
    )
    # a bucket's first gaps lie within gap_list_max rows of its head: join by row blocks
    width = 4096
    near = heads.withColumn(
        "_at", F.explode(F.expr(f"sequence(_head div {width}L, (_head + {gap_list_max}) div {width}L)"))
    )
    picked = (
        rows.withColumn("_at", F.expr(f"_no div {width}L"))
        .join(near, [KEY, "bucket_index", "_at"])
        .where((F.col("_no") > F.col("_head")) & (F.col("_no") <= F.col("_head") + gap_list_max))
    )
    return picked.groupBy(KEY, "bucket_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_no", "gap_ms"))), lambda x: x["gap_ms"]).alias("gaps_ms")
    )


def bucket_text_parts(cut: DataFrame) -> DataFrame:
    """Text of each bucket in parts, one per slice it touches; joined with a space they give the whole."""
    item = F.struct("sort_ms", "segment_id", "pos", "word")
    return cut.groupBy(KEY, "bucket_index", F.col("slice").alias("part_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda w: w["word"]), " ").alias("text")
    )


def cadence_summary(mean: Column, std: Column) -> Column:
    pace = (
        F.when(mean < 0.05, F.lit("very fast"))
        .when(mean < 0.1, F.lit("fast"))
        .when(mean < 0.2, F.lit("normal"))
        .when(mean < 0.4, F.lit("slow"))
        .otherwise(F.lit("very slow"))
    )
    steady = (
        F.when(std < 0.02, F.lit("very consistent"))
        .when(std < 0.05, F.lit("consistent"))
        .when(std < 0.1, F.lit("variable"))
        .otherwise(F.lit("highly variable"))
    )
    return F.concat(
        pace, F.lit(" speech with "), steady, F.lit(" pacing (μ="), fixed(mean, 3), F.lit("s, σ="), fixed(std, 3), F.lit("s)")
    )


def global_cadence(cut: DataFrame, buckets: DataFrame, gap_threshold: float = 1.5) -> DataFrame:
    """Mean, sample deviation, exact percentiles and summary of all in-bucket gaps per recording."""
    n, s, q = F.col("total_gaps"), F.col("_s"), F.col("_q")
    base = buckets.groupBy(KEY).agg(
        F.sum("word_count").alias("total_words"),
        F.sum("word_gap_count").alias("total_gaps"),
        F.sum("gap_sum").alias("_s"),
        F.sum("gap_squares").alias("_q"),
        F.count(F.lit(1)).alias("bucket_count"),
        F.min("bucket_index").alias("_lo"),
        F.max("bucket_index").alias("_hi"),
    )
    names = [f"p{p}" for p in PERCENTILES]
    shares = exact_percentiles(cut.select(KEY, "gap_ms"), "gap_ms", [p / 100.0 for p in PERCENTILES], names, 100.0)
    rows = base.join(shares, KEY, "left").withColumns(
        {
            "global_gap_mean": ratio(s / 1000.0, n),
            "global_gap_std": F.sqrt(sample_variance(s, q, n)),
        }
    )
    return rows.select(
        KEY,
        "global_gap_mean",
        "global_gap_std",
        "total_words",
        "total_gaps",
        "bucket_count",
        F.lit(gap_threshold).alias("anomaly_threshold"),
        *[(F.col(p) / 1000.0).alias(p) for p in names],
        F.when(n == 0, F.lit("No gaps detected"))
        .otherwise(cadence_summary(F.col("global_gap_mean"), F.col("global_gap_std")))
        .alias("cadence_summary"),
        "_lo",
        "_hi",
    )


def flag_anomalies(
    buckets: DataFrame, cadence: DataFrame, gap_threshold: float = 1.5, variance_threshold: float = 1.5
) -> DataFrame:
    """Anomaly flag and severity of each bucket; fewer than two gaps are always normal."""
    facts = cadence.select(KEY, "global_gap_mean", "global_gap_std", "_lo", "_hi")
    rows = with_facts(buckets, facts, "bucket_index", "_lo", "_hi", BUCKETS_PER_SLICE)
    off = F.abs(F.col("word_gap_mean") - F.col("global_gap_mean"))
    mean_limit = F.lit(gap_threshold) * F.col("global_gap_std")
    var_limit = F.lit(variance_threshold) * F.col("global_gap_std") * F.col("global_gap_std")
    over = lambda k: (off > k * mean_limit) | (F.col("word_gap_var") > k * var_limit)
    enough = F.col("word_gap_count") >= 2
    return rows.withColumns(
        {
            "cadence_anomaly": enough & over(1),
            "cadence_severity": F.when(~enough | ~over(1), F.lit("normal"))
            .when(over(3), F.lit("severe"))
            .when(over(2), F.lit("moderate"))
            .otherwise(F.lit("mild")),
            "gap_deviation_from_global": off,
        }
    )


def cadence_analysis(cadence: DataFrame, flagged: DataFrame) -> DataFrame:
    """The global analysis with its number of anomalous buckets."""
    odd = flagged.groupBy(KEY).agg(F.count_if("cadence_anomaly").alias("anomalous_buckets"))
    return cadence.join(odd, KEY)
