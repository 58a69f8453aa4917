"""Text search on a stored inverted index.

The index is a Parquet table of postings (term, recording, bucket, positions), cut into parts by a hash
of the term and sorted by term inside.  A query reads the parts of its terms only, and in them the row
groups that hold the terms.  New rows are appended as a generation of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.timeline import KEY

PARTS = 64
POSTINGS = "term string, recording_id bigint, bucket_index bigint, positions array<int>, part int"


def terms(text: str):
    """Case-folded words of a column, in order."""
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def part_of(term):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def append_text(rows: DataFrame, path: str, text: str = "text") -> None:
    """Adds ``rows`` (recording_id, bucket_index, text) to the index below ``path``; null texts have no words.

    A very frequent term is dealt out by its recordings, so that its part is no single task.
    """
    each = rows.select(KEY, "bucket_index", F.posexplode(terms(text)).alias("position", "term"))
    postings = each.groupBy("term", KEY, "bucket_index").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    placed = postings.withColumn("part", part_of("term"))
    dealt = placed.repartitionByRange("part", "term", KEY, "bucket_index").sortWithinPartitions("part", "term", KEY, "bucket_index")
    dealt.write.mode("append").partitionBy("part").parquet(path)


def search_index(spark: SparkSession, path: str, query: str, phrase: bool = False) -> DataFrame:
    """(recording_id, bucket_index, hits): rows that hold every term of ``query``; with ``phrase`` side by side in its order.

    hits counts occurrences of terms, or of the phrase.  A query without terms finds nothing.
    """
    wanted = [t for t in query.lower().split() if t]
    named = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "i int, term string")
    parts = sorted({r[0] for r in named.select(part_of("term")).collect()})  # as many as the query has terms
    postings = spark.read.schema(POSTINGS).parquet(path).where(F.col("part").isin(parts) & F.col("term").isin(wanted))
    distinct = len(set(wanted))
    if not phrase:
        found = postings.groupBy(KEY, "bucket_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("positions")).cast("int").alias("hits"))
        return found.where(F.col("n") == distinct).drop("n")
    # where the phrase would begin, by each of its words; it stands where all agree
    begins = postings.join(F.broadcast(named), "term").select(KEY, "bucket_index", "i", F.explode("positions").alias("p"))
    agreed = begins.groupBy(KEY, "bucket_index", (F.col("p") - F.col("i")).alias("begin")).agg(F.count(F.lit(1)).alias("n"))
    return agreed.where(F.col("n") == len(wanted)).groupBy(KEY, "bucket_index").agg(F.count(F.lit(1)).cast("int").alias("hits"))
