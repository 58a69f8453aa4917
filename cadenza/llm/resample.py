"""Importance resampling towards a target distribution, over hashed word runs.

A document's features are all runs of one to three consecutive words.  A feature's bucket is the
CRC-32 of its bytes, modulo the number of buckets.  The smoothed log ratio of a bucket's share in
the target and in the documents is its gain; a document's weight is the sum of the gains of its
features; weight plus Gumbel noise from a hash of the id is its score, and the highest scores are
drawn, which is sampling without replacement in proportion to the exponential of the weights.

*Head and tail.*  A first pass counts words and pairs inside tasks and gives on only those that
recur within one slice of rows; the most frequent of all are the head, of bounded size.  Tasks get
for each head word the CRC states of the word and of the word after a space, and for each head
pair the state and bucket of both words together.  Everything else takes its CRC directly: a
word's from its bytes, a run's from the state of what comes before it, which is carried over the
following word by the linear map that so many bytes apply to a CRC.  Head and tail give the same
exact buckets, so that the head decides about speed alone; totals cover every feature.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
#: Size of the head.
WORDS = 50_000
PAIRS = 100_000
#: Words and pairs that recur so often within one slice of rows are counted for the head.
RECURRING = 8
SLICE_BYTES = 8_000_000
#: Lower-case bytes; what is no letter, digit or byte of a longer character becomes a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(PLAIN).split()


# --- CRC states ----------------------------------------------------------------------------


class Shifts(dict):
    """For each number of bytes, what so many further bytes do to a CRC: a table for each of its four bytes."""

    def __missing__(self, size: int) -> np.ndarray:
        # a CRC is linear in what precedes: the CRC of a || b is shifted(crc(a)) ^ crc(b)
        zeros = bytes(size)
        base = zlib.crc32(zeros)
        bits = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], np.uint32)
        tables = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for b in range(8):
                tables[k, 1 << b : 2 << b] = tables[k, : 1 << b] ^ bits[8 * k + b]
        self[size] = tables
        return tables


SHIFTS = Shifts()
#: A longer word's shift is applied for its own sake, not looked up for all.
LONG = 128


def carried(state: np.ndarray, size: np.ndarray, following: np.ndarray) -> np.ndarray:
    """CRC of two parts from that of the first, the size of the second in bytes, and that of the second."""
    sizes, at = np.unique(size, return_inverse=True)
    tables = np.stack([SHIFTS[int(s)] if s <= LONG else Shifts.__missing__({}, int(s)) for s in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
    return tables[at, 0, state & 255] ^ tables[at, 1, state >> 8 & 255] ^ tables[at, 2, state >> 16 & 255] ^ tables[at, 3, state >> 24] ^ following


@dataclass
class Head:
    """CRC states of frequent words and pairs."""

    number: dict[bytes, int]
    alone: np.ndarray  # of each word
    after: np.ndarray  # of a space and the word
    size: np.ndarray  # bytes of both
    pair: np.ndarray  # numbers of frequent pairs of head words, ascending
    pair_state: np.ndarray

    @staticmethod
    def of(frequent: list[bytes], pairs: list[tuple[bytes, bytes]]) -> Head:
        number = {w: i for i, w in enumerate(frequent)}
        alone, after, size = states(frequent)
        own = sorted((number[a] * len(frequent) + number[b], a + b" " + b) for a, b in pairs if a in number and b in number)
        return Head(number, alone, after, size, np.array([k for k, _ in own], np.int64), np.array([zlib.crc32(x) for _, x in own], np.uint32))


def states(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alone = np.array([zlib.crc32(w) for w in own], np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in own], np.uint32)
    return alone, after, np.array([len(w) + 1 for w in own], np.int64)


def runs(texts: list[str], head: Head, longest: int = LONGEST_RUN) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many words each text has, and for each run length (text number, CRC) of every run."""
    found = [words(t) for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    many = len(head.number)
    tail: dict[bytes, int] = {}
    get = head.number.get
    number = np.array([n if (n := get(w)) is not None else tail.setdefault(w, many + len(tail)) for x in found for w in x], np.int64)
    alone, after, size = (np.concatenate(p) for p in zip((head.alone, head.after, head.size), states(list(tail)), strict=True))
    state = alone[number]
    out = [(row, state)]
    for n in range(2, longest + 1):
        inside = row[: len(row) - n + 1] == row[n - 1 :]
        begin = np.flatnonzero(inside)
        if n == 2 and len(head.pair):
            first, second = number[begin], number[begin + 1]
            key = np.where((first < many) & (second < many), first * many + second, -1)
            at = np.minimum(np.searchsorted(head.pair, key), len(head.pair) - 1)
            hit = head.pair[at] == key
            value = np.empty(len(begin), np.uint32)
            value[hit] = head.pair_state[at[hit]]
            rest = begin[~hit]
            value[~hit] = carried(state[rest], size[number[rest + 1]], after[number[rest + 1]])
        else:
            value = carried(state[begin], size[number[begin + n - 1]], after[number[begin + n - 1]])
        state = np.zeros(len(row), np.uint32)
        state[begin] = value
        out.append((row[begin], value))
    return counts, out


# --- passes --------------------------------------------------------------------------------


def head_of(df: DataFrame, most_words: int = WORDS, most_pairs: int = PAIRS, recurring: int = RECURRING) -> Head:
    """The most frequent words and pairs of ``df`` (text), at most so many; the driver receives no more than these."""

    def counted(batches):
        for batch in batches:
            for part in common.slices(batch, SLICE_BYTES):
                number: dict[bytes, int] = {}
                found = [[number.setdefault(w, len(number)) for w in words(t)] for t in common.texts(part.column(0))]
                at = np.array([n for x in found for n in x], np.int64)
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                own = list(number)
                count = np.bincount(at, minlength=len(own))
                often = np.flatnonzero(count >= recurring)
                pair, times = np.unique((at[:-1] * len(own) + at[1:])[row[:-1] == row[1:]], return_counts=True)
                pair, times = pair[times >= recurring], times[times >= recurring]
                first = [own[i] for i in often] + [own[i] for i in pair // max(1, len(own))]
                second = [None] * len(often) + [own[i] for i in pair % max(1, len(own))]
                columns = [pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(np.append(count[often], times), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    total = common.stage(df.select("text").mapInArrow(counted, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "head")
    order = [F.col("n").desc(), "a", "b"]
    alone = [bytes(r.a) for r in total.where("b is null").orderBy(*order).limit(most_words).collect()]
    pairs = [(bytes(r.a), bytes(r.b)) for r in total.where("b is not null").orderBy(*order).limit(most_pairs).collect()]
    return Head.of(alone, pairs)


def shared(df: DataFrame, value) -> Callable:
    """A broadcast value, read anew in every task; its size is bounded by the caller."""
    held = df.sparkSession.sparkContext.broadcast(value)
    return lambda: held.value


def totals(df: DataFrame, head: Callable[[], Head], buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts of ``df`` fall into each bucket."""

    def summed(batches):
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.slices(batch, SLICE_BYTES):
                for _, state in runs(common.texts(part.column(0)), head())[1]:
                    count += np.bincount(state % buckets, minlength=buckets)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own], pa.int64())], names=["bucket", "n"])

    rows = df.select("text").mapInArrow(summed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # one row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    ratio = [(float(t + 1) * s_all) / (float(s + 1) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(df: DataFrame, head: Callable[[], Head], gain: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_features and weight to every row of ``df`` (text)."""

    def weighed(text):
        counts, found = runs(common.texts(text), head())
        features, weight = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        for row, state in found:
            features += np.bincount(row, minlength=len(counts))
            # whole numbers below 2 ** 53 add up exactly
            weight += np.bincount(row, gain[state % len(gain)], minlength=len(counts)).astype(np.int64)
        return counts, features, weight

    return common.with_columns(df, weighed, ["text"], "n_words long, n_features long, weight long", keep, SLICE_BYTES)


def noise(key: str = "doc_id", seed: int = 42) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(df: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank to ``df`` (doc_id, n_words, score), a table on disk.

    Rows are dealt into ranges of score and id and numbered there; the rows of earlier ranges
    are added from one count per range.
    """
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    dealt = df.where(eligible).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = common.stage(dealt, "ranges").withColumn("__part", F.shiftright("__at", 33)).withColumn("__own", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["__part"], r.n) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one row for each range
    total = sum(n for _, n in sizes)
    before, offsets = 0, []
    for part, n in sizes:
        offsets += [F.lit(part), F.lit(before)]
        before += n
    place = F.create_map(*offsets)[F.col("__part")] + F.col("__own") + 1 if offsets else F.lit(None)
    drawn = dealt.withColumn("__place", place.cast("long"))
    rank = F.when(F.col("__place") <= percent * total // 100, F.col("__place"))
    rest = df.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", rank).select(*df.columns, "rank").unionByName(rest)


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``df`` (doc_id, text), n_words, n_features, weight, score and rank.

    ``rank`` counts the drawn rows from 1, ``percent`` of the rows with at least ``least_words``
    words; it is null for others.  Null and empty texts, and texts without words, have no
    features and weight 0.  A row without doc_id has no score and is not drawn; repeated rows have
    equal scores and are drawn one after the other; an empty target gives every bucket its smoothed
    share; an empty table stays empty.  Kept columns with the names of results give way to them.
    """
    head = shared(df, head_of(df))
    gain = gains(totals(df, head), totals(target, head))
    scored = weights(df, head, gain, [c for c in keep if c.lower() not in ("score", "rank")])
    return ranked(common.stage(scored.withColumn("score", F.col("weight") + noise("doc_id", seed)), "weights"), percent, least_words)


# --- the same in SQL -----------------------------------------------------------------------


def half_byte(x: int) -> int:
    """Four steps of CRC-32 (reflected polynomial)."""
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def _sql() -> str:
    table = ", ".join(str(half_byte(i)) for i in range(16))
    half = lambda x: f"xor(({x}) >> 4, list_extract([{table}], (({x}) & 15) + 1))"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words_ = f"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
    runs_ = (
        "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), "
        "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS x"
    )
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS id, doc_id, {words_} FROM documents
    ), b AS (
        SELECT {words_} FROM benchmark
    ), f AS (
        SELECT id, {runs_} FROM d UNION ALL SELECT 0, {runs_} FROM b
    ), c AS (
        SELECT id, x, count(*) AS n FROM f GROUP BY ALL
    ), k AS (
        SELECT x, xor(list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(x)), lambda i: CAST('0x' || substring(hex(encode(x)), 2 * i + 1, 2) AS BIGINT))),
            lambda a, b: {half(half("xor(a, b)"))}
        ), 4294967295) % {BUCKETS} AS bucket
        FROM (SELECT DISTINCT x FROM c)
    ), e AS (
        SELECT c.id, bucket, sum(n) AS n FROM c JOIN k USING (x) GROUP BY ALL
    ), s AS (
        SELECT bucket, CAST(coalesce(sum(n) FILTER (id > 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (id = 0), 0) AS DOUBLE) AS t FROM e GROUP BY bucket
    ), a AS (
        SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM s
    ), g AS (
        SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS gain FROM s, a
    ), w AS (
        SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_features, CAST(coalesce(sum(n * gain), 0) AS BIGINT) AS weight
        FROM d LEFT JOIN (SELECT e.id, n, gain FROM e JOIN g USING (bucket)) h ON h.id = d.id GROUP BY d.id, d.doc_id, len(d.w)
    ), v AS (
        SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || doc_id), 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM w
    ), o AS (
        SELECT *, n_words >= {LEAST_WORDS} AND score IS NOT NULL AS able FROM v
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS many FROM o
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * many // 100 THEN place END AS rank FROM r
    """


SQL = _sql()
