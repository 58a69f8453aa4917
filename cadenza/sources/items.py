"""Items of JSON arrays in documents of any size and layout.

A document is a file, or all files of one ``recording_id=`` folder in the order of their names (as
the writers leave it: parts of one document, or several documents one after the other).  Its
text may be spread over lines or stand on one; no task holds more than slices of it.

Spark's text reader cuts the bytes after every closing brace, also inside files that it splits.  The
pieces are put into slices of about a megabyte by their place in the document.  What a slice means
depends on all before it, but only through little: whether it begins inside a string (the
quotes before it, modulo two), how deep in brackets (the sum of steps), and the keys of the
containers that are open around it.  Each of these is one small row per slice, carried over as in
``timeline``; then all slices find their items at once.  An item that crosses slices is put
together from its parts.

Packed documents (``writers.write_packed``) come as lines and go through the same slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.timeline import KEY, SLICE, beside, carry, numbered, running, settle, with_facts, with_slice

DOC = "doc"
SLICE_BYTES = 1 << 20
#: Items of a line table whose lengths are added up together.
LINES = 1024
#: Places in a slice; an item is named by slice and place of its first brace.
PLACES = 1 << 32
ITEM, PART, OPEN, RECORDING, FOUND = range(5)
NAMED = re.compile(rb'"((?:[^"\\]|\\.)*)"[ \t\r\n]*:[ \t\r\n]*\Z')
RECORDED = re.compile(rb'"recording_id"[ \t\r\n]*:[ \t\r\n]*"?([0-9]{1,18})')


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(doc, file, folder, size, block, row, value): the text below ``path``, cut after each closing brace; on disk."""
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"^(.*/recording_id=[^/]*)/[^/]*$", 1)
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.when(folder != "", folder).otherwise(file).alias(DOC),
        file.alias("file"),
        F.regexp_extract(folder, "recording_id=(-?[0-9]{1,18})$", 1).alias("folder"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    return settle(rows)


def slices(pieces: DataFrame) -> DataFrame:
    """(doc, slice, text): the documents of ``fragments`` in slices, each with its whole text; on disk."""
    length = F.octet_length("value").cast("bigint") + 1
    files = pieces.groupBy(DOC, "file", "size").agg(F.sum(length).alias("total"), F.max(F.struct("block", "row")).alias("last"))
    earlier = Window.partitionBy(DOC).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # a last piece without brace is told by the file's size; the reader leaves out a byte order mark
    bare = F.when((F.col("total") - F.col("size")).isin(1, -2), F.col("last"))
    files = files.select("file", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"), bare.alias("bare"))
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.col("block") + F.coalesce(F.sum(length).over(before), F.lit(0))).join(files, "file")
    ended = F.coalesce(F.struct("block", "row") == F.col("bare"), F.lit(False))
    text = F.when(ended, F.col("value")).otherwise(F.concat("value", F.lit("}")))
    cut = with_slice(placed.select(DOC, (F.col("base") + F.col("at")).alias("at"), "file", "row", text.alias("text")), "at", SLICE_BYTES)
    ordered = F.array_sort(F.collect_list(F.struct("at", "file", "row", "text")))
    return settle(cut.groupBy(DOC, SLICE).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text")))


def line_slices(lines: DataFrame) -> DataFrame:
    """(doc, slice, text): the documents of a line table in slices, as ``slices`` makes them from files; on disk."""
    place = F.expr(f"section * {1 << 40}L + item").alias("place")
    rows = with_slice(lines.select(KEY, place, "sub", "line"), "place", LINES)
    placed = running(rows, F.octet_length("line").cast("bigint") + 1, ["place", "sub"], "at").drop(SLICE)
    cut = with_slice(placed.withColumn("at", F.coalesce("at", F.lit(0))), "at", SLICE_BYTES)
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    text = F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n"))
    return settle(cut.groupBy(KEY, SLICE).agg(text.alias("text")).select(packed_name(KEY).alias(DOC), SLICE, "text"))


def packed_name(key: str) -> Column:
    return F.concat(F.lit("recording_id="), F.col(key).cast("string"))


# --- one slice -----------------------------------------------------------------------------


def brackets(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside strings, and the depth after each, from 0 at the beginning."""
    a = np.frombuffer(text, np.uint8)
    escaped = np.zeros(len(a) + 1, bool)
    slash = np.flatnonzero(a == 92)
    if len(slash):
        first = np.r_[True, np.diff(slash) > 1]
        begin = slash[np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))]
        odd = (slash - begin) % 2 == 0  # first, third, ... of its run: the next character is escaped
        escaped[slash[odd] + 1] = True
    quote = (a == 34) & ~escaped[:-1]
    outside = (np.cumsum(quote) + inside) % 2 == 0
    step = np.where((a == 123) | (a == 91), 1, 0) - np.where((a == 125) | (a == 93), 1, 0)
    place = np.flatnonzero((step != 0) & outside)
    return place, np.cumsum(step[place])


def container(text: bytes, place: int) -> str:
    """The bracket at ``place`` and the key before it, if it has one."""
    key = NAMED.search(text[max(0, place - 300) : place])
    return chr(text[place]) + (key[1].decode("utf-8", "replace") if key else "")


def summary(text: bytes, inside: bool) -> tuple[int, dict[int, str]]:
    """How many brackets stay open, and for each depth the container that was opened there last."""
    place, depth = brackets(text, inside)
    opened = {}
    opening = np.isin(np.frombuffer(text, np.uint8)[place], (123, 91))
    for d in np.unique(depth[opening]).tolist():
        opened[d] = container(text, int(place[opening & (depth == d)][-1]))
    return int(depth[-1]) if len(depth) else 0, opened


def found(text: bytes, inside: bool, depth: int, two: str, three: str, paths: Sequence[tuple[str, ...]]) -> Iterator[tuple]:
    """(kind, place, text) of items and parts of items, of the recording and of wanted arrays in one slice.

    ``two`` and ``three`` are the containers open at depth 2 and 3 (the document's own is 1).
    """
    singles = {"[" + p[0] for p in paths if len(p) == 1}
    doubles = {("{" + p[0], "[" + p[1]) for p in paths if len(p) == 2}

    def wanted() -> int:
        return 2 if two in singles else 3 if (two, three) in doubles else 0

    place, after = brackets(text, inside)
    after = after + depth
    level = wanted()
    begin = None if level and depth > level else -1  # of the open item: None if it began before the slice, -1 without one
    low = np.flatnonzero(after <= 4)
    previous = np.append(depth, after)[low]
    for p, now, was in zip(place[low].tolist(), after[low].tolist(), previous.tolist(), strict=True):
        level = wanted()
        if now > was:
            if level and was == level:
                begin = p
            elif now == 2:
                two, three = container(text, p), ""
                if wanted():
                    yield FOUND, p, b""
            elif now == 3 and not (level == 2):
                three = container(text, p)
                if wanted():
                    yield FOUND, p, b""
        elif level and now == level and begin != -1:
            yield (PART, 0, text[: p + 1]) if begin is None else (ITEM, begin, text[begin : p + 1])
            begin = -1
        elif now < 2:
            two = three = ""
        elif now < 3 and level != 2:
            three = ""
    if begin is None:
        yield PART, 0, text
    elif begin >= 0:
        yield PART, begin, text[begin:]
    # null: the item that was open before the slice is still open
    yield OPEN, begin, b""
    for m in RECORDED.finditer(text):
        at = int(np.searchsorted(place, m.start()))
        if (int(after[at - 1]) if at else depth) == 1:
            yield RECORDING, int(m[1]), b""


# --- documents -----------------------------------------------------------------------------


def array_items(spark: SparkSession, path: str, paths: Sequence[tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Items of the arrays under one of ``paths`` (one or two keys) in the documents below ``path``, and the documents.

    Items: (doc, recording_id, item, text), numbered from 0 in each document.  recording_id is the
    folder's, else the one that the document names, else the file's name or a hash of it if
    the name is no number.  Documents: (doc, recording_id, length, balanced, found).
    """
    pieces = fragments(spark, path)
    return sliced_items(slices(pieces), pieces.groupBy(DOC).agg(F.max("folder").alias("folder")), paths)


def line_items(lines: DataFrame, paths: Sequence[tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """``array_items`` of the documents of a line table (recording_id, section, item, sub, line) on disk."""
    cut = line_slices(lines)
    folders = cut.select(DOC, F.substring_index(DOC, "=", -1).alias("folder")).distinct()
    return sliced_items(cut, folders, paths)


def sliced_items(cut: DataFrame, folders: DataFrame, paths: Sequence[tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """``array_items`` from (doc, slice, text) on disk and (doc, folder)."""
    quotes = F.regexp_count(F.regexp_replace("text", r"(?s)\\.", ""), F.lit('"')).cast("bigint")
    counted = settle(cut.select(DOC, SLICE, F.octet_length("text").cast("bigint").alias("bytes"), quotes.alias("quotes")))
    entered = beside(cut, carry(counted, "quotes", "sum", "inside", [DOC]), [DOC])

    def summarised(batches):
        for batch in batches:
            rows = []
            for text, inside in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows.append(summary(text.encode(), bool(inside % 2)))
            opened = pa.array([list(r[1].items()) for r in rows], pa.map_(pa.int32(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([r[0] for r in rows], pa.int64()), opened], names=[DOC, SLICE, "inside", "steps", "opened"])

    entered = entered.select(DOC, SLICE, "text", "inside")
    deep = settle(entered.mapInArrow(summarised, f"{DOC} string, {SLICE} bigint, inside bigint, steps bigint, opened map<int,string>"))
    depth = settle(beside(deep, carry(deep, "steps", "sum", "depth", [DOC]), [DOC]))
    at = lambda d: F.element_at("opened", (F.lit(d) - F.col("depth")).cast("int"))
    known = depth.select(DOC, SLICE, at(2).alias("two"), at(3).alias("three"))
    states = beside(depth.select(DOC, SLICE, "inside", "depth"), carry(known, "two", "last", "two", [DOC]), [DOC])
    states = beside(states, carry(known, "three", "last", "three", [DOC]), [DOC])

    def searched(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, number, text, inside, depth, two, three = (c[i].as_py() for c in batch.columns)
                rows = list(found(text.encode(), bool(inside % 2), depth, two or "", three or "", paths))
                kinds, places, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(rows)), pa.array([number] * len(rows), pa.int64()), pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array(range(len(rows)), pa.int32())],
                    names=[DOC, SLICE, "kind", "place", "text", "nth"],
                )

    given = beside(cut, states, [DOC]).select(DOC, SLICE, "text", "inside", "depth", "two", "three")
    hits = settle(given.mapInArrow(searched, f"{DOC} string, {SLICE} bigint, kind int, place bigint, text string, nth int"))
    name = F.col(SLICE) * PLACES + F.col("place")
    whole = hits.where(F.col("kind") == ITEM).select(DOC, name.alias("begin"), "text")
    # parts of items that cross slices: what an earlier slice left open names the item
    left = hits.where(F.col("kind") == OPEN).select(DOC, SLICE, F.when(F.col("place") == -1, F.lit(-1)).otherwise(name).alias("begin"))
    carried = carry(left, "begin", "last", "open", [DOC])
    parts = hits.where(F.col("kind") == PART)
    later = (F.col("nth") == 0) & (F.col("place") == 0) & (F.col("depth") > 0)
    parts = beside(beside(parts, carried, [DOC]), depth.select(DOC, SLICE, "depth"), [DOC])
    begin = F.when(later & (F.col("open") >= 0), F.col("open")).otherwise(name)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(SLICE, "text"))), lambda x: x["text"]), "")
    crossing = parts.withColumn("begin", begin).groupBy(DOC, "begin").agg(joined.alias("text"))
    listed = numbered(with_slice(whole.unionByName(crossing), "begin", PLACES), ["begin"], "item", [DOC])
    said = hits.where(F.col("kind").isin(RECORDING, FOUND)).groupBy(DOC).agg(
        F.max(F.when(F.col("kind") == RECORDING, F.col("place"))).alias("said"), F.max((F.col("kind") == FOUND).cast("int")).alias("found")
    )
    totals = counted.groupBy(DOC).agg(F.sum("bytes").alias("length"), F.sum("quotes").alias("quotes"), F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi"))
    steps = depth.groupBy(DOC).agg(F.sum("steps").alias("steps"))
    stem = F.regexp_extract(DOC, r"([^/]*?)(?:\.[^./]*)?$", 1)
    own = F.when(stem.rlike(r"^[0-9]{1,18}$"), stem.try_cast("bigint")).otherwise(F.xxhash64(stem))
    recording = F.coalesce(F.col("folder").try_cast("bigint"), "said", own)
    documents = totals.join(steps, DOC).join(folders, DOC).join(said, DOC, "left").select(
        DOC, recording.alias(KEY), "length", ((F.col("quotes") % 2 == 0) & (F.col("steps") == 0) & (F.col("length") > 0)).alias("balanced"), (F.coalesce("found", F.lit(0)) == 1).alias("found"), "_lo", "_hi"
    )
    documents = settle(documents)
    items = with_facts(listed, documents.select(DOC, KEY, "_lo", "_hi"), SLICE, "_lo", "_hi", 4096, [DOC])
    return items.select(DOC, KEY, "item", "text"), documents.drop("_lo", "_hi")
