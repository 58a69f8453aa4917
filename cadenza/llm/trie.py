"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

Conversations are rebuilt (each takes its first turns from the first of its group), and become
keys of 16 bytes a turn, a digest of role and text; keys that share turns share leading bytes.  Sorted
by key, conversations below one trie node are neighbours, and the number of turns that two
neighbours share is the depth of the node where their paths meet.

*Forests.*  Rows are dealt into ranges of (key, conv_id).  Each bounded batch of a range is a
forest of its own: its neighbour edges are taken in descending depth, union-find merges the
components on both sides, and every merge makes or widens the branching node of that depth.  Nodes
between two branching nodes have one child and are written when the lower component merges.

*Contraction.*  What lies off the paths of a batch's first and last key is complete and leaves the batch.
The nodes on these two paths may go on in other batches: each is contracted to one open item with
what is known of it (members, children, leaves and tokens of finished subtrees).  Open items are keys
themselves, far fewer than conversations; they are sorted and merged by the same forest, round
after round, until one batch holds them all.  A complete child of an open node learns its
parent's smallest member from the last rounds by the parent's digest; the members that end in an
open node travel in pieces, which one task hashes in order without holding them.

A conversation of n turns is a key of 16 n bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadenza.llm import common

GROUP = 5
HEADS = 9
TURN = 16
#: Open items that one last batch merges.
LAST = 20_000
#: Items whose forest is built at once.
ROWS = 2_000
#: Rows of an Arrow batch of results.
WRITTEN = 5_000
PIECE = 4_096
NODE, ORPHAN, ITEM, ENDS = range(4)
NUMBERS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
OUT = f"kind int, {NUMBERS}, ends string, digest binary, parent binary, key binary, sizes array<long>, first long"


# --- rebuilding ----------------------------------------------------------------------------


def rebuilt(messages: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, key, sizes): every conversation with its first h turns from the first one of its group.

    h is the CRC-32 of the decimal conv_id modulo ``heads``.  Turns are ordered by turn, null first; turns
    of one number by a digest of role and text.  ``sizes`` has the UTF-8 bytes of each turn's text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    turns = messages.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))
    turns = common.stage(turns, "turns")
    first = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, heads).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(first, "head", "left").withColumn("h", h)
    empty = F.array().cast(turns.schema["turns"].dataType)
    whole = F.concat(F.slice(F.coalesce("first", empty), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return joined.select("conv_id", whole.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"), F.col("turns.size").alias("sizes")
    )


# --- forests -------------------------------------------------------------------------------


@dataclass
class Component:
    """Neighbours that share ``depth`` turns at least, and what is known of their node at that depth."""

    depth: int
    first: int  # of the items
    least: int | None  # smallest member
    members: int
    children: int
    leaves: int
    saved: int
    open: bool
    ends: list[int] = field(default_factory=list)
    waiting: list[tuple] = field(default_factory=list)  # finished children, without their parent's smallest member
    travelled: bool = False  # some of its ends went ahead in pieces


def shared(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


def digest(key: bytes, depth: int) -> bytes:
    return hashlib.blake2b(key[: depth * TURN], digest_size=16).digest()


def joined(ends: list[int]) -> str:
    return ",".join(map(str, ends))


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Forest:
    """The forest of a sorted batch of items; rows of ``OUT`` gather in ``rows``."""

    def __init__(self, items: list[Component], keys: list[bytes], sizes: list[list[int]], last: bool, named: bool):
        self.items, self.keys, self.sizes, self.last, self.named = items, keys, sizes, last, named
        self.rows: list[tuple] = []

    def grow(self) -> list[tuple]:
        n = len(self.keys)
        edges = [shared(self.keys[i - 1], self.keys[i]) for i in range(1, n)]
        if not self.last:
            self.items[0].open = self.items[-1].open = True
        parent = list(range(n))  # a component's root is its leftmost item
        for i in sorted(range(1, n), key=lambda i: -edges[i - 1]):  # stable: equal depths from left to right
            a, b = i - 1, i
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            depth = edges[i - 1]
            left, right = self.lifted(self.items[a], depth), self.lifted(self.items[b], depth)
            self.items[a] = self.merged(left, right)
            parent[b] = a
        self.finish(self.lifted(self.items[0], 0))
        return self.rows

    @staticmethod
    def merged(a: Component, b: Component) -> Component:
        """Two components of one node as one, the left one's ends before the right one's."""
        a.ends += b.ends
        a.waiting += b.waiting
        return Component(
            a.depth, a.first, smaller(a.least, b.least), a.members + b.members, a.children + b.children, a.leaves + b.leaves, a.saved + b.saved,
            a.open or b.open, a.ends, a.waiting, a.travelled or b.travelled,
        )

    def lifted(self, c: Component, depth: int) -> Component:
        """The component as part of its ancestor at ``depth``; its node and those in between are finished."""
        if c.depth == depth:
            return c
        if c.open:
            self.contract(c)
            return Component(depth, c.first, None, 0, 0, 0, 0, True)
        row = self.finish(c)
        sizes, leaves, saved = self.sizes[c.first], row[6], row[7]
        for d in range(c.depth - 1, depth, -1):  # nodes with one child; each is the parent of the one before
            self.put(row, c.least)
            saved += (c.members - 1) * sizes[d - 1]
            row = (NODE, c.least, d, None, c.members, 1, leaves, saved, hashlib.sha256().hexdigest(), None)
        return Component(depth, c.first, c.least, c.members, 1, leaves, saved, False, [], [row])

    def finish(self, c: Component) -> tuple:
        """The row of a component's node, still without parent; its children get theirs."""
        if c.open and not self.last:
            self.contract(c)
            return ()
        for row in c.waiting:
            self.put(row, c.least)
        leaves = c.leaves if c.children else 1
        saved = c.saved + ((c.members - 1) * self.sizes[c.first][c.depth - 1] if c.depth else 0)
        own = digest(self.keys[c.first], c.depth) if self.named else None
        # ends that went ahead are hashed elsewhere
        ends = None if c.travelled else hashlib.sha256(joined(c.ends).encode()).hexdigest()
        row = (NODE, c.least, c.depth, None, c.members, c.children, leaves, saved, ends, own)
        if not c.depth:
            self.put(row, None)
        return row

    def contract(self, c: Component) -> None:
        """An open component goes on as one item; its finished children wait for the parent's smallest member."""
        key = self.keys[c.first][: c.depth * TURN]
        name = digest(key, c.depth)
        for row in c.waiting:
            self.rows.append((ORPHAN, *row[1:], name, None, None, None))
        for low in range(0, len(c.ends), PIECE):
            own = c.ends[low : low + PIECE]
            self.rows.append((ENDS, *[None] * 7, joined(own), name, None, None, None, own[0]))
        if c.members or c.travelled:
            at = "" if c.ends or c.travelled else None
            self.rows.append((ITEM, c.least, c.depth, None, c.members, c.children, c.leaves, c.saved, at, None, None, key, self.sizes[c.first][: c.depth], None))

    def put(self, row: tuple, parent: int | None) -> None:
        self.rows.append((*row[:3], parent, *row[4:], None, None, None, None))


def forests(last: bool, first_round: bool, rows: int):
    """A function for mapInArrow over sorted items; in the last round all batches are one."""
    schema = to_arrow_schema(T.StructType.fromDDL(OUT))

    def grown(batch: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        if not c["key"]:
            return
        if first_round:
            items = [Component(len(k) // TURN, i, conv, 1, 0, 0, 0, False, [conv]) for i, (k, conv) in enumerate(zip(c["key"], c["conv_id"], strict=True))]
        else:
            own = zip(c["key"], *(c[n] for n in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")), strict=True)
            items = [Component(len(k) // TURN, i, *r[:5], False, travelled=r[5] is not None) for i, (k, *r) in enumerate(own)]
        made = Forest(items, c["key"], c["sizes"], last, not first_round).grow()
        for low in range(0, len(made), WRITTEN):
            columns = zip(*made[low : low + WRITTEN], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        if last:  # bounded by LAST
            held = list(batches)
            if held:
                yield from grown(pa.Table.from_batches(held))
            return
        for batch in batches:
            for part in common.slices(batch, rows=rows):
                yield from grown(part)

    return run


def hashed(pieces: DataFrame) -> DataFrame:
    """(digest, sha): the hash of the members that end in each open node, from their pieces in order.

    A node's pieces go through one task as a stream; the task holds one hash state, not the members.
    """

    def run(batches):
        name, state = None, None
        for batch in batches:
            names, shas = [], []
            for d, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d != name:
                    if name is not None:
                        names.append(name)
                        shas.append(state.hexdigest())
                    name, state = d, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(shas, pa.string())], names=["digest", "sha"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["digest", "sha"])

    ordered = pieces.select("digest", "ends", "first").repartition("digest").sortWithinPartitions("digest", "first")
    return ordered.select("digest", "ends").mapInArrow(run, "digest binary, sha string")


def nodes(conversations: DataFrame, last: int = LAST, rows: int = ROWS) -> DataFrame:
    """One row for every node of the trie of ``conversations`` (conv_id, key, sizes), conv_id being unique.

    Columns as in ``trie``.  Without conversations there is no node.  Rounds end when ``last``
    open items are left, or a round no longer halves them (keys that are prefixes of each other
    throughout).
    """
    order = ["key", "conv_id"]
    keys = common.stage(conversations.select("key", "sizes", "conv_id"), "keys")
    first = common.stage(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(forests(False, True, rows), OUT), "forests")
    found, before, final, merged = first, None, False, None
    while not final:
        items = found.where(F.col("kind") == ITEM).select("key", "sizes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
        left = items.count()
        final = left <= last or (before is not None and 2 * left > before)
        dealt = items.coalesce(1) if final else items.repartitionByRange(*order)
        found = common.stage(dealt.sortWithinPartitions(*order).mapInArrow(forests(final, False, rows), OUT), "forests")
        merged, before = found if merged is None else merged.unionAll(found), left
    shas = hashed(first.where(F.col("kind") == ENDS))
    numbers = [f.name for f in T.StructType.fromDDL(NUMBERS)]
    own = merged.where(F.col("kind").isin(NODE, ORPHAN)).select("kind", *numbers, "ends", "digest", "parent")
    ended = own.where("ends is null").drop("ends").join(shas.withColumnRenamed("sha", "ends"), "digest")
    own = common.stage(own.where("ends is not null").unionByName(ended), "merged")
    # a complete child of an open node: its parent is a merged node with digest
    parents = own.where("digest is not null").select(F.col("digest").alias("parent"), F.col("conv_id").alias("__parent"))
    done = first.where(F.col("kind") == NODE).unionByName(own.where(F.col("kind") == NODE), allowMissingColumns=True)
    orphans = first.where(F.col("kind") == ORPHAN).unionByName(own.where(F.col("kind") == ORPHAN), allowMissingColumns=True)
    known = orphans.join(common.small(parents), "parent").withColumn("parent_conv_id", F.col("__parent"))
    columns = [*numbers, F.col("ends").alias("ends_sha256")]
    return done.select(*columns).unionAll(known.select(*columns))


def trie(messages: DataFrame, group: int = GROUP, heads: int = HEADS, last: int = LAST, rows: int = ROWS) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations of ``messages`` (conv_id, turn, role, text).

    conv_id is the smallest member (a rebuilt conversation that starts with the node's turns),
    depth the number of turns, parent_conv_id the parent's conv_id (the root, at depth 0, has none);
    n_convs, n_children, n_leaves (nodes without children in the subtree) and saved_tokens
    (UTF-8 bytes of texts that members share, summed over the subtree) count;
    ends_sha256 hashes the decimal conv_ids of the members that end in the node, ascending.

    A null role or text is empty; a null turn comes first; rows of one turn are ordered by a digest
    of role and text; repeated rows are repeated turns; rows without conv_id are left out, as are
    other columns; a conversation without turns is a member of the root; an empty table has no node.
    """
    return nodes(rebuilt(messages, group, heads), last, rows)


#: The same rows from prefixes as strings.  A row's ancestors are the beginnings of its prefix.
SQL = """
    WITH tab AS (
        SELECT list(c ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END) AS c
            FROM (SELECT unnest(range(256)) AS i)
        )
    ), ids AS (
        SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL
    ), h AS (
        SELECT conv_id, xor(list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
            lambda a, b: xor(a >> 8, list_extract(tab, (xor(a, b) & 255) + 1))
        ), 4294967295) % 9 AS h
        FROM ids, tab
    ), m AS (
        SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
               md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d
        FROM conversations
    ), t AS (
        SELECT conv_id, d, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS n FROM m
    ), r AS (
        SELECT h.conv_id, 0 AS part, n, d, size FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND n <= h
        UNION ALL
        SELECT h.conv_id, 1 AS part, n, d, size FROM h JOIN t ON t.conv_id = h.conv_id AND n > h
    ), k AS (
        SELECT h.conv_id, coalesce(string_agg(d, '' ORDER BY part, n), '') AS key, list(size ORDER BY part, n) AS sizes, count(d) AS turns
        FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id
    ), p AS (
        SELECT conv_id, turns, sizes, left(key, 32 * depth) AS prefix, depth
        FROM (SELECT *, unnest(range(0, turns + 1)) AS depth FROM k)
    ), node AS (
        SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               (count(*) - 1) * coalesce(any_value(CASE WHEN depth > 0 THEN sizes[depth] END), 0) AS own,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
        FROM p GROUP BY prefix, depth
    ), below AS (
        SELECT left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
    ), counted AS (
        SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN below USING (prefix)
    ), up AS (
        SELECT left(prefix, 32 * above) AS prefix, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
               CAST(sum(own) AS BIGINT) AS saved_tokens
        FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY 1
    )
    SELECT c.conv_id, c.depth, parent.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
    FROM counted c JOIN up USING (prefix)
    LEFT JOIN node parent ON parent.prefix = left(c.prefix, 32 * (c.depth - 1)) AND parent.depth = c.depth - 1
"""
