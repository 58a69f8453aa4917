"""The prefix trie of conversations against plain prefixes, SQL and odd input."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from cadenza.llm import common, queries, trie


def plain_nodes(rows):
    """Every node from the prefixes of all rebuilt conversations; rows are (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, tie), role, text))
    own = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        whole = (*own.get(c - c % 5, [])[:h], *own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()
    )


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("last", "size"), [(20_000, 2_000), (20_000, 3), (6, 4), (1, 2)])
def test_nodes_whatever_the_batches(spark, last, size):
    """Copies, prefixes of each other and shared beginnings; small batches force contraction and several rounds."""
    rng = random.Random(size)
    rows = []
    for c in range(120):
        own = rng.choice([[], ["a"], ["a", "b"], ["a", "b", "c", "d"], ["q"] * 12, list("xyzuvwxyzuvw")]) + rng.choices("abé", k=rng.randint(0, 3)) + (["same"] * 3 if c % 3 else [])
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(own or ["lone"])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(trie.trie(df, last=last, rows=size)) == plain_nodes(rows)


def test_one_large_group_of_copies(spark):
    rows = [(c, i, "user", f"turn {i}") for c in range(0, 4_000, 5) for i in range(4)] + [(4_003, 0, "user", "turn 0")]
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA), rows=100)) == plain_nodes(rows)


def test_pieces_are_hashed_in_order(spark):
    pieces = [(b"n%d" % (i % 3), str(i), i) for i in range(300)]
    found = {bytes(r.digest): r.sha for r in trie.hashed(spark.createDataFrame(pieces, "digest binary, ends string, first long").repartition(7)).collect()}
    assert found == {b"n%d" % k: hashlib.sha256(",".join(str(i) for i in range(k, 300, 3)).encode()).hexdigest() for k in range(3)}


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 5, "user", "é" * 50_000), (1, 5, "user", "é" * 50_000), (1, 5, "tool", ""), (2, 0, "user", None), (None, 0, "user", "lost"), (12, -3, "", "x"), (7, None, "a", "b"), (7, None, "a", "b")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", Depth double")
    assert got(trie.trie(df)) == plain_nodes(rows)
    assert trie.trie(df.limit(0)).count() == 0
    one = [(9, i, "user", str(i)) for i in range(3_000)]  # one long conversation
    assert got(trie.trie(spark.createDataFrame(one, SCHEMA))) == plain_nodes(one)


def test_trie_of_the_table_and_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in common.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = plain_nodes(rows)
    assert got(queries.op13_trie(spark, folder)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in con.sql(trie.SQL).fetchall()) == want
