"""Byte-level BPE against the library, and importance resampling against plain counting."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from cadenza.llm import bpe, common, queries, resample

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names clash with results."""
    rows = [(1, None, 9.0, "x"), (2, "", 1.0, "x"), (3, "Word other, " * 20_000, 1.0, None), (4, "same text", None, "x"), (4, "same text", None, "x"), (None, "no id " * 30, 2.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, Score double, IDS string")


# --- byte-level BPE ------------------------------------------------------------------------


def both_ways(texts, library):
    words = bpe.vocabulary(PATH)
    data, starts = bpe.flat(pa.array(texts, pa.string()))
    ids, offsets, ends = words.encode(data, starts)
    for text, own in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert own.tolist() == library.encode_ordinary(text or ""), repr(text)[:200]
    assert words.decode(ids, offsets, ends) == [(t or "").encode() for t in texts]


def test_ids_of_odd_strings(library):
    both_ways([None, "", " ", "  ", "a", " a", "a ", "'s", "''s", " 's", "'s's", "'sfoo", "'llama", "x'S", "\n\n a\n", "\x1c\x85\xa0  b", "\U000105c0\U0001f600é"], library)
    rng = random.Random(1)
    signs = [*"aZ9 \n\t'strevmld.,!　​''é漢٣\x1c\x85\xa0 \r", "\U0001f600", "\U000105c0", "'s", "'re", "'ll", "don't", " '", "\n\n", "   "]
    for _ in range(40):
        both_ways(["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(200)], library)


def test_long_slices_merge_like_short_ones(library):
    rng = random.Random(2)
    both_ways(["a" * 100_000, "!" * 3_000, " " * 500 + "x", "".join(rng.choices("abcdefgh", k=5_000)), "漢" * 2_000], library)
    words = bpe.vocabulary(PATH)
    for _ in range(300):
        piece = "".join(rng.choices("abenrst é", k=rng.randint(2, 60))).encode()
        assert words.merged(piece) == words.merged_by_heap(piece)


def test_states_compose_in_any_order():
    inside, opening, after, state, _ = bpe.automaton()
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 8, 1_000)
    functions = inside[symbols]
    functions[::97] = opening[symbols[::97]]
    now, want = bpe.START, []
    for i, x in enumerate(symbols.tolist()):
        now = bpe.step(bpe.START if i % 97 == 0 else now, x)[0]
        want.append(now)
    assert state[bpe.scanned(functions, after)].tolist() == want


def test_bpe_of_the_table(spark, small, library):
    got = {r.doc_id: r for r in queries.op11_bpe(spark, small).collect()}
    rows = common.table(spark, small, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        own = got[r.doc_id]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_of_odd_rows(odd, library):
    got = bpe.encode(odd, PATH)
    assert [c for c in got.columns if c.lower() == "ids"] == ["ids"] and got.count() == 6
    for r in bpe.decode(got, PATH).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
        assert [bytes(r.bytes)[o : o + 3] for o in r.offsets[:5]] == [(r.text or "").encode()[o : o + 3] for o in r.offsets[:5]]
    assert bpe.decode(bpe.encode(odd.limit(0), PATH), PATH).count() == 0
    both = bpe.encode(odd, PATH, ["doc_id"], decoded=True).collect()
    assert sorted(bytes(r.bytes) for r in both) == sorted((r.text or "").encode() for r in odd.collect())
    nothing = odd.selectExpr("doc_id", "cast(null as array<int>) ids", "cast(null as array<int>) offsets")
    assert all(bytes(r.bytes) == b"" for r in bpe.decode(nothing, PATH).collect())


# --- importance resampling -----------------------------------------------------------------

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain_draw(documents, benchmark):
    """{doc_id: (n_features, weight, score, rank)} by counting everything in the driver."""
    found = {i: plain_features(t) for i, t in documents}
    s, t = Counter(), Counter()
    for _, own in found.values():
        s.update(own)
    for text in benchmark:
        t.update(plain_features(text)[1])
    many, more = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (many + 10_000) / ((s[b] + 1) * (more + 10_000)))) for b in range(10_000)]
    rows = {}
    for i, (_, own) in found.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in own.items())
        rows[i] = [sum(own.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, (n, _) in found.items() if n >= 20), key=lambda i: (-rows[i][2], i))
    for rank, i in enumerate(able[: 5 * len(able) // 100], 1):
        rows[i][3] = rank
    return {i: tuple(r) for i, r in rows.items()}


def test_states_carry_over_words():
    rng = random.Random(3)
    parts = [(rng.randbytes(rng.randint(1, 300)), rng.randbytes(rng.randint(1, 300))) for _ in range(200)]
    state, size, following = (np.array(x) for x in zip(*((zlib.crc32(a), len(b), zlib.crc32(b)) for a, b in parts), strict=True))
    assert resample.carried(state.astype(np.uint32), size, following.astype(np.uint32)).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_head_and_tail_give_the_same_buckets():
    texts = ["the quick Brown the quick", "", "a", "é-x é x", "the the the", "x" * 500 + " y", "one two three four"]
    heads = [resample.Head.of([], []), resample.Head.of([b"the", b"quick", b"x"], [(b"the", b"quick"), (b"the", b"the")]), resample.Head.of([b"a"], [])]
    for head in heads:
        counts, found = resample.runs(texts, head)
        for i, text in enumerate(texts):
            own = Counter(x for row, state in found for x in (state[row == i] % 10_000).tolist())
            assert (counts[i], own) == plain_features(text)


def test_resampling_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in common.table(spark, folder, "documents").collect()]
    want = plain_draw(rows, [r.text for r in common.table(spark, folder, "benchmark").collect()])
    got = queries.op12_resample(spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(resample.SQL).fetchall()} == want
    assert [r.rank for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == list(range(1, sum(r.rank is not None for r in got) + 1))


def test_head_holds_what_recurs(spark):
    texts = [("common pair here",)] * 50 + [(f"rare{i} word{i}",) for i in range(200)]
    head = resample.head_of(spark.createDataFrame(texts, "text string").coalesce(1))
    assert set(head.number) == {b"common", b"pair", b"here"} and len(head.pair) == 2
    assert len(resample.head_of(spark.createDataFrame(texts, "text string").coalesce(1), 2, 1).number) == 2


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, "word other"), (2, None)], "item_id long, text string")
    got = resample.resample(odd, target, percent=100, least_words=1, keep=("doc_id", "Score")).collect()
    assert len(got) == 6 and sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    by = {r.doc_id: r for r in got}
    assert (by[1].n_features, by[1].weight, by[2].weight) == (0, 0, 0) and by[None].score is None and by[None].rank is None
    assert by[1].score is not None and by[3].n_features == 3 * 40_000 - 3
    assert resample.resample(odd.limit(0), target).count() == 0
    assert all(r.rank is None for r in resample.resample(odd, target.limit(0)).collect() if r.doc_id in (1, 2, 4))
