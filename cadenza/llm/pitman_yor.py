"""Language-model scores from a hierarchical Pitman-Yor model with Gibbs-sampled seating.

Tokens are lower-cased words and a closing token.  The context of a token is the word
before it, whichever that is (the empty word at the beginning); every such word has a restaurant.
All of them share a parent restaurant with a parent of its own, which draws from a
uniform base over the training tokens' types and one place for all unknown words (the event
space of the base score, so that the two are comparable).

*Training.*  Spark counts the pairs of neighbouring words over all training texts, words being known by 64-bit
hashes.  A pair seen once has one table; in a Gibbs sweep the others sample their numbers of
tables given the parent's predictive probability, and the tables of each word, added up, are its customers in the
parent, where its tables are sampled in turn.  A sweep joins the pairs with one row for each of their words and
collects nothing but totals.  Customers of one dish come one by one at first and then in blocks
that grow with the crowd.  Discounts come from the numbers of dishes with one and two customers.

*Scoring.*  Predictive probabilities are averaged over the samples after the burn-in.  The most
frequent words and pairs, a bounded number, are looked up in the tasks; all others meet their
numbers in joins on hashes, where no key is hot because none of them is frequent.  A bitmap of fixed size
names the pairs that may have been seen twice: any other pair of a training text was seen once and needs no join.

``frequent``, ``counts`` and ``trained`` are the same model for a given list of contexts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import common

CONTEXTS = 12
STRENGTH = 1.0
BURN_IN = 1
SAMPLES = 2
HEAD = 200_000
PAIRS_A_WORD = 5
BITS = 1 << 27
FLUSH = 300_000
SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: str) -> list[bytes]:
    """Words of a text and the closing token, which is the empty word."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    words.append(b"")
    return words


def contexts(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Context of every token: 1 + number of the latest frequent word before it, or 0."""
    own = np.array([number.get(w, -1) for w in words], np.int64)
    last = np.maximum.accumulate(np.where(own >= 0, np.arange(len(own)), -1))
    before = np.concatenate([[-1], last[:-1]])
    return np.where(before >= 0, own[before] + 1, 0)


# --- counting ------------------------------------------------------------------------------


def frequent(df: DataFrame, n: int = CONTEXTS) -> list[bytes]:
    """The ``n`` most frequent words of all texts of ``df``."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py() or "")[:-1])
                if len(seen) > FLUSH:
                    yield rows()
        if seen:
            yield rows()

    counted = df.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return [bytes(r.word) for r in counted.orderBy(F.desc("c"), "word").limit(n).collect()]


def counts(df: DataFrame, chosen: list[bytes]) -> DataFrame:
    """(word, c): for every token type of ``df`` how often it occurs in each context."""
    width = len(chosen) + 1

    def run(batches):
        number = {w: i for i, w in enumerate(chosen)}
        seen: list[Counter] = [Counter() for _ in range(width)]

        def rows():
            words = [w for one in seen for w in one]
            k = np.repeat(np.arange(width, dtype=np.int32), [len(one) for one in seen])
            n = [x for one in seen for x in one.values()]
            for one in seen:
                one.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(k), pa.array(n, pa.int64())], names=["word", "k", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py() or "")
                context = contexts(words, number)
                for k in np.unique(context).tolist():
                    seen[k].update(compress(words, (context == k).tolist()))
                if sum(map(len, seen)) > FLUSH:
                    yield rows()
        yield rows()

    found = df.select("text").mapInArrow(run, "word binary, k int, n long")
    each = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(width)]
    return found.groupBy("word").agg(*each).select("word", F.array(*[F.col(f"c{k}") for k in range(width)]).alias("c"))


# --- Gibbs sweeps --------------------------------------------------------------------------


def discount(one: float, two: float) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def seated(customers: np.ndarray, opening: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Samples the number of tables of each dish.

    ``opening`` is (strength + discount * tables of the restaurant) * probability under the parent.
    """
    own = np.minimum(customers, 1)
    at = 1
    left = np.flatnonzero(customers > at)
    while len(left):
        step = max(1, at // 8)
        block = np.minimum(step, customers[left] - at)
        new = opening[left] / (opening[left] + at - d * own[left])
        own[left] += rng.binomial(block, np.clip(new, 0, 1))
        at += step
        left = left[customers[left] > at]
    return own


@dataclass
class Totals:
    """What the types share: customers and tables of every restaurant, discounts, number of types."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    d: float
    parent_d: float
    types: int

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability in the parent restaurant of dishes with these customers and tables."""
        new = (STRENGTH + self.parent_d * self.parent_tables) / (self.types + 1)
        return (customers - self.parent_d * tables + new) / (STRENGTH + self.parent_customers)

    def context(self, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Predictive probability in each context (columns)."""
        new = (STRENGTH + self.d * self.tables) * parent[:, None]
        return (customers - self.d * tables + new) / (STRENGTH + self.customers)

    def unknown(self) -> np.ndarray:
        """Predictive probability of an unknown word in each context."""
        zero = np.zeros((1, len(self.customers)))
        return self.context(zero, zero, self.parent(np.zeros(1), np.zeros(1)))[0]


def added(state: DataFrame, width: int, alone: int = 0) -> Totals:
    """Totals over all types of ``state`` (word, c, t, own) and ``alone`` more with one customer in the first restaurant."""
    parts = [F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(width)] + [F.sum(F.col("t")[k]).alias(f"t{k}") for k in range(width)]
    holding = lambda n: F.sum(F.size(F.filter("c", lambda x: x == n))).alias(f"n{n}")  # noqa: E731  (a second argument would be the index)
    small = [holding(1), holding(2)]
    served = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x)
    r = state.agg(
        *parts, *small, F.sum("own").alias("own"), F.count("*").alias("types"),
        F.count(F.when(served == 1, 1)).alias("one"), F.count(F.when(served == 2, 1)).alias("two"),
    ).first()
    c = np.array([r[f"c{k}"] or 0 for k in range(width)], float)
    t = np.array([r[f"t{k}"] or 0 for k in range(width)], float)
    c[0] += alone
    t[0] += alone
    d, parent_d = discount((r.n1 or 0) + alone, r.n2 or 0), discount(r.one + alone, r.two)
    return Totals(c, t, t.sum(), float((r.own or 0) + alone), d, parent_d, r.types + alone)


def matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def arrays(m: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def sweep(state: DataFrame, now: Totals, seed: int | None, keep: bool) -> DataFrame:
    """Adds the predictive probabilities of the seating to ``p`` with ``keep``; then reseats every type if there is a seed."""
    width = len(now.customers)

    def run(batches):
        rng = np.random.default_rng([SEED, seed or 0, TaskContext.get().partitionId()])
        for batch in batches:
            c, t, p = (matrix(batch.column(i), width) for i in (1, 2, 4))
            own = batch.column(3).to_numpy()
            parent = now.parent(t.sum(axis=1), own)
            if keep:
                p = p + now.context(c, t, parent)
            if seed is not None:
                opening = (STRENGTH + now.d * now.tables) * parent[:, None]
                t = seated(c.ravel(), opening.ravel(), now.d, rng).reshape(c.shape)
                served = t.sum(axis=1)
                new = np.full(len(served), (STRENGTH + now.parent_d * now.parent_tables) / (now.types + 1))
                own = seated(served, new, now.parent_d, rng)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), arrays(t, pa.int64()), pa.array(own), arrays(p, pa.float64())], names=["word", "c", "t", "own", "p"])

    return state.mapInArrow(run, state.schema)


def trained(words: DataFrame, width: int) -> tuple[DataFrame, np.ndarray, int, int]:
    """(word, c, p): averaged predictive probabilities by context; those of unknown words; numbers of tokens and types.

    ``words`` (word, c) is on disk.
    """
    ones = F.transform("c", lambda x: F.least(x, F.lit(1).cast("long")))
    zeros = F.array_repeat(F.lit(0.0), width)
    state = words.select("word", "c", ones.alias("t"), F.lit(1).cast("long").alias("own"), zeros.alias("p"))
    now = added(state, width)
    tokens_, types = int(now.customers.sum()), now.types
    unknown = np.zeros(width)
    for k in range(BURN_IN + SAMPLES):
        sample = k > BURN_IN  # what comes in is the seating after k sweeps
        unknown += now.unknown() / SAMPLES if sample else 0
        state = common.stage(sweep(state, now, k, sample), "seating")
        now = added(state, width)
    unknown += now.unknown() / SAMPLES
    state = sweep(state, now, None, True)
    return state.select("word", "c", F.transform("p", lambda x: x / SAMPLES).alias("p")), unknown, tokens_, types


# --- a restaurant for every preceding word -----------------------------------------------------


def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of some texts as numbers: hashes of their types, type of each token, type before it, tokens of each text.

    The word before a text's first token is the empty one, as at the end of a text.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, doc = split.flatten(), pc.list_parent_indices(split)
    full = pc.not_equal(flat, "")
    words, doc = flat.filter(full).dictionary_encode(), doc.filter(full).to_numpy()
    types = [w.encode("utf-8", "replace") for w in words.dictionary.to_pylist()] + [b""]
    size = np.bincount(doc, minlength=len(column)) + 1
    ids = np.full(int(size.sum()), len(types) - 1)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(size) - 1] = False
    ids[inside] = words.indices.to_numpy()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in types], np.uint64).astype(np.int64)
    return hashes, ids, np.concatenate([[len(types) - 1], ids[:-1]])[: len(ids)], size


def followers(df: DataFrame) -> DataFrame:
    """(u, w, c): how often the word with hash ``w`` follows the one with hash ``u`` in all texts of ``df``."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                hashes, ids, before, _ = encoded(part.column(0))
                pair, n = np.unique(before * len(hashes) + ids, return_counts=True)
                u, w = np.divmod(pair, len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[u]), pa.array(hashes[w]), pa.array(n, pa.int64())], names=["u", "w", "n"])

    return df.select("text").mapInArrow(run, "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("c"))


def joint() -> Column:
    """One hash of a pair from those of its words, as ``u ^ (w << 1 | w >> 63)``."""
    return F.col("u").bitwiseXOR(F.shiftleft("w", 1).bitwiseOR(F.shiftrightunsigned("w", 63)))


def reseated(pairs: DataFrame, d: float, seed: int) -> DataFrame:
    """New numbers of tables ``t`` of pairs (u, w, c, s, opening); ``s``, their sum over the samples, is kept."""

    def run(batches):
        rng = np.random.default_rng([SEED, 1_000 + seed, TaskContext.get().partitionId()])
        for batch in batches:
            t = seated(batch.column(2).to_numpy(), batch.column(4).to_numpy(), d, rng)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(t), batch.column(3)], names=["u", "w", "c", "t", "s"])

    return pairs.select("u", "w", "c", "s", "opening").sortWithinPartitions("u", "w").mapInArrow(run, "u long, w long, c long, t long, s long")


def learned(pairs: DataFrame) -> tuple[DataFrame, DataFrame, float, list[float], int, int]:
    """(word, c, lp) of every type, (pair, c, m) of the pairs seen more than once, ``m`` of those seen once,
    sampled probabilities of unknown words, numbers of tokens and types.

    ``lp`` holds for each sample the word's probability in the shared restaurant and, as a context, its
    weight for new tables; ``m`` is what a pair's customers keep: p(w | u) = (m + mean of weight * probability) /
    (STRENGTH + c of u).  A pair seen once has one table, and so has a type seen once, with one pair behind and one
    ahead; only the others are sampled and kept from sweep to sweep.  ``pairs`` is on disk.
    """
    once = F.count(F.when(F.col("c") == 1, 1))
    r = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), once.alias("one"), F.count(F.when(F.col("c") == 2, 1)).alias("two")).first()
    d = discount(r.one, r.two)
    types = pairs.groupBy(F.col("w").alias("word")).agg(F.sum("c").alias("c"), once.alias("follows"))
    leads = pairs.groupBy(F.col("u").alias("word")).agg(once.alias("leads"))
    counted = common.stage(types.join(leads, "word"), "types")
    types = counted.where("c > 1").withColumn("lp", F.array().cast("array<double>"))
    again = common.stage(pairs.where("c > 1").withColumns({"t": F.lit(1).cast("long"), "s": F.lit(0).cast("long")}), "pairs")
    of = counted.agg(F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("alone")).first()
    state, now, unknown, v, alone, lp_alone = None, None, [], of.v, of.alone, []
    for k in range(BURN_IN + SAMPLES):
        behind = again.groupBy(F.col("w").alias("word")).agg(F.sum("t").alias("_t"))
        ahead = again.groupBy(F.col("u").alias("word")).agg(F.sum("t").alias("_l"))
        c = F.array(F.col("follows") + F.coalesce("_t", F.lit(0)))
        one = F.lit(1).cast("long")
        fed = types.select("word", "follows").join(behind, "word", "left").select("word", c.alias("c"))
        if state is None:
            fed = fed.withColumns({"t": F.array(one), "own": one})
        else:
            fed = fed.join(state.select("word", F.col("t").alias("_t"), "own"), "word")
            fed = fed.select("word", "c", F.array(F.least(F.col("_t")[0], F.col("c")[0])).alias("t"), "own")
        fed = common.stage(fed.withColumn("p", F.array(F.lit(0.0))), "fed")
        now = added(fed, 1, alone)
        state = common.stage(sweep(fed.sortWithinPartitions("word"), now, k, False), "seating")
        now = added(state, 1, alone)
        weight = F.lit(STRENGTH) + F.lit(d) * (F.col("leads") + F.coalesce("_l", F.lit(0)))
        sample = k >= BURN_IN
        shared = sweep(state, now, None, True).select("word", F.col("p")[0].alias("p"))
        rows = types.join(shared, "word").join(ahead, "word", "left").withColumn("weight", weight)
        lp = F.concat("lp", F.array("p", "weight")) if sample else F.col("lp")
        rows = common.stage(rows.select("word", "c", "follows", "leads", lp.alias("lp"), "p", "weight"), "types")
        types = rows.drop("p", "weight")
        if sample:
            unknown.append(float(now.unknown()[0]))
            one_row = np.ones((1, 1))
            lp_alone += [float(now.context(one_row, one_row, now.parent(np.ones(1), np.ones(1)))[0, 0]), STRENGTH + d]
            again = again.withColumn("s", F.col("s") + F.col("t"))
        if k + 1 < BURN_IN + SAMPLES:
            met = again.join(rows.select(F.col("word").alias("w"), "p"), "w").join(rows.select(F.col("word").alias("u"), "weight"), "u")
            again = common.stage(reseated(met.withColumn("opening", F.col("weight") * F.col("p")), d, k), "pairs")
    kept = again.select(joint().alias("pair"), "c", (F.col("c") - F.lit(d / SAMPLES) * F.col("s")).alias("m"))
    once_seen = counted.where("c = 1").select("word", "c", F.array(*map(F.lit, lp_alone)).alias("lp"))
    return types.select("word", "c", "lp").unionByName(once_seen), kept, 1 - d, unknown, int(r.n), v


# --- scoring -------------------------------------------------------------------------------


def most(table: DataFrame, rows: int) -> pa.Table:
    """The rows of ``table`` with the largest ``c``, at most ``rows``, ordered by the first column.

    Rows of one count are taken together or not at all, so that no sort is needed.
    """
    cut, taken = None, 0
    for r in table.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(rows).collect():
        taken += r.n
        if taken > rows:
            break
        cut = r.c
    return table.where(F.col("c") >= cut if cut is not None else F.lit(False)).toArrow().sort_by(table.columns[0]).combine_chunks()


def place(top: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in the ordered ``top``; its length where it is missing."""
    at = np.searchsorted(top, hashes)
    at[np.append(top, 0)[at] != hashes] = len(top)
    return at


def marked(df: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` bits with those of the hashes in the only column of ``df`` set, whatever their number."""
    bit = F.pmod(F.col(df.columns[0]), F.lit(BITS)) + 1
    parts = df.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for k, bits in zip(parts["k"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[k - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those marked; False is certain."""
    at = hashes & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def asked_for(df: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows of ``df`` (pair) that may be among those marked."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(among(shared.value, batch.column(0).to_numpy())))

    return df.mapInArrow(run, df.schema)


def looked_up(prices: DataFrame, width: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, base, counts and numbers of the most frequent words, at most ``head`` of them; a row of zeros follows."""
    top = most(prices.select("word", "base", "c", "lp"), head)
    base, c, table = np.zeros(len(top) + 1), np.zeros(len(top) + 1), np.zeros((len(top) + 1, width))
    if len(top):
        base[:-1], c[:-1] = top["base"].to_numpy(), top["c"].to_numpy()
        table[:-1] = matrix(top["lp"].chunk(0), width)
    return top["word"].to_numpy().astype(np.int64), base, c, table


def score(df: DataFrame, train: str = "train", head: int = HEAD) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row of ``df`` (doc_id, text, train).

    The model learns from the rows where ``train`` holds (null: not) and scores all rows, whole.
    Null and empty texts are the closing token alone.  Repeated rows count and are scored each.
    Without training rows every token is unknown.  Other columns are left out; an empty table
    stays empty.
    """
    df = df.select("doc_id", "text", F.coalesce(F.col(train), F.lit(False)).alias("train"))
    # in order of the first word they take less room
    counted = common.stage(followers(df.where("train")).sortWithinPartitions("u"), "followers")
    types, kept, m_once, unknown, n, v = learned(counted)
    width = 2 * SAMPLES
    base = F.log10((F.col("c") + 1) / F.lit(float(n + 1 * (v + 1))))
    prices = common.stage(types.select("word", "c", "lp", base.alias("base")), "prices")
    pairs = most(kept.select("pair", "c", "m"), PAIRS_A_WORD * head)
    # a training text's pair that was not seen twice was seen once: what is surely not repeated need not be looked for
    repeated = marked(kept.select("pair"))
    shared = df.sparkSession.sparkContext.broadcast((*looked_up(prices, width, head), pairs["pair"].to_numpy(), np.append(pairs["m"].to_numpy(), 0), repeated))
    schema = T.StructType(
        [T.StructField("key", T.LongType()), df.schema["doc_id"], df.schema["train"]]
        + T.StructType.fromDDL(
            "n_tokens long, known long, base double, lp double, pair array<long>, n array<int>, lead array<double>, den array<double>, "
            "u array<long>, w array<long>, n_far array<int>, den_far array<double>, u_near array<boolean>, w_near array<boolean>, sure array<boolean>"
        ).fields
        + [T.StructField(f"x{s}", T.ArrayType(T.DoubleType())) for s in range(SAMPLES)]
    )

    def run(batches):
        top, base, c, table, top_pairs, shares, repeated = shared.value
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in common.slices(batch, rows=1_000):
                hashes, ids, before, size = encoded(part.column(1))
                at = place(top, hashes)
                texts = len(size)
                doc = np.repeat(np.arange(texts), size)
                known = np.bincount(doc, at[ids] < len(top), texts).astype(np.int64)
                sums = np.bincount(doc, base[at[ids]], texts)
                pair, times = np.unique((doc * len(hashes) + before) * len(hashes) + ids, return_counts=True)
                pair, w = np.divmod(pair, len(hashes))
                doc, u = np.divmod(pair, len(hashes))
                iu, iw, u, w = at[u], at[w], hashes[u], hashes[w]
                u_near, w_near, den = iu < len(top), iw < len(top), STRENGTH + c[iu]
                # of each sample what is known here: weight * probability, or one of the two
                x = np.where(u_near[:, None], table[iu, 1::2], 1) * np.where(w_near[:, None], table[iw, ::2], 1)
                lead, far = x.mean(axis=1), ~(u_near & w_near)
                pair = u ^ (w << 1 | (w.view(np.uint64) >> np.uint64(63)).view(np.int64))
                share = place(top_pairs, pair)
                listed = share < len(top_pairs)
                sure = np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)[doc] & ~among(repeated, pair)
                m = np.where(sure, m_once, shares[share])
                here = ~far & (listed | sure)
                lp = np.bincount(doc[here], times[here] * np.log10((m[here] + lead[here]) / den[here]), texts).astype(float)  # of no pairs it counts in integers
                keys = key + 1 + np.arange(texts)
                key += texts
                columns = [pa.array(keys), part.column(0), part.column(2), *map(pa.array, (size, known, sums, lp))]
                times = times.astype(np.int32)
                for chosen, of in ((~far & ~here, (pair, times, lead, den)), (far, (u, w, times, den, u_near, w_near, sure, *x.T))):
                    bounds = pa.array(np.searchsorted(doc[chosen], np.arange(texts + 1)), pa.int32())
                    columns += [pa.ListArray.from_arrays(bounds, pa.array(y[chosen])) for y in of]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    read = common.stage(df.mapInArrow(run, schema), "read")
    xs = [f"x{s}" for s in range(SAMPLES)]
    near = read.select("key", "train", F.explode(F.arrays_zip("pair", "n", "lead", "den")).alias("r"))
    near = near.select("key", "train", "r.*", F.lit(False).alias("sure"), F.lit(0).alias("known"), F.lit(0.0).alias("base"))
    far = read.select("key", "train", F.explode(F.arrays_zip("u", "w", F.col("n_far").alias("n"), F.col("den_far").alias("den"), "u_near", "w_near", "sure", *xs)).alias("r"))
    far = far.select("key", "train", "r.*")
    asked = near.where("not train").select("pair").unionByName(far.where("not train").select(joint().alias("pair")))
    once_seen = asked_for(counted.where("c = 1").select(joint().alias("pair")), marked(asked))
    kept = kept.select("pair", "m").unionByName(once_seen.withColumn("m", F.lit(m_once)))
    nothing = F.lit(float(-np.log10(n + 1 * (v + 1))))
    # only rare words meet their numbers by key
    for side in ("w", "u"):
        known = prices.select(F.col("word").alias(side), F.col("c").alias(f"c_{side}"), F.col("base").alias(f"base_{side}"), F.col("lp").alias(f"lp_{side}"))
        far = far.where(~F.col(f"{side}_near")).join(known, side, "left").unionByName(far.where(f"{side}_near"), allowMissingColumns=True)
    found = F.col("base_w").isNotNull() & ~F.col("w_near")
    met = [
        F.col(x)
        * F.when(F.col("w_near"), 1.0).otherwise(F.coalesce(F.col("lp_w")[2 * s], F.lit(unknown[s])))
        * F.when(F.col("u_near"), 1.0).otherwise(F.coalesce(F.col("lp_u")[2 * s + 1], F.lit(STRENGTH)))
        for s, x in enumerate(xs)
    ]
    den = F.when(F.col("u_near"), F.col("den")).otherwise(F.lit(STRENGTH) + F.coalesce("c_u", F.lit(0)))
    base_far = F.when(F.col("w_near"), 0.0).otherwise(F.col("n") * F.coalesce("base_w", nothing))
    far = far.select(
        "key", "train", joint().alias("pair"), "n", den.alias("den"), (sum(met) / SAMPLES).alias("lead"), "sure",
        F.when(found, F.col("n")).otherwise(0).alias("known"), base_far.alias("base"),
    )
    m = F.coalesce("m", F.when(F.col("train"), m_once).otherwise(0.0))
    lp = F.col("n") * F.log10(F.greatest((m + F.col("lead")) / F.col("den"), F.lit(1e-300)))
    more = (
        near.unionByName(far.where("not sure"))
        .join(kept, "pair", "left")
        .unionByName(far.where("sure"), allowMissingColumns=True)
        .groupBy("key")
        .agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum(lp).alias("more_lp"))
    )
    return read.select("key", "doc_id", "train", "n_tokens", "known", "base", "lp").join(more, "key", "left").select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("lp") + F.coalesce("more_lp", F.lit(0.0))).alias("score"),
    )


def perplexity() -> Column:
    """Perplexity by token, from score and n_tokens."""
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
