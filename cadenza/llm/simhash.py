"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text gets a 64-bit SimHash of its word shingles.  Equal fingerprints are one node.  Two
nodes are linked if they differ in at most ``distance`` bits.

*Partitions.*  Over all distinct fingerprints the joint counts of every two bits are added up
(one 64 x 64 table).  Bits are grouped along the tree of largest mutual information, so that
correlated bits share a partition.  *Thresholds.*  If the thresholds t_i of m partitions add up
to distance - m + 1, fingerprints within ``distance`` differ in at most t_i bits of some
partition i (t_i = -1: the partition is left out).  For every number of partitions, dynamic
programming chooses the thresholds of least cost, where the cost of (partition, t) is the
number of probes, weighted, plus the number of candidates that the tree model expects for it
(more where keys would be too large).
*Probes.*  With threshold t a fingerprint is filed once for every way of masking t bits of the
partition: fingerprints within t bits there meet under a key.  A key's fingerprints agree on
the bits it shows.

A key with more than ``GROUP`` fingerprints is never gathered.  While a key leaves enough bits
open, its fingerprints are filed again, under the same principle, by ``distance`` + 1 parts of the
open bits.  Otherwise they are dealt into blocks, and every two blocks form a group.
*Verification.*  Inside a group all pairs are compared, but only a spanning forest of the links
goes on: one row per fingerprint at most, never all pairs; a fingerprint that is reached is not
compared again as a target, so that dense groups take few rounds.  Components come from repeated
contraction of the links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

SEED = 42
DISTANCE = 2
#: Most fingerprints that are compared with each other in one group.
GROUP = 16_384
#: Parts with fewer bits than this hardly divide a key.
PART = 8
#: A filed row costs about as much as so many comparisons.
PROBE = 1_000
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ones(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    columns = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)  # little-endian bytes
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ BITS for k in range(8)])
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = hashes ^ (hashes >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(text: str, words: int, more: int = 0) -> list[int]:
    """SimHash of the shingles of ``words`` words, then ``more`` further 64-bit SimHashes.

    The whole sequence is one shingle if it is shorter; without words all are 0.
    """
    own = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not own:
        return [0] * (1 + more)
    joined = b" ".join(own)
    ends = (np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[min(words, len(own)) - 1 :], strict=False)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    found = [ones(hashes)]
    for _ in range(more):
        hashes = mixed(hashes)
        found.append(ones(hashes))
    return found


def fingerprints(df: DataFrame, words: int = 3, keep: Sequence[str] | None = None, more: int = 0) -> DataFrame:
    """Adds fp, the fingerprint as a signed long, and w1, w2, ... to every row; null texts count as empty."""
    names = ["fp", *(f"w{i}" for i in range(1, more + 1))]

    def made(text):
        rows = [fingerprint(t, words, more) for t in common.texts(text)]
        return list(np.array(rows, np.uint64).reshape(-1, 1 + more).T.astype(np.int64))

    return common.with_columns(df, made, ["text"], ", ".join(f"{n} long" for n in names), keep)


# --- partitions and thresholds -------------------------------------------------------------


def joint_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits i and j, for all i, j, and how many there are (64, 64)."""

    def run(batches):
        total = np.zeros((65, 65))
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            bits = np.ones((len(fp), 65), np.float64)
            bits[:, :64] = (fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(65), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i int, row array<double>"
    columns = [F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(65)]
    rows = nodes.select("fp").mapInArrow(run, schema).groupBy("i").agg(*columns).collect()  # 65 rows
    out = np.zeros((65, 65))
    for r in rows:
        out[r.i] = r[1:]
    return out


def tree(counts: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Order of the bits, parent of each bit (or -1), joint probabilities [i, j, a, b]."""
    n = counts[64, 64] + 1
    one = (np.diag(counts)[:64] + 0.5) / n
    both = (counts[:64, :64] + 0.25) / n
    joint = np.empty((64, 64, 2, 2))
    joint[..., 1, 1] = both
    joint[..., 1, 0] = np.maximum(one[:, None] - both, 1e-9)
    joint[..., 0, 1] = np.maximum(one[None, :] - both, 1e-9)
    joint[..., 0, 0] = np.maximum(1 - one[:, None] - one[None, :] + both, 1e-9)
    single = np.stack([1 - one, one], axis=-1)
    shared = (joint * np.log(joint / (single[:, None, :, None] * single[None, :, None, :]))).sum(axis=(2, 3))
    np.fill_diagonal(shared, -np.inf)
    order, parent, best = [0], [-1] * 64, shared[0].copy()
    link = np.zeros(64, int)
    best[0] = -np.inf
    while len(order) < 64:  # largest spanning tree; a bit follows the one it depends on
        i = int(np.argmax(best))
        order.append(i)
        parent[i] = int(link[i])
        better = shared[i] > best
        better[order] = False
        best[better], link[better] = shared[i][better], i
        best[i] = -np.inf
    return order, parent, joint


def agreement(bits: Sequence[int], parent: Sequence[int], joint: np.ndarray, most: int) -> np.ndarray:
    """Chance that two independent fingerprints of the tree model differ in 0, 1, ..., most of ``bits``."""
    inside = set(bits)
    children: dict[int, list[int]] = {b: [] for b in bits}
    roots = []
    for b in bits:
        if parent[b] in inside:
            children[parent[b]].append(b)
        else:
            roots.append(b)

    def below(b: int) -> np.ndarray:
        """[x, y, d]: chance of d differences in the subtree of b, given values x and y at b."""
        out = np.zeros((2, 2, most + 1))
        out[0, 0, 0] = out[1, 1, 0] = 1
        if most:
            out[0, 1, 1] = out[1, 0, 1] = 1
        for c in children[b]:
            sub = below(c)
            given = joint[b, c] / joint[b, c].sum(axis=1, keepdims=True)  # [value of b, value of c]
            moved = np.einsum("xu,yv,uvd->xyd", given, given, sub)
            mixed = np.zeros_like(out)
            for d in range(most + 1):
                for e in range(d + 1):
                    mixed[..., d] += out[..., e] * moved[..., d - e]
            out = mixed
        return out

    total = np.zeros(most + 1)
    total[0] = 1
    for r in roots:
        single = joint[r, r - 1 if r else 1].sum(axis=1)
        own = np.einsum("x,y,xyd->d", single, single, below(r))
        total = np.array([sum(total[e] * own[d - e] for e in range(d + 1)) for d in range(most + 1)])
    return total


def allocate(costs: Sequence[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per partition, that add up to ``total`` at least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, extra in options.items():
                new = (cost + extra, [*chosen, t])
                if used + t not in step or new < step[used + t]:
                    step[used + t] = new
        best = step
    return best.get(total, (math.inf, []))


def choose(counts: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition in use, for fingerprints with these joint counts."""
    order, parent, joint = tree(counts)
    n = max(1.0, counts[64, 64])
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, distance + 3):
        parts = [[int(b) for b in p] for p in np.array_split(order, m)]
        costs = []
        for bits in parts:
            near = np.cumsum(agreement(bits, parent, joint, distance))
            options = {-1: 0.0}
            for t in range(min(distance, len(bits) - 1) + 1):
                probes = math.comb(len(bits), t)
                options[t] = PROBE * n * probes + n * n / 2 * near[t]
                if n * near[t] > GROUP:  # most keys would be filed again, by distance + 1 parts
                    options[t] += PROBE * n * probes * (distance + 1)
            costs.append(options)
        cost, chosen = allocate(costs, distance - m + 1)
        if cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


# --- probing -------------------------------------------------------------------------------


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(parts: Sequence[tuple[Sequence[int], int]]) -> list[int]:
    """Bits that a key shows, for every way to mask ``threshold`` bits of a partition."""
    shown = []
    for bits, t in parts:
        whole = sum(1 << b for b in bits)
        shown += [signed(whole & ~sum(1 << b for b in hidden)) for hidden in itertools.combinations(bits, t)]
    return shown


def filed(df: DataFrame, shown: Sequence[int]) -> DataFrame:
    """Every row of ``df`` under each of its keys: adds shown and value."""
    each = F.explode(F.array(*[F.lit(m).cast("long") for m in shown]))
    return df.withColumn("shown", each).withColumn("value", F.col("fp").bitwiseAND(F.col("shown")))


def opened(df: DataFrame, distance: int) -> DataFrame:
    """Files the fingerprints of large keys again: each under distance + 1 equal parts of its open bits."""

    def deeper(shown):
        cache: dict[int, list[int]] = {}
        for s in shown.unique().to_pylist():
            free = [b for b in range(64) if not (s >> b) & 1]
            cache[s] = [signed((s | sum(1 << int(b) for b in p)) & (1 << 64) - 1) for p in np.array_split(free, distance + 1) if len(p)]
        return [[cache[s] for s in shown.to_pylist()]]

    more = common.with_columns(df.drop("value"), deeper, ["shown"], "next array<long>")
    return more.withColumn("shown", F.explode("next")).drop("next").withColumn("value", F.col("fp").bitwiseAND(F.col("shown")))


def paired(keys: DataFrame, large: DataFrame, group: int) -> DataFrame:
    """The fingerprints of large keys in groups (i, j) of two blocks; any two of a key share a group."""
    rows = keys.join(large, ["shown", "value"]).withColumn("blocks", F.ceil(2 * F.col("n") / group))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    each = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "blocks", "own", "other")


def forest(bits: np.ndarray, distance: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) of a spanning forest over linked rows of ``bits`` (fingerprints x words)."""
    left: list[int] = []
    right: list[int] = []
    # a breadth-first walk: each fingerprint is compared once with all that are not yet reached
    free = np.arange(len(bits))
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            i = queue.pop()
            near = np.bitwise_count(bits[free, 0] ^ bits[i, 0]) <= distance
            if bits.shape[1] > 1 and near.any():
                at = np.flatnonzero(near)
                near[at] = np.bitwise_count(bits[free[at]] ^ bits[i]).sum(axis=1) <= total
            found = free[near]
            if len(found):
                left += [i] * len(found)
                right += found.tolist()
                queue += found.tolist()
                free = free[~near]
    return np.array(left, np.int64), np.array(right, np.int64)


def links(nodes: DataFrame, distance: int = DISTANCE, total: int = 0, group: int = GROUP) -> DataFrame:
    """(a, b): links that connect whatever links of ``nodes`` connect.

    ``nodes`` (node, fp[, w1, ...]) is a table on disk with distinct rows.  Two nodes are linked
    if their fp differ in at most ``distance`` bits and, with further words, all words together
    in at most ``total``.
    """
    names = ["fp", *(c for c in nodes.columns if c.startswith("w"))]
    parts = choose(joint_counts(nodes), distance)
    keys = filed(nodes, masks(parts) if parts else [0])

    def compared(batches):
        for batch in batches:
            lists = [batch.column(i) for i in range(1 + len(names))]
            flat = np.stack([x.flatten().to_numpy() for x in lists], axis=1)
            at = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            node, bits = flat[:, 0], flat[:, 1:].view(np.uint64)
            sizes = np.diff(at)
            two = at[:-1][sizes == 2]
            apart = np.bitwise_count(bits[two] ^ bits[two + 1])
            two = two[(apart[:, 0] <= distance) & ((len(names) == 1) | (apart.sum(axis=1) <= total))]
            found = [(node[two], node[two + 1])]
            for i in np.flatnonzero(sizes > 2):
                a, b = forest(bits[at[i] : at[i + 1]], distance, total)
                found.append((node[at[i] + a], node[at[i] + b]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    def linked(filed_: DataFrame, by: list[str]) -> DataFrame:
        gathered = filed_.groupBy(*by).agg(F.collect_list(F.struct("node", *names)).alias("rows"))
        lists = [F.col("rows")[c].alias(c) for c in ("node", *names)]
        return common.stage(gathered.select(*lists).mapInArrow(compared, "a long, b long").distinct(), "links")

    found: DataFrame | None = None
    while True:
        sizes = common.stage(keys.groupBy("shown", "value").agg(F.count("*").alias("n")).where("n > 1"), "keys")
        small = keys.join(sizes.where(F.col("n") <= group).drop("n"), ["shown", "value"])
        found = linked(small, ["shown", "value"]) if found is None else found.union(linked(small, ["shown", "value"]))
        large = sizes.where(F.col("n") > group)
        narrow = 64 - F.bit_count("shown") < PART * (distance + 1)
        blocks = large.where(narrow)
        if not blocks.isEmpty():
            found = found.union(linked(paired(keys, blocks, group), ["shown", "value", "i", "j"]))
        large = large.where(~narrow)
        if large.isEmpty():
            return found.distinct()
        # the same fingerprint may come by several large keys
        keys = common.stage(opened(keys.join(large.drop("n"), ["shown", "value"], "left_semi"), distance).distinct(), "filed")


# --- components ----------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): a representative for every fingerprint that has a link.

    Each round gives every node the smallest of itself and its neighbours and contracts the
    links accordingly; at least half of the linked nodes vanish in a round.  The rounds are
    then composed backwards.
    """
    rounds: list[DataFrame] = []
    edges = common.stage(edges, "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = common.stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "round")
        rounds.append(step)
        moved = edges.join(step, F.col("a") == F.col("node")).select(F.col("root").alias("a"), "b")
        moved = moved.join(step, F.col("b") == F.col("node")).select("a", F.col("root").alias("b"))
        edges = common.stage(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    out = rounds[-1].select(F.col("node").alias("fp"), "root")
    for step in reversed(rounds[:-1]):
        later = out.select(F.col("fp").alias("root"), F.col("root").alias("next"))
        out = step.join(later, "root", "left").select(F.col("node").alias("fp"), F.coalesce("next", "root").alias("root"))
    return out


def near_duplicates(
    df: DataFrame, words: int = 3, distance: int = DISTANCE, keep: Sequence[str] = ("doc_id",), more: int = 0, total: int = 0
) -> DataFrame:
    """The columns ``keep`` of every row, fp (long), fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id that the document reaches by links.  Null and empty
    texts have fingerprint 0 and are linked like any other.  Repeated rows stay, each with the
    same component; a null doc_id takes part in links but names no component (null if alone);
    an empty table stays empty.  With ``more`` further words a link also takes at most ``total``
    differing bits in all words together.
    """
    marked = common.stage(fingerprints(df, words, keep, more), "fingerprints")
    names = ["fp", *(f"w{i}" for i in range(1, more + 1))]
    node = F.xxhash64(*names) if more else F.col("fp")
    marked = marked.withColumn("node", node)
    nodes = common.stage(marked.groupBy("node", *names).agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.drop("least"), distance, total)).withColumnRenamed("fp", "node")
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.stage(rooted.join(least, "root").select("node", "component_id"), "components")
    return marked.join(named, "node").select(*keep, "fp", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- near copies by similarity ----------------------------------------------------------------

#: For pairs of similarity 0.8 (Jaccard of five-word shingles): their cosine is about 8/9, so that 0.15 of the bits differ.
NEAR_WORDS = 5
NEAR_BITS = 10
NEAR_MORE = 2
NEAR_TOTAL = 40
SIMILARITY = 0.8
#: Most texts, and shingles of texts, that are compared in one group.
GROUP_TEXTS = 4_096
GROUP_SHINGLES = 2_000_000


def shingles(text: str, words: int = NEAR_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles; the whole sequence is one if it is shorter, also the empty one."""
    own = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    joined = b" ".join(own)
    ends = list(itertools.accumulate((len(w) + 1 for w in own), initial=0))
    spans = [(a, b - 1) for a, b in zip(ends, ends[words:], strict=False)] or [(0, len(joined))]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs of ``sets`` (distinct numbers) with Jaccard ``least`` or more.

    A breadth-first walk: what a set shares with all others is counted along the postings of its
    members; a set that is reached is not compared again as a target.
    """
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if shared >= least * (len(sets[0]) + len(sets[1]) - shared) else []
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    unique, member = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(member, kind="stable")
    posting, starts = row[order], np.searchsorted(member[order], np.arange(len(unique) + 1))
    begin = np.cumsum(size) - size
    free = np.ones(len(sets), bool)
    found = []
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first], queue = False, [first]
        while queue and free.any():
            i = queue.pop()
            own = member[begin[i] : begin[i] + size[i]]
            n = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - n.cumsum() + n, n) + np.arange(n.sum())
            shared = np.bincount(posting[at], minlength=len(sets))
            near = np.flatnonzero(free & (shared >= least * (size[i] + size - shared)))
            free[near] = False
            queue += near.tolist()
            found += [(i, j) for j in near.tolist()]
    return found


def verified(groups: DataFrame, least: float) -> DataFrame:
    """(a, b): links between similar nodes of each group of ``groups`` (root, i, j, node, set), which lies together and in order."""

    def run(batches):
        key, node, sets = None, [], []

        def links():
            pairs = similar(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([node[x[k]] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for part in common.slices(batch):
                keys = zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)
                for own, n, x in zip(keys, part.column(3).to_pylist(), part.column(4), strict=True):
                    if own != key:
                        yield links()
                        key, node, sets = own, [], []
                    node.append(n)
                    sets.append(x.values.to_numpy().view(np.uint64))
        yield links()

    by = ["root", "i", "j"]
    return groups.select(*by, "node", "set").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def similar_components(df: DataFrame, words: int = NEAR_WORDS, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` as (doc_id, __node), on disk, and (node, root) of every text with a similar other text.

    Equal texts are one node.  SimHash links (at most NEAR_BITS bits of any of three 64-bit words, and
    NEAR_TOTAL of all) gather what may be similar in components; inside these the Jaccard similarity of the shingle
    sets is exact, and only pairs with ``least`` or more link.  A component with many
    texts or shingles is dealt into blocks, and every two blocks are compared as one group.
    """
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = df.select("doc_id", "text").withColumn("__node", node)
    marked = common.stage(fingerprints(texts, words, ["doc_id", "__node"], NEAR_MORE), "marked")
    names = ["fp", *(f"w{i}" for i in range(1, NEAR_MORE + 1))]
    nodes = common.stage(marked.groupBy(F.col("__node").alias("node")).agg(*[F.first(n).alias(n) for n in names]), "nodes")
    found = None
    for k in range(len(names)):
        # each word in turn is the one that is probed
        turned = [F.col(n).alias(m) for n, m in zip([*names[k:], *names[:k]], names, strict=True)]
        own = links(nodes.select("node", *turned), NEAR_BITS, NEAR_TOTAL)
        found = own if found is None else found.unionAll(own)
    loose = common.stage(components(found.distinct()).select(F.col("fp").alias("__node"), "root"), "loose")
    linked = texts.drop("doc_id").join(common.small(loose), "__node").dropDuplicates(["__node"])
    sets = common.stage(
        common.with_columns(linked, lambda text: [[shingles(t, words).view(np.int64) for t in common.texts(text)]], ["text"], "set array<long>", ["__node", "root"]).withColumnRenamed("__node", "node"),
        "sets",
    )
    sizes = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("set")).alias("m"))
    blocks = F.greatest(F.ceil(2 * F.col("n") / GROUP_TEXTS), F.ceil(2 * F.col("m") / GROUP_SHINGLES))
    whole = (F.col("n") <= GROUP_TEXTS) & (F.col("m") <= GROUP_SHINGLES)
    dealt = sets.join(common.small(common.stage(sizes.withColumn("blocks", F.when(whole, 1).otherwise(blocks)).drop("n", "m"), "sizes")), "root")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    each = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return marked.select("doc_id", "__node"), components(verified(groups, least).distinct()).withColumnRenamed("fp", "node")


def distinct_documents(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` without near copies: of each group the row with the smallest doc_id stays.

    Groups are texts linked by a Jaccard similarity of five-word shingles of ``least`` or more.
    Rows are judged by doc_id and text together: of repeated rows one stays, and different texts under one
    doc_id are judged apart.  Null and empty texts are copies of each other.  Rows without doc_id
    cannot be named by a decision and stay.  An empty table stays empty.
    """
    marked, roots = similar_components(df, least=least)
    rows = marked.where("doc_id is not null").groupBy("doc_id", "__node").agg(F.count("*").alias("n"))
    rooted = rows.join(common.small(common.stage(roots.withColumnRenamed("node", "__node"), "roots")), "__node", "left")
    rooted = common.stage(rooted.withColumn("root", F.coalesce("root", "__node")), "rows")
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "__node")).alias("first"), F.count("*").alias("many")).where("many > 1")
    losing = rooted.join(common.small(common.stage(first, "first")), "root").where(F.struct("doc_id", "__node") != F.col("first"))
    key = ["doc_id", "__node"]
    gone = common.stage(losing.select(*key), "copies")
    named = df.withColumn("__node", F.xxhash64(F.coalesce("text", F.lit(""))))
    unique = named.join(common.small(gone), key, "left_anti")
    repeated = rooted.where("n > 1").join(gone, key, "left_anti").select(*key)
    if repeated.isEmpty():
        return unique.select(df.columns)
    once = named.join(repeated, key, "left_semi").dropDuplicates(key).select(df.columns)
    return unique.join(repeated, key, "left_anti").select(df.columns).unionByName(once)
