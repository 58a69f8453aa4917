"""Toxicity, quality, quality rules and decontamination against plain versions and on odd input."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import common, decontaminate, gam, outliers, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word other, " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names clash with results."""
    rows = [(1, None, None, None, 9.0), (2, "", "en", "a", 1.0), (3, LONG, "en", None, 1.0), (4, "same text", "en", "a", None), (4, "same text", "en", "a", None), (None, "no id", "de", "b", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Score double")


@pytest.fixture(scope="module")
def model(spark, small):
    return gam.fit_labels(common.table(spark, small, "documents"), common.table(spark, small, "labels"))


@pytest.fixture(scope="module")
def index(spark, small):
    return toxicity.fit_labels(common.table(spark, small, "documents"), common.table(spark, small, "labels"))


# --- toxicity ------------------------------------------------------------------------------


def examples(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        own = collections.Counter(rng.choices(words, k=rng.randint(0, 8)))
        out.append((i, rng.randint(0, 1), list(own), list(own.values())))
    return words, out


def test_neighbours_are_exact():
    words, found = examples(700, 1)
    index = toxicity.build(words, found)
    vectors = {}
    for i, _, own, counts in found:
        v = np.zeros(len(words))
        for t, c in zip(own, counts, strict=True):
            v[words.index(t)] = (1 + np.log(c)) * index.idf[words.index(t)]
        vectors[i] = v / (np.linalg.norm(v) or 1)
    for q in range(0, 700, 23):
        at, w = index.vector(collections.Counter(dict(zip(found[q][2], found[q][3], strict=True))))
        if not len(at):
            continue
        query = np.zeros(len(words))
        query[at] = w
        all_of_them = sorted((round(float(query @ v), 12) for v in vectors.values()), reverse=True)[:15]
        assert np.allclose([c for c, _ in index.nearest(at, w, 15)], all_of_them, atol=1e-9)


def test_votes_are_rates_without_terms():
    words, found = examples(200, 2)
    index = toxicity.build(words, found)
    score, ids, _ = index.vote("nothing known here", 15)
    bare = [r for r in found if not r[2]]
    assert len(ids) == min(15, len(bare)) and 0 < score < 1
    assert index.vote("", 15)[0] == score
    empty = toxicity.build([], [])
    assert 0 <= empty.vote("anything", 15)[0] <= 1


def test_every_shared_word_counts(spark):
    """Wording of two toxic examples among many is found, and every example with a shared word can be evidence."""
    rows = [(i, 0, f"plain words about topic t{i % 50} today") for i in range(300)]
    rows += [(500, 1, "grumbledore snark"), (501, 1, "grumbledore snark"), (502, 0, "xyzzy plugh")]
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    assert set(index.ids.tolist()) == {*range(300), 500, 501} and index.bare_ids == [502]
    score, evidence, _ = index.vote("what a grumbledore", 15)
    assert score > 0.7 and evidence == [500, 501]
    near, evidence, _ = index.vote("topic t7", 15)
    assert near < 0.1 and evidence[:6] == [7, 57, 107, 157, 207, 257]
    assert index.vote("frobozz", 15)[1] == [502]


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op7_toxicity(spark, folder).join(common.table(spark, folder, "labels"), "doc_id").where("held_out")
    right = scored.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    caught = scored.where("toxic = 1").agg(F.avg("predicted")).first()[0]
    assert right > 0.97 and caught > 0.85


def test_toxicity_of_odd_rows(spark, odd, index):
    got = toxicity.score(odd, index).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert got[3].score == got[4].score and [c.lower() for c in toxicity.score(odd, index).columns].count("score") == 1
    assert toxicity.score(odd.limit(0), index).count() == 0
    assert toxicity.harmless(odd, index).columns == odd.columns
    lonely = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert 0 <= toxicity.fit_labels(odd, lonely, 9, 10).vote("x", 3)[0] <= 1


# --- quality -------------------------------------------------------------------------------


def test_cuts_and_quadrants_are_the_best():
    rng = np.random.default_rng(0)
    g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
    table = gam.shallow(g, h, leaves=2)
    whole = gam.gain(g.sum(), h.sum())
    best = max(gam.gain(g[:k].sum(), h[:k].sum()) + gam.gain(g[k:].sum(), h[k:].sum()) - whole for k in range(1, 9))
    k = int(np.flatnonzero(np.diff(table))[0]) + 1
    assert np.isclose(gam.gain(g[:k].sum(), h[:k].sum()) + gam.gain(g[k:].sum(), h[k:].sum()) - whole, best)
    g2, h2 = rng.normal(size=(5, 6)), rng.uniform(0.1, 1, (5, 6))
    won, table2 = gam.quadrants(g2, h2)
    tries = [sum(gam.gain(p.sum(), q.sum()) for p, q in ((g2[:i, :j], h2[:i, :j]), (g2[:i, j:], h2[:i, j:]), (g2[i:, :j], h2[i:, :j]), (g2[i:, j:], h2[i:, j:]))) for i in range(1, 5) for j in range(1, 6)]
    assert np.isclose(won + gam.gain(g2.sum(), h2.sum()), max(tries)) and len(np.unique(table2)) <= 4


def test_pairs_catch_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (2_000, len(gam.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    fitted = gam.train(x, y)
    assert (0, 1) in fitted.pairs and np.mean((fitted.score(x) > 0.5) == y) > 0.9


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op2_quality(spark, folder).join(common.table(spark, folder, "labels"), "doc_id").where("held_out")
    assert scored.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.98


def test_quality_of_odd_rows(spark, odd, model):
    got = gam.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and got[3].score == got[4].score
    assert gam.score(odd.limit(0), model).count() == 0 and gam.accepted(odd, model).columns == odd.columns
    one_class = gam.train(np.zeros((3, len(gam.FEATURES))), np.ones(3))
    assert np.allclose(one_class.score(np.zeros((2, len(gam.FEATURES)))), 3.5 / 4)
    none = gam.fit_labels(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert gam.score(odd, none).count() == 6


# --- quality rules -------------------------------------------------------------------------


def plain_statistics(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b c a b c", "a a a a", "x\nx\n\nx \n y", "é|ü <b> é|ü <b> é|ü", "p\x1cq  r\x0b\x0cs", "a b a b a b\na b", "#" * 50])
def test_statistics(text):
    assert outliers.statistics(text) == plain_statistics(text)


def test_statistics_of_the_table(spark, small):
    for r in common.table(spark, small, "documents").limit(150).collect():
        assert outliers.statistics(r.text or "") == plain_statistics(r.text or "")


def test_outliers_stand_out_of_their_group(spark):
    rng = random.Random(0)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))
    rows = [(i, text(rng.randint(80, 200)), "en", f"s{i % 2}") for i in range(400)]
    rows += [(1_000 + i, " ".join(w + "###$$" for w in text(120).split()), "en", "s0") for i in range(60)]  # 23 per cent of the group
    rows += [(2_000, text(120), "xx", "lone"), (2_001, text(120), None, None)]
    got = {r.doc_id: r for r in outliers.reject(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 462 and not any(got[1_000 + i].kept for i in range(60))
    assert sum(got[i].kept for i in range(400)) >= 398 and got[2_000].kept and got[2_001].kept


def test_menus_and_repeated_lines_alone_are_outliers(spark):
    """Half a symbol a word, or a tenth of a line repeated a word, stands out where other texts have none."""
    rng = random.Random(1)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n)]
    rows = [(i, " ".join(words(rng.randint(150, 350))), "en", "s") for i in range(300)]
    rows += [(1_000 + i, "\n".join(f"{a} {b} |" for a, b in zip(words(120), words(120), strict=True)), "en", "s") for i in range(10)]
    rows += [(2_000 + i, "\n".join([*words(210), *["again"] * 31]), "en", "s") for i in range(10)]
    got = {r.doc_id: r for r in outliers.reject(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values()) and not any(r.kept for i, r in got.items() if i >= 1_000)
    assert sum(got[i].kept for i in range(300)) >= 297


def test_labelled_bad_rows_past_the_base_rules_are_rejected(spark):
    folder = "/root/testdata/sf0.1"
    judged = queries.op9_outliers(spark, folder).where("not base_failed").join(common.table(spark, folder, "labels"), "doc_id")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("share")).collect()}
    assert share[0] > 0.97 and share[1] < 0.03


def test_concentration_matches_plain_steps():
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)) * [1, 0.5, 0.4, 0.3, 0.6] + [5, 1, 0.5, 0.2, 0.1]
    order = np.argsort(rng.uniform(size=500))
    rows = []
    for k, part in enumerate(np.array_split(order, 10)):
        own = x[part]
        rows.append({"pool": 1, "class": k, "n": len(own)} | {f"s{i}": own[:, i].sum() for i in range(5)} | {f"p{q}": (own[:, i] * own[:, j]).sum() for q, (i, j) in enumerate(outliers.PRODUCTS)})
    found = outliers.concentrated(pd.DataFrame(rows).sample(frac=1, random_state=0)).iloc[0]
    inner = x[order[:250]]
    assert np.allclose(found["centre"], inner.mean(axis=0))
    assert np.allclose(np.reshape(found["inverse"], (5, 5)), outliers.regular(outliers.CONSISTENT * np.cov(inner.T, bias=True)))


def test_outliers_of_odd_rows(odd):
    got = outliers.reject(odd).collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert next(r for r in got if r.doc_id == 3).base_failed  # repeats itself
    assert outliers.reject(odd.limit(0)).count() == 0


# --- decontamination -----------------------------------------------------------------------


def plain_edits(passage, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_edited_passages_are_found_up_to_the_budget():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghij   ", k=n))
    passages = [(i, "q" + text(rng.randint(30, 220)) + "q") for i in range(12)]
    index = decontaminate.Index.of(passages)
    for _ in range(80):
        k = rng.randrange(12)
        budget, part = int(index.budget[k]), list(passages[k][1])
        for _ in range(rng.randint(0, budget + 2)):
            at = rng.randrange(len(part))
            part[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        document = text(rng.randint(0, 150)) + "".join(part).upper() + text(rng.randint(0, 150))
        squeezed = re.sub(r"\s+", " ", document.lower())
        edits = plain_edits(re.sub(r"\s+", " ", passages[k][1]), squeezed)
        got = [s for s in index.find(document) if s[0] == k]
        assert bool(got) == (edits <= budget) and (not got or min(s[3] for s in got) == edits)


def test_places_are_those_of_the_whole_text():
    passage = "The quick brown fox jumps over the lazy dog near the river"
    index = decontaminate.Index.of([(7, passage), (8, "tiny"), (9, "  ")])
    text = "İé  x\n\n" + passage.replace(" ", "\n \t").upper() + " end. Tiny! tinyer"
    (short, begin, end, _), *rest = sorted(index.find(text), reverse=True)
    assert (short, text[begin:end]) == (8, "Tiny") and len(rest) == 1
    item, begin, end, edits = rest[0]
    assert item == 7 and edits == 0 and text[begin:end].split() == passage.upper().split()
    assert [s[0] for s in index.find((passage + " and ") * 3)] == [7, 7, 7]


def test_matches_of_odd_rows(spark, odd, small):
    benchmark = common.table(spark, small, "benchmark")
    first = benchmark.first()
    rows = spark.createDataFrame([(5, LONG + first.text + LONG), (5, LONG + first.text + LONG), (None, first.text)], "doc_id long, text string")
    documents = odd.select("doc_id", "text").unionByName(rows)
    got = decontaminate.matches(documents, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id) == [(5, first.item_id)] * 2 and len(got) == 3
    assert decontaminate.clean(documents, benchmark).count() == 6
    assert decontaminate.matches(documents, benchmark.limit(0)).count() == 0 == decontaminate.matches(documents.limit(0), benchmark).count()
    nulls = spark.createDataFrame([(None, None), (1, None), (2, "")], "item_id long, text string")
    assert decontaminate.matches(documents, nulls).count() == 0 and decontaminate.clean(odd, nulls).count() == 6
    blocks = decontaminate.blocks(benchmark, 2_000)
    assert len(blocks) > 1 and sum(map(len, blocks)) == benchmark.count()


def test_several_blocks_of_passages_are_one_query_set(spark, small, monkeypatch):
    benchmark, documents = common.table(spark, small, "benchmark"), common.table(spark, small, "documents")
    want = sorted(map(tuple, decontaminate.matches(documents, benchmark).collect()))
    left = decontaminate.clean(documents, benchmark).count()
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (3_000,))
    assert len(decontaminate.blocks(benchmark)) > 2 and want
    assert sorted(map(tuple, decontaminate.matches(documents, benchmark).collect())) == want
    assert decontaminate.clean(documents, benchmark).count() == left
