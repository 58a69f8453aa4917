"""SimHash, extraction, quotations, packing, archives, language model and pipeline against plain versions and on odd input."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import common, html, packing, pitman_yor, queries, quotes, simhash, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- SimHash -------------------------------------------------------------------------------


def plain_fingerprint(text, n):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  ", "One", "one two", "A b c", "a a a a a", "x\x1cy é Ä ß A\x0bb\x0cc d e", "la " * 500])
def test_fingerprints(text):
    assert simhash.fingerprint(text, 3)[0] == plain_fingerprint(text, 3) and simhash.fingerprint(text, 5, 1)[0] == plain_fingerprint(text, 5)


def plain_components(fps, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("distance", "group"), [(0, 2_000), (1, 5), (2, 2_000), (2, 3), (5, 10)])
def test_components_whatever_the_group_size(spark, distance, group):
    """Random, chained and densely grouped fingerprints; small groups force the deeper filing."""
    rng = random.Random(distance)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)]
    for _ in range(25):
        fps.append(fps[-1] ^ (1 << rng.randrange(64)))
    fps = sorted(set(fps))
    nodes = common.stage(spark.createDataFrame([(simhash.signed(x),) * 2 for x in fps], "node long, fp long"), "nodes")
    roots = {r.fp: r.root for r in simhash.components(simhash.links(nodes, distance, group=group)).collect()}
    got = [roots.get(simhash.signed(x), simhash.signed(x)) for x in fps]
    want = plain_components(fps, distance)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_thresholds_meet_the_pigeonhole_bound():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (3_000, 64))
    bits[:, 1::2] = bits[:, ::2] ^ (rng.uniform(size=(3_000, 32)) < 0.1)  # neighbours are correlated
    full = np.concatenate([bits, np.ones((3_000, 1), int)], axis=1)
    counts = (full.T @ full).astype(float)
    parts = simhash.choose(counts, 4)
    assert sum(t + 1 for _, t in parts) == 5 and len({b for own, _ in parts for b in own}) == sum(len(own) for own, _ in parts)
    order, parent, joint = simhash.tree(counts)
    assert sorted(order) == list(range(64)) and sum(parent[b] in (b - 1, b + 1) for b in range(64)) >= 31
    near = simhash.agreement(order[:10], parent, joint, 2)
    sample = bits[:, order[:10]]
    apart = (sample[:1_500] != sample[1_500:]).sum(axis=1)
    assert np.allclose(near, [np.mean(apart == d) for d in range(3)], atol=0.03)
    assert simhash.allocate([{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 1.0, 1: 20.0}], 0) == (6.0, [0, 0])


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (9, "some words here now"), (4, "Some words here now"), (4, "Some words here now"), (None, "some words here now"), (None, "alone in the world"), (7, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("FP", F.lit("x"))
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (1, 1), (2, 1), (4, 4), (4, 4), (7, 7), (9, 4)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.distinct_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 7]


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(2)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    rows, copies = [], set()
    for i in range(60):
        own = words(rng.randint(150, 400))
        rows.append((i, " ".join(own)))
        if i % 2:
            near = list(own)
            for _ in range(len(own) // 100):
                near[rng.randrange(len(near))] = "changed"
            rows.append((100 + i, " ".join(near)))
            copies.add(100 + i)
    left = {r.doc_id for r in simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left >= set(range(60)) and len(left & copies) <= 1


def plain_groups(sets, least):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_similar_sets_link_like_all_pairs():
    rng = random.Random(4)
    for _ in range(60):
        base = rng.sample(range(500), 40)
        sets = [set(rng.sample(base, rng.randint(30, 40)) + rng.sample(range(500), rng.randint(0, 8))) for _ in range(rng.randint(2, 25))]
        links = simhash.similar([np.array(sorted(s), np.uint64) for s in sets], 0.8)
        parent = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert len(links) < len(sets) and parent == plain_groups(sets, 0.8)


@pytest.mark.parametrize(("texts", "total"), [(4_096, 2_000_000), (3, 2_000_000), (4_096, 500)])
def test_copies_by_exact_similarity(spark, monkeypatch, texts, total):
    """Pairs around 0.8: none below goes, nearly all above do, whatever the size of the groups."""
    monkeypatch.setattr(simhash, "GROUP_TEXTS", texts)
    monkeypatch.setattr(simhash, "GROUP_SHINGLES", total)
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n)]
    rows, near = [], {}
    for i in range(150):
        own = words(rng.randint(80, 200))
        rows.append((i, " ".join(own)))
        copy = list(own)
        for at in rng.sample(range(len(own)), rng.randint(1, 5)):
            copy[at] = "changed"
        rows.append((1_000 + i, " ".join(copy)))
        a, b = (set(simhash.shingles(t).tolist()) for t in (rows[-2][1], rows[-1][1]))
        near[1_000 + i] = len(a & b) / len(a | b)
    rows += [(3, "unlike " + " ".join(words(90))), (2_000, rows[0][1]), (2_000, "unlike " + " ".join(words(90)))]
    left = collections.Counter(r.doc_id for r in simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left[3] == 2 and left[2_000] == 1 and all(left[i] == 1 for i in range(150) if i != 3)
    assert all(left[i] for i, x in near.items() if x < 0.8)
    above = [i for i, x in near.items() if x >= 0.8]
    assert len(above) > 50 and sum(not left[i] for i in above) >= 0.93 * len(above)


# --- extraction ----------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body class="has-sidebar"><div id="header"><a href="/">Home</a></div>
<div class="cookie-notice"><p>We use cookies, many of them, all the time, for everything you do here.</p></div>
<div class="wrap"><div class="content post-%d"><h2>Title %d</h2><p>One &lt;two&gt; thr<b>ee</b>, four&nbsp;and so on<br>for a long enough text.<p>More&#x21; &eacute;
%s<div class="comments"><p>I disagree strongly with all of this, and I will say so at length, often.</p></div></div>
<div class="sidebar"><p>Related one, two, three, four, five, six, seven, eight, nine, ten.</p></div></div><form><p>Search, please, do it now, thanks.</p></form><script>if(a<b){"<p>x</p>"}</script></body></html>"""


def test_main_text(spark):
    filler = "Words, commas, and more words to fill the page with enough text. " * 3
    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, filler if i else "<ul><li>a</li></ul>")) for i in range(8)]
    rows += [(20, None, None), (21, "http://h.example/x", ""), (22, "no address", "just <b>te</b>xt &am"), (23, "http://o.example", "<div hidden>no</div><p>yes <unclosed x='"), (0, "http://h.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("TEXT", F.lit(1))
    got = collections.defaultdict(list)
    for r in html.main_text(pages).collect():
        got[r.page_id].append((r.text, r.n_chars))
    for i in range(1, 8):
        assert got[i][0][0] == " ".join(f"Title {i} One <two> three, four and so on for a long enough text. More! é {filler}".split())
    assert got[0][0][0] == "Title 0 One <two> three, four and so on for a long enough text. More! é a" and len(got[0]) == 2
    assert [got[i][0][0] for i in (20, 21, 22, 23)] == ["", "", "just text &am", "yes"] and got[22][0][1] == 13
    assert html.main_text(pages.limit(0)).count() == 0


def test_hosts_agree_on_a_path(spark):
    """A page whose own best container is another one follows its host."""
    usual = "<body><div class='story'><p>%s</p></div><div class='box'><p>short, aside.</p></div></body>"
    text = "A long paragraph, with commas, that holds the story of this page, more or less in full. " * 4
    rows = [(i, "https://H.example:80/a", usual % text) for i in range(9)] + [(9, "https://h.example/b", "<body><div class='story'><p>Tiny story.</p></div><div class='box'><p>%s</p></div></body>" % text)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Tiny story." and got[0] == text.strip()


def test_articles_of_the_table(spark, small):
    from html import unescape

    for r in html.main_text(common.table(spark, small, "pages"), ["page_id", "html"]).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        assert r.text == " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner[1]))).split())


# --- quotations ----------------------------------------------------------------------------


def test_deep_and_large_pages_take_their_length(spark):
    """16,000 nested elements with a path each, and 1,500 nested paragraphs around 120 KB of text."""
    import time

    begin = time.process_time()
    deep = "<div class='c/1 x'>" * 16_000 + "<p>Deep text, with words and commas, enough of them to count here.</p>"
    page = html.parse(deep)
    own = html.path(page, html.best(page))
    assert html.extract(page, [own, "div"]) == "Deep text, with words and commas, enough of them to count here."
    words = "some words, " * 10_000
    nested = html.parse("<blockquote>" * 1_500 + words + "</blockquote>" * 1_500)
    assert html.extract(nested, []) == " ".join(words.split())
    assert time.process_time() - begin < 15
    long = html.parse("<div>" * 200_000 + "x")  # a page of a megabyte
    assert html.extract(long, ["/".join(["div"] * 3)]) in ("x", "") and time.process_time() - begin < 30


def test_measures_are_those_of_the_text():
    page = html.parse("<p>a, b<i>c</i> d <b> e,</b>f<nav>menu, x</nav> g</p>tail<ul><li>one</li><li></li></ul>  <a>l, k</a>")
    measures = html.Measures(page)
    for n in page.nodes:
        text = html.content(page, n)
        assert measures.of(n) == (len(text), text.count(","))


def test_pages_of_many_hosts_are_dealt_out(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", PAGE % (i, i, "Words, commas, and more words to fill the page with enough text. " * 3)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in html.main_text(pages, ["page_id"]).collect())
    monkeypatch.setattr(html, "HOSTS", 1)
    assert sorted(tuple(r) for r in html.main_text(pages, ["page_id"]).collect()) == want


def test_long_quotations_and_deep_levels(spark):
    quoted = "\n".join(f"> line {i}" for i in range(100_000))
    rows = [(1, 0, "a", "line 77777"), (1, 1, "b", quoted + "\nmy answer"), (1, 2, "c", ">" * 20_000 + " deep\nshallow"), (1, 3, "d", "> " * 20_000 + "x\n" + "> blank\n>\n> blank" * 3)]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].text, got[1].n_quotes, got[1].reply_to) == ("my answer", 1, 0)
    assert got[2].text == "shallow" and got[2].n_quotes == 1 and got[3].n_quotes == 5


def test_a_million_quoted_lines(spark):
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("> l"), i.cast("string"))), "\n")
    df = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("a").alias("role"), F.concat(lines, F.lit("\nown")).alias("text"))
    row = quotes.parsed(df).select("own", F.size("quotes").alias("n"), F.length(F.col("quotes")[0]["passage"]).alias("m")).first()
    assert (row.own, row.n) == ("own", 1) and row.m > 6_000_000


def test_quotations_against_sql(spark):
    rows = [
        (1, 0, "u", "Hello there.\n\nSecond para\nline two"), (1, 1, "a", "> Hello there.\nHi!"), (1, 2, "u", "On Monday x wrote:\n> second PARA\n> line two\n>\n> nothing\nSure"),
        (1, 3, "a", ">> Hello there.\n> Hi!\nDeep\r\n> > x"), (1, 4, "u", "unrelated"), (1, 5, "a", "> unrelated\n\nAnswer > not quote"), (1, 6, "x", "> Answer > not quote\nend"),
        (1, 6, "x", "> Answer > not quote\nend"), (2, 0, None, None), (2, 1, "u", ""), (None, 3, "u", "> q\na"), (3, None, "u", "x"), (2, 5, "u", ">"), (2, 9, "u", "  > >  deep\n>\ttab"),
        (2, 11, "z", "deep"), (2, 12, "z", ">deep\n>  DEEP  "), (4, 0, "a", "Le x a écrit :\n> y\n>y\n"), (4, 1, "a", "y"), (4, 2, "a", ">y"), (5, 0, "u", "long line\n" * 3_000),
    ]
    rows += [(6, k, "u", f"> message {k - 1}\nmessage {k}" if k else "message 0") for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1))
    got = quotes.conversations(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(quotes.SQL).df()
    plain = lambda d: sorted(str([None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r]) for r in d[sorted(d)].astype(object).values.tolist())
    assert plain(got) == plain(want)
    chain = got[got.conv_id == 6].sort_values("turn")
    assert chain.depth.tolist() == list(range(40)) and set(chain.thread) == {0} and set(chain.position) == set(range(40))
    assert quotes.conversations(df.limit(0)).count() == 0
    parts = quotes.assembled(quotes.conversations(df), 25).where("conv_id = 6").orderBy("part").collect()
    assert [m.turn for p in parts for m in p.messages] == list(range(40)) and len(parts) == 2


# --- packing -------------------------------------------------------------------------------


def test_both_vocabulary_forms_give_the_same_ids(spark, small):
    plain, ranks, kept = packing.encoding(JSON), packing.encoding(RANKS), packing.Encoder(RANKS)
    texts = [r.text or "" for r in common.table(spark, small, "documents").collect()]
    texts += ["", " ", "a  b", "a\n b", "a \n b", "a\n \nb  ", " x", "x ", "I'm don't 12'34", "é  ü　x", "\t \t", "日本 語", "<|endoftext|> a", "word" * 5_000]
    for t in texts:
        ids = plain(t)
        assert ranks(t) == ids and np.frombuffer(kept.ids(t), "<u4").tolist() == ids, t[:80]


def test_ids_are_those_of_the_unmodified_tokenizer():
    from tokenizers import Tokenizer

    plain, kept = Tokenizer.from_file(JSON), packing.Encoder(RANKS)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f" {end} ", f"x{end}y z", f"a  {end}\n b", f"a\n{end}  b", f"é {end}, I'm {end}.", f"{end[:-1]} {end}", "a <|endof text|> b", f"{'w' * 80}{end} {'w' * 80}{end}"]
    for t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert packing.encoding(JSON)(t) == packing.encoding(RANKS)(t) == np.frombuffer(kept.ids(t), "<u4").tolist() == ids, t
    assert np.frombuffer(kept.ids(f"a {end} b"), "<u4").tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_everything_and_waste_little(seed):
    rng = random.Random(seed)
    counts = collections.Counter(min(2_048, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(3_000))
    patterns = packing.plan(counts)
    held = collections.Counter()
    for p in patterns:
        assert sum(s * n for s, n in p.runs) <= 2_048 and sum(n for s, n in p.runs if s > 682) <= 2
        for s, n in p.runs:
            held[s] += n * p.times
    total = sum(s * n for s, n in counts.items())
    large = sum(n for s, n in counts.items() if s > 1_024)
    assert held == counts and sum(p.times for p in patterns) <= 1.01 * max(-(-total // 2_048), large) + 1
    assert packing.plan({}) == [] and [p.runs for p in packing.plan({2_048: 3, 1: 1})] in ([[(2_048, 1)], [(1, 1)]], [[(1, 1)], [(2_048, 1)]])


def test_packed_pieces(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5_000), (3, "word " * 5_000), (None, "no id"), (5, "a b c")] + [(10 + i, "x y z " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Offset", F.lit(1))
    got = packing.pack(df, JSON, keep_ids=True).toPandas()
    encode = packing.encoding(JSON)
    want = collections.Counter()
    for i, t in rows:
        ids = [*encode(t or ""), 0]
        first = (len(ids) - 1) % 2_048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2_048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((int(r.doc_id) if r.doc_id == r.doc_id else 0, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2_048
    assert packing.pack(df.limit(0), JSON).count() == 0


# --- archives ------------------------------------------------------------------------------


def test_round_trip_in_segments(spark):
    rows = [(7, None, None), (8, "a\r\nb", "é" * 70), (9, "u", "é" * 70), (9, "u", "é" * 70), (None, "n", "é" * 70), (10, "x", ""), (11, "q", "ü€\r\n\r\nWARC/1.1\r\n" * 9_000), (12, "s", "tiny"), (13, "s", "tiny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Digest", F.lit(1))
    got = warc.round_trip(df, True, 5_000).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    for r in got:
        page = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(page.encode()) and (r.record_type == "revisit" or bytes(r.payload).decode() == page)
    assert sorted((r.page_id or 0, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 8), (9, 8), (9, 8)]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_broken_archives_give_rows_with_problems(spark, tmp_path):
    whole = [x for i in range(3) for x in warc.records(i, "u", "payload é " * 500, None, f"r{i}", 1_000)]
    assert len(whole) > 12
    missing = [x for i, x in enumerate(whole) if i != 1]
    bad_total = [re.sub(r"(Segment-Total-Length: )\d+", r"\g<1>5", x) for x in whole]
    bad_chunk = warc.records(5, "u", "x" * 300, None, "r5")[0].replace("12c\r\n", "12d\r\n", 1)
    cases = {"ok": whole[::-1], "missing": missing, "total": bad_total, "chunk": [bad_chunk], "twice": [*whole, whole[1]]}
    want = {"ok": [None] * 3, "missing": [None, None, "segments missing or repeated"], "total": ["another total length"] * 3, "chunk": ["chunk of another size"], "twice": [None, None, "segments missing or repeated"]}
    for name, parts in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join((x + warc.END).encode() for x in parts))
        got = [r.problem for r in warc.read(spark, str(tmp_path / name)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want[name])), name
    cut = b"".join((x + warc.END).encode() for x in [*warc.records(1, "u", "a" * 200, None, "r"), *warc.records(2, "u", "b" * 200, 9, "s")])
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(cut[:400] + cut[500:])
    assert [r.problem for r in warc.read(spark, str(tmp_path / "cut")).collect() if r.problem is None] == []


def test_one_page_id_with_several_payloads(spark):
    a, b = "<p>" + "a" * 200, "<p>" + "b" * 300
    rows = [(5, "u", a), (5, "u", b), (7, "u", a), (8, "u", b)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    digest = {n: __import__("hashlib").sha256(x.encode()).hexdigest() for n, x in ((len(a), a), (len(b), b))}
    assert sorted((r.page_id, r.payload_bytes, r.refers_to or 0) for r in got) == [(5, 203, 0), (5, 303, 0), (7, 203, 5), (8, 303, 5)]
    assert all(r.payload_digest == digest[r.payload_bytes] and r.problem is None for r in got)


def test_archives_of_the_table_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    got = queries.op6_warc(spark, small).toPandas()
    want = con.sql(queries.SQL["op6_warc"]).df()[list(got)]
    plain = lambda d: sorted(str([None if pd.isna(x) else x for x in r]) for r in d.astype(object).values.tolist())
    assert plain(got) == plain(want)


# --- language model ------------------------------------------------------------------------


def test_language_model_against_plain_counts(spark):
    rng = random.Random(4)
    one, two = [f"en{i}" for i in range(60)], [f"de{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(one if i % 2 else two, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(20, 80))).title(), i % 5 != 0) for i in range(200)]
    rows += [(500, None, True), (501, "", False), (502, "unseen words only", False), (None, "EN1 en2", None), (1, rows[1][1], True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").withColumn("Score", F.lit("x"))
    for head in (100_000, 5):
        got = pitman_yor.score(df, head=head).collect()
        assert len(got) == len(rows)
        tokens = [(i, [*WORD.findall(lower(t or "")), ""], bool(tr)) for i, t, tr in rows]
        c = collections.Counter(w for _, own, tr in tokens if tr for w in own)
        n, v = c.total(), len(c)
        want = {(i, tr): (len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) for i, own, tr in tokens}
        for r in got:
            size, known, base = want[r.doc_id, r.train]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        held = [r for r in got if not r.train and r.doc_id and r.doc_id < 500]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)  # contexts help
        scores = {(r.doc_id, r.train): r.score for r in got}
        if head == 5:
            assert all(math.isclose(scores[k], first[k], rel_tol=1e-9) for k in scores)
        first = scores
    assert pitman_yor.score(df.limit(0)).count() == 0
    assert pitman_yor.score(df.where("not train")).where("n_known > 0 or train_tokens > 0 or base_score <> 0").count() == 0


def test_predictive_probabilities_add_up_to_one(spark):
    text = "a b c a b a the cat the dog a a a " * 5
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    chosen = pitman_yor.frequent(df, 3)
    words = common.stage(pitman_yor.counts(df, chosen), "words")
    seen, unknown, n, v = pitman_yor.trained(words, len(chosen) + 1)
    total = np.sum([r.p for r in seen.collect()], axis=0) + unknown
    assert np.allclose(total, 1) and n == 3 * (5 * 13 + 1) and v == 7 and chosen[0] == b"a"


def test_every_preceding_word_is_a_context(spark):
    """Thirty words, each with a follower of its own: whatever the word, its follower is likelier than another's."""
    rng = random.Random(7)
    draw = lambda: rng.choices(range(30), weights=[1 / (k + 1) for k in range(30)], k=20)
    rows = [(i, " ".join(f"a{k} b{k}" for k in draw()), True) for i in range(60)]
    rows += [(100 + k, f"a{k} b{k}", False) for k in range(30)] + [(200 + k, f"a{k} b{(k + 1) % 30}", False) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for head in (100_000, 5):
        got = {r.doc_id: r.score for r in pitman_yor.score(df, head=head).collect()}
        assert all(got[100 + k] > got[200 + k] + 0.5 for k in range(30))


def test_probabilities_after_each_word_add_up_to_one(spark):
    """With pairs and types seen once kept out of the sweeps: what a word's followers keep and what it hands on is all there is."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(40)], weights=[1 / (k + 1) for k in range(40)], k=12)) + f" only{i}" for i in range(40)]
    pairs = common.stage(pitman_yor.followers(spark.createDataFrame([(t,) for t in texts], "text string")), "pairs")
    types, kept, m_once, unknown, n, v = pitman_yor.learned(pairs)
    lp = {r.word: (r.c, r.lp) for r in types.collect()}
    assert len(lp) == v and n == 40 * 14 and kept.where("c < 2").count() == 0
    m = {r.pair: r.m for r in kept.collect()}
    for s in range(pitman_yor.SAMPLES):
        assert math.isclose(sum(x[2 * s] for _, x in lp.values()) + unknown[s], 1)
    shares = collections.Counter()
    for r in pairs.withColumn("pair", pitman_yor.joint()).collect():
        assert (r.c > 1) == (r.pair in m)
        shares[r.u] += m.get(r.pair, m_once)
    for u, (c, x) in lp.items():
        assert math.isclose(shares[u] + np.mean(x[1::2]), pitman_yor.STRENGTH + c)


def test_discount_comes_from_dishes_with_one_and_two_customers(spark):
    state = spark.createDataFrame([(i, [c], [1], 1) for i, c in enumerate([1, 1, 1, 2, 2, 5])], "word long, c array<long>, t array<long>, own long")
    got = pitman_yor.added(state, 1)
    assert math.isclose(got.d, pitman_yor.discount(3, 2)) and got.types == 6
    assert pitman_yor.added(state.where("word > 1"), 1, 2) == got


def test_bitmap_misses_no_hash(spark):
    rng = np.random.default_rng(5)
    hashes = np.append(rng.integers(-(2**63), 2**63 - 1, 3_000), [0, -1, pitman_yor.BITS, -(2**63), 2**63 - 1])
    df = spark.createDataFrame([(int(h),) for h in hashes], "pair long")
    bits = pitman_yor.marked(df.limit(0).unionByName(df))
    assert pitman_yor.among(bits, hashes).all() and pitman_yor.among(bits, rng.integers(-(2**63), 2**63 - 1, 3_000)).mean() < 0.01
    assert not pitman_yor.marked(df.limit(0)).any() and pitman_yor.asked_for(df, bits).count() == len(hashes)


def test_tokens_as_numbers():
    texts = ["One two\x0bTWO\u00a0x \u0130\t", "", None, " \n", "\x1cthree one"]
    hashes, ids, before, size = pitman_yor.encoded(pa.array(texts))
    plain = [pitman_yor.tokens(t or "") for t in texts]
    want = [np.uint64(xxhash.xxh64_intdigest(w, 42)).astype(np.int64) for own in plain for w in own]
    assert size.tolist() == [len(own) for own in plain] and hashes[ids].tolist() == want
    assert hashes[before].tolist() == [hashes[-1], *want[:-1]]


def test_seating_follows_the_chinese_restaurant():
    """The mean number of tables of one dish equals that of seating one customer after the other."""
    rng = np.random.default_rng(0)
    for customers in (2, 7, 60):
        got = pitman_yor.seated(np.full(4_000, customers), np.full(4_000, 1.5), 0.4, rng).mean()
        plain = []
        for _ in range(4_000):
            t = 1
            for i in range(1, customers):
                t += rng.uniform() < 1.5 / (1.5 + i - 0.4 * t)
            plain.append(t)
        assert abs(got - np.mean(plain)) < 0.25


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline(spark, small):
    docs = common.table(spark, small, "documents")
    labels = {r.doc_id: r for r in common.table(spark, small, "labels").collect()}
    odd = spark.createDataFrame([(None, None, None, None, None), (90_001, "", "en", "s", 0), (90_002, None, "en", "s", 0)], docs.schema)
    kept = docs.unionByName(odd)
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = common.stage(function(spark, kept, small), name)
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before
        if name == "quality":
            good = [i for i in before if i in labels and labels[i].quality == 1]
            assert sum(i in after for i in good) > 0.98 * len(good)
    assert kept.count() < docs.count()
    again = corpus_pipeline.STAGES[2][1](spark, kept, small)
    assert again.count() == kept.count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert corpus_pipeline.STAGES[2][1](spark, docs.limit(0), small).count() == 0
