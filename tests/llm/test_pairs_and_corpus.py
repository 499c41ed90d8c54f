"""Near-duplicates, components, language model, lines, archives and the pipeline."""

import itertools
import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import graph, language_model, lines, minhash, queries, simhash, warc
from lamina.llm.common import fresh_dir, saved, ship, split_by

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    ship(spark)
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def joined(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = text.encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_brute_force(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_simhash"](spark, SF).collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    assert {k: r.fingerprint for k, r in rows.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {k: r.component_id for k, r in rows.items()} == joined(prints, pairs)


def test_links_of_crowded_prints(spark, texts, monkeypatch):
    """Many prints around a few centres, which share whole parts: every link is found, also by whole balls."""
    rng = random.Random(4)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(400):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    prints |= {rng.getrandbits(64) for _ in range(500)} | {0, 1, 2**64 - 1}
    crowd = rng.getrandbits(64)  # many prints that differ in one half, and lone ones beside what they share
    prints |= {crowd ^ (rng.getrandbits(32) << 32) for _ in range(3000)} | {crowd ^ 1 << b for b in range(32)}
    monkeypatch.setattr(simhash, "CROWD", 16)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    got = {tuple(r) for r in simhash.links(df, 2).select("a", "b").collect()}
    signed = sorted(int(np.uint64(p).view(np.int64)) for p in prints)
    assert got == {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    cost = np.cumsum(rng.uniform(0, 5, (20, 3, 4)), 2)
    level, least = simhash.allocate(cost, 3)
    for i in range(20):
        best = min(sum(cost[i, p, t[p]] for p in range(3)) for t in itertools.product(range(4), repeat=3) if sum(t) == 3)
        assert least[i] == pytest.approx(best) and level[i].sum() == 3


def jaccard(a, b, size=5):
    a, b = (set(simhash.shingle_hashes(t, size).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_documents_equal_exact_jaccard(spark, texts):
    """Groups are the components of pairs at 0.8 or more; pairs planted around 0.6 to 0.9 stay apart where they are below."""
    rng = random.Random(11)
    some = [t for t in texts.values() if 5 < len(t.split()) < 600][:120]
    rows = []
    for t in some:
        words = t.split()
        rows.append(" ".join(words))
        for rate in (0.005, 0.02, 0.035, 0.06):
            rows.append(" ".join(w if rng.random() > rate else f"other{rng.random()}" for w in words))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(rows[a], rows[b]) >= 0.8]
    want = joined(range(len(rows)), pairs)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == want
    sets = simhash.shingle_sets(df, "doc_id", "text", 5)
    for rounds in (0, 2):  # blocks of few shingles, so that components are dealt over several tasks, at once or after rounds of stars
        split = simhash.label(sets.select("doc_id", "fp"), simhash.verified_links(sets, df, "doc_id", "text", 5, tokens=500, rounds=rounds), "doc_id")
        assert {r.doc_id: r.component_id for r in split.collect()} == want


def test_pairs_just_over_the_similarity_are_found(spark, texts):
    """Long pairs at 0.80 to 0.85, and short ones at exactly 0.8 (four of five shingles)."""
    rng = random.Random(12)
    word = lambda: f"w{rng.getrandbits(40)}"
    pairs = []
    for i in range(100):
        words = [word() for _ in range(304)]
        pairs.append((words, words[: 304 - (k := 24 + i % 10)] + [word() for _ in range(k)]))
    for _ in range(300):
        words = [word() for _ in range(8)]
        pairs.append((words, [*words, word()]))
    assert all(0.8 <= jaccard(" ".join(a), " ".join(b)) <= 0.855 for a, b in pairs)
    df = spark.createDataFrame([(2 * i + j, " ".join(p[j])) for i, p in enumerate(pairs) for j in range(2)], "doc_id long, text string")
    assert all(r.component_id == r.doc_id // 2 * 2 for r in simhash.similar_documents(df).collect())


def test_bands_agree_as_often_as_they_should():
    rng = np.random.default_rng(13)
    for shared, apart in ((4, 1), (80, 20), (30, 70)):
        rate, trials, same = shared / (shared + apart), 1000, []
        for _ in range(trials):
            h = rng.integers(0, 2**64, shared + apart, dtype=np.uint64)
            same.append((minhash.band_keys(h[: shared + apart // 2]) == minhash.band_keys(np.r_[h[:shared], h[shared + apart // 2 :]])).sum())
        assert np.mean(same) / minhash.BANDS == pytest.approx(rate**minhash.ROWS, rel=0.1, abs=0.0015)
        assert rate < 0.8 or min(same) > 0


def test_candidates_come_from_fingerprints(spark, texts, monkeypatch):
    """Pairs at 0.8, long, short and of four and five shingles, are candidates by SimHash, in one group or in many; strangers aren't."""
    rng = random.Random(15)
    word = lambda: f"w{rng.getrandbits(40)}"
    pairs = []
    for n, last in ((8, 1), (9, 1), (34, 3), (27, 1), (308, 33)):  # words, and how many are added or replaced at the end
        for _ in range(60):
            words = [word() for _ in range(n)]
            pairs.append((words, [*words, word()] if last == 1 else words[:-last] + [word() for _ in range(last)]))
    assert all(jaccard(" ".join(a), " ".join(b)) >= 0.8 for a, b in pairs)
    rows = [" ".join(words) for p in pairs for words in p]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for group in (simhash.GROUP, 40):
        monkeypatch.setattr(simhash, "GROUP", group)
        plan, sets = simhash.plan_similar(600), simhash.shingle_sets(df, "doc_id", "text", 5)
        for r in sets.collect():
            h = np.unique(simhash.shingle_hashes(rows[r.doc_id], 5))
            assert r.bits == simhash.majority(h, plan.lanes(plan.short if r.n <= 5 else plan.long)).astype(">u8").tobytes()
        ids = {r.fp: r.doc_id for r in sets.collect()}
        found = {}
        for r in simhash.candidates(sets).collect():
            found.setdefault(r.band, set()).add(ids[r.fp] // 2)
        assert set().union(*found.values()) == set(range(len(pairs))) and all(len(f) == 1 for f in found.values())


def test_joined_prints_equal_brute_force(monkeypatch):
    """Crowds, strangers and chains: the groups are those of all pairs, also where pairs are compared few at a time."""
    rng = np.random.default_rng(16)
    for pairs in (simhash.PAIRS, 7):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        key, words = rng.integers(0, 24, 300), rng.integers(0, 2**64, (300, 6), np.uint64)
        for i in range(100, 300):  # near copies of one of five, up to and over the limit
            flips = rng.choice(384, rng.integers(30, 100), replace=False)
            words[i] = words[i % 5] ^ np.array([sum(1 << int(b % 64) for b in flips if b // 64 == w) for w in range(6)], np.uint64)
        near = [(a, b) for a, b in itertools.combinations(range(300), 2) if int(key[a] ^ key[b]).bit_count() <= 1 and np.bitwise_count(words[a] ^ words[b]).sum() <= simhash.APART]
        got, want = simhash.joined_prints(key, words), joined(range(300), near)
        assert len(near) > 200 and len(set(got)) == len(set(want.values())) == len({(got[i], want[i]) for i in range(300)})


def test_bits_differ_as_rarely_as_the_plan_says():
    """Sets of 0.8 or more that share up to 48 hashes, in every way to differ, by the votes that they share; and long ones drawn."""
    votes = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n

    for shared in range(4, 49):
        for own, other in itertools.product(range(shared // 4 + 1), repeat=2):
            if 0 < own + other <= shared / 4:
                one, one_b = ((votes(x) * (2 * (np.arange(shared + 1)[:, None] + np.arange(x + 1)) > shared + x)).sum(1) for x in (own, other))
                differ = (votes(shared) * (one * (1 - one_b) + (1 - one) * one_b)).sum()
                assert differ <= (simhash.DIFFER_SHORT if shared + max(own, other) <= simhash.SHORT else simhash.DIFFER)
    rng, plan = np.random.default_rng(17), simhash.plan_similar(10**6)
    same, apart = [], []
    for _ in range(300):
        h = rng.integers(0, 2**64, 450, dtype=np.uint64)
        a, b = (np.stack([simhash.majority(s, plan.lanes(plan.long))]) for s in (h[:425], np.r_[h[:375], h[425:], h[375:400]]))
        (p, x), (q, y) = plan.cut(a, plan.long), plan.cut(b, plan.long)
        near = np.min([np.bitwise_count(k ^ m) for k, m in zip(simhash.blocks_of(x), simhash.blocks_of(y))], axis=0) <= 1
        same.append(((p == q) & near).mean())
        apart.append(np.bitwise_count(a[:, : simhash.COMPARED] ^ b[:, : simhash.COMPARED]).sum())
    assert min(same) > 0 and max(apart) <= simhash.APART


def test_repeated_shingles_count_once(spark, texts):
    """A text and the same text twice over, and one with a line repeated many times, are near copies as sets."""
    rng = random.Random(14)
    words = [f"w{rng.getrandbits(40)}" for _ in range(300)]
    rows = [words, words * 2, words + words[-10:] * 90, [f"w{rng.getrandbits(40)}" for _ in range(300)]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_near_duplicates_of_odd_rows(spark, texts):
    data = [(5, None, 1), (3, "", 1), (None, " \t", 1), (9, "One two", 1), (8, "one  TWO", 1), (8, "one  TWO", 1), (7, "word " * 30_000, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", 3), ("5", 3), ("7", 7), ("8", 8), ("8", 8), ("9", 8), ("None", 3)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.similar_documents(df.limit(0)).count() == 0
    stay = simhash.drop_similar(df)
    assert stay.columns == df.columns and sorted(str(r.doc_id) for r in stay.collect()) == ["3", "7", "8", "8", "None"]


def test_rows_are_split_by_keys(spark, texts):
    rows = spark.range(5000).select((F.col("id") % 4000).alias("id"), F.lit("x").alias("__bit")).unionByName(spark.createDataFrame([(None, "x")], "id long, __bit string"))
    keys = saved(spark.range(3900, 4100).select(F.xxhash64("id").alias("k")))
    maybe, rest = split_by(rows, F.when(F.col("id").isNotNull(), F.xxhash64("id")), keys)
    assert maybe.columns == rest.columns == rows.columns and maybe.count() + rest.count() == 5001
    inside = {r.id for r in maybe.collect()}
    assert set(range(3900, 4000)) <= inside and len(inside) < 900 and not inside & {r.id for r in rest.collect()}


def test_components(spark, texts):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    loose = [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)]
    pairs = chain + star + loose + [(5, 5), (1, 0)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(5)
    got = {r.node: r.root for r in graph.components(df).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == joined(nodes, pairs)
    assert graph.components(df.limit(0)).count() == 0


def test_language_model_equals_sql(same, texts):
    assert same(queries.QUERIES["op6_language_model"], queries.ORACLE_SQL["op6_language_model"]) == 1000


def plain_scores(rows, order, alpha=0.4):
    """Scores by the definition: counts of the other rows, dictionaries only."""
    words = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() for t in rows]
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every, total, out = sum(own, Counter()), sum(map(len, words)), []
    for w, mine in zip(words, own):
        value = 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                gram, left = tuple(w[i - n + 1 : i + 1]), min(order, i + 1) - n
                if n == 1:
                    value += math.log10(every[gram] / total) + left * math.log10(alpha)
                elif every[gram] > mine[gram]:
                    value += math.log10((every[gram] - mine[gram]) / (every[gram[:-1]] - mine[gram[:-1]])) + left * math.log10(alpha)
                    break
        out.append((len(w), value))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_language_model_equals_counting(spark, texts, monkeypatch, order):
    """Many chunks and buckets, repeated rows, and null ids beside ids above 2^53."""
    monkeypatch.setattr(language_model, "CHUNK_WORDS", 300)
    monkeypatch.setattr(language_model, "BUCKET_WORDS", 500)
    rng = random.Random(22)
    rows = [" ".join(rng.choice("aAbBcCdefgh") for _ in range(rng.randrange(40))) for _ in range(120)] + ["New words only", "New words only", "Other words", None, "", " \t"]
    ids = [None if i % 7 == 0 else (1 << 53) + 2 * i + 1 for i in range(len(rows))]
    df = spark.createDataFrame([(k, t, 1) for k, t in zip(ids, rows)], "doc_id long, text string, n int").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, round(r.log10_score, 6) + 0.0) for r in language_model.scores(df, order=order).collect())
    assert got == sorted((str(k), n, round(v, 6) + 0.0) for k, (n, v) in zip(ids, plain_scores(rows, order)))


def test_language_model_of_odd_rows(spark, texts):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1)], "doc_id long, text string, n int")
    assert sorted((r.doc_id, r.n_words, r.log10_score) for r in language_model.scores(df).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert language_model.scores(df.limit(0)).count() == 0
    named = spark.createDataFrame([("x", "a b"), (None, "a b")], "doc_id string, text string")
    assert sorted((str(r.doc_id), round(r.log10_score, 6)) for r in language_model.scores(named).collect()) == [("None", -0.30103), ("x", -0.30103)]


def test_packed_arrays_come_back():
    for kind in (np.int32, np.uint32, np.int64, np.uint64):
        x = np.arange(1000).astype(kind) ** 2
        assert (language_model.unpack(language_model.pack(x), kind) == x).all() and len(language_model.unpack(language_model.pack(x[:0]), kind)) == 0


def test_lines_equal_sql(same):
    assert same(queries.QUERIES["op5_line_dedup"], queries.ORACLE_SQL["op5_line_dedup"]) == 250


def test_lines_of_odd_rows(spark):
    data = [("http://A.b:80/x", "menu\nown 1\nmenu", 1), ("https://u@a.b/y", " \nmenu \nown 2", 1), ("http://a.b", "menu\nown 1", 1), (None, None, 1), (None, "menu", 1), ("nothing", "menu", 1), ("http://c.d/", "", 1)]
    df = spark.createDataFrame(data, "url string, text string, site int")
    out = lines.drop_boilerplate(df, lines.host_of("url"), lines.lines_of_text("text"), ratio=0.5, least_pages=3)
    got = sorted(((str(r.host), r.n_lines, r.n_dropped, tuple(r.kept)) for r in out.collect()))
    assert got == sorted([("a.b", 3, 2, ("own 1",)), ("a.b", 2, 1, ("own 2",)), ("a.b", 2, 1, ("own 1",)), ("None", 0, 0, ()), ("None", 1, 0, ("menu",)), ("", 1, 0, ("menu",)), ("c.d", 0, 0, ())])
    assert out.columns[:3] == ["url", "text", "site"] and lines.drop_boilerplate(df.limit(0), lines.host_of("url"), lines.lines_of_text("text")).count() == 0


def test_a_line_on_few_pages_of_a_host_stays(spark):
    """On three of 20 pages a line stays, on five it goes; on a host of one page nothing goes, of two what both have."""
    rows = [("http://large/", f"menu\nown {i}" + "\nthree" * (i < 3) + "\nfive" * (i < 5)) for i in range(20)] + [("http://one/", "menu\nown")] + [("http://two/", f"menu\nown {i}") for i in range(2)]
    out = lines.drop_boilerplate(spark.createDataFrame(rows, "url string, text string"), lines.host_of("url"), lines.lines_of_text("text")).collect()
    kept = {h: {x for r in out if r.host == h for x in r.kept} for h in ("large", "one", "two")}
    assert kept == {"large": {f"own {i}" for i in range(20)} | {"three"}, "one": {"menu", "own"}, "two": {"own 0", "own 1"}}


@pytest.mark.parametrize("part", [" ", "<", "<script ", "<!--", "<style>", "< a", " \n", "\t\x0b<"])
def test_long_pages_take_no_longer_than_their_length(spark, part):
    began = time.time()
    page = "first<p>" + part * (5_000_000 // len(part))
    assert spark.createDataFrame([(page,)], "html string").select(lines.lines_of_html("html").alias("x")).first().x[0] == "first"
    assert time.time() - began < 15


def test_lines_of_html(spark):
    pages = ["a<script>x</script>b<!-- c <p> -->d<br/>e", "a<SCRIPT src=x>if (a<b) {}</SCRIPT >b", "<style>p{}</style>a < b > c", "x<script>y<script>z</script>w", None, ""]
    got = [r.x for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").orderBy("i").select(lines.lines_of_html("html").alias("x")).collect()]
    assert got == [["abd", "e"], ["a"], ["a", "c"], ["xw"], [], []]


def test_archives_equal_sql(same):
    assert same(queries.QUERIES["op8_warc"], queries.ORACLE_SQL["op8_warc"]) == 250


def test_archives_come_back_whole(spark, texts, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    big = "é\r\n\r\n" * 900
    data = [(1, "http://www.A.b/x y\n", big), (3, "http://a.b/?q#f", big), (3, "http://a.b/?q#f", big), (None, None, big), (7, "::bad[", None), (8, "http://[x/", ""), (9, None, "s"), (10, "http://a.b/?q", "s\x00")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    path = fresh_dir(spark, "warc-test")
    Path(path).mkdir(parents=True)
    (Path(path) / "pages-orphan.warc.gz").touch()
    warc.write(df, path)
    assert not (Path(path) / "pages-orphan.warc.gz").exists()
    back = lambda p: warc.read(spark, warc.find(spark, warc.keys_of(df), p), p)
    rows = sorted(((r.page_id, r.type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in back(path).collect()), key=str)
    whole = big.encode()
    assert rows == sorted([(1, "revisit", 3, None), (3, "response", None, whole), (3, "response", None, whole), (None, "revisit", 3, None), (7, "response", None, b""), (8, "response", None, b""), (9, "response", None, b"s"), (10, "response", None, b"s\x00")], key=str)
    digests = {(r.page_id, r.record_type, r.payload_bytes) for r in warc.digests(back(path)).collect()}
    assert (1, "revisit", len(whole)) in digests and (3, "response", len(whole)) in digests
    look = warc.Lookup(path)
    assert sorted(c[1] for c in look.captures("http://a.b/?q")) == [3, 3, 10] and look.captures("http://a.b/none") == []
    assert all(look.read(c)["page_id"] == c[1] for c in look.captures("http://a.b/?q"))
    every = [look.read(c)["id"] for url in {u for _, u, _ in data} for c in look.captures(url)]
    assert len(set(every)) == len(data)  # also for repeated and null page_ids
    some = spark.createDataFrame([("http://a.b/?q",), ("http://none/",), (None,)], "url string")
    assert sorted(str(r.page_id) for r in warc.find(spark, warc.keys_of(some), path).collect()) == ["10", "3", "3", "9", "None"]  # two pages have no URL
    empty = fresh_dir(spark, "warc-test")
    warc.write(df.limit(0), empty)
    assert warc.digests(back(empty)).count() == 0


def test_sort_keys():
    assert warc.sort_key("http://Blog.Example.com:80/a?b=c#d") == "com,example,blog)/a?b=c"
    assert " " not in warc.sort_key("http://a b/c d\n") and warc.sort_key(None) == ")/"


def test_pipeline(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        assert docs.columns[:5] == columns and (name == "sharding" or docs.columns == columns)
        kept.append({r.doc_id for r in docs.collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:])) and kept[-1] == kept[-2]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in kept[1] for k in good) >= 0.98 * len(good)
    assert sum(k in kept[1] for k, q in labels.items() if q == 0) <= 0.15 * sum(q == 0 for q in labels.values())
    first = {}
    for k in sorted(kept[1]):
        first.setdefault(texts[k], k)
    assert all(k not in kept[2] for k in kept[1] if first[texts[k]] != k)  # exact copies
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept[2] - kept[3] >= {k for k in kept[2] if any(b in texts[k] for b in bench)}
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_stages_of_odd_rows(spark, texts):
    """Nulls in any column, repeated rows, a very long text, clashing names, and no rows at all."""
    import corpus_pipeline

    prose = [t for t in texts.values() if 50 < len(t.split()) < 200][:30]
    names = ["shard", "copies", "target", "size", "fp", "place", "n", "root", "band", "score", "x", "y", "quality", "least", "item_id"]
    rows = [(i, t, "en", "a" if i % 2 else None, len(t), *range(len(names))) for i, t in enumerate(prose)]
    rows += [(None, None, None, None, None, *[None] * len(names)), (None, prose[0], None, None, None, *[None] * len(names)), rows[3], rows[3], (500, "", "en", "b", 0, *range(len(names))), (501, "word " * 300_000, "en", "b", 0, *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for some in (df, df.limit(0)):
        docs = saved(some)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, saved(stage(spark, docs, SF), name)
            columns = [c for c in before.columns if name != "sharding" or c != "shard"]
            assert [c for c in docs.columns if c in columns] == columns
            assert docs.select(*columns).distinct().join(before.select(*columns).distinct().withColumn("__was", F.lit(1)), [docs[c].eqNullSafe(before[c]) for c in columns], "left").where("__was is null").count() == 0
            if not some.count():
                assert docs.count() == 0
    kept = corpus_pipeline.near_duplicates(spark, saved(df), SF).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and sum(r.doc_id == 3 for r in kept) in (0, 3)
