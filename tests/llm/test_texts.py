"""Operators that read single texts: token counts, fingerprints, decontamination, quality."""

import base64
import hashlib
import random

import numpy as np
import pytest
import xxhash

from lamina.llm import decontamination, queries, quality, sketches, tokens
from lamina.llm.common import ship

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), public.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark, texts, library):
    rows = queries.QUERIES["op9_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library[0].encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_token_counts_of_odd_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)  # so that the memory is emptied often
    monkeypatch.setattr(tokens, "BLOCK", 200)
    count, rng = tokens.Counter(tokens.Merges(library[1])), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "é", "中", "😀", "'s", "'LL", "1", "²", "<|endoftext|>", "!!", "aaaaaaa", "the", "\x00", "​"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", "ab" * 5000, "x " * 3000]
    got = [n for a, b in tokens.blocks(odd) for n in count(odd[a:b])]
    assert got == [len(library[0].encode(t, add_special_tokens=False).ids) for t in odd]


def test_token_counts_of_odd_rows(spark, docs, library):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a", 3), (1, "a", 3)], "doc_id long, text string, n_tokens int")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, library[1]).collect()) == [("1", 0, 0), ("1", 1, 1), ("1", 1, 1), ("None", 0, 0)]
    assert tokens.token_counts(df.limit(0), library[1]).count() == 0


def plain_sketch(text, fraction=16):
    """The sketch by its definition, in Python integers."""
    mask, points, out = (1 << 64) - 1, [ord(c) + 1 for c in text], set()
    for i in range(max(1, len(points) - 7) if points else 0):
        h = 0 if len(points) >= 8 else len(points)
        for x in points[i : i + 8]:
            h = (h * 0x9E3779B97F4A7C15 + x) & mask
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & mask
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & mask
        h = (h ^ (h >> 33)) >> 32
        if h < (1 << 32) // fraction:
            out.add(h)
    return sorted(out)


def plain_row(own, after):
    half = len(own) // 2
    edited = own[: len(own) - half] + after[:half]
    a, b, c = (set(plain_sketch(t)) for t in (own, edited, after))
    code = lambda s: base64.b64encode(b"".join(x.to_bytes(4, "big") for x in sorted(s))).decode()
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    return len(own), hashlib.sha256(edited.encode()).hexdigest(), code(a), code(b), like(a, b), like(a, c)


def plain_rows(rows):
    """Expected (doc_id, ...) of all rows, ordered as the operator says: null ids first, equal ids by xxhash64 of the text."""
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    return [(k, *plain_row(t, order[(i + 1) % len(order)][1])) for i, (k, t) in enumerate(order)]


def fields(r):
    return r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next


def test_fingerprints_equal_brute_force(spark, texts):
    small = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op10_fingerprints"](spark, small).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(fields, rows)) == sorted(plain_rows(docs))
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
    size = sum(len(t) for _, t in docs)
    assert 0.2 * size < sum(len(r.fingerprint) for r in rows) < 0.4 * size


def test_fingerprints_beside_null_and_large_ids(spark, docs, monkeypatch):
    """Null ids beside ids above 2^53, an id with many texts, and rows that are repeated often, in many stretches."""
    monkeypatch.setattr(sketches, "STRETCH", 3)
    monkeypatch.setattr(sketches, "CROWD", 4)
    monkeypatch.setattr(sketches, "COPIES", 7)
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    rows = [((1 << 53) + 2 * i + 1, word(rng.randrange(60))) for i in range(300)] + [(None, word(30)) for _ in range(150)] + [(None, None)] * 60 + [(-5, word(40)) for _ in range(120)] + [(7, "the same text again and again")] * 90
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sketches.edited_fingerprints(df).collect()
    assert sorted(map(fields, got), key=str) == sorted(plain_rows(rows), key=str)


def test_sketches_estimate_and_merge():
    rng = random.Random(2)
    long, short = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (40_000, 3000))
    both = sketches.merge(sketches.sketch(long), sketches.sketch(short))
    assert sketches.containment(sketches.sketch(short), both) == 1
    part = long[:3000]
    assert sketches.containment(sketches.sketch(part), sketches.sketch(long)) > 0.98
    assert sketches.containment(sketches.sketch(short), sketches.sketch(long)) < 0.1
    half = long[:20_000] + "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    assert abs(sketches.resemblance(sketches.sketch(long), sketches.sketch(half)) - 1 / 3) < 0.03
    for t in ("", "a", "ab cd", long):
        s = sketches.sketch(t)
        assert (sketches.decode(sketches.encode(s)) == s).all()
    assert len(sketches.sketch(long, fraction=1)) > 39_000 and sketches.resemblance(sketches.sketch(""), sketches.sketch("")) == 1


def test_fingerprints_of_odd_rows(spark, docs):
    df = spark.createDataFrame([(None, "b" * 40, 1, 1), (None, None, 1, 1), (1, "x" * 50, 1, 1), (1, "y", 1, 1), (5, "", 1, 1), (9, "z😀" * 9000, 1, 1)], "doc_id long, text string, __h int, fingerprint int")
    rows = [(r.doc_id, r.n_chars) for r in sketches.edited_fingerprints(df).collect()]
    assert sorted(rows, key=str) == sorted([(None, 40), (None, 0), (1, 50), (1, 1), (5, 0), (9, 18_000)], key=str)
    assert sketches.edited_fingerprints(df.limit(0)).count() == 0
    alone = sketches.edited_fingerprints(df.where("doc_id = 9")).first()
    assert alone.near_next == 1 and sketches.fingerprints(df.where("doc_id = 9")).first().fingerprint == alone.fingerprint


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != x)))
        row = now
    return min(row)


def test_passages_within_the_budget_are_found(spark, texts):
    rng = random.Random(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index, hosts = decontamination.build(items), [t for t in texts.values() if 200 < len(t) < 700][:20]
    plain = lambda t: "".join(map(chr, decontamination.normal(t)[0]))
    for _ in range(30):
        key, text = rng.choice(items)
        changed = list(text)
        for _ in range(rng.randrange(int(len(text) * 0.1) + 1)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(2)] = rng.choice(["x", "", "q "])
        host = rng.choice(hosts)
        at = rng.randrange(len(host))
        whole = f"{host[:at]} {''.join(changed)} {host[at:]}"
        least, budget = least_edits(plain(text), plain(whole)), int(len(plain(text)) * decontamination.RATE)
        found = {index.items[i]: edits for i, _, _, edits in decontamination.matches(index, whole)}
        assert found.get(key) == (least if least <= budget else None)


def edits_of(items, text):
    """Least edits between each item and any passage of a text, by the whole matrix, a column at a time for all items."""
    width = max(map(len, items))
    grid = np.full((len(items), width), -1, np.int64)
    for i, x in enumerate(items):
        grid[i, : len(x)] = [ord(c) for c in x]
    ends, rows, steps = np.array([len(x) for x in items]), np.arange(len(items)), np.arange(width + 1)
    cost = np.tile(steps, (len(items), 1))
    best = cost[rows, ends]
    for c in text:
        now = np.zeros_like(cost)
        now[:, 1:] = np.minimum(cost[:, :-1] + (grid != ord(c)), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(now - steps, 1) + steps
        best = np.minimum(best, cost[rows, ends])
    return best


def test_decontamination_equals_brute_force(spark, texts):
    """Both ways: a row for each document and item within the budget or with a verbatim part of 160 characters, and no other."""
    rng = random.Random(31)
    plain = lambda t: "".join(map(chr, decontamination.normal(t)[0]))
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "shorter"), (901, "word for word"), (902, "".join(rng.choice("abcdefghij ") for _ in range(700)).strip())]
    hosts = [t for t in texts.values() if len(t) < 500][:80]
    docs = [t for t in texts.values() if any(i[1][:40] in plain(t) for i in items) and len(t) < 3000][:20]
    for i in range(80):
        text, host = items[rng.randrange(len(items))][1], hosts[i]
        part = text[(at := rng.randrange(max(1, len(text) // 3))) : at + rng.randrange(40, len(text) + 200)]
        changed = list(part)
        for _ in range(rng.randrange(int(len(part) * 0.1) + 1)):
            changed[(at := rng.randrange(len(changed))) : at + rng.randrange(2)] = rng.choice(["x", "", "q "])
        docs.append(f"{host[: len(host) // 2]} {''.join(changed)} {host[len(host) // 2 :]}")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    windows = {k: [t[a : a + 512] for a in sorted({*range(0, max(len(t) - 512, 0), 256), max(len(t) - 512, 0)})] for k, t in items}
    probes = [(k, w) for k, own in windows.items() for w in own]
    allowed = np.array([min(int(len(w) * 0.08), max((len(w) - 11) // 8, 0)) for _, w in probes])
    want = set()
    for d, text in enumerate(map(plain, docs)):
        want |= {(d, probes[i][0]) for i in np.flatnonzero(edits_of([w for _, w in probes], text) <= allowed)}
        want |= {(d, k) for k, t in items if any(t[a : a + 160] in text for a in range(len(t) - 159))}
    assert got == want and len(want) > 25


def test_decontamination_query_finds_whole_items(spark, texts):
    rows = queries.QUERIES["op2_decontamination"](spark, SF).collect()
    plain = {k: "".join(map(chr, decontamination.normal(t)[0])) for k, t in texts.items()}
    items = {r.item_id: "".join(map(chr, decontamination.normal(r.text)[0])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in plain.items() for i, p in items.items() if p in t}
    assert exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        passage = "".join(map(chr, decontamination.normal(texts[r.doc_id][r.start : r.end])[0]))
        assert abs(len(passage) - len(items[r.item_id])) <= r.edits and r.edits <= len(items[r.item_id]) * decontamination.RATE


def test_passages_in_any_segment(monkeypatch):
    """Long texts are searched in segments, also where a gram is frequent in both text and benchmark."""
    rng = random.Random(32)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(i, letters(300)) for i in range(20)] + [(20 + i, "and so on, " * 3 + letters(250)) for i in range(300)]
    index = decontamination.build(items)
    text = " ".join(f"{letters(rng.randrange(3000))} {items[i][1]}" for i in range(20)) + " and so on, " * 20_000 + items[100][1]
    whole = decontamination.matches(index, text)
    assert {index.items[i] for i, *_ in whole} == {*range(20), 100}
    monkeypatch.setattr(decontamination, "SEGMENT", 5000)
    monkeypatch.setattr(decontamination, "PAIRS", 100_000)
    assert decontamination.matches(index, text) == whole


def test_decontamination_of_odd_rows(spark, docs, monkeypatch):
    long = "word number " + " ".join(f"w{i}" for i in range(400))
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "exactly these words here"), (5, "Exactly these words here"), (6, long)], "item_id long, text string")
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "so EXACTLY\n these  words here.", 1), (None, long[200:1300], 1), (4, "exactly those wards hire", 1), (3, "so EXACTLY\n these  words here.", 1)], "doc_id long, text string, item_id int")
    expected = [("3", 4, 0), ("3", 4, 0), ("3", 5, 0), ("3", 5, 0), ("None", 6, 0)]
    for size in (2_000_000, 500):  # one index or several
        monkeypatch.setattr(decontamination, "INDEX_CHARS", size)
        found = sorted((str(r.doc_id), r.item_id, r.edits) for r in decontamination.contaminated(df, bench).collect())
        assert found == expected
        assert sorted(str(r.doc_id) for r in decontamination.drop_contaminated(df, bench).collect()) == ["1", "2", "4"]
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_verbatim_parts_of_items_are_found():
    """Three quarters of an item of 300 characters, and 160 characters of a long one from any place; 159 are no passage."""
    rng = random.Random(15)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    middle, long = letters(300), letters(1500)
    index = decontamination.build([("middle", middle), ("long", long)])
    for item, key, size in ((middle, "middle", 225), (long, "long", 160), (long, "long", 400)):
        for at in range(0, len(item) - size + 1, 7):
            host = f"{letters(90)} - {item[at : at + size]} - {letters(90)}"
            assert [(index.items[i], e) for i, _, _, e in decontamination.matches(index, host)] == [(key, 0)]
    (_, start, end, _), = decontamination.matches(index, host)
    assert item[at : at + size] in host[start:end] or host[start:end] in item and end - start >= 160
    assert decontamination.matches(index, f"{letters(90)} - {long[700:859]} - {letters(90)}") == []


def test_short_items_are_searched_exactly(spark, docs):
    bench = spark.createDataFrame([(1, "\u7b54\u6848\u662f\u4e00\u767e\u4e8c\u5341"), (2, "Forty 2"), (3, " "), (4, "of  A")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x\u7b54\u6848\u662f\u4e00\u767e\u4e8c\u5341y"), (2, "it is forty\n2"), (3, "forty two"), (4, "of a"), (5, "")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontamination.contaminated(df, bench).collect())
    assert rows == [(1, 1, 1, 8, 0), (2, 2, 6, 13, 0), (4, 4, 0, 4, 0)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(df, bench).collect()) == [3, 5]


def test_repetitive_texts_are_no_passages():
    index = decontamination.build([(1, "are there any words that are in it, are there")])
    assert decontamination.matches(index, "are there, " * 500) == []


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() > 0.99 and (got.predicted == got.quality).mean() > 0.98


def test_quality_of_odd_rows(spark, docs):
    df = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "a b", 1.0), (2, "!" * 100_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (7, 0)], "doc_id long, quality int")
    rows = quality.classify(df, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and sum(r.held_out for r in rows if r.doc_id is None) == 1
    assert len({r.score for r in quality.classify(df, labels.limit(0)).collect()}) >= 1
    assert quality.classify(df.limit(0), labels).count() == 0
    assert quality.drop_rejected(df, labels).columns == df.columns


def test_fit_equals_the_plain_solution(spark, docs):
    """Ridge by least squares on all rows at once, and isotonic levels by their min-max formula."""
    rng = np.random.default_rng(41)
    x = rng.normal(size=(900, quality.FEATURES)).astype(np.float32).astype(float)
    y, late = (x[:, 0] + rng.normal(size=900) > 0).astype(float), rng.random(900) < 0.25
    df = spark.createDataFrame([(list(map(float, a)), float(b), bool(c)) for a, b, c in zip(x, y, late)], "x array<float>, y double, calibrates boolean").repartition(5)
    model = quality.fit(df)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    phi = np.concatenate([np.cos(z @ model.frequency + model.phase) * np.sqrt(2 / quality.COSINES), z / 10, np.ones((900, 1))], 1)
    penalty = np.sqrt(quality.PENALTY * 900 + 1e-6) * np.eye(phi.shape[1])
    weight = np.linalg.lstsq(np.r_[phi[~late], penalty], np.r_[y[~late], np.zeros(len(penalty))], rcond=None)[0]
    assert np.allclose(model.raw(x), phi @ weight, atol=1e-6)
    order = np.argsort(model.raw(x[late]), kind="stable")
    label = y[late][order]
    n = len(label)
    mean = lambda a, b: label[a : b + 1].mean()
    best = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert np.allclose(sorted(set(np.round(best, 9))), model.levels) and len(model.knots) == len(model.levels)


def test_no_repeated_id_outgrows_the_fit(spark, docs):
    """An id of a third of all rows is one row of the fit; scores depend on texts alone."""
    df = spark.createDataFrame([(1, f"text {i} of many") for i in range(200)] + [(i, f"good words {i}.") for i in range(2, 400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)] + [(1, 0)] * 50, "doc_id long, quality int")
    rows = quality.classify(df, labels).collect()
    assert len(rows) == 598 and quality.drop_rejected(df, labels).count() == sum(r.predicted for r in rows)


def test_isotonic():
    knots, levels = quality.isotonic(np.array([3.0, 1, 2, 4, 0]), np.array([1.0, 1, 0, 1, 0]))
    assert (np.diff(levels) > 0).all() and levels[0] == 0 and levels[-1] == 1 and 0.5 in levels and len(knots) == len(levels)
