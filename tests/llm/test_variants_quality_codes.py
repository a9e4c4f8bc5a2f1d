"""Operators 11 to 13 against brute force, with nulls, empty tables, ties, repeated rows, clashing names and very long words."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import quality, queries, spelling, vectorcodes


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(count, ratio=10):
    out = {}
    for w, n in count.items():
        others = [(-count[o], o) for o in count if near(w, o)]
        best = min(others, default=None)
        ok = best is not None and -best[0] >= ratio * n
        out[w] = (best[1] if ok else None, n, len(others), -best[0] if ok else None)
    for w in list(out):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("most_bytes", [32 << 20, 2048])  # one group of filters, and many
def test_variants_against_all_pairs(spark, most_bytes):
    rng = random.Random(1)
    count = {}
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
        count[w] = rng.choice([2, 2, 20, 20, 200, 2000])
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcÿ") + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:]])
            if v:
                count[v] = rng.choice([2, 3, 25, 300])
    count |= {"x" * 70: 2, "x" * 71: 900, "y" * 128: 30, "y" * 129: 2, "y" * 128 + "z": 300, "z" * 3000: 5, "z" * 1500 + "a" + "z" * 1499: 50, "z" * 3001: 50}
    table = spark.createDataFrame([(w, n, "clash") for w, n in count.items()] + [(None, 4, "c")], "word string, n long, form string")
    assert rows_of(spelling.group_variants(table, most_bytes=most_bytes)) == brute_variants(count)


def test_no_words_no_variants(spark):
    table = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(table).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short words 1234567 aaaaaaa")], "doc_id long, text string")
    assert spelling.group_variants(spelling.vocabulary(docs)).count() == 0


def test_a_group_of_filters_keeps_within_its_bytes():
    sizes = {7: 5_000_000, 8: 10, 9: 400_000, 70: 3}
    groups = spelling.layout(sizes, 1 << 20)
    assert max(len(g.bits) for g in groups) * 8 <= 1 << 20 and len(groups) > 10
    for s in sizes:
        assert sum(int((g.base[s] >= 0).sum()) for g in groups) == groups[0].slices[s]


def test_op11_counts_and_planted_misspellings(spark, tmp_path):
    rng = random.Random(4)
    words = ["kindness", "Streets", "ÉTOILEéé", "ßberlin", "mountain", "mountains", "fountain", "abcdefgh", "sixsix"]
    text = lambda: rng.choice([" ", "-", "1"]).join(rng.choice(words) for _ in range(120))
    rows = [(i, text(), 5) for i in range(60)] + [(60, None, 1), (61, "", 1), (62, "kindnes × kindnes÷", 1), (None, "streets " * 3, 1), (3, "kindness", 2), (3, "kindness", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, word int").write.parquet(f"{tmp_path}/documents.parquet")
    count = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = brute_variants({w: n for w, n in count.items() if len(w) >= 7 and n >= 2})
    assert any(v[0] for v in want.values())
    assert rows_of(queries.op11_spelling(spark, str(tmp_path))) == want


def test_op11_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = queries.op11_spelling(spark, small).select("word", "form", "root", "n", "n_near", "form_n").collect()
    twin = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.oracle_sql()['op11_spelling']})").fetchall()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(twin, key=lambda r: r[0]) and twin


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, label, vector), sorted by id."""
    v = [(i, lab, [int(np.floor(scale * float(np.float64(x)))) for x in vec]) for i, lab, vec in rows]
    width = len(v[0][2]) // parts
    cut = [[x[2][p * width : (p + 1) * width] for x in v] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda a, book: min((off(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for a in cut[p]:
                groups.setdefault(find(a, books[p])[1], []).append(a)
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[find(cut[p][i], books[p]) for p in range(parts)] for i in range(len(v))]
    total = Counter()
    for (_, lab, _), f in zip(v, found, strict=True):
        total[lab] += sum(x[0] for x in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), sum(o for o, _ in f), total[lab], sha) for (i, lab, _), f in zip(v, found, strict=True))


def test_codes_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), None if i % 9 == 0 else int(i % 3), [float(x) for x in rng.integers(-3, 4, 8) / 8]) for i in range(400)]
    rows[300:330] = [(i, 1, rows[5][2]) for i in range(300, 330)]
    rows[350:400] = [(i, 2, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(350, 400)]
    unused = [(500, 1, None), (501, 1, []), (502, 1, [None] * 8), (503, 1, [float("nan")] + [0.0] * 7), (504, 1, [0.0] * 7 + [float("-inf")])]
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows + unused if r[0] != 501], "vec_id long, label int, embedding array<double>, code string, error int")
    table.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op13_vector_codes(spark, str(tmp_path)).collect())
    assert got == brute_codes(rows)
    codes, books = vectorcodes.compress(table, entries=5, rounds=2)
    assert sorted((r.vec_id, r.code, r.error, r.label_error, books.sha256()) for r in codes.collect()) == brute_codes(rows, entries=5, rounds=2)
    back = vectorcodes.decode(codes, books).join(table.select("vec_id", "embedding"), "vec_id").collect()
    for r in back:
        assert r.error == sum((int(np.floor(1024 * x)) - y) ** 2 for x, y in zip(r.embedding, r.vector, strict=True))


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, label int, embedding array<double>"
    assert vectorcodes.compress(spark.createDataFrame([], kind))[0].count() == 0
    rows = [(1, 1, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, 1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, 1, [1e300, -1e300, 0.0, 0.0, 0.0]), (3, None, [1.0]), (None, 4, [0.0] * 5)]
    codes, books = vectorcodes.compress(spark.createDataFrame(rows, kind))
    got = {(r.vec_id, r.label): (r.code, r.error, r.label_error) for r in codes.collect()}
    assert got == {(1, 1): ("00000000", 0, 0), (2, 1): ("02020200", 0, 0), (3, None): (None, None, None), (None, 4): ("03020200", 0, 0)}
    assert books.dims == 5 and codes.count() == 5
    empty, _ = vectorcodes.compress(spark.createDataFrame([(1, 1, []), (2, 1, [])], kind))
    assert sorted(tuple(r) for r in empty.collect()) == [(1, 1, "00000000", 0, 0), (2, 1, "00000000", 0, 0)]


@pytest.mark.parametrize("n, depth, entries, top", [(1, 3, 2, 4), (700, 4, 9, 2), (600, 16, 64, 300), (300, 1, 7, 1 << 27), (5000, 2, 3, 60)])
def test_trie_walk_is_brute_force(n, depth, entries, top):
    rng = np.random.default_rng(n)
    rows = np.unique(rng.integers(-top, top, (n, depth)), axis=0)
    book = rng.integers(-top, top, (entries, depth))
    entry, error = vectorcodes.nearest(rows, book, block=64)
    full = ((rows[:, None] - book) ** 2).sum(2)
    assert (entry == full.argmin(1)).all() and (error == full.min(1)).all()


def junk(rng, words):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w for w in rng.sample(words, 8) for _ in range(12))
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in rng.choices(words, k=60))
    return " | ".join(rng.choices(words, k=50))


def test_quality_learns_from_positives_alone(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    good = lambda: ". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(rng.randrange(3, 12))) + "."
    truth = {i: rng.random() < 0.7 for i in range(900)}
    docs = spark.createDataFrame([(i, good() if y else junk(rng, words), 3) for i, y in truth.items()] + [(None, good(), 1), (7000, None, 1), (7001, "", 1), (5, good(), 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in truth.items() if i % 2] + [(None, 1, 0), (5, None, 1), (9, 1 - int(truth[9]), 0), (7, int(truth[7]), 0)], "doc_id long, quality int, x int")
    held = {r.doc_id for r in labels.where(quality.held_out(F.col("doc_id"))).collect()}
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    assert trusted == {i for i, y in truth.items() if i % 2 and y and i not in held and i != 9}
    assert {i for i in held} == {i for i in truth if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}
    found, model = quality.quality(docs, labels)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == 904 and all(0 <= s <= 1 for _, s in got)
    assert abs(model.prior - 0.7) < 0.1
    score = {i: s for i, s in got if i is not None and i < 7000}
    right = [(score[i] >= 0.3) == y for i, y in truth.items() if i not in (5,) and i not in trusted]
    assert sum(right) >= 0.97 * len(right)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality(docs, none)[0].collect()] == [0.5, 0.5]
    assert quality.quality(docs.limit(0), none)[0].count() == 0


def test_long_texts_have_the_vector_of_the_whole():
    rng = random.Random(2)
    text = " ".join(rng.choice(["abc", "De", "!!", "é1", "x" * 40]) for _ in range(9000)) + "\nlast line"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = quality.vectors(data, np.array([0, len(data), len(data)]))
    small = list(quality._pieces(data, 1000))
    assert small[0][0] == 0 and small[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(small, small[1:], strict=False))
    wide = quality._pieces
    try:
        quality._pieces = lambda d: wide(d, 1000)
        parts = quality.vectors(data, np.array([0, len(data)]))
    finally:
        quality._pieces = wide
    own = slice(quality.WIDTH - quality._OWN, quality.WIDTH)
    assert np.abs(np.delete(whole[0], quality.WIDTH - 2)[: quality.WIDTH - quality._OWN] ** 2 - np.delete(parts[0], quality.WIDTH - 2)[: quality.WIDTH - quality._OWN] ** 2).max() < 0.002
    assert np.allclose(whole[0][own][[0, 1, 2, 4, 7]], parts[0][own][[0, 1, 2, 4, 7]]) and not whole[1].any()
    assert list(quality._pieces(np.full(5000, 120, np.uint8), 1000)) == [(0, 5000)]


def test_op12_on_held_out_rows(spark, small):
    found = queries.op12_quality(spark, small)
    rows = found.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 200
    own = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in own) >= 0.8 * len(own) and all(r.predicted == (r.score >= 0.3) for r in rows)
