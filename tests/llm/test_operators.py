"""Each numbered operator against a brute-force version, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import pathlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import kdtree, language, licenses, mixing, near_dup, positional, secrets, sieve, substrings, urlfilter, wordpiece
from tidepanel.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"


def docs(spark, rows):
    """Rows (id, text[, lang, source]); ``size`` is an extra column whose name clashes."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 7) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(n, seed, size=40):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_top_k_against_all_scores(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-5, 6, (120, 3)).astype(float)
    v[60:90] = v[60]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(500, None), (3, v[3].tolist())], "id long, v array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree.top_k(rows, rows.where("id % 20 = 0"), 5, shard_rows=40).collect()}
    for q in range(0, 120, 20):
        best = sorted(((-(v[q] @ v[i]), i) for i in range(120) if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert kdtree.top_k(rows.limit(0), rows, 5).count() == 0


def test_top_k_finds_repeated_ids_once(spark):
    best = {i: [100.0 - i, 1.0] for i in range(12)}
    rows = [(i, v) for i, v in best.items()] + [(0, best[0])] * 9 + [(i, [50.0, 0.0]) for i in (20, 20, 20, 20, 20, 20, 20, 21, 22)] + [(1, [3.0, 9.0]), (2, [200.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([(900, [1.0, 0.0]), (901, [-1.0, 0.0]), (901, [-1.0, 0.0]), (902, [0.0, 1.0])], "id long, v array<double>")
    for shard_rows in (1000, 8):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kdtree.top_k(table, asked, 5, shard_rows=shard_rows).collect())
        for q, w in ((900, (1, 0)), (901, (-1, 0)), (902, (0, 1))):
            score = {}
            for i, v in rows:
                score[i] = max(score.get(i, -(10**9)), int(w[0] * v[0] + w[1] * v[1]))
            expected = sorted((-s, i) for i, s in score.items())[:5]
            assert [r for r in got if r[0] == q] == [(q, k + 1, i, -s) for k, (s, i) in enumerate(expected)]


def test_top_k_edges(spark, tmp_path, monkeypatch):
    from tidepanel.llm import queries

    rng = np.random.default_rng(5)
    v = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(300)}
    table = spark.createDataFrame([(i, x, 7) for i, x in v.items()], "id long, v array<double>, score int")
    monkeypatch.setattr(kdtree, "BOX_BYTES", 300)  # boxes in many rounds
    got = [tuple(r) for r in kdtree.top_k(table, table.where("id % 7 = 0"), 5, shard_rows=16, query_rows=10, sample_rows=90).collect()]
    want = [(q, n + 1, i, int(s)) for q in range(0, 300, 7) for n, (s, i) in enumerate(sorted(((np.dot(v[q], v[i]), i) for i in v if i != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(got) == want
    assert kdtree.top_k(table, table.limit(0)).count() == kdtree.top_k(table.limit(0), table).count() == 0
    mixed = spark.createDataFrame([(1, []), (2, []), (3, [1.0]), (4, [2.0]), (None, [3.0]), (5, [1.0, 2.0])], "id long, v array<double>")
    assert sorted(tuple(r) for r in kdtree.top_k(mixed, mixed).collect()) == [(1, 1, 2, 0), (2, 1, 1, 0), (3, 1, 4, 2), (4, 1, 3, 2)]

    raw = [(0, [0.5, -0.001]), (50, [float("nan"), 1.0]), (100, [1.0, 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [0.25, 0.999]), (7, [0.25, 0.9999])]
    spark.createDataFrame(raw, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op1_top_k(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 100, 128 * 256 - 256), (0, 2, 6, 128 * 64 - 255), (0, 3, 7, 128 * 64 - 255), (100, 1, 6, 256 * (64 + 255)), (100, 2, 7, 256 * (64 + 255)), (100, 3, 0, 256 * 127)]


def test_license_forms(spark):
    text = licenses.KNOWN["MIT"][0]
    wrap = lambda t: re.sub(r"(.{50,70}) ", r"\1\n", t)
    heads = ("Copyright (c) 2020 Some One\n", "Copyright © 2020 Jo\n", "© 2020-2021 Jo\n", "(c) 2019 Jo\n", "Copyright Jo Doe 2020\n", "Copyright: Jo Doe\n", " * Copyright (C) Jo\nAll rights reserved.\n\n", "MIT License\n\nCopyright (c) 2020 Jo\n\n")
    rows = [(k, head + wrap(text)) for k, head in enumerate(heads)]
    rows += [(20, text.upper().replace("SUBLICENSE", "sub-\nlicense")), (20, text), (21, "x " + text), (22, None), (23, ""), (24, "a\nLicenced under CC BY-NC 4.0!\nb"), (25, " \n\n\t")]
    rows.append((26, "one paragraph of words " * 2000 + "\nReleased under the MIT License.\n" * 3))
    got = licenses.license_scan(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.kind, r.unit, r.license) for r in got) == [(k, "text", 0, "MIT") for k in [*range(len(heads)), 20, 20]]
    lines = licenses.license_scan(docs(spark, rows), kinds=("line",)).where("doc_id > 20").orderBy("doc_id", "unit").collect()
    assert [(r.doc_id, r.unit, r.license) for r in lines] == [(24, 2, "CC-BY-NC-4.0"), (26, 2, "MIT"), (26, 4, "MIT"), (26, 6, "MIT")]
    assert licenses.license_scan(docs(spark, rows).limit(0)).count() == 0


def test_own_known_table(spark, monkeypatch):
    mine = spark.createDataFrame([("House", "Do as you like."), ("Other name", "do as you LIKE"), ("House", "do as you like")], "license string, text string").select("license", licenses.digest(F.col("text")).alias("digest"))
    want = [(1, "House"), (1, "Other name")]
    for most in (licenses.BROADCAST_ROWS, 1):  # broadcast, and shuffled
        monkeypatch.setattr(licenses, "BROADCAST_ROWS", most)
        got = licenses.license_scan(docs(spark, [(1, "Do as you like!\n")]), mine)
        assert sorted((r.doc_id, r.license) for r in got.collect()) == want
    assert licenses.license_scan(docs(spark, [(1, "Do as you like")]), mine.limit(0)).count() == 0


def test_long_licenses_by_digest(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    rows = [(k, (folder / name).read_text(errors="replace")) for k, name in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0"))]
    rows.append((7, rows[0][1].split("END OF TERMS")[0].replace("Version 2.0, January 2004", "Version 2.0, January 2004 ")))
    got = {r.doc_id: r.license for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert got == {0: "Apache-2.0", 1: "GPL-2.0", 2: "GPL-3.0", 3: "LGPL-2.1", 4: "LGPL-3.0", 5: "MPL-2.0", 6: "CC0-1.0", 7: "Apache-2.0"}


def test_licenses_with_titles_and_in_blocks(spark, tmp_path):
    wrap = lambda t: re.sub(r"(.{50,70}) ", r"\1\n", t)
    rows = [(k, f"{title}\n\nCopyright (c) 2020 Some One\n\n{wrap(licenses.KNOWN[name][0])}\n") for k, (name, title) in enumerate((n, t) for n, ts in licenses.TITLES.items() for t in ts)]
    names = [n for n, ts in licenses.TITLES.items() for _ in ts]
    assert {r.doc_id: r.license for r in licenses.license_scan(docs(spark, rows)).collect()} == dict(enumerate(names))
    docs(spark, [(1, f"a b\n \n{wrap(licenses.KNOWN['ISC'][0])}\n\nc d"), (2, f"{rows[0][1]}\n"), (3, "a\nReleased under the MIT licence\n")]).write.parquet(f"{tmp_path}/documents.parquet")
    from tidepanel.llm import queries

    assert sorted(tuple(r) for r in queries.queries()["op2_license_blocks"](spark, str(tmp_path)).collect()) == [(1, 2, "ISC"), (2, 3, "MIT")]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    twin = con.sql(queries.oracle_sql()["op2_licenses"] + " ORDER BY doc_id").fetchall()
    mine = queries.op2_licenses(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in mine] == twin == [(2, "MIT", 0, ""), (3, None, 1, "MIT")]


@pytest.fixture(scope="module")
def crf(spark, small):
    return secrets.fit(spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame([(-k, f"some words password = {hashlib.sha256(str(k).encode()).hexdigest()[:18]} and more", "en", "s", 0) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")))


def test_base_secrets_and_redaction(spark, crf):
    text = "é Password : \"abc.def1\" x token=abc AKIA" + "A1" * 9 + " " + "ab12" * 7
    got = secrets.scan(docs(spark, [(1, text), (2, None), (3, "")]), crf).orderBy("doc_id").collect()
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 1) and got[1].base_spans == got[2].base_spans == ""
    assert got[0].base_spans.startswith("assign:2:22,access:")
    assert secrets.digest_text(secrets.base_spans(text)) == got[0].base_spans
    spans = F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(4).cast("long").alias("end")), F.struct(F.lit(3).cast("long").alias("start"), F.lit(5).cast("long").alias("end")))
    assert spark.range(1).select(secrets.redacted(F.lit("abcdef"), spans, "#").alias("t")).first().t == "ab#f"


def test_segment_decoding_is_whole_text_decoding(crf):
    rng = random.Random(3)
    for k in range(6):
        text = " ".join(words(200, k)).replace("w", "word") + " password = 0123abcd4567ef89aa and then " + "x" * 400 + "1" + " y" * (k % 3)
        text += " ".join(secrets.drawn_lookalike(rng, ["some", "words"]) + " in a row of plain and quite ordinary words" * (k % 2) for _ in range(9))
        text += f" end {secrets.drawn_secret(rng)[1]}"
        tokens = [t.span() for t in secrets.TOKEN.finditer(text)]
        found = list(secrets.segments(text))
        assert all(t in set(tokens) for s in found for t in s)
        of_whole = dict(zip(tokens, crf.scores(secrets.features(text, tokens, secrets.file_features(text))), strict=True))
        active = {t for s in found for t in s}
        held = np.array([of_whole[t] if t in active else [-1e9, -1e9, 0.0] for t in tokens])
        labels, spans = secrets.viterbi(held, crf.move), []
        for (a, b), y in zip(tokens, labels, strict=True):
            if y == secrets.BEGIN or y == secrets.INSIDE and not spans:
                spans.append((a, b))
            elif y == secrets.INSIDE:
                spans[-1] = (spans[-1][0], b) if before != secrets.OUTSIDE else spans[-1]
                if before == secrets.OUTSIDE:
                    spans.append((a, b))
            before = y
        assert secrets.crf_spans(text, crf) == [(a, a + len(text[a:b].rstrip("."))) for a, b in spans]
        assert any("0123abcd4567ef89aa" in text[a:b] for a, b in spans)


def test_substring_dedup_leaves_no_shuffle_files(spark, small):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count(".data")
    table = spark.read.parquet(f"{small}/documents.parquet")
    spark._jvm.System.gc()
    before = files()
    assert substrings.substring_dedup(table).count() == table.count()
    assert files() <= before


def test_every_token_of_a_text_is_decoded():
    rng, draw = random.Random(7), np.random.default_rng(7)
    bits = ["plain", "words", "HunterTwoBlueSky", "A", "x1", "=", ":", "a_b", "Z" * 30, "pass", ".", "'q'", "\n"]
    tagged = 0
    for k in range(200):
        text = "".join(rng.choice(bits) + rng.choice((" ", " ", "  ", "")) for _ in range(rng.randrange(60)))
        tokens = [t.span() for t in secrets.TOKEN.finditer(text)]
        feats = secrets.features(text, tokens, secrets.file_features(text)) if tokens else []
        names = sorted({f for own in feats for f in own}) or ["bias"]
        emit = draw.normal(size=(len(names), 3)) / 2
        emit[:, secrets.OUTSIDE] += draw.random() / 3
        model = secrets.CRF({f: i for i, f in enumerate(names)}, emit, draw.normal(size=(3, 3)))
        spans, before = [], secrets.OUTSIDE
        for (a, b), y in zip(tokens, secrets.viterbi(model.scores(feats), model.move) if tokens else [], strict=True):
            if y == secrets.BEGIN or y == secrets.INSIDE and before == secrets.OUTSIDE:
                spans.append((a, b))
            elif y == secrets.INSIDE:
                spans[-1] = (spans[-1][0], b)
            before = y
        assert secrets.crf_spans(text, model) == [(a, a + len(text[a:b].rstrip("."))) for a, b in spans]
        tagged += len(spans)
        if tokens:
            bounds, scores = secrets.token_scores(text, model)
            assert bounds.tolist() == [list(t) for t in tokens] and np.allclose(scores, model.scores(feats))
    assert tagged > 500
    text = "some quite plain words of prose before HunterTwoBlueSky and many more plain words of prose behind it"
    model = secrets.CRF({"s:aA16v2": 0, "bias": 1}, np.array([[9.0, 0.0, 0.0], [0.0, 0.0, 2.0]]), np.zeros((3, 3)))
    assert list(secrets.segments(text)) == [] and [text[a:b] for a, b in secrets.crf_spans(text, model)] == ["HunterTwoBlueSky"]


def test_model_finds_secrets_that_no_pattern_knows(spark, small, crf):
    rng = random.Random(12345)
    prose = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(150).collect()]
    prose = [t for t in prose if not secrets.base_spans(t)]
    hits = asked = false = clean = 0
    for t in prose:
        clean += len(secrets.crf_spans(t, crf)) > 0
        for _ in range(3):
            at = t.index(" ", rng.randrange(len(t) // 2))
            lead, value = secrets.drawn_secret(rng)
            made = f"{t[:at]} {lead}{value} {t[at + 1 :]}"
            start = at + 1 + len(lead)
            if not secrets.base_spans(made):
                asked += 1
                hits += any(a <= start + 2 and b >= start + len(value) - 2 for a, b in secrets.crf_spans(made, crf))
            false += len(secrets.crf_spans(f"{t[:at]} {secrets.drawn_lookalike(rng, ['abc', 'words'])} {t[at + 1 :]}", crf)) > 0
    print("recall", hits, asked, "false", false, 3 * len(prose), "clean texts tagged", clean)
    assert hits >= 0.9 * asked and false <= 0.03 * 3 * len(prose) and clean <= 0.01 * len(prose)


def test_base_spans_by_an_independent_pass(spark, crf):
    rng = random.Random(8)
    bits = ["password", "Token", "api_key", "APIkey", " = ", ":", "\"", "'", "abc.d", "AKIA", "Z" * 16, "AB12" * 5, "0f" * 12, "é", " ", "\n", "secret=\"x+/y_=.-9\"", "passwd  :  ", "\t=", "a" * 24]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for k in range(120)] + [(200, "z " * 60_000 + "token=abcdef1"), (7, None), (201, "x")]

    def brute(text):
        out = []
        for kind, pattern, least, group in (("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
            out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
        return ",".join(x[2] for x in sorted(out))

    table = docs(spark, rows).withColumn("n_hex", F.lit("clash")).withColumn("secret_spans", F.lit(1))
    got = sorted((r.doc_id, r.base_spans, r.n_assign + r.n_access + r.n_hex) for r in secrets.scan(table, crf).collect())
    assert got == sorted((i, brute(t or ""), brute(t or "").count(":") // 2) for i, t in rows)


def test_every_trigger_extends_its_stretch():
    tokens = lambda text: {text[a:b] for s in secrets.segments(text) for a, b in s}
    for text in ("the old user password HunterTwoBlueSky", "id 7 then the old user password HunterTwoBlueSky", "some words key HunterTwoBlueSky", "some words: HunterTwoBlueSky"):
        assert "HunterTwoBlueSky" in tokens(text)
    text = " ".join(f"word{'' if k % 40 else k}" for k in range(200))
    whole = [t.span() for t in secrets.TOKEN.finditer(text)]
    of_whole = dict(zip(whole, secrets.features(text, whole, ()), strict=True))
    found = list(secrets.segments(text))
    assert len(found) > 3 and all(f == of_whole[t] for s in found for t, f in zip(s, secrets.features(text, s, ()), strict=True))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    paths = [[int(c) for c in np.base_repr(k, 3).zfill(6)] for k in range(3**6)]
    score = lambda p: sum(emit[i, y] for i, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))
    assert secrets.viterbi(emit, move) == max(paths, key=score)


def test_url_filter_as_of(spark):
    pages = spark.createDataFrame([(1, "https://u@A.x.com:80/p", "2024-01-05"), (2, "http://a.x.com/", "2024-01-20"), (3, "http://b.x.com", "2024-01-05"), (4, None, "2024-01-05"), (5, "nope", None), (3, "http://b.x.com", "2024-01-05")], "page_id long, url string, d string").withColumn("day", F.to_date("d"))
    lists = spark.createDataFrame([("l", "x.com", "block", "2024-01-01"), ("l", "x.com", "allow", "2024-01-10"), ("m", "a.x.com", "allow", "2024-01-05"), (None, "x.com", "block", "2024-01-01")], "list string, domain string, action string, d string").select("list", "domain", "action", F.to_date("d").alias("day"))
    got = sorted((r.page_id, r.host, r.n_active, r.verdict, r.matched) for r in urlfilter.url_filter(pages, lists).collect())
    assert got == [(1, "a.x.com", 2, "allow", "m:a.x.com"), (2, "a.x.com", 2, "allow", "m:a.x.com"), (3, "b.x.com", 1, "block", "l:x.com"), (3, "b.x.com", 1, "block", "l:x.com"), (4, "", 0, "allow", ""), (5, "", 0, "allow", "")]


def test_language_on_held_out_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(rows.where(~held).select("doc_id", "text", "lang"))
    got = language.predict(rows.where(held), model)
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs(spark, [(1, None), (2, ""), (3, "12 %% \u00bd\u2167"), (4, "the and of")]), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[4][0] in model.languages
    piece, language.PIECE = language.PIECE, 7
    try:  # cut texts score as whole ones
        cut = language.scores(model, ["the quick brown fox jumps", "é"])
    finally:
        language.PIECE = piece
    assert np.allclose(cut, language.scores(model, ["the quick brown fox jumps", "é"]), rtol=1e-5)


def brute_windows(rows, n):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        own = {tuple(w[k : k + n]): None for k in range(len(w) - n + 1)}
        gone = {j for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in seen for j in range(k, k + n)}
        seen |= set(own)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("window", [5, 12])
def test_repeated_windows(spark, window):
    base = words(200, 2, 500)
    rows = [(k, " ".join(words(60, 10 + k, 500) + base[3 * k : 3 * k + 20 + k] + words(9, 50 + k, 500))) for k in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, None), (23, ""), (24, "a " * 60), (25, "a " * 40), (26, " ".join(base))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(docs(spark, rows), window).collect()}
    assert got == brute_windows(rows, window)


def test_a_passage_in_every_text(spark):
    passage, window = words(14, 77, 500), 5
    rows = [(k, " ".join(words(9, 300 + k, 500) + passage + words(k % 4, 400 + k, 500))) for k in range(40)] + [(50, " ".join(words(20_000, 6, 4000)))]
    table = docs(spark, [*rows, (None, rows[0][1]), (None, None), (7, rows[7][1])])
    found = substrings.substring_dedup(table, window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found if r.doc_id is not None} == brute_windows(rows, window)
    assert len(found) == len(rows) + 3 and all(r.n_removed == 0 for r in found if r.doc_id is None)


def brute_groups(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark):
    base, rng = words(80, 3, 900), random.Random(4)
    rows = [(k, " ".join(words(30, 100 + k, 900))) for k in range(15)]
    for k in range(60):  # one large bucket of near copies, more or less changed
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"z{rng.randrange(99)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300, rows[0][1].upper()), (301, None), (302, "  "), (303, "Two words"), (304, "two WORDS")]
    rows += [(305, "long " * 5 + " ".join(words(30_000, 8, 9000)))]
    p = near_dup.NearDup(shingle=3, percent=85, bands=22, small=4, block=16)
    table = docs(spark, [*rows, (None, rows[0][1]), (None, None), (5, rows[5][1])])
    found = near_dup.near_duplicates(table, p).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None}
    assert got == brute_groups(rows, 3, 85) and len(found) == len(rows) + 3
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)] * 2
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_near_duplicates_of_texts_without_words(spark):
    found = near_dup.near_duplicates(docs(spark, [(k, " " if k % 2 else None) for k in range(9)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == [(k, 0, k, True) for k in range(9)]


def test_one_id_on_two_texts_is_one_document(spark):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    found = near_dup.near_duplicates(docs(spark, [(1, a), (2, b), (1, b), (3, a)])).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1}


def test_components(spark):
    links = [(k, k + 1) for k in range(20)] + [(40, 41), (41, 42), (42, 40), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40, 42: 40}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(rows, items, n, slop):
    """(doc_id, n_words, n_hit, items, near items) of each row, by looking everywhere."""
    windows = {}
    for i, text in items:
        w = item_words(text)
        if i is not None and w:
            for s in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, text in rows:
        w = item_words(text)
        hit, found, near = set(), set(), set()
        for length in {len(q) for q in windows}:
            for s in range(len(w) - length + 1):
                if names := windows.get(tuple(w[s : s + length])):
                    hit |= set(range(s, s + length))
                    found |= names
        for q, names in windows.items() if slop >= 0 and len(w) < 5000 else ():
            if set(q) <= set(w) and any(Counter(q) <= Counter(w[max(0, s) : s + len(q) + slop]) for s in range(1 - len(q) - slop, len(w))):
                near |= names
        out.append((i, len(w), len(hit), tuple(sorted(found)), tuple(sorted(near))))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once, terms_at_once", [(1000, 1000), (3, 1000), (3, 20)])
def test_contamination(spark, at_once, terms_at_once):
    item = words(30, 5, 200)
    items = [(1, " ".join(item)), (2, "Short Item!"), (3, None), (4, "..."), (5, " ".join(item[:19])), (None, " ".join(item)), (6, "alpha beta")]
    rows = [(1, "a b c " + ", ".join(item[4:22]).upper() + " tail"), (2, "x short-item y short item"), (3, None), (4, " ".join(item[:12])), (5, " ".join(words(400, 6, 200))), (1, "no hit")]
    rows += [(6, "one two alpha"), (7, "beta three"), (8, " ".join(item[:6] + ["odd"] + item[6:13])), (None, "short item"), (9, "filler " * 30_000 + "alpha beta"), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = positional.contamination(docs(spark, rows), bench, slop=4, at_once=at_once, terms_at_once=terms_at_once).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near_items)) for r in got), key=str)
    want = brute_contamination(rows, items, 13, 4)
    long = [x for x in got if x[0] == 9]
    assert [x for x in got if x[0] != 9] == [x for x in want if x[0] != 9]
    assert [x[:4] for x in long] == [x[:4] for x in want if x[0] == 9] and long[0][4] == ("6",)
    near = {x[0]: x[4] for x in got}
    assert near[6] == near[7] == () and near[8] == ("1", "5")
    assert all(set(x[3]) <= set(x[4]) for x in got)
    exact = positional.contamination(docs(spark, rows), bench, at_once=at_once).collect()
    assert not any(r.near_items for r in exact)


def test_proximity_is_a_matter_of_the_text_alone(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma", 0), (2, "beta beta", 0)], "item_id long, text string, near_items int")
    asked = [(1, "alpha f f f f f beta gamma"), (2, "alpha f f f beta gamma"), (3, "gamma f beta f f alpha"), (4, "beta f f f f beta"), (5, "beta f f f beta f f f f beta"), (6, "beta gamma"), (7, "gamma alpha beta")]
    others = [[], ["alpha " * 5], ["beta gamma " * 9], ["alpha beta " * 7, "gamma " * 30]]
    for more in others:
        rows = asked + [(100 + k, t) for k, t in enumerate(more)]
        got = {r.doc_id: r.near_items for r in positional.contamination(docs(spark, rows), item, slop=3).collect()}
        assert [got[k] for k in range(1, 8)] == [[], ["1"], ["1"], [], ["2"], [], ["1"]], more


def test_proximity_of_generated_texts(spark):
    rng = random.Random(10)
    items = [(k, " ".join(words(rng.randrange(1, 7), 900 + k, 12))) for k in range(15)]
    rows = [(k, " ".join(words(rng.randrange(0, 40), 950 + k, 12))) for k in range(40)]
    for slop in (0, 2):
        got = positional.contamination(docs(spark, rows).repartition(1), spark.createDataFrame(items, "item_id long, text string"), n=4, slop=slop).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near_items)) for r in got), key=str)
        assert got == brute_contamination(rows, items, 4, slop) and any(len(x[4]) > len(x[3]) for x in got)


def test_op8_digests_against_brute_force(spark, small):
    from tidepanel.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op8_decontamination(spark, small).collect()))
    want = [(i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n) for i, n, hit, found, _ in brute_contamination(rows, items, 13, -1)]
    assert got == sorted(want) and any(x[5] for x in got)


def test_contamination_of_generated_texts(spark):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng.randrange(1, 12), 700 + k, 30))) for k in range(12)]
    rows = [(k, " ".join(words(rng.randrange(0, 60), 800 + k, 30))) for k in range(60)]
    rows += [(100 + k, f"{rows[k][1]} {items[k][1]} {rows[k + 1][1]}") for k in range(12)]
    got = positional.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), n=5).collect()
    want = brute_contamination(rows, items, 5, -1)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == [x[:4] for x in want]


def test_token_counts_are_greedy(spark):
    vocabulary = [b" a", b" ab", b"abc", b"bcd", b"c", b" abcdx", b"\xc3\xa9t"]
    known = {*vocabulary, *(bytes([b]) for b in range(256))}

    def greedy(w):
        n = 0
        while w:
            n, w = n + 1, w[max(k for k in range(1, len(w) + 1) if w[:k] in known) :]
        return n

    rng = random.Random(7)
    rows = [(k, " ".join("".join(rng.choice("abcdxét") for _ in range(rng.randrange(1, 9))) for _ in range(30))) for k in range(9)] + [(20, None), (21, ""), (22, "abcd" * 300)]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(docs(spark, rows), vocabulary).collect()}
    assert got == {i: (len(w := (t or "").encode().split()), sum(greedy(b" " + x) for x in w)) for i, t in rows}


def test_mixing_fills_to_the_caps(spark):
    rows = [(k, " ".join(words(1 + k % 9, k)), "en", ["a", "b", "c", "d", None][k % 5]) for k in range(400)] + [(1, None, "en", "a"), (None, "x y", "en", "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    size = Counter()
    for r in got:
        size[r.source] += r.size
    order = sorted((s for s in size if s), key=str) + [None]
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        goal = 2 * size[s] if s in capped else level * weight[s]
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(goal) and r.source_size == size[s] and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - goal) <= max(r.size for r in own) / 2 + 1e-6
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0 and mixing.mix_rows(docs(spark, rows).limit(0)).count() == 0
    assert all(r.copies <= 2 for r in got)
    whole = mixing.mix_rows(docs(spark, rows))  # its size takes the place of the extra column
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.copies, r.taken)
    assert sorted(map(key, whole.collect())) == sorted(map(key, got))


def test_mixing_of_empty_texts_and_equal_rows(spark):
    rows = [(k, "", "en", "a") for k in range(5)] + [(9, "a b c", "en", "a")] * 40 + [(k, "x " * 30, "en", "b") for k in range(20, 30)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert all(r.copies <= 2 for r in got)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 15 + 1e-6
    nothing = mixing.mix(docs(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert [(r.size, r.taken, r.target) for r in nothing] == [(0, 0, 0.0)] * 2


def test_empty_tables(spark):
    none = docs(spark, [(1, "a")]).limit(0)
    assert substrings.substring_dedup(none).count() == near_dup.near_duplicates(none).count() == 0
    assert positional.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert language.predict(none, language.fit(none)).count() == secrets.scan(none, secrets.fit(none)).count() == 0


def test_pipeline_keeps_and_drops(spark, small):
    import corpus_pipeline as pipeline

    rows = spark.read.parquet(f"{small}/documents.parquet").unionByName(docs(spark, [(10**6, None), (10**6 + 1, "12345"), (10**6 + 2, None)]).drop("size"))
    found = pipeline.identify_language(spark, rows, small)
    assert found.columns == rows.columns and {r.doc_id for r in rows.subtract(found).select("doc_id").collect()} >= {10**6, 10**6 + 1}
    red = pipeline.redact_secrets(spark, docs(spark, [(1, "my password=abcdef123 ok"), (2, "clean")]).drop("size"), small)
    assert {r.doc_id: r.text for r in red.collect()} == {1: "my [SECRET] ok", 2: "clean"}
    assert [n for n, _ in pipeline.STAGES][-1] == "mixing"


def brute_language(text, model):
    """Lang and score of one text, character by character."""
    text = (text or "").lower()
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    codes = [ord(c) if "a" <= c <= "z" or ord(c) >= 0xC0 else 32 for c in text]
    joint = list(model.prior)
    for i in range(len(codes)):
        h = None
        for n in range(min(language.ORDERS, len(codes) - i)):
            x = codes[i + n] * 0x9E3779B1
            h = x % 2**32 if h is None else ((h ^ h >> 15) * 0x85EBCA6B + x) % 2**32
            bucket = ((h ^ h >> 13) * 0xC2B2AE35 % 2**32) >> 17
            for k in range(len(joint)):
                joint[k] += float(model.log_p[k, n * language.BUCKETS + bucket])
    best = max(range(len(joint)), key=lambda k: joint[k])
    return model.languages[best], 1 / sum(np.exp(x - joint[best]) for x in joint)


def test_language_scores_by_brute_force(spark):
    rows = [(k, text, lang) for k, (text, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 3)]
    model = language.fit(docs(spark, [*rows, (50, None, "en"), (51, "x", None)]))
    asked = [(1, "the dog"), (2, "und die"), (3, "LE CHIEN, é!"), (4, "zz"), (5, None), (6, "7"), (7, "a"), (1, "the dog"), (8, "le der the " * 20_000)]
    table = docs(spark, asked).withColumn("lang_pred", F.lit(0)).withColumn("score", F.lit("clash"))
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language.predict(table, model).collect())
    want = sorted((i, *brute_language(x, model)) for i, x in asked if i != 8)
    assert [r[:2] for r in got if r[0] != 8] == [r[:2] for r in want]
    assert [r[2] for r in got if r[0] != 8] == pytest.approx([r[2] for r in want], abs=1e-5)
    tie = language.Model(("a", "b"), np.zeros((2, language.ORDERS * language.BUCKETS), np.float32), np.log([0.5, 0.5]))
    assert [(r.lang_pred, r.score) for r in language.predict(docs(spark, [(1, "word")]), tie).collect()] == [("a", 0.5)]


def brute_mix(rows, weights=(5, 2, 1), share=1.5, epochs=2):
    """(id, source, target, copies) of each row of (id, text, source)."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    order, capped, level = [*sorted(s for s in size if s is not None), *([None] if None in size else [])], set(), 0
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    while len(capped) < len(order):
        level = (share * sum(size.values()) - epochs * sum(size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > epochs * size[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in order:
        target = epochs * size[s] if s in capped else level * weight[s]
        rep, before = target / size[s] if size[s] else 0.0, 0
        for i, text, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            n = len((text or "").split())
            extra = (rep - int(rep)) * size[s]
            out.append((i, s, target, int(rep) + (before + n / 2 <= extra and extra > 0)))
            before += n
    return out


def test_pipeline_against_brute_force(spark, small):
    import corpus_pipeline as pipeline

    table = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    model = language.fit(table.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = {r.doc_id: {**r.asDict(), "lang": lang} for r in table.collect() if (lang := brute_language(r.text, model)[0]) != "und"}
    groups = brute_groups([(i, r["text"]) for i, r in rows.items()], 5, 80)
    rows = {i: r for i, r in rows.items() if groups[i][1] == i}
    hits = {i: (n_words, n_hit) for i, n_words, n_hit, _, _ in brute_contamination([(i, r["text"]) for i, r in rows.items()], bench, 13, -1)}
    rows = {i: r for i, r in rows.items() if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])}
    crf = secrets.fit(spark.createDataFrame(list(rows.values()), table.schema))
    for r in rows.values():
        done, at = [], 0
        for a, _, b in secrets.all_spans(r["text"] or "", crf)[1]:
            if a >= at:
                done += [r["text"][at:a], "[SECRET]"]
            at = max(at, b)
        r["text"] = "".join(done) + (r["text"] or "")[at:] if r["text"] is not None else None
        r["n_chars"] = len(r["text"]) if r["text"] is not None else None
    mixed = {i: (target, copies) for i, _, target, copies in brute_mix([(i, r["text"], r["source"]) for i, r in rows.items()]) if copies}
    found = {r.doc_id: r for r in pipeline.run(spark, small).collect()}
    assert found.keys() == mixed.keys()
    for i, r in found.items():
        assert (r.text, r.lang, r.source, r.n_chars) == tuple(rows[i][c] for c in ("text", "lang", "source", "n_chars"))
        assert r.copies == mixed[i][1] and r.target == pytest.approx(mixed[i][0]) and r.taken == r.copies * len(r.text.split())


def test_pipeline_stages_alone(spark, small):
    import corpus_pipeline as pipeline

    base = words(60, 3)
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "odd"])), (3, None), (None, " ".join(base)), (4, item), (5, "clean words here"), (6, "")]
    table = docs(spark, rows).drop("size")
    left = pipeline.drop_near_duplicates(spark, table, small)
    assert left.columns == table.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "5", "6", "None"]
    left = pipeline.drop_contaminated(spark, table, small)
    assert left.columns == table.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "5", "6", "None"]
    mixed = pipeline.mix_sources(spark, table, small)
    assert {"text", "lang", "source", "copies", "taken"} <= set(mixed.columns) and mixed.where("copies < 1").count() == 0 < mixed.count()
    none = table.limit(0)
    assert all(stage(spark, none, small).count() == 0 for _, stage in pipeline.STAGES)


def test_sieve(spark):
    ids = spark.createDataFrame([(i * 7,) for i in range(500)] + [(None,)], "doc_id long")
    table = spark.createDataFrame([(i, str(i)) for i in range(4000)] + [(None, "x"), (7, "7")], "doc_id long, text string")
    for bits in (15, 18):  # small ones let more through
        left = sieve.without(table, ids).collect()
        assert sorted(r.doc_id for r in left if r.doc_id is not None) == [i for i in range(4000) if i % 7 or i >= 3500]
        assert [r.text for r in left if r.doc_id is None] == ["x"]
        hit = table.where(sieve.sieve(ids, "doc_id", bits)(F.col("doc_id"))).select("doc_id").distinct().count()
        assert 501 <= hit < 4000
    assert sieve.without(table, ids.limit(0)).count() == 4002 and sieve.without(table.limit(0), ids).count() == 0


def test_texts_scored_together_are_scored_as_alone():
    """op3_secrets scores runs of texts at once: by the features of every token, whatever texts lie beside, in code points."""
    rng, draw = random.Random(11), np.random.default_rng(11)
    bits = ["plain", "HunterTwoBlueSky", "A", "x1", "=", ":", "a_b", "Z" * 30, "pass", "toKen", ".", "'q'", "\n", "é", "日本", "0f" * 9, "0F" * 9, "aB9/" * 11, "aeiou-xyz9", "q" * 70, "9.8.7+6", "to", "ken", "v1-Beta.22"]
    texts = ["".join(rng.choice(bits) + rng.choice((" ", " ", "")) for _ in range(rng.randrange(40))) for _ in range(150)] + ["", "to", "ken", "=", "x" * 5000 + "key"]
    wide = [[t.span() for t in secrets.TOKEN.finditer(t)] for t in texts]
    feats = [secrets.features(t, b, secrets.file_features(t)) if b else [] for t, b in zip(texts, wide, strict=True)]
    names = sorted({f for own in feats for fs in own for f in fs})
    model = secrets.CRF({f: i for i, f in enumerate(names)}, draw.normal(size=(len(names), 3)), draw.normal(size=(3, 3)))
    first, bounds, emit = secrets.chunk_scores(texts, model)
    assert first[0] == 0 and first[-1] == len(bounds) == len(emit)
    for k, (t, b) in enumerate(zip(texts, wide, strict=True)):
        own = slice(first[k], first[k + 1])
        assert bounds[own].tolist() == [list(x) for x in b]
        assert not b or np.allclose(emit[own], model.scores(feats[k]))
    assert list(secrets.chunk_spans(texts, model)) == [secrets.all_spans(t, model) for t in texts]
    assert len(model.words.code) < 200  # codes, not words, are held
    assert [t for own in secrets._chunks([None, *texts]) for t in own] == ["", *texts] and list(secrets._chunks([])) == []
