"""The corpus operators against brute force, on the smallest tables and on rows made to be awkward."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillet.llm import embedding_dedup, licenses, line_dedup, mixing, mixture_lm, packing, pii, quality, shingles, simhash, topk
from quillet.llm.components import components
from quillet.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
LONG = "word, " * 30000
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", "en", "a"), (4, "One two three", "en", "b"), (4, "One two three", "en", "b"), (5, LONG, "en", "a"),
    (6, "mail a@b.co_m@x.org +1 (988) 555-2485 10.0.0.256 1.2.3.4.5.6.7.8 4111 1111 1111 1111", "en", "c"), (None, "no id here", "en", "c"),
    (7, "ÄÖ 𝔘 x.y@z.example.com, İstanbul <|endoftext|>  \u0085 don'T", "de", "𝔘"), (8, "ONE two THREE", "en", "b"), (9, "0" * 5000 + "a@" + "-1" * 4000, "en", "z")]


def awkward(spark):
    rows = [(i, t, lang, s, len(t or ""), "x", 1) for i, t, lang, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, fp int")


def docs_of(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == least_reachable(nodes, [(a, b) for a, b in edges if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [16384, 8])
def test_simhash(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", limit)
    rng = np.random.default_rng(1)
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them every single day of the year".split() * 6
    extra = []
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[j] = f"w{rng.integers(5)}"
        extra.append((10000 + i, " ".join(w), "s"))
    rows = docs_of(spark) + extra
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    fps = {i: fingerprint(t) for i, t, _ in rows}
    ids = sorted(fps)
    code = np.array([fps[i] for i in ids], np.uint64)
    links = [(ids[a], ids[b]) for a, b in np.argwhere(np.bitwise_count(code[:, None] ^ code[None]) <= 4) if a < b]
    want = least_reachable(ids, links)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert len(set(want.values())) < len(ids)


def test_simhash_awkward(spark):
    got = simhash.simhash_components(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert {c for _, c in by[4] | by[8]} == {4}
    assert len(by[4]) == 1 and by[5] == {(f"{fingerprint(LONG):016x}", 5)}
    assert simhash.simhash_components(awkward(spark).limit(0)).count() == 0
    kept = simhash.drop_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9]


def test_near_copies_by_shingles(spark, monkeypatch):
    """Of texts whose five-word shingles have a Jaccard similarity of 0.8 or more one stays, however far their fingerprints are."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(60, 300)))]
        for c in range(4):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 40))):
                w[at] = f"new{rng.integers(10**6)}"
            rows.append((1000 * g + c, " ".join(w)))
    crowd = [f"v{x}" for x in rng.integers(0, 400, 120)]
    rows += [(900000 + i, " ".join([*crowd[:-1], f"end{i}"])) for i in range(80)] + [(950000, "one two"), (950001, None), (None, " ".join(crowd))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = {i: t for i, t in rows if i is not None}
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in text.items()}
    ids = sorted(text)
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(grams[a] & grams[b]) >= 0.8 * max(1, len(grams[a] | grams[b]))]
    fps = {i: simhash.fingerprint_of((t or "").encode()) for i, t in text.items()}
    far = [(a, b) for a, b in near if (fps[a] ^ fps[b]).bit_count() > 4]
    alike = near + [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = {i for i, root in least_reachable(ids, alike).items() if i == root}
    assert len(far) > 50
    for limit in (4096, 16):
        monkeypatch.setattr(shingles, "BLOCK_ROWS", limit)
        out = [r["doc_id"] for r in simhash.drop_near_copies(docs).collect()]
        kept = {i for i in out if i is not None}
        assert len(out) == len(kept) + 1 and want <= kept
        assert sum(a in kept and b in kept for a, b in near) <= 0.02 * len(near)


def test_two_texts_of_one_id_both_stay(spark):
    rows = [(1, "first text of the id, quite long enough"), (1, "another matter altogether is told here"), (1, "first text of the id, quite long enough"), (2, "Another matter altogether is told here"), (3, None), (3, ""), (None, None)]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got) == [(0, ""), (1, rows[1][1]), (1, rows[0][1]), (3, "")]


def brute_pii(text):
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def test_pii(spark):
    rows = [(i, t) for i, t, _ in docs_of(spark)] + [(90000 + n, t) for n, (_, t, _, _) in enumerate(AWKWARD)]
    rows += [(80000, "1.2.3 007.08.9.1x 300.1.1.1 1.1.1.1.1.1.1.1 a.b@c.d.e..f g@h i@j.k@l.m"), (80001, "+12 345 +1234567 +1-2-3-4-5-6-7-8-9. +123456789012345678 5500 0000 0000 0004 4111111111111112")]
    got = {r["doc_id"]: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for i, t in rows:
        base = brute_pii(t or "")
        found += len(base)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert found > 20


def test_pii_learns(spark):
    soft = pii.reliabilities([(0, v, 5) for v in (364, 360)] + [(6, 9 * 27 + 13, 4), (6, 2 * 243 + 2 * 81 + 2, 9)])
    assert soft[0, 364] > soft[6, 2 * 243 + 2 * 81 + 2]
    weights = pii.train([(5, 364, 7, 50), (5, 2 * 243 + 2 * 81 + 2, 100, 50)])
    assert pii.probability(5, 7, weights) > 0.5 > pii.probability(5, 100, weights)


def test_pii_recall_of_further_kinds(spark):
    """Of spans planted in prose nine in ten are found at least, and few of what only looks like them."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 9))))
    prose = lambda: " ".join(word() for _ in range(30))
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    hexed = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    make = {"secret": lambda: rng.choice([f'token = "{hexed(40)}"', f"AKIA{''.join(rng.choice(list('ABCDEFGHIJ234567'), 16))}", f"ghp_{hexed(36)}", f"api_key: {hexed(32)}"]), "person": lambda: f"Mr. Peter {word().capitalize()}",
            "national_id": lambda: f"ssn {int(rng.integers(100, 660))}-{int(rng.integers(10, 99))}-{int(rng.integers(1000, 9999))}", "local_phone": lambda: f"call ({digits(3)}) {digits(3)}-{digits(4)}",
            "obfuscated_email": lambda: f"mail {word()} [at] {word()} [dot] com", "iban": lambda: f"iban DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"}
    rows, planted = [], {}
    for n in range(600):
        kind = sorted(make)[n % len(make)]
        planted[n] = kind
        rows.append((n, f"{prose()} {make[kind]()} {prose()}"))
    rows += [(1000 + n, f"{prose()} {x} {prose()}") for n, x in enumerate(["version 555-12-0000", "key = value", "password: xxxxxxxxxxxxxxxx", "order no. 000-00-0000", "the token = abcdefghij"] * 40)]
    clashing = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "id", "k", "s")})
    got = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.find_pii(clashing).collect()}
    caught = Counter(kind for n, kind in planted.items() if kind in got[n])
    assert all(caught[k] >= 0.9 * 100 for k in make), caught
    assert sum(bool(got[i]) for i, _ in rows[600:]) <= 0.2 * 200
    assert pii.find_pii(clashing.limit(0)).count() == 0


def test_pii_of_a_long_text(spark):
    """Thousands of spans in one text are placed right, also across the lots of lengths."""
    for n in (63, 64, 65, 5000):
        text = "é ".join(f"u{i}@mail.example.com" for i in range(n))
        r = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(text))
        assert r["n_email"] == n and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = [(i, f"clean text number {i} about gardens and rivers " * 30, 1) for i in range(300)]
    bad = [(1000 + i, "BUY!! NOW!! " * (50 + i % 70), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    out = quality.importance_resample(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).collect()
    kept = {r["doc_id"] for r in out if r["selected"]}
    assert {i for i, _, _ in good} <= kept and len(kept & {i for i, _, _ in bad}) <= 15
    keys = sorted((r["key"] for r in out), reverse=True)
    assert len(kept) == quality._kept_rows(360, 300 / 360, 360) and min(r["key"] for r in out if r["selected"]) == keys[len(kept) - 1]
    assert quality.importance_resample(docs, labels.limit(0)).where("NOT selected").count() == 0
    assert quality.importance_resample(awkward(spark), labels).count() == len(AWKWARD)
    assert quality.importance_resample(awkward(spark).limit(0), labels).count() == 0
    assert quality.selected_documents(awkward(spark), labels).columns == awkward(spark).columns


def test_quality_without_good_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int")
    out = quality.importance_resample(docs, labels).collect()
    assert len(out) == 50 and all(r["selected"] and abs(r["log_weight"]) < 1e-9 for r in out)
    assert quality.selected_documents(docs, labels).count() == 50


def test_quality_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    ratios, good, n = quality.log_ratios(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    h = quality.Hasher()
    raw, target = np.full(quality.BUCKETS, quality.SMOOTHING), np.zeros(quality.BUCKETS)
    for t in (b"a b a", b"c"):
        raw += np.bincount(h.buckets(t), minlength=quality.BUCKETS)
    target += np.bincount(h.buckets(b"a b a"), minlength=quality.BUCKETS)
    raw /= raw.sum()
    target = (target + quality.PRIOR * quality.BUCKETS * raw) / (target.sum() + quality.PRIOR * quality.BUCKETS)
    assert np.allclose(ratios, np.log(target / raw)) and (good, n) == (0.5, 2)


def test_kth_largest(spark):
    x = [int(v) for v in np.random.default_rng(0).integers(-10**12, 10**12, 500)] + [7] * 50
    df = spark.createDataFrame([(v,) for v in x], "x long")
    for k in (1, 17, 300, 550, 900):
        assert quality.kth_largest(df, "x", k) == sorted(x, reverse=True)[min(k, len(x)) - 1]


def test_line_dedup(spark, monkeypatch):
    rows = [(i, f"own line {i}\nShared  Line\nnear {i % 7}\n\nlast", f"s{i % 9}") for i in range(63)] + [(100, None, "s1"), (101, "", None), (102, "shared line", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites = defaultdict(set)
    norm = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ").lower()
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[norm(x)].add(s)
    for lg in (line_dedup.LG_K, 4):
        monkeypatch.setattr(line_dedup, "LG_K", lg)
        got = {r["doc_id"]: r["text"] for r in line_dedup.without_boilerplate(docs).collect()}
        for i, t, _ in rows:
            assert got[i] == (None if t is None else "\n".join(x for x in t.split("\n") if not norm(x) or len(sites[norm(x)]) < line_dedup.MIN_SITES))
    assert got[102] == ""
    out = line_dedup.without_boilerplate(awkward(spark), min_sites=1)
    assert out.count() == len(AWKWARD) and out.columns == awkward(spark).columns
    assert line_dedup.without_boilerplate(awkward(spark).limit(0)).count() == 0


def test_line_dedup_keeps_copied_documents(spark):
    """A clean document copied over more than MIN_SITES sources keeps its text, and so does the first of near copies."""
    import corpus_pipeline

    clean, near = "a clean document\nof two lines", "one body\nshared by all\n"
    rows = [(i, clean, f"s{i}") for i in range(12)] + [(100 + i, f"{near}own {i}", f"s{i}") for i in range(12)]
    rows += [(200 + i, f"page {i}\nAccept  Cookies\nend {i}", f"s{i}") for i in range(9)] + [(None, clean, "s90"), (300, None, "s1"), (301, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, docs, SF).collect()}
    assert len(got) == len(rows) and all(got[i] == clean for i in [*range(12), None])
    assert got[100] == near + "own 0" and all(got[100 + i] == f"own {i}" for i in range(1, 12))
    assert got[200] == rows[24][1] and all(got[200 + i] == f"page {i}\nend {i}" for i in range(1, 9))
    assert got[300] is None and got[301] == ""


def check_packing(rows, out, capacity=2048):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by, bins = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(r["length"] for r in out)


def test_packing(spark):
    rows = [(i, t) for i, t, _ in docs_of(spark)]
    rows += [(90000 + n, t) for n, (_, t, _, _) in enumerate(AWKWARD)] + [(91000 + n, t) for n, t in enumerate(["ΣΑΣ Σ", "x ́y", "it's 12.5% foo_bar ½ ² ǅ ß ﬁ 你好 a<|startoftext|>b", "\x1c|\x85|　x", "Ⱥx aʼb ø×÷", "\x00\x01 \x7f"])]
    for parts in (1, 7):
        out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), tokenizer_path()).collect()
        padding, tokens = check_packing(rows, out)
        assert padding < 2 * 2048 + 0.01 * tokens
    assert packing.pack(awkward(spark), tokenizer_path()).select("doc_id").distinct().count() == 10
    assert packing.pack(awkward(spark).limit(0), tokenizer_path()).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    near = []
    for i in range(150):
        noise = rng.standard_normal(64)
        near.append(x[i] / np.linalg.norm(x[i]) + noise / np.linalg.norm(noise) * math.tan(math.acos(0.9 + 0.0006 * i)) * 0.97)
    hub = rng.standard_normal(64)
    crowd = hub + 0.1 * rng.standard_normal((200, 64))
    all_ = np.concatenate([x, near, crowd]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(all_)] + [(1000, all_[0].tolist()), (2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [1.0]), (2004, [None] + [1.0] * 63)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    v = np.concatenate([all_, all_[:1]]).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [*range(len(all_)), 1000]
    link = v @ v.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(1)
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    assert (found[:150].sum() + found[400:550].sum()) >= 0.9 * (want[:150].sum() + want[400:550].sum())
    comp = least_reachable(ids, [(ids[a], ids[b]) for a, b in np.argwhere(link) if a < b])
    assert sum(got[i]["component_id"] == comp[i] for i in ids) >= 0.97 * len(ids)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in (2000, 2001, 2002, 2003, 2004))
    named = spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.01]), (7, [0.0, 1.0]), (None, [-1.0, 0.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "uid", "code", "key", "mult")})
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_components(named).collect() if r["component_id"]) == [(0, 1, 7), (7, 0, 7), (7, 1, 7)]
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_recall_in_the_querys_form(spark):
    """Recall of links over the query's own vectors and copies of each at planted cosines, in the table's own form."""
    rng = np.random.default_rng(6)
    x = np.array([r[0] for r in spark.read.parquet(SF.replace("0.001", "0.1") + "/embeddings.parquet").where("embedding IS NOT NULL").select("embedding").collect()], np.float64)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    cos = rng.uniform(0.9, 0.99, len(x))
    near = cos[:, None] * x / np.linalg.norm(x, axis=1, keepdims=True) + np.sqrt(1 - cos[:, None] ** 2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = np.concatenate([x, near]).astype(np.float32)
    got = embedding_dedup.embedding_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>"))
    found = sum(r["n_links"] for r in got.collect()) // 2
    v = rows.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = sum(int((v[s : s + 1000] @ v.T >= 0.9).sum()) for s in range(0, len(v), 1000)) - len(v)
    assert want // 2 >= 0.9 * len(x) and 0.95 * (want // 2) <= found <= want // 2


def test_embeddings_hot_blocks(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(embedding_dedup.embedding_components(table))
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 4)
    assert key(embedding_dedup.embedding_components(table)) == whole


@pytest.mark.parametrize("block", [8192, 64])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", block // 8)
    monkeypatch.setattr(topk, "SEED_ROWS", 16)
    rng = np.random.default_rng(2)
    real = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = real + [(10000 + i, (v * s).astype(np.float32).tolist()) for i, (v, s) in enumerate(zip(rng.standard_normal((150, 64)), rng.exponential(0.3, 150)))]
    rows += [(20000 + i, real[3][1]) for i in range(20)] + [(30000, None), (30050, [float("inf")] * 64), (30100, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if v is not None and np.isfinite(v).all()}
    want = {q: sorted(((i, int(x @ ok[q])) for i, x in ok.items() if i != q), key=lambda p: (-p[1], p[0]))[:5] for q in ok if q % 50 == 0}
    assert got == want
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [3.0, 0.0]), (None, [9.0, 9.0]), (5, [1e13, 7.0])], "vec_id long, embedding array<double>")
    twice = twice.withColumns({c: F.lit(1) for c in ("id", "v", "norm", "block", "chunk", "qid")})
    out = topk.top_k(twice, twice.where("vec_id = 2 AND embedding[0] = 1"), 9).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(5, 256 * 256 * 10**13), (1, 2 * 65536), (1, 65536)]
    huge = topk.top_k(twice, twice.where("vec_id = 5"), 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in huge] == [(2, 3 * 65536 * 10**13), (1, 2 * 65536 * 10**13)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"]
    rows = [(1, mit), (2, mit.replace("<year> <copyright holders>", "2020 Somebody, Inc.").upper()), (3, mit.split("\n\n", 2)[2].replace("sublicense", "sublicence").replace(", ", " ,\n")), (4, mit + " and more"), (5, None), (6, ""), (7, "released under the MIT licence")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", "MIT", None, None, None, "MIT notice"]
    whole = spark.createDataFrame([(n, name, "\n " + body.upper().replace(" ", " \t ").replace("\n", "\r\n").replace(",", ";")) for n, (name, body) in enumerate(licenses.LICENSES.items())], "doc_id long, name string, text string")
    found = licenses.scan_licenses(whole.withColumns({c: F.lit(1) for c in ("digest", "license", "id")})).join(whole.select("doc_id", "name"), "doc_id").collect()
    assert len(found) == len(licenses.LICENSES) >= 22 and all(r["license"] == r["name"] for r in found)
    assert got[5]["digest"] is None and got[6]["digest"] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan_licenses(awkward(spark)).count() == len(AWKWARD) and licenses.scan_licenses(awkward(spark).limit(0)).count() == 0


def mix_targets(sizes):
    """Targets of sources in their order, one round after the other."""
    left, open_, out = mixing.SHARE * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(mixing.WEIGHTS[i % 3] for i in open_)
        full = [i for i in sorted(open_) if left * mixing.WEIGHTS[i % 3] / whole > mixing.MOST * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * mixing.WEIGHTS[i % 3] / whole
            break
        for i in full:
            out[i] = mixing.MOST * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


@pytest.mark.parametrize("few", [50_000, 0])
def test_mixing_many_sources(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "CHUNK_SOURCES", 32)
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), f"site{int(rng.integers(0, 900))}") for i in range(3000)] + [(9000 + i, "v " * 500, "big") for i in range(60)] + [(9900, "", "nothing"), (9901, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(x for x in sizes if x is not None) + [None]
    want = dict(zip(names, mix_targets([sizes[n] for n in names])))
    out = mixing.mix(df).collect()
    source = {i: s for i, _, s in rows}
    for r in out:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and math.isclose(r["target"], want[source[r["doc_id"]]], rel_tol=1e-12) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[n] - want[n]) <= max(2, 0.01 * want[n]) for n in names)


def test_mixing(spark):
    rows = [(i, t, s) for i, t, s in docs_of(spark)] + [(90000 + n, t, s) for n, (_, t, _, s) in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()))
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    per = [sum(size[i] for i, _, x in rows if x == s) for s in names]
    want = dict(zip(names, mix_targets(per)))
    assert abs(sum(want.values()) - 1.5 * sum(per)) < 1e-6 * sum(per)
    source, taken = {i: s for i, _, s in rows}, Counter()
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[names.index(source[r["doc_id"]])] and r["target"] == want[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, n in zip(names, per):
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), (s, taken[s], want[s])
    assert len(out) == len(rows) and mixing.mix(df.limit(0)).count() == 0
    mixed = mixing.mixed_documents(awkward(spark))
    assert mixed.columns == awkward(spark).columns
    words = sum(len((r["text"] or "").encode().split()) for r in mixed.collect())
    clashing = awkward(spark).withColumns({c: F.lit(1) for c in ("mix_id", "mix_taken", "row_key", "kept_id", "own_t1", "line_gone", "ord")})
    assert mixing.mixed_documents(clashing).columns == clashing.columns and mixing.mixed_documents(clashing).count() == mixed.count()
    assert simhash.drop_near_copies(clashing).count() == 7 and line_dedup.without_boilerplate(clashing).count() == len(AWKWARD)
    assert words == mixing.mix(awkward(spark)).agg(F.sum("taken")).first()[0]


def lm_rows(spark):
    return [(i, t) for i, t, _ in docs_of(spark)] + [(None, "no id"), (700001, None), (700002, " \n"), (700003, LONG), (700004, "twice told"), (700004, "twice told")]


def lm_part(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10


def brute_lm(rows):
    """score by row, token after token, with counts in plain dictionaries."""
    m, low = mixture_lm, lambda w: xxhash.xxh3_64_intdigest(w) & 0xFFFFFF
    texts = [(lm_part(i), m.words_of((t or "").encode())) for i, t in rows]
    c_model, mixing, order0, after = Counter(), Counter(), np.zeros(1 << m.ORDER0_BITS, np.int64), defaultdict(Counter)
    for part, words in texts:
        for previous, w in zip([m.END, *words], words):
            if part > 1:
                c_model[w] += 1
                order0[low(w) & (1 << m.ORDER0_BITS) - 1] += 1
                after[previous][low(w)] += 1
            elif part:
                mixing[w] += 1
    followers, cells = {}, {}
    for w, c in after.items():
        first = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: m.FOLLOWERS]
        fill = [(0, 0)] * (m.FOLLOWERS - len(first))
        lows, ns = (np.array([x], dt) for x, dt in zip(zip(*first, *fill), (np.uint32, np.int64)))
        followers[w] = [x for x, _ in first]
        cells[w] = m.follower_cells(ns, lows, np.array([sum(c.values())]), np.array([len(c)]), order0)[0]
    seen, none = np.zeros(2 * int(np.prod(m.FOLLOW_CELLS)), np.int64), 0
    for part, words in texts:
        for previous, w in zip([m.END, *words], words) if part == 1 else ():
            for j, f in enumerate(followers.get(previous, ())):
                seen[2 * cells[previous][j] + (f == low(w))] += 1
                if f == low(w):
                    break
            else:
                none += 1
    slots = [np.zeros(2 << b, np.int64) for b in m.SPELL_BITS]
    for w in c_model:
        bit, _, where = m.spelling([w])
        for t, s in zip(slots, where):
            np.add.at(t, 2 * s + bit, 1)
    tables = [m.logit_class(t) for t in slots]
    spell = np.zeros(2 * int(np.prod(m.SPELL_CELLS)), np.int64)
    for w in mixing:
        if not c_model[w]:
            cell, bit, _ = m.spelling_cells([w], tables)
            np.add.at(spell, 2 * cell + bit, 1)
    known = (none - sum(n for w, n in mixing.items() if not c_model[w]) + 1) / (none + 2)
    mixed, spelling = m.follower_mixer(seen), m.spelling_mixer(spell)
    out = []
    for _, words in texts:
        score = 0.0
        for previous, w in zip([m.END, *words], words):
            for j, f in enumerate(followers.get(previous, ())):
                score += mixed[cells[previous][j], int(f == low(w))]
                if f == low(w):
                    break
            else:
                if c_model[w]:
                    score += math.log10(known * c_model[w] / sum(c_model.values()))
                else:
                    cell, bit, _ = m.spelling_cells([b"" if w == m.END else w], tables)
                    score += math.log10(1 - known) + spelling[cell, bit].sum()
        out.append(score)
    return out


def test_mixture_lm(spark, tmp_path, monkeypatch):
    rows = lm_rows(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = Counter(w for i, t in tokens if lm_part(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for (i, t), score in zip(tokens, brute_lm(rows)):
        want[i].append((len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), score))
    for blocks, parts in ((mixture_lm.BLOCK_BYTES, 1), (40_000, 5)):
        monkeypatch.setattr(mixture_lm, "BLOCK_BYTES", blocks)
        monkeypatch.setattr(mixture_lm, "BUCKET_BYTES", blocks)
        monkeypatch.setattr(mixture_lm, "HOT_SHARE", 1 << 16 if parts == 1 else 64)
        out = mixture_lm.mixture_scores(docs.repartition(parts)).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r["held_out"], r["train_tokens"]) == (lm_part(r["doc_id"]) == 0, n) and r["bits_per_byte"] > 0
            assert any((r["n_tokens"], r["n_known"]) == w[:2] and math.isclose(r["base_score"], w[2], rel_tol=1e-9) and math.isclose(r["score"], w[3], rel_tol=1e-9) for w in want[r["doc_id"]]), r


def test_mixture_lm_beats_the_base(spark):
    """On the rows held out of a thousand documents, the model's chance of the texts is above the unigram base's."""
    out = mixture_lm.mixture_scores(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert out["score"] > 0.95 * out["base"]


def test_mixture_lm_awkward(spark):
    clashing = awkward(spark).withColumns({c: F.lit(1) for c in ("id", "part", "block", "kind", "data", "bucket", "n")})
    assert mixture_lm.mixture_scores(clashing).count() == len(AWKWARD)
    assert mixture_lm.mixture_scores(awkward(spark).limit(0)).count() == 0
    held = [i for i in range(1, 200) if lm_part(i) == 0]
    nothing = mixture_lm.mixture_scores(spark.createDataFrame([(i, "only held out") for i in held], "doc_id long, text string")).collect()
    assert len(nothing) == len(held) and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and -100 < r["score"] < 0 for r in nothing)


def test_mixture_lm_is_a_distribution():
    """Chances of a bit add up to one in every cell, and so do those of all words that the code can spell."""
    rng = np.random.default_rng(0)
    for mixer, cells in ((mixture_lm.follower_mixer, mixture_lm.FOLLOW_CELLS), (mixture_lm.spelling_mixer, mixture_lm.SPELL_CELLS)):
        assert np.allclose((10 ** mixer(rng.integers(0, 9, 2 * int(np.prod(cells))))).sum(1), 1)
    assert math.isclose(sum(2.0 ** -float(s) for s in mixture_lm.SIZE), 1)


def test_pipeline(spark, tmp_path):
    """The stages one after the other on the smallest tables, against what each may do."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = lambda t: len((t or "").encode().split())
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, texts = set(before), before
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= ids and rows
        ids = {r["doc_id"] for r in rows}
        if n == 2:
            fps = np.array([fingerprint(r["text"]) for r in rows], np.uint64)
            near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
            assert near.sum() == len(rows)
        if n < 3:
            assert len(rows) == len(ids)
            texts = {r["doc_id"]: r["text"] for r in rows}
        else:
            taken = Counter()
            for r in rows:
                taken[r["doc_id"]] += size(r["text"])
                assert texts[r["doc_id"]].encode().split()[: size(r["text"])] == r["text"].encode().split()
            assert all(taken[i] <= 2 * size(texts[i]) for i in taken)
            kept = [(r["doc_id"], r["text"]) for r in rows]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in kept)
