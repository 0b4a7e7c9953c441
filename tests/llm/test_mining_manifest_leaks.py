"""Hard negatives, the Merkle manifest and benchmark passages against brute force, and their queries against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quillet.llm import decontamination, hard_negatives, merkle, queries

SF = "/root/testdata/sf0.001"


# ---- hard negatives ---------------------------------------------------------------------------------------------------
def brute_negatives(rows, anchors, k=5, m=10):
    def fit(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    whole = lambda v: [math.floor(256 * float(x)) for x in v]
    clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    known = [(r[0], whole(r[1]), r[2]) for r in rows if fit(r)]
    out = []
    for a, v, label in {(r[0], tuple(whole(r[1])), r[2]) for r in anchors if fit(r)}:
        scored = [(-clip(sum(x * y for x, y in zip(v, c))), i, l2) for i, c, l2 in known if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:k]:
            fits = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:m]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int, id string, bits int, at long"


def told(spark, rows, anchors, **kw):
    frame = lambda some: spark.createDataFrame([(*r, "x", 1, 2) for r in some], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(frame(rows), frame(anchors), **kw).collect())


@pytest.mark.parametrize("block,lot", [(4096, 2048), (7, 3)])
def test_hard_negatives(spark, monkeypatch, block, lot):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "LOT_ROWS", lot)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1, 13) + (i % 4 == 0)).round(2).tolist(), int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))) for i in range(120)]
    rows += [(200 + i, rows[4][1], i % 2) for i in range(25)]  # copies: ties and a common vector
    got = told(spark, rows, rows[::9])
    assert got == brute_negatives(rows, rows[::9]) and len(got) > 100


def test_hard_negatives_awkward(spark):
    base = [(1, [1.0, 2.0], 0), (2, [1.0, 1.9], 0), (3, [0.5, 0.9], 1), (3, [0.5, 0.9], 1), (4, [0.6, 0.5], 1), (4, [0.5, 0.6], 2), (5, [1.0, 2.0, 0.0], 0)]
    bad = [(None, [1.0, 1.0], 0), (6, None, 0), (7, [1.0, 1.0], None), (8, [1.0, float("nan")], 1), (9, [float("inf"), 1.0], 1), (10, [1.0, None], 1), (11, [], 1), (12, [-1.0, -3.0], 0)]
    rows = base + bad
    assert told(spark, rows, rows) == brute_negatives(rows, rows) and told(spark, rows, rows)
    assert told(spark, [], []) == [] and told(spark, rows, []) == [] and told(spark, [], rows) == []
    huge = [(1, [3e12, -2e12, 5.0], 0), (2, [2.9e12, 1e12, 1.0], 0), (3, [25.0, 0.0, 0.25], 1), (4, [20.0, -1.0, 0.125], 1), (5, [1e-9, 0.0, -0.3], 1)]
    assert told(spark, huge, huge) == brute_negatives(huge, huge) and told(spark, huge, huge)


def test_planes_give_exact_products():
    rng = np.random.default_rng(6)
    for width in (1, 8, 9, 64):
        c, a = rng.integers(-(1 << int(rng.integers(1, 40))), 1 << 30, (40, width)), rng.integers(-200, 200, (5, width))
        c[:10] %= 7
        assert (hard_negatives.scores(a, hard_negatives.planes_of(hard_negatives.bit_planes(c)), 40) == a @ c.T).all()


# ---- Merkle manifest ----------------------------------------------------------------------------------------------------
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    def climb(level):
        """(root, per node the (left, right) siblings of each level)."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for p, i in zip(paths, at):
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                p.append((run[: i % 8], run[i % 8 + 1 :]))
            level, at = [H(*level[i : i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for g in langs}
    trees = {g: climb([leaf_of(*r) for r in own[g]]) for g in langs}
    root, over = climb([trees[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, above in zip(langs, over):
        for r, path in zip(own[g], trees[g][1]):
            lower = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            d = leaf_of(*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if lower else r[4])
            for left, right in path + above:
                d = H(*left, d, *right)
            out.append((r[0], leaf_of(*r), trees[g][0], root, H(*(x for left, right in path + above for x in left + right)), d, d == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, no string, i int, place long")
    return sorted((tuple(r) for r in merkle.manifest(frame).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(0,), (1,), (1, 1), (8,), (9, 1), (64, 65, 7), (1, 1, 1, 1, 1, 1, 1, 1, 1), (600, 3)])
def test_manifest(spark, sizes):
    rng, rows = random.Random(7), []
    for g, n in enumerate(sizes):
        rows += [(i * len(sizes) + g, f"s{i % 3}", "de" * g, i, f"Text {rng.random()} ÄB") for i in range(n)]
    rng.shuffle(rows)
    got = manifest_of(spark, rows)
    assert got == brute_manifest(rows)
    if sum(sizes) > 20:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_awkward(spark):
    rows = [(1, None, None, None, None), (2, "", "en", 0, ""), (3, "a", "en", 1, "ABC, " * 60000), (None, "a", "en", 1, "X"), (None, "a", "en", 1, "X"), (None, "b", "é", -5, "tab\tnul\0"),
            (4, "a", "z", 1, "same")] + [(9, "a", "fr", 2, "Copy")] * 40 + [(9, "a", "fr", 2, "Other copy")] * 3 + [(-7, "a", "𝔘", 2, "ÄÖ abc"), (12, "a", "", 2, "ÄÖ abc")]
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_proves_some_leaves(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    dag = merkle.build(merkle.document_leaves(docs))
    some = merkle.prove(dag, dag.leaves.where("order_key IN (5, 6, 299)"))
    want = {r[0]: r for r in brute_manifest(rows)}
    got = some.select("order_key", merkle.hex_of(some["d"]).alias("d"), "leaf", merkle.proof_digest(some["path"]).alias("proof"), merkle.folded(some["leaf"], some["path"]).alias("root")).collect()
    assert sorted(r["order_key"] for r in got) == [5, 6, 299]
    for r in got:
        assert r["d"] == r["leaf"] == want[r["order_key"]][1] and r["proof"] == want[r["order_key"]][4] and r["root"] == dag.root.hex()


# ---- benchmark passages ---------------------------------------------------------------------------------------------------
def brute_leaks(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9)):
            if w:
                patterns[tuple(w[s : s + 10])].add(None if i is None else str(i))
    out = []
    for doc_id, t in docs:
        w, hit, who = words(t), set(), set()
        for p in {len(p) for p in patterns}:
            for s in range(len(w) - p + 1):
                if (owners := patterns.get(tuple(w[s : s + p]))) is not None:
                    hit |= set(range(s, s + p))
                    who |= owners - {None}
        out.append((doc_id, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaks_of(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, id string, own int")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, window string")
    return sorted((tuple(r) for r in decontamination.contamination(d, b).collect()), key=repr)


@pytest.mark.parametrize("shard", [8 << 20, 2000])
def test_leaks(spark, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard)
    rng = random.Random(9)
    word = lambda: rng.choice(("a", "b", "B", "cc", "ü", "7", "long"))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 3, 9, 10, 11, 30)) if i % 7 else 12))) for i in range(40) if i % 5]
    items = [(i, t) for i, t in items if len(t.split()) > 2] + [(100, "same text of thirteen words that many documents share with one another here"), (101, "same text of thirteen words that many documents share with one another here")]
    docs = [(i, ", ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(60)]
    for i in range(30):
        passage = rng.choice(items)[1].upper() if i % 2 else rng.choice(items)[1]
        docs.append((1000 + i, " ".join(["x"] * rng.randint(0, 25)) + "\n" + passage + "! " + " ".join(["y"] * rng.randint(0, 25))))
    docs += [(2000, f"{items[0][1]} {items[1][1]} {items[0][1]}"), (2001, None), (2002, ""), (None, items[0][1]), (None, items[0][1]), (2000, items[2][1])]
    got = leaks_of(spark, docs, items)
    assert got == brute_leaks(docs, items) and {r[-1] for r in got} == {True, False}


def test_leaks_awkward(spark):
    items = [(1, None), (2, ""), (3, " ?! "), (None, "no id but these ten words are looked for in texts"), (4, "Two words"), (4, "again the same item with another text of eleven words ok"), (5, "\u0085x y Über"), (10, "Two words"), (9, "w " * 30)]
    docs = [(1, None), (1, None), (2, "two WORDS two,words"), (3, "no id but these ten words are looked for in texts"), (4, "w " * 100000 + "two words"), (5, "\u0085x y! über \u0085x y! Über"), (6, "İ don't"), (None, "two words")]
    assert leaks_of(spark, docs, items) == brute_leaks(docs, items)
    assert leaks_of(spark, [], items) == [] and leaks_of(spark, docs[:4], []) == brute_leaks(docs[:4], [])


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle_manifest", "op13_decontamination"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, con.fetchall()))
