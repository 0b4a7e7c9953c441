"""Secrets in full, and the quality classifier row by row against brute force."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillet.llm import pii, quality

SF = "/root/testdata/sf0.001"
KEY = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + "\n".join("MIIEow+/" * 8 for _ in range(30)) + "\n-----END RSA PRIVATE KEY-----"


CUT = "-----BEGIN PRIVATE KEY-----\n" + "MIIB\n" * 50000 + "cut"


@pytest.mark.parametrize("secret", ["sk-" + "aB3_" * 300, "eyJ" + "aB3x" * 400 + "." + "eyJz" * 900 + "." + "Qq7-" * 500, KEY, CUT, "ghp_" + "a1" * 400, "xoxb-" + "12ab-" * 60, "password: " + "Zz9/" * 20000, "AKIA" + "Q1" * 8])
def test_secrets_are_proposed_in_full(spark, secret):
    text = "see: " + secret + " and more é"
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(pii.PATTERNS["secret"]), F.lit(0)), pii.HINTS["secret"](F.col("t"))).first()
    assert got[0] == [secret] and got[1]


@pytest.mark.parametrize("secret", ["sk-" + "aB3_" * 300, KEY, "ghp_" + "a1" * 400])
def test_secrets_are_found_in_full(spark, secret):
    r = pii.pii_digest(spark.createDataFrame([(1, f"see: {secret} and more é")], "doc_id long, text string")).first()
    assert f"secret:5:{5 + len(secret)}" in r["spans"].split(",")


def brute(docs, labels):
    """doc_id -> (log weight, key), and the number of rows that stay, by a plain reading of the method."""
    hasher = quality.Hasher()
    counts = {i: np.bincount(hasher.buckets((t or "").encode()), minlength=quality.BUCKETS) for i, t in docs}
    best = {}
    for i, q in labels:
        if i is not None and q is not None:
            best[i] = max(q, best.get(i, 0))
    raw = sum(counts.values()) + quality.SMOOTHING
    raw = raw / raw.sum()
    good = sum((counts[i] for i, q in best.items() if q == 1 and i in counts), np.zeros(quality.BUCKETS))
    target = (good + quality.PRIOR * quality.BUCKETS * raw) / (good.sum() + quality.PRIOR * quality.BUCKETS)
    ratio = np.log(target / raw)
    share = sum(best.values()) / len(best)
    k = min(len(docs), math.ceil(len(docs) * (share + 2 * math.sqrt(share * (1 - share) / len(best)))))

    def noise(i):
        signed = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(quality.SEED.to_bytes(4, "little", signed=True), 42))
        return -math.log(-math.log(((signed >> 11) + 0.5) / (1 << 53)))

    weights = {i: float((counts[i] * ratio).sum()) for i, _ in docs}
    return {i: (w, w + noise(i)) for i, w in weights.items()}, k


def test_quality_row_by_row(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want, k = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = {r["doc_id"]: r for r in quality.importance_resample(docs, labels).collect()}
    assert set(got) == set(want)
    for i, (w, key) in want.items():
        assert abs(got[i]["log_weight"] - w) < 1e-6 * max(1, abs(w)) and abs(got[i]["key"] - key) < 1e-6 * max(1, abs(key)), i
    least = sorted((math.floor(key * quality.STEP) for _, key in want.values()), reverse=True)[k - 1]
    assert {i for i, r in got.items() if r["selected"]} == {i for i, (_, key) in want.items() if math.floor(key * quality.STEP) >= least}
    stay = {r["doc_id"] for r in quality.selected_documents(docs, labels).collect()}
    assert stay == {i for i, r in got.items() if r["selected"]}


def test_quality_of_text_ids(spark):
    docs = spark.createDataFrame([("a", "good words here", 1), ("b", "bad", 2), (None, "good words", 3), ("7", None, 4), ("7", "long " * 50000, 5)], "doc_id string, text string, ord int")
    for labels in (spark.createDataFrame([("a", 1), ("b", 0), (None, 1)], "doc_id string, quality int"), spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")):
        out = quality.importance_resample(docs, labels)
        assert out.count() == 5 and out.where("key IS NULL OR selected IS NULL").count() == 0
        assert quality.selected_documents(docs, labels).columns == docs.columns
    assert quality.importance_resample(docs.limit(0), labels).count() == 0
    assert quality.importance_resample(docs.withColumn("doc_id", F.col("ord")), labels).count() == 5
