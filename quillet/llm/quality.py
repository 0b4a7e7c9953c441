"""Quality by importance resampling.

Two hashed n-gram models are counted: of target text (a bounded sample of rows labelled good) and of all raw text.
A document's importance is the sum of log ratios of its words and word pairs; Gumbel noise drawn from its id makes
the k largest keys a sample without replacement in proportion to importance. Counting and scoring run over
whole texts, in Arrow batches; only the two tables of BUCKETS numbers pass through the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import free_name, materialize, unit_hash

BUCKETS = 1 << 14
#: Labelled rows that the target model and the share of good rows are fitted on, at most.
LABELLED_ROWS = 100_000
CACHE_WORDS = 400_000
SEED = 29
#: Pseudo-counts per bucket: of the raw model, and of the raw model's shares in the target model.
SMOOTHING, PRIOR = 0.1, 10.0

#: Runs of letters and digits, or of other signs; white space separates.
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")


class Hasher:
    """Buckets of a text's words and word pairs. A worker remembers the first CACHE_WORDS words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        h = xxhash.xxh64_intdigest(w.lower(), SEED) & 0x7FFFFFFF
        if len(self.known) < CACHE_WORDS and len(w) <= 64:
            self.known[w] = h
        return h

    def buckets(self, text: bytes) -> np.ndarray:
        get = self.known.get
        words = _TOKEN.findall(text)
        h = np.array([get(w, -1) for w in words], np.int64)
        for i in np.flatnonzero(h < 0).tolist():
            h[i] = self._word(words[i])
        pairs = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA6B) >> 15
        return np.concatenate([h, pairs]) & (BUCKETS - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (bucket, n) of each model, model 1 for target rows and 0 for all."""
    hasher, totals = Hasher(), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            texts, target = batch.column(0).slice(at, 64).cast(pa.binary()).to_pylist(), batch.column(1).slice(at, 64).to_pylist()
            found = [hasher.buckets(t or b"") for t in texts]
            for model, some in enumerate((found, [f for f, good in zip(found, target) if good])):
                if some:
                    totals[model] += np.bincount(np.concatenate(some), minlength=BUCKETS)
    model, bucket = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(bucket, pa.int32()), pa.array(totals[model, bucket])], names=["model", "bucket", "n"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, int]:
    """(log p_target - log p_raw by bucket, share of good rows among the labelled, labelled rows)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("marked_id")).agg(F.max("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64(F.lit(SEED), "marked_id"), "marked_id").limit(LABELLED_ROWS)
    marks = materialize(marks)
    r = marks.agg(F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("good")).first()
    good = marks.where("quality = 1").select("marked_id", F.lit(True).alias("target"))  # at most LABELLED_ROWS ids
    same = F.col("doc_id") == F.col("marked_id") if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType else F.col("doc_id").cast("string") == F.col("marked_id").cast("string")
    rows = docs.select("doc_id", "text").join(F.broadcast(good), same, "left")
    counted = rows.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_count, "model int, bucket int, n long")
    n = np.zeros((2, BUCKETS))
    for row in counted.groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 * BUCKETS rows
        n[row["model"], row["bucket"]] = row["n"]
    raw = (n[0] + SMOOTHING) / (n[0] + SMOOTHING).sum()
    target = (n[1] + PRIOR * BUCKETS * raw) / (n[1].sum() + PRIOR * BUCKETS)
    return np.log(target / raw), r["good"] if r["n"] else 1.0, r["n"]


def scorer(ratios: np.ndarray):
    """A column function of texts: their log importance; null and empty texts have 0."""
    @F.arrow_udf("double")
    def log_importance(text: pa.Array) -> pa.Array:
        hasher = _WORKER.setdefault("hasher", Hasher())
        return pa.array([float(ratios[hasher.buckets(t.as_py() or b"")].sum()) for t in text.cast(pa.binary())], pa.float64())

    return lambda text: log_importance(text)


_WORKER: dict[str, Hasher] = {}


def gumbel(doc_id: Column, kind: str) -> Column:
    """Noise of a row, by its id alone; kind is the id's type. Rows without an id share one draw."""
    known = F.coalesce(doc_id, F.lit(-1)) if kind in ("bigint", "int", "smallint", "tinyint") else F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null"))
    return -F.log(-F.log(unit_hash(F.lit(SEED), known)))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column (not null), by counting 4096 ranges at a time; no sort, no task with all rows."""
    if k <= 0:
        return None
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not r["n"]:
        return None
    lo, hi, k = r["lo"], r["hi"], min(k, r["n"])
    while lo < hi:
        step = (hi - lo) // 4096 + 1
        inside = df.where(F.col(column).between(lo, hi))
        ranges = inside.groupBy(F.expr(f"({column} - ({lo})) div {step}").alias("g")).count().collect()  # at most 4096 rows
        for g, n in sorted(((x["g"], x["count"]) for x in ranges), reverse=True):
            if k <= n:
                lo, hi = lo + g * step, min(hi, lo + (g + 1) * step - 1)
                break
            k -= n
    return lo


#: Keys are compared in steps of 2^-20 of a nat.
STEP = float(1 << 20)


def _kept_rows(n: int, good: float, labelled: int) -> int:
    """k: the rows, times the upper end (two standard errors) of the labelled share of good ones; all rows, if none is good."""
    if not labelled or not good:
        return n
    return min(n, math.ceil(n * (good + 2 * math.sqrt(good * (1 - good) / labelled))))


def importance_resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, log_weight, key (double), selected (boolean).

    selected: the key is among the k largest, k being the rows times the share of good rows among the labelled
    (its upper confidence end, so that good rows are kept); rows equal to the k-th key are all selected. Null and
    empty texts weigh 0, texts of any length are counted and scored whole; rows with the same id and text get the same
    key. Ids may be numbers or texts; if the tables' differ in type, they are compared as texts. Labels that are null are left out, an id
    with several labels counts as its highest; without any label, or a good one, all weights are 0 and all rows are
    selected. No rows give no rows; further columns of either table are ignored.
    """
    ratios, good, labelled = log_ratios(docs, labels)
    scored = docs.select("doc_id", scorer(ratios)(F.col("text")).alias("log_weight"))
    scored = materialize(scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), dict(docs.dtypes)["doc_id"])).withColumn("ord", F.floor(F.col("key") * STEP)))
    least = kth_largest(scored, "ord", _kept_rows(scored.count(), good, labelled))
    return scored.select("doc_id", "log_weight", "key", (F.col("ord") >= F.lit(least if least is not None else 0)).alias("selected"))


def selected_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that importance_resample selects, with their columns.

    Each row is scored once and written with its key; only the keys are read to find the least one that stays.
    """
    ratios, good, labelled = log_ratios(docs, labels)
    name = free_name(docs.columns, "ord")
    scored = materialize(docs.withColumn(name, F.floor((scorer(ratios)(F.col("text")) + gumbel(F.col("doc_id"), dict(docs.dtypes)["doc_id"])) * STEP)))
    keys = scored.select(F.col(name).alias("ord"))
    least = kth_largest(keys, "ord", _kept_rows(keys.count(), good, labelled))
    return scored.where(F.col(name) >= F.lit(least if least is not None else 0)).select(*docs.columns)
