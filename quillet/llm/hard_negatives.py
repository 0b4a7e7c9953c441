"""Hard-negative mining with Four-Russians scoring.

Candidates are indexed as bit planes: plane b of a vector holds bit b of each whole component, eight dimensions to a
byte. An anchor's eight dimensions have 256 subset sums, so its product with a candidate's plane is a table lookup a
byte, and planes are added from the highest down with a shift between them. The sums are whole numbers and exact.

Each anchor meets the rows of its own label once, which gives its positives, and then all rows in blocks, where those of
other labels whose score lies in the band of a positive are kept, the best of each block first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .util import materialize

#: Candidates of a block about; anchors that meet a block at once; anchors whose tables, and candidates whose sums, are held at once.
BLOCK_ROWS, LOT_ROWS, STRIPE, CHUNK = 4096, 2048, 32, 1024
GROUP = 8
LONGEST = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component as longs; null if the vector is null or holds a null or non-finite component."""
    top = float(np.finfo(np.float64).max) / 256
    fine = F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= top)), F.lit(False))
    return F.when(fine, F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")))


def bit_planes(rows: np.ndarray) -> list[bytes]:
    """Per row of whole numbers: the number of planes (one byte), then its planes from bit 0 on, eight dimensions a byte.

    The highest plane is the sign's: its bits count negative. A row takes as many planes as its largest component needs.
    """
    n, width = rows.shape
    most = np.maximum(rows.max(1), ~rows.min(1)) if width else np.zeros(n, np.int64)
    planes = 1 + np.searchsorted(np.left_shift(1, np.arange(63, dtype=np.int64)), most, side="right")
    out: list[bytes] = [b""] * n
    for p in np.unique(planes).tolist():
        at = np.flatnonzero(planes == p)
        packed = np.stack([np.packbits((rows[at] >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(p)], axis=1)
        for i, row in zip(at.tolist(), packed.reshape(len(at), -1)):
            out[i] = bytes([p]) + row.tobytes()
    return out


def _indexed(vectors: pa.Array) -> pa.Array:
    values, starts = vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    widths, out = np.diff(starts), [b""] * len(vectors)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        for i, b in zip(at.tolist(), bit_planes(values[starts[at][:, None] + np.arange(w)])):
            out[i] = b
    return pa.array(out, pa.binary())


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): of each run of eight dimensions the sums of all subsets of an anchor's components."""
    n, width = anchors.shape
    groups = -(-width // GROUP)
    parts = np.zeros((n, groups * GROUP), anchors.dtype)
    parts[:, :width] = anchors
    parts = parts.reshape(n, groups, GROUP)
    out = np.zeros((groups, 1 << GROUP, n), anchors.dtype)
    for j in range(GROUP):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, :, j].T[:, None, :]
    return out


def planes_of(bits: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, planes) of candidates that have equally many planes and groups; planes: (candidates, planes, groups)."""
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(bits):
        kinds.setdefault((b[0], len(b)), []).append(i)
    return [(np.array(at), np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), -1)[:, 1:].reshape(len(at), p, -1)) for (p, _), at in kinds.items()]


def scores(anchors: np.ndarray, candidates: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """(anchors, n): exact products of anchors (whole numbers) and the candidates of planes_of, by shifts and lookups.

    Sums that may leave a long are taken in Python's whole numbers and then count as the nearest long.
    """
    most = sum(max(map(abs, map(int, column)), default=0) for column in anchors.T) << max((p.shape[1] for _, p in candidates), default=0)
    kind = np.int32 if most < 1 << 31 else np.int64 if most <= LONGEST else object
    tables = subset_sums(anchors.astype(kind))
    out = np.zeros((len(anchors), n), kind)
    for at, planes in candidates:
        used = range(min(planes.shape[2], len(tables)))
        for lo in range(0, len(at), CHUNK):
            part = planes[lo : lo + CHUNK]
            total = np.zeros((len(part), len(anchors)), kind)
            found = np.zeros_like(total)
            for b in range(part.shape[1] - 1, -1, -1):
                total += total  # one bit up
                for g in used:
                    np.take(tables[g], part[:, b, g], axis=0, out=found, mode="clip")
                    if b == part.shape[1] - 1:
                        total -= found
                    else:
                        total += found
            out[:, at[lo : lo + CHUNK]] = total.T
    return np.clip(out, -LONGEST, LONGEST).astype(np.int64)


def _matrix(rows: pa.ChunkedArray) -> np.ndarray:
    listed = rows.to_pylist()
    out = np.zeros((len(listed), max(map(len, listed), default=0)), np.int64)
    for i, r in enumerate(listed):
        out[i, : len(r)] = r
    return out


def _prepared(left: pa.Table, right: pa.Table):
    """Candidates in the order of their ids, their planes, and both sides' ids and labels as places in common lists."""
    left = left.take(pc.sort_indices(left, [("id", "ascending")])).combine_chunks()
    common = lambda c: pa.chunked_array([*left.column(c).chunks, *right.column(c).chunks], left.schema.field(c).type).combine_chunks().dictionary_encode().indices.to_numpy()
    ids, labels = common("id"), common("label")
    n = len(left)
    return left, left.column("bits").to_pylist(), _matrix(right.column("v")), ids[:n], ids[n:], labels[:n], labels[n:]


def _best_of_label(k: int):
    """Per anchor, the k best candidates of its label in this cell."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, pos, score = [], [], []
        if len(left) and len(right):
            left, bits, v, ids, own_ids, labels, own_labels = _prepared(left, right)
            for label in np.unique(own_labels).tolist():
                rows = np.flatnonzero(labels == label)
                planes = planes_of([bits[i] for i in rows])
                asked = np.flatnonzero(own_labels == label)
                for at in range(0, len(asked) if len(rows) else 0, STRIPE):
                    some = asked[at : at + STRIPE]
                    for a, s in zip(some.tolist(), scores(v[some], planes, len(rows))):
                        other = np.flatnonzero(ids[rows] != own_ids[a])
                        best = other[np.argsort(-s[other], kind="stable")[:k]]  # candidates stand in the order of ids
                        own += [a] * len(best)
                        pos += rows[best].tolist()
                        score += s[best].tolist()
        return pa.table({"id": right.column("id").take(pa.array(own, pa.int64())), "akey": right.column("akey").take(pa.array(own, pa.int64())),
                         "positive_id": left.column("id").take(pa.array(pos, pa.int64())), "positive_score": pa.array(score, pa.int64())})
    return run


def _best_in_bands(k: int, low: int, high: int):
    """Per anchor and positive, the k best candidates of other labels in this block whose score lies in the positive's band."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, nth, pos, score = [], [], [], []
        if len(left) and len(right):
            left, bits, v, ids, own_ids, labels, own_labels = _prepared(left, right)
            planes = planes_of(bits)
            positives = right.column("positives").to_pylist()
            for at in range(0, len(right), STRIPE):
                for a, s in zip(range(at, len(right)), scores(v[at : at + STRIPE], planes, len(left))):
                    bands = [(p["nth"], -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives[a]]
                    bands = [b for b in bands if b[1] <= b[2]]
                    if not bands:
                        continue
                    fit = np.flatnonzero((s >= min(b[1] for b in bands)) & (s <= max(b[2] for b in bands)) & (labels != own_labels[a]) & (ids != own_ids[a]))
                    fit = fit[np.argsort(-s[fit], kind="stable")]
                    down = -s[fit]
                    for n, least, most in bands:
                        first = int(np.searchsorted(down, -most, side="left"))
                        best = fit[first : min(first + k, int(np.searchsorted(down, -least, side="right")))]
                        own += [a] * len(best)
                        nth += [n] * len(best)
                        pos += best.tolist()
                        score += s[best].tolist()
        return pa.table({"id": right.column("id").take(pa.array(own, pa.int64())), "akey": right.column("akey").take(pa.array(own, pa.int64())), "nth": pa.array(nth, pa.int32()),
                         "negative_id": left.column("id").take(pa.array(pos, pa.int64())), "negative_score": pa.array(score, pa.int64())})
    return run


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score (long).

    anchors: rows of the same form. An anchor's positives are its best other rows of the same label; for each, the best
    rows of other labels whose score is low to high per cent of the positive's (none, if that is below zero). Scores are
    inner products of floor(256 * x), ties go to the smaller id; fewer rows, if there are fewer.

    Rows without id, label or vector, or with a null or non-finite component, take no part; shorter vectors count as
    padded by zeros, components and products beyond a long as the nearest long. Rows that repeat an id are candidates of
    their own and left out together for an anchor of that id; anchors that repeat in full count once, anchors that share
    only the id each give their rows. Other columns are ignored, whatever their names. No rows give no rows.

    Candidates are dealt into blocks by their place in the index, and a label's rows into as many cells as it needs, so
    neither a common label nor a common vector outgrows a task.
    """
    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole(F.col(vector_col)).alias("v"))
        return rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")

    index = materialize(usable(vectors).select("id", "label", F.arrow_udf(_indexed, "binary")("v").alias("bits")))
    asked = materialize(usable(anchors).withColumn("akey", F.xxhash64("label", "v")).dropDuplicates(["id", "akey"]))
    blocks, lots = 1 + index.count() // BLOCK_ROWS, 1 + asked.count() // LOT_ROWS
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("id", "akey"), F.lit(lots)).cast("int"))
    dealt = index.withColumn("at", F.xxhash64(F.monotonically_increasing_id()))  # no key decides where a candidate goes
    id_type = index.schema["id"].dataType

    def meet(left: DataFrame, right: DataFrame, place: str, search, *out: T.StructField) -> DataFrame:
        if lots > 1:  # a block goes to each lot of anchors once
            there = right.select(F.col(place).alias("there"), F.col("lot").alias("of_lot")).distinct()
            left = left.join(there, F.col(place) == F.col("there")).drop("there")
        else:
            left = left.withColumn("of_lot", F.lit(0))
        kinds = T.StructType([T.StructField("id", id_type), T.StructField("akey", T.LongType()), *out])
        return left.select(place, "of_lot", "id", "label", "bits").groupBy(place, "of_lot").cogroup(right.groupBy(place, "lot")).applyInArrow(search, kinds)

    # cells of equal labels: a label of many rows is dealt over several, and its anchors go to each of them
    hot = materialize(index.groupBy("label").count().where(F.col("count") > BLOCK_ROWS).select(F.col("label").alias("hot_label"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    cell = F.pmod(F.xxhash64("label", "salt"), F.lit(blocks)).cast("int").alias("cell")
    own = dealt.join(hot, F.col("label") == F.col("hot_label"), "left").withColumn("salt", F.pmod("at", salts).cast("int")).select("id", "label", "bits", cell)
    sent = asked.join(hot, F.col("label") == F.col("hot_label"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("id", "akey", "label", "v", "lot", cell).dropDuplicates(["id", "akey", "cell"])
    found = meet(own, sent, "cell", _best_of_label(positives), T.StructField("positive_id", id_type), T.StructField("positive_score", T.LongType()))
    nth = F.row_number().over(Window.partitionBy("id", "akey").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = materialize(found.withColumn("nth", nth).where(F.col("nth") <= positives))

    banded = chosen.groupBy("id", "akey").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("positives"))  # a few per anchor
    sent = asked.join(banded, ["id", "akey"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "akey", "label", "v", "positives", "lot", "block")
    fits = meet(dealt.withColumn("block", F.pmod("at", F.lit(blocks)).cast("int")), sent, "block", _best_in_bands(negatives, low, high),
                T.StructField("nth", T.IntegerType()), T.StructField("negative_id", id_type), T.StructField("negative_score", T.LongType()))
    rank = F.row_number().over(Window.partitionBy("id", "akey", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    kept = fits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return kept.join(chosen, ["id", "akey", "nth"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
