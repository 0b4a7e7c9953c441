"""A Merkle manifest of a data set, kept as a content-addressed graph, with proofs found by descent.

Rows are leaves, ordered within their group; runs of FAN nodes become one node until a group has one, its subroot; the
groups' subroots, in the groups' order, make a tree of the same form over them. Each inner node is a record: its digest
and its children's. A request for a leaf starts at the root with the digits of the leaf's place in base FAN: each digit
selects a child, the children not selected are a segment of the path, and the segments in reverse are the proof.
Requests that share leading digits go down together, so a level of the descent has as many rows as nodes asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import materialize

FAN_BITS = 3
FAN = 1 << FAN_BITS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:binary,right:binary>>"


def row_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of values, each as '-' if null, else its UTF-8 byte count, ':' and itself."""
    written = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(w).cast("string"), F.lit(":"), w), F.lit("-")) for w in written]), 256)


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _node(children: Column) -> Column:
    """The digest of digests: SHA-256 of their hex texts, one after the other."""
    return F.unhex(F.sha2(F.array_join(F.transform(children, hex_of), ""), 256))


@dataclass
class Dag:
    """leaves: (no, height, i, leaf, group and payload columns); records: by level, (no, height, i, d, children); roots: (no, height, n, d)."""

    leaves: DataFrame
    records: dict[int, DataFrame]
    roots: DataFrame
    top: dict[int, DataFrame]
    top_height: int
    root: bytes | None


def _height(n: Column) -> Column:
    """Levels above n leaves: the least h with FAN ** h >= n."""
    out = F.lit(0)
    for k in range(21):
        out = out + F.when(n > F.lit(1 << FAN_BITS * k), 1).otherwise(0)
    return out.cast("int")


def _placed(rows: DataFrame) -> DataFrame:
    """rows (group_key, order_key, leaf and more) with no (the group's place), i (the row's place in it) and height of its tree.

    Rows are range-partitioned and sorted, written, and numbered by their partition's and their own place in what was
    written: no group is gathered in one task. Rows that repeat in full are told apart by their place in the input.
    """
    keys = ["group_key", "order_key", "leaf", "tie"]
    # the digests are written first: range bounds are sampled, and rows must not be read and hashed twice for that
    dealt = materialize(rows).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.drop("tie").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    runs = dealt.groupBy("group_key", part.alias("part")).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("group_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("rows").over(Window.partitionBy("group_key")))
    runs = runs.withColumn("no", F.dense_rank().over(Window.orderBy("group_key")).cast("long") - 1)  # a row per group and partition
    runs = runs.select(F.col("group_key").alias("of_group"), F.col("part").alias("of_part"), "first", "before", "n", "no")
    told = dealt.join(runs, F.col("group_key").eqNullSafe(F.col("of_group")) & (part == F.col("of_part")))
    return told.withColumn("i", F.col("before") + F.col("place") - F.col("first")).withColumn("height", _height(F.col("n"))).drop("place", "of_group", "of_part", "first", "before")


def _levels(nodes: DataFrame, height: int) -> dict[int, DataFrame]:
    """Records (no, height, i, d, children) of each level from 1 on, above nodes (no, height, i, d)."""
    out: dict[int, DataFrame] = {}
    for level in range(1, height + 1):
        runs = nodes.where(F.col("height") >= level).groupBy("no", "height", F.shiftright("i", FAN_BITS).alias("up"))
        made = runs.agg(F.sort_array(F.collect_list(F.struct("i", "d"))).alias("run"))  # FAN rows a run at most
        made = made.select("no", "height", F.col("up").alias("i"), F.transform("run", lambda x: x["d"]).alias("children"))
        out[level] = materialize(made.select("no", "height", "i", _node(F.col("children")).alias("d"), "children"))
        nodes = out[level]
    return out


def build(rows: DataFrame) -> Dag:
    """The graph over rows (group_key, order_key, leaf: hex digest, and payload columns, none named no, i, n, height, place or tie).

    Groups come in the order of group_key, null first, strings by their UTF-8 bytes; leaves ascend by order_key, null
    first, ties by leaf. A group of one leaf has that leaf as subroot, a data set of one group its subroot as root.
    """
    leaves = materialize(_placed(rows))
    height = leaves.agg(F.max("height")).first()[0] or 0
    nodes = leaves.select("no", "height", "i", F.unhex("leaf").alias("d"))
    records = _levels(nodes, height)
    roots = nodes.where("height = 0")
    for level, made in records.items():
        roots = roots.unionByName(made.where(F.col("height") == level).select("no", "height", "i", "d"))
    roots = materialize(roots.select("no", "height", "d"))
    groups = roots.agg(F.count("*").alias("n")).withColumn("top", _height(F.col("n"))).first()
    over = roots.select(F.lit(0).cast("long").alias("no"), F.lit(groups["top"]).alias("height"), F.col("no").alias("i"), "d")
    top = _levels(over, groups["top"])
    last = (top[groups["top"]] if top else over).select("d").first()
    return Dag(leaves, records, roots, top, groups["top"], bytes(last["d"]) if last else None)


def _descend(starts: DataFrame, records: dict[int, DataFrame], asked: DataFrame) -> DataFrame:
    """asked (no, height, i and more) with d, subroot and path: from starts (no, height, d, subroot, path) down to the leaves."""
    here = None
    above = starts.select("no", "height", F.lit(0).cast("long").alias("i"), "d", "subroot", "path")
    for level in range(max(records, default=0), 0, -1):
        begin = above.where(F.col("height") == level)
        here = begin if here is None else here.unionByName(begin)
        store = records[level].select(F.col("d").alias("digest"), "children").dropDuplicates(["digest"])  # equal runs are one record
        opened = here.join(store, F.col("d") == F.col("digest")).select(F.col("no").alias("of"), F.col("i").alias("above"), "subroot", "path", "children")
        wanted = asked.where(F.col("height") >= level)
        if level > 1:
            wanted = wanted.select("no", "height", F.shiftright("i", FAN_BITS * (level - 1)).alias("i")).distinct()
        met = wanted.join(opened, (F.col("no") == F.col("of")) & (F.shiftright("i", FAN_BITS) == F.col("above")))
        digit = F.col("i").bitwiseAND(F.lit(FAN - 1)).cast("int")
        joined = lambda a: F.aggregate(a, F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y))
        segment = F.struct(joined(F.slice("children", F.lit(1), digit)).alias("left"), joined(F.slice("children", digit + 2, F.lit(FAN))).alias("right"))
        here = met.select(*wanted.columns, F.get("children", digit).alias("d"), "subroot", F.concat("path", F.array(segment)).cast(PATH).alias("path"))
    lone = asked.where("height = 0").join(starts.where("height = 0").select(F.col("no").alias("of"), "d", "subroot", "path"), F.col("no") == F.col("of")).drop("of")
    return lone if here is None else here.unionByName(lone)


def prove(dag: Dag, requests: DataFrame | None = None) -> DataFrame:
    """requests (rows of dag.leaves; all, if None) with d, subroot and path (the segments from the root down, as digests left and right of the way)."""
    empty = F.array().cast(PATH)
    root = F.lit(dag.root).cast("binary")
    over = dag.roots.select(F.lit(0).cast("long").alias("no"), F.lit(dag.top_height).alias("height"), F.col("no").alias("i"), F.col("no").alias("group_no"), F.col("height").alias("group_height"))
    start = over.sparkSession.range(1).select(F.lit(0).cast("long").alias("no"), F.lit(dag.top_height).alias("height"), root.alias("d"), root.alias("subroot"), empty.alias("path"))
    groups = _descend(start, dag.top, over)
    groups = materialize(groups.select(F.col("group_no").alias("no"), F.col("group_height").alias("height"), "d", F.col("d").alias("subroot"), "path"))
    return _descend(groups, dag.records, dag.leaves if requests is None else requests)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(hex_of(s["left"]), hex_of(s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(F.reverse(path), leaf, lambda x, s: F.sha2(F.concat(hex_of(s["left"]), x, hex_of(s["right"])), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents, by lang and doc_id, with the digest to fold from: where the text is tampered with, that of the row with A-Z in lower case."""
    digest = lambda text: row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    return docs.select(F.col("lang").alias("group_key"), F.col("doc_id").alias("order_key"), digest(F.col("text")).alias("leaf"),
                       F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(F.translate("text", UPPER, LOWER))).alias("lowered"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of docs (doc_id, source, lang, n_chars, text).

    folded_root starts from the lowered leaf where 3 divides the CRC-32 of doc_id as text, from the row's own elsewhere.
    Null columns are part of the digest; rows without a doc_id come first in their lang and are not tampered with; rows
    that repeat have places, and so proofs, of their own. Texts of any length are hashed where they are read and never
    shuffled. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    dag = build(document_leaves(docs))
    told = prove(dag)
    root = F.lit(dag.root.hex() if dag.root else None).cast("string")
    out = told.select(F.col("order_key").alias("doc_id"), "leaf", hex_of(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                      folded(F.coalesce("lowered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
