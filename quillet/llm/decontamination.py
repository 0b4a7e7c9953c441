"""Benchmark passages in documents by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. For each pattern length, a shift table tells by the last BLOCK words of a
position how far the search may jump: as far as no pattern can end. Where it may not, the patterns that end with those
words are a bucket; their first words and then all words are compared. Documents are scanned where they are read.

The patterns are dealt into shards of bounded size. Each is broadcast on its own and scans the documents once; usually
there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import materialize

WINDOW, BLOCK = 10, 2
#: Bytes of patterns, owners included, of one shard about.
SHARD_BYTES = 8 << 20
#: Bytes as they are read: A-Z lowered; ASCII other than letters and digits separates words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


class Search:
    """The tables of patterns (tuples of words) of one length, and their owners."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK, self.length)
        self.furthest = self.length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[tuple[bytes, ...], list[str]]]]] = {}
        for p, owners in patterns.items():
            for end in range(self.block, self.length + 1):
                key = b" ".join(p[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.furthest), self.length - end)
            first = b" ".join(p[: self.block])
            self.buckets.setdefault(b" ".join(p[-self.block :]), {}).setdefault(first, []).append((p, owners))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, owners) of each occurrence."""
        length, block, furthest, shift = self.length, self.block, self.furthest, self.shift
        end, n = length, len(words)
        while end <= n:
            key = words[end - 2] + b" " + words[end - 1] if block == 2 else b" ".join(words[end - block : end])
            jump = shift.get(key, furthest)
            if jump:
                end += jump
                continue
            start = end - length
            for p, owners in self.buckets[key].get(b" ".join(words[start : start + block]), ()):
                if list(p) == words[start:end]:
                    yield start, owners
            end += 1


def searches_of(pairs: list[tuple[str, str | None]]) -> list[Search]:
    """Searches, one per length, for (window: words joined by spaces, item) pairs."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for window, item in pairs:
        p = tuple(window.encode().split(b" "))
        owners = by_length.setdefault(len(p), {}).setdefault(p, [])
        if item is not None:
            owners.append(item)
    return [Search(p) for p in by_length.values()]


def found_in(words: list[bytes], searches: list[Search]) -> tuple[list[tuple[int, int]], list[str]]:
    """(spans, items): disjoint runs of hit words, end exclusive, in order, and the sorted items with an occurrence."""
    hits: list[tuple[int, int]] = []
    items: set[str] = set()
    for s in searches:
        for start, owners in s.occurrences(words):
            hits.append((start, start + s.length))
            items.update(owners)
    return merged(hits), sorted(items, key=str.encode)


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start:long,end:long>>"


def _spans_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(tables):
    """Of batches of (id, own, text): id, own, n_words, spans and items, by the searches of a broadcast shard."""
    def run(batches):
        searches = tables.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                at, who = found_in(words, searches)
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in at])
                items.append(who)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(n_words, pa.int64()), pa.array(spans, _spans_type()), pa.array(items, pa.list_(pa.string()))],
                                             names=["id", "own", "n_words", "spans", "items"])
    return run


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window: words joined by spaces, item as text): each run of window words of an item; all its words, if it has fewer but any."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD), F.lit(0))
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("start")
    return rows.select("item", "words", start).select(F.array_join(F.slice("words", F.col("start"), F.lit(window)), " ").alias("window"), "item").distinct()


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words (long), spans (disjoint runs of words inside an occurrence, end exclusive), items (sorted as strings).

    Words are runs of digits, lower-cased letters and anything beyond ASCII. Null and empty texts have no words; texts of
    any length are scanned whole. Items without words occur nowhere; items that repeat an id are one item; an item
    without an id makes hits but is not listed. Documents that repeat, or lack an id, keep a row each. Other columns are
    ignored, whatever their names. No documents give no rows, no benchmark no spans.
    """
    spark = docs.sparkSession
    pairs = materialize(windows(benchmark, window))
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length(F.coalesce("item", F.lit("")))), F.lit(0))).first()[0]
    shards = 1 + size // SHARD_BYTES
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("own"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([own.schema["id"], own.schema["own"], T.StructField("n_words", T.LongType())]).simpleString()[7:-1].replace(":", " ")

    def scanned(n: int) -> DataFrame:
        part = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == n).collect()  # SHARD_BYTES about
        tables = spark.sparkContext.broadcast(searches_of([(r["window"], r["item"]) for r in part]))
        return own.mapInArrow(_scan(tables), f"{kind}, spans {SPANS}, items array<string>")

    out = scanned(0)
    if shards > 1:
        # what a shard finds is written before the next is broadcast, but for documents in which it finds nothing
        base = materialize(out)
        more = [base.where(F.size("spans") > 0).select("id", "own", "spans", "items")]
        more += [materialize(scanned(n).where(F.size("spans") > 0).select("id", "own", "spans", "items")) for n in range(1, shards)]
        hits = more[0]
        for m in more[1:]:
            hits = hits.unionByName(m)
        hits = hits.dropDuplicates(["id", "own", "spans", "items"]).groupBy(F.col("id").alias("of"), F.col("own").alias("of_own")).agg(
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("who"))  # a document's own hits
        met = base.join(hits, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_own")), "left")
        out = met.select("id", "own", "n_words", F.coalesce(_joined(F.col("all")), F.array().cast(SPANS)).alias("spans"), F.coalesce("who", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def _joined(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap as one."""
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if one is None else [{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in one])] for one in lists.to_pylist()], _spans_type())

    return F.arrow_udf(run, SPANS)(spans)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: the figures of contaminated_spans."""
    found = contaminated_spans(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
