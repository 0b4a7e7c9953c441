"""Cross-site boilerplate lines.

Lines are normalised and hashed; for each hash a HyperLogLog sketch of the sites it stands on is built by partial
aggregation and merged. A sketch well below or above the threshold decides; lines near it get an exact distinct
count. Lines on MIN_SITES sites or more are removed wherever they stand.

With copies_once, as the pipeline asks, no text is lost because it was copied: a text counts for one site however
many copies of it there are, and the first occurrence of a removed line stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import free_name, materialize

MIN_SITES = 8
LG_K = 9
#: Relative half-width around the threshold in which a sketch does not decide: three standard errors of LG_K.
BAND = 3 * 1.04 / math.sqrt(1 << LG_K)


def normal_line(line: Column) -> Column:
    """Lower case of A-Z only, runs of ASCII white space as one space, trimmed."""
    spaced = F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")
    return F.trim(F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def hashed_lines(docs: DataFrame, text_col: str, site_col: str, id_col: str | None = None) -> DataFrame:
    """(t1, t2, site, lines): two hashes of each text, and two of each of its normalised lines, null for a blank one.

    Written once, so that the texts are split and normalised a single time for all that follows. With id_col there
    is one row per distinct text, of its least id (nulls last) and that row's site, and a column with them, place.
    """
    normal = F.transform(F.split(F.col(text_col), "\n", -1), normal_line)
    lines = F.transform(normal, lambda n: F.when(n != "", F.struct(F.xxhash64(n).alias("h1"), F.hash(n).alias("h2"))))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null"))
    own = [F.xxhash64(text_col).alias("t1"), F.hash(text_col).alias("t2"), site.alias("site"), lines.alias("lines")]
    named = docs.where(F.col(text_col).isNotNull())
    if id_col is None:
        return materialize(named.select(*own))
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), site.alias("site"))
    one = named.select(*own, place.alias("place")).groupBy("t1", "t2").agg(F.min("place").alias("place"), F.first("lines").alias("lines"))
    return materialize(one.select("t1", "t2", F.col("place.site").alias("site"), "lines", "place"))


def boilerplate(hashed: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that stand on min_sites sites or more; a null site counts as a site."""
    lines = hashed.select("site", F.explode("lines").alias("l")).where("l IS NOT NULL").select("l.h1", "l.h2", "site")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about"))
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    sure = spread.where(F.col("about") > high).select("h1", "h2")
    near = spread.where(F.col("about").between(low, high)).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count()
    return sure.unionByName(exact.where(F.col("count") >= min_sites).select("h1", "h2"))


def removed_positions(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, copies_once: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(t1, t2, gone array<int>): for each distinct text, the places of its boilerplate lines, from 0.

    What goes depends on a text only, so texts are named by two hashes of their own rather than by an id that may repeat.
    copies_once: see without_boilerplate.
    """
    if copies_once:
        return _removed_after_first(hashed_lines(docs, text_col, site_col, id_col), min_sites)
    hashed = hashed_lines(docs, text_col, site_col)
    lines = hashed.select("t1", "t2", F.posexplode("lines").alias("at", "l")).where("l IS NOT NULL").select("t1", "t2", "at", "l.h1", "l.h2")
    gone = lines.join(boilerplate(hashed, min_sites), ["h1", "h2"], "left_semi")
    return gone.groupBy("t1", "t2").agg(F.collect_set("at").alias("gone"))


def _removed_after_first(hashed: DataFrame, min_sites: int) -> DataFrame:
    """removed_positions of distinct texts, without the first occurrence of each line by (least id of the text, position)."""
    lines = hashed.select("t1", "t2", "place", F.posexplode("lines").alias("at", "l")).where("l IS NOT NULL").select("t1", "t2", "place", "at", "l.h1", "l.h2")
    found = materialize(lines.join(boilerplate(hashed, min_sites), ["h1", "h2"], "left_semi"))
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("place", "t1", "t2", "at")).alias("f")).select("f.t1", "f.t2", "f.at")
    return found.join(first, ["t1", "t2", "at"], "left_anti").groupBy("t1", "t2").agg(F.collect_set("at").alias("gone"))


def without_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, n_removed: str | None = None,
                        copies_once: bool = False, id_col: str = "doc_id") -> DataFrame:
    """docs with its boilerplate lines taken out of text_col; every row stays, and its columns.

    A text all of whose lines go becomes empty; null texts stay null, empty ones empty; blank lines stay. n_chars,
    if there, follows. n_removed: name for a further column with the number of lines removed (int). Repeated rows
    are cleaned alike. No rows give no rows. Very long texts and lines are taken whole; the work is linear in them.

    copies_once: rows of equal text count as one, on the site of the least id_col, and each line keeps its first
    occurrence (by that id, then by position; all copies of that text keep it), so no line leaves the table.
    """
    t1, t2, own1, own2, gone = (free_name(docs.columns, c) for c in ("line_t1", "line_t2", "own_t1", "own_t2", "line_gone"))
    found = removed_positions(docs, text_col, site_col, min_sites, copies_once, id_col).select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("gone").alias(gone))
    text = F.col(text_col)
    keyed = docs.withColumns({own1: F.xxhash64(text), own2: F.hash(text)})
    met = keyed.join(found, (F.col(own1) == F.col(t1)) & (F.col(own2) == F.col(t2)), "left")

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))  # by a set: linear in a text's lines
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    once = F.get(F.transform(F.array(F.split(text, "\n", -1)), kept), F.lit(0))  # the lambda's argument holds the lines, which are split once
    out = met.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(once))
    if n_removed:
        out = out.withColumn(n_removed, F.coalesce(F.size(gone), F.lit(0)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast("long"))
    return out.select(*docs.columns, *([n_removed] if n_removed else []))
