"""The registered queries of the operators, on whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, decontamination, embedding_dedup, hard_negatives, licenses, line_dedup, merkle, mixing, packing, pii, quality, simhash, topk
from .util import read


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_boilerplate(read(spark, sf_dir, "documents"), n_removed="n_removed")
    return cleaned.select("doc_id", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(read(spark, sf_dir, "embeddings"))


def op6_mixture_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.context_scores(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality_resampling, op3_line_dedup, op4_harmonic_packing, op5_embedding_dedup, op6_mixture_lm, op7_simhash, op8_topk, op9_license_scan, op10_source_mix,
                                   op11_hard_negatives, op12_merkle_manifest, op13_decontamination)}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LINE = rf"trim(translate(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), {LETTERS}), ' ')"
OP3_SQL = f"""
WITH lines AS (SELECT r, doc_id, source, line, pos, {_LINE} AS norm FROM (
       SELECT r, doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
     spread AS (SELECT norm, count(DISTINCT coalesce('=' || source, 'null')) AS sites FROM lines WHERE norm <> '' GROUP BY norm),
     kept AS (SELECT r, doc_id, count(*) FILTER (coalesce(sites, 0) >= {line_dedup.MIN_SITES}) AS gone, string_agg(line, chr(10) ORDER BY pos) FILTER (coalesce(sites, 0) < {line_dedup.MIN_SITES}) AS text
              FROM lines LEFT JOIN spread USING (norm) GROUP BY r, doc_id)
SELECT doc_id, CAST(gone AS INTEGER) AS n_removed, CAST(length(coalesce(text, '')) AS BIGINT) AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256 FROM kept
UNION ALL SELECT doc_id, 0, NULL, NULL FROM documents WHERE text IS NULL"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def _canonical_sql(text: str) -> str:
    low = rf"regexp_replace(translate({text}, {LETTERS}), '(^|\n){licenses.COPYRIGHT_LINE}', chr(10), 'g')"
    words = rf"replace(trim(regexp_replace({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), '{licenses.SPLIT_WORD[0]}', '{licenses.SPLIT_WORD[1]}')"
    case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licenses.SPELLINGS.items())
    return rf"regexp_replace(array_to_string(list_transform(string_split({words}, ' '), lambda w: CASE w {case} ELSE w END), ' '), '^{licenses.TITLES} (permission|this software)', '\3')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP9_SQL = f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({_canonical_sql("body")}) AS digest FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.LICENSES.items())}) t(license, body)) GROUP BY digest),
     own AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM own LEFT JOIN known USING (digest)"""

_WHOLE = """list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"""
OP11_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     a AS (SELECT DISTINCT vec_id AS anchor_id, label AS own, v AS av FROM v WHERE vec_id % 100 = 0),
     s AS (SELECT anchor_id, own, av, vec_id, label, CAST(list_sum(list_transform(list_zip(av, v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM a, v WHERE anchor_id <> vec_id),
     p AS (SELECT anchor_id, own, av, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id, own, av ORDER BY score DESC, vec_id) AS nth FROM s WHERE label = own QUALIFY nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, own, av, nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id, own, av) WHERE s.label <> own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score) WHERE rank <= 10"""

#: Levels written out in SQL: enough for 8 ** 7 leaves of a language.
_LEVELS = 7


def _crc_step(x: str) -> str:
    return f"CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"


def _merkle_sql() -> str:
    def digest(text: str) -> str:
        return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + "))"

    parts = ["t0 AS (SELECT range AS i, CAST(range AS BIGINT) AS x FROM range(256))"]
    parts += [f"t{k} AS (SELECT i, {_crc_step('x')} AS x FROM t{k - 1})" for k in range(1, 9)]
    parts.append("tab AS (SELECT list(x ORDER BY i) AS tab FROM t8)")
    crc = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
           "lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))")
    lowered = f"translate(text, {LETTERS})"
    parts.append(f"l AS (SELECT doc_id, lang, {digest('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {digest(lowered)} ELSE {digest('text')} END AS used FROM documents, tab)")
    parts.append("r AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS no, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM l)")
    parts.append("n0 AS (SELECT no, r AS i, leaf AS d, count(*) OVER (PARTITION BY no) AS n FROM r)")

    def level(below: str, k: int, name: str, key: str) -> list[str]:
        """Nodes of the next level, and of each node the siblings left and right of it (empty for one that stands alone)."""
        run = f"PARTITION BY {key}, i // 8 ORDER BY i"
        return [f"{name}s{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lft, "
                f"CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS rgt FROM {below})",
                f"{name}{k + 1} AS (SELECT {key}, i, d, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT {key}, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d FROM {below} GROUP BY {key}, i // 8))"]

    for k in range(_LEVELS):
        parts += level(f"n{k}", k, "n", "no")
    parts.append(f"m0 AS (SELECT 0 AS g, no AS i, d, count(*) OVER () AS n FROM n{_LEVELS})")
    for k in range(3):
        parts += level(f"m{k}", k, "m", "g")
    joins, proof, fold = "", [], "used"
    for name, levels, place in (("n", _LEVELS, "r.r"), ("m", 3, "r.no")):
        for k in range(levels):
            on = f"{name}s{k}.i = {place} // {8 ** k}" + (f" AND ns{k}.no = r.no" if name == "n" else "")
            joins += f" JOIN {name}s{k} ON {on}"
            proof += [f"{name}s{k}.lft", f"{name}s{k}.rgt"]
    steps, at = [f"p0 AS (SELECT r.doc_id, r.leaf, ns{_LEVELS - 1}.d AS below, m0.d AS subroot, m3.d AS root, sha256(concat({', '.join(proof)})) AS proof_sha256, used AS f, "
                 + ", ".join(f"{name}s{k}.lft AS {name}l{k}, {name}s{k}.rgt AS {name}r{k}, {name}s{k}.n AS {name}n{k}" for name, levels in (("n", _LEVELS), ("m", 3)) for k in range(levels))
                 + f" FROM r{joins} JOIN m0 ON m0.i = r.no, m3)"], 0
    for name, levels in (("n", _LEVELS), ("m", 3)):
        for k in range(levels):
            steps.append(f"p{at + 1} AS (SELECT * REPLACE (CASE WHEN {name}n{k} > 1 THEN sha256(concat({name}l{k}, f, {name}r{k})) ELSE f END AS f) FROM p{at})")
            at += 1
    return "WITH " + ", ".join(parts + steps) + f" SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM p{at}"


_WORDS = rf"regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
     pat AS (SELECT DISTINCT item, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
     grams AS (SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
     occ AS (SELECT r, s, k, item FROM grams JOIN pat USING (k, g)),
     hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM occ)) GROUP BY r),
     who AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(who.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN who USING (r)"""

#: The other operators hash with XXH64, draw noise from it, train models or tokenise: tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op8_topk": OP8_SQL, "op9_license_scan": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle_manifest": _merkle_sql(),
                              "op13_decontamination": OP13_SQL}
