"""The whole pipeline on tables that are empty, hold nulls only, or repeat rows and ids under columns with clashing names."""

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ord long, `Line_gone` string, key double, own string"
PROSE = [" ".join(f"{w}{i}" for w in ("river", "stone", "walks", "under", "bright", "lamps", "toward", "quiet", "harbour", "towns", "where", "boats", "rest")) for i in range(6)]


def stored(spark, folder, docs, labels=()):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None if text is None else len(text), 7, "x", 0.5, None)


@pytest.mark.parametrize("docs", [[], [row(1, None), row(None, None, None), row(2, "")]], ids=["empty", "nothing to read"])
def test_no_words_give_no_rows(spark, tmp_path, docs):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, docs)).collect() == []


def test_repeats_and_clashing_names(spark, tmp_path):
    """Copies go but for the least id's, two texts under one id both stay, and columns keep their values up to the mix."""
    docs = [row(i, t, "ab"[i % 2]) for i, t in enumerate(PROSE)] + [row(0, PROSE[0], "a"), row(9, PROSE[1], "c"), row(2, "another text under an id that is taken " + PROSE[5][::-1], None), row(None, "no id " + PROSE[4][::-1])]
    folder = stored(spark, tmp_path, docs)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert kept.columns == [c.split()[0].strip("`") for c in COLUMNS.split(", ")]
    rows = kept.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None) == sorted((False, d[0], d[1]) for d in docs[:6] + [docs[8]])
    assert [r["text"] for r in rows if r["doc_id"] is None] == [docs[9][1]]
    assert {(r["ord"], r["Line_gone"], r["key"], r["own"]) for r in rows} == {(7, "x", 0.5, None)}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and {p["doc_id"] for p in pieces} <= {r["doc_id"] for r in rows}
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
