"""Null ids, repeated rows, clashing columns, very long and malformed values, and empty tables, through every operator and stage."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import extraction, imatch, language, mixing, neighbours, packing, passages, quality, secret_scan, simhash

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "score label bits key rank cluster node root tag z1 t1 raw part of seen kept copy _kept _label _quality_score_ word n".split()


def line(rng, n):
    return " ".join("".join(rng.choices(["an", "ber", "tion", "ou", "re", "st"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [line(rng, 80) for _ in range(30)] + [None, "", "  ", None, line(rng, 30_000), "\x00 ퟿ é", "tie", "tie"]
    out = [(k, t, "en", "a" if k % 2 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[4], None, "a", 1), (None, None, None, None, None), (3, texts[7], "de", "b", 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id bigint, quality int, toxic int")


def test_rows_without_an_id_and_repeated_rows_are_scored(docs, rows, labels):
    machine = quality.trained(docs, labels)
    assert quality.scored(docs, machine, name="s").where("s between 0 and 1").count() == len(rows)
    kept = quality.good(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert quality.good(docs.limit(0), labels).count() == 0 and quality.good(docs, labels.limit(0), 0.5).count() == len(rows)
    model = language.trained(docs)
    assert language.identified(docs, model).count() == len(rows)
    assert secret_scan.redacted(docs).columns == docs.columns


def test_secrets_of_rows_without_an_id(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    df = spark.createDataFrame([(None, f"token = {key}"), (1, None), (2, f"token = {key}"), (2, f"token = {key}")], "doc_id bigint, text string").withColumns({"score": F.lit(1), "value": F.lit(2)})
    got = sorted(((r.doc_id, r.value) for r in secret_scan.findings(df).collect()), key=repr)
    assert got == [(2, key), (2, key), (None, key)]


def test_imatch_of_tied_and_missing_ids(docs, rows):
    for n in (3, 10, 1000):
        got = imatch.fingerprints(docs, rows_a_part=n).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars) for r in got) == sorted((-1 if d is None else d, len(t or "")) for d, t, *_ in rows)
    by = {d: t or "" for d, t, *_ in rows if d is not None and d > 7}
    for r in got:
        if r.doc_id is not None and r.doc_id > 8:
            t, after = by[r.doc_id], by[r.doc_id - 1]
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


def test_copies_of_tied_and_missing_ids(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.where("doc_id IS NOT NULL").collect()]
    assert len(texts) == len(set(texts)) and kept.where("doc_id IS NULL").count() == 2
    assert {t for t in texts if t and t.strip()} >= {t for d, t, *_ in rows if d is not None and d < 30 and t and d not in (3, 7)}
    assert simhash.components(docs).count() == len(rows)
    assert passages.repeated_passages(docs).where("doc_id IS NULL OR first_doc IS NULL").count() == 0


def test_packing_and_mixing_of_dirty_rows(docs, rows):
    pieces = packing.pack(docs, TOKENIZER, length=128).collect()
    assert sum(r.length for r in pieces if r.start == 0) > 0 and sum(r.start == 0 for r in pieces) == len(rows)
    assert mixing.copies(docs.drop("copy"), power=1.0).count() > 0


def test_neighbours_with_clashing_columns_and_ties(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1e300, 1e300], [-1.0, 2.0]]
    df = spark.createDataFrame([(20 * k, x) for k, x in enumerate(v)] + [(7, [1.0, 0.0, 0.0]), (20, v[1])], "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("score", "rank", "size", "block", "turn", "query_id", "mine", "meet")})
    got = {}
    for r in neighbours.nearest(df, k=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 80, 100}
    assert sorted(got[0])[0][1:] == (80, 1e300) and sorted(got[60])[0][1:] == (80, 1e300)
    assert [x[1:] for x in sorted(got[80])] == [(0, 1e300), (20, 1e300)]


def test_malformed_and_very_long_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = "<p>" + "word " * 200_000
    rng = random.Random(3)
    junk = ["".join(rng.choices(["<", ">", "</", "<p", "<p ", "=", '"', "'", "a", " ", "<!--", "-->", "&lt", "&#9;", "<article>", "</div>", "<script>", "\n"], k=200)) for _ in range(300)]
    pages = [(1, None, deep), (2, None, long), (3, "http://h/x", "<p>a</p>"), (3, "http://h/x", "<p>a</p>"), (None, "http://h/x", "<p>b</p>"), (None, None, None)] + [(10 + k, "junk.org", j) for k, j in enumerate(junk)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("host", "part", "texts", "places", "parts", "count", "repeated")})
    got = extraction.main_text(df).collect()
    assert len(got) == len(pages)
    text = {(r.page_id, r.url): r.text for r in got}
    assert text[1, None] == "x" and text[2, None] == " ".join(["word"] * 200_000) and text[3, "http://h/x"] == "a" and text[None, "http://h/x"] == "b" and text[None, None] == ""
    assert all("  " not in t and t == t.strip() for t in text.values())


def test_pipeline_stages_on_dirty_rows(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.where("copy = 'copy!' AND score = 'score!'").count() == kept.count(), name
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).columns == docs.columns
    assert kept.count() > 0 and corpus_pipeline.pack_windows(spark, kept, str(tmp_path)).count() > 0


def test_pipeline_of_an_empty_table(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_lists_of_scores_stay_finite():
    rng = np.random.default_rng(0)
    index = neighbours.Index(np.arange(50), rng.normal(size=(50, 4)) * 1e-200)
    ids, score = index.search(0, index.vectors[0], 5)
    assert len(ids) == 5 and np.isfinite(score).all()
