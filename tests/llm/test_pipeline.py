"""The pipeline, stage by stage, against plain versions on whole small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerlens.llm import mixing, quality, secret_scan, sentencepiece

from ..conftest import SF_ORACLE, SF_SMALL
from .data import DOCS, clashing, near_copies
from .test_joins import brute_jaccard
from .test_operators import edge_docs, plain_spans


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_stages_are_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]


def test_quality_drops_what_it_rejects(spark, documents):
    kept = P.quality(spark, documents, SF_SMALL)
    assert kept.schema.names == documents.schema.names
    scores = quality.quality_report(spark, documents, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    want = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < documents.count()


@pytest.mark.parametrize("seed", [3, 8])
def test_one_of_each_group_stays(spark, seed):
    rows = near_copies(seed)
    df = clashing(spark.createDataFrame(rows, DOCS))
    kept = P.near_duplicates(spark, df, SF_SMALL)
    assert kept.columns == df.columns
    comp, _ = brute_jaccard([(r[0], r[1]) for r in rows])
    want = {i for i, (_, c) in comp.items() if c == i}
    assert rows_of(kept) == rows_of(df.where(F.col("doc_id").isin(sorted(want))))


@pytest.mark.parametrize("order", range(3))
def test_no_text_goes_because_an_id_repeats(spark, order):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(2, a), (1, b), (1, a), (None, a), (None, a), (None, "only a row without an id says this"), (None, "ONLY a row without an id says this"),
            (5, None), (5, None), (None, ""), (None, ""), (1 << 62, "an id beyond two to the power of sixty two"), (-3, "an id below zero is the smallest one"),
            (1 << 62, "An id beyond two to the power of sixty two"), (9, b), (9, b)]
    rows = [rows, rows[::-1], rows[5:] + rows[:5]][order]
    df = clashing(spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(3))
    kept = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, df, SF_SMALL).collect()]
    words = [k for k in kept if k[1]]
    assert sorted(k[1].lower() for k in words) == sorted({t.lower() for _, t in rows if t})  # every text once
    assert {k for k in words if k[1] in (a, b)} == {(1, a), (1, b)} and (None, a) not in kept
    assert sorted((k for k in kept if not k[1]), key=str) == sorted((r for r in rows if not r[1]), key=str)


def test_secrets_are_masked(spark):
    documents = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    out = {r["doc_id"]: r for r in P.secrets(spark, documents, SF_SMALL).collect()}
    changed = 0
    for r in documents.collect():
        text, at = "", 0
        for a, _, b in plain_spans(r["text"])[1]:
            if a >= at:
                text += r["text"][at:a] + secret_scan.MASK
            at = max(at, b)
        text += r["text"][at:]
        got = out[r["doc_id"]]
        assert got["text"] == text and got["n_chars"] == (len(text) if text != r["text"] else r["n_chars"])
        assert (got["lang"], got["source"]) == (r["lang"], r["source"])
        changed += text != r["text"]
    assert changed and not any(plain_spans(r["text"])[0] for r in out.values())


def test_the_mixture_draw_takes_effect(spark, documents):
    kept = P.mixture(spark, documents, SF_SMALL)
    assert kept.schema == documents.schema
    want = mixing.mix_report(spark, documents, share=P.MIX_SHARE).where("kept").select("doc_id")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in want.collect())


def test_tokens_are_the_librarys(spark, documents):
    import sentencepiece as library
    lib = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_FILE)
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in P.tokens(spark, documents, SF_SMALL).collect():
        assert r["ids"] == lib.encode(text[r["doc_id"]]) and r["n_pieces"] == len(r["ids"])


def test_run_is_its_stages(spark, documents):
    df = documents
    for _, stage in P.STAGES:
        df = stage(spark, df, SF_SMALL)
    assert rows_of(P.run(spark, SF_SMALL)) == rows_of(df)
    assert 0 < df.count() < documents.count()
    assert all(r["n_pieces"] > 0 for r in df.collect())


def test_stages_take_edge_rows_and_clashing_columns(spark):
    df = edge_docs(spark)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF_SMALL)
        assert out.columns == df.columns, name
        if name == "secrets":
            assert rows_of(out) == rows_of(df)
        if name == "near_duplicates":
            ids = sorted((r["doc_id"] for r in out.collect()), key=str)
            assert ids == sorted([1, 2, 3, 4, 5, 6, 7, None], key=str)
        extra = {r["doc_id"]: r["score"] for r in out.collect()}
        assert set(extra.values()) <= {"extra score"}
        assert stage(spark, df.limit(0), SF_SMALL).count() == 0
    got = {r["doc_id"]: r["n_pieces"] for r in P.tokens(spark, df, SF_SMALL).collect()}
    assert got[1] is None and got[2] == 0 and got[6] > 60_000
