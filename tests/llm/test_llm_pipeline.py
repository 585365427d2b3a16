"""The stages of the corpus pipeline, on documents with planted cases."""

import importlib.util
import re

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("corpus_pipeline.py is absent", allow_module_level=True)

import corpus_pipeline as C  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    tables = [docs.toPandas()]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        tables.append(docs.toPandas())
        if k < len(C.STAGES) - 1:
            assert sorted(docs.columns) == sorted(columns), name
            assert set(tables[-1]["doc_id"]) <= set(tables[-2]["doc_id"]) and counts[-1] <= counts[-2]
    norm = tables[2]["text"].map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))
    assert not norm.duplicated().any() and set(norm) == set(tables[1]["text"].map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)))
    least = tables[1].assign(n=tables[1]["text"].map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))).groupby("n")["doc_id"].min()
    assert set(least) == set(tables[2]["doc_id"])
    sizes = tables[-1].groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 2048 and set(tables[-1]["doc_id"]) == set(tables[-2]["doc_id"])


def test_run(spark):
    assert C.run(spark, SF).count() > 0


ODD = [
    (1, "plain words of a short text", "en", "s", 5, True, 1, "x"),
    (1, "plain words of a short text", "en", "s", 5, True, 1, "x"),
    (2, None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None),
    (None, "plain words of a short  text", "en", None, 1, True, 1, "x"),
    (3, "", "en", "s", 0, False, 2, ""),
    (4, " \n\t ", "de", "s", 0, False, 2, ""),
    (5, "long words here " * 30_000, "en", "s", 9, True, 3, "y"),
    (6, "long words here " * 30_000, "en", "t", 9, True, 3, "y"),
]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows_through_every_stage(spark, rows):
    """Nulls in any column, repeats, very long texts, clashing column names, no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, th long, sequence_id string"
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = out.collect()
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert len(got) <= max(1, len(rows)) and set(r["doc_id"] for r in got) <= set(r[0] for r in rows)
        if name == "exact dedup" and rows:
            assert len(got) == 4  # plain, empty, blank, long: by normalised text
        if name == "minhash near-dedup" and rows:
            # Rows without words are linked with nothing; the null id gives way to 1.
            assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "4", "5", "None"]
