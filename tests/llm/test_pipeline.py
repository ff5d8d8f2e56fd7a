"""Stages of the pipeline on odd rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

STAGES = dict(P.STAGES)
LONG = "longword " * 40_000
LINE = "one line that is long enough to be counted here"
ITEM = "The quick brown fox jumps over the lazy dog near the river. It was a sunny day."
GOOD, BAD = "careful words that explain the matter well ", "$$$ click !!! win >>> now ### free "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(1000, 1060)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def frame(spark, rows):
    """Rows of doc_id and text with columns that are named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return df.withColumns({"n_chars": F.char_length("text").cast("bigint"), "N_lines": own, "n_dropped": own, "leaks": own, "score": own, "component_id": own, "ids": own, "n_tokens": own, "rep": own, "digest": own, "shard": own, "key": own})


def told(df):
    return sorted((repr((r["doc_id"], r["text"])) for r in df.collect()))


def untouched(df):
    return all({r[c] for c in df.columns[3:]} == {f"own {'-' if r['doc_id'] is None else r['doc_id']}"} for r in df.collect())


ODD = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "a b c d e f"), (4, " \n\t"), (5, "é" * 50)]


def test_quality(spark, folder):
    rows = [(i, (GOOD if i % 2 else BAD) * 20) for i in range(1000, 1060)] + [*ODD, (7, GOOD * 30), (7, GOOD * 30), (8, BAD * 30)]
    df = frame(spark, rows)
    out = STAGES["quality"](spark, df, folder)
    assert out.columns == df.columns and out.dtypes == df.dtypes and untouched(out)
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(7) == 2 and 8 not in ids and 1 not in ids and 2 not in ids  # half of the labels are 0, so an empty text gets 0.5
    assert STAGES["quality"](spark, df.limit(0), folder).count() == 0


def test_line_dedup(spark, folder):
    rows = [*ODD, *((i, f"{LINE}\nown {i}") for i in range(10, 16)), (15, f" {LINE.upper()}\t"), (16, LINE), (16, LINE)]
    df = frame(spark, rows)
    out = STAGES["line_dedup"](spark, df, folder)
    assert out.columns == df.columns and out.dtypes == df.dtypes and untouched(out)
    assert told(out) == sorted(repr(r) for r in [*ODD, *((i, f"own {i}") for i in range(10, 16)), (15, ""), (16, LINE), (16, LINE)])
    assert {(r["doc_id"], r["n_chars"]) for r in out.where("doc_id between 10 and 14").collect()} == {(i, 6) for i in range(10, 15)}
    assert STAGES["line_dedup"](spark, df.limit(0), folder).count() == 0


def test_near_duplicates(spark, folder):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [*ODD, (20, base), (21, base), (21, base), (22, base + " end"), (23, base.upper()), (24, "w1 w2"), (25, "W1  w2")]
    df = frame(spark, rows)
    out = STAGES["near_duplicates"](spark, df, folder)
    assert out.columns == df.columns and untouched(out)
    assert told(out) == sorted(repr(r) for r in [*ODD, (20, base), (24, "w1 w2")])
    assert STAGES["near_duplicates"](spark, df.limit(0), folder).count() == 0


def test_decontamination(spark, folder):
    rows = [*ODD, (30, "before " + ITEM + " after"), (30, "clean"), (31, LONG + ITEM), (32, ITEM), (32, ITEM), (None, ITEM)]
    df = frame(spark, rows)
    out = STAGES["decontamination"](spark, df, folder)
    assert out.columns == df.columns and untouched(out)
    assert told(out) == sorted(repr(r) for r in [*ODD, (30, "clean")])
    assert STAGES["decontamination"](spark, df.limit(0), folder).count() == 0


def test_encode(spark, folder):
    out = STAGES["encode"](spark, frame(spark, ODD), folder)
    assert out.columns == ["doc_id", "ids", "n_tokens"]
    got = out.collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0} and len({r["n_tokens"] for r in got if r["doc_id"] == 3}) == 1
    assert STAGES["encode"](spark, frame(spark, ODD).limit(0), folder).count() == 0
