"""The queries of the corpus operators on the smallest tables."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavemill.llm.entries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13": ["doc_id", "n_shingles", "component_id", "kept"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    want = COLUMNS.get(name.split("_")[0], [])
    assert found.columns[: len(want)] == want
    rows = found.collect()
    assert rows
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    result = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    assert columns == sorted(found.columns)
    place = {c[0]: k for k, c in enumerate(result.description)}
    assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str([r[place[c]] for c in columns]) for r in result.fetchall())


def test_pipeline_drops_rows_and_not_ids(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [
        (None, text(1), "a"),
        (None, text(1), "b"),
        (None, text(1), "b"),
        (5, text(1) + " tail", "a"),
        (None, text(2), "a"),
        (None, text(2), "b"),
        (7, text(3), "a"),
        (7, text(4), "a"),
        (6, text(4), "a"),
        (None, None, "a"),
        (None, None, "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted([(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()], key=str)
    assert kept == sorted([(5, text(1) + " tail"), (None, text(2)), (7, text(3)), (6, text(4)), (None, None), (None, None)], key=str)

    spark.createDataFrame([(1, text(2)), (2, text(4))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = sorted([(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()], key=str)
    assert clean == sorted([r[:2] for r in rows if r[1] not in (text(2), text(4))], key=str)


def odd_tables(spark, folder):
    """Documents with nulls, repeats, ties and columns of clashing names."""
    rng = np.random.default_rng(41)
    prose = lambda n: " ".join(f"w{rng.integers(3000)}" for _ in range(n))
    item, rows = prose(30), []
    for k in range(400):
        text = prose(int(rng.integers(30, 80)))
        if k % 5 == 0:
            text = text.replace(" ", "### ")  # bad
        if k % 11 == 1:
            text += f" {item} " + prose(5)  # leaks
        if k % 13 == 2:
            text += " password = hunter2hunter2 end"
        rows.append((k, text, "en", ("a", "b", None)[k % 3], len(text)))
    rows += [(500 + k, rows[7 + k // 4][1] + f" tail{k}", "en", "a", 9) for k in range(8)]  # near copies
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (None, None, None, None, None), (600, "", "de", "b", 0), (601, None, "de", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {"_key": F.lit(1), "_size": F.lit("s"), "size": F.lit(2), "_qc_kept": F.lit(False), "did": F.lit(3), "id": F.lit("i"), "label": F.lit(4), "copies": F.lit(0.5), "key": F.lit(5)}
    docs = docs.withColumns(clash)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 5 != 0), 0) for k in range(0, 400, 2)] + [(None, 1, 0), (1, None, None), (9999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, rows, item


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, rows, item = odd_tables(spark, str(tmp_path))
    kept, before = docs, [(r[0], r[1]) for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns, name
        now = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        if name == "quality_classifier":
            bad = [t for _, t in before if t and "###" in t]
            assert len([1 for _, t in now if t and "###" in t]) <= 0.1 * len(bad)
            assert len([1 for _, t in now if t and "###" not in t]) >= 0.95 * len([1 for _, t in before if t and "###" not in t])
        elif name == "near_duplicates":
            same = lambda t: t.split(" tail")[0]
            assert Counter(same(t) for _, t in now if t) == Counter({same(t): 1 for _, t in before if t})
            assert sum(not t for _, t in now) >= len({x for x in before if not x[1]})
        elif name == "decontamination":
            assert sorted(now, key=str) == sorted([x for x in before if not x[1] or item not in x[1]], key=str)
        elif name == "secret_scan":
            assert [i for i, _ in sorted(now, key=str)] == [i for i, _ in sorted(before, key=str)]
            assert not any(t and "hunter2" in t for _, t in now) and sum(bool(t) and "[SECRET]" in t for _, t in now) == sum(bool(t) and "hunter2" in t for _, t in before)
        else:
            taken = {r.source: (r.taken, r.target) for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
            assert all(abs(a - b) <= 80 for a, b in taken.values()) and set(out.columns) >= set(docs.columns) | {"copies", "taken", "target"}
            assert out.filter("copies < 1 or copies > 3").isEmpty()
        kept, before = spark.createDataFrame(out.collect(), out.schema) if now else out, now


def test_pipeline_runs_and_leaves_one_table(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() > 0
    folder = os.path.dirname(found.inputFiles()[0].removeprefix("file:"))
    assert os.listdir(os.path.dirname(folder)) == ["4-mixing"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, tmp_path, name, stage):
    for table, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "a few words", "en", "s", 11), (2, None, None, None, None)], docs.schema)
    assert stage(spark, some, str(tmp_path)).count() <= 2
