import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tarnwerk.llm import queries, suffixes, superminhash  # noqa: E402
from tarnwerk.llm.workspace import Workspace, shared_folder  # noqa: E402

from .helpers import SCHEMA, clashing, odd_rows, prose  # noqa: E402


def test_stages_and_registration():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "suffix_dedup", "packing"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 11)} == {n[: n.index("_") + 1] for n in names if n.startswith("op")}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    passage = prose(99, 60)
    rows = [(i, prose(i, 90) + (passage if i in (3, 4) else ""), "en", "s", 1) for i in range(40)] + [(500, prose(1, 90), "en", "s", 1)] + [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = clashing(docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        at = Workspace(spark, "t").keep(out)
        kept[name] = at.count()
    assert kept["toxicity"] == len(rows)
    assert kept["quality"] < kept["toxicity"] and kept["near_dedup"] < kept["quality"] and kept["suffix_dedup"] == kept["near_dedup"]
    got = {r["doc_id"]: r["text"] for r in at.collect()}
    assert at.where("doc_id = 1005").count() == 1
    assert 1 in got and 500 not in got and passage not in got[3] and passage not in got[4] and got[5 + 5].startswith(prose(10, 90)[:50])
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() >= kept["suffix_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert suffixes.LENGTH == 400 and superminhash.near_duplicates.__defaults__[:2] == (5, 80)


def test_queries_read_whole_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op3_media_columns", "op7_license_scans"):
        assert queries.QUERIES[name](spark, small).count() == docs
    out = queries.op10_chat_formatting(spark, small)
    convs = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count()
    assert out.count() == convs + 1 and out.where(F.col("conv_id") == -7).first()["loss_chars"] == 21


def test_rows_that_share_an_id_have_their_own_verdicts(spark, tmp_path, monkeypatch):
    texts = {i: prose(i, 90) for i in range(1, 9)}
    rows = [(None, texts[1]), (None, texts[2]), (None, "qqbad " + texts[3]), (None, "few words"), (7, texts[1] + " end"), (7, texts[4]), (7, texts[4]), (7, texts[5]), (3, texts[6]), (7, texts[6]), (7, "qqbad"), (None, texts[8]), (None, texts[8])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    found = np.unique(np.concatenate([f for _, _, _, f in corpus_pipeline.toxicity.features(pa.array(["qqbad"]))])).astype(np.int64)
    monkeypatch.setattr(corpus_pipeline.toxicity, "learned", lambda *_: (-6.0, found, np.full(len(found), 20.0, np.float32)))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_quality, corpus_pipeline.drop_near_duplicates):
        at = Workspace(spark, "t").keep(stage(spark, at, str(tmp_path)))
    got = sorted((r["doc_id"] or 0, r["text"][:40]) for r in at.collect())
    assert got == sorted((i, texts[k][:40]) for i, k in ((7, 1), (0, 2), (7, 4), (7, 5), (3, 6), (0, 8)))
