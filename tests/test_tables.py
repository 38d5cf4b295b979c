import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from callscope.operators.calls import analyze_calls
from callscope.schemas import CALL_ANALYSIS, DAILY_CHURN
from callscope.sources import archive as Z, files as S, tables as K


def test_append_and_browse(spark, tmp_path):
    path = str(tmp_path / "calls")
    calls = spark.createDataFrame([("a", "我要销户199元"), ("b", "您好")], "call_id string, transcript string")
    K.append_analysis(analyze_calls(calls), path)
    K.append_analysis(spark.createDataFrame([("c",)], "call_id string"), path)
    stored = spark.read.parquet(path)
    assert [f.dataType for f in stored.schema.fields] == [f.dataType for f in CALL_ANALYSIS.fields]
    got = {r["call_id"]: r for r in K.browse(stored, 10).collect()}
    assert got["a"]["key_entities"] == {"amount_yuan": "199"} and got["c"]["key_entities"] == {}
    assert (got["c"]["sentiment"], got["c"]["risk_level"], got["c"]["duration_seconds"]) == ("neutral", "low", 0)
    assert len(got["a"]["embedding"]) == 16 and got["c"]["embedding"] == [0.0] * 16
    bad = stored.withColumn("key_entities", F.lit("{bad"))
    assert K.browse(bad, 1).first()["key_entities"] == {}


def test_create(spark, tmp_path):
    path = str(tmp_path / "t")
    K.create_table(spark.range(3).toDF("x"), path, overwrite=False)
    K.create_table(spark.range(2).toDF("x"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        K.create_table(spark.range(2).toDF("x"), path, overwrite=False)


def test_merge(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, x int")
    new = spark.createDataFrame([("a", 10, 7)], "doc_id string, x int, y int")
    merged, names = K.merge_columns(base, new)
    assert names == ["y"] and sorted(tuple(r) for r in merged.collect()) == [("a", 1, 7), ("b", 2, None)]
    replaced, names = K.merge_columns(base, new, replace=True)
    assert names == ["x", "y"] and {r["doc_id"]: r["x"] for r in replaced.collect()} == {"a": 10, "b": None}
    assert K.merge_columns(base, base)[1] == []
    with pytest.raises(ValueError):
        K.add_column(base, "x", F.lit(1))
    assert K.add_column(base, "z", F.lit(1)).columns == ["doc_id", "x", "z"]
    with pytest.raises(TypeError):
        K.assert_type(base, "x", T.BinaryType())
    K.assert_type(base, "x", T.IntegerType())


def test_daily_snapshots(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = spark.createDataFrame([("2024-01-01", 5)], "date string, total_calls bigint").withColumn("date", F.to_date("date"))
    K.append_daily(day, path, "s1", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    K.append_daily(day.withColumn("total_calls", F.lit(6)), path, "s2", F.lit("2024-01-02 10:00:00").cast("timestamp"))
    table = K.read_daily(spark, path)
    assert os.path.isdir(f"{path}/date=2024-01-01")
    assert table.schema["avg_sentiment_score"].dataType == DAILY_CHURN["avg_sentiment_score"].dataType
    assert table.count() == 2 and K.snapshots(table).count() == 2
    assert [r["total_calls"] for r in K.as_of(table, "s1").collect()] == [5]
    assert K.as_of(table, "s2").count() == 2
    assert table.first()["top_switch_reason"] == "N/A"
    with pytest.raises(LookupError):
        K.as_of(table, "s3")


def test_rewrite_and_compact(spark, tmp_path):
    path = str(tmp_path / "frag")
    spark.range(0, 8, 1, 8).write.parquet(path)
    assert tuple(K.fragmentation(spark.read.parquet(path)).first())[:2] == (8, 8)
    assert K.compact(spark, path, file_bytes=1) is None
    new = K.compact(spark, path)
    assert tuple(K.fragmentation(spark.read.parquet(new)).first())[:2] == (1, 8)
    assert K.compact(spark, new) is None
    spark.sql("CREATE DATABASE IF NOT EXISTS lake")
    table = K.register(spark, "lake", path, "frag_table")
    try:
        K.swap(spark, table, new)
        assert spark.table(table).count() == 8
        described = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
        assert described["row_count"] == "8"
        tree = K.catalog_tree(spark).where("database = 'lake'").collect()
        assert [(r["table"], r["columns"]) for r in tree] == [("frag_table", 1)]
    finally:
        spark.sql(f"DROP TABLE {table}")


def test_archive(spark, tmp_path):
    folder = str(tmp_path / "lake")
    calls = spark.createDataFrame([("a", "我要销户"), ("b", "您好")], "call_id string, transcript string")
    Z.archive(Z.raw_documents(calls), folder, "raw_audio")
    Z.archive(Z.analysis_documents(analyze_calls(calls)), folder, "voice_analysis")
    Z.archive(spark.createDataFrame([("2024-01-01", 3)], "date string, total int"), folder, "analytics")
    assert Z.document(Z.read_archive(spark, folder, "raw_audio"), "call_id", "a")["transcript"] == "我要销户"
    assert Z.document(Z.read_archive(spark, folder, "voice_analysis"), "call_id", "a")["intent"] == "销户"
    assert Z.document(Z.read_archive(spark, folder, "analytics"), "date", "2024-01-01")["total"] == 3
    assert Z.document(Z.read_archive(spark, folder, "raw_audio"), "call_id", "z") is None
    stats = {r["prefix"]: r["objects"] for r in Z.object_stats(spark, folder).collect()}
    assert set(stats) == {"raw_audio", "voice_analysis", "analytics"} and all(n >= 1 for n in stats.values())
    with pytest.raises(ValueError):
        Z.archive(calls, folder, "elsewhere")


def test_manifests(spark, tmp_path):
    frame = spark.createDataFrame([("a", "s3://x/a"), ("b", "s3://x/b")], "doc_id string, s3_url string").withColumn("more", F.lit(1))
    frame.write.parquet(str(tmp_path / "m.parquet"))
    (tmp_path / "m.jsonl").write_text('{"doc_id": "a", "s3_url": "u"}\n')
    (tmp_path / "m.csv").write_text("doc_id,s3_url,more\na,u,1\n")
    for name, n in (("m.parquet", 2), ("m.jsonl", 1), ("m.csv", 1)):
        got = S.read_manifest(spark, str(tmp_path / name))
        assert got.columns == ["doc_id", "s3_url"] and got.count() == n
    with pytest.raises(ValueError):
        S.read_manifest(spark, "m.xlsx")


@pytest.mark.parametrize("rows,message", [([], "non-empty"), ([{"doc_id": ""}], "needs"), ([{"file": "x"}], "needs"), ([{"doc_id": "a"}, {"doc_id": "a"}], "repeat")])
def test_bad_json_manifest(spark, tmp_path, rows, message):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(rows))
    with pytest.raises(ValueError, match=message):
        S.read_json_manifest(spark, str(path))


def test_files(spark, tmp_path):
    media = tmp_path / "media"
    (media / "sub").mkdir(parents=True)
    (media / "b.wav").write_bytes(b"RIFF1")
    (media / "sub" / "a.MP3").write_bytes(b"ID3")
    (media / "note.txt").write_bytes(b"no")
    got = S.build_manifest(spark, str(media)).collect()
    assert [r["doc_id"] for r in got] == ["a.MP3", "b.wav"]
    assert {r["size"] for r in S.list_objects(spark, str(media)).collect()} == {5, 3, 2}
    rows = [{"doc_id": d, "file": f} for d, f in (("x", "b.wav"), ("y", "gone.wav"))]
    (tmp_path / "manifest.json").write_text(json.dumps(rows))
    manifest = S.read_json_manifest(spark, str(tmp_path / "manifest.json")).withColumn("text", F.lit("文本"))
    files = S.read_files(spark, str(media)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    kept = {r["doc_id"]: r for r in S.attach_blobs(manifest, files, "file").collect()}
    assert (kept["x"]["analysis_status"], kept["y"]["analysis_status"], kept["y"]["embedding_status"]) == ("pending", "download_failed", "skipped")
    assert kept["x"]["mime_type"] == "audio/x-wav"
    assert [r["doc_id"] for r in S.attach_blobs(manifest, files, "file", missing="drop").collect()] == ["x"]
    text = {r["doc_id"]: r for r in S.attach_blobs(manifest, files, "file", missing="text", blob="audio_blob", text="text").collect()}
    assert bytes(text["y"]["audio_blob"]).decode() == "文本" and not text["y"]["from_audio"] and text["x"]["from_audio"]
    stored = S.attach_blobs(manifest, files, "file")
    assert S.blob_lookup(stored, "doc_id", "x") == (b"RIFF1", "audio/x-wav")
    for missing in ("y", "z"):
        with pytest.raises(FileNotFoundError):
            S.blob_lookup(stored, "doc_id", missing)
    out = tmp_path / "out"
    ids = spark.createDataFrame([("x",), ("y",), ("../evil",)], "doc_id string")
    S.export_blobs(stored, ids, str(out), blob="image_blob")
    assert sorted(os.listdir(out)) == ["x"] and (out / "x").read_bytes() == b"RIFF1"
