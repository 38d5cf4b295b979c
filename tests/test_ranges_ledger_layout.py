"""Range joins, the answer ledger, table layouts, exports by hash and files that arrive as a stream."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from callscope.operators import ledger as L, models as M
from callscope.operators.browse import lookup
from callscope.operators.ranges import range_join
from callscope.session import scratch_dir
from callscope.sources import files as S, tables as K
from callscope.streaming import live as R


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Ranges


@pytest.mark.parametrize("hot", [10**9, 20])
def test_range_join_equals_the_nested_loop(spark, hot):
    r = random.Random(2)
    points = [(i, r.choice("ab"), r.choice([50.0, 50.0, r.uniform(-100, 1000)])) for i in range(600)] + [(700, "a", None), (701, None, 50.0)]
    spans = [(i, r.choice("ab"), s, s + r.choice([0.0, 0.5, 3.0, 40.0, 900.0])) for i, s in enumerate(r.uniform(-120, 1000) for _ in range(80))]
    spans += [(100, "a", None, 5.0), (101, "a", 5.0, None), (102, "b", 9.0, 8.0), (103, "a", 50.0, 50.0), (104, "a", -1e7, 1e7), (105, None, 0.0, 99.0)]
    a = spark.createDataFrame(points, "p int, k string, x double").repartition(3)
    b = spark.createDataFrame(spans, "s int, k string, lo double, hi double").repartition(3)
    got = sorted((x["p"], x["s"]) for x in range_join(a, b, "x", "lo", "hi", by=["k"], hot=hot).collect())
    want = sorted((p, s) for p, k, x in points for s, j, lo, hi in spans if None not in (k, x, lo, hi) and k == j and lo <= x <= hi)
    assert got == want and len(want) > 1000
    free = sorted((x["p"], x["s"]) for x in range_join(a.drop("k"), b.drop("k"), "x", "lo", "hi", hot=hot).collect())
    assert free == sorted((p, s) for p, _, x in points for s, _, lo, hi in spans if None not in (x, lo, hi) and lo <= x <= hi)


def test_range_join_of_times_has_no_nested_loop(spark):
    base = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(i, base + dt.timedelta(minutes=7 * i)) for i in range(300)], "p int, at timestamp")
    b = spark.createDataFrame([(i, base + dt.timedelta(hours=i), base + dt.timedelta(hours=i, minutes=30)) for i in range(30)], "s int, lo timestamp, hi timestamp")
    out = range_join(a, b, "at", "lo", "hi", least=60)
    want = {(i, s) for i in range(300) for s in range(30) if 60 * s <= 7 * i <= 60 * s + 30}
    assert {(x["p"], x["s"]) for x in out.collect()} == want
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    assert range_join(a, b.where("s > 99"), "at", "lo", "hi").collect() == []
    with pytest.raises(ValueError, match="both tables"):
        range_join(a, b.withColumnRenamed("s", "p"), "at", "lo", "hi")


# Ledger


def _answers(texts):
    if any(t == "bad" for t in texts):
        raise ValueError("no answer")
    return [f"{len(t)}" for t in texts]


def test_ledger_asks_each_text_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def run(texts):
            calls.add(len(texts))
            return _answers(texts)

        return run

    df = spark.createDataFrame([(i, ["a", "bb", "ccc"][i % 3]) for i in range(300)] + [(900, None), (901, ""), (902, "bad")], "id int, t string").repartition(5)
    first = {r["id"]: r["_call"] for r in L.answered(df, "t", factory, path, "v1", "b1", micro_batch=1).collect()}
    assert len(first) == 303 and first[4]["value"] == "2" and first[901]["value"] == "0" and first[900] is None
    assert first[902]["error"].startswith("ValueError") and calls.value == 5
    for batch, more in (("b1", 2), ("b2", 1)):  # a repeated batch, then the next one: of what it has, the error only
        before = calls.value
        again = {r["id"]: r["_call"] for r in L.answered(df, "t", factory, path, "v1", batch, micro_batch=1).collect()}
        assert {k: v and v["value"] for k, v in again.items()} == {k: v and v["value"] for k, v in first.items()}
        assert calls.value - before == (5 if batch == "b1" else 1), (batch, more)
    grown = df.union(spark.createDataFrame([(999, "dddd")], df.schema))
    before = calls.value
    assert {r["id"]: r["_call"] for r in L.answered(grown.where("t <> 'bad'"), "t", factory, path, "v1", "b3", micro_batch=1).collect()}[999]["value"] == "4"
    assert calls.value - before == 1
    L.answered(df.where("t <> 'bad'"), "t", factory, path, "v2", "b1", micro_batch=1).count()
    assert calls.value - before == 5 and L.read_ledger(spark, path, "v2").count() == 4


def test_ledger_with_hot_texts(spark, tmp_path):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(120)] + [(500, None)], "id int, t string").repartition(4)
    out = {r["id"]: r["_call"] for r in L.answered(df, "t", lambda: _answers, str(tmp_path / "l"), "v", "b", hot=10).collect()}
    assert len(out) == 121 and all(out[i]["value"] == ("4" if i % 3 else str(len(f"t{i}"))) for i in range(120)) and out[500] is None
    assert L.answered(df.limit(0), "t", lambda: _answers, str(tmp_path / "l"), "v", "b0").collect() == []


def test_ledger_stores_hashes_not_texts(spark, tmp_path, monkeypatch):
    """Both ways to the texts that are asked give the same rows, and neither writes a text."""
    written, store = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, label: (written.extend(df.columns), store(df, label))[1])
    df = spark.createDataFrame([(i, f"t{'x' * (i % 7)}") for i in range(60)] + [(500, None)], "id int, t string").repartition(4)
    rows = []
    for few in (0, 1000):
        monkeypatch.setattr(L, "_FEW", few)
        path = str(tmp_path / f"l{few}")
        for batch in ("b1", "b2"):
            rows.append(sorted((r["id"], r["_call"] and r["_call"]["value"]) for r in L.answered(df, "t", lambda: _answers, path, "v", batch).collect()))
        assert L.read_ledger(spark, path, "v").count() == 7
    assert all(r == rows[0] for r in rows) and len(rows[0]) == 61 and dict(rows[0])[6] == "7"
    assert "_text" not in written and "t" not in written


def test_enrich_with_a_ledger_gives_the_same_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", "x" * 30), ("b", "y"), ("c", None)], "doc_id string, t string")
    model = lambda: lambda texts: ['{"caller_intent": "投诉", "sentiment": "negative"}' if len(t) > 5 else "" for t in texts]
    path = str(tmp_path / "l")
    plain = sorted(M.enrich(df, "doc_id", "t", model).collect())
    kept = M.enrich(df, "doc_id", "t", model, ledger=lambda rows, text: L.answered(rows, text, model, path, "v", "b"))
    assert sorted(kept.collect()) == plain


# Layouts


def scanned(df):
    """Rows that the scans of a frame hand on, after row groups were ruled out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        else:
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_curve_prunes_both_columns_and_bloom_prunes_keys(spark, tmp_path):
    r = random.Random(1)
    rows = [(str(uuid.UUID(int=r.getrandbits(128))), r.randrange(100_000), r.choice(["aa", "bb", "cc", "dd", None]), i) for i in range(40_000)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id string, a long, b string, n int").repartition(8).write.parquet(path)
    small = {"parquet.block.size": "65536", "parquet.page.row.count.limit": "2000", "parquet.block.row.count.limit": "1000"}
    laid = spark.read.parquet(K.compact_clustered(spark, path, ("a", "b"), "id", files=32, **small))
    assert laid.count() == 40_000 and sorted(laid.collect(), key=lambda x: x["n"])[7] == rows[7]
    before = spark.read.parquet(path)
    for where in ("a between 5000 and 6000", "b = 'cc' and a < 20000", "b is null"):
        assert sorted(x["n"] for x in laid.where(where).collect()) == sorted(x["n"] for x in before.where(where).collect())
    assert scanned(before.where("a between 5000 and 6000")) == 40_000
    assert scanned(laid.where("a between 5000 and 6000")) < 0.35 * 40_000
    assert scanned(laid.where("b = 'cc'")) < 0.7 * 40_000
    asked = lookup(laid, "id", rows[123][0])
    assert [x["n"] for x in asked.collect()] == [123]
    assert scanned(laid.where(F.col("id") == rows[123][0])) < 0.4 * 40_000  # ids are random: only blooms can tell


def test_curve_of_odd_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 1.0), (3, None, float("nan"))], "id int, a string, x double")
    df.write.parquet(path)
    assert spark.read.parquet(K.compact_clustered(spark, path, ("a", "x"))).count() == 3
    df.limit(0).write.mode("overwrite").parquet(path)
    assert spark.read.parquet(K.compact_clustered(spark, path, ("a", "x"))).count() == 0


def test_count_of_cuts(one):
    cuts = [1.0, 2.0, 5.0]
    for value, want in ((0.5, 0), (1.0, 1), (1.5, 1), (2.0, 2), (4.9, 2), (5.0, 3), (9.0, 3), (None, None)):
        assert one(K.let_count(cuts, F.col("t")), "t double", (value,)) == want


def test_bucketed_merges_leave_the_base_where_it_is(spark, tmp_path):
    names = [f"default.b_{uuid.uuid4().hex}" for _ in range(3)]
    base = spark.createDataFrame([(i, f"r{i}") for i in range(500)] + [(None, "none")], "doc_id int, a string")
    K.save_bucketed(base, names[0], "doc_id", 4, str(tmp_path / "0"))
    new = spark.createDataFrame([(i, i * 2, "skipped") for i in range(0, 500, 2)] + [(None, 7, "x")], "doc_id int, b int, a string")
    assert K.merge_bucketed(spark, names[0], new, "doc_id", names[1], path=str(tmp_path / "1")) == ["b"]
    later = spark.createDataFrame([(i, i * 3) for i in range(0, 500, 5)], "doc_id int, c int")
    merged, added, buckets = K.merged_bucketed(spark, names[1], later, "doc_id")
    assert added == ["c"] and buckets == 4
    plan = plan_of(merged)
    side = plan[: plan.index("REPARTITION_BY_NUM")]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in side and "Bucketed: true" in plan
    K.merge_bucketed(spark, names[1], later, "doc_id", names[2], path=str(tmp_path / "2"))
    got = {x["doc_id"]: (x["a"], x["b"], x["c"]) for x in spark.table(names[2]).collect()}
    assert len(got) == 501 and got[10] == ("r10", 20, 30) and got[3] == ("r3", None, None) and got[None] == ("none", None, None)
    assert spark.sql(f"DESCRIBE EXTENDED {names[2]}").where("col_name = 'Num Buckets'").first()["data_type"] == "4"
    with pytest.raises(ValueError, match="repeats"):
        K.merge_bucketed(spark, names[0], new.union(new), "doc_id", names[2])
    spark.createDataFrame([(1,)], "doc_id int").createOrReplaceTempView("plain_view")
    with pytest.raises(ValueError, match="not bucketed"):
        K.merge_bucketed(spark, "plain_view", new, "doc_id", names[2])


def test_snapshots_of_one_instant(spark, tmp_path):
    path = str(tmp_path / "d")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for name in ("s1", "s2"):
        K.append_daily(spark.createDataFrame([("2024-01-01", 5)], "date string, total_calls int"), path, name, at)
    daily = K.read_daily(spark, path)
    assert K.as_of(daily, "s1").count() == 1 and K.as_of(daily, "s2").count() == 2


# Files


def test_export_takes_any_id(spark, tmp_path):
    ids = ["a/" * 60, "é" * 60, "..", ".", "_x", ".hidden", "x" * 1000, "plain.WAV", "a b?*:\n", "CON", "", None, "empty", "null"]
    rows = [(i, None if i == "null" else b"" if i == "empty" else f"blob of {i}".encode()) for i in ids] + [("plain.WAV", b"blob of plain.WAV"), ("unasked", b"z")]
    df = spark.createDataFrame(rows, "doc_id string, audio_blob binary").repartition(3)
    out = str(tmp_path / "out")
    asked = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    listed = {r["doc_id"]: (r["name"], r["size"]) for r in S.export_blobs(df, asked, out).collect()}
    assert set(listed) == set(ids) - {None, "empty", "null"}
    assert all((tmp_path / "out" / name).read_bytes() == f"blob of {i}".encode() and size == len(f"blob of {i}".encode()) for i, (name, size) in listed.items())
    assert {r["path"].rsplit("/", 1)[1] for r in S.list_objects(spark, out).collect()} == {name for name, _ in listed.values()}
    assert [r["doc_id"] for r in S.build_manifest(spark, out).collect()] == ["plain.WAV"] == [listed["plain.WAV"][0]]
    assert len({name for name, _ in listed.values()}) == len(listed) and len(listed["x" * 1000][0]) == 66
    S.export_blobs(df, asked, "file:" + out)  # as a path of Hadoop is written; the same files again
    assert S.list_objects(spark, out).count() == len(listed)


def test_files_that_arrive_in_batches(spark, tmp_path):
    folder, sink, state = (str(tmp_path / x) for x in ("in", "sink", "state"))
    (tmp_path / "in").mkdir()
    manifest = spark.createDataFrame([(i, f"f{i}.jpg") for i in range(6)] + [(9, None)], "doc_id int, file string")

    def arrive(*names, text="v1"):
        for n in names:
            (tmp_path / "in" / n).write_bytes(f"{text} {n}".encode())

    arrive("f0.jpg", "f5.jpg", "stray.jpg")
    S.attach_stream(spark, manifest.where("doc_id <> 5"), folder, "file", sink, state).awaitTermination()
    arrive("f1.jpg", "f2.jpg")
    S.attach_stream(spark, manifest, folder, "file", sink, state).awaitTermination()
    arrive("f3.jpg")
    S.attach_stream(spark, manifest, folder, "file", sink, state, most_files=1).awaitTermination()
    S.attach_stream(spark, manifest, folder, "file", sink, state).awaitTermination()
    got = {r["doc_id"]: (r["analysis_status"], bytes(r["image_blob"]) if r["image_blob"] else None) for r in S.read_attached(spark, manifest, folder, "file", sink).collect()}
    assert got == {**{i: ("pending", f"v1 f{i}.jpg".encode()) for i in (0, 1, 2, 3, 5)}, 4: ("download_failed", None), 9: ("download_failed", None)}
    whole = S.read_files(spark, folder).withColumn("path", S.file_name(F.col("path")))
    batch = {r["doc_id"]: r["analysis_status"] for r in S.attach_blobs(manifest, whole, "file").collect()}
    assert batch == {i: s for i, (s, _) in got.items()}
    stored = spark.read.parquet(sink)
    assert stored.count() == 6 + 0 and stored.where("content is null").count() == 2  # f5 came before its row, and the stray
    assert S.read_attached(spark, manifest, folder, "file", sink, missing="drop").count() == 5


def test_late_names_need_no_second_reading(spark, tmp_path):
    folder, sink, state = (str(tmp_path / x) for x in ("in", "sink", "state"))
    (tmp_path / "in").mkdir()
    manifest = spark.createDataFrame([(i, f"f{i}.jpg") for i in range(200)], "doc_id int, file string")
    for i in range(199):
        (tmp_path / "in" / f"f{i}.jpg").write_bytes(b"v%d" % i)
    query = S.attach_stream(spark, manifest.where("doc_id >= 100"), folder, "file", sink, state)
    query.awaitTermination()
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup(str(query.runId)) for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    assert tasks and max(tasks) < 199  # no task for each file
    for i in range(50):
        (tmp_path / "in" / f"f{i}.jpg").unlink()
    got = {r["doc_id"]: r["image_blob"] for r in S.read_attached(spark, manifest, folder, "file", sink).collect()}
    assert got == {**{i: bytearray(b"v%d" % i) for i in range(199)}, 199: None}
    old = str(tmp_path / "old")  # as earlier versions wrote it
    spark.read.parquet(sink).drop("waiting").write.partitionBy("batch_id").parquet(old)
    got = {r["doc_id"]: r["image_blob"] for r in S.read_attached(spark, manifest, folder, "file", old).collect()}
    assert got == {**dict.fromkeys(range(50)), **{i: bytearray(b"v%d" % i) for i in range(50, 199)}, 199: None}


# Streams


def test_repeated_ids_are_analysed_once_and_counted(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "call_id string, transcript string, ts timestamp"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    counts = R.count_rows(spark)
    total = {"rows": 0, "late": 0, "repeated": 0}
    parts = [[("a", "我要销户", at(1)), ("b", "我要投诉", at(1)), ("a", "again", at(2))], [("a", "once more", at(3)), ("c", "text", at(4)), ("", "no id", at(4)), ("", "no id", at(4))], [("late", "too late", dt.datetime(2023, 1, 1))], [("d", "x", at(5))]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        q = R.analyze_stream(spark.readStream.schema(schema).parquet(source), sink, state, once_within="1 day")
        q.awaitTermination()
        for k, v in counts.of(q).items():
            total[k] += v
    spark.streams.removeListener(counts)
    rows = [(r["call_id"], r["transcript"]) for r in spark.read.parquet(sink).collect()]
    named = sorted(r for r in rows if not r[0].startswith("call_2"))
    assert [c for c, _ in named] == ["a", "b", "c", "d"] and named[0][1] in ("我要销户", "again")
    made = [c for c, _ in rows if c.startswith("call_2")]
    assert len(made) == 2 and len(set(made)) == 2  # two calls without an id are two
    assert total["rows"] == 9 and total["repeated"] == 2 and total["late"] == 1
    assert R.late_rows(q, counts) == 0
