"""Hot groups and plans: what must hold when a third of all rows share a key."""

import pytest
from pyspark.sql import functions as F

from callscope.operators import aggregates as A, calls as C, similarity as N
from callscope.queries import QUERIES
from callscope.queries.fixtures import PACK
from callscope.session import scratch_dir
from callscope.sources.files import check_manifest

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def turns(spark):
    """Conversations of which one holds a third of the turns."""
    base = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    n = base.count()
    hot = base.limit(n // 2).withColumns({"turn": F.monotonically_increasing_id(), "conv_id": F.lit(-1).cast("bigint")})
    return base.unionByName(hot).repartition(6).cache()


def test_hot_call_equals_its_transcript(spark, turns):
    by_turn = C.analyze_turns(turns, "conv_id", "role", "text", PACK)
    whole = C.assemble(turns, "conv_id", "turn", "role", "text", PACK)
    expected = C.analyze_calls(whole, "conv_id", "transcript", PACK, rules=None).drop("transcript")
    key = lambda r: r["conv_id"]
    assert sorted(by_turn.drop("turns").collect(), key=key) == sorted(expected.collect(), key=key)


def test_turns_are_combined_before_the_shuffle(turns):
    text = plan(C.analyze_turns(turns, "conv_id", "role", "text", PACK))
    assert "partial_bit_or" in text and "SortAggregate" not in text and "collect_list" not in text


def test_hot_conversation_loses_no_turn(turns):
    parts = C.assemble(turns, "conv_id", "turn", "role", "text", PACK, part_turns=5)
    lines = parts.select(F.sum(F.length("transcript") - F.length(F.replace("transcript", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    expected = turns.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    assert lines == expected


def test_daily_counts_before_it_picks_a_reason(spark):
    rows = spark.range(3000).select(
        F.lit("d").alias("date"), F.lit("投诉").alias("caller_intent"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 900).cast("string"))).alias("switch_reason"),
        F.lit("low").alias("risk_level"), F.lit("neutral").alias("sentiment"), F.lit(0.5).alias("sentiment_score"),
    )
    daily = A.daily_aggregate(rows)
    assert daily.first()["top_switch_reason"] == "hot" and daily.first()["total_calls"] == 3000
    assert "mode(" not in plan(daily)


def test_repeated_manifest_key_is_found_by_counts(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 100, "hot").otherwise(F.col("id").cast("string")).alias("doc_id"))
    with pytest.raises(ValueError, match="repeat"):
        check_manifest(rows)


def test_hot_cell_is_many_files(spark):
    rows = spark.range(0, 3000, 1, 4).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.rand(1), F.rand(2))).alias("embedding"),
    ).cache()
    index = N.build_cells(rows, scratch_dir(spark, "hot-cells"), cells=4, seed=1)
    found = N.nearest_cells(spark, index, [1.0, 1.0], k=20)
    assert [r["doc_id"] for r in found.orderBy("doc_id").collect()] == [3 * i for i in range(20)]


def test_percentiles_of_a_grown_group(spark):
    """One group grows tenfold: its narrowing still sees counts of one range only."""
    base = spark.range(2000).select(F.lit("a").alias("g"), (F.col("id") * 37 % 1999).cast("double").alias("v"))
    hot = spark.range(20000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 19997 / 3).alias("v"))
    rows = base.union(hot).union(spark.range(1000).select(F.lit(None).cast("string").alias("g"), F.lit(5.0).alias("v")))
    found = {r["g"]: r for r in A.exact_percentiles(rows, "v", A.LATENCY_POINTS, ["g"], bins=16).collect()}
    for g in ("a", "hot"):
        expected = rows.where(F.col("g") == g).select(*[F.percentile("v", p).alias(n) for n, p in A.LATENCY_POINTS.items()]).first()
        assert all(abs(found[g][n] - expected[n]) < 1e-9 for n in A.LATENCY_POINTS)
    assert found[None]["p99"] == 5.0


def test_a_longer_signal_has_more_salts(spark):
    from callscope.operators import signal as G

    rows = spark.range(3 * G.BLOCK * G.SALT_BLOCKS).select(F.lit("s").alias("signal_id"), F.col("id").alias("idx"), F.sin(F.col("id") / 9).alias("value"))
    vector = G.signal_features(rows).first()["features"]
    assert len(vector) == 128 and abs(sum(x * x for x in vector) - 1) < 1e-4


def test_vector_search_is_a_scan_and_a_top_k(spark):
    text = plan(QUERIES["nearest_filtered"](spark, FOLDER))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(QUERIES["scalar_query"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text
    assert "GreaterThan(n_chars,1000)" in text and "EqualTo(lang,fr)" in text
    assert "embedding" not in plan(QUERIES["public_projection"](spark, FOLDER)).replace("embeddings.parquet", "")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
