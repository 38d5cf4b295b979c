"""Indexes, sketches and automata: what lets a search or a report skip most of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.automaton import automaton_scores
from ..operators import aggregates as A, quantised as P
from ..session import scratch_dir
from .registry import query, scan, table
from .search import ASKED, DISTANCE, _near

# ---- keywords ----------------------------------------------------------------------------

PHRASE_WORDS = (1, 2, 3, 4)


def phrase_dictionary(spark, d):
    """Every run of one to four words of the benchmark items, by length and first character."""
    words = F.split(F.lower("text"), " ")
    rows = table(spark, d, "benchmark").select(words.alias("w")).withColumn("m", F.explode(F.lit(list(PHRASE_WORDS)))).where("size(w) >= m")
    runs = rows.select("m", F.explode(F.expr("transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
    found: dict[str, list[str]] = {}
    # The dictionary is the operator's argument; the texts are what grows.
    for r in runs.where("phrase <> ''").distinct().orderBy("m", "phrase").collect():
        found.setdefault(f"{r['m']}{r['phrase'][0]}", []).append(r["phrase"])
    return found


@query("keyword_large", """WITH w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark), m AS (SELECT unnest([1, 2, 3, 4]) AS m),
runs AS (SELECT DISTINCT m, phrase FROM (SELECT m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, m WHERE len(w) >= m) WHERE phrase <> ''),
docs AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, m || substr(phrase, 1, 1) AS category, count(*)::INT AS score FROM docs JOIN runs ON contains(t, phrase) GROUP BY 1, 2""")
def keyword_large(spark, d):
    scores = automaton_scores(F.col("text"), phrase_dictionary(spark, d))
    return scan(spark, d, "documents", "doc_id", "text").select("doc_id", F.inline(scores))


# ---- latency -----------------------------------------------------------------------------

ODD_VALUE = """CASE event_id % 40 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN NULL ELSE value END"""


@query("latency_nonfinite", f"""WITH v AS (SELECT event_type, {ODD_VALUE} AS x FROM events),
o AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM v WHERE x IS NOT NULL),
p AS (SELECT event_type, name, (n - 1) * q AS pos FROM (SELECT DISTINCT event_type, n FROM o), (VALUES ('p50', 0.5), ('p75', 0.75), ('p95', 0.95), ('p99', 0.99)) t(name, q)),
b AS (SELECT p.event_type, name, pos - floor(pos) AS part, a.x AS lo, c.x AS hi FROM p JOIN o a ON a.event_type = p.event_type AND a.r = floor(pos) JOIN o c ON c.event_type = p.event_type AND c.r = least(floor(pos) + 1, c.n - 1)),
f AS (SELECT event_type, name, CASE WHEN part = 0 OR lo = hi THEN lo WHEN isfinite(lo) AND isfinite(hi) THEN lo + part * (hi - lo) ELSE (1 - part) * lo + part * hi END AS x FROM b)
SELECT event_type, name, CASE WHEN isnan(x) THEN 'nan' WHEN isinf(x) THEN 'inf' ELSE 'number' END AS kind, round(CASE WHEN isfinite(x) THEN x END, 6) AS value FROM f""")
def latency_nonfinite(spark, d):
    place = F.col("event_id") % 40
    odd = F.when(place == 0, F.lit("Infinity").cast("double")).when(place == 1, F.lit("NaN").cast("double")).when(place == 2, F.lit("-Infinity").cast("double")).when(place == 3, None).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("event_type", odd.alias("value"))
    wide = A.exact_percentiles(rows, "value", A.LATENCY_POINTS, ["event_type"])
    x = F.col("x")
    finite = ~F.isnan(x) & (F.abs(x) < F.lit("Infinity").cast("double"))
    return wide.unpivot("event_type", list(A.LATENCY_POINTS), "name", "x").select(
        "event_type", "name", F.when(F.isnan(x), "nan").when(finite, "number").otherwise("inf").alias("kind"), F.round(F.when(finite, x), 6).alias("value")
    )


SPAN = ("2024-01-05", "2024-01-24")


@query("latency_sketches", f"""SELECT event_type, point, count(value) AS n, true AS within_bound
FROM (SELECT event_type, value FROM events WHERE ts >= DATE '{SPAN[0]}' AND ts < DATE '{SPAN[1]}') e, (SELECT unnest([0.5, 0.75, 0.95, 0.99]) AS point) p GROUP BY 1, 2""")
def latency_sketches(spark, d):
    """Sketches by day and type, stored; a span is merged from them and its ranks held against the values."""
    events = table(spark, d, "events").select("event_type", "value", F.to_date("ts").alias("date"))
    path = scratch_dir(spark, "sketches")
    A.quantile_sketches(events, "value", ["date", "event_type"]).write.partitionBy("date").parquet(path)
    during = F.col("date").between(SPAN[0], F.date_sub(F.lit(SPAN[1]), 1))
    points = {f"p{i}": p for i, p in enumerate(A.LATENCY_POINTS.values())}
    merged = A.sketch_quantiles(spark.read.parquet(path).where(during), points, ["event_type"]).drop("n")
    values = events.where(during & F.col("value").isNotNull()).join(F.broadcast(merged), "event_type")  # a row for each type
    below = [F.struct(F.lit(p).alias("point"), F.count_if(F.col("value") < F.col(n)).alias("under"), F.count_if(F.col("value") <= F.col(n)).alias("upto")) for n, p in points.items()]
    ranks = values.groupBy("event_type").agg(F.count("value").alias("n"), F.array(*below).alias("r")).select("event_type", "n", F.inline("r"))
    # The bound holds in 99 of 100 cases; three times as far is out of reach of chance.
    room = 3 * A.sketch_error(800) * F.col("n") + 1
    rank = F.col("point") * F.col("n")
    return ranks.select("event_type", "point", "n", ((F.col("under") - room <= rank) & (rank <= F.col("upto") + room)).alias("within_bound"))


# ---- vectors -----------------------------------------------------------------------------


@query("nearest_codes", f"""WITH q AS (SELECT {ASKED}::DOUBLE[] AS v) SELECT vec_id, label, round({DISTANCE}, 6) AS distance FROM embeddings e, q
ORDER BY {DISTANCE}, vec_id LIMIT 10""")
def nearest_codes(spark, d):
    index = P.build_codes(table(spark, d, "embeddings"), scratch_dir(spark, "codes"), "vec_id", cells=8, parts=8, entries=32)
    return _near(P.nearest_codes(spark, index, ASKED, k=10, probes=3))
