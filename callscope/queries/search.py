"""Browsing, similarity and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S, text as X, vectors as V
from ..operators import browse as B, similarity as N
from ..session import scratch_dir
from ..sources.files import attach_blobs, check_manifest, read_manifest
from ..sources import tables as K
from .registry import query, scan, table
from .texts import RULE_SQL, ruled

# ---- browse ------------------------------------------------------------------------------


@query("scalar_query", """SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000 AND lang = 'fr' ORDER BY doc_id LIMIT 10""")
def scalar_query(spark, d):
    docs = table(spark, d, "documents")
    found = B.scalar_query(docs, "n_chars > 1000 AND lang = 'fr'", 10, ("doc_id", "lang", "n_chars"), order_by=("doc_id",), most_k=B.MAX_TOP_K)
    return found.rows


@query("scalar_query_counts", """SELECT count(*) AS matched, least(count(*), 10) AS returned FROM documents WHERE n_chars > 1000 AND lang = 'fr'""")
def scalar_query_counts(spark, d):
    found = B.scalar_query(table(spark, d, "documents"), "n_chars > 1000 AND lang = 'fr'", 10)
    # Both counts stay in the plan: no row reaches the driver.
    all_rows = found.matching.select(F.lit(0).alias("kept"))
    return all_rows.unionAll(found.rows.select(F.lit(1).alias("kept"))).agg(
        F.count_if(F.col("kept") == 0).alias("matched"), F.count_if(F.col("kept") == 1).alias("returned")
    )


@query("scalar_query_lenient", "SELECT doc_id, lang FROM documents")
def scalar_query_lenient(spark, d):
    return B.scalar_query(table(spark, d, "documents"), "no_such_column = 1", 10, ("doc_id", "lang"), lenient=True).rows


@query("predicate_presets", f"""WITH {RULE_SQL} SELECT doc_id, bad_tone, downgrade_related FROM ruled WHERE bad_tone = true OR downgrade_related = true""")
def predicate_presets(spark, d):
    return B.scalar_query(ruled(spark, d), B.PREDICATES["at_risk"], None, ("doc_id", "bad_tone", "downgrade_related")).rows


@query("predicate_bad_tone", f"""WITH {RULE_SQL} SELECT doc_id, bad_tone, downgrade_related FROM ruled WHERE bad_tone = true""")
def predicate_bad_tone(spark, d):
    return B.scalar_query(ruled(spark, d), B.PREDICATES["bad_tone"], None, ("doc_id", "bad_tone", "downgrade_related")).rows


@query("predicate_images", """WITH i AS (SELECT vec_id AS doc_id, CASE WHEN label = 9 THEN NULL ELSE label % 2 = 0 END AS is_avatar,
CASE WHEN label < 6 THEN 'ok' WHEN label < 8 THEN 'llm_failed' END AS analysis_status FROM embeddings)
SELECT doc_id, 'avatars' AS preset FROM i WHERE is_avatar = true UNION ALL SELECT doc_id, 'not_ok' FROM i WHERE analysis_status != 'ok'""")
def predicate_images(spark, d):
    """The two presets on images; a status or verdict that is null meets neither."""
    label = F.col("label")
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.when(label != 9, label % 2 == 0).alias("is_avatar"), F.when(label < 6, "ok").when(label < 8, "llm_failed").alias("analysis_status")
    )
    some = lambda name: B.scalar_query(rows, B.PREDICATES[name], None, ("doc_id",)).rows.withColumn("preset", F.lit(name))
    return some("avatars").union(some("not_ok"))


@query("result_columns", f"""WITH {RULE_SQL} SELECT doc_id, text_emotion, bad_tone, emotion_score, downgrade_related, primary_reason, secondary_reason
FROM ruled ORDER BY doc_id LIMIT 20""")
def result_columns(spark, d):
    return B.scalar_query(ruled(spark, d), None, 20, B.RESULT_COLUMNS, order_by=("doc_id",)).rows


@query("public_projection", "SELECT vec_id, label, '/api/image/assets/' || vec_id AS preview_url FROM embeddings")
def public_projection(spark, d):
    return B.public_view(table(spark, d, "embeddings"), "vec_id", drop=("embedding",))


@query("membership_export", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def membership_export(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1")
    return B.members(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ids, "doc_id")


@query("unified_browse", """SELECT 'audio' AS _dataset, doc_id, lang, n_chars, NULL::BIGINT AS page_id, NULL AS url FROM documents
UNION ALL SELECT 'image', NULL, NULL, NULL, page_id, url FROM pages""")
def unified_browse(spark, d):
    audio = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    image = table(spark, d, "pages").select("page_id", "url")
    return B.unified_browse({"audio": audio, "image": image, "video": None}, None)


@query("unified_browse_page", """SELECT * FROM (SELECT 'audio' AS _dataset, doc_id AS id FROM documents ORDER BY doc_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'image', page_id FROM pages ORDER BY page_id LIMIT 50)""")
def unified_browse_page(spark, d):
    frames = {
        "audio": table(spark, d, "documents").select(F.col("doc_id").alias("id")),
        "image": table(spark, d, "pages").select(F.col("page_id").alias("id")),
    }
    return B.unified_browse(frames, 50, {"audio": "id", "image": "id"})


@query("point_lookup", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, d):
    return B.lookup(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 42)


@query("top_k_score", "SELECT event_id, value FROM events WHERE value >= 100 ORDER BY value DESC, event_id LIMIT 20")
def top_k_score(spark, d):
    return B.top_k(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 20, floor=100)


# ---- manifests and merges ----------------------------------------------------------------


def _manifest_and_files(spark, d):
    manifest = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("item/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("file"), "text"
    )
    files = table(spark, d, "pages").select(
        F.concat(F.lit("item/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").cast("binary").alias("content"),
    )
    return manifest, files


@query("manifest_left", """SELECT d.doc_id, 'text/html' AS mime_type, CASE WHEN p.page_id IS NULL THEN 'download_failed' ELSE 'pending' END AS analysis_status,
CASE WHEN p.page_id IS NULL THEN 'skipped' ELSE 'pending' END AS embedding_status, octet_length(encode(p.html)) AS bytes
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def manifest_left(spark, d):
    manifest, files = _manifest_and_files(spark, d)
    out = attach_blobs(manifest, files, "file")
    return out.select(
        "doc_id", "mime_type", "analysis_status", "embedding_status", F.octet_length("image_blob").cast("bigint").alias("bytes")
    )


@query("manifest_inner", """SELECT d.doc_id, octet_length(encode(p.html)) AS bytes FROM documents d JOIN pages p ON p.page_id = d.doc_id""")
def manifest_inner(spark, d):
    manifest, files = _manifest_and_files(spark, d)
    out = attach_blobs(manifest, files, "file", missing="drop", blob="audio_blob")
    return out.select("doc_id", F.octet_length("audio_blob").cast("bigint").alias("bytes"))


@query("manifest_text_fallback", """SELECT d.doc_id, p.page_id IS NOT NULL OR b.item_id IS NOT NULL AS from_audio,
md5(coalesce(p.html, b.text, d.text)) AS blob FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id AND p.url LIKE 'https%'
LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def manifest_text_fallback(spark, d):
    manifest, _ = _manifest_and_files(spark, d)
    name = lambda c: F.concat(F.lit("item/"), F.col(c).cast("string"), F.lit(".html")).alias("path")
    cache = table(spark, d, "pages").where(F.col("url").startswith("https")).select(name("page_id"), F.col("html").cast("binary").alias("content"))
    store = table(spark, d, "benchmark").select(name("item_id"), F.col("text").cast("binary").alias("content"))
    out = attach_blobs(manifest, cache, "file", missing="text", blob="audio_blob", text="text", backup=store)
    return out.select("doc_id", "from_audio", F.md5("audio_blob").alias("blob"))


@query("manifest_formats", """SELECT f.format, p.page_id::VARCHAR AS doc_id, p.url AS s3_url FROM pages p, (SELECT unnest(['csv', 'jsonl', 'parquet']) AS format) f""")
def manifest_formats(spark, d):
    folder = scratch_dir(spark, "manifests")
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("s3_url"))
    rows.write.parquet(f"{folder}/m.parquet")
    rows.write.json(f"{folder}/m.jsonl")
    rows.write.option("header", True).csv(f"{folder}/m.csv")
    read = [read_manifest(spark, f"{folder}/m.{kind}").select(F.lit(kind).alias("format"), "*") for kind in ("csv", "jsonl", "parquet")]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("manifest_checked", "SELECT doc_id, lang FROM documents")
def manifest_checked(spark, d):
    return check_manifest(table(spark, d, "documents").select("doc_id", "lang"))


@query("mime_guess", """SELECT doc_id, CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'fr' THEN 'audio/mpeg' WHEN 'de' THEN 'x/given' ELSE 'application/octet-stream' END AS mime_type FROM documents""")
def mime_guess(spark, d):
    lang = F.col("lang")
    path = F.concat(F.lit("a.b/"), F.col("source"), F.when(lang == "en", ".JPG").when(lang == "fr", ".mp3").otherwise(""))
    return table(spark, d, "documents").select(
        "doc_id", S.guess_mime(path, F.when(lang == "de", "x/given").otherwise("")).alias("mime_type")
    )


@query("browse_entities", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS keys, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS k FROM events""")
def browse_entities(spark, d):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    rows = K.browse(table(spark, d, "events").select("event_id", text.alias("key_entities")), None)
    return rows.select("event_id", F.size("key_entities").alias("keys"), F.try_element_at("key_entities", F.lit("k")).alias("k"))


@query("registered_table", "SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def registered_table(spark, d):
    path = scratch_dir(spark, "registered")
    K.create_table(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path)
    name = K.register(spark, "default", path, "documents_copy")
    return spark.table(name).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("column_merge", """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def column_merge(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang")
    new = table(spark, d, "labels").withColumn("lang", F.lit("skipped: the base has it"))
    merged, _ = K.merge_columns(base, new)
    return merged


# ---- similarity --------------------------------------------------------------------------

CLEAN = """regexp_replace(text, '[\\s，。！？、：；（）《》"\\-【】0-9]+', '', 'g')"""
BIGRAMS = """CASE WHEN length(c) >= 2 THEN list_transform(range(1, length(c)), lambda i: substr(c, i, 2)) WHEN length(c) = 1 THEN [c] ELSE [] END"""


@query("bigrams", f"""WITH t AS (SELECT conv_id, turn, {CLEAN} AS c FROM conversations), g AS (SELECT conv_id, turn, {BIGRAMS} AS b FROM t)
SELECT conv_id, turn, len(b) AS n, len(list_distinct(b)) AS distinct_n, md5(array_to_string(b, '|')) AS bigrams FROM g""")
def bigram_rows(spark, d):
    df = scan(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", X.bigrams(F.col("text")).alias("b"))
    return df.select(
        "conv_id", "turn", F.size("b").cast("bigint").alias("n"), F.size(F.array_distinct("b")).cast("bigint").alias("distinct_n"),
        F.md5(F.array_join("b", "|")).alias("bigrams"),
    )


SEARCH_FOR = "the quement station thinks about schlich"


@query("bigram_jaccard", f"""WITH t AS (SELECT doc_id, {CLEAN} AS c FROM documents), g AS (SELECT doc_id, list_distinct({BIGRAMS}) AS b FROM t),
asked AS (SELECT {CLEAN.replace('text', "'" + SEARCH_FOR + "'", 1)} AS c), q AS (SELECT list_distinct({BIGRAMS}) AS q FROM asked)
SELECT doc_id, round(len(list_intersect(b, q)) / (len(b) + len(q) - len(list_intersect(b, q))), 6) AS jaccard FROM g, q""")
def bigram_jaccard(spark, d):
    scored = N.bigram_scores(scan(spark, d, "documents", "doc_id", "text"), SEARCH_FOR, F.col("text"))
    return scored.select("doc_id", F.round("_jaccard", 6).alias("jaccard"))


@query("bigram_search")
def bigram_search(spark, d):
    found = N.bigram_search(scan(spark, d, "documents", "doc_id", "text"), SEARCH_FOR, 10, 0.05, "doc_id", F.col("text"))
    return found.select("doc_id", F.round("_similarity", 6).alias("similarity"))


@query("hashed_bag")
def hashed_bag(spark, d):
    bag = V.hashed_bag(X.bigrams(F.col("text")), 16)
    return scan(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.transform(bag, lambda x: x.cast("float")).alias("embedding"))


def _letter_hash(token):
    """A hash that SQL can state as well, to check the arithmetic around the hashing."""
    return F.ascii(F.substring(token, 1, 1)) * 31 + F.ascii(F.substring(token, 2, 1))


_letter_hash.pairs = lambda first, second: first * 31 + second


BUCKET = "(unicode(substr(x, 1, 1)) * 31 + unicode(substr(x, 2, 1))) % 256"
SCORED = f"""WITH t AS (SELECT doc_id, {CLEAN} AS c FROM documents), g AS (SELECT doc_id, {BIGRAMS} AS b FROM t),
asked AS (SELECT {CLEAN.replace('text', "'" + SEARCH_FOR + "'", 1)} AS c), qb AS (SELECT {BIGRAMS} AS b FROM asked),
q AS (SELECT list_distinct(b) AS q FROM qb),
tokens AS (SELECT doc_id, unnest(b) AS x FROM g), counts AS (SELECT doc_id, {BUCKET} AS bucket, count(*) AS n FROM tokens GROUP BY 1, 2),
qcounts AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM (SELECT unnest(b) AS x FROM qb) GROUP BY 1),
norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY 1), qnorm AS (SELECT sqrt(sum(n * n)) AS norm FROM qcounts),
dots AS (SELECT c.doc_id, sum(c.n * k.n) AS dot FROM counts c JOIN qcounts k ON c.bucket = k.bucket GROUP BY 1),
jac AS (SELECT doc_id, len(list_intersect(list_distinct(b), q)) / (len(list_distinct(b)) + len(q) - len(list_intersect(list_distinct(b), q))) AS j FROM g, q),
scored AS (SELECT jac.doc_id, CASE WHEN j > 0 THEN 0.85 * j + 0.15 * dots.dot / (norms.norm * qnorm.norm) ELSE 0 END AS s
FROM jac LEFT JOIN dots ON jac.doc_id = dots.doc_id LEFT JOIN norms ON jac.doc_id = norms.doc_id, qnorm)"""


@query("bigram_similarity", f"{SCORED} SELECT doc_id, round(s::DOUBLE, 6) AS similarity FROM scored")
def bigram_similarity(spark, d):
    docs = scan(spark, d, "documents", "doc_id", "text")
    scored = N.bigram_scores(docs, SEARCH_FOR, F.col("text"), hasher=_letter_hash)
    return scored.select("doc_id", F.round("_similarity", 6).alias("similarity"))


@query("bigram_search_top", f"{SCORED} SELECT doc_id, round(s::DOUBLE, 6) AS similarity FROM scored WHERE s >= 0.05 ORDER BY s DESC, doc_id LIMIT 10")
def bigram_search_top(spark, d):
    docs = scan(spark, d, "documents", "doc_id", "text")
    found = N.bigram_search(docs, SEARCH_FOR, 10, 0.05, "doc_id", F.col("text"), hasher=_letter_hash)
    return found.select("doc_id", F.round("_similarity", 6).alias("similarity"))


@query("bigram_postings", f"{SCORED} SELECT doc_id, round(s::DOUBLE, 6) AS similarity FROM scored WHERE s >= 0.05 ORDER BY s DESC, doc_id LIMIT 10")
def bigram_postings(spark, d):
    """The same search over a stored index."""
    path = scratch_dir(spark, "postings")
    N.build_postings(scan(spark, d, "documents", "doc_id", "text"), path, "doc_id", F.col("text"), hasher=_letter_hash)
    found = N.search_postings(spark, path, SEARCH_FOR, 10, 0.05, "doc_id", hasher=_letter_hash)
    return found.select("doc_id", F.round("_similarity", 6).alias("similarity"))


@query("hashed_bag_counts", f"""WITH t AS (SELECT conv_id, turn, {CLEAN} AS c FROM conversations), g AS (SELECT conv_id, turn, {BIGRAMS} AS b FROM t),
tokens AS (SELECT conv_id, turn, unnest(b) AS x FROM g), counts AS (SELECT conv_id, turn, {BUCKET.replace('256', '16')} AS position, count(*) AS n FROM tokens GROUP BY 1, 2, 3)
SELECT conv_id, turn, position::BIGINT AS position, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM counts""")
def hashed_bag_counts(spark, d):
    turns = scan(spark, d, "conversations", "conv_id", "turn", "text")
    bag = V.hashed_bag(X.bigrams(F.col("text")), 16, _letter_hash)
    exploded = turns.select("conv_id", "turn", F.posexplode(bag).alias("position", "value")).where("value > 0")
    return exploded.select("conv_id", "turn", F.col("position").cast("bigint").alias("position"), F.round("value", 6).alias("value"))


@query("l2_normalize", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT vec_id, unnest(range(1, 65)) AS position, round(unnest(v) / norm, 6) AS value FROM n""")
def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(scaled)).alias("p", "x"))
    return rows.select("vec_id", (F.col("p") + 1).cast("bigint").alias("position"), F.round("x", 6).alias("value"))


@query("hash_embedding", """WITH h AS (SELECT doc_id, list_transform(range(128), lambda i: CASE WHEN i < 32 THEN ('0x' || substr(sha256(text), 2 * i + 1, 2))::INT / 255.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM h)
SELECT doc_id, unnest(range(1, 129)) AS position, round(unnest(v) / norm, 5) AS value FROM n""")
def hash_embedding(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(V.hash_embedding(F.col("text"))).alias("p", "x"))
    return df.select("doc_id", (F.col("p") + 1).cast("bigint").alias("position"), F.round("x", 5).alias("value"))


DISTANCE = "list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
LIKE_7 = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)"


def _near(df):
    return df.select("vec_id", "label", F.round("_distance", 6).alias("distance"))


@query("nearest_by_row", f"""{LIKE_7} SELECT vec_id, label, round({DISTANCE}, 6) AS distance FROM embeddings e, q WHERE vec_id <> 7 ORDER BY {DISTANCE}, vec_id LIMIT 10""")
def nearest_by_row(spark, d):
    return _near(N.nearest(table(spark, d, "embeddings"), 10, "vec_id", like=7))


@query("nearest_with_self", f"""{LIKE_7} SELECT vec_id, label FROM embeddings e, q ORDER BY {DISTANCE}, vec_id LIMIT 10""")
def nearest_with_self(spark, d):
    return N.nearest(table(spark, d, "embeddings"), 10, "vec_id", like=7, include_self=True, columns=("vec_id", "label"))


ASKED = [round(((i * 37) % 19 - 9) / 60.0, 6) for i in range(64)]


@query("nearest_filtered", f"""WITH q AS (SELECT {ASKED}::DOUBLE[] AS v) SELECT vec_id, label, round({DISTANCE}, 6) AS distance FROM embeddings e, q
WHERE label NOT IN (8, 9) AND label > 2 ORDER BY {DISTANCE}, vec_id LIMIT 10""")
def nearest_filtered(spark, d):
    ok = F.when(F.col("label") >= 8, "failed").otherwise("ok")
    rows = table(spark, d, "embeddings").withColumn("embedding_status", ok)
    return _near(N.nearest(rows, 10, "vec_id", query=ASKED, where="(embedding_status = 'ok') AND (label > 2)"))


@query("nearest_postfiltered", f"""{LIKE_7} SELECT * FROM (SELECT vec_id, label, round({DISTANCE}, 6) AS distance FROM embeddings e, q WHERE vec_id <> 7
ORDER BY {DISTANCE}, vec_id LIMIT 20) WHERE label > 4""")
def nearest_postfiltered(spark, d):
    return _near(N.nearest(table(spark, d, "embeddings"), 20, "vec_id", like=7, where="label > 4", postfilter=True))


@query("nearest_cells", f"""WITH q AS (SELECT {ASKED}::DOUBLE[] AS v) SELECT vec_id, label, round({DISTANCE}, 6) AS distance FROM embeddings e, q
ORDER BY {DISTANCE}, vec_id LIMIT 10""")
def nearest_cells(spark, d):
    index = N.build_cells(table(spark, d, "embeddings"), scratch_dir(spark, "cells"), "vec_id", cells=16)
    return _near(N.nearest_cells(spark, index, ASKED, k=10, probes=3))
