"""Registered queries: objects, manifests, exports, archive and catalog, each written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..operators import browse as B, calls as C
from ..plans import sqlgate as Q
from ..session import scratch_dir
from ..sources import archive as Z, files as S, tables as K
from . import fixtures as fx
from .registry import query, scan, table
from .texts import DOCS


def _exported(spark, rows, blob):
    """Write a blob for each row to a file of its own, and list them."""
    folder = scratch_dir(spark, "exported")
    return folder, S.export_blobs(rows, rows.select("doc_id"), folder, "doc_id", blob)


@query("exported_objects", """SELECT CASE page_id % 5 WHEN 0 THEN '_' || page_id WHEN 1 THEN '../' || page_id WHEN 2 THEN page_id || repeat('é/', 500) ELSE page_id || '/' || url END AS id,
octet_length(encode(html)) AS size FROM pages""")
def exported_objects(spark, d):
    """Ids hold slashes, a leading underscore, ``..`` or a thousand characters; the files are listed, and named by the list."""
    kind, number = F.col("page_id") % 5, F.col("page_id").cast("string")
    name = F.when(kind == 0, F.concat(F.lit("_"), number)).when(kind == 1, F.concat(F.lit("../"), number)).when(kind == 2, F.concat(number, F.repeat(F.lit("é/"), 500))).otherwise(F.concat_ws("/", "page_id", "url"))
    rows = table(spark, d, "pages").select(name.alias("doc_id"), F.col("html").cast("binary").alias("blob"))
    folder, listed = _exported(spark, rows, "blob")
    objects = S.list_objects(spark, folder).select(S.file_name(F.col("path")).alias("name"), "size")
    return objects.join(listed.select(F.col("doc_id").alias("id"), "name"), "name").select("id", "size")


@query("built_manifest", "SELECT conv_id || '-' || turn || '.wav' AS doc_id FROM conversations WHERE role = 'user'")
def built_manifest(spark, d):
    ending = F.when(F.col("role") == "user", ".wav").otherwise(".txt")
    rows = scan(spark, d, "conversations", "conv_id", "turn", "role", "text").select(
        F.concat(F.col("conv_id"), F.lit("-"), F.col("turn"), ending).alias("doc_id"), F.col("text").cast("binary").alias("blob")
    )
    folder, listed = _exported(spark, rows, "blob")
    files = S.build_manifest(spark, folder).select(F.col("doc_id").alias("name"))
    return files.join(listed.select("doc_id", "name"), "name").select("doc_id")


@query("blob_point", "SELECT octet_length(encode(html)) AS size, md5(html) AS md5 FROM pages WHERE page_id = (SELECT max(page_id) FROM pages)")
def blob_point(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("blob"))
    last = pages.agg(F.max("page_id")).first()[0]
    content, _ = S.blob_lookup(pages, "page_id", last, "blob")
    return spark.createDataFrame([(content,)], "b binary").select(F.length("b").cast("bigint").alias("size"), F.md5("b").alias("md5"))


@query("row_count", "SELECT count(*) AS rows FROM documents")
def row_count(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("rows"))


@query("added_column", "SELECT doc_id, n_chars * 2 AS double_chars FROM documents")
def added_column(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return K.add_column(docs, "double_chars", F.col("n_chars") * 2).drop("n_chars")


@query("typed_column", "SELECT lang, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def typed_column(spark, d):
    docs = K.assert_type(table(spark, d, "documents"), "n_chars", T.LongType())
    return docs.groupBy("lang").agg(F.sum("n_chars").alias("chars"))


@query("archive_stats", "SELECT 'raw_audio' AS prefix, true AS stored, count(*) AS documents FROM conversations")
def archive_stats(spark, d):
    folder = scratch_dir(spark, "archive")
    calls = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("text").alias("transcript"))
    Z.archive(Z.raw_documents(calls), folder, "raw_audio")
    found = Z.object_stats(spark, folder).select("prefix", ((F.col("objects") > 0) & (F.col("bytes") > 0)).alias("stored"))
    prefix = F.regexp_extract(F.col("_metadata.file_path"), "/([a-z_]+)/[^/]*$", 1).alias("prefix")
    rows = Z.read_archive(spark, folder, "raw_audio").groupBy(prefix).agg(F.count("*").alias("documents"))
    return found.join(rows, "prefix")


@query("archive_analysis", f"WITH {DOCS} SELECT doc_id::VARCHAR AS call_id, caller_intent AS intent, risk_level AS risk, sentiment FROM analysed")
def archive_analysis(spark, d):
    folder = scratch_dir(spark, "archive")
    docs = scan(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("transcript"))
    Z.archive(Z.analysis_documents(C.analyze_calls(docs, pack=fx.PACK, rules=None)), folder, "voice_analysis")
    return Z.read_archive(spark, folder, "voice_analysis", "call_id string, intent string, risk string, sentiment string")


@query("catalog_listing", "SELECT 'documents_listed' AS name, 3 AS columns, count(*) AS row_count FROM documents")
def catalog_listing(spark, d):
    path = scratch_dir(spark, "listed")
    K.create_table(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path)
    K.register(spark, "default", path, "documents_listed")
    tree = K.catalog_tree(spark).where("table = 'documents_listed'")
    return tree.select(F.col("table").alias("name"), "columns", "row_count")


@query("view_schemas", """WITH d AS (SELECT 'listed_documents' AS name, column_name AS "column", lower(data_type) AS type FROM (DESCRIBE documents) t(column_name, data_type, a, b, c, e)),
n AS (SELECT count(doc_id) AS doc_id, count(text) AS text, count(lang) AS lang, count(source) AS source, count(n_chars) AS n_chars FROM documents),
f AS (UNPIVOT n ON COLUMNS(*) INTO NAME "column" VALUE filled) SELECT name, d."column", type, filled FROM d JOIN f ON f."column" = d."column\"""")
def view_schemas(spark, d):
    """The schema of every view that is listed, with the values that each column holds."""
    Q.register_views(spark, {"listed_documents": table(spark, d, "documents"), "_hidden": table(spark, d, "labels")})
    found = {name: columns for name, columns in Q.schemas(spark).items() if name in ("listed_documents", "_hidden")}
    parts = []
    for name, columns in found.items():
        kinds = F.create_map(*[F.lit(x) for c in columns for x in (c["column"], c["type"].replace("string", "varchar"))])
        filled = spark.table(name).agg(*[F.count(c["column"]).alias(c["column"]) for c in columns])
        parts.append(filled.unpivot([], [c["column"] for c in columns], "column", "filled").select(F.lit(name).alias("name"), "column", kinds[F.col("column")].alias("type"), "filled"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# ---- layout ------------------------------------------------------------------------------


@query("clustered_lookup", """SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42
UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000 AND lang = 'fr'""")
def clustered_lookup(spark, d):
    """A point and a range from a table laid out along a curve over two columns, with a bloom filter on the key."""
    path = scratch_dir(spark, "clustered")
    table(spark, d, "documents").select("doc_id", "lang", "n_chars").write.parquet(path)
    laid = spark.read.parquet(K.compact_clustered(spark, path, ("n_chars", "lang"), "doc_id", files=8))
    point = B.lookup(laid, "doc_id", 42)
    return point.union(B.scalar_query(laid, "n_chars > 1000 AND lang = 'fr'", None).rows)


@query("bucketed_merge", """SELECT d.doc_id, d.lang, l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def bucketed_merge(spark, d):
    """Two merges into a bucketed table; neither shuffles what is there already."""
    names = [f"default.bucketed_{uuid.uuid4().hex}" for _ in range(2)]
    K.save_bucketed(table(spark, d, "documents").select("doc_id", "lang"), names[0], "doc_id", 8, scratch_dir(spark, "bucketed"))
    K.merge_bucketed(spark, names[0], table(spark, d, "labels"), "doc_id", names[1], path=scratch_dir(spark, "bucketed"))
    return K.merged_bucketed(spark, names[1], table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")[0]


@query("attached_stream", """SELECT d.doc_id, 'text/html' AS mime_type, CASE WHEN p.page_id IS NULL THEN 'download_failed' ELSE 'pending' END AS analysis_status,
CASE WHEN p.page_id IS NULL THEN 'skipped' ELSE 'pending' END AS embedding_status, octet_length(encode(p.html)) AS bytes
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def attached_stream(spark, d):
    """Files that arrive in three batches, and a manifest that names some of them only after they came."""
    folder, sink, state = (scratch_dir(spark, x) for x in ("arriving", "arrived", "arrivals"))
    manifest = table(spark, d, "documents").select("doc_id", S.export_name(F.concat(F.lit("item/"), F.col("doc_id").cast("string"), F.lit(".html"))).alias("file"))
    files = table(spark, d, "pages").select(F.concat(F.lit("item/"), F.col("page_id").cast("string"), F.lit(".html")).alias("doc_id"), F.col("html").cast("binary").alias("blob"), "page_id")
    for part in range(3):
        some = files.where(F.col("page_id") % 3 == part)
        S.export_blobs(some, some.select("doc_id"), f"{folder}/part{part}", "doc_id", "blob")
        named = manifest.where(F.col("doc_id") % 2 == 0) if part == 0 else manifest
        S.attach_stream(spark, named, folder, "file", sink, state).awaitTermination()
    out = S.read_attached(spark, manifest, folder, "file", sink)
    return out.select("doc_id", "mime_type", "analysis_status", "embedding_status", F.octet_length("image_blob").cast("bigint").alias("bytes"))
