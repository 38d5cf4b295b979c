"""Registered queries of the operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir
from .archives import pages_through_archives
from .collocations import collocations
from .common import documents, labels
from .embedding_forest import near_embeddings
from .jaccard_join import jaccard_components
from .licenses import scan_licenses
from .mixing import mix_sources
from .packing import pack
from .pii import find_pii
from .quality_classifier import quality_report
from .quality_rules import fit_quality, quality_rules
from .reversed_search import reversed_search
from .secrets import scan_secrets, secret_report
from .toxicity import toxicity_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality_rules(docs, fit_quality(docs, labels(spark, folder)))


@query
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder))


ORACLES["op1_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id
"""


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(documents(spark, folder))


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(documents(spark, folder), scratch_dir(spark, "op10-ledger"))
    return secret_report(found)


@query
def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder))


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(documents(spark, folder, "doc_id", "text", "lang", "source")).drop("_text")


def _shared_out(parent: str, child: str) -> str:
    """Siblings below one parent: what each is given of ``total``."""
    over = f"OVER ({f'PARTITION BY {parent} ' if parent else ''}ORDER BY room, {child}"
    whole = f"OVER ({f'PARTITION BY {parent}' if parent else ''})"
    return f"""SELECT *, CASE WHEN room <= level THEN room ELSE greatest(0, max(CASE WHEN room > level THEN level END) {whole}) END AS given FROM (
      SELECT *, (total - coalesce(sum(room) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / count(*) {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM nodes)"""


ORACLES["op7_mixing"] = f"""
WITH docs AS (
  SELECT doc_id, 'domain' || (('0x' || substr(md5(source), 1, 4))::INT % 4) AS domain, lang, source, md5(coalesce(text, '')) AS m,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 2 AS room FROM docs GROUP BY ALL),
l1 AS (WITH nodes AS (SELECT domain, sum(room) AS room, (SELECT 0.8::DOUBLE * sum(tokens)::DOUBLE FROM leaves) AS total FROM leaves GROUP BY domain) {_shared_out('', 'domain')}),
l2 AS (WITH nodes AS (SELECT a.domain, a.lang, sum(a.room) AS room, any_value(b.given) AS total FROM leaves a JOIN l1 b USING (domain) GROUP BY a.domain, a.lang) {_shared_out('domain', 'lang')}),
l3 AS (WITH nodes AS (SELECT a.domain, a.lang, a.source, a.tokens, a.room, b.given AS total FROM leaves a JOIN l2 b USING (domain, lang)) {_shared_out('domain, lang', 'source')}),
budgets AS (SELECT domain, lang, source, tokens, floor(given + 1e-6)::BIGINT AS budget FROM l3),
parts AS (SELECT *, least(CASE WHEN tokens > 0 THEN budget // tokens ELSE 2 END, 2) AS whole FROM budgets),
placed AS (
  SELECT d.*, p.budget, p.whole, p.budget - p.whole * p.tokens AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('1:' || p.whole || ':' || doc_id || ':' || m), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN parts p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget,
  (CASE WHEN n_tokens = 0 THEN 2 ELSE whole + (whole < 2 AND before + n_tokens <= rest)::INT END)::BIGINT AS copies,
  (CASE WHEN whole < 2 AND before + n_tokens > rest AND before < rest THEN rest - before ELSE 0 END)::BIGINT AS part_tokens
FROM placed
"""


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_report(documents(spark, folder), labels(spark, folder))


@query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(documents(spark, folder), labels(spark, folder))


@query
def op4_embedding_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))


@query
def op11_reversed_search(spark: SparkSession, folder: str) -> DataFrame:
    return reversed_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op11_reversed_search"] = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS d, {_TERMS} AS t FROM documents),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs WHERE len(t) > 0),
tf AS (SELECT d, any_value(doc_id) AS doc_id, t, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT d, doc_id, len(t) AS n, unnest(t) AS t FROM docs) GROUP BY d, t),
asked AS (SELECT i, any_value(item_id) AS item_id, t, count(*)::BIGINT AS q FROM (SELECT item_id, row_number() OVER () AS i, unnest({_TERMS}) AS t FROM benchmark) GROUP BY i, t),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY t, n_docs),
scored AS (
  SELECT a.i, any_value(a.item_id) AS item_id, tf.d, any_value(tf.doc_id) AS doc_id,
    sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN tf USING (t) JOIN weight USING (t), corpus GROUP BY a.i, tf.d),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(documents(spark, folder, "lang", "text"))


ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, count(*)::BIGINT AS f
      FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM pieces, (SELECT unnest([1, 2, 3]) AS m)) GROUP BY ALL),
asked AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
cuts AS (SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM asked) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM asked WHERE m = 3) GROUP BY ALL),
ranked AS (SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, score::BIGINT AS score
  FROM low LEFT JOIN inner_ i ON i.lang = low.lang AND i.phrase = low.phrase AND low.m = 2 WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op12_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    return pages_through_archives(spark.read.parquet(f"{folder}/pages.parquet"))


ORACLES["op12_arc_to_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(s, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""
