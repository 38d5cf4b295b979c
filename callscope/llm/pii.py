"""Operator 9: personal data, base patterns and information-theoretic sanitisation.

Addresses, network numbers, cards and phones are found by patterns. The corpus then says which
other terms give them away: a term t that stands in texts with entity e discloses it when
PMI(e; t) >= strength * IC(e), that is P(e | t) >= P(e) ** (1 - strength), with counts over all
different texts, at least ``support`` of which hold both, and a confidence bound over all pairs.
Personal values hardly ever repeat, so an entity is also a kind, the local part or domain of an
address, or the start of a number. Such terms are removed wherever they occur.

Everything is built-in functions: no Python runs on the executors. Null text counts as empty.
Ids are not read, so rows with a null id are handled as any other. Repeated rows are handled row by
row; equal texts count once as evidence. Other columns are kept by ``sanitised`` and not read. Empty tables give
empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from .common import sized, stored
from .spans import chained, counted, joined, matches, none, replaced

# The base patterns. Possessive repeats and look-behinds find the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IP_FINE = rf"^0*{_BYTE}(?:\.0*{_BYTE})" + r"{3}$"
KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{N}]{3,}+"
#: Chance that any term at all is taken for disclosing though it is none.
CHANCE = 0.05


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    def card(value: Column) -> Column:
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))

    def when(mark: str, spans: Column) -> Column:
        return F.when(text.contains(mark), spans).otherwise(none())

    return chained([
        when("@", matches(text, "email", 0, EMAIL)),
        when(".", matches(text, "ip", 1, IP, lambda v: v.rlike(IP_FINE))),
        matches(text, "card", 2, CARD, card),
        when("+", matches(text, "phone", 3, PHONE, lambda v: F.length(_digits(v)).between(8, 15))),
    ])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _entities(span: Column) -> Column:
    """What a span may stand for: its kind, its exact value, and groups that repeat where values do not."""
    kind, value = span["kind"], span["value"]
    address = F.when(kind == "email", F.concat(F.lit("email:"), F.lower(F.substring_index(value, "@", 1)), F.lit("@")))
    network = address.when(kind == "ip", F.concat(F.lit("ip:"), F.substring_index(value, ".", 2), F.lit(".")))
    group = network.otherwise(F.concat(kind, F.lit(":"), F.substring(_digits(value), F.lit(1), F.when(kind == "card", 6).otherwise(4)), F.lit("*")))
    domain = F.when(kind == "email", F.concat(F.lit("email:@"), F.lower(F.substring_index(value, "@", -1))))
    return F.array_compact(F.array(kind, F.concat(kind, F.lit(":"), value), group, domain))


def disclosing_terms(found: DataFrame, support: int, strength: float) -> DataFrame:
    """``term`` of all terms that disclose an entity. ``found`` has ``_id, _text, _spans``.

    All counts are of different texts, as a whole, without the entities themselves. With p = P(e),
    n_t texts of a term and n_both of them with e, chance alone gives that many with a probability
    of at most exp(-n_t KL(n_both / n_t, p)); over all pairs that could be, this must be ``CHANCE``.
    """
    texts = found.select(F.xxhash64("_text").alias("d"), "_text", "_spans")
    copies = texts.groupBy("d").agg(F.count("*").alias("c"))
    total = copies.count()
    copies = sized(stored(copies.where("c > 1"), "op9-copies"))
    bare = F.when(F.size("_spans") > 0, replaced(F.col("_text"), F.col("_spans"), lambda kind: F.lit(" "))).otherwise(F.col("_text"))

    hits = texts.where(F.size("_spans") > 0).select("d", F.array_distinct(F.flatten(F.transform("_spans", _entities))).alias("e"), _terms(bare).alias("t"))
    hits = stored(hits.dropDuplicates(["d"]), "op9-hits")
    entities = hits.select(F.explode("e").alias("e")).groupBy("e").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    entities = stored(entities, "op9-entities")
    beside = stored(hits.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("n_near")), "op9-beside")
    tested = max(entities.count() * beside.count(), 1)
    # Values of their own text only leave before terms are paired with them.
    near = hits.select("d", F.explode("e").alias("e")).join(sized(entities), "e").select("d", "e").join(hits.select("d", "t"), "d").select("e", F.explode("t").alias("t"))
    both = near.groupBy("e", "t").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    # Common words stand near many entities: already the texts where a term is near any are too
    # many for one of them, and it need not be counted over the corpus.
    p = F.col("n_e") / F.lit(float(max(total, 1)))
    least = F.pow(p, F.lit(1 - strength))
    pairs = stored(both.join(entities, "e").join(beside, "t").where(F.col("n_both") / F.col("n_near") >= least).drop("n_near"), "op9-pairs")

    asked = sized(stored(pairs.select("t").distinct(), "op9-asked"))
    said = texts.join(copies, "d", "left").select((1 / F.coalesce("c", F.lit(1))).alias("w"), F.explode(_terms(bare)).alias("t"))
    count = said.join(asked, "t").groupBy("t").agg(F.round(F.sum("w")).alias("n_t"))
    q = F.col("n_both") / F.col("n_t")
    apart = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    sure = (q > p) & (F.col("n_t") * apart >= math.log(tested / CHANCE))
    return stored(pairs.join(count, "t").where((q >= least) & sure).select(F.col("t").alias("term")).distinct(), "op9-terms")


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 5, strength: float = 0.9) -> DataFrame:
    """``_row`` (the row of ``docs``), ``_text, _spans, _more``: base spans and those of disclosing terms (kind ``term``)."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    found = whole.withColumn("_spans", base_spans(F.col("_text")))
    terms = disclosing_terms(found.select("_id", "_text", "_spans"), support, strength)
    # Terms are given back to texts, not to ids, which may be null or repeat; equal texts share a row.
    found = found.withColumn("_d", F.xxhash64("_text"))
    holders = found.select("_d", F.explode(_terms(F.col("_text"))).alias("term")).join(sized(terms), "term").groupBy("_d").agg(F.concat_ws("|", F.array_sort(F.collect_set("term"))).alias("_terms"))
    held = found.join(sized(stored(holders, "op9-holders")), "_d", "left").drop("_d")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.col("_terms"), F.lit(r")(?![\p{L}\p{N}])"))
    more = F.when(F.col("_terms").isNotNull(), matches(F.col("_text"), "term", 4, pattern)).otherwise(none())
    return held.withColumn("_more", more)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 5, strength: float = 0.9) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    rows = all_spans(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, support, strength)
    rows = rows.select(F.col("_id").alias(id_col), F.col("_spans"), chained([F.col("_spans"), F.col("_more")]).alias("_all"))
    return rows.select(
        F.col(id_col), *[counted(F.col("_spans"), k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("_spans"), True), 256).alias("base_sha256"),
        joined(F.col("_all"), True).alias("spans"), counted(F.col("_all"), "term").alias("n_term"),
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 5, strength: float = 0.9) -> DataFrame:
    """``docs`` with each span of the text replaced by the name of its kind in brackets; null stays null."""
    rows = all_spans(docs, id_col, text_col, support, strength)
    clean = F.when(F.col(f"_row.`{text_col}`").isNotNull(), replaced(F.col("_text"), chained([F.col("_spans"), F.col("_more")]), lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))))
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
