"""Operator 7: mixing sources to target weights by hierarchical budgeting.

Documents hang as leaves domain / language / source. The token budget goes down the tree by the
weights of siblings. What a node cannot use, because its documents times ``epochs`` are fewer
tokens, its siblings take over first, by their weights; only what none of them can take reaches
the siblings of the ancestors. Each leaf then reads its documents in a seeded order, epoch after
epoch, and stops where its budget ends.

Null names of a level count as one name, the empty one. Documents without words cost nothing and
stay. Null and repeated ids are handled row by row; rows that are alike tie in every order. An
empty table gives an empty result. Nothing but leaf rows is gathered anywhere; a hot leaf is
summed in buckets of the seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .ranks import bucket_count, running

LEVELS = ("domain", "lang", "source")


def _weight(levels: Sequence[str], weights: Mapping[str, float]) -> Column:
    """Weight of a node among its siblings: given for its path ``a/b``, else 1."""
    path = F.concat_ws("/", *[F.col(x) for x in levels])
    out = F.lit(1.0)
    for name, value in weights.items():
        out = F.when(path == name, F.lit(float(value))).otherwise(out)
    return out


def _share_out(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``given`` for siblings: ``total`` by ``weight``, never over ``room``, all of it if it fits.

    Siblings are filled in the order of room per weight. The level of filling at a sibling is what
    the ones before left, over the weights from it on; the first sibling whose room per weight
    lies above sets the level of all after it.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("room") / F.col("weight"), *LEVELS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    staged = nodes.withColumn("level", level).withColumn("short", F.col("room") <= F.col("level") * F.col("weight"))
    common = F.max(F.when(~F.col("short"), F.col("level"))).over(w)
    return staged.withColumn("given", F.when(F.col("short"), F.col("room")).otherwise(F.greatest(F.lit(0.0), common * F.col("weight"))))


def leaf_budgets(leaves: DataFrame, total: float, weights: Mapping[str, float], epochs: int) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``budget``."""
    down: DataFrame | None = None
    room = leaves.withColumn("room", F.col("tokens") * F.lit(float(epochs)))
    for k in range(1, len(LEVELS) + 1):
        here, parent = LEVELS[:k], LEVELS[: k - 1]
        nodes = room.groupBy(*here).agg(F.sum("room").alias("room")).withColumn("weight", _weight(here, weights))
        for missing in LEVELS[k:]:
            nodes = nodes.withColumn(missing, F.lit(""))
        nodes = nodes.withColumn("total", F.lit(float(total))) if down is None else nodes.join(down, list(parent))
        down = _share_out(nodes, parent).select(*here, F.col("given").alias("total"))
    return leaves.join(down, list(LEVELS)).withColumn("budget", F.floor(F.col("total") + 1e-6).cast("bigint")).drop("total")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("bigint")


def domain_of(source: Column, domains: int = 4) -> Column:
    """The tables have no domains; sources are dealt over some by name."""
    return F.concat(F.lit("domain"), F.pmod(_hex(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 4), F.lit(domains)).cast("string"))


def mix_sources(
    docs: DataFrame, share: float = 0.8, epochs: int = 2, weights: Mapping[str, float] | None = None, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None,
) -> DataFrame:
    """``id, domain, lang, source, n_tokens, budget, copies, part_tokens`` of every row; the budget is ``share`` of all tokens.

    ``copies`` is how often a row is read whole: once for each whole epoch of its leaf, and once
    more if it lies in the prefix of the last. The row at the end of the prefix is read up to
    ``part_tokens`` more, so that a leaf's tokens are its budget exactly.
    """
    level = {"domain": domain_of(F.col(source_col)) if domain is None else domain, "lang": F.col(lang_col), "source": F.col(source_col)}
    rows = docs.select(F.col(id_col).alias("_id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in level.items()], word_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.col(text_col).cast("string")).alias("_text"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("_md5"))
    rows = stored(rows, "op7-rows")
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "op7-leaves")
    total = share * (leaves.agg(F.sum("tokens")).first()[0] or 0.0)
    budgets = leaf_budgets(leaves, total, weights or {}, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(epochs)).cast("bigint")
    budgets = stored(budgets.withColumn("whole", F.least(whole, F.lit(epochs).cast("bigint"))).withColumn("rest", (F.col("budget") - F.col("whole") * F.col("tokens")).cast("bigint")), "op7-budgets")

    # The order of the epoch that is cut short: its number is part of the seed.
    ordered = rows.join(budgets.select(*LEVELS, "budget", "whole", "rest"), list(LEVELS)).withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), "whole", "_id", "_md5").cast("binary"))).drop("_md5")
    ordered = stored(ordered, "op7-ordered")
    buckets = bucket_count(ordered)
    bucket = F.floor(_hex(F.col("_key"), 8) * F.lit(buckets) / F.lit(2**32)).cast("bigint")
    placed = running(ordered, list(LEVELS), bucket, ["_key", "_id", "n_tokens"], "n_tokens", "_before", "op7-sums")
    open_ = F.col("whole") < epochs
    extra = open_ & (F.col("_before") + F.col("n_tokens") <= F.col("rest"))
    part = F.when(open_ & ~extra & (F.col("_before") < F.col("rest")), F.col("rest") - F.col("_before")).otherwise(0).cast("bigint")
    copies = F.when(F.col("n_tokens") == 0, F.lit(epochs).cast("bigint")).otherwise(F.col("whole") + extra.cast("bigint"))
    return placed.select(F.col("_id").alias(id_col), *LEVELS, "n_tokens", "budget", copies.alias("copies"), part.alias("part_tokens"), "_text")


def keep_mixed(docs: DataFrame, share: float = 0.8, weights: Mapping[str, float] | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that one epoch at most reads whole, with all their columns.

    Rows are found again by id and text, nulls included; rows that are alike in both may be told
    apart only by their number, so all of them stay where one does.
    """
    chosen = mix_sources(docs, share, 1, weights, seed, id_col, text_col).where("copies > 0").select(F.col(id_col).alias("_cid"), F.col("_text").alias("_ctext")).distinct()
    mark = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["_cid"]) & (mark == chosen["_ctext"]), "left_semi")
