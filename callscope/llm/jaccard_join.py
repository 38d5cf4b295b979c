"""Operator 1: n-gram Jaccard join by a token-group matrix.

Documents are sets of five-word shingles. Two link when 100 |A and B| >= 80 |A or B|.

1. Equal sets are one class; everything after works on one set for each class.
2. Only sets that can have a partner go on. The k first common shingles of a linked pair lie
   among the first n - need + k of either set in any global order, so a set with fewer than k
   shared shingles there has no partner. The order is by hash and needs no counting; hot
   shingles are combined inside each task before they move.
3. Sets are partitioned into groups of similar ones: members of a min-hash bucket that really
   link with the bucket's leader, joined across buckets.
4. The matrix of shingles and groups holds the union of each group's shingles. A set looks up
   its rarest shingles there (prefix filter on true frequencies); its overlap with the union of
   a found group bounds its overlap with every member. Groups below the bound stay closed. How
   far into either set a shingle lies bounds what they can share if it is the first (positional
   filter), for the sizes of the two.
   Groups are only looked up from smaller ones: a link inside a group adds nothing.
5. Members of opened groups that share a rare shingle are compared exactly. The found links
   join groups into components.

No link between groups is lost: a linked pair shares a prefix shingle, and the bound never
exceeds what the pair needs.

Null and empty texts and texts without words have no shingles and stay alone. Rows with a null
id take part; a component's name is its smallest id that is not null. Repeated rows are kept
and share a component. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, ids_of, mix, record, sized, stored, texts_of
from .graph import components
from .shingles import shingle_sets, signature

#: Bytes of text whose shingles a task combines before it sends them on.
COMBINE_BYTES = 16 << 20
#: Sets of a min-hash bucket beyond which its leader is sent to them.
HOT = 1000
SEEDS = tuple(0x9E3779B97F4A7C15 * k % 2**64 for k in range(1, 9))


def needed(n, percent: int):
    """Least overlap of a set of ``n`` with any partner: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def extra(n):
    """How many common shingles the first filter asks for: a tenth, one at least."""
    return np.maximum(1, -(-n // 10))


def _set_rows(docs: DataFrame) -> DataFrame:
    """``_id, _mark, n, sig`` of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n", pa.int64()), ("sig", pa.int64())])
        for batch in blocks(batches, "_text", 1 << 20):
            sets = shingle_sets(texts_of(batch, "_text"))
            made = record([[len(s) for s in sets], [signature(s) for s in sets]], schema)
            yield pa.RecordBatch.from_arrays([ids_of(batch, "_id"), ids_of(batch, "_mark"), *made.columns], names=["_id", "_mark", "n", "sig"])

    return docs.mapInArrow(rows, f"_id {docs.schema['_id'].dataType.simpleString()}, _mark long, n long, sig long")


def _prefix_rows(docs: DataFrame, percent: int) -> DataFrame:
    """``key, kind, sig, hits``: what a task knows of the first shingles of its sets.

    Kind 0: a shingle of one set here. Kind 1: a shingle of several sets here, all of them
    credited already. Kind 2: the credits of a set (its key is the set's).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("sig", pa.int64()), ("hits", pa.int64())])

        def flush(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
            sigs = np.fromiter(sets, np.int64, len(sets))
            sizes = [len(s) for s in sets.values()]
            token = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            times = np.diff(np.concatenate([first, [len(token)]]))
            one = first[times == 1]
            many = first[times > 1]
            credit = np.bincount(owner, np.repeat(times > 1, times).astype(float), len(sets)).astype(np.int64)
            full = np.flatnonzero(credit)
            return record(
                [np.concatenate([token[one], token[many], sigs[full]]),
                 np.repeat(np.array([0, 1, 2], np.int8), [len(one), len(many), len(full)]),
                 np.concatenate([sigs[owner[one]], np.zeros(len(many), np.int64), sigs[full]]),
                 np.concatenate([np.zeros(len(one) + len(many), np.int64), credit[full]])],
                schema,
            )

        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in blocks(batches, "_text", 1 << 20):
            texts = texts_of(batch, "_text")
            for s in shingle_sets(texts):
                if len(s):
                    n = len(s)
                    held[signature(s)] = s[: n - needed(n, percent) + int(extra(n))]
            size += texts.nbytes
            if size >= COMBINE_BYTES and held:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    return docs.mapInArrow(rows, "key long, kind byte, sig long, hits long")


def _credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sig, hits`` from rows of ``_prefix_rows`` sorted by key.

    The rows of a key, one for each combining step at most, may reach into the next batch.
    """
    schema = pa.schema([("sig", pa.int64()), ("hits", pa.int64())])
    names = ("key", "kind", "sig", "hits")

    def credit(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, kind, sig, hits = rows
        own = kind == 2
        told, said = sig[own], hits[own]
        key, kind, sig = key[~own], kind[~own], sig[~own]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = np.minimum.reduceat(np.where(kind == 1, np.iinfo(np.int64).max, sig), first), np.maximum.reduceat(np.where(kind == 1, np.iinfo(np.int64).min, sig), first)
            shared = (low < high) | (np.maximum.reduceat(kind, first) == 1)
            fine = np.repeat(shared, np.diff(np.concatenate([first, [len(key)]]))) & (kind == 0)
            told, said = np.concatenate([told, sig[fine]]), np.concatenate([said, np.ones(int(fine.sum()), np.int64)])
        sigs, at = np.unique(told, return_inverse=True)
        return record([sigs, np.bincount(at, said, len(sigs)).astype(np.int64)], schema)

    rest: list[np.ndarray] | None = None
    for batch in batches:
        rows = [ids_of(batch, c).to_numpy(zero_copy_only=False) for c in names]
        rows = rows if rest is None else [np.concatenate([r, x]) for r, x in zip(rest, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left")) if len(rows[0]) else 0
        rest = [r[cut:] for r in rows]
        if cut:
            yield credit([r[:cut] for r in rows])
    if rest is not None and len(rest[0]):
        yield credit(rest)


def _candidates(docs: DataFrame, percent: int) -> DataFrame:
    """``sig, hits``: sets that share shingles with others, and how many of their first ones."""
    rows = _prefix_rows(docs, percent).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_credits, "sig long, hits long").groupBy("sig").agg(F.sum("hits").alias("hits"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig, n, tokens, keys`` of the wanted classes (``rep, rep_mark, sig, n``), recomputed from one text each.

    An id that many texts share tells them apart by their marks: each text meets its own class only.
    """
    marked = docs.withColumn("_mark", F.xxhash64("_text"))
    found = marked.join(sized(wanted), marked["_id"].eqNullSafe(wanted["rep"]) & (marked["_mark"] == wanted["rep_mark"])).select("_text", "sig", "n")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
        for batch in blocks(batches, "_text", 1 << 20):
            out = []
            for sig, n, s in zip(*(ids_of(batch, c).to_pylist() for c in ("sig", "n")), shingle_sets(texts_of(batch, "_text"))):
                if len(s) == n and signature(s) == sig:
                    out.append((sig, n, s, [int(mix(s.view(np.uint64) ^ np.uint64(x)).min().view(np.int64)) for x in SEEDS]))
            yield record([list(c) for c in zip(*out)] if out else [[]] * 4, schema)

    return found.mapInArrow(rows, "sig long, n long, tokens array<long>, keys array<long>").dropDuplicates(["sig"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` those whose sets link."""
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _part(n: Column, percent: int, whole: int) -> Column:
    """ceil(n percent / whole)"""
    return -F.floor(-n * percent / whole)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between sets that make the components of all links."""
    tokens = sets.select("sig", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(shared, "token").groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"), (F.sum("df") / F.first("n")).alias("central"))
    # Unshared shingles come first in the order, so they use up the start of the prefix; a set
    # with too few shared ones has no partner and leaves here.
    ranked = ranked.withColumn("keep", F.size("all") - _part(F.col("n"), percent, 100) + 1).where("keep > 0")
    ranked = stored(ranked.select("sig", "n", "central", F.size("all").alias("shared"), F.expr("slice(all, 1, cast(keep as int)).token").alias("prefix")), "op1-ranked")
    sets = sets.join(ranked.select("sig", "central"), "sig")

    # The set whose shingles are the commonest leads its buckets: what the others were made from.
    keyed = sets.select("sig", "n", "central", F.posexplode("keys").alias("r", "key"))
    leaders = keyed.groupBy("r", "key").agg(F.max(F.struct("central", "sig", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    leaders = stored(leaders, "op1-leaders")
    # The members of a hot bucket stay where they are, and its leader is sent to them: there is one
    # such bucket for ``HOT`` members at most.
    hot = sized(stored(leaders.where(F.col("m") > HOT), "op1-hot"))
    some = keyed.join(hot.select("r", "key"), ["r", "key"], "left_anti").join(leaders, ["r", "key"])
    met = some.unionByName(keyed.join(hot, ["r", "key"]))
    stars = met.where(F.col("sig") != F.col("lead.sig")).where(_sizes_fit(F.col("n"), F.col("lead.n"), percent))
    inner = stored(_linked(stars.select(F.col("sig").alias("a"), F.col("lead.sig").alias("b")).distinct(), sets, percent), "op1-stars")

    grouped = components(inner, "op1-groups")
    group = ranked.select("sig", "n").join(grouped.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "n", F.coalesce("component", "sig").alias("g"))
    sizes = group.groupBy("g").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    group = stored(group.join(sizes, "g"), "op1-members")

    # ``slack`` is the most that two sets can share if this is their first common shingle.
    prefix = ranked.select("sig", "n", "shared", F.posexplode("prefix").alias("at", "token")).withColumn("slack", F.col("shared") - F.col("at")).drop("at", "shared")
    prefix = stored(prefix.join(group.drop("n"), "sig"), "op1-prefix")

    # The matrix: which groups hold a shingle, and how early. Only shingles of several groups, in
    # the prefix of one that may be the smaller of a pair, can join two.
    early = F.when(F.col("slack") >= _part(2 * F.col("n"), percent, 100 + percent), 1)
    matrix = prefix.groupBy("token", "g").agg(
        F.first("members").alias("members"), F.first("high").alias("high"), F.min("n").alias("low"), F.max("slack").alias("slack_g"), F.count(early).alias("early"),
    )
    across = matrix.groupBy("token").agg(F.count("*").alias("groups"), F.sum("early").alias("early")).where("groups > 1 and early > 0").select("token")
    asks = prefix.join(across, "token", "left_semi").select("token", "sig", "n", "slack", F.col("g").alias("own"), F.col("members").alias("own_members"))
    least = _part(F.col("n") + F.greatest(F.col("low"), _part(F.col("n"), percent, 100)), percent, 100 + percent)
    met = F.expr("own_members < members or (own_members = members and own < g)") & (F.least("slack", "slack_g") >= least) & (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    found = asks.join(matrix.join(across, "token", "left_semi"), "token").where(met)
    asked = stored(found.groupBy("sig", "g").agg(F.min("low").alias("low")), "op1-asked")

    # Bound: overlap with the union of the group, against what the smallest fitting partner needs.
    union = sets.select("sig", "tokens").join(group.select("sig", "g"), "sig").join(asked.select("g").distinct(), "g", "left_semi").select("g", F.explode("tokens").alias("token")).distinct()
    ours = asked.join(sets.select("sig", "n", "tokens"), "sig").select("sig", "n", "g", "low", F.explode("tokens").alias("token"))
    overlap = ours.join(union, ["g", "token"]).groupBy("sig", "g").agg(F.count("*").alias("most"), F.first("n").alias("n"), F.first("low").alias("low"))
    opened = overlap.where(F.col("most") >= _part(F.col("n") + F.greatest(F.col("low"), _part(F.col("n"), percent, 100)), percent, 100 + percent)).select("sig", "g")

    mine = prefix.select("sig", "token", "n", "slack").join(opened, "sig")
    theirs = prefix.select("token", "g", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("slack").alias("slack_b"))
    early = F.least("slack", "slack_b") >= _part(F.col("n") + F.col("nb"), percent, 100 + percent)
    shared = mine.join(theirs, ["token", "g"]).where(early & _sizes_fit(F.col("n"), F.col("nb"), percent)).groupBy(F.col("sig").alias("a"), "g", "b").agg(F.count("*").alias("m"))
    pairs = stored(shared, "op1-pairs")
    # One link with a group settles it, so the most promising member goes first, and the others
    # are compared only where that one fails.
    best = pairs.groupBy("a", "g").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
    linked = stored(_linked(best.select("a", "b"), sets, percent), "op1-first")
    settled = linked.join(best, ["a", "b"]).select("a", "g")
    others = pairs.join(settled, ["a", "g"], "left_anti").join(best, ["a", "g", "b"], "left_anti").select("a", "b")
    return inner.union(linked).union(_linked(others, sets, percent))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, mark: str | None = None, group: str | None = None) -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``.

    For callers whose ids repeat or are null: ``mark`` names a further column, the xxhash64 of the row's
    text, and ``group`` one that is the same number in all rows of a component, null without words.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = stored(_set_rows(docs.withColumn("_mark", F.xxhash64("_text"))), "op1-rows")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_mark"))  # ids before null ones
    classes = rows.where("n > 0").groupBy("sig", "n").agg(first.alias("f")).select("sig", "n", F.col("f._id").alias("rep"), F.col("f._mark").alias("rep_mark"))
    least = F.greatest(F.lit(1), F.expr(f"-floor(-(-floor(-n * {percent} / 100)) / 10)"))
    wanted = stored(classes.join(_candidates(docs, percent), "sig").where(F.col("hits") >= least).select("rep", "rep_mark", "sig", "n"), "op1-wanted")
    sets = stored(_sets(docs, wanted), "op1-sets")

    joined = components(stored(_links(sets, percent), "op1-links"), "op1-components")
    named = joined.join(wanted.select(F.col("sig").alias("node"), "rep"), "node")
    least_id = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least_id, "component").select(F.col("node").alias("sig"), "component", "least")
    final = classes.join(named, "sig", "left").select("sig", "n", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "sig").alias("_group"))
    alone = rows.where("n = 0").select("_id", "_mark", "n", F.col("_id").alias("component_id"), F.lit(None).cast("long").alias("_group"))
    named = rows.where("n > 0").join(final, ["sig", "n"]).select("_id", "_mark", "n", "component_id", "_group").union(alone)
    more = [F.col(c).alias(name) for c, name in (("_mark", mark), ("_group", group)) if name]
    return named.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *more)
