"""Operator 11: ranked lexical search with the queries indexed and the documents streamed.

The items' terms make the inverted index: term -> items that hold it, with repeats. One pass over
the documents keeps, of each, its length and the counts of terms that some item holds. From these
rows come the corpus statistics, and a second pass streams them through the broadcast index: a
task adds up a document's score for every item it meets and keeps a heap of the best ``k``
documents an item. Heaps are merged in two steps, first among some tasks, then for each item.

A task's memory is the index, ``k`` rows an item and one block of documents; what it sends on is
``k`` rows an item at most. The index is sent whole only up to ``MAX_POSTINGS`` postings: a larger
set of items is cut into shards of that size by hash, each of which meets all documents.

Null texts, and texts without a term, are no documents of the corpus and match nothing. Among equal
scores ids ascend and rows with a null id come last; a row that is repeated is ranked as often as it
stands there. An item row that is repeated is answered as often. Items without a term, or without a
document that scores above 0, give no row; so do empty tables. Other columns are not read. A very
long text is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, codes_of, ids_of, record, release, stored, texts_of, utf8_bytes

K = 20
#: Postings of the broadcast index: 16 bytes each.
MAX_POSTINGS = 2_000_000
#: Scores that a task holds at once: documents of a block times items.
_CELLS = 1 << 21

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[[b for b in range(128) if not chr(b).isalnum()]] = 32

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_BEST = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z as a-z, and each text's number of them."""
    raw, offsets = utf8_bytes(texts)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_LETTER[raw].tobytes()))
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
    sums = np.concatenate([[0], np.cumsum(full)])
    ends = lists.offsets.to_numpy()
    return words.filter(pa.array(full)), np.diff(sums[ends - ends[0]])


class Index:
    """Postings of a shard of items: for term ``t`` the items ``item[at[t]:at[t + 1]]`` with their repeats."""

    def __init__(self, texts: list[str]) -> None:
        words, count = terms_of(pa.array(texts, pa.string()))
        codes, self.terms = codes_of(words)
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), count)
        pairs, repeats = np.unique(codes * max(len(texts), 1) + owner, return_counts=True)
        self.item = (pairs % max(len(texts), 1)).astype(np.int32)
        self.repeats = repeats.astype(np.int64)
        self.at = np.searchsorted(pairs // max(len(texts), 1), np.arange(len(self.terms) + 1))
        self.items = len(texts)


def term_counts(docs: DataFrame, terms: pa.Array, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n, terms, counts`` of documents with a term: all terms counted in ``n``, the given ones listed."""
    words = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for block in blocks(batches, text):
            found, n = terms_of(texts_of(block, text))
            at = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)[at >= 0]
            pairs, times = np.unique(owner * max(len(known), 1) + at[at >= 0], return_counts=True)
            full = np.flatnonzero(n)
            ends = np.searchsorted(pairs // max(len(known), 1), np.concatenate([full, [len(n)]])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % max(len(known), 1), times)]
            yield record([ids_of(block, key).cast(pa.int64()).take(pa.array(full)), n[full], *lists], _COUNTS)

    return docs.select(key, text).mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


class Heaps:
    """The best ``k`` of each item so far; smaller rows than an item's ``k``-th are turned away at once."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        self.waiting: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, doc: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        """``scores[d, i]`` of block document ``d`` for item ``i``."""
        row, item = np.nonzero(scores >= self.least)
        if len(row):
            self.waiting.append([item, doc[row], scores[row, item], null[row]])
            self.n += len(row)
            if self.n > 4 * self.k * len(self.least):
                self.settle()

    def settle(self) -> None:
        item, doc, score, null = (np.concatenate(x) for x in zip(self.rows, *self.waiting))
        order = np.lexsort((doc, null, -score, item))
        item, doc, score, null = item[order], doc[order], score[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        self.rows = [x[place < self.k] for x in (item, doc, score, null)]
        self.waiting, self.n = [], 0


def best(counts: DataFrame, index: Index, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the heaps of every task."""
    shared = counts.sparkSession.sparkContext.broadcast((index, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        heaps = Heaps(index.items, k)
        step = max(1, _CELLS // max(index.items, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                doc, n, terms, times = (part.column(c) for c in range(4))
                size = np.diff(terms.offsets.to_numpy())
                owner = np.repeat(np.arange(part.num_rows), size)
                term, tf = terms.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                m = 75 + (25 * n.to_numpy() * n_docs) // n_terms
                gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))
                scores = np.zeros((part.num_rows, index.items), np.int64)
                order = np.argsort(term, kind="stable")
                ends = np.flatnonzero(np.diff(term[order], append=-1)) + 1
                for low, high in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                    at = order[low:high]
                    a, b = index.at[term[at[0]]], index.at[term[at[0]] + 1]
                    scores[np.ix_(owner[at], index.item[a:b])] += gain[at, None] * index.repeats[a:b]
                heaps.add(pc.fill_null(doc, 0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), scores)
        heaps.settle()
        item, doc, score, null = heaps.rows
        yield record([item.astype(np.int32), pa.array(doc, mask=null), score], _BEST)
        release()

    return counts.mapInArrow(search, "item int, doc_id long, score long")


def merged(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item, numbered from 1; parts of an item's rows are cut to ``k`` before they meet."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def reversed_search(docs: DataFrame, items: DataFrame, k: int = K, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items (item_id, text)`` its ``k`` best of ``docs (doc_id, text)``.

    A term's weight is ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and a document's length counts through
    ``m = 75 + 25 n N div L``; a score is the sum of ``w * (10^9 tf div (1000 tf + 12 m))`` in integers.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("text is not null")
    held = F.size(F.split(F.translate("text", "\t\n\r", "   "), "[^0-9A-Za-z\\u0080-\\x{10FFFF}]+"))
    total = items.agg(F.sum(held)).first()[0] or 0
    shards = 1 + int(total // max_postings)
    results = []
    for shard in range(shards):
        # A shard's items come to the driver: some two million words, however many items there are.
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard).collect() if total else []
        if not mine:
            continue
        index = Index([r["text"] for r in mine])
        counts = stored(term_counts(docs, index.terms), "search-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(index.terms), np.int64)
        for term, n in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the index
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "item int, item_id long")
        results.append(merged(best(counts, index, weights, n_docs, int(n_terms), k), k).join(F.broadcast(ids), "item"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select("item_id", "rank", "doc_id", "score")
