"""Operator 4: near-duplicate embeddings by a forest of random-projection trees.

Vectors of one direction (to twelve decimals) are one class. Each tree splits the vectors by
their projection on a random direction, near the middle; those between two quantiles around the
cut spill over to both sides. Leaves that hold more than ``leaf`` vectors are split again by
trees fitted on a sample of the leaf, until none does, so the depth grows with the data. Within
leaves all pairs are compared in double precision, which verifies them; found pairs of all trees
are put together.

Leaves cut a group that is larger than they are, and lose its links. A vector with many partners
in some leaf is therefore crowded: it belongs to a cell around a pivot that it is linked with, and
is compared with every vector that is near enough to the pivot to be its partner, in blocks. Its
links are counted, all of them, and none is written but those to pivots, which make components.

The splits are fitted on samples of at most about ``SAMPLE`` vectors a leaf; every vector is
routed. Splits are by quantiles of distinct projections, so a dense cluster shrinks at each.

Null vectors, zero vectors, those with null or non-finite components or of another length than
most, and rows with a null id link with nothing and are their own component (null for a null id).
Repeated rows of an id and vector count once as a link's end. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

TREES, LEAF, SAMPLE, SPILL = 8, 1024, 8192, 0.05
#: A vector with a ``CROWD``-th of a leaf as partners in one is crowded. Pivots sent to tasks at once, and vectors a task compares with a cell.
CROWD, CELLS, PIECE = 8, 4096, 4096


def build(sample: np.ndarray, size: int, spill: float, seed: int) -> dict[str, np.ndarray]:
    """A tree over the sample, split until at most ``size`` of it are in a leaf. Leaves have no children."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int, float, float]] = []
    directions: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append((-1, -1, 0.0, 0.0))
        directions.append(np.zeros(sample.shape[1]))
        if len(rows) <= size:
            return me
        direction = rng.normal(size=sample.shape[1])
        at = sample[rows] @ direction
        middle = rng.uniform(0.4, 0.6)
        low, high = np.quantile(at, [middle - spill, middle + spill])
        left, right = rows[at <= high], rows[at >= low]
        if max(len(left), len(right)) == len(rows):
            return me
        directions[me] = direction
        nodes[me] = (grow(left), grow(right), float(low), float(high))
        return me

    grow(np.arange(len(sample)))
    table = np.array(nodes)
    return {"left": table[:, 0].astype(int), "right": table[:, 1].astype(int), "low": table[:, 2], "high": table[:, 3], "direction": np.array(directions)}


def route(tree: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and the leaves they reach; a row that spills over comes several times."""
    rows, at = np.arange(len(x)), np.zeros(len(x), int)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        leaf = tree["left"][at] < 0
        done.append((rows[leaf], at[leaf]))
        rows, at = rows[~leaf], at[~leaf]
        value = np.einsum("ij,ij->i", x[rows], tree["direction"][at])
        left, right = value <= tree["high"][at], value >= tree["low"][at]
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([tree["left"][at[left]], tree["right"][at[right]]])
    return tuple(np.concatenate(c) for c in zip(*done)) if done else (rows, at)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, direction`` of usable vectors; ``direction`` is null for the others."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("_id"), v.alias("v"))
    fine = F.col("_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Scaled by the largest component first, so that no square over- or underflows.
    top = rows.withColumn("v", F.when(fine, F.col("v"))).withColumn("m", F.array_max(F.transform("v", F.abs)))
    scaled = top.withColumn("v", F.when(F.col("m") > 0, F.transform("v", lambda x: x / F.col("m"))))
    norm = scaled.withColumn("m", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return norm.select("_id", F.transform("v", lambda x: F.round(x / F.col("m"), 12) + 0.0).alias("direction"))


def _split(members: DataFrame, spill: float, leaf: int, sample: int, seed: int, trees: int) -> DataFrame:
    """Members ``tree, node, id, v`` routed down new trees, one for each leaf that they are in.

    With ``trees`` the members are all classes, still in no tree, and each goes down that many.
    """
    spark = members.sparkSession
    part = members if trees else members.join(members.groupBy("tree", "node").agg(F.count("*").alias("n")), ["tree", "node"])
    total = members.count() if trees else 0
    share = F.lit(sample / max(total, 1)) if trees else F.lit(float(sample)) / F.col("n")

    def enough(rows: int, all_rows: int) -> int:
        """Sampled vectors a leaf may keep so that about half of ``leaf`` of all vectors reach it."""
        return max(min(leaf // 2, 16), int(leaf / 2 * rows / max(all_rows, rows, 1)))

    chance = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share
    kind = dict(members.dtypes)["id"]

    if trees:
        picked = part.where(chance).orderBy(F.xxhash64("id")).limit(2 * sample)
        x = np.array([r["v"] for r in picked.select("v").collect()])  # at most 2 SAMPLE vectors
        made = [build(x, enough(len(x), total), spill, seed + t) for t in range(trees)] if len(x) else []

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
                for t, tree in enumerate(made):
                    rows, at = route(tree, v)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t)), pa.array(at.astype(np.int64)), batch.column(0).take(take), batch.column(1).take(take)], names=["tree", "node", "id", "v"])

        return members.select("id", "v").mapInArrow(down, f"tree long, node long, id {kind}, v array<double>")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("id")["v"].to_numpy())
        tree = build(x, enough(len(x), int(rows["n"].iloc[0])), spill, abs(hash((seed, *map(int, key)))))
        return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "made": [pickle.dumps(tree)]})

    fitted = stored(part.where(chance).select("tree", "node", "id", "v", "n").groupBy("tree", "node").applyInPandas(fit, "tree long, node long, made binary"), "op4-trees")

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for made, group in rows.groupby("made", sort=False):
                at_row, at = route(pickle.loads(made), np.stack(group["v"].to_numpy()))
                out = group.iloc[at_row][["tree", "node", "id", "v"]].copy()
                # Below the old node; nodes of different trees never meet.
                out["node"] = [hash((int(n), seed, int(a))) for n, a in zip(out["node"], at)]
                yield out

    return spark.createDataFrame([], members.schema).union(members.join(fitted, ["tree", "node"]).mapInPandas(again, f"tree long, node long, id {kind}, v array<double>"))


def _crowded(x: np.ndarray, close: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """Cells of a leaf's crowded vectors: a pivot and those linked with it, until each is in one."""
    degree = close.sum(1)
    left = degree >= least
    out = []
    while left.any():
        pivot = int(np.argmax(np.where(left, degree, -1)))
        mine = left & close[pivot]
        mine[pivot] = True
        out.append((pivot, np.flatnonzero(mine)))
        left &= ~mine
    return out


def found_links(classes: DataFrame, least: float, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, spill: float = SPILL, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Links of classes (``id, v, weight``) whose cosine is at least ``least``.

    ``a, others``: parts of the weight that a class is linked with, to be added up; and ``a, b``:
    links that make the components of all links.
    """
    kind = dict(classes.dtypes)["id"]
    now = stored(_split(classes.select("id", "v"), spill, leaf, sample, seed, trees), "op4-leaves")
    ready: DataFrame | None = None
    for level in range(1, 60):
        sizes = stored(now.groupBy("tree", "node").agg(F.count("*").alias("n")), "op4-sizes")
        over = sizes.where(F.col("n") > leaf).select("tree", "node")
        fits = now.join(sizes.where(F.col("n") <= leaf).select("tree", "node"), ["tree", "node"])
        ready = fits if ready is None else ready.union(fits)
        if over.isEmpty():
            break
        now = stored(_split(now.join(over, ["tree", "node"]), spill, leaf, sample, seed + 1000 * level, 0), "op4-leaves")
    else:
        raise RuntimeError("leaves do not shrink")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").sort_values("id")
        x = np.stack(rows["v"].to_numpy())
        x = x / np.sqrt((x * x).sum(1))[:, None]
        close = x @ x.T >= least
        np.fill_diagonal(close, False)
        ids = rows["id"].to_numpy()
        cells = _crowded(x, close, max(leaf // CROWD, 2))
        for _, mine in cells:
            close[mine], close[:, mine] = False, False
        a, b = np.nonzero(np.triu(close, 1))
        out = [pd.DataFrame({"a": ids[a], "b": ids[b], "cell": -1, "centre": None})]
        out += [pd.DataFrame({"a": ids[mine], "b": ids[pivot], "cell": k, "centre": [x[pivot] if i == pivot else None for i in mine]}) for k, (pivot, mine) in enumerate(cells)]
        made = pd.concat(out, ignore_index=True)
        made["tree"], made["node"] = key
        return made[["tree", "node", "cell", "a", "b", "centre"]]

    found = stored(ready.groupBy("tree", "node").applyInPandas(compare, f"tree long, node long, cell long, a {kind}, b {kind}, centre array<double>"), "op4-found")
    crowded = found.where("cell >= 0").withColumn("key", F.xxhash64("tree", "node", "cell"))
    owned = crowded.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("tree", "node", "cell", "key", "b")).alias("x"))
    owned = stored(owned.select("id", F.col("x.key").alias("own"), F.col("x.b").alias("pivot")), "op4-owned")

    pairs = found.where("cell < 0").select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(owned.select(F.col("id").alias(end)), end, "left_anti").select("a", "b")
    pairs = stored(pairs, "op4-pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("id").alias("b"), "weight"), "b").select("a", F.col("weight").alias("others"))
    if owned.isEmpty():
        return others, pairs
    cells = stored(crowded.where("centre is not null").select(F.col("key").alias("cell"), "centre").join(owned.select(F.col("own").alias("cell")).distinct(), "cell"), "op4-cells")
    exact = _exact_links(classes.join(owned, "id", "left"), cells, least)
    edges = pairs.union(owned.select("id", "pivot")).union(exact.where("pivot is not null").select("a", "pivot"))
    return others.union(exact.select("a", "others")), edges


def _exact_links(members: DataFrame, cells: DataFrame, least: float) -> DataFrame:
    """``a, others, pivot``: all links of the vectors that a cell owns, with each other and the rest.

    ``members`` are all vectors (``id, v, weight, own, pivot``), ``own`` is null outside cells. What
    a cell owns is linked with its pivot, so partners are at most two link angles from the pivot.
    """
    kind = dict(members.dtypes)["id"]
    reach = (2 * least * least - 1 if least > 0 else -1.0) - 1e-9
    parts = -(-cells.count() // CELLS)
    near: DataFrame | None = None
    for part in range(parts):
        chosen = cells.where(F.pmod(F.xxhash64("cell"), F.lit(parts)) == part).collect()  # about CELLS pivots at most
        if not chosen:
            continue
        keys, centres = np.array([r["cell"] for r in chosen], np.int64), np.array([r["centre"] for r in chosen], float)

        def meet(batches: Iterator[pa.RecordBatch], keys: np.ndarray = keys, centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
                for low in range(0, len(keys), 256):
                    row, cell = np.nonzero(v @ centres[low : low + 256].T >= reach)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[low + cell]), batch.column(0).take(pa.array(row))], names=["cell", "id"])

        met = stored(members.select("id", "v").mapInArrow(meet, f"cell long, id {kind}"), "op4-near")
        near = met if near is None else near.union(met)
    pieces = stored(near.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).alias("pieces")), "op4-pieces")
    asked = near.join(pieces, "cell").select("cell", F.pmod(F.xxhash64("id"), "pieces").alias("piece"), "id")
    asked = asked.join(members, "id").select("cell", "piece", "id", "v", "weight", F.col("own").isNotNull().alias("owned"), F.lit(None).cast(kind).alias("pivot"), F.lit(False).alias("mine"))
    mine = members.where("own is not null").withColumnRenamed("own", "cell").join(pieces, "cell")
    mine = mine.select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "id", "v", "weight", F.lit(True).alias("owned"), "pivot", F.lit(True).alias("mine"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = rows[rows["mine"]], rows[~rows["mine"]]
        if not len(theirs):
            return pd.DataFrame({"a": [], "others": [], "pivot": []})
        x, y = (np.stack(r["v"].to_numpy()) for r in (ours, theirs))
        x, y = (v / np.sqrt((v * v).sum(1))[:, None] for v in (x, y))
        close = (x @ y.T >= least) & (ours["id"].to_numpy()[:, None] != theirs["id"].to_numpy()[None])
        linked = close.any(0)
        # A cell that owns the other end counts for it.
        told = np.where(theirs["owned"].to_numpy(bool), 0, ours["weight"].to_numpy() @ close)
        out = [
            pd.DataFrame({"a": ours["id"].to_numpy(), "others": close @ theirs["weight"].to_numpy(), "pivot": None}),
            pd.DataFrame({"a": theirs["id"].to_numpy()[linked], "others": told[linked], "pivot": ours["pivot"].iloc[0]}),
        ]
        return pd.concat([x.astype({"pivot": object}) for x in out], ignore_index=True)

    return stored(mine.unionByName(asked).groupBy("cell", "piece").applyInPandas(count, f"a {kind}, others long, pivot {kind}"), "op4-exact")


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, **forest) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row; links are pairs found with a cosine of at least ``least``."""
    rows = stored(_classes(vectors, id_col, vector_col), "op4-rows")
    good = rows.where("direction is not null").select("_id", "direction").distinct()
    classes = good.groupBy("direction").agg(F.min("_id").alias("rep"), F.count("*").alias("weight"))
    # Vectors of another length have no cosine with the rest: each length is a forest of its own.
    classes = stored(classes.withColumn("size", F.size("direction")), "op4-classes")
    kind = dict(classes.dtypes)["rep"]
    # Classes are named by a number: an id that repeats with another vector is in several.
    named = stored(classes.withColumn("id", F.xxhash64("direction")), "op4-named")
    links = vectors.sparkSession.createDataFrame([], "a long, others long")
    edges = vectors.sparkSession.createDataFrame([], "a long, b long")
    for size in [r["size"] for r in named.select("size").distinct().collect()]:
        others, joins = found_links(named.where(F.col("size") == size).select("id", F.col("direction").alias("v"), "weight"), least, **forest)
        links, edges = links.union(others), edges.union(joins)

    links = links.groupBy("a").agg(F.sum("others").alias("others"))
    joined = components(edges, "op4-components").join(named.select(F.col("id").alias("node"), "rep"), "node")
    least_id = joined.groupBy("component").agg(F.min("rep").alias("least"))
    named_by = joined.join(least_id, "component").select(F.col("node").alias("id"), "least")
    final = named.select("id", "direction", "rep", "weight").join(links.withColumnRenamed("a", "id"), "id", "left").join(named_by, "id", "left")
    final = final.select("direction", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.where("direction is not null").join(final, "direction").select("_id", "n_links", "component_id")
    alone = rows.where("direction is null").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").cast(kind).alias("component_id"))
    out = out.union(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
