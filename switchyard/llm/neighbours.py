"""Approximate nearest neighbours by a forest of random-projection trees.

A node of a tree sends a vector to the side of a random hyperplane that it
lies on.  The hyperplanes are fitted on a bounded sample (``sample_rows``
distinct vectors, by hash); every distinct vector of the table is then dealt
to its leaf of every tree.  A query keeps one priority queue for all trees,
ordered by how far it lies from the hyperplanes crossed so far, and visits
the ``visits`` leaves that leave it first.  Leaf and query meet by an
equi-join of (tree, leaf), in blocks of bounded size; distances of all
candidates are exact, in double precision, on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Tree:
    normals: np.ndarray  # (nodes, dimensions)
    cuts: np.ndarray
    children: np.ndarray  # (nodes, 2): a node, or -1 - leaf

    @classmethod
    def grown(cls, points: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
        normals, cuts, children, leaves = [], [], [], 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            normal = rng.standard_normal(points.shape[1])
            along = points[rows] @ normal
            cut = float(np.median(along)) if len(rows) else 0.0
            right = along > cut
            if len(rows) > leaf_rows and right.any():
                me = len(normals)
                normals.append(normal / max(1e-300, float(np.linalg.norm(normal))))
                cuts.append(cut / max(1e-300, float(np.linalg.norm(normal))))
                children.append([0, 0])
                todo += [(rows[~right], me, 0), (rows[right], me, 1)]
            else:
                me = -1 - leaves
                leaves += 1
            if parent >= 0:
                children[parent][side] = me
        return cls(np.array(normals).reshape(len(normals), points.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2))

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), np.int64) if len(self.cuts) else np.full(len(points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", points[inner], self.normals[node]) > self.cuts[node]
            at[inner] = self.children[node, right.astype(int)]
        return -1 - at


def leaves_of(forest: list[Tree], query: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The first ``visits`` (tree, leaf) that the shared queue yields: least distance to the hyperplanes crossed."""
    queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    out: list[tuple[int, int]] = []
    margins = [tree.normals @ query - tree.cuts for tree in forest]
    while queue and len(out) < visits:
        far, t, node = heapq.heappop(queue)
        while node >= 0:
            m = float(margins[t][node])
            near = 1 if m > 0 else 0
            heapq.heappush(queue, (max(far, abs(m)), t, int(forest[t].children[node, 1 - near])))
            node = int(forest[t].children[node, near])
        out.append((t, -1 - node))
    return out


def finite(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = 8, sample_rows: int = 16_384, leaf_rows: int = 32, visits: int = 600,
            block_rows: int = 4096, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row, its own row excluded.

    Ordered by Euclidean distance, then the smaller id.  Vectors of another
    length than the query's are no candidates.  Equal vectors are searched
    once: of each the ``k + 1`` smallest ids can be among the nearest.
    Repeated ids count once; rows without an id or a usable vector take no
    part; an empty table gives no rows.  ``visits`` leaves hold about
    ``visits * leaf_rows * rows / sample_rows`` candidates, so a table far
    larger than the sample needs a larger sample.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("v")))
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "ann-rows")
    # a row for each distinct vector; no key of it gathers more than k + 1 ids
    first = Window.partitionBy("v").orderBy("id")
    members = written(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
                      .groupBy("v").agg(F.min("id").alias("gid"), F.sort_array(F.collect_list("id")).alias("ids")), "ann-distinct")
    sample = [np.array(r["v"]) for r in members.orderBy(F.xxhash64(F.lit(seed), "gid")).limit(sample_rows).select("v").collect()]
    forests: dict[int, list[Tree]] = {}
    for size in sorted({len(v) for v in sample}):
        points, rng = np.array([v for v in sample if len(v) == size]), np.random.default_rng(seed)
        forests[size] = [Tree.grown(points, leaf_rows, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forests)  # bounded by sample_rows x trees / leaf_rows hyperplanes

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            for size, part in batch.groupby(sizes):
                points = np.array(part["v"].tolist())
                for t, tree in enumerate(shared.value.get(size, [Tree(np.zeros((0, size)), np.zeros(0), np.zeros((0, 2), int))])):
                    yield pd.DataFrame({"size": size, "tree": t, "leaf": tree.leaf(points), "gid": part["gid"], "ids": part["ids"], "v": part["v"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, v in zip(batch["qid"], batch["v"]):
                forest = shared.value.get(len(v), [Tree(np.zeros((0, len(v))), np.zeros(0), np.zeros((0, 2), int))])
                got = leaves_of(forest, np.asarray(v), visits)
                yield pd.DataFrame({"qid": q, "v": [v] * len(got), "size": len(v), "tree": [t for t, _ in got], "leaf": [x for _, x in got]})

    index = members.mapInPandas(deal, "size int, tree int, leaf int, gid long, ids array<long>, v array<double>")
    # equal queries are asked once; the members of a vector find their answers by it
    asking = rows.where("asks").select("id", "v")
    distinct = written(asking.groupBy("v").agg(F.min("id").alias("qid")), "ann-queries")
    asked = distinct.mapInPandas(ask, "qid long, v array<double>, size int, tree int, leaf int")
    key = ["size", "tree", "leaf"]
    # leaves far over the mean are cut into blocks, and every block sees all queries of the leaf
    index = written(index, "ann-index")
    blocks = index.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    large = written(blocks.where("blocks > 1"), "ann-large-leaves")
    index = index.join(large, key, "left").withColumn("block", F.pmod(F.xxhash64("gid"), F.coalesce("blocks", F.lit(1))).cast("int"))
    asked = asked.join(large, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))

    def rank(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            points, ids = np.array(candidates["v"].tolist()), candidates["ids"].tolist()
            for q, v in zip(queries["qid"], queries["v"]):
                d = np.sqrt(((points - np.asarray(v)) ** 2).sum(axis=1))
                best = np.argsort(d, kind="stable") if len(d) <= k + 1 else np.flatnonzero(d <= np.partition(d, k)[k])
                out += [(q, int(i), float(d[j])) for j in best for i in ids[j]]
        return pd.DataFrame(out, columns=["qid", "id", "d"])

    by = [*key, "block"]
    found = (asked.select("qid", "v", *by).groupBy(*by).cogroup(index.select("gid", "ids", "v", *by).groupBy(*by))
             .applyInPandas(rank, "qid long, id long, d double"))
    found = found.groupBy("qid", "id").agg(F.min("d").alias("d"))  # several trees find the same
    best = Window.partitionBy("qid").orderBy("d", "id")
    answers = written(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("qid", "id", "d"), "ann-answers")
    per_query = asking.select(F.col("id").alias("query_id"), "v").join(distinct, "v").select("query_id", "qid").join(answers, "qid")
    own = Window.partitionBy("query_id").orderBy("d", "id")
    return (per_query.where("id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), F.col("d").alias("score")))
