"""Embedding near-duplicates by hierarchical navigable small-world graphs.

The distinct vectors are dealt to shards of bounded size; each shard gets a
graph of layers, every layer a random part of the one below, in which a
vector's neighbours are near and spread out.  Every shard is queried by every
other (of two shards the one's vectors search the other's graph, which shows
the links of both) and by its own vectors, from the top layer down, by a
beam; a shard widens its beam until an audit passes (vectors planted at the linking angle of its own
members must be found).  Cosines are verified in double precision, and the
links make components.  Searches run on many queries at once.

A graph is a table with a row for each vector, written once to the shared
folder; workers read the graph and the vectors that ask it from there, with
``pyarrow.fs``.  So nothing is copied for each pair of shards, and a worker
holds one graph and one shard's vectors.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_fs_path, scratch_path
from .common import let_go, written
from .components import connected_components
from .neighbours import finite

WIDTH = 16  # neighbours in upper layers; twice as many in the lowest
BATCH = 512
ROOM = 1 << 22  # numbers that a step gathers at a time
CROWD = 8  # a query that finds so many rows compares all


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; huge components do not overflow."""
    vectors = vectors.astype(np.float64, copy=False)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


@dataclass
class Layer:
    members: np.ndarray  # rows of the shard
    links: np.ndarray  # (members, width): places in ``members``, -1 for none
    points: np.ndarray  # the members' vectors, in single precision


def _keys(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """(cosine, place) as one number that sorts like them; its last bit says whether the place has been opened."""
    bits = sims.view(np.int32).astype(np.int64)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) << 32 | ids.astype(np.int64) << 1


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` best (place, cosine) that a beam search from ``entry`` finds for each query, best first; place -1 for none.

    Cosines are computed for places met for the first time only, ``ROOM``
    numbers at a time.
    """
    n, m = len(queries), len(points)
    links = np.concatenate([links, np.full((1, links.shape[1]), -1, links.dtype)])  # the last row: neighbours of none
    seen = np.zeros(n * (m + 1), bool)
    seen[m::m + 1] = True  # "no neighbour": the place before a query's first
    none = np.iinfo(np.int64).min + 1  # counts as opened
    beam = np.full((n, ef), none)
    start = entry[:, :ef]
    beam[:, :start.shape[1]] = _keys(start, np.einsum("qd,qkd->qk", queries, points[start]))
    seen[np.arange(n)[:, None] * (m + 1) + start] = True
    live = np.arange(n)
    while len(live):
        now = beam[live]
        todo = np.where(now & 1, none, now)
        pick = todo if ef <= step else np.partition(todo, ef - step, axis=1)[:, ef - step:]
        now |= (todo >= pick.min(axis=1, keepdims=True)) & (todo > none)
        near = links.take(np.where(pick > none, (pick & 0xFFFFFFFF) >> 1, m), axis=0).reshape(len(live), -1)
        near.sort(axis=1)
        at = near + live[:, None] * (m + 1)
        fresh = ~seen.take(at, mode="wrap")
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        cells, many = np.flatnonzero(fresh), np.count_nonzero(fresh, axis=1)
        seen[at.ravel()[cells]] = True
        found, room = near.ravel()[cells], max(1, ROOM // points.shape[1])
        asks, sims = np.repeat(live, many), np.empty(len(cells), np.float32)
        for a in range(0, len(cells), room):
            sims[a:a + room] = np.einsum("nd,nd->n", queries.take(asks[a:a + room], axis=0), points.take(found[a:a + room], axis=0))
        new = np.full((len(live), many.max()), none)
        new[np.repeat(np.arange(len(live)), many), np.arange(len(cells)) - np.repeat(np.cumsum(many) - many, many)] = _keys(found, sims)
        now = np.partition(np.concatenate([now, new], axis=1), new.shape[1], axis=1)[:, new.shape[1]:] if new.shape[1] else now
        beam[live] = now
        live = live[~(now & 1).all(axis=1)]
    beam = np.sort(beam, axis=1)[:, ::-1]
    bits = (beam >> 32).astype(np.int32)
    sims = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32).view(np.float32)
    return np.where(beam > none, (beam & 0xFFFFFFFF) >> 1, -1), np.where(beam > none, sims, np.float32(-np.inf))


def _spread(points: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to it than to a chosen one.

    The nearest of the rest fill up what is left of ``width``.  Rows are taken
    a few at a time, since all candidates' vectors would be larger than the graph.
    """
    n, k = ids.shape
    kept = np.full((n, width), -1, np.int32)
    some = max(1, ROOM // (k * max(k, points.shape[1])))
    for a in range(0, n, some):
        near, cosines = ids[a:a + some], sims[a:a + some]
        valid = (near >= 0) & (near != own[a:a + some, None]) & np.isfinite(cosines)
        vectors = points.take(near, axis=0)
        nearer = vectors @ vectors.transpose(0, 2, 1) >= cosines[:, :, None]
        words = np.packbits(np.pad(nearer, ((0, 0), (0, 0), (0, -k % 64))), axis=2, bitorder="little").view(np.uint64)
        chosen, taken, count = np.zeros(near.shape, bool), np.zeros((len(near), words.shape[2]), np.uint64), np.zeros(len(near), int)
        for j in range(k):
            chosen[:, j] = valid[:, j] & ~(taken & words[:, j]).any(axis=1) & (count < width)
            count += chosen[:, j]
            taken[:, j // 64] |= chosen[:, j].astype(np.uint64) << np.uint64(j % 64)
        rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
        kept[a:a + some, :rank.shape[1]] = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(near, rank, 1), -1)
    return kept


def _grown(points: np.ndarray, width: int, effort: int = 48) -> np.ndarray:
    """The links of one layer: batches are searched in the graph so far and linked in both directions.

    Batches grow with the graph, so that a row's links are chosen anew less often.
    """
    m = len(points)
    links = np.full((m, width), -1, np.int32)
    done = 0
    while done < m:
        batch = np.arange(done, min(m, done + (max(BATCH, min(done // 8, 8 * BATCH)) if done >= BATCH else 128)))
        for a in range(0, len(batch), BATCH):
            some = batch[a:a + BATCH]
            fresh = points[some] @ points[batch].T
            fresh[np.arange(len(some)), some - done] = -np.inf
            top = np.argpartition(-fresh, width - 1, axis=1)[:, :width] if len(batch) > width else np.argsort(-fresh, axis=1)
            ids, sims = batch[top], np.take_along_axis(fresh, top, 1)
            if done:
                entry = np.unique(np.random.default_rng(done).integers(0, done, 8))[None, :].repeat(len(some), 0)
                old, near = _beam(points[:done], links[:done], points[some], entry, effort)
                ids, sims = np.concatenate([ids, old], 1), np.concatenate([sims, near], 1)
            ids = np.where(np.isfinite(sims), ids, -1)
            order = np.argsort(-sims, axis=1, kind="stable")
            links[some] = _spread(points, some, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), width)
        # the other direction: every target chooses anew from its links and the newcomers nearest to it
        source, target = np.repeat(batch, width), links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        near = np.einsum("nd,nd->n", points[source], points[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.empty(0, np.int64)
        place = np.arange(len(target)) - np.repeat(starts, np.diff(np.append(starts, len(target))))
        some = place < width
        asked, at = np.unique(target[some], return_inverse=True)
        extra = np.full((len(asked), width), -1, np.int32)
        extra[at, place[some]] = source[some]
        ids = np.sort(np.concatenate([links[asked], extra], 1), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims, room = np.full(ids.shape, -np.inf, np.float32), max(1, ROOM // (ids.shape[1] * points.shape[1]))
        for a in range(0, len(asked), room):
            sims[a:a + room] = np.einsum("nd,nkd->nk", points[asked[a:a + room]], points.take(ids[a:a + room], axis=0))
        sims[ids < 0] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        links[asked] = _spread(points, asked, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), width)
        done = int(batch[-1]) + 1
    return links


@dataclass
class Dealt:
    """The vectors of one length: their shards, and the units of search between these.

    Of two shards one asks the other: the one that is fewer steps ahead, round
    the circle of shards.  A unit is a block of a shard's vectors asking a
    graph; units of a graph and, for it, of a shard follow each other.
    """

    size: int
    first: int  # shard
    shards: int
    blocks: int
    begin: int  # unit

    @property
    def units(self) -> int:
        return self.shards * (self.shards // 2 + 1) * self.blocks

    def unit(self, no: int) -> tuple[int | None, int, int, int]:
        """(graph, shard that asks it, block, blocks); no graph if the other shard asks."""
        rest, block = divmod(no - self.begin, self.blocks)
        to, steps = divmod(rest, self.shards // 2 + 1)
        shard = (to - steps) % self.shards
        asks = 2 * steps < self.shards or shard < to
        return self.first + to if asks else None, self.first + shard, block, self.blocks


@dataclass
class Graph:
    vectors: np.ndarray  # unit, double
    layers: list[Layer]  # the lowest first
    beam: int

    @classmethod
    def built(cls, vectors: np.ndarray, least: float, seed: int = 5, audit: int = 512, recall: float = 0.99) -> Graph:
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(WIDTH)).astype(int)
        level[:1] = max(level.max(initial=0), 0)
        single, layers = vectors.astype(np.float32), []
        for high in range(level.max(initial=0) + 1):
            members = np.flatnonzero(level >= high)
            points = single[members] if high else single
            layers.append(Layer(members, _grown(points, WIDTH * (1 if high else 2)), points))
        graph = cls(vectors, layers, 32 if len(vectors) <= 2 * 8192 else 48)
        graph._audit(least, rng, audit, recall)
        return graph

    def _audit(self, least: float, rng: np.random.Generator, audit: int, recall: float) -> None:
        """Doubles the beam until vectors planted at the linking cosine of members find them."""
        n, d = self.vectors.shape
        at = rng.permutation(n)[:audit]
        noise = rng.standard_normal((len(at), d))
        base = self.vectors[at]
        noise -= (noise * base).sum(axis=1, keepdims=True) * base
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        cosine = min(1.0, least + 0.01)
        planted = unit(cosine * base + np.sqrt(1 - cosine**2) * noise / np.where(length > 0, length, 1))
        while self.beam < n:
            found, sims = self.search(planted, self.beam)
            crowd = (sims >= least).sum(axis=1) >= CROWD  # compared with all rows
            if ((found == at[:, None]).any(axis=1) | crowd).mean() >= recall:
                return
            self.beam *= 2
        self.beam = n

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the shard, cosines) of the best ``ef``, from the top layer down."""
        out = []
        for a in range(0, len(queries), BATCH):
            asked = queries[a:a + BATCH].astype(np.float32)
            best = np.full((len(asked), 1), self.layers[-1].members[0])
            for high in range(len(self.layers) - 1, -1, -1):
                layer = self.layers[high]
                entry = np.searchsorted(layer.members, best)
                ids, sims = _beam(layer.points, layer.links, asked, entry, min(len(layer.members), 8 if high else ef))
                best = np.where(ids < 0, -1, layer.members[ids])
                if high:  # repeated entries would be counted twice
                    best = best[:, :1]
            out.append((best, sims))
        width = max(i.shape[1] for i, _ in out)
        pad = lambda x, v: np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=v)
        return np.concatenate([pad(i, -1) for i, _ in out]), np.concatenate([pad(s, -np.inf) for _, s in out])

    def pairs(self, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, rows found for them) with a cosine of ``least`` or more, verified in double precision, some at a time.

        The links of a crowd of close rows lead to each other, and to some of
        them none: queries that find ``CROWD`` rows are compared with all rows.
        """
        ask, slack = len(queries) if self.beam < len(self.vectors) else 0, self._slack()
        crowded = [np.arange(ask, len(queries))]
        for a in range(0, ask, BATCH):
            asked = np.arange(a, min(a + BATCH, ask))
            ids, sims = self.search(queries[asked], self.beam)
            near = (sims >= least - slack) & (ids >= 0)
            crowd = near.sum(axis=1) >= CROWD
            crowded.append(asked[crowd])
            near[crowd] = False
            q, k = np.nonzero(near)
            yield from self._verified(queries, asked[q], ids[q, k], sims[q, k], least)
        todo, some = np.concatenate(crowded), max(1, ROOM // len(self.vectors))
        for a in range(0, len(todo), some):
            asked = todo[a:a + some]
            sims = queries[asked].astype(np.float32) @ self.layers[0].points.T
            q, rows = np.nonzero(sims >= least - slack)
            yield from self._verified(queries, asked[q], rows, sims[q, rows], least)

    def _slack(self) -> float:
        """More than single precision can be wrong by in a cosine."""
        return max(1e-5, self.vectors.shape[1] * 2.0**-23)

    def _verified(self, queries: np.ndarray, q: np.ndarray, rows: np.ndarray, sims: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that link: what single precision leaves open is computed in double precision."""
        some = max(1, ROOM // (4 * queries.shape[1]))
        good = sims >= least + self._slack()
        unsure = np.flatnonzero(~good)
        for a in range(0, len(unsure), some):
            at = unsure[a:a + some]
            good[at] = np.einsum("nd,nd->n", queries[q[at]], self.vectors[rows[at]]) >= least
        for a in range(0, max(1, len(q)), ROOM // 4):
            kept = good[a:a + ROOM // 4]
            yield q[a:a + ROOM // 4][kept], rows[a:a + ROOM // 4][kept]

    def within(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        """Of each query the rows that ``pairs`` finds."""
        q, rows = (np.concatenate(x) for x in zip(*self.pairs(queries, least)))
        order = np.lexsort((rows, q))
        return np.split(rows[order], np.searchsorted(q[order], np.arange(1, len(queries))))

    def packed(self, v: np.ndarray | None = None) -> pa.Table:
        """A row for each vector: its number, ``v`` (unit vectors, if not given), its links in the lowest layer and in those above, the beam."""
        n, levels = len(self.vectors), np.zeros(len(self.vectors), np.int64)
        for layer in self.layers[1:]:
            levels[layer.members] += 1
        starts = np.concatenate(([0], np.cumsum(levels * WIDTH)))
        upper = np.empty(starts[-1], np.int32)
        for high, layer in enumerate(self.layers[1:]):
            upper[starts[layer.members][:, None] + high * WIDTH + np.arange(WIDTH)] = layer.links
        lists = lambda ends, x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
        even = lambda x: lists(np.arange(n + 1) * x.shape[1], x.ravel())
        return pa.table({"nth": np.arange(n, dtype=np.int32), "v": even(self.vectors if v is None else v),
                         "links": even(self.layers[0].links), "upper": lists(starts, upper), "beam": np.full(n, self.beam, np.int32)})

    @classmethod
    def unpacked(cls, rows: pa.Table) -> Graph:
        vectors = unit(matrix(rows["v"]))
        single, upper = vectors.astype(np.float32), rows["upper"].combine_chunks()
        layers, levels, flat = [Layer(np.arange(len(rows)), matrix(rows["links"]), single)], upper.value_lengths().to_numpy() // WIDTH, upper.flatten().to_numpy()
        starts = np.cumsum(levels * WIDTH) - levels * WIDTH
        for high in range(levels.max(initial=0)):
            members = np.flatnonzero(levels > high)
            layers.append(Layer(members, flat[starts[members][:, None] + high * WIDTH + np.arange(WIDTH)], single[members]))
        return cls(vectors, layers, rows["beam"][0].as_py())


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.combine_chunks().flatten().to_numpy().reshape(len(lists), -1)


def runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut where ``column`` changes."""
    cuts = np.flatnonzero(np.diff(batch[column].to_numpy())) + 1
    for a, z in pairwise([0, *cuts.tolist(), len(batch)]):
        if z > a:
            yield batch.slice(a, z - a)


def unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the trees of ``a`` and ``b``, pair by pair, together; every node of ``up`` names its root, before and after."""
    while (differ := up[a] != up[b]).any():
        one, other = up[a[differ]], up[b[differ]]
        np.minimum.at(up, np.maximum(one, other), np.minimum(one, other))
        while ((above := up[up]) != up).any():
            up[:] = above


def shard_rows_of(path: str, shard: int, columns: list[str]) -> pa.Table:
    """A shard's rows by their numbers, from the shared folder."""
    from pyarrow import fs, parquet

    system, at = fs.FileSystem.from_uri(local_fs_path(f"{path}/shard={shard}"))
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-"))
    rows = pa.concat_tables([parquet.ParquetFile(f, filesystem=system).read(["nth", *columns], use_threads=False) for f in files])
    nth = rows["nth"].to_numpy()
    return rows if (nth[1:] > nth[:-1]).all() else rows.take(np.argsort(nth))


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                    shard_rows: int = 8192, block_rows: int = 4096, shards: int = 12, shard_bytes: int = 16 << 20) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``.

    Rows whose vector is null, empty, zero or holds null or non-finite
    components link with nothing, as do vectors of different lengths.  Equal
    vectors are searched once and counted as often as they occur.  A null id
    is no link and gets null ids back; repeated rows of an id are one vector
    each.  Counts, not pairs, leave the searches, and of the links only what
    connects.

    Shards have about ``shard_rows`` rows until there are ``shards`` of them;
    from there on they grow, up to ``shard_bytes`` of vectors.  A search costs
    little more in a larger graph, and there are fewer to ask.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = written(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
                   .withColumn("ok", finite(F.col("v")) & F.col("id").isNotNull()), "hnsw-rows")
    usable = rows.where("ok")
    reps = written(usable.groupBy("v").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("size", F.size("v")), "hnsw-distinct")
    # equal ids may carry different vectors: a representative is told apart by (gid, its vector's hash)
    reps = reps.withColumn("key", F.xxhash64("v"))
    plan: list[Dealt] = []
    for size, n in sorted((r["size"], r["count"]) for r in reps.groupBy("size").count().collect()):  # a row for each vector length
        most = max(1, shard_bytes // (size * (4 if kind == "array<float>" else 8)))
        many = max(-(-n // most), min(-(-n // shard_rows), shards))
        last = plan[-1] if plan else Dealt(0, 0, 0, 0, 0)
        plan.append(Dealt(size, last.first + last.shards, many, -(-n // (many * block_rows)), last.begin + last.units))
    total, units = (plan[-1].first + plan[-1].shards, plan[-1].begin + plan[-1].units) if plan else (0, 0)
    sizes = spark.createDataFrame(pa.table({"size": pa.array([d.size for d in plan], pa.int32()), "first": pa.array([d.first for d in plan], pa.int64()),
                                            "shards": pa.array([d.shards for d in plan], pa.int64())}))
    dealt = reps.join(F.broadcast(sizes), "size").select((F.col("first") + F.pmod("key", "shards")).alias("shard"), "key", "copies", "v")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for _, group in groupby((run for batch in batches for run in runs(batch, "shard")), key=lambda run: run["shard"][0].as_py()):
            members = pa.Table.from_batches(list(group))
            v = matrix(members["v"])
            graph = Graph.built(unit(v), least).packed(v)
            yield from pa.table([*(members[c] for c in ("shard", "key", "copies")), *graph.columns], names=["shard", "key", "copies", *graph.column_names]).to_batches(4096)
            let_go()

    path, tasks = scratch_path(spark, "hnsw-graphs"), max(1, min(total, 4096))
    (dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "key")
     .mapInArrow(build, f"shard long, key long, copies long, nth int, v {kind}, links array<int>, upper array<int>, beam int")
     .write.partitionBy("shard").parquet(path))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        at = by = None
        for batch in batches:
            for unit_no in batch["id"].to_pylist():
                to, shard, block, blocks = plan[bisect_right(plan, unit_no, key=lambda d: d.begin) - 1].unit(unit_no)
                if to is None:
                    continue
                if to != at:
                    graph = rows = copies = keys = queries = by = None  # one graph at a time
                    rows = shard_rows_of(path, to, ["key", "copies", "v", "links", "upper", "beam"])
                    graph, copies, keys, at = Graph.unpacked(rows), rows["copies"].to_numpy(), rows["key"].to_numpy(), to
                    rows = None
                if shard != by:
                    queries = None
                    queries, by = shard_rows_of(path, shard, ["key", "copies", "v"]), shard
                    let_go()
                first = len(queries) * block // blocks
                asked = queries.slice(first, len(queries) * (block + 1) // blocks - first)
                if not len(asked):
                    continue
                own, m = shard == to, len(keys)
                many, key = asked["copies"].to_numpy(), asked["key"].to_numpy()
                node = np.arange(len(asked)) + (first if own else m)  # of an own query its row, else a node after the rows
                up = np.arange(m if own else m + len(asked))
                seen, met = np.zeros(len(up)), np.zeros(len(up), bool)  # counts below 2 ** 53
                for q, hits in graph.pairs(unit(matrix(asked["v"])), least):
                    q, hits = (x[key[q] != keys[hits]] for x in (q, hits))
                    seen += np.bincount(node[q], copies[hits], len(up))
                    if not own:  # nobody asks in the other direction
                        seen += np.bincount(hits, many[q], len(up))
                    met[node[q]] = met[hits] = True
                    unite(up, node[q], hits)
                names, linked = keys if own else np.concatenate([keys, key]), np.flatnonzero(met)
                yield pa.record_batch({"key": names[linked], "n": seen[linked].astype(np.int64), "to": names[up[linked]]})

    parts = max(1, min(units, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = written(spark.range(0, units, 1, parts).mapInArrow(search, "key long, n long, to long"), "hnsw-links")
    linked = found.groupBy("key").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("key").alias("src"), F.col("to").alias("dst")))
    roots = reps.join(comps.withColumnRenamed("node", "key"), "key", "left").select("key", "gid", "copies", F.coalesce("component", "key").alias("root"))
    smallest = written(roots.groupBy("root").agg(F.min("gid").alias("component_id")), "hnsw-roots")
    by_vector = written(roots.join(smallest, "root").join(linked, "key", "left")
                        .select("key", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "hnsw-components")
    keyed = rows.select("id", F.when(F.col("ok"), F.xxhash64("v")).alias("key"))
    own = F.coalesce("component_id", "id")
    return keyed.join(by_vector, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), (F.col("id") == own).alias("kept"))
