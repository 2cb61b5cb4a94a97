"""SimHash near-duplicates: fingerprints, BK-trees per shard, connected components.

A *shard* holds the distinct fingerprints that agree in one of
``radius + 1`` blocks of their bits.  Two fingerprints within the radius
differ in at most ``radius`` blocks, so they share a shard: searching each
shard's tree with the shard's own fingerprints misses no link, and the work
does not grow with the square of the corpus.  All trees together grow with
the corpus and have no proven bound, so they are not broadcast: each is built
in the task that its shard is dealt to.  A shard of more than ``cell``
fingerprints is searched as cells of two chunks each, so no task holds a
large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_go, written
from .components import connected_components

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GROUP = 16_384  # hashes counted together


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half the shingles' hashes.

    Words are runs of bytes that are not ASCII white space, A-Z in lower case.
    Fewer words than a shingle: the whole sequence is one.  No word: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    line = b" ".join(words)
    begins = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, GROUP):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begins[at:at + GROUP], stops[at:at + GROUP])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprinted(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of every whole text as a signed 64-bit number."""

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for texts in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.array(prints.view(np.int64))

    return run.asNondeterministic()(text)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.children: list[dict[int, int]] = [{} for _ in prints]
        values = prints.tolist()
        for i in range(1, len(values)):
            at = 0
            while (near := self.children[at].setdefault((values[i] ^ values[at]).bit_count(), i)) != i:
                at = near

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it), following only edges within the radius."""
        todo = [(0, np.arange(len(queries)))] if len(self.prints) else []
        while todo:
            node, asked = todo.pop()
            far = np.bitwise_count(queries[asked] ^ self.prints[node]).astype(np.int64)
            yield node, asked[far <= radius]
            for d, child in self.children[node].items():
                near = asked[np.abs(far - d) <= radius]
                if len(near):
                    todo.append((child, near))


def _forest(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what is linked among ``prints``: each one to the first of its component."""
    up = list(range(len(prints)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    if len(prints) == 2:
        if (int(prints[0]) ^ int(prints[1])).bit_count() <= radius:
            up[1] = 0
    else:
        for node, near in BKTree(prints).search(prints, radius):
            for other in near[near != node].tolist():
                a, b = root(node), root(other)
                if a != b:
                    up[max(a, b)] = min(a, b)
    linked = [(i, r) for i in range(len(prints)) if (r := root(i)) != i]
    return [i for i, _ in linked], [r for _, r in linked]


def links(prints: DataFrame, radius: int = 3, cell: int = 1024) -> DataFrame:
    """``prints(fp)``, distinct -> ``(src, dst)``: links that connect all within ``radius`` bits.

    Of a connected set inside a shard only the links to one of its members are
    returned, so rows grow with the fingerprints, not with their pairs.
    """
    blocks = radius + 1
    width = 64 // blocks
    keys = F.array(*[
        F.struct(F.lit(b).cast("int").alias("block"),
                 F.shiftrightunsigned("fp", width * b).bitwiseAND(F.lit((1 << (width if b < blocks - 1 else 64 - width * b)) - 1)).alias("bits"))
        for b in range(blocks)])
    dealt = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.bits")
    large = (dealt.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
             .withColumn("chunks", F.ceil(F.col("n") / cell).cast("int")).drop("n"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                    lambda other: F.struct(F.least(other, chunk).alias("i"), F.greatest(other, chunk).alias("j"))))
    placed = (dealt.join(large, ["block", "bits"], "left").select("fp", "block", "bits", F.explode(cells).alias("c"))
              .select("fp", F.xxhash64("block", "bits", "c.i", "c.j").alias("shard"))
              .repartition("shard").sortWithinPartitions("shard", "fp"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_fp, left_shard = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in [*batches, None]:
            if batch is not None:
                left_fp = np.concatenate([left_fp, batch.column("fp").to_numpy()])
                left_shard = np.concatenate([left_shard, batch.column("shard").to_numpy()])
            if not len(left_fp):
                continue
            starts = np.flatnonzero(np.concatenate(([True], left_shard[1:] != left_shard[:-1])))
            stops = np.append(starts[1:], len(left_fp))
            whole = len(starts) if batch is None else len(starts) - 1  # the last shard may go on
            src, dst = [], []
            for a, b in zip(starts[:whole], stops[:whole]):
                if b - a > 1:
                    members = left_fp[a:b]
                    i, r = _forest(members.view(np.uint64), radius)
                    src += members[i].tolist()
                    dst += members[r].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
            keep = len(left_fp) if batch is None else starts[whole]
            left_fp, left_shard = left_fp[keep:], left_shard[keep:]

    # fingerprints with the same shard hash but another block only meet in one tree more
    return placed.mapInArrow(search, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3, carry: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp`` (signed), ``component_id``, ``component`` and ``carry``.

    ``component`` is the same for all linked fingerprints and differs between
    others, also where one id has texts in both.

    ``component_id`` is the smallest non-null id reachable over links of at
    most ``radius`` differing bits, the row's own included.  Null and empty
    texts have fingerprint zero and are linked like any other; repeated rows
    stay; a null id is in the component of its text.
    """
    extra = [] if carry is None else [carry.alias("carry")]
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprinted(F.col(text_col), shingle).alias("fp"), *extra), "simhash")
    reps = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    comps = connected_components(links(reps.select("fp"), radius))
    roots = reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("root"))
    smallest = written(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-roots")
    by_print = written(roots.join(smallest, "root").select("fp", "component_id", F.col("root").alias("component")), "simhash-components")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "component", *(["carry"] if extra else []))
