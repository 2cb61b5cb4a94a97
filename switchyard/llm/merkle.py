"""A Merkle manifest of a table: a content-addressed DAG, and proofs by descent from its root.

Leaves are digests of rows, numbered within each group.  Every two
consecutive nodes become their digest until one is left, the group's subroot;
the subroots, in the order of the groups, make the root in the same way.

The store maps digests to children.  A record spans up to ``BITS`` binary
levels: it holds the nodes of each of them, so a block of 256 leaves is one
record and a table of 10^12 rows five records deep.  A request goes down from
the root: the next digits of its rank choose the child, and the siblings not
chosen join its path; reversed, the path runs from the leaf to the root.
Requests go down together, as the distinct prefixes of their ranks, so upper
records are met once and not once a leaf, and no key gathers more than one
block of requests.

Null group values are a group of their own, first in order.  Equal rows are
leaves of their own; ties in the order are broken by the leaf digest.  An
empty table has no root and gives no rows.  Rows travel in a struct, so their
column names cannot clash with those used here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .common import written

BITS = 8
FAN = 1 << BITS
_STEP = "array<struct<right:boolean,sibling:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def record_digest(*fields: Column) -> Column:
    """The digest of a row: ``-`` for a null field, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _pairs(nodes: Column) -> Column:
    """The next level: the digest of every two nodes; of a lone last one, too."""
    places = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(places, lambda i: digest(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))))


def _height(n: Column) -> Column:
    """Levels of a record where its group has ``n`` nodes: until one is left, ``BITS`` at most."""
    return sum([(n > (1 << k)).cast("int") for k in range(BITS)], F.lit(0))


def _above(n: Column, tier: int) -> Column:
    """Nodes of a group of ``n`` leaves above ``tier`` tiers of records."""
    return F.ceil(n / F.lit(FAN ** tier)).cast("long") if tier else n


@dataclass
class Manifest:
    """``leaves``: struct ``row``, ``grp``, ``rank`` from 0, ``leaf``.  ``groups``: ``grp``, ``g`` from 0, ``n``, ``subroot``.
    ``records``: ``digest`` and the ``levels`` of nodes under it, lowest first.  ``root``: one row, none if there are no leaves."""

    leaves: DataFrame
    groups: DataFrame
    records: DataFrame
    root: DataFrame
    tiers: int  # of records under the largest subroot
    top_tiers: int  # of records over the subroots


def _records_of(nodes: DataFrame, n: DataFrame | None) -> DataFrame:
    """Blocks of nodes (``g``, ``rank``, ``digest``[, ``n``]) as (``g``, ``n``, ``rank``, ``digest``, ``levels``)."""
    blocks = nodes.groupBy("g", *(["n"] if n is None else []), F.shiftright("rank", BITS).alias("rank")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda s: s["digest"]).alias("nodes"))
    if n is not None:
        blocks = n.join(blocks.withColumnRenamed("g", "of"), F.col("grp").eqNullSafe(F.col("of"))).select("g", "n", "rank", "nodes")
    steps = F.slice(F.sequence(F.lit(1), F.lit(BITS)), F.lit(1), _height(F.col("n")))
    levels = F.aggregate(steps, F.array("nodes"), lambda done, _: F.concat(done, F.array(_pairs(F.element_at(done, -1)))))
    return (blocks.withColumn("levels", levels)
            .select("g", "n", "rank", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), "levels"))


def _tree(nodes: DataFrame, most: int, name: str, n: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (``g``, ``digest``) and the records of each tier, lowest first."""
    tiers: list[DataFrame] = []
    while most > 1 or n is not None:
        blocks = written(_records_of(nodes, n), f"merkle-{name}{len(tiers)}")
        tiers.append(blocks)
        nodes = blocks.select("g", "rank", "digest", _above(F.col("n"), 1).alias("n"))
        most, n = -(-most // FAN), None
    return nodes.select("g", "digest"), tiers


def build(rows: DataFrame, group: str, order: list[str], leaf: str) -> Manifest:
    """The manifest of ``rows``, whose column ``leaf`` holds their digests, by ``group`` in ``order``."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    packed = written(rows.select(F.struct("*").alias("row"), F.col(group).alias("grp"), *keys, F.col(leaf).alias("leaf")), "merkle-rows")
    names = [f"k{i}" for i in range(len(keys))]
    numbered = ranked(packed, ["grp"], [*names, "leaf", F.xxhash64("row")], out="at")
    leaves = written(numbered.select("row", "grp", (F.col("at") - 1).alias("rank"), "leaf"), "merkle-leaves")
    counts = written(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
    sizes = counts.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    groups = ranked(counts, [], ["grp"], out="at").select("grp", (F.col("at") - 1).alias("g"), "n")
    groups = written(groups, "merkle-numbered")
    nodes = leaves.select(F.col("grp").alias("g"), "rank", F.col("leaf").alias("digest"))
    subroots, tiers = _tree(nodes, sizes["most"] or 0, "tier", groups)
    groups = written(groups.join(subroots.withColumnRenamed("digest", "subroot"), "g"), "merkle-groups")
    top = groups.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.col("subroot").alias("digest"), F.lit(sizes["groups"]).cast("long").alias("n"))
    root, above = _tree(top, sizes["groups"], "top")
    children = F.slice("levels", F.lit(1), F.size("levels") - 1)  # the last level is the digest itself
    store = [t.where(F.size("levels") > 1).select("digest", children.alias("levels")) for t in [*tiers, *above]]
    records = store[0]
    for more in store[1:]:
        records = records.unionByName(more)
    # equal blocks have one digest and are one record
    records = written(records.groupBy("digest").agg(F.any_value("levels").alias("levels")), "merkle-records")
    return Manifest(leaves, groups, records, root.select(F.col("digest").alias("root")), len(tiers), len(above))


def _siblings(levels: Column, place: Column) -> Column:
    """What a request for ``place`` does not choose on its way down a record; null where a node has no sibling."""
    down = F.reverse(F.sequence(F.lit(0), F.size(levels) - 1))

    def step(k: Column) -> Column:
        at = F.call_function("shiftright", place, k)
        return F.struct((at % 2 == 1).alias("right"), F.get(F.get(levels, k), at.bitwiseXOR(F.lit(1))).alias("sibling"))

    return F.when(F.size(levels) > 0, F.transform(down, step)).otherwise(F.array().cast(_STEP))


def _descend(state: DataFrame, records: DataFrame, deep: Column) -> DataFrame:
    """Every request prefix one record further down; where there is none at this depth (``deep`` false), as it is."""
    met = state.withColumn("key", F.when(deep, F.col("at"))).join(records, F.col("key") == F.col("digest"), "left")
    children = F.transform(F.get("levels", F.lit(0)), lambda node, i: F.struct(
        i.cast("long").alias("place"), node.alias("digest"), _siblings(F.col("levels"), i).alias("step")))
    same = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.col("at").alias("digest"), F.array().cast(_STEP).alias("step")))
    kept = [c for c in state.columns if c not in ("prefix", "at", "path")]
    return (met.withColumn("child", F.explode(F.when(F.col("levels").isNull(), same).otherwise(children)))
            .select(*kept, (F.col("prefix") * FAN + F.col("child.place")).alias("prefix"), F.col("child.digest").alias("at"),
                    F.concat("path", "child.step").alias("path")))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The proof of each requested leaf: ``requests`` has ``row`` (any struct), ``grp`` and ``rank``, at most one for a leaf.

    Returns ``row``, ``subroot``, ``root`` and ``path`` from the leaf up: (is the node right of its sibling, sibling).
    """
    m = manifest
    asked = requests.groupBy("grp", F.shiftright("rank", BITS).alias("block")).agg(
        F.collect_list(F.struct((F.col("rank") % FAN).cast("int").alias("place"), "row")).alias("asked"))
    numbered = m.groups.select(F.col("grp").alias("of"), "g")
    asked = written(numbered.join(asked, F.col("of").eqNullSafe(F.col("grp"))).select("g", "block", "asked"), "merkle-asked")
    wanted = [asked.select("g", F.col("block").alias("prefix"))]
    for _ in range(m.tiers - 1):
        wanted.append(wanted[-1].select("g", F.shiftright("prefix", BITS).alias("prefix")).distinct())

    state = m.root.select("root", F.lit(0).cast("long").alias("prefix"), F.col("root").alias("at"), F.array().cast(_STEP).alias("path"))
    for _ in range(m.top_tiers):
        state = _descend(state, m.records, F.lit(True))
    state = state.withColumnRenamed("prefix", "g").withColumn("subroot", F.col("at"))
    state = state.join(m.groups.select("g", "n"), "g").withColumn("prefix", F.lit(0).cast("long"))
    state = state.join(wanted[-1].select("g").distinct(), "g", "left_semi")
    for tier in range(m.tiers - 1, 0, -1):
        state = _descend(state, m.records, _above(F.col("n"), tier) > 1)
        state = written(state.join(wanted[tier - 1], ["g", "prefix"], "left_semi"), f"merkle-state{tier}")
    blocks = state.join(asked, (state["g"] == asked["g"]) & (F.col("prefix") == F.col("block"))).drop(asked["g"])
    # the requests of one leaf block share its record
    blocks = blocks.withColumn("key", F.when(F.col("n") > 1, F.col("at"))).join(m.records, F.col("key") == F.col("digest"), "left")
    levels = F.coalesce("levels", F.array().cast("array<array<string>>"))
    found = F.transform("asked", lambda q: F.struct(q["row"].alias("row"), _siblings(levels, q["place"]).alias("step")))
    return (blocks.select("root", "subroot", "path", F.explode(found).alias("q"))
            .select("q.row", "subroot", "root", F.reverse(F.concat("path", "q.step")).alias("path")))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, s: F.when(s["sibling"].isNull(), digest(node))
                       .when(s["right"], digest(s["sibling"], node)).otherwise(digest(node, s["sibling"])))


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)
