"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's rows are dealt, in the order of a hash of their key, into blocks of
``block_rows``.  With integer shares that add up to P, block j (from 1) of a
source with share a may start at slot floor((j-1) P / a), its release, and
must be done by slot ceil(j P / a), its deadline; each slot goes to the
released block with the earliest deadline.  One period of P slots is
scheduled (a fold over P slots; its size is that of the configuration) and
holds for all periods: every source gets exactly its share in each, and after
every slot it is less than one block off its target.  Sources of equal share
have equal windows, so for few distinct shares the period is known as a few
runs of slots, for any number of sources (``segments``).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import ranked as skew_safe_ranked
from .common import written

RUN = 16_384  # rows of a group that are ranked together
MAX_SLOTS = 20_000  # sources x slots of a period stay a configuration, not data


def period(shares: dict[str, int]) -> tuple[list[str], int]:
    if any(not isinstance(a, int) or a < 1 for a in shares.values()):
        raise ValueError("shares are positive integers")
    if sum(shares.values()) > MAX_SLOTS:
        raise ValueError(f"shares add up to more than {MAX_SLOTS}")
    return sorted(shares), sum(shares.values())


def schedule(spark: SparkSession, shares: dict[str, int]) -> DataFrame:
    """``(slot, source, nth, release, deadline)`` for each slot of one period, by earliest deadline first.

    Equal deadlines: the later release first (the tighter window), then the
    larger share, then the name.
    """
    names, slots = period(shares)
    a = F.array(*[F.lit(shares[s]) for s in names])
    total = F.lit(slots)
    done = F.array(*[F.lit(0) for _ in names])
    index = F.sequence(F.lit(0), F.lit(len(names) - 1))

    def pick(state: Column, slot: Column) -> Column:
        def order(i: Column) -> Column:
            share, j = F.element_at(a, i + 1), F.element_at(state["done"], i + 1)
            release = F.floor(j * total / share).cast("int")
            deadline = F.ceil((j + 1) * total / share).cast("int")
            return F.struct((release > slot).cast("int").alias("early"), deadline.alias("deadline"), (-release).alias("tight"),
                            (-share).alias("small"), i.alias("i"))
        best = F.array_min(F.transform(index, order))
        return F.struct(
            F.transform(state["done"], lambda n, i: F.when(i == best["i"], n + 1).otherwise(n)).alias("done"),
            F.concat(state["picks"], F.array(F.struct(
                slot.alias("slot"), best["i"].alias("i"), F.element_at(state["done"], best["i"] + 1).alias("nth"),
                (-best["tight"]).alias("release"), best["deadline"].alias("deadline")))).alias("picks"))

    start = F.struct(done.alias("done"), F.array().cast("array<struct<slot:int,i:int,nth:int,release:int,deadline:int>>").alias("picks"))
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, pick, lambda s: s["picks"])
    named = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("p.i") + 1)
    return spark.range(1).select(F.explode(folded).alias("p")).select("p.slot", named.alias("source"), "p.nth", "p.release", "p.deadline")


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds ``_rank`` (from 0) of each row inside its group by the hex text ``_hash``, then ``order``.

    The first digits of the hash cut a group into many runs that are ranked
    apart; a run's offset is the size of the runs before it.  So a group with
    a large share of all rows spans many tasks.  There is a run for about
    every ``RUN`` rows, 256 at least.
    """
    total = rows.count()
    digits = 2
    while 16 ** digits * RUN < total:
        digits += 1
    return _ranked_in_runs(rows.withColumn("_run", F.substring("_hash", 1, digits)), group, [F.col("_hash"), *order])


def _ranked_in_runs(runs: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds ``_rank`` (from 0) of each row inside its group by ``_run``, which is dropped, then ``order``; runs are ranked apart."""
    from pyspark.sql import Window

    sizes = runs.groupBy(group, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_run").orderBy(*order)
    placed = runs.withColumn("_in", F.row_number().over(inside) - 1)
    return (placed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r")))
            .withColumn("_rank", (F.col("_offset") + F.col("_in")).cast("long")).drop("_g", "_r", "_run", "_offset", "_in"))


def segments(counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """One period of ``counts[a]`` sources of each share a as runs of slots ``(share, nth, first, n, slot)``.

    The n sources from place ``first`` on (by name, among those of their
    share) have block ``nth`` in the n slots from ``slot`` on.  The order is
    that of ``schedule``: sources of one share have the same windows, so they
    are served in turn by name, and another share comes first only from a
    release on.  So there are less than two runs for each share and block,
    however many sources there are.
    """
    total = sum(a * n for a, n in counts.items())
    coming = sorted((j * total // a, a, j) for a, n in counts.items() if n for j in range(a))
    ready: list[tuple[int, int, int, int, int]] = []
    out, slot, at = [], 0, 0
    while slot < total:
        while at < len(coming) and coming[at][0] <= slot:
            release, a, j = coming[at]
            heapq.heappush(ready, (-(-(j + 1) * total // a), -release, -a, j, 0))
            at += 1
        deadline, early, small, j, first = heapq.heappop(ready)
        until = coming[at][0] if at < len(coming) else total
        n = min(counts[-small] - first, until - slot)
        out.append((-small, j, first, n, slot))
        if first + n < counts[-small]:
            heapq.heappush(ready, (deadline, early, small, j, first + n))
        slot += n
    return out


def dealt_shares(docs: DataFrame, source_col: str = "source", most: int = 5) -> DataFrame:
    """``source, share, slots, period``: shares from 1 to ``most``, dealt to all sources by name.

    ``slots`` has the slot of each of the source's blocks in one period.  The
    sources stay a table of any size; only their number is collected.
    """
    spark = docs.sparkSession
    names = written(docs.select(F.col(source_col).alias("source")).where("source is not null").distinct(), "mixing-names")
    n = names.count()
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // 16_384)
    counts = {1 + k: len(range(k, n, most)) for k in range(most)}
    runs = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(r, ("share", "nth", "first", "n", "slot"))]) for r in segments(counts)])
    if not n:
        runs = runs.cast("array<struct<share:bigint,nth:bigint,first:bigint,n:bigint,slot:bigint>>")
    numbered = skew_safe_ranked(names, [], ["source"], "_i", parts).withColumn("_i", F.col("_i") - 1)
    numbered = numbered.withColumn("share", (1 + F.col("_i") % most).cast("long")).withColumn("_place", F.floor(F.col("_i") / most))

    def slot(nth: Column) -> Column:
        own = F.filter(runs, lambda r: (r["share"] == F.col("share")) & (r["nth"] == nth)
                       & (r["first"] <= F.col("_place")) & (F.col("_place") < r["first"] + r["n"]))
        return F.get(own, F.lit(0))["slot"] + F.col("_place") - F.get(own, F.lit(0))["first"]

    plan = numbered.select("source", "share", F.transform(F.sequence(F.lit(0).cast("long"), F.col("share") - 1), slot).alias("slots"),
                           F.lit(sum(a * c for a, c in counts.items())).cast("long").alias("period"))
    plan = written(plan, "mixing-shares")
    return F.broadcast(plan) if n <= MAX_SLOTS else plan  # more sources: adaptive execution decides


def mixed(docs: DataFrame, shares: dict[str, int] | DataFrame, id_col: str = "doc_id", source_col: str = "source",
          block_rows: int = 64, carry: list[str] | None = None) -> DataFrame:
    """``id_col, source, nth_row, block, slot`` and the columns ``carry`` for every row of ``docs``.

    ``shares`` are given by name, or for any number of sources as the table
    of ``dealt_shares``.

    ``slot`` is the block's slot in the endless schedule.  While all sources
    have rows, every source is less than one block off its target after each
    slot; the slots of a source that has run out stay empty, and the others
    keep their proportions.  Nothing is dropped or repeated: rows of a null
    source or of one without a share have null block and slot and come last.
    ``(slot, nth_row)`` orders the mix.  Rows of equal id and source get
    neighbouring places, in the order of ``carry``.
    """
    carry = carry or []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), *([F.struct(*carry).alias("_carry")] if carry else []))
    rows = rows.withColumn("_hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    rows = ranked(rows, "src", [F.col("id"), *([F.col("_carry")] if carry else [])])
    return _slotted(rows, shares, id_col, block_rows, carry)


def in_order(docs: DataFrame, shares: dict[str, int] | DataFrame, at: str, id_col: str = "doc_id", source_col: str = "source",
             block_rows: int = 64, carry: list[str] | None = None) -> DataFrame:
    """As ``mixed``, but the rows of a source have the order that they are in by the column ``at``, as ``common.place`` gives it.

    For the rows of ``reordered``, written and read again: the places that
    its mix gave them.
    """
    carry = carry or []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.col(at).alias("_at"), *([F.struct(*carry).alias("_carry")] if carry else []))
    run = F.struct("_at.part", "_at.nth", "_at.file", F.floor(F.col("_at.row") / RUN).alias("rows"))
    return _slotted(_ranked_in_runs(rows.withColumn("_run", run), "src", [F.col("_at.row")]), shares, id_col, block_rows, carry)


def _slotted(rows: DataFrame, shares: dict[str, int] | DataFrame, id_col: str, block_rows: int, carry: list[str]) -> DataFrame:
    """What ``mixed`` returns, for rows ranked in their source ``src``."""
    if isinstance(shares, DataFrame):
        plan = shares.select(F.col("source").alias("_s"), "share", "slots", "period")
        rows = rows.join(plan, F.col("src") == F.col("_s"), "left").withColumn("block", F.when(F.col("share").isNotNull(), F.floor(F.col("_rank") / block_rows)))
        nth = (F.col("block") % F.col("share")).cast("int")
        rows = rows.withColumn("slot", F.floor(F.col("block") / F.col("share")) * F.col("period") + F.get("slots", nth))
    elif shares:
        slots = sum(shares.values())
        plan = F.broadcast(schedule(rows.sparkSession, shares).select(F.col("source").alias("_s"), "slot", "nth"))  # one period
        share = F.create_map(*[F.lit(x) for s, a in sorted(shares.items()) for x in (s, a)])
        rows = rows.withColumn("block", F.when(F.col("src").isin(list(shares)), F.floor(F.col("_rank") / block_rows)))
        a = F.coalesce(F.try_element_at(share, F.col("src")), F.lit(1))
        rows = (rows.withColumn("_nth", (F.col("block") % a).cast("int")).withColumn("_cycle", F.floor(F.col("block") / a))
                .join(plan, (F.col("src") == F.col("_s")) & (F.col("_nth") == F.col("nth")), "left")
                .withColumn("slot", F.col("_cycle") * slots + F.col("slot")))
    else:
        rows = rows.withColumn("block", F.lit(None).cast("long")).withColumn("slot", F.lit(None).cast("long"))
    return rows.select(F.col("id").alias(id_col), F.col("src").alias("source"), F.col("_rank").alias("nth_row"),
                       F.col("block").cast("long"), F.col("slot").cast("long"), *[F.col("_carry")[c].alias(c) for c in carry])


def reordered(docs: DataFrame, shares: dict[str, int] | DataFrame, id_col: str = "doc_id", source_col: str = "source",
              block_rows: int = 64, ties: list[Column] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` in mixing order: a range sort over slots, no row lost.

    Rows of equal id and source lie side by side, in the order of ``ties``;
    null ids as well.
    """
    ties = ties or []
    plan = mixed(docs, shares, id_col, source_col, block_rows).groupBy(
        F.col(id_col).alias("_id"), F.col("source").alias("_src")).agg(F.min("slot").alias("_slot"), F.min("nth_row").alias("_nth"))
    plan = written(plan, "mixing")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.col(source_col).alias("s"),
                       *[t.alias(f"t{k}") for k, t in enumerate(ties)])  # whatever its columns are called
    joined = rows.join(plan, F.col("i").eqNullSafe(F.col("_id")) & F.col("s").eqNullSafe(F.col("_src")), "left")
    return joined.orderBy(F.col("_slot").asc_nulls_last(), F.col("_nth").asc_nulls_last(), *[f"t{k}" for k in range(len(ties))]).select("row.*")
