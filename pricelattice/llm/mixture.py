"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

*Targets.* Sources by code point (null last) weigh ``weights`` in turn and share all words; a target stops at ``repeats``
times its source, and what is cut off is shared out again by weight. Both follow from one level ``c``: a target is
``least(repeats * words, c * weight)``.

*Copies.* A target of ``k + f`` times its source gives every document ``k`` certain whole copies. The other ``f * words``
are drawn by Pareto order sampling: document ``i`` has inclusion probability ``p_i = f * w_i / mean(w)`` (``w_i`` falls with
the square root of its length, so long documents repeat less), a random number ``U_i`` from a hash of its id, and the rank
``U_i / (1 - U_i) / (p_i / (1 - p_i))``. The lowest ranks are taken until the words are reached. What the first document
that no longer fits leaves open is filled in the same order from the documents that still fit, ``FILLS`` times.

*Scale.* Ranks are cut by prefix sums over rank bins per source (two levels), so no window holds a source: only the rows of
one narrow bin, some millionth of a source, are ordered by one task. Reruns agree: nothing but the id's hash is random.

Defined results: null or empty text has size 0 and takes 0 words; rows with the same id and size draw the same number and are
ordered by nothing else, any of them may be taken; a null id draws like the empty string; an empty table gives an empty
table; further columns of ``docs`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
REPEATS = 3
FILLS = 2
#: A rank becomes one of ``PLACES`` places in its order; bins of places narrow down in these steps to single places.
PLACES = 1 << 48
SHIFTS = (36, 24, 0)


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` from one row per source (``source, source_size``)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", turn.cast("bigint")).withColumn("most", F.col("source_size") * repeats)
    # sources in the order in which a rising level reaches their ceiling: the level is the first that no open source exceeds
    reach = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = reach.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    rows = (rows.withColumn("total", F.sum("source_size").over(whole))
            .withColumn("stopped", F.coalesce(F.sum("most").over(before), F.lit(0)))
            .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
            .withColumn("turn", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.row_number().over(reach)))
            .withColumn("c", F.min_by("level", "turn").over(whole)))
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("c") * F.col("weight")).alias("target"))


def weight() -> Column:
    """A document's weight in the draw: a million by the square root of its length."""
    return F.floor(F.lit(1e6) / F.sqrt(F.col("size") + 1)).cast("bigint")


def unit(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 48 bits of a digest, which any SQL engine repeats."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("bigint")
    return (digest + F.lit(0.5)) / F.lit(float(1 << 48))


def _prefix_cut(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Per source (a key ``sid``, never null) the place before which the sizes of ``rows`` (``sid, size, place``) stay
    within ``room``: ``sid, room, spent, until``; rows with ``place < until`` fit.

    Each level sums the bins of one width, and goes on inside the bin in which the room runs out."""
    state = room.select("sid", "room", F.lit(0.0).alias("spent"), F.lit(0).cast("bigint").alias("until"))
    width = PLACES
    for bits in SHIFTS:
        inside = rows.join(state.select("sid", "until"), "sid").filter((F.col("place") >= F.col("until")) & (F.col("place") < F.col("until") + width))
        bins = inside.groupBy("sid", F.shiftright("place", bits).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        sums = bins.withColumn("upto", upto).join(state, "sid")
        over = F.col("spent") + F.col("upto") > F.col("room")
        edge = sums.groupBy("sid").agg(
            F.min(F.when(over, F.col("bin"))).alias("bin"), F.max(F.when(~over, F.col("upto"))).alias("fits"))
        # with no bin that overflows, all that lies inside fits
        state = stored(state.join(edge, "sid", "left").select(
            "sid", "room", (F.col("spent") + F.coalesce(F.col("fits"), F.lit(0))).alias("spent"),
            F.coalesce(F.shiftleft("bin", bits), F.col("until") + width).alias("until")), "cut")
        width = 1 << bits
    return state


def size() -> Column:
    """Words of a document."""
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")


def sid() -> Column:
    """A key of a source that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: str = "mix", fills: int = FILLS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row of ``docs`` (``doc_id, text, source``)."""
    return decided(docs, weights, repeats, seed, fills).drop("sid")


def decided(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: str = "mix", fills: int = FILLS) -> DataFrame:
    """``mix`` with ``sid``; rows alike in ``sid``, ``doc_id`` and ``size`` have the same place, thus the same copies."""
    rows = stored(docs.select("doc_id", "source", size().alias("size")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * weight()).alias("weighed"))
    goal = targets(sums.select("source", "source_size"), weights, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    name = sid()
    plan = stored(goal.join(sums.select(F.col("source").alias("other"), "weighed"), F.col("source").eqNullSafe(F.col("other"))).select(
        name.alias("sid"), "source_size", "target", whole.alias("certain"), "weighed",
        (F.col("target") - whole * F.col("source_size")).alias("room")), "targets")

    share = F.col("room") / F.col("source_size")
    chance = F.least(F.greatest(share * weight() * F.col("source_size") / F.col("weighed").cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = (rows.withColumn("sid", name).drop("source").join(plan, "sid").withColumn("u", unit(F.col("doc_id"), seed)).withColumn("p", chance)
              .withColumn("rank", odds).withColumn("place", F.floor(F.col("rank") / (1 + F.col("rank")) * float(PLACES - 1)).cast("bigint")))
    sampled = stored(ranked.select("sid", "doc_id", "size", F.coalesce("place", F.lit(0).cast("bigint")).alias("place")), "ranks")

    # the first cut, then what it leaves open: documents behind it that still fit
    steps = []
    room = plan.select("sid", "room")
    left = sampled.filter("size > 0").select("sid", "size", "place")
    for k in range(1 + fills):
        cut = _prefix_cut(left, room).withColumn("room", F.col("room") - F.col("spent"))
        steps.append(cut.select("sid", F.col("until").alias(f"until{k}"), F.col("room").alias(f"room{k}")))
        room = cut.select("sid", "room")
        left = left.join(cut.select("sid", "until", "room"), "sid").filter("place >= until and size <= room").select("sid", "size", "place")
    ends = plan.select("sid", "source_size", "target", "certain")
    for step in steps:
        ends = ends.join(step, "sid")
    ends = stored(ends, "ends")
    extra = F.col("place") < F.col("until0")
    fits = F.lit(True)
    for k in range(fills):
        fits = fits & (F.col("place") >= F.col(f"until{k}")) & (F.col("size") <= F.col(f"room{k}"))
        extra = extra | (fits & (F.col("place") < F.col(f"until{k + 1}")))
    copies = F.when(F.col("size") > 0, F.col("certain") + F.when(extra, 1).otherwise(0)).otherwise(F.col("certain"))
    return sampled.join(ends, "sid").select("sid", "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
