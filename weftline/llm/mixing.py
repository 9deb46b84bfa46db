"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies: its source's target words
over its source's words. The whole part is taken as it is. The fractional parts are rounded by
the pivotal method: two fractions meet, mass goes at random from one to the other until one of
them is 0 or 1, and the other goes on. Mass is counted in words (fraction times size), and the
direction is drawn so that each document's expected mass stays. So the words of a source are kept
at every step, and what a source takes differs from its target by part of one document at most.
Documents that are more than 1/512 of their source (so fewer than 512) go first: each meets the
rest of its source as a whole, which makes up for it; that document is then a small one.

The meetings form a reduction tree. Documents are dealt to small blocks of one source and similar
size; a block folds its members in order of size and sends at most one residual up; 64 residuals
meet in a block of the next level, then the size classes of a source meet, and the last residual
of a source, a small document as a rule, is rounded by itself. Outcomes travel back down by joins
on block keys. No block holds more than a small number of members however large a source is.

Rows alike in id, source and text meet each other first: their mass is as many whole copies as it
makes, and one row is left with a fraction. So they are one member with a count, however many they
are, and are dealt to rows again at the end.

Masses are integers, so no mass is lost to floating point; the random numbers are hashes of the
members, so reruns agree. Sources, too, are numbered and summed by ranges, so there may be many.

Cases: a null text has size 0; null sources are one source, ordered last; ids may be null or
repeat (each row counts as a document of its own); an empty table gives an empty result; other
columns are ignored by `plan_mix`. `apply_mix` knows a row by its id, source and text; rows alike in
all three share out their copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut

UNIT = 1 << 14  #: masses are whole numbers of 1/UNIT words
DRAW = 1 << 17  #: random numbers are 0 to DRAW - 1; words * UNIT * 2 * DRAW stays below 2**63
FAN_IN = 64  #: children of a node of the reduction tree
GIANT = 1 / 512  #: the part of its source from which a document is settled before the others
CLASSES_PER_OCTAVE = 4  #: size classes between a size and its double
ALIKE = 4096  #: rows alike that are made by one row when they are dealt out again
WORD = r"[^\x20\x09-\x0D]+"


def _running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds `place` (from 1) and for each of sums the total of the rows before, over all rows in order.

    Rows are sorted into ranges, each its own task; the ranges' totals, one row for each, are added up.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("part").alias("p"), *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"base_{c}") for c in ("n", *[f"sum_{c}" for c in sums])]
    )
    within = Window.partitionBy("part").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(bases), F.col("part") == F.col("p"))  # one row a range
    out = out.withColumn("place", F.row_number().over(within) + F.col("base_n"))
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"base_sum_{c}"))
    return out.select(*rows.columns, "place", *[f"before_{c}" for c in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Per source: its number `sid`, words, documents and target.

    Sources share all words by weight; a target stops at `cap` times its source's words and the
    excess goes to the others by weight, until none is above. That is the level L at which the
    sum of min(L * weight, cap * words) equals all words, found over the sources in order of
    cap * words / weight. The rows here are sources, not documents.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.sum("alike").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    per = (
        _running(per, [F.col("source").asc_nulls_last()], [])
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumnRenamed("place", "sid")
    )
    ordered = cut(_running(per, [F.col("ratio"), F.col("sid")], ["most", "weight"]))
    total = ordered.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if total["weight"] is None:
        return ordered.select("source", "sid", "source_size", "n_docs", F.col("most").alias("target"))
    level = (F.lit(float(total["words"])) - F.col("before_most")) / (F.lit(total["weight"]) - F.col("before_weight"))
    held = ordered.withColumn("level", level).where(F.col("level") <= F.col("ratio"))
    at = held.agg(F.min(F.struct("ratio", "sid", "level")).alias("at")).first()["at"]
    target = F.col("most") if at is None else F.least(F.lit(at["level"]) * F.col("weight"), F.col("most"))
    return ordered.select("source", "sid", "source_size", "n_docs", target.alias("target"))


def _fold(members: Column, seed: int) -> Column:
    """Pivotal rounding along an array of struct(pos, mass, room, h), where 0 <= mass <= room.

    Returns struct(at, mass, room, h, taken): the member left with a fraction (at -1: none) and the
    members that were filled up to a whole copy.
    """
    zero = F.lit(0).cast("long")

    def state(at: Column, mass: Column, room: Column, h: Column, taken: Column) -> Column:
        return F.struct(
            at.alias("at"), mass.alias("mass"), room.alias("room"), h.alias("h"), taken.alias("taken")
        )

    def meet(acc: Column, x: Column) -> Column:
        to_acc = F.least(acc["room"] - acc["mass"], x["mass"])  # what x could give
        to_x = F.least(x["room"] - x["mass"], acc["mass"])  # what x could get
        draw = F.pmod(F.xxhash64(acc["h"], x["h"], F.lit(seed)), F.lit(DRAW))
        x_gives = draw * (to_acc + to_x) < to_x * F.lit(DRAW)
        acc_mass = F.when(x_gives, acc["mass"] + to_acc).otherwise(acc["mass"] - to_x)
        x_mass = F.when(x_gives, x["mass"] - to_acc).otherwise(x["mass"] + to_x)
        filled = F.filter(
            F.array(F.when(acc_mass == acc["room"], acc["at"]), F.when(x_mass == x["room"], x["pos"])),
            lambda p: p.isNotNull(),
        )
        taken = F.concat(acc["taken"], filled)
        acc_open = (acc_mass > 0) & (acc_mass < acc["room"])
        x_open = (x_mass > 0) & (x_mass < x["room"])
        return (
            F.when(x["mass"] == 0, acc)
            .when(
                x["mass"] == x["room"],
                state(acc["at"], acc["mass"], acc["room"], acc["h"], F.concat(acc["taken"], F.array(x["pos"]))),
            )
            .when(acc["mass"] == 0, state(x["pos"], x["mass"], x["room"], x["h"], acc["taken"]))
            .when(acc_open, state(acc["at"], acc_mass, acc["room"], acc["h"], taken))
            .when(x_open, state(x["pos"], x_mass, x["room"], x["h"], taken))
            .otherwise(state(F.lit(-1), zero, zero, zero, taken))
        )

    return F.aggregate(members, state(F.lit(-1), zero, zero, zero, F.array().cast("array<int>")), meet)


def _block(rows: DataFrame, keys: list[str], carry: list[str], seed: int) -> DataFrame:
    """One row a block: its members in order and how their fractions folded."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("room")).alias("first"), "h", "mass", "room", *carry)))
    numbered = F.transform(
        "members",
        lambda m, i: F.struct(
            i.alias("pos"), m["mass"].alias("mass"), m["room"].alias("room"), m["h"].alias("h")
        ),
    )
    return (
        rows.groupBy(*keys)
        .agg(listed.alias("members"))
        .withColumn("end", _fold(numbered, seed))
    )


def _settle(blocks: DataFrame, keys: list[str], outcome: DataFrame | None, carry: list[str], seed: int) -> DataFrame:
    """Each member of each block with `got`, 0 or 1.

    outcome: what became of the blocks' residuals (keys, got); None at the root, where a residual
    is rounded by itself.
    """
    if outcome is None:
        left = (F.pmod(F.xxhash64("end.h", F.lit(seed), F.lit("root")), F.lit(DRAW)) * F.col("end.room") < F.col("end.mass") * DRAW).cast("int")
        blocks = blocks.withColumn("left_got", left)
    else:
        outcome = outcome.select(*keys, "got")
        blocks = blocks.join(outcome.withColumnRenamed("got", "left_got"), keys, "left")
    got = F.when(F.col("pos") == F.col("end.at"), F.coalesce("left_got", F.lit(0))).otherwise(
        F.array_contains("end.taken", F.col("pos")).cast("int")
    )
    return blocks.select(*keys, "end", "left_got", F.posexplode("members").alias("pos", "m")).select(
        *[k for k in keys if k not in carry], *[F.col(f"m.{c}").alias(c) for c in carry], got.alias("got")
    )


def _settle_giants(giants: DataFrame, carry: list[str], seed: int) -> DataFrame:
    """Documents that are a large part of their source, one after the other, the largest first.

    Such a document meets all the rest of its source at once, which takes or gives the mass in
    proportion; so the smaller documents make up for the larger ones. giants: sid, pool_mass and
    pool_room (of the whole source), room, h and the columns to carry; at most 1 / GIANT rows a
    source. One row a source: its giants, those taken, and the mass and room of the rest.
    """
    zero = F.lit(0).cast("long")

    def meet(acc: Column, x: Column) -> Column:
        own = F.when(acc["room"] > 0, F.floor(x["room"] * (acc["mass"] / acc["room"]))).otherwise(zero)
        own = F.least(own.cast("long"), x["room"], acc["mass"])
        rest_mass, rest_room = acc["mass"] - own, acc["room"] - x["room"]
        # rounding may leave the rest a little more mass than it has room for
        over = F.greatest(zero, rest_mass - rest_room)
        own, rest_mass = own + over, rest_mass - over
        up = F.least(x["room"] - own, rest_mass)
        down = F.least(rest_room - rest_mass, own)
        r = F.pmod(F.xxhash64(x["h"], F.lit(seed), F.lit("giant")), F.lit(DRAW))
        gets = r * (up + down) < down * F.lit(DRAW)
        mass = F.when(gets, own + up).otherwise(own - down)
        # if the rest ran out first, the document is rounded by itself
        alone = F.pmod(F.xxhash64(x["h"], F.lit(seed), F.lit("alone")), F.lit(DRAW)) * x["room"] < mass * F.lit(DRAW)
        return F.struct(
            F.when(gets, rest_mass - up).otherwise(rest_mass + down).alias("mass"),
            rest_room.alias("room"),
            F.concat(acc["taken"], F.array(alone.cast("int"))).alias("taken"),
        )

    members = F.array_sort(F.collect_list(F.struct((-F.col("room")).alias("first"), "h", "room", *carry)))
    start = F.struct(
        F.col("pool_mass").alias("mass"), F.col("pool_room").alias("room"), F.array().cast("array<int>").alias("taken")
    )
    return (
        giants.groupBy("sid", "pool_mass", "pool_room")
        .agg(members.alias("members"))
        .withColumn("end", F.aggregate("members", start, meet))
    )


def _row_key(doc_id: Column, source: Column, text_hash: Column) -> Column:
    """What rows alike in id, source and text have in common; nulls are left out of the text."""
    return F.to_json(F.struct(doc_id.cast("string").alias("id"), source.cast("string").alias("source"), text_hash.alias("text")))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 0,
) -> DataFrame:
    """One row a document: doc_id, source, size, text_hash, source_size, target, copies."""
    return _dealt_out(_rounded(docs, id_col, text_col, source_col, weights, cap, seed))


def _known(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What a row is known by, with the number of rows alike."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("alike"))


def _dealt_out(groups: DataFrame) -> DataFrame:
    """Rows alike as rows again: `more` of them have a copy more than `whole`. Many of them are made in many tasks."""
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(alike - 1) div {ALIKE}"))))
    if (groups.agg(F.max("alike")).first()[0] or 0) > ALIKE:
        parts = parts.repartition("doc_id", "text_hash", "part")
    last = F.least(F.lit(ALIKE).cast("long"), F.col("alike") - F.col("part") * ALIKE)
    rows = parts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    extra = (F.col("part") * ALIKE + F.col("k") <= F.col("more")).cast("int")
    return rows.select("doc_id", "source", "size", "text_hash", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def _rounded(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: float, seed: int
) -> DataFrame:
    """One row for documents alike: `alike` of them, of which `more` are taken once more than `whole`."""
    sized = cut(_known(docs, id_col, text_col, source_col).withColumn("h", F.xxhash64("doc_id", "size", "source", "text_hash", F.lit(seed))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))))
    targets = cut(
        source_targets(sized, weights, cap)
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("whole", F.floor("rate"))
        .withColumn("pool_room", F.col("source_size") * UNIT)
        .withColumn("pool_mass", F.round((F.col("rate") - F.col("whole")) * F.col("pool_room")).cast("long"))
        .withColumnRenamed("source", "source_")
    )
    known = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("source_")))
        .withColumn("room", F.col("size") * UNIT)
        .withColumn("cls", F.floor(F.log2(F.col("size") + 1) * CLASSES_PER_OCTAVE).cast("int"))
        .withColumn("giant", (F.col("size") > 0) & (F.col("size") >= F.col("source_size") * GIANT))
    )
    names = ["size", "doc_id", "source", "source_size", "target", "whole", "text_hash"]
    carry = [*names, "alike", "sure"]
    # fewer than 1 / GIANT of them are alike
    single = known.where("giant").withColumn("k", F.explode(F.expr("sequence(1L, alike)")))
    single = single.withColumn("h", F.when(F.col("k") > 1, F.xxhash64("h", "k")).otherwise(F.col("h")))
    giants = cut(_settle_giants(single, names, seed))
    settled = giants.select(F.posexplode("members").alias("pos", "m"), "end").select(
        *[f"m.{c}" for c in names],
        F.lit(1).cast("long").alias("alike"),
        F.get("end.taken", F.col("pos")).cast("long").alias("more"),
    )
    rests = giants.select("sid", F.col("end.mass").alias("rest_mass"), F.col("end.room").alias("rest_room"))
    share = F.coalesce(
        F.try_divide("rest_mass", "rest_room"), F.try_divide("pool_mass", "pool_room"), F.lit(0.0)
    )
    small = (
        known.where("not giant")
        .join(rests, "sid", "left")
        .withColumn("mass", F.least(F.round(F.col("room") * share).cast("long"), F.col("room")) * F.col("alike"))
        # rows alike: as many whole copies as their mass makes, and one fraction
        .withColumn("sure", F.coalesce(F.expr("mass div nullif(room, 0)"), F.lit(0)))
        .withColumn("mass", F.col("mass") - F.col("sure") * F.col("room"))
    )
    classes = cut(
        known.where("not giant")
        .groupBy("sid", "cls")
        .agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(FAN_IN * 0.75)))).cast("int").alias("bits"))
    )
    deepest = classes.agg(F.max("bits")).first()[0] or 0
    leaves = small.join(classes, ["sid", "cls"]).withColumn(
        "sub", F.expr("shiftrightunsigned(h, 1) & (shiftleft(1L, bits) - 1)")
    )
    keys = ["sid", "cls", "sub"]
    end = [F.col(f"end.{c}").alias(c) for c in ("mass", "room", "h")]
    blocks = [(cut(_block(leaves, keys, carry, seed)), keys, carry)]
    for level in range(1, math.ceil(deepest / 6) + 1):
        kids = blocks[-1][0].where("end.at >= 0").select(*keys, F.col("sub").alias("child"), *end)
        kids = kids.withColumn("sub", F.shiftright("sub", 6))
        blocks.append((cut(_block(kids, keys, ["child"], seed + level)), keys, ["child"]))
    kids = blocks[-1][0].where("end.at >= 0").select(*keys, *end)
    outcome = _settle(_block(kids, ["sid"], ["cls", "sub"], seed - 1), ["sid"], None, ["cls", "sub"], seed)
    for rows, own, carried in reversed(blocks[1:]):
        # what happened to the children of this level, keyed as the level below keys its blocks
        outcome = _settle(rows, own, outcome, carried, seed).drop("sub").withColumnRenamed("child", "sub")
    rows, own, carried = blocks[0]
    out = _settle(rows, own, outcome, carried, seed)
    out = out.select(*names, "alike", (F.col("sure") + F.col("got")).alias("more"))
    return cut(out.unionByName(settled))


def apply_mix(
    docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents, each as often as the plan takes it, with their own columns.

    Rows alike in id, source and text share out the copies planned for them, as evenly as whole
    copies allow. They are numbered by the partition they lie in, so a group that is a large part of
    the table is many tasks.
    """
    key = _row_key(F.col(id_col), F.col(source_col), F.xxhash64(text_col))
    tagged = cut(
        docs.withColumn("_mix_key", key)
        .withColumn("_mix_row", F.monotonically_increasing_id())
        .withColumn("_mix_part", F.spark_partition_id())
    )
    slim = tagged.select("_mix_key", "_mix_part", "_mix_row")
    planned = plan.groupBy(_row_key(F.col("doc_id"), F.col("source"), F.col("text_hash")).alias("_mix_key")).agg(
        F.sum("copies").alias("_mix_sum"), F.count("*").alias("_mix_rows")
    )
    below = Window.partitionBy("_mix_key").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        slim.groupBy("_mix_key", "_mix_part")
        .count()
        .withColumn("_mix_base", F.coalesce(F.sum("count").over(below), F.lit(0)))
        .join(planned.where("_mix_sum > 0"), "_mix_key")
        .drop("count")
    )
    within = Window.partitionBy("_mix_key", "_mix_part").orderBy("_mix_row")
    copies = (
        slim.withColumn("_mix_k", F.row_number().over(within) - 1)
        .join(bases, ["_mix_key", "_mix_part"])
        .selectExpr(
            "_mix_row",
            "_mix_sum div _mix_rows + if(_mix_base + _mix_k < _mix_sum % _mix_rows, 1, 0) AS _mix_n",
        )
    )
    return (
        tagged.join(copies.where("_mix_n > 0"), "_mix_row")
        .withColumn("_mix_i", F.explode(F.sequence(F.lit(1), F.col("_mix_n").cast("int"))))
        .select(*docs.columns)
    )
