"""Mixing sources to target weights along a curriculum, in built-in functions alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalgrid.llm.common import broadcast_if_small, stored

BLANK = r"\x20\x09-\x0D"
# Weight of a source over the run, as straight lines between (place in the run, weight). Their
# areas are 5, 2 and 1: heavy sources fade out, light ones come in late.
SCHEDULES = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
BUDGET = 1.5
MOST_REPEATS = 2

Schedule = Sequence[tuple[float, float]]


def word_count(text: str | Column) -> Column:
    """Number of runs without blanks in a whole text; null is empty.

    Each word shrinks to one letter together with the blanks before it, so no list of words is held.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    marks = F.regexp_replace(text, f"[{BLANK}]*+[^{BLANK}]++", "x")
    return F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))).cast("long")


def segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """The lines of a schedule as (start, weight there, slope, area before)."""
    places = [at for at, _ in schedule]
    if len(schedule) < 2 or places[0] != 0 or places[-1] != 1 or any(b <= a for a, b in zip(places, places[1:])):
        raise ValueError("a schedule rises in place from 0 to 1")
    if any(weight < 0 for _, weight in schedule):
        raise ValueError("weights are not negative")
    out, area = [], 0.0
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        out.append((float(a), float(v), (w - v) / (b - a), area))
        area += (b - a) * (v + w) / 2
    if area <= 0:
        raise ValueError("a schedule has some weight")
    return [*out, (1.0, 0.0, 0.0, area)]


def prefix_sums(df: DataFrame, order: list, sums: Mapping[str, Column]) -> DataFrame:
    """Add exclusive running sums over all rows in an order, without bringing the rows to one task.

    Rows are range-partitioned and written; running sums are taken inside a part, and the sums of the
    parts before, one row a part, are added. Ties in the order count in any order.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    offsets = offsets.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    running = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    # As many rows as there are partitions.
    together = running.join(F.broadcast(offsets), "_part")
    return together.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def source_targets(sources: DataFrame, budget: float, most: int, schedules: Sequence[Schedule]) -> DataFrame:
    """Give each source its schedule and its target of words.

    ``sources`` has a row per source: none (whether the name is null), name, source_size. Schedules
    rotate over the sources by code point, null last. The budget, a share of all words, is dealt by
    the schedules' areas; a source stops at ``most`` times its size, and what it leaves is dealt
    again to the others by area. A source ends full exactly if, with all sources of a smaller
    (limit / area) full, its part would still be beyond its limit, so one sorted pass finds the level.
    """
    areas = [segments(s)[-1][3] for s in schedules]
    ranked = prefix_sums(sources, ["none", "name"], {"rank": F.lit(1)})
    which = (F.col("rank") % len(schedules)).cast("int")
    area = F.element_at(F.array(*map(F.lit, areas)), which + 1)
    dealt = stored(ranked.withColumn("schedule", which).withColumn("area", area)
                   .withColumn("limit", F.col("source_size") * most), "sources")
    words, weight = dealt.agg(F.sum("source_size"), F.sum("area")).first()
    total = budget * (words or 0)
    filled = prefix_sums(dealt.withColumn("fills_at", F.col("limit") / F.col("area")), ["fills_at", "none", "name"],
                         {"limits": F.col("limit"), "areas": F.col("area")})
    level = (F.lit(total) - F.col("limits")) / (F.lit(weight or 0.0) - F.col("areas"))
    found = filled.agg(F.max(F.when(level < F.col("fills_at"), level))).first()[0]
    target = F.col("limit").cast("double")
    if found is not None:
        target = F.least(target, F.col("area") * F.lit(found))
    return dealt.select("none", "name", "source_size", "schedule", target.alias("target"))


def place(done: Column, target: Column, schedule: Column, schedules: Sequence[Schedule]) -> Column:
    """The place in the run at which a source's cumulative demand reaches ``done`` words of its target."""
    lines = [segments(s) for s in schedules]
    kinds = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("at", "weight", "slope", "area"), line)])
                                for line in one[:-1]]) for one in lines])
    whole = F.element_at(F.array(*[F.lit(one[-1][3]) for one in lines]), schedule + 1)
    wanted = done / target * whole
    line = F.element_at(F.filter(F.element_at(kinds, schedule + 1), lambda x: x["area"] <= wanted), -1)
    left = wanted - line["area"]
    root = F.sqrt(F.greatest(F.lit(0.0), line["weight"] * line["weight"] + 2.0 * line["slope"] * left))
    return line["at"] + F.when(left > 0, 2.0 * left / (line["weight"] + root)).otherwise(0.0)


def mixed(documents: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, budget: float = BUDGET,
          most: int = MOST_REPEATS, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, copies, and what is carried.

    A source offers its documents in the order of a hash of their ids, ``most`` times over, and gives
    as many words as its target rounds to; the document at that border is taken in part, from its
    beginning. ``copies`` has an entry (copy, words, position) for each time a document is taken;
    the position, from 0 to 1, is where the source's weight schedule, integrated, has asked for all
    words before it. ``training_order`` sorts by it. Columns named in ``carry`` come back in a struct
    ``carried``; other columns are ignored.

    Null text is empty; documents without words are kept with nothing taken. A null source is a source
    of its own, a null doc_id sorts like an empty one. Repeated rows count as documents of their own;
    equal rows may change places. Tables without rows or words give targets of 0.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long"), F.col("source").isNull().alias("none"),
        F.coalesce("source", F.lit("")).alias("name"), word_count("text").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).alias("turn"),
        F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"),
        *([F.struct(*carry).alias("carried")] if carry else []))
    order = ["none", "name", "turn", "size", "tie", "row"]
    offered = stored(prefix_sums(rows, order, {"before": F.col("size")}), "offered")
    sources = offered.groupBy("none", "name").agg(F.sum("size").alias("source_size"), F.min("before").alias("first"))
    sources = stored(sources, "sources")
    targets = source_targets(sources.drop("first"), budget, most, schedules)
    targets = stored(targets.join(sources.select("none", "name", "first"), ["none", "name"]), "targets")
    both = offered.join(broadcast_if_small(targets), ["none", "name"])
    quota = F.floor(F.col("target") + 0.5).cast("long")
    copies = []
    for i in range(most):
        done = F.col("before") - F.col("first") + i * F.col("source_size")
        copies.append(F.struct(
            F.lit(i).alias("copy"),
            F.greatest(F.lit(0), F.least(F.col("size"), quota - done)).cast("long").alias("words"),
            place(done.cast("double"), F.col("target"), F.col("schedule"), schedules).alias("position")))
    # A target of 0 divides nothing: such a source has no copy.
    taken = F.when(F.col("target") > 0, F.filter(F.array(*copies), lambda c: c["words"] > 0)).otherwise(
        F.filter(F.array(F.struct(F.lit(0).alias("copy"), F.lit(0).cast("long").alias("words"),
                                  F.lit(0.0).alias("position"))), lambda c: c["words"] > 0))
    out = both.select("doc_id", F.when(~F.col("none"), F.col("name")).alias("source"), "size", "source_size", "target",
                      taken.alias("copies"), *(["carried"] if carry else []))
    return out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))


def training_order(mix: DataFrame) -> DataFrame:
    """One row per taken copy, range-sorted by position: written files follow the curriculum."""
    rows = mix.select(*[c for c in mix.columns if c not in ("copies", "taken")], F.explode("copies").alias("taken"))
    rows = rows.select(*[c for c in rows.columns if c != "taken"], "taken.*")
    order = ["position", "source", "doc_id", "copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
