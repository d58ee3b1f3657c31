"""Trace analytics: spans paired, totalled, overlapped and compared. Spans: (tid, name, start, end)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _levelled(events: DataFrame) -> DataFrame:
    """Begin and end events with ``open``, the spans open after each, and ``depth``, the level of the span that it begins or ends.

    An end without an open span counts for nothing: it leaves the depth at 0 and has the level 0.
    """
    thread = Window.partitionBy("pid", "tid").orderBy("ts", "seq")
    so_far = thread.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("ph") == "B"
    marks = events.where(F.col("ph").isin("B", "E")).withColumn("_run", F.sum(F.when(begins, 1).otherwise(-1)).over(so_far))
    # what the running sum fell below zero, so far, were stray ends
    marks = marks.withColumn("open", F.col("_run") - F.least(F.lit(0), F.min("_run").over(so_far))).drop("_run")
    return marks.withColumn("depth", F.when(begins, F.col("open")).otherwise(F.coalesce(F.lag("open").over(thread), F.lit(0))))


#: Fixed value: the parent of a span that lies in no other.
ROOT = "<root>"


def pair_spans(events: DataFrame) -> DataFrame:
    """(pid, tid, name, parent, depth, start, end) of begin and end events (pid, tid, ts, seq, ph, name): an end closes the innermost open span, whatever its name.

    Depth is a running sum, floored at 0; begin and end pair by (thread, depth, how many at that depth). Unmatched ones go.
    """
    deep = _levelled(events)
    nth = F.row_number().over(Window.partitionBy("pid", "tid", "depth", "ph").orderBy("ts", "seq"))
    numbered = deep.where("depth >= 1").withColumn("nth", nth)
    by = numbered.groupBy("pid", "tid", "depth", "nth").agg(
        F.min(F.when(F.col("ph") == "B", F.col("ts"))).alias("start"),
        F.min(F.when(F.col("ph") == "E", F.col("ts"))).alias("end"),
        F.min(F.when(F.col("ph") == "B", F.col("name"))).alias("name"),
        F.min(F.when(F.col("ph") == "B", F.col("seq"))).alias("seq"),
    )
    # the parent is the last begin one level up: each begin stands at its own level and asks at the one above
    roles = F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("asks")), F.struct((F.col("depth") - 1).alias("level"), F.lit(True).alias("asks")))
    placed = by.where("start is not null").withColumn("role", F.explode(roles)).select("*", "role.*")
    above = Window.partitionBy("pid", "tid", "level").orderBy("start", "seq", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parent = F.last(F.when(~F.col("asks"), F.struct("name")), True).over(above)["name"]
    return placed.withColumn("parent", F.coalesce(parent, F.lit(ROOT))).where("asks and end is not null").select("pid", "tid", "name", "parent", "depth", "start", "end")


def pair_spans_strict(events: DataFrame) -> DataFrame:
    """(pid, tid, name, start, end, anomaly): an end closes the nearest open span of its name; those opened since, and ends without one, are anomalies."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple] = []
        for g in batches:  # sorted, in parts: a long thread isn't one frame
            rows = []
            for ph, name, ts in zip(g["ph"], g["name"], g["ts"], strict=True):
                if ph == "B":
                    stack.append((name, ts))
                    continue
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if at is None:
                    rows.append((*key, name, None, ts, True))
                    continue
                rows += [(*key, n, t, None, True) for n, t in stack[at + 1 :]]
                rows.append((*key, name, stack[at][1], ts, False))
                del stack[at:]
            yield pd.DataFrame(rows, columns=["pid", "tid", "name", "start", "end", "anomaly"])
        yield pd.DataFrame([(*key, n, t, None, True) for n, t in stack], columns=["pid", "tid", "name", "start", "end", "anomaly"])

    def threads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            for k, g in b.groupby(["pid", "tid"], sort=False):
                if key is not None and k != key:
                    yield from pair(key, iter(held))
                    held = []
                key = k
                held.append(g)
        if key is not None:
            yield from pair(key, iter(held))

    marks = events.where(F.col("ph").isin("B", "E")).select("pid", "tid", "ts", "seq", "ph", "name")
    dealt = marks.repartition("pid", "tid").sortWithinPartitions("pid", "tid", "ts", "seq")
    return dealt.mapInPandas(threads, "pid long, tid long, name string, start double, end double, anomaly boolean")


def span_totals(spans: DataFrame, by: str = "name") -> DataFrame:
    """(by, n, total, most)."""
    length = F.col("end") - F.col("start")
    return spans.groupBy(by).agg(F.count("*").alias("n"), F.sum(length).alias("total"), F.max(length).alias("most"))


def is_wait(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^(wait|lock|recv|park|idle)"))


def busy_wait(spans: DataFrame, waits: Column) -> DataFrame:
    """(tid, busy, wait): time in spans that wait and that don't."""
    length = F.col("end") - F.col("start")
    total = lambda c: F.coalesce(F.sum(F.when(c, length)), F.lit(0))
    return spans.groupBy("tid").agg(total(~waits).alias("busy"), total(waits).alias("wait"))


def lock_waits(spans: DataFrame) -> DataFrame:
    """(lock, n, total, most) of the spans named lock.wait, by the lock that their ``args`` (a map) name."""
    waits = spans.where("name = 'lock.wait'").withColumn("lock", F.coalesce(F.col("args")["lock"], F.lit("<unknown>")))
    return span_totals(waits, "lock")


def alloc_sites(instants: DataFrame) -> DataFrame:
    """(site, n, bytes) of the instants named alloc, by the site that their ``args`` (a map) name; without a number of bytes they count as 0."""
    found = instants.where("name = 'alloc'").select(F.coalesce(F.col("args")["site"], F.lit("<unknown>")).alias("site"), F.coalesce(F.expr("try_cast(args['bytes'] as long)"), F.lit(0)).alias("bytes"))
    return found.groupBy("site").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def busy_wait_gap(spans: DataFrame, waits: Column, tolerance: float = 0.02) -> DataFrame:
    """(tid, busy, wait, life, gap, closed): what is left of each thread's life; closed if busy, wait and gap make it up and the gap isn't negative beyond the tolerance."""
    length = F.col("end") - F.col("start")
    total = lambda c: F.coalesce(F.sum(F.when(c, length)), F.lit(0))
    by = spans.groupBy("tid").agg(total(~waits).alias("busy"), total(waits).alias("wait"), (F.max("end") - F.min("start")).alias("life"))
    rest = by.withColumn("gap", F.col("life") - F.col("busy") - F.col("wait"))
    return rest.withColumn("closed", F.col("gap") >= -tolerance * F.col("life"))


def call_tree(spans: DataFrame) -> DataFrame:
    """(parent, name, n, total, self): self time is what the children of a name don't take."""
    length = F.col("end") - F.col("start")
    own = spans.groupBy("parent", "name").agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    kids = spans.where(F.col("parent") != ROOT).groupBy(F.col("parent").alias("name")).agg(F.sum(length).alias("below"))
    all_of = spans.groupBy("name").agg(F.sum(length).alias("of_name"))
    met = own.join(all_of, "name").join(kids, "name", "left")
    share = F.col("total") - F.coalesce("below", F.lit(0)) * F.col("total") / F.greatest("of_name", F.lit(1e-9))
    return met.select("parent", "name", "n", "total", share.alias("self"))


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """(name, other, n, total): how long spans of ``right`` run while those of ``left`` do.

    Times are cut into stretches of ``width``; spans meet where they share one and count in the first that they share, so no
    span meets all others.
    """

    def cut(spans: DataFrame, mark: str) -> DataFrame:
        first, last = F.floor(F.col("start") / width), F.floor(F.col("end") / width)
        return spans.select(F.col("name").alias(f"{mark}_name"), F.col("start").alias(f"{mark}_start"), F.col("end").alias(f"{mark}_end"), F.explode(F.sequence(first, last)).alias("stretch"))

    a, b = cut(left, "a"), cut(right, "b")
    met = a.join(b, "stretch").where("a_start < b_end and b_start < a_end")
    met = met.where(F.col("stretch") == F.floor(F.greatest("a_start", "b_start") / width))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return met.groupBy(F.col("a_name").alias("name"), F.col("b_name").alias("other")).agg(F.count("*").alias("n"), F.sum(shared).alias("total"))


def trace_diff(left: DataFrame, right: DataFrame, top: int = 25) -> DataFrame:
    """(name, left, right, delta): totals of two traces by name, the largest differences first."""
    a, b = (span_totals(s).select("name", F.col("total").alias(n)) for s, n in ((left, "left"), (right, "right")))
    met = a.join(b, "name", "full_outer").na.fill(0, ["left", "right"])
    return met.withColumn("delta", F.col("left") - F.col("right")).orderBy(F.desc(F.abs("delta")), "name").limit(top)


def effective_cores(spans: DataFrame) -> DataFrame:
    """(total, wall, cores)."""
    by = spans.agg(F.sum(F.col("end") - F.col("start")).alias("total"), (F.max("end") - F.min("start")).alias("wall"))
    return by.withColumn("cores", F.round(F.col("total") / F.col("wall"), 6))


def last_wave(spans: DataFrame, workers: int) -> DataFrame:
    """(wave, last_mean, last_most, all_mean, ratio): the last ceil(n / workers) spans by start, against all of them."""
    length = F.col("end") - F.col("start")
    of_all = spans.agg(F.count("*").alias("n"), F.avg(length).alias("all_mean")).head()
    wave = max(1, math.ceil(of_all["n"] / workers))
    last = spans.orderBy(F.desc("start"), F.desc("end")).limit(wave).agg(F.avg(length).alias("last_mean"), F.max(length).alias("last_most"))
    told = last.where("last_mean is not null").select(F.lit(wave).cast("long").alias("wave"), "*", F.lit(of_all["all_mean"]).alias("all_mean"))
    return told.withColumn("ratio", F.when(F.col("all_mean") > 0, F.col("last_mean") / F.col("all_mean")))


def _crossed(rows: DataFrame, group: str, rank: str, bits: int) -> DataFrame:
    """(n): pairs of a group of which the earlier by (end, start) has the larger rank (of so many bits), counted a bit at a time."""
    rank_of = F.col(rank)
    each = rows.select(group, "start", "end", rank_of.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    each = each.select("*", F.call_function("shiftright", F.col("r"), F.col("bit") + 1).alias("prefix"), F.call_function("shiftright", F.col("r"), F.col("bit")).bitwiseAND(F.lit(1)).alias("one"))
    before = Window.partitionBy(group, "bit", "prefix").orderBy("end", "start", "r").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("ahead", F.coalesce(F.sum("one").over(before), F.lit(0))).agg(F.coalesce(F.sum(F.when(F.col("one") == 0, F.col("ahead"))), F.lit(0)).alias("n"))


#: Spans of a stretch of starts or ends, about: what one task sorts. The grid of stretches has ``GRID`` a side at most.
PER_STRETCH, GRID = 1 << 16, 512


def inversions(spans: DataFrame) -> DataFrame:
    """(n, inversions): pairs of spans of all threads that are out of order between start and end: one starts before the other and ends after it.

    Spans are cut into stretches by start and by end. Pairs in other stretches of both are counted on the grid of stretches; pairs
    that share one of them, within it. Equal starts, and equal ends, are no inversion.
    """
    count = spans.count()
    side = min(GRID, max(2, math.ceil(count / PER_STRETCH)))
    at = [i / side for i in range(1, side)]
    cuts = spans.agg(F.percentile_approx("start", at, 10_000).alias("s"), F.percentile_approx("end", at, 10_000).alias("e")).head()
    rows = spans.select("start", "end", _slot(F.col("start"), sorted(set(cuts["s"] or []))).alias("i"), _slot(F.col("end"), sorted(set(cuts["e"] or []))).alias("j"))
    full = spans.sparkSession.range(side * side).select((F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))
    cells = full.join(rows.groupBy("i", "j").agg(F.count("*").alias("c")), ["i", "j"], "left").na.fill(0, ["c"])
    upto = lambda part, order: Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("a", F.coalesce(F.sum("c").over(upto("j", "i")), F.lit(0)))  # spans of earlier starts, same ends
    cells = cells.withColumn("b", F.coalesce(F.sum("a").over(upto("i", F.desc("j"))), F.lit(0)))  # of those, and later ends
    grid = cells.agg(F.coalesce(F.sum(F.col("c") * F.col("b")), F.lit(0)).alias("n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("start", "end")) - 1)
    within = _crossed(ranked, "i", "rank", max(1, count.bit_length()))
    ends = _crossed(rows, "j", "i", max(1, side.bit_length()))
    total = grid.unionByName(within).unionByName(ends).agg(F.sum("n").cast("long").alias("inversions"))
    return total.select(F.lit(count).cast("long").alias("n"), "inversions")


def leaf_time(events: DataFrame) -> DataFrame:
    """(pid, tid, name, total): time charged to the innermost open span, from each event to the next of its thread."""
    thread = Window.partitionBy("pid", "tid").orderBy("ts", "seq")
    timed = _levelled(events).withColumn("elapsed", F.lead("ts").over(thread) - F.col("ts"))
    # the innermost open span is the last begin at the depth reached
    at = Window.partitionBy("pid", "tid", "open").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("ph") == "B", F.col("name")), True).over(at)
    return timed.withColumn("top", top).where("open > 0 and elapsed is not null").groupBy("pid", "tid", F.col("top").alias("name")).agg(F.sum("elapsed").alias("total"))


#: Stretches of values, of about as many distinct ones each, in which running counts are taken.
SLOTS = 256


def _slot(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at or below the value, by halving."""
    if not bounds:
        return F.lit(0)
    m = len(bounds) // 2
    right = _slot(value, bounds[m + 1 :]) + (m + 1)
    return F.when(value < F.lit(bounds[m]), _slot(value, bounds[:m])).otherwise(right)


def log_summary(durations: DataFrame, by: str = "name", value: str = "value") -> DataFrame:
    """(by, n, p50, p95, most): percentiles are elements of the sorted list, by index; nulls are its end.

    Equal values are counted first; running counts go over slots of values and, in the slots that hold an element, over values.
    """
    counted = durations.groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    cuts = counted.select(F.percentile_approx("v", [i / SLOTS for i in range(1, SLOTS)], F.lit(10_000)).alias("cuts")).head()[0]
    v = F.col("v")
    slot = F.when(v.isNull(), F.lit(SLOTS)).otherwise(_slot(v, sorted(set(cuts or []))))
    counted = counted.withColumn("slot", slot)
    group = Window.partitionBy("g")
    sums = counted.groupBy("g", "slot").agg(F.sum("k").alias("held"))
    before = F.coalesce(F.sum("held").over(group.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("g", "slot", "held", before.alias("before"), F.sum("held").over(group).alias("n"))
    n = F.col("n")
    ranks = {"p50": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * F.lit(0.95))), "most": n - 1}
    within = lambda r, start, size: (r >= start) & (r < start + size)
    wanted = F.array(*[F.when(within(r, F.col("before"), F.col("held")), r) for r in ranks.values()])
    slots = sums.select(F.col("g").alias("_g"), F.col("slot").alias("_slot"), "before", "n", wanted.alias("ranks")).where(F.exists("ranks", lambda r: r.isNotNull()))
    met = counted.join(slots, F.col("g").eqNullSafe(F.col("_g")) & (F.col("slot") == F.col("_slot")))
    own = Window.partitionBy("g", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("k").over(own), F.lit(0))
    met = met.withColumn("at", at)
    found = [F.max(F.when(within(F.get("ranks", F.lit(i)), F.col("at"), F.col("k")), v)).alias(name) for i, name in enumerate(ranks)]
    return met.groupBy(F.col("g").alias(by)).agg(F.max("n").alias("n"), *found)
