"""Measurement analytics: benchmark facts grouped, pivoted, guarded and compared. Built-in DataFrame operations only.

``cells``: (corpus_set, file, level, threads, rival, ours, rival_bytes). ``runs``: (config columns, tool, times array<double>,
speed, size). Ties count as wins, percentiles by index are elements of the sorted list, sorts end in a tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OURS = "ours"
#: Thresholds of the guards.
GUARDS = {
    "speed_vs_pigz": 0.95,
    "size_vs_pigz_l9": 1.005,
    "size_vs_pigz": 1.02,
    "speed_vs_igzip_l1_l3": 1.0,
    "decompress_vs_pigz": 1.0,
    "decompress_vs_gzip": 1.0,
    "decompress_vs_rapidgzip": 0.99,
    "decompress_vs_igzip": 0.90,
    "decompress_vs_igzip_multi": 1.0,
    "single_vs_rapidgzip": 0.99,
    "single_vs_pigz": 1.0,
}
ALARM_POINTS = 6.0


def norm_results(documents: DataFrame) -> DataFrame:
    """Result documents (path, level, threads, content_type, results array<struct>) as one row a result, older names coalesced, errors out."""
    r = F.col("r")
    each = documents.withColumn("r", F.explode("results"))
    fields = {f.name for f in documents.schema["results"].dataType.elementType.fields}
    first = lambda *names: F.coalesce(*[r[n] for n in names if n in fields], F.lit(None))
    kind = F.coalesce("content_type", F.when(F.contains("path", F.lit("text")), "text").when(F.contains("path", F.lit("random")), "random").otherwise("unknown"))
    good = F.lit(True) if "error" not in fields else r["error"].isNull()
    return each.where(good).select(
        "path", "level", "threads", kind.alias("data_type"), r["tool"].alias("tool"), first("speed_mbps", "speed").alias("speed"),
        first("output_size", "size").alias("size"), first("median", "time").alias("median"), first("trials").alias("trials"), first("cv").alias("cv"),
    )


def dedup(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, by a fold in ``order``: a later row replaces the kept one if it has more trials, or else a lower cv; nulls count as 0 trials and a cv of 1."""
    rest = [c for c in rows.columns if c not in key]
    sorted_rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("row"))))
    known = lambda r: (F.coalesce(r["trials"], F.lit(0)), F.coalesce(r["cv"], F.lit(1.0)))
    better = lambda kept, new: (known(new)[0] > known(kept)[0]) | (known(new)[1] < known(kept)[1])
    got = rows.groupBy(*key).agg(sorted_rows.alias("s"))
    fold = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0))["row"], lambda k, x: F.when(better(k, x["row"]), x["row"]).otherwise(k))
    return got.select(*key, fold.alias("row")).select(*key, "row.*")


def _stats(times: Column) -> tuple[Column, Column, Column]:
    """(count, mean, sample standard deviation) of an array of doubles; the squares are summed around the running mean (Welford), as SQL's stddev_samp does."""
    n = F.size(times)
    mean = F.aggregate(times, F.lit(0.0), lambda a, x: a + x) / n

    def step(a: Column, x: Column) -> Column:
        moved = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), moved.alias("mean"), (a["squares"] + (x - moved) * (x - a["mean"])).alias("squares"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    squares = F.aggregate(times, start, step, lambda a: a["squares"])
    return n, mean, F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0)


def median(s: Column) -> Column:
    """The middle of a sorted array, or the mean of its two middles."""
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def bench_summary(runs: DataFrame, times: str = "times", size: str = "size") -> DataFrame:
    """``runs`` with trials, the trimmed mean, sd, cv, the median and the speeds: above four trials the fastest and the slowest are out."""
    s = F.array_sort(times)
    trimmed = F.when(F.size(s) > 4, F.slice(s, F.lit(2), F.size(s) - 2)).otherwise(s)
    rows = runs.withColumn("_t", trimmed)
    n, mean, sd = _stats(F.col("_t"))
    rows = rows.withColumns({"trials": F.size(times), "trimmed": n, "mean": mean, "sd": sd, "median": median(F.col("_t"))})
    p10, p90 = F.get("_t", F.floor(n / 10).cast("int")), F.get("_t", F.least(n - 1, F.floor(n * 9 / 10).cast("int")))
    speed = lambda t: F.col(size) / t / 1e6
    return rows.withColumns(
        {"cv": F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(1.0), "mbps": speed(F.col("median")), "p10_mbps": speed(p90), "p90_mbps": speed(p10)}
    ).drop("_t")


def robust_stats(runs: DataFrame, least_trials: int = 3, most_cv: float = 0.1, times: str = "times") -> DataFrame:
    """``runs`` with the median and sd of the times up to twice the median (all of them if that leaves under half), and whether they are stable."""
    s = F.array_sort(times)
    rows = runs.withColumn("_m", median(s)).withColumn("_k", F.filter(s, lambda x: x <= F.col("_m") * 2))
    kept = F.when(F.size("_k") < F.floor(F.size(times) / 2), s).otherwise(F.col("_k"))
    rows = rows.withColumn("_k", kept)
    n, _, sd = _stats(F.col("_k"))
    rows = rows.withColumns({"median": median(F.col("_k")), "sd": sd, "kept": n})
    stable = (F.size(times) >= least_trials) & ((F.col("median") == 0) | (F.col("sd") / F.col("median") <= most_cv))
    return rows.withColumn("stable", stable).drop("_m", "_k")


def pivot_tool(rows: DataFrame, config: Sequence[str], value: str, tools: Sequence[str]) -> DataFrame:
    """A column for each tool; of several rows of a tool the largest value."""
    return rows.groupBy(*config).pivot("tool", list(tools)).agg(F.max(value))


def against(rows: DataFrame, config: Sequence[str]) -> DataFrame:
    """Our row next to each rival's of the same configuration; ``unpigz`` is pigz."""
    tool = F.when(F.col("tool") == "unpigz", "pigz").otherwise(F.col("tool"))
    named = rows.withColumn("tool", tool)
    mine = named.where(F.col("tool") == OURS).select(*config, *[F.col(c).alias(f"our_{c}") for c in ("speed", "size")])
    theirs = named.where(F.col("tool") != OURS).select(*config, F.col("tool").alias("rival"), "speed", "size")
    return mine.join(theirs, list(config))


def guards_compress(rows: DataFrame, config: Sequence[str] = ("data_type", "level", "threads")) -> DataFrame:
    """(config, rival, metric, ratio, threshold, passed): speed and size against pigz, speed against igzip at levels 1 to 3. Rivals at null or 0 are skipped."""
    met = against(rows, config)
    speed, size = F.col("our_speed") / F.col("speed"), F.col("our_size") / F.col("size")
    tight = F.when(F.col("level") >= 9, GUARDS["size_vs_pigz_l9"]).otherwise(GUARDS["size_vs_pigz"])
    row = lambda metric, ratio, threshold, passed: F.struct(F.lit(metric).alias("metric"), ratio.alias("ratio"), threshold.alias("threshold"), passed.alias("passed"))
    low = F.lit(GUARDS["speed_vs_pigz"])
    match = F.lit(GUARDS["speed_vs_igzip_l1_l3"])
    tests = F.array(
        F.when((F.col("rival") == "pigz") & (F.col("speed") > 0), row("speed_vs_pigz", speed, low, speed >= low)),
        F.when((F.col("rival") == "pigz") & (F.col("size") > 0), row("size_vs_pigz", size, tight, size <= tight)),
        F.when((F.col("rival") == "igzip") & F.col("level").between(1, 3) & (F.col("speed") > 0), row("speed_vs_igzip", speed, match, speed >= match)),
    )
    return met.select(*config, "rival", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("t")).select(*config, "rival", "t.*")


def guards_decompress(rows: DataFrame, config: Sequence[str] = ("data_type", "threads"), single_member: bool = False) -> DataFrame:
    """(config, rival, ratio, threshold, passed) of decompression speeds."""
    met = against(rows, config).where("speed > 0")
    rival = F.col("rival")
    if single_member:
        threshold = F.when(rival == "rapidgzip", GUARDS["single_vs_rapidgzip"]).when(rival == "pigz", GUARDS["single_vs_pigz"])
    else:
        igzip = F.when(F.col("threads") > 1, GUARDS["decompress_vs_igzip_multi"]).otherwise(GUARDS["decompress_vs_igzip"])
        threshold = F.when(rival == "igzip", igzip)
        for name in ("pigz", "gzip", "rapidgzip"):
            threshold = threshold.when(rival == name, GUARDS[f"decompress_vs_{name}"])
    told = met.select(*config, "rival", (F.col("our_speed") / F.col("speed")).alias("ratio"), threshold.alias("threshold")).where("threshold is not null")
    return told.withColumn("passed", F.col("ratio") >= F.col("threshold"))


def all_passed(guards: DataFrame) -> DataFrame:
    return guards.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def compare_band(ratio: Column, good: float = 1.0, close: float = 0.95) -> Column:
    """good, close or bad of a higher-is-better ratio; null stays null and 0 is none."""
    return F.when(ratio == 0, "none").when(ratio >= good, "good").when(ratio >= close, "close").when(ratio.isNotNull(), "bad")


def ratio_ledger(rows: DataFrame, config: Sequence[str]) -> DataFrame:
    """(config, rival, ratio, verdict) of our median over the rival's: LOSS above 1.03, WIN below 0.97, else TIE."""
    mine = rows.where(F.col("tool") == OURS).select(*config, F.col("median").alias("ours"))
    theirs = rows.where(F.col("tool") != OURS).select(*config, F.col("tool").alias("rival"), "median")
    ratio = F.when(F.col("median") != 0, F.col("ours") / F.col("median"))
    told = mine.join(theirs, list(config)).select(*config, "rival", ratio.alias("ratio"))
    return told.withColumn("verdict", F.when(F.col("ratio") > 1.03, "LOSS").when(F.col("ratio") < 0.97, "WIN").otherwise("TIE"))


def best_ratio(runs: DataFrame, config: Sequence[str], reference: str) -> DataFrame:
    """(config, tool, ratio, margin, verdict): best time over the reference's best; inside the larger spread it is a TIE."""
    by = runs.select(*config, "tool", F.array_min("times").alias("best"), (F.array_max("times") / F.array_min("times") - 1).alias("spread"))
    ref = by.where(F.col("tool") == reference).select(*config, F.col("best").alias("ref"), F.col("spread").alias("ref_spread"))
    told = by.join(ref, list(config)).select(*config, "tool", (F.col("best") / F.col("ref")).alias("ratio"), F.greatest("spread", "ref_spread").alias("margin"))
    return told.withColumn("verdict", F.when(F.col("ratio") < 1 - F.col("margin"), "WIN").when(F.col("ratio") > 1 + F.col("margin"), "LOSS").otherwise("TIE"))


def won(cells: DataFrame) -> DataFrame:
    return cells.withColumn("win", (F.col("ours") <= F.col("rival_bytes")).cast("int"))


def win_rate(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, wins, rate): percent of cells that we win."""
    counts = won(cells).groupBy(*by).agg(F.count("*").alias("n"), F.sum("win").alias("wins"))
    return counts.withColumn("rate", F.round(100.0 * F.col("wins") / F.col("n"), 6))


WIN_SETS = ((), ("rival",), ("threads",), ("level",), ("rival", "threads"))


def win_rate_sets(cells: DataFrame) -> DataFrame:
    """(rival, threads, level, holdout_n, holdout_rate, board_n, board_rate, delta) overall and by each set, both populations side by side."""
    dims = ["rival", "threads", "level"]

    def of(population: str) -> DataFrame:
        own = won(cells).where(F.col("corpus_set") == population)
        rolled = own.groupingSets([[F.col(c) for c in s] for s in WIN_SETS], *dims).agg(
            F.grouping_id(*dims).alias("gid"), F.count("*").alias(f"{population}_n"), F.round(100.0 * F.sum("win") / F.count("*"), 6).alias(f"{population}_rate")
        )
        return rolled.where(F.col(f"{population}_n") > 0)

    a, b = of("holdout"), of("board").withColumnsRenamed({c: f"_{c}" for c in [*dims, "gid"]})
    same = F.col("gid") == F.col("_gid")
    for c in dims:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = a.join(b, same, "full_outer")
    key = [F.coalesce(c, f"_{c}").alias(c) for c in dims]
    return met.select(*key, "holdout_n", "holdout_rate", "board_n", "board_rate", F.round(F.col("holdout_rate") - F.col("board_rate"), 6).alias("delta"))


def overfit_alarm(cells: DataFrame) -> DataFrame:
    """(holdout_rate, board_rate, delta, alarm): an alarm if the holdout trails by 6 points or more."""
    rate = lambda s: F.round(100.0 * F.sum(F.when(F.col("corpus_set") == s, F.col("win"))) / F.count_if(F.col("corpus_set") == s), 6)
    told = won(cells).agg(rate("holdout").alias("holdout_rate"), rate("board").alias("board_rate"))
    return told.withColumn("delta", F.round(F.col("holdout_rate") - F.col("board_rate"), 6)).withColumn("alarm", F.col("delta") <= -ALARM_POINTS)


def worst_members(cells: DataFrame, population: str = "holdout") -> DataFrame:
    """(file, n, losses, excess, rate, worst_rival, worst_level, worst_threads, worst_ratio): files with the cell that they lose by most."""
    own = won(cells).where(F.col("corpus_set") == population).withColumn("ratio", F.col("ours") / F.col("rival_bytes"))
    lost = F.col("win") == 0
    cell = F.struct("ratio", "rival", "level", "threads")
    by = own.groupBy("file").agg(
        F.count("*").alias("n"),
        F.count_if(lost).alias("losses"),
        F.coalesce(F.sum(F.when(lost, F.col("ours") - F.col("rival_bytes"))), F.lit(0)).alias("excess"),
        F.round(100.0 * F.avg("win"), 6).alias("rate"),
        F.max(F.when(lost, cell)).alias("w"),
    )
    return by.select(
        "file", "n", "losses", "excess", "rate", F.col("w.rival").alias("worst_rival"), F.col("w.level").alias("worst_level"),
        F.col("w.threads").alias("worst_threads"), F.round("w.ratio", 6).alias("worst_ratio"),
    )


def won_ledger(pins: DataFrame, cells: DataFrame) -> DataFrame:
    """The pinned wins (file, level, threads, rival, rival_bytes) that no longer hold: empty is good."""
    return pins.join(cells.select("file", "level", "threads", "rival", "ours"), ["file", "level", "threads", "rival"], "left").where("ours is null or ours > rival_bytes")


def pin_match(current: DataFrame, pinned: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, field, pinned, current): every value that isn't as pinned, rows of one side only included."""
    fields = [c for c in pinned.columns if c not in key]
    long = lambda df, name: df.unpivot(list(key), [F.col(c).cast("string").alias(c) for c in fields], "field", name)
    met = long(pinned, "pinned").join(long(current, "current"), [*key, "field"], "full_outer")
    return met.where(~F.col("pinned").eqNullSafe(F.col("current")))


def ladder(sizes: DataFrame, key: str = "file") -> DataFrame:
    """(key, level, size, before, sags): each level with the one below it; sags where it is larger."""
    w = Window.partitionBy(key).orderBy("level")
    rows = sizes.select(key, "level", "size", F.lag("size").over(w).alias("before"))
    return rows.where("before is not null").withColumn("sags", F.col("size") > F.col("before"))


def noise_bound(size: Column, slack: int = 0) -> Column:
    """The most that incompressible input may grow to: five bytes a stored block, of which an empty input has one too, and the frame."""
    return size + F.greatest(F.ceil(size / 65_535), F.lit(1)) * 5 + 18 + slack


def cliffs(ratios: DataFrame, axes: Sequence[str], jump: float = 0.02, near: float = 0.02) -> DataFrame:
    """(axis, axes..., to, ratio, next_ratio, kind): neighbours along one axis, the others fixed, whose verdict crosses 1 or jumps close to it."""
    found = None
    for axis in axes:
        w = Window.partitionBy(*[a for a in axes if a != axis]).orderBy(axis)
        rows = ratios.select(F.lit(axis).alias("axis"), *axes, F.lead(F.col(axis).cast("string")).over(w).alias("to"), "ratio", F.lead("ratio").over(w).alias("next_ratio"))
        found = rows if found is None else found.unionByName(rows)
    a, b = F.col("ratio"), F.col("next_ratio")
    crosses = (a - 1) * (b - 1) < 0
    jumps = (F.abs(a - b) > jump) & (F.greatest(a, b) > 1 - near)
    kind = F.when(crosses, "CROSS").when(jumps, "NEAR-JUMP")
    return found.where("next_ratio is not null").withColumn("kind", kind).where("kind is not null")


def gap_analysis(rows: DataFrame, config: Sequence[str], top: int = 15) -> DataFrame:
    """(config, rival, gap, side, rank): the largest losses and wins in speed, in percent; 0 is a win, gzip and zopfli don't count."""
    met = against(rows, config).where(~F.col("rival").isin("gzip", "zopfli") & (F.col("speed") > 0))
    gap = F.round((F.col("our_speed") / F.col("speed") - 1) * 100, 6)
    told = met.select(*config, "rival", gap.alias("gap")).withColumn("side", F.when(F.col("gap") < 0, "loss").otherwise("win"))
    order = [F.when(F.col("side") == "loss", F.col("gap")).otherwise(-F.col("gap")), *config, "rival"]
    # the top of each task first, then of those
    few = told.withColumn("_p", F.spark_partition_id()).withColumn("_r", F.row_number().over(Window.partitionBy("side", "_p").orderBy(*order))).where(F.col("_r") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(*order))).where(F.col("rank") <= top).drop("_p", "_r")


def run_compare(before: DataFrame, after: DataFrame, key: Sequence[str], cut: float = 3.0, flag: float = 10.0) -> DataFrame:
    """(key, change, class): percent change in speed between two runs; regression, improvement or neutral, and whether it is large."""
    met = before.select(*key, F.col("speed").alias("was")).join(after.select(*key, F.col("speed").alias("now")), list(key)).where("was > 0")
    change = F.round((F.col("now") / F.col("was") - 1) * 100, 6)
    told = met.select(*key, change.alias("change"))
    kind = F.when(F.col("change") < -cut, "regression").when(F.col("change") > cut, "improvement").otherwise("neutral")
    return told.withColumn("class", kind).withColumn("large", F.abs("change") > flag)


def run_history(scores: DataFrame) -> DataFrame:
    """(run, n, wins, rate, change) of rows (run, gap): share of gaps that aren't negative, and its change from the run before."""
    by = scores.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("gap") >= 0).alias("wins"))
    by = by.withColumn("rate", F.round(100.0 * F.col("wins") / F.col("n"), 6))
    return by.withColumn("change", F.round(F.col("rate") - F.lag("rate").over(Window.orderBy("run")), 6))


def gap_cause(scenario: Column, rival: Column) -> Column:
    """What a loss is put down to, by the words of its scenario and by the rival: the first rule that holds, else a default. Fixed values."""
    has = lambda word: F.contains(scenario, F.lit(word))
    return (
        F.when(has("Tmax") & (rival == "rapidgzip") & ~has("bgzf"), "No parallel single-member decompression. rapidgzip speculatively parallelizes.")
        .when(has("bgzf") & has("T1"), "BGZF T1 overhead from parallel detection. Consider fast-path for T1.")
        .when(has("Tmax") & has("bgzf"), "BGZF Tmax contention or decompressor allocation overhead.")
        .when(has("Tmax") & has("pigz"), "Multi-member parallel not matching rapidgzip's pipelining.")
        .when(has("compress") & (rival == "igzip"), "ISA-L uses hand-tuned SIMD assembly for compression.")
        .when(has("T1") & (rival == "igzip"), "ISA-L inflate uses hand-tuned x86 assembly.")
        .otherwise("Investigate with local profiling.")
    )


def scorecard(scores: DataFrame) -> DataFrame:
    """(wins, losses, percent) of rows with ``verdict``: WIN is a win, all else a loss; whole percents, rounded down."""
    wins = F.count_if(F.col("verdict") == "WIN")
    told = scores.agg(wins.alias("wins"), (F.count("*") - wins).alias("losses"))
    return told.withColumn("percent", F.expr("wins * 100 div nullif(wins + losses, 0)"))


def loss_groups(scores: DataFrame) -> DataFrame:
    """The losses among (scenario, platform, rival, gap, verdict), each with ``group``: the first rule that holds."""
    scenario, packs = F.col("scenario"), ~F.contains("platform", F.lit("decompress"))
    has = lambda word: F.contains(scenario, F.lit(word))
    group = (
        F.when((F.col("rival") == "igzip") & has("L1"), "igzip_l1")
        .when(has("Tmax") & ~packs & F.col("rival").isin("rapidgzip", "unpigz"), "tmax_parallel")
        .when(has("Tmax") & packs, "compress_scaling")
        .when(F.col("gap") > -3.0, "near_parity")
        .otherwise("other")
    )
    return scores.where("verdict <> 'WIN'").withColumn("group", group)


RIVALS = ("pigz", "igzip", "gzip")


def _beside(rows: DataFrame, config: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each configuration with our row: our values, and each rival's as ``rival_value``. Of several rows of a tool the largest value."""
    of = lambda tool, v: F.max(F.when(F.col("tool") == tool, F.col(v)))
    theirs = [of(r, v).alias(f"{r}_{v}") for r in RIVALS for v in values]
    wide = rows.groupBy(*config).agg(F.count_if(F.col("tool") == OURS).alias("_own"), *[of(OURS, v).alias(v) for v in values], *theirs)
    return wide.where("_own > 0").drop("_own")


def summary_compress(rows: DataFrame, config: Sequence[str] = ("data_type", "level", "threads")) -> DataFrame:
    """(config, speed, size, vs_pigz, vs_igzip, vs_gzip): our speed and size, and how many percent faster than each rival; null without it or at 0."""
    wide = _beside(rows, config, ("speed", "size"))
    vs = [F.when(F.col(f"{r}_speed") > 0, F.round((F.col("speed") / F.col(f"{r}_speed") - 1) * 100, 6)).alias(f"vs_{r}") for r in RIVALS]
    return wide.select(*config, "speed", "size", *vs)


def summary_decompress(rows: DataFrame, config: Sequence[str] = ("data_type", "level", "threads")) -> DataFrame:
    """(config, speed, vs_pigz, vs_igzip, vs_gzip, wins, passed): two of three rivals at most 5 percent faster is a pass."""
    told = summary_compress(rows, config).drop("size")
    wins = sum((F.when(F.col(f"vs_{r}") >= -5, 1).otherwise(0) for r in RIVALS), F.lit(0))
    return told.withColumn("wins", wins).withColumn("passed", F.col("wins") >= 2)


def validation_table(rows: DataFrame, config: Sequence[str] = ("data_type", "level", "threads")) -> DataFrame:
    """(config, median, gzip_speedup, pigz_speedup, size_change, slow, large): times against gzip and pigz, sizes against pigz.

    ``slow`` and ``large`` say that the overhead in percent is above what the level allows.
    """
    wide = _beside(rows, config, ("median", "size"))
    level = F.col("level")
    most_time = F.when(level >= 7, 5.0).otherwise(2.0)  # fixed values, as the sizes'
    most_size = F.when(level >= 9, 0.5).when(level >= 7, 2.0).otherwise(8.0)
    both = lambda a, b, c: F.when((F.col(a) != 0) & (F.col(b) != 0), c)
    faster = lambda r: both("median", f"{r}_median", F.round(F.col(f"{r}_median") / F.col("median"), 6))
    slower = both("median", "pigz_median", (F.col("median") / F.col("pigz_median") - 1) * 100)
    grown = both("size", "pigz_size", (F.col("size") / F.col("pigz_size") - 1) * 100)
    return wide.select(
        *config, "median", faster("gzip").alias("gzip_speedup"), faster("pigz").alias("pigz_speedup"), F.round(grown, 6).alias("size_change"),
        (slower > most_time).alias("slow"), (grown > most_size).alias("large"),
    )


def route_check(rows: DataFrame, config: Sequence[str]) -> DataFrame:
    """(config, change, ok): our median time over pigz's in percent; up to 5 percent slower is ok."""
    wide = _beside(rows, config, ("median",)).where("pigz_median > 0")
    change = (F.col("median") / F.col("pigz_median") - 1) * 100
    return wide.select(*config, F.round(change, 6).alias("change"), (change <= 5).alias("ok"))


def _first(rows: DataFrame, keep: Column, order: Sequence[str], name: str) -> Column:
    """The first row by ``order`` that ``keep`` holds for."""
    return F.min_by(F.struct(*[c for c in rows.columns if c not in order], *order), F.when(keep, F.struct(*order))).alias(name)


def _key_rows(rows: DataFrame, order: Sequence[str], fast: int, small: int) -> DataFrame:
    """One row with the first results of both tools at level ``fast`` with threads, and at level ``small``."""
    own, pigz = (F.col("tool") == t for t in (OURS, "pigz"))
    quick, level = (F.col("level") == fast) & (F.col("threads") > 1), F.col("level") == small
    return rows.agg(*[_first(rows, a & b, order, n) for n, a, b in (("f", own, quick), ("fp", pigz, quick), ("s", own, level), ("sp", pigz, level))])


def key_metrics(rows: DataFrame, unpacking: DataFrame, order: Sequence[str], fast: int = 1, small: int = 9) -> DataFrame:
    """(speed_vs_pigz, size_vs_pigz, best_speed, best_source), one row: the first threaded results at level ``fast``, the first
    at level ``small``, in percent; and the fastest of ``unpacking`` (tool, speed, source), the first source of equals. Null where a side is missing or 0."""
    base = _key_rows(rows, order, fast, small)
    best = unpacking.where(F.col("tool") == OURS).agg(F.max(F.struct("speed")).alias("_b"), F.min(F.struct((-F.col("speed")).alias("speed"), "source")).alias("b"))
    percent = lambda a, b: F.when(F.col(b) > 0, F.round((F.col(a) / F.col(b) - 1) * 100, 6))
    told = base.crossJoin(best)  # one row each
    return told.select(
        percent("f.speed", "fp.speed").alias("speed_vs_pigz"), percent("s.size", "sp.size").alias("size_vs_pigz"), F.col("_b.speed").alias("best_speed"), F.col("b.source").alias("best_source")
    )


def goals(rows: DataFrame, unpacking: DataFrame, order: Sequence[str], fast: int = 1, small: int = 9, smallest: int = 11, least_speed: float = 300.0) -> DataFrame:
    """(goal, passed): a row for each goal that there are results for.

    Packing as fast as pigz, within half a percent of its size, no larger than gzip at level ``smallest``, and unpacking our own files at ``least_speed``.
    """
    base = _key_rows(rows, order, fast, small)
    top = F.col("level") == smallest
    most = rows.agg(_first(rows, (F.col("tool") == OURS) & top, order, "t"), _first(rows, (F.col("tool") == "gzip") & top, order, "tg"))
    mine = unpacking.where((F.col("tool") == OURS) & (F.col("source") == OURS)).agg(F.min_by("speed", F.struct(*order)).alias("u"))
    told = base.crossJoin(most).crossJoin(mine)  # one row each
    all_of = {
        "packing speed": F.col("f.speed") >= F.col("fp.speed"),
        "packed size": F.col("s.size") <= F.col("sp.size") * 1.005,
        "smallest size": F.when(F.col("tg.size") > 0, F.col("t.size") <= F.col("tg.size")),
        "unpacking speed": F.col("u") >= least_speed,
    }
    each = F.array(*[F.struct(F.lit(k).alias("goal"), c.alias("passed")) for k, c in all_of.items()])
    return told.select(F.explode(each).alias("g")).select("g.*").where("passed is not null")


def single_member_goals(rows: DataFrame) -> DataFrame:
    """(threads, passed): our single-member speed is 99 percent of rapidgzip's or more; rows (threads, tool, speed, error), those with an error don't count."""
    fine = rows.where("error is null").groupBy("threads").agg(F.max(F.when(F.col("tool") == OURS, F.col("speed"))).alias("a"), F.max(F.when(F.col("tool") == "rapidgzip", F.col("speed"))).alias("b"))
    return fine.where("a is not null and b > 0").select("threads", (F.col("a") / F.col("b") >= 0.99).alias("passed"))


#: The ways in which a probe of the fast parse ends.
OUTCOMES = ("miss", "too_short", "accepted", "deferred")


def reconcile(counters: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, outcomes_left, positions_left): what the sums of counters leave; nothing if they agree.

    Probes against their outcomes, and positions (processed, skipped) against the bytes given out (literals, match_bytes). The
    second holds only where the fast parse alone ran (``attempts`` > 0, no ``other_attempts``) and is null elsewhere.
    """
    pure = (F.col("attempts") > 0) & (F.col("other_attempts") == 0)
    return counters.select(
        *key,
        (F.col("attempts") - sum(map(F.col, OUTCOMES), F.lit(0))).alias("outcomes_left"),
        F.when(pure, F.col("processed") + F.col("skipped") - F.col("literals") - F.col("match_bytes")).alias("positions_left"),
    )


def size_delta(cells: DataFrame) -> DataFrame:
    """(n, bigger, total, worst_pct, worst_file): only a positive percentage can be the worst."""
    pct = 100.0 * (F.col("ours") - F.col("rival_bytes")) / F.col("rival_bytes")
    rows = cells.withColumn("pct", F.round(pct, 6))
    worst = F.max(F.when(F.col("pct") > 0, F.struct("pct", "file", "level", "threads", "rival")))
    s = rows.agg(F.count("*").alias("n"), F.count_if(F.col("pct") > 0).alias("bigger"), F.sum(F.col("ours") - F.col("rival_bytes")).alias("total"), worst.alias("w"))
    return s.select("n", "bigger", "total", F.col("w.pct").alias("worst_pct"), F.col("w.file").alias("worst_file"))


def seam_tax(sizes: DataFrame) -> DataFrame:
    """(file, level, size_t1, size_t4, tax): what four threads cost over one."""
    wide = sizes.where(F.col("threads").isin(1, 4)).groupBy("file", "level").pivot("threads", [1, 4]).agg(F.min("ours"))
    return wide.where("`1` is not null and `4` is not null").select("file", "level", F.col("1").alias("size_t1"), F.col("4").alias("size_t4"), (F.col("4") - F.col("1")).alias("tax"))


def perf_shape(counters: DataFrame, pins: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, holds): the growth from one to four threads isn't above the pinned one, in whole numbers; at 0 for one thread four may not exceed the pin."""
    met = counters.join(pins.select(*key, F.col("t1").alias("pin_t1"), F.col("t4").alias("pin_t4")), list(key))
    cross = F.col("t4").cast("decimal(38,0)") * F.col("pin_t1") <= F.col("t1").cast("decimal(38,0)") * F.col("pin_t4")
    return met.select(*key, F.when(F.col("pin_t1") == 0, F.col("t4") <= F.col("pin_t4")).otherwise(cross).alias("holds"))


def sample_stratified(blocks: DataFrame, per: int = 10) -> DataFrame:
    """``blocks`` (file, block, most_bits): the first ``per`` of each stratum by the longest code: shallow up to 9 bits, deep from 13."""
    stratum = F.when(F.col("most_bits") <= 9, "shallow").when(F.col("most_bits") >= 13, "deep").otherwise("typical")
    w = Window.partitionBy("stratum").orderBy("file", "block")
    return blocks.withColumn("stratum", stratum).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per).drop("n")


def trials(outcomes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n, median, least, most, sd) of rows (key, ok, seconds): a failed trial voids its set."""
    by = outcomes.groupBy(*key).agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n"), F.median("seconds").alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.stddev_samp("seconds").alias("sd"))
    return by.where("ok").drop("ok")


def log_rows(lines: DataFrame) -> DataFrame:
    """(line, job, tool, seconds) of log lines (line, text): the current job is carried on from its last mention."""
    job = F.nullif(F.regexp_extract("text", r"^job: (\S+)", 1), F.lit(""))
    w = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.withColumn("job", F.last(job, True).over(w))
    seconds = F.regexp_extract("text", r"^\s*(\w+)\s+([0-9.]+)\s*s$", 2)
    return named.withColumn("seconds", F.nullif(seconds, F.lit("")).cast("double")).where("seconds is not null").select("log", "line", "job", F.regexp_extract("text", r"^\s*(\w+)", 1).alias("tool"), "seconds")
