"""The facts that the queries work on, made from the driver's tables, each with the same in SQL.

The star schema stands in for benchmark facts and the event table for a trace; this is a reading of synthetic data, said here once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RIVALS = ("gzip", "pigz", "igzip", "libdeflate")
TOOLS = ("ours", "pigz", "igzip", "gzip", "rapidgzip")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(names: tuple[str, ...], n: str) -> object:
    return F.element_at(F.array(*map(F.lit, names)), (F.col(n) % len(names) + 1).cast("int"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_set, file, level, threads, rival, ours, rival_bytes): sizes of files by level and threads, ours and a rival's."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    threads = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 4).otherwise(14)
    return items.groupBy(
        F.when(F.col("l_linestatus") == "O", "holdout").otherwise("board").alias("corpus_set"),
        F.col("p_brand").alias("file"),
        F.col("l_linenumber").alias("level"),
        threads.alias("threads"),
        _one_of(RIVALS, "l_suppkey").alias("rival"),
    ).agg(F.sum(F.col("l_quantity").cast("long")).alias("ours"), F.sum(1 + F.col("l_partkey") % 50).alias("rival_bytes"))


CELLS = """cells AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'holdout' ELSE 'board' END AS corpus_set, p_brand AS file, l_linenumber AS level,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE 14 END AS threads,
    ['gzip', 'pigz', 'igzip', 'libdeflate'][(l_suppkey % 4 + 1)::INT] AS rival,
    sum(l_quantity::BIGINT)::BIGINT AS ours, sum(1 + l_partkey % 50)::BIGINT AS rival_bytes
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
won AS (SELECT *, (ours <= rival_bytes)::INT AS win FROM cells)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(data_type, level, threads, tool, speed, size, median): one benchmark result a tool and configuration."""
    return read(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("data_type"), F.col("l_linenumber").alias("level"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("threads"), _one_of(TOOLS, "l_partkey").alias("tool")
    ).agg(F.max("l_extendedprice").alias("speed"), F.sum(F.col("l_quantity").cast("long")).alias("size"), F.min("l_extendedprice").alias("median"))


RESULTS = """results AS (
  SELECT l_returnflag AS data_type, l_linenumber AS level, (l_suppkey % 3 + 1)::INT AS threads,
    ['ours', 'pigz', 'igzip', 'gzip', 'rapidgzip'][(l_partkey % 5 + 1)::INT] AS tool,
    max(l_extendedprice) AS speed, sum(l_quantity::BIGINT)::BIGINT AS size, min(l_extendedprice) AS median
  FROM lineitem GROUP BY ALL),
against AS (
  SELECT a.data_type, a.level, a.threads, b.tool AS rival, a.speed AS our_speed, a.size AS our_size, a.median AS our_median, b.speed, b.size, b.median
  FROM results a JOIN results b USING (data_type, level, threads) WHERE a.tool = 'ours' AND b.tool <> 'ours')"""


def timed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, size, times): the trials of a run."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(
        (F.col("run") * 1000).alias("size"), F.collect_list("l_quantity").alias("times")
    )


RUNS = "runs AS (SELECT l_orderkey AS run, l_orderkey * 1000 AS size, list_sort(list(l_quantity)) AS s FROM lineitem GROUP BY ALL)"


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(data_type, level, tool, times)."""
    i = read(spark, sf_dir, "lineitem")
    return i.groupBy(F.col("l_returnflag").alias("data_type"), F.col("l_linenumber").alias("level"), _one_of(TOOLS, "l_partkey").alias("tool")).agg(F.collect_list("l_extendedprice").alias("times"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, platform, rival, gap, verdict): our speed against each rival's, by configuration."""
    r = read(spark, sf_dir, "lineitem")
    threads = F.element_at(F.array(*map(F.lit, ("T1", "T4", "Tmax"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    kind = F.when(F.col("l_returnflag") == "A", "bgzf").when(F.col("l_returnflag") == "N", "compress").otherwise("pigz")
    scenario = F.concat_ws("-", kind, F.concat(F.lit("L"), F.col("l_linenumber").cast("string")), threads)
    platform = F.when(F.col("l_returnflag") == "N", "compress-arm").otherwise("decompress-x86")
    by = r.groupBy(scenario.alias("scenario"), platform.alias("platform"), _one_of(TOOLS, "l_partkey").alias("tool")).agg(F.max("l_extendedprice").alias("speed"))
    mine, theirs = by.where("tool = 'ours'"), by.where("tool <> 'ours'").withColumnsRenamed({"tool": "rival", "speed": "other"})
    gap = F.round((F.col("speed") / F.col("other") - 1) * 100, 6)
    met = mine.drop("tool").join(theirs, ["scenario", "platform"]).select("scenario", "platform", "rival", gap.alias("gap"))
    return met.withColumn("verdict", F.when(F.col("gap") >= 0, "WIN").otherwise("LOSS"))


SCORES = """facts AS (
  SELECT concat_ws('-', CASE l_returnflag WHEN 'A' THEN 'bgzf' WHEN 'N' THEN 'compress' ELSE 'pigz' END, 'L' || l_linenumber, ['T1', 'T4', 'Tmax'][(l_suppkey % 3 + 1)::INT]) AS scenario,
    CASE l_returnflag WHEN 'N' THEN 'compress-arm' ELSE 'decompress-x86' END AS platform, ['ours', 'pigz', 'igzip', 'gzip', 'rapidgzip'][(l_partkey % 5 + 1)::INT] AS tool, max(l_extendedprice) AS speed
  FROM lineitem GROUP BY ALL),
gaps AS (SELECT a.scenario, a.platform, b.tool AS rival, round((a.speed / b.speed - 1) * 100, 6) AS gap FROM facts a JOIN facts b USING (scenario, platform) WHERE a.tool = 'ours' AND b.tool <> 'ours'),
scores AS (SELECT *, CASE WHEN gap >= 0 THEN 'WIN' ELSE 'LOSS' END AS verdict FROM gaps)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, tid, ts, seq, ph, name): begin and end events of a trace; of each user's events those with an odd number are ends."""
    e = read(spark, sf_dir, "events")
    ph = F.when(F.col("event_id") % 2 == 0, "B").otherwise("E")
    return e.select(F.lit(0).cast("long").alias("pid"), F.col("user_id").alias("tid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), ph.alias("ph"), F.col("event_type").alias("name"))


MARKS = """marks AS (
  SELECT user_id AS tid, epoch_us(ts) AS ts, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'E' END AS ph, event_type AS name,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
summed AS (SELECT *, sum(CASE ph WHEN 'B' THEN 1 ELSE -1 END) OVER (PARTITION BY tid ORDER BY nth ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marks),
floored AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY tid ORDER BY nth ROWS UNBOUNDED PRECEDING)) AS still FROM summed),
begun AS (SELECT tid, nth, still AS depth, ts, name FROM floored WHERE ph = 'B'),
ended AS (SELECT *, coalesce(lag(still) OVER (PARTITION BY tid ORDER BY nth), 0) AS depth, lead(ts) OVER (PARTITION BY tid ORDER BY nth) AS next FROM floored),
paired AS (
  SELECT e.tid, b.name, coalesce(p.name, '<root>') AS parent, e.depth::BIGINT AS depth, b.ts AS start, e.ts AS "end"
  FROM (SELECT * FROM ended WHERE ph = 'E' AND depth > 0) e ASOF JOIN begun b ON e.tid = b.tid AND e.depth = b.depth AND e.nth >= b.nth
    ASOF LEFT JOIN begun p ON e.tid = p.tid AND e.depth - 1 = p.depth AND e.nth >= p.nth)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, name, start, end) in microseconds: an event lasts its value in minutes."""
    e = read(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("tid"), F.col("event_type").alias("name"), start.alias("start"), (start + F.round(F.col("value") * 6e7).cast("long")).alias("end"))


SPANS = """spans AS (
  SELECT user_id AS tid, event_type AS name, epoch_us(ts) AS start, epoch_us(ts) + round(value * 6e7)::BIGINT AS "end" FROM events)"""
