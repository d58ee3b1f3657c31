"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Documents are shuffled by a hash of their id and queue in their source. Each is sent once or twice; its virtual
finish time is the source's words sent up to its end divided by the source's target. All are then sorted by finish
time over the whole table, and the mix ends where the running total reaches the budget. Each source is cut at virtual
time 1: the document that reaches its target gives the words sent so far, so that it ends within a word of it. As the
targets add up to the budget at most, the running total cuts nothing beyond that.

* Word counts of a source are summed per (source, slot of the shuffle) first; the running sum within a source adds
  the slots before to a window over one slot, so a source of any size spreads over ``SLOTS`` windows. The same holds
  for the running total over slots of virtual time.
* Targets share ``FACTOR`` times all words by weight, no source above ``REPEATS`` times its words: the excess is
  reshared by weight until none is above (water filling, in closed form over the sources sorted by words / weight).

Results in odd cases: a null text is empty; empty documents have size 0 and give no words. Null sources are one source,
the last. A table without words has targets of 0. Rows that repeat an id are documents of their own, in the order of their
size. An empty table gives no rows. Other columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import cut

FACTOR = 1.5
REPEATS = 2
SLOTS = 4096
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)

WORD = r"[^\x20\x09-\x0D]+"


def _key() -> Column:
    return F.concat_ws(":", F.col("doc_id"), F.xxhash64("source", "text"))


def sized(docs: DataFrame) -> DataFrame:
    """(row, key, doc_id, source, size, place): key tells documents apart but for repeated rows, place is the document's in the shuffle."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        _key().alias("key"),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"),
    )


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target): one row for each source; windows over this table see a row a source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (nth % len(WEIGHTS) + 1).cast("int"))
    budget = F.sum("source_size").over(Window.partitionBy()) * FACTOR
    weighed = sources.withColumn("weight", weight).withColumn("budget", budget).withColumn("most", F.col("source_size") * REPEATS)
    tight = Window.orderBy(F.col("most") / F.col("weight"), "most", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("budget") - before) / weights  # words a weight, were this source the first below its limit
    capped = weighed.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("weight") * F.col("level"))
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy())
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * common["level"])
    return capped.select("source", "source_size", target.alias("target"))


def _running(rows: DataFrame, keys: list[str], slot: Column, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` of the rows before, by ``keys`` and in the order of (slot, order): slots of a key are summed first."""
    rows = rows.withColumn("_slot", slot)
    totals = rows.groupBy(*keys, "_slot").agg(F.sum(value).alias("_total"))
    earlier = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slot").alias("_of"), earlier.alias("_offset"))
    own = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_slot") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
        .join(offsets, same)
        .withColumn(name, F.col("_offset") + F.col("_own"))
        .drop("_slot", "_own", "_offset", "_of", *[f"_{k}" for k in keys])
    )


def packets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, repeat, finish, taken): each sending of each document, in no order."""
    shuffle_slot = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    queued = _running(rows, ["source"], shuffle_slot, ["place", "size", "row"], "size", "start")
    of = targets.select(F.col("source").alias("_source"), "source_size", "target")
    queued = queued.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sent = queued.withColumn("repeat", F.explode(F.array(*map(F.lit, range(REPEATS)))))
    start = F.col("start") + F.col("repeat") * F.col("source_size")
    words = F.least(F.greatest(F.floor("target") - start, F.lit(0)), F.col("size"))
    finish = F.when(F.col("target") > 0, (start + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    sent = sent.withColumn("words", words.cast("long")).withColumn("finish", finish)
    # the whole table by virtual finish time; what lies beyond the budget isn't sent
    # documents that send nothing come after all others, spread over slots of their own: their place doesn't matter
    idle = F.lit(2 * SLOTS + 1) + F.pmod(F.hash("row"), F.lit(SLOTS))
    time_slot = F.when(F.col("words") > 0, F.least(F.floor(F.col("finish") * SLOTS), F.lit(2 * SLOTS)).cast("int")).otherwise(idle)
    sent = sent.withColumn("all", F.lit(0))
    total = _running(sent, ["all"], time_slot, ["finish", "place", "repeat", "size", "row"], "words", "sent")
    budget = targets.agg(F.floor(F.sum("source_size") * FACTOR)).head()[0] or 0
    taken = F.least(F.col("words"), F.greatest(F.lit(int(budget)) - F.col("sent"), F.lit(0)))
    return total.withColumn("taken", taken).drop("all", "words", "sent", "start")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    rows = cut(sized(docs))
    sent = packets(rows, cut(source_targets(rows)))
    return (
        sent.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("taken").alias("taken"))
        .select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, once for each sending, with the text up to the last word taken."""
    rows = cut(sized(docs))
    sent = packets(rows, cut(source_targets(rows))).where("taken > 0")
    sent = cut(sent.groupBy(F.col("key").alias("_key")).agg(F.collect_list("taken").alias("_takens"), F.max("size").alias("_size"), F.countDistinct("row").alias("_rows")))
    named = docs.select(F.struct("*").alias("row"), _key().alias("_key"), "text")
    if sent.where("_rows > 1").head(1):  # rows that repeat an id and text: what is taken of them is given by one
        named = named.dropDuplicates(["_key"])
    out = named.join(sent, "_key").withColumn("_taken", F.explode("_takens"))
    # each word with the white space before it
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), F.col("_taken").cast("int")), "")
    text = F.when(F.col("_taken") < F.col("_size"), first).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget, source_size * 2 AS most FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, most, source ASC NULLS LAST)),
capped AS (SELECT *, most <= weight * level AS capped FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE
    ELSE weight * (SELECT arg_min(level, most / weight) FROM capped WHERE NOT capped) END AS target FROM capped),
queued AS (
  SELECT r.*, t.source_size, t.target, floor(t.target)::BIGINT AS whole,
    (coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY place, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
sent AS (
  SELECT q.*, least(greatest(whole - (start + k * source_size), 0), size) AS words, k,
    CASE WHEN target > 0 THEN (start + k * source_size + size) / target ELSE 0 END AS finish
  FROM queued q, (VALUES (0), (1)) AS r(k)),
total AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, place, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sent)
SELECT doc_id, size, source_size, target,
  sum(least(words, greatest((SELECT floor(sum(source_size) * 1.5) FROM sources) - before, 0)))::BIGINT AS taken
FROM total GROUP BY doc_id, size, source_size, target
"""
