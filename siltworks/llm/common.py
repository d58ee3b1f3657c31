"""What several operators share: cutting lineage, checked broadcasts, linked classes."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a few fixed-width columns up to which a join side is sent to every executor (about 8 MB).
BROADCAST_ROWS = 200_000

#: White space between words, as a regular expression that Java and RE2 read alike.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, read from there from now on.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset,
    as in local tests, a temporary folder is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltworks-checkpoints-"))
    return df.checkpoint(eager=True)


def maybe_broadcast(small: DataFrame, rows: int) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows of fixed-width columns are few, else as it is."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def heavy(total: int) -> int:
    """From how many rows on a key is hot: above it lie ``BROADCAST_ROWS`` keys of ``total`` rows at most."""
    return max(1024, total // BROADCAST_ROWS)


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` (one narrow row a key), hot keys by broadcast, so that their rows aren't moved.

    ``weight`` is the column of ``small`` with the number of ``big``'s rows of the key; these add up to ``total`` at most,
    which bounds the broadcast. ``how`` is inner, left or left_semi. Both sides are evaluated twice.
    """
    most = heavy(total)
    hot = F.broadcast(small.where(F.col(weight) > most))
    by_broadcast = big.join(hot, keys, "left_semi" if how == "left_semi" else "inner")
    return by_broadcast.unionByName(big.join(hot, keys, "left_anti").join(small.where(F.col(weight) <= most), keys, how))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``big`` joined to ``small``, whose rows may be wide: those of a hot key are repeated, so that the key spreads over several tasks.

    ``hot``: (keys, n), the keys with more than ``heavy`` of ``big``'s rows and their number.
    """
    hot = cut(hot)
    most = hot.agg(F.min("n")).head()[0]
    if most is None:
        return big.join(small, keys)
    parts = F.broadcast(hot.select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    many = F.coalesce("_parts", F.lit(1))
    a = big.join(parts, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), many.cast("long")).cast("int")).drop("_parts")
    b = small.join(parts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts")
    return a.join(b, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (id long, root long), root the smallest id reachable.

    Alternating large-star and small-star steps. A step takes the smallest neighbour of each node by an
    aggregate with partial sums and joins it to the edges; that of a node of many neighbours is sent to their
    edges where they lie, so they don't meet in one task. Ids that no edge names have no row. Edges that are
    loops or hold nulls are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    e = cut(e.distinct())
    total = 2 * e.count()  # a step makes no more edges than there were edges and nodes
    for _ in range(rounds):
        # large star: each node hands its larger neighbours to its smallest neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        low = low.select("u", F.least("u", "m").alias("m"), "n")
        e = (
            hot_join(e.select(F.col("b").alias("u"), F.col("a").alias("v")), low, ["u"], "n", total)
            .where("v <> m")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        met = hot_join(e.select(F.col("a").alias("u"), F.col("b").alias("v")), low, ["u"], "n", total)
        e = (
            met.where("v <> m")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        e = cut(e)
        # done once every node has one edge, to a node that has none
        many = e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        roots = e.select(F.col("b").alias("id")).distinct()
        inner = roots.join(e.select(F.col("a").alias("id")), "id", "left_semi")
        if not many.head(1) and not inner.head(1):
            return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
                roots.select("id", F.col("id").alias("root"))
            )
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def hash_sample(rows: DataFrame, by: str, content: list[str], most: int) -> DataFrame:
    """``most`` rows at most for each value of ``by`` (few values), those with the smallest hashes of ``content``; rows of equal content are one.

    Two times as many are expected below a first bound, which follows from an approximate count of the distinct hashes; only these are moved.
    """
    hashed = rows.withColumn("_h", F.xxhash64(F.lit("sample"), *content))
    sizes = hashed.groupBy(by).agg(F.approx_count_distinct("_h").alias("n")).collect()  # a row a value
    share = {r[by]: min(1.0, (2 * most + 100) / max(1, r["n"])) for r in sizes if r[by] is not None}
    if not share:
        return rows.limit(0)
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv]), F.col(by))
    spread = F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    rest = [c for c in rows.columns if c != by]
    once = hashed.where(spread < bound).groupBy(by, "_h").agg(*[F.first(c).alias(c) for c in rest])
    order = Window.partitionBy(by).orderBy(F.pmod("_h", F.lit(1 << 30)), "_h")
    return once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select(*rows.columns)


def crc_mod5(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: 0 is the held-out fifth. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("null"))) % 5
