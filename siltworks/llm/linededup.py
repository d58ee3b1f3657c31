"""Line dedup: a deletion-neighbourhood join over words, keeping the earliest line. DataFrame operations only.

The unit of an edit is a word (a run of anything but ASCII white space, lower-cased). The bound grows with the line: a
line goes if an earlier line, by document id and line number, has the same words or, where the longer of the two has
``near_words`` words or more, is within one edit of it: one word more, less or other (a similarity of 0.8 or more from
five words on). That the earlier line goes as well makes no difference. Blank lines stay.

* Equal lines meet by a 128-bit hash in an aggregate with partial results, so a hot line costs a row a task.
* Two lines within one edit share their first or their last half. Only lines that share a half with another
  distinct line emit their neighbourhood, as far as it lies outside the shared half: a hash for each deletion, by exclusive or of position-bound word hashes.
* Equal variants are joined to the earliest line that has them, never to each other, and the words of both
  lines are compared before a line goes. Rows of a hot half or variant aren't moved for these joins (``hot_join``), and
  an early line that very many others are near to is repeated for them (``salted_join``).

Results in odd cases: a null text stays null and an empty one empty. Documents stay even if no line of theirs does.
Rows that repeat an id and text are one document, each row with the same result; null ids come first. An empty
table gives no rows. Other columns are kept by ``dedup`` and not read, whatever their names; those called ``_n_lines`` and
``_n_kept`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import cut, heavy, hot_join, maybe_broadcast, salted_join

NEAR_WORDS = 5
#: Words of a line whose hashes are combined in one go; longer lines take as many goes as they need.
STRETCH = 512


def words_of(line: Column) -> Column:
    spaced = F.lower(line)
    for c in "\t\n\v\f\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _half(words: Column, n: Column, head: bool) -> Column:
    """A hash of the first or last n words, odd for the first."""
    part = F.slice(words, F.lit(1), n) if head else F.slice(words, F.size(words) - n + 1, n)
    h = F.xxhash64(F.lit("head" if head else "tail"), n, part)
    return h.bitwiseOR(F.lit(1)) if head else h.bitwiseAND(F.lit(-2))


def _reach(n: Column) -> Column:
    """The words in a half of a line of n: half of them, less up to three in long lines, so that most lines of n and n - 1 words have the same."""
    half = F.shiftright(n, 1)
    return F.when(half < 8, half).otherwise(half.bitwiseAND(F.lit(-4)))


def _before(xs: Column) -> Column:
    """(total, out) of an array: the exclusive or of it all, and before each element that of those ahead."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, x: F.struct(acc["total"].bitwiseXOR(x).alias("total"), F.array_append(acc["out"], acc["total"]).alias("out"))
    return F.aggregate(xs, zero, step)


def running_xor(xs: Column) -> Column:
    """Before each element of an array of longs the exclusive or of those ahead, by stretches, so that long arrays aren't copied at every step."""
    starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int"))
    parts = F.transform(starts, lambda k: _before(F.slice(xs, k * STRETCH + 1, STRETCH)))
    ahead = _before(F.transform(parts, lambda p: p["total"]))["out"]
    whole = F.flatten(F.zip_with(parts, ahead, lambda p, a: F.transform(p["out"], lambda x: x.bitwiseXOR(a))))
    return F.when(F.size(xs) <= STRETCH, _before(xs)["out"]).otherwise(whole)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def _numbered(keyed: DataFrame) -> DataFrame:
    """(doc_id, h, line_no, words) of every line that isn't blank."""
    lines = keyed.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return _fixed(lines, words=words_of(F.col("line"))).drop("line").where(F.size("words") > 0)


def first_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """One row for each distinct line: first (doc_id, h, line_no) and, if it may be near another, its halves."""
    n, w = F.size("words"), F.col("words")
    both = lambda reach: [_half(w, reach, True), _half(w, reach, False)]
    own, less = _reach(n), _reach(n - 1)
    # a line of one word less than near_words counts only as the shorter one of two
    halves = F.when((n >= near_words) & (own != less), F.array(*both(own), *both(less))).when(n >= near_words - 1, F.array(*both(own)))
    return (
        _numbered(_keyed(docs))
        .select(
            F.xxhash64(w).alias("k1"),
            F.xxhash64(F.lit("second"), w).alias("k2"),
            F.struct("doc_id", "h", "line_no").alias("at"),
            halves.alias("halves"),
        )
        .groupBy("k1", "k2")
        .agg(F.min("at").alias("first"), F.first("halves").alias("halves"))
        .select("first", "halves")
    )


def active_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(first, n, words, whole, all_moved, parts) of the distinct lines that share a half with another one.

    ``whole`` is the hash of all words; ``parts`` has (i, part), and ``all_moved`` xor ``part`` is the hash without word i.
    """
    halves = firsts.where("halves is not null").select("first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    met = hot_join(halves, shared, ["half"], "n", 4 * firsts.count(), "left_semi")
    # an edit beyond a shared head is in the rest of the line, one before a shared tail likewise
    head = F.col("half").bitwiseAND(F.lit(1)) == 1
    active = cut(met.groupBy("first").agg(F.bool_or(head).alias("head"), F.bool_or(~head).alias("tail")))
    # the words of these lines
    each = _keyed(docs).select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.rlike("line", F.lit(r"[^\x20\x09-\x0D]")))
    lines = each.select(F.struct("doc_id", "h", "line_no").alias("first"), "line").join(maybe_broadcast(active, active.count()), "first")
    if _keyed(docs).groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").head(1):
        lines = lines.groupBy("first").agg(*[F.first(c).alias(c) for c in ("line", "head", "tail")])
    # the hash of a line without word i is (words before i) xor (words after i, one place earlier)
    xor = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    lines = _fixed(lines, words=words_of(F.col("line"))).drop("line")
    lines = _fixed(lines, n=F.size("words"), here=F.transform("words", lambda w, i: F.xxhash64(w, i)), moved=F.transform("words", lambda w, i: F.xxhash64(w, i - 1)))
    lines = _fixed(lines, both=F.zip_with("here", "moved", lambda a, b: a.bitwiseXOR(b)), whole=xor(F.col("here")), all_moved=xor(F.col("moved"))).drop("here")
    lines = _fixed(lines, swapped=running_xor(F.col("both"))).drop("both")
    least = _reach(F.col("n") - 1)  # the shorter of the halves
    may_differ = lambda i: (F.col("head") & (i >= least)) | (F.col("tail") & (i < F.col("n") - least))
    at = lambda z, i: F.when(may_differ(i), F.struct(i.alias("i"), z["moved"].bitwiseXOR(z["swapped"]).alias("part")))
    parts = F.filter(F.transform(F.arrays_zip("moved", "swapped"), at), lambda x: x.isNotNull())
    return _fixed(lines, parts=parts).select("first", "n", "words", "whole", "all_moved", "parts")


def _fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once a row: a generator of one row keeps the optimizer from repeating them inside lambdas."""
    made = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return rows.select("*", F.inline(made))


def near_lines(docs: DataFrame, firsts: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The ``first`` of every distinct line that is within one edit of an earlier one."""
    lines = cut(active_lines(docs, firsts))
    variants = lines.where(F.col("n") >= near_words).select("first", "n", "all_moved", F.inline("parts"))
    variants = variants.select("first", "n", "i", F.col("all_moved").bitwiseXOR(F.col("part")).alias("rest"))
    total = variants.count()
    late, early = F.col("first").alias("late"), F.col("early")
    # another word at the same place: the variants are equal, and so is the place
    low = variants.groupBy("n", "i", "rest").agg(F.min("first").alias("early"), F.count("*").alias("met")).where("met > 1")
    changed = hot_join(variants, low, ["n", "i", "rest"], "met", total).where("early < first").select(late, early, "i", F.lit(True).alias("both"))
    # one word more: a variant of the longer line equals the whole shorter line
    longer = variants.groupBy("n", "rest").agg(F.min(F.struct("first", "i")).alias("m"), F.count("*").alias("met"))
    shorter = lines.select((F.col("n") + 1).alias("n"), F.col("whole").alias("rest"), F.col("first").alias("short"))
    met = cut(longer.join(shorter, ["n", "rest"]))
    longer_early = met.where("m.first < short").select(F.col("short").alias("late"), F.col("m.first").alias("early"), "m.i", F.lit(False).alias("both"))
    longer_late = hot_join(variants, met.select("n", "rest", "met", F.col("short").alias("early")), ["n", "rest"], "met", total)
    longer_late = longer_late.where("early < first").select(late, early, "i", F.lit(False).alias("both"))
    pairs = cut(changed.unionByName(longer_late).unionByName(longer_early))
    # verify: the same words once word i of the longer line, or of both, is out
    out = lambda w, i: F.concat(F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.size(w)))
    a = lines.select(F.col("first").alias("late"), F.col("words").alias("a"))
    b = lines.select(F.col("first").alias("early"), F.col("words").alias("b"))
    i, wa, wb = F.col("i"), F.col("a"), F.col("b")
    within = (
        F.when(F.col("both"), (F.size(wa) == F.size(wb)) & (out(wa, i) == out(wb, i)))
        .when(F.size(wa) > F.size(wb), out(wa, i) == wb)
        .otherwise(out(wb, i) == wa)
    )
    hot = pairs.groupBy("early").agg(F.count("*").alias("n")).where(F.col("n") > heavy(pairs.count()))
    return salted_join(pairs.join(a, "late"), b, ["early"], hot).where(within).select(F.col("late").alias("first")).distinct()


def kept_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, h, kept): the numbers of the lines that stay, blank ones apart, for documents that keep one."""
    firsts = cut(first_lines(docs, near_words))
    stay = firsts.select("first").join(near_lines(docs, firsts, near_words), "first", "left_anti")
    return stay.select("first.*").groupBy("doc_id", "h").agg(F.collect_list("line_no").alias("kept"))


def dedup(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs``, all columns, with ``text`` without the lines that go, and as ``_n_lines`` and ``_n_kept`` its lines that aren't blank."""
    kept = kept_lines(docs, near_words).select(F.col("doc_id").alias("d"), "h", "kept")
    rows = docs.select(F.struct("*").alias("row"), "text")
    joined = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left")
    lines = F.split("text", "\n")
    blank = F.filter(F.transform(F.col("lines"), lambda x, i: F.when(F.rlike(x, F.lit(rf"^[\x20\x09-\x0D]*$")), i)), lambda i: i.isNotNull())
    stay = F.coalesce("kept", F.array().cast("array<int>"))
    joined = joined.withColumn("lines", lines).withColumn("blank", blank).withColumn("stay", F.array_sort(F.concat(stay, "blank")))
    left = F.when(F.size("stay") == F.size("lines"), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n"))
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_kept")]
    return joined.select(
        *[F.when(F.col("text").isNotNull(), left).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names],
        F.coalesce(F.size("lines") - F.size("blank"), F.lit(0)).cast("long").alias("_n_lines"),
        F.size(stay).cast("long").alias("_n_kept"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, text_sha256) for every document: its lines that aren't blank, those that stay, the text left."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_kept").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


#: The same rows by DuckDB, which joins the variants as strings, without the prefilter by halves.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
worded AS (
  SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM lines),
firsts AS (
  SELECT words, min({'d': doc_id, 'l': line_no}) AS first FROM worded WHERE len(words) > 0 GROUP BY words),
long AS (SELECT * FROM firsts WHERE len(words) >= 5),
variants AS (
  SELECT first, len(words) AS n, i,
    array_to_string(list_concat(list_slice(words, 1, i - 1), list_slice(words, i + 1, len(words))), ' ') AS rest
  FROM long, unnest(range(1, len(words) + 1)) AS u(i)),
low AS (SELECT n, i, rest, min(first) AS early FROM variants GROUP BY n, i, rest HAVING count(*) > 1),
gone AS (
  SELECT v.first FROM variants v JOIN low USING (n, i, rest) WHERE low.early < v.first
  UNION SELECT v.first FROM variants v JOIN firsts s ON v.rest = array_to_string(s.words, ' ') WHERE s.first < v.first
  UNION SELECT s.first FROM variants v JOIN firsts s ON v.rest = array_to_string(s.words, ' ') WHERE v.first < s.first),
kept AS (
  SELECT first.d AS doc_id, first.l AS line_no FROM firsts WHERE first NOT IN (SELECT first FROM gone)),
marked AS (
  SELECT w.doc_id, w.line_no, w.line, len(w.words) = 0 AS blank, k.doc_id IS NOT NULL AS stays
  FROM worded w LEFT JOIN kept k ON w.doc_id = k.doc_id AND w.line_no = k.line_no),
texts AS (
  SELECT doc_id, count(*) FILTER (NOT blank) AS n_lines, count(*) FILTER (stays) AS n_kept,
    string_agg(line, chr(10) ORDER BY line_no) FILTER (blank OR stays) AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_kept, 0) AS n_kept, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
