"""One query for each operator family over the driver's tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import labels
from siltworks.operators import bytestats, codec, deflate, lz, marked, measure, seek, trace
from siltworks.plans import inputs
from siltworks.sources.blobs import complete_set, table_blobs

CONFIG = ("data_type", "level", "threads")


def byte_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.byte_hist(table_blobs(spark, sf_dir))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.entropy(table_blobs(spark, sf_dir))


def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.content_type(table_blobs(spark, sf_dir))


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.canvas(table_blobs(spark, sf_dir))


def tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.tuning(table_blobs(spark, sf_dir))


def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytestats.chunk_grid(table_blobs(spark, sf_dir))


def gzip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table_blobs(spark, sf_dir), 6)


def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table_blobs(spark, sf_dir), 1, "raw")


def zlib_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table_blobs(spark, sf_dir), 9, "zlib")


def stored_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table_blobs(spark, sf_dir), 0)


def _packed(spark: SparkSession, sf_dir: str, table: str = "documents", level: int = 6) -> DataFrame:
    return codec.compress(table_blobs(spark, sf_dir, table), level).select("stream_id", "packed")


def gzip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.headers(_packed(spark, sf_dir)).select("stream_id", "ok", "name", "mtime", "os", "header_bytes", "isize")


def gzip_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.listing(_packed(spark, sf_dir))


def gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two members a blob: the second holds the text again."""
    p = _packed(spark, sf_dir).select("stream_id", F.concat("packed", "packed").alias("packed"))
    return codec.members(p).select("stream_id", "member", "isize", "output_offset")


def gzip_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third blob is cut short, and so an error row."""
    p = _packed(spark, sf_dir)
    cut = F.when(F.col("stream_id") % 3 == 0, F.substring("packed", F.lit(1), F.octet_length("packed") - 9)).otherwise(F.col("packed"))
    return codec.test(p.select("stream_id", cut.alias("packed"))).select("stream_id", "ok")


def crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_blobs(spark, sf_dir).select("stream_id", F.crc32("raw").alias("crc32"), F.octet_length("raw").cast("long").alias("bytes"))


def gzip_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.route(_packed(spark, sf_dir), 4)


def dict_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1 KiB primed with what is before them, put together and inflated again."""
    joined = codec.reassembled(codec.chunked(table_blobs(spark, sf_dir), 1024))
    back = codec.decompress(joined, "raw")
    return back.select("stream_id", F.octet_length("raw").cast("long").alias("bytes"), F.sha2("raw", 256).alias("sha256"))


def pick_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.smallest(table_blobs(spark, sf_dir))


def level_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.level_params(spark)


def lz_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.summary(table_blobs(spark, sf_dir))


def analysis_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.analysis_card(table_blobs(spark, sf_dir))


def _walked(spark: SparkSession, sf_dir: str, level: int = 6, table: str = "documents", counts: bool = True) -> DataFrame:
    """Blocks with counts in place of the tokens, where these aren't asked for."""
    return deflate.blocks(_packed(spark, sf_dir, table, level), counts)


def walk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).drop("file_bytes", *deflate.COUNTS)


def block_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflate.block_fingerprints(_walked(spark, sf_dir))


def stream_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflate.stream_fingerprints(_walked(spark, sf_dir))


def _token_sizes(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    t = deflate.tokens(_walked(spark, sf_dir, table=table, counts=False))
    return t.groupBy("stream_id").agg(F.sum("length").alias("bytes"), F.max(F.col("pos") + F.col("length")).alias("end"))


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens' lengths make up each text again; over the small table, as its SQL."""
    return _token_sizes(spark, sf_dir, "benchmark")


def token_sizes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every document; an empty one has no tokens."""
    sizes = _token_sizes(spark, sf_dir, "documents")
    return table_blobs(spark, sf_dir).select("stream_id").join(sizes, "stream_id", "left").na.fill(0, ["bytes", "end"])


def match_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflate.match_histograms(deflate.tokens(_walked(spark, sf_dir, counts=False)))


def diverge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflate.diverge_packed(*(_packed(spark, sf_dir, level=n) for n in (1, 9)))


def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (deflate.stream_fingerprints(_walked(spark, sf_dir, n)) for n in (1, 9))
    return deflate.fingerprint_diff(a, b)


def block_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflate.census(_walked(spark, sf_dir))


def block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflate.spans(_walked(spark, sf_dir))


def table_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflate.table_frequency(_walked(spark, sf_dir))


def _both_packings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the bit account of levels 1 and 9, the file sizes of both)."""
    a, b = (_packed(spark, sf_dir, level=n) for n in (1, 9))
    x, y = (p.select("stream_id", F.octet_length("packed").cast("long").alias("file_bytes")) for p in (a, b))
    return deflate.bit_account_packed(a, b), x, y


def bit_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_packings(spark, sf_dir)[0]


def bit_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the walked bits leave of the files' sizes: nothing."""
    return deflate.bit_residual(*_both_packings(spark, sf_dir))


def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks make up each document, and one of them is the last."""
    by = _walked(spark, sf_dir).groupBy("stream_id").agg(F.sum("span_bytes").alias("bytes"), F.count_if("final").alias("last"), F.max("error").alias("error"))
    return by.select("stream_id", "bytes", "last", F.col("error").isNull().alias("ok"))


def cut_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of ``rolling_cuts`` follow each other over the whole document."""
    c = rolling_cuts(spark, sf_dir)
    return c.groupBy("stream_id").agg(F.sum("size").alias("bytes"), (F.max(F.col("start") + F.col("size")) == F.sum("size")).alias("whole"))


def listed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's sizes, and their sum in the row of all."""
    return gzip_listing(spark, sf_dir).select(F.coalesce("stream_id", F.lit(-1)).alias("stream_id"), "bytes")


def _deflate64_round_trip(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    back = deflate.inflate64(codec.huffman_only(table_blobs(spark, sf_dir, table)))
    return back.select("stream_id", F.octet_length("raw").cast("long").alias("bytes"), F.sha2("raw", 256).alias("sha256"))


def deflate64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams without matches are the same in both forms; over the small table, as its SQL."""
    return _deflate64_round_trip(spark, sf_dir, "benchmark")


def deflate64_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every document."""
    return _deflate64_round_trip(spark, sf_dir, "documents")


def _index_seek(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    blobs = table_blobs(spark, sf_dir, table)
    # dealt out by id once, for the index and for what is read by it
    framed = codec.framed(codec.reassembled(codec.chunked(blobs, 128)), blobs).repartition("stream_id")
    wanted = blobs.select("stream_id", F.floor(F.octet_length("raw") / 2).alias("offset"), F.lit(100).alias("size"))
    got = seek.index_seek(framed, seek.index_build(framed, 512), wanted)
    return got.select("stream_id", "offset", F.sha2("part", 256).alias("sha256"))


def index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred bytes from the middle of each text, by checkpoints every 512 bytes of packed chunks; over the small table, as its SQL."""
    return _index_seek(spark, sf_dir, "benchmark")


def index_seek_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every document."""
    return _index_seek(spark, sf_dir, "documents")


def as_of_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checkpoints of their customer: the last one at or before each of some offsets."""
    o = inputs.read(spark, sf_dir, "orders")
    points = o.select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("output_at"), F.col("o_orderkey").alias("point"), F.col("o_orderkey").alias("input_at"), F.lit(None).cast("string").alias("error"))
    wanted = inputs.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), (F.col("c_custkey") * 7).alias("offset"))
    return seek.as_of(wanted, points).select("stream_id", "offset", F.coalesce("point", F.lit(-1)).alias("point"))


def rolling_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With small bounds, so that texts are cut at all."""
    return seek.rolling_cuts(table_blobs(spark, sf_dir), 64, 0x3F, 256, 4096)


def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.win_rate(inputs.cells(spark, sf_dir), ("corpus_set",))


def win_rate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = measure.win_rate_sets(inputs.cells(spark, sf_dir))
    return told.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("rival", "threads", "level")})


def overfit_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.overfit_alarm(inputs.cells(spark, sf_dir))


def worst_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.worst_members(inputs.cells(spark, sf_dir))


def size_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.size_delta(inputs.cells(spark, sf_dir)).select("n", "bigger", "total", "worst_pct")


def seam_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.seam_tax(inputs.cells(spark, sf_dir).where("corpus_set = 'board' or threads = 4"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.cells(spark, sf_dir).groupBy("file", "level").agg(F.sum("ours").alias("size"))
    return measure.ladder(c)


def cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.cells(spark, sf_dir).groupBy("file", "level", "threads", "rival").agg((F.sum("ours") / F.sum("rival_bytes")).alias("ratio"))
    found = measure.cliffs(c, ("file", "level", "threads", "rival"))
    return found.withColumns({"ratio": F.round("ratio", 6), "next_ratio": F.round("next_ratio", 6)})


def won_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.cells(spark, sf_dir)
    pins = c.where("corpus_set = 'board'").select("file", "level", "threads", "rival", (F.col("rival_bytes") - 20).alias("rival_bytes"))
    return measure.won_ledger(pins, c.where("corpus_set = 'board'"))


def split_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = inputs.read(spark, sf_dir, "part")
    return complete_set(parts.select("p_brand").distinct(), parts.select("p_brand", "p_partkey"), "p_brand")


def guards_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.guards_compress(inputs.results(spark, sf_dir))
    return g.withColumn("ratio", F.round("ratio", 6))


def guards_decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.guards_decompress(inputs.results(spark, sf_dir), CONFIG)
    return g.withColumn("ratio", F.round("ratio", 6))


def pivot_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.pivot_tool(inputs.results(spark, sf_dir), CONFIG, "speed", inputs.TOOLS)


def ratio_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.ratio_ledger(inputs.results(spark, sf_dir), CONFIG).withColumn("ratio", F.round("ratio", 6))


def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.gap_analysis(inputs.results(spark, sf_dir), CONFIG)


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = inputs.results(spark, sf_dir).where("tool = 'ours'").select("data_type", "level", "threads", "speed")
    return measure.run_compare(r.where("threads = 1"), r.where("threads = 2").select("data_type", "level", "speed"), ("data_type", "level"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.against(inputs.results(spark, sf_dir), CONFIG)
    return measure.run_history(g.select(F.col("level").alias("run"), (F.col("our_speed") / F.col("speed") - 1).alias("gap")))


def summary_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.summary_compress(inputs.results(spark, sf_dir), CONFIG)


def summary_decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.summary_decompress(inputs.results(spark, sf_dir), CONFIG)


def validation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.validation_table(inputs.results(spark, sf_dir), CONFIG)


def route_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.route_check(inputs.results(spark, sf_dir), CONFIG)


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.scorecard(inputs.scores(spark, sf_dir))


def loss_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.loss_groups(inputs.scores(spark, sf_dir))


def gap_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.scores(spark, sf_dir).select("scenario", "platform", "rival", measure.gap_cause(F.col("scenario"), F.col("rival")).alias("cause"))


def compare_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.against(inputs.results(spark, sf_dir), CONFIG)
    return g.select(*CONFIG, "rival", measure.compare_band(F.col("our_speed") / F.col("speed")).alias("band"))


def best_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = measure.best_ratio(inputs.tool_runs(spark, sf_dir), ("data_type", "level"), "ours")
    return b.withColumns({c: F.round(c, 6) for c in ("ratio", "margin")})


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs.read(spark, sf_dir, "lineitem")
    t = measure.trials(i.select(F.col("l_orderkey").alias("run"), (F.col("l_discount") < 0.08).alias("ok"), F.col("l_quantity").alias("seconds")), ("run",))
    return t.withColumn("sd", F.round("sd", 6))


def pin_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with two threads against those with one, as pins."""
    r = inputs.results(spark, sf_dir).where("tool = 'ours'")
    a, b = (r.where(f"threads = {n}").select("data_type", "level", "size", F.floor("speed").alias("speed")) for n in (2, 1))
    return measure.pin_match(a, b, ("data_type", "level"))


def perf_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.cells(spark, sf_dir)
    wide = lambda v: c.groupBy("file").agg(*[F.coalesce(F.sum(F.when(F.col("threads") == t, F.col(v))), F.lit(0)).alias(f"t{t}") for t in (1, 4)])
    return measure.perf_shape(wide("ours"), wide("rival_bytes"), ("file",))


def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blocks of their brand."""
    p = inputs.read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("block"), (F.col("p_partkey") % 16).alias("most_bits"))
    return measure.sample_stratified(p)


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each kind and level, of those of all threads and tools; every fifth doesn't know its trials."""
    r = inputs.results(spark, sf_dir)
    r = r.select("data_type", "level", "threads", "tool", F.when(F.col("size") % 5 > 0, F.col("size") % 7).alias("trials"), (F.col("size") % 11 / 10.0).alias("cv"))
    return measure.dedup(r, ("data_type", "level"), ("threads", "tool"))


def norm_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results put into documents and taken out again; those of gzip have an error."""
    r = inputs.results(spark, sf_dir)
    one = F.struct("tool", F.col("speed").alias("speed_mbps"), F.col("size").alias("output_size"), F.col("median").alias("time"), F.when(F.col("tool") == "gzip", "bad").alias("error"))
    path = F.concat(F.element_at(F.array(*map(F.lit, ("text", "random", "other"))), (F.col("level") % 3 + 1).cast("int")), F.lit(".json"))
    docs = r.groupBy("data_type", "level", "threads").agg(F.collect_list(one).alias("results")).select(path.alias("path"), "level", "threads", F.when(F.col("data_type") != "N", F.col("data_type")).alias("content_type"), "results")
    return measure.norm_results(docs).drop("trials", "cv")


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = measure.bench_summary(inputs.timed_runs(spark, sf_dir)).drop("times")
    b = b.withColumns({c: F.round(c, 9) for c in ("mbps", "p10_mbps", "p90_mbps")})
    return b.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "cv", "median")})


def robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = measure.robust_stats(inputs.timed_runs(spark, sf_dir)).drop("times", "size")
    return r.withColumns({c: F.round(c, 6) for c in ("median", "sd")})


def noise_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blobs stay within the bound."""
    p = codec.compress(table_blobs(spark, sf_dir), 0)
    return p.select("stream_id", (F.octet_length("packed") <= measure.noise_bound(F.col("bytes"))).alias("holds"))


def span_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.span_totals(inputs.spans(spark, sf_dir))


def _waits() -> object:
    return F.col("name").isin("view", "click")


def busy_wait_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.busy_wait_gap(inputs.spans(spark, sf_dir), _waits())


def wait_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.spans(spark, sf_dir)
    return trace.overlaps(s.where(_waits() & (F.col("tid") == 1)), s.where(~_waits()), 600_000_000)


def trace_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.spans(spark, sf_dir)
    return trace.trace_diff(s.where("tid % 2 = 0"), s.where("tid % 2 = 1"))


def effective_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.effective_cores(inputs.spans(spark, sf_dir))


def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.inversions(inputs.spans(spark, sf_dir))


def last_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trace.last_wave(inputs.spans(spark, sf_dir), 8)
    return w.withColumns({c: F.round(c, 6) for c in ("last_mean", "all_mean", "ratio")})


def pair_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event ends a span: with ends that no begin goes with."""
    return trace.pair_spans(inputs.marks(spark, sf_dir)).drop("pid")


def leaf_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.leaf_time(inputs.marks(spark, sf_dir)).drop("pid")


def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.call_tree(trace.pair_spans(inputs.marks(spark, sf_dir))).select("parent", "name", "n", "total")


def pair_spans_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name; how many pairs and anomalies each thread has."""
    p = trace.pair_spans_strict(inputs.marks(spark, sf_dir))
    return p.groupBy("tid").agg(F.count_if(~F.col("anomaly")).alias("pairs"), F.count_if("anomaly").alias("anomalies"))


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.log_summary(inputs.read(spark, sf_dir, "events"), "event_type", "value")


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict's rules over line items as stand-ins: any four numbers."""
    i = inputs.read(spark, sf_dir, "lineitem")
    e, c, n, d, p = F.col("l_quantity") % 8, F.col("l_discount") * 10, F.col("l_partkey") % 200, F.col("l_extendedprice") % 8192, F.col("l_suppkey") * 7 % 300
    said = labels.verdict(e, c, n, d, p)
    return i.select("l_orderkey", "l_linenumber", said["nature"].alias("nature"), said["reach"].alias("reach"), said["cap"].alias("cap"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table_blobs(spark, sf_dir).select("stream_id", F.octet_length("raw").cast("long").alias("bytes"))
    return b.select("stream_id", labels.human_bytes(F.col("bytes")).alias("human"), labels.format_by_extension(F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ("gz", "zz", "zip", "tgz", "txt"))), (F.col("stream_id") % 5 + 1).cast("int")))).alias("format"))


def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as marked members of 1 KiB, listed without inflating them."""
    return marked.blocks(marked.compress(table_blobs(spark, sf_dir), 1024)).select("stream_id", "block", "isize", "output_offset", "error")


def marked_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked members are gzip members like others."""
    back = codec.decompress(marked.compress(table_blobs(spark, sf_dir), 1024))
    return back.select("stream_id", "members", F.octet_length("raw").cast("long").alias("bytes"), F.sha2("raw", 256).alias("sha256"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four forms by their id: marked members, two members, one member, not packed."""
    b, p = table_blobs(spark, sf_dir), _packed(spark, sf_dir)
    form = F.col("stream_id") % 4
    marks = marked.compress(b.where(form == 0), 1024)
    twice = p.where(form == 1).select("stream_id", F.concat("packed", "packed").alias("packed"))
    return marks.union(twice).union(p.where(form == 2)).union(b.where(form == 3).select("stream_id", F.col("raw").alias("packed")))


def gzip_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers tell; packed data may hold the magic bytes by chance, so one member or more aren't told apart here."""
    s = marked.structure(_mixed(spark, sf_dir))
    return s.select("stream_id", F.when(F.col("kind").isin("multi-member", "single-member"), "gzip").otherwise(F.col("kind")).alias("kind"))


def output_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked.output_estimate(_mixed(spark, sf_dir).where(F.col("stream_id") % 4 < 3))


def mixed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.route(_mixed(spark, sf_dir).where(F.col("stream_id") % 4 < 3), 4)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a name and a time in their headers; every fifth has no name, every seventh no time. From id 49,676 on the time is beyond a header's four bytes, and the file's own alone."""
    b, n = table_blobs(spark, sf_dir), F.col("stream_id")
    name = F.when(n % 5 > 0, F.concat(F.lit("doc-"), n.cast("string"), F.lit(".txt")))
    time = F.when(n % 7 > 0, n * 86_461).otherwise(0)
    return codec.framed(codec.compress(b, 6, "raw"), b, name, time, (time.alias("file_time"),))


def gzip_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.headers(_named(spark, sf_dir)).select("stream_id", "name", "mtime", "header_bytes", "isize")


def gzip_listing_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.listing_detail(_named(spark, sf_dir)).select("stream_id", "method", "crc", "date", "bytes", "name")


def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's literal codes are complete: in units of 2^-15 the codes of a block add up to 2^15."""
    lens = deflate.code_lengths(_packed(spark, sf_dir))
    kraft = F.aggregate("literals", F.lit(0), lambda a, x: a + F.when(x > 0, (32_768 / F.pow(F.lit(2), x)).cast("int")).otherwise(0))
    by = lens.select("stream_id", F.col("error").isNull().alias("ok"), F.coalesce(kraft == 32_768, F.col("btype") == "stored").alias("complete"))
    return by.groupBy("stream_id").agg(F.bool_and("ok").alias("ok"), F.bool_and("complete").alias("complete"))


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.cells(spark, sf_dir)
    sizes = F.col("rival_bytes"), F.col("ours")
    return c.select("corpus_set", "file", "level", "threads", "rival", F.round(labels.saved_percent(*sizes), 6).alias("percent"), labels.saved_text(*sizes).alias("told"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with levels 6 and 7 as 11 and 9."""
    level = F.when(F.col("level") == 6, 11).when(F.col("level") == 7, 9).otherwise(F.col("level"))
    return inputs.results(spark, sf_dir).withColumn("level", level).withColumn("source", F.when(F.col("data_type") == "A", "ours").otherwise(F.lower("data_type")))


def key_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _levels(spark, sf_dir)
    return measure.key_metrics(r, r, CONFIG)


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _levels(spark, sf_dir)
    return measure.goals(r, r, CONFIG)


def single_member_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = inputs.results(spark, sf_dir).where("data_type = 'R'")
    error = F.when((F.col("tool") == "ours") & (F.col("level") == 3), "bad")
    return measure.single_member_goals(r.select((F.col("threads") + 10 * F.col("level")).alias("threads"), "tool", "speed", error.alias("error")))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of counters: outcomes that are made to agree in four of five."""
    o, n = inputs.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    parts = {"miss": n % 7, "too_short": n % 11, "accepted": n % 13, "deferred": n % 3, "processed": n % 50, "skipped": n % 9, "literals": n % 50 - n % 4, "match_bytes": n % 9 + n % 4}
    facts = o.select(n.alias("run"), *[c.alias(k) for k, c in parts.items()], F.when(n % 6 == 0, 1).otherwise(0).alias("other_attempts"))
    facts = facts.withColumn("attempts", F.col("miss") + F.col("too_short") + F.col("accepted") + F.col("deferred") + F.when(F.col("run") % 5 == 0, 1).otherwise(0))
    return measure.reconcile(facts, ("run",))


def lock_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as waits for the user's lock; every third names none."""
    s = inputs.spans(spark, sf_dir).where("name = 'view'")
    lock = F.when(F.col("tid") % 3 > 0, F.concat(F.lit("lock-"), (F.col("tid") % 20).cast("string")))
    return trace.lock_waits(s.select(F.lit("lock.wait").alias("name"), "start", "end", F.create_map(F.lit("lock"), lock).alias("args")))


def alloc_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as allocations of their type; every fourth doesn't know its bytes."""
    e = inputs.read(spark, sf_dir, "events")
    size = F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 4096).cast("string"))
    return trace.alloc_sites(e.select(F.lit("alloc").alias("name"), F.create_map(F.lit("site"), F.col("event_type"), F.lit("bytes"), size).alias("args")))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
