"""Measurement and trace operators on small facts with known answers."""

import math
import statistics

from pyspark.sql import functions as F

from siltworks.operators import measure, trace


def test_trimmed_and_robust_statistics(spark):
    times = [[1.0, 2.0, 3.0], [9.0, 1.0, 2.0, 3.0, 4.0, 5.0], [2.0], [1.0, 1.1, 1.2, 5.0]]
    df = spark.createDataFrame([(i, t, 100.0) for i, t in enumerate(times)], "run long, times array<double>, size double")
    got = {r.run: r for r in measure.bench_summary(df).collect()}
    for i, t in enumerate(times):
        s = sorted(t)[1:-1] if len(t) > 4 else sorted(t)
        assert got[i].median == statistics.median(s) and math.isclose(got[i].mean, statistics.mean(s))
        assert math.isclose(got[i].sd, statistics.stdev(s) if len(s) > 1 else 0, abs_tol=1e-12)
        assert got[i].p10_mbps == 100 / s[min(len(s) - 1, len(s) * 9 // 10)] / 1e6
    robust = {r.run: r for r in measure.robust_stats(df, 3, 0.1).collect()}
    assert robust[3].kept == 3 and robust[3].median == 1.1 and robust[3].stable and not robust[2].stable


def test_dedup_is_a_fold_in_order(spark):
    rows = [("a", 1, 3, 0.5), ("a", 2, 5, 0.9), ("a", 3, 4, 0.1), ("a", 4, 4, 0.2), ("b", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, seq int, trials int, cv double")
    got = {r.k: (r.trials, r.cv) for r in measure.dedup(df, ["k"], ["seq"]).collect()}
    assert got == {"a": (4, 0.1), "b": (1, 1.0)}


def test_norm_results_coalesces_older_names(spark):
    schema = "path string, level int, threads int, content_type string, results array<struct<tool:string,speed:double,speed_mbps:double,size:long,error:string>>"
    df = spark.createDataFrame([("x/text/1.json", 6, 1, None, [("ours", 5.0, None, 9, None), ("pigz", None, 4.0, None, None), ("gzip", 1.0, 1.0, 1, "failed")])], schema)
    got = {r.tool: (r.speed, r.size, r.data_type) for r in measure.norm_results(df).collect()}
    assert got == {"ours": (5.0, 9, "text"), "pigz": (4.0, None, "text")}


def test_guards(spark):
    rows = [("t", 9, 1, "ours", 95.0, 1005), ("t", 9, 1, "unpigz", 100.0, 1000), ("t", 2, 1, "ours", 99.0, 1021), ("t", 2, 1, "pigz", 0.0, 1000), ("t", 2, 1, "igzip", 100.0, None)]
    df = spark.createDataFrame(rows, "data_type string, level int, threads int, tool string, speed double, size long")
    g = measure.guards_compress(df)
    got = {(r.level, r.metric): r.passed for r in g.collect()}
    assert got == {(9, "speed_vs_pigz"): True, (9, "size_vs_pigz"): True, (2, "size_vs_pigz"): False, (2, "speed_vs_igzip"): False}
    assert tuple(measure.all_passed(g).head()) == (False, 2)


def test_cliffs_and_ladder(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 1.1), (2, 1, 0.95), (2, 2, 0.5)], "a int, b int, ratio double")
    got = {(r.axis, r.a, r.b, r.kind) for r in measure.cliffs(df, ["a", "b"]).collect()}
    assert got == {("b", 1, 1, "CROSS"), ("a", 1, 2, "CROSS")}
    sizes = spark.createDataFrame([("f", 1, 10), ("f", 2, 11), ("f", 3, 9)], "file string, level int, size long")
    assert [(r.level, r.sags) for r in measure.ladder(sizes).orderBy("level").collect()] == [(2, True), (3, False)]


def test_pins_shapes_strata_trials_and_logs(spark):
    a = spark.createDataFrame([("x", 1, 2), ("y", 1, 1)], "k string, p long, q long")
    b = spark.createDataFrame([("x", 1, 3), ("z", 1, 1)], "k string, p long, q long")
    assert {(r.k, r.field) for r in measure.pin_match(a, b, ["k"]).collect()} == {("x", "q"), ("y", "p"), ("y", "q"), ("z", "p"), ("z", "q")}
    c = spark.createDataFrame([("x", 10, 30), ("y", 0, 5)], "k string, t1 long, t4 long")
    assert {r.k: r.holds for r in measure.perf_shape(c, spark.createDataFrame([("x", 5, 14), ("y", 0, 5)], "k string, t1 long, t4 long"), ["k"]).collect()} == {"x": False, "y": True}
    blocks = spark.createDataFrame([("f", k, m) for k, m in enumerate([5, 9, 10, 13, 15, 7])], "file string, block int, most_bits int")
    assert sorted((r.stratum, r.block) for r in measure.sample_stratified(blocks, 2).collect()) == [("deep", 3), ("deep", 4), ("shallow", 0), ("shallow", 1), ("typical", 2)]
    t = spark.createDataFrame([("a", True, 1.0), ("a", True, 3.0), ("b", True, 1.0), ("b", False, 0.1)], "k string, ok boolean, seconds double")
    assert [(r.k, r.n, r.median) for r in measure.trials(t, ["k"]).collect()] == [("a", 2, 2.0)]
    lines = spark.createDataFrame([("l", 1, "job: one"), ("l", 2, "  pigz 1.5 s"), ("l", 3, "noise"), ("l", 4, "job: two"), ("l", 5, "ours 0.5 s")], "log string, line int, text string")
    assert [(r.job, r.tool, r.seconds) for r in measure.log_rows(lines).orderBy("line").collect()] == [("one", "pigz", 1.5), ("two", "ours", 0.5)]
    cause = spark.createDataFrame([("compress-L12-T1", "igzip"), ("text-Tmax", "rapidgzip"), ("bgzf-Tmax", "rapidgzip"), ("text-T1", "igzip"), ("L1", "igzip")], "s string, r string").select(measure.gap_cause(F.col("s"), F.col("r")).alias("c"))
    assert [r.c.split(" ")[0] + r.c[-12:] for r in cause.collect()] == ["ISA-Lcompression.", "Noarallelizes.", "BGZFon overhead.", "ISA-L86 assembly.", "Investigatel profiling."]


def events(spark, rows):
    return spark.createDataFrame([(1, 7, float(ts), k, ph, name) for k, (ts, ph, name) in enumerate(rows)], "pid long, tid long, ts double, seq long, ph string, name string")


def test_spans_are_paired_by_depth_or_by_name(spark):
    e = events(spark, [(0, "B", "a"), (1, "B", "b"), (3, "E", "b"), (4, "B", "c"), (5, "E", "?"), (9, "E", "a"), (10, "B", "open")])
    got = {(r.name, r.parent, r.depth, r.start, r.end) for r in trace.pair_spans(e).collect()}
    assert got == {("a", "<root>", 1, 0, 9), ("b", "a", 2, 1, 3), ("c", "a", 2, 4, 5)}
    strict = {(r.name, r.start, r.end, r.anomaly) for r in trace.pair_spans_strict(e).collect()}
    assert strict == {("b", 1.0, 3.0, False), ("?", None, 5.0, True), ("c", 4.0, None, True), ("a", 0.0, 9.0, False), ("open", 10.0, None, True)}
    leaf = {r.name: r.total for r in trace.leaf_time(e).collect()}
    assert leaf == {"a": 1 + 1 + 4, "b": 2, "c": 1}
    tree = {r.name: (r.total, r.self) for r in trace.call_tree(trace.pair_spans(e)).collect()}
    assert tree["a"] == (9, 6) and tree["b"] == (2, 2)


def test_overlaps_by_stretches_are_all_overlaps(spark):
    import random

    r = random.Random(1)
    spans = lambda n: [(r.choice("xyz"), s, s + r.randrange(1, 60)) for s in (r.randrange(200) for _ in range(n))]
    a, b = spans(30), spans(40)
    frame = lambda rows: spark.createDataFrame([(1, *x) for x in rows], "tid long, name string, start long, end long")
    got = {(x.name, x.other): (x.n, x.total) for x in trace.overlaps(frame(a), frame(b), 16).collect()}
    want = {}
    for n, s, e in a:
        for m, t, f in b:
            if s < f and t < e:
                k, total = want.get((n, m), (0, 0))
                want[n, m] = k + 1, total + min(e, f) - max(s, t)
    assert got == want
    w = trace.last_wave(frame(a), 3).head()
    tail = sorted(a, key=lambda x: (x[1], x[2]))[-10:]
    assert w.wave == 10 and w.last_most == max(e - s for _, s, e in tail) and abs(w.ratio - (sum(e - s for _, s, e in tail) / 10) / (sum(e - s for _, s, e in a) / 30)) < 1e-9


def test_inversions_are_pairs_out_of_order(spark, monkeypatch):
    import random

    r = random.Random(2)
    frame = lambda rows: spark.createDataFrame([(1, "x", *x) for x in rows], "tid long, name string, start long, end long")
    assert trace.inversions(frame([(0, 10), (1, 5), (2, 4)])).head().inversions == 3
    spans = [(s, s + r.randrange(0, 80)) for s in (r.randrange(150) for _ in range(300))] + [(5, 200)] * 3
    want = sum(a < c and b > d for a, b in spans for c, d in spans)
    for stretch in (1 << 16, 20, 1):
        monkeypatch.setattr(trace, "PER_STRETCH", stretch)
        got = trace.inversions(frame(spans)).head()
        assert (got.n, got.inversions) == (303, want)
    assert trace.inversions(frame(spans).limit(0)).head().inversions == 0


def test_stray_ends_lose_no_spans(spark):
    import random

    e = events(spark, [(0, "E", "?"), (1, "B", "a"), (2, "E", "a"), (3, "B", "b"), (5, "E", "b")])
    assert {(r.name, r.parent, r.depth, r.start, r.end) for r in trace.pair_spans(e).collect()} == {("a", "<root>", 1, 1, 2), ("b", "<root>", 1, 3, 5)}
    assert {r.name: r.total for r in trace.leaf_time(e).collect()} == {"a": 1, "b": 2}
    r = random.Random(9)
    rows = [(k, r.choice("BE"), r.choice("xyz")) for k in range(300)]
    stack, want, leaf = [], set(), {}
    for (ts, ph, name), following in zip(rows, [*rows[1:], None], strict=True):
        if ph == "B":
            stack.append((name, ts))
        elif stack:
            n, start = stack.pop()
            want.add((n, stack[-1][0] if stack else "<root>", len(stack) + 1, start, ts))
        if stack and following:
            leaf[stack[-1][0]] = leaf.get(stack[-1][0], 0) + following[0] - ts
    got = events(spark, rows)
    assert {(x.name, x.parent, x.depth, x.start, x.end) for x in trace.pair_spans(got).collect()} == want
    assert {x.name: x.total for x in trace.leaf_time(got).collect()} == leaf


def _gathers(df):
    return "collect_list" in df._jdf.queryExecution().optimizedPlan().toString()


def test_log_summary_counts_instead_of_gathering(spark):
    import random

    r = random.Random(3)
    values = {"hot": [r.choice([0.0, 1.5, r.expovariate(0.01), r.random() * 1e-6]) for _ in range(3000)], "one": [4.0], "two": [1.0, 2.0], "same": [7.0] * 500, None: [3.0, 1.0, 2.0], "nulls": [1.0, None, None]}
    df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs], "name string, value double").repartition(7)
    out = trace.log_summary(df)
    assert not _gathers(out)
    want = {}
    for k, xs in values.items():
        s, n = sorted(x for x in xs if x is not None), len(xs)
        s += [None] * (n - len(s))
        want[k] = (n, s[n // 2], s[min(n - 1, int(n * 0.95))], s[n - 1])
    assert {x.name: (x.n, x.p50, x.p95, x.most) for x in out.collect()} == want
    assert trace.log_summary(df.limit(0)).count() == 0


def test_as_of_scans_instead_of_gathering(spark):
    import random

    from siltworks.operators import seek

    r = random.Random(5)
    points = [(s, r.randrange(1000), k) for s in (1, 2, None) for k in range(60)]
    index = spark.createDataFrame([(s, k, k * 2, at, None) for s, at, k in points] + [(1, 99, 1, 0, "bad")], "stream_id long, point long, input_at long, output_at long, error string")
    asked = [(s, r.randrange(-5, 1005), 10) for s in (1, 2, 3, None) for _ in range(20)] * 2
    out = seek.as_of(spark.createDataFrame(asked, "stream_id long, offset long, size int"), index)
    assert not _gathers(out)
    want = []
    for s, o, size in asked:
        best = max(((at, k) for t, at, k in points if s is not None and t == s and at <= o), default=(None, None))
        want.append((s, o, size, best[1], None if best[1] is None else best[1] * 2, best[0]))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_the_parent_is_the_innermost_open_span(spark):
    e = events(spark, [(0, "B", "a"), (1, "E", "a"), (2, "B", "open"), (3, "B", "b"), (4, "B", "c"), (5, "E", "c"), (6, "E", "b"), (7, "B", "d"), (8, "E", "d")])
    out = trace.pair_spans(e)
    assert not _gathers(out)
    assert {(r.name, r.parent, r.depth) for r in out.collect()} == {("a", "<root>", 1), ("b", "open", 2), ("c", "b", 3), ("d", "open", 2)}


def test_key_metrics_goals_and_counters(spark):
    from siltworks.operators import measure, trace

    empty = spark.createDataFrame([], "tool string, level int, threads int, speed double, size long, source string")
    assert tuple(measure.key_metrics(empty, empty, ("level", "threads")).head()) == (None,) * 4
    assert measure.goals(empty, empty, ("level", "threads")).count() == 0
    rows = spark.createDataFrame(
        [("ours", 1, 1, 9.0, 1, "ours"), ("ours", 1, 2, 200.0, 100, "ours"), ("ours", 1, 4, 900.0, 100, "ours"), ("pigz", 1, 2, 100.0, 90, "pigz"), ("ours", 9, 1, 5.0, 1006, "gzip"), ("pigz", 9, 1, 5.0, 1000, "gzip")],
        empty.schema,
    )
    assert tuple(measure.key_metrics(rows, rows, ("level", "threads")).head()) == (100.0, 0.6, 900.0, "ours")
    assert {tuple(r) for r in measure.goals(rows, rows, ("level", "threads")).collect()} == {("packing speed", True), ("packed size", False), ("unpacking speed", False)}
    single = spark.createDataFrame([(1, "ours", 99.0, None), (1, "rapidgzip", 100.0, None), (2, "ours", 98.0, None), (2, "rapidgzip", 100.0, None), (3, "ours", 1.0, "bad"), (3, "rapidgzip", 1.0, None)], "threads int, tool string, speed double, error string")
    assert {tuple(r) for r in measure.single_member_goals(single).collect()} == {(1, True), (2, False)}
    names = "run long, attempts long, miss long, too_short long, accepted long, deferred long, other_attempts long, processed long, skipped long, literals long, match_bytes long"
    counted = spark.createDataFrame([(1, 10, 1, 2, 3, 4, 0, 5, 6, 4, 7), (2, 11, 1, 2, 3, 4, 0, 5, 6, 4, 6), (3, 10, 1, 2, 3, 4, 1, 5, 6, 0, 0), (4, 0, 0, 0, 0, 0, 0, 5, 0, 0, 0)], names)
    assert {tuple(r) for r in measure.reconcile(counted, ("run",)).collect()} == {(1, 0, 0), (2, 1, 1), (3, 0, None), (4, 0, None)}
    spans = spark.createDataFrame([("lock.wait", 0, 5, {"lock": "a"}), ("lock.wait", 2, 3, {}), ("lock.wait", 7, 8, None), ("lock.held", 0, 9, {"lock": "a"})], "name string, start long, end long, args map<string,string>")
    assert {tuple(r) for r in trace.lock_waits(spans).collect()} == {("a", 1, 5, 5), ("<unknown>", 2, 2, 1)}
    instants = spark.createDataFrame([("alloc", {"site": "s", "bytes": "7"}), ("alloc", {"site": "s", "bytes": "x"}), ("alloc", None), ("free", {"site": "s", "bytes": "9"})], "name string, args map<string,string>")
    assert {tuple(r) for r in trace.alloc_sites(instants).collect()} == {("s", 2, 7), ("<unknown>", 1, 0)}


def test_deviation_on_the_limit_is_that_of_sql(spark):
    """A deviation of a tenth of the median, but for the last bit of the running sums."""
    import duckdb

    times = [14.0, 14.0, 16.0, 17.0]
    row = measure.robust_stats(spark.createDataFrame([(1, times)], "run long, times array<double>")).head()
    sd = duckdb.connect().execute("SELECT list_aggregate(?::DOUBLE[], 'stddev_samp')", [times]).fetchone()[0]
    assert row.sd == sd and row.stable == (sd / 15 <= 0.1)


def test_small_losses_keep_their_sign(spark):
    from siltworks.functions import labels

    df = spark.createDataFrame([(10_000, 10_003), (10_000, 10_000), (10_000, 9_997), (1000, 1001)], "a long, b long")
    said = [r.t for r in df.select(labels.saved_text(F.col("a"), F.col("b")).alias("t")).collect()]
    assert said == [f"{x:7.1f}%" for x in (-0.03, 0.0, 0.03, -0.1)]
