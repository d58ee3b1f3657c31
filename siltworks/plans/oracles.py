"""The queries in DuckDB's SQL, written for themselves from the operators' definitions."""

from __future__ import annotations

from siltworks.plans.inputs import CELLS, MARKS, RESULTS, RUNS, SCORES, SPANS

BLOBS = "blobs AS (SELECT doc_id AS stream_id, encode(coalesce(text, '')) AS raw FROM documents)"
HIST = f"""{BLOBS},
pairs AS (SELECT stream_id, unnest(regexp_extract_all(hex(raw), '..')) AS pair FROM blobs),
hist AS (SELECT stream_id, ('0x' || pair)::INT AS byte, count(*) AS n FROM pairs GROUP BY ALL)"""
LABEL = "CASE WHEN entropy < 2.5 THEN 'VERY LOW' WHEN entropy < 4.5 THEN 'LOW' WHEN entropy < 6.5 THEN 'MEDIUM' WHEN entropy < 7.8 THEN 'HIGH' ELSE 'MAX' END"
SAMPLE = f"""{BLOBS},
pairs AS (SELECT stream_id, unnest(regexp_extract_all(left(hex(raw), 16384), '..')) AS pair FROM blobs),
hist AS (SELECT stream_id, ('0x' || pair)::INT AS byte, count(*) AS n FROM pairs GROUP BY ALL),
facts AS (
  SELECT stream_id, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13) OR byte BETWEEN 128 AND 247), 0)::BIGINT AS text,
    coalesce(sum(n) FILTER (byte BETWEEN 0 AND 8 OR byte IN (11, 12) OR byte BETWEEN 14 AND 31), 0)::BIGINT AS control,
    sum(n * n)::BIGINT AS squares, count(*) AS kinds, max(n) AS most
  FROM hist GROUP BY stream_id),
judged AS (
  SELECT *, total >= 256 AND squares / 256.0::DOUBLE - (total / 256.0::DOUBLE) * (total / 256.0::DOUBLE) < total / 256.0::DOUBLE * 1.5::DOUBLE AND kinds / 256.0::DOUBLE > 0.8 AND most / total < 0.1 AS random_like FROM facts),
contents AS (
  SELECT b.stream_id, octet_length(b.raw) AS bytes, coalesce(CASE WHEN text / total > 0.8 AND control / total < 0.1 THEN 'text' WHEN text / total < 0.3 AND random_like THEN 'random' ELSE 'binary' END, 'binary') AS content,
    coalesce(random_like, FALSE) AS random_like
  FROM blobs b LEFT JOIN judged USING (stream_id))"""
ROUND_TRIP = f"WITH {BLOBS} SELECT stream_id, octet_length(raw) AS bytes, sha256(raw) AS sha256 FROM blobs"
CHUNK = """CASE WHEN (raw // 300000) * 300000 >= 131072 THEN (raw // 300000) * 300000 ELSE raw END"""
SIZES = f"""{BLOBS},
sizes AS (SELECT stream_id, octet_length(raw) AS bytes, least(greatest(octet_length(raw) // 16, 524288), 8388608, greatest(octet_length(raw), 131072)) AS raw FROM blobs)"""
BENCH = "blobs AS (SELECT item_id AS stream_id, encode(coalesce(text, '')) AS raw FROM benchmark)"
WIDE = f"""{RESULTS},
wide AS (
  SELECT data_type, level, threads, max(speed) FILTER (tool = 'ours') AS speed, max(size) FILTER (tool = 'ours') AS size, max(median) FILTER (tool = 'ours') AS median,
    max(speed) FILTER (tool = 'pigz') AS pigz_speed, max(speed) FILTER (tool = 'igzip') AS igzip_speed, max(speed) FILTER (tool = 'gzip') AS gzip_speed,
    max(size) FILTER (tool = 'pigz') AS pigz_size, max(median) FILTER (tool = 'pigz') AS pigz_median, max(median) FILTER (tool = 'gzip') AS gzip_median
  FROM results GROUP BY ALL HAVING count(*) FILTER (tool = 'ours') > 0)"""
#: The checksum, a table step a byte; the table's entries by eight steps each.
CRC = f"""{BLOBS},
steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS s FROM range(256) AS r(i)),
digits AS (SELECT stream_id, octet_length(raw) AS bytes, list_transform(regexp_extract_all(hex(raw), '..'), lambda p: ('0x' || p)::BIGINT) AS d FROM blobs),
sums AS (SELECT stream_id, bytes, xor(list_reduce(list_prepend(4294967295, d), lambda a, b: xor(a // 256, s[xor(a % 256, b) + 1])), 4294967295) AS crc FROM digits, steps)"""
LEVELS = f"""{RESULTS},
levels AS (
  SELECT data_type, threads, tool, speed, size, CASE level WHEN 6 THEN 11 WHEN 7 THEN 9 ELSE level END AS level, CASE data_type WHEN 'A' THEN 'ours' ELSE lower(data_type) END AS source,
    {{'a': data_type, 'b': CASE level WHEN 6 THEN 11 WHEN 7 THEN 9 ELSE level END, 'c': threads}} AS o, level = 1 AND threads > 1 AS fast FROM results)"""
MEDIAN = "(s[(len(s) - 1) // 2 + 1] + s[len(s) // 2 + 1]) / 2"

ORACLES = {
    "byte_hist": f"WITH {HIST} SELECT * FROM hist",
    "entropy": f"""WITH {HIST}, sums AS (
      SELECT stream_id, sum(n)::BIGINT AS bytes, count(*) AS "distinct", round(abs(log2(sum(n)::DOUBLE) - sum(n * log2(n)) / sum(n)), 6) AS entropy FROM hist GROUP BY stream_id),
      filled AS (SELECT b.stream_id, coalesce(bytes, 0) AS bytes, coalesce("distinct", 0) AS "distinct", coalesce(entropy, 0) AS entropy FROM blobs b LEFT JOIN sums USING (stream_id))
      SELECT *, {LABEL} AS label FROM filled""",
    "content_type": f"WITH {SAMPLE} SELECT stream_id, content, random_like FROM contents",
    "canvas": f"""WITH {BLOBS},
      sized AS (SELECT stream_id, hex(raw) AS digits, greatest(ceil(octet_length(raw) / 64), 1)::BIGINT AS per FROM blobs),
      cells AS (SELECT stream_id, c::INT AS cell, digits[(2 * c * per + 1):(2 * (c + 1) * per)] AS part FROM sized, unnest(range(0, 64)) AS u(c)),
      bytes AS (SELECT stream_id, cell, unnest(regexp_extract_all(part, '..')) AS pair FROM cells WHERE part <> '')
      SELECT stream_id, cell, count(*) AS bytes, sum(('0x' || pair)::INT)::BIGINT // count(*) AS mean_byte FROM bytes GROUP BY ALL""",
    "tuning": f"""WITH {SAMPLE}, base AS (
      SELECT stream_id, bytes, content, CASE WHEN bytes <= 102400 THEN 32768 WHEN bytes <= 1048576 THEN 65536 WHEN bytes <= 10485760 THEN 131072 ELSE 524288 END AS base,
        least(greatest(bytes // 16, 524288), 8388608, greatest(bytes, 131072)) AS raw FROM contents)
      SELECT stream_id, bytes, content, 8 AS threads, CASE content WHEN 'text' THEN base WHEN 'binary' THEN base * 2 ELSE base // 2 END AS buffer,
        CASE WHEN bytes <= 65536 THEN 'single' ELSE 'parallel' END AS backend, {CHUNK} AS chunk FROM base""",
    "chunk_grid": f"""WITH {SIZES}, per AS (SELECT stream_id, bytes, {CHUNK} AS per FROM sizes WHERE bytes > 0)
      SELECT stream_id, (start // per)::INT AS chunk, start, least(per, bytes - start) AS size FROM (SELECT *, unnest(range(0, bytes, per)) AS start FROM per)""",
    "gzip_round_trip": ROUND_TRIP,
    "raw_round_trip": ROUND_TRIP,
    "zlib_round_trip": ROUND_TRIP,
    "stored_round_trip": ROUND_TRIP,
    "dict_chunks": ROUND_TRIP,
    "gzip_headers": f"WITH {BLOBS} SELECT stream_id, TRUE AS ok, NULL::VARCHAR AS name, 0 AS mtime, 255 AS os, 10 AS header_bytes, octet_length(raw) AS isize FROM blobs",
    "gzip_members": f"""WITH {BLOBS} SELECT stream_id, k AS member, octet_length(raw) AS isize, k * octet_length(raw) AS output_offset FROM blobs, (VALUES (0), (1)) AS v(k)""",
    "gzip_test": "SELECT doc_id AS stream_id, doc_id % 3 <> 0 AS ok FROM documents",
    "noise_bound": "SELECT doc_id AS stream_id, TRUE AS holds FROM documents",
    "token_sizes": f'WITH {BENCH} SELECT stream_id, octet_length(raw) AS bytes, octet_length(raw) AS "end" FROM blobs',
    "deflate64_round_trip": f"WITH {BENCH} SELECT stream_id, octet_length(raw) AS bytes, sha256(raw) AS sha256 FROM blobs",
    "index_seek": f"WITH {BENCH} SELECT stream_id, octet_length(raw) // 2 AS \"offset\", sha256(unhex(hex(raw)[(octet_length(raw) // 2 * 2 + 1):(octet_length(raw) // 2 * 2 + 200)])) AS sha256 FROM blobs",
    "token_sizes_documents": f'WITH {BLOBS} SELECT stream_id, octet_length(raw) AS bytes, octet_length(raw) AS "end" FROM blobs',
    "deflate64_documents": f"WITH {BLOBS} SELECT stream_id, octet_length(raw) AS bytes, sha256(raw) AS sha256 FROM blobs",
    "index_seek_documents": f"WITH {BLOBS} SELECT stream_id, octet_length(raw) // 2 AS \"offset\", sha256(unhex(hex(raw)[(octet_length(raw) // 2 * 2 + 1):(octet_length(raw) // 2 * 2 + 200)])) AS sha256 FROM blobs",
    "as_of_checkpoint": """WITH w AS (SELECT c_custkey AS stream_id, c_custkey * 7 AS "offset" FROM customer)
      SELECT w.stream_id, w."offset", coalesce(o.o_orderkey, -1) AS point FROM w ASOF LEFT JOIN orders o ON w.stream_id = o.o_custkey AND w."offset" >= o.o_orderkey""",
    "level_params": """SELECT * FROM (VALUES (0, 'stored', 0, 32, 0), (1, 'fast', 1, 32, 1), (2, 'greedy', 6, 10, 2), (3, 'lazy', 12, 14, 3), (4, 'greedy', 16, 30, 4),
      (5, 'lazy', 16, 30, 5), (6, 'lazy', 35, 65, 6), (7, 'lazy', 100, 130, 7), (8, 'lazy2', 300, 258, 8), (9, 'lazy2', 600, 258, 9),
      (10, 'near-optimal', 35, 75, 9), (11, 'near-optimal', 100, 150, 9), (12, 'near-optimal', 300, 258, 9)) AS t(level, strategy, depth, nice, used_level)""",
    "win_rate": f"WITH {CELLS} SELECT corpus_set, count(*) AS n, sum(win)::BIGINT AS wins, round(100.0::DOUBLE * sum(win) / count(*), 6) AS rate FROM won GROUP BY 1",
    "win_rate_sets": f"""WITH {CELLS.replace("won AS", "won AS MATERIALIZED")}, sets AS (
      SELECT rival, threads, level, count(*) FILTER (corpus_set = 'holdout') AS h, count(*) FILTER (corpus_set = 'board') AS b,
        sum(win) FILTER (corpus_set = 'holdout') AS hw, sum(win) FILTER (corpus_set = 'board') AS bw
      FROM won GROUP BY GROUPING SETS ((), (rival), (threads), (level), (rival, threads))),
      rates AS (SELECT *, round(100.0::DOUBLE * hw / nullif(h, 0), 6) AS hr, round(100.0::DOUBLE * bw / nullif(b, 0), 6) AS br FROM sets)
      SELECT coalesce(rival, 'all') AS rival, coalesce(threads::VARCHAR, 'all') AS threads, coalesce(level::VARCHAR, 'all') AS level,
        nullif(h, 0) AS holdout_n, hr AS holdout_rate, nullif(b, 0) AS board_n, br AS board_rate, round(hr - br, 6) AS delta FROM rates WHERE h + b > 0""",
    "overfit_alarm": f"""WITH {CELLS}, r AS (
      SELECT round(100.0::DOUBLE * sum(win) FILTER (corpus_set = 'holdout') / count(*) FILTER (corpus_set = 'holdout'), 6) AS holdout_rate,
        round(100.0::DOUBLE * sum(win) FILTER (corpus_set = 'board') / count(*) FILTER (corpus_set = 'board'), 6) AS board_rate FROM won)
      SELECT *, round(holdout_rate - board_rate, 6) AS delta, round(holdout_rate - board_rate, 6) <= -6 AS alarm FROM r""",
    "worst_members": f"""WITH {CELLS}, own AS (SELECT *, ours / rival_bytes AS ratio FROM won WHERE corpus_set = 'holdout'),
      worst AS (SELECT * FROM own WHERE win = 0 QUALIFY row_number() OVER (PARTITION BY file ORDER BY ratio DESC, rival DESC, level DESC, threads DESC) = 1)
      SELECT o.file, count(*) AS n, count(*) FILTER (o.win = 0) AS losses, coalesce(sum(o.ours - o.rival_bytes) FILTER (o.win = 0), 0)::BIGINT AS excess, round(100.0::DOUBLE * avg(o.win), 6) AS rate,
        any_value(w.rival) AS worst_rival, any_value(w.level) AS worst_level, any_value(w.threads) AS worst_threads, round(any_value(w.ratio), 6) AS worst_ratio
      FROM own o LEFT JOIN worst w USING (file) GROUP BY o.file""",
    "size_delta": f"""WITH {CELLS}, p AS (SELECT *, round(100.0::DOUBLE * (ours - rival_bytes) / rival_bytes, 6) AS pct FROM cells)
      SELECT count(*) AS n, count(*) FILTER (pct > 0) AS bigger, sum(ours - rival_bytes)::BIGINT AS total, max(pct) FILTER (pct > 0) AS worst_pct FROM p""",
    "seam_tax": f"""WITH {CELLS}, s AS (SELECT file, level, min(ours) FILTER (threads = 1) AS size_t1, min(ours) FILTER (threads = 4) AS size_t4 FROM cells WHERE corpus_set = 'board' OR threads = 4 GROUP BY ALL)
      SELECT *, size_t4 - size_t1 AS tax FROM s WHERE size_t1 IS NOT NULL AND size_t4 IS NOT NULL""",
    "ladder": f"""WITH {CELLS}, s AS (SELECT file, level, sum(ours)::BIGINT AS size FROM cells GROUP BY ALL),
      l AS (SELECT *, lag(size) OVER (PARTITION BY file ORDER BY level) AS before FROM s)
      SELECT *, size > before AS sags FROM l WHERE before IS NOT NULL""",
    "cliffs": f"""WITH {CELLS}, r AS (SELECT file, level, threads, rival, sum(ours) / sum(rival_bytes) AS ratio FROM cells GROUP BY ALL),
      pairs AS (
        SELECT 'file' AS axis, *, lead(file) OVER w AS "to", lead(ratio) OVER w AS next_ratio FROM r WINDOW w AS (PARTITION BY level, threads, rival ORDER BY file)
        UNION ALL BY NAME SELECT 'level' AS axis, *, lead(level::VARCHAR) OVER w AS "to", lead(ratio) OVER w AS next_ratio FROM r WINDOW w AS (PARTITION BY file, threads, rival ORDER BY level)
        UNION ALL BY NAME SELECT 'threads' AS axis, *, lead(threads::VARCHAR) OVER w AS "to", lead(ratio) OVER w AS next_ratio FROM r WINDOW w AS (PARTITION BY file, level, rival ORDER BY threads)
        UNION ALL BY NAME SELECT 'rival' AS axis, *, lead(rival) OVER w AS "to", lead(ratio) OVER w AS next_ratio FROM r WINDOW w AS (PARTITION BY file, level, threads ORDER BY rival)),
      kinds AS (SELECT *, CASE WHEN (ratio - 1) * (next_ratio - 1) < 0 THEN 'CROSS' WHEN abs(ratio - next_ratio) > 0.02 AND greatest(ratio, next_ratio) > 0.98 THEN 'NEAR-JUMP' END AS kind FROM pairs WHERE next_ratio IS NOT NULL)
      SELECT axis, file, level, threads, rival, "to", round(ratio, 6) AS ratio, round(next_ratio, 6) AS next_ratio, kind FROM kinds WHERE kind IS NOT NULL""",
    "won_ledger": f"""WITH {CELLS} SELECT file, level, threads, rival, rival_bytes - 20 AS rival_bytes, ours FROM cells WHERE corpus_set = 'board' AND ours > rival_bytes - 20""",
    "split_resolve": "SELECT DISTINCT p_brand FROM part",
    "guards_compress": f"""WITH {RESULTS}, g AS (
      SELECT data_type, level, threads, rival, 'speed_vs_pigz' AS metric, our_speed / speed AS ratio, 0.95::DOUBLE AS threshold, our_speed / speed >= 0.95 AS passed FROM against WHERE rival = 'pigz' AND speed > 0
      UNION ALL SELECT data_type, level, threads, rival, 'size_vs_pigz', our_size / size, CASE WHEN level >= 9 THEN 1.005::DOUBLE ELSE 1.02::DOUBLE END, our_size / size <= CASE WHEN level >= 9 THEN 1.005 ELSE 1.02 END FROM against WHERE rival = 'pigz' AND size > 0
      UNION ALL SELECT data_type, level, threads, rival, 'speed_vs_igzip', our_speed / speed, 1.0::DOUBLE, our_speed / speed >= 1.0 FROM against WHERE rival = 'igzip' AND level BETWEEN 1 AND 3 AND speed > 0)
      SELECT data_type, level, threads, rival, metric, round(ratio, 6) AS ratio, threshold, passed FROM g""",
    "guards_decompress": f"""WITH {RESULTS}, g AS (
      SELECT data_type, level, threads, rival, our_speed / speed AS ratio, CASE rival WHEN 'igzip' THEN CASE WHEN threads > 1 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END WHEN 'rapidgzip' THEN 0.99::DOUBLE ELSE 1.0::DOUBLE END AS threshold FROM against WHERE speed > 0)
      SELECT data_type, level, threads, rival, round(ratio, 6) AS ratio, threshold, ratio >= threshold AS passed FROM g""",
    "pivot_tool": f"""WITH {RESULTS} SELECT data_type, level, threads, max(speed) FILTER (tool = 'ours') AS ours, max(speed) FILTER (tool = 'pigz') AS pigz, max(speed) FILTER (tool = 'igzip') AS igzip,
      max(speed) FILTER (tool = 'gzip') AS gzip, max(speed) FILTER (tool = 'rapidgzip') AS rapidgzip FROM results GROUP BY ALL""",
    "ratio_ledger": f"""WITH {RESULTS} SELECT data_type, level, threads, rival, round(our_median / median, 6) AS ratio, CASE WHEN our_median / median > 1.03 THEN 'LOSS' WHEN our_median / median < 0.97 THEN 'WIN' ELSE 'TIE' END AS verdict FROM against""",
    "gap_analysis": f"""WITH {RESULTS}, g AS (SELECT data_type, level, threads, rival, round((our_speed / speed - 1) * 100, 6) AS gap FROM against WHERE rival NOT IN ('gzip', 'zopfli') AND speed > 0),
      s AS (SELECT *, CASE WHEN gap < 0 THEN 'loss' ELSE 'win' END AS side FROM g)
      SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'loss' THEN gap ELSE -gap END, data_type, level, threads, rival) AS rank FROM s QUALIFY rank <= 15""",
    "run_compare": f"""WITH {RESULTS}, o AS (SELECT * FROM results WHERE tool = 'ours'), c AS (
      SELECT a.data_type, a.level, round((b.speed / a.speed - 1) * 100, 6) AS change FROM o a JOIN o b USING (data_type, level) WHERE a.threads = 1 AND b.threads = 2 AND a.speed > 0)
      SELECT *, CASE WHEN change < -3 THEN 'regression' WHEN change > 3 THEN 'improvement' ELSE 'neutral' END AS class, abs(change) > 10 AS large FROM c""",
    "run_history": f"""WITH {RESULTS}, h AS (SELECT level AS run, count(*) AS n, count(*) FILTER (our_speed / speed - 1 >= 0) AS wins FROM against GROUP BY 1),
      r AS (SELECT *, round(100.0::DOUBLE * wins / n, 6) AS rate FROM h)
      SELECT *, round(rate - lag(rate) OVER (ORDER BY run), 6) AS change FROM r""",
    "bench_summary": f"""WITH {RUNS}, t AS (SELECT run, size, len(s)::INT AS trials, CASE WHEN len(s) > 4 THEN s[2:len(s) - 1] ELSE s END AS s FROM runs),
      m AS (SELECT *, len(s)::INT AS trimmed, list_avg(s) AS mean, CASE WHEN len(s) > 1 THEN list_aggregate(s, 'stddev_samp') ELSE 0 END AS sd, {MEDIAN} AS median,
        s[len(s) // 10 + 1] AS p10, s[least(len(s) - 1, len(s) * 9 // 10) + 1] AS p90 FROM t)
      SELECT run, size, trials, trimmed, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(CASE WHEN mean > 0 THEN sd / mean ELSE 1 END, 6) AS cv,
        round(size / median / 1e6, 9) AS mbps, round(size / p90 / 1e6, 9) AS p10_mbps, round(size / p10 / 1e6, 9) AS p90_mbps FROM m""",
    "robust_stats": f"""WITH {RUNS}, m AS (SELECT *, {MEDIAN} AS m FROM runs), k AS (SELECT run, len(s) AS n, s AS whole, list_filter(s, lambda x: x <= 2 * m) AS kept FROM m),
      c AS (SELECT run, n, CASE WHEN len(kept) < n // 2 THEN whole ELSE kept END AS s FROM k),
      f AS (SELECT run, n, {MEDIAN} AS median, CASE WHEN len(s) > 1 THEN list_aggregate(s, 'stddev_samp') ELSE 0 END AS sd, len(s)::INT AS kept FROM c)
      SELECT run, round(median, 6) AS median, round(sd, 6) AS sd, kept, n >= 3 AND (median = 0 OR sd / median <= 0.1) AS stable FROM f""",
    "span_totals": f'WITH {SPANS} SELECT name, count(*) AS n, sum("end" - start)::BIGINT AS total, max("end" - start) AS most FROM spans GROUP BY 1',
    "busy_wait_gap": f"""WITH {SPANS}, b AS (
      SELECT tid, coalesce(sum("end" - start) FILTER (name NOT IN ('view', 'click')), 0)::BIGINT AS busy, coalesce(sum("end" - start) FILTER (name IN ('view', 'click')), 0)::BIGINT AS wait, max("end") - min(start) AS life FROM spans GROUP BY 1)
      SELECT *, life - busy - wait AS gap, life - busy - wait >= -0.02 * life AS closed FROM b""",
    "wait_overlap": f"""WITH {SPANS} SELECT a.name, b.name AS other, count(*) AS n, sum(least(a."end", b."end") - greatest(a.start, b.start))::BIGINT AS total
      FROM spans a JOIN spans b ON a.start < b."end" AND b.start < a."end" WHERE a.name IN ('view', 'click') AND a.tid = 1 AND b.name NOT IN ('view', 'click') GROUP BY 1, 2""",
    "trace_diff": f"""WITH {SPANS}, t AS (SELECT name, coalesce(sum("end" - start) FILTER (tid % 2 = 0), 0)::BIGINT AS "left", coalesce(sum("end" - start) FILTER (tid % 2 = 1), 0)::BIGINT AS "right" FROM spans GROUP BY 1)
      SELECT *, "left" - "right" AS delta FROM t ORDER BY abs("left" - "right") DESC, name LIMIT 25""",
    "effective_cores": f'WITH {SPANS} SELECT sum("end" - start)::BIGINT AS total, max("end") - min(start) AS wall, round(sum("end" - start) / (max("end") - min(start)), 6) AS cores FROM spans',
    "inversions": f"""WITH {SPANS} SELECT (SELECT count(*) FROM spans) AS n, (SELECT count(*) FROM spans a JOIN spans b ON a.start < b.start AND a."end" > b."end") AS inversions""",
    "last_wave": f"""WITH {SPANS}, l AS (SELECT "end" - start AS length, row_number() OVER (ORDER BY start DESC, "end" DESC) AS nth, count(*) OVER () AS n FROM spans),
      w AS (SELECT any_value(ceil(n / 8))::BIGINT AS wave, avg(length) FILTER (nth <= ceil(n / 8)) AS last_mean, max(length) FILTER (nth <= ceil(n / 8)) AS last_most, avg(length) AS all_mean FROM l)
      SELECT wave, round(last_mean, 6) AS last_mean, last_most, round(all_mean, 6) AS all_mean, round(last_mean / all_mean, 6) AS ratio FROM w""",
    "pair_spans": f"WITH {MARKS} SELECT * FROM paired",
    "leaf_time": f"""WITH {MARKS} SELECT e.tid, b.name, sum(e.next - e.ts)::BIGINT AS total
      FROM (SELECT * FROM ended WHERE still > 0 AND next IS NOT NULL) e ASOF JOIN begun b ON e.tid = b.tid AND e.still = b.depth AND e.nth >= b.nth GROUP BY ALL""",
    "call_tree": f"""WITH {MARKS} SELECT parent, name, count(*) AS n, sum("end" - start)::BIGINT AS total FROM paired GROUP BY ALL""",
    "bit_residual": "SELECT doc_id AS stream_id, 0 AS residual_ours, 0 AS residual_theirs FROM documents",
    "block_sizes": f"WITH {BLOBS} SELECT stream_id, octet_length(raw) AS bytes, 1 AS last, TRUE AS ok FROM blobs",
    "cut_sizes": f"WITH {BLOBS} SELECT stream_id, octet_length(raw) AS bytes, TRUE AS whole FROM blobs",
    "listed_sizes": f"WITH {BLOBS} SELECT stream_id, octet_length(raw) AS bytes FROM blobs UNION ALL SELECT -1, sum(octet_length(raw))::BIGINT FROM blobs",
    "summary_compress": f"""WITH {WIDE} SELECT data_type, level, threads, speed, size, round((speed / pigz_speed - 1) * 100, 6) AS vs_pigz, round((speed / igzip_speed - 1) * 100, 6) AS vs_igzip, round((speed / gzip_speed - 1) * 100, 6) AS vs_gzip FROM wide""",
    "summary_decompress": f"""WITH {WIDE}, v AS (SELECT data_type, level, threads, speed, round((speed / pigz_speed - 1) * 100, 6) AS vs_pigz, round((speed / igzip_speed - 1) * 100, 6) AS vs_igzip, round((speed / gzip_speed - 1) * 100, 6) AS vs_gzip FROM wide),
      w AS (SELECT *, coalesce(vs_pigz >= -5, FALSE)::INT + coalesce(vs_igzip >= -5, FALSE)::INT + coalesce(vs_gzip >= -5, FALSE)::INT AS wins FROM v) SELECT *, wins >= 2 AS passed FROM w""",
    "validation_table": f"""WITH {WIDE} SELECT data_type, level, threads, median, round(gzip_median / median, 6) AS gzip_speedup, round(pigz_median / median, 6) AS pigz_speedup, round((size / pigz_size - 1) * 100, 6) AS size_change,
      (median / pigz_median - 1) * 100 > CASE WHEN level >= 7 THEN 5 ELSE 2 END AS slow, (size / pigz_size - 1) * 100 > CASE WHEN level >= 9 THEN 0.5 WHEN level >= 7 THEN 2 ELSE 8 END AS large FROM wide""",
    "route_check": f"WITH {WIDE} SELECT data_type, level, threads, round((median / pigz_median - 1) * 100, 6) AS change, (median / pigz_median - 1) * 100 <= 5 AS ok FROM wide WHERE pigz_median > 0",
    "scorecard": f"WITH {SCORES} SELECT count(*) FILTER (verdict = 'WIN') AS wins, count(*) FILTER (verdict <> 'WIN') AS losses, count(*) FILTER (verdict = 'WIN') * 100 // count(*) AS percent FROM scores",
    "loss_groups": f"""WITH {SCORES} SELECT *, CASE WHEN rival = 'igzip' AND contains(scenario, 'L1') THEN 'igzip_l1' WHEN contains(scenario, 'Tmax') AND contains(platform, 'decompress') AND rival IN ('rapidgzip', 'unpigz') THEN 'tmax_parallel'
      WHEN contains(scenario, 'Tmax') AND NOT contains(platform, 'decompress') THEN 'compress_scaling' WHEN gap > -3 THEN 'near_parity' ELSE 'other' END AS "group" FROM scores WHERE verdict <> 'WIN'""",
    "gap_cause": f"""WITH {SCORES} SELECT scenario, platform, rival, CASE WHEN contains(scenario, 'Tmax') AND rival = 'rapidgzip' AND NOT contains(scenario, 'bgzf') THEN 'No parallel single-member decompression. rapidgzip speculatively parallelizes.'
      WHEN contains(scenario, 'bgzf') AND contains(scenario, 'T1') THEN 'BGZF T1 overhead from parallel detection. Consider fast-path for T1.' WHEN contains(scenario, 'Tmax') AND contains(scenario, 'bgzf') THEN 'BGZF Tmax contention or decompressor allocation overhead.'
      WHEN contains(scenario, 'Tmax') AND contains(scenario, 'pigz') THEN 'Multi-member parallel not matching rapidgzip''s pipelining.' WHEN contains(scenario, 'compress') AND rival = 'igzip' THEN 'ISA-L uses hand-tuned SIMD assembly for compression.'
      WHEN contains(scenario, 'T1') AND rival = 'igzip' THEN 'ISA-L inflate uses hand-tuned x86 assembly.' ELSE 'Investigate with local profiling.' END AS cause FROM scores""",
    "compare_band": f"WITH {RESULTS} SELECT data_type, level, threads, rival, CASE WHEN our_speed / speed = 0 THEN 'none' WHEN our_speed / speed >= 1 THEN 'good' WHEN our_speed / speed >= 0.95 THEN 'close' WHEN our_speed / speed IS NOT NULL THEN 'bad' END AS band FROM against",
    "best_ratio": """WITH t AS (SELECT l_returnflag AS data_type, l_linenumber AS level, ['ours', 'pigz', 'igzip', 'gzip', 'rapidgzip'][(l_partkey % 5 + 1)::INT] AS tool, min(l_extendedprice) AS best, max(l_extendedprice) / min(l_extendedprice) - 1 AS spread FROM lineitem GROUP BY ALL),
      r AS (SELECT a.data_type, a.level, a.tool, a.best / b.best AS ratio, greatest(a.spread, b.spread) AS margin FROM t a JOIN t b USING (data_type, level) WHERE b.tool = 'ours')
      SELECT data_type, level, tool, round(ratio, 6) AS ratio, round(margin, 6) AS margin, CASE WHEN ratio < 1 - margin THEN 'WIN' WHEN ratio > 1 + margin THEN 'LOSS' ELSE 'TIE' END AS verdict FROM r""",
    "trials": "SELECT l_orderkey AS run, count(*) AS n, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1 HAVING bool_and(l_discount < 0.08)",
    "pin_match": f"""WITH {RESULTS}, o AS (SELECT data_type, level, threads, size, floor(speed)::BIGINT AS speed FROM results WHERE tool = 'ours'),
      l AS (SELECT data_type, level, threads, unnest(['size', 'speed']) AS field, unnest([size, speed])::VARCHAR AS v FROM o)
      SELECT data_type, level, field, p.v AS pinned, c.v AS "current" FROM (SELECT * FROM l WHERE threads = 1) p FULL JOIN (SELECT * FROM l WHERE threads = 2) c USING (data_type, level, field) WHERE p.v IS DISTINCT FROM c.v""",
    "perf_shape": f"""WITH {CELLS}, w AS (SELECT file, coalesce(sum(ours) FILTER (threads = 1), 0)::HUGEINT AS t1, coalesce(sum(ours) FILTER (threads = 4), 0)::HUGEINT AS t4, coalesce(sum(rival_bytes) FILTER (threads = 1), 0)::HUGEINT AS p1,
      coalesce(sum(rival_bytes) FILTER (threads = 4), 0)::HUGEINT AS p4 FROM cells GROUP BY 1) SELECT file, CASE WHEN p1 = 0 THEN t4 <= p4 ELSE t4 * p1 <= t1 * p4 END AS holds FROM w""",
    "sample_stratified": """WITH s AS (SELECT p_brand AS file, p_partkey AS block, p_partkey % 16 AS most_bits, CASE WHEN p_partkey % 16 <= 9 THEN 'shallow' WHEN p_partkey % 16 >= 13 THEN 'deep' ELSE 'typical' END AS stratum FROM part)
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY file, block) <= 10""",
    "dedup": f"""WITH {RESULTS}, r AS (SELECT data_type, level, threads, tool, CASE WHEN size % 5 > 0 THEN size % 7 END AS trials, size % 11 / 10.0::DOUBLE AS cv FROM results),
      l AS (SELECT data_type, level, list_reduce(list({{'threads': threads, 'tool': tool, 'trials': trials, 'cv': cv}} ORDER BY threads, tool), lambda k, x: CASE WHEN coalesce(x.trials, 0) > coalesce(k.trials, 0) OR coalesce(x.cv, 1) < coalesce(k.cv, 1) THEN x ELSE k END) AS k FROM r GROUP BY ALL)
      SELECT data_type, level, k.threads AS threads, k.tool AS tool, k.trials AS trials, k.cv AS cv FROM l""",
    "norm_results": f"""WITH {RESULTS} SELECT ['text', 'random', 'other'][(level % 3 + 1)::INT] || '.json' AS path, level, threads, CASE WHEN data_type <> 'N' THEN data_type ELSE ['text', 'random', 'unknown'][(level % 3 + 1)::INT] END AS data_type, tool, speed, size, median
      FROM results WHERE tool <> 'gzip'""",
    "log_summary": """WITH l AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS s FROM events GROUP BY 1)
      SELECT event_type, n, s[n // 2 + 1] AS p50, s[least(n - 1, floor(n * 0.95::DOUBLE)::BIGINT) + 1] AS p95, s[n] AS most FROM l""",
    "verdict": """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity % 8 AS e, l_discount * 10 AS c, l_partkey % 200 AS n, l_extendedprice % 8192 AS d, l_suppkey * 7 % 300 AS p FROM lineitem)
      SELECT l_orderkey, l_linenumber,
        CASE WHEN e > 7.8 AND c < 0.05 THEN 'random' WHEN e < 2.5 THEN 'constant' WHEN e < 4.5 AND c > 0.7 THEN 'text' WHEN e > 6.5 AND c > 0.6 THEN 'binary' WHEN c < 0.2 THEN 'unrepetitive' ELSE 'structured' END AS nature,
        CASE WHEN n >= 100 AND c > 0.05 THEN CASE WHEN d < 64 THEN 'neighbouring' WHEN d < 512 THEN 'section' WHEN d < 4096 THEN 'phrase' ELSE 'global' END END AS reach,
        CASE WHEN p >= 258 THEN 'capped' WHEN p >= 64 THEN 'solid' WHEN p >= 16 THEN 'short' ELSE 'none' END AS cap FROM v""",
    "human_sizes": f"""WITH {BLOBS} SELECT stream_id, CASE WHEN octet_length(raw) >= 1048576 THEN printf('%.1f', octet_length(raw) / 1048576.0::DOUBLE) || ' MiB' WHEN octet_length(raw) >= 1024 THEN printf('%.1f', octet_length(raw) / 1024.0::DOUBLE) || ' KiB' ELSE octet_length(raw)::VARCHAR || ' B' END AS human,
      ['gzip', 'zlib', 'zip', 'gzip', 'gzip'][(stream_id % 5 + 1)::INT] AS format FROM blobs""",
    "marked_blocks": f"""WITH {BLOBS}, starts AS (SELECT stream_id, octet_length(raw) AS n, unnest(range(0, greatest(octet_length(raw), 1), 1024)) AS start FROM blobs)
      SELECT stream_id, start // 1024 AS block, least(1024, n - start) AS isize, start AS output_offset, NULL::VARCHAR AS error FROM starts""",
    "marked_round_trip": f"WITH {BLOBS} SELECT stream_id, greatest((octet_length(raw) + 1023) // 1024, 1) AS members, octet_length(raw) AS bytes, sha256(raw) AS sha256 FROM blobs",
    "gzip_structure": f"WITH {BLOBS} SELECT stream_id, CASE WHEN stream_id % 4 = 0 THEN 'marked' WHEN stream_id % 4 < 3 THEN 'gzip' WHEN octet_length(raw) < 2 THEN 'too small' ELSE 'not gzip' END AS kind FROM blobs",
    "output_estimate": f"WITH {BLOBS} SELECT stream_id, octet_length(raw) AS bytes FROM blobs WHERE stream_id % 4 < 3",
    "gzip_route": "SELECT doc_id AS stream_id, 'single-parallel' AS route FROM documents",
    "mixed_routes": "SELECT doc_id AS stream_id, ['marked-parallel', 'members-grid', 'single-parallel'][(doc_id % 4 + 1)::INT] AS route FROM documents WHERE doc_id % 4 < 3",
    "gzip_named": f"""WITH {BLOBS}, named AS (SELECT *, CASE WHEN stream_id % 5 > 0 THEN 'doc-' || stream_id || '.txt' END AS name FROM blobs)
      SELECT stream_id, name, CASE WHEN stream_id % 7 > 0 THEN stream_id * 86461 ELSE 0 END AS mtime, 10 + coalesce(length(name) + 1, 0) AS header_bytes, octet_length(raw) AS isize FROM named""",
    "gzip_listing_detail": f"""WITH {CRC} SELECT stream_id, 'defla' AS method, printf('%08x', crc) AS crc,
      CASE WHEN stream_id % 7 > 0 AND stream_id > 0 THEN strftime(make_timestamp(stream_id * 86461 * 1000000), '%b ') || lpad(day(make_timestamp(stream_id * 86461 * 1000000))::VARCHAR, 2, ' ') || strftime(make_timestamp(stream_id * 86461 * 1000000), ' %H:%M') END AS date,
      bytes, CASE WHEN stream_id % 5 > 0 THEN 'doc-' || stream_id || '.txt' END AS name FROM sums""",
    "crc32": f"WITH {CRC} SELECT stream_id, crc AS crc32, bytes FROM sums",
    "code_lengths": "SELECT doc_id AS stream_id, TRUE AS ok, TRUE AS complete FROM documents",
    "saved": f"""WITH {CELLS}, p AS (SELECT *, (1 - ours / rival_bytes) * 100 AS percent FROM cells)
      SELECT corpus_set, file, level, threads, rival, round(percent, 6) AS percent, printf('%7.1f%%', round_even(least(greatest(percent, -99.9), 99.9), 1)) AS told FROM p""",
    "key_metrics": f"""WITH {LEVELS}
      SELECT round((min_by(speed, o) FILTER (tool = 'ours' AND fast) / min_by(speed, o) FILTER (tool = 'pigz' AND fast) - 1) * 100, 6) AS speed_vs_pigz,
        round((min_by(size, o) FILTER (tool = 'ours' AND level = 9) / min_by(size, o) FILTER (tool = 'pigz' AND level = 9) - 1) * 100, 6) AS size_vs_pigz,
        max(speed) FILTER (tool = 'ours') AS best_speed, min_by(source, {{'a': -speed, 'b': source}}) FILTER (tool = 'ours') AS best_source FROM levels""",
    "goals": f"""WITH {LEVELS}, g AS (
      SELECT 'packing speed' AS goal, min_by(speed, o) FILTER (tool = 'ours' AND fast) >= min_by(speed, o) FILTER (tool = 'pigz' AND fast) AS passed FROM levels
      UNION ALL SELECT 'packed size', min_by(size, o) FILTER (tool = 'ours' AND level = 9) <= 1.005 * min_by(size, o) FILTER (tool = 'pigz' AND level = 9) FROM levels
      UNION ALL SELECT 'smallest size', min_by(size, o) FILTER (tool = 'ours' AND level = 11) <= min_by(size, o) FILTER (tool = 'gzip' AND level = 11) FROM levels
      UNION ALL SELECT 'unpacking speed', min_by(speed, o) FILTER (tool = 'ours' AND source = 'ours') >= 300 FROM levels)
      SELECT * FROM g WHERE passed IS NOT NULL""",
    "single_member_goals": f"""WITH {RESULTS}, t AS (SELECT (threads + 10 * level)::INT AS threads, max(speed) FILTER (tool = 'ours' AND level <> 3) AS a, max(speed) FILTER (tool = 'rapidgzip') AS b FROM results WHERE data_type = 'R' GROUP BY 1)
      SELECT threads, a / b >= 0.99 AS passed FROM t WHERE a IS NOT NULL AND b > 0""",
    "reconcile": "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS outcomes_left, CASE WHEN o_orderkey % 6 > 0 AND o_orderkey % 7 + o_orderkey % 11 + o_orderkey % 13 + o_orderkey % 3 + (o_orderkey % 5 = 0)::INT > 0 THEN 0 END AS positions_left FROM orders",
    "lock_waits": f"""WITH {SPANS} SELECT CASE WHEN tid % 3 > 0 THEN 'lock-' || tid % 20 ELSE '<unknown>' END AS lock, count(*) AS n, sum("end" - start)::BIGINT AS total, max("end" - start) AS most FROM spans WHERE name = 'view' GROUP BY 1""",
    "alloc_sites": "SELECT event_type AS site, count(*) AS n, sum(CASE WHEN event_id % 4 > 0 THEN event_id % 4096 ELSE 0 END)::BIGINT AS bytes FROM events GROUP BY 1",
}
