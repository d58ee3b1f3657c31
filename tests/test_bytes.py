"""Codecs, walks and byte analysis against the standard codec and identities that must hold."""

import gzip
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.functions import labels
from siltworks.operators import bytestats, codec, deflate, lz, marked, seek
from siltworks.sources import blobs as sources
from siltworks.sources import fixtures

R = random.Random(4)
TEXTS = [b"", b"a", b"abc" * 400, bytes(R.randrange(256) for _ in range(3000)), b" ".join(b"%d word" % (k % 37) for k in range(900)), bytes(70_000)]


@pytest.fixture(scope="module")
def raws(spark):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(TEXTS)], "stream_id long, raw binary").cache()


def packed(spark, rows):
    return spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "stream_id long, packed binary")


@pytest.mark.parametrize("container", ["gzip", "zlib", "raw"])
@pytest.mark.parametrize("level", [0, 1, 6, 12])
def test_round_trips(raws, level, container):
    p = codec.compress(raws, level, container)
    assert {r.used_level for r in p.collect()} == {min(level, 9)}
    got = {r.stream_id: bytes(r.raw) for r in codec.decompress(p, container).collect()}
    assert got == dict(enumerate(TEXTS))


def test_malformed_blobs_are_error_rows(spark):
    good = gzip.compress(TEXTS[4], mtime=0)
    bad_crc = good[:-8] + bytes(4) + good[-4:]
    rows = [b"", b"plain", good, good[:-3], bad_crc, good[:40], good + good, good + bytes(20), good + b"junk", good[:10] + b"\x07" + good[11:]]
    got = {r.stream_id: r for r in codec.decompress(packed(spark, rows)).collect()}
    assert [got[i].error is None for i in range(len(rows))] == [True, True, True, False, False, False, True, True, False, False]
    assert bytes(got[1].raw) == b"" and got[6].members == 2 and bytes(got[7].raw) == TEXTS[4]
    assert bytes(codec.decompress(packed(spark, [b"plain"]), keep_non_gzip=True).head().raw) == b"plain"
    assert "more than 100 bytes" in codec.decompress(packed(spark, [good]), most=100).head().error
    walked = deflate.blocks(packed(spark, rows[2:6])).where("error is not null")
    assert {r.stream_id for r in walked.collect()} == {1, 3}


def test_headers_and_members(spark):
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(b"hello") + raw.flush()
    tail = zlib.crc32(b"hello").to_bytes(4, "little") + (5).to_bytes(4, "little")
    named = b"\x1f\x8b\x08\x1c" + (77).to_bytes(4, "little") + b"\x00\x03" + b"\x04\x00GZ\x00\x00" + b"na\xe9me\x00note\x00" + body + tail
    plain = gzip.compress(b"x" * 1000, mtime=0)
    h = {r.stream_id: r for r in codec.headers(packed(spark, [named, plain, b"short"])).collect()}
    assert (h[0].name, h[0].comment, h[0].mtime, h[0].extra, h[0].isize, h[0].os) == ("naéme", "note", 77, 4, 5, 3)
    assert h[0].header_bytes == len(named) - len(body) - 8 and h[1].header_bytes == 10 and not h[2].ok
    m = codec.members(packed(spark, [plain + named, plain]))
    assert [(r.member, r.start, r.isize, r.output_offset) for r in m.where("stream_id = 0").orderBy("member").collect()] == [(0, 0, 1000, 0), (1, len(plain), 5, 1000)]
    routes = {r.stream_id: r.route for r in codec.route(packed(spark, [named, plain * 8, plain * 2, plain]), 4).collect()}
    assert routes == {0: "marked-parallel", 1: "members-parallel", 2: "members-grid", 3: "single-parallel"}
    total = codec.listing(packed(spark, [plain, plain])).where("stream_id is null").head()
    assert total.bytes == 2000 and total.packed_bytes == 2 * len(plain)


@pytest.mark.parametrize("level", [0, 1, 6, 9])
def test_walks_fold_to_the_stream(spark, raws, level):
    p = codec.compress(raws, level).select("stream_id", "packed").cache()
    walked = deflate.blocks(p).cache()
    assert walked.where("error is not null").count() == 0
    fp = {r.stream_id: r for r in deflate.stream_fingerprints(walked, p).collect()}
    blocks = deflate.block_fingerprints(walked).groupBy("stream_id").agg(*[F.sum(c).alias(c) for c in ("header_bits", "data_bits", "literals", "matches", "span_bytes")])
    for b in blocks.collect():
        f = fp[b.stream_id]
        assert (b.header_bits, b.data_bits, b.literals, b.matches, b.span_bytes) == (f.header_bits, f.data_bits, f.literals, f.matches, f.decoded_bytes)
        assert f.decoded_bytes == len(TEXTS[b.stream_id])
        assert f.len3 + f.len4_7 + f.len8_15 + f.len16_31 + f.len32_257 + f.len258 == f.matches
        assert 0 <= 8 * f.file_bytes - 18 * 8 - f.header_bits - f.data_bits < 8
    t = deflate.tokens(walked).groupBy("stream_id").agg(F.sum("length").alias("n"))
    assert {r.stream_id: r.n for r in t.collect()} == {i: len(x) for i, x in enumerate(TEXTS) if x}


def test_bits_are_accounted_for(raws):
    a, b = (codec.compress(raws, n).select("stream_id", "packed") for n in (1, 9))
    size = lambda p: p.select("stream_id", F.octet_length("packed").cast("long").alias("file_bytes"))
    acc = deflate.bit_account(deflate.blocks(a), deflate.blocks(b), size(a), size(b)).groupBy("stream_id").agg(F.sum("bits_ours").alias("x"), F.sum("bits_theirs").alias("y"), F.min("bits_ours").alias("least"))
    sizes = {r.stream_id: r.file_bytes for r in size(a).collect()}, {r.stream_id: r.file_bytes for r in size(b).collect()}
    for r in acc.collect():
        assert (r.x, r.y) == (8 * sizes[0][r.stream_id], 8 * sizes[1][r.stream_id]) and r.least >= 0
    account = deflate.bit_account(deflate.blocks(a), deflate.blocks(b), size(a), size(b))
    assert {(r.residual_ours, r.residual_theirs) for r in deflate.bit_residual(account, size(a), size(b)).collect()} == {(0, 0)}
    wrong = size(a).withColumn("file_bytes", F.col("file_bytes") + 3)
    assert {(r.residual_ours, r.residual_theirs) for r in deflate.bit_residual(account, wrong, size(b)).collect()} == {(24, 0)}


def test_headers_beyond_the_limits_are_refused(spark):
    def bits(*fields):
        x = at = 0
        for value, width in fields:
            x, at = x | value << at, at + width
        return x.to_bytes((at + 7) // 8, "little")

    frame = lambda body: b"\x1f\x8b\x08" + bytes(7) + body + bytes(16)
    lengths = [(0, 3), (0, 3), (1, 3), *[(0, 3)] * 14, (1, 3)]  # of the code lengths: 18 and 1 have one bit each
    many, dist = (bits((1, 1), (2, 2), (30, 5), (0, 5), (15, 4)), bits((1, 1), (2, 2), (0, 5), (30, 5), (15, 4)))
    past = bits((1, 1), (2, 2), (0, 5), (0, 5), (14, 4), *lengths, *[(1, 1), (127, 7)] * 2)
    said = [r.error for r in deflate.blocks(packed(spark, [frame(many), frame(dist), frame(past)])).orderBy("stream_id").collect()]
    assert said == ["too many codes", "too many codes", "a repeat runs past the codes"]


def test_many_members_are_read_in_pieces(spark):
    data = b"".join(gzip.compress(bytes([k % 256]) * (k * 37), mtime=0) for k in range(3000)) + bytes(20)
    assert codec.unpack(data) == (b"".join(bytes([k % 256]) * (k * 37) for k in range(3000)), 3000)
    big = gzip.compress(R.randbytes(300_000) + bytes(500_000), mtime=0)
    assert len(codec.unpack(big * 2)[0]) == 1_600_000 and codec.unpack(big, most=800_000)[1] == 1
    with pytest.raises(ValueError):
        codec.unpack(big, most=799_999)
    found = codec.members(packed(spark, [data, big * 2, big[:-3]])).collect()
    assert sorted((r.stream_id, r.member, r.error) for r in found if r.stream_id) == [(1, 0, None), (1, 1, None), (2, 0, "truncated")]
    assert sum(r.length or 0 for r in found if r.stream_id == 0) == len(data) - 20


def test_deflate64(spark, raws):
    got = {r.stream_id: r for r in deflate.inflate64(codec.huffman_only(raws)).collect()}
    assert {i: bytes(r.raw) for i, r in got.items()} == dict(enumerate(TEXTS))

    def bits(*fields):  # the last length code means 3 and 16 more bits
        out, n = 0, 0
        for value, width in fields:
            out |= value << n
            n += width
        return out.to_bytes((n + 7) // 8, "little")

    rev = lambda v, n: int(format(v, f"0{n}b")[::-1], 2)
    stream = bits((1, 1), (1, 2), (rev(0x30 + ord("z"), 8), 8), (rev(0xC0 + 285 - 280, 8), 8), (40_000 - 3, 16), (0, 5), (0, 7))
    row = deflate.inflate64(packed(spark, [stream, stream[:-2]])).orderBy("stream_id").collect()
    assert bytes(row[0].raw) == b"z" * 40_001 and row[1].error


def test_seek_at_between_and_after_checkpoints(spark):
    text = bytes(R.randrange(97, 110) for _ in range(20_000))
    b = spark.createDataFrame([(1, bytearray(text))], "stream_id long, raw binary")
    framed = codec.framed(codec.reassembled(codec.chunked(b, 1000)), b).cache()
    assert gzip.decompress(bytes(framed.head().packed)) == text
    index = seek.index_build(framed, 3000).cache()
    points = [r.output_at for r in index.orderBy("point").collect()]
    assert points[0] == 0 and len(points) == 7 and seek.check_index(index).where("not ok").count() == 0
    offsets = [0, 1, points[1], points[1] - 1, points[2] + 5, 19_990, 20_000]
    wanted = spark.createDataFrame([(1, o, 50) for o in offsets] + [(9, 0, 1)], "stream_id long, offset long, size long")
    got = {(r.stream_id, r.offset): r for r in seek.index_seek(framed, index, wanted).collect()}
    assert all(bytes(got[1, o].part) == text[o : o + 50] for o in offsets) and got[9, 0].error
    two = framed.select("stream_id", F.concat("packed", "packed").alias("packed"))
    assert seek.index_build(two).head().error == "several members"


def cuts(data, window, mask, least, most):
    out, start, total = [], 0, 0
    for i, x in enumerate(data):
        total += x - (data[i - window] if i >= window else 0)
        n = i - start + 1
        if len(data) > least and n >= least and (total & mask == mask or n >= most):
            out.append(n)
            start = i + 1
    return out + ([len(data) - start] if start < len(data) or not data else [])


def test_rolling_cuts(spark):
    data = [bytes(R.randrange(256) for _ in range(n)) for n in (0, 10, 300, 5000, 20_000)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "stream_id long, raw binary")
    got = seek.rolling_cuts(df, 32, 0x1F, 100, 700).orderBy("stream_id", "block").collect()
    for i, x in enumerate(data):
        assert [r["size"] for r in got if r.stream_id == i] == cuts(x, 32, 0x1F, 100, 700)


def slow_lz(raw):
    table, out, i = {}, [], 0
    while i + 2 < len(raw):
        t = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
        h = (t * lz.FACTOR & 0xFFFFFFFF) >> 17
        p = table.get(h)
        table[h] = i
        if p is not None and 3 <= i - p < 32768 and raw[p : p + 3] == raw[i : i + 3]:
            n = 3
            while n < min(258, len(raw) - i) and raw[p + n] == raw[i + n]:
                n += 1
            out.append((i, n, i - p))
            i += n
        else:
            i += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300) | st.text("ab c", max_size=400).map(str.encode))
def test_lz_matches(raw):
    assert lz.matches_of(raw) == slow_lz(raw)
    out = bytearray()
    last = 0
    for pos, n, d in lz.matches_of(raw):
        out += raw[last:pos]
        for _ in range(n):
            out.append(out[-d])
        last = pos + n
    assert bytes(out + raw[last:]) == raw


def test_runs_of_period_one_and_two_have_no_matches():
    assert lz.matches_of(b"a" * 5000) == [] == lz.matches_of(b"ab" * 2000)
    assert len(lz.matches_of(b"ABCDEFGHIJ" * 3)) == 1


def test_analysis_card(spark, raws):
    card = {r.stream_id: r for r in lz.analysis_card(raws).collect()}
    assert card[0].entropy == 0 and card[0].matches == 0 and card[0].content == "binary"
    assert card[3].entropy_label == "MAX" and card[3].content == "binary" and card[5].entropy_label == "VERY LOW"
    assert card[4].cover > 0.5 and sum(card[4].length_buckets) == card[4].matches == sum(card[4].distance_buckets)
    assert card[4].outlook.mid == (card[4].outlook.low + card[4].outlook.high) / 2


def test_histograms_add_up(raws):
    got = bytestats.byte_hist(raws).collect()
    want = {(i, b): n for i, t in enumerate(TEXTS) for b, n in Counter(t).items()}
    assert {(r.stream_id, r.byte): r.n for r in got} == want


def test_labels(spark):
    e = spark.createDataFrame([(x,) for x in (2.4999, 2.5, 4.5, 6.5, 7.8)], "e double").select(labels.entropy_label(F.col("e")).alias("l"))
    assert [r.l for r in e.collect()] == ["VERY LOW", "LOW", "MEDIUM", "HIGH", "MAX"]
    d = spark.createDataFrame([(x,) for x in (3, 4, 5, 128, 129)], "n long").select(labels.bucket(F.col("n"), labels.LENGTH_ENDS).alias("b"))
    assert [r.b for r in d.collect()] == [0, 0, 1, 5, 6]
    names = spark.createDataFrame([("a.tgz",), ("b.txt.gz",), ("c-gz",), ("d_z",), ("e",)], "n string").select(labels.output_name(F.col("n")).alias("o"))
    assert [r.o for r in names.collect()] == ["a.tar", "b.txt", "c", "d", "e"]
    b = spark.range(1).select(labels.bar(F.lit(4.0), 8.0, 10).alias("b")).head().b
    assert b == "[█████     ]"


def test_files_traces_and_pins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(b"abc"))
    (tmp_path / "in" / "b.txt").write_bytes(b"plain")
    files = sources.routed(sources.from_files(spark, str(tmp_path / "in")))
    assert {(r.format, r.sniffed, r.refused) for r in files.collect()} == {("gzip", "gzip", False), ("gzip", "raw", True)}
    (tmp_path / "t.json").write_text('[\n{"name":"x","ph":"B","pid":1,"tid":2,"ts":1.5,"args":{"k":"v"}},\nnot json\n]')
    got = sources.read_trace(spark, str(tmp_path / "t.json")).collect()
    assert sum(r.bad for r in got) == 1 and any(r.name == "x" and r.args == {"k": "v"} for r in got)
    (tmp_path / "p.tsv").write_text("# note\nfixture\tlevel\ntext\t1\n")
    assert [tuple(r) for r in sources.read_pins(spark, str(tmp_path / "p.tsv"), "fixture string, level int").collect()] == [("text", 1)]
    declared, present = spark.createDataFrame([("a",), ("b",)], "m string"), spark.createDataFrame([("a",)], "m string")
    assert sources.complete_set(declared, declared, "m").count() == 2
    with pytest.raises(Exception, match="missing member: b"):
        sources.complete_set(declared, present, "m").collect()


def test_fixtures(spark):
    got = {r.stream_id: bytes(r.raw) for r in fixtures.blobs(spark, 20_000).collect()}
    assert set(got) == set(fixtures.KINDS) and {len(x) for x in got.values()} == {20_000}
    assert all(fixtures.make(k, 999, 1) == x[:999] for k, x in got.items())
    ratio = {k: len(zlib.compress(x)) / len(x) for k, x in got.items()}
    assert ratio["noise"] > 0.99 > ratio["binary"] and ratio["tabular"] < 0.6
    assert fixtures.surface(spark, 2048).count() == 16


def test_streaming_unpacks_what_arrives(spark, tmp_path):
    from siltworks.streaming import pipes

    (tmp_path / "in").mkdir()
    for i, x in enumerate((gzip.compress(b"one"), gzip.compress(b"two")[:-2])):
        (tmp_path / "in" / f"{i}.gz").write_bytes(x)
    q = pipes.write(pipes.unpacked(pipes.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.error is None for r in got) == [False, True] and any(r.raw and bytes(r.raw) == b"one" for r in got)


def test_walk_queries_cover_the_documents(spark, tmp_path):
    """One row a document where the queries name streams; long texts have blocks, and distances beyond 4096, that the small table can't."""
    from siltworks.plans import queries

    texts = ["", "short", " ".join(f"{k * 7919 % 10007} word" for k in range(9000)), "a" + "".join(chr(97 + R.randrange(26)) for _ in range(5000)) * 2]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fp = {r.stream_id: r for r in queries.stream_fingerprints(spark, str(tmp_path)).collect()}
    assert {i: r.decoded_bytes for i, r in fp.items()} == {i: len(t) for i, t in enumerate(texts)}
    assert fp[3].dist_gt4096 > 0 and fp[2].blocks_dynamic > 1
    sizes = {r.stream_id: (r.bytes, r.end) for r in queries.token_sizes_documents(spark, str(tmp_path)).collect()}
    assert sizes == {i: (len(t), len(t)) for i, t in enumerate(texts)}
    acc = queries.bit_account(spark, str(tmp_path)).where("class = 'frame'").collect()
    assert {r.stream_id for r in acc} >= {1, 2, 3}
    walked = queries.walk_blocks(spark, str(tmp_path))
    assert {r.stream_id for r in walked.collect()} == {0, 1, 2, 3} and walked.where("error is not null").count() == 0


def test_headers_read_long_names_and_comments_whole(spark):
    name, note, body = b"n" * 70_000, b"c" * 90_000, zlib.compress(b"x", wbits=-15)
    head = b"\x1f\x8b\x08\x18" + bytes(4) + b"\x00\x03"
    row = codec.headers(packed(spark, [head + name + b"\0" + note + b"\0" + body + bytes(8)])).head()
    assert (len(row.name), len(row.comment), row.header_bytes) == (70_000, 90_000, 10 + 70_001 + 90_001)


def field(name: bytes, payload: bytes) -> bytes:
    return name + len(payload).to_bytes(2, "little") + payload


def with_extra(extra: bytes, flag: int = 4, rest: bytes = b"body" + bytes(20)) -> bytes:
    return b"\x1f\x8b\x08" + bytes([flag]) + bytes(6) + len(extra).to_bytes(2, "little") + extra + rest


def test_marked_members_are_listed(spark, raws):
    files = {r.stream_id: bytes(r.packed) for r in marked.compress(raws, 1000).collect()}
    assert {i: gzip.decompress(x) for i, x in files.items()} == dict(enumerate(TEXTS))
    found = marked.blocks(packed(spark, [files[i] for i in range(len(TEXTS))])).collect()
    for i, t in enumerate(TEXTS):
        mine = sorted((r for r in found if r.stream_id == i), key=lambda r: r.block)
        assert [r.isize for r in mine] == [len(t[k : k + 1000]) for k in range(0, max(len(t), 1), 1000)]
        for r in mine:
            part = files[i][r.start : r.start + r.length]
            assert gzip.decompress(part) == t[r.output_offset : r.output_offset + r.isize]
            assert zlib.decompress(files[i][r.data_start : r.start + r.length - 8], -15) == t[r.output_offset : r.output_offset + r.isize]


def test_marks_of_odd_files(spark):
    one = marked.member(b"abc", 6)
    named = with_extra(field(b"GZ", (0).to_bytes(4, "little")))
    short = with_extra(field(b"XX", b"123") + field(b"GZ", (43).to_bytes(2, "little")), rest=bytes(20))  # two bytes: the length less one
    cases = [one + one[:-1], b"", gzip.compress(b"abc"), named, short, with_extra(field(b"BC", b"12")), with_extra(b"GZ\xff\xff"), None, b"\x1f", b"plain text without magic", one + gzip.compress(b"x")]
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(cases)], "stream_id long, packed binary")
    got = marked.blocks(rows).collect()
    assert {r.stream_id: sum(x.stream_id == r.stream_id for x in got) for r in got if r.error is None} == {0: 1, 4: 1, 10: 1}
    assert {r.stream_id for r in got if r.error} == {1, 2, 3, 5, 6, 7, 8, 9}
    kinds = {r.stream_id: (r.kind, r.magics) for r in marked.structure(rows).collect()}
    assert {i: k for i, (k, _) in kinds.items()} == {
        0: "marked", 1: "too small", 2: "single-member", 3: "marked", 4: "marked", 5: "marked-standard", 6: "single-member", 7: "too small", 8: "too small", 9: "not gzip", 10: "marked",
    }

    def magics(x: bytes) -> int:
        n = at = 0
        while (at := x.find(b"\x1f\x8b", at)) >= 0:
            n, at = n + 1, at + 10
        return n

    assert {i: n for i, (_, n) in kinds.items()} == {i: magics(x or b"") for i, x in enumerate(cases)}
    size = {r.stream_id: r.bytes for r in marked.output_estimate(rows).collect()}
    assert (size[0], size[1], size[2], size[7], size[8], size[10]) == (3, 0, 3, 0, 0, 3)
    routes = {r.stream_id: r.route for r in codec.route(packed(spark, [one, gzip.compress(b"x") * 2, gzip.compress(b"x")]), 1).collect()}
    assert routes == {0: "marked-parallel", 1: "members-in-order", 2: "single-parallel"}


def test_code_lengths_are_those_of_the_tables(spark, raws):
    p = codec.compress(raws, 6).select("stream_id", "packed")
    lens = {(r.stream_id, r.block): r for r in deflate.code_lengths(p).collect()}
    walked = deflate.blocks(p).drop("tokens").collect()
    assert set(lens) == {(r.stream_id, r.block) for r in walked}
    for r in walked:
        mine = lens[r.stream_id, r.block]
        assert (mine.btype, mine.start_bit, mine.body_bit, mine.end_bit) == (r.btype, r.start_bit, r.start_bit + r.header_bits, r.start_bit + r.header_bits + r.data_bits)
        assert r.table_fp is None or r.table_fp == deflate.table_hash(tuple(mine.literals), tuple(mine.distances))
        assert mine.literals is None or sum(2.0**-n for n in mine.literals if n) == 1
    assert deflate.code_lengths(packed(spark, [b"not gzip"])).head().error
    assert {r.error for r in deflate.code_lengths(spark.createDataFrame([(0, bytearray(gzip.compress(b"", 0)))], "stream_id long, packed binary")).collect()} == {None}


def test_listing_detail_and_names(spark):
    blobs = spark.createDataFrame([(0, bytearray(b"abc"), "a.txt", 1_709_164_859), (1, bytearray(b""), None, 0)], "stream_id long, raw binary, name string, mtime long")
    files = codec.framed(codec.compress(blobs, 6, "raw"), blobs, F.col("name"), F.col("mtime"))
    assert {gzip.decompress(bytes(r.packed)) for r in files.collect()} == {b"abc", b""}
    a, b = (tuple(r) for r in codec.listing_detail(files).orderBy("stream_id").collect())
    assert a == (0, "defla", f"{zlib.crc32(b'abc'):08x}", "Feb 29 00:00", len(files.where("stream_id = 0").head().packed), 3, -99.9, "a.txt")
    assert (b[2], b[3], b[5], b[6], b[7]) == ("00000000", None, 0, 0.0, None)


@pytest.mark.parametrize("size", [0, 1, 65_535, 65_536, 122_698, 400_000])
def test_stored_blobs_have_full_blocks(spark, size):
    from siltworks.operators import measure

    raw = R.randbytes(size)
    for container in ("gzip", "zlib", "raw"):
        x = codec.pack(raw, 0, container)
        assert codec.unpack(x, container) == (raw, 1)
        assert len(x) == size + 5 * max(1, -(-size // 65_535)) + {"gzip": 18, "zlib": 6, "raw": 0}[container]
    assert spark.range(1).select((F.lit(len(codec.pack(raw, 0))) <= measure.noise_bound(F.lit(size))).alias("holds")).head().holds


def test_packings_are_compared_where_they_meet(spark):
    """The same as by tokens as rows, which never leave the walk here: over several blocks, stored ones, members, bad blobs and missing ones."""
    long = " ".join(f"{k * 7919 % 10007} word" for k in range(9000)).encode()
    raws = [*TEXTS, long, R.randbytes(100_000), long[:70_000] + R.randbytes(70_000) + bytes(70_000)]
    ours, theirs = ([gzip.compress(x, n, mtime=0) for x in raws] for n in (1, 9))
    ours += [ours[6] + ours[4], gzip.compress(long, 0, mtime=0), ours[6][:-4000], b"junk", ours[4]]
    theirs += [theirs[6] + theirs[4], theirs[6], theirs[6], theirs[4], b""]
    a, b = packed(spark, ours), packed(spark, theirs).where("stream_id <> 3")
    size = lambda p: p.select("stream_id", F.octet_length("packed").cast("long").alias("file_bytes"))
    got, want = deflate.diverge_packed(a, b), deflate.diverge(deflate.tokens(deflate.blocks(a)), deflate.tokens(deflate.blocks(b)))
    assert sorted(got.collect(), key=str) == sorted(want.select(got.columns).collect(), key=str) and got.columns == want.columns
    got, want = deflate.bit_account_packed(a, b), deflate.bit_account(deflate.blocks(a), deflate.blocks(b), size(a), size(b))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str) and got.columns == want.columns


def exchanges(df):
    """What moves between tasks: the columns of each exchange of the plan."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan)), plan


def test_queries_over_walks_move_no_tokens(spark, tmp_path):
    from siltworks.plans import queries

    texts = ["", "short", " ".join(f"{k * 7919 % 10007} word" for k in range(3000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for q in (queries.diverge, queries.bit_account, queries.bit_residual):
        assert "pos#" not in exchanges(q(spark, str(tmp_path)))[1]
    assert "Window" not in exchanges(queries.token_sizes_documents(spark, str(tmp_path)))[1]
    assert {(r.residual_ours, r.residual_theirs) for r in queries.bit_residual(spark, str(tmp_path)).collect()} == {(0, 0)}


def test_times_beyond_four_bytes_are_no_times(spark):
    blobs = spark.createDataFrame([(0, bytearray(b"abc"), (1 << 32) - 1), (1, bytearray(b"abc"), 1 << 32), (2, bytearray(b"abc"), -1)], "stream_id long, raw binary, mtime long")
    files = codec.framed(codec.compress(blobs, 6, "raw"), blobs, mtime=F.col("mtime"))
    assert [r.mtime for r in codec.headers(files).orderBy("stream_id").collect()] == [(1 << 32) - 1, 0, 0]


def test_slices_are_bounded():
    import pyarrow as pa

    from siltworks.operators import batches

    raws = [b"x" * n for n in (0, 10, 90, 1, 500, 0, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raws))), pa.array(raws, pa.binary())], names=["stream_id", "raw"])
    parts = list(batches.slices([batch, batch.slice(0, 0), batch.slice(3)], "raw", most=100))
    assert [x for p in parts for x in p.column("raw").to_pylist()] == raws + raws[3:]
    assert all(p.num_rows == 1 or sum(len(x or b"") for x in p.column("raw").to_pylist()) <= 100 for p in parts)


def test_counts_of_the_walk_are_those_of_its_tokens(spark, raws):
    p = codec.compress(raws, 6).select("stream_id", "packed").union(packed(spark, [b"x" * 20]).select(F.lit(99).cast("long"), "packed"))
    fields = ["stream_id", "block", "error", *deflate.COUNTS]
    got, want = (sorted(map(str, deflate.counted(w).where("error is null").select(fields).collect())) for w in (deflate.blocks(p, counts=True), deflate.blocks(p)))
    assert got == want and len(got) >= len(TEXTS)
    assert "tokens" not in deflate.blocks(p, counts=True).columns


#: Python's step in a query: its input (raw or packed), and the operator that has the step.
STEPS = {
    "block_census": ("packed", lambda p: deflate.blocks(p, counts=True)),
    "lz_summary": ("raw", lz.lz_matches),
    "fingerprint_diff": ("raw", lambda b: codec.compress(b, 9)),
    "analysis_card": ("raw", lambda b: bytestats.byte_hist(b, bytestats.SAMPLE)),
    "token_sizes_documents": ("packed", deflate.blocks),
    "gzip_route": ("packed", codec.members),
    "dict_chunks": ("raw", lambda b: codec.chunked(b, 1024)),
    "zlib_round_trip": ("packed", lambda p: codec.decompress(p, "zlib")),
    "entropy": ("raw", bytestats.entropy),
    "gzip_listing": ("raw", lambda b: codec.listing(codec.compress(b))),
    "byte_hist": ("raw", bytestats.byte_hist),
    "gzip_round_trip": ("packed", codec.decompress),
    "match_histograms": ("packed", lambda p: deflate.match_histograms(deflate.tokens(deflate.blocks(p)))),
}


@pytest.mark.parametrize("query", STEPS)
def test_python_hands_on_a_slice_at_a_time(raws, monkeypatch, query):
    """A batch of blobs comes out in parts of bounded size: what a worker holds doesn't follow the batch."""
    import pyarrow as pa

    (column, step), found, plain = STEPS[query], [], type(raws).mapInArrow
    monkeypatch.setattr(type(raws), "mapInArrow", lambda self, f, schema: found.append(f) or plain(self, f, schema))
    step(raws.select("stream_id", F.col("raw").alias(column)))
    random_text = [bytes(R.choices(range(64, 128), k=1 << 16)) for _ in range(48)]
    made = random_text if column == "raw" else [zlib.compress(x) if query.startswith("zlib") else gzip.compress(x) for x in random_text]
    batch = pa.RecordBatch.from_arrays([pa.array(range(48)), pa.array(made, pa.binary())], names=["stream_id", column])
    parts = list(found[0](iter([batch])))
    assert len(parts) >= 3 and max(p.nbytes for p in parts) < 6 << 20
    assert pa.chunked_array([p.column("stream_id") for p in parts]).unique().to_pylist() == list(range(48))


#: Queries that walk and ask for no token.
WALKS = [
    "stream_fingerprints",
    "block_spans",
    "block_sizes",
    "block_fingerprints",
    "walk_blocks",
]


@pytest.mark.parametrize("query", WALKS)
def test_tokens_never_leave_walks_that_need_none(spark, query):
    from siltworks.plans import queries

    plan = getattr(queries, query)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "tokens#" not in plan


def test_spans_of_an_empty_document(spark, tmp_path):
    """Its only block makes no bytes: their spread is null, and no division by zero."""
    from siltworks.plans import queries

    spark.createDataFrame([(0, ""), (1, None), (2, "abc" * 50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.block_spans(spark, str(tmp_path)).orderBy("stream_id").collect()]
    assert got == [(0, 1, 0, 0, 0, 0.0, None), (1, 1, 0, 0, 0, 0.0, None), (2, 1, 150, 150, 150, 150.0, 0.0)]


#: Ids about the last whose time, id * 86,461 seconds, is within four bytes, one much later, and one without a time.
LATE = (49_674, 49_675, 49_676, 49_677, 256_409, 7 * 30_000)


@pytest.mark.parametrize("query", ["gzip_listing_detail", "gzip_named"])
def test_late_times_are_those_of_the_sql(spark, tmp_path, query):
    """Times that a header can't hold, beside those that it can."""
    import duckdb

    from siltworks import catalog

    spark.createDataFrame([(i, f"text {i}") for i in LATE], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[query])
    columns = [c[0] for c in found.description]
    got = catalog.queries()[query](spark, str(tmp_path)).select(*columns).orderBy("stream_id").collect()
    assert [tuple(r) for r in got] == sorted(found.fetchall())


def test_a_header_s_time_comes_before_the_file_s(spark):
    blobs = spark.createDataFrame([(i, bytearray(b"abc"), t) for i, t in enumerate((5, 0, 1 << 32))], "stream_id long, raw binary, mtime long")
    for keep, want in (F.lit(9), [5, 9, 9]), (F.lit(None).cast("long"), [5, 0, 0]):
        files = codec.framed(codec.compress(blobs, 6, "raw"), blobs, mtime=F.col("mtime"), keep=(keep.alias("file_time"),))
        assert [r.mtime for r in codec.headers(files).orderBy("stream_id").collect()] == want


def flushed(raw, level, strategy, size, flush):
    """A gzip blob of chunks that end with ``flush``."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15, 1, strategy)
    body = b"".join(c.compress(raw[k : k + size]) + c.flush(flush) for k in range(0, len(raw), size)) + c.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")


@pytest.mark.parametrize("flush", [zlib.Z_NO_FLUSH, zlib.Z_SYNC_FLUSH, zlib.Z_PARTIAL_FLUSH, zlib.Z_BLOCK])
def test_checkpoints_are_the_walk_s(flush):
    """What the codec says of blocks' ends is what walking them says, where they are near and where they are far."""
    words = " ".join(R.choice(("the", "window", "of", "bits")) + str(R.randrange(99)) for _ in range(4000)).encode()
    for raw in (b"", b"a", words, R.randbytes(30_000), b"\0\0\xff\xff" * 9000):
        for level, strategy in ((0, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_FIXED), (9, zlib.Z_HUFFMAN_ONLY)):
            data = flushed(raw, level, strategy, 128, flush)
            for interval in (1, 512, 5000):
                want, out, reached = [], 0, 0
                for start, head, bits, _, final, _, tokens in deflate.walk(data, 10):
                    out, end = out + int(deflate.spans_of(tokens).sum()), start + head + bits
                    if not final and end % 8 == 0 and out - reached >= interval:
                        want.append((10 + end // 8, out))
                        reached = out
                assert list(seek.block_ends(data, 10, interval)) == [*want, (len(data) - 8, -1)]


def test_flushed_chunks_are_indexed_without_a_walk(monkeypatch):
    def refused(*_):
        raise AssertionError("walked")

    text = " ".join(str(k * 7919 % 10007) for k in range(9000)).encode()
    data = flushed(text, 6, zlib.Z_DEFAULT_STRATEGY, 128, zlib.Z_SYNC_FLUSH)
    monkeypatch.setattr(deflate, "walk", refused)
    found, frame = [], type("Frame", (), {"columns": ["stream_id", "packed"], "schema": {"stream_id": type("Id", (), {"dataType": type("T", (), {"simpleString": lambda: "long"})})}})()
    frame.select, frame.mapInArrow = lambda *_: frame, lambda f, schema: found.append(f)
    seek.index_build(frame, 512)
    import pyarrow as pa

    (rows,) = found[0](iter([pa.RecordBatch.from_arrays([pa.array([3]), pa.array([data], pa.binary())], names=["stream_id", "packed"])]))
    assert rows.column("error").null_count == rows.num_rows == len(text) // 512 + 1


def test_histories_reach_over_batches(spark):
    text = bytes(R.randrange(97, 110) for _ in range(80_000))
    blobs = spark.createDataFrame([(k, bytearray(text[: 20_000 * k])) for k in range(5)], "stream_id long, raw binary")
    index = seek.index_build(codec.framed(codec.reassembled(codec.chunked(blobs, 500)), blobs), 1000).cache()
    places = [(k, min(o, 20_000 * k), 9) for k in range(5) for o in (0, 999, 1000, 1001, 33_000, 70_001, 80_000)] + [(9, 5, 9), (None, 5, 9)]
    wanted = spark.createDataFrame(places, "stream_id long, offset long, size long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = seek.histories(wanted, index).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, ((r.stream_id, r.offset, r["size"]) for r in got))) == sorted(map(str, places))
    as_of = {(r.stream_id, r.offset): (r.point, r.input_at, r.output_at) for r in seek.as_of(wanted, index.drop("window")).collect()}
    for r in got:
        assert as_of[r.stream_id, r.offset] == (r.point, r.input_at, r.output_at)
        assert r.history is None and r.point is None if r.stream_id in (9, None) else bytes(r.history) == text[max(0, r.output_at - 32_768) : r.output_at]


def test_index_seek_reads_its_index_once(spark):
    from siltworks.plans import queries

    plan = queries.index_seek(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("points(") == 1
