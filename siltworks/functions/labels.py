"""Labels, buckets and routes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends (exclusive) and their labels.
ENTROPY_LABELS = ((2.5, "VERY LOW"), (4.5, "LOW"), (6.5, "MEDIUM"), (7.8, "HIGH"), (None, "MAX"))
COVER_LABELS = ((0.05, "NONE"), (0.30, "LOW"), (0.60, "MEDIUM"), (0.85, "HIGH"), (None, "EXTREME"))
#: The band of sizes in percent that goes with a cover.
OUTLOOK = ((0.05, 96, 100), (0.30, 70, 92), (0.60, 50, 70), (0.85, 25, 50), (None, 8, 25))
#: Upper ends (inclusive) of the match length and distance buckets.
LENGTH_ENDS = (4, 8, 16, 32, 64, 128)
DISTANCE_ENDS = (8, 64, 512, 4096)
#: Name endings by format.
ENDINGS = {"gzip": ("gz", "gzip", "tgz", "taz", "z"), "zlib": ("zz",), "zip": ("zip",)}


def below(value: Column, steps: Sequence[tuple[float | None, object]]) -> Column:
    """The value of the first step whose upper end (exclusive) lies above ``value``; an end of None is the last."""
    out = None
    for end, label in steps:
        if end is None:
            return (F.lit(label) if out is None else out.otherwise(F.lit(label)))
        out = F.when(value < end, F.lit(label)) if out is None else out.when(value < end, F.lit(label))
    return out


def entropy_label(entropy: Column) -> Column:
    return below(entropy, ENTROPY_LABELS)


def cover_label(cover: Column) -> Column:
    return below(cover, COVER_LABELS)


def outlook(cover: Column, compressed: Column, raw: Column) -> Column:
    """(observed, low, mid, high) percent of the raw size: what was observed, or the band that goes with the cover."""
    low, high = below(cover, [(e, float(lo)) for e, lo, _ in OUTLOOK]), below(cover, [(e, float(hi)) for e, _, hi in OUTLOOK])
    seen = 100.0 * compressed / F.greatest(raw, F.lit(1))
    return F.struct(seen.alias("observed"), low.alias("low"), ((low + high) / 2).alias("mid"), high.alias("high"))


def bucket(value: Column, ends: Sequence[int]) -> Column:
    """The number of the first inclusive upper end that holds ``value``; past the last, their count."""
    return below(value, [*((end + 1, i) for i, end in enumerate(ends)), (None, len(ends))])


def verdict(entropy: Column, cover: Column, matches: Column, mean_distance: Column, peak: Column) -> Column:
    """(nature, reach, cap): what kind of data it is, how far its repeats reach (null unless there are enough) and how long they get."""
    nature = (
        F.when((entropy > 7.8) & (cover < 0.05), "random")
        .when(entropy < 2.5, "constant")
        .when((entropy < 4.5) & (cover > 0.7), "text")
        .when((entropy > 6.5) & (cover > 0.6), "binary")
        .when(cover < 0.2, "unrepetitive")
        .otherwise("structured")
    )
    reach = F.when((matches >= 100) & (cover > 0.05), below(mean_distance, [(64, "neighbouring"), (512, "section"), (4096, "phrase"), (None, "global")]))
    cap = F.when(peak >= 258, "capped").when(peak >= 64, "solid").when(peak >= 16, "short").otherwise("none")
    return F.struct(nature.alias("nature"), reach.alias("reach"), cap.alias("cap"))


def buffer_size(size: Column, content: Column) -> Column:
    base = below(size, [(102_401, 32_768), (1_048_577, 65_536), (10_485_761, 131_072), (None, 524_288)])
    return F.when(content == "text", base).when(content == "binary", base * 2).otherwise((base / 2).cast("int"))


def thread_count(requested: Column, cpus: Column, size: Column, level: Column) -> Column:
    """All of the threads asked for that there are; half for small inputs at levels 2 to 5."""
    most = F.least(requested, cpus)
    return F.when(level.between(2, 5) & (size <= 102_400), F.greatest(F.floor(most / 2), F.lit(1))).otherwise(most).cast("int")


def backend(size: Column, threads: Column) -> Column:
    return F.when((size > 65_536) & (threads > 1), "parallel").otherwise("single")


def numa_pinning(threads: Column, size: Column) -> Column:
    return (threads >= 4) & (size >= 10_485_760)


def chunk_size(size: Column, threads: Column) -> Column:
    """Bytes of a compression chunk: two chunks a thread, 512 KiB to 8 MiB, 128 KiB for tiny inputs, cut to whole blocks of 300,000 bytes."""
    fair = F.floor(size / (F.greatest(threads, F.lit(1)) * 2))
    raw = F.least(F.greatest(fair, F.lit(512 << 10)), F.lit(8 << 20), F.greatest(size, F.lit(128 << 10)))
    whole = F.floor(raw / 300_000) * 300_000
    return F.when(whole >= 128 << 10, whole).otherwise(raw).cast("long")


def sniff(raw: Column) -> Column:
    """The kind by the first bytes: gzip, zlib or raw."""
    first = F.hex(F.substring(raw, 1, 2))
    return F.when(first == "1F8B", "gzip").when(F.startswith(first, F.lit("78")), "zlib").otherwise("raw")


def format_by_extension(name: Column) -> Column:
    ending = F.lower(F.element_at(F.split(name, "[.]"), -1))
    out = None
    for kind, endings in ENDINGS.items():
        out = F.when(ending.isin(*endings), kind) if out is None else out.when(ending.isin(*endings), kind)
    return out.otherwise("gzip")


def little_endian(raw: Column, at: Column | int, width: int) -> Column:
    """The unsigned integer of ``width`` bytes from the 1-based place on."""
    return F.conv(F.hex(_reversed(raw, at, width)), 16, 10).cast("long")


def _reversed(raw: Column, at: Column | int, width: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.concat(*[F.substring(raw, at + k, F.lit(1)) for k in reversed(range(width))])


def isize(raw: Column) -> Column:
    """The last member's size modulo 2^32, from the last four bytes; null below 18 bytes."""
    return F.when(F.octet_length(raw) >= 18, little_endian(raw, F.octet_length(raw) - 3, 4))


def human_bytes(n: Column, units: Sequence[str] = ("B", "KiB", "MiB", "GiB", "TiB"), step: int = 1024) -> Column:
    """Bytes with one decimal (ties to even) in the largest unit that leaves one or more; plain below the first step."""
    out = F.concat(n.cast("string"), F.lit(f" {units[0]}"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(n >= step**k, F.concat(F.format_string("%.1f", F.bround(n / float(step**k), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def saved_percent(before: Column, after: Column) -> Column:
    """How many percent smaller, 0 for nothing before."""
    return F.when(before > 0, (1 - after / before) * 100).otherwise(0.0)


def saved_text(before: Column, after: Column) -> Column:
    """The saved percentage between -99.9 and 99.9, seven characters wide; a loss that rounds to nothing keeps its sign."""
    held = F.greatest(F.least(saved_percent(before, after), F.lit(99.9)), F.lit(-99.9))
    return F.format_string("%7.1f%%", F.when(held < 0, -F.bround(-held, 1)).otherwise(F.bround(held, 1)))


def bar(value: Column, most: float, width: int) -> Column:
    """A bar of eighths of a character, in brackets."""
    eighths = F.round(F.greatest(F.least(value / most, F.lit(1.0)), F.lit(0.0)) * width * 8).cast("int")
    part = F.substring(F.lit("▁▂▃▄▅▆▇█"), F.greatest(eighths % 8, F.lit(1)), F.lit(1))
    filled = F.concat(F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int")), F.when((eighths % 8 > 0) & (eighths < width * 8), part).otherwise(F.lit("")))
    return F.concat(F.lit("["), F.rpad(filled, width, " "), F.lit("]"))


def output_name(name: Column, ending: str = ".gz") -> Column:
    """The name without its compressed ending; archives keep ``.tar``."""
    archive = F.regexp_replace(name, r"(?i)\.(tgz|taz)$", ".tar")
    return F.when(archive != name, archive).otherwise(F.regexp_replace(name, r"(?i)(\.gz|\.gzip|\.zz|\.zip|\.z|-gz|-z|_z)$", ""))
