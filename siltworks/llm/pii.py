"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Base spans are those of the four kinds' regular expressions that pass the kind's test; they always stay. Candidates are
all matches of these expressions, failing ones too, and of looser forms (``[at]`` addresses, numbers without a country
code, IPv6, dotted cards). Each labeler votes yes, no or nothing on each candidate: strict form, checksum or range,
gazetteers of endings, issuers, country codes and blocks of addresses, words around it that speak for its kind, words that speak against it. Votes are
counted by pattern (at most 4 x 3^5 rows, whatever the table's size); EM over that table estimates the labelers'
reliabilities by kind, silence being an answer too. Its posteriors train a logistic classifier on votes, kind and shape, again over counted rows, which is
applied as a column expression: a candidate of ``accept`` or more that overlaps no base span is added.

DataFrame operations only; texts aren't shuffled. Results in odd cases: a null text is empty; a document without spans has
zeros and empty lists. Rows that repeat an id and text get the same result each. An empty table gives no rows, and one
without candidates trains nothing and adds nothing. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltworks.llm.common import cut

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

#: Regular expressions of the base spans. Possessive forms and look-behinds only keep the search linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the expression to match at all.
GUARD = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Looser forms, for candidates that the base expressions don't match.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./-])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_GUARD = {"email": r"[\[(]at[\])]", "ip": LOOSE["ip"], "card": r"[0-9]{4}[./][0-9]{4}[./]", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}

#: Fixed values, gazetteers. Endings of addresses besides the two-letter ones of countries.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "museum", "coop", "aero", "mobi", "jobs", "travel", "app", "dev", "online", "site", "shop", "blog", "cloud")
#: First digits of card issuers, from and to, and the digits of their cards.
ISSUERS = ((34, 34, 15), (37, 37, 15), (36, 36, 14), (300, 305, 14), (4, 4, 16), (4, 4, 19), (51, 55, 16), (2221, 2720, 16), (6011, 6011, 16), (644, 649, 16), (65, 65, 16), (3528, 3589, 16), (62, 62, 16), (62, 62, 19))
#: Country codes of one and two digits, and the first two digits of those of three.
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
CALLING_OF_THREE = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
#: Blocks of addresses that name no host of a person: this network, loopback, link-local, multicast, reserved.
NO_HOST = r"^(?:0+\.|127\.|169\.254\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)|^(?:0{1,4}:){7}|^[fF][eEfF]"
#: Words around a span that speak for its kind, and words before it that speak against any.
FOR = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|write|address|reach|reply)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|login|logged|client|address|peer)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|paid|charge|account)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|dial|text|reach)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|item|part|serial|build|release|section|page|figure|doi|sku|ticket|ref)\b|[$€£]\x20?$"
AROUND = 40

LABELERS = ("form", "check", "gazetteer", "context_for", "context_against")


@dataclass(frozen=True)
class Params:
    rounds: int = 50
    accept: float = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def passes(kind: Column, m: Column) -> Column:
    """Whether a match of the kind's base expression is a base span."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    ip = F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    card = F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    phone = F.length(_digits(m)).between(10, 15)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, base, start, end, match, before, after): every match, by code points, with the text around it."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null")
    found = []
    for kind in KINDS:
        for base, regex, guard in ((True, BASE[kind], GUARD[kind]), (False, LOOSE[kind], LOOSE_GUARD[kind])):
            pieces = F.struct(
                F.lit(kind).alias("kind"),
                F.lit(base).alias("base"),
                F.split("text", regex, -1).alias("pieces"),
                F.regexp_extract_all("text", F.lit(regex), F.lit(0)).alias("matches"),
            )
            holds = F.contains("text", F.lit(guard)) if guard == "@" else F.rlike("text", F.lit(guard))
            found.append(F.when(holds, pieces))
    each = keyed.select("doc_id", "h", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).where(F.size("f.matches") > 0)
    # a piece goes before each match and after it
    zipped = F.transform(
        F.col("f.matches"),
        lambda m, i: F.struct(
            m.alias("match"),
            F.length(F.get("f.pieces", i)).alias("gap"),
            F.right(F.get("f.pieces", i), F.lit(AROUND)).alias("before"),
            F.left(F.get("f.pieces", i + 1), F.lit(AROUND)).alias("after"),
        ),
    )
    rows = each.select("doc_id", "h", "f.kind", "f.base", F.posexplode(zipped).alias("k", "m")).select("doc_id", "h", "kind", "base", "k", "m.*")
    rows = rows.dropDuplicates(["doc_id", "h", "kind", "base", "k"])
    within = Window.partitionBy("doc_id", "h", "kind", "base").orderBy("k")
    end = F.sum(F.col("gap") + F.length("match")).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", end)
    return rows.select("doc_id", "h", "kind", "base", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after")


def listed(kind: Column, m: Column, base: Column) -> Column:
    """Whether a match is in the gazetteer of its kind: ending, issuer, country code (or area code, without one), kind of address."""
    digits = _digits(m)
    ending = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    issued = F.lit(False)
    for low, high, n in ISSUERS:
        issued |= (F.length(digits) == n) & F.left(digits, F.lit(len(str(low)))).cast("int").between(low, high)
    code = F.left(digits, F.lit(1)).isin("1", "7") | F.left(digits, F.lit(2)).isin(*CALLING) | F.left(digits, F.lit(2)).isin(*CALLING_OF_THREE)
    area = F.rlike(digits, F.lit(r"^[2-9][0-8]"))
    return (
        F.when(kind == "email", ending.isin(*ENDINGS) | (F.length(ending) == 2))
        .when(kind == "ip", ~F.rlike(m, F.lit(NO_HOST)))
        .when(kind == "card", issued)
        .otherwise(F.when(base, code).otherwise(area))
    )


def voted(found: DataFrame) -> DataFrame:
    """``found`` with ``ok`` (a base span) and a vote of each labeler: 1, 0 or null; and whether it overlaps a base span."""
    m, kind = F.col("match"), F.col("kind")
    near = lambda side: F.coalesce(*[F.when(kind == k, F.rlike(side, F.lit(v))) for k, v in FOR.items()])
    check = F.when(kind == "card", F.call_function("luhn_check", _digits(m)) & F.length(_digits(m)).between(13, 19)).when(
        kind == "phone", F.length(_digits(m)).between(10, 15)
    ).when((kind == "ip") & F.col("base"), passes(kind, m))
    length = F.length(_digits(m))
    shape = F.when(kind.isin("card", "phone"), F.least(length, F.lit(20))).otherwise(F.least((F.length(m) / 8).cast("int"), F.lit(8)))
    out = found.select(
        "*",
        (F.col("base") & passes(kind, m)).alias("ok"),
        F.col("base").cast("int").alias("form"),
        check.cast("int").alias("check"),
        listed(kind, m, F.col("base")).cast("int").alias("gazetteer"),
        F.when(near(F.col("before")) | near(F.col("after")), 1).alias("context_for"),
        F.when(F.rlike("before", F.lit(AGAINST)), 0).alias("context_against"),
        shape.cast("int").alias("shape"),
    )
    # the furthest end of the base spans that start before this one does, and the nearest start of those after
    spans = Window.partitionBy("doc_id", "h").orderBy("start")
    reach = F.max(F.when(F.col("ok"), F.col("end"))).over(spans.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(F.col("ok"), F.col("start"))).over(spans.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    overlaps = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    return out.withColumn("overlaps", overlaps)


def reliabilities(counts: list[tuple], rounds: int) -> tuple[dict, dict]:
    """EM over rows (kind, votes, n): the posterior of each (kind, votes), and rates.

    A labeler says nothing, no or yes; in each kind and class it has a chance of each of the three, so that silence and
    votes that only ever go one way tell as well. ``rates[kind, labeler]`` has these chances for both classes, ``rates[labeler]`` the
    share of yes among its votes in either class, over all kinds. Posteriors start as the share of yes votes, and at 0.1 where the checksum or range fails, so that the classes can't change places.
    """
    check = LABELERS.index("check")
    share = lambda v: (0.5 + sum(x for x in v if x is not None)) / (1 + sum(x is not None for x in v))
    post = {(k, v): 0.1 if v[check] == 0 else share(v) for k, v, _ in counts}
    told = lambda x: 0 if x is None else 1 + x
    rates: dict = {}
    for _ in range(rounds):
        prior = {}
        for k in {kind for kind, *_ in counts}:
            own = [(v, post[kk, v], n) for kk, v, n in counts if kk == k]
            prior[k] = (1 + sum(p * n for _, p, n in own)) / (2 + sum(n for *_, n in own))
            for j, name in enumerate(LABELERS):
                seen = [[1.0] * 3, [1.0] * 3]  # of class 0 and 1, with one imagined answer of each
                for v, p, n in own:
                    seen[0][told(v[j])] += n * (1 - p)
                    seen[1][told(v[j])] += n * p
                rates[k, name] = tuple(tuple(x / sum(c) for x in c) for c in seen)
        for k, v, _ in counts:
            logit = math.log(prior[k] / (1 - prior[k]))
            for name, x in zip(LABELERS, v, strict=True):
                logit += math.log(rates[k, name][1][told(x)] / rates[k, name][0][told(x)])
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    for j, name in enumerate(LABELERS):
        yes = [[1.0, 2.0], [1.0, 2.0]]
        for k, v, n in counts:
            if v[j] is not None:
                for c, p in ((0, 1 - post[k, v]), (1, post[k, v])):
                    yes[c][0] += n * p * v[j]
                    yes[c][1] += n * p
        rates[name] = (yes[0][0] / yes[0][1], yes[1][0] / yes[1][1])
    return post, rates


def _features(kind: str, votes: tuple, shape: int) -> list[str]:
    named = [f"{n}={'?' if x is None else x}" for n, x in zip(LABELERS, votes, strict=True)]
    return ["bias", kind, *named, f"{kind}:{shape}"]


def classifier(rows: list[tuple], post: dict, rounds: int = 200) -> dict[str, float]:
    """Weights by feature of a logistic regression on rows (kind, votes, shape, n) with the posteriors as soft labels, by AdaGrad."""
    total = sum(n for *_, n in rows)
    weight: dict[str, float] = {}
    past: dict[str, float] = {}
    data = [(_features(k, v, s), post[k, v], n / total) for k, v, s, n in rows]
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, y, share in data:
            z = sum(weight.get(x, 0.0) for x in names)
            g = share * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            for x in names:
                slope[x] = slope.get(x, 0.0) + g
        for x, g in slope.items():
            g += 1e-4 * weight.get(x, 0.0)
            past[x] = past.get(x, 0.0) + g * g
            weight[x] = weight.get(x, 0.0) - 0.5 * g / math.sqrt(past[x] + 1e-12)
    return weight


def scored(found: DataFrame, p: Params) -> DataFrame:
    """``found`` (as of ``voted``) with ``score``, the classifier's probability."""
    patterns = found.groupBy("kind", *LABELERS, "shape").agg(F.count("*").alias("n")).collect()  # bounded: kinds x votes x shapes
    rows = sorted(((r["kind"], tuple(r[x] for x in LABELERS), r["shape"], r["n"]) for r in patterns), key=str)
    if not rows:
        return found.withColumn("score", F.lit(0.0))
    counts: dict[tuple, int] = {}
    for k, v, _, n in rows:
        counts[k, v] = counts.get((k, v), 0) + n
    post, _ = reliabilities([(k, v, n) for (k, v), n in counts.items()], p.rounds)
    weight = classifier(rows, post)
    lookup = F.create_map(*[F.lit(x) for k, w in sorted(weight.items()) for x in (k, w)])
    names = [F.lit("bias"), F.col("kind"), *[F.concat(F.lit(f"{x}="), F.coalesce(F.col(x).cast("string"), F.lit("?"))) for x in LABELERS]]
    names.append(F.concat_ws(":", "kind", F.col("shape").cast("string")))
    z = sum((F.coalesce(F.element_at(lookup, n), F.lit(0.0)) for n in names), F.lit(0.0))
    return found.withColumn("score", 1 / (1 + F.exp(-z)))


def find(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The spans: (doc_id, h, kind, start, end, ok, score); ok tells base spans from added ones."""
    found = scored(cut(voted(candidates(docs))), p)
    return found.where(F.col("ok") | (~F.col("overlaps") & (F.col("score") >= p.accept))).select("doc_id", "h", "kind", "start", "end", "ok", "score")


def report(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``; the numbers count base spans."""
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", nth.alias("nth"), "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("told"))
    numbers = [F.count(F.when(F.col("ok") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    # equal spans of two expressions are listed once
    by_doc = find(docs, p).groupBy("doc_id", "h").agg(*numbers, F.collect_list(F.when(F.col("ok"), span)).alias("base"), F.collect_set(span).alias("all"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["told"]), ",")
    by_doc = by_doc.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), *[f"n_{k}" for k in KINDS], listed("base").alias("base"), listed("all").alias("spans"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"))
    return keys.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
