"""Line dedup, mixing, personal data, BPE, URL filters and the pipeline against brute force or the library they match."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import bpe, common, linededup, minhash, mixing, pii, urlfilter
from siltworks.llm.queries import tokenizer_path

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def lines_kept(rows):
    """By brute force: the lines of (doc_id, text) that stay."""
    seen, first = {}, []
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(x for x in SPACES.split(line.lower()) if x)
            if w and w not in seen:
                seen[w] = (i, k)
                first.append(w)

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    gone = {a for n, a in enumerate(first) if any(max(len(a), len(b)) >= 5 and near(a, b) for b in first[:n])}
    return {seen[w] for w in first if w not in gone}


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(1)
    base = [[f"w{r.randrange(50)}" for _ in range(n)] for n in [*range(1, 16), 3, 4, 5, 6, 9, 10, 4, 5, 12, 40, 1300]]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k, what = r.randrange(len(w)), r.randrange(3)
                w[k : k + 1] = [["new"], [], [w[k], "more"]][what]
            lines.append(r.choice([" ", "\t"]).join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join([*lines, ""] if i % 3 else lines)))
    # a template line on every document, as one that others are a word away from, and as a whole
    rows = [(i, f"{t}\nthis page of the report has number {i}\nall of it is the same on every page\nthe number {i} is no word of it") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stay = lines_kept(rows)
    got = {x.doc_id: x for x in linededup.dedup(df).collect()}
    for i, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if not x.strip() or (i, k) in stay]
        assert got[i].text == "\n".join(kept), i
        assert got[i]._n_kept == sum(bool(x.strip()) for x in kept)


def test_line_dedup_with_hot_keys(spark, monkeypatch):
    """With every key of several rows taken for a hot one the result is the same."""
    rows = [(i, f"page {i} of a long and dull report\nand {i // 3} more of it there are\nand more of it there are") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.text) for r in linededup.dedup(df).collect())
    for module in (common, linededup):
        monkeypatch.setattr(module, "heavy", lambda total: 1)
    assert sorted((r.doc_id, r.text) for r in linededup.dedup(df).collect()) == want
    stay = lines_kept(rows)
    assert want == [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) in stay)) for i, t in rows]


def test_columns_named_like_helpers(spark):
    rows = [(k, f"one two three four five six\nline {k}", "a", *"pqrstuvwxyz", k) for k in range(3)]
    names = ["doc_id", "text", "source", "_h", "_d", "_lines", "_key", "_taken", "_n_lines", "row", "kept", "lines", "_gone", "_size", "h"]
    df = spark.createDataFrame(rows, names)
    kept = linededup.dedup(df)
    assert sorted(kept.columns) == sorted([*names, "_n_kept"]) and [r.row for r in kept.orderBy("doc_id").collect()] == ["w"] * 3 or kept.count() == 3
    assert kept.where("_n_kept > 2 or _d <> 'q' or h is null").count() == 0
    assert mixing.mix(df).columns == names and mixing.mix(df).where("_key <> 's' or _taken <> 't'").count() == 0
    assert minhash.keep_one(df).columns == names


def test_line_dedup_odd_rows(spark, odd):
    got = linededup.dedup(odd)
    assert got.columns == [*odd.columns, "_n_lines", "_n_kept"] and got.count() == odd.count()
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[1] is None and by[2] == "" and by[3] == " \n\t " and by[4] == "one two" and by[5] == "" and by[8] == "é 😀 ß\nline\n\nother"
    assert linededup.dedup(odd.limit(0)).count() == 0


def fair(sizes, weights, budget):
    """Targets by resharing the excess until none is above twice its size."""
    target, open_ = {}, set(sizes)
    while True:
        left, w = budget - sum(target.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
        open_ -= over


def test_mixing_targets_and_takings(spark, documents, odd):
    for df in (documents, odd):
        rows = df.collect()
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = Counter()
        for r in rows:
            sizes[r.source] += words(r.text)
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        want = fair(sizes, weights, 1.5 * sum(sizes.values()))
        got = mixing.mixed(df).join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()
        taken = Counter()
        for g in got:
            assert 0 <= g.taken <= 2 * g.size
            if g.doc_id is not None:
                assert abs(g.target - want[g.source]) < 1e-6 * max(1, want[g.source]) and g.source_size == sizes[g.source]
        for g in mixing.packets(mixing.sized(df), mixing.source_targets(mixing.sized(df))).collect():
            taken[g.source] += g.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in order)
        out = mixing.mix(df)
        assert out.columns == df.columns
        again = Counter()
        for r in out.collect():
            again[r.source] += words(r.text)
        assert all(abs(again[s] - want[s]) <= 1 for s in order)
    assert mixing.mixed(odd.limit(0)).count() == 0
    same = [sorted(map(tuple, mixing.mixed(documents.repartition(n)).collect())) for n in (1, 7)]
    assert same[0] == same[1]


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        t = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in t) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(t):
    return sorted((m.start(), k, m.end(), n) for k, (n, x) in enumerate(KINDS.items()) for m in re.finditer(x, t or "") if passes(n, m[0]))


def test_pii_base_spans(spark, documents, odd):
    r = random.Random(2)
    texts = ["a@b.c+d@e.f x@y.z.w@q.r", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.04", "4111 1111-1111 1111 😀 +1 (988) 555-2485 (", "1" * 5000, "1 " * 5000, "a@" + "b." * 5000 + "c", "name [at] mail [dot] example.com or 555-123-4567"]
    texts += ["".join(r.choice("a1.@+- 25(") for _ in range(50)) for _ in range(400)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (made, documents, odd):
        text = {(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()}
        got = Counter((x.doc_id, x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in pii.report(df).collect())
        assert got.total() == df.count()
        for i, t in text:
            s = base_spans(t)
            n = Counter(k for *_, k in s)
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest()
            assert (i, digest, *(n[k] for k in KINDS)) in got
    spans = {x.doc_id: x.spans for x in pii.report(made).collect()}
    assert "phone:" in spans[6]
    assert pii.report(odd.limit(0)).count() == 0


def test_pii_em_finds_the_worse_labeler():
    rng = np.random.default_rng(0)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        v = [int(y if rng.random() < a else not y) for a in (0.95, 0.9, 0.6)]
        counts["card", (*v, None, None)] += 1
    _, rates = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()], 50)
    assert rates["form"][1] > rates["gazetteer"][1] + 0.2 and rates["form"][0] < 0.12


def test_pii_labelers_of_one_side_tell():
    """Two labelers that only ever fire in one class, in nine of ten of its cases, move the posterior by firing and by silence."""
    rng = np.random.default_rng(1)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        v = [int(y if rng.random() < 0.8 else not y) for _ in range(3)]
        counts["card", (*v, 1 if y and rng.random() < 0.9 else None, 0 if not y and rng.random() < 0.9 else None)] += 1
    post, rates = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()], 50)
    assert rates["card", "context_for"][1][2] > 0.8 and rates["card", "context_for"][0][2] < 0.1
    assert rates["card", "context_against"][0][1] > 0.8 and rates["card", "context_against"][1][1] < 0.1
    for v in ((1, 1, 0), (0, 1, 0)):
        assert post["card", (*v, 1, None)] > 0.9 and post["card", (*v, None, 0)] < 0.1


def test_pii_added_spans_on_planted_forms(spark):
    """Recall of planted spans that the base expressions miss, and precision against look-alikes."""
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))

    def luhn(n):
        d = "4" + digits(n - 2)
        return next(d + c for c in "0123456789" if passes("card", d + c))

    def spaced(c, sep):
        return sep.join(c[k : k + 4] for k in range(0, 16, 4))

    rows, planted = [], set()
    for i in range(1200):
        kind, real = r.choice(list(KINDS)), r.random() < 0.6
        if kind == "email":
            m = f"{word()} [at] {word()} [dot] {r.choice(['com', 'org', 'de'])}" if real else f"{word()} [at] {word()} [dot] {word()}"
        elif kind == "ip":
            m = ":".join(f"{r.randrange(4096, 65536):x}" for _ in range(8)) if real else ":".join(["0"] * 7 + [str(r.randrange(10))])
        elif kind == "card":
            m = spaced(luhn(16), ".") if real else spaced("9" + digits(15), ".")
        else:
            m = f"({r.randrange(201, 990) // 10 * 10 % 790 + 201}) {r.randrange(200, 999)}-{digits(4)}" if real else f"1{digits(2)}-1{digits(2)}-{digits(4)}"
        ahead = {"email": "contact", "ip": "server", "card": "paid by card", "phone": "call"}[kind] if real and r.random() < 0.8 else "part" if not real and r.random() < 0.8 else word()
        t = f"{word()} {ahead} {m} {word()}"
        rows.append((i, t))
        if real:
            planted.add((i, t.index(m), t.index(m) + len(m)))
    base = ["mail a.b@c.org now", "call +49 30 1234567 now", "server 8.8.4.4 is up", "card 4111 1111 1111 1111 paid", "version 1.2.3.400 is out", "part 1234567890123456 sold", "order +1234 5 off"]
    rows += [(2000 + k, base[k % len(base)]) for k in range(700)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    added = {(x.doc_id, x.start, x.end) for x in found.where("not ok and doc_id < 2000").collect()}
    print("recall", len(added & planted) / len(planted), "precision", len(added & planted) / max(1, len(added)))
    assert len(added & planted) >= 0.8 * len(planted) and len(added & planted) >= 0.9 * len(added)


def test_bpe_is_the_librarys(spark, documents, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    r = random.Random(3)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "I'll don't WE'RE", "  a   b \n\n c\t\t", "".join(r.choice("abcdé") for _ in range(20_000)), "日本語😀👩‍👩‍👧 ٣٤५ ⅷ²½", "\x00\x01\x1c\x85\xa0"]
    texts += ["".join(r.choice("ab '\n\té😀1.<|>s t") for _ in range(50)) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (made, documents, odd):
        for p in (bpe.Params(), bpe.Params(lexicon=0)):
            got = Counter(tuple(x) for x in bpe.digests(df, tokenizer_path(), p).collect())
            rows = df.select("doc_id", "text").collect()
            ids = [e.ids for e in t.encode_batch([x.text or "" for x in rows], add_special_tokens=False)]
            want = Counter((x.doc_id, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for x, i in zip(rows, ids, strict=True))
            assert got == want
    assert bpe.digests(odd.limit(0), tokenizer_path()).count() == 0


def test_bpe_lexicon_counts_all_words_wherever_they_lie(spark):
    with open(tokenizer_path(), "rb") as f:
        content = f.read()
    texts = [f"spread w{i}x" for i in range(40)]  # each stretch has each word once
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    name = bpe._hand_out(df, content, ".json")
    got = [sorted(bpe.frequent_words(df.repartition(n), name, bpe.Params(lexicon=30, counted=1))) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 30 and "spread" in "".join(got[0])
    assert len(bpe.frequent_words(df.select("doc_id", F.lit("a b c d e").alias("text")), name, bpe.Params(lexicon=3))) == 3


def test_minimal_automaton_shares_suffixes():
    words = sorted({f"{a}{b}ing".encode() for a in "abc" for b in "xyz"} | {b"a", b"ax"})
    f = bpe.minimal_automaton(words)
    lookup = {}
    for w in words:
        s = rank = 0
        for c in w:
            k = next(k for k in range(f["first"][s], f["first"][s + 1]) if f["byte"][k] == c)
            rank, s = rank + f["skip"][k], f["to"][k]
        assert f["final"][s]
        lookup[w] = rank
    assert [lookup[w] for w in words] == list(range(len(words)))
    assert len(f["final"]) <= 10  # of 46 in a tree


def test_url_filters(spark):
    urls = ["http://a.example.org/es/x", "http://EXAMPLE.org/en/12?q", "https://sub.example.org/en/2", "http://badexample.org/es/", "x.org/", None, "", "http://fr.com/fr/a", "http://com/de/", "http://q.com/de", "http://m.net/ads/1?utm_source=2", "http://10.0.0.1/", "ftp://org#/es/", "http://org/a#b", "a://b://c/d"]
    urls += ["http://a.net/ads/", "http://h.net/?page=1234", "http://h.net/?page=12"]
    pages = spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)] + [(3, urls[3], None)], "page_id long, url string, host string")
    got = sorted(map(tuple, urlfilter.judge(pages, urlfilter.rules(spark, urlfilter.DOMAIN_RULES, urlfilter.PATTERN_RULES)).collect()), key=str)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").where("not (page_id = 3 and url is null)").dropDuplicates(["page_id"]).toPandas())
    want = con.execute(urlfilter.oracle_sql()).fetchall()
    assert got == sorted([*want, next(w for w in want if w[0] == 3)], key=str)
    none = urlfilter.judge(pages, urlfilter.rules(spark, [], []))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(got)
    assert urlfilter.judge(pages.limit(0), urlfilter.rules(spark, urlfilter.DOMAIN_RULES, urlfilter.PATTERN_RULES)).count() == 0


def test_rules_are_indexed_by_their_rarest_token(spark):
    listed = urlfilter.rules(spark, [], [urlfilter.Pattern("common.*rare", ("common", "rare")), urlfilter.Pattern("x", ()), urlfilter.Pattern("never", ("never",))])
    counts = spark.createDataFrame([("common", 9), ("rare", 2)], "token string, n long")
    assert {(r.rule_id, r.token) for r in urlfilter.indexed(listed, counts).collect()} == {(0, "rare"), (1, None)}


def test_pipeline(spark, documents):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mix", "bpe"]
    docs, columns = documents, documents.columns
    for name, stage in c.STAGES:
        before, docs = docs, stage(spark, docs, "").cache()
        if name == "bpe":
            break
        assert docs.columns == columns, name
        if name == "line_dedup":
            stay = lines_kept([(r.doc_id, r.text) for r in before.collect()])
            assert docs.agg(F.sum(F.length("text"))).head()[0] == sum(len("\n".join(x for k, x in enumerate((r.text or "").split("\n")) if not x.strip() or (r.doc_id, k) in stay)) for r in before.collect())
    assert docs.count() == before.count() and docs.agg(F.sum("n_tokens")).head()[0] > 0


def test_pipeline_on_odd_and_empty_tables(spark, odd):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as c

    for df in (odd, odd.limit(0), odd.withColumn("lang", F.lit(None).cast("string"))):
        docs, seen = df, []
        for name, stage in c.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
            seen.append(docs.collect())
            assert name == "bpe" or docs.columns == df.columns
        ids = [sorted((r.doc_id for r in rows), key=str) for rows in seen]
        if df is odd:
            assert ids[0] == sorted([4, 4, 5, 6, 8, None], key=str) and ids[1] == ids[0]
            assert {r.doc_id: r.text for r in seen[1]}[5] == "" and ids[2].count(4) == 1
            assert 5 not in ids[3] and len(ids[4]) == len(ids[3]) and all(r.n_tokens > 0 for r in seen[4])
            assert all(r.n_chars == len(r.text) for r in seen[1] + seen[3])
        else:
            assert ids == [[]] * 5
