"""Language ID and toxicity: held-out accuracy, calibration, odd cases."""

import numpy as np
from pyspark.sql import functions as F

from siltworks.llm import langid, toxicity


def test_language_of_held_out_documents(spark, documents):
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    row = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert row[1] > 20 and row[0] > 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r[0] for r in got.select("lang_pred").distinct().collect()} <= {"de", "en", "es", "fr", "und"}


def test_language_learns_from_training_documents_only(spark, documents):
    """Other labels on held-out documents change nothing."""
    changed = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    cols = ["doc_id", "lang_pred", "score"]
    assert langid.identify(documents).select(cols).exceptAll(langid.identify(changed).select(cols)).count() == 0


def test_language_odd_rows(spark, odd):
    got = langid.identify(odd)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == odd.count()
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, 7}
    assert got.where("lang_pred = 'und' and score <> 0").count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {1, 2, 3, 7}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_temperature_of_overconfident_logits():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    z = rng.normal(size=(400, 3))
    z[np.arange(400), y] += 1
    assert 0.7 < langid.fit_temperature(z, y) < 1.4
    assert 3.5 < langid.fit_temperature(5 * z, y) < 7


def _toxic(spark, n=600):
    rng = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(400)])
    rows, labels = [], []
    for i in range(n):
        t = list(rng.choice(words, 60))
        toxic = int(i % 6 == 0)
        if toxic:
            for k in rng.choice(60, rng.integers(1, 12), replace=False):
                t[k] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(t)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = _toxic(spark)
    got = toxicity.grade(docs, labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert sum(r.toxic and r.y for r in got) >= 0.9 * sum(r.y for r in got) > 5
    assert sum(r.toxic and not r.y for r in got) <= 1
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got)
    # more of it is more severe
    counted = {r.doc_id: sum(w in ("vile", "nasty") for w in r.text.split()) for r in docs.collect()}
    s = np.array([(counted[r.doc_id], r.severity) for r in got if r.y])
    assert np.corrcoef(s.T)[0, 1] > 0.6


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.grade(odd, labels)
    assert got.count() == odd.count()
    assert {r.severity for r in got.where("doc_id in (1, 2, 3)").collect()} == {0.0}
    assert toxicity.grade(odd, labels.limit(0)).where("severity > 0").count() == 0
    assert toxicity.grade(odd.limit(0), labels).count() == 0


def test_ftrl_against_one_coordinate_at_a_time():
    """The update as published, feature by feature in plain Python."""
    rng = np.random.default_rng(3)
    p = langid.Params(bits=4, epochs=2, l1=0.05, l2=0.01)
    xs, ys = [], []
    for _ in range(40):
        at = np.sort(rng.choice(16, 5, replace=False))
        xs.append((at, rng.random(5))), ys.append(int(at[0] > 2) + int(at[0] > 4))
    w, bias = langid.ftrl(xs, ys, 3, p)
    z, n = ([[0.0] * 3 for _ in range(17)] for _ in range(2))

    def weight(f, k):
        l1, l2 = (p.l1, p.l2) if f < 16 else (0.0, 0.0)
        if abs(z[f][k]) <= l1:
            return 0.0
        return -(z[f][k] - (l1 if z[f][k] > 0 else -l1)) / ((p.beta + n[f][k] ** 0.5) / p.alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in order.permutation(40):
            x = [*zip(xs[i][0].tolist(), xs[i][1].tolist(), strict=True), (16, 1.0)]
            score = np.array([sum(v * weight(f, k) for f, v in x) for k in range(3)])
            q = np.exp(score) / np.exp(score).sum()
            steps = [(f, k, v * (q[k] - (k == ys[i])), weight(f, k)) for f, v in x for k in range(3)]
            for f, k, g, old in steps:
                sigma = ((n[f][k] + g * g) ** 0.5 - n[f][k] ** 0.5) / p.alpha
                z[f][k] += g - sigma * old
                n[f][k] += g * g
    assert np.allclose(w, [[weight(f, k) for k in range(3)] for f in range(16)]) and np.allclose(bias, [weight(16, k) for k in range(3)])
    assert (w == 0).any()


def test_weights_are_sparse_and_the_sample_is_bounded(spark, documents):
    m = langid.fit(documents)
    seen = np.abs(m.idf - m.idf.max()) > 1e-12  # features of any training document
    assert (m.weights[seen] == 0).mean() > 0.5
    one_id = documents.where("lang is not null").limit(100).select(F.lit(2).alias("doc_id"), "text", F.col("lang").alias("label"))
    for i in (None, 2, 3, 8):
        rows = langid.training_sample(one_id.withColumn("doc_id", F.lit(i).cast("long")), langid.Params(per_label=5)).groupBy("label").count().collect()
        assert rows and all(1 <= r["count"] <= 5 for r in rows)


def test_ordinal_slopes_are_the_derivatives():
    theta = np.array([-0.5, 0.4, 1.7])

    def loss(s, t, g):
        edge = np.concatenate(([1.0], toxicity.sigmoid(s - t), [0.0]))
        return -np.log(edge[g] - edge[g + 1])

    for g in range(4):
        for s in (-2.0, 0.1, 3.0):
            ds, dt = toxicity.slopes(s, theta, g)
            assert abs(ds - (loss(s + 1e-6, theta, g) - loss(s - 1e-6, theta, g)) / 2e-6) < 1e-5
            for k in range(3):
                up, down = theta.copy(), theta.copy()
                up[k], down[k] = up[k] + 1e-6, down[k] - 1e-6
                assert abs(dt[k] - (loss(s, up, g) - loss(s, down, g)) / 2e-6) < 1e-5


def test_toxicity_sample_of_one_id(spark):
    docs = spark.createDataFrame([(7, f"text number {k} {'vile' * (k % 2)}") for k in range(300)] + [(k, "fine words") for k in range(100, 140)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), *[(k, 0) for k in range(100, 140)]], "doc_id long, toxic int")
    sample, share = toxicity.training_sample(docs, labels, toxicity.Params(per_class=25))
    assert sum(t for t, *_ in sample) in (0, 25) and len(sample) <= 50
