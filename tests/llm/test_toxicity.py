import random

import pytest
from pyspark.sql import functions as F

from tarnwerk.llm import toxicity

from .helpers import SCHEMA, clashing, odd_rows, prose

BAD = ("vileword", "nastyterm", "awfulname")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        words = prose(i, 60).split()
        toxic = i % 5 == 0 or i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD).upper() + ",")
        rows.append((1000 + i, " ".join(words), "en", "a", 1))
        labels.append((1000 + i, 1, int(toxic)))
    return spark.createDataFrame(rows + odd_rows(), SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (1001, 1, None), (999999, 0, 1)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = toxicity.learned(clashing(docs), labels)
    got = toxicity.score(clashing(docs), model).join(labels.dropna(), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) / len(got) > 0.97
    assert 0 < len(model[1]) < 5000


def test_held_out_rows_teach_nothing(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learned(docs, labels), toxicity.learned(docs, flipped)
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_every_row_scores_and_same_texts_alike(corpus):
    docs, labels = corpus
    got = toxicity.score(docs, toxicity.learned(docs, labels))
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    same = {r["score"] for r in got.where("doc_id in (5, 6)").collect()}
    assert len(same) == 1
    assert len({r["score"] for r in got.where("doc_id in (1, 2, 3)").collect()}) == 1


def test_no_labels_and_one_class(spark, corpus):
    docs, labels = corpus
    none = toxicity.learned(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0
    clean = toxicity.learned(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, clean).where("score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_sample_is_bounded_and_repeated_rows_teach_once(corpus):
    docs, labels = corpus
    mine = labels.select("doc_id", F.col("toxic").alias("label"))
    few = toxicity.fit(docs, mine, max_rows=50)
    some = toxicity.fit(docs, mine, max_features=4000)
    every = toxicity.fit(docs, mine)
    assert few[1].tolist() != every[1].tolist() != some[1].tolist()
    again = toxicity.fit(docs.union(docs.where("doc_id % 2 = 0")), mine)
    assert again[0] == every[0] and (again[1] == every[1]).all() and (again[2] == every[2]).all()


def plain_ftrl(rows, labels, alpha, beta, l1, epochs):
    """Per-coordinate FTRL-proximal, one coordinate at a time."""
    import math

    z, n, touched = {}, {}, set()

    def weight(i, l1):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha)

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            w = {i: weight(i, 0.0 if i == "bias" else l1) for i in [*x.tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
                touched.add(i)
    return weight("bias", 0.0), {i: weight(i, l1) for i in touched if i != "bias" and weight(i, l1)}


def test_ftrl_equals_plain_updates():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(10, 1000, 20), [1] if i % 2 else [2])) for i in range(400)]
    labels = [i % 2 if i % 11 else 1 - i % 2 for i in range(400)]
    for alpha, root in ((2.0, 0.1), (0.5, 0.02)):
        bias, live, w = toxicity.train(rows, labels, bits=10, alpha=alpha, l1_root=root)
        want_bias, want = plain_ftrl(rows, labels, alpha, 1.0, root * 20, 3)
        assert bias == pytest.approx(want_bias, abs=1e-9)
        assert dict(zip(live.tolist(), w.tolist(), strict=True)) == pytest.approx(want, rel=1e-5, abs=1e-6)
        assert want[1] > 0 > want[2] and len(want) < 900


def test_bias_alone_carries_the_share():
    import numpy as np

    x = np.array([1, 2])
    for labels in ([], [0], [0] * 98, [1] * 98):
        bias, live, _ = toxicity.train([x] * len(labels), labels)
        assert not len(live) and 1 / (1 + np.exp(-bias)) == pytest.approx((sum(labels) + 1) / (len(labels) + 2), abs=1e-3)
