import zlib

import numpy as np
import pytest

from ragtide.llm import quality as q
from ragtide.llm import queries

from .conftest import LONG


@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, q.train(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, _ = trained
    got = {r["doc_id"]: r for r in q.report(docs, labels).collect()}
    rows = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in got]
    assert len(rows) > 40
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([(s >= q.CUT) == bool(y) for s, y in rows])
    assert auc > 0.9 and accuracy > 0.85
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= q.CUT)


def test_training_is_repeatable_and_ignores_held_out_rows(spark, trained):
    docs, labels, weights = trained
    assert np.array_equal(weights, q.train(docs.repartition(7), labels.repartition(3)))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(weights, q.train(docs, turned))


def test_scores_are_sparse_dot_products(trained):
    weights = trained[2]
    for text in (b"One two THREE", b"", b"a", b"x y"):
        places, first = q.slots([text])
        n = first[1]
        z = float(weights[-1]) + sum(float(q.WEIGHT) * float(weights[i]) / n for i in places.ravel()) if n else float(weights[-1])
        assert q.scores([text], weights)[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_ftrl_separates():
    rng = np.random.default_rng(1)
    examples = [(np.array([int(y), 5, q.SLOTS]), np.array([1.0, rng.random(), 1.0]), int(y)) for y in rng.integers(0, 2, 400)]
    w = q.ftrl(examples)
    assert w[1] > 0.5 > -0.5 > w[0]


def brute_ftrl(examples, epochs):
    """Weights a coordinate at a time: the definition of follow-the-regularised-leader with both penalties."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= q.L1:
            return 0.0
        return -(z[i] - (q.L1 if z[i] > 0 else -q.L1)) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)

    for _ in range(epochs):
        for row, y in examples:
            w = {i: weight(i) for i in row}
            p = 1 / (1 + np.exp(-sum(w[i] * x for i, x in row.items())))
            for i, x in row.items():
                g = (p - y) * x
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / q.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_against_brute_force(spark, documents):
    rng = np.random.default_rng(3)
    vocabulary = ["Good", "prose", "here", "AND", "there", "spam", "CLICK", "12", "now!", "é"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for i in range(150)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(i, int(rng.integers(0, 2))) for i, _ in rows], "doc_id long, quality int")
    got = q.train(documents(rows), labels, sample=70, epochs=2)
    order = {r[0]: r[1] for r in labels.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learnt = sorted((i for i, _ in rows if zlib.crc32(str(i).encode()) % 5), key=lambda i: order[i])[:70]
    texts, examples = dict(rows), []
    for i in learnt:
        places, first = q.slots([(texts[i] or "").encode()])
        row = {q.SLOTS: 1.0}
        for k in places.ravel().tolist():
            row[k] = row.get(k, 0.0) + float(q.WEIGHT) / first[1]
        examples.append((row, y[i]))
    want = np.zeros(q.SLOTS + 1)
    for i, w in brute_ftrl(examples, 2).items():
        want[i] = w
    assert np.count_nonzero(want) > 100 and np.allclose(got, want, atol=1e-5)


def test_odd_rows(documents, spark):
    rows = [(1, "good words here"), (2, None), (3, ""), (1, "good words here"), (None, "x"), (4, LONG)]
    docs = documents(rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    got = q.report(docs, labels).collect()
    assert len(got) == len(rows)
    none = q.report(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert q.report(documents([]), labels).collect() == []
    kept = q.drop_poor(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_query_columns(spark, sf_dir):
    assert queries.QUERIES["op10_quality"](spark, sf_dir).columns == ["doc_id", "held_out", "score", "predicted"]
