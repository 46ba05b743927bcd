"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features: words (lower-cased), pairs of neighbours, and the same two of word shapes (which kinds of characters a word
has, and its length class), each hashed to one of SLOTS places; their counts, divided by the number of words. A text's
score is the logistic function of a sparse dot product with the weights. A null or wordless text has the score of the
bias alone.

Training takes labelled rows whose crc32 of the id (as text) is not 0 modulo 5: those that come first by a hash of their
id, at most `sample` (12,000 by default). Their features go to one task, which makes `epochs` passes in that order;
weights have a fixed size of 1 MB. Further columns, such as language and source, are never looked at. Of an id with
several labels the highest counts; of rows that repeat an id one is learnt from; null ids and labels are not learnt from.
Without any labelled row all weights stay 0, and every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm._text import SPACE, U, Words, chunks, grams, mix, utf8

SLOTS, SAMPLE, EPOCHS, CUT = 1 << 18, 12_000, 3, 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02
#: What a family of features adds up to.
WEIGHT = np.float32(8)

_KIND = np.full(256, 16, np.uint8)
_KIND[:128] = 8
_KIND[48:58] = 4
_KIND[65:91] = 2
_KIND[97:123] = 1


def slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of all texts, shape (4, words); and where each text's words begin (and the end)."""
    raw = Words(texts, SPACE, lower=False)
    w = Words(texts, SPACE)
    n = len(w.hash)
    out = np.zeros((4, n), np.uint32)
    if n:
        kinds = np.bitwise_or.reduceat(_KIND[raw.data], np.stack([raw.start, raw.end], 1).ravel())[::2]
        size = np.minimum(w.end - w.start, 31) >> 2
        shape = mix((kinds.astype(U) << U(8)) + size.astype(U) + U(1))
        for k, x in ((0, w.hash), (2, shape)):
            out[k] = mix(x ^ U(k + 1)) & U(SLOTS - 1)
            if n > 1:
                out[k + 1, :-1] = mix(grams(x, 2) ^ U(k + 17)) & U(SLOTS - 1)
            # A text's last word has no neighbour: its pair stands for the end.
            last = w.first[1:][w.count > 0] - 1
            out[k + 1, last] = mix(x[last] ^ U(k + 33)) & U(SLOTS - 1)
    return out, w.first


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Scores of texts; weights: SLOTS and, last, the bias."""
    places, first = slots(texts)
    per_word = weights[places].sum(axis=0, dtype=np.float64)
    sums = np.concatenate([[0.0], np.cumsum(per_word)])
    n = np.diff(first)
    z = weights[-1] + WEIGHT * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (slots, values, label) examples, in the given order; the bias is the last place."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-max(-60.0, min(60.0, float(w @ x)))))
            g = (p - y) * x
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return weights(np.arange(SLOTS + 1)).astype(np.float32)


def _features(batches):
    for batch in batches:
        texts, rows = utf8(batch.column(2)), []
        for a, b in chunks(texts):
            places, first = slots(texts[a:b])
            for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
                i, c = np.unique(places[:, s:e], return_counts=True)
                rows.append((i.astype(np.uint32).tobytes(), (WEIGHT * c / max(1, e - s)).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)]], ["ord", "label", "slots", "x"])


def _train(epochs: int):
    def run(batches):
        rows = []
        for batch in batches:
            rows += list(zip(*(c.to_pylist() for c in batch.columns)))
        rows.sort(key=lambda r: (r[0], r[2], r[3]))
        examples = [(np.append(np.frombuffer(i, np.uint32), SLOTS).astype(np.int64), np.append(np.frombuffer(x, np.float32), 1.0).astype(np.float64), y) for _, y, i, x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(examples, epochs).tobytes()], pa.binary())], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, label: str = "quality") -> np.ndarray:
    """Weights. labels: doc_id and the label's column."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.withColumn("ord", F.xxhash64("doc_id")).orderBy("ord", "doc_id").limit(sample)  # so few rows that they can be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "ord", "label").agg(F.min("text").alias("text"))
    made = rows.select("ord", "label", "text").mapInArrow(_features, "ord long, label int, slots binary, x binary")
    got = made.repartition(1).mapInArrow(_train(epochs), "weights binary").first()
    return np.frombuffer(bytes(got[0]), np.float32) if got else np.zeros(SLOTS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id columns and score, for each row."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols]

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(len(id_cols)))
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(id_cols))], pa.array(scores(texts[a:b], weights))], [*id_cols, "score"])

    return docs.select(*id_cols, F.col(text_col).cast("string")).mapInArrow(run, ", ".join([*kinds, "score double"]))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """For each document: doc_id, held_out, score, predicted (1 from a score of 0.3)."""
    out = score(docs, train(docs, labels, **options))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs, with their columns, without those that score below the cut."""
    weights, place = train(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(place))
            for a, b in chunks(texts):
                yield batch.slice(a, b - a).filter(pa.array(scores(texts[a:b], weights) >= cut))

    return docs.mapInArrow(run, docs.schema)
