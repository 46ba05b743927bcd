"""Near-duplicate documents: many universal hash minima with banding, signature verification, confirmation on whole
shingle sets, and connected components by alternating large-star and small-star.

Rules. Words are runs without ASCII white space, after A-Z are lower-cased. A document's set holds its distinct
shingles of `words` words; a shorter document has its whole sequence as one; one without words, or null, has the empty
set and is linked with nothing. Two documents are linked if 100 * intersection >= percent * union. Ids are whole numbers
or null. A row whose id is null takes part in all links but is nobody's representative. Rows that repeat an id are one
document: where their texts differ, the one whose set has the least digest is compared, and all share its component.

How links are found without pairs of a whole group: equal sets fall into one class first, by a partial aggregation.
Class representatives that share a band key are compared with the least of that bucket (a star, linear in its size);
what those confirmed links join is one component. Only buckets that still hold several components are looked at again,
in blocks of rows dealt to separate tasks, which compare signatures and then whole sets and give back no more links than
are needed to join what belongs together. Bands: 24 of 5 minima, so that a pair just at 0.85 is missed with a
probability under 1e-6 (at 0.8: 1e-4; at 0.9: 1e-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm._graph import components
from ragtide.llm._store import Store, narrowed
from ragtide.llm._text import SPACE, U, Words, chunks, grams, mix, utf8

BANDS, ROWS = 24, 5
#: Rows of a block in which signatures are compared pair by pair.
BLOCK = 256

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def least_shared(percent: int) -> int:
    """Minima that the signatures of a pair at the threshold share at least: the mean less seven deviations."""
    p, n = percent / 100, BANDS * ROWS
    return max(0, int(n * p - 7 * (n * p * (1 - p)) ** 0.5))


def shingle_sets(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each range of texts: sorted distinct shingle hashes of all, and where each text's begin (and the end)."""
    for a, b in chunks(texts):
        w = Words(texts[a:b], SPACE)
        whole = grams(w.hash, n)
        sets = []
        for i, k in zip(w.first[:-1].tolist(), w.count.tolist()):
            if k >= n:
                s = np.sort(whole[i : i + k - n + 1])
                sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:
                sets.append(grams(w.hash[i : i + k], k) if k else whole[:0])
        yield np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def signatures(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint32 minima, one row for each text; all ones for an empty set."""
    size = np.diff(first)
    out = np.full((len(size), BANDS * ROWS), 2**32 - 1, np.uint32)
    full = np.flatnonzero(size)
    x = (flat >> U(32)).astype(np.uint32)
    step = 1 << 15
    i = 0
    while i < len(full):  # a few thousand hashes at a time stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(first[full], first[full[i]] + step)))
        lo, hi = first[full[i]], first[full[j - 1] + 1]
        part, at = x[lo:hi], first[full[i:j]] - lo
        for k in range(BANDS * ROWS):
            out[full[i:j], k] = np.minimum.reduceat(part * _A[k] + _B[k], at)
        i = j
    return out


def _sketch(words: int):
    def run(batches):
        for batch in batches:
            texts, at = utf8(batch.column(1)), 0
            for flat, first in shingle_sets(texts, words):
                size = np.diff(first)
                rows = len(size)
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat ^ U(0x5851F42D4C957F2D)))])
                other = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat + U(0x14057B7EF767814F)))])
                sig = signatures(flat, first)
                keys = grams_of_bands(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, rows),
                        pa.array(size.astype(np.int64)),
                        pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)),
                        pa.array((other[first[1:]] - other[first[:-1]]).view(np.int64)),
                        pa.array([x.tobytes() for x in (sig & np.uint32(255)).astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "sig", "bands"],
                )
                at += rows

    return run


def grams_of_bands(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), U)
    for b in range(BANDS):
        acc = np.full(len(sig), b + 1, U)
        for r in range(ROWS):
            acc = mix(acc * U(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r].astype(U))
        out[:, b] = acc
    return out


def _sets(words: int):
    """id, the first half of the set's digest as _sketch() has it, and the sorted set."""

    def run(batches):
        for batch in batches:
            texts, at = utf8(batch.column(1)), 0
            for flat, first in shingle_sets(texts, words):
                rows = len(first) - 1
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat ^ U(0x5851F42D4C957F2D)))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, rows),
                        pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)),
                        pa.array([flat[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary()),
                    ],
                    ["id", "h1", "grams"],
                )
                at += rows

    return run


def _close(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    n, m = len(x) // 8, len(y) // 8
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate([np.frombuffer(x, U), np.frombuffer(y, U)])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (n + m - shared)


def _alike(percent: int):
    """Pairs whose signatures share enough minima."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if x:
                same = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) == np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(same.sum(axis=1) >= least_shared(percent)))

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = [_close(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def join_block(ids: list, comps: list, sigs: np.ndarray, sets: list[bytes], side: np.ndarray, two: bool, percent: int) -> list[tuple]:
    """Confirmed links that join different components among the rows of a block (or between two blocks)."""
    root = {c: c for c in comps}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for i in range(len(ids)):
        others = np.flatnonzero(side != side[i]) if two else np.arange(i + 1, len(ids))
        if two and side[i]:
            continue
        for j in others[(sigs[others] == sigs[i]).sum(axis=1) >= least_shared(percent)].tolist():
            a, b = find(comps[i]), find(comps[j])
            if a != b and _close(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        two = bool((pdf["b1"] != pdf["b2"]).iloc[0])
        side = (pdf["block"] == pdf["b2"]).to_numpy() if two else np.zeros(len(pdf), bool)
        links = join_block(pdf["id"].tolist(), pdf["comp"].tolist(), sig, pdf["grams"].tolist(), side, two, percent)
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _with_nodes(docs: DataFrame, store: Store, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text), null ids replaced by numbers beyond all ids, equal texts without an id taken as one; (node, text) of
    these; and the largest id."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    top = src.agg(F.max("doc_id")).first()[0]
    top = 0 if top is None else top
    unnamed = src.where("doc_id IS NULL").select("text").distinct()
    unnamed = store.put(unnamed.select((F.monotonically_increasing_id() + F.lit(top) + F.lit(1)).alias("node"), "text"), "unnamed")
    return src.where("doc_id IS NOT NULL").union(unnamed), unnamed, top


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept. docs may have any further columns.

    component_id is the smallest id reachable over links (its own for a row without links; null where all ids of the
    class are null); kept tells whether the row is that document. An empty table gives an empty result.
    """
    store = Store(docs.sparkSession, "minhash")
    src, unnamed, top = _with_nodes(docs, store, id_col, text_col)
    out = _components(src, store, percent, words)
    nulls = docs.where(F.col(id_col).isNull()).select(F.col(text_col).cast("string").alias("text"))
    again = nulls.join(unnamed, nulls["text"].eqNullSafe(unnamed["text"])).select("node")
    found = out.where(F.col("doc_id") > top).select(F.col("doc_id").alias("id"), "n_shingles", "component_id")
    again = again.join(found, F.col("node") == F.col("id")).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", "component_id")
    out = out.where(F.col("doc_id") <= top).union(again).withColumn("component_id", F.when(F.col("component_id") <= top, F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _components(src: DataFrame, store: Store, percent: int, words: int) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of src (doc_id, text), of which no id is null."""
    made = store.put(
        src.mapInArrow(_sketch(words), "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>"), "sketch"
    )
    # A class: documents with equal sets. Rows without words stay alone.
    key = ["h1", "h2", "n_shingles"]
    own = made.where("n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("k")).select("doc_id", "k.*")
    own = store.put(own, "own")
    slim = store.put(own.join(own.groupBy(*key).agg(F.min("doc_id").alias("rep")), key).select("doc_id", "rep"), "classes")
    reps = own.join(slim.where("doc_id = rep"), "doc_id").select("doc_id", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    sketch = made.select("doc_id", *key, "sig", "bands").join(reps, "doc_id").where("h1 = g1 AND h2 = g2").select("doc_id", "n_shingles", "sig", "bands").dropDuplicates(["doc_id"])
    sketch = store.put(sketch, "reps")
    # Buckets with several members, and each member's pair with the least.
    rows = sketch.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top").select("key", "hub")
    live = store.put(rows.join(hubs, "key").select("key", F.col("doc_id").alias("id"), "hub"), "live")
    pairs = live.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    sig = sketch.select(F.col("doc_id").alias("id"), "n_shingles", "sig")
    pairs = (
        pairs.join(sig.select(F.col("id").alias("u"), F.col("n_shingles").alias("n1"), F.col("sig").alias("s1")), "u")
        .join(sig.select(F.col("id").alias("v"), F.col("n_shingles").alias("n2"), F.col("sig").alias("s2")), "v")
        .where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
        .select("u", "v", "s1", "s2")
        .mapInArrow(_alike(percent), "u long, v long")
    )
    pairs = store.put(pairs, "pairs")
    store.free()

    def with_sets(ids: DataFrame, tag: str) -> DataFrame:
        wanted = narrowed(src, src["doc_id"], ids).join(ids, src["doc_id"] == ids["id"], "left_semi")
        sets = wanted.mapInArrow(_sets(words), "id long, h1 long, grams binary").where("octet_length(grams) > 0")
        return store.put(sets.groupBy("id").agg(F.min_by("grams", "h1").alias("grams")), tag)

    sets = with_sets(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "sets")
    links = (
        pairs.join(sets.select(F.col("id").alias("u"), F.col("grams").alias("g1")), "u")
        .join(sets.select(F.col("id").alias("v"), F.col("grams").alias("g2")), "v")
        .select("u", "v", "g1", "g2")
        .mapInArrow(_confirm(percent), "u long, v long")
    )
    links = store.put(links, "links")
    store.free()
    comp = store.put(components(links, store, "a"), "comp")
    # Buckets that still hold several components.
    named = live.join(comp, live["id"] == comp["node"], "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    apart = named.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("m2"),
    ).where("lo <> hi")
    # Of buckets with the same members, which several bands give, one is enough.
    apart = apart.groupBy("n", "m1", "m2").agg(F.min("key").alias("key"))
    rest = store.put(named.join(apart.select("key", "n"), "key"), "rest")
    if not rest.isEmpty():
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        ids = rest.select("id").distinct()
        more = with_sets(ids.join(sets.select("id"), "id", "left_anti"), "more")
        known = sets.join(ids, "id", "left_semi").union(more).join(sig.select("id", "sig"), "id")
        dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "key", "id", "comp", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")
        )
        found = dealt.join(known, "id").groupBy("key", "b1", "b2").applyInPandas(_block_links(percent), "u long, v long")
        found = store.put(found.distinct(), "found")
        if not found.isEmpty():
            comp = store.put(components(links.union(found), store, "b"), "comp2")
        store.drop("more", "found")
    store.drop("live", "pairs", "sets", "rest", "reps")
    named = slim.join(comp, slim["rep"] == comp["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = made.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep. Of rows that repeat a kept id, one with the least text
    stays. Of linked rows of which none has an id, one stays; a row without an id that is linked to one with an id goes."""
    store = Store(docs.sparkSession, "minhash")
    src, unnamed, _ = _with_nodes(docs, store, "doc_id", "text")
    kept = store.put(_components(src, store, percent, words).where("doc_id = component_id").select(F.col("doc_id").alias("node")).distinct(), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    free = rows.where("node IS NULL").drop("node").join(unnamed.withColumnRenamed("text", "own"), F.col("text").eqNullSafe(F.col("own")))
    every = rows.where("node IS NOT NULL").union(free.select("row", "node", "text"))
    stay = every.join(kept, "node", "left_semi").groupBy("node").agg(F.min_by("row", F.struct("text")).alias("row"))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
