"""Benchmark passages in documents: a prefix-filtered set join with exact verification.

A window is `size` consecutive words of an item; an item of fewer words, but some, is one window. A document word inside
an occurrence of any window is hit. Words are runs of digits, small letters and characters beyond ASCII, after A-Z are
lower-cased.

All words of a window must occur, so its prefix is one word: the rarest, by counts of the benchmark's vocabulary over all
documents. A document's words are looked up among these prefix words; each find is tied to the windows that have the
word, at its place in them (positional bound), if the document has room for the whole window there (length bound), and
then all words of the window are compared: by 64-bit hashes, and what these let pass byte by byte.

The windows are sent to all tasks if they fit into max_broadcast_bytes, which is checked; beyond it they are dealt into
slices that do, each slice reads the documents for itself, and the finds of all slices are put together. An item's
windows may lie in several slices.

Null or wordless texts have no words and are never contaminated; null item ids count as an item named null; items and
rows may repeat; an empty benchmark hits nothing; further columns, of whatever name, are not touched.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.llm._text import NON_WORD, U, Words, chunks, mix, utf8

SIZE = 13
MAX_BROADCAST_BYTES = 64 << 20
_SALT = U(0x2545F4914F6CDD1D)


def _windows(size: int):
    """Items to windows: the item's name, and the window's words with a space between."""

    def run(batches):
        for batch in batches:
            names = [str(x) if x is not None else "null" for x in batch.column(0).to_pylist()]
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                w = Words(texts[a:b], NON_WORD)
                for i, (f, n) in enumerate(zip(w.first[:-1].tolist(), w.count.tolist())):
                    words = [w.word(j) for j in range(f, f + n)]
                    count = max(1, n - size + 1) if n else 0
                    for c in range(0, count, 4096):
                        part = [b" ".join(words[j : j + size]) for j in range(c, min(c + 4096, count))]
                        yield pa.RecordBatch.from_arrays([pa.array([names[a + i]] * len(part), pa.string()), pa.array(part, pa.binary())], ["item", "words"])

    return run


def _table(keys: np.ndarray) -> np.ndarray:
    """A filter of fixed size on 16 bits of a hash, so that most words are settled by one look."""
    out = np.zeros(1 << 16, bool)
    out[(keys >> U(48)).astype(np.int64)] = True
    return out


def _find(keys: np.ndarray, table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes that are among the sorted keys, and which key."""
    at = np.flatnonzero(table[(hashes >> U(48)).astype(np.int64)])
    place = np.searchsorted(keys, hashes[at])
    place[place == len(keys)] = 0
    good = keys[place] == hashes[at]
    return at[good], place[good]


def _count(vocabulary: np.ndarray):
    def run(batches):
        total, table = np.zeros(len(vocabulary), np.int64), _table(vocabulary)
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in chunks(texts):
                total += np.bincount(_find(vocabulary, table, Words(texts[a:b], NON_WORD).hash)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], ["word", "n"])

    return run


def hashed(windows: list[bytes]) -> list[np.ndarray]:
    """Each window's words as hashes."""
    out = []
    for a, b in chunks(windows):
        w = Words(windows[a:b], NON_WORD)
        out += np.split(w.hash, w.first[1:-1])
    return out


class Index:
    """Windows by their rarest word."""

    def __init__(self, windows: list[tuple[str, bytes]], counts: dict[int, int]):
        by_words: dict[bytes, set[str]] = {}
        for item, words in windows:
            by_words.setdefault(words, set()).add(item)
        self.items = [frozenset(s) for s in by_words.values()]
        self.texts = list(by_words)
        self.words = hashed(self.texts)
        prefix = []
        for k, w in enumerate(self.words):
            at = min(range(len(w)), key=lambda i: (counts.get(int(w[i]), 0), int(w[i])))
            prefix.append((int(w[at]), at, k))
        self.keys = np.array(sorted({x[0] for x in prefix}), U)
        place = {int(x): i for i, x in enumerate(self.keys)}
        self.uses: list[list[tuple[int, int]]] = [[] for _ in self.keys]
        for word, at, k in prefix:
            self.uses[place[word]].append((at, k))
        # Of each window a sum that its words' sums give by a subtraction, so that most finds are settled at once.
        self.check = np.array([mix(w + _SALT).sum(dtype=U) for w in self.words], U)
        self.table = _table(self.keys)

    def matches(self, w: Words) -> list[tuple[int, int, int]]:
        """(first word, end, window) of every occurrence in the texts of w."""
        if not len(self.keys) or not len(w.hash):
            return []
        at, key = _find(self.keys, self.table, w.hash)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(w.hash + _SALT), dtype=U)])
        row = np.searchsorted(w.first, at, side="right") - 1
        out = []
        for k in np.unique(key).tolist():
            mine = key == k
            p, lo, hi = at[mine], w.first[row[mine]], w.first[row[mine] + 1]
            for offset, window in self.uses[k]:
                first, size = p - offset, len(self.words[window])
                fits = np.flatnonzero((first >= lo) & (first + size <= hi))
                first = first[fits]
                first = first[sums[first + size] - sums[first] == self.check[window]]
                for f in first.tolist():
                    if np.array_equal(w.hash[f : f + size], self.words[window]) and b" ".join(w.word(i) for i in range(f, f + size)) == self.texts[window]:
                        out.append((f, f + size, window))
        return out


def _scan(index: Index):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                w = Words(texts[a:b], NON_WORD)
                items: list[set] = [set() for _ in range(b - a)]
                spans: list[list] = [[] for _ in range(b - a)]
                for first, end, window in index.matches(w):
                    row = int(np.searchsorted(w.first, first, side="right")) - 1
                    items[row] |= index.items[window]
                    spans[row].append((first - int(w.first[row]), end - int(w.first[row])))
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(w.count.astype(np.int64)), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array([[{"first": s, "end": e} for s, e in union(x)] for x in spans], kind),
                        batch.column(2).slice(a, b - a),
                    ],
                    ["id", "n_words", "items", "hits", "th"],
                )

    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover together."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _merged(hits: Column) -> Column:
    """union() of an array of ranges."""
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(x["end"], last["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["first"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(hits), none, add)


FOUND = "n_words long, items array<string>, hits array<struct<first:long,end:long>>, th long"


def _indexes(src: DataFrame, benchmark: DataFrame, size: int, max_broadcast_bytes: int):
    """An index for each slice of the windows. src: a column text."""
    windows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(_windows(size), "item string, words binary").distinct()
    # A window's bytes, its hashes and its entries in the index.
    weight = windows.agg(F.sum(2 * F.octet_length("words") + F.octet_length("item") + 8 * size + 400)).first()[0] or 0
    slices = -(-weight // max_broadcast_bytes) or 1
    for k in range(slices):
        own = [(r[0], bytes(r[1])) for r in windows.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == k).collect()]
        vocabulary = np.unique(np.concatenate(hashed([w for _, w in own]))) if own else np.zeros(0, U)
        counts = {}
        if len(vocabulary):
            counted = src.select("text").mapInArrow(_count(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n"))
            counts = {int(np.int64(r[0]).view(U)): r[1] for r in counted.collect()}
        yield Index(own, counts)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """For each row of docs: id, n_words, items (ids as strings, sorted), hits (word ranges that windows cover)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    kind = src.schema["id"].dataType.simpleString()
    parts = [src.mapInArrow(_scan(index), f"id {kind}, {FOUND}") for index in _indexes(src, benchmark, size, max_broadcast_bytes)]
    slices = len(parts)
    if slices == 1:
        return parts[0].drop("th")
    # Rows that repeat have equal finds, so one row for each id and text gives them all.
    whole = reduce(DataFrame.union, parts).groupBy("id", "th").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.flatten(F.collect_set("hits")).alias("hits"))
    whole = whole.withColumn("hits", _merged(F.col("hits")))
    keys = src.select(F.col("id").alias("kid"), F.col("th").alias("kth"))
    return keys.join(whole, keys["kid"].eqNullSafe(whole["id"]) & (keys["kth"].eqNullSafe(whole["th"]))).select(F.col("kid").alias("id"), "n_words", "items", "hits")


def verdict(found: DataFrame, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: at least percent of the words are hit."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    out = found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def _leaks(hits: list[tuple[int, int]], n_words: int, size: int, percent: int) -> bool:
    hit = sum(e - s for s, e in hits)
    return any(e - s >= size for s, e in hits) or hit > 0 and 100 * hit >= percent * n_words


def _filter(index: Index, place: int, size: int, percent: int):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(place))
            for a, b in chunks(texts):
                w = Words(texts[a:b], NON_WORD)
                spans: list[list] = [[] for _ in range(b - a)]
                for first, end, _ in index.matches(w):
                    spans[int(np.searchsorted(w.first, first, side="right")) - 1].append((first, end))
                yield batch.slice(a, b - a).filter(pa.array([not _leaks(union(x), n, size, percent) for x, n in zip(spans, w.count.tolist())], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = 5, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs, with their columns, without rows that hold a benchmark passage: a stretch of `size` words or more that windows
    cover, however long the row is; or, where items are shorter, as many of their words as are percent of the row's.
    Texts decide, so rows with equal or null ids are told apart. One slice of windows filters the rows where they lie; the
    share of hits in several slices needs them all, so their finds are put together by text."""
    place = docs.columns.index("text")
    src = docs.select(F.col("text").cast("string").alias("text"))
    indexes = list(_indexes(src, benchmark, size, max_broadcast_bytes))
    if len(indexes) == 1:
        return docs.mapInArrow(_filter(indexes[0], place, size, percent), docs.schema)
    row = docs.select(F.struct("*").alias("row"), F.sha2(F.col("text").cast("string").cast("binary"), 256).alias("digest"))
    text = row.select("digest", F.col("row").getField("text").cast("string").alias("text")).where("text IS NOT NULL")
    src = text.select(F.col("digest").alias("id"), "text", F.lit(0).cast("long").alias("th"))
    found = reduce(DataFrame.union, (src.mapInArrow(_scan(index), f"id string, {FOUND}") for index in indexes)).where("size(hits) > 0")
    hits = found.groupBy("id").agg(F.max("n_words").alias("n_words"), _merged(F.flatten(F.collect_set("hits"))).alias("hits"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    bad = hits.where(F.exists("hits", lambda x: x["end"] - x["first"] >= size) | (hit * 100 >= F.col("n_words") * percent)).select(F.col("id").alias("digest"))
    return row.join(bad, "digest", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
