"""Unigram encoding and decoding with a SentencePiece vocabulary: Viterbi over a double-array trie of the pieces' bytes.

The vocabulary file's pieces are read straight from its protobuf. Scores are the file's where it is a Unigram model; a
BPE file's scores are ranks, from which log scores follow by Zipf's law. As in that library a character without a piece
of its own costs 10 more than the worst piece, and is written as its UTF-8 bytes.

A space becomes the marker, one is put in front, and decoding undoes both. A marker character of the text itself is
written as bytes, so that every text comes back exactly. No piece holds a marker behind another character, nor a newline
(checked when the file is loaded), so a text's best path is made of the best paths of its marked words; these are found
once for each distinct word of a batch, all words of a length together.

A null text is treated as empty; an empty text has no ids. Rows may repeat; further columns are not touched.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm._text import chunks, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = b"\xff"
#: From this many bytes a word is encoded by itself; so many words' ids are remembered.
LONG, REMEMBERED = 64, 400_000
_WORD = re.compile(rb"\n|\xff*[^\xff\n]+|\xff+")


def _fields(data: bytes):
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) in the order of ids, and the kind of model (1: Unigram, 2: BPE)."""
    pieces, kind = [], 1
    for n, x in _fields(data):
        if n == 1:
            f = dict(_fields(x))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
        elif n == 2:
            kind = dict(_fields(x)).get(3, 1)
    return pieces, kind


def zipf(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Scores by Zipf's law from ranks: the log of 1 / (rank + 1), so normalised that the shares add up to 1."""
    order = sorted((i for i, p in enumerate(pieces) if p[2] == 1), key=lambda i: -pieces[i][1])
    total = sum(1 / (r + 1) for r in range(len(order)))
    score = {i: -float(np.log((r + 1) * total)) for r, i in enumerate(order)}
    return [(p, score.get(i, s), t) for i, (p, s, t) in enumerate(pieces)]


class DoubleArray:
    """base, check and value of a trie on bytes: node t = base[s] + byte is a child of s if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        size = 1 << 10
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = wide = 257
        todo = [(0, sorted(keys.items()), 0)]
        while todo:
            node, items, depth = todo.pop()
            groups: dict[int, list] = defaultdict(list)
            for k, v in items:
                if len(k) == depth:
                    value[node] = v
                else:
                    groups[k[depth]].append((k, v))
            if not groups:
                continue
            codes = list(groups)
            while free < len(check) and check[free] >= 0:
                free += 1
            # Lone children fill gaps; wider nodes search from where the last ones found room.
            at = first = max(1, free - codes[0]) if len(codes) == 1 else max(1, wide)
            while True:
                while at + 256 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                if all(check[at + c] < 0 for c in codes):
                    break
                at += 1
            if len(codes) > 1 and at - first > 64:
                wide = at - 32
            base[node] = at
            for c in codes:
                check[at + c] = node
            todo += [(at + c, groups[c], depth + 1) for c in codes]
        pad = [0] * 256
        self.base, self.check, self.value = (np.array(x + [p] * 256, np.int32) for x, p in ((base + pad, 0), (check + [-1] * 256, -1), (value + [-1] * 256, -1)))


class Unigram:
    """Encoder and decoder. Only arrays, so that it can be sent to the tasks."""

    def __init__(self, data: bytes):
        pieces, kind = read_model(data)
        if kind == 2:
            pieces = zipf(pieces)
        mark = "▁"
        own = {p.replace(mark, "\0").encode().replace(b"\0", MARK): i for i, (p, _, t) in enumerate(pieces) if t in (1, 4) and p}
        if any(MARK in k.lstrip(MARK) or b"\n" in k for k in own):
            raise ValueError("a piece holds a marker behind another character, or a newline")
        self.trie = DoubleArray(own)
        self.score = np.array([s for _, s, _ in pieces], np.float32)
        self.unknown = np.float32(min((s for _, s, t in pieces if t == 1), default=0.0) - np.float32(10))
        self.bytes = np.full(256, -1, np.int32)
        for i, (p, _, t) in enumerate(pieces):
            if t == 6:
                self.bytes[int(p[3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.text = [p.replace(mark, " ").encode() if t != 6 else bytes([int(p[3:5], 16)]) for p, _, t in pieces]
        self._seen: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def _fallback(self, char: bytes) -> list[int]:
        if char == MARK:
            char = b" "
        return [int(self.bytes[b]) for b in char]

    def _one(self, word: bytes) -> bytes:
        """A single word of any length, in time proportional to it."""
        n, base, check, value, score = len(word), self.trie.base, self.trie.check, self.trie.value, self.score
        best, back = [-np.inf] * (n + 1), [(-1, -1)] * (n + 1)
        best[0] = np.float32(0)
        s = 0
        while s < n:
            step = 1
            while s + step < n and word[s + step] & 0xC0 == 0x80:
                step += 1
            node, e, single = 0, s, False
            here = best[s]
            while e < n:
                t = base[node] + word[e]
                if check[t] != node:
                    break
                node, e = t, e + 1
                v = value[node]
                if v >= 0:
                    single |= e == s + step
                    if here + score[v] > best[e]:
                        best[e], back[e] = here + score[v], (s, int(v))
            if not single and here + self.unknown > best[s + step]:
                best[s + step], back[s + step] = here + self.unknown, (s, -1)
            s += step
        out, e = [], n
        while e:
            s, v = back[e]
            out.append([v] if v >= 0 else self._fallback(word[s:e]))
            e = s
        return np.array([i for part in reversed(out) for i in part], np.int32).tobytes()

    def _many(self, words: list[bytes]) -> None:
        """Words of one length, together: a step of the trie moves all of them."""
        n, m = len(words[0]), len(words)
        w = np.frombuffer(b"".join(words), np.uint8).reshape(m, n)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        best, start, piece = np.full((m, n + 1), -np.inf, np.float32), np.zeros((m, n + 1), np.int16), np.full((m, n + 1), -1, np.int32)
        best[:, 0] = 0
        head = np.ones((m, n + 1), bool)
        head[:, :n] = (w & 0xC0 != 0x80) | (w == 255)
        for s in range(n):
            row = np.flatnonzero(head[:, s])
            node, single = np.zeros(len(row), np.int32), np.zeros(m, bool)
            alone, e = row, s
            while len(row) and e < n:
                t = base[node] + w[row, e]
                good = check[t] == node
                row, node, e = row[good], t[good], e + 1
                v = value[node]
                has = np.flatnonzero(v >= 0)
                if len(has):
                    r, v = row[has], v[has]
                    new = best[r, s] + score[v]
                    if e - s <= 4:
                        # A piece of one character: the next character begins where it ends.
                        one = head[r, e] & ~head[r, s + 1 : e].any(axis=1)
                        single[r[one]] = True
                    won = new > best[r, e]
                    r, v = r[won], v[won]
                    best[r, e], start[r, e], piece[r, e] = new[won], s, v
            alone = alone[~single[alone]]
            if len(alone):
                end = s + 1 + np.argmax(head[alone, s + 1 :], axis=1)
                new = best[alone, s] + self.unknown
                won = new > best[alone, end]
                r, end = alone[won], end[won]
                best[r, end], start[r, end], piece[r, end] = new[won], s, -1
        starts, pieces = start.tolist(), piece.tolist()
        for word, st, pc in zip(words, starts, pieces):
            out, e = [], n
            while e:
                s, v = st[e], pc[e]
                out.append([v] if v >= 0 else self._fallback(word[s:e]))
                e = s
            self._seen[word] = struct.pack(f"<{sum(map(len, out))}i", *[i for part in reversed(out) for i in part])

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids (int32) of each UTF-8 text."""
        split = [_WORD.findall(MARK + t.replace(b" ", MARK)) if t else [] for t in texts]
        new = {w for words in split for w in words} - self._seen.keys()
        if len(self._seen) + len(new) > REMEMBERED:
            self._seen = {}
            new = {w for words in split for w in words}
        by_size: dict[int, list[bytes]] = defaultdict(list)
        for w in new:
            if len(w) < LONG:
                by_size[len(w)].append(w)
            else:
                self._seen[w] = self._one(w)
        for words in by_size.values():
            for i in range(0, len(words), 4096):
                self._many(words[i : i + 4096])
        seen = self._seen
        return [np.frombuffer(b"".join([seen[w] for w in words]), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text."""
        text = self.text
        return b"".join([text[i] for i in ids.tolist()])[1:]


def load(path: str = VOCABULARY) -> Unigram:
    """The vocabulary file, read on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return Unigram(f.read())


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode(df: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), model: Unigram | None = None) -> DataFrame:
    """id columns and ids, an array of ints."""
    model = model or load()
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols]

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(len(id_cols)))
            for a, b in chunks(texts):
                ids = model.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(id_cols))], _lists(ids)], [*id_cols, "ids"])

    return df.select(*id_cols, F.col(text_col).cast("string")).mapInArrow(run, ", ".join([*kinds, "ids array<int>"]))


def decode(df: DataFrame, ids_col: str = "ids", id_cols: tuple[str, ...] = ("doc_id",), model: Unigram | None = None) -> DataFrame:
    """id columns and text, decoded from ids."""
    model = model or load()
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols]

    def run(batches):
        for batch in batches:
            ids = batch.column(len(id_cols))
            texts = [model.decode(x.values.to_numpy()) if x.is_valid else b"" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(texts, pa.binary()).cast(pa.string())], [*id_cols, "text"])

    return df.select(*id_cols, ids_col).mapInArrow(run, ", ".join([*kinds, "text string"]))


def report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Unigram | None = None, with_ids: bool = False) -> DataFrame:
    """For each row: doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian 32-bit words), text_sha256
    of the text decoded from the ids, round_trip: whether it is the row's text; and ids, if asked for."""
    model = model or load()
    of = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "text_sha256", "round_trip"] + ["ids"] * with_ids

    def run(batches):
        low = np.zeros(len(model.score), np.int64)
        low[model.bytes] = 1
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                ids = model.encode_batch(texts[a:b])
                back = [model.decode(x) for x in ids]
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(low[x].sum()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    pa.array([x == y for x, y in zip(back, texts[a:b])], pa.bool_()),
                ]
                if with_ids:
                    cols.append(_lists(ids))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {of}, n_tokens long, n_byte_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, schema)
