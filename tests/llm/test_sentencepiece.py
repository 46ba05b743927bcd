import hashlib
import random

import numpy as np
import pytest

from ragtide.llm import queries
from ragtide.llm import sentencepiece as sp

from .conftest import LONG


@pytest.fixture(scope="module")
def model():
    return sp.load()


@pytest.fixture(scope="module")
def pieces():
    with open(sp.VOCABULARY, "rb") as f:
        p, kind = sp.read_model(f.read())
    return sp.zipf(p) if kind == 2 else p


def viterbi(pieces, unknown, bytes_, text):
    """Best score of the whole text, by a plain dictionary over all of it at once."""
    own = {p.replace("▁", " "): (i, s) for i, (p, s, t) in enumerate(pieces) if t in (1, 4) and p}
    text = " " + text
    best = [(0.0, [])] + [(-1e30, None)] * len(text)
    for i in range(len(text)):
        if best[i][1] is None:
            continue
        for j in range(i + 1, min(len(text), i + 24) + 1):
            if text[i:j] in own:
                k, s = own[text[i:j]]
                if best[i][0] + s > best[j][0]:
                    best[j] = (best[i][0] + s, best[i][1] + [k])
        if text[i] not in own and best[i][0] + unknown > best[i + 1][0]:
            best[i + 1] = (best[i][0] + unknown, best[i][1] + [int(bytes_[b]) for b in text[i].encode()])
    return best[-1]


TEXTS = ["Hello world", "the quick brown fox", "naïve café — über", "日本語のテキスト", "a  b   c ", "\n\nline\n", "▁mark▁", "x" * 200, "😀😁 ok", "1234567890", "internationalisation"]


def test_scores_are_the_best(model, pieces):
    byte_ids = set(model.bytes.tolist())
    for text in TEXTS:
        if "▁" in text:
            continue
        ids = model.encode_batch([text.encode()])[0]
        total, unseen = 0.0, 0
        own = {p.replace("▁", " ") for p, _, t in pieces if t in (1, 4)}
        for i in ids.tolist():
            total += 0.0 if i in byte_ids else float(model.score[i])
        unseen = sum(c not in own for c in " " + text)
        want = viterbi(pieces, float(model.unknown), model.bytes, text)[0]
        assert total + unseen * float(model.unknown) == pytest.approx(want, abs=1e-2), text


def test_round_trip(model):
    r = random.Random(1)
    texts = [t.encode() for t in TEXTS] + ["".join(chr(r.choice([32, 10, 9, 0x2581, r.randrange(33, 0x2FF), r.randrange(0x1F300, 0x1F600)])) for _ in range(r.randrange(90))).encode() for _ in range(300)]
    for text, ids in zip(texts, model.encode_batch(texts)):
        assert model.decode(ids) == text


def test_long_words_are_encoded_like_short_ones(model):
    for word in ("ab" * 31, "é" * 31, "zq" * 30):
        own = sp.MARK + word.encode()
        model._seen.pop(own, None)
        model._many([own])
        assert model._seen[own] == model._one(own)


def test_double_array():
    r = random.Random(2)
    keys = {bytes(r.randrange(1, 255) for _ in range(r.randrange(1, 6))): i for i in range(3000)}
    trie = sp.DoubleArray(keys)

    def find(k):
        node = 0
        for b in k:
            t = trie.base[node] + b
            if trie.check[t] != node:
                return -1
            node = t
        return trie.value[node]

    assert all(find(k) == v for k, v in keys.items())
    assert all(find(k + b"\xff") == -1 for k in keys)


def test_rows(documents, model):
    rows = [(1, "hello"), (2, None), (3, ""), (1, "hello"), (None, "x"), (4, LONG)]
    got = sp.report(documents(rows)).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0
    assert by[4]["text_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert by[1]["ids_sha256"] == hashlib.sha256(model.encode_batch([b"hello"])[0].astype("<i4").tobytes()).hexdigest()
    assert sp.report(documents([])).collect() == []


def test_encode_and_decode_frames(documents):
    docs = documents([(1, "hello there"), (2, None), (3, "")])
    back = {r["doc_id"]: r["text"] for r in sp.decode(sp.encode(docs)).collect()}
    assert back == {1: "hello there", 2: "", 3: ""}


def test_the_marker_comes_first(model):
    ids = model.encode_batch([b"hello"])[0]
    assert model.text[int(ids[0])].startswith(b" ") and np.issubdtype(ids.dtype, np.integer)


def test_query_against_brute_force(spark, sf_dir, model, pieces):
    """Whole documents: every row's ids score best, and what comes back is the text."""
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_sentencepiece"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        assert got[doc]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[doc]["round_trip"]
    few = sorted((d for d, t in texts.items() if t and "▁" not in t), key=lambda d: len(texts[d]))[:25]
    byte_ids, own = set(model.bytes.tolist()), {p.replace("▁", " ") for p, _, t in pieces if t in (1, 4)}
    for doc in few:
        ids = model.encode_batch([texts[doc].encode()])[0]
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest())
        total = sum(float(model.score[i]) for i in ids.tolist() if i not in byte_ids) + sum(c not in own for c in " " + texts[doc]) * float(model.unknown)
        assert total == pytest.approx(viterbi(pieces, float(model.unknown), model.bytes, texts[doc])[0], rel=1e-5, abs=1e-2)
