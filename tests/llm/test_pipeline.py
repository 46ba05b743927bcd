import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from ragtide.llm import quality, sentencepiece

from .test_decontaminate import leaks
from .test_line_dedup import distance
from .test_minhash import brute as groups


def close(a, b):
    if a == b or abs(len(a) - len(b)) > 2:
        return False
    x, y = Counter(a), Counter(b)
    return sum(((x - y) + (y - x)).values()) <= 4 and distance(a, b) <= 2


def without_repeated_lines(rows):
    occ = [(doc, n, line) for doc, text in rows for n, line in enumerate((text or "").split("\n")) if len(line) >= 40]
    kinds = sorted({o[2] for o in occ}, key=len)
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in reversed(kinds[:i]):
            if len(a) - len(b) > 2:
                break
            if close(a, b):
                root[find(a)] = find(b)
    head, gone = {}, set()
    for o in sorted(occ):
        if head.setdefault(find(o[2]), o) != o:
            gone.add(o[:2])
    out = []
    for doc, text in rows:
        lost = any((doc, n) in gone for n in range(len((text or "").split("\n"))))
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (doc, n) not in gone)
        if not lost or left.strip():
            out.append((doc, left))
    return out


def test_every_stage_against_brute_force(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    weights = quality.train(docs, read("labels"))
    rows = [r for r in rows if quality.scores([(r[1] or "").encode()], weights)[0] >= quality.CUT]
    assert len(rows) > 50
    rows = without_repeated_lines(rows)
    kept = {x[0] for x in groups(rows, 80) if x[3]}
    rows = [r for r in rows if r[0] in kept]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    bad = leaks(rows, items)
    assert any(bad)
    rows = [r for r, gone in zip(rows, bad) if not gone]
    model = sentencepiece.load()
    want = {}
    for doc, text in rows:
        ids = model.encode_batch([(text or "").encode()])[0]
        want[doc] = (len(ids), hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest(), True)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["round_trip"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_dedup", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
