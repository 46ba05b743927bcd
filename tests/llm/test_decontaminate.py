import random
import re

import pytest

from oracle import compare, connect
from ragtide.llm import decontaminate as d
from ragtide.llm import queries
from ragtide.llm._text import NON_WORD, Words

from .conftest import LONG


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def finds(docs, items, size=13):
    """Of each document its id, number of words, hit places and items."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (t := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[t]
        yield doc, w, hit, found


def leaks(docs, items, size=13):
    """For each document whether it holds a passage: a stretch of hit words, or a twentieth of all."""
    out = []
    for _, w, hit, _ in finds(docs, items, size):
        stretch = any(all(i + j in hit for j in range(size)) for i in hit)
        out.append(stretch or len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def brute(docs, items, size=13):
    out = []
    for doc, w, hit, found in finds(docs, items, size):
        out.append((doc, len(w), len(hit), len(found), d.items_digest(list(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(["the", "a", "Of", "to", "w%d" % r.randrange(40)]) for _ in range(n))
    items = [(i, some(r.choice([3, 12, 13, 14, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (None, some(15)), (3, some(20)), (3, "x1 y2")]
    docs = []
    for i in range(60):
        text = some(r.randrange(0, 300))
        if i % 3 == 0:
            text += "! " + (r.choice(items)[1] or "").upper().replace(" ", ", ") + " " + some(50)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "--"), (5, docs[5][1]), (None, items[0][1]), (103, LONG + (items[4][1] or "")), (104, "x1 y2")]
    return docs, items


@pytest.mark.parametrize("room", [64 << 20, 2000])
def test_against_brute_force(spark, documents, case, room):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.verdict(d.find_items(documents(docs), bench, max_broadcast_bytes=room)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(docs, items)


@pytest.mark.parametrize("room", [64 << 20, 9000])
def test_dropping(spark, documents, case, room):
    docs, items = case
    docs = [*docs, (5, "another text"), (None, "and one without an id"), (200, "far " * 600 + items[4][1] + " away" * 600), (201, "far " * 600 + "x1 y2" + " away" * 600)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(docs).selectExpr("*", "'mine' AS __th", "'too' AS row", "1 AS digest", "0 AS hits")
    kept = d.drop_contaminated(table, bench, max_broadcast_bytes=room)
    assert kept.columns == table.columns
    bad = leaks(docs, items)
    assert sorted((str(x["doc_id"]), x["text"] or "", x["__th"]) for x in kept.collect()) == sorted((str(i), t or "", "mine") for (i, t), b in zip(docs, bad) if not b)
    assert 20 < sum(bad) < len(bad) - 9 and bad[-2:] == [len(words(items[4][1])) >= 13, False]


def test_words_that_a_polynomial_confuses(spark, documents):
    a = "ab"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    got = {x["doc_id"]: (x["n_hit"], x["n_items"], x["contaminated"]) for x in d.verdict(d.find_items(documents([(1, a), (2, b)]), bench)).collect()}
    assert got == {1: (1, 1, True), 2: (0, 0, False)}
    w = Words([a.encode(), b.encode(), a.upper().encode()], NON_WORD)
    assert w.hash[0] == w.hash[2] != w.hash[1]


def test_empty(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.find_items(documents([]), bench).collect() == []
    got = d.verdict(d.find_items(documents([(1, "some words here")]), bench)).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (3, 0, False)
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.find_items(documents([]), one).collect() == []


def test_query_is_its_sql(spark, sf_dir):
    compare(queries.QUERIES["op7_decontaminate"](spark, sf_dir), connect(sf_dir), queries.SQL["op7_decontaminate"])
