import random
import re
from collections import Counter

from oracle import compare, connect
from ragtide.llm import minhash_dedup as m
from ragtide.llm import queries

from .conftest import LONG


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both)) or (rows[i][0] is not None and rows[i][0] == rows[j][0] and a == sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id is not None and doc_id == least))
    return sorted(out, key=str)


def check(docs, rows):
    got, want = Counter(tuple(x) for x in m.near_duplicates(docs, 85).collect()), Counter(brute(rows, 85))
    assert [got - want, want - got] == [Counter(), Counter()]


def changed(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return w


def test_groups_chains_and_odd_rows(documents):
    r = random.Random(2)
    rows, k = [], 0
    for _ in range(12):
        words = [f"w{r.randrange(300)}" for _ in range(r.choice([8, 60, 200]))]
        for _ in range(8):
            words = changed(r, words, r.choice([0, 1, 2, 8]))
            rows.append((k * 7 % 500, " ".join(words)))
            k += 1
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "two one"), (906, LONG), (907, LONG + " end"), (906, LONG), (None, "one two"), (None, "nobody else says this here"), (908, "a\u00a0b c d e f")]
    check(documents(rows), rows)


def test_a_crowded_bucket_is_looked_through(documents, monkeypatch):
    """Texts that share three quarters of their words with each other, and among them pairs that are nearer."""
    monkeypatch.setattr(m, "BLOCK", 16)
    r = random.Random(3)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for k in range(60):
        own = [f"x{k}_{i}" for i in range(22)]
        rows.append((k, " ".join(common + own)))
    for k in range(20, 40):
        rows.append((100 + k, rows[k][1] + " tail"))
    r.shuffle(rows)
    check(documents(rows), rows)


def test_least_shared():
    assert 60 < m.least_shared(80) < m.least_shared(85) < m.least_shared(95) < 120


def test_one_of_each_group_stays(documents):
    text = " ".join(f"w{i}" for i in range(100))
    docs = documents([(5, text), (3, text + " more"), (9, "else where is nothing like it"), (3, text + " more"), (None, text)])
    kept = m.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == [3, 9]


def test_empty(documents):
    assert m.near_duplicates(documents([])).collect() == []


def test_query_is_its_sql(spark, sf_dir):
    compare(queries.QUERIES["op4_minhash"](spark, sf_dir), connect(sf_dir), queries.SQL["op4_minhash"])


def test_rows_without_an_id_and_repeated_ids(documents):
    r = random.Random(23)
    words = [f"w{r.randrange(300)}" for _ in range(80)]
    a, near, b, c = " ".join(words), " ".join(changed(r, words, 1)), "nobody with an id says this here", "a text with two rows under one id"
    rows = [(1, a), (None, a), (None, near), (None, b), (None, b), (None, b.upper()), (None, None), (None, ""), (5, c), (5, "b " + c), (7, "b " + c), (7, "b " + c)]
    df = documents(rows).selectExpr("*", "'mine' AS row", "'too' AS node", "1 AS own")
    got = Counter(tuple(x) for x in m.near_duplicates(df, 80).collect())
    assert {k: v for k, v in got.items() if k[0] is None} == {(None, 76, 1, False): 2, (None, 3, None, False): 3, (None, 0, None, False): 2}
    kept = m.drop_near_duplicates(df)
    assert kept.columns == df.columns
    texts = Counter((x["doc_id"], x["text"] and x["text"].lower(), x["row"], x["node"]) for x in kept.collect())
    five = {x["doc_id"]: x["component_id"] for x in m.near_duplicates(df, 80).collect()}
    assert five[5] == 5 and five[7] in (5, 7)
    want = Counter({(1, a, "mine", "too"): 1, (None, b, "mine", "too"): 1, (None, None, "mine", "too"): 1, (None, "", "mine", "too"): 1, (5, min(c, "b " + c), "mine", "too"): 1})
    if five[7] == 7:
        want[7, "b " + c, "mine", "too"] = 1
    assert texts == want
    # The same whatever order the rows come in.
    again = {x["doc_id"]: x["component_id"] for x in m.near_duplicates(documents(rows[::-1]), 80).collect()}
    assert again == five


def test_words_that_a_polynomial_confuses(documents):
    a = "ab"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    got = {x["doc_id"]: (x["component_id"], x["kept"]) for x in m.near_duplicates(documents([(1, a), (2, b)])).collect()}
    assert got == {1: (1, True), 2: (2, True)}
