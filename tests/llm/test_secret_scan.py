import hashlib
import math
import random
import re
import string

from ragtide.llm import queries
from ragtide.llm import secret_scan as s

from .conftest import LONG

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(out)


def joined(found):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in found)


def check(rows, got):
    assert sorted((i or 0, joined(brute(t)), *[sum(k == j for _, k, _ in brute(t)) for j in range(3)]) for i, t in rows) == sorted((r["id"] or 0, r["base"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got)


def test_base_spans(documents):
    r = random.Random(4)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", "=", ": ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "deadbeef" * 3, "é", " ", "x1", "\n", "secret=", "/+._-", "Z9"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1, rows[1][1]), (None, "token=abcdefghijklm"), (1002, LONG + "secret: abcdefghijkl")]
    check(rows, s.find_secrets(documents(rows)).collect())
    assert s.find_secrets(documents([])).collect() == []


def test_random_tokens_are_found_and_words_are_not(documents):
    r = random.Random(5)
    alphabet = string.ascii_letters + string.digits + "+/"
    rows, keys = [], {}
    for i in range(300):
        words = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "internationalisation_framework_module", "some/path/to/a/file/in/the/tree"]) for _ in range(40))
        if i % 10 == 0:
            keys[i] = "".join(r.choice(alphabet) for _ in range(64))
            words += " " + keys[i]
        rows.append((i, words))
    found = {x["id"]: x["spans"] for x in s.find_secrets(documents(rows)).collect() if "random:" in x["spans"]}
    assert set(found) <= set(keys)
    assert len(found) >= 27
    for i, spans in found.items():
        at = dict(rows)[i].index(keys[i])
        assert f"random:{at}:{at + 64}" in spans


def deviates(token, alphabet):
    """Chi-squared statistic and the runs' and neighbours' deviates, symbol by symbol."""
    v, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    chi = sum((v.count(x) - n / k) ** 2 for x in range(k)) * k / n
    high = [2 * x >= k for x in v]
    hi, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mu = 1 + 2 * hi * (n - hi) / n
    z_runs = 99 if hi in (0, n) else (runs - mu) / math.sqrt(max(1e-9, (mu - 1) * (mu - 2) / (n - 1)))
    serial = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(v, v[1:]))
    return chi, z_runs, serial / ((k * k - 1) / 12) / math.sqrt(n - 1)


def test_battery_at_every_length(spark):
    r = random.Random(7)
    hexa, b32, b64 = s._ALPHABETS["hex"], s._ALPHABETS["base32"], s._ALPHABETS["base64"]
    rows = []
    for n in (20, 21, 64, 4095, 4096, 4097, 8191, 8192, 8193, 20_001):
        rows += [("".join(r.choice(a) for _ in range(n)), a) for a in (hexa, b32, b64)]
    rows += [("0" * 5000, hexa), ("08" * 2500, hexa), ("ab/+" * 3000, b64), ("f" * 4097, hexa)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, text string")
    got = {x["id"]: x for x in s.battery(s.tokens(df, ["id"])).collect()}
    assert len(got) == len(rows)
    for i, (t, a) in enumerate(rows):
        assert (got[i]["n"], got[i]["k"]) == (len(t), len(a))
        for x, y in zip((got[i]["chi"], got[i]["z_runs"], got[i]["z_serial"]), deviates(t, a)):
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


def test_long_random_tokens_are_found(documents):
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "Delta", "Epsilon 12", "internationalisation_framework_module", "some/path/to/a/file/in/the/tree"]
    rows, want = [(i, " ".join(r.choice(words) for _ in range(1000))) for i in range(100)], {}
    for i, (n, a) in enumerate([(4096, "base64"), (4097, "base64"), (6000, "hex"), (50_000, "base64"), (300_000, "base64"), (40_000, "hex")], 200):
        rows.append((i, "key " + "".join(r.choice(s._ALPHABETS[a]) for _ in range(n)) + " end"))
        want[i] = f"random:4:{4 + n}"
    rows += [(300, "some/path/to/a/file/in/the/tree/" * 1000)]
    got = {x["id"]: x["spans"] for x in s.find_secrets(documents(rows)).collect()}
    assert {i: [x for x in spans.split(",") if x.startswith("random:")] for i, spans in got.items() if "random:" in spans} == {i: [x] for i, x in want.items()}


def encoding(token):
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        return "hex", token.lower()
    return ("base32" if re.fullmatch("[A-Z2-7]+", token) else "base64"), token.replace("-", "+").replace("_", "/")


def log_p(z):
    return math.log(0.5 * math.erfc(-z / math.sqrt(2))) if z > -37 else -z * z / 2


def brute_random(rows):
    """(row, start, end) of the tokens found, by the definitions; and of those that exact chances would leave."""
    toks, seen = [], {}
    for i, (_, text) in enumerate(rows):
        for c in text or "":
            seen[c] = seen.get(c, 0) + 1
        for m in re.finditer("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*", text or ""):
            if len(t := m[0].rstrip("=")) >= 20:
                toks.append((i, m.start(), t, *encoding(t)))
                for c in t:
                    seen[c] -= 1
    model = {}
    for enc, a in s._ALPHABETS.items():
        if total := sum(seen.get(c, 0) for c in a):
            p, k = [seen.get(c, 0) / total for c in a], len(a)
            model[enc] = k * sum(x**2 for x in p) - 1, 4 * k * k * (sum(x**3 for x in p) - sum(x**2 for x in p) ** 2)
    by_class = {}
    for i, start, t, enc, plain in toks:
        k, n = len(s._ALPHABETS[enc]), len(t)
        chi, z_runs, z_serial = deviates(plain, s._ALPHABETS[enc])
        z_chi = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
        even = -s.REJECT - 1 <= z_chi <= s.REJECT and abs(z_runs) <= s.REJECT and abs(z_serial) <= s.REJECT
        d, v = model.get(enc, (None, None))
        ln_p = 0.0 if d is None else log_p((chi - (k - 1) - n * d) / math.sqrt(2 * (k - 1) + n * v))
        by_class.setdefault((enc, int(math.log2(n / 20))), []).append((ln_p, even, (i, start, start + n)))
    found, exact = set(), set()
    for group in by_class.values():
        m = len(group)
        bins = [min(s.BINS - 1, math.floor(-8 * x)) for x, *_ in group]
        cuts = [b for b in bins if math.exp(-b / 8) <= s.RATE * sum(c >= b for c in bins) / m]
        found |= {at for (_, even, at), b in zip(group, bins) if cuts and even and b >= min(cuts)}
        ranked = sorted(x for x, *_ in group)
        top = max((x for j, x in enumerate(ranked, 1) if x <= math.log(s.RATE * j / m)), default=-math.inf)
        exact |= {at for x, even, at in group if even and x <= top}
    return found, exact


def test_random_spans_against_brute_force(documents):
    r = random.Random(17)
    words = ["alpha", "Beta", "gamma", "delta 12", "EPSILON", "internationalisation_framework_module", "some/path/to/a/file/in/the/tree", "deadbeefdeadbeefdeadbeef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "é"]
    rows = []
    for i in range(250):
        text = [r.choice(words) for _ in range(30)]
        for _ in range(r.choice([0, 0, 1, 3])):
            a = r.choice([*s._ALPHABETS.values(), "0123456789ABCDEF", "aeioubcdrstln", "abcdefghijklmnopqrstuvwxyz0123456789"])
            text.insert(r.randrange(30), "".join(r.choice(a) for _ in range(r.choice([19, 20, 24, 32, 40, 64, 100, 700]))) + r.choice(["", "=", "=="]))
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, "")]
    found, exact = brute_random(rows)
    got = set()
    for x in s.find_secrets(documents(rows)).collect():
        got |= {(i, int(a), int(b)) for i, row in enumerate(rows) if row[0] == x["id"] for k, a, b in (y.split(":") for y in x["spans"].split(",") if y) if k == "random"}
    assert got == found <= exact and len(found) > 60 and len(exact - found) < 10


def test_normal_tail(spark):
    zs = [-30.0, -12.5, -8.0, -6.0, -5.0, -3.2, -1.0, -0.01, 0.0, 0.5, 3.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").selectExpr("z", f"{s._log_normal_tail('z')} AS p")
    for z, p in df.collect():
        assert math.isclose(p, log_p(z), rel_tol=1e-6, abs_tol=2e-7), z


def test_blobs_do_not_mask_keys(documents):
    r = random.Random(19)
    b64 = s._ALPHABETS["base64"]
    words = ["alpha", "beta", "gamma", "Delta", "Epsilon 12", "some/path/to/a/file/in/the/tree"]
    rows, want = [], set()
    for i in range(300):
        text = " ".join(r.choice(words) for _ in range(40))
        for j, n in ((0, 64), (1, 4000)):
            if i % 10 == j:
                want.add((i, n))
                text += " " + "".join(r.choice(b64) for _ in range(n))
        rows.append((i, text))
    got = set()
    for x in s.find_secrets(documents(rows)).collect():
        got |= {(x["id"], int(b) - int(a)) for k, a, b in (y.split(":") for y in x["spans"].split(",") if y) if k == "random"}
    assert got <= want and len(got) >= 57


def test_upper_case_hex_is_hex(spark, documents):
    r = random.Random(13)
    words = ["alpha", "beta", "gamma", "Delta", "Epsilon 12", "some/path/to/a/file/in/the/tree"]
    rows = [(i, " ".join(r.choice(words) for _ in range(100))) for i in range(100)]
    keys = {200 + i: "".join(r.choice("0123456789ABCDEF") for _ in range(64)) for i in range(20)}
    rows += [(i, f"key {t} end") for i, t in keys.items()]
    df = documents(rows)
    encs = {x["id"]: (x["enc"], x["plain"]) for x in s.tokens(df.selectExpr("doc_id AS id", "text"), ["id"]).where("id >= 200").collect()}
    assert encs == {i: ("hex", t.lower()) for i, t in keys.items()}
    found = {x["id"] for x in s.find_secrets(df).collect() if "random:4:68" in x["spans"]}
    assert found <= set(keys) and len(found) >= 18


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op5_secrets"](spark, sf_dir).collect():
        assert r["base_sha256"] == hashlib.sha256(joined(brute(texts[r["doc_id"]])).encode()).hexdigest()


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.QUERIES["op5_secrets"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
