import random
import re

from ragtide.llm import pii
from ragtide.llm.queries import QUERIES

from .conftest import LONG

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    for k, pattern, good in (
        (0, EMAIL, lambda s: True),
        (1, IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        (2, CARD, lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (3, PHONE, lambda s: 10 <= len(digits(s)) <= 15),
    ):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if good(m[0])]
    return sorted(out)


def base(text):
    return [s for s in pii.spans(text) if s[1] < 4]


def test_base_spans_are_the_patterns():
    r = random.Random(1)
    parts = ["a", "b.", "@", ".", "-", "+", "1", "22", "255", "256", "1.2.3.4", "x@y.z", "4111 1111 1111 1111", "+49 (30) 1234567", " ", "%", "é", "٣", "\n", "http://", "0"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert base(text) == brute(text), text


def test_added_kinds():
    kinds = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.spans(t) if k >= 4]
    assert kinds("see https://u:p@ex.org:80/a?b=1, ok") == [("url", "https://u:p@ex.org:80/a?b=1")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00.") == []
    assert kinds("Account no. 1234-5678 closed") == [("account", "1234-5678")]
    assert kinds("http://") == [] and kinds("") == []


def test_time_is_linear():
    import time

    def took(text):
        start = time.perf_counter()
        pii.spans(text)
        return time.perf_counter() - start

    for part in ("http://x/", "http://x:y@", "a@", "@a.", "1.", "1.2.3.", "12", "1 ", "+1 ", "+", "iban ", "account 1", "x@y.z", "http://a.b/,"):
        n = 40_000 // len(part)
        few = min(took(part * n) for _ in range(2))
        assert took(part * 8 * n) < 24 * few + 0.3, part


def test_redaction():
    assert pii.redact("write a@b.org or 10.0.0.1") == "write <email> or <ip>"
    assert pii.redact(None) == ""


def test_rows(documents):
    rows = [(1, "a@b.c"), (2, None), (3, ""), (1, "a@b.c"), (None, "1.2.3.4"), (5, LONG + "x@y.zz"), (6, "@" * 50_000)]
    got = pii.find_pii(documents(rows)).collect()
    assert sorted((r["id"] or 0, [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in got) == sorted((i or 0, [(s, pii.KINDS[k], e) for s, k, e in pii.spans(t or "")]) for i, t in rows)
    assert pii.find_pii(documents([])).count() == 0


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op2_pii"](spark, sf_dir).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == pii.digest(want)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in want) for i in range(4)]
