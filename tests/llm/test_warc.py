import gzip
import hashlib

import pytest

from ragtide.llm import warc


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first long")


def brute(rows):
    raw = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for i, p in raw:
        ids = [j for j, q in raw if q == p and j is not None]
        first = min(ids, default=None) if len(p) >= 100 else None
        revisit = first is not None and first != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_pages(pages):
    big = "<p>ü\r\n\r\nContent-Length: 3</p>" * 20
    rows = [(3, "http://a/ä", big), (1, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (1, None, big), (None, "u", big), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "x" * 100), (11, "u", "x" * 100), (12, "u", "y" * 9_000_000)]
    rows = [(*r, "clash", 0) for r in rows]
    assert sorted((tuple(r) for r in warc.round_trip(pages(rows)).collect()), key=str) == brute(rows)
    assert warc.round_trip(pages([])).count() == 0


def test_normaliser_cuts_members():
    recs = [warc.record(i, b"http://x", b"payload %d" % i, "d", None if i % 2 else 7) for i in range(50)]
    for whole in (gzip.compress(b"".join(recs)), b"".join(gzip.compress(b"".join(recs[i : i + 7])) for i in range(0, 50, 7))):
        data, index = warc.normalise(whole)
        assert [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index] == recs
        assert index[3]["record_id"] == "<urn:page:3>" and gzip.decompress(data) == b"".join(recs)
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(recs[0][:-10]))


def test_pieces_of_any_size():
    data = b"".join(warc.record(i, b"u", b"z" * i, "d", None) for i in range(200))
    for step in (1, 7, 1000):
        cutter, got = warc.RecordCutter(), []
        for i in range(0, len(data), step):
            got += cutter.feed(data[i : i + step])
        got += cutter.end()
        assert b"".join(got) == data and len(got) == 200


def test_truncated_archives_are_errors():
    recs = [warc.record(i, b"u", b"payload of some length %d" % i * 40, "d", None) for i in range(9)]
    whole = gzip.compress(b"".join(recs))
    for cut in (1, 4, 8, 9, 30, len(whole) // 2, len(whole) - 5):
        with pytest.raises(ValueError):
            warc.normalise(whole[:-cut])
    members = b"".join(map(gzip.compress, recs))
    with pytest.raises(ValueError):
        warc.normalise(members[:-3])
    assert warc.normalise(b"") == (b"", [])


def test_time_is_linear_in_a_record():
    import time

    def took(n):
        data, cutter = warc.record(1, b"u", b"z" * n, "d", None), warc.RecordCutter()
        start = time.perf_counter()
        got = [x for i in range(0, len(data), 1 << 14) for x in cutter.feed(data[i : i + (1 << 14)])]
        assert len([*got, *cutter.end()]) == 1
        return time.perf_counter() - start

    few = min(took(2 << 20) for _ in range(3))
    assert took(32 << 20) < 60 * few + 0.3


def test_many_repeated_digests_are_joined(pages):
    rows = [(i, "u", "copy of %d " % (i % 7) * 20, "clash", 0) for i in range(30)]
    archives = warc.normalise_archives(warc.write_archives(pages(rows), max_broadcast_rows=2))
    assert sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=str) == brute(rows)
