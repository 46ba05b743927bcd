"""Operators against plain Python lists."""

import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import ragtide as rt

ROWS = st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(-9, 9)), max_size=5)), min_size=1, max_size=8)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def over(rows, fn):
    return [None if r is None else fn(r) for r in rows]


@QUICK
@given(rows=ROWS)
def test_many_operators(spark, rows):
    a = rt.from_rows(rows, npartitions=2, schema="array<bigint>", spark=spark)
    there = lambda r: [x for x in r if x is not None]
    made = rt.zip(
        {
            "sum": rt.sum(a, axis=1), "max": rt.max(a, axis=1), "argmin": rt.argmin(a, axis=1), "count": rt.count(a, axis=1), "sort": rt.sort(a), "argsort": rt.argsort(a, ascending=False),
            "pairs": rt.combinations(a, 2), "triples": rt.argcombinations(a, 3), "filter": a[a > 0], "pad": rt.pad_none(a, 3, clip=True), "back": a[:, ::-2], "drop": rt.drop_none(a, axis=1), "runs": rt.run_lengths(a),
        },
        depth_limit=1,
    )
    got = made.compute()
    expect = {
        "sum": over(rows, lambda r: sum(there(r))),
        "max": over(rows, lambda r: max(there(r), default=None)),
        "argmin": over(rows, lambda r: r.index(min(there(r))) if there(r) else None),
        "count": over(rows, lambda r: len(there(r))),
        "sort": over(rows, lambda r: sorted(there(r)) + [None] * r.count(None)),
        "argsort": over(rows, lambda r: sorted(range(len(r)), key=lambda i: (r[i] is None, -(r[i] or 0), i))),
        "pairs": over(rows, lambda r: list(itertools.combinations(r, 2))),
        "triples": over(rows, lambda r: list(itertools.combinations(range(len(r)), 3))),
        "filter": over(rows, lambda r: [x for x in r if x is not None and x > 0]),
        "pad": over(rows, lambda r: (r + [None] * 3)[:3]),
        "back": over(rows, lambda r: r[::-2]),
        "drop": over(rows, there),
        "runs": over(rows, lambda r: [len(list(g)) for _, g in itertools.groupby(r)]),
    }
    for name, want in expect.items():
        assert [g[name] for g in got] == want, name


@QUICK
@given(rows=ROWS, start=st.integers(-6, 9), stop=st.one_of(st.none(), st.integers(-6, 9)), step=st.integers(1, 3))
def test_slices(spark, rows, start, stop, step):
    a = rt.from_rows(rows, npartitions=3, schema="array<bigint>", spark=spark)
    assert a[start:stop:step].compute() == rows[start:stop:step]
    assert a[:, start:stop:step].compute() == over(rows, lambda r: r[start:stop:step])
    assert rt.sum(a).compute() == sum(x for r in rows if r for x in r if x is not None)
