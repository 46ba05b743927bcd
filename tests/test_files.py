import gzip
import json
import lzma
import math

import numpy as np
import pytest

import ragtide as rt
from ragtide.sources.files import schema_of_jsonschema


def test_parquet_order_columns_and_report(spark, tmp_path):
    a = rt.from_lists([[{"p": [{"x": i, "y": -i, "z": 0}], "foo": i}] * 3 for i in range(4)], spark=spark)
    path = rt.to_parquet(a, str(tmp_path / "p"))
    b = rt.from_parquet(path, spark=spark)
    assert b.compute() == a.compute()
    assert b.foo[5:8].compute() == [1, 2, 2]
    assert rt.from_parquet(path, columns=["p.[xy]"], spark=spark)[:1].compute() == [{"p": [{"x": 0, "y": 0}]}]
    assert rt.from_parquet(path, columns="p.x", spark=spark).fields == ["p"]
    known = rt.from_parquet(path, split_row_groups=True, spark=spark)
    assert known.known_divisions and len(known) == 12
    (tmp_path / "p" / "broken.parquet").write_bytes(b"not parquet")
    c, report = rt.from_parquet(path, report=True, schema=b.frame.df.select("p", "foo").schema, spark=spark)
    assert rt.num(c, axis=0).compute() == 12
    bad = [r for r in report.collect() if not r["ok"]]
    assert len(bad) == 1 and bad[0]["path"].endswith("broken.parquet")


def test_json_round_trip_and_packings(spark, tmp_path):
    rows = [{"name": "a", "goals": [1, 2]}, {"name": "b", "goals": []}, {"name": None, "goals": [None]}]
    text = "\n".join(map(json.dumps, rows)) + "\n"
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "a.json.xz").write_bytes(lzma.compress(text.encode()))
    for name in ("a.json", "a.json.gz", "a.json.xz"):
        got = rt.from_json(str(tmp_path / name), spark=spark)
        assert rt.zip({"name": got.name, "goals": got.goals}, depth_limit=1).compute() == rows
    (tmp_path / "one.json").write_text(json.dumps({"record": [1, 2, 3]}, indent=1))
    assert rt.from_json(str(tmp_path / "one.json"), line_delimited=False, spark=spark).record.compute() == [[1, 2, 3]]
    schema = {"type": "object", "properties": {"goals": {"type": "array", "items": {"type": ["integer", "null"]}}}}
    assert rt.from_json(str(tmp_path / "a.json"), schema=schema, spark=spark).compute()[0] == {"goals": [1, 2]}
    (tmp_path / "bad.json").write_text('{"name": "a"}\n{"name": \n')
    with pytest.raises(Exception, match="not JSON"):
        rt.from_json(str(tmp_path / "bad.json"), schema="name string", spark=spark).compute()
    good, report = rt.from_json(str(tmp_path / "bad.json"), schema="name string", report=True, spark=spark)
    assert [r["bad_lines"] for r in report.collect()] == [1]
    assert rt.num(good, axis=0).compute() == 2


def test_json_special_numbers_and_complex(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"v": [1.5, "nan!", "inf!", "-inf!"], "c": {"r": 1.0, "i": 2.0}}\n')
    a = rt.from_json(str(tmp_path / "n.json"), schema="v array<double>, c struct<r:double,i:double>", nan_string="nan!", posinf_string="inf!", neginf_string="-inf!", complex_record_fields=("r", "i"), spark=spark)
    v = a.v.compute()[0]
    assert v[0] == 1.5 and math.isnan(v[1]) and v[2:] == [math.inf, -math.inf]
    assert a.c.compute() == [{"re": 1.0, "im": 2.0}]
    out = rt.to_json(a, str(tmp_path / "out"), nan_string="N", posinf_string="P", neginf_string="M", complex_record_fields=("r", "i"))
    line = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(line) == {"v": [1.5, "N", "P", "M"], "c": {"r": 1.0, "i": 2.0}} and out


def test_json_without_lines(spark, tmp_path):
    rt.to_json(rt.from_lists([[[1, 2], []]], spark=spark), str(tmp_path / "bare"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "bare").glob("part-*")).split()) == ["[1,2]", "[]"]
    rt.to_json(rt.from_lists([[{"a": 1}, {"a": 2}]], spark=spark), str(tmp_path / "whole"), line_delimited=False)
    got = [json.loads(p.read_text()) for p in (tmp_path / "whole").glob("part-*") if p.read_text()]
    assert sorted(x["a"] for part in got for x in part) == [1, 2]


def test_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n\nthree\n")
    assert rt.from_text(str(tmp_path / "t.txt"), spark=spark).compute() == ["one", "", "three"]
    (tmp_path / "u.txt").write_text("a;b;c")
    assert rt.from_text(str(tmp_path / "u.txt"), delimiter=";", spark=spark).compute() == ["a", "b", "c"]
    (tmp_path / "t.txt.xz").write_bytes(lzma.compress(b"x\ny\n"))
    assert rt.from_text(str(tmp_path / "t.txt.xz"), spark=spark).compute() == ["x", "y"]


def test_functions_as_sources(spark):
    def fail_on_two(n):
        if n == 2:
            raise OSError("gone")
        return [n, n * 10]

    a = rt.from_map(fail_on_two, [1, 3], spark=spark)
    assert a.compute() == [1, 10, 3, 30] and a.npartitions == 2
    b, report = rt.from_map(fail_on_two, [1, 2, 3], meta="bigint", report=True, spark=spark)
    assert b.compute() == [1, 10, 3, 30]
    assert [(r["exception"], r["message"]) for r in report.orderBy("item").collect()] == [(None, None), ("OSError", "gone"), (None, None)]
    assert rt.from_delayed([lambda: [1], lambda: [2, 3]], spark=spark).compute() == [1, 2, 3]
    for bad in ((), ([],), ([1], [1, 2])):
        with pytest.raises(ValueError):
            rt.from_map(fail_on_two, *bad, spark=spark)


def test_bridges(spark):
    a = rt.from_numpy(np.arange(6).reshape(3, 2), chunks=(2, 1), spark=spark)
    assert a.divisions == (0, 2, 3)
    assert (rt.to_numpy(a) == np.arange(6).reshape(3, 2)).all()
    with pytest.raises(ValueError):
        rt.to_numpy(rt.from_lists([[[1], [2, 3]]], spark=spark))
    assert list(rt.to_bag(a)) == [[0, 1], [2, 3], [4, 5]]
    assert [d() for d in rt.to_delayed(a)] == [[[0, 1], [2, 3]], [[4, 5]]]
    r = rt.from_rows([{"x": [1, 2], "y": 1}, {"x": [], "y": 2}, {"x": [3], "y": 3}], npartitions=2, spark=spark)
    assert r.divisions == (0, 2, 3)
    assert [tuple(x) for x in rt.to_dataframe(r).orderBy("entry", "subentry").collect()] == [(0, 0, 1, 1), (0, 1, 2, 1), (2, 0, 3, 3)]


def test_json_schemas(spark):
    a = rt.from_rows([{"x": [1], "s": "t", "f": 1.0, "b": True}], spark=spark)
    made = rt.layout_to_jsonschema(a)
    assert made["properties"]["x"] == {"type": "array", "items": {"type": "integer"}}
    assert schema_of_jsonschema(made).simpleString() == a.dtype.simpleString()


def test_blocks_are_those_of_one_read(spark, tmp_path):
    (tmp_path / "t.txt").write_text("some line\n" * 9000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    a = rt.from_text(str(tmp_path / "t.txt"), blocksize=10_000, spark=spark)
    assert a.npartitions >= 8 and len(a.compute()) == 9000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert rt.from_text(str(tmp_path / "t.txt"), spark=spark).npartitions < 8


def test_fields_beyond_the_sample_are_not_lost_in_silence(spark, tmp_path):
    path = tmp_path / "late.json"
    path.write_text('{"a": 1}\n' * 5 + '{"a": 2, "b": 3}\n')
    with pytest.raises(Exception, match="sampled lines lack"):
        rt.from_json(str(path), meta_sample_rows=3, spark=spark).compute()
    array, failed = rt.from_json(str(path), meta_sample_rows=3, report=True, spark=spark)
    assert [r["a"] for r in array.compute()] == [1] * 5 + [2]
    assert [(r["bad_lines"], r["lost_fields"]) for r in failed.collect()] == [(0, 1)]
    assert rt.from_json(str(path), meta_sample_rows=None, spark=spark).compute()[-1] == {"a": 2, "b": 3}


def test_json_arrays_stream(spark, tmp_path):
    import json

    rt.to_json(rt.from_rows([{"a": i} for i in range(50)], npartitions=3, spark=spark), str(tmp_path / "arrays"), line_delimited=False)
    files = sorted((tmp_path / "arrays").glob("part-*"))
    rows = [x for f in files if f.stat().st_size for x in json.loads(f.read_text())]
    assert sorted(x["a"] for x in rows) == list(range(50))
