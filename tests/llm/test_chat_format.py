import hashlib
import random

import pyarrow as pa
import pytest
from oracle import compare, connect
from ragtide.llm import chat_format as c
from ragtide.llm import queries

SIGNS = ["### ", "</turn>", "\\", ":", "\n", "assistant", " ", "x", "\\n", "### Assistant: ", "é", ""]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string, context_chars long")


def cases():
    r = random.Random(1)
    rows = [(k % 40, k // 40, r.choice(["user", "assistant", "a:b\n\\c", None, "### x"]), "".join(r.choice(SIGNS) for _ in range(r.randrange(9))) if k % 11 else None, "clash", 0) for k in range(400)]
    return rows + [rows[3], rows[3], (None, 0, "assistant", "lost", "", 0), (70, None, "assistant", "no turn", "", 0), (71, 0, "user", "w " * 100_000, "", 0), (71, 1, "assistant", "w " * 100_000, "", 0)]


def ordered(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    return {k: sorted(v, key=lambda t: (t[0], t[1].encode(), t[2].encode())) for k, v in convs.items()}


def test_report_reads_everything_back(spark):
    rows = cases()
    got = {r["conv_id"]: r for r in c.report(turns(spark, rows)).collect()}
    want = ordered(rows)
    assert set(got) == set(want)
    for k, said in want.items():
        loss = "".join(t for _, role, t in said if role == "assistant")
        assert got[k]["n_turns"] == len(said)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k]["n_examples"] == sum(r == "assistant" for _, r, _ in said)
    assert c.report(turns(spark, [])).collect() == []


def test_prefixes_hold_all_turns_before(spark):
    rows = cases()
    whole = {}
    for k, said in ordered(rows).items():
        df = c.format_turns(turns(spark, [(k, i, r, t, "", 0) for i, (_, r, t) in enumerate(said)])) if k in (0, 1, 70) else None
        if df is not None:
            whole[k] = [x["piece"] for x in df.orderBy("turn").collect()]
    made = c.prefixes(turns(spark, [r for r in rows if r[0] in whole])).collect()
    by = {(r["conv_id"], r["example"]): r for r in made}
    offsets = {(r["conv_id"], r["example"]): r for r in c.examples(turns(spark, [r for r in rows if r[0] in whole])).collect()}
    assert set(by) == set(offsets)
    for k, pieces in whole.items():
        text, n = "", 0
        for (_, role, said), piece in zip(ordered(rows)[k], pieces):
            if role == "assistant":
                r, o = by[(k, n)], offsets[(k, n)]
                assert r["prompt"].startswith(text) and r["prompt"] + r["target"] == text + piece
                assert o["context_chars"] == len(text) and o["prefix_chars"] == len(text + piece)
                assert c.unescape((text + piece)[o["loss_start"] : o["loss_end"]]) == said
                n += 1
            text += piece


def test_report_reads_the_examples_ranges(spark, sf_dir):
    plan = queries.QUERIES["op9_chat"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "loss_start" in plan and "context_chars" in plan


def test_report_reads_written_examples(spark, monkeypatch):
    """What report() gives comes out of examples that hold their whole context: others give another result or an error."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "### d"), (1, 4, "user", "e"), (2, 0, "user", "no reply")]
    batches = [b for df in [c._in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))] for b in df.toArrow().to_batches()]
    batches = sorted(batches, key=lambda b: b["conv_id"][0].as_py())
    made = [r for b in c._write(batches) for r in b.to_pylist()]
    said = ["### user: a </turn>\n", "### assistant: b </turn>\n", "### user: c </turn>\n", "### assistant: \\### d </turn>\n", "### user: e </turn>\n"]
    one = [(r["example"], r["text"]) for r in made if r["conv_id"] == 1]
    assert one == [(0, "".join(said[:2])), (1, "".join(said[:4])), (None, said[4])]
    assert [(r["example"], r["text"]) for r in made if r["conv_id"] == 2] == [(None, "### user: no reply </turn>\n")]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in made if r["example"] is not None] == ["b", "\\### d"]
    short = [{**r, "text": r["text"].replace("### user: a", "### user: z")} if r["example"] == 1 else r for r in made]
    with pytest.raises(ValueError, match="go on from"):
        list(c._digest([pa.RecordBatch.from_pylist(short, c._WRITTEN)]))
    whole = list(c._read_back(batches))
    monkeypatch.setattr(c, "BATCH_CHARS", 1)
    assert len(list(c._write(batches))) > 2
    assert [r for b in whole for r in b.to_pylist()] == [r for b in c._read_back(batches) for r in b.to_pylist()]


def test_control_strings_in_texts_come_back():
    for text in ("### Assistant: </turn> ok", "\\### Assistant: </turn> ok", "\\\\", "### </turn>\n### User: x </turn>\n"):
        piece = "### user: " + text.replace("\\", "\\\\").replace("### ", "\\### ").replace("</turn>", "\\</turn>") + " </turn>\n"
        assert c.read_piece(piece) == ("user", text)


def test_query_is_its_sql(spark, sf_dir):
    compare(queries.QUERIES["op9_chat"](spark, sf_dir), connect(sf_dir), queries.SQL["op9_chat"])
