import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyquarry.operators import compaction as c

SCHEMA = "file_id long, body string, n_bytes long, written_at timestamp, payload string"


def rec(q, n=1, t="de", **more):
    return {"source_qa_id": q, "target_language": t, "attempt": n, **more}


def test_layouts_and_broken_bodies():
    a, b = rec("a", translation={"question": "x {[\n"}), rec("b")
    line = json.dumps
    assert len(c.records_of(line(a) + "\n" + line(b))) == 2
    assert len(c.records_of("﻿" + line(a))) == 1
    assert len(c.records_of(json.dumps([a, b], indent=2))) == 2
    assert len(c.records_of(json.dumps({"records": [a, b]}))) == 2
    whole = json.dumps([a, b], indent=2)
    assert [r["source_qa_id"] for r in c.records_of(whole[: whole.rindex('"b"')])] == ["a"]
    assert [r["source_qa_id"] for r in c.records_of(line(a)[:40] + "\n" + line(b))] == ["b"]
    assert c.records_of(line(a)[:-1]) == []
    for empty in (None, "", "  \n", "[]", "{}", "null", "3", '{"source_qa_id": "", "target_language": "de", "attempt": 1}', '{"source_qa_id": "x", "target_language": null, "attempt": 1}', '{"source_qa_id": "x", "target_language": "de", "attempt": true}'):
        assert c.records_of(empty) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=6), st.integers(0, 200))
def test_cut_anywhere_keeps_what_is_whole(texts, cut):
    lines = [json.dumps(rec(f"q{i}", translation={"question": t}), ensure_ascii=False) for i, t in enumerate(texts)]
    body = "\n".join(lines)
    whole, at = 0, 0
    for x in lines:
        at += len(x) + (1 if at else 0)
        whole += at <= cut
    assert [r["source_qa_id"] for r in c.records_of(body[:cut])] == [f"q{i}" for i in range(whole)]


def test_each_record_once_in_disjoint_sorted_files(spark):
    rng = random.Random(1)
    records = [rec(f"q{rng.randrange(300):04d}", rng.randrange(1, 3), rng.choice(["de", "fr"]), translation={"question": "x" * rng.randrange(80)}) for _ in range(900)]
    hot = rec("q0001", 1, "de")
    rows = [(i, "\n".join(json.dumps(r) for r in rng.sample(records, 3)) + "\n" + json.dumps(hot), 300, None, "clash") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:5] + [(999, None, None, None, None)], SCHEMA)
    out = c.consolidate(df, target_bytes=12_000)
    got = out.collect()
    want = {(r["source_qa_id"], r["target_language"], r["attempt"]) for b in rows for r in c.records_of(b[1])}
    keys = [(r.source_qa_id, r.target_language, r.attempt) for r in got]
    assert len(keys) == len(set(keys)) and set(keys) == want
    meta = sorted(c.range_metadata(out).collect(), key=lambda r: tuple(r.min_key))
    assert len(meta) > 2 and sum(r.n_records for r in meta) == len(want)
    assert all(tuple(a.max_key) < tuple(b.min_key) for a, b in zip(meta, meta[1:]))
    assert all(r.n_bytes <= 18_000 for r in meta)


def test_copies_kept_on_request_and_most_complete_wins(spark):
    full = rec("a", consistency={"verdict": "passed"})
    df = spark.createDataFrame([(1, json.dumps(rec("a")), 9, None, ""), (2, json.dumps(full), 9, None, "")], SCHEMA)
    (r,) = c.consolidate(df).collect()
    assert json.loads(r.payload) == full
    assert sorted(r.payload for r in c.consolidate(df.repartition(2), keep_copies=True).collect()) == sorted(json.dumps(r, sort_keys=True, separators=(",", ":")) for r in (rec("a"), full))


def test_every_copy_is_kept(spark):
    """Six copies in two bodies stay six, also when further files are merged in; without copies one stays."""
    body = lambda n: "\n".join([json.dumps(rec("a"))] * n)
    df = spark.createDataFrame([(1, body(4), 9, None, ""), (2, body(2), 9, None, "")], SCHEMA)
    kept = c.consolidate(df, keep_copies=True)
    assert kept.count() == 6 and c.consolidate(df).count() == 1
    more = spark.createDataFrame([(3, body(2) + "\n" + json.dumps(rec("b")), 9, None, "")], SCHEMA)
    assert sorted(r.source_qa_id for r in c.add_files(kept, more, keep_copies=True).collect()) == ["a"] * 8 + ["b"]
    assert sorted(r.source_qa_id for r in c.add_files(kept, more).collect()) == ["a", "b"]


def test_written_files_hold_every_record_in_order(spark, tmp_path):
    rows = [(i, "\n".join(json.dumps(rec(f"q{(i * 7 + k) % 90:03d}", note="x" * 60)) for k in range(5)), 500, None, "") for i in range(60)]
    m = c.write_consolidated(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "o"), target_bytes=4_000, keep_copies=True)
    meta = sorted(m.collect(), key=lambda r: tuple(r.min_key))
    assert len(meta) > 3 and sum(r.n_records for r in meta) == 300
    assert all(tuple(a.max_key) < tuple(b.min_key) for a, b in zip(meta, meta[1:]))
    data = spark.read.parquet(str(tmp_path / "o" / "data"))
    assert data.select("out_file", *c.KEY, "n_bytes").count() == 300


def test_empty_and_written(spark, tmp_path):
    assert c.consolidate(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, json.dumps(rec("a")), None, None, ""), (2, json.dumps(rec("b")), None, None, "")], SCHEMA)
    m = c.write_consolidated(df.drop("n_bytes"), str(tmp_path / "o"))
    assert [r.n_records for r in m.collect()] == [2]


def test_round_trip_over_the_tiny_table(spark, tiny):
    import __spark_entry__ as e

    bodies = [r.body for r in spark.read.parquet(f"{tiny}/cache_file.parquet").collect()]
    want = {(r["source_qa_id"], r["target_language"], r["attempt"]) for b in bodies for r in c.records_of(b)}
    got = [tuple(r) for r in e.queries()["p3_found"](spark, tiny).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("body", ["[" * 2000, "{" * 2000, '{"a":' * 1500])
def test_deep_nesting_ends(body):
    assert c.records_of(body) == []


def test_further_files_are_merged_in(spark):
    body = lambda *qs: "\n".join(json.dumps(rec(q, translation={"question": "x" * 50})) for q in qs)
    first = c.consolidate(spark.createDataFrame([(1, body("a", "c"), 9, None, "")], SCHEMA))
    more = spark.createDataFrame([(2, body("b", "c"), 9, None, ""), (3, json.dumps(rec("a", translation={}, consistency={})), 9, None, "")], SCHEMA)
    out = {r.source_qa_id: json.loads(r.payload) for r in c.add_files(first, more, target_bytes=150).collect()}
    assert sorted(out) == ["a", "b", "c"] and "consistency" in out["a"]
