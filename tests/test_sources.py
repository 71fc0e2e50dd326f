import json

import pytest

from polyquarry.sources import connectors, files
from polyquarry.streaming import journal


def test_lines_and_documents(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"id": "1"}\n\n{"id": "2"}\nbroken\n', encoding="utf-8")
    rows = sorted(files.read_lines(spark, str(p), "id string").collect(), key=lambda r: r.line)
    assert [(r.line, r.id, r.bad) for r in rows] == [(1, "1", None), (3, "2", None), (4, None, "broken")]
    with pytest.raises(Exception, match="bad line 4"):
        files.strict_lines(spark, str(p), "id string").collect()
    d = tmp_path / "d.json"
    d.write_text(json.dumps({"a": [{"b": 1}]}, indent=1))
    assert files.read_documents(spark, str(d), "a array<struct<b int>>").first().doc.a[0].b == 1
    d.write_text("[1]")
    with pytest.raises(Exception):
        files.read_documents(spark, str(d), "a array<struct<b int>>").collect()


def test_tables_hashes_settings(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "id string, extra int")
    files.write_review_table(df, str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t"))
    assert back.columns == files.REVIEW_COLUMNS and back.first().id == "x"
    f = tmp_path / "h"
    f.write_text("abc")
    assert files.file_hashes(spark, str(f)).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    f.write_text("# c\nexport A='x=1'\nB = \"y\"\nnothing\n")
    assert files.read_settings(str(f)) == {"A": "x=1", "B": "y"}
    assert files.parse_choices("a, b", ["a", "b"]) == ["a", "b"]
    for bad in ("", "a,a", "z"):
        with pytest.raises(ValueError):
            files.parse_choices(bad, ["a"])
    assert len(files.digest(["a", "b"])) == 12
    i = tmp_path / "i.csv"
    i.write_text("checkpoint_id,source_language,summary_path,method\n1,de,p,npo\n2,fr,q,npo\n")
    assert files.read_index(spark, str(i), "npo").count() == 2
    with pytest.raises(ValueError):
        files.read_index(spark, str(i), "other")
    assert files.expand_template(spark, "{source_language}/{method}", ["de"], "npo").first().path == "de/npo"


def test_connector_retries_and_gives_up():
    calls = []

    def flaky(request):
        calls.append(request)
        if len(calls) < 3:
            raise connectors.ServiceError(503)
        return {"ok": True}

    assert connectors.call(flaky, {}, sleep=lambda s: None) == ({"ok": True}, 3, None)

    def gone(request):
        raise connectors.ServiceError(404)

    assert connectors.call(gone, {}, sleep=lambda s: None)[1] == 1
    assert connectors.delay(1) == 2 and connectors.delay(9) == 60 and connectors.delay(1, retry_after=7) == 7
    assert connectors.score_of('{"score": 0.25}') == 0.25
    for bad in ('{"score": 0.3}', '{"score": true}', '{"score": 1, "x": 2}', "no", "[1]"):
        assert connectors.score_of(bad) is None


def test_enrich(spark):
    df = spark.createDataFrame([(1, '{"title": "A"}'), (2, '{"title": "B"}')], "id long, request string")
    got = {r.id: (r.answer, r.error) for r in connectors.enrich(df, "id", "request", connectors.offline_pages({"A": "text"}), 2).collect()}
    assert got == {1: ('{"extract": "text", "title": "A"}', None), 2: (None, "status 404")}


def test_journal_resumes_and_recovers(spark, tmp_path):
    seen = []
    inputs = spark.createDataFrame([("a",), ("b",)], "id string")

    def score(df):
        seen.append(df.count())
        return df.selectExpr("id", "1.0D score", "cast(null as string) error")

    path = str(tmp_path / "j")
    journal.resume(inputs.limit(1), path, "id", {"v": 1}, score)
    out = journal.resume(inputs, path, "id", {"v": 1}, score)
    assert seen == [1, 1] and sorted(r.id for r in out.collect()) == ["a", "b"]
    assert journal.progress(out, 2).first().state == "complete"
    with pytest.raises(Exception, match="protocol"):
        journal.resume(inputs, path, "id", {"v": 2}, score)
    f = tmp_path / "j.jsonl"
    f.write_text('{"id": "1"}\n{"id": "2"}\n{"id": ')
    assert sorted(r.id for r in journal.recover(spark, str(f), "id string").collect()) == ["1", "2"]
    f.write_text('{"id": "1"}\n{"id": \n{"id": "3"}\n')
    with pytest.raises(Exception, match="malformed line 2"):
        journal.recover(spark, str(f), "id string").collect()


def test_stream_processes_new_files_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.createDataFrame([(1, "x")], "id int, k string")
    df.write.parquet(src)
    step = lambda: journal.run_once(journal.stream_table(spark, src, df.schema), out, state)
    step()
    step()
    assert spark.read.parquet(out).count() == 1
    df.write.mode("append").parquet(src)
    step()
    assert spark.read.parquet(out).count() == 2


def test_hashes_of_files_that_no_row_may_hold(spark, tmp_path):
    import hashlib

    kept = {}
    for name, text in (("a b.json", b"x" * 3_000_001), ("c%20d.json", b"\xef\xbb\xbfy\r\n" * 1000)):
        (tmp_path / name).write_bytes(text)
        kept[name] = (len(text), hashlib.sha256(text).hexdigest())
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # a file's content in one row is an error
    try:
        rows = files.file_hashes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)
    assert {r.path.rpartition("/")[2]: (r.length, r.sha256) for r in rows} == kept
    assert all(files.hadoop_sha256(spark, r.path) == r.sha256 for r in rows)
