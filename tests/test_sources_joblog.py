"""Sources, sinks, job-log operators and the streaming twins."""

import itertools
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE


def _write(text: str, name: str = "t.txt") -> str:
    d = tempfile.mkdtemp(prefix="edgewise-test-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_whitespace_text_types_and_missing(spark):
    from edgewise.sources.text import read_whitespace_table
    p = _write("  src   dst\tw  flag  name\n1 2 0.5 True a\n\n 2\t\t3  NaN False  b \n3 1 1.5 True nan\n")
    df = read_whitespace_table(spark, p)
    assert df.dtypes == [("src", "bigint"), ("dst", "bigint"), ("w", "double"),
                         ("flag", "boolean"), ("name", "string")]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, 2, 0.5, True, "a"), (2, 3, None, False, "b"), (3, 1, 1.5, True, None)]


def test_whitespace_text_schema_and_graph(spark):
    from edgewise.graph import Graph
    from edgewise.sources.text import read_whitespace_table
    p = _write("src dst\n1 2\n2 3\n")
    e = read_whitespace_table(spark, p, schema="src string, dst string")
    assert e.dtypes == [("src", "string"), ("dst", "string")]
    g = Graph.from_edges(e)
    assert g.vertices.count() == 3


def test_csv_sink_roundtrip_maps(spark):
    from edgewise.sources.csv_sink import read_csv, write_csv
    df = spark.createDataFrame([(1, {1: 0, 3: 2}), (2, {})], "id bigint, d map<bigint,int>")
    out = tempfile.mkdtemp(prefix="edgewise-sink-") + "/r"
    write_csv(df, out)
    back = {r.id: r.d for r in read_csv(spark, out, "id bigint, d string").collect()}
    assert back == {1: '{"1":0,"3":2}', 2: "{}"}


def test_stage_log_three_columns_run_from_file_name(spark):
    from edgewise.operators.joblog import stage_durations
    from edgewise.sources.stage_log import read_stage_log
    text = ("Action,Date,Time\n"
            "start creation,2023-02-01,10:00:00.000000\n"
            "finish creation,2023-02-01,10:00:05.500000\n"
            "start execution,2023-02-01,10:00:05.500000\n"
            "\n"
            "finish execution,2023-02-01,10:01:05.500000\n"
            "start deletion,2023-02-01,10:01:05.600000\n"
            "finish deletion,2023-02-01,10:01:07.600000\n")
    p = _write(text, "tenant-user-7-2023-02-01.csv")
    log = read_stage_log(spark, os.path.dirname(p), with_run_column=False)
    assert log.count() == 6 and {r.run for r in log.collect()} == {"tenant-user-7"}
    d = stage_durations(log).collect()[0]
    assert (d.creation_sec, d.execution_sec, d.deletion_sec) == (5.5, 60.0, 2.0)


def test_validate_and_normalize_requests(spark):
    from edgewise.operators.joblog import normalize_requests, validate_requests
    rows = [("r1", "tenant", "user", "a@b.c", "example", 3),
            ("r2", "1-URGENT", "Bob_1", "a@b.c", "x", None),
            ("r3", None, "u" * 40, "a@b.c", None, None)]
    df = spark.createDataFrame(rows, "name string, tenant string, user string, user_email string, "
                                     "graph_location string, nr_workers int")
    v = {r.name: (r.violations, r.is_valid) for r in validate_requests(df).collect()}
    assert v["r1"] == ([], True)
    assert v["r2"] == (["tenant_pattern", "user_pattern"], False)
    assert v["r3"] == (["tenant_missing", "user_length", "location_missing"], False)
    n = {r.name: r for r in normalize_requests(df).collect()}
    assert n["r2"].tenant == "1-urgent" and n["r2"].nr_workers == 2
    assert n["r1"].module == "mount.example" and n["r1"].run_name == "tenant-user-r1"


def test_outcome_classes_and_first_arrivals(spark):
    from edgewise.operators.joblog import first_arrivals, outcome_classes
    o = spark.createDataFrame([(1, 200), (2, 400), (3, None), (4, 500), (5, 200), (6, 302)],
                              "k int, result_code int")
    got = {r.outcome_class: r.n for r in outcome_classes(o).collect()}
    assert got == {"ok": 2, "user_error": 1, "no_outcome": 1, "platform_error": 1, "other": 1}
    a = spark.createDataFrame([("x", 3, 9), ("x", 1, 8), ("x", 1, 7), ("y", 5, 1)],
                              "name string, ts int, event_id int")
    f = {r.name: (r.first_ts, r.event_id) for r in first_arrivals(a, "name", "ts", "event_id").collect()}
    assert f == {"x": (1, 7), "y": (5, 1)}


def test_streaming_twins_equal_batch(spark):
    from edgewise import queries
    for stream, batch in (("first_arrivals_stream", "first_arrivals"),
                          ("request_outcomes_stream", "request_outcomes")):
        s = queries.QUERIES[stream](spark, SMOKE)
        b = queries.QUERIES[batch](spark, SMOKE)
        if batch == "first_arrivals":
            b = b.select("name", "first_ts", "event_id")
        assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.select(*s.columns).collect()))


def test_stage_log_fixture_roundtrip(spark):
    from edgewise import queries
    from edgewise.plans import fixtures as fx
    a = queries.QUERIES["stage_log_source"](spark, SMOKE)
    b = fx.stage_stamps(spark, SMOKE)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select("run", "action", "ts").collect()))


def test_entry_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.columns == ["id", "pagerank"] and df.count() == 20
    assert set(se.oracle_sql()) <= set(se.queries())


def _files(folder, *texts):
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"part{i}.txt").write_text(t)
    return str(folder)


def test_each_file_has_its_own_header(spark, tmp_path):
    """A data line equal to the header stays; columns follow each file's header."""
    from edgewise.sources.text import read_whitespace_table
    path = _files(tmp_path / "t", "src dst tag\n1 2 x\nsrc dst tag\n", "tag dst src\n\ny 4 3\n", "\n src  dst tag\n5 6\n")
    got = {tuple(r) for r in read_whitespace_table(spark, path).collect()}
    assert got == {("1", "2", "x"), ("src", "dst", "tag"), ("3", "4", "y"), ("5", "6", None)}
    typed = read_whitespace_table(spark, _files(tmp_path / "n", "a b\n1d 2\n", "b a\n3 2f\n"))
    assert dict(typed.dtypes) == {"a": "string", "b": "bigint"}


def test_text_that_does_not_fit_its_header_fails(spark, tmp_path):
    import pytest
    from edgewise.sources.text import read_whitespace_table
    with pytest.raises(Exception, match="more fields"):
        read_whitespace_table(spark, _files(tmp_path / "w", "a b\n1 2 3\n"), "a int, b int").collect()
    with pytest.raises(ValueError, match="does not match"):
        read_whitespace_table(spark, _files(tmp_path / "h", "a b\n1 2\n", "a c\n1 2\n"))


def test_csv_quotes_are_doubled(spark, tmp_path):
    import pandas as pd
    from pyspark.sql import functions as F
    from edgewise.sources.csv_sink import write_csv
    write_csv(spark.range(1).select("id", F.create_map(F.lit("1"), F.lit(2)).alias("m")), str(tmp_path / "c"), single_file=True)
    part = next((tmp_path / "c").glob("part-*"))
    assert pd.read_csv(part)["m"].tolist() == ['{"1":2}']


def test_outcomes_are_reduced_and_names_matched_whole(spark):
    from edgewise.operators.joblog import request_outcomes, validate_requests
    req = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    out = spark.createDataFrame([("a", 200), ("a", 400)], "name string, result_code int")
    assert sorted(map(tuple, request_outcomes(req, out, ["name"]).collect())) == [("a", 400), ("b", None)]
    r = spark.createDataFrame([("abc\n", "u", "e", "g")], "tenant string, user string, user_email string, graph_location string")
    assert validate_requests(r).first().violations == ["tenant_pattern"]


def _stamp(day, hour, minute=0):
    import datetime
    return datetime.datetime(2024, 1, day, hour, minute)


def test_two_streams_match_late_rows_and_eviction(spark, tmp_path):
    """Requests and outcomes as two streams: pairs in range, unmatched ones once settled, late rows dropped and counted."""
    from edgewise.operators.joblog import match_outcomes
    from edgewise.streaming.joblog_stream import matched_stream
    rs, os_ = "event_id int, k string, request_ts timestamp", "k string, outcome_ts timestamp, result_code int"
    req, out, log = str(tmp_path / "r"), str(tmp_path / "o"), str(tmp_path / "log")

    def feed(requests, outcomes):
        spark.createDataFrame(requests, rs).coalesce(1).write.mode("append").parquet(req)
        spark.createDataFrame(outcomes, os_).coalesce(1).write.mode("append").parquet(out)
        runs = []
        got = matched_stream(spark, req, rs, out, os_, "k", "2 hours", "1 hour", log_path=log, runs=runs)
        return sorted((r["event_id"], r["result_code"]) for r in got.collect()), runs[0]

    got, run = feed([(1, "a", _stamp(1, 1)), (2, "b", _stamp(1, 1)), (3, "a", _stamp(1, 4)), (9, None, _stamp(1, 1))],
                    [("a", _stamp(1, 2), 400), ("a", _stamp(1, 1, 30), 200), ("a", _stamp(1, 0), 500), (None, _stamp(1, 1), 200)])
    # request 1 has two outcomes in range, the first counts; 2 may still get one; 9 has no key
    assert got == [(1, 200)] and run.late_rows == 0
    # the watermark of both sides moves on: 2 and 9 are settled without an outcome, 3 is still open
    got, run = feed([(4, "c", _stamp(1, 6))], [("z", _stamp(1, 5, 30), 200), ("a", _stamp(1, 4, 45), 400)])
    assert got == [(1, 200), (2, None), (3, 400), (9, None)]
    # an outcome behind the watermark is late: counted, and it changes nothing
    got, run = feed([(5, "d", _stamp(1, 12))], [("b", _stamp(1, 1, 10), 200), ("d", _stamp(1, 13), 200)])
    assert run.late_rows >= 1 and (2, None) in got and (5, 200) in got
    held = run.state_rows
    # state is evicted: far later records leave only themselves behind
    got, run = feed([(6, "e", _stamp(9, 1))], [("e", _stamp(9, 1), 400)])
    assert run.state_rows <= 2 < held + 3
    assert got == [(1, 200), (2, None), (3, 400), (4, None), (5, 200), (6, 400), (9, None)]
    # the batch twin gives the same, but for the late outcome
    r, o = spark.read.schema(rs).parquet(req), spark.read.schema(os_).parquet(out).where("not (k = 'b')")
    assert sorted((x["event_id"], x["result_code"]) for x in match_outcomes(r, o, "k", 7200).collect()) == got


def test_match_outcomes_against_all_pairs(spark):
    """Bucketed matching: ties of time, bucket borders, requests of one key at one time, null keys."""
    import random
    from edgewise.operators.joblog import match_outcomes
    rng = random.Random(2)
    keys = ["a"] * 6 + ["b", "c", None]
    requests = [(i, rng.choice(keys), _stamp(1, rng.randrange(20), rng.choice([0, 0, 7, 59]))) for i in range(80)]
    outcomes = [(rng.choice(keys), _stamp(1, rng.randrange(20), rng.choice([0, 0, 8, 30])), rng.choice([200, 400])) for _ in range(60)]
    want = []
    for i, k, t in requests:
        fit = [(u, c) for q, u, c in outcomes if k is not None and q == k and 0 <= (u - t).total_seconds() <= 3600]
        want.append((i, *(min(fit) if fit else (None, None))))
    got = match_outcomes(spark.createDataFrame(requests, "event_id int, k string, request_ts timestamp"),
                         spark.createDataFrame(outcomes, "k string, outcome_ts timestamp, result_code int"), "k", 3600)
    assert sorted((r["event_id"], r["outcome_ts"], r["result_code"]) for r in got.collect()) == sorted(want)


def test_dedup_within_watermark_expires(spark, tmp_path):
    """A repeated record is dropped while its key is held, a late one is dropped and counted, a key comes back after expiry."""
    from edgewise.streaming.joblog_stream import distinct_arrivals_stream, first_arrivals_stream
    schema, src, log = "name string, ts timestamp, event_id int", str(tmp_path / "s"), str(tmp_path / "log")

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        runs = []
        got = distinct_arrivals_stream(spark, src, schema, ["name"], "2 hours", log_path=log, runs=runs)
        return sorted(r["name"] for r in got.collect()), runs[0]

    got, run = feed([("a", _stamp(1, 1), 1), ("a", _stamp(1, 1, 30), 2), ("b", _stamp(1, 2), 3)])
    assert got == ["a", "b"] and run.late_rows == 0 and run.state_rows == 2
    got, run = feed([("a", _stamp(1, 2, 30), 4), ("c", _stamp(1, 6), 5)])   # a is still held
    assert got == ["a", "b", "c"] and run.state_rows == 1                    # a and b have expired
    got, run = feed([("late", _stamp(1, 1), 6), ("a", _stamp(1, 7), 7)])     # a is new again
    assert got == ["a", "a", "b", "c"] and run.late_rows == 1
    # the aggregating twin: a late row is counted, the first arrival stays the smallest
    runs, log2 = [], str(tmp_path / "first")
    first = first_arrivals_stream(spark, src, schema, key="name", log_path=log2, watermark="2 hours", files_per_batch=1, runs=runs)
    assert {r["name"]: r["event_id"] for r in first.collect() if r["name"] != "late"} == {"a": 1, "b": 3, "c": 5}


def test_percentile_ranks(spark):
    """Ranks keep the bound in groups far larger than the summary; nulls and ties included."""
    from pyspark.sql import functions as F
    from edgewise.operators.joblog import percentile_ranks, stage_percentiles
    d = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("day"),
                                   F.when(F.col("id") % 7 > 0, F.pmod(F.hash("id"), F.lit(4000)) / 100).alias("creation_sec"),
                                   F.when(F.col("id") % 2 == 0, F.lit(5.0)).alias("execution_sec"),
                                   F.lit(None).cast("double").alias("deletion_sec"))
    got = percentile_ranks(d, stage_percentiles(d, "day", (0.0, 0.5, 0.95, 1.0), 200), "day").collect()
    assert len(got) == 4 * (2 * 3 + 2 + 1)
    for r in got:
        slack = r["n"] / 200 + 1
        assert r["below"] <= r["percentage"] * r["n"] + slack and r["upto"] >= r["percentage"] * r["n"] - slack
    exact = sorted(x[0] for x in d.select("creation_sec").where("creation_sec is not null and day = '1'").collect())
    mid = next(r for r in got if r["stage"] == "creation" and r["day"] == "1" and r["percentage"] == 0.5)
    assert mid["n"] == len(exact) and mid["below"] == sum(x < mid["sec"] for x in exact)


def test_every_rule_is_met_and_some_requests_are_valid(spark):
    from pyspark.sql import functions as F
    from edgewise.operators.joblog import request_outcomes, validate_requests
    from edgewise.plans import fixtures as fx
    v = validate_requests(fx.requests(spark, SMOKE))
    codes = {r[0] for r in v.select(F.explode("violations")).distinct().collect()}
    assert codes == {"tenant_missing", "tenant_pattern", "tenant_length", "user_missing", "user_pattern", "user_length",
                     "email_length", "location_missing", "location_length"}
    assert v.where("is_valid").count() > 0.4 * v.count()
    # of several requests of one key the earliest stays
    req = spark.createDataFrame([("a", 5, "late"), ("a", 2, "early"), ("b", 1, "x")], "name string, request_ts int, user string")
    out = spark.createDataFrame([("a", 200)], "name string, result_code int")
    got = request_outcomes(req, out, ["name"]).select("name", "request_ts", "user", "result_code").collect()
    assert sorted(map(tuple, got)) == [("a", 2, "early", 200), ("b", 1, "x", None)]


def test_one_odd_header_among_very_many_fails(spark, tmp_path):
    """Headers of every file are compared, more of them than a driver would list, in any order of the names."""
    from edgewise.sources.text import header_names
    names = [f"c{i}" for i in range(7)]
    for k, order in enumerate(itertools.islice(itertools.permutations(names), 1200)):
        (tmp_path / f"{k:05d}.txt").write_text(" ".join(order) + "\n" + " ".join("1" * 7) + "\n")
    assert header_names(spark, str(tmp_path)) == names
    (tmp_path / "99999.txt").write_text("c0 c1 c2 c3 c4 c5 c7\n1 2 3 4 5 6 7\n")
    with pytest.raises(ValueError, match="99999"):
        header_names(spark, str(tmp_path))
    (tmp_path / "99999.txt").write_text("c0 c1 c2 c3 c4 c5 c5\n1 2 3 4 5 6 7\n")
    with pytest.raises(ValueError, match="does not match"):
        header_names(spark, str(tmp_path))
