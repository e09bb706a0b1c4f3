"""Every query over the small projects equals its rows; the store of a stream of events; sources of JSON lines."""

import json

import duckdb
import pandas as pd
import pytest

from fixture_queries import FIXTURE_QUERIES, FIXTURE_SQL
from quillspan.operators import production, reports
from quillspan.streaming import hooks, log


def told(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", FIXTURE_QUERIES)
def test_fixture_query(spark, name):
    got, want = FIXTURE_QUERIES[name](spark, "").toPandas(), duckdb.sql(FIXTURE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and told(got.astype(object)) == told(want.astype(object))


def test_hooks_as_a_stream(spark, tmp_path):
    """Events of a folder, batch by batch, with the decision on each; what came before isn't taken again."""
    projects = spark.createDataFrame([("shop", "/w/shop")], "project string, folder string")
    verdicts = spark.createDataFrame([("shop", "BREAK")], "project string, verdict string")
    decide = lambda asked: hooks.decisions(hooks.with_project(asked, projects), verdicts)
    (tmp_path / "in").mkdir()
    for i, path in enumerate(("/w/shop/a.gs", "/w/b.gs")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"tool_input": {"file_path": path}}) + "\n")
        hooks.run(hooks.events(spark, str(tmp_path / "in")), decide, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("batch", "file", "decision").collect()
    assert sorted(map(tuple, got)) == [(0, "/w/shop/a.gs", "block"), (1, "/w/b.gs", "pass")]


def test_windows_and_counters_of_streams(spark, tmp_path):
    """The windowed log and the counters of needs give over a stream what they give over the table."""
    rows = spark.range(200).selectExpr("if(id % 3 = 0, 'f', 'g') as function", "if(id % 7 = 0, 'FAILED', 'COMPLETED') as status", "timestamp_micros(1704067200000000 + id * 7200000000) as started", "concat('n', id % 5) as need", "timestamp_micros(id) as at")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, plan in (("w", log.windows), ("c", hooks.running_counts)):
        plan(log.stream_of(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"held_{name}").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"held_{name}").collect())) == sorted(map(tuple, plan(spark.read.parquet(str(tmp_path / "in"))).collect()))


def test_sources_of_json_lines(spark, tmp_path):
    lines = ['{"project": "p", "functionName": "f", "processStatus": "FAILED", "startTime": "2024-01-01T00:00:00Z"}', '{"project": "p"}', "{oops"]
    (tmp_path / "log.json").write_text("\n".join(lines))
    assert [tuple(r)[:3] for r in production.processes(spark, str(tmp_path / "log.json")).collect()] == [("p", "f", "FAILED")]
    (tmp_path / "dep.json").write_text('{"project": "p", "deploymentId": "d", "versionNumber": 3, "entryPoints": [{"entryPointType": "WEB_APP"}]}\n{"project": "q", "error": "no access"}')
    assert sorted((r.project, r.version, r.types, r.error) for r in production.deployments(spark, str(tmp_path / "dep.json")).collect()) == [("p", 3, ["WEB_APP"], None), ("q", None, [], "no access")]
    (tmp_path / "req.json").write_text('{"id": "1", "need": "A b", "at": "2024-01-01T00:00:00Z"}\n{"need": "x"}\n{"id": "2", "need": "a  B", "at": "2024-01-02T00:00:00Z"}\n{"id": "3", "need": "c", "at": "2024-01-02T00:00:00Z"}')
    reports.write_requests(reports.request_counts(reports.requests(spark, str(tmp_path / "req.json"))), str(tmp_path / "out"))
    out = spark.read.json(str(tmp_path / "out")).select("need", "occurrences").collect()
    assert sorted(map(tuple, out)) == [("A b", 2), ("c", 1)]
