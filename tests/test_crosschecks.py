"""The store against other projects, logs and deployments."""

import json

import pytest

from quillspan.operators import facts as fs
from quillspan.plans import crosschecks as cc

CALLER = "function run() { Core.add(1); Core.hidden_(); Core.gone(); Other.add(2); helper(); }\nfunction helper() {}\nfunction lone() {}\nfunction onOpen() {}\nfunction doGet() {}\nfunction p_() {}"
LIBRARY = "function add(a) { return a; }\nfunction hidden_() {}"


@pytest.fixture(scope="module")
def park(spark):
    manifest = json.dumps({"dependencies": {"libraries": [{"userSymbol": "Core"}]}})
    rows = [(f"app/{env}", "a.gs", "gs", CALLER) for env in ("dev", "prod", "test")] + [(f"app/{env}", "appsscript.json", "manifest", manifest) for env in ("dev", "prod", "test")]
    rows += [(f"lib/{env}", "l.gs", "gs", LIBRARY) for env in ("dev", "prod")]
    files = spark.createDataFrame(rows, "project string, file string, kind string, content string")
    return fs.written(fs.facts(files)), fs.manifests(files)


def test_library_edges_follow_the_environment(spark, park):
    providers = spark.createDataFrame([("Core", "dev", "lib/dev"), ("Core", "prod", "lib/prod")], "prefix string, env string, provider string")
    got = cc.library_edges(*park, providers).collect()
    assert sorted((r.project, r.provider, r.function) for r in got) == [("app/dev", "lib/dev", "add"), ("app/prod", "lib/prod", "add"), ("app/test", "lib/dev", "add")]


def test_prod_truth(spark, park):
    m = [("helper", 100, 0), ("run", 20, 1), ("lone", 0, 0), ("p_", 3, 0), ("doGet", 0, 0)]
    metrics = spark.createDataFrame([("app/dev", *x) for x in m], "project string, symbol string, runs long, errors long")
    got = {r.symbol: (r.heat, r.status) for r in cc.prod_truth(park[0].where("project = 'app/dev'"), metrics, 30).collect()}
    assert got == {"helper": ("hot", "live"), "run": ("warm", "errored"), "lone": ("cold", "confirmed_dead"), "p_": ("warm", "dispatched_dynamic"), "doGet": ("cold", "cold_exposed"), "onOpen": ("unknown", "unknown")}


def test_deployment_status(spark, park):
    d = spark.createDataFrame([("app/prod", "WEB_APP", 3), ("app/prod", "ADD_ON", None), ("app/prod", "EXECUTION_API", 1), ("app/dev", "ADD_ON", 2)], "project string, type string, version int")
    got = {(r.project, r.symbol): r.status for r in cc.deployment_status(park[0], d).collect()}
    assert (got["app/prod", "doGet"], got["app/prod", "onOpen"], got["app/prod", "lone"], got["app/prod", "p_"]) == ("live_web_app", "live_api", "live_api", "head_only")
    assert (got["app/dev", "onOpen"], got["app/dev", "lone"], got["app/test", "doGet"]) == ("live_addon", "head_only", "unknown")
