"""Queries over the driver's tables, each with its SQL.

The tables hold no scripts, so each query runs an operator of the fact store
on tables of the same shape: what plays which part is in the docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import findings as fd
from quillspan.functions.text import body_fingerprint, rounded
from quillspan.operators import facts as fs
from quillspan.operators import incremental
from quillspan.operators import relations as op
from quillspan.operators import secrets
from quillspan.operators import workspace as ws
from quillspan.operators.similarity import similar_names
from quillspan.plans import crosschecks, rules
from quillspan.sources.tables import process_log, table
from quillspan.streaming.log import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(r"""SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, regexp_extract(unnest(a), 'href="([^"]*)"', 1) AS href
FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<a [^>]*>'), lambda x: NOT contains(x, 'target=')) AS a FROM pages)""")
def webapp_link_target(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages that name no target; pos counts such links from 0."""
    links = F.filter(F.regexp_extract_all("html", F.lit("<a [^>]*>"), F.lit(0)), lambda x: ~x.contains("target="))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "tag")).select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("tag", 'href="([^"]*)"', 1).alias("href"))


@query("""SELECT page_id, url FROM pages WHERE url LIKE 'http://%'""")
def webapp_mixed_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").startswith("http://")).select("page_id", "url")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unresolved' WHEN p_size > 25 THEN 'large' ELSE 'small' END AS resolved
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def resolve_calls_left(spark: SparkSession, d: str) -> DataFrame:
    """Lines as calls, parts as definitions: a left join, then precedence by CASE."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    kind = F.when(F.col("p_partkey").isNull(), "unresolved").when(F.col("p_size") > 25, "large").otherwise("small")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", kind.alias("resolved"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def unresolved_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers as calls, urgent orders as definitions: those without one."""
    urgent = table(spark, d, "orders").where("o_orderpriority LIKE '1%'")
    return op.anti(table(spark, d, "customer"), urgent, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("""SELECT l_partkey, count(DISTINCT l_orderkey) AS callers FROM lineitem GROUP BY l_partkey""")
def called_by_inversion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("callers"))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus = 'F')""")
def exposed_semi(spark: SparkSession, d: str) -> DataFrame:
    shipped = table(spark, d, "lineitem").where("l_linestatus = 'F'")
    return table(spark, d, "supplier").join(shipped, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("""WITH a AS (SELECT s_nationkey AS k, min(s_suppkey) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
b AS (SELECT n_regionkey AS k, min(s_suppkey) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v, (SELECT min(s_suppkey) FROM supplier)) AS provider FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON a.k = c_nationkey LEFT JOIN b ON b.k = n_regionkey""")
def cross_project_env_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A provider of the same nation, else of the same region, else the first of all."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rich = table(spark, d, "supplier").where("s_acctbal > 5000")
    near = rich.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("v"))
    far = rich.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("v"))
    every = table(spark, d, "supplier").agg(F.min("s_suppkey").alias("v")).withColumn("k", F.lit(0))
    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("_every", F.lit(0))
    return op.fallback_join(customers, [(near, "s_nationkey", "c_nationkey", "v"), (far, "n_regionkey", "n_regionkey", "v"), (every, "k", "_every", "v")], "provider").select("c_custkey", "provider")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
b AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS s FROM orders)
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """All orders and a later version of them all: pending ones got new keys, urgent ones a new status."""
    o = table(spark, d, "orders")
    before = o.select("o_orderkey", F.col("o_orderstatus").alias("s"))
    after = o.select(F.expr("CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_orderkey END").alias("o_orderkey"), F.when(F.col("o_orderpriority").like("1%"), "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return op.snapshot_diff(before, after, "o_orderkey", "s")


@query(r"""WITH d AS (SELECT doc_id, substr(sha256(trim(regexp_replace(text, '[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))), 1, 16) AS fingerprint FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS i FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY -doc_id) AS i FROM d)
SELECT a.fingerprint, a.doc_id AS old, -b.doc_id AS new FROM a JOIN b ON a.fingerprint = b.fingerprint AND a.i = b.i""")
def rename_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as function bodies, all removed and all added again under negated ids: equal bodies are paired one to one in order."""
    docs = op.stored(table(spark, d, "documents").select("doc_id", body_fingerprint(F.col("text")).alias("fingerprint")))
    return op.pair_one_to_one(docs, docs.withColumn("doc_id", -F.col("doc_id")), "fingerprint", "doc_id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber > CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 4 END""")
def param_position_theta(spark: SparkSession, d: str) -> DataFrame:
    """Calls with more arguments than a removed parameter's position: an equi-join with a range residual."""
    at = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").like("1%"), 2).otherwise(4).alias("at"))
    return table(spark, d, "lineitem").join(at, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") > F.col("at"))).select("l_orderkey", "l_linenumber")


@query("""SELECT user_id, k, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'purchase') AS writes, count(*) FILTER (event_type = 'error') AS deletes,
CASE WHEN bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'view') THEN 'write_only' WHEN bool_or(event_type = 'view') AND NOT bool_or(event_type = 'purchase') THEN 'read_only' ELSE 'ok' END AS status
FROM (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type IN ('view', 'purchase', 'error') AND k IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id, k""")
def key_status_index(spark: SparkSession, d: str) -> DataFrame:
    """Property keys: views read, purchases write, errors delete."""
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return op.key_status(e, ["user_id", "k"], "event_type", "view", "purchase", "error")


@query("""WITH c AS (SELECT c_custkey, greatest(50, 100 - least(40, 5 * count(o_orderkey))) AS pct FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CAST(pct AS BIGINT) AS pct, CASE WHEN pct >= 95 THEN 'high' WHEN pct >= 80 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def coverage_score(spark: SparkSession, d: str) -> DataFrame:
    """Customers as functions, orders as uncertain places."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    pct = op.coverage(F.coalesce("n", F.lit(0)))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", pct.alias("pct")).withColumn("confidence", op.confidence(F.col("pct")))


@query("""WITH c AS (SELECT c_custkey, greatest(50, 100 - least(40, 5 * count(o_orderkey))) AS pct FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT count(*) AS functions, CAST(floor(avg(pct) + 0.5) AS BIGINT) AS pct, count(*) FILTER (pct < 80) AS risky FROM c""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return coverage_score(spark, d).agg(F.count("*").alias("functions"), rounded(F.avg("pct")).alias("pct"), F.count_if(F.col("pct") < 80).alias("risky"))


@query("""SELECT DISTINCT p_brand AS name, 'undeclared' AS status FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#99') UNION ALL
SELECT name, 'unused' FROM (VALUES ('Brand#11'), ('Brand#12'), ('Brand#99')) t(name) WHERE name NOT IN (SELECT p_brand FROM part)""")
def undeclared_unused(spark: SparkSession, d: str) -> DataFrame:
    """Brands used and not declared, declared and not used."""
    declared = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#99",)], "name string")
    used = table(spark, d, "part").select(F.col("p_brand").alias("used")).distinct()
    on = F.col("name") == F.col("used")
    return used.join(declared, on, "left_anti").select(F.col("used").alias("name"), F.lit("undeclared").alias("status")).unionByName(declared.join(used, on, "left_anti").withColumn("status", F.lit("unused")))


@query("""SELECT c_custkey, bool_or(coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)) AS satisfied FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def scope_any_of(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of the accepted priorities occurs."""
    any_of = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("s"))
    return table(spark, d, "customer").join(any_of, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("s", F.lit(False)).alias("satisfied"))


@query("""SELECT page_id, url FROM pages WHERE NOT (starts_with(url, 'https://') OR starts_with(url, 'http://site1'))""")
def prefix_whitelist_anti(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that start with no listed prefix; the list is a manifest's, so it is an expression, not a join."""
    allowed = ["https://", "http://site1"]
    listed = F.lit(False)
    for prefix in allowed:
        listed = listed | F.col("url").startswith(prefix)
    return table(spark, d, "pages").where(~listed).select("page_id", "url")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS s FROM orders)
SELECT o_orderkey, CASE s WHEN 'O' THEN 'Done' WHEN 'P' THEN 'Open' ELSE 'Start' END AS type, CASE s WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END::BIGINT AS done, s <> 'O' AS stopped FROM o""")
def chain_fold(spark: SparkSession, d: str) -> DataFrame:
    """A call chain of two steps for each order, typed step by step through a registry."""
    registry = F.create_map(*[F.lit(x) for x in ("Start.open", "Open", "Open.close", "Done")])
    second = F.when(F.col("o_orderstatus") == "O", "close").otherwise("drop")
    first = F.when(F.col("o_orderstatus").isin("O", "P"), "open").otherwise("none")
    return op.chain_fold(table(spark, d, "orders").select("o_orderkey", F.lit("Start").alias("root"), F.array(first, second).alias("steps")), "steps", registry)


@query("""SELECT event_type AS function, count(*) AS runs, count(*) FILTER (event_type = 'error') AS errors, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, CAST(floor(count(*) FILTER (event_type = 'error') * 1000 / count(*)) AS BIGINT) AS rate_1000 FROM events GROUP BY 1""")
def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events as a process log."""
    return op.log_metrics(process_log(table(spark, d, "events"))).select("function", "runs", "errors", F.unix_micros("last_run").alias("last_us"), "rate_1000")


@query("""WITH m AS (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN m USING (o_custkey) WHERE o_orderdate < latest AND o_orderstatus = 'O'""")
def latest_version_drift(spark: SparkSession, d: str) -> DataFrame:
    """Open orders older than their customer's latest."""
    o = table(spark, d, "orders")
    latest = o.groupBy(F.col("o_custkey").alias("_c")).agg(F.max("o_orderdate").alias("latest"))
    return o.where("o_orderstatus = 'O'").join(latest, (F.col("o_custkey") == F.col("_c")) & (F.col("o_orderdate") < F.col("latest"))).select("o_orderkey")


@query("""WITH a AS (SELECT doc_id, sha1(text) AS h FROM documents), b AS (SELECT CASE WHEN lang = 'fr' THEN -1 - doc_id ELSE doc_id END AS doc_id, sha1(CASE WHEN source LIKE '%a%' THEN text || 'x' ELSE text END) AS h FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_local' WHEN a.doc_id IS NULL THEN 'only_remote' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h IS DISTINCT FROM b.h""")
def hash_content_diff(spark: SparkSession, d: str) -> DataFrame:
    """All documents and their deployed versions, compared by digest: French ones got new ids, those of some sources new text."""
    docs = table(spark, d, "documents")
    remote = docs.select(F.when(F.col("lang") == "fr", -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("source").like("%a%"), F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    digest = lambda df: df.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"))
    return op.content_diff(digest(docs), digest(remote), "doc_id", "h")


@query("""SELECT r_name, n_name, count(*) AS customers, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def parc_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Regions as apps, nations as environments."""
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return table(spark, d, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("customers"), (F.grouping("r_name") + F.grouping("n_name")).cast("long").alias("level"))


@query(r"""SELECT trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')) AS need, count(*) AS occurrences, min(conv_id) AS first_seen, max(conv_id) AS last_seen FROM conversations GROUP BY 1""")
def request_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Turns as requests: the same normalised text counts up."""
    return op.upsert_counts(table(spark, d, "conversations"), "text", ["conv_id", "turn"])


_SIMILAR = """WITH n AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT a.name, b.name AS other, levenshtein(lower(a.name), lower(b.name)) AS distance FROM n a JOIN n b ON a.name <> b.name WHERE levenshtein(lower(a.name), lower(b.name)) <= greatest(2, length(a.name) // 3) OR contains(lower(b.name), lower(a.name))),
t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, other) AS place FROM s)
SELECT p_partkey, other, CAST(distance AS INT) AS distance, CAST(place AS INT) AS place FROM part JOIN t ON p_name = name WHERE place <= 3"""


@query(_SIMILAR)
def topk_similar(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of all part names for each part's name, as misspelt functions get theirs."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return similar_names(part, part, "p_name", 3)


@query(_SIMILAR)
def similar_part_names(spark: SparkSession, d: str) -> DataFrame:
    """As topk_similar, under its earlier name."""
    return topk_similar(spark, d)


@query("""SELECT o_custkey, count(*) AS sites, min(o_orderkey) AS first_site FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def first_site(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("sites"), F.min("o_orderkey").alias("first_site")).where("sites >= 3")


@query(r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
p AS (SELECT * FROM (VALUES ('token_literal', 'token = "[0-9a-f]+"'), ('GOOGLE_API_KEY', 'AIza[0-9A-Za-z_-]{35}'), ('OAUTH_ACCESS_TOKEN', 'ya29\.[0-9A-Za-z_-]+'), ('SERVICE_ACCOUNT_PRIVATE_KEY', '"private_key":\s*"-----BEGIN')) t(pattern, rx))
SELECT doc_id, CAST(line AS BIGINT) AS line, pattern FROM x JOIN p ON regexp_matches(l, rx)""")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that hold a token or one of the known secrets; the pattern's name and the line are told, never the value."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    found = secrets.secret_lines(files, patterns={"token_literal": 'token = "[0-9a-f]+"'})
    return found.select(F.col("file").cast("long").alias("doc_id"), "line", "pattern")


@query("""WITH f AS (SELECT 'webapp.mixed_content' AS rule, 'warn' AS severity FROM pages WHERE starts_with(url, 'http://') UNION ALL
SELECT 'calls.unresolved', 'break' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') UNION ALL SELECT 'coverage.large', 'info' FROM part WHERE p_size > 45)
SELECT rule, count(*) FILTER (severity = 'break') AS breaks, count(*) FILTER (severity = 'warn') AS warns, count(*) FILTER (severity = 'info') AS infos, CASE WHEN bool_or(severity = 'break') THEN 'BREAK' WHEN bool_or(severity = 'warn') THEN 'WARN' ELSE 'CLEAN' END AS verdict FROM f GROUP BY 1""")
def verdict_fold(spark: SparkSession, d: str) -> DataFrame:
    """Findings of three rules, folded to a verdict by rule."""
    return fd.verdict(_findings(spark, d), "rule")


@query("""SELECT 'webapp.mixed_content' AS rule, CAST(page_id AS VARCHAR) AS symbol FROM pages WHERE starts_with(url, 'http://') UNION ALL SELECT 'calls.unresolved', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def severity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Findings that are warnings at least."""
    return fd.at_least(_findings(spark, d), "warn").select("rule", "symbol")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return fd.union(
        webapp_mixed_content(spark, d).select(*fd.finding("webapp.mixed_content", "warn", F.col("page_id"), F.lit("plain http"))),
        unresolved_anti(spark, d).select(*fd.finding("calls.unresolved", "break", F.col("c_custkey"), F.lit("no urgent order"))),
        table(spark, d, "part").where("p_size > 45").select(*fd.finding("coverage.large", "info", F.col("p_partkey"), F.lit("large"))),
    )


@query("""SELECT epoch_us(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01')) AS from_us, event_type AS function, count(*) AS runs, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2""")
def log_windows(spark: SparkSession, d: str) -> DataFrame:
    """Runs in windows of seven days; the same plan takes a stream."""
    return windows(process_log(table(spark, d, "events"))).select(F.unix_micros("from").alias("from_us"), "function", "runs", "errors")


def scripts(spark: SparkSession, d: str, later: bool) -> DataFrame:
    """Each order as a script of two functions in its customer's project; later ones have lost a parameter (F) or have a new name (P)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # parsing is costly and a table of few row groups would be one task
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(n, "o_orderkey")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    name = F.when((status == "P") & F.lit(later), "h").otherwise("f")
    params = F.when((status == "F") & F.lit(later), "a").otherwise("a, b")
    code = F.concat(F.lit("/** Order. */\nfunction "), name, key, F.lit("("), params, F.lit(") {\n  if (a > 1) { return g"), key, F.lit("(a, 'x)'); }\n  return null;\n}\nconst g"), key, F.lit(" = x => ({id: x, s: `${f"), key, F.lit("(x, 1)}`});\n"))
    return o.select(F.col("o_custkey").cast("string").alias("project"), F.concat(key, F.lit(".gs")).alias("file"), F.lit("gs").alias("kind"), code.alias("content"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS project, CAST(2 * count(*) AS BIGINT) AS functions, CAST(2 * count(*) AS BIGINT) AS calls, CAST(count(*) AS BIGINT) AS nullable FROM orders GROUP BY 1""")
def scan_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts parsed to facts, counted by project."""
    n = lambda kind, also=True: F.count_if((F.col("fact") == kind) & also)
    return fs.facts(scripts(spark, d, False)).groupBy("project").agg(n("function").alias("functions"), n("call").alias("calls"), n("returns", F.coalesce("flag", F.lit(False))).alias("nullable"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS project, CASE WHEN o_orderstatus = 'F' THEN 'param.removed' ELSE 'function_renamed' END AS change, 'f' || o_orderkey AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'b' ELSE 'h' || o_orderkey END AS detail FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def script_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes between two snapshots of parsed scripts."""
    return rules.changes(*_snapshots(spark, d, rules.CHANGED))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS project, 'internal_caller' AS kind, 'break' AS severity, o_orderkey || '.gs' AS file, CAST(6 AS INT) AS line, 'f' || o_orderkey AS symbol,
CASE WHEN o_orderstatus = 'F' THEN 'passes removed parameter b' ELSE 'still names a function that is now h' || o_orderkey END AS reason FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def script_check(spark: SparkSession, d: str) -> DataFrame:
    """What those changes break: calls that pass the lost parameter, calls by the old name."""
    return rules.diff(*_snapshots(spark, d, rules.DIFFED))


def _snapshots(spark: SparkSession, d: str, only: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The stores of the scripts before and after, of the facts that are asked for; of the later ones only those that changed are parsed."""
    before = fs.written(fs.facts(scripts(spark, d, False), only))
    return before, fs.written(incremental.scan_incremental(before, scripts(spark, d, True), only))


@query(r"""SELECT CAST(page_id AS VARCHAR) AS file, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"#][^"]*)"[^>]*>')) AS tag FROM pages) WHERE NOT contains(tag, 'target=') GROUP BY 1""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links without a target by page, from the facts of whole pages."""
    pages = table(spark, d, "pages").select(F.lit("site").alias("project"), F.col("page_id").cast("string").alias("file"), F.lit("html").alias("kind"), F.col("html").alias("content"))
    return fs.view(fs.facts(pages), "html_link").groupBy("file").agg(F.count("*").alias("links"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.lit("site").alias("project"), F.col("page_id").cast("string").alias("file"), F.lit("html").alias("kind"), F.col("html").alias("content"))


@query(r"""SELECT CAST(page_id AS VARCHAR) AS file, generate_subscripts(b, 1) - 1 AS ordinal, CAST(length(unnest(b)) AS INTEGER) AS length FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS b FROM pages)""")
def webapp_script_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Inline scripts of whole pages, as the page parser cuts them."""
    return fs.view(fs.facts(_pages(spark, d)), "chunk").select("file", F.col("ordinal").cast("long").alias("ordinal"), "length")


@query("""WITH s AS (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added FROM s""")
def field_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """Priorities of a customer's filled orders as fields before, of open ones as fields after."""
    some = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    told = table(spark, d, "orders").groupBy("o_custkey").agg(some("F").alias("a"), some("O").alias("b"))
    lost = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return told.select("o_custkey", lost("a", "b").alias("removed"), lost("b", "a").alias("added"))


@query("""SELECT l_orderkey, CAST(max(l_linenumber) FILTER (l_linestatus = 'F') AS BIGINT) AS was, CAST(max(l_linenumber) AS BIGINT) AS now FROM lineitem GROUP BY 1 HAVING max(l_linenumber) > max(l_linenumber) FILTER (l_linestatus = 'F')""")
def column_growth(spark: SparkSession, d: str) -> DataFrame:
    """Orders as variables, line numbers as columns read: those whose greatest grew from the filled lines to all."""
    line = F.col("l_linenumber").cast("long")
    told = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linestatus") == "F", line)).alias("was"), F.max(line).alias("now"))
    return told.where("now > was")


_WORDS = """WITH w AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '[a-z]{9,}')) AS id FROM documents), o AS (SELECT id, min(lang) AS env FROM w GROUP BY 1)"""


def _resource_words(spark: SparkSession, d: str) -> DataFrame:
    """Long words of documents as resource ids in code; each belongs to the first language that has it."""
    words = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0)))).alias("id"))
    owner = words.groupBy(F.col("id").alias("_id")).agg(F.min("lang").alias("env"))
    return words.join(owner, F.col("id") == F.col("_id"))


@query(_WORDS + " SELECT doc_id, w.id, env FROM w JOIN o ON w.id = o.id WHERE lang <> env")
def word_leak(spark: SparkSession, d: str) -> DataFrame:
    """Ids in documents of another language than their own."""
    return _resource_words(spark, d).where("lang <> env").select("doc_id", "id", "env")


@query(_WORDS + " SELECT lang, count(*) AS hits, count(DISTINCT w.id) AS ids FROM w JOIN o ON w.id = o.id WHERE lang = env GROUP BY 1")
def word_hardcode(spark: SparkSession, d: str) -> DataFrame:
    """Ids written out in documents of their own language."""
    return _resource_words(spark, d).where("lang = env").groupBy("lang").agg(F.count("*").alias("hits"), F.countDistinct("id").alias("ids"))


@query("""SELECT c_custkey, count(*) AS matches FROM customer JOIN supplier ON s_nationkey = c_nationkey OR floor(s_acctbal / 100) = floor(c_acctbal / 100) GROUP BY 1""")
def disjunctive_match(spark: SparkSession, d: str) -> DataFrame:
    """Customers by how many suppliers have their nation or their balance in hundreds: counts by either less those by both, so no pair is made."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 100).alias("b"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.floor(F.col("c_acctbal") / 100).alias("b"))
    count = lambda name, *keys: s.groupBy(*keys).agg(F.count("*").alias(name))
    out = c.join(count("by_nation", "n"), "n", "left").join(count("by_balance", "b"), "b", "left").join(count("by_both", "n", "b"), ["n", "b"], "left").na.fill(0, ["by_nation", "by_balance", "by_both"])
    return out.select("c_custkey", (F.col("by_nation") + F.col("by_balance") - F.col("by_both")).alias("matches")).where("matches > 0")


_HEAT = """WITH m AS (SELECT c_custkey AS f, CASE WHEN c_custkey % 5 < 4 THEN (SELECT count(*) FROM events WHERE user_id = c_custkey) END AS runs, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS errors, c_mktsegment = 'BUILDING' AS seen FROM customer),
h AS (SELECT *, CASE WHEN runs IS NULL THEN 'unknown' WHEN runs = 0 THEN 'cold' WHEN runs / 30.0 >= 1 THEN 'hot' ELSE 'warm' END AS heat FROM m)"""


def _heated(spark: SparkSession, d: str) -> DataFrame:
    """Customers as functions, events of the user of that number as their log over 30 days; a fifth has no metrics; one segment counts as exposed."""
    log = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    out = table(spark, d, "customer").join(log, F.col("c_custkey") == F.col("user_id"), "left")
    out = out.select(F.col("c_custkey").alias("f"), F.when(F.col("c_custkey") % 5 < 4, F.coalesce("n", F.lit(0))).alias("runs"), F.coalesce("e", F.lit(0)).alias("errors"), (F.col("c_mktsegment") == "BUILDING").alias("seen"))
    return out.withColumn("heat", crosschecks.heat_of(F.col("runs"), 30))


@query(_HEAT + " SELECT f, heat FROM h")
def heat(spark: SparkSession, d: str) -> DataFrame:
    return _heated(spark, d).select("f", "heat")


@query(_HEAT + " SELECT f, CASE WHEN heat = 'unknown' THEN 'unknown' WHEN runs > 0 AND errors * 100 >= runs * 5 THEN 'errored' WHEN NOT seen AND heat = 'cold' THEN 'confirmed_dead' WHEN NOT seen THEN 'dispatched_dynamic' WHEN heat = 'cold' THEN 'cold_exposed' ELSE 'live' END AS status FROM h")
def cross_status(spark: SparkSession, d: str) -> DataFrame:
    return _heated(spark, d).select("f", crosschecks.status_of(F.col("heat"), F.col("runs"), F.col("errors"), F.col("seen")).alias("status"))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'live_web_app' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'live_addon' WHEN c_mktsegment = 'BUILDING' THEN 'live_api' ELSE 'head_only' END AS status FROM customer""")
def dispatch_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first of three kinds of orders that a customer has: one aggregate, one join."""
    has = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority").like("1%")).alias("web"), F.bool_or(F.col("o_orderstatus") == "P").alias("addon"))
    out = table(spark, d, "customer").join(has, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.when(F.col("web"), "live_web_app").when(F.col("addon"), "live_addon").when(F.col("c_mktsegment") == "BUILDING", "live_api").otherwise("head_only").alias("status"))


@query("""SELECT DISTINCT p_type, word FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word NOT IN (SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)""")
def doc_drift(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names that no name starts with, by type: references to nothing known."""
    part = table(spark, d, "part")
    known = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return part.select("p_type", F.explode(F.split("p_name", " ")).alias("word")).distinct().join(known, "word", "left_anti").select("p_type", "word")


@query("""SELECT r_name || '/' || n_name AS project, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'""")
def suffix_target(spark: SparkSession, d: str) -> DataFrame:
    """Customers of the project region/nation that ends in a nation's name."""
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("project"))
    return ws.pick(geo, "NATION_3").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("project", "c_custkey")


def edited_scripts(spark: SparkSession, d: str) -> DataFrame:
    """All scripts, those of one order in a hundred with a function more."""
    more = F.when(F.regexp_extract("file", r"^(\d+)", 1).cast("long") % 100 == 7, "function more() { return f(1); }\n").otherwise("")
    return scripts(spark, d, False).withColumn("content", F.concat("content", more))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS project, CAST(sum(CASE WHEN o_orderkey % 100 = 7 THEN 3 ELSE 2 END) AS BIGINT) AS functions, CAST(sum(CASE WHEN o_orderkey % 100 = 7 THEN 3 ELSE 2 END) AS BIGINT) AS calls FROM orders GROUP BY 1""")
def scan_incremental(spark: SparkSession, d: str) -> DataFrame:
    """An incremental scan after one script in a hundred changed: the whole store, of which only those are parsed anew."""
    store = incremental.scan_incremental(fs.written(fs.facts(scripts(spark, d, False))), edited_scripts(spark, d))
    n = lambda kind: F.count_if(F.col("fact") == kind)
    return store.groupBy("project").agg(n("function").alias("functions"), n("call").alias("calls"))
