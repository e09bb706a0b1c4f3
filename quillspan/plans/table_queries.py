"""More queries over the driver's tables: searches, walks, upkeep of counts, places and windows, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import normalised, short_hash
from quillspan.operators import facts as fs
from quillspan.operators import deltas, incremental, patterns, production, walks
from quillspan.operators import relations as op
from quillspan.plans.catalog import edited_scripts, query, scripts
from quillspan.sources.shared import shared_folder
from quillspan.sources.tables import process_log, table
from quillspan.streaming import counters, log

_PASSAGES = """WITH h AS (SELECT doc_id, item_id, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'prod' END AS env, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'prod' END AS owner FROM documents JOIN benchmark ON contains(documents.text, benchmark.text))"""


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the benchmark in documents, as ids of resources in sources; even ones are of one environment, odd ones of the other."""
    env = lambda c: F.when(F.col(c) % 2 == 0, "dev").otherwise("prod")
    known = table(spark, d, "benchmark").select("item_id", F.col("text").alias("id"), env("item_id").alias("owner"))
    docs = table(spark, d, "documents").select("doc_id", env("doc_id").alias("env"), "text")
    hits = patterns.containing(docs, "text", known, "id").join(known.select("item_id", F.col("id").alias("_id")), F.col("id") == F.col("_id")).select("doc_id", "item_id", "env")
    return patterns.by_owner(hits, known.select("item_id", F.col("owner").alias("env")), "item_id", "env")


@query(_PASSAGES + " SELECT doc_id, item_id, env, owner FROM h WHERE env <> owner")
def resource_leak(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of the other environment."""
    return _passages(spark, d).where("not own").select("doc_id", "item_id", "env", F.col("owners")[0].alias("owner"))


@query(_PASSAGES + " SELECT doc_id, item_id, env FROM h WHERE env = owner")
def resource_hardcode(spark: SparkSession, d: str) -> DataFrame:
    """Documents that write out a passage of their own environment."""
    return _passages(spark, d).where("own").select("doc_id", "item_id", "env")


@query("""WITH p AS (SELECT regexp_extract(url, '^https?://[^/]+/[a-z]+/') AS prefix FROM pages WHERE page_id % 3 = 0 UNION SELECT regexp_extract(url, '^https?://[^/]+') FROM pages WHERE page_id % 7 = 0 UNION SELECT url FROM pages WHERE page_id % 11 = 0)
SELECT page_id, url, (SELECT arg_max(prefix, length(prefix)) FROM p WHERE starts_with(url, prefix)) AS prefix FROM pages""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Each page's address with the longest that fits of a list of sites, sections and addresses, itself taken from a part of the pages."""
    pages = table(spark, d, "pages").select("page_id", "url")
    cut = lambda rx: F.regexp_extract("url", rx, 0).alias("prefix")
    listed = pages.where("page_id % 3 = 0").select(cut("^https?://[^/]+/[a-z]+/")).union(pages.where("page_id % 7 = 0").select(cut("^https?://[^/]+"))).union(pages.where("page_id % 11 = 0").select("url"))
    return patterns.longest_prefixes(pages, "url", listed, "prefix")


_STEPS = """e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL),
g AS (SELECT a.event_type AS type, b.event_type AS step, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.i = a.i + 1 GROUP BY 1, 2),
r AS (SELECT type, step, step AS returns FROM g WHERE n * 25 > (SELECT sum(n) FROM g))"""


@query(f"""WITH RECURSIVE {_STEPS},
w AS (SELECT user_id, event_type AS type, CAST(0 AS BIGINT) AS done, false AS stopped FROM e WHERE i = 0 UNION ALL
SELECT w.user_id, coalesce(r.returns, w.type), w.done + CASE WHEN r.returns IS NULL THEN 0 ELSE 1 END, r.returns IS NULL FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.done + 1 LEFT JOIN r ON r.type = w.type AND r.step = e.event_type WHERE NOT w.stopped)
SELECT user_id, type, done, stopped FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY done DESC, stopped DESC) AS n FROM w) WHERE n = 1""")
def chain_walk(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events in order as a chain of calls, from the first one's type, walked through the transitions that are more frequent than one in 25."""
    e = table(spark, d, "events").where("user_id is not null").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    placed = op.ranked(e, "user_id", "at", "place").select("user_id", "event_type", (F.col("place") - 1).alias("i"))
    after = placed.select(F.col("user_id").alias("_u"), (F.col("i") - 1).alias("_i"), F.col("event_type").alias("step"))
    pairs = placed.join(after, (F.col("user_id") == F.col("_u")) & (F.col("i") == F.col("_i"))).groupBy(F.col("event_type").alias("type"), "step").agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    registry = pairs.where(F.col("n") * 25 > total).select("type", "step", F.col("step").alias("returns"))
    roots = placed.where("i = 0").select("user_id", F.col("event_type").alias("type"))
    steps = placed.where("i > 0").select("user_id", (F.col("i") - 1).alias("pos"), F.col("event_type").alias("step"))
    return walks.walk(steps, roots, registry, "user_id")


@query("""SELECT CAST(CASE WHEN l_orderkey % 100 = 7 THEN l_partkey + 1 ELSE l_partkey END AS BIGINT) AS l_partkey, count(DISTINCT l_orderkey) AS members, count(*) AS links FROM lineitem GROUP BY 1""")
def maintained_callers(spark: SparkSession, d: str) -> DataFrame:
    """Orders that call each part, after one order in a hundred calls the next part instead: the counts before, kept up by the difference."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey")
    edges = op.stored(deltas.edge_counts(rows, ["l_partkey"], ["l_orderkey"]))
    counts = op.stored(deltas.members(edges, ["l_partkey"]))
    gone = rows.where("l_orderkey % 100 = 7")
    delta = op.stored(deltas.signed(gone, gone.withColumn("l_partkey", F.col("l_partkey") + 1), ["l_partkey", "l_orderkey"]))
    return deltas.maintained_members(counts, edges, delta, ["l_partkey"], ["l_orderkey"])


@query("""SELECT l_partkey, array_to_string(list_slice(list(l_orderkey || '/' || l_linenumber ORDER BY l_orderkey, l_linenumber), 1, 10), ' ') AS first, count(*) AS total FROM lineitem GROUP BY 1""")
def first_callers(spark: SparkSession, d: str) -> DataFrame:
    """The first ten lines that name a part, and how many do in all."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    told = op.first_by_key(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"], 10, "first", "total")
    return told.select("l_partkey", F.array_join(F.transform("first", lambda x: F.concat_ws("/", x["l_orderkey"], x["l_linenumber"])), " ").alias("first"), "total")


@query("""WITH d AS (SELECT event_type AS function, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1, 2),
s AS (SELECT function, CAST(unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT function FROM d)),
w AS (SELECT function, day, CAST(sum(coalesce(n, 0)) OVER t AS BIGINT) AS runs, CAST(sum(coalesce(e, 0)) OVER t AS BIGINT) AS errors FROM s LEFT JOIN d USING (function, day) WINDOW t AS (PARTITION BY function ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))
SELECT function, strftime(day, '%Y-%m-%d') AS day, runs, errors, CASE WHEN runs = 0 THEN 'cold' WHEN runs / 30.0 >= 1 THEN 'hot' ELSE 'warm' END AS heat FROM w""")
def trailing_heat(spark: SparkSession, d: str) -> DataFrame:
    """Runs, errors and heat of each function over the thirty days up to each day."""
    told = production.trailing(process_log(table(spark, d, "events")), ["function"], 30)
    return told.select("function", F.date_format("day", "yyyy-MM-dd").alias("day"), "runs", "errors", "heat")


@query("""SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part""")
def name_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each part in the order of names, as readers have it; names here are of small letters and spaces, where bytes give the same."""
    return op.in_order(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "place", "p_partkey").withColumn("place", F.col("place").cast("long"))


@query("""SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) AS place FROM pages""")
def url_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each page in the order of the bytes of its address."""
    return op.in_order(table(spark, d, "pages").select("page_id", "url"), "url", "place", "page_id", collation="").withColumn("place", F.col("place").cast("long"))


_NEEDS = r"""n AS (SELECT conv_id, turn, role, text, trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')) AS need FROM conversations),
i AS (SELECT conv_id, turn, role, text, lower(to_base(list_reduce(list_transform(string_split(need, ''), lambda c: CAST(coalesce(unicode(nullif(c, '')), -1) AS BIGINT)), lambda h, c: CASE WHEN c < 0 THEN h ELSE xor(h * 33, c) & 4294967295 END, CAST(5381 AS BIGINT)), 36)) AS id FROM n)"""


@query("WITH " + _NEEDS + " SELECT conv_id, turn, id FROM i")
def request_ids(spark: SparkSession, d: str) -> DataFrame:
    """The short id of each turn's text as a need."""
    return table(spark, d, "conversations").select("conv_id", "turn", short_hash(normalised(F.col("text"))).alias("id"))


@query("WITH " + _NEEDS + """, t AS (SELECT id AS key, text, conv_id * 1000 + turn AS s, CASE WHEN turn % 2 = 0 THEN role END AS context FROM i)
SELECT key, arg_min(text, (s, text)) AS need, count(*) AS occurrences, CAST(min(s) AS BIGINT) AS first_seen, CAST(max(s) AS BIGINT) AS last_seen, arg_max(context, (s, context)) FILTER (context IS NOT NULL) AS context FROM t GROUP BY key""")
def streamed_needs(spark: SparkSession, d: str) -> DataFrame:
    """Turns as requests of a stream that is read to its end: the state of each need after it, read back from what the stream wrote.

    Every second turn tells a context. The whole stream comes twice, and counts once.
    """
    at = F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn"))
    rows = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("need"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" ").alias("context"), at.alias("at"))
    home = f"{shared_folder(spark)}/quillspan-{uuid.uuid4().hex}"
    for again in range(2):
        rows.write.mode("append").parquet(f"{home}/in")
        counters.run(counters.counted_stream(log.stream_of(spark, f"{home}/in")), f"{home}/out", f"{home}/at").awaitTermination()
    last = counters.current(spark.read.parquet(f"{home}/out"))
    return last.select("key", "need", "occurrences", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "context")


@query("""SELECT CAST(count(*) FILTER (o_orderkey % 100 = 7) AS BIGINT) AS parsed, CAST(count(*) FILTER (o_orderkey % 100 <> 7) AS BIGINT) AS taken_over, CAST(0 AS BIGINT) AS removed, CAST(sum(CASE WHEN o_orderkey % 100 = 7 THEN 3 ELSE 2 END) AS BIGINT) AS functions FROM orders""")
def scan_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental scan did, from the job that wrote its store: files parsed, taken over and removed, functions found."""
    before = fs.written(fs.facts(scripts(spark, d, False)))
    _, told = incremental.scan_measured(before, edited_scripts(spark, d))
    return told


@query("""SELECT CAST(o_custkey AS VARCHAR) AS project, CASE WHEN i = 0 THEN 'f' || o_orderkey WHEN i = 1 THEN 'g' || o_orderkey ELSE 'f' END AS symbol, CAST(count(*) AS BIGINT) AS members, CAST(count(*) AS BIGINT) AS links
FROM (SELECT o_custkey, o_orderkey, unnest(CASE WHEN o_orderkey % 100 = 7 THEN [0, 1, 2] ELSE [0, 1] END) AS i FROM orders) GROUP BY 1, 2""")
def maintained_calls(spark: SparkSession, d: str) -> DataFrame:
    """Callers of each name in scripts after one in a hundred changed: the counts of the scan before, kept up by the calls that those files lost and got."""
    before = fs.written(fs.facts(scripts(spark, d, False)))
    edges = op.stored(incremental.call_edges(before))
    counts = op.stored(deltas.members(edges, incremental.CALLED))
    return incremental.maintained_calls(before, edited_scripts(spark, d), edges, counts)
