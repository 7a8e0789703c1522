"""Queries of sources, maintenance, adoption and the journal, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text as fn
from graphlens.operators import adopt, maintain
from graphlens.plans.views import table
from graphlens.sources import files, jobs
from graphlens.storage import new_folder, stored
from graphlens.streaming import journal

QUERIES, SQL = {}, {}
NOW = "2030-01-01 00:00:00"


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _now():
    return F.lit(NOW).cast("timestamp")


# Sources.


def _doc_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))


@query("""SELECT source, 'local:hash:sha256-' || left(sha256(string_agg(path || chr(0) || hash || chr(10), '' ORDER BY path)), 32) AS snapshot_id, count(*) AS n
FROM (SELECT source, source || '/' || doc_id AS path, sha256(text) AS hash FROM documents) GROUP BY 1""")
def snapshot_digest(spark, sf_dir):
    return files.snapshot_digest(_doc_files(spark, sf_dir))


@query("""WITH l AS (SELECT source, count(*) OVER (PARTITION BY source) AS n, source || '/' || doc_id AS path, sha256(text) AS hash FROM documents),
p AS (SELECT source, n, left(sha256(path), CASE WHEN n <= 16 THEN 1 WHEN n <= 256 THEN 2 WHEN n <= 4096 THEN 3 ELSE 4 END) AS part, sha256(string_agg(path || chr(0) || hash || chr(10), '' ORDER BY path)) AS d FROM l GROUP BY ALL)
SELECT source, 'local:tree:sha256-' || left(sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)), 32) AS snapshot_id, n FROM p GROUP BY ALL""")
def snapshot_tree(spark, sf_dir):
    """As for sources of very many files: none is digested whole."""
    return files.snapshot_digest(_doc_files(spark, sf_dir), 1)


@query(r"""SELECT url AS path, sha256(html) AS sha256, strlen(html) AS size FROM pages
WHERE strlen(html) <= 1048576 AND NOT regexp_matches(url, '(^|/)(build|dist)(/|$)') AND NOT regexp_matches(url, '(^|/)[^/]*7(/.*)?$')""")
def file_scan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))
    named = pages.withColumn("name", F.concat("path", F.lit(".html")))
    return named.filter(files.kept(F.col("name"), F.col("size"), []) & ~F.col("path").rlike(files.glob_pattern("*7"))).select("path", "sha256", "size")


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def point_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return files.by_ids(rows, ids).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, unnest(scope) AS scope FROM (SELECT p_brand || '-' || p_partkey AS id, list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) > 3)) AS scope FROM part) WHERE len(scope) > 0")
def catalog_explode(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.array_distinct(F.filter(F.split("p_name", " "), lambda x: F.length(x) > 3)).alias("scope"))
    return files.catalog(entries)


@query("SELECT p_brand || '-' || p_partkey AS id, p_type AS scope FROM part WHERE p_size % 4 <> 0 AND p_partkey % 5 <> 0")
def catalog_strings(spark, sf_dir):
    """Entries whose scope is one string; of some it is missing, or they have no id."""
    name = F.when(F.col("p_partkey") % 5 != 0, F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")))
    return files.catalog(table(spark, sf_dir, "part").select(name.alias("id"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("scope")))


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("cluster_name"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("submitted_at"))


@query("SELECT o_orderkey AS job_id, o_orderpriority AS cluster_name, o_orderstatus AS state FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def job_list(spark, sf_dir):
    return jobs.list_jobs(_jobs(spark, sf_dir)).select("job_id", "cluster_name", "state")


@query("""SELECT user_id AS job_id, max(event_id) AS attempt, arg_max(event_type, event_id) AS state, string_agg(event_type, '>' ORDER BY ts, event_id) AS states FROM events GROUP BY 1""")
def job_detail(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("state"), "ts")
    return jobs.job_detail(rows.drop("ts"), rows.withColumnRenamed("attempt", "ord"))


@query("""WITH e AS (SELECT user_id AS job_id, event_id AS attempt, event_type AS state FROM events), q AS (SELECT DISTINCT user_id AS job_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -1 END AS asked FROM events)
SELECT q.job_id, asked, max(attempt) AS attempt, arg_max(state, attempt) AS state, '/logs/' || q.job_id AS stdout_path, NULL::VARCHAR AS job_dir FROM q JOIN e ON e.job_id = q.job_id AND (asked = -1 OR attempt = asked) GROUP BY q.job_id, asked""")
def job_attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("state"))
    asked = events.select(F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-1).alias("attempt"))
    found = jobs.asked_jobs(rows, asked).withColumn("metadata", F.create_map(F.lit("run.stdout_path"), F.concat(F.lit("/logs/"), F.col("job_id").cast("string"))))
    return jobs.log_paths(found, "run.").select("job_id", "asked", "attempt", "state", "stdout_path", "job_dir")


@query("""SELECT conv_id || '/' || turn AS id, role AS stream, array_to_string(string_split(text, chr(10))[-2:], chr(10)) AS tail, text IS NULL AS missing FROM conversations""")
def log_tail(spark, sf_dir):
    logs = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("stream"), "text")
    return jobs.log_tail(logs, 2)


@query("""SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'profile' AS source FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, 'ssh' FROM supplier""")
def destinations(spark, sf_dir):
    profiles = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return jobs.destinations(profiles, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("""SELECT r_name AS project, n_name AS experiment, o_orderkey AS run_id, o_orderstatus AS status
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
WHERE r_regionkey = 1 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def run_list(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    runs = rows.select(F.col("r_name").alias("project"), F.col("n_name").alias("experiment"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"), "r_regionkey")
    return jobs.list_runs(runs, "r_regionkey", 1, "O", 100).select("project", "experiment", "run_id", "status")


@query("""SELECT r_name AS project, n_name AS experiment, count(c_custkey) AS runs FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def project_list(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("r_name").alias("project"), F.col("n_name").alias("experiment")).agg(F.count("c_custkey").alias("runs"))


# Names, paths and texts.

_PATH = r"regexp_replace(url, '^[a-z]+://[^/]+/?', '')"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+/?", "").alias("path"), "html")


@query("SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS summary FROM documents")
def first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.first_line(F.col("text")).alias("summary"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PATH} || '/__init__.py', '\.[^./]+$', ''), '/__init__$', ''), '/+$', ''), '/+', '.', 'g') AS qualname FROM pages")
def path_qualname(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", fn.path_qualname(F.concat("path", F.lit("/__init__.py"))).alias("qualname"))


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' END AS language FROM pages WHERE {_PATH} IS NOT NULL")
def path_language(spark, sf_dir):
    suffix = F.element_at(F.array(F.lit(".PY"), F.lit(".tsx"), F.lit(".bin")), (F.col("page_id") % 3 + 1).cast("int"))
    return _paths(spark, sf_dir).select("page_id", fn.path_language(F.concat("path", suffix)).alias("language"))


@query(rf"SELECT page_id, regexp_matches({_PATH} || '/' || (CASE WHEN page_id % 2 = 0 THEN 'test_a.py' ELSE 'a.py' END), '(^|/)(tests?/|conftest\.py$|test_[^/]*$|[^/]*_test\.py$)') AS is_test FROM pages")
def test_paths(spark, sf_dir):
    name = F.when(F.col("page_id") % 2 == 0, "test_a.py").otherwise("a.py")
    return _paths(spark, sf_dir).select("page_id", fn.is_test_path(F.concat_ws("/", "path", name)).alias("is_test"))


@query(r"SELECT c_custkey, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 1200 THEN left(text, 1200) || '…' ELSE text END AS text FROM documents")
def text_caps(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.capped(F.col("text"), 1200).alias("text"))


# Maintenance.


@query("""WITH o AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.path = n.path""")
def snapshot_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    new = docs.withColumn("hash", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return maintain.snapshot_diff(docs.withColumn("hash", F.sha2("text", 256)).filter("doc_id % 7 <> 0"), new.filter("doc_id % 11 <> 0"))


@query("SELECT source, bool_or(doc_id % 97 = 0) AS stale FROM documents GROUP BY 1")
def stat_stale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), "doc_id")
    return maintain.stale_sources(docs, docs.withColumn("mtime", F.when(F.col("doc_id") % 97 == 0, 2).otherwise(1)))


@query("SELECT doc_id::VARCHAR AS path, md5(text) AS hash, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'reuse' ELSE 'extract' END AS action FROM documents")
def extract_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"), "doc_id")
    payload = F.when(F.col("doc_id") % 2 == 0, F.lit('{"nodes": 1}')).otherwise(F.lit("{broken"))
    cache = docs.filter("doc_id % 3 = 0").withColumns({"version": F.lit("4"), "payload": payload})
    return maintain.extract_plan(docs.drop("doc_id"), cache, "4")


@query("""WITH r AS (SELECT user_id % 50 AS path, event_type AS hash, '4' AS version, props AS payload, ts AS created_at FROM events)
SELECT path, hash, max(payload) FILTER (created_at = m) AS payload FROM (SELECT *, max(created_at) OVER (PARTITION BY path, hash) AS m FROM r) GROUP BY 1, 2""")
def cache_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("path"), F.col("event_type").alias("hash"), F.lit("4").alias("version"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), "event_id")
    return maintain.upserted(rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id")).select("path", "hash", "payload")


def _cache(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("key"), F.col("ts").alias("created_at"), F.length("props").cast("long").alias("size"))


@query("SELECT event_id AS key FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 30 * 86400::BIGINT * 1000000")
def age_prune(spark, sf_dir):
    rows = _cache(spark, sf_dir).crossJoin(F.broadcast(table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))))  # one row
    return maintain.age_prune(rows, F.col("now"), 30).select("key")


@query("SELECT event_type AS cache, event_id AS key FROM (SELECT *, sum(length(props)) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS s FROM events) WHERE s <= 2000")
def size_shed(spark, sf_dir):
    return maintain.shed_to_fit(_cache(spark, sf_dir), 2000).select("cache", "key")


@query("""SELECT event_type AS cache, event_id AS key FROM (SELECT *, sum(length(props)) OVER w AS t, count(*) OVER w AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WINDOW w AS (PARTITION BY event_type))
WHERE t <= 2000 OR k > greatest(n // 10, 1)""")
def size_shed_pass(spark, sf_dir):
    return maintain.shed_pass(_cache(spark, sf_dir), 2000).select("cache", "key")


def _manifests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("spec"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("indexed_at"), F.col("event_type").alias("commit"))


@query(f"SELECT user_id AS spec, event_id AS snapshot_id FROM events WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) <= 36500 * 86400::BIGINT * 1000000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def retention_topk(spark, sf_dir):
    return maintain.retain_newest(_manifests(spark, sf_dir), _now(), 36500, 3).select("spec", "snapshot_id")


@query("SELECT user_id AS snapshot_id, event_id AS build_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("snapshot_id"), F.col("ts").alias("indexed_at"), F.col("event_id").alias("build_id"), "event_type")
    return maintain.latest_manifest(rows).drop("indexed_at")


@query("SELECT o_custkey AS spec, count(*) AS snapshots, round(sum(o_totalprice), 2) AS bytes FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def scope_gc(spark, sf_dir):
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spec"), F.col("o_totalprice").alias("size"))
    return maintain.out_of_scope(snapshots, table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("spec")))


@query("SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2)")
def orphan_gc(spark, sf_dir):
    folders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return maintain.orphans(folders, table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("snapshot_id")), _now()).select("snapshot_id")


@query("""SELECT event_id AS snapshot_id, left(sha256('{"overlays":[' || (CASE WHEN user_id % 3 = 0 THEN 'null' ELSE '"|' || user_id || '\\u00e9"' END) || '],"resolver":"' || event_type || '","schema":4}'), 24) AS build, event_type = 'view' AS valid FROM events""")
def cache_valid(spark, sf_dir):
    overlay = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("|"), F.col("user_id").cast("string"), F.lit("é")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("snapshot_id"), F.lit(4).alias("schema_version"), F.col("event_type").alias("components"), F.struct(F.lit(4).alias("schema"), F.col("event_type").alias("resolver"), F.array(overlay).alias("overlays")).alias("parts"))
    rows = rows.withColumn("build", maintain.build_id(F.col("parts"), rows.schema["parts"].dataType))
    valid = maintain.cache_valid(rows, rows.filter("components = 'view'").select("schema_version", "components").distinct())
    return valid.join(rows.select("snapshot_id", "build"), "snapshot_id")


@query("""WITH h AS (SELECT user_id AS spec, arg_max(event_type, (ts, event_id)) AS head FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
SELECT event_id, CASE WHEN head IS NULL THEN 'unknown' WHEN head = event_type THEN 'fresh' ELSE 'stale' END AS freshness FROM events LEFT JOIN h ON spec = user_id""")
def commit_freshness(spark, sf_dir):
    rows = _manifests(spark, sf_dir)
    heads = rows.filter("spec % 4 <> 0").groupBy("spec").agg(F.max_by("commit", F.struct("indexed_at", "snapshot_id")).alias("commit"))
    joined = rows.join(heads.select("spec", F.col("commit").alias("head")), "spec", "left")
    known = maintain.commit_freshness(rows.withColumn("spec", F.col("snapshot_id")), joined.filter("head is not null").select(F.col("snapshot_id").alias("spec"), F.col("head").alias("commit")))
    return known.select(F.col("spec").alias("event_id"), "freshness")


@query(f"""SELECT event_type AS cache, count(*) AS entries, sum(length(props))::BIGINT AS used, sum(length(props)) > 10000 AS over_limit,
coalesce(sum(length(props)) FILTER (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 1000 * 86400::BIGINT * 1000000), 0)::BIGINT AS reclaimable FROM events GROUP BY 1""")
def cache_report(spark, sf_dir):
    return maintain.cache_report(_cache(spark, sf_dir), _now(), 1000, 10_000)


@query("""WITH n AS (SELECT count(*) AS k FROM documents), e AS (SELECT source, count(*) AS edges FROM lineitem, n JOIN documents ON doc_id = l_orderkey % k GROUP BY 1), w AS (SELECT source, sum(len(regexp_extract_all(text, '[^\n]+'))) AS nodes FROM documents GROUP BY 1)
SELECT source, count(*) AS files, any_value(nodes)::BIGINT AS nodes, coalesce(any_value(edges), 0) AS edges, min(doc_id) % 2 = 0 AS cached FROM documents JOIN w USING (source) LEFT JOIN e USING (source) GROUP BY 1 UNION ALL SELECT 'empty', 0, 0, 0, false""")
def index_report(spark, sf_dir):
    """Documents as files, their lines as nodes, order lines as edges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sources = docs.groupBy("source").agg((F.min("doc_id") % 2 == 0).alias("cached")).union(spark.range(1).select(F.lit("empty"), F.lit(False)))
    nodes = docs.select("source", F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")))
    n = docs.agg(F.count(F.lit(1)).alias("k"))
    edges = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select((F.col("l_orderkey") % F.col("k")).alias("doc_id")).join(docs.select("doc_id", "source"), "doc_id")  # one row
    return maintain.index_report(sources, docs, nodes, edges)


@query("""WITH b AS (SELECT c_custkey AS ord, c_custkey // 2 AS spec, 'n' || (c_custkey % 40) AS name FROM customer), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY spec ORDER BY ord) = 1)
SELECT ord, spec, CASE WHEN row_number() OVER w > 1 THEN name || '-' || row_number() OVER w ELSE name END AS name FROM f WINDOW w AS (PARTITION BY name ORDER BY ord)""")
def source_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.floor(F.col("c_custkey") / 2).alias("spec"), F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("name"))
    return maintain.source_dedupe(rows)


@query("""WITH b AS (SELECT c_custkey AS ord, c_custkey // 2 AS spec, 'n' || (c_custkey % 40) AS name FROM customer), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY spec ORDER BY ord) = 1),
d AS (SELECT spec, CASE WHEN row_number() OVER w > 1 THEN name || '-' || row_number() OVER w ELSE name END AS name FROM f WINDOW w AS (PARTITION BY name ORDER BY ord)), x AS (SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '-2' ELSE '' END AS name, -n_nationkey::BIGINT AS spec FROM nation)
SELECT name, spec, false AS explicit FROM d WHERE name NOT IN (SELECT name FROM x) UNION ALL SELECT name, spec, true FROM x""")
def source_set(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.floor(F.col("c_custkey") / 2).alias("spec"), F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("name"))
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "-2").otherwise(""))
    return maintain.source_set(rows, table(spark, sf_dir, "nation").select(name.alias("name"), (-F.col("n_nationkey")).cast("long").alias("spec")))


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '2.0' ELSE p_name || '-' || p_type END AS name, string_split(lower(p_name), ' ') AS fs FROM part)
SELECT k, CASE WHEN k % 4 = 0 THEN 'pkg2.0' ELSE replace(lower(name), ' ', '') END AS source, CASE k % 5 WHEN 0 THEN 'mod' || k WHEN 1 THEN fs[1] WHEN 2 THEN 'lone' ELSE CASE WHEN k % 4 = 0 THEN '2.0' ELSE replace(name, '-', '_') END END AS top FROM p WHERE NOT (k % 5 = 1 AND k % 4 = 0)""")
def package_names(spark, sf_dir):
    """Source names and top levels: a fifth declare theirs, a fifth have one folder that fits, a fifth a lone one that doesn't, and the rest two that are as good as each other."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "2.0").otherwise(F.concat_ws("-", "p_name", "p_type"))
    words = F.split(F.lower("p_name"), " ")
    folders = F.when(k % 5 == 1, F.array(words[0], F.replace(F.lower(F.replace(name, F.lit(" "), F.lit("-"))), F.lit("-"), F.lit("_")), F.lit("tests_of_it"))).when(k % 5 == 2, F.array(F.lit("lone"))).when(k % 5 > 2, F.array(F.lit("x1"), F.lit("x2")))
    declared = F.when(k % 5 == 0, F.concat(F.lit("\n  mod"), k.cast("string"), F.lit("\nother")))
    rows = table(spark, sf_dir, "part").filter("not (p_partkey % 5 = 1 and p_partkey % 4 = 0)").select(k.alias("k"), name.alias("name"), declared.alias("declared"), folders.alias("folders"))
    return rows.select("k", maintain.source_name(F.col("name")).alias("source"), maintain.top_level(F.col("name"), F.col("declared"), F.col("folders")).alias("top"))


@query(r"""WITH p AS (SELECT 'pkg-' || p_partkey AS normal, p_size % 3 = 0 AS e, list_contains(regexp_split_to_array(lower(p_name), '[,\s]+'), 'small') AS k, p_size % 5 = 0 AS d,
p_partkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) AS inc, p_partkey IN (5, 6, 20, 30, 40) AS exc, p_partkey % 7 = 0 AS nowhere FROM part),
o AS (SELECT *, CASE WHEN exc AND (e OR k OR d OR inc) THEN 'excluded' WHEN NOT (e OR k OR d OR inc) THEN 'none' WHEN nowhere THEN 'skipped' ELSE 'source' END AS outcome FROM p)
SELECT normal, CASE WHEN outcome IN ('source', 'skipped') THEN concat_ws(',', CASE WHEN e THEN 'entry_point' END, CASE WHEN k THEN 'keyword' END, CASE WHEN d THEN 'editable' END, CASE WHEN inc THEN 'override' END) ELSE '' END AS identified_by, outcome FROM o""")
def package_signals(spark, sf_dir):
    groups = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("lens.plugins"))).otherwise(F.array(F.lit("other")))
    name = F.concat(F.lit("Pkg_."), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(name.alias("name"), F.regexp_replace("p_name", " ", ", ").alias("keywords"), groups.alias("entry_point_groups"), F.when(F.col("p_size") % 5 == 0, "file:///x").alias("direct_url"), F.when(F.col("p_partkey") % 7 != 0, "/x").alias("package_dir"))
    return maintain.package_signals(rows, ["small"], "lens.", [f"pkg-{k}" for k in range(1, 11)], [f"pkg-{k}" for k in (5, 6, 20, 30, 40)])


# Adoption: pages as files (host/path/index.html), lineitem as a ledger.

_LISTING = r"""ls AS (SELECT regexp_replace(url, '^[a-z]+://', '') || '/' || CASE page_id % 12 WHEN 0 THEN 'Params' || page_id || '.yaml' WHEN 1 THEN 'events.out.tfevents.' || page_id WHEN 2 THEN page_id || '.trr'
WHEN 3 THEN page_id || '.LAMMPSTRJ' WHEN 4 THEN 'checkpoint-' || page_id WHEN 5 THEN page_id || '.pth' ELSE 'p' || page_id || '.html' END AS path,
CASE WHEN page_id % 25 = 0 THEN 0 ELSE strlen(html) END AS size, sha256(html) AS sha256, page_id FROM pages)"""
_DIRS = "an AS (SELECT path, size, page_id, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS dir FROM ls)"
_ARTIFACT = r"""(starts_with(string_split(path, '/')[-1], 'events.out.tfevents.') OR regexp_matches(lower(string_split(path, '/')[-1]), '^.+\.(log|lammps|out|dat|npy|npz|h5|hdf5|csv|xyz|pdb|dcd|xtc|trr|lammpstrj|chk|pt|pth)$|^(params|result|checkpoint|thermo|metrics|log|out)'))"""


def _listing(spark, sf_dir):
    k, key = F.col("page_id") % 12, F.col("page_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("Params"), key, F.lit(".yaml"))).when(k == 1, F.concat(F.lit("events.out.tfevents."), key)).when(k == 2, F.concat(key, F.lit(".trr")))
    name = name.when(k == 3, F.concat(key, F.lit(".LAMMPSTRJ"))).when(k == 4, F.concat(F.lit("checkpoint-"), key)).when(k == 5, F.concat(key, F.lit(".pth"))).otherwise(F.concat(F.lit("p"), key, F.lit(".html")))
    size = F.when(F.col("page_id") % 25 == 0, 0).otherwise(F.octet_length("html")).cast("long")
    return table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), name).alias("path"), size.alias("size"), F.sha2("html", 256).alias("sha256"), "page_id")


@query(f"""WITH {_LISTING}, {_DIRS} SELECT dir, len(string_split(dir, '/'))::INT AS depth, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (regexp_extract(path, '^(.*)/[^/]*$', 1) = dir) AS direct, len(string_split(dir, '/')) > 6 AS too_deep FROM an GROUP BY dir""")
def dir_rollup(spark, sf_dir):
    return adopt.dir_rollup(_listing(spark, sf_dir))


@query(f"WITH {_LISTING} SELECT path, {_ARTIFACT} AS artifact FROM ls")
def artifact_flag(spark, sf_dir):
    return _listing(spark, sf_dir).select("path", adopt.is_artifact(F.col("path")).alias("artifact"))


def _classify_sql() -> str:
    out = [f"WITH {_LISTING}, {_DIRS}, ds AS (SELECT dir, len(string_split(dir, '/')) AS depth, bool_or(regexp_extract(path, '^(.*)/[^/]*$', 1) = dir AND {_ARTIFACT}) AS a FROM an GROUP BY dir), k7 AS (SELECT dir, depth, 'loose' AS kind FROM ds WHERE depth = 99)"]
    for d in range(6, 0, -1):
        out.append(f""", b{d} AS (SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS dir, list_sort(list(DISTINCT kind)) AS ks FROM k{d + 1} GROUP BY 1), k{d} AS (SELECT ds.dir, depth,
        CASE WHEN ks = ['run'] THEN 'experiment' WHEN ks = ['experiment'] THEN 'project' WHEN a AND (ks IS NULL OR ks = ['loose']) THEN 'run' ELSE 'loose' END AS kind FROM ds LEFT JOIN b{d} ON b{d}.dir = ds.dir WHERE depth = {d})""")
    return "".join(out)


_KINDS = " UNION ALL ".join(f"SELECT dir, depth::INT AS depth, kind FROM k{d}" for d in range(6, 0, -1))


@query(_classify_sql() + f" SELECT * FROM ({_KINDS})")
def dir_classify(spark, sf_dir):
    return adopt.classify_dirs(_listing(spark, sf_dir))


@query(_classify_sql() + f" SELECT 'kind ' || kind AS what, count(*) AS n FROM ({_KINDS}) GROUP BY kind UNION ALL SELECT 'files', count(*) FROM ls UNION ALL SELECT 'bytes', sum(size)::BIGINT FROM ls UNION ALL SELECT 'depth', max(len(string_split(path, '/')) - 1)::BIGINT FROM ls")
def survey_summary(spark, sf_dir):
    listing = _listing(spark, sf_dir)
    return adopt.survey_summary(adopt.classify_dirs(listing), listing)


@query("""WITH r AS (SELECT source || repeat('/d', (doc_id % 9)::INT) || '/' || doc_id AS path, doc_id, n_chars FROM documents)
SELECT path, CASE WHEN doc_id % 20 = 0 THEN 'broken_symlink' WHEN doc_id % 10 = 0 THEN 'escaping_symlink' WHEN doc_id % 33 = 0 THEN 'unreadable_file' WHEN n_chars < 100 THEN 'empty_file' ELSE 'depth_limit' END AS oddity FROM r WHERE doc_id % 10 = 0 OR doc_id % 33 = 0 OR n_chars < 100 OR doc_id % 9 + 1 > 6""")
def oddities(spark, sf_dir):
    link = F.col("doc_id") % 10 == 0
    path = F.concat("source", F.repeat(F.lit("/d"), (F.col("doc_id") % 9).cast("int")), F.lit("/"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), link.alias("is_symlink"), F.when(link & (F.col("doc_id") % 20 != 0), "../x").alias("link_target"), F.when(F.col("doc_id") % 33 != 0, F.when(F.col("n_chars") < 100, 0).otherwise(F.col("n_chars"))).alias("size"))
    return adopt.oddities(rows)


def _plan(spark, sf_dir):
    listing = _listing(spark, sf_dir)
    runs = adopt.classify_dirs(listing).filter("kind = 'run'").select("dir")
    return listing, runs, adopt.plan_mapping(runs, "root")


_SLUG = "coalesce(nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'default')"
_PLAN = _classify_sql() + f""", rn AS (SELECT dir, string_split(dir, '/') AS p FROM ({_KINDS}) WHERE kind = 'run'),
pl AS (SELECT dir, {_SLUG.format("coalesce(p[-3], 'root')")} AS project, {_SLUG.format("coalesce(p[-2], 'default')")} AS experiment, {_SLUG.format("p[-1]")} AS run_id FROM rn),
ow AS (SELECT dir AS run, path FROM an WHERE dir IN (SELECT dir FROM rn))"""


@query(_PLAN + " SELECT * FROM pl")
def plan_mapping(spark, sf_dir):
    return _plan(spark, sf_dir)[2]


@query(_PLAN + " SELECT * FROM ow")
def run_files(spark, sf_dir):
    listing, runs, _ = _plan(spark, sf_dir)
    return adopt.run_files(listing, runs)


@query(_PLAN + " SELECT path, CASE WHEN size = 0 THEN 'empty' ELSE 'outside any run' END AS reason FROM ls WHERE path NOT IN (SELECT path FROM ow)")
def skipped_files(spark, sf_dir):
    listing, runs, _ = _plan(spark, sf_dir)
    return adopt.skipped(listing, adopt.run_files(listing, runs))


def _planned(spark, sf_dir):
    listing, runs, mapping = _plan(spark, sf_dir)
    owned = adopt.run_files(listing, runs)
    sized = owned.join(mapping, owned["run"] == mapping["dir"]).join(listing.select("path", "size"), "path")
    return sized.select("project", "experiment", "run_id", F.col("run").alias("source"), F.expr("substring(path, length(run) + 2)").alias("file"), "size")


_PLANNED = _PLAN + ", pn AS (SELECT project, experiment, run_id, run AS source, substring(ow.path, length(run) + 2) AS file, size FROM ow JOIN pl ON dir = run JOIN ls ON ls.path = ow.path)"


@query(_PLANNED + " SELECT count(DISTINCT project) AS projects, count(DISTINCT (project, experiment)) AS experiments, count(DISTINCT (project, experiment, run_id)) AS runs, count(file) AS files FROM pn")
def plan_totals(spark, sf_dir):
    return adopt.plan_totals(_planned(spark, sf_dir))


_SLOTS = ", sl AS (SELECT DISTINCT source, CASE WHEN length(source) % 2 = 0 THEN 'old/' || source ELSE project || '/' || experiment || '/run-' || run_id END AS target, CASE WHEN length(source) % 2 = 0 THEN 'old' ELSE run_id END AS run_id FROM pn)"


@query(_PLANNED + _SLOTS + """ SELECT 'run' AS kind, source, target, 'verified' AS status, run_id, 0::BIGINT AS size, 0 AS place FROM sl UNION ALL SELECT 'ingest', source, target, 'pending', run_id, 0, 1 FROM sl
UNION ALL SELECT 'file', source || '/' || file, target || '/artifacts/' || file, 'pending', sl.run_id, size, 2 FROM pn JOIN sl USING (source)""")
def ledger_plan(spark, sf_dir):
    planned = _planned(spark, sf_dir)
    prior = planned.filter("length(source) % 2 = 0").select(F.lit("run").alias("kind"), "source", F.concat(F.lit("old/"), "source").alias("target"), F.lit("moved").alias("status"), F.lit("old").alias("run_id")).distinct()
    return adopt.ledger_plan(planned, True, prior).select("kind", "source", "target", "status", "run_id", "size", F.col("ord.place").alias("place"))


@query("""WITH l AS (SELECT s_suppkey AS ledger, s_name AS source, s_nationkey AS t, CASE WHEN s_suppkey % 2 = 0 THEN 'copy' ELSE 'move' END AS mode, s_suppkey % 3 AS version FROM supplier)
SELECT ledger, field, have, want FROM (SELECT ledger, 'mode' AS field, mode AS have, 'copy' AS want FROM l UNION ALL SELECT ledger, 'version', version::VARCHAR, '1' FROM l UNION ALL SELECT ledger, 'target', t::VARCHAR, (t % 5)::VARCHAR FROM l) WHERE have <> want""")
def ledger_guard(spark, sf_dir):
    have = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ledger"), F.col("s_name").alias("source"), F.col("s_nationkey").alias("target"), F.when(F.col("s_suppkey") % 2 == 0, "copy").otherwise("move").alias("mode"), (F.col("s_suppkey") % 3).alias("version"))
    return adopt.incompatible(have, have.select("ledger", "source", (F.col("target") % 5).alias("target"), F.lit("copy").alias("mode"), F.lit(1).alias("version")))


@query("""SELECT l_suppkey AS ledger, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_shipdate AS target, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_shipdate)::INT AS place FROM lineitem WHERE l_returnflag <> 'N' QUALIFY place <= 50""")
def ledger_outstanding(spark, sf_dir):
    return adopt.outstanding(_ledger(spark, sf_dir)).select("ledger", "target", "place")


@query("""WITH l AS (SELECT o_custkey AS run, o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'csv' ELSE 'log' END AS format, o_orderkey % 2 = 0 AS step FROM orders)
SELECT run, path, format, CASE WHEN run % 4 = 0 OR (format = 'csv' AND NOT step) THEN 'skip' ELSE 'ingest' END AS action, CASE WHEN run % 4 = 0 THEN 'already ingested' WHEN format = 'csv' AND NOT step THEN 'csv needs step and series columns' END AS reason FROM l""")
def ingest_plan(spark, sf_dir):
    logs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "csv").otherwise("log").alias("format"), F.when(F.col("o_orderkey") % 2 == 0, "step").alias("step"), F.array(F.lit("loss")).alias("series"))
    return adopt.ingest_plan(logs, table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("run")))


@query("""SELECT run, array_to_string(list_sort(json_keys(arg_min(props, p))), ',') AS keys FROM (SELECT user_id AS run, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END * 1000000000 + event_id AS p, props FROM events WHERE event_type IN ('view', 'click')) GROUP BY 1""")
def param_lift(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "view", "params.json").when(F.col("event_type") == "click", "parameters.json").otherwise("other.json")
    rows = events.select(F.col("user_id").alias("run"), name.alias("name"), F.col("props").alias("content"), "event_id")
    first = rows.groupBy("run", "name").agg(F.min_by("content", "event_id").alias("content"))
    return adopt.lifted_parameters(first)


@query(f"SELECT p_brand AS scope, {_SLUG.format('p_name')} AS slug, count(DISTINCT p_name) AS names FROM (SELECT p_brand, p_name || (CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '!' END) AS p_name FROM part) GROUP BY ALL HAVING names > 1")
def slug_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".").otherwise("!")).alias("name"))
    return adopt.slug_conflicts(rows)


def _ledger(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linenumber") % 2 == 0, "moved").otherwise("verified")).when(F.col("l_returnflag") == "R", "pending").otherwise("failed")
    return table(spark, sf_dir, "lineitem").select(F.lit("file").alias("kind"), F.col("l_orderkey").cast("string").alias("source"), F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]).alias("target"), status.alias("status"), F.col("l_suppkey").alias("ledger"), F.col("l_quantity").alias("size"), F.md5(F.col("l_partkey").cast("string")).alias("sha256"))


@query("SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_shipdate AS target, CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'moved' WHEN l_returnflag = 'N' THEN 'verified' ELSE 'pending' END AS status FROM lineitem")
def ledger_resume(spark, sf_dir):
    old = _ledger(spark, sf_dir)
    return adopt.resumed(old.select("kind", "source", "target").withColumn("status", F.lit("pending")), old).select("target", "status")


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 9 = 0 THEN 'skip' WHEN doc_id % 3 = 0 THEN 'transfer' WHEN doc_id % 4 = 0 THEN 'refuse' ELSE 'reuse' END AS decision FROM documents""")
def transfer_decision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("h"))
    sources = docs.select("path", F.when(F.col("doc_id") % 9 != 0, F.col("h")).alias("sha256"))
    targets = docs.filter("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 4 == 0, F.lit("other")).otherwise(F.col("h")).alias("sha256"))
    return adopt.transfer_decision(sources, targets)


@query("""SELECT ledger, ord, decision FROM (SELECT *, coalesce(max((decision = 'refuse')::INT) OVER (PARTITION BY ledger ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
FROM (SELECT l_suppkey AS ledger, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS ord, CASE WHEN l_quantity > 45 THEN 'refuse' ELSE 'transfer' END AS decision FROM lineitem)) WHERE f = 0""")
def transfer_until_failure(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ledger"), (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_quantity") > 45, "refuse").otherwise("transfer").alias("decision"))
    return adopt.until_failure(rows)


@query("""SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_shipdate AS target, CASE WHEN l_returnflag <> 'N' THEN 'outstanding' WHEN l_linenumber = 1 THEN 'missing' WHEN l_linenumber = 2 THEN 'size drift' ELSE 'hash drift' END AS problem FROM lineitem
WHERE l_returnflag <> 'N' OR l_linenumber IN (1, 2, 3)""")
def verify_ledger(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    number = F.split("target", "/")[1]
    there = ledger.filter(number != "1").select("target", F.when(number == "2", F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(number == "3", "x").otherwise(F.col("sha256")).alias("sha256"))
    return adopt.verify(ledger, there)


@query("""SELECT l_suppkey AS ledger, count(*) FILTER (l_returnflag = 'N' AND l_linenumber % 2 = 1) AS verified, count(*) FILTER (l_returnflag = 'N' AND l_linenumber % 2 = 0) AS moved, 0::BIGINT AS skipped, count(*) FILTER (l_returnflag = 'R') AS pending, count(*) FILTER (l_returnflag = 'A') AS failed, bool_and(l_returnflag = 'N') AS complete FROM lineitem GROUP BY 1""")
def ledger_status(spark, sf_dir):
    return adopt.ledger_status(_ledger(spark, sf_dir))


_OUTCOME = """x AS (SELECT l_suppkey AS ledger, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS ord, l_quantity::BIGINT AS size, CASE WHEN l_quantity > 45 AND l_linenumber < 3 THEN 'refuse' WHEN l_linenumber = 4 THEN 'skip' WHEN l_linenumber = 5 THEN 'reuse' ELSE 'transfer' END AS decision FROM lineitem),
s AS (SELECT ledger, min(ord) AS stop FROM x WHERE decision = 'refuse' GROUP BY 1),
oc AS (SELECT x.*, CASE WHEN ord > stop THEN 'pending' WHEN decision = 'skip' THEN 'skipped' WHEN decision = 'refuse' THEN 'failed' ELSE 'moved' END AS status,
  CASE WHEN ord > stop THEN NULL WHEN decision = 'skip' THEN 'source vanished' WHEN decision = 'refuse' THEN 'target holds another file' END AS detail FROM x LEFT JOIN s USING (ledger))"""


def _outcome(spark, sf_dir):
    n = F.col("l_linenumber")
    decision = F.when((F.col("l_quantity") > 45) & (n < 3), "refuse").when(n == 4, "skip").when(n == 5, "reuse").otherwise("transfer")
    order = F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + n
    return adopt.transfer_outcome(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ledger"), order.alias("ord"), F.col("l_quantity").cast("long").alias("size"), decision.alias("decision")), "move")


@query(f"WITH {_OUTCOME} SELECT ledger, ord, size, decision, status, detail FROM oc")
def transfer_outcome(spark, sf_dir):
    return _outcome(spark, sf_dir)


@query(f"""WITH {_OUTCOME} SELECT ledger, count(*) FILTER (status = 'moved' AND decision = 'transfer') AS transferred, count(*) FILTER (status = 'moved' AND decision = 'reuse') AS reused,
coalesce(sum(size) FILTER (status = 'moved' AND decision = 'transfer'), 0)::BIGINT AS bytes, count(detail) AS problems, count(*) FILTER (status IN ('pending', 'failed')) AS outstanding,
count(detail) = 0 AND count(*) FILTER (status IN ('pending', 'failed')) = 0 AS ok FROM oc GROUP BY 1""")
def outcome_report(spark, sf_dir):
    return adopt.outcome_report(_outcome(spark, sf_dir))


@query(f"""WITH {_OUTCOME} SELECT ledger || '/' || ord AS target, CASE WHEN status IN ('pending', 'failed') THEN 'outstanding' WHEN ord % 3 = 0 THEN 'missing' WHEN ord % 3 = 1 AND size > 0 THEN 'size drift' END AS problem FROM oc
WHERE status IN ('pending', 'failed') OR ord % 3 = 0 OR (ord % 3 = 1 AND size > 0)""")
def verify_outcome(spark, sf_dir):
    """The statuses and sizes of a transfer against what is found there."""
    ledger = _outcome(spark, sf_dir).withColumns({"target": F.concat_ws("/", "ledger", "ord"), "sha256": F.lit("h")})
    there = ledger.filter("ord % 3 <> 0").select("target", F.when(F.col("ord") % 3 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha256").dropDuplicates(["target"])
    return adopt.verify(ledger, there)


_EXCLUDED = ["en", "de", "1"]
_TOP = f"tp AS (SELECT path, size, list_filter(list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/')), lambda d: string_split(d, '/')[-1] IN {tuple(_EXCLUDED)})[1] AS dir FROM ls)"


@query(f"WITH {_LISTING}, {_TOP} SELECT dir, count(*) AS files, sum(size)::BIGINT AS bytes FROM tp WHERE dir IS NOT NULL GROUP BY 1")
def excluded_dirs(spark, sf_dir):
    return adopt.excluded_dirs(_listing(spark, sf_dir), _EXCLUDED)


@query(f"""WITH {_LISTING}, {_TOP}, an AS (SELECT path, size, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS d FROM tp WHERE dir IS NULL)
SELECT d AS dir, len(string_split(d, '/'))::INT AS depth, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (regexp_extract(path, '^(.*)/[^/]*$', 1) = d) AS direct, len(string_split(d, '/')) > 6 AS too_deep FROM an GROUP BY 1""")
def pruned_rollup(spark, sf_dir):
    return adopt.dir_rollup(adopt.surveyed(_listing(spark, sf_dir), _EXCLUDED))


@query(_PLAN + """, u AS (SELECT run, path FROM ow UNION ALL SELECT 'other/' || (length(path) % 3), path FROM ow WHERE length(path) % 2 = 0 UNION ALL SELECT 'more', path FROM ow WHERE length(path) % 4 = 0)
SELECT path, count(DISTINCT run) AS runs, min(run) AS first, max(run) AS last FROM u GROUP BY 1 HAVING runs > 1""")
def file_conflicts(spark, sf_dir):
    listing, runs, _ = _plan(spark, sf_dir)
    owned = adopt.run_files(listing, runs)
    n = F.length("path")
    other = owned.filter(n % 2 == 0).select(F.concat(F.lit("other/"), (n % 3).cast("string")).alias("run"), "path")
    return adopt.file_conflicts(owned.union(other).union(owned.filter(n % 4 == 0).select(F.lit("more"), "path")))


@query("""WITH r AS (SELECT c_custkey AS run, c_custkey % 7 = 0 AS b FROM customer), l AS (SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN 'csv' WHEN 'O' THEN 'lammps' ELSE 'tensorboard' END AS format FROM orders WHERE o_custkey % 3 <> 0)
SELECT 'format ' || format AS what, count(*) AS n FROM l GROUP BY format UNION ALL SELECT 'runs_with_buffer', count(*) FROM r WHERE b UNION ALL SELECT 'runs_without_logs', count(*) FROM r WHERE run NOT IN (SELECT run FROM l)""")
def log_summary(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "csv").when(F.col("o_orderstatus") == "O", "lammps").otherwise("tensorboard")
    logs = table(spark, sf_dir, "orders").filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("run"), kind.alias("format"))
    return adopt.log_summary(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_custkey") % 7 == 0).alias("has_buffer")), logs)


@query("""WITH l AS (SELECT l_orderkey AS run, l_linenumber::DOUBLE AS step, l_quantity, l_tax, l_discount FROM lineitem)
SELECT run, run || '.csv' AS path, step, unnest(['l_quantity', 'l "tax"']) AS series, unnest([l_quantity, l_tax]) AS value FROM l WHERE run % 2 = 0
UNION ALL SELECT run, run || '.csv', step, 'loss', l_discount FROM l WHERE run % 2 = 1""")
def csv_series(spark, sf_dir):
    """A CSV file for each order: even ones with a note and a quoted name, of which all numbers count; odd ones with other columns, of which one does."""
    even = F.col("l_orderkey") % 2 == 0
    cells = lambda *c: F.concat_ws(",", *[F.lit(x[1:]) if x[0] == "=" else F.col(x).cast("string") for x in c])
    line = F.when(even, cells("l_quantity", "l_linenumber", '="a, b"', "l_tax")).otherwise(cells("l_linenumber", "l_discount", "l_tax"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))  # of one order
    head = F.when(even, 'l_quantity,epoch,note,"l ""tax"""').otherwise("step,loss,l_tax")
    files = rows.select(F.col("l_orderkey").alias("run"), F.concat(F.col("l_orderkey").cast("string"), F.lit(".csv")).alias("path"), F.concat(head, F.lit("\n"), "body", F.lit("\n")).alias("content"), F.when(even, "epoch").otherwise("step").alias("step"), F.when(~even, F.array(F.lit("loss"), F.lit("none"))).alias("series"))
    return adopt.csv_series(files)


@query(_PLAN + """, q AS (SELECT DISTINCT split_part(dir, '/', 1) AS root FROM pl UNION ALL SELECT dir FROM pl) SELECT root || '!' AS request, root, dir AS run FROM q JOIN pl ON dir = root OR starts_with(dir, root || '/')""")
def ingest_fan_out(spark, sf_dir):
    _, runs, _ = _plan(spark, sf_dir)
    roots = runs.select(F.substring_index("dir", "/", 1).alias("root")).distinct().union(runs.select("dir"))
    return adopt.ingest_fan_out(roots.select(F.concat("root", F.lit("!")).alias("request"), "root"), runs)


@query("""WITH l AS (SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN 'csv' ELSE 'log' END AS format, CASE WHEN o_custkey % 4 = 0 OR (o_orderstatus = 'F' AND o_orderkey % 2 = 1) THEN 'skip' ELSE 'ingest' END AS action FROM orders),
e AS (SELECT run, format, count(*) FILTER (action = 'ingest') AS n, count(*) FILTER (action = 'skip') AS s FROM l GROUP BY ALL) SELECT run, coalesce(string_agg(format || '=' || n, ', ' ORDER BY format) FILTER (n > 0), '') AS counts, sum(s)::BIGINT AS skipped FROM e GROUP BY 1""")
def ingest_counts(spark, sf_dir):
    return adopt.ingest_counts(ingest_plan(spark, sf_dir))


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME series VALUE value")
def wide_to_long(spark, sf_dir):
    return adopt.wide_to_long(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity", "l_discount", "l_tax"])


@query("""WITH r AS (SELECT o_orderkey AS request, CASE o_orderstatus WHEN 'F' THEN 'copy' WHEN 'O' THEN 'move' ELSE 'link' END AS mode, o_orderkey % 10 AS k FROM orders)
SELECT request, 'mode' AS violation FROM r WHERE mode = 'link' UNION ALL SELECT request, 'nested' FROM r WHERE k = 0 UNION ALL SELECT request, 'format' FROM r WHERE k = 5""")
def preconditions(spark, sf_dir):
    k = F.col("o_orderkey") % 10
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderstatus") == "F", "copy").when(F.col("o_orderstatus") == "O", "move").otherwise("link").alias("mode"), F.lit("/data/a").alias("source"), F.when(k == 0, "/data/a/b").otherwise("/data/ab").alias("target"), F.when(k == 5, "xls").otherwise("csv").alias("format"))
    return adopt.preconditions(rows)


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), q AS (SELECT path, string_split(path, '/') AS s FROM p)
SELECT path, CASE WHEN len(list_filter(s[1:2], lambda x: NOT regexp_matches(x, '^[a-z0-9]+(-[a-z0-9]+)*$'))) > 0 THEN 'not kebab-case' ELSE 'no run prefix' END AS problem FROM q
WHERE len(list_filter(s[1:2], lambda x: NOT regexp_matches(x, '^[a-z0-9]+(-[a-z0-9]+)*$'))) > 0 OR (len(s) > 2 AND NOT starts_with(s[3], 'run-'))""")
def layout_names(spark, sf_dir):
    return adopt.layout_problems(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct())


# Journal.


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("session_id", F.col("user_id") % 20)


_JOURNAL = "j AS (SELECT user_id % 20 AS session_id, event_id, event_type, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS cursor FROM events), r AS (SELECT * FROM j QUALIFY cursor > max(cursor) OVER (PARTITION BY session_id) - 30)"


@query(f"WITH {_JOURNAL} SELECT session_id, event_id, cursor FROM r")
def journal_retained(spark, sf_dir):
    return journal.retained(journal.with_cursors(_events(spark, sf_dir)), 30).select("session_id", "event_id", "cursor")


@query(f"""WITH {_JOURNAL}, q AS (SELECT DISTINCT session_id, unnest([0, 10, 100000]) AS since FROM j), n AS (SELECT q.session_id, since, cursor FROM q JOIN r USING (session_id) WHERE cursor > since QUALIFY row_number() OVER (PARTITION BY session_id, since ORDER BY cursor) <= 12),
g AS (SELECT session_id, since, count(*) AS events, max(cursor) AS last FROM n GROUP BY ALL), o AS (SELECT session_id, min(cursor) AS oldest FROM r GROUP BY 1)
SELECT session_id, since::BIGINT AS since, coalesce(events, 0) AS events, coalesce(last, since)::BIGINT AS next_cursor, since < oldest - 1 AS truncated FROM q LEFT JOIN g USING (session_id, since) LEFT JOIN o USING (session_id)""")
def journal_page(spark, sf_dir):
    kept = journal.retained(journal.with_cursors(_events(spark, sf_dir)), 30)
    asked = _events(spark, sf_dir).select("session_id").distinct().select("session_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 10, 100000)])).alias("since"))
    return journal.poll(kept, asked, 12)


@query("SELECT user_id % 20 AS session_id, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS cursor FROM events WHERE event_type IN ('click', 'error')")
def journal_subscribed(spark, sf_dir):
    return journal.with_cursors(journal.subscribed(_events(spark, sf_dir), ["click", "error"])).select("session_id", "event_id", "cursor")


@query(f"WITH {_JOURNAL} SELECT session_id, event_id, cursor FROM r")
def stream_retention(spark, sf_dir):
    """The retained journal by a stream over all events in three micro-batches by time: what it has appended without what it has evicted."""
    path = new_folder(spark, "journal")
    events = _events(spark, sf_dir).select(F.col("session_id").cast("long").alias("session_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events = stored(events, "events")
    cuts = [c.timestamp() for c in events.agg(F.percentile_approx("ts", [0.33, 0.67])).first()[0]]
    at = F.col("ts").cast("double")
    for part in (at <= cuts[0], (at > cuts[0]) & (at <= cuts[1]), at > cuts[1]):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/in")  # one file a micro-batch
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with journal.keyed_state(spark):
        out = journal.stream_retained(source, 30).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    gone = rows.filter("change = 'evicted'").select("session_id", "cursor")
    return rows.filter("change = 'appended'").join(gone, ["session_id", "cursor"], "left_anti").select("session_id", "event_id", "cursor")


@query("""SELECT 'a' AS snapshot_id, p_partkey AS id, p_name AS name FROM part WHERE p_size > 10 UNION ALL SELECT 'b', s_suppkey, s_name FROM supplier""")
def published_reads(spark, sf_dir):
    """Two snapshots, one of them published again; an attempt without a manifest row is never read."""
    path = new_folder(spark, "published")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    files.publish({"nodes": parts.drop("p_size"), "files": parts.select("id")}, path, "a")
    files.publish({"nodes": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}, path, "b")
    files.publish({"nodes": parts.filter("p_size > 10").drop("p_size"), "files": parts.select("id")}, path, "a")
    parts.drop("p_size").write.parquet(f"{path}/nodes/snapshot_id=c/attempt=broken")
    return files.published(spark, path, "nodes")
