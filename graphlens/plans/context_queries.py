"""Queries of graph reads, descriptions, pages, bounded contexts and the routing guide, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphlens.functions.json import canonical
from graphlens.operators import context, federate, pages
from graphlens.plans.views import SQL_DOCUMENT_NODES, SQL_STAR, document_nodes, star_edges, star_nodes, table
from graphlens.sources import files

QUERIES, SQL = {}, {}


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Graph reads.


@query(f"WITH {SQL_STAR} SELECT id, kind FROM sn WHERE name IN (SELECT p_name FROM part UNION ALL SELECT n_name FROM nation)")
def nodes_by_name(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_name").alias("qualname")).union(table(spark, sf_dir, "nation").select("n_name"))
    return files.by_values(star_nodes(spark, sf_dir), "qualname", asked).select("id", "kind")


@query(f"WITH {SQL_STAR} SELECT id, name FROM sn WHERE kind = 'class' ORDER BY id LIMIT 50")
def nodes_by_kind(spark, sf_dir):
    return files.by_kind(star_nodes(spark, sf_dir), "class", 50).select("id", "name")


@query(f"WITH {SQL_STAR} SELECT source, target, kind, seq FROM se WHERE kind IN ('calls', 'extends') AND target IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25 UNION ALL SELECT 'n1')")
def edges_to(spark, sf_dir):
    ids = table(spark, sf_dir, "part").filter("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("id")).union(spark.range(1).select(F.lit("n1")))
    return files.edges_at(star_edges(spark, sf_dir), ids, "target", ["calls", "extends"]).select("source", "target", "kind", "seq")


# Descriptions: orders and parts of the star schema as symbols; order lines 6 and 7 of a part are its examples and tests.


def _id(c):
    return F.concat(F.lit("g#"), c, F.lit("#x"))


def _graph(spark, sf_dir):
    nodes = star_nodes(spark, sf_dir).withColumns({"id": _id(F.col("id")), "qualname": F.concat_ws(".", "kind", F.replace("name", F.lit(" "), F.lit("."))), "end_line": F.col("start_line") + 1, "signature": F.when(F.col("kind") == "function", F.concat("name", F.lit("()"))), "summary": F.when(F.length("name") > 12, F.col("name")), "docstring": F.lit(None).cast("string")})
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 6, "exemplifies").when(F.col("l_linenumber") == 7, "tests").otherwise("calls")
    how = F.when(F.col("l_returnflag") == "N", "resolved").otherwise("heuristic")
    edges = lines.select(_id(F.concat(F.lit("o"), "l_orderkey")).alias("source"), _id(F.concat(F.lit("p"), "l_partkey")).alias("target"), kind.alias("kind"), how.alias("provenance"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return nodes, edges


def _asked(spark, sf_dir):
    """Every part, every third order at an old snapshot, and suppliers of an unknown source."""
    ref = lambda source, snapshot, key: federate.symbol_ref(F.lit(source), F.lit(snapshot), _id(key))
    parts = table(spark, sf_dir, "part").select(ref("star", "local:hash:1", F.concat(F.lit("p"), "p_partkey")).alias("ref"))
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, ref("star", "local:hash:0", F.concat(F.lit("o"), "o_orderkey"))).otherwise(ref("star", "local:hash:1", F.concat(F.lit("o"), "o_orderkey"))).alias("ref"))
    return parts.union(orders).union(table(spark, sf_dir, "supplier").select(ref("other", "local:hash:1", F.concat(F.lit("s"), "s_suppkey"))))


def _described(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    sources = spark.createDataFrame([("star", "local:hash:1", "fresh")], "source string, snapshot string, freshness string")
    rules = table(spark, sf_dir, "part").select(F.concat_ws(".", F.lit("class"), F.split("p_name", " ")[0]).alias("scope")).distinct().select("scope", F.concat(F.lit("about "), "scope").alias("title"), F.array(F.lit("use it")).alias("rules"))
    text = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("text"))
    return context.describe(_asked(spark, sf_dir), sources, nodes, edges, rules, text)


_DESCRIBED = f"""{SQL_STAR},
gn AS (SELECT *, kind || '.' || replace(name, ' ', '.') AS qualname FROM sn),
ge AS (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, CASE l_linenumber WHEN 6 THEN 'exemplifies' WHEN 7 THEN 'tests' ELSE 'calls' END AS kind, CASE WHEN l_returnflag = 'N' THEN 'resolved' ELSE 'heuristic' END AS provenance, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
gi AS (SELECT kind, target AS ref, source AS id, min((seq, provenance)) AS e FROM ge GROUP BY ALL), gir AS (SELECT *, row_number() OVER (PARTITION BY kind, ref ORDER BY e[1], id) AS k FROM gi),
go AS (SELECT source AS ref, target AS id, min((seq, provenance)) AS e FROM ge WHERE kind = 'calls' GROUP BY ALL), gor AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY e[1], id) AS k FROM go),
la AS (SELECT ref, string_agg('g#' || id || '#x', ',' ORDER BY k) FILTER (kind = 'exemplifies' AND k <= 3) AS examples, string_agg('g#' || id || '#x', ',' ORDER BY k) FILTER (kind = 'tests' AND k <= 5) AS tests,
  string_agg('g#' || id || '#x', ',' ORDER BY k) FILTER (kind = 'calls' AND k <= 6 AND e[2] = 'resolved') AS callers FROM gir GROUP BY 1),
lo AS (SELECT ref, string_agg('g#' || id || '#x', ',' ORDER BY k) FILTER (k <= 6 AND e[2] = 'resolved') AS callees FROM gor GROUP BY 1),
cs AS (SELECT DISTINCT 'class.' || string_split(p_name, ' ')[1] AS scope FROM part),
cv AS (SELECT gn.qualname, scope, row_number() OVER (PARTITION BY gn.qualname ORDER BY length(scope) DESC, scope) AS k FROM (SELECT DISTINCT qualname FROM gn) gn JOIN cs ON gn.qualname = scope OR starts_with(gn.qualname, scope || '.')),
cl AS (SELECT qualname, string_agg(scope, ',' ORDER BY k) AS conventions FROM cv WHERE k <= 3 GROUP BY 1),
ft AS (SELECT p_brand AS file, list_sort(list(p_name)) AS ls FROM part GROUP BY 1),
ds AS (SELECT 'star@local:hash:1:g#' || gn.id || '#x' AS ref, gn.*, coalesce(examples, '') AS examples, coalesce(tests, '') AS tests, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, coalesce(conventions, '') AS conventions,
  CASE WHEN ls IS NULL THEN '<source unavailable>' ELSE array_to_string(ls[greatest(start_line, 1):greatest(start_line, 1) + 1 + (CASE WHEN start_line < 1 THEN start_line - 1 ELSE 0 END)], chr(10)) END AS source_code
  FROM gn LEFT JOIN la ON la.ref = gn.id LEFT JOIN lo ON lo.ref = gn.id LEFT JOIN cl ON cl.qualname = gn.qualname LEFT JOIN ft ON ft.file = gn.file
  WHERE gn.id[1] = 'p' OR (gn.id[1] = 'o' AND substring(gn.id, 2)::BIGINT % 3 <> 0))"""


@query(f"WITH {_DESCRIBED} SELECT ref, kind, qualname, examples, tests, callers, callees, conventions, source_code FROM ds")
def describe(spark, sf_dir):
    ids = lambda c, f="id": F.array_join(F.coalesce(F.transform(c, lambda x: x[f]), F.array().cast("array<string>")), ",").alias(c)
    return _described(spark, sf_dir).select("ref", "kind", "qualname", ids("examples"), ids("tests"), ids("callers"), ids("callees"), ids("conventions", "scope"), "source_code")


@query(f"""WITH {_DESCRIBED}, a AS (SELECT 'star@local:hash:1:g#p' || p_partkey || '#x' AS ref FROM part UNION ALL SELECT 'star@local:hash:' || (CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '1' END) || ':g#o' || o_orderkey || '#x' FROM orders UNION ALL SELECT 'other@local:hash:1:g#s' || s_suppkey || '#x' FROM supplier)
SELECT a.ref, ds.ref IS NOT NULL AS ok, CASE WHEN ds.ref IS NULL THEN 'SYMBOL_NOT_FOUND' END AS code,
coalesce(concat_ws(chr(10), '# ' || qualname, CASE WHEN kind = 'function' THEN '`' || name || '()`' END, CASE WHEN length(name) > 12 THEN name END, 'ref: ' || ds.ref), '') AS markdown,
CASE WHEN coalesce(examples, '') = '' THEN 0 ELSE len(string_split(examples, ',')) END::INT AS examples, CASE WHEN coalesce(tests, '') = '' THEN 0 ELSE len(string_split(tests, ',')) END::INT AS tests,
coalesce(kind = 'function', false) AS has_signature, coalesce(length(name) > 12, false) AS has_summary FROM a LEFT JOIN ds USING (ref)""")
def open_pages(spark, sf_dir):
    return context.open_pages(_asked(spark, sf_dir), _described(spark, sf_dir))


# Conversations as tasks: their turns are hits, details and pages.


@query("""WITH p AS (SELECT conv_id AS task_id, 1 AS part, turn AS ord, '## ' || role AS text FROM conversations UNION ALL SELECT conv_id, 2, turn, text FROM conversations),
u AS (SELECT *, 1500 - coalesce(sum(length(text) + 2) OVER (PARTITION BY task_id ORDER BY part, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM p WHERE text <> ''),
s AS (SELECT task_id, part, ord, CASE WHEN length(text) + 2 <= l THEN text ELSE left(text, (l - 2)::BIGINT) END AS text FROM u WHERE length(text) + 2 <= l OR l > 80)
SELECT task_id, string_agg(text, chr(10) || chr(10) ORDER BY part, ord) AS markdown FROM s GROUP BY 1""")
def compose_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("ord"), "role", "text")
    return context.compose([turns.select("task_id", "ord", F.concat(F.lit("## "), "role").alias("text")), turns.select("task_id", "ord", "text")], 1500)


_BUDGET, _ENVELOPE = 1200, 50


@query(f"""WITH h AS (SELECT conv_id AS task_id, turn AS rank, conv_id || '/' || turn AS ref, to_json({{'kind': role, 'ref': conv_id || '/' || turn}})::VARCHAR AS item, text,
  to_json({{'ref': conv_id || '/' || turn, 'text': text}})::VARCHAR AS ditem, to_json({{'ref': conv_id || '/' || turn}})::VARCHAR AS compact FROM conversations),
s AS (SELECT *, {_ENVELOPE} + sum(length(item) + 1) OVER (PARTITION BY task_id ORDER BY rank) AS used FROM h), k AS (SELECT * FROM s WHERE used <= {_BUDGET}),
b AS (SELECT task_id, max(used) AS base FROM k GROUP BY 1), d AS (SELECT task_id, rank, ditem, compact, text, base + sum(length(ditem) + 1) OVER (PARTITION BY task_id ORDER BY rank) AS du FROM k JOIN b USING (task_id)),
e AS (SELECT *, {_BUDGET} - (du - length(ditem) - 1) AS room FROM d), f AS (SELECT *, room - length(compact) - 36 AS space FROM e WHERE du <= {_BUDGET} OR (room > 0 AND length(compact) <= room)),
g AS (SELECT task_id, 'detail' AS part, rank, CASE WHEN du <= {_BUDGET} THEN ditem WHEN space > 0 AND length(text) > 0 THEN left(compact, length(compact) - 1) || ',"source":' || to_json(left(text, space::BIGINT) || CASE WHEN length(text) > space THEN chr(10) || '... (truncated)' ELSE '' END) || '}}' ELSE compact END AS item, du > {_BUDGET} AS compacted FROM f
  UNION ALL SELECT task_id, 'hit', rank, item, false FROM k)
SELECT *, ({_ENVELOPE} + sum(length(item) + 1) OVER (PARTITION BY task_id ORDER BY part DESC, rank))::BIGINT AS used FROM g""")
def context_pack(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    ref = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref")
    json = lambda *c: canonical(F.struct(*c), turns.select(F.struct(*c).alias("x")).schema["x"].dataType)
    hits = turns.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("rank"), ref, json(F.col("role").alias("kind"), ref).alias("item"))
    details = turns.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("rank"), ref, json(ref, "text").alias("item"), json(ref).alias("compact"), F.col("text").alias("source"))
    return context.fit_context(hits, details, _BUDGET, _ENVELOPE)


@query("""WITH s AS (SELECT user_id AS g, CASE WHEN bool_or(event_type = 'error') THEN 'stale' WHEN user_id % 5 = 0 THEN 'fresh' END AS f, count(*) FILTER (event_type = 'click') AS n, CASE WHEN user_id % 2 = 0 THEN 'available' WHEN user_id % 3 = 0 THEN 'down' END AS r FROM events GROUP BY 1)
SELECT g AS "group", concat_ws('; ', CASE WHEN coalesce(f, 'unknown') <> 'fresh' THEN 'collection freshness is ' || coalesce(f, 'unknown') END, CASE WHEN n > 0 THEN n || ' selected source(s) failed during retrieval' END, CASE WHEN coalesce(r, 'unknown') <> 'available' THEN 'registry status is ' || coalesce(r, 'unknown') END) AS warnings FROM s""")
def context_warnings(spark, sf_dir):
    group = F.col("user_id")
    states = table(spark, sf_dir, "events").groupBy(group.alias("group")).agg(F.bool_or(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "click").alias("failed"))
    states = states.withColumns({"freshness": F.when(F.col("e"), "stale").when(F.col("group") % 5 == 0, "fresh"), "registry": F.when(F.col("group") % 2 == 0, "available").when(F.col("group") % 3 == 0, "down")})
    return context.context_warnings(states).select("group", F.array_join("warnings", "; ").alias("warnings"))


# Cues of intents, fragments of roles, further roles, packages that stand for a role, and what is said of a role.
CUES = [(0, "how", "explain"), (1, "tion", "metal"), (2, "test", "verify"), (3, "the", "light"), (4, "run", "heavy")]
FRAGMENTS = [(0, "large", "heavy"), (1, "small", "light"), (2, "steel", "metal")]
EXTRA = [(0, "large", "light"), (1, "widget", "explain")]
HINTS = [(0, "explain", "guidebook"), (1, "verify", "checker"), (2, "heavy", "lifter"), (3, "verify", "assayer")]
TEXTS = [("light", "small things", "heavy tools"), ("verify", "before a release", "guessing")]


def _values(rows):
    return ", ".join(map(str, rows))


_GUIDE = f"""t AS (SELECT conv_id || '/' || turn AS task_id, text FROM conversations), c(ord, cue, role) AS (VALUES {_values(CUES)}), f(ord, fragment, role) AS (VALUES {_values(FRAGMENTS)}),
xr(ord, fragment, role) AS (VALUES {_values(EXTRA)}), h(ord, role, package) AS (VALUES {_values(HINTS)}), tx(role, "when", avoid) AS (VALUES {_values(TEXTS)}),
n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0), m AS (SELECT name, arg_min(f.role, (-length(fragment), ord)) AS role FROM n JOIN f ON contains(lower(name), fragment) GROUP BY 1),
al AS (SELECT name, role, min(o) AS o FROM (SELECT name, role, -1 AS o FROM m UNION ALL SELECT name, role, ord FROM n JOIN xr ON contains(lower(name), fragment)) GROUP BY ALL),
r AS (SELECT role, list_sort(list(DISTINCT name)) AS p, min((name, o)) AS f FROM al WHERE name NOT LIKE '%widget' GROUP BY 1), hh AS (SELECT role, list(package ORDER BY ord) AS p FROM h GROUP BY 1),
i AS (SELECT task_id, role, row_number() OVER (PARTITION BY task_id ORDER BY min(ord)) - 1 AS ord FROM t JOIN c ON contains(lower(text), cue) GROUP BY task_id, role),
j AS (SELECT * FROM i UNION ALL SELECT task_id, role, k FROM t, (SELECT role, row_number() OVER (ORDER BY f) - 1 AS k FROM r) WHERE task_id NOT IN (SELECT task_id FROM i)),
x AS (SELECT j.*, coalesce(r.p, hh.p, []) AS p, r.p IS NOT NULL AS available, tx."when", tx.avoid FROM j LEFT JOIN r USING (role) LEFT JOIN hh USING (role) LEFT JOIN tx USING (role)),
gd AS (SELECT task_id, ord::INT AS ord, role, coalesce("when", 'tasks related to role ' || chr(39) || role || chr(39)) AS "when", array_to_string(p, ',') AS prefer, available,
  concat_ws(' ', CASE WHEN len(p) > 0 THEN array_to_string(p[1:2], ' ') END, role, 'public API') AS search_query, coalesce(avoid, 'inventing interfaces that no source returned') AS avoid,
  CASE WHEN NOT available THEN 'intent ' || chr(39) || role || chr(39) || ' has no installed/ok source' END AS warning FROM x)"""


def _guide(spark, sf_dir):
    tasks = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"), "text")
    make, roles = spark.createDataFrame, "ord int, fragment string, role string"
    inventory, fragments = _inventory(spark, sf_dir), make(FRAGMENTS, roles)
    return tasks, context.routing_guide(tasks, make(CUES, "ord int, cue string, role string"), inventory, fragments, make(EXTRA, roles), make(HINTS, "ord int, role string, package string"), make(TEXTS, "role string, when string, avoid string"))


def _inventory(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_name").alias("name")).distinct().withColumn("status", F.when(F.col("name").endswith("widget"), "failed").otherwise("ok"))


@query(f"WITH {_GUIDE} SELECT * FROM gd")
def routing_guide(spark, sf_dir):
    return _guide(spark, sf_dir)[1]


@query(f"""WITH {_GUIDE}, u AS (SELECT task_id, -1 AS o, 0 AS k, trim(text) AS query FROM t UNION ALL SELECT task_id, ord, 0, search_query FROM gd WHERE prefer <> '' UNION ALL SELECT task_id, ord, 1, string_split(prefer, ',')[1] || ' public API capabilities' FROM gd WHERE prefer <> ''),
g AS (SELECT task_id, query, min((o, k)) AS m FROM u WHERE query <> '' GROUP BY ALL) SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY m) - 1 AS ord, query FROM g""")
def suggested_queries(spark, sf_dir):
    return context.suggested_queries(*_guide(spark, sf_dir))


@query(f"WITH {_GUIDE} SELECT task_id, string_agg(DISTINCT package, ',' ORDER BY package) AS packages FROM (SELECT task_id, unnest(string_split(prefer, ',')) AS package FROM gd WHERE available) GROUP BY 1")
def preferred_packages(spark, sf_dir):
    return context.preferred_packages(_guide(spark, sf_dir)[1])


@query(f"WITH {_GUIDE} SELECT name, name || ' public API' AS query FROM m WHERE name NOT LIKE '%widget'")
def guide_probes(spark, sf_dir):
    return context.probes(_inventory(spark, sf_dir), spark.createDataFrame(FRAGMENTS, "ord int, fragment string, role string"))


@query("""SELECT lang AS task_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, 'd' || doc_id) - 1 AS ord, 'd' || doc_id AS ref, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE source || doc_id END AS title, source, coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 1 END, false) AS executable,
NULL AS signature, left(text, 9) AS summary FROM documents QUALIFY ord < 12""")
def guide_hits(spark, sf_dir):
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    hits = table(spark, sf_dir, "documents").select(F.col("lang").alias("task_id"), F.col("n_chars").alias("rank"), F.concat(F.lit("d"), name).alias("ref"), F.when(k % 2 == 0, F.concat(F.lit("T"), name)).otherwise("").alias("title"), F.concat("source", name).alias("qualname"), "source", F.when(k % 3 > 0, k % 3 == 1).alias("executable"), F.lit(None).cast("string").alias("signature"), F.left("text", F.lit(9)).alias("summary"))
    return context.top_hits(hits)


@query("SELECT lang AS query_id, rank AS ord, CASE WHEN doc_id % 2 = 0 THEN 'execute' ELSE 'describe' END AS action, 'd' || doc_id AS ref FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents) WHERE rank < 5")
def next_actions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")) - 1)
    return context.next_actions(docs.select(F.col("lang").alias("query_id"), "rank", F.concat(F.lit("d"), "doc_id").alias("ref"), (F.col("doc_id") % 2 == 0).alias("executable")))


@query("""WITH l AS (SELECT DISTINCT source || 'x' AS a FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'src1'),
r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '@ns/' || source WHEN 1 THEN 'Family_' || source WHEN 2 THEN source || '.core' ELSE source END AS source, source AS root FROM documents)
SELECT doc_id, source FROM r WHERE EXISTS (SELECT 1 FROM l WHERE starts_with(a, root))""")
def scope_allow(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("@ns/"), "source")).when(k == 1, F.concat(F.lit("Family_"), "source")).when(k == 2, F.concat("source", F.lit(".core"))).otherwise(F.col("source"))
    listed = docs.filter("doc_id % 5 = 0").select(F.concat("source", F.lit("x")).alias("source")).distinct().union(spark.range(1).select(F.lit("SRC1")))
    return context.allowed_sources(docs.select("doc_id", name.alias("source")), listed, ["family"])


@query("""WITH l AS (SELECT list_sort(list(DISTINCT a)) AS a FROM (SELECT source AS a FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'src1'))
SELECT o_orderkey AS query_id, array_to_string(CASE o_orderkey % 3 WHEN 0 THEN a ELSE list_filter(['src' || o_orderkey % 30, 'zzz', 'src1'], lambda x: len(list_filter(a, lambda y: starts_with(y, x))) > 0) END, ',') AS sources FROM orders, l""")
def pinned_sources(spark, sf_dir):
    key = F.col("o_orderkey")
    named = F.when(key % 3 > 0, F.array(F.concat(F.lit("Family-Src"), (key % 30).cast("string")), F.lit("zzz"), F.lit("src1.core")))
    requests = table(spark, sf_dir, "orders").select(key.alias("query_id"), named.alias("sources"))
    listed = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select("source").distinct().union(spark.range(1).select(F.lit("SRC1")))
    return context.pinned_sources(requests, listed, ["family"]).select("query_id", F.array_join("sources", ",").alias("sources"))


# Pages.

_SEARCH_HITS = "row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank"


@query(f"""WITH h AS (SELECT source, doc_id, lang, {_SEARCH_HITS}, CASE WHEN doc_id % 3 > 0 THEN left(text, 20) ELSE '' END AS summary, CASE WHEN doc_id % 4 > 0 THEN 'd' || doc_id END AS ref FROM documents),
l AS (SELECT source, rank, '- `' || source || '.' || doc_id || '` (' || lang || ') source=`' || source || '` exec=`' || (CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END) || '`' || (CASE WHEN summary <> '' THEN chr(10) || '  ' || summary ELSE '' END) || coalesce(chr(10) || '  ref: `' || ref || '`', '') AS line FROM h WHERE rank < 30),
q AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'nothing')
SELECT q.source AS query_id, rtrim('# Search `about ' || q.source || '`' || chr(10) || chr(10) || '{pages.SEARCH_NOTE}' || chr(10) || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY rank), ''), chr(10) || ' ') || chr(10) AS markdown FROM q LEFT JOIN l USING (source) GROUP BY q.source""")
def search_pages(spark, sf_dir):
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")) - 1
    name = F.concat_ws(".", "source", k.cast("string"))
    hits = docs.select(F.col("source").alias("query_id"), rank.alias("rank"), name.alias("title"), F.col("lang").alias("kind"), "source", (k % 2 == 0).alias("executable"), F.when(k % 3 > 0, F.left("text", F.lit(20))).otherwise("").alias("summary"), F.when(k % 4 > 0, F.concat(F.lit("d"), k.cast("string"))).alias("ref"))
    asked = docs.select(F.col("source").alias("query_id")).distinct().union(spark.range(1).select(F.lit("nothing")))
    return pages.search_pages(asked.withColumn("text", F.concat(F.lit("about "), "query_id")), hits)


@query(f"""WITH {_GUIDE}, l AS (SELECT task_id, ord, '- **' || role || '**: ' || "when" || ' → prefer [' || (CASE WHEN prefer = '' THEN '' ELSE chr(39) || replace(prefer, ',', chr(39) || ', ' || chr(39)) || chr(39) END) || '] (available=' || (CASE WHEN available THEN 'True' ELSE 'False' END) || ')' AS line, '- warning: ' || warning AS warning FROM gd)
SELECT task_id, '{pages.SUGGEST_HEAD}' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY ord) || coalesce(chr(10) || string_agg(warning, chr(10) ORDER BY ord), '') || chr(10) AS markdown FROM l GROUP BY 1""")
def suggest_pages(spark, sf_dir):
    return pages.suggest_pages(_guide(spark, sf_dir)[1])


@query(f"""WITH {SQL_DOCUMENT_NODES}, m AS (SELECT source AS page, source, qualname, kind, CASE WHEN doc_id % 2 = 0 THEN left(docstring, 15) END AS summary, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord FROM dn WHERE kind = 'module' QUALIFY ord < 9),
s AS (SELECT source, '- `' || qualname || '` (' || kind || ') ' || (CASE WHEN doc_id % 2 = 0 THEN '(x)' ELSE '' END) || ' — s' || doc_id AS line, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM dn WHERE kind = 'class' QUALIFY place < 15),
t AS (SELECT source, string_agg(line, chr(10) ORDER BY place) AS tops FROM s GROUP BY 1),
p AS (SELECT page, ord, '## `' || qualname || '` (module)' || chr(10) || coalesce(nullif(summary, ''), '{pages.NO_MODULE_SUMMARY}') || coalesce(chr(10) || chr(10) || '{pages.SYMBOLS_NOTE}' || chr(10) || CASE WHEN ord % 2 = 0 THEN tops END, '') || chr(10) AS part FROM m LEFT JOIN t USING (source)),
o AS (SELECT DISTINCT source AS page FROM dn)
SELECT o.page, regexp_replace('# Outline: ' || o.page || (CASE WHEN ends_with(o.page, '1') THEN ' / sub' ELSE '' END) || chr(10) || chr(10) || '{pages.OUTLINE_NOTE}' || chr(10) || chr(10) || coalesce(string_agg(part, chr(10) ORDER BY ord), ''), '\\s+$', '') || chr(10) AS markdown FROM o LEFT JOIN p USING (page) GROUP BY 1""")
def outline_pages(spark, sf_dir):
    """The first modules of each source, every second with the source's classes as its symbols."""
    nodes, k = document_nodes(spark, sf_dir), F.col("doc_id")
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    modules = nodes.filter("kind = 'module'").withColumn("ord", place).filter("ord < 9").select(F.col("source").alias("page"), "ord", "qualname", "kind", F.when(k % 2 == 0, F.left("docstring", F.lit(15))).alias("summary"))
    classes = nodes.filter("kind = 'class'").withColumn("place", place).select(F.col("source").alias("page"), "place", "qualname", "kind", F.when(k % 2 == 0, "(x)").alias("signature"), F.concat(F.lit("s"), k.cast("string")).alias("summary"))
    symbols = classes.join(modules.filter("ord % 2 = 0").select("page", "ord"), "page")
    outlines = nodes.select(F.col("source").alias("page"), "source", F.when(F.col("source").endswith("1"), "sub").alias("path")).distinct()
    return pages.outline_pages(outlines, modules, symbols)


@query(f"""SELECT 's' || s_suppkey AS name, '## s' || s_suppkey || '  `' || (CASE WHEN s_suppkey % 2 = 0 THEN 'ok' ELSE 'None' END) || '`' || (CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || '- role_hint: `r`' ELSE '' END) || chr(10) || '- spec: `' || s_name || '`' || chr(10) || '- freshness: `fresh`' ||
(CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || '- modules indexed: ' || s_nationkey ELSE '' END) || (CASE WHEN s_suppkey % 5 = 0 THEN chr(10) || '- error: it broke' ELSE '' END) || chr(10) || chr(10) || (CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE '{pages.NO_PACKAGE_SUMMARY}' END) || chr(10) AS markdown FROM supplier""")
def package_pages(spark, sf_dir):
    k = F.col("s_suppkey")
    return pages.package_entries(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), F.when(k % 2 == 0, "ok").alias("status"), F.when(k % 3 == 0, "r").alias("role"), F.col("s_name").alias("spec"), F.lit("fresh").alias("freshness"), F.when(k % 2 == 0, F.col("s_nationkey")).alias("modules"), F.when(k % 5 == 0, "it broke").alias("error"), F.when(k % 4 == 0, F.col("s_name")).otherwise("").alias("summary")))


@query("""SELECT 'd' || doc_id AS ref, '## `' || (CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE 'd' || doc_id END) || '`' || chr(10) || chr(10) || 'signature: `' || (CASE WHEN doc_id % 2 = 0 THEN 'f()' ELSE 'None' END) || '`' || chr(10) || chr(10) || (CASE doc_id % 5 WHEN 0 THEN 'short' WHEN 1 THEN text ELSE '' END) || chr(10) AS markdown FROM documents""")
def detail_pages(spark, sf_dir):
    k, text = F.col("doc_id"), F.lit(None).cast("string")
    return pages.detail_pages(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), k.cast("string")).alias("ref"), F.when(k % 3 == 0, F.col("source")).alias("qualname"), F.when(k % 3 == 1, F.col("lang")).alias("title"), F.when(k % 2 == 0, "f()").alias("signature"), F.when(k % 5 == 0, "short").otherwise("").alias("summary"), F.when(k % 5 == 1, F.col("text")).otherwise(text).alias("docstring")))


@query(f"""WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey AS ref, p_name AS name, greatest(p_size % 8 - 1, 0) AS n FROM part)
SELECT ref, '# Open `' || ref || '`' || chr(10) || chr(10) || '- qualname: `' || name || '`' || chr(10) || '- signature: `None`' || chr(10) || '- executable: `' || (CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END) || '`' || chr(10) || '- coverage: examples=' || n || ' tests=' || (CASE WHEN k % 3 = 0 THEN 0 ELSE n END) || chr(10) || chr(10)
|| '## Summary' || chr(10) || chr(10) || (CASE WHEN k % 2 = 0 THEN name ELSE '{pages.NO_SUMMARY}' END) || chr(10) || chr(10) || '## Examples' || chr(10) || chr(10) || (CASE WHEN n = 0 THEN '{pages.NO_EXAMPLES}' ELSE array_to_string(list_transform(range(1, least(n, 5) + 1), lambda i: '- `e' || i || '`: '), chr(10)) END) || chr(10) || chr(10)
|| '## Tests' || chr(10) || chr(10) || (CASE WHEN n = 0 OR k % 3 = 0 THEN '{pages.NO_TESTS}' ELSE array_to_string(list_transform(range(1, least(n, 5) + 1), lambda i: '- `e' || i || '`'), chr(10)) END) || chr(10) AS markdown FROM p""")
def symbol_pages(spark, sf_dir):
    k = F.col("p_partkey")
    n = F.greatest(F.col("p_size") % 8 - 1, F.lit(0))
    listed = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("qualname"), F.lit(None).cast("string").alias("summary")))
    listed = F.slice(listed, F.lit(2), n)
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("ref"), F.col("p_name").alias("qualname"), F.lit(None).cast("string").alias("signature"), (k % 2 == 0).alias("executable"), F.when(k % 2 == 0, F.col("p_name")).alias("summary"), F.lit("").alias("docstring"), listed.alias("examples"), F.when(k % 3 != 0, listed).alias("tests"))
    return pages.symbol_pages(rows)


@query(f"""WITH {SQL_STAR} SELECT kind || '@s1:' || id AS ref, kind, 'ns' AS namespace, kind AS source, name AS title, CASE WHEN length(name) > 12 THEN name END AS summary, false AS executable, id AS node_id, 'unknown' AS language, 'unknown' AS freshness, coalesce(file, '') AS file, coalesce(start_line, 0) AS start_line, coalesce(start_line, 0) AS end_line FROM sn WHERE kind <> 'method'""")
def symbol_hits(spark, sf_dir):
    none = F.lit(None).cast("string")
    nodes = star_nodes(spark, sf_dir).withColumns({"source": F.col("kind"), "summary": F.when(F.length("name") > 12, F.col("name")), "signature": none, "language": none, "end_line": F.lit(None).cast("int")})
    sources = nodes.select("source").distinct().filter("source <> 'method'").select("source", F.lit("ns").alias("namespace"), F.lit("s1").alias("snapshot"), none.alias("freshness"))
    found = federate.symbol_hits(nodes, sources)
    return found.select("ref", "kind", "namespace", "source", "title", "summary", "executable", "provenance.node_id", "provenance.language", "freshness", "span.file", "span.start_line", "span.end_line")


@query("""SELECT '@p/' || p_partkey AS ref, p_size % 2 = 1 AND p_partkey % 3 = 0 AS executable, CASE WHEN p_size % 2 = 0 THEN 'none' WHEN p_partkey % 3 = 0 THEN 'ready' WHEN p_partkey % 3 = 1 THEN 'broken' ELSE 'unavailable' END AS execution_status, CASE WHEN p_size % 2 = 1 AND p_partkey % 3 = 0 THEN '@p/' || p_partkey END AS executable_capability_id,
CASE WHEN p_size % 5 = 0 THEN 'fresh' ELSE 'unknown' END AS freshness, p_name AS title FROM part WHERE p_partkey % 4 <> 0""")
def describe_registry(spark, sf_dir):
    k = F.col("p_partkey")
    part, ref = table(spark, sf_dir, "part"), F.concat(F.lit("@p/"), k.cast("string"))
    items = part.select(ref.alias("id"), F.when(F.col("p_size") % 2 == 0, "document").otherwise("executable").alias("kind"), F.when(k % 3 == 0, "ready").when(k % 3 == 1, "broken").alias("status"), F.when(F.col("p_size") % 5 == 0, "fresh").alias("freshness"), F.col("p_name").alias("title"))
    asked = part.filter("p_partkey % 4 <> 0").select(ref.alias("ref"))
    asked = asked.union(asked).union(part.select(F.concat(F.lit("@q/"), k.cast("string")))).union(part.select("p_name"))
    return context.describe_registry(asked, items).select("ref", "executable", "execution_status", "executable_capability_id", "freshness", "title")
