"""Queries of search, walks and lint, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import federate, graph, lint, search
from graphlens.plans.views import SQL_DOCUMENT_NODES, SQL_STAR, SQL_TOKENS, benchmark_queries, document_edges, document_nodes, star_edges, star_nodes, table

QUERIES, SQL = {}, {}


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _bm25_sql(limit: int, kinds: str = "") -> str:
    fields = " UNION ALL ".join(f"SELECT id, {w}::DOUBLE AS w, unnest({SQL_TOKENS.format(f)}) AS term FROM dn" for f, w in search.FIELD_WEIGHTS.items())
    return rf"""{SQL_DOCUMENT_NODES},
ix AS (SELECT id, term, sum(w) AS tf, count(*) AS n FROM ({fields}) GROUP BY ALL),
sz AS (SELECT id, sum(n) AS dl FROM ix GROUP BY 1),
tot AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM sz),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({SQL_TOKENS.format('text')}) AS prefix FROM benchmark),
q AS (SELECT * FROM qt WHERE NOT (length(prefix) = 1 AND ascii(prefix) < 128)),
voc AS (SELECT term, unnest(list_transform(range(1, length(term) + 1), lambda k: left(term, k))) AS prefix FROM (SELECT DISTINCT term FROM ix)),
m AS (SELECT DISTINCT term, prefix FROM voc WHERE prefix IN (SELECT prefix FROM q)),
f AS (SELECT prefix, id, sum(tf) AS tf FROM ix JOIN m USING (term) GROUP BY ALL),
dfs AS (SELECT prefix, count(*) AS df FROM f GROUP BY 1),
hits AS (
  SELECT query_id, id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), {search.LEAST_IDF}) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))), 6) AS score
  FROM f JOIN dfs USING (prefix) JOIN sz USING (id) CROSS JOIN tot JOIN q USING (prefix) {kinds} GROUP BY ALL),
top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM hits QUALIFY rank < {limit})"""


SQL_SIGNALS = rf"""
sg AS (SELECT target, count(*) FILTER (kind = 'calls' AND provenance = 'resolved') AS callers, count(*) FILTER (kind = 'exemplifies') AS examples,
              count(*) FILTER (kind = 'tests') AS tests FROM de GROUP BY 1),
ex AS (
  SELECT query_id, top.id, rank AS fts_rank, {search.RANK_WEIGHT}::DOUBLE / (1 + rank) AS s_rank,
         CASE kind WHEN 'class' THEN 1.0 WHEN 'function' THEN 1.0 WHEN 'method' THEN 0.9 WHEN 'module' THEN 0.0 ELSE 0.5 END::DOUBLE AS s_kind,
         CASE WHEN is_exported AND kind NOT IN ('module', 'package', 'namespace') THEN 1.0 ELSE 0.0 END::DOUBLE AS s_exported,
         0.3::DOUBLE * ln(1 + coalesce(callers, 0)) AS s_callers,
         CASE WHEN coalesce(examples, 0) > 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS s_examples, CASE WHEN coalesce(tests, 0) > 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS s_tests
  FROM top JOIN dn ON dn.id = top.id LEFT JOIN sg ON sg.target = top.id),
rr AS (SELECT *, round(s_rank + s_kind + s_exported + s_callers + s_examples + s_tests, 6) AS signal_score FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY signal_score DESC, fts_rank, id) - 1 AS rank FROM rr QUALIFY rank < 20)"""


@query(f"WITH {_bm25_sql(20)} SELECT query_id, id, score, rank FROM top")
def search_bm25(spark, sf_dir):
    return search.bm25(document_nodes(spark, sf_dir), benchmark_queries(spark, sf_dir), 20)


@query("WITH " + _bm25_sql(20, "JOIN (SELECT id FROM dn WHERE kind IN ('class', 'module')) USING (id)") + " SELECT query_id, id, score, rank FROM top")
def search_kind_filtered(spark, sf_dir):
    return search.bm25(document_nodes(spark, sf_dir), benchmark_queries(spark, sf_dir), 20, ["class", "module"])


@query(rf"""WITH {SQL_DOCUMENT_NODES},
tk AS MATERIALIZED ({" UNION ALL ".join(f"SELECT id, {k} AS field, {w}::DOUBLE AS w, {SQL_TOKENS.format(f)} AS t FROM dn" for k, (f, w) in enumerate(search.FIELD_WEIGHTS.items()))}),
sz AS MATERIALIZED (SELECT id, sum(len(t)) AS dl FROM tk GROUP BY 1 HAVING dl > 0),
tot AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM sz),
pr AS MATERIALIZED (SELECT id, w, t[i] AS a, t[i + 1] AS b FROM (SELECT id, w, t, unnest(range(1, len(t))) AS i FROM tk)),
q AS MATERIALIZED (
  SELECT DISTINCT item_id AS query_id, string_split(x, '_')[1] AS a, string_split(x, '_')[2] AS b FROM (
    SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+ [\p{{L}}\p{{N}}]+')) AS y, replace(y, ' ', '_') AS x FROM benchmark)),
f AS MATERIALIZED (SELECT q.a, q.b, id, sum(w) AS tf FROM (SELECT DISTINCT a, b FROM q) q JOIN pr ON pr.a = q.a AND starts_with(pr.b, q.b) GROUP BY ALL),
dfs AS (SELECT a, b, count(*) AS df FROM f GROUP BY ALL),
hits AS (
  SELECT query_id, id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), {search.LEAST_IDF}) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))), 6) AS score
  FROM f JOIN dfs USING (a, b) JOIN sz USING (id) CROSS JOIN tot JOIN q USING (a, b) GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM hits QUALIFY rank < 20""")
def search_phrases(spark, sf_dir):
    """Each benchmark passage as a query of pairs of neighbouring words, joined by _."""
    pairs = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+ [\p{L}\p{N}]+"), F.lit(0))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.transform(pairs, lambda x: F.replace(x, F.lit(" "), F.lit("_"))), " ").alias("text"))
    return search.bm25(document_nodes(spark, sf_dir), asked, 20)


@query(f"WITH {_bm25_sql(60)}, {SQL_SIGNALS} SELECT query_id, id, fts_rank, signal_score, rank FROM rk")
def rerank(spark, sf_dir):
    nodes = document_nodes(spark, sf_dir)
    out = search.search(nodes, document_edges(spark, sf_dir), benchmark_queries(spark, sf_dir), 20)
    return out.select("query_id", "id", "fts_rank", "signal_score", "rank")


@query(f"WITH {_bm25_sql(60)}, {SQL_SIGNALS} SELECT query_id, id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("s_rank", "s_kind", "s_exported", "s_callers", "s_examples", "s_tests")) + " FROM rk")
def rank_explain(spark, sf_dir):
    out = search.search(document_nodes(spark, sf_dir), document_edges(spark, sf_dir), benchmark_queries(spark, sf_dir), 20)
    return out.select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("s_rank", "s_kind", "s_exported", "s_callers", "s_examples", "s_tests")])


@query("""WITH q AS (SELECT s_suppkey AS query_id, lower(left(p_name, 4)) || '%' || lower(right(p_type, 3)) AS text FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT query_id, 'p' || p_partkey AS id, p_name || ' ' || p_type AS qualname, row_number() OVER (PARTITION BY query_id ORDER BY p_name || ' ' || p_type, 'p' || p_partkey) - 1 AS rank
FROM part JOIN q ON p_name ILIKE '%' || text || '%' OR p_name || ' ' || p_type ILIKE '%' || text || '%' OR p_type ILIKE '%' || text || '%' QUALIFY rank < 10""")
def search_like(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    nodes = parts.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("qualname"), F.col("p_type").alias("summary"))
    text = F.concat(F.lower(F.left("p_name", F.lit(4))), F.lit("%"), F.lower(F.right("p_type", F.lit(3))))
    asked = table(spark, sf_dir, "supplier").join(parts, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), text.alias("text"))
    return search.contains(nodes, asked, 10)


@query(f"WITH {SQL_STAR} SELECT target, count(*) AS n FROM se WHERE kind = 'calls' GROUP BY 1")
def edge_counts(spark, sf_dir):
    return search.edge_counts(star_edges(spark, sf_dir), "calls")


@query(f"WITH {SQL_STAR} SELECT target, count(*) AS n FROM se WHERE kind = 'calls' AND provenance = 'resolved' GROUP BY 1")
def resolved_callers(spark, sf_dir):
    return search.edge_counts(star_edges(spark, sf_dir), "calls", "resolved")


@query(f"WITH {SQL_STAR} SELECT name AS qualname, arg_min(id, (CASE kind WHEN 'package' THEN 0 WHEN 'module' THEN 1 WHEN 'class' THEN 3 WHEN 'function' THEN 4 WHEN 'method' THEN 4 END, id)) AS id FROM sn GROUP BY 1")
def best_node(spark, sf_dir):
    return graph.best_node(star_nodes(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT array_to_string(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), '.') AS name FROM pages),
s AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS scope FROM pages),
p AS (SELECT name, unnest(list_transform(range(1, len(string_split(name, '.')) + 1), lambda k: array_to_string(string_split(name, '.')[1:k], '.'))) AS scope FROM n)
SELECT name, p.scope, row_number() OVER (PARTITION BY name ORDER BY length(p.scope) DESC, p.scope) - 1 AS rank FROM p JOIN s ON s.scope = p.scope QUALIFY rank < 3""")
def scope_match(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("u"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("scope"))
    return graph.scope_match(urls.select(F.array_join(F.split("u", "/"), ".").alias("name")).distinct(), urls, 3).select("name", "scope", "rank")


def _walk_sql(kinds: list[str], limit: int, near="target", far="source") -> str:
    listed = str(kinds)
    return f"""WITH {SQL_STAR}, f AS (
  SELECT {near} AS ref, {far} AS id, min((list_position({listed}, kind), seq, kind, provenance)) AS e FROM se WHERE list_contains({listed}, kind) AND {far} IN (SELECT id FROM sn) GROUP BY ALL)
SELECT ref, id, e[3] AS kind, e[4] AS provenance, row_number() OVER (PARTITION BY ref ORDER BY e[1], e[2], id) - 1 AS rank FROM f QUALIFY rank < {limit}"""


@query(_walk_sql(["calls"], 6))
def walk_callers(spark, sf_dir):
    return graph.walk(star_edges(spark, sf_dir), star_nodes(spark, sf_dir), ["calls"], 6)


@query(_walk_sql(["calls"], 6, "source", "target"))
def walk_callees(spark, sf_dir):
    return graph.walk(star_edges(spark, sf_dir), star_nodes(spark, sf_dir), ["calls"], 6, incoming=False)


@query(_walk_sql(["extends", "implements"], 10))
def walk_implementers(spark, sf_dir):
    return graph.walk(star_edges(spark, sf_dir), star_nodes(spark, sf_dir), ["extends", "implements"], 10)


@query(f"""WITH {SQL_STAR}, f AS (SELECT target AS ref, source AS id, min((seq, kind, provenance)) AS e FROM se WHERE kind <> 'contains' GROUP BY ALL)
SELECT ref, id, e[2] AS kind, e[3] AS provenance, row_number() OVER (PARTITION BY ref ORDER BY e[1], id) - 1 AS rank FROM f QUALIFY rank < 8""")
def references(spark, sf_dir):
    return graph.references(star_edges(spark, sf_dir), star_nodes(spark, sf_dir), 8)


@query(f"""WITH {SQL_STAR}, b AS (SELECT target AS tgt, source AS nxt, kind, min(seq) AS seq, CASE kind WHEN 'calls' THEN 0 ELSE 1 END AS place FROM se WHERE kind IN ('calls', 'extends') GROUP BY ALL),
e1 AS (SELECT sn.id AS seed, nxt AS id, min((place, seq, b.kind)) AS e FROM sn JOIN b ON tgt = id WHERE nxt <> id GROUP BY ALL),
one AS (SELECT seed, id, 1 AS depth, seed AS via, e[3] AS kind, row_number() OVER (PARTITION BY seed ORDER BY e[1], e[2], id) AS ord FROM e1 QUALIFY ord <= 100),
e2 AS (SELECT seed, nxt AS id, min((ord, place, seq, one.id, b.kind)) AS e FROM one JOIN b ON tgt = one.id WHERE nxt <> seed GROUP BY ALL),
two AS (SELECT seed, id, 2 AS depth, e[4] AS via, e[5] AS kind, row_number() OVER (PARTITION BY seed ORDER BY e[1], e[2], e[3], id) AS ord FROM e2 WHERE (seed, id) NOT IN (SELECT (seed, id) FROM one) QUALIFY ord <= 100)
SELECT seed, id, depth::INT AS depth, via, kind FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, ord) <= 100""")
def impact_depth2(spark, sf_dir):
    return graph.impact(star_edges(spark, sf_dir), star_nodes(spark, sf_dir), 2, 100)


@query(f"""WITH {SQL_DOCUMENT_NODES}, s AS (SELECT source AS name, CASE WHEN min(doc_id) % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN min(doc_id) % 2 = 0 THEN 'fresh' END AS freshness FROM documents GROUP BY 1 UNION ALL SELECT 'unread', 'pending', 'fresh'),
c AS (SELECT source AS name, count(*) FILTER (kind = 'module') AS modules, arg_min({{'q': qualname, 's': summary}}, (length(qualname), qualname)) FILTER (kind = 'module' AND coalesce(summary, '') <> '') AS x FROM dn GROUP BY 1)
SELECT name, x.q AS title, x.s AS summary, coalesce(modules, 0) AS modules, CASE WHEN contains(name, 'src1') THEN 'first' WHEN contains(name, 'src') THEN 'any' ELSE 'other' END AS role,
concat_ws('; ', CASE WHEN status <> 'ok' THEN 'source is ' || status END, CASE WHEN coalesce(freshness, 'unknown') <> 'fresh' THEN 'freshness is ' || coalesce(freshness, 'unknown') END, CASE WHEN coalesce(x.s, '') = '' THEN 'no summary' END) AS warnings FROM s LEFT JOIN c USING (name)""")
def package_catalog(spark, sf_dir):
    least = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("k"))
    sources = least.select("name", F.when(F.col("k") % 3 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("k") % 2 == 0, "fresh").alias("freshness")).union(spark.range(1).select(F.lit("unread"), F.lit("pending"), F.lit("fresh")))
    roles = federate.roles(sources.select("name"), spark.createDataFrame([(0, "src1", "first"), (1, "src", "any")], "ord int, fragment string, role string"))
    return graph.package_catalog(graph.package_card(document_nodes(spark, sf_dir)), sources, roles)


@query(f"""WITH {SQL_DOCUMENT_NODES}, c AS (
  SELECT source, count(*) FILTER (kind = 'module') AS modules,
         arg_min({{'q': qualname, 's': summary}}, (length(qualname), qualname)) FILTER (kind = 'module' AND coalesce(summary, '') <> '') AS x FROM dn GROUP BY 1)
SELECT source, x.q AS title, x.s AS summary, modules FROM c""")
def package_card(spark, sf_dir):
    return graph.package_card(document_nodes(spark, sf_dir))


# Orders count as methods of their customers here.
_OUTLINE = f"""WITH {SQL_STAR}, i AS (SELECT source, target, seq FROM se WHERE kind = 'contains'),
m AS (SELECT source, string_agg(target, ',' ORDER BY seq, target) AS listed, count(*) AS n FROM i GROUP BY 1),
o AS (SELECT i.source AS module, string_agg(target, ',' ORDER BY start_line, seq) AS symbols, string_agg(coalesce(listed, ''), ';' ORDER BY start_line, seq) AS members, coalesce(sum(m.n), 0)::BIGINT AS n_members, count(*) AS k
      FROM i JOIN sn ON sn.id = target LEFT JOIN m ON m.source = target WHERE i.source[1] = 'n' GROUP BY 1)"""


def _outlined(spark, sf_dir, path=None):
    nodes = star_nodes(spark, sf_dir).withColumn("kind", F.when(F.col("id").startswith("o"), "method").otherwise(F.col("kind")))
    return graph.outline(nodes, star_edges(spark, sf_dir), path)


@query(_OUTLINE + " SELECT sn.id AS module, symbols, members, coalesce(n_members, 0) AS n_members FROM sn LEFT JOIN o ON o.module = sn.id WHERE kind IN ('module', 'package')")
def outline(spark, sf_dir):
    return _outlined(spark, sf_dir)


@query(_OUTLINE + " SELECT sn.id AS module, symbols, coalesce(n_members, 0) AS n_members FROM sn LEFT JOIN o ON o.module = sn.id WHERE kind IN ('module', 'package') AND (file = '1' OR starts_with(file, '1/'))")
def outline_path(spark, sf_dir):
    return _outlined(spark, sf_dir, "1").select("module", "symbols", "n_members")


@query(_OUTLINE + " SELECT sn.id AS module, array_to_string(string_split(symbols, ',')[1:5], ',') AS symbols, coalesce(k, 0) AS n_symbols FROM sn LEFT JOIN o ON o.module = sn.id WHERE kind IN ('module', 'package')")
def outline_page(spark, sf_dir):
    return graph.first_members(_outlined(spark, sf_dir), 5)


@query(r"""SELECT o_orderpriority AS id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS kind FROM orders GROUP BY 1""")
def dedupe_last(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("kind"))
    return graph.dedupe_last(nodes)


def _lint_nodes(spark, sf_dir):
    nodes = document_nodes(spark, sf_dir)
    short = F.col("doc_id") % 3 == 0
    return nodes.withColumns({"docstring": F.when(~short, F.col("docstring")), "summary": F.when(~short, F.col("summary"))})


def _lint_refs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("file", (F.col("l_partkey") % 50).cast("string"))
    refs = lines.filter("l_returnflag <> 'N' or l_linestatus = 'F'").select("file")
    edges = lines.filter("l_returnflag = 'N'").select("file", F.lit("resolved").alias("provenance"))
    return refs, edges


_LINT = f"""WITH {SQL_DOCUMENT_NODES},
u AS (SELECT id, file, start_line FROM dn WHERE is_exported AND kind <> 'module' AND (doc_id % 3 = 0 OR (coalesce(docstring, '') = '' AND coalesce(summary, '') = ''))),
t AS (SELECT id, file, start_line FROM dn WHERE kind IN ('class', 'function') AND id NOT IN (SELECT target FROM de WHERE kind = 'tests' AND seq % 200 = 7)),
r AS (SELECT (l_partkey % 50)::VARCHAR AS file, count(*) FILTER (l_returnflag <> 'N' OR l_linestatus = 'F') AS unresolved, count(*) FILTER (l_returnflag = 'N') AS resolved FROM lineitem GROUP BY 1),
h AS (SELECT *, round(unresolved / (unresolved + resolved), 6) AS ratio FROM r WHERE unresolved + resolved >= 5 AND unresolved / (unresolved + resolved) > 0.5)"""


@query(_LINT + " SELECT * FROM u")
def lint_undocumented(spark, sf_dir):
    return lint.undocumented(_lint_nodes(spark, sf_dir))


@query(_LINT + " SELECT * FROM t")
def lint_untested(spark, sf_dir):
    return lint.untested(_lint_nodes(spark, sf_dir), document_edges(spark, sf_dir).filter("seq % 200 = 7"))


@query(_LINT + " SELECT * FROM h")
def lint_unresolved(spark, sf_dir):
    return lint.unresolved_files(*_lint_refs(spark, sf_dir))


@query(_LINT + " SELECT 'undocumented' AS \"check\", count(*) AS n FROM u UNION ALL SELECT 'untested', count(*) FROM t UNION ALL SELECT 'unresolved', count(*) FROM h")
def lint_totals(spark, sf_dir):
    refs, resolved = _lint_refs(spark, sf_dir)
    edges = document_edges(spark, sf_dir).filter("kind = 'tests' and seq % 200 = 7").select("target", "kind", F.lit(None).cast("string").alias("file"), F.lit("heuristic").alias("provenance"))
    edges = edges.unionByName(resolved.select(F.lit(None).cast("string").alias("target"), F.lit("calls").alias("kind"), "file", "provenance"))
    return lint.totals(_lint_nodes(spark, sf_dir), edges, refs)
