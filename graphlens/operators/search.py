"""Lexical recall and signal ranking. Every operator takes a table of requests and ranks within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphlens.functions.text import tokens
from graphlens.storage import new_folder, stored

# Weights of the fields, BM25 constants, weights of the ranking signals, priors of node kinds, and kinds that are places to browse.
FIELD_WEIGHTS = {"name": 10.0, "qualname": 5.0, "docstring": 1.0, "summary": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RANK_WEIGHT, EXPORTED, CALLERS, EXAMPLES, TESTS = 1.5, 1.0, 0.3, 0.8, 0.8
KIND_PRIORS = {
    "module": 0.0, "package": 0.0, "namespace": 0.0, "class": 1.0, "struct": 1.0, "interface": 1.0, "trait": 1.0,
    "function": 1.0, "enum": 0.9, "method": 0.9, "property": 0.5, "type_alias": 0.4, "constant": 0.3, "field": 0.3,
}
DEFAULT_PRIOR = 0.5
NAVIGATIONAL = ["module", "package", "namespace"]
#: Words of a query: as those of the index, but _ joins them.
QUERY_TOKEN = r"[\p{L}\p{N}_]+"
#: Rows of a stored table that are broadcast at most: words and phrases of queries.
SMALL_ROWS = 500_000
#: Lengths of beginnings up to this one are written out in the plan, which runs faster than a function over an array.
UNROLLED = 32
#: Texts that ``contains`` broadcasts at once.
ASKED = 10_000


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase, parts: the distinct tokens of each query but single ASCII characters; a token with _ is a phrase of its parts."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(QUERY_TOKEN), F.lit(0)))
    rows = queries.select("query_id", word.alias("word")).filter(~F.col("word").rlike(r"^[\x00-\x7F]$"))
    parts = F.filter(F.split("word", "_"), lambda x: x != "")
    return rows.select("query_id", parts.alias("parts")).filter(F.size("parts") > 0).select("query_id", F.array_join("parts", "_").alias("phrase"), "parts").distinct()


def _tokens_of(field: str) -> Column:
    return tokens(F.coalesce(F.col(field), F.lit("")))


def summed_terms(nodes: DataFrame) -> DataFrame:
    """id, dl (tokens of the node), term, tf (sum of the weights of the fields where it stands), first (1 in one row of each node).

    The texts are dealt by id, which moves less than their terms would, and the terms are then summed up where they are.
    """
    names = [f"_t{k}" for k in range(len(FIELD_WEIGHTS))]
    split = _dealt(nodes, "id", *FIELD_WEIGHTS).select("id", *[_tokens_of(f).alias(n) for f, n in zip(FIELD_WEIGHTS, names)])
    filled = F.coalesce(*[F.when(F.size(n) > 0, F.lit(k)) for k, n in enumerate(names)])
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(w).alias("w"), F.col(n).alias("tokens")) for k, (n, w) in enumerate(zip(names, FIELD_WEIGHTS.values()))]))
    rows = split.select("id", sum((F.size(n) for n in names), F.lit(0)).cast("long").alias("dl"), filled.alias("filled"), fields.alias("f"))
    one = rows.select("id", "dl", (F.col("f.at") == F.col("filled")).alias("filled"), "f.w", F.posexplode("f.tokens").alias("at", "term"))
    return one.groupBy("id", "term").agg(F.max("dl").alias("dl"), F.sum("w").alias("tf"), F.count_if(F.col("filled") & (F.col("at") == 0)).alias("first"))


def postings(nodes: DataFrame) -> DataFrame:
    """``summed_terms``, stored, for nodes that several searches read."""
    return stored(summed_terms(nodes), "postings")


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Some columns, by id; with a fixed number of tasks, as texts cost more than their bytes tell."""
    return rows.select(*columns).repartition(3 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table with a broadcast hint, if it has ``rows`` rows at most; larger ones are left to the optimiser's joins."""
    return F.broadcast(df) if df.count() <= rows else df


def _beginnings(rows: DataFrame, term: str, prefixes: DataFrame) -> DataFrame:
    """Adds ``k`` and ``prefix``: the beginnings of each row's term of the lengths that ``prefixes`` have; one row with nulls without any."""
    lengths = sorted(prefixes.agg(F.collect_set(F.length("prefix"))).first()[0])  # as many numbers as the longest prefix has letters, at most
    starts = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.length(term) >= n, F.left(F.col(term), F.lit(n))) for n in lengths if n <= UNROLLED]))
    longer = [n for n in lengths if n > UNROLLED]
    if longer:
        more = F.filter(F.array(*map(F.lit, longer)), lambda n: n <= F.length(term))
        starts = F.concat(starts, F.transform(more, lambda n: F.left(F.col(term), n)))
    return rows.select("*", F.posexplode_outer(starts).alias("k", "prefix"))


def word_matches(terms: DataFrame, words: DataFrame) -> DataFrame:
    """id, dl, first, phrase, tf: the words that each term of a node begins with, and a row without a phrase for the first term of each.

    The terms stay where they are: the words asked for are few beside the terms that they are completed to.
    """
    asked = small(stored(words.select("phrase", F.col("phrase").alias("prefix")), "words"))
    rows = _beginnings(terms, "term", asked).join(asked, "prefix", "left").withColumn("first", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("first")).otherwise(0))
    return rows.filter("phrase is not null or first > 0").select("id", "dl", "first", "phrase", "tf")


def phrase_matches(nodes: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, phrase, tf: nodes in one field of which the parts of a phrase stand side by side, the last as a beginning of a word.

    Every run of as many tokens as a phrase has parts is compared as a whole, its last token by its beginnings, so that frequent words
    give no rows of their own.
    """
    last = F.element_at("parts", -1)
    head = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "_")
    wanted = small(stored(phrases.select("phrase", F.size("parts").alias("n"), head.alias("head"), last.alias("prefix")), "phrase-parts"))
    sizes = F.broadcast(wanted.agg(F.array_sort(F.collect_set("n")).alias("sizes")))  # one row, of as many numbers as the longest phrase has parts
    fields = F.array(*[F.struct(F.lit(w).alias("w"), _tokens_of(f).alias("tokens")) for f, w in FIELD_WEIGHTS.items()])
    rows = _dealt(nodes, "id", *FIELD_WEIGHTS).select("id", F.explode(fields).alias("f")).select("id", "f.w", "f.tokens").crossJoin(sizes)

    def runs(n: Column) -> Column:
        at = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - n + 1))
        return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.struct(n.alias("n"), F.array_join(F.slice("tokens", i, n - 1), "_").alias("head"), F.get("tokens", i + n - 2).alias("last")))

    run = rows.select("id", "w", F.explode(F.flatten(F.transform("sizes", runs))).alias("r")).select("id", "w", "r.n", "r.head", "r.last")
    run = run.join(F.broadcast(wanted.select("n", "head").distinct()) if wanted.count() <= SMALL_ROWS else wanted.select("n", "head").distinct(), ["n", "head"], "left_semi")
    return _beginnings(run, "last", wanted).join(wanted, ["n", "head", "prefix"]).groupBy("id", "phrase").agg(F.sum("w").alias("tf"))


def bm25(nodes: DataFrame, queries: DataFrame, limit: int, kinds: list[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank (from 0) of the best ``limit`` nodes of each query.

    A query token matches the words that it begins; one with _ matches its parts side by side, the last as a beginning. A node's matches
    are one row, and its scores are summed up where that row is; nodes are split into tokens again only where phrases are asked for.
    ``index``: the ``postings`` of the nodes, if there are any. ``kinds`` filter before the scoring, and so before the limit;
    frequencies are of all nodes.
    """
    terms = summed_terms(nodes) if index is None else index
    asked = stored(query_phrases(queries), "phrases")
    phrases = asked.select("phrase", "parts").distinct()
    words = phrases.filter(F.size("parts") == 1).select("phrase")
    matched = word_matches(terms, words).groupBy("id", "phrase").agg(F.max("dl").alias("dl"), F.sum("first").alias("first"), F.sum("tf").alias("tf"))
    several = phrases.filter(F.size("parts") > 1)
    if not several.isEmpty():
        matched = matched.unionByName(phrase_matches(nodes, several), allowMissingColumns=True)
    hit = F.when(F.col("phrase").isNotNull(), F.struct("phrase", "tf"))
    found = stored(matched.groupBy("id").agg(F.max("dl").alias("dl"), F.sum("first").alias("first"), F.collect_list(hit).alias("hits")), "matches")  # a node's phrases
    totals = found.agg(F.sum("first").alias("docs"), (F.sum(F.col("first") * F.col("dl")) / F.sum("first")).alias("avgdl"))
    df = found.select(F.explode("hits.phrase").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weights = small(stored(asked.select("query_id", "phrase").join(df, "phrase").crossJoin(F.broadcast(totals)).select("query_id", "phrase", idf.alias("idf"), "avgdl"), "weights"))  # one row of totals
    able = found if kinds is None else found.join(nodes.filter(F.col("kind").isin(kinds)).select("id"), "id", "left_semi")
    each = _dealt(able.filter(F.size("hits") > 0), "id", "dl", "hits").select("id", "dl", F.explode("hits").alias("h")).select("id", "dl", "h.phrase", "h.tf")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = each.join(weights, "phrase").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return best(hits, ["query_id"], [F.desc("score"), F.col("id")], limit)


def best(rows: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank`` from 0; each task cuts its own rows to the limit before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


def contains(nodes: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Fallback for queries without lexical hits: name, qualname or summary holds the text (% and _ are wildcards), by qualname.

    Wildcards leave no key to join on, so the distinct texts are broadcast to the distinct names, ``ASKED`` at a time; each block's hits
    are written before the next, so that the plan doesn't grow with the texts. Nodes of the same names are cut to the limit before and
    the hits of a text after its names are compared, so that queries of one text share its first ``limit`` nodes.
    """
    texts = stored(queries.select("text").distinct().withColumn("number", F.monotonically_increasing_id()), "asked")
    order = F.row_number().over(W.partitionBy(F.shiftright("number", 33)).orderBy("number")) - 1  # within a partition
    texts = stored(texts.select("text", F.shiftright("number", 33).alias("part"), F.floor(order / ASKED).alias("block")), "asked")
    like = F.expr(" or ".join(f"coalesce({f} ilike concat('%', text, '%'), false)" for f in ("name", "qualname", "summary")))
    names = ["name", "qualname", "summary"]
    rows = stored(best(nodes.select("id", *names), names, [F.col("id")], limit).drop("rank"), "named")
    hits = rows.select("id", "qualname", F.lit("").alias("text")).limit(0)
    path = new_folder(nodes.sparkSession, "contains")
    blocks = texts.select("part", "block").distinct().collect()  # a row for every ASKED texts and partition
    for r in blocks:
        own = F.broadcast(texts.filter((F.col("part") == r.part) & (F.col("block") == r.block)).select("text"))
        found = rows.join(own, like).select("id", "qualname", "text")
        best(found, ["text"], [F.col("qualname"), F.col("id")], limit).drop("rank").write.mode("append").parquet(path)
    hits = nodes.sparkSession.read.schema(hits.schema).parquet(path) if blocks else hits
    return best(hits.join(queries, "text").select("query_id", "id", "qualname"), ["query_id"], [F.col("qualname"), F.col("id")], limit)


def edge_counts(edges: DataFrame, kind: str, provenance: str | None = None) -> DataFrame:
    """target, n: incoming edges of a kind; targets without any are absent."""
    own = edges.filter(F.col("kind") == kind)
    return (own if provenance is None else own.filter(F.col("provenance") == provenance)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def signals(edges: DataFrame) -> DataFrame:
    """target, callers (resolved), examples and tests of any provenance, in one pass."""
    kind = F.col("kind")
    return edges.filter(kind.isin("calls", "exemplifies", "tests")).groupBy("target").agg(
        F.count_if((kind == "calls") & (F.col("provenance") == "resolved")).alias("callers"),
        F.count_if(kind == "exemplifies").alias("examples"),
        F.count_if(kind == "tests").alias("tests"),
    )


def explained(ranked: DataFrame) -> DataFrame:
    """Adds what each signal gives: of rank, kind, exported, callers, examples, tests."""
    zero = F.lit(0.0)
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KIND_PRIORS.items() for x in p]), F.col("kind")), F.lit(DEFAULT_PRIOR))
    return ranked.withColumns({
        "s_rank": RANK_WEIGHT / (1 + F.col("rank")),
        "s_kind": prior,
        "s_exported": F.when(F.col("is_exported") & ~F.col("kind").isin(NAVIGATIONAL), F.lit(EXPORTED)).otherwise(zero),
        "s_callers": CALLERS * F.log1p(F.coalesce("callers", F.lit(0))),
        "s_examples": F.when(F.coalesce("examples", F.lit(0)) > 0, F.lit(EXAMPLES)).otherwise(zero),
        "s_tests": F.when(F.coalesce("tests", F.lit(0)) > 0, F.lit(TESTS)).otherwise(zero),
    })


def rerank(recalled: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The recalled nodes of each query by lexical rank and graph signals, stable, the best ``limit``; only edges to recalled nodes are counted."""
    ids = recalled.select("id").distinct()
    told = signals(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    rows = recalled.join(nodes.select("id", "kind", "is_exported"), "id").join(told, F.col("id") == F.col("target"), "left")
    total = sum((F.col(c) for c in ("s_kind", "s_exported", "s_callers", "s_examples", "s_tests")), F.col("s_rank"))
    scored = explained(rows).withColumn("signal_score", F.round(total, 6)).withColumnRenamed("rank", "fts_rank")
    return best(scored, ["query_id"], [F.desc("signal_score"), F.col("fts_rank"), F.col("id")], limit)


def recall(nodes: DataFrame, queries: DataFrame, limit: int, kinds: list[str] | None = None) -> DataFrame:
    """query_id, id, rank: lexical hits, and for queries without any the nodes that contain their text."""
    hits = stored(bm25(nodes, queries, limit, kinds).select("query_id", "id", "rank"), "recall")
    rest = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    able = nodes if kinds is None else nodes.filter(F.col("kind").isin(kinds))
    return stored(hits.unionByName(contains(able, rest, limit).select("query_id", "id", "rank")), "recall")


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, limit: int, oversample: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """Recall of ``oversample`` times the limit, then the ranking by signals."""
    return rerank(recall(nodes, queries, oversample * limit, kinds), nodes, edges, limit)
