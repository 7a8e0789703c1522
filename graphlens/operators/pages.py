"""Markdown pages of many requests at once: one row a page, each of bounded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the pages say, and how many results and symbols they show.
SEARCH_NOTE = "Index helper. Open exact refs with `open` before coding."
OUTLINE_NOTE = "Module directory. Read summaries, then `open` exact refs."
SYMBOLS_NOTE = "Exported symbols (sample):"
SUGGEST_HEAD = "# Suggest (optional shortcut)"
PACKAGES_NOTE = "Read each summary and choose sources yourself.\nThis is a directory page, not a ranking."
NO_MODULE_SUMMARY, NO_PACKAGE_SUMMARY, NO_SUMMARY = "*(no module summary)*", "*(no package summary in index)*", "*(no summary)*"
NO_EXAMPLES, NO_TESTS = "*(no example nodes in index — trust signature + summary only)*", "*(no test nodes linked)*"
RESULTS, SYMBOLS, LISTED = 30, 15, 5


def _told(text: Column) -> Column:
    """A value as it is shown, None where there is none."""
    return F.coalesce(text.cast("string"), F.lit("None"))


def _flag(x: Column) -> Column:
    return F.when(x.isNull(), "None").when(x, "True").otherwise("False")


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _in_order(rows: DataFrame, key: str, order: str, text: Column, name: str) -> DataFrame:
    """key and the texts of its rows as an array, in order; callers bound the rows of a key."""
    item = F.struct(order, text.alias("_text"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_text"]).alias(name))


def _closed(head: Column, parts: Column) -> Column:
    """A page of a head and parts, a line each, with one line end."""
    whole = F.concat(head, F.array_join(F.coalesce(parts, F.array().cast("array<string>")), "\n"))
    return F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n"))


def search_pages(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, markdown: the first results of each query (query_id, text). ``hits``: query_id, rank from 0, title, kind, source, executable, summary, ref."""
    own = F.concat(F.lit("- `"), _told(F.col("title")), F.lit("` ("), _told(F.col("kind")), F.lit(") source=`"), _told(F.col("source")), F.lit("` exec=`"), _flag(F.col("executable")), F.lit("`"))
    line = F.concat_ws("\n", own, F.concat(F.lit("  "), _given(F.col("summary"))), F.concat(F.lit("  ref: `"), _given(F.col("ref")), F.lit("`")))
    lines = _in_order(hits.filter(F.col("rank") < RESULTS), "query_id", "rank", line, "lines")
    head = F.concat(F.lit("# Search `"), "text", F.lit(f"`\n\n{SEARCH_NOTE}\n\n"))
    return queries.join(lines, "query_id", "left").select("query_id", _closed(head, F.col("lines")).alias("markdown"))


def suggest_pages(guide: DataFrame) -> DataFrame:
    """task_id, markdown: the checklist of each task (see ``context.routing_guide``) and its warnings."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.split("prefer", ","), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    prefer = F.when(F.col("prefer") == "", "[]").otherwise(listed)
    line = F.concat(F.lit("- **"), "role", F.lit("**: "), "when", F.lit(" → prefer "), prefer, F.lit(" (available="), _flag(F.col("available")), F.lit(")"))
    rows = _in_order(guide, "task_id", "ord", line, "lines").join(_in_order(guide.filter("warning is not null"), "task_id", "ord", F.concat(F.lit("- warning: "), "warning"), "warnings"), "task_id", "left")
    told = F.concat("lines", F.coalesce("warnings", F.array().cast("array<string>")))
    return rows.select("task_id", F.concat(F.lit(f"{SUGGEST_HEAD}\n\n"), F.array_join(told, "\n"), F.lit("\n")).alias("markdown"))


def outline_pages(outlines: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """page, markdown of each outline (page, source, path). ``modules``: page, ord, qualname, kind, summary, as many as a page holds;
    ``symbols``: page, ord (of the module), place, qualname, kind, signature, summary, of which the first SYMBOLS are shown."""
    dash = F.concat(F.lit("— "), _given(F.col("summary")))
    sample = F.rtrim(F.concat(F.lit("- `"), "qualname", F.lit("` ("), "kind", F.lit(") "), F.coalesce("signature", F.lit("")), F.lit(" "), F.coalesce(dash, F.lit(""))))
    both = F.struct("page", "ord").alias("at")
    tops = _in_order(symbols.filter(F.col("place") < SYMBOLS).select(both, "place", sample.alias("line")), "at", "place", F.col("line"), "lines")
    rows = modules.select("page", "ord", both, "qualname", "kind", "summary").join(tops, "at", "left")
    shown = F.concat(F.lit(f"\n\n{SYMBOLS_NOTE}\n"), F.array_join("lines", "\n"))
    part = F.concat(F.lit("## `"), "qualname", F.lit("` ("), "kind", F.lit(")\n"), F.coalesce(_given(F.col("summary")), F.lit(NO_MODULE_SUMMARY)), F.coalesce(shown, F.lit("")), F.lit("\n"))
    head = F.concat(F.lit("# Outline: "), "source", F.coalesce(F.concat(F.lit(" / "), _given(F.col("path"))), F.lit("")), F.lit(f"\n\n{OUTLINE_NOTE}\n\n"))
    return outlines.join(_in_order(rows, "page", "ord", part, "parts"), "page", "left").select("page", _closed(head, F.col("parts")).alias("markdown"))


def package_entries(cards: DataFrame) -> DataFrame:
    """name, markdown: a card's entry on the packages page, which is a heading, PACKAGES_NOTE and the entries by name. ``cards``: name, status, role, spec, freshness, modules, error, summary."""
    lines = [
        F.concat(F.lit("## "), "name", F.lit("  `"), _told(F.col("status")), F.lit("`")),
        F.concat(F.lit("- role_hint: `"), _given(F.col("role")), F.lit("`")),
        F.concat(F.lit("- spec: `"), _told(F.col("spec")), F.lit("`")),
        F.concat(F.lit("- freshness: `"), _told(F.col("freshness")), F.lit("`")),
        F.concat(F.lit("- modules indexed: "), F.col("modules").cast("string")),
        F.concat(F.lit("- error: "), _given(F.col("error"))),
        F.concat(F.lit("\n"), F.coalesce(_given(F.col("summary")), F.lit(NO_PACKAGE_SUMMARY)), F.lit("\n")),
    ]
    return cards.select("name", F.concat_ws("\n", *lines).alias("markdown"))


def detail_pages(details: DataFrame) -> DataFrame:
    """ref, markdown: the short page of a symbol (ref, qualname, title, signature, summary, docstring)."""
    name = F.coalesce(_given(F.col("qualname")), _given(F.col("title")), "ref")
    text = F.coalesce(_given(F.col("summary")), _given(F.col("docstring")), F.lit(""))
    return details.select("ref", F.concat(F.lit("## `"), name, F.lit("`\n\nsignature: `"), _told(F.col("signature")), F.lit("`\n\n"), text, F.lit("\n")).alias("markdown"))


def symbol_pages(described: DataFrame) -> DataFrame:
    """ref, markdown: the whole page of a symbol (ref, qualname, signature, executable, summary, docstring, examples, tests: arrays of (qualname, summary))."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")

    def listed(c: str, line, none: str) -> Column:
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(F.transform(F.slice(c, 1, LISTED), line), "\n")).otherwise(none)

    examples = listed("examples", lambda x: F.concat(F.lit("- `"), x["qualname"], F.lit("`: "), F.coalesce(x["summary"], F.lit(""))), NO_EXAMPLES)
    tests = listed("tests", lambda x: F.concat(F.lit("- `"), x["qualname"], F.lit("`")), NO_TESTS)
    summary = F.coalesce(_given(F.col("summary")), _given(F.col("docstring")), F.lit(NO_SUMMARY))
    parts = [
        F.concat(F.lit("# Open `"), "ref", F.lit("`\n")),
        F.concat(F.lit("- qualname: `"), _told(F.col("qualname")), F.lit("`")),
        F.concat(F.lit("- signature: `"), _told(F.col("signature")), F.lit("`")),
        F.concat(F.lit("- executable: `"), _flag(F.col("executable")), F.lit("`")),
        F.concat(F.lit("- coverage: examples="), size("examples"), F.lit(" tests="), size("tests"), F.lit("\n")),
        F.concat(F.lit("## Summary\n\n"), summary, F.lit("\n")),
        F.concat(F.lit("## Examples\n\n"), examples, F.lit("\n")),
        F.concat(F.lit("## Tests\n\n"), tests, F.lit("\n")),
    ]
    return described.select("ref", F.concat_ws("\n", *parts).alias("markdown"))
