"""Column functions over paths, names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# Languages by file extension, and the suffixes, names and prefixes of run artifacts.
LANGUAGES = {"py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "md": "markdown", "json": "json", "toml": "toml", "html": "html"}


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def folded(text: Column) -> Column:
    """Text for comparisons without case: lower-cased, ß as ss and a final sigma as any other."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped; null without one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(lines, F.lit(0))


def first_prose_line(text: Column) -> Column:
    """The first line of Markdown that isn't blank once marks of quotes, lists, emphasis and rules are stripped from its beginning; null without one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[>*_\-\s]+", ""))), lambda x: x != "")
    return F.get(lines, F.lit(0))


def path_language(path: Column) -> Column:
    """Language by the path's extension, whatever its case; null where unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension)


def path_qualname(path: Column) -> Column:
    """Dotted name of a module's path, without its suffix, a leading src and a final __init__."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"(^|/)__init__$", ""), r"^/*(src/)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r"/+", ".")


def _parts(path: Column, suffix: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), suffix, ""), "/"), lambda x: x != "")


def script_qualname(path: Column) -> Column:
    """Dotted name of a TypeScript or JavaScript path, without a leading src and a final index; (root) where nothing is left."""
    parts = _parts(path, r"\.([cm]?[jt]sx?)$")
    parts = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    parts = F.when(F.try_element_at(parts, F.lit(-1)) == "index", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(F.nullif(F.array_join(parts, "."), F.lit("")), F.lit("(root)"))


def crate_qualname(path: Column) -> Column:
    """Name of a Rust path with ::, from the folder above its last src on and without a final lib, main or mod; (crate) where nothing is left."""
    parts = _parts(path, r"\.rs$")
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x == "src", i)))
    above = F.when(last > 0, F.slice(parts, last, F.lit(1))).otherwise(F.slice(parts, F.lit(1), F.lit(0)))
    parts = F.when(last.isNotNull(), F.concat(above, F.slice(parts, last + 2, F.size(parts)))).otherwise(parts)
    parts = F.when(F.try_element_at(parts, F.lit(-1)).isin("lib", "main", "mod"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(F.nullif(F.array_join(parts, "::"), F.lit("")), F.lit("(crate)"))


def is_test_path(path: Column) -> Column:
    """conftest, test_*, *_test.py, or a test or tests folder."""
    return path.rlike(r"(^|/)(tests?/|conftest\.py$|test_[^/]*$|[^/]*_test\.py$)")


def slug(text: Column) -> Column:
    """Lower case with runs of other characters as one dash; ``default`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("default"))


def capped(text: Column, limit: int, suffix: str = "…") -> Column:
    """At most ``limit`` characters, and ``suffix`` where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(text)


def prefixes(parts: Column, separator: str) -> Column:
    """All leading joins of an array of parts, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
