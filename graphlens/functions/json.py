"""Canonical JSON: keys in order, no white space, numbers and strings as Python's ``json.dumps`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.storage import stored




def quoted(text: Column, ascii_only: bool = False) -> Column:
    """A string as JSON; with ``ascii_only`` other characters as \\u and four hexadecimal digits, in pairs beyond 16 bits."""
    units = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c).cast("long")
        pair = F.concat(units(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), units(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        short = F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f")
        short = short.when(n < 32, units(n))
        return (short.when(n > 0xFFFF, pair).when(n > 126, F.when(n == 127, c).otherwise(units(n))) if ascii_only else short).otherwise(c)

    special = r'(?s).*[\x00-\x1f"\\' + (r"\x{80}-\x{10ffff}].*" if ascii_only else "].*")
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.concat(F.lit('"'), F.when(text.rlike(special), F.array_join(F.transform(letters, one), "")).otherwise(text), F.lit('"'))


def number(value: Column) -> Column:
    """A double as Python writes it: the shortest digits that tell it, plain from 1e-4 to below 1e16."""
    text = value.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)", 1), r"\.0$", ""), r"\.", "")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(F.rpad(digits, power + 1, F.lit("0")).substr(F.lit(1), power + 1), F.lit("."), F.when(F.length(digits) > power + 1, digits.substr(power + 2, F.length(digits))).otherwise("0"))
    tail = F.concat(F.when(F.length(digits) > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), digits.substr(F.lit(2), F.length(digits)))).otherwise(digits), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    named = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity")
    return named.when(power.isNull(), text).otherwise(F.concat(sign, F.when((power < 0) & (power >= -4), small).when((power >= 0) & (power < 16), large).otherwise(tail)))


def canonical(value: Column, kind: T.DataType, ascii_only: bool = False) -> Column:
    """JSON of a column of a declared type: structs and maps with their keys in order, arrays in theirs, nulls as null."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(quoted(F.lit(f.name), ascii_only), F.lit(":"), canonical(value[f.name], f.dataType, ascii_only)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, ascii_only)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.cast("string").alias("k"), k.alias("key"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["k"], ascii_only), F.lit(":"), canonical(value[e["key"]], kind.valueType, ascii_only))), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        out = value.cast("string")
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        out = quoted(value.cast("string"), ascii_only)
    return F.coalesce(out, F.lit("null"))


def canonical_text(rows: DataFrame, key: str, text: str, ascii_only: bool = False) -> DataFrame:
    """``key`` and ``canonical`` of JSON texts of any shape; null where a text isn't JSON.

    Values are exploded level by level, each with its place, until none holds others; then the levels are put together again from the
    innermost out. ``key`` is unique. A level costs one join by place, so its rows spread over all tasks however large a text is; the
    join's kind is fixed, as the optimiser takes a level for a hundredth of its size once its variants are left out, and would broadcast it.
    """
    # Texts cost far more than their bytes tell, so they are dealt to all tasks; only containers go down to the next level.
    shape = F.schema_of_variant("_v")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").alias("_kind")
    dealt = rows.select(key, text).repartition(3 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    level = dealt.select(F.col(key).alias("_key"), F.lit("").alias("_at"), F.lit(None).cast("string").alias("_name"), F.lit(0).alias("_pos"), F.try_parse_json(F.col(text)).alias("_v"))
    levels = []
    while True:
        level = stored(level.select("*", kind), "json")
        levels.append(level)
        inner = level.filter("_kind is not null")
        if inner.isEmpty():
            break
        parts = inner.select("_key", F.concat("_at", F.lit("/"), "_pos").alias("_at"), "_v").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        level = parts.select("_key", "_at", F.col("key").alias("_name"), F.col("pos").alias("_pos"), F.col("value").alias("_v"))
    built = None
    for level in reversed(levels):
        shape = F.schema_of_variant("_v")
        whole = shape.isin("BIGINT", "BOOLEAN") | (shape.rlike(r"^DECIMAL\(\d+,0\)$") & (F.abs(F.try_variant_get("_v", "$", "double")) >= 2.0**63))
        plain = F.when(F.is_variant_null("_v"), F.lit("null")).when(shape == "STRING", quoted(F.try_variant_get("_v", "$", "string"), ascii_only)).when(whole, F.try_variant_get("_v", "$", "string")).otherwise(number(F.try_variant_get("_v", "$", "double")))
        told = level.select("_key", "_at", "_name", "_pos", "_kind", F.when(F.col("_kind").isNull(), plain).alias("_plain"))
        if built is not None:
            told = told.withColumn("_own", F.concat("_at", F.lit("/"), "_pos")).join(built.select("_key", F.col("_at").alias("_own"), "_inner").hint("merge"), ["_key", "_own"], "left").drop("_own")
        else:
            told = told.withColumn("_inner", F.lit(None).cast("string"))
        inner = F.coalesce("_inner", F.lit(""))
        value = F.when(F.col("_kind") == "object", F.concat(F.lit("{"), inner, F.lit("}"))).when(F.col("_kind") == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("_plain"))
        item = F.struct(F.coalesce("_name", F.lit("")).alias("name"), "_pos", F.when(F.col("_name").isNull(), value).otherwise(F.concat(quoted(F.col("_name"), ascii_only), F.lit(":"), value)).alias("text"))
        built = told.groupBy("_key", "_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), ",").alias("_inner"))  # one text's parts
    whole = built.select(F.col("_key").alias(key), F.col("_inner").alias("canonical")).hint("merge")
    return whole.join(rows.select(key), key, "right").withColumn("canonical", F.nullif("canonical", F.lit("")))
