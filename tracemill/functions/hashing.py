"""Canonical hashes, fingerprints and signatures.

The JSON is that of Python's json module with sorted keys and non-ASCII characters as they are, byte for byte, so
hashes made elsewhere with it can be compared with those made here.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    MapType,
    StringType,
    StructType,
)

#: Escapes with a letter; other control characters are written as \\u00xx.
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def json_string(text: Column) -> Column:
    """A string as JSON, in one pass; only one with control characters that have no letter, or that isn't UTF-8, goes through all escapes one by one."""
    rare = text
    for c in (*(c for c in _SHORT if c >= " "), *map(chr, range(32))):
        rare = F.replace(rare, F.lit(c), F.lit(_SHORT.get(c, f"\\u{ord(c):04x}")))
    # Spark writes \\u with capital digits.
    listed = F.to_json(F.array(text))
    plain = ~F.contains(listed, F.lit("\\u00")) & F.is_valid_utf8(text)
    return F.when(plain, F.substring(listed, F.lit(2), F.length(listed) - 2)).when(text.isNotNull(), F.concat(F.lit('"'), rare, F.lit('"')))


def json_number(x: Column) -> Column:
    """A double as JSON: as few digits as tell it apart, with an exponent below 1e-4 and from 1e16.

    The digits are the JVM's; before Java 19 those of a few doubles, as 5e-324, are more than they need to be.
    """
    text = F.abs(x).cast("string")
    digits, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    whole, after = F.split_part(digits, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(digits, F.lit("."), F.lit(2)), "0+$", "")
    all_digits = F.concat(whole, after)
    large = F.when(
        F.length(after) > power, F.concat(F.substring(all_digits, F.lit(1), power + 1), F.lit("."), F.substring(all_digits, power + 2, F.length(after)))
    ).otherwise(F.concat(F.rpad(all_digits, power + 1, F.lit("0")), F.lit(".0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), all_digits)
    mantissa = F.when(after == "", whole).otherwise(F.concat(whole, F.lit("."), after))
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    size = F.when(power.isNull(), text).when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(exponent)
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.when(F.isnan(x), "NaN").otherwise(F.concat(F.when(negative, "-").otherwise(""), size))


def canonical_json(value: Column, kind: DataType) -> Column:
    """JSON without blanks, keys sorted, nulls written."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical_json(value[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(json_string(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))
        names = F.array_sort(F.map_keys(value))
        text = F.concat(F.lit("{"), F.array_join(F.transform(names, lambda k: entry(F.struct(k.alias("key"), F.try_element_at(value, k).alias("value")))), ","), F.lit("}"))
    elif isinstance(kind, (DoubleType, FloatType)):
        text = json_number(value.cast("double"))
    elif isinstance(kind, (IntegralType, BooleanType, DecimalType)):
        text = value.cast("string")
    else:
        text = json_string(value.cast(StringType()))
    return F.when(value.isNull(), "null").otherwise(text)


def canonical_sha256(value: Column, kind: DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)


def text_sha256(text: Column) -> Column:
    """SHA-256 of a string as JSON text; null stays null."""
    return F.sha2(json_string(text), 256)


def identity(*columns: Column) -> Column:
    """128 bits that stand for values in groups and joins, so that a shuffle carries them in place of long texts; nulls are values too."""
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("identity"), *columns).alias("y"))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def signature(config: Column, kind: DataType) -> Column:
    """16 hex digits that name a configuration."""
    return F.substring(canonical_sha256(config, kind), 1, 16)


def is_revision(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{40}$")


def fingerprint(df: DataFrame, order: str) -> DataFrame:
    """One row: number of rows and a hash over all of them that depends on content and order column, not on partitions."""
    row = canonical_sha256(F.struct(*df.columns), StructType(df.schema.fields))
    piece = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(piece).cast("string").alias("fingerprint"))


#: Ranges of a node of a hash tree that make one of the next level.
FAN = 1024


def hash_tree(df: DataFrame, key: str, width: int) -> DataFrame:
    """level, node, n, hash over ranges of a whole-number key: level 0 has ranges of `width`, each level after it FAN times that, the last one node.

    A node's hash is the sum of its rows' hashes, so it depends on contents and repeats, not on order, files or partitions,
    and each level comes from the one below. Rows are hashed once, by canonical JSON of all columns. Rows with a null key have
    the node null of level 0 and stand in no other. A table without keys has no other levels.
    """
    row = canonical_sha256(F.struct(*df.columns), StructType(df.schema.fields))
    piece = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    leaves = df.groupBy(F.floor(F.col(key) / width).cast("long").alias("node")).agg(F.count("*").alias("n"), F.sum(piece).alias("hash"))
    # Every leaf counts for its node on each level; levels beyond 64 bits of range don't occur.
    levels = F.expr(f"transform(sequence(0, {-(-64 // (FAN.bit_length() - 1))}), l -> struct(l AS level, CASE WHEN l = 0 THEN node ELSE cast(floor(node / power({FAN}D, l)) AS bigint) END AS node))")
    every = leaves.select(F.explode(levels).alias("at"), "n", "hash").select("at.level", "at.node", "n", "hash")
    return every.where("level = 0 or node is not null").groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("hash").alias("hash"))


def differing_ranges(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """low, high, n_before, n_after of the ranges of level 0 in which two hash trees differ; a null range is that of null keys.

    Level by level from the top, and below only what differs above: where the tops agree, nothing else is compared.
    """
    both = a.withColumn("after", F.lit(False)).unionByName(b.withColumn("after", F.lit(True)))
    top, at = both.agg(F.max("level").alias("m")).first()["m"] or 0, None
    side = lambda c, after: F.max(F.when(F.col("after") == after, F.col(c)))
    for level in range(top, -1, -1):
        nodes = both.where(F.col("level") == level)
        if at is not None:
            # Null keys have no node above; theirs is compared whatever the rest.
            nodes = nodes.withColumn("up", F.when(F.col("node").isNotNull(), F.floor(F.col("node") / FAN).cast("long")))
            nodes = nodes.join(at.select(F.col("node").alias("above"), F.lit(True).alias("differs")), F.col("up") == F.col("above"), "left").where("differs or node is null")
        pairs = nodes.groupBy("node").agg(*(side(c, after).alias(f"{c}_{name}") for c in ("n", "hash") for after, name in ((False, "before"), (True, "after"))))
        at = pairs.where(~(F.col("n_before").eqNullSafe(F.col("n_after")) & F.col("hash_before").eqNullSafe(F.col("hash_after"))))
    at = at.select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after")))
    return at.select((F.col("node") * width).alias("low"), ((F.col("node") + 1) * width).alias("high"), "n_before", "n_after")
