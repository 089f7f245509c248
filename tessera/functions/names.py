"""Names, slugs, cache keys and small parsers as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import numbered


def prompt_text(name: Column) -> Column:
    """"bean_leaf" -> "a bean leaf"; an empty name takes "an"."""
    words = F.replace(name, F.lit("_"), F.lit(" "))
    first = F.lower(F.substring(words, 1, 1))
    return F.concat(F.when(first.isin("a", "e", "i", "o", "u", ""), "an").otherwise("a"), F.lit(" "), words)


def sanitized(name: Column) -> Column:
    """White space collapsed and trimmed, / as " or ", \\ as a blank; empty gives "unknown"."""
    flat = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    flat = F.replace(F.replace(flat, F.lit("/"), F.lit(" or ")), F.lit("\\"), F.lit(" "))
    return F.when(flat == "", "unknown").otherwise(flat)


def slug(value: Column, longest: int = 48) -> Column:
    kept = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    cut = F.substring(kept, 1, longest)
    return F.when(cut == "", "cache").otherwise(cut)


def fingerprint(config: dict) -> str:
    """12 hex digits of the canonical JSON of a configuration; computed once, on the driver."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def cache_key(key: Column) -> Column:
    """Key with forward slashes and without leading dots and slashes (characters, not a prefix)."""
    return F.regexp_replace(F.replace(key, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def prompt_cache_name(key: Column) -> Column:
    return F.concat(slug(stem(key)), F.lit("_"), F.substring(F.sha1(key), 1, 12), F.lit(".pt"))


def feature_cache_name(key: Column, longest: int = 80) -> Column:
    own = cache_key(key)
    return F.concat(slug(stem(own), longest), F.lit("_"), F.sha1(own), F.lit(".pt"))


def optional_number(value: Column) -> Column:
    """"none" and "null", in any case and with blanks, are null; other text is a number or null."""
    flat = F.lower(F.trim(value))
    return F.when(~flat.isin("none", "null", ""), flat.try_cast("double"))


def cluster_number(value: Column) -> Column:
    """A number of clusters; "auto", "none", "null" and other text are null, which stands for a number by class size."""
    return optional_number(value).cast("int")


#: The label of pixels that do not count, and the kind of mask that queries are judged by, for all data sets.
IGNORE_LABEL, MASK_TYPE = 0, "semantic_union_binary_from_annotations"


def dataset_family(root: Column) -> Column:
    """The family of a data set, by the name of its folder."""
    low = F.lower(basename(root))
    known = F.when(low.contains("ade20k_150"), "ade20k_150").when(low.contains("cityscapes"), "cityscapes")
    return known.when(low.contains("pc-59") | low.contains("pc59"), "pc59").when(low.contains("lvis"), "lvis").otherwise("other")


def ignore_policy(root: Column) -> Column:
    """struct<ignore_label, family>: how unlabelled pixels of a data set count."""
    return F.struct(F.lit(IGNORE_LABEL).alias("ignore_label"), dataset_family(root).alias("family"))


def query_rule(root: Column) -> Column:
    """struct<mask_type, united>: a class's truth in an image is the union of its instances (data sets of instances) or annotations."""
    united = F.when(dataset_family(root) == "lvis", "instances").otherwise("annotations")
    return F.struct(F.lit(MASK_TYPE).alias("mask_type"), united.alias("united"))


def utc_text(time: Column) -> Column:
    """ISO time in seconds with the zone written out."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two times, rounded to tenths."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 1)


def normal_text(value: Column, other: Column) -> Column:
    """value with white space collapsed, else other, else null."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(tidy(value), tidy(other))


def split_name(path: Column) -> Column:
    low = F.lower(basename(path))
    return F.when(low.contains("val"), "val").when(low.contains("test"), "test").otherwise("eval")


def category_name(name: Column, category_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("cat_"), category_id.cast("string")))


def thresholds(start: float, stop: float, step: float) -> list[float]:
    """start:stop:step with the stop included."""
    out, k = [], 0
    while start + k * step <= stop + 1e-9:
        out.append(round(start + k * step, 10))
        k += 1
    return out


def vocabulary(names: DataFrame, column: str = "name") -> DataFrame:
    """(category_id, name, original_name): distinct names in order, sanitised; equal ones get (2), (3), ... and a suffixed
    name that is already taken moves on by numbering again."""
    own = names.select(F.col(column).alias("original_name")).where("original_name is not null").distinct().withColumn("clean", sanitized(F.col("original_name")))
    order = Window.partitionBy("clean").orderBy("original_name")
    named = own.withColumn("k", F.row_number().over(order)).withColumn("name", F.when(F.col("k") == 1, F.col("clean")).otherwise(F.concat("clean", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))))
    again = Window.partitionBy("name").orderBy("k", "original_name")
    named = named.withColumn("j", F.row_number().over(again)).withColumn("name", F.when(F.col("j") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), (F.col("j")).cast("string"), F.lit(")"))))
    return numbered(named, "original_name", name="category_id").select("category_id", "name", "original_name")
