"""Image labels: NAME=VALUE text to typed items and groups, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRING = r"'(?:[^']|'')*'"
NUMBER = r"[+-]?[0-9]+(?:[.][0-9]*)?(?:[EeDd][+-]?[0-9]+)?"
ITEM = rf"([A-Za-z][A-Za-z0-9_]*)\s*=\s*({STRING}|{NUMBER}|\([^)]*\))"


def items(labels: DataFrame) -> DataFrame:
    """From (path, text): path, pos, name, raw value; the LBLSIZE item is left out."""
    names, values = (F.regexp_extract_all("text", F.lit(ITEM), F.lit(i)) for i in (1, 2))
    found = labels.select("path", F.posexplode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("pos", "item"))
    return found.select("path", "pos", "item.name", F.col("item.value").alias("raw")).where("upper(name) <> 'LBLSIZE'")


def all_items(parts: DataFrame) -> DataFrame:
    """Items of a file's leading label and of the one behind its samples (path, part, text), one after the other."""
    first, second = (items(parts.where(F.col("part") == i).select("path", "text")).withColumn("part", F.lit(i)) for i in (0, 1))
    return first.unionByName(second).select("path", "part", "pos", "name", "raw")


def unquoted(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, "^'|'$", ""), "''", "'")


def typed(found: DataFrame) -> DataFrame:
    """Items with kind (string, int, double, list) and s, i, d, n (elements of a list)."""
    raw = F.col("raw")
    number = F.regexp_replace(raw, "[Dd]", "E")
    kind = F.when(raw.startswith("'"), "string").when(raw.startswith("("), "list").when(raw.rlike("^[+-]?[0-9]+$"), "int").otherwise("double")
    elements = F.regexp_extract_all(raw, F.lit(f"({STRING}|{NUMBER})"), F.lit(1))
    return found.withColumn("kind", kind).select(
        "*",
        F.when(F.col("kind") == "string", unquoted(raw)).alias("s"),
        F.when(F.col("kind") == "int", raw.try_cast("long")).alias("i"),
        F.when(F.col("kind") == "double", number.try_cast("double")).alias("d"),
        F.when(F.col("kind") == "list", F.size(elements)).alias("n"),
    )


def grouped(found: DataFrame) -> DataFrame:
    """Items with section (system, property, task), its name and its number within the label.

    A PROPERTY or TASK item opens a group that lasts to the next; a PROPERTY after a TASK is marked as an error.
    """
    opens = F.upper("name").isin("PROPERTY", "TASK")
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = found.select(
        "*",
        F.sum(F.when(opens, 1).otherwise(0)).over(w).alias("number"),
        F.last(F.when(opens, F.upper("name")), ignorenulls=True).over(w).alias("opened"),
        F.last(F.when(opens, unquoted(F.col("raw"))), ignorenulls=True).over(w).alias("title"),
        F.max(F.when(F.upper("name") == "TASK", 1).otherwise(0)).over(w).alias("tasked"),
    )
    wrong = (F.upper("name") == "PROPERTY") & (F.col("tasked") == 1)
    section = F.when(F.col("opened").isNull(), "system").otherwise(F.lower("opened"))
    return out.select("path", "pos", "name", "raw", section.alias("section"), F.coalesce("title", F.lit("")).alias("title"), F.col("number").cast("int").alias("number"), wrong.alias("error"))


def nested(found: DataFrame) -> DataFrame:
    """One row per label: system map, properties map of maps, tasks array of maps (values as written)."""
    placed = grouped(found).where(~F.upper("name").isin("PROPERTY", "TASK") | (F.col("section") == "system"))
    per_group = placed.groupBy("path", "section", "number", "title").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "raw")))).alias("items"))
    return per_group.groupBy("path").agg(
        F.first(F.when(F.col("section") == "system", F.col("items")), ignorenulls=True).alias("system"),
        F.map_from_entries(F.collect_list(F.when(F.col("section") == "property", F.struct("title", "items")))).alias("properties"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == "task", F.struct("number", "title", F.map_entries("items").alias("e"))))), lambda t: F.struct(t["title"], F.map_from_entries(t["e"]).alias("items"))).alias("tasks"),
    )
