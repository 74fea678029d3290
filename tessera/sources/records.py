"""JSONL records behind a gate, vocabularies and hierarchies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import gates


class GateError(ValueError):
    """A record is not admitted; the message names the line."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line that is not blank. A file is one row at first: gold files are small."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    return whole.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "value")).where("trim(value) <> ''").select("file", (F.col("at") + 1).alias("line"), "value")


def read_gated(spark: SparkSession, path: str, schema: str, gate: Callable[[Column], Column], kind: str) -> DataFrame:
    """Records of a JSONL file; GateError at the first line that is no JSON, fails the gate or repeats an item_id."""
    lines = numbered_lines(spark, path)
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    errors = F.when(F.col("v").isNull(), F.array(F.lit("not JSON"))).otherwise(gate(F.col("v")))
    rows = parsed.select("file", "line", errors.alias("errors"), F.from_json("value", schema).alias("r")).cache()
    bad = rows.where(F.size("errors") > 0).orderBy("file", "line").select("line", "errors").first()
    twice = rows.groupBy("r.item_id").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.count(F.lit(1)).alias("n")).where("n > 1 and item_id is not null").orderBy(F.col("lines")[1]).first()
    if bad and (not twice or bad["line"] <= twice["lines"][1]):
        raise GateError(f"{kind} line {bad['line']}: {'; '.join(bad['errors'])}")
    if twice:
        raise GateError(f"{kind} line {twice['lines'][1]}: item_id {twice['item_id']!r} is also on line {twice['lines'][0]}")
    return rows.select("r.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_gated(spark, path, schemas.GOLD, gates.gold_errors, "gold")


def read_pred(spark: SparkSession, path: str) -> DataFrame:
    return read_gated(spark, path, schemas.PRED, gates.pred_errors, "pred")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent) edges of {"edges": {child: [parents]}}."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "edges map<string,array<string>>").alias("d"))
    return doc.select(F.explode("d.edges").alias("child", "parents")).select("child", F.explode("parents").alias("parent"))


def read_vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(axis, value); the built-in vocabulary without a path."""
    if path is None:
        return spark.createDataFrame([(a, v) for a, vs in schemas.FACETS.items() for v in vs], "axis string, value string")
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "facets map<string,struct<values:array<string>>>").alias("d"))
    return doc.select(F.explode("d.facets").alias("axis", "f")).select("axis", F.explode("f.values").alias("value"))


def read_matcher_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a struct<surface:string,aliases:array<string>>, b struct<surface:string>, human_match boolean, note string").json(path)
