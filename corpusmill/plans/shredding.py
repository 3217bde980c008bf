"""p1: flat child tables of the JSON columns of request_captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shred import entities, latest_delivery, shred
from .registry import Registry, table

REGISTRY = Registry()
FIELDS = ["retrieval_results", "retriever_config", "reranker_config"]
ITEM_LABELS = {
    "chunk_id": ["chunkid"],
    "document_id": ["documentid"],
    "locator": ["locator"],
    "retrieval_score": ["retrievalscore"],
    "rerank_score": ["rerankscore"],
    "kind": ["kind"],
    "model_name": ["modelname"],
    "name": ["name"],
    "value": ["value"],
}


def capture_entities(spark, folder: str) -> DataFrame:
    nodes = shred(table(spark, folder, "request_captures"), "request_id", FIELDS, "stored_at")
    return entities(nodes, ITEM_LABELS, numbers_of="reranker_config")


def retrieved_items(found: DataFrame) -> DataFrame:
    """Objects of retrieval_results with a chunk id; pos counts a request's items in reading order."""
    items = latest_delivery(found.where("node < 0 or (field = 'retrieval_results' and chunk_id is not null)"))
    return items.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("node")))


def reranker_weights(found: DataFrame) -> DataFrame:
    """A weight a row: of ``{"weights": {name: number}}`` and of lists of names and values alike."""
    own = latest_delivery(found.where("node < 0 or (field = 'reranker_config' and entity = 'weights')"))
    named = F.when(F.col("has_name") & F.col("name").isNotNull(), F.transform(F.filter("numbers", lambda x: F.lower(x["label"]) == "value"), lambda x: F.struct(F.col("name").alias("label"), x["value"].alias("value")))).otherwise(F.col("numbers"))
    return own.select("key", "node", "parent", "ordinal", F.explode(named).alias("w")).select("key", "node", "parent", "ordinal", F.col("w.label").alias("weight"), F.col("w.value").alias("value"))


def _children(found: DataFrame) -> DataFrame:
    """All children of all fields and the deliveries, as (key, stamp, delivery, field, child, node,
    child_key), in one pass."""
    item = F.when((F.col("field") == "retrieval_results") & F.col("chunk_id").isNotNull(), F.array(F.struct(F.lit("retrieval_results").alias("child"), F.trim("chunk_id").alias("child_key"))))
    strategy = F.when((F.col("field") == "retriever_config") & (F.col("entity") == "strategy"), F.array(F.struct(F.lit("retriever_config.strategy").alias("child"), F.col("kind").alias("child_key"))))
    cross = F.when((F.col("field") == "reranker_config") & (F.col("entity") == "crossencoder"), F.array(F.struct(F.lit("reranker_config.cross_encoder").alias("child"), F.col("model_name").alias("child_key"))))
    name = F.when(F.col("name").isNotNull() & F.exists("numbers", lambda x: F.lower(x["label"]) == "value"), F.array(F.struct(F.lit("reranker_config.weights").alias("child"), F.col("name").alias("child_key"))))
    weights = F.when((F.col("field") == "reranker_config") & (F.col("entity") == "weights"), F.coalesce(name, F.transform("numbers", lambda x: F.struct(F.lit("reranker_config.weights").alias("child"), x["label"].alias("child_key")))))
    delivery = F.when(F.col("node") < 0, F.array(F.struct(F.lit(None).cast("string").alias("child"), F.lit(None).cast("string").alias("child_key"))))
    return found.select("key", "stamp", "delivery", "field", "node", F.explode(F.coalesce(item, strategy, cross, weights, delivery)).alias("c")).select("key", "stamp", "delivery", "field", "node", "c.child", "c.child_key")


@REGISTRY.query("p1_found")
def p1_found(spark, folder):
    rows = latest_delivery(_children(capture_entities(spark, folder)))
    place = F.when(F.col("child") == "retrieval_results", F.row_number().over(Window.partitionBy("key", "child").orderBy("node"))).otherwise(F.lit(0))
    return rows.select(F.col("key").alias("request_id"), "child", place.cast("int").alias("pos"), "child_key").distinct()


@REGISTRY.query("p1_retrieved_items")
def p1_retrieved_items(spark, folder):
    items = retrieved_items(capture_entities(spark, folder))
    return items.select(F.col("key").alias("request_id"), "pos", F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "ordinal", "chunk_id", "document_id", "locator", F.expr("try_cast(retrieval_score as double)").alias("retrieval_score"), F.expr("try_cast(rerank_score as double)").alias("rerank_score"))


@REGISTRY.query("p1_reranker_weights")
def p1_reranker_weights(spark, folder):
    rows = reranker_weights(capture_entities(spark, folder))
    return rows.select(F.col("key").alias("request_id"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "ordinal", "weight", "value").distinct()


def _configured(spark, folder: str, field: str, entity: str) -> DataFrame:
    """The objects under one label of a configuration, with their place in the parent."""
    rows = latest_delivery(capture_entities(spark, folder).where((F.col("node") < 0) | ((F.col("field") == field) & (F.col("entity") == entity))))
    return rows.select(F.col("key").alias("request_id"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "ordinal", "kind", "model_name").distinct()


@REGISTRY.query("p1_retriever_strategies")
def p1_retriever_strategies(spark, folder):
    return _configured(spark, folder, "retriever_config", "strategy").drop("model_name")


@REGISTRY.query("p1_cross_encoders")
def p1_cross_encoders(spark, folder):
    return _configured(spark, folder, "reranker_config", "crossencoder").drop("kind")


@REGISTRY.query("p1_rejects")
def p1_rejects(spark, folder):
    """The fields of each request's latest delivery that have no nodes, and why."""
    nodes = shred(table(spark, folder, "request_captures"), "request_id", FIELDS, "stored_at").where("node < 0")
    return latest_delivery(nodes).select(F.col("key").alias("request_id"), "field", F.col("scalar").alias("reason")).distinct()
