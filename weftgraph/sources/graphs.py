"""Graphs as tables or JSON, the store of documents' keyphrases, stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: num_nodes, num_relationships, created_at, node_types (a map of counts)."""
    types = nodes.groupBy("type").agg(F.count("*").alias("n"))  # a row per type
    tally = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("node_types"))
    return tally.crossJoin(F.broadcast(edges.agg(F.count("*").alias("num_relationships")))).withColumn("created_at", F.current_timestamp())  # one row each


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, kind: str = "parquet") -> None:
    """nodes, edges and metadata below folder, as Parquet or as JSON lines."""
    for name, df in (("nodes", nodes), ("edges", edges), ("metadata", graph_metadata(nodes, edges))):
        df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def typed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("type", F.when(F.col("type") == "DOCUMENT", "DOCUMENT").otherwise("CHUNK"))


def read_graph(spark: SparkSession, folder: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Nodes, those of unknown type as CHUNK, and the edges whose ends both exist."""
    nodes = typed(spark.read.format(kind).load(f"{folder}/nodes"))
    return nodes, without_dangling(spark.read.format(kind).load(f"{folder}/edges"), nodes, "source", "target", "id")


def normal_id(ident: Column) -> Column:
    """A UUID in its usual form where the text is one (any case, with braces, urn or without hyphens), else the text."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(ident, r"^urn:uuid:", ""), r"[{}-]", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(ident)


def read_json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph that is one JSON document {nodes, relationships}: typed nodes and edges without loose ends, ids in normal form."""
    whole = spark.read.option("multiLine", True).json(path)
    nodes = typed(whole.select(F.explode("nodes").alias("n")).select("n.*")).withColumn("id", normal_id(F.col("id")))
    edges = whole.select(F.explode("relationships").alias("r")).select("r.*").withColumn("source", normal_id(F.col("source"))).withColumn("target", normal_id(F.col("target")))
    return nodes, without_dangling(edges, nodes, "source", "target", "id")


def without_dangling(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    ids = nodes.select(F.col(node).alias("_node"))
    return edges.join(ids, F.col(a) == F.col("_node"), "left_semi").join(ids, F.col(b) == F.col("_node"), "left_semi")


# ---- the store of documents ----


def store_rows(chunks: DataFrame, documents: DataFrame, parameters: str = "") -> DataFrame:
    """filename, source_hash, parameters and chunks (by chunk_index, with their keyphrases): one row per document.

    documents: filename, content. chunks: filename, chunk_index, keyphrases and more. parameters: what else chunks depend on.
    """
    rest = [c for c in chunks.columns if c not in ("filename", "chunk_index")]
    per = chunks.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("chunk_index", *rest))).alias("chunks"))
    docs = documents.select("filename", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256).alias("source_hash"), F.lit(parameters).alias("parameters"))
    return docs.join(per, "filename")


def write_store(rows: DataFrame, folder: str) -> None:
    """Append to the store; the latest row of a document, its content and its parameters counts."""
    rows.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(folder)


def hydrate(chunks: DataFrame, documents: DataFrame, store: DataFrame, parameters: str = "") -> DataFrame:
    """chunks with the stored keyphrases where a document's content and parameters are the same, by chunk_index; else their own."""
    hashes = documents.select("filename", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256).alias("source_hash"))
    kept = store.filter(F.col("parameters") == parameters)
    stamp = F.col("stored_at") if "stored_at" in store.columns else F.lit(0)
    latest = kept.groupBy("filename", "source_hash").agg(F.max_by("chunks", stamp).alias("chunks"))
    cached = hashes.join(latest, ["filename", "source_hash"]).select("filename", F.explode("chunks").alias("c"))
    cached = cached.select("filename", F.col("c.chunk_index").alias("chunk_index"), F.col("c.keyphrases").alias("_cached")).filter(F.size("_cached") > 0)
    return chunks.join(cached, ["filename", "chunk_index"], "left").withColumn("keyphrases", F.coalesce("_cached", "keyphrases")).drop("_cached")


# ---- stages ----

# The graph's versions in the order they are made.
SNAPSHOTS = ("kg_01_raw", "kg_02_enriched", "kg_03_agent", "kg_04_graphify", "kg_live", "kg_final")


def write_stage(rows: DataFrame, folder: str, stage: str) -> None:
    """Append rows to a stage's checkpoint."""
    rows.write.mode("append").parquet(f"{folder}/{stage}")


def read_stage(spark: SparkSession, folder: str, stage: str, schema: str) -> DataFrame:
    """A stage's checkpoint, empty if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{stage}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/{stage}") if there else spark.createDataFrame([], schema)


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str, name: str) -> None:
    if name not in SNAPSHOTS:
        raise ValueError(f"no snapshot {name}")
    write_graph(nodes, edges, f"{folder}/{name}")
