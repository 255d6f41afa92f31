"""A store of indexed documents: a narrow table of metadata, a wide one of bodies, and the read operators on them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import toc, trees
from leafmill.session import materialise


class Workspace:
    """Documents under a folder; metadata are read without touching bodies."""

    META = "doc_id string, type string, doc_name string, doc_description string, page_count int, line_count int"
    PAGES = "doc_id string, page int, text string"
    NODES = "doc_id string, node_id string, parent_id string, ord long, structure string, title string, start_index int, end_index int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.meta_path, self.page_path, self.node_path = (os.path.join(path, x) for x in ("meta", "pages", "nodes"))

    def index_pages(self, pages: DataFrame) -> None:
        """Indexes documents given as pages (``doc_id, page, text``)."""
        pages = materialise(pages)
        nodes = toc.build_index(pages)
        meta = pages.groupBy("doc_id").agg(F.max("page").alias("page_count")).select("doc_id", F.lit("pdf").alias("type"), F.translate("doc_id", "_", " ").alias("doc_name"), F.lit(None).cast("string").alias("doc_description"), "page_count", F.lit(None).cast("int").alias("line_count"))
        self._add(meta, pages.select("doc_id", F.col("page").cast("int").alias("page"), "text"), nodes.select("doc_id", "node_id", "parent_id", "ord", "structure", "title", "start_index", "end_index"))

    def index_markdown(self, texts: DataFrame) -> None:
        """Indexes Markdown documents (``doc_id, text``); their lines are their pages."""
        texts = materialise(texts)
        nodes = toc.build_markdown_index(texts)
        meta = texts.select("doc_id", F.lit("md").alias("type"), F.translate("doc_id", "_", " ").alias("doc_name"), F.lit(None).cast("string").alias("doc_description"), F.lit(None).cast("int").alias("page_count"), F.size(F.split("text", r"\r?\n")).alias("line_count"))
        rows = nodes.select("doc_id", "node_id", "parent_id", "ord", F.lit(None).cast("string").alias("structure"), "title", F.col("line_num").alias("start_index"), F.lit(None).cast("int").alias("end_index"))
        self._add(meta, nodes.select("doc_id", F.col("line_num").alias("page"), "text"), rows)

    def _add(self, meta: DataFrame, pages: DataFrame, nodes: DataFrame) -> None:
        # bodies first: a document is known once all of it is there
        for rows, schema, path in ((pages, self.PAGES, self.page_path), (nodes, self.NODES, self.node_path), (meta, self.META, self.meta_path)):
            fields = [f.split(" ") for f in schema.split(", ")]
            rows.select(*(F.col(name).cast(kind).alias(name) for name, kind in fields)).write.mode("append").parquet(path)

    def meta(self) -> DataFrame:
        return self.spark.read.parquet(self.meta_path)

    def rebuild_meta(self) -> None:
        """Metadata from the bodies, where they were lost."""
        pages = self.spark.read.parquet(self.page_path)
        meta = pages.groupBy("doc_id").agg(F.max("page").alias("page_count")).select("doc_id", F.lit("pdf").alias("type"), F.translate("doc_id", "_", " ").alias("doc_name"), F.lit(None).cast("string").alias("doc_description"), "page_count", F.lit(None).cast("int").alias("line_count"))
        meta.write.mode("overwrite").parquet(self.meta_path)

    def document(self, doc_id: str) -> str:
        """Metadata as JSON; an error object for an unknown id."""
        row = self.meta().where(F.col("doc_id") == doc_id).limit(1).collect()
        return json.dumps({k: v for k, v in row[0].asDict().items() if v is not None} if row else {"error": f"no document {doc_id}"})

    def structure(self, doc_id: str) -> str:
        """The section tree as JSON, without texts."""
        rows = self.spark.read.parquet(self.node_path).where(F.col("doc_id") == doc_id).orderBy("ord").collect()
        if not rows:
            return json.dumps({"error": f"no document {doc_id}"})
        below: dict = {}
        for r in rows:
            below.setdefault(r["parent_id"], []).append(r)

        def nested(r) -> dict:
            out = {k: r[k] for k in ("node_id", "structure", "title", "start_index", "end_index") if r[k] is not None}
            kids = [nested(c) for c in below.get(r["node_id"], [])]
            return out | ({"nodes": kids} if kids else {})

        return json.dumps([nested(r) for r in below.get(None, [])])

    def pages(self, doc_id: str, spec: str) -> str:
        """Contents of pages ``5-7,12`` as JSON; of Markdown the sections between the least and the greatest line."""
        try:
            wanted = toc.page_range(spec)
        except ValueError as e:
            return json.dumps({"error": str(e)})
        meta = self.meta().where(F.col("doc_id") == doc_id).limit(1).collect()
        if not meta:
            return json.dumps({"error": f"no document {doc_id}"})
        rows = self.spark.read.parquet(self.page_path).where(F.col("doc_id") == doc_id)
        rows = rows.where(F.col("page").between(wanted[0], wanted[-1])) if meta[0]["type"] == "md" else rows.where(F.col("page").isin(wanted))
        return json.dumps([{"page": r["page"], "content": r["text"]} for r in rows.select("page", "text").distinct().orderBy("page").collect()])

    def search(self, condition: str) -> DataFrame:
        """Documents by a SQL condition on their metadata."""
        return self.meta().where(condition)


def node_pages(workspace: Workspace) -> DataFrame:
    """``doc_id, node_id, text`` of every node of a workspace."""
    spark = workspace.spark
    return trees.node_text(spark.read.parquet(workspace.node_path), spark.read.parquet(workspace.page_path))
