"""Collections of texts with vectors: rows become texts, texts chunks, chunks vectors; listing, pages, changes, removal.

A collection is one partition of a Parquet table below ``root``.  ``embed`` turns a list of texts into vectors; a service
or a model stands behind it, and it runs in tasks, a batch of chunks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import chunks
from tessella.operators.retrieval import Bm25Index, bm25_index
from tessella.sources.sinks import delete_rows, upsert
from tessella.sources.tables import written

Embed = Callable[[list[str]], list[list[float]]]
CHUNK = "chunk_id string, parent_id string, chunk_index int, chunk_total int, chunk_type string, text string, meta map<string,string>, embedding array<double>"


def embedded(rows: DataFrame, embed: Embed) -> DataFrame:
    """``rows`` with ``embedding``, the vector of ``text``; the vectors of a batch are asked for together."""

    @F.pandas_udf("array<double>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([list(map(float, v)) for v in embed(series.fillna("").tolist())], index=series.index, dtype=object)

    return rows.withColumn("embedding", vectors("text"))


def row_texts(rows: DataFrame, id_col: str, vector_fields: Sequence[str] = (), metadata_fields: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, meta of structured rows.

    The text is the one field asked for, else the JSON object of the fields (all but the id where none is named); meta
    maps the metadata fields that are not null to their values, scalars as they are and others in JSON.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    own = [c for c in rows.columns if c != id_col]

    def value(name: str) -> Column:
        column, kind = F.col(f"`{name}`"), kinds[name].typeName()
        return F.to_json(column) if kind in ("struct", "array", "map") else column.cast("string")

    if len(vector_fields) == 1:
        text = value(vector_fields[0])
    else:
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in (vector_fields or own)]), {"ignoreNullFields": "false"})
    pairs = [x for c in metadata_fields if c in kinds for x in (F.lit(c), value(c))]
    meta = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("text"), meta.alias("meta"))


def chunk_rows(texts: DataFrame, kind: str = "json") -> DataFrame:
    """Chunks of (doc_id, text, meta) with their document's metadata."""
    cut = chunks.chunked(texts).withColumn("chunk_type", F.lit(kind))
    return cut.join(texts.select(F.col("doc_id").alias("parent_id"), "meta"), "parent_id")


def json_chunks(items: DataFrame) -> DataFrame:
    """Chunks of JSON objects (doc_id, text): of the first long field of an object, else the object itself."""
    fields = F.map_values(F.from_json("text", "map<string,string>"))
    long = F.filter(fields, lambda v: (F.length(v) / 4 > chunks.MOST_TOKENS) | (F.size(tx.tokenize(v)) > chunks.MOST_TOKENS))
    chosen = F.coalesce(F.get(long, F.lit(0)), F.col("text"))
    return chunks.chunked(items.select("doc_id", chosen.alias("text"))).withColumn("chunk_type", F.lit("json"))


@dataclass(frozen=True)
class Collections:
    spark: SparkSession
    root: str
    embed: Embed

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/chunks"

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{CHUNK}, collection string").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], f"{CHUNK}, collection string")

    def of(self, name: str) -> DataFrame:
        return self.rows().where(F.col("collection") == name).drop("collection")

    def listed(self) -> DataFrame:
        """Names of collections with their numbers of documents and chunks."""
        return self.rows().groupBy("collection").agg(F.countDistinct("parent_id").alias("documents"), F.count(F.lit(1)).alias("chunks")).orderBy("collection")

    def _put(self, name: str, rows: DataFrame) -> None:
        # written apart first, as a table cannot be read and replaced in one job
        kept = written(rows, "collection").withColumn("collection", F.lit(name))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(self.path)

    def add(self, name: str, rows: DataFrame, id_col: str, vector_fields: Sequence[str] = (), metadata_fields: Sequence[str] = ()) -> DataFrame:
        """Vectorise rows into a collection; what it holds of the same documents is replaced.  The new chunks."""
        texts = row_texts(rows, id_col, vector_fields, metadata_fields).where(F.trim("text") != "")
        new = written(embedded(chunk_rows(texts, "text" if vector_fields else "json"), self.embed), "vectorised")
        new = new.select(*[c.split()[0] for c in CHUNK.split(", ")])
        self._put(name, upsert(self.of(name), new, ["parent_id"]))
        return new

    def remove(self, name: str, ids: DataFrame) -> None:
        """Remove the documents of ``ids`` (parent_id)."""
        self._put(name, delete_rows(self.of(name), ids, ["parent_id"]))

    def page(self, name: str, page: int = 1, size: int = 10) -> DataFrame:
        """chunk_id, preview and metadata of one page, in order of the ids."""
        if page < 1 or size < 1:
            raise ValueError("page and size must be at least 1")
        found = self.of(name).orderBy("chunk_id").offset((page - 1) * size).limit(size)
        return found.select("chunk_id", tx.preview(F.col("text")).alias("preview"), "meta")

    def detail(self, name: str, chunk_id: str) -> DataFrame:
        return self.of(name).where(F.col("chunk_id") == chunk_id).select("chunk_id", "text", "meta")

    def index(self, name: str) -> Bm25Index:
        return bm25_index(self.of(name).select(F.col("chunk_id").alias("doc_id"), "text"))

    def whole(self, name: str, results: DataFrame) -> DataFrame:
        """``results`` (qid, doc_id of a chunk, ...) with the whole text of its document, metadata merged into JSON texts."""
        store = self.of(name)
        many = chunks.reassembled(store.where("chunk_total > 1")).select("parent_id", F.col("text").alias("_whole"))
        own = store.select(F.col("chunk_id").alias("doc_id"), "parent_id", "meta", F.col("text").alias("_text")).join(many, "parent_id", "left")
        shown = F.map_filter("meta", lambda k, v: ~k.isin("custom_data", *chunks.INTERNAL_KEYS))
        text = tx.merged_json(shown, F.coalesce("_whole", "_text"))
        return results.drop("text").join(own, "doc_id").withColumn("text", text).drop("parent_id", "meta", "_text", "_whole")
