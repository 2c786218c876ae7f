"""Sources and sinks: OCR documents, samples, results, page listings, graph tables."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.schema import OCR_DOCUMENT, QA_SAMPLE


def read_ocr_documents(spark: SparkSession, path: str, doc_id: str | None = None, limit: int | None = None) -> DataFrame:
    """OCR documents, one JSON file each; a document filter prunes files by name."""
    df = spark.read.schema(OCR_DOCUMENT).option("multiLine", True).json(path)
    if doc_id:
        df = df.filter(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"(?:_ocr)?\.json$", "") == doc_id)
    return df.orderBy("document_id").limit(limit) if limit else df


def ocr_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of OCR documents as rows, in the order written."""
    b = documents.select(F.col("document_id").alias("doc_id"), F.posexplode("blocks").alias("pos", "b"))
    return b.select("doc_id", "pos", "b.*")


def read_samples(spark: SparkSession, path: str, schema: str = QA_SAMPLE) -> DataFrame:
    """Samples of a JSON array file, with their place in it."""
    one = spark.read.option("wholetext", True).text(path)
    rows = one.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>")).alias("sample_idx", "s"))
    return rows.select("sample_idx", "s.*")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*") if schema else spark.read.json(path)


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """Page images by document and number (the number ends the file's stem); pixels are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "length")
    stem = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    return f.select(F.regexp_extract(stem, r"^(.*)_[0-9]+$", 1).alias("doc_id"), F.regexp_extract(stem, r"_([0-9]+)$", 1).try_cast("int").alias("page"), "path", "length").filter("page is not null")


def first_listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Page images of each document from the first of the folders that has its page 0; folders that are
    missing are passed by. Raises where none can be read."""
    every = None
    for no, folder in enumerate(folders):
        try:
            one = page_images(spark, folder).withColumn("_no", F.lit(no))
        except AnalysisException:
            continue
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise FileNotFoundError(f"none of {folders} can be read")
    chosen = every.filter("page = 0").groupBy("doc_id").agg(F.min("_no").alias("_no"))
    return every.join(chosen, ["doc_id", "_no"]).drop("_no")


def pick_pages(pages: DataFrame, only: list[int] | None = None, start: int | None = None, end: int | None = None, most: int | None = None, required: bool = False) -> DataFrame:
    """Pages of a listing: an id set, then a half-open range, then the first ``most`` of each document.
    With ``required`` an empty choice raises."""
    p = pages.filter(F.col("page").isin(only)) if only else pages
    p = p.filter(F.col("page") >= start) if start is not None else p
    p = p.filter(F.col("page") < end) if end is not None else p
    if most is not None:
        p = p.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).filter(F.col("_n") <= most).drop("_n")
    if required and p.isEmpty():
        raise FileNotFoundError("no pages")
    return p


def page_count(pages: DataFrame) -> DataFrame:
    """Number of page images of each document."""
    return pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))


def read_hypergraph(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """The hypergraph of one document, its name given with or without the suffix; an empty frame if it is not there."""
    name = doc_id.removesuffix(".pdf")
    return spark.read.parquet(path).filter(F.col("document_id").isin(name, f"{name}.pdf"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.option("wholetext", True).text(path).select("value", "_metadata.file_name")
    return f.select(F.regexp_extract("file_name", r"^(.*)_[0-9]+\.txt$", 1).alias("doc_id"), F.regexp_extract("file_name", r"_([0-9]+)\.txt$", 1).try_cast("int").alias("page"), F.col("value").alias("text"))


def unfinished(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def expand_env(value):
    """Environment variables in the strings of a nested configuration."""
    if isinstance(value, str):
        return os.path.expandvars(value)
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    return [expand_env(v) for v in value] if isinstance(value, list) else value


def write_graph(tables: dict[str, DataFrame], path: str, by: str | None = None) -> None:
    """Tables of a graph (nodes, pages, edges, members or vertices, arcs), one folder each."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{path}/{name}")


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_ocr(documents: DataFrame, blocks: DataFrame, path: str) -> None:
    """OCR documents as JSON, one record each with its blocks in order and their number by type."""
    b = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "page", "bbox", "block_type", "text", "rec_conf"))).alias("blocks"))
    kinds = blocks.groupBy("doc_id", "block_type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "n")))).alias("statistics"))
    out = documents.join(b, documents.document_id == b.doc_id, "left").drop("doc_id").join(kinds, documents.document_id == kinds.doc_id, "left").drop("doc_id")
    out.write.mode("overwrite").json(path)


def with_ranked_pages(samples: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """Samples with the ``k`` best pages and their scores (``ranked``: sample_idx, page, score); empty where there are none."""
    w = Window.partitionBy("sample_idx").orderBy(F.col("score").desc(), "page")
    r = ranked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("_n", "page", "score"))).alias("r"))
    j = samples.join(r, "sample_idx", "left").withColumn("r", F.coalesce("r", F.array().cast(r.schema["r"].dataType)))
    return j.withColumn(f"image_top_{k}_question", F.transform("r", lambda x: x["page"])).withColumn(f"image_top_{k}_question_score", F.transform("r", lambda x: x["score"])).drop("r")


def cached(df: DataFrame, path: str, key: str, compute) -> DataFrame:
    """Read-through table cache: rows of ``df`` whose ``key`` is in the table at ``path`` are taken from it, the others
    computed by ``compute`` (a function of a frame that keeps ``key``) and added to it."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path)
    except AnalysisException:
        compute(df).write.mode("append").parquet(path)
        return spark.read.parquet(path).join(df.select(key).distinct(), key, "left_semi")
    fresh = df.join(have.select(key).distinct(), key, "left_anti")
    if not fresh.isEmpty():
        compute(fresh).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(df.select(key).distinct(), key, "left_semi")


def write_edge_list(arcs: DataFrame, path: str) -> None:
    """Arcs as lines of ``src dst {weight, kind}``, the attributes as JSON."""
    arcs.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.to_json(F.struct("weight", "kind")))).write.mode("overwrite").text(path)
