"""The search index as Parquet tables - meta, chunks, vectors - written with a checksum and read with refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import shared_path

VERSION = 2


class IndexRefused(ValueError):
    """The stored index doesn't fit: another version, another model, or vectors that don't belong to the chunks."""


def vectors_checksum(vectors: DataFrame) -> str:
    """A checksum of all (chunk_ord, embedding) rows, whatever their order, from one row per partition."""
    row = F.xxhash64("chunk_ord", "embedding")
    summed = vectors.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    return vectors.sparkSession.range(1).select(F.sha2(F.lit(f"{summed['n']}:{summed['x']}:{summed['s']}"), 256)).first()[0]


def write_index(chunks: DataFrame, vectors: DataFrame, path: str, model: str, dtype: str, dim: int, source_sha256: str = "") -> None:
    """Write chunks (any columns with chunk_ord) and vectors (chunk_ord, embedding), then the meta row."""
    spark = chunks.sparkSession
    vectors.write.mode("error").parquet(f"{path}/vectors")
    chunks.write.mode("error").parquet(f"{path}/chunks")
    checksum = vectors_checksum(spark.read.parquet(f"{path}/vectors"))
    meta = "version int, model string, dtype string, dim int, vectors_sha256 string, source_sha256 string"
    row = [(VERSION, model, dtype, dim, checksum, source_sha256)]
    spark.createDataFrame(row, meta).coalesce(1).write.mode("error").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str, model: str, dtype: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """The chunks and vectors of an index; refuses another version, model, changed vectors, or rows without partner."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION:
        raise IndexRefused(f"version {meta['version']}, expected {VERSION}")
    if (meta["model"], meta["dtype"], meta["dim"]) != (model, dtype, dim):
        raise IndexRefused(f"made with {meta['model']} {meta['dtype']} {meta['dim']}, expected {model} {dtype} {dim}")
    chunks, vectors = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")
    if vectors_checksum(vectors) != meta["vectors_sha256"]:
        raise IndexRefused("the vectors were changed after the index was written")
    ords = chunks.select("chunk_ord", F.lit(True).alias("c")).join(vectors.select("chunk_ord", F.lit(True).alias("v")), "chunk_ord", "full_outer")
    if not ords.where("c is null or v is null").isEmpty():
        raise IndexRefused("chunks and vectors don't belong together")
    return chunks, vectors


def is_stale(spark: SparkSession, path: str, source: str) -> bool:
    """Whether the source file changed since the index was written; a missing source is no reason to warn."""
    recorded = spark.read.parquet(f"{path}/meta").first()["source_sha256"]
    found = spark.read.format("binaryFile").load(source).select(F.sha2("content", 256).alias("h")).first()
    return bool(found and recorded and found["h"] != recorded)


def round_trip(indexed: DataFrame, model: str = "given", dtype: str = "float32", dim: int = 64) -> DataFrame:
    """Write rows (chunk_ord, chunk_id, ..., embedding) to the shared folder as an index and read them back."""
    spark = indexed.sparkSession
    path = shared_path(spark, "index")
    write_index(indexed.drop("embedding"), indexed.select("chunk_ord", "embedding"), path, model, dtype, dim)
    chunks, vectors = read_index(spark, path, model, dtype, dim)
    return chunks.join(vectors, "chunk_ord")
