import pytest

from folioscope.sources import index_store


def tables(spark):
    chunks = spark.createDataFrame([(0, "a"), (1, "b")], "chunk_ord int, chunk_id string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "chunk_ord int, embedding array<float>")
    return chunks, vectors


def test_round_trip_and_refusals(spark, tmp_path):
    chunks, vectors = tables(spark)
    path = str(tmp_path / "index")
    index_store.write_index(chunks, vectors, path, "m", "float32", 2)
    c, v = index_store.read_index(spark, path, "m", "float32", 2)
    assert c.count() == 2 and v.count() == 2
    for wrong in (("other", "float32", 2), ("m", "int8", 2), ("m", "float32", 3)):
        with pytest.raises(index_store.IndexRefused):
            index_store.read_index(spark, path, *wrong)
    spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.0, 1.0])], "chunk_ord int, embedding array<float>").write.mode("overwrite").parquet(path + "/vectors")
    with pytest.raises(index_store.IndexRefused, match="changed"):
        index_store.read_index(spark, path, "m", "float32", 2)


def test_rows_without_partner_are_refused(spark, tmp_path):
    chunks, vectors = tables(spark)
    path = str(tmp_path / "index")
    index_store.write_index(chunks.limit(1), vectors, path, "m", "float32", 2)
    with pytest.raises(index_store.IndexRefused, match="belong"):
        index_store.read_index(spark, path, "m", "float32", 2)
    index_store.write_index(chunks, vectors, path + "2", "m", "float32", 2)
    spark.createDataFrame([(1, "m", "float32", 2, "x", "")], "version int, model string, dtype string, dim int, vectors_sha256 string, source_sha256 string").write.mode("overwrite").parquet(path + "2/meta")
    with pytest.raises(index_store.IndexRefused, match="version"):
        index_store.read_index(spark, path + "2", "m", "float32", 2)


def test_staleness(spark, tmp_path):
    source = tmp_path / "book.txt"
    source.write_text("one")
    digest = spark.sql("select sha2('one', 256)").first()[0]
    chunks, vectors = tables(spark)
    path = str(tmp_path / "index")
    index_store.write_index(chunks, vectors, path, "m", "float32", 2, digest)
    assert not index_store.is_stale(spark, path, str(source))
    source.write_text("two")
    assert index_store.is_stale(spark, path, str(source))
