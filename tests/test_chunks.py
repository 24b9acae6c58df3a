from pyspark.sql import functions as F

from quernstone.plans import common as C


def test_long_documents_keep_their_tail(spark, tmp_path):
    n = 2100
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x" * 896), n).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = C.chunks(spark, str(tmp_path)).agg(F.count("*"), F.max("chunk_idx")).first()
    assert tuple(found) == (n, n - 1)
