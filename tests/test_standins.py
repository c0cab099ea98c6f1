import hashlib
from collections import Counter

from pyspark.sql import functions as F

from checks import standins


def plain(text):
    counts = Counter(int(hashlib.md5(word.encode()).hexdigest()[:3], 16) >> 2 for word in text.split(" "))
    return bytes(255 * counts[c] // max(counts.values()) for c in range(standins.SIDE**2))


def test_pixels_come_from_cells_and_not_from_texts(spark):
    """Python gets two bytes a word, in parts of a batch, whatever the texts' length."""
    texts = ["", " ", "a", "é a  a", *(" ".join(f"w{j % (i + 1)}" for j in range(i * 7)) for i in range(1, 300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    assert df.select(standins.cells(F.col("text")).alias("c")).schema["c"].dataType.simpleString() == "array<smallint>"
    got = df.select("id", standins.raster(standins.cells(F.col("text"))).alias("data")).collect()
    assert {r.id: bytes(r.data) for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of many splits whose rows lie in one row group is read by one task: its rows are dealt out."""
    import os

    from pyspark.sql import functions as F

    from framewright.session import spread

    path = str(tmp_path / "one")
    spark.range(4000).withColumn("text", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(path)
    size = max(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path))
    cores = spark.sparkContext.defaultParallelism
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(size // (2 * cores)))
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= cores
        assert scan.select(F.spark_partition_id()).distinct().count() == 1
        dealt = spread(scan, "id")
        assert dealt.select(F.spark_partition_id()).distinct().count() >= cores
        assert sorted(r["id"] for r in dealt.collect()) == list(range(4000))
    finally:
        spark.conf.set(key, before)
    even = spark.range(4000, numPartitions=2 * cores)
    assert spread(even, "id") is even
    none = spark.range(0, numPartitions=2 * cores)
    assert spread(none, "id").count() == 0
