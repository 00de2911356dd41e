"""Written tables, their removal, and bounded samples."""

import os

from pyspark.sql import functions as F

from foliant.llm.storage import cut, release, smallest


def test_cut_and_release(spark):
    df = cut(spark.range(10), "t")
    folder = df._cut_path.removeprefix("file://")
    assert df.count() == 10 and os.path.isdir(folder)
    release(df, None, spark.range(1))
    assert not os.path.exists(folder)


def test_smallest(spark):
    df = spark.range(1000).withColumn("place", F.pmod(F.xxhash64("id"), F.lit(50)))
    places = [r.place for r in smallest(df, "place", 70).collect()]
    assert len(places) == 70
    assert sorted(places) == sorted(r.place for r in df.collect())[:70]
    assert smallest(df.limit(0), "place", 5).count() == 0
    assert smallest(df.limit(3), "place", 5).count() == 3
