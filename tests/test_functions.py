import os.path
import random

import pytest
from pyspark.sql import functions as F

from captionforge.functions.text import basename, extension, output_path, srt_timestamp, strip_text

STAMPS = [
    (None, "00:00:00,000"), (-1.0, "00:00:00,000"), (0.0, "00:00:00,000"), (0.0005, "00:00:00,000"), (0.0015, "00:00:00,002"), (0.0025, "00:00:00,002"), (1.0005, "00:00:01,000"),
    (59.9994, "00:00:59,999"), (59.9996, "00:01:00,000"), (3599.9996, "01:00:00,000"), (359999.9996, "100:00:00,000"), (400000.25, "111:06:40,250"),
]


def test_timestamps(spark):
    rows = spark.createDataFrame(STAMPS, "v double, want string").select("want", srt_timestamp(F.col("v")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_timestamps_against_a_model(spark):
    def model(v):
        whole = int(v)
        ms = whole * 1000 + round((v - whole) * 1000)
        return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"

    values = [k / 2000 for k in range(4001)] + [random.Random(1).uniform(0, 1e5) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", srt_timestamp(F.col("v")).alias("got")).collect()
    assert all(r.got == model(r.v) for r in rows)


def test_strip_takes_every_space(spark):
    texts = [chr(c) + "a b" + chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["", " \n\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_text(F.col("t")).alias("got")).collect()
    assert [r.t for r in rows if r.got != r.t.strip()] == []
    assert spark.range(1).select(strip_text(F.lit(None).cast("string"))).first()[0] == ""


@pytest.mark.parametrize("path", ["/a/b.mp4", "/a/b.c.mkv", "/a/.x", "/a.b/c", "x", "/a/b.", "s3://k/é.wav"])
def test_paths(spark, path):
    row = spark.createDataFrame([(path,)], "p string").select(output_path(F.col("p")).alias("o"), basename(F.col("p")).alias("b"), extension(F.col("p")).alias("e")).first()
    stem, ext = os.path.splitext(path)
    assert (row.o, row.b, row.e) == (stem + ".srt", os.path.basename(path), ext.lower())
