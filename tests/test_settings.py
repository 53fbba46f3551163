"""Typed settings values."""

from pyspark.sql import functions as F

from pixelquarry.sources import settings


def test_typed_values(spark):
    texts = ["1 2 3 4", " 9 8 -3 +4 tail", "1 2 3", "", None, "12", "5-6 7", "300 -1 256", "99999999999 1 1 1", "a 1 2 3"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, set_value string")
    got = {r.i: (tuple(r.rect), tuple(r.size), tuple(r.color)) for r in rows.select("i", settings.as_rect((0, 0, 0, 0)).alias("rect"), settings.as_size((7, 8)).alias("size"), settings.as_color((1, 2, 3)).alias("color")).collect()}
    rect, size, color = (0, 0, 0, 0), (7, 8), (1, 2, 3)
    assert got[0] == ((1, 2, 3, 4), (1, 2), (1, 2, 3)) and got[1] == ((-3, 4, 9, 8), (9, 8), (9, 8, 253))
    assert got[2] == (rect, (1, 2), (1, 2, 3)) and got[3] == got[4] == got[5] == got[9] == (rect, size, color)
    assert got[6] == (rect, (5, 1), (5, 250, 7)) and got[7] == (rect, (300, 1), (44, 255, 0)) and got[8] == (rect, size, color)
    assert rows.select(F.lit(1)).count() == 10
