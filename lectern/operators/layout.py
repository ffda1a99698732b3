"""I4: reading order of OCR detections, as one fold."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def reorder_by_layout(detections: Column, tolerance: float = 15) -> Column:
    """Text of detections (box of four corners, text, confidence): rows of boxes whose height is within the tolerance of the row's first, left to right, rows top down."""
    keyed = F.transform(detections, lambda d, i: F.struct(((d["box"][0][1] + d["box"][1][1]) / 2).alias("y"), i.alias("i"), d["box"][0][0].alias("x"), d["text"].alias("text")))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("row"), F.array().cast("array<struct<row:int,x:double,i:int,text:string>>").alias("out"))

    def place(s: Column, d: Column) -> Column:
        same = F.coalesce(F.abs(d["y"] - s["y"]) <= tolerance, F.lit(False))
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(F.when(same, s["y"]).otherwise(d["y"]).alias("y"), row.alias("row"), F.concat(s["out"], F.array(F.struct(row.alias("row"), d["x"].cast("double").alias("x"), d["i"].alias("i"), d["text"].alias("text")))).alias("out"))

    placed = F.array_sort(F.aggregate(F.array_sort(keyed), start, place)["out"])
    joined = F.aggregate(placed, F.struct(F.lit(0).alias("row"), F.lit("").alias("s")), lambda s, d: F.struct(d["row"].alias("row"), F.when(s["s"] == "", d["text"]).otherwise(F.concat(s["s"], F.when(d["row"] == s["row"], " ").otherwise("\n"), d["text"])).alias("s")))
    return F.coalesce(joined["s"], F.lit(""))
