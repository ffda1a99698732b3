"""Line filter for first pages, as one expression over an array of lines, so no line leaves its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import flags_of_trimmed, trimmed

MOST_DROPPED, RUN = 0.7, 3
LINE_END = "\\R|[\\x1c-\\x1e]"


def lines_of(text: Column) -> Column:
    """Lines as they are, without one empty line after a last line end."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def flagged(text: Column) -> Column:
    """Array of (line, blank, bad, name, run): bad by B1 to B5, run by B7 the length of the run of name lines that it stands in."""
    return with_runs(flags_of(text))


def flags_of(text: Column) -> Column:
    """Array of (line, blank, bad, name)."""
    rows = F.transform(lines_of(text), lambda x: F.struct(x.alias("line"), trimmed(x).alias("t")))
    rows = F.transform(rows, lambda r: F.struct(r["line"].alias("line"), flags_of_trimmed(r["t"]).alias("f"), (r["t"] == "").alias("blank")))
    return F.transform(rows, lambda r: F.struct(r["line"].alias("line"), r["blank"].alias("blank"), (r["f"]["email"] | r["f"]["orcid"] | r["f"]["institution"] | r["f"]["initials"] | r["f"]["authors"]).alias("bad"), r["f"]["name"].alias("name")))


def with_runs(rows: Column) -> Column:
    """rows with run: a mark for each line, cut into runs of one mark, so the work grows with the lines alone."""
    marks = F.array_join(F.transform(rows, lambda r: F.when(r["name"], "1").otherwise("0")), "")
    runs = F.regexp_extract_all(marks, F.lit("1+|0+"), F.lit(0))
    runs = F.flatten(F.transform(runs, lambda m: F.array_repeat(F.when(m.startswith("1"), F.length(m)).otherwise(0), F.length(m))))
    return F.zip_with(rows, runs, lambda r, n: F.struct(r["line"].alias("line"), r["blank"].alias("blank"), r["bad"].alias("bad"), r["name"].alias("name"), n.alias("run")))


def title_of(rows: Column) -> Column:
    """Place, from 1, of the first line that isn't blank."""
    return F.array_position(F.transform(rows, lambda r: ~r["blank"]), True)


def dropped(rows: Column, title: Column | None = None) -> Column:
    """Array of booleans: lines that go; the first line that isn't blank (the title) never does. Given as a column, the title is found once, not for each line."""
    title = title_of(rows) if title is None else title
    return F.transform(rows, lambda r, i: (r["bad"] | (r["run"] >= RUN)) & (i + 1 != title))


def strip_boilerplate(text: Column) -> Column:
    """The text without its dropped lines; as it was if none goes, or more than seven in ten would."""
    rows = flagged(text)
    return kept_text(text, rows, dropped(rows))


def kept_text(text: Column, rows: Column, gone: Column) -> Column:
    n = F.size(F.filter(gone, lambda g: g))
    filled = F.size(F.filter(rows, lambda r: ~r["blank"]))
    kept = F.filter(F.zip_with(rows, gone, lambda r, g: F.when(~g, r["line"])), lambda x: x.isNotNull())
    return F.when((n == 0) | (n / F.greatest(filled, F.lit(1)) > MOST_DROPPED), text).otherwise(F.array_join(kept, "\n"))


def strip_pages(df: DataFrame, text: str, where: Column) -> DataFrame:
    """strip_boilerplate() of a column on the rows where the condition holds; lines, flags and runs are columns, so that each is made once."""
    df = df.withColumn("__flags", F.when(where, flags_of(F.col(text)))).withColumn("__rows", with_runs(F.col("__flags")))
    df = df.withColumn("__title", title_of(F.col("__rows")))
    df = df.withColumn("__gone", dropped(F.col("__rows"), F.col("__title")))
    return df.withColumn(text, F.when(where, kept_text(F.col(text), F.col("__rows"), F.col("__gone"))).otherwise(F.col(text))).drop("__flags", "__rows", "__title", "__gone")
