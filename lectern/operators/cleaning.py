"""Audit and cleaning of question and answer rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lectern.functions.text import blank, clean_answer, clean_question, words

MOST_WORDS, COLLECTED = 20, 10_000


def first_answer(rows: DataFrame) -> DataFrame:
    """A1: answer and num_answers from an array of answers."""
    return rows.withColumn("answer", F.coalesce(F.get("answers", F.lit(0)), F.lit(""))).withColumn("num_answers", F.coalesce(F.size("answers"), F.lit(0)))


def audit(rows: DataFrame) -> DataFrame:
    """Count and percentage of seven issues of (answer, num_answers), in one pass and one count of distinct answers."""
    a = F.coalesce("answer", F.lit(""))
    tests = {
        "empty": blank(a),
        "non_ascii": a.rlike("[^\\x00-\\x7F]"),
        "long": F.size(words(a)) > MOST_WORDS,
        "numeric": a.rlike("(?U)^[\\d\\s.,%]+$"),
        "multiple_answers": F.col("num_answers") > 1,
        "white_space": a.rlike("(?U)\\s{2}"),
    }
    one = rows.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count_distinct(a)).alias("duplicate"), *(F.count_if(t).alias(k) for k, t in tests.items()))
    items = F.array(*(F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in [*tests, "duplicate"]))
    return one.select("total", F.explode(items).alias("x")).select("x.issue", "x.n", F.coalesce(F.try_divide(100.0 * F.col("x.n"), F.col("total")), F.lit(0.0)).alias("percent"))


def cleaned(rows: DataFrame) -> DataFrame:
    """Cleaned (row_id, question, answer): no empty or long answers, the first row of each pair."""
    c = rows.select("row_id", clean_question(F.col("question")).alias("question_clean"), clean_answer(F.col("answer")).alias("answer_clean"))
    c = c.where((F.col("answer_clean") != "") & (F.size(words(F.col("answer_clean"))) <= MOST_WORDS))
    return c.groupBy("question_clean", "answer_clean").agg(F.min("row_id").alias("row_id"))


def removed(rows: DataFrame) -> DataFrame:
    """Rows left after each step."""
    c = rows.select(clean_question(F.col("question")).alias("q"), clean_answer(F.col("answer")).alias("a"))
    filled, short = F.col("a") != "", F.size(words(F.col("a"))) <= MOST_WORDS
    one = c.agg(F.count(F.lit(1)).alias("rows"), F.count_if(filled).alias("filled"), F.count_if(filled & short).alias("short"), F.count_distinct(F.when(filled & short, F.struct("q", "a"))).alias("distinct"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(k).alias("n")) for k in ("rows", "filled", "short", "distinct")))).alias("x")).select("x.step", "x.n")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Values by falling count, with their share."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("__total")))  # one row
    return counts.crossJoin(total).withColumn("share", F.col("n").cast("double") / F.col("__total")).drop("__total").orderBy(F.desc("n"), column)


def histogram(rows: DataFrame, value: str, most: int) -> DataFrame:
    """A4: counts of a value clipped to most."""
    return rows.groupBy(F.least(F.col(value), F.lit(most)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(rows: DataFrame, value: str, probabilities: list[float], most: int = COLLECTED, accuracy: int = 10_000) -> list[float | None]:
    """A5, A10: exact quantiles with linear interpolation, by selection: no task, nor the driver, holds more than a summary of the values, and `most` of them for each rank.

    A quantile lies between the values of two ranks. For each rank an approximate summary gives two values that enclose it, and one pass counts the rows
    below, at and between them. If the rank falls on one of the two, it is found, however many rows are equal; else the search goes on strictly
    between them, where a small part of the rows is left. Nulls don't count; no rows give nulls.
    """
    v = F.col(value).cast("double")
    rows = rows.where(F.col(value).isNotNull()).select(v.alias("v"))
    n = rows.count()
    if n == 0:
        return [None] * len(probabilities)
    ranks = sorted({r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    known: dict[int, float] = {}
    # What encloses a rank: open ends, the rows up to the lower one, and the rows between.
    open_: dict[int, tuple[float | None, float | None, int, int]] = {r: (None, None, 0, n) for r in ranks}
    inside = lambda low, high: F.lit(True) & (F.lit(True) if low is None else F.col("v") > low) & (F.lit(True) if high is None else F.col("v") < high)
    while open_:
        few = {r: x for r, x in open_.items() if x[3] <= most}
        for low, high, before, _ in set(few.values()):
            values = [x.v for x in rows.where(inside(low, high)).orderBy("v").collect()]  # `most` at most
            known |= {r: values[r - before] for r, x in few.items() if x[:3] == (low, high, before)}
        open_ = {r: x for r, x in open_.items() if r not in few}
        if not open_:
            break
        cuts = [F.percentile_approx(F.when(inside(low, high), F.col("v")), F.array(*(F.lit(min(1.0, max(0.0, (r - before) / held + d / accuracy))) for d in (-2, 2))), accuracy).alias(str(r)) for r, (low, high, before, held) in open_.items()]
        found = rows.agg(*cuts).first()
        counts = []
        for r, (low, high, _, _) in open_.items():
            a, b = found[str(r)]
            counts += [F.count_if(inside(low, high) & t).alias(f"{r}_{k}") for k, t in (("below", F.col("v") < a), ("at", F.col("v") == a), ("between", (F.col("v") > a) & (F.col("v") < b)), ("top", F.col("v") == b))]
        counted, next_ = rows.agg(*counts).first(), {}
        for r, (low, high, before, held) in open_.items():
            a, b = found[str(r)]
            below, at, between, top = (counted[f"{r}_{k}"] for k in ("below", "at", "between", "top"))
            place = r - before
            if place < below:
                next_[r] = (low, a, before, below)
            elif place < below + at:
                known[r] = a
            elif place < below + at + between:
                next_[r] = (a, b, before + below + at, between)
            elif a != b and place < below + at + between + top:
                known[r] = b
            else:
                done = below + at + (between + top if a != b else 0)
                next_[r] = (b, high, before + done, held - done)
        open_ = next_
    out = []
    for p in probabilities:
        x = p * (n - 1)
        low, high = known[math.floor(x)], known[math.ceil(x)]
        out.append(low + (high - low) * (x - math.floor(x)) if high != low else low)
    return out


def describe(rows: DataFrame, value: str) -> DataFrame:
    """A5, A10: count, mean, sample deviation, least, quartiles (exact, linear), most; two places."""
    r = lambda c: F.bround(c, 2)
    q1, median, q3 = (r(F.lit(x).cast("double")) for x in exact_quantiles(rows, value, [0.25, 0.5, 0.75]))
    return rows.agg(F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.stddev_samp(value)).alias("std"), F.min(value).alias("least"), q1.alias("q1"), median.alias("median"), q3.alias("q3"), F.max(value).alias("most"))


def starters(rows: DataFrame, text: str, n: int = 8) -> DataFrame:
    """The n most common first words."""
    first = F.get(words(F.lower(F.col(text))), F.lit(0)).alias("word")
    return rows.select(first).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)
