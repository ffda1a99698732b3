"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Token counts are summed by cell (source, language, topic); the cells are raked to
the targets of each margin in turn until every margin is met (TOLERANCE of all tokens), and the ratio of a cell's fitted to its own
tokens gives each of its documents the same calibrated probability,
min(1, scale x ratio). scale is solved so that the expected tokens are the asked
share of all tokens. A row is sampled if its hash falls below its
probability, which needs no state and repeats exactly.

Targets are shares by value of a margin; a margin without targets is tempered:
each value's share of tokens to the power 0.5. Values without a target keep their own
share of the tokens, and targets share the rest. Where cells that hold no tokens make the targets contradict each other, no fit
exists; raking stops after MOST_SWEEPS, and `gap`, the largest error of a margin, says so.

The table of cells comes to the driver if it has at most CELLS rows; a larger one is raked by joins
over written tables, by the same rules.

Cases: null source, language or topic is a value of its own; null text has no
tokens and is sampled with its cell's probability (1 if the whole cell is empty);
rows are drawn by id and text, so different texts of one id are drawn apart; rows that share both, and rows without an id, are each drawn by
their place in the table; an empty table gives an
empty one; extra columns pass through, whatever their names. Cells are aggregated before any shuffle,
so a source that holds a third of all rows is a few rows; a table of at most CELLS cells is
broadcast, so texts stay where they lie, and a larger one is joined by Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm._shared import body, materialize

MARGINS = ("source", "language", "topic")
TEMPER, SHARE, TOLERANCE, MOST_SWEEPS, CELLS, REPEATS = 0.5, 0.6, 1e-9, 500, 100_000, 1_000_000
#: The query's targets; sources are tempered.
TARGETS = {
    "language": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.5, "essay": 0.15, "note": 0.05, "records": 0.1, "tables": 0.05, "markup": 0.05, "contact": 0.05, "licensed": 0.05},
}


def topic(text: Column) -> Column:
    """What a text is about by its form: licence lines, tables, marked-up or contact text, records (numbers in one of twenty characters or more), notes (under 60 code points), essays (4,000 or more), prose."""
    n = F.length(text)
    count = lambda c: n - F.length(F.translate(text, c, ""))
    return (
        F.when(F.contains(text, F.lit("icensed under")), F.lit("licensed"))
        .when(count("|") * 60 > n, F.lit("tables"))
        .when(count("#*$%&<>{}") * 30 > n, F.lit("markup"))
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), F.lit("contact"))
        .when(count("0123456789") * 20 > n, F.lit("records"))
        .when(n < 60, F.lit("note"))
        .when(n >= 4000, F.lit("essay"))
        .otherwise(F.lit("prose"))
    )


def n_tokens(text: Column) -> Column:
    """Words between white space (x20, x09-x0D): each white space but those that follow another, or begin the text, ends a word."""
    spaced = F.concat(F.lit(" "), F.translate(text, "\t\n\x0b\x0c\r", "     "), F.lit(" "))
    return (F.size(F.filter(F.split(spaced, " "), lambda w: w != ""))).cast("bigint")


# --- raking ---------------------------------------------------------------------------------


def goals(had: dict, given: dict | None) -> dict:
    """Tokens that each value of a margin is to have, from the tokens that it has."""
    total = sum(had.values())
    if given is None:
        share = {v: n**TEMPER for v, n in had.items() if n > 0}
        rest = {}
    else:
        share = {v: float(given[v]) for v, n in had.items() if n > 0 and given.get(v, 0) > 0}
        rest = {v: float(n) for v, n in had.items() if v not in given}
    room, norm = total - sum(rest.values()), sum(share.values())
    if not norm:
        return {v: float(n) for v, n in had.items()}
    return {v: 0.0 for v in had} | {v: room * s / norm for v, s in share.items()} | rest


def rake_here(cells: list[tuple], targets: dict[str, dict] | None = None) -> tuple[list[float], float]:
    """Weights of cells (margins' values, tokens) and the largest error of a margin as a share of all tokens."""
    w, total = [float(c[-1]) for c in cells], float(sum(c[-1] for c in cells)) or 1.0

    def sums(k: int, values: list) -> dict:
        out: dict = {}
        for c, x in zip(cells, values, strict=True):
            out[c[k]] = out.get(c[k], 0) + x
        return out

    goal = [goals(sums(k, [c[-1] for c in cells]), (targets or {}).get(m)) for k, m in enumerate(MARGINS)]
    gap = 0.0
    for _ in range(MOST_SWEEPS):
        gap = 0.0
        for k in range(len(MARGINS)):
            had = sums(k, w)
            gap = max([gap, *(abs(had[v] - goal[k][v]) / total for v in had)])
            w = [x * (goal[k][c[k]] / had[c[k]] if had[c[k]] > 0 else 0.0) for c, x in zip(cells, w, strict=True)]
        if gap < TOLERANCE:
            break
    return w, gap


def scale_here(cells: list[tuple], w: list[float], share: float) -> float:
    """scale so that the tokens of all cells times min(1, scale x ratio) are the asked share: the cells of the largest ratios are full."""
    total = sum(c[-1] for c in cells)
    some = sorted(((x / c[-1], c[-1], x) for c, x in zip(cells, w, strict=True) if c[-1] > 0), reverse=True)
    full, loose = 0.0, sum(x for _, _, x in some)
    scale = 0.0
    for ratio, tokens, x in some:
        scale = (share * total - full) / loose if loose > 1e-12 * total else float("inf")
        if scale * ratio <= 1:
            break
        full, loose = full + tokens, loose - x
    return scale


def rake_spread(cells: DataFrame, targets: dict[str, dict] | None = None) -> tuple[DataFrame, float]:
    """rake_here() over a table of cells too large for the driver: cells with w, and the gap."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    df, goal = materialize(cells.withColumn("w", F.col("tokens").cast("double")), "cells"), {}
    for m in MARGINS:
        had, given = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").cast("double").alias("n")), (targets or {}).get(m)
        if given is None:
            t = had.withColumn("share", F.when(F.col("n") > 0, F.pow("n", F.lit(TEMPER)))).withColumn("rest", F.lit(None).cast("double"))
        else:
            asked = spark.createDataFrame([(k, float(v)) for k, v in given.items()], "of string, asked double")
            t = had.join(F.broadcast(asked), F.col("value").eqNullSafe(F.col("of")), "left").withColumn("share", F.when((F.col("n") > 0) & (F.col("asked") > 0), F.col("asked"))).withColumn("rest", F.when(F.col("of").isNull(), F.col("n")))
        t = materialize(t.select("value", "n", "share", "rest"), "shares")
        norm, rest = t.agg(F.sum("share"), F.coalesce(F.sum("rest"), F.lit(0.0))).first()
        value = F.coalesce("rest", F.col("share") * ((total - rest) / norm), F.lit(0.0)) if norm else F.col("n")
        goal[m] = materialize(t.select("value", value.alias("goal")), "goals")
    gap = 0.0
    for _ in range(MOST_SWEEPS):
        gap = 0.0
        for m in MARGINS:
            sums = materialize(df.groupBy(F.col(m).alias("value")).agg(F.sum("w").alias("had")).join(goal[m].withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v"))).select("value", "had", "goal"), "sums")
            gap = max(gap, sums.agg(F.max(F.abs(F.col("had") - F.col("goal")))).first()[0] / total)
            factor = sums.select("value", F.when(F.col("had") > 0, F.col("goal") / F.col("had")).otherwise(0.0).alias("f"))
            df = materialize(df.join(factor, F.col(m).eqNullSafe(F.col("value"))).select(*MARGINS, "tokens", (F.col("w") * F.col("f")).alias("w")), "cells")
        if gap < TOLERANCE:
            break
    return df, gap


def scale_spread(df: DataFrame, share: float) -> float:
    """scale_here() by steps that only rise: the cells that one scale fills set the next."""
    df = df.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")))
    total, fitted = df.agg(F.sum("tokens"), F.sum("w")).first()
    scale = share * float(total or 0) / float(fitted or 1)
    while True:
        full = F.col("ratio") * scale >= 1
        capped, loose = df.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("w")))).first()
        new = (share * float(total or 0) - float(capped or 0)) / float(loose) if loose else scale
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new


def calibrated(cells: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE, most: int = CELLS) -> tuple[DataFrame, float]:
    """Cells (margins, tokens) with w and probability, and the gap of the fit."""
    probability = lambda ratio, scale: F.when(F.col("tokens") > 0, F.least(F.lit(1.0), ratio * scale)).otherwise(1.0)
    if cells.count() > most:
        df, gap = rake_spread(cells, targets)
        return df.withColumn("probability", probability(F.col("w") / F.col("tokens"), scale_spread(df, share))), gap
    here = [(*(r[m] for m in MARGINS), r.tokens) for r in cells.collect()]  # at most `most` rows
    w, gap = rake_here(here, targets)
    scale = scale_here(here, w, share)
    rows = [(*c, x, min(1.0, x / c[-1] * scale) if c[-1] and x else 0.0 if c[-1] else 1.0) for c, x in zip(here, w, strict=True)]
    table = cells.sparkSession.createDataFrame(rows, ", ".join(f"{m} string" for m in MARGINS) + ", tokens bigint, w double, probability double").coalesce(1)
    return table, gap


# --- documents ---------------------------------------------------------------------------------


def keyed(docs: DataFrame, names: dict[str, Column] | None = None) -> DataFrame:
    """row (all columns of docs), the margins, tokens and the row's draw, uniform from 0 to 1; rows that share id and text are told apart by their place in the table."""
    names = names or {"source": F.col("source"), "language": F.col("lang"), "topic": topic(body())}
    key = F.xxhash64("doc_id", F.xxhash64(body()))
    twice = materialize(docs.where("doc_id is not null").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("again")), "repeats")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *(names[m].cast("string").alias(m) for m in MARGINS), n_tokens(body()).alias("tokens"), key.alias("key"), F.monotonically_increasing_id().alias("place"))
    rows = rows.join(F.broadcast(twice) if twice.count() <= REPEATS else twice, "key", "left")
    place = F.when(F.col("row.doc_id").isNull() | F.col("again"), F.col("place"))
    draw = F.shiftrightunsigned(F.xxhash64("key", place, F.lit("mix")), 11) * F.lit(2.0**-53)
    return rows.select("row", *MARGINS, "tokens", draw.alias("draw"))


def mixed(rows: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE) -> DataFrame:
    """Rows of keyed() with probability and sampled."""
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    small = cells.count() <= CELLS
    table, _ = calibrated(cells, targets, share)
    # Nulls are values: the key of a cell is made so that an equi-join finds them.
    key = F.to_json(F.array(*MARGINS)).alias("cell")
    return rows.withColumn("cell", key).join(table.select(key, "probability").hint("broadcast") if small else table.select(key, "probability"), "cell").drop("cell").withColumn("sampled", F.col("draw") < F.col("probability"))


def mix_documents(docs: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE, names: dict[str, Column] | None = None) -> DataFrame:
    """row (all columns of docs), the margins, tokens, draw, probability and sampled."""
    return mixed(keyed(docs, names), targets, share)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = materialize(keyed(docs).select(F.col("row.doc_id").alias("doc_id"), *MARGINS, "tokens", "draw"), "keyed")  # texts are read once
    return mixed(rows, TARGETS).select("doc_id", *MARGINS, F.col("tokens").alias("n_tokens"), "probability", "sampled")


def sample_documents(docs: DataFrame, targets: dict[str, dict] | None = None) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    return mix_documents(docs, TARGETS if targets is None else targets).where("sampled").select("row.*")
