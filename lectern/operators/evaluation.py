"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KS = (1, 3, 5)


def ranks(retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question (qid) hit_at_k and first_correct_rank, from (qid, rank, match); a question without results is a miss."""
    first = retrieved.groupBy("qid").agg(F.min(F.when(F.col("match"), F.col("rank"))).alias("first_correct_rank"))
    out = questions.select("qid").join(first, "qid", "left")
    return out.withColumns({f"hit_at_{k}": F.coalesce(F.col("first_correct_rank") <= k, F.lit(False)) for k in KS})


def recall(per_question: DataFrame) -> DataFrame:
    """A row for each k."""
    n = F.count(F.lit(1))
    one = per_question.agg(n.alias("total"), *(F.count_if(F.col(f"hit_at_{k}")).alias(f"h{k}") for k in KS))
    return one.select("total", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in KS))).alias("x")).select("x.k", "x.hits", "total", F.coalesce(F.try_divide(F.col("x.hits").cast("double"), F.col("total")), F.lit(0.0)).alias("recall"))


def reciprocal(rank: Column) -> Column:
    """E7."""
    return F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Null where either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def available(questions: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """E5: chunks on each question's expected page, 0 if there are none."""
    return questions.join(chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks_available")), keys, "left").withColumn("chunks_available", F.coalesce("chunks_available", F.lit(0)).cast("bigint"))


def compare_single(full: DataFrame, single: DataFrame) -> DataFrame:
    """Per question, ranks in the full and in the own-document index."""
    f, s = F.col("full_rank"), F.col("single_rank")
    both = full.select("qid", F.col("first_correct_rank").alias("full_rank")).join(single.select("qid", F.col("first_correct_rank").alias("single_rank")), "qid")
    return both.withColumn("rank_improvement", (F.coalesce(f, F.lit(99)) - F.coalesce(s, F.lit(99))).cast("bigint")).withColumn("cross_document_interference", s.isNotNull() & (f.isNull() | F.coalesce(f > s, F.lit(False))))


def single_summary(compared: DataFrame) -> DataFrame:
    """How many questions rank better in their own document's index, and how many it misses, too."""
    return compared.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("rank_improvement") > 0).alias("improved"), F.count_if(F.col("single_rank").isNull()).alias("still_missing"))


def miss_list(per_question: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Questions without a match among the retrieved, with what was retrieved instead, by rank."""
    got = retrieved.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"))
    return per_question.where("not hit_at_5").select("qid").join(got, "qid", "left")


def buckets(rows: DataFrame, retrieved: str, answered: str) -> DataFrame:
    """Counts and shares of the four outcomes, all present."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(True, True, "both correct"), (True, False, "retrieval only"), (False, True, "answer only"), (False, False, "both wrong")], "r boolean, a boolean, bucket string")
    counts = rows.groupBy(F.col(retrieved).alias("r"), F.col(answered).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    out = names.join(counts, ["r", "a"], "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy())), F.lit(0.0)))  # four rows


def method_summary(rows: DataFrame, methods: list[str]) -> DataFrame:
    """Means by method, turned: a row for each method."""
    parts = []
    for m in methods:
        parts.append(F.struct(F.lit(m).alias("method"), F.avg(F.col(f"{m}_extraction_time_sec") + F.col(f"{m}_pipeline_time_sec")).alias("mean_total_sec"), F.avg(f"{m}_exact_match").alias("mean_exact_match"), F.avg(f"{m}_token_f1").alias("mean_token_f1"), F.avg(f"{m}_manual_quality").alias("mean_manual_quality")))
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's part of the total; keys that begin with "0." are left out."""
    sums = rows.where(~F.col(key).startswith("0.")).groupBy(key).agg(F.sum(value).alias("amount"))
    total = F.broadcast(sums.agg(F.sum("amount").alias("__total")))  # one row
    return sums.crossJoin(total).withColumn("share", F.try_divide(F.col("amount").cast("double"), F.col("__total"))).drop("__total")
