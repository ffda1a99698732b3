"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once a document: its measurements are columns, its
verdicts are bits of one word. A policy is a named, versioned mask; a document
stays if no bit of the policy's mask is set. What each rule alone drops, or what
a policy without one of its rules would keep, follows from the ledger by bitwise
aggregation, without reading a text again.

Cases: null or blank text has no words and fails the least-words rule; repeated
lines, words and windows are counted as the docstrings say; rows may repeat; an
empty table gives an empty ledger; other columns may have any name but those the
ledger adds. Windows are matched by 39 bits of their hash and confirmed word by word; a text
in which two different windows share these bits, or of over 2^24 words, has its windows sorted by their words instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm._shared import SPACE, body

RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > 1.5 * n_words",
    "repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 24 * n_words",
}
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length")}


#: Bits of a window's place in its packed form; texts of more words are sorted by words.
PLACE_BITS = 24


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def window_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def repeated_places(df: DataFrame) -> DataFrame:
    """df with __repeats: places, in order, of the three-word windows of __words that stand there twice or more; __packed has them packed and sorted."""
    w, p, no = F.col("__words"), F.col("__packed"), F.lit(False)
    low = F.lit((1 << PLACE_BITS) - 1)

    def hashed_alike(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftrightunsigned(a, PLACE_BITS) == F.shiftrightunsigned(b, PLACE_BITS), no)

    def same(a: Column, b: Column) -> Column:
        at, to = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        return hashed_alike(a, b) & F.coalesce((F.get(w, at) == F.get(w, to)) & (F.get(w, at + 1) == F.get(w, to + 1)) & (F.get(w, at + 2) == F.get(w, to + 2)), no)

    # Neighbours of one hash and different words: then, as for too many words, all windows are sorted by their words.
    df = df.withColumn("__met", (F.size(w) > 1 << PLACE_BITS) | F.exists(F.transform(p, lambda x, i: hashed_alike(x, F.get(p, i + 1)) & ~same(x, F.get(p, i + 1))), lambda x: x))
    none = F.array().cast("array<struct<a:string,b:string,c:string,i:bigint>>")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("bigint").alias("i")))
    df = df.withColumn("__sorted", F.when(F.col("__met") & (F.size(w) >= 3), F.array_sort(windows)).otherwise(none))
    e = F.col("__sorted")
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), no)
    exact = F.transform(F.filter(e, lambda x, i: equal(x, F.get(e, i + 1)) | ((i > 0) & equal(x, F.get(e, i - 1)))), lambda x: x["i"])
    fast = F.transform(F.filter(p, lambda x, i: same(x, F.get(p, i + 1)) | ((i > 0) & same(x, F.get(p, i - 1)))), lambda x: x.bitwiseAND(low))
    return df.withColumn("__repeats", F.sort_array(F.when(F.col("__met"), exact).otherwise(fast))).drop("__met", "__sorted")


def measured(docs: DataFrame, text: str = "text", hashed=window_hash) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    t = body(text)
    bare = F.regexp_replace(t, SPACE, "")
    # Columns that later ones use more than once, so that each is made once.
    df = docs.withColumn("__words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("__words").cast("bigint")
    df = df.withColumn("n_words", n).withColumn("word_chars", F.length(bare).cast("bigint"))
    df = df.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("bigint"))
    df = df.withColumn("n_lines", F.size("__lines").cast("bigint")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
    w = F.col("__words")
    # A window's hash in the high bits, its place in the low ones: equal windows are neighbours once sorted.
    packed = F.when((F.size(w) < 3) | (F.size(w) > 1 << PLACE_BITS), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(F.shiftrightunsigned(hashed(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS + 1), PLACE_BITS).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn("__packed", F.sort_array(packed))
    df = repeated_places(df)
    r = F.col("__repeats")
    covered = F.aggregate(r, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("at")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3).cast("bigint"), x - s["at"])).alias("n"), x.alias("at")), lambda s: s["n"])
    return df.withColumn("n_repeat_words", F.when(F.size(r) == 0, F.lit(0).cast("bigint")).otherwise(covered)).drop("__words", "__lines", "__packed", "__repeats")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their text, with measurements and the failure bits."""
    bits = F.lit(0)
    for rule, test in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(bit(rule))).otherwise(F.lit(0)))
    return measured(docs, text).withColumn("failed", bits).drop(text)


def apply_policy(rows: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    return rows.withColumn(out, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it drops, and that the policy keeps without it. One pass; a row for each failure word travels."""
    words = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in POLICIES[policy]))).alias("x")
    hit = F.col("failed").bitwiseAND(F.col("x.bit")) != 0
    alone = F.col("failed") == F.col("x.bit")
    return words.select("failed", "n", rules).groupBy("x.rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(alone | (F.col("failed") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = apply_policy(apply_policy(ledger(docs), "base", "base_kept"), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", F.col("failed").alias("failed_bits"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT rid, doc_id, t,
    list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM d
), g AS (
  SELECT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS s, unnest(range(1, len(w) - 1)) AS i
  FROM a WHERE len(w) >= 3
), f AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM f WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN r USING (rid)
), b AS (
  SELECT *,
    CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols > 1.5 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 24 * n_words THEN 16 ELSE 0 END AS INTEGER) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""
