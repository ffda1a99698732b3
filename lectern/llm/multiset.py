"""Homomorphic multiset hash of a document's paragraphs, in DataFrame expressions only.

A text is the multiset of its paragraphs (lines, blank ones too). Each is hashed to a
wide vector; the fingerprint is the vectors' sum modulo powers of two, so it
doesn't depend on order, and adding or taking away a paragraph adds or takes away
its vector. A paragraph's vector has its count of one, four residues of its own hashes, which
serve equality, and, for likeness, the count of its clauses and LANES sums of one bit of the clauses'
hashes, two to a word of 32 bits each. A lane's sum, recentred by the count of
clauses, is a random projection of the multiset of clauses: the normed inner product of two
fingerprints estimates how many clauses they share, with a standard error of about 0.1.

Cases: null text is empty and has the zero fingerprint, without a paragraph; two empty texts are
alike; equal texts have equal fingerprints; texts that differ in blank lines differ in their count; no text
has the 2^31 clauses that would make lanes carry; the next document is
found by (doc_id descending, null ids last, the text's hash, text), so ties and repeated rows have
one order; with one document, it is its own next one; an empty table gives an
empty one; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm._shared import body, ranges

WORDS, HALF = 48, 32
LANE_MASK = 1 | 1 << HALF
RESIDUE_BITS = 48
CLAUSES = "(?<=[.!?,;:])[\\x20\\t\\r\\x0B\\f]+|\\n"
ROWS = 1_024


def zero() -> Column:
    return F.lit(0).cast("bigint")


def salted(salt: str):
    """A hash of an element; transform() would take a second argument for the element's place."""
    return lambda x: F.xxhash64(x, F.lit(salt))


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the fingerprint array: counts of paragraphs and clauses, WORDS words of lanes, four residues."""
    empty = F.array().cast("array<string>")
    paragraphs = F.when(text == "", empty).otherwise(F.split(text, "\n", -1))
    clauses = F.filter(F.split(text, CLAUSES, -1), lambda x: x != "")
    df = df.withColumn("__p", paragraphs).withColumn("__c", clauses)
    for c, of, salt in (("__h", "__c", "h"), ("__g", "__c", "g"), ("__q", "__p", "h"), ("__r", "__p", "g")):
        df = df.withColumn(c, F.transform(of, salted(salt)))
    total = lambda a, f: F.aggregate(a, zero(), lambda s, x: s + f(x))
    lanes = [total(F.col("__h" if k < HALF else "__g"), lambda x, k=k % HALF: F.shiftrightunsigned(x, k).bitwiseAND(F.lit(LANE_MASK))) for k in range(WORDS)]
    low, wide = F.lit(2**32 - 1), F.lit(2**RESIDUE_BITS - 1)
    residues = [total(F.col(c), f).bitwiseAND(wide) for c in ("__q", "__r") for f in (lambda x: x.bitwiseAND(low), lambda x: F.shiftrightunsigned(x, 32))]
    return df.withColumn(out, F.array(F.size("__p").cast("bigint"), F.size("__c").cast("bigint"), *lanes, *residues)).drop("__p", "__c", "__h", "__g", "__q", "__r")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint with b's paragraphs added (sign 1) or taken away (-1)."""
    wide = F.lit(2**RESIDUE_BITS - 1)
    return F.zip_with(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), b, lambda x, y: F.when(x["i"] >= WORDS + 2, (x["x"] + F.lit(sign) * y).bitwiseAND(wide)).otherwise(x["x"] + F.lit(sign) * y))


def as_text(fingerprint: Column) -> Column:
    return F.concat_ws("-", F.transform(fingerprint, lambda x: F.lower(F.hex(x))))


def signed_lanes(fingerprint: Column) -> Column:
    """2 x WORDS recentred sums."""
    n = F.get(fingerprint, F.lit(1))
    lane = lambda w, k: 2 * F.shiftrightunsigned(w, k * HALF).bitwiseAND(F.lit(2**HALF - 1)) - n
    return F.flatten(F.transform(F.slice(fingerprint, 3, WORDS), lambda w: F.array(lane(w, 0), lane(w, 1))))


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the share of clauses that two fingerprints have in common, from 0 to 1."""
    df = df.withColumn("__a", signed_lanes(F.col(a))).withColumn("__b", signed_lanes(F.col(b)))
    x, y = F.col("__a"), F.col("__b")
    norm = product(x, x) + product(y, y)
    value = F.when(F.col(a) == F.col(b), F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(2 * product(x, y), norm))))
    return df.withColumn(out, value).drop("__a", "__b")


def with_next(df: DataFrame, carried: list[str]) -> DataFrame:
    """df (doc_id, t, ...) with next_<c> of each carried column: of the document that follows by doc_id descending, the first after the last.

    Ranges of about ROWS rows are sorted apart; the first row of each also goes to the end of the range before it.
    """
    spark = df.sparkSession
    df = df.withColumn("tie", F.xxhash64("t"))
    df, n = ranges(df, ["doc_id", "tie"], F.lit(1), ROWS, nulls_first=True)
    # Descending: the last range comes first, and its greatest id, with the least tie there, is its head.
    heads = df.groupBy("range").agg(F.max("doc_id").alias("head"))
    heads = df.select("range", "doc_id", "tie").join(F.broadcast(heads), "range").where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("range", "head").agg(F.min("tie").alias("least"))
    known = [(r.range, r.head, r.least, (r.range + 1) % n) for r in heads.collect()]  # a row for each range, 65,536 at most
    small = F.broadcast(spark.createDataFrame(known, "range bigint, head bigint, least bigint, before bigint").coalesce(1))
    df = df.join(small, "range")
    first = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("least"))
    own = F.struct(F.col("range").alias("b"), F.lit(0).alias("guest"))
    df = df.withColumn("x", F.explode(F.when(first, F.array(own, F.struct(F.col("before").alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(own))))
    df = df.select("doc_id", "tie", *carried, F.col("x.b").alias("b"), F.col("x.guest").alias("guest"))
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie", "t")
    return df.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)).where("guest = 0").drop("b", "guest", "tie")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text) and its fingerprint array."""
    return with_fingerprint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body().alias("t")), F.col("t"), "fp")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = with_next(fingerprint_documents(docs), ["t", "fp"])
    df = df.withColumn("n_chars", F.length("t").cast("bigint")).withColumn("k", F.floor(F.col("n_chars") / 3).cast("int"))
    df = df.withColumn("edited", F.expr("concat(substring(t, 1, cast(n_chars as int) - k), substring(next_t, 1, k))"))
    df = with_fingerprint(df, F.col("edited"), "efp")
    df = likeness(likeness(df, "fp", "efp", "near_edited"), "fp", "next_fp", "near_next")
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"), "near_edited", "near_next")
