"""Self-checks of a store and drafting of ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import normalise_probe, words
from lectern.operators.vectors import few, knn

WINDOW, BLOCK = 15, 4096


def consistent(left: DataFrame, right: DataFrame) -> DataFrame:
    """H1, H3: rows of either table that the other lacks, with the side they are on; none if a round trip lost nothing."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def probes(chunks: DataFrame, id_: str, doc: str, n: int = 40, seed: int = 0) -> DataFrame:
    """H2: n ids by the order of their hash, each document's first, the first and the last of all."""
    some = chunks.select(F.col(id_).alias("id")).orderBy(F.md5(F.concat_ws("-", F.col(id_).cast("string"), F.lit(str(seed))).cast("binary")), id_).limit(n)
    return some.union(chunks.groupBy(doc).agg(F.min(id_)).select(f"min({id_})")).union(chunks.agg(F.min(id_))).union(chunks.agg(F.max(id_))).distinct()


def boundaries(chunks: DataFrame, doc: str, position: str) -> DataFrame:
    """H4."""
    return chunks.groupBy(doc).agg(F.min(position).alias("first_position"))


def targets(questions: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """H5: per question the first chunk on its page whose text holds the answer, else the first."""
    a = normalise_probe(F.col("answer"))
    holds = (a != "") & F.contains(normalise_probe(F.col("chunk")), a)
    best = F.min(F.struct((~holds).alias("no"), "position", "chunk"))
    return questions.join(chunks, keys).groupBy("qid").agg(best.alias("x")).select("qid", "x.position", (~F.col("x.no")).alias("contains_answer"), "x.chunk")


def mid_slice(w: Column) -> Column:
    """H6: fifteen words around the middle."""
    return F.array_join(F.slice(w, F.greatest(F.lit(0), F.floor(F.size(w) / 2).cast("int") - 7) + 1, WINDOW), " ")


def best_window(df: DataFrame, w: str, answer: str, out: str) -> DataFrame:
    """H7: the first fifteen-word window with most distinct words of the answer (arrays of words)."""
    a, n = F.array_distinct(F.col(answer)), F.size(w)
    starts = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    best = F.array_max(F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(F.slice(F.col(w), s + 1, WINDOW), a)).alias("n"), (-s).alias("s"))))
    df = df.withColumn("__b", best)
    return df.withColumn(out, F.array_join(F.slice(F.col(w), 1 - F.col("__b.s"), WINDOW), " ")).withColumn(f"{out}_overlap", F.col("__b.n")).drop("__b")


def lift_sentence(text: Column, anchor: Column) -> Column:
    """The sentence around the anchor's first place, or 180 characters to either side; null if the anchor isn't there."""
    at = F.position(anchor, text)
    end = at + F.length(anchor)  # the place after the anchor, from 1
    back = F.position(F.lit(" ."), F.reverse(F.substring(text, F.lit(1), at - 1)))
    left = F.when(back > 0, at - back - 1)  # the place of the dot, from 1
    ahead = F.position(F.lit(". "), F.substring(text, end, F.length(text)))
    right = F.when(ahead > 0, end + ahead - 1)
    start = F.greatest(at - 180, F.lit(1))
    return F.when((at > 0) & (right - left < 600), F.substring(text, left + 2, right - left - 1)).when(at > 0, F.substring(text, start, F.least(end + 179, F.length(text)) - start + 1))


def occurrences(texts: DataFrame, anchors: DataFrame, id_: str, text: str, anchor_id: str, anchor: str) -> DataFrame:
    """(anchor's id, row's id) wherever a row's text contains an anchor: one pass of an automaton over the texts for each block of anchors."""
    out = None
    n = anchors.count()
    parts = max(1, -(-n // BLOCK))
    for k in range(parts):
        rows = anchors if parts == 1 else anchors.where(F.pmod(F.xxhash64(anchor_id), F.lit(parts)) == k)
        table = rows.where(F.col(anchor) != "").select(anchor_id, anchor).toArrow()
        sent = texts.sparkSession.sparkContext.broadcast((table[anchor_id].to_pylist(), table[anchor].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            tree, by = ahocorasick.Automaton(), {}
            for i, a in zip(*sent.value, strict=True):
                by.setdefault(a, []).append(i)
            for a in by:
                tree.add_word(a, a)
            if by:
                tree.make_automaton()
            for batch in few(batches):
                hits = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if by and t:
                        hits += [(q, i) for a in {a for _, a in tree.iter(t)} for q in by[a]]
                yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in hits], pa.int64()) for j in (0, 1)], names=["anchor_id", "row_id"])

        found = texts.select(id_, text).mapInArrow(run, "anchor_id bigint, row_id bigint")
        out = found if out is None else out.unionAll(found)
    return out


def other_pages(anchors: DataFrame, pages: DataFrame, per_row: int = 256) -> DataFrame:
    """Anchors (anchor_id, source_file, page, anchor) with other_pages, the other pages of their own file that hold the anchor, in order; none for an empty anchor.

    A file's anchors go to its pages in arrays of at most per_row, so an anchor meets no other file's text, and a page's text is sent once for so many anchors.
    """
    order = Window.partitionBy("source_file").orderBy("anchor_id", "page")
    some = anchors.where(F.col("anchor") != "").withColumn("__block", F.floor((F.row_number().over(order) - 1) / per_row))
    asked = some.groupBy(F.col("source_file").alias("__file"), "__block").agg(F.collect_set("anchor").alias("__anchors"))
    met = pages.select("source_file", F.col("page").alias("__other"), "text").join(asked, F.col("source_file").eqNullSafe(F.col("__file")))
    hits = met.select("source_file", "__other", F.explode(F.expr("filter(__anchors, a -> contains(text, a))")).alias("anchor")).distinct()
    same = F.col("a.source_file").eqNullSafe(F.col("h.source_file")) & (F.col("a.anchor") == F.col("h.anchor")) & ~F.col("a.page").eqNullSafe(F.col("h.__other"))
    found = anchors.alias("a").join(hits.alias("h"), same, "left")
    return found.groupBy("a.anchor_id", "a.source_file", "a.page", "a.anchor").agg(F.sort_array(F.collect_list("h.__other")).alias("other_pages"))


def differing(left: DataFrame, right: DataFrame, key: str, bits: int = 12) -> DataFrame:
    """H1, H3: (key, kind) of rows that two tables don't share: lost (left alone has the key), added (right alone), or changed (other values, or another number of equal rows).

    Each side is summed up to digests of ranges of the keys' hashes: rows, and sums of two hashes of whole rows, which don't depend on the rows' order. Ranges whose digests
    agree are left alone; those that differ are cut again into 2^bits, and only rows of ranges that still differ are compared.
    """
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        raise ValueError("the tables must have the same columns")

    def side(df: DataFrame) -> DataFrame:
        rows = df.select(*columns)
        row = F.struct(*columns)
        h = F.xxhash64(key)
        return rows.select(F.col(key).alias("__key"), F.shiftrightunsigned(h, 64 - bits).alias("__range"), F.shiftrightunsigned(h, 64 - 2 * bits).alias("__part"), F.xxhash64(row).alias("__x"), F.xxhash64(F.lit(1), row).alias("__y"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("__whole"))

    def digests(rows: DataFrame, by: str) -> DataFrame:
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), total("__x").alias("x"), total("__y").alias("y"))

    def apart(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
        same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.y").eqNullSafe(F.col("b.y"))
        return digests(a, by).alias("a").join(digests(b, by).alias("b"), F.col(f"a.{by}") == F.col(f"b.{by}"), "full").where(~same).select(F.coalesce(f"a.{by}", f"b.{by}").alias(by))

    a, b = side(left), side(right)
    for by in ("__range", "__part"):
        # At most 2^bits ranges are broadcast: where none differs, the rows aren't read again.
        some = F.broadcast(apart(a, b, by)) if by == "__range" else apart(a, b, by)
        a, b = a.join(some, by, "left_semi"), b.join(some, by, "left_semi")
    rows = a.withColumn("__of", F.lit(1)).union(b.withColumn("__of", F.lit(-1)))
    each = rows.groupBy("__key", "__whole").agg(F.sum("__of").alias("d"), F.bool_or(F.col("__of") > 0).alias("l"), F.bool_or(F.col("__of") < 0).alias("r"))
    keys = each.groupBy("__key").agg(F.bool_or(F.col("d") != 0).alias("d"), F.bool_or("l").alias("l"), F.bool_or("r").alias("r")).where("d")
    return keys.select(F.col("__key").alias(key), F.when(F.col("l") & F.col("r"), "changed").when(F.col("l"), "lost").otherwise("added").alias("kind"))


def unused(candidates: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """H9."""
    return candidates.join(used, keys, "left_anti")


def rejected_reason(in_use: Column, page: Column, n_pages: Column, found: Column) -> Column:
    """The first reason that holds; null for an accepted candidate."""
    return F.when(in_use, "in use").when(n_pages.isNull() | (page > n_pages), "out of range").when(~found, "not found")


def rollup(rows: DataFrame) -> DataFrame:
    """H14."""
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("page")).alias("pages"))


def self_retrieval(targets: DataFrame, index: DataFrame, embedder, k: int = 5) -> DataFrame:
    """H8: each target chunk (qid, position, source_file, page, chunk, answer) sought by its whole text, by fifteen words of its middle and by the fifteen that hold most of the answer; a row for each with first_distance, same_chunk, hit_at_1 and first_correct_rank.

    index: position, source_file, page, chunk, embedding; embedder(df, text) adds the embedding. An index without embeddings is embedded where it is searched, by vectors' own model.
    """
    w = words(F.col("chunk"))
    t = best_window(targets.withColumn("w", w).withColumn("a", words(normalise_probe(F.col("answer")))).withColumn("lower", F.transform("w", F.lower)), "lower", "a", "window")
    kinds = {"full_text": F.col("chunk"), "substring_midchunk": mid_slice(F.col("w")), "substring_answer_window": F.col("window")}
    asked = t.select("qid", "position", "source_file", "page", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("kind"), x.alias("query")) for i, (n, x) in enumerate(kinds.items())))).alias("x"))
    asked = asked.select((F.col("qid") * len(kinds) + F.col("x.i")).alias("ask"), "qid", F.col("position").alias("own"), F.col("source_file").alias("own_file"), F.col("page").alias("own_page"), F.col("x.kind").alias("kind"), F.col("x.query").alias("query"))
    top = knn(embedder(asked.select("ask", "query"), "query"), index, k, "ask", "position", text=None if "embedding" in index.columns else "chunk").withColumnRenamed("qid", "ask")
    top = top.join(index.select(F.col("position").alias("id"), "source_file", "page"), "id").join(asked.drop("query"), "ask")
    right = F.col("source_file").eqNullSafe(F.col("own_file")) & F.col("page").eqNullSafe(F.col("own_page"))
    return top.groupBy("qid", "kind").agg(
        F.min("score").alias("first_distance"),
        F.bool_or((F.col("rank") == 1) & (F.col("id") == F.col("own"))).alias("same_chunk"),
        F.bool_or((F.col("rank") == 1) & right).alias("hit_at_1"),
        F.min(F.when(right, F.col("rank"))).alias("first_correct_rank"),
    )


def verdict(found: DataFrame, differences: DataFrame) -> DataFrame:
    """H8: hits at rank 1 by kind of query, the rows in which the index and its copy differ, and whether all is in order: no row differs, and every chunk finds its own page."""
    hits = lambda k: F.count_if((F.col("kind") == k) & F.col("hit_at_1")).alias(k)
    one = found.agg(F.count_distinct("qid").alias("targets"), *(hits(k) for k in ("full_text", "substring_midchunk", "substring_answer_window")))
    both = one.crossJoin(differences.agg(F.count(F.lit(1)).alias("differing")))  # one row by one row
    return both.withColumn("clean", (F.col("differing") == 0) & (F.col("full_text") == F.col("targets")))
