"""Queries over the driver's tables, each with the SQL that its rows are held against.

documents stand for a project's files: source is the file, and doc_id less the
file's least doc_id plus 1 is the page. benchmark texts are questions, and the
documents that contain them the expected pages. In the vector queries every row
of embeddings whose id is divisible by 20 is a question, and rows of its label
are correct. User turns of conversations are questions, the next turn's text the
answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions import sql, text as fn
from lectern.operators import boilerplate, chunking, cleaning, evaluation, generation, groundtruth, layout, pivots, relational, vectors
from lectern.sources import ledger, loaders, pagesource, store
from lectern.streaming import ingest, reindex

#: Windows of a document, or turns of a conversation, that have numbers of their own; no text has so many.
PLACES = 1 << 24

QUERIES: dict = {}
SQL: dict[str, str] = {}


def n1_sql(x: str) -> str:
    """N1 without look-around: patterns that may overlap are applied twice, and dots to keep are marked."""
    for pattern, by in [("([0-9]),([0-9])", r"\1\2")] * 2 + [(r"([0-9])\s+([0-9])", r"\1\2"), ("[^a-z0-9.]+", " ")] + [(r"([0-9])\.([0-9])", r"\1~\2")] * 2 + [(r"\.", " "), ("~", "."), (r"\s+", " ")]:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')" if (pattern, by) != ("([0-9]),([0-9])", r"\1\2") or x.startswith("regexp") else f"regexp_replace(lower({x}), '{pattern}', '{by}', 'g')"
    return f"trim({x})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """doc_id, source_file, page, text. With found, a small table that has doc_id: only its pages, with its other columns."""
    docs = relational.spread(table(spark, d, "documents"), "doc_id").select("doc_id", "source", "text")
    first = docs.groupBy(F.col("source").alias("of")).agg(F.min("doc_id").alias("first"))
    more = [] if found is None else [c for c in found.columns if c != "doc_id"]
    docs = docs if found is None else docs.join(F.broadcast(found), "doc_id")
    return docs.join(first, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", F.col("source").alias("source_file"), (F.col("doc_id") - F.col("first") + 1).alias("page"), "text", *more)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source_file, page, chunk_no, chunk, n_tokens, position."""
    rows = chunking.windows(pages(spark, d).withColumn("clean", fn.collapse(F.col("text"))).drop("text"))
    return rows.withColumn("position", F.col("doc_id") * PLACES + F.col("chunk_no"))


def with_chunks(spark: SparkSession, d: str, top: DataFrame) -> DataFrame:
    """top, a few rows for each question whose id is a chunk's position, with source_file, page, chunk_no and chunk: only their documents are cleaned, and only their windows cut."""
    found = top.withColumns({"doc_id": F.shiftright("id", PLACES.bit_length() - 1), "__no": F.col("id").bitwiseAND(F.lit(PLACES - 1)).cast("int")})
    rows = pages(spark, d, found).withColumn("clean", fn.collapse(F.col("text")))
    return chunking.windows(rows.drop("text"), only="__no").select(*top.columns, "source_file", "page", "chunk_no", "chunk")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df computed once, as a table in the store's folder."""
    path = store.scratch(df.sparkSession, tag)
    store.save(df, path)
    return store.load(df.sparkSession, path)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the turn that follows: conv_id, turn, question, answer."""
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def vector_questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").withColumn("qid", F.col("vec_id")), v


def vector_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions and their five nearest other rows with a match flag."""
    q, v = vector_questions(spark, d)
    top = vectors.knn(q, v, 5, "qid", "vec_id", exclude_self=True)
    top = top.join(v.select(F.col("vec_id").alias("id"), "label"), "id").join(q.select("qid", F.col("label").alias("asked")), "qid")
    return q, top.withColumn("match", F.col("label") == F.col("asked"))


PG = "pg AS (SELECT d.doc_id, d.source AS source_file, d.doc_id - m.m + 1 AS page, d.text FROM documents d JOIN (SELECT source, min(doc_id) AS m FROM documents GROUP BY source) m ON d.source IS NOT DISTINCT FROM m.source)"
CH = PG + r""", cl AS (SELECT doc_id, source_file, page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM pg),
tk AS (SELECT doc_id, source_file, page, string_split(clean, ' ') AS t FROM cl WHERE clean <> ''),
cn AS (SELECT doc_id, source_file, page, t, unnest(range(0, greatest(1, CAST(ceil((len(t) - 40) / 180.0) AS BIGINT)))) AS chunk_no FROM tk),
ch AS (SELECT doc_id, source_file, page, CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string(t[chunk_no * 180 + 1 : chunk_no * 180 + 220], ' ') AS chunk, CAST(len(t[chunk_no * 180 + 1 : chunk_no * 180 + 220]) AS INTEGER) AS n_tokens, doc_id * 16777216 + chunk_no AS position FROM cn)"""
QA = "qa AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user')"
DIST = "list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(v.embedding[i] AS DOUBLE)) ** 2))"
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE)))"
KNN = f"s AS (SELECT q.vec_id AS qid, q.label AS asked, v.vec_id AS id, v.label, {DIST} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s)"
HIT = KNN.replace("WHERE q.vec_id % 20 = 0", "WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id") + ", h AS (SELECT qid, min(rank) FILTER (WHERE label = asked AND rank <= 5) AS fr FROM r GROUP BY qid)"
SIM = f"s AS (SELECT q.vec_id AS qid, q.label AS asked, v.vec_id AS id, v.label, {DOT} AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id), best AS (SELECT qid, max(sim) FILTER (WHERE label = asked) AS correct, max(sim) FILTER (WHERE label <> asked) AS incorrect FROM s GROUP BY qid)"


N3_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
EX = "ex AS (SELECT b.item_id, b.text AS anchor, pg.doc_id, pg.source_file, pg.page, pg.text FROM benchmark b JOIN pg ON contains(pg.text, b.text) WHERE b.text <> '')"
FLAGGED = r"""ln AS (SELECT doc_id, page, text, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, unnest(range(1, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) + 1)) AS no FROM src),
tr AS (SELECT *, trim(line, E' \t\x0b\x0c\r\n') AS t FROM ln), tw AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w, regexp_replace(t, '[∗*†‡§¶]', '', 'g') AS bt FROM tr),
tb AS (SELECT *, list_filter(regexp_split_to_array(bt, '\s+'), lambda x: x <> '') AS bw FROM tw), tn AS (SELECT *, list_filter(bw, lambda x: regexp_matches(x, '\pL')) AS nw FROM tb),
fl AS (SELECT *, t <> '' AND len(w) <= 16 AND regexp_matches(t, '\b(?:University|Universite|Department|Dept\.|Institute|Institut|College|Faculty|School of|Laborator(?:y|ies)|Academy|Hospital|Center for|Centre for|Corresponding Author)\b') AND len(regexp_extract_all(t, '(?:^|\s)[a-z]{2,}')) / greatest(len(w), 1) < 0.4 AND NOT regexp_matches(t, '[.:;]$') AS institution,
t <> '' AND NOT regexp_matches(t, '(?:^|\s)[a-z]{2,}') AND len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) >= 4 AND (regexp_matches(t, '[∗*†‡§¶]') OR len(list_filter(w, lambda x: regexp_matches(x, '^[\p{Nd}²³¹⁰-⁹]+$'))) >= 2) AS authors,
t <> '' AND NOT regexp_matches(bt, '(?:^|\s)[a-z]{2,}') AND len(bw) BETWEEN 1 AND 4 AND len(nw) BETWEEN 2 AND 3 AND len(list_filter(nw, lambda x: NOT regexp_matches(x, '^\p{Lu}'))) = 0 AS name,
regexp_matches(t, '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}') OR regexp_matches(t, '(?i)orcid') OR len(w) <= 20 AND len(regexp_extract_all(t, '\b[A-Z]\.\s*(?:[A-Z]\.\s*)*[A-Z][a-z]+')) >= 2 AS other FROM tn),
isl AS (SELECT doc_id, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS g FROM fl WHERE name), rn AS (SELECT doc_id, no, count(*) OVER (PARTITION BY doc_id, g) AS run FROM isl),
ru AS (SELECT fl.*, coalesce(run, 0) AS run, fl.no = min(fl.no) FILTER (WHERE t <> '') OVER (PARTITION BY fl.doc_id) AS title FROM fl LEFT JOIN rn ON rn.doc_id = fl.doc_id AND rn.no = fl.no),
dr AS (SELECT *, (institution OR authors OR other OR run >= 3) AND NOT coalesce(title, false) AS gone FROM ru),
ag AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, count(*) FILTER (WHERE t <> '') AS filled, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM dr GROUP BY doc_id),
sa AS (SELECT src.*, CASE WHEN n = 0 OR n / greatest(filled, 1) > 0.7 THEN text ELSE kept END AS clean FROM src JOIN ag USING (doc_id))"""
LINES = PG + ", src AS (SELECT * FROM pg WHERE text IS NOT NULL), " + FLAGGED
STRIPPED = LINES + ", st AS (SELECT * FROM sa)"


# --- chunking -----------------------------------------------------------------


@query(f"WITH {CH} SELECT doc_id, source_file, page, chunk_no, chunk, n_tokens FROM ch")
def chunk_windows(spark, d):
    return chunks(spark, d).drop("position")


@query(f"WITH {CH} SELECT source_file, page, count(*) AS n FROM ch GROUP BY ALL")
def chunk_counts_per_page(spark, d):
    return chunks(spark, d).groupBy("source_file", "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CH} SELECT source_file, count(*) AS chunks, max(page) AS pages FROM ch GROUP BY 1")
def per_file_stats(spark, d):
    return store.stats(chunks(spark, d))


@query(r"SELECT doc_id, CAST(length(trim(coalesce(text, ''), E' \t\n\x0b\x0c\r')) AS BIGINT) AS n_chars FROM documents WHERE length(trim(coalesce(text, ''), E' \t\n\x0b\x0c\r')) < 20")
def doc_length_guard(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_file"), F.lit(1).cast("bigint").alias("page"), "text")
    return chunking.guard(docs)[1].select(F.col("source_file").cast("bigint").alias("doc_id"), "n_chars")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents")
def ws_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.collapse(F.col("text")).alias("clean"))


@query("SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'text' WHEN 4 THEN 'image' END AS modality FROM embeddings")
def modality_dispatch(spark, d):
    names = F.array(*map(F.lit, ["a.PDF", "b.jpeg", "c.m4a", "d.txt", "x/e.v2.TIFF", "f.docx"]))
    return table(spark, d, "embeddings").select("vec_id", fn.modality(F.get(names, (F.col("vec_id") % 6).cast("int"))).alias("modality"))


@query(f"WITH {STRIPPED}, gd AS (SELECT doc_id, trim(regexp_replace(clean, '\\s+', ' ', 'g')) AS c FROM sa WHERE length(trim(text, E' \\t\\n\\x0b\\x0c\\r')) >= 20), tt AS (SELECT doc_id, string_split(c, ' ') AS t FROM gd WHERE c <> ''), wn AS (SELECT doc_id, t, unnest(range(0, greatest(1, CAST(ceil((len(t) - 40) / 180.0) AS BIGINT)))) AS chunk_no FROM tt) SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string(t[chunk_no * 180 + 1 : chunk_no * 180 + 220], ' ') AS chunk FROM wn")
def preprocess(spark, d):
    """Each document as a file of one page: guard, filter of first pages, windows."""
    docs = relational.spread(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("source_file"), F.lit(1).alias("page"), "text")
    return chunking.preprocess(chunking.as_pages(docs)).select(F.col("source_file").cast("bigint").alias("doc_id"), "chunk_no", "chunk")


@query(f"WITH {CH} SELECT doc_id, chunk_no, chunk, n_tokens FROM ch")
def token_windows(spark, d):
    """C4 through the tokenizer interface."""
    rows = pages(spark, d).select("doc_id", fn.collapse(F.col("text")).alias("clean"))
    return chunking.token_windows(rows)


@query("SELECT page_id, nullif(trim(trim(regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1f]', '', 'g')), '.'), '') AS name FROM pages")
def safe_names(spark, d):
    """N13."""
    return table(spark, d, "pages").select("page_id", fn.safe_name(F.col("url")).alias("name"))


# --- boilerplate ----------------------------------------------------------------



@query(
    "WITH "
    + LINES
    + r""" SELECT count(*) FILTER (WHERE regexp_matches(t, '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}')) AS email, count(*) FILTER (WHERE regexp_matches(t, '(?i)orcid')) AS orcid,
count(*) FILTER (WHERE len(regexp_extract_all(t, '\b[A-Z]\.\s*(?:[A-Z]\.\s*)*[A-Z][a-z]+')) >= 2 AND len(regexp_extract_all(t, '\S+')) <= 20) AS initials,
count(*) FILTER (WHERE institution) AS institution, count(*) FILTER (WHERE authors) AS authors, count(*) FILTER (WHERE name) AS "name", doc_id FROM fl GROUP BY doc_id"""
)
def boilerplate_line_flags(spark, d):
    rows = pages(spark, d).select("doc_id", F.transform(boilerplate.lines_of(F.col("text")), fn.line_flags).alias("f"))
    count = lambda k: F.size(F.filter("f", lambda x: x[k])).cast("bigint").alias(k)
    return rows.select("doc_id", *map(count, ("email", "orcid", "initials", "institution", "authors", "name")))


@query(f"WITH {STRIPPED} SELECT doc_id, clean AS text FROM st WHERE page = 1")
def page1_boilerplate(spark, d):
    """First pages after C6."""
    return pages(spark, d).where("page = 1").select("doc_id", boilerplate.strip_boilerplate(F.col("text")).alias("text"))


@query(f"WITH {LINES} SELECT doc_id, CAST(count(*) FILTER (WHERE name) AS INTEGER) AS name_lines, CAST(coalesce(max(run), 0) AS INTEGER) AS longest_run FROM ru GROUP BY doc_id")
def name_run_islands(spark, d):
    rows = pages(spark, d).select("doc_id", boilerplate.flagged(F.col("text")).alias("f"))
    return rows.select("doc_id", F.size(F.filter("f", lambda x: x["name"])).alias("name_lines"), F.coalesce(F.array_max(F.transform("f", lambda x: x["run"])), F.lit(0)).alias("longest_run"))


@query(
    r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '^\s*$') OR regexp_matches(coalesce(text, ''), '^[\s()0-9,]+$')
OR (length(text) - length(replace(text, '|', '')) > 10 AND len(regexp_extract_all(text, '[A-Za-z]{3,}')) < 8) AS degenerate FROM documents"""
)
def degenerate_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.degenerate(F.col("text")).alias("degenerate"))


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), E' \\t\\x0b\\x0c\\r\\n') AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, x, count(*) AS n, min(i) AS i FROM l WHERE x <> '' GROUP BY doc_id, x),
b AS (SELECT doc_id, sum(n) AS lines, arg_max(struct_pack(n := n, x := x), [n, -i]) AS top FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(lines >= 8 AND top.n >= 8 AND length(top.x) <= 20, false) AS repeated FROM documents d LEFT JOIN b USING (doc_id)"""
)
def repeated_line_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(fn.repeated_short_line(F.col("text")), F.lit(False)).alias("repeated"))


@query(
    r"""WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(0, CAST(ceil(len(w) / 7.0) AS BIGINT)), lambda i: array_to_string(w[i * 7 + 1 : i * 7 + 7], ' ')), chr(10)) AS text FROM b"""
)
def ocr_layout(spark, d):
    """Words of each document laid out as boxes, read back in reading order."""
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    box = lambda w, i: F.struct(F.array(corner(i % 7 * 50, F.floor(i / 7) * 40 + i % 3), corner(i % 7 * 50 + 40, F.floor(i / 7) * 40 + i % 3), corner(i % 7, F.floor(i / 7)), corner(i % 7, F.floor(i / 7))).alias("box"), w.alias("text"), F.lit(1.0).alias("confidence"))
    rows = table(spark, d, "benchmark").select("item_id", F.transform(fn.words(F.col("text")), box).alias("r"))
    return rows.select("item_id", layout.reorder_by_layout(F.col("r")).alias("text"))


# --- vectors ------------------------------------------------------------------------

HASHED = CH + """, w AS (SELECT position, unnest(string_split(lower(chunk), ' ')) AS tok FROM ch), b AS (SELECT position, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS k, count(*) AS n FROM w WHERE tok <> '' GROUP BY ALL),
nm AS (SELECT position, sqrt(sum(n * n)) AS z FROM b GROUP BY 1), e AS (SELECT b.position, k, n / z AS x FROM b JOIN nm USING (position))"""


@query(f"WITH {HASHED} SELECT doc_id, chunk_no, CAST(count(*) AS INTEGER) AS filled, round(sum((k + 1) * x), 6) AS checksum FROM e JOIN ch USING (position) GROUP BY ALL")
def hash_embed(spark, d):
    rows = vectors.embed(chunks(spark, d).select("doc_id", "chunk_no", "chunk"), "chunk")
    weighted = F.aggregate(F.transform("embedding", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", "chunk_no", F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"), F.round(weighted, 6).alias("checksum"))


def top_chunks(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    asked = vectors.embed(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), fn.collapse(F.col("text")).alias("question")), "question")
    return with_chunks(spark, d, vectors.knn(asked, chunks(spark, d), k, "qid", "position", metric="l2", text="chunk"))


@query()
def question_topk(spark, d):
    """The flagship: the five chunks nearest to each question. Chunks tie under the stand-in embedder, so SQL compares the distances (question_distances)."""
    return top_chunks(spark, d).select("qid", "rank", "source_file", "page", "chunk_no", F.bround("score", 6).alias("distance"))


@query(
    f"""WITH {HASHED}, qw AS (SELECT item_id AS qid, unnest(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) AS tok FROM benchmark), qb AS (SELECT qid, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS k, count(*) AS n FROM qw WHERE tok <> '' GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(n * n)) AS z FROM qb GROUP BY 1), qe AS (SELECT qb.qid, k, n / z AS x FROM qb JOIN qn USING (qid)), dots AS (SELECT qid, position, sum(qe.x * e.x) AS dot FROM qe JOIN e USING (k) GROUP BY ALL),
al AS (SELECT qn.qid, nm.position, 2 - 2 * coalesce(dot, 0) AS dist FROM qn CROSS JOIN nm LEFT JOIN dots ON dots.qid = qn.qid AND dots.position = nm.position), rk AS (SELECT qid, dist, row_number() OVER (PARTITION BY qid ORDER BY dist) AS rank FROM al)
SELECT qid, CAST(rank AS INTEGER) AS rank, round(dist + 0, 4) AS distance FROM rk WHERE rank <= 5"""
)
def question_distances(spark, d):
    return top_chunks(spark, d).select("qid", "rank", F.round("score", 4).alias("distance"))


@query(f"WITH {KNN} SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS distance FROM r WHERE rank <= 5")
def knn_l2_topk(spark, d):
    q, v = vector_questions(spark, d)
    return vectors.knn(q, v, 5, "qid", "vec_id").select("qid", "id", "rank", F.round("score", 5).alias("distance"))


@query(f"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, {DOT} AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s) SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(sim, 5) AS cosine FROM r WHERE rank <= 5")
def knn_cosine_topk(spark, d):
    q, v = vector_questions(spark, d)
    return vectors.knn(q, v, 5, "qid", "vec_id", metric="cosine").select("qid", "id", "rank", F.round("score", 5).alias("cosine"))


@query(f"WITH {KNN}, p AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s WHERE label = asked) SELECT qid, id, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 3")
def knn_per_partition(spark, d):
    q, v = vector_questions(spark, d)
    return vectors.knn(q, v, 3, "qid", "vec_id", same="label").select("qid", "id", "rank")


@query(f"WITH {KNN} SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS distance FROM r WHERE rank <= 5")
def knn_pivot_topk(spark, d):
    """V3, V4 through an index that reads only the blocks that may hold an answer."""
    q, v = vector_questions(spark, d)
    index = pivots.build(v, store.scratch(spark, "pivots"), 32, "vec_id", block_rows=64)
    return pivots.search(q, index, 5, id_="vec_id").select("qid", "id", "rank", F.round("score", 5).alias("distance"))


@query(f"WITH {KNN} SELECT count(*) AS probes, count(*) FILTER (WHERE qid = id) AS found FROM r WHERE rank = 1")
def self_search(spark, d):
    q, v = vector_questions(spark, d)
    return vectors.knn(q, v, 1, "qid", "vec_id").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("qid") == F.col("id")).alias("found"))


@query("WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ** 2))) AS z FROM embeddings) SELECT round(min(z), 5) AS least, round(max(z), 5) AS most FROM n")
def vector_norms(spark, d):
    n = vectors.norm(F.col("embedding"))
    return table(spark, d, "embeddings").agg(F.round(F.min(n), 5).alias("least"), F.round(F.max(n), 5).alias("most"))


# --- evaluation -----------------------------------------------------------------------


@query(f"WITH {HIT}, k AS (SELECT unnest([1, 3, 5]) AS k) SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE fr <= k) AS hits, count(*) AS total, count(*) FILTER (WHERE fr <= k) / count(*) AS recall FROM h, k GROUP BY k")
def recall_at_k(spark, d):
    q, top = vector_hits(spark, d)
    return evaluation.recall(evaluation.ranks(top, q))


@query(f"WITH {HIT} SELECT qid, CAST(fr AS INTEGER) AS first_correct_rank, coalesce(fr <= 1, false) AS hit_at_1, coalesce(fr <= 3, false) AS hit_at_3, coalesce(fr <= 5, false) AS hit_at_5 FROM h")
def first_correct_rank(spark, d):
    q, top = vector_hits(spark, d)
    return evaluation.ranks(top, q)


@query(f"WITH {HIT} SELECT round_even(avg(coalesce(1.0 / fr, 0)), 4) AS mrr FROM h")
def mrr(spark, d):
    q, top = vector_hits(spark, d)
    return evaluation.ranks(top, q).agg(F.bround(F.avg(evaluation.reciprocal(F.col("first_correct_rank"))), 4).alias("mrr"))


@query(f"WITH {HIT}, t AS (SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS retrieved FROM r WHERE rank <= 5 GROUP BY qid) SELECT qid, retrieved FROM h JOIN t USING (qid) WHERE coalesce(fr > 5, true)")
def misses(spark, d):
    q, top = vector_hits(spark, d)
    return evaluation.miss_list(evaluation.ranks(top, q), top).withColumn("retrieved", F.array_join("retrieved", ","))


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    q, v = vector_questions(spark, d)
    return vectors.extremes(q, v, "qid", "vec_id", "label").withColumn("gap", F.col("correct") - F.col("incorrect"))


@query(f"WITH {SIM}, wrong AS (SELECT qid, arg_max(id, sim) FILTER (WHERE label <> asked) AS w FROM s GROUP BY qid) SELECT qid, round(correct, 5) AS correct, round(incorrect, 5) AS incorrect, round(correct - incorrect, 4) AS gap, w // 50 = qid // 50 AS same_document FROM best JOIN wrong USING (qid)")
def best_correct_vs_top_incorrect(spark, d):
    """E8 to E10; fifty vectors in a row stand for a document."""
    same = (F.floor(F.col("incorrect_id") / 50) == F.floor(F.col("qid") / 50)).alias("same_document")
    return diagnostics(spark, d).select("qid", same, F.round("correct", 5).alias("correct"), F.round("incorrect", 5).alias("incorrect"), F.round("gap", 4).alias("gap"))


@query(f"WITH {SIM} SELECT qid, count(*) FILTER (WHERE sim > correct + 1e-12) AS n_above FROM s JOIN best USING (qid) GROUP BY qid")
def chunks_above_correct(spark, d):
    q, v = vector_questions(spark, d)
    best = vectors.extremes(q, v, "qid", "vec_id", "label").select("qid", "correct")
    return vectors.count_above(q.join(best, "qid"), v, "qid", "vec_id", "correct")


def gaps(spark: SparkSession, d: str) -> DataFrame:
    q, top = vector_hits(spark, d)
    return diagnostics(spark, d).join(evaluation.ranks(top, q), "qid").withColumn("hit", F.col("hit_at_5").cast("double"))


@query(f"WITH {HIT}, {SIM.replace('s AS', 's2 AS').replace('FROM s ', 'FROM s2 ')}, g AS (SELECT correct - incorrect AS gap, CAST(coalesce(fr <= 5, false) AS DOUBLE) AS hit FROM best JOIN h USING (qid)) SELECT round(CASE WHEN stddev_pop(hit) = 0 THEN NULL ELSE covar_pop(gap, hit) / (stddev_pop(gap) * stddev_pop(hit)) END, 4) AS correlation FROM g")
def gap_correlation(spark, d):
    return gaps(spark, d).agg(F.round(evaluation.pearson("gap", "hit"), 4).alias("correlation"))


@query(f"WITH {HIT}, {SIM.replace('s AS', 's2 AS').replace('FROM s ', 'FROM s2 ')} SELECT coalesce(fr <= 5, false) AS hit, count(*) AS n, round(avg(correct - incorrect), 4) AS mean_gap FROM best JOIN h USING (qid) GROUP BY 1")
def hit_miss_means(spark, d):
    return gaps(spark, d).groupBy(F.col("hit_at_5").alias("hit")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 4).alias("mean_gap"))


@query(
    f"WITH {HIT}, p AS (SELECT qid, id, label, asked, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s WHERE label = asked), o AS (SELECT qid, min(rank) FILTER (WHERE rank <= 5) AS sr FROM p GROUP BY qid) "
    "SELECT h.qid, CAST(CASE WHEN fr <= 5 THEN fr END AS INTEGER) AS full_rank, CAST(sr AS INTEGER) AS single_rank, CAST(coalesce(CASE WHEN fr <= 5 THEN fr END, 99) - coalesce(sr, 99) AS BIGINT) AS rank_improvement, sr IS NOT NULL AND (fr IS NULL OR fr > 5 OR fr > sr) AS cross_document_interference FROM h JOIN o ON h.qid = o.qid"
)
def single_vs_full(spark, d):
    q, top = vector_hits(spark, d)
    _, v = vector_questions(spark, d)
    own = vectors.knn(q, v, 5, "qid", "vec_id", same="label", exclude_self=True).withColumn("match", F.lit(True))
    return evaluation.compare_single(evaluation.ranks(top, q), evaluation.ranks(own, q))


@query(
    f"WITH {HIT}, p AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s WHERE label = asked), o AS (SELECT qid, min(rank) FILTER (WHERE rank <= 5) AS sr FROM p GROUP BY qid) "
    "SELECT count(*) AS questions, count(*) FILTER (WHERE coalesce(CASE WHEN fr <= 5 THEN fr END, 99) - coalesce(sr, 99) > 0) AS improved, count(*) FILTER (WHERE sr IS NULL) AS still_missing FROM h JOIN o ON h.qid = o.qid"
)
def single_summary(spark, d):
    return evaluation.single_summary(single_vs_full(spark, d))


def expected(spark: SparkSession, d: str) -> DataFrame:
    """item_id, doc_id, source_file, page of the documents that contain a benchmark text."""
    docs = pages(spark, d)
    found = groundtruth.occurrences(relational.spread(table(spark, d, "documents"), "doc_id"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("anchor_id").alias("item_id"), F.col("row_id").alias("doc_id")).join(docs.select("doc_id", "source_file", "page"), "doc_id")




@query(f"WITH {CH}, {EX}, a AS (SELECT source_file, page, count(*) AS n FROM ch GROUP BY ALL) SELECT item_id, ex.doc_id, coalesce(n, 0) AS chunks_available FROM ex LEFT JOIN a ON a.source_file = ex.source_file AND a.page = ex.page")
def chunks_available(spark, d):
    return evaluation.available(expected(spark, d), chunks(spark, d), ["source_file", "page"]).select("item_id", "doc_id", "chunks_available")


@query(
    """WITH n AS (SELECT quality = 1 AS r, toxic = 1 AS a FROM labels), b AS (SELECT * FROM (VALUES (true, true, 'both correct'), (true, false, 'retrieval only'), (false, true, 'answer only'), (false, false, 'both wrong')) t(r, a, bucket))
SELECT bucket, count(n.r) AS n, count(n.r) / (SELECT CAST(count(*) AS DOUBLE) FROM n) AS share FROM b LEFT JOIN n ON n.r = b.r AND n.a = b.a GROUP BY bucket"""
)
def outcome_buckets(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("r"), (F.col("toxic") == 1).alias("a"))
    return evaluation.buckets(rows, "r", "a")


@query("SELECT event_type, round(sum(value), 2) AS amount, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def stage_shares(spark, d):
    return evaluation.shares(table(spark, d, "events"), "event_type", "value").select("event_type", F.round("amount", 2).alias("amount"), F.round("share", 6).alias("share"))


@query(f"WITH {QA} SELECT conv_id, turn, {N3_SQL.format('answer')} AS answer FROM qa")
def normalise_probe(spark, d):
    return questions(spark, d).select("conv_id", "turn", fn.normalise_probe(F.col("answer")).alias("answer"))


@query(f"WITH {QA} SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN trim(question) <> '' THEN 'Extracted text: ' || question END, CASE WHEN trim(answer) <> '' THEN 'Image description: ' || answer END) AS text FROM qa")
def ocr_and_caption(spark, d):
    """S5."""
    return questions(spark, d).select("conv_id", "turn", fn.ocr_and_caption(F.col("question"), F.col("answer")).alias("text"))


@query(f"WITH {QA} SELECT conv_id, turn, coalesce(string_split(answer, '. ')[1], '') AS answer, CAST(len(string_split(answer, '. ')) AS INTEGER) AS num_answers FROM qa")
def first_answer(spark, d):
    """A1: sentences stand for answers."""
    rows = questions(spark, d).withColumn("answers", F.split("answer", "\\. "))
    return cleaning.first_answer(rows.drop("answer")).select("conv_id", "turn", "answer", "num_answers")


# --- grading ----------------------------------------------------------------------------


@query(f"WITH {QA} SELECT conv_id, turn, {n1_sql('answer')} AS answer FROM qa")
def normalise_answer(spark, d):
    """N1."""
    return questions(spark, d).select("conv_id", "turn", fn.normalise_answer(F.col("answer")).alias("answer"))


@query(f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all({n1_sql('text')}, '[0-9]+(?:\\.[0-9]+)?'))) AS INTEGER) AS n FROM documents")
def numbers_in(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(fn.numbers_in(F.col("text"))).alias("n"))


N2_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"""WITH {QA}, t AS (SELECT conv_id, turn, list_filter(string_split({N2_SQL.format('question')}, ' '), lambda x: x <> '') AS e, list_filter(string_split({N2_SQL.format('answer')}, ' '), lambda x: x <> '') AS g FROM qa),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(e), lambda w: least(len(list_filter(e, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS c FROM t)
SELECT conv_id, turn, round(CASE WHEN c = 0 THEN 0 ELSE 2.0 * c / (len(e) + len(g)) END, 6) AS f1 FROM o"""
)
def token_f1(spark, d):
    rows = questions(spark, d).select("conv_id", "turn", fn.tokens(fn.normalise_metric(F.col("question"))).alias("e"), fn.tokens(fn.normalise_metric(F.col("answer"))).alias("g"))
    return rows.select("conv_id", "turn", F.round(fn.token_f1(F.col("e"), F.col("g")), 6).alias("f1"))


METHODS_SQL = f"""WITH {QA}, t AS (SELECT *, list_filter(string_split({N2_SQL.format('question')}, ' '), lambda x: x <> '') AS e, list_filter(string_split({N2_SQL.format('answer')}, ' '), lambda x: x <> '') AS g FROM qa),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(e), lambda w: least(len(list_filter(e, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS c FROM t),
m AS (SELECT length(question) / 100.0 AS el, length(answer) / 100.0 AS pl, CAST(contains({N2_SQL.format('answer')}, {N2_SQL.format('question')}) AS INTEGER) AS hit, CASE WHEN c = 0 THEN 0 ELSE 2.0 * c / (len(e) + len(g)) END AS f1, CASE WHEN turn % 3 = 0 THEN turn % 5 END AS q FROM o)
SELECT method, round(x[1], 6) AS mean_total_sec, round(x[2], 6) AS mean_exact_match, round(x[3], 6) AS mean_token_f1, round(x[4], 6) AS mean_manual_quality FROM
(SELECT unnest(['first', 'second']) AS method, unnest([[avg(el + pl), avg(hit), avg(f1), avg(q)], [avg(2 * el + pl), avg(1 - hit), avg(f1 / 2), NULL]]) AS x FROM m)"""


@query(METHODS_SQL)
def method_summary(spark, d):
    """Two ways to answer, with their times, matches, F1 and a quality that some rows, or all, lack."""
    q = questions(spark, d)
    e, g = F.length("question") / F.lit(100.0), F.length("answer") / F.lit(100.0)
    f1 = fn.token_f1(fn.tokens(fn.normalise_metric(F.col("question"))), fn.tokens(fn.normalise_metric(F.col("answer"))))
    hit, quality = fn.contained(F.col("question"), F.col("answer")), F.when(F.col("turn") % 3 == 0, F.col("turn") % 5)
    of = {"first": (e, g, hit, f1, quality), "second": (2 * e, g, 1 - hit, f1 / 2, F.lit(None).cast("double"))}
    names = ("extraction_time_sec", "pipeline_time_sec", "exact_match", "token_f1", "manual_quality")
    rows = evaluation.method_summary(q.select(*(c.alias(f"{m}_{n}") for m, cs in of.items() for n, c in zip(names, cs, strict=True))), list(of))
    means = ("mean_total_sec", "mean_exact_match", "mean_token_f1", "mean_manual_quality")
    return rows.select("method", *(F.round(c, 6).alias(c) for c in means))


FIRST, LAST = (f"coalesce(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')[{i}], '')" for i in (1, -1))


@query(f"WITH {QA} SELECT conv_id, turn, CAST(contains({N2_SQL.format('answer')}, {N2_SQL.format(FIRST)}) AS INTEGER) AS hit FROM qa")
def containment_match(spark, d):
    """Whether the answer holds the question's first word."""
    return questions(spark, d).select("conv_id", "turn", fn.contained(word_of("question", 0), F.col("answer")).alias("hit"))


def word_of(text: str, place: int):
    w = fn.words(F.col(text))
    return F.coalesce(F.get(w, F.lit(place) if place >= 0 else F.size(w) + place), F.lit(""))


@query(f"WITH {QA} SELECT conv_id, turn, greatest(CAST(contains({N2_SQL.format('answer')}, {N2_SQL.format(FIRST)}) AS INTEGER), CAST(contains({N2_SQL.format('answer')}, {N2_SQL.format(LAST)}) AS INTEGER)) AS best FROM qa")
def best_over_answers(spark, d):
    """The better of the question's first and last word as answers."""
    answers = F.array(word_of("question", 0), word_of("question", -1))
    return questions(spark, d).select("conv_id", "turn", fn.best_over(answers, lambda a: fn.contained(a, F.col("answer"))).alias("best"))


@query(
    f"""WITH {QA}, a AS (SELECT conv_id, turn, {n1_sql('question')} AS e, {n1_sql('answer')} AS g FROM qa),
b AS (SELECT *, list_filter(string_split(e, ' '), lambda x: x <> '') AS te, list_filter(string_split(g, ' '), lambda x: x <> '') AS tg, list_distinct(regexp_extract_all(e, '[0-9]+(?:\\.[0-9]+)?')) AS ne, regexp_extract_all(g, '[0-9]+(?:\\.[0-9]+)?') AS ng FROM a),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(te), lambda w: least(len(list_filter(te, lambda x: x = w)), len(list_filter(tg, lambda x: x = w))))), 0) AS common FROM b),
f AS (SELECT *, round_even(CASE WHEN common = 0 THEN 0 ELSE 2.0 * common / (len(te) + len(tg)) END, 3) AS token_f1, e = g AS exact_match, e <> '' AND contains(g, e) AS expected_in_answer, length(g) >= 2 AND contains(e, g) AS answer_in_expected, len(ne) > 0 AND len(list_filter(ne, lambda x: NOT list_contains(ng, x))) = 0 AS all_expected_numbers_present FROM c),
j AS (SELECT *, exact_match OR expected_in_answer OR answer_in_expected OR token_f1 >= 0.6 OR all_expected_numbers_present AS correct FROM f)
SELECT conv_id, turn, exact_match, expected_in_answer, answer_in_expected, token_f1, all_expected_numbers_present, correct, NOT correct AND token_f1 >= 0.3 AND token_f1 < 0.6 AS needs_human_review FROM j"""
)
def judge_signals(spark, d):
    return fn.judge(questions(spark, d), "question", "answer").select("conv_id", "turn", "exact_match", "expected_in_answer", "answer_in_expected", "token_f1", "all_expected_numbers_present", "correct", "needs_human_review")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])\s*([.,:])\s*([0-9])', '\1\2\3', 'g'), '([$#])\s+([0-9])', '\1\2', 'g') AS fixed FROM documents")
def fix_number_spacing(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.fix_number_spacing(F.col("text")).alias("fixed"))


@query(f"WITH {QA}, n AS (SELECT len(list_filter(regexp_split_to_array(coalesce(answer, ''), '\\s+'), lambda x: x <> '')) AS n FROM qa) SELECT CASE WHEN n = 0 THEN 'empty' WHEN n = 1 THEN 'single word' WHEN n <= 5 THEN 'short phrase' WHEN n <= 15 THEN 'sentence' ELSE 'long answer' END AS class, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM n) AS share FROM n GROUP BY 1")
def answer_class(spark, d):
    rows = questions(spark, d).select(fn.answer_class(F.size(fn.words(F.col("answer")))).alias("class"))
    return cleaning.value_counts(rows, "class")


@query(f"WITH {PG} SELECT DISTINCT CASE WHEN source_file IS NULL THEN 'unknown file' ELSE source_file || ' — page ' || page END AS label FROM pg")
def source_labels(spark, d):
    return pages(spark, d).select(fn.source_label(F.col("source_file"), F.col("page")).alias("label")).distinct()


@query("SELECT conv_id, bool_or(contains(lower(text), 'the') OR contains(lower(text), 'der')) AS any_hit, bool_and(contains(lower(text), 'the') OR contains(lower(text), 'der')) AS consistent FROM conversations GROUP BY 1")
def key_phrase_consistency(spark, d):
    hit = fn.key_phrase(F.col("text"), ["the", "der"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(hit).alias("any_hit"), F.bool_and(hit).alias("consistent"))


# --- SQL text -------------------------------------------------------------------------------


def told(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """SQL text with the engine's functions over tables that stand in braces."""
    sql.register(spark)
    return spark.sql(text, **tables)


@query(f"WITH {QA}, t AS (SELECT conv_id, turn, list_filter(string_split({n1_sql('question')}, ' '), lambda x: x <> '') AS e, list_filter(string_split({n1_sql('answer')}, ' '), lambda x: x <> '') AS g FROM qa), o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(e), lambda w: least(len(list_filter(e, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS c FROM t) SELECT conv_id, turn, round(CASE WHEN c = 0 THEN 0 ELSE 2.0 * c / (len(e) + len(g)) END, 6) AS f1 FROM o")
def sql_token_f1(spark, d):
    return told(spark, "SELECT conv_id, turn, round(token_f1(question, answer), 6) AS f1 FROM {qa}", qa=questions(spark, d))


@query(f"WITH {QA} SELECT conv_id, turn, {n1_sql('answer')} AS answer FROM qa")
def sql_normalise_answer(spark, d):
    return told(spark, "SELECT conv_id, turn, normalise_answer(answer) AS answer FROM {qa}", qa=questions(spark, d))


@query(SQL["degenerate_flags"])
def sql_is_degenerate(spark, d):
    return told(spark, "SELECT doc_id, is_degenerate(text) AS degenerate FROM {documents}", documents=table(spark, d, "documents"))


@query(f"WITH {CH} SELECT doc_id, source_file, page, chunk_no, chunk, n_tokens, CAST(row_number() OVER (PARTITION BY source_file ORDER BY page, chunk_no) - 1 AS INTEGER) AS position FROM ch")
def sql_chunk_windows(spark, d):
    """C4 as a table function; each file's chunks are numbered in the order of its pages."""
    rows = pages(spark, d).select("doc_id", "source_file", "page", fn.collapse(F.col("text")).alias("clean"))
    return told(spark, "SELECT doc_id, source_file, page, chunk_no, chunk, n_tokens, position FROM chunk_windows(TABLE({rows}) PARTITION BY source_file ORDER BY page, text_column => 'clean')", rows=rows)


# Rounds of the budget as a recursive query over each conversation's turns.
BUDGET_SQL = r"""WITH RECURSIVE n AS (SELECT conv_id, turn, text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS INTEGER) AS n FROM conversations),
c AS (SELECT conv_id, list(n ORDER BY turn, n) AS lengths FROM n GROUP BY conv_id),
r AS (SELECT 0 AS i, conv_id, lengths, list_transform(lengths, lambda x: 0) AS got, 300 AS room FROM c
UNION ALL SELECT i + 1, conv_id, lengths, CASE WHEN room = 0 OR total = 0 THEN got WHEN spent = 0 THEN list_transform(range(1, len(lengths) + 1), lambda k: CAST(got[k] + CASE WHEN got[k] < lengths[k] AND len(list_filter(range(1, k), lambda j: got[j] < lengths[j])) < room THEN 1 ELSE 0 END AS INTEGER))
ELSE list_transform(range(1, len(lengths) + 1), lambda k: CAST(got[k] + adds[k] AS INTEGER)) END, CASE WHEN room = 0 OR total = 0 THEN room WHEN spent = 0 THEN 0 ELSE room - spent END
FROM (SELECT *, CAST(coalesce(list_sum(adds), 0) AS INTEGER) AS spent FROM (SELECT *, list_transform(range(1, len(lengths) + 1), lambda k: CASE WHEN got[k] < lengths[k] AND total > 0 THEN least(CAST(floor(room * power(0.85::DOUBLE, k - 1) / total) AS INTEGER), lengths[k] - got[k]) ELSE 0 END) AS adds FROM
(SELECT *, coalesce(list_sum(list_transform(range(1, len(lengths) + 1), lambda k: CASE WHEN got[k] < lengths[k] THEN power(0.85::DOUBLE, k - 1) ELSE 0::DOUBLE END)), 0) AS total FROM r WHERE i < 2 * len(lengths) + 2))))
SELECT conv_id, lengths, got AS taken FROM r WHERE i = 2 * len(lengths) + 2"""


@query(BUDGET_SQL)
def sql_allocate_budget(spark, d):
    """G1 in SQL text: each conversation's turns as chunks of a context of 300 words."""
    return told(spark, """SELECT conv_id, lengths, allocate_budget(lengths, 300) AS taken FROM (SELECT conv_id, transform(sort_array(collect_list(struct(turn, size(filter(split(coalesce(text, ''), '(?U)\\\\s+'), w -> w <> '')) AS n))), x -> x.n) AS lengths
        FROM {turns} GROUP BY conv_id)""", turns=table(spark, d, "conversations"))


# --- generation -----------------------------------------------------------------------------


@query(BUDGET_SQL)
def allocate_budget(spark, d):
    """Each conversation's turns as chunks of a context of 300 words."""
    lengths = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.size(fn.words(F.col("text"))).alias("n")))), lambda x: x["n"])
    c = table(spark, d, "conversations").groupBy("conv_id").agg(lengths.alias("lengths"))
    return c.select("conv_id", "lengths", generation.allocate_budget(F.col("lengths"), F.lit(300)).alias("taken"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    top = top_chunks(spark, d, 3).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return generation.budget_context(asked.join(top, "qid"), "question", "chunks")


@query()
def budget_context(spark, d):
    return answers(spark, d).select("qid", "context", F.size(F.split("context", " ")).alias("n_tokens"))


@query()
def token_context(spark, d):
    """G2 by a public tokenizer: each conversation's texts as chunks of its first one's prompt, of at most 1,024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("chunks"))
    rows = generation.token_context(c.withColumn("question", F.get("chunks", F.lit(0))), "question", "chunks", lambda: chunking.LibraryTokenizer(path))
    return rows.select("conv_id", "context")


@query(f"WITH {QA} SELECT conv_id, turn, 'Question: ' || question || chr(10) || 'Context: ' || answer || chr(10) || 'Answer:' AS prompt FROM qa")
def prompt_build(spark, d):
    return questions(spark, d).select("conv_id", "turn", generation.prompt(F.col("question"), F.col("answer")).alias("prompt"))


@query()
def answer_questions(spark, d):
    out = generation.generate(answers(spark, d).select("qid", "question", "context"))
    return out.select("qid", generation.answered(fn.fix_number_spacing(F.col("answer"))).alias("answer"))


@query(f"WITH {KNN} SELECT qid, 'label ' || label AS source_label, CAST(min(rank) AS INTEGER) AS first_rank FROM r WHERE rank <= 5 GROUP BY ALL")
def distinct_sources(spark, d):
    q, v = vector_questions(spark, d)
    top = vectors.knn(q, v, 5, "qid", "vec_id").join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    return generation.distinct_sources(top.withColumn("source_label", F.concat(F.lit("label "), F.col("label").cast("string"))))


# --- self-checks and ground truth ---------------------------------------------------------------


@query("SELECT vec_id, label, 'left' AS side FROM embeddings WHERE false")
def roundtrip_diff(spark, d):
    """H1, H3: rows that a store lost, gained or changed between writing and reading."""
    rows, path = table(spark, d, "embeddings").select("vec_id", "label"), store.scratch(spark, "index")
    store.save(rows, path, "label")
    return groundtruth.consistent(rows, store.load(spark, path).select("vec_id", "label"))


@query("SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) > 0)) AS positive FROM embeddings")
def store_roundtrip(spark, d):
    """Vectors as a store gives them back."""
    path = store.scratch(spark, "vectors")
    store.save(table(spark, d, "embeddings"), path)
    return store.load(spark, path).select("vec_id", "label", F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positive"))


@query("SELECT doc_id, quality, toxic FROM labels")
def append_absent(spark, d):
    """K7: half of the labels are there; all are appended, and none stands twice."""
    rows, path = table(spark, d, "labels").select("doc_id", "quality", "toxic"), store.scratch(spark, "labels")
    store.save(rows.where("doc_id % 2 = 0"), path)
    store.append_absent(rows, path, "doc_id")
    return store.load(spark, path)


@query("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations")
def json_roundtrip(spark, d):
    """K2, S8."""
    path = store.scratch(spark, "json")
    store.write_report(table(spark, d, "conversations"), path)
    return loaders.read_json(spark, path, lines=True).select("conv_id", "turn", "role", "text")


@query("SELECT item_id, text, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n FROM benchmark")
def csv_roundtrip(spark, d):
    """Texts and arrays of words through CSV."""
    path = store.scratch(spark, "csv")
    store.write_csv(table(spark, d, "benchmark").select("item_id", "text", F.to_json(fn.words(F.col("text"))).alias("words")), path)
    return loaders.read_csv(spark, path, ("words",)).select(F.col("item_id").cast("bigint").alias("item_id"), "text", F.size("words").alias("n"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 10")
def first_rows(spark, d):
    """S12; the limit is the feature."""
    return loaders.take(table(spark, d, "embeddings").select("vec_id", "label"), 10, "vec_id")


@query(f"WITH {CH}, {EX}, t AS (SELECT item_id AS qid, position, contains({N3_SQL.format('chunk')}, {N3_SQL.format('anchor')}) AS holds FROM ex JOIN ch ON ch.source_file = ex.source_file AND ch.page = ex.page) SELECT qid, arg_min(position, [CASE WHEN holds THEN 0 ELSE 1 END, position]) AS position, bool_or(holds) AS contains_answer FROM t GROUP BY qid")
def target_chunks(spark, d):
    """H5."""
    return wanted(spark, d, expected(spark, d), chunks(spark, d)).drop("chunk")


def wanted(spark: SparkSession, d: str, places: DataFrame, every: DataFrame) -> DataFrame:
    """H5 among all chunks, from the rows of expected()."""
    asked = places.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer")), "item_id").select(F.col("item_id").alias("qid"), "source_file", "page", "answer")
    return groundtruth.targets(asked, every, ["source_file", "page"])


def sought(spark: SparkSession, d: str, every: DataFrame) -> DataFrame:
    """H8 over all chunks, which are a stored table: they are read several times. So are what is expected and sought, small tables of their own."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    targets = kept(wanted(spark, d, kept(expected(spark, d), "expected"), every).select("qid", "position"), "targets")
    found = targets.join(every, "position").join(asked, "qid").select("qid", "position", "source_file", "page", "chunk", "answer")
    return groundtruth.self_retrieval(kept(found, "sought"), every, vectors.embed)


@query()
def self_retrieval(spark, d):
    """H8; a test holds it against brute force."""
    return sought(spark, d, kept(chunks(spark, d), "chunks"))


@query()
def retrieval_verdict(spark, d):
    """H8: hits by kind of query, and whether all is in order: the stored index is held against the one it was made from."""
    rows = chunks(spark, d)
    stored = kept(rows, "chunks")
    return groundtruth.verdict(sought(spark, d, stored), groundtruth.differing(rows, stored, "position"))


@query("SELECT source, min(doc_id) AS first_position FROM documents GROUP BY 1")
def doc_boundaries(spark, d):
    return groundtruth.boundaries(table(spark, d, "documents"), "source", "doc_id")


@query("SELECT * FROM (SELECT doc_id AS id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-0'), doc_id LIMIT 40) UNION SELECT min(doc_id) FROM documents GROUP BY source UNION SELECT min(doc_id) FROM documents UNION SELECT max(doc_id) FROM documents")
def probe_sample(spark, d):
    return groundtruth.probes(table(spark, d, "documents"), "doc_id", "source")


@query(
    rf"""WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, array_to_string(w[greatest(0, len(w) // 2 - 7) + 1 : greatest(0, len(w) // 2 - 7) + 15], ' ') AS mid FROM b"""
)
def mid_slice(spark, d):
    return table(spark, d, "benchmark").select("item_id", groundtruth.mid_slice(fn.words(F.col("text"))).alias("mid"))


@query(
    rf"""WITH {QA}, t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '') AS w, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '')) AS a FROM qa),
s AS (SELECT *, unnest(range(0, greatest(len(w) - 15, 0) + 1)) AS st FROM t), o AS (SELECT conv_id, turn, w, st, len(list_intersect(w[st + 1 : st + 15], a)) AS n FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, st) AS k FROM o)
SELECT conv_id, turn, array_to_string(w[st + 1 : st + 15], ' ') AS best, CAST(n AS INTEGER) AS best_overlap FROM r WHERE k = 1"""
)
def best_answer_window(spark, d):
    rows = questions(spark, d).select("conv_id", "turn", fn.words(F.lower("answer")).alias("w"), fn.words(F.lower("question")).alias("a"))
    return groundtruth.best_window(rows, "w", "a", "best").select("conv_id", "turn", "best", "best_overlap")


@query(
    f"""WITH {PG}, {EX}, p AS (SELECT item_id, doc_id, anchor, text, strpos(text, anchor) AS pos FROM ex),
q AS (SELECT *, pos + length(anchor) AS e, strpos(reverse(substr(text, 1, pos - 1)), ' .') AS bk, strpos(substr(text, pos + length(anchor)), '. ') AS ah FROM p),
z AS (SELECT *, CASE WHEN bk > 0 THEN pos - bk - 1 END AS l, CASE WHEN ah > 0 THEN e + ah - 1 END AS r FROM q)
SELECT item_id, doc_id, CASE WHEN r - l < 600 THEN substr(text, l + 2, r - l - 1) ELSE substr(text, greatest(pos - 180, 1), least(e + 179, length(text)) - greatest(pos - 180, 1) + 1) END AS sentence FROM z"""
)
def sentence_lift(spark, d):
    rows = expected(spark, d).select("item_id", "doc_id").join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("anchor")), "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("item_id", "doc_id", groundtruth.lift_sentence(F.col("text"), F.col("anchor")).alias("sentence"))


@query(f"WITH {PG}, {EX} SELECT item_id, count(*) AS n_places, min(doc_id) AS first_doc FROM ex GROUP BY 1")
def anchor_ambiguity(spark, d):
    return expected(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_places"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {PG}, {EX}, o AS (SELECT a.item_id, a.doc_id, list_sort(list(b.page)) AS pages FROM ex a JOIN ex b ON a.item_id = b.item_id AND a.source_file IS NOT DISTINCT FROM b.source_file AND a.page <> b.page GROUP BY ALL) SELECT item_id, doc_id, coalesce(array_to_string(pages, ','), '') AS other_pages FROM ex LEFT JOIN o USING (item_id, doc_id)")
def anchor_other_pages(spark, d):
    """For each place of a benchmark text, the other pages of its file that hold it, too."""
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("anchor_id"), F.col("text").alias("anchor"))
    rows = expected(spark, d)
    found = groundtruth.other_pages(rows.withColumnRenamed("item_id", "anchor_id").drop("doc_id").join(texts, "anchor_id"), pages(spark, d))
    back = found.join(rows.select(F.col("item_id").alias("anchor_id"), "doc_id", "source_file", "page"), ["anchor_id", "source_file", "page"])
    return back.select(F.col("anchor_id").alias("item_id"), "doc_id", F.array_join("other_pages", ",").alias("other_pages"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'lost' WHEN doc_id % 13 = 0 THEN 'changed' END AS kind FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 17 = 0")
def range_differences(spark, d):
    """H1, H3: what a table lost, gained and changed, found by digests of ranges."""
    docs = table(spark, d, "documents")
    other = docs.where("doc_id % 11 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 13 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    other = other.unionByName(docs.where("doc_id % 17 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    return groundtruth.differing(docs, other, "doc_id")


@query(f"WITH {PG}, {EX} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ex)")
def exclusion_antijoin(spark, d):
    return groundtruth.unused(table(spark, d, "documents").select("doc_id"), expected(spark, d).select("doc_id"), ["doc_id"])


@query(
    f"""WITH {PG}, {EX}, u AS (SELECT DISTINCT doc_id FROM ex), n AS (SELECT source_file, max(page) - 20 AS n_pages FROM pg GROUP BY 1)
SELECT pg.doc_id, CASE WHEN u.doc_id IS NOT NULL THEN 'in use' WHEN n_pages IS NULL OR page > n_pages THEN 'out of range' WHEN NOT contains(text, 'the ') THEN 'not found' END AS reason FROM pg LEFT JOIN u ON u.doc_id = pg.doc_id LEFT JOIN n ON n.source_file = pg.source_file"""
)
def reject_reasons(spark, d):
    rows = pages(spark, d)
    used = expected(spark, d).select("doc_id").distinct().withColumn("used", F.lit(True))
    n = rows.groupBy("source_file").agg((F.max("page") - 20).alias("n_pages"))
    joined = rows.join(used, "doc_id", "left").join(n, "source_file", "left")
    return joined.select("doc_id", groundtruth.rejected_reason(F.col("used").isNotNull(), F.col("page"), F.col("n_pages"), F.contains("text", F.lit("the "))).alias("reason"))


@query(f"WITH {PG}, {EX} SELECT source_file, count(*) AS n, list_sort(list(DISTINCT page)) AS pages FROM ex GROUP BY 1")
def candidate_rollup(spark, d):
    return groundtruth.rollup(expected(spark, d))


# --- dataset cleaning ------------------------------------------------------------------------------


@query(
    rf"""WITH {QA}, t AS (SELECT coalesce(answer, '') AS a, turn % 3 AS k FROM qa), i AS (SELECT count(*) AS total, count(*) FILTER (WHERE trim(a) = '') AS empty, count(*) FILTER (WHERE regexp_matches(a, '[^\x00-\x7F]')) AS non_ascii,
count(*) FILTER (WHERE len(list_filter(regexp_split_to_array(a, '\s+'), lambda x: x <> '')) > 20) AS long, count(*) FILTER (WHERE regexp_matches(a, '^[0-9 .,%]+$')) AS "numeric", count(*) FILTER (WHERE k > 1) AS multiple_answers, count(*) FILTER (WHERE regexp_matches(a, '\s\s')) AS white_space, count(*) - count(DISTINCT a) AS duplicate FROM t)
SELECT issue, n, 100.0 * n / total AS percent FROM (UNPIVOT i ON empty, non_ascii, long, "numeric", multiple_answers, white_space, duplicate INTO NAME issue VALUE n)"""
)
def issue_audit(spark, d):
    return cleaning.audit(questions(spark, d).withColumn("num_answers", F.col("turn") % 3))


CLEAN = QA + r""", c AS (SELECT conv_id * 16777216 + turn AS row_id, trim(regexp_replace(regexp_replace(question, '[^\x00-\x7F]+', '', 'g'), '\s+', ' ', 'g')) AS question_clean, lower(trim(regexp_replace(regexp_replace(answer, '[^\x00-\x7F]+', '', 'g'), '\s+', ' ', 'g'))) AS answer_clean FROM qa)"""


@query(f"WITH {CLEAN} SELECT question_clean, answer_clean, min(row_id) AS row_id FROM c WHERE answer_clean <> '' AND len(string_split(answer_clean, ' ')) <= 20 GROUP BY ALL")
def clean_pipeline(spark, d):
    return cleaning.cleaned(questions(spark, d).withColumn("row_id", F.col("conv_id") * PLACES + F.col("turn")))


@query(
    f"""WITH {CLEAN}, f AS (SELECT *, answer_clean <> '' AS x, len(string_split(answer_clean, ' ')) <= 20 AS y FROM c)
SELECT unnest(['rows', 'filled', 'short', 'distinct']) AS step, unnest([count(*), count(*) FILTER (WHERE x), count(*) FILTER (WHERE x AND y), count(DISTINCT CASE WHEN x AND y THEN struct_pack(q := question_clean, a := answer_clean) END)]) AS n FROM f"""
)
def removed_rows(spark, d):
    return cleaning.removed(questions(spark, d))


@query(f"WITH {QA}, n AS (SELECT len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) AS n FROM qa) SELECT count(*) AS n, round_even(avg(n), 2) AS mean, round_even(stddev_samp(n), 2) AS std, CAST(min(n) AS INTEGER) AS least, round_even(quantile_cont(n, 0.25), 2) AS q1, round_even(quantile_cont(n, 0.5), 2) AS median, round_even(quantile_cont(n, 0.75), 2) AS q3, CAST(max(n) AS INTEGER) AS most FROM n")
def describe_lengths(spark, d):
    return cleaning.describe(questions(spark, d).select(F.size(fn.words(F.col("answer"))).alias("words")), "words")


@query("SELECT unnest([0.01, 0.25, 0.5, 0.9, 0.999]) AS p, round(unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.9, 0.999])), 6) AS value FROM lineitem")
def exact_quantiles(spark, d):
    """A10 on doubles."""
    p = [0.01, 0.25, 0.5, 0.9, 0.999]
    found = cleaning.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", p, most=500)
    return spark.createDataFrame([(a, round(b, 6)) for a, b in zip(p, found, strict=True)], "p double, value double")


@query(f"WITH {QA}, n AS (SELECT len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) AS n FROM qa) SELECT CAST(least(n, 30) AS INTEGER) AS bin, count(*) AS n FROM n GROUP BY 1")
def length_histogram(spark, d):
    return cleaning.histogram(questions(spark, d).select(F.size(fn.words(F.col("answer"))).alias("words")), "words", 30)


@query(f"WITH {QA} SELECT (list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> ''))[1] AS word, count(*) AS n FROM qa GROUP BY 1 HAVING word IS NOT NULL ORDER BY n DESC, word LIMIT 8")
def top_starters(spark, d):
    return cleaning.starters(questions(spark, d), "question")


@query("SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents")
def distinct_values(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct(F.xxhash64("text"), F.md5(F.encode("text", "utf-8"))).alias("texts"), F.count_distinct("source").alias("sources"))


@query("WITH f AS (SELECT source AS project, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), '2024-01-01 00:00:00', CAST(n_chars AS VARCHAR))) AS h FROM documents), s AS (SELECT project, count(*) AS n, " + ", ".join(f"sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS HUGEINT)) AS s{k}" for k in range(4)) + " FROM f GROUP BY project) SELECT project, sha256(concat_ws('-', n, s0, s1, s2, s3)) AS signature FROM s")
def project_signature(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("name"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.col("n_chars").alias("length"))
    return store.signature(files)


@query("SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN -n_chars ELSE n_chars END AS n_chars FROM documents")
def ledger_commits(spark, d):
    """K1, K7, S10 in versions: some rows added, some replaced, some removed, and those added that the store then lacks."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    t = ledger.Ledger(spark, store.scratch(spark, "ledger"), "doc_id bigint, source string, n_chars bigint", "doc_id")
    t.append(docs.where("doc_id % 5 <> 0"))
    t.upsert(docs.where("doc_id % 3 = 0").withColumn("n_chars", -F.col("n_chars")))
    t.delete(docs.where("doc_id % 7 = 0"))
    t.append_absent(docs)
    return t.read().drop("row_id")


CHANGED = CH.replace("pg AS (SELECT d.doc_id, d.source AS source_file, d.doc_id - m.m + 1 AS page, d.text FROM", "pg AS (SELECT d.doc_id, d.source AS source_file, d.doc_id - m.m + 1 AS page, CASE WHEN d.source LIKE '%2' THEN replace(d.text, 'e', 'E') ELSE d.text END AS text FROM")


@query(f"WITH {CHANGED} SELECT source_file, page, chunk_no, md5(chunk) AS chunk FROM ch WHERE source_file IS NULL OR source_file NOT LIKE '%3'")
def reindexed_chunks(spark, d):
    """The index of all files after some changed and some were deleted, held against one that is built anew."""
    index = reindex.index_of(spark, store.scratch(spark, "index"))
    first = pages(spark, d).select("source_file", F.lit(1).alias("state"), "page", "text", F.lit(False).alias("deleted"))
    reindex.apply_changes(index, first, ("pages", 0), strip_page1=False)
    changed = first.where("source_file like '%2' or source_file like '%3'").withColumns({"state": F.lit(2), "text": F.expr("replace(text, 'e', 'E')"), "deleted": F.expr("source_file like '%3'")})
    reindex.apply_changes(index, changed, ("pages", 1), strip_page1=False)
    return index.read().select("source_file", "page", "chunk_no", F.md5("chunk").alias("chunk"))


@query("SELECT item_id, text, 'text' AS modality FROM benchmark WHERE trim(text) <> ''")
def page_source(spark, d):
    """S1 to S7 as a data source: benchmark texts written as files and read back."""
    path = store.scratch(spark, "files")
    table(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    pagesource.register(spark)
    rows = spark.read.format("lectern_pages").option("path", path).load().where("modality = 'text'")
    return rows.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), F.regexp_replace("text", "\\n$", "").alias("text"), "modality")


# --- beyond the reference -----------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    return relational.pricing_summary(table(spark, d, "lineitem"))


@query("SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def segment_revenue(spark, d):
    return relational.segment_revenue(*(table(spark, d, t) for t in ("customer", "orders", "lineitem")))


@query("SELECT r_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def region_cube(spark, d):
    return relational.region_cube(*(table(spark, d, t) for t in ("region", "nation", "customer")))


@query("SELECT event_id, user_id, click FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click FROM events) WHERE event_type = 'error'")
def last_event_before(spark, d):
    return relational.last_event_before(table(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The stream's plan run over the table as a batch."""
    return ingest.event_windows(table(spark, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


