"""How the word use of a language's sources diverges: pairs of sources, and the terms that set a source apart.

Pass one finds exact document frequencies: a task counts each document's distinct terms once, the counts are summed over the
corpus, and every language keeps the terms of `least` documents or more.

Pass two recounts the occurrences with an automaton (pyahocorasick) over the kept terms, each padded with a
delimiter on both sides, so that it is met as a whole term only; texts have one delimiter for every character that no term has, and matches may share it.
The automaton holds the HEAD_TERMS kept terms of most documents, HEAD_CHARS code points in all: what is broadcast and held by a worker has
that bound whatever the corpus. Where more terms are kept, the occurrences that it doesn't hold are counted as strings and
meet the kept terms in a join; the result is the same.

Counts of (group, term) that occur are postings. A pair's sum over all kept terms is taken from postings alone: terms that neither source
has differ by one constant; those of one source are summed over its distinct counts, since the other's share is then a constant, too; only
terms that both have are met pair by pair, within a task, and leave it as sums by pair of sources.

Cases: null text, language and source are empty strings; groups without terms have pairs and no terms; a language without kept terms gives 0 for all its pairs;
a language of one source has no pairs; repeated rows are documents of their own; very long texts are matched in slices that end
between terms; ties go by the bytes of the item; an empty table gives an empty one; only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.llm._shared import as_bytes, body, freeing, materialize, small_batches

LEAST, TOP, ONE = 3, 200, 1_000_000_000
HEAD_TERMS, HEAD_CHARS, HEAD_LENGTH = 1 << 20, 1 << 23, 64
FLUSH, SLICE, PAIRS, POSTINGS, GROUPS = 1 << 19, 1 << 21, 1 << 20, 1 << 18, 1 << 16
#: Letters in lower case and all that isn't ASCII as they are, a space for the rest.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def share(count: Column, total: Column) -> Column:
    """A term's share of a group in billionths, smoothed by one; exact. total: occurrences and terms together."""
    return F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def rows_of(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(body(lang).alias("lang"), body(source).alias("source"), body(text).alias("text"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """lang, term, df."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, terms in seen.items():
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(terms), np.int32)), pa.array([lang])).cast(pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64())], names=["lang", "term", "df"])
            seen.clear()

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                seen.setdefault(lang, Counter()).update(set(value.translate(PLAIN).split()))
            if sum(map(len, seen.values())) > FLUSH:
                yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(freeing(count), "lang string, term string, df bigint").groupBy("lang", "term").agg(F.sum("df").alias("df"))


class Vocabulary:
    """The automaton over distinct terms, and each language's ids of them (-1: not its own). words: terms joined by line ends, and their ids, by language."""

    def __init__(self, words: dict[str, tuple[bytes, np.ndarray]], named: bool = False):
        import ahocorasick

        self.match, places, n = ahocorasick.Automaton(), {}, 0
        for lang, (terms, _) in words.items():
            places[lang] = at = []
            for term in terms.decode().split("\n") if terms else []:
                word = f" {term} "
                i = self.match.get(word, -1)
                if i < 0:
                    i, n = n, n + 1
                    self.match.add_word(word, i)
                at.append(i)
        self.n, self.ids = n, {}
        for lang, (_, tids) in words.items():
            self.ids[lang] = np.full(n, -1, np.int64)
            self.ids[lang][places[lang]] = tids
        #: Only where some kept terms aren't in the automaton: each language's own.
        self.own = {lang: set(terms.split(b"\n")) for lang, (terms, _) in words.items()} if named else {}
        if n:
            self.match.make_automaton()

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the terms that occur, their occurrences); the text's terms have one space at least on either side."""
        found, start = [], 0
        while self.n and start < len(text) - 1:
            end = len(text) if len(text) - start <= SLICE else text.find(" ", start + SLICE) + 1 or len(text)
            # Slices share the space between them.
            found.append(summed(np.fromiter(map(itemgetter(1), self.match.iter(text, start, end)), np.int64)))
            start = end - 1 if end < len(text) else end
        return merged(found)


def summed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(numbers, return_counts=True)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of several parts as one."""
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    numbers, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.zeros(len(numbers), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return numbers, n


_vocabulary: list = [None, None]


def vocabulary_of(sent, named: bool) -> Vocabulary:
    """The broadcast terms' automaton; a worker holds one."""
    if _vocabulary[0] != sent.id:
        _vocabulary[:] = None, None
        _vocabulary[:] = sent.id, Vocabulary(sent.value, named)
    return _vocabulary[1]


class _Sent:
    """A broadcast with a name of its own, so that a worker knows it again."""

    def __init__(self, spark: SparkSession, value):
        import uuid

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.held.value


def postings(rows: DataFrame, sites: DataFrame, kept: DataFrame, head_terms: int = HEAD_TERMS, head_chars: int = HEAD_CHARS) -> DataFrame:
    """gid, tid, n: occurrences of kept terms (lang, term, tid, df) in groups (lang, source, gid), where there are any. Rows are sent with the group's number if there are at most GROUPS groups, else with its names."""
    spark = rows.sparkSession
    few = sites.count() <= GROUPS
    number = {(r.lang, r.source): r.gid for r in sites.collect()} if few else {}
    some = kept.where(F.length("term") <= HEAD_LENGTH).orderBy(F.desc("df"), "tid").limit(head_terms).select("lang", "term", "tid").toArrow()
    some = some.slice(0, int(np.searchsorted(np.cumsum(pc.utf8_length(some["term"]).to_numpy()), head_chars, "right"))).combine_chunks()
    head = {}
    for lang in some["lang"].unique().to_pylist():
        own = some.filter(pc.equal(some["lang"], lang))
        head[lang] = b"\n".join(as_bytes(own["term"])), own["tid"].to_numpy()
    whole = kept.count() == some.num_rows
    sent = _Sent(spark, head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(sent, not whole)
        known: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
        other: dict[tuple[str, str], Counter] = {}
        size = 0

        def out(group: tuple[str, str], tid, term, n) -> pa.RecordBatch:
            if few:
                names = [pa.array(np.full(len(n), number[group], np.int64))]
            else:
                names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([x])).cast(pa.string()) for x in group]
            return pa.RecordBatch.from_arrays([*names, tid, *([] if whole else [term]), pa.array(n, pa.int64())], names=[*group_names, "tid", *([] if whole else ["term"]), "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for group, parts in known.items():
                numbers, n = merged(parts)
                tids = words.ids[group[0]][numbers]
                yield out(group, pa.array(tids[tids >= 0]), pa.nulls(int((tids >= 0).sum()), pa.string()), n[tids >= 0])
            for group, terms in other.items():
                yield out(group, pa.nulls(len(terms), pa.int64()), pa.array(list(terms), pa.binary()).cast(pa.string()), list(terms.values()))
            known.clear(), other.clear()

        for batch in batches:
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                texts.setdefault((lang, source), []).append(value.translate(PLAIN))
            for group, parts in texts.items():
                raw = b" ".join([b"", *parts, b""])
                if group[0] in words.ids:
                    known.setdefault(group, []).append(words.counts(raw.decode()))
                    size += len(known[group][-1][0])
                if not whole:
                    own = words.own.get(group[0], ())
                    other.setdefault(group, Counter()).update({t: c for t, c in Counter(raw.split()).items() if t not in own})
            if size > 4 * FLUSH or sum(map(len, other.values())) > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    group_names = ["gid"] if few else ["lang", "source"]
    found = rows.mapInArrow(freeing(count), ("gid bigint" if few else "lang string, source string") + ", tid bigint" + ", term string" * (not whole) + ", n bigint")
    if not whole:
        found = materialize(found, "occurrences")
        rest = found.where("tid is null").groupBy(*group_names, "term").agg(F.sum("n").alias("n"))
        rest = rest.join(F.broadcast(sites.select("gid", "lang")), "gid") if few else rest  # at most GROUPS rows
        rest = rest.join(kept.select("lang", "term", F.col("tid").alias("__tid")), ["lang", "term"])
        found = found.where("tid is not null").select(*group_names, "tid", "n").union(rest.select(*group_names, F.col("__tid").alias("tid"), "n"))
    found = found.groupBy(*group_names, "tid").agg(F.sum("n").alias("n"))
    return found if few else found.join(sites, ["lang", "source"]).select("gid", "tid", "n")


def met_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, both, more) of groups a and b of a language: kept terms that both have, and what these add to the sum beyond what either alone would. rows: tid, gid, p, zero."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def pairs(tid: np.ndarray, gid: np.ndarray, p: np.ndarray, zero: np.ndarray) -> Iterator[pa.RecordBatch]:
            opens = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
            sizes = np.diff(np.append(opens, len(tid)))
            mine = np.repeat(sizes, sizes)  # partners of each posting, itself among them
            first = np.repeat(opens, sizes)
            start = 0
            while start < len(tid):
                # As many postings at a time as have PAIRS partners in all, one at least.
                stop = max(start + 1, start + int(np.searchsorted(np.cumsum(mine[start:]), PAIRS, "right")))
                k = mine[start:stop]
                a = np.repeat(np.arange(start, stop), k)
                b = first[a] + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
                a, b = a[a != b], b[a != b]
                names, which = np.unique(gid, return_inverse=True)
                keys, at, both = np.unique(which[a] * len(names) + which[b], return_inverse=True, return_counts=True)
                f = lambda x, y: (x - y) * (x - y) // y
                more = np.zeros(len(keys), np.int64)
                np.add.at(more, at, f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]))
                yield pa.RecordBatch.from_arrays([pa.array(names[keys // len(names)]), pa.array(names[keys % len(names)]), pa.array(both), pa.array(more)], names=["a", "b", "both", "more"])
                start = stop

        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < POSTINGS:
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))  # the last term may go on
            if end:
                yield from pairs(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield from pairs(*held)

    dealt = rows.select("tid", "gid", "p", "zero").repartition("tid").sortWithinPartitions("tid")
    out = dealt.mapInArrow(freeing(meet), "a bigint, b bigint, both bigint, more bigint")
    return out.groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum(F.col("more").cast("decimal(20,0)")).alias("more"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", head_terms: int = HEAD_TERMS, head_chars: int = HEAD_CHARS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: every other source of the language by its divergence, and the first `top` terms that the source has more often than the language."""
    spark = docs.sparkSession
    small_batches(spark, 4096)
    rows = rows_of(docs, text, lang, source)
    kept = document_frequencies(rows).where(F.col("df") >= least)
    kept = materialize(kept.select(F.monotonically_increasing_id().alias("tid"), "lang", "term", "df"), "kept")
    sites = materialize(rows.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "sites")
    found = materialize(postings(rows, sites, kept, head_terms, head_chars), "postings")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    own = found.groupBy("gid").agg(F.sum("n").alias("total"), F.count("*").alias("some"))
    zero = F.coalesce(F.col("v"), F.lit(0))
    groups = sites.join(own, "gid", "left").join(size, "lang", "left")
    groups = groups.select("gid", "lang", "source", F.coalesce("some", F.lit(0)).alias("some"), zero.alias("v"), (F.coalesce("total", F.lit(0)) + zero).alias("mass"))
    groups = materialize(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.greatest("mass", F.lit(1)))).otherwise(1)), "groups")

    slim = found.join(groups.select("gid", "lang", "source", "mass", "zero"), "gid").withColumn("p", share(F.col("n"), F.col("mass")))
    met = met_pairs(slim)
    # Terms that one source has, summed over its distinct shares; all other sources of the language see them alike.
    shares = slim.groupBy("lang", "gid", "zero", "p").agg(F.count("*").alias("m"))
    there = groups.select("lang", F.col("gid").alias("to"), F.col("zero").alias("nil"))
    wide = lambda c: c.cast("decimal(20,0)") * F.col("m").cast("decimal(18,0)")
    lone = shares.join(there, "lang").where("gid <> to").groupBy("gid", "to").agg(F.sum(wide(gap(F.col("p"), F.col("nil")))).alias("from_own"), F.sum(wide(gap(F.col("nil"), F.col("p")))).alias("from_other"))
    mine = groups.select("lang", "source", F.col("gid").alias("a"), F.col("some").alias("some_a"), F.col("zero").alias("nil_a"), "v")
    others = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("some").alias("some_b"), F.col("zero").alias("nil_b"))
    pairs = mine.join(others, "lang").where("a <> b").join(lone.select(F.col("gid").alias("a"), F.col("to").alias("b"), F.col("from_own").alias("x")), ["a", "b"], "left")
    pairs = pairs.join(lone.select(F.col("gid").alias("b"), F.col("to").alias("a"), F.col("from_other").alias("y")), ["a", "b"], "left").join(met, ["a", "b"], "left")
    nil = F.lit(0).cast("decimal(38,0)")
    neither = (F.col("v") - F.col("some_a") - F.col("some_b") + F.coalesce("both", F.lit(0))).cast("decimal(18,0)") * gap(F.col("nil_a"), F.col("nil_b")).cast("decimal(20,0)")
    value = (neither.cast("decimal(38,0)") + F.coalesce("x", nil) + F.coalesce("y", nil) + F.coalesce("more", nil)).cast("bigint")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by))

    whole = found.groupBy("tid").agg(F.sum("n").alias("all"))
    base = kept.select("tid", "lang", "term").join(whole, "tid", "left")
    mass = groups.groupBy("lang").agg((F.sum(F.col("mass") - F.col("v")) + F.first("v")).alias("mass_l"))
    base = base.join(mass, "lang").select("tid", "term", share(F.coalesce("all", F.lit(0)), F.col("mass_l")).alias("q"))
    terms = slim.join(base, "tid").where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) AS p FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
l AS (SELECT kept.lang, kept.term, 1 + (1000000000::HUGEINT * (coalesce(t.n, 0) + 1)) // (tn.n + v.v) AS q FROM kept JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM gn GROUP BY lang) tn USING (lang) LEFT JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t ON t.lang = kept.lang AND t.term = kept.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
filled AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM filled UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 200"""
