"""Hierarchical Pitman-Yor language model over word contexts, seated by Gibbs sampling.

A restaurant for each context, the word before, seats the tokens that follow it.
Each of the HEAD most frequent words is a context; all others share CLASSES
contexts by hash. All contexts share one parent, the restaurant of words without
a context, whose base measure is diffuse: each of its tables is a word of its
own, and a new table is a word that training never saw. That is the one event
"unknown word", as it is for the base, so the probabilities of the known words
and of it sum to 1 in every context. A table opened in a context is a customer of
the parent.

The sampler is a blocked Gibbs sampler whose steps are draws from exact laws. Given the
seats, a context's gamma variable g ~ Gamma(strength / discount + its tables) and
the parent's shares beta ~ Dirichlet(customers - discount, ..., strength +
discount x words) are drawn. Given these, the dishes of all contexts are
independent: c customers of a word take t tables with weight S(c, t) x (discount
x g x beta)^t, S being generalised Stirling numbers. seat() draws t for every count:
from the recursion's table to EXACT, beyond it from a convergent series or, where
tables are many, a saddle point. So no table of a dish's own enters its own law.
Each sweep after the burn-in is a sample, and a score uses the mean of the
samples' predictive probabilities.

Pairs (word, context) lie in buckets by hash: those of a head word by the pair,
all others by the word, so a frequent word is spread over buckets, and what a
rare one needs is in one. A sweep is one pass over the pairs of two customers or
more; contexts and head words, bounded in number, are summed and sent back. Texts
go to the buckets as sorted, packed postings (word, context, document of a block,
count), and the sums of each block's documents come back.

Words outside the head are named by 62-bit hashes; a word whose name meets another's is
named by a second hash, found while words are counted, so counts are exact.

Cases: null text is empty, which is the end token alone; a null doc_id trains (it isn't held out); repeated rows
are scored each and train each; a very long text is a block of its own; with
no training row every word is unknown, with probability 1; an
empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import as_bytes, body, freeing, materialize, mix, remove_table, small_batches

HEAD, CLASSES = 1 << 17, 1 << 12
CONTEXTS = HEAD + CLASSES
SWEEPS, BURN_IN, STRENGTH = 6, 2, 1.0
EXACT, SMALL, SERIES, FLUSH = 1024, 16, 8.0, 400_000
BLOCK_BYTES, BLOCK_ROWS, BUCKET_TOKENS, MOST_BUCKETS, HELD_DOCS = 6 << 20, 1 << 14, 1 << 19, 1 << 16, 1 << 21
TAIL = 1 << 62


# --- seating ---------------------------------------------------------------------------


@lru_cache(maxsize=8)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t up to most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.log(np.maximum(c - discount * t, 0)) + s[c, 1:])
    return s


def lgamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(7):
        shift = shift + np.log(x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def series(c: np.ndarray, t: np.ndarray, d: float, x: float) -> np.ndarray:
    """log S(c, t) by the alternating sum over j of binomial(t, j) x gamma(c - jd) / gamma(-jd); x: the largest t / c^d."""
    j, ratio = 1, 0.0
    while j < 20 or ratio > -40:  # terms fall once j passes their peak
        j += 1
        ratio = j * np.log(max(x, 1e-9)) + float(lgamma(1 + j * d) - lgamma(1 + j))
        if j > 400:
            break
    j = np.arange(1, j + 1)
    j = j[j * d < c.min() - 1]
    c, t, j = c[:, None], t[:, None].astype(float), j[None]
    some = j <= t
    size = np.where(some, lgamma(t + 1) - lgamma(np.where(some, t - j, 0) + 1) - lgamma(j + 1) + lgamma(c - j * d) - lgamma(c) + lgamma(1 + j * d), -np.inf)
    top = size.max(axis=1, keepdims=True)
    total = (np.exp(size - top) * np.where(j % 2 == 1, 1.0, -1.0) * np.sin(np.pi * ((j * d) % 2)) / np.pi).sum(axis=1)
    c, t = c[:, 0], t[:, 0]
    return np.log(np.maximum(total, 1e-300)) + top[:, 0] + lgamma(c) - lgamma(t + 1) - t * np.log(d)


def saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) by the saddle point of ((1 - (1 - x)^d) / d)^t x^-c."""
    t = t.astype(float)
    lo, hi = np.full(len(c), -40.0), np.full(len(c), 6.0)
    for _ in range(64):
        mid = (lo + hi) / 2
        y = np.exp(-np.exp(mid))  # 1 - x
        g = (1 - y) * y ** (d - 1) * d / np.maximum(-np.expm1(-d * np.exp(mid)), 1e-300)
        less = t * g < c
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    q = np.exp((lo + hi) / 2)
    y, x, f = np.exp(-q), -np.expm1(-q), -np.expm1(-d * q) / d
    g = x * y ** (d - 1) / f
    spread = np.maximum(t * (g + x * x * (1 - d) * y ** (d - 2) / f - g * g), 1e-12)
    m = np.maximum(c - t, 1.0)
    out = lgamma(c + 1.0) - lgamma(t + 1) + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * spread)
    out += 0.5 * np.log(2 * np.pi * m) + m * np.log(m) - m - lgamma(m + 1)  # what Stirling's formula leaves of the customers who opened no table
    return np.where(t >= c, 0.0, out)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for counts beyond the table; -inf where no such seating is."""
    out = np.full(len(c), -np.inf)
    some = np.flatnonzero((t >= 1) & (t <= c))
    x = t[some] / c[some].astype(float) ** d
    near = (1 - d) * d ** (d / (1 - d)) * x ** (1 / (1 - d)) <= SERIES
    at = some[near][np.argsort(x[near], kind="stable")]
    for part in np.array_split(at, max(1, len(at) // 2_000)):
        if len(part):
            out[part] = series(c[part], t[part], d, float((t[part] / c[part].astype(float) ** d).max()))
    if (~near).any():
        out[some[~near]] = saddle(c[some[~near]], t[some[~near]], d)
    return out


def seat_many(c: np.ndarray, z: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """seat() beyond the table: the law is log-concave, so its mode is found by halving and the draw is made among the tables within nine deviations of it."""
    logp = lambda at, t: log_stirling(c[at], t, d) + t * np.log(z[at])
    every = np.arange(len(c))
    lo, hi = np.ones(len(c), np.int64), np.minimum(c, np.ceil(2 + 2 * z / d)).astype(np.int64)
    while (lo < hi).any():
        at = np.flatnonzero(lo < hi)
        mid = (lo[at] + hi[at]) // 2
        rises = logp(at, mid + 1) > logp(at, mid)
        lo[at], hi[at] = np.where(rises, mid + 1, lo[at]), np.where(rises, hi[at], mid)
    at_mode, beside = logp(every, lo), np.fmax(logp(every, np.maximum(lo - 1, 1)), logp(every, np.minimum(lo + 1, c)))
    width = np.ceil(9 / np.sqrt(np.maximum(at_mode - beside, 1e-9))).clip(12, 4 * np.sqrt(lo) + 40).astype(np.int64) if len(c) else lo
    out = np.ones(len(c), np.int64)
    for k in every:
        t = np.arange(max(1, lo[k] - width[k]), min(c[k], lo[k] + width[k]) + 1)
        p = log_stirling(np.full(len(t), c[k]), t, d) + t * np.log(z[k])
        p = np.cumsum(np.exp(p - p.max()))
        out[k] = t[min(int(np.searchsorted(p, u[k] * p[-1])), len(t) - 1)]
    return out


def seat(c: np.ndarray, z: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of each dish, t with weight S(c, t) x z^t: c customers, discount d, u uniform draws."""
    t = (c > 0).astype(np.int64)
    law, pull = stirling(d), np.log(np.maximum(z, 1e-300))
    order = np.argsort(np.minimum(c, EXACT + 1).astype(np.uint16), kind="stable")
    sizes, first = np.unique(c[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        if not 2 <= size <= EXACT:
            continue
        if size <= SMALL:  # a polynomial in z
            terms, power, total = [], z[rows], 0.0
            for weight in np.exp(law[size, 1 : size + 1]).tolist():
                total = total + weight * power
                terms.append(total)
                power = power * z[rows]
            left = u[rows] * total
            t[rows] = 1 + sum((x < left).astype(np.int64) for x in terms[:-1])
            continue
        step = np.arange(1, size + 1)
        for part in np.array_split(rows, -(-len(rows) * size // 2_000_000)):
            p = pull[part, None] * step + law[size, 1 : size + 1]
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            t[part] = 1 + (p < u[part, None] * p[:, -1:]).sum(axis=1).clip(0, size - 1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        t[many] = seat_many(c[many], np.maximum(z[many], 1e-300), d, u[many])
    return t


# --- words, blocks and buckets --------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Tokens of each text, words, and each token's place among them: lower-case (A-Z) words, and after each text the end, which is the empty word."""
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, cut = parts.flatten(), parts.offsets.to_numpy()
    found = flat.dictionary_encode()
    words = [*as_bytes(found.dictionary), b""]
    filled = pc.binary_length(flat).to_numpy() > 0  # white space at a text's ends leaves empty strings
    n = np.diff(np.concatenate([[0], np.cumsum(filled)])[cut - cut[0]])
    at = np.full(int(n.sum()) + len(n), len(words) - 1)
    inner = np.ones(len(at), bool)
    inner[np.cumsum(n + 1) - 1] = False
    at[inner] = found.indices.to_numpy()[filled]
    return n + 1, words, at


def names(words: list[bytes], second: bool = False) -> np.ndarray:
    """Names of words; the second ones don't depend on the first."""
    import xxhash

    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest if second else xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return (hashed >> np.uint64(2) | np.uint64(TAIL)).astype(np.int64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """name, second and c, the count in training, of the tokens of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            columns = names(seen), names(seen, True), np.fromiter(seen.values(), np.int64, len(seen))
            for at in range(0, len(seen), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in columns], names=["name", "second", "c"])
            seen.clear()

        for block in blocks(batches, 0):
            n, words, at = tokens_of(block.column(0))
            trains = np.repeat(~np.asarray(block.column(1)), n)
            for word, count in zip(words, np.bincount(at, trains, len(words)).astype(np.int64).tolist(), strict=True):
                seen[word] += count
            if len(seen) > FLUSH:
                yield from flush()
        yield from flush()

    rows = docs.select(body().alias("t"), held_out().alias("held"))
    return rows.mapInArrow(freeing(run), "name bigint, second bigint, c bigint").repartition("name").groupBy("name", "second").agg(F.sum("c").alias("c"))


class Codes:
    """Codes of words: a head word's rank, else its name, the second one if the first is another word's too."""

    def __init__(self, head: np.ndarray, doubled: np.ndarray):
        self.order = np.argsort(head)
        self.head, self.doubled = head[self.order], doubled

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = names(words)
        if len(self.doubled):
            out = np.where(np.isin(out, self.doubled), names(words, True), out)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, out), len(self.head) - 1)
            out = np.where(self.head[at] == out, self.order[at], out)
        return out


def context_of(w: np.ndarray) -> np.ndarray:
    return np.where(w < HEAD, w, HEAD + (mix(w.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.int64))


def indexed(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words outside the head, and small numbers of all: a head word's own, then those of the others in order."""
    tail = np.flatnonzero(w >= HEAD)
    word, place = np.unique(w[tail], return_inverse=True)
    at = w.copy()
    at[tail] = HEAD + place
    return word, at


def worded(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Codes of the numbers that indexed() gives."""
    out, tail = at.copy(), at >= HEAD
    out[tail] = word[at[tail] - HEAD]
    return out


def bucket_of(w: np.ndarray, u: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.where(w < HEAD, w * CONTEXTS + u + 1, w).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def coded(texts: pa.Array, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's document, code and context; the end stands before a text's first token."""
    n, words, at = tokens_of(texts)
    of = codes(words)
    w = of[at]
    before = np.concatenate([of[-1:], w[:-1]])[: len(w)]
    before[np.cumsum(n) - n] = of[-1]
    return np.repeat(np.arange(len(n)), n), w, context_of(before)


def blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of about BLOCK_BYTES of text and at most BLOCK_ROWS rows."""
    own, held, rows = [], 0, 0
    for batch in batches:
        size = np.diff(np.frombuffer(batch.column(text).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(text).offset :][: batch.num_rows + 1]) if batch.num_rows else []
        start = 0
        for k, n in enumerate(size):
            held, rows = held + int(n), rows + 1
            if held >= BLOCK_BYTES or rows == BLOCK_ROWS:
                own.append(batch.slice(start, k + 1 - start))
                yield pa.concat_batches(own)
                own, held, rows, start = [], 0, 0, k + 1
        if start < batch.num_rows:
            own.append(batch.slice(start))
    if own:
        yield pa.concat_batches(own)


def narrowed(column: np.ndarray) -> np.ndarray:
    if column.dtype == np.float64 or not len(column):
        return column
    least, most = int(column.min()), int(column.max())
    return column.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


@lru_cache(1)
def codec() -> tuple:
    """A worker's compressor and decompressor: their work space costs more to make than a small blob to pack."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*columns: np.ndarray) -> bytes:
    """Columns, the first as differences, in the least width, byte by byte and compressed: sorted columns shrink most."""
    columns = [narrowed(c) for c in (np.diff(columns[0], prepend=0), *columns[1:])]
    head = f"{len(columns[0])} {' '.join(c.dtype.str for c in columns)}\n".encode()
    return codec()[0].compress(head + b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns))


def unpack(data: bytes) -> list[np.ndarray]:
    head, _, raw = codec()[1].decompress(data).partition(b"\n")
    n, *kinds = head.decode().split(" ")
    n, at, out = int(n), 0, []
    for kind in map(np.dtype, kinds):
        column = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind)
        out.append(column if kind.kind == "f" else column.astype(np.int64))
        at += n * kind.itemsize
    out[0] = np.cumsum(out[0])
    return out


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed columns by bucket; rows keep their order."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")  # at most 2^16 buckets
    cut = np.concatenate([[0], np.cumsum(np.bincount(bucket))])
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, pack(*(c[cut[b] : cut[b + 1]] for c in columns))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time, with whether their first column's value begins a run."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[0] != last, row
            last = row[0]


def table_of(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


# --- counts -----------------------------------------------------------------------------------


def bucket_row(bucket: int, blobs: list[bytes]) -> tuple:
    """A bucket's pairs (w, u, c), its state, sums by code, and counts of pairs and words."""
    w, u, n = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
    word, wi = np.unique(w, return_inverse=True)
    key, at = np.unique(wi * CONTEXTS + u, return_inverse=True)
    c, wi, u = np.bincount(at, n).astype(np.int64), key // CONTEXTS, key % CONTEXTS
    w = word[wi]
    many = c >= 2
    alone, several = np.bincount(wi[~many], minlength=len(word)), np.bincount(wi[many], minlength=len(word))
    tail = word >= HEAD
    kept = tail & (several > 0)
    rest = tail & (several == 0)
    code, place = np.unique(np.concatenate([u, CONTEXTS + w[w < HEAD]]), return_inverse=True)
    of_u, of_w = place[: len(u)], place[len(u) :]
    n = len(code)
    sums = np.bincount(of_u, ~many, n) + np.bincount(of_w, ~many[w < HEAD], n), np.bincount(of_u, many, n) + np.bincount(of_w, many[w < HEAD], n), np.bincount(of_u, c, n)
    state = pack(w[many], u[many], c[many], np.ones(int(many.sum()), np.int64), np.zeros(int(many.sum()), np.int64))
    words = pack(word[kept], alone[kept])
    met = (alone + several)[tail]
    return (bucket, pack(w, u, c), state, words, pack(code, *(s.astype(np.int64) for s in sums)), int((c == 1).sum()), int((c == 2).sum()), int((met == 1).sum()), int((met == 2).sum()), int(rest.sum()), int(alone[rest].sum()), int(met.sum()))


PAIRS = [("bucket", pa.int64()), ("pairs", pa.binary()), ("state", pa.binary()), ("words", pa.binary()), ("sums", pa.binary()), *((x, pa.int64()) for x in ("n1", "n2", "w1", "w2", "rest", "rest_customers", "tail_customers"))]


def as_schema(columns: list[tuple[str, pa.DataType]]) -> str:
    kinds = {pa.int64(): "bigint", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in columns)


def pair_table(docs: DataFrame, buckets: int, words) -> DataFrame:
    """A row for each bucket of training pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*words.value)
        for block in blocks(batches, 0):
            _, w, u = coded(block.column(0), codes)
            word, at = indexed(w)
            key, n = np.unique(at * CONTEXTS + u, return_counts=True)
            w, u = worded(word, key // CONTEXTS), key % CONTEXTS
            yield table_of(list(dealt(bucket_of(w, u, buckets), w, u, n)), [("bucket", pa.int64()), ("x", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for fresh, (bucket, x) in runs(batches):
            if fresh and blobs:
                yield table_of([bucket_row(at, blobs)], PAIRS)
                blobs = []
            at = bucket
            blobs.append(x)
        if blobs:
            yield table_of([bucket_row(at, blobs)], PAIRS)

    rows = docs.where(~held_out()).select(body().alias("t")).mapInArrow(freeing(count), "bucket bigint, x binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(freeing(merge), as_schema(PAIRS))


def summed(table: DataFrame, columns: int) -> np.ndarray:
    """(columns, CONTEXTS + HEAD) sums over all buckets, from packed sums by code: at most CONTEXTS + HEAD rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, CONTEXTS + HEAD), np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                code, *sums = unpack(x)
                for own, part in zip(total, sums, strict=True):
                    own[code] += part
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], names=["code", *(f"s{k}" for k in range(columns))])

    names_ = [f"s{k}" for k in range(columns)]
    got = table.where("sums is not null").select("sums").mapInArrow(run, "code bigint, " + ", ".join(f"{n} bigint" for n in names_)).groupBy("code").agg(*(F.sum(n).alias(n) for n in names_)).toArrow()
    out = np.zeros((columns, CONTEXTS + HEAD), np.int64)
    out[:, got["code"].to_numpy()] = [got[n].to_numpy() for n in names_]
    return out


# --- sampling ---------------------------------------------------------------------------------


def discount_of(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.5


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array(key, np.uint64)))


class Model:
    """What the samples share and hold: discounts of contexts (d) and of the parent (d0), tokens, words, customers by context, and by sample the contexts' rooms, head words' and all customers of the parent."""

    def __init__(self, tokens: int, distinct: int):
        self.tokens, self.distinct, self.d, self.d0 = tokens, distinct, 0.5, 0.5
        self.customers = np.zeros(CONTEXTS)
        self.rooms: list[np.ndarray] = []
        self.head: list[np.ndarray] = []
        self.total: list[float] = []

    def keep(self, tables: np.ndarray, head: np.ndarray) -> None:
        self.rooms.append(STRENGTH + self.d * tables)
        self.head.append(head)
        self.total.append(STRENGTH + float(tables.sum()))

    def base(self, customers: list[np.ndarray]) -> np.ndarray:
        """(words, samples) probabilities without a context, of words with so many customers in each sample."""
        return np.stack([(c - self.d0) / n for c, n in zip(customers, self.total, strict=True)], axis=1)

    def unknown(self) -> np.ndarray:
        return (STRENGTH + self.d0 * self.distinct) / np.array(self.total) if self.distinct else np.ones(len(self.total))


SUMS = -1  #: the bucket of a task's sums
STATE = [("bucket", pa.int64()), ("state", pa.binary()), ("words", pa.binary()), ("sums", pa.binary()), ("gamma", pa.float64())]


def reseated(row: tuple, sweep: int, d: float, d0: float, g: np.ndarray, share: np.ndarray, total: float, kept: int, sums: np.ndarray) -> tuple[tuple, float]:
    """A bucket's row after a sweep, whose tables it adds to sums, and the sum of its words' next gamma draws.

    Draws depend on bucket and sweep alone, so a task that runs again draws the same.
    """
    bucket, state, words = row[:3]
    w, u, c, t, held = unpack(state)
    word, alone, *history = unpack(words)
    tail = np.flatnonzero(w >= HEAD)
    head = np.flatnonzero(w < HEAD)
    wi = np.searchsorted(word, w[tail])
    customers = alone + np.bincount(wi, t[tail], len(word)).astype(np.int64)
    draws = generator(bucket, sweep)
    gamma = draws.standard_gamma(customers - d0) if sweep else customers - d0
    beta = np.zeros(len(w))
    beta[head], beta[tail] = share[w[head]], gamma[wi]
    t = seat(c, d * g[u] * beta / total, d, draws.random(len(c)))
    customers = alone + np.bincount(wi, t[tail], len(word)).astype(np.int64)
    if kept >= 0:
        held, history = held + t, [*history, customers]
    sums[:CONTEXTS] += np.bincount(u, t, CONTEXTS).astype(np.int64)
    sums[CONTEXTS:] += np.bincount(w[head], t[head], HEAD).astype(np.int64)
    return (bucket, pack(w, u, c, t, held), pack(word, alone, *history), None, 0.0), float(generator(bucket, sweep + 1).standard_gamma(customers - d0).sum())


def drawn(model: Model, sweep: int, tables: np.ndarray, head: np.ndarray, ahead: float, rest: int, rest_customers: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Draws given all seats: contexts' gamma variables, head words' gammas, and the sum of all gammas of the parent; the first sweep has the parent's means.

    ahead: the sum that the buckets drew for their words; rest: words outside the head that stand in single pairs alone, whose customers never change.
    """
    draws = generator(2**63, sweep)
    g = draws.standard_gamma(STRENGTH / model.d + tables)
    if not sweep:
        return g, np.where(head > 0, head - model.d0, 0.0), STRENGTH + float(tables.sum())
    share = np.where(head > 0, draws.standard_gamma(np.maximum(head - model.d0, 1e-9)), 0.0)
    new, others = draws.standard_gamma(STRENGTH + model.d0 * model.distinct), draws.standard_gamma(rest_customers - model.d0 * rest) if rest else 0.0
    return g, share, float(share.sum() + ahead + new + others)


def train(docs: DataFrame, vocab: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[Model, DataFrame, DataFrame, object, int]:
    """The sampled model, the pairs, the pairs' last state, the words' codes (broadcast) and the number of buckets."""
    sc = docs.sparkSession.sparkContext
    tokens, distinct = vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    model = Model(tokens or 0, distinct)
    # The head: all words from the least count, on a fine scale, that no more than HEAD words reach.
    scale = F.floor(F.log2("c") * 256)
    steps = sorted(((r.step, r.n) for r in vocab.where("c > 0").groupBy(scale.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most 64 x 256 rows
    held = np.cumsum([n for _, n in steps])
    least = next((s for (s, _), n in zip(reversed(steps), held[::-1], strict=True) if n <= HEAD), None)
    doubled = frozenset(r.name for r in vocab.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name").collect())  # one pair is expected among three billion words
    name = F.when(F.col("name").isin(list(doubled)), F.col("second")).otherwise(F.col("name")) if doubled else F.col("name")
    top = [] if least is None else sorted((-r.c, r.name) for r in vocab.where((F.col("c") > 0) & (scale >= int(least))).select(name.alias("name"), "c").collect())
    words = sc.broadcast((np.array([n for _, n in top], np.int64), np.array(sorted(doubled), np.int64)))
    counts = np.zeros(HEAD, np.int64)
    counts[: len(top)] = [-c for c, _ in top]
    buckets = int(min(max(model.tokens // BUCKET_TOKENS, 1), MOST_BUCKETS))
    pairs = materialize(pair_table(docs, buckets, words), "pairs")
    alone, several, customers = summed(pairs, 3)
    n1, n2, w1, w2, rest, rest_customers, tail_customers = (x or 0 for x in pairs.agg(*(F.sum(x) for x in ("n1", "n2", "w1", "w2", "rest", "rest_customers", "tail_customers"))).first())
    head = (alone + several)[CONTEXTS:]
    model.d, model.d0 = discount_of(n1, n2), discount_of(w1 + int((head == 1).sum()), w2 + int((head == 2).sum()))
    model.customers, model.counts = customers[:CONTEXTS].astype(float), counts
    state, gone = pairs.select("bucket", "state", "words", "sums", F.lit(0.0).alias("gamma")), None
    tables, ahead = (alone + several)[:CONTEXTS], 0.0
    schema = as_schema(STATE)
    for sweep in range(sweeps):
        kept = sweep - burn_in
        sent = sc.broadcast((model.d, model.d0, *drawn(model, sweep, tables, head, ahead, rest, rest_customers)))

        def run(batches: Iterator[pa.RecordBatch], sweep=sweep, kept=kept, sent=sent) -> Iterator[pa.RecordBatch]:
            sums, gamma = np.zeros(CONTEXTS + HEAD, np.int64), 0.0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row, ahead = reseated(row, sweep, *sent.value, kept, sums)
                    gamma += ahead
                    yield table_of([row], STATE)
            code = np.flatnonzero(sums)
            yield table_of([(SUMS, None, None, pack(code, sums[code]), gamma)], STATE)

        state, before = materialize(state.where(F.col("bucket") != SUMS).mapInArrow(freeing(run), schema), "seats"), gone
        gone = state
        if before is not None:
            remove_table(before)
        now = summed(state, 1)[0]
        tables, head = (alone[:CONTEXTS] + now[:CONTEXTS]), alone[CONTEXTS:] + now[CONTEXTS:]
        ahead = state.agg(F.sum("gamma")).first()[0] or 0.0
        sent.unpersist()
        if kept >= 0:
            model.keep(tables, head)
    return model, pairs, state, words, buckets


# --- scores -------------------------------------------------------------------------------------


class Bucket:
    """Probabilities of a bucket's pairs, and of its words in contexts that they never followed."""

    def __init__(self, model: Model, rooms: np.ndarray, pairs: bytes | None, state: bytes | None, words: bytes | None):
        self.model, self.rooms = model, rooms
        w, u, c = unpack(pairs) if pairs else np.zeros((3, 0), np.int64)
        self.word, wi = np.unique(w, return_inverse=True)
        self.tokens = np.bincount(wi, c, len(self.word)).astype(np.int64)
        samples = len(model.total)
        customers = [np.bincount(wi, minlength=len(self.word)) for _ in range(samples)]  # a word of single pairs alone has as many customers as pairs
        seats = np.ones(len(c)) * samples
        self.key = wi * CONTEXTS + u
        if state:
            sw, su, _, _, held = unpack(state)
            seats[np.searchsorted(self.key, np.searchsorted(self.word, sw) * CONTEXTS + su)] = held
            code, _, *history = unpack(words)
            at = np.searchsorted(self.word, code)
            for k in range(samples):
                customers[k][at] = history[k]
        head = self.word < HEAD
        for k in range(samples):
            customers[k][head] = model.head[k][self.word[head]]
        self.base = model.base(customers)
        self.seen = np.log10((c - model.d * seats / samples + (rooms[u] * self.base[wi]).mean(axis=1)) / (STRENGTH + model.customers[u]))

    def log10(self, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the mean predictive probability of w after u, and the count of w in training where w is a word outside the head."""
        n = len(self.word)
        wi = np.minimum(np.searchsorted(self.word, w), max(n - 1, 0))
        known = (self.word[wi] == w) if n else np.zeros(len(w), bool)
        key = wi * CONTEXTS + u
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        out = np.zeros(len(w))
        hit = known & (self.key[at] == key) if n else known
        out[hit] = self.seen[at[hit]]
        miss = np.flatnonzero(~hit)
        base = np.repeat(self.model.unknown()[None], len(miss), axis=0)
        own = known[miss]
        base[own] = self.base[wi[miss[own]]]
        head = ~own & (w[miss] < HEAD)  # a head word that no pair of this bucket has
        base[head] = self.model.base([h[w[miss[head]]] for h in self.model.head])
        out[miss] = np.log10((self.rooms[u[miss]] * base).mean(axis=1) / (STRENGTH + self.model.customers[u[miss]]))
        return out, np.where(known, self.tokens[wi] if n else 0, 0)


PARTS = [("bucket", pa.int64()), ("kind", pa.int64()), ("block", pa.int64()), ("x", pa.binary()), ("y", pa.binary())]
SCORES = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
META, PAIR, SEATS, POSTED = -1, 0, 1, 2


def score_documents(docs: DataFrame, model: Model, pairs: DataFrame, state: DataFrame, words, buckets: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for each row of docs."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model, np.stack(model.rooms, axis=1)))
    none = np.log10(model.tokens + model.distinct + 1.0)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, counts = Codes(*words.value), shared.value[0].counts
        place = TaskContext.get().partitionId() << 32
        for k, block in enumerate(blocks(batches, 1)):
            doc, w, u = coded(block.column(1), codes)
            docs_ = block.num_rows
            head = w < HEAD
            base = np.bincount(doc[head], np.log10(counts[w[head]] + 1.0) - none, docs_)
            meta = pack(np.arange(docs_), np.asarray(block.column(0).is_valid()).astype(np.int64), np.asarray(block.column(0).fill_null(0)), np.bincount(doc, minlength=docs_), np.bincount(doc[head], minlength=docs_), base)
            word, at = indexed(w)
            pair, doc = np.divmod(np.sort((at * CONTEXTS + u) * docs_ + doc), docs_)
            first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
            n, pair, doc = np.diff(first, append=len(pair)), pair[first], doc[first]
            at, u = np.divmod(pair, CONTEXTS)
            w = worded(word, at)
            bucket = bucket_of(w, u, buckets)
            rows = [(b, POSTED, place + k, x, None) for b, x in dealt(bucket, w, u, doc, n)]
            yield table_of([((place + k) % buckets, META, place + k, meta, None), *rows], PARTS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rooms = shared.value
        parts: dict[int, np.ndarray] = {}
        held, bucket, found, seats = 0, None, None, (None, None)

        def flush() -> Iterator[pa.RecordBatch]:
            for block, a in parts.items():
                at = np.flatnonzero(a.any(axis=0))
                yield table_of([(block, POSTED, pack(at, a[0, at].astype(np.int64), a[1, at], a[2, at]))], [("block", pa.int64()), ("kind", pa.int64()), ("x", pa.binary())])
            parts.clear()

        for fresh, (_, kind, block, x, y) in runs(batches):
            if fresh:
                bucket, found, seats = None, None, (None, None)
            if kind == META:
                yield table_of([(block, META, x)], [("block", pa.int64()), ("kind", pa.int64()), ("x", pa.binary())])
            elif kind == PAIR:
                found = x
            elif kind == SEATS:
                seats = x, y
            else:
                bucket = bucket or Bucket(own, rooms, found, *seats)
                w, u, doc, n = unpack(x)
                value, count = bucket.log10(w, u)
                tail = w >= HEAD
                if block not in parts or parts[block].shape[1] <= doc.max():
                    grown = np.zeros((3, int(doc.max()) + 1))
                    if block in parts:
                        grown[:, : parts[block].shape[1]] = parts[block]
                    held += grown.shape[1]
                    parts[block] = grown
                a = parts[block]
                size = a.shape[1]
                a[0] += np.bincount(doc[tail], n[tail] * (count[tail] > 0), size)
                a[1] += np.bincount(doc[tail], n[tail] * (np.log10(count[tail] + 1.0) - none), size)
                a[2] += np.bincount(doc, n * value, size)
                if held > HELD_DOCS:
                    yield from flush()
                    held = 0
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, meta = None, None

        def out() -> pa.RecordBatch:
            valid, ids, n, known, base = meta
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(n), pa.array(known + total[0].astype(np.int64)), pa.array(base + total[1]), pa.array(total[2])], names=[x for x, _ in SCORES])

        for fresh, (_, kind, x) in runs(batches):
            if fresh and meta is not None:
                yield out()
            if kind == META:
                _, valid, ids, n, known, base = unpack(x)
                meta, total = (valid, ids, n, known, base), np.zeros((3, len(ids)))
            else:
                at, known, base, value = unpack(x)
                total[:, at] += [known, base, value]
        if meta is not None:
            yield out()

    blank = F.lit(None).cast("binary")
    zero = F.lit(0).cast("bigint")
    kind = lambda k: F.lit(k).cast("bigint").alias("kind")
    posted = docs.select(F.col("doc_id").cast("bigint"), body().alias("t")).mapInArrow(freeing(post), as_schema(PARTS))
    held = pairs.select("bucket", kind(PAIR), zero.alias("block"), F.col("pairs").alias("x"), blank.alias("y"))
    seats = state.where(F.col("bucket") != SUMS).select("bucket", kind(SEATS), zero.alias("block"), F.col("state").alias("x"), F.col("words").alias("y"))
    rows = posted.unionAll(held).unionAll(seats).repartition("bucket").sortWithinPartitions("bucket", "kind", "block")
    sums = rows.mapInArrow(freeing(score), "block bigint, kind bigint, x binary").repartition("block").sortWithinPartitions("block", "kind")
    return sums.mapInArrow(freeing(add), as_schema(SCORES))


def perplexity(scored: DataFrame, score: str = "score") -> DataFrame:
    """Per held_out: tokens and perplexity a token."""
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens")).alias("perplexity"))


def model_documents(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[DataFrame, Model]:
    """Scores of all rows under the model of those that aren't held out, and the model."""
    small_batches(docs.sparkSession, 512)
    vocab = materialize(vocabulary(docs), "vocabulary")
    model, pairs, state, words, buckets = train(docs, vocab, sweeps, burn_in)
    return score_documents(docs, model, pairs, state, words, buckets), model


def op2_lm(spark, sf_dir: str) -> DataFrame:
    scored, model = model_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
