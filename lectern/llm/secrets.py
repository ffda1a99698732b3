"""Secret scans: fixed patterns, and novelty under a primed zstandard dictionary.

The fixed patterns (kinds assign, access, hex) give the base spans. Beside them
a candidate is a run of LEAST or more characters without white space, quotes or
brackets that comes within REACH code points of a sensitive word, before or after it, on its line or the next.
It is measured by its marginal compressed bytes: the size of the surrounding
text with the candidate less the size without it, under a dictionary of the identifiers that the
corpus has near sensitive words, most frequent last, so that names, paths and repeated values come out cheap. From
`novelty` bytes a byte on, it is reported as kind novel. The size alone decides, not an alphabet. Novel spans that
touch a base span are left out; base spans always stay.

Cases: null text is empty and has no spans; offsets are code points, end
exclusive; spans of equal start keep the order of KINDS; whole texts are
scanned, however long; repeated rows give repeated rows; an empty table gives an
empty one; other columns may have any name, those of the result in `keep` excepted, which is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import body, freeing, small_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST, REACH, AROUND, NOVELTY, DICTIONARY_WORDS, LEAST_SEEN = 12, 64, 600, 0.85, 1_000, 5
CANDIDATE = re.compile(r"""[^\s"'`<>()\[\]{},;|]{%d,}""" % LEAST)
ROOTS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "private", "signature", "session", "login")
SENSITIVE = re.compile(r"(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth|encryption|signing)?key|auth(?:orization|entication)?|cred(?:ential)?|bearer|signature|session|login)s?(?![a-z])", re.I | re.A)
#: What may stand before a sensitive word as part of it.
PREFIX = re.compile(r"[a-z0-9]*[_-]", re.I | re.A)
#: Dates and times of day are as hard to compress as keys of their length, and no secrets.
DATE = re.compile(r"\d{4}[-/.]\d{2}[-/.]\d{2}(?:[T_-]?\d{2}[:.]\d{2}(?:[:.]\d{2}(?:[.]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?[.:]?", re.A)
IDENTIFIER = re.compile(r"[A-Za-z_]{3,32}")
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key authorization bearer credential session cookie login username "
    "account client_id client_secret signature certificate public static final class function return import export const import from "
    "config settings environment variable default value string number boolean object array index length version release build "
    "https://www. http:// .com .org .net .html .json .yaml /usr/local/lib /home/user/ sha256 md5 base64 utf-8 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def sensitive(text: str) -> Iterator[tuple[int, int]]:
    """Sensitive words with what belongs to them; in time proportional to the text."""
    done = 0
    for m in SENSITIVE.finditer(text):
        start = m.start()
        if start > done and text[start - 1] in "_-":
            start -= 1
            while start > done and text[start - 1].isascii() and text[start - 1].isalnum():
                start -= 1
        yield start, m.end()
        done = m.end()


def learn_identifiers(docs: DataFrame, text: str = "text") -> str:
    """The dictionary: fixed identifiers, and the DICTIONARY_WORDS that stand around sensitive words in most documents of the corpus, of all that do in LEAST_SEEN or more."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                lower = value.lower()
                if any(r in lower for r in ROOTS):
                    near: list[list[int]] = []
                    for start, end in sensitive(value):
                        if near and near[-1][1] >= start - AROUND:
                            near[-1][1] = end + AROUND
                        else:
                            near.append([max(0, start - AROUND), end + AROUND])
                    seen.update({w for start, end in near for w in IDENTIFIER.findall(value, start, end)})
            if len(seen) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["w", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["w", "n"])

    words = docs.select(body(text).alias("t")).mapInArrow(freeing(run), "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    top = words.where(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "w").limit(DICTIONARY_WORDS).collect()
    return " ".join([IDENTIFIERS, *(r.w for r in reversed(top))])


class NoveltyScanner:
    def __init__(self, novelty: float = NOVELTY, dictionary: str = IDENTIFIERS):
        import zstandard as z

        self.novelty = novelty
        self.packer = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(dictionary.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)

    def marginal(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that text[start:end] adds to its surroundings, a byte: the middle of three surroundings, as one alone may meet a step of the packer's."""
        own, sizes = text[start:end], []
        for before, after in ((AROUND, AROUND), (AROUND // 5, AROUND * 4 // 5), (AROUND * 2 // 5, AROUND * 3 // 5)):
            left, right = text[max(0, start - before) : start], text[end : end + after]
            sizes.append(len(self.packer.compress((left + own + right).encode())) - len(self.packer.compress((left + right).encode())))
        return sorted(sizes)[1] / len(own.encode())

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """Runs near sensitive words, in order, each once; every character is searched once, so the time is proportional to the text."""
        run, seen, none = None, 0, (len(text) + 2 * REACH, len(text) + 2 * REACH)
        for first, last in sensitive(text):
            while run is None or run[0] < last + REACH:
                if run is not None and run[1] > first - REACH:
                    yield run
                start = max(seen, first - REACH)
                while start > seen and not text[start - 1].isspace():  # runs begin before the reach
                    start -= 1
                found = CANDIDATE.search(text, start)
                run = found.span() if found else none
                seen = found.end() if found else len(text)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's index, end), in order."""
        lower = text.lower()
        found = []
        if any(w in lower for w in ("passw", "secret", "token", "api")):
            found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        if not any(r in lower for r in ROOTS):
            return sorted(found)
        taken, k, novel = [], 0, []
        for a, _, b in sorted(found):  # disjoint stretches
            if taken and a < taken[-1][1]:
                taken[-1] = taken[-1][0], max(taken[-1][1], b)
            else:
                taken.append((a, b))
        for start, end in self.candidates(text):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k < len(taken) and taken[k][0] < end:
                continue
            named = PREFIX.match(text, start, end)
            if SENSITIVE.fullmatch(text, named.end() if named else start, end) is None and SENSITIVE.fullmatch(text, start, end) is None and DATE.fullmatch(text, start, end) is None and self.marginal(text, start, end) >= self.novelty:
                novel.append((start, 3, end))
        return sorted(found + novel)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch of overlapping spans replaced by a mark with the first span's kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"<secret:{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])


RESULT = ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")


def scan_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False, novelty: float = NOVELTY, dictionary: str = IDENTIFIERS) -> DataFrame:
    """The columns of keep, the counts by kind, the base spans' hash, all spans, and the redacted text if asked for."""
    clash = {*keep} & {*RESULT, "redacted"}
    if clash:
        raise ValueError(f"keep names columns of the result: {', '.join(sorted(clash))}")
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, body(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string" + ", redacted string" * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NoveltyScanner(novelty, dictionary)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, all_spans, texts = [], [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                spans = scanner.spans(value)
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(listed([s for s in spans if s[1] != 3]).encode()).hexdigest())
                all_spans.append(listed(spans))
                if redact:
                    texts.append(redacted(value, spans) if spans else value)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * redact, names=[*keep, *RESULT] + ["redacted"] * redact)

    return rows.mapInArrow(freeing(run), schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_documents(docs, dictionary=learn_identifiers(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced by marks; n_chars counts the new text's code points. A null text stays null."""
    names = docs.columns
    rows = docs.select(F.struct(*(c for c in names if c not in ("text", "n_chars"))).alias("row"), F.col("text").isNull().alias("blank"), "text")
    out = scan_documents(rows, keep=("row", "blank"), redact=True, dictionary=learn_identifiers(docs))
    text = F.when(~F.col("blank"), F.col("redacted"))
    of = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("bigint")}
    return out.select(*(of[c].alias(c) if c in of else F.col("row").getField(c).alias(c) for c in names))
