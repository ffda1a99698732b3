"""§2.12: the engine's functions in SQL.

register() gives a session token_f1, normalise_answer, allocate_budget and is_degenerate as SQL functions, whose bodies Catalyst inlines
like any expression, and chunk_windows as a table function: of a table of any columns, by the partition and order that the query
names.

    SELECT token_f1('a b', answer) FROM t
    SELECT * FROM chunk_windows(TABLE(pages) PARTITION BY source_file ORDER BY page, text_column => 'text', size => 220, overlap => 40)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lectern.operators.chunking import OVERLAP, SIZE, window_count

# Parts of a round of allocate_budget: s holds what each rank got and the room that is left; d what the round has dealt so far. Ranks
# weigh 0.85 to their power, a share is floored, and a round that deals nothing gives the first hungry ranks one each.
HUNGRY = "s.got[k] < lengths[k]"
TOTAL = f"aggregate(sequence(0, size(lengths) - 1), 0D, (t, k) -> t + if({HUNGRY}, power(0.85D, k), 0D))"


def dealt(share: str) -> str:
    add = f"if({HUNGRY}, least({share}, lengths[k] - s.got[k], d.room), 0)"
    return f"aggregate(sequence(0, size(lengths) - 1), named_struct('got', CAST(array() AS ARRAY<INT>), 'room', s.room), (d, k) -> named_struct('got', array_append(d.got, s.got[k] + {add}), 'room', d.room - {add}))"


DEAL, ONES = dealt(f"CAST(floor(s.room * power(0.85D, k) / {TOTAL}) AS INT)"), dealt("1")

BODIES = {
    "normalise_answer(answer STRING) RETURNS STRING": r"""btrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(answer),
        r'(?U)(?<=\d),(?=\d)', ''), r'(?U)(\d)\s+(\d)', '$1$2'), '[^a-z0-9.]+', ' '), r'(?<!\d)\.|\.(?!\d)', ' '), r'\s+', ' '))""",
    "shared_tokens(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS INT": """aggregate(
        array_sort(concat(transform(a, x -> struct(x AS t, 0 AS of)), transform(b, x -> struct(x AS t, 1 AS of)))),
        named_struct('t', CAST(NULL AS STRING), 'a', 0, 'b', 0, 'n', 0),
        (s, x) -> named_struct('t', x.t, 'a', if(s.t <=> x.t, s.a, 0) + if(x.of = 0, 1, 0), 'b', if(s.t <=> x.t, s.b, 0) + if(x.of = 1, 1, 0), 'n', s.n + if(s.t <=> x.t, 0, least(s.a, s.b))),
        s -> s.n + least(s.a, s.b))""",
    "answer_tokens(answer STRING) RETURNS ARRAY<STRING>": "filter(split(normalise_answer(answer), ' '), w -> w <> '')",
    "token_f1(expected STRING, got STRING) RETURNS DOUBLE": """if(size(answer_tokens(expected)) + size(answer_tokens(got)) = 0, 0D,
        2D * shared_tokens(answer_tokens(expected), answer_tokens(got)) / (size(answer_tokens(expected)) + size(answer_tokens(got))))""",
    "is_degenerate(text STRING) RETURNS BOOLEAN": r"""NOT rlike(coalesce(text, ''), r'(?U)\S') OR rlike(coalesce(text, ''), r'(?U)^[\s()\d,]+$')
        OR (regexp_count(coalesce(text, ''), r'\|') > 10 AND regexp_count(coalesce(text, ''), '[A-Za-z]{3,}') < 8)""",
    "allocate_budget(lengths ARRAY<INT>, budget INT) RETURNS ARRAY<INT>": f"""CASE WHEN lengths IS NULL THEN NULL WHEN size(lengths) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE aggregate(
        sequence(0, 2 * size(lengths) + 1), named_struct('got', transform(lengths, x -> 0), 'room', greatest(coalesce(budget, 0), 0)),
        (s, i) -> CASE WHEN s.room = 0 OR {TOTAL} = 0 THEN s WHEN {DEAL}.room = s.room THEN named_struct('got', {ONES}.got, 'room', 0) ELSE {DEAL} END, s -> s.got) END""",
}


class ChunkWindows:
    """C4 as a table function: each row's windows, with the row's other columns, chunk_no, chunk, n_tokens and position, the chunk's place in its partition."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text_column: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text_column.value not in rows.dataType.names:
            raise ValueError(f"the table has no column {text_column.value}")
        window_count_checked(size.value if size else SIZE, overlap.value if overlap else OVERLAP)
        schema = StructType([f for f in rows.dataType.fields if f.name != text_column.value])
        for name, kind in (("chunk_no", IntegerType()), ("chunk", StringType()), ("n_tokens", IntegerType()), ("position", IntegerType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.position = 0

    def eval(self, rows: Row, text_column: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        words = (rows[text_column] or "").split()
        kept = [v for n, v in zip(rows.__fields__, rows, strict=True) if n != text_column]
        for number, start in enumerate(range(0, max(len(words) - overlap, min(len(words), 1)), size - overlap)):
            part = words[start : start + size]
            yield (*kept, number, " ".join(part), len(part), self.position)
            self.position += 1


def window_count_checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window's size")  # C7


def register(spark: SparkSession) -> None:
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("chunk_windows", udtf(ChunkWindows))
