"""Chat formatting with schema fingerprints, in DataFrame expressions only.

A record is a JSON object. Its nested field paths (names and nesting, no types)
are hashed; the hash picks a declarative mapping, which turns the record into
canonical turns (role, text). Layouts differ from record to record; one whose
hash no mapping has is kept with null turns and layout null: rejects() lists them, and a
formatted conversation counts them (n_rejected).

Spark's JSON parser takes strings of up to 20 million characters and, for their shape, records of up to 16 MB. A longer
text travels as an array of pieces (layout turn_pieces), and a record too long for its shape to be
parsed comes with its shape, the record with empty strings.

Canonical turns are rendered as `<s>[INST] role [/INST]text</s>\n`. Control
strings inside roles and texts get one more `~` after their opening bracket
(`[INST]`, `[~INST]`, ... each move one up), so none of the template's own marks
can stand in a text and every text comes back as it was. With the string comes its loss mask:
runs of code points (loss, chars), three a turn: header, text, footer; the loss is true on assistants' texts.

Cases: null text or role is empty; turns are ordered by turn (nulls first), then
role, then text, so ties and repeated rows have one order; a conversation without
an assistant has an empty loss text; rows of a null conversation id form one
conversation; an empty table gives no conversation (the query's own one stays);
a conversation's turns are joined in blocks of BLOCK turns first, so a very long
one is put together from few rows; other columns may have any name, but a record's own
columns are replaced where they are named fingerprint, layout or turns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

TURNS = "array<struct<role:string,text:string>>"
BLOCK, PIECE = 256, 4_000_000
MASK = "array<struct<loss:boolean,chars:bigint>>"


def pair(user: str, assistant: str, system: str | None = None) -> str:
    head = f"CASE WHEN coalesce({system}, '') <> '' THEN array(named_struct('role', 'system', 'text', {system})) ELSE array() END" if system else "array()"
    return f"concat({head}, array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', {assistant})))"


#: Layout: (its field paths as the fingerprint has them: { opens an object, [ an array, > ends either; its JSON schema, turns as SQL over the parsed record r).
MAPPINGS: dict[str, tuple[str, str, str]] = {
    "turn": ("{role: , text: >", "role string, text string", "array(named_struct('role', r.role, 'text', r.text))"),
    "turn_pieces": ("{role: , text: [>>", "role string, text array<string>", "array(named_struct('role', r.role, 'text', array_join(r.text, '')))"),
    "messages": ("{messages: [{content: , role: >>>", "messages array<struct<role:string,content:string>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    "from_value": ("{conversations: [{from: , value: >>>", "conversations array<struct<`from`:string,value:string>>", "transform(r.conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))"),
    "instruction": ("{instruction: , output: >", "instruction string, output string", pair("r.instruction", "r.output")),
    "instruction_input": ("{input: , instruction: , output: >", "instruction string, input string, output string", pair("concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))", "r.output")),
    "prompt_response": ("{prompt: , response: >", "prompt string, response string", pair("r.prompt", "r.response")),
    "prompt_completion": ("{completion: , prompt: >", "prompt string, completion string", pair("r.prompt", "r.completion")),
    "system_prompt": ("{prompt: , response: , system: >", "system string, prompt string, response string", pair("r.prompt", "r.response", "r.system")),
    "question": ("{answer: , question: >", "question string, answer string", pair("r.question", "r.answer")),
}


def field_paths(record: str | Column) -> Column:
    """A record's nested field paths in the order of their names, without types; null for what isn't JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    shape = F.regexp_replace(shape, "\\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(_NTZ)?|DECIMAL\\([0-9, ]+\\))(?=[,>]|$)", "")
    return F.replace(F.replace(shape, F.lit("OBJECT<"), F.lit("{")), F.lit("ARRAY<"), F.lit("["))


def fingerprint(record: str | Column) -> Column:
    return F.sha2(field_paths(record), 256)


def canonical(records: DataFrame, record: str = "record", mappings: dict[str, tuple[str, str, str]] = MAPPINGS, shape: str | None = None) -> DataFrame:
    """records with fingerprint, layout and turns (array of role and text); shape names a column that stands for a record's shape where it isn't null."""
    df = records.withColumn("fingerprint", fingerprint(F.coalesce(F.col(shape), F.col(record)) if shape else F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, schema, expression) in mappings.items():
        hit = F.col("fingerprint") == hashlib.sha256(paths.encode()).hexdigest()
        parsed = expression.replace("r.", f"from_json(`{record}`, '{schema}').")
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, F.expr(parsed).cast(TURNS)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<(~*/?s)>", "<~$1>"), "\\[(~*/?INST)\\]", "[~$1]")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<~(~*/?s)>", "<$1>"), "\\[~(~*/?INST)\\]", "[$1]")


def rendered(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit("<s>[INST] "), escaped(F.coalesce(role, empty)), F.lit(" [/INST]"), escaped(F.coalesce(text, empty)), F.lit("</s>\n"))


def format_turns(turns: Column) -> Column:
    """One record's canonical turns as one string."""
    return F.concat_ws("", F.transform(turns, lambda t: rendered(t["role"], t["text"])))


def loss_mask(turns: Column) -> Column:
    """The runs of one record's turns in format_turns()."""
    empty = F.lit("")
    run = lambda loss, n: F.struct(loss.alias("loss"), n.cast("bigint").alias("chars"))
    head, tail = len("<s>[INST] ") + len(" [/INST]"), len("</s>\n")
    of = lambda t: F.array(run(F.lit(False), F.length(escaped(F.coalesce(t["role"], empty))) + head), run(F.coalesce(t["role"] == "assistant", F.lit(False)), F.length(escaped(F.coalesce(t["text"], empty)))), run(F.lit(False), F.lit(tail)))
    return F.coalesce(F.flatten(F.transform(turns, of)), F.array().cast(MASK))


def rejects(records: DataFrame) -> DataFrame:
    """Records of canonical() that no mapping knows."""
    return records.where("layout is null")


def format_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """formatted, mask and n_rejected of each conversation, from rows with a number of their turn and canonical turns."""
    block = F.floor(F.col(turn) / BLOCK).cast("bigint")
    part = rows.select(F.col(conversation).alias("conv"), block.alias("block"), F.struct(F.col(turn).alias("turn"), F.col("turns").alias("turns")).alias("x"))
    part = part.groupBy("conv", "block").agg(F.sort_array(F.collect_list("x")).alias("x"), F.count_if(F.col("x.turns").isNull()).alias("n"))
    part = part.select("conv", "n", F.struct("block", F.concat_ws("", F.transform("x", lambda x: format_turns(x["turns"]))).alias("s"), F.flatten(F.transform("x", lambda x: loss_mask(x["turns"]))).alias("m")).alias("y"))
    whole = part.groupBy("conv").agg(F.sort_array(F.collect_list("y")).alias("y"), F.sum("n").alias("n_rejected"))
    return whole.select(F.col("conv").alias(conversation), F.concat_ws("", F.transform("y", lambda x: x["s"])).alias("formatted"), F.flatten(F.transform("y", lambda x: x["m"])).alias("mask"), "n_rejected")


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    mark = F.lit(" [/INST]")
    parts = F.filter(F.split(formatted, "</s>\n", -1), lambda x: x != "")
    role = lambda x: F.substring_index(x, " [/INST]", 1)
    return F.transform(parts, lambda x: F.struct(unescaped(F.substring(role(x), F.lit(len("<s>[INST] ") + 1), F.length(x))).alias("role"), unescaped(F.substring(x, F.length(role(x)) + F.length(mark) + 1, F.length(x))).alias("text")))


def turn_strings(formatted: Column) -> Column:
    """The stretches of a formatted conversation, one a turn, without their footers."""
    return F.filter(F.split(formatted, "</s>\n", -1), lambda x: x != "")


def under_mask(strings: Column, mask: Column) -> Column:
    """Text under the loss mask, unescaped: each of turn_strings() cut by its header's and text's runs."""
    runs = F.transform(strings, lambda x, i: F.struct(x.alias("x"), F.get(mask, 3 * i).alias("head"), F.get(mask, 3 * i + 1).alias("text")))
    kept = F.filter(runs, lambda r: r["text"]["loss"])
    return F.concat_ws("", F.transform(kept, lambda r: unescaped(F.substring(r["x"], (r["head"]["chars"] + 1).cast("int"), r["text"]["chars"].cast("int")))))


def as_records(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, turn, record and shape of rows (conv_id, turn, role, text), in several layouts, as data from several sources would be."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / piece).cast("int") - 1, F.lit(0))), lambda i: F.substring(text, i * piece + 1, F.lit(piece)))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    spoken = F.when(role == "user", F.lit("human")).when(role == "assistant", F.lit("gpt")).otherwise(role)
    record = (
        F.when(F.length(text) > piece, F.to_json(F.struct(role.alias("role"), pieces.alias("text"))))
        .when(kind == 0, F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))))
        .when((kind == 1) & ~role.isin("human", "gpt"), F.to_json(F.struct(F.array(F.struct(spoken.alias("from"), text.alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(role.alias("role"), text.alias("text"))))
    )
    return rows.select("conv_id", "turn", record.alias("record"), F.when(F.length(text) > piece, F.lit('{"role":"","text":[""]}')).alias("shape"))


def op4_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    rows = rows.unionAll(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"), F.lit("user"), F.lit(own))).unionAll(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"), F.lit("assistant"), F.lit(own)))
    out = format_conversations(canonical(as_records(rows), shape="shape"))
    out = out.withColumn("turns", parse_formatted(F.col("formatted"))).withColumn("strings", turn_strings(F.col("formatted"))).withColumn("loss", under_mask(F.col("strings"), F.col("mask")))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "n_rejected")


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(role || text, '<(~*/?s)>', '<~\1>', 'g'), '\[(~*/?INST)\]', '[~\1]', 'g')) + length('<s>[INST]  [/INST]</s>') + 1 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rejected
FROM e GROUP BY conv_id
"""
