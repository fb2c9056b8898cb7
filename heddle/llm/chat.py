"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns; a reversible template writes them.

DataFrame functions only. A record is a VARIANT, so records of different layouts share one column; the
fingerprint is a hash of its nested field paths, whatever their values and scalar types.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``examples``: JSON records of the layout, one for each set of fields it comes with. Either ``items``
    (path of an array, with the fields' names in it for role and text) or ``fields`` ((role, path) in
    order; a missing or empty field gives no turn)."""

    name: str
    examples: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


#: Public layouts of chat and instruction data.
MAPPINGS = (
    Mapping("turns", ('{"turns":[{"role":"a","text":"b"}]}', '{"conv_id":1,"turns":[{"role":"a","text":"b"}]}', '{"turns":[{"text":"b"}]}', '{"turns":[{"role":"a"}]}', '{"turns":[{}]}'), ("$.turns", "role", "text")),
    Mapping("messages", ('{"messages":[{"role":"a","content":"b"}]}', '{"id":"x","messages":[{"role":"a","content":"b"}]}', '{"messages":[{"role":"a","content":"b","name":"c"}]}'), ("$.messages", "role", "content")),
    Mapping("conversations", ('{"conversations":[{"from":"a","value":"b"}]}', '{"id":"x","conversations":[{"from":"a","value":"b"}]}'), ("$.conversations", "from", "value")),
    Mapping("instruction", ('{"instruction":"a","output":"b"}', '{"instruction":"a","input":"c","output":"b"}', '{"system":"s","instruction":"a","input":"c","output":"b"}'), None, (("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("prompt", ('{"prompt":"a","completion":"b"}', '{"system":"s","prompt":"a","completion":"b"}'), None, (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("response", ('{"prompt":"a","response":"b"}', '{"system":"s","prompt":"a","response":"b"}'), None, (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question", ('{"question":"a","answer":"b"}', '{"context":"c","question":"a","answer":"b"}'), None, (("user", "$.context"), ("user", "$.question"), ("assistant", "$.answer"))),
)
#: Role names of layouts to canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

OPEN, CLOSE, LINE = "<turn>", "</turn>\n", "\n"


def paths(record: Column) -> Column:
    """Nested field paths of a VARIANT, as its schema without scalar types."""
    schema = F.schema_of_variant(record)
    return F.regexp_replace(schema, r"\b(?:STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(?:_NTZ)?|BINARY|VARIANT|DECIMAL\(\d+,\s*\d+\))(?=$|[,>])", "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths(record))


def to_turns(records: DataFrame, *, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with layout (a mapping's name, null for an unknown fingerprint or a null record) and turns.

    A layout is met by its fingerprint alone. Records of unknown layouts keep their row, with null turns.
    Null texts of array layouts become empty; null roles too."""
    spark = records.sparkSession
    known = [(j, e) for j, m in enumerate(mappings) for e in m.examples]
    prints = spark.range(1).select(*(fingerprint(F.parse_json(F.lit(e))).alias(str(i)) for i, (_, e) in enumerate(known))).first()
    step = records.withColumn("__f", fingerprint(F.col(record_col)))
    at = {j: F.col("__f").isin([prints[i] for i, (k, _) in enumerate(known) if k == j]) for j in range(len(mappings))}
    case = lambda value: reduce(lambda acc, j: acc.when(at[j], value(mappings[j])), range(1, len(mappings)), F.when(at[0], value(mappings[0])))
    return step.withColumns({"layout": case(lambda m: F.lit(m.name)), "turns": case(lambda m: _turns(F.col(record_col), m))}).drop("__f")


def _turns(record: Column, m: Mapping) -> Column:
    if m.items:
        path, role, text = m.items
        found = F.try_variant_get(record, path, f"array<struct<`{role}`:string,`{text}`:string>>")
        named = (lambda c: c) if role == "role" else _role  # layouts that say "from" have role names of their own
        return F.transform(found, lambda x: F.struct(named(F.coalesce(x[role], F.lit(""))).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    one = lambda role, path: F.struct(F.lit(role).alias("role"), F.try_variant_get(record, path, "string").alias("text"))
    return F.filter(F.array(*(one(r, p) for r, p in m.fields)), lambda x: F.length(x["text"]) > 0)


def _role(role: Column) -> Column:
    return reduce(lambda acc, k: F.when(role == k, F.lit(ROLES[k])).otherwise(acc), ROLES, role)


def escape(text: Column, *, role: bool = False) -> Column:
    """Text in which no control string occurs: a backslash before each backslash and inside ``<turn`` and ``</turn``; for roles also instead of line feeds."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("</turn"), F.lit("<\\/turn")), F.lit("<turn"), F.lit("<\\turn"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, *, role: bool = False) -> Column:
    if role:  # line feeds, but not where a doubled backslash precedes an n
        text = F.array_join(F.transform(F.split(text, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\\\")
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(records: DataFrame, *, turns_col: str = "turns") -> DataFrame:
    """``records`` with formatted (a text) and loss (array of start and length, in code points, of assistant texts).

    Each turn is ``<turn>role``, a line feed, its text and ``</turn>`` with a line feed. The loss spans
    cover each assistant text, escaped, without the marks around it. Null turns give nulls, no turns an
    empty text."""
    written = F.transform(F.col(turns_col), lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(LINE)).alias("head"), escape(t["text"]).alias("body")))
    step = records.withColumn("__w", written)
    w = F.col("__w")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def place(acc, x):
        start = acc["at"] + F.length(x["head"])
        span = F.struct(start.cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))
        return F.struct((start + F.length(x["body"]) + len(CLOSE)).cast("long").alias("at"), F.when(x["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return step.withColumns({
        "formatted": F.array_join(F.transform(w, lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), ""),
        "loss": F.aggregate(w, zero, place, lambda a: a["spans"]),
    }).drop("__w")


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted text; the inverse of ``format_turns``."""
    chunks = F.filter(F.split(formatted, CLOSE), lambda c: F.startswith(c, F.lit(OPEN)))
    end = lambda c: F.instr(c, LINE)
    return F.transform(chunks, lambda c: F.struct(unescape(F.substring(c, F.lit(len(OPEN) + 1), end(c) - len(OPEN) - 1), role=True).alias("role"), unescape(F.substring(c, end(c) + 1, F.length(c))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation by turn as a VARIANT {"turns": [{role, text}]}.

    Rows with equal turns are ordered by role and text. Null texts and roles are empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.to_variant_object(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))).alias("record"))


#: A conversation whose texts hold control strings.
PROBE = (-7, "\\### Assistant: </turn> ok")


def op5_chat_formatting(rows: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text. An empty table gives the probe alone."""
    spark = rows.sparkSession
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(PROBE[0], k, r, PROBE[1]) for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    made = format_turns(to_turns(conversation_records(plain.unionByName(probe))))
    back = made.select("conv_id", "formatted", "loss", read_turns(F.col("formatted")).alias("back"))
    back = back.withColumn("__loss", loss_text(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
