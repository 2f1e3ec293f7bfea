"""Chat records of any known layout as canonical turns and as formatted text, in DataFrame operations only.

A record is a JSON object, or a struct of the same fields. The paths of its fields (object keys, [] for an array) are
hashed to a fingerprint, which selects one of the declarative LAYOUTS (for a fingerprint that is none of theirs, the
first layout whose paths are all there): how to get from those paths to turns of (role, text). Adding a layout is
adding a row. A struct's paths are those of its fields that are not null; structs never become JSON, so the limits of
JSON parsers do not touch their texts. The query makes structs of three layouts out of the conversations.

Formatted text has a mark before and after each turn. Control strings inside texts and roles are escaped with a
backslash after their first character, one more where there are some already, so that no text can contain a mark and
unescaping gives back every text exactly. The loss mask is the list of spans that are an assistant's text.

Defined results: a null text is empty, a null role is "". A record of unknown layout or broken JSON has null turns.
Sound JSON beyond the limits of Spark's variants (a text over 20,000,000 characters, a record over 128 MiB) is an
error; so is a conversation beyond the 2 GiB of a Spark string. Rows of a conversation are ordered by turn, then role, then text. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"
#: The control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_REST = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>"
ESCAPE = (rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")
UNESCAPE = (rf"([<\[])\\(\\*)({_REST})", r"$1$2$3")

#: Role names of other layouts, by their canonical ones.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

_TURNS = "array<struct<role:string,text:string>>"
#: Layout name, the field paths that it needs, and turns from the record (a VARIANT column named record).
LAYOUTS: list[tuple[str, list[str], str]] = [
    (
        "messages",
        ["messages[].content", "messages[].role"],
        "transform(variant_get(record, '$.messages', 'array<struct<role:string,content:string>>'), m -> struct(m.role AS role, m.content AS text))",
    ),
    (
        "conversations",
        ["conversations[].from", "conversations[].value"],
        "transform(variant_get(record, '$.conversations', 'array<struct<from:string,value:string>>'), m -> struct(m.from AS role, m.value AS text))",
    ),
    (
        "instruction_input",
        ["input", "instruction", "output"],
        "array(struct('user' AS role, concat_ws('\\n\\n', variant_get(record, '$.instruction', 'string'), nullif(variant_get(record, '$.input', 'string'), '')) AS text),"
        " struct('assistant' AS role, variant_get(record, '$.output', 'string') AS text))",
    ),
    (
        "instruction",
        ["instruction", "output"],
        "array(struct('user' AS role, variant_get(record, '$.instruction', 'string') AS text), struct('assistant' AS role, variant_get(record, '$.output', 'string') AS text))",
    ),
    (
        "prompt_completion",
        ["completion", "prompt"],
        "array(struct('user' AS role, variant_get(record, '$.prompt', 'string') AS text), struct('assistant' AS role, variant_get(record, '$.completion', 'string') AS text))",
    ),
    (
        "prompt_response",
        ["prompt", "response"],
        "array(struct('user' AS role, variant_get(record, '$.prompt', 'string') AS text), struct('assistant' AS role, variant_get(record, '$.response', 'string') AS text))",
    ),
    (
        "question_answer",
        ["answer", "question"],
        "array(struct('user' AS role, variant_get(record, '$.question', 'string') AS text), struct('assistant' AS role, variant_get(record, '$.answer', 'string') AS text))",
    ),
]


def paths(record: Column) -> Column:
    """All field paths of a record, in order, from a walk over its schema; names beyond letters and digits in backticks."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>"), F.lit(0))

    def step(s: Column, token: Column) -> Column:
        outer = F.element_at(s["outer"], -1)
        path = F.concat(F.when(outer == "", "").otherwise(F.concat(outer, F.lit("."))), F.substring(token, F.lit(1), F.length(token) - 2))
        inside = F.concat(s["outer"], F.array(s["at"]))
        return (
            F.when(token == ">", F.struct(F.slice(s["outer"], F.lit(1), F.size(s["outer"]) - 1).alias("outer"), s["at"].alias("at"), s["found"].alias("found")))
            .when(token == "OBJECT<", F.struct(inside.alias("outer"), s["at"].alias("at"), s["found"].alias("found")))
            .when(token == "ARRAY<", F.struct(inside.alias("outer"), F.concat(s["at"], F.lit("[]")).alias("at"), s["found"].alias("found")))
            .otherwise(F.struct(s["outer"].alias("outer"), path.alias("at"), F.concat(s["found"], F.array(path)).alias("found")))
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("outer"), F.lit("").alias("at"), none.alias("found"))
    return F.array_sort(F.aggregate(tokens, start, step, lambda s: s["found"]))


def struct_paths(kind: DataType, at: str = "") -> list[str]:
    """The field paths of a struct type."""
    if isinstance(kind, ArrayType):
        return struct_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, StructType):
        return []
    quoted = lambda x: x if re.fullmatch(r"\w+", x, re.A) else "`" + x.replace("`", "``") + "`"
    names = [(f"{at}.{quoted(f.name)}" if at else quoted(f.name), f.dataType) for f in kind.fields]
    return [x for name, inner in names for x in (name, *struct_paths(inner, name))]


def whole(need: list[str]) -> list[str]:
    """The paths of a record that has just the fields that a layout needs."""
    return sorted({*need, *(p.split("[].")[0] for p in need)})


def fingerprint(found: Column) -> Column:
    return F.xxhash64(F.array_join(found, "\n"))


#: Characters that a record has at least if it is beyond a limit of variants.
LEAST_LOST = 20_000_000


def parsed_json(json: Column) -> Column:
    """JSON text as a variant, null if broken; an error if it is sound, but too large for one."""
    sound = F.from_json(json, "map<string,string>", {"maxStringLen": str(2**31 - 1)}).isNotNull()
    lost = F.raise_error(F.lit("a JSON record is too large for a variant: give it as a struct")).cast("variant")
    return F.coalesce(F.try_parse_json(json), F.when((F.length(json) > LEAST_LOST) & sound, lost))


def canonical(records: DataFrame, json: str = "record") -> DataFrame:
    """records with fingerprint, layout and turns: array of (role, text). json: JSON text, or a struct."""
    if isinstance(kind := records.schema[json].dataType, StructType):
        return _of_structs(records.withColumn("record", F.col(json)), kind)
    rows = records.withColumn("record", parsed_json(F.col(json))).withColumn("paths", paths(F.col("record")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("paths")))
    layout, turns, known = F.lit(None).cast("string"), F.lit(None).cast(_TURNS), []
    for name, need, how in reversed(LAYOUTS):
        # only records with other fields beside the needed ones (an id, say) have a fingerprint that no layout has: the
        # first layout of the list whose paths are all there reads them
        within = F.size(F.array_except(F.array(*map(F.lit, need)), F.col("paths"))) == 0
        layout = F.when(within, F.lit(name)).otherwise(layout)
        known.append((F.col("fingerprint") == fingerprint(F.array(*map(F.lit, whole(need)))), name))
    for exact, name in known:
        layout = F.when(exact, F.lit(name)).otherwise(layout)
    rows = rows.withColumn("layout", layout)
    for name, _, how in LAYOUTS:
        turns = F.when(F.col("layout") == name, F.expr(how).cast(_TURNS)).otherwise(turns)
    return rows.withColumn("turns", _clean(turns)).drop("record", "paths")


def _of_structs(rows: DataFrame, kind: StructType) -> DataFrame:
    """As canonical(). A record has the paths of those of its fields that are not null: records of many layouts share a
    struct. Their fingerprints are looked up in the table of known ones; as with JSON, a record with other fields
    beside the needed ones takes the first layout whose paths are all there."""
    own = lambda f: [p for p in struct_paths(StructType([f]))]
    there = [F.when(F.col("record")[f.name].isNotNull(), F.array(*map(F.lit, own(f)))).otherwise(F.array().cast("array<string>")) for f in kind.fields]
    found = F.array_sort(F.concat(*there)) if there else F.array().cast("array<string>")
    rows = rows.withColumn("paths", F.when(F.col("record").isNotNull(), found))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("paths")))
    every = set(struct_paths(kind))
    usable = [(name, need, how) for name, need, how in LAYOUTS if set(need) <= every]
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for name, need, _ in reversed(usable):
        layout = F.when(F.size(F.array_except(F.array(*map(F.lit, need)), F.col("paths"))) == 0, F.lit(name)).otherwise(layout)
    for name, need, _ in usable:
        layout = F.when(F.col("fingerprint") == fingerprint(F.array(*map(F.lit, whole(need)))), F.lit(name)).otherwise(layout)
    rows = rows.withColumn("layout", layout)
    for name, _, how in usable:
        own_turns = F.expr(re.sub(r"variant_get\(record, '\$\.(\w+)', '[^']*'\)", r"record.\1", how)).cast(_TURNS)
        turns = F.when(F.col("layout") == name, own_turns).otherwise(turns)
    return rows.withColumn("turns", _clean(turns)).drop("record", "paths")


def _clean(turns: Column) -> Column:
    """Turns with canonical role names and without nulls."""
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.transform(
        turns,
        lambda t: F.struct(
            F.coalesce(F.element_at(known, F.lower(t["role"])), t["role"], F.lit("")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        ),
    )


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _role(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    plain = F.regexp_replace(unescaped(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def formatted(rows: DataFrame) -> DataFrame:
    """rows with formatted and loss_spans, an array of (start, length) in code points from 1, from their turns."""
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    rows = rows.withColumn("parts", parts)
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(END) + 1)).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    s["spans"],
                    F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return rows.withColumn("formatted", text).withColumn("loss_spans", spans).drop("parts")


def parsed(text: Column) -> Column:
    """The turns of formatted text."""
    marked = F.split(text, r"\Q" + END + r"\E\n")
    marked = F.slice(marked, F.lit(1), F.size(marked) - 1)
    head = rf"(?s)^\Q{START}\E([^\n]*)\n(.*)$"
    return F.transform(
        marked,
        lambda t: F.struct(
            _role_back(F.regexp_extract(t, head, 1)).alias("role"), unescaped(F.regexp_extract(t, head, 2)).alias("text")
        ),
    )


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation, by turn, as a record of a layout that can hold it whole.

    One question and one answer are a prompt and its response; other dialogues of users and assistants are
    conversations of from and value; whatever else there is, messages of role and content.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    dialogue = ~pair & F.forall(roles, lambda r: r.isin("user", "assistant"))
    said = {
        "messages": F.when(~pair & ~dialogue, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))),
        "conversations": F.when(dialogue, F.transform("t", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["content"].alias("value")))),
        "prompt": F.when(pair, F.get("t", F.lit(0))["content"]),
        "response": F.when(pair, F.get("t", F.lit(1))["content"]),
    }
    return rows.select("conv_id", F.struct(*(v.alias(k) for k, v in said.items())).alias("record"))


def report(conversations: DataFrame) -> DataFrame:
    """Each conversation formatted, and what its formatted text and loss mask give back."""
    rows = formatted(canonical(records_of(conversations))).select("conv_id", "formatted", "loss_spans")
    turns = parsed(F.col("formatted"))
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"], s["length"]))), ""
    )
    rows = rows.withColumn("turns", turns).withColumn("loss", loss)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
