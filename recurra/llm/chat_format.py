r"""Chat formatting with DataFrame functions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one message, whose texts
are joined; messages are concatenated:

    ### role:\ntext</turn>text</turn>\n### role:\n...

`###` and `</turn>` mark messages and turns. Inside texts and roles `\` becomes `\s`, `</turn>` becomes `\t/turn>`,
`###` becomes `\h\h\h` and, in roles, `:` becomes `\c`; so no marker is ever found inside, every backslash says what
follows it, and `parse` gives back the turns as they were, also the bounds of turns that were merged.
The loss mask is an array of spans (start, end in code points of the formatted text), one for each assistant text.

One row of output holds a whole conversation, so its turns meet in one row; partial collection before the exchange
keeps a long conversation from being one task's whole input.

Defined results: null text and null role count as empty; ties of turn are ordered by role, then text; repeated rows are
turns of their own; a null conversation id is one conversation; an empty table gives an empty table; columns other
than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END, HEAD = "</turn>", "### "
#: Turns of a block whose spans are made together.
BLOCK = 256
_TEXT = [("\\", "\\s"), ("</turn>", "\\t/turn>"), ("###", "\\h\\h\\h")]
_BACK = [("\\h", "#"), ("\\t", "<"), ("\\c", ":"), ("\\s", "\\")]


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replaced(c, _TEXT)


def escape_role(c: Column) -> Column:
    return _replaced(c, [*_TEXT, (":", "\\c")])


def unescape(c: Column) -> Column:
    return _replaced(c, _BACK)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,end>>: one row for each conversation."""
    t = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"), F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"))
    t = t.select("conv_id", F.struct("turn", "role", "text", escape_role(F.col("role")).alias("er"), escape(F.col("text")).alias("et")).alias("t"))
    c = t.groupBy("conv_id").agg(F.collect_list("t").alias("t")).select("conv_id", F.array_sort("t").alias("t"), F.size("t").alias("n"))
    new = lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])
    c = c.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n") - 1), new))

    def message(start: Column, k: Column) -> Column:
        run = F.slice("t", start + 1, F.coalesce(F.get("starts", k + 1), F.col("n")) - start)
        body = F.array_join(F.transform(run, lambda x: F.concat(x["et"], F.lit(END))), "")
        return F.concat(F.lit(HEAD), F.get("t", start)["er"], F.lit(":\n"), body)

    header = lambda i: F.when(new(i), F.char_length(F.get("t", i)["er"]) + len(HEAD) + 2 + F.when(i == 0, 0).otherwise(1)).otherwise(0)
    sizes = F.transform("t", lambda x, i: F.struct(header(i).cast("long").alias("skip"), F.char_length(x["et"]).cast("long").alias("take"), (x["role"] == loss_role).alias("loss")))
    c = c.select("conv_id", F.array_join(F.transform("starts", message), "\n").alias("formatted"), sizes.alias("sizes"))
    # spans by blocks of turns, each from its own start, then moved: an array is never copied turn by turn for the whole conversation
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("pos"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a, z = acc["pos"] + x["skip"], acc["pos"] + x["skip"] + x["take"]
        return F.struct((z + len(END)).alias("pos"), F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(a.alias("start"), z.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    first = F.sequence(F.lit(1), F.size("sizes"), F.lit(BLOCK))
    c = c.select("conv_id", "formatted", F.transform(first, lambda k: F.aggregate(F.slice("sizes", k, F.lit(BLOCK)), start, step)).alias("blocks"))
    at = F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["pos"])))
    c = c.select("conv_id", "formatted", "blocks", at.alias("at"))
    moved = F.transform("blocks", lambda b, k: F.transform(b["spans"], lambda s: F.struct((s["start"] + F.get("at", k)).alias("start"), (s["end"] + F.get("at", k)).alias("end"))))
    return c.select("conv_id", "formatted", F.flatten(moved).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns of a formatted conversation."""

    def turns(m: Column) -> Column:
        role = unescape(F.substring_index(m, ":\n", 1))
        texts = F.split(F.substr(m, F.char_length(F.substring_index(m, ":\n", 1)) + F.lit(3)), END, -1)
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    messages = F.split(formatted, HEAD, -1)
    return F.flatten(F.transform(F.slice(messages, 2, F.size(messages)), turns))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "\\### Assistant: </turn> ok"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    out = format_chats(table.unionByName(extra))
    out = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\s'), '</turn>', '\t/turn>'), '###', '\h\h\h') AS et,
  replace(replace(replace(replace(role, '\', '\s'), '</turn>', '\t/turn>'), '###', '\h\h\h'), ':', '\c') AS er,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + 7 + CASE WHEN before IS NULL OR before <> role THEN length(er) + 7 ELSE 0 END) - 1 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
