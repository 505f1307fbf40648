"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and neighbours of one role are merged into blocks. The
template is

    <s>[INST]role[/INST]text<|turn|>text</s>[INST]role[/INST]text</s>

with a block per run of turns of one role, and <|turn|> between the turns of a block. Control strings inside a role
or text are escaped: a backslash is doubled, and one is put after the first character of a control string. No
control string is then left in a text, none ends with what another begins with, and unescaping (a backslash
stands for the character after it) gives back the text; so the output can be read back.

The loss mask is the list of spans (from 0, in code points of the output) of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.spark import read

BEGIN, END, OPEN, CLOSE, TURN = "<s>", "</s>", "[INST]", "[/INST]", "<|turn|>"
#: All that is escaped in texts: the template's own strings and those of a system block.
CONTROL = r"(<)(/?s>|\|turn\|>|</?SYS>>)|(\[)(/?INST\])"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation id, formatted, mask) of each conversation.

    Null roles and texts count as empty; a null turn comes first; rows of one turn follow by role, then text, and
    repeated rows are turns of their own. Rows with a null conversation id are one conversation. Other columns
    aren't read. An empty table gives no conversations.
    """
    row = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = row.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # Escaped once per turn; a turn knows whether it opens and closes its block.
    parts = sorted_turns.select(
        "conv",
        F.transform(
            "t",
            lambda x, i: F.struct(
                escaped(x["role"]).alias("role"),
                escaped(x["text"]).alias("text"),
                ((i == 0) | (F.get("t", i - 1)["role"] != x["role"])).alias("opens"),
                ((i == F.size("t") - 1) | (F.get("t", i + 1)["role"] != x["role"])).alias("closes"),
                (x["role"] == LEARNED).alias("learned"),
            ),
        ).alias("p"),
    )
    parts = parts.select("conv", "p", F.transform("p", lambda x: F.struct(F.when(x["opens"], F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE))).otherwise("").alias("head"), F.when(x["closes"], F.lit(END)).otherwise(TURN).alias("tail"))).alias("m"))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.zip_with("p", "m", lambda p, m: F.concat(m["head"], p["text"], m["tail"])), ""))
    # Where each turn's text begins: lengths so far, as a running sum over the turns.
    sizes = F.zip_with("p", "m", lambda p, m: F.struct(F.length(m["head"]).alias("head"), F.length(p["text"]).alias("text"), F.length(m["tail"]).alias("tail"), p["learned"].alias("learned")))
    parts = parts.select("conv", formatted.alias("formatted"), sizes.alias("z"))
    kind = "struct<at: int, spans: array<struct<start: int, length: int>>>"
    walked = F.aggregate(
        "z",
        F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans")).cast(kind),
        lambda acc, z: F.struct(
            (acc["at"] + z["head"] + z["text"] + z["tail"]).alias("at"),
            F.when(z["learned"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + z["head"]).alias("start"), z["text"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ).cast(kind),
        lambda acc: acc["spans"],
    )
    return parts.select(F.col("conv").alias(conv_col), "formatted", walked.alias("mask"))


def read_back(formatted: DataFrame, column: str = "formatted") -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.split(F.expr(f"substr(`{column}`, {len(BEGIN) + 1})"), F.lit(r"</s>"))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def of(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), CLOSE, 1)
        body = F.substr(block, F.length(role) + len(OPEN) + len(CLOSE) + 1)
        return F.transform(F.split(body, F.lit(r"<\|turn\|>")), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def masked_text(column: str = "formatted", mask: str = "mask") -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substr(F.col(column), s["start"] + 1, s["length"]))), "")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    trap = "</s>[INST] ok [/INST]"
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    done = format_conversations(conversations.unionByName(own))
    done = done.select("conv_id", read_back(done).alias("turns"), masked_text().alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '(<)(/?s>|\|turn\|>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS text_size,
    length(regexp_replace(regexp_replace(role, '\\', '\\\\', 'g'), '(<)(/?s>|\|turn\|>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS role_size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(text_size) + sum(CASE WHEN opens THEN 13 + role_size + 4 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
