r"""Chat formatting by prefix-target expansion. DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that
reply is trainable. A conversation that does not end with an assistant turn has one more example
without a trainable part, so that no turn is missing from the output.

Template of a turn: ``### role: text</turn>`` and a line feed. Inside texts and roles the control
strings are escaped: ``\`` becomes ``\b``, ``</turn>`` becomes ``\e``, ``###`` becomes ``\h`` (and in
roles ``:`` becomes ``\c``). Every backslash of the output starts an escape, so the rules are reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Replace control strings; see the module's text."""
    for plain, code in (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`; the backslash itself comes last."""
    for code, plain in (("\\c", ":"), ("\\h", "###"), ("\\e", "</turn>"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_targets(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", reply_role: str = "assistant") -> DataFrame:
    """One row per example: the conversation id, ``target`` (1-based position of the trainable turn;
    one past the last where nothing is trainable), ``n_context``, ``formatted``, ``loss_start`` and
    ``loss_length`` (code points of ``formatted`` under the loss mask).

    Turns are ordered by turn (nulls first), then role and text; repeated rows are repeated turns.
    Null texts and roles count as empty, a null conversation id is a conversation. A conversation
    is one value: its examples contain all of its text by definition.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conv_col).alias("__conv")).agg(F.sort_array(F.collect_list(row)).alias("__turns"))
    shown = grouped.select(
        "__conv",
        F.transform(
            "__turns",
            lambda t: F.struct(
                (t["role"] == reply_role).alias("reply"),
                F.concat(F.lit(HEAD), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("__shown"),
    )
    n = F.size("__shown")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("__shown", i - 1)["reply"])
    tail = F.when(F.element_at("__shown", -1)["reply"], F.array().cast("array<int>")).otherwise(F.array(n + 1))
    written = F.transform("__shown", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    examples = shown.select("__conv", "__shown", written.alias("__written"), F.explode(F.concat(replies, tail)).alias("target"))
    at = F.get("__shown", F.col("target") - 1)
    context = F.array_join(F.slice("__written", 1, F.col("target") - 1), "")
    full = examples.select(
        "__conv",
        "target",
        context.alias("__context"),
        F.coalesce(at["head"], F.lit("")).alias("__head"),
        at["body"].alias("__body"),
    )
    trainable = F.col("__body").isNotNull()
    return full.select(
        F.col("__conv").alias(conv_col),
        "target",
        (F.col("target") - 1).alias("n_context"),
        F.concat("__context", "__head", F.when(trainable, F.concat("__body", F.lit(END))).otherwise("")).alias("formatted"),
        F.when(trainable, F.length("__context") + F.length("__head")).alias("loss_start"),
        F.coalesce(F.length("__body"), F.lit(0)).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Formatted text back to an array of (role, text)."""
    pieces = F.split(formatted, END)
    parsed = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(p, MIDDLE, 2))
    return F.transform(parsed, lambda p: F.struct(unescape(F.substr(p[0], F.lit(len(HEAD) + 1))).alias("role"), unescape(p[1]).alias("text")))


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation what its examples say: ``turns`` (from the longest example), ``loss`` (all
    text under the masks, in order) and ``formatted_chars`` (code points of all its examples)."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    part = F.struct("target", F.coalesce(loss, F.lit("")).alias("text"))
    return examples.groupBy(conv_col).agg(
        read_turns(F.max_by("formatted", "target")).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )


def fixed_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts consist of control strings."""
    i = F.col("id")
    return spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        i.alias("turn"),
        F.when(i == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )


def turn_digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
), e AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS m,
         sum(4 + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c')) + 2
             + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h')) + 8) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR n = m) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
