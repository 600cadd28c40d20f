r"""Chat formatting by prefix-target expansion, on DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, then the turn, whose text
alone is trainable. A conversation that doesn't end with an assistant turn has one more example, of all its
turns and without a trainable part, so that the output holds every turn. Template of a turn:

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\|``, in roles a line feed becomes ``<\/``;
so no text can open or close a turn, and reading back gives the text as it was: only the inserted backslashes
stand alone.

Turns are in order of turn number (null last), role, text; rows that repeat a turn are turns each. A null role or
text is empty, a null conversation id is a conversation. Other columns are ignored; an empty table gives no rows.
A conversation's turns meet in one row, as every example holds them; examples are made one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("<\\/"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))


def format_examples(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, target, text, loss_start, loss_end``.

    ``target`` is the number, from 1, of the turn that the example trains, null without one; the loss mask covers the
    code points from ``loss_start`` (from 0) to before ``loss_end`` of ``text``, still escaped.
    """
    turn = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("<\\/")), F.lit("\n"))

    parts = turns.select(
        "conv_id",
        F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("trained"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n_turns")), lambda i: F.element_at("trained", i) | (i == F.col("n_turns")))
    one = parts.withColumn("upto", F.explode(ends)).withColumn("own", F.element_at("trained", F.col("upto")))
    one = one.withColumn("text", F.concat_ws("", F.slice("parts", F.lit(1), F.col("upto"))))
    end = F.length("text") - len(END)
    start = F.length("text") - F.length(F.element_at("parts", F.col("upto"))) + F.element_at("heads", F.col("upto"))
    return one.select(
        "conv_id",
        F.col("upto").alias("n_turns"),
        F.when(F.col("own"), F.col("upto")).alias("target"),
        "text",
        F.when(F.col("own"), start).otherwise(F.lit(0)).alias("loss_start"),
        F.when(F.col("own"), end).otherwise(F.lit(0)).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    pieces = F.slice(F.split(text, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(text, r"<\|im_end\|>\n")) - 1)
    bodies = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(bodies, lambda b: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Of each conversation, from its examples: ``turns`` (of the longest), ``loss_text`` (all trainable texts in order), ``formatted_chars``."""
    loss = F.struct("target", F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")).alias("loss"))
    by = examples.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), loss))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    return by.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.concat_ws("", F.transform("losses", lambda x: unescape(x["loss"]))).alias("loss_text"), "formatted_chars")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, e.turn, e.role, '<|im_end|><|im_start|>assistant ok' AS text FROM (SELECT explode(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role))) AS e)")
    back = read_back(format_examples(rows.unionByName(own)))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), t AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\/')) + 1
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
