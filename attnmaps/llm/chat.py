"""Chat formatting with Spark expressions only.

Template: ``<|start|>role<|body|>`` opens a block of adjacent turns of one role, ``<|turn|>``
divides its turns, ``<|end|>`` closes it. Inside roles and texts a control string gets a backslash after
its first character, and one with backslashes there gets another, so that every
text comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.common import bound, running, slices, total

START, BODY, TURN, END = "<|start|>", "<|body|>", "<|turn|>", "<|end|>"
#: Turns of a conversation that are put together at first, by turn number.
STRIDE = 256
#: Starts of control strings, of this template and of common others.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text):
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text):
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def _merged(blocks):
    """Neighbouring blocks (role, texts) of one role become one block."""
    at = F.sequence(F.lit(1), F.size(blocks))
    first = F.filter(at, lambda i: (i == 1) | ~F.get(blocks, i - 1)["role"].eqNullSafe(F.get(blocks, i - 2)["role"]))
    ends = F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(blocks) + 1))
    return F.zip_with(
        first,
        ends,
        lambda s, e: F.struct(F.get(blocks, s - 1)["role"].alias("role"), F.flatten(F.slice(blocks, s, e - s)["texts"]).alias("texts")),
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted): one row for each conversation.

    Turns are sorted by number, nulls first, and those that share a number by role and
    text; none is dropped. Null roles and texts are empty. Turns with a null conversation
    id form one conversation. Runs of ``STRIDE`` turn numbers are merged before the
    conversation is put together, so a conversation of very many turns meets as few
    rows; a single conversation's text must still fit in one value.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), escape(F.coalesce(role_col, F.lit(""))).alias("role"), escape(F.coalesce(text_col, F.lit(""))).alias("text"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.expr(f"cast(`{turn_col}` as long) div {STRIDE}").alias("run"), turn.alias("t"))
    runs = rows.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    single = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    parts = runs.select("conv_id", "run", single.alias("blocks")).select("conv_id", F.struct("run", _merged(F.col("blocks")).alias("blocks")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.flatten(F.array_sort(F.collect_list("part"))["blocks"]).alias("blocks"))
    merged = whole.select("conv_id", _merged(F.col("blocks")).alias("blocks"))
    text = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(BODY), F.array_join(b["texts"], TURN), F.lit(END)))
    return merged.select("conv_id", F.array_join(text, "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): turns as array of (role, text), from the formatted text alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")

    def turns_of(block):
        parts = F.split(F.substring(block, len(START) + 1, 2**31 - 1), r"<\|body\|>")
        role, body = unescape(F.get(parts, 0)), F.get(parts, 1)
        return F.transform(F.split(body, r"<\|turn\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def loss_mask(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds ``loss_spans``: where in ``formatted`` the texts of a role lie, as (start, end) in code points.

    The spans are found in the formatted text alone. They hold each text once, in order, as it
    is written there; marks and other roles are outside.
    """

    def of_block(block, begin):
        parts = F.split(block, r"<\|body\|>")
        head = begin + F.length(F.get(parts, 0)) + len(BODY)

        def spans(texts):
            sizes = F.transform(texts, lambda x: F.length(x) + len(TURN))
            place = lambda before: F.transform(texts, lambda x, k: F.struct((head + F.get(before, k)).alias("start"), (head + F.get(before, k) + F.length(x)).alias("end")))
            return bound(running(sizes, total), place)

        own = unescape(F.substring(F.get(parts, 0), len(START) + 1, 2**31 - 1)) == role
        return F.when(own, bound(F.split(F.get(parts, 1), r"<\|turn\|>"), spans)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    def all_blocks(blocks):
        sizes = F.transform(blocks, lambda b: F.length(b) + len(END))
        return bound(running(sizes, total), lambda begins: F.flatten(F.transform(blocks, lambda b, i: of_block(b, F.get(begins, i)))))

    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    return formatted.withColumn("loss_spans", bound(blocks, all_blocks))


def loss_texts(masked: DataFrame) -> DataFrame:
    """Adds ``loss_texts``: what the spans of ``loss_spans`` hold, without escapes."""
    return masked.withColumn("loss_texts", F.transform(slices(F.col("formatted"), F.col("loss_spans")), unescape))
