"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is trainable.  Written out in full, the contexts of
a conversation of T turns would hold T*T/2 turns, so the output is two tables:

* ``turns``: ``conv_id, turn_no, text, starts, body_from, body_to, trainable``;
  ``text`` is the turn between its marks, ``starts`` its place (in code points)
  in the formatted conversation, ``body_from:body_to`` the escaped body within;
* ``examples``: ``conv_id, example_no, turn_no, context_chars, loss_from,
  loss_to``; the example is the formatted conversation up to ``loss_to`` plus
  the end mark, its loss mask is ``loss_from:loss_to``.

:func:`expand` joins the two into full example texts where that is wanted.
Turns go in order of ``turn``, ties by role, then text.  Null role or text is
empty, a null ``turn`` comes first, a null ``conv_id`` is a conversation like
any other, repeated rows are repeated turns, extra columns are ignored, and an
empty table gives empty outputs.  Turns are dealt out in ranges of their order, so
a hot conversation is formatted by many tasks; its digest in :func:`describe`,
a hash of the whole, is streamed by one, which holds a batch of rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.shared import shared_dir, stage

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of this and other common templates.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
#: Where a control string begins; one may begin inside another.
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURNS = "conv_id long, turn_no long, text string, starts long, body_from long, body_to long, trainable boolean"


def escape(text: str) -> str:
    """Doubles backslashes, then puts one into each control string after its first character; none is left."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of :func:`escape`: of each backslash and the character after it, the character."""
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn and the place of its escaped body in it."""
    head = f"{TURN}{escape(role)}{BODY}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(text: str) -> tuple[str, str]:
    """Role and text of a marked turn."""
    head, _, body = text.removeprefix(TURN).partition(BODY)
    return unescape(head), unescape(body.removesuffix(END))


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marked turns with their number and place within the part of the conversation that lies in this task."""
    from pyspark import TaskContext

    part, last, no, place = TaskContext.get().partitionId(), object(), 0, 0
    for b in batches:
        rows = []
        for conv, role, text in zip(b.conv_id, b.role, b.text, strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if conv != last:
                last, no, place = conv, 0, 0
            out, at, to = render(role, text)
            rows.append((part, conv, no, out, place, at, to, role == "assistant"))
            no, place = no + 1, place + len(out)
        frame = pd.DataFrame(rows, columns=["part", "conv_id", "turn_no", "text", "starts", "body_from", "body_to", "trainable"])
        yield frame.assign(conv_id=frame.conv_id.astype("Int64"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """The ``turns`` table: ranges of turns are numbered each by itself, then moved by what earlier ranges hold of the conversation."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role"), blank("text"))
    local = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_number, f"part int, {_TURNS}"), "chat-ranges")
    held = local.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), F.sum("n").over(earlier).alias("turns_before"), F.sum("chars").over(earlier).alias("chars_before"))
    # only a conversation cut by a range's end has an earlier part: at most one row per range
    moved = stage(moved.where("turns_before IS NOT NULL"), "chat-moves")
    out = local.join(moved, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    later = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    return out.select("conv_id", later("turn_no", "turns_before"), "text", later("starts", "chars_before"), "body_from", "body_to", "trainable")


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: the context before it and the loss mask over its reply."""
    mine = turns.where("trainable")
    return mine.select("conv_id", F.col("turn_no").alias("example_no"), "turn_no", F.col("starts").alias("context_chars"), (F.col("starts") + F.col("body_from")).alias("loss_from"), (F.col("starts") + F.col("body_to")).alias("loss_to"))


def expand(turns: DataFrame) -> DataFrame:
    """Full texts ``conv_id, example_no, text, loss_from, loss_to``.  Quadratic in a conversation's turns."""
    t = turns.select(F.col("conv_id").alias("c"), F.col("turn_no").alias("n"), "text")
    joined = examples(turns).join(t, F.col("conv_id").eqNullSafe(F.col("c"))).where("n <= turn_no")
    whole = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]))
    return joined.groupBy("conv_id", "example_no", "loss_from", "loss_to").agg(whole.alias("text")).select("conv_id", "example_no", "text", "loss_from", "loss_to")


def write_chat(conversations: DataFrame, folder: str | None = None) -> str:
    """Write ``turns`` and ``examples`` and return their folder."""
    spark = conversations.sparkSession
    folder = folder or f"{shared_dir(spark)}/chat-{uuid4().hex}"
    format_turns(conversations).write.parquet(f"{folder}/turns")
    examples(spark.read.parquet(f"{folder}/turns")).write.parquet(f"{folder}/examples")
    return folder


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    last, turns, loss, n, chars, total = object(), None, None, 0, 0, 0

    def row() -> tuple:
        return (last, n, turns.hexdigest(), chars, loss.hexdigest(), total)

    for b in batches:
        rows = []
        for conv, text, at, to, train in zip(b.conv_id, b.text, b.loss_from, b.loss_to, b.masked, strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if conv != last:
                if turns is not None:
                    rows.append(row())
                last, turns, loss, n, chars, total = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, body = parse(text)
            turns.update(f"{role}\n{body}\n".encode())
            if train:
                reply = unescape(text[int(at) : int(to)])
                loss.update(reply.encode())
                chars += len(reply)
            n, total = n + 1, total + len(text)
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
    if turns is not None:
        yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})


def describe(spark: SparkSession, folder: str) -> DataFrame:
    """Digest per conversation of what :func:`write_chat` wrote: marks parsed, masks taken from the examples."""
    turns, masks = spark.read.parquet(f"{folder}/turns"), spark.read.parquet(f"{folder}/examples")
    masks = masks.select(F.col("conv_id").alias("c"), F.col("turn_no").alias("t"), "loss_from", "loss_to", F.lit(True).alias("masked"))
    rows = turns.join(masks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn_no") == F.col("t")), "left")
    rows = rows.select("conv_id", "turn_no", "text", *((F.coalesce(c, F.lit(0)) - F.col("starts")).alias(c) for c in ("loss_from", "loss_to")), F.coalesce("masked", F.lit(False)).alias("masked"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return rows.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted, written, and described from what is read back."""
    odd = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return describe(spark, write_chat(rows.unionByName(own)))


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


OP2_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(TURN) + len(BODY) + len(END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
