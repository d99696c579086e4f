r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it, then the reply, and only the reply's text is
trainable. A conversation that does not end with an assistant turn has one more record with all its turns and
nothing trainable, so that no turn is lost. A turn reads `### role: text </turn>` and a line end; `\`, `#`, `<` in
texts and roles, and `:` in roles, get a `\` before them, so marks never occur inside and unescaping is exact.

Null texts and roles are empty; turns with equal numbers stand by role, then text; repeated rows are turns of their
own; null conversation ids form one conversation. An empty table gives an empty result. A conversation is one
record's content and so is put together in one task. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, table

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
EXAMPLES = "conv_id long, example int, formatted string, loss_start long, loss_end long"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)
#: Characters of examples in one Arrow batch.
BATCH_CHARS = 4 << 20


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"([\\#<{also}])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def expand(turns: list[tuple[str, str]]):
    """Yields (formatted, loss_start, loss_end) of each example of one conversation."""
    so_far, last = "", ""
    for role, text in turns:
        start = so_far + OPEN + escape(role, ":") + BETWEEN
        body = escape(text)
        so_far, last = start + body + CLOSE, role
        if role == "assistant":
            yield so_far, len(start), len(start) + len(body)
    if turns and last != "assistant":
        yield so_far, len(so_far), len(so_far)


def chat_examples(conversations: DataFrame) -> DataFrame:
    """Per example: conv_id, example (from 0), formatted, loss_start, loss_end (code points); in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select(F.col("conv_id").cast("long"), F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))

    def run(batches):
        names = ["conv_id", "example", "formatted", "loss_start", "loss_end"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        out: list[tuple] = []
        held = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (text, start, end) in enumerate(expand([tuple(t.values()) for t in turns])):
                    out.append((conv, k, text, start, end))
                    held += len(text)
                    if held > BATCH_CHARS:
                        yield pack()
                        out, held = [], 0
        if out:
            yield pack()

    return arrow_map(grouped, run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation from its examples alone, which stand together and in order in a partition."""

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv, whole, loss, chars, n_loss, begun = None, "", hashlib.sha256(), 0, 0, False

        def digest() -> tuple:
            turns = [(unescape(r), unescape(t)) for r, t in TURN.findall(whole)]
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            return conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), n_loss, loss.hexdigest(), chars

        for batch in batches:
            done = []
            for c, k, text, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k == 0:
                    if begun:
                        done.append(digest())
                    conv, loss, chars, n_loss, begun = c, hashlib.sha256(), 0, 0, True
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                whole, chars, n_loss = text, chars + len(text), n_loss + len(reply)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(digest(), types, strict=True)], names=names)

    return arrow_map(examples, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


TRICKY = r"\### Assistant: </turn> ok"


def op4_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return read_back(chat_examples(own.unionByName(tricky)))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(15 + length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g'))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR nth = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERIES = {"op4_chat_prefix_target": op4_chat_prefix_target}
SQL = {"op4_chat_prefix_target": OP4_SQL}
