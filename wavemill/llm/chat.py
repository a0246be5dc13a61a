"""Chat formatting with cumulative snapshots collapsed.

Chat logs are often written after every turn, so the same conversation is there
once for each of its lengths.  A rolling hash over the turns gives every prefix
of every conversation a key: its length and the exclusive or of two 64-bit
hashes of each turn with its place.  A conversation whose whole key is a proper
prefix of another's is a snapshot of it; an anti-join of whole keys against
proper-prefix keys leaves the maximal conversations, which are rendered.

Conversations that are equal turn by turn are one, that of the least id; both
sides of the anti-join are distinct, so a conversation or a first turn shared
by any number of logs is one row of it.  Texts become hashes at once, and only
hashes are ordered and joined; the texts of the conversations that stay are
gathered at the end, once.  All steps are DataFrame operations.

Turns are ordered by ``turn``, then role, then text.  Where turns of one
conversation, number and role differ in text, as is rare, the texts of that
conversation go along to be ordered.  Equal rows of one conversation count
once.  A null role or text counts as empty; turns without a ``turn`` come
first.  Turns with a null id form one conversation.  A conversation, however
long, is one row of the result, and its turns are gathered in one task.  No
turns give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: How a turn is rendered: its role, its text, the end of the turn.
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"
#: Id lists up to this many rows are broadcast, others joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _turns(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(F.col(id).alias("id"), F.col(turn).alias("turn"), C.text_of(role).alias("role"), C.text_of(text).alias("text"))


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows joined with distinct ids (column ``own``), broadcast if few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, F.col("id").eqNullSafe(F.col("own")), how)


def prefixes(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each turn its conversation, its place from 1, the conversation's
    length and the hashes ``h1``, ``h2`` of the conversation up to it."""
    rows = _turns(turns, id, turn, role, text)
    rows = rows.select("id", "turn", "role", "text", *[F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)])
    bounds = [f(F.struct("t1", "t2")) for f in (F.min, F.max)]
    tied = rows.groupBy("id", "turn", "role").agg(bounds[0].alias("low"), bounds[1].alias("high")).filter("low <> high")
    tied = C.durable(tied.select(F.col("id").alias("own"), F.lit(True).alias("tied")).distinct())
    rows = _among(rows, tied, "left").select("id", "turn", "role", F.when(F.col("tied"), F.col("text")).alias("tie"), "t1", "t2")
    order = Window.partitionBy("id").orderBy("turn", "role", "tie", "t1", "t2")
    # equal rows follow each other; of them the first counts
    same = F.lag(F.struct("turn", "role", "t1", "t2")).over(order).eqNullSafe(F.struct("turn", "role", "t1", "t2"))
    rows = rows.withColumn("same", same).filter(~F.col("same"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("length", F.count("*").over(Window.partitionBy("id")))
    return rows.select("id", "place", "length", *[F.bit_xor(F.xxhash64("place", f"t{k}")).over(upto).alias(f"h{k}") for k in (1, 2)])


def maximal(marked: DataFrame) -> DataFrame:
    """``id``, ``length`` and ``n_copies`` of the conversations that stay."""
    key = [F.col("place"), F.col("h1"), F.col("h2")]
    whole = marked.filter("place = length").groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("n_copies"))
    proper = marked.filter("place < length").select(*key).distinct()
    return whole.join(proper, ["place", "h1", "h2"], "left_anti").select("id", F.col("place").cast("long").alias("length"), "n_copies")


def collapse(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations: ``id``, ``n_turns``, ``n_copies`` and ``rendered``."""
    kept = C.durable(maximal(C.durable(prefixes(turns, id, turn, role, text))))
    rows = _among(_turns(turns, id, turn, role, text), kept.select(F.col("id").alias("own"), "length", "n_copies"), "inner")
    before, after = TEMPLATE.split("{role}")
    middle, end = after.split("{text}")
    # numbered turns after those without a number
    gathered = F.array_sort(F.collect_set(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text")))
    rendered = F.array_join(F.transform(gathered, lambda x: F.concat(F.lit(before), x["role"], F.lit(middle), x["text"], F.lit(end))), "")
    found = rows.groupBy("id", "length", "n_copies").agg(rendered.alias("rendered"))
    return found.select(F.col("id").alias(id), F.col("length").alias("n_turns"), "n_copies", "rendered")


def op6_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    return collapse(C.table(spark, sf_dir, "conversations"))
