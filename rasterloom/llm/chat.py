"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

A log often holds a conversation again after each turn. Each turn gets a rolling hash of the turns up to it: the sum of
position-bound 64-bit hashes of role and text (two of them, summed in halves so that nothing overflows), taken by one
window. A conversation whose full hash is the hash of a proper prefix of another goes by anti-join; of equal ones the least
conv_id stays. The survivors, the maximal conversations, are rendered. Hashing shuffles numbers only; the texts move once,
to be rendered. Prefixes are made distinct map-side before the anti-join, so a first turn that a third of all logs share is
one row a task.

Turns stand in the order of `turn`, null first; equal turns by their hashes; repeated rows are turns like others. A null
role is rendered as "unknown", a null text as empty; both differ from those words when conversations are compared. Rows of
null conv_id are one conversation. "<|" in a role or text becomes "< |", so that no text forges a marker. A conversation
must fit in one row, as its rendering is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import load, table


def _hashes(c: DataFrame) -> DataFrame:
    flags = F.isnull("role").cast("int") + 2 * F.isnull("text").cast("int")
    return c.withColumns({"h1": F.xxhash64("role", F.lit("\x1f"), "text", flags), "h2": F.xxhash64(F.lit(7), "text", flags, "role")})


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1 for the first turn), n (turns of the conversation), key and check: the rolling hash of the turns up to here."""
    rows = _hashes(conversations.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "h1", "h2")
    w = Window.partitionBy("conv_id").orderBy("turn", "h1", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"at": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "h1", "h2")), "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    halves = {}
    for k in ("h1", "h2"):
        term = F.xxhash64("at", k)
        halves |= {f"{k}_lo": F.sum(term.bitwiseAND(F.lit(0xFFFFFFFF))).over(w), f"{k}_hi": F.sum(F.shiftrightunsigned(term, 32)).over(w)}
    rows = rows.withColumns(halves)
    return rows.select("conv_id", "at", "n", F.xxhash64("h1_lo", "h1_hi").alias("key"), F.xxhash64(F.lit(1), "h2_lo", "h2_hi").alias("check"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: the conversations that are no prefix of another; of equal ones the least conv_id, with how many there are."""
    p = prefix_hashes(conversations)
    full = p.where("at = n").groupBy("at", "key", "check").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = p.where("at < n").select("at", "key", "check").distinct()
    return full.join(shorter, ["at", "key", "check"], "left_anti").select("conv_id", F.col("at").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id and chat: each turn as <|role|>, line feed, text, <|end|>, line feed."""
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    rows = _hashes(conversations.select("conv_id", "turn", "role", "text"))
    rows = rows.select("conv_id", "turn", "h1", "h2", F.concat(F.lit("<|"), safe(F.coalesce("role", F.lit("unknown"))), F.lit("|>\n"), safe(F.coalesce("text", F.lit(""))), F.lit("<|end|>\n")).alias("piece"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "piece")))
    return rows.groupBy("conv_id").agg(turns.alias("x")).select("conv_id", F.array_join(F.col("x.piece"), "").alias("chat"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat of the maximal conversations. Columns other than conv_id, turn, role and text aren't read; an empty table gives no rows."""
    keep = table(maximal(conversations), "maximal")
    own = keep.select(F.col("conv_id").alias("own_id"), "n_turns", "n_copies")
    texts = conversations.join(keep.select(F.col("conv_id").alias("kept_id")), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    d = render(texts).join(own, F.col("conv_id").eqNullSafe(F.col("own_id")))
    return d.select("conv_id", "n_turns", "n_copies", "chat")


def op10_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, n_copies, chat of every maximal conversation."""
    return format_chats(load(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, count(*) AS n, list(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n') ORDER BY turn) AS l,
    string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY turn) AS chat
  FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT i, md5(array_to_string(l[1:i], chr(30))) AS k FROM (SELECT l, unnest(range(1, n)) AS i FROM c)),
f AS (SELECT n, md5(array_to_string(l, chr(30))) AS k, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ALL)
SELECT f.conv_id, CAST(f.n AS BIGINT) AS n_turns, CAST(f.n_copies AS BIGINT) AS n_copies, c.chat
FROM f JOIN c ON f.conv_id = c.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i = f.n AND p.k = f.k)
"""
