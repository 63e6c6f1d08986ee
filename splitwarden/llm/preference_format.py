"""Preference pairs from conversations: one prompt, two completions, and what of them is trained on.

Chosen and rejected conversations of a pair share a longest common prefix of turns (same role and text). It is
rendered once, as the prompt; what follows in each is its completion. The mask of a completion lists the
character spans [from, to) of the assistant's texts with their end mark; all else is left out of the loss.

Turns are ordered by turn, then role and text, so ties and repeated rows have one order; null roles and texts
render as empty and equal each other. A pair that lacks one of its conversations is left out. Equal
conversations give two empty completions. Columns but those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the ChatML format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _conversations(turns: DataFrame, key: str, name: str) -> DataFrame:
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.array_sort(F.collect_list(turn)).alias(name))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column, role: str) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(_header(t))
        end = begin + F.length(_body(t))
        span = F.struct(begin.alias("from"), end.alias("to"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == role, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask; both tables have key, turn, role, text."""
    both = _conversations(chosen, key, "a").join(_conversations(rejected, key, "b"), "pair_id")
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False)).cast("int")
    both = both.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size("a")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return both.select("pair_id", "n_common", _rendered(F.slice("a", F.lit(1), F.col("n_common"))).alias("prompt"), *(_rendered(rest(F.col(c))).alias(n) for c, n in (("a", "chosen"), ("b", "rejected"))), *(_mask(rest(F.col(c)), trained_role).alias(n) for c, n in (("a", "chosen_mask"), ("b", "rejected_mask"))))


def swapped(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """Rejected conversations: the last answer of each is that of its neighbour, whose id differs in the last bit.

    Conversations without an answer, or whose neighbour has none, are left out.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    last = turns.where((F.col("role") == role) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l")).select("conv_id", F.col("l.turn").alias("last"), F.col("l.text").alias("answer"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("other"))
    known = last.join(other, "conv_id").select("conv_id", "last", "other")
    joined = turns.join(known, "conv_id")
    return joined.select("conv_id", "turn", "role", F.when(F.col("turn").eqNullSafe(F.col("last")) & (F.col("role") == role), F.col("other")).otherwise(F.col("text")).alias("text"))


def rotated(conversations: DataFrame, role: str = "assistant", buckets: int = 1024) -> DataFrame:
    """Rejected conversations: the last answer of each is that of the next answered one, in the order of hashed ids.

    The last in that order takes the answer of the first, so every conversation with an answer and an id has a
    row, whatever the ids; only if a single one is answered there is no other answer, and no row. Conversations
    without an answer are left out. One task sees at most one row of each bucket, or the ids of one bucket.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    last = turns.where((F.col("role") == role) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    order = last.select("conv_id", F.col("l.turn").alias("last"), F.struct(F.xxhash64("conv_id").alias("h"), F.col("conv_id").alias("id"), F.col("l.text").alias("answer")).alias("own"))
    order = order.withColumn("bucket", F.pmod("own.h", F.lit(buckets)))
    heads = order.groupBy("bucket").agg(F.min("own").alias("head"))
    # An aggregate of at most one row a bucket.
    everywhere = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(Window.orderBy("bucket")), F.first("head").over(everywhere)).alias("following"))
    inside = order.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("own.h", "conv_id")))
    known = inside.join(heads, "bucket").select("conv_id", "last", F.coalesce("next", "following").alias("next")).where("next.id <> conv_id").select("conv_id", "last", F.col("next.answer").alias("other"))
    return turns.join(known, "conv_id").select("conv_id", "turn", "role", F.when(F.col("turn").eqNullSafe(F.col("last")) & (F.col("role") == role), F.col("other")).otherwise(F.col("text")).alias("text"))


def digest(df: DataFrame) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ";")
    return df.select("pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


SQL = """
WITH last AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
pair AS (SELECT a.conv_id, a.last, b.answer AS other FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1::BIGINT)),
t AS (SELECT c.conv_id, c.turn, c.role, c.text AS a, CASE WHEN c.turn = p.last AND c.role = 'assistant' THEN p.other ELSE c.text END AS b,
             row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS i
      FROM conversations c JOIN pair p USING (conv_id)),
n AS (SELECT conv_id, coalesce(min(i) FILTER (a <> b) - 1, count(*)) AS n_common FROM t GROUP BY conv_id),
r AS (SELECT t.*, n.n_common, '<|im_start|>' || role || chr(10) AS h, a || '<|im_end|>' AS ba, b || '<|im_end|>' AS bb FROM t JOIN n USING (conv_id)),
o AS (SELECT *, sum(CASE WHEN i > n_common THEN length(h || ba) + 1 ELSE 0 END) OVER w - length(ba) - 1 AS fa,
             sum(CASE WHEN i > n_common THEN length(h || bb) + 1 ELSE 0 END) OVER w - length(bb) - 1 AS fb
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id AS pair_id, any_value(n_common)::BIGINT AS n_common,
       coalesce(string_agg(h || ba || chr(10), '' ORDER BY i) FILTER (i <= n_common), '') AS prompt,
       coalesce(string_agg(h || ba || chr(10), '' ORDER BY i) FILTER (i > n_common), '') AS chosen,
       coalesce(string_agg(h || bb || chr(10), '' ORDER BY i) FILTER (i > n_common), '') AS rejected,
       coalesce(string_agg(fa::BIGINT || '-' || (fa + length(ba))::BIGINT, ';' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(fb::BIGINT || '-' || (fb + length(bb))::BIGINT, ';' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""
