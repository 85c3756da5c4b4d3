"""Chat formatting after cumulative-snapshot collapse, with DataFrame functions only.

A logged conversation is often a snapshot of a longer one: its turns are that
one's first turns. Every turn hashes with its number, role and text; a rolling
prefix hash (the exclusive or of the turns' SHA-256 so far, and the number of turns) identifies each prefix of each conversation. Running values
are formed in two levels, within blocks of ``BLOCK`` turn numbers and over the
blocks, so that no task holds a whole conversation. A conversation whose full
hash is a shorter prefix of another is dropped by an anti-join; of conversations
with the same turns the smallest id stays. The turns that are left are rendered.

Defined cases: repeated rows count once; several texts of one turn number form
one step of the prefix; null role and text hash as such and render empty; turns
without a number come first; rows without a conversation id are one
conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK = 1024
#: the parts of a hash, 64 bits each
KEYS = (1, 2, 3, 4)
#: ChatML
START, END = "<|im_start|>", "<|im_end|>"


def _xor(name: str) -> Column:
    return F.bit_xor(name)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, at, n, h1 .. h4): the hash of every prefix that ends at a turn number.

    ``turns`` has conv, at, role and text, without repeated rows.
    """
    # lengths first, so that no two turns give the same bytes; -1 stands for null
    lengths = [F.coalesce(F.octet_length(c), F.lit(-1)).cast("string") for c in ("role", "text")]
    whole = F.concat_ws(":", F.col("at").cast("string"), *lengths, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turn = turns.select("conv", "at", F.sha2(whole, 256).alias("s"))
    hashed = turn.select("conv", "at", *(F.conv(F.substring("s", 16 * k - 15, 16), 16, -10).cast("long").alias(f"t{k}")
                                         for k in KEYS))
    steps = hashed.groupBy("conv", "at").agg(F.count(F.lit(1)).alias("c"),
                                              *(_xor(f"t{k}").alias(f"x{k}") for k in KEYS))
    steps = steps.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
    blocks = steps.groupBy("conv", "block").agg(F.sum("c").alias("bc"),
                                                *(_xor(f"x{k}").alias(f"b{k}") for k in KEYS))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("bc"),
                           *(F.coalesce(_xor(f"b{k}").over(before), F.lit(0)).alias(f"b{k}") for k in KEYS))
    upto = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = steps.select("conv", "block", "at", F.sum("c").over(upto).alias("n"),
                       *(_xor(f"x{k}").over(upto).alias(f"h{k}") for k in KEYS))
    b = blocks.withColumnsRenamed({"conv": "b_conv", "block": "b_block"})
    joined = own.join(b, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    return joined.select("conv", "at", (F.col("n") + F.col("bc")).alias("n"),
                         *(F.col(f"h{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in KEYS))


def maximal(prefixes: DataFrame) -> DataFrame:
    """Conversations (conv) that are neither a shorter prefix nor a later copy of another."""
    last = staged(prefixes.groupBy("conv").agg(F.max("at").alias("last")).withColumnRenamed("conv", "l_conv"),
                  "chat-last")
    all_ = prefixes.join(last, F.col("conv").eqNullSafe(F.col("l_conv")))
    key = ["at", "n", *(f"h{k}" for k in KEYS)]
    # one row per whole conversation and one per proper prefix: nothing hot is left to join
    whole = all_.where("at = last").groupBy(*key).agg(F.min(F.struct(F.col("conv").isNull().alias("none"), "conv")).alias("c"))
    proper = all_.where("at < last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select(F.col("c.conv").alias("conv"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def collapse_and_render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text") -> DataFrame:
    """One row per turn of every maximal conversation: conv_id, turn, role, rendered, in any order.

    A conversation's text is its rows' ``rendered`` in the order of turn and rendered.
    """
    first = -(1 << 40)
    rows = turns.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(first)).alias("at"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text")).distinct()
    rows = staged(rows, "chat-turns")
    prefixes = staged(prefix_hashes(rows), "chat-prefixes")
    keep = staged(maximal(prefixes), "chat-maximal").withColumnRenamed("conv", "k_conv")
    left = rows.join(keep, F.col("conv").eqNullSafe(F.col("k_conv")), "left_semi")
    return left.select(F.col("conv").alias(conv_col), F.nullif(F.col("at"), F.lit(first)).alias(turn_col),
                       F.col("role").alias(role_col), rendered(F.col("role"), F.col("text")).alias("rendered"))
