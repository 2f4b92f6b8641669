"""Exact dedup by progressive refinement: length, prefix hash, full hash.

DataFrame operations only. Each pass keeps what can still have an equal partner:

1. group by byte length: lengths that occur once are done;
2. group the rest by (length, hash of the first characters): single ones are done;
3. the full SHA-256 is computed for rows of surviving groups only.

What survives a pass reaches the next one as a bitmap: each key that occurs more
than once sets one bit, and a row goes on where its bit is set. A bitmap has 16 bits
a key, and ``2**MOST_BITS`` at most, so it may be broadcast; two keys on one bit only
cost a hash that was not needed. Beyond some millions of keys a full bitmap lets more
rows through, which is still less work than to shuffle their texts. No text is ever
shuffled, and every group by is on counts that are summed before they travel.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otelframe.llm.common import materialize, text_or_empty

PREFIX_CHARS = 64
#: Bounds of a bitmap's size: 2**26 bits are 8 MB in 64-bit words.
LEAST_BITS, MOST_BITS = 16, 26


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(1 << bits))


class Bitmap(NamedTuple):
    rows: DataFrame
    bits: int


def repeat_bitmap(keys: DataFrame, bits: int | None = None) -> Bitmap:
    """Bits of the values of ``key`` (long) that occur more than once."""
    repeated = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return bitmap(materialize(repeated), bits)


def bitmap(keys: DataFrame, bits: int | None = None) -> Bitmap:
    """A bit for each value of ``key`` (long), as at most 2**bits / 4096 rows: slice,
    masks (map of word number to 64 bits). Without ``bits`` the keys are counted."""
    bits = bits or min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    words = (
        keys.select(_bit(F.col("key"), bits).alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    )
    slices = words.groupBy(F.expr("word div 64").alias("slice")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).alias("k"), "mask"))).alias("masks"))
    return Bitmap(materialize(slices), bits)


def keep_set_bits(rows: DataFrame, key: Column, known: Bitmap, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether the bit of ``key`` is set."""
    hit = F.expr("(shiftright(try_element_at(masks, cast(_bit div 64 % 64 as bigint)), cast(_bit % 64 as int)) & 1L) = 1L")
    joined = rows.withColumn("_bit", _bit(key, known.bits)).join(F.broadcast(known.rows), F.expr("_bit div 4096") == F.col("slice"), "left")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_bit", "slice", "masks")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: dict[str, Column] | None = None, bits: int | None = None) -> DataFrame:
    """One row per input row: id, length, keep_id, group_size, kept, full_hash.

    Texts are equal when identical; null counts as empty. The row with the largest
    id stays; null ids are the smallest, and rows repeated with the same id share
    one decision. ``full_hash`` (binary) is null where refinement ended before it
    was needed. ``carry`` names further columns to take along, as expressions over
    the text column. An empty table gives an empty result; columns of ``docs`` that
    are not named are not read, whatever they are called.
    """
    carry = carry or {}
    base = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    by_length = F.octet_length("text").cast("long")
    by_prefix = F.xxhash64(by_length, F.substring("text", 1, PREFIX_CHARS))

    lengths = repeat_bitmap(base.select(by_length.alias("key")), bits)
    same_length = keep_set_bits(base, by_length, lengths, "alive")
    prefixes = repeat_bitmap(same_length.where("alive").select(by_prefix.alias("key")), bits)
    # a prefix key holds the length, so its bit stands for both passes
    marked = keep_set_bits(base, by_prefix, prefixes, "alive")

    full = F.when(F.col("alive"), F.unhex(F.sha2("text", 256)))
    rows = marked.select(
        F.col("id"),
        by_length.alias("length"),
        full.alias("full_hash"),
        # rows without a full hash join nothing; a key of their own spreads them
        F.coalesce(full, F.unhex(F.hex(F.xxhash64("id", by_length)))).alias("join_key"),
        *[c.alias(f"c_{name}") for name, c in carry.items()],
    )
    groups = (
        rows.where("full_hash is not null")
        .groupBy("full_hash", "length")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("full_hash").alias("g_key"), "keep_id", "group_size")
    )
    joined = rows.join(groups, F.col("join_key") == F.col("g_key"), "left")
    single = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias(id_column),
        "length",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(single, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "full_hash",
        *[F.col(f"c_{name}").alias(name) for name in carry],
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from otelframe.llm.common import documents

    done = exact_dedup(documents(spark, sf_dir), carry={"text_sha256": F.sha2("text", 256)})
    return done.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
