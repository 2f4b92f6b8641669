"""Exact n-gram Jaccard self-join with set-relation skipping, as connected classes.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of
0.8 or more; the result gives each document the smallest id that links reach.

Equal sets are one set. Each set is put in one global order of shingles, rare ones
first (by counts of hash buckets, then by hash), and only its prefix is indexed: sets
that link share a shingle of both prefixes. Two kinds of skipping keep the work
linear in a group of many similar sets:

* index lists are skipped by blocks and position: a list is dealt into blocks of
  sets whose sizes are within a factor of 0.8, and an entry only meets its own block
  and the next ones; entries hold the shingle's place too, and pairs that cannot reach
  the needed overlap from there go; what is left is met by a parity bitmap of each set,
  whose differing bits are a lower bound of the sets' difference, and only pairs below
  that bound are compared by their whole sets;
* answers are derived from a similar set's answers: all sets of a list are first
  compared with the list's one leader. What links to it is in its class, and lists
  whose sets are in one class by then are done. For sets of different classes in a
  list, one promising pair of each (set, class) is compared next, and only where
  that does not join them all pairs between the two classes that pass the position
  filter are. Pairs inside one class are never compared again.

Every link between different classes is looked for in full at the end, so no link is
lost; a large group costs as many comparisons as it has sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from otelframe.llm import shingles
from otelframe.llm.common import dealt_anew, documents, map_texts, materialize, release
from otelframe.llm.components import connected_components
from otelframe.llm.exact_dedup import bitmap, keep_set_bits

#: Similarity 80/100 as integers; shingle counts are kept for 2**COUNT_BITS hash buckets.
NEAR, WHOLE = 80, 100
COUNT_BITS, SLICES = 22, 64
_LAST = (1 << 63) - 1
#: Tasks whose counts are added up in one group.
ADDED = 128


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def sketch(h: np.ndarray) -> bytes:
    """Parity bitmap: bit i tells whether an odd number of shingles fall on it. It has
    about as many bits as the set has shingles, 64 to 65536, a power of two."""
    bits = 1 << min(16, max(6, (len(h) - 1).bit_length()))
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, the longer one folded: a lower bound of
    the number of shingles that only one set has."""
    if len(x) < len(y):
        x, y = y, x
    a, n = int.from_bytes(x, "big"), len(x)
    while n > len(y):
        n //= 2
        a = (a >> (8 * n)) ^ (a & ((1 << (8 * n)) - 1))
    return (a ^ int.from_bytes(y, "big")).bit_count()


def sets_and_counts(docs: DataFrame) -> DataFrame:
    """For each document id, size, sig, sketch; and for each task its bucket counts (how
    many documents have a shingle of the bucket), as SLICES rows with slice, counts and
    the task's number ``part``."""
    ddl = "id long, copy long, size long, sig long, sketch binary, slice int, counts binary, part int"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            out: dict[str, list] = {"size": [], "sig": [], "sketch": []}
            for text in batch.column("text").to_pylist():
                h = shingles.distinct(text)
                np.add.at(counts, bucket_of(h), 1)
                out["size"].append(len(h))
                out["sig"].append(shingles.signature(h) if len(h) else None)
                out["sketch"].append(sketch(h))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array(out["size"], pa.int64()), pa.array(out["sig"], pa.int64()), pa.array(out["sketch"], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], schema=schema)
        if counts.any():
            parts = [p.astype("<u4").tobytes() for p in np.split(counts, SLICES)]
            task = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, pa.int64())] * 4, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()), task], schema=schema)

    return docs.select("id", "copy", "text").mapInArrow(run, ddl)


def order_classes(found: DataFrame) -> np.ndarray:
    """For each bucket a class from 0 (rare) up, four classes to a doubling of the
    count: 2**COUNT_BITS bytes, whatever the size of the corpus."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((1 << COUNT_BITS) // SLICES, np.uint64)
        for data in part["counts"]:
            sums += np.frombuffer(data, "<u4")
        total = np.minimum(sums, np.iinfo(np.uint32).max).astype("<u4").tobytes()
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "counts": [total], "part": part["part"].iloc[:1] // ADDED})

    # added up as a tree, so that no group grows with the number of tasks
    rows = found.where("slice is not null").select("slice", "counts", "part")
    left = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        rows = rows.groupBy("slice", F.expr(f"part div {ADDED}").alias("_of")).applyInPandas(add, "slice int, counts binary, part int")
        left = -(-left // ADDED)
        if left == 1:
            break
        rows = materialize(rows)
    table = np.zeros(1 << COUNT_BITS, np.uint8)
    width = len(table) // SLICES
    for r in rows.toLocalIterator():
        sums = np.frombuffer(r.counts, "<u4")
        table[r.slice * width : (r.slice + 1) * width] = np.minimum(255, np.round(4 * np.log2(1 + sums.astype(np.float64))))
    return table


def prefixes(docs: DataFrame, table: Broadcast) -> DataFrame:
    """Index entries: gram, sig, size, place (in the set's global order), for the
    ``size - ceil(0.8 size) + 1`` first shingles of each set. ``table`` has the class of
    each bucket of shingles."""

    def rows(batch: dict) -> dict:
        grams, sigs, sizes, places = [], [], [], []
        for text in batch["text"]:
            h = shingles.distinct(text)
            n = len(h)
            if not n:
                continue
            length = n - -(-NEAR * n // WHOLE) + 1
            chosen = h[np.lexsort((h, table.value[bucket_of(h)]))[:length]]
            grams.append(chosen.view(np.int64))
            sigs.append(np.full(length, shingles.signature(h), np.int64))
            sizes.append(np.full(length, n, np.int32))
            places.append(np.arange(length, dtype=np.int32))
        long, short = np.empty(0, np.int64), np.empty(0, np.int32)
        return {"gram": np.concatenate([long, *grams]), "sig": np.concatenate([long, *sigs]), "size": np.concatenate([short, *sizes]), "place": np.concatenate([short, *places])}

    return map_texts(docs, ["text"], "gram long, sig long, size int, place int", rows)


def reachable(a: str, b: str) -> Column:
    """Whether two entries of one list can still be entries of sets that link."""
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    rest = F.least(F.col(f"{a}.size") - F.col(f"{a}.place"), F.col(f"{b}.size") - F.col(f"{b}.place"))
    return (WHOLE * small >= NEAR * large) & ((NEAR + WHOLE) * rest >= NEAR * (F.col(f"{a}.size") + F.col(f"{b}.size")))


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig, grams (sorted shingles as bytes) of the sets in ``wanted`` (sig, id): documents
    are picked by a bitmap of bounded size, so that no text is shuffled."""
    known = bitmap(wanted.select(F.xxhash64("id").alias("key")))
    picked = keep_set_bits(docs, F.xxhash64("id"), known, "wanted").where("wanted")

    def rows(batch: dict) -> dict:
        sets = [shingles.distinct(t) for t in batch["text"]]
        return {"id": batch["id"], "sig": [shingles.signature(h) if len(h) else None for h in sets], "grams": [h.tobytes() for h in sets]}

    made = map_texts(picked, ["id", "text"], "id long, sig long, grams binary", rows)
    return made.join(wanted.select("sig", F.col("id").alias("w_id")), "sig").where(F.col("id").eqNullSafe(F.col("w_id"))).dropDuplicates(["sig"]).select("sig", "grams")


def near_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of ``sets`` (sig, size, sketch): those that sizes and bitmaps allow."""
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(WHOLE * F.least("size_a", "size_b") >= NEAR * F.greatest("size_a", "size_b"))

    def rows(batch: dict) -> dict:
        ok = [
            (WHOLE + NEAR) * differing_bits(x, y) <= (WHOLE - NEAR) * (m + n)
            for x, y, m, n in zip(batch["sketch_a"], batch["sketch_b"], batch["size_a"], batch["size_b"])
        ]
        keep = np.flatnonzero(ok).tolist()
        return {"a": [batch["a"][i] for i in keep], "b": [batch["b"][i] for i in keep]}

    return map_texts(both, ["a", "b", "size_a", "size_b", "sketch_a", "sketch_b"], "a long, b long", rows)


def compared(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b): those that link, by their whole sets."""
    close = materialize(near_enough(pairs, sets))
    wanted = materialize(close.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(sets.select("sig", "id"), "sig"))
    whole = materialize(contents(docs, wanted))
    left = close.join(whole.select(F.col("sig").alias("b"), F.col("grams").alias("grams_b")), "b")
    both = left.join(whole.select(F.col("sig").alias("a"), F.col("grams").alias("grams_a")), "a")

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, x, y in zip(batch["a"], batch["b"], batch["grams_a"], batch["grams_b"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            if WHOLE * common >= NEAR * (len(x) + len(y) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return materialize(map_texts(both, ["a", "b", "grams_a", "grams_b"], "a long, b long", rows))


def near_duplicate_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, copy (hash of the text), size (of its set),
    component_id, kept.

    ``component_id`` is the smallest id of the class, and ``kept`` marks the row that has
    it (of several texts with that id, the one of least ``copy``). Null texts and texts
    without words have empty sets and link with nothing: their component_id is their own
    id, and they are kept. Null ids are never the smallest; a class whose ids are all null
    has a null component_id. Rows that repeat id and text share their results. Tables
    without rows give no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("copy"), F.col(text_column).alias("text"))
    found = materialize(sets_and_counts(docs))
    members = found.where("slice is null").select("id", "copy", "size", "sig", "sketch")
    place = F.struct(F.coalesce("id", F.lit(_LAST)).alias("at"), "copy")
    sets = members.where("sig is not null").groupBy("sig").agg(F.min(place).alias("o"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sets = materialize(sets.select("sig", F.nullif("o.at", F.lit(_LAST)).alias("id"), "o", "size", "sketch"))

    table = docs.sparkSession.sparkContext.broadcast(order_classes(found))
    entries = materialize(prefixes(docs, table))
    table.unpersist()
    met = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(dealt_anew().alias("gram"))
    several = entries.join(met, "gram", "left_semi").distinct()
    # the leader is the set that has the list's shingle first: it has the fewest rarer
    # shingles of its own, so it is the one in the middle of a group of edited copies
    lists = several.groupBy("gram").agg(F.min(F.struct("place", "sig", "size")).alias("head"), F.min("sig").alias("least"), F.max("sig").alias("most")).where("least <> most")
    shared = materialize(several.join(lists.select(dealt_anew().alias("gram"), "head"), "gram"))
    release(entries)

    first = shared.withColumn("a", F.struct("head.size", "head.place")).withColumn("b", F.struct("size", "place")).where((F.col("sig") != F.col("head.sig")) & reachable("a", "b"))
    linked = compared(docs, first.select(F.col("head.sig").alias("a"), F.col("sig").alias("b")).distinct(), sets)
    labels = connected_components(linked)

    for exhaustive in (False, True):
        pairs = between_classes(shared, labels, exhaustive)
        more = compared(docs, pairs, sets)
        if not more.isEmpty():
            labels = connected_components(more, labels)
    release(shared)

    classed = sets.select("sig", "o").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    low = classed.groupBy("label").agg(F.min("o").alias("low")).select(dealt_anew("label").alias("label"), "low")
    named = classed.join(low, "label").select(dealt_anew("sig").alias("key"), "low")
    # rows without words join nothing; keys of their own spread them
    keyed = members.select("id", "copy", "size", "sig", F.coalesce("sig", F.xxhash64("id")).alias("key"))
    done = keyed.join(named, "key", "left")
    alone = F.col("sig").isNull()
    return done.select(
        F.col("id").alias(id_column), "copy", "size", F.when(alone, F.col("id")).otherwise(F.nullif("low.at", F.lit(_LAST))).alias("component_id"), (alone | (place == F.col("low"))).alias("kept")
    )


def between_classes(shared: DataFrame, labels: DataFrame, exhaustive: bool) -> DataFrame:
    """Pairs (a, b) of sets in different classes that share a list and can link there:
    all of them, or for each set and other class the one met in most lists.

    A list's largest class is not paired with itself by the join: one side of it
    takes the other sets only.
    """
    labelled = shared.drop("head").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    lists = labelled.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    mixed = labelled.join(lists.select(dealt_anew().alias("gram")), "gram", "left_semi").select("gram", "sig", "size", "place", "label")
    mixed = materialize(mixed)
    per_class = mixed.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = per_class.groupBy("gram").agg(F.expr("max_by(label, named_struct('n', n, 'label', label))").alias("largest"))
    strays = mixed.join(largest.select(dealt_anew().alias("gram"), "largest"), "gram").where("label <> largest")
    # sets that link are in one block of sizes or in neighbouring ones
    block = F.floor(F.log("size") / math.log(WHOLE / NEAR)).cast("int")
    a = strays.withColumn("gram", dealt_anew()).withColumn("block", F.explode(F.array(block - 1, block, block + 1))).alias("a")
    b = mixed.withColumn("block", block).alias("b")
    each = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.label") != F.col("b.label"))
    once = (F.col("b.label") == F.col("a.largest")) | (F.col("a.sig") < F.col("b.sig"))
    met = a.join(b, each & once & reachable("a", "b")).select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b"), F.col("b.label").alias("label_b"))
    if exhaustive:
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    counted = met.groupBy("a", "b", "label_b").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("a", "label_b").agg(F.expr("max_by(b, named_struct('n', n, 'b', b))").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
