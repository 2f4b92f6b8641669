"""Content-addressed store of token ids.

A rolling hash over the id stream of a document cuts it where the hash of the last
ids has its low bits zero, so equal passages give equal chunks wherever they stand.
The store is three Parquet tables in the shared folder:

* ``chunks``: chunk_id (BLAKE2b of the payload), data; each distinct chunk once;
* ``recipes``: start, doc_id, n_tokens, chunk_ids, ends (of the chunks), root (Merkle root);
* ``manifest``: one Merkle root over the recipes of each range of RANGE documents at most.

The payload of a chunk is its ids as little-endian uint16 where all fit, else
uint32, after a byte that tells the width. Reading back checks every chunk against
its name, every recipe against its root, and the roots and numbers of recipes of each
range against the manifest, so that a recipe that was lost is an error. A document's CRC is put together from
the CRCs of the chunks read, so that verifying moves a few bytes a chunk and no
payload; ``restore`` returns the ids themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otelframe.llm.common import documents, map_texts, materialize, release, shared_dir, write_parquet
from otelframe.llm.tokens import default_vocabulary, with_end

#: Ids that the rolling hash sees, and the bounds and mean of a chunk's ids.
WINDOW, LEAST, MEAN, MOST = 8, 64, 512, 2048
#: Documents whose recipes stand under one root of the manifest.
RANGE = 10_000


class Store(NamedTuple):
    chunks: str
    recipes: str
    manifest: str


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of ``ids``."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):  # h[i] = sum of mixed[i - k] * odd ** k
        h[k:] += mixed[: n - k] * np.uint64(pow(0xBF58476D1CE4E5B9, k, 1 << 64))
    marks = (np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN - LEAST) == 0) + 1).tolist()
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or (m == n and m > last):
            out.append(m)
            last = m
    return out


def payload(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a level's odd last node goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements modulo the CRC-32 one (bits reflected)."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(np.broadcast(a, b).shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= b * ((a >> np.uint32(k)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (b & np.uint32(1)))
    return out


def crc_before(crc: np.ndarray, bytes_after: np.ndarray) -> np.ndarray:
    """What a part with ``crc`` contributes to the CRC of a whole in which
    ``bytes_after`` bytes follow it; the whole's CRC is the XOR over its parts."""
    out, power = crc.astype(np.uint32), np.uint32(1 << 23)  # x ** 8
    left = bytes_after.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = _times(np.broadcast_to(power, odd.sum()), out[odd])
        power = _times(np.array([power]), np.array([power]))[0]
        left = left >> 1
    return out


def write_store(docs: DataFrame, vocabulary: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> Store:
    """Encode every text, append ``end_id``, and write the three tables, documents in
    ascending order of id.

    Null texts are empty (one chunk with the end id). Null ids come first; rows with
    equal ids stand next to each other in the order of their contents. Tables without
    rows give a store without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ddl = "doc_id long, n_tokens long, root binary, chunk_ids array<binary>, ends array<long>, fresh array<binary>, data array<binary>"

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_tokens", "root", "chunk_ids", "ends", "fresh", "data")}
        seen: set[bytes] = set()
        for text in batch["text"]:
            ids = with_end(vocabulary, text or "", end_id)
            ends = cuts(ids)
            parts = [payload(ids[a:b]) for a, b in zip([0, *ends], ends)]
            names = [name_of(p) for p in parts]
            fresh = []
            for k, x in enumerate(names):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            out["n_tokens"].append(len(ids))
            out["root"].append(merkle(names))
            out["chunk_ids"].append(names)
            out["ends"].append(ends)
            out["fresh"].append([names[k] for k in fresh])
            out["data"].append([parts[k] for k in fresh])
        return out | {"doc_id": batch["id"]}

    staged = materialize(map_texts(docs, [F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")], ddl, rows, at_once=20_000))
    root = shared_dir(spark)
    store = Store(f"{root}/chunks", f"{root}/recipes", f"{root}/manifest")

    fresh = staged.select(F.explode(F.arrays_zip("fresh", "data")).alias("x")).select(F.col("x.fresh").alias("chunk_id"), F.col("x.data").alias("data"))
    write_parquet(fresh.groupBy("chunk_id").agg(F.first("data").alias("data")), store.chunks)

    recipes = staged.select("doc_id", "n_tokens", "root", "chunk_ids", "ends")
    # rows that are equal in all of these are interchangeable, and their number spreads them
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("root"), F.col("row")]
    recipes = recipes.withColumn("row", F.monotonically_increasing_id())
    ranged = materialize(recipes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    within = Window.partitionBy("part").orderBy(*order)
    counted = ranged.withColumn("inside", F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    counted = counted.withColumn("range", ((F.row_number().over(within) - 1) / RANGE).cast("int"))
    placed = counted.join(F.broadcast(before), "part").select("part", "range", (F.col("before") + F.col("inside")).alias("start"), "doc_id", "n_tokens", "chunk_ids", "ends", "root")
    write_parquet(placed, store.recipes)
    release(staged, ranged)
    write_parquet(range_roots(spark, store), store.manifest)
    return store


def range_roots(spark, store: Store) -> DataFrame:
    """part, range, documents, root: the Merkle root of the stored recipes of each range."""

    def roots(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        return pd.DataFrame({"part": [key[0]], "range": [key[1]], "documents": [len(part)], "root": [merkle(list(part["root"]))]})

    return spark.read.parquet(store.recipes).select("part", "range", "start", "root").groupBy("part", "range").applyInPandas(roots, "part int, range int, documents long, root binary")


def check_manifest(spark, store: Store) -> None:
    """An error where the stored recipes of a range differ from the manifest in number,
    order or contents, or where either lacks a range."""
    now = range_roots(spark, store).select("part", "range", F.col("documents").alias("n"), F.col("root").alias("r"))
    both = spark.read.parquet(store.manifest).join(now, ["part", "range"], "full")
    wrong = both.where(~(F.col("documents").eqNullSafe(F.col("n")) & F.col("root").eqNullSafe(F.col("r")))).limit(1).collect()
    if wrong:
        raise ValueError(f"recipes of range {wrong[0].part}, {wrong[0].range} differ from the manifest")


def checked_chunks(spark, store: Store) -> DataFrame:
    """chunk_id, stored (number of ids), crc (of the ids as uint32) of every stored chunk, read and checked."""

    def rows(batch: dict) -> dict:
        crc, n = [], []
        for name, data in zip(batch["chunk_id"], batch["data"]):
            ids = unpack(data)
            if name_of(data) != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            crc.append(zlib.crc32(ids))
            n.append(len(ids))
        return {"chunk_id": batch["chunk_id"], "stored": n, "crc": crc}

    return map_texts(spark.read.parquet(store.chunks), ["chunk_id", "data"], "chunk_id binary, stored long, crc long", rows)


def read_recipes(spark, store: Store) -> DataFrame:
    """Recipe rows, each checked against its Merkle root."""
    table = spark.read.parquet(store.recipes).drop("part", "range")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, root in zip(batch.column("chunk_ids").to_pylist(), batch.column("root").to_pylist()):
                if merkle(names) != root:
                    raise ValueError("a recipe differs from its root")
            yield batch

    return table.mapInArrow(check, table.schema)


def verify(spark, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored files, once
    they agree with the manifest."""
    check_manifest(spark, store)

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, bytes_after: pd.Series) -> pd.Series:
        return pd.Series(crc_before(crc.to_numpy(), bytes_after.to_numpy()).astype("int64"))

    recipes = read_recipes(spark, store)
    entries = recipes.select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip("chunk_ids", "ends")).alias("x"))
    entries = entries.select("doc_id", "start", "n_tokens", F.col("x.chunk_ids").alias("chunk_id"), (4 * (F.col("n_tokens") - F.col("x.ends"))).alias("bytes_after"))
    joined = entries.join(checked_chunks(spark, store), "chunk_id", "left")
    parts = joined.select("doc_id", "start", "n_tokens", "stored", shifted(F.expr("nvl(crc, raise_error('a chunk is missing'))"), "bytes_after").alias("part"))
    whole = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sum("stored").alias("found"), F.expr("bit_xor(part)").alias("ids_crc32"))
    return whole.select("doc_id", "start", F.expr("if(found = n_tokens, n_tokens, raise_error('a document is incomplete'))").alias("n_tokens"), "ids_crc32")


def restore(spark, store: Store) -> DataFrame:
    """doc_id, start, ids of each document, joined from its chunks."""
    check_manifest(spark, store)
    entries = read_recipes(spark, store).select("doc_id", "start", F.posexplode("chunk_ids").alias("k", "chunk_id"))
    chunks = spark.read.parquet(store.chunks).select("chunk_id", "data")
    rows = entries.join(chunks, "chunk_id").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "data"))).alias("parts"))

    def ids(batch: dict) -> dict:
        return {"doc_id": batch["doc_id"], "start": batch["start"], "ids": [np.concatenate([unpack(p["data"]) for p in parts]).tolist() for parts in batch["parts"]]}

    return map_texts(rows, ["doc_id", "start", "parts"], "doc_id long, start long, ids array<int>", ids)


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    store = write_store(documents(spark, sf_dir), default_vocabulary("byte_bpe_50k.json"))
    return verify(spark, store)
