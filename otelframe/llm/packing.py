"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has three capacities: tokens, documents, and attention cost (the sum of
squared piece lengths). Pieces are dealt at random into blocks of bounded size; each
block is packed longest first, and a piece goes to the open sequence that fits it
under every constraint and scores best: the smallest weighted norm of what would
stay free, or the largest weighted dot product of piece and free room. Blocks are
drawn alike, so the loss is a few sequences a block; sequences that a block leaves
badly filled are packed once more together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otelframe.llm.common import documents, map_texts, materialize
from otelframe.llm.tokens import default_vocabulary, with_end

#: Pieces that one task packs together, about.
BLOCK_PIECES = 8_000
#: Bins of one fill, and further fills, that are scored before the best is taken, fuller ones
#: first; None scores all that fit.
SCORED_BINS, SCORED_FILLS = None, None


def cut(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids with the end id: doc_id, piece, start, length,
    ids_crc32 (and ids). Only documents longer than ``capacity`` are cut, into
    pieces of ``capacity``; the first one takes the rest. Null and empty texts are one
    piece of the end id, very long ones many pieces; null ids and repeated rows are rows
    like any other, and an empty table gives no pieces. Other columns are not read."""
    ddl = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, text in zip(batch["id"], batch["text"]):
            ids = with_end(vocabulary, text or "", end_id)
            first = len(ids) % capacity or capacity
            starts = [0, *range(first, len(ids), capacity)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                out["id"].append(doc)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[a:b]))
                if with_ids:
                    out["ids"].append(ids[a:b].tolist())
        return out

    return map_texts(docs, [F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")], ddl, rows)


def best_fit(
    lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm",
    scored_bins: int | None = SCORED_BINS, scored_fills: int | None = SCORED_FILLS,
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Pieces longer than ``capacity`` are an error; a
    piece that alone breaks the cost capacity gets a bin of its own."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    if scored_bins is None and scored_fills is None:
        return best_of_all(lengths, capacity, max_docs, max_cost, weights, rule)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    most_bins, most_fills = scored_bins or np.inf, np.inf if scored_fills is None else scored_fills
    free: list[list[int]] = []  # of each bin: tokens, documents, cost
    by_fill: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
    mask = 0  # bit r: some open bin has r free tokens
    wt, wd, wc = weights

    def score(b: int, size: int) -> float:
        t, d, c = free[b]
        if rule == "dot":
            return -(wt * size / capacity * t / capacity + wd / max_docs * d / max_docs + wc * size * size / max_cost * c / max_cost)
        return wt * ((t - size) / capacity) ** 2 + wd * ((d - 1) / max_docs) ** 2 + wc * ((c - size * size) / max_cost) ** 2

    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if size > capacity:
            raise ValueError(f"piece of {size} tokens exceeds {capacity}")
        cost, best, chosen, fills, rest = size * size, None, -1, 0, mask >> size
        # fills ascend, so the first bins are the fullest; beyond the scored ones the
        # search only goes on while nothing has fitted
        while rest and (chosen < 0 or fills <= most_fills):
            step = (rest & -rest).bit_length()
            fill = size + step - 1 if not fills else fill + step
            rest >>= step
            fills += 1
            for seen, b in enumerate(by_fill[fill]):
                if chosen >= 0 and seen >= most_bins:
                    break
                if free[b][2] >= cost and ((s := score(b, size)), b) < (best or (np.inf, 0)):
                    best, chosen = (s, b), b
        if chosen < 0:
            chosen = len(free)
            free.append([capacity, max_docs, max_cost])
        else:
            held = by_fill[free[chosen][0]]
            del held[chosen]
            if not held:
                mask &= ~(1 << free[chosen][0])
        room = free[chosen]
        bins[i], offsets[i] = chosen, capacity - room[0]
        room[0] -= size
        room[1] -= 1
        room[2] -= cost
        if room[0] > 0 and room[1] > 0 and room[2] > 0:
            by_fill[room[0]][chosen] = None
            mask |= 1 << room[0]
    return bins, offsets


def best_of_all(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """``best_fit`` over all open bins that fit, scored at once; of equal scores the first
    bin wins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    if len(lengths) and (longest := int(lengths.max())) > capacity:
        raise ValueError(f"piece of {longest} tokens exceeds {capacity}")
    room = np.empty((3, len(lengths)), np.int64)  # of each listed bin: tokens, documents, cost
    number = np.empty(len(lengths), np.int64)
    listed = opened = closed = 0
    wt, wd, wc = weights
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        cost = size * size
        t, d, c = room[:, :listed]
        fit = np.flatnonzero((t >= size) & (c >= cost))
        if len(fit):
            t, d, c = t[fit], d[fit], c[fit]
            if rule == "dot":
                score = -(wt * size / capacity * t / capacity + wd / max_docs * d / max_docs + wc * size * size / max_cost * c / max_cost)
            else:
                score = wt * ((t - size) / capacity) ** 2 + wd * ((d - 1) / max_docs) ** 2 + wc * ((c - cost) / max_cost) ** 2
            at = int(fit[np.argmin(score)])
        else:
            at, listed, opened = listed, listed + 1, opened + 1
            room[:, at], number[at] = (capacity, max_docs, max_cost), opened - 1
        bins[i], offsets[i] = number[at], capacity - room[0, at]
        room[:, at] -= (size, 1, cost)
        if room[:, at].min() <= 0:
            room[0, at] = -1  # takes no more
            closed += 1
            if closed > 64 and 2 * closed > listed:
                keep = np.flatnonzero(room[0, :listed] > 0)
                listed, closed = len(keep), 0
                room[:, :listed], number[:listed] = room[:, keep], number[keep]
    return bins, offsets


def _packed(pieces: DataFrame, capacity: int, max_docs: int, max_cost: int, **how) -> DataFrame:
    """Pieces with a column ``block`` get sequence_id, offset and fill."""

    def pack_block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id", "piece", "start", "ids_crc32"], ascending=False, kind="stable", na_position="first").reset_index(drop=True)
        bins, offsets = best_fit(part["length"].to_numpy(), capacity, max_docs, max_cost, **how)
        used = np.bincount(bins, weights=part["length"])
        return part.assign(sequence_id=part["block"] * (1 << 32) + bins, offset=offsets, fill=used[bins].astype("int64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.groupBy("block").applyInPandas(pack_block, f"{fields}, sequence_id long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = 1024, max_docs: int | None = None, max_cost: int | None = None, block_pieces: int = BLOCK_PIECES, **how) -> DataFrame:
    """Place pieces (id, piece, start, length, ids_crc32, ...) in sequences: adds
    sequence_id and offset (gapless from 0). ``how`` goes to ``best_fit``: weights, rule,
    scored_bins and scored_fills.

    Without ``max_docs`` and ``max_cost`` only tokens bind. Null ids, ties and
    repeated rows are pieces like any other. An empty table gives an empty result.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    pieces = materialize(pieces)
    blocks = max(1, -(-pieces.count() // block_pieces))
    # dealt by the place in the written table (its name has a random part, the number has not),
    # so that equal rows fall into all blocks and a second run packs alike
    row = F.xxhash64(F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1), "_metadata.row_index")
    dealt = pieces.withColumn("block", F.pmod(row, F.lit(blocks)))
    first = materialize(_packed(dealt, capacity, max_docs, max_cost, **how))
    loose = F.col("fill") < capacity * 49 // 50
    groups = max(1, -(-first.where(loose).count() // block_pieces))
    again = first.where(loose).withColumn("block", F.lit(blocks) + F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups))).drop("sequence_id", "offset", "fill")
    done = first.where(~loose).unionByName(_packed(again, capacity, max_docs, max_cost, **how))
    return done.drop("block", "fill")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(cut(docs, default_vocabulary("byte_bpe_50k.json"))).withColumnRenamed("id", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
