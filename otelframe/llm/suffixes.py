"""Removal of byte strings that earlier documents hold, with suffix arrays of shards.

Documents lie in blocks (about ``BLOCK`` bytes each). All strings of ``length`` bytes
("windows") are dealt to shards so that equal windows meet:

1. A window belongs to the least hash among its 16-byte grams. Neighbouring windows
   with one least gram travel as one *piece*: their bytes, once. Each block sends its
   sorted gram hashes, cut at the bounds of the ranges by binary search; a range answers
   with a bit for each hash that another document holds, or that is crowded.
2. Blocks send the pieces of such grams only. Equal pieces of a block go once, for its
   smallest document; pieces of a crowded gram go window by window, dealt by content.
3. A range drops equal pieces again, and cuts what is left, in the order of the grams,
   into shards of ``SHARD`` bytes. In each the windows are sorted by Larsson-Sadakane
   refinement (ranks of 5, 10, 20, ... bytes; only groups that are still together are
   sorted anew), and Kasai's common prefixes tell which neighbours agree in ``length``
   bytes. A gram that lies in several shards is merged over them by binary search in
   their sorted windows.
4. Covered windows go back to their blocks as spans, and the rest of each text is kept.

Every window is looked at, and decisions are made on bytes, never on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otelframe.llm.common import documents, materialize, release, text_or_empty

LENGTH = 50
#: Bytes of the grams by which windows are dealt.
GRAM = 16
#: Bytes of texts in a block (a longer text is a block of its own), and bytes worked on at a time.
BLOCK = 1 << 21
#: Windows in a piece at most.
PIECE = 256
#: Bytes of texts behind a range of hashes, and behind a range of pieces.
HASH_RANGE, PIECE_RANGE = 1 << 25, 1 << 23
#: Bytes under one suffix array: three ranks of 21 bits fit in a sort key.
SHARD = 1 << 20
#: Pieces of a gram in all blocks beyond which they go window by window.
CROWDED = 1 << 16
U = np.uint64


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position, most significant first; data is padded."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded.tobytes(), strides=(1,)).astype(U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each position of ``words`` but the last eight."""
    return _mixed(words[:-8] ^ (words[8:] * U(0x94D049BB133111EB)))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return h if done == width else np.minimum(h[: len(h) - (width - done)], h[width - done :])


def pieces_of(data: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram, document, start, windows) of the pieces of a block, in text order. Equal
    windows have equal grams; no piece leaves its document."""
    begins = np.cumsum(lengths) - lengths
    ends = begins + lengths
    grams, starts, counts = [], [], []
    for a in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[a : a + BLOCK + length - 1]
        least = _sliding_min(gram_hashes(_words(part))[: len(part) - GRAM + 1], length - GRAM + 1)
        n = len(least)
        # windows that would leave their document: the last length - 1 positions of each
        low, high = np.clip(np.maximum(ends - length + 1, begins) - a, 0, n), np.clip(ends - a, 0, n)
        outside = np.cumsum(np.bincount(low, minlength=n + 1)[:n] - np.bincount(high, minlength=n + 1)[:n]) > 0
        edges = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (outside[1:] != outside[:-1])]))
        sizes = np.diff(np.append(edges, n))
        inside = ~outside[edges]
        edges, sizes = edges[inside], sizes[inside]
        cuts = -(-sizes // PIECE)
        if len(cuts) and cuts.max() > 1:  # long runs of one gram (periodic text) in several pieces
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            edges, sizes = np.repeat(edges, cuts) + nth * PIECE, np.minimum(np.repeat(sizes, cuts) - nth * PIECE, PIECE)
        grams.append(least[edges])
        starts.append(edges + a)
        counts.append(sizes)
    if not grams:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    start = np.concatenate(starts)
    # grams are least hashes and so small ones: mixed again they fill the ranges evenly
    return _mixed(np.concatenate(grams)), np.searchsorted(begins, start, "right") - 1, start, np.concatenate(counts)


def range_bounds(n: int) -> np.ndarray:
    return np.array([k * (1 << 64) // n for k in range(1, n)], U)


def _groups(same: np.ndarray) -> np.ndarray:
    """Starts of runs, from whether each place but the first is like the one before."""
    return np.flatnonzero(np.concatenate([[True], ~same]))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the intervals, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64)
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def equal_pieces(data: np.ndarray, gram: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): pieces sorted by gram so that those with equal bytes stand together;
    where each group of equal ones begins in that order. Sums of gram hashes bring equal
    pieces together, their bytes decide."""
    if not len(gram):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([np.zeros(1, U), np.cumsum(gram_hashes(_words(data) if words is None else words), dtype=U)])
    last = np.minimum(start + size - GRAM + 1, len(total) - 1)
    sign = _mixed((total[last] - total[start]) ^ (size.astype(U) << U(40)))
    order = np.lexsort((sign, gram))
    a, b = order[:-1], order[1:]
    same = (gram[a] == gram[b]) & (sign[a] == sign[b]) & (size[a] == size[b])
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), 1 << 16):
        some = pairs[k : k + (1 << 16)]
        n = size[a[some]]
        differ = data[_spread(start[a[some]], n)] != data[_spread(start[b[some]], n)]
        same[some] = ~np.maximum.reduceat(differ, np.cumsum(n) - n)
    return order, _groups(same)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Positions ``starts``, sorted by the ``length`` bytes from each on.

    Larsson-Sadakane: ranks by h bytes are refined to 2h bytes by the rank h bytes on;
    groups of one position are done. The last step takes ``length - h`` instead of h, so
    that order ends with the window. At most 2**21 bytes."""
    n, mask = len(data), U((1 << 21) - 1)
    place = np.arange(n, dtype=U)
    keys = np.sort(((_words(data) >> U(24)) << U(21)) | place)
    h, rank = 5, np.zeros(n + length, U)

    def ranked(where: np.ndarray, fresh: np.ndarray, base: np.ndarray | int) -> np.ndarray:
        """Ranks are the places at which groups begin; returns the members of groups of several."""
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(where)))
        rank[where] = np.repeat(base[heads] if isinstance(base, np.ndarray) else heads, sizes)
        return where[np.repeat(sizes, sizes) > 1]

    where = (keys & mask).astype(np.int64)
    open_ = ranked(where, np.concatenate([[True], (keys[1:] >> U(21)) != (keys[:-1] >> U(21))]), 0)
    while 2 * h <= length and len(open_):
        keys = np.sort((rank[open_] << U(42)) | (rank[open_ + h] << U(21)) | open_.astype(U))
        where, both, group = (keys & mask).astype(np.int64), keys >> U(21), (keys >> U(42)).astype(np.int64)
        # a group's members stay on the places that it has: its rank and those that follow
        first = _groups(group[1:] == group[:-1])
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        open_ = ranked(where, np.concatenate([[True], both[1:] != both[:-1]]), group + nth)
        h *= 2
    keys = np.sort((rank[starts] << U(42)) | (rank[starts + max(0, length - h)] << U(21)) | starts.astype(U))
    return (keys & mask).astype(np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Common bytes of each window with the one before it in ``order``, ``length`` at most.

    Kasai: the window one byte on keeps all but one byte of its neighbour's common
    prefix, if that neighbour also goes on to a window before it. All pieces (``first``
    window and ``count`` of windows) are walked side by side."""
    words = _words(np.concatenate([data, np.zeros(length + 16, np.uint8)]))
    rank = np.full(len(data) + 1, -1, np.int64)
    rank[order] = np.arange(len(order))
    out = np.zeros(len(order), np.int64)
    by_count = np.argsort(-count, kind="stable")
    first, count = first[by_count], count[by_count]
    known, other = np.zeros(len(first), np.int64), np.full(len(first), -1, np.int64)
    for t in range(int(count[0]) if len(count) else 0):
        n = int(np.searchsorted(-count, -t, "left"))  # pieces with a window at offset t
        i = first[:n] + t
        r = rank[i]
        after = rank[other[:n] + 1]
        carried = np.where((other[:n] >= 0) & (after >= 0) & (after < r), np.maximum(known[:n] - 1, 0), 0)
        j = np.where(r > 0, order[np.maximum(r, 1) - 1], -1)
        going = np.flatnonzero(j >= 0)
        while len(going):
            x = words[i[going] + carried[going]] ^ words[j[going] + carried[going]]
            equal = np.where(x == 0, 8, sum((x < (U(1) << U(8 * k))).astype(np.int64) for k in range(1, 8)))
            carried[going] += equal
            going = going[(equal == 8) & (carried[going] < length)]
        carried[j < 0] = 0
        known[:n], other[:n] = np.minimum(carried, length), j
        out[r] = known[:n]
    return out


def _strings(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Windows as byte strings, which compare like their bytes."""
    return np.ascontiguousarray(data[starts[:, None] + np.arange(length)]).view(f"S{length}").ravel()


def _shard_minima(data: np.ndarray, gram: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int, merged: np.ndarray) -> tuple:
    """Windows of a shard in sorted order, the class of each and the smallest document of
    each class; for pieces of grams in ``merged`` also the classes' strings."""
    starts, of = _spread(first, count), np.repeat(np.arange(len(first)), count)
    order = suffix_order(data, starts, length)
    lcp = common_prefixes(data, order, first, count, length)
    owner = np.empty(len(data), np.int64)
    owner[starts] = of
    piece = owner[order]
    heads = _groups(lcp[1:] >= length)
    classes = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    least = np.minimum.reduceat(doc[piece], heads)
    shared = np.flatnonzero(np.isin(gram[piece[heads]], merged))
    return order, piece, classes, least, shared, _strings(data, order[heads[shared]], length)


def covered_windows(data: np.ndarray, gram: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the windows that a piece of a smaller document has too. Pieces
    are sorted by gram; those of a gram in several shards are merged by binary search."""
    size = count + length - 1
    number = (np.cumsum(size) - 1) // shard
    bounds = np.append(_groups(number[1:] == number[:-1]), len(gram)) if len(gram) else np.zeros(1, np.int64)
    merged = np.unique(gram[bounds[1:-1]][gram[bounds[1:-1] - 1] == gram[bounds[1:-1]]])
    shards, held, lows = [], None, None
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = data[_spread(start[a:b], size[a:b])]
        first = np.cumsum(size[a:b]) - size[a:b]
        order, piece, classes, least, shared, strings = _shard_minima(own, gram[a:b], first, count[a:b], doc[a:b], length, merged)
        shards.append((a, order - first[piece], piece, classes, least, shared, strings))
        if not len(strings):
            continue
        if held is None:
            held, lows = strings, least[shared]
            continue
        at = np.minimum(np.searchsorted(held, strings), len(held) - 1)
        known = held[at] == strings
        np.minimum.at(lows, at[known], least[shared][known])
        at = np.searchsorted(held, strings[~known])
        held, lows = np.insert(held, at, strings[~known]), np.insert(lows, at, least[shared][~known])
    pieces, offsets = [], []
    for a, offset, piece, classes, least, shared, strings in shards:
        if len(strings):
            least[shared] = lows[np.searchsorted(held, strings)]
        hit = least[classes] < doc[a + piece]
        pieces.append(piece[hit] + a)
        offsets.append(offset[hit])
    return (np.concatenate(pieces), np.concatenate(offsets)) if pieces else (np.zeros(0, np.int64),) * 2


def repeats_in(data: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to) of the spans of pieces that pieces of smaller documents cover."""
    start = np.cumsum(size) - size
    words = _words(data)
    hashes = gram_hashes(np.append(words, np.zeros(8, U)))
    hashes[_spread(start + size - GRAM + 1, np.full(len(size), GRAM - 1))] = ~U(0)  # grams that leave their piece
    gram = np.minimum.reduceat(hashes, start)
    order, heads = equal_pieces(data, gram, start, size, words)
    sizes = np.diff(np.append(heads, len(order)))
    low = np.minimum.reduceat(doc[order], heads)
    later = doc[order] > np.repeat(low, sizes)
    whole = order[later]  # an equal piece of a smaller document covers all of it
    # one piece stands for each group of equal ones; alone with its gram it needs no sorting
    lead, lead_gram = order[heads], gram[order[heads]]
    alone = np.diff(np.append(_groups(lead_gram[1:] == lead_gram[:-1]), len(lead)))
    mixed = np.flatnonzero(np.repeat(alone, alone) > 1)
    some = lead[mixed]
    piece, offset = covered_windows(data, gram[some], start[some], size[some] - length + 1, low[mixed], length, shard)
    at = np.lexsort((offset, piece))
    piece, offset = piece[at], offset[at]
    if len(piece):
        runs = _groups((piece[1:] == piece[:-1]) & (offset[1:] == offset[:-1] + 1))
        lasts = np.append(runs[1:], len(piece)) - 1
        group, begin, end = mixed[piece[runs]], offset[runs], offset[lasts] + length
        # spans hold for all pieces of the group's smallest document
        firsts = np.flatnonzero(~later)
        holders = np.bincount(np.repeat(np.arange(len(heads)), sizes)[firsts], minlength=len(heads))
        base = np.cumsum(holders) - holders
        times = holders[group]
        member = order[firsts[_spread(base[group], times)]]
        begin, end = np.repeat(begin, times), np.repeat(end, times)
    else:
        member = begin = end = np.zeros(0, np.int64)
    return np.concatenate([whole, member]), np.concatenate([np.zeros(len(whole), np.int64), begin]), np.concatenate([size[whole], end])


# --- Spark jobs -------------------------------------------------------------------

_I8 = np.dtype("<i8")
ZSTD = pa.Codec("zstd", 1)


def _packed(data: np.ndarray) -> bytes:
    return ZSTD.compress(data.tobytes(), asbytes=True) if len(data) else b""


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ZSTD.decompress(blob, n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)


def blocks_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Blocks of whole texts, written once: block, ids, orders (ids with nulls last),
    lengths and the bytes. A block's name is its place in the table that is written."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids, texts):
            data = np.frombuffer(b"".join(texts), np.uint8)
            lengths = np.array([len(t) for t in texts], _I8)
            orders = np.array([(1 << 63) - 1 if i is None else i for i in ids], _I8)
            return pa.RecordBatch.from_pydict({"ids": [ids], "orders": [orders.tobytes()], "lengths": [lengths.tobytes()], "n": [len(data)], "data": [_packed(data)]}, schema=schema)

        ids, texts, n = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                t = t.as_py()
                if texts and n + len(t) > BLOCK:
                    yield block(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(t)
                n += len(t)
        if texts:
            yield block(ids, texts)

    schema = pa.schema([("ids", pa.list_(pa.int64())), ("orders", pa.binary()), ("lengths", pa.binary()), ("n", pa.int64()), ("data", pa.binary())])
    made = source.mapInArrow(run, "ids array<long>, orders binary, lengths binary, n long, data binary")
    return materialize(made.select(F.expr("uuid()").alias("block"), "*"))


def _read_block(row: dict) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["orders"], _I8), np.frombuffer(row["lengths"], _I8), _unpacked(row["data"], row["n"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _block_grams(gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct grams of a block, pieces of each, and whether several documents have it."""
    order = np.argsort(gram, kind="stable")
    g, d = gram[order], doc[order]
    heads = _groups(g[1:] == g[:-1])
    return g[heads], np.diff(np.append(heads, len(g))), np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)


def _send_grams(length: int, ranges: int):
    bounds = range_bounds(ranges)
    schema = pa.schema([("range", pa.int32()), ("block", pa.string()), ("grams", pa.binary()), ("counts", pa.binary()), ("several", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            orders, lengths, data = _read_block(row)
            gram, doc, _, _ = pieces_of(data, lengths, length)
            if not len(gram):
                continue
            grams, counts, several = _block_grams(gram, orders[doc])
            cut = [0, *np.searchsorted(grams, bounds).tolist(), len(grams)]
            parts = [(k, a, b) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_pydict({
                "range": [k for k, _, _ in parts], "block": [row["block"]] * len(parts), "grams": [grams[a:b].tobytes() for _, a, b in parts],
                "counts": [counts[a:b].astype("<u4").tobytes() for _, a, b in parts], "several": [several[a:b].tobytes() for _, a, b in parts],
            }, schema=schema)

    return run


def _answer_grams(table: pa.Table) -> pa.Table:
    """For each block's grams of a range: 1 where another document holds the gram, 2 where it is crowded."""
    rows = table.to_pylist()
    grams = [np.frombuffer(r["grams"], "<u8") for r in rows]
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    heads = _groups(flat[order][1:] == flat[order][:-1])
    sizes = np.diff(np.append(heads, len(flat)))
    held = np.add.reduceat(np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64)[order], heads)
    several = np.maximum.reduceat(np.concatenate([np.frombuffer(r["several"], bool) for r in rows])[order], heads)
    kind = np.where(several | (sizes > 1), np.where(held > CROWDED, 2, 1), 0).astype(np.uint8)
    out = np.empty(len(flat), np.uint8)
    out[order] = np.repeat(kind, sizes)
    ends = np.cumsum([len(g) for g in grams])
    kinds = [out[e - len(g) : e].tobytes() for g, e in zip(grams, ends, strict=True)]
    return pa.table({"block": [r["block"] for r in rows], "range": [r["range"] for r in rows], "kinds": kinds}, schema=pa.schema([("block", pa.string()), ("range", pa.int32()), ("kinds", pa.binary())]))


_PIECES = pa.schema([("range", pa.int32()), ("block", pa.string()), ("size", pa.binary()), ("order", pa.binary()), ("start", pa.binary()), ("n", pa.int64()), ("data", pa.binary()), ("spans", pa.binary())])


def _send_pieces(length: int, ranges: int, gram_ranges: int):
    """Pieces of grams that several documents hold. Spans already known in the block (equal
    pieces, but for the smallest document's) go along."""
    bounds, gram_bounds = range_bounds(ranges), range_bounds(gram_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            orders, lengths, data = _read_block(row)
            gram, doc, start, count = pieces_of(data, lengths, length)
            if not len(gram):
                continue
            grams, _, _ = _block_grams(gram, orders[doc])
            kinds = np.zeros(len(grams), np.uint8)
            cut = [0, *np.searchsorted(grams, gram_bounds).tolist(), len(grams)]
            for answer in row["answers"]:
                kinds[cut[answer["range"]] : cut[answer["range"] + 1]] = np.frombuffer(answer["kinds"], np.uint8)
            kind = kinds[np.searchsorted(grams, gram)]
            wanted = np.flatnonzero(kind)
            if not len(wanted):
                continue
            gram, doc, start, count, kind = (x[wanted] for x in (gram, doc, start, count, kind))
            if (kind == 2).any():  # window by window
                times = np.where(kind == 2, count, 1)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                gram, doc, start, count, kind = (np.repeat(x, times) for x in (gram, doc, start, count, kind))
                start, count = start + np.where(kind == 2, nth, 0), np.where(kind == 2, 1, count)
            size, order = count + length - 1, orders[doc]
            place, heads = equal_pieces(data, gram, start, size)
            low = np.repeat(np.minimum.reduceat(order[place], heads), np.diff(np.append(heads, len(place))))
            later = place[order[place] > low]
            spans = np.stack([start[later], start[later] + size[later]]).astype(_I8).tobytes()
            sent = place[order[place] == low]
            gram, start, size, order, kind = (x[sent] for x in (gram, start, size, order, kind))
            deal = gram.copy()
            crowded = np.flatnonzero(kind == 2)
            if len(crowded):  # by all bytes of the window
                hashes = gram_hashes(_words(data))
                deal[crowded] = _mixed(np.add.reduce([hashes[start[crowded] + k] * U(2 * k + 1) for k in (*range(0, length - GRAM, GRAM), length - GRAM)]))
            at = np.argsort(deal, kind="stable")
            start, size, order = start[at], size[at], order[at]
            cut = [0, *np.searchsorted(deal[at], bounds).tolist(), len(at)]
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a == b:
                    continue
                own = data[_spread(start[a:b], size[a:b])]
                yield pa.RecordBatch.from_pydict({
                    "range": [k], "block": [row["block"]], "size": [size[a:b].astype("<u2").tobytes()], "order": [order[a:b].astype(_I8).tobytes()],
                    "start": [start[a:b].astype(_I8).tobytes()], "n": [len(own)], "data": [_packed(own)], "spans": [spans],
                }, schema=_PIECES)
                spans = b""

    return run


def _find_repeats(length: int):
    schema = pa.schema([("block", pa.string()), ("spans", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        size = [np.frombuffer(r["size"], "<u2").astype(np.int64) for r in rows]
        of = np.repeat(np.arange(len(rows)), [len(s) for s in size])
        start = np.concatenate([np.frombuffer(r["start"], _I8) for r in rows])
        piece, begin, end = repeats_in(np.concatenate([_unpacked(r["data"], r["n"]) for r in rows]), np.concatenate(size), np.concatenate([np.frombuffer(r["order"], _I8) for r in rows]), length)
        at = np.argsort(of[piece], kind="stable")
        piece, begin, end = piece[at], begin[at], end[at]
        cut = np.searchsorted(of[piece], np.arange(len(rows) + 1))
        spans = []
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            found = np.stack([start[piece[a:b]] + begin[a:b], start[piece[a:b]] + end[a:b]]).astype(_I8)
            known = np.frombuffer(rows[k]["spans"], _I8).reshape(2, -1)
            spans.append(np.concatenate([known, found], axis=1).tobytes())
        return pa.table({"block": [r["block"] for r in rows], "spans": spans}, schema=schema)

    return run


_KEPT = "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block without what its spans cover."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    for row in _rows(batches):
        _, lengths, data = _read_block(row)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        found = [np.frombuffer(blob, _I8).reshape(2, -1) for blob in row["found"] or []]
        begin, end = np.concatenate([np.zeros((2, 0), _I8), *found], axis=1)
        change = np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
        gone = np.cumsum(change[:-1]) > 0
        # edges of runs; a run also ends where its document does
        edge = np.concatenate([gone[:1], gone[1:] != gone[:-1], gone[-1:]]) if len(gone) else np.zeros(1, bool)
        inner = begins[(begins > 0) & (begins < len(data))]
        both = np.unique(inner[gone[inner] & gone[inner - 1]])
        cuts = np.sort(np.concatenate([np.flatnonzero(edge), np.repeat(both, 2)])).reshape(-1, 2)
        owner = np.searchsorted(begins, cuts[:, 0], "right") - 1
        counts = np.bincount(owner, minlength=len(lengths))
        local = cuts - begins[owner][:, None]
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(local[:, 0]), pa.array(local[:, 1])], fields=list(span)))
        kept = [data[b:e][~gone[b:e]].tobytes() for b, e in zip(begins, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(lengths), spans, pa.array(kept, pa.binary())], schema=schema)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, spans (start, end: removed bytes of the UTF-8 text), kept (binary) for
    each row: every byte goes that a string of ``length`` bytes (17 to 20,000) covers which
    also starts in a document with a smaller id.

    Strings are judged on the input. Null texts are empty. Rows with one id do not take from each other; null
    ids are the largest, and equal. Repeated rows each give a row. An empty table gives
    an empty result. Other columns are not read. Texts of any length are worked through
    two megabytes at a time; a row of that length is held by its task.
    """
    if not GRAM < length <= 20_000:
        raise ValueError(f"length must be between {GRAM + 1} and 20000")
    blocks = blocks_of(docs, id_column, text_column)
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gram_ranges, ranges = -(-total // HASH_RANGE) or 1, -(-total // PIECE_RANGE) or 1
    grams = blocks.select("block", "orders", "lengths", "n", "data").mapInArrow(_send_grams(length, gram_ranges), "range int, block string, grams binary, counts binary, several binary")
    answers = materialize(grams.groupBy("range").applyInArrow(_answer_grams, "block string, range int, kinds binary"))
    known = answers.groupBy("block").agg(F.collect_list(F.struct("range", "kinds")).alias("answers"))
    asked = blocks.join(known, "block").select("block", "orders", "lengths", "n", "data", "answers")
    pieces = asked.mapInArrow(_send_pieces(length, ranges, gram_ranges), "range int, block string, size binary, order binary, start binary, n long, data binary, spans binary")
    spans = materialize(pieces.groupBy("range").applyInArrow(_find_repeats(length), "block string, spans binary"))
    release(answers)
    found = spans.groupBy("block").agg(F.collect_list("spans").alias("found"))
    return blocks.join(found, "block", "left").select("block", "ids", "orders", "lengths", "n", "data", "found").mapInArrow(_keep_rest, _KEPT)


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: For small tables: a row for each window.
OP12_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select r, doc_id, p, substr(x, 2 * p + 1, 100) as s from (select *, unnest(range(0, greatest(0, length(x) // 2 - 49))) as p from d)),
h as (select r, p from (select r, p, doc_id, min(doc_id) over (partition by s) as least from w) where doc_id > least or (doc_id is null and least is not null)),
c as (select r, p, p + 50 as q, max(p + 50) over (partition by r order by p rows between unbounded preceding and 1 preceding) as before from h),
s as (select r, g, min(p) as a, max(q) as b from (select *, sum(case when before is null or p > before then 1 else 0 end) over (partition by r order by p) as g from c) group by r, g),
k as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as z from s),
t as (select r, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(d.x, 2 * z + 1, 2 * (a - z)), '' order by a) as head, max(b) as last from k join d using (r) group by r)
select d.doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(case when t.r is null then x else concat(head, substr(x, 2 * last + 1)) end)) as kept_sha256
from d left join t using (r)
"""
