"""Near-duplicate passages by compact windows.

A text is its sequence of 5-word shingles. For each of HASHES hash functions, all
subsequences are grouped by the place of their least hash: a node of the sequence's
Cartesian tree stands for every subsequence within its span that holds it, a compact
window. Passages have LEAST shingles or more, so only nodes with such a span matter,
and of a span only the stretches of LEAST shingles: a window is a run of their starts
[a, b] that share a least hash. Runs are what a sliding minimum over the hashes gives,
without building the rest of the tree; neighbouring nodes of equal hash are one window,
cut after LEAST starts.

Windows of several functions that overlap in a document are joined interval by interval:
each pair of functions of a group of four, the four together, and all eight name the
overlap by their hashes. Two stretches with similarity 0.8 share such a name with chance
0.9993. Documents that share a name are compared with the first one that has it, so a
passage in many documents takes as many comparisons. Documents that only hold a part of a
passage rarely stand first for all its names, as they would have to hold the least
shingles of both functions of every pair. What is met is verified: stretches of LEAST
shingles on the diagonal of the common shingle are compared as sets, and those with a
Jaccard similarity of 0.8 or more are joined into maximal passages.

In a family of variants of one passage the first holder of a name is rarely the variant
that is similar enough. All holders are aligned with it, though, so those that lie at one
cell of its places are compared with each other, as far as they have stretches that no
passage found so far contains (``neighbourhood``). A cell's values are counted in arrays, for
all its starts at once: the common shingles of two stretches are those that stand first in
both, exactly as in the verification. Each stretch is sought until one earlier document has it; cells
with many documents are dealt over several groups.

``exhaustive=True`` compares stretches still uncovered with all earlier holders of their
names, also those that the first holder has at another place. It takes a comparison for each
pair of such holders.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otelframe.llm import shingles
from otelframe.llm.common import dealt_anew, documents, map_texts, materialize, release

#: Words of the shortest passage, and its shingles.
WORDS = 50
LEAST = WORDS - shingles.WORDS + 1
#: Hash functions, in groups; the pairs of a group, the group, and all together are names.
HASHES, GROUP = 8, 4
#: Similarity as 80 of 100.
NEAR, WHOLE = 80, 100
#: Places that one word damages, and the longest run of places that is put back: an edit of
#: the first holder and one of the other may lie side by side.
DAMAGE = shingles.WORDS
LONGEST = 2 * DAMAGE
#: Documents at one first holder meet in cells of so many starts; beyond so many of them the
#: seekers of a cell are dealt over several groups.
CELL, SLICE = 32, 2048
PASSAGE = ["id", "copy", "source_id", "source_copy", "start_word", "end_word", "source_start"]
#: Stretches that travel are cut at multiples of this, so that few differ.
GRID = 64
#: Shingles that are taken at a time, and the bits that hold a place among them.
BLOCK, PLACE_BITS = 1 << 15, 20
_LAST = (1 << 63) - 1
NAMES = [t for g in range(0, HASHES, GROUP) for t in (*itertools.combinations(range(g, g + GROUP), 2), tuple(range(g, g + GROUP)))]
NAMES.append(tuple(range(HASHES)))


def sliding_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours along the last axis."""
    n, done = keys.shape[-1], 1
    while 2 * done <= width:
        keys = np.minimum(keys[..., :-done], keys[..., done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[..., : n - width + 1], keys[..., rest : rest + n - width + 1]) if rest else keys


def compact_windows(sequence: np.ndarray, owner: np.ndarray, least: int = LEAST) -> dict[str, np.ndarray]:
    """key (hash function and least hash), owner, a, b, c of all windows of sequences that
    stand one after the other in ``sequence``; ``owner`` ascends. Stretches that start
    in [a, b] have their least hash first at c (places in the whole)."""
    n = len(sequence)
    kinds = {"key": np.int64, "owner": owner.dtype, "a": np.int64, "b": np.int64, "c": np.int64}
    if n < least:
        return {k: np.empty(0, t) for k, t in kinds.items()}
    if n > 1 << PLACE_BITS:
        raise ValueError("cut the sequence first")
    low = np.uint64((1 << PLACE_BITS) - 1)
    factors = np.array([shingles.odd(j) for j in range(HASHES)], np.uint64)[:, None]
    hashes = sequence[None, :] * factors
    hashes ^= hashes >> np.uint64(32)
    # the place in the low bits: of equal hashes the first is the least, and is told
    least_of = sliding_minima((hashes & ~low) | np.arange(n, dtype=np.uint64), least)
    whole = owner[: n - least + 1] == owner[least - 1 :]
    border = np.concatenate(([True], owner[1 : n - least + 1] != owner[: n - least]))
    out: dict[str, list] = {k: [] for k in kinds}
    for j in range(HASHES):
        value = least_of[j] & ~low
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])) | border)
        ends = np.append(starts[1:], len(value)) - 1
        real = whole[starts]
        starts, ends = starts[real], ends[real]
        # a run ends where its last stretch would leave the document
        ends = np.minimum(ends, np.searchsorted(owner, owner[starts], "right") - least)
        # where the least hash repeats, a run may be long: parts have a c of their own
        parts = -(-(ends - starts + 1) // least)
        offset = least * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        starts, ends = np.repeat(starts, parts) + offset, np.repeat(ends, parts)
        c = (least_of[j][starts] & low).astype(np.int64)
        for k, v in (("key", (hashes[j][c] & ~np.uint64(HASHES - 1) | np.uint64(j)).view(np.int64)), ("owner", owner[starts]), ("a", starts), ("b", np.minimum(ends, starts + least - 1)), ("c", c)):
            out[k].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def blocks(texts: list, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of the texts, several at a time: shingles, the text each belongs to, and
    the place there of the first shingle of each text. Very long ones come in parts that
    overlap by a stretch."""
    held, size = [], 0

    def given() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = [len(s) for _, _, s in held]
        at = np.repeat(np.arange(len(held)), lengths)
        firsts = np.cumsum([0, *lengths[:-1]])
        return np.concatenate([s for _, _, s in held]), at, np.array([(k, first - place) for (k, place, _), first in zip(held, firsts)], np.int64)

    most = 1 << (PLACE_BITS - 1)
    for k, text in enumerate(texts):
        s = shingles.sequence(text)
        for place in range(0, max(1, len(s) - least + 1), most):
            part = s[place : place + most + least - 1]
            if len(part) >= least:
                held.append((k, place, part))
                size += len(part)
            if size >= BLOCK:
                yield given()
                held, size = [], 0
    if held:
        yield given()


def whole_copies(docs: DataFrame) -> DataFrame:
    """id, copy, source_id, source_copy, words: documents whose text an earlier one has."""
    who = F.struct("id", "copy")
    keyed = docs.select("id", "copy", F.xxhash64("text", F.octet_length("text")).alias("h"), "text")
    counted = map_texts(keyed, keyed.columns, "words int", lambda batch: {"words": [shingles.n_words(t) for t in batch["text"]]}, keep=("id", "copy", "h"))
    firsts = counted.groupBy("h").agg(F.min(who).alias("o"), F.max(who).alias("last"), F.max("words").alias("words")).where("o.id <> last.id or o.copy <> last.copy")
    firsts = firsts.select(dealt_anew("h").alias("h"), F.col("o.id").alias("source_id"), F.col("o.copy").alias("source_copy"), "words")
    return keyed.drop("text").join(firsts, "h").where("id <> source_id or copy <> source_copy").drop("h").distinct()


def windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """key, id, copy, a, b, c, told of the windows, places in the document. Of equal texts of a
    batch the first one counts, the others are copies. ``told`` is 0 where the batch has the
    key in one text only, 1 for the first window of another key and 2 for the rest of its windows."""
    kinds = {"key": np.int64, "id": np.int64, "copy": np.int64, "a": np.int32, "b": np.int32, "c": np.int32}

    def rows(batch: dict) -> dict:
        ids, copies = np.array(batch["id"], np.int64), np.array(batch["copy"], np.int64)
        order = np.lexsort((ids, copies))
        first_ones = np.sort(order[np.concatenate(([True], np.diff(copies[order]) != 0))[: len(order)]])
        ids, copies = ids[first_ones], copies[first_ones]
        out: dict[str, list] = {k: [np.empty(0, t)] for k, t in kinds.items()}
        for s, owner, first in blocks([batch["text"][k] for k in first_ones], least):
            w = compact_windows(s, owner, least)
            text, shift = first[w["owner"]].T
            for k, v in (("key", w["key"]), ("id", ids[text]), ("copy", copies[text]), *((k, w[k] - shift) for k in "abc")):
                out[k].append(v.astype(kinds[k]))
        made = {k: np.concatenate(v) for k, v in out.items()}
        return made | {"told": told_of(made["key"], made["copy"])}

    return map_texts(docs, ["id", "copy", "text"], "key long, id long, copy long, a int, b int, c int, told byte", rows)


def key_runs(key: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal keys, and whether it has several texts."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    if not len(starts):
        return starts, np.empty(0, bool)
    return starts, np.minimum.reduceat(copy, starts) < np.maximum.reduceat(copy, starts)


def told_of(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """0 for keys of one ``of`` only; for others 1 where the key comes first, and 2 elsewhere."""
    order = np.argsort(key, kind="stable")
    starts, several = key_runs(key[order], of[order])
    told = np.zeros(len(order), np.int8)
    told[order] = np.repeat(2 * several.astype(np.int8), np.diff(np.append(starts, len(order))))
    told[order[starts[several]]] = 1
    return told


def shared_windows(found: DataFrame) -> DataFrame:
    """key, id, copy, a, b, c: those of ``windows`` whose key two different texts or more have.
    Windows of a key meet in one task, but those that know it from their batch (``told`` 2) go anywhere."""
    placed = found.withColumn("place", F.when(F.col("told") == 2, F.xxhash64("id", "a", "key")).otherwise(F.col("key")))
    same = Window.partitionBy("place")
    told = placed.withColumns({"low": F.min("copy").over(same), "high": F.max("copy").over(same), "any": F.max("told").over(same)})
    return told.where("low < high or any > 0").select("key", "id", "copy", "a", "b", "c")


def overlaps(key: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """name, doc, a, b, c: maximal runs of starts on which all functions of an entry of
    NAMES have windows, named by their keys; c is the first function's."""
    out: dict[str, list] = {k: [np.empty(0, np.int64)] for k in ("name", "doc", "a", "b", "c")}
    if not len(key):
        return {k: v[0] for k, v in out.items()}
    # documents one after the other on one line, with room between them
    room = np.zeros(int(doc.max()) + 2, np.int64)
    np.maximum.at(room, doc + 1, b.astype(np.int64) + 2)
    base = np.cumsum(room)
    lo, hi = base[doc] + a, base[doc] + b
    function = key & (HASHES - 1)
    edges = np.unique(np.concatenate((lo, hi + 1)))
    known, place = np.zeros((HASHES, len(edges)), np.uint64), np.zeros((HASHES, len(edges)), np.int64)
    for j in range(HASHES):
        mine = np.flatnonzero(function == j)
        if not len(mine):
            continue
        mine = mine[np.argsort(lo[mine], kind="stable")]
        at = np.searchsorted(lo[mine], edges, "right") - 1
        inside = (at >= 0) & (edges <= hi[mine][np.maximum(at, 0)])
        known[j, inside] = key[mine][at[inside]].view(np.uint64)
        place[j, inside] = c[mine][at[inside]]
    for functions in NAMES:
        ok = (known[list(functions)] != 0).all(axis=0)
        name = np.zeros(len(edges), np.uint64)
        for j in functions:
            name = shingles.mix(name * np.uint64(shingles.odd(0)) + known[j])
        name[~ok] = 0
        at = place[functions[0]]
        starts = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (at[1:] != at[:-1]))))
        ends = np.append(starts[1:], len(name))
        keep = ok[starts]
        starts, ends = starts[keep], ends[keep]
        of = np.searchsorted(base, edges[starts], "right") - 1
        for k, v in (("name", name[starts].view(np.int64)), ("doc", of), ("a", edges[starts] - base[of]), ("b", edges[ends] - 1 - base[of]), ("c", at[starts])):
            out[k].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def named_overlaps(shared: DataFrame) -> DataFrame:
    """name, id, copy, a, b, c: the named overlaps of the windows of each document."""
    names = ["name", "id", "copy", "a", "b", "c"]

    def named(table: pa.Table, doc: np.ndarray) -> pa.RecordBatch:
        found = overlaps(table["key"].to_numpy(), doc, *(table[k].to_numpy().astype(np.int64) for k in "abc"))
        firsts = np.flatnonzero(np.diff(doc, prepend=-1))
        of = [table[k].to_numpy()[firsts][found["doc"]] for k in ("id", "copy")]
        return pa.RecordBatch.from_arrays([pa.array(found["name"]), *map(pa.array, of), *(pa.array(found[k], pa.int32()) for k in "abc")], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last document so far
        for batch in itertools.chain(batches, [None]):
            if not (held if batch is None else batch.num_rows):
                continue
            table = pa.Table.from_batches(held + ([batch] if batch else []))
            new = np.any([np.diff(table[k].to_numpy()) != 0 for k in ("id", "copy")], axis=0)
            doc = np.concatenate(([0], np.cumsum(new)))
            until = int(np.searchsorted(doc, doc[-1])) if batch else len(doc)
            held = table.slice(until).to_batches()
            if until:
                yield named(table.slice(0, until), doc[:until])

    return shared.repartition("id", "copy").sortWithinPartitions("id", "copy").mapInArrow(run, "name long, id long, copy long, a int, b int, c int")


def ranges(met: DataFrame) -> DataFrame:
    """Of entries that meet one of another document (id, copy, a, b, c; o_id, o_copy, o_c):
    one row for each pair and diagonal d, with the starts [a, b] that its entries span."""
    return met.groupBy("id", "copy", "o_id", "o_copy", (F.col("o_c") - F.col("c")).alias("d")).agg(F.min("a").alias("a"), F.max("b").alias("b"))


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, copy, x, y, part: the shingles (32 bits of each) of the places [x, y] in
    ``wanted``, as far as the document goes."""
    cuts = wanted.groupBy("id", "copy").agg(F.collect_set(F.struct("x", "y")).alias("cuts"))
    joined = docs.dropDuplicates(["id", "copy"]).join(cuts, ["id", "copy"])

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "copy", "x", "y", "part")}
        for doc, copy, text, cuts in zip(batch["id"], batch["copy"], batch["text"], batch["cuts"]):
            s = (shingles.sequence(text) >> np.uint64(32)).astype("<u4")
            for cut in cuts:
                for k, v in zip(out, (doc, copy, cut["x"], cut["y"], s[cut["x"] : cut["y"] + 1].tobytes())):
                    out[k].append(v)
        return out

    return map_texts(joined, ["id", "copy", "text", "cuts"], "id long, copy long, x int, y int, part binary", rows)


def _next_at(values: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value and place: the next place in ``other`` from there on that holds the
    value, or -1."""
    codes = np.sort((other.astype(np.uint64) << np.uint64(32)) | np.arange(len(other), dtype=np.uint64))
    found = np.searchsorted(codes, (values.astype(np.uint64) << np.uint64(32)) | np.maximum(at, 0).astype(np.uint64))
    code = codes[np.minimum(found, len(codes) - 1)]
    same = (found < len(codes)) & ((code >> np.uint64(32)) == values) & (at < len(other))
    return np.where(same, (code & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)


def _previous(values: np.ndarray) -> np.ndarray:
    """Place of the previous entry of equal value, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1, np.int64)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def similar_in(mine: list[np.ndarray], other: list[np.ndarray], d: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """pair, start: of each pair k the starts s for which the sets of mine[k][s : s + least]
    and other[k][s + d : s + d + least] have a Jaccard similarity of 0.8 or more. Each distinct
    entry of a set is counted for the range of s in which it stands first."""
    sizes, other_sizes = (np.array([len(v) for v in side], np.int64) for side in (mine, other))
    first = np.maximum(0, -d)
    last = np.minimum(sizes, other_sizes - d) - least
    room = np.maximum(last - first + 2, 0)
    room[last < first] = 0
    base, at_mine, at_other = (np.cumsum(v) - v for v in (room, sizes, other_sizes))
    if not room.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # p and q: the pair of each entry, i and j: its place there; entries of different pairs are different
    p, q = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), other_sizes)
    i, j = np.arange(len(p)) - at_mine[p], np.arange(len(q)) - at_other[q]
    entries = np.concatenate((*mine, *other)).astype(np.uint64) | np.concatenate((p, q)).astype(np.uint64) << np.uint64(32)
    codes = np.unique(entries, return_inverse=True)[1]
    codes_mine, codes_other = codes[: len(p)], codes[len(p) :]

    def before(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        previous = _previous(codes)
        return np.where(previous < 0, -1, previous - at)

    before_mine, before_other = before(codes_mine, at_mine[p]), before(codes_other, at_other[q])

    def counted(pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        lo, hi = np.maximum(lo, first[pair]), np.minimum(hi, last[pair])
        some = lo <= hi
        line = (base - first)[pair[some]]
        return np.cumsum(np.bincount(line + lo[some], minlength=room.sum()) - np.bincount(line + hi[some] + 1, minlength=room.sum()))

    n_mine = counted(p, np.maximum(i - least + 1, before_mine + 1), i)
    n_other = counted(q, np.maximum(j - least + 1, before_other + 1) - d[q], j - d[q])
    # of equal entries only those can both stand first of which one is the next after the other
    after = _next_at(codes_mine, codes_other, at_other[p] + np.maximum(i + d[p], 0))
    back = _next_at(codes_other, codes_mine, at_mine[q] + np.maximum(j - d[q] + 1, 0))
    x = np.concatenate((np.flatnonzero(after >= 0), back[back >= 0]))
    y = np.concatenate((after[after >= 0], np.flatnonzero(back >= 0)))
    lo = np.maximum(np.maximum(i[x] - least + 1, before_mine[x] + 1), np.maximum(j[y] - least + 1, before_other[y] + 1) - d[p[x]])
    common = counted(p[x], lo, np.minimum(i[x], j[y] - d[p[x]]))
    near = WHOLE * common >= NEAR * (n_mine + n_other - common)
    near[(base + room)[room > 0] - 1] = False  # the place after the last start
    found = np.flatnonzero(near)
    pair = np.repeat(np.arange(len(sizes)), room)[found]
    return pair, found - base[pair] + first[pair]


def similar_starts(mine: np.ndarray, other: np.ndarray, d: int, least: int = LEAST) -> np.ndarray:
    """The same for one pair."""
    return similar_in([mine], [other], np.array([d]), least)[1]


def joined_runs(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Unions [start, end) of stretches of ``least`` that begin at ``starts``."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > least)
    firsts, lasts = starts[np.concatenate(([0], breaks + 1))], starts[np.append(breaks, len(starts) - 1)] + least
    return list(zip(firsts.tolist(), lasts.tolist()))


def aligned(docs: DataFrame, pairs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (see ``ranges``) with the places of the cuts they need, and these cuts; both
    are written."""
    low = lambda c: F.expr(f"{c} div {GRID} * {GRID}").cast("int")
    high = lambda c: F.expr(f"({c} div {GRID} + 1) * {GRID} - 1").cast("int")
    pairs = pairs.withColumns({"x": F.greatest(F.lit(0), F.col("a") + F.col("d")), "y": F.greatest(F.lit(0), F.col("b") + F.col("d") + least - 1), "b": F.col("b") + least - 1})
    pairs = pairs.withColumns({"a": low("a"), "b": high("b"), "x": low("x"), "y": high("y"), "at": F.col("a"), "until": F.col("b") - least + 1})
    pairs = materialize(pairs)
    wanted = pairs.select("id", "copy", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("o_id").alias("id"), F.col("o_copy").alias("copy"), "x", "y"))
    return pairs, materialize(cut_out(docs, wanted))


def side_by_side(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` with the cuts of both documents."""
    mine = parts.select("id", "copy", F.col("x").alias("a"), F.col("y").alias("b"), F.col("part").alias("mine"))
    theirs = parts.select(F.col("id").alias("o_id"), F.col("copy").alias("o_copy"), "x", "y", F.col("part").alias("theirs"))
    return pairs.join(mine, ["id", "copy", "a", "b"]).join(theirs, ["o_id", "o_copy", "x", "y"])


def verified(pairs: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """id, copy, source_id, source_copy, start_word, end_word, source_start: the passages
    among ``pairs`` (see ``aligned``)."""
    both = side_by_side(pairs, parts)
    names = ["id", "copy", "o_id", "o_copy", "d", "a", "x", "at", "until", "mine", "theirs"]

    def rows(batch: dict) -> dict:
        doc, copy, o_id, o_copy, d, a, x, at, until = (np.array(batch[k], np.int64) for k in names[:-2])
        same, sets, ends = [], [], until.copy()
        for k, (mine, theirs) in enumerate(zip(batch["mine"], batch["theirs"])):
            first, n, there = 4 * (at[k] - a[k]), 4 * (until[k] - at[k] + least), 4 * (at[k] + d[k] - x[k])
            piece = mine[first : first + n]
            if there >= 0 and piece == theirs[there : there + n]:  # no need to look at sets
                ends[k] = at[k] + len(piece) // 4 - least
                same.append(k)
            else:
                sets.append(k)
        sets, same = np.array(sets, np.int64), np.array(same, np.int64)
        pair, start = similar_in(*([np.frombuffer(batch[k][i], "<u4") for i in sets] for k in ("mine", "theirs")), (d + a - x)[sets], least)
        pair = sets[pair]
        start = start + a[pair]
        inside = (start >= at[pair]) & (start <= until[pair])
        pair, start = pair[inside], start[inside]
        opens = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(start) > least)))[: len(pair)])
        closes = np.append(opens[1:], len(pair))[: len(opens)] - 1
        same = same[ends[same] >= at[same]]
        k = np.concatenate((pair[opens], same))
        start, end = np.concatenate((start[opens], at[same])), np.concatenate((start[closes], ends[same])) + least + shingles.WORDS - 1
        return dict(zip(PASSAGE, (doc[k], copy[k], o_id[k], o_copy[k], start, end, start + d[k])))

    return map_texts(both, names, "id long, copy long, source_id long, source_copy long, start_word int, end_word int, source_start int", rows, at_once=500)


def apart(pairs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """``pairs`` with ``cells`` and ``masks``: the cells of CELL places of the other document
    that hold starts in [at, until] of stretches that no passage of ``found`` contains, and
    these starts as bits; pairs without any are left out."""
    spans = found.groupBy("id", "copy").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    width, columns = least + shingles.WORDS - 1, pairs.columns

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            at, until, d = (batch.column(k).to_numpy().astype(np.int64) for k in ("at", "until", "d"))
            room = until - at + 2  # all starts of all pairs on one line
            base = np.cumsum(room) - room
            known = batch.column("spans")
            of = np.repeat(np.arange(len(at)), known.value_lengths().fill_null(0).to_numpy())
            start, end = (v.to_numpy().astype(np.int64) for v in known.flatten().flatten())
            lo, hi = np.maximum(start, at[of]), np.minimum(end - width, until[of])  # starts of stretches within the span
            some, line = lo <= hi, (base - at)[of]
            change = np.bincount((line + lo)[some], minlength=room.sum()) - np.bincount((line + hi + 1)[some], minlength=room.sum())
            open_ = np.cumsum(change) == 0
            open_[base + room - 1] = False
            s = np.flatnonzero(open_)
            pair = np.repeat(np.arange(len(at)), room)[s]
            place = s - base[pair] + at[pair] + d[pair]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(place // CELL) != 0)))[: len(s)])
            masks = np.add.reduceat(1 << place % CELL, first) if len(first) else place
            offsets = pa.array(np.searchsorted(pair[first], np.arange(len(at) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((place[first] // CELL, pa.int32()), (masks, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in columns), *lists], names=[*columns, "cells", "masks"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.join(spans, ["id", "copy"], "left").select(*columns, "spans").mapInArrow(free, f"{ddl}, cells array<int>, masks array<long>").where(F.size("cells") > 0)


def contents(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums up to each place of a hash of the value and the place: of any stretch, the
    difference of two of them tells the contents."""
    hashed = shingles.mix(values.astype(np.uint64) * np.uint64(shingles.odd(0)) + shingles.mix(place.astype(np.uint64) * np.uint64(shingles.odd(1))))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)))


def hood_keys(mine: np.ndarray, theirs: np.ndarray, place: int, first: int, last: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, start and role of the stretches of ``mine`` that start in [first, last], against
    the first holder's shingles ``theirs`` at the same places (the first of them is ``place``
    there). Role 0: holder and seeker share the key; 1: for holders; 2: for seekers."""
    keys, starts, roles = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int8)]
    differs = np.concatenate(([0], (mine != theirs).astype(np.int8), [0]))
    agree = np.concatenate(([0], np.cumsum(1 - differs[1:-1])))
    s = np.arange(first, last + 1)
    s = s[(3 * (agree[s + least] - agree[s]) >= least) & (agree[s + least] - agree[s] < least)]
    if not len(s):
        return keys[0], starts[0], roles[0]
    edges = np.flatnonzero(np.diff(differs))
    opens, ends = edges[::2], edges[1::2]  # runs [open, end) of places that differ
    at = place + np.arange(len(mine))
    own, head = contents(mine, at), contents(theirs, at)
    full = own[s + least] - own[s]

    def add(content: np.ndarray, of: np.ndarray, kind: int, where: int, *who: int) -> None:
        if not len(of):
            return
        key = shingles.mix(content + shingles.mix((place + of).astype(np.uint64) * np.uint64(shingles.odd(2)) + np.uint64(kind + 8 * where)))
        for role in who:
            keys.append(key)
            starts.append(of)
            roles.append(np.full(len(of), role, np.int8))

    add(full, s, 0, 0, 0)  # as it is
    add(full, s, 1, 0, 2)  # as some other is with a run put back
    back = head - own
    # what differs at the ends of a stretch is put back at once
    many = len(opens) - 1
    k = np.minimum(np.searchsorted(ends, s, "right"), many)
    lead = np.where((opens[k] <= s) & (ends[k] > s), np.minimum(ends[k], s + least), s)
    k = np.minimum(np.searchsorted(ends, s + least - 1, "right"), many)
    trail = np.where((opens[k] < s + least) & (ends[k] >= s + least), np.maximum(opens[k], s), s + least)
    inner = full + (back[lead] - back[s]) + (back[s + least] - back[trail])
    short = lead - s + s + least - trail <= LONGEST
    add(inner[short], s[short], 4, 0, 0)
    for o, e in zip(opens.tolist(), ends.tolist()):
        of = s[(3 * (o - s) >= least) & (o < s + least)]
        add(own[o : o + 1] - own[of], of, 5, place + o, 0)
        of = s[(e > s) & (3 * (s + least - e) >= least)]
        add(own[of + least] - own[e : e + 1], of, 6, place + e, 0)
        if e - o > LONGEST:
            continue
        inside = (s < o) & (e < s + least)
        put, of = full[inside] + (back[e : e + 1] - back[o : o + 1]), s[inside]
        add(put, of, 0, 0, 2)
        add(put, of, 1, 0, 1)
        add(put, of, 2, place + o, 0)
        add(put, of, 3, place + e, 0)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(roles)


def distinct_members(rows: Iterator[tuple[int, int, int, int, int, bytes]]) -> list[tuple[int, int, int, int, int, bytes]]:
    """Members of a cell (see ``compared_cells``) without those that seek nothing and have the
    contents of an earlier member at the same place: what these would cover, that one has
    covered before. So a hot cell of copies takes no more memory than its different
    contents and its seekers."""
    seen: set[tuple[int, bytes]] = set()
    kept = []
    for r in rows:
        content = (r[2], r[5])
        if r[4] or content not in seen:
            kept.append(r)
        seen.add(content)
    return kept


def compared(rows: list[tuple[int, int, int, int, int, bytes]], least: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """``compared_cells`` of one cell."""
    return compared_cells([rows], least)


def compared_cells(cells: list[list[tuple[int, int, int, int, int, bytes]]], least: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """Passages (as ``verified`` gives them) among the members of each cell, for the starts that
    are sought. Members are id, copy, place (in the cell, of the first shingle), start (its
    place in the document), mask (starts sought) and part, by id and copy. A member is
    compared with the earlier documents, first ones first, until its starts are covered:
    with 8 at once, then 16, and so on, for all members of all cells."""
    rows = [r for cell in cells for r in cell]
    members = np.array([len(cell) for cell in cells])
    cell = np.repeat(np.arange(len(cells)), members)
    begin = (np.cumsum(members) - members)[cell]
    until = begin.copy()  # members before it are of earlier documents
    for i, r in enumerate(rows):
        until[i] = until[i - 1] if i > begin[i] and rows[i - 1][:2] == r[:2] else i
    shift, sought = np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
    values = [np.frombuffer(r[5], "<u4") for r in rows]
    lengths = np.array([len(v) for v in values])
    entry = np.cumsum(lengths) - lengths  # the first entry of each member
    member = np.repeat(np.arange(len(rows)), lengths)
    at = np.arange(len(member)) - entry[member] + shift[member]
    distinct, codes = np.unique(np.concatenate(values).astype(np.uint64) | cell[member].astype(np.uint64) << np.uint64(32), return_inverse=True)
    edges = np.searchsorted(distinct, np.arange(len(cells) + 1, dtype=np.uint64) << np.uint64(32))
    kinds = np.diff(edges)[cell]  # values of the member's cell, and the code of no value
    own = codes - edges[cell[member]]
    width, s = CELL + least - 1, np.arange(CELL)
    place = np.arange(width)
    table = np.repeat(kinds.astype(np.int32), width).reshape(-1, width)
    table[member, at] = own
    before = np.full((len(rows), width), width, np.int16)  # place of the previous equal one
    previous = _previous(codes + member * len(distinct))
    before[member, at] = np.where(previous < 0, -1, at[previous])

    def counted(of: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
        """For each of n rows and each start, how many [lo, hi] of the row hold it."""
        some = lo <= hi
        of = (of * (CELL + 1))[some]
        change = np.bincount(of + lo[some], minlength=n * (CELL + 1)) - np.bincount(of + hi[some] + 1, minlength=n * (CELL + 1))
        return np.cumsum(change.reshape(-1, CELL + 1), axis=1)[:, :CELL]

    sizes = counted(member, np.maximum(at - least + 1, before[member, at] + 1), np.minimum(at, CELL - 1), len(rows))
    whole = (shift[:, None] <= s) & (s <= (shift + lengths - least)[:, None])
    bits, few = 1 << s, -(-NEAR * least // WHOLE)  # of the larger set, where no value repeats
    seekers = np.flatnonzero((sought != 0) & (until > begin))
    # so many seekers at once that what is known of their values, and their pairs, stay small
    load = np.cumsum(np.maximum((kinds + 1)[seekers] >> 5, (until - begin)[seekers]))
    for some in np.split(seekers, np.flatnonzero(np.diff(load >> 15)) + 1):
        known = np.cumsum((kinds + 1)[some]) - (kinds + 1)[some]
        low, high = np.full((kinds + 1)[some].sum(), 2 * width), np.full((kinds + 1)[some].sum(), -1)
        seeker = np.repeat(np.arange(len(some)), lengths[some])
        mine = np.arange(len(seeker)) - (np.cumsum(lengths[some]) - lengths[some] - entry[some])[seeker]
        key = known[seeker] + own[mine]
        low[key[::-1]], high[key] = at[mine][::-1], at[mine]  # first and last place of each value
        plain = np.bincount(seeker, low[key] != high[key], len(some)) == 0
        n = (until - begin)[some]
        k = np.repeat(np.arange(len(some)), n)
        j = np.arange(len(k)) - (np.cumsum(n) - n - begin[some])[k]
        alike = [(high[known[k[x : x + 4096], None] + table[j[x : x + 4096]]] >= 0).sum(axis=1) >= few for x in range(0, len(k), 4096)]
        chosen = np.flatnonzero(np.concatenate(alike)) if alike else np.empty(0, np.int64)
        k, j = k[chosen], j[chosen]
        turn = np.arange(len(k)) - np.searchsorted(k, k)
        done, take = 0, 8
        while len(k):
            now = np.flatnonzero(turn < done + take)
            for x in range(0, len(now), 4096):
                a, b = k[now[x : x + 4096]], j[now[x : x + 4096]]
                i = some[a]
                # each value of the others counts for the starts of which it stands first in the
                # stretch, and mine from its first place to its last one: none too few
                where = known[a, None] + table[b]
                lo = np.maximum(np.maximum(low[where], place) - least + 1, np.maximum(before[b] + 1, 0))
                common = counted(np.repeat(np.arange(len(a)), width).reshape(-1, width), lo, np.minimum(np.minimum(high[where], place), CELL - 1), len(a))
                near = ((WHOLE * common >= NEAR * (sizes[i] + sizes[b] - common)) & whole[b] & whole[i]) @ bits
                hits = np.flatnonzero(near & sought[i])
                rough = hits[~plain[a[hits]]]
                if len(rough):  # where a value of mine repeats, it may lie between its places
                    pair, start = similar_in([values[y] for y in i[rough]], [values[y] for y in b[rough]], shift[i[rough]] - shift[b[rough]], least)
                    near[rough] = 0
                    np.add.at(near, rough[pair], bits[start + shift[i[rough[pair]]]])
                for y, o, covered in zip(i[hits].tolist(), b[hits].tolist(), near[hits].tolist()):
                    if not covered & int(sought[y]):
                        continue
                    sought[y] &= ~covered
                    (doc, copy, _, start), (o_doc, o_copy, _, o_start) = rows[y][:4], rows[o][:4]
                    for first, end in joined_runs(np.flatnonzero(covered >> s & 1), least):
                        yield doc, copy, o_doc, o_copy, start + first - int(shift[y]), start + end - int(shift[y]) + shingles.WORDS - 1, o_start + first - int(shift[o])
            left = np.flatnonzero((turn >= done + take) & (sought[some[k]] != 0))
            k, j, turn = k[left], j[left], turn[left]
            done, take = done + take, 2 * take


def neighbourhood(pairs: DataFrame, parts: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Passages (as ``verified`` gives them) of stretches that no passage of ``found`` contains.
    ``pairs`` are aligned with the first holders of their names. Documents that lie at one
    cell of a first holder are compared with each other, where one of them seeks."""
    pair, group = ["id", "copy", "o_id", "o_copy", "d"], ["o_id", "o_copy", "cell"]
    seeking = materialize(apart(pairs.select(*pair, "at", "until"), found, least))
    cell = lambda c: F.floor((F.col(c) + F.col("d")) / CELL).cast("int")
    sought = seeking.select("o_id", "o_copy", F.explode("cells").alias("cell")).distinct()
    spread = pairs.select(*pair, F.explode(F.sequence(cell("at"), cell("until"))).alias("cell"))
    several = spread.join(sought, group, "left_semi").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("n > 1")
    celled = several.groupBy(*pair).agg(F.collect_list(F.struct("cell", "n")).alias("among"))
    mine = parts.select("id", "copy", F.col("x").alias("a"), F.col("y").alias("b"), F.col("part").alias("mine"))
    joined = pairs.select(*pair, "a", "b", "at", "until").join(celled, pair).join(seeking.select(*pair, "cells", "masks"), pair, "left").join(mine, ["id", "copy", "a", "b"])
    names = [*pair, "a", "at", "until", "among", "cells", "masks", "mine"]
    member = "o_id long, o_copy long, cell int, slice int, id long, copy long, place int, start int, mask long, part binary"

    def members(batch: dict) -> dict:
        out: dict[str, list] = {p.split()[0]: [] for p in member.split(", ")}
        for doc, copy, o_id, o_copy, d, a, at, until, among, cells, masks, mine in zip(*(batch[k] for k in names)):
            mask = dict(zip(cells or (), masks or ()))
            for c, n in ((x["cell"], x["n"]) for x in among):
                lo, hi = max(at, c * CELL - d), min(until, c * CELL + CELL - 1 - d, a + len(mine) // 4 - least)
                if hi < lo:
                    continue
                part = mine[4 * (lo - a) : 4 * (hi - a + least)]
                slices = -(-n // SLICE)  # a hot cell's seekers are dealt, its holders are in all slices
                for k in range(slices):
                    for column, v in zip(out.values(), (o_id, o_copy, c, k, doc, copy, lo + d - c * CELL, lo, mask.get(c, 0) if k == copy % slices else 0, part)):
                        column.append(v)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in PASSAGE]

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k.endswith(("id", "copy")) else pa.int32()) for k, v in zip(PASSAGE, out)], names=PASSAGE)
            for v in out:
                v.clear()
            return batch

        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        cells, n = [], 0
        for _, held in itertools.chain(itertools.groupby(rows, key=lambda r: r[:4]), [(None, ())]):
            held = distinct_members(r[4:] for r in held)
            if len(held) > 1 and any(r[4] for r in held):
                cells.append(held)
                n += len(held)
            if cells and (n >= 512 or not held):
                for row in compared_cells(cells, least):
                    for column, v in zip(out, row):
                        column.append(v)
                cells, n = [], 0
            if len(out[0]) >= 10_000:
                yield given()
        yield given()

    dealt = map_texts(joined, names, member, members, at_once=500).repartition(*group, "slice").sortWithinPartitions(*group, "slice", "id", "copy", "start")
    return dealt.mapInArrow(run, "id long, copy long, source_id long, source_copy long, start_word int, end_word int, source_start int")


def merged(found: DataFrame) -> DataFrame:
    """Passages of one document and source that overlap or touch become one."""
    pair = Window.partitionBy("id", "copy", "source_id", "source_copy").orderBy("start_word", "end_word", "source_start")
    reach = F.max("end_word").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("opens", F.coalesce((F.col("start_word") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("run", F.sum("opens").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "copy", "source_id", "source_copy", "run").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.expr("min_by(source_start, struct(start_word, source_start))").alias("source_start")
    )


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, exhaustive: bool = False) -> DataFrame:
    """id, source_id, start_word, end_word (exclusive), source_start: passages of 50 words
    or more that a document shares, at a similarity of 0.8, with an earlier one.

    Documents are ordered by id, null ids last. Rows that repeat an id and a text are one
    document; rows that repeat an id with other texts are documents of their own, ordered
    by a hash of the text, and their passages carry the same id. Of equal texts all but the
    first are one passage each, with the first as source. Null and short texts have
    no passages. Repeats inside one document are not reported. Other columns are not read;
    an empty table gives an empty result. ``exhaustive`` is explained above.
    """
    text = F.col(text_column)
    docs = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text")).where("text is not null")
    # copies of a whole text are told at once, and only its first document goes on
    copies = materialize(whole_copies(docs).where(F.col("words") >= least + shingles.WORDS - 1))
    shared = materialize(shared_windows(windows(docs, least)).join(copies.select("id", "copy").hint("shuffle_hash"), ["id", "copy"], "left_anti"))
    entries = materialize(named_overlaps(shared))
    release(shared)
    who = F.struct("id", "copy")
    heads = entries.groupBy("name").agg(F.min(F.struct("id", "copy", "a", "c")).alias("o"), F.max(who).alias("last")).where("o.id <> last.id or o.copy <> last.copy")
    heads = heads.select(dealt_anew("name").alias("name"), F.col("o.id").alias("o_id"), F.col("o.copy").alias("o_copy"), F.col("o.c").alias("o_c"))
    later = entries.join(heads, "name").where("id <> o_id or copy <> o_copy")
    if exhaustive:
        later = materialize(later)
    pairs, parts = aligned(docs, ranges(later), least)
    found = materialize(verified(pairs, parts, least))
    if not exhaustive:
        release(entries)
    near = materialize(neighbourhood(pairs, parts, found, least))
    release(pairs, parts)
    found = found.unionByName(near)
    if exhaustive:
        found = materialize(found)
        known = found.groupBy("id", "copy").agg(F.collect_set(F.struct("start_word", (F.col("end_word") - shingles.WORDS).alias("last"))).alias("known"))
        covered = F.coalesce(F.exists("known", lambda p: (p["start_word"] <= F.col("a")) & (F.col("b") + least - 1 <= p["last"])), F.lit(False))
        left = materialize(later.join(known, ["id", "copy"], "left").where(~covered).select("name", "id", "copy", "a", "b", "c"))
        holders = entries.select("name", F.col("id").alias("o_id"), F.col("copy").alias("o_copy"), F.col("c").alias("o_c"))
        earlier = F.struct("o_id", "o_copy") < who
        found = found.unionByName(verified(*aligned(docs, ranges(left.join(holders, "name").where(earlier)), least), least))
    whole = copies.select("id", "copy", "source_id", "source_copy", F.lit(0).alias("start_word"), F.col("words").alias("end_word"), F.lit(0).alias("source_start"))
    done = merged(found).drop("run").unionByName(whole).select(F.nullif("id", F.lit(_LAST)).alias(id_column), F.nullif("source_id", F.lit(_LAST)).alias("source_id"), "start_word", "end_word", "source_start")
    return done


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = repeated_passages(documents(spark, sf_dir)).withColumnRenamed("source_id", "source_doc_id")
    return done.withColumn("n_words", F.col("end_word") - F.col("start_word"))
