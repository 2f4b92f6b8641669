"""Line dedup by winnowing.

Every window of ``run`` consecutive lines selects the line with the least hash (the
last of equal ones): windows with equal lines select equal lines, so a repeated run
of ``run`` lines or more always shares a fingerprint. Shorter runs that hold enough
words, and whole documents of fewer lines, are windows of their own and their own
fingerprints. Fingerprints that occur once end there. Around the others, matches are extended both ways: each window that an
anchor line stands for is compared as a whole, and windows found earlier elsewhere
join into maximal repeated runs. Lines of such runs are deleted; the first
occurrence of a line in the corpus, by id and position, always stays.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otelframe.llm.common import documents, map_texts, materialize

#: Lines of the shortest run that counts.
RUN = 3
#: Words that make a shorter run count.
WORDS = 50
_LAST = (1 << 63) - 1


def shorter(split: list[bytes], run: int, words: int) -> list[tuple[int, int]]:
    """(at, size) of the windows of fewer than ``run`` lines that count."""
    count = [len(x.split()) for x in split]
    sums = np.concatenate(([0], np.cumsum(count)))
    found = [(at, size) for size in range(1, min(run - 1, len(split)) + 1) for at in np.flatnonzero(sums[size:] - sums[:-size] >= words).tolist()]
    if len(split) < run and 0 < sums[-1] < words:
        found.append((0, len(split)))
    return found


def windows(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """One row per window of ``run`` lines: id, copy (hash of the text), lines, at, size
    (its lines), anchor (hash of the selected line), fresh (not the anchor of the window
    before), content (128-bit hash of the lines). With ``words``, also one per shorter
    window of so many words, and one per document of fewer lines that has a word."""
    ddl = "id long, copy long, lines int, at int, size int, anchor long, fresh boolean, content binary"

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {p.split()[0]: [] for p in ddl.split(", ")}
        for doc, copy, text in zip(batch["id"], batch["copy"], batch["text"]):
            split = text.encode().split(b"\n")
            digests = [xxhash.xxh3_128_digest(x) for x in split]
            for at, size in shorter(split, run, words) if words is not None else ():
                content = xxhash.xxh3_128_digest(b"".join(digests[at : at + size]))
                for k, v in zip(out, (doc, copy, len(digests), at, size, int.from_bytes(content[:8], "little", signed=True), True, content)):
                    out[k].append(v)
            n = len(digests) - run + 1
            if n < 1:
                continue
            h = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], np.int64)
            frame = np.lib.stride_tricks.sliding_window_view(h[::-1], run)[::-1]  # reversed: argmin takes the last
            chosen = np.arange(n) + run - 1 - frame.argmin(axis=1)
            out["id"] += [doc] * n
            out["copy"] += [copy] * n
            out["lines"] += [len(digests)] * n
            out["at"] += range(n)
            out["size"] += [run] * n
            out["anchor"] += h[chosen].tolist()
            out["fresh"] += [True, *(chosen[1:] != chosen[:-1]).tolist()]
            out["content"] += [xxhash.xxh3_128_digest(b"".join(digests[i : i + run])) for i in range(n)]
        return out

    text = F.col("text")
    return map_texts(docs.where(text.isNotNull()), [F.coalesce(F.col("id"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text")], ddl, rows)


def kept_runs(covered: DataFrame) -> DataFrame:
    """id, copy, lines, removed, kept: runs of lines that stay, of rows with the array
    ``deleted`` of line numbers."""

    def rows(batch: dict) -> dict:
        kept = []
        for at, n in zip(batch["deleted"], batch["lines"]):
            stays = np.ones(n, np.int8)
            stays[np.asarray(at, np.int64)] = 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], stays, [0]))))
            kept.append([{"first": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
        return {"removed": [len(at) for at in batch["deleted"]], "kept": kept} | {k: batch[k] for k in ("id", "copy", "lines")}

    return map_texts(covered, ["id", "copy", "lines", "deleted"], "id long, copy long, lines int, removed int, kept array<struct<first: int, n: int>>", rows)


def repeated_lines(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """Documents with repeated runs: id, copy, lines, kept (runs that stay), removed."""
    table = materialize(windows(docs, run, words))
    # a second key (of hashes) makes Spark deal both sides anew, so that it can split a hot group
    repeated = table.groupBy("anchor").agg(F.count_if("fresh").alias("n")).where("n > 1").select("anchor", F.xxhash64("anchor").alias("deal"))
    matched = materialize(table.withColumn("deal", F.xxhash64("anchor")).join(repeated, ["deal", "anchor"], "left_semi").drop("deal"))
    place = F.struct("id", "copy", "at")
    first = matched.groupBy("content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("content", "first", F.xxhash64("content").alias("deal"))
    later = matched.withColumn("deal", F.xxhash64("content")).join(first, ["deal", "content"]).where(place > F.col("first"))
    covered = later.select("id", "copy", "lines", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("line"))
    by_doc = covered.groupBy("id", "copy").agg(F.first("lines").alias("lines"), F.collect_set("line").alias("deleted"))
    return kept_runs(by_doc)


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of ``text``, plus ``lines`` and
    ``removed`` (numbers of lines) in a struct column ``_dedup``.

    A run counts from ``run`` lines on, from ``words`` words on, or if it is a whole
    document (of one word at least); ``words=None`` leaves only the first rule. Words
    are parted by ASCII space. Lines end at a newline. Null texts stay null and have no lines; an empty text is
    one empty line. Documents are ordered by id, null ids last; rows that repeat both
    id and text are one document and share its first occurrence. A document whose
    lines all repeat gets an empty text. All columns are kept; an empty table gives
    an empty result.
    """
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    found = repeated_lines(boxed.select("id", "text"), run, words).withColumnRenamed("id", "r_id").withColumnRenamed("copy", "r_copy").withColumnRenamed("lines", "r_lines")
    keyed = boxed.withColumn("key", F.coalesce(F.col("id"), F.lit(_LAST))).withColumn("copy", F.xxhash64("text"))
    joined = keyed.join(found, (F.col("key") == F.col("r_id")) & (F.col("copy") == F.col("r_copy")), "left")
    rest = F.array_join(F.flatten(F.transform("kept", lambda r: F.slice(F.split("text", "\n", -1), r["first"] + 1, r["n"]))), "\n")
    cleaned = F.when(F.col("kept").isNull(), F.col("text")).otherwise(rest)
    lines = F.coalesce("r_lines", F.size(F.split("text", "\n", -1)))
    info = F.struct(F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("lines"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))
    return joined.select(*[cleaned.alias(c) if c == text_column else F.col("_row").getField(c).alias(c) for c in names], info.alias("_dedup"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(line_dedup(documents(spark, sf_dir), words=None))


def op8_line_dedup_short(spark, sf_dir: str) -> DataFrame:
    return digests(line_dedup(documents(spark, sf_dir)))


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", F.col("_dedup.lines").alias("n_lines"), F.col("_dedup.removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = f"""
with lines as (
  select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
  from documents where text is not null),
win as (
  select doc_id, pos, line || chr(10) || lead(line, 1) over w || chr(10) || lead(line, 2) over w as content
  from lines window w as (partition by doc_id order by pos)),
marked as (
  select doc_id, pos, content is not null and
         row_number() over (partition by content order by coalesce(doc_id, {_LAST}), pos) > 1 as later
  from win),
fate as (
  select l.doc_id, l.pos, l.line,
         coalesce(bool_or(m.later) over (partition by l.doc_id order by l.pos rows between 2 preceding and current row), false) as gone
  from lines l join marked m on l.doc_id = m.doc_id and l.pos = m.pos),
done as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
  from fate group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join done using (doc_id)
"""

# the same with windows of one to three lines, and whole documents of fewer
OP8_SHORT_SQL = rf"""
with lines as (
  select doc_id, count(*) over (partition by doc_id) as n, pos, line, len(regexp_extract_all(line, '[^ \t\n\x0b\f\r]+')) as words
  from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
        from documents where text is not null)),
win as (
  select doc_id, n, pos, size, string_agg(line, chr(10)) over w as content, count(*) over w as have, sum(words) over w as words
  from lines, (select unnest([1, 2, 3]) as size)
  window w as (partition by doc_id, size order by pos rows between current row and size - 1 following)),
marked as (
  select doc_id, pos, size, row_number() over (partition by size, content order by coalesce(doc_id, {_LAST}), pos) > 1 as later
  from win where have = size and (size = 3 or words >= 50 or (n = size and words > 0))),
gone as (select distinct doc_id, pos + unnest(range(size)) as pos from marked where later),
done as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed, coalesce(string_agg(line, chr(10) order by l.pos) filter (where g.pos is null), '') as kept
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join done using (doc_id)
"""
