"""Fill-in-middle transformation by secondary sort.

Each text is cut, at two lines that its id draws, into prefix, middle and suffix, and
leaves its task as pieces: header, marks and chunks of whole lines, keyed by document
and place in the output. One shuffle deals the documents and sorts the pieces inside
each partition by document and place, so that a task streams them into a running
digest and never holds a document. The same task then sends every piece on under its
place in the original, which it reads off the output's marks and form alone; a second
sort inside the partition (no shuffle) puts the text together again for its own digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from otelframe.llm.common import documents, text_or_empty

# Marks of the parts, in the order of the original text.
PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
#: Characters in a piece.
CHUNK = 1 << 15
#: Place of the first piece of each part in the original.
PART = 1 << 40
#: Bytes that leave a task at a time.
AT_ONCE = 1 << 22


def line_count(text: str) -> int:
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def after_lines(text: str, n: int) -> int:
    """Where the first n lines end."""
    return len(text) - len(text.split("\n", n)[n]) if text.count("\n") >= n else len(text)


def layout(key: str, text: str, seed: int, fim: int, spm: int) -> tuple[str, int, int, int]:
    """(form, lines, end of the prefix, end of the middle). The first four groups of eight
    hex digits of a hash of seed and key draw both cuts, whether to transform (``fim`` of
    100) and the form (``spm`` of 100)."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = line_count(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= fim:
        return "plain", n, 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < spm else "psm", n, after_lines(text, a), after_lines(text, b)


def chunks(text: str, a: int, b: int) -> Iterator[bytes]:
    """text[a:b] in pieces of whole lines, CHUNK characters at most; longer lines are cut."""
    while a < b:
        end = min(b, a + CHUNK)
        if end < b:
            end = (text.rfind("\n", a, end) + 1) or end
        yield text[a:end].encode()
        a = end


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about AT_ONCE bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("piece") or b"") + 100
        if size > AT_ONCE:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _each(batches: Iterator[pa.RecordBatch], slices: int = 256) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, slices):
            yield from batch.slice(k, slices).to_pylist()


_KEYS = "deal long, row long, place long"
_HEAD = "n long, form string, prefix_chars long, middle_chars long"


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 7, fim: int = 100, spm: int = 50) -> DataFrame:
    """Pieces of the transformed texts: deal and row (which name the document), place in
    the output, piece (UTF-8); and at place 0 a header with id, n, form, prefix_chars and
    middle_chars (null if plain). psm is ``<P>prefix<S>suffix<M>middle``, spm
    ``<S>suffix<P>prefix<M>middle``; empty texts and those with a mark stay plain.

    Null texts are empty; a null id draws like an empty one. Repeated rows are documents
    of their own. An empty table gives none. Other columns are not read.
    """
    source = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key"), F.xxhash64(id_column, text_column).alias("deal"),
        F.monotonically_increasing_id().alias("row"), text_or_empty(text_column).alias("text"),
    )
    result = StructType([source.schema["id"], *StructType.fromDDL(f"{_KEYS}, {_HEAD}, piece binary").fields])
    schema = to_arrow_schema(result)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for x in _each(batches):
            text = x["text"]
            form, n, a, b = layout(x["key"], text, seed, fim, spm)
            name = {"deal": x["deal"], "row": x["row"]}
            yield name | {"place": 0, "id": x["id"], "n": n, "form": form} | ({} if form == "plain" else {"prefix_chars": a, "middle_chars": b - a})
            parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
            order = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
            out = (p for mark in order for p in (mark, *chunks(text, *parts[mark]))) if order else chunks(text, 0, len(text))
            for place, piece in enumerate(out, 1):
                yield name | {"place": place, "piece": piece}

    return source.mapInArrow(lambda batches: _batches(rows(batches), schema), result)


def in_order(parts: DataFrame) -> DataFrame:
    """Pieces with all of a document in one partition, in output order: what is streamed
    to a file or a digest. Rows of one document come from one task, so a lost task cannot
    mix two attempts."""
    return parts.repartition("deal").sortWithinPartitions("deal", "row", "place")


def restored(ordered: DataFrame) -> DataFrame:
    """From pieces in output order the pieces in original order, and for each document a
    header at place -1, now with output_sha256."""
    result = StructType([*ordered.schema.fields, *StructType.fromDDL("output_sha256 string").fields])
    schema = to_arrow_schema(result)
    parts = {mark: k * PART for k, mark in enumerate((PREFIX, MIDDLE, SUFFIX))}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        head, digest, place = None, hashlib.sha256(), 0
        for x in _each(batches):
            if x["place"] == 0:
                if head:
                    yield head | {"place": -1, "output_sha256": digest.hexdigest()}
                head, digest, place = x, hashlib.sha256(), 0
                continue
            digest.update(x["piece"])
            if head["form"] != "plain" and x["piece"] in parts:  # a mark: texts with marks are plain
                place = parts[x["piece"]]
                continue
            yield {"deal": x["deal"], "row": x["row"], "place": place, "piece": x["piece"]}
            place += 1
        if head:
            yield head | {"place": -1, "output_sha256": digest.hexdigest()}

    return ordered.mapInArrow(lambda batches: _batches(rows(batches), schema), result).sortWithinPartitions("deal", "row", "place")


def digests(original: DataFrame) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each
    document, from its pieces in original order."""
    result = StructType([original.schema["id"], *StructType.fromDDL(f"{_HEAD}, output_sha256 string, restored_sha256 string").fields])
    schema = to_arrow_schema(result)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        head, digest = None, hashlib.sha256()
        for x in _each(batches):
            if x["place"] >= 0:
                digest.update(x["piece"])
                continue
            if head:
                yield head | {"restored_sha256": digest.hexdigest()}
            head, digest = {f: x[f] for f in schema.names if f in x}, hashlib.sha256()
        if head:
            yield head | {"restored_sha256": digest.hexdigest()}

    return original.mapInArrow(lambda batches: _batches(rows(batches), schema), result)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    done = digests(restored(in_order(pieces(documents(spark, sf_dir)))))
    return done.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l, cast('0x' || h[1:8] as ubigint) as h1, cast('0x' || h[9:16] as ubigint) as h2, cast('0x' || h[25:32] as ubigint) as h4 from d),
c as (select *, cast(least(h1 % (len(l) + 1), h2 % (len(l) + 1)) as bigint) as a, cast(greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) as bigint) as b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(l[1:a], '') as pre, array_to_string(l[a + 1:b], '') as mid, array_to_string(l[b + 1:], '') as suf from c)
select doc_id, cast(len(l) as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(pre || mid || suf) as restored_sha256
from p
"""
