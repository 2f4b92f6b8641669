"""Repair of the turn structure of conversations, by alignment to their grammar.

The roles of a conversation should read ``(s?(ua)+)?`` by their initials. Turns are
aligned to the grammar's strings of each feasible length (Wagner-Fischer): all lengths
are prefixes of ``uaua...`` or ``suaua...``, so that one table for each of the two has
a column for every length. Only cells that can still be part of a repair within the
incumbent cost are filled (Ukkonen's band); the incumbent is the cost of a plain repair
from left to right. The best ends are traced back, and their audits compared.

Rows are dealt by conversation and sorted inside the partition; a task holds two
characters for each turn, not its text. The audit is then sorted in front of the
conversation's turns, in the same partition, and the repaired turns are streamed.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Costs of the edits, the blank characters, and what a turn may end with.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = [".", "!", "?"]
ROLE = {"u": "user", "a": "assistant"}


def wanted(j: int, system: bool) -> str:
    """Initial at place j of the grammar's string."""
    return "s" if system and j == 0 else "ua"[(j - system) % 2]


def _first_repair(turns: list[tuple[str, str]]) -> int:
    """Cost above the least of a plain repair: a turn of the other role gets a turn
    before it, turns of no usable role get the role that is due."""
    cost, due = 0, "u"
    for role, fault in turns:
        if fault in "BD":
            continue
        if role == "s" or role == "?":
            cost += REROLE
            due = "ua"[due == "u"]
        elif role != due:
            cost += INSERT
        else:
            due = "ua"[due == "u"]
    return cost + (INSERT if due == "a" else 0)


def _table(turns: list, removal: list[int], system: bool, most: int) -> list[tuple[int, array]]:
    """Rows of (first column, costs) of the cells within ``most``. The costs leave out what
    every repair pays; cells beyond the band count as most + 1."""
    over = most + 1
    row = [0]
    low = 0
    out = []
    for i in range(len(turns) + 1):
        if i:
            role, fault = turns[i - 1]
            before, gone = row, removal[i - 1]
            if fault in "BD":
                row = [min(over, c + gone) for c in before]
            else:
                row = [min(over, c + gone) for c in before] + [over]
                for k, c in enumerate(before):
                    if c > most:
                        continue
                    due = wanted(low + k, system)
                    step = c if role == due else over if due == "s" else c + REROLE
                    if step < row[k + 1]:
                        row[k + 1] = step
        # turns put in; none can be put in for the system turn
        k = 0
        while k < len(row):
            c = row[k] + INSERT
            if c <= most and not (system and low + k == 0):
                if k + 1 == len(row):
                    row.append(c)
                elif c < row[k + 1]:
                    row[k + 1] = c
            k += 1
        first = next((k for k, c in enumerate(row) if c <= most), len(row))
        last = next((k for k in range(len(row), 0, -1) if row[k - 1] <= most), 0)
        row = row[first:last]
        low += first
        out.append((low, array("q", row)))
        if not row:
            break
    return out


def _audit(turns: list, removal: list[int], system: bool, table: list[tuple[int, array]], ends: list[int]) -> str:
    """The least audit, in ASCII order, of the cheapest repairs that end in ``ends``."""
    over = 1 << 60

    def cost(i: int, j: int) -> int:
        low, row = table[i]
        return row[j - low] if 0 <= j - low < len(row) else over

    n = len(turns)
    alive: list[set[int]] = [set() for _ in range(n)] + [set(ends)]
    for i in range(n, -1, -1):
        low, row = table[i]
        if i < n:
            role, fault = turns[i]
            for k, c in enumerate(row):
                j = low + k
                kept = fault not in "BD" and (j + 1) in alive[i + 1] and cost(i + 1, j + 1) == c + (0 if role == wanted(j, system) else REROLE) and (role == "s" or wanted(j, system) != "s")
                if kept or (j in alive[i + 1] and cost(i + 1, j) == c + removal[i]):
                    alive[i].add(j)
        for k in range(len(row) - 2, -1, -1):
            j = low + k
            if j + 1 in alive[i] and row[k + 1] == row[k] + INSERT and not (system and j == 0):
                alive[i].add(j)
    i = j = 0
    audit = []
    while True:
        c = cost(i, j)
        if i < n and j in alive[i + 1] and cost(i + 1, j) == c + removal[i]:
            audit.append("D")
            i += 1
        elif (j + 1) in alive[i] and cost(i, j + 1) == c + INSERT and not (system and j == 0):
            audit.append("I")
            j += 1
        elif i < n:
            audit.append("K" if turns[i][0] == wanted(j, system) else "R")
            i, j = i + 1, j + 1
        else:
            return "".join(audit)


def align(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair. ``initials`` has s, u, a or ? for each turn,
    ``faults`` B (blank), D (duplicate), T (truncated) or - (none)."""
    turns = list(zip(initials, faults, strict=True))
    least = sum(DELETE if f in "BD" else TRUNCATED if f == "T" else 0 for f in faults)
    removal = [0 if f in "BD" else DELETE - TRUNCATED if f == "T" else DELETE for f in faults]
    most = min(_first_repair(turns), sum(removal))
    found = []
    for system in (False, True):
        if system and not any(r == "s" and f not in "BD" for r, f in turns):
            continue
        table = _table(turns, removal, system, most)
        if len(table) <= len(turns):
            continue
        low, row = table[-1]
        ends = {low + k: c for k, c in enumerate(row) if c <= most and (low + k >= 3 and (low + k) % 2 == 1 if system else (low + k) % 2 == 0)}
        if ends:
            most = min(ends.values())
            found.append((most, _audit(turns, removal, system, table, [m for m, c in ends.items() if c == most])))
    cost, audit = min(found)
    return least + cost, audit


def with_faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """conv, turn, role, text, initial, fault of each turn: B blank, D duplicate of an
    earlier turn (role and text), T truncated, - none; X where ``gone`` holds (the row only
    names its conversation). A null role or text is one space. Turns of one number are
    ordered by role and text, null numbers come first."""
    some = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    )
    # a conversation's rows are spread by role and text here
    nth = F.row_number().over(Window.partitionBy("conv", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first()))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("gone"), "X").when(end == "", "B").when(nth > 1, "D").when(~end.isin(ENDS), "T").otherwise("-")
    return some.select("conv", "turn", "role", "text", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), fault.alias("fault"))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _report(turns: list, initials: list[str], faults: list[str]) -> dict:
    known = [t for t in turns if t is not None]
    pairs = [a + b for a, b in zip(initials, initials[1:], strict=False)]
    cost, audit = align("".join(initials), "".join(faults))
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "blank": faults.count("B"), "duplicate": faults.count("D"), "truncated": faults.count("T"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
    }


def audited(faulty: DataFrame) -> DataFrame:
    """The turns of each conversation in order (place 1, 2, ...), behind a row at place 0
    with its counts, cost and audit; rows of a conversation stand together."""
    source = faulty.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    result = StructType([source.schema["conv"], *StructType.fromDDL(f"place long, role string, text string, {_COUNTS}").fields])
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, initials, faults = None, [], [], []
        for batch in batches:
            reports, places, keep = [], [], []
            for conv, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault")), strict=True):
                if current is None or conv != current[0]:
                    if current:
                        reports.append({"conv": current[0], "place": 0} | _report(known, initials, faults))
                    current, known, initials, faults = (conv,), [], [], []
                keep.append(fault != "X")
                if fault != "X":
                    known.append(turn)
                    initials.append(initial)
                    faults.append(fault)
                    places.append(len(faults))
            rows = batch.filter(pa.array(keep, pa.bool_()))
            fixed = {"conv": rows.column("conv"), "place": pa.array(places, pa.int64()), "role": rows.column("role"), "text": rows.column("text")}
            yield pa.RecordBatch.from_arrays([fixed[f.name].cast(f.type) if f.name in fixed else pa.nulls(rows.num_rows, f.type) for f in schema], schema=schema)
            if reports:
                yield pa.RecordBatch.from_pylist(reports, schema=schema)
        if current:
            yield pa.RecordBatch.from_pylist([{"conv": current[0], "place": 0} | _report(known, initials, faults)], schema=schema)

    return source.mapInArrow(run, result).sortWithinPartitions("conv", "place")


def _edits(audit: str) -> Iterator[tuple[str, int]]:
    """(edit, place in the target) of each edit."""
    j = 0
    for edit in audit:
        yield edit, j
        j += edit != "D"


def _repaired(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """For each conversation its report and its repaired turns (edit, role, text); they are
    read from ``rows`` as they are asked for."""
    rows = iter(rows)
    head = next(rows, None)
    while head is not None:
        following: list[dict | None] = [None]

        def turns(head=head, following=following):
            system = None
            for edit, j in _edits(head["audit"]):
                row = next(rows) if edit != "I" else None
                if edit == "D":
                    continue
                if system is None:
                    system = edit == "K" and row["role"][:1] == "s"
                if edit == "K":
                    yield edit, row["role"], row["text"]
                else:
                    yield edit, ROLE[wanted(j, system)], row["text"] if row else ""
            following[0] = next(rows, None)

        yield head, turns()
        head = following[0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            yield from batch.slice(k, 256).to_pylist()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 0), role, text, edit (K, R or I) of the repaired turns.

    Nulls in role and text are one space, which is blank; null conversation ids are one
    conversation; null turn numbers come first; equal ones are ordered by role and text.
    Repeated rows are duplicates and go. An empty table, and a conversation of which nothing stays, give
    no rows. Other columns are not read. Texts are streamed, however long.
    """
    source = audited(with_faults(rows, conv, turn, role, text))
    result = StructType([source.schema["conv"], *StructType.fromDDL("place long, role string, text string, edit string").fields])
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for head, turns in _repaired(_rows(batches)):
            for place, (edit, as_role, content) in enumerate(turns):
                held.append({"conv": head["conv"], "place": place, "role": as_role, "text": content, "edit": edit})
                size += len(content) + 100
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return source.mapInArrow(run, result)


def structure_report(faulty: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256
    (of ``role:text``, joined by newlines) of each conversation in ``with_faults`` rows."""
    source = audited(faulty)
    result = StructType([source.schema["conv"], *StructType.fromDDL(f"{_COUNTS}, repaired_sha256 string").fields])
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for head, turns in _repaired(_rows(batches)):
            digest, between = hashlib.sha256(), b""
            for _, as_role, content in turns:
                digest.update(between + f"{as_role}:".encode())
                digest.update(content.encode())
                between = b"\n"
            held.append({c: head[c] for c in schema.names if c in head} | {"repaired_sha256": digest.hexdigest()})
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return source.mapInArrow(run, result)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by a checksum of conversation and turn: rows
    that are dropped (marked ``gone``), emptied, without ends, repeated, or of role user."""
    some = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    drawn = some.withColumn("kind", F.crc32(name) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = drawn.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return changed.withColumn("copy", F.explode(times)).drop("kind", "copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    done = structure_report(with_faults(rows, gone=F.col("gone")))
    return done.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
