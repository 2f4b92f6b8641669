"""Conversation repair, suffix-array dedup and fill-in-middle against brute force."""

import functools
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from otelframe.llm import conversations, fill_middle, suffixes

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- conversations ----


def cheapest(initials, faults):
    """Least (cost, audit), by recursion over the grammar's states."""

    @functools.lru_cache(None)
    def best(i, state, room):
        # states: b begin, s after s, u after u, a after a (or an end)
        options = [(0, "")] if i == len(initials) and state in "ba" else []
        after = {"b": "su", "s": "u", "u": "a", "a": "u"}[state]

        def then(cost, letter, *at):
            c, audit = best(*at)
            options.append((cost + c, letter + audit))

        for to in after:
            if to != "s" and room:
                then(3, "I", i, to, room - 1)
        if i < len(initials):
            then(4, "D", i + 1, state, room)
            if faults[i] not in "BD":
                more = 3 if faults[i] == "T" else 0
                for to in after:
                    if initials[i] == to:
                        then(more, "K", i + 1, to, room)
                    if to != "s":
                        then(more + 3, "R", i + 1, to, room)
        return min(options, default=(10**9, "~"))

    return best(0, "b", len(initials) + 2)


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(0, 10))
        initials = "".join(rng.choice(list("uuaas?"), n))
        faults = "".join(rng.choice(list("---TBD"), n))
        assert conversations.align(initials, faults) == cheapest(initials, faults), (initials, faults)


def test_long_alignment():
    rng = np.random.default_rng(6)
    initials = "s" + "".join("ua"[k % 2] for k in range(2000) if rng.random() > 0.05)
    faults = "".join(rng.choice(list("-" * 16 + "TB"), len(initials)))
    cost, audit = conversations.align(initials, faults)
    kept = [f for f, e in zip(faults, (e for e in audit if e != "I"), strict=True) if e != "D"]
    paid = 3 * (audit.count("R") + audit.count("I")) + 4 * audit.count("D") + 3 * kept.count("T")
    assert paid == cost and "B" not in kept


def repaired(rows):
    """The report of one conversation's rows (turn, role, text), in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), ""
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults += "B" if not end else "D" if (role, text) in seen else "T" if end not in ".!?" else "-"
        seen.add((role, text))
    initials = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "?" for r in rows)
    cost, audit = cheapest(initials, faults)
    out, left = [], iter(rows)
    for edit in audit:
        row = next(left) if edit != "I" else None
        if edit == "D":
            continue
        due = "user" if not out or out[-1][0][0] in "sa" else "assistant"
        out.append((row[1] if edit == "K" else due, row[2] if row else ""))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, faults.count("B"), faults.count("D"), faults.count("T"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out))), out


def test_query_equals_brute_force(spark):
    after = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        conv, turn, role, text = r.conv_id, r.turn, r.role or " ", r.text or " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        after[conv] += {0: [], 1: [(turn, role, "")], 2: [(turn, role, re.sub("[.!?]", "", text))], 3: [(turn, role, text)] * 2, 4: [(turn, "user", text)]}.get(kind, [(turn, role, text)])
    want = {conv: repaired(rows)[0] for conv, rows in after.items()}
    got = {r[0]: tuple(r)[1:] for r in conversations.op11_conversation_repair(spark, SF).collect()}
    assert got == want


def test_conversation_edges(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 9, "user", "And"),
        (2, None, None, None), (2, 3, "user", " \n"), (None, 1, "tool", "Run."), (None, None, "user", "Go!"), (3, 1, "assistant", "x" * 200_000 + "."), (3, 1, "assistant", "a."),
    ]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], TURNS + ", place int, fault string")
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role or " ", text or " "))
    got = {r[0]: tuple(r)[1:] for r in conversations.structure_report(conversations.with_faults(df)).collect()}
    assert got == {c: repaired(x)[0] for c, x in by_conv.items()}
    out = defaultdict(list)
    for r in sorted(conversations.repair(df).collect(), key=lambda r: r.place):
        out[r.conv].append((r.role, r.text))
    assert out == {c: x for c, rows in by_conv.items() if (x := repaired(rows)[1])}
    empty = spark.createDataFrame([], TURNS)
    assert conversations.repair(empty).count() == 0 and conversations.structure_report(conversations.with_faults(empty)).count() == 0


def test_dropped_conversations_are_named(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", True), (1, 1, "user", "a.", True), (2, 0, "user", "a.", False), (2, 1, "user", "a.", True)], TURNS + ", gone boolean")
    got = {r.conv: (r.cost, r.audit, r.duplicate, r.repaired_sha256) for r in conversations.structure_report(conversations.with_faults(df, gone=F.col("gone"))).collect()}
    assert got == {1: (0, "", 0, sha("")), 2: (3, "KI", 0, sha("user:a.\nassistant:"))}


# ---- suffix arrays ----


def left_over(rows, length):
    """(doc_id, n_bytes, spans, kept) of (doc_id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            w, i_ = b[p : p + length], float("inf") if i is None else i
            first[w] = min(first.get(w, i_), i_)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (float("inf") if i is None else i):
                gone[p + 1 : p + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        out.append((i, len(b), [tuple(map(int, e)) for e in edges], bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])))
    return out


def removed(df, **options):
    return [(r.id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(df, **options).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_suffix_functions():
    rng = np.random.default_rng(2)
    for length in (17, 40, 50, 64):
        base = rng.integers(97, 97 + int(rng.choice([1, 2, 26])), 600).astype(np.uint8)
        size = rng.integers(length, 200, 30)
        data = np.concatenate([base[a : a + n] for a, n in zip(rng.integers(0, 400, 30), size, strict=True)])
        first = np.cumsum(size) - size
        starts = np.concatenate([np.arange(a, a + n - length + 1) for a, n in zip(first, size, strict=True)])
        order = suffixes.suffix_order(data, starts, length)
        windows = [data[p : p + length].tobytes() for p in order]
        assert windows == sorted(windows) and sorted(order) == sorted(starts)
        lcp = suffixes.common_prefixes(data, order, first, size - length + 1, length)
        for a, b, n in zip(windows, windows[1:], lcp[1:], strict=False):
            assert n == next((k for k in range(length) if a[k] != b[k]), length)


@pytest.mark.parametrize("shard", [300, 1 << 20])
def test_shards_are_merged(shard):
    """Variants of one passage, under few grams: they meet across shards."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 90).astype(np.uint8)
    rows = []
    for i in range(60):
        x = base.copy()
        x[rng.integers(0, 90, 2)] = 65 + rng.integers(0, 3, 2)
        rows.append((int(rng.integers(0, 30)), x.tobytes().decode()))
    data, lengths = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.array([len(t) for _, t in rows])
    _, doc, start, count = suffixes.pieces_of(data, lengths, 50)
    size = count + 49
    own = np.concatenate([data[a : a + n] for a, n in zip(start, size, strict=True)])
    ids = np.array([i for i, _ in rows])
    piece, begin, end = suffixes.repeats_in(own, size, ids[doc], 50, shard)
    gone = np.zeros(len(data), bool)
    for p, a, b in zip(piece, begin, end, strict=True):
        gone[start[p] + a : start[p] + b] = True
    want = np.concatenate([np.isin(np.arange(n), [k for a, b in spans for k in range(a, b)]) for _, n, spans, _ in left_over(rows, 50)])
    assert (gone == want).all() and gone.any()


def test_repeats_equal_brute_force(spark, edge, monkeypatch):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    want = ordered(left_over(rows, 50))
    assert ordered(removed(edge)) == want
    monkeypatch.setattr(suffixes, "CROWDED", 2)  # window by window
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    monkeypatch.setattr(suffixes, "PIECE_RANGE", 1 << 12)
    monkeypatch.setattr(suffixes, "HASH_RANGE", 1 << 12)
    assert ordered(removed(edge)) == want


def test_repeats_of_random_texts(spark):
    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abé "), int(rng.integers(20, 120)))) for _ in range(12)]
    rows = [(int(i), "".join(rng.choice(parts, int(rng.integers(0, 6))))) for i in rng.integers(0, 40, 60)]
    assert ordered(removed(spark.createDataFrame(rows, "doc_id long, text string"), length=20)) == ordered(left_over(rows, 20))


def test_suffix_dedup_edges(spark, empty):
    assert suffixes.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(empty, length=16)


@pytest.mark.parametrize("module,name,sql", [(suffixes, "op12_suffix_dedup", "OP12_SQL"), (fill_middle, "op13_fill_middle", "OP13_SQL")])
def test_equal_to_sql(spark, module, name, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.execute(getattr(module, sql))
    columns = [c[0] for c in found.description]
    got = getattr(module, name)(spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())


# ---- fill in the middle ----


def transformed(key, text):
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_middle_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    rows += [(20, "a<P>\nb"), (21, "\n"), (22, "\n\n\nx"), (23, "no end\nat all"), (24, "".join(f"line {k}\n" for k in range(20_000))), (25, "é" * 100_000 + "\n" + "<P" * 40_000)]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, row int, form string")
    want = []
    for i, t in rows:
        n, form, p, m, out = transformed("" if i is None else i, t or "")
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    ordered_pieces = fill_middle.in_order(fill_middle.pieces(df))
    assert ordered(map(tuple, fill_middle.digests(fill_middle.restored(ordered_pieces)).collect())) == ordered(want)
    texts = defaultdict(bytes)
    for r in sorted(ordered_pieces.where("piece is not null").collect(), key=lambda r: (r.row, r.place)):
        assert len(r.piece.decode()) <= fill_middle.CHUNK
        texts[r.row] += r.piece
    assert sorted(sha(t) for t in texts.values()) == sorted(w[5] for w in want if w[5] != sha(""))
    assert fill_middle.digests(fill_middle.restored(fill_middle.in_order(fill_middle.pieces(empty)))).count() == 0


def test_some_stay_plain(spark):
    df = spark.createDataFrame([(i, "a\nb\nc") for i in range(200)], "doc_id long, text string")
    forms = defaultdict(int)
    for r in fill_middle.pieces(df, fim=50, spm=0).where("place = 0").collect():
        forms[r.form] += 1
    assert set(forms) == {"plain", "psm"} and 60 < forms["plain"] < 140
