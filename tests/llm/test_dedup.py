"""Exact, line, passage and n-gram dedup against brute force."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from otelframe.llm import exact_dedup, jaccard, lines, passages, shingles
from otelframe.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def oracle(sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return con.execute(sql)


def as_rows(result):
    names = [d[0] for d in result.description]
    return {tuple(sorted(zip(names, r))) for r in result.fetchall()}


@pytest.mark.parametrize("run, sql", [(exact_dedup.op7_exact_dedup, exact_dedup.OP7_SQL), (lines.op8_line_dedup, lines.OP8_SQL)])
def test_queries_equal_their_sql(spark, run, sql):
    assert {tuple(sorted(r.asDict().items())) for r in run(spark, SF).collect()} == as_rows(oracle(sql))


def test_exact_dedup_edges(edge, empty):
    rows = exact_dedup.exact_dedup(edge).collect()
    assert len(rows) == edge.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [(r.keep_id, r.group_size, r.kept) for r in by_id[1]] == [(2, 3, False)]
    assert by_id[2][0].kept and {(r.keep_id, r.kept) for r in by_id[None]} == {(2, False), (4, False)}
    assert [(r.keep_id, r.group_size, r.kept) for r in by_id[5]] == [(5, 2, True)] * 2
    assert by_id[3][0].keep_id == 4 and by_id[4][0].kept
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_full_hash_is_taken_for_surviving_groups_only(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert all(r.full_hash is not None for r in rows if r.group_size > 1)
    assert sum(r.full_hash is not None for r in rows) < len(rows) / 2
    crowded = exact_dedup.exact_dedup(docs, bits=12).collect()  # many keys on one bit: same result
    assert {(r.doc_id, r.keep_id, r.group_size) for r in crowded} == {(r.doc_id, r.keep_id, r.group_size) for r in rows}


def test_line_dedup_edges(edge, empty):
    rows = {(r.doc_id, r.text): r for r in lines.line_dedup(edge).collect()}
    assert rows[6, "one line of text\nanother line of text\na third line of text\ntail six"]._dedup.removed == 0
    assert rows[7, "tail seven"]._dedup == (4, 3)
    assert rows[3, None]._dedup == (0, 0) and rows[4, ""]._dedup == (1, 0)
    assert lines.line_dedup(edge).columns == [*edge.columns, "_dedup"] and lines.line_dedup(edge).count() == edge.count()
    assert lines.line_dedup(empty).count() == 0


def brute_windows(h, least):
    out = set()

    def split(a, b):
        if b - a + 1 >= least:
            c = a + int(np.argmin(h[a : b + 1]))
            out.add((a, c, b))
            split(a, c - 1)
            split(c + 1, b)

    split(0, len(h) - 1)
    return out


def test_compact_windows_equal_the_cartesian_tree():
    """Wide nodes of each function's tree give the runs of starts with one least hash."""
    rng = np.random.default_rng(0)
    for trial in range(60):
        least = int(rng.integers(1, 20))
        sequences = [rng.integers(0, 50 if trial % 2 else 1 << 40, int(rng.integers(1, 120))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(3)]
        owner = np.repeat(np.arange(3), [len(s) for s in sequences])
        got = passages.compact_windows(np.concatenate(sequences), owner, least)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sequences])))
        for k, s in enumerate(sequences):
            for j in range(passages.HASHES):
                h = s * np.uint64(shingles.odd(j))
                h ^= h >> np.uint64(32)
                want = {i: int(h[c]) >> 3 for l, c, r in brute_windows(h >> np.uint64(passages.PLACE_BITS) << np.uint64(passages.PLACE_BITS), least) for i in range(max(l, c - least + 1), min(c, r - least + 1) + 1)}
                mine = (got["owner"] == k) & (got["key"] & 7 == j)
                runs = [(a - at[k], b - at[k], int(np.int64(x).view(np.uint64)) >> 3, c - at[k]) for a, b, x, c in zip(got["a"][mine], got["b"][mine], got["key"][mine], got["c"][mine])]
                assert {i: x for a, b, x, _ in runs for i in range(a, b + 1)} == want and len(want) == sum(b - a + 1 for a, b, *_ in runs)
                assert all(a <= c < a + least and int(h[c]) >> 3 == x and b - a < least for a, b, x, c in runs)


def test_similar_starts_equal_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        least, k = int(rng.integers(1, 10)), int(rng.choice([2, 5, 30]))
        x = rng.integers(0, k, int(rng.integers(1, 40))).astype("<u4")
        y = rng.integers(0, k, int(rng.integers(1, 40))).astype("<u4") if rng.random() < 0.4 else np.concatenate((x[int(rng.integers(len(x))) :], x[:5]))
        for d in range(-8, 8):
            near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
            want = [s for s in range(len(x) - least + 1) if 0 <= s + d <= len(y) - least and near(set(x[s : s + least].tolist()), set(y[s + d : s + d + least].tolist()))]
            assert passages.similar_starts(x, y, d, least).tolist() == want


def test_passages_hold_every_exact_repeat(spark, docs, texts):
    found = {}
    rows = passages.op6_substring_dedup(spark, SF).collect()
    for r in rows:
        assert r.source_doc_id < r.doc_id and r.n_words >= 50
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word - 49))
    seen, must = set(), {}
    for doc, text in sorted(texts.items()):
        w = text.encode().lower().split()
        keys = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        if hits := {i for i, k in enumerate(keys) if k in seen}:
            must[doc] = hits
        seen.update(keys)
    total = sum(map(len, must.values()))
    assert set(must) <= set(found)
    assert sum(len(v & found[d]) for d, v in must.items()) >= 0.95 * total
    sets = {d: shingles.distinct(t) for d, t in texts.items()}
    for doc in set(found) - set(must):  # the others are near copies of some passage
        others = np.unique(np.concatenate([s for d, s in sets.items() if d < doc]))
        assert np.isin(shingles.sequence(texts[doc]), others).sum() >= 36  # 41 of 46 where all differ
    by_doc = {d: t.encode().lower().split() for d, t in texts.items()}
    for r in rows:  # the first stretch of each passage is near the one it names
        a, b = (set(zip(*[by_doc[d][at + i : at + 46 + i] for i in range(5)])) for d, at in ((r.doc_id, r.start_word), (r.source_doc_id, r.source_start)))
        assert 100 * len(a & b) >= 80 * len(a | b)


def test_passage_edges(edge, empty):
    rows = passages.repeated_passages(edge).collect()
    assert {(r.doc_id, r.source_id) for r in rows} == {(2, 1), (None, 1)}
    assert passages.repeated_passages(empty).count() == 0


def test_passages_of_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(7)
    p, q = (" ".join(f"w{x}" for x in rng.integers(1 << 40, size=70)) for _ in range(2))
    rows = [(1, p, 0), (2, "a b " + p, 0), (2, "c d " + q, 0), (2, "c d " + q, 1), (3, q, 0), (4, p + " " + q, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    want = {(2, 1, 2, 72), (3, 2, 0, 70), (4, 1, 0, 70), (4, 2, 68, 140)}  # a stretch may begin two words before its passage
    mixed = df.orderBy(F.desc("text")).repartition(3)
    for found in (passages.repeated_passages(df), passages.repeated_passages(mixed)):
        assert {(r.doc_id, r.source_id, r.start_word, r.end_word) for r in found.collect()} == want
    assert {(r.doc_id, r.source_id, r.start_word, r.end_word) for r in passages.repeated_passages(mixed, exhaustive=True).collect()} >= want


def test_passages_behind_decoys(spark):
    """Earlier documents hold both halves of each passage: the pair is found all the same."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(1 << 40, size=n)]
    texts, want = {}, set()
    for k in range(60):
        p = words(60)
        q = list(p)
        if k % 2:
            q[int(rng.integers(5, 55))] = "changed"
        for i, part in enumerate((words(50) + p[:30] + words(50), words(50) + p[30:] + words(50), words(80) + p + words(80), words(80) + q + words(80))):
            texts[10 * k + i] = " ".join(part)
        want.add((10 * k + 3, 10 * k + 2))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = {(r.doc_id, r.source_id) for r in passages.repeated_passages(df).collect()}
    assert first <= want and len(first) >= 59
    assert {(r.doc_id, r.source_id) for r in passages.repeated_passages(df, exhaustive=True).collect()} == want


def plain_sets(texts):
    low = {c: c + 32 for c in range(65, 91)}
    out = {}
    for doc, text in texts.items():
        w = [x for x in "".join(chr(32) if c in "\t\n\x0b\x0c\r" else c for c in text.translate(low)).split(" ") if x]
        out[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def classes(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_jaccard_classes_equal_all_pairs(spark, texts):
    sets = plain_sets(texts)
    want = classes(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op9_ngram_jaccard(spark, SF).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_jaccard_on_chains_and_borders(spark):
    """Chains of edits: the first copy links with near ones only, so classes grow by
    links of copies; pairs at exactly 0.8 link, just below do not."""
    rng = np.random.default_rng(3)
    texts, n = {}, 0
    for size in (8, 12, 20, 44, 90):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(size)]
        for _ in range(14):
            texts[n] = " ".join(words)
            n += 1
            words = list(words)
            words[int(rng.integers(len(words)))] = f"w{rng.integers(1 << 40)}" if rng.random() < 0.5 else words[0]
    texts[n] = " ".join(f"e{i}" for i in range(13))  # 9 shingles
    texts[n + 1] = texts[n] + " x y"  # 11 in all: 9 / 11 = 0.818
    texts[n + 2] = " ".join(f"g{i}" for i in range(12))  # 8
    texts[n + 3] = texts[n + 2] + " x y"  # 8 / 10 = 0.8
    texts[n + 4] = texts[n + 2] + " p q r"  # 8 / 11
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicate_classes(df).collect()}
    assert got == classes(plain_sets(texts))
    assert got[n + 1] == n and got[n + 3] == n + 2 and got[n + 4] == n + 4


def test_jaccard_edges(edge, empty):
    rows = jaccard.near_duplicate_classes(edge).collect()
    assert len(rows) == edge.count()
    found = {(r.doc_id, r.size): r.component_id for r in rows}
    assert found[1, 10] == 1 and found[2, 10] == 1 and found[None, 10] == 1
    assert found[3, 0] == 3 and found[None, 0] is None and found[10, 1] == 10
    assert jaccard.near_duplicate_classes(empty).count() == 0


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 400))).astype(np.uint64)
        a = np.unique(base[rng.random(len(base)) < 0.9])
        b = np.unique(np.concatenate((base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 300))).astype(np.uint64))))
        assert jaccard.differing_bits(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + (i * 7) % 31, 100 + ((i + 1) * 7) % 31) for i in range(30)] + [(200, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(31)}
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    more = connected_components(frame([(7, 105), (500, 501)]), connected_components(frame(edges)))
    assert {r.node: r.label for r in more.collect()} == {n: 0 for n in got} | {500: 500, 501: 500}


def test_text_digest_of_kept_lines(spark, texts):
    rows = {r.doc_id: r for r in lines.op8_line_dedup(spark, SF).collect()}
    untouched = [d for d, r in rows.items() if not r.n_removed]
    assert all(rows[d].kept_sha256 == hashlib.sha256(texts[d].encode()).hexdigest() for d in untouched)
