"""BPE, token store, packing and audio against the library, brute force and round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from otelframe.llm import audio, bpe, packing, token_store
from otelframe.llm.tokens import default_vocabulary, encoder

WORDS, BYTES = default_vocabulary("word_bpe_49k.json"), default_vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "Don't WE'LL 'RE 12345 ½²", "<|endoftext|> a <|startoftext|>b", "éÀ Ǆ ﬁ ΣΑΣ İ", "a\x1cb\x85c", "😀😀漢字", "ab" * 3000, "</w>x</w>", "tab\there\r\n\n x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


def test_word_bpe_equals_the_library(texts, library):
    e = bpe.word_encoder(WORDS)
    for text in [*texts.values(), *ODD]:
        ids, decimal = e.encode(text)
        known = library[0].encode(text, add_special_tokens=False).ids
        assert ids.tolist() == known and decimal == " ".join(map(str, known))
        assert e.decode(ids).decode() == library[0].decode(known, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thearinsgmo'!1é \n", max_size=60))
def test_word_bpe_on_made_words(text):
    known = Tokenizer.from_file(WORDS) if not hasattr(test_word_bpe_on_made_words, "t") else test_word_bpe_on_made_words.t
    test_word_bpe_on_made_words.t = known
    assert bpe.word_encoder(WORDS).encode(text)[0].tolist() == known.encode(text, add_special_tokens=False).ids


def test_byte_bpe_equals_the_library(texts, library):
    for text in [*texts.values(), *ODD]:
        assert encoder(BYTES)(text).tolist() == library[1].encode(text, add_special_tokens=False).ids


def odd_texts():
    """Strings over all planes, unassigned code points and combining marks included."""
    rng = np.random.default_rng(9)
    pools = [(0x20, 0x3000), (0x300, 0x370), (0x900, 0xE00), (0x1AB0, 0x1B00), (0x10000, 0x20000), (0, 0x110000)]
    for k in range(1200):
        codes = rng.integers(*pools[k % len(pools)], int(rng.integers(1, 40)))
        yield "".join(chr(c) for c in codes.tolist() if not 0xD800 <= c < 0xE000)


def test_odd_texts_equal_the_library(library):
    words, ids = bpe.word_encoder(WORDS), encoder(BYTES)
    for text in odd_texts():
        assert words.encode(text)[0].tolist() == library[0].encode(text, add_special_tokens=False).ids
        assert ids(text).tolist() == library[1].encode(text, add_special_tokens=False).ids


def test_bpe_query_equals_the_library(spark, texts, library):
    rows = bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library[0].encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library[0].decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_decode_rows(edge, empty, texts, docs):
    rows = bpe.encode_decode(docs, WORDS, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows[:20]:
        assert r.n_tokens == len(r.ids) and hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256
    none = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(edge, WORDS, with_ids=False).where("doc_id in (3, 4, 5)").collect()} == {(0, none, none)}
    assert bpe.encode_decode(empty, WORDS).count() == 0


def expected_ids(library, text, end):
    return library[1].encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_verifies_and_restores(spark, docs, texts, library):
    store = token_store.write_store(docs, BYTES)
    at = 0
    for r in token_store.verify(spark, store).orderBy("doc_id").collect():
        ids = expected_ids(library, texts[r.doc_id], 0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    for r in token_store.restore(spark, store).limit(20).collect():
        assert r.ids == expected_ids(library, texts[r.doc_id], 0)
    chunks = spark.read.parquet(store.chunks)
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    assert sum(r.documents for r in spark.read.parquet(store.manifest).collect()) == len(texts)


def test_token_store_edges(spark, edge, empty):
    rows = token_store.verify(spark, token_store.write_store(edge, BYTES)).collect()
    assert len(rows) == edge.count() and sorted(r.n_tokens for r in rows)[0] == 1
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)][:2] == [None, None]
    assert token_store.verify(spark, token_store.write_store(empty, BYTES)).count() == 0


def test_token_store_finds_damage(spark, docs):
    store = token_store.write_store(docs.limit(5), BYTES)
    bad = spark.read.parquet(store.chunks).selectExpr("chunk_id", "concat(data, cast('xx' as binary)) as data")
    bad.write.parquet(store.chunks + "-bad")
    with pytest.raises(Exception, match="damaged"):
        token_store.verify(spark, store._replace(chunks=store.chunks + "-bad")).collect()


def test_token_store_finds_lost_recipes(spark, docs):
    store = token_store.write_store(docs, BYTES)
    some = spark.read.parquet(store.recipes)
    for n, kept in enumerate((some.where("doc_id % 3 > 0"), some.where("doc_id < 0"), some.withColumn("start", 10**6 - F.col("start")))):
        kept.write.parquet(f"{store.recipes}-{n}")
        for read in (token_store.verify, token_store.restore):
            with pytest.raises(ValueError, match="manifest"):
                read(spark, store._replace(recipes=f"{store.recipes}-{n}"))


def test_equal_passages_get_equal_chunks():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 50_000, 9000)

    def parts(head):
        ids = np.concatenate((head, common))
        return {token_store.name_of(token_store.payload(x)) for x in np.split(ids, token_store.cuts(ids)[:-1])}

    a, b = parts(rng.integers(0, 50_000, 700)), parts(rng.integers(0, 50_000, 333))
    assert len(a & b) >= 0.6 * min(len(a), len(b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=8))
def test_crc_is_put_together_from_parts(parts):
    after = [sum(map(len, parts[i + 1 :])) for i in range(len(parts))]
    got = token_store.crc_before(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array(after))
    assert int(np.bitwise_xor.reduce(got)) == zlib.crc32(b"".join(parts))


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return bins


def test_packing_of_documents(docs, texts, library):
    rows = packing.pack_documents(docs).collect()
    bins = check_packing(rows, 1024)
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 1024) * 1.02 + 2
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, pieces in by_doc.items():
        ids = expected_ids(library, texts[doc], 2)
        pieces.sort(key=lambda r: r.piece)
        assert [p.length for p in pieces[1:]] == [1024] * (len(pieces) - 1) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    assert len(by_doc) == len(texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.integers(1, 6), st.integers(64, 4096), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_capacity(sizes, max_docs, max_cost, rule):
    lengths = np.array(sizes)
    bins, offsets = packing.best_fit(lengths, 64, max_docs, max_cost, rule=rule)
    for b in np.unique(bins):
        mine = bins == b
        assert lengths[mine].sum() <= 64 and mine.sum() <= max_docs
        assert (lengths[mine] ** 2).sum() <= max_cost or mine.sum() == 1
        assert sorted(offsets[mine]) == [0, *np.cumsum(lengths[mine][np.argsort(offsets[mine])])[:-1]]


def test_packing_edges(edge, empty, spark):
    rows = packing.pack_documents(edge).collect()
    check_packing(rows, 1024)
    assert {r.doc_id for r in rows} == {r.doc_id for r in edge.select("doc_id").collect()}
    assert packing.pack_documents(empty).count() == 0
    small = packing.pack(packing.cut(edge, BYTES), block_pieces=3).collect()
    check_packing(small, 1024)
    assert len(small) == len(rows)


def test_equal_rows_fall_into_all_blocks(spark):
    rows = spark.range(8000).selectExpr("cast(null as bigint) as id", "0 as piece", "0L as start", "1L as length", "7L as ids_crc32")
    done = packing.pack(rows, capacity=64, block_pieces=1000).collect()
    check = {}
    for r in done:
        check.setdefault(r.sequence_id, set()).add(r.offset)
    assert len(done) == 8000 and len(check) == 125 and all(v == set(range(64)) for v in check.values())
    assert len({s >> 32 for s in check}) >= 8


def test_documents_and_cost_bind(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 300, 2000).tolist()
    rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "id long, piece int, start long, length long, ids_crc32 long")
    for how in ({}, {"rule": "dot"}, {"scored_bins": None, "scored_fills": None}):
        done = packing.pack(rows, max_docs=6, max_cost=150_000, block_pieces=700, **how).collect()
        bins = {}
        for r in done:
            bins.setdefault(r.sequence_id, []).append(r.length)
        assert sorted(r.length for r in done) == sorted(sizes)
        assert all(sum(b) <= 1024 and len(b) <= 6 and sum(n * n for n in b) <= 150_000 for b in bins.values())
        assert any(len(b) == 6 for b in bins.values()) and max(sum(n * n for n in b) for b in bins.values()) > 140_000
        least = max(sum(sizes) / 1024, len(sizes) / 6, sum(n * n for n in sizes) / 150_000)
        assert len(bins) <= 1.2 * least + 3


def plain_feature(payload):
    """What is told of a recording, computed by direct sums."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = audio.phases()[:, ::-1].T.reshape(-1)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    y = np.convolve(up, h)[: len(up)][:: audio.DOWN]
    n = max(1, 1 + -(-(len(y) - audio.FRAME) // audio.HOP))
    y = np.concatenate((y, np.zeros(max(0, (n - 1) * audio.HOP + audio.FRAME - len(y)))))
    frames = np.array([y[i * audio.HOP : i * audio.HOP + audio.FRAME] for i in range(n)]) * np.hanning(audio.FRAME)
    wave = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME), np.arange(audio.FRAME // 2 + 1)) / audio.FRAME)
    mels = np.log(np.abs(frames @ wave) ** 2 @ audio.mel_filters().astype(float) + 1e-6)
    energy = 10 * np.log10((frames**2).mean(axis=1) + 1e-9)
    level, on, marks = energy - np.median(energy), False, []
    for v in level:
        on = v >= audio.START_DB or (on and v > audio.END_DB)
        marks.append(on)
    return n, mels.mean(axis=0), sum(b and not a for a, b in zip([False, *marks], marks)), sum(marks)


def test_audio_query_equals_direct_sums(spark, texts):
    rows = audio.op5_audio_features(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    close = 0
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        wav = audio.to_wav(payload)
        assert audio.from_wav(wav) == (8000, payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest())
        told = dict(p.split("=") for p in r.feature.split(";"))
        n, mels, runs, loud = plain_feature(payload)
        assert int(told["frames"]) == n and int(told["patches"]) == -(-n // audio.PATCH)
        assert np.allclose([float(v) for v in told["mel"].split(",")], mels, atol=0.03)
        close += (int(told["segments"]), int(told["loud"])) == (runs, loud)
    assert close >= 0.98 * len(rows)  # an energy on a threshold may fall to either side in single precision


def test_stored_tensors(docs):
    for r in audio.features(audio.store_media(docs)).limit(40).collect():
        table = pa.ipc.open_stream(r.tensors).read_all()
        assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float16(), [audio.PATCH, audio.MELS], dim_names=["frame", "mel"])
        cubes, first, last = audio.patches(r.tensors)
        assert cubes.shape == (table.num_rows, audio.PATCH, audio.MELS) and (last > first).all() and (first[1:] == last[:-1]).all()


def test_resampling_is_the_direct_filter():
    x = np.random.default_rng(1).normal(size=101).astype(np.float32)
    h = audio.phases()[:, ::-1].T.reshape(-1)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    direct = np.convolve(up, h)[: len(up)][:: audio.DOWN]
    assert np.allclose(audio.resample(x), direct, atol=1e-4)


def test_a_tone_lands_in_its_band_and_segments_follow_energy():
    t = np.arange(8000) / 6000
    low, high = audio.log_mel(np.sin(2 * np.pi * 200 * t))[0].mean(0).argmax(), audio.log_mel(np.sin(2 * np.pi * 2500 * t))[0].mean(0).argmax()
    assert low < high
    energy = np.array([0, 0, 2, 1, 1, 0.8, 0.2, 0, 0, 3, 0.4, 0, 0])
    assert audio.segments(energy) == [(2, 6), (9, 10)]


def test_audio_edges(edge, empty):
    rows = audio.described(audio.features(audio.store_media(edge))).collect()
    assert len(rows) == edge.count() and min(r.payload_bytes for r in rows) == 192
    same = {(r.n_bytes, r.payload_sha256): r.feature for r in rows}
    assert all(same[r.n_bytes, r.payload_sha256] == r.feature for r in rows)
    assert audio.described(audio.features(audio.store_media(empty))).count() == 0


def test_packing_is_the_same_in_each_run(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i % 700, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 200, 3000))], "id long, piece int, start long, length long, ids_crc32 long").repartition(5, "id")
    runs = [sorted(map(tuple, packing.pack(rows, capacity=256, block_pieces=500).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_equal_documents_of_the_store_spread_over_ranges(spark):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # it would join so few rows again
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    rows = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "if(id < 2900, '', 'one more text') as text")
    try:
        store = token_store.write_store(rows, BYTES)
    finally:
        spark.conf.set(coalesce, before)
    done = token_store.verify(spark, store).collect()
    assert len(done) == 3000 and len({r.start for r in done}) == 3000
    sizes = spark.read.parquet(store.recipes).groupBy("part").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2900


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_takes_the_best_of_all_open_bins(rule):
    """No open bin that fits scores better than the one a piece goes to."""
    rng = np.random.default_rng(9)
    lengths, capacity, max_docs, max_cost, weights = rng.integers(1, 300, 1500), 1024, 40, 300_000, (1.0, 0.5, 0.5)
    bins, offsets = packing.best_fit(lengths, capacity, max_docs, max_cost, weights=weights, rule=rule)
    room = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = [b for b, (t, d, c) in enumerate(room) if t >= n and d >= 1 and c >= n * n and min(t, d, c) > 0]
        if not fit:
            assert bins[i] == len(room)
            room.append([capacity, max_docs, max_cost])
        else:
            free, full = np.array([room[b] for b in fit], float), np.array([capacity, max_docs, max_cost], float)
            need = np.array([n, 1, n * n]) / full
            score = ((free / full - need) ** 2 @ weights) if rule == "norm" else -(free / full * need @ weights)
            assert bins[i] in fit and score[fit.index(bins[i])] <= score.min() + 1e-12
        b = int(bins[i])
        assert offsets[i] == capacity - room[b][0]
        room[b] = [x - y for x, y in zip(room[b], (n, 1, n * n))]
