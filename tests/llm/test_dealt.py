"""The ten dealt operators on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweave.llm import exact_dedup, language_id, lm_score, ngram_join, packing, poisson_mix, token_count, toxicity, warc, webp
from geoweave.llm.bytebpe import tokenizer_path
from geoweave.llm.lattice import Arcs, load_pieces, normalised, scores_as_weights

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, n long, token long, digest string"
LONG = "the quick brown fox jumps over it. " * 9000


def table(spark, texts, ids=None, langs=None, sources=None):
    n = len(texts)
    ids = list(range(1, n + 1)) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * n)[k], (sources or ["a"] * n)[k], len(t or ""), 0.5, 7, 7, 7, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["Same text", "same TEXT", None, "", "   ", "Straße Éa <|endoftext|> don't", "　\n\t x  y", LONG, "Same text", "one two"]
ODD_IDS = [5, 9, 3, 4, None, 6, 7, 8, 5, None]


def test_exact_dedup(spark):
    docs = table(spark, ODD, ODD_IDS)
    index = exact_dedup.new_index(spark)
    got = index.decide(index.ingest(docs)).collect()
    assert len(got) == len(ODD)
    by = {}
    for i, t in zip(ODD_IDS, ODD, strict=True):
        key = hashlib.sha256("".join(c.lower() if c.isascii() else c for c in t or "").encode()).hexdigest()
        by.setdefault(key, []).append(i)
    for r in got:
        ids = by[r.digest]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert all(sum(r.kept for r in got if r.digest == k) == 1 for k in by)
    # a later batch knows what the index has
    assert exact_dedup.deduplicated(table(spark, ["SAME text", "new"], [99, 100]), index).select("doc_id").collect() == [(100,)]
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.deduplicated(docs, index)
    assert kept.columns == docs.columns and kept.count() == len(by)
    assert exact_dedup.deduplicated(docs, index).count() == 0  # delivered again
    index.drop()
    assert kept.count() == len(by)
    assert exact_dedup.deduplicated(docs.limit(0), exact_dedup.new_index(spark)).count() == 0


def test_exact_dedup_query_in_batches(spark, tmp_path):
    table(spark, [f"T{i % 7}" if i % 3 else None for i in range(60)], [i or None for i in range(60)]).write.parquet(f"{tmp_path}/documents.parquet")
    tables = {t.name for t in spark.catalog.listTables()}
    got = exact_dedup.op4_exact_dedup(spark, str(tmp_path)).collect()
    want = {}
    for i in range(60):
        want.setdefault(f"t{i % 7}" if i % 3 else "", []).append(i)
    assert len(got) == 60
    for own in want.values():
        rows = [r for r in got if r.keep_id == max(own)]
        assert sorted(r.doc_id or 0 for r in rows) == own and {r.group_size for r in rows} == {len(own)} and [r.doc_id for r in rows if r.kept] == [max(own)]
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_poisson_mix(spark):
    n = 4000
    docs = table(spark, ["t"] * n, list(range(n)), sources=["big" if i % 4 else None if i % 8 else "small" for i in range(n)])
    got = poisson_mix.poisson_mix(docs, targets={"big": 0.5, "small": 0.5}, extra=True)
    c = Counter(r.source for r in got.select("source").collect())
    assert abs(c["big"] / n - 0.5) < 0.05 and abs(c["small"] / n - 0.5) < 0.05 and None not in c
    keys = [r[0] for r in got.select("__key").collect()]
    assert keys == sorted(keys)
    assert poisson_mix.poisson_mix(docs).columns == docs.columns
    assert poisson_mix.poisson_mix(docs.limit(0)).count() == 0
    for rate in (0.3, 1.0, 7.5, 900.0):
        cdf = poisson_mix.with_cdf(spark.range(1).select(F.lit("s").alias("__source"), F.lit(rate).alias("__rate"))).first()["__cdf"]
        want = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(len(cdf))])
        assert np.allclose(cdf, want, atol=1e-9) and cdf[-1] > 1 - 1e-9


def test_poisson_mix_rows_without_ids(spark):
    n = 4000
    docs = table(spark, [f"t{i % 50}" for i in range(n)], [None] * n, sources=["big" if i % 8 else "small" for i in range(n)])
    got = poisson_mix.poisson_mix(docs, targets={"big": 0.5, "small": 0.5}, extra=True).collect()
    c = Counter(r.source for r in got)
    assert abs(c["big"] / n - 0.5) < 0.05 and abs(c["small"] / n - 0.5) < 0.07 and len({r["__key"] for r in got}) > 0.99 * len(got)


def test_poisson_mix_query_mixes_whole_rows(spark, tmp_path, monkeypatch):
    table(spark, [f"text {i}" for i in range(40)]).write.parquet(f"{tmp_path}/documents.parquet")
    stored, staged = {}, poisson_mix.staged
    monkeypatch.setattr(poisson_mix, "staged", lambda df, name: stored.setdefault(name, staged(df, name)))
    got = poisson_mix.op6_poisson_mix(spark, str(tmp_path)).collect()
    whole = stored["mix-corpus"].select("doc_id", "__copy", "text", "lang", "n_chars").collect()
    assert sorted((r[0], r[1]) for r in whole) == sorted((r.doc_id, r.copy_no) for r in got) and len(got) > 0
    assert all(r.text == f"text {r.doc_id - 1}" and r.lang == "en" and r.n_chars == len(r.text) for r in whole)
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_token_count(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["'s", "'re", "'ll", "'ve", "'v", "'", " ", "  ", "\n", "　", "a", "re", "12", "é", "日本", "!!", "don't", "<|endoftext|>", "😀", "ß", "The", "x" * 90]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]
    got = token_count.token_counts(table(spark, texts, list(range(len(texts)))), limit=5).orderBy("doc_id").collect()
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [w > 5 for w in want]
    assert token_count.token_counts(table(spark, []), limit=5).count() == 0


def test_token_count_tables_fill_up_and_chunks_compose():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = [" ".join(letters(24) for _ in range(9000)), " ".join(letters(24) for _ in range(4000)), letters(150_000), "x" * 40_000, " " * 30_000, "é" * 9000, "ab" * 30_000, None]
    library, counter = Tokenizer.from_file(path), token_count.TokenCounter(path, 1 << 15)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert counter.count_column(pa.array(texts)).tolist() == want
    assert [int(counter.count_column(pa.array([t], pa.string()))[0]) for t in texts] == want
    assert counter.built <= 1 << 15


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ODD + [LONG[: 50 * k] for k in range(1, 60)]
    docs = table(spark, texts, list(range(len(texts))))
    got = packing.pack_documents(docs).collect()
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(texts)}
    for i, own in ids.items():
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(own)
        at = 0
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            assert r.piece == 0 or r.length == 2048
            at += r.length
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(map(len, ids.values())) // 2048) + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert packing.pack_documents(table(spark, [None, None], [None, None])).count() == 2


@pytest.mark.parametrize("steps", [4, 256, 100000])
def test_packing_plan_places_all(steps):
    rng = np.random.default_rng(steps)
    sizes, n = np.unique(rng.integers(1, 2049, 40000), return_counts=True)
    plan = packing.packing_plan(dict(zip(sizes.tolist(), n.tolist(), strict=True)), steps=steps)
    for s, c in zip(sizes.tolist(), n.tolist(), strict=True):
        own = plan[plan.length == s]
        ranks = np.concatenate([np.arange(r.first, r.first + r.n) for r in own.itertuples()])
        assert sorted(ranks) == list(range(c))
    used = {}
    for r in plan.itertuples():
        for k in range(r.sequence_id, r.sequence_id + r.n):
            assert used.get(k, 0) == r.offset
            used[k] = used.get(k, 0) + r.length
    assert max(used.values()) <= 2048
    assert len(used) <= 1.15 * int((sizes * n).sum()) / 2048 + 40


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_rule(seed):
    # pieces that are placed at once go where they would go one by one, but for ties
    rng, capacity = np.random.default_rng(seed), 12
    sizes = sorted(rng.integers(1, capacity, 150).tolist(), reverse=True)
    bins = packing.Bins(capacity)
    at = 0
    while at < len(sizes):
        gap, m = bins.best(sizes[at])
        m = min(m, sizes.count(sizes[at]) - sizes[:at].count(sizes[at]), 10**6 if gap == capacity else int(bins.count[gap]))
        for _ in range(m):
            least = min(1 + 2 * int(bins.count[g - sizes[at]]) * (g > sizes[at]) - (g == sizes[at]) + (1 - 2 * int(bins.count[g]) if g < capacity else 0) for g in range(sizes[at], capacity + 1) if g == capacity or bins.count[g])
            before = int((bins.count**2).sum())
            bins.put(gap - sizes[at], bins.take(gap, 1))
            assert int((bins.count**2).sum()) - before == least
            at += 1
    assert packing.packing_plan({6: 1, 7: 1, 3: 1}, 10).sort_values("length").offset.tolist() == [7, 0, 0]


def test_packing_repeated_rows_and_white_space(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a b", "a b", None] + [c * 300_000 for c in (" ", "\n", "\t", "\u3000")] + [" " * 1_500_000]
    got = packing.pack_documents(table(spark, texts, [1, 1, None, 4, 5, 6, 7, 8])).collect()
    assert len({r.row for r in got}) == len(texts) and len({(r.row, r.piece) for r in got}) == len(got)
    for i, t in zip([4, 5, 6, 7, 8], texts[3:], strict=True):
        assert sum(r.length for r in got if r.doc_id == i) == len(library.encode(t, add_special_tokens=False).ids) + 1


def test_webp(spark):
    texts = [*ODD[:7], LONG[:70000], "a" * 576, "b" * 577]
    got = webp.media_columns(table(spark, texts, list(range(len(texts)))), keep_media=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert webp.load(bytes(r.media)).tobytes() == want and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert webp.media_columns(table(spark, [])).count() == 0


def test_webp_transforms():
    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (5, 3), (19, 34)):
        smooth = (np.cumsum(np.cumsum(rng.integers(-2, 3, (h, w, 4)), 0), 1) & 255).astype(np.uint8)
        few = rng.choice(np.array([[1, 2, 3, 4], [9, 9, 9, 255], [0, 0, 0, 0]], np.uint8), (h, w))
        for image in (smooth, few):
            blocks = (-(-h >> 2), -(-w >> 2))
            predict = (webp.PREDICTOR, 2, rng.integers(0, 14, blocks))
            cross = (webp.CROSS_COLOUR, 2, rng.integers(0, 1 << 24, blocks) | 0xFF000000)
            for transforms in ((), (predict,), (cross,), ((webp.SUBTRACT_GREEN,),), (predict, cross, (webp.SUBTRACT_GREEN,)), *([((webp.PALETTE,),)] if image is few else [])):
                for cache in (0, 5):
                    assert (webp.decode(webp.encode(image, transforms, cache)) == image).all()


def test_webp_picks_what_an_image_gains_from():
    rng = np.random.default_rng(6)
    smooth = np.cumsum(np.cumsum(rng.integers(-2, 3, (40, 192, 3)), 0), 1).astype(np.uint8).tobytes()
    repeats = b"".join(rng.choice([bytes(rng.integers(0, 256, 3).astype(np.uint8)) for _ in range(40)], 192 * 20).tolist())
    grey = np.repeat(rng.integers(0, 256, 192 * 20), 3).astype(np.uint8).tobytes()
    kinds = set()
    for payload in (smooth, repeats, grey, "Простой текст на русском языке, повторы и повторы. ".encode() * 300):
        payload = payload[: len(payload) // 576 * 576]
        media = webp.store(payload)
        assert webp.load(media).tobytes() == payload
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 192, 3)
        argb = np.ascontiguousarray(np.concatenate((pixels[..., ::-1], np.full((*pixels.shape[:2], 1), 255, np.uint8)), axis=2)).view("<u4")[..., 0]
        picked = webp.chosen(argb)
        kinds.add(picked[0][0] if picked else None)
        assert len(media) <= len(webp.encode(np.concatenate((pixels, np.full((*pixels.shape[:2], 1), 255, np.uint8)), axis=2))) + 64
    assert {webp.PREDICTOR, webp.SUBTRACT_GREEN} <= kinds


def test_webp_rejects_cut_files():
    data = webp.store(b"hello world " * 48)
    with pytest.raises(ValueError):
        webp.decode(data[:60])


def webp_payloads():
    rng = np.random.default_rng(11)
    words = [w.encode() for w in LONG.split()[:9] + ["Straße", "naïve", "Жук", "42", "\n", " " * 40]]
    texts = [b" ".join(words[k] for k in rng.integers(0, len(words), n)) for n in rng.integers(0, 700, 120).tolist()]
    texts += [bytes(rng.choice(list(b"qxzjkvwQXZJK#@~^"), n).tolist()) * 9 for n in (5, 60, 200, 900)]  # codes of their own
    texts += [b"".join(rng.choice([b"abc", b"xyz", b"QQQ", b"~~~"] + [bytes([97 + k, 98, 99]) for k in range(20)], 3000).tolist())]  # colour cache
    texts += [b"", b"a", b"x" * 40000, b"y, z " * 20 + b" " * 30000 + b"end", bytes(range(256)) * 9, rng.integers(0, 256, 5000).astype(np.uint8).tobytes()]
    texts += [t * 30 for t in texts[:2]] + ["Простой текст на русском языке. ".encode() * 99]
    return [t.ljust(max(1, -(-len(t) // 576)) * 576, b"\xff") for t in texts]


def test_webp_side_by_side(monkeypatch):
    payloads = webp_payloads()
    media = webp.store_many(payloads)
    assert media == [webp.store(p) for p in payloads] == [webp.store_many([p])[0] for p in payloads]
    read = webp.load_many(media)
    assert [x.tobytes() for x in read] == payloads == [x.tobytes() for m in media for x in webp.load_many([m])]
    assert webp.store_many([]) == webp.load_many([]) == []
    # most of them don't take the way of single images, those with a colour cache neither
    lanes = [lane for i, m in enumerate(media) if (lane := webp.lane_of(i, m))]
    assert len(lanes) > len(media) - 12 and {lane.cache_bits > 0 for lane in lanes} == {True, False}
    assert all(x is not None for x in webp.Lanes(lanes).read())
    # what the side-by-side decoder doesn't know
    rng = np.random.default_rng(5)
    image = rng.integers(0, 9, (7, 192, 4)).astype(np.uint8)
    image[..., 3] = 255
    transforms = ((webp.PREDICTOR, 2, rng.integers(0, 14, (2, 48))), (webp.SUBTRACT_GREEN,))
    odd = [webp.encode(image, t, c) for t in ((), transforms) for c in (0, 1, 7, 11)]
    assert all((x == image[..., :3].reshape(-1)).all() for x in webp.load_many(odd + media[:60])[: len(odd)])
    for cut in (media[3][:-40], media[3][:45]):
        with pytest.raises(ValueError):
            webp.load_many([*media[:60], cut])
    monkeypatch.setattr(webp, "TABLES", 5000)  # in several goes
    assert [x.tobytes() for x in webp.load_many(media)] == payloads


def test_webp_codes():
    rng = np.random.default_rng(13)
    for n in (2, 3, 40, 256, 2328):
        lengths = webp.code_lengths(rng.geometric(0.01, n))
        symbols, codes = webp.canonical(lengths)
        # in reading order no code begins another, and codes of one length ascend with their symbols
        bits = [f"{c:0{lengths[s]}b}"[::-1] for s, c in zip(symbols.tolist(), codes.tolist(), strict=True)]
        assert bits == sorted(bits) and not any(b.startswith(a) for a, b in zip(bits, bits[1:], strict=False))
        table = webp.Code(lengths).table
        assert all(table[c] == s << 4 | int(lengths[s]) for s, c in zip(symbols.tolist(), codes.tolist(), strict=True))
    for lengths in ([1] * 3, [1] * 5, [2, 2, 2], [15] * 40):
        with pytest.raises(ValueError):
            webp.Code(np.array(lengths, np.uint8))


def test_webp_side_by_side_takes_half_the_time():
    rng = np.random.default_rng(12)
    payloads = [(LONG[k : k + n]).encode().ljust(-(-n // 576) * 576, b"\xff") for k, n in rng.integers(1, 3000, (600, 2)).tolist()]

    def took(f):
        at = time.process_time()
        f()
        return time.process_time() - at

    one = min(took(lambda: [webp.load(webp.store(p)) for p in payloads]) for _ in range(2))
    assert min(took(lambda: webp.load_many(webp.store_many(payloads))) for _ in range(2)) < one / 2


def test_webp_many_rows():
    # 16411 rows (prime) need two columns of rows, the last half filled up
    payload = np.random.default_rng(1).integers(97, 105, 576 * 16411).astype(np.uint8).tobytes()
    assert webp.load(webp.store(payload)).tobytes() == payload


def test_warc(spark):
    big = "x" * 1000 + "é"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/ b", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (2, None, big), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = warc.new_folder(spark, "warc-test")
    manifest = warc.write_warc(pages, folder, archive_bytes=2000)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_warc(manifest, folder).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(i, "response" if i == 9 or t != big else "revisit", 9 if t == big and i != 9 else None, len((t or "").encode()), sha(t or "")) for i, _, t in rows]
    assert got == sorted(want, key=str)
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder), folder).count() == 0
    records = [warc.record(i, "u", f"<p>{i} and some more text {i % 7}</p>".encode() * 20, "d", None, False) for i in range(300)]
    data = warc.write_archive(records)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and len(list(warc.read_archive(data))) == 300


def test_warc_dictionary_learns_from_whole_records(monkeypatch):
    records, seen = [bytes([65 + i % 26]) * (200 << 10) for i in range(20)], []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, samples, **_: seen.extend(samples))
    warc.train(records)
    assert seen == records


def word(rng, parts):
    return "".join(rng.choice(parts) for _ in range(rng.randrange(2, 5)))


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"aa": ["ta", "ko", "mi", "ra"], "bb": ["sch", "ung", "ein", "er"]}
    langs = [rng.choice(["aa", "bb"]) for _ in range(300)]
    texts = [" ".join(word(rng, parts[x]) for _ in range(30)) for x in langs]
    models = language_id.train(table(spark, [*texts[:200], None, "zzz"], langs=[*langs[:200], "aa", None]))
    got = language_id.predict(table(spark, [*texts[200:], None, "", "12 -- 3"], langs=["zz"] * 103), models).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:100]] == langs[200:]
    assert [(r.lang_pred, r.score) for r in got[100:]] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.train(table(spark, [])) == []
    assert language_id.predict(table(spark, ["abc"]), []).first().lang_pred == "und"


def test_lattice_sums_all_segmentations():
    pieces = load_pieces()
    logp = np.log(np.random.default_rng(0).random(len(pieces.names)) * 0.1)
    index = {n: i for i, n in enumerate(pieces.names)}

    def total(s):
        return sum((math.exp(logp[index[s[:k]]]) * (total(s[k:]) if k < len(s) else 1.0) for k in range(1, len(s) + 1) if s[:k] in index), 0.0)

    words = [w.encode() for w in ("the", "a", "straße", "", "日本", "running", "x" * 12)]
    arcs = Arcs(pieces, words)
    alpha = arcs.forward(logp)
    assert np.allclose(alpha[arcs.goal], [math.log(total(b" " + w)) for w in words])
    assert np.allclose(arcs.backward(logp)[arcs.origin], alpha[arcs.goal])
    # the two draws are distributions: all pieces that begin words, all others with the end
    logp, end = normalised(pieces, scores_as_weights(pieces), 10.0)
    assert abs(np.exp(logp[pieces.first]).sum() - 1) < 1e-9 and abs(np.exp(logp[~pieces.first]).sum() + math.exp(end) - 1) < 1e-9


def test_lm_scores(spark):
    rng = random.Random(2)
    texts = [" ".join(word(rng, ["ta", "Ko", "mi", "ra", "s"]) for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, "", "unseen-zzz \x85 ta"]
    docs = table(spark, texts, [*range(len(texts) - 1), None]).withColumn("held_out", F.col("doc_id") % 3 == 0).fillna({"held_out": False})
    got = {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    split = {i: (t or "").encode().lower().split() for i, t in zip([*range(len(texts) - 1), None], texts, strict=True)}
    c = Counter()
    for i, ws in split.items():
        if i is None or i % 3:
            c.update([*ws, b""])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, ws in split.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(c[w] > 0 for w in [*ws, b""]), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, b""])) < 1e-6
        assert math.isfinite(r.score) and r.score < 0
    assert lm_score.lm_scores(docs.limit(0)).count() == 0
    assert abs(float(lm_score.log_gamma(np.array([0.001]))[0]) - math.lgamma(0.001)) < 1e-9


def test_lm_scores_against_brute_force(spark):
    """Both scores from the formulas, with every segmentation written out."""
    texts, held = ["ta ko ta", "ko mi mi", "ta", None, "raZZ ta ra ta", "ko é\u00a0x"], [False, False, False, False, True, True]
    docs = table(spark, texts).withColumn("held_out", F.element_at(F.array(*map(F.lit, held)), F.col("doc_id").cast("int")))
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, strength=50.0, rounds=0).collect()}
    words = [(t or "").encode().lower().split() for t in texts]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v, ends = sum(c.values()), len(c), held.count(False)
    ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
    pieces = load_pieces()
    logp, end = normalised(pieces, scores_as_weights(pieces) * v, v)
    weight = dict(zip(pieces.names, np.exp(logp).tolist(), strict=True))
    paths = lambda x: sum((weight[x[:k]] * (paths(x[k:]) if k < len(x) else 1.0) for k in range(1, len(x) + 1) if x[:k] in weight), 0.0)
    spelled = lambda w: paths(b" " + w) * math.exp(end)
    share = lambda w: max(c[w] - discount, 0) / n + discount * v / n * spelled(w)
    p_end, mu = (ends + 1) / (n + ends + 2), 50.0
    for i, ws in enumerate(words):
        around = len(ws) * math.log(1 - p_end) + math.log(p_end)
        mixed = math.lgamma(mu) - math.lgamma(mu + len(ws)) + sum(math.lgamma(mu * share(w) + m) - math.lgamma(mu * share(w)) for w, m in Counter(ws).items())
        assert abs(got[i + 1].score - (mixed + around) / math.log(10)) < 1e-6
        assert abs(got[i + 1].lattice_score - (sum(math.log(spelled(w)) for w in ws) + around) / math.log(10)) < 1e-6


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return {ids[i]: (len(sets[i]), min(ids[j] for j in range(len(sets)) if find(j) == find(i))) for i in range(len(sets))}


def test_ngram_join(spark):
    rng = random.Random(4)
    texts = [None, "", "one", "One", "one two", "a b c", "A b  c", LONG[:4000]]
    for _ in range(12):
        base = [word(rng, ["ta", "ko", "mi", "ra", "lo", "pe"]) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = word(rng, ["zu", "xe", "vo"])
            texts.append(" ".join(own))
    ids = list(range(1000, 1000 - len(texts), -1))
    got = ngram_join.near_components(table(spark, texts, ids)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, ids)
    assert ngram_join.near_components(table(spark, [])).count() == 0
    odd = ngram_join.near_components(table(spark, ["a b c", "a b c", "a b c", "x"], [None, 5, 5, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in odd) == [(0, 0), (0, 5), (5, 5), (5, 5)]


def test_ngram_join_long_lists(spark, monkeypatch):
    """A group of near copies that don't all link, over several blocks."""
    rng = random.Random(6)
    base = [word(rng, ["ta", "ko", "mi", "ra", "lo", "pe"]) for _ in range(90)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            own[rng.randrange(len(own))] = word(rng, ["zu", "xe", "vo"])
        texts.append(" ".join(own))
    ids = list(range(1, len(texts) + 1))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = ngram_join.near_components(table(spark, texts, ids)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, ids)


def test_ngram_join_words_that_polynomial_hashes_confuse(spark):
    one = ["ab"[bin(i).count("1") % 2] for i in range(1024)]
    other = ["ba"[bin(i).count("1") % 2] for i in range(1024)]
    texts = ["".join(one), "".join(other), "".join(one[:64]), "".join(other[:64]), "".join(one), "w" * 65, "w" * 66]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(table(spark, texts)).collect()}
    assert got == brute_components(texts, list(range(1, 8))) and got[2] == (1, 2) and got[5] == (1, 1)


def test_toxicity(spark):
    rng = random.Random(8)
    bad, rows, labels = ["grumble", "grumbly", "snarkle"], [], []
    for i in range(600):
        words = [word(rng, ["ta", "ko", "mi", "ra", "lo"]) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", ".", "ish"])
        rows.append(" ".join(words))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs = table(spark, rows, list(range(600)))
    truth = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.learnable(docs), truth)
    got = toxicity.scored(docs, model, name="s").select("doc_id", "s").collect()
    assert sum((r.s >= 0.5) == (r.doc_id % 6 == 0) for r in got) >= 595
    odd = toxicity.scored(table(spark, [None, "", LONG]), model, name="s").collect()
    assert all(0 <= r.s < 0.5 for r in odd)
    assert toxicity.train(docs.limit(0), truth) is None
    assert toxicity.scored(docs, None, name="s").filter("s <> 0").count() == 0


def test_toxicity_risk_against_brute_force():
    """The risk written out document by document, and that the fit can't be bettered by moving one weight."""
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(1, 30, 8)).astype(np.uint32) for _ in range(400)]
    positive, unlabelled, prior = [np.union1d(t, [np.uint32(50)]) if i % 2 else np.union1d(t, [np.uint32(51)]) for i, t in enumerate(texts[:60])], texts[60:], 0.1
    unlabelled[:20] = [np.union1d(t, [np.uint32(50)]) for t in unlabelled[:20]]
    model = toxicity.fit(positive, unlabelled, prior)
    table = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    z = lambda d: model.bias + sum(table.get(int(f), 0.0) for f in d)
    loss = lambda x: math.log1p(math.exp(-x))
    plus = prior * sum(loss(z(d)) for d in positive) / len(positive)
    minus = sum(loss(-z(d)) for d in unlabelled) / len(unlabelled) - prior * sum(loss(-z(d)) for d in positive) / len(positive)
    got = toxicity.risk_of(model, positive, unlabelled, prior)
    assert abs(got[0] - plus) < 1e-9 and abs(got[1] - minus) < 1e-9 and minus > -0.01
    assert {50, 51} <= set(table) and all(z(d) > 0 for d in positive[:2]) and max(z(d) for d in unlabelled[20:]) < 0
    total = lambda m: (lambda a, b: a + max(0.0, b))(*toxicity.risk_of(m, positive, unlabelled, prior)) + 5e-5 * float((m.weights**2).sum())
    for i in range(len(model.weights)):
        for step in (-1.0, 1.0):
            other = toxicity.Classifier(model.features, model.weights + step * (np.arange(len(model.weights)) == i), model.bias)
            assert total(other) >= total(model) - 1e-3


def test_language_posterior_against_brute_force(spark):
    """Each language's likelihood over all segmentations, written out."""
    pieces, rng = load_pieces(), np.random.default_rng(4)
    models = []
    for lang, share in (("aa", 0.75), ("bb", 0.25)):
        logp, end = normalised(pieces, rng.random(len(pieces.names)), 10.0)
        models.append((lang, share, logp, end))
    texts = ["Hello there, world", "x1 straße", "a", "b b b b b"]
    got = language_id.predict(table(spark, texts), models).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        words = [w.encode() for w in language_id.words_of(t)]
        logs = []
        for _, share, logp, end in models:
            weight = dict(zip(pieces.names, np.exp(logp).tolist(), strict=True))
            paths = lambda x, weight=weight: sum((weight[x[:k]] * (paths(x[k:], weight) if k < len(x) else 1.0) for k in range(1, len(x) + 1) if x[:k] in weight), 0.0)
            logs.append(math.log(share) + sum(math.log(paths(b" " + w)) + end for w in words))
        best = int(np.argmax(logs))
        p = [math.exp((x - max(logs)) / math.sqrt(len(words))) for x in logs]
        assert r.lang_pred == models[best][0] and abs(r.score - p[best] / sum(p)) < 1e-9
