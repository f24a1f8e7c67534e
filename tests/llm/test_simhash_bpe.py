from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duskveil.llm import bpe, common, linkage, simhash

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_fp(text: str, k: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) <= k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(docs, none):
    got = {(r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(docs).collect()}
    assert got == {(r.doc_id, brute_fp(r.text, 4)) for r in docs.collect()}
    assert simhash.simhash_classes(none).count() == 0


def test_classes_against_brute_force(spark):
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(6)]
    fps = {0}
    for b in bases:
        for _ in range(25):
            x = b
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = brute_components(near, len(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    for block in (3, 2048):
        table = df.selectExpr("fp").select(simhash.F.explode(simhash.ball_keys(simhash.F.col("fp"))).alias("key"), simhash.F.col("fp").alias("id"))
        links = linkage.bucket_links(table, simhash._within(4), block)
        got = {r.id: r.root for r in linkage.components(links).collect()}
        groups = {}
        for i, x in enumerate(signed):
            groups.setdefault(want[i], set()).add(got.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_whole_query(docs):
    rows = docs.collect()
    fps = [brute_fp(r.text, 4) for r in rows]
    comp = brute_components([(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], len(rows))
    low = {}
    for r, c in zip(rows, comp):
        if r.doc_id is not None:
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", low.get(c)) for r, f, c in zip(rows, fps, comp))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_classes(docs).collect())
    assert got == want


def test_near_classes_and_dedup(spark, docs):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [0, 2, 5, 8, 9, 10, 11, 13, None]  # 2, 3 and 4 have no words; 5, 6 and 7 are near copies
    words = [f"w{i}" for i in range(300)]
    changed = words[:150] + ["other"] + words[151:]
    far = [f"v{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate([words, changed, far, words])], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == [0, 2]


def test_near_classes_at_the_limit(spark, monkeypatch):
    """Pairs of a similarity just over and just under 0.8 are told apart on their whole sets, whatever the cut in blocks."""
    rng = random.Random(11)
    texts = []
    for base in range(60):
        n = rng.choice([12, 40, 90, 200, 400, 900])
        words = [f"b{base}w{i}" for i in range(n)]
        texts.append(words)
        for v in range(3):
            cut = rng.randrange(round(0.16 * n), round(0.25 * n) + 1)
            texts.append([*words[: n - cut], *([] if v else [f"b{base}v{v}x{i}" for i in range(rng.randrange(3))])])
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    same = lambda a, b: len(a & b) / len(a | b)
    of = {(i, j): same(sets[i], sets[j]) for i in range(len(texts)) for j in range(i // 4 * 4, i)}
    assert sum(0.75 <= s < 0.8 for s in of.values()) > 20 and sum(0.8 <= s < 0.85 for s in of.values()) > 20
    want = brute_components([p for p, s in of.items() if s >= 0.8], len(texts))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for size in (2000, 16 << 20):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", size, raising=False)
        got = {r.doc_id: r.component_id for r in simhash.near_classes(df).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_minwise_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 800, dtype=np.uint64)
    b = np.concatenate([a[:720], rng.integers(0, 2**63, 80, dtype=np.uint64)])
    p = simhash._probes()
    assert abs((simhash.minwise(a, p) == simhash.minwise(b, p)).mean() - 720 / 880) < 0.12


NASTY = ["", " ", "a", "it's we'll I'D", "  two  spaces \n\n tabs\t\tend  ", "<|endoftext|>", "x<|endoftext|> y", "日本語テキスト 😀😀", "a" * 3000, "1234567890" * 50, "don’t — “q” …", "  x", "\r\n\r\n ", "!!!???###", "word " * 400]


def test_encoding_equals_library():
    t, enc = Tokenizer.from_file(PATH), bpe.encoding(PATH)
    for x in NASTY:
        ids = t.encode(x, add_special_tokens=False).ids
        assert bpe.encode(enc, x.encode()).tolist() == ids
        assert enc.decode(ids) == t.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*NASTY, " the cat", "'s", "  ", "\n", "é", "Z z", "'", "l", "<|endof", "text|>"]), max_size=12), st.lists(st.integers(0, 400), max_size=6))
def test_joins_are_exact(parts, cuts):
    enc = bpe.encoding(PATH)
    raw = "".join(parts).encode()
    ends = sorted({bpe._whole(raw, min(c, len(raw))) for c in cuts} | {len(raw)} - {0})
    pieces = [bpe.encode(enc, raw[a:b]) for a, b in zip([0, *ends], ends) if b > a]
    assert bpe.joined(enc, pieces).tolist() == bpe.encode(enc, raw).tolist()


def test_chunks_cover_texts():
    raw = ("Ünï " * 9000 + "x" * 40000).encode()
    ends = bpe.chunks_of(raw)
    assert ends[-1] == len(raw) and all(b > a for a, b in zip([0, *ends], ends))
    b"".join(raw[a:b] for a, b in zip([0, *ends], ends)).decode()
    for a, b in zip([0, *ends], ends):
        raw[a:b].decode()


def test_documents(spark, docs, none):
    shared = " ".join(f"passage{i} of many words" for i in range(900))
    rows = [(i, f"start {i} " + shared + f" end {i}", "x") for i in range(6)] + [(0, "start 0 " + shared + " end 0", "x")]
    more = spark.createDataFrame(rows, "doc_id long, text string, seq string")
    t = Tokenizer.from_file(PATH)
    for df in (docs, more):
        want = sorted((str(r.doc_id), len(i := t.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in df.collect())
        for most in (0, 200_000):
            got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encoded(df, PATH, most), PATH).collect())
            assert got == want
    assert bpe.shared_chunks(more).count() > 3
    assert bpe.encoded(none, PATH).count() == 0
    assert {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()}[9] == docs.where("doc_id = 9").first().text


def test_hot_keys_lie_in_many_tasks(spark, monkeypatch):
    """One key on 60,000 of 90,000 rows: blocks are right at the edges of partitions, and one leader stands for a block."""
    rows = [(7, i) for i in range(60_000)] + [(8 + i % 14_000, i) for i in range(30_000)] + [(3, 1), (3, 1), (3, 5)]
    table = spark.createDataFrame(rows, "key long, id long").repartition(8)
    got = linkage.blocks_of(table, 512).toPandas()
    hot = got[got.key == 7]
    assert sorted(hot.id) == list(range(60_000)) and set(hot["last"]) == {117} and hot.groupby("block").size().max() == 512
    assert sorted(got[got.key == 3].id) == [1, 1, 5] and len(got) == 90_003
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins small partitions
    kept, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, what: kept.append(stored(df, what)) or kept[-1])
    assert linkage.blocks_of(table, 512).count() == 90_003
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in kept[0].groupBy("part").count().collect()) < 40_000
    seen = spark.sparkContext.accumulator(0)

    def near_of(ids, _):
        def near(i, others):
            seen.add(len(others))
            return (ids[others] % 3000 == 0) == (ids[i] % 3000 == 0)

        return near

    links = linkage.bucket_links(table.where("key = 7"), near_of, 512)
    roots = {r.id: r.root for r in linkage.components(links).collect()}
    assert all(roots.get(i, i) == int(i % 3000 > 0) for i in range(60_000)) and seen.value < 60_000 * 200  # of 3.6 * 10^9 pairs
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    joined = common.hot_join(table, spark.createDataFrame([(7, "a"), (8, "b")], "key long, name string"), "key", "left")
    assert joined.count() == 90_003 and joined.where("name = 'a'").count() == 60_000 and joined.where("name = 'b'").count() == sum(k == 8 for k, _ in rows)
