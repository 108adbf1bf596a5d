"""Text operators against brute force and exact rules, on small fixtures with nulls, empty texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cityloom.llm import bpe, hamming, orderhash, packing, quality, secrets, sharding, simhash, substrings, transcripts
from cityloom.llm.queries import vocabulary_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block string, length string, key string"


def documents(spark, texts):
    """One row per text, in order; the last columns clash with names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "b", "l", "k") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "éclair", "the", "of", "password=abcdef1", "it's", "ß"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    texts += [None, "", "   ", "x", "<|endoftext|> a", texts[3], texts[3], texts[3] + " tail", "z" * 5000]
    rows = list(enumerate(texts))
    return rows + [rows[5], rows[5], (None, texts[4]), (None, None)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def vocab(spark):
    return bpe.vocabulary(spark, vocabulary_path())


def test_bpe_equals_the_library(spark, corpus, tokenizer, vocab):
    rows = bpe.decode(bpe.encode(documents(spark, corpus), vocab), vocab).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_on_odd_characters(tokenizer):
    own = bpe.WordBpe(open(vocabulary_path()).read())
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(1, 0x250), 0x300, 0x3A3, 0x2019, 0x2028, 0x200B, 0x4E2D, 0x1F600]] + ["'s", "'ll", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_whole(spark, corpus, tokenizer, vocab):
    items = packing.pieces(documents(spark, corpus), vocab, capacity=64)
    packed = packing.pack(items, capacity=64).collect()
    want = Counter()
    for i, t in corpus:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(r.length for r in packed) // 64) + 3


def test_packing_plan_beats_or_equals_best_fit():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        counts = np.bincount(rng.integers(1, 101, n), minlength=101)
        plan = packing.plan(counts, 100, rounds=40)
        lengths = np.repeat(np.arange(101), counts)
        if n:
            sequences, _ = plan.place(lengths, np.concatenate([np.arange(c) for c in counts]))
            assert len(set(sequences.tolist())) <= sum(c for _, c in packing.best_fit(counts, 100))


def test_packing_program_places_most_items_of_many_lengths(monkeypatch):
    rng = np.random.default_rng(8)
    lengths = np.minimum(1 + rng.exponential(500, 9000).astype(int), 2047)
    counts = np.bincount(lengths, minlength=2049)
    assert (counts > 0).sum() > 1000 and (counts[1025:] > 0).sum() > 300
    plain, best_fit, handed = packing.best_fit(counts, 2048), packing.best_fit, []

    def watched(left, capacity):
        handed.append((int(left.sum()), best_fit(left, capacity)))
        return handed[-1][1]

    monkeypatch.setattr(packing, "best_fit", watched)
    chosen = packing.configurations(counts, 2048)
    places = lambda held: {(tuple(map(tuple, parts.tolist())), copies) for parts, copies in held}
    used = [left for left, tail in handed if left < len(lengths) and places(tail) <= places(chosen)]
    assert used and min(used) < len(lengths) / 4  # the rest stands in configurations of the program
    assert sum(copies for _, copies in chosen) <= sum(copies for _, copies in plain)
    held = np.zeros_like(counts)
    for parts, copies in chosen:
        assert (parts[:, 0] * parts[:, 1]).sum() <= 2048
        np.add.at(held, parts[:, 0], parts[:, 1] * copies)
    assert (held == counts).all()


def test_simhash_groups_equal_brute_force(spark, corpus):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(documents(spark, corpus), crowd=3).collect())

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fingerprint(t)) for i, t in corpus]
    reach, want = list(range(len(prints))), Counter()

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                reach[root(a)] = root(b)
    for n, (i, p) in enumerate(prints):
        ids = [prints[m][0] for m in range(len(prints)) if root(m) == root(n) and prints[m][0] is not None]
        want[i, p - (1 << 64) if p >> 63 else p, min(ids, default=None)] += 1
    assert got == want


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_near_fingerprints_link_in_crowded_signatures(spark, radius):
    for segment in range(len(simhash.segments(radius))):
        begin, width = simhash.segments(radius)[segment]
        parts = simhash.free_parts(segment, radius)
        assert len(parts) > radius and sorted(b for at, n in parts for b in range(at, at + n)) == [b for b in range(64) if not begin <= b < begin + width]
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False)) for _ in range(300)} | {centre}
    signed = [p - (1 << 64) if p >> 63 else p for p in near]
    prints = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    for crowd in (10, 10_000):
        links = simhash.near_links(prints, radius, crowd).collect()
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= radius for a, b in links)
        group, todo = {signed[0]}, [signed[0]]
        beside = {}
        for a, b in links:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
        while todo:
            for x in beside.get(todo.pop(), set()) - group:
                group.add(x)
                todo.append(x)
        assert group == set(signed)  # all lie within the radius of the centre, which is there


def test_substrings_equal_brute_force(spark, corpus):
    rows = [(i, t) for i, t in corpus] + [(900, " ".join(f"w{n}" for n in range(200))), (901, "q " + " ".join(f"w{n}" for n in range(50, 160)))]
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[j:j + 5]) for w in words for j in range(len(w) - 4))
    want = Counter()
    for (i, _), w in zip(rows, words):
        gone = {j + k for j in range(len(w) - 4) if seen[tuple(w[j:j + 5])] > 1 for k in range(5)}
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = substrings.repeats(documents(spark, rows), window=5).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    longest = {r.doc_id: r.longest for r in got}
    for (i, _), w in zip(rows, words):  # every level by itself
        level, most = 5, 0
        while len(w) >= level:
            ends = Counter(tuple(x[j:j + level]) for x in words for j in range(len(x) - level + 1))
            most = level if any(ends[tuple(w[j:j + level])] > 1 for j in range(len(w) - level + 1)) else most
            level *= 2
        assert i is None or longest[i] == most
    assert longest[900] == longest[901] == 80 and all((r.longest > 0) == (r.n_removed > 0) for r in got)


@pytest.mark.parametrize("window, first", [(1, None), (2, None), (7, 1), (8, 3), (8, 8), (9, 2)])
def test_levels_decide_as_brute_force(spark, window, first):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, window - 1, window, 40]))) for _ in range(60)] + [None, "b", "b"]
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[j:j + window]) for w in words for j in range(len(w) - window + 1))
    want = Counter()
    for i, w in enumerate(words):
        gone = {j + k for j in range(len(w) - window + 1) if seen[tuple(w[j:j + window])] > 1 for k in range(window)}
        want[i, len(w), len(gone), " ".join(x.decode() for n, x in enumerate(w) if n not in gone)] += 1
    got = substrings.remove_repeats(documents(spark, list(enumerate(texts))), window=window, first=first).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


def test_levels_double_up_to_the_window():
    assert substrings.level_lengths(35) == [18, 35] and substrings.level_lengths(35, 9) == [9, 18, 35]
    assert substrings.level_lengths(1) == [1] and substrings.level_lengths(8, 20) == [8]
    # windows of which a half does not repeat are no candidates of the next level
    starts, flat = np.array([0, 6, 12]), np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 8, 9], np.uint64) * np.uint64(12345677)
    told = substrings.announce(0, substrings.candidates(flat, starts, [2, 4], [], 3)[1], 3, substrings.BEFORE)
    assert sum(len(x) for x in told.column("numbers").to_pylist()) == 6 * 7
    places, hashes = substrings.candidates(flat, starts, [2, 4], [substrings.answer(told, substrings.BEFORE)], 3)
    assert places.tolist() == [0, 6] and hashes.shape == (2, 2)


def test_one_equal_stream_is_no_repeat():
    first = np.array([7, 7, 9, 9], np.uint64) << np.uint64(60)
    both = np.stack([first, np.array([1, 2, 3, 3], np.uint64) << np.uint64(32)])
    told = substrings.announce(5, both, 4, substrings.DECIDES)
    said = substrings.answer(told, substrings.DECIDES)
    assert substrings.repeated(both, said, 4).tolist() == [False, False, True, True]
    assert substrings.repeated(first[None], substrings.answer(substrings.announce(5, first[None], 4)), 4).all()


def test_secrets_link_weak_parts_only_where_they_meet(spark):
    token = "aB3" * 9
    near, far = f"user=alice then {token} end", f"user=alice\n\n{token}"
    url = f"https://example.org/x user=bob password=hunter22 {'y' * 300} https://example.net/z"
    texts = [(1, near), (2, far), (3, "token=abc secret=token:abcdefgh"), (4, None), (5, ""), (6, url), (6, url), (None, "é AKIA" + "A" * 16)]
    rows = secrets.scan(documents(spark, texts)).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert len(rows) == len(texts)
    assert spans[1] == f"ident:0:10,secret:16:{16 + len(token)}"
    assert spans[2] == "" and spans[3] == "" and spans[4] == "" and spans[5] == ""
    assert spans[6] == "endpoint:0:21,ident:22:30,assign:31:48"
    assert spans[None] == "access:2:22"
    clean = {r.doc_id: r.text for r in secrets.redact(documents(spark, texts)).collect()}
    assert clean[1] == "[SECRET] then [SECRET] end" and clean[2] == far and clean[4] is None
    assert clean[None] == "é [SECRET]"


def test_sharding_law(spark, corpus):
    rows = sharding.shard_by_bytes(documents(spark, corpus), shards=5).collect()
    assert len(rows) == len(corpus)
    whole = sum(r["size"] for r in rows)
    for s in range(5):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - whole / 5) <= 5016 + 16
    assert all(r["size"] == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)


@pytest.mark.parametrize("block,run", [(None, hamming.RUN), (16, 2)])
def test_hamming_top_k_equals_brute_force(spark, block, run):
    rng = np.random.default_rng(4)
    codes = rng.integers(-(2**63), 2**63 - 1, 60).tolist()
    codes += [codes[0] ^ (1 << b) for b in range(12)] + [codes[0]] * 15 + [None]
    rows = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    found = hamming.search(rows, rows.where("id % 20 = 0"), k=5, block=block, run=run)
    got = {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in found.collect()}
    want = {}
    for q, c in enumerate(codes):
        if q % 20 == 0 and c is not None:
            near = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in enumerate(codes) if x is not None)
            want |= {(q, n): (i, d) for n, (d, i) in enumerate(near[:5], 1)}
    assert got == want


def test_hamming_without_rows(spark):
    none = spark.createDataFrame([(None, 5), (7, None)], "id bigint, code bigint")
    assert hamming.search(none, none).count() == 0
    few = spark.createDataFrame([(1, 5), (None, 5), (2, 6)], "id bigint, code bigint")
    assert sorted((r.query_id, r.neighbor_id, r.distance) for r in hamming.search(few, few.where("id = 1")).collect()) == [(1, 1, 0), (1, 2, 2)]


def test_order_minhash(spark, corpus):
    got = orderhash.with_edits(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id is not None}
    assert prints[43] != prints[0] and prints[45] == prints[46] == prints[3]
    texts = dict(corpus[:49])
    for r in got:
        if r.doc_id in range(6, 48):
            text, after = texts[r.doc_id] or "", texts[r.doc_id + 1] or ""
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(orderhash.edited_text(text, after).encode()).hexdigest()
    sketch = orderhash.OrderMinHash()
    a, b = b"one two three four five six seven eight nine ten " * 3, b"eight nine ten one two three four five six seven " * 3
    assert orderhash.likeness(sketch(a), sketch(a)) == 1 and orderhash.likeness(sketch(a), sketch(b)) < 1


def test_quality_holds_out(spark):
    rng = random.Random(9)
    common = [f"w{i}" for i in range(200)]

    def text(kind):
        words = [rng.choice(common) for _ in range(60)]
        return " ".join(words[:30] + ["vile"] + words[30:]) if kind == 0 else " ".join(f"{w}&&&" for w in words) if kind == 1 else " ".join(words)

    rows = [(i, text(i % 3)) for i in range(2400)]
    docs = documents(spark, rows + [(8000, None), (8001, "")])
    rated = spark.createDataFrame([(i, i % 3) for i in range(2000)] + [(5000, None)], "doc_id bigint, grade int")
    model = quality.fit(docs, rated)
    held = [r for r in quality.score(docs, model).collect() if r.doc_id is not None and 2000 <= r.doc_id < 2400]
    right = [(r.tail >= 0.5) == (r.doc_id % 3 == 2) for r in held]
    assert sum(right) / len(right) > 0.97
    none = quality.fit(docs, rated.where("false"))
    assert {round(r.tail, 6) for r in quality.score(docs, none).collect()} == {0.5}


def test_transcripts_recover_roles(spark):
    talk = [(c, t, ["user", "assistant"][t % 2], "What is it?" if t % 2 == 0 else "It is a long answer. " * 8) for c in range(12) for t in range(8)]
    rows = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")
    raw = rows.withColumn("text", transcripts.transcript(F.col("role"), F.col("conv_id"), F.col("turn"), F.col("text")))
    odd = spark.createDataFrame([(None, 0, "user", None), (None, 1, "other", ""), (3, 3, None, "again")], "conv_id bigint, turn bigint, role string, text string")
    hmm = transcripts.fit(raw)
    got = transcripts.parse(raw.unionByName(odd).drop("role"), hmm).collect()
    assert len(got) == len(talk) + 3
    role = {(c, t): r for c, t, r, _ in talk}
    known = [r for r in got if (r.conv_id, r.turn) in role]
    assert sum(r.roles.split(",")[0] == role[r.conv_id, r.turn] for r in known) / len(known) > 0.95
    whole = {}
    for c in (0, 5):  # one stretch or many: the same path
        lines = [x for _, _, text in sorted((r.conv_id, r.turn, r.text) for r in raw.where(F.col("conv_id") == c).collect()) for x in text.split("\n")]
        shown = [transcripts.symbol(x)[0] for x in lines]
        bridge = hmm.bridge(shown)[-1]
        whole[c] = hmm.path(shown), hmm.path(shown, None, int(bridge.argmax()))
        assert whole[c][0] == whole[c][1]


def test_empty_tables(spark, vocab):
    docs = documents(spark, [])
    assert bpe.encode(docs, vocab).count() == 0
    assert packing.pack(packing.pieces(docs, vocab)).count() == 0
    assert simhash.keep_one(docs).count() == 0
    assert substrings.repeats(docs).count() == 0
    assert secrets.scan(docs).count() == 0
    assert sharding.shard_by_bytes(docs).count() == 0
    assert orderhash.with_edits(docs).count() == 0
    codes = spark.createDataFrame([], "id bigint, code bigint")
    assert hamming.search(codes, codes).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert transcripts.parse(turns, transcripts.fit(turns)).count() == 0


def test_pipeline_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
