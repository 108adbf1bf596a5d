"""Token counts, hard negatives and whitening against the library and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cityloom.llm import bpe, negatives, tokencount, whitening
from cityloom.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return tokencount.TokenCounter(open(vocabulary_path("byte_bpe_50k.json")).read())


def test_counts_equal_the_library(byte_tokenizer, counter):
    rng = random.Random(1)
    pool = [chr(x) for x in [*range(1, 0x600), 0x2019, 0x2028, 0x200B, 0x3000, 0x4E2D, 0x558, 0x10EC5, 0x1F600, 0xFEFF]] + ["'s", "'ll", " ", "  ", "\n", "<|endoftext|>", "the", " hello", "aaaaaa"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "<|endoftext|><|endoftext|> \n", "a" * 3000, "ab" * 2000 + " ", " \n" * 500, "x" * 63 + "é" * 65]
    for text in texts:
        assert counter.count(text) == len(byte_tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_splitters_agree_where_they_are_used(byte_tokenizer, counter):
    import re

    stable = re.compile(f"[{tokencount.STABLE}]")
    for x in range(1, 0x30000):
        if 0xD800 <= x < 0xE000 or not stable.match(chr(x)):
            continue
        for p in ("a", "1", "!"):
            text = p + chr(x) + p
            spans = [m.span() for m in counter.word.finditer(text)]
            assert spans == [s for _, s in byte_tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            if x < 0x2B0:
                assert spans == [m.span() for m in counter.latin_word.finditer(text)]


def test_long_texts_are_taken_in_runs(byte_tokenizer, counter, monkeypatch):
    text = " ".join(f"word{i % 97} l'été ß" for i in range(4000)) + "  \n"
    want = len(byte_tokenizer.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(tokencount, "LONG", 10)
    monkeypatch.setattr(tokencount, "RUN", 7)
    monkeypatch.setattr(tokencount, "MEMO", 3)
    assert counter.count(text) == want
    assert counter.count("中" + text) == want + len(byte_tokenizer.encode("中", add_special_tokens=False).ids)


def test_counted_rows(spark, byte_tokenizer):
    texts = [None, "", "  ", "twice", "twice", "naïve café", "word " * 1025, "zig zag " * 600_000, "z" * 200_000]
    rows = [(i, t, "mine", 7, "old") for i, t in enumerate(texts)] + [(None, "twice", "mine", 7, "old")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, column string, part int, n_tokens string")
    vocab = bpe.vocabulary(spark, vocabulary_path("byte_bpe_50k.json"))
    got = tokencount.counts(docs, vocab).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "column", "part", "n_bytes", "n_tokens", "over_limit"}
    for r in got:
        n = len(byte_tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.column, r.part, r.n_bytes, r.n_tokens, r.over_limit) == ("mine", 7, len((r.text or "").encode()), n, n > 1024)
    assert tokencount.counts(docs.limit(0), vocab).count() == 0


def brute_negatives(rows, anchors, k=5, m=10):
    """Rows and anchors as ``(id, label, x)``; anchors by their place in rows."""
    pad = max(len(x) for _, _, x in rows)
    x = np.array([list(v) + [0] * (pad - len(v)) for _, _, v in rows], dtype=object)
    out = Counter()
    for a in anchors:
        scores = x.dot(x[a])
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-scores[i], rows[i][0] is None, rows[i][0] or 0))
        for p in [i for i in order if rows[i][1] == rows[a][1]][:k]:
            fit = [i for i in order if rows[i][1] != rows[a][1] and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]]
            for n, i in enumerate(fit[:m], 1):
                out[rows[a][0], rows[p][0], n, rows[i][0], int(scores[p]), int(scores[i])] += 1
    return out


VECTORS = "id bigint, label int, x array<bigint>, block string, run string, score string, positive string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, l, x, "b", "r", "s", "p") for i, l, x in rows], VECTORS)


@pytest.mark.parametrize("block,run,tree,chunk", [(None, negatives.RUN, negatives.TREE, negatives.CHUNK), (40, 3, 2, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, run, tree, chunk):
    monkeypatch.setattr(negatives, "TREE", tree)
    monkeypatch.setattr(negatives.groves, "__defaults__", (tree,))
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    centres = rng.integers(-60, 60, (4, 12))
    rows = [(int(i), int(i % 4), (centres[i % 4] // 2 + centres[(i // 4) % 4] + rng.integers(-40, 40, 12)).tolist()) for i in range(160)]
    rows += [(int(500 + i), 1, rows[1][2]) for i in range(70)]  # copies of one vector, in both parts
    rows += [rows[0], rows[0], (0, 2, rows[5][2]), (None, 0, rows[3][2]), (None, 1, rows[0][2]), (20, 3, [1, 2]), (21, 3, []), (40, 0, [0] * 12)]
    anchors = [i for i, (d, _, _) in enumerate(rows) if d is not None and d % 20 == 0]
    odd = [(60, None, rows[0][2]), (80, 1, None), (100, 1, [None, 2])]
    table = vectors(spark, rows + odd)
    got = negatives.mine(table, table.where("id % 20 = 0"), block=block, run=run)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, anchors)


def test_negatives_beyond_exact_doubles(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, (rng.integers(0, 2**29, 6)).tolist()) for i in range(60)]
    table = vectors(spark, rows)
    got = negatives.mine(table, table.where("id % 10 = 0"))
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, range(0, 60, 10))
    with pytest.raises(Exception, match="64-bit"):
        far = vectors(spark, [(0, 1, [2**40]), (1, 1, [2**40]), (2, 2, [2**39])])
        negatives.mine(far, far).collect()


def test_negatives_without_rows(spark):
    none = vectors(spark, [(1, None, [1]), (2, 3, None)])
    assert negatives.mine(none, none).count() == 0
    alone = vectors(spark, [(1, 1, [4]), (2, 2, [3])])
    assert negatives.mine(alone, alone).count() == 0


def test_bounds_leave_rows_unscored():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (6, 16))
    rows = np.concatenate([c + rng.integers(-20, 20, (400, 16)) for c in centres])
    anchors = rows[::40]
    grove = negatives.Grove(anchors, np.arange(len(anchors)), np.full(len(anchors), negatives.NONE + 1), np.full(len(anchors), 2**62), 6)
    for at in range(0, len(rows), 200):
        grove.search(rows[at:at + 200], np.arange(at, at + 200), lambda level: np.ones((len(level), 200), bool))
    assert grove.scored < len(rows) * len(anchors) / 2
    scores = anchors @ rows.T
    window, score, number = grove.found()
    for a in range(len(anchors)):
        want = sorted(range(len(rows)), key=lambda i: (-scores[a, i], i))[:6]
        assert number[window == a].tolist() == want and score[window == a].tolist() == scores[a, want].tolist()


def matrices():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    spectra = [[1.0] * 4 + [0.5] * 26, [1, 1 - 1e-12, 1 - 2e-12, 1 - 3e-12] + [1e-3] * 26, (10.0 ** -np.arange(30)).tolist()]
    twice = rng.normal(size=(100, 8))
    twice[:, 4:] = twice[:, :4]
    plain = [rng.normal(size=(3 * d + 5, d)) for d in (1, 2, 3, 5, 64)]
    return [*plain, rng.normal(size=(50, 64)), np.eye(20), np.diag([3, 3, 3, 1, 1.0]), np.diag([5, 0, 0, 0.0]), np.zeros((5, 6)), np.ones((9, 7)), twice, *[(turn * np.sqrt(s)) @ turn.T for s in spectra]]


@pytest.mark.parametrize("rows", matrices())
def test_directions_equal_eigenvectors(rows):
    width = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    values, turned = whitening.directions(np.vstack([r, np.zeros((width - len(r), width))]), 4)
    square, m = rows.T @ rows, min(4, width)
    want = np.linalg.eigvalsh(square)[::-1][:m]
    scale = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(square @ turned - turned * values).max() <= 1e-13 * scale
    assert np.abs(turned.T @ turned - np.eye(m)).max() <= 1e-13


def test_small_singular_values_keep_their_digits():
    diagonal = 10.0 ** -np.arange(16)
    below = np.sqrt(whitening.dqds(diagonal, diagonal[1:] * 0.5))
    product = math.prod(diagonal)
    assert abs(math.prod(below) / product - 1) < 1e-12  # the determinant, 1e-120
    assert np.abs(below / np.sqrt(whitening.dqds(diagonal[::-1], diagonal[:0:-1] * 0.5)) - 1).max() < 0.6


def brute_whitening(xs):
    fitted = np.array(sorted(set(map(tuple, xs))), dtype=np.float64)
    n = len(fitted)
    centred = fitted - fitted.mean(0)
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1]
    return n, [sum(int(v) for v in c) for c in fitted.T], fitted.mean(0), values, turned


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rng = np.random.default_rng(3)
    xs = (rng.integers(-100, 100, (150, 6)) * np.array([9, 5, 3, 2, 1, 1])).tolist()
    rows = [(i, x) for i, x in enumerate(xs)] + [(900 + i, xs[0]) for i in range(60)] + [(None, xs[1]), (7, None), (8, [None] * 6)]
    table = spark.createDataFrame([(i, x, "c", "n", 1.5) for i, x in rows], "id bigint, x array<bigint>, component string, n string, at double").repartition(12)
    got = whitening.whiten(table).collect()
    kept = [(i, x) for i, x in rows if x is not None and None not in x]
    n, sums, mean, values, turned = brute_whitening(xs)
    assert Counter((r.id, r.component) for r in got) == Counter((i, c) for i, _ in kept for c in (1, 2, 3, 4))
    by_id = dict(kept)
    sign = {}
    for r in got:
        x = by_id[r.id]
        assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and 0 <= r.identity_error < 1e-9
        want = (np.array(x) - mean) @ turned[:, r.component - 1] / np.sqrt(values[r.component - 1])
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "id bigint, x array<bigint>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None), (2, [])])).count() == 0
    same = whitening.whiten(make([(1, [3, 4]), (2, [3, 4])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    flat = {(r.id, r.component): r for r in whitening.whiten(make([(1, [0, 5]), (2, [2, 5]), (3, [1]), (4, [1, 0])])).collect()}
    assert len(flat) == 8 and flat[3, 1].whitened == flat[4, 1].whitened and flat[1, 1].n == 3
    line = {(r.id, r.component): r for r in whitening.whiten(make([(1, [0, 5]), (2, [2, 5])])).collect()}
    assert line[1, 2].whitened is None and line[1, 2].explained == 0 and abs(line[2, 1].whitened - 1) < 1e-12
    far = {r.id: r for r in whitening.whiten(make([(1, [2**40]), (2, [-(2**40)]), (3, [0])])).collect()}
    assert far[1].deviation is None and far[3].deviation == 0
