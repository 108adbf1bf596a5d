"""Cases in which rows, ids or columns once were lost, and every stage of the pipeline on odd tables."""

import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.llm import bpe, packing, quality, secrets, sharding, simhash, tokencount
from cityloom.llm.queries import vocabulary_path

REPO = Path(__file__).resolve().parents[2]
#: Names that operators use for themselves somewhere.
INTERNAL = ["row", "key", "block", "length", "part", "tie", "size", "_id", "_hash", "_at", "_part", "_before", "_row_key", "_spans", "_kept", "spans", "n_words", "n_removed",
            "kept", "starts", "hashes", "ordinal", "before", "score", "tail", "expected_grade", "class", "fp0", "name", "root", "component_id", "ids", "shard", "none", "kept_id"]


@pytest.fixture(scope="module")
def vocab(spark):
    return bpe.vocabulary(spark, vocabulary_path())


def clashing(spark, texts):
    columns = ["doc_id", "text", "lang", "source", "n_chars", *INTERNAL]
    rows = [(i, t, "en", "s", None if t is None else len(t), *[f"{c}-{n}" for c in INTERNAL]) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {'bigint' if c in ('doc_id', 'n_chars') else 'string'}" for c in columns))


def test_packing_keeps_large_ids_beside_null_ones(spark, vocab):
    docs = spark.createDataFrame([(2**53 + 1, "a b"), (None, "c d"), (2**53 + 3, "e"), (-(2**62) - 1, "")], "doc_id bigint, text string").coalesce(1)
    packed = packing.pack(packing.pieces(docs, vocab))
    assert {r.doc_id for r in packed.collect()} == {2**53 + 1, None, 2**53 + 3, -(2**62) - 1}
    named = packing.pack(packing.pieces(docs, vocab).withColumns({"part": F.lit("p"), "tie": F.lit("t"), "row": F.lit("r"), "before": F.array(F.lit(1))}))
    assert {(r.part, r.tie, r.row, tuple(r.before)) for r in named.collect()} == {("p", "t", "r", (1,))}


def test_words_of_equal_hash(spark):
    from tokenizers import Tokenizer

    swap = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(10):
        word += word.translate(swap)
    other = word.translate(swap)
    own, library = bpe.WordBpe(open(vocabulary_path()).read()), Tokenizer.from_file(vocabulary_path())
    for texts in ([word, other], [f"{other} x {word} {other} hello"], [word], [other]):
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memo_is_forgotten_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    own, whole = bpe.WordBpe(open(vocabulary_path()).read()), bpe.WordBpe(open(vocabulary_path()).read())
    texts = [f"some words {i} and more{i} words" for i in range(60)]
    want = whole.encode(texts)
    assert [own.encode([t])[0] for t in texts] == want and len(own.memo_letters) < 120


def test_repeated_ids_of_different_texts_stay(spark):
    one, two = " ".join(f"left{i}" for i in range(60)), " ".join(f"right{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one), (1, one), (None, two), (None, "alone " * 20)]
    kept = simhash.keep_one(clashing(spark, rows), width=2, tables=4)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, one), (1, two), (None, "alone " * 20)])


def test_columns_of_any_name_stay(spark, vocab):
    import corpus_pipeline

    texts = [(1, "plain words here"), (2, "password=abcdef1 user=bob"), (3, None), (4, ""), (5, "other text for all")]
    docs = clashing(spark, texts)
    same = [*INTERNAL, "lang", "source"]
    want = {tuple(r[c] for c in same) for r in docs.collect()}

    def held(df, without=()):
        names = [c for c in same if c not in without]
        assert {tuple(r[c] for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()} == {tuple(v for c, v in zip(same, w) if c not in without) for w in want}

    held(secrets.redact(docs))
    held(simhash.keep_one(docs.withColumn("text", F.concat("doc_id", F.lit(" is the only one of its text")))))
    held(quality.select(docs, quality.fit(docs, spark.createDataFrame([], "doc_id bigint, grade int")), least_tail=0))
    held(sharding.shard_by_bytes(docs, shards=2), without=["size", "shard"])
    held(bpe.encode(docs, vocab), without=["ids"])
    held(tokencount.counts(docs, bpe.vocabulary(spark, vocabulary_path("byte_bpe_50k.json"))))
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        held(out)


def test_every_stage_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(60))
    tails = [" ".join(f"{x}{i}" for i in range(150)) for x in "xy"]
    texts = [(1, f"alpha beta {passage} gamma {tails[0]}"), (2, f"delta {passage} password=abcdef1 {tails[1]}"), (3, None), (4, ""), (5, ""), (None, None), (6, "only text"), (6, "only text"), (7, passage)]
    for n, rows in enumerate((texts, [])):
        folder = tmp_path / str(n)
        docs = clashing(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        seen = {name: stage(spark, docs, str(folder)).collect() for name, stage in corpus_pipeline.STAGES}
        if not rows:
            assert not any(seen.values()) and corpus_pipeline.run(spark, str(folder)).count() == 0
            continue
        assert len(seen["quality classifier"]) == len(texts)  # without labels nobody is judged
        near = Counter((r.doc_id, r.text) for r in seen["simhash near-dedup"])
        assert near == Counter([(1, texts[0][1]), (2, texts[1][1]), (3, None), (6, "only text"), (7, passage)])
        cleaned = Counter((r.doc_id, r.text, r.n_chars) for r in seen["substring dedup"])
        assert cleaned == Counter([(1, f"alpha beta gamma {tails[0]}", 17 + len(tails[0])), (2, f"delta password=abcdef1 {tails[1]}", 23 + len(tails[1])), (3, None, None), (4, "", 0), (5, "", 0), (None, None, None), (6, "only text", 9), (6, "only text", 9)])
        redacted = {r.doc_id: (r.text, r.n_chars) for r in seen["secret scans"]}
        assert redacted[2] == (f"delta {passage} [SECRET] {tails[1]}", len(f"delta {passage} [SECRET] {tails[1]}")) and redacted[1] == (texts[0][1], len(texts[0][1]))
        assert len(seen["best-fit packing"]) == len(texts)
        assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()) == Counter([1, 2, 3, 6])


def test_workers_need_no_package(tmp_path):
    """Every operator that runs Python in tasks, with the package on the driver's path alone."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})
        from pyspark.sql import functions as F
        from cityloom.runtime import session
        from cityloom.llm import bpe, hamming, negatives, orderhash, packing, quality, sharding, simhash, substrings, tokencount, transcripts, whitening
        from cityloom.llm.queries import vocabulary_path
        spark = session("local[2]", shuffle_partitions=2)
        assert spark.range(1).select(F.udf(lambda x: __import__("importlib.util").util.find_spec("cityloom") is None, "boolean")("id")).first()[0], "the package is visible"
        docs = spark.createDataFrame([(i, f"text {{i}} of words") for i in range(20)], "doc_id bigint, text string")
        vocab, counted = bpe.vocabulary(spark, vocabulary_path()), bpe.vocabulary(spark, vocabulary_path("byte_bpe_50k.json"))
        rows = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("label"), F.array("doc_id", F.lit(2)).alias("x"))
        model = quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade")))
        turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), "text")
        codes = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("code"))
        for made in (bpe.decode(bpe.encode(docs, vocab), vocab), packing.pack(packing.pieces(docs, vocab)), quality.select(docs, model), sharding.shard_by_bytes(docs), simhash.keep_one(docs),
                     substrings.repeats(docs), orderhash.with_edits(docs), transcripts.parse(turns, transcripts.fit(turns)), hamming.search(codes, codes),
                     tokencount.counts(docs, counted), negatives.mine(rows, rows), whitening.whiten(rows)):
            made.collect()
        print("all ran")
    """)
    script = tmp_path / "alone.py"
    script.write_text(code)
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_edited_copies_are_caught(spark):
    """Copies of which 2 % of the words are others share 0.8 of their five-word shingles; nine in ten must go, and nothing else."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3000)]
    originals = [rng.choice(words, int(rng.integers(80, 600))).tolist() for _ in range(150)]
    rows, alike = [(i, " ".join(w)) for i, w in enumerate(originals)], 0
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for i, w in enumerate(originals):
        copy = [str(rng.choice(words)) if rng.random() < 0.02 else x for x in w]
        a, b = shingles(w), shingles(copy)
        if len(a & b) / len(a | b) >= 0.8 and copy != w:
            rows.append((1000 + i, " ".join(copy)))
            alike += 1
    import corpus_pipeline

    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert alike > 50 and {i for i in kept if i < 1000} == set(range(150))
    assert 1 - sum(i >= 1000 for i in kept) / alike >= 0.9
