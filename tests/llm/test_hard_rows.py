"""Texts that fool hashes, repeated ids, hot rows and clashing names."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from normscope.llm import base, bpe_units, mixing, ngram_join, pii, quality_rules, token_counts, url_filter, wavelet


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_in_powers(spark, n):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    texts = [f"x {a} {b}", a, b, f"{a}\n{b}\n"]
    bb = Tokenizer.from_file(base.tokenizer_path("byte_bpe_50k.json"))
    sp = SentencePieceProcessor(model_file=base.tokenizer_path("piece_bpe_32k.model"))
    for encoder, plain in (
        (bpe_units.byte_level(bb.to_str()), lambda t: bb.encode(t, add_special_tokens=False).ids), (bpe_units.sentence_pieces(base.read_bytes(base.tokenizer_path("piece_bpe_32k.model"))), sp.encode)
    ):
        ids, at = encoder.encode_arrow(pa.array(texts))
        assert [ids[x:y].tolist() for x, y in itertools.pairwise(at)] == [plain(t) for t in texts]
    assert quality_rules.measure(pa.array(texts))["n_dup_lines"].tolist() == [0] * 4
    window, at = ngram_join.shingles(pa.array(texts))
    assert len({tuple(window[x:y]) for x, y in itertools.pairwise(at)}) == 4
    assert np.diff(at).tolist() == [1] * 4


def test_equal_hashes_are_not_equal_units(monkeypatch):
    """All units get one hash: only their bytes tell them apart."""
    monkeypatch.setattr(bpe_units.spans, "hashes", lambda raw, starts, ends: np.full(starts.size, 7, np.uint64))
    from tokenizers import Tokenizer

    bb = Tokenizer.from_file(base.tokenizer_path("byte_bpe_50k.json"))
    texts = ["one two three", "two three one", "a longer unit-with-more-than-eight bytes", "a longer unit-with-more-than-eighty bytes", "<|endoftext|>  <|endoftext|> x"]
    encoder = bpe_units.byte_level(bb.to_str())
    for _ in range(2):
        ids, at = encoder.encode_arrow(pa.array(texts))
        assert [ids[x:y].tolist() for x, y in itertools.pairwise(at)] == [bb.encode(t, add_special_tokens=False).ids for t in texts]


def test_stages_keep_rows_and_names(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    r = random.Random(1)
    text = [" ".join(r.choices(words, k=60)) for _ in range(4)]
    names = ["_key", "_dropped", "_id", "_copy", "row_id", "gone_id", "row_key", "chunk", "Row_Place", "_n", "_row"]
    rows = [(5, text[0], "a"), (5, text[1], "b"), (3, text[0] + " end", "c"), (7, text[2], "d"), (None, text[3], "e"), (None, text[3] + "  ", "f"), (9, None, "g"), (10, "", "h")]
    df = spark.createDataFrame([(*x, *[f"{x[2]}{k}" for k in range(len(names))]) for x in rows], ["doc_id", "text", "source", *names])
    kept = ngram_join.keep_one(df)
    got = kept.collect()
    assert kept.columns == df.columns and all(x["_key"] == x["source"] + "0" and x["_dropped"] == x["source"] + "1" for x in got)
    assert sorted(x["source"] for x in got if x["text"]) in (["b", "c", "d", "e"], ["b", "c", "d", "f"])
    assert {"g", "h"} <= {x["source"] for x in got}
    mixed = mixing.taken(df)
    assert mixed.columns == df.columns and all(x["_copy"] == x["source"] + "3" for x in mixed.collect())
    two = spark.createDataFrame([(1, "a b c", "s", "en"), (1, "a b c", "s", "de")], ["doc_id", "text", "source", "lang"])
    assert {x["lang"] for x in mixing.taken(two).collect()} <= {"en", "de"}
    whole = mixing.mix(two).agg(F.sum("taken")).first()[0]
    assert sum(len(x["text"].split()) for x in mixing.taken(two).collect()) == whole
    clean = pii.redacted(df)
    assert clean.columns == df.columns and sorted(x["source"] for x in clean.collect()) == sorted(x[2] for x in rows)
    labels = spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, quality int")
    assert quality_rules.keep(df, labels).columns == df.columns
    urls = spark.createDataFrame([(f"http://{w}.org/x", k % 2 == 0, "d", "c", "n") for k, w in enumerate(words)], ["url", "accepted", "d", "code", "_n"])
    assert {x["d"] + x["code"] + x["_n"] for x in url_filter.learn(urls).score(urls).collect()} == {"dcn"}


def test_hot_ids_of_a_mix(spark, monkeypatch):
    """A third of all rows and more share one id and size: one item, taken as often as all of them are due."""
    sizes, stored = [], base.stored

    def seen(df, purpose):
        out = stored(df, purpose)
        if purpose == "mix":
            sizes.append(out.agg(F.max(F.size("f.done"))).first()[0] or 0)
        return out

    monkeypatch.setattr(base, "stored", seen)
    hot = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rest = spark.range(3000).select("id", F.concat(F.lit("x "), F.repeat(F.lit("y "), (F.col("id") % 7).cast("int"))), F.when(F.col("id") % 3 == 0, "s").otherwise("t"))
    df = hot.union(rest)
    got = mixing.mix(df)
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count(F.lit(1)).alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert sum(r["n"] for r in by) == 203_000 and all(abs(r["taken"] - r["target"]) <= 8 and r["over"] <= 0 for r in by)
    assert max(sizes) <= 4 * mixing.BLOCK
    assert mixing.mix(df).groupBy("id", "size", "taken").count().exceptAll(got.groupBy("id", "size", "taken").count()).count() == 0


def test_recall_where_buckets_split(spark, monkeypatch):
    """Leaves of four nodes: nearly all buckets are split, and classes still are those of brute force."""
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    passage = r.choices(words, k=30)
    texts = []
    for _ in range(60):
        own = r.choices(words, k=90)
        for _ in range(r.choice((1, 2, 5))):
            copy = own.copy()
            for _ in range(r.randrange(3)):
                copy[r.randrange(90)] = r.choice(words)
            texts.append(" ".join(passage + copy))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {x["id"]: x for x in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(got[a]["class_id"] == got[b]["class_id"] for a, b in links)
    assert len(links) > 80 and found >= 0.97 * len(links)
    assert all(got[a]["class_id"] != got[b]["class_id"] for a, b in itertools.combinations(range(len(texts)), 2) if not sets[a] & sets[b] - {tuple(passage[k : k + 5]) for k in range(26)})


def test_wide_sketches_lose_no_pair():
    r = np.random.default_rng(2)
    for n in (3, 50, 400, 3000):
        x = r.integers(1, 1 << 62, n).astype(np.uint64)
        y = np.concatenate([x[n // 10 :], r.integers(1, 1 << 62, n // 10).astype(np.uint64)])
        window, at = np.concatenate([np.sort(x), np.sort(y)]), np.array([0, x.size, x.size + y.size])
        wide, place = ngram_join.wide_odd_sketches(window, at)
        a, b = wide[place[0] : place[1]], wide[place[1] : place[2]]
        assert a.size == b.size >= 2 * n / 64 and np.bitwise_count((a ^ b).view(np.uint64)).sum() <= 2 * (n // 10)
        half = ngram_join.wide_odd_sketches(window[: max(1, n // 2)], np.array([0, max(1, n // 2)]))[0]
        assert half.size <= a.size


def test_viterbi_and_held_out_spans():
    model = pii.BiLstmCrf(4, seed=9)
    r = np.random.default_rng(1)
    model.p["a"], model.p["s"], model.p["e"] = (r.normal(0, 1, model.p[k].shape).astype(np.float32) for k in "ase")
    x = r.integers(0, pii.N_SHAPES, (6, 4)).astype(np.uint8)
    tags, best = model.decode(x)
    score = model._run(x, False)[0]
    for k in range(6):
        worth = lambda t: sum(score[j, k, t[j]] for j in range(4)) + model.p["s"][t[0]] + model.p["e"][t[3]] + sum(model.p["a"][u, v] for u, v in itertools.pairwise(t))  # noqa: B023, E731
        paths = list(itertools.product(range(len(pii.TAGS)), repeat=4))
        assert tuple(tags[k]) == max(paths, key=worth) and best[k] == pytest.approx(max(map(worth, paths)), rel=1e-4)
    model = pii.standard_model()
    held = pii.labelled_examples(150, seed=4242)
    tags, _ = pii.network_tags(model, [t for t, _ in held])
    every, _ = pii.network_tags(model, [t for t, _ in held], every=True)
    found = [set(pii._tagged(t)) for t in tags]
    right = sum(len(f & set(g)) for f, (_, g) in zip(found, held, strict=True))
    # whole spans with exact ends, in the invented texts' many formats
    assert right >= 0.65 * sum(map(len, found)) and right >= 0.65 * sum(len(g) for _, g in held)
    assert all((a[a > 0] == b[a > 0]).all() for a, b in zip(tags, every, strict=True))


def test_second_pass_encodes_nothing(spark, monkeypatch):
    path = base.shared_path(spark, "test-two-passes")
    df = spark.createDataFrame([(k, f"text {k % 7}") for k in range(50)], "doc_id long, text string")
    cache = token_counts.TokenCountCache(spark, path, base.tokenizer_path("byte_bpe_50k.json"))
    first = sorted(map(tuple, cache.count(df, "doc_id", "text").collect()))
    monkeypatch.setattr(cache, "_encoded", lambda missing: pytest.fail("encoded again"))
    assert sorted(map(tuple, cache.count(df, "doc_id", "text").collect())) == first and spark.read.parquet(path).count() == 7


def test_wavelet_reads_few_blocks(tmp_path):
    ids = np.random.default_rng(3).integers(0, 50_000, 400_000)
    path = tmp_path / "x.wm"
    path.write_bytes(wavelet.to_file(ids, [1], np.array([ids.size])))
    shard = wavelet.open_shard(f"file://{path}")
    assert shard.access(123_456) == ids[123_456] and shard.unpacked <= 2 * shard.bits
    before = shard.unpacked
    token = int(ids[77])
    assert shard.count(token) == (ids == token).sum() and shard.select(token, 0) == np.flatnonzero(ids == token)[0]
    assert shard.unpacked - before <= 6 * shard.bits and (shard.decode() == ids).all()


def test_wavelet_planes_by_pieces(monkeypatch):
    import zstandard

    made, new = [], zstandard.ZstdDecompressor
    monkeypatch.setattr(zstandard, "ZstdDecompressor", lambda: made.append(1) or new())
    r = np.random.default_rng(8)
    for n, top in ((wavelet.PIECE - 1, 9), (wavelet.PIECE, 40_000), (3 * wavelet.PIECE + 17, 50_000), (2 * wavelet.PIECE + 1, 90_000), (5, 1)):
        ids = r.integers(0, top, n).astype(np.uint32)
        kept = ids.copy()
        planes, zeros = wavelet._planes(ids)
        x = kept
        for k, (plane, n_zeros) in enumerate(zip(planes, zeros, strict=True)):
            bit = (x >> (len(planes) - 1 - k) & 1).astype(bool)
            assert (plane == np.packbits(bit)).all() and n_zeros == n - bit.sum()
            x = np.concatenate([x[~bit], x[bit]])
        made.clear()
        shard = wavelet.ShardFile(wavelet.to_file(ids, [1], np.array([n])))
        assert (shard.decode() == kept).all() and (ids == kept).all() and shard.documents()[1].tolist() == [0, n]
        assert len(made) == 1  # not one for each block


def test_shards_split_equal_ids(spark):
    df = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("same text "), F.col("id") % 10).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = base.shared_path(spark, "test-equal-ids")
        summary = wavelet.write_shards(df, "doc_id", "text", base.tokenizer_path("byte_bpe_50k.json"), folder, shard_tokens=2000)
        assert summary.count() >= 4 and summary.agg(F.sum("n_docs")).first()[0] == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("same", [True, False])
def test_links_of_blocks_in_pieces(monkeypatch, same):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    texts = ["", "one", *(" ".join(rng.choice(words, 60)) for _ in range(3))]
    for k in range(40):  # near copies of the three, and of each other
        near = texts[2 + k % 3].split(" ")
        near[int(rng.integers(60))] = "other"
        texts.append(" ".join(near[: 60 - k % 5]))
    held = [(not same and k % 2 == 1, k, x) for k, x in enumerate(texts)]
    sets = [set(np.asarray(ngram_join.shingles(pa.array([x]))[0]).tolist()) for x in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    others = lambda k: [m for m in range(len(texts)) if m != k and (same or (m - k) % 2)]
    expected = {k: sum(alike(k, m) for m in others(k)) for k in range(len(texts)) if texts[k]}
    assert max(expected.values()) > 5
    whole = ngram_join._count_block(held, same)
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    pieces = base.cut
    monkeypatch.setattr(base, "cut", lambda batch, _: pieces(batch, 500))
    for got in (whole, ngram_join._count_block(held, same)):
        counts = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
        assert {k: counts[k] for k in expected} == expected


def test_stored_steps_send_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    df = spark.range(0, 1200, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(sizes, "bytes long, n long")
    got = base.stored(df, "batches").collect()
    assert max(r["bytes"] for r in got) < 2 * base.SENT_BYTES and len(got) > 1 and sum(r["n"] for r in got) == 1200
    assert spark.conf.get(name) == before
    with pytest.raises(ValueError), base.small_batches(spark):
        raise ValueError
    assert spark.conf.get(name) == before
