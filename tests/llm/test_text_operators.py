"""The training-data operators on hand-made rows: exactness, brute force and edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from normscope.llm import base, bpe_units, language_id, matroska, mixing, ngram_join, pii, quality_rules, sentence_pieces, token_counts, url_filter, wavelet

NASTY = [
    None, "", " ", "  ", "   a", "a ", "a  b", "x\n \ny", "<|endoftext|> b", "▁ b", "it's 's 'll", "日本 語 x", "\x1c a", "a\t b", "🙂 🙂", "é è", "a" * 3000 + " " + "b" * 50,
    "one two three four five six one two three four five six", "a\u1680b c", "x\u00a0y z",
]


def docs(spark, texts, **more):
    """Documents with ids, and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, 2.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n long, `size` double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


# ---------------------------------------------------------------- 1, 9, 10: tokens


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return sentencepiece.SentencePieceProcessor(model_file=base.tokenizer_path("piece_bpe_32k.model")), Tokenizer.from_file(base.tokenizer_path("byte_bpe_50k.json"))


def test_units_equal_the_libraries(libraries):
    sp, bb = libraries
    texts = [t or "" for t in NASTY]
    for encoder, whole in (
        (bpe_units.sentence_pieces(base.read_bytes(base.tokenizer_path("piece_bpe_32k.model"))), sp.encode),
        (bpe_units.byte_level(base.read_bytes(base.tokenizer_path("byte_bpe_50k.json")).decode()), lambda t: bb.encode(t, add_special_tokens=False).ids),
        (bpe_units.byte_level(base.read_bytes(base.tokenizer_path("word_bpe_49k.json")).decode()), None),
    ):
        if whole is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(base.tokenizer_path("word_bpe_49k.json"))
            whole = lambda t, slow=slow: slow.encode(t, add_special_tokens=False).ids
        for _ in range(2):  # the second time from the cache
            ids, at = encoder.encode_arrow(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [whole(t) for t in texts]


def test_unit_table_holds_its_bound(libraries):
    bb = libraries[1]
    encoder = bpe_units.byte_level(base.read_bytes(base.tokenizer_path("byte_bpe_50k.json")).decode())
    encoder._limit = 50
    texts = [" ".join(f"w{i * j}" for i in range(30)) for j in range(20)]
    for t in texts:
        assert encoder.encode_arrow(pa.array([t]))[0].tolist() == bb.encode(t).ids
    assert encoder._used <= 50 + 31


def test_sentence_pieces(spark, libraries):
    sp = libraries[0]
    got = sentence_pieces.encode(docs(spark, NASTY), "doc_id", "text", base.tokenizer_path("piece_bpe_32k.model")).orderBy("id").collect()
    for row, text in zip(got, NASTY, strict=True):
        text = text or ""
        ids = sp.encode(text, add_eos=True)
        assert row["ids"] == ids and row["decoded"] == sp.decode(ids)
        assert row["ends"] == sorted(row["ends"]) and row["ends"][-1] == len(text.encode()) and len(row["ends"]) == len(ids)
        raw, before = text.encode(), 0
        for i, end in zip(ids[:-1], row["ends"], strict=False):
            piece = sp.id_to_piece(i)
            if not sp.is_byte(i):
                assert raw[before:end].decode().replace(" ", "▁") in (piece, piece.removeprefix("▁"))
            before = end
    assert sentence_pieces.encode(docs(spark, []), "doc_id", "text", base.tokenizer_path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_map_equals_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.ModelProto.FromString(theirs.serialized_model_proto()).normalizer_spec
    ours = sentence_pieces.Normalizer(spec)
    for text in ["ＡＢＣ ﬁ ①", "a  b   c ", "  x", "㍿ Å é", "ｶﾞ", "A\u0301 \u3000 z", "", " ", "ſt Ⅷ"]:
        normal, source = ours.normalize(text)
        assert normal.decode() == theirs.normalize(text)
        assert list(source) == sorted(source) and len(source) == len(normal) + 1 and source[-1] <= len(text.encode())


def test_token_counts_encode_misses_once(spark, libraries):
    bb = libraries[1]
    path = base.shared_path(spark, "test-cache")
    cache = token_counts.TokenCountCache(spark, path, base.tokenizer_path("byte_bpe_50k.json"))
    got = cache.count(docs(spark, [*NASTY, *NASTY]), "doc_id", "text").orderBy("id").collect()
    for row, text in zip(got, [*NASTY, *NASTY], strict=True):
        assert row["n_tokens"] == len(bb.encode(text or "", add_special_tokens=False).ids) and row["n_bytes"] == len((text or "").encode())
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in NASTY})
    assert cache.count(docs(spark, ["new", *NASTY]), "doc_id", "text").count() == len(NASTY) + 1 and spark.read.parquet(path).count() == stored.count() + 1
    other = token_counts.TokenCountCache(spark, path, base.tokenizer_path("piece_bpe_32k.model"))
    assert other.count(docs(spark, ["new"]), "doc_id", "text").first()["n_tokens"] == len(libraries[0].encode("new"))
    assert cache.count(docs(spark, []), "doc_id", "text").count() == 0


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (5000, 300), (700, 70000)):
        x = r.integers(0, top, n)
        m = wavelet.ShardFile(wavelet.to_file(x, [None, 5], np.array([n, 0])))
        assert (m.decode() == x).all() and all(m.access(i) == x[i] for i in range(0, n, 97))
        for token in {int(x[0]), int(x[-1]), top + 3}:
            places = np.flatnonzero(x == token)
            assert m.count(token) == places.size and [m.select(token, k) for k in range(min(20, places.size))] == places[:20].tolist()
            assert m.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        with pytest.raises(IndexError):
            m.select(top + 3, 0)


def test_wavelet_files(spark, libraries):
    bb = libraries[1]
    df = docs(spark, NASTY).repartition(3).unionByName(docs(spark, ["twice"]).withColumn("doc_id", F.lit(3).cast("long")))
    got = wavelet.store_and_read(df, "doc_id", "text", base.tokenizer_path("byte_bpe_50k.json")).collect()
    expected, at = [], 0
    placed = lambda row: (row[0], xxhash.xxh64_intdigest(row[1].encode(), 42) + 2**63 & 2**64 - 1)  # noqa: E731  (the hash as a signed long)
    for i, text in sorted([*enumerate(t or "" for t in NASTY), (3, "twice")], key=placed):
        ids = [*bb.encode(text, add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == expected
    folder = base.shared_path(spark, "test-wavelet")
    wavelet.write_shards(df, "doc_id", "text", base.tokenizer_path("byte_bpe_50k.json"), folder, shard_tokens=50).count()
    assert wavelet.count_token(spark, folder, 0).agg(F.sum("occurrences")).first()[0] == sum(bb.encode(t or "").ids.count(0) + 1 for t in [*NASTY, "twice"])
    assert wavelet.store_and_read(docs(spark, []), "doc_id", "text", base.tokenizer_path("byte_bpe_50k.json")).count() == 0


# ---------------------------------------------------------------- 2: quality


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often, cover = Counter(g), set()
    for k, x in enumerate(g):
        if often[x] > 1:
            cover.update(range(k, k + 5))
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover)


def test_statistics(spark):
    texts = [*NASTY, "a b\na b\n\n\na b \na b", "x\r\ny\r\nx\r\n", "* # |", "w " * 50, "ÄÖ × aÀ\n"]
    got = quality_rules.statistics(docs(spark, texts), "doc_id", "text").orderBy("id").collect()
    for row, text in zip(got, texts, strict=True):
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == counted(text)
    assert got[-1]["n_capitals"] == 3


def test_decision_list_learns_thresholds():
    r = np.random.default_rng(0)
    x = {"a": r.random(2000), "b": r.random(2000)}
    bad = (x["a"] > 0.9) | ((x["a"] < 0.2) & (x["b"] < 0.3))
    rules = quality_rules.learn(x, bad)
    found = rules.first(x) >= 0
    assert (found & ~bad).sum() <= 0.01 * (~bad).sum() and (found & bad).sum() > 0.9 * bad.sum()
    assert not quality_rules.learn(x, np.zeros(2000, bool)).rules


def test_judge_and_keep(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9)))
    good = [" ".join(word() for _ in range(60)) for _ in range(120)]
    bad = [" ".join(word() + "$$$" for _ in range(60)) for _ in range(120)]
    df = docs(spark, [*good, *bad, None, "short", "a b c d e " * 20])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(1, None), (None, 0)], "doc_id long, quality int")
    judged, rules = quality_rules.judge(df, labels)
    kept = {x["id"] for x in judged.where("kept").collect()}
    assert rules.rules and set(range(120)) <= kept and len(kept) <= 126
    whole = quality_rules.keep(df, labels)
    assert whole.columns == df.columns and {x["doc_id"] for x in whole.collect()} == kept
    none, empty = quality_rules.judge(df, labels.limit(0))
    assert not empty.rules and none.where("kept").count() == 240
    assert quality_rules.keep(df.limit(0), labels).count() == 0


# ---------------------------------------------------------------- 3: language


def test_rank_order_profiles_against_brute_force():
    def slow(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {w} "
            out.update(w)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    for text in ["The cat, the hat!", "Ünïcode ßß 12 x", "a", "", "123", "日本語 x"]:
        t, g, n = language_id.grams(["other", text, "more"])
        name = lambda v: "".join(" " if c == 1 else chr(c) for c in reversed([v >> s & 0x1FFFFF for s in (0, 21, 42)]) if c)
        mine = {name(v): c for k, v, c in zip(t.tolist(), g.tolist(), n.tolist(), strict=True) if k == 1}
        assert mine == dict(slow(text))


def test_identify(spark):
    texts = {"en": "the house and the garden with that thing", "de": "das haus und der garten mit dem ding nicht", "fr": "la maison et le jardin avec cette chose"}
    rows = [(i, t + f" {i}", lang) for i, (lang, t) in enumerate([*texts.items()] * 20)]
    train = spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    profiles = language_id.learn(train, "doc_id", "text", "lang")
    given = docs(spark, ["the thing and that garden", "nicht mit dem garten", "avec la maison", None, "", "12 3!", "x" * 100000])
    got = [(x["lang_pred"], x["score"]) for x in language_id.identify(given, profiles, "doc_id", "text").orderBy("id").collect()]
    assert [x[0] for x in got[:6]] == ["en", "de", "fr", "und", "und", "und"] and all(0 <= x[1] <= 1 for x in got) and got[3][1] == 0
    nothing = language_id.learn(train.limit(0), "doc_id", "text", "lang")
    assert language_id.identify(given, nothing, "doc_id", "text").where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(given.limit(0), profiles, "doc_id", "text").count() == 0


def test_held_out_accuracy(spark, small):
    from normscope.llm.queries import op3_language_id

    docs_ = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, small).join(docs_, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count() > 0
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs_.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


# ---------------------------------------------------------------- 4: mixing


def test_targets_fill_up(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    weights, sizes = dict(zip(["a", "b", "c", "z", None], [3, 1, 2, 3, 1], strict=True)), {"a": 100, "b": 1000, "c": 10, None: 50, "z": 0}
    left, total, expected = set(sizes), 1.5 * sum(sizes.values()), {}
    while left:
        level = (total - sum(expected.values())) / sum(weights[s] for s in left)
        over = {s for s in left if weights[s] * level >= 2 * sizes[s]}
        if not over:
            expected |= {s: weights[s] * level for s in left}
            break
        expected |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    assert got == pytest.approx(expected) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_meets_its_targets(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(r.integers(1, 60))), None if i % 10 == 9 else f"s{i % 4 if i % 3 else 0}") for i in range(1500)]
    rows += [(5000, None, "s1"), (5001, "", None), (None, "x y", "s2"), (0, "same", "s0"), (0, "same", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.withColumn("p", F.lit(1)), block=8).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    by = got.fillna({"source": "none"}).groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (by["size"] == by["told"]).all() and ((by["taken"] - by["target"]).abs() <= by["most"] + 1e-6).all()
    again = mixing.mix(df.repartition(5), block=8).toPandas()
    key = ["id", "source", "size", "taken"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.where("doc_id = 5000")).first()["taken"] == 0
    kept = mixing.taken(df)
    assert kept.columns == df.columns and kept.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == pytest.approx(by["target"].sum(), rel=0.05)


def test_rounding_is_fair(spark):
    rows = [("s", 40, int(i), i, 10, 0.3, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, n_source long, key long, id long, `size` long, p double, whole long")
    up = mixing.round_fractions(df, block=8).where("p = 1").count()
    assert up == 12


# ---------------------------------------------------------------- 5: personal data


def slow_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_patterns_against_plain_expressions():
    r = np.random.default_rng(6)
    alphabet = list("ab.@-+0123459 ()%é\n")
    for _ in range(400):
        text = "".join(r.choice(alphabet, int(r.integers(0, 80))))
        assert pii.pattern_spans(text) == slow_spans(text)
    for text in ["a@b@c.de f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111-1111 1111", "+1 (293) 555-9179 +12", "x@y..z a@-.b"]:
        assert pii.pattern_spans(text) == slow_spans(text)
    assert pii.pattern_spans("a" * 200000 + "@" * 5 + "1" * 200000) == []


def test_gradients():
    model = pii.BiLstmCrf(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = pii.training_windows(pii.labelled_examples(2))
    x, y = x[:, :10], y[:, :10]
    _, g = model.gradients(x, y)
    for k in model.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, two = model.p[k][at], []
        for step in (1e-4, -1e-4):
            model.p[k][at] = was + step
            two.append(model.gradients(x, y)[0])
        model.p[k][at] = was
        assert g[k][at] == pytest.approx((two[0] - two[1]) / 2e-4, rel=1e-2)


def test_network_finds_what_patterns_miss(spark):
    model = pii.standard_model()
    x, y = pii.training_windows(pii.labelled_examples(200, seed=77))
    best, _ = model.decode(x)
    assert ((best > 0) & (y > 0)).sum() > 0.85 * (y > 0).sum() and ((best > 0) & (y > 0)).sum() > 0.85 * (best > 0).sum()
    text = "please call (293) 555-9179 now. " + "plain words here " * 20 + "card 4111.1111.1111.1111 it is"
    added = [s for s in pii.find(model, [text])[0] if s[3]]
    assert {s[0] for s in added} == {"phone", "card"}
    shifted = pii.find(model, ["lorem ipsum dolor " * 7 + text])[0]
    assert [(k, b - a) for k, a, b, _ in shifted] == [(k, b - a) for k, a, b, _ in pii.find(model, [text])[0]]
    assert pii.find(model, ["", "no numbers at all", "in 2024 and 1999, page 12 of 300"]) == [[], [], []]
    given = docs(spark, [None, "", "write to a.b@c.de or 10.0.0.1", "é a@b.cd", text])
    got = pii.detect(given, "doc_id", "text").orderBy("id").collect()
    assert [[(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got[:4]] == [[], [], [("email", 9, 17), ("ip", 21, 29)], [("email", 2, 8)]]
    clean = pii.redacted(given)
    assert clean.columns == given.columns and [r["text"] for r in clean.orderBy("doc_id").collect()][:4] == [None, "", "write to [EMAIL] or [IP]", "é [EMAIL]"]
    assert pii.detect(given.limit(0), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- 6: near duplicates


def near(texts):
    """Class and links of each text by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    parent, links = list(range(len(texts))), [set() for _ in texts]

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
                if a != b:
                    links[i].add(b)
                    links[j].add(a)
    return [top(i) for i in range(len(texts))], [len(x) for x in links]


@pytest.fixture(scope="module")
def copies():
    r = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, 5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        words = [word() for _ in range(int(r.integers(30, 200)))]
        texts.append(" ".join(words))
        for _ in range(int(r.integers(0, 5))):
            near_ = list(words)
            for _ in range(int(r.integers(0, max(1, len(words) // 60) + 1))):
                near_[int(r.integers(len(near_)))] = word()
            texts.append(" ".join(near_))
    core = [word() for _ in range(150)]
    for i in range(40):  # a large group of near copies
        t = list(core)
        t[i * 3] = word()
        texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(80)]) for _ in range(30)]  # a passage that is shared
    return [*texts, None, "", "one two", "one two", "one  two\n", "x", texts[0], texts[0]]


def test_join_against_all_pairs(spark, copies, monkeypatch):
    classes, links = near(copies)
    got = ngram_join.join(docs(spark, copies)).orderBy("id").collect()
    assert [r["class_id"] for r in got] == classes and [r["n_links"] for r in got] == links
    monkeypatch.setattr(ngram_join, "LEAF", 8)  # large buckets: the recursion, and blocks
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    again = ngram_join.join(docs(spark, copies)).orderBy("id").collect()
    wrong = sum(a["class_id"] != b for a, b in zip(again, classes, strict=True))
    assert wrong <= 0.02 * len(copies)
    kept = ngram_join.keep_one(docs(spark, copies))
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} == set(classes)


def test_join_edge_cases(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d e f"]).unionByName(docs(spark, ["a b c d e f"]))
    assert ngram_join.join(twice).select("class_id", "n_links").distinct().collect()[0] == (0, 0) and ngram_join.keep_one(twice).count() == 1
    null = docs(spark, ["a b c d e f", "a b c d e f", None]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = ngram_join.join(null).collect()
    assert len(got) == 3 and len({r["class_id"] for r in got}) == 2 and sum(r["id"] is None for r in got) == 1


def test_runs_reach_the_recall():
    for depth in (3, 5, 8):
        runs = ngram_join.runs_for(depth, 0.99)
        assert 1 - (1 - ngram_join.survival(depth)) ** runs >= 0.99


# ---------------------------------------------------------------- 7: URLs


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://Example.ORG/en/12", "https://a.example.org/es/x?q", "http://xexample.org/es/", "http://org/x", "http://org", "http://b.com/fr/1#t", "b.com/fr/", None, "", "x://y://z/w", "http://u@h.com:80/de/",
        "http://b.com?x=/fr/", "http://É.com/fr/",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    h, p = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    got = df.select("page_id", h.alias("h"), p.alias("p"), url_filter.first_rule(h, p).alias("r")).orderBy("page_id").collect()
    assert [(r["h"], r["p"]) for r in got] == [
        ("example.org", "/en/12"), ("a.example.org", "/es/x"), ("xexample.org", "/es/"), ("org", "/x"), ("org", ""), ("b.com", "/fr/1"), ("", ""), ("", ""), ("", ""), ("y:", "//z/w"),
        ("u@h.com:80", "/de/"), ("b.com", ""), ("É.com", "/fr/"),
    ]
    rules = [r["r"]["rule"] if r["r"] else None for r in got]
    assert rules == ["example.org/en/1", "example.org/es/", "org/", "org/", None, "com/fr/", None, None, None, None, None, None, "com/fr/"]


def slow_ratio(sample, urls, min_seen=4):
    """The two models' difference by plain dictionaries."""
    n = url_filter.SIGNS
    code = lambda u: [0, 0] + [url_filter.ALPHABET.find(c) + 1 or n - 1 for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u)]
    counts = {k: [Counter(), Counter(), Counter()] for k in (1, 0)}
    for u, good in sample:
        s = code(u)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            for order, key in enumerate(((c,), (b, c), (a, b, c))):
                counts[int(good)][order][key] += 1
    seen = lambda k, order, ctx: [v for key, v in counts[k][order].items() if key[:-1] == ctx]

    def p(k, a, b, c):
        s0 = list(counts[k][0].values())
        out = (counts[k][0][(c,)] + len(s0) / n + 1 / n) / (sum(s0) + len(s0) + 1)
        for order, ctx in ((1, (b,)), (2, (a, b))):
            s = seen(k, order, ctx)
            if sum(s) + sum(seen(1 - k, order, ctx)) >= min_seen:
                out = (counts[k][order][(*ctx, c)] + len(s) * out + out) / (sum(s) + len(s) + 1)
        return out

    found = []
    for u in urls:
        s = code(u)
        d = [np.log(p(1, a, b, c)) - np.log(p(0, a, b, c)) for a, b, c in zip(s, s[1:], s[2:], strict=False)]
        found.append(float(np.mean(d)) if d else 0.0)
    return found


def test_ratio_against_dictionaries(spark):
    r = np.random.default_rng(3)
    sample = [("http://" + "".join(r.choice(list("abc./"), 12)), True) for _ in range(30)] + [("http://" + "".join(r.choice(list("xyz-9"), 12)), False) for _ in range(30)]
    df = spark.createDataFrame(sample, "url string, accepted boolean")
    ratio = url_filter.learn(df)
    urls = ["http://abc/abc", "http://xyz-9", "", "HTTP://É", "q" * 500]
    got = ratio.score(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(9, None)], "i int, url string")).orderBy("i").collect()
    assert [x["difference"] for x in got[:5]] == pytest.approx(slow_ratio(sample, urls), abs=1e-6) and got[5]["difference"] == 0
    assert got[0]["difference"] > ratio.threshold > got[1]["difference"]
    one_sided = url_filter.learn(df.where("accepted"))
    assert one_sided.threshold == float("-inf")


def test_judge_urls(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, None), (3, "http://b.com/de/1"), (4, "http://c.net/q")], "page_id long, url string").withColumn("difference", F.lit("clash"))
    judged, _ = url_filter.judge(df)
    got = sorted((r["id"], r["rule"], r["verdict"] in ("allow", "block")) for r in judged.select("id", F.coalesce("rule", F.lit("")).alias("rule"), "verdict").collect())
    assert got == [(1, "org/", True), (1, "org/", True), (2, "", True), (3, "com/de/", True), (4, "", True)]
    assert url_filter.judge(df.limit(0))[0].count() == 0


# ---------------------------------------------------------------- 8: media


def test_matroska_round_trip(spark):
    got = matroska.read_media(matroska.to_media(docs(spark, NASTY), "doc_id", "text")).orderBy("id").collect()
    for row, text in zip(got, NASTY, strict=True):
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert row["n_bytes"] == len(raw) and row["payload_bytes"] == len(padded) and row["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(padded[-32:]) and row["cues_ok"] and row["n_packets"] == len(padded) // 576
    assert matroska.to_media(docs(spark, []), "doc_id", "text").count() == 0


def test_matroska_packets(spark):
    payload = bytes(range(256)) * 9 * 400
    m = matroska.parse(matroska.mux(payload))
    assert m.complete and set(m.lacing) == {"fixed", "xiph", "ebml"} and len(m.clusters) == len(m.cues) == 4 and m.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert m.time_ns == [12_000_000 * k for k in range(len(m.time_ns))]
    rows = matroska.packets(spark.createDataFrame([(1, bytearray(matroska.mux(payload))), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary"), "doc_id", "media")
    assert rows.count() == len(payload) // 576 and rows.agg(F.sum("byte_size")).first()[0] == len(payload)


def test_matroska_forms():
    """Unequal laces, unknown sizes, unknown elements and cut bytes."""
    frames = [b"a" * 700, b"b" * 3, b"c" * 255, b"d" * 900]
    for kind in (matroska.XIPH, matroska.EBML_LACE):
        block = matroska.vint(2) + (5).to_bytes(2, "big") + bytes([kind]) + matroska._lace(frames, kind) + b"".join(frames)
        body = matroska.uint(matroska.CLUSTER_TIME, 7) + matroska.element(0xEC, b"\0" * 9) + matroska.element(matroska.SIMPLE_BLOCK, block)
        head = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm"))
        unknown = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska._id(matroska.CLUSTER) + b"\xff" + body + matroska._id(matroska.CLUSTER) + b"\xff" + body
        m = matroska.parse(head + unknown)
        assert m.size == [700, 3, 255, 900] * 2 and m.time_ns == [12_000_000] * 8 and m.track == [2] * 8 and len(m.clusters) == 2 and m.doc_type == "webm"
        data = head + unknown
        assert [data[o : o + s] for o, s in zip(m.offset, m.size, strict=True)] == frames * 2
        cut = matroska.parse(data[:-5])
        assert len(cut.size) == 4 and not cut.complete
    assert matroska.parse(b"").size == [] and not matroska.parse(b"\0\0").complete
