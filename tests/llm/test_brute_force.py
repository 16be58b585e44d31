"""Every opN_ query on the smallest tables against a plain version; op6 and op7 against their SQL."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from normscope.llm import base, language_id, oracle, pii, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(small):
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()}


def rows(query, spark, small):
    return {r["doc_id"]: r for r in query(spark, small).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, small, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=base.tokenizer_path("piece_bpe_32k.model"))
    got = rows(queries.op1_sentence_pieces, spark, small)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*sp.encode(t), sp.eos_id()]
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_op2(spark, small, texts):
    got = rows(queries.op2_quality_rules, spark, small)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        if len(t) < 20000:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def profile(texts, limit):
    n = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            w = f" {w} "
            for k in (1, 2, 3):
                for a in range(len(w) - k + 1):
                    g = w[a : a + k]
                    if g.strip():
                        n[g] = n.get(g, 0) + 1
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))[:limit]]


def test_op3_distances():
    learned = {"de": "der die das und nicht ein eine mit auf", "en": "the and of to in that with for not", "xx": "zzz qqq zq"}
    known = {lang: {g: k for k, g in enumerate(profile([t], 300))} for lang, t in learned.items()}
    grams = np.unique(np.concatenate([language_id.grams([t])[1] for t in learned.values()]))
    rank = np.full((grams.size, 3), 300, np.int32)
    for k, t in enumerate(learned.values()):
        _, g, place = language_id.places(*language_id.grams([t]), 300)
        rank[np.searchsorted(grams, g), k] = place
    profiles = language_id.Profiles(tuple(learned), grams, rank)
    for text in ("das ist nicht der Weg", "that is not the way", "zq", "123 !", "ein and eine", ""):
        own = profile([text], 300)
        distance = {lang: sum(abs(k - p[g]) if g in p else 300 for k, g in enumerate(own)) for lang, p in known.items()}
        (lang,), (score,) = profiles.predict([text])
        assert lang == (min(distance, key=lambda x: (distance[x], x)) if own else "und")
        assert score == pytest.approx(1 - min(distance.values()) / (300 * len(own)) if own else 0)


def test_op3(spark, small, texts):
    got = rows(queries.op3_language_id, spark, small)
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{small}/documents.parquet'").fetchall())
    assert got.keys() == texts.keys() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    judged = [got[i]["lang_pred"] == x for i, x in lang.items() if x and got[i]["held_out"] and len(texts[i]) > 200]
    assert np.mean(judged) > 0.9


def test_op3_against_all_distances(spark, small, texts):
    """Profiles, distances and scores of every document anew."""
    got = rows(queries.op3_language_id, spark, small)
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{small}/documents.parquet'").fetchall())
    learned = {x: profile([texts[i] for i, y in lang.items() if y == x and zlib.crc32(str(i).encode()) % 4 != 2], 300) for x in {*lang.values()} - {None}}
    known = {x: {g: k for k, g in enumerate(p)} for x, p in learned.items()}
    for i, t in texts.items():
        own = profile([t], 300)
        distance = {x: sum(abs(k - p[g]) if g in p else 300 for k, g in enumerate(own)) for x, p in known.items()}
        assert got[i]["lang_pred"] == (min(distance, key=lambda x: (distance[x], x)) if own else "und")
        assert got[i]["score"] == pytest.approx(1 - min(distance.values()) / (300 * len(own)) if own else 0, abs=1e-12)


def test_op4(spark, small, texts):
    got = rows(queries.op4_mixing, spark, small)
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{small}/documents.parquet'").fetchall())
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    names = sorted({*source.values()} - {None}) + [None] * (None in source.values())
    total = {s: sum(size[i] for i in texts if source[i] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]]) and r["target"] == pytest.approx(target[source[i]])
        assert r["taken"] in (0, size[i], 2 * size[i])
    for s in names:
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - target[s]) <= max(size[i] for i in texts if source[i] == s)
    assert {i: r["taken"] for i, r in rows(queries.op4_mixing, spark, small).items()} == {i: r["taken"] for i, r in got.items()}


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if least <= len(d) <= most and (kind == "phone" or sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0):
                out.append((kind, *m.span()))
    return out


def test_op5(spark, small, texts):
    got = rows(queries.op5_pii, spark, small)
    assert got.keys() == texts.keys()
    held = found = 0
    for i, t in texts.items():
        fixed = slow_base(t) if len(t) < 50000 else pii.pattern_spans(t)
        r = got[i]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in fixed))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in fixed) for k in pii.KINDS]
        spans = {tuple(x.split(":")) for x in r["spans"].split(",") if x}
        assert spans >= {(k, str(a), str(b)) for k, a, b in fixed} and r["n_spans"] == len(spans)
        held, found = held + len(fixed), found + r["n_confirmed"]
    assert found >= 0.6 * held  # the network by itself


def test_op6_and_op7(spark, small):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name in ("op6_ngram_join", "op7_url_filter"):
        got = queries.QUERIES[name](spark, small)
        wanted = con.execute(oracle.ORACLES[name])
        order = [d[0] for d in wanted.description]
        assert sorted(map(str, wanted.fetchall())) == sorted(str(tuple(r[c] for c in order)) for r in got.collect())


def test_op8(spark, small, texts):
    got = rows(queries.op8_matroska, spark, small)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] >= len(payload)


def test_op9_and_op10(spark, small, texts):
    from tokenizers import Tokenizer

    bb = Tokenizer.from_file(base.tokenizer_path("byte_bpe_50k.json"))
    files, cached = rows(queries.op9_wavelet, spark, small), rows(queries.op10_token_counts, spark, small)
    assert files.keys() == cached.keys() == texts.keys()
    at = 0
    for i in sorted(texts):
        ids = bb.encode(texts[i], add_special_tokens=False).ids
        assert (cached[i]["n_bytes"], cached[i]["n_tokens"], cached[i]["over_limit"]) == (len(texts[i].encode()), len(ids), len(ids) > 1024)
        ids.append(0)
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
