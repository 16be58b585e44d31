"""Line dedup, periodic runs and vector codes: queries against plain versions, kernels against brute force, hard rows."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normscope.llm import line_dedup, oracle, periodic_runs, queries, vector_codes

SIX = " \t\n\v\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(small):
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_vector_codes"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    wanted = con.execute(oracle.ORACLES[name])
    order = [d[0] for d in wanted.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(str, wanted.fetchall())) == sorted(str(tuple(r[c] for c in order)) for r in got.collect())


# lines


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SIX))


def deduped(rows, min_chars=20, min_docs=3):
    """(n_lines, n_dropped, kept) of each (id, text), each row a document."""
    held = {}
    for at, (i, t) in enumerate(rows):
        for k in {key_of(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append((-(2**63) if i is None else i, at))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if len(held.get(key_of(x), ())) < min_docs or max(held[key_of(x)])[0] == (-(2**63) if i is None else i)]
        out.append((len(all_), len(all_) - len(keep), "\n".join(keep)))
    return out


def test_op11(spark, small, texts):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op11_line_dedup(spark, small).collect()}
    rows = sorted(texts.items())
    assert got == {i: (n, d, sha(k)) for (i, _), (n, d, k) in zip(rows, deduped(rows), strict=True)}
    assert sum(d for _, d, _ in got.values()) > 0


def test_line_dedup_hard_rows(spark):
    shared, wide = "This Line Is Shared By Many", "ä" * 19 + "é"
    rows = [
        (1, f"{shared}\nown"), (2, f"  {shared.lower()}\t\r\nown"), (3, f"{shared.upper()}\n{shared}"), (3, f"{shared}\n"), (4, None), (5, ""), (None, f"{shared}\n{wide}"), (6, f"{wide}\n\n{wide}"), (7, f"\n{wide} "),
        (8, wide), (9, "\n\n"), (10, "Ä" * 20), (11, "ä" * 20), (12, "ä" * 20), (13, ("x" * 5000 + "\n") * 3), (14, "x" * 5000), (15, "X" * 5000 + "\n" + "z" * 100_000), (16, wide[:-1]), (17, wide[:-1]), (18, wide[:-1]),
    ]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "id long, t string, kept string, n_lines int").repartition(3)
    got = line_dedup.dedup(df, "id", "t").collect()
    expected = [(i, k, n, d) for (i, _), (n, d, k) in zip(rows, deduped(rows), strict=True)]
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=by) == sorted(expected, key=by)
    assert line_dedup.dedup(df.limit(0), "id", "t").collect() == []


def test_index_in_many_shards_and_small_memory(spark, monkeypatch):
    """Shards beyond what a worker keeps are read again; the result is the same."""
    rng = np.random.default_rng(5)
    rows = [(i, "\n".join(f"a line of some length {k}" for k in rng.integers(0, 300, 40))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    index = line_dedup.build(df, "id", "t", shard_hashes=4, least_shards=2)
    assert len(index.names) > 16
    monkeypatch.setattr(line_dedup, "KEPT_BYTES", 2000)
    x = line_dedup.lines(pa.array([t for _, t in rows]), 20)
    counts, keepers = index.probe(x["a"], x["b"])
    held = {}
    for i, t in rows:
        for line in t.split("\n"):
            held.setdefault(line, set()).add(i)
    whole = [line for _, t in rows for line in t.split("\n")]
    for line, n, keeper in zip([whole[k] for k in x["of"]], counts, keepers, strict=True):
        assert (n, keeper) == ((len(held[line]), max(held[line])) if len(held[line]) >= 3 else (0, -(2**63)))
    assert len(line_dedup._KEPT) < 16


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 100, 5000):
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        if n > 2:
            a[1] = a[0]  # one first half, two hashes
        found = line_dedup.PerfectHash.of(a, b)
        assert sorted(found.places(a, b).tolist()) == list(range(n))
        assert len(found.bits) * 8 <= 6 * n + 640
        strange = line_dedup.Shard.of(a, b, np.ones(n, np.int64), np.ones(n, np.int64)).probe(b, a)[0]
        assert not strange.any()


# runs


def brute_runs(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)  # the least period of a stretch comes first
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def test_op12(spark, small, texts):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, small).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for i, t in texts.items():
        words = t.encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)], planted + 1
        found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        r = got[i]
        assert (r["n_runs"], r["runs_sha256"]) == (len(found), sha("".join(f"{s},{size},{q}\n" for s, size, q in found)))
        assert r["collapsed_sha256"] == sha(b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(2, 12))
def test_runs_are_those_of_brute_force(docs, least):
    sizes, symbols = np.array([len(d) for d in docs]), np.array([x for d in docs for x in d], np.int64)
    got = [[] for _ in docs]
    for text, *run in zip(*(x.tolist() for x in periodic_runs.runs(symbols, sizes, least)), strict=True):
        got[text].append(tuple(run))
    assert [sorted(g) for g in got] == [brute_runs(d, least) for d in docs]


def test_periodic_runs_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 5000), (None, "b c " * 12), (4, "x y z " * 4), (5, "x y z " * 3 + "x y"), (6, "A a " * 6), (7, " ".join(map(str, range(30_000))))]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "id long, t string, runs int, n_words string")
    got = {(r["id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.detect(df, "id", "t").collect()}
    assert got == {
        (1, 0): ([], ""), (2, 0): ([], ""), (3, 0): ([], ""), (4, 5000): ([(0, 5000, 1)], "a"), (None, 12): ([(0, 12, 1)], "b c"), (4, 12): ([(0, 12, 3)], "x y z"), (5, 11): ([], rows[6][1].strip()),
        (6, 12): ([(0, 12, 2)], "A a"), (7, 30_000): ([], rows[8][1]),
    }
    assert periodic_runs.detect(df.limit(0), "id", "t").collect() == []


# vectors


def coded(rows, parts=4, entries=256, rounds=4):
    """(codebooks, {id: (code, error)}) of (id, vector) by plain search."""
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[x[p * width : (p + 1) * width] for _, x in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(books[p], x)[1] for x in cut[p]]
            members = [[x for x, k in zip(cut[p], of, strict=True) if k == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(members, books[p], strict=True)]
    found = [[near(books[p], x) for x in cut[p]] for p in range(parts)]
    return books, [(i, "".join(f"{found[p][k][1]:02x}" for p in range(parts)), sum(found[p][k][0] for p in range(parts))) for k, (i, _) in enumerate(kept)]


def test_op13_of_two_dimensions_a_part(spark, tmp_path):
    """The query on a table with unusable rows, against plain search."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)], int(i) % 3) for i in rng.permutation(400)]
    rows += [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, None), (1004, [0.25] * 8, None), (1005, [0.25] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    books, expected = coded([(i, v) for i, v, _ in rows])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == expected
    assert {r["codebooks_sha256"] for r in got} == {sha(",".join(str(x) for b in books for e in b for x in e))}
    labels = {i: label for i, _, label in rows}
    for r in got:
        assert r["label_error"] == sum(e for i, _, e in expected if labels[i] == labels[r["vec_id"]])


def test_partial_distances_are_exact():
    rng = np.random.default_rng(4)
    for width, spread in ((1, 3), (2, 3), (16, 4), (16, 3000), (5, 1)):
        entries = rng.integers(-spread, spread + 1, (2, 40, width))
        books, x = vector_codes.Codebooks(entries), rng.integers(-spread, spread + 1, (500, 2 * width))
        codes, error = books.assign(x, rows=64)
        far = [((x[:, None, p * width : (p + 1) * width] - entries[p]) ** 2).sum(axis=2) for p in range(2)]
        assert (codes == np.stack([f.argmin(axis=1) for f in far], axis=1)).all()  # of ties the lowest
        assert (error == sum(f.min(axis=1) for f in far)).all()


def test_vector_codes_hard_rows(spark):
    rows = [(5, [1.0] * 6, "a"), (5, [2.0] * 6, "a"), (None, [1.0] * 6, None), (7, [1.0] * 5, "b"), (8, [], "b"), (9, [3e30] * 6, "b"), (10, [-1.5] * 6, "b")]
    df = spark.createDataFrame([(i, v, x, "c", 1) for i, v, x in rows], "id long, v array<double>, kind string, code string, error int")
    found, books = vector_codes.compress(df, "id", "v", "kind")
    got = sorted(((r["id"] or 0, r["label"], r["code"], r["error"], r["label_error"]) for r in found.collect()), key=str)
    assert books.entries.shape == (4, 3, 2)  # three rows with ids, six components filled up to eight
    assert got == sorted([(5, "a", "00000000", 0, 0), (5, "a", "01010100", 0, 0), (0, None, "00000000", 0, 0), (10, "b", "02020200", 0, 0)], key=str)
    assert vector_codes.compress(df.limit(0), "id", "v", "kind")[0].collect() == []
