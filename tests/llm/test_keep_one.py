"""Near-duplicate classes where ids repeat or are missing."""

import random

from normscope.llm import ngram_join

SCHEMA = "doc_id long, text string"


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))


def kept(spark, rows):
    return sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())


def test_unrelated_texts_of_one_id_stay(spark):
    many = [(5, text(k)) for k in range(20)]
    assert kept(spark, many + [many[3]]) == sorted(many)


def test_a_near_copy_takes_no_other_text_of_its_id_away(spark):
    a, b = text("a"), text("b")
    assert kept(spark, [(3, a), (5, a + " more"), (5, b)]) == [(3, a), (5, b)]


def test_near_copies_of_one_id_leave_one(spark):
    got = kept(spark, [(5, text("a")), (5, text("a") + " more"), (7, text("a"))])
    assert len(got) == 1 and got[0][0] == 5


def test_missing_ids_with_white_space_variants_leave_one(spark):
    a, b = text("a"), text("b")
    rows = [(None, a), (None, a.replace(" ", "  ")), (None, a + "\n"), (None, b), (None, b)]
    got = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["text"].split() for r in got) == sorted([a.split(), b.split()])
