"""The URL threshold comes from all labelled rows, and the sample from every URL by its rows."""

import random

import duckdb

from normscope.llm import base, oracle, queries, url_filter


def test_threshold_and_sample_cover_all_rows(spark, monkeypatch):
    r = random.Random(3)
    word = lambda signs: "".join(r.choices(signs, k=8))
    rows = [(f"http://{word('abcdefgh')}.org/{word('abcdij')}", True) for _ in range(300)] + [(f"http://{word('efghijkl')}.com/{word('cdijkl')}", False) for _ in range(300)]
    rows += [("http://often.org/always", True)] * 300
    seen, stored = {}, base.stored

    def keep(df, purpose):
        seen[purpose] = stored(df, purpose)
        return seen[purpose]

    monkeypatch.setattr(base, "stored", keep)
    df = spark.createDataFrame(rows, "url string, accepted boolean")
    ratio = url_filter.learn(df, max_labelled=60)
    sample = {(x["url"], x["accepted"]): x["n_rows"] for x in seen["url-sample"].collect()}
    assert sample["http://often.org/always", True] == 30 and all(20 <= sum(n for (_, a), n in sample.items() if a == k) <= 100 for k in (True, False))
    scored = [(x["difference"], x["accepted"]) for x in ratio.score(df).collect()]

    def worth(t):
        return round(sum(d < t and not a for d, a in scored) / 300 - sum(d < t and a for d, a in scored) / 600, 9)

    assert ratio.threshold == min({d for d, _ in scored}, key=lambda t: (-worth(t), t))


def test_models_count_all_labelled_rows(spark, tmp_path):
    """Above 20,000 labelled rows a class, the query still equals the SQL, which counts every row."""
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT j AS page_id, CASE WHEN i % 40 = 0 THEN 'http://' || translate(md5(i::VARCHAR)[:12], '01234', 'ghijk') || '.net/a' WHEN i % 40 = 1 THEN 'http://' || md5(i::VARCHAR)[:12] || '.net/de/' || i % 7 WHEN i % 11 = 0 THEN 'http://often.org/' || i % 3
        WHEN i % 2 = 0 THEN 'http://' || translate(md5(i::VARCHAR)[:12], '01234', 'ghijk') || '.org/a' ELSE 'http://' || md5(i::VARCHAR)[:12] || '.com/de/' || i % 5 END AS url FROM (SELECT j, j // 40 AS i FROM range(52000) t(j))) TO '{tmp_path}/pages.parquet'"""
    )
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    wanted = con.execute(oracle.ORACLES["op7_url_filter"])
    order = [d[0] for d in wanted.description]
    got = queries.op7_url_filter(spark, str(tmp_path)).collect()
    assert all(sum(r["rule"] == k for r in got) > 20_000 for k in ("org/", "com/de/"))
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
    assert sorted(map(str, wanted.fetchall())) == sorted(str(tuple(r[c] for c in order)) for r in got)
