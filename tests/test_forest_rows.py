"""A forest's trees draw from all rows of their scope."""

import pickle

from pyspark.sql import functions as F

from normscope.operators import forest
from normscope.spec import EventSpec


def test_rows_of_high_hashes_are_drawn(spark):
    # the 1,808 rows of the highest hashes hold large values
    ids = spark.range(10_000).withColumnRenamed("id", "event_id").withColumn("h", F.xxhash64("event_id")).orderBy("h").collect()
    rows = [(r["event_id"], "e", k / 1e4 + 100.0 * (k >= 8192), k % 7 / 7.0) for k, r in enumerate(ids)]
    spec = EventSpec(numeric=("a", "b"), categorical=())
    log = spark.createDataFrame(rows, "event_id long, entity_id string, a double, b double")
    model = pickle.loads(forest.fit(log, spec).where("scope_key = '*'").first()["model"])
    assert model.sample == 256 and len(model.trees) == 100
    assert sum((threshold > 1).any() for _, threshold, *_ in model.trees) > 90
