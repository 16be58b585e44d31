"""The run's metrics are those of the whole run."""

from normscope.plans import queries


def test_run_metrics_are_those_of_the_six_detector_run(spark):
    log = "/root/testdata/sf0.01"
    assert queries.run_metrics(spark, log).first()["cases_created"] == queries.flagship_case_queue(spark, log).count()
