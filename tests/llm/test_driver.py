"""What the driver plans and starts doesn't outgrow its memory: small plans, few jobs, same results."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.llm import components, secrets


def test_findings_and_forest_make_small_plans(spark):
    """The driver writes, compiles and keeps the plans' code; that of the findings had 657,000 characters."""
    found = secrets.labelled_findings(spark, 600)
    code = found._jdf.queryExecution().debug().codegenToSeq()
    assert sum(len(code.apply(i)._2()) for i in range(code.size())) < 60_000
    rows = spark.range(1).select(*(F.lit(0.5).alias(k) for k in secrets.FEATURES))
    plan = rows.select(secrets.forest_column(secrets.fit_forest(found), F.col))._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN") <= 2  # in the expression and its name, not one a node


@pytest.mark.parametrize("rows", [1 << 15, 40])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, rows):
    """A chain of ascending ids lost four nodes a round, so that one of over 240 ended in an error."""
    monkeypatch.setattr(components, "ROWS", rows)
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(a, a + 1) for a in range(1000, 1400)]
    up = {x: x for pair in links for x in pair}
    for _ in up:  # plainly: until nothing changes
        before = dict(up)
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            break
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), most_rounds=8).collect()}
    assert found == {k: v for k, v in up.items() if k not in alone}


def test_few_links_take_few_jobs(spark):
    """A path of 300 nodes took over 20 jobs in rounds."""
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    spark.sparkContext.setJobGroup("few links", "")
    try:
        found = components.connected_components(links)
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert found.where("component = 0").count() == 301
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8
