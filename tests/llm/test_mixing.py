"""Mixing: what goes through a shuffle."""

from voxloom.llm import mixing


def shuffled(plan) -> int:
    """Rows written to shuffles by a plan that has run."""
    name, metrics = plan.nodeName(), plan.metrics()
    own = metrics.apply("shuffleRecordsWritten").value() if name == "Exchange" and metrics.contains("shuffleRecordsWritten") else 0
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.getClass().getSimpleName() else None
    children = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    return own + sum(map(shuffled, children))


def test_only_buckets_that_a_budget_cuts_are_dealt(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "'en' as lang", "if(id % 3 = 0, 'src0', 'src1') as source")
    mixed = mixing.mix(docs, carry=True).select("row.*", "epoch", "leaf_budget")
    rows = mixed.collect()
    assert shuffled(mixed._jdf.queryExecution().executedPlan()) < 500  # of 20,000 rows, all of which were dealt before
    plan = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.epoch) for r in rows) == sorted((r.doc_id, r.epoch) for r in plan)
    for source in ("src0", "src1"):
        own = [r for r in plan if r.source == source]
        assert 0 <= own[0].leaf_budget - sum(r.n_tokens for r in own) < 7  # a prefix: less than a document is left
