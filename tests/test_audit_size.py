"""What the audit leaves to the driver."""

from citelake import audit
from citelake.plans import judging_queries


def test_staged_tables_of_the_audit_are_not_broadcast(spark, monkeypatch):
    plans, write = [], audit.stage
    monkeypatch.setattr(audit, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    whole = judging_queries.audit_of_parts(spark, "/root/testdata/sf0.001")
    assert whole.claims.columns
    whole.close()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
