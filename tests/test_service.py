"""Audits kept as tables: overrides, re-checks and what is derived from them."""

import json

import pytest
from pyspark.sql import functions as F

from citelake.plans.judging_queries import audit_of_parts
from citelake.service import AuditService, check_options


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    a = audit_of_parts(spark, "/root/testdata/sf0.001")
    few = F.col("run_id").isin("1", "2")
    service = AuditService(spark, str(tmp_path_factory.mktemp("audits")))
    service.audit(a.manuscripts.where(few), a.replies.where(few), a.sources.where(few))
    return service


def state(service, run_id="1", key="3"):
    r = service.entries(run_id).where(F.col("key") == key).first()
    return r["verdict"], r["reviewed_source"]


def test_overrides_and_rechecks(service):
    before = state(service)
    others = {(r["run_id"], r["key"]): r["verdict"] for r in service.entries().collect() if (r["run_id"], r["key"]) != ("1", "3")}
    service.set_verdict("1", "3", "unrelated", "read it", claim_no=0)
    assert state(service) == ("unrelated", "claims")
    service.set_verdict("1", "3", "weak")
    assert state(service) == ("weak", "reference")
    service.set_verdict("1", "3", clear=True)
    service.set_verdict("1", "3", clear=True, claim_no=0)
    assert state(service) == before
    service.recheck("1", "3", "unverified", "")
    assert state(service) == before
    service.set_verdict("1", "3", "weak")
    service.recheck("1", "3", "supported", "lexical")
    assert state(service) == ("supported", "")
    assert others == {(r["run_id"], r["key"]): r["verdict"] for r in service.entries().collect() if (r["run_id"], r["key"]) != ("1", "3")}


def test_wrong_calls(service):
    with pytest.raises(ValueError):
        service.set_verdict("1", "3", "perhaps")
    with pytest.raises(KeyError):
        service.set_verdict("1", "99", "weak")
    with pytest.raises(KeyError):
        service.set_verdict("1", "3", "weak", claim_no=50)


def test_documents_and_risk(service):
    rows = {r["run_id"]: [json.loads(x)["key"] for x in r["references"]] for r in service.documents().collect()}
    assert rows["1"] == [str(k) for k in range(1, 11)]
    assert {r["run_id"] for r in service.risk().collect()} == {"1", "2"} and service.runs().count() == 2
    assert "supported" in service.capabilities()["verdicts"]


def test_options():
    got = check_options({"reference_cap": "9999", "claim_cap": "x", "contact_email": "a@b.org"})
    assert (got["reference_cap"], got["claim_cap"], got["contact_email"]) == (500, 6, "a@b.org")
    for bad in ({"contact_email": "nobody"}, {"api_key": "short"}, {"provider": "unknown"}, {"model": "no spaces"}, {"provider": "custom", "base_url": "http://a"}):
        with pytest.raises(ValueError):
            check_options(bad)
