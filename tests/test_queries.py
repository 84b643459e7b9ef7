import hmac
import hashlib

import pytest

from halyard import registry
from halyard.plans.scalars import KEY
from oracle import assert_same, connect

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, db, name):
    assert_same(registry.queries()[name](spark, small), db, SQL[name])


def test_keyed_digests_equal_the_library(spark, small):
    names = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{small}/customer.parquet").collect()}
    want = {k: hmac.new(KEY, v.encode(), hashlib.sha256).hexdigest() for k, v in names.items()}
    assert {r["c_custkey"]: r["digest"] for r in registry.queries()["hmac_hex"](spark, small).collect()} == want
    for r in registry.queries()["hmac_scale"](spark, small).collect():
        assert r["shift"] == int(int(want[r["c_custkey"]][:12], 16) / 2**48 * 61) - 30
    uids = [r["uid"] for r in registry.queries()["hmac_uid"](spark, small).limit(20).collect()]
    for u in uids:
        n = int(u.removeprefix("2.25."))
        assert n >> 76 & 0xF == 4 and n >> 62 & 3 == 2 and n < 1 << 128


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_orderkey", "display_set", "position", "l_partkey", "l_extendedprice"] and df.count() > 0


def test_filters_reach_the_scan(spark, small):
    plan = registry.queries()["find_match_project"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull" in plan or "PushedFilters: [In(" in plan
    assert "o_totalprice" not in plan  # columns that are not asked for are not read
