"""Each case is announced once over several runs; announcements are cases and packets, not pairs."""

import datetime as dt
from decimal import Decimal

import pytest

from quillwork.streaming import notify
from quillwork.streaming.index import BucketedTable

NOW = dt.datetime(2024, 5, 1)
REQUESTS = "id long, ticket_number string, status string, base_price decimal(10,2)"


@pytest.fixture
def log(spark, tmp_path):
    return BucketedTable(spark, f"{tmp_path}/log", notify.CASES, buckets=4)


def run(spark, log, n, states, advisors=3, size=2):
    rows = [(k, f"T{k}", status, None if price is None else Decimal(price)) for k, (status, price) in states.items()]
    users = spark.createDataFrame([(k, f"a{k % 5}@x" if k else None, "advisor") for k in range(advisors + 1)] + [(99, "u@x", "user")], "id long, email string, role string")
    return notify.announce(spark.createDataFrame(rows, REQUESTS), users, log, "job", n, NOW, size)["pushed"]


def seen(log):
    return {r.id: r.version for r in notify.announced(log).collect()}


def test_once_over_runs(spark, log):
    """Free at booking, paid, or confirmed and not free; not again when the status goes back and forth."""
    assert run(spark, log, 0, {1: ("pending", 0), 2: ("pending_payment", 5), 3: ("confirmed", 0), 4: ("confirmed", None), 5: ("pending", None)}) == 2
    assert run(spark, log, 1, {1: ("confirmed", 0), 2: ("paid", 5), 3: ("confirmed", 0), 4: ("pending_payment", None)}) == 1
    assert run(spark, log, 2, {1: ("pending", 0), 2: ("paid", 5), 4: ("confirmed", None)}) == 0
    assert run(spark, log, 1, {7: ("paid", 5)}) == 0  # a run that was done is not done again
    assert seen(log) == {1: 0, 4: 0, 2: 1}


def test_without_advisors_cases_wait(spark, log):
    assert run(spark, log, 0, {1: ("paid", 5)}, advisors=0) == 0
    assert run(spark, log, 0, {1: ("paid", 5)}) == 1
    assert seen(log) == {1: 0}


def test_messages_of_a_run_by_parts(spark, log):
    run(spark, log, 0, {k: ("paid", 5) for k in range(20)}, advisors=7)
    assert sorted(e for r in notify.recipients(log, 0).collect() for e in r.emails) == [f"a{k}@x" for k in range(5)]  # each address once
    parts = [notify.messages(log, 0, k, 3).collect() for k in range(3)]
    pairs = [(r.ticket_number, e) for part in parts for r in part for e in r.emails]
    assert len(pairs) == len(set(pairs)) == 100 and all(parts)
    assert sum(map(len, parts)) < len(pairs)
    assert notify.messages(log, 0)._jdf.queryExecution().optimizedPlan().toString().count("Cross") == 0


def test_packets_have_copies_for_many_cases(spark, log, monkeypatch):
    """One packet is not one task's: its copies are met by a share of the cases each; every case meets every packet once."""
    monkeypatch.setattr(notify, "CASES_A_COPY", 5)
    run(spark, log, 0, {k: ("paid", 5) for k in range(40)}, advisors=7, size=100)
    plan = notify.messages(log, 0)
    assert sorted((r.ticket_number, r.addresses, len(r.emails)) for r in plan.collect()) == sorted((f"T{k}", 5, 5) for k in range(40))
    assert "copy" in plan._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
