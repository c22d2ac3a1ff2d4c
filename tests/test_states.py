"""Streams with state: end to end from JSON lines, services of cases, clocks of confirmations, states that end."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillwork.operators.booking import confirmation_state
from quillwork.streaming import jobs

T = dt.datetime
WON, FAILED, GONE = "payment_intent.succeeded", "payment_intent.payment_failed", "payment_intent.canceled"


def day(n, hour=0):
    return T(2024, 1, 1, hour) + dt.timedelta(days=n - 1)


def line(event, at, kind, intent, request=7, error=None):
    thing = {"id": intent, "amount": 45000, "currency": "mad", "metadata": {"legal_aid_request_id": str(request)}}
    if error:
        thing["last_payment_error"] = {"code": error, "message": f"{error}!"}
    return json.dumps({"id": event, "ts": at.isoformat(), "type": kind, "data": {"object": thing}})


def put(spark, place, rows, schema=None):
    df = spark.createDataFrame([(r,) for r in rows], "value string") if schema is None else spark.createDataFrame(rows, schema)
    (df.coalesce(1).write.mode("append").text if schema is None else df.coalesce(1).write.mode("append").parquet)(f"{place}/in")


def test_webhooks_end_to_end(spark, tmp_path):
    """Repeated, broken, unknown and incomplete lines; a later failure replaces a success; states go on over runs."""
    requests = spark.createDataFrame([(7,)], "id long")

    def run():
        jobs.webhook_stream(spark.readStream.text(f"{tmp_path}/in"), requests, str(tmp_path), lateness="30 days")

    put(spark, tmp_path, [line("e1", day(1), WON, "pi_a"), line("e1", day(1), WON, "pi_a"), line("e2", day(2), FAILED, "pi_b", error="early"), "{", '"text"', line("e3", day(2), "charge.updated", "pi_a")])
    run()
    put(spark, tmp_path, [line("e1", day(1), WON, "pi_a"), line("e4", day(3), FAILED, "pi_a", error="declined"), line("e5", day(4), WON, "pi_b", request=99), line("e6", day(4), WON, None)])
    run()
    put(spark, tmp_path, [line("e4", day(3), FAILED, "pi_a", error="declined"), line("e7", day(5), WON, "pi_b")])
    run()
    last = jobs._last_states(spark, str(tmp_path), f"{jobs.FOLD}, events long", "intent_id", ["status", "ever_succeeded", "failure_code", "failure_message", "events"])
    assert {r.intent_id: tuple(r)[1:] for r in last.collect()} == {"pi_a": ("failed", True, "declined", "declined!", 2), "pi_b": ("succeeded", True, None, None, 3)}
    rejects = spark.read.parquet(f"{tmp_path}/rejects")
    assert sorted((r.reason, r.event_id or "", r.value[:6]) for r in rejects.collect()) == [("broken", "", '"text"'), ("broken", "", "{"), ("incomplete", "e6", '{"id":'), ("unknown type", "e3", '{"id":')]


def test_order_and_batches_do_not_matter(spark, tmp_path):
    """The same events in one batch, or one by one from the last to the first, leave the same states."""
    kinds = "event_id long, ts timestamp_ntz, type string, intent_id string, request_id long, failure_code string, failure_message string"
    events = [(n, day(n), (WON, FAILED, GONE, WON, FAILED)[n % 5], f"pi_{n % 3}", 7 if n % 4 else 99, f"c{n}" if n % 5 in (1, 4) else None, None) for n in range(1, 25)]
    found = []
    for name, cuts in (("one", [events]), ("many", [[e] for e in reversed(events[:6])] + [events[6:]])):
        place = tmp_path / name
        for some in cuts:
            put(spark, place, some, kinds)
            jobs.run_now(jobs.webhook_fold(spark.readStream.schema(kinds).parquet(f"{place}/in"), spark.createDataFrame([(7,)], "id long")), f"{place}/out", "update", f"{place}/state")
        last = jobs._last_states(spark, str(place), jobs.FOLD, "intent_id", ["status", "ever_succeeded", "failure_code"])
        found.append(sorted(map(tuple, last.collect())))
    assert found[0] == found[1] and len(found[0]) == 3


def test_states_of_intents_end(spark, tmp_path):
    """An intent whose last event is older than its time to live is forgotten: a failure then finds nothing to change."""
    requests = spark.createDataFrame([(7,)], "id long")
    kinds = "event_id long, ts timestamp_ntz, type string, intent_id string, request_id long, failure_code string, failure_message string"

    def run(*events):
        put(spark, tmp_path, list(events), kinds)
        rows = jobs.payment_states(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), requests, lateness="1 day", keep_days=10)
        jobs.run_now(rows, f"{tmp_path}/out", "update", f"{tmp_path}/state")

    run((1, day(1), WON, "old", 7, None, None), (2, day(8), WON, "new", 7, None, None))
    run((3, day(15), GONE, "other", 7, None, None))  # the mark is now day 14: 'old' ended on day 11, 'new' ends on day 18
    run((4, day(16), FAILED, "old", 7, "x", "y"), (5, day(16), FAILED, "new", 7, "x", "y"))
    rows = spark.read.parquet(f"{tmp_path}/out").where("failure_code = 'x'").collect()
    assert [(r.intent_id, r.status) for r in rows] == [("new", "failed")]


def test_services_of_cases(spark, tmp_path):
    """Which services are done, and when; open again after the second toggle; without a service id too; late batches count by seq."""
    kinds = "case_id long, seq long, at timestamp_ntz, action string, service_id long, user_id long"
    batches = [
        [(1, 1, day(1), "toggle", 5, 9), (1, 2, day(2), "toggle", 6, 9), (1, 3, day(3), "toggle", None, 9), (2, 9, day(9), "toggle", 5, 9)],
        [(1, 6, day(6), "toggle", 5, 9), (1, 7, day(7), "toggle", 5, 9), (2, 11, day(11), "toggle", 5, 9)],
        [(1, 4, day(4), "toggle", 6, 9), (2, 10, day(10), "toggle", 5, 9), (1, 8, day(8), "note", None, 9)],
    ]
    for some in batches:
        put(spark, tmp_path, some, kinds)
        jobs.run_now(jobs.case_state_stream(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", "update", f"{tmp_path}/state")
    saved = spark.read.parquet(f"{tmp_path}/out")
    rows = saved.select("case_id", "batch", F.explode("changed").alias("c")).select("case_id", "batch", "c.*").collect()
    state = {}
    for r in sorted(rows, key=lambda r: r.batch):
        state[r.case_id, r.service_id] = r.completed_at
    assert state == {(1, 5): day(7), (1, 6): None, (1, None): day(3), (2, 5): day(11)}
    assert {(r.case_id, r.batch): r.completed for r in saved.collect()} == {(1, 0): 3, (2, 0): 1, (1, 1): 3, (2, 1): 0, (1, 2): 2, (2, 2): 1}


def test_states_of_cases_end(spark, tmp_path):
    kinds = "case_id long, seq long, at timestamp_ntz, action string, service_id long, user_id long"
    for some in ([(1, 1, day(1), "toggle", 5, 9)], [(2, 2, day(40), "note", None, 9)], [(1, 3, day(41), "toggle", 5, 9)]):
        put(spark, tmp_path, some, kinds)
        rows = jobs.case_state_stream(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), lateness="2 days", keep_days=20)
        jobs.run_now(rows, f"{tmp_path}/out", "update", f"{tmp_path}/state")
    got = [r.completed for r in spark.read.parquet(f"{tmp_path}/out").where("case_id = 1").orderBy("batch").collect()]
    assert got == [1, 1]  # a case that was kept would have its service open again


EVENTS = "token long, kind string, attempt_id long, at timestamp_ntz, expires_at timestamp_ntz"


@pytest.mark.parametrize("cuts", [1, 4])
def test_confirmations_by_the_clock(spark, tmp_path, cuts):
    """Every attempt is judged as the batch operator does at its time, over one batch or several; timers tell what expires."""
    made = lambda token, n, ends=True: (token, "created", None, day(n), day(n + 1) if ends else None)
    tried = lambda token, attempt, n, hour=0: (token, "confirm", attempt, day(n, hour), None)
    events = [
        made(1, 1), tried(1, 10, 1, 5), tried(1, 11, 1, 6),  # confirmed, then again
        made(2, 1), tried(2, 20, 3),  # late
        made(3, 1), made(4, 2), tried(4, 40, 3),  # never tried; tried at the last moment
        tried(5, 50, 2), made(6, 3, ends=False), tried(6, 60, 3, 1), made(7, 9),  # unknown; without an end; still pending
    ]
    events.sort(key=lambda e: e[3])
    for k in range(cuts):
        put(spark, tmp_path, events[k * len(events) // cuts : (k + 1) * len(events) // cuts], EVENTS)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_now(jobs.confirmation_stream(stream, "12 hours"), f"{tmp_path}/out", "append", f"{tmp_path}/state")
    got = {(r.token, r.attempt_id): r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    created = {e[0]: e for e in events if e[1] == "created"}
    rows = [(t, a, created[t][4] if t in created else None, day(1, 5) if (t, a) == (1, 11) else None, t in created, at) for t, kind, a, at, _ in events if kind == "confirm"]
    judged = spark.createDataFrame(rows, "token long, attempt_id long, ends timestamp_ntz, used timestamp_ntz, there boolean, now timestamp_ntz")
    want = {(r.token, r.attempt_id): r.s for r in judged.select("token", "attempt_id", confirmation_state(F.col("ends"), F.col("used"), F.col("there"), F.col("now")).alias("s")).collect()}
    assert got == want | {(2, None): "expired", (3, None): "expired", (6, None): "expired"}
    assert want == {(1, 10): "ok", (1, 11): "invalid", (2, 20): "expired", (4, 40): "ok", (5, 50): "invalid", (6, 60): "expired"}


class Store:
    """The calls of a stateful processor on its handle, counted, in memory."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, *schema):
        return Kept(self, name)

    getMapState = getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


class Kept:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls += 1
        return self.store.values.get(self.name, [] if self.name == "tokens" else None)

    def put(self, value):
        self.store.calls += 1
        self.store.values[self.name] = value

    update = put

    def updateValue(self, key, value):
        self.store.calls += 1
        self.store.values.setdefault("map", {})[key] = value

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.store.values.get("map", {})

    def clear(self):
        self.store.values.pop(self.name, None)


def test_calls_do_not_grow_with_events():
    """A batch costs an intent, or a group of tokens, a few calls of the store, whatever its rows; ids count once beyond `few` too."""
    from pyspark.sql import Row

    from quillwork.streaming import states

    event = lambda n: Row(at=n * 1000, event_id=n, status="succeeded", known=True, failure_code=None, failure_message=None)
    for few, most in ((1024, 3), (10, 1000)):
        store = Store()
        fold = states.PaymentFold(1000, "long", True, few)
        fold.init(store)
        for batch in (range(50), range(20, 100)):
            store.calls = 0
            (out,) = fold.handleInputRows(("pi",), iter([event(n) for n in batch]), store)
            assert store.calls <= most
        assert out.events == 100
        store.now = 1050  # an old timer fires: the intent ends later
        assert list(fold.handleExpiredTimer(("pi",), store, None)) == [] and "fold" in store.values and 99 + 1000 in store.timers
        store.now = 1099
        list(fold.handleExpiredTimer(("pi",), store, None))
        assert "fold" not in store.values
    store, clock = Store(), states.ConfirmationClock(10)
    clock.init(store)
    rows = [Row(token=n, kind="created", attempt_id=None, at=0, expires_at=n * 1000) for n in range(1, 101)] + [Row(token=5, kind="confirm", attempt_id=1, at=1, expires_at=None)]
    assert [(r.token, r.outcome) for r in clock.handleInputRows((0,), iter(rows), store)] == [(5, "ok")] and store.calls == 3 and store.timers == {2}
    store.now = 60
    assert [r.token for r in clock.handleExpiredTimer((0,), store, None)] == [n for n in range(1, 60) if n != 5] and min(t for t in store.timers if t > 2) == 61
    assert 5 not in {t[0] for t in store.values["tokens"]} and len(store.values["tokens"]) == 99
