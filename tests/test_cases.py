import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from quillwork.operators import booking as K
from quillwork.operators import cases as C
from quillwork.operators import maintain as M
from quillwork.operators import payments as Y
from quillwork.operators import pricing as P

D = Decimal
T = dt.datetime


def requests(spark, *rows):
    names = ("id", "status", "base_price", "case_status", "advisor_id", "created_at", "service_id", "ticket_number", "paid_at", "receipt_path")
    kinds = "id long, status string, base_price decimal(10,2), case_status string, advisor_id long, created_at timestamp_ntz, service_id long, ticket_number string, paid_at timestamp_ntz, receipt_path string"
    full = [tuple({"case_status": "open", "created_at": T(2024, 1, 1), "ticket_number": f"T{r['id']}", "base_price": D(500), **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, kinds)


def test_prices(spark):
    rows = spark.createDataFrame([(D("500.00"),), (D("25.25"),), (D("300.00"),), (None,)], "p decimal(10,2)")
    got = rows.select(P.online_total(F.col("p")).alias("a"), P.bank_total(F.col("p")).alias("b"), P.to_cents(P.online_total(F.col("p"))).alias("c")).collect()
    assert [tuple(r) for r in got] == [(D("450.00"), D("550.00"), 45000), (D("22.73"), D("27.78"), 2273), (D("270.00"), D("330.00"), 27000), (None, None, None)]


def test_price_label(spark):
    rows = spark.createDataFrame([(None, D("1234.50")), ("0", D("2.50")), ("from 3", D(1)), ("", D(0)), (None, None)], "s string, p decimal(10,2)")
    assert [r.x for r in rows.select(P.price_label(F.col("s"), F.col("p")).alias("x")).collect()] == ["1,235 MAD", "3 MAD", "from 3", "Free", "Free"]


def services(spark):
    return spark.createDataFrame([(1, D(0), True, True), (2, D(300), True, False), (3, D(200), False, False), (4, D(1), False, True)], "id long, price decimal(10,2), allows_office boolean, allows_whatsapp boolean")


def test_modes(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 2), (3, 4)], "request_id long, service_id long")
    get = lambda **k: {r.request_id: r.modes for r in K.common_modes(pairs, services(spark), **k).collect()}
    assert get() == {1: ["office"], 2: [], 3: []}
    assert get(empty_modes="ignore") == {1: ["office"], 2: ["office"], 3: []}
    assert {r.id: r.modes for r in K.service_modes(services(spark)).collect()} == {1: "office,whatsapp", 2: "office", 3: "whatsapp", 4: "whatsapp"}


def test_bookings(spark):
    kinds = "id long, full_name string, email string, phone string, whatsapp string, case_description string, service_ids array<bigint>, consultation_mode string, payment_method string"
    rows = [
        (1, "A", "a@b.c", " +212 600-000-000", None, "x", [2, 1, 1], "office", None),
        (2, "B", "b@b.c", "+212600000000", None, "x", [99], None, "bank"),
        (3, None, "bad", "12", "1", "", None, "phone", "cash"),
        (4, "D", "d@b.c", "+212600000000", None, "x", [1], "whatsapp", "bank"),
    ]
    b = spark.createDataFrame(rows, kinds)
    errors = {r.id: r.errors for r in K.validate_bookings(b, services(spark)).collect()}
    assert errors == {1: "service_ids.distinct", 2: "service_ids.exists", 3: "full_name,email,phone,whatsapp,case_description,service_ids,consultation_mode,payment_method", 4: ""}
    made = {r.id: (r.base_price, r.service_id, r.consultation_mode, r.payment_method, r.status) for r in K.book_requests(b, services(spark)).collect()}
    assert made == {1: (D(300), 1, "office", "google_pay", "pending_payment"), 4: (D(0), 1, "whatsapp", "bank", "pending")}


def test_rules_of_the_services_chosen(spark):
    kinds = "id long, service_ids array<bigint>, consultation_mode string, payment_method string, call_time string"
    rows = [(1, [1], None, None, None), (2, [2], "whatsapp", "", None), (3, [2, 3], "phone", None, None), (4, [99], None, None, None), (5, [2, 2], "office", "bank", None), (6, [1, 2], "", "bank", None)]
    got = {r.id: r.errors for r in K.conditional_errors(spark.createDataFrame(rows, kinds), services(spark)).collect()}
    assert got == {1: "consultation_mode.required", 2: "consultation_mode.allowed,payment_method.required", 3: "payment_method.required", 4: "", 5: "", 6: "consultation_mode.required"}


def test_call_time(spark):
    kinds = "id long, full_name string, email string, phone string, whatsapp string, case_description string, service_ids array<bigint>, consultation_mode string, payment_method string, call_time string"
    rows = [(n, "A", "a@b.c", "+212600000000", None, "x", [1], "office", "bank", at) for n, at in enumerate([None, "x" * 20, "x" * 21])]
    assert {r.id: r.errors for r in K.validate_bookings(spark.createDataFrame(rows, kinds), services(spark)).collect()} == {0: "", 1: "", 2: "call_time"}


def test_localized_services(spark):
    names = ("name", "description", "notes", "additional_notes", "price_display")
    kinds = "id long, price decimal(10,2), " + ", ".join(f"{n}_{x} string" for n in names for x in ("en", "fr"))
    rows = [(1, D(5), "n", None, "d", "", "o", "", "a", "0", "p", None), (2, D(0), "n", "m", "d", None, None, None, "a", "b", None, "")]
    got = [tuple(r) for r in P.localized_services(spark.createDataFrame(rows, kinds), "fr").orderBy("id").collect()]
    assert got == [(1, "n", "", "o", "a", "p", "p"), (2, "m", "d", None, "b", None, "Gratuit")]


def test_confirmation_state(spark):
    now = F.lit(T(2024, 1, 2))
    rows = spark.createDataFrame([(T(2024, 1, 1), None), (None, None), (T(2024, 1, 3), None), (T(2024, 1, 1), T(2024, 1, 1))], "e timestamp, c timestamp")
    assert [r.x for r in rows.select(K.confirmation_state(F.col("e"), F.col("c"), F.lit(True), now).alias("x")).collect()] == ["expired", "expired", "ok", "invalid"]


def test_case_filters(spark):
    r = requests(spark, {"id": 1, "status": "pending", "base_price": D(0)}, {"id": 2, "status": "confirmed", "base_price": D(0)}, {"id": 3, "status": "confirmed"}, {"id": 4, "status": "paid"}, {"id": 5, "status": "pending_payment"}, {"id": 6, "status": "confirmed", "base_price": None})
    ids = lambda f: sorted(x.id for x in f.collect())
    assert ids(C.visible_cases(r)) == [1, 2, 3, 4, 6]
    assert ids(C.case_filter_payment(r, "free")) == [1, 2]
    assert ids(C.case_filter_payment(r, "confirmed")) == [3, 6]
    assert ids(C.case_filter_payment(r, "paid")) == [4]
    assert ids(C.case_filter_payment(r, "?")) == ids(C.case_filter_status(r, "?")) == [1, 2, 3, 4, 5, 6]
    assert tuple(C.payment_split(r).first()) == (1, 2, 2)
    assert tuple(C.payment_split(r.limit(0)).first()) == (0, 0, 0)


def test_case_page(spark):
    r = requests(spark, *[{"id": n, "status": "paid", "created_at": T(2024, 1, 20 - n), "case_status": "closed" if n == 3 else "open"} for n in range(12)])
    assert [x.id for x in C.case_page(r).collect()] == [3, 11, 10, 9]
    assert C.case_page(r, page=3).count() == 4 and C.case_page(r, page=4).count() == 0


def test_progress(spark):
    r = requests(spark, {"id": 1, "status": "paid", "service_id": 7}, {"id": 2, "status": "paid", "service_id": 8}, {"id": 3, "status": "paid"})
    pairs = spark.createDataFrame([(1, 7, T(2024, 1, 1)), (1, 9, None), (1, 10, None)], "request_id long, service_id long, completed_at timestamp_ntz")
    s = C.selected_services(r, pairs)
    assert sorted((x.request_id, x.service_id) for x in s.collect()) == [(1, 7), (1, 9), (1, 10), (2, 8)]
    assert sorted(tuple(x) for x in C.task_progress(r, s).collect()) == [(1, 3, 1, 33), (2, 1, 0, 0), (3, 0, 0, 0)]
    assert C.fully_completed(s).count() == 0


def test_fanout_without_advisors(spark):
    r = requests(spark, {"id": 1, "status": "paid"})
    none = spark.createDataFrame([], "id long, name string, email string, role string")
    assert C.notification_fanout(r, none).count() == 0
    many = spark.range(5).select("id", F.lit("advisor").alias("role"), F.col("id").cast("string").alias("email"))
    assert C.notification_fanout(r, many).count() == C.notification_fanout(r, many, most=2).count() == 5


def test_events(spark):
    r = requests(spark, {"id": 1, "status": "pending_payment", "receipt_path": "x"})
    kinds = "event_id long, ts timestamp_ntz, type string, intent_id string, request_id long"
    e = spark.createDataFrame([(1, T(2024, 1, 1), Y.FAILED, "pi_a", 1), (2, T(2024, 1, 2), Y.SUCCEEDED, "pi_a", 1), (3, T(2024, 1, 3), Y.FAILED, "pi_a", 1), (4, T(2024, 1, 3), Y.SUCCEEDED, "pi_b", 99), (5, T(2024, 1, 4), "other", "pi_a", 1)], kinds)
    assert [tuple(x) for x in Y.transactions_latest(e, r).collect()] == [("pi_a", "failed", True)]
    assert [tuple(x) for x in Y.paid_requests(e, r).collect()] == [(1, "paid", T(2024, 1, 2), None)]


def test_last_failure_stays(spark):
    r = requests(spark, {"id": 1, "status": "pending_payment"})
    kinds = "event_id long, ts timestamp_ntz, type string, intent_id string, request_id long, failure_code string, failure_message string"
    e = spark.createDataFrame([(1, T(2024, 1, 1), Y.FAILED, "pi_a", 1, "early", "m"), (2, T(2024, 1, 2), Y.SUCCEEDED, "pi_a", 1, None, None), (3, T(2024, 1, 3), Y.FAILED, "pi_a", 1, "declined", None), (4, T(2024, 1, 4), Y.CANCELED, "pi_a", 1, None, None)], kinds)
    assert [tuple(x) for x in Y.transactions_latest(e, r).collect()] == [("pi_a", "canceled", True, "declined", None)]


def test_constraints_of_documents_and_people(spark):
    docs = spark.createDataFrame([(1, "t" * 501, "en", "LAW", None, "f"), (1, None, "en", "LAW", "g", "f")], "id long, title string, language string, type string, group string, source_file string")
    arts = spark.createDataFrame([("a", 1, "n", "x", 0, None, None, None), ("b", 2, "n", None, 1, None, None, "c" * 501)], "id string, document_id long, article_number string, text string, sort_key int, path string, slug string, chapter string")
    broken = {x.rule: x.violations for x in M.corpus_constraints(docs, arts).collect() if x.violations}
    assert broken == {"documents.title length": 1, "documents.title null": 1, "documents.id unique": 1, "articles.text null": 1, "articles.chapter length": 1, "articles.document_id": 1}
    r = requests(spark, {"id": 1, "status": "paid"})
    users = spark.createDataFrame([(1, "A", "a@b.c", "user"), (2, "B", "a@b.c", None)], "id long, name string, email string, role string")
    notes = spark.createDataFrame([(1, 1, None, "x"), (2, 7, 9, "y")], "id long, request_id long, user_id long, note string")
    paid = spark.createDataFrame([(1, 1, "processing", "pi"), (2, 3, "s" * 31, "pi")], "id long, request_id long, status string, intent_id string")
    broken = {x.rule: x.violations for x in M.people_constraints(users, notes, r, paid).collect() if x.violations}
    assert broken == {"users.role null": 1, "users.email unique": 1, "transactions.status length": 1, "transactions.intent_id unique": 1, "notes.request_id": 1, "notes.user_id": 1, "transactions.request_id": 1}


def test_reconcile(spark):
    r = requests(spark, {"id": 1, "status": "pending_payment"})
    kinds = "event_id long, intent_id string, request_id long, ticket_number string, asked_ticket string, amount_cents long, currency string, status string"
    i = spark.createDataFrame([(1, "pi_a", 1, "T1", "T1", 45000, "MAD", "succeeded"), (2, "pi_b", 1, "T1", "T1", 10000, "mad", "succeeded"), (3, "x", 1, "T1", "T1", 45000, "mad", "requires_action"), (4, "pi_d", 1, "T1", "??", 45000, "mad", "succeeded"), (5, "pi_e", 1, None, "T1", 45000, "mad", "succeeded")], kinds)
    assert sorted(tuple(x) for x in Y.reconcile_payments(i, r).collect()) == [(1, True, 200), (2, True, 422), (3, False, 409), (4, True, 404), (5, True, 422)]


def test_maintenance(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, n string, p int")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "id long, n string")
    assert sorted(tuple(x) for x in M.snapshot_sync(t, s, "id").collect()) == [(1, None, None, "delete"), (2, "B", 6, "update"), (3, "C", None, "insert")]
    r = requests(spark, {"id": 1, "status": "paid", "advisor_id": 4}, {"id": 2, "status": "paid", "advisor_id": 5})
    gone = spark.createDataFrame([(4,)], "id long")
    assert sorted((x.id, x.advisor_id) for x in M.null_on_delete(r, "advisor_id", gone).collect()) == [(1, None), (2, 5)]
    actions = spark.createDataFrame([(1, 1, T(2024, 1, 1), "toggle", 7, 3), (1, 2, T(2024, 1, 2), "toggle", 7, 3), (1, 3, T(2024, 1, 3), "toggle", 8, 3), (1, 4, T(2024, 1, 4), "claim", 7, 9), (1, 5, T(2024, 1, 5), "claim", 7, 3), (1, 6, T(2024, 1, 6), "close", 7, 3)], "case_id long, seq long, at timestamp_ntz, action string, service_id long, user_id long")
    state = M.case_state_fold(actions).first()
    assert (state.advisor_id, state.first_contact_at, state.case_status, state.closed_at, state.completed) == (9, T(2024, 1, 4), "closed", T(2024, 1, 6), 1)


def test_users_latest_gives_every_user(spark):
    users = spark.range(120).selectExpr("id", "concat('u', id) AS name", "'user' AS role")
    assert [r.id for r in C.users_latest(users).collect()] == list(range(119, -1, -1))
    assert [r.id for r in C.users_latest(users, most=2).collect()] == [119, 118]


def test_fanout_is_dealt_over_tasks(spark):
    """Cases that lie in one partition give their rows in many tasks, and the same rows."""
    from quillwork.operators import cases

    requests = spark.createDataFrame([(f"T{k}", "paid", None) for k in range(60)], "ticket_number string, status string, base_price decimal(10,2)").coalesce(1)
    users = spark.createDataFrame([(f"a{k}", "advisor") for k in range(10)], "email string, role string")
    found = cases.notification_fanout(requests, users, pairs=100)
    assert len({r.p for r in found.selectExpr("spark_partition_id() AS p").collect()}) > 1
    assert sorted((r.ticket_number, r.email) for r in found.collect()) == sorted((f"T{k}", f"a{e}") for k in range(60) for e in range(10))


def test_fanout_copies_no_cases(spark):
    """With more addresses than a block holds a case is still written to the shuffle once, no side is broadcast, and a task holds a block of each."""
    r = requests(spark, *[{"id": n, "status": "paid"} for n in range(40)])
    many = spark.range(23).select("id", F.lit("advisor").alias("role"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("email"))
    found = C.notification_fanout(r, many, most=5, pairs=50)
    assert sorted((x.ticket_number, x.email) for x in found.collect()) == sorted((f"T{n}", f"a{k}") for n in range(40) for k in range(23))
    tasks = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("email").alias("emails"))
    assert tasks.agg(F.max("n"), F.max("emails")).first()[1] < 2 * 5 and tasks.count() > 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Broadcast" not in plan


def test_pairs_are_dealt_over_tasks_by_rows(spark):
    """A large table's pairs lie in tasks of a bounded number of rows, each request in one, and are the same pairs."""
    from quillwork.sources import bindings

    folder = "/root/testdata/sf0.01"
    whole, dealt = bindings.request_services(spark, folder, rows=10**9), bindings.request_services(spark, folder, rows=5000)
    assert dealt.exceptAll(whole).count() == whole.exceptAll(dealt).count() == 0
    tasks = dealt.withColumn("task", F.spark_partition_id())
    assert tasks.groupBy("task").count().agg(F.max("count")).first()[0] < 2 * 5000
    assert tasks.groupBy("request_id").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0


def test_report_on_dealt_pairs(spark, tmp_path):
    """Pairs dealt by request reach the report without being dealt anew by pair, and lost references count as in SQL."""
    import os

    from oracle import TABLES, compare, connect

    from quillwork.plans import payments
    from quillwork.sources import bindings as B

    folder = str(tmp_path)
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")
    lines = B.read(spark, "/root/testdata/sf0.001", "lineitem")
    broken = lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey") * 2)).withColumn("l_partkey", F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") + 50))
    broken.unionByName(broken.limit(100)).write.parquet(f"{folder}/lineitem.parquet")
    report = lambda s, d: M.constraint_report(B.requests(s, d), B.request_services(s, d, rows=500), B.services(s, d), B.users(s, d).where("role = 'advisor'"))
    compare(spark, connect(folder), report, payments.SQL["constraint_report"], folder)
    found = report(spark, folder)
    assert {x.rule for x in found.where("violations > 0").collect()} >= {"request_services.request_id", "request_services.service_id"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(request_id" in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)


def test_keys_are_dealt_over_tasks_by_rows(spark):
    """Keys of a large table are grouped in tasks of a bounded number of rows and not where they are read; one that fills half the table is dealt too."""
    ids = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("id"))
    dealt = M.key_counts(ids, "id", rows=500)
    assert {(x.id, x.n) for x in dealt.collect()} == {(0, 10000)} | {(k, 1) for k in range(1, 20000, 2)}
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2 * 500
    assert M.unique_violations(ids, "r", "id", rows=500).collect() == M.unique_violations(ids, "r", "id", rows=None).collect() == [("r", 9999)]
    lowest = M.unique_violations(ids, "r", "id", rows=500)._jdf.queryExecution().executedPlan().toString().splitlines()
    first = max(k for k, x in enumerate(lowest) if "Exchange hashpartitioning(" in x)
    assert "reader" in lowest[first] and ", 40)" in lowest[first]
    assert not any("Aggregate" in x for x in lowest[first:])


def test_report_on_dealt_keys(spark, tmp_path, monkeypatch):
    """Requests that are listed again count as in SQL where their keys are dealt over tasks."""
    import os

    from oracle import TABLES, compare, connect

    from quillwork.plans import payments
    from quillwork.sources import bindings as B

    folder = str(tmp_path)
    for t in TABLES:
        if t != "orders":
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")
    orders = B.read(spark, "/root/testdata/sf0.001", "orders")
    orders.unionByName(orders.where("o_orderkey % 3 = 0")).unionByName(orders.where("o_orderkey = 7")).write.parquet(f"{folder}/orders.parquet")
    counts = M.key_counts
    monkeypatch.setattr(M, "key_counts", lambda t, *keys, rows: counts(t, *keys, rows=rows and 100))
    compare(spark, connect(folder), payments.QUERIES["constraint_report"], payments.SQL["constraint_report"], folder)
    found = {x.rule: x.violations for x in payments.QUERIES["constraint_report"](spark, folder).collect()}
    assert found["requests.id unique"] == found["requests.ticket_number unique"] == 501
