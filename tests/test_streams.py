import datetime as dt

from pyspark.sql import functions as F

from quillwork.streaming import jobs

T = dt.datetime


def test_broken_webhook_lines(spark):
    rows = spark.createDataFrame([("{",), ('{"id": "e", "type": "x", "data": {"object": {"id": "pi_1", "amount": 5, "metadata": {"legal_aid_request_id": "7"}}}}',)], "value string")
    got = {r.type: (r.intent_id, r.request_id, r.amount_cents) for r in jobs.webhook_source(rows).collect()}
    assert got == {None: (None, None, None), "x": ("pi_1", 7, 5)}


def test_sync_replaces_by_id(spark, tmp_path):
    kinds = "id string, document_id long, article_number string, text string, sort_key int, chapter string, path string, footnotes string, synced boolean"
    docs = spark.createDataFrame([(1, "Code", "fr", "LAW", None, "f")], "id long, title string, language string, type string, group string, source_file string")

    def put(*rows):
        spark.createDataFrame([(i, d, "n", text, 0, None, None, None, done) for i, d, text, done in rows], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        jobs.sync_articles(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), docs, f"{tmp_path}/index", f"{tmp_path}/state")

    put(("a", 1, "one", None), ("b", 2, "two", None), ("c", 1, "done", True))
    run()
    put(("a", 1, "new", None), ("d", 1, "four", None))
    run()
    got = {r.id: (r.text, r.document_title) for r in spark.read.parquet(f"{tmp_path}/index/version=1").collect()}
    assert got == {"a": ("new", "Code"), "b": ("two", None), "d": ("four", "Code")}


def run_batches(spark, tmp_path, rows, kinds, fold):
    """What a fold gives after each of the lists of rows, every list in a run of its own: state goes on from run to run."""
    for some in rows:
        spark.createDataFrame(some, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_now(fold(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", "update", f"{tmp_path}/state")
    return spark.read.parquet(*[f"{tmp_path}/out/n={n}" for n in range(len(rows))])


def test_payment_fold_over_batches(spark, tmp_path):
    kinds = "event_id long, ts timestamp_ntz, type string, intent_id string, request_id long, failure_code string, failure_message string"
    won, failed, gone = "payment_intent.succeeded", "payment_intent.payment_failed", "payment_intent.canceled"
    day = lambda n: T(2024, 1, n)
    first = [(1, day(1), won, "a", 7, None, None), (2, day(2), failed, "b", 8, "early", "no intent yet")]
    second = [(4, day(4), gone, "a", 7, None, None), (3, day(3), failed, "a", 7, "card_declined", "no"), (5, day(5), won, "b", 99, None, None)]
    third = [(6, day(6), won, "b", 8, None, None)]
    requests = spark.createDataFrame([(7,), (8,)], "id long")
    saved = run_batches(spark, tmp_path, [first, second, third], kinds, lambda s: jobs.webhook_fold(s, requests))
    got = {(r.batch, r.intent_id): (r.status, r.ever_succeeded, r.failure_code, r.failure_message) for r in saved.collect()}
    assert got == {
        (0, "a"): ("succeeded", True, None, None),
        (1, "a"): ("canceled", True, "card_declined", "no"),
        (2, "b"): ("succeeded", True, None, None),
    }


def test_case_fold_over_batches(spark, tmp_path):
    kinds = "case_id long, seq long, at timestamp_ntz, action string, service_id long, user_id long"
    day = lambda n: T(2024, 1, n)
    first = [(1, 1, day(1), "toggle", 5, 9), (1, 2, day(2), "claim", None, 9)]
    second = [(1, 4, day(4), "close", None, 9), (1, 3, day(3), "toggle", 6, 9), (2, 5, day(5), "note", None, 3)]
    third = [(1, 6, day(6), "toggle", 5, 9), (1, 7, day(7), "claim", None, 4), (1, 8, day(8), "reopen", None, 4)]
    saved = run_batches(spark, tmp_path, [first, second, third], kinds, jobs.case_state_stream)
    last = saved.groupBy("case_id").agg(F.max_by(F.struct(*saved.columns), "batch").alias("s")).select("s.*")
    got = {r.case_id: (r.batch, r.advisor_id, r.first_contact_at, r.case_status, r.closed_at, r.last_touched_at, r.completed) for r in last.collect()}
    assert got == {1: (2, 9, day(2), "open", None, day(8), 1), 2: (1, None, None, "open", None, day(5), 0)}
