"""Who is told of a case, once, when it becomes ready.

A run looks at the requests as they are, takes the ready ones that no run has
announced, and puts them into a log (a BucketedTable by request id). Beside each
run lie its recipients, packed: an announcement is its cases and one list of
packets, not a row a pair. Messages are expanded a part of a run at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.operators.cases import ready_cases
from quillwork.streaming.index import BucketedTable

CASES = "id long, ticket_number string"
#: Addresses a packet, on average.
PACKET = 500
#: Cases that meet one copy of a packet.
CASES_A_COPY = 5_000


def packets(users: DataFrame, size: int = PACKET) -> DataFrame:
    """packet, emails: the different addresses of advisors, dealt by hash into packets of about `size`."""
    emails = users.where("role = 'advisor' AND email IS NOT NULL").select("email").distinct()
    n = max(1, -(-emails.count() // size))
    return emails.groupBy(F.pmod(F.xxhash64("email"), F.lit(n)).alias("packet")).agg(F.array_sort(F.collect_list("email")).alias("emails"))


def newly_ready(requests: DataFrame, log: BucketedTable) -> DataFrame:
    """id, ticket_number of the ready cases that the log doesn't hold."""
    return ready_cases(requests).select("id", "ticket_number").join(log.live().select("id"), "id", "left_anti")


def announce(requests: DataFrame, users: DataFrame, log: BucketedTable, job: str, run: int, now: dt.datetime, size: int = PACKET) -> dict:
    """One run: announces what became ready since the runs before; gives the log's report.

    Without advisors nothing is announced, and the cases wait for a run that has
    some. A run that is repeated announces nothing more; a case that is ready
    again after it was not is not announced again.
    """
    whole = packets(users, size)
    if whole.isEmpty():
        return {"version": None, "job": job, "batch": run, "pushed": 0, "buckets": 0, "compacted": 0, "synced_at": now}
    version = max(log.versions(), default=-1) + 1
    whole.write.mode("overwrite").parquet(f"{log.root}/recipients/version={version}")  # of this run, or of the next if this one was done before
    return log.merge(newly_ready(requests, log), job, run, now)


def announced(log: BucketedTable) -> DataFrame:
    """id, ticket_number, version, synced_at: every announced case and its run."""
    return log.live()


def recipients(log: BucketedTable, version: int) -> DataFrame:
    return log.spark.read.schema("packet long, emails array<string>").parquet(f"{log.root}/recipients/version={version}")


def messages(log: BucketedTable, version: int, part: int = 0, parts: int = 1) -> DataFrame:
    """ticket_number, packet, emails, addresses: part `part` of `parts` of a run's messages, one a case and packet, with its number of emails.

    A case meets every packet through a key of the packets' numbers, so neither
    side is broadcast or gathered; packets are few, so each has a copy for about
    every CASES_A_COPY cases.
    """
    cases = announced(log).where((F.col("version") == version) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).select("id", "ticket_number")
    copies = max(1, -(-cases.count() // CASES_A_COPY))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    whole = recipients(log, version).withColumn("addresses", F.size("emails")).withColumn("copy", numbers(copies - 1))
    n = recipients(log, version).agg(F.max("packet")).first()[0]
    asked = cases.select("ticket_number", F.pmod(F.xxhash64("id", F.lit(copies)), F.lit(copies)).alias("copy"), numbers(n).alias("packet"))
    return asked.join(whole, ["packet", "copy"]).select("ticket_number", "packet", "emails", "addresses")
