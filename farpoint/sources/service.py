"""Asking a service: one rate for all tasks, retries that count, and answers that are kept."""

from __future__ import annotations

import hashlib
import heapq
import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.sources.files import exists

#: Tries of a request, and the seconds before the second one, which double.
TRIES, FIRST_WAIT = 4, 0.6
#: Requests of one job: what a lost task costs at most. Its answers are kept when it ends.
EACH = 2_000
#: Seconds, about, for which tasks agree on who may ask when.
ROUND = 4.0
KEPT = "key string, body binary"

#: Gives the answer's bytes for a request's parameters, or raises.
Transport = Callable[[dict], bytes]


def request_key(params: dict) -> str:
    """The name under which an answer is kept: the SHA-1 of the parameters, sorted, as a query string."""
    return hashlib.sha1(urlencode(sorted(params.items())).encode()).hexdigest()


def key_of(params: Column) -> Column:
    """``request_key`` of parameters in JSON, as a column; null for null."""
    # what the two encoders write differently
    quoted = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.array_sort(F.map_entries(F.from_json(params, "map<string,string>")))
    return F.sha1(F.array_join(F.transform(pairs, lambda e: F.concat(quoted(e["key"]), F.lit("="), quoted(e["value"]))), "&"))


class Queue:
    """Requests that wait for an attempt, each with the time from which it may be made."""

    def __init__(self, requests: list[tuple[str, dict]], transport: Transport):
        self.waiting = [(0.0, i, key, params, 1) for i, (key, params) in enumerate(requests)]
        self.transport = transport

    def attempt(self, now: float) -> tuple[str, bytes] | None:
        """Makes one attempt, if any may be made now; the answer if it is one. What failed TRIES times is left out."""
        if not self.waiting or self.waiting[0][0] > now:
            return None
        _, i, key, params, tries = heapq.heappop(self.waiting)
        try:
            return key, self.transport(params)
        except Exception:
            if tries < TRIES:
                heapq.heappush(self.waiting, (now + FIRST_WAIT * 2 ** (tries - 1), i, key, params, tries + 1))
            return None


def shared_slots(waiting: list[int], total: int, first: int) -> list[int]:
    """Who has which of ``total`` slots: tasks with attempts left take turns from ``first`` on, each as many as it has."""
    out, left, who = [], list(waiting), first
    while len(out) < total and any(left):
        if left[who % len(left)]:
            left[who % len(left)] -= 1
            out.append(who % len(left))
        who += 1
    return out


def paced(queue: Queue, me: int, gather: Callable[[str], list[str]], per_second: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, bytes]]:
    """Answers of the queue while all tasks together make ``per_second`` attempts at most.

    Round by round the tasks tell each other how many attempts they have left, deal the next slots out by the same
    rule, and keep to theirs; the next round begins when the slots of this one are over. So the rate is the whole job's
    whatever the number of tasks, also when all but one are done, and retries take slots like first attempts.
    """
    turn = 0
    while True:
        waiting = [int(x) for x in gather(str(len(queue.waiting)))]
        if not any(waiting):
            return
        slots = shared_slots(waiting, max(len(waiting), round(per_second * ROUND)), turn)
        began, turn = now(), turn + len(slots)
        for k in (k for k, who in enumerate(slots) if who == me):
            sleep(max(0.0, began + k / per_second - now()))
            if (got := queue.attempt(now())) is not None:
                yield got
        sleep(max(0.0, began + len(slots) / per_second - now()))


def tried(queue: Queue) -> Iterator[tuple[str, bytes]]:
    """Answers of the queue, as fast as they come."""
    while queue.waiting:
        time.sleep(max(0.0, queue.waiting[0][0] - time.monotonic()))
        if (got := queue.attempt(time.monotonic())) is not None:
            yield got


def kept(spark, store: str) -> DataFrame:
    """(key, body) of the answers at ``store``."""
    return spark.read.schema(KEPT).parquet(store) if exists(spark, f"{store}/*.parquet") else spark.createDataFrame([], KEPT)


def fetched(requests: DataFrame, transport: Transport, store: str, per_second: float = 2.0, partitions: int = 8, each: int = EACH) -> DataFrame:
    """``requests`` (with params, JSON) and body: what the service answers, null where all tries failed or params is null.

    Answers are kept in the table at ``store`` under the request's key; what is there is not asked for again, in this
    run or a later one. Equal requests are made once. Failed ones are not kept: the next run asks again. Requests are
    made by jobs of about ``each``, so a lost executor costs one job's answers.

    per_second: attempts of the whole job, retries included; 0 or less is no limit. With a limit, the ``partitions``
    tasks of a job run as one barrier stage (the cluster must have so many slots) and share slots (``paced``).
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("__key", key_of(F.col("params")))
    asked = keyed.where(F.col("__key").isNotNull()).select(F.col("__key").alias("key"), "params").dropDuplicates(["key"])
    lacking = asked.join(kept(spark, store).select("key"), "key", "left_anti")
    jobs = max(1, -(-lacking.count() // each))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        todo = [(k, json.loads(p)) for f in frames for k, p in zip(f["key"], f["params"], strict=True)]
        queue = Queue(todo, transport)
        if per_second > 0:
            task = BarrierTaskContext.get()
            answers = paced(queue, task.partitionId(), task.allGather, per_second)
        else:
            answers = tried(queue)
        for got in answers:
            yield pd.DataFrame([got], columns=["key", "body"])

    for job in range(jobs):
        # what an earlier job of this run has kept is not asked for again if this one starts anew
        part = lacking.where(F.pmod(F.xxhash64("key"), F.lit(jobs)) == job).repartition(partitions)
        part.mapInPandas(run, KEPT, barrier=per_second > 0).write.mode("append").parquet(store)
    # of what was asked for alone; a task that ran twice may have kept an answer twice
    have = kept(spark, store).join(asked.select("key"), "key", "left_semi").groupBy("key").agg(F.first("body").alias("body"))
    return keyed.join(have, F.col("__key") == F.col("key"), "left").drop("__key", "key")
