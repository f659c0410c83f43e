"""Request limits and quota ledgers, exact in time order with a small state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailgrid import constants as K

DECISIONS = "key string, event_id bigint, ts timestamp, accepted boolean, retry_after int"


def _referee(limits: tuple):
    """(start, judge): queues per limit from earlier accepts, and the decision on the next time.

    A limit of n per period needs only the n latest accepts, oldest first: there is room if there
    are fewer, or if the oldest has left the period. Rejected times leave no trace. Both are
    defined inside so that workers get them by value.
    """
    from collections import deque

    def start(accepted=()):
        return [deque(accepted, maxlen=most) for most, _ in limits]

    def judge(queues, now: float) -> tuple[bool, int]:
        for queue, (most, period) in zip(queues, limits):
            if len(queue) == most and now - queue[0] < period:
                return False, int(period - (now - queue[0])) + 1
        for queue in queues:
            queue.append(now)
        return True, 0

    return start, judge


def limit_requests(log: DataFrame, limits=K.PLAN_LIMITS) -> DataFrame:
    """Each request of a batch log with its decision; rejected attempts are not counted.

    Where a key rests for the longest period nothing before matters, so its rows are cut into
    parts there, and parts are judged apart. Within one, rows come in time order, and a task holds
    only as many accepted times as the largest limit allows.
    """
    start, decide = _referee(tuple(limits))
    rows = log.select(
        F.col("ip").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"),
    )
    longest = max(period for _, period in limits)
    in_order = Window.partitionBy("key").orderBy("at", "event_id")
    rested = F.coalesce(F.col("at") - F.lag("at").over(in_order) >= longest, F.lit(True))
    parts = rows.withColumn("part", F.sum(rested.cast("long")).over(in_order))
    ordered = parts.repartition("key", "part").sortWithinPartitions("key", "part", "at", "event_id")

    def judge(batches):
        current, queues = None, start()
        for batch in batches:
            accepted, waits = [], []
            for key, part, at in zip(batch["key"], batch["part"], batch["at"]):
                if (key, part) != current:
                    current, queues = (key, part), start()
                good, wait = decide(queues, at)
                accepted.append(good)
                waits.append(wait)
            yield batch[["key", "event_id", "ts"]].assign(accepted=accepted, retry_after=waits)

    return ordered.mapInPandas(judge, DECISIONS)


def limit_stream(log: DataFrame, limits=K.PLAN_LIMITS, delay: str = "10 minutes") -> DataFrame:
    """The same decisions on a stream whose rows arrive in any order within ``delay``.

    A row waits in its key's state until the watermark has passed it; then it is judged after all
    earlier ones, whatever batch or chunk they came in, so the decisions are those of
    ``limit_requests``. Rows later than the watermark are dropped. A key's state is its waiting
    rows and its latest accepts, and goes when the longest period has passed.
    """
    start, decide = _referee(tuple(limits))
    most, longest_ms = max(n for n, _ in limits), max(period for _, period in limits) * 1_000
    rows = log.select(
        F.col("ip").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts")
    ).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted, times, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for batch in batches:
                times += batch["at"].tolist()
                ids += batch["event_id"].tolist()
        passed = state.getCurrentWatermarkMs()
        rows = sorted(zip(times, ids))
        ready = [row for row in rows if row[0] < passed * 1_000]
        waiting = rows[len(ready):]
        queues = start(accepted)
        said = [decide(queues, at / 1e6) for at, _ in ready]
        accepted = list(max(queues, key=lambda q: q.maxlen))
        wake = waiting[0][0] // 1_000 + 1 if waiting else int(accepted[-1] * 1_000) + longest_ms if accepted else 0
        if waiting or wake > passed:
            state.update((accepted[-most:], [at for at, _ in waiting], [n for _, n in waiting]))
            state.setTimeoutTimestamp(max(wake, passed + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({
            "key": [key[0]] * len(ready), "event_id": [n for _, n in ready],
            "ts": pd.to_datetime([at for at, _ in ready], unit="us"),
            "accepted": [good for good, _ in said], "retry_after": [wait for _, wait in said],
        })

    return rows.groupBy("key").applyInPandasWithState(
        judge, DECISIONS, "accepted array<double>, times array<bigint>, ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def trailing_count(rows: DataFrame, key: str, seconds: int, name: str) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to each row; ``_at`` holds microseconds.

    A row counts one from its time on, and one less when the window has left it, so a running sum over
    both is the count, in steps that don't grow with the window. Time is cut into slots as long as
    the window, and a slot starts from the rows that leave it, so a busy key is one task per slot.
    """
    width = seconds * 1_000_000
    here, gone = F.struct(F.col("_at").alias("at"), F.lit(1).alias("step")), F.struct((F.col("_at") + width).alias("at"), F.lit(-1).alias("step"))
    steps = rows.withColumn("_e", F.explode(F.array(here, gone))).withColumn("_slot", F.col("_e.at") - F.pmod("_e.at", F.lit(width)))
    slot = Window.partitionBy(key, "_slot")
    upto = slot.orderBy("_e.at").rangeBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn(name, F.sum("_e.step").over(upto) + F.count_if(F.col("_e.step") < 0).over(slot))
    return counted.where(F.col("_e.step") > 0).drop("_e", "_slot")


def attempts_in_window(log: DataFrame, limits=K.PLAN_LIMITS) -> DataFrame:
    """Attempts of the key in each trailing window: where all fit, the request was surely accepted."""
    out = log.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    sure = F.lit(True)
    for allowed, seconds in limits:
        out = trailing_count(out, "ip", seconds, f"last_{seconds}")
        sure = sure & (F.col(f"last_{seconds}") <= allowed)
    return out.withColumn("surely_accepted", sure).drop("_at")


def quota_ledger(calls: DataFrame, budget: int, seconds: int = K.QUOTA_SECONDS) -> DataFrame:
    """Calls left per endpoint after each call: own 24 h budget against the last server reading.

    ``server_remaining`` is null when a call carried no reading; before the first reading the
    remaining quota is unknown. Every call after a reading lowers it by one. There are few
    endpoints, so calls are numbered inside a day and days are chained through one small row
    per endpoint and day.
    """
    timed = calls.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    counted = trailing_count(timed, "endpoint", seconds, "_used").withColumns({
        "own_remaining": F.greatest(F.lit(budget) - F.col("_used"), F.lit(0)),
        "_day": F.floor(F.col("_at") / (K.QUOTA_SECONDS * 1_000_000)),
    })
    in_day = Window.partitionBy("endpoint", "_day").orderBy("_at", "event_id")
    upto = in_day.rowsBetween(Window.unboundedPreceding, 0)
    read = F.col("server_remaining").isNotNull()
    numbered = counted.withColumn("_n", F.row_number().over(in_day)).withColumn(
        "_here", F.last(F.when(read, F.struct("server_remaining", "_n")), ignorenulls=True).over(upto)
    )
    place = F.struct("_at", "event_id")
    days = counted.groupBy("endpoint", "_day").agg(
        F.count(F.lit(1)).alias("_calls"),
        F.max_by("server_remaining", F.when(read, place)).alias("_reading"),
        F.max(F.when(read, place)).alias("_read_at"),
    )
    after = (
        counted.join(days.select("endpoint", "_day", "_read_at"), ["endpoint", "_day"])
        .where(place > F.col("_read_at")).groupBy("endpoint", "_day").agg(F.count(F.lit(1)).alias("_since"))
    )
    before = Window.partitionBy("endpoint").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    chained = days.join(after, ["endpoint", "_day"], "left").withColumn(
        "_offset", F.coalesce(F.sum("_calls").over(before), F.lit(0))
    ).withColumn(
        "_mark", F.when(
            F.col("_reading").isNotNull(),
            F.struct(F.col("_reading"), (F.col("_offset") + F.col("_calls") - F.coalesce("_since", F.lit(0))).alias("at")),
        )
    ).withColumn("_earlier", F.last("_mark", ignorenulls=True).over(before))
    known = numbered.join(chained.select("endpoint", "_day", "_offset", "_earlier"), ["endpoint", "_day"])
    today = F.col("_here.server_remaining") - (F.col("_n") - F.col("_here._n"))
    earlier = F.col("_earlier._reading") - (F.col("_offset") + F.col("_n") - F.col("_earlier.at"))
    server = F.greatest(F.when(F.col("_here").isNotNull(), today).otherwise(earlier), F.lit(0))
    unknown = F.col("_here").isNull() & F.col("_earlier").isNull()
    return known.withColumn("remaining", F.when(~unknown, F.least("own_remaining", server))).select(
        *calls.columns, "own_remaining", "remaining"
    )
