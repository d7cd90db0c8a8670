"""Conversation turns put back in order by a stateful stream.

Turns arrive in numbered batches: late, repeated, out of order. ``transformWithState`` holds what is
known of a conversation under the key (conv_id, part); a part is a range of ``PART`` turn numbers, so
a conversation of any length is spread over as many keys, and none holds more than its own range.
The event time is the batch number: every batch brings one tick, so that an empty batch moves the
watermark as well. An arrival deletes the key's timer and registers it anew at its batch plus the
idle time; when it expires the key closes, and a tombstone rejects what comes later.

What parts of one conversation have to know of each other is little. Each batch tells all parts of a
long conversation that it had an arrival (``touch`` rows), so that they close together. A later part's
turns are released once the parts before it are full; ``assembled`` puts that together from one row
a part. Conversations of a single part, as nearly all are, need neither.
"""

from __future__ import annotations

import contextlib
import hashlib
import sys
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.window import Window

from .common import bounded_batches, discard, materialize, project, work_path, writing

#: Turn numbers of a part, as a power of two: what one state key may hold.
PART_BITS = 12
#: Successive batches without an arrival that close a conversation.
IDLE = 3
#: Bytes of payloads a key's arrivals keep in memory before they go to its state.
HELD_BYTES = 4 << 20

INPUT = "kind string, conv_id long, part long, more boolean, first long, turn long, role string, payload string, batch int, at timestamp"
OUTPUT = "event string, conv_id long, part long, more boolean, first long, turn long, batch int, payload string, run long, n_kept long, largest long, n_breaks long, head_role string, tail_role string"
_OUT = tuple(c.split()[0] for c in OUTPUT.split(", "))
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # each batch is a start of its own; stores left open for the next one would keep their local folders
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _due(batch: int) -> int:
    """The timer of a closing in ``batch``: after the time of the batch before, before its own."""
    return 1000 * batch + 500


class Reassembly(StatefulProcessor):
    """State of one part of a conversation: kept turns and roles, payloads not released yet, the tombstone."""

    def __init__(self, idle: int = IDLE):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "last int, run long, more boolean, first long, turns array<long>, roles array<string>")
        self.waiting = handle.getMapState("waiting", "turn long", "payload string")
        self.closed = handle.getValueState("closed", "batch int")

    def _row(self, key, event: str, **values) -> Row:
        return Row(**{f: values.get(f) for f in _OUT} | {"event": event, "conv_id": key[0], "part": key[1]})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if key[1] < 0:  # the tick has moved the watermark
            for _ in rows:
                pass
            return
        known = self.open.get()
        if known is None and self.closed.exists():
            for r in rows:
                if r.kind == "turn":
                    yield self._row(key, "reject", turn=r.turn, batch=r.batch, payload=r.payload, first=r.first, more=r.more)
            return
        last, run, more, first, turns, roles = known or (None, None, None, None, (), ())
        if known is not None:
            # arrivals come before timers: one that is due and has not been called yet closes here
            rows = iter(rows)
            head = next(rows)
            rows = chain([head], rows)
            if head.batch > last + self.idle:
                yield self._closed(key, known)
                self.handle.deleteTimer(_due(last + self.idle))
                yield from (self._row(key, "reject", turn=r.turn, batch=r.batch, payload=r.payload, first=r.first, more=r.more) for r in rows if r.kind == "turn")
                return
        have, fresh, held, batch, before = dict(zip(turns, roles, strict=True)), {}, 0, last, len(turns)
        for r in rows:
            batch, more, first = r.batch, r.more, r.first
            if r.kind != "turn" or (r.turn in have and r.turn not in fresh):
                continue
            if r.turn not in fresh or r.payload.encode() < fresh[r.turn].encode():
                have[r.turn], fresh[r.turn] = r.role, r.payload
                held += len(r.payload)
            if held > HELD_BYTES:  # a turn arrives once in a batch; what is written here is final
                for t, payload in fresh.items():
                    self.waiting.updateValue((t,), (payload,))
                fresh, held = {}, 0
        if run is None:
            run = first if key[1] == 0 else ((first >> PART_BITS) + key[1]) << PART_BITS
        while run in have:
            payload = fresh.pop(run, None)
            if payload is None:
                payload = self.waiting.getValue((run,))[0]
                self.waiting.removeKey((run,))
            yield self._row(key, "release", turn=run, batch=batch, payload=payload, first=first, more=more)
            run += 1
        for t, payload in fresh.items():
            self.waiting.updateValue((t,), (payload,))
        if last != batch:
            if last is not None:
                self.handle.deleteTimer(_due(last + self.idle))
            self.handle.registerTimer(_due(batch + self.idle))
        if last != batch or len(have) > before:
            self.open.update((batch, run, more, first, list(have), list(have.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield self._closed(key, self.open.get())

    def _closed(self, key, known) -> Row:
        """The closing of a part; from now on there is its tombstone only."""
        last, run, more, first, turns, roles = known
        have = dict(zip(turns, roles, strict=True))
        base = ((first >> PART_BITS) + key[1]) << PART_BITS
        breaks = sum(t - 1 in have and have[t - 1] == role for t, role in have.items())
        left = ",".join(str(t) for t in sorted(have) if t >= run)
        self.closed.update((last + self.idle,))
        self.open.clear()
        self.waiting.clear()
        return self._row(
            key, "close", turn=-1, batch=last + self.idle, payload=left, first=first, more=more, run=run, n_kept=len(have),
            largest=max(have, default=None), n_breaks=breaks, head_role=have.get(base), tail_role=have.get(base + (1 << PART_BITS) - 1),
        )

    def close(self) -> None:
        pass


def _part(turn: Column) -> Column:
    return F.shiftright(turn, PART_BITS)


def prepared(arrivals: DataFrame) -> DataFrame:
    """Arrivals (conv_id, turn, role, payload, batch) as the stream's rows: of a turn's arrivals in a batch the smallest payload, ``first``, the part, touches.

    Sums by key before each shuffle; the joins by conversation are ones that adaptive execution splits where a
    conversation is hot. A conversation of many parts gets one touch a part and batch.
    """
    once = project(arrivals, conv_id="long", turn="long", role="string", payload="string", batch="int").where("turn is not null")
    once = once.groupBy("conv_id", "turn", "batch").agg(F.min(F.struct("payload", "role")).alias("a")).select("conv_id", "turn", "batch", "a.role", "a.payload")
    ends = once.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("_last")).withColumnRenamed("conv_id", "_c")
    rows = once.join(ends, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("more", _part(F.col("first")) != _part(F.col("_last")))
    turns = rows.select(F.lit("turn").alias("kind"), "conv_id", (_part(F.col("turn")) - _part(F.col("first"))).alias("part"), "more", "first", "turn", "role", "payload", "batch")
    return turns


def touches(turns: DataFrame) -> DataFrame:
    """For conversations of several parts: a row for each part and each batch in which the conversation had an arrival."""
    long = turns.where("more")
    parts = long.select("conv_id", "part", "first").distinct()
    when = long.select(F.col("conv_id").alias("_c"), "batch").distinct()
    both = parts.join(when, F.col("conv_id").eqNullSafe(F.col("_c")))
    none = F.lit(None)
    return both.select(F.lit("touch").alias("kind"), "conv_id", "part", F.lit(True).alias("more"), "first", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("payload"), "batch")


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.timestamp_seconds(F.col("batch") + 1))


def _tick(spark: SparkSession, batch: int) -> DataFrame:
    null = "null"
    columns = ["'tick' kind", f"cast({null} as long) conv_id", "-1L part", "false more", f"cast({null} as long) first", f"cast({null} as long) turn", f"cast({null} as string) role", f"cast({null} as string) payload", f"{batch} batch"]
    return spark.range(1).selectExpr(*columns)


@contextlib.contextmanager
def _settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in (*_SETTINGS, "spark.sql.streaming.noDataMicroBatches.enabled")}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _fed(spark: SparkSession, source: str, sink: str, checkpoint: str, idle: int) -> None:
    """Start the query on its checkpoint, take what is new in ``source``, and stop."""
    rows = spark.readStream.schema(INPUT).parquet(source).withWatermark("at", "0 seconds")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stream's helper process on the driver may not find this package
    try:
        keyed = rows.groupBy("conv_id", "part").transformWithState(Reassembly(idle), OUTPUT, "Append", "EventTime")
        query = keyed.writeStream.format("parquet").outputMode("append").options(**writing(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    try:
        query.awaitTermination()
    finally:
        query.stop()


def reassemble(arrivals: DataFrame, n_batches: int, idle: int = IDLE) -> DataFrame:
    """Events of conversations whose turns (conv_id, turn, role, payload, batch) arrive in batches 0 to ``n_batches`` - 1.

    Returns event (release, reject, close), conv_id, turn (-1 for a closing), batch, payload (of a closing: its
    kept but unreleased turns' numbers, ascending, comma-joined, or NULL where ``assembled`` gives only their
    hash), sha256 (of the payload), and for closings n_missing and n_breaks.

    Defined results: rows without a turn are dropped; a null conv_id is a conversation of its own; of repeated turns
    in a batch the smallest payload arrives, of batches the earliest is kept; an empty batch still counts towards
    closing; an empty table gives no event; other columns are ignored. Source, sink and checkpoint are new
    folders under ``spark.checkpoint.dir``; a query that ends early can be started again on them.
    """
    spark = arrivals.sparkSession
    bounded_batches(spark)
    source, sink, checkpoint, store = (work_path(spark, f"turns-{x}") for x in ("source", "sink", "checkpoint", "arrivals"))
    columns = [c.split()[0] for c in INPUT.split(", ")]
    turns = prepared(arrivals)
    turns.write.partitionBy("batch").options(**writing(store)).parquet(store)
    schema = T.StructType([f for f in T.StructType.fromDDL(INPUT) if f.name != "at"])
    stored = spark.read.schema(schema).parquet(store)
    with _settings(spark):
        extra = materialize(touches(stored), "turns-touches")
        for n in [*range(n_batches), n_batches + idle]:  # the last one is a tick alone: the end closes what is open
            # a timer is called in the run after the one whose tick made it due; the end calls all
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(n >= n_batches).lower())
            rows = stored.where(F.col("batch") == n).unionByName(extra.where(F.col("batch") == n)).unionByName(_tick(spark, n))
            _timed(rows).select(*columns).write.mode("append").options(**writing(source)).parquet(source)
            _fed(spark, source, sink, checkpoint, idle)
    discard(spark, source, store)
    return assembled(spark.read.schema(OUTPUT).parquet(sink), n_batches)


def _ready(releases: DataFrame) -> DataFrame:
    """(conv_id, part, ready): the batch in which all parts before this one were full; parts that never are, are left out.

    A scan in two levels: runs of parts are summed up first, so no window holds more than a run.
    """
    first_span = (F.shiftleft(_part(F.col("first")) + 1, PART_BITS) - F.col("first")).cast("long")
    span = F.when(F.col("part") == 0, first_span).otherwise(F.lit(1 << PART_BITS))
    full = releases.groupBy("conv_id", "part", "first").agg(F.count("*").alias("n"), F.max("batch").alias("batch")).where(F.col("n") == span)
    full = full.select("conv_id", "part", "batch", _part(F.col("part")).alias("block"))
    blocks = full.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.max("batch").alias("batch"))
    w = Window.partitionBy("conv_id").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", (F.row_number().over(w) == F.col("block") + 1).alias("dense"), F.min(F.col("n") == 1 << PART_BITS).over(before).alias("whole"), F.max("batch").over(before).alias("carry"))
    carried = carried.where(F.col("dense") & F.coalesce("whole", F.lit(True))).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "carry")
    inner = Window.partitionBy("conv_id", "block").orderBy("part")
    scanned = full.join(carried, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    scanned = scanned.withColumn("place", F.row_number().over(inner)).where(F.col("place") == F.col("part") % (1 << PART_BITS) + 1)
    upto = F.greatest("carry", F.max("batch").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return scanned.select("conv_id", (F.col("part") + 1).alias("part"), upto.alias("ready"))


_HASHED = "conv_id long, batch int, sha256 string"


def _closings(parts: DataFrame, ready: DataFrame) -> DataFrame:
    """One closing for each conversation of several parts.

    The numbers of a conversation's unreleased turns go through one hash in ascending order, which no other way
    than in turn can give; numbers alone do, part by part, in constant memory.
    """
    r = ready.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "ready")
    seen = parts.join(r, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left").drop("_c", "_p")
    tails = parts.select(F.col("conv_id").alias("_c"), (F.col("part") + 1).alias("_p"), F.col("tail_role").alias("_tail"))
    seen = seen.join(tails, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left").drop("_c", "_p")
    base = F.shiftleft(_part(F.col("first")) + F.col("part"), PART_BITS)
    seen = seen.withColumn("held", F.when((F.col("part") > 0) & F.col("ready").isNull() & (F.col("run") > base), base))
    facts = seen.groupBy("conv_id").agg(
        F.max("batch").alias("batch"), F.min("first").alias("first"), F.max("largest").alias("largest"), F.sum("n_kept").alias("n_kept"),
        (F.sum("n_breaks") + F.count_if(F.col("head_role") == F.col("_tail"))).alias("n_breaks"),
    )
    ordered = seen.select("conv_id", "part", "held", "run", "payload").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def hashed(batches):
        key, digest, some = None, None, False
        for b in batches:
            for r in b.to_pylist():
                if digest is None or r["conv_id"] != key:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv_id": key, "sha256": digest.hexdigest()}], schema=pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())]))
                    key, digest, some = r["conv_id"], hashlib.sha256(), False
                held = ",".join(map(str, range(r["held"], r["run"]))) if r["held"] is not None else ""
                for text in (held, r["payload"]):
                    if text:
                        digest.update(("," * some + text).encode())
                        some = True
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "sha256": digest.hexdigest()}], schema=pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())]))

    digests = ordered.mapInArrow(hashed, "conv_id long, sha256 string").withColumnRenamed("conv_id", "_c")
    return facts.join(digests, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c").withColumn("payload", F.lit(None).cast("string"))


def assembled(events: DataFrame, n_batches: int) -> DataFrame:
    """The stream's output (of parts) as events of conversations; see ``reassemble``."""
    missing = F.col("largest") - F.col("first") + 1 - F.col("n_kept")
    columns = ["event", "conv_id", "turn", "batch", "payload", "sha256", "n_missing", "n_breaks"]

    def shown(df: DataFrame, close: bool) -> DataFrame:
        out = df if "sha256" in df.columns else df.withColumn("sha256", F.sha2("payload", 256))
        out = out.withColumn("n_missing", missing if close else F.lit(None).cast("long"))
        return out.withColumn("batch", F.least("batch", F.lit(n_batches)).cast("long")).select(*columns)

    closing = F.col("event") == "close"
    own = events.where(~closing & (~F.col("more") | (F.col("event") == "reject") | (F.col("part") == 0)))
    long = events.where("more")
    releases = long.where("event = 'release'")
    ready = _ready(releases)
    r = ready.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "ready")
    later = releases.where("part > 0").join(r, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).drop("_c", "_p")
    later = later.withColumn("batch", F.greatest("batch", "ready"))
    closed = _closings(long.where(closing), ready).withColumns({"event": F.lit("close"), "turn": F.lit(-1).cast("long")})
    return shown(own, False).unionByName(shown(later, False)).unionByName(shown(events.where(closing & ~F.col("more")), True)).unionByName(shown(closed, True))


def dealt(conversations: DataFrame, n_batches: int = 8) -> DataFrame:
    """A table of conversations (conv_id, turn, role, text) as arrivals: each turn in one batch by its hash, some once more as a user's, in a later one.

    Null roles and texts are empty; rows without a turn are dropped; a null conv_id hashes as empty.
    """
    rows = project(conversations, conv_id="long", turn="long", role="string", text="string").where("turn is not null").fillna("", ["role", "text"])
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    rows = rows.withColumn("h", F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long"))
    again = F.when(F.col("h") % 7 < 2, F.struct(((F.col("h") + 3) % n_batches).cast("int").alias("batch"), F.lit("user").alias("role")))
    both = F.filter(F.array(F.struct((F.col("h") % n_batches).cast("int").alias("batch"), "role"), again), lambda x: x.isNotNull())
    sent = rows.select("conv_id", "turn", "text", F.inline(both))
    return sent.select("conv_id", "turn", "role", F.concat("role", F.lit("|"), "text").alias("payload"), "batch")


def digest(conversations: DataFrame, n_batches: int = 8, idle: int = IDLE) -> DataFrame:
    """Events of a whole table of conversations dealt into batches: event, sha256, conv_id, turn, batch, n_missing, n_breaks."""
    return reassemble(dealt(conversations, n_batches), n_batches, idle).select("event", "sha256", "conv_id", "turn", "batch", "n_missing", "n_breaks")
