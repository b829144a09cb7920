"""From signals to alerts: contract gate, memory, recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series as S


def with_contract(signals: DataFrame, best: DataFrame) -> DataFrame:
    """Signals that have a qualifying contract, with the contract attached.

    Placed before the memory: a symbol without a contract is not remembered, so
    it is looked at again in the next cycle.
    """
    return signals.join(best, "symbol")


def fresh_against(signals: DataFrame, memory: DataFrame) -> DataFrame:
    """Signals that are new or changed with respect to a memory snapshot."""
    return signals.join(memory.select("symbol", "signature"), ["symbol", "signature"], "left_anti")


def alert_memory(events: DataFrame, hours: int = 24, order: tuple[str, ...] = ("ts", "alert_id"), part_rows: int = 100_000) -> DataFrame:
    """Which of the time-ordered signals are sent.

    A signal is sent when its symbol is not remembered or is remembered with
    another signature; only sending refreshes the memory, which fades after
    `hours`. Hence the remembered signature is always the one of the signal
    before, a change of signature is always sent, and inside an unchanged run the
    sent ones are found by stepping over at least `hours` each time.

    The signal before and the run number come from chunks of about `part_rows` rows
    with carried values. A run is then reduced to one entry per scan time before it is walked.
    """
    runs = _numbered_runs(S.add_parts(events, rows=part_rows), order)
    first_at = runs.groupBy("symbol", "run", "signature", "ts").agg(F.min("alert_id").alias("alert_id"))
    walked = first_at.groupBy("symbol", "run", "signature").agg(
        F.array_sort(F.collect_list(F.struct("ts", "alert_id"))).alias("times"))
    return (walked.withColumn("sent", F.explode(_spaced(F.col("times"), hours)))
            .select("symbol", F.col("sent.ts").alias("ts"), F.col("sent.alert_id").alias("alert_id"),
                    "signature", (F.col("sent") == F.element_at("times", 1)).alias("changed")))


def _numbered_runs(chunked: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Number the runs of equal signatures per symbol in `order`.

    Changes inside a chunk are counted there; the table of chunks tells whether a
    chunk opens with a change and how many runs came before it.
    """
    w = Window.partitionBy("symbol", S.CHUNK).orderBy(*order)
    before = F.lag("signature").over(w)
    rows = chunked.withColumn("_new", F.when(before != F.col("signature"), 1).otherwise(0))
    at = F.struct(*order)
    ends = rows.groupBy("symbol", S.CHUNK).agg(
        F.min_by("signature", at).alias("_first"), F.max_by("signature", at).alias("_last"),
        F.sum("_new").alias("_n"))
    chunks = Window.partitionBy("symbol").orderBy(S.CHUNK)
    opens = F.coalesce(F.lag("_last").over(chunks) != F.col("_first"), F.lit(True)).cast("int")
    ends = ends.withColumn("_open", opens)
    earlier = F.sum(F.col("_n") + F.col("_open")).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("symbol", S.CHUNK, (F.coalesce(earlier, F.lit(0)) + F.col("_open")).alias("_base"))
    local = rows.withColumn("_cum", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return S.join_chunks(local, ends, S.KEYS).withColumn("run", F.col("_base") + F.col("_cum"))


def _spaced(times: Column, hours: int) -> Column:
    """Keep the first entry and then each first entry more than `hours` after the last kept."""
    kind = "array<struct<ts:timestamp,alert_id:bigint>>"
    gap = hours * 3_600_000_000

    def step(kept: Column, entry: Column) -> Column:
        latest = F.get(kept, F.size(kept) - 1)["ts"]
        due = F.unix_micros(entry["ts"]) - F.unix_micros(latest) > gap
        return F.when(F.coalesce(due, F.lit(True)), F.concat(kept, F.array(entry).cast(kind))).otherwise(kept)

    return F.aggregate(times, F.array().cast(kind), step)


def memory_after(sent: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Memory snapshot at `now`: the last sent signature per symbol, if not faded."""
    last = sent.groupBy("symbol").agg(F.max_by(F.struct("signature", "ts"), F.struct("ts", "alert_id")).alias("m"))
    return last.select("symbol", "m.signature", "m.ts").where(
        F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("ts") <= hours * 3600)


def eligible(subscribers: DataFrame, accepted: DataFrame, approved: DataFrame, now: int,
             admin: int | None = None) -> DataFrame:
    """Every subscriber with `is_eligible`: the admin, or accepted and approved in time.

    An expiry of 0 never ends.
    """
    joined = (subscribers.join(accepted.select("chat_id", F.lit(True).alias("has_accepted")), "chat_id", "left")
              .join(approved.select("chat_id", "expiry"), "chat_id", "left"))
    paid = F.coalesce((F.col("expiry") == 0) | (F.col("expiry") > now), F.lit(False))
    is_admin = F.col("chat_id") == F.lit(admin) if admin else F.lit(False)
    accepted_flag = F.coalesce(F.col("has_accepted"), F.lit(False))
    return joined.select("chat_id", accepted_flag.alias("accepted"), "expiry",
                         (is_admin | (accepted_flag & paid)).alias("is_eligible"))


def lapsed(subscribers: DataFrame, approved: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(remaining subscribers, notices): paid terms that ended are removed and told."""
    from ..functions import texts as T

    ended = (F.col("expiry") > 0) & (F.col("expiry") <= now)
    joined = subscribers.join(approved.select("chat_id", "expiry"), "chat_id", "left")
    gone = F.coalesce(ended, F.lit(False))
    notices = joined.where(gone).select("chat_id", "expiry", F.lit(T.EXPIRY_NOTICE).alias("notice"))
    return joined.where(~gone).select("chat_id"), notices


def subscription_list(approved: DataFrame, accepted: DataFrame, now: int, admin: int | None = None) -> DataFrame:
    return eligible(approved.select("chat_id"), accepted, approved, now, admin).orderBy("chat_id")


def delivery_counts(sent: DataFrame, recipients: DataFrame) -> DataFrame:
    """Messages per alert without writing out every alert-recipient pair.

    Every eligible reader gets every alert, so the pairs add nothing to the two
    lists; one number is attached to each alert.
    """
    total = recipients.where("is_eligible").agg(F.count(F.lit(1)).alias("recipients"))
    return sent.withColumn("recipients", total.scalar())
