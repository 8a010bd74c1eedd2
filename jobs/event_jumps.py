"""Event jumps by day: how often one type of event follows another, kept up to date as events come in.

What a network's or a chain's rates are estimated from, for logs that grow: each run takes the files that are new since
the last one, whatever days their events are of, and replaces only the days whose jumps they change.

    python -m jobs.event_jumps SOURCE OUT --config jobs/event_jumps.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans import derive
from cellweave.plans.staging import cut

from .common import command, log, opened, replace_partitions, settings

DEFAULTS = {"user": "user_id", "event": "event_id", "type": "event_type", "time": "ts", "files_per_batch": 1000}
EVENT = "user string, one struct<us:bigint,event:string,type:string,block:date>"
EVENTS, ENDS, JUMPS = f"{EVENT}, day date, batch bigint", "user string, first {0}, last {0}, day date".format(EVENT.split(" one ")[1]), "src string, dst string, n bigint, us bigint, day date"
DAY = 86_400_000_000


def accepted(events: DataFrame, s: dict) -> DataFrame:
    """(user, one, day): a row an event that has a user, a time and a type, in the form of derive.consecutive(). Ids go
    by number where they are numbers, as twenty digits, else by their text."""
    name = lambda k: F.col(f"`{s[k]}`")
    number = dict(events.dtypes)[s["event"]] in ("tinyint", "smallint", "int", "bigint")
    # the sign bit flipped, so that negative numbers come before the others in text order too
    event = F.lpad((name("event").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") if number else name("event").cast("string")
    rows = events.select(name("user").cast("string").alias("user"), F.unix_micros(name("time").cast("timestamp")).alias("us"), event.alias("event"), name("type").cast("string").alias("type"))
    rows = rows.where("user IS NOT NULL AND us IS NOT NULL AND type IS NOT NULL")
    rows = rows.withColumn("day", F.date_from_unix_date(F.floor((F.col("us") - F.pmod("us", F.lit(DAY))) / DAY).cast("int")))
    return rows.select("user", F.struct("us", "event", "type", F.col("day").alias("block")).alias("one"), "day")


def pattern(source: str) -> str:
    """A pattern that matches just this path. A file stream takes patterns that match a file, but no file's plain path."""
    source = source.rstrip("/")
    return source if any(c in source for c in "*?[{") else f"{source[:-1]}[{source[-1]}]"


def update(batch: DataFrame, number: int, out: str, s: dict) -> None:
    """Take one batch in. Repeating it, as after a failure, replaces what it has written with the same.

    Every table is partitioned by day, and days are few (a broadcast of them is some hundred bytes for each ten). A day
    changes if the batch has events of it, or of the day before it on which one of the batch's users was seen.
    """
    spark = batch.sparkSession
    events, ends, jumps = (f"{out}/{x}" for x in ("events", "ends", "jumps"))
    replace_partitions(accepted(batch, s).withColumn("batch", F.lit(number).cast("long")), events, "day", "batch")
    stored = spark.read.schema(EVENTS).parquet(events)
    new = stored.where(F.col("batch") == number)
    days = cut(new.groupBy("day").agg(F.count(F.lit(1)).alias("n")))
    if days.isEmpty():
        log.info("batch %d: nothing new", number)
        return
    of = lambda rows, which: rows.join(F.broadcast(which.select("day")), "day", "left_semi")
    replace_partitions(derive.block_ends(of(stored, days).select("user", "one"), ["user"]).select("user", "first", "last", F.col("block").alias("day")), ends, "day")
    held = spark.read.schema(ENDS).parquet(ends).withColumnRenamed("day", "block")
    # of the batch's users, the days that come right after one of the batch's days
    seam = derive.seams(held.join(new.select("user").distinct(), "user", "left_semi"), ["user"])
    after = of(seam.select(F.col("one.block").alias("day"), F.col("two.block").alias("next")), days).select(F.col("next").alias("day"))
    changed = cut(days.select("day").union(after).distinct())
    inside = derive.consecutive(of(stored, changed).select("user", "one.*"), ["user"], F.col("block"), ["us", "event"], ["type"]).where("one.block = two.block")
    across = derive.seams(held, ["user"])
    across = across.join(F.broadcast(changed), across["two"]["block"] == changed["day"], "left_semi")
    found = inside.union(across).groupBy(F.col("one.type").alias("src"), F.col("two.type").alias("dst"), F.col("two.block").alias("day"))
    replace_partitions(found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("two.us") - F.col("one.us")).alias("us")), jumps, "day")
    read, n = days.agg(F.sum("n"), F.count(F.lit(1))).first()
    log.info("batch %d: %d events of %d days read, %d days written", number, read, n, changed.count())


def run(spark: SparkSession, source: str, out: str, config: str | None = None) -> DataFrame:
    """Bring `out` up to date with the Parquet files at `source`: out/jumps (src, dst, n, us by day), the day being that of
    the later event and us the microseconds between the two.

    A user's events go by time, then id, then type. Rows without a user, a time or a type are left out. Events may come
    late. A file is taken once, as the stream's checkpoint under out/checkpoint says; a run without new files changes
    nothing. One run at a time may write to a folder.
    """
    s = settings(spark, config, DEFAULTS)
    for name, schema, parts in (("events", EVENTS, ("day", "batch")), ("ends", ENDS, ("day",)), ("jumps", JUMPS, ("day",))):
        found = opened(spark, f"{out}/{name}", schema, *parts)
    files = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(pattern(source))
    stream = files.writeStream.foreachBatch(lambda batch, number: update(batch, number, out, s)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    found = spark.read.schema(JUMPS).parquet(f"{out}/jumps")
    log.info("%s: %d jumps between types and days", out, found.count())
    return found


def main(argv: list[str] | None = None) -> None:
    command(__doc__, run, argv)


if __name__ == "__main__":
    main()
