"""Plans run over file streams to the end, as queries: the result must be that of the batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators.aggregates import aggregate, count, count_distinct
from weir.operators.relational import project, select
from weir.plans.basics import TEXTS
from weir.plans.builder import Component, Source
from weir.plans.named import PLANS, theta_output_dominated
from weir.plans.oracles import ORACLES as PLAN_ORACLES
from weir.session import shared_folder
from weir.sources.tables import stream, table
from weir.streaming import append, events, online, texts


def tables_of(plan: Component) -> set[str]:
    return {plan.name} if isinstance(plan, Source) else {n for c in plan.inputs for n in tables_of(c)}


#: Micro-batches that a registered query takes in at least, each with some of every table; of plans that take rows back, more.
BATCHES, MORE = 2, dict.fromkeys(("tpch17", "tpch18", "tpch22", "nested_first"), 4)

#: Parts are stored compressed and shuffled as they are, which takes a few times their size.
FILES = 4


def arriving(spark: SparkSession, sf_dir: str, names: list[str], folder: str, batches: int = BATCHES) -> dict[str, DataFrame]:
    """The tables as streams that arrive in ``batches`` micro-batches. A table of fewer files is first written anew; what Spark reads in
    several parts gets ``FILES`` files for each of them in every micro-batch. Parts of about the same number of rows are written as they
    are read, without a shuffle; of others the rows are dealt out by their hashes."""
    out = {}
    for name in names:
        rows = table(spark, sf_dir, name)
        files = len(rows.inputFiles())
        if files < batches:
            parts, path = rows.rdd.getNumPartitions(), f"{folder}/tables/{name}.parquet"
            files = batches * (FILES * parts if parts > 1 else 1)
            if most := _even(rows, files):
                rows.write.option("maxRecordsPerFile", most).parquet(path)
                files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
            else:
                rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
            out[name] = stream(spark, f"{folder}/tables", name, -(-files // batches))
        else:
            out[name] = stream(spark, sf_dir, name, max(1, files // batches))
    return out


def _even(rows: DataFrame, files: int) -> int | None:
    """Rows of a file if ``files`` are made of the parts in which Spark reads a table; None for one part or where the largest has more
    than twice the rows of the mean. Rows are counted from the footers of the table's files."""
    parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    if len(parts) < 2 or max(parts) * rows.rdd.getNumPartitions() > 2 * sum(parts):
        return None
    return -(-sum(parts) // files)


def _run(plan: Callable[[], Component], how, batches: int = BATCHES) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made, folder = plan(), _folder(spark)
        return how(made, arriving(spark, sf_dir, sorted(tables_of(made)), folder, batches), folder).result()

    return query


def _text(name: str, tables: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """A text of the dialect as a running plan."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _folder(spark)
        return texts.run(spark, TEXTS[name], arriving(spark, sf_dir, tables, folder), folder).result()

    return query


def flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment with counts summed in parts, flushed at an interval while the query runs, and then stopped."""
    made, folder = PLANS["hyracksbatch"](), _folder(spark)
    running = online.start(made, arriving(spark, sf_dir, sorted(tables_of(made)), folder), folder, "100 milliseconds")
    return running.stop().result()


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running count of one type of event."""
    plan, folder = Source("events", aggregate(["event_type"], n=count())), _folder(spark)
    return append.run(plan, arriving(spark, sf_dir, ["events"], folder), folder).look_up(event_type="click")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents counted over a stream."""
    words = F.explode(F.split(F.col("text"), r"\s+")).alias("word")
    plan = Source("documents", project(words), select("word <> ''"), aggregate(["word"], n=count()))
    folder = _folder(spark)
    return append.run(plan, arriving(spark, sf_dir, ["documents"], folder), folder).result()


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different users met each type of event: a stream against a static table, then distinct users."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    folder = _folder(spark)
    met = arriving(spark, sf_dir, ["events"], folder)["events"].join(users, "user_id").select("event_type", "user_id")
    plan = Source("events", aggregate(["event_type"], n=count_distinct(F.col("user_id"))))
    return append.run(plan, {"events": met}, folder).result()


_LATE = "1 day"


def _events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events to their end, in one micro-batch, as the table's rows don't arrive in the order of their times; a watermark takes
    times with a zone only."""
    return events.ended(stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", folder)


def _drained(rows: DataFrame, folder: str) -> DataFrame:
    zoneless = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")}
    return events.drain(rows, folder).withColumns(zoneless)


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = events.tumbling(_events(spark, sf_dir, folder), "ts", "1 hour", _LATE, ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 2))
    return _drained(rows, folder)


def event_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours that begin every hour."""
    folder = _folder(spark)
    return _drained(events.sliding(_events(spark, sf_dir, folder), "ts", "2 hours", "1 hour", _LATE, ["event_type"], n=F.count("*")), folder)


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    return _drained(events.sessions(_events(spark, sf_dir, folder), "ts", "2 hours", _LATE, ["user_id"], n=F.count("*")), folder)


_APPEND = ("hyracks", "tpch3", "tpch5", "tpch6", "tpch7", "tpch9", "tpch10", "tpch12", "theta_hyracks", "theta_inequality")
_ONLINE = ("distinct_hyracks", "hyracks_pre_agg", "tpch4", "tpch17", "tpch18", "tpch20", "tpch22", "nested_first", "theta_multiple_join")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"stream_{n}": _run(PLANS[n], append.run) for n in _APPEND},
    **{f"online_{n}": _run(PLANS[n], online.run, MORE.get(n, BATCHES)) for n in _ONLINE},
    "online_theta_output_dominated": _run(theta_output_dominated, online.run),
    "online_dialect_tpch3": _text("tpch3", ["customer", "orders", "lineitem"]),
    "online_dialect_tpch7": _text("tpch7", ["nation", "supplier", "customer", "orders", "lineitem"]),
    "online_dialect_distinct_hyracks": _text("distinct_hyracks", ["customer", "orders"]),
    "stream_hyracksbatch": flushed,
    "stream_look_up": looked_up,
    "stream_event_slides": event_slides,
    "stream_word_count": word_count,
    "stream_reach": reach,
    "stream_event_hours": event_hours,
    "stream_event_sessions": event_sessions,
}

ORACLES: dict[str, str] = {
    **{q: PLAN_ORACLES[q.split("_", 1)[1]] for q in QUERIES if q.split("_", 1)[1] in PLAN_ORACLES},
    **{f"online_dialect_{n}": PLAN_ORACLES[n] for n in ("tpch3", "tpch7", "distinct_hyracks")},
    "stream_look_up": "select event_type, count(*) as n from events where event_type = 'click' group by 1",
    "stream_event_slides": """select s as start, s + interval 2 hour as stop, event_type, count(*) as n
from (select unnest([time_bucket(interval 1 hour, ts) - interval 1 hour, time_bucket(interval 1 hour, ts)]) as s, event_type from events) group by 1, 2, 3""",
    "stream_word_count": r"select word, count(*) as n from (select unnest(regexp_split_to_array(text, '\s+')) as word from documents) where word <> '' group by 1",
    "stream_reach": "select event_type, count(distinct user_id) as n from events group by 1",
    "stream_event_hours": """select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as stop, event_type, count(*) as n, round(sum(value), 2) as total
from events group by 1, 2, 3""",
    "stream_event_sessions": """with gaps as (select user_id, ts, case when ts < lag(ts) over w + interval 2 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
numbered as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from gaps)
select min(ts) as start, max(ts) + interval 2 hour as stop, user_id, count(*) as n from numbered group by user_id, s""",
}
