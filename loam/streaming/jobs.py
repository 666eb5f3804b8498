"""Streams: the log queue, first sights per session, rollups of late events, and linking of new nodes.

Each source is a folder into which files are dropped (or any other stream); offsets and state live in the checkpoint, so
a drained row is never drained again and a restart loses nothing. The jobs run to the end of what is there
(availableNow) or on, as the trigger says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.operators import linking
from loam.operators.journal import ensure_projects, route_errors
from loam.operators.mutate import retention
from loam.operators.neighbours import nearest, pair_ranks
from loam.operators.retrieval import vector_arm
from loam.session import lookup_join, materialize

QUEUE = "project string, level string, worker string, message string, timestamp timestamp"
#: Days of event time after which a session without events is forgotten.
KEPT_DAYS = 7


def read_folder(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int | None = None) -> DataFrame:
    """A stream of the files dropped into a folder."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime="10 seconds")).start()


def valid_entries(queue: DataFrame) -> DataFrame:
    """Entries with a project and a message; the level is INFO and upper case by default."""
    rows = queue.filter((F.coalesce(F.trim("project"), F.lit("")) != "") & (F.coalesce(F.trim("message"), F.lit("")) != ""))
    return rows.withColumn("level", F.upper(F.coalesce(F.nullif(F.trim("level"), F.lit("")), F.lit("INFO"))))


def ingest_queue(queue: DataFrame, out: str, checkpoint: str, now: bool = True, projects: DataFrame | None = None, clock: str | None = None) -> StreamingQuery:
    """Drains the queue into out/logs, and rows of an error level into out/errors too. Each batch is written under its number, so a repeated one replaces itself.

    With projects (a table) and a clock, entries get the project's id, projects not there yet are added under out/projects (the whole table,
    by batch), and a log older than its project keeps isn't written."""
    state = {"projects": projects}

    def handle(batch: DataFrame, number: int) -> None:
        rows = valid_entries(batch)
        rows = rows.select(F.col("project").alias("project_id"), F.col("message").alias("entry"), "level", "worker", F.col("timestamp").alias("logged_at"))
        if state["projects"] is not None:
            state["projects"] = materialize(ensure_projects(state["projects"], rows.select(F.col("project_id").alias("name")), clock))
            state["projects"].write.mode("overwrite").parquet(f"{out}/projects/batch={number}")
            ids = state["projects"].groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_id"))
            rows = lookup_join(rows.withColumn("_name", F.trim("project_id")), materialize(ids), "_name").withColumn("project_id", F.col("_id")).drop("_id", "_name")
            rows = retention(rows.withColumn("logged_at", F.col("logged_at").cast("timestamp_ntz")), state["projects"], clock)
        logs, errors = route_errors(rows)
        logs.write.mode("overwrite").parquet(f"{out}/logs/batch={number}")
        errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    return run(queue, handle, checkpoint, now=now)


def first_in_session(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """(session, path, ts): the first time a session sees a path; the state of a session is dropped `delay` after. events: (session, path, ts)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "path"])


def _seen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Paths not yet shown in this session; a `start` event forgets what was shown."""
    if state.hasTimedOut:
        state.remove()
        return
    shown = set(state.get[0]) if state.exists else set()
    rows = pd.concat(list(batches)).sort_values(["ts", "path"], kind="stable")
    out = []
    for r in rows.itertuples():
        if r.event == "start":
            shown.clear()
        elif r.path is not None and r.path not in shown:
            shown.add(r.path)
            out.append((key[0], r.path, r.ts))
    state.update((sorted(shown),))
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + KEPT_DAYS * 24 * 3600 * 1000)
    yield pd.DataFrame(out, columns=["session", "path", "ts"])


def unseen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(session, path, ts): what a session hasn't been shown since its last start. events: (session, event, path, ts). A session is one group; its state is its own paths."""
    groups = events.withWatermark("ts", late).groupBy("session")
    return groups.applyInPandasWithState(_seen, "session string, path string, ts timestamp", "paths array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def rollup_windows(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; events later than the watermark are left out in append mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def since(df: DataFrame, column: str, cursor: str | None) -> DataFrame:
    """Rows after a high-water mark."""
    return df if cursor is None else df.filter(F.col(column) > F.lit(cursor).cast(dict(df.dtypes)[column]))


def focus_links(new: DataFrame, nodes: DataFrame, named: DataFrame, dims: int = 384, k: int = linking.K_SEMANTIC) -> DataFrame:
    """(a, b, confidence, rank) of candidate links of new nodes (path) with the nodes there are, themselves among them.

    Candidates: the k most similar nodes of each new one, sharers of its rare terms, two hops, mentions either way. rank is that of the
    write-time search: one more than the number of more similar nodes, from the new node's side, among the k nearest."""
    fresh = materialize(new.select("path").distinct())
    mine = materialize(nodes.join(fresh, "path", "left_semi"))
    near = vector_arm(nodes, mine.select(F.col("path").alias("query"), F.col("embedding").alias("vector")), k + 1, dims).filter("query != path")
    near = near.withColumn("rank", F.rank().over(Window.partitionBy("query").orderBy(F.desc("sim")))).filter(F.col("rank") <= k)
    near = materialize(near.select(F.col("query").alias("a"), F.col("path").alias("b"), "sim", F.col("rank").cast("long").alias("rank")))
    vectors = materialize(linking.idf_vectors(nodes))
    told = materialize(linking.mentions(nodes))
    touch = lambda df, x, y: df.join(fresh.withColumnRenamed("path", x), x, "left_semi").unionByName(df.join(fresh.withColumnRenamed("path", y), y, "left_semi"))
    lexical = linking.rare_term_pairs(vectors).select("a", "b")
    pairs = linking.canonical(near.select("a", "b"), touch(lexical, "a", "b"), touch(linking.two_hop(linking.deliberate(named)), "a", "b"), touch(told, "path", "mentioned"))
    pairs = materialize(pairs)
    ranked = materialize(nearest(nodes, linking.K_SEMANTIC, dims))
    featured = linking.features(pairs, ranked, vectors, named, materialize(pair_ranks(nodes, ranked, pairs, dims)))
    scored = linking.score(featured, told).select("a", "b", "confidence")
    best = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("rank").alias("near")).groupBy("a", "b").agg(F.min("near").alias("rank"))
    return scored.join(best, ["a", "b"], "left")


def link_new_nodes(new: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, now: bool = True, dims: int = 384) -> StreamingQuery:
    """Writes, under the number of each batch of new nodes (path), their routed links (a, b, confidence, action). tables: the nodes and links by path as they are when a batch comes."""
    def handle(batch: DataFrame, number: int) -> None:
        nodes, named = tables()
        none = batch.sparkSession.createDataFrame([], "a string, b string")
        linking.route(focus_links(batch, nodes, named, dims), named, none).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run(new, handle, checkpoint, now=now)
