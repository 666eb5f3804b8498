"""The project journal: rollups, searches and lists over projects, milestones, tasks and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import lookup_join, materialize
from loam.visibility import moment


def current(df: DataFrame) -> DataFrame:
    """Live rows, each id once."""
    return df.filter("deleted_at is null").dropDuplicates(["id"])


def has_words(words: list[str], columns: list[str]) -> Column:
    """Every word is in some column, in any case."""
    one = lambda w: reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(w.lower())), F.lit(False)) for c in columns])
    return reduce(Column.__and__, [one(w) for w in words], F.lit(True))


def rollup(projects: DataFrame, milestones: DataFrame, tasks: DataFrame, logs: DataFrame, now: str) -> DataFrame:
    """(project, milestones, milestones_done, tasks, tasks_done, done_pct, logs_30d, last_log); each child table is summed up before it meets the projects."""
    p, m, t, g = map(current, (projects, milestones, tasks, logs))
    per_m = t.groupBy(F.col("milestone_id").alias("id")).agg(F.count(F.lit(1)).alias("tasks"), F.count_if("completed").alias("tasks_done"))
    per_p = m.join(per_m, "id", "left").groupBy("project_id").agg(F.count(F.lit(1)).alias("milestones"), F.count_if("completed").alias("milestones_done"), F.sum(F.coalesce("tasks", F.lit(0))).alias("tasks"), F.sum(F.coalesce("tasks_done", F.lit(0))).alias("tasks_done"))
    recent = F.col("logged_at") >= moment(now) - F.expr("INTERVAL 30 DAYS")
    per_l = g.groupBy("project_id").agg(F.count_if(recent).alias("logs_30d"), F.max("logged_at").alias("last_log"))
    rows = p.select(F.col("id").alias("project_id"), F.col("name").alias("project")).join(per_p, "project_id", "left").join(per_l, "project_id", "left").fillna(0, ["milestones", "milestones_done", "tasks", "tasks_done", "logs_30d"])
    pct = F.when(F.col("tasks") > 0, F.bround(100.0 * F.col("tasks_done") / F.col("tasks"), 1)).otherwise(0.0)
    return rows.select("project", "milestones", "milestones_done", "tasks", "tasks_done", pct.alias("done_pct"), "logs_30d", "last_log")


def overview(projects: DataFrame, milestones: DataFrame, reminders: DataFrame, now: str, archived: bool = False) -> DataFrame:
    """(project, archived, done_pct, updated_at, open, due, overdue) of live projects, archived ones only if asked for: share of done milestones in percent, open reminders, those that are due and those from before today."""
    p = current(projects) if archived else current(projects).filter("not coalesce(archived, false)")
    m = current(milestones).groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("completed").alias("done"))
    left = ~F.coalesce("completed", F.lit(False))
    r = current(reminders).groupBy(F.col("project_id").alias("id")).agg(F.count_if(left).alias("open"), F.count_if(left & due(F.col("target_date"), now)).alias("due"), F.count_if(left & overdue(F.col("target_date"), now)).alias("overdue"))
    rows = p.select("id", F.col("name").alias("project"), F.coalesce("archived", F.lit(False)).alias("archived"), "updated_at").join(m, "id", "left").join(r, "id", "left").fillna(0, ["n", "done", "open", "due", "overdue"])
    return rows.select("project", "archived", F.when(F.col("n") > 0, F.bround(100.0 * F.col("done") / F.col("n"), 1)).otherwise(0.0).alias("done_pct"), "updated_at", "open", "due", "overdue")


def project_view(name: str, projects: DataFrame, milestones: DataFrame, tasks: DataFrame, logs: DataFrame, limit: int = 20) -> DataFrame:
    """(kind, id, parent, title, done, at, position) of one live project: itself, its milestones, their tasks, and its last logs in the order they were written."""
    p = F.broadcast(current(projects).filter(F.col("name") == name).select(F.col("id").alias("_p"), F.col("name").alias("_name"), "status", "updated_at"))
    m = current(milestones).join(p.select("_p"), F.col("project_id") == F.col("_p"), "left_semi")
    t = current(tasks).join(m.select(F.col("id").alias("_m")), F.col("milestone_id") == F.col("_m"), "left_semi")
    g = current(logs).join(p.select("_p"), F.col("project_id") == F.col("_p"), "left_semi").orderBy(F.desc("logged_at"), F.desc("id")).limit(limit)
    g = g.withColumn("position", F.row_number().over(Window.orderBy("logged_at", "id")).cast("long"))  # over `limit` rows
    none, no = F.lit(None).cast("long"), F.lit(None).cast("boolean")
    parts = [
        p.select(F.lit("project").alias("kind"), F.col("_p").cast("long").alias("id"), none.alias("parent"), F.col("_name").alias("title"), no.alias("done"), F.col("updated_at").alias("at"), none.alias("position")),
        m.select(F.lit("milestone"), F.col("id").cast("long"), F.col("project_id").cast("long"), "title", F.coalesce("completed", F.lit(False)), "completed_at", none),
        t.select(F.lit("task"), F.col("id").cast("long"), F.col("milestone_id").cast("long"), "title", F.coalesce("completed", F.lit(False)), "created_at", none),
        g.select(F.lit("log"), F.col("id").cast("long"), F.col("project_id").cast("long"), "entry", no, "logged_at", "position"),
    ]
    return reduce(DataFrame.union, parts)


def complete(rows: DataFrame, ids: DataFrame, done: bool, now: str) -> DataFrame:
    """Milestones, tasks or reminders (id) set done or open; live ones only. A milestone's completion time follows."""
    hits = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("deleted_at").isNull()
    values = {"completed": F.lit(done), "updated_at": moment(now)} | ({"completed_at": moment(now) if done else F.lit(None).cast("timestamp_ntz")} if "completed_at" in rows.columns else {})
    return hits.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def append(rows: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """New rows of a journal table (milestones, tasks, reminders, pages, errors) with the next ids, created and updated now, and a sync_id. new is small: what somebody writes."""
    base = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    order = Window.orderBy(*[F.col(f"`{c}`").cast("string") for c in new.columns])
    kinds = dict(rows.dtypes)
    made = new.withColumn("id", F.row_number().over(order)).join(F.broadcast(base)).withColumn("id", (F.col("id") + F.col("_base")).cast(kinds["id"])).drop("_base").withColumns({c: moment(now) for c in ("created_at", "updated_at") if c in kinds})
    if "sync_id" in kinds and "sync_id" not in new.columns:
        made = made.withColumn("sync_id", F.substring(F.sha2(F.concat_ws("|", F.lit(now), F.col("id").cast("string"), *[F.col(f"`{c}`").cast("string") for c in new.columns]), 256), 1, 32))
    return rows.unionByName(made, allowMissingColumns=True)


def edit(rows: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Live rows of a journal table with the values that changes (id, columns) have for them; null leaves a value as it is."""
    new = changes.dropDuplicates(["id"])
    columns = [c for c in new.columns if c != "id"]
    both = rows.join(new.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in columns]), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("deleted_at").isNull()
    out = both.withColumns({c: F.when(hit, F.coalesce(f"_n_{c}", c)).otherwise(F.col(c)) for c in columns})
    return out.withColumn("updated_at", F.when(hit, moment(now)).otherwise(F.col("updated_at"))).select(*rows.columns)


def errors_of(projects: DataFrame, errors: DataFrame, project: str | None = None, words: list[str] | None = None, limit: int = 50) -> DataFrame:
    """(project, id, error_msg, solution_msg, created_at), the newest first."""
    rows = current(errors).join(current(projects).select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    rows = rows if project is None else rows.filter(F.col("project") == project)
    rows = rows if not words else rows.filter(has_words(words, ["error_msg", "solution_msg"]))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("project", "id", "error_msg", "solution_msg", "created_at")


def search_pages(projects: DataFrame, pages: DataFrame, project: str, words: list[str] | None = None, title: str | None = None) -> DataFrame:
    """(id, title, content) of one project's pages: all, those with all words, or those of a title."""
    rows = current(pages).join(current(projects).filter(F.col("name") == project).select(F.col("id").alias("project_id")), "project_id", "left_semi")
    rows = rows if not words else rows.filter(has_words(words, ["title", "content"]))
    return (rows if title is None else rows.filter(F.col("title") == title)).orderBy("title", "id").select("id", "title", "content")


def ensure_projects(projects: DataFrame, names: DataFrame, now: str) -> DataFrame:
    """projects and those of names (name) that aren't there, with the next ids."""
    new = names.select(F.trim("name").alias("name")).filter("name is not null and name != ''").distinct().join(projects.select("name"), "name", "left_anti")
    return append(projects, materialize(new.withColumn("archived", F.lit(False))), now)


def active_tasks(projects: DataFrame, milestones: DataFrame, tasks: DataFrame) -> DataFrame:
    """(project, milestone, task_id, task): open tasks whose milestone and project are live."""
    p = current(projects).filter("not coalesce(archived, false)").select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    m = current(milestones).select(F.col("id").alias("milestone_id"), "project_id", F.col("title").alias("milestone"))
    t = current(tasks).filter("not coalesce(completed, false)").select(F.col("id").alias("task_id"), "milestone_id", F.col("title").alias("task"))
    return lookup_join(t.join(m, "milestone_id"), materialize(p), "project_id").select("project", "milestone", "task_id", "task")


def filter_logs(projects: DataFrame, logs: DataFrame, project: str | None = None, level: str | None = None, worker: str | None = None, limit: int = 50) -> DataFrame:
    """The newest logs that meet the conditions given."""
    rows = current(logs).join(current(projects).select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    if project:
        rows = rows.filter(F.col("project") == project)
    if level:
        rows = rows.filter(F.col("level") == level.upper())
    if worker:
        rows = rows.filter(F.contains(F.lower("worker"), F.lit(worker.lower())))
    return rows.orderBy(F.desc("logged_at"), F.desc("id")).limit(limit).select("project", "id", "logged_at", "level", "worker", "entry")


def search_everywhere(tables: dict[str, tuple[DataFrame, list[str]]], words: list[str]) -> DataFrame:
    """(kind, id, title): rows of several tables whose columns hold all words. tables: kind to (rows with id and title, columns to search)."""
    parts = [df.filter(has_words(words, cols)).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col("title")) for kind, (df, cols) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def route_errors(logs: DataFrame, levels: tuple[str, ...] = ("ERROR", "CRITICAL", "FATAL", "EXCEPTION")) -> tuple[DataFrame, DataFrame]:
    """All logs, and those that are errors too as (project_id, error_msg, created_at)."""
    errors = logs.filter(F.upper(F.trim("level")).isin(*levels))
    return logs, errors.select("project_id", F.col("entry").alias("error_msg"), F.col("logged_at").alias("created_at"))


def due(date: Column, now: str) -> Column:
    """Whether a date text (date, or date and time) has come; false where it can't be read."""
    day = F.try_to_timestamp(F.when(F.length(date) == 10, date), F.lit("yyyy-MM-dd"))
    full = F.try_to_timestamp(date, F.lit("yyyy-MM-dd HH:mm"))
    return F.coalesce(F.coalesce(day, full) <= F.lit(now).cast("timestamp"), F.lit(False))


def overdue(date: Column, now: str) -> Column:
    """By the first ten characters, as text."""
    return F.coalesce(F.substring(date, 1, 10) < F.lit(now[:10]), F.lit(False))


def project_of_folder(folders: DataFrame, projects: DataFrame) -> DataFrame:
    """(cwd, project): the project whose folder is the longest that holds the directory. projects: (project, dir).

    Each directory is exploded into its prefixes, so this is an equi-join."""
    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    prefixes = folders.select("cwd", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    hits = prefixes.join(projects.select("project", F.regexp_replace("dir", "/+$", "").alias("dir")), "dir")
    return hits.groupBy("cwd").agg(F.max_by("project", F.struct(F.length("dir"), "project")).alias("project"))
