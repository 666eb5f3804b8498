"""Statistics of the tree, the links, the event log and activity over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.functions import text as tx
from loam.visibility import moment


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.when(whole > 0, part / whole), digits)


def corpus(nodes: DataFrame, now: str) -> DataFrame:
    """One row over live nodes that aren't categories."""
    n = nodes.filter("deleted_at is null and type != 'category'")
    chars = F.length(F.coalesce("body", F.lit("")))
    cur = F.col("origin") == "curated"
    return n.agg(F.count(F.lit(1)).alias("n"), F.count_if(cur).alias("curated"), F.count_if(~cur).alias("extracted"), F.count_if(F.size("embedding") > 0).alias("embedded"), F.count_if(F.size("pin_triggers") > 0).alias("pinned"), F.coalesce(F.sum(F.when(cur, chars)), F.lit(0)).alias("chars"), tx.approx_tokens(F.coalesce(F.sum(F.when(cur, chars)), F.lit(0))).alias("tokens"), F.countDistinct(ps.project_slug(F.col("path"))).alias("projects"))


def quality(nodes: DataFrame, now: str, oversized: int = 2000) -> DataFrame:
    """One row of bands over live curated nodes that aren't categories."""
    n = nodes.filter("deleted_at is null and origin = 'curated' and type != 'category'")
    i, t = F.round(F.col("importance").cast("double"), 6), moment(now)
    ago = lambda c, d: F.col(c) >= t - F.expr(f"INTERVAL {d} DAYS")
    chars = F.length(F.coalesce("body", F.lit("")))
    counts = {
        "high": i >= 0.7, "middle": (i >= 0.4) & (i < 0.7), "low": i < 0.4,
        "created_7d": ago("created_at", 7), "created_30d": ago("created_at", 30), "updated_7d": ago("updated_at", 7), "updated_30d": ago("updated_at", 30),
        "never_accessed": F.coalesce("access_count", F.lit(0)) == 0, "stale": F.col("updated_at") < t - F.expr("INTERVAL 180 DAYS"),
        "expired": F.col("valid_until") < t, "oversized": chars > oversized,
    }
    return n.agg(*[F.count_if(c).alias(k) for k, c in counts.items()], F.round(F.avg(chars), 6).alias("avg_chars"))


def branches(nodes: DataFrame) -> DataFrame:
    """(branch, n, last_update)."""
    return nodes.groupBy(ps.branch(F.col("path")).alias("branch")).agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_update"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def monthly(df: DataFrame, column: str, now: str, months: int = 6) -> DataFrame:
    """(month, n) of the last months."""
    start = F.date_trunc("month", moment(now).cast("timestamp")) - F.expr(f"INTERVAL {months - 1} MONTHS")
    m = F.date_trunc("month", F.col(column).cast("timestamp"))
    return df.filter(m >= start).groupBy(F.date_format(m, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def activity(nodes: DataFrame, now: str, days: int = 365) -> DataFrame:
    """(day, created, updated) for every one of the last days (1 to 400), those without any too. Updated: touched last on a later day than created."""
    days = max(1, min(400, days))
    today = F.to_date(moment(now))
    spine = nodes.sparkSession.range(days).select(F.date_sub(today, F.col("id").cast("int")).alias("day"))
    c, u = F.to_date("created_at"), F.to_date("updated_at")
    made = nodes.groupBy(c.alias("day")).agg(F.count(F.lit(1)).alias("created"))
    touched = nodes.filter(u > c).groupBy(u.alias("day")).agg(F.count(F.lit(1)).alias("updated"))
    return spine.join(made, "day", "left").join(touched, "day", "left").fillna(0, ["created", "updated"])


def streaks(series: DataFrame) -> DataFrame:
    """(start, length) of runs of days with activity; series: (day, n), one row a day. The window is over days, not over rows of data."""
    on = series.filter("n > 0").withColumn("_i", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))
    return on.groupBy("_i").agg(F.min("day").alias("start"), F.count(F.lit(1)).alias("length")).drop("_i")


def levels(series: DataFrame, cuts: tuple[float, ...] = (0.3, 0.6, 0.85)) -> DataFrame:
    """Adds level 0 to 4: 0 without activity, else by the values at the given shares of the days with any (the value at position floor(share n))."""
    ranked = series.filter("n > 0").withColumn("_r", F.row_number().over(Window.orderBy("n")) - 1)
    total = ranked.agg(F.count(F.lit(1)).alias("_n"))
    at = [F.max(F.when(F.col("_r") == F.floor(F.col("_n") * c), F.col("n"))).alias(f"_q{i}") for i, c in enumerate(cuts)]
    quantiles = ranked.join(F.broadcast(total)).agg(*at)
    level = F.when(F.col("n") <= 0, 0)
    for i in range(len(cuts)):
        level = level.when(F.col("n") <= F.col(f"_q{i}"), i + 1)
    return series.join(F.broadcast(quantiles)).withColumn("level", level.otherwise(len(cuts) + 1)).drop(*[f"_q{i}" for i in range(len(cuts))])


def link_quality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links, their origin, mean confidence of inferred ones, curated nodes that no link at all touches."""
    touched = links.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    alone = nodes.filter("deleted_at is null and origin = 'curated' and type != 'category'").join(touched, "id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    inferred = F.col("link_origin") == "inferred"
    return links.agg(F.count(F.lit(1)).alias("n"), F.count_if(inferred).alias("inferred"), F.round(F.avg(F.when(inferred, F.col("confidence").cast("double"))), 6).alias("avg_confidence")).join(F.broadcast(alone))


def event_metrics(events: DataFrame) -> DataFrame:
    """One row. events: (session, event, chars, hit: boolean, semantic: boolean, latency)."""
    prompt = F.col("event") == "prompt"
    per_session = events.groupBy("session").agg(F.sum(F.coalesce("chars", F.lit(0))).alias("c"), F.count_if(prompt).alias("prompts"), F.count_if(prompt & F.col("hit")).alias("hits"), F.count_if(prompt & F.col("semantic")).alias("sem"), F.sum(F.when(prompt, F.col("latency"))).alias("lat"))
    return per_session.agg(F.count(F.lit(1)).alias("sessions"), F.sum("prompts").alias("prompts"), share(F.sum("hits"), F.sum("prompts")).alias("hit_rate"), share(F.sum("sem"), F.sum("prompts")).alias("semantic_share"), F.round(F.avg("c"), 6).alias("chars_per_session"), share(F.sum("lat"), F.sum("prompts")).alias("avg_latency"))


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, n) of the most frequent elements of an array column."""
    return df.select(F.explode(column).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def use_rate(feedback: DataFrame, now: str, days: int = 30) -> DataFrame:
    w = feedback.filter(F.col("injected_at") >= moment(now) - F.expr(f"INTERVAL {days} DAYS"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if("used").alias("used"), share(F.count_if("used"), F.count(F.lit(1))).alias("rate"))


def health(projects: DataFrame, milestones: DataFrame, tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of totals over live rows."""
    live = lambda d: d.filter("deleted_at is null").dropDuplicates(["id"])
    p = live(projects).agg(F.count(F.lit(1)).alias("projects"), F.sum(F.when(F.col("archived"), 1).otherwise(0)).alias("archived"))
    m = live(milestones).agg(F.count(F.lit(1)).alias("milestones"), F.sum(F.when(F.col("completed"), 1).otherwise(0)).alias("milestones_done"))
    t = live(tasks).agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.when(F.col("completed"), 1).otherwise(0)).alias("tasks_done"))
    n = live(nodes).agg(F.round(F.avg(F.col("importance").cast("double")), 2).alias("avg_importance"))
    return p.join(F.broadcast(m)).join(F.broadcast(t)).join(F.broadcast(n))


def tail_bytes(lines: DataFrame, order: str, text: str, budget: int, spans: int = 256) -> DataFrame:
    """The newest lines (and their line ends) within a budget of bytes; lines of equal order come as one.

    The lines are summed by span of the order first; whole spans are kept or left by their sums, and only the span in
    which the budget ends is opened, again by spans, until it holds few lines. So no task orders the log."""
    rows = lines.withColumn("_b", (F.octet_length(text) + 1).cast("long"))
    key = F.col(order).cast("double") if dict(lines.dtypes)[order] not in ("timestamp", "timestamp_ntz") else F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    rows = rows.filter(F.col(order).isNotNull()).withColumn("_o", key)
    low, high, n = rows.agg(F.min("_o"), F.max("_o"), F.count(F.lit(1))).first()
    floor, left = float("inf"), budget  # lines above floor are kept; what is left is for those from low to high
    while n > spans * 64 and high > low:
        width = (high - low) / spans
        part = rows.filter((F.col("_o") >= low) & (F.col("_o") <= high)).withColumn("_s", F.least(F.floor((F.col("_o") - low) / width), F.lit(spans - 1)))
        sums = sorted(part.groupBy("_s").agg(F.sum("_b"), F.count(F.lit(1)), F.min("_o"), F.max("_o")).collect(), reverse=True)  # at most `spans` rows
        for _, size, count, first, last in sums:
            if size > left:
                low, high, n = first, last, count
                break
            left -= size
            floor = first
        else:
            return rows.drop("_b", "_o")
        if high - low <= 0:
            break
    inside = rows.filter((F.col("_o") >= low) & (F.col("_o") <= high) & (F.col("_o") < floor))
    w = Window.orderBy(F.desc("_o")).rangeBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("_run", F.sum("_b").over(w)).filter(F.col("_run") <= left).drop("_run")
    return rows.filter(F.col("_o") >= floor).unionByName(cut).drop("_b", "_o")


def file_coverage(files: DataFrame, nodes: DataFrame, probe: int = 80) -> DataFrame:
    """One row over memory files (path, text): number, characters, and how many are in the tree by their first characters after the frontmatter, compared as normalised text."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\A---\n.*?\n---\n", ""), r"\s+", " ")))
    f = files.select(F.col("path").alias("f"), F.length("text").alias("chars"), F.substring(plain(F.col("text")), 1, probe).alias("probe"))
    key = F.substring(plain(F.col("body")), 1, probe)
    hit = f.join(nodes.select(key.alias("probe")).filter("probe != ''").distinct(), "probe", "left_semi").select("f").distinct().withColumn("_h", F.lit(1))
    return f.join(hit, "f", "left").agg(F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"), F.count("_h").alias("covered"))


def attribute_replies(rows: DataFrame) -> DataFrame:
    """(conv, prompt_no, prompt, reply): text of the replies from each prompt to the next one. rows: (conv, turn, role, text); prompts are role `user`."""
    w = Window.partitionBy("conv").orderBy("turn")
    seg = rows.withColumn("prompt_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).filter("prompt_no > 0")
    parts = seg.groupBy("conv", "prompt_no").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("prompt"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("r"))
    return parts.select("conv", F.col("prompt_no").cast("long").alias("prompt_no"), "prompt", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("reply"))
