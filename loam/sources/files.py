"""Files as tables: event logs, transcripts, gold sets, Markdown memories; and the sinks that write them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators.journal import project_of_folder
from loam.operators.retrieval import judge, usage_rank
from loam.operators.stats import tail_bytes
from loam.session import materialize

# The fields of the logs, transcripts and gold sets that are read.
EVENTS = "ts double, event string, session string, slug string, source string, chars long, semantic boolean, hits array<string>, latency_ms double, reason string"
TRANSCRIPT = "type string, timestamp string, isMeta boolean, message struct<role:string, content:string>, attachment struct<type:string, content:string>"
#: What a shown digest begins with, and how a path is written in it.
MARK, SHOWN_PATH = "# memories", r"⟨(/[^⟩]+)⟩"
GOLD = "prompt string, slug string, expected array<string>, acceptable array<string>, note string"
# Kinds of memory files, by their frontmatter, and the node types they become.
KINDS = {"user": "user", "feedback": "feedback", "project": "project", "reference": "reference"}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of events; lines that can't be read are skipped, and a missing path is an empty log."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(path)


def append_events(events: DataFrame, path: str, most: int | None = None) -> None:
    """Events added to a log. With `most`, a log above so many bytes is rewritten first to its newest half."""
    if most is not None:
        compact_events(events.sparkSession, path, most)
    events.write.mode("append").json(path)


def compact_events(spark: SparkSession, path: str, most: int) -> bool:
    """Keeps the newest lines of a log above `most` bytes, within half of that; whether it did. The log is written beside the old one and swapped with it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old = hadoop(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(old) or fs.getContentSummary(old).getLength() <= most:
        return False
    lines = spark.read.text(path).select("value", F.expr("try_cast(get_json_object(value, '$.ts') as double)").alias("ts"))
    kept = tail_bytes(lines.filter("ts is not null"), "ts", "value", most // 2)
    kept.select("value").write.mode("overwrite").text(path + ".new")
    fs.rename(old, hadoop(path + ".old"))
    fs.rename(hadoop(path + ".new"), old)
    fs.delete(hadoop(path + ".old"), True)
    return True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(conv, turn, r) of the JSON lines of transcripts. The line number within its file orders a transcript, so a file is one row; files are many."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conv"), F.posexplode(F.split("value", "\n")).alias("turn", "line"))
    return lines.filter(F.trim("line") != "").select("conv", "turn", F.from_json("line", TRANSCRIPT).alias("r")).filter("r.type is not null")


def _content(content: Column, tools: bool = False, between: str = " ") -> Column:
    """The text of a message: as it is, or its text pieces, and with tools the inputs of tools too."""
    chunks = F.from_json(content, "array<struct<type:string, text:string, input:string>>")
    kept = F.filter(chunks, lambda c: (c["type"] == "text") | (F.lit(tools) & (c["type"] == "tool_use")))
    pieces = F.transform(kept, lambda c: F.when(c["type"] == "text", c["text"]).otherwise(F.coalesce(c["input"], F.lit("{}"))))
    return F.when(F.ltrim(content).startswith("["), F.array_join(pieces, between)).otherwise(content)


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """(conv, turn, role, text): prompts and replies in order."""
    rows = _lines(spark, path).filter("r.type in ('user', 'assistant') and not coalesce(r.isMeta, false)")
    return rows.select("conv", "turn", F.col("r.type").alias("role"), _content(F.col("r.message.content")).alias("text")).filter("text is not null and text != ''")


def read_injections(spark: SparkSession, path: str, mark: str = MARK) -> DataFrame:
    """(conv, turn, injected_at, paths, prompt, reply): each digest shown in a transcript, the prompt before it, and all that was written after it up to the next prompt or digest."""
    content = F.col("r.message.content")
    only_text = ~F.ltrim(content).startswith("[") | F.forall(F.from_json(content, "array<struct<type:string>>"), lambda c: c["type"] == "text")
    is_prompt = (F.col("r.type") == "user") & ~F.coalesce("r.isMeta", F.lit(False)) & F.coalesce(only_text, F.lit(False))
    note = F.when((F.col("r.type") == "attachment") & (F.col("r.attachment.type") == "hook_additional_context"), F.when(F.ltrim("r.attachment.content").startswith("["), F.array_join(F.from_json("r.attachment.content", "array<string>"), "\n")).otherwise(F.col("r.attachment.content")))
    rows = _lines(spark, path).select("conv", "turn", F.col("r.timestamp").alias("ts"), F.when(is_prompt, F.coalesce(_content(content, True, "\n"), F.lit(""))).alias("prompt"), F.when(F.contains(note, F.lit(mark)), F.regexp_extract_all(note, F.lit(SHOWN_PATH), F.lit(1))).alias("paths"), F.when(F.col("r.type") == "assistant", _content(content, True, "\n")).alias("said"))
    w = Window.partitionBy("conv").orderBy("turn")
    rows = rows.withColumns({"seg": F.sum((F.col("prompt").isNotNull() | F.col("paths").isNotNull()).cast("int")).over(w), "asked": F.last("prompt", True).over(w)})
    parts = rows.groupBy("conv", "seg").agg(F.max("paths").alias("paths"), F.max(F.when(F.col("paths").isNotNull(), F.col("ts"))).alias("ts"), F.min(F.when(F.col("paths").isNotNull(), F.col("turn"))).alias("turn"), F.max(F.when(F.col("paths").isNotNull(), F.col("asked"))).alias("prompt"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("turn", "said")))), lambda x: x["said"]), "\n").alias("reply"))
    return parts.filter((F.size("paths") > 0) & F.col("ts").isNotNull()).select("conv", "turn", F.try_to_timestamp("ts").cast("timestamp_ntz").alias("injected_at"), "paths", F.coalesce("prompt", F.lit("")).alias("prompt"), "reply")


def feedback(injections: DataFrame, corpus: DataFrame) -> DataFrame:
    """(session_id, path, injected_at, used, score) of each node shown, judged by the reply. corpus: (path, title, body)."""
    each = injections.select(F.concat_ws("#", "conv", "turn").alias("query"), "conv", "injected_at", F.explode(F.array_distinct("paths")).alias("path"), "prompt", "reply")
    ranks = judge(usage_rank(corpus, each.select("query", "path", "prompt", "reply")), corpus)
    return each.join(ranks, ["query", "path"]).select(F.col("conv").alias("session_id"), "path", "injected_at", "used", F.col("rank_share").alias("score"))


def substantive(text) -> object:
    """Whether a user's turn says something: 40 characters, no command, no markup, no notice of the tool."""
    t = F.trim(text)
    return (F.length(t) >= 40) & ~t.startswith("/") & ~t.startswith("!") & ~t.rlike(r"(?s)^<.*>$") & ~F.contains(F.lower(t), F.lit("[request interrupted")) & ~F.startswith(t, F.lit("Caveat:"))


def user_turns(transcript: DataFrame) -> DataFrame:
    return transcript.filter((F.col("role") == "user") & substantive(F.col("text")))


def mine_prompts(transcript: DataFrame, limit: int = 300, least: int = 12, length: int = 2000) -> DataFrame:
    """(prompt): the newest distinct prompts; transcript: (conv, turn, role, text, modified)."""
    rows = transcript.filter((F.col("role") == "user") & (F.length(F.trim("text")) >= least) & ~F.trim(F.col("text")).rlike("^[/!<]")).select(F.substring(F.trim("text"), 1, length).alias("prompt"), "modified", "conv", "turn")
    newest = rows.groupBy("prompt").agg(F.max(F.struct("modified", "conv", (-F.col("turn")).alias("turn"))).alias("at"))
    return newest.orderBy(F.desc("at"), "prompt").limit(limit).select("prompt")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a gold set; blank lines and lines of // are skipped, a line without a prompt is an error that names it."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    rows = lines.select("value", F.from_json("value", GOLD).alias("g"))
    told = F.coalesce(F.trim(F.col("g.prompt")), F.lit("")) != ""
    return rows.select(F.when(told, F.col("g")).otherwise(F.raise_error(F.concat(F.lit("gold line without a prompt: "), "value")).cast("struct<prompt:string,slug:string,expected:array<string>,acceptable:array<string>,note:string>")).alias("g")).select("g.*")


def read_memory_files(spark: SparkSession, path: str, folders: DataFrame | None = None) -> DataFrame:
    """(file, path, title, type, importance, body) of Markdown files with frontmatter; a field that can't be read gets its default.

    folders (project, dir): a file within a project's folder becomes a node of that project, others a note."""
    raw = spark.read.text(path, wholetext=True).select(F.url_decode(F.input_file_name()).alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("v"))
    front = F.regexp_extract("v", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    rows = raw.select("file", front.alias("f"), F.regexp_replace(F.regexp_replace("v", r"(?s)\A---\n.*?\n---(?:\n|\z)", ""), r"\A\s+|\s+\z", "").alias("body"))
    field = lambda k: F.nullif(F.trim(F.regexp_extract("f", rf"(?m)^{k}:[ \t]*(.*)$", 1), ), F.lit(""))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.lower(field("type"))]
    name = F.regexp_extract("file", r"([^/]+)\.md$", 1)
    importance = F.expr("try_cast(nullif(trim(regexp_extract(f, '(?m)^importance:[ \\\\t]*(.*)$', 1)), '') as float)")
    base = F.lit("/notes/")
    if folders is not None:
        at = rows.select(F.regexp_replace(F.regexp_replace("file", "^file:/*", "/"), "/[^/]*$", "").alias("cwd")).distinct()
        found = project_of_folder(at, folders)
        rows = rows.withColumn("cwd", F.regexp_replace(F.regexp_replace("file", "^file:/*", "/"), "/[^/]*$", "")).join(found, "cwd", "left")
        base = F.coalesce(F.concat(F.lit("/projects/"), "project", F.lit("/")), base)
    return rows.select("file", F.concat(base, tx.slugify(name, 60, "misc")).alias("path"), F.coalesce(field("name"), field("title"), name).alias("title"), F.coalesce(kind, F.lit("note")).alias("type"), F.coalesce(importance, F.lit(0.5).cast("float")).alias("importance"), "body")


def markdown(nodes: DataFrame) -> DataFrame:
    """(path, text) of the export: frontmatter and body of live curated nodes. Paths that would leave the folder are left out."""
    safe = ~F.exists(F.slice(F.split("path", "/"), 2, 100000), lambda s: s.isin("", ".", ".."))
    rows = nodes.filter("deleted_at is null and origin = 'curated'").filter(F.col("path").startswith("/") & safe)
    text = F.concat(F.lit("---\ntitle: "), F.regexp_replace(F.coalesce("title", F.lit("")), r"[\r\n]+", " "), F.lit("\ntype: "), F.coalesce("type", F.lit("note")), F.lit("\nimportance: "), F.format_number(F.coalesce(F.col("importance").cast("double"), F.lit(0.5)), 2), F.lit("\n---\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    return rows.select("path", text.alias("text"))


def export_markdown(nodes: DataFrame, path: str) -> int:
    """A folder of files <path of the node>.md, one for each exported node; files of nodes that are no longer there are deleted. The number of files written. The folder is one that all executors share."""
    rows = materialize(markdown(nodes))

    def write(part: Iterator[Row]) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for r in part:
            name = f"{root}{r['path']}.md"
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(name) as f:
                f.write(r["text"].encode())

    def remove(part: Iterator[Row]) -> None:
        from pyarrow import fs

        for r in part:
            system, name = fs.FileSystem.from_uri(r["file"])
            system.delete_file(name)

    rows.foreachPartition(write)
    there = nodes.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "/+", "/")
    kept = rows.select(F.concat(bare(F.lit(path)), "path", F.lit(".md")).alias("_n"))
    gone = there.select(F.regexp_replace("path", "^file:/*", "file:///").alias("file"), bare(F.col("path")).alias("_n")).join(kept, "_n", "left_anti")
    gone.foreachPartition(remove)
    return rows.count()


def write_snapshot(df: DataFrame, path: str, **options: str) -> None:
    """A new snapshot; never the path that df was read from."""
    df.write.mode("overwrite").options(**options).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database, read in parallel by ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()
