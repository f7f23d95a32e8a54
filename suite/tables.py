"""The driver's tables in the shape of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators.messages import with_search_columns
from turnstone.sources.transcripts import line_pos, raw_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute_stamp(number: str) -> str:
    """SQL: ISO text of a number of minutes into 2024."""
    return (
        "date_format(timestamp_ntz'2024-01-01 00:00:00' "
        f"+ make_dt_interval(0, 0, cast({number} as int), 0), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    )


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: project = source, session = source and language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("uuid"),
        F.concat_ws("/", "source", "lang").alias("session_id"),
        F.lit(None).cast("string").alias("parent_uuid"),
        F.expr(minute_stamp("doc_id")).alias("timestamp"),
        F.lit("user").alias("role"),
        F.col("text").alias("content"),
        F.col("source").alias("project_slug"),
        F.col("lang").alias("engineer_id"),
    )


def doc_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .withColumn("timestamp", F.expr(minute_stamp("doc_id")))
        .groupBy("source", "lang")
        .agg(
            F.min("timestamp").alias("started_at"),
            F.max("timestamp").alias("ended_at"),
            F.count("*").alias("turn_count"),
        )
        .select(
            F.concat_ws("/", "source", "lang").alias("session_id"),
            F.col("source").alias("project_slug"),
            "started_at",
            "ended_at",
            "turn_count",
            F.col("lang").alias("git_branch"),
            F.col("lang").alias("engineer_id"),
        )
    )


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_search_columns(doc_messages(spark, sf_dir))


_TOOL = "concat('Tool', cast(turn % 3 as string))"


def transcript_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines ``(project_slug, transcript, conv_id, turn, value)``.

    System turns become metadata lines, user turns plain strings, assistant turns block arrays.
    """
    talk = table(spark, sf_dir, "conversations")
    blocks = f"""array(
        named_struct('type', 'thinking', 'thinking', 'let me see', 'text', null, 'name', null),
        named_struct('type', 'text', 'thinking', null, 'text', text, 'name', null),
        named_struct('type', 'tool_use', 'thinking', null, 'text', null, 'name', {_TOOL}))"""

    def line(content: str) -> str:
        return f"""to_json(named_struct(
            'type', role,
            'uuid', concat('c', conv_id, '-', turn),
            'parentUuid', if(turn > 0, concat('c', conv_id, '-', turn - 1), null),
            'timestamp', {minute_stamp("conv_id * 20 + turn")},
            'sessionId', concat('c', conv_id),
            'gitBranch', if(turn > 0, concat('b', conv_id % 3), null),
            'cwd', concat('/work/p', conv_id % 4),
            'message', named_struct('role', role, 'content', {content})))"""

    return talk.select(
        F.expr("concat('p', conv_id % 4)").alias("project_slug"),
        F.expr("concat('c', conv_id)").alias("transcript"),
        "conv_id",
        "turn",
        F.expr(f"if(role = 'assistant', {line(blocks)}, {line('text')})").alias("value"),
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a scan of transcript files would give them."""
    path = F.concat(F.lit("/"), "project_slug", F.lit("/"), "transcript", F.lit(".jsonl"))
    lines = transcript_json(spark, sf_dir).select(
        path.alias("file_path"), line_pos(row=F.col("turn")).alias("pos"), "value"
    )
    return raw_lines(lines)


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of which most lack something: by (conv_id + turn) % 8, a number or nothing as id, a text
    as message, no role, an unknown role with a number as parent, a blank text, a metadata type; 0 is sound."""
    case = "(conv_id + turn) % 8"

    def line(typ="role", uuid="concat('c', conv_id, '-', turn)", parent="if(turn > 0, concat('c', conv_id, '-', turn - 1), null)",
             message="named_struct('role', role, 'content', text)"):
        return f"to_json(named_struct('type', {typ}, 'uuid', {uuid}, 'parentUuid', {parent}, 'message', {message}))"

    kinds = [
        line(), line(uuid="turn"), line(uuid="cast(null as string)"), line(message="text"), line(message="named_struct('content', text)"),
        line(parent="turn", message="named_struct('role', 'tool', 'content', text)"),
        line(message="named_struct('role', role, 'content', ' \\n\\t ')"), line(typ="'summary'", message="named_struct('role', 'user', 'content', text)"),
    ]
    value = "case " + " ".join(f"when {case} = {k} then {x}" for k, x in enumerate(kinds)) + " end"
    lines = table(spark, sf_dir, "conversations").select(
        F.expr("concat('/p', conv_id % 4, '/c', conv_id, '.jsonl')").alias("file_path"), line_pos(row=F.col("turn")).alias("pos"), F.expr(value).alias("value")
    )
    return raw_lines(lines)


def land_transcripts(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the lines as ``<project>/<session>.jsonl``, as the recorder of the conversations leaves them.

    Where the folder is on a disk that the tasks share, they write the files as the recorder does: Spark's writer starts
    processes for each local file and leaves a folder for each. Elsewhere Spark writes them and the driver renames.
    """
    lines = (
        transcript_json(spark, sf_dir)
        .repartition("project_slug", "transcript")
        .sortWithinPartitions("project_slug", "transcript", "turn")
        .select("project_slug", "transcript", "value")
    )
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop(path))
    if files.getUri().getScheme() == "file":
        lines.foreachPartition(_recorder(hadoop(path).toUri().getPath()))
        return
    aside = f"{path}-parts"
    lines.write.partitionBy("project_slug", "transcript").text(aside)
    for part in files.globStatus(hadoop(f"{aside}/project_slug=*/transcript=*/part-*")):
        session, project = part.getPath().getParent(), part.getPath().getParent().getParent()
        slug, name = (x.getName().split("=", 1)[1] for x in (project, session))
        files.mkdirs(hadoop(f"{path}/{slug}"))
        files.rename(part.getPath(), hadoop(f"{path}/{slug}/{name}.jsonl"))


def _recorder(root: str):
    """Writes rows sorted by project and transcript, a file for each; a task that runs again replaces its files."""

    def record(rows) -> None:
        import os
        import uuid
        from itertools import groupby

        for (slug, name), said in groupby(rows, key=lambda r: (r.project_slug, r.transcript)):
            os.makedirs(f"{root}/{slug}", exist_ok=True)
            aside = f"{root}/{slug}/.{uuid.uuid4().hex}"
            with open(aside, "w", encoding="utf-8", newline="") as file:
                file.writelines(f"{r.value}\n" for r in said)
            os.replace(aside, f"{root}/{slug}/{name}.jsonl")

    return record


_EVENT_TIME = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool uses: engineer = user, session = user and day."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("concat('u', user_id)").alias("engineer_id"),
        F.expr("concat('p', user_id % 5)").alias("project_slug"),
        F.expr("concat('u', user_id, '-', date_format(ts, 'yyyyMMdd'))").alias("session_id"),
        F.expr("if(user_id % 7 = 0, null, concat('b', user_id % 3))").alias("git_branch"),
        F.expr("concat('/work/p', user_id % 5)").alias("cwd"),
        F.expr(_EVENT_TIME).alias("timestamp"),
        F.col("event_type").alias("tool"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parsed lines, for the operators that start from those."""
    return event_rows(spark, sf_dir).select(
        "project_slug",
        F.col("session_id").alias("transcript"),
        line_pos(row=F.col("event_id")).alias("pos"),
        "timestamp",
        F.lit(None).cast("string").alias("raw_session"),
        "git_branch",
        "cwd",
        F.lit(True).alias("is_turn"),
        F.array("tool").alias("tools"),
        "engineer_id",
    )


def event_sessions(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """One row per engineer and day (and per ``by``)."""
    return (
        event_rows(spark, sf_dir)
        .withColumn("batch_id", F.col("event_id") % 2)
        .groupBy("session_id", "project_slug", "engineer_id", "git_branch", "cwd", *by)
        .agg(
            F.min("timestamp").alias("started_at"),
            F.max("timestamp").alias("ended_at"),
            F.count("*").alias("turn_count"),
        )
    )




def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as notes: the path of the url is the file name, the text starts with its title."""
    breaks = F.regexp_replace("html", "</(p|h1|div|title|li)>", "\n\n")
    body = F.regexp_replace(breaks, "<[^>]*>", "")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        F.expr("concat('notes/', url)").alias("rel_path"),
        F.expr("element_at(array('lessons', 'runbooks', 'decisions'), cast(page_id % 3 as int) + 1)").alias("category"),
        F.regexp_replace("url", "[^a-z0-9]+", "-").alias("stem"),
        F.concat(F.lit("# "), title, F.lit("\n\n"), body).alias("content"),
        "page_id",
    )
