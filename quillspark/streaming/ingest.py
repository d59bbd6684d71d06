"""Files that arrive, their jobs, and incremental commits, on Structured Streaming."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quillspark.operators.catalog import file_entry
from quillspark.sources.files import convert, markdown_files, pending_conversions
from quillspark.sources.generations import Generations, manifest_documents, writer_lock

POLLS = "path string, size long, mtime long, poll long"
STATES = "job_id string, status string, updated_at timestamp"
STATUSES = ("queued", "running", "succeeded", "succeeded_with_warnings", "failed")


def wanted(path: Column) -> Column:
    """PDF files that are neither hidden nor half-written."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.rlike(r"\.pdf$") & ~F.startswith(name, F.lit(".")) & ~F.contains(name, F.lit(".part"))


def _settled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits a file once, when two polls in a row saw the same size and time; a file that missed a poll starts again."""
    seen = pd.concat(list(frames)).sort_values("poll")
    size, mtime, poll, told = state.get if state.exists else (-1, -1, -2, False)
    out = []
    for row in seen.itertuples():
        same = (row.size, row.mtime) == (size, mtime) and row.poll == poll + 1
        if not same:
            told = False
        if same and not told:
            told = True
            out.append((key[0], row.size, row.mtime, row.poll))
        size, mtime, poll = int(row.size), int(row.mtime), int(row.poll)
    state.update((size, mtime, poll, told))
    yield pd.DataFrame(out, columns=["path", "size", "mtime", "poll"])


def stable_files(polls: DataFrame) -> DataFrame:
    """Stream of files that stopped changing, from a stream of polls (path, size, mtime, poll number)."""
    rows = polls.where(wanted(F.col("path")))
    return rows.groupBy("path").applyInPandasWithState(_settled, POLLS, "size long, mtime long, poll long, told boolean", "append", "NoTimeout")


def settled(polls: DataFrame) -> DataFrame:
    """Adds `stable` to a table of polls (path, size, mtime, poll): size and mtime are those of the poll before."""
    before = Window.partitionBy("path").orderBy("poll")
    same = (F.col("size") == F.lag("size").over(before)) & (F.col("mtime") == F.lag("mtime").over(before))
    return polls.withColumn("stable", F.coalesce(same, F.lit(False)))


def poll_folder(folder: str, poll: int) -> list[dict]:
    """What one look at the inbox sees."""
    out = []
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if entry.is_file():
            s = entry.stat()
            out.append({"path": entry.path, "size": s.st_size, "mtime": s.st_mtime_ns, "poll": poll})
    return out


def not_indexed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name, sha256) that the manifest knows neither by name, nor by the name of their markdown, nor by content."""
    names = manifest.select(F.lower("name").alias("k"))
    rows = files.join(names, F.lower("name") == F.col("k"), "left_anti")
    rows = rows.join(names, F.regexp_replace(F.lower("name"), r"\.[^.]*$", ".md") == F.col("k"), "left_anti")
    return rows.join(manifest.where("sha256 != ''").select("sha256"), "sha256", "left_anti")


# Jobs


def latest_states(log: DataFrame) -> DataFrame:
    """(job_id, status, updated_at, created_at) of each job from its append-only log."""
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"), F.min("updated_at").alias("created_at"))


def next_job(log: DataFrame) -> DataFrame:
    """The oldest queued job, unless one is running."""
    states = latest_states(log)
    busy = states.agg(F.coalesce(F.max(F.col("status") == "running"), F.lit(False)).alias("busy"))
    return states.where("status = 'queued'").crossJoin(F.broadcast(busy)).where("not busy").orderBy("created_at", "job_id").limit(1).drop("busy")


def interrupted(log: DataFrame) -> DataFrame:
    """Log rows that fail whatever was running when the service stopped."""
    return latest_states(log).where("status = 'running'").select("job_id", F.lit("failed").alias("status"), (F.col("updated_at") + F.expr("interval 1 second")).alias("updated_at"))


def work(spark: SparkSession, log: str, job: Callable[[str], list[str]], now: Callable[[], datetime.datetime] = datetime.datetime.now) -> int:
    """Runs queued jobs one after the other until none is left; returns how many ran. `log` is the append-only table of states.

    Jobs that were running when the last worker stopped fail first. A job returns its warnings; one that raises has failed.
    """

    def tell(rows: DataFrame) -> None:
        rows.select(F.col("job_id").cast("string"), "status", F.col("updated_at").cast("timestamp")).write.mode("append").parquet(log)

    read = lambda: spark.read.parquet(log)
    tell(interrupted(read()))
    ran = 0
    while (row := next_job(read()).first()) is not None:
        # Each state is later than the one before, whatever the clock says.
        started = max(now(), row.updated_at + datetime.timedelta(microseconds=1))
        tell(spark.createDataFrame([(row.job_id, "running", started)], STATES))
        try:
            outcome = "succeeded_with_warnings" if job(row.job_id) else "succeeded"
        except Exception:  # the state tells; other jobs go on
            outcome = "failed"
        tell(spark.createDataFrame([(row.job_id, outcome, max(now(), started + datetime.timedelta(microseconds=1)))], STATES))
        ran += 1
    return ran


# Incremental index


class Journal:
    """Stages of a commit, appended to one file."""

    def __init__(self, path: str):
        self.path = path

    def add(self, stage: str, **what) -> None:
        with open(self.path, "a") as f:
            f.write(json.dumps({"stage": stage} | what) + "\n")

    def stages(self) -> list[str]:
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return [json.loads(x)["stage"] for x in f]


def add_documents(spark: SparkSession, store: Generations, documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], provider: str, model: str, batch: int | None = None) -> str | None:
    """One incremental commit: new documents are chunked, embedded and written; what the index holds already is neither read nor
    written again.

    documents: path, name, sha256, text and catalog columns. Returns the generation, or None if nothing is new.
    """
    journal = Journal(os.path.join(store.root, "journal.jsonl"))
    with writer_lock(store.root):
        if batch is not None and store.manifest().get("batch") == batch:
            return store.current()
        store.check_model(provider, model)
        known = spark.createDataFrame([(d["name"], d["sha256"]) for d in store.manifest()["documents"]], "name string, sha256 string")
        new = not_indexed(documents, known).dropDuplicates(["name"]).persist()
        try:
            if new.isEmpty():
                return None
            journal.add("files_promoted", n=new.count())
            added, catalog = embed(chunk(new)), new.drop("text")
            if added.where("embedding is null").limit(1).count():
                raise ValueError("chunks without vector")
            journal.add("candidate_validated")
            documents = store.manifest()["documents"] + manifest_documents(catalog, sha="sha256")
            generation = store.commit({"chunks": added, "catalog": catalog}, provider, model, documents, batch, onto=store.current())
            journal.add("committed", generation=generation)
            return generation
        except BaseException:
            journal.add("rolled_back")
            raise
        finally:
            new.unpersist()


def rebuild(spark: SparkSession, store: Generations, documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], types: Callable[[DataFrame], DataFrame], provider: str, model: str) -> str:
    """A whole new generation of every document, with the catalog and the types derived from it; readers keep the old one until it is
    complete. It also puts the parts of incremental commits together again, and is the way to another embedding model.

    documents: path, name, sha256, text and catalog columns, as `documents_of` gives them.
    """
    journal = Journal(os.path.join(store.root, "journal.jsonl"))
    with writer_lock(store.root):
        try:
            # Converted and read once for the three tables.
            documents = documents.dropDuplicates(["name"]).persist()
            catalog, chunks = documents.drop("text"), embed(chunk(documents))
            generation = store.commit({"chunks": chunks, "catalog": catalog, "types": types(catalog)}, provider, model, manifest_documents(catalog, sha="sha256"))
            journal.add("committed", generation=generation)
            return generation
        except BaseException:
            journal.add("rolled_back")
            raise
        finally:
            documents.unpersist()


def documents_of(spark: SparkSession, root: str, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, name, sha256, text, title, type, number, year) of every markdown file below a folder and of the PDFs that have none."""
    ready = markdown_files(spark, root).select("path", "text")
    paths = pending_conversions(spark, root)
    pdfs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).join(paths, "path", "left_semi")
    made = convert(pdfs.select("path", "content"), converters).where("markdown is not null").select("path", F.col("markdown").alias("text"))
    rows = ready.unionByName(made).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("sha256", F.sha2("text", 256))
    entry = file_entry(F.col("path"), F.col("text"), F.create_map().cast("map<string,string>"), F.array().cast("array<string>"))
    return rows.withColumn("e", entry).select("path", "name", "sha256", "text", "e.*")


def run_incremental(stream: DataFrame, store: Generations, checkpoint: str, **settings):
    """Adds each micro-batch of documents; a batch that is replayed after a crash commits nothing twice."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        add_documents(batch.sparkSession, store, batch, batch=batch_id, **settings)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
