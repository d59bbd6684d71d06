import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedding as M
from quillspark.sources.generations import Generations
from quillspark.streaming import ingest as I

DOC = "path string, name string, sha256 string, text string"


def chunk(docs):
    return docs.select("path", F.lit(1).alias("chunk"), "text")


def settings():
    return {"chunk": chunk, "embed": M.embed, "provider": "hash", "model": "64"}


def test_incremental(spark, tmp_path):
    store = Generations(str(tmp_path / "store"))
    one = spark.createDataFrame([("x/a.md", "a.md", "1", "alfa")], DOC)
    two = spark.createDataFrame([("x/a.md", "a.md", "1", "alfa"), ("x/b.md", "b.md", "2", "beta"), ("x/c.md", "c.md", "1", "same content")], DOC)
    first = I.add_documents(spark, store, one, **settings())
    assert I.add_documents(spark, store, one, **settings()) is None
    second = I.add_documents(spark, store, two, **settings())
    assert first != second and sorted(r.path for r in store.read(spark).collect()) == ["x/a.md", "x/b.md"] and store.read(spark, "catalog").count() == 2
    with pytest.raises(ValueError):
        I.add_documents(spark, store, spark.createDataFrame([("x/d.md", "d.md", "4", "delta")], DOC), chunk=chunk, embed=lambda d: d.withColumn("embedding", F.lit(None).cast("array<float>")), provider="hash", model="64")
    assert store.current() == second and I.Journal(str(tmp_path / "store" / "journal.jsonl")).stages()[-1] == "rolled_back"


def test_stream_commits_once(spark, tmp_path):
    inbox, store = tmp_path / "in", Generations(str(tmp_path / "store"))
    inbox.mkdir()
    for k in range(2):
        (inbox / f"{k}.json").write_text(json.dumps({"path": f"{k}.md", "name": f"{k}.md", "sha256": str(k), "text": f"t{k}"}))
        stream = spark.readStream.schema(DOC).json(str(inbox))
        I.run_incremental(stream, store, str(tmp_path / "cp"), **settings()).awaitTermination(120)
    assert store.read(spark).count() == 2
    generation = store.current()
    again = spark.createDataFrame([("9.md", "9.md", "9", "t")], DOC)
    assert I.add_documents(spark, store, again, batch=store.manifest()["batch"], **settings()) == generation


def test_stable_files(spark, tmp_path):
    polls = tmp_path / "polls"
    polls.mkdir()
    sizes = {"a.pdf": [1, 1, 1, 2, 2], "b.pdf": [1, 2, 3, 4, 4], "c.part": [1] * 5, ".h.pdf": [1] * 5, "d.pdf": [1, None, 1, 1, 1]}
    for poll in range(5):
        rows = [{"path": f"/in/{n}", "size": s[poll], "mtime": 0, "poll": poll} for n, s in sizes.items() if s[poll]]
        (polls / f"{poll}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(polls / f"{poll}.json", (1_700_000_000 + poll, 1_700_000_000 + poll))
    stream = I.stable_files(spark.readStream.schema(I.POLLS).option("maxFilesPerTrigger", 1).json(str(polls)))
    q = stream.writeStream.format("memory").queryName("stable").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted((r.path, r.poll) for r in spark.table("stable").collect()) == [("/in/a.pdf", 1), ("/in/a.pdf", 4), ("/in/b.pdf", 4), ("/in/d.pdf", 3)]
    (tmp_path / "f.pdf").write_text("x")
    assert [p["size"] for p in I.poll_folder(str(tmp_path), 7)] == [1]


def test_jobs(spark):
    log = spark.createDataFrame([("a", "queued", 1), ("b", "queued", 2), ("a", "running", 3), ("a", "succeeded", 5), ("c", "queued", 0)], "job_id string, status string, t int").select("job_id", "status", F.timestamp_seconds("t").alias("updated_at"))
    assert {r.job_id: r.status for r in I.latest_states(log).collect()} == {"a": "succeeded", "b": "queued", "c": "queued"}
    assert I.next_job(log).first().job_id == "c"
    busy = log.unionByName(spark.createDataFrame([("c", "running", 9)], "job_id string, status string, t int").select("job_id", "status", F.timestamp_seconds("t").alias("updated_at")))
    assert I.next_job(busy).count() == 0 and [r.job_id for r in I.interrupted(busy).collect()] == ["c"]


def test_worker(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("a", "queued", 1), ("b", "queued", 2), ("c", "queued", 0), ("c", "running", 3), ("d", "queued", 4)]
    spark.createDataFrame(rows, "job_id string, status string, t int").select("job_id", "status", F.timestamp_seconds("t").alias("updated_at")).write.parquet(log)
    seen = []

    def job(name):
        seen.append(name)
        if name == "b":
            raise ValueError
        return ["odd"] if name == "d" else []

    assert I.work(spark, log, job) == 3 and seen == ["a", "b", "d"]
    states = {r.job_id: r.status for r in I.latest_states(spark.read.parquet(log)).collect()}
    assert states == {"a": "succeeded", "b": "failed", "c": "failed", "d": "succeeded_with_warnings"}


def test_rebuild(spark, tmp_path):
    root, store = tmp_path / "docs" / "RES", Generations(str(tmp_path / "store"))
    root.mkdir(parents=True)
    (root / "RES-0007-2020.md").write_text("seven")
    (root / "RES-0008-2021.pdf").write_bytes(b"eight")
    documents = I.documents_of(spark, str(tmp_path / "docs"), {"pdf": lambda b: b.decode() * 20})
    types = lambda catalog: catalog.groupBy("type").agg(F.count("*").alias("n"))
    generation = I.rebuild(spark, store, documents, chunk, M.embed, types, "hash", "64")
    assert store.current() == generation and store.read(spark).count() == 2
    more = spark.createDataFrame([("x/b.md", "b.md", "2", "beta")], DOC)
    files = set(os.listdir(store.folder(generation) + "/chunks"))
    for k in range(3):
        I.add_documents(spark, store, more.withColumn("name", F.lit(f"{k}.md")).withColumn("sha256", F.lit(f"s{k}")), **settings())
    # The parts that later generations are made of stay, unwritten.
    assert store.read(spark).count() == 5 and set(os.listdir(store.folder(generation) + "/chunks")) == files
    assert len(os.listdir(store.root + "/generations")) == 4 and len(store.manifest()["documents"]) == 5
    again = I.rebuild(spark, store, documents, chunk, M.embed, types, "other", "32")
    assert store.read(spark).count() == 2 and store.read(spark, "types").count() >= 1 and store.manifest()["embedding_provider"] == "other"
    assert store.parts(again) == [again]


def test_settled(spark):
    polls = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 1, 1), ("a", 2, 1, 2), ("b", 1, 1, 0)], I.POLLS)
    assert sorted((r.path, r.poll, r.stable) for r in I.settled(polls).collect()) == [("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, False)]
