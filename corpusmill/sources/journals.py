"""Small files around a run: metric and job journals, checkpoints, scores, reports."""

from __future__ import annotations

import hashlib
import json
import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import strict_json
from corpusmill.functions.names import next_number, run_name, run_number
from corpusmill.functions.text import is_blank
from corpusmill.sources import scans

#: The kinds of a metric journal's events, and the fields that hold numbers.
EVENTS = ("execution", "training_started", "update", "validation", "training_interrupted", "training_resumed", "segment_complete", "training_complete")
NUMBERS = {"epoch": "long", "completed_updates": "long", "completed_epochs": "long", "completed_targets": "long", "target_count": "long", "example_count": "long", "effective_learning_rate": "double", "gradient_norm": "double", "pre_update_loss": "double", "mean_cross_entropy": "double", "perplexity": "double"}
SCORE = {"prompt_id", "checkpoint", "criterion", "score", "max_score", "notes"}


class Journal:
    """A new file of events, one JSON line each, flushed as it is written; numbers must be finite."""

    def __init__(self, path: str):
        self.file = open(path, "x", encoding="utf-8")  # noqa: SIM115

    def add(self, event: str, **fields) -> None:
        if event not in EVENTS:
            raise ValueError(f"unknown event {event}")
        if any(isinstance(v, float) and not math.isfinite(v) for v in fields.values()):
            raise ValueError(f"{event} has a number that isn't finite")
        self.file.write(strict_json.canonical({"schema_version": 1, "event": event, **fields}) + "\n")
        self.file.flush()

    def close(self) -> None:
        self.file.close()


def events(spark: SparkSession, path: str) -> DataFrame:
    """A journal's whole events: one row each with the fields of all kinds. A last line without its end is passed over, as are lines that are no object."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"[^\n]*\z", ""), "\n")).alias("at", "line"))
    schema = "schema_version int, event string, " + ", ".join(f"{k} {v}" for k, v in NUMBERS.items())
    return rows.where(F.col("line").startswith("{")).select("at", F.from_json("line", schema).alias("e")).where("e.event is not null").select("at", "e.*")


def checkpoints(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """(run, number, name, status) of a run's folders: complete with a manifest and a marker of its digest, incomplete without a marker, else invalid."""
    rows = []
    for p in sorted(Path(folder).iterdir()):
        if p.is_dir() and re.fullmatch(rf"{re.escape(run_name(run))}-[0-9]+", p.name, re.IGNORECASE):
            marker, manifest = p / "COMPLETE", p / "manifest.json"
            if not marker.is_file():
                status = "incomplete"
            else:
                status = "complete" if manifest.is_file() and marker.read_text().split() == [hashlib.sha256(manifest.read_bytes()).hexdigest()] else "invalid"
            rows.append((run_name(run), p.name, status))
    df = spark.createDataFrame(rows, "run string, name string, status string")
    return df.select("run", run_number(F.col("name"), run).alias("number"), "name", "status")


def save_checkpoint(folder: str, run: str, manifest: dict) -> Path:
    """A new folder with the next number of the run, its marker last."""
    path = Path(folder) / f"{run_name(run)}-{next_number([p.name for p in Path(folder).iterdir()], run)}"
    path.mkdir()
    text = strict_json.canonical(manifest, indent=1)
    (path / "manifest.json").write_text(text)
    (path / "COMPLETE").write_text(hashlib.sha256(text.encode()).hexdigest() + "\n")
    return path


def artifact(spark: SparkSession, path: str) -> dict:
    """(sha256, bytes, files) of a folder: a digest of its files' sorted names, digests and sizes, taken where they lie."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").removeprefix("file://")
    rows = rows.select(F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("path")
    listed = [r.asDict() for r in rows.collect()]  # a row for each file
    return {"sha256": hashlib.sha256(strict_json.canonical(listed).encode()).hexdigest(), "bytes": sum(r["bytes"] for r in listed), "files": len(listed)}


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Score records of a JSON file (selection_reason, rubric, records) that hold to its rubric; else an error."""
    raw = strict_json.parse(Path(path).read_bytes())
    if not str(raw.get("selection_reason", "")).strip() or not raw.get("rubric") or not raw.get("records"):
        raise ValueError("scores need a selection_reason, a rubric and records")
    seen = set()
    for r in raw["records"]:
        if set(r) != SCORE or not all(isinstance(r[k], str) and r[k].strip() for k in ("prompt_id", "checkpoint", "criterion", "notes")):
            raise ValueError(f"a score has the fields {sorted(SCORE)}, texts not blank")
        key = (r["prompt_id"], r["checkpoint"], r["criterion"])
        if key in seen or r["criterion"] not in raw["rubric"]:
            raise ValueError(f"{key} is repeated, or has no criterion of the rubric")
        seen.add(key)
        if any(type(r[k]) not in (int, float) or not math.isfinite(r[k]) for k in ("score", "max_score")) or not 0 <= r["score"] <= r["max_score"] or not r["max_score"]:
            raise ValueError(f"the score of {key} must lie between 0 and a positive max_score")
    rows = [(r["prompt_id"], r["checkpoint"], r["criterion"], float(r["score"]), float(r["max_score"]), r["notes"]) for r in raw["records"]]
    return spark.createDataFrame(rows, "prompt_id string, checkpoint string, criterion string, score double, max_score double, notes string")


def select_checkpoint(spark: SparkSession, scores_path: str, checkpoint: str, report: str) -> dict:
    """A new report on the checkpoint chosen, which must be complete and have scores."""
    found, chosen = scores(spark, scores_path), Path(checkpoint)
    if found.where(F.col("checkpoint") == chosen.name).isEmpty() or not (chosen / "COMPLETE").is_file():
        raise ValueError(f"{chosen.name} has no scores, or isn't complete")
    if Path(report).resolve().is_relative_to(chosen.resolve()):
        raise ValueError("the report must lie outside the checkpoint")
    out = {"schema_version": 1, "selected_checkpoint": chosen.name, "checkpoint": artifact(spark, checkpoint), "scores_sha256": hashlib.sha256(Path(scores_path).read_bytes()).hexdigest()}
    Path(report).mkdir()
    (Path(report) / "selection.json").write_text(strict_json.canonical(out, indent=1))
    return out


def jsonl_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text) of JSON lines below root with a string text that isn't blank; doc_id is the path and /@record-<line>."""
    rows = scans.jsonl(spark, root, ["text"]).where(~is_blank(F.col("text")))
    return rows.select(F.concat(scans.below("file", root), F.lit("/@record-"), F.col("row_no").cast("string")).alias("doc_id"), "text")


def strict_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, line) of JSON lines, of which none repeats a key or holds a number that isn't finite."""
    rows = scans.lines(spark, path).withColumn("problem", strict_json.problem(F.col("line")))
    if bad := rows.where("problem is not null").orderBy("file", "row_no").limit(3).collect():
        raise scans.SourceError("; ".join(f"{r['file']} line {r['row_no']}: {r['problem']}" for r in bad))
    return rows.drop("problem")


def export_records(records: DataFrame, folder: str) -> DataFrame:
    """(id, output): writes each record (id, stage, partition, payload) to a file of its own, named by its id's digest; for small releases on a shared folder (K6)."""
    name = F.concat_ws("/", "stage", "partition", F.concat(F.sha2("id", 256), F.when(F.col("stage") == "chat", ".jsonl").otherwise(".txt")))
    rows = records.select("id", name.alias("output"), "payload")

    def write(part) -> None:
        for r in part:
            p = Path(folder, r["output"])
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(r["payload"], encoding="utf-8")

    rows.foreachPartition(write)
    return rows.drop("payload")


def stage_report(folder: str, manifest: dict) -> None:
    """The manifest of a reviewed stage, and after it a marker with its digest."""
    text = strict_json.canonical(manifest, indent=2) + "\n"
    for name, content in (("manifest.json", text), ("COMPLETE", json.dumps({"schema_version": 1, "manifest_sha256": hashlib.sha256(text.encode()).hexdigest()}) + "\n")):
        with open(Path(folder) / name, "x", encoding="utf-8") as f:
            f.write(content)
