"""Sources and sinks: JSON lines, CSV, nested JSON, TOML settings, vectors, manifests, documents and reports.

Schemas are given, never inferred.
"""

from __future__ import annotations

import io
import json
import tomllib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "id STRING, year INT, number INT, section STRING, marks INT, type STRING, stem STRING, options MAP<STRING, STRING>, status STRING, review_reasons ARRAY<STRING>"
PREDICTION = "id STRING, method STRING, prompt_version STRING, primary STRING, secondary ARRAY<STRING>, ranking ARRAY<STRUCT<item STRING, score DOUBLE>>, usage STRUCT<prompt_tokens BIGINT, completion_tokens BIGINT, seconds DOUBLE, batch_size INT>"
TAXONOMY = "papers MAP<STRING, STRUCT<title STRING, sections ARRAY<STRUCT<id STRING, number INT, title STRING, official_text STRING, items ARRAY<STRUCT<id STRING, label STRING, cluster STRING, official_text STRING, note STRING>>>>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, key: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. With ``key`` the last line of each key counts."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key is None:
        return rows
    from tagmill.operators.ordering import latest

    # a line's place: its file, where the task's part of the file begins, and the line's number in the task, which has the
    # partition's number in its upper bits; of two lines of one part the partition is the same
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    return latest(rows.select("*", place.alias("__at")), [key], "__at").drop("__at").select(*rows.columns)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Cached predictions of one prompt version."""
    return read_jsonl(spark, path, PREDICTION, "id").filter(F.col("prompt_version") == version)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Reference tags: id, primary, secondary array, fit, confidence, rationale."""
    raw = spark.read.schema("id STRING, primary STRING, secondary STRING, fit STRING, confidence STRING, rationale STRING").csv(path, header=True, multiLine=True, escape='"')
    parts = F.filter(F.transform(F.split(F.coalesce("secondary", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select("id", F.trim("primary").alias("primary"), parts.alias("secondary"), F.trim("fit").alias("fit"), F.trim("confidence").alias("confidence"), F.trim("rationale").alias("rationale"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A nested taxonomy document flattened to items."""
    whole = spark.read.schema(TAXONOMY).json(path, multiLine=True)
    sections = whole.select(F.explode("papers").alias("part", "paper")).select("part", F.explode("paper.sections").alias("s"))
    rows = sections.select("part", F.col("s.id").alias("section_id"), F.col("s.title").alias("section_title"), F.explode("s.items").alias("i"))
    return rows.select("part", "section_id", "section_title", F.col("i.id").alias("item_id"), F.col("i.label").alias("label"), F.col("i.cluster").alias("cluster"), F.concat("section_id", F.lit(":"), "i.cluster").alias("unit_id"), F.col("i.official_text").alias("official_text"), F.coalesce("i.note", F.lit("")).alias("note"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Unit settings from TOML: unit_id, hours, prereqs. A small local file of the caller."""
    units = tomllib.loads(Path(path).read_text(encoding="utf-8"))["units"]
    return spark.createDataFrame([(k, float(v["hours"]), list(v.get("prereqs", []))) for k, v in units.items()], "unit_id STRING, hours DOUBLE, prereqs ARRAY<STRING>")


def read_profile(path: str) -> dict:
    """A planner profile from TOML, with defaults; impossible ones are errors."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    profile = {"name": Path(path).stem, "study_days_per_week": 6, "final_weeks": 4, "ratings": {}, "progress": [], "mocks": []} | data
    if profile["exam_date"] <= profile["start_date"]:
        raise ValueError("exam_date must be after start_date")
    if not 0 < profile["hours_per_day"] <= 16:
        raise ValueError("hours_per_day must be above 0 and at most 16")
    if not 1 <= profile["study_days_per_week"] <= 7:
        raise ValueError("study_days_per_week must be from 1 to 7")
    return profile


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of .npy files: file, row, vector. Files are read where the tasks run."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"file": file, "row": np.arange(len(matrix)), "vector": [x.astype("float32") for x in matrix]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file STRING, row BIGINT, vector ARRAY<FLOAT>")


def write_npy(rows: DataFrame, path: str, id_: str = "id", vector: str = "vector") -> int:
    """Vectors in order of their ids as one .npy file of 32-bit numbers, and the ids beside it (path + ``.ids.json``).

    One file is one machine's matter, so rows are streamed through the driver; returns how many there were.
    """
    ids, vectors = [], []
    for r in rows.select(id_, vector).orderBy(id_).toLocalIterator():
        ids.append(r[0])
        vectors.append(np.asarray(r[1], np.float32))
    np.save(path, np.stack(vectors) if vectors else np.empty((0, 0), np.float32), allow_pickle=False)
    Path(f"{path}.ids.json").write_text(json.dumps(ids), encoding="utf-8")
    return len(ids)


def read_documents(spark: SparkSession, path: str, signature: bytes = b"%PDF") -> DataFrame:
    """Raw files with checksum and whether they begin as they should."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (F.substring("content", 1, len(signature)) == F.lit(bytearray(signature))).alias("valid"), "content")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by semicolons."""
    flat = [F.concat_ws(";", F.transform(c, lambda x: x.cast("string"))).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines, in order over the files as well if columns are named."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select("name", "sha256", "bytes").orderBy("name").write.mode("overwrite").json(path)


def document(**parts: DataFrame) -> str:
    """One JSON document of small frames: a list of rows under each name."""
    return json.dumps({name: [json.loads(x) for x in frame.toJSON().collect()] for name, frame in parts.items()}, ensure_ascii=False)


def markdown_table(rows: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A small frame as a Markdown table: numbers short, shares as they are, nulls empty."""
    columns = list(columns or rows.columns)

    def cell(v: object) -> str:
        return "" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()])


#: Kinds of a plan's rows as its report calls them, in the order of a week.
PLAN_KINDS = {"learn": "Learn", "revise": "Revise", "mock": "Mock exam", "target": "Weak spots", "finish": "Finished, practise with"}


def write_plan(plan: DataFrame, calendar: DataFrame, folder: str, labels: dict[str, str] | None = None) -> tuple[str, str]:
    """One profile's plan as ``plan.md`` and ``plan.json``; returns both paths. labels: names of units."""
    name = (labels or {}).get
    weeks = [r.asDict() for r in calendar.select("week", "week_start", "week_end", "phase", "capacity").orderBy("week").collect()]
    blocks: dict[int, list[dict]] = {}
    for r in plan.select("week", "kind", "unit_id", "plan_hours", "practice").orderBy("week", "kind", "unit_id").collect():
        blocks.setdefault(r["week"], []).append(r.asDict())
    text = ["# Weekly plan", ""]
    for w in weeks:
        own = blocks.get(w["week"], [])
        hours = sum(b["plan_hours"] for b in own)
        text += [f"## Week {w['week'] + 1}: {w['week_start']} to {w['week_end']} ({w['phase']}, {hours:g} of {w['capacity']:g} h)", ""]
        for kind, title in PLAN_KINDS.items():
            of_kind = [b for b in own if b["kind"] == kind]
            if of_kind:
                text.append(f"- {title}: " + "; ".join(f"{name(b['unit_id'], b['unit_id'])} " + (b["practice"] or "nothing" if kind == "finish" else f"{b['plan_hours']:g} h") for b in of_kind))
        text.append("")
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    (root / "plan.md").write_text("\n".join(text), encoding="utf-8")
    data = [{**{k: str(v) if k.startswith("week_") else v for k, v in w.items()}, "blocks": [{k: v for k, v in b.items() if k != "week"} for b in blocks.get(w["week"], [])]} for w in weeks]
    (root / "plan.json").write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(root / "plan.md"), str(root / "plan.json")


def report(title: str, sections: dict[str, tuple[str, DataFrame]]) -> str:
    """A Markdown report: heading -> (what the table shows, a small frame)."""
    parts = [f"# {title}"]
    for heading, (text, frame) in sections.items():
        parts += [f"## {heading}", text, markdown_table(frame)]
    return "\n\n".join(parts) + "\n"
