"""Files and stored catalogues: collecting, reading by kind, writing, caching."""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.columns import qcol
from gristmill.operators.joins import anti_join
from gristmill.session import stored
from gristmill.sources import workbook

WORKBOOKS, TEXTS, TABLES = (".xlsx", ".xlsm"), (".txt", ".md"), (".parquet", ".csv", ".json", ".orc")
REPORT_ROWS = 1000


def collect_paths(items: Iterable[str], kinds: Sequence[str] = (*WORKBOOKS, *TEXTS, *TABLES)) -> list[str]:
    """Files of the given kinds among files, folders (searched through) and patterns; each once,
    lock files left out. Paths with a scheme go through as they are."""
    found: dict[str, None] = {}
    for item in items:
        if "://" in item:
            found[item] = None
            continue
        paths = glob.glob(os.path.join(item, "**", "*"), recursive=True) if os.path.isdir(item) else glob.glob(item, recursive=True)
        for path in sorted(paths):
            if path.lower().endswith(tuple(kinds)) and not os.path.basename(path).startswith("~$"):
                found[os.path.abspath(path)] = None
    return list(found)


def read_file(spark: SparkSession, path: str, split: bool = False) -> dict[str, DataFrame]:
    """The tables of a file by its ending; ValueError for kinds that are not read."""
    name, low = path.rstrip("/").rsplit("/", 1)[-1], path.lower()
    if low.endswith(WORKBOOKS):
        return workbook.tables_of(stored(workbook.read_grids(spark, path)), split)
    if low.endswith(".csv"):
        return {name: workbook.typed(spark.read.csv(path, header=True))}
    if low.endswith((".parquet", ".json", ".orc")):
        return {name: spark.read.format(low.rsplit(".", 1)[-1]).load(path)}
    if low.endswith(TEXTS):
        return {name: read_texts(spark, [path])}
    raise ValueError(f"{name} is of no kind that is read")


def read_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(source, location, text)`` of text files, each whole, under its name; one scan for all of them."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(list(paths), wholetext=True).select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source"), F.lit("1").alias("location"), F.col("value").alias("text"))


def encode_name(name: str) -> str:
    """Marks in names that paths do not take, as hexadecimal codes."""
    return re.sub(r"[^\w.-]", lambda m: f"%{ord(m[0]):x}%", name)


def decode_name(folder: str) -> str:
    return re.sub(r"%([0-9a-f]+)%", lambda m: chr(int(m[1], 16)), folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a store without versions, one in each folder; a folder that is not there has none."""
    if not exists(spark, folder):
        return {}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return {decode_name(n): spark.read.parquet(f"{folder}/{n}") for n in names}


def save_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, or as a workbook for ``.xlsx``."""
    if path.lower().endswith(".xlsx"):
        workbook.write_workbook(df, path)
    else:
        df.write.mode("overwrite").csv(path, header=True)


def report_payload(df: DataFrame, rows: int = REPORT_ROWS) -> dict:
    """Columns and the first rows, ready for JSON: missing values null, everything else plain."""
    found = df.limit(rows + 1).collect()
    safe = lambda v: None if v is None or v != v or v in (float("inf"), float("-inf")) else v if isinstance(v, (str, int, float, bool)) else str(v)
    return {"columns": df.columns, "rows": [[safe(v) for v in r] for r in found[:rows]], "truncated": len(found) > rows}


def cache_key(model: str, text: Column) -> Column:
    return F.sha1(F.concat_ws("\0", F.lit(model), text).cast("binary"))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct ``(key, text)`` that a cache of embeddings (column ``key``) lacks."""
    wanted = texts.select(cache_key(model, qcol(text)).alias("key"), qcol(text).alias("text")).dropDuplicates(["key"])
    return anti_join(wanted, cache, "key", "key")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file with ``#`` comments: q, expect, expect_table, expect_num."""
    lines = spark.read.text(path).where(~F.startswith(F.ltrim("value"), F.lit("#")) & (F.trim("value") != ""))
    return lines.select(F.from_json("value", "q string, expect array<string>, expect_table string, expect_num double").alias("j")).select("j.*")


class Audit:
    """Questions and what became of them, a line of JSON each, one file a month."""

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, at: datetime | None = None) -> str:
        return os.path.join(self.folder, f"audit-{(at or datetime.now(UTC)):%Y-%m}.jsonl")

    def log(self, question: str, kind: str, seconds: float, tables: Sequence[str] = (), **more: object) -> None:
        os.makedirs(self.folder, exist_ok=True)
        line = {"at": datetime.now(UTC).isoformat(timespec="seconds"), "question": question, "kind": kind, "seconds": round(seconds, 3), "tables": list(tables), **more}
        with open(self.path(), "a", encoding="utf-8") as file:
            file.write(json.dumps(line, ensure_ascii=False, default=str) + "\n")

    def recent(self, n: int = 50) -> list[dict]:
        """The last n entries, the newest first; damaged lines are passed over."""
        out: list[dict] = []
        for path in sorted(glob.glob(os.path.join(self.folder, "audit-*.jsonl")), reverse=True):
            with open(path, encoding="utf-8") as file:
                for line in reversed(file.readlines()):
                    try:
                        out.append(json.loads(line))
                    except ValueError:
                        continue
                    if len(out) == n:
                        return out
        return out


def read_scores(path: str) -> dict:
    """The scores of a JSON file; none if it is missing or damaged."""
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file)
    except (OSError, ValueError):
        return {}


def record_score(path: str, kind: str, payload: dict) -> dict:
    """Merge a score into a JSON file and return the whole."""
    board = read_scores(path)
    board[kind] = {**payload, "at": datetime.now(UTC).isoformat(timespec="seconds")}
    with open(path, "w", encoding="utf-8") as file:
        json.dump(board, file, ensure_ascii=False, indent=1)
    return board


class HouseRules:
    """A text file of rules, one a line; read again when it changes, to ``most`` characters."""

    def __init__(self, path: str, most: int = 6000):
        self.path, self.most = path, most
        self.seen: tuple[float, list[str]] = (-1.0, [])

    def rules(self) -> list[str]:
        try:
            changed = os.path.getmtime(self.path)
            if changed != self.seen[0]:
                with open(self.path, encoding="utf-8") as file:
                    lines = [line.strip() for line in file.read()[: self.most].splitlines()]
                self.seen = (changed, [x for x in lines if x and not x.startswith("#")])
        except OSError:
            self.seen = (-1.0, [])
        return self.seen[1]
