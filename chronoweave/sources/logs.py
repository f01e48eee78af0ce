"""Logs and files of runs: CSV and JSON lines that grow by appending, a fan-out over them, run folders, rule cards, splits, artifacts and bundles.

These are small driver-side files of one run.  Tables go through DataFrame
writers: ``append_rows`` adds a DataFrame to a folder of JSON lines or CSV in
parallel, and ``write_split_tables`` writes folds as tables.
"""

from __future__ import annotations

import contextlib
import csv
import json
import os
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def stamp() -> str:
    """A name for a folder, by the second."""
    return datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")


def run_folder(base: str, name: str | None = None) -> str:
    """A new folder below base; names that are taken get a number."""
    first = Path(base) / "-".join(x for x in (stamp(), name) if x)
    folder, k = first, 0
    while True:
        try:
            folder.mkdir(parents=True)
            return str(folder)
        except FileExistsError:
            k += 1
            folder = first.with_name(f"{first.name}-{k}")


def save_json(path: str, value: object) -> None:
    """Indented, with sorted keys; whole or not at all."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, sort_keys=True, ensure_ascii=False, default=str)
        out.write("\n")
    os.replace(part, path)


def load_json(path: str) -> object:
    with open(path, encoding="utf-8") as lines:
        return json.load(lines)


def artifact_line(value: Mapping) -> str:
    """An artifact as one line with sorted keys."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def write_artifact(folder: str, value: Mapping, name: str = "metrics.jsonl") -> str:
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(artifact_line(value) + "\n", encoding="utf-8")
    return str(path)


def first_record(path: str) -> dict:
    """The first line of a file that isn't blank, which must be a JSON object."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as lines:
        line = next((x for x in lines if x.strip()), None)
    if line is None:
        raise ValueError(f"{path} has no record")
    try:
        record = json.loads(line)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} doesn't begin with JSON") from e
    if not isinstance(record, dict):
        raise ValueError(f"{path} doesn't begin with an object")
    return record


class _Appended:
    """A file opened for appending with its first record."""

    def __init__(self, path: str) -> None:
        self.path, self._out = Path(path), None
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def out(self):
        if self._out is None:
            self._out = self.path.open("a", newline="", encoding="utf-8")
        return self._out

    def flush(self) -> None:
        if self._out:
            self._out.flush()

    def close(self) -> None:
        if self._out:
            self._out.close()
            self._out = None

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


class CsvLog(_Appended):
    """Rows under one header, written with the first row of a new file.

    Without given columns, those of the first row in order of their names.  Keys
    that are no columns are an error unless ``extra`` lets them pass unwritten;
    missing ones are empty.
    """

    def __init__(self, path: str, columns: Sequence[str] | None = None, header: bool = True, extra: bool = False) -> None:
        super().__init__(path)
        self.columns, self.extra = list(columns) if columns else None, extra
        self.header_due = header and not (self.path.exists() and self.path.stat().st_size)

    def row(self, values: Mapping) -> None:
        if self.columns is None:
            self.columns = sorted(values)
        if not self.extra and (more := sorted(set(values) - set(self.columns))):
            raise ValueError(f"not columns of this log: {', '.join(more)}")
        writer = csv.writer(self.out(), lineterminator="\r\n")
        if self.header_due:
            writer.writerow(self.columns)
            self.header_due = False
        writer.writerow([values.get(c, "") for c in self.columns])

    def rows(self, many: Iterable[Mapping]) -> None:
        for values in many:
            self.row(values)


class JsonLog(_Appended):
    """A JSON object a line; ``stamped`` ones get the time as ``ts`` unless they have one."""

    def __init__(self, path: str, stamped: bool = False) -> None:
        super().__init__(path)
        self.stamped = stamped

    def log(self, record: Mapping) -> None:
        more = {"ts": utc_now()} if self.stamped and "ts" not in record else {}
        self.out().write(json.dumps({**record, **more}, ensure_ascii=False, default=str) + "\n")


class NoBoard:
    """Where scalars and histograms go when there is no backend for them: nowhere."""

    def scalar(self, tag: str, value: float, step: int) -> None: ...

    def scalars(self, tag: str, values: Mapping[str, float], step: int) -> None: ...

    def histogram(self, tag: str, values: Sequence[float], step: int) -> None: ...

    def flush(self) -> None: ...

    def close(self) -> None: ...


class RunLog:
    """One call to all logs of a run: a row of metrics to CSV, JSON lines and the board's scalars."""

    def __init__(self, csv_log: CsvLog | None = None, json_log: JsonLog | None = None, board: object | None = None) -> None:
        self.csv, self.json, self.board = csv_log, json_log, board or NoBoard()

    def metrics(self, step: int, values: Mapping[str, float], prefix: str = "") -> None:
        row = {"step": step, **values}
        if self.csv:
            self.csv.row(row)
        if self.json:
            self.json.log(row)
        for name, value in values.items():
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                self.board.scalar(f"{prefix}{name}", float(value), step)

    def batch(self, frame: DataFrame, step: int) -> None:
        """For foreachBatch: a micro-batch of (metric, value) as one row."""
        self.metrics(step, {r["metric"]: r["value"] for r in frame.select("metric", "value").orderBy("metric").collect()})

    def flush(self) -> None:
        for log in (self.csv, self.json, self.board):
            if log:
                log.flush()

    def close(self) -> None:
        for log in (self.csv, self.json, self.board):
            if log:
                log.close()


def append_rows(frame: DataFrame, folder: str, form: str = "json") -> None:
    """Add a table to a folder of JSON lines or CSV, in parallel; CSV files each begin with the header."""
    writer = frame.write.mode("append")
    writer.option("header", True).csv(folder) if form == "csv" else writer.json(folder)


def card_records(cards: DataFrame, ts: str | None = None) -> DataFrame:
    """Rule cards in the form of their log: one JSON object a line."""
    return cards.select(
        F.lit(ts or utc_now()).alias("ts"), "label", "rule_id", F.col("kind").alias("type"), F.size("edges").alias("support"), F.col("mean").alias("reliability_mean"), F.array("lo", "hi").alias("reliability_ci"), "text", F.col("edges").alias("provenance_edges")
    )


def append_cards(cards: DataFrame, folder: str) -> bool:
    """Add rule cards to their log; a log that can't be written is no reason to stop a run."""
    try:
        append_rows(card_records(cards), folder)
    except Exception:
        return False
    return True


def split_sides(folds: DataFrame) -> DataFrame:
    """(fold, side, id) of rows (id, fold): the fold's ids are its val side, and all other ids its train side."""
    sets = folds.groupBy("id").agg(F.collect_set("fold").alias("own"))
    numbers = folds.select("fold").distinct()
    # folds are few, and ids are not
    return sets.join(F.broadcast(numbers), F.lit(True)).select("fold", F.when(F.array_contains("own", F.col("fold")), "val").otherwise("train").alias("side"), "id")


def write_split_tables(folds: DataFrame, path: str) -> None:
    """split_sides() as JSON lines below path/fold=/side=, in parallel, over what stood there."""
    split_sides(folds).write.mode("overwrite").partitionBy("fold", "side").json(path)


def write_splits(folds: DataFrame, folder: str) -> list[str]:
    """fold_i_train.json and fold_i_val.json, sorted lists of ids: train is all ids without the fold's.

    The lists are files by contract.  Ids come in order through the driver, once
    for all files, and none of them is held.
    """
    numbers = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    names = {(i, side): f"{folder}/fold_{i}_{side}.json" for i in numbers for side in ("train", "val")}
    Path(folder).mkdir(parents=True, exist_ok=True)
    with contextlib.ExitStack() as stack:
        files = {k: stack.enter_context(open(f"{name}.part", "w", encoding="utf-8")) for k, name in names.items()}
        empty = dict.fromkeys(files, True)
        for row in folds.groupBy("id").agg(F.collect_set("fold").alias("own")).orderBy("id").toLocalIterator():
            for i in numbers:
                k = (i, "val" if i in row["own"] else "train")
                files[k].write(("[\n  " if empty[k] else ",\n  ") + json.dumps(row["id"], ensure_ascii=False))
                empty[k] = False
        for k, out in files.items():
            out.write("[]\n" if empty[k] else "\n]\n")
    for name in names.values():
        os.replace(f"{name}.part", name)
    return list(names.values())


def write_bundle(folder: str, files: Sequence[str], manifest: Mapping) -> tuple[str, str]:
    """bundle.jsonl, the first records of the files in order, each with its file's folder as ``__name``, and manifest.json."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = f"{folder}/bundle.jsonl"
    with open(path, "w", encoding="utf-8") as out:
        for name in files:
            out.write(artifact_line({"__name": Path(name).parent.name, **first_record(name)}) + "\n")
    save_json(f"{folder}/manifest.json", {**manifest, "files": list(files)})
    return path, f"{folder}/manifest.json"
