"""Runs, ablations, reports and bundles: what turns steps of the engine into files that can be compared.

``python -m chronoweave <command> ...`` runs each of these; see COMMANDS.
Records of runs are small, one JSON line a run, so comparing them is driver
work; the step under them and every table operation are Spark's.
"""

from __future__ import annotations

import argparse
import json
import os
import platform
import random
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import fields, is_dataclass, replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, deep_merge, fingerprint, from_mapping, load_yaml, parse_overrides
from ..functions.special import z_for_alpha
from ..operators import artifacts, evaluate, stats
from ..sources import logs, tables
from . import engine

#: Fixed values of the quick run: when the target spikes, and its default sources.
HEAD_T = 10_000
DEFAULT_CONNECTIVITY = {2: [1]}


def set_seeds(python: int = 0, numpy: int = 0) -> dict[str, int]:
    """Seed this process's generators; expressions and UDFs of the engine take theirs as arguments."""
    random.seed(python)
    np.random.seed(numpy % (1 << 32))
    return {"python": python, "numpy": numpy}


def environment(spark: SparkSession | None = None) -> dict:
    """What a run depends on besides its configuration: versions, platform and the settings of the session that shape results."""
    import pandas
    import pyarrow
    import pyspark

    out = {"python_version": " ".join(sys.version.split()), "platform": platform.platform(), "packages": {"numpy": np.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__, "pyspark": pyspark.__version__}}
    if spark is not None:
        names = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions")
        out["spark"] = {"version": spark.version, "conf": fingerprint({n: spark.conf.get(n, None) for n in names})}
    return out


def quick(spark: SparkSession, spec: Mapping, folder: str | None = None) -> dict:
    """One step over two events, a source's and the target's at the middle of the allowed delays; the record of the run.

    spec has ``seeds``, ``connectivity`` (target to sources) and ``engine``, the
    nested values of an EngineConfig.  With a folder, metrics.jsonl is written.
    """
    seeds = dict(spec.get("seeds") or {})
    set_seeds(int(seeds.get("python", 0)), int(seeds.get("numpy", 0)))
    cfg = from_mapping(dict(spec.get("engine") or {}))
    wired: dict[int, list[int]] = {}
    for post, pres in (spec.get("connectivity") or {}).items():
        if str(post).lstrip("-").isdigit():
            wired[int(post)] = [int(p) for p in pres or [] if str(p).lstrip("-").isdigit()]
    wired = wired or dict(DEFAULT_CONNECTIVITY)
    head = min(wired)
    source = min(wired[head] or [head])
    delay = (cfg.grow.delay_min + cfg.grow.delay_max) // 2
    events = [(source, HEAD_T - delay), (head, HEAD_T)]
    got = engine.Engine(tables.connectivity_of(spark, wired), cfg).step(engine.empty(spark), tables.events_of(spark, events), tables.events_of(spark, events[-1:]))
    summary = evaluate.reliability_summary(got.state.edges).first().asDict(recursive=True)
    record = {"ts": logs.utc_now(), "config_fingerprint": fingerprint(spec), "env": environment(spark), "metrics": got.metrics, "reliability_summary": summary}
    if folder:
        record["artifact"] = logs.write_artifact(folder, record)
    return record


def dataset(spark: SparkSession, events: DataFrame, connectivity: DataFrame, cfg: EngineConfig, limit: int = 10, folder: str | None = None) -> dict:
    """One step over the first events, in order of time, of a table; the latest of them is the target.

    The limit is the feature, a smoke run's size, and is kept from 1 to 100.
    Learning is by Beta counts, whatever the configuration says.
    """
    cfg = replace(cfg, learn=replace(cfg.learn, impl="beta"))
    first = events.select("n", "t").orderBy("t", "n").limit(evaluate.step_limit(limit))
    target = first.orderBy(F.desc("t"), F.desc("n")).limit(1)
    got = engine.Engine(connectivity, cfg).step(engine.empty(spark), first, target)
    summary = evaluate.reliability_summary(got.state.edges).first().asDict(recursive=True)
    record = {"ts": logs.utc_now(), "config_fingerprint": fingerprint(cfg), "env": environment(spark), "metrics": got.metrics, "reliability_summary": summary}
    if folder:
        record["artifact"] = logs.write_artifact(folder, record)
    return record


def records_table(spark: SparkSession, records: Sequence[Mapping]) -> DataFrame:
    """(seq, label, mean, lo, hi) of records of runs, in their order."""
    def bounds(summary: Mapping) -> tuple[float, float]:
        ci = [e["ci"] for e in summary.get("edges") or [] if isinstance(e.get("ci"), (list, tuple)) and len(e["ci"]) == 2]
        mean = min(1.0, max(0.0, float(summary.get("mean_reliability", 0.0))))
        lo, hi = (min(1.0, max(0.0, float(np.mean([c[i] for c in ci])))) if ci else mean for i in (0, 1))
        return (lo, hi) if lo <= hi else (mean, mean)

    rows = []
    for i, r in enumerate(records):
        summary = r.get("reliability_summary") or {}
        label = next((x for x in (r.get("config_fingerprint"), r.get("__name"), r.get("name")) if isinstance(x, str) and x), f"t{i}")
        rows.append((i, label, float(summary.get("mean_reliability", 0.0)), *bounds(summary)))
    return spark.createDataFrame(rows, "seq bigint, label string, mean double, lo double, hi double")


def series(spark: SparkSession, records: Sequence[Mapping], alpha: float = 0.05) -> dict:
    """Runs' reliabilities with their intervals, in order."""
    rows = records_table(spark, records).orderBy("seq").collect()
    return {"alpha": alpha, "names": [r["label"] for r in rows], "mean": [r["mean"] for r in rows], "ci": [[r["lo"], r["hi"]] for r in rows]}


def effects(spark: SparkSession, a: Sequence[Mapping], b: Sequence[Mapping], by: str = "index", alpha: float = 0.05) -> dict:
    rows = evaluate.effect_sizes(records_table(spark, a), records_table(spark, b), by, z_for_alpha(alpha)).collect()
    return {"alpha": alpha, "align_by": by, "pairs": [[r["name_a"], r["name_b"]] for r in rows], "cohen_d": [r["cohen_d"] for r in rows], "hedges_g": [r["hedges_g"] for r in rows]}


def group_aggregate(spark: SparkSession, groups: Mapping[str, Sequence[Mapping]], alpha: float = 0.05) -> dict:
    """Each group's series, mean of means and number of runs."""
    out = {name: {"reliability_ts": series(spark, records, alpha), "group_mean": float(np.mean([(r.get("reliability_summary") or {}).get("mean_reliability", 0.0) for r in records])) if records else 0.0, "n": len(records)} for name, records in groups.items()}
    return {"alpha": alpha, "groups": out}


def ablation(spark: SparkSession, root: str, learners: Sequence[str] = ("beta", "ema"), abstraction: Sequence[bool] = (False,), replicates: int = 2, seed: int = 123, by: str = "name", alpha: float = 0.05) -> dict:
    """Quick runs over the grid of learners and abstraction, each replicate with seeds of its own, and beta against ema by effect sizes.

    Pairs fall back to order where the two sides have no name in common.
    """
    groups: dict[str, list] = {}
    conditions: dict[str, dict] = {}
    for learner in learners:
        for on in abstraction:
            label = f"p={learner.lower()}|abs={int(on)}"
            for r in range(replicates):
                spec = {"seeds": {"python": seed + r, "numpy": seed + r}, "connectivity": {"2": [1]}, "engine": {"learn": {"impl": learner.lower()}, "mine": {"enabled": bool(on)}, "grow": {"delay_min": 100, "delay_max": 500}}}
                record = quick(spark, spec, f"{root}/{label}/rep{r}")
                groups.setdefault(label, []).append({"__name": label, **record})
                at = conditions.setdefault(label, {"n": 0, "artifacts": []})
                at["n"] += 1
                at["artifacts"].append(record["artifact"])
    compared = []
    for on in sorted({int(x) for x in abstraction}):
        pair = [f"p={x}|abs={on}" for x in ("beta", "ema")]
        if all(p in groups for p in pair):
            found = effects(spark, groups[pair[0]], groups[pair[1]], by, alpha)
            if by == "name" and not found["pairs"]:
                found = effects(spark, groups[pair[0]], groups[pair[1]], "index", alpha)
            compared.append({"pair": pair, "effect_sizes": found})
    return {"alpha": alpha, "conditions": conditions, "aggregate": group_aggregate(spark, groups, alpha), "comparisons": compared}


def _file(path: str) -> str:
    return f"{path}/metrics.jsonl" if os.path.isdir(path) else path


def _records(paths: Sequence[str]) -> list[dict]:
    return [{"__name": Path(_file(p)).parent.name, **logs.first_record(_file(p))} for p in paths]


def report(spark: SparkSession, a: Sequence[str], b: Sequence[str] = (), by: str = "index", alpha: float = 0.05, out: str | None = None) -> dict:
    """The series of set a and, with set b, effect sizes; paths are files or folders of runs."""
    if not a:
        raise ValueError("a report needs a path")
    first = _records(a)
    made: dict = {"reliability_ts": series(spark, first, alpha)}
    if b:
        made["effect_sizes"] = effects(spark, first, _records(b), by, alpha)
    if out:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(logs.artifact_line(made) + "\n", encoding="utf-8")
        made["artifact"] = out
    return made


def same(a: Mapping, b: Mapping, tol: float = 0.0) -> dict:
    """Whether two runs agree in the counters that both have and in their edges, and where they don't."""
    diff: dict = {}
    one, two = a.get("metrics") or {}, b.get("metrics") or {}
    for name in sorted(set(one) & set(two)):
        if abs(float(one[name]) - float(two[name])) > tol:
            diff[f"metrics.{name}"] = [one[name], two[name]]
    sides = [{e["id"]: e.get("mean") for e in (x.get("reliability_summary") or {}).get("edges") or []} for x in (a, b)]
    for name in sorted(set(sides[0]) | set(sides[1])):
        x, y = sides[0].get(name), sides[1].get(name)
        if x is None or y is None or abs(x - y) > tol:
            diff[f"edges.{name}"] = [x, y]
    return {"equal": not diff, "diff": diff}


def manifest(records: Sequence[Mapping], comparisons: Sequence[Mapping] = (), label: str | None = None) -> dict:
    """What a bundle holds: the runs' names and fingerprints, and how they compare."""
    return {"label": label, "count": len(records), "fingerprints": [r.get("config_fingerprint") for r in records], "names": [r.get("__name") for r in records], "comparisons": list(comparisons), "all_equal": all(c["equal"] for c in comparisons)}


def bundle(paths: Sequence[str], folder: str, tol: float = 0.0, label: str | None = None) -> dict:
    """The first records of runs in one file, with a manifest that compares each with the first."""
    files = [_file(p) for p in paths]
    records = _records(paths)
    compared = [{"i": 0, "j": j, **same(records[0], r, tol)} for j, r in enumerate(records) if j]
    concat, listed = logs.write_bundle(folder, files, manifest(records, compared, label))
    return {"bundle_dir": folder, "concat": concat, "manifest": listed, "comparisons": compared}


def off_by_default() -> dict[str, bool]:
    """Whether every optional part of the engine is off unless asked for."""
    cfg = EngineConfig()
    return {f"{f.name}_default_off": not getattr(cfg, f.name).enabled for f in fields(cfg) if is_dataclass(getattr(cfg, f.name)) and hasattr(getattr(cfg, f.name), "enabled")}


def gates(paths: Sequence[str] = (), words: Mapping[str, Sequence[str]] | None = None) -> dict:
    """Checks before a release: optional parts are off, the paths exist, and each document holds its words."""
    docs = {}
    for path, wanted in (words or {}).items():
        text = Path(path).read_text(encoding="utf-8").lower() if os.path.exists(path) else ""
        docs[path] = bool(text) and all(w.lower() in text for w in wanted)
    out = {"flags": off_by_default(), "paths": {p: os.path.exists(p) for p in paths}, "docs": docs}
    return out | {"ok": all(v for part in out.values() for v in part.values())}


def splits(spark: SparkSession, path: str, folder: str, k: int = 5, seed: int = 0) -> list[str]:
    """Stratified folds of a manifest as lists of ids."""
    return logs.write_splits(stats.stratified_folds(tables.read_manifest(spark, path), k, seed), folder)


def baseline(spark: SparkSession, n_samples: int = 200, n_classes: int = 2, n_neurons: int = 32, n_steps: int = 20, seed: int = 0) -> dict:
    """Synthetic classes of spike trains, told apart by their mean rates: the separation |r1 - r0| / (r0 + r1) of the two classes."""
    spikes = tables.poisson_batches(spark, n_samples, n_classes, n_neurons, n_steps, seed)
    rates = {r["label"]: r["rate"] for r in spikes.groupBy("label").agg((F.sum("spikes") / (F.count(F.lit(1)) * n_steps)).alias("rate")).collect()}
    r0, r1 = rates.get(0, 0.0), rates.get(1, 0.0)
    return {"rates": rates, "separation": abs(r1 - r0) / (r0 + r1) if r0 + r1 else 0.0}


def _session() -> SparkSession:
    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[2]")).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _spec(args: argparse.Namespace) -> dict:
    """The configuration of YAML files, in order, with key.sub=value overrides on top."""
    values: dict = {}
    for path in args.config or []:
        values = deep_merge(values, load_yaml(path))
    return deep_merge(values, parse_overrides(args.overrides))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="chronoweave")
    subs = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "quick", "dataset"):
        sub = subs.add_parser(name)
        sub.add_argument("overrides", nargs="*")
        sub.add_argument("--config", action="append")
        sub.add_argument("--out")
        sub.add_argument("--events", help="folder with events.parquet")
        sub.add_argument("--limit", type=int, default=10)
    sub = subs.add_parser("ablation")
    sub.add_argument("root")
    sub.add_argument("--replicates", type=int, default=2)
    sub = subs.add_parser("report")
    sub.add_argument("--a", nargs="+", required=True)
    sub.add_argument("--b", nargs="*", default=[])
    sub.add_argument("--by", choices=["index", "name"], default="index")
    sub.add_argument("--alpha", type=float, default=0.05)
    sub.add_argument("--out")
    sub = subs.add_parser("bundle")
    sub.add_argument("artifacts", nargs="+")
    sub.add_argument("--folder", default="artifacts/bundle")
    sub.add_argument("--tol", type=float, default=0.0)
    sub.add_argument("--label")
    sub = subs.add_parser("splits")
    sub.add_argument("manifest")
    sub.add_argument("folder")
    sub.add_argument("--k", type=int, default=5)
    sub.add_argument("--seed", type=int, default=0)
    sub = subs.add_parser("baselines")
    sub.add_argument("--seed", type=int, default=0)
    sub.add_argument("--dry-run", action="store_true")
    sub = subs.add_parser("gates")
    sub.add_argument("paths", nargs="*")
    sub = subs.add_parser("verify")
    sub.add_argument("log")
    return parser


def _quick(args: argparse.Namespace) -> dict:
    spec = _spec(args)
    return quick(_session(), {"engine": {k: v for k, v in spec.items() if k not in ("seeds", "connectivity")}, **{k: spec[k] for k in ("seeds", "connectivity") if k in spec}}, args.out)


def _dataset(args: argparse.Namespace) -> dict:
    if not args.events:
        raise SystemExit("--events names the folder of the table")
    spark = _session()
    events = tables.read_events(spark, args.events)
    return dataset(spark, events, tables.ring_connectivity(events), from_mapping(_spec(args)), args.limit, args.out)


def _verify(args: argparse.Namespace) -> dict:
    from ..sources import audit

    return audit.verify(audit.read(_session(), args.log)).first().asDict()


COMMANDS: dict[str, Callable[[argparse.Namespace], object]] = {
    "run": lambda a: _dataset(a) if a.events else _quick(a),
    "quick": _quick,
    "dataset": _dataset,
    "ablation": lambda a: ablation(_session(), a.root, replicates=a.replicates),
    "report": lambda a: report(_session(), a.a, a.b, a.by, a.alpha, a.out),
    "bundle": lambda a: bundle(a.artifacts, a.folder, a.tol, a.label),
    "splits": lambda a: splits(_session(), a.manifest, a.folder, a.k, a.seed),
    "baselines": lambda a: {"dry_run": True} if a.dry_run else baseline(_session(), seed=a.seed),
    "gates": lambda a: gates(a.paths),
    "verify": _verify,
}


def main(args: list[str]) -> int:
    """Run a command and print its result as one JSON line; a failed check is exit code 1."""
    given = _parser().parse_args(args)
    got = COMMANDS[given.command](given)
    print(json.dumps(got, sort_keys=True, default=str))
    return int(isinstance(got, dict) and got.get("ok") is False)
