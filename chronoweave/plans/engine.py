"""The step of the engine: one batch of events through growth, search, mining, promotion and learning.

State is two tables, vertices and edges, and one of label states.  A step reads
the edges that were there and writes only what it changes: new vertices, the rows
of new and changed edges, and the ids of those that go.  A Store keeps these
changes as versions in a folder that all executors share and writes a whole state
every so many.  Growth reads the vertices that the batch's heads can see, admission
the edges of the batch's time, and search, mining and learning those that the
targets' horizon reaches, as no head comes before its tails; whole states are
written in order of time, so what lies beyond is not read.  Pruning, which may
take any edge, reads ids and reliabilities of all.  A version is complete once its
name stands in the log, so a failed step leaves the one before it in force.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import ids
from ..functions.lineage import cut, drop
from ..operators import abstraction, cards, grow, learn, mine, rewrite, traverse
from ..sources import audit, logs

VERTEX = "n bigint, t bigint"
Feasible = Callable[[Column, Column], Column]


@dataclass
class State:
    vertices: DataFrame
    edges: DataFrame
    labels: DataFrame


@dataclass
class Outcome:
    """A step's state, and what it changed: new vertices, rows of new and changed edges, ids of edges that went."""

    state: State
    metrics: dict[str, int] = field(default_factory=dict)
    promoted: DataFrame | None = None
    paths: DataFrame | None = None
    fresh: DataFrame | None = None
    changed: DataFrame | None = None
    gone: DataFrame | None = None


def overlay(base: DataFrame, changed: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """base with the rows of changed in place of its own of the same ids, and without those gone."""
    out = base.join(changed.select("id"), "id", "left_anti").select(*base.columns).unionByName(changed.select(*base.columns))
    return out if gone is None else out.join(gone.select("id"), "id", "left_anti").select(*base.columns)


def empty(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], VERTEX), spark.createDataFrame([], ids.EDGE), spark.createDataFrame([], mine.STATE))


def always(tail: Column, head: Column) -> Column:
    """The feasibility check that lets everything pass."""
    return F.lit(True)


class Engine:
    """Steps over a connectivity (post, pre); feasible(tail, head) is the gate's predicate as an expression."""

    def __init__(self, connectivity: DataFrame, cfg: EngineConfig | None = None, feasible: Feasible = always) -> None:
        self.connectivity, self.cfg, self.feasible = connectivity, cfg or EngineConfig(), feasible

    def _gated(self, point: str, df: DataFrame, ok: Column, seen: dict[str, int]) -> DataFrame:
        """df by the gate: in soft mode only counted, in hard mode filtered."""
        gate = self.cfg.gate
        if not gate.enabled or point not in gate.points:
            return df
        marked = cut(df.withColumn("__ok", F.coalesce(ok, F.lit(False))))
        got = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("__ok").alias("ok")).first()
        seen[f"n_{point}_checked"], seen[f"n_{point}_infeasible"] = got["n"], got["n"] - got["ok"]
        return (marked.where("__ok") if gate.mode == "hard" else marked).drop("__ok")

    @staticmethod
    def _between(df: DataFrame, t: Column, lo: int | None, hi: int | None) -> DataFrame:
        """Rows with a time from lo to hi, where these are given."""
        df = df if lo is None else df.where(t >= lo)
        return df if hi is None else df.where(t <= hi)

    def step(self, state: State, events: DataFrame, targets: DataFrame | None = None, sign: int = 1, freeze: bool = False, now_t: int | None = None) -> Outcome:
        """All events are vertices before any of them is a head, so heads see tails of their own batch.

        Promotion reads reliabilities before learning; pruning comes last, and
        both only with targets.
        """
        cfg, seen = self.cfg, {}
        base, columns = state.edges, state.edges.columns
        heads = cut(events.select("n", "t").dropDuplicates(["n", "t"]))
        fresh = cut(heads.join(state.vertices, ["n", "t"], "left_anti"))
        vertices = state.vertices.unionByName(fresh)
        size = events.agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t")).first()
        now_t = size["t"] if now_t is None and size["t"] is not None else now_t or 0
        seen |= {"n_events": size["n"], "n_vertices_new": heads.count()}
        span = heads.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
        back = max(cfg.grow.delay_max, cfg.grow.refractory_rho, 0)
        seen_from = self._between(vertices, F.col("t"), None if span["lo"] is None else span["lo"] - back, span["hi"])
        made = cut(grow.candidates(seen_from, self.connectivity, cfg.grow, heads).select(*columns))
        seen["n_candidates"] = made.count()
        made = self._gated("grow", made, self.feasible(F.col("tail"), F.col("head")), seen)
        rules = cfg.rewrite.apply_ops if cfg.rewrite.enabled else ()
        new = grow.admit(self._between(base, F.col("head.t"), span["lo"], span["hi"]), made).select(*columns)
        new = cut(rewrite.as_rule(new) if "grow" in rules else new)
        drop(new, made)
        seen["n_admitted"] = new.count()
        seen |= {"n_hyperpaths": 0, "n_promoted": 0, "n_edges_updated": 0, "n_pruned": 0}
        edges = base.unionByName(new)
        none = cut(new.select("id").limit(0))
        out = Outcome(State(vertices, edges, state.labels), seen, fresh=fresh, changed=new, gone=none)
        if targets is None:
            self._audited(new, None, None)
            return out
        # a path's edges, and what promotion may raise, have heads from the horizon's end to the last target
        ends = targets.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
        reach = None if cfg.traverse.horizon <= 0 or ends["lo"] is None else ends["lo"] - cfg.traverse.horizon
        near = self._between(edges, F.col("head.t"), reach, None)
        # new edges' tails are vertices that growth saw
        known = grow.connected(traverse.within(self._between(base, F.col("head.t"), reach, None), targets, cfg.traverse), vertices)
        usable = known.unionByName(traverse.within(self._between(new, F.col("head.t"), reach, None), targets, cfg.traverse))
        paths = cut(traverse.traverse(usable, vertices, targets, cfg.traverse, checked=True))
        if cfg.gate.enabled and "backward" in cfg.gate.points:
            parts = paths.select("target", "label", F.explode("edges").alias("id")).join(near.select("id", self.feasible(F.col("tail"), F.col("head")).alias("ok")), "id")
            judged = parts.groupBy("target", "label").agg(F.bool_and("ok").alias("ok"))
            joined = paths.join(judged, ["target", "label"], "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
            paths = self._gated("backward", joined, F.col("ok"), seen).drop("ok")
        seen["n_hyperpaths"] = paths.count()
        changed = new
        if cfg.mine.enabled:
            promoted_rows, out.state.labels, out.promoted = self._mined(paths, near, state.labels, now_t)
            seen["n_promoted"] = out.promoted.count()
            if cfg.audit.cards and seen["n_promoted"]:
                logs.append_cards(cards.cards(out.promoted.drop("label").withColumnRenamed("structure", "label"), near, cfg.card), cfg.audit.cards)
            changed = overlay(changed, promoted_rows)
            near = overlay(self._between(base, F.col("head.t"), reach, None), self._between(changed, F.col("head.t"), reach, None))
        touched = cut(learn.evidence(paths).select("id").join(near.select("id"), "id", "left_semi"))
        seen["n_edges_updated"] = touched.count()
        learnt = cut(learn.update(near.join(touched, "id", "left_semi").select(*columns), paths, sign, now_t, cfg.learn, freeze))
        self._audited(new, paths, learnt)
        changed = cut(overlay(changed, learnt))
        edges = overlay(base, changed)
        gone = cut((rewrite.pruned(edges, cfg.rewrite.prune_threshold) if "prune" in rules else learn.pruned(edges, cfg.learn.prune_threshold)).select("id"))
        if "prune" in rules and gone.isEmpty():  # the rule took nothing, so the plain threshold has its turn
            gone = cut(learn.pruned(edges, cfg.learn.prune_threshold).select("id"))
        seen["n_pruned"] = gone.count()
        if "freeze" in rules:
            frozen = rewrite.apply_freeze(overlay(base, changed, gone).where("not frozen"), cfg.rewrite.freeze_threshold).where("frozen")
            changed = cut(overlay(changed, cut(frozen)))
        out.state.edges, out.paths, out.changed, out.gone = overlay(base, changed, gone), paths, changed, gone
        if "freeze" in rules:
            seen["n_frozen"] = out.state.edges.where("frozen").count()
        return out

    def _mined(self, paths: DataFrame, edges: DataFrame, before: DataFrame, now_t: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows of the edges that newly promoted labels make or raise, the label states, and the promoted paths."""
        cfg = self.cfg.mine
        shaped = cut(abstraction.label_paths(paths.where("length > 0"), edges))
        new = shaped.select(F.col("structure").alias("label"), F.lit(now_t).cast("long").alias("t"), F.xxhash64("target", "label").alias("seq"), F.col("score").alias("weight"))
        after = cut(mine.resume(before, new, cfg))
        was = before.select("label", F.col("promotions").alias("was"))
        up = after.join(was, "label", "left").where("promotions > coalesce(was, 0)").select("label", F.col("count").alias("weight"))
        capped = up.orderBy(F.desc("weight"), "label").limit(cfg.promotion_cap)
        # the concrete path that stands for a label: the best, then the smallest
        best = shaped.join(capped.select(F.col("label").alias("structure")), "structure").groupBy("structure").agg(F.min_by(F.struct("target", "label", "edges", "score", "length"), F.struct(-F.col("score"), "target", "label")).alias("p"))
        chosen = drop(cut(best.select("p.*", "structure")), shaped)
        return cut(abstraction.promotions(chosen.drop("structure"), edges, self.cfg.abstraction)), after, chosen

    def _audited(self, admitted: DataFrame, paths: DataFrame | None, updated: DataFrame | None) -> None:
        """Write the step's records to the audit log, if there is one."""
        if self.cfg.audit.log:
            records = audit.step_records(admitted, paths, updated, logs.utc_now())
            audit.AuditLog(self.cfg.audit.log, self.cfg.audit.max_bytes).rows(records.orderBy("phase", "at", "name"))


class Store:
    """Versions of a state in a shared folder; the folder is a path that driver and executors both reach.

    A version is its step's changes; every ``whole_every`` versions, and with the
    first, the whole edges are written, and only versions from the last of these
    on are read.  Vertices only ever grow, so theirs are read of all versions.
    Whole edges, and the vertices of each version, are written in order of time,
    so the statistics of their files say which of them a range of times needs.
    """

    def __init__(self, spark: SparkSession, folder: str, whole_every: int = 16) -> None:
        self.spark, self.folder, self.whole_every = spark, folder.rstrip("/"), whole_every

    def _log(self) -> list[tuple[int, bool]]:
        """(version, whole) of the complete versions, in order: one small row a version."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema("version bigint, whole boolean, metrics string").json(f"{self.folder}/log").select("version", "whole").distinct().collect()
        return sorted((r["version"], r["whole"]) for r in rows)

    def version(self) -> int | None:
        log = self._log()
        return log[-1][0] if log else None

    def _read(self, versions: list[int], table: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/v{v}/{table}" for v in versions])

    def load(self) -> State:
        log = self._log()
        if not log:
            return empty(self.spark)
        versions = [v for v, _ in log]
        start = max(v for v, whole in log if whole)
        edges = self._read([start], "edges")
        if later := [v for v in versions if v > start]:
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)/(?:changed|gone)/", 1).cast("bigint").alias("v")
            rows = self._read(later, "changed").select(F.struct(*edges.columns).alias("row"), "id", number)
            marks = self._read(later, "gone").select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "id", number)
            # of each id the latest word, and within a version its going
            last = rows.unionByName(marks).groupBy("id").agg(F.max_by("row", F.struct("v", F.col("row").isNull())).alias("row"))
            edges = overlay(edges, last.where("row is not null").select("row.*"), last.where("row is null").select("id"))
        return State(self._read(versions, "vertices"), edges, self._read(versions[-1:], "labels"))

    def save(self, outcome: Outcome, version: int) -> None:
        whole = [v for v, w in self._log() if w]
        full = not whole or version - whole[-1] >= self.whole_every
        parts = {"vertices": outcome.fresh, "labels": outcome.state.labels, "changed": outcome.changed, "gone": outcome.gone}
        if full:
            parts["edges"] = outcome.state.edges
        for name, time in (("vertices", "t"), ("edges", "head.t")):
            if name in parts:
                parts[name] = parts[name].repartitionByRange(F.col(time)).sortWithinPartitions(F.col(time))
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        self.spark.createDataFrame([(version, full, json.dumps(outcome.metrics, sort_keys=True))], "version bigint, whole boolean, metrics string").coalesce(1).write.mode("append").json(f"{self.folder}/log")


def stepper(engine: Engine, store: Store, targets: Callable[[DataFrame], DataFrame] | None = None, sign: int = 1) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: a micro-batch is a step; one that was saved already is passed over when replayed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        last = store.version()
        if last is not None and batch_id <= last:
            return
        rows = cut(batch.select("n", "t"))
        store.save(engine.step(store.load(), rows, targets(rows) if targets else None, sign), batch_id)

    return run


def run_quick(spark: SparkSession, cfg: EngineConfig | None = None, pairs: tuple[tuple[int, int], ...] = ((0, 0), (1, 200))) -> dict[str, int]:
    """Counters of a step over a few events, with the last as the target."""
    from ..sources import tables

    conn = tables.connectivity_of(spark, {1: [0], 2: [0, 1]})
    events = tables.events_of(spark, list(pairs))
    return Engine(conn, cfg).step(empty(spark), events, tables.events_of(spark, [pairs[-1]])).metrics
