"""Registered queries of predictions, decay, sketches, sampled search and the like, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DecayConfig, EngineConfig, GrowConfig, IsolationConfig, LearnConfig, MineConfig, TraverseConfig, WalkConfig
from ..functions import ids
from ..operators import abstraction, conflict, decay, isolation, policy, resample, similar, sketch, templates, walk, watch
from ..sources import audit
from . import engine
from .catalog import ORACLE_SQL, _TASK, _TWO, DAY, EV, GROW, HOUR, MINUTE, T0, T1, UN, _events, _graph, _neuron_records, _tasks, _two_step, _unary, query
from .catalog_more import _SHARES, MIXED, _mixed, _search, _targets

OPEN, CLOSE = 10 * MINUTE, 2 * HOUR
#: rates an hour, so that a month of events shows them
SLOW = DecayConfig(unit=HOUR, relax=0.01, count_keep=0.98, prune_threshold=0.45, prune_age=DAY, prune_uses=3, idle=20 * DAY, budget_per_head=60, age_lambda=0.01)

_PATTERNS = EV + ", pat AS (SELECT pre || '>' || post AS edge, pre, post FROM conn)"
_WATCH = _PATTERNS + f""", top AS (SELECT max(t) AS now FROM ev),
w AS (SELECT DISTINCT edge, post AS n, t AS "at", t + {OPEN} AS open, t + {CLOSE} AS close FROM vx JOIN pat ON pat.pre = vx.n),
hits AS (SELECT edge, "at", min(v.t) AS hit FROM w JOIN vx v ON v.n = w.n AND v.t BETWEEN w.open AND w.close GROUP BY 1, 2),
outcome AS (SELECT w.*, CASE WHEN hit IS NOT NULL THEN 'confirmed' WHEN close <= now THEN 'missed' ELSE 'pending' END AS status, CASE WHEN hit IS NOT NULL THEN hit WHEN close <= now THEN close END AS resolved_at
  FROM w LEFT JOIN hits USING (edge, "at"), top)"""


def _patterns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(events, patterns): each neuron predicts those that listen to it."""
    vertices, conn = _graph(spark, d)
    edge = F.concat(F.col("pre").cast("string"), F.lit(">"), F.col("post").cast("string"))
    return vertices, conn.select(edge.alias("edge"), "pre", F.col("post").alias("n"), F.lit(OPEN).alias("delay_min"), F.lit(CLOSE).alias("delay_max"))


def _now(events: DataFrame) -> int:
    return events.agg(F.max("t")).first()[0]


@query("watcher_outcomes", f'WITH {_WATCH} SELECT edge, n, "at", status, resolved_at FROM outcome')
def _(spark, d):
    events, patterns = _patterns(spark, d)
    return watch.outcomes(watch.watchers(events, patterns), events).select("edge", "n", "at", "status", "resolved_at")


_COUNTS = _WATCH + f""", counted AS (SELECT edge, sum(CASE WHEN status = 'confirmed' THEN f ELSE 0.0 END) AS pos, sum(CASE WHEN status = 'missed' THEN f ELSE 0.0 END) AS neg, count(*) AS uses
  FROM (SELECT *, pow(0.98::DOUBLE, greatest(now - resolved_at, 0) / {HOUR}) AS f FROM outcome, top WHERE status <> 'pending') GROUP BY edge)"""


@query("watcher_counts", f"WITH {_COUNTS} SELECT edge, round(pos, 9) AS pos, round(neg, 9) AS neg, uses FROM counted")
def _(spark, d):
    """In two halves by time that are merged, each kept as of its own last touch."""
    events, patterns = _patterns(spark, d)
    now = _now(events)
    found = watch.outcomes(watch.watchers(events, patterns), events)
    old, new = (decay.counts(found.where(part), at, SLOW) for part, at in ((F.col("resolved_at") <= T1, T1), (F.col("resolved_at") > T1, now)))
    merged = decay.merged(old, new, SLOW)
    # an edge that had no outcome since is still as of the first half
    fade = F.pow(F.lit(SLOW.count_keep), (F.lit(now) - F.col("as_of")) / HOUR)
    return merged.select("edge", F.round(F.col("pos") * fade, 9).alias("pos"), F.round(F.col("neg") * fade, 9).alias("neg"), "uses")


@query("watcher_learned", f"""WITH {_COUNTS}, e AS (SELECT edge AS id, {T1} AS last, 0.1 + (post % 8) / 10 AS r, post % 11 = 0 AS frozen FROM pat)
SELECT id, round(CASE WHEN frozen OR pos IS NULL THEN r ELSE greatest(0.02, least(0.98, 0.9 * (0.5 + (r - 0.5) * pow(0.99::DOUBLE, greatest(now - last, 0) / {HOUR})) + 0.1 * pos / (pos + neg + 1.0))) END, 9) AS reliability,
  CASE WHEN frozen OR pos IS NULL THEN NULL ELSE now END AS last_update_t FROM e LEFT JOIN counted ON edge = id, top""")
def _(spark, d):
    events, patterns = _patterns(spark, d)
    now = _now(events)
    edges = patterns.select(
        F.col("edge").alias("id"), F.struct(F.col("n"), F.lit(T1).alias("t")).alias("head"), (0.1 + (F.col("n") % 8) / 10).alias("reliability"), F.lit(None).cast("bigint").alias("last_update_t"), (F.col("n") % 11 == 0).alias("frozen")
    )
    local = decay.counts(watch.outcomes(watch.watchers(events, patterns), events), now, SLOW)
    return decay.learn(edges, local, now, SLOW).select("id", F.round("reliability", 9).alias("reliability"), "last_update_t")


_FADED = UN + f""", top AS (SELECT max(t) AS now FROM ev),
faded AS (SELECT un.*, now, (t // 1000000) % 13 = 0 AS frozen, 0.5 + (r - 0.5) * pow(0.99::DOUBLE, (now - t) / {HOUR}) AS r_now FROM un, top)"""


def _frozen_some(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    return _unary(spark, d).withColumn("frozen", (F.col("head.t") / 1_000_000).cast("long") % 13 == 0), _now(_events(spark, d))


@query("decayed_edges", f"WITH {_FADED} SELECT id, round(CASE WHEN frozen THEN r ELSE r_now END, 9) AS reliability FROM faded")
def _(spark, d):
    edges, now = _frozen_some(spark, d)
    return decay.as_of(edges, now, SLOW).select("id", F.round("reliability", 9).alias("reliability"))


@query("decay_pruned", f"""WITH {_FADED}, marked AS (SELECT *, CASE WHEN r_now < 0.45 AND NOT (now - t < {DAY} OR s + m < 3) THEN 'threshold' WHEN now - t > {20 * DAY} THEN 'idle' END AS reason FROM faded WHERE NOT frozen),
ranked AS (SELECT id, row_number() OVER (PARTITION BY n ORDER BY r_now * exp(-0.01::DOUBLE * (now - t) / {HOUR}) DESC, id) AS rk FROM marked WHERE reason IS NULL)
SELECT id, reason FROM marked WHERE reason IS NOT NULL UNION ALL SELECT id, 'budget' FROM ranked WHERE rk > 60""")
def _(spark, d):
    edges, now = _frozen_some(spark, d)
    return decay.pruned(edges, now, SLOW)


PANE, PANES, CAPACITY, SHARE = 6 * HOUR, 8, 140, 0.015
_PANES = EV + f""", o AS (SELECT t // {PANE} AS pane, n::VARCHAR AS label, count(*) AS c FROM ev GROUP BY 1, 2)"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("n").cast("string").alias("label"), "t")


@query("sketch_bounds", f"WITH {_PANES} SELECT pane, label, c, true AS inside FROM o")
def _(spark, d):
    """Whether a pane's summary holds each label's true count within its bounds, over half as many labels as there are."""
    summary = sketch.summaries(_labels(spark, d), PANE, 30)
    counts = _labels(spark, d).groupBy(F.floor(F.col("t") / PANE).alias("pane"), "label").agg(F.count(F.lit(1)).alias("c"))
    lows, totals = summary.where("label is not null").select("pane", "label", "low"), summary.where("label is null").select("pane", "lost", "n")
    low = F.coalesce("low", F.lit(0))
    inside = F.col("c").between(low, low + F.col("lost")) & (F.col("lost") * 31 <= F.col("n"))
    return counts.join(lows, ["pane", "label"], "left").join(totals, "pane").select("pane", "label", "c", inside.alias("inside"))


@query("frequent_labels", f"""WITH {_PANES}, w AS (SELECT unnest(range((SELECT min(pane) FROM o), (SELECT max(pane) FROM o) + 1)) AS win),
s AS (SELECT win, label, sum(c)::BIGINT AS support FROM o JOIN w ON pane BETWEEN win - {PANES - 1} AND win GROUP BY 1, 2), t AS (SELECT win, sum(support)::BIGINT AS n FROM s GROUP BY 1),
f AS (SELECT *, win - row_number() OVER (PARTITION BY label ORDER BY win) AS island FROM s JOIN t USING (win) WHERE support >= {SHARE / 2}::DOUBLE * n),
m AS (SELECT *, count(*) FILTER (support >= {SHARE}::DOUBLE * n) OVER (PARTITION BY label, island ORDER BY win) AS since FROM f),
a AS (SELECT win, label, support, n, island, row_number() OVER (PARTITION BY label, island ORDER BY win) AS nth FROM m WHERE since > 0)
SELECT win, label, support, n, CASE nth WHEN 1 THEN 'promoted' ELSE 'active' END AS state FROM a
UNION ALL SELECT max(win) + 1, label, NULL, NULL, 'demoted' FROM a GROUP BY label, island HAVING max(win) < (SELECT max(win) FROM f)""")
def _(spark, d):
    labels = _labels(spark, d)
    summary = sketch.summaries(labels, PANE, CAPACITY)
    return sketch.with_states(sketch.frequent(labels, summary, PANE, PANES, CAPACITY, SHARE / 2), SHARE)


WALK = WalkConfig(horizon=12 * HOUR, depth=12, branch=2, beam_size=4, incoming_cap=5, lambda_recent=1 / HOUR, seed=7)
_WALK = MIXED + f""", cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, t ORDER BY r DESC, id) AS rank_in FROM en) WHERE rank_in <= 5),
tg AS (SELECT DISTINCT n, t FROM ev WHERE event_type = 'purchase'), beam AS (
  SELECT n AS tn, t AS tt, [{{'t': t, 'n': n}}] AS frontier, []::VARCHAR[] AS path, 1.0::DOUBLE AS score, false AS done, 0 AS depth FROM tg
  UNION ALL SELECT tn, tt, frontier, path, score, done, depth FROM (
    SELECT *, row_number() OVER (PARTITION BY tn, tt, done ORDER BY score DESC, path) AS rk FROM (
      SELECT tn, tt, frontier, path, score, done, depth FROM (
        SELECT b.tn, b.tt, list_concat(list_filter(b.frontier, lambda x: x <> b.frontier[-1]), list_filter(e.new, lambda x: x = b.frontier[-1] OR NOT list_contains(b.frontier, x))) AS frontier, list_append(b.path, e.id) AS path, b.score * e.r AS score, false AS done, b.depth + 1 AS depth,
          row_number() OVER (PARTITION BY b.tn, b.tt, b.path ORDER BY (ln(e.r) + 0.5::DOUBLE * exp((e.t - b.tt)::DOUBLE / {HOUR})) / 0.7::DOUBLE
            - ln(-ln((('0x' || substr(md5('7|' || b.tn || '@' || b.tt || '|' || array_to_string(b.path, ',') || '|' || e.id), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) DESC, e.id) AS turn
        FROM beam b JOIN cap e ON e.n = b.frontier[-1].n AND e.t = b.frontier[-1].t AND b.tt - e.first_t <= {12 * HOUR} WHERE NOT b.done AND b.depth <= 12) WHERE turn <= 2
      UNION ALL SELECT b.tn, b.tt, b.frontier, b.path, b.score, true, b.depth FROM beam b WHERE NOT b.done AND NOT EXISTS (SELECT 1 FROM cap e WHERE e.n = b.frontier[-1].n AND e.t = b.frontier[-1].t AND b.tt - e.first_t <= {12 * HOUR})
    )
  ) WHERE done OR rk <= 4
), best AS (SELECT *, array_to_string(list_sort(path), '|') AS label FROM beam WHERE done)
SELECT tn AS n, tt AS t, label, len(path) AS length, round(score * pow(0.98::DOUBLE, len(path)), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tn, tt, label ORDER BY score DESC, path) AS rk FROM best) WHERE rk = 1"""


@query("walk_sampled", f"WITH RECURSIVE {_WALK}")
def _(spark, d):
    vertices, edges = _mixed(spark, d)
    return walk.walk(edges, vertices, _targets(spark, d), WALK, closing=True).select("target.n", "target.t", "label", "length", ids.rounded(F.col("score"), 9).alias("score"))


REPLICATES = 100


def _mix32(x: str) -> str:
    """SQL of resample.mixed() for an expression of type UBIGINT."""
    a = f"(xor({x}, {x} >> 16) * 2246822507::UBIGINT) & 4294967295"
    b = f"(xor({{0}}, {{0}} >> 13) * 3266489909::UBIGINT) & 4294967295"
    return f"list_transform([list_transform([{a}], lambda p: {b.format('p')})[1]], lambda q: xor(q, q >> 16))[1]"


_CHANCE = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in resample.CHANCES)


@query("bootstrap_means", f"""WITH l AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS x, {_mix32('((l_orderkey * 8 + l_linenumber) & 4294967295)::UBIGINT')} AS k FROM lineitem),
r AS (SELECT i AS replicate, {_mix32(f'(((i + 1) * 2654435769 + 11) & 4294967295)::UBIGINT')} AS salt FROM (SELECT unnest(range({REPLICATES})) AS i)),
w AS (SELECT g, replicate, x, {_mix32('xor(k, salt)')} / 4294967296.0::DOUBLE AS u FROM l, r),
m AS (SELECT g, replicate, sum(x * n) / sum(n) AS mean FROM (SELECT g, replicate, x, {_CHANCE} AS n FROM w) GROUP BY 1, 2)
SELECT g AS "group", round(stddev_samp(mean), 9) AS se, round(quantile_cont(mean, 0.025), 9) AS lo, round(quantile_cont(mean, 0.975), 9) AS hi FROM m GROUP BY 1""")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    got = resample.bootstrap(lines, F.col("l_quantity"), F.col("l_orderkey") * 8 + F.col("l_linenumber"), "l_returnflag", REPLICATES, seed=11)
    return got.select("group", *(F.round(c, 9).alias(c) for c in ("se", "lo", "hi")))


@query("promoted_paths", f"""WITH {_TWO}, made AS (SELECT n || '@' || t || '&' || pre || '@' || pt || '#' || t AS id, max(greatest(0.1, least(1.0, least(ra, rb)))) AS r FROM two GROUP BY 1)
SELECT coalesce(un.id, made.id) AS id, round(CASE WHEN un.id IS NULL THEN made.r WHEN made.r > un.r + 1e-6 THEN made.r ELSE un.r END, 9) AS reliability, CASE WHEN un.id IS NULL THEN 'abstraction' ELSE 'unary' END AS provenance FROM un FULL JOIN made USING (id)""")
def _(spark, d):
    """Paths of two edges promote to new edges, or raise the edge that is there already."""
    edges, paths = _two_step(spark, d)
    return abstraction.promote(paths, edges).select("id", F.round("reliability", 9).alias("reliability"), "provenance")


@query("audit_broken", "WITH k AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT 'changed' AS log, false AS ok, n AS count, n // 2 AS bad_index FROM k UNION ALL SELECT 'missing', false, n - 1, n // 2 + 1 FROM k UNION ALL SELECT 'repeated', false, n + 1, NULL FROM k UNION ALL SELECT 'whole', true, n, NULL FROM k")
def _(spark, d):
    """A chain with a changed record, without one, with one that stands twice, and as it was written."""
    log = audit.chained(_neuron_records(spark, d), ["n"]).select("idx", "line")
    at = F.col("idx") == F.floor(F.lit(log.count()) / 2)
    logs = {"changed": log.withColumn("line", F.when(at, F.replace("line", F.lit('"kind":"NEURON"'), F.lit('"kind":"NEUR0N"'))).otherwise(F.col("line"))), "missing": log.where(~at), "repeated": log.unionByName(log.where(at)), "whole": log}
    out = [audit.verify(x).select(F.lit(name).alias("log"), "ok", "count", "bad_index") for name, x in logs.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


STRONG, MINED, PRUNED = 0.9, 0.7, 0.89999
_STEP = f"""WITH RECURSIVE {_search(f'{STRONG}::DOUBLE', 4, 12)}{_SHARES},
parts AS (SELECT tn, tt, label, weight, e.n, e.t, e.new FROM (SELECT tn, tt, label, weight, unnest(path) AS id FROM paths) JOIN en e USING (id)),
shown AS (SELECT *, n || ':' || array_to_string(list_sort(list_transform(new, lambda x: x.n || ',' || (t - x.t))), ';') AS shape FROM parts),
shaped AS (SELECT tn, tt, label, any_value(weight) AS weight, tn || '|' || array_to_string(list_sort(list(shape)), '/') AS structure, flatten(list(new)) AS tails, list({{'t': t, 'n': n}}) AS heads FROM shown GROUP BY 1, 2, 3),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY weight DESC, tn, tt, label) AS nth, sum(weight) OVER (PARTITION BY structure) AS total FROM shaped) WHERE nth = 1 AND total >= {MINED}),
hoe AS (SELECT tn, tt, list_sort(list_transform(list_distinct(list_filter(tails, lambda x: NOT list_contains(heads, x))), lambda x: x.n || '@' || x.t)) AS tail FROM chosen),
made AS (SELECT DISTINCT tn || '@' || tt || '&' || array_to_string(tail, ',') || '#' || tt AS id FROM hoe WHERE len(tail) > 0),
every AS (SELECT id, CASE size WHEN 1 THEN 'unary' WHEN 2 THEN 'pair' ELSE 'triple' END AS provenance FROM en UNION ALL SELECT id, 'abstraction' FROM made WHERE id NOT IN (SELECT id FROM en)),
learnt AS (SELECT id, provenance, CASE WHEN share > 0 THEN greatest(0.02, least(0.98, {STRONG}::DOUBLE * 0.9 + ({STRONG}::DOUBLE - share) * 0.1)) ELSE {STRONG}::DOUBLE END AS r, coalesce(share > 0, false) AS touched FROM every LEFT JOIN shares USING (id))"""


@query("step_mined", _STEP + f""" SELECT id, provenance, round(r, 9) AS reliability, touched FROM learnt WHERE r >= {PRUNED}
UNION ALL SELECT 'n_promoted', '', (SELECT count(*) FROM chosen), NULL UNION ALL SELECT 'n_edges_updated', '', (SELECT count(*) FROM shares WHERE share > 0), NULL UNION ALL SELECT 'n_pruned', '', (SELECT count(*) FROM learnt WHERE r < {PRUNED}), NULL""")
def _(spark, d):
    """The whole step over all events, with mining, promotion, learning from errors and pruning: the edges that it leaves, and its counters."""
    events = _events(spark, d)
    _, conn = _graph(spark, d)
    cfg = EngineConfig(
        grow=GrowConfig(**{**GROW.__dict__, "init_reliability": STRONG}), traverse=TraverseConfig(horizon=12 * HOUR, beam_size=4), learn=LearnConfig(prune_threshold=PRUNED), mine=MineConfig(enabled=True, theta=MINED, hold_k=1, promotion_cap=1_000_000)
    )
    out = engine.Engine(conn, cfg).step(engine.empty(spark), events, _targets(spark, d), sign=-1, now_t=T1)
    rows = out.state.edges.select("id", "provenance", F.round("reliability", 9).alias("reliability"), F.col("last_update_t").isNotNull().alias("touched"))
    counts = [(k, "", float(out.metrics[k]), None) for k in ("n_promoted", "n_edges_updated", "n_pruned")]
    return rows.unionByName(spark.createDataFrame(counts, "id string, provenance string, reliability double, touched boolean"))


HELD = IsolationConfig(ttl=4 * HOUR, review=HOUR, leak=0.1)
_HELD = UN + f""", fr AS (SELECT pre || '>' || n AS id, t AS start, t + {4 * HOUR} AS stop FROM un WHERE r >= 0.6), asked AS (SELECT pre || '>' || post AS id, t FROM vx JOIN conn ON post = n)"""


@query("freeze_states", f"WITH {_HELD} SELECT a.id, a.t, CASE WHEN max(f.stop) > a.t THEN 'frozen' WHEN max(f.stop) + {HOUR} > a.t THEN 'review' ELSE 'open' END AS state FROM asked a LEFT JOIN fr f ON f.id = a.id AND f.start <= a.t AND f.stop + {HOUR} > a.t GROUP BY 1, 2")
def _(spark, d):
    """What each pattern may learn at each event of its head, when every reliable edge freezes its pattern for four hours."""
    vertices, conn = _graph(spark, d)
    pattern = lambda pre, n: F.concat(pre.cast("string"), F.lit(">"), n.cast("string"))
    edges = _unary(spark, d).where("reliability >= 0.6")
    frozen = edges.select(pattern(F.get("tail", F.lit(0))["n"], F.col("head.n")).alias("id"), F.col("head.t").alias("start"), (F.col("head.t") + HELD.ttl).alias("stop"))
    asked = vertices.join(conn, vertices["n"] == conn["post"]).select(pattern(F.col("pre"), F.col("post")).alias("id"), "t")
    return isolation.states(asked, frozen, HELD).select("id", "t", "state")


@query("freezes_merged", f"WITH {_HELD}, o AS (SELECT DISTINCT id, start, stop FROM fr), g AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM o), i AS (SELECT *, sum(gap) OVER (PARTITION BY id ORDER BY start, stop) AS k FROM g) SELECT id, min(start) AS start, max(stop) AS stop FROM i GROUP BY id, k")
def _(spark, d):
    pre = F.get("tail", F.lit(0))["n"].cast("string")
    edges = _unary(spark, d).where("reliability >= 0.6")
    return isolation.merged(edges.select(F.concat(pre, F.lit(">"), F.col("head.n").cast("string")).alias("id"), F.col("head.t").alias("start"), (F.col("head.t") + HELD.ttl).alias("stop")))


@query("region_admitted", f"WITH {UN}, s AS (SELECT id, n, n % 4 AS region, CASE WHEN n % 4 = pre % 4 THEN 1 ELSE 2 END AS span, r FROM un), q AS (SELECT *, floor(round(count(*) OVER (PARTITION BY n) * 0.1::DOUBLE, 6)) AS quota FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY n, span ORDER BY r - 0.5 * (span - 1) DESC, id) AS rk FROM q) SELECT id, region, span FROM k WHERE span = 1 OR rk <= quota")
def _(spark, d):
    """Neurons in four regions; a head neuron keeps the best of its edges across regions, up to a tenth of all."""
    vertices, _ = _graph(spark, d)
    return isolation.within_leak(_unary(spark, d), vertices.select("n", (F.col("n") % 4).alias("region")).distinct(), HELD).select("id", "region", "span")


@query("task_freezes", f"""WITH {_TASK}, best AS ({ORACLE_SQL['jaccard_decide'].split('AS similarity FROM')[0].split(' SELECT nn.new_id')[0].replace(f'WITH {_TASK}, ', 'WITH ')} SELECT nn.new_id AS task_id, coalesce(sim, 0) AS sim FROM nn LEFT JOIN b ON b.new_id = nn.new_id),
d AS (SELECT task_id, CASE WHEN sim >= 0.85 THEN 'REUSE' WHEN sim > 0.75 THEN 'HYBRID' ELSE 'ISOLATE' END AS mode FROM best),
c AS (SELECT task_id, count(*) AS n, max(edge_id) AS most FROM tasks GROUP BY 1),
k AS (SELECT t.task_id, edge_id, row_number() OVER (PARTITION BY t.task_id ORDER BY reliability * (edge_id::DOUBLE / nullif(most, 0)) DESC, edge_id) AS rk, ceil(round(n * CASE mode WHEN 'ISOLATE' THEN 0.3::DOUBLE WHEN 'HYBRID' THEN 0.3::DOUBLE * 0.5::DOUBLE ELSE 0 END, 6)) AS quota FROM tasks t JOIN d USING (task_id) JOIN c USING (task_id))
SELECT task_id, edge_id AS id, {T1}::BIGINT AS start, {T1 + 4 * HOUR}::BIGINT AS stop FROM k WHERE rk <= quota""")
def _(spark, d):
    """Each asked customer's decision against the strong edges of all, and what it freezes of the customer's own edges; an edge's number stands for its uses."""
    cfg = IsolationConfig(**{**HELD.__dict__, "protect_share": 0.3, "reuse": 0.85, "isolate": 0.75})
    tasks, new = _tasks(spark, d)
    decided = policy.decide(tasks, new).select(F.col("new_id").alias("task_id"), isolation.mode(F.col("similarity"), cfg).alias("mode"))
    edges = tasks.select("task_id", F.col("edge_id").alias("id"), "reliability", F.col("edge_id").alias("uses"))
    return isolation.freezes(decided, edges, T1, cfg).select("task_id", "id", "start", "stop")


#: funnels of a neuron's events: A grows by a step at T1, C is made of A and B
TEMPLATES = [
    ("A", 1, 1, 0, 0, "view", None, None), ("A", 1, 1, 0, 1, "click", MINUTE, 12 * HOUR),
    ("A", 2, 1, T1, 0, "view", None, None), ("A", 2, 1, T1, 1, "click", MINUTE, 12 * HOUR), ("A", 2, 1, T1, 2, "purchase", 0, 24 * HOUR),
    ("B", 1, 1, 0, 0, "click", None, None), ("B", 1, 1, 0, 1, "error", MINUTE, 24 * HOUR),
    ("C", 1, 2, T0, 0, "T:A", None, None), ("C", 1, 2, T0, 1, "T:B", 0, 48 * HOUR),
]


def _step_sql(name: str, before: str, kind: str, lo: int, hi: int, source: str = "e") -> str:
    return f"{name} AS (SELECT s.n, s.start, min(x.t) AS t FROM {before} s JOIN {source} x ON x.n = s.n AND x.kind = '{kind}' AND x.t BETWEEN s.t + {lo} AND s.t + {hi} GROUP BY 1, 2)"


_FUNNELS = EV + f""", e AS (SELECT DISTINCT n, event_type AS kind, t FROM ev), v AS (SELECT n, t AS start, t FROM e WHERE kind = 'view'), c AS (SELECT n, t AS start, t FROM e WHERE kind = 'click'),
{_step_sql('a1', '(SELECT * FROM v WHERE start < ' + str(T1) + ')', 'click', MINUTE, 12 * HOUR)}, {_step_sql('a2x', '(SELECT * FROM v WHERE start >= ' + str(T1) + ')', 'click', MINUTE, 12 * HOUR)}, {_step_sql('a2', 'a2x', 'purchase', 0, 24 * HOUR)},
{_step_sql('b1', 'c', 'error', MINUTE, 24 * HOUR)}, low AS (SELECT 'A' AS template, 1 AS version, 1 AS level, * FROM a1 UNION ALL SELECT 'A', 2, 1, * FROM a2 UNION ALL SELECT 'B', 1, 1, * FROM b1),
up AS (SELECT DISTINCT n, 'T:' || template AS kind, t FROM low), w AS (SELECT n, t AS start, t FROM up WHERE kind = 'T:A' AND t >= {T0}), {_step_sql('c1', 'w', 'T:B', 0, 48 * HOUR, 'up')}"""


@query("template_matches", f"WITH {_FUNNELS} SELECT template, version, level, n, start, t AS stop FROM low UNION ALL SELECT 'C', 1, 2, * FROM c1")
def _(spark, d):
    events = _events(spark, d).select("n", F.col("event_type").alias("kind"), "t")
    return templates.composed(events, spark.createDataFrame(TEMPLATES, templates.TEMPLATE)).select("template", "version", "level", "n", "start", "stop")


RHO = 3 * HOUR
_RIVALS = MIXED + f""", sc AS (SELECT n, t, id, round(0.7::DOUBLE * (list_sum(list_transform(new, lambda x: 1.0::DOUBLE - abs(t - x.t - {(MINUTE + 6 * HOUR) // 2}) / {6 * HOUR - MINUTE}::DOUBLE)) / len(new)) + 0.3::DOUBLE * (1 - len(new) / 3), 9) AS s FROM en WHERE list_max(list_transform(new, lambda x: x.t)) - list_min(list_transform(new, lambda x: x.t)) <= {30 * MINUTE}),
o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s DESC, t) AS k FROM (SELECT n, t, max(s) AS s FROM sc GROUP BY 1, 2)),
g AS (SELECT DISTINCT n, 0::BIGINT AS k, []::BIGINT[] AS kept FROM o
  UNION ALL SELECT o.n, o.k, CASE WHEN len(list_filter(kept, lambda x: abs(x - o.t) <= {RHO})) > 0 THEN kept ELSE list_append(kept, o.t) END FROM g JOIN o ON o.n = g.n AND o.k = g.k + 1),
kept AS (SELECT n, unnest(arg_max(kept, k)) AS t FROM g GROUP BY n)"""


@query("rival_heads", f"WITH RECURSIVE {_RIVALS} SELECT id, s AS score FROM sc JOIN kept USING (n, t)")
def _(spark, d):
    """Coherent candidates of the heads that stay where heads of a neuron within three hours exclude each other."""
    _, edges = _mixed(spark, d)
    edges = edges.where(conflict.coherent(F.col("tail"), 30 * MINUTE))
    score = conflict.priority(F.col("head.t"), F.col("tail"), MINUTE, 6 * HOUR, 3)
    return conflict.admitted(edges, score, RHO).select("id", score.alias("score"))


@query("vector_groups", """WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE len(embedding) > 0),
u AS (SELECT id, list_transform(x, lambda a: a / sqrt(list_sum(list_transform(x, lambda b: b * b)))) AS x FROM v),
l AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id <> q.id AND len(p.x) = len(q.x) AND list_dot_product(p.x, q.x) >= 0.4),
r AS (SELECT id AS node, id AS reached FROM u UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT e.vec_id AS id, coalesce(min(reached), e.vec_id) AS group_id FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN r ON r.node = e.vec_id GROUP BY e.vec_id""")
def _(spark, d):
    return similar.groups(spark.read.parquet(f"{d}/embeddings.parquet"), 0.4, 0.9999, id_col="vec_id", vector_col="embedding")
