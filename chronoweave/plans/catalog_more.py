"""More registered queries: edges of several tails, the whole step, gates, rewriting, parsing, statistics and runs.

Edges here are the candidates of the catalog, of one to three tails, with
synthetic counts; what the search and the learning do with several tails is
compared with recursive SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CardConfig, EngineConfig, GateConfig, LearnConfig, RewriteConfig, TraverseConfig
from ..functions import ids
from ..functions.lineage import cut
from ..operators import abstraction, artifacts, encoders, evaluate, grow, learn, metrics, policy, rewrite, stats, transforms, traverse
from ..sources import tables
from ..streaming import buffer
from . import engine
from .catalog import COMBOS, EV, GROW, HOUR, NEAR, T0, T1, UN, UNARY, _events, _graph, _predictions, _unary, query

_PRED_SQL = "p AS (SELECT label::BIGINT AS y_true, ((label + CASE WHEN vec_id % 4 = 0 THEN 1 + vec_id % 3 ELSE 0 END) % 10)::BIGINT AS y_pred FROM embeddings)"

#: candidates within their budgets: head (n, t), tails as sorted structs, counts s and m, reliability r
MIXED = COMBOS.replace("SELECT n || '@' || t || '&' || array_to_string(list_sort(tail), ',') || '#' || t AS id", "SELECT n, t, tail, n || '@' || t || '&' || array_to_string(list_sort(tail), ',') || '#' || t AS id") + """, picked AS (
  SELECT * FROM edges WHERE rk <= 8
), mixed AS (
  SELECT DISTINCT n, t, id, size, list_sort(list_transform(tail, lambda x: {'t': split_part(x, '@', 2)::BIGINT, 'n': split_part(x, '@', 1)::BIGINT})) AS new FROM picked
), en AS (
  SELECT *, new[1].t AS first_t, (new[-1].t // 1000000) % 7 AS s, (t // 1000000) % 5 AS m, (1.0::DOUBLE + (new[-1].t // 1000000) % 7) / (2.0::DOUBLE + (new[-1].t // 1000000) % 7 + (t // 1000000) % 5) AS r FROM mixed
)"""


def _search(r: str, beam: int, hours: int) -> str:
    """The beam search over en with reliability r: rows (tn, tt, path, score) of ended paths, the best of each label, before the length penalty."""
    return MIXED + f""", tg AS (SELECT DISTINCT n, t FROM ev WHERE event_type = 'purchase'), beam AS (
  SELECT n AS tn, t AS tt, [{{'t': t, 'n': n}}] AS frontier, []::VARCHAR[] AS path, 1.0::DOUBLE AS score, false AS done FROM tg
  UNION ALL SELECT tn, tt, frontier, path, score, done FROM (
    SELECT *, row_number() OVER (PARTITION BY tn, tt, done ORDER BY score DESC, path) AS rk FROM (
      SELECT b.tn, b.tt, list_concat(list_filter(b.frontier, lambda x: x <> b.frontier[-1]), list_filter(e.new, lambda x: x = b.frontier[-1] OR NOT list_contains(b.frontier, x))) AS frontier, list_append(b.path, e.id) AS path, b.score * {r} AS score, false AS done
        FROM beam b JOIN en e ON e.n = b.frontier[-1].n AND e.t = b.frontier[-1].t AND b.tt - e.first_t <= {hours * HOUR} WHERE NOT b.done
      UNION ALL SELECT b.tn, b.tt, b.frontier, b.path, b.score, true FROM beam b WHERE NOT b.done AND NOT EXISTS (SELECT 1 FROM en e WHERE e.n = b.frontier[-1].n AND e.t = b.frontier[-1].t AND b.tt - e.first_t <= {hours * HOUR})
    )
  ) WHERE done OR rk <= {beam}
), found AS (
  SELECT tn, tt, path, score, array_to_string(list_sort(path), '|') AS label FROM beam WHERE done
), best AS (
  SELECT tn, tt, path, score, label FROM (SELECT *, row_number() OVER (PARTITION BY tn, tt, label ORDER BY score DESC, path) AS rk FROM found) WHERE rk = 1
)"""


#: the score with the penalty for each edge, and each edge's share of all paths' scores
_SHARES = ", paths AS (SELECT *, score * pow(0.98::DOUBLE, len(path)) AS weight FROM best), total AS (SELECT sum(weight) AS w FROM paths), shares AS (SELECT id, sum(weight) / (SELECT w FROM total) AS share FROM (SELECT unnest(list_distinct(path)) AS id, weight FROM paths) GROUP BY 1)"
MULTI, STEP = _search("e.r", 4, 12), _search("0.1::DOUBLE", 4, 12)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the candidates, with counts and reliabilities."""
    vertices, conn = _graph(spark, d)
    made = grow.candidates(vertices, conn, GROW)
    last = F.array_max(F.transform("tail", lambda v: v["t"]))
    s, m = (last / 1_000_000).cast("long") % 7, (F.col("head.t") / 1_000_000).cast("long") % 5
    return vertices, made.withColumn("counts_success", s).withColumn("counts_miss", m).withColumn("reliability", (1.0 + s) / (2.0 + s + m))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'purchase'").select("n", "t").distinct()


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vertices, edges = _mixed(spark, d)
    edges = cut(edges)  # read by the search and again by what follows it
    return vertices, edges, traverse.traverse(edges, vertices, _targets(spark, d), TraverseConfig(horizon=12 * HOUR, beam_size=4), checked=True)


@query("traverse_multi", f"WITH RECURSIVE {MULTI} SELECT tn AS n, tt AS t, label, len(path) AS length, round(score * pow(0.98::DOUBLE, len(path)), 9) AS score FROM best")
def _(spark, d):
    return _paths(spark, d)[2].select("target.n", "target.t", "label", F.col("length").cast("long").alias("length"), F.round("score", 9).alias("score"))


@query("evidence_paths", f"WITH RECURSIVE {MULTI}{_SHARES} SELECT id, round(CASE WHEN share IS NULL THEN r ELSE greatest(0.02, least(0.98, r * 0.9 + (r + share) * 0.1)) END, 9) AS reliability, s + (share IS NOT NULL)::INT AS counts_success, m AS counts_miss FROM en LEFT JOIN shares USING (id)")
def _(spark, d):
    _, edges, paths = _paths(spark, d)
    return learn.update(edges, paths, 1, T1).select("id", F.round("reliability", 9).alias("reliability"), "counts_success", "counts_miss")


@query("evidence_beta_up", f"WITH RECURSIVE {MULTI}{_SHARES} SELECT id, round(CASE WHEN share IS NULL THEN r ELSE (s + 1.0 + share) / (s + m + 2.0 + share) END, 9) AS reliability, (s + CASE WHEN share IS NULL THEN 0 ELSE round_even(share, 0) END)::BIGINT AS counts_success, m AS counts_miss FROM en LEFT JOIN shares USING (id)")
def _(spark, d):
    _, edges, paths = _paths(spark, d)
    return learn.update(edges, paths, 1, T1, LearnConfig(impl="beta")).select("id", F.round("reliability", 9).alias("reliability"), "counts_success", "counts_miss")


@query("evidence_beta_share", f"WITH RECURSIVE {MULTI}{_SHARES} SELECT id, round(CASE WHEN share IS NULL THEN r ELSE (s + 1.0) / (s + m + 2.0 + 0.25 * share) END, 9) AS reliability FROM en LEFT JOIN shares USING (id)")
def _(spark, d):
    _, edges, paths = _paths(spark, d)
    return learn.update(edges, paths, -1, T1, LearnConfig(impl="beta", share_negative=0.25)).select("id", F.round("reliability", 9).alias("reliability"))


@query("evidence_frozen", f"WITH {MIXED} SELECT id, round(r, 9) AS reliability FROM en")
def _(spark, d):
    vertices, edges = _mixed(spark, d)
    paths = edges.select(F.col("head").alias("target"), F.array("id").alias("edges"), F.col("reliability").alias("score"), F.lit(1).alias("length"), F.col("id").alias("label"))
    frozen = learn.update(edges, paths, 1, T1, LearnConfig(impl="beta"), freeze=True)
    return learn.update(frozen, paths, 0, T1, LearnConfig(impl="beta")).select("id", F.round("reliability", 9).alias("reliability"))


_HOE = f"""WITH RECURSIVE {MULTI}, real AS (SELECT * FROM best WHERE len(path) > 0), parts AS (SELECT tn, tt, label, e.id, e.n, e.t, e.r, e.new FROM (SELECT tn, tt, label, unnest(path) AS id FROM real) JOIN en e USING (id)),
hoe AS (SELECT tn, tt, label, flatten(list(new)) AS tails, list({{'t': t, 'n': n}}) AS heads, min(r) AS lo, avg(r) AS mid, exp(avg(ln(r))) AS geo FROM parts GROUP BY 1, 2, 3),
made AS (SELECT tn, tt, label, list_sort(list_transform(list_distinct(list_filter(tails, lambda x: NOT list_contains(heads, x))), lambda x: x.n || '@' || x.t)) AS tail, list_min(list_transform(list_filter(tails, lambda x: NOT list_contains(heads, x)), lambda x: x.t)) AS first_t, list_max(list_transform(list_filter(tails, lambda x: NOT list_contains(heads, x)), lambda x: x.t)) AS last_t, lo, mid, geo FROM hoe)
SELECT tn || '@' || tt || '&' || array_to_string(tail, ',') || '#' || tt AS id, label, tt - last_t AS delta_min, tt - first_t AS delta_max, round(greatest(0.1, least(1.0, {{0}})), 9) AS reliability FROM made WHERE len(tail) > 0"""

for _kind, _column in (("min", "lo"), ("mean", "mid"), ("geo", "geo")):

    @query(f"hoe_multi_{_kind}", _HOE.replace("{0}", _column))
    def _(spark, d, kind=_kind):
        _, edges, paths = _paths(spark, d)
        made = abstraction.higher_order(paths, edges, abstraction.AbstractionConfig(reliability=kind))
        return made.select("id", F.col("hoe_label").alias("label"), "delta_min", "delta_max", F.round("reliability", 9).alias("reliability"))


@query("promoted", f"WITH {NEAR} SELECT n || '@' || t || '&' || pre || '@' || pt || '#' || t AS id, CASE WHEN (pt // 1000000) % 2 = 0 THEN 0.6 ELSE 0.3 END AS reliability FROM tails")
def _(spark, d):
    """Paths of one edge promote to the edge itself, which is there already: its reliability is raised, never lowered."""
    edges = _unary(spark, d).withColumn("reliability", F.lit(0.3))
    strong = edges.withColumn("reliability", F.when((F.get("tail", F.lit(0))["t"] / 1_000_000).cast("long") % 2 == 0, 0.6).otherwise(0.1))
    paths = edges.select(F.col("head").alias("target"), F.array("id").alias("edges"), F.lit(1.0).alias("score"), F.lit(1).alias("length"), F.col("id").alias("label"))
    made = abstraction.higher_order(paths, strong).select(*edges.columns)
    raised = grow.edge_key(made).groupBy("key_head", "key_tail").agg(F.max("reliability").alias("to"))
    return abstraction.raise_known(edges, raised).select("id", "reliability")


@query("step_targets", f"""WITH RECURSIVE {STEP}{_SHARES}, updated AS (SELECT count(*) AS k FROM shares WHERE share > 0) SELECT * FROM (
  SELECT 'n_events' AS metric, (SELECT count(*) FROM ev) AS value UNION ALL SELECT 'n_vertices_new', (SELECT count(*) FROM vx) UNION ALL SELECT 'n_candidates', (SELECT count(*) FROM picked) UNION ALL SELECT 'n_admitted', (SELECT count(*) FROM en)
  UNION ALL SELECT 'n_hyperpaths', (SELECT count(*) FROM best) UNION ALL SELECT 'n_edges_updated', (SELECT k FROM updated) UNION ALL SELECT 'n_pruned', 0 UNION ALL SELECT 'n_promoted', 0)""")
def _(spark, d):
    events = _events(spark, d)
    cfg = EngineConfig(grow=GROW, traverse=TraverseConfig(horizon=12 * HOUR, beam_size=4))
    got = engine.Engine(tables.ring_connectivity(tables.vertices(events)), cfg).step(engine.empty(spark), events, _targets(spark, d)).metrics
    return spark.createDataFrame(list(got.items()), "metric string, value bigint")


@query("step_gated", f"WITH {NEAR} SELECT * FROM (SELECT 'n_grow_checked' AS metric, (SELECT count(*) FROM tails) AS value UNION ALL SELECT 'n_grow_infeasible', (SELECT count(*) FROM tails WHERE (pt // 1000000) % 3 = 0) UNION ALL SELECT 'n_admitted', (SELECT count(*) FROM tails WHERE (pt // 1000000) % 3 <> 0))")
def _(spark, d):
    events = _events(spark, d)
    feasible = lambda tail, head: (F.get(tail, F.lit(0))["t"] / 1_000_000).cast("long") % 3 != 0
    cfg = EngineConfig(grow=UNARY, gate=GateConfig(True, "hard", ("grow",)))
    got = engine.Engine(tables.ring_connectivity(tables.vertices(events)), cfg, feasible).step(engine.empty(spark), events).metrics
    return spark.createDataFrame([(k, got[k]) for k in ("n_grow_checked", "n_grow_infeasible", "n_admitted")], "metric string, value bigint")


@query("connected", f"WITH {MIXED} SELECT id FROM en WHERE NOT list_bool_or(list_transform(new, lambda x: (x.t // 1000000) % 11 = 0))")
def _(spark, d):
    vertices, edges = _mixed(spark, d)
    return grow.connected(edges, vertices.where((F.col("t") / 1_000_000).cast("long") % 11 != 0)).select("id")


@query("admissible", f"WITH {MIXED} SELECT id, list_bool_and(list_transform(new, lambda x: x.t BETWEEN t - {3 * HOUR} AND t - {HOUR})) AS ok FROM en")
def _(spark, d):
    return _mixed(spark, d)[1].select("id", ids.admissible(F.col("tail"), F.col("head.t"), F.lit(HOUR), F.lit(3 * HOUR)).alias("ok"))


@query("parsed_ids", f"WITH {MIXED} SELECT id, n || '@' || t AS head, n, t, list_sort(list_transform(new, lambda x: x.n || '@' || x.t))[1] AS tail, len(new) AS size FROM en")
def _(spark, d):
    parsed = _mixed(spark, d)[1].select("id", ids.parse_edge(F.col("id")).alias("e"))
    v = ids.parse_vertex(F.col("e.head"))
    return parsed.select("id", "e.head", v["n"].alias("n"), v["t"].alias("t"), F.get("e.tail", F.lit(0)).alias("tail"), F.size("e.tail").alias("size"))


@query("edge_set", f"WITH {MIXED} SELECT n || '@' || t AS head, array_to_string(list_sort(list_transform(new, lambda x: x.n || '@' || x.t)), ',') AS tail, (1.0 + s) / (2.0 + s + m) >= 0.7 AS frozen FROM en")
def _(spark, d):
    frozen = rewrite.apply_freeze(_mixed(spark, d)[1], 0.7)
    return rewrite.edge_set(frozen).select("head", F.array_join("tail", ",").alias("tail"), "frozen")


@query("dpo_grow", f"WITH {NEAR}, e AS (SELECT n || '@' || t || '&' || pre || '@' || pt || '#' || t AS id, t, pt FROM tails) SELECT id, CASE WHEN (pt // 1000000) % 3 = 0 THEN 'unary' ELSE 'dpo:grow' END AS provenance, CASE WHEN (pt // 1000000) % 3 = 0 THEN {6 * HOUR} ELSE t - pt END AS delta_max FROM e")
def _(spark, d):
    edges, vertices = _unary(spark, d), tables.vertices(_events(spark, d))
    known = edges.where((F.get("tail", F.lit(0))["t"] / 1_000_000).cast("long") % 3 == 0)
    return rewrite.apply_grow(known, vertices, edges.select("head", "tail")).select("id", "provenance", "delta_max")


@query("same_graph", "SELECT true AS same, false AS other")
def _(spark, d):
    edges = _unary(spark, d)
    return spark.createDataFrame([(rewrite.same_graph(edges, edges.repartition(3)), rewrite.same_graph(edges, rewrite.apply_freeze(edges, 0.7)))], "same boolean, other boolean")


@query("removed_edges", f"WITH {UN} SELECT id FROM un WHERE r < 0.5")
def _(spark, d):
    edges = _unary(spark, d)
    return grow.remove(edges, edges.where(F.col("reliability") >= 0.5)).select("id")


@query("critical_pairs", f"""WITH {UN}, c AS (SELECT id, (t // 1000000) % 3 <> 0 AS there, r FROM un),
mt AS (SELECT id, 'grow' AS rule FROM c UNION ALL SELECT id, 'prune' FROM c WHERE there AND r <= 0.5 UNION ALL SELECT id, 'freeze' FROM c WHERE there AND r >= 0.4),
pr AS (SELECT x.rule AS a, y.rule AS b, id FROM mt x JOIN mt y USING (id) WHERE x.rule < y.rule)
SELECT a, b, id, NOT (a = 'grow' AND b = 'prune') AS joinable FROM pr""")
def _(spark, d):
    """All unary candidates may grow, and two thirds of them are in the graph, where pruning and freezing overlap from 0.4 to 0.5."""
    made = _unary(spark, d)
    edges = made.where((F.col("head.t") / 1_000_000).cast("long") % 3 != 0)
    rules = [rewrite.Rule("grow", "GROW"), rewrite.Rule("prune", "PRUNE", 0.5), rewrite.Rule("freeze", "FREEZE", 0.4)]
    return rewrite.overlaps(rules, edges, made).select("a", "b", ids.edge_id(F.col("key_head"), F.col("key_tail")).alias("id"), "joinable")


_RULES = f"SELECT user_id || '@' || epoch_us(ts) // {24 * HOUR} AS system, CASE event_type WHEN 'signup' THEN 'GROW' WHEN 'error' THEN 'PRUNE' ELSE 'FREEZE' END AS kind, CASE WHEN user_id % 3 = 0 THEN user_id END AS max_grow FROM events"


@query("termination", f"WITH rules AS ({_RULES}) SELECT system, CASE WHEN bool_or(kind = 'GROW') AND max(max_grow) IS NULL THEN 'unknown' ELSE 'true' END AS ends, bool_or(kind = 'GROW') AND max(max_grow) IS NOT NULL AS bounded FROM rules GROUP BY system")
def _(spark, d):
    """A neuron's events of a day are the rules of a system, which differ in whether they grow; every third neuron's have a bound."""
    kind = F.when(F.col("event_type") == "signup", "GROW").when(F.col("event_type") == "error", "PRUNE").otherwise("FREEZE")
    system = F.concat(F.col("n").cast("string"), F.lit("@"), F.floor(F.col("t") / (24 * HOUR)).cast("string"))
    rules = _events(spark, d).select(system.alias("system"), kind.alias("kind"), F.when(F.col("n") % 3 == 0, F.col("n")).alias("max_grow"))
    return rewrite.termination(rules)


# ---------------------------------------------------------------- sources, encoders and streams


@query("layered_edges", "WITH m AS (SELECT count(DISTINCT event_type) AS fan, count(DISTINCT user_id) AS layers FROM events) SELECT (l + 1) * fan + i AS head_n, (l + 1) * 100 AS head_t, l * fan + j AS tail_n, l * 100 AS tail_t FROM m, (SELECT unnest(range((SELECT layers FROM m))) AS l), (SELECT unnest(range((SELECT fan FROM m))) AS i), (SELECT unnest(range((SELECT fan FROM m))) AS j)")
def _(spark, d):
    """A layer for each neuron of the table, as wide as it has types of events."""
    size = _events(spark, d).agg(F.count_distinct("event_type").alias("fan"), F.count_distinct("n").alias("layers")).first()
    v = F.get("tail", F.lit(0))
    return tables.layered_edges(spark, size["fan"], size["layers"]).select(F.col("head.n").alias("head_n"), F.col("head.t").alias("head_t"), v["n"].alias("tail_n"), v["t"].alias("tail_t"))


@query("sorted_rank", f"WITH {EV} SELECT n, t, event_id, row_number() OVER (ORDER BY t, n, event_id) - 1 AS rank FROM ev")
def _(spark, d):
    return transforms.global_rank(_events(spark, d), "t", "n", "event_id").select("n", "t", "event_id", "rank")


@query("binned_lists", f"WITH {EV} SELECT (t - {T0}) // {HOUR} AS bin, string_agg(n || '@' || t, ',' ORDER BY t, n) AS members FROM ev WHERE t BETWEEN {T0} AND {T1} GROUP BY 1")
def _(spark, d):
    bins = transforms.chunk_by_bins(_events(spark, d), T0, T1, HOUR)
    return bins.select("bin", F.array_join(F.transform("events", lambda e: F.concat(e["n"].cast("string"), F.lit("@"), e["t"].cast("string"))), ",").alias("members"))


@query("baseline_columns", f"WITH {EV}, a AS (SELECT DISTINCT n FROM (SELECT n FROM ev UNION ALL SELECT unnest(range(0, 3000)))) SELECT n, row_number() OVER (ORDER BY n) - 1 AS col FROM a")
def _(spark, d):
    return encoders.neuron_columns(_events(spark, d), 3000)


@query("encoder_by_name", f"WITH {EV} SELECT 'binner' AS name, (t - {T0}) // {HOUR} AS bin, n, 1.0::DOUBLE AS value FROM ev WHERE t BETWEEN {T0} AND {T1} GROUP BY 2, 3")
def _(spark, d):
    return encoders.get_encoder("simple")(_events(spark, d), T0, T1, HOUR).select(F.lit("binner").alias("name"), "bin", "n", "value")


@query("retained_events", f"WITH {EV} SELECT n, t, event_id FROM (SELECT *, max(t) OVER (PARTITION BY n) AS last FROM ev) WHERE t >= last - {24 * HOUR} AND t >= {T0}")
def _(spark, d):
    kept = buffer.retained(_events(spark, d), buffer.BufferConfig(horizon=24 * HOUR))
    return buffer.prune_before(kept, T0).select("n", "t", "event_id")


@query("watermark", f"WITH {EV} SELECT max(t) AS watermark FROM ev")
def _(spark, d):
    return spark.createDataFrame([(buffer.Watermark().batch(_events(spark, d)),)], "watermark bigint")


@query("delay_classes", f"WITH {UN} SELECT id, coalesce(list_filter([1, 2, 3, 5, 7, 10, 15, 20, 25, 30], lambda b: b >= ceil((t - pt) // 1000000 / 1000.0))[1], 30) AS bucket FROM un")
def _(spark, d):
    """Delays here are hours, so a thousandth of a thousandth of them is looked up."""
    delay = F.floor((F.col("head.t") - F.get("tail", F.lit(0))["t"]) / 1_000_000)
    return _unary(spark, d).select("id", ids.delay_bucket(delay).alias("bucket"))


@query("edge_json", """WITH {0} SELECT id, '{{"head":{{"n":' || n || ',"t":' || t || '}},"counts_miss":' || m || ',"last_update_t":' || t || '}}' AS body FROM un""".format(UN))
def _(spark, d):
    return _unary(spark, d).select("id", ids.as_json("head", "counts_miss", "last_update_t").alias("body"))


@query("rated_labels", f"WITH {UN} SELECT id, 'HEAD:' || n || '|EDGES:[(''' || n || ''', ((''' || pre || ''', ' || round_even((t - pt) / 1000000.0, 0)::BIGINT || '),), ''' || printf('%.3f', round_even(r, 3)) || ''')]' AS structure FROM un")
def _(spark, d):
    return _unary(spark, d).select("id", ids.structural_label(F.col("head"), F.array(F.struct("head", "tail", "reliability")), 1_000_000.0, True).alias("structure"))


# ---------------------------------------------------------------- evaluation and runs

_BUNDLE = f"""{_PRED_SQL}, c AS (SELECT unnest(range(0, 10)) AS k), cell AS (SELECT k, (SELECT count(*) FROM p WHERE y_true = k AND y_pred = k)::DOUBLE AS tp, (SELECT count(*) FROM p WHERE y_pred = k)::DOUBLE AS pr, (SELECT count(*) FROM p WHERE y_true = k)::DOUBLE AS su FROM c),
pc AS (SELECT k, tp / (pr + 1e-12) AS precision, tp / (su + 1e-12) AS recall, su AS support FROM cell), f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM pc), acc AS (SELECT avg((y_true = y_pred)::INT)::DOUBLE AS a FROM p)
SELECT metric, k, round(value, 9) AS value FROM (
  SELECT 'accuracy' AS metric, NULL::BIGINT AS k, a AS value FROM acc UNION ALL SELECT 'micro_precision', NULL, a FROM acc UNION ALL SELECT 'micro_recall', NULL, a FROM acc UNION ALL SELECT 'micro_f1', NULL, a FROM acc
  UNION ALL SELECT 'macro_precision', NULL, avg(precision) FROM f UNION ALL SELECT 'macro_recall', NULL, avg(recall) FROM f UNION ALL SELECT 'macro_f1', NULL, avg(f1) FROM f
  UNION ALL SELECT 'precision_per_class', k, precision FROM f UNION ALL SELECT 'recall_per_class', k, recall FROM f UNION ALL SELECT 'f1_per_class', k, f1 FROM f UNION ALL SELECT 'support_per_class', k, support FROM f)"""


@query("evaluate", f"WITH {_BUNDLE}")
def _(spark, d):
    return evaluate.evaluate(_predictions(spark, d), pred="y_pred", n_classes=10).withColumn("value", F.round("value", 9))


@query("evaluate_running", f"WITH {_BUNDLE}")
def _(spark, d):
    rows, running = _predictions(spark, d), evaluate.Running(10)
    for k in range(3):
        running.add(rows.where(F.pmod(F.xxhash64("y_true", "y_pred"), F.lit(3)) == k))
    return running.finish(spark).withColumn("value", F.round("value", 9))


@query("argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS best FROM embeddings")
def _(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", metrics.argmax(F.col("embedding")).alias("best"))


@query("labels_checked", "SELECT vec_id, label::BIGINT AS label FROM embeddings")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").cast("double").alias("label"))
    return evaluate.integer_labels(rows, "label", n_classes=10)


_RUNS = "r AS (SELECT event_type AS run, event_id % 5 AS k, avg(value) AS value FROM events GROUP BY 1, 2)"


@query("bundles_aggregated", f"WITH {_RUNS} SELECT 'm' AS metric, k, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n FROM r GROUP BY k")
def _(spark, d):
    runs = _events(spark, d).groupBy(F.col("event_type").alias("run"), (F.col("event_id") % 5).alias("k")).agg(F.avg("value").alias("value"))
    return evaluate.aggregate(runs.withColumn("metric", F.lit("m"))).select("metric", "k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("groups_aggregated", "WITH r AS (SELECT event_type AS grp, user_id % 10 AS seq, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT grp, count(*) AS n, round(avg(mean), 6) AS group_mean, string_agg('r' || seq, ',' ORDER BY seq) AS labels FROM r GROUP BY 1")
def _(spark, d):
    runs = _events(spark, d).groupBy(F.col("event_type").alias("grp"), (F.col("n") % 10).alias("seq")).agg(F.avg("value").alias("mean"))
    made = evaluate.aggregate_groups(runs.select("grp", "seq", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("label"), "mean", F.col("mean").alias("lo"), F.col("mean").alias("hi")))
    return made.select("grp", "n", F.round("group_mean", 6).alias("group_mean"), F.array_join("series.label", ",").alias("labels"))


_SIDES = "p AS (SELECT event_type AS label, user_id % 2 AS side, greatest(0.05, least(0.95, avg(value) / (1 + max(value)))) AS mean FROM events GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY label) - 1 AS seq FROM p)"


@query("effects_by_name", f"WITH {_SIDES}, j AS (SELECT a.label AS name_a, b.label AS name_b, a.mean AS ma, b.mean AS mb, 0.2 / (2 * 1.959963984540054) AS sa, 0.3 / (2 * 1.959963984540054) AS sb FROM w a JOIN w b ON a.label = b.label AND a.side = 0 AND b.side = 1), d AS (SELECT *, (ma - mb) / sqrt((sa * sa + sb * sb) / 2) AS d, greatest(1.0, ma * (1 - ma) / (sa * sa) + mb * (1 - mb) / (sb * sb) - 2) AS dof FROM j) SELECT name_a, name_b, round(d, 6) AS cohen_d, round(d * CASE WHEN dof > 3 THEN 1 - 3 / (4 * dof - 1) ELSE 1 END, 6) AS hedges_g FROM d")
def _(spark, d):
    mean = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.avg("value") / (1 + F.max("value"))))
    runs = _events(spark, d).groupBy(F.col("event_type").alias("label"), (F.col("n") % 2).alias("side")).agg(mean.alias("mean")).withColumn("seq", F.xxhash64("label"))
    sides = [runs.where(F.col("side") == k).select("seq", "label", "mean", (F.col("mean") - w).alias("lo"), (F.col("mean") + w).alias("hi")) for k, w in ((0, 0.1), (1, 0.15))]
    return evaluate.effect_sizes(*sides, by="name").select("name_a", "name_b", F.round("cohen_d", 6).alias("cohen_d"), F.round("hedges_g", 6).alias("hedges_g"))


@query("metrics_compared", "SELECT event_type AS metric, avg(value) FILTER (user_id % 2 = 0) IS NOT DISTINCT FROM avg(value) FILTER (user_id % 2 = 1) AS equal FROM events GROUP BY 1")
def _(spark, d):
    sides = [_events(spark, d).where(F.col("n") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")) for k in (0, 1)]
    return artifacts.compare_metrics(*sides).select("metric", "equal")


@query("totals", "SELECT event_type AS metric, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1")
def _(spark, d):
    steps = _events(spark, d).select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    return artifacts.step_totals(steps).select("metric", F.round("total", 4).alias("total"), "n")


@query("reliability_summary", f"WITH {UN}, top AS (SELECT id, (s + 1.0) / (s + m + 2.0) AS mean FROM un ORDER BY t DESC, r DESC, id LIMIT 10) SELECT round(avg(mean), 9) AS mean_reliability, string_agg(id, ';' ORDER BY id) AS ids FROM top")
def _(spark, d):
    made = evaluate.reliability_summary(_unary(spark, d), 10, CardConfig(samples=500))
    return made.select(F.round("mean_reliability", 9).alias("mean_reliability"), F.array_join("edges.id", ";").alias("ids"))


@query("folds_train", "WITH f AS (SELECT vec_id AS id, (row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings) SELECT id FROM f WHERE fold <> 2")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"))
    return evaluate.split(stats.stratified_folds(rows, 5), 2)[0].select("id")


# ---------------------------------------------------------------- statistics

_PAIRS = "p AS (SELECT l_quantity AS x, 25 + l_discount * 10 AS y, x - y AS d FROM lineitem)"


@query("mean_interval", "SELECT round(avg(l_quantity), 6) AS mean, round(1.9599 * stddev_samp(l_quantity) / sqrt(count(*)), 2) AS half FROM lineitem")
def _(spark, d):
    mean, lo, hi = stats.mean_ci(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("value")))
    return spark.createDataFrame([(round(mean, 6), round((hi - lo) / 2, 2))], "mean double, half double")


@query("paired_t", f"WITH {_PAIRS} SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, round(avg(d) / stddev_samp(d), 6) AS d FROM p")
def _(spark, d):
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"), (25 + F.col("l_discount") * 10).cast("double").alias("y"))
    got = stats.paired_ttest(pairs)
    return spark.createDataFrame([(round(got["t"], 4), round(got["d"], 6))], "t double, d double")


@query("wilcoxon", f"WITH {_PAIRS}, g AS (SELECT abs(round(d, 2)) AS a, count(*) AS n, count(*) FILTER (round(d, 2) > 0) AS up FROM p WHERE round(d, 2) <> 0 GROUP BY 1), k AS (SELECT *, coalesce(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM g), z AS (SELECT sum(rank * up) AS w, sum(n)::DOUBLE AS n, sum(n::DOUBLE ** 3 - n) AS ties FROM k) SELECT round(least(w, n * (n + 1) / 2 - w), 1) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(n), 6) AS r FROM z")
def _(spark, d):
    x = F.round(F.col("l_quantity").cast("double") - (25 + F.col("l_discount").cast("double") * 10), 2)
    got = stats.wilcoxon(spark.read.parquet(f"{d}/lineitem.parquet").select(x.alias("x"), F.lit(0.0).alias("y")))
    return spark.createDataFrame([(round(float(got["w"]), 1), round(float(got["r"]), 6))], "w double, r double")


@query("special_values", "SELECT event_type AS name, round(1.959963984540054 * stddev_samp(value) / sqrt(count(value)), 6) AS z05, round(2.5758293035489004 * stddev_samp(value) / sqrt(count(value)), 6) AS z01, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def _(spark, d):
    """Half widths of normal intervals at two levels, and linear quantiles, of each type of events."""
    from ..functions.special import z_for_alpha

    half = lambda alpha: F.round(z_for_alpha(alpha) * F.stddev_samp("value") / F.sqrt(F.count("value")), 6)
    at = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return _events(spark, d).groupBy(F.col("event_type").alias("name")).agg(half(0.05).alias("z05"), half(0.01).alias("z01"), at(0.5).alias("median"), at(0.9).alias("p90"))


@query("resisted", f"WITH {UN} SELECT id, CASE WHEN r >= 0.7 THEN 0.25 * (1 - 0.8) ELSE 0.25 END AS scaled, CASE WHEN r >= 0.7 THEN 0.0 ELSE 0.25 END AS fixed, 'task:' || pre AS region FROM un")
def _(spark, d):
    strength = F.when(F.col("reliability") >= 0.7, F.lit(0.8))
    pre = F.get("tail", F.lit(0))["n"].cast("string")
    return _unary(spark, d).select("id", policy.resisted(F.lit(0.25), strength).alias("scaled"), policy.resisted(F.lit(0.25), strength, "immutable").alias("fixed"), policy.region_tag("task", pre).alias("region"))


@query("fingerprints", """WITH ev AS (SELECT event_id, '{"a":' || user_id || ',"b":"' || event_type || '"}' AS body FROM events) SELECT event_id, sha256(body) AS fingerprint FROM ev""")
def _(spark, d):
    """What a configuration's fingerprint is, over rows: SHA-256 of compact JSON with sorted keys."""
    return _events(spark, d).select("event_id", F.sha2(F.to_json(F.struct(F.col("n").alias("a"), F.col("event_type").alias("b"))), 256).alias("fingerprint"))


@query("rewritten_step", f"WITH {NEAR} SELECT * FROM (SELECT 'n_admitted' AS metric, (SELECT count(*) FROM tails) AS value UNION ALL SELECT 'n_grown', (SELECT count(*) FROM tails))")
def _(spark, d):
    events = _events(spark, d)
    cfg = EngineConfig(grow=UNARY, rewrite=RewriteConfig(enabled=True))
    out = engine.Engine(tables.ring_connectivity(tables.vertices(events)), cfg).step(engine.empty(spark), events)
    grown = out.state.edges.where("provenance = 'dpo:grow'").count()
    return spark.createDataFrame([("n_admitted", out.metrics["n_admitted"]), ("n_grown", grown)], "metric string, value bigint")
