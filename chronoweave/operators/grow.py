"""Candidate hyperedges: lookback top-k, time clusters, combinations and a budget, for all heads at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import GrowConfig
from ..functions import ids


def refractory_ok(vertices: DataFrame, rho: int, heads: DataFrame | None = None) -> DataFrame:
    """Heads without a vertex of their own neuron in [t - rho + 1, t - 1]."""
    heads = vertices if heads is None else heads
    if rho <= 0:
        return heads
    before = F.lag("t").over(W.partitionBy("n").orderBy("t"))
    free = vertices.withColumn("before", before).where(F.col("before").isNull() | (F.col("t") - F.col("before") >= rho)).select("n", "t")
    return free if heads is vertices else heads.join(free, ["n", "t"], "left_semi")


def lookback(heads: DataFrame, vertices: DataFrame, connectivity: DataFrame, cfg: GrowConfig) -> DataFrame:
    """(n, t, pre, pt): for each head and source neuron its k latest vertices in [t - delay_max, t - delay_min].

    Time is cut into buckets as wide as the interval, and a vertex stands in its
    own and the next, so the bucket of an interval's end holds all of it.  There
    vertices and interval ends are sorted once: each vertex carries the last ones
    up to itself, and an end takes what the vertex before it carries.  So a busy
    neuron costs a sort, not its heads times its vertices.
    """
    if cfg.delay_max < cfg.delay_min or cfg.k <= 0:
        return heads.limit(0).select("n", "t", F.col("n").alias("pre"), F.col("t").alias("pt"))
    width = max(1, cfg.delay_max - cfg.delay_min)
    bucket = lambda x: F.floor(x / width).cast("long")
    asked = heads.select("n", "t").join(connectivity, heads["n"] == connectivity["post"]).select("pre", "n", (F.col("t") - cfg.delay_min).alias("at"))
    given = vertices.select(F.col("n").alias("pre"), F.col("t").alias("at")).select("pre", "at", F.explode(F.array(bucket(F.col("at")), bucket(F.col("at")) + 1)).alias("bucket"))
    by_time = W.partitionBy("pre", "bucket").orderBy("at")
    itself = int(cfg.delay_min <= 0)  # a head may be its own latest vertex, which doesn't count
    carried = F.array_compact(F.array(*[F.lag("at", i).over(by_time) for i in range(cfg.k + itself)]))
    none = F.lit(None).cast("bigint")
    rows = given.select("pre", "bucket", "at", F.lit(0).alias("kind"), none.alias("n"), carried.alias("recent"))
    rows = rows.unionByName(asked.select("pre", bucket(F.col("at")).alias("bucket"), "at", F.lit(1).alias("kind"), "n", F.lit(None).cast("array<bigint>").alias("recent")))
    upto = W.partitionBy("pre", "bucket").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("recent", F.last("recent", ignorenulls=True).over(upto)).where("kind = 1").withColumn("t", F.col("at") + cfg.delay_min)
    inside = F.filter("recent", lambda pt: (pt >= F.col("t") - cfg.delay_max) & ((F.col("n") != F.col("pre")) | (F.col("t") != pt)))
    return found.select("n", "t", "pre", F.explode(F.slice(inside, 1, cfg.k)).alias("pt"))


def clusters(tails: DataFrame, delta: int) -> DataFrame:
    """tails with (cluster, idx): single linkage in time, gap to the one before <= delta; idx counts within the head."""
    order = W.partitionBy("n", "t").orderBy("pt", "pre")
    gap = F.coalesce((F.col("pt") - F.lag("pt").over(order) > delta).cast("int"), F.lit(0))
    return tails.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(order)).withColumn("idx", F.row_number().over(order)).drop("gap")


def combinations(tails: DataFrame, cfg: GrowConfig) -> DataFrame:
    """(n, t, tail, size, idx): single tails, and pairs and triples within clusters."""
    v = lambda a: F.struct(F.col(f"{a}.pre").alias("n"), F.col(f"{a}.pt").alias("t"))
    numbered = clusters(tails, cfg.causal_coincidence_delta)
    out = numbered.alias("a").select("n", "t", F.array(v("a")).alias("tail"), F.array("a.idx").alias("idx"))
    same = lambda x: (F.col("a.n") == F.col(f"{x}.n")) & (F.col("a.t") == F.col(f"{x}.t")) & (F.col("a.cluster") == F.col(f"{x}.cluster"))
    if cfg.combination_order_max >= 2 and cfg.causal_coincidence_delta > 0:
        two = numbered.alias("a").join(numbered.alias("b"), same("b") & (F.col("a.idx") < F.col("b.idx")))
        out = out.unionByName(two.select("a.n", "a.t", F.array(v("a"), v("b")).alias("tail"), F.array("a.idx", "b.idx").alias("idx")))
        if cfg.combination_order_max >= 3:
            three = two.join(numbered.alias("c"), same("c") & (F.col("b.idx") < F.col("c.idx")))
            out = out.unionByName(three.select("a.n", "a.t", F.array(v("a"), v("b"), v("c")).alias("tail"), F.array("a.idx", "b.idx", "c.idx").alias("idx")))
    return out.withColumn("size", F.size("tail"))


def within_budget(tails: DataFrame, cfg: GrowConfig) -> DataFrame:
    """combinations(), cut to each head's budget: fewer tails first, then the later latest tail, then the order of tails.

    A size is made only for heads whose smaller sizes leave room, so what is
    made and not kept stays below a budget's square a head.
    """
    budget, head = cfg.budget_per_head, W.partitionBy("n", "t")
    v = lambda a: F.struct(F.col(f"{a}.pre").alias("n"), F.col(f"{a}.pt").alias("t"))
    first = lambda *by: F.row_number().over(head.orderBy(*by))
    numbered = clusters(tails, cfg.causal_coincidence_delta).withColumn("used", F.count(F.lit(1)).over(head))
    one = numbered.withColumn("place", first(F.desc("pt"), "idx")).where(F.col("place") <= budget)
    out = one.alias("a").select("n", "t", F.array(v("a")).alias("tail"), F.lit(1).alias("size"))
    if cfg.combination_order_max < 2 or cfg.causal_coincidence_delta <= 0:
        return out
    open_ = numbered.where(F.col("used") < budget)
    same = lambda x, y: (F.col(f"{x}.n") == F.col(f"{y}.n")) & (F.col(f"{x}.t") == F.col(f"{y}.t")) & (F.col(f"{x}.cluster") == F.col(f"{y}.cluster")) & (F.col(f"{x}.idx") < F.col(f"{y}.idx"))
    two = open_.alias("a").join(open_.alias("b"), same("a", "b"))
    two = two.select("a.n", "a.t", "a.cluster", F.col("b.idx").alias("idx"), F.array("a.idx", "b.idx").alias("places"), F.array(v("a"), v("b")).alias("tail"), F.greatest("a.pt", "b.pt").alias("latest"), "a.used")
    two = two.withColumn("place", first(F.desc("latest"), "places")).withColumn("pairs", F.count(F.lit(1)).over(head))
    out = out.unionByName(two.where(F.col("used") + F.col("place") <= budget).select("n", "t", "tail", F.lit(2).alias("size")))
    if cfg.combination_order_max < 3:
        return out
    two = two.where(F.col("used") + F.col("pairs") < budget).select("n", "t", "cluster", "idx", "places", "tail", "latest", (F.col("used") + F.col("pairs")).alias("used"))
    three = two.alias("a").join(open_.alias("b"), same("a", "b"))
    three = three.select("a.n", "a.t", F.array_append("a.tail", v("b")).alias("tail"), F.array_append("a.places", F.col("b.idx")).alias("places"), F.greatest("a.latest", "b.pt").alias("latest"), "a.used")
    three = three.withColumn("place", first(F.desc("latest"), "places")).where(F.col("used") + F.col("place") <= budget)
    return out.unionByName(three.select("n", "t", "tail", F.lit(3).alias("size")))


def candidates(vertices: DataFrame, connectivity: DataFrame, cfg: GrowConfig, heads: DataFrame | None = None) -> DataFrame:
    """Edges of the heads (by default all vertices), within the budget of each: fewer tails first, then later ones."""
    heads = refractory_ok(vertices, cfg.refractory_rho, heads)
    tails = lookback(heads, vertices, connectivity, cfg)
    made = within_budget(tails, cfg) if cfg.budget_per_head > 0 else combinations(tails, cfg)
    head = F.struct("n", "t")
    return made.select(
        ids.edge_id(F.struct("n", "t"), F.col("tail")).alias("id"),
        head.alias("head"),
        "tail",
        F.lit(max(0, cfg.delay_min)).cast("long").alias("delta_min"),
        F.lit(max(0, cfg.delay_min, cfg.delay_max)).cast("long").alias("delta_max"),
        F.lit(cfg.refractory_rho).cast("long").alias("rho"),
        F.lit(cfg.init_reliability).alias("reliability"),
        F.lit(0).cast("long").alias("counts_success"),
        F.lit(0).cast("long").alias("counts_miss"),
        F.lit(None).cast("long").alias("last_update_t"),
        F.get(F.array(F.lit("unary"), F.lit("pair"), F.lit("triple")), F.col("size") - 1).alias("provenance"),
        F.lit(False).alias("frozen"),
    )


def edge_key(edges: DataFrame) -> DataFrame:
    """edges with the key (head, tail as a sorted set) that admission compares."""
    return edges.withColumn("key_head", F.struct("head.n", "head.t")).withColumn("key_tail", F.array_sort("tail"))


def admit(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The new edges whose head and tail stand neither in edges nor earlier in new."""
    first = edge_key(new).withColumn("rank", F.row_number().over(W.partitionBy("key_head", "key_tail").orderBy("id"))).where("rank = 1").drop("rank")
    known = edge_key(edges).select("key_head", "key_tail")
    return first.join(known, ["key_head", "key_tail"], "left_anti").select(*new.columns)


def most_recent(heads: DataFrame, connectivity: DataFrame, vertices: DataFrame, delay_min: int, delay_max: int) -> DataFrame:
    """As-of join: for each head and source neuron its latest vertex in [t - delay_max, t - delay_min)."""
    return lookback(heads, vertices, connectivity, GrowConfig(k=1, delay_min=delay_min + 1, delay_max=delay_max))


def get_vertex(vertices: DataFrame, n: int, t: int) -> DataFrame:
    return vertices.where((F.col("n") == n) & (F.col("t") == t))


def get_edge(edges: DataFrame, id: str) -> DataFrame:
    return edges.where(F.col("id") == id)


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those whose ids stand in gone (id)."""
    return edges.join(gone.select("id"), "id", "left_anti").select(*edges.columns)


def incoming(edges: DataFrame, n: int, t: int) -> DataFrame:
    return edges.where((F.col("head.n") == n) & (F.col("head.t") == t))


def outgoing(edges: DataFrame, n: int, t: int) -> DataFrame:
    return edges.where(F.exists("tail", lambda v: (v["n"] == n) & (v["t"] == t)))


def incident(edges: DataFrame, n: int, t: int) -> DataFrame:
    """edges of a vertex with their ``side``, out or in, found in one pass; an edge of both sides stands twice."""
    out = F.when(F.exists("tail", lambda v: (v["n"] == n) & (v["t"] == t)), "out")
    into = F.when((F.col("head.n") == n) & (F.col("head.t") == t), "in")
    return edges.withColumn("side", F.explode(F.array_compact(F.array(out, into))))


def connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges all of whose tail vertices exist."""
    tails = edges.select("id", F.size("tail").alias("need"), F.explode("tail").alias("v")).select("id", "need", "v.n", "v.t")
    whole = tails.join(vertices, ["n", "t"], "left_semi").groupBy("id", "need").agg(F.count(F.lit(1)).alias("have")).where("need = have").select("id")
    return edges.join(whole, "id", "left_semi")


def snapshot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    return vertices.agg(F.count(F.lit(1)).alias("num_vertices")).join(edges.agg(F.count(F.lit(1)).alias("num_edges")), F.lit(True))
