"""Graph rewriting: grow, prune and freeze rules, their critical pairs and termination."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .grow import admit, connected, edge_key


def apply_grow(edges: DataFrame, vertices: DataFrame, new: DataFrame) -> DataFrame:
    """edges and those of new (head, tail) whose vertices exist and that aren't there yet."""
    delays = F.transform("tail", lambda v: F.col("head.t") - v["t"])
    made = new.select(
        ids.edge_id(F.col("head"), F.col("tail")).alias("id"), "head", "tail", F.lit(0).cast("long").alias("delta_min"), F.greatest(F.lit(0).cast("long"), F.array_max(delays)).alias("delta_max"),
        F.lit(0).cast("long").alias("rho"), F.lit(0.10).alias("reliability"), F.lit(0).cast("long").alias("counts_success"), F.lit(0).cast("long").alias("counts_miss"), F.lit(None).cast("long").alias("last_update_t"),
        F.lit("dpo:grow").alias("provenance"), F.lit(False).alias("frozen"),
    )
    made = connected(made.join(vertices, (F.col("head.n") == vertices["n"]) & (F.col("head.t") == vertices["t"]), "left_semi"), vertices)
    return edges.unionByName(admit(edges, made).select(*edges.columns))


def as_rule(new: DataFrame) -> DataFrame:
    """New edges as the growth rule makes them: with their observed delays and its provenance."""
    return new.withColumn("delta_min", F.lit(0).cast("long")).withColumn("delta_max", F.greatest(F.lit(0).cast("long"), F.array_max(F.transform("tail", lambda v: F.col("head.t") - v["t"])))).withColumn("provenance", F.lit("dpo:grow"))


def apply_prune(edges: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Edges whose posterior mean is above the threshold."""
    return edges.where(ids.posterior_mean(F.col("counts_success"), F.col("counts_miss")) > threshold)


def pruned(edges: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Edges that apply_prune() takes."""
    return edges.where(ids.posterior_mean(F.col("counts_success"), F.col("counts_miss")) <= threshold)


def apply_freeze(edges: DataFrame, threshold: float = 0.95) -> DataFrame:
    return edges.withColumn("frozen", F.col("frozen") | (ids.posterior_mean(F.col("counts_success"), F.col("counts_miss")) >= threshold))


def edge_set(edges: DataFrame) -> DataFrame:
    """What two graphs are compared by."""
    return edges.select(ids.tail_ids(F.col("tail")).alias("tail"), ids.vertex_id(F.col("head")).alias("head"), "frozen").distinct()


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    shape = lambda edges, side: edges.select(ids.tail_ids(F.col("tail")).alias("tail"), ids.vertex_id(F.col("head")).alias("head"), "frozen", F.lit(side).alias("side"))
    return shape(a, 1).unionByName(shape(b, 2)).groupBy("head", "tail", "frozen").agg(F.bit_or("side").alias("sides")).where("sides <> 3").isEmpty()


@dataclass(frozen=True)
class Rule:
    """kind is GROW, PRUNE or FREEZE; a match names an edge, by (head, tails), with its counts."""

    name: str
    kind: str
    threshold: float | None = None
    matches: tuple = field(default=())


def _apply(rule: Rule, match: tuple, graph: dict) -> dict:
    """One rule at one match (head, tails, successes, misses) on a small graph {(head, tails): (s, f, frozen)}."""
    head, tails, s, f = match
    key, out = (head, tuple(sorted(tails))), dict(graph)
    if rule.kind == "GROW":
        out.setdefault(key, (0, 0, False))
    elif key in out:
        a, b, frozen = out[key]
        mean = (1 + a) / (2 + a + b)
        if rule.kind == "PRUNE" and mean <= (0.2 if rule.threshold is None else rule.threshold):
            del out[key]
        elif rule.kind == "FREEZE" and mean >= (0.95 if rule.threshold is None else rule.threshold):
            out[key] = (a, b, True)
    return out


def critical_pairs(rules: list[Rule], max_pairs: int = 100) -> list[dict]:
    """Whether each two rules, at each two matches, give the same graph in either order.

    A driver-side analysis of rules, which are few; graphs here hold the matched edges only.
    """
    out = []
    for a in rules:
        for b in rules:
            if a is b:
                continue
            for ma in a.matches:
                for mb in b.matches:
                    if len(out) >= max_pairs:
                        return out
                    graph = {(m[0], tuple(sorted(m[1]))): (m[2], m[3], False) for r, m in ((a, ma), (b, mb)) if r.kind != "GROW"}
                    one, two = _apply(b, mb, _apply(a, ma, graph)), _apply(a, ma, _apply(b, mb, graph))
                    out.append({"a": a.name, "b": b.name, "joinable": {(k, v[2]) for k, v in one.items()} == {(k, v[2]) for k, v in two.items()}})
    return out


def matches(rule: Rule, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, key_head, key_tail) of the rule's matches: candidates to grow, and edges whose posterior mean lets it prune or freeze them."""
    mean = ids.posterior_mean(F.col("counts_success"), F.col("counts_miss"))
    if rule.kind == "GROW":
        found = candidates
    elif rule.kind == "PRUNE":
        found = edges.where(mean <= (0.2 if rule.threshold is None else rule.threshold))
    else:
        found = edges.where((mean >= (0.95 if rule.threshold is None else rule.threshold)) & ~F.col("frozen"))
    return edge_key(found).select(F.lit(rule.name).alias("rule"), "key_head", "key_tail").distinct()


def _applied(rule: Rule, state: Column) -> Column:
    """An edge's state (there, s, m, frozen) after the rule at it."""
    there, s, m = state["there"], state["s"], state["m"]
    struct = lambda a, b, c, d: F.struct(a.alias("there"), b.cast("bigint").alias("s"), c.cast("bigint").alias("m"), d.alias("frozen"))
    mean = ids.posterior_mean(s, m)
    if rule.kind == "GROW":
        return F.when(there, state).otherwise(struct(F.lit(True), F.lit(0), F.lit(0), F.lit(False)))
    if rule.kind == "PRUNE":
        return F.when(there & (mean <= (0.2 if rule.threshold is None else rule.threshold)), struct(F.lit(False), F.lit(0), F.lit(0), F.lit(False))).otherwise(state)
    return F.when(there & (mean >= (0.95 if rule.threshold is None else rule.threshold)), struct(F.lit(True), s, m, F.lit(True))).otherwise(state)


def overlaps(rules: list[Rule], edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, key_head, key_tail, joinable): where two rules match one edge, and whether both orders end the same.

    Matches on different edges don't touch each other, so only pairs that share
    one are critical; these come from a join on the edge, of the graph's own
    edges and of candidates.  An edge has at most one match a rule, so a shared
    edge gives a row for each two rules and never more.
    """
    of = {r.name: r for r in rules}
    if len(of) < len(rules):
        raise ValueError("rules have names of their own")
    every = matches(rules[0], edges, candidates)
    for rule in rules[1:]:
        every = every.unionByName(matches(rule, edges, candidates))
    there = edge_key(edges).groupBy("key_head", "key_tail").agg(F.min_by(F.struct("counts_success", "counts_miss", "frozen"), "id").alias("e"))
    by_edge = every.groupBy("key_head", "key_tail").agg(F.array_sort(F.collect_set("rule")).alias("rules")).where("size(rules) > 1")
    state = F.struct(F.col("e").isNotNull().alias("there"), F.coalesce("e.counts_success", F.lit(0)).cast("bigint").alias("s"), F.coalesce("e.counts_miss", F.lit(0)).cast("bigint").alias("m"), F.coalesce("e.frozen", F.lit(False)).alias("frozen"))
    rows = by_edge.join(there, ["key_head", "key_tail"], "left").withColumn("state", state)
    same = lambda x, y: (x["there"] == y["there"]) & (x["frozen"] == y["frozen"])
    pairs = [(a, b) for a in of for b in of if a < b]
    made = [F.when(F.array_contains("rules", a) & F.array_contains("rules", b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), same(_applied(of[b], _applied(of[a], F.col("state"))), _applied(of[a], _applied(of[b], F.col("state")))).alias("joinable"))) for a, b in pairs]
    return rows.select("key_head", "key_tail", F.explode(F.array_compact(F.array(*made))).alias("p")).select("p.a", "p.b", "key_head", "key_tail", "p.joinable")


def termination(rules: DataFrame) -> DataFrame:
    """(system, ends, bounded) of rule systems given as rows (system, kind, max_grow): terminates() for each, as one aggregate."""
    grows, bound = F.max((F.col("kind") == "GROW").cast("int")) == 1, F.max("max_grow")
    each = rules.groupBy("system").agg(F.coalesce(grows, F.lit(False)).alias("grows"), F.coalesce(bound >= 0, F.lit(False)).alias("limit"))
    return each.select("system", F.when(F.col("grows") & ~F.col("limit"), "unknown").otherwise("true").alias("ends"), (F.col("grows") & F.col("limit")).alias("bounded"))


def terminates(rules: list[Rule], max_grow: int | None = None) -> tuple[bool | str, bool]:
    """(True or "unknown", whether a bound on growth was needed)."""
    if not any(r.kind == "GROW" for r in rules):
        return True, False
    return (True, True) if max_grow is not None and max_grow >= 0 else ("unknown", False)
