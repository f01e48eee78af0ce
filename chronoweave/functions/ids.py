"""Identifiers, labels and small expressions over vertices and edges.

A vertex is a struct (n, t); its id is ``n@t``.  Ids are rendered for output
and never parsed back where the struct is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = (
    "id string, head struct<n:bigint,t:bigint>, tail array<struct<n:bigint,t:bigint>>, delta_min bigint, delta_max bigint, rho bigint, "
    "reliability double, counts_success bigint, counts_miss bigint, last_update_t bigint, provenance string, frozen boolean"
)


def vertex_id(v: Column) -> Column:
    return F.concat(v["n"].cast("string"), F.lit("@"), v["t"].cast("string"))


def tail_ids(tail: Column) -> Column:
    """Rendered ids in the order of their text."""
    return F.array_sort(F.transform(tail, vertex_id))


def edge_id(head: Column, tail: Column) -> Column:
    return F.concat(vertex_id(head), F.lit("&"), F.array_join(tail_ids(tail), ","), F.lit("#"), head["t"].cast("string"))


def parse_vertex(vid: Column) -> Column:
    """(n, t) of a rendered id; null parts where they aren't integers."""
    parts = F.split(vid, "@", 2)
    return F.struct(F.get(parts, F.lit(0)).try_cast("bigint").alias("n"), F.get(parts, F.lit(1)).try_cast("bigint").alias("t"))


def parse_edge(eid: Column) -> Column:
    """(head id, tail ids) of a rendered edge id."""
    body = F.substring_index(eid, "#", 1)
    return F.struct(F.substring_index(body, "&", 1).alias("head"), F.split(F.substring_index(body, "&", -1), ",").alias("tail"))


def path_label(edges: Column) -> Column:
    return F.array_join(F.array_sort(edges), "|")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals as SQL engines round doubles: by the scaled double itself.

    F.round() goes by the shortest decimal that stands for the double, so what
    looks like a tie goes up there although the double lies below it.
    """
    scaled = F.abs(x) * float(10**digits)
    whole = F.floor(scaled)
    return F.signum(x) * (whole + (scaled - whole >= 0.5).cast("int")) / float(10**digits)


def admissible(tail: Column, head_t: Column, delta_min: Column, delta_max: Column) -> Column:
    """Every tail time lies in [head_t - delta_max, head_t - delta_min]."""
    return F.forall(tail, lambda v: v["t"].between(head_t - delta_max, head_t - delta_min))


def posterior_mean(success: Column, miss: Column, alpha0: float = 1.0, beta0: float = 1.0) -> Column:
    return (success + alpha0) / (success + miss + (alpha0 + beta0))


def structural_label(head: Column, edges: Column, time_resolution: float = 1.0, reliability: bool = False) -> Column:
    """``HEAD:n|EDGES:[...]`` of a path; edges is an array of (head, tail) structs, with reliability if it is shown, in three decimals.

    Each edge shows its head neuron and, for each tail, the neuron and the delay
    in units of time_resolution, half to even.  Shifting all times leaves it.
    """
    def shown(e: Column) -> Column:
        pairs = F.transform(e["tail"], lambda v: F.struct(v["n"].cast("string").alias("n"), F.bround((e["head"]["t"] - v["t"]) / time_resolution).cast("bigint").alias("d")))
        tails = F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit("('"), p["n"], F.lit("', "), p["d"].cast("string"), F.lit(")")))
        comma = F.when(F.size(tails) == 1, ",").otherwise("")
        more = F.concat(F.lit(", '"), F.format_string("%.3f", F.bround(e["reliability"], 3)), F.lit("'")) if reliability else F.lit("")
        return F.concat(F.lit("('"), e["head"]["n"].cast("string"), F.lit("', ("), F.array_join(tails, ", "), comma, F.lit(")"), more, F.lit(")"))

    return F.concat(F.lit("HEAD:"), head["n"].cast("string"), F.lit("|EDGES:["), F.array_join(F.array_sort(F.transform(edges, shown)), ","), F.lit("]"))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine of two arrays, 0 where a norm is not above eps, clipped to [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na <= eps) | (nb <= eps), 0.0).otherwise(clamp(dot(a, b) / (na * nb), -1.0, 1.0))


#: Upper bounds of delay classes, in milliseconds.
DELAY_BUCKETS_MS = (1, 2, 3, 5, 7, 10, 15, 20, 25, 30)


def delay_bucket(delay_us: Column) -> Column:
    """The least class whose bound is not below the delay, rounded up to milliseconds; the last one beyond all."""
    ms = F.ceil(delay_us / 1000)
    fits = F.filter(F.array(*[F.lit(b) for b in DELAY_BUCKETS_MS]), lambda b: b >= ms)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(DELAY_BUCKETS_MS[-1]))


def as_json(*columns: str) -> Column:
    """A row's columns as JSON, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
