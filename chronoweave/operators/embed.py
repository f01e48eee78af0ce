"""Structural embeddings: relabelling rounds over a path's edges, hashed into a vector.

A path is seen as vertices (by neuron) and edges (by their delays); each round
renames every node by a keyed hash of its own label and its neighbours', and
all labels of all rounds add a signed one to a bucket of the vector.  Times
enter as delays only, so shifting a path in time leaves its vector alone, and
so does the order of its edges.

The hash is keyed BLAKE2b, which Spark doesn't have, so vectors are made in
Arrow batches.  An empty path gives zeros; a null path counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EmbedConfig


def _hasher(seed: int) -> Callable[[str], int]:
    """The keyed hash; its key is read once, and paths that share edges share most labels."""
    keyed = hashlib.blake2b(digest_size=8, key=int(seed).to_bytes(8, "little", signed=True))

    @lru_cache(maxsize=1 << 15)
    def run(text: str) -> int:
        h = keyed.copy()
        h.update(text.encode())
        return int.from_bytes(h.digest(), "little")

    return run


def _labels(parts: list[tuple], cfg: EmbedConfig, hashed: Callable[[str], int]) -> Iterator[int]:
    """Hashes of all labels of all rounds of a path given as [(head, tails, reliability)]."""
    labels: list[str] = []
    near: list[list[tuple[str, int]]] = []
    number: dict[tuple, int] = {}

    def node(key: tuple, name: str) -> int:
        i = number.setdefault(key, len(labels))
        if i == len(labels):
            labels.append(name)
            near.append([])
        return i

    for head, tails, reliability in parts:
        delays = sorted([(n, round((head[1] - t) / cfg.time_resolution)) for n, t in tails])
        name = f"E{head[0]}:{delays}"
        if cfg.use_reliability:
            name += f":{reliability:.3f}"
        e = node((head, *sorted(tails), "e"), name)
        labels[e] = name
        for role, v in (("h", head), *[("t", v) for v in tails]):
            i = node(v, f"V{v[0]}")
            near[i].append((role, e))
            near[e].append((role, i))
    for label in labels:
        yield hashed("0|" + label)
    for level in range(1, cfg.iterations + 1):
        labels = [f"{hashed(label + '|' + '|'.join(sorted([role + labels[i] for role, i in links]))):016x}" for label, links in zip(labels, near)]
        for label in labels:
            yield hashed(f"{level}|{label}")


def _vectors(paths: list[list[tuple]], cfg: EmbedConfig) -> np.ndarray:
    """A row for each path."""
    hashed, at, sign = _hasher(cfg.seed), [], []
    for i, parts in enumerate(paths):
        for h in _labels(parts, cfg, hashed):
            at.append(i * cfg.dim + (h >> 1) % cfg.dim)
            sign.append(1.0 if h & 1 else -1.0)
    out = np.bincount(np.array(at, np.int64), np.array(sign), len(paths) * cfg.dim).reshape(len(paths), cfg.dim)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0) if cfg.normalize else out


def vector(parts: list | None, cfg: EmbedConfig) -> np.ndarray:
    """The vector of a path given as [{head: {n, t}, tail: [{n, t}], reliability}]."""
    listed = [((e["head"]["n"], e["head"]["t"]), [(v["n"], v["t"]) for v in e["tail"]], e["reliability"]) for e in (parts if parts is not None else [])]
    return _vectors([listed], cfg)[0]


def _listed(column: pa.Array) -> list[list[tuple]]:
    """The paths of a column of parts, as [(head, tails, reliability)]."""
    cuts = lambda x: np.append(0, np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
    pairs = lambda x: list(zip(x.field("n").to_pylist(), x.field("t").to_pylist(), strict=True))
    flat, at = column.flatten(), cuts(column)
    tail = flat.field("tail")
    ends, inner = pairs(tail.flatten()), cuts(tail)
    rows = list(zip(pairs(flat.field("head")), (ends[a:b] for a, b in zip(inner, inner[1:])), flat.field("reliability").to_pylist(), strict=True))
    return [rows[a:b] for a, b in zip(at, at[1:])]


def embed(parts: Column, cfg: EmbedConfig | None = None) -> Column:
    """array<double> of a column of path parts."""
    cfg = cfg or EmbedConfig()

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = _vectors(_listed(batch), cfg)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * cfg.dim), pa.array(made.ravel()))

    return run(parts)


def embed_paths(paths: DataFrame, edges: DataFrame, cfg: EmbedConfig | None = None) -> DataFrame:
    """(target, label, embedding) of each path; edges that are gone add nothing, and paths with their ``parts`` aren't joined with edges."""
    if "parts" in paths.columns:
        shown = F.transform("parts", lambda e: F.struct(e["head"].alias("head"), e["tail"].alias("tail"), e["reliability"].alias("reliability")))
        return paths.select("target", "label", embed(shown, cfg).alias("embedding"))
    keyed = paths.select("target", "label", F.explode_outer("edges").alias("id")).join(edges.select("id", F.struct("head", "tail", "reliability").alias("part")), "id", "left")
    return keyed.groupBy("target", "label").agg(F.collect_list("part").alias("parts")).select("target", "label", embed(F.col("parts"), cfg).alias("embedding"))
