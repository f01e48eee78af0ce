"""Validated parameter objects of the engine."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, is_dataclass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


# Defaults are fixed values: results of runs without settings depend on them.


@dataclass(frozen=True)
class GrowConfig:
    k: int = 3
    combination_order_max: int = 2
    causal_coincidence_delta: int = 500
    budget_per_head: int = 16
    init_reliability: float = 0.10
    refractory_rho: int = 0
    delay_min: int = 100
    delay_max: int = 500


@dataclass(frozen=True)
class TraverseConfig:
    horizon: int = 2000
    beam_size: int = 8
    length_penalty_base: float = 0.98


@dataclass(frozen=True)
class WalkConfig:
    """A sampled search; lambda_recent is per unit of time."""

    horizon: int = 2000
    depth: int = 12
    branch: int = 4
    beam_size: int = 8
    incoming_cap: int = 16
    temperature: float = 0.7
    w_reliability: float = 1.0
    w_recent: float = 0.5
    w_rule: float = 0.5
    w_similar: float = 0.5
    lambda_recent: float = 1 / 100_000
    length_penalty_base: float = 0.98
    seed: int = 0

    def __post_init__(self) -> None:
        _need(self.temperature > 0, "temperature must be positive")
        _need(min(self.depth, self.branch, self.beam_size, self.incoming_cap) > 0, "depth, branch, beam_size and incoming_cap must be positive")


@dataclass(frozen=True)
class LearnConfig:
    impl: str = "ema"
    ema_alpha: float = 0.10
    clamp_min: float = 0.02
    clamp_max: float = 0.98
    prune_threshold: float = 0.05
    decay_lambda: float = 0.0
    alpha0: float = 1.0
    beta0: float = 1.0
    share_negative: float = 1.0
    respect_freeze: bool = True

    def __post_init__(self) -> None:
        _need(self.impl in ("ema", "beta"), "impl must be ema or beta")
        _need(self.alpha0 > 0 and self.beta0 > 0, "priors must be positive")
        _need(self.share_negative >= 0, "share_negative must not be negative")


@dataclass(frozen=True)
class DecayConfig:
    """Local learning from predictions, decay and pruning; rates are per ``unit`` of time."""

    unit: int = 1_000_000
    alpha: float = 0.10
    reliability_min: float = 0.02
    reliability_max: float = 0.98
    prior: float = 0.5
    path_share: float = 0.5
    count_keep: float = 0.98
    stabilizer: float = 1.0
    relax: float = 0.01
    prune_threshold: float = 0.02
    prune_age: int = 2_000_000
    prune_uses: int = 3
    idle: int = 30_000_000
    budget_per_head: int = 256
    age_lambda: float = 0.01

    def __post_init__(self) -> None:
        _need(self.unit > 0, "unit must be positive")
        _need(0 < self.count_keep <= 1 and 0 <= self.relax < 1, "count_keep is a share above 0, relax one below 1")
        _need(0 <= self.path_share <= 1 and 0 <= self.alpha <= 1, "shares lie from 0 to 1")
        _need(self.reliability_min <= self.prior <= self.reliability_max, "the prior lies within the bounds")
        _need(self.budget_per_head > 0, "a head's budget must be positive")


@dataclass(frozen=True)
class MineConfig:
    enabled: bool = False
    theta: float = 5.0
    lambda_decay: float = 0.0
    hold_k: int = 2
    min_weight: float = 1e-6
    promotion_cap: int = 1


@dataclass(frozen=True)
class AbstractionConfig:
    reliability: str = "min"
    floor: float = 0.10
    dedup: bool = True

    def __post_init__(self) -> None:
        _need(self.reliability in ("min", "mean", "geo"), "reliability must be min, mean or geo")


@dataclass(frozen=True)
class RewriteConfig:
    enabled: bool = False
    prune_threshold: float = 0.2
    freeze_threshold: float = 0.95
    apply_ops: tuple[str, ...] = ("grow", "prune", "freeze")

    def __post_init__(self) -> None:
        _need(set(self.apply_ops) <= {"grow", "prune", "freeze"}, "apply_ops are of grow, prune and freeze")


@dataclass(frozen=True)
class GateConfig:
    enabled: bool = False
    mode: str = "soft"
    points: tuple[str, ...] = ("grow", "backward")

    def __post_init__(self) -> None:
        _need(self.mode in ("soft", "hard"), "mode must be soft or hard")


@dataclass(frozen=True)
class PolicyConfig:
    similarity_threshold: float = 0.5
    freeze_strength: float = 1.0
    mode: str = "resistance"
    top_fraction: float = 0.2
    cutoff: float = 0.6
    epsilon: float = 1e-12

    def __post_init__(self) -> None:
        _need(0 <= self.similarity_threshold <= 1, "similarity_threshold must be in [0, 1]")
        _need(self.mode in ("resistance", "immutable"), "mode must be resistance or immutable")
        _need(0 < self.top_fraction <= 1, "top_fraction must be in (0, 1]")
        _need(0 <= self.cutoff <= 1, "cutoff must be in [0, 1]")


@dataclass(frozen=True)
class EmbedConfig:
    dim: int = 256
    iterations: int = 2
    normalize: bool = True
    seed: int = 0
    use_reliability: bool = False
    time_resolution: float = 1.0

    def __post_init__(self) -> None:
        _need(self.dim > 0 and self.iterations >= 0 and self.time_resolution > 0, "dim and time_resolution must be positive")


@dataclass(frozen=True)
class IsolationConfig:
    """Three-way decisions, freezes that expire, and regions; times are in the units of events."""

    reuse: float = 0.6
    isolate: float = 0.3
    protect_share: float = 0.05
    protect_most: int = 50_000
    hybrid_share: float = 0.5
    ttl: int = 120_000_000
    review: int = 30_000_000
    review_alpha: float = 0.02
    leak: float = 0.1
    span_penalty: float = 0.5

    def __post_init__(self) -> None:
        _need(self.isolate <= self.reuse, "isolate must not be above reuse")
        _need(self.ttl > 0 and self.review >= 0, "ttl must be positive and review not negative")
        _need(0 <= self.leak <= 1 and 0 <= self.protect_share <= 1 and 0 <= self.hybrid_share <= 1, "shares lie from 0 to 1")


@dataclass(frozen=True)
class CardConfig:
    alpha0: float = 1.0
    beta0: float = 1.0
    level: float = 0.95
    samples: int = 5000
    frozen_threshold: float = 0.9

    def __post_init__(self) -> None:
        _need(self.alpha0 > 0 and self.beta0 > 0 and self.samples > 0 and 0 < self.level < 1, "priors, samples and level must be in range")


@dataclass(frozen=True)
class BufferConfig:
    """Per-neuron buffers: how long events are kept after a neuron's last, looked at every so many."""

    horizon: int = 500_000
    prune_batch: int = 256

    def __post_init__(self) -> None:
        _need(self.horizon >= 0 and self.prune_batch > 0, "horizon and prune_batch must be in range")


@dataclass(frozen=True)
class EncoderConfig:
    time_bin: int = 1000
    normalize: bool = True

    def __post_init__(self) -> None:
        _need(self.time_bin > 0, "time_bin must be positive")


@dataclass(frozen=True)
class AuditConfig:
    """Where a step writes its audit chain and its rule cards; nowhere unless set."""

    log: str | None = None
    cards: str | None = None
    max_bytes: int | None = None


@dataclass(frozen=True)
class EngineConfig:
    grow: GrowConfig = field(default_factory=GrowConfig)
    traverse: TraverseConfig = field(default_factory=TraverseConfig)
    learn: LearnConfig = field(default_factory=LearnConfig)
    mine: MineConfig = field(default_factory=MineConfig)
    abstraction: AbstractionConfig = field(default_factory=AbstractionConfig)
    rewrite: RewriteConfig = field(default_factory=RewriteConfig)
    gate: GateConfig = field(default_factory=GateConfig)
    card: CardConfig = field(default_factory=CardConfig)
    audit: AuditConfig = field(default_factory=AuditConfig)


def deep_merge(base: dict, over: dict) -> dict:
    """A new mapping with the second's leaves over the first's."""
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def parse_overrides(args: list[str]) -> dict:
    """Nested values of ``key.sub=value`` arguments; true, false and numbers are converted."""
    out: dict = {}
    for arg in args:
        path, eq, text = arg.partition("=")
        if not eq:
            continue
        value: object = text
        if text.lower() in ("true", "false"):
            value = text.lower() == "true"
        else:
            for kind in (int, float):
                try:
                    value = kind(text)
                    break
                except ValueError:
                    pass
        leaf: object = value
        for part in reversed(path.split(".")):
            leaf = {part: leaf}
        out = deep_merge(out, leaf)
    return out


def load_yaml(path: str) -> dict:
    """A YAML file's mapping; an empty file is an empty one."""
    import yaml  # not everywhere; only YAML files need it

    with open(path, encoding="utf-8") as text:
        values = yaml.safe_load(text) or {}
    if not isinstance(values, dict):
        raise ValueError(f"{path} doesn't hold a mapping")
    return values


#: The sections and keys of experiment files, and the parameters that they set.  Others are left alone.
SECTIONS = {
    "dch": ("grow", {x: x for x in ("k", "combination_order_max", "causal_coincidence_delta", "budget_per_head", "init_reliability", "refractory_rho", "delay_min", "delay_max")}),
    "traversal": ("traverse", {x: x for x in ("horizon", "beam_size", "length_penalty_base")}),
    "plasticity": ("learn", {"ema_alpha": "ema_alpha", "reliability_min": "clamp_min", "reliability_max": "clamp_max", "decay_lambda": "decay_lambda", "prune_threshold": "prune_threshold"}),
    "fsm": ("mine", {"theta": "theta", "lambda_decay": "lambda_decay", "hold_k": "hold_k", "min_weight": "min_weight", "promotion_limit_per_step": "promotion_cap"}),
    "scaffolding": ("mine", {"enabled": "enabled"}),
}


def from_experiment(values: dict) -> EngineConfig:
    """An EngineConfig from the sections of an experiment's files; keys that set nothing here are passed over."""
    made: dict = {}
    for name, (part, keys) in SECTIONS.items():
        for key, value in (values.get(name) or {}).items():
            if key in keys:
                made.setdefault(part, {})[keys[key]] = value
    return from_mapping(made)


def from_mapping(values: dict) -> EngineConfig:
    """An EngineConfig from nested values; unknown keys are errors."""
    made = {}
    for name, part in values.items():
        kind = EngineConfig.__dataclass_fields__[name].default_factory
        made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in part.items()})
    return EngineConfig(**made)


def fingerprint(obj: object) -> str:
    """SHA-256 of the object's sorted, compact JSON."""
    plain = asdict(obj) if is_dataclass(obj) else obj
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
