"""Events, connectivity and other inputs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as (n, t, event_id, event_type, value); t is microseconds."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type", "value")


def vertices(events: DataFrame) -> DataFrame:
    """One vertex a neuron and time."""
    return events.select("n", "t").dropDuplicates(["n", "t"])


def stream_vertices(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """The same on a stream; events has ts besides n and t."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["n", "t"])


def ring_connectivity(neurons: DataFrame, fan_in: int = 4) -> DataFrame:
    """(post, pre): each neuron listens to the next fan_in, modulo their number."""
    n = neurons.agg(F.max("n")).first()[0]
    size = (n if n is not None else -1) + 1
    return neurons.sparkSession.range(max(size, 0)).select(F.col("id").alias("post"), F.explode(F.sequence(F.lit(1), F.lit(fan_in))).alias("o")).select("post", ((F.col("post") + F.col("o")) % F.lit(max(size, 1))).alias("pre"))


def connectivity_of(spark: SparkSession, mapping: dict[int, list[int]]) -> DataFrame:
    return spark.createDataFrame([(int(p), int(q)) for p, qs in mapping.items() for q in sorted(set(qs))], "post bigint, pre bigint")


def events_of(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(int(n), int(t)) for n, t in pairs], "n bigint, t bigint")


def read_dataset(spark: SparkSession, path: str, split: str, item: str | None = None) -> DataFrame:
    """(item, label, n, t) of recordings in Parquet below path/train or path/test: all, or one by its id."""
    if split not in ("train", "test"):
        raise ValueError("split is train or test")
    rows = spark.read.parquet(f"{path.rstrip('/')}/{split}").select("item", "label", "n", "t")
    return rows if item is None else rows.where(F.col("item") == item)


def read_first_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The first record of each file of a path, with the name of the file's folder as ``__name``; one that is no JSON object fails."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("__file", F.col("_metadata.file_path")).withColumn("__block", F.col("_metadata.file_block_start")).withColumn("__id", F.monotonically_increasing_id())
    first = lines.groupBy("__file").agg(F.min_by("value", F.struct("__block", "__id")).alias("value"))
    # as a variant, so that anything but an object shows
    kind = F.schema_of_variant(F.try_parse_json("value"))
    first = first.withColumn("value", F.when(kind.startswith("OBJECT"), F.col("value")).otherwise(F.raise_error(F.concat("__file", F.lit(" doesn't begin with a JSON object"))).cast("string")))
    name = F.element_at(F.split("__file", "/"), -2).alias("__name")
    return first.select(name, F.from_json("value", schema).alias("record") if schema else F.col("value").alias("record"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a CSV with those columns in any case; empty or repeated ids are errors."""
    raw = spark.read.csv(path, header=True)
    named = {c.strip().lower(): c for c in raw.columns}
    if not {"id", "label"} <= set(named):
        raise ValueError("a manifest has the columns id and label")
    rows = raw.select(F.trim(F.col(named["id"])).alias("id"), F.trim(F.col(named["label"])).alias("label"))
    bad = rows.agg(F.count_if(F.coalesce(F.col("id"), F.lit("")) == "").alias("empty"), (F.count("id") - F.count_distinct("id")).alias("twice")).first()
    if bad["empty"] or bad["twice"]:
        raise ValueError("ids of a manifest are set and unique")
    return rows


def synthetic_events(spark: SparkSession, n_events: int, n_neurons: int, dt: int = 1, seed: int = 0) -> DataFrame:
    """Uniform neurons, one event each dt; the same for the same seed, on any number of tasks."""
    return spark.range(n_events).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_neurons)).alias("n"), (F.col("id") * dt).alias("t"))


def layered_edges(spark: SparkSession, fan: int, layers: int, reliability: float = 0.9) -> DataFrame:
    """Unary edges of layers + 1 layers of fan vertices each: every vertex of a layer from every one before."""
    grid = spark.range(layers * fan * fan).select((F.col("id") / (fan * fan)).cast("long").alias("layer"), ((F.col("id") / fan).cast("long") % fan).alias("i"), (F.col("id") % fan).alias("j"))
    head = F.struct(((F.col("layer") + 1) * fan + F.col("i")).alias("n"), ((F.col("layer") + 1) * 100).alias("t"))
    tail = F.array(F.struct((F.col("layer") * fan + F.col("j")).alias("n"), (F.col("layer") * 100).alias("t")))
    return grid.select(head.alias("head"), tail.alias("tail"), F.lit(reliability).alias("reliability"))


def random_edges(spark: SparkSession, n_edges: int, n_neurons: int, span: int, fan: int = 2, reliability: float = 0.5, seed: int = 0) -> DataFrame:
    """Edges of ``fan`` tails each, of neurons and times below n_neurons and span; tails are earlier than their head."""
    draw = lambda salt, below: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), below)
    t = (draw("t", F.lit(max(1, span - 1))) + 1).alias("t")
    tail = F.array_distinct(F.array(*[F.struct(draw(f"n{i}", F.lit(n_neurons)).alias("n"), draw(f"t{i}", F.col("t")).alias("t")) for i in range(fan)]))
    heads = spark.range(n_edges).select("id", draw("n", F.lit(n_neurons)).alias("n"), t)
    return heads.select(F.struct("n", "t").alias("head"), tail.alias("tail"), F.lit(reliability).alias("reliability"))


def fan_edges(spark: SparkSession, n_edges: int, t: int = 1000, reliability: float = 0.5) -> DataFrame:
    """Unary edges of one head, each from a neuron of its own."""
    tail = F.array(F.struct((F.col("id") + 1).alias("n"), F.lit(t - 100).cast("bigint").alias("t")))
    return spark.range(n_edges).select(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(t).cast("bigint").alias("t")).alias("head"), tail.alias("tail"), F.lit(reliability).alias("reliability"))


#: The chance of a spike a step of the first class, and what each later class adds.
POISSON_RATES = (0.05, 0.10)


def poisson_batches(spark: SparkSession, n_samples: int, n_classes: int = 2, n_neurons: int = 32, n_steps: int = 20, seed: int = 0) -> DataFrame:
    """(sample, label, n, spikes) of synthetic spike trains: a step spikes with the class's rate, drawn from the cell and the seed alone."""
    first, more = POISSON_RATES
    cells = spark.range(n_samples * n_neurons).select((F.col("id") / n_neurons).cast("long").alias("sample"), (F.col("id") % n_neurons).alias("n"))
    cells = cells.withColumn("label", F.pmod(F.xxhash64("sample", F.lit(seed)), F.lit(n_classes)))
    draw = lambda step: F.pmod(F.xxhash64("sample", "n", step, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    hits = F.size(F.filter(F.sequence(F.lit(1), F.lit(n_steps)), lambda step: draw(step) < first + more * F.col("label")))
    return cells.select("sample", "label", "n", hits.cast("long").alias("spikes"))
