"""Mixing sources to target weights with exact budgets.

Every row gets a hash-random key.  Rows are range-sorted by the key within each
source, sizes are summed by prefix over the whole source, and the source is cut
where its budget ends, inside a document if need be; a budget beyond the
source's size repeats it for whole epochs first.

The prefix sums are distributed: keys are uniform, so equal ranges of the key
are buckets of about equal rows, and a source gets as many as its rows ask for.
Bucket totals are summed before any shuffle of rows; each bucket then adds the
sum of those before it to its own running sum.  So a source with a third of all
rows is sorted by many tasks, and equal runs of the same rows agree.

Cases: a null or blank text has size 0 and takes nothing; a null source is a
source of its own, after all others; repeated rows are mixed each for itself;
ties of the key fall back to the id and the size; sources without words have
the target 0; very long texts are counted and cut whole; an empty table gives an
empty result; other columns, whatever their names, pass through mix() and are
left out of mix_sizes().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import free_prefix

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
ROWS_A_BUCKET = 5_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(ident: Column) -> Column:
    """32 hexadecimal digits that depend on nothing but the id."""
    return F.md5(F.coalesce(ident.cast("string"), F.lit("null")))


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """(skey, source_size, target) from one row (skey, source_size) a source.

    Weights repeat over the sources in order of code points, null last.  A
    target stops at ``epochs`` times the source's size and the excess is
    reshared by weight until none is above.  In closed form: with the sources
    sorted by cap over weight, the first k stop at their caps and the others
    get ``level`` times their weight, for the least k at which that holds; the
    level falls with k from there on, so it is the largest that holds.
    """
    by_name, by_ratio = W.orderBy(F.col("skey") == "", "skey"), W.orderBy("ratio", "skey")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy()))
    )
    return ranked.select("skey", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sizes(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """(doc_id, skey, slot, size, key, source_size, target, whole, taken) from rows of (doc_id, source, size).

    ``whole`` epochs of the source are taken, and of one more what the target
    leaves; ``taken`` is what both take of the row.
    """
    n_slots = min(1 << 20, max(16, -(-rows.count() // rows_a_bucket)))
    keyed = rows.select("doc_id", source_key(F.col("source")).alias("skey"), "size", random_key(F.col("doc_id")).alias("key"))
    slot = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_slots / F.lit(float(1 << 32))).cast("int")
    keyed = keyed.withColumn("slot", slot)
    # a slot is a range of keys: ranges, their prefix sums and the sources' totals come from one small row a source and slot
    slots = keyed.groupBy("skey", "slot").agg(F.sum("size").alias("slot_size"))
    before = W.partitionBy("skey").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
    aims = targets(slots.groupBy("skey").agg(F.sum("slot_size").alias("source_size")), weights, share, epochs)
    slots = slots.join(aims, "skey").select("skey", "slot", "before", "source_size", "target")
    inside = W.partitionBy("skey", "slot").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("whole") * F.col("source_size")
    return (
        keyed.join(slots, ["skey", "slot"])
        .withColumn("upto", F.col("before") + F.sum("size").over(inside))
        .withColumn("whole", whole)
        .withColumn("taken", F.col("whole") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("upto") + F.col("size"))))
        .select("doc_id", "skey", "slot", "size", "key", "source_size", "target", "whole", "taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: docs' rows, repeated for each epoch taken; the one row where a source is cut ends after its last taken word.

    Texts are not shuffled: a row's share follows from its key and the place
    where its source is cut, one small row a source.  Of rows equal in id and
    size to the row at the cut, which alone are put in an order of their texts,
    the first ones are whole and the one after them is cut.
    """
    names, p = docs.columns, free_prefix(docs)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    mixed = mix_sizes(sizes, **settings).withColumn("extra", F.col("taken") - F.col("whole") * F.col("size"))
    # equal rows stand in one slot, so this sums them without an exchange
    places = mixed.groupBy("skey", "slot", "key", "doc_id", "size").agg(F.sum("extra").alias("extra"), F.max("whole").alias("whole"))
    place = F.struct("key", "doc_id", "size")
    cuts = places.groupBy("skey").agg(F.max("whole").alias(f"{p}whole"), F.max(F.when(F.col("extra") > 0, F.struct(place.alias("place"), "extra"))).alias(f"{p}cut")).withColumnRenamed("skey", f"{p}skey")
    own = F.struct(random_key(F.col(id_col)).alias("key"), F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"))
    rows = docs.withColumn(f"{p}skey", source_key(F.col(source_col))).join(cuts, f"{p}skey").withColumn(f"{p}place", own)
    last, size, whole, words = F.col(f"{p}cut.place"), F.col(f"{p}place.size"), F.col(f"{p}whole"), F.col(f"{p}words")
    at_cut = F.col(f"{p}place").eqNullSafe(last)
    apart = rows.where(~at_cut).withColumn(f"{p}words", F.when(F.col(f"{p}place") < last, size).otherwise(F.lit(0).cast("long")))
    turn = F.row_number().over(W.partitionBy(f"{p}skey").orderBy(F.xxhash64(text_col), text_col)) - 1
    tied = rows.where(at_cut).withColumn(f"{p}words", F.greatest(F.lit(0).cast("long"), F.least(size, F.col(f"{p}cut.extra") - turn * size)))
    rows = apart.unionByName(tied)
    copies = F.when(size > 0, whole + (words > 0).cast("long")).otherwise(0).cast("int")
    rows = rows.withColumn(f"{p}copies", copies).where(F.col(f"{p}copies") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies"))))
    text = F.col(text_col)
    left = F.get(F.split(F.regexp_replace(text, "^" + SPACE, ""), SPACE, words.cast("int") + 1), words.cast("int"))
    partial = (F.col(f"{p}copy") > whole) & (words < size)
    cut = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(F.coalesce(left, F.lit("")))))
    rows = rows.withColumn(text_col, F.when(partial, cut).otherwise(text))
    return rows.select(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sizes(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey
), ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY skey = '', skey) - 1) % 3]::DOUBLE AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), aims AS (
  SELECT skey, source_size, coalesce(least(cap, weight * (SELECT max(level) FROM levels WHERE level <= cap / weight)), cap) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY skey ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized JOIN aims USING (skey)
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - upto + size)))::BIGINT AS taken FROM placed
"""
