"""URL filters: rules first, then the ratio of two character language models.

URLs that a rule decides train two variable-order Markov models, one on the
accepted and one on the rejected ones.  Contexts go up to four characters and
orders are interpolated by the number of distinct continuations of each context
(Witten-Bell smoothing), down to a uniform distribution.  A URL's score is the
mean over its characters of ``log p_accepted - log p_rejected``.  A share of the
decided URLs, by hash, trains no model: the threshold is the midpoint of the mean
scores of its accepted and of its rejected URLs, or of all decided ones where it
lacks either.  A URL without a rule is allowed at the threshold or above.

Host and path are modelled as two strings with contexts of their own, so that
a host or a path is scored once however many URLs share it.  Counts of all
contexts of all URLs are kept, in tables that are joined by shuffle; nothing is
broadcast but what the planner finds small.

Cases: a null URL or one without ``://`` has an empty host and path, which no
rule fits, and the score 0; repeated rows each train the models and each get a
verdict; without accepted or without rejected URLs the threshold is null and
what no rule decides is allowed; URLs of any length are scored whole; an empty
table gives an empty result; other columns, whatever their names, are not read.
Scores are sums of exact decimals, so reruns agree to the last URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
ALPHABET = 256.0
HELD_OUT = "012"  # first hexadecimal digits of the hashes of URLs that calibrate and don't train

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ? or #, with A-Z lower-cased; path: then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; a rule is host, then path, and fits subdomains and longer paths."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _grams(field: Column, text: Column) -> Column:
    """All characters of a text, each with the ORDER characters before it; the start is padded by the field's mark."""
    padded = F.concat(F.repeat(field, ORDER), text)
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, delta) from (gram, a, r), the counts of each gram in accepted and rejected URLs, 0 where there are none."""
    each = grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ORDER))))
    each = each.withColumn("ctx", F.expr(f"substring(gram, {ORDER + 1} - k, k)")).withColumn("ch", F.expr(f"substring(gram, {ORDER + 1}, 1)"))
    levels = each.groupBy("k", "ctx", "ch").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    same = W.partitionBy("k", "ctx")
    for x in "ar":
        levels = levels.withColumn(f"n_{x}", F.sum(x).over(same)).withColumn(f"t_{x}", F.sum((F.col(x) > 0).cast("long")).over(same))
    # written, so that a frequent context's rows are dealt anew for the join and don't stay with its window
    joined = each.select("gram", "k", "ctx", "ch").join(cut(levels), ["k", "ctx", "ch"])
    steps = joined.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "a", "r", "n_a", "n_r", "t_a", "t_r"))).alias("steps"))

    def p(x: str) -> Column:
        return F.aggregate("steps", F.lit(1.0 / ALPHABET), lambda low, s: F.when(s[f"n_{x}"] > 0, (s[x] + s[f"t_{x}"] * low) / (s[f"n_{x}"] + s[f"t_{x}"])).otherwise(low))

    return steps.select("gram", (F.log(p("a")) - F.log(p("r"))).alias("delta"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row; score is null where a rule decides."""
    host, path = host_and_path(F.col("__url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("said", said)

    # each distinct URL once, then each distinct host and path once
    known = urls.groupBy("host", "path").agg(F.first("said").alias("said"), F.count(F.lit(1)).alias("n"))
    fields = F.explode(F.array(F.struct(F.lit("\x01").alias("field"), F.col("host").alias("text")), F.struct(F.lit("\x02").alias("field"), F.col("path").alias("text")))).alias("part")
    held = F.substring(F.md5(F.concat_ws("\x00", "host", "path")), 1, 1).isin(*HELD_OUT)
    known = known.withColumn("held", held)
    accepted, rejected = (F.when((F.col("said") == x) & ~F.col("held"), F.col("n")).otherwise(0) for x in ("allow", "block"))
    parts = known.select(fields, accepted.alias("a"), rejected.alias("r")).groupBy("part").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    spread = parts.select("part", "a", "r", F.explode(F.when(F.length("part.text") > 0, _grams(F.col("part.field"), F.col("part.text")))).alias("gram"))
    # written, so that both sides of the join have exchanges of their own and the gram that begins every path is split
    deltas = cut(gram_scores(spread.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))).withColumn("delta", F.col("delta").cast("decimal(24,15)")))
    totals = cut(spread.select("part", "gram").join(deltas, "gram").groupBy("part").agg(F.sum("delta").cast("double").alias("total")))

    def scored(rows: DataFrame) -> DataFrame:
        for field, name in (("\x01", "host"), ("\x02", "path")):
            own = totals.where(F.col("part.field") == field).select(F.col("part.text").alias(name), F.col("total").alias(f"{name}_total"))
            rows = rows.join(own, name, "left")
        total = F.coalesce("host_total", F.lit(0.0)) + F.coalesce("path_total", F.lit(0.0))
        return rows.withColumn("score", total / F.greatest(F.lit(1), F.length("host") + F.length("path"))).drop("host_total", "path_total")

    exact = lambda side, held: [F.sum(F.when(side & held, x)) for x in (F.col("score").cast("decimal(24,15)") * F.col("n"), F.col("n"))]
    columns = {f"{said}_{name}": exact(F.col("said") == said, held) for said in ("allow", "block") for name, held in (("held", F.col("held")), ("all", F.lit(True)))}
    sums = scored(known.where("said is not null")).agg(*[(x.cast("double") / n).alias(name) for name, (x, n) in columns.items()]).first()
    means = [sums[f"{said}_held"] if None not in (sums["allow_held"], sums["block_held"]) else sums[f"{said}_all"] for said in ("allow", "block")]
    threshold = None if None in means else sum(means) / 2
    unknown = scored(urls.where("said is null"))
    verdict = F.when(F.lit(threshold).cast("double").isNull() | (F.col("score") >= F.lit(threshold)), "allow").otherwise("block")
    decided = urls.where("said is not null").withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.col("said"))
    both = decided.unionByName(unknown.withColumn("verdict", verdict))
    return both.select("page_id", "host", "path", "rule", "verdict", "score", F.lit(threshold).cast("double").alias("threshold"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH urls AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split_urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM split_urls
), known AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said, left(md5(host || chr(0) || path), 1) IN ('0', '1', '2') AS held FROM ruled
), parts AS (
  SELECT field, txt, sum(CASE WHEN said = 'allow' AND NOT held THEN 1 ELSE 0 END) AS a, sum(CASE WHEN said = 'block' AND NOT held THEN 1 ELSE 0 END) AS r
  FROM (SELECT chr(1) AS field, host AS txt, said, held FROM known UNION ALL SELECT chr(2), path, said, held FROM known) GROUP BY 1, 2
), spread AS (
  SELECT field, txt, a, r, substr(repeat(field, 4) || txt, i, 5) AS gram FROM (SELECT *, unnest(range(1, length(txt) + 1)) AS i FROM parts)
), grams AS (
  SELECT gram, sum(a) AS a, sum(r) AS r FROM spread GROUP BY 1
), each AS (
  SELECT gram, k, substr(gram, 5 - k, k) AS ctx, substr(gram, 5, 1) AS ch, a, r FROM grams, (SELECT unnest(range(0, 5)) AS k)
), levels AS (
  SELECT *, sum(a) OVER w AS n_a, sum((a > 0)::INT) OVER w AS t_a, sum(r) OVER w AS n_r, sum((r > 0)::INT) OVER w AS t_r
  FROM (SELECT k, ctx, ch, sum(a) AS a, sum(r) AS r FROM each GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY k, ctx)
), wide AS (
  SELECT e.gram,
    list(CASE WHEN l.n_a > 0 THEN l.a::DOUBLE / (l.n_a + l.t_a) ELSE 0 END ORDER BY k) AS ca, list(CASE WHEN l.n_a > 0 THEN l.t_a::DOUBLE / (l.n_a + l.t_a) ELSE 1 END ORDER BY k) AS la,
    list(CASE WHEN l.n_r > 0 THEN l.r::DOUBLE / (l.n_r + l.t_r) ELSE 0 END ORDER BY k) AS cr, list(CASE WHEN l.n_r > 0 THEN l.t_r::DOUBLE / (l.n_r + l.t_r) ELSE 1 END ORDER BY k) AS lr
  FROM each e JOIN levels l USING (k, ctx, ch) GROUP BY 1
), deltas AS (
  SELECT gram, ln(ca[5]+la[5]*(ca[4]+la[4]*(ca[3]+la[3]*(ca[2]+la[2]*(ca[1]+la[1]/256)))))
             - ln(cr[5]+lr[5]*(cr[4]+lr[4]*(cr[3]+lr[3]*(cr[2]+lr[2]*(cr[1]+lr[1]/256))))) AS delta FROM wide
), totals AS (
  SELECT field, txt, sum(delta) AS total FROM spread JOIN deltas USING (gram) GROUP BY 1, 2
), scored AS (
  SELECT k.*, (coalesce(h.total, 0) + coalesce(p.total, 0)) / greatest(1, length(host) + length(path)) AS score
  FROM known k LEFT JOIN totals h ON h.field = chr(1) AND h.txt = host LEFT JOIN totals p ON p.field = chr(2) AND p.txt = path
), bar AS (
  SELECT coalesce((avg(score) FILTER (said = 'allow' AND held) + avg(score) FILTER (said = 'block' AND held)) / 2, (avg(score) FILTER (said = 'allow') + avg(score) FILTER (said = 'block')) / 2) AS threshold FROM scored
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN threshold IS NULL OR score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM scored, bar
"""
