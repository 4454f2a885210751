"""Mixing sources to target weights: certain whole copies, then a Pareto order sample of fixed size in words."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, new_path

#: Buckets of the rank at each level of the search for a source's threshold.
BUCKETS = 4096
#: Documents that fill what the sample leaves open in a source, one after another.
FILLS = 6
#: A document's inclusion odds grow with the binary digits of its size, from TILT for an empty one.
TILT = 8
#: Rows of a table of sources or of picked documents up to which a join broadcasts it, at some 100 bytes a row.
SMALL = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _level(total: Column, cap: Column, weight: Column, keys: list[str], order: list[Column]) -> Column:
    """The level at which least(cap, level * weight), summed over the rows of a key, is total; order: from the least cap / weight."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    free = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    return F.when(free > 0, (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / free)


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights 1, 2, 3, repeating by code point order, null last. Sharing anew what exceeds a cap, until none does, gives every
    source min(cap, level * weight); the level follows from the sources in order of cap / weight. One row a source.
    """
    ranked = sizes.withColumn("w", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    whole = Window.partitionBy()
    level = _level(F.sum("source_size").over(whole), F.col("cap"), F.col("w"), [], [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()])
    # it rises while sources stay capped and falls from the first one that does not
    return ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole)).select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def expected_copies(classes: DataFrame, most: float = 3.0) -> DataFrame:
    """(src, name, source_size, target, digits, sure, p, need) from (src, name, source_size, target, digits, words).

    A document of a source is expected to come min(most, level * (TILT + digits of its size)) times, so that the words of all
    its documents reach the target. sure copies are certain, p is the probability of one more, and need the words that those
    bring. One row for each source and number of digits.
    """
    q = F.col("digits") + F.lit(float(TILT))
    own = classes.withColumn("cap", F.col("words") * F.lit(most)).withColumn("w", F.col("words") * q)
    own = own.withColumn("level", _level(F.col("target"), F.col("cap"), F.col("w"), ["src", "name"], [F.col("digits").desc()]))
    of = Window.partitionBy("src", "name")
    copies = F.coalesce(F.least(F.lit(most), F.max("level").over(of) * q), F.lit(0.0))
    own = own.withColumn("copies", copies).withColumn("sure", F.floor("copies")).withColumn("p", F.col("copies") - F.floor("copies"))
    return own.withColumn("need", F.col("target") - F.sum(F.col("sure") * F.col("words")).over(of)).select("src", "name", "source_size", "target", "digits", "sure", "p", "need")


def _u(seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _cut(rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(keys, level, before): the bucket in which each source's running sum of sizes first exceeds its need, and the sum before it."""
    sums = rows.groupBy(*keys, level).agg(F.sum("size").alias("s"), F.max("need").alias("need"))
    run = sums.withColumn("after", F.sum("s").over(Window.partitionBy(*keys).orderBy(level))).where("after > need")
    return run.groupBy(*keys).agg(F.min(level).alias(level), F.min(F.col("after") - F.col("s")).alias("before"))


def _small(table: DataFrame, most: int = SMALL) -> DataFrame:
    """table, broadcast if it has few rows; the join decides otherwise. Its rows are a few numbers each."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def mix_sources(docs: DataFrame, most: float = 3.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Documents of a source have unequal inclusion probabilities, more for longer ones (expected_copies), and none is expected
    more than `most` times. Each takes the whole part of its expected copies for certain. The rest is a Pareto order sample:
    documents rank by u / (1 - u) over p / (1 - p), p being the other part, and enter in that order while the words they
    bring stay within the target. The threshold is found from sums over buckets of the rank, refined once, so no source is
    sorted or gathered in one task; only documents of one fine bucket are put in order. What the document at the threshold
    leaves open is filled by the first by rank of those that fill at least half of it, or if there is none by the first that
    fits, FILLS times; what is still open then is less than the smallest document left, or than a small part of one document.
    u comes from doc_id and size, so reruns agree. Null and empty texts have size 0 and take nothing; null is a source of its
    own, the last; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    return _copies(rows, most, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, most: float = 3.0, seed: str = "mix") -> DataFrame:
    """Each row of docs as many times as mix_sources takes it, with the columns of docs; rows it does not take are left out.

    The rows are numbered in a table in the shared folder, so that repeated ones are told apart.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    path = new_path(spark, "mix")
    docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    own = dict(zip(docs.columns, names, strict=True))
    kept = spark.read.parquet(path)
    rows = kept.select(F.col(own["doc_id"]).cast("long").alias("doc_id"), F.col(own["source"]).cast("string").alias("source"), word_count(F.col(own["text"])).alias("size"), "row")
    copies = _copies(durable(rows), most, seed).where("copies > 0 and size > 0").select("row", "copies")
    times = kept.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select(*names).toDF(*docs.columns)


def _copies(rows: DataFrame, most: float, seed: str) -> DataFrame:
    """Adds source_size, target and copies to durable rows of row, doc_id, source, size."""
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    digits = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0).alias("digits")
    classes = durable(rows.groupBy("source", digits).agg(F.sum("size").alias("words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    # a few rows a source
    classes = classes.join(F.broadcast(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    copies = durable(expected_copies(classes.select(F.xxhash64(named).alias("src"), named.alias("name"), "source_size", "target", "digits", "words"), most))
    rows = rows.select("row", "doc_id", "size", digits, F.xxhash64(named).alias("src"), named.alias("name")).join(_small(copies), ["src", "name", "digits"]).drop("name", "digits")
    odds = _u(seed) / (1 - _u(seed)) * (1 - F.col("p")) / F.col("p")
    rows = rows.withColumn("v", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds)))
    rows = rows.withColumn("b1", F.floor(F.col("v") * BUCKETS)).withColumn("b2", F.floor((F.col("v") * BUCKETS - F.floor(F.col("v") * BUCKETS)) * BUCKETS))
    rows = durable(rows)
    live = rows.where("v is not null")
    first = durable(_cut(live, ["src"], "b1"))
    inside = live.join(_small(first), ["src", "b1"]).withColumn("need", F.col("need") - F.col("before")).drop("before")
    second = durable(_cut(inside, ["src", "b1"], "b2"))
    last = inside.join(_small(second), ["src", "b1", "b2"])
    order = Window.partitionBy("src").orderBy("v", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("run", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("before") + F.col("run") + F.col("size") <= F.col("need"))
    extra = durable(last.select("row", "src", "size"))
    bounds = durable(first.select("src", F.col("b1").alias("c1")).join(second.select("src", F.col("b2").alias("c2")), "src"))
    below = F.col("v").isNotNull() & (F.col("c1").isNull() | (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))))
    marked = rows.join(_small(bounds), "src", "left").withColumn("below", below)
    # what the first pick leaves open in each source; the next documents that fit fill it
    gaps = durable(live.groupBy("src").agg(F.max("need").alias("need")).join(marked.where("below").groupBy("src").agg(F.sum("size").alias("got")), "src", "left").select("src", (F.col("need") - F.coalesce("got", F.lit(0))).alias("gap")))
    spent = extra.groupBy("src").agg(F.sum("size").alias("spent"))
    gaps = gaps.join(spent, "src", "left").select("src", (F.col("gap") - F.coalesce("spent", F.lit(0))).alias("gap"))
    for _ in range(FILLS):
        gaps = durable(gaps)
        fits = marked.where("v is not null and not below").join(_small(gaps), "src").where("size <= gap and size > 0").join(_small(extra.select("row")), "row", "left_anti")
        fits = fits.select("src", (F.col("v") + F.when(F.col("size") * 2 <= F.col("gap"), 1).otherwise(0)).alias("late"), "doc_id", "row", "size")
        best = fits.groupBy("src").agg(F.min("late").alias("late"))
        fill = fits.join(_small(durable(best)), ["src", "late"]).groupBy("src").agg(F.min(F.struct("doc_id", "row", "size")).alias("m")).select("src", "m.row", "m.size")
        fill = durable(fill.select("row", "src", "size"))
        extra = durable(extra.unionByName(fill))
        gaps = gaps.join(fill.select("src", F.col("size").alias("filled")), "src", "left").select("src", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap"))
    chosen = marked.join(_small(extra.select("row", F.lit(True).alias("extra"))), "row", "left")
    return chosen.select("row", "doc_id", "size", "source_size", "target", (F.col("sure") + F.when(F.col("below") | F.col("extra").isNotNull(), 1).otherwise(0)).alias("copies"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 2: the words each document gives to the mix."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FILL = """
g{k} AS (SELECT src, any_value(need) - sum(CASE WHEN more = 1 THEN size ELSE 0 END) AS gap FROM r{k} GROUP BY src),
b{k} AS (SELECT doc_id FROM (SELECT r.doc_id, row_number() OVER (PARTITION BY r.src ORDER BY r.v + CASE WHEN r.size * 2 <= g.gap THEN 1 ELSE 0 END, r.doc_id) AS k
  FROM r{k} r JOIN g{k} g ON r.src = g.src WHERE r.more = 0 AND r.size > 0 AND r.v IS NOT NULL AND r.size <= g.gap) WHERE k = 1),
r{n} AS (SELECT * REPLACE (CASE WHEN doc_id IN (SELECT doc_id FROM b{k}) THEN 1 ELSE more END AS more) FROM r{k})"""

OP2_SQL = (
    r"""
WITH d0 AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS digits FROM d0),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0::DOUBLE))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::DOUBLE)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
c AS (SELECT coalesce('s' || d.source, 'n') AS src, d.digits, any_value(t.source_size) AS source_size, any_value(t.target) AS target, sum(d.size)::DOUBLE AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2),
e AS (SELECT *, words * 3.0::DOUBLE AS cap, words * (digits + TILT.0::DOUBLE) AS w FROM c),
f AS (SELECT *, sum(w) OVER p - coalesce(sum(w) OVER o, 0.0::DOUBLE) AS free, target - coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS rest
  FROM e WINDOW p AS (PARTITION BY src), o AS (PARTITION BY src ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, coalesce(least(3.0::DOUBLE, max(CASE WHEN free > 0 THEN rest / free END) OVER (PARTITION BY src) * (digits + TILT.0::DOUBLE)), 0.0::DOUBLE) AS copies FROM f),
q AS (SELECT src, digits, source_size, target, floor(copies)::BIGINT AS sure, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY src) AS need FROM h),
u AS (SELECT d.doc_id, q.src, d.size, q.source_size, q.target, q.sure, q.p, q.need,
  (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN q ON coalesce('s' || d.source, 'n') = q.src AND d.digits = q.digits),
o AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u / (1 - u) * (1 - p) / p END AS odds FROM u),
v AS (SELECT *, odds / (1 + odds) AS v FROM o),
k AS (SELECT *, sum(CASE WHEN v IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY v NULLS LAST, doc_id) AS after FROM v),
r0 AS (SELECT *, CASE WHEN v IS NOT NULL AND after <= need THEN 1 ELSE 0 END AS more FROM k),""".replace("TILT", str(TILT))
    + ",".join(_FILL.format(k=k, n=k + 1) for k in range(FILLS))
    + f" SELECT doc_id, size, source_size, target, ((sure + more) * size)::BIGINT AS taken FROM r{FILLS}"
)
