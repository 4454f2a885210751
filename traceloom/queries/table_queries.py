"""Text, manifests, and changes of stored tables."""
from pyspark.sql import functions as F

from .. import catalog
from ..functions import text
from ..operators import tables
from ..sources import manifests
from .base import query


@query("""WITH o AS (SELECT event_id, 'A=' || event_type || ',' || user_id || '; B ;C= ' || (user_id % 5) AS options FROM events)
SELECT event_id, regexp_extract(options, 'A=([^;]*)', 1) AS a, 'true' AS b, trim(regexp_extract(options, 'C=([^;]*)', 1)) AS c, NULL::VARCHAR AS d FROM o""")
def options_tokenize(spark, d):
    options = F.concat(F.lit("A="), "event_type", F.lit(","), F.col("user_id").cast("string"), F.lit("; B ;C= "), (F.col("user_id") % 5).cast("string"))
    own = spark.read.parquet(f"{d}/events.parquet").select("event_id", text.options_map(options).alias("o"))
    return own.select("event_id", *(F.try_element_at("o", F.lit(k)).alias(k.lower()) for k in "ABCD"))


@query("""WITH w AS (SELECT CAST(i AS INT) AS nm, i::DOUBLE AS x FROM range(350, 800) t(i)), s AS (SELECT nm, x, CASE WHEN x >= 380 AND x < 420 THEN 0.3 + 0.7 * (x - 380) / 40 WHEN x >= 420 AND x < 701 THEN 1 WHEN x >= 701 AND x <= 780 THEN 0.3 + 0.7 * (780 - x) / 80 ELSE 0 END::DOUBLE AS f,
CASE WHEN x < 440 THEN (440 - x) / 60 WHEN x >= 510 AND x < 580 THEN (x - 510) / 70 WHEN x >= 580 THEN 1 ELSE 0 END::DOUBLE AS r, CASE WHEN x >= 440 AND x < 490 THEN (x - 440) / 50 WHEN x >= 490 AND x < 580 THEN 1 WHEN x >= 580 AND x < 645 THEN (645 - x) / 65 ELSE 0 END::DOUBLE AS g, CASE WHEN x < 490 THEN 1 WHEN x < 510 THEN (510 - x) / 20 ELSE 0 END::DOUBLE AS b FROM w)
SELECT nm, CAST(round_even(pow(r * f, 0.8::DOUBLE) * 255, 0) AS INT) AS red, CAST(round_even(pow(g * f, 0.8::DOUBLE) * 255, 0) AS INT) AS green, CAST(round_even(pow(b * f, 0.8::DOUBLE) * 255, 0) AS INT) AS blue FROM s""")
def wavelength_rgb(spark, d):
    own = spark.range(350, 800).select(F.col("id").cast("int").alias("nm"), text.wavelength_rgb(F.col("id")).alias("c"))
    return own.select("nm", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("red", "green", "blue"))))


@query("""WITH p(panel, marker) AS (SELECT 'P0', 'x/m' || i FROM range(1, 8) t(i) UNION ALL SELECT 'P1', 'x/m' || i FROM range(1, 6) t(i) UNION ALL SELECT 'P2', 'x/m' || i FROM range(2, 8) t(i)),
h AS (SELECT DISTINCT 's' || l_partkey AS sample, 'f' || l_partkey AS assay, 'P' || (l_partkey % 3) AS panel, upper('x/m' || l_linenumber) AS marker FROM lineitem WHERE l_quantity > 30), k AS (SELECT DISTINCT sample, assay, panel FROM h),
x AS (SELECT k.*, upper(p.marker) AS marker FROM k JOIN p USING (panel) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sample = k.sample AND h.assay = k.assay AND h.marker = upper(p.marker))),
u AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.panel = h.panel AND upper(p.marker) = h.marker))
SELECT k.sample, k.assay, k.panel, coalesce((SELECT 'exclude=' || string_agg(marker, ',' ORDER BY marker) FROM x WHERE x.sample = k.sample AND x.assay = k.assay), '') AS options,
coalesce((SELECT string_agg(marker, ',' ORDER BY marker) FROM u WHERE u.sample = k.sample AND u.assay = k.assay), '') AS unknown FROM k""")
def genemapper_excludes(spark, d):
    key = F.col("l_partkey").cast("string")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 30").select(
        F.concat(F.lit("f"), key).alias("Sample File"), F.concat(F.lit("s"), key).alias("Sample Name"), F.lit("r").alias("Run Name"), F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string")).alias("Panel"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("Marker"),
    )
    panels = [("P0", f"x/m{i}") for i in range(1, 8)] + [("P1", f"x/m{i}") for i in range(1, 6)] + [("P2", f"x/m{i}") for i in range(2, 8)]
    own = manifests.genemapper(rows, spark.createDataFrame(panels, "panel string, marker string"), "x")
    return own.withColumn("unknown", F.array_join("unknown", ","))


@query("SELECT l_partkey AS assay, count(DISTINCT l_suppkey)::BIGINT AS runs FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def genemapper_mixed_runs(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1").select(F.col("l_partkey").alias("Sample File"), F.col("l_suppkey").alias("Run Name"))
    return manifests.mixed_runs(rows)


@query("""WITH o AS (SELECT c_name AS code, c_nationkey AS category, CAST(NULL AS VARCHAR) AS remark FROM customer WHERE c_custkey < 900), n AS (SELECT upper(c_name) AS code, CAST(c_nationkey + 100 AS INT) AS category, 'new' AS remark FROM customer WHERE c_custkey >= 800)
SELECT coalesce(o.code, n.code) AS code, coalesce(n.category, o.category) AS category, coalesce(n.remark, o.remark) AS remark FROM o FULL JOIN n ON lower(o.code) = lower(n.code)""")
def sample_upsert(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    old = rows.where("c_custkey < 900").select(F.col("c_name").alias("code"), F.col("c_nationkey").alias("category"), F.lit(None).cast("string").alias("remark"))
    new = rows.where("c_custkey >= 800").select(F.upper("c_name").alias("code"), (F.col("c_nationkey") + 100).alias("category"), F.lit("new").alias("remark"))
    return tables.upsert(old, new, ["code"], fold=["code"])


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def cascade_delete(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    stored = {"customers": customers, "orders": orders, "lines": lines}
    gone = orders.where("o_custkey % 10 = 3").select(F.col("o_custkey").alias("c_custkey")).distinct()
    chain = [("customers", "c_custkey", "c_custkey"), ("orders", "o_orderkey", "o_custkey"), ("lines", "l_orderkey", "l_orderkey")]
    return tables.cascade(stored, gone, chain)["lines"]


@query("SELECT p_name AS code, p_brand AS batch, count(*)::BIGINT AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return tables.repeated(catalog.samples(spark, d), ["code", "batch"])


@query("WITH k AS (SELECT 'b' || user_id % 7 || '|' || user_id || '|f|' || event_type AS key FROM events) SELECT split_part(key, '|', 1) AS batch, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def peak_cache_counts(spark, d):
    user = F.col("user_id").cast("string")
    keys = spark.read.parquet(f"{d}/events.parquet").select(F.concat_ws("|", F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")), user, F.lit("f"), "event_type").alias("key"))
    return tables.cache_counts(keys)


@query("SELECT s_suppkey AS assay_id, CASE WHEN s_nationkey = 3 THEN 'P9' ELSE 'P' || s_nationkey END AS panel, s_name AS filename, 's' || s_suppkey AS sample FROM supplier")
def reassign_panels(spark, d):
    key = F.col("s_suppkey").cast("string")
    own = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("assay_id"), F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("panel"), F.col("s_name").alias("filename"), F.concat(F.lit("s"), key).alias("sample"))
    return tables.reassign(own, own.where("panel = 'P3'").select("sample", "filename", F.lit("P9").alias("panel")))


@query("SELECT p_partkey AS sample_id, replace(replace(replace(replace(p_name || '|' || p_brand || '/x', ' ', ''), '|', '_'), '#', '_'), '/', '_') AS label FROM part")
def plain_labels(spark, d):
    own = catalog.samples(spark, d)
    return own.select("sample_id", text.plain_label(F.concat("code", F.lit("|"), "batch", F.lit("/x"))).alias("label"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_option(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query()
def abif_scan(spark, d):
    """Tags of files that are written here first, one an assay, and read as the reader finds them."""
    from ..sources import abif
    from .signal_queries import _PIECE, _raw, assay_tops

    def build(batches):
        import pandas as pd

        for batch in batches:
            for i in range(0, len(batch), _PIECE):
                piece = batch.iloc[i : i + _PIECE]
                both = [(_raw(2 * a + 1, v), _raw(2 * a, z)) for a, v, z in zip(piece["assay_id"], piece["vic"], piece["liz"], strict=True)]
                files = [abif.write_tags({("DyeN", 1): (18, "VIC"), ("DyeN", 5): (18, "LIZ"), ("DATA", 1): (4, v), ("DATA", 105): (4, z), ("RUND", 1): (10, (2020, 1, 2)), ("RUNT", 1): (11, (3, 4, 5, 0))}) for v, z in both]
                yield pd.DataFrame({"path": "a" + piece["assay_id"].astype(str), "content": files})

    files = assay_tops(spark, d).mapInPandas(build, "path string, content binary")
    return abif.file_channels(files).select("path", "channel", "dye", "wavelength", "started", F.size("raw").alias("n"), F.array_max("raw").alias("highest"))
