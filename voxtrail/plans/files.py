"""Scans and sinks: the given tables are written to the shared folder in the reference
formats and read back, so the check sees what the reader returned."""

from pyspark.sql import functions as F

from voxtrail.operators import compare as C, report as R
from voxtrail.plans.contracts import sub
from voxtrail.plans.registry import query
from voxtrail.session import scratch_path
from voxtrail.sources import tables as S


@query("s1_scan_units", """
SELECT roi, contrast, count(*) AS n, rnd(avg(accuracy)) AS mean, count(DISTINCT subject) AS n_files FROM results GROUP BY roi, contrast""")
def s1(c):
    path = scratch_path(c.spark, "units")
    # a unit's folder may hold several files: its rows are dealt by region too
    (c.view("results").withColumn("unit", F.col("subject")).repartition("unit", F.pmod(F.xxhash64("roi"), F.lit(4)))
     .write.partitionBy("unit").option("header", True).csv(path))
    d = S.scan_units(c.spark, f"{path}/unit=*", "subject int, roi string, contrast string, accuracy double")
    unit = F.regexp_extract("source_file", "unit=[0-9]+", 0)
    return d.groupBy("roi", "contrast").agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("mean"), F.count_distinct(unit).alias("n_files"))


CONF = """SELECT CAST(l_orderkey AS STRING) AS t, CAST(l_linenumber AS STRING) AS run, CASE WHEN l_tax < 0.005 THEN 'n/a'
 WHEN l_tax < 0.015 THEN 'NaN' WHEN l_tax < 0.025 THEN 'NA' ELSE CAST(l_discount - 0.02 AS STRING) END AS fd FROM {lineitem}"""


@query("s2_scan_confounds", """
SELECT run, count(*) AS n, count(v) AS n_valid, count(*) FILTER (v < 0) AS n_invalid, rnd(sum(v)) AS total
FROM (SELECT l_linenumber::VARCHAR AS run, CASE WHEN l_tax >= 0.025 THEN l_discount - 0.02 END AS v FROM lineitem) GROUP BY run""")
def s2(c):
    path = scratch_path(c.spark, "confounds")
    c.spark.sql(sub(c, CONF)).write.option("sep", "\t").option("header", True).csv(path)
    d = S.scan_tsv(c.spark, path, ["t", "run", "fd"], ["fd"])
    bad = S.invalid_numbers(d, "fd").groupBy("run").agg(F.count(F.lit(1)).alias("n_invalid"))
    g = d.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("fd").alias("n_valid"), F.sum("fd").alias("total"))
    return g.join(bad, "run", "left").fillna(0, ["n_invalid"])


@query("s3_scan_ledger", """
SELECT stage, count(*) AS n, count(*) FILTER (sequence <> 1 AND pseq IS DISTINCT FROM sequence - 1) AS n_gaps FROM (
 SELECT stage, sequence, lag(sequence) OVER (ORDER BY sequence) AS pseq FROM ledger_body WHERE sequence % 997 <> 5) GROUP BY stage""")
def s3(c):
    from voxtrail.operators.validate import previous_row
    path = scratch_path(c.spark, "ledger")
    c.view("ledger_body").filter("sequence % 997 <> 5").write.json(path)
    d = S.scan_ledger(c.spark, path, "sequence long, event string, subject long, stage string, status string")
    d = previous_row(d, [], "sequence", ["stage"])
    gap = (F.col("sequence") != 1) & F.col("prev_stage").isNull()
    return d.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("n_gaps"))


LINES = """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'name without number' WHEN p_partkey % 13 = 0 THEN concat(p_partkey, ' *.*.*.*.*')
 WHEN p_partkey % 17 = 0 THEN CAST(p_partkey AS STRING) ELSE concat(CAST(p_partkey - 20 AS DOUBLE), ' ', p_brand, ' ', p_size) END AS value FROM {part}"""


@query("s4_scan_labels", """
SELECT (p_partkey - 20)::INT AS roi_id, p_brand AS roi_name FROM part WHERE p_partkey > 20 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0
 AND p_partkey % 17 <> 0""")
def s4(c):
    path = scratch_path(c.spark, "labels")
    c.spark.sql(sub(c, LINES)).write.text(path)
    return S.scan_labels(c.spark, path)


@query("p17_file_identity", """
SELECT c_nationkey AS unit, octet_length(encode(t))::BIGINT AS size, sha256(t) AS sha256 FROM (
  SELECT c_nationkey, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS t FROM customer GROUP BY c_nationkey)""")
def p17_files(c):
    path = scratch_path(c.spark, "payloads")
    (c.table("customer").select(F.col("c_nationkey").alias("unit"), "c_custkey", "c_name").repartition("unit")
     .sortWithinPartitions("unit", "c_custkey").select("unit", "c_name").write.partitionBy("unit").text(path))
    d = S.scan_payloads(c.spark, path).filter(F.col("path").contains("unit="))
    return d.select(F.regexp_extract("path", "unit=(-?[0-9]+)", 1).cast("int").alias("unit"), "size", "sha256")


@query("s5_pattern_cache", """
SELECT subject, count(*) AS n, rnd(sum(list_sum(embedding[17:32]::DOUBLE[]))) AS total FROM trials GROUP BY subject""")
def s5(c):
    from voxtrail.functions import arrays as A
    from voxtrail.operators.patterns import slice_regions
    path = scratch_path(c.spark, "cache")
    S.write_pattern_cache(slice_regions(c.view("trials"), "embedding", 16), path, "roi", "subject",
                          spread_by="vec_id")
    d = c.spark.read.parquet(path).filter("roi = 'r1'")  # prunes to one folder
    return d.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum(A.total(F.col("features"))).alias("total"))


@query("s6_result_sink", """
SELECT roi, contrast, rnd(avg(accuracy)) AS mean FROM results GROUP BY ALL""")
def s6(c):
    long = c.view("results").groupBy("roi", "contrast").agg(F.avg("accuracy").alias("mean"))
    names = ["AF", "AO", "NF", "NO", "RF", "RO"]
    path = scratch_path(c.spark, "sink")
    S.write_results(long, R.to_wide(long, ["roi"], "contrast", "mean", names), path)
    return R.to_long(c.spark.read.parquet(f"{path}/wide"), ["roi"], names, "contrast", "mean")


@query("s7_resume", """
SELECT o_orderkey AS unit FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus='F')""")
def s7(c):
    work = c.table("orders").select(F.col("o_orderkey").alias("unit"))
    done = c.table("lineitem").filter("l_linestatus='F'").select(F.col("l_orderkey").alias("unit"))
    return C.unfinished(work, done, ["unit"])


@query("s8_merge_trees", """
WITH m AS (SELECT subject, roi, contrast, kind, accuracy FROM pipeline_results WHERE pipeline='p0' AND kind='within'
 UNION ALL SELECT subject, roi, contrast, kind, accuracy FROM pipeline_results WHERE pipeline='p1' AND kind='cross'),
n AS (SELECT subject, count(*) AS n_rows FROM m GROUP BY subject)
SELECT subject, roi, contrast, kind, rnd(accuracy) AS accuracy, n_rows, n_rows = 102 AS complete FROM m JOIN n USING (subject)""")
def s8(c):
    p = c.view("pipeline_results")
    return C.merge_trees(p.filter("pipeline='p0'").drop("pipeline"), p.filter("pipeline='p1'").drop("pipeline"),
                         "kind", "subject", 102)
