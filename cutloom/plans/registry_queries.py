"""Queries over registries: names used, declared, installed and listed; and the streaming refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators import registry_checks
from cutloom.plans.registry import query
from cutloom.tables import table

NAMES_SQL = """
WITH installed AS (SELECT DISTINCT replace(lower(p_name || '_' || p_type), '_', '-') AS name FROM part WHERE p_size < 40),
raw_used AS (SELECT DISTINCT lower(p_name || '_' || p_type) AS name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49),
used AS (SELECT DISTINCT replace(CASE WHEN name = 'red bolt_small' THEN 'hot gear_large' ELSE name END, '_', '-') AS name FROM raw_used),
declared AS (SELECT DISTINCT replace(lower(p_name || '_' || p_type), '_', '-') AS name FROM part WHERE p_retailprice < 950),
free AS (SELECT 'small ring-economy' AS name)"""
GAPS_SQL = f"""{NAMES_SQL}
SELECT name, 'unused' AS problem FROM installed WHERE name NOT IN (SELECT name FROM used) AND name NOT IN (SELECT name FROM free)
UNION ALL SELECT name, 'undeclared' FROM used WHERE name NOT IN (SELECT name FROM declared) AND name NOT IN (SELECT name FROM free) AND name IN (SELECT name FROM installed)"""


def gaps(spark: SparkSession, sf_dir: str, whitelisted: bool = False) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("name", F.concat_ws("_", "p_name", "p_type"))
    used = part.join(table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select(F.lower("name").alias("name")).distinct()
    aliases = spark.createDataFrame([("red bolt_small", "hot gear_large")], "import_name string, package string")
    free = spark.createDataFrame([("small ring_economy",)], "name string")  # plays the standard library
    return registry_checks.dependency_gaps(part.where("p_size < 40"), used, part.where("p_retailprice < 950"), aliases, free, part.where("p_retailprice > 1700") if whitelisted else None)


PART_SUMS = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query(f"""
WITH rows AS (SELECT o_orderpriority, sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}}') AS h FROM orders)
SELECT count(*) AS n, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) AS n_unknown,
       CASE WHEN count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, sha256(concat_ws(':', count(*)::VARCHAR, {PART_SUMS})) AS sha256 FROM rows""")
def q115_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's rows outside their domain, and the digest that a run freezes."""
    return registry_checks.governed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query("""
WITH tools AS (SELECT s_suppkey, 'scripts/s' || s_suppkey || '.py' AS path FROM supplier),
files AS (SELECT 'code/main/scripts/s' || s_suppkey || '.py' AS path FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'main/scripts/s' || s_suppkey || '.py' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT s_suppkey, t.path, coalesce(a.path, b.path) AS file FROM tools t LEFT JOIN files a ON a.path = 'code/main/' || t.path LEFT JOIN files b ON b.path = 'main/' || t.path""")
def q112_resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered scripts below the first of two roots that has them."""
    key = F.col("s_suppkey")
    tools = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("scripts/s"), key, F.lit(".py")).alias("path"))
    below = lambda root, every: tools.where(key % every == 0).select(F.concat(F.lit(root), "path").alias("path"))
    return registry_checks.resolved(tools, below("code/main/", 3).union(below("main/", 2)), ["code/main/", "main/"]).select("s_suppkey", "path", "file")


@query(GAPS_SQL)
def q29_dependency_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed names that nothing uses, and used names that nothing declares."""
    return gaps(spark, sf_dir)


@query(f"SELECT count(*) FILTER (problem = 'undeclared') AS n_undeclared, count(*) FILTER (problem = 'unused') AS n_unused, CASE WHEN count(*) FILTER (problem = 'undeclared') > 0 THEN 'FAIL' WHEN count(*) FILTER (problem = 'unused') > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM ({GAPS_SQL})")
def q71_dependency_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gaps amount to."""
    return registry_checks.verdict(gaps(spark, sf_dir))


WHITELIST_SQL = f"""{NAMES_SQL}, spare AS (SELECT DISTINCT replace(lower(p_name || '_' || p_type), '_', '-') AS name FROM part WHERE p_retailprice > 1700)
SELECT name, 'unused' AS problem FROM installed WHERE name NOT IN (SELECT name FROM used) AND name NOT IN (SELECT name FROM free) AND name NOT IN (SELECT name FROM spare)
UNION ALL SELECT name, 'undeclared' FROM used WHERE name NOT IN (SELECT name FROM declared) AND name NOT IN (SELECT name FROM free) AND name IN (SELECT name FROM installed)"""


@query(WHITELIST_SQL)
def q91_whitelisted_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a whitelist, which excuses unused names but no undeclared ones."""
    return gaps(spark, sf_dir, whitelisted=True)


PATH_SQL = "'scripts/' || (page_id % 13) || '/' || split_part(split_part(url, '/', 3), '.', 2) || '_' || (page_id % 50) || '.py'"


@query(f"""
WITH files AS (SELECT DISTINCT {PATH_SQL} AS path FROM pages), listed AS (SELECT DISTINCT {PATH_SQL} AS path FROM pages WHERE url LIKE 'https%'), allowed AS (SELECT DISTINCT {PATH_SQL} AS path FROM pages WHERE url LIKE '%utm_source%')
SELECT path FROM files WHERE path NOT IN (SELECT path FROM listed) AND split_part(path, '/', -1) NOT IN (SELECT split_part(path, '/', -1) FROM listed) AND path NOT IN (SELECT path FROM allowed)""")
def q30_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that no list has, by path or base name."""
    host = F.split(F.split("url", "/")[2], r"\.")[1]
    path = F.concat(F.lit("scripts/"), (F.col("page_id") % 13).cast("string"), F.lit("/"), host, F.lit("_"), (F.col("page_id") % 50).cast("string"), F.lit(".py"))
    pages = table(spark, sf_dir, "pages").select("url", path.alias("path"))
    return registry_checks.unregistered(pages.select("path").distinct(), pages.where("url LIKE 'https%'"), pages.where("url LIKE '%utm_source%'"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey")
def q72_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered keys that have nothing behind them."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""
WITH t AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'name: x' ELSE 'name: x' || chr(10) || 'status: ' || replace(lower(split_part(o_orderpriority, '-', 2)), ' ', '_') END AS text FROM orders),
s AS (SELECT CASE WHEN regexp_extract(text, '(?m)^status:\\s*(\\w+)', 1) = '' THEN 'none' ELSE regexp_extract(text, '(?m)^status:\\s*(\\w+)', 1) END AS status FROM t)
SELECT status, count(*) AS n, status NOT IN ('urgent', 'high', 'medium', 'low') AS bad FROM s GROUP BY status""")
def q57_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines of texts, and those that are no known status."""
    status = F.translate(F.lower(F.split("o_orderpriority", "-")[1]), " ", "_")
    text = F.when(F.col("o_orderstatus") == "P", "name: x").otherwise(F.concat(F.lit("name: x\nstatus: "), status))
    return registry_checks.statuses(table(spark, sf_dir, "orders").select(text.alias("text")), ["urgent", "high", "medium", "low"])


@query("SELECT name, n FROM (SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, name LIMIT 20")
def q73_first_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def q33_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by the streaming operator, run over the stored events as a batch."""
    from cutloom.streaming.refresh import counted_by_window

    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    found = counted_by_window(events.select("event_type", F.col("day").alias("ts")), "ts", "1 day", "1 day", None, ["event_type"])
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
