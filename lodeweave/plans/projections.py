"""Projections of star-schema tables into the canonical relations, each as a DataFrame and as the SQL that defines it.

Parts are symbols in files of ten, joined by consecutive lines of an order; nations are packages; suppliers and customers
are what packages hold. Return flags are confidences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input over all cores, where heavy work per row follows; large inputs have enough splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (32 << 20) else df


def tag(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def flag_confidence(column: str):
    return F.when(F.col(column) == "R", 2).when(F.col(column) == "A", 1).otherwise(0)


FLAG = "CASE {0} WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, confidence): a part to the part on the next line of an order, for large returned lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    a = line.where("l_returnflag = 'R' and l_quantity >= 40").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("s"))
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("d"), flag_confidence("l_returnflag").alias("c"))
    met = a.join(b, ["l_orderkey", "l_linenumber"]).where("s <> d")
    return met.groupBy("s", "d").agg(F.max("c").alias("confidence")).select(tag("p:", "s").alias("src"), tag("p:", "d").alias("dst"), "confidence")


PART_EDGES = f"""edges AS (
  SELECT 'p:' || a.l_partkey AS src, 'p:' || b.l_partkey AS dst, CAST(max({FLAG.format("b.l_returnflag")}) AS INTEGER) AS confidence
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_returnflag = 'R' AND a.l_quantity >= 40 AND a.l_partkey <> b.l_partkey GROUP BY 1, 2
)"""


def part_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 50
    rows = table(spark, sf_dir, "part").where(kind < 3)
    return rows.select(F.when(kind == 0, "production").when(kind == 1, "test").otherwise("tooling").alias("kind"), tag("p:", "p_partkey").alias("node"), (F.col("p_size") % 3).cast("int").alias("confidence"))


PART_ROOTS = """roots AS (
  SELECT CASE p_partkey % 50 WHEN 0 THEN 'production' WHEN 1 THEN 'test' ELSE 'tooling' END AS kind, 'p:' || p_partkey AS node, CAST(p_size % 3 AS INTEGER) AS confidence
  FROM part WHERE p_partkey % 50 < 3
)"""


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols: parts in files of ten, of which the second five are members of the first; names repeat between files."""
    k = F.col("p_partkey")
    last = k % 10
    return table(spark, sf_dir, "part").select(
        tag("p:", "p_partkey").alias("sym"),
        F.concat(F.lit("f:"), F.floor(k / 10).cast("string")).alias("path"),
        F.when(last < 5, F.concat(F.lit("n"), last.cast("string"))).otherwise(F.concat(F.lit("m"), (k % 3).cast("string"))).alias("name"),
        F.when(last >= 5, F.concat(F.lit("n"), (last - 5).cast("string"))).alias("member_of"),
        F.when(F.col("p_size") == 1, "constructor").otherwise("function").alias("kind"),
        (F.col("p_size") % 2 == 0).alias("implicitly_invoked"),
    )


PART_SYMBOLS = """symbols AS (
  SELECT 'p:' || p_partkey AS sym, 'f:' || (p_partkey // 10) AS path,
         CASE WHEN p_partkey % 10 < 5 THEN 'n' || (p_partkey % 10) ELSE 'm' || (p_partkey % 3) END AS name,
         CASE WHEN p_partkey % 10 >= 5 THEN 'n' || (p_partkey % 10 - 5) END AS member_of,
         CASE WHEN p_size = 1 THEN 'constructor' ELSE 'function' END AS kind, p_size % 2 = 0 AS implicitly_invoked
  FROM part
)"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: some are unclaimed, some vendored; units of five files."""
    k = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("k")).distinct()
    return k.select(
        tag("f:", "k").alias("path"),
        F.when(F.col("k") % 17 != 0, "lang").alias("language"),
        F.when(F.col("k") % 11 == 0, "vendored").otherwise("authored").alias("origin"),
        F.concat(F.lit("u:"), F.floor(F.col("k") / 5).cast("string")).alias("unit"),
        F.when(F.col("k") % 6 == 0, "test").otherwise("production").alias("role"),
    )


PART_FILES = """files AS (
  SELECT DISTINCT 'f:' || (p_partkey // 10) AS path, CASE WHEN (p_partkey // 10) % 17 <> 0 THEN 'lang' END AS language,
         CASE WHEN (p_partkey // 10) % 11 = 0 THEN 'vendored' ELSE 'authored' END AS origin, 'u:' || (p_partkey // 10 // 5) AS unit,
         CASE WHEN (p_partkey // 10) % 6 = 0 THEN 'test' ELSE 'production' END AS role
  FROM part
)"""


def nation_edges(spark: SparkSession, sf_dir: str, over: float = 1.0) -> DataFrame:
    """(src, dst, confidence, n): supplier nation to customer nation, where lines are over `over` times the mean."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = line.join(order, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    mean = F.broadcast(n.agg(F.avg("n").alias("mean")))  # one row
    met = n.join(mean, F.col("n") > F.col("mean") * over)
    return met.select(tag("n:", "s_nationkey").alias("src"), tag("n:", "c_nationkey").alias("dst"), (F.col("n") % 3).cast("int").alias("confidence"), "n")


def nation_edges_sql(over: float = 1.0, name: str = "edges") -> str:
    return f"""{name}_n AS (
  SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2
), {name} AS (
  SELECT 'n:' || s_nationkey AS src, 'n:' || c_nationkey AS dst, CAST(n % 3 AS INTEGER) AS confidence, n FROM {name}_n WHERE n > (SELECT avg(n) FROM {name}_n) * {over}
)"""


def lines_with_origin(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """Lines joined with their customer and both nations."""
    line = table(spark, sf_dir, "lineitem").where(where).select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    c_nation = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("c_regionkey"))
    s_nation = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("s_regionkey"))
    return line.join(order, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").join(c_nation, "c_nationkey").join(s_nation, "s_nationkey")


def lines_sql(where: str, name: str = "lines") -> str:
    return f"""{name} AS (
  SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_returnflag, l_quantity, l_shipdate, o_custkey, o_orderpriority, c_nationkey, s_nationkey, cn.n_regionkey AS c_regionkey, sn.n_regionkey AS s_regionkey
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey WHERE {where}
)"""


def url_path(url):
    """A page's address as a path: host and segments, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"[?#].*$", "")


PAGE_PATHS = r"paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, html FROM pages)"
#: The directories above a path, as a list; the last is the root.
ANCESTORS = "list_concat(list_transform(range(1, len(string_split({0}, '/'))), lambda i: array_to_string(string_split({0}, '/')[1:i], '/')), [''])"
