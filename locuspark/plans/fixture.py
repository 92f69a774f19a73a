"""A genotype, phenotypes and p-values derived from the star-schema tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locuspark.sources.genotype import Genotype, from_long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snp() -> Column:
    return F.concat("p_brand", F.lit("_"), "p_type")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type of a part; a type is a chromosome."""
    names = table(spark, sf_dir, "part").select(snp().alias("snp"), F.col("p_type").alias("chromosome"), "p_brand").distinct()
    place = F.row_number().over(Window.partitionBy("chromosome").orderBy("p_brand")) * F.lit(100000.0)
    index = F.row_number().over(Window.orderBy("snp")) - 1  # 150 markers at most
    return names.select("snp", "chromosome", place.alias("position"), index.alias("marker_idx"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: sample, sample_idx, y (account balance), nation, segment."""
    rows = table(spark, sf_dir, "customer")
    index = F.row_number().over(Window.orderBy("c_custkey")) - 1
    return rows.select(F.col("c_custkey").alias("sample"), index.alias("sample_idx"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a customer bought a marker, up to 2."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), snp().alias("snp"))
    bought = lines.join(orders, "l_orderkey").join(parts, "l_partkey").groupBy("sample", "snp").agg(F.count(F.lit(1)).alias("n"))
    return bought.select("sample", "snp", F.least(F.lit(2), "n").cast("double").alias("dosage"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, pooled by nation and segment: 125 samples at any scale, with mean phenotypes."""
    pooled = samples(spark, sf_dir).groupBy("nation", "segment").agg(F.count(F.lit(1)).alias("size"), F.avg("y").alias("y"))
    index = F.row_number().over(Window.orderBy("nation", "segment")) - 1
    return pooled.select(F.concat("nation", F.lit("/"), "segment").alias("sample"), index.alias("sample_idx"), "y", "nation", "segment", "size")


def family_genotype(spark: SparkSession, sf_dir: str) -> Genotype:
    """Mean dosages of the families, as of pooled samples."""
    who, what = families(spark, sf_dir), markers(spark, sf_dir)
    members = samples(spark, sf_dir).select("sample", "nation", "segment").join(F.broadcast(who.drop("sample", "y")), ["nation", "segment"])
    cells = counts(spark, sf_dir).join(members, "sample").groupBy("sample_idx", "snp").agg((F.sum("dosage") / F.first("size")).alias("dosage"))
    cells = cells.join(F.broadcast(what.select("snp", "marker_idx")), "snp")
    taxa = list(map(str, who.orderBy("sample_idx").select("sample").toArrow().column(0).to_pylist()))
    return from_long(cells.select("sample_idx", "marker_idx", "dosage"), what, taxa, absent=0.0)


def genotype(spark: SparkSession, sf_dir: str) -> Genotype:
    """Packed dosages; who bought nothing has 0."""
    who, what = samples(spark, sf_dir), markers(spark, sf_dir)
    cells = counts(spark, sf_dir).join(who.select("sample", "sample_idx"), "sample").join(F.broadcast(what.select("snp", "marker_idx")), "snp")
    taxa = list(map(str, who.orderBy("sample_idx").select("sample").toArrow().column(0).to_pylist()))
    return from_long(cells.select("sample_idx", "marker_idx", "dosage"), what, taxa, absent=0.0)


def with_missing(g: Genotype) -> Genotype:
    """Dosages missing where sample + marker is a multiple of 17."""
    gone = F.transform("dosages", lambda x, i: F.when((i + F.col("marker_idx")) % 17 == 0, F.lit(float("nan"))).otherwise(x))
    return g.with_packed(g.packed.withColumn("dosages", gone))


def phenotype(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    found = samples(spark, sf_dir).orderBy("sample_idx").select("sample", "y").toArrow()
    return dict(zip(map(str, found.column(0).to_pylist()), found.column(1).to_pylist()))


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as markers with a p-value each: marker_idx, snp, chromosome, position, p_value."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.cast("long").alias("marker_idx"),
        F.concat(F.lit("O"), key.cast("string")).alias("snp"),
        F.col("o_orderpriority").alias("chromosome"),
        (key * F.lit(1000.0)).alias("position"),
        (F.pow(((key * 7919) % 9973 + 1) / F.lit(9974.0), F.lit(2.0))).alias("p_value"),
    )


SQL = """
with recursive markers as materialized (
    select snp, chromosome, 100000.0 * row_number() over (partition by chromosome order by p_brand) as position,
           row_number() over (order by snp) - 1 as marker_idx
    from (select distinct p_brand || '_' || p_type as snp, p_type as chromosome, p_brand from part)),
customers as materialized (
    select c_custkey as sample, row_number() over (order by c_custkey) - 1 as sample_idx,
           c_acctbal as y, c_nationkey as nation, c_mktsegment as segment
    from customer),
counts as (
    select o_custkey as sample, p_brand || '_' || p_type as snp, least(2, count(*)) as dosage
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2),
{samples},
p as (
    select cast(o_orderkey as bigint) as marker_idx, 'O' || cast(o_orderkey as varchar) as snp, o_orderpriority as chromosome,
           o_orderkey * 1000.0 as position, pow(((o_orderkey * 7919) % 9973 + 1) / 9974.0, 2) as p_value
    from orders)"""

CUSTOMERS = """samples as (select * from customers),
g as (
    select s.sample, s.sample_idx, s.y, s.nation, k.marker_idx, k.snp, k.chromosome, k.position,
           cast(coalesce(c.dosage, 0) as double) as dosage
    from samples s cross join markers k left join counts c on c.sample = s.sample and c.snp = k.snp)"""

FAMILIES = """samples as (
    select nation || '/' || segment as sample, row_number() over (order by nation, segment) - 1 as sample_idx, avg(y) as y, nation, segment, count(*) as size
    from customers group by nation, segment),
pooled as (
    select s.sample_idx, c.snp, sum(c.dosage) as total
    from counts c join customers m on c.sample = m.sample join samples s on s.nation = m.nation and s.segment = m.segment group by 1, 2),
g as (
    select s.sample, s.sample_idx, s.y, s.nation, k.marker_idx, k.snp, k.chromosome, k.position,
           coalesce(c.total, 0) / cast(s.size as double) as dosage
    from samples s cross join markers k left join pooled c on c.sample_idx = s.sample_idx and c.snp = k.snp)"""


def sql(body: str, families: bool = False) -> str:
    """SQL over the same tables: markers, samples, counts, g and p."""
    return SQL.format(samples=FAMILIES if families else CUSTOMERS) + body
