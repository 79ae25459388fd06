"""Tables projected to a class model: customers and nations are classes, orders are attributes, suppliers associations; customers in debt inherit nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names that the attributes have in turn.
TYPES = ["decimal", "Int", "xsd:date", "money", "text"]


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``classes, attributes, relations`` as ``operators.model`` takes them."""
    nation, customer, supplier, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "customer", "supplier", "orders"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    text = lambda x: x.cast("string")
    none, package, key = text(F.lit(None)), F.lower("c_mktsegment"), F.col("s_suppkey")
    classes = (
        customer.select(package.alias("package"), name("BigCustomer", "c_custkey").alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("display"), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("owes in "), "c_mktsegment")).alias("note"))
        .unionAll(nation.select(none, name("Nation", "n_nationkey"), F.col("n_name"), none))
        .unionAll(supplier.where(key % 10 == 0).select(F.lit("supply"), name("BigCustomer", "s_suppkey"), none, none))
        .unionAll(supplier.select(F.lit("supply"), name("XMLSource", "s_suppkey"), none, none))
    )
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("o_orderkey") % len(TYPES) + 1).cast("int"))
    owners = customer.select(F.col("c_custkey").alias("o_custkey"), package.alias("package"))
    attributes = orders.join(owners, "o_custkey").select("package", name("BigCustomer", "o_custkey").alias("class"), name("orderTotalOf", "o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 11 > 0, kind).alias("datatype"))
    up, to = F.lit("inheritance"), F.lit("association")
    relations = (
        customer.where("c_acctbal >= 0").select(F.concat(package, F.lit("."), name("BigCustomer", "c_custkey")).alias("source"), name("Nation", "c_nationkey").alias("target"), up.alias("kind"), none.alias("label"))
        .unionAll(nation.where("n_nationkey < 3").select(name("Nation", "n_nationkey"), F.concat(F.lit("Nation"), text((F.col("n_nationkey") + 1) % 3)), up, none))
        .unionAll(supplier.select(name("Nation", "s_nationkey"), F.concat(F.when(key % 20 == 7, "Ghost").otherwise("XMLSource"), text(key)), to, F.when(key % 3 == 1, "supplies goods To").when(key % 3 == 2, F.concat(F.lit("hasSource-"), text(key)))))
    )
    return classes, attributes, relations
