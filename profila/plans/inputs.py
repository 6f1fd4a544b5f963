"""Tables the registered queries run on: the given Parquet tables and expressions over them.

The given tables have no nulls, repeated rows or decorated strings, so inputs for the
operators that look for those are derived here, over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profila.model import ROW, Dataset
from profila.session import staging_path, use_utc
from profila.sources.tables import profile_table

COPY_SHIFT = 1_000_000_000  # row numbers of repeated rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def blank_every(key: str, step: int, column: str) -> Column:
    """The column with nulls where the key is a multiple of step."""
    return F.when(F.col(key) % step != 0, F.col(column)).alias(column)


def events_gaps(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", blank_every("event_id", 13, "ts"), blank_every("event_id", 11, "user_id"),
        blank_every("event_id", 5, "event_type"), blank_every("event_id", 7, "value"))


def related(spark, folder, gaps: bool = False) -> DataFrame:
    """lineitem measures with strong, monotone, absent and no variation."""
    li = table(spark, folder, "lineitem")
    df = li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (-F.col("l_quantity") * F.col("l_quantity")).alias("falling"),
        F.col("l_tax").alias("tax"), F.lit(1.0).alias("fixed"))
    if gaps:
        df = df.withColumns({
            c: F.when((F.col("l_orderkey") + F.col("l_linenumber")) % step != 0, F.col(c))
            for c, step in (("qty", 7), ("net", 5), ("falling", 3))})
    return df


RELATED = ["qty", "price", "net", "falling", "tax", "fixed"]


def orders_repeated(spark, folder) -> DataFrame:
    """orders plus a second copy of every hundredth row."""
    o = table(spark, folder, "orders").withColumn(ROW, F.col("o_orderkey"))
    again = o.where("o_orderkey % 100 = 0").withColumn(ROW, F.col("o_orderkey") + COPY_SHIFT)
    return o.unionByName(again)


def orders_as_text(spark, folder) -> DataFrame:
    """orders as a messy text file would hold them."""
    o = table(spark, folder, "orders")
    key, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    return o.select(
        key.alias(ROW), key.cast("string").alias("order_id"),
        F.when(key % 50 == 0, "absent").otherwise(F.concat(F.lit("$"), price)).alias("price"),
        F.when(key % 10 == 0, "absent").otherwise(price).alias("mixed_price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("zoned"),
        F.when(key % 11 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(key % 9 != 0, F.col("o_orderstatus")).alias("status"),
        F.concat(F.lit("ref-"), key.cast("string")).alias("ref"))


def segments(spark, folder) -> DataFrame:
    """Customer segments per order with lower-case and shortened spellings."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    key, seg = F.col("o_orderkey"), F.col("c_mktsegment")
    return o.join(c, "o_custkey").select(
        key.alias(ROW),
        F.when(key % 11 == 0, F.lower(seg)).when(key % 13 == 0, F.substring(seg, 1, 1)).otherwise(seg).alias("segment"))


def short_segments(spark, folder) -> DataFrame:
    """Customer segments per order, some shortened to their first one or two letters."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    key, seg = F.col("o_orderkey"), F.col("c_mktsegment")
    return o.join(c, "o_custkey").select(key.alias(ROW), F.when(key % 13 == 0, F.substring(seg, 1, 1)).when(
        key % 17 == 0, F.lower(F.substring(seg, 1, 2))).otherwise(seg).alias("segment"))


def parts_split(spark, folder):
    """Parts of small and of other sizes; only the names of some brands occur on both sides."""
    p = table(spark, folder, "part").withColumn(ROW, F.col("p_partkey"))
    low = F.col("p_size") <= 25
    label = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(
        F.concat(F.when(low, "small ").otherwise("large "), F.col("p_brand"))).alias("brand")
    return [("small", p.where(low).select(ROW, label, "p_size")), ("large", p.where(~low).select(ROW, label, "p_size"))]


ODD_NAMES = ["S.No", "price.usd", "a", "a", "A", "b`t", "", "x  y"]


def odd_csv(spark, folder) -> str:
    """Orders as a comma-separated file with an odd header; every value column is the price times its place."""
    o = table(spark, folder, "orders")
    cells = [F.col("o_orderkey").cast("string")] + [
        (F.col("o_totalprice").cast("decimal(12,2)") * i).cast("string") for i in range(1, len(ODD_NAMES))]
    head = spark.createDataFrame([(",".join(ODD_NAMES),)], "value string")
    path = staging_path(spark, "odd-text")
    # one file, so that its header comes first
    head.unionByName(o.select(F.concat_ws(",", *cells).alias("value"))).coalesce(1).write.text(path)
    return path


def late_comma_csv(spark, folder) -> str:
    """Whole numbers, of which one in a hundred has a decimal comma; early notes are runs of commas."""
    key = F.col("o_orderkey")
    path = staging_path(spark, "late-text")
    table(spark, folder, "orders").select(
        key.cast("string").alias("key"),
        F.concat(key.cast("string"), F.when(key % 100 == 0, ",5").otherwise("")).alias("val"),
        F.when(key <= 300, F.concat(F.lit("a,b,c,"), key.cast("string"))).otherwise("none so far").alias("note"),
    ).write.option("header", True).option("sep", ";").csv(path)
    return path


def odd_parquet(spark, folder) -> str:
    o = table(spark, folder, "orders")
    path = staging_path(spark, "odd-parquet")
    o.select(
        F.col("o_orderkey").alias("o.key"), F.col("o_totalprice").alias("`price`"),
        (-F.col("o_totalprice")).alias("PRICE"), F.col("o_orderstatus").alias("Status."),
        F.col("o_orderpriority").alias("status.")).write.parquet(path)
    return path


def orders(spark, folder) -> Dataset:
    return profile_table("orders", table(spark, folder, "orders"), row="o_orderkey")


def orders_text(spark, folder) -> Dataset:
    return profile_table("orders_as_text", orders_as_text(spark, folder))


def orders_split(spark, folder) -> tuple[Dataset, Dataset]:
    """Orders before and from 1998, the later ones with a renamed, a retyped and a new label."""
    o = table(spark, folder, "orders").withColumn(ROW, F.col("o_orderkey"))
    early = o.where("o_orderdate < '1998-01-01'")
    late = o.where("o_orderdate >= '1998-01-01'").select(
        ROW, "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("o_custkey"),
        "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("ordered"),
        F.when(F.col("o_orderpriority") == "5-LOW", "6-NONE").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return profile_table("early", early), profile_table("late", late)


def orders_csv(spark, folder) -> str:
    """A semicolon-separated text file of orders, written by Spark to the shared folder.

    It has blanks around values, markers, empty rows and an empty column.
    """
    key = F.col("o_orderkey")
    o = table(spark, folder, "orders")
    blank = key % 40 == 7
    rows = o.select(*[
        F.when(blank, "").otherwise(c).alias(n) for n, c in {
            "order id": key.cast("string"),
            "price": F.when(key % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")),
            "day": F.date_format("o_orderdate", "yyyy-MM-dd"),
            "priority": F.when(key % 6 == 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))).otherwise(F.col("o_orderpriority")),
            "status": F.when(key % 8 == 0, "?").otherwise(F.col("o_orderstatus")),
            "nothing": F.lit("--"),
        }.items()])
    path = staging_path(spark, "orders-text")
    rows.write.option("header", True).option("sep", ";").option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
