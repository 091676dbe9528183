"""The engine's relations, derived by Spark from the driver tables (whole tables throughout)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmesh.operators import retrieval as R

TODAY = "1998-01-01"  # "today" is always a parameter, so that results do not depend on the clock
SPLIT_DAY = "1998-07-01"  # the old and the new snapshot are the orders before and from this day


TEXT_TABLES = {"documents", "pages"}  # heavy work per row


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files give fewer input splits than that; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def today() -> Column:
    return F.lit(TODAY).cast("date")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks; the person is the document's source, the section its language."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("person_id"), F.col("lang").alias("section"),
        F.col("doc_id").alias("seq"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One mean vector per person that has vectors."""
    owners = chunks(spark, sf).select("chunk_id", "person_id")
    return R.profile_vectors(vectors(spark, sf).join(owners, "chunk_id"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per benchmark item: its text as keywords, the vector with its number."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("keywords"))
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vecs, "query_id")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Expected persons per query: the owners of documents that hold the query's whole passage, word by word.

    Documents and passages first meet in an equi-join on six words in a row (passages of fewer words: on their first
    word); what meets is compared as a whole.
    """
    words = F.split(F.trim(F.lower(F.col("text"))), r"\s+")
    flat = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))

    def keys(step: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - step + 1, F.lit(1))),
                           lambda i: F.xxhash64(F.lit(step), F.array_join(F.slice("w", i, F.lit(step)), " ")))

    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).select(
        "query_id", flat.alias("passage"), F.get(F.when(F.size("w") >= 6, keys(6)).otherwise(keys(1)), F.lit(0)).alias("g"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("person_id"), words.alias("w"))
    found = R.bounded_join(docs.select("doc_id", F.explode(F.array_distinct(F.concat(keys(6), keys(1)))).alias("g")),
                           items.select("query_id", "g"), ["g"], ["doc_id"]).select("query_id", "doc_id").distinct()
    return found.join(docs.select("doc_id", "person_id", flat.alias("held")), "doc_id").join(
        items.drop("g"), "query_id").where(F.contains(F.col("held"), F.col("passage"))).select("query_id", "person_id").distinct()


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as calls; the title is the part with the customer's number and the priority."""
    orders = table(spark, sf, "orders")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("o_custkey"), "p_name", "p_type", "p_brand")
    published = F.col("o_orderdate").cast("date")

    def date(label: str, shift: Column, applies: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.date_add(published, shift.cast("int")).alias("date"),
                        applies.alias("is_application"))

    dates = F.when(F.col("o_orderstatus") == "P", F.array().cast(
        "array<struct<label:string,date:date,is_application:boolean>>")).otherwise(F.array(
            date("Yayın tarihi", F.lit(0), F.lit(False)),
            date("Son başvuru", 30 + F.col("o_custkey") % 120, F.lit(True)),
            date("E-imza", 60 + F.col("o_orderkey") % 90, F.col("o_orderstatus") == "O")))
    return orders.join(parts, "o_custkey", "left").select(
        F.col("o_orderkey").alias("call_id"),
        F.concat(F.lit("https://calls.example/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat_ws(" ", "p_name", "o_orderpriority").alias("title"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("program_code"),
        F.col("p_type").alias("program_name"),
        F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("academic")).otherwise(F.lit("industry")).alias("audience"),
        F.concat_ws(" ", "p_type", "p_name").alias("summary"),
        F.array(F.col("p_brand"), F.col("p_type")).alias("conditions"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type", "o_orderstatus").alias("text"),
        published.alias("publish_date"), published.alias("first_seen"), dates.alias("dates"))


def call_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the calls whose number has an embedding."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("call_id"), "embedding")


def news_url() -> Column:
    """Address of an order line; the line number alone does not tell lines of an order apart."""
    return F.concat_ws("-", F.lit("https://news.example/"), *[
        F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def announcements(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as listed announcements of the order's call family: same part name and priority."""
    lines = table(spark, sf, "lineitem")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority",
                                               "o_orderstatus")
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select(
        news_url().alias("url"),
        F.concat_ws(" ", "p_name", "o_orderpriority").alias("title"),
        F.col("o_orderpriority").alias("source"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("program_code"),
        F.col("l_shipdate").cast("date").alias("publish_date"))
