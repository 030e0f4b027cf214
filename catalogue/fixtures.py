"""Deterministic inputs derived from whole supplied tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import table
from tabulift.plans.scratch import spread

# The supplied tables hold no missing values, so these rules put some in and repeat some rows. No row is left out.
MESSY_CUSTOMER = """messy AS (
  WITH holes AS (
    SELECT c_custkey,
           CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
           CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment
    FROM customer)
  SELECT * FROM holes UNION ALL SELECT * FROM holes WHERE c_custkey % 10 = 0)"""


def messy_customer(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    holes = table(spark, folder, "customer").select(
        k,
        F.when(k % 7 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 13 == 0, None).when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return holes.unionAll(holes.filter(k % 10 == 0))


MESSY_LINEITEM = """messy AS (
  WITH holes AS (
    SELECT l_orderkey, l_partkey, l_linenumber,
           CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
           CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
           CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN '' ELSE l_returnflag END AS l_returnflag
    FROM lineitem)
  SELECT * FROM holes UNION ALL SELECT * FROM holes WHERE l_orderkey % 10 = 0)"""


def messy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    holes = table(spark, folder, "lineitem").select(
        o,
        p,
        "l_linenumber",
        F.when(o % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(p % 11 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(o % 13 == 0, None).when(p % 17 == 0, "").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
    )
    return holes.unionAll(holes.filter(o % 10 == 0))


# Columns of every scaling kind: narrow, wide, constant, 0/1, and one with far values.
SCALING = """scaling AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CAST(1.0 AS DOUBLE) AS always_one,
         CAST(l_linenumber % 2 AS INTEGER) AS odd_line,
         CASE WHEN l_orderkey % 997 = 0 THEN l_quantity * 100 ELSE l_quantity END AS spiked
  FROM lineitem)"""


def scaling(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.lit(1.0).alias("always_one"),
        (F.col("l_linenumber") % 2).cast("int").alias("odd_line"),
        F.when(F.col("l_orderkey") % 997 == 0, F.col("l_quantity") * 100).otherwise(F.col("l_quantity")).alias("spiked"),
    )


# Targets of every kind the problem-type rules tell apart.
TYPING = """typing AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS two_texts,
         o_orderpriority AS five_texts,
         o_orderstatus = 'F' AS truth,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS two_integers,
         CAST(o_custkey % 12 AS INTEGER) AS twelve_integers,
         o_orderkey AS many_integers,
         o_totalprice AS many_floats,
         CAST(o_custkey % 4 AS DOUBLE) AS four_whole_floats,
         CAST(o_custkey % 4 AS DOUBLE) / 8 AS four_fractions,
         CAST(7 AS INTEGER) AS constant,
         CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS holes,
         o_orderdate AS moment
  FROM orders)"""


def typing(spark: SparkSession, folder: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    key = F.col("o_custkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(done, "done").otherwise("open").alias("two_texts"),
        F.col("o_orderpriority").alias("five_texts"),
        done.alias("truth"),
        done.cast("int").alias("two_integers"),
        (key % 12).cast("int").alias("twelve_integers"),
        F.col("o_orderkey").alias("many_integers"),
        F.col("o_totalprice").alias("many_floats"),
        (key % 4).cast("double").alias("four_whole_floats"),
        ((key % 4).cast("double") / 8).alias("four_fractions"),
        F.lit(7).alias("constant"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("holes"),
        F.col("o_orderdate").alias("moment"),
    )


# One row per line item with numbers of its order and customer: the table to be modelled.
MODEL_TABLE = """model_table AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, o_totalprice,
         c_acctbal, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
MODEL_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal")


def model_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = spread(table(spark, folder, "lineitem").drop("l_shipdate"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    joined = joined.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.select(*LINE_KEY, *MODEL_NUMBERS, "l_returnflag", "l_linestatus")


# Real binary labels of documents.
REAL_LABELS = """real_labels AS (
  SELECT documents.doc_id, n_chars, lang, source, quality, toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"""


def real_labels(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return documents.join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "n_chars", "lang", "source", "quality", "toxic"
    )


# Predictions by arithmetic on whole tables, so that metrics can be checked without training.
PREDICTIONS = """predictions AS (
  SELECT o_orderkey,
         CAST(o_orderkey % 3 AS INTEGER) AS label,
         CAST(CASE WHEN o_custkey % 10 < 6 THEN o_orderkey % 3 ELSE o_custkey % 4 END AS INTEGER) AS prediction,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS hit,
         CAST(floor(o_totalprice / 1000) AS DOUBLE) AS score,
         CAST((o_custkey % 50) + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END AS DOUBLE) AS score0,
         CAST((o_custkey % 40) + CASE WHEN o_orderkey % 3 = 1 THEN 10 ELSE 0 END AS DOUBLE) AS score1,
         CAST((o_custkey % 30) + CASE WHEN o_orderkey % 3 = 2 THEN 10 ELSE 0 END AS DOUBLE) AS score2,
         o_totalprice AS amount,
         o_totalprice * 0.9 + (o_custkey % 100) * 10 AS estimate
  FROM orders)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    o, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")

    def score(modulus, cls):
        return ((c % modulus) + F.when(o % 3 == cls, 10).otherwise(0)).cast("double")

    return table(spark, folder, "orders").select(
        o,
        (o % 3).cast("int").alias("label"),
        F.when(c % 10 < 6, o % 3).otherwise(c % 4).cast("int").alias("prediction"),
        (F.col("o_orderstatus") == "F").cast("int").alias("hit"),
        F.floor(price / 1000).cast("double").alias("score"),
        score(50, 0).alias("score0"),
        score(40, 1).alias("score1"),
        score(30, 2).alias("score2"),
        price.alias("amount"),
        (price * 0.9 + (c % 100) * 10).alias("estimate"),
    )
