"""Loading, guards, names, narrowing, previews."""

from pyspark.sql import functions as F

from catalogue.registry import query, table
from tabulift.functions.schema import normalize_names
from tabulift.plans.scratch import scratch_path
from tabulift.sources.tables import load_csv, load_status, load_table, narrow_types, preview

#: Splits of a table that make one file: its text, larger than the splits, is cut into several ranges.
SPLITS_A_FILE = 2


@query("load_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def load_customer(spark, folder):
    path = scratch_path(spark, "customer") + ".CSV"
    table(spark, folder, "customer").write.csv(path, header=True)
    return load_table(spark, path).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("load_csv_text", "SELECT doc_id, text, lang FROM documents")
def load_csv_text(spark, folder):
    """Texts with line breaks, quotes and commas, written and read back."""
    path = scratch_path(spark, "documents") + ".csv"
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return load_table(spark, path)


@query("load_csv_split", "SELECT doc_id, text, lang, n_chars FROM documents")
def load_csv_split(spark, folder):
    """Texts with line breaks in files of several ranges each, read by ranges and cut at record ends."""
    path = scratch_path(spark, "documents") + ".csv"
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    docs = docs.coalesce(max(1, docs.rdd.getNumPartitions() // SPLITS_A_FILE))  # one task writes a file, so files do not grow with the table
    docs.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return load_csv(spark, path, split=True)


@query(
    "load_guard",
    """SELECT 'customer' AS name, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'loaded' END AS status FROM customer
       UNION ALL SELECT 'nobody', CASE WHEN count(*) = 0 THEN 'empty' ELSE 'loaded' END FROM customer WHERE c_custkey < -1""",
)
def load_guard(spark, folder):
    customer = table(spark, folder, "customer")
    cases = {"customer": customer, "nobody": customer.filter("c_custkey < -1")}
    return spark.createDataFrame([(n, load_status(df)[0]) for n, df in cases.items()], "name string, status string")


@query(
    "normalize_names",
    """SELECT c_custkey AS c_custkey, c_name AS c_name, c_acctbal AS ab, c_nationkey AS ab_2, c_mktsegment AS market_segment
       FROM customer""",
)
def names(spark, folder):
    odd = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("C CustKey"),
        F.col("c_name").alias(" C Name "),
        F.col("c_acctbal").alias("a-b"),
        F.col("c_nationkey").alias("ab"),
        F.col("c_mktsegment").alias("Market Segment!?"),
    )
    return normalize_names(odd)


NARROWING = """narrowing AS (
  SELECT CAST(o_orderkey % 100 AS BIGINT) AS tiny, o_orderkey % 30000 AS small, o_custkey * 40 AS plain,
         o_orderkey * 3000000000 AS wide, o_orderkey % 128 AS edge_high, -(o_orderkey % 129) AS edge_low, o_totalprice
  FROM orders)"""
_NARROW = """CASE WHEN lo IS NULL THEN was WHEN lo > -128 AND hi < 127 THEN 'tinyint' WHEN lo > -32768 AND hi < 32767 THEN 'smallint'
  WHEN lo > -2147483648 AND hi < 2147483647 THEN 'int' ELSE 'bigint' END"""


def narrowing(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        (k % 100).alias("tiny"),
        (k % 30000).alias("small"),
        (F.col("o_custkey") * 40).alias("plain"),
        (k * 3000000000).alias("wide"),
        (k % 128).alias("edge_high"),
        (-(k % 129)).alias("edge_low"),
        "o_totalprice",
    )


@query(
    "narrow_types",
    f"""WITH {NARROWING}, bounds AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'bigint' AS was, min({c}) AS lo, max({c}) AS hi FROM narrowing"
        for c in ("tiny", "small", "plain", "wide", "edge_high", "edge_low")
    )
    + f""") SELECT "column", was AS "from", {_NARROW} AS "to" FROM bounds""",
)
def narrow_report(spark, folder):
    return narrow_types(narrowing(spark, folder))[1]


@query(
    "narrow_types_table",
    f"WITH {NARROWING} SELECT tiny, small, plain, wide, edge_high, edge_low, o_totalprice FROM narrowing",
)
def narrow_table(spark, folder):
    """The narrowed values, widened again for the comparison because their types depend on the data."""
    narrow = narrow_types(narrowing(spark, folder))[0]
    return narrow.select(*[F.col(c).cast("bigint") for c in narrow.columns if c != "o_totalprice"], "o_totalprice")


@query("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 15")
def first_rows(spark, folder):
    return preview(table(spark, folder, "customer"), "c_custkey")
