"""Projections by type family and data-quality reports."""

from catalogue.fixtures import MESSY_CUSTOMER, MESSY_LINEITEM, SCALING, messy_customer, messy_lineitem, scaling
from catalogue.registry import query, rounded, table
from tabulift.functions import schema
from tabulift.operators import profile
from tabulift.plans.scratch import held, spread


@query("select_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_numeric(spark, folder):
    return schema.select_numeric(table(spark, folder, "orders"))


@query("select_categorical", "SELECT o_orderstatus, o_orderpriority FROM orders")
def select_categorical(spark, folder):
    return schema.select_categorical(table(spark, folder, "orders"))


@query("shape", f"WITH {MESSY_LINEITEM} SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns FROM messy")
def shape(spark, folder):
    return profile.shape(messy_lineitem(spark, folder))


@query(
    "column_types",
    """SELECT column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
         WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type
       FROM information_schema.columns WHERE table_name = 'lineitem'""",
)
def column_types(spark, folder):
    return profile.column_types(table(spark, folder, "lineitem"))


_MISSING = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 2) AS percentage FROM messy"""
    for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
)


@query(
    "missing_profile",
    f"""WITH {MESSY_LINEITEM}, p AS ({_MISSING}) SELECT "column", missing, CAST(percentage AS DOUBLE) AS percentage FROM p""",
)
def missing_profile(spark, folder):
    return profile.missing_profile(messy_lineitem(spark, folder))


@query(
    "missing_only",
    f"""WITH {MESSY_LINEITEM}, p AS ({_MISSING})
        SELECT "column", missing, CAST(percentage AS DOUBLE) AS percentage FROM p WHERE missing > 0""",
)
def missing_only(spark, folder):
    return profile.missing_profile(messy_lineitem(spark, folder), only_missing=True)


@query(
    "missing_total",
    f"""WITH {MESSY_LINEITEM} SELECT CAST(6 * count(*) - count(l_orderkey) - count(l_partkey) - count(l_linenumber)
        - count(l_quantity) - count(l_extendedprice) - count(l_returnflag) AS BIGINT) AS missing FROM messy""",
)
def missing_total(spark, folder):
    return profile.missing_total(messy_lineitem(spark, folder))


@query(
    "duplicate_count",
    f"""WITH {MESSY_LINEITEM}, g AS (
          SELECT count(*) AS n FROM messy
          GROUP BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag)
        SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g""",
)
def duplicate_count(spark, folder):
    return profile.duplicate_count(messy_lineitem(spark, folder))


LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()
LINEITEM_NUMBERS = LINEITEM[:8]


@query(
    "unique_counts",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM lineitem""" for c in LINEITEM),
)
def unique_counts(spark, folder):
    return profile.unique_counts(table(spark, folder, "lineitem"))


@query(
    "describe_numeric",
    f"WITH {MESSY_CUSTOMER} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
            CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
            round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM messy"""
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    ),
)
def describe_numeric(spark, folder):
    return rounded(profile.describe_numeric(messy_customer(spark, folder)))


@query(
    "describe_numeric_lineitem",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
            round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in LINEITEM_NUMBERS
    ),
)
def describe_numeric_lineitem(spark, folder):
    with held(spread(schema.select_numeric(table(spark, folder, "lineitem")))) as numbers:
        return rounded(profile.describe_numeric(numbers), 4)


def _describe_text(source, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM {source}) AS count,
            (SELECT count(DISTINCT {c}) FROM {source}) AS "unique", v AS top, n AS freq
            FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1)"""
        for c in columns
    )


@query("describe_categorical", f"WITH {MESSY_LINEITEM} {_describe_text('messy', ['l_returnflag'])}")
def describe_categorical(spark, folder):
    return profile.describe_categorical(messy_lineitem(spark, folder))


@query("describe_categorical_documents", _describe_text("documents", ["text", "lang", "source"]))
def describe_categorical_documents(spark, folder):
    return profile.describe_categorical(table(spark, folder, "documents"))


def outliers_sql(source, c):
    return f"""(SELECT CAST(coalesce(sum(CASE WHEN q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))
        THEN 1 ELSE 0 END), 0) AS BIGINT) FROM {source},
        (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))"""


SCALING_COLUMNS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "always_one", "odd_line", "spiked")


@query(
    "outlier_count_iqr",
    f"WITH {SCALING} "
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {outliers_sql('scaling', c)} AS outliers""" for c in SCALING_COLUMNS),
)
def outlier_count_iqr(spark, folder):
    return profile.outlier_count_iqr(scaling(spark, folder))


@query(
    "column_spread",
    f"WITH {SCALING} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct", round(var_samp({c}), 2) AS variance,
            round(CAST(max({c}) - min({c}) AS DOUBLE), 4) AS range, round(stddev_samp({c}), 4) AS std FROM scaling"""
        for c in SCALING_COLUMNS
    ),
)
def column_spread(spark, folder):
    return rounded(rounded(profile.column_spread(scaling(spark, folder)), 4, "range", "std"), 2, "variance")


@query("class_counts", "SELECT l_returnflag AS class, count(*) AS count FROM lineitem GROUP BY l_returnflag")
def class_counts(spark, folder):
    return profile.class_counts(table(spark, folder, "lineitem"), "l_returnflag")


@query(
    "min_class_count",
    "SELECT min(n) AS min_class_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)",
)
def min_class_count(spark, folder):
    return profile.min_class_count(table(spark, folder, "lineitem"), "l_returnflag")


@query("value_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type")
def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "events"), "event_type").orderBy("count", ascending=False)


@query(
    "non_binary_numeric",
    f"WITH {SCALING} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, spiked FROM scaling",
)
def non_binary_numeric(spark, folder):
    df = scaling(spark, folder)
    return df.select(*profile.non_binary_numeric(df))


@query(
    "scalable_columns",
    f"WITH {SCALING} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, odd_line, spiked FROM scaling",
)
def scalable_columns(spark, folder):
    df = scaling(spark, folder)
    return df.select(*profile.scalable_columns(df))
