"""Encoding and scaling."""

from pyspark.sql import functions as F

from catalogue.fixtures import MESSY_CUSTOMER, SCALING, messy_customer, scaling
from catalogue.profiling import SCALING_COLUMNS, outliers_sql
from catalogue.registry import query, rounded, table
from tabulift.operators import encode, scale
from tabulift.plans.scratch import held, spread

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _hot(column, values):
    return ", ".join(f"""CAST(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS "{column}_{v}\"""" for v in values)


@query(
    "encode_one_hot",
    f"SELECT o_orderkey, {_hot('o_orderstatus', 'FOP')}, {_hot('o_orderpriority', PRIORITIES)} FROM orders",
)
def one_hot(spark, folder):
    return encode.encode(_orders(spark, folder), "one-hot", order_by="o_orderkey")


@query(
    "encode_one_hot_missing",
    f"""WITH {MESSY_CUSTOMER} SELECT c_custkey, {_hot('c_mktsegment', ['', *SEGMENTS])},
        CAST(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END AS INTEGER) AS c_mktsegment_nan FROM messy""",
)
def one_hot_missing(spark, folder):
    df = messy_customer(spark, folder).select("c_custkey", "c_mktsegment")
    return encode.OneHotEncoder.fit(df).transform(df)


def _appearance(source, column, key):
    return f"""(SELECT {column} AS v, row_number() OVER (ORDER BY min({key}), {column}) AS code FROM {source} GROUP BY {column})"""


@query(
    "encode_ordinal",
    f"""SELECT o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority FROM orders
        JOIN {_appearance('orders', 'o_orderstatus', 'o_orderkey')} s ON o_orderstatus = s.v
        JOIN {_appearance('orders', 'o_orderpriority', 'o_orderkey')} p ON o_orderpriority = p.v""",
)
def ordinal(spark, folder):
    return encode.encode(_orders(spark, folder), "ordinal", order_by="o_orderkey")


@query(
    "encode_ordinal_missing",
    f"""WITH {MESSY_CUSTOMER} SELECT c_custkey, code AS c_mktsegment FROM messy
        JOIN {_appearance('messy', 'c_mktsegment', 'c_custkey')} d ON c_mktsegment IS NOT DISTINCT FROM d.v""",
)
def ordinal_missing(spark, folder):
    df = messy_customer(spark, folder).select("c_custkey", "c_mktsegment")
    return encode.OrdinalEncoder.fit(df, "c_custkey").transform(df)


@query(
    "encode_ordinal_names",
    f"""SELECT c_custkey, d.code AS c_name FROM customer JOIN {_appearance('customer', 'c_name', 'c_custkey')} d ON c_name = d.v""",
)
def ordinal_names(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name")
    return encode.encode(df, "ordinal", order_by="c_custkey")


@query(
    "encode_binary",
    f"""SELECT o_orderkey, CAST((s.code >> 1) & 1 AS INTEGER) AS o_orderstatus_0, CAST(s.code & 1 AS INTEGER) AS o_orderstatus_1,
        CAST((p.code >> 2) & 1 AS INTEGER) AS o_orderpriority_0, CAST((p.code >> 1) & 1 AS INTEGER) AS o_orderpriority_1,
        CAST(p.code & 1 AS INTEGER) AS o_orderpriority_2 FROM orders
        JOIN {_appearance('orders', 'o_orderstatus', 'o_orderkey')} s ON o_orderstatus = s.v
        JOIN {_appearance('orders', 'o_orderpriority', 'o_orderkey')} p ON o_orderpriority = p.v""",
)
def binary(spark, folder):
    return encode.encode(_orders(spark, folder), "binary", order_by="o_orderkey")


@query(
    "encode_frequency",
    """SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderstatus) / count(*) OVER (), 8) AS o_orderstatus,
       round(count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER (), 8) AS o_orderpriority FROM orders""",
)
def frequency(spark, folder):
    return rounded(encode.encode(_orders(spark, folder), "frequency"), 8)


@query(
    "label_encode",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code
       FROM lineitem""",
)
def label(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return encode.label_encode(df, "l_returnflag", "code")


# --- scaling ---------------------------------------------------------------------------------------------------------


def _stats(source, c):
    return f"""(SELECT min({c}) AS lo, max({c}) AS hi, avg({c}) AS mean, stddev_pop({c}) AS sp, stddev_samp({c}) AS sd,
        var_samp({c}) AS vs, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr,
        {outliers_sql(source, c)} AS outliers FROM {source})"""


_PLAN = "CASE WHEN hi = lo OR vs < 1e-9 THEN 'skip' WHEN outliers > 0 THEN 'robust' WHEN hi - lo > 1000 OR sd > 100 THEN 'standard' ELSE 'minmax' END"


@query(
    "scale_plan",
    f"WITH {SCALING} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {_PLAN} AS scaler, CASE WHEN hi = lo THEN 'constant' WHEN vs < 1e-9 THEN 'near-zero variance'
            WHEN outliers > 0 THEN 'outliers' WHEN hi - lo > 1000 OR sd > 100 THEN 'wide' ELSE 'default' END AS reason, outliers
            FROM {_stats('scaling', c)}"""
        for c in SCALING_COLUMNS
    ),
)
def scale_plan(spark, folder):
    with held(spread(scaling(spark, folder))) as kept:
        return scale.scale(kept, "auto")[1]


def _auto(c, s):
    return f"""round(CASE WHEN {s}.plan = 'skip' THEN {c} WHEN {s}.plan = 'robust' THEN ({c} - {s}.med) / {s}.iqr
        WHEN {s}.plan = 'standard' THEN ({c} - {s}.mean) / {s}.sp ELSE ({c} - {s}.lo) / ({s}.hi - {s}.lo) END, 6) AS {c}"""


@query(
    "scale_auto",
    f"WITH {SCALING}, "
    + ", ".join(f"s{i} AS (SELECT *, {_PLAN} AS plan FROM {_stats('scaling', c)})" for i, c in enumerate(SCALING_COLUMNS))
    + " SELECT "
    + ", ".join(_auto(c, f"s{i}") for i, c in enumerate(SCALING_COLUMNS))
    + " FROM scaling, "
    + ", ".join(f"s{i}" for i in range(len(SCALING_COLUMNS))),
)
def scale_auto(spark, folder):
    df = scaling(spark, folder)
    with held(spread(df)) as kept:
        fitted = scale.fit_auto(kept)
    return rounded(fitted.transform(df))


_MANUAL = {
    "minmax": "({c} - s.lo_{c}) / (s.hi_{c} - s.lo_{c})",
    "standard": "({c} - s.mean_{c}) / s.sp_{c}",
    "robust": "({c} - s.med_{c}) / s.iqr_{c}",
}
_TWO = ("l_quantity", "l_extendedprice")


def _manual_sql(kind):
    stats = ", ".join(
        f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, avg({c}) AS mean_{c}, stddev_pop({c}) AS sp_{c}, "
        f"quantile_cont({c}, 0.5) AS med_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}"
        for c in _TWO
    )
    values = ", ".join(f"round({_MANUAL[kind].format(c=c)}, 6) AS {c}" for c in _TWO)
    return f"SELECT {values}, l_returnflag FROM lineitem, (SELECT {stats} FROM lineitem) s"


def _manual(kind):
    def run(spark, folder):
        df = table(spark, folder, "lineitem").select(*_TWO, "l_returnflag")
        return rounded(scale.scale(df, "manual", kind)[0])

    return run


for _kind in _MANUAL:
    query(f"scale_{_kind}", _manual_sql(_kind))(_manual(_kind))


@query(
    "scale_manual",
    f"""WITH {SCALING}, s AS (SELECT """
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in SCALING_COLUMNS)
    + " FROM scaling) SELECT "
    + ", ".join(
        c if c in ("always_one", "odd_line") else f"round(({c} - m_{c}) / d_{c}, 6) AS {c}" for c in SCALING_COLUMNS
    )
    + " FROM scaling, s",
)
def scale_manual(spark, folder):
    return rounded(scale.scale(scaling(spark, folder), "manual", scale.STANDARD)[0])


@query("feature_target_split", "SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY l_returnflag")
def feature_target_split(spark, folder):
    from tabulift.functions.schema import feature_target_split as cut

    features, target = cut(table(spark, folder, "lineitem"), "l_returnflag")
    assert "l_returnflag" not in features.columns
    return target.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))


@query("select_features", "SELECT l_quantity, l_tax, l_returnflag FROM lineitem")
def select_features(spark, folder):
    from tabulift.functions.schema import select_features as choose

    return choose(table(spark, folder, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])


@query("encode_one_hot_long", "SELECT c_custkey, 'c_name' AS \"column\", c_name AS category FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer")
def encode_one_hot_long(spark, folder):
    return encode.one_hot_long(table(spark, folder, "customer"), "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "encode_one_hot_nan",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS v_nan, CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END AS v_nan_2,
         CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS v_x FROM customer""",
)
def encode_one_hot_nan(spark, folder):
    """A category 'nan' beside missing values."""
    value = F.when(F.col("c_custkey") % 3 == 1, "nan").when(F.col("c_custkey") % 3 == 2, "x")
    df = table(spark, folder, "customer").select("c_custkey", value.alias("v"))
    made = encode.OneHotEncoder.fit(df.withColumn("at", F.col("c_custkey") % 3), ["v"], order_by="at").transform(df)
    return made.select("c_custkey", "v_nan", "v_nan_2", "v_x")
