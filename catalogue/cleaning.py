"""Missing values and duplicates."""

from pyspark.sql import functions as F

from catalogue.fixtures import MESSY_CUSTOMER, MESSY_LINEITEM, messy_customer, messy_lineitem
from catalogue.registry import query, rounded
from tabulift.operators import clean, profile

EMPTY = """emptied AS (SELECT c_custkey, c_nationkey, c_acctbal, nullif(c_mktsegment, '') AS c_mktsegment FROM messy)"""


@query("replace_empty", f"WITH {MESSY_CUSTOMER}, {EMPTY} SELECT * FROM emptied")
def replace_empty(spark, folder):
    return clean.replace_empty(messy_customer(spark, folder))


@query(
    "replace_empty_counts",
    f"""WITH {MESSY_CUSTOMER}, {EMPTY}
        SELECT 'before' AS step, CAST(sum(CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END + CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END
          + CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM messy
        UNION ALL
        SELECT 'after', CAST(sum(CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END + CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END
          + CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM emptied""",
)
def replace_empty_counts(spark, folder):
    df = messy_customer(spark, folder)
    before = profile.missing_total(df).select(F.lit("before").alias("step"), "missing")
    after = profile.missing_total(clean.replace_empty(df)).select(F.lit("after").alias("step"), "missing")
    return before.unionAll(after)


@query("drop_na_rows", f"WITH {MESSY_LINEITEM} SELECT * FROM messy WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL")
def drop_na_rows(spark, folder):
    return clean.drop_na_rows(messy_lineitem(spark, folder))


@query(
    "impute_median",
    f"""WITH {MESSY_LINEITEM}, m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS p FROM messy)
        SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_partkey AS DOUBLE) AS l_partkey,
               CAST(l_linenumber AS DOUBLE) AS l_linenumber, round(coalesce(l_quantity, q), 6) AS l_quantity,
               round(coalesce(l_extendedprice, p), 6) AS l_extendedprice, l_returnflag FROM messy, m""",
)
def impute_median(spark, folder):
    return rounded(clean.impute_median(messy_lineitem(spark, folder)), 6, "l_quantity", "l_extendedprice")


MODE = """mode_of AS (SELECT c_mktsegment AS top FROM {source} WHERE c_mktsegment IS NOT NULL
  GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)"""


@query(
    "impute_mode",
    f"""WITH {MESSY_CUSTOMER}, {EMPTY}, {MODE.format(source='emptied')}
        SELECT c_custkey, c_nationkey, c_acctbal, coalesce(c_mktsegment, top) AS c_mktsegment FROM emptied, mode_of""",
)
def impute_mode(spark, folder):
    return clean.impute_mode(clean.replace_empty(messy_customer(spark, folder)))


@query("drop_duplicates", f"WITH {MESSY_LINEITEM} SELECT DISTINCT * FROM messy")
def drop_duplicates(spark, folder):
    return clean.drop_duplicates(messy_lineitem(spark, folder))


IMPUTED = f"""{MESSY_CUSTOMER}, {EMPTY}, {MODE.format(source='emptied')}, filled AS (
  SELECT CAST(c_custkey AS DOUBLE) AS c_custkey,
         coalesce(CAST(c_nationkey AS DOUBLE), (SELECT quantile_cont(c_nationkey, 0.5) FROM emptied)) AS c_nationkey,
         coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM emptied)) AS c_acctbal,
         coalesce(c_mktsegment, top) AS c_mktsegment FROM emptied, mode_of)"""


def cleaned(spark, folder):
    return clean.clean(messy_customer(spark, folder), treat_empty=True, missing=clean.IMPUTE, duplicates=clean.DEDUPE)


@query("clean", f"WITH {IMPUTED} SELECT DISTINCT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM filled")
def clean_table(spark, folder):
    return rounded(cleaned(spark, folder).table, 6, "c_acctbal")


_CELLS = "CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END + CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END + CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END"


@query(
    "cleaning_report",
    f"""WITH {IMPUTED}, b AS (SELECT count(*) AS n, CAST(sum({_CELLS}) AS BIGINT) AS m FROM messy),
        e AS (SELECT CAST(sum({_CELLS}) AS BIGINT) AS m FROM emptied),
        d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM messy)),
        f AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM filled))
        SELECT 'empty strings' AS subject, 'replaced by missing' AS action, e.m - b.m AS amount FROM b, e
        UNION ALL SELECT 'missing numbers', 'median', 2
        UNION ALL SELECT 'missing categories', 'mode', 1
        UNION ALL SELECT 'duplicate rows', 'removed', b.n - f.n FROM b, f
        UNION ALL SELECT 'rows', 'before', n FROM b
        UNION ALL SELECT 'rows', 'after', n FROM f
        UNION ALL SELECT 'missing cells', 'before', m FROM b
        UNION ALL SELECT 'missing cells', 'after', 0
        UNION ALL SELECT 'duplicates', 'before', b.n - d.n FROM b, d
        UNION ALL SELECT 'duplicates', 'after', 0""",
)
def cleaning_report(spark, folder):
    return cleaned(spark, folder).report


@query(
    "clean_drop",
    f"""WITH {MESSY_LINEITEM} SELECT DISTINCT * FROM messy
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND nullif(l_returnflag, '') IS NOT NULL""",
)
def clean_drop(spark, folder):
    return clean.clean(messy_lineitem(spark, folder), treat_empty=True, missing=clean.DROP, duplicates=clean.DEDUPE).table


@query("clean_table", f"WITH {IMPUTED} SELECT DISTINCT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM filled")
def clean_without_report(spark, folder):
    made = clean.clean_table(messy_customer(spark, folder), treat_empty=True, missing=clean.IMPUTE, duplicates=clean.DEDUPE)
    return rounded(made, 6, "c_acctbal")
