"""Train/test splits and folds."""

from catalogue.charts import HASH, LINE_ORDER
from catalogue.fixtures import LINE_KEY
from catalogue.registry import query, table
from tabulift.operators import split

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
NUMBER = f"CAST('0x' || substr({HASH}, 1, 8) AS BIGINT)"


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(*LINE_KEY, "l_returnflag")


@query(
    "train_test_split",
    f"SELECT {KEYS}, l_returnflag, CASE WHEN {NUMBER} < floor(0.2 * 4294967296) THEN 'test' ELSE 'train' END AS part FROM lineitem",
)
def train_test_split(spark, folder):
    return split.train_test_split(_lines(spark, folder), "l_returnflag", LINE_KEY).table


@query(
    "stratified_split",
    f"""SELECT {KEYS}, l_returnflag, CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINE_ORDER})
          <= floor(count(*) OVER (PARTITION BY l_returnflag) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM lineitem""",
)
def stratified_split(spark, folder):
    made = split.train_test_split(
        _lines(spark, folder), "l_returnflag", LINE_KEY, stratify=True, problem_type="Multiclass Classification"
    )
    return made.table


@query("kfold", f"SELECT {KEYS}, l_returnflag, CAST({NUMBER} % 5 AS INTEGER) AS fold FROM lineitem")
def kfold(spark, folder):
    return split.kfold(_lines(spark, folder), LINE_KEY)


@query(
    "stratified_kfold",
    f"""SELECT {KEYS}, l_returnflag,
        CAST(((row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINE_ORDER}) - 1) * 5)
          // count(*) OVER (PARTITION BY l_returnflag) AS INTEGER) AS fold FROM lineitem""",
)
def stratified_kfold(spark, folder):
    return split.stratified_kfold(_lines(spark, folder), "l_returnflag", LINE_KEY)
