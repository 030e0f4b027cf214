"""Chart data: top lists, samples, histograms, densities, boxes, crosstabs, correlations."""

from pyspark.sql import functions as F

from catalogue.fixtures import LINE_KEY, MESSY_LINEITEM, messy_lineitem
from catalogue.registry import query, rounded, table
from tabulift.operators import chartdata
from tabulift.plans.scratch import held, spread

HASH = "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42'))"
LINE_ORDER = f"{HASH}, l_orderkey, l_linenumber, l_partkey, l_suppkey"
SAMPLED = f"sampled AS (SELECT * FROM lineitem ORDER BY {LINE_ORDER} LIMIT 50000)"


def _lines(spark, folder, *names):
    return table(spark, folder, "lineitem").select(*LINE_KEY, *names)


def _top(source, c, k):
    return f"(SELECT {c} AS value, count(*) AS count FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, value LIMIT {k})"


@query("top_k_values", f"SELECT * FROM {_top('lineitem', 'l_partkey', 20)}")
def top_k_values(spark, folder):
    return chartdata.top_k_values(table(spark, folder, "lineitem"), "l_partkey")


@query("count_bars", f"SELECT * FROM {_top('part', 'p_brand', 20)}")
def count_bars(spark, folder):
    return chartdata.count_bars(table(spark, folder, "part"), "p_brand")


_OTHER = f"""other AS (SELECT coalesce(t.value, 'Other') AS value, CAST(sum(c.n) AS BIGINT) AS count
  FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) c LEFT JOIN {_top('part', 'p_brand', 20)} t ON p_brand = t.value GROUP BY 1)"""


@query("top_k_other", f"WITH {_OTHER} SELECT * FROM other")
def top_k_other(spark, folder):
    return chartdata.top_k_other(table(spark, folder, "part"), "p_brand")


@query("pie_shares", f"WITH {_OTHER} SELECT value, count, round(count * 100.0 / sum(count) OVER (), 6) AS percentage FROM other")
def pie_shares(spark, folder):
    return rounded(chartdata.pie_shares(table(spark, folder, "part"), "p_brand"))


@query("sort_by_x", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice")
def sort_by_x(spark, folder):
    return chartdata.sort_by_x(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("sample_rows", f"WITH {SAMPLED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM sampled")
def sample_rows(spark, folder):
    return chartdata.sample_rows(_lines(spark, folder, "l_quantity"), LINE_KEY, chartdata.MAX_SAMPLE)


def histogram_sql(source, c, label=""):
    return f"""SELECT {label} CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 30), 6) AS "left", round(lo + (i + 1) * ((hi - lo) / 30), 6) AS "right",
        coalesce(n, 0) AS count FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {source}) s, range(30) t(i)
        LEFT JOIN (SELECT least(floor(({c} - lo) / (hi - lo) * 30), 29) AS b, count(*) AS n
          FROM {source}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {source}) GROUP BY 1) h ON h.b = i"""


@query("histogram", histogram_sql("lineitem", "l_extendedprice"))
def histogram(spark, folder):
    return rounded(chartdata.histogram(table(spark, folder, "lineitem"), "l_extendedprice"))


@query(
    "kde",
    """WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS bw FROM orders),
       grid AS (SELECT i AS point, lo - 3 * bw + i * ((hi - lo + 6 * bw) / 199) AS x, n, bw FROM s, range(200) t(i))
       SELECT CAST(point AS INTEGER) AS point, round(x, 4) AS x,
              round(sum(exp(-0.5 * ((x - o_totalprice) / bw) * ((x - o_totalprice) / bw))) / (n * bw * sqrt(2 * pi())), 12) AS density
       FROM grid, orders GROUP BY point, x, n, bw""",
)
def kde(spark, folder):
    return rounded(rounded(chartdata.kde(spread(table(spark, folder, "orders").select("o_totalprice")), "o_totalprice"), 4, "x"), 12, "density")


_BOX = """count(x) AS count, any_value(q1) AS q1, any_value(med) AS median, any_value(q3) AS q3,
  least(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END), any_value(q1)) AS whisker_low,
  greatest(max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END), any_value(q3)) AS whisker_high,
  CAST(sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers"""
_BOX_ROUNDED = "round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high"


@query(
    "box_stats",
    f"""WITH long AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
          UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
        q AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1),
        b AS (SELECT long."column", {_BOX} FROM long JOIN q ON long."column" = q."column" GROUP BY 1)
        SELECT "column", count, {_BOX_ROUNDED}, outliers FROM b""",
)
def box_stats(spark, folder):
    with held(spread(table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"))) as numbers:
        return rounded(chartdata.box_stats(numbers))


@query(
    "box_by_category",
    f"""WITH long AS (SELECT p_brand AS category, p_retailprice AS x FROM part WHERE p_brand IN (SELECT value FROM {_top('part', 'p_brand', 15)})),
        q AS (SELECT category, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1),
        b AS (SELECT long.category, {_BOX} FROM long JOIN q ON long.category = q.category GROUP BY 1)
        SELECT category, count, {_BOX_ROUNDED}, outliers FROM b""",
)
def box_by_category(spark, folder):
    return rounded(chartdata.box_by_category(table(spark, folder, "part"), "p_retailprice", "p_brand"))


@query(
    "violin_by_category",
    f"""WITH rows_of AS (SELECT p_brand AS category, p_retailprice AS v FROM part WHERE p_brand IN (SELECT value FROM {_top('part', 'p_brand', 15)})),
        s AS (SELECT category, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM rows_of GROUP BY 1),
        grid AS (SELECT category, i AS point, lo - 2 * bw + i * ((hi - lo + 4 * bw) / 99) AS x, n, bw FROM s, range(100) t(i))
        SELECT grid.category, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
               round(sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 9) AS density
        FROM grid JOIN rows_of ON grid.category = rows_of.category GROUP BY grid.category, point, x, n, bw""",
)
def violin_by_category(spark, folder):
    return rounded(rounded(chartdata.violin_by_category(table(spark, folder, "part"), "p_retailprice", "p_brand"), 6, "x"), 9, "density")


@query(
    "mean_by_category",
    f"""SELECT p_brand AS category, round(avg(p_retailprice), 6) AS mean FROM part
        WHERE p_brand IN (SELECT value FROM {_top('part', 'p_brand', 15)}) GROUP BY p_brand""",
)
def mean_by_category(spark, folder):
    return rounded(chartdata.mean_by_category(table(spark, folder, "part"), "p_retailprice", "p_brand"))


@query(
    "grouped_counts",
    f"""SELECT p_brand AS x, p_name AS hue, count(*) AS count FROM part WHERE p_brand IN (SELECT value FROM {_top('part', 'p_brand', 15)})
        AND p_name IN (SELECT value FROM {_top('part', 'p_name', 10)}) GROUP BY p_brand, p_name""",
)
def grouped_counts(spark, folder):
    return chartdata.grouped_counts(table(spark, folder, "part"), "p_brand", "p_name")


@query(
    "crosstab_proportions",
    f"""WITH totals AS (SELECT p_brand, count(*) AS t FROM part WHERE p_name IS NOT NULL GROUP BY p_brand),
        cells AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY p_brand, p_name)
        SELECT x.value AS x, h.value AS hue, round(coalesce(n, 0) / t, 8) AS share FROM {_top('part', 'p_brand', 15)} x
        JOIN {_top('part', 'p_name', 10)} h ON true JOIN totals ON totals.p_brand = x.value
        LEFT JOIN cells ON cells.p_brand = x.value AND cells.p_name = h.value""",
)
def crosstab_proportions(spark, folder):
    return rounded(chartdata.crosstab_proportions(table(spark, folder, "part"), "p_brand", "p_name"), 8)


@query("scatter_points", f"WITH {SAMPLED} SELECT l_quantity AS x, l_extendedprice AS y FROM sampled")
def scatter_points(spark, folder):
    return chartdata.scatter_points(_lines(spark, folder, "l_quantity", "l_extendedprice"), LINE_KEY, "l_quantity", "l_extendedprice")


@query("line_series", "SELECT l_quantity AS x, round(avg(l_extendedprice), 4) AS y FROM lineitem GROUP BY l_quantity")
def line_series(spark, folder):
    return rounded(chartdata.line_series(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), 4, "y")


@query(
    "joint_stats",
    f"""SELECT 'points' AS part, l_quantity AS a, l_extendedprice AS b FROM lineitem
        UNION ALL SELECT part, "left", CAST(count AS DOUBLE) FROM ({histogram_sql('lineitem', 'l_quantity', "'x' AS part, ")})
        UNION ALL SELECT part, "left", CAST(count AS DOUBLE) FROM ({histogram_sql('lineitem', 'l_extendedprice', "'y' AS part, ")})""",
)
def joint_stats(spark, folder):
    df = _lines(spark, folder, "l_quantity", "l_extendedprice")
    parts = chartdata.joint_stats(df, LINE_KEY, "l_quantity", "l_extendedprice")
    points = parts["points"].select(F.lit("points").alias("part"), F.col("x").alias("a"), F.col("y").alias("b"))
    margins = [
        rounded(parts[m]).select(F.lit(m).alias("part"), F.col("left").alias("a"), F.col("count").cast("double").alias("b")) for m in "xy"
    ]
    return points.unionByName(margins[0]).unionByName(margins[1])


_PAIR_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "pairplot_data",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x_name, '{b}' AS y_name, {a} AS x, {b} AS y, l_returnflag AS hue FROM lineitem"
        for i, b in enumerate(_PAIR_COLUMNS)
        for a in _PAIR_COLUMNS[:i]
    ),
)
def pairplot_pairs(spark, folder):
    return chartdata.pairplot_data(_lines(spark, folder, *_PAIR_COLUMNS, "l_returnflag"), LINE_KEY, _PAIR_COLUMNS, "l_returnflag")["pairs"]


@query(
    "pairplot_diagonal",
    "WITH long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS name, l_returnflag AS hue, {c} AS v FROM lineitem" for c in _PAIR_COLUMNS)
    + """), s AS (SELECT name, hue, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM long GROUP BY 1, 2),
        weights AS (SELECT name, hue, v, count(*) AS w FROM long GROUP BY 1, 2, 3),
        grid AS (SELECT name, hue, i AS point, lo - 3 * bw + i * ((hi - lo + 6 * bw) / 199) AS x, n, bw FROM s, range(200) t(i))
        SELECT grid.name, grid.hue, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
               round(sum(w * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 7) AS density
        FROM grid JOIN weights ON grid.name = weights.name AND grid.hue = weights.hue GROUP BY grid.name, grid.hue, point, x, n, bw""",
)
def pairplot_diagonal(spark, folder):
    df = _lines(spark, folder, *_PAIR_COLUMNS, "l_returnflag")
    diagonal = chartdata.pairplot_data(df, LINE_KEY, _PAIR_COLUMNS, "l_returnflag")["diagonal"]
    return rounded(rounded(diagonal, 6, "x"), 7, "density")


@query(
    "hue_rule",
    """SELECT 'l_returnflag' AS target, true AS used UNION ALL
       SELECT 'l_linenumber', count(DISTINCT l_linenumber) < 15 FROM lineitem UNION ALL
       SELECT 'l_quantity', count(DISTINCT l_quantity) < 15 FROM lineitem UNION ALL SELECT 'l_shipdate', false""",
)
def hue_rule(spark, folder):
    df = table(spark, folder, "lineitem")
    targets = ("l_returnflag", "l_linenumber", "l_quantity", "l_shipdate")
    return spark.createDataFrame([(t, chartdata.hue_column(df, t) is not None) for t in targets], "target string, used boolean")


_CORRELATED = ("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
_MATRIX = (
    f"{MESSY_LINEITEM}, m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS p FROM messy), "
    "filled AS (SELECT l_partkey, l_linenumber, coalesce(l_quantity, q) AS l_quantity, coalesce(l_extendedprice, p) AS l_extendedprice FROM messy, m), "
    "matrix AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM filled" for a in _CORRELATED for b in _CORRELATED
    )
    + ")"
)


def _correlated(spark, folder):
    return messy_lineitem(spark, folder).select(*_CORRELATED)


@query("correlation_matrix", f"WITH {_MATRIX} SELECT * FROM matrix")
def correlation_matrix(spark, folder):
    return rounded(chartdata.correlation_matrix(_correlated(spark, folder)), 8)


_PLACE = "CASE {c} WHEN 'l_partkey' THEN 0 WHEN 'l_linenumber' THEN 1 WHEN 'l_quantity' THEN 2 ELSE 3 END"


@query("correlation_lower", f"WITH {_MATRIX} SELECT * FROM matrix WHERE {_PLACE.format(c='a')} > {_PLACE.format(c='b')}")
def correlation_lower(spark, folder):
    return rounded(chartdata.correlation_lower(_correlated(spark, folder)), 8)


@query(
    "correlation_sorted",
    f"""WITH {_MATRIX}, place AS (SELECT a AS n, CAST(row_number() OVER (ORDER BY abs(r) DESC, a) AS INTEGER) AS i FROM matrix WHERE b = 'l_extendedprice')
        SELECT a, b, r, x.i AS "row", y.i AS "column" FROM matrix JOIN place x ON a = x.n JOIN place y ON b = y.n""",
)
def correlation_sorted(spark, folder):
    return rounded(chartdata.correlation_sorted(_correlated(spark, folder), "l_extendedprice"), 8)


# Ten columns with a constant one and an empty one among them: as with any other number, r is null for these two.
_EDGE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "same", "empty")
_EDGE_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0), 8) AS r FROM edge"
    for a in _EDGE
    for b in _EDGE
)


def _edge(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.withColumns({"same": F.lit(7.5), "empty": F.lit(None).cast("double")}).select(*_EDGE)


@query("correlation_matrix_edge", f"WITH edge AS (SELECT *, 7.5::DOUBLE AS same, NULL::DOUBLE AS empty FROM lineitem) {_EDGE_CELLS}")
def correlation_matrix_edge(spark, folder):
    return rounded(chartdata.correlation_matrix(_edge(spark, folder)), 8)
