"""Queries over numeric columns: data quality, scaling and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlens.functions import text as X
from supportlens.operators import charts as H, profile as P
from supportlens.operators.profile_store import ProfileStore
from supportlens.operators.quantiles import numeric_columns
from supportlens.plans import oracle_text as O, views
from supportlens.plans.registry import query
from supportlens.session import work_folder

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRED = [*NUMBERS, "l_partkey", "l_suppkey"]


def each(template: str, columns=NUMBERS) -> str:
    """One SELECT per column, with ``{c}`` as the column's name."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


def _rounded(value: str) -> str:
    """Six decimals, with one zero instead of two signed ones."""
    return f"CASE WHEN round({value}, 6) = 0 THEN 0.0 ELSE round({value}, 6) END"


MEASURE_COLUMNS = [*NUMBERS, "l_returnflag", "l_linestatus", "return_status"]


@query(
    each(
        """SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
                  round((count(*) - count({c})) * 100.0 / count(*), 6) AS percent FROM measures""",
        MEASURE_COLUMNS,
    ),
    "measures",
)
def missing_stats(spark, sf_dir):
    return P.missing_stats(views.measures(spark, sf_dir))


@query(
    """SELECT count(*) AS total_records, count(DISTINCT measures) AS distinct_records,
              count(*) - count(DISTINCT measures) AS duplicate_records
       FROM measures""",
    "measures",
)
def duplicate_count(spark, sf_dir):
    return P.duplicate_count(views.measures(spark, sf_dir))


DESCRIBED_SQL = each(
    """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
              min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
              round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM measures"""
)


@query(DESCRIBED_SQL, "measures")
def describe_numeric(spark, sf_dir):
    return P.describe_numeric(views.measures(spark, sf_dir), NUMBERS)


@query(DESCRIBED_SQL, "measures")
def describe_current(spark, sf_dir):
    """The same from sketches per file; the second half of the rows is added to the first."""
    rows = views.measures(spark, sf_dir)
    path = work_folder(spark, "measures")
    store = ProfileStore(spark, work_folder(spark, "profile"), rows.schema, NUMBERS)
    later = F.coalesce(F.pmod(F.xxhash64("l_extendedprice"), F.lit(2)) == 0, F.lit(False))
    for part in (rows.where(~later), rows.where(later)):
        part.write.mode("append").parquet(path)
        store.update(path)
    return store.describe(spark.read.schema(rows.schema).parquet(path))


@query(
    each(
        """SELECT * FROM (SELECT '{c}' AS "column", CAST(sum(n) OVER () AS BIGINT) AS count, count(*) OVER () AS "unique", {c} AS top, n AS freq
                 FROM (SELECT {c}, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY {c})
                 QUALIFY row_number() OVER (ORDER BY n DESC, {c}) = 1)""",
        ["instruction", "category", "intent", "flags"],
    ),
    "records",
)
def describe_categorical(spark, sf_dir):
    return P.describe_categorical(views.records(spark, sf_dir), ["instruction", "category", "intent", "flags"])


@query(
    each("""SELECT '{c}' AS "column", 'numeric' AS kind, count({c}) AS present FROM measures""")
    + " UNION ALL "
    + each(
        """SELECT '{c}' AS "column", 'categorical' AS kind, count({c}) AS present FROM measures""",
        ["l_returnflag", "l_linestatus", "return_status"],
    ),
    "measures",
)
def column_kinds(spark, sf_dir):
    return P.column_kinds(views.measures(spark, sf_dir))


@query(
    each(
        """SELECT '{c}' AS "column", count(*) AS classes, round(max(n) * 100.0 / any_value(t), 6) AS max_percent,
                  round(min(n) * 100.0 / any_value(t), 6) AS min_percent,
                  max(n) * 100.0 / any_value(t) > 80 OR min(n) * 100.0 / any_value(t) < 20 AS imbalanced
           FROM (SELECT {c}, count(*) AS n, (SELECT count(*) FROM measures) AS t FROM measures
                 WHERE {c} IS NOT NULL GROUP BY {c})""",
        ["l_returnflag", "l_linestatus", "return_status"],
    ),
    "measures",
)
def class_balance(spark, sf_dir):
    return P.class_balance(views.measures(spark, sf_dir))


def _correlation_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {_rounded(f'corr({a}, {b})')} AS r FROM measures"
        for a in NUMBERS
        for b in NUMBERS
    )


@query(_correlation_sql(), "measures")
def correlation_matrix(spark, sf_dir):
    return P.correlation_matrix(views.measures(spark, sf_dir), NUMBERS)


@query(_correlation_sql(), "measures")
def correlation_heatmap(spark, sf_dir):
    return H.correlation_heatmap(views.measures(spark, sf_dir), NUMBERS)


# --- cleaning ------------------------------------------------------------------------------------------


KEYED = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, NULLIF(l_discount, 0) AS l_discount, NULLIF(l_tax, 0) AS l_tax, NULLIF(l_returnflag, 'N') AS l_returnflag, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS return_status FROM lineitem"


def _keyed(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("return_status"),
    )


@query(
    f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM ({KEYED})"
)
def drop_sparse_columns(spark, sf_dir):
    return P.drop_sparse_columns(_keyed(spark, sf_dir))


@query(
    f"""WITH k AS ({KEYED})
        SELECT l_orderkey, l_linenumber,
               coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM k)) AS l_discount,
               coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM k)) AS l_tax FROM k"""
)
def fill_median(spark, sf_dir):
    rows = _keyed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return P.fill_median(rows, ["l_discount", "l_tax"])


@query(
    f"""WITH k AS ({KEYED})
        SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (
            SELECT l_returnflag FROM k WHERE l_returnflag IS NOT NULL
            GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag FROM k"""
)
def fill_mode(spark, sf_dir):
    return P.fill_mode(_keyed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag"))


QUARTILES = """(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"""
PRICES = ["l_extendedprice", "l_quantity"]


@query(
    each(
        f"""SELECT '{{c}}' AS "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
            FROM {QUARTILES}""",
        PRICES,
    )
)
def iqr_bounds(spark, sf_dir):
    return P.iqr_table(views.table(spark, sf_dir, "lineitem"), PRICES)


EVENT_QUARTILES = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@query(
    f"""SELECT 'value' AS "column", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM events, {EVENT_QUARTILES}"""
)
def outlier_count(spark, sf_dir):
    return P.outlier_count(views.table(spark, sf_dir, "events"), ["value"])


@query(
    f"""SELECT event_id, round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), value)), 6) AS value
        FROM events, {EVENT_QUARTILES}"""
)
def clip_outliers(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "value")
    return P.clip_outliers(rows, ["value"]).withColumn("value", F.round("value", 6))


def _standard(column: str, table: str) -> str:
    return _rounded(
        f"({column} - (SELECT avg({column}) FROM {table})) / (SELECT stddev_pop({column}) FROM {table})"
    )


def _minmax(column: str, table: str) -> str:
    return _rounded(
        f"({column} - (SELECT min({column}) FROM {table})) / (SELECT max({column}) - min({column}) FROM {table})"
    )


def _round_columns(df, columns):
    rounded = {c: F.round(c, 6) for c in columns}
    return df.withColumns({c: F.when(value == 0.0, 0.0).otherwise(value) for c, value in rounded.items()})


@query(f"SELECT event_id, {_standard('value', 'events')} AS value FROM events")
def standardize(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "value")
    return _round_columns(P.standardize(rows, ["value"]), ["value"])


@query(
    f"SELECT event_id, {_standard('value', 'events')} AS value, {_minmax('value', 'events')} AS value_minmax FROM events"
)
def minmax_scale(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "value")
    return _round_columns(P.standardize(rows, ["value"], minmax=True), ["value", "value_minmax"])


@query(
    f"""SELECT p_partkey, {_standard('p_size', 'part')} AS p_size, {_standard('p_retailprice', 'part')} AS p_retailprice
        FROM part"""
)
def scale_features(spark, sf_dir):
    rows = views.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return _round_columns(P.standardize(rows, ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"])


@query(
    each(
        """SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS scale,
                  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM part""",
        ["p_size", "p_retailprice"],
    )
)
def feature_scaler(spark, sf_dir):
    stats = P.scaling_stats(views.table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "scale")})


def _profile_sql() -> str:
    """Fill, drop copies, clip and scale, column by column."""
    filled = ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM measures)) AS {c}" for c in NUMBERS
    )
    flag = (
        "coalesce(l_returnflag, (SELECT l_returnflag FROM measures WHERE l_returnflag IS NOT NULL"
        " GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag"
    )
    bounds = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in NUMBERS
    )
    clipped = ", ".join(
        f"greatest({c}_q1 - 1.5 * ({c}_q3 - {c}_q1), least({c}_q3 + 1.5 * ({c}_q3 - {c}_q1), {c})) AS {c}"
        for c in NUMBERS
    )
    scaled = ", ".join(
        f"{_standard(c, 'clipped')} AS {c}, {_minmax(c, 'clipped')} AS {c}_minmax" for c in NUMBERS
    )
    return f"""
        WITH filled AS (SELECT DISTINCT {filled}, {flag}, l_linestatus FROM measures),
             bounds AS (SELECT {bounds} FROM filled),
             clipped AS (SELECT {clipped}, l_returnflag, l_linestatus FROM filled, bounds)
        SELECT {scaled}, l_returnflag, l_linestatus FROM clipped"""


@query(_profile_sql(), "measures")
def profile_frame(spark, sf_dir):
    cleaned = P.clean_frame(views.measures(spark, sf_dir))
    return _round_columns(cleaned, numeric_columns(cleaned))


# --- chart tables -----------------------------------------------------------------------------------------


def _histogram_sql(value: str, table: str, bins: int) -> str:
    return f"""
        SELECT CAST(b AS INT) AS bin, round(lo + b * (hi - lo) / {bins}.0, 6) AS bin_start,
               round(lo + (b + 1) * (hi - lo) / {bins}.0, 6) AS bin_end, count(x) AS n
        FROM (SELECT min({value}) AS lo, max({value}) AS hi FROM {table})
        CROSS JOIN (SELECT unnest(range({bins})) AS b)
        LEFT JOIN (SELECT CAST({value} AS DOUBLE) AS x FROM {table})
          ON least(floor((x - lo) * {bins}.0 / (hi - lo)), {bins - 1}) = b
        GROUP BY b, lo, hi"""


@query(_histogram_sql("length(text)", "documents", 50))
def histogram(spark, sf_dir):
    return H.histogram(views.table(spark, sf_dir, "documents"), X.char_length("text"))


def _words(column: str) -> str:
    return f"coalesce(len({O.words(column)}), 0)"


@query(
    f"""SELECT 'question_length' AS "column", * FROM ({_histogram_sql(_words('question'), 'qa', 50)})
        UNION ALL SELECT 'answer_length', * FROM ({_histogram_sql(_words('answer'), 'qa', 50)})""",
    "qa",
)
def length_by_group(spark, sf_dir):
    lengths = {"question_length": X.word_count("question"), "answer_length": X.word_count("answer")}
    return H.histograms(views.qa(spark, sf_dir), lengths)


@query(
    f"""WITH stats AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS std FROM events),
             params AS (SELECT *, std * power(n, -0.2) AS h, (hi - lo) / 49.0 AS step FROM stats),
             bins AS ({_histogram_sql('value', 'events', 200)})
        SELECT CAST(point AS INT) AS point, round(lo + point * step, 6) AS x,
               round(sum(exp(-0.5 * power((lo + point * step - (lo + (bin + 0.5) * (hi - lo) / 200.0)) / h, 2)) * bins.n)
                     / (any_value(params.n) * any_value(h) * sqrt(2 * pi())), 9) AS density
        FROM bins, params, (SELECT unnest(range(50)) AS point)
        GROUP BY point, lo, step"""
)
def kde_curve(spark, sf_dir):
    return H.kde_curve(views.table(spark, sf_dir, "events"), "value")


@query(
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                         quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT 'value' AS "column", round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
              min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
              max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
              count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
       FROM events, q"""
)
def box_stats(spark, sf_dir):
    return H.box_stats(views.table(spark, sf_dir, "events"), ["value"])


@query(
    """SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY lang
       UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"""
)
def category_bars(spark, sf_dir):
    """The text column has too many values to be drawn and is left out by its count."""
    return H.category_bars(views.table(spark, sf_dir, "documents"), ["lang", "source", "text"])


@query(
    """SELECT "column" FROM (SELECT 'lang' AS "column", count(DISTINCT lang) AS n FROM documents
                             UNION ALL SELECT 'source', count(DISTINCT source) FROM documents
                             UNION ALL SELECT 'text', count(DISTINCT text) FROM documents)
       WHERE n <= 50"""
)
def high_cardinality_guard(spark, sf_dir):
    kept = P.distinct_up_to(views.table(spark, sf_dir, "documents"), ["lang", "source", "text"])
    return spark.createDataFrame([(c,) for c in kept], "`column` STRING")


@query(
    " UNION ALL ".join(
        f"""SELECT l_orderkey, '{a}' AS x_column, '{b}' AS y_column, {a} AS x, {b} AS y FROM lineitem"""
        for i, a in enumerate(PAIRED)
        for b in PAIRED[i + 1 :]
    )
)
def pair_points(spark, sf_dir):
    return H.pair_points(views.table(spark, sf_dir, "lineitem"), "l_orderkey", PAIRED)


@query(
    """SELECT CAST(d AS DATE) AS day, count(e.event_id) AS event_id, count(e.value) AS value, count(e.props) AS props
       FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS d FROM events)
       LEFT JOIN events e ON e.ts::DATE = d::DATE GROUP BY d"""
)
def daily_counts(spark, sf_dir):
    return H.daily_counts(views.table(spark, sf_dir, "events"), "ts", ["event_id", "value", "props"])
