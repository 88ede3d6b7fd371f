"""The given star-schema tables in the roles of the analysis.

Customers are stream sites, orders are biological samples, line items are flow readings,
suppliers are watersheds, parts are river reaches. Each role exists twice: as a DataFrame, and
as the SQL view the oracle queries use.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions.semantics import recode
from riffle.operators.reshape import wide_to_long
from riffle.operators.scores import all_scores, assemble, flow_long
from riffle.session import materialize
from riffle.sources import tables

SEGMENT_CLASS = {"BUILDING": "NAT", "AUTOMOBILE": "SB0", "FURNITURE": "SB1", "MACHINERY": "SB2", "HOUSEHOLD": "HB"}
READINGS = ["d_qty", "d_price", "d_disc", "d_tax"]

# (metric, code, component) of the label dimension used on the given tables.
LABELS = [
    ("Dry-season median baseflow", "DS_Mag_50", "Dry-season baseflow"),
    ("Fall pulse magnitude", "FA_Mag", "Fall pulse flow"),
    ("10-year flood magnitude", "Peak_10", "Peak flow"),
    ("2-year flood magnitude", "Peak_2", "Peak flow"),
    ("5-year flood magnitude", "Peak_5", "Peak flow"),
    ("Spring recession magnitude", "SP_Mag", "Spring recession flow"),
    ("Wet-season low baseflow", "Wet_BFL_Mag_10", "Wet-season baseflow"),
    ("Wet-season median baseflow", "Wet_BFL_Mag_50", "Wet-season baseflow"),
    ("Peak Flow Magnitude (Q99, cfs)", "Q99", "Peak Flow Magnitude"),
]

# Published limits for the readings: (metric, endpoint, index, threshold, sign, 25, 50, 75).
PUBLISHED = [
    ("d_qty", "asci", "ASCI", 0.86, "Positive", 15.0, 12.0, 6.0),
    ("d_qty", "asci", "ASCI", 0.86, "Negative", -15.0, -12.0, -6.0),
    ("d_qty", "csci", "CSCI", 0.79, "Positive", 20.0, 16.0, 4.0),
    ("d_price", "csci", "CSCI", 0.79, "Positive", 30000.0, 20000.0, 10000.0),
    ("d_price", "csci", "CSCI", 0.79, "Negative", -30000.0, -20000.0, -10000.0),
    ("d_price", "csci", "CSCI", 0.63, "Negative", -30000.0, -25000.0, -10000.0),
    ("d_disc", "asci", "ASCI", 0.86, "Positive", 0.06, 0.055, 0.03),
    ("d_disc", "asci", "ASCI", 0.86, "Negative", -0.04, -0.025, -0.01),
    ("d_flow", "asci", "ASCI", 0.86, "Negative", -0.04, -0.02, -0.01),
]

# Crossings of the site-level curves by index and metric, in the wide layout: for each limit
# class a lower and an upper crossing, built from the two numbers and a step per class.
CURVES = [
    ("csci", "DS_Mag_50", 6, 0.9, -60.0, 55.0), ("csci", "DS_Mag_50", 6, 0.5, -25.0, 15.0),
    ("csci", "FA_Mag", 6, 0.9, -40.0, None), ("csci", "FA_Mag", 6, 0.5, 5.0, None),
    ("csci", "Peak_10", 3, 0.9, -50.0, -20.0), ("csci", "Peak_10", 3, 0.5, None, None),
    ("csci", "SP_Mag", 3, 0.9, None, None), ("csci", "SP_Mag", 3, 0.5, -9.0, 9.0),
    ("csci", "Peak_2", 9, 0.9, -9.0, 9.0), ("csci", "Q99", 3, 0.7, -9.0, 9.0),
    ("asci", "DS_Mag_50", 6, 0.9, 20.0, None), ("asci", "DS_Mag_50", 6, 0.5, None, None),
    ("asci", "SP_Mag", 6, 0.9, -30.0, None), ("asci", "SP_Mag", 6, 0.5, 3.0, 30.0),
    ("asci", "Q99", 3, 0.9, None, None), ("asci", "Q99", 3, 0.5, None, None),
    ("asci", "Wet_BFL_Mag_50", 3, 0.9, -80.0, 70.0), ("asci", "Wet_BFL_Mag_50", 3, 0.5, -10.0, None),
]


def crossing(value: float | None, step: int) -> float | None:
    """Crossing of the ``step``-th limit class; some classes are not reached at all."""
    return None if value is None or (step == 3 and value < 0) else value + step


def thresholds_rows() -> list[tuple]:
    rows = []
    for index, code, smooth, quantile, low, high in CURVES:
        sides = []
        for step in range(len(C.LIMIT_CLASSES)):
            first = crossing(low, step)
            sides += [first, crossing(high, step) if first is not None else None]
        rows.append((index, code, smooth, quantile, *sides))
    return rows


THRESHOLD_COLUMNS = ["Index", "Hydro_endpoint", "SmoothingFunc", "Quantile"] + [
    f"Threshold{name}_{side}" for name in C.LIMIT_CLASSES for side in ("Lower", "Upper")
]


def _values(rows, columns, doubles=()) -> str:
    def text(v, name):
        if v is None:
            return "CAST(NULL AS DOUBLE)"
        return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if name in doubles else str(v)

    body = ", ".join("(" + ", ".join(text(v, n) for v, n in zip(r, columns)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def _case(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_SCORE_TEXT = """CASE WHEN o_totalprice < 2500 THEN 'NA' ELSE
    cast((cast(round(o_totalprice*100) AS bigint)*12//5)//100000000 AS varchar) || '.' ||
    lpad(cast((cast(round(o_totalprice*100) AS bigint)*12//5)%100000000 AS varchar), 8, '0') END"""
_LON = "-124 + ({k} % 997) / 100.0::double"
_LAT = "32 + ({k} % 991) / 100.0::double"

VIEWS: dict[str, str] = {
    "v_site": f"""SELECT cast(c_custkey AS varchar) AS masterid,
        CASE WHEN c_acctbal >= -900 THEN {_case('c_mktsegment', SEGMENT_CLASS)} END AS channel_engineering_class
        FROM customer""",
    "v_csci_raw": f"""SELECT cast(o_custkey AS varchar) AS masterid, cast(year(o_orderdate) AS integer) AS sampleyear,
        CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS fieldreplicate, {_SCORE_TEXT} AS csci,
        {_LON.format(k='o_custkey')} AS longitude, {_LAT.format(k='o_custkey')} AS latitude,
        cast(o_custkey * 10 AS varchar) AS comid FROM orders WHERE o_orderstatus <> 'P'""",
    "v_asci_raw": f"""SELECT cast(o_custkey AS varchar) AS masterid,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS sampledate,
        CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS replicate, {_SCORE_TEXT} AS result,
        {_LON.format(k='o_custkey')} AS longitude, {_LAT.format(k='o_custkey')} AS latitude,
        cast(o_custkey * 10 AS varchar) AS comid FROM orders WHERE o_orderstatus = 'P'""",
    "v_scores": """SELECT masterid, sampleyear, 'csci' AS Metric, try_cast(csci AS double) AS MetricValue,
        longitude, latitude, comid AS COMID FROM v_csci_raw WHERE fieldreplicate = 1
        UNION ALL
        SELECT masterid, cast(substr(sampledate, 1, 4) AS integer), 'asci', try_cast(result AS double),
        longitude, latitude, comid FROM v_asci_raw WHERE replicate = 1""",
    "v_flow_wide": f"""SELECT cast(o_custkey AS varchar) AS masterid,
        {_LON.format(k='o_custkey')} AS longitude, {_LAT.format(k='o_custkey')} AS latitude,
        cast(sum(cast(l_quantity AS bigint)) - 26 * count(*) AS double) AS d_ds_mag_50,
        cast(sum(l_linenumber) - 4 * count(*) + 8 AS double) AS d_fa_mag,
        cast(sum(cast(round(l_discount * 100) AS bigint)) - 5 * count(*) AS double) AS d_peak_10,
        cast(sum(cast(round(l_tax * 100) AS bigint)) - 4 * count(*) AS double) AS d_peak_2,
        cast(nullif(sum(cast(round((l_discount - l_tax) * 100) AS bigint)) - count(*), 0) AS double) AS d_peak_5,
        cast(sum(CASE WHEN l_returnflag = 'R' THEN cast(l_quantity AS bigint) ELSE 0 END)
           - sum(CASE WHEN l_returnflag = 'A' THEN cast(l_quantity AS bigint) ELSE 0 END) + 60 AS double) AS d_sp_mag,
        cast(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END)
           - sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END) + 12 AS double) AS d_wet_bfl_mag_10,
        cast(sum(CASE WHEN l_returnflag = 'A' THEN cast(l_quantity AS bigint) ELSE 0 END)
           - sum(CASE WHEN l_returnflag = 'N' THEN cast(l_quantity AS bigint) ELSE 0 END) - 40 AS double) AS d_wet_bfl_mag_50,
        cast(sum(CASE WHEN l_linestatus = 'O' THEN cast(l_quantity AS bigint) ELSE -cast(l_quantity AS bigint) END) AS double) AS delta_q99
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""",
    "v_flow_long": "SELECT masterid, longitude, latitude, flow_metric, deltah_final FROM (" + " UNION ALL ".join(
        f"SELECT masterid, longitude, latitude, '{m}' AS flow_metric, {m} AS deltah_final FROM v_flow_wide"
        for m in C.FLOW_METRICS) + ")",
    "v_labels": _values(
        [(n, c, p, {v: k for k, v in C.METRIC_CODES.items()}[c]) for n, c, p in LABELS],
        ["Flow_Metric_Name", "hydro_endpoints", "Flow_Component", "flow_metric"]),
    "v_engsites": """SELECT s.*, c.channel_engineering_class,
        CASE WHEN channel_engineering_class = 'NAT' THEN 'Natural' WHEN channel_engineering_class <> 'NAT' THEN 'Modified' END AS Class2
        FROM v_scores s JOIN v_site c ON s.masterid IS NOT DISTINCT FROM c.masterid""",
    "v_all": """SELECT f.masterid, e.sampleyear, e.Metric, e.MetricValue, f.longitude, f.latitude, e.COMID,
        e.channel_engineering_class, e.Class2, f.flow_metric, f.deltah_final,
        l.Flow_Metric_Name, l.hydro_endpoints, l.Flow_Component
        FROM v_flow_long f LEFT JOIN v_engsites e ON f.masterid = e.masterid AND f.longitude = e.longitude AND f.latitude = e.latitude
        LEFT JOIN v_labels l ON f.flow_metric = l.flow_metric""",
    "v_reading_wide": """SELECT l_orderkey AS order_id, l_returnflag AS class, l_linestatus AS status, l_quantity - 25 AS d_qty,
        l_extendedprice - 50000 AS d_price, nullif(round(l_discount - 0.05, 4), 0) AS d_disc,
        nullif(round(l_tax - 0.04, 4), 0) AS d_tax FROM lineitem""",
    "v_reading": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT order_id, class, status, '{m}' AS flow_metric, {m} AS deltah_final FROM v_reading_wide" for m in READINGS) + ")",
    "v_published": _values(
        PUBLISHED, ["Hydro_endpoint", "Bio_endpoint", "Biol", "Bio_threshold", "Type", "Threshold25", "Threshold50", "Threshold75"],
        doubles=("Bio_threshold", "Threshold25", "Threshold50", "Threshold75")),
    "v_thresholds": _values(thresholds_rows(), THRESHOLD_COLUMNS, doubles=("Quantile", *THRESHOLD_COLUMNS[4:])),
}


def with_views(sql: str) -> str:
    """Put the definitions of the role views in front that the SQL uses."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    lead = sql.lstrip()
    if lead[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {views}, {lead[14:]}"
    if lead[:5].upper() == "WITH ":
        return f"WITH {views}, {lead[5:]}"
    return f"WITH {views} {sql}"


def _position(key: str):
    k = F.col(key)
    return (
        (F.lit(-124) + (k % 997) / F.lit(100.0)).alias("longitude"),
        (F.lit(32) + (k % 991) / F.lit(100.0)).alias("latitude"),
    )


class Roles:
    """The role tables for one session and one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._flow: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def channel_class(self) -> DataFrame:
        segment = recode(F.col("c_mktsegment"), SEGMENT_CLASS)
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("masterid"),
            F.when(F.col("c_acctbal") >= -900, segment).alias("channel_engineering_class"),
        )

    def _samples(self) -> DataFrame:
        scaled = F.expr("cast(round(o_totalprice * 100) AS bigint) * 12 div 5")
        return self.table("orders").withColumn("scaled", scaled).select(
            F.col("o_custkey").cast("string").alias("masterid"),
            F.when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(1).alias("replicate"),
            F.when(F.col("o_totalprice") < 2500, "NA").otherwise(
                F.concat(F.expr("cast(scaled div 100000000 AS string)"), F.lit("."),
                         F.lpad((F.col("scaled") % 100000000).cast("string"), 8, "0"))
            ).alias("result"),
            *_position("o_custkey"), (F.col("o_custkey") * 10).cast("string").alias("comid"),
            "o_orderdate", "o_orderstatus",
        )

    def csci_raw(self) -> DataFrame:
        return (
            self._samples().filter(F.col("o_orderstatus") != "P")
            .withColumn("sampleyear", F.year("o_orderdate"))
            .withColumnsRenamed({"replicate": "fieldreplicate", "result": "csci"}).drop("o_orderdate", "o_orderstatus")
        )

    def asci_raw(self) -> DataFrame:
        return (
            self._samples().filter(F.col("o_orderstatus") == "P")
            .withColumn("sampledate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .drop("o_orderdate", "o_orderstatus")
        )

    def scores(self) -> DataFrame:
        return all_scores(self.csci_raw(), self.asci_raw())

    def flow_wide(self) -> DataFrame:
        quantity = F.col("l_quantity").cast("bigint")
        cents = lambda c: F.round(c * 100).cast("bigint")
        only = lambda flag, value: F.sum(F.when(F.col("l_returnflag") == flag, value).otherwise(0))
        rows = F.count("*")
        joined = self.table("orders").select("o_orderkey", "o_custkey").join(
            self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
        )
        number = F.col("l_linenumber")
        deltas = {
            "d_ds_mag_50": F.sum(quantity) - 26 * rows,
            "d_fa_mag": F.sum(number) - 4 * rows + 8,
            "d_peak_10": F.sum(cents(F.col("l_discount"))) - 5 * rows,
            "d_peak_2": F.sum(cents(F.col("l_tax"))) - 4 * rows,
            "d_peak_5": F.nullif(F.sum(cents(F.col("l_discount") - F.col("l_tax"))) - rows, F.lit(0)),
            "d_sp_mag": only("R", quantity) - only("A", quantity) + 60,
            "d_wet_bfl_mag_10": only("R", number) - only("N", number) + 12,
            "d_wet_bfl_mag_50": only("A", quantity) - only("N", quantity) - 40,
            "delta_q99": F.sum(F.when(F.col("l_linestatus") == "O", quantity).otherwise(-quantity)),
        }
        return joined.groupBy("o_custkey").agg(*[v.cast("double").alias(k) for k, v in deltas.items()]).select(
            F.col("o_custkey").cast("string").alias("masterid"), *_position("o_custkey"), *deltas
        )

    def flow(self) -> DataFrame:
        return flow_long(self.flow_wide()) if self._flow is None else self._flow

    def written_flow(self) -> DataFrame:
        """The flow values, written once; steps of the same query read them from there afterwards."""
        if self._flow is None:
            self._flow = materialize(self.flow(), "flow")
        return self._flow

    def label_file(self) -> DataFrame:
        """The label rows in the layout of the label file, without the Q99 row."""
        return tables.constant_table(self.spark, LABELS[:-1], tables.LABELS)

    def labels(self) -> DataFrame:
        return tables.label_dimension(self.label_file())

    def all_data(self) -> DataFrame:
        return assemble(self.scores(), self.channel_class(), self.flow(), self.labels(), label_rows=len(LABELS))

    def reading_wide(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("class"),
            F.col("l_linestatus").alias("status"), (F.col("l_quantity") - 25).alias("d_qty"),
            (F.col("l_extendedprice") - 50000).alias("d_price"),
            F.nullif(F.round(F.col("l_discount") - 0.05, 4), F.lit(0.0)).alias("d_disc"),
            F.nullif(F.round(F.col("l_tax") - 0.04, 4), F.lit(0.0)).alias("d_tax"),
        )

    def reading(self) -> DataFrame:
        return wide_to_long(self.reading_wide(), READINGS, "flow_metric", "deltah_final")

    def reading_metrics(self) -> DataFrame:
        """Metrics that occur in the readings: all of them, as every row has each, or none of an empty table."""
        names = [] if self.table("lineitem").isEmpty() else [(name,) for name in READINGS]
        return tables.constant_table(self.spark, names, tables.schema_of(("Hydro_Metric", "string")))

    def published(self) -> DataFrame:
        return tables.constant_table(self.spark, PUBLISHED, tables.PUBLISHED_LIMITS)

    def thresholds(self) -> DataFrame:
        kinds = ["string", "string", "int", "double"] + ["double"] * (len(THRESHOLD_COLUMNS) - 4)
        schema = tables.schema_of(*zip(THRESHOLD_COLUMNS, kinds))
        return tables.constant_table(self.spark, thresholds_rows(), schema)
