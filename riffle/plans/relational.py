"""Sources, projections, joins, aggregates, windows and reshaping on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions import semantics as S
from riffle.operators import joins as J
from riffle.operators import ranks, reshape
from riffle.operators import scores as SC
from riffle.operators.alteration import label_alteration, published_limits
from riffle.operators.curves import curve_roots, grid_ranges, regular_grid
from riffle.plans.registry import query
from riffle.plans.roles import LABELS, PUBLISHED, READINGS, SEGMENT_CLASS
from riffle.session import new_path
from riffle.sources import tables as IO

def tally(*, name: str = "n"):
    return F.count("*").alias(name)


# ---- sources and sinks -------------------------------------------------------------------

@query("IO1_read_csv", """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer""")
def io1(r):
    path = new_path(r.spark, "io1")
    out = r.table("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal")
    IO.write_csv(out, path)
    return IO.read_csv(r.spark, path, IO.schema_of(("c_custkey", "bigint"), ("segment", "string"), ("c_acctbal", "double")))


@query("IO2_write_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def io2(r):
    path = new_path(r.spark, "io2")
    out = r.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    IO.write_csv(out, path)
    return IO.read_csv(r.spark, path, out.schema)


@query("IO3_save_load", """SELECT flow_metric, class, count(*) AS n, min(deltah_final) AS lowest, max(deltah_final) AS highest
    FROM v_reading WHERE flow_metric <> 'd_tax' GROUP BY ALL""")
def io3(r):
    path = new_path(r.spark, "io3")
    IO.save_table(r.reading(), path, ["flow_metric"])
    kept = IO.load_table(r.spark, path).filter(F.col("flow_metric") != "d_tax")
    return kept.groupBy("flow_metric", "class").agg(
        tally(), F.min("deltah_final").alias("lowest"), F.max("deltah_final").alias("highest"))


@query("IO6_staged_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def io6(r):
    schema = IO.schema_of(("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double"))
    return IO.load_table(r.spark, f"{r.sf_dir}/supplier.parquet", schema)


@query("IO9_label_dimension", """SELECT f.masterid, f.flow_metric, f.deltah_final, l.Flow_Metric_Name, l.hydro_endpoints, l.Flow_Component
    FROM v_flow_long f LEFT JOIN v_labels l ON f.flow_metric = l.flow_metric""")
def io9(r):
    flow = r.flow().select("masterid", "flow_metric", "deltah_final")
    return J.lookup(flow, IO.label_dimension(r.label_file()), ["flow_metric"], rows=len(LABELS))


# ---- projections, filters, predicates ----------------------------------------------------

@query("PF1_select", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def pf1(r):
    return r.table("lineitem").drop("l_partkey").select("l_orderkey", "l_quantity", "l_extendedprice")


@query("PF2_rename", "SELECT o_orderkey AS sample, o_custkey AS masterid, o_totalprice AS MetricValue FROM orders")
def pf2(r):
    return r.table("orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumnsRenamed(
        {"o_orderkey": "sample", "o_custkey": "masterid", "o_totalprice": "MetricValue"})


@query("PF3_derive", "SELECT o_orderkey, o_totalprice / 500000::double AS MetricValue, cast(year(o_orderdate) AS integer) AS sampleyear FROM orders")
def pf3(r):
    return r.table("orders").select(
        "o_orderkey", (F.col("o_totalprice") / F.lit(500000.0)).alias("MetricValue"), F.year("o_orderdate").alias("sampleyear"))


@query("PF4_filter", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000""")
def pf4(r):
    return r.table("orders").filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000)
    ).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("PF5_membership", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def pf5(r):
    return r.table("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("PF6_sign_split", """SELECT flow_metric, CASE WHEN deltah_final > 0 THEN 'Pos' ELSE 'Neg' END AS direction,
    count(*) AS n, min(deltah_final) AS lowest, max(deltah_final) AS highest
    FROM v_reading WHERE deltah_final <> 0 GROUP BY ALL""")
def pf6(r):
    x = F.col("deltah_final")
    return r.reading().filter(x != 0).groupBy(
        "flow_metric", F.when(x > 0, "Pos").otherwise("Neg").alias("direction")
    ).agg(tally(), F.min(x).alias("lowest"), F.max(x).alias("highest"))


@query("PF7_drop_missing", "SELECT order_id, class, d_disc, d_tax FROM v_reading_wide WHERE d_disc IS NOT NULL AND d_tax IS NOT NULL")
def pf7(r):
    return r.reading_wide().select("order_id", "class", "d_disc", "d_tax").na.drop(subset=["d_disc", "d_tax"])


@query("PF8_drop_infinite", """SELECT l_returnflag, count(*) AS n, count(ratio) AS n_known, max(ratio) AS highest FROM (
    SELECT l_returnflag, CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN 'inf'::double ELSE l_tax / l_discount END AS ratio FROM lineitem)
    WHERE ratio IS NULL OR ratio <> 'inf'::double GROUP BY ALL""")
def pf8(r):
    ratio = F.when(F.col("l_tax") != 0, F.when(F.col("l_discount") == 0, float("inf")).otherwise(
        F.try_divide("l_tax", "l_discount")))
    rows = r.table("lineitem").select("l_returnflag", ratio.alias("ratio"))
    return S.finite_rows(rows).groupBy("l_returnflag").agg(
        tally(), F.count("ratio").alias("n_known"), F.max("ratio").alias("highest"))


@query("PF9_two_way_label", """SELECT class, CASE WHEN d_disc < 0 THEN 'Negative' WHEN d_disc >= 0 THEN 'Positive' END AS Type,
    count(*) AS n FROM v_reading_wide GROUP BY ALL""")
def pf9(r):
    label = S.if_else(F.col("d_disc") < 0, F.lit("Negative"), F.lit("Positive"))
    return r.reading_wide().groupBy("class", label.alias("Type")).agg(tally())


@query("PF10_mapping", """SELECT masterid, channel_engineering_class,
    CASE channel_engineering_class WHEN 'HB' THEN 0.67::double WHEN 'NAT' THEN 0.79::double WHEN 'SB0' THEN 0.78::double WHEN 'SB2' THEN 0.75::double END AS BioThresh
    FROM v_site""")
def pf10(r):
    return r.channel_class().withColumn("BioThresh", S.by_index(F.lit("csci"), F.col("channel_engineering_class"), C.BIO_THRESHOLDS))


@query("PF11_fill_missing", "SELECT order_id, coalesce(d_disc, 0) AS d_disc, coalesce(d_tax, 0) AS d_tax FROM v_reading_wide")
def pf11(r):
    return r.reading_wide().select("order_id", "d_disc", "d_tax").na.fill(0.0)


@query("PF12_relabel", """SELECT masterid,
    CASE channel_engineering_class WHEN 'NAT' THEN 'Natural' WHEN 'SB0' THEN 'Soft: Zero Hard Sides' WHEN 'SB1' THEN 'Soft: One Hard Side'
      WHEN 'SB2' THEN 'Soft: Two Hard Sides' WHEN 'HB' THEN 'Hard Bottom' END AS channel_engineering_class,
    CASE channel_engineering_class WHEN 'NAT' THEN 1 WHEN 'SB0' THEN 2 WHEN 'SB1' THEN 3 WHEN 'SB2' THEN 4 WHEN 'HB' THEN 5 END AS class_order
    FROM v_site""")
def pf12(r):
    return S.relabel(r.channel_class(), "channel_engineering_class", C.CHANNEL_NAMES, "class_order")


@query("PF13_listed_metrics", """SELECT masterid, flow_metric, deltah_final FROM v_flow_long
    WHERE flow_metric IN ('d_peak_10', 'd_peak_2', 'd_peak_5', 'delta_q99')""")
def pf13(r):
    return r.flow().filter(F.col("flow_metric").isin(C.PEAK_METRICS)).select("masterid", "flow_metric", "deltah_final")


@query("PF14_null_count", """SELECT flow_metric, count(*) AS n, count_if(deltah_final IS NULL) AS n_null FROM v_reading GROUP BY ALL""")
def pf14(r):
    return r.reading().groupBy("flow_metric").agg(tally(), F.count_if(F.col("deltah_final").isNull()).alias("n_null"))


@query("PF15_closed_interval", """SELECT class, CASE WHEN d_disc >= -0.02 AND d_disc <= 0.03 THEN 'Within'
    WHEN d_disc IS NOT NULL THEN 'NotWithin' END AS position, count(*) AS n FROM v_reading_wide GROUP BY ALL""")
def pf15(r):
    label = S.if_else(F.col("d_disc").between(-0.02, 0.03), F.lit("Within"), F.lit("NotWithin"))
    return r.reading_wide().groupBy("class", label.alias("position")).agg(tally())


# ---- joins -------------------------------------------------------------------------------

@query("JN1_inner", """SELECT o_orderkey, cast(o_custkey AS varchar) AS masterid, channel_engineering_class
    FROM orders JOIN v_site ON cast(o_custkey AS varchar) = masterid""")
def jn1(r):
    orders = r.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("masterid"))
    return J.join(orders, r.channel_class(), ["masterid"])


@query("JN2_left_dimension", """SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation
    ON c_nationkey = n_nationkey AND n_regionkey < 4""")
def jn2(r):
    nation = r.table("nation").filter(F.col("n_regionkey") < 4)
    return J.lookup(r.table("customer").select("c_custkey", "c_nationkey"), nation, {"c_nationkey": "n_nationkey"})


@query("JN3_left_common", """SELECT c_custkey, nationkey, regionkey, n_name FROM (
    SELECT c_custkey, c_nationkey AS nationkey, c_nationkey % 5 AS regionkey FROM customer) c
    LEFT JOIN nation ON nationkey = n_nationkey AND regionkey = n_regionkey""")
def jn3(r):
    left = r.table("customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"), (F.col("c_nationkey") % 5).alias("regionkey"))
    right = r.table("nation").withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    return J.join(left, right, J.common_columns(left, right), "left")


@query("JN4_right_three_keys", """SELECT f.masterid, f.longitude, f.latitude, e.Metric, e.MetricValue, e.channel_engineering_class, f.d_ds_mag_50
    FROM v_engsites e RIGHT JOIN v_flow_wide f ON e.masterid = f.masterid AND e.longitude = f.longitude AND e.latitude = f.latitude""")
def jn4(r):
    sites = SC.score_sites(r.scores(), r.channel_class()).drop("sampleyear", "COMID", "Class2")
    flow = r.flow_wide().select("masterid", "longitude", "latitude", "d_ds_mag_50")
    return J.join(sites, flow, ["masterid", "longitude", "latitude"], "right")


@query("JN5_full", """WITH u AS (SELECT nullif(user_id, 7) AS k, count(*) AS n_events FROM events GROUP BY ALL),
    s AS (SELECT nullif(s_suppkey, 9) AS k, s_name FROM supplier)
    SELECT coalesce(u.k, s.k) AS k, n_events, s_name FROM u FULL JOIN s ON u.k IS NOT DISTINCT FROM s.k""")
def jn5(r):
    users = r.table("events").groupBy(F.nullif("user_id", F.lit(7)).alias("k")).agg(tally(name="n_events"))
    names = r.table("supplier").select(F.nullif("s_suppkey", F.lit(9)).alias("k"), "s_name")
    return J.join(users, names, ["k"], "full")


@query("JN6_many_to_many", """SELECT event_type, o_orderstatus, count(*) AS n_pairs FROM events JOIN orders ON user_id = o_custkey GROUP BY ALL""")
def jn6(r):
    """The pairs are counted from the sizes of the groups that meet, so none is generated."""
    events = r.table("events").groupBy(F.col("user_id").alias("k"), "event_type").agg(tally(name="n_events"))
    orders = r.table("orders").groupBy(F.col("o_custkey").alias("k"), "o_orderstatus").agg(tally(name="n_orders"))
    return J.join(events, orders, ["k"]).groupBy("event_type", "o_orderstatus").agg(
        F.sum(F.col("n_events") * F.col("n_orders")).alias("n_pairs"))


@query("JN7_semi", """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (
    SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL""")
def jn7(r):
    natural = r.table("customer").filter(F.col("c_mktsegment") == "BUILDING")
    return J.within(r.table("orders"), natural, {"o_custkey": "c_custkey"}).groupBy("o_orderstatus").agg(tally())


@query("JN8_anti", """SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_custkey, 5) AS k FROM customer) c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.k AND o_orderstatus = 'P')""")
def jn8(r):
    sites = r.table("customer").select("c_custkey", F.nullif("c_custkey", F.lit(5)).alias("k"))
    return J.without(sites, r.table("orders").filter(F.col("o_orderstatus") == "P"), {"k": "o_custkey"})


@query("JN9_config_grid", f"""SELECT biol, flow, direction, cast(smooth AS integer) AS smooth FROM (SELECT DISTINCT l_returnflag AS biol FROM lineitem),
    (SELECT unnest({READINGS}) AS flow), (SELECT unnest(['Pos', 'Neg']) AS direction), (SELECT unnest({C.SMOOTHS}) AS smooth)""")
def jn9(r):
    endpoints = r.table("lineitem").select(F.col("l_returnflag").alias("biol")).distinct()
    return J.config_grid(endpoints, flow=READINGS, direction=["Pos", "Neg"], smooth=C.SMOOTHS)


_LIMITS = """lim AS (SELECT Hydro_endpoint AS Hydro_Metric, Bio_endpoint, Biol, Bio_threshold, t AS Threshold,
    max(CASE WHEN Type = 'Positive' THEN v END) AS Positive, max(CASE WHEN Type = 'Negative' THEN v END) AS Negative
    FROM (SELECT *, unnest(['Threshold25', 'Threshold50', 'Threshold75']) AS t, unnest([Threshold25, Threshold50, Threshold75]) AS v
      FROM v_published WHERE Bio_threshold IN (0.79, 0.86)) GROUP BY ALL)"""
LABELLED = f"""WITH {_LIMITS}, lab AS (SELECT d.class AS channel_engineering_class, d.deltah_final, lim.*,
    CASE WHEN deltah_final <= Positive AND deltah_final >= Negative THEN 'Unaltered'
         WHEN NOT (deltah_final <= Positive AND deltah_final >= Negative) THEN 'Altered' END AS Alteration_Current
    FROM v_reading d FULL JOIN lim ON d.flow_metric = lim.Hydro_Metric WHERE Bio_threshold IS NOT NULL)"""


def labelled(r):
    delta = r.reading().withColumnsRenamed({"flow_metric": "Hydro_Metric", "class": "channel_engineering_class"})
    return label_alteration(delta, published_limits(r.published()), limit_rows=3 * len(PUBLISHED), known=r.reading_metrics())


@query("JN10_band", LABELLED + """ SELECT Hydro_Metric, Biol, Threshold, channel_engineering_class, Alteration_Current, count(*) AS n FROM lab GROUP BY ALL""")
def jn10(r):
    return labelled(r).groupBy("Hydro_Metric", "Biol", "Threshold", "channel_engineering_class", "Alteration_Current").agg(tally())


# ---- aggregates --------------------------------------------------------------------------

@query("AG1_count", "SELECT class, d_disc, count(*) AS n FROM v_reading_wide GROUP BY ALL")
def ag1(r):
    return r.reading_wide().groupBy("class", "d_disc").agg(tally())


@query("AG2_count_distinct_rows", """SELECT o_orderstatus, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY ALL""")
def ag2(r):
    return r.table("orders").select("o_custkey", "o_orderstatus").distinct().groupBy("o_orderstatus").agg(tally())


@query("AG3_count_extra_key", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def ag3(r):
    return r.table("lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(tally())


@query("AG4_conditional_count", "SELECT class, status, count_if(d_qty > 0) AS NoAugmented FROM v_reading_wide GROUP BY ALL")
def ag4(r):
    return r.reading_wide().groupBy("class", "status").agg(F.count_if(F.col("d_qty") > 0).alias("NoAugmented"))


@query("AG5_sum", "SELECT l_returnflag, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS total FROM lineitem GROUP BY ALL")
def ag5(r):
    return r.table("lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"))


@query("AG6_distinct_count", """SELECT class, count(DISTINCT d_disc) + max(CASE WHEN d_disc IS NULL THEN 1 ELSE 0 END) AS n_values,
    count(DISTINCT order_id) AS n_orders FROM v_reading_wide GROUP BY ALL""")
def ag6(r):
    return r.reading_wide().groupBy("class").agg(
        S.distinct_values(F.col("d_disc")).alias("n_values"), F.count_distinct("order_id").alias("n_orders"))


@query("AG7_extremes", "SELECT min(deltah_final) AS MinDel, max(deltah_final) AS MaxDel FROM v_reading")
def ag7(r):
    return r.reading().agg(F.min("deltah_final").alias("MinDel"), F.max("deltah_final").alias("MaxDel"))


@query("AG8_mean_min_max", """SELECT class, status, flow_metric, round(avg(deltah_final), 6) AS mean, min(deltah_final) AS lowest, max(deltah_final) AS highest
    FROM v_reading GROUP BY ALL""")
def ag8(r):
    return r.reading().groupBy("class", "status", "flow_metric").agg(
        F.round(F.avg("deltah_final"), 6).alias("mean"), F.min("deltah_final").alias("lowest"), F.max("deltah_final").alias("highest"))


@query("AG9_correlation", """SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, CAST(NULL AS double) AS r_constant
    FROM lineitem GROUP BY ALL""")
def ag9(r):
    return r.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(S.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"),
        S.correlation(F.col("l_quantity"), F.lit(1.0)).alias("r_constant"))


@query("AG10_rows_and_attribute", """SELECT o_custkey, count(*) AS n, min(c_mktsegment) AS Index FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def ag10(r):
    """The attribute is constant within the group, so it is joined after the count."""
    counts = r.table("orders").groupBy("o_custkey").agg(tally())
    return J.join(counts, r.table("customer").select("c_custkey", F.col("c_mktsegment").alias("Index")), {"o_custkey": "c_custkey"})


@query("AG11_box_summary", """WITH q AS (SELECT class, flow_metric, quantile_cont(deltah_final, 0.25) AS q1, quantile_cont(deltah_final, 0.5) AS median,
      quantile_cont(deltah_final, 0.75) AS q3 FROM v_reading GROUP BY ALL),
    j AS (SELECT v.class, v.flow_metric, q1, median, q3, deltah_final AS x, deltah_final BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inner_
      FROM v_reading v JOIN q ON v.class = q.class AND v.flow_metric = q.flow_metric WHERE deltah_final IS NOT NULL)
    SELECT class, flow_metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(x) FILTER (inner_) AS whisker_low,
      max(x) FILTER (inner_) AS whisker_high, count_if(NOT inner_) AS n_outliers, count(*) AS n FROM j GROUP BY class, flow_metric, q1, median, q3""")
def ag11(r):
    box = ranks.box_summary(r.reading(), ["class", "flow_metric"], "deltah_final")
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("AG12_frequency", "SELECT l_quantity > 25 AS over, count(*) AS n FROM lineitem GROUP BY ALL")
def ag12(r):
    return r.table("lineitem").groupBy((F.col("l_quantity") > 25).alias("over")).agg(tally())


@query("AG13_overall_classes", """SELECT class, count(*) AS n FROM (SELECT DISTINCT masterid,
    unnest([channel_engineering_class, 'NATLow', 'NATMed', 'NATHigh']) AS class FROM v_engsites) GROUP BY ALL""")
def ag13(r):
    sites = SC.score_sites(r.scores(), r.channel_class()).select("masterid", F.col("channel_engineering_class").alias("class"))
    return reshape.with_overall_classes(sites, "class").groupBy("class").agg(tally())


# ---- windows -----------------------------------------------------------------------------

@query("WN1_share", """SELECT l_returnflag, l_linestatus, n, round(100.0::double * n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS perc
    FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)""")
def wn1(r):
    counts = r.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(tally())
    return counts.withColumn("perc", F.round(S.share(F.col("n"), ["l_returnflag"]), 6))


@query("WN2_group_maximum", """SELECT order_id, d_disc, CASE WHEN count(*) OVER w = count(d_disc) OVER w THEN max(d_disc) OVER w END AS d_disc_max
    FROM v_reading_wide WINDOW w AS (PARTITION BY order_id)""")
def wn2(r):
    rows = r.reading_wide().select("order_id", "d_disc")
    best = rows.groupBy("order_id").agg(S.max_or_null(F.col("d_disc")).alias("d_disc_max"))
    return J.join(rows, best, ["order_id"], "left")


@query("WN3_next_point", """SELECT event_type, event_id AS x, value AS y, lead(event_id) OVER w AS x_next, lead(value) OVER w AS y_next
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def wn3(r):
    return ranks.next_point(r.table("events"), ["event_type"], "event_id", "value")


_ROOTS = """WITH pts AS (SELECT event_type, cast(event_id AS double) AS x, value AS y FROM events),
    seg AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM pts WINDOW w AS (PARTITION BY event_type ORDER BY x)),
    lv AS (SELECT unnest({names}) AS level, unnest({values}::double[]) AS l),
    hits AS (SELECT event_type, level, x0 - (y0 - l) * (x - x0) / (y - y0) AS root FROM seg, lv WHERE (y0 - l) * (y - l) < 0),
    nr AS (SELECT *, row_number() OVER (PARTITION BY event_type, level ORDER BY root) AS rn FROM hits)
    SELECT event_type, level, round(max(root) FILTER (rn = 1), 6) AS Lower, round(max(root) FILTER (rn = 2), 6) AS Upper, count(*) AS n_roots
    FROM nr GROUP BY ALL"""
# Levels with three decimals: no value lies on one.
_LEVELS = {"low": 0.795, "mid": 12.345, "high": 60.005, "none": 1e9}


def _event_roots(r, names):
    levels = {n: F.lit(_LEVELS[n]) for n in names}
    found = curve_roots(r.table("events"), ["event_type"], "event_id", "value", levels)
    return found.withColumns({"Lower": F.round("Lower", 6), "Upper": F.round("Upper", 6)})


@query("WN4_first_two_roots", _ROOTS.format(names=["mid"], values=[_LEVELS["mid"]]))
def wn4(r):
    return _event_roots(r, ["mid"])


@query("DM10_curve_roots", _ROOTS.format(names=list(_LEVELS), values=list(_LEVELS.values())))
def dm10(r):
    return _event_roots(r, list(_LEVELS))


@query("WN5_first_row", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def wn5(r):
    orders = r.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return J.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


# ---- sorts and limits --------------------------------------------------------------------

@query("SL1_sort", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY 1, 2")
def sl1(r):
    return r.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(tally()).orderBy("l_returnflag", "l_linestatus")


@query("SL2_order_by_response", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice")
def sl2(r):
    return r.table("orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice")


@query("SL3_first_rows", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 24")
def sl3(r):
    return r.table("part").select("p_partkey", "p_name").orderBy("p_partkey").limit(C.LABEL_ROWS)


# ---- sets and reshaping ------------------------------------------------------------------

@query("ST1_union_by_name", """SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment, NULL AS name FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name FROM supplier""")
def st1(r):
    a = r.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = r.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return reshape.stack_rows(a, b)


@query("ST2_union_all", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def st2(r):
    return r.table("customer").select(F.col("c_nationkey").alias("nation")).unionByName(
        r.table("supplier").select(F.col("s_nationkey").alias("nation")))


@query("ST3_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def st3(r):
    return r.table("lineitem").select("l_returnflag", "l_linestatus", "l_discount").distinct()


@query("RS1_wide_to_long", "SELECT order_id, class, status, flow_metric, deltah_final FROM v_reading")
def rs1(r):
    return reshape.wide_to_long(r.reading_wide(), READINGS, "flow_metric", "deltah_final")


@query("RS2_long_to_wide", """SELECT l_returnflag, max(n) FILTER (l_linenumber = 1) AS "1", max(n) FILTER (l_linenumber = 2) AS "2",
    max(n) FILTER (l_linenumber = 99) AS "99" FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def rs2(r):
    counts = r.table("lineitem").groupBy("l_returnflag", "l_linenumber").agg(tally())
    return reshape.long_to_wide(counts, ["l_returnflag"], "l_linenumber", "n", [1, 2, 99])


@query("RS3_columns_by_key", """SELECT o.o_orderkey, o.o_totalprice, n_items FROM orders o LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey""")
def rs3(r):
    items = r.table("lineitem").groupBy("l_orderkey").agg(tally(name="n_items"))
    return J.join(r.table("orders").select("o_orderkey", "o_totalprice"), items, {"o_orderkey": "l_orderkey"}, "left")


# ---- scalar functions --------------------------------------------------------------------

@query("SC1_paste", """SELECT masterid, masterid || '_' || coalesce(channel_engineering_class, 'NA') AS code FROM v_site""")
def sc1(r):
    return r.channel_class().select("masterid", S.paste(F.col("masterid"), F.col("channel_engineering_class")).alias("code"))


@query("SC2_split", """SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number FROM customer""")
def sc2(r):
    parts = F.split("c_name", "[^0-9A-Za-z]+")
    return r.table("customer").select("c_custkey", F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("number"))


@query("SC3_replace", "SELECT s_suppkey, regexp_replace(s_name, 'Supplier#0*', '', 'g') AS short FROM supplier")
def sc3(r):
    return r.table("supplier").select("s_suppkey", F.regexp_replace("s_name", "Supplier#0*", "").alias("short"))


@query("SC4_convert", """SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS double) AS level,
    try_cast(split_part(o_orderpriority, '-', 2) AS double) AS not_a_number, cast(o_custkey AS varchar) AS masterid FROM orders""")
def sc4(r):
    parts = F.split("o_orderpriority", "-")
    return r.table("orders").select(
        "o_orderkey", S.to_number(F.get(parts, F.lit(0))).alias("level"), S.to_number(F.get(parts, F.lit(1))).alias("not_a_number"),
        F.col("o_custkey").cast("string").alias("masterid"))


@query("SC5_arithmetic", """SELECT order_id, abs(d_qty) AS size, d_qty + d_disc AS total, CASE WHEN d_qty <> 0 THEN d_disc / d_qty END AS ratio FROM v_reading_wide""")
def sc5(r):
    return r.reading_wide().select(
        "order_id", F.abs("d_qty").alias("size"), (F.col("d_qty") + F.col("d_disc")).alias("total"),
        F.try_divide("d_disc", "d_qty").alias("ratio"))


@query("SC6_grid", """WITH s AS (SELECT class, min(d_qty) AS lo, max(d_qty) AS hi, abs(avg(d_qty) / 500) AS step FROM v_reading_wide GROUP BY ALL)
    SELECT class, round(least(lo + i * step, hi), 9) AS deltah_final FROM (
      SELECT *, unnest(range(cast(floor((hi - lo) / step + 1e-10) AS bigint) + 1)) AS i FROM s WHERE step > 0)""")
def sc6(r):
    ranges = grid_ranges(r.reading_wide(), ["class"], "d_qty")
    grid = regular_grid(ranges, "x_min", "x_max", "x_step", "deltah_final")
    return grid.select("class", F.round("deltah_final", 9).alias("deltah_final"))


@query("SC7_year", "SELECT masterid, sampledate, cast(substr(sampledate, 1, 4) AS integer) AS sampleyear FROM v_asci_raw")
def sc7(r):
    return r.asci_raw().select("masterid", "sampledate", S.year_of(F.col("sampledate")).alias("sampleyear"))


@query("SC8_arrays", """SELECT vec_id AS parent, size, 'V' || label AS request, cast(v AS double) AS v FROM (
    SELECT vec_id, label, len(embedding) AS size, unnest([x FOR x IN embedding IF x > 0.125::float]) AS v FROM embeddings)""")
def sc8(r):
    """Build a request per parent, drop empty and small elements, flatten with the parent key."""
    kept = F.filter("embedding", lambda v: v > F.lit(0.125).cast("float"))
    return r.table("embeddings").filter(F.size("embedding") > 0).select(
        F.col("vec_id").alias("parent"), F.size("embedding").cast("bigint").alias("size"),
        F.concat(F.lit("V"), F.col("label").cast("string")).alias("request"), F.explode(kept).alias("v")
    ).withColumn("v", F.col("v").cast("double"))


@query("JN5_scores_and_classes", """SELECT coalesce(s.masterid, c.masterid) AS masterid, sampleyear, Metric, MetricValue, channel_engineering_class,
    CASE WHEN channel_engineering_class = 'NAT' THEN 'Natural' WHEN channel_engineering_class <> 'NAT' THEN 'Modified' END AS Class2
    FROM v_scores s FULL JOIN v_site c ON s.masterid = c.masterid""")
def jn5_scores(r):
    """Scores and classes, keeping the samples without class and the sites without sample."""
    return SC.score_sites(r.scores(), r.channel_class(), keep_unmatched=True).drop("longitude", "latitude", "COMID")


@query("UF3_function_of_two_columns", _ROOTS.format(names=["high"], values=[_LEVELS["high"]]))
def uf3(r):
    """A function of two columns with many results: native expressions, no Python per row."""
    return _event_roots(r, ["high"])
