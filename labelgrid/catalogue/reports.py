"""Relational reports: filters, joins, top-k, pivots, unions, path and text parsing."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as rel
from ..plans import experiments
from ..registry import query, r6, table
from ..sources import tables as src


@query("""SELECT DISTINCT o_orderpriority, round(o_totalprice / 100000, 0) AS bucket FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1996-01-01'""")
def f01_f02_f07_a07_filtered_distinct(spark, d):
    o = table(spark, d, "orders").where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW") & (F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    )
    return o.select("o_orderpriority", F.round(F.col("o_totalprice") / 100000, 0).alias("bucket")).dropDuplicates()


_POSE = """SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS lat,
CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS alt FROM events"""


def poses(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("lat"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("alt"),
    )


@query(f"""WITH p AS ({_POSE}), q AS (SELECT CASE WHEN lat IS NULL OR isnan(lat) THEN 'lat' WHEN alt IS NULL OR isnan(alt) THEN 'alt' END AS reason FROM p)
SELECT coalesce(reason, 'usable') AS reason, count(*) AS n FROM q GROUP BY 1""")
def f06_unusable_poses(spark, d):
    reason = rel.usable_pose({"lat": ["lat"], "alt": ["alt"]})
    return poses(spark, d).groupBy(F.coalesce(reason, F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS ({_POSE}) SELECT user_id, round(avg(CASE WHEN isnan(lat) THEN NULL ELSE lat END), 6) AS mean_lat, round(max(alt), 6) AS top_alt FROM p GROUP BY user_id""")
def r08_x11_nan_to_null(spark, d):
    return rel.nan_to_null(poses(spark, d)).groupBy("user_id").agg(r6(F.avg("lat")).alias("mean_lat"), r6(F.max("alt")).alias("top_alt"))


@query("""WITH f AS (SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT c.c_custkey AS user_id, c.c_nationkey, f.event_id, f.value FROM customer c JOIN f ON c.c_custkey = f.user_id""")
def j01_first_match_join(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    right = table(spark, d, "events").select("user_id", "event_id", "value", "ts")
    return rel.first_match(left, right, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "c_nationkey", "event_id", "value")


@query("""WITH e AS (SELECT event_id, CASE WHEN user_id % 5 > 0 THEN user_id END AS user_id, ts, value FROM events)
SELECT event_id, user_id, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS latched FROM e""")
def w02_latched_first_value(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("user_id"), "ts", "value")
    return rel.latched(e, ["user_id"], "value", ["ts", "event_id"], "latched").select("event_id", "user_id", "latched")


@query("""SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS rank FROM events QUALIFY rank <= 20""")
def l02_l03_top_k(spark, d):
    return rel.top_k(table(spark, d, "events"), ["event_type"], [F.desc_nulls_last("value"), F.col("event_id")], 20).select("event_type", "event_id", "rank")


@query("""SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 20) GROUP BY event_type""")
def a26_box_plot_of_best(spark, d):
    best = rel.top_k(table(spark, d, "events"), ["event_type"], [F.desc_nulls_last("value"), F.col("event_id")], 20)
    return best.groupBy("event_type").agg(*[r6(F.percentile("value", p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])


@query("""SELECT o.o_orderkey, replace(n.n_name, ' ', '_') AS place, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def j03_aligned_join(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "o_orderkey", F.replace("n_name", F.lit(" "), F.lit("_")).alias("place"), "r_name"
    )


@query("""SELECT n.n_name, r.r_name AS partner FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""")
def j02_f14_partner_or_error(spark, d):
    n = table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("k"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("partner"))
    return rel.aligned_or_error(n, r, ["k"], "partner").select("n_name", "partner")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def j04_f04_listed_only(spark, d):
    allowed = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.listed_only(table(spark, d, "customer").select("c_custkey"), allowed, ["c_custkey"])


@query("""SELECT o_orderkey, o_orderstatus AS d3 FROM orders UNION ALL
SELECT o_orderkey, 'dsm' AS d3 FROM orders WHERE o_orderstatus = 'F'""")
def f18_duplicated_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("d3"))
    return rel.duplicated(o, F.col("d3") == "F", "d3", "dsm")


_JITTER = """j AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS INT) AS k, CAST(o_orderkey % 30 AS DOUBLE) AS v FROM orders),
p AS (SELECT o_orderkey, CASE WHEN k = 0 THEN v ELSE 0 END AS gps, CASE WHEN k = 1 THEN v ELSE 0 END AS alt, CASE WHEN k = 2 OR k = 3 AND v = 5 THEN v ELSE 0 END AS imu FROM j),
t AS (SELECT o_orderkey, CASE WHEN imu <> 0 THEN 'imu' WHEN alt <> 0 THEN 'altitude' WHEN gps <> 0 THEN 'gps' ELSE 'imu' END AS jitter_type, gps + alt + imu AS jitter FROM p)"""


@query(f"WITH {_JITTER} SELECT * FROM t WHERE NOT (jitter_type IN ('gps', 'altitude') AND jitter > 10)")
def f03_f19_s02_jitter(spark, d):
    k, v = (F.col("o_orderkey") % 4).cast("int"), (F.col("o_orderkey") % 30).cast("double")
    at = lambda c: F.when(c, v).otherwise(F.lit(0.0)).cast("string")
    name = F.concat_ws("_", at(k == 0), at(k == 1), at((k == 2) | ((k == 3) & (v == 5))))
    rows = table(spark, d, "orders").select("o_orderkey", text.jitter(name).alias("j")).select("o_orderkey", "j.jitter_type", "j.jitter")
    return rel.without_wide_jitter(rows)


@query("""SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[-1] AS leaf, replace(string_split(url, '/')[-2], 'en', 'pair') AS lang,
regexp_replace(url, '[^0-9<.-]+', '', 'g') AS digits, lpad(CAST(page_id AS VARCHAR), CAST(greatest(5, length(CAST(page_id AS VARCHAR))) AS INT), '0') AS padded,
contains(url, 'page=') AS paged FROM pages""")
def x01_x02_x06_x07_path_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", text.segment(url, 3).alias("host"), text.segment(url, -1).alias("leaf"), F.replace(text.segment(url, -2), F.lit("en"), F.lit("pair")).alias("lang"),
        text.number_in(url).alias("digits"), text.padded_number(F.col("page_id"), 5).alias("padded"), url.contains("page=").alias("paged"),
    )


@query("""SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS "F", sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::DOUBLE AS "O",
sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::DOUBLE AS "P" FROM orders GROUP BY 1""")
def a27_pivot(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return rel.pivoted(counts, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "n").na.fill(0.0)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM orders")
def a21_counts_with_total(spark, d):
    return rel.counts_with_total(table(spark, d, "orders"), "o_orderpriority")


@query("""SELECT o_orderpriority, CAST(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS INT) AS place, count(*) AS n FROM orders GROUP BY 1, 2""")
def l01_l05_category_order(spark, d):
    order = ["3-MEDIUM", "1-URGENT"]
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("o_orderpriority")).cast("int")
    return rel.in_category_order(counts, "o_orderpriority", order).select("o_orderpriority", F.when(place == 0, 3).otherwise(place).alias("place"), "n")


@query("""SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def u01_union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL""")
def x21_json_property(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT label_set, refine, res, CAST(printf('%dm', CAST(res AS INT)) AS VARCHAR) AS res_label FROM (SELECT unnest(['common', 'more_common', 'most_common']) AS label_set),
(SELECT unnest(['none', 'crf_planet']) AS refine), (SELECT unnest([1.0, 5.0, 10.0])::DOUBLE AS res)""")
def j10_x08_experiment_grid(spark, d):
    g = experiments.grid(spark, {"label_set": ["common", "more_common", "most_common"], "refine": ["none", "crf_planet"], "res": [1.0, 5.0, 10.0]})
    return g.select("*", text.resolution_label(F.col("res")).alias("res_label"))


@query("""WITH t AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS w)
SELECT w, round(avg(abs(l_discount * w - l_tax)), 6) AS loss FROM lineitem, t GROUP BY w""")
def m06_a20_grid_search(spark, d):
    trials = experiments.grid(spark, {"w": [1, 2, 3, 4, 5]})
    return experiments.evaluated(trials, table(spark, d, "lineitem").select("l_discount", "l_tax"), F.abs(F.col("l_discount") * F.col("w") - F.col("l_tax")), ["w"]).withColumn("loss", r6("loss"))


_UNIT = lambda *parts: "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query(f"""WITH t AS (SELECT trial, 0.1::DOUBLE + {_UNIT("7", "trial", "'w'")} * (50.0 - 0.1)::DOUBLE AS w, CAST(1 + floor({_UNIT("7", "trial", "'theta'")} * 10) AS INT) AS theta FROM range(20) r(trial))
SELECT trial, round(w, 6) AS w, theta, round(avg(abs(l_discount * w - l_tax * theta)), 6) AS loss FROM t, lineitem GROUP BY trial, w, theta ORDER BY avg(abs(l_discount * w - l_tax * theta)), trial LIMIT 5""")
def m06_random_search(spark, d):
    """The five best of 20 drawn trials."""
    trials = experiments.random_search(spark, 20, {"w": (0.1, 50.0, "float"), "theta": (1, 10, "int")}, seed=7)
    loss = F.abs(F.col("l_discount") * F.col("w") - F.col("l_tax") * F.col("theta"))
    found = experiments.evaluated(trials, table(spark, d, "lineitem").select("l_discount", "l_tax"), loss, ["trial", "w", "theta"])
    return found.orderBy("loss", "trial").limit(5).select("trial", r6("w").alias("w"), "theta", r6("loss").alias("loss"))


@query("""WITH e AS (SELECT user_id AS file, event_id AS n, event_type AS mark, CAST(floor(value * 100) AS BIGINT) AS v FROM events)
SELECT file, CAST(arg_max(v, n) FILTER (WHERE mark = 'click') AS DOUBLE) AS click, CAST(arg_max(v, n) FILTER (WHERE mark = 'view') AS DOUBLE) AS "view" FROM e GROUP BY file""")
def s22_log_lines(spark, d):
    line = F.concat(F.col("event_type"), F.lit(" metric: "), F.floor(F.col("value") * 100).cast("string"))
    logs = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("n"), line.alias("line"))
    return src.parse_logs(logs, {"click": "click metric:", "view": "view metric:"})


@query(r"""SELECT concat(n_name, ' & ', n_regionkey, ' \\') AS latex FROM nation""")
def s23_latex_rows(spark, d):
    return src.latex_rows(table(spark, d, "nation"), ["n_name", "n_regionkey"])


@query("""SELECT p_partkey, o_orderkey FROM (SELECT p_partkey, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part) p
JOIN (SELECT o_orderkey, o_totalprice / 500 AS x0, CAST(o_orderkey % 50 AS DOUBLE) AS y0 FROM orders) b
ON x BETWEEN x0 AND x0 + 40 AND y BETWEEN y0 AND y0 + 3""")
def j08_u03_points_in_boxes(spark, d):
    points = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    x0, y0 = F.col("o_totalprice") / 500, (F.col("o_orderkey") % 50).cast("double")
    boxes = table(spark, d, "orders").select("o_orderkey", x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 3).alias("y1"))
    return rel.binned_box_join(points, boxes, 40.0).select("p_partkey", "o_orderkey")


@query("""SELECT l_returnflag, min(l_shipdate) AS first_day, max(l_extendedprice) AS x0, max(l_tax) AS y0, min(l_extendedprice + 200000) AS x1, min(l_tax + l_quantity) AS y1 FROM lineitem GROUP BY l_returnflag""")
def a25_bounds(spark, d):
    """What all boxes of a flag have in common."""
    l = table(spark, d, "lineitem")  # noqa: E741
    boxes = l.select(
        "l_returnflag", F.col("l_extendedprice").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_extendedprice") + 200000).alias("x1"), (F.col("l_tax") + F.col("l_quantity")).alias("y1")
    )
    return rel.intersection_bounds(boxes, ["l_returnflag"]).join(l.groupBy("l_returnflag").agg(F.min("l_shipdate").alias("first_day")), "l_returnflag")
