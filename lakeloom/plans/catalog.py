"""The core queries, each with its SQL (run by DuckDB on the same tables).

Sums of money are sums of exact decimals on both sides, orders end in a unique column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import cents, discounted, dot, json_long, money, strip_tags
from lakeloom.operators import sequences
from lakeloom.operators.intervals import coverage, overlap_join
from lakeloom.operators.joins import asof_join, range_join
from lakeloom.operators.scan import places, quantile_of_each, value_ranks
from lakeloom.operators.skew import skew_join
from lakeloom.operators.sketches import DISTINCT, RANK, SHARE, DayStore, distinct_count, frequent, quantile
from lakeloom.operators.vectors import VectorIndex
from lakeloom.operators.windows import sessions, top_of_each
from lakeloom.sources import table
from lakeloom.sources.shared import fresh_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty,
       sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE AS sum_disc_price, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= ntz("1998-09-02"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        money(cents("l_quantity")).alias("sum_qty"), money(discounted()).alias("sum_disc_price"), F.count(F.lit(1)).alias("count_order")
    )


@query("""
SELECT n_name, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name""")
def local_supplier_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").where((F.col("o_orderdate") >= ntz("1996-01-01")) & (F.col("o_orderdate") < ntz("1998-01-01")))
    places = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    bought = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sold = bought.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return sold.groupBy("n_name").agg(money(discounted()).alias("revenue"))


@query("""
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1""")
def customers_without_late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= ntz("2000-01-01"))
    idle = table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), money(cents("c_acctbal")).alias("balance"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
WHERE place <= 3""")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_of_each(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("""
SELECT o_orderkey, o_totalprice - lag(o_totalprice) OVER w AS change, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("change"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("n3"))


@query("""
SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority,
       (grouping(o_orderstatus) * 2 + grouping(o_orderpriority))::BIGINT AS level, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.when(F.grouping(c) == 1, F.lit("all")).otherwise(F.col(c))
    counted = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return counted.agg(whole("o_orderstatus").alias("status"), whole("o_orderpriority").alias("priority"), F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n")).select("status", "priority", "level", "n")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS "view"
FROM events GROUP BY 1""")
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0)


@query("""
SELECT (json_extract_string(props, '$.k'))::BIGINT % 10 AS digit, count(*) AS n FROM events GROUP BY 1""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((json_long("props", "$.k") % 10).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p.event_id, coalesce(v.event_id, -1) AS view_id
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts
                   ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true""")
def last_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = rows.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof_join(rows.where("event_type = 'purchase'").drop("event_type"), views, ["user_id"], "ts", ["view_id"], "view_id", F.to_date("ts")).select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query("""
SELECT e.event_id, b.event_id AS error_id FROM events e JOIN events b
ON b.event_type = 'error' AND epoch(e.ts) >= epoch(b.ts) AND epoch(e.ts) < epoch(b.ts) + 30 WHERE e.event_type = 'purchase'""")
def purchases_after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    errors = rows.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("at").alias("from_at"), (F.col("at") + 30_000_000).alias("to_at"))
    found = range_join(rows.where("event_type = 'purchase'"), errors, F.col("at"), F.col("from_at"), F.col("to_at"), 30_000_000)
    return found.select("event_id", "error_id")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_time, max(ts) AS last_time, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 7200)


@query("""
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL""")
def six_hour_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), money(cents("value")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
SELECT p_brand, count(DISTINCT p_type) AS types, quantile_cont(p_retailprice, 0.5) AS median_price FROM part GROUP BY 1""")
def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    types = parts.groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"))
    return types.join(quantile_of_each(parts, ["p_brand"], "p_retailprice", 0.5, "median_price"), "p_brand")


@query("""
SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return low.subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("""
SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers
FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey""")
def nations_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    both = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    return both.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""
SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 0) AS spent
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1""")
def open_orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), money(cents("o_totalprice")).alias("spent"))
    joined = table(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query("""
SELECT o_orderpriority AS name, 'priority' AS kind FROM orders UNION SELECT l_returnflag, 'flag' FROM lineitem UNION SELECT c_mktsegment, 'segment' FROM customer""")
def labels_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = (("orders", "o_orderpriority", "priority"), ("lineitem", "l_returnflag", "flag"), ("customer", "c_mktsegment", "segment"))
    each = [table(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(k).alias("kind")).distinct() for t, c, k in some]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""
SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda status: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O"))


@query("""
SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9000""")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).exceptAll(rich)


@query("""
SELECT CASE WHEN grouping(r_name) = 1 THEN 'all' ELSE r_name END AS region, CASE WHEN grouping(n_name) = 1 THEN 'all' ELSE n_name END AS nation, count(*) AS n, max(c_acctbal) AS most
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def customers_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    placed = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = lambda c: F.when(F.grouping(c) == 1, F.lit("all")).otherwise(F.col(c))
    return placed.rollup("r_name", "n_name").agg(whole("r_name").alias("region"), whole("n_name").alias("nation"), F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("most")).select("region", "nation", "n", "most")


@query("""
SELECT l_returnflag, l_linestatus, l_discount, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_discount), ())""")
def lines_by_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status, discount = (F.col(c) for c in ("l_returnflag", "l_linestatus", "l_discount"))
    return table(spark, sf_dir, "lineitem").groupingSets([[flag, status], [discount], []], flag, status, discount).agg(flag, status, discount, F.count(F.lit(1)).alias("n")).select("l_returnflag", "l_linestatus", "l_discount", "n")


@query("""
SELECT p_partkey, (ntile(4) OVER w)::INT AS quarter, (rank() OVER (PARTITION BY p_brand ORDER BY p_size))::INT AS rank, (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size))::INT AS dense, percent_rank() OVER w AS share, cume_dist() OVER w AS below
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)""")
def part_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    ranked = value_ranks(places(parts, ["p_brand"], ["p_retailprice", "p_partkey"]), ["p_brand"], "p_size")
    place, total = F.col("place"), F.col("total")
    least, more = F.floor(total / 4), total % 4  # quarters of `least` rows, the first `more` of them of one row more
    quarter = F.when(place <= more * (least + 1), F.ceil(place / (least + 1))).otherwise(F.ceil((place - more) / least))
    share = F.when(total == 1, F.lit(0.0)).otherwise((place - 1) / (total - 1))
    return ranked.select("p_partkey", quarter.cast("int").alias("quarter"), F.col("rank").cast("int").alias("rank"), F.col("dense").cast("int").alias("dense"), share.alias("share"), (place / total).alias("below"))


@query("""
SELECT event_id, first_value(event_id) OVER w AS opened, lead(event_type, 1, 'none') OVER w AS then_type, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS hour_n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000, 0)
    return rows.select("event_id", F.first("event_id").over(w).alias("opened"), F.lead("event_type", 1, "none").over(w).alias("then_type"), F.count(F.lit(1)).over(hour).alias("hour_n"))


@query("""
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, isodow(o_orderdate)::INT AS weekday, count(*) AS n, sum(date_diff('day', o_orderdate, last_day(o_orderdate)::TIMESTAMP))::BIGINT AS days_left
FROM orders GROUP BY ALL""")
def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    parts = [F.date_trunc("month", day).cast("timestamp_ntz").alias("month"), F.year(day).alias("year"), F.quarter(day).alias("quarter"), (F.weekday(day) + 1).alias("weekday")]
    return table(spark, sf_dir, "orders").groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.sum(F.date_diff(F.last_day(day), F.to_date(day))).cast("long").alias("days_left"))


@query("""
SELECT upper(split_part(p_name, ' ', 1)) AS first_word, length(p_type) AS type_size, count(*) AS n, min(substr(p_brand, 7))  AS least, max(lpad(p_size::VARCHAR, 4, '0')) AS widest, count(*) FILTER (p_name LIKE '%widget') AS widgets
FROM part GROUP BY ALL""")
def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("first_word"), F.length("p_type").cast("long").alias("type_size")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.expr("substr(p_brand, 7)")).alias("least"), F.max(F.lpad(F.col("p_size").cast("string"), 4, "0")).alias("widest"), F.count_if(F.col("p_name").like("%widget")).alias("widgets")
    )


@query("""
SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderdate, o_orderkey) AS priorities, len(list(o_orderkey)) AS n, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '') AS statuses
FROM orders GROUP BY 1""")
def priorities_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_join(F.transform(ordered, lambda x: x["o_orderpriority"]), "|").alias("priorities"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("statuses")
    )


@query("""
SELECT label, dim::INT AS dim, count(*) AS n, round(avg(x), 6) AS mean FROM
(SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY ALL""")
def embedding_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""
SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, list_position(embedding, list_max(embedding))::INT AS peak, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings""")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(F.sqrt(dot(v, v)), 6).alias("norm"), F.array_position(v, F.array_max(v)).cast("int").alias("peak"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"))


@query("""
SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(url, '://', 1) AS scheme, count(*) AS n, count(*) FILTER (contains(url, 'utm_')) AS tracked, sum(length(html))::BIGINT AS size FROM pages GROUP BY ALL""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").contains("utm_")).alias("tracked"), F.sum(F.length("html")).alias("size")
    )


@query(r"""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS n_links,
       trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain
FROM pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit("<a href="), 0)).cast("long").alias("n_links"), strip_tags(html).alias("plain")
    )


@query("""
SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, string_agg(left(role, 1), '' ORDER BY turn) AS shape, max_by(role, turn) AS last_role, sum(length(text)) FILTER (role = 'assistant')::BIGINT AS answered
FROM conversations GROUP BY 1""")
def conversation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.countDistinct("role").alias("roles"),
        F.array_join(F.transform(turns, lambda x: F.left(x["role"], F.lit(1))), "").alias("shape"),
        F.max_by("role", "turn").alias("last_role"),
        F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("answered"),
    )


@query("""
SELECT a.conv_id, a.turn, b.turn AS answer_turn, length(b.text) AS size FROM conversations a ASOF JOIN (SELECT * FROM conversations WHERE role = 'assistant') b
ON a.conv_id = b.conv_id AND a.turn >= b.turn WHERE a.role = 'user'""")
def answers_before_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn")
    answers = rows.where("role = 'assistant'").select("conv_id", "turn", F.col("turn").alias("answer_turn"), F.length("text").cast("long").alias("size"))
    return asof_join(asked, answers, ["conv_id"], "turn", ["answer_turn", "size"], "answer_turn").where("answer_turn is not null")


@query("""
SELECT e.event_id, count(*) AS n FROM events e JOIN (SELECT epoch_us(ts) AS s, epoch_us(ts) + (value * 1000000 * CASE WHEN event_id % 50 = 0 THEN 500 ELSE 1 END)::BIGINT AS t FROM events WHERE event_type = 'signup') r
ON epoch_us(e.ts) >= r.s AND epoch_us(e.ts) < r.t WHERE e.event_type = 'purchase' GROUP BY 1""")
def purchases_in_open_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    long = F.when(F.col("event_id") % 50 == 0, F.lit(500)).otherwise(F.lit(1))
    offers = rows.where("event_type = 'signup'").select(F.col("at").alias("from_at"), (F.col("at") + F.round(F.col("value") * 1000000 * long).cast("long")).alias("to_at"))
    found = range_join(rows.where("event_type = 'purchase'").select("event_id", "at"), offers, F.col("at"), F.col("from_at"), F.col("to_at"), 300_000_000)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag, corr(l_quantity, l_extendedprice) > 0.5 AS linked, round(stddev_samp(l_quantity), 6) AS spread, round(avg(l_discount), 6) AS mean, count(DISTINCT l_suppkey) AS suppliers, bool_or(l_tax > 0.07) AS taxed
FROM lineitem GROUP BY 1""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        (F.corr("l_quantity", "l_extendedprice") > 0.5).alias("linked"), F.round(F.stddev_samp("l_quantity"), 6).alias("spread"), F.round(F.avg("l_discount"), 6).alias("mean"), F.countDistinct("l_suppkey").alias("suppliers"), F.bool_or(F.col("l_tax") > 0.07).alias("taxed")
    )


@query("""
SELECT p_partkey, what, amount FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (amount FOR what IN (size, price))""")
def part_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "what", "amount")


@query("""
SELECT n_name, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal > (SELECT avg(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = n_nationkey)""")
def suppliers_above_their_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    mean = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("mean"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(mean, F.col("s_nationkey") == F.col("k")).where("s_acctbal > mean").select("n_name", "s_name", "s_acctbal")


@query("""
SELECT event_id, value::DECIMAL(18,2) * n > total AS above FROM events
JOIN (SELECT event_type, count(*) AS n, sum(value::DECIMAL(18,2)) AS total FROM events GROUP BY 1) USING (event_type)""")
def events_against_their_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", cents("value").alias("value"))
    types = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    keys = types.select("event_type", F.col("n").alias("_rows"))
    return skew_join(events, types, ["event_type"], keys=keys).select("event_id", (F.col("value") * F.col("n") > F.col("total")).alias("above"))


#: An order is open from its day to the last day on which a line of it is shipped.
OPEN = """SELECT o_orderkey, o_custkey, o_orderpriority, epoch_us(o_orderdate) AS opened, epoch_us(max(l_shipdate)) AS closed
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, o_orderdate"""


def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    orders = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority", micros("o_orderdate").alias("opened"), micros("last").alias("closed"))


@query(f"""
WITH o AS ({OPEN})
SELECT a.o_orderkey AS first_order, b.o_orderkey AS second_order, least(a.closed, b.closed) - greatest(a.opened, b.opened) AS together
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.opened < b.closed AND b.opened < a.closed
WHERE a.opened < a.closed AND b.opened < b.closed""")
def orders_open_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = open_orders(spark, sf_dir).drop("o_orderpriority")
    second = first.toDF("second_order", "o_custkey", "from_", "until")
    day = 86_400_000_000
    met = overlap_join(first, second, (F.col("opened"), F.col("closed")), (F.col("from_"), F.col("until")), 30 * day, ["o_custkey"])
    shared = F.least("closed", "until") - F.greatest("opened", "from_")
    return met.where("o_orderkey < second_order").select(F.col("o_orderkey").alias("first_order"), "second_order", shared.alias("together"))


@query(f"""
WITH o AS ({OPEN}), e AS (
  SELECT o_orderpriority, opened AS "at", 1 AS n FROM o WHERE opened < closed UNION ALL SELECT o_orderpriority, closed, -1 FROM o WHERE opened < closed),
s AS (SELECT o_orderpriority, "at", sum(n) AS n FROM e GROUP BY 1, 2)
SELECT o_orderpriority, "at", (sum(n) OVER (PARTITION BY o_orderpriority ORDER BY "at"))::BIGINT AS "open" FROM s""")
def open_orders_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(open_orders(spark, sf_dir), ["o_orderpriority"], "opened", "closed")


#: The truth beside what the day sketches say of each week: whether every estimate lies within its bound.
@query("""
SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS medians_near, true AS most_near FROM events GROUP BY 1""")
def weeks_from_day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "user_id", "value", "event_type")
    store = DayStore(spark, fresh_path(spark, "day-sketches"))
    view = F.col("event_type").eqNullSafe("view")
    store.add(events.where(~view), "others", F.col("ts"), "user_id", "value", "user_id")
    store.add(events.where(view), "views", F.col("ts"), "user_id", "value", "user_id")
    week = lambda c: F.to_date(F.date_trunc("week", F.col(c).cast("timestamp")))
    said = store.merged([week("day").alias("week")]).select("week", distinct_count().alias("about"), quantile(0.5).alias("median"), F.transform(frequent(5), lambda x: F.struct(x["item"].alias("user_id"), x["count"].alias("said"))).alias("most"))
    counted = events.groupBy(week("ts").alias("week"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    users = counted.groupBy("week").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"))
    mean = lambda c: F.avg(c.cast("double"))
    # a value that many rows share takes up all ranks from below to upto
    ranks = events.select(week("ts").alias("week"), "value").join(F.broadcast(said.select("week", "median")), "week").groupBy("week").agg(mean(F.col("value") < F.col("median")).alias("below"), mean(F.col("value") <= F.col("median")).alias("upto"))
    # where no user is frequent none is said, or fewer than 5: who isn't said must be as rare as that means
    most = said.select("week", F.explode("most").alias("m")).select("week", "m.user_id", "m.said").where("user_id is not null")  # nulls are counted as an item too
    least = said.select("week", F.when(F.size("most") == 5, F.array_min(F.transform("most", lambda x: x["said"]))).otherwise(0).alias("least"))
    unsaid = F.when(F.col("said").isNull(), F.col("n"))
    off = counted.where("user_id is not null").join(most, ["week", "user_id"], "full").groupBy("week").agg(F.max(F.abs(F.col("said") - F.coalesce("n", F.lit(0)))).alias("off"), F.max(unsaid).alias("unsaid"))
    every = users.join(said, "week").join(ranks, "week").join(off.join(F.broadcast(least), "week"), "week", "left")
    bound, none, rank = SHARE * F.col("n"), F.lit(0), RANK + 1 / F.col("n")
    return every.select(
        "week",
        "n",
        "users",
        (F.abs(F.col("about") - F.col("users")) <= F.ceil(DISTINCT * F.col("users"))).alias("users_near"),
        (F.col("median").isNull() | ((F.col("below") <= 0.5 + rank) & (F.col("upto") >= 0.5 - rank))).alias("medians_near"),
        ((F.coalesce("off", none) <= bound) & (F.coalesce("unsaid", none) <= F.greatest(F.coalesce("least", none), 2 * bound))).alias("most_near"),
    )


@query("""
WITH e AS (SELECT *, count(*) FILTER (event_type IN ('error', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part
  FROM events WHERE event_type IN ('view', 'error', 'purchase')),
p AS (SELECT user_id, coalesce(part, 0) AS part, count(*) FILTER (event_type = 'view') AS views FROM e GROUP BY ALL)
SELECT e.user_id, ts, event_id FROM e JOIN p ON p.user_id = e.user_id AND p.part = coalesce(e.part, 0) WHERE event_type = 'purchase' AND views >= 2""")
def purchases_after_two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return sequences.matches(events, ["user_id"], ["ts", "event_id"], "event_type", [{"view"}, {"view"}, {"purchase"}], {"error", "purchase"})


def near_vectors(spark: SparkSession, sf_dir: str, recall: float | None) -> DataFrame:
    """The 10 nearest of all embeddings for those whose id is divisible by 20."""
    rows, at = table(spark, sf_dir, "embeddings"), fresh_path(spark, "vectors")
    index = VectorIndex.build(rows, f"{at}/index", "vec_id", "embedding")
    probes = None if recall is None else index.probes_for(recall, rows, "vec_id", "embedding", 10, f"{at}/probes")
    found = index.search(rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, f"{at}/search", probes)
    return found.select("query_id", "near_id", "place", F.round("distance", 6).alias("distance"))


@query("""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS near_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, near_id) AS place FROM p)
SELECT query_id, near_id, place::INT AS place, round(d, 6) AS distance FROM r WHERE place <= 10""")
def nearest_vectors_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, sf_dir, None)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the exact query, but from as many lists as a measured recall of 0.95 needs. No SQL: tests hold it against the exact one."""
    return near_vectors(spark, sf_dir, 0.95)


QUERIES["nearest_vectors"] = nearest_vectors
