"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement re-derives its stand-in tables from the driver tables with
plain SQL CTEs and follows the source analysis as SQL, so it shares no code
path with the Spark plans. Decimal rounding is written as
``ROUND(CAST(x AS DECIMAL(38,9)), n)``, the same half-up rule the plans use.
"""

from __future__ import annotations


def R(expr: str, n: int) -> str:
    """Half-up rounding of a double expression, as DOUBLE."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,9)), {n}) AS DOUBLE)"


# ----------------------------------------------------------- stand-in CTEs
CTE = {
    "f_users": """f_users AS (
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_nationkey END AS race_id,
               CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS payer
        FROM customer)""",
    "f_race": """f_race AS (SELECT n_nationkey AS race_id, n_name AS race FROM nation)""",
    "f_events": """f_events AS (
        SELECT l.l_orderkey * 10 + l.l_linenumber AS transaction_id, o.o_custkey AS id,
               l.l_partkey AS item_code,
               CASE WHEN l.l_orderkey % 100 = 0 THEN 0.0 ELSE l.l_extendedprice END AS amount
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "f_items": """f_items AS (SELECT p_partkey AS item_code, p_name AS game_items FROM part)""",
    "flats": """flats AS (
        SELECT l.l_orderkey * 10 + l.l_linenumber AS id, n.n_name AS city, o.o_orderstatus AS type,
               l.l_quantity AS total_area,
               CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_linenumber END AS rooms,
               CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE l.l_linenumber % 3 END AS balcony,
               2.4 + l.l_discount * 10 AS ceiling_height,
               5 + l.l_suppkey % 20 AS floors_total,
               1 + l.l_partkey % 10 AS floor,
               CASE WHEN l.l_partkey % 9 = 0 THEN 1 ELSE 0 END AS open_plan,
               l.l_suppkey % 4 AS parks_around3000,
               l.l_partkey % 3 AS ponds_around3000,
               l.l_quantity * 0.6 AS living_area,
               CASE WHEN l.l_tax = 0 THEN 1 ELSE 0 END AS is_apartment,
               l.l_quantity * 0.2 AS kitchen_area,
               l.l_extendedprice / 10 AS airports_nearest,
               l.l_extendedprice AS last_price,
               o.o_orderdate AS first_day_exposition,
               CASE WHEN date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) >= 0
                    THEN date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) END
                 AS days_exposition
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"


SQL: dict[str, str] = {}

# --------------------------------------------------------------- fantasy game
SQL["payer_share"] = with_("f_users") + f"""
, player AS (SELECT id, bool_or(payer = 1) AS pays FROM f_users GROUP BY id)
SELECT count(*) AS total_users, count_if(pays)::BIGINT AS total_paying_users,
       {R('avg(pays::INT)', 5)} AS share_paying_users
FROM player"""

SQL["payer_share_by_group"] = with_("f_users", "f_race") + f"""
, tally AS (SELECT race_id, payer, count(id)::DOUBLE AS n FROM f_users GROUP BY ALL)
SELECT race, max(n) FILTER (payer = 1) AS paying_users, sum(n)::BIGINT AS total_users,
       {R('max(n) FILTER (payer = 1) / sum(n)', 5)} AS share_paying_users_in_race_context
FROM tally JOIN f_race USING (race_id) GROUP BY race"""

SQL["payer_share_by_group_window"] = with_("f_users", "f_race") + f"""
SELECT r.race, CAST(NULLIF(COUNT(u.id) FILTER (WHERE u.payer = 1), 0) AS DOUBLE) AS paying_users,
       COUNT(u.id) AS total_users,
       {R('NULLIF(COUNT(u.id) FILTER (WHERE u.payer = 1), 0)::DOUBLE / COUNT(u.id)', 5)}
         AS share_paying_users_in_race_context
FROM f_users u JOIN f_race r ON u.race_id = r.race_id GROUP BY r.race"""

SQL["purchase_stats"] = with_("f_events") + f"""
SELECT COUNT(e.transaction_id) AS purchase_count,
       CAST(SUM(CAST(e.amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
       MIN(e.amount) AS min_price, MAX(e.amount) AS max_price,
       {R('AVG(e.amount)', 2)} AS avg_price,
       {R('PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY e.amount)', 2)} AS median,
       {R('STDDEV_SAMP(e.amount)', 2)} AS deviation
FROM f_events e"""

SQL["zero_amount_share"] = with_("f_events") + f"""
, price AS (SELECT amount = 0 AS is_free, count(*) AS n FROM f_events GROUP BY is_free)
SELECT coalesce(sum(n) FILTER (is_free), 0)::BIGINT AS free_purchases_count, sum(n)::BIGINT AS total_purchases_count,
       {R('coalesce(sum(n) FILTER (is_free), 0)::DOUBLE / sum(n)', 5)} AS share_of_free_purchases
FROM price"""

SQL["item_popularity"] = with_("f_events", "f_items") + f"""
, sold AS (
  SELECT item_code, grouping(item_code) AS is_total, count(DISTINCT transaction_id) AS sales, count(DISTINCT id) AS buyers
  FROM f_events WHERE amount > 0 GROUP BY GROUPING SETS ((item_code), ()))
SELECT DISTINCT game_items, s.sales AS total_sales, {R('s.sales / t.sales::DOUBLE', 5)} AS share_of_items_sale,
       {R('s.buyers / t.buyers::DOUBLE', 5)} AS share_of_players
FROM sold s JOIN sold t ON s.is_total = 0 AND t.is_total = 1 JOIN f_items i ON i.item_code = s.item_code"""

SQL["group_activity"] = with_("f_users", "f_race", "f_events") + f"""
, purse AS (
  SELECT id, count(*) AS bought, sum(CAST(amount AS DECIMAL(18,2))) AS spent FROM f_events WHERE amount > 0 GROUP BY id),
player AS (
  SELECT (SELECT race FROM f_race r WHERE r.race_id = u.race_id) AS race, u.payer = 1 AS pays, bought, spent
  FROM f_users u LEFT JOIN purse USING (id)),
-- players without a known race are counted, but have no purchase metrics
fact AS (
  SELECT race, count(*) AS players,
         nullif(count(bought) FILTER (race IS NOT NULL), 0)::DOUBLE AS buyers,
         nullif(count(bought) FILTER (race IS NOT NULL AND pays), 0)::DOUBLE AS payers,
         sum(bought) FILTER (race IS NOT NULL) AS deals, sum(spent) FILTER (race IS NOT NULL) AS money
  FROM player GROUP BY race)
SELECT race, players AS total_users, buyers AS buying_users, payers AS paying_users,
       {R('buyers / players', 2)} AS share_buying_users, {R('payers / buyers', 2)} AS share_paying_users,
       {R('deals / buyers', 2)} AS avg_purchase_count, {R('money / deals', 2)} AS avg_purchase_amount,
       {R('money / buyers', 2)} AS avg_amount_all_purchases
FROM fact"""

# ---------------------------------------------------------------- real estate
# Listings below the 99th percentile of each measure (ceilings also above the
# 1st; unknown values pass), in cities, first shown in 1996 to 1999.
_LIMITS = """
, bound AS (
  SELECT quantile_cont(total_area, 0.99) AS area_max, quantile_disc(rooms, 0.99) AS rooms_max,
         quantile_disc(balcony, 0.99) AS balcony_max, quantile_cont(ceiling_height, [0.01, 0.99]) AS ceiling FROM flats),
city_ads AS (
  SELECT flats.*, last_price / total_area AS metre_price FROM flats CROSS JOIN bound
  WHERE type = 'F' AND year(first_day_exposition) IN (1996, 1997, 1998, 1999) AND total_area < area_max
    AND coalesce(rooms < rooms_max, true) AND coalesce(balcony < balcony_max, true)
    AND coalesce(ceiling_height > ceiling[1] AND ceiling_height < ceiling[2], true))"""

_MEDIANS = ",\n       ".join(f"quantile_disc({c}, 0.5)::BIGINT AS median_{c}" for c in (
    "rooms", "balcony", "floors_total", "floor", "parks_around3000", "ponds_around3000"))

SQL["listing_activity"] = with_("flats") + _LIMITS + f"""
, band(sort_order, category_ads, shortest, longest) AS (
  VALUES (1, '1-30 days', 0, 30), (2, '31-90 days', 31, 90), (3, '91-180 days', 91, 180),
         (4, '181+ days', 181, 1000000000), (5, 'active', -1, -1)),
ad AS (
  SELECT city_ads.*, band.*, if(city = 'NATION_1', city, 'other_cities') AS area_name
  FROM city_ads JOIN band ON coalesce(days_exposition, -1) BETWEEN shortest AND longest),
area AS (SELECT area_name, count(*)::DOUBLE AS area_ads FROM ad GROUP BY area_name)
SELECT area_name, category_ads, sort_order, count(*) AS ads_count, {R('count(*) / any_value(area_ads)', 2)} AS ads_share,
       {R('avg(metre_price)', 2)} AS avg_price_for_metre, {R('avg(total_area)', 2)} AS avg_total_area,
       {_MEDIANS},
       {R('avg(ceiling_height)', 2)} AS avg_ceiling_height, {R('avg(living_area)', 2)} AS avg_living_area,
       {R('avg(kitchen_area)', 2)} AS avg_kitchen_area, {R('avg(airports_nearest) / 1000', 2)} AS avg_airports_nearest,
       {R('avg((open_plan = 1)::INT)', 2)} AS open_plan_share, {R('avg((is_apartment = 1)::INT)', 2)} AS apartment_share
FROM ad JOIN area USING (area_name) GROUP BY area_name, category_ads, sort_order"""

# One row per listing and happening (publication, removal), summed by month,
# then the two happenings of a month side by side.
SQL["listing_seasonality"] = with_("flats") + _LIMITS + f"""
, happening AS (
  SELECT 'published' AS what, month(first_day_exposition) AS m, total_area, {R('metre_price', 2)} AS metre_price FROM city_ads
  UNION ALL
  SELECT 'removed', month(first_day_exposition + to_days(days_exposition::INTEGER)), total_area, {R('metre_price', 2)}
  FROM city_ads WHERE days_exposition IS NOT NULL),
monthly AS (
  SELECT what, m, count(*)::DOUBLE AS ads, {R('avg(metre_price)', 2)} AS price, {R('avg(total_area)', 2)} AS size
  FROM happening GROUP BY what, m),
ranked AS (
  SELECT a.*, {R('ads / (SELECT sum(ads) FROM monthly x WHERE x.what = a.what)', 2)} AS share,
         1 + (SELECT count(*) FROM monthly x WHERE x.what = a.what AND x.ads > a.ads)::DOUBLE AS place
  FROM monthly a),
side AS (
  SELECT m, """ + ", ".join(f"max({c}) FILTER (what = '{w}') AS {w}_{c}" for w in ("published", "removed") for c in (
    "m", "ads", "share", "place", "price", "size")) + """
  FROM ranked GROUP BY m)
SELECT m::DOUBLE AS month, published_m::DOUBLE AS publish_month, removed_m::DOUBLE AS removal_month,
       monthname(make_date(2023, m::INTEGER, 1)) AS month_name,
       ['winter', 'spring', 'summer', 'autumn'][(m % 12) // 3 + 1] AS season_name,
       published_ads, published_share AS share_of_published_ads, published_place AS published_rank,
       removed_ads, removed_share AS share_of_removed_ads, removed_place AS removed_rank,
       published_price AS published_avg_price_for_metre, removed_price AS removed_avg_price_for_metre,
       published_size AS published_avg_total_area, removed_size AS removed_avg_total_area
FROM side"""

SQL["listings_monitor"] = with_("flats") + f"""
SELECT CASE WHEN month(first_day_exposition) IN (12, 1, 2) THEN 'winter'
            WHEN month(first_day_exposition) IN (3, 4, 5) THEN 'spring'
            WHEN month(first_day_exposition) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season_name,
       CAST(rooms AS DOUBLE) AS rooms, COUNT(id) AS listings,
       COUNT(*) FILTER (WHERE days_exposition IS NULL) AS active_listings,
       {R('AVG(last_price)', 2)} AS avg_price,
       {R('AVG(last_price / total_area)', 2)} AS avg_price_for_metre
FROM flats GROUP BY ALL"""

# ---------------------------------------------------------------- ticket sales
CTE["t_orders"] = """t_orders AS (
    SELECT l.l_orderkey * 10 + l.l_linenumber AS order_id, o.o_custkey AS user_id,
           CAST(l.l_shipdate AS DATE) AS created_dt_msk, l.l_shipdate AS created_ts_msk,
           l.l_partkey AS event_id, CAST((l.l_partkey % 5) * 4 AS INTEGER) AS age_limit,
           CASE WHEN o.o_orderstatus = 'P' THEN 'kzt' ELSE 'rub' END AS currency_code,
           CASE WHEN l.l_suppkey % 4 = 0 THEN 'desktop' ELSE 'mobile' END AS device_type_canonical,
           l.l_extendedprice / 100 AS revenue,
           'partner_' || CAST(l.l_suppkey % 12 AS VARCHAR) AS service_name,
           CAST(l.l_quantity AS INTEGER) % 6 + 1 AS tickets_count,
           l.l_extendedprice / 100 * (1 + l.l_tax) AS total,
           p.p_name AS event_type_description, p.p_type AS event_type_main,
           p.p_brand AS region_name, CAST(p.p_size AS BIGINT) AS city_id
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""
CTE["t_rates"] = """t_rates AS (
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS data,
           CAST(19.0 + (day(o_orderdate) % 7) * 0.25 AS DOUBLE) AS curs
    FROM orders)"""
CTE["t_clean"] = """t_capped AS (
    SELECT t.* FROM t_orders t
    JOIN (SELECT currency_code, quantile_cont(revenue, 0.99) AS cap FROM t_orders
          WHERE currency_code IN ('rub', 'kzt') GROUP BY currency_code) c
      ON t.currency_code = c.currency_code
    WHERE t.revenue <= c.cap),
t_dedup AS (
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (
          PARTITION BY user_id, event_id, created_ts_msk, tickets_count, revenue, currency_code,
                       event_type_description, event_type_main
          ORDER BY order_id, created_dt_msk, age_limit, device_type_canonical, service_name, total,
                   region_name, city_id) AS rn
      FROM t_capped) WHERE rn = 1),
t_feat AS (
    SELECT d.*, r.curs,
           CASE WHEN d.currency_code = 'rub' THEN d.revenue ELSE d.revenue * r.curs / 100 END AS revenue_rub
    FROM t_dedup d LEFT JOIN t_rates r ON d.created_dt_msk = r.data),
t_clean AS (
    SELECT *, revenue_rub / tickets_count AS one_ticket_revenue_rub,
           month(created_dt_msk) AS month,
           CASE WHEN month(created_dt_msk) IN (12, 1, 2) THEN 'winter'
                WHEN month(created_dt_msk) IN (3, 4, 5) THEN 'spring'
                WHEN month(created_dt_msk) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
           date_diff('day', CAST(lag(created_ts_msk) OVER (PARTITION BY user_id ORDER BY created_ts_msk, order_id, event_id, tickets_count, revenue, event_type_description) AS DATE),
                     CAST(created_ts_msk AS DATE)) AS days_since_prev
    FROM t_feat)"""

_T = with_("t_orders", "t_rates", "t_clean")

SQL["revenue_caps"] = with_("t_orders") + f"""
, caps AS (SELECT currency_code, quantile_cont(revenue, 0.99) AS cap FROM t_orders
           WHERE currency_code IN ('rub', 'kzt') GROUP BY currency_code)
SELECT t.currency_code, {R('c.cap', 2)} AS cap, COUNT(*) AS orders,
       COUNT(*) FILTER (WHERE t.revenue <= c.cap) AS kept, COUNT(*) FILTER (WHERE t.revenue > c.cap) AS cut
FROM t_orders t JOIN caps c ON t.currency_code = c.currency_code GROUP BY t.currency_code, c.cap"""

SQL["tickets_clean"] = _T + f"""
SELECT order_id, user_id, strftime(created_dt_msk, '%Y-%m-%d') AS created_dt_msk,
       strftime(created_ts_msk, '%Y-%m-%d %H:%M:%S') AS created_ts_msk, event_id, currency_code,
       device_type_canonical, revenue, tickets_count, event_type_main, region_name, service_name, curs,
       {R('revenue_rub', 6)} AS revenue_rub, {R('one_ticket_revenue_rub', 6)} AS one_ticket_revenue_rub,
       CAST(month AS BIGINT) AS month, season, CAST(days_since_prev AS DOUBLE) AS days_since_prev
FROM t_clean"""


def _season_share(dim_name: str, expr: str) -> str:
    return f"""
  SELECT '{dim_name}' AS dimension, COALESCE(s.value, a.value) AS value, s.summer_share, a.autumn_share
  FROM (SELECT CAST({expr} AS VARCHAR) AS value,
               {R('COUNT(*)::DOUBLE * 100 / SUM(COUNT(*)) OVER ()', 6)} AS summer_share
        FROM t_clean WHERE season = 'summer' GROUP BY 1) s
  FULL JOIN (SELECT CAST({expr} AS VARCHAR) AS value,
               {R('COUNT(*)::DOUBLE * 100 / SUM(COUNT(*)) OVER ()', 6)} AS autumn_share
        FROM t_clean WHERE season = 'autumn' GROUP BY 1) a ON s.value = a.value"""


SQL["season_mix"] = _T + "\n" + "\nUNION ALL".join([
    _season_share("event_type", "event_type_main"), _season_share("device", "device_type_canonical"),
    _season_share("age_limit", "age_limit")])

SQL["season_unit_revenue"] = _T + f"""
, s AS (SELECT event_type_main AS event_type, AVG(one_ticket_revenue_rub) AS summer_mean
        FROM t_clean WHERE season = 'summer' GROUP BY 1),
a AS (SELECT event_type_main AS event_type, AVG(one_ticket_revenue_rub) AS autumn_mean
      FROM t_clean WHERE season = 'autumn' GROUP BY 1)
SELECT COALESCE(s.event_type, a.event_type) AS event_type, {R('summer_mean', 6)} AS summer_mean,
       {R('autumn_mean', 6)} AS autumn_mean,
       {R('(autumn_mean - summer_mean) / summer_mean * 100', 1)} AS change_percent
FROM s FULL JOIN a ON s.event_type = a.event_type
WHERE summer_mean IS NOT NULL OR autumn_mean IS NOT NULL"""

_DAILY = """
, daily AS (
  SELECT created_dt_msk, COUNT(order_id) AS orders_count, COUNT(DISTINCT user_id) AS dau,
         AVG(one_ticket_revenue_rub) AS avg_ticket_price
  FROM t_clean WHERE season = 'autumn' GROUP BY created_dt_msk)"""

SQL["daily_dynamics"] = _T + _DAILY + f"""
SELECT strftime(created_dt_msk, '%Y-%m-%d') AS day, orders_count, dau,
       {R('avg_ticket_price', 6)} AS avg_ticket_price,
       {R('orders_count::DOUBLE / dau', 6)} AS avg_orders_per_user,
       CAST(isodow(created_dt_msk) - 1 AS BIGINT) AS day_of_week,
       strftime(created_dt_msk, '%A') AS weekday_name,
       CASE WHEN isodow(created_dt_msk) >= 6 THEN 'weekend' ELSE 'weekday' END AS type_of_day
FROM daily"""

SQL["weekday_cycle"] = _T + _DAILY + f"""
SELECT CAST(isodow(created_dt_msk) - 1 AS BIGINT) AS day_of_week,
       MIN(strftime(created_dt_msk, '%A')) AS weekday_name,
       {R('AVG(orders_count)', 2)} AS avg_orders, {R('AVG(dau)', 2)} AS avg_dau
FROM daily GROUP BY 1"""

SQL["day_type_cycle"] = _T + _DAILY + f"""
SELECT CASE WHEN isodow(created_dt_msk) >= 6 THEN 'weekend' ELSE 'weekday' END AS type_of_day,
       {R('AVG(orders_count)', 2)} AS avg_orders, {R('AVG(dau)', 2)} AS avg_dau
FROM daily GROUP BY 1"""


def _leader_sql(key: str, by: str, revenue: bool) -> str:
    rev = ""
    if revenue:
        rev = f""", {R('SUM(revenue_rub)', 2)} AS ticket_revenue,
       {R('SUM(revenue_rub) / (SELECT SUM(revenue_rub) FROM t_clean) * 100', 2)} AS revenue_share"""
    order = "SUM(revenue_rub)" if by == "ticket_revenue" else by
    return _T + f"""
SELECT {key}, COUNT(DISTINCT event_id) AS events_count, COUNT(order_id) AS orders_count,
       {R('COUNT(DISTINCT event_id)::DOUBLE / (SELECT COUNT(DISTINCT event_id) FROM t_clean) * 100', 2)} AS events_share,
       {R('COUNT(order_id)::DOUBLE / (SELECT COUNT(*) FROM t_clean) * 100', 2)} AS orders_share{rev}
FROM t_clean GROUP BY {key} ORDER BY {order} DESC, {key} LIMIT 5"""


SQL["region_leaders_by_events"] = _leader_sql("region_name", "events_count", False)
SQL["region_leaders_by_orders"] = _leader_sql("region_name", "orders_count", False)
SQL["partner_leaders_by_events"] = _leader_sql("service_name", "events_count", True)
SQL["partner_leaders_by_orders"] = _leader_sql("service_name", "orders_count", True)
SQL["partner_leaders_by_revenue"] = _leader_sql("service_name", "ticket_revenue", True)

SQL["first_last_change"] = _T + f"""
, m AS (SELECT month, COUNT(order_id) AS order_count FROM t_clean GROUP BY month)
SELECT CAST(f.month AS BIGINT) AS first_month, CAST(l.month AS BIGINT) AS last_month,
       f.order_count AS first_count, l.order_count AS last_count,
       {R('(l.order_count - f.order_count)::DOUBLE / f.order_count * 100', 2)} AS change_percent
FROM (SELECT * FROM m ORDER BY month LIMIT 1) f, (SELECT * FROM m ORDER BY month DESC LIMIT 1) l"""

SQL["overlap_percent"] = _T + f"""
, mob AS (SELECT DISTINCT user_id FROM t_clean WHERE season = 'autumn' AND device_type_canonical = 'mobile'),
desk AS (SELECT DISTINCT user_id FROM t_clean WHERE season = 'autumn' AND device_type_canonical = 'desktop'),
both_ AS (SELECT user_id FROM mob INTERSECT SELECT user_id FROM desk),
any_ AS (SELECT user_id FROM mob UNION SELECT user_id FROM desk)
SELECT (SELECT COUNT(*) FROM mob) AS users_a, (SELECT COUNT(*) FROM desk) AS users_b,
       (SELECT COUNT(*) FROM both_) AS users_both, (SELECT COUNT(*) FROM any_) AS users_any,
       {R('(SELECT COUNT(*) FROM both_)::DOUBLE / (SELECT COUNT(*) FROM any_) * 100', 4)} AS overlap_pct"""


def t_sf_sql(t: str, df: str) -> str:
    """Upper tail of Student's t from the power series of the regularized
    incomplete beta function I_y(1/2, df/2), y = t^2 / (df + t^2)."""
    y = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    term = (f"exp((i + 0.5) * ln({y}) + ({df}) / 2 * ln(1 - {y}) + lgamma(i + 0.5 + ({df}) / 2)"
            f" - lgamma(({df}) / 2) - lgamma(i + 1.5))")
    inside = f"least(1.0, list_sum(list_transform(range(0, 5000), lambda i: {term})))"
    return f"(CASE WHEN ({t}) = 0 THEN 0.5 ELSE (1 - sign({t}) * {inside}) / 2 END)"


def normal_cdf_sql(z: str) -> str:
    """Normal CDF from the series of odd powers over odd double factorials."""
    a = f"least(abs({z}), 20.0)"
    term = f"exp((2 * i + 1) * ln({a}) - {a} * {a} / 2 - (i + 1.5) * ln(2.0) - lgamma(i + 1.5))"
    half = f"least(0.5, list_sum(list_transform(range(0, 500), lambda i: {term})))"
    return f"(CASE WHEN ({z}) = 0 THEN 0.5 ELSE 0.5 + sign({z}) * {half} END)"


def welch_sql(per_cte: str, group: str, value: str, a: str, b: str) -> str:
    return f"""{per_cte}
, m AS (
  SELECT COUNT({value}) FILTER (WHERE {group} = '{a}') AS n_a,
         AVG({value}) FILTER (WHERE {group} = '{a}') AS mean_a,
         VAR_SAMP({value}) FILTER (WHERE {group} = '{a}') AS var_a,
         COUNT({value}) FILTER (WHERE {group} = '{b}') AS n_b,
         AVG({value}) FILTER (WHERE {group} = '{b}') AS mean_b,
         VAR_SAMP({value}) FILTER (WHERE {group} = '{b}') AS var_b
  FROM per),
s AS (
  SELECT *, (mean_a - mean_b) / NULLIF(sqrt(var_a / NULLIF(n_a, 0) + var_b / NULLIF(n_b, 0)), 0) AS t,
         power(var_a / NULLIF(n_a, 0) + var_b / NULLIF(n_b, 0), 2)
           / NULLIF(power(var_a / NULLIF(n_a, 0), 2) / NULLIF(n_a - 1, 0)
                    + power(var_b / NULLIF(n_b, 0), 2) / NULLIF(n_b - 1, 0), 0) AS dof
  FROM m)
SELECT n_a, {R('mean_a', 6)} AS mean_a, {R('var_a', 6)} AS var_a, n_b, {R('mean_b', 6)} AS mean_b,
       {R('var_b', 6)} AS var_b, {R('t', 6)} AS t_stat, {R('dof', 6)} AS dof,
       {R(t_sf_sql('t', 'dof'), 6)} AS p_value
FROM s"""


SQL["welch_orders"] = _T + welch_sql("""
, per AS (SELECT user_id, device_type_canonical AS device, COUNT(order_id) AS orders_count
          FROM t_clean WHERE season = 'autumn' GROUP BY 1, 2)""", "device", "orders_count", "mobile", "desktop")

SQL["welch_order_gap"] = _T + welch_sql("""
, per AS (SELECT user_id, device_type_canonical AS device, AVG(days_since_prev) AS gap
          FROM t_clean WHERE season = 'autumn' AND days_since_prev IS NOT NULL GROUP BY 1, 2)""",
                                        "device", "gap", "mobile", "desktop")

SQL["order_gap"] = _T + f"""
, per AS (SELECT user_id, device_type_canonical AS device, AVG(days_since_prev) AS gap
          FROM t_clean WHERE days_since_prev IS NOT NULL GROUP BY 1, 2)
SELECT device, COUNT(gap) AS users, {R('AVG(gap)', 6)} AS mean_gap, {R('STDDEV_SAMP(gap)', 6)} AS std_gap,
       {R('MIN(gap)', 6)} AS min_gap, {R('quantile_cont(gap, 0.5)', 6)} AS median_gap,
       {R('MAX(gap)', 6)} AS max_gap
FROM per GROUP BY device"""

# ---------------------------------------------------------------- startups
CTE["s_clean"] = """s_raw AS (
    SELECT CASE WHEN l.l_orderkey % 53 = 0 THEN NULL WHEN l.l_linenumber % 2 = 0 THEN upper(p.p_name)
                ELSE p.p_name END AS name,
           CASE WHEN p.p_size <= 30 THEN p.p_type ELSE p.p_type || ' ' || p.p_name END AS market,
           CASE WHEN l.l_orderkey % 41 = 0 THEN '-'
                ELSE format('{:,}', CAST(floor(l.l_extendedprice * 10) AS BIGINT)) END AS funding_total_usd,
           CASE o.o_orderstatus WHEN 'F' THEN 'Operating' WHEN 'O' THEN 'Acquired' ELSE 'Closed' END AS status,
           CAST(l.l_linenumber AS DOUBLE) AS funding_rounds,
           CASE WHEN l.l_orderkey % 37 = 0 THEN 'n/a' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS founded_at,
           strftime(o.o_orderdate, '%Y-%m-%d') AS first_funding_at,
           CASE WHEN l.l_linenumber > 2
                THEN strftime(CAST(o.o_orderdate AS DATE) + CAST(l.l_partkey % 60 AS INTEGER), '%Y-%m-%d') END
             AS mid_funding_at,
           strftime(l.l_shipdate, '%Y-%m-%d') AS last_funding_at,
           CASE WHEN l_suppkey % 13 = 0 THEN l_extendedprice ELSE 0.0 END AS seed,
           CASE WHEN l_suppkey % 13 = 1 THEN l_extendedprice ELSE 0.0 END AS venture,
           CASE WHEN l_suppkey % 13 = 2 THEN l_extendedprice ELSE 0.0 END AS equity_crowdfunding,
           CASE WHEN l_suppkey % 13 = 3 THEN l_extendedprice ELSE 0.0 END AS undisclosed,
           CASE WHEN l_suppkey % 13 = 4 THEN l_extendedprice ELSE 0.0 END AS convertible_note,
           CASE WHEN l_suppkey % 13 = 5 THEN l_extendedprice ELSE 0.0 END AS debt_financing,
           CASE WHEN l_suppkey % 13 = 6 THEN l_extendedprice ELSE 0.0 END AS angel,
           CASE WHEN l_suppkey % 13 = 7 THEN l_extendedprice ELSE 0.0 END AS "grant",
           CASE WHEN l_suppkey % 13 = 8 THEN l_extendedprice ELSE 0.0 END AS private_equity,
           CASE WHEN l_suppkey % 13 = 9 THEN l_extendedprice ELSE 0.0 END AS post_ipo_equity,
           CASE WHEN l_suppkey % 13 = 10 THEN l_extendedprice ELSE 0.0 END AS post_ipo_debt,
           CASE WHEN l_suppkey % 13 = 11 THEN l_extendedprice ELSE 0.0 END AS secondary_market,
           CASE WHEN l_suppkey % 13 = 12 THEN l_extendedprice ELSE 0.0 END AS product_crowdfunding
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
s_typed AS (
    SELECT DISTINCT lower(coalesce(name, 'unknown')) AS name, lower(coalesce(market, 'unknown')) AS market,
           TRY_CAST(replace(funding_total_usd, ',', '') AS DOUBLE) AS funding_total_usd,
           lower(coalesce(status, 'unknown')) AS status, CAST(funding_rounds AS BIGINT) AS funding_rounds,
           try_strptime(founded_at, '%Y-%m-%d') AS founded_at,
           try_strptime(first_funding_at, '%Y-%m-%d') AS first_funding_at,
           try_strptime(mid_funding_at, '%Y-%m-%d') AS mid_funding_at,
           try_strptime(last_funding_at, '%Y-%m-%d') AS last_funding_at,
           seed, venture, equity_crowdfunding, undisclosed, convertible_note, debt_financing, angel, "grant",
           private_equity, post_ipo_equity, post_ipo_debt, secondary_market, product_crowdfunding
    FROM s_raw),
s_clean AS (
    SELECT * REPLACE (coalesce(mid_funding_at, first_funding_at + (last_funding_at - first_funding_at) / 2)
                      AS mid_funding_at)
    FROM s_typed
    WHERE NULLIF(name, 'unknown') IS NOT NULL AND funding_total_usd IS NOT NULL
      AND first_funding_at IS NOT NULL AND last_funding_at IS NOT NULL),
s_group AS (
    SELECT *, date_diff('day', CAST(first_funding_at AS DATE), CAST(last_funding_at AS DATE)) AS funding_duration_days,
           CASE WHEN funding_rounds = 1 THEN 'single round'
                WHEN date_diff('day', CAST(first_funding_at AS DATE), CAST(last_funding_at AS DATE)) <= 365
                  THEN 'up to a year'
                ELSE 'over a year' END AS funding_group
    FROM s_clean),
s_seg AS (
    SELECT market, COUNT(*) AS count,
           CASE WHEN COUNT(*) > 120 THEN 'mass' WHEN COUNT(*) >= 35 THEN 'mid' ELSE 'niche' END AS category
    FROM s_group GROUP BY market),
s_rel AS (
    SELECT g.* REPLACE (CASE WHEN s.category = 'mass' THEN g.market ELSE s.category END AS market)
    FROM s_group g LEFT JOIN s_seg s ON g.market = s.market),
s_fence AS (
    SELECT market, quantile_cont(funding_total_usd, 0.25) AS q1, quantile_cont(funding_total_usd, 0.75) AS q3
    FROM s_rel GROUP BY market),
s_flag AS (
    SELECT r.*, coalesce(r.funding_total_usd < f.q1 - 1.5 * (f.q3 - f.q1)
                         OR r.funding_total_usd > f.q3 + 1.5 * (f.q3 - f.q1), false) AS is_outlier
    FROM s_rel r LEFT JOIN s_fence f ON r.market = f.market),
s_normal AS (SELECT *, CAST(year(mid_funding_at) AS BIGINT) AS year FROM s_flag WHERE NOT is_outlier),
s_final AS (
    SELECT * FROM s_normal
    WHERE year IN (SELECT year FROM s_normal GROUP BY year HAVING SUM(funding_rounds) >= 50))"""
CTE["s_returns"] = """s_returns AS (
    SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
           SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0.0 END) / 1e6 AS seed,
           SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice ELSE 0.0 END) / 1e6 AS venture,
           SUM(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice ELSE 0.0 END) / 1e6 AS angel,
           SUM(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice ELSE 0.0 END) / 1e6 AS debt_financing,
           SUM(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE 0.0 END) / 1e6 AS private_equity
    FROM orders GROUP BY 1)"""

SQL["funding_clean"] = with_("s_clean") + """
SELECT name, market, status, funding_total_usd, funding_rounds,
       strftime(founded_at, '%Y-%m-%d %H:%M:%S') AS founded_at,
       strftime(first_funding_at, '%Y-%m-%d %H:%M:%S') AS first_funding_at,
       strftime(mid_funding_at, '%Y-%m-%d %H:%M:%S') AS mid_funding_at,
       strftime(last_funding_at, '%Y-%m-%d %H:%M:%S') AS last_funding_at,
       seed, venture, equity_crowdfunding, undisclosed, convertible_note, debt_financing, angel, "grant",
           private_equity, post_ipo_equity, post_ipo_debt, secondary_market, product_crowdfunding
FROM s_clean"""

SQL["funding_terms"] = with_("s_clean") + f"""
SELECT funding_group, COUNT(*) AS companies,
       {R('COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER () * 100', 4)} AS companies_pct,
       {R('SUM(funding_total_usd) / SUM(SUM(funding_total_usd)) OVER () * 100', 4)} AS money_pct
FROM s_group GROUP BY funding_group"""

SQL["market_tiers"] = with_("s_clean") + """
SELECT category, COUNT(market) AS segment_count, CAST(SUM(count) AS BIGINT) AS company_count FROM s_seg GROUP BY category"""

SQL["iqr_outliers"] = with_("s_clean") + f"""
SELECT market, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_outlier) AS outliers,
       {R('(COUNT(*) FILTER (WHERE is_outlier))::DOUBLE / COUNT(*) * 100', 4)} AS ratio
FROM s_flag GROUP BY market ORDER BY ratio DESC, market LIMIT 10"""

SQL["active_years"] = with_("s_clean") + """
SELECT year, CAST(SUM(funding_rounds) AS BIGINT) AS rounds, COUNT(DISTINCT month(mid_funding_at)) AS n_months,
       array_to_string(list_sort(list_distinct(list(month(mid_funding_at)))), ',') AS months
FROM s_final GROUP BY year"""

_RETURNED = ("seed", "venture", "angel", "debt_financing", "private_equity")
SQL["funding_types"] = with_("s_clean", "s_returns") + f"""
, long AS (UNPIVOT (SELECT * FROM s_final) ON
    seed, venture, equity_crowdfunding, undisclosed, convertible_note, debt_financing, angel, "grant", private_equity,
    post_ipo_equity, post_ipo_debt, secondary_market, product_crowdfunding INTO NAME funding_type VALUE money),
m AS (SELECT funding_type, SUM(money) AS total_money, COUNT(*) FILTER (WHERE money > 0) AS popularity FROM long GROUP BY 1),
ret AS (SELECT funding_type, SUM(money) AS total_returns
        FROM (UNPIVOT s_returns ON {', '.join(_RETURNED)} INTO NAME funding_type VALUE money) GROUP BY 1)
SELECT m.funding_type, {R('m.total_money', 2)} AS total_money, m.popularity,
       {R('r.total_returns', 6)} AS total_returns
FROM m LEFT JOIN ret r ON m.funding_type = r.funding_type"""

SQL["yearly_rounds"] = with_("s_clean") + f"""
SELECT year, {R('median(funding_total_usd / funding_rounds)', 4)} AS avg_round_median,
       CAST(SUM(funding_rounds) AS BIGINT) AS total_rounds
FROM s_final GROUP BY year"""

SQL["growth_segments"] = with_("s_clean") + f"""
, pv AS (
  SELECT market, SUM(CASE WHEN year = 1999 THEN funding_total_usd ELSE 0 END) AS total_from,
         SUM(CASE WHEN year = 2000 THEN funding_total_usd ELSE 0 END) AS total_to
  FROM s_final GROUP BY market)
SELECT market, {R('total_from', 2)} AS total_from, {R('total_to', 2)} AS total_to FROM pv
WHERE total_to > total_from AND market NOT IN ('mid', 'niche', 'unknown')"""

SQL["segment_year_matrix"] = with_("s_clean") + f"""
, money AS (SELECT market, 'y' || year AS y, {R('SUM(funding_total_usd)', 2)} AS total FROM s_final WHERE market IS NOT NULL GROUP BY ALL)
SELECT market, coalesce(COLUMNS('^(y[0-9]+)$'), 0) AS '\\1' FROM (PIVOT money ON y USING first(total) GROUP BY market)"""

SQL["growing_segments_by_year"] = with_("s_clean") + f"""
, money AS (SELECT market, year, SUM(funding_total_usd) AS total FROM s_final GROUP BY ALL),
grown AS (
  SELECT market FROM money WHERE market NOT IN ('mid', 'niche', 'unknown') GROUP BY market
  HAVING coalesce(SUM(total) FILTER (WHERE year = 2000), 0) > coalesce(SUM(total) FILTER (WHERE year = 1999), 0)),
years AS (SELECT DISTINCT year FROM s_final)
SELECT g.market, y.year, {R('coalesce(m.total, 0)', 2)} AS total
FROM grown g CROSS JOIN years y LEFT JOIN money m ON m.market = g.market AND m.year = y.year"""

_RT = ("venture", "debt_financing", "private_equity", "seed", "angel")
SQL["return_ratio"] = with_("s_clean", "s_returns") + """
, inv AS (SELECT year, """ + ", ".join(f"SUM({t}) / 1000000 AS {t}" for t in _RT) + """ FROM s_final GROUP BY year)
SELECT x.year, """ + ",\n  ".join(
    R(f"CASE WHEN x.{t} / (y.{t} + 1e-60) > 2 THEN NULL ELSE x.{t} / (y.{t} + 1e-60) END", 6) + f" AS {t}_ratio"
    for t in _RT) + """
FROM s_returns x JOIN inv y ON x.year = y.year"""

# ---------------------------------------------------------------- catering venues
CTE["v_clean"] = """v_merged AS (
    SELECT d.doc_id AS id,
           'Venue ' || CAST((CASE WHEN d.doc_id % 20 = 1 THEN d.doc_id - 1 ELSE d.doc_id END) % 150 AS VARCHAR) AS name,
           upper(d.lang) AS category,
           'Street ' || CAST((CASE WHEN d.doc_id % 20 = 1 THEN d.doc_id - 1 ELSE d.doc_id END) % 997 AS VARCHAR)
             AS address,
           d.source AS district,
           CASE WHEN d.source = 'src0' THEN NULL ELSE d.text END AS hours,
           CAST(l.quality + d.doc_id % 31 / 10 AS DOUBLE) AS rating, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS chain,
           CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST(d.n_chars AS DOUBLE) END AS seats,
           CASE WHEN l.toxic IS NULL THEN NULL WHEN d.n_chars < 1000 THEN 'Low' WHEN d.n_chars < 5000 THEN 'Medium'
                WHEN d.n_chars < 20000 THEN 'High' ELSE 'Very High' END AS price,
           CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.n_chars / 10.0::DOUBLE END AS middle_avg_bill
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
v_norm AS (
    SELECT id, lower(name) AS name, lower(category) AS category, lower(address) AS address,
           lower(district) AS district, lower(coalesce(hours, 'unknown')) AS hours, rating,
           CAST(chain AS BOOLEAN) AS chain, CAST(seats AS BIGINT) AS seats,
           lower(coalesce(price, 'unknown')) AS price, middle_avg_bill
    FROM v_merged),
v_clean AS (
    SELECT * EXCLUDE (rn),
           coalesce(contains(hours, 'the') AND contains(hours, 'and'), false) AS is_24_7
    FROM (SELECT *, row_number() OVER (PARTITION BY name, address ORDER BY id) AS rn FROM v_norm)
    WHERE rn = 1)"""

_V = with_("v_clean")

SQL["venues_clean"] = _V + """
SELECT id, name, category, address, district, rating, chain, CAST(seats AS DOUBLE) AS seats, price, middle_avg_bill,
       is_24_7 FROM v_clean"""

SQL["hours_flag_check"] = _V + """
SELECT COUNT(*) FILTER (WHERE hours <> 'the and') AS not_exact, COUNT(*) FILTER (WHERE hours = 'the and') AS exact,
       COUNT(*) FILTER (WHERE is_24_7) AS flag_true, COUNT(*) FILTER (WHERE NOT is_24_7) AS flag_false
FROM v_clean"""

SQL["category_counts"] = _V + f"""
SELECT category, COUNT(*) AS count, {R('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()', 4)} AS percent
FROM v_clean WHERE category IS NOT NULL GROUP BY category"""

SQL["district_counts"] = _V + f"""
SELECT district, COUNT(*) AS count, {R('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()', 4)} AS percent
FROM v_clean WHERE district IS NOT NULL GROUP BY district"""

SQL["district_category_mix"] = _V + f"""
, inside AS (SELECT category FROM v_clean WHERE district = 'src0' AND category IS NOT NULL)
SELECT category, COUNT(*) AS count, {R('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM inside)', 4)} AS percent
FROM inside GROUP BY category"""

SQL["chain_by_category"] = _V + f"""
SELECT category, COUNT(*) FILTER (WHERE NOT chain) AS no_chain, COUNT(*) FILTER (WHERE chain) AS chain,
       COUNT(*) AS total,
       {R('(COUNT(*) FILTER (WHERE NOT chain))::DOUBLE / COUNT(*) * 100', 4)} AS no_chain_pct,
       {R('(COUNT(*) FILTER (WHERE chain))::DOUBLE / COUNT(*) * 100', 4)} AS chain_pct
FROM v_clean GROUP BY category"""

SQL["rating_by_category"] = _V + f"""
SELECT category, COUNT(rating) AS count, {R('AVG(rating)', 6)} AS mean, {R('STDDEV_SAMP(rating)', 6)} AS std,
       {R('MIN(rating)', 6)} AS min, {R('quantile_cont(rating, 0.25)', 6)} AS q25,
       {R('quantile_cont(rating, 0.5)', 6)} AS q50, {R('quantile_cont(rating, 0.75)', 6)} AS q75,
       {R('MAX(rating)', 6)} AS max
FROM v_clean WHERE category IS NOT NULL GROUP BY category"""

SQL["rating_spread"] = _V + f"""
SELECT {R('(MAX(m) - MIN(m)) / 4.0 * 100', 4)} AS rating_diff_pct
FROM (SELECT category, AVG(rating) AS m FROM v_clean WHERE category IS NOT NULL GROUP BY category)"""

SQL["seats_by_category"] = _V + f"""
SELECT category, {R('quantile_cont(seats, 0.5)', 4)} AS median_seats,
       {R('(SELECT quantile_cont(seats, 0.01) FROM v_clean)', 4)} AS p01_seats,
       {R('(SELECT quantile_cont(seats, 0.5) FROM v_clean)', 4)} AS p50_seats,
       {R('(SELECT quantile_cont(seats, 0.99) FROM v_clean)', 4)} AS p99_seats
FROM v_clean GROUP BY category"""

SQL["large_venues"] = _V + """
SELECT id, name, category, seats FROM v_clean
WHERE seats >= (SELECT quantile_cont(seats, 0.99) FROM v_clean)"""

SQL["bill_by_district"] = _V + f"""
SELECT district, {R('median(middle_avg_bill)', 4)} AS median, {R('AVG(middle_avg_bill)', 4)} AS mean
FROM v_clean GROUP BY district"""

SQL["rating_by_price"] = _V + f"""
SELECT price, {R('AVG(rating)', 6)} AS mean_rating FROM v_clean GROUP BY price"""

SQL["top_chains"] = _V + f"""
SELECT name, category, COUNT(id) AS count, {R('AVG(rating)', 6)} AS mean_rating
FROM v_clean WHERE chain GROUP BY name, category ORDER BY count DESC, name, category LIMIT 15"""

SQL["top_chains_categories"] = _V + """
SELECT category, COUNT(name) AS chains FROM (
  SELECT name, category, COUNT(id) AS count FROM v_clean WHERE chain
  GROUP BY name, category ORDER BY count DESC, name, category LIMIT 15)
GROUP BY category"""

SQL["association_table"] = _V + """
, rng AS (SELECT MIN(seats) AS s_lo, MAX(seats) AS s_hi, MIN(rating) AS r_lo, MAX(rating) AS r_hi FROM v_clean),
vb AS (
  SELECT v.*, CASE WHEN s_hi = s_lo THEN seats - s_lo
                   ELSE least(floor((seats - s_lo) / ((s_hi - s_lo) / 10.0)), seats * 0 + 9) END AS seats_bin,
         CASE WHEN r_hi = r_lo THEN rating - r_lo
              ELSE least(floor((rating - r_lo) / ((r_hi - r_lo) / 10.0)), rating * 0 + 9) END AS t
  FROM v_clean v, rng),
lng AS (
  SELECT t, 'category' AS attr, CAST(category AS VARCHAR) AS val FROM vb
  UNION ALL SELECT t, 'district', CAST(district AS VARCHAR) FROM vb
  UNION ALL SELECT t, 'chain', CAST(chain AS VARCHAR) FROM vb
  UNION ALL SELECT t, 'seats_bin', CAST(seats_bin AS VARCHAR) FROM vb
  UNION ALL SELECT t, 'price', CAST(price AS VARCHAR) FROM vb
  UNION ALL SELECT t, 'is_24_7', CAST(is_24_7 AS VARCHAR) FROM vb),
cells AS (SELECT attr, t, val, COUNT(*) AS n FROM lng WHERE t IS NOT NULL AND val IS NOT NULL GROUP BY ALL),
rt AS (SELECT attr, t, SUM(n) AS n_t FROM cells GROUP BY ALL),
ct AS (SELECT attr, val, SUM(n) AS n_v FROM cells GROUP BY ALL),
att AS (SELECT attr, SUM(n) AS n_all, COUNT(DISTINCT t) AS k_t, COUNT(DISTINCT val) AS k_v FROM cells GROUP BY attr),
chi AS (
  SELECT att.attr, att.n_all, att.k_t, att.k_v,
         SUM(power(coalesce(c.n, 0) - rt.n_t * ct.n_v / att.n_all, 2) / (rt.n_t * ct.n_v / att.n_all)) AS chi2
  FROM rt JOIN ct ON rt.attr = ct.attr JOIN att ON rt.attr = att.attr
  LEFT JOIN cells c ON c.attr = rt.attr AND c.t = rt.t AND c.val = ct.val
  GROUP BY ALL)""" + f"""
SELECT attr, CAST(n_all AS BIGINT) AS n_all, {R('chi2', 6)} AS chi2,
       {R('CASE WHEN least(k_t, k_v) - 1 = 0 THEN NULL ELSE sqrt(chi2 / (n_all * (least(k_t, k_v) - 1))) END', 6)}
         AS cramers_v
FROM chi"""

# ---------------------------------------------------------------- video games
CTE["g_clean"] = """g_raw AS (
    SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name,
           p_brand AS platform,
           CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(1995 + p_partkey % 20 AS DOUBLE) END AS year_of_release,
           upper(p_type[1]) || lower(p_type[2:]) AS genre,
           p_retailprice / 1000 AS na_sales_mm,
           CASE WHEN p_partkey % 13 = 0 THEN 'unknown' ELSE CAST(p_retailprice / 2000 AS VARCHAR) END AS eu_sales_mm,
           CASE WHEN p_partkey % 17 = 0 THEN 'unknown' ELSE CAST(p_size / 100 AS VARCHAR) END AS jp_sales_mm,
           p_size / 1000 AS other_sales_mm,
           CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END AS critic_score,
           CASE WHEN p_partkey % 11 = 0 THEN 'tbd' WHEN p_partkey % 19 = 0 THEN NULL
                ELSE CAST(p_size / 5 AS VARCHAR) END AS user_score,
           CASE WHEN p_partkey % 23 = 0 THEN NULL
                ELSE ['E', 'T', 'M', 'K-A', 'e10+'][CAST(p_partkey % 6 + 1 AS INTEGER)] END AS rating
    FROM part),
g_clean AS (
    SELECT DISTINCT lower(name) AS name, platform, CAST(year_of_release AS INTEGER) AS year_of_release,
           lower(genre) AS genre, na_sales_mm, TRY_CAST(eu_sales_mm AS DOUBLE) AS eu_sales_mm,
           TRY_CAST(jp_sales_mm AS DOUBLE) AS jp_sales_mm, other_sales_mm,
           CAST(coalesce(critic_score, -1.0) AS INTEGER) AS critic_score,
           coalesce(TRY_CAST(user_score AS DOUBLE), -1.0) AS user_score,
           coalesce(CASE WHEN upper(rating) = 'K-A' THEN 'E' ELSE upper(rating) END, 'unknown') AS rating
    FROM g_raw WHERE name IS NOT NULL AND genre IS NOT NULL AND year_of_release IS NOT NULL),
g_actual AS (
    SELECT *,
      CASE WHEN user_score >= 0 AND user_score < 3 THEN 'low' WHEN user_score >= 3 AND user_score < 8 THEN 'mid'
           WHEN user_score >= 8 AND user_score < 10 THEN 'high' ELSE 'unknown' END AS user_score_category,
      CASE WHEN critic_score >= 0 AND critic_score < 30 THEN 'low'
           WHEN critic_score >= 30 AND critic_score < 80 THEN 'mid'
           WHEN critic_score >= 80 AND critic_score < 100 THEN 'high' ELSE 'unknown' END AS critic_score_category
    FROM g_clean WHERE year_of_release BETWEEN 2000 AND 2013)"""

SQL["games_clean"] = with_("g_clean") + "\nSELECT * FROM g_clean"
SQL["score_bins"] = with_("g_clean") + """
SELECT user_score_category, critic_score_category, COUNT(*) AS games FROM g_actual GROUP BY ALL"""
SQL["top_platforms"] = with_("g_clean") + """
SELECT platform, COUNT(name) AS games FROM g_actual GROUP BY platform ORDER BY games DESC, platform LIMIT 7"""
SQL["games_profile"] = with_("g_clean") + """
SELECT platform, genre, COUNT(*) AS count FROM g_clean GROUP BY ALL"""

SQL["games_values"] = with_("g_clean") + "\n" + " UNION ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM g_clean WHERE {c} IS NOT NULL"
    for c in ("platform", "year_of_release", "rating"))

# ---------------------------------------------------------------- quality profiles
_VM_COLS = ("id", "name", "category", "address", "district", "hours", "rating", "chain", "seats", "price",
            "middle_avg_bill")

SQL["null_profile"] = with_("v_clean") + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    f"{R(f'(COUNT(*) FILTER (WHERE {c} IS NULL)) * 100.0 / COUNT(*)', 4)} AS null_pct FROM v_merged"
    for c in _VM_COLS)

SQL["missing_report"] = "SELECT * FROM (" + SQL["null_profile"] + ") WHERE n_null > 0"

SQL["null_totals"] = with_("v_clean") + """
SELECT CAST(SUM(""" + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _VM_COLS) + """) AS BIGINT) AS null_cells,
       COUNT(*) FILTER (WHERE """ + " OR ".join(f"{c} IS NULL" for c in _VM_COLS) + """) AS rows_with_null,
       COUNT(*) AS rows
FROM v_merged"""

SQL["marker_profile"] = with_("g_clean") + """
SELECT 'EU sales' AS "column", COUNT(*) FILTER (WHERE eu_sales_mm = 'unknown') AS n_marker, 'unknown' AS marker FROM g_raw
UNION ALL SELECT 'JP sales', COUNT(*) FILTER (WHERE jp_sales_mm = 'unknown'), 'unknown' FROM g_raw
UNION ALL SELECT 'User Score', COUNT(*) FILTER (WHERE user_score = 'tbd'), 'tbd' FROM g_raw"""

SQL["duplicate_profile"] = """
SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS distinct_rows,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates, 'full_row' AS scope
FROM lineitem
UNION ALL
SELECT COUNT(*), (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), 'order_line_key'
FROM lineitem"""

SQL["duplicate_lines"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) WHERE c > 1"""

SQL["cleaning_audit"] = with_("t_orders") + f"""
, caps AS (SELECT currency_code, quantile_cont(revenue, 0.99) AS cap FROM t_orders
           WHERE currency_code IN ('rub', 'kzt') GROUP BY 1),
capped AS (SELECT t.* FROM t_orders t JOIN caps c ON t.currency_code = c.currency_code WHERE t.revenue <= c.cap),
deduped AS (SELECT DISTINCT user_id, event_id, created_ts_msk, tickets_count, revenue, currency_code,
                   event_type_description, event_type_main FROM capped),
n AS (SELECT (SELECT COUNT(*) FROM t_orders WHERE currency_code IN ('rub', 'kzt')) AS rows_before,
             (SELECT COUNT(*) FROM capped) AS rows_capped, (SELECT COUNT(*) FROM deduped) AS rows_after)
SELECT rows_before, rows_before - rows_capped AS removed_cap, rows_capped - rows_after AS removed_duplicates,
       rows_after, {R('(rows_before - rows_after) * 100.0 / rows_before', 4)} AS removed_pct,
       (SELECT COUNT(*) FROM deduped WHERE currency_code <> 'rub' AND CAST(created_ts_msk AS DATE) NOT IN
          (SELECT CAST(o_orderdate AS DATE) FROM orders)) AS unmatched_rates
FROM n"""

SQL["event_value_describe"] = f"""
SELECT event_type, COUNT(value) AS count, {R('AVG(value)', 6)} AS mean, {R('STDDEV_SAMP(value)', 6)} AS std,
       {R('MIN(value)', 6)} AS min, {R('quantile_cont(value, 0.25)', 6)} AS q25,
       {R('quantile_cont(value, 0.5)', 6)} AS q50, {R('quantile_cont(value, 0.75)', 6)} AS q75,
       {R('MAX(value)', 6)} AS max
FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""

SQL["event_value_summary"] = f"""
SELECT COUNT(value) AS count, {R('AVG(value)', 6)} AS mean, {R('STDDEV_SAMP(value)', 6)} AS std,
       {R('MIN(value)', 6)} AS min, {R('quantile_cont(value, 0.25)', 6)} AS q25,
       {R('quantile_cont(value, 0.5)', 6)} AS q50, {R('quantile_cont(value, 0.75)', 6)} AS q75,
       {R('MAX(value)', 6)} AS max
FROM events"""

SQL["event_value_histogram"] = f"""
WITH r AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events WHERE value IS NOT NULL),
b AS (SELECT CASE WHEN hi = lo THEN 0
                  ELSE CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS BIGINT) END AS bin, lo, hi
      FROM events, r WHERE value IS NOT NULL)
SELECT g.bin, {R('lo + g.bin * (hi - lo) / 20', 6)} AS bin_left, {R('lo + (g.bin + 1) * (hi - lo) / 20', 6)} AS bin_right,
       (SELECT COUNT(*) FROM b WHERE b.bin = g.bin) AS count
FROM r, (SELECT unnest(range(20)) AS bin) g"""

SQL["event_value_boxplot"] = f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                  quantile_cont(value, 0.75) AS q3
           FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type)
SELECT e.event_type, {R('q1', 6)} AS q1, {R('med', 6)} AS median, {R('q3', 6)} AS q3,
       {R('MIN(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1))', 6)} AS whisker_low,
       {R('MAX(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1))', 6)} AS whisker_high,
       COUNT(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       COUNT(*) AS n
FROM events e JOIN q ON e.event_type = q.event_type WHERE value IS NOT NULL
GROUP BY e.event_type, q1, med, q3"""

# ---------------------------------------------------------------- app sessions and experiments
CTE["sessions"] = """sessions AS (
    SELECT user_id, event_id AS session_id, CAST(ts AS DATE) AS session_date, ts AS session_start_ts,
           CAST(event_type = 'signup' AS INTEGER) AS registration_flag,
           1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS page_counter,
           ['CIS', 'EU', 'MENA'][CAST(user_id % 3 + 1 AS INTEGER)] AS region,
           ['Android', 'iPhone', 'PC', 'Mac'][CAST(user_id % 4 + 1 AS INTEGER)] AS device,
           CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS test_group
    FROM events),
hist AS (SELECT * FROM sessions WHERE session_start_ts < TIMESTAMP '2024-01-15 00:00:00'),
test AS (SELECT * FROM sessions WHERE session_start_ts >= TIMESTAMP '2024-01-15 00:00:00'),
hist_first AS (
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_start_ts, session_id) AS rn FROM hist)
    WHERE rn = 1),
test_first AS (
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_start_ts, session_id) AS rn FROM test)
    WHERE rn = 1)"""
_S = with_("sessions")

SQL["sessions_per_user"] = _S + """
SELECT user_id, COUNT(DISTINCT session_id) AS session_count FROM hist GROUP BY user_id"""

SQL["top_user_sessions"] = _S + """
, top AS (SELECT user_id FROM hist GROUP BY user_id ORDER BY COUNT(DISTINCT session_id) DESC, user_id LIMIT 1)
SELECT user_id, session_id, strftime(session_date, '%Y-%m-%d') AS session_date, registration_flag, page_counter,
       region, device
FROM hist WHERE user_id IN (SELECT user_id FROM top)"""

SQL["sessions_daily"] = _S + f"""
SELECT strftime(session_date, '%Y-%m-%d') AS session_date, COUNT(DISTINCT user_id) AS total_users,
       CAST(SUM(registration_flag) AS BIGINT) AS registered_users,
       {R('SUM(registration_flag)::DOUBLE / COUNT(DISTINCT user_id)', 6)} AS share_registered_users
FROM hist GROUP BY session_date"""

SQL["pages_per_first_session"] = _S + """
SELECT page_counter, COUNT(session_id) AS sessions FROM hist_first GROUP BY page_counter"""

SQL["good_sessions_daily"] = _S + f"""
SELECT strftime(session_date, '%Y-%m-%d') AS session_date, COUNT(*) AS total_sessions,
       CAST(SUM(CAST(page_counter >= 4 AS INTEGER)) AS BIGINT) AS good_sessions,
       {R('SUM(CAST(page_counter >= 4 AS INTEGER))::DOUBLE / COUNT(*)', 6)} AS share_of_good_sessions
FROM hist_first GROUP BY session_date"""

# Normal quantiles of 1 - alpha / 2 and of the power.
_Z_ALPHA = {0.01: 2.5758293035489004, 0.05: 1.959963984540054, 0.1: 1.6448536269514722}
_Z_POWER = {0.8: 0.8416212335729143, 0.9: 1.2815515655446004}


def _sizes_sql(cases) -> str:
    per = "\n  UNION ALL ".join(
        f"SELECT '{kind}' AS mde_kind, {mde}::DOUBLE AS mde, {a}::DOUBLE AS alpha, {p}::DOUBLE AS power, "
        f"2 * power({_Z_ALPHA[a] + _Z_POWER[p]!r} / (2 * asin(sqrt({'base_rate * ' if kind == 'relative' else ''}"
        f"({'1' if kind == 'relative' else 'base_rate'} + {mde}))) - 2 * asin(sqrt(base_rate))), 2) AS n, "
        f"base_rate, avg_daily_users FROM base, daily" for kind, mde, a, p in cases)
    return _S + f"""
, base AS (SELECT AVG(CAST(page_counter >= 4 AS DOUBLE)) AS base_rate FROM hist_first),
daily AS (SELECT CAST(ROUND(AVG(u)) AS BIGINT) AS avg_daily_users
          FROM (SELECT session_date, COUNT(DISTINCT user_id) AS u FROM hist GROUP BY session_date)),
k AS ({per})
SELECT mde_kind, alpha, power, {R('base_rate', 6)} AS base_rate, mde, {R('n', 2)} AS sample_size,
       avg_daily_users, CAST(ceil(n / (avg_daily_users / 2)) AS BIGINT) AS test_duration_days
FROM k"""


SQL["ab_sample_size"] = "SELECT * EXCLUDE (alpha, power) FROM (" + _sizes_sql(
    [(kind, 0.03, 0.05, 0.8) for kind in ("relative", "absolute")]) + ")"
SQL["ab_sample_size_grid"] = _sizes_sql([("absolute", 0.03, a, p) for a in _Z_ALPHA for p in _Z_POWER])

SQL["ab_balance"] = _S + f"""
SELECT test_group, COUNT(DISTINCT user_id) AS users,
       {R('COUNT(DISTINCT user_id) * 100.0 / SUM(COUNT(DISTINCT user_id)) OVER ()', 2)} AS users_pct
FROM test GROUP BY test_group"""

SQL["group_pct_diff"] = _S + f"""
SELECT COUNT(DISTINCT user_id) FILTER (WHERE test_group = 'A') AS users_a,
       COUNT(DISTINCT user_id) FILTER (WHERE test_group = 'B') AS users_b,
       {R("(COUNT(DISTINCT user_id) FILTER (WHERE test_group = 'A') - COUNT(DISTINCT user_id) FILTER (WHERE test_group = 'B'))::DOUBLE / COUNT(DISTINCT user_id) FILTER (WHERE test_group = 'A') * 100", 4)} AS pct_diff
FROM test"""

SQL["ab_overlap"] = _S + """
SELECT COUNT(*) AS users_in_both_groups FROM (
  SELECT user_id FROM test GROUP BY user_id HAVING COUNT(DISTINCT test_group) > 1)"""


def _attr_balance_sql(attr: str) -> str:
    return _S + f"""
, firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                        ORDER BY session_start_ts, test_group, {attr}) AS rn FROM test) WHERE rn = 1)
SELECT test_group, {attr}, COUNT(*) AS users,
       {R(f'COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY test_group)', 4)} AS users_pct
FROM firsts GROUP BY test_group, {attr}"""


SQL["ab_device_balance"] = _attr_balance_sql("device")
SQL["ab_region_balance"] = _attr_balance_sql("region")

_COUNTS_TEST = """
, c AS (SELECT COUNT(*) FILTER (WHERE test_group = 'A') AS n_a,
               CAST(SUM(CASE WHEN test_group = 'A' AND page_counter >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS success_a,
               COUNT(*) FILTER (WHERE test_group = 'B') AS n_b,
               CAST(SUM(CASE WHEN test_group = 'B' AND page_counter >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS success_b
        FROM test_first)"""

SQL["ab_success"] = _S + _COUNTS_TEST + f"""
SELECT n_a, success_a, n_b, success_b, {R('success_a::DOUBLE / n_a', 6)} AS share_a,
       {R('success_b::DOUBLE / n_b', 6)} AS share_b,
       {R('(success_b::DOUBLE / n_b - success_a::DOUBLE / n_a) * 100', 4)} AS diff_points
FROM c"""


def ztest_sql(counts_from: str) -> str:
    return f"""
, zz AS (
  SELECT *, (success_a::DOUBLE / NULLIF(n_a, 0) - success_b::DOUBLE / NULLIF(n_b, 0))
              / NULLIF(sqrt(((success_a + success_b)::DOUBLE / NULLIF(n_a + n_b, 0))
                            * (1 - (success_a + success_b)::DOUBLE / NULLIF(n_a + n_b, 0))
                            * (1.0 / NULLIF(n_a, 0) + 1.0 / NULLIF(n_b, 0))), 0) AS z
  FROM {counts_from})
SELECT n_a, success_a, n_b, success_b, {R('success_a::DOUBLE / NULLIF(n_a, 0)', 6)} AS share_a,
       {R('success_b::DOUBLE / NULLIF(n_b, 0)', 6)} AS share_b,
       (success_a >= 5 AND n_a - success_a >= 5 AND success_b >= 5 AND n_b - success_b >= 5) AS enough_data,
       {R('z', 6)} AS z_stat, {R(normal_cdf_sql('z'), 6)} AS p_value
FROM zz"""


SQL["ab_ztest"] = _S + _COUNTS_TEST + ztest_sql("c")

CTE["site"] = """users_ AS (SELECT DISTINCT user_id FROM events),
participants AS (
    SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS "group", 'interface_eu_test' AS ab_test
    FROM users_ WHERE user_id % 3 <> 0
    UNION ALL
    SELECT user_id, CASE WHEN user_id % 4 < 2 THEN 'A' ELSE 'B' END, 'recommender_system_test'
    FROM users_ WHERE user_id % 5 = 0),
site_clean AS (
    SELECT * FROM participants WHERE ab_test = 'interface_eu_test'
      AND user_id NOT IN (SELECT user_id FROM participants WHERE ab_test = 'recommender_system_test')),
ev AS (SELECT user_id, ts AS event_dt, event_type AS event_name FROM events
       WHERE user_id IN (SELECT user_id FROM site_clean)),
ev7 AS (SELECT e.* FROM ev e JOIN (SELECT user_id, MIN(event_dt) AS start_dt FROM ev GROUP BY user_id) s
          ON e.user_id = s.user_id WHERE e.event_dt - s.start_dt <= INTERVAL 7 DAYS),
conv AS (
    SELECT p."group", COUNT(*) AS total_visitors, CAST(SUM(CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS buyers_count
    FROM site_clean p LEFT JOIN (SELECT DISTINCT user_id FROM ev7 WHERE event_name = 'purchase') b
      ON p.user_id = b.user_id
    GROUP BY p."group")"""

SQL["site_overlap"] = with_("site") + """
SELECT COUNT(DISTINCT user_id) FILTER (WHERE ab_test = 'interface_eu_test') AS site_users,
       COUNT(DISTINCT user_id) FILTER (WHERE ab_test = 'recommender_system_test') AS competing_users,
       (SELECT COUNT(*) FROM (SELECT user_id FROM participants WHERE ab_test = 'interface_eu_test'
                              INTERSECT SELECT user_id FROM participants WHERE ab_test = 'recommender_system_test')) AS "both",
       (SELECT COUNT(*) FROM site_clean) AS site_users_clean
FROM participants"""

SQL["site_balance"] = with_("site") + f"""
SELECT "group", COUNT(DISTINCT user_id) AS users,
       {R('COUNT(DISTINCT user_id) * 100.0 / SUM(COUNT(DISTINCT user_id)) OVER ()', 2)} AS users_pct
FROM site_clean GROUP BY "group" """

SQL["site_conversion"] = with_("site") + f"""
SELECT "group", total_visitors, buyers_count, {R('buyers_count::DOUBLE / total_visitors * 100', 2)} AS conversion_rate
FROM conv"""

SQL["site_ztest"] = with_("site") + """
, c AS (SELECT SUM(CASE WHEN "group" = 'A' THEN total_visitors ELSE 0 END)::BIGINT AS n_a,
               SUM(CASE WHEN "group" = 'A' THEN buyers_count ELSE 0 END)::BIGINT AS success_a,
               SUM(CASE WHEN "group" = 'B' THEN total_visitors ELSE 0 END)::BIGINT AS n_b,
               SUM(CASE WHEN "group" = 'B' THEN buyers_count ELSE 0 END)::BIGINT AS success_b FROM conv)""" \
    + ztest_sql("c")

CTE["reading"] = """reading AS (
    SELECT user_id AS puid, CASE WHEN user_id % 4 = 0 THEN 'city_a' ELSE 'city_b' END AS city,
           SUM(value) / 60 AS hours, event_type AS source_type
    FROM events GROUP BY user_id, event_type),
reading_clean AS (
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY puid ORDER BY source_type, city, hours) AS rn FROM reading)
    WHERE rn = 1)"""

SQL["reading_dedupe_audit"] = with_("reading") + """
SELECT COUNT(*) AS rows, COUNT(DISTINCT puid) AS distinct_puid, COUNT(*) - COUNT(DISTINCT puid) AS duplicates
FROM reading"""

SQL["reading_city_stats"] = with_("reading") + f"""
SELECT city, COUNT(hours) AS count, {R('AVG(hours)', 2)} AS mean, {R('median(hours)', 2)} AS median,
       {R('STDDEV_SAMP(hours)', 2)} AS std, {R('MIN(hours)', 2)} AS min, {R('MAX(hours)', 2)} AS max
FROM reading_clean GROUP BY city"""

SQL["welch_by_group"] = with_("reading") + welch_sql(
    ", per AS (SELECT city, hours FROM reading_clean)", "city", "hours", "city_a", "city_b")

# ---------------------------------------------------------------- dashboard metrics
CTE["food"] = """food AS (
    SELECT user_id, ts, event_type AS event, CASE WHEN event_type = 'purchase' THEN value END AS revenue,
           'venue_' || CAST(event_id % 11 AS VARCHAR) AS venue,
           'dish_' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 23 AS VARCHAR) AS dish
    FROM events)"""
_F = with_("food")

SQL["dau"] = _F + """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, COUNT(DISTINCT user_id) AS dau FROM food GROUP BY 1"""

SQL["conversion_daily"] = _F + f"""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, COUNT(DISTINCT user_id) AS active_users,
       COUNT(DISTINCT user_id) FILTER (WHERE event = 'purchase') AS ordering_users,
       {R("(COUNT(DISTINCT user_id) FILTER (WHERE event = 'purchase'))::DOUBLE / COUNT(DISTINCT user_id)", 6)} AS conversion
FROM food GROUP BY 1"""

SQL["avg_check"] = _F + f"""
SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, {R('SUM(CAST(revenue AS DECIMAL(18,2)))', 2)} AS revenue,
       COUNT(*) AS orders, {R('CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)', 4)} AS avg_check
FROM food WHERE event = 'purchase' GROUP BY 1"""

SQL["ltv_top_venues"] = _F + f"""
SELECT venue, {R('SUM(revenue)', 2)} AS ltv FROM food WHERE event = 'purchase'
GROUP BY venue ORDER BY SUM(revenue) DESC, venue LIMIT 3"""

SQL["ltv_top_dishes"] = _F + f"""
SELECT dish, {R('SUM(revenue)', 2)} AS ltv FROM food WHERE event = 'purchase'
GROUP BY dish ORDER BY SUM(revenue) DESC, dish LIMIT 5"""

_RET = """
, d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM food),
f AS (SELECT user_id, MIN(day) AS first_day FROM d GROUP BY user_id),
act AS (SELECT d.user_id, {cohort} AS cohort, date_diff('day', f.first_day, d.day) AS day_offset
        FROM d JOIN f ON d.user_id = f.user_id),
sizes AS (SELECT {cohort} AS cohort, COUNT(*) AS cohort_size FROM f GROUP BY 1),
grid AS (SELECT a.cohort, s.cohort_size, UNNEST(range(0, MAX(a.day_offset) + 1)) AS day_offset
         FROM act a JOIN sizes s ON a.cohort = s.cohort GROUP BY a.cohort, s.cohort_size),
cnt AS (SELECT cohort, day_offset, COUNT(DISTINCT user_id) AS retained_users FROM act GROUP BY ALL)
SELECT {sel} CAST(g.day_offset AS BIGINT) AS day_offset, g.cohort_size, coalesce(c.retained_users, 0) AS retained_users,
       CAST(ROUND(CAST(coalesce(c.retained_users, 0)::DOUBLE / g.cohort_size AS DECIMAL(38,9)), 6) AS DOUBLE) AS retention_rate
FROM grid g LEFT JOIN cnt c ON g.cohort = c.cohort AND g.day_offset = c.day_offset"""

SQL["retention"] = _F + _RET.format(cohort="'all'", sel="")
SQL["retention_monthly"] = _F + _RET.format(cohort="strftime(date_trunc('month', f.first_day), '%Y-%m-%d')",
                                            sel="g.cohort,")

SQL["dau_bitmaps"] = _F + """
, days AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM food)
SELECT strftime(a.day, '%Y-%m-%d') AS day, (SELECT COUNT(*) FROM days d WHERE d.day = a.day AND user_id IS NOT NULL) AS dau,
       (SELECT COUNT(DISTINCT user_id) FROM days d WHERE d.day BETWEEN a.day - 6 AND a.day) AS wau
FROM (SELECT DISTINCT day FROM days) a"""

SQL["retention_bitmaps"] = f"""
SELECT 'all' AS cohort, * FROM ({SQL['retention']}) UNION ALL BY NAME SELECT * FROM ({SQL['retention_monthly']})"""

SQL["overlap_bitmaps"] = _F + f"""
, u AS (SELECT user_id, bool_or(event = 'view') AS a, bool_or(event = 'purchase') AS b FROM food
        WHERE event IN ('view', 'purchase') AND user_id IS NOT NULL GROUP BY 1)
SELECT COUNT(*) FILTER (WHERE a) AS users_a, COUNT(*) FILTER (WHERE b) AS users_b, COUNT(*) FILTER (WHERE a AND b) AS users_both,
       COUNT(*) AS users_any, {R('(COUNT(*) FILTER (WHERE a AND b)) * 100.0 / COUNT(*)', 4)} AS overlap_pct FROM u"""

CTE["talks"] = """talks AS (
    SELECT l.l_orderkey * 10 + l.l_linenumber AS talk_id, o.o_orderpriority AS conference, n.n_name AS country,
           c.c_name AS speaker, c.c_mktsegment AS occupation, string_split(p.p_name, ' ') AS tags,
           l.l_quantity AS length, l.l_extendedprice AS views,
           CAST(floor(l.l_discount * 100) AS BIGINT) AS applause, CAST(floor(l.l_tax * 100) AS BIGINT) AS laughter
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey)"""
_TK = with_("talks")

SQL["talk_counts"] = _TK + """
SELECT COUNT(DISTINCT conference) AS conferences, COUNT(*) AS talks, COUNT(DISTINCT speaker) AS speakers,
       (SELECT COUNT(DISTINCT tag) FROM (SELECT UNNEST(tags) AS tag FROM talks)) AS tags
FROM talks"""

SQL["talk_by_conference"] = _TK + f"""
SELECT conference, {R('AVG(length)', 4)} AS mean_length, MAX(views) AS max_views,
       CAST(SUM(applause) AS BIGINT) AS total_applause, COUNT(DISTINCT speaker) AS speakers
FROM talks GROUP BY conference"""

SQL["talk_filter"] = _TK + f"""
SELECT COUNT(*) AS talks, {R('SUM(views)', 2)} AS views, COUNT(DISTINCT speaker) AS speakers
FROM talks WHERE country = 'NATION_3' AND conference = '1-URGENT'"""

SQL["talks_top_laughter"] = _TK + """
SELECT talk_id, speaker, laughter FROM talks ORDER BY laughter DESC, talk_id LIMIT 10"""

SQL["top_tags"] = _TK + f"""
SELECT tag, COUNT(talk_id) AS talks, {R('SUM(views)', 2)} AS views
FROM (SELECT UNNEST(tags) AS tag, talk_id, views FROM talks) GROUP BY tag ORDER BY talks DESC, tag LIMIT 20"""

SQL["speakers_top"] = _TK + """
SELECT speaker, occupation, CAST(SUM(applause) AS BIGINT) AS applause FROM talks
GROUP BY speaker, occupation ORDER BY applause DESC, speaker, occupation LIMIT 10"""

SQL["top_tags_by_views"] = _TK + f"""
, t AS (SELECT UNNEST(tags) AS tag, talk_id, views FROM talks)
SELECT tag, COUNT(talk_id) AS talks, {R('SUM(views)', 2)} AS views FROM t GROUP BY tag
ORDER BY 3 DESC, tag LIMIT 20"""

# ---------------------------------------------------------------- intake
SQL["csv_orders"] = f"""
SELECT o_orderstatus, COUNT(o_orderkey) AS orders, {R('SUM(CAST(o_totalprice AS DECIMAL(28,6)))', 2)} AS money
FROM orders GROUP BY 1"""
SQL["csv_row_counts"] = """
SELECT source, n_rows FROM (SELECT COUNT(*) AS n_rows FROM customer), (VALUES ('table'), ('csv')) v(source)"""
SQL["csv_dirty_funding"] = with_("s_clean") + """
SELECT status, COUNT(*) AS companies, COUNT(*) FILTER (WHERE funding_total_usd <> '-') AS with_amount,
       COUNT(*) FILTER (WHERE funding_total_usd = '-') AS bad_amount,
       SUM(TRY_CAST(replace(funding_total_usd, ',', '') AS DOUBLE)) AS money
FROM s_raw GROUP BY status"""
SQL["csv_gzip_events"] = """
SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, COUNT(*) AS events FROM events GROUP BY ALL"""
SQL["zip_events"] = """
SELECT CASE WHEN user_id % 2 = 1 THEN 'odd.csv' ELSE 'even.csv' END AS member, hour(ts) AS hour, COUNT(*) AS events,
       COUNT(DISTINCT user_id) AS users, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_event
FROM events GROUP BY 1, 2"""

SQL["csv_inferred"] = """
WITH n AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderkey % 50 = 0) AS na, COUNT(*) FILTER (WHERE o_orderkey % 3 = 0) AS third FROM orders)
SELECT t.position::BIGINT AS position, t.column, t.type, n.n AS n_rows, CASE t.position WHEN 6 THEN n.third ELSE 0 END AS n_null, 0::BIGINT AS n_bad,
       CASE t.position WHEN 5 THEN 'bigint' ELSE t.type END AS type_loose, CASE t.position WHEN 5 THEN n.na ELSE 0 END AS n_bad_loose
FROM n CROSS JOIN (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_totalprice', 'double'), (2, 'o_orderstatus', 'string'), (3, 'day', 'date'),
                          (4, 'moment', 'timestamp'), (5, 'customer', 'string'), (6, 'even', 'boolean')) t(position, "column", type)"""

SQL["csv_text_dates"] = """
SELECT CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS month, COUNT(*) AS orders
FROM orders GROUP BY 1"""
SQL["catalog_orders"] = """
SELECT o_orderpriority, COUNT(*) AS orders, MAX(o_orderkey) AS last_order FROM orders GROUP BY 1"""
