"""Reference-shaped frames derived from the driver tables.

The analyses read tables that do not ship with them (players, listings,
ticket orders, startups, venues, games, app sessions, experiment events).
Each function below derives a frame with the reference column names from the
driver tables, lazily, so every query's work grows with the input.
The mapping follows FIXTURES.md section 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

# ---------------------------------------------------------------- fantasy game

def fantasy_users(t: Tables) -> DataFrame:
    """Players: customer; every 6th customer pays; every 97th has no race."""
    c = t.customer
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 97 == 0, F.lit(None).cast("int"))
         .otherwise(F.col("c_nationkey")).alias("race_id"),
        F.when(F.col("c_custkey") % 6 == 0, 1).otherwise(0).alias("payer"),
    )


def fantasy_race(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("race_id"), F.col("n_name").alias("race"))


def fantasy_events(t: Tables) -> DataFrame:
    """Purchases: one per order line, bought by the order's customer.
    Lines of every 100th order are free (amount 0)."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    o = t.orders.select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("o_custkey").alias("id"),
        F.col("l_partkey").alias("item_code"),
        F.when(F.col("l_orderkey") % 100 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("amount"),
    )


def fantasy_items(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item_code"), F.col("p_name").alias("game_items"))


# ---------------------------------------------------------------- real estate

# Fixed values of the stand-in: the named city, the listing type kept, the year window.
REAL_ESTATE_MAIN_CITY = "NATION_1"
REAL_ESTATE_CITY_TYPE = "F"
REAL_ESTATE_YEARS = (1996, 1999)


def _flat_columns() -> list:
    """The measures of a flat: columns of its order line alone."""
    return [(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_quantity").alias("total_area"),
            F.nullif(F.col("l_linenumber"), F.lit(7)).alias("rooms"),
            F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("balcony"),
            (F.lit(2.4) + F.col("l_discount") * 10).alias("ceiling_height"),
            (F.lit(5) + F.col("l_suppkey") % 20).alias("floors_total"),
            (F.lit(1) + F.col("l_partkey") % 10).alias("floor"),
            F.when(F.col("l_partkey") % 9 == 0, 1).otherwise(0).alias("open_plan"),
            (F.col("l_suppkey") % 4).alias("parks_around3000"),
            (F.col("l_partkey") % 3).alias("ponds_around3000"),
            (F.col("l_quantity") * 0.6).alias("living_area"),
            F.when(F.col("l_tax") == 0, 1).otherwise(0).alias("is_apartment"),
            (F.col("l_quantity") * 0.2).alias("kitchen_area"),
            (F.col("l_extendedprice") / 10).alias("airports_nearest")]


def real_estate_flats(t: Tables) -> DataFrame:
    """The flats alone, one per order line."""
    return t.lineitem.select(*_flat_columns())


def real_estate_listings(t: Tables) -> DataFrame:
    """Flats + advertisement + city + type in one frame at order-line grain."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))  # 25 rows, fixed size
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(c, F.col("o_custkey") == F.col("c_custkey"))
              .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
              .select(*_flat_columns(),
                      F.col("n_name").alias("city"),
                      F.col("o_orderstatus").alias("type"),
                      F.col("l_extendedprice").alias("last_price"),
                      F.col("o_orderdate").alias("first_day_exposition"),
                      F.when(days >= 0, days).alias("days_exposition")))


# ---------------------------------------------------------------- ticket sales

def ticket_orders(t: Tables) -> DataFrame:
    """Ticket orders joined with their events (J1): one order per order line,
    the event is the part, the currency follows the order status."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                           "l_extendedprice", "l_tax", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, F.col("l_partkey") == F.col("p_partkey"))
              .select(
                  (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"),
                  F.col("o_custkey").alias("user_id"),
                  F.to_date("l_shipdate").alias("created_dt_msk"),
                  F.col("l_shipdate").alias("created_ts_msk"),
                  F.col("l_partkey").alias("event_id"),
                  ((F.col("l_partkey") % 5) * 4).cast("int").alias("age_limit"),
                  F.when(F.col("o_orderstatus") == "P", "kzt").otherwise("rub").alias("currency_code"),
                  F.when(F.col("l_suppkey") % 4 == 0, "desktop").otherwise("mobile").alias("device_type_canonical"),
                  (F.col("l_extendedprice") / 100).alias("revenue"),
                  F.concat(F.lit("partner_"), (F.col("l_suppkey") % 12).cast("string")).alias("service_name"),
                  ((F.col("l_quantity").cast("int") % 6) + 1).alias("tickets_count"),
                  (F.col("l_extendedprice") / 100 * (1 + F.col("l_tax"))).alias("total"),
                  F.col("p_name").alias("event_type_description"),
                  F.col("p_type").alias("event_type_main"),
                  F.col("p_brand").alias("region_name"),
                  F.col("p_size").cast("bigint").alias("city_id"),
              ))


def tenge_rates(t: Tables) -> DataFrame:
    """Daily KZT rate per 100 units, one row per calendar day that has an
    order; days without an order have no rate (N19)."""
    d = F.to_date("o_orderdate")
    return (t.orders.select(d.alias("data")).distinct()
            .select("data", F.lit(100).alias("nominal"),
                    (F.lit(19.0) + (F.dayofmonth("data") % 7) * 0.25).alias("curs"),
                    F.lit("kzt").alias("cdx")))


# ---------------------------------------------------------------- startups

# The funding types, in the order of the source's list. An order
# line of the stand-in carries the type of its supplier number.
FUNDING_TYPES = (
    "seed", "venture", "equity_crowdfunding", "undisclosed", "convertible_note", "debt_financing", "angel", "grant",
    "private_equity", "post_ipo_equity", "post_ipo_debt", "secondary_market", "product_crowdfunding")
# Returns per type come from the order priority.
RETURN_PRIORITY_OF = {"seed": "1-URGENT", "venture": "2-HIGH", "angel": "3-MEDIUM",
                      "debt_financing": "4-NOT SPECIFIED", "private_equity": "5-LOW"}


def startup_investments_raw(t: Tables) -> DataFrame:
    """Raw startup records as text, like the ``;`` separated source: amounts
    with thousands separators or ``-``, dates as text (some unparsable),
    missing names and mixed-case text."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    p = t.part.select("p_partkey", "p_name", "p_type", "p_size")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, F.col("l_partkey") == F.col("p_partkey"))
    amount = F.floor(F.col("l_extendedprice") * 10).cast("bigint")
    types = {name: F.when(F.col("l_suppkey") % len(FUNDING_TYPES) == i, F.col("l_extendedprice")).otherwise(F.lit(0.0))
             for i, name in enumerate(FUNDING_TYPES)}
    return j.select(
        F.when(F.col("l_orderkey") % 53 == 0, F.lit(None).cast("string"))
         .when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_size") <= 30, F.col("p_type"))
         .otherwise(F.concat_ws(" ", F.col("p_type"), F.col("p_name"))).alias("market"),
        F.when(F.col("l_orderkey") % 41 == 0, F.lit("-")).otherwise(F.format_number(amount, 0))
         .alias("funding_total_usd"),
        F.when(F.col("o_orderstatus") == "F", "Operating").when(F.col("o_orderstatus") == "O", "Acquired")
         .otherwise("Closed").alias("status"),
        F.col("l_linenumber").cast("double").alias("funding_rounds"),
        F.when(F.col("l_orderkey") % 37 == 0, F.lit("n/a"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("founded_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_funding_at"),
        F.when(F.col("l_linenumber") > 2,
               F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("l_partkey") % 60).cast("int")),
                             "yyyy-MM-dd")).alias("mid_funding_at"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("last_funding_at"),
        *[c.alias(n) for n, c in types.items()],
    )


def startup_returns(t: Tables) -> DataFrame:
    """Returns per year and funding type, in millions (order totals by year
    and priority)."""
    o = t.orders.select(F.year("o_orderdate").cast("bigint").alias("year"), "o_orderpriority", "o_totalprice")
    return o.groupBy("year").agg(*[
        (F.sum(F.when(F.col("o_orderpriority") == pr, F.col("o_totalprice")).otherwise(0.0)) / 1e6).alias(ty)
        for ty, pr in RETURN_PRIORITY_OF.items()])


# ---------------------------------------------------------------- catering venues

# Fixed values of the stand-in: two words whose joint presence in the text
# plays the role of "daily" and "around the clock" in the opening hours.
HOURS_WORDS = ("the", "and")


def venue_info(t: Tables) -> DataFrame:
    """Venue info before the prices: documents with the opening-hours text."""
    hours = F.when(F.col("source") == "src0", F.lit(None).cast("string")).otherwise(F.col("text"))
    return t.documents.select("doc_id", "lang", "source", "n_chars", hours.alias("hours"))


def venues_merged(t: Tables, info: DataFrame | None = None) -> DataFrame:
    """Venue info left-joined with prices (J2): documents are venues, labels
    carry the rating and the price information of the labelled ones. ``info``
    is ``venue_info``, or that with other columns in place of the hours: what is
    put in their place before the join spares it moving the long text."""
    info = venue_info(t) if info is None else info
    hours = [c for c in info.columns if c not in ("doc_id", "lang", "source", "n_chars")]
    lab = t.labels.select("doc_id", "quality", "toxic")
    j = info.join(lab, "doc_id", "left")
    price = (F.when(F.col("toxic").isNull(), F.lit(None).cast("string"))
              .when(F.col("n_chars") < 1000, "Low").when(F.col("n_chars") < 5000, "Medium")
              .when(F.col("n_chars") < 20000, "High").otherwise("Very High"))
    # every 20th venue repeats the name and address of the one before it
    key = F.when(F.col("doc_id") % 20 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return j.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Venue "), (key % 150).cast("string")).alias("name"),
        F.upper("lang").alias("category"),
        F.concat(F.lit("Street "), (key % 997).cast("string")).alias("address"),
        F.col("source").alias("district"),
        *hours,
        (F.col("quality") + F.col("doc_id") % 31 / 10).cast("double").alias("rating"),
        F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("chain"),
        F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("n_chars").cast("double")).alias("seats"),
        price.alias("price"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("n_chars") / 10.0).alias("middle_avg_bill"),
    )


# ---------------------------------------------------------------- video games

# Fixed values of the stand-in: ESRB-like rating codes by part key.
GAME_RATINGS = ("E", "T", "M", "K-A", "e10+")


def games_raw(t: Tables) -> DataFrame:
    """Game titles with the source header and dirty values: text sales with
    'unknown', user score text with 'tbd', missing years, scores and ratings."""
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    rating = F.try_element_at(F.array(*[F.lit(r) for r in GAME_RATINGS]), (k % 6 + 1).cast("int"))
    return p.select(
        F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("Name"),
        F.col("p_brand").alias("Platform"),
        F.when(k % 31 == 0, F.lit(None).cast("double")).otherwise((F.lit(1995) + k % 20).cast("double"))
         .alias("Year of Release"),
        F.initcap("p_type").alias("Genre"),
        (F.col("p_retailprice") / 1000).alias("NA sales"),
        F.when(k % 13 == 0, F.lit("unknown")).otherwise((F.col("p_retailprice") / 2000).cast("string"))
         .alias("EU sales"),
        F.when(k % 17 == 0, F.lit("unknown")).otherwise((F.col("p_size") / 100).cast("string")).alias("JP sales"),
        (F.col("p_size") / 1000).alias("Other sales"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise((F.col("p_size") * 2).cast("double"))
         .alias("Critic Score"),
        F.when(k % 11 == 0, F.lit("tbd")).when(k % 19 == 0, F.lit(None).cast("string"))
         .otherwise((F.col("p_size") / 5).cast("string")).alias("User Score"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(rating).alias("Rating"),
    )


# ---------------------------------------------------------------- app sessions and experiments

# Fixed values of the stand-ins: region and device labels by user id, the day
# the recommendation test starts, the two site tests.
REGIONS = ("CIS", "EU", "MENA")
DEVICES = ("Android", "iPhone", "PC", "Mac")
TEST_START = "2024-01-15"
SITE_TEST = "interface_eu_test"
COMPETING_TEST = "recommender_system_test"


def _pick(labels, idx):
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (idx % len(labels) + 1).cast("int"))


def app_sessions(t: Tables) -> DataFrame:
    """App sessions: every event is a session of its user; pages viewed come
    from the JSON properties; the test group follows the user id parity."""
    e = t.events.select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id"), F.col("event_id").alias("session_id"),
        F.to_date("ts").alias("session_date"), F.col("ts").alias("session_start_ts"),
        (F.col("event_type") == "signup").cast("int").alias("registration_flag"),
        (F.lit(1) + k % 7).alias("page_counter"),
        _pick(REGIONS, F.col("user_id")).alias("region"),
        _pick(DEVICES, F.col("user_id")).alias("device"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("test_group"),
    )


def ab_participants(t: Tables) -> DataFrame:
    """Experiment participants of two overlapping tests, derived from the
    users present in the events."""
    users = t.events.select("user_id").distinct()
    dev = _pick(DEVICES, F.col("user_id"))
    site = users.filter(F.col("user_id") % 3 != 0).select(
        "user_id", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("group"),
        F.lit(SITE_TEST).alias("ab_test"), dev.alias("device"))
    comp = users.filter(F.col("user_id") % 5 == 0).select(
        "user_id", F.when(F.col("user_id") % 4 < 2, "A").otherwise("B").alias("group"),
        F.lit(COMPETING_TEST).alias("ab_test"), dev.alias("device"))
    return site.unionByName(comp)


def ab_events(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("ts").alias("event_dt"), F.col("event_type").alias("event_name"),
                           F.col("props").alias("details"))


def reading_activity(t: Tables) -> DataFrame:
    """Reading hours: one row per (user, event type) so user ids repeat; the
    city follows the user id."""
    e = t.events.select("user_id", "event_type", "value")
    return e.groupBy("user_id", "event_type").agg((F.sum("value") / 60).alias("hours")).select(
        F.col("user_id").alias("puid"),
        F.when(F.col("user_id") % 4 == 0, "city_a").otherwise("city_b").alias("city"),
        "hours", F.col("event_type").alias("source_type"))


# ---------------------------------------------------------------- food delivery and talks

def food_events(t: Tables) -> DataFrame:
    """Delivery-app events: a purchase is an order with revenue = value; the
    venue and the dish come from the event id and the JSON properties."""
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("user_id", "ts", F.col("event_type").alias("event"),
                    F.when(F.col("event_type") == "purchase", F.col("value")).alias("revenue"),
                    F.concat(F.lit("venue_"), (F.col("event_id") % 11).cast("string")).alias("venue"),
                    F.concat(F.lit("dish_"), (k % 23).cast("string")).alias("dish"))


def talks(t: Tables) -> DataFrame:
    """Conference talks: one per order line; conference = order priority,
    speaker = customer, tags = words of the part name."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                           "l_discount", "l_tax")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))  # 25 rows, fixed size
    p = t.part.select("p_partkey", "p_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
           .join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey")))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("talk_id"),
                    F.col("o_orderpriority").alias("conference"), F.col("n_name").alias("country"),
                    F.col("c_name").alias("speaker"), F.col("c_mktsegment").alias("occupation"),
                    F.split("p_name", " ").alias("tags"), F.col("l_quantity").alias("length"),
                    F.col("l_extendedprice").alias("views"),
                    F.floor(F.col("l_discount") * 100).cast("bigint").alias("applause"),
                    F.floor(F.col("l_tax") * 100).cast("bigint").alias("laughter"))
