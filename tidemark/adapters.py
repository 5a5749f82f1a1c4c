"""The driver's star-schema tables read as observation tables.

Plain projections and joins; ``checks/sql.py`` states the same projections in SQL. Money is kept
as whole cents in doubles so that other engines see identical numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed


class Tables:
    """Lazy readers over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _line(self) -> DataFrame:
        return self.read("lineitem").join(
            self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"),
            "l_partkey",
        )

    def prices(self) -> DataFrame:
        return self._line().select(
            F.col("p_type").alias("series_id"),
            F.col("l_suppkey").alias("market_id"),
            F.to_date("l_shipdate").alias("as_of_date"),
            F.when(F.col("l_returnflag") == "A", "modal")
            .when(F.col("l_returnflag") == "N", "min")
            .otherwise("max")
            .alias("price_type"),
            unit_cents().alias("value"),
            line_status().alias("validation_status"),
            line_id().alias("observation_id"),
            line_seen().alias("observed_at"),
        )

    def arrivals(self) -> DataFrame:
        return self._line().select(
            F.col("p_type").alias("series_id"),
            F.col("l_suppkey").alias("market_id"),
            F.to_date("l_shipdate").alias("as_of_date"),
            F.col("l_quantity").alias("volume"),
            line_status().alias("validation_status"),
            line_id().alias("observation_id"),
            line_seen().alias("observed_at"),
        )

    def markets(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").alias("market_id"))

    def rules(self) -> DataFrame:
        """Decision rules per series: long names carry a floor price, short ones do not."""
        name = F.col("p_type")
        return (
            self.read("part")
            .select("p_type")
            .distinct()
            .select(
                name.alias("series_id"),
                F.when(
                    F.length(name) > 5,
                    F.create_map(
                        F.lit(fixed.FLOOR_RULE_KEY),
                        (F.length(name) * 25000).cast("string"),
                        F.lit(fixed.PROXIMITY_RULE_KEY),
                        F.lit("0.4"),
                    ),
                )
                .otherwise(F.create_map().cast("map<string,string>"))
                .alias("decision_rules"),
            )
        )

    def weather(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        return self.read("orders").select(
            F.lit("belt").alias("series_id"),
            F.col("o_orderpriority").alias("region_id"),
            F.to_date("o_orderdate").alias("as_of_date"),
            F.when(cents % 11 != 0, (cents % 640) / 16.0).alias("rainfall_mm"),
            F.when(cents % 13 != 0, F.lit(15.0) + (cents % 400) / 16.0).alias("temperature_mean_c"),
            F.when(cents % 17 != 0, F.lit(30.0) + (cents % 112) / 2.0).alias(
                "relative_humidity_pct"
            ),
            F.when(F.col("o_custkey") % 10 == 0, "rejected")
            .when(F.col("o_orderstatus") == "F", "validated")
            .when(F.col("o_orderstatus") == "O", "received")
            .otherwise("published")
            .alias("validation_status"),
            F.col("o_orderkey").alias("observation_id"),
            F.col("o_orderdate").alias("observed_at"),
        )

    def futures(self) -> DataFrame:
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("as_of_date")
        )
        shipped = F.to_date("l_shipdate")
        return (
            self._line()
            .join(orders, "l_orderkey")
            .filter(shipped > F.col("as_of_date"))
            .groupBy(
                F.col("p_type").alias("series_id"),
                F.col("p_brand").alias("contract_symbol"),
                "as_of_date",
                F.last_day(shipped).alias("expiry_date"),
            )
            .agg(
                F.max(unit_cents()).alias("settle_price"),
                F.sum("l_quantity").cast("long").alias("open_interest"),
            )
            .select(
                "series_id",
                "contract_symbol",
                "as_of_date",
                "expiry_date",
                "settle_price",
                F.when(F.col("open_interest") % 7 != 0, F.col("open_interest")).alias(
                    "open_interest"
                ),
                F.lit("validated").alias("validation_status"),
                F.col("as_of_date").cast("timestamp").alias("observed_at"),
            )
        )

    def pairs(self) -> DataFrame:
        """Forecast evaluation pairs from orders."""
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        predicted = F.col("o_totalprice") + (cents % 2001 - 1000)
        return self.read("orders").select(
            F.col("o_orderpriority").alias("series_id"),
            F.col("o_orderkey").alias("pair_id"),
            F.to_date("o_orderdate").alias("as_of_date"),
            ((F.col("o_orderkey") % 3 + 1) * 30).cast("long").alias("horizon_days"),
            F.when(cents % 37 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("actual"),
            predicted.alias("predicted"),
            F.when(cents % 5 != 0, predicted - 500.0).alias("band_low"),
            F.when(cents % 7 != 0, predicted + 500.0).alias("band_high"),
        )

    def signals(self) -> DataFrame:
        """Agent signals from events: several versions per agent and day, the latest counts."""
        share = F.least(F.col("value") / 500.0, F.lit(1.0))
        agent = F.col("event_type")
        return self.read("events").select(
            F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("commodity_id"),
            F.to_date("ts").alias("as_of_date"),
            F.lit("r1").alias("registry_id"),
            F.when(agent == "click", "Market")
            .when(agent == "view", "Weather")
            .when(agent == "purchase", "Policy")
            .when(agent == "signup", "Demand")
            .otherwise("Futures")
            .alias("agent_type"),
            F.when(F.col("event_id") % 3 == 0, "bullish")
            .when(F.col("event_id") % 3 == 1, "bearish")
            .otherwise("neutral")
            .alias("direction"),
            F.round(share, 4).cast("decimal(5,4)").alias("magnitude"),
            F.round(F.lit(1.0) - share, 4).cast("decimal(5,4)").alias("confidence"),
            F.from_json("props", "map<string,string>").alias("signal_components"),
            F.col("ts").alias("as_of_timestamp"),
            F.col("event_id").alias("signal_id"),
        )


def unit_cents() -> Column:
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double")


def line_status() -> Column:
    return F.when(F.col("l_linestatus") == "F", "validated").otherwise("received")


def line_id() -> Column:
    return F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.to_date("l_shipdate").cast("string"),
        unit_cents().cast("long").cast("string"),
    )


def line_seen() -> Column:
    return F.timestamp_add("HOUR", F.col("l_linenumber"), F.col("l_shipdate"))


class Landed(Tables):
    """The same tables as landed records and stored observations with flaws to find."""

    def raw_records(self) -> DataFrame:
        # Joined one by one: the size of a plain table is known, that of their join is guessed far too high,
        # and the lines would be shuffled to meet it.
        line = (
            self.read("lineitem")
            .join(self.read("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
            .join(self.read("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
            .join(self.read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
        )
        order, part, cents = F.col("l_orderkey"), F.col("l_partkey"), unit_cents().cast("long")
        label = F.lit("Maize")
        names = ("Cotton", "Kapas", "Cotton (Unginned)", "Cotton-Bags", " Cotton-Loose ",
                 "Cotton Seed")
        for i, name in enumerate(names):
            label = F.when(order % 7 == i, name).otherwise(label)
        day = F.to_date("l_shipdate")
        return line.select(
            line_id().alias("source_file"),
            F.col("l_linenumber").alias("position"),
            F.concat(F.lit(" "), "r_name", F.lit(" ")).alias("state"),
            F.col("n_name").alias("district"),
            F.col("s_name").alias("market"),
            label.alias("commodity"),
            F.when(part % 3 == 0, "A").when(part % 3 == 1, "").alias("variety"),
            F.when(part % 4 == 0, "FAQ").alias("grade"),
            F.when(part % 50 == 0, "31/02/2024")
            .otherwise(F.date_format(day, "d/M/yyyy"))
            .alias("arrival_date"),
            F.when(order % 97 == 0, "abc")
            .when(order % 5 == 0, "")
            .otherwise(cents.cast("string"))
            .alias("min_price"),
            F.when(F.col("l_returnflag") != "R", (cents + 200).cast("string")).alias("max_price"),
            (cents + 100).cast("string").alias("modal_price"),
            F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long").cast("string"))
            .otherwise("")
            .alias("arrival_tonnes"),
            F.when(F.col("l_linenumber") % 2 == 0, "7").alias("arrival"),
        )

    def market_places(self) -> DataFrame:
        """Known markets: every fifth supplier is unknown."""
        return (
            self.read("supplier")
            .filter(F.col("s_suppkey") % 5 != 0)
            .join(self.read("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
            .join(self.read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
            .select(
                F.col("r_name").alias("state"),
                F.col("n_name").alias("district"),
                F.col("s_name").alias("market"),
                F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("market_id"),
            )
        )

    def stored_prices(self) -> DataFrame:
        supp = F.col("l_suppkey")
        return self.read("lineitem").select(
            line_id().alias("observation_id"),
            F.when(supp % 17 == 0, None)
            .when(supp % 13 == 0, F.concat(F.lit("x"), supp.cast("string")))
            .otherwise(F.concat(F.lit("m"), supp.cast("string")))
            .alias("market_id"),
            F.when(F.col("l_orderkey") % 11 == 0, "jute")
            .when(F.col("l_orderkey") % 23 == 0, "unknown")
            .otherwise("cotton")
            .alias("commodity_id"),
            F.when(F.col("l_returnflag") == "A", "modal")
            .when(F.col("l_returnflag") == "N", "min")
            .otherwise("max")
            .alias("price_type"),
            F.col("l_extendedprice").alias("value"),
            F.when(F.col("l_partkey") % 19 != 0, "quintal").alias("unit"),
            F.lit("INR").alias("currency"),
            F.to_date("l_shipdate").alias("as_of_date"),
            F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") - 2)
            .cast("timestamp")
            .alias("observed_at"),
            F.when(F.col("l_partkey") % 29 == 0, "other").otherwise("agmarknet").alias("source"),
            F.when(F.col("l_partkey") % 3 == 0, "A").alias("quality_grade"),
            line_status().alias("validation_status"),
        )

    def stored_arrivals(self) -> DataFrame:
        rows = self.stored_prices()
        return rows.select(
            "observation_id", "market_id", "commodity_id",
            (F.col("value") * 10).alias("volume"), "unit", "as_of_date", "observed_at", "source",
            "validation_status",
        )

    def dimension_markets(self) -> DataFrame:
        return self.read("supplier").select(
            F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("market_id")
        )

    def dimension_commodities(self) -> DataFrame:
        """Two registered commodities, read off the order priorities."""
        first = F.substring("o_orderpriority", 1, 1).cast("int")
        return (
            self.read("orders")
            .select(F.when(first == 1, "cotton").when(first == 2, "jute").alias("commodity_id"))
            .filter(F.col("commodity_id").isNotNull())
            .distinct()
        )
