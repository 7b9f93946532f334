"""Analog views of the warehouse sources, derived from the test tables.

The churn study reads fifteen warehouse tables that are not available; the
views below re-create their shape (keys, flags, dates, amounts, nulls and
duplicate keys) from the TPC-H-like test tables, so every operator runs on
data whose size grows with the input.  The definitions are the ones fixed in
FIXTURES.md; the DuckDB twins live in ``fixture_sql``.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_END = dt.date(2099, 12, 31)


def _half(c: Column) -> Column:
    return F.floor(c / F.lit(2.0)).cast("bigint")


class Fixtures:
    def __init__(self, tables):
        self.t = tables

    # -- service agreements -------------------------------------------------
    @cached_property
    def sa(self) -> DataFrame:
        t = self.t
        # max(shipdate if shipdate > orderdate) == max(shipdate) when that max
        # exceeds the order date, else NULL: pre-aggregating lineitem before
        # the join is exact and shrinks the shuffle to one row per order.
        last_ship = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_last_ship"))
        o = t.orders.join(last_ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        key = F.col("o_orderkey")
        base = (
            o.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        end = F.when(F.col("_last_ship") > F.col("o_orderdate"), F.to_date("_last_ship"))
        return base.select(
            key.alias("sa_id"),
            F.col("o_custkey").alias("account_id"),
            _half(F.col("o_custkey")).alias("person_id"),
            (key % 500).alias("premise_id"),
            F.col("r_name").alias("cis_division"),
            F.col("c_mktsegment").alias("customer_class"),
            F.col("n_name").alias("city"),
            F.concat(
                (F.col("o_custkey") + 10000).cast("string"), F.lit("-"), (key % 500 + 1000).cast("string")
            ).alias("postal"),
            F.when(key % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias(
                "rate_class_code"
            ),
            F.when(F.col("o_orderstatus") == "F", "60")
            .when(F.col("o_orderstatus") == "O", "20")
            .when(key % 5 == 0, "70")
            .when(key % 5 == 1, "10")
            .otherwise("40")
            .alias("sa_status_flag"),
            F.to_date("o_orderdate").alias("sa_start_date"),
            F.coalesce(end, F.lit(OPEN_END)).alias("sa_end_date"),
        )

    # -- turn-on / turn-off facts (not unique per SA) -------------------------
    @cached_property
    def recdet(self) -> DataFrame:
        sa = self.sa.select("sa_id", "premise_id", "sa_start_date", "sa_end_date")
        null = F.lit(None).cast("string")
        sid = F.col("sa_id")
        starts = sa.select(
            F.trunc("sa_start_date", "MM").alias("month_start_date"),
            "sa_id",
            "premise_id",
            F.lit("Y").alias("started_flag"),
            F.lit("N").alias("stopped_flag"),
            F.when(sid % 7 == 0, null).when(sid % 11 == 0, "Y").otherwise("N").alias("dnp_started_flag"),
            F.lit("N").alias("dnp_stopped_flag"),
        )
        stops = sa.filter(F.col("sa_end_date") < F.lit(OPEN_END)).select(
            F.trunc("sa_end_date", "MM").alias("month_start_date"),
            "sa_id",
            "premise_id",
            F.lit("N").alias("started_flag"),
            F.lit("Y").alias("stopped_flag"),
            null.alias("dnp_started_flag"),
            F.when(sid % 3 == 0, "Y").otherwise("N").alias("dnp_stopped_flag"),
        )
        moved = sa.filter(sid % 50 == 0).select(
            F.trunc("sa_start_date", "MM").alias("month_start_date"),
            "sa_id",
            (F.col("premise_id") + 1).alias("premise_id"),
            F.lit("Y").alias("started_flag"),
            F.lit("N").alias("stopped_flag"),
            F.lit("N").alias("dnp_started_flag"),
            F.lit("N").alias("dnp_stopped_flag"),
        )
        return starts.unionByName(stops).unionByName(moved)

    # -- weather by area and day ---------------------------------------------
    @cached_property
    def weather(self) -> DataFrame:
        li = self.t.lineitem
        avg_q = F.avg("l_quantity")
        return (
            li.groupBy(
                F.when(F.col("l_linestatus") == "O", "LGC").otherwise("MGE").alias("trend_area_code"),
                F.to_date("l_shipdate").alias("degree_day_date"),
            )
            .agg(
                avg_q.alias("average_temperature"),
                F.when(avg_q < 65, F.lit(65.0) - avg_q).otherwise(F.lit(0.0)).alias("degree_day"),
                F.min("l_quantity").alias("minimum_temperature"),
                F.max("l_quantity").alias("maximum_temperature"),
            )
        )

    # -- financial transactions ------------------------------------------------
    @cached_property
    def ft(self) -> DataFrame:
        li = self.t.lineitem
        ship = F.to_date("l_shipdate")
        return li.select(
            F.col("l_orderkey").alias("sa_id"),
            F.when(F.col("l_returnflag") == "A", "PS")
            .when(F.col("l_returnflag") == "N", "BS")
            .otherwise("PX")
            .alias("ft_type_flag"),
            ship.alias("post_date"),
            F.col("l_partkey").alias("parent_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sibling_id"),
            F.when(F.col("l_partkey") % 13 == 0, F.lit(None).cast("date"))
            .otherwise(F.date_add(ship, 30))
            .alias("arrears_date"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("current_amount"),
            F.col("l_extendedprice").alias("payoff_amount"),
            F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("frozen_sw"),
        )

    # Payments are reduced under the key by which they are joined, so that they are
    # shuffled once; every other id of a payment follows from this one.
    @cached_property
    def pay_seg(self) -> DataFrame:
        seg = self._paid.select(F.col("sibling_id").alias("integration_id"), (F.col("sibling_id") + 1).alias("payment_id"))
        return seg.repartition("integration_id").distinct()

    @cached_property
    def pay(self) -> DataFrame:
        payment = F.col("sibling_id") + 1
        return self._paid.select(payment.alias("integration_id"), (payment * 2).alias("pay_event_id")).repartition("integration_id").distinct()

    @cached_property
    def pay_event(self) -> DataFrame:
        event = self._paid.select(((F.col("sibling_id") + 1) * 2).alias("integration_id"), "post_date")
        return event.groupBy("integration_id").agg(F.max("post_date").alias("payment_date"))

    @property
    def _paid(self) -> DataFrame:
        return self.ft.filter(F.col("ft_type_flag") == "PS")

    # -- small facts -------------------------------------------------------------
    @cached_property
    def credit(self) -> DataFrame:
        c = self.t.customer
        return c.filter(F.col("c_custkey") % 10 != 0).select(
            F.col("c_custkey").alias("account_id"),
            F.floor("c_acctbal").cast("int").alias("internal_credit_rating"),
        )

    @cached_property
    def pledge(self) -> DataFrame:
        o = self.t.orders
        return o.filter(F.col("o_orderpriority") == "1-URGENT").select(
            _half(F.col("o_custkey")).alias("person_id"),
            F.to_date("o_orderdate").alias("pledge_dt"),
            (F.col("o_orderkey") - F.col("o_orderkey") % 3).alias("c1sa"),
        )

    @cached_property
    def adj(self) -> DataFrame:
        li = self.t.lineitem
        return li.filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("sa_id"),
            F.lit("LPC").alias("adjustment_type_code"),
            F.when(F.col("l_linestatus") == "F", "50").otherwise("20").alias("adjustment_status_flag"),
            F.to_date("l_shipdate").alias("creation_date"),
        )

    @cached_property
    def usage_fact(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(
            F.col("l_orderkey").alias("sa_id"),
            F.col("l_quantity").alias("billed_usage"),
            F.last_day(F.to_date("l_shipdate")).alias("last_day_of_period"),
        )

    # -- deterministic score column for the evaluation operators ---------------
    def scored(self, as_of: str = "1998-03-01", horizon: int = 180) -> DataFrame:
        from churnscope.functions.asof import active_at, stopped_within
        from churnscope.functions.hashing import unit_hash

        sa = self.sa.filter(active_at(as_of))
        label = stopped_within(as_of, horizon)
        payments = self.ft.groupBy("sa_id").agg(F.count(F.lit(1)).alias("payments"))
        scored = sa.select("sa_id", label.alias("label")).withColumn(
            "prob", F.round((unit_hash(F.col("sa_id"), "s:") + F.lit(0.5) * F.col("label")) / F.lit(1.5), 4)
        )
        return (
            scored.join(payments, "sa_id", "left")
            .select(
                "sa_id",
                "label",
                "prob",
                (F.col("prob") >= 0.5).cast("int").alias("pred"),
                F.coalesce(F.col("payments"), F.lit(0)).alias("payments"),
            )
        )
