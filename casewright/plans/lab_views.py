"""Lab tables as views over the driver's star schema.

The operators work on the lab schema (cases, products, tasks, customers, ...). This module derives
those tables from ``orders``, ``lineitem``, ``events`` and the other given tables with expressions
that keep the edge cases the operators must survive: cases without products, blank and null
categories, locations that are null or aliased, repeated line numbers, null amounts.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.calendar import BusinessCalendar
from casewright.sources.tables import read_table

AS_OF = date(1998, 6, 15)
NOW = datetime(1998, 6, 15, 12, 0)
EVENT_DAY = date(2024, 1, 19)
EVENT_NOW = datetime(2024, 1, 19, 15, 0)

# 1998 follows this list alone; every other year follows the yearly rules.
CALENDAR = BusinessCalendar(
    frozenset(
        {
            date(1998, 1, 1),
            date(1998, 1, 2),
            date(1998, 5, 25),
            date(1998, 6, 12),
            date(1998, 7, 3),
            date(1998, 9, 7),
            date(1998, 11, 26),
            date(1998, 12, 25),
        }
    )
)

# Location of each nation number, one per nation; null and blank exercise the no-location bucket.
LOCATIONS = [
    "Design Cart",
    "3D Design",
    "3D Manufacturing",
    "Oven",
    "Metal Shelf",
    "Marpe Finish",
    "Tumbler",
    "Banding",
    "Wire E&P",
    "Welding",
    "QC",
    "Marpe",
    "New Cases",
    "New Cases How to Proceed",
    "New Cases Waiting For Scans",
    "Email Plan Case",
    "Email Follow Up",
    "Zoom Set Up",
    "Zoom Consult",
    "Zoom Export Needed",
    "Airway Planning",
    "Shipping Hold Tray",
    "Attic",
    "",
    None,
]
CATEGORY_BY_TYPE = {
    "LARGE": ("Hybrid", "Hybrid"),
    "ECONOMY": ("E² Expanders", "E-expander Plus"),
    "SMALL": ("Lab to Lab", "Lab to lab"),
    "MEDIUM": ("Metal", "Clear"),
    "PROMO": ("Marpe", "Wire Bending"),
    "STANDARD": ("Airway", "Accessories"),
}
TASK_BY_EVENT = {
    "click": "3dplan",
    "error": "3dfin-exp",
    "purchase": "3drevise",
    "signup": "3dd",
    "view": "3dcf",
}
HOLD_STATUSES = [
    "Production, Waiting on Scan",
    "Airway, How to Proceed",
    "Email Plan,Waiting on Approval",
    "Zoom Plan, Waiting on Approval",
    "Customer Request",
]


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def money(col: Column, digits: int = 2) -> Column:
    return col.cast(f"decimal(18,{digits})")


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


class Lab:
    """Lab tables of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        """One given table; the schema is read from its files once per process, not once per use."""
        key = (self.folder, name)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = read_table(self.spark, self.folder, name).schema
        return read_table(self.spark, self.folder, name, _SCHEMAS[key])

    def cases(self) -> DataFrame:
        """One row per order; dates and location come from its lines in a single aggregation.

        A query that does not use the location drops that part of the aggregate, which then hashes.
        """
        line_order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
        lines = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.min("l_shipdate").alias("first_ship"),
                F.max("l_shipdate").alias("last_ship"),
                F.max(line_order)["l_suppkey"].alias("last_location_id"),
            )
        )
        key = F.col("o_orderkey")
        status = (
            F.when(F.col("o_orderstatus") == "F", "Invoiced")
            .when(F.col("o_orderstatus") == "O", "In Production")
            .when(key % 5 == 0, "Submitted")
            .when(key % 7 == 0, "Cancelled")
            .otherwise("On Hold")
        )
        ship = F.coalesce("first_ship", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
        slashed = F.concat(
            F.month("o_orderdate").cast("string"), F.lit("/"), F.dayofmonth("o_orderdate").cast("string")
        )
        other = F.concat(
            (key % 12 + 1).cast("string"), F.lit("/"), (key % 28 + 1).cast("string")
        )
        reason = (
            F.when(key % 8 == 0, F.concat(F.lit("(AFU) "), slashed, F.lit(" waiting on scan")))
            .when(key % 8 == 1, F.concat(F.lit("zfu"), slashed, F.lit(" then (EFU) "), other))
            .when(key % 8 == 2, F.concat(F.lit("(ZFU)"), slashed))
            .when(key % 8 == 3, "no date given")
            .when(key % 8 == 4, "(AFU) 2/30 call back")
            .when(key % 8 == 5, "(EFU) 2/29 plan")
            .when(key % 8 == 6, "AFU 13/40, afu 7/4")
        )
        return (
            self.table("orders")
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                key.alias("case_id"),
                key.cast("string").alias("case_number"),
                F.when(
                    F.col("o_orderpriority") == "1-URGENT",
                    F.concat(F.lit("R"), (key % 90).cast("string")),
                )
                .otherwise((key % 9000 + 1000).cast("string"))
                .alias("pan_number"),
                status.alias("status"),
                ship.alias("ship_date"),
                (ship + F.expr("INTERVAL 2 DAYS")).alias("due_date"),
                F.col("o_orderdate").alias("date_in"),
                F.col("o_orderdate").alias("create_date"),
                F.when(F.col("o_orderstatus") == "F", F.coalesce("last_ship", ship)).alias(
                    "invoice_date"
                ),
                F.when(F.col("o_orderstatus") == "P", ship).alias("hold_date"),
                _pick(key % 5, HOLD_STATUSES).alias("hold_status"),
                reason.alias("hold_reason"),
                F.col("last_location_id"),
                (F.col("o_orderpriority") == "2-HIGH").alias("local_delivery"),
                F.col("o_custkey").cast("string").alias("customer_id"),
                F.concat(F.lit("Dr "), F.col("o_custkey").cast("string")).alias("doctor_name"),
                F.when(key % 13 != 0, F.concat(F.lit("Pat"), (key % 100).cast("string"))).alias(
                    "patient_first"
                ),
                F.concat(F.lit("Doe"), (key % 37).cast("string")).alias("patient_last"),
                F.when(key % 53 == 0, "R").otherwise("D").alias("type"),
                (key % 97 == 0).alias("deleted"),
                F.when(key % 3 != 0, key % 61 == 0).alias("is_adjustment"),
                F.when(key % 3 == 0, "North Lab").otherwise("South Lab").alias("lab_name"),
                money(F.col("o_totalprice")).alias("taxable_amount"),
                money(key % 100).alias("non_taxable_amount"),
                money(key % 10).alias("sales_discount"),
                money(key % 4).alias("remake_discount"),
                money(key % 20).alias("total_tax"),
                money(F.col("o_totalprice")).alias("total_charge"),
                F.when(key % 10 == 0, "Remake").when(key % 10 == 5, "  ").alias("remake"),
                F.when(key % 10 == 0, _pick(key % 3, ["Fit", "Shade", "Broken"])).alias(
                    "remake_reason"
                ),
                F.when(key % 4 == 0, F.concat(F.lit("note "), key.cast("string"))).alias(
                    "work_order_notes"
                ),
            )
        )

    def numbered_cases(self) -> DataFrame:
        """Cases, a third of which share one of forty numbers, as the parts of a split order do."""
        shared = F.concat(F.lit("S"), (F.col("case_id") % 40).cast("string"))
        return self.cases().withColumn("case_number", F.when(F.col("case_id") % 3 == 0, shared).otherwise(F.col("case_number")))

    def locations(self) -> DataFrame:
        """Location of the work done by each supplier, named after its nation."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"), _pick(F.col("s_nationkey"), LOCATIONS).alias("description")
        )

    def case_products(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("case_id"),
            F.col("l_linenumber").alias("case_product_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("source_id"),
            F.col("l_shipdate").alias("line_date"),
            F.col("l_quantity").cast("int").alias("quantity"),
            money(F.col("l_extendedprice")).alias("unit_price"),
            money(F.col("l_extendedprice")).alias("extended_amount"),
            money(F.col("l_discount")).alias("sales_discount"),
            money(F.col("l_tax")).alias("remake_discount"),
            F.when(F.col("l_returnflag") == "R", "R")
            .when(F.col("l_returnflag") == "N", "")
            .alias("remake"),
        )

    def products(self) -> DataFrame:
        category = F.lit(None).cast("string")
        for kind, (even, odd) in CATEGORY_BY_TYPE.items():
            label = F.when(F.col("p_size") % 2 == 0, even).otherwise(odd)
            category = F.when(F.col("p_type") == kind, label).otherwise(category)
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") == 50, "")
            .when(F.col("p_size") == 49, F.lit(None))
            .otherwise(category)
            .alias("category"),
            F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("Rush "), F.col("p_name")))
            .otherwise(F.col("p_name"))
            .alias("description"),
            money(F.col("p_size")).alias("unit_value"),
        )

    def case_tasks(self) -> DataFrame:
        """Tasks of a case from its lines; open tasks have no completion time."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("case_id"),
            F.col("l_linenumber").alias("case_product_id"),
            F.concat(F.lit("task"), F.col("l_linenumber").cast("string")).alias("task"),
            F.concat(F.lit("dept"), (F.col("l_linenumber") % 3).cast("string")).alias("department"),
            F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("complete_date"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("source_id"),
        )

    def task_history(self) -> DataFrame:
        """Completed tasks from the event log; the case number sits in the JSON properties."""
        kind = F.lit(None).cast("string")
        for event, task in TASK_BY_EVENT.items():
            kind = F.when(F.col("event_type") == event, task).otherwise(kind)
        return self.table("events").select(
            F.col("event_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("case_id"),
            F.get_json_object("props", "$.k").alias("case_number"),
            (F.col("event_id") % 5).alias("case_product_id"),
            kind.alias("task"),
            F.col("user_id").cast("string").alias("completed_by"),
            F.col("ts").alias("complete_date"),
            F.when(F.col("event_id") % 10 == 0, "Yes").otherwise("No").alias("rejected"),
            (F.col("event_id") % 3 + 1).cast("int").alias("quantity"),
            F.col("value"),
        )

    def planned_tasks(self) -> DataFrame:
        """Planned durations per case, task and product, several candidates per key."""
        return self.task_history().select(
            "case_id",
            "task",
            "case_product_id",
            money(money(F.col("value")) / 100, 4).alias("duration"),
            F.col("complete_date").alias("planned_at"),
            F.col("event_id").alias("plan_id"),
        )

    def employees(self) -> DataFrame:
        """Customers that occur as users of the event log."""
        users = self.table("events").select("user_id").distinct()
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .join(users, F.col("c_custkey") == F.col("user_id"), "left_semi")
            .select(
                key.alias("employee_id"),
                F.concat(F.lit("Given"), key.cast("string"), F.lit(" Mid Family"), key.cast("string"))
                .alias("staff_name"),
                F.concat(F.lit("payroll "), key.cast("string")).alias("payroll_name"),
                F.when(F.col("c_mktsegment") == "HOUSEHOLD", "z_Not On Report")
                .when(key % 11 != 0, F.col("c_mktsegment"))
                .alias("team"),
                (key % 3).cast("int").alias("training_plan"),
            )
        )

    def timesheets(self) -> DataFrame:
        """Work hours per user and day: distinct active hours of the event log."""
        hours = self.table("events").select(
            F.to_date("ts").alias("date"), "user_id", F.hour("ts").alias("hour")
        )
        return (
            hours.groupBy("date", "user_id")
            .agg(F.count_distinct("hour").alias("active"))
            .select(
                "date",
                F.concat(F.lit("payroll "), F.col("user_id").cast("string")).alias("name"),
                F.when(F.col("user_id") % 17 == 0, 0).otherwise(F.col("active")).cast("double")
                .alias("work_hours"),
            )
        )

    def case_links(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self.table("orders")
            .select(
                key.alias("case_id"),
                (key - 1 - key % 7).alias("link_case_id"),
                F.when(key % 3 == 0, F.concat(F.lit("Remake Of "), (key - 1).cast("string")))
                .otherwise("Split From")
                .alias("notes"),
            )
            .filter("link_case_id >= 0")
        )

    def audit_trail(self) -> DataFrame:
        """Audit events of cases from the lines: several per case, some by machines."""
        user = F.col("l_suppkey") % 23
        name = F.concat(F.lit("User"), user.cast("string"), F.lit(" Surname"), user.cast("string"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("case_id"),
            F.when(user == 0, F.lit(None))
            .when(user == 1, "Web")
            .when(user == 2, "Solo")
            .otherwise(name)
            .alias("created_by"),
            (
                F.col("l_shipdate")
                + F.make_dt_interval(hours=(F.col("l_partkey") % 24).cast("int"))
            ).alias("create_date"),
            _pick((F.col("l_linenumber") % 3), ["New Case", "Accept Remote Case", "Edited"]).alias(
                "type"
            ),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("source_id"),
        )

    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        balance = money(F.col("c_acctbal"))
        zero = money(F.lit(0))

        def bucket(n: int) -> Column:
            return F.when(key % 7 == n, F.lit(None)).when(key % 5 == n, balance).otherwise(zero)

        site = F.concat(F.lit("@practice"), F.floor(key / 2).cast("string"), F.lit(".example"))
        suite = F.when(key % 7 == 0, F.concat(F.lit("Suite "), (key % 20).cast("string")))
        phone = F.concat(F.lit("555-"), F.lpad((key * 7 % 10_000).cast("string"), 4, "0"))
        street = F.concat(key.cast("string"), F.lit(" Main Street"))
        zip_code = F.lpad((key % 100_000).cast("string"), 5, "0")
        nations = (
            self.table("nation")
            .join(
                self.table("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
            )
            .select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
        )
        return (
            self.table("customer")
            .join(nations, "c_nationkey", "left")
            .select(
                key.cast("string").alias("customer_id"),
                F.concat(F.lit("Practice "), F.floor(key / 2).cast("string")).alias("practice_name"),
                F.when(F.col("r_name") != "AFRICA", F.col("r_name")).alias("dental_group"),
                F.when(key % 4 != 0, F.concat(F.lit("First"), key.cast("string"))).alias("first_name"),
                F.concat(F.lit("Last"), (key % 50).cast("string")).alias("last_name"),
                F.concat(F.lit("Rep "), (key % 12).cast("string")).alias("sales_person"),
                F.col("c_mktsegment").alias("type"),
                F.when(key % 3 != 0, _pick(key % 2, ["Ortho", "General"])).alias("specialty"),
                F.concat(F.lit("City "), (key % 40).cast("string")).alias("city"),
                F.col("n_name").alias("state"),
                F.when(key % 11 == 0, F.concat(F.lit("Rep "), (key % 5).cast("string"))).alias("referred_by"),
                F.when(key % 5 != 0, F.concat(F.lit("front"), key.cast("string"), site)).alias("email"),
                phone.alias("office_phone"),
                F.when(key % 3 == 0, F.concat(F.lit("556-"), key.cast("string"))).alias("cell"),
                F.when(key % 4 == 1, phone).alias("fax"),
                street.alias("address1"),
                suite.alias("address2"),
                zip_code.alias("zip_code"),
                F.col("n_name").alias("country"),
                F.when(key % 2 == 0, F.concat(F.lit("Last"), (key % 50).cast("string"))).alias("bill_contact"),
                F.when(key % 6 != 1, F.concat(F.lit("billing"), key.cast("string"), site)).alias("bill_email"),
                phone.alias("bill_phone"),
                street.alias("bill_address1"),
                suite.alias("bill_address2"),
                F.concat(F.lit("City "), (key % 40).cast("string")).alias("bill_city"),
                F.col("n_name").alias("bill_state"),
                zip_code.alias("bill_zip_code"),
                F.col("n_name").alias("bill_country"),
                F.when(key % 12 != 0, F.date_sub(F.lit(AS_OF), (key % 200).cast("int"))).alias("last_payment_date"),
                F.when(key % 6 == 0, "").otherwise(
                    F.concat(F.lit("Catalog "), (key % 4).cast("string"))
                ).alias("price_catalog"),
                (key % 3 != 1).alias("active"),
                (key % 4 == 1).alias("prospect"),
                (key % 89 == 0).alias("deleted"),
                F.when(key % 2 == 0, "North Lab").otherwise("South Lab").alias("lab_name"),
                bucket(0).alias("past_due_30"),
                bucket(1).alias("past_due_60"),
                bucket(2).alias("past_due_90"),
                bucket(3).alias("past_due_over_90"),
                balance.alias("current_balance"),
                (balance * 2).cast("decimal(18,2)").alias("total_balance"),
                F.when(key % 9 != 0, money(key % 30)).alias("unapplied_payments"),
                money(key % 8).alias("unapplied_credits"),
                F.when(key % 5 != 0, money(key % 70)).alias("this_period_charges"),
                money(key % 500).alias("last_payment_amount"),
                (key % 10 == 0).alias("is_on_cod"),
                (key % 6 == 0).alias("on_credit_hold"),
                (key % 4 == 0).alias("in_collection"),
            )
        )

    def customer_dates(self) -> DataFrame:
        """First and last case date of each customer."""
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").cast("string").alias("customer_id"))
            .agg(
                F.to_date(F.min("o_orderdate")).alias("date_of_first_case"),
                F.to_date(F.max("o_orderdate")).alias("date_of_last_case"),
            )
        )

    def sales_summary(self) -> DataFrame:
        """Month, year and lifetime sales per customer as of the pinned day."""
        day = F.to_date("o_orderdate")
        amount = money(F.col("o_totalprice"))
        month = F.trunc(F.lit(AS_OF), "month")
        year = F.trunc(F.lit(AS_OF), "year")

        def total(condition: Column, name: str) -> Column:
            return F.sum(F.when(condition, amount)).alias(name)

        return (
            self.table("orders")
            .filter(day <= F.lit(AS_OF))
            .groupBy(F.col("o_custkey").cast("string").alias("customer_id"))
            .agg(
                total(day >= month, "mtd_sales"),
                total((day >= F.add_months(month, -1)) & (day < month), "lm_sales"),
                total(day >= year, "ytd_sales"),
                total((day >= F.add_months(year, -12)) & (day < year), "ly_sales"),
                F.sum(amount).alias("ltd_sales"),
            )
        )

    def call_notes(self) -> DataFrame:
        """Call notes from the conversations, one per turn."""
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"),
            F.col("text").alias("note"),
            F.date_add(F.lit(date(1998, 1, 1)), (F.col("conv_id") % 160).cast("int")).alias("call_date"),
            F.when(F.col("role") == "user", F.concat((F.col("conv_id") % 90).cast("string"), F.lit(".0")))
            .when(F.col("role") == "assistant", F.col("role"))
            .alias("user_id"),
        )

    def case_calls(self) -> DataFrame:
        """Links of calls to an anchor case and a second case."""
        conv = F.col("conv_id")
        return self.table("conversations").select(
            (conv * 1000 + F.col("turn")).alias("call_id"),
            F.when(conv % 6 != 0, conv * 5 + F.col("turn")).alias("anchor_case_id"),
            F.when(conv % 4 != 0, conv * 3).alias("link_case_id"),
        )

    def case_documents(self) -> DataFrame:
        """Case documents from the document table: one file, several files, folders and links."""
        key = F.col("doc_id")
        text = key.cast("string")
        shape = key % 6
        return self.table("documents").select(
            key.alias("case_id"),
            F.when(shape == 0, F.concat(F.lit("\\Feb\\24\\doc_"), text, F.lit(".pdf")))
            .when(shape == 1, F.concat(F.lit("\\"), text, F.lit("\\Upload_1\\")))
            .when(shape == 2, F.concat(F.lit("//store/files/Designs/"), text, F.lit("/")))
            .when(shape == 3, F.concat(F.lit("https://host.example/"), text))
            .otherwise(F.concat(F.lit("modelscans/"), text, F.lit("/")))
            .alias("file_path"),
            F.when(shape == 0, F.concat(F.lit("doc_"), text, F.lit(".pdf")))
            .when(shape == 1, F.concat(F.lit("upper "), text, F.lit(".stl  lower.jpeg photo one.png")))
            .when(shape == 2, F.concat(F.lit("plan"), text, F.lit("  notes  sketch")))
            .when(shape == 3, F.lit("link"))
            .otherwise(F.concat(F.lit("scan a"), text, F.lit(".ply b.ply")))
            .alias("source_file_name"),
            F.when(shape == 0, "CaseDocuments")
            .when(shape == 1, "Digital Impression")
            .when(shape == 2, "Design")
            .when(shape == 3, F.lit(None))
            .when(shape == 4, "Model Scan")
            .otherwise("Archive")
            .alias("repository"),
            (shape == 3).alias("is_url"),
            F.when(shape.isin(1, 2), 3).when(shape == 4, 2).when(shape == 5, 4).otherwise(1)
            .alias("file_count"),
            (key % 50 == 0).alias("deleted"),
        )

    def preferences(self) -> DataFrame:
        """Department preferences of customers, several versions per department."""
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.concat(F.lit("dept"), (F.col("o_orderkey") % 3).cast("string")).alias("department"),
            F.col("o_orderpriority").alias("preference"),
            F.col("o_orderkey").cast("string").alias("preference_value"),
            F.col("o_orderdate").alias("create_date"),
            F.col("o_orderkey").alias("preference_id"),
        )

    def goals(self) -> DataFrame:
        """Monthly revenue goals per year: the average order value times a fixed case count."""
        months = (
            self.table("orders")
            .select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
            .distinct()
        )
        return months.filter("year <> 1996").select(
            "year", "month", money(F.col("month") * 100000 + 5000000).alias("revenue_goal")
        )
