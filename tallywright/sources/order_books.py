"""Binding of the order / line-item tables to the logical books.

``orders`` and ``lineitem`` carry two books at once: invoices with their lines, and a journal
with its postings. ``part`` is the product list and the chart of accounts, ``customer`` the
customers, ``supplier`` the suppliers. Every entity is a lazy projection of the given tables;
the only literal table is the list of exchange rates, one row per region.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import money
from ..schemas import RATE, Books
from .tables import load_tables

# Rate by region key. Region 4 has none on purpose: its sales have a null amount.
FX_RATES = {0: "1.0000", 1: "1.2500", 2: "0.8000", 3: "1.1000"}
# Category by account type. LARGE has none on purpose: it takes the default.
CATEGORIES = {
    "STANDARD": "3.Servicios",
    "ECONOMY": "3.Servicios",
    "MEDIUM": "4.Insumos",
    "PROMO": "5.Comerciales",
    "SMALL": "4.Insumos",
}
STATES = {"O": 0, "F": 1, "P": 2}
VOUCHERS = {"N": 0, "R": 1, "A": 2}


def _code(column: str, codes: dict[str, int]):
    chain = None
    for text, code in codes.items():
        chain = F.when(F.col(column) == text, code) if chain is None else chain.when(F.col(column) == text, code)
    return chain


def _literal(rows: dict, key: str, value: str) -> DataFrame:
    """A rule table as VALUES: Spark knows its size and folds it into the plan."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    values = ", ".join(f"({k!r}, {v!r})" for k, v in rows.items())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({key}, {value})")


def load_order_books(spark: SparkSession, folder: str) -> Books:
    return order_books(load_tables(spark, folder))


def order_books(t: Mapping[str, DataFrame]) -> Books:
    priority_digit = F.substring("o_orderpriority", 1, 1).cast("int")
    # first digit: account class (1 asset, 4 result)
    account_class = F.when(F.col("p_type") == "LARGE", "1").otherwise("4")
    account_no = F.concat(account_class, F.lpad(F.col("p_partkey").cast("string"), 11, "0"))
    account_name = F.upper(F.concat_ws(" ", "p_type", "p_name"))

    def nation() -> DataFrame:
        # 25 rows at every scale, so a join with it is a lookup
        return t["nation"]

    def sales_customers() -> DataFrame:
        return t["customer"].join(
            F.broadcast(nation()), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )

    def order_line() -> DataFrame:
        return t["lineitem"].select(
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_partkey").alias("product_id"),
            money(F.col("l_extendedprice")).alias("price"),
            (F.col("l_discount") * 100).alias("discount_pct"),
            _code("l_returnflag", VOUCHERS).alias("doc_type"),
        )

    def purchases() -> DataFrame:
        return t["orders"].select(
            F.col("o_orderkey").alias("purchase_id"),
            F.col("o_orderkey").alias("number"),
            F.col("o_orderdate").alias("created_at"),
            _code("o_orderstatus", STATES).alias("state"),
        )

    def purchase_lines() -> DataFrame:
        # supplier and voucher type belong to the line here
        return t["lineitem"].select(
            F.col("l_orderkey").alias("purchase_id"),
            F.col("l_suppkey").alias("contact_id"),
            F.col("l_suppkey").alias("fiscal_id"),
            F.col("l_partkey").alias("product_id"),
            _code("l_returnflag", VOUCHERS).alias("voucher_type"),
            money(F.col("l_extendedprice")).alias("price"),
        )

    def order_dates() -> DataFrame:
        return t["orders"].groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("modified_at")
        )

    def supplier_dates() -> DataFrame:
        return purchase_lines().join(purchases(), "purchase_id").groupBy("contact_id").agg(
            F.min("created_at").alias("created_at"), F.max("created_at").alias("modified_at")
        )

    def customer_nation() -> DataFrame:
        return t["customer"].select(
            F.col("c_nationkey").alias("company_id"), F.col("c_mktsegment").alias("segment")
        )

    books = {
        "invoice": lambda: t["orders"].select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("contact_id"),
            F.col("o_orderdate").alias("issued_at"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderkey").alias("number"),
            priority_digit.alias("letter_code"),
        ),
        "invoice_line": lambda: order_line(),
        "product": lambda: t["part"].select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("code"),
            F.col("p_name").alias("product"),
            F.col("p_type").alias("product_kind"),
        ),
        "fx_rate": lambda: _literal(FX_RATES, "rate_id", "rate").withColumn("rate", F.col("rate").cast(RATE)),
        "branch": lambda: nation().select(F.col("n_nationkey").alias("branch_id"), F.col("n_nationkey").alias("branch_no")),
        "customer_card": lambda: sales_customers().select(
            F.col("c_custkey").alias("contact_id"),
            F.col("c_name").alias("company"),
            F.col("c_nationkey").alias("branch_id"),
            F.col("n_regionkey").alias("rate_id"),
        ),
        "journal": lambda: t["orders"].select(
            F.col("o_orderkey").alias("journal_id"),
            F.col("o_orderdate").alias("accounting_at"),
            priority_digit.alias("origin_code"),
            F.col("o_orderpriority").alias("priority"),
        ),
        "journal_line": lambda: t["lineitem"].select(
            F.col("l_orderkey").alias("journal_id"),
            F.col("l_partkey").alias("account_id"),
            F.col("l_suppkey").alias("origin_id"),
            F.col("l_suppkey").alias("movement_id"),
            F.col("l_shipdate").alias("loaded_at"),
            _code("l_linestatus", {"O": 0, "F": 1}).alias("side"),
            money(F.col("l_extendedprice")).alias("amount"),
            F.col("l_returnflag").alias("line_flag"),
        ),
        "account": lambda: t["part"].select(
            F.col("p_partkey").alias("account_id"),
            account_no.alias("account_no"),
            F.col("p_brand").alias("class_code"),
            account_name.alias("account_name"),
            F.col("p_name").alias("item_name"),
            F.col("p_type").alias("category_key"),
            F.col("p_size").cast("string").alias("level"),
            F.when(F.col("p_size") > 25, 1).otherwise(0).alias("postable"),
        ),
        "account_policy": lambda: t["part"].select(
            F.concat(account_no, F.lit(".0")).alias("account_no"),
            account_name.alias("account_name"),
            F.when(F.col("p_size") <= 15, "Si")
            .when(F.col("p_size") <= 30, " si ")
            .when(F.col("p_size") <= 40, "Sí")
            .otherwise("No")
            .alias("consider"),
        ),
        "account_category": lambda: _literal(CATEGORIES, "category_key", "category"),
        "origin_party": lambda: t["supplier"].select(F.col("s_suppkey").alias("origin_id"), F.col("s_name").alias("party")),
        "movement": lambda: t["supplier"].select(
            F.col("s_suppkey").alias("movement_id"), F.col("s_suppkey").alias("fiscal_id")
        ),
        "fiscal_party": lambda: t["supplier"].select(
            F.col("s_suppkey").alias("fiscal_id"),
            F.col("s_name").alias("party"),
            F.concat_ws("-", F.lit("30"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("tax_id"),
            F.col("s_nationkey").alias("company_id"),
        ),
        "contact": lambda: t["customer"]
        .join(order_dates(), F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("contact_id"),
            F.col("c_nationkey").alias("company_id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.when(F.col("c_acctbal") >= 0, F.concat(F.lower("c_name"), F.lit("@example.org"))).alias("email"),
            "created_at",
            "modified_at",
        ),
        "company": lambda: nation().select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company")),
        "industry": lambda: customer_nation().distinct(),
        "party_type": lambda: nation().select(
            F.col("n_nationkey").alias("company_id"),
            F.when(F.col("n_regionkey") < 3, "CLIENTE").otherwise("OTRO").alias("party_type"),
        ),
        "contact_invoice": lambda: t["orders"]
        .filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("date")))
        .select(F.col("o_custkey").alias("contact_id"), F.col("o_orderdate").alias("issued_at")),
        "supplier_contact": lambda: t["supplier"]
        .join(supplier_dates(), F.col("s_suppkey") == F.col("contact_id"), "left")
        .select(
            F.col("s_suppkey").alias("contact_id"),
            F.col("s_suppkey").alias("company_id"),
            "created_at",
            "modified_at",
        ),
        "supplier_company": lambda: t["supplier"].select(
            F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company")
        ),
        "supplier_type": lambda: t["supplier"].select(
            F.col("s_suppkey").alias("company_id"),
            F.when(F.col("s_acctbal") >= 2500, "PROVEEDOR").otherwise("OTRO").alias("party_type"),
        ),
        "purchase": lambda: purchases(),
        "purchase_line": lambda: purchase_lines(),
    }
    return Books(books)
