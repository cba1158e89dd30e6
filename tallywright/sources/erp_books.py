"""Binding of the accounting system's own tables to the logical books.

Table and column names are those of the source database. Ids stay as they are (opaque text,
never trimmed or case-folded); money becomes DECIMAL(18,2) before anything is summed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money
from ..functions.text import canonical_account_no
from ..schemas import RATE, Books

TABLES = (
    "facturas",
    "facturasitems",
    "productos",
    "monedacotizaciones",
    "talonarios",
    "contactos",
    "empresas",
    "industriaysub",
    "tiposysub",
    "asientos",
    "asientositems",
    "cuentascontables",
    "compras",
    "comprasitems",
    "fiscal",
    "movimientos",
)


def _as(**names: str) -> list[Column]:
    return [F.col(source).alias(target) for target, source in names.items()]


def erp_books(
    t: Mapping[str, DataFrame], policy: DataFrame | None = None, categories: DataFrame | None = None
) -> Books:
    def companies() -> DataFrame:
        return t["empresas"].select(*_as(company_id="IDEmpresa", company="Empresa"))

    def contacts() -> DataFrame:
        return t["contactos"].select(
            *_as(
                contact_id="IDContacto",
                company_id="IDEmpresa",
                first_name="Nombre",
                last_name="Apellido",
                email="Correo",
                created_at="FechaCreacion",
                modified_at="FechaModificacion",
            )
        )

    def industries() -> DataFrame:
        return t["industriaysub"].select(*_as(company_id="IDRef", segment="Valor"))

    def types() -> DataFrame:
        return t["tiposysub"].select(*_as(company_id="IDRef", party_type="Valor"))

    def fiscal() -> DataFrame:
        return t["fiscal"].select(
            *_as(fiscal_id="RecID", party="RazonSocial", tax_id="NroImpuesto1", company_id="IDRef")
        )

    def purchases() -> DataFrame:
        return t["compras"].select(
            *_as(
                purchase_id="RecID",
                contact_id="IDRef",
                fiscal_id="IDFiscal",
                created_at="FechaCreacion",
                number="Numero",
                branch_no="NroSucursal",
                rate_id="IDCotizacionMoneda",
            ),
            F.col("Estado").cast("int").alias("state"),
            F.col("TipoComprobante").cast("int").alias("voucher_type"),
        )

    def products() -> DataFrame:
        return t["productos"].select(
            *_as(product_id="RecID", code="Codigo", product="Descripcion", product_kind="TipoProducto")
        )

    def accounts() -> DataFrame:
        return t["cuentascontables"].select(
            F.col("RecID").alias("account_id"),
            canonical_account_no(F.col("Numero")).alias("account_no"),
            canonical_account_no(F.col("Numero")).alias("class_code"),
            canonical_account_no(F.col("Numero")).alias("category_key"),
            F.col("Descripcion").alias("account_name"),
            F.col("Nivel").alias("level"),
            F.col("Imputable").cast("int").alias("postable"),
        )

    def invoices() -> DataFrame:
        return t["facturas"].select(
            *_as(
                invoice_id="RecID",
                contact_id="IDRef",
                branch_id="IDTalonario",
                rate_id="IDCotizacionMoneda",
                issued_at="FechaEmision",
                number="Numero",
            ),
            F.col("Tipo").cast("int").alias("doc_type"),
            F.col("TipoMultitipo").cast("int").alias("letter_code"),
            F.col("Estado").cast("string").alias("status"),
            F.col("Descuento").cast("double").alias("discount_pct"),
        )

    books = {
        "invoice": lambda: invoices(),
        "invoice_line": lambda: t["facturasitems"].select(
            *_as(invoice_id="IdFactura", product_id="IDProducto"), money(F.col("ImportePrecio2")).alias("price")
        ),
        "product": lambda: products(),
        "fx_rate": lambda: t["monedacotizaciones"].select(
            F.col("RecID").alias("rate_id"), F.col("CotMoneda2").cast(RATE).alias("rate")
        ),
        "branch": lambda: t["talonarios"].select(
            F.col("RecID").alias("branch_id"), F.col("NroSucursal").cast("int").alias("branch_no")
        ),
        "customer_card": lambda: contacts().join(companies(), "company_id", "left").select("contact_id", "company"),
        "journal": lambda: t["asientos"].select(
            *_as(
                journal_id="RecID",
                accounting_at="Fecha",
                loaded_at="FechaCreacion",
                origin_id="IDOrigen",
                detail="Descripcion",
            ),
            F.col("TipoOrigen").cast("int").alias("origin_code"),
        ),
        "journal_line": lambda: t["asientositems"].select(
            *_as(journal_id="IDAsiento", account_id="IDCuentaContable", movement_id="IDMovimiento", line_kind="Tipo"),
            F.col("TipoSaldo").cast("int").alias("side"),
            money(F.col("Importe1")).alias("amount"),
        ),
        "account": lambda: accounts(),
        "origin_party": lambda: purchases().join(fiscal().drop("company_id"), "fiscal_id", "left").select(
            F.col("purchase_id").alias("origin_id"), "party"
        ),
        "movement": lambda: t["movimientos"].select(*_as(movement_id="RecID", fiscal_id="IDFiscalCliente")),
        "fiscal_party": lambda: fiscal(),
        "contact": lambda: contacts(),
        "company": lambda: companies(),
        "industry": lambda: industries(),
        "party_type": lambda: types(),
        "contact_invoice": lambda: invoices().select("contact_id", "issued_at"),
        "supplier_contact": lambda: contacts().select("contact_id", "company_id", "created_at", "modified_at"),
        "supplier_company": lambda: companies(),
        "supplier_type": lambda: types(),
        "purchase": lambda: purchases(),
        "purchase_line": lambda: t["comprasitems"].select(
            *_as(purchase_id="IDCompra", product_id="IDProducto"), money(F.col("ImportePrecio1")).alias("price")
        ),
    }
    if policy is not None:
        books["account_policy"] = lambda: policy
    if categories is not None:
        books["account_category"] = lambda: categories
    return Books(books)
