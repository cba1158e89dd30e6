"""Business rules as data.

Operators hold no business values of their own. Each one takes a ``Rules`` object, so
another company, chart of accounts or test table set is another ``Rules`` instance.
SQL-text fields (``*_sql``) are Spark SQL expressions over the logical columns named in
``schemas.py``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class PartyOverride:
    """Rows of this party belong to ``unit``; ``find`` in the concept becomes ``replace``."""

    party: str
    unit: str
    find: str = ""
    replace: str = ""


@dataclass(frozen=True)
class DetailOverride:
    """Rows with exactly this detail text belong to ``unit`` under ``concept``."""

    detail: str
    unit: str
    concept: str


@dataclass(frozen=True)
class Rules:
    # business units
    unit_a: str
    unit_b: str
    unit_other: str
    branch_units: dict[int, str]
    # sales; customer_units: (text in the customer's name, unit), which beats the branch
    sales_since: dt.date
    cancelled_status: str
    excluded_codes: tuple[str, ...]
    # ledger
    ledger_since: dt.date
    first_month: dt.date
    origin_labels: dict[int, str]
    closing_origins: tuple[int, ...]
    noise_texts: tuple[tuple[str, str], ...]
    detail_sql: str
    # payroll
    accrual_kinds: dict[str, str]
    accrual_unit_sql: str
    liability_units: dict[str, str]
    pool_codes: tuple[str, ...]
    union_codes: tuple[str, ...]
    closing_text: str
    subclass_key_sql: str
    subclass_labels: dict[str, str]
    subclass_pivot_labels: dict[str, str]
    # expenses
    name_units: tuple[tuple[str, str], ...]
    upkeep_pattern: str
    expense_origin: str
    expense_exceptions: tuple[tuple[str, str], ...]
    expense_noise_text: str
    reversal_text: str
    party_overrides: tuple[PartyOverride, ...] = ()
    detail_overrides: tuple[DetailOverride, ...] = ()
    customer_units: tuple[tuple[str, str], ...] = ()
    # older long-format products
    long_codes: tuple[str, ...] = ()
    label_unit_pattern: str = ""
    label_pattern: str = ""
    closing_entry_text: str = ""
    excluded_concept_text: str = ""
    excluded_accounts: tuple[str, ...] = ()
    # account numbers above this value are result accounts
    result_accounts_above: int = 42100000
    concept_order: tuple[str, ...] = field(default=())
    concept_order_old: tuple[str, ...] = field(default=())

    @property
    def units(self) -> tuple[str, str]:
        """Units that appear in a P&L."""
        return (self.unit_a, self.unit_b)

    @property
    def all_pool_codes(self) -> tuple[str, ...]:
        return self.pool_codes + self.union_codes


# Labels that appear in results.
SALES_CONCEPT = "Ventas netas - "
SALARIES = "Sueldos"
CHARGES = "Cargas Sociales"
UNION_DUES = "Sindicato"
UNCLASSIFIED = "Sin Clasificar"
UNCLASSIFIED_PIVOT = "(sin clasificar)"
DETAIL_ACCRUED = "Cuenta Devengado"
DETAIL_LIABILITY = "Cuenta patrimonial"
ORIGIN_SALES = "Ventas"
ORIGIN_PAYROLL = "Sueldos"
ORIGIN_EXPENSES = "Compras"
GROUP_SALES = "1.Ventas"
GROUP_PAYROLL = "2.RRHH"
GROUP_EXPENSES = "3.Egresos"
DEFAULT_CATEGORY = "1.VENTAS"
PAYROLL_CATEGORY = "2.Sueldos y Cargas Sociales"
SUPPLIER_TYPE = "PROVEEDOR"
RESULT_LABEL = "Resultado"
SCOPE_ALL = "Gral."
PAYROLL_WORDS_OLD = ("Sueldos Y Jornales", CHARGES, UNION_DUES)
MARGIN_SECTION = "4.Margen"
MARGIN_LABEL = "MARGEN OPERATIVO"
MARGIN_PCT_LABEL = "Margen %"
MONTH_NAMES = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")
PURCHASE_STATES = {0: "Pendiente", 1: "Pagado", 2: "Anulado"}
VOUCHER_TYPES = {0: "Factura", 1: "Nota de Credito", 2: "Nota de Debito"}
OTHER_CODE = "Otro"
DOCUMENT_TYPES = {0: "Factura", 1: "Nota de Crédito", 2: "Nota de Débito"}
DOCUMENT_OTHER = "Comprobante"
DOCUMENT_LETTERS = {1: "A", 2: "B", 3: "C", 4: "E", 5: "M"}


# Origin codes of a journal entry.
ORIGIN_LABELS = {
    1: "Recibo",
    2: "ComprobanteFondo",
    3: "Deposito",
    4: "Pago",
    5: "ChequePropio",
    6: "ChequeTercero",
    7: "Factura",
    8: "Compra",
    9: "Asiento Resumen",
    10: "AsientoCierreResultado",
    11: "AsientoCierrePatrimonio",
    12: "Ajuste",
}


# Rules of the regional two-unit company. Account numbers, branch numbers, text
# marks and labels of its accounting system. Party and detail overrides name real parties, so
# they are not kept here: pass them with ``dataclasses.replace(REGIONAL, party_overrides=...)``.
REGIONAL = Rules(
    unit_a="Bs.As.",
    unit_b="Salta",
    unit_other="Otros",
    branch_units={3: "Bs.As.", 8: "Bs.As.", 4: "Salta"},
    sales_since=dt.date(2024, 1, 1),
    cancelled_status="6",
    excluded_codes=("4.VEH.10.5 BSAS", "4.VEH.10.5"),
    ledger_since=dt.date(2024, 1, 1),
    first_month=dt.date(2024, 1, 1),
    origin_labels=ORIGIN_LABELS,
    closing_origins=(10, 11),
    noise_texts=(("infl", "INFL"), ("reversion", "REVERS"), ("provision", "PROV")),
    detail_sql="detail",
    accrual_kinds={
        "42101029": SALARIES,
        "42102023": SALARIES,
        "42201029": SALARIES,
        "42202023": SALARIES,
        "42101009": CHARGES,
        "42102005": CHARGES,
        "42201009": CHARGES,
        "42202005": CHARGES,
    },
    accrual_unit_sql="CASE WHEN account_no LIKE '421%' THEN 'Bs.As.' ELSE 'Salta' END",
    liability_units={"21301001": "Bs.As.", "21301002": "Salta"},
    pool_codes=("21302001", "21302002", "21302004", "21302005", "21302006"),
    union_codes=("21302007", "21302008", "21302009", "21302010"),
    closing_text="Asiento|ASTO DE",
    subclass_key_sql="account_no",
    subclass_labels={
        "42101": "Consultoría y Operaciones",
        "42102": "Administración",
        "42201": "Consultoría y Operaciones",
        "42202": "Administración",
    },
    subclass_pivot_labels={"42101": "Consultoría y operaciones", "42102": "Administración"},
    name_units=(("Bs.As.", "BSAS|BS AS"), ("Salta", "PAT|SALTA")),
    upkeep_pattern="Mantenimiento|mantenimiento",
    expense_origin="Compra",
    expense_exceptions=(("42102025", "ComprobanteFondo"),),
    expense_noise_text="INFL",
    reversal_text="(?iu)nota de crédito|anulación",
    long_codes=("42101009", "42101029", "42201009", "42201029", "42102005", "42102023"),
    label_unit_pattern=r"(?i)Bs\.As\.|Bs As|Bsas|Ventas netas - Otros",
    label_pattern="Bs.As.|Bs As|Bsas|Ventas netas - Otros",
    closing_entry_text="Asiento de cierre",
    excluded_concept_text="Amortizaciones|Armotizaciones",
    excluded_accounts=("42105001", "42301016"),
    concept_order=(
        "00-Ventas netas - Bs.As.",
        "00-Ventas netas - Salta",
        "00-Ventas netas - Otros",
        "01-Sueldos - Salta",
        "01-Sueldos Consultoría y operaciones - Bs.As.",
        "01-Sueldos Administración - Bs.As.",
        "01-Sueldos (sin clasificar) - Bs.As.",
        "01-Cargas Sociales - Salta",
        "01-Cargas Sociales Consultoría y operaciones - Bs.As.",
        "01-Cargas Sociales Administración - Bs.As.",
        "01-Cargas Sociales (sin clasificar) - Bs.As.",
    ),
    concept_order_old=(
        "Ventas netas - Bs.As.",
        "Ventas netas - Salta",
        "Ventas netas - Otros",
        "Sueldos Y Jornales A Pagar Patogenicos",
        "Sueldos Y Jornales A Pagar Bs As",
        "Sindicato - Bs.As.",
        "Sindicato - Salta",
        "Cargas Sociales - Bs.As.",
        "Cargas Sociales - Salta",
    ),
)


# Rules for the order/line-item tables (see sources/order_books.py for the binding).
ORDERS = Rules(
    unit_a="A",
    unit_b="B",
    unit_other="Otros",
    branch_units={3: "A", 8: "A", 4: "B"},
    sales_since=dt.date(1996, 1, 1),
    cancelled_status="P",
    excluded_codes=("Brand#12", "Brand#13"),
    ledger_since=dt.date(1996, 1, 1),
    first_month=dt.date(1996, 1, 1),
    origin_labels={1: "Compra", 2: "ComprobanteFondo", 3: "Factura", 4: "AsientoCierreResultado"},
    closing_origins=(4,),
    noise_texts=(("infl", " HOT "), ("reversion", " COLD "), ("provision", " A$")),
    detail_sql="concat_ws(' ', priority, item_name, line_flag)",
    accrual_kinds={"Brand#3": SALARIES, "Brand#4": SALARIES, "Brand#5": CHARGES, "Brand#6": CHARGES},
    accrual_unit_sql=(
        "CASE WHEN account_name RLIKE '^(STANDARD|ECONOMY) ' THEN 'A' "
        "WHEN account_name RLIKE '^(MEDIUM|PROMO) | RED ' THEN 'B' END"
    ),
    liability_units={"Brand#7": "A", "Brand#8": "B"},
    pool_codes=("Brand#9",),
    union_codes=("Brand#10",),
    closing_text="NOT SPECIFIED",
    subclass_key_sql="account_name",
    subclass_labels={"ECONO": "Operaciones", "STAND": "Administracion", "MEDIU": "Operaciones"},
    subclass_pivot_labels={"ECONO": "Operaciones", "STAND": "Administracion"},
    name_units=(("A", "^(STANDARD|ECONOMY) "), ("B", "^(MEDIUM|PROMO) | RED ")),
    upkeep_pattern="Gear|gear",
    expense_origin="Compra",
    expense_exceptions=(("Brand#11", "ComprobanteFondo"),),
    expense_noise_text=" hot ",
    reversal_text="(?i) r$",
    party_overrides=(
        PartyOverride("SUPPLIER#000000003", "B", "Economy ", "Promo "),
        PartyOverride("SUPPLIER#000000007", "B", "Standard ", "Medium "),
    ),
    detail_overrides=(DetailOverride("1-URGENT old gear N", "B", "01-Otros DA"),),
    long_codes=("Brand#3", "Brand#5"),
    label_unit_pattern="(?i)Standard|Economy|Ventas netas - Otros",
    label_pattern="Ventas netas - A|Ventas netas - Otros|Standard|Economy",
    closing_entry_text="NOT SPECIFIED",
    excluded_concept_text="Anvil|Plate",
    excluded_accounts=("400000000011", "400000000012"),
    result_accounts_above=399999999999,
    concept_order=(
        "00-Ventas netas - A",
        "00-Ventas netas - B",
        "00-Ventas netas - Otros",
        "01-Sueldos - B",
        "01-Sueldos Operaciones - A",
        "01-Sueldos Administracion - A",
        "01-Sueldos (sin clasificar) - A",
        "01-Cargas Sociales - B",
        "01-Cargas Sociales Operaciones - A",
        "01-Cargas Sociales Administracion - A",
        "01-Cargas Sociales (sin clasificar) - A",
    ),
    concept_order_old=(
        "Ventas netas - A",
        "Ventas netas - B",
        "Ventas netas - Otros",
        "Sindicato - A",
        "Sindicato - B",
        "Cargas Sociales - A",
        "Cargas Sociales - B",
    ),
)
