"""Reference SQL for the catalogued queries, for an ANSI engine over the same tables.

Written apart from the DataFrame code and in another style (windows where the plans aggregate,
anti-joins where they flag), so that agreement means something. Rule values come in by name
from ``rules.ORDERS`` only where a list would otherwise be repeated.
"""

from __future__ import annotations

from ..rules import ORDERS as R
from .queries import PAYROLL_CODES, TOP_N, YEARS

# written apart from the list of the code under test
REPORT_MONTHS = tuple(f"{year}-{month:02d}" for year in range(1996, 2002) for month in range(1, 13))


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _cash(expression: str) -> str:
    return f"CAST(ROUND({expression}, 2) AS DOUBLE)"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _pivot(value: str, months=REPORT_MONTHS, month: str = "month") -> str:
    cells = [f"{_cash(f'SUM(CASE WHEN {month} = {m!r} THEN {value} END)')} AS \"{m}\"" for m in months]
    return ", ".join(cells) + f", {_cash(f'SUM(CASE WHEN {month} NOT IN ({_list(months)}) THEN {value} END)')} AS other_months"


YEAR_TEST = f"CAST(substr(month, 1, 4) AS INT) IN ({', '.join(map(str, YEARS))})"
UNIT_A = f"regexp_matches(account_name, '{dict(R.name_units)['A']}')"
UNIT_B = f"regexp_matches(account_name, '{dict(R.name_units)['B']}')"
NAME_UNIT = f"CASE WHEN {UNIT_A} THEN 'A' WHEN {UNIT_B} THEN 'B' END"
TITLE = "array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split({0}, ' ')], ' ')"
CONCEPT = TITLE.format("account_name")
BRANCH_UNIT = "CASE WHEN c_nationkey IN (3, 8) THEN 'A' WHEN c_nationkey = 4 THEN 'B' ELSE '{0}' END"
PREFIX = (
    "CASE WHEN regexp_matches({0}, '^[0-9][0-9]-') THEN {0} WHEN {0} LIKE '%Ventas netas%' THEN '00-' || {0} "
    "WHEN {0} LIKE '%{1}%' OR {0} LIKE '%Cargas Sociales%' OR {0} LIKE '%Sindicato%' THEN '01-' || {0} ELSE '02-' || {0} END"
)
GROUP = (
    "CASE WHEN concept LIKE '00-%' THEN '1.Ventas' WHEN concept LIKE '01-%' THEN '2.RRHH' ELSE '3.Egresos' END"
)
ORIGIN = (
    "CASE origin_code WHEN 1 THEN 'Compra' WHEN 2 THEN 'ComprobanteFondo' WHEN 3 THEN 'Factura' "
    "WHEN 4 THEN 'AsientoCierreResultado' END"
)
NOISE = (
    "CASE WHEN origin_code = 4 THEN 'cierre' WHEN contains(upper(detail), ' HOT ') THEN 'infl' "
    "WHEN contains(upper(detail), ' COLD ') THEN 'reversion' WHEN l_returnflag = 'A' THEN 'provision' ELSE 'base' END"
)

FX = "fx(rate_id, rate) AS (VALUES (0, 1.0000), (1, 1.2500), (2, 0.8000), (3, 1.1000))"


def _sales(other: str = "Otros", owned_by_b: str = "FALSE") -> tuple[str, ...]:
    return (
        FX,
        f"""sales AS (
  SELECT o_orderkey AS invoice_id, CASE WHEN {owned_by_b} THEN 'B' ELSE {BRANCH_UNIT.format(other)} END AS unit, o_orderdate AS issued_at,
         strftime(o_orderdate, '%Y-%m') AS month, c_name AS party,
         (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)
           * (CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(rate AS DECIMAL(10,4)) * CAST(1 - l_discount * 100 / 100 AS DECIMAL(8,6))) AS amount,
         CASE l_returnflag WHEN 'N' THEN 'Factura' WHEN 'R' THEN 'Nota de Crédito' WHEN 'A' THEN 'Nota de Débito' ELSE 'Comprobante' END
           || ' (' || CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' WHEN '4' THEN 'E' WHEN '5' THEN 'M' END || ') '
           || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS detail
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN fx ON rate_id = n_regionkey
  WHERE o_orderstatus <> 'P' AND o_orderdate >= DATE '1996-01-01' AND p_brand NOT IN ('Brand#12', 'Brand#13'))""",
        """sales_month AS (
  SELECT unit, month, 'Ventas netas - ' || unit AS concept, CAST(COALESCE(SUM(amount), 0) AS DECIMAL(28,6)) AS amount,
         COALESCE(SUM(amount), 0) AS exact_amount FROM sales GROUP BY unit, month)""",
    )


SALES = _sales()

LINES = f"""lines AS (
  SELECT o_orderkey AS journal_id, o_orderdate AS accounting_at, l_shipdate AS loaded_at,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS side,
         CASE p_type WHEN 'LARGE' THEN '1' ELSE '4' END || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS account_no, p_brand AS class_code,
         upper(p_type || ' ' || p_name) AS account_name, p_size, p_type,
         CAST(substr(o_orderpriority, 1, 1) AS INT) AS origin_code, l_returnflag,
         o_orderpriority || ' ' || p_name || ' ' || l_returnflag AS detail, s_name AS party,
         strftime(o_orderdate, '%Y-%m') AS accounting_month, strftime(l_shipdate, '%Y-%m') AS load_month
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey)"""
LEDGER = f"""ledger AS (
  SELECT *, {CONCEPT} AS concept, {NAME_UNIT} AS name_unit, {ORIGIN} AS origin, {NOISE} AS category
  FROM lines WHERE loaded_at >= DATE '1996-01-01')"""
BOOK = (LINES, LEDGER)

SUBCLASS = "CASE substr(account_name, 1, 5) WHEN 'ECONO' THEN 'Operaciones' WHEN 'STAND' THEN 'Administracion' WHEN 'MEDIU' THEN 'Operaciones' ELSE 'Sin Clasificar' END"
SPLIT = "CASE substr(account_name, 1, 5) WHEN 'ECONO' THEN ' Operaciones' WHEN 'STAND' THEN ' Administracion' ELSE '' END"
ACCRUAL = (
    f"""accrual_rows AS (
  SELECT name_unit AS unit, CASE WHEN class_code IN ('Brand#3', 'Brand#4') THEN 'Sueldos' ELSE 'Cargas Sociales' END AS kind,
         {SUBCLASS} AS subclass, {SPLIT} AS split, account_no, accounting_at, accounting_month AS month, category, origin,
         CASE side WHEN 0 THEN amount WHEN 1 THEN -amount END AS amount
  FROM ledger WHERE class_code IN ({_list(R.accrual_kinds)}) AND name_unit IS NOT NULL
    AND category IN ('base', 'provision'))""",
    """flagged AS (
  SELECT *, COALESCE(SUM(CASE WHEN category = 'base' THEN amount END) OVER (PARTITION BY account_no, month), 0) <> 0 AS use_base
  FROM accrual_rows)""",
    "kept AS (SELECT * FROM flagged WHERE (category = 'base') = use_base)",
    "cut AS (SELECT MAX(month) AS cutoff FROM kept WHERE kind = 'Sueldos')",
    """closed AS (
  SELECT kept.*, kind || CASE WHEN unit = 'A' THEN split ELSE '' END || ' - ' || unit AS concept
  FROM kept, cut WHERE month <= cutoff AND month >= '1996-01')""",
)
LIABILITY = (
    """owed AS (
  SELECT CASE class_code WHEN 'Brand#7' THEN 'A' ELSE 'B' END AS unit, load_month AS month, amount, loaded_at, account_no, concept, origin
  FROM ledger WHERE class_code IN ('Brand#7', 'Brand#8') AND side = 0 AND detail NOT LIKE '%NOT SPECIFIED%')""",
    """pool AS (SELECT load_month AS month, SUM(amount) AS pool FROM ledger
  WHERE class_code IN ('Brand#9', 'Brand#10') AND side = 0 GROUP BY 1)""",
    """late AS (
  SELECT unit, month, amount, CAST(amount AS DOUBLE) / CAST(SUM(amount) OVER (PARTITION BY month) AS DOUBLE) AS share
  FROM (SELECT unit, month, SUM(amount) AS amount FROM owed, cut WHERE month > cutoff GROUP BY unit, month))""",
    """late_charges AS (
  SELECT unit, month, CAST(COALESCE(CAST(pool AS DOUBLE), 0) * share AS DECIMAL(28,6)) AS amount FROM late LEFT JOIN pool USING (month))""",
)
SUFFIX = "CASE WHEN unit = 'A' THEN ' (sin clasificar)' ELSE '' END || ' - ' || unit"
HYBRID = f"""hybrid AS (
  SELECT unit, month, kind, concept, CAST(SUM(amount) AS DECIMAL(28,6)) AS amount FROM closed GROUP BY 1, 2, 3, 4
  UNION ALL SELECT unit, month, 'Sueldos', 'Sueldos' || {SUFFIX}, CAST(amount AS DECIMAL(28,6)) FROM late
  UNION ALL SELECT unit, month, 'Cargas Sociales', 'Cargas Sociales' || {SUFFIX}, amount FROM late_charges)"""
PAYROLL = (*BOOK, *ACCRUAL, *LIABILITY, HYBRID)

IN_POLICY = "p_size <= 30"
IN_NAME = "contains(concept, 'Gear')"


def _expenses(copies: str = "1", overrides: bool = True) -> tuple[str, ...]:
    unit = f"CASE WHEN {IN_POLICY} THEN name_unit END"
    concept = "concept"
    if overrides:
        unit = f"CASE WHEN party IN ('Supplier#000000003', 'Supplier#000000007') THEN 'B' ELSE {unit} END"
        concept = (
            "CASE party WHEN 'Supplier#000000003' THEN replace(concept, 'Economy ', 'Promo ') "
            "WHEN 'Supplier#000000007' THEN replace(concept, 'Standard ', 'Medium ') ELSE concept END"
        )
    return (
        f"""expenses AS (
  SELECT {unit} AS unit, loaded_at, load_month AS month, {concept} AS concept, account_no, detail, party, origin,
         CASE WHEN l_returnflag = 'R' THEN -amount ELSE amount END AS amount
  FROM ledger, LATERAL (SELECT unnest(range({copies}))) AS copy
  WHERE ({IN_POLICY} OR {IN_NAME}) AND class_code NOT IN ({_list(R.accrual_kinds)})
    AND (origin = 'Compra' OR (class_code = 'Brand#11' AND origin = 'ComprobanteFondo')) AND NOT contains(detail, ' hot '))""",
    )


TWICE = f"CAST({IN_POLICY} AS INT) + CAST({IN_NAME} AS INT)"
DA = "detail = '1-URGENT old gear N'"


def _expense_month(consistent: bool = True) -> str:
    unit = f"CASE WHEN {DA} THEN 'B' ELSE unit END" if consistent else "unit"
    concept = f"CASE WHEN {DA} THEN '01-Otros DA' ELSE concept END" if consistent else "concept"
    known = "unit IN ('A', 'B')" if consistent else "unit IS NOT NULL"
    return f"""expense_month AS (
  SELECT {unit} AS unit, month, account_no, {concept} AS concept, SUM(amount) AS amount FROM expenses WHERE {known} GROUP BY ALL)"""


def _pnl(literal: bool = False) -> tuple[str, ...]:
    return (
        *SALES,
        *PAYROLL,
        *_expenses(TWICE if literal else "1"),
        _expense_month(not literal),
        """pnl_rows AS (
  SELECT unit, month, concept, amount FROM sales_month
  UNION ALL SELECT unit, month, concept, amount FROM hybrid
  UNION ALL SELECT unit, month, concept, CAST(amount AS DECIMAL(28,6)) FROM expense_month)""",
        f"""pnl AS (
  SELECT unit, {GROUP} AS pnl_group, concept, month, SUM(amount) AS amount
  FROM (SELECT unit, month, {PREFIX.format('concept', 'Sueldos')} AS concept, amount FROM pnl_rows WHERE unit IN ('A', 'B'))
  GROUP BY ALL)""",
    )


PNL = _pnl()
FACT = (
    f"""raw_fact AS (
  SELECT unit, issued_at AS moment, month, 'Ventas netas - ' || unit AS concept, '' AS account_no, CAST(amount AS DECIMAL(28,6)) AS amount,
         detail, party, 'Ventas' AS source, NULL AS origin FROM sales
  UNION ALL SELECT unit, accounting_at, month, kind, account_no, amount, 'Cuenta Devengado', subclass, 'Sueldos', origin FROM closed
  UNION ALL SELECT unit, loaded_at, month, 'Sueldos', account_no, amount, 'Cuenta patrimonial', 'Sin Clasificar', 'Sueldos', origin FROM owed, cut WHERE month > cutoff
  UNION ALL SELECT unit, NULL, month, 'Cargas Sociales', NULL, amount, 'Cuenta patrimonial', 'Sin Clasificar', NULL, NULL FROM late_charges
  UNION ALL SELECT unit, loaded_at, month, concept, account_no, amount, detail, party, 'Compras', origin FROM expenses)""",
    f"""moved AS (
  SELECT CASE WHEN {DA} THEN 'B' ELSE unit END AS unit, moment, month, CASE WHEN {DA} THEN '01-Otros DA' ELSE concept END AS concept,
         account_no, amount, detail, party, source, origin FROM raw_fact WHERE unit IN ('A', 'B'))""",
    f"""fact AS (SELECT {GROUP} AS pnl_group, * FROM (SELECT * REPLACE ({PREFIX.format('concept', 'Sueldos')} AS concept) FROM moved))""",
    f"""party_months AS (
  SELECT unit, pnl_group, concept, party, month, SUM(amount) AS amount FROM fact
  WHERE party IS NOT NULL AND {YEAR_TEST} GROUP BY ALL)""",
    f"""best AS (
  SELECT unit, concept, party, SUM(ABS(amount)) AS total FROM party_months GROUP BY unit, concept, party
  QUALIFY ROW_NUMBER() OVER (PARTITION BY unit, concept ORDER BY SUM(ABS(amount)) DESC, party) <= {TOP_N})""",
)
MARGIN = f"""margins AS (
  SELECT unit, month, SUM(amount) FILTER (pnl_group = '1.Ventas') AS s, SUM(amount) FILTER (pnl_group = '2.RRHH') AS p,
         SUM(amount) FILTER (pnl_group = '3.Egresos') AS e FROM pnl WHERE {YEAR_TEST} GROUP BY unit, month)""", f"""margin AS (
  SELECT unit, month, COALESCE(s, 0) AS sales, COALESCE(p, 0) AS payroll, COALESCE(e, 0) AS expenses,
         COALESCE(s, 0) - COALESCE(p, 0) - COALESCE(e, 0) AS margin FROM margins)"""
MARGIN_PCT = "CAST(margin AS DOUBLE) / NULLIF(CAST(sales AS DOUBLE), 0) * 100"


def _rank(column: str, order: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(order))
    return f"CASE {column} {cases} ELSE {len(order)} END"


def _pesos(value: str) -> str:
    body = f"translate(format('{{:,.1f}}', ABS(CAST({value} AS DOUBLE)) / 1e6), ',.', '.,')"
    return f"CASE WHEN {value} < 0 THEN '-$' ELSE '$' END || {body} || 'M'"


RESULT_FILTER = (
    "detail NOT LIKE '%NOT SPECIFIED%' AND NOT contains(concept, 'Anvil') AND NOT contains(concept, 'Plate') "
    "AND account_no NOT IN ('400000000011', '400000000012')"
)
BY_DATE = f"""dated AS (SELECT *, {CONCEPT} AS concept, {ORIGIN} AS origin FROM lines WHERE accounting_at >= DATE '1998-01-01')"""
ABOVE = f"TRY_CAST(account_no AS BIGINT) > {R.result_accounts_above}"
LABEL = "regexp_matches(concept, 'Ventas netas - A|Ventas netas - Otros|Standard|Economy')"


def _result(literal: bool = False) -> str:
    if literal:
        is_sales = "sales_row"
        flag = f"""marked AS (
  SELECT *, DENSE_RANK() OVER (PARTITION BY scope ORDER BY {_rank('concept', R.concept_order_old)}, concept, account_no) <= 2 AS sales_row FROM scoped)"""
    else:
        is_sales = "concept LIKE 'Ventas netas - %'"
        flag = "marked AS (SELECT * FROM scoped)"
    cells = ", ".join(
        f"CASE WHEN concept = 'Resultado' THEN COALESCE({_cash(f'SUM(CASE WHEN month = {m!r} THEN amount END)')}, 0) "
        f"ELSE {_cash(f'SUM(CASE WHEN month = {m!r} THEN amount END)')} END AS \"{m}\""
        for m in REPORT_MONTHS
    )
    cells += f", {_cash(f'SUM(CASE WHEN month NOT IN ({_list(REPORT_MONTHS)}) THEN amount END)')} AS other_months"
    return _with(
        *SALES,
        LINES,
        BY_DATE,
        f"""cells AS (
  SELECT '' AS account_no, concept, month, amount FROM sales_month
  UNION ALL SELECT account_no, concept, accounting_month, CAST(SUM(amount) AS DECIMAL(28,6)) FROM dated WHERE {ABOVE} AND {RESULT_FILTER} GROUP BY 1, 2, 3)""",
        f"""scoped AS (SELECT 'Gral.' AS scope, * FROM cells UNION ALL SELECT CASE WHEN {LABEL} THEN 'A' ELSE 'B' END, * FROM cells)""",
        flag,
        f"""complete AS (
  SELECT scope, account_no, concept, month, amount FROM scoped
  UNION ALL SELECT scope, '', 'Resultado', month, SUM(CASE WHEN {is_sales} THEN amount ELSE -amount END) FROM marked GROUP BY scope, month)""",
        select=f"SELECT scope, account_no, concept, {cells} FROM complete GROUP BY scope, account_no, concept",
    )


SHARES = """shares AS (
  SELECT unit, month, CAST(amount AS DOUBLE) / CAST(SUM(amount) OVER (PARTITION BY month) AS DOUBLE) AS share FROM (
    SELECT CASE class_code WHEN 'Brand#7' THEN 'A' ELSE 'B' END AS unit, load_month AS month, SUM(amount) AS amount
    FROM ledger WHERE class_code IN ('Brand#7', 'Brand#8') AND side = 0 GROUP BY 1, 2))""", """pools AS (
  SELECT CASE class_code WHEN 'Brand#9' THEN 'Cargas Sociales' ELSE 'Sindicato' END AS kind, load_month AS month, *
  FROM ledger WHERE (class_code = 'Brand#9' AND side = 0) OR class_code = 'Brand#10')"""
PART_OF = "CAST(CAST(amount AS DOUBLE) * share AS DECIMAL(28,6))"

SPLIT_PCT = "round_even({0} / NULLIF(CAST(o + a AS DOUBLE), 0) * 100, 1)"
PAYROLL_SPLIT = """split AS (
  SELECT kind, month, COALESCE(SUM(amount) FILTER (subclass = 'Operaciones'), 0) AS o,
         COALESCE(SUM(amount) FILTER (subclass = 'Administracion'), 0) AS a FROM closed WHERE unit = 'A' GROUP BY kind, month)"""
SPLIT_SELECT = (
    f"SELECT kind, month, {_cash('o')} AS operations, {_cash('a')} AS administration, {_cash('o + a')} AS total, "
    f"{SPLIT_PCT.format('CAST(o AS DOUBLE)')} AS operations_pct, {SPLIT_PCT.format('CAST(a AS DOUBLE)')} AS administration_pct FROM split"
)
RECONCILE = """compare AS (
  SELECT month, owed, accrued, COALESCE(month > cutoff, FALSE) AS is_fallback
  FROM (SELECT month, SUM(amount) AS owed FROM owed WHERE unit = 'A' GROUP BY month)
  FULL OUTER JOIN (SELECT month, SUM(amount) AS accrued FROM closed WHERE unit = 'A' AND kind = 'Sueldos' GROUP BY month) USING (month), cut)"""

ACTIVITY = """activity AS (
  SELECT account_no, account_name, COUNT(*) AS moves_total, COUNT(*) FILTER (loaded_at >= DATE '1996-01-01') AS moves_recent,
         COUNT(DISTINCT journal_id) AS journals, MIN(loaded_at) AS first_move, MAX(loaded_at) AS last_move,
         COALESCE(SUM(amount) FILTER (loaded_at >= DATE '1996-01-01' AND side = 0), 0) AS debit,
         COALESCE(SUM(amount) FILTER (loaded_at >= DATE '1996-01-01' AND side = 1), 0) AS credit, ANY_VALUE(p_size) AS p_size
  FROM lines GROUP BY account_no, account_name)"""
INVENTORY = f"""inventory AS (
  SELECT COALESCE({NAME_UNIT}, 'Otras') AS unit, account_no, {CONCEPT} AS label, moves_total, moves_recent, journals,
         debit - credit AS net, strftime(last_move, '%Y-%m') AS last_month
  FROM activity WHERE moves_recent > 0 AND p_size <= 30)"""
PROFILE = f"""profile AS (
  SELECT accounting_month, account_no, account_name, side,
         CASE category WHEN 'cierre' THEN '4_cierre' WHEN 'infl' THEN '2_infl' WHEN 'reversion' THEN '3_reversion'
           WHEN 'provision' THEN '3_provision' ELSE '1_base' END AS category, COUNT(*) AS n, SUM(amount) AS total
  FROM ledger WHERE class_code IN ({_list(PAYROLL_CODES)}) GROUP BY ALL)"""
SEARCH = "(party ILIKE '%plier#000000001%' OR party ILIKE '%supplier#000000004%')"

CONTACTS = """contacts AS (
  SELECT c_name AS last_name, CASE WHEN c_acctbal >= 0 THEN lower(c_name) || '@example.org' END AS email, n_name AS company,
         MIN(c_mktsegment) AS first_name, MIN(seg.segment) AS segment, MIN(CASE WHEN n_regionkey < 3 THEN 'CLIENTE' ELSE 'OTRO' END) AS party_type,
         strftime(MAX(d.first_at), '%Y-%m-%d') AS created_at, strftime(MAX(d.last_at), '%Y-%m-%d') AS modified_at,
         strftime(MAX(o.o_orderdate), '%Y-%m-%d') AS last_invoice
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT c_nationkey AS k, MIN(c_mktsegment) AS segment FROM customer GROUP BY 1) seg ON seg.k = c_nationkey
  LEFT JOIN (SELECT o_custkey AS k, MIN(o_orderdate) AS first_at, MAX(o_orderdate) AS last_at FROM orders GROUP BY 1) d ON d.k = c_custkey
  LEFT JOIN orders o ON o.o_custkey = c_custkey AND o.o_orderstatus = 'O' AND o.o_orderdate >= DATE '2001-01-01'
  GROUP BY 1, 2, 3)"""
SUPPLIERS = """bought AS (
  SELECT l_suppkey, o_orderkey, o_orderdate, o_orderstatus, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""", """suppliers AS (
  SELECT s_name AS company, strftime(MIN(o_orderdate), '%Y-%m-%d') AS created_at, strftime(MAX(o_orderdate), '%Y-%m-%d') AS modified_at,
         strftime(MAX(o_orderdate), '%Y-%m-%d') AS last_purchase, 'PROVEEDOR' AS party_type,
         COUNT(DISTINCT CASE WHEN o_orderdate >= DATE '2000-08-01' AND o_orderstatus <> 'P' AND l_returnflag = 'N' THEN o_orderkey END) AS documents,
         COALESCE(SUM(price) FILTER (o_orderdate >= DATE '2000-08-01' AND o_orderstatus <> 'P' AND l_returnflag = 'N'), 0) AS amount
  FROM supplier LEFT JOIN bought ON l_suppkey = s_suppkey WHERE s_acctbal >= 2500 GROUP BY s_name)"""
SUPPLIER_COLUMNS = f"company, created_at, modified_at, last_purchase, party_type, documents, {_cash('amount')} AS amount"


def _statement() -> str:
    return _with(
        *PNL,
        *FACT,
        *MARGIN,
        f"chosen AS (SELECT * FROM pnl WHERE {YEAR_TEST})",
        select=f"""SELECT unit, section, level, concept, party, label, month, CAST(ROUND(CAST(amount AS DECIMAL(38,6)), 2) AS DOUBLE) AS amount FROM (
  SELECT unit, pnl_group AS section, 0 AS level, NULL AS concept, NULL AS party, substr(pnl_group, 3) AS label, month, CAST(SUM(amount) AS DECIMAL(38,6)) AS amount FROM chosen GROUP BY ALL
  UNION ALL SELECT unit, pnl_group, 1, concept, NULL, trim(substr(concept, 4)), month, amount FROM chosen
  UNION ALL SELECT unit, pnl_group, 2, concept, party, CASE WHEN length(party) > 45 THEN substr(party, 1, 45) || '…' ELSE party END, month, amount
    FROM party_months JOIN best USING (unit, concept, party) WHERE (unit, concept) IN (SELECT (unit, concept) FROM chosen)
  UNION ALL SELECT unit, '4.Margen', 3, NULL, NULL, 'MARGEN OPERATIVO', month, margin FROM margin
  UNION ALL SELECT unit, '4.Margen', 4, NULL, NULL, 'Margen %', month, CAST({MARGIN_PCT} AS DECIMAL(38,6)) FROM margin)""",
    )


def oracle_sql() -> dict[str, str]:
    day = "strftime({0}, '%Y-%m-%d')".format
    dmy = "strftime({0}, '%d/%m/%Y')".format
    sql = {
        # sales
        "sales_fact": _with(*SALES, select=f"SELECT unit, {day('issued_at')} AS moment, month, 'Ventas netas - ' || unit AS concept, {_cash('amount')} AS amount, detail, party FROM sales"),
        "sales_monthly": _with(*SALES, select=f"SELECT unit, month, concept, {_cash('exact_amount')} AS amount FROM sales_month"),
        "sales_document_label": _with(*SALES, select="SELECT DISTINCT invoice_id, detail FROM sales"),
        "sales_customer_units": _with(*_sales("Otros", "c_name LIKE '%00000001%'"), select=f"SELECT unit, month, concept, {_cash('exact_amount')} AS amount FROM sales_month"),
        "first_invoices": f"""SELECT c_name AS company, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS invoice_id, {BRANCH_UNIT.format('Otros')} AS unit
FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY ROW_NUMBER() OVER (PARTITION BY c_name ORDER BY o_orderdate, o_orderkey) = 1""",
        "new_customers": f"""SELECT month, unit, COUNT(*) AS new_customers FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, {BRANCH_UNIT.format('Otros')} AS unit
  FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY ROW_NUMBER() OVER (PARTITION BY c_name ORDER BY o_orderdate, o_orderkey) = 1) GROUP BY month, unit""",
        # ledger and accounts
        "ledger_fact": _with(*BOOK, select=f"SELECT journal_id, {day('accounting_at')} AS accounting_at, {day('loaded_at')} AS loaded_at, CAST(amount AS DOUBLE) AS amount, side, account_no, concept, origin, detail, party FROM ledger"),
        "ledger_co_located": _with(*BOOK, select=f"SELECT journal_id, {day('accounting_at')} AS accounting_at, {day('loaded_at')} AS loaded_at, CAST(amount AS DOUBLE) AS amount, side, account_no, concept, origin, detail, party FROM ledger"),
        "ledger_line_first": _with(LINES, BY_DATE, select=f"SELECT account_no, concept, detail, CAST(amount AS DOUBLE) AS amount, {day('accounting_at')} AS accounting_at FROM dated WHERE {ABOVE} AND {RESULT_FILTER}"),
        "ledger_by_party": _with(LINES, BY_DATE, select=f"SELECT account_no, concept, detail, CAST(amount AS DOUBLE) AS amount, {day('accounting_at')} AS accounting_at, party FROM dated WHERE {ABOVE}"),
        "ledger_by_movement": _with(LINES, BY_DATE, select=f"SELECT party, COUNT(*) AS n, {_cash('SUM(amount)')} AS amount FROM dated WHERE {ABOVE} GROUP BY party"),
        "account_canonical": "SELECT CASE p_type WHEN 'LARGE' THEN '1' ELSE '4' END || lpad(CAST(p_partkey AS VARCHAR), 11, '0') || '.0' AS raw, CAST(CASE p_type WHEN 'LARGE' THEN 100000000000 ELSE 400000000000 END + p_partkey AS VARCHAR) AS account_no FROM part",
        "account_policy_selected": "SELECT CAST(CASE p_type WHEN 'LARGE' THEN 100000000000 ELSE 400000000000 END + p_partkey AS VARCHAR) AS account_no, upper(p_type || ' ' || p_name) AS account_name FROM part WHERE p_size <= 30",
        "account_unit_lists": f"SELECT account_no, unit FROM (SELECT CAST(CASE p_type WHEN 'LARGE' THEN 100000000000 ELSE 400000000000 END + p_partkey AS VARCHAR) AS account_no, {NAME_UNIT} AS unit FROM (SELECT *, upper(p_type || ' ' || p_name) AS account_name FROM part) WHERE p_size <= 30) WHERE unit IS NOT NULL",
        "account_search": """SELECT * FROM (SELECT CASE p_type WHEN 'LARGE' THEN '1' ELSE '4' END || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS account_no, upper(p_type || ' ' || p_name) AS account_name,
  CAST(p_size AS VARCHAR) AS level, CAST(p_size > 25 AS INT) AS postable FROM part)
WHERE account_no LIKE '1%' OR account_name ILIKE '%hot anv%' OR account_name ILIKE '%plate%'""",
        "origin_decode": f"SELECT origin_code, {ORIGIN} AS origin, COUNT(*) AS journals FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS origin_code FROM orders) GROUP BY 1, 2",
        "signed_amount": _with(*BOOK, select=f"SELECT account_no, {_cash('SUM(CASE side WHEN 0 THEN amount WHEN 1 THEN -amount END)')} AS signed, {_cash('SUM(amount)')} AS gross FROM ledger GROUP BY account_no"),
        "noise_category": _with(*BOOK, select=f"SELECT category, COUNT(*) AS n, {_cash('SUM(amount)')} AS total FROM ledger GROUP BY category"),
        # payroll
        "noise_profile": _with(*BOOK, PROFILE, select=f"SELECT accounting_month, account_no, account_name, side, category, n, {_cash('total')} AS total FROM profile"),
        "noise_summary": _with(*BOOK, PROFILE, select=f"SELECT category, side, CAST(SUM(n) AS BIGINT) AS n, {_cash('SUM(total)')} AS total FROM profile GROUP BY category, side"),
        "payroll_base_or_provision": _with(*BOOK, *ACCRUAL, select="SELECT unit, kind, subclass, account_no, month, category, CAST(amount AS DOUBLE) AS amount FROM kept"),
        "payroll_cutoff": _with(*BOOK, *ACCRUAL, select="SELECT cutoff FROM cut"),
        "payroll_accrual_monthly": _with(*BOOK, *ACCRUAL, select=f"SELECT unit, kind, subclass, concept, month, {_cash('SUM(amount)')} AS amount FROM closed GROUP BY ALL"),
        "payroll_fallback_share": _with(*PAYROLL, select="SELECT unit, month, CAST(amount AS DOUBLE) AS amount, ROUND(share, 6) AS share FROM late"),
        "payroll_fallback_apportioned": _with(*PAYROLL, select=f"SELECT unit, month, 'Cargas Sociales' || {SUFFIX} AS concept, {_cash('amount')} AS amount FROM late_charges"),
        "payroll_row_apportioned": _with(*BOOK, *SHARES, select=f"SELECT unit, {day('loaded_at')} AS moment, month, kind || ' - ' || unit AS concept, account_no, {_cash(PART_OF)} AS amount, concept AS detail, kind AS source FROM pools LEFT JOIN shares USING (month)"),
        "payroll_account_apportioned": _with(*BOOK, *SHARES, select=f"SELECT unit, month, kind || ' - ' || unit AS concept, detail, account_no, {_cash(PART_OF)} AS amount FROM (SELECT kind, month, account_no, detail, SUM(amount) AS amount FROM (SELECT kind, month, account_no, amount, {_title_detail()} AS detail FROM pools) GROUP BY ALL) LEFT JOIN shares USING (month)"),
        "payroll_hybrid_monthly": _with(*PAYROLL, select=f"SELECT unit, month, kind, concept, {_cash('amount')} AS amount FROM hybrid"),
        "payroll_hybrid_per_unit": _with(*PAYROLL, *_per_unit(), select=f"SELECT unit, month, kind, concept, {_cash('amount')} AS amount FROM hybrid_unit"),
        "payroll_subclass": _with(*BOOK, *ACCRUAL, select=f"SELECT unit, kind, subclass, {_cash('SUM(amount)')} AS amount FROM closed GROUP BY ALL"),
        "payroll_month_pivot": _with(*BOOK, *ACCRUAL, select="SELECT month, " + ", ".join(f"{_cash(f'SUM(amount) FILTER (concept = {c!r})')} AS \"{c}\"" for c in _payroll_concepts()) + f", {_cash(f'SUM(amount) FILTER (concept NOT IN ({_list(_payroll_concepts())}))')} AS other_concepts" + " FROM closed GROUP BY month"),
        "payroll_split_ratio": _with(*BOOK, *ACCRUAL, PAYROLL_SPLIT, select=SPLIT_SELECT),
        "payroll_last_months": _with(*BOOK, *ACCRUAL, PAYROLL_SPLIT, select=SPLIT_SELECT + " QUALIFY ROW_NUMBER() OVER (PARTITION BY kind ORDER BY month DESC) <= 12"),
        "method_reconciliation": _with(*PAYROLL, RECONCILE, select=f"SELECT month, {_cash('owed')} AS owed, {_cash('accrued')} AS accrued, is_fallback FROM compare"),
        "fallback_months": _with(*PAYROLL, RECONCILE, select="SELECT COUNT(*) AS months, string_agg(month, ',' ORDER BY month) AS month_list FROM compare WHERE is_fallback"),
        # expenses
        "expenses_selected": _with(*BOOK, *_expenses(overrides=False), select=f"SELECT account_no, concept, COUNT(*) AS n, {_cash('SUM(amount)')} AS amount FROM expenses GROUP BY account_no, concept"),
        "expenses_selected_literal": _with(*BOOK, *_expenses(TWICE, overrides=False), select=f"SELECT account_no, concept, COUNT(*) AS n, {_cash('SUM(amount)')} AS amount FROM expenses GROUP BY account_no, concept"),
        "expenses_flipped": _with(*BOOK, *_expenses(), select=f"SELECT month, regexp_matches(detail, ' R$') AS flipped, COUNT(*) AS n, {_cash('SUM(amount)')} AS amount FROM expenses GROUP BY 1, 2"),
        "expenses_overrides": _with(*BOOK, *_expenses(), select=f"SELECT party, CASE WHEN {DA} THEN 'B' ELSE unit END AS unit, CASE WHEN {DA} THEN '01-Otros DA' ELSE concept END AS concept, COUNT(*) AS n, {_cash('SUM(amount)')} AS amount FROM expenses WHERE {DA} OR party IN ('Supplier#000000003', 'Supplier#000000007') GROUP BY 1, 2, 3"),
        "expenses_rule_table": _with(*BOOK, *_expenses(overrides=False), """named AS (SELECT DISTINCT p_name AS item FROM part WHERE p_name IS NOT NULL)""",
            """moved AS (
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'B' ELSE unit END AS unit, CASE WHEN s_suppkey IS NULL THEN concept ELSE replace(concept, 'Economy ', 'Promo ') END AS concept, detail, amount
  FROM expenses LEFT JOIN (SELECT s_name, MIN(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_name) ON s_name = party)""",
            """ruled AS (
  SELECT detail, arg_min({'u': CASE WHEN contains(item, 'e') THEN 'A' END, 'c': CASE WHEN item > 'm' THEN '02-' || item END},
      (length(item), CASE WHEN contains(item, 'e') THEN 'A' ELSE '' END, CASE WHEN item > 'm' THEN '02-' || item ELSE '' END)) AS rule
  FROM (SELECT DISTINCT detail FROM moved) JOIN named ON contains(lower(detail), lower(item)) GROUP BY detail)""",
            select=f"SELECT COALESCE(rule.u, unit) AS unit, COALESCE(rule.c, concept) AS concept, COUNT(*) AS n, {_cash('SUM(amount)')} AS amount FROM moved LEFT JOIN ruled USING (detail) GROUP BY ALL"),
        "expenses_monthly": _with(*BOOK, *_expenses(), _expense_month(), select=f"SELECT unit, month, account_no, concept, {_cash('amount')} AS amount FROM expense_month"),
        "expense_codes": _with(*BOOK, *_expenses(), _expense_month(), select=f"SELECT concept, account_no, (SELECT {_cash('SUM(amount)')} FROM expense_month t WHERE t.concept = c.concept) AS amount FROM (SELECT DISTINCT concept, account_no FROM expense_month) c"),
        "expense_pivot": _with(*BOOK, select=f"SELECT account_no, concept, {_pivot('amount', month='load_month')} FROM ledger GROUP BY account_no, concept"),
        # P&L and margin
        "movements_fact": _with(*PNL, *FACT, select=f"SELECT pnl_group, unit, {day('moment')} AS moment, month, concept, account_no, {_cash('amount')} AS amount, detail, party, source, origin FROM fact"),
        "movements_ordered": _with(*PNL, *FACT, select=f"""SELECT pnl_group, unit, {day('moment')} AS moment, month, concept, account_no, {_cash('amount')} AS amount, detail, party, source, origin,
  ROW_NUMBER() OVER (ORDER BY unit NULLS LAST, moment NULLS LAST, concept NULLS LAST, account_no NULLS LAST, pnl_group NULLS LAST, month NULLS LAST,
    amount NULLS LAST, detail NULLS LAST, party NULLS LAST, source NULLS LAST, origin NULLS LAST) AS position FROM fact"""),
        "pnl_long": _with(*PNL, select=f"SELECT unit, pnl_group, concept, month, {_cash('amount')} AS amount FROM pnl"),
        # batches do not show in the result
        "pnl_late_batches": _with(*PNL, select=f"SELECT unit, pnl_group, concept, month, {_cash('amount')} AS amount FROM pnl"),
        "pnl_long_literal": _with(*_pnl(literal=True), select=f"SELECT unit, pnl_group, concept, month, {_cash('amount')} AS amount FROM pnl"),
        "pnl_pivot": _with(*PNL, select=f"SELECT unit, pnl_group, concept, {_pivot('amount')} FROM pnl GROUP BY unit, pnl_group, concept"),
        "pnl_ordered": _with(*PNL, select=f"SELECT unit, pnl_group, concept, month, {_cash('amount')} AS amount, {_rank('concept', R.concept_order)} AS concept_rank FROM pnl"),
        "pnl_with_result": _result(),
        "pnl_with_result_literal": _result(literal=True),
        "pnl_liability_method": _liability_pnl(),
        "pnl_by_detail": _pnl_by_detail(),
        "margin_monthly": _with(*PNL, *MARGIN, select=f"SELECT unit, month, {_cash('sales')} AS sales, {_cash('payroll')} AS payroll, {_cash('expenses')} AS expenses, {_cash('margin')} AS margin, ROUND({MARGIN_PCT}, 4) AS margin_pct FROM margin"),
        "margin_total": _with(*PNL, *MARGIN, "total AS (SELECT unit, SUM(sales) AS sales, SUM(payroll) AS payroll, SUM(expenses) AS expenses, SUM(margin) AS margin, SUM(payroll + expenses) AS costs FROM margin GROUP BY unit)", select=f"SELECT unit, {_cash('sales')} AS sales, {_cash('payroll')} AS payroll, {_cash('expenses')} AS expenses, {_cash('margin')} AS margin, {_cash('costs')} AS costs, ROUND(COALESCE({MARGIN_PCT}, 0), 4) AS margin_pct, {_pesos('sales')} AS sales_text, {_pesos('costs')} AS costs_text, {_pesos('margin')} AS margin_text FROM total"),
        "margin_chart_series": _with(*PNL, *MARGIN, select="SELECT unit, month, ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][CAST(substr(month, 6) AS INT)] || ' ' || substr(month, 1, 4) AS label, series, ROUND(value, 4) AS value FROM ("
            + " UNION ALL ".join(f"SELECT unit, month, '{name}' AS series, CAST({column} AS DOUBLE) / 1e6 AS value FROM margin" for name, column in (("Ventas", "sales"), ("RRHH", "payroll"), ("Egresos", "expenses"), ("Margen", "margin")))
            + f" UNION ALL SELECT unit, month, 'Margen %', {MARGIN_PCT} FROM margin)"),
        "statement_rows": _statement(),
        "topn_counterparty": _with(*PNL, *FACT, select=f"SELECT unit, concept, party, {_cash('total')} AS total FROM best"),
        "counterparty_pivot": _with(*PNL, *FACT, select=f"SELECT unit, concept, party, {_pivot('amount', [m for m in REPORT_MONTHS if m[:4] in {str(y) for y in YEARS}])} FROM party_months GROUP BY unit, concept, party"),
        "margin_long": _margin_long(dmy),
        "margin_from_purchases": _margin_from_purchases(dmy),
        "month_detail": _with(LINES, BY_DATE, select=f"SELECT account_no, concept, detail, CAST(amount AS DOUBLE) AS amount, {dmy('accounting_at')} AS day FROM dated WHERE {ABOVE} AND {RESULT_FILTER} AND accounting_month = '1999-05' AND {LABEL}"),
        # parties
        "contact_report": _with(CONTACTS, select="SELECT * FROM contacts"),
        "contact_with_invoice": _with(CONTACTS, select="SELECT * FROM contacts WHERE last_invoice IS NOT NULL"),
        "supplier_report": _with(*SUPPLIERS, select=f"SELECT {SUPPLIER_COLUMNS} FROM suppliers"),
        "supplier_last_year": _with(*SUPPLIERS, select=f"SELECT {SUPPLIER_COLUMNS} FROM suppliers WHERE documents > 0"),
        "supplier_active": _with(*SUPPLIERS, select=f"SELECT {SUPPLIER_COLUMNS} FROM suppliers WHERE last_purchase >= '2001-07-01'"),
        "supplier_new": _with(*SUPPLIERS, select=f"SELECT {SUPPLIER_COLUMNS} FROM suppliers WHERE created_at >= '1995-01-08'"),
        "recent_customers": f"""SELECT n_name AS company, t.tax_id, MIN(c_mktsegment) AS segment, CASE WHEN n_regionkey < 3 THEN 'CLIENTE' ELSE 'OTRO' END AS party_type, {dmy('o.last_at')} AS last_invoice
FROM nation JOIN customer ON c_nationkey = n_nationkey
JOIN (SELECT c_nationkey AS k, MAX(o_orderdate) AS last_at FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_orderdate >= DATE '2001-01-01' GROUP BY 1) o ON o.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, MIN('30-' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0')) AS tax_id FROM supplier GROUP BY 1) t ON t.k = n_nationkey
WHERE o.last_at >= DATE '2001-07-01' GROUP BY n_name, n_regionkey, t.tax_id, o.last_at""",
        "recent_suppliers": f"""SELECT s_name AS party, '30-' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS tax_id, {dmy('MAX(o_orderdate)')} AS last_purchase
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '2001-07-01' GROUP BY s_name, s_suppkey""",
        "purchase_decoded": f"""SELECT CASE o_orderstatus WHEN 'O' THEN 'Pendiente' WHEN 'F' THEN 'Pagado' WHEN 'P' THEN 'Anulado' ELSE 'Otro' END AS state_name,
  CASE l_returnflag WHEN 'N' THEN 'Factura' WHEN 'R' THEN 'Nota de Credito' WHEN 'A' THEN 'Nota de Debito' ELSE 'Otro' END AS voucher_name,
  COUNT(*) AS n, {_cash('SUM(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""",
        # diagnostics
        "account_activity": _with(LINES, ACTIVITY, select=f"SELECT account_no, account_name, moves_total, moves_recent, journals, {day('first_move')} AS first_move, {day('last_move')} AS last_move, {_cash('debit')} AS debit, {_cash('credit')} AS credit FROM activity"),
        "account_inventory": _with(LINES, ACTIVITY, INVENTORY, select=f"SELECT * REPLACE ({_cash('net')} AS net) FROM inventory"),
        "account_inventory_totals": _with(LINES, ACTIVITY, INVENTORY, select=f"SELECT unit, COUNT(*) AS accounts, CAST(SUM(moves_recent) AS BIGINT) AS moves_recent, {_cash('SUM(net)')} AS net FROM inventory GROUP BY unit"),
        "date_shift_matrix": _with(*BOOK, select=f"""SELECT accounting_month, load_month, account_no, account_name, side, origin_code, COUNT(*) AS n, {_cash('SUM(amount)')} AS total,
  {_cash("SUM(CASE WHEN detail LIKE '%NOT SPECIFIED%' THEN amount ELSE 0 END)")} AS closing, {_cash("SUM(CASE WHEN detail NOT LIKE '%NOT SPECIFIED%' THEN amount ELSE 0 END)")} AS operating
  FROM ledger WHERE class_code IN ({_list(PAYROLL_CODES)}) GROUP BY 1, 2, 3, 4, 5, 6"""),
        "closing_vs_operating": _with(*BOOK, select=f"""SELECT load_month, {_cash("SUM(CASE WHEN detail LIKE '%NOT SPECIFIED%' THEN amount ELSE 0 END)")} AS closing,
  {_cash("SUM(CASE WHEN detail NOT LIKE '%NOT SPECIFIED%' THEN amount ELSE 0 END)")} AS operating, COUNT(*) AS n FROM ledger WHERE class_code IN ('Brand#7', 'Brand#8') GROUP BY load_month"""),
        "origin_distribution": _with(*BOOK, select=f"SELECT origin_code, side, COUNT(*) AS n, COUNT(DISTINCT journal_id) AS journals, {_cash('SUM(amount)')} AS total FROM ledger WHERE class_code IN ({_list(PAYROLL_CODES)}) GROUP BY origin_code, side"),
        "unit_debit_credit": _with(*BOOK, select=f"SELECT accounting_month, load_month, name_unit AS unit, {_cash('SUM(CASE WHEN side = 0 THEN amount ELSE 0 END)')} AS debit, {_cash('SUM(CASE WHEN side = 1 THEN amount ELSE 0 END)')} AS credit FROM ledger WHERE class_code IN ('Brand#3', 'Brand#4') GROUP BY 1, 2, 3"),
        "raw_sample": _with(*BOOK, select=f"SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount, {day('loaded_at')} AS loaded_at, {day('accounting_at')} AS accounting_at) FROM (SELECT loaded_at, accounting_at, account_no, account_name, side, amount, origin_code, detail, party FROM ledger WHERE class_code IN ({_list(PAYROLL_CODES)}) AND loaded_at >= DATE '1997-01-01' ORDER BY ALL LIMIT 120)"),
        "ledger_search": _with(*BOOK, select=f"SELECT {day('loaded_at')} AS loaded_at, origin_code, CAST(amount AS DOUBLE) AS amount, side, account_no, account_name, party, detail FROM ledger WHERE {SEARCH}"),
        "party_search": f"SELECT DISTINCT s_name AS party, CAST(s_suppkey AS VARCHAR) AS fiscal_id FROM supplier WHERE {SEARCH.replace('party', 's_name')}",
        "capital_accounts": _with(*BOOK, select=f"SELECT account_no, account_name, origin_code, COUNT(*) AS n, {_cash('SUM(amount)')} AS total FROM ledger WHERE account_no LIKE '1%' AND side = 0 GROUP BY 1, 2, 3"),
        "asset_monthly": _with(*BOOK, select=f"SELECT load_month AS month, account_no, account_name, origin_code, {_cash('SUM(amount)')} AS total, COUNT(*) AS n FROM ledger WHERE account_no LIKE '1%' AND side = 0 AND loaded_at >= DATE '1999-01-01' AND loaded_at < DATE '2000-01-01' GROUP BY 1, 2, 3, 4"),
        "liability_history": _with(*BOOK, select=f"SELECT load_month AS month, account_no, account_name, side, COUNT(*) AS n, {_cash('SUM(amount)')} AS total FROM ledger WHERE class_code IN ('Brand#7', 'Brand#8') GROUP BY 1, 2, 3, 4"),
        "liability_raw": _with(*BOOK, select=f"SELECT {day('loaded_at')} AS loaded_at, side, CAST(amount AS DOUBLE) AS amount, account_no, account_name, detail, origin_code FROM ledger WHERE class_code IN ('Brand#7', 'Brand#8') AND loaded_at >= DATE '1999-06-01' AND loaded_at < DATE '1999-09-01'"),
    }
    return sql


def _payroll_concepts() -> list[str]:
    return [c.removeprefix("01-") for c in R.concept_order if c.startswith("01-") and "sin clasificar" not in c]


def _title_detail() -> str:
    """Title case over runs of letters; every run in these texts is ASCII."""
    return "array_to_string([CASE WHEN regexp_matches(t, '^[a-z]') THEN upper(t[1]) || t[2:] ELSE t END for t in regexp_extract_all(lower(detail), '[a-z]+|[^a-z]+')], '')"


def _per_unit() -> tuple[str, ...]:
    return (
        "unit_cut AS (SELECT unit, MAX(month) AS unit_cutoff FROM kept WHERE kind = 'Sueldos' GROUP BY unit)",
        """owed_share AS (SELECT unit, month, amount, CAST(amount AS DOUBLE) / CAST(SUM(amount) OVER (PARTITION BY month) AS DOUBLE) AS share
  FROM (SELECT unit, month, SUM(amount) AS amount FROM owed GROUP BY unit, month))""",
        "late_unit AS (SELECT owed_share.* FROM owed_share JOIN unit_cut USING (unit) WHERE month > unit_cutoff)",
        f"""hybrid_unit AS (
  SELECT unit, month, kind, kind || CASE WHEN unit = 'A' THEN split ELSE '' END || ' - ' || unit AS concept, CAST(SUM(amount) AS DECIMAL(28,6)) AS amount
  FROM kept JOIN unit_cut USING (unit) WHERE month <= unit_cutoff AND month >= '1996-01' GROUP BY 1, 2, 3, 4
  UNION ALL SELECT unit, month, 'Sueldos', 'Sueldos' || {SUFFIX}, CAST(amount AS DECIMAL(28,6)) FROM late_unit
  UNION ALL SELECT unit, month, 'Cargas Sociales', 'Cargas Sociales' || {SUFFIX}, CAST(COALESCE(CAST(pool AS DOUBLE), 0) * share AS DECIMAL(28,6)) FROM late_unit LEFT JOIN pool USING (month))""",
    )


def _liability_pnl() -> str:
    prefix = PREFIX.format("concept", "Sueldos Y Jornales")
    return _with(
        *SALES,
        *BOOK,
        *SHARES,
        *_expenses(),
        _expense_month(consistent=False),
        f"""rows_ AS (
  SELECT unit, concept, month, amount FROM sales_month
  UNION ALL SELECT CASE class_code WHEN 'Brand#7' THEN 'A' ELSE 'B' END, concept, load_month, amount FROM ledger WHERE class_code IN ('Brand#7', 'Brand#8') AND side = 0
  UNION ALL SELECT unit, kind || ' - ' || unit, month, {PART_OF} FROM (SELECT kind, month, SUM(amount) AS amount FROM pools GROUP BY kind, month) JOIN shares USING (month)
  UNION ALL SELECT unit, concept, month, amount FROM expense_month)""",
        f"prefixed AS (SELECT unit, month, amount, {prefix} AS concept FROM rows_ WHERE unit IN ('A', 'B'))",
        select=f"SELECT unit, {GROUP} AS pnl_group, concept, month, {_cash('SUM(amount)')} AS amount FROM prefixed GROUP BY ALL",
    )


def _pnl_by_detail() -> str:
    title = _title_detail()
    return _with(
        *SALES,
        *BOOK,
        *SHARES,
        *_expenses(),
        f"""parts AS (
  SELECT unit, month, concept, NULL AS account_no, '-' AS detail, amount FROM sales_month
  UNION ALL SELECT CASE class_code WHEN 'Brand#7' THEN 'A' ELSE 'B' END, load_month, {title}, account_no, '-', SUM(amount)
    FROM ledger WHERE class_code IN ('Brand#7', 'Brand#8') AND side = 0 GROUP BY 1, 2, 3, 4
  UNION ALL SELECT unit, month, kind || ' - ' || unit, account_no, detail, {PART_OF}
    FROM (SELECT kind, month, account_no, {title} AS detail, SUM(amount) AS amount FROM pools GROUP BY 1, 2, 3, 4) JOIN shares USING (month)
  UNION ALL SELECT unit, month, concept, account_no, {title}, SUM(amount) FROM expenses GROUP BY 1, 2, 3, 4, 5)""",
        select=f"SELECT unit, month, concept, account_no, detail, {_cash('amount')} AS amount FROM parts WHERE unit IN ('A', 'B')",
    )


LONG_UNIT = "CASE WHEN regexp_matches(concept, '(?i)Standard|Economy|Ventas netas - Otros') THEN 'A' ELSE 'B' END"
LONG_ROWS = "class_code IN ('Brand#3', 'Brand#5')"


def _margin_long(dmy) -> str:
    rank = _rank("concept", R.concept_order_old)
    category = "CASE p_type WHEN 'STANDARD' THEN '3.Servicios' WHEN 'ECONOMY' THEN '3.Servicios' WHEN 'MEDIUM' THEN '4.Insumos' WHEN 'PROMO' THEN '5.Comerciales' WHEN 'SMALL' THEN '4.Insumos' ELSE '1.VENTAS' END"
    return _with(
        *_sales("A"),
        LINES,
        BY_DATE,
        select=f"""SELECT {LONG_UNIT} AS unit, accounting_month AS month, {dmy('accounting_at')} AS day, account_no, concept, detail AS voucher,
  CAST(amount AS DOUBLE) AS amount, CAST(-amount AS DOUBLE) AS balance, {category} AS category, {rank} AS concept_rank
FROM dated WHERE {LONG_ROWS} AND {RESULT_FILTER}
UNION ALL SELECT unit, month, NULL, NULL, concept, NULL, {_cash('amount')}, {_cash('amount')}, '1.VENTAS', {rank} FROM sales_month""",
    )


def _margin_from_purchases(dmy) -> str:
    rank = _rank("concept", R.concept_order_old)
    return _with(
        *_sales("A"),
        LINES,
        BY_DATE,
        f"""everything AS (
  SELECT NULL AS unit, strftime(o_orderdate, '%Y-%m') AS month, {dmy('o_orderdate')} AS day, upper(p_type[1]) || lower(p_type[2:]) AS concept, p_name AS product,
         CAST(o_orderkey AS VARCHAR) AS number, l_extendedprice AS amount, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS balance,
         p_brand AS product_code, s_name AS party, 'Pagado' AS state_name,
         CASE l_returnflag WHEN 'N' THEN 'Factura' WHEN 'R' THEN 'Nota de Credito' ELSE 'Nota de Debito' END AS voucher_name
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
  WHERE o_orderdate >= DATE '1998-01-01' AND o_orderstatus = 'F'
  UNION ALL SELECT {LONG_UNIT}, accounting_month, {dmy('accounting_at')}, concept, {_title_detail()}, account_no, CAST(amount AS DOUBLE), CAST(-amount AS DOUBLE), '2.Sueldos y Cargas Sociales', NULL, NULL, NULL
  FROM dated WHERE {LONG_ROWS}
  UNION ALL SELECT unit, month, NULL, concept, NULL, NULL, {_cash('amount')}, {_cash('amount')}, '1.VENTAS', NULL, NULL, NULL FROM sales_month)""",
        select=f"SELECT *, {rank} AS concept_rank FROM everything",
    )
