"""Synthetic tables in the shape of the accounting system, with the edge rows that matter.

All names are invented. ``erp_tables(spark, **changes)`` gives the full set; a keyword replaces
the rows of one table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

SCHEMAS = {
    "facturas": "RecID string, IDRef string, IDTalonario string, IDCotizacionMoneda string, FechaEmision timestamp_ntz, "
    "Numero bigint, Tipo int, TipoMultitipo int, Estado int, Descuento double",
    "facturasitems": "IdFactura string, IDProducto string, ImportePrecio2 double",
    "productos": "RecID string, Codigo string, Descripcion string, TipoProducto string",
    "monedacotizaciones": "RecID string, CotMoneda2 double",
    "talonarios": "RecID string, NroSucursal int",
    "contactos": "IDContacto string, IDEmpresa string, Nombre string, Apellido string, Correo string, "
    "FechaCreacion timestamp_ntz, FechaModificacion timestamp_ntz",
    "empresas": "IDEmpresa string, Empresa string",
    "industriaysub": "IDRef string, Valor string",
    "tiposysub": "IDRef string, Valor string",
    "asientos": "RecID string, Fecha timestamp_ntz, FechaCreacion timestamp_ntz, TipoOrigen int, IDOrigen string, Descripcion string",
    "asientositems": "IDAsiento string, IDCuentaContable string, TipoSaldo int, Importe1 double, Tipo int, IDMovimiento string",
    "cuentascontables": "RecID string, Numero string, Descripcion string, Nivel string, Imputable int",
    "compras": "RecID string, IDRef string, IDFiscal string, FechaCreacion timestamp_ntz, Numero string, NroSucursal int, "
    "IDCotizacionMoneda string, Estado int, TipoComprobante int",
    "comprasitems": "IDCompra string, IDProducto string, ImportePrecio1 double",
    "fiscal": "RecID string, RazonSocial string, NroImpuesto1 string, IDRef string",
    "movimientos": "RecID string, IDFiscalCliente string",
}
POLICY = "account_no string, level string, kind string, account_name string, consider string"


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


# accounts: number, description; two ids share one number, one number is no plan number
ACCOUNTS = [
    ("a-op", "42101029", "BSAS SUELDOS"),
    ("a-ad", "42102023", "BSAS SUELDOS ADM"),
    ("b-op", "42201029", "PAT SUELDOS"),
    ("a-ch", "42101009", "BSAS CARGAS SOCIALES"),
    ("b-ch", "42201009", "PAT CARGAS SOCIALES"),
    ("owe-a", "21301001", "SUELDOS Y JORNALES A PAGAR BS AS"),
    ("owe-b", "21301002", "SUELDOS Y JORNALES A PAGAR PATOGENICOS"),
    ("pool", "21302001", "CARGAS SOCIALES A PAGAR"),
    ("dues", "21302007", "SINDICATO A PAGAR"),
    ("x-up", "42101056", "BSAS MANTENIMIENTO"),
    ("x-up2", "42209999", "PAT MANTENIMIENTO DE MAQUINARIAS"),
    ("x-pat", "42101077", "BSAS PATENTES"),
    ("x-wat", "42102025", "BSAS AGUA-LUZ"),
    ("x-dup1", "42201001", "PAT ALQUILERES"),
    ("x-dup2", "42201001", "PAT ALQUILERES Y EXPENSAS"),
    ("x-no", "42303002", "BIO OTROS"),
    ("cap", "12101001", "VEHICULOS"),
]

POLICY_ROWS = [
    ("42101029.0", "1", "g", "BSAS SUELDOS", "Si"),
    ("42101056.0", "1", "g", "BSAS MANTENIMIENTO", " si "),
    ("42101077", "1", "g", "BSAS PATENTES", "SI"),
    ("42102025", "1", "g", "BSAS AGUA-LUZ", "Si"),
    ("42201001", "1", "g", "PAT ALQUILERES", "No"),
    ("42201001", "1", "g", "PAT ALQUILERES", "si"),
    ("42209999", "1", "g", "PAT MANTENIMIENTO DE MAQUINARIAS", "No"),
    ("42303002", "1", "g", "BIO OTROS", "Sí"),
]

# journal: id, accounting date, load date, origin, origin id, text, lines (account, side, amount)
JOURNALS = [
    # base rows: closed months
    ("j01", "2024-01-31", "2024-03-05", 9, None, "Devengado enero", [("a-op", 0, 1000.10), ("a-ad", 0, 200.0), ("a-ch", 0, 300.0), ("b-op", 0, 500.0)]),
    # base sums to exactly zero and a provision is there: the provision counts
    ("j02", "2024-02-29", "2024-03-05", 9, None, "Devengado", [("a-op", 0, 0.1), ("a-op", 0, 0.2), ("a-op", 1, 0.3)]),
    ("j03", "2024-02-29", "2024-03-05", 9, None, "PROV sueldos febrero", [("a-op", 0, 777.77)]),
    # provision only
    ("j04", "2024-02-29", "2024-03-06", 9, None, "Provision", [("b-op", 0, 444.0)]),
    # provision beside base: ignored; its reversal too
    ("j05", "2024-03-31", "2024-04-02", 9, None, "Sueldos marzo", [("a-op", 0, 1100.0)]),
    ("j06", "2024-03-31", "2024-04-02", 9, None, "Provision marzo", [("a-op", 0, 9999.0)]),
    ("j07", "2024-03-31", "2024-04-02", 9, None, "Reversion provision marzo", [("a-op", 1, 9999.0)]),
    # closing entry whose text also says inflation
    ("j08", "2024-03-31", "2024-04-02", 10, None, "Cierre INFL", [("a-op", 1, 5000.0)]),
    ("j09", "2024-03-31", "2024-04-02", 12, None, "Ajuste INFL marzo", [("a-op", 0, 50.0)]),
    # accounted before the first month, loaded after it
    ("j10", "2023-12-31", "2024-01-15", 9, None, None, [("a-op", 0, 888.0)]),
    # after the cutoff: charges exist, salaries do not
    ("j11", "2024-05-31", "2024-06-01", 9, None, "Cargas mayo", [("b-ch", 0, 60.0)]),
    # liability side: fallback months 2024-04 and 2024-05; null text stays, closing text goes
    ("j12", "2024-04-30", "2024-04-30", 4, None, None, [("owe-a", 0, 300.0), ("owe-b", 0, 100.0)]),
    ("j13", "2024-04-30", "2024-04-30", 4, None, "Asiento de cierre", [("owe-a", 0, 9000.0)]),
    ("j14", "2024-04-30", "2024-04-30", 4, None, "Pago", [("owe-a", 1, 70.0), ("pool", 0, 80.0), ("dues", 0, 40.0), ("dues", 1, 4.0)]),
    ("j15", "2024-05-31", "2024-05-31", 4, None, "Pago", [("owe-a", 0, 200.0)]),
    # pool without salaries in its month: nowhere to go
    ("j16", "2024-06-30", "2024-06-30", 4, None, "Pago", [("pool", 0, 1234.0)]),
    # expenses
    ("j20", "2024-01-10", "2024-01-10", 8, "c1", "Factura A 1", [("x-up", 0, 100.0), ("x-pat", 0, 10.0)]),
    ("j21", "2024-01-11", "2024-01-11", 8, "c1", "nota de crédito 9", [("x-up", 0, 30.0)]),
    ("j22", "2024-01-12", "2024-01-12", 8, "c2", "Factura B", [("x-pat", 0, 7.0), ("x-dup1", 0, 3.0), ("x-dup2", 0, 4.0)]),
    ("j23", "2024-01-13", "2024-01-13", 2, None, "Fondo", [("x-wat", 0, 11.0), ("x-up", 0, 99.0)]),
    ("j24", "2024-01-14", "2024-01-14", 8, None, "AJ INFL", [("x-up", 0, 1.0)]),
    ("j25", "2024-01-15", "2024-01-15", 0, "c1", None, [("x-up", 0, 1.0)]),
    ("j26", "2024-01-16", "2024-01-16", 8, "c9", None, [("x-up2", 0, 5.0), ("x-no", 0, 6.0), ("cap", 0, 900.0)]),
    ("j27", "2024-01-17", "2024-01-17", 8, "c1", "PAGO ESPECIAL", [("x-up", 0, 15.0)]),
    # header without lines; loaded too early
    ("j30", "2024-01-20", "2024-01-20", 8, "c1", "Sin items", []),
    ("j31", "2023-05-01", "2023-05-01", 8, "c1", "Viejo", [("x-up", 0, 1.0)]),
]

ROWS = {
    "facturas": [
        ("f1", "k1", "t3", "m1", day("2024-01-05"), 12, 0, 1, 1, 10.0),
        ("f2", "k1", "t3", "m1", day("2024-01-06"), 123456789, 1, None, 1, 0.0),
        ("f3", "k2", "t4", "m2", day("2024-02-01"), None, 2, 9, 1, 0.0),
        ("f4", "k2", "t9", "m-none", day("2024-02-01"), 3, None, 2, 1, 0.0),
        ("f5", "k3", None, "m1", day("2024-02-02"), 4, 0, 1, 6, 0.0),
        ("f6", "k1", "t8", "m1", day("2023-07-01"), 5, 0, 1, 1, 0.0),
        ("f7", "k2", "t4", "m1", day("2024-02-01"), 6, 0, 1, 1, 0.0),
        ("f8", "k-none", "t4", "m1", day("2023-01-01"), 7, 0, 1, 1, 0.0),
    ],
    "facturasitems": [
        ("f1", "p1", 1000.0),
        ("f1", "p1", 500.5),
        ("f1", "p-veh", 1e6),
        ("f2", "p1", 100.0),
        ("f3", "p1", 40.0),
        ("f4", "p1", 77.0),
        ("f5", "p1", 9.0),
        ("f6", "p1", 9.0),
        ("f7", "p-none", 9.0),
        ("f7", "p-null", 9.0),
    ],
    "productos": [("p1", "SVC", "Servicio", "servicio de campo"), ("p-veh", "4.VEH.10.5", "Camion", "bien"), ("p-null", None, "x", "y")],
    "monedacotizaciones": [("m1", 1.0), ("m2", 850.25)],
    "talonarios": [("t3", 3), ("t4", 4), ("t8", 8), ("t9", 9)],
    "contactos": [
        ("k1", "e1", "Ana", "Prueba", "a@example.org", day("2023-01-01"), day("2024-01-01")),
        ("k2", "e2", "Beto\x07", "Ejemplo", None, day("2023-06-01"), day("2023-06-02")),
        ("k3", "e2", "Caro", "Ejemplo", None, day("2023-07-01"), day("2023-07-02")),
        ("k4", "e3", "Dani", "Modelo", "d@example.org", None, None),
    ],
    "empresas": [("e1", "Empresa Uno"), ("e2", "Empresa Dos"), ("e3", "Proveedora Tres")],
    "industriaysub": [("e1", "Salud"), ("e1", "Agro"), ("e2", "Salud")],
    "tiposysub": [("e1", "CLIENTE"), ("e2", "CLIENTE"), ("e3", "CLIENTE"), ("e3", "PROVEEDOR")],
    "asientos": [(j, day(a), day(l), o, ref, text) for j, a, l, o, ref, text, _ in JOURNALS],
    "asientositems": [
        (j, account, side, amount, 0, f"mv-{account}") for j, _, _, _, _, _, lines in JOURNALS for account, side, amount in lines
    ],
    "cuentascontables": [(i, number, name, "1.2.3", 1) for i, number, name in ACCOUNTS],
    "compras": [
        ("c1", "k4", "s1", day("2024-01-10"), "1", 1, "m2", 1, 0),
        ("c2", "k4", "s2", day("2024-02-10"), "2", 1, None, 0, 0),
        ("c3", "k4", "s1", day("2024-03-10"), "3", 1, "m1", 2, 0),
        ("c4", "k4", "s1", day("2024-03-11"), "4", 1, "m1", 1, 1),
        ("c5", "k4", "s3", day("2022-03-11"), "5", 1, "m1", 1, 0),
    ],
    "comprasitems": [("c1", "p1", 100.0), ("c1", "p1", 20.0), ("c2", "p1", 3.0), ("c3", "p1", 1e5), ("c4", "p1", 7.0), ("c5", "p1", 1.0)],
    # one party name with two ids; ids with odd characters
    "fiscal": [
        ("s1", "Ficticia SA", "30-1", "e3"),
        ("s2", " reasignada srl ", "30-2", "e1"),
        ("s3", "FICTICIA SA", "30-3", None),
        ('s,4"ñ', None, None, None),
    ],
    "movimientos": [("mv-x-up", "s1"), ("mv-x-pat", "s2"), ("mv-a-op", None), ("mv-lonely", "s3")],
}


def erp_tables(spark: SparkSession, **changes):
    rows = {**ROWS, **changes}
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def policy(spark: SparkSession, rows=None):
    return spark.createDataFrame(rows or POLICY_ROWS, POLICY)
