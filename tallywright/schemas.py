"""Logical entities: the columns an operator may rely on.

A binding (``sources/erp_books.py``, ``sources/order_books.py``) maps physical tables to
these entities. Column sets are minimal; a binding may carry a column on another entity of
the same join (for example a line-level discount), since joins are by shared key name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# ten digits before the point; price x rate x discount then keeps eight decimals
RATE = T.DecimalType(18, 8)
# monthly results: room for rates and shares beyond cents
AMOUNT = T.DecimalType(28, 6)

ENTITIES: dict[str, dict[str, str]] = {
    # sales
    "invoice": {"invoice_id": "key", "contact_id": "key", "issued_at": "timestamp", "status": "string"},
    "invoice_line": {"invoice_id": "key", "product_id": "key", "price": "decimal(18,2)"},
    "product": {"product_id": "key", "code": "string"},
    "fx_rate": {"rate_id": "key", "rate": "decimal(10,4)"},
    "branch": {"branch_id": "key", "branch_no": "int"},
    "customer_card": {"contact_id": "key", "company": "string"},
    # ledger
    "journal": {"journal_id": "key", "accounting_at": "timestamp", "origin_code": "int"},
    "journal_line": {"journal_id": "key", "account_id": "key", "side": "int", "amount": "decimal(18,2)"},
    "account": {"account_id": "key", "account_no": "string", "account_name": "string", "class_code": "string"},
    "account_policy": {"account_no": "string", "account_name": "string", "consider": "string"},
    "account_category": {"category_key": "string", "category": "string"},
    "origin_party": {"origin_id": "key", "party": "string"},
    "movement": {"movement_id": "key", "fiscal_id": "key"},
    "fiscal_party": {"fiscal_id": "key", "party": "string", "tax_id": "string"},
    # parties
    "contact": {"contact_id": "key", "company_id": "key", "created_at": "timestamp", "modified_at": "timestamp"},
    "company": {"company_id": "key", "company": "string"},
    "industry": {"company_id": "key", "segment": "string"},
    "party_type": {"company_id": "key", "party_type": "string"},
    "contact_invoice": {"contact_id": "key", "issued_at": "timestamp"},
    # purchases
    "supplier_contact": {"contact_id": "key", "company_id": "key", "created_at": "timestamp"},
    "supplier_company": {"company_id": "key", "company": "string"},
    "supplier_type": {"company_id": "key", "party_type": "string"},
    "purchase": {"purchase_id": "key", "created_at": "timestamp", "state": "int"},
    "purchase_line": {"purchase_id": "key", "price": "decimal(18,2)"},
}

# The workbook of the chart of accounts: ten columns, named by position.
ACCOUNT_POLICY = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "account_no",
            "level",
            "kind",
            "account_name",
            "created_at",
            "modified_at",
            "side",
            "postable",
            "unused",
            "consider",
        )
    ]
)

ACCOUNT_CATEGORY = T.StructType(
    [T.StructField("category_key", T.StringType()), T.StructField("category", T.StringType())]
)


class Books(Mapping[str, DataFrame]):
    """Entities by name, each built on first use and checked for its key columns.

    A query touches a few entities; the others are never planned and their files never opened.
    """

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            frame = self._builders[name]()
            missing = {c for c, kind in ENTITIES.get(name, {}).items() if kind == "key"} - set(frame.columns)
            if missing:
                raise ValueError(f"entity {name!r} lacks {sorted(missing)}; it has {frame.columns}")
            self._frames[name] = frame
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replaced(self, **frames: DataFrame) -> Books:
        """The same books with some entities exchanged, for example another policy table."""
        return Books({**self._builders, **{name: (lambda f=frame: f) for name, frame in frames.items()}})
