"""tallywright: management-accounting analytics expressed as Spark DataFrame plans.

The package is organised by what a user asks for:

* ``sources``    read tables and files, and bind them to the logical books
* ``functions``  column expressions (labels, periods, classification, money)
* ``operators``  sales, ledger, payroll, expense, purchase and party frames
* ``plans``      whole products: P&L, margin, statement, older P&L variants
* ``sinks``      multi-output reports and isolated exports
* ``catalog``    the named queries and the SQL each one is checked against

Everything is lazy: a function takes DataFrames and returns a DataFrame.
"""
