"""Themed test sheets derived from a table, and their placement in a sheet grid.

Every themed row is computed from one seed row (default: ``orders``) with
integer arithmetic only -- no random numbers -- so the sheets grow with the
table, are the same on every run and can be rebuilt by any SQL engine.
Money is ``DECIMAL(18,2)``; each theme keeps its rule (for example
``Total = Amount + Tax``, ``Closing = Opening + Credits - Debits``).

``offset_sheet`` lays a theme out as a worksheet would look after reading:
up to three title lines, then the header row, then the data rows (blank rows
between them are dropped by the reader, so the header sits right below the
titles), all as cells.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CELL_AT, literal_rows
from ..session import cut_lineage, ship_package
from . import reshape

# ---------------------------------------------------------------------------
# Theme names, header rows and the choice lists of each theme.
THEMES = (
    "financial_invoices", "financial_transactions", "financial_balances", "inventory_products",
    "inventory_warehouse", "personnel_employees", "personnel_departments", "sales_orders",
    "sales_customers", "sales_revenue",
)
HEADERS = {
    "financial_invoices": ["Invoice_ID", "Customer_Name", "Invoice_Date", "Due_Date", "Amount", "Tax", "Total",
                           "Status", "Payment_Method"],
    "financial_transactions": ["Transaction_ID", "Account_Number", "Transaction_Date", "Description", "Debit",
                               "Credit", "Balance", "Category"],
    "financial_balances": ["Account_ID", "Account_Name", "Account_Type", "Opening_Balance", "Credits", "Debits",
                           "Closing_Balance", "Last_Updated"],
    "inventory_products": ["SKU", "Product_Name", "Category", "Quantity_On_Hand", "Unit_Price", "Supplier",
                           "Reorder_Level", "Last_Restocked"],
    "inventory_warehouse": ["Location_Code", "Aisle", "Bin", "Product_SKU", "Quantity", "Unit_Cost", "Total_Value",
                            "Last_Counted"],
    "personnel_employees": ["Employee_ID", "First_Name", "Last_Name", "Department", "Position", "Hire_Date",
                            "Salary", "Email", "Status"],
    "personnel_departments": ["Department_ID", "Department_Name", "Manager", "Employee_Count", "Budget",
                              "Cost_Center", "Location"],
    "sales_orders": ["Order_ID", "Customer_Name", "Order_Date", "Product", "Quantity", "Unit_Price", "Total",
                     "Shipping_Method", "Status"],
    "sales_customers": ["Customer_ID", "Company_Name", "Contact_Person", "Email", "Phone", "Total_Orders",
                        "Total_Revenue", "Last_Order_Date"],
    "sales_revenue": ["Period", "Region", "Product_Line", "Units_Sold", "Revenue", "Cost_Of_Goods", "Gross_Profit",
                      "Profit_Margin"],
}
INVOICE_STATUS = ["Paid", "Pending", "Overdue", "Cancelled"]
PAYMENT_METHODS = ["Credit Card", "Bank Transfer", "Check", "Cash"]
TRANSACTION_CATEGORIES = ["Utilities", "Payroll", "Revenue", "Supplies", "Rent"]
ACCOUNT_TYPES = ["Asset", "Liability", "Revenue", "Expense", "Equity"]
PRODUCT_CATEGORIES = ["Electronics", "Clothing", "Food", "Hardware", "Office"]
DEPARTMENTS = ["Sales", "Engineering", "Marketing", "Finance", "HR", "Operations"]
EMPLOYEE_STATUS = ["Active", "On Leave", "Terminated"]
SHIPPING_METHODS = ["Standard", "Express", "Overnight", "International"]
ORDER_STATUS = ["Pending", "Shipped", "Delivered", "Cancelled"]
REGIONS = ["North", "South", "East", "West", "Central"]
# ---------------------------------------------------------------------------

MONEY = "decimal(18,2)"


def _choice(options: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx + 1).cast("int"))


def _mod(col: Column, n: int) -> Column:
    return F.pmod(col, F.lit(n))


def _cents(col: Column) -> Column:
    """Integer cents -> DECIMAL(18,2) money."""
    return (col.cast("decimal(18,0)") / F.lit(100)).cast(MONEY)


def _id(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix), col.cast("string"))


def theme(seed: DataFrame, name: str, key: str = "o_orderkey", other: str = "o_custkey",
          when: str = "o_orderdate") -> DataFrame:
    """Rows of theme ``name``, one per seed row (plus the seed ``key`` for ordering)."""
    k, c = F.col(key), F.col(other)
    day = F.to_date(F.col(when))
    mix = _mod(k * F.lit(7919), 1_000_003)  # a second, scrambled driver of values
    if name == "financial_invoices":
        amount = _cents(F.lit(10_000) + _mod(mix, 990_000))
        tax = (amount * F.lit(Decimal("0.08"))).cast(MONEY)
        cols = [_id("INV-", F.lit(10_000) + _mod(k, 90_000)), _id("Customer#", c), day, F.date_add(day, 30),
                amount, tax, (amount + tax).cast(MONEY), _choice(INVOICE_STATUS, _mod(k, 4)),
                _choice(PAYMENT_METHODS, _mod(c, 4))]
    elif name == "financial_transactions":
        amount = _cents(F.lit(1_000) + _mod(mix, 499_000))
        debit = _mod(k, 2) == 0
        zero = F.lit(0).cast(MONEY)
        cols = [_id("TXN-", F.lit(100_000) + _mod(k, 900_000)), F.concat(F.lit("ACCT"), F.lpad(c.cast("string"), 10, "0")),
                day, F.concat(F.lit("Order "), k.cast("string")), F.when(debit, amount).otherwise(zero),
                F.when(debit, zero).otherwise(amount), _cents(F.lit(100_000) + _mod(c * F.lit(104_729), 4_900_000)),
                _choice(TRANSACTION_CATEGORIES, _mod(k, 5))]
    elif name == "financial_balances":
        opening = _cents(F.lit(1_000_000) + _mod(mix, 9_000_000))
        credits = _cents(F.lit(100_000) + _mod(k * F.lit(104_729), 1_900_000))
        debits = _cents(F.lit(100_000) + _mod(k * F.lit(1_299_709), 1_400_000))
        cols = [_id("ACC-", F.lit(1_000) + _mod(k, 9_000)), _id("Account ", c), _choice(ACCOUNT_TYPES, _mod(k, 5)),
                opening, credits, debits, (opening + credits - debits).cast(MONEY), day]
    elif name == "inventory_products":
        cols = [_id("SKU-", F.lit(10_000) + _mod(k, 90_000)), _id("Product ", k), _choice(PRODUCT_CATEGORIES, _mod(k, 5)),
                _mod(k, 501), _cents(F.lit(500) + _mod(mix, 49_500)), _id("Supplier ", c), F.lit(10) + _mod(k, 41), day]
    elif name == "inventory_warehouse":
        qty = F.lit(1) + _mod(k, 100)
        cost = _cents(F.lit(1_000) + _mod(mix, 19_000))
        cols = [F.concat(F.char(F.lit(65) + _mod(k, 6)), (F.lit(1) + _mod(k, 9)).cast("string")), F.lit(1) + _mod(k, 20),
                _id("B", F.lit(1) + _mod(k, 50)), _id("SKU-", F.lit(10_000) + _mod(c, 90_000)), qty, cost,
                (qty * cost).cast(MONEY), day]
    elif name == "personnel_employees":
        cols = [_id("EMP-", F.lit(1_000) + _mod(k, 9_000)), _id("First", c), _id("Last", k),
                _choice(DEPARTMENTS, _mod(k, 6)), _id("Position ", _mod(k, 10)), day,
                F.lit(40_000) + _mod(mix, 110_001), F.concat(F.lit("emp"), k.cast("string"), F.lit("@example.com")),
                _choice(EMPLOYEE_STATUS, _mod(k, 3))]
    elif name == "personnel_departments":
        count = F.lit(5) + _mod(k, 46)
        cols = [_id("DEPT-", F.lit(100) + _mod(k, 900)), _choice(DEPARTMENTS, _mod(k, 6)), _id("Manager ", c), count,
                count * (F.lit(50_000) + _mod(mix, 50_001)), _id("CC-", F.lit(1_000) + _mod(c, 9_000)),
                _id("City ", _mod(c, 100))]
    elif name == "sales_orders":
        qty = F.lit(1) + _mod(k, 100)
        price = _cents(F.lit(1_000) + _mod(mix, 49_000))
        cols = [_id("ORD-", F.lit(10_000) + _mod(k, 90_000)), _id("Customer#", c), day, _id("Product ", _mod(k, 1_000)),
                qty, price, (qty * price).cast(MONEY), _choice(SHIPPING_METHODS, _mod(k, 4)),
                _choice(ORDER_STATUS, _mod(c, 4))]
    elif name == "sales_customers":
        n = F.lit(1) + _mod(k, 50)
        avg = _cents(F.lit(50_000) + _mod(mix, 450_001))
        cols = [_id("CUST-", F.lit(1_000) + _mod(k, 9_000)), _id("Company ", c), _id("Contact ", k),
                F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")),
                F.concat(F.lit("555-"), F.lpad(_mod(k, 10_000).cast("string"), 4, "0")), n, (n * avg).cast(MONEY), day]
    elif name == "sales_revenue":
        units = F.lit(100) + _mod(k, 9_901)
        revenue = (units * (F.lit(20) + _mod(mix, 181))).cast(MONEY)
        cogs = (revenue * (F.lit(40) + _mod(k, 31)) / F.lit(100)).cast(MONEY)
        profit = (revenue - cogs).cast(MONEY)
        margin = F.concat(F.format_number(profit * F.lit(100) / revenue, 1), F.lit("%"))
        cols = [F.concat(F.lit("Q"), (F.lit(1) + _mod(k, 4)).cast("string"), F.lit("-"),
                         (F.lit(2022) + _mod(k, 3)).cast("string")),
                _choice(REGIONS, _mod(k, 5)), _choice(PRODUCT_CATEGORIES, _mod(c, 5)), units, revenue, cogs, profit,
                margin]
    else:
        raise ValueError(f"unknown theme {name!r}; known: {', '.join(THEMES)}")
    headers = HEADERS[name]
    return seed.select(k.alias("_seed"), *[col.alias(h) for col, h in zip(cols, headers)])


def display_name(name: str) -> str:
    """``sales_orders`` -> ``Sales Orders``."""
    return " ".join(w.capitalize() for w in name.split("_"))


def offset_sheet(themed: DataFrame, name: str, start_row: int, file_path: str, worksheet: str = "Data",
                 generated: str = "", total_records: int | None = None) -> DataFrame:
    """Cells of a theme laid out with its header on 1-based ``start_row``.

    Title lines (only where there is room above the header): the report
    title, ``Generated: ..`` and ``Total Records: N``; the blank rows between
    titles and header are dropped as a reader drops blank rows.  The grid is
    the header's width, so title rows carry nulls after column 1.
    """
    spark = themed.sparkSession
    headers = HEADERS[name]
    width = len(headers)
    titles = []
    if start_row > 1:
        titles.append(f"{display_name(name)} Report")
    if start_row > 2:
        titles.append(f"Generated: {generated}")
    if start_row > 3:
        n = total_records if total_records is not None else themed.count()
        titles.append(f"Total Records: {n}")
    top = len(titles)
    file_name = file_path.rsplit("/", 1)[-1]
    fixed_rows = []
    for i, t in enumerate(titles):
        fixed_rows.extend((i, j, t if j == 1 else None) for j in range(1, width + 1))
    fixed_rows.extend((top, j, h) for j, h in enumerate(headers, start=1))
    fixed = literal_rows(spark, fixed_rows, CELL_AT).select(
        F.lit(file_path).alias("file_path"), F.lit(file_name).alias("file_name"), F.lit(worksheet).alias("worksheet"),
        "row", "column", "value",
    )
    indexed = reshape.with_row_index(themed, ["_seed"]).withColumn("row", F.col("row") + F.lit(top + 1))
    data = reshape.to_cells(
        indexed,
        lineage={"file_path": F.lit(file_path), "file_name": F.lit(file_name), "worksheet": F.lit(worksheet)},
        columns=headers,
    )
    return fixed.unionByName(data)


def write_workbooks(
    df: DataFrame,
    folder: str,
    file_name: Column,
    order: list[str],
    columns: list[str],
    sheet: str = "Data",
    header: bool = True,
    rows_per_file: int = 50_000,
) -> DataFrame:
    """Write the rows of ``df`` as .xlsx workbooks under ``folder``; one task per workbook.

    Rows are grouped by ``file_name`` (a Column giving a stem), numbered in
    ``order`` inside each group with the skew-safe row index, and cut into
    workbooks of at most ``rows_per_file`` rows (``<stem>_part_<n>.xlsx``), so
    no task ever holds more than that many rows however large a group is.
    Each workbook has one sheet: an optional header row, then the data.  File
    names are fixed by the data, so a retried task rewrites the same file.
    Returns the written files (``file_path``, ``n_rows``), materialised.
    Each task streams its rows sorted by (file, row) and holds one file's rows
    at a time.
    """
    ship_package(df.sparkSession)
    base = df.select(file_name.alias("_wb_stem"), *order, *[c for c in columns if c not in order])
    idx = reshape.with_row_index(base, order, ["_wb_stem"], name="_wb_row")
    part = (F.floor(F.col("_wb_row") / F.lit(rows_per_file)) + 1).cast("bigint")
    named = idx.withColumn(
        "_wb_path",
        F.concat(F.lit(folder.rstrip("/") + "/"), F.col("_wb_stem"), F.lit("_part_"), part.cast("string"),
                 F.lit(".xlsx")),
    )
    cols = list(columns)

    def write_partition(batches):
        import pyarrow as pa

        from ..sources.files import open_output
        from ..sources.workbook_writer import write_xlsx

        done_paths, done_rows = [], []
        cur, rows = None, []

        def flush():
            with open_output(cur) as f:
                write_xlsx(f, {sheet: ([cols] if header else []) + rows})
            done_paths.append(cur)
            done_rows.append(len(rows))

        # rows arrive sorted by (file, row): one file is held at a time
        for batch in batches:
            d = batch.to_pydict()
            for i, path in enumerate(d["_wb_path"]):
                if path != cur:
                    if cur is not None:
                        flush()
                    cur, rows = path, []
                rows.append([d[c][i] for c in cols])
        if cur is not None:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(done_paths, pa.string()), pa.array(done_rows, pa.int64())],
                                         names=["file_path", "n_rows"])

    # Python does the heavy work here, so the task count follows the number of
    # files, not the shuffle size: an explicit repartition on the file (never
    # coalesced by AQE), rows sorted by (file, row) inside each task
    n_files = named.select("_wb_path").distinct().count()
    sc = df.sparkSession.sparkContext
    parts = max(1, min(n_files, max(2 * sc.defaultParallelism, -(-n_files // 32))))
    written = (
        named.select("_wb_path", "_wb_row", *cols)
        .repartition(parts, "_wb_path")
        .sortWithinPartitions("_wb_path", "_wb_row")
        .mapInArrow(write_partition, "file_path string, n_rows bigint")
    )
    return cut_lineage(written)
