"""Themed sheets keep their rules on every row; offset layout; output file summary."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from sheetlake.operators import cells as cl
from sheetlake.operators import synth
from sheetlake.plans import views as V

SF = "/root/testdata/sf0.001"


def _rows(spark, theme):
    return [r.asDict() for r in synth.theme(V.table(spark, SF, "orders"), theme).collect()]


def test_every_theme_has_its_header_and_one_row_per_order(spark):
    n = V.table(spark, SF, "orders").count()
    for theme in synth.THEMES:
        df = synth.theme(V.table(spark, SF, "orders"), theme)
        assert df.columns[1:] == synth.HEADERS[theme]
        assert df.count() == n


def test_financial_rules(spark):
    for r in _rows(spark, "financial_invoices"):
        assert (r["Due_Date"] - r["Invoice_Date"]).days == 30
        assert r["Tax"] == (r["Amount"] * Decimal("0.08")).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
        assert r["Total"] == r["Amount"] + r["Tax"]
        assert r["Status"] in synth.INVOICE_STATUS and r["Payment_Method"] in synth.PAYMENT_METHODS
    for r in _rows(spark, "financial_transactions"):
        assert (r["Debit"] == 0) != (r["Credit"] == 0)
    for r in _rows(spark, "financial_balances"):
        assert r["Closing_Balance"] == r["Opening_Balance"] + r["Credits"] - r["Debits"]


def test_inventory_personnel_sales_rules(spark):
    for r in _rows(spark, "inventory_products"):
        assert 0 <= r["Quantity_On_Hand"] <= 500 and 10 <= r["Reorder_Level"] <= 50
    for r in _rows(spark, "inventory_warehouse"):
        assert r["Total_Value"] == r["Quantity"] * r["Unit_Cost"]
    for r in _rows(spark, "personnel_employees"):
        assert 40_000 <= r["Salary"] <= 150_000
    for r in _rows(spark, "personnel_departments"):
        assert 5 <= r["Employee_Count"] <= 50 and r["Budget"] % r["Employee_Count"] == 0
        assert 50_000 <= r["Budget"] // r["Employee_Count"] <= 100_000
    for r in _rows(spark, "sales_orders"):
        assert r["Total"] == r["Quantity"] * r["Unit_Price"]
    for r in _rows(spark, "sales_customers"):
        assert 500 <= r["Total_Revenue"] / r["Total_Orders"] <= 5000
    for r in _rows(spark, "sales_revenue"):
        assert r["Gross_Profit"] == r["Revenue"] - r["Cost_Of_Goods"]
        margin = (r["Gross_Profit"] * 100 / r["Revenue"]).quantize(Decimal("0.1"), rounding="ROUND_HALF_EVEN")
        assert r["Profit_Margin"] == f"{margin}%"


def test_offset_sheet_puts_titles_then_header(spark):
    themed = synth.theme(V.table(spark, SF, "orders"), "sales_orders")
    cells = synth.offset_sheet(themed, "sales_orders", 3, "/f/x.xlsx", generated="now")
    top = {(r.row, r.column): r.value for r in cells.where(F.col("row") <= 2).collect()}
    assert top[(0, 1)] == "Sales Orders Report" and top[(1, 1)] == "Generated: now"
    assert [top[(2, j)] for j in range(1, 10)] == synth.HEADERS["sales_orders"]
    assert cells.count() == (themed.count() + 3) * 9


def test_output_files_summary_on_written_cells(spark, tmp_path):
    out = str(tmp_path / "c")
    V.cells(spark, SF).write.parquet(out)
    got = cl.output_files_summary(spark.read.parquet(out)).collect()
    assert sum(r.n_rows for r in got) == V.cells(spark, SF).count()
    assert all(r.size_kb > 0 and r.output_file.endswith(".parquet") for r in got)
