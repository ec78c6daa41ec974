"""sheetlake: spreadsheet workbooks and wide tables as one table of cells, on Spark.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame
operators), ``sources`` (catalog, workbook decoding, ingest, cell and ledger
I/O), ``streaming`` (incremental conversion), ``plans`` (the registered
queries over the driver's tables).
"""

__version__ = "0.1.0"
