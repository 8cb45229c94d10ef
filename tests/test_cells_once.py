"""Headers of table rows are read once, although the search for the header above reads the rows several times."""

from __future__ import annotations

from skuloom.operators import documents as doc


def test_rows_come_from_the_written_table(spark):
    cells = [(1, 1, 0, 0, ["Model #", "Description", "Qty"]), (1, 1, 0, 1, [" M-100 ", "Oven", "2 pcs"]), (1, 1, 0, 2, ["M-200", "", "x"])]
    rows = doc.cells_to_rows(spark.createDataFrame(cells, "doc_id long, page int, table_no int, row_no int, cells array<string>"))
    files = rows.inputFiles()
    assert files and all("/cells-" in f for f in files)
    got = rows.select("row_no", "product_name", "model_sku", "quantity").collect()
    assert sorted(map(tuple, got)) == [(1, "Oven", "M-100", 2), (2, "", "M-200", 1)]
