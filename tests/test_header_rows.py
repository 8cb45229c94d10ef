"""Header rows of tables: found by their first words, carried down in one pass."""

from __future__ import annotations

from skuloom.operators import documents as doc
from skuloom.operators import keyed


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_value_above_takes_one_pass(spark):
    """slices and their last values are found together, without a join of two aggregates."""
    rows = spark.createDataFrame([(1, 0, "a"), (1, 9, None), (1, 10, "b"), (1, 25, None), (2, 3, None), (2, 4, "c")], "k int, o int, v string")
    up = keyed.carry_down(rows, ["k"], "o", "v", "up", slice_rows=8)
    assert _plan(up).count("Aggregate [") == 1 and _plan(up).count("Join ") == 1
    assert {(r.k, r.o): r.up for r in up.collect()} == {(1, 0): None, (1, 9): "a", (1, 10): "a", (1, 25): "b", (2, 3): None, (2, 4): None}


def test_header_rows_and_cells_below_them(spark):
    """rows without the word of a main header are no header; the last header of a column counts, missing cells are blank."""
    cells = [
        (1, 1, 0, 0, ["MODEL--#", "Item/Description", "Item Name", "Qty"]), (1, 1, 0, 1, ["M-100", "Oven", "Big oven", "2 pcs"]), (1, 1, 0, 2, ["M-200", "Sink"]),
        (1, 1, 0, 3, ["Finish", "Qty", "Price"]), (1, 1, 0, 4, ["MFR", None, "Part No", "Colour"]), (1, 1, 0, 5, ["Acme", "x", "P-3000", "Red", "more"]),
        (2, 1, 0, 1, None), (2, 1, 0, 2, ["Wolf sink Model: S-400"]),
    ]
    rows = doc.cells_to_rows(spark.createDataFrame(cells, "doc_id long, page int, table_no int, row_no int, cells array<string>"))
    got = {(r.doc_id, r.row_no): (r.product_name, r.brand, r.model_sku, r.quantity, r.finish_color) for r in rows.collect()}
    assert got == {
        (1, 1): ("Big oven", "", "M-100", 2, ""), (1, 2): ("", "", "M-200", 1, ""), (1, 5): ("", "Acme", "P-3000", 1, "Red"),
        (2, 2): ("Wolf sink", "Wolf", "S-400", 1, ""),
    }
