"""Answers of a call in the rows: confidence decides about replacing, evidence goes into the notes."""

import pytest

from skuloom.operators.transcripts import SOURCE_NOTE, apply_transcript

ROW = {"row_id": 1, "conv_id": 7, "dimensions": "", "finish_color": "Oak", "model_sku": "", "brand": "Wolf", "supplier": "", "product_name": "", "category": "", "room": "", "price": "", "notes": ""}


@pytest.mark.parametrize(
    ("specs", "overwrite", "notes", "want"),
    [
        ([("Finish / Color", "brass", "low", "It is brass.")], True, "", ("Oak", "", "")),
        ([("Finish / Color", "brass", "medium", "It is brass.")], True, "a", ("brass", "finish_color", f"a\n{SOURCE_NOTE}\nFinish / Color evidence: It is brass.")),
        ([("Finish / Color", "brass", "high", "")], False, "a", ("Oak", "", "a")),
        ([("Material", "steel", "medium", "All steel.")], False, "", ("Oak", "notes", f"Material: steel\n{SOURCE_NOTE}\nNotes evidence: All steel.")),
        ([("Material", "steel", "low", "")], True, "a", ("Oak", "", "a")),
        ([("Price", "$5", "low", "Five."), ("Price", "$6", "high", "Six.")], False, SOURCE_NOTE, ("Oak", "price", f"{SOURCE_NOTE}\nPrice evidence: Six.")),
        ([("Price", "", "high", "x"), ("Brand", "Miele", "unresolved", "")], True, "", ("Oak", "", "")),
    ],
)
def test_apply(spark, specs, overwrite, notes, want):
    rows = spark.createDataFrame([tuple((ROW | {"notes": notes}).values())], ", ".join(f"{c} {'long' if c.endswith('_id') else 'string'}" for c in ROW))
    said = spark.createDataFrame([(7, *s) for s in specs], "conv_id long, field string, value string, confidence string, evidence string")
    out = apply_transcript(rows, said, overwrite)
    assert out.columns == [*["conv_id"], *[c for c in ROW if c != "conv_id"], "applied"]
    r = out.first()
    assert (r["finish_color"], r["applied"], r["notes"]) == want
