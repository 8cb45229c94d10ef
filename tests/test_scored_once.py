"""Rows of the export are scored once, although the search for the best row and the join back both read the scores."""

from __future__ import annotations

from skuloom.operators import export
from skuloom.registry import source


def test_both_sides_read_the_written_scores(spark):
    rows = source(spark, "/root/testdata/sf0.001", "intake_wide").limit(200)
    files = export.mark_duplicates(rows).inputFiles()
    assert files and all("/scored-" in f for f in files)
