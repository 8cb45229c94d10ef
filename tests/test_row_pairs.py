"""Pairing and merging of parser and model rows against the rule written as a plain walk."""

import random
import re

import pytest

from skuloom.operators import documents as doc

COLS = "doc_id long, position long, model_sku string, product_name string"


def norm(v):
    return re.sub("[^a-z0-9]+", "", (v or "").lower())


def walk(left, right):
    used, out = set(), []
    for i, (_, p, model, name) in enumerate(left):
        model, name = norm(model), norm(name)
        free = [k for k in range(len(right)) if k not in used]
        hit = next((k for k in free if model and norm(right[k][2]) == model), None)
        if hit is None and i in free:
            hit = i
        if hit is None and name:
            hit = next((k for k in free if norm(right[k][3]) and (name in norm(right[k][3]) or norm(right[k][3]) in name)), None)
        used.add(hit)
        out.append((p, None if hit is None else right[hit][1]))
    return out + [(None, r[1]) for k, r in enumerate(right) if k not in used]


def expected(left, right):
    docs = {r[0] for r in [*left, *right]}
    side = lambda rows, d: sorted(r for r in rows if r[0] == d)
    return sorted(((d, *pair) for d in docs for pair in walk(side(left, d), side(right, d))), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_pairs(spark, seed):
    rng = random.Random(seed)
    models = ["", "", "M-1", "m1", "M2", "M3", None]
    names = ["", None, "oven", "wall oven", "Oven 30", "range", "gas range", "sink", "ra", "in"]
    rows = lambda most: [
        (d, p * 3, rng.choice(models), rng.choice(names)) for d in range(60) for p in range(rng.randint(0, most))
    ]
    left, right = rows(9), rows(7)
    frame = lambda r: spark.createDataFrame(r, COLS).repartition(3)
    got = sorted(map(tuple, doc.pair_rows(frame(left), frame(right)).collect()), key=str)
    assert got == expected(left, right)


def test_one_large_document(spark):
    """One document with hundreds of rows of one model, of one name, and without either."""
    rng = random.Random(9)
    left = [(1, p, rng.choice(["M1", "M1", "", "M2"]), rng.choice(["oven", "oven", "gas oven", ""])) for p in range(700)]
    right = [(1, p, rng.choice(["m1", "", "m2", "m9"]), rng.choice(["oven", "", "oven 30"])) for p in range(500)]
    got = sorted(map(tuple, doc.pair_rows(spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS)).collect()), key=str)
    assert got == expected(left, right)


def test_names_meet_where_one_holds_the_other(spark):
    rng = random.Random(3)
    words = lambda n: sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(n)})
    a, b = words(80), words(80)
    frame = lambda names: spark.createDataFrame([(d, n) for d in (1, 2) for n in names], "doc_id long, name string")
    got = sorted(map(tuple, doc._linked_names(frame(a), frame(b)).collect()))
    assert got == sorted((d, x, y) for d in (1, 2) for x in a for y in b if x in y or y in x)


def test_merged_rows(spark):
    """Matched, lonely parser and lonely model rows, with the columns of both sides and the audit."""
    left = "doc_id long, position long, product_name string, brand string, model_sku string, dimensions string, supplier string, category string, quantity long, notes string, status string, source_type string, page int, review_required boolean"
    right = left.replace("page int", "answer int")
    p = spark.createDataFrame([(1, 0, "Range", "Wolf", "M1", "d", "s", "c", 2, "a", "", "PDF", 4, False), (1, 1, "", "", "", "", "", "", 0, "", "Open", "PDF", 5, None)], left)
    m = spark.createDataFrame([(1, 0, "Gas Range", "", "m-1", "", "", "", 1, "b", "x", "AI", 7, True), (2, 0, "Oven", "", "", "", "", "", None, None, "", "AI", 8, True)], right)
    out = {(r["doc_id"], r["p_position"], r["m_position"]): r for r in doc.merge_rows(p, m).collect()}
    assert set(out) == {(1, 0, 0), (1, 1, None), (2, None, 0)}
    both, alone, model = out[1, 0, 0], out[1, 1, None], out[2, None, 0]
    assert (both["product_name"], both["model_sku"], both["quantity"], both["notes"]) == ("Gas Range", "m-1", 2, "a b")
    assert (both["status"], both["source_type"], both["page"], both["answer"], both["review_required"]) == ("Ready for Review", "PDF_AI", 4, 7, True)
    assert (both["deterministic_product_name"], both["ai_product_name"], both["final_product_name"]) == ("Range", "Gas Range", "Gas Range")
    assert both["ai_used"] and both["parse_confidence"] == 100 and both["missing_critical_fields_before_ai"] == ""
    assert not alone["ai_used"] and alone["ai_skipped_reason"] == doc.NO_MATCH and alone["status"] == "Open" and alone["page"] == 5 and alone["answer"] is None
    assert alone["missing_critical_fields_after_ai"] == "Product Name, Brand, Model/SKU, Dimensions, Supplier, Product Category, Quantity"
    assert model["product_name"] == "Oven" and model["source_type"] == "AI" and model["answer"] == 8 and model["parse_confidence"] == 25
    assert doc.merge_rows(p.limit(0), m.limit(0)).collect() == []


def test_short_documents_need_no_rounds(spark, monkeypatch):
    """Documents around the limit give the same pairs walked or in rounds; without a long one no round is made."""
    rng = random.Random(4)
    rows = lambda: [(d, p, rng.choice(["", "M1", "m2"]), rng.choice(["oven", "gas oven", ""])) for d in range(30) for p in range(rng.randint(0, 5))]
    left, right = rows(), rows()
    a, b = spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS)
    assert sorted(map(tuple, doc.pair_rows(a, b, 3).collect()), key=str) == expected(left, right)
    monkeypatch.setattr(doc, "_pairs_in_rounds", None)
    assert sorted(map(tuple, doc.pair_rows(a, b).collect()), key=str) == expected(left, right)
