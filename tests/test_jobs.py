"""Whole-table jobs against brute force, and invariants."""

import random




from skuloom.operators import documents as doc
from skuloom.operators import export, keyed, page_parse, pages
from skuloom.operators.memory import upsert_memory
from skuloom.registry import source

SF = "/root/testdata/sf0.001"


def test_number_and_carry(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, f"h{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, h string")
    got = {(r.k, r.o): r.n for r in keyed.number_within(df, ["k"], "o", slice_rows=16).collect()}
    up = {(r.k, r.o): r.up for r in keyed.carry_down(df, ["k"], "o", "h", "up", slice_rows=16).collect()}
    for key in "ab":
        last, n = None, 0
        for k, o, h in rows:
            if k == key:
                n += 1
                assert got[(k, o)] == n and up[(k, o)] == last
                last = h or last


def test_pairs(spark):
    p = [(1, 0, "M-1", "gas range"), (1, 1, "", "wall oven"), (1, 2, "M9", "sink")]
    m = [(1, 0, "m1", "range"), (1, 1, "zz", "sink"), (1, 2, "yy", "lamp"), (1, 3, "m9", "x")]
    cols = "doc_id long, position long, model_sku string, product_name string"
    got = {(r.p_position, r.m_position) for r in doc.pair_rows(spark.createDataFrame(p, cols), spark.createDataFrame(m, cols)).collect()}
    assert got == {(0, 0), (1, 1), (2, 3), (None, 2)}


def test_export_conserves_rows(spark):
    rows = source(spark, SF, "intake_wide")
    marked = export.mark_duplicates(rows).select("row_id", "removed", "kept_row_id", "richness").toPandas()
    assert len(marked) == rows.count() and marked["row_id"].is_unique
    kept = marked[~marked["removed"]].set_index("row_id")["richness"]
    gone = marked[marked["removed"]]
    assert len(gone) and (kept.loc[gone["kept_row_id"].astype(int)].to_numpy() > gone["richness"].to_numpy()).all()


def test_page_elements_and_images(spark):
    html = (
        '<html><head><title>Range X1 | Maker</title><meta property="og:image" content="/og.jpg">'
        '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Range","image":"https://m.com/x1.jpg","width":"30 in"}]}</script>'
        '</head><body><div class="gallery"><img src="a.png" srcset="b.png 800w, c.png 1200w" alt="X1"></div>'
        '<div class="product hero" style="background:url(\'/bg.webp\')"></div><dl><dt>Height</dt><dd>84 in</dd></dl></body></html>'
    )
    df = spark.createDataFrame([(1, "https://m.com/p/x1", html)], "page_id long, url string, html string")
    elements = page_parse.page_elements(df)
    found = {(r.image_url, r.source_type, r.width) for r in pages.page_images(elements, df).collect()}
    assert found == {
        ("https://m.com/og.jpg", "og:image", None), ("https://m.com/p/a.png", "img", None), ("https://m.com/p/b.png", "img_srcset", 800),
        ("https://m.com/p/c.png", "img_srcset", 1200), ("https://m.com/bg.webp", "css_background", None), ("https://m.com/x1.jpg", "json_ld_image", None),
    }
    assert pages.page_fields(elements).collect()[0].name == "Range"
    size = pages.page_dimensions(elements).collect()[0]
    assert size.axes == 1 and size.method == "json_ld"


def test_sinks(spark, tmp_path):
    from skuloom.sources import sinks

    rows = export.import_rows(export.prepare(source(spark, SF, "intake_wide")))
    sinks.write_import_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == list(sinks.IMPORT_HEADER) and back.count() == rows.count()
    log = spark.createDataFrame([("2026-01-01", " House 1", "a", "", "success", "")], "timestamp string, project string, product_name string, product_url string, status string, message string")
    sinks.append_log(log, str(tmp_path / "log"))
    assert [r.project for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["House_1"]


def test_sources(spark, tmp_path):
    from skuloom.sources import intake_sources as src

    (tmp_path / "urls.txt").write_text(" https://a.com/x \n\n\thttps://b.com\n")
    got = src.read_url_list(spark, str(tmp_path / "urls.txt"), project="P").collect()
    assert sorted(r.product_url for r in got) == ["https://a.com/x", "https://b.com"] and got[0].project == "P"
    (tmp_path / "side_table-1.pdf").write_bytes(b"x")
    assert [r.product_name for r in src.read_documents(spark, str(tmp_path)).collect()] == ["side table 1"]


def test_memory_upsert_keeps_whole_records(spark):
    keys = "normalized_brand string, normalized_model_sku string, "
    rest = "source_type string, confidence_score int, success_count int, failure_count int, dimensions_text string, width_in double"
    old = spark.createDataFrame(
        [("a", "1", "manufacturer", None, 2, 0, "3 x 4", 5.0, "kept", "2020"), ("b", "1", "retailer", 90, 1, 1, "", 0.0, "n", None)],
        keys + rest + ", note string, first_seen_at string",
    )
    new = spark.createDataFrame(
        [("a", "1", "other", None, 1, 0, "", None, "2024"), ("b", "1", "manual", None, 0, 1, "9 x 9", 2.0, "2024"), ("c", "1", "other", None, 1, 0, "", 1.0, "2024")],
        keys + rest + ", first_seen_at string",
    )
    got = {r.normalized_brand: r for r in upsert_memory(old, new).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].source_type, got["a"].dimensions_text, got["a"].width_in, got["a"].note, got["a"].first_seen_at) == ("manufacturer", "3 x 4", 5.0, "kept", "2020")
    assert (got["a"].success_count, got["b"].failure_count) == (3, 2)
    assert (got["b"].source_type, got["b"].confidence_score, got["b"].dimensions_text, got["b"].first_seen_at) == ("manual", 90, "9 x 9", "2024")
    assert (got["c"].source_type, got["c"].note, got["c"].width_in) == ("other", None, 1.0)
