"""Golden cases of single-row rules."""

from pyspark.sql import functions as F

from skuloom.functions import dims, rules, urls
from skuloom.functions import text as tx
from skuloom.operators import transcripts as tr
from skuloom.operators.candidates import model_variants, weak_page_reason
from skuloom.operators.pages import dimension_candidates


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_dimensions(spark):
    got = values(spark, ['14 7/8"W x 22 in D x 33.375 in H', "Width: 36, Height 84", "12 x 14", '5"L', "30 wide"], dims.parse_dims)
    assert (got[0].width, got[0].depth, got[0].height) == ("14 7/8", "22", "33.375")
    assert (got[1].width, got[1].height, got[1].depth) == ("36", "84", "")
    assert got[2].width == "" and got[3].length == "5"


def test_sanity(spark):
    got = values(
        spark,
        ['2"W x 3"H x 4"D', 'box 10"W', '400"W', "", '3"W x 4"H x 9"D', "rough-in 3", '0"W'],
        lambda c: dims.sanity_reason(c, F.lit("Appliances")),
    )
    assert got == [
        "width below plausible appliance bounds", "shipping/package dimensions", "dimension exceeds plausible product bounds",
        "", "width below plausible appliance bounds", "cutout/opening dimensions", "non-positive dimension value",
    ]


def test_numbers(spark):
    assert values(spark, ["14 7/8", "7/8", "1/0", "x", "2.5"], dims.to_number) == [14.875, 0.875, None, None, 2.5]
    assert values(spark, ["1/3", "2 1/2", "9"], lambda c: dims.decimal_text(c, 4)) == ["0.3333", "2.5", "9"]


def test_title_and_location(spark):
    assert values(spark, ["half-bath o'neil 2nd floor"], tx.title_case) == ["Half-Bath O'Neil 2Nd Floor"]
    got = values(spark, ["bar - if we can fit it", "", "kitchen", "pantry - TBD later"], rules.normalize_location)
    assert [(g.location, g.score) for g in got] == [("Bar", 65), ("", 0), ("Kitchen", 90), ("Pantry", 65)]


def test_urls(spark):
    got = values(
        spark,
        ["", "https://a b.com", "ftp://x.com", "https://[bad", "https://nodot", "http://localhost:3", "https://1.2.3.4/x", "https://ok.com"],
        urls.url_problem,
    )
    assert got == [
        "empty URL", "malformed URL: contains whitespace", "malformed URL: unsupported scheme ftp", "Invalid IPv6 URL: Invalid IPv6 URL",
        "malformed domain: nodot", "", "", "",
    ]
    weak = values(spark, ["https://x.com", "https://x.com/collections", "https://x.com/a/search?x=1", "https://x.com/p/1", "https://x.com/a.pdf"], weak_page_reason)
    assert weak == ["homepage", "category/browse page", "search result page", "", "spec PDF, not product page"]


def test_sections(spark):
    got = values(spark, ["decorative table lamp", "Stone/Tile", "knob", "", "plumbing"], rules.normalize_section)
    assert got == ["Lighting", "Flooring", "Hardware", "General", "Plumbing"]
    assert values(spark, ["plumbing", "Chair", "other", "rugs"], rules.normalize_category) == ["Hardware", "Seating", "", "Rugs"]


def test_notes(spark):
    got = values(spark, ["[x: y] 3. Call first\nTraceback here\nkeep", "row 4 - Hello"], tx.clean_notes)
    assert got == ["Call first keep", "Hello"]


def test_model_variants(spark):
    assert values(spark, ["DEC36RID/R"], model_variants) == [["DEC36RID/R", "DEC36RIDR", "DEC36RID", "DEC36R"]]


def test_spoken_numbers(spark):
    assert values(spark, ["it is eighty-four inches", "one hundred and two", "no"], tr.number_words) == ["it is 84inches", "102", "no"]


def test_spoken_sizes(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "a", "Yes, for the Scotsman SCN60PA1SU, the dimensions are twenty four inches wide, twenty three inches deep, and thirty four inches high."),
            (2, 0, "a", "width 36"), (3, 0, "a", None), (3, 1, "a", ""), (4, 0, "a", "width 36"), (4, 1, "a", "it is forty inches wide"),
        ],
        "conv_id long, turn int, role string, text string",
    )
    got = {(r.conv_id, r.field): (r.value, r.confidence) for r in tr.transcript_specs(turns, ("Width", "Price")).collect()}
    assert len(got) == 12
    assert got[1, "Dimensions"] == ("24 in W x 23 in D x 34 in H", "high") and got[1, "Width"] == ("24 in", "high")
    assert got[2, "Dimensions"] == ("", "unresolved") and got[2, "Width"] == ("36 in", "medium")
    assert got[4, "Width"] == got[3, "Width"] == got[1, "Price"] == ("", "unresolved")


CANDIDATES = [
    ('Product Dimensions: 3"W x 4"H x 5"D.\nShipping dimensions: 9 x 9 x 9 in', ['3"W x 4"H x 5"D']),
    ("Size 10 cm x 20 cm x 30 cm", ['3.937"W x 7.874"D x 11.811"H']),
    ("Cutout dimensions: 3 x 4 x 5", []),
    ("Überall 😀 size: 1/2 x 3 1/4 x 5;\nSize: 1/2 x 3 1/4 x 5", ["1/2 x 3 1/4 x 5", '1/2"W x 3 1/4"D x 5"H']),
    ("box 3 x 4 x 5", []),
    ("no figures here", []),
    ("", []),
    (None, []),
]


def test_dimension_candidates(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CANDIDATES)], "k int, t string")
    got = df.select("k", dimension_candidates(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r["c"] for r in got] == [want for _, want in CANDIDATES]


def test_cutout_candidates(spark):
    df = spark.createDataFrame([("Cutout dimensions: 3 x 4 x 5",)], "t string")
    assert df.select(dimension_candidates(F.col("t"), cutout=True)).first()[0] == ["3 x 4 x 5"]
