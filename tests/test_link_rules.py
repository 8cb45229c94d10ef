"""Rules of links: same labels as the plain rule, and no array of host suffixes per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import urls
from skuloom.operators.export import source_kind


def below(domain, names):
    return any(domain == n or domain.endswith("." + n) for n in names)


def test_equal_or_below_a_fixed_name(spark):
    names = ["build.com", "a-b.example.org"]
    domains = ["build.com", "www.build.com", "rebuild.com", "build.com.net", "buildxcom", "a-b.example.org", "x.a-b.example.org", "", ".build.com", "build.com\n"]
    got = spark.createDataFrame([(d,) for d in domains] + [(None,)], "d string").select("d", urls.in_domains(F.col("d"), names).alias("y")).collect()
    assert {r.d: r.y for r in got} == {d: below(d, names) for d in domains} | {None: None}


def test_suffixes_are_not_listed_per_row(spark):
    df = spark.range(1).selectExpr("concat('h', id, '.build.com') AS d").select(urls.in_domains(F.col("d"), urls.RETAILERS).alias("y"))
    assert "arrays_overlap" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_kinds_of_links(spark):
    cases = [
        ("https://u@www.maker.com:80/a.pdf?x", "", "", "Spec sheet PDF"), ("https://maker.com/Manual/a.PDF", "", "retailer", "Manual/archive"),
        ("https://x.com/a", "", "ARCHIVE page", "Manual/archive"), ("https://x.com/a", "", "spec_sheet", "Spec sheet PDF"),
        ("https://www.build.com/a", "build.com", "manufacturer", "Retailer"), ("https://x.com", "", "big_Retailer", "Retailer"),
        ("https://u:p@shop.maker.com:8080/a", " Maker.com ", "retail", "Manufacturer"), ("https://[::1]:80/", "", "manufacturer_url", "Manufacturer"),
        ("https://x.com/a", "maker.com", "", "Unknown"), ("https://x.com/a", None, None, "Unknown"), (None, "a.com", "image", "Unknown"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "u string, m string, h string")
    got = df.select(source_kind(F.col("u"), F.col("m"), F.col("h")).alias("k")).collect()
    assert [r.k for r in got] == [c[3] for c in cases]


def test_first_url_brackets_and_noise(spark):
    cases = [
        ("see (https://a.com/x), or", "https://a.com/x"), ("https://[bad", ""), ("https://a.com/x[1", "https://a.com/x[1"), ("https://a.com/SECRET", ""),
        ("https://a.com/Traceback", ""), ("none", ""), ("https://a.com.,;", "https://a.com"), ("", ""), ("https://]x", ""),
    ]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(urls.first_url(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [u for _, u in cases]
