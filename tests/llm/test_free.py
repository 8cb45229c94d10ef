"""The operators of free style against plain Python, round trips and held-out labels."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skuloom.llm import language_id, toxicity
from skuloom.llm.queries import URL_RULES, op7_language_id, op8_toxicity
from skuloom.llm.suffix_dedup import suffix_dedup
from skuloom.llm.url_reputation import judge_urls
from skuloom.llm.warc import LoserTree, archive_round_trip, merged_index, write_archives
from tests.llm import brute, cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


# WARC


PAGES = "page_id bigint, url string, html string, digest string, kind string"


def page_rows():
    big = "<p>é" * 60
    return [
        (5, "http://B.example.com/x?q=1#f", big, "d", "k"), (3, "http://a.example.com/", big, "d", "k"), (9, None, big, "d", "k"),
        (4, "http://a.example.com/", None, "d", "k"), (6, "http://a.example.com/\n\t", "", "d", "k"), (7, "no scheme", "short", "d", "k"),
        (8, "http://a.example.com/", "short", "d", "k"), (None, "http://n.example.com/", big + "n", "d", "k"),
        (10, "http://n.example.com/", big + "n", "d", "k"), (11, "u://x", big + "r", "d", "k"), (11, "u://x", big + "r", "d", "k"),
        (12, "u://y", "a\r\n\r\nWARC/1.1\r\n" * 40, "d", "k"),
    ] + [(100 + i, f"http://a.example.com/{i % 3}", big * (1 + i % 2), "d", "k") for i in range(30)]


def expected(rows):
    first = {}
    data = [(p, (h or "").encode()) for p, _, h, *_ in rows]
    for p, b in data:
        if len(b) >= 100:
            first.setdefault(b, []).append(p)
    used = set()
    for p, b in data:
        digest = hashlib.sha256(b).hexdigest()
        least = min((x for x in first.get(b, []) if x is not None), default=None)
        if len(b) < 100 or (p == least and b not in used):
            used.add(b)
            yield p, len(b), digest, "response", None
        else:
            yield p, len(b), digest, "revisit", least


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize(("per_range", "fan_in"), [(50_000, 512), (5, 2)])
def test_warc_round_trip(spark, per_range, fan_in):
    rows = page_rows()
    out = archive_round_trip(spark.createDataFrame(rows, PAGES).repartition(4), per_range=per_range, fan_in=fan_in)
    got = out.collect()
    same([r[:5] for r in got], expected(rows))
    got.sort(key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"].encode(), r["stamp"]) for r in got]
    assert keys == sorted(keys)
    seen = defaultdict(int)
    for r in got:
        seen[r["url_key"]] += 1
        assert r["capture"] == seen[r["url_key"]]
    assert archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(9):
        lists = [sorted(rnd.randrange(20) for _ in range(rnd.randrange(6))) for _ in range(k)]
        assert list(LoserTree([iter(x) for x in lists])) == sorted(x for y in lists for x in y)


# URL reputation


def test_url_rules(spark):
    urls = [
        "http://A.Example.net/en/x", "http://example.net/de/", "http://x.net/", "http://x.net", "http://notexample.net/en/",
        "https://m.example.com/de/1?q", "http://example.com/deX", "ftp://a.org/fr/", "http://org/fr/", "http://aorg/fr/",
        "http://a.org?x=/fr/", "http://a.org#/fr/", "nothing", "", None, "x://", "http://a\nb.net/\n?x", "http://É.net/É/",
    ]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[0], "h", "r")]
    out = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string"), spark.createDataFrame([], "page_id bigint, bad int"), URL_RULES)
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = brute.ascii_lower(rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)


def test_reputation_shrinks_and_blocks(spark):
    hosts = {"bad.evil.com": (40, 39), "new.evil.com": (0, 0), "few.good.com": (1, 1), "a.good.com": (60, 1), "b.good.com": (80, 2), "c.evil.com": (50, 48)}
    pages, out, n = [], [], 0
    for h, (total, bad) in hosts.items():
        for i in range(max(1, total)):
            pages.append((n, f"http://{h}/{i}"))
            if total:
                out.append((n, int(i < bad)))
            n += 1
    out += [(None, 1), (0, None), (10**6, 1)]
    got = judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(out, "page_id bigint, bad int"), [("allow", "none", "/")])
    verdict = {r["host"]: r["verdict"] for r in got.collect()}
    assert verdict["bad.evil.com"] == verdict["c.evil.com"] == "block"
    assert verdict["few.good.com"] == verdict["a.good.com"] == verdict["b.good.com"] == "allow"


# Language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op7_language_id(spark, SF).filter("held_out").join(docs, "doc_id")
    right, total = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * total
    assert out.filter("score < 0 OR score > 1").count() == 0


def test_language_awkward_rows(spark, docs, empty):
    both = docs.withColumn("held_out", F.lit(False))
    model = language_id.learn(both)
    assert set(model["langs"]) == {"de", "en"}
    got = language_id.predict(both, model).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for k in (1000, 1001, 1002):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    none = language_id.predict(both, language_id.learn(empty))
    assert none.filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty.withColumn("held_out", F.lit(False)), model).count() == 0


def test_forward_sum():
    """All segmentations of a word, listed one by one."""
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab", "bb"]
    import numpy as np

    p = np.array([[0.1, 0.2], [0.05, 0.1], [0.2, 0.1], [0.1, 0.3], [0.25, 0.1], [0.2, 0.1], [0.1, 0.1]])
    model = {"langs": ["x", "y"], "ids": {s: i for i, s in enumerate(pieces)}, "p": p, "longest": 3}

    def total(s, k):
        return 1.0 if not s else sum(p[i][k] * total(s[len(x) :], k) for i, x in enumerate(pieces) if s.startswith(x))

    words = ["ab", "abb", "a", "abab"]
    got = np.exp(language_id.word_scores(words, model))
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([total("▁" + w, 0), total("▁" + w, 1)])


# Toxicity


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = op8_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    tp = sum(r["predicted"] == r["toxic"] == 1 for r in out)
    assert tp >= 0.7 * sum(r["toxic"] for r in out)
    assert tp >= 0.75 * sum(r["predicted"] for r in out)


def test_toxicity_awkward_rows(spark, docs, empty):
    both = docs.withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(*toxicity.sample(docs, labels))
    got = toxicity.toxicity(both, model)
    assert got.count() == docs.count()
    assert got.filter("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
    nothing = toxicity.toxicity(both, toxicity.fit(*toxicity.sample(docs, labels.limit(0))))
    assert nothing.filter("score <> 0 OR predicted <> 0").count() == 0
    assert toxicity.toxicity(empty.withColumn("held_out", F.lit(False)), model).count() == 0


# Passages


def brute_passages(rows, least=50):
    where = defaultdict(set)
    words = [(d, brute.ascii_lower(t).encode().split()) for d, t in rows]
    for k, (_, w) in enumerate(words):
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(k)
    for _, (d, w) in enumerate(words):
        spans = []
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        if spans:
            yield d, len(w), tuple(map(tuple, spans))


def passages(df):
    return [(r["doc_id"], r["n_words"], tuple((p["start"], p["end"]) for p in r["passages"])) for r in df.collect()]


def test_passages(docs, empty):
    same(passages(suffix_dedup(docs)), brute_passages([r[:2] for r in cases.documents()]))
    assert suffix_dedup(empty).count() == 0


def test_passages_of_every_length_and_place(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        w = [f"w{rnd.randrange(9)}" if i % 3 else f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40, 200))]
        rows.append((i, " ".join(w)))
    for i in range(60, 120):
        src = rows[rnd.randrange(60)][1].split()
        a, n = rnd.randrange(len(src)), rnd.randrange(40, 70)
        fill = [f"y{rnd.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(fill[:15] + src[a : a + n] + fill[15:])))
    same(passages(suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))), brute_passages(rows))


def test_passages_on_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    same(passages(suffix_dedup(docs)), brute_passages([tuple(r) for r in docs.collect()]))


def test_index_is_written_once_per_capture(spark):
    import uuid

    from skuloom.llm.common import shared_dir

    rows = page_rows()
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    __import__("os").makedirs(folder)
    runs = write_archives(spark.createDataFrame(rows, PAGES), folder)
    assert merged_index(runs, folder, per_range=4).count() == len(rows)
