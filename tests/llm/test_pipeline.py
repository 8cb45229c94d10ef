"""Every stage of the pipeline against plain Python on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from skuloom.llm.common import stored
from tests.llm import brute, cases

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source").collect()))


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("awkward", [False, True])
def test_stages(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if awkward:
        docs = stored(spark.createDataFrame(cases.documents(), cases.SCHEMA), "awkward")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    names = list(STAGES)

    kept = stored(STAGES[names[0]](spark, docs, SF), "one")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert not rows(kept) - rows(docs)
    assert not any(brute.op5_base(*r)[-1] for r in texts(kept))

    alone = stored(STAGES[names[1]](spark, kept, SF), "two")
    assert not rows(alone) - rows(kept)
    numbered = list(enumerate(t for _, t in texts(kept)))
    groups = defaultdict(list)
    for (i, t), (_, _, c) in zip(numbered, brute.op4(numbered), strict=True):
        groups[c].append(t)
    left = Counter(t for _, t in texts(alone))
    assert sum(left.values()) == len(groups)
    for members in groups.values():
        assert any(left[t] for t in members)
    again = list(enumerate(t for _, t in texts(alone)))
    assert all(i == c for i, _, c in brute.op4(again))

    clean = stored(STAGES[names[2]](spark, alone, SF), "three")
    numbered = list(enumerate(t for _, t in texts(alone)))
    hit = {r[0] for r in brute.op1(numbered, [tuple(i) for i in items]) if r[-1]}
    assert Counter(t for _, t in texts(clean)) == Counter(t for i, t in numbered if i not in hit)

    masked = stored(STAGES[names[3]](spark, clean, SF), "four")
    assert masked.columns == corpus_pipeline.COLUMNS and masked.count() == clean.count()
    assert all(brute.op9_base(t)[:3] == (0, 0, 0) for _, t in texts(masked))

    mixed = STAGES[names[4]](spark, masked, SF).collect()
    per = defaultdict(int)
    for r in masked.collect():
        per[r["source"]] += len(brute.SPACE_WORD.findall(r["text"] or ""))
    assert len(mixed) == masked.count()
    assert sum(r["taken"] for r in mixed) == pytest.approx(sum(brute.op3_targets(per).values()), abs=len(per) + 1)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert out.count() > 0


def test_empty(spark):
    docs = spark.createDataFrame([], cases.SCHEMA)
    for stage in STAGES.values():
        assert stage(spark, docs, SF).count() == 0


def test_filter_is_the_verdict(spark):
    """The filter of the first stage keeps the rows that the operator's verdict keeps, extra columns included."""
    from skuloom.llm.quality_rules import quality_filter, quality_rules

    docs = stored(spark.createDataFrame(cases.documents(3, 400), cases.SCHEMA), "awkward")
    kept = quality_filter(docs, min_group=20)
    assert kept.columns == docs.columns
    want = Counter(r["doc_id"] for r in quality_rules(docs, min_group=20).filter("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_equal_rows_keep_their_verdict(spark):
    """Copies of a contaminated text all go, copies of a secret are all masked, and counts of clean copies stay."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    secret = "password = hunter22hunter22"
    texts_in = [bench] * 3 + [secret] * 4 + ["clean words only"] * 2 + [None, None, ""]
    docs = stored(spark.createDataFrame([(i // 2, t, "en", "s", 1) for i, t in enumerate(texts_in)], "doc_id bigint, text string, lang string, source string, n_chars bigint"), "copies")
    clean = Counter(t for _, t in texts(STAGES["benchmark decontamination"](spark, docs, SF)))
    assert clean == Counter(texts_in[3:])
    masked = STAGES["secret scans"](spark, docs, SF).collect()
    assert Counter(r["text"] for r in masked) == Counter([bench] * 3 + ["[secret]"] * 4 + texts_in[7:])
    assert all(r["n_chars"] == 8 for r in masked if r["text"] == "[secret]")
