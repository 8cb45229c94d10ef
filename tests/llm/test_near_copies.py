"""A large group of near copies of one text: every copy links with the text, few copies with each other."""

import random

from skuloom.llm import ngram_join as nj
from tests.llm import brute


def group(seed, copies, others):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    base = [rnd.choice(vocab) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, copies + 1):
        w = list(base)
        for _ in range(rnd.randint(4, 14)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((k, " ".join(w)))
    return rows + [(copies + 1 + k, " ".join(rnd.choice(vocab) for _ in range(120))) for k in range(others)]


def test_near_copies_are_met_by_their_text(spark, monkeypatch):
    """The result is that of brute force, and the pairs of the last step do not grow with the square of the group."""
    made = []
    across = nj._across

    def counted(*args):
        out = across(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(nj, "_across", counted)
    rows = group(3, 400, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in nj.ngram_join(docs).collect())
    assert got == sorted(brute.op4(rows))
    assert made[0] < 10 * len(rows)
