"""Cross-tokenizer alignment against a plain version that joins overlapping tokens one by one."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skuloom.llm import token_alignment
from skuloom.llm.queries import VOCABULARIES, op13_cross_tokenizer_alignment
from tests.llm import cases

PATHS = f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model"


def plain_tokens(text):
    """Ids and bytes of A and B, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "known"):
        a = Tokenizer.from_file(PATHS[0])
        a.encode_special_tokens = True
        plain_tokens.known = a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a, b = plain_tokens.known
    # A's byte letters, from the definition: printable ones stand for themselves, the others follow from 256 on.
    letters, extra = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + extra)] = byte
            extra += 1
    x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    raw = (" " + text).encode()
    same = b"".join(w for _, w in x) == raw == b"".join(w for _, w in y)
    return (x, y) if text and same else ([], [])


def plain_groups(x, y):
    """Tokens taken from both sides until the bytes taken are equally many."""
    groups, i, j = [], 0, 0
    while i < len(x):
        ga, gb, na, nb = [], [], 0, 0
        while not ga or na != nb:
            if na <= nb:
                ga.append(x[i][0])
                na += len(x[i][1])
                i += 1
            else:
                gb.append(y[j][0])
                nb += len(y[j][1])
                j += 1
        groups.append((ga, gb))
    return groups


def plain(rows):
    docs = [(d, *plain_tokens(t or "")) for d, t in rows]
    grouped = [(d, len(x), len(y), plain_groups(x, y)) for d, x, y in docs]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for *_, g in grouped]
    count = Counter(p for one in links for p in one)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    for (d, na, nb, g), one in zip(grouped, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        best = sum(k for (a, b), k in one.items() if count[a, b] == top[a])
        total = sum(k * count[p] for p, k in one.items())
        yield d, na, nb, len(g), sum(one.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if na else ""


AWKWARD = [
    "", " ", None, "a\0b", "▁x", "<s> </s> <unk> <0x41>", "<|endoftext|> hi", "  two  spaces\n\n", "é ﬁ ½", "​﻿ x",
    "日本語\U0001d11e", "\t\r\n", "\x1c\x85", "same words", "same words", "กำลัง" * 40, "\U0001f600\U0001f468‍\U0001f469" * 300,
    "x" * 5000, "ab " * 3000, "word and▁mark",
]
KEY = lambda r: tuple((x is not None, x) for x in r)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def compare(docs, rows, **how):
    got = token_alignment.align(docs, *PATHS, **how)[0].select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(plain(rows), key=KEY)


@pytest.mark.parametrize("per_block", [4_000_000, 500])
def test_awkward_texts(spark, per_block):
    rows = [(r[0], r[1]) for r in cases.documents()] + [(5000 + k, t) for k, t in enumerate(AWKWARD)]
    extra = [(*r, "pairs", 1) for r in rows]
    docs = spark.createDataFrame(extra, "doc_id bigint, text string, pairs string, block int").repartition(3)
    compare(docs, rows, per_block=per_block)


def test_small_pieces_and_packs(spark, monkeypatch):
    """The pieces of a text, the packs of tokens and large groups change nothing."""
    rows = [(k, r[1]) for k, r in enumerate(cases.documents(3, 60))] + [(100 + k, t) for k, t in enumerate(AWKWARD)]
    a, b = token_alignment.sides(*PATHS)
    want = list(plain(rows))
    for piece, pack, large in ((64, 50, 4), (1000, 1 << 18, 1), (1 << 16, 10, 1 << 12)):
        monkeypatch.setattr(token_alignment, "PIECE", piece)
        monkeypatch.setattr(token_alignment, "PACK", pack)
        monkeypatch.setattr(token_alignment, "LARGE", large)
        block = token_alignment.Block(a, b, token_alignment._schema("bigint", token_alignment.DIGEST))
        for (d, _), pieces in zip(rows, token_alignment.encoded([t for _, t in rows], a, b), strict=True):
            block.add(d, pieces)
        row = block.row(0)
        digests = pa.ipc.open_stream(row[1]).read_all().to_pylist()
        assert [tuple(d.values())[:6] for d in digests] == [(w[0], *w[1:5], w[7]) for w in want]
        # Of one block alone the holders are the counts.
        index, times = np.frombuffer(row[4], np.uint32), np.frombuffer(row[5], np.uint32)
        assert int((row[3][index].astype(int) * times).sum()) == sum(w[6] for w in want)


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS)[0].collect() == []


def test_sample(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_cross_tokenizer_alignment(spark, folder).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(plain(rows), key=KEY)
