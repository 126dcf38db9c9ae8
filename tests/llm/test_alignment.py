"""Cross-tokenizer alignment against byte ranges by brute force."""

import collections
import hashlib
import json

import pytest
import sentencepiece
from tokenizers import Tokenizer

from hyperweave.llm import alignment, queries
from hyperweave.llm.bpe import byte_symbols

A, B = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = {s: k for k, s in enumerate(byte_symbols())}
    with open(A, encoding="utf-8") as f:
        names = {i: n for n, i in json.load(f)["model"]["vocab"].items()}
    a_bytes = lambda i: names[i].encode() if i == 50256 else bytes(value[c] for c in names[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), b.encode, a_bytes, b_bytes


def brute(texts, sides):
    """Per text: n_a, n_b, the groups, and all overlapping pairs by comparing ranges."""
    encode_a, encode_b, a_bytes, b_bytes = sides
    out = []
    for text in texts:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            out.append((0, 0, "", []))
            continue
        spans = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], [0, 0]
        for cut in cuts:
            parts = [[], []]
            for side in (0, 1):
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= cut:
                    parts[side].append(str(spans[side][at[side]][2]))
                    at[side] += 1
            groups.append("|".join(map(",".join, parts)))
        links, k = [], 0
        for s, e, i in spans[0]:
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def brute_report(keys, texts, sides):
    rows = brute(texts, sides)
    n = collections.Counter(p for r in rows for p in set(r[3]))
    most = collections.Counter()
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return collections.Counter(
        (k, r[0], r[1], r[2].count(";") + 1 if r[2] else 0, len(r[3]), sum(n[p] == most[p[0]] for p in r[3]), sum(n[p] for p in r[3]), sha(r[2])) for k, r in zip(keys, rows)
    )


TEXTS = ["Hello, world! naïve café 12345 <|endoftext|> <s> </s> <unk>", "日本語のテキスト 🎉🎉 Ωμέγα", " leading", "trailing  \n\n\t", "​﻿odd \x00 bytes \x7f", "<0x0A> ▁ not a byte", "internationalization " * 40, "ﬁ ﬀ ½ Å é é"]


@pytest.mark.parametrize("most", [alignment.SLICE, 50])
def test_alignment(spark, odd, sides, most):
    own = spark.createDataFrame([(200 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "score", "n").unionByName(own, allowMissingColumns=True)
    held = docs.select("doc_id", "text").collect()
    got = alignment.report(docs, A, B, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == brute_report([r.doc_id for r in held], [r.text for r in held], sides)


def test_alignment_of_nothing(spark, none):
    assert alignment.report(none, A, B).count() == 0


def test_groups_and_pairs(spark, sides):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    with open(B, "rb") as f:
        size = alignment.Pieces(f.read()).size
    for k, (n_a, n_b, groups, links) in enumerate(brute(TEXTS, sides)):
        assert (got[k].n_a, got[k].n_b, got[k].groups) == (n_a, n_b, groups)
        assert dict(zip(got[k].pairs, got[k].times)) == collections.Counter(a * size + b for a, b in links)


def test_texts_that_a_side_changes_have_no_tokens(monkeypatch, sides):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        own = alignment.Aligner(f.read(), g.read())
    own.b.encode = lambda t: sides[1](t)[:-1]
    assert own.groups("some text here") == (0, 0, [])


@pytest.mark.parametrize("deep,remembered", [(2, 10), (3, 10**6), (24, 1)])
def test_long_groups_and_forgetting(monkeypatch, sides, deep, remembered):
    monkeypatch.setattr(alignment, "DEEP", deep)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        own = alignment.Aligner(f.read(), g.read())
    texts = [*TEXTS, "x" * 5000, " " * 999, "0" * 3000, "é" * 2000, ""]
    for _ in range(2):
        got = own.rows(texts, False)
        want = brute(texts, sides)
        assert list(got[4]) == [w[2] for w in want] and list(got[3]) == [len(w[3]) for w in want]


def test_the_faster_library_agrees(sides):
    """Every letter, sign and space of the lower planes in several places."""
    with open(A, encoding="utf-8") as f:
        own = alignment.ByteLevel(f.read())
    assert "tiktoken" in type(own.encode.__self__).__module__
    points = [c for c in [*range(0x3100), *range(0xF900, 0x10000), *range(0x1F000, 0x1FB00)] if not 0xD800 <= c < 0xE000]
    for c in points:
        text = f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} .{chr(c)}  {chr(c)}\n{chr(c)}'s"
        assert own.encode(" " + text) == sides[0](text), hex(c)
