"""Token windows against a tokenizer by hand."""

import os

import pytest

from hyperweave.functions import tokens

FOLDER = os.environ.get("HYPERWEAVE_TOKENIZERS", "/opt/tokenizers")
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"]
TEXTS = ["Some words, naïve café 12345 " * 40, "日本語のテキスト🎉 " * 30, "", None, "x", " \n lead and trail \n", "<|endoftext|> is text", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "kept") for k, t in enumerate(TEXTS)], "id int, text string, other string")


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("size,overlap", [(768, 64), (7, 3), (1, 0)])
def test_token_windows(docs, name, size, overlap):
    path = f"{FOLDER}/{name}"
    with open(path, "rb") as f:
        v = tokens.Vocabulary(name, f.read())
    want = []
    for k, t in enumerate(TEXTS):
        ids = v.encode(t) if t else []
        for n, a in enumerate(range(0, len(ids), size - overlap)):
            want.append((k, n, len(ids[a : a + size]), v.decode(ids[a : a + size]).strip(), "kept"))
    got = tokens.token_windows(docs, path, size, overlap).collect()
    assert sorted((r.id, r.chunk_order_index, r.tokens, r.text, r.other) for r in got) == sorted(want)
    for r in got:
        text = TEXTS[r.id]
        assert 0 <= r.start <= r.end <= len(text)
        if "�" not in r.text:  # no character is cut
            assert text[r.start : r.end].strip() == r.text
    last = {}
    for r in got:
        last[r.id] = max(last.get(r.id, 0), r.end)
    assert all(n == len(TEXTS[k].rstrip()) or n == len(TEXTS[k]) for k, n in last.items())


def test_counts_and_limits(spark, docs):
    path = f"{FOLDER}/byte_bpe_50k.tiktoken"
    got = {r.id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}
    assert got[2] == got[3] == 0 and got[4] == 1 and got[7] == 3001
    assert sorted(r.id for r in tokens.within_tokens(docs, path, 1).collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        tokens.token_windows(docs, path, 5, 5)
    assert tokens.token_windows(docs.limit(0), path).count() == 0


def test_rank_file_and_json_agree(docs):
    a, b = ({(r.id, r.n_tokens) for r in tokens.count_tokens(docs, f"{FOLDER}/{n}").collect()} for n in FILES[:2])
    assert a == b
