"""Every operator against brute force on odd tables, and its empty case."""

import collections
import hashlib
import json
import os
import random
import re
import struct
import textwrap
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperweave.llm import bpe, decontamination, grouping, licenses, parity, permutation, pii, quality, queries, repeats, shingles, tokenfiles, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}
WORDS_FILE, RANKS = f"{queries.TOKENIZERS}/word_bpe_49k.json", f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


# 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_permutation_index(spark, odd):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    data += [(1000 + i, data[0][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (None, [1.0] * 8), (2004, []), (2005, [float("inf")] * 8)]
    got = collections.defaultdict(list)
    for r in permutation.search(vectors(spark, data), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    use = [(i, np.array(v, float)) for i, v in data if i is not None and i < 2000]
    ids, m = np.array([i for i, _ in use]), np.stack([v for _, v in use])
    size, hit, total = np.sqrt((m * m).sum(1)), 0, 0
    for i, v in use:
        if i % 50 == 0:
            score = (m * v).sum(1) / (size * np.sqrt((v * v).sum()))
            want = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != i][:5]
            hit, total = hit + len({x for x, _ in got[i]} & set(want)), total + 5
            for x, s in got[i]:
                assert abs(s - score[list(ids).index(x)]) < 1e-12
    assert hit / total >= 0.9
    assert [x for x, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]  # ties to the smaller id
    few = permutation.search(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]), F.col("id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert permutation.search(vectors(spark, []), F.col("id") == 0).count() == 0
    assert permutation.search(vectors(spark, [(3, [1.0])]), F.col("id") == 0).count() == 0


def near_by_force(ids, m, i, k=5):
    unit = permutation.scaled(m)
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    score = unit @ unit[list(ids).index(i)]
    return [int(ids[x]) for x in np.lexsort((ids, -score)) if ids[x] != i][:k]


def test_vectors_of_several_lengths(spark, odd):
    rng = np.random.default_rng(3)
    wide, narrow = rng.normal(size=(60, 8)), rng.normal(size=(40, 3))
    data = [(k, v.tolist()) for k, v in enumerate(wide)] + [(100 + k, v.tolist()) for k, v in enumerate(narrow)] + [(300, [1.0])]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for r in permutation.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = {i: near_by_force(np.arange(60), wide, i) for i in (0, 50)} | {100: near_by_force(np.arange(100, 140), narrow, 100)}
    assert got == want  # 300 has no other vector of its length


def test_vectors_near_the_ends_of_doubles(spark, odd):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 6)) * np.array([1e200, 1e-200, 1e300])[np.arange(30) % 3, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
    rows = permutation.search(df, F.col("id") % 10 == 0).orderBy("query_id", "rank").collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.query_id].append(r.vec_id)
        x, y = m[r.query_id] / np.abs(m[r.query_id]).max(), m[r.vec_id] / np.abs(m[r.vec_id]).max()
        assert abs(r.score - x @ y / np.sqrt((x @ x) * (y @ y))) < 1e-12
    assert got == {i: near_by_force(np.arange(30), m, i) for i in (0, 10, 20)}


def test_recall_of_whole_blocks():
    """Blocks of production size, where a tenth is reranked: spread-out and clustered vectors."""
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(permutation.BLOCK, 64))
    centres = rng.normal(size=(40, 64))
    for m in (spread, centres[rng.integers(0, 40, permutation.BLOCK)] + 0.3 * rng.normal(size=spread.shape)):
        m = m / np.sqrt((m * m).sum(1, keepdims=True))
        index = permutation.PivotOrders(permutation.unlike(m[: permutation.SAMPLED], permutation.PIVOTS), permutation.LISTED)
        orders = index.of(m)
        block, hit, looked = permutation.Block(orders, len(index.pivots)), 0, []
        for j in range(0, len(m), 100):
            at = block.nearest(orders[j], len(m) // permutation.PART)
            looked.append(len(at))
            score = m @ m[j]
            score[j] = -2
            hit += len(set(at) & set(np.argsort(-score)[:5]))
        assert hit / (5 * len(looked)) >= 0.9
        assert m is not spread or np.median(looked) <= 1.3 * len(m) / permutation.PART


def test_footrule_of_whole_lists():
    rng = np.random.default_rng(6)
    orders = np.stack([rng.permutation(20)[:8] for _ in range(50)]).astype(np.int32)
    block = permutation.Block(orders, 20)
    for q in orders[:5]:
        want = [sum(8 - abs(i - list(q).index(p)) for i, p in enumerate(o) if p in q) for o in orders]
        assert block.agreement(q, 8, 8).tolist() == want


# 2


def test_token_counts(spark, odd, none):
    with open(RANKS, "rb") as f:
        encoding = tokenfiles.encoder(f.read())
    want = bag((i, len(encoding.encode_ordinary(t or ""))) for i, t in rows_of(odd))
    assert bag(tokenfiles.count_tokens(odd, RANKS, block=700).collect()) == want  # documents cross many blocks
    assert tokenfiles.count_tokens(none, RANKS).count() == 0


def test_flat_file_without_last_separator(spark, odd, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, 9, 9, 7, 7, 7, 9, 4, 4], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/a.bin",), (f"file://{tmp_path}/b.bin",)], "file string")
    for block in (1, 2, 4, 100):
        got = tokenfiles.scan_token_files(spark, files, eod=9, block=block).orderBy("ordinal").collect()
        assert [(r.ordinal, r.first, r.n_tokens) for r in got] == [(0, 0, 1), (1, 2, 0), (2, 3, 3), (3, 7, 2)]


# 3


def test_warc_round_trip(spark, odd, tmp_path):
    big = "p" * 300
    rows = [(1, None), (2, ""), (3, big), (4, big), (5, big), (6, "é" * 60), (7, "é" * 60), (8, "short"), (9, "short"), (None, big), (None, "x"), (10, "long" * 100_000)]
    pages = spark.createDataFrame([(i, "http://a/ü\n", h, "clash") for i, h in rows], "page_id long, url string, html string, archive string")
    for zip64 in (False, True):
        written = warc.write_archives(pages, "page_id", "html", "url", zip64=zip64)
        path = written.first().archive[len("file://") :]
        assert all(m.compress_type == 0 for m in zipfile.ZipFile(path).infolist()) and zipfile.ZipFile(path).testzip() is None
        got = warc.read_archives(spark, written, with_payload=True).collect()
        want = bag((i, len((h or "").encode()), sha(h or ""), "revisit" if i in (4, 5, 7) else "response", {4: 3, 5: 3, 7: 6}.get(i)) for i, h in rows)
        assert bag((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert all(bytes(r.payload) == (dict(rows).get(r.key) or "").encode() for r in got if r.key and r.record_type == "response")
        assert {r.target for r in got} == {"http://a/ü\n"}
    empty = warc.write_archives(pages.limit(0), "page_id", "html", "url")
    assert empty.count() == 0 and warc.read_archives(spark, empty).count() == 0


def test_archives_of_others(spark, odd, tmp_path):
    import base64
    import gzip

    def made(kind, ident, payload, http=True, digest="sha1", more=()):
        block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if http else b"") + payload
        name = {"sha1": lambda: "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(), "sha256": lambda: "sha256:" + sha(payload), None: lambda: "md5:0"}[digest]()
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Target-URI: http://x/{ident}", f"WARC-Payload-Digest: {name}", f"Content-Type: {'application/http; msgtype=response' if http else 'text/html'}", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    a = [made("warcinfo", "i", b"software: x", http=False, digest=None), made("response", "a1", b"one" * 50), made("request", "q", b"GET", digest=None), made("revisit", "a2", b"", more=["WARC-Refers-To: <urn:uuid:a1>"])]
    b = [made("response", "b1", "zwei é".encode(), digest="sha256"), made("response", "b2", b"\0bin\r\n\r\nary", http=False)]
    c = [made("response", "c1", b"plain", digest=None), made("response", "c2", b"")]
    packed = [[gzip.compress(r) for r in x] for x in (a, b)]
    index = ["!meta 0 {}", "not json {"] + [f"com,x)/ 2024 " + json.dumps({"url": "http://x", "filename": "a.warc.gz", "offset": str(sum(map(len, packed[0][:k]))), "length": len(packed[0][k]), "status": "200"}) for k in (3, 1)]
    with zipfile.ZipFile(tmp_path / "others.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(packed[0]))
        z.writestr("archive/b.warc.gz", b"".join(packed[1]))
        z.writestr("archive/c.warc", b"".join(c))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(index).encode()))
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
    given = spark.createDataFrame([(f"file://{tmp_path}/others.wacz",)], "archive string")
    got = {r.key: r for r in warc.read_archives(spark, given, "string", with_payload=True).collect()}
    want = {"a1": b"one" * 50, "b1": "zwei é".encode(), "b2": b"\0bin\r\n\r\nary", "c1": b"plain", "c2": b""}
    assert {k: bytes(r.payload) for k, r in got.items() if r.record_type == "response"} == {f"urn:uuid:{k}": v for k, v in want.items()}
    assert all(r.payload_digest == sha(bytes(r.payload)) and r.payload_bytes == len(r.payload) for r in got.values() if r.record_type == "response")
    r = got["urn:uuid:a2"]
    assert (r.record_type, r.refers_to, r.payload_bytes, r.payload) == ("revisit", "urn:uuid:a1", None, None) and got["urn:uuid:b1"].target == "http://x/b1"
    assert {r.key for r in warc.read_archives(spark, given).collect()} == {None}
    with zipfile.ZipFile(tmp_path / "deflated.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"x" * 1000)
    with pytest.raises(Exception, match="not stored"):
        warc.read_archives(spark, spark.createDataFrame([(f"file://{tmp_path}/deflated.wacz",)], "archive string")).count()


def test_archives_roll_over(spark, odd):
    rows = [(k, random.Random(k).randbytes(300).hex()) for k in range(40)] + [(50, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    written = warc.write_archives(pages, "page_id", "html", roll=2000)
    assert written.count() > 5 and written.agg(F.sum("n_records")).first()[0] == 41
    assert {(r.key, r.payload_digest) for r in warc.read_archives(spark, written).collect()} == {(k, sha(t or "")) for k, t in rows}


def test_scans_cross_reads(monkeypatch):
    import gzip
    import io

    monkeypatch.setattr(warc, "RANGE", 7)
    records = [warc.record(k, "u", b"p" * k, sha(b"p" * k), None, k) for k in (0, 5, 100)]
    for packed in (True, False):
        data = b"".join(gzip.compress(r) if packed else r for r in records)
        got = list(warc.scan_records(io.BytesIO(b"junk" + data + b"after"), 4, len(data), packed))
        assert [len(block) for _, block in got] == [0, 5, 100]


def test_zip_directory_rejects_rubbish(tmp_path):
    import io

    with pytest.raises(ValueError):
        warc.read_directory(io.BytesIO(b"not a zip" * 10), 90)
    out = io.BytesIO()
    z = warc.StoredZip(out, zip64=True)
    z.begin("ä/b")
    z.write(b"hello")
    z.end()
    z.close()
    found = warc.read_directory(out, len(out.getvalue()))
    assert found["ä/b"]["size"] == 5 and out.getvalue()[found["ä/b"]["start"] :][:5] == b"hello"
    assert struct.unpack_from("<L", out.getvalue(), found["ä/b"]["start"] + 5 + 4)[0] == zlib.crc32(b"hello")


# 4


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        text = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40)))
        assert grouping.suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def brute_repeats(rows, n=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + n] for _, b in texts for k in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\x01" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone) if not y))))
    return bag(out)


def repeats_of(df, **more):
    return bag(repeats.remove_repeats(df, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def thue_morse(k):
    bits = [0]
    for _ in range(k):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_fingerprints_of_opposite_texts(spark, odd):
    a, b = thue_morse(10)  # equal under any polynomial hash modulo a power of two
    data = np.frombuffer((a + b).encode(), np.uint8)
    for which in (0, 1):
        x, y = repeats.Prints(data, which).of(np.array([0, 1024]), np.array([1024, 2048]))
        assert x != y
    u, v = a[:256], b[:256]
    rows = [(1, "q" * 180 + u + "r" * 150), (2, "s" * 160 + v + "t" * 170), (3, v[::-1] + u), (4, u + "w" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats_of(df) == brute_repeats(rows)


def test_ranges_keep_their_fingerprints():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 4, 3000).astype(np.uint8)
    data[2000:2500] = data[100:600]
    prints = repeats.Prints(data)
    assert (prints.of(np.arange(100, 300), np.arange(400, 600)) == prints.of(np.arange(2000, 2200), np.arange(2300, 2500))).all()
    assert len(np.unique(prints.of(np.arange(1000), np.arange(1000) + 40))) == 1000


def test_repeats(spark, odd, none):
    small = odd.where("doc_id IS NULL OR doc_id <> 4")
    assert repeats_of(small) == brute_repeats(rows_of(small))
    rng = random.Random(2)
    base = ["".join(rng.choice("abé ") for _ in range(400)) for _ in range(4)]
    rows = [(0, "ab" * 400), (1, base[0] * 2), (2, base[1]), (3, base[1][1:200]), (4, base[1][:199] + "q" + base[1][200:]), (4, base[1])]
    rows += [(k, rng.choice(base)[rng.randrange(300) :] + rng.choice(base)[: rng.randrange(400)]) for k in range(5, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats_of(df) == brute_repeats(rows)
    assert repeats.remove_repeats(none).count() == 0


def test_passages_that_one_task_meets_often(spark, odd):
    rng = random.Random(19)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passages = [text(500), text(230)]
    rows = []
    for k in range(90):
        p = passages[k % 2]
        if k % 5 == 0:
            p = p[: rng.randrange(210, len(p) + 1)]
        rows.append((k, rng.choice(["", text(rng.randrange(300))]) + p + rng.choice(["", text(rng.randrange(300))])))
    rows += [(200, passages[0][:250] + "#" + passages[0][250:]), (201, passages[1][5:])]
    want = brute_repeats(rows)
    for parts, crowd in ((1, 2000), (1, 3), (30, 2000), (30, 3)):
        assert repeats_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), crowd=crowd) == want


def test_crowded_anchor(spark, odd):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    rows = [(k, "".join(rng.choice("ghij") for _ in range(150)) + passage + "".join(rng.choice("klmn") for _ in range(150))) for k in range(40)]
    texts = [t.encode() for _, t in rows]
    data, bounds = repeats._laid(texts)
    _, owner, _, n, _ = repeats.anchors(data, bounds)
    assert list(np.bincount(owner, n)) == [len(t) - 199 for t in texts]  # every window has one anchor
    seen = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    assert [list(w) for w in repeats.repeated_windows(texts, 200)] == [[k for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1] for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (2, 2000):
        assert repeats_of(df, crowd=crowd) == brute_repeats(rows)


# 5

KINDS = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(x) if j % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for j, x in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end()))
    names = list(KINDS)
    return [sum(x[1] == k for x in found) for k in range(4)], sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)))


HARD = ["a@b.c_d@e.f x@y", "x@@y.z q@w.e.r.t. 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111-4111-1111-1111-1111", "+1 (301) 555-0346 +12 ++123456789 +1--2", "é😀a@b.co 😀 4111111111111111", "9" * 3000 + "a" * 3000 + "@", "a@b" + ".c" * 2000, "1.2.3.4a@5.6", "0000.1.1.1"]


def test_pii(spark, odd, none):
    df = odd.unionByName(spark.createDataFrame([(500 + k, t) for k, t in enumerate(HARD)], "doc_id long, text string"), allowMissingColumns=True)
    text = {(i, sha(t or "")): t for i, t in rows_of(df)}
    got = pii.report(pii.find(df.select("doc_id", "text"))).collect()
    want = bag((i, *brute_pii(t)[0], brute_pii(t)[1]) for i, t in rows_of(df))
    assert text and bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and clean.count() == df.count() and clean.select("base", "spans").distinct().count() <= 2
    assert {r.text for r in clean.where("doc_id = 8").collect()} == {"mail [EMAIL] or [PHONE]"}
    assert pii.report(pii.find(none.select("doc_id", "text"))).count() == 0 and pii.sanitise(none).count() == 0


def test_disclosing_terms(spark, odd):
    rows = [(k, f"line {k} mail joe@x.org about zanzibar today number {k}\nplain line of words {k}") for k in range(4)] + [(10 + k, f"other text of the day {k} about nothing") for k in range(60)]
    rows += [(100 + k, "a copy mail ann@x.org about quokka") for k in range(5)]  # copies are one context
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.entity: r.terms for r in pii.disclosing_terms(df).collect()}
    assert "zanzibar" in terms["0:joe@x.org"] and "about" not in terms["0:joe@x.org"] and "0:ann@x.org" not in terms
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zanzibar" not in out[0] and "[TERM]" in out[0] and "[EMAIL]" in out[0] and out[10] == rows[4][1] and "quokka" in out[100]


def test_spans_of_very_long_texts(spark, odd):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdé😀") for _ in range(5)) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(60_000)) + " Zanzibar joe@x.org " + " ".join(f"u{k}@x.org" for k in range(6000))
    rows = [(1, long)] + [(k, f"mail joe@x.org of zanzibar {k}") for k in range(2, 8)] + [(100 + k, f"other text {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.report(pii.find(df)).where("doc_id = 1").first()
    at = long.index("Zanzibar")
    assert (got.n_email, got.base_sha256) == (6001, brute_pii(long)[1]) and f"term:{at}:{at + 8}," in got.spans
    out = pii.sanitise(df).where("doc_id = 1").first().text
    assert out == long[:at] + "[TERM] [EMAIL]" + " [EMAIL]" * 6000


def test_overlapping_spans_become_one(spark, odd):
    text = "é 1.2.3.4a@5.6 b +1 301 555 0346 1 x@y.z@w"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    spans = [tuple(map(int, x.split(":")[1:])) for x in pii.report(pii.find(df)).where("doc_id = 1").first().spans.split(",")]
    kinds = [x.split(":")[0] for x in pii.report(pii.find(df)).where("doc_id = 1").first().spans.split(",")]
    want, at = "", 0
    for (a, b), kind in zip(spans, kinds):
        if a >= at:
            want += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()} == {1: want + text[at:], 2: "", 3: None}


def test_contexts_are_bounded(spark, odd):
    words = [f"w{k:04d}" for k in range(900)]
    line = " ".join(words)
    parts = re.findall(pii.STRETCH, "one\n\n" + line + "\ntwo")
    assert parts[0] == "one" and parts[-1] == "two" and "".join(parts[1:-1]) == line and all(len(x) <= 1300 for x in parts)
    assert all(not x.startswith(("w0", "w1")) or x[:5] in words for x in parts)


def test_disclosing_terms_of_all_scripts(spark, odd):
    forms = [("Éva", "Ñíll", "ΟΔΟΣ"), ("éva", "ÑÍLL", "οδος"), ("ÉVA", "ñíll", "Οδος"), ("Éva", "Ñíll", "ΟΔΟΣ")]
    rows = [(k, f"row {k} by {a}, {b} {c}. mail joe@x.org") for k, (a, b, c) in enumerate(forms)]
    df = spark.createDataFrame(rows + [(10 + k, f"other text {k} by nobody in a row") for k in range(60)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.report(pii.find(df)).collect()}
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for (i, t), words in zip(rows, forms):
        assert all(f"term:{t.index(w)}:{t.index(w) + len(w)}" in found[i] and w not in out[i] for w in words)


# 6


def brute_licenses(rows, threshold=licenses.THRESHOLD):
    sets = [(label, WORD.findall(body.translate(LOWER))) for label, body in licenses.TEMPLATES]
    classes = licenses.size_classes([len(s) for _, s in sets])
    out = collections.defaultdict(set)
    for i, t in rows:
        blocks = [(set(WORD.findall(line.translate(LOWER))), None) for line in (t or "").split("\n")]
        words = WORD.findall((t or "").translate(LOWER))
        for low, high in classes:
            span = licenses.SLACK * high
            blocks += [(set(words[k : k + 2 * span]), (low, high)) for k in range(0, max(len(words) - span, 0) + 1, span)]
        for held, of in blocks:
            for label, s in sets:
                if (of is None or of[0] <= len(s) <= of[1]) and len(held & set(s)) * 1e6 >= round(threshold * len(set(s)) * 1e6):
                    out[i].add(label)
    return out


def test_licenses(spark, odd, none):
    extra = [(200, "Licensed under CC BY-NC 4.0."), (201, "x\nReleased UNDER the MIT License; mit license"), (202, "GENERAL PUBLIC LICENSE general-public license"), (203, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without limits"), (204, "license by nc under 4.0")]
    df = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    found, got = brute_licenses(rows_of(df)), []
    for r in licenses.scan(df).collect():
        got.append((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert set(filter(None, r.labels.split(","))) == set(filter(None, r.base_labels.split(","))) | found[r.doc_id], r
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    want = []
    for i, t in rows_of(df):
        w, places = WORD.findall((t or "").translate(LOWER)), []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places.sort()
        want.append((i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))))
    assert bag(got) == bag(want) and licenses.scan(none).count() == 0


def test_reservation_of_rights(spark, odd):
    rows = [(1, "Copyright Example.\nAll rights reserved.\nText"), (2, "No part of this may be reproduced without written permission"), (3, "All rights"), (4, "All parts reserved")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("proprietary", 1.0), 2: ("proprietary", 1.0), 3: ("", 0.0), 4: ("", 0.0)}


def test_wrapped_notices(spark, odd):
    text = lambda label, k=0: [b for x, b in licenses.TEMPLATES if x == label][k]
    wrapped = lambda t, n, mark="": "\n".join(mark + x for x in textwrap.wrap(t, n))
    mit = text("mit", 1).replace("files,", 'files (the "Software"),')
    rows = [(1, "Prose.\n\n" + wrapped(mit, 76, " * ") + "\n\nProse."), (2, wrapped(text("bsd"), 40, "# ")), (3, "word\n" * 500 + text("mpl").replace(" ", "\r\n")), (4, wrapped("About this: " + text("cc0"), 72))]
    rows += [(5, wrapped(text("bsd"), 90).replace("\n", "\n \n")), (6, "Redistribution and use in source and binary forms, with or without modification,\n" + "word " * 400 + "\nare permitted provided that the following conditions are met"), (7, None)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd", 3: "mpl", 4: "cc0", 5: "bsd", 6: "", 7: ""}


def test_whole_license_texts(spark, odd, tmp_path, monkeypatch):
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = {f"L-{k}.0": " ".join(rng.sample(words, 120)) for k in range(5)}
    for name, body in texts.items():
        (tmp_path / f"{name}.txt").write_text(textwrap.fill(body, 70))
    templates = licenses.read_templates(spark, str(tmp_path))
    assert [label for label, _ in templates] == sorted(texts)
    rows = [(k, "intro\n\n" + textwrap.fill(body, 60, initial_indent="// ", subsequent_indent="// ") + "\n\nend") for k, body in enumerate(texts.values())] + [(9, " ".join(rng.sample(words, 90))), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (20_000, 150):  # all at once, and one after the other
        monkeypatch.setattr(licenses, "MOST_WORDS", most)
        assert len(licenses._template_sets(df, templates)) == (1 if most > 400 else 5)
        got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df, templates=templates).collect()}
        assert got == {k: (name, 1.0) for k, name in enumerate(texts)} | {9: ("", 0.0), 10: ("", 0.0)}


#: A license of several paragraphs with a title, a copyright line and a list.
WHOLE = """Sample Public License

Copyright (c) 2024 The Authors

Permission is granted to anyone who receives a copy of this program and its manuals to run, study, share and change it
for any purpose, as long as each of the following terms is met:

  1. The notice above and this list stay in all copies, whether in source or compiled form.
  2. Changed versions are marked as such and are not presented as the original work.

THE PROGRAM COMES "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT ARE THE AUTHORS LIABLE FOR ANY DAMAGE THAT ARISES
FROM ITS USE, EVEN IF THEY WERE TOLD THAT IT MIGHT.
"""


@pytest.mark.parametrize("most", [20_000, 40])
def test_license_files_of_several_paragraphs(spark, odd, monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_WORDS", most)
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(WORD.findall(WHOLE.lower())[:25] + ["other", "words"]) for _ in range(n))
    commented = "\n".join("// " + line for line in WHOLE.split("\n"))
    half = WHOLE[: len(WHOLE) // 2]
    rows = [(1, WHOLE), (2, prose(900) + "\n\n" + commented + "\n\n" + prose(900)), (3, "<p>" + WHOLE.replace("\n\n", "</p>\r\n\r\n<p>") + "</p>"), (4, half), (5, half + "word " * 2000 + WHOLE[len(WHOLE) // 2 :]), (6, WHOLE.replace("\n", " ")), (7, prose(3000)), (8, ""), (9, None)]
    templates = [("sample", WHOLE), ("mit", "Released under the MIT License")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    found = ("sample", 1.0)
    assert got == {1: found, 2: found, 3: found, 4: ("", 0.0), 5: ("", 0.0), 6: found, 7: ("", 0.0), 8: ("", 0.0), 9: ("", 0.0)}


def test_templates_are_classed_by_length():
    assert licenses.size_classes([5, 3, 6, 7, 25, 15, 12]) == [(3, 6), (7, 12), (15, 25)] and licenses.size_classes([]) == []


# 7


def brute_windows(docs, items, n=10):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        if item is not None and w:
            for k in range(max(1, len(w) - n + 1)):
                windows[tuple(w[k : k + n])].add(item)
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return bag(out)


def test_decontamination(spark, odd, none):
    docs = odd.where("doc_id IS NULL OR doc_id NOT IN (4, 5)")
    texts = dict((i, t) for i, t in rows_of(docs) if i)
    items = [(1, texts[10]), (2, " ".join(texts[11].split()[3:9])), (10, texts[10].upper()), (3, None), (4, " . "), (None, texts[12]), (5, "TEXT"), (2, " ".join(texts[11].split()[3:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(rows_of(docs), items)
    for size in (4_000_000, 20, 7):  # one slice, several, and items in pieces
        found = decontamination.find_windows(docs, bench, slice_words=size)
        assert bag(decontamination.report(found, "doc_id").collect()) == want
    hit = {r.doc_id for r in decontamination.report(found, "doc_id").where("contaminated").collect()}
    kept = decontamination.decontaminate(docs, bench)
    again = decontamination.report(decontamination.find_windows(kept, spark.createDataFrame(items[:1], "item_id long, text string")), "doc_id")
    assert again.where("contaminated").count() == 0 and kept.columns == docs.columns
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench, remove="documents").collect()} == set(i for i, _ in rows_of(docs)) - hit
    assert bag(rows_of(decontamination.decontaminate(docs, bench.limit(0)))) == bag(rows_of(docs))
    assert decontamination.decontaminate(none, bench).count() == 0


def test_remove_runs():
    assert decontamination.remove_runs("a b c, d! é f".encode(), [[1, 3], [4, 5]]) == "a , d!  f"


# 8


def test_quality(spark, odd, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(4, 14))) + "." for _ in range(rng.randint(1, 6)))
    bad = lambda: "\n".join(" ".join(word() + rng.choice(["%%%", "$$$", " |"]) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(1, 6)))
    rows = [(k, good() if k % 4 else bad()) for k in range(800)] + [(900, None), (901, ""), (902, "word " * 30_000), (None, "no id.")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(k, int(bool(k % 4)), 0) for k in range(800)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, sample=400)
    got = quality.score(docs, model).select("doc_id", "score", quality.held_out(F.col("doc_id")).alias("h")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= quality.CUT) == bool(r.doc_id % 4) for r in got if r.h and r.doc_id < 800]
    assert all(bool(r.h) == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 100 and sum(held) / len(held) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert len({k for k in range(800) if k % 4} - kept) <= 6 and len({k for k in range(0, 800, 4)} & kept) <= 6
    alone = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, alone).collect()} == {1.0} and quality.score(none, model).count() == 0
    assert quality.score(odd, model, into="q").count() == odd.count()


def plain_features(text):
    """Every line's features, from its characters."""
    ends, plain = b".?!:;\"'", b".,;:?'\"()-"
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    mark = lambda b: 32 < b < 127 and not letter(b) and not digit(b)
    odd = lambda b: mark(b) and b not in plain
    rows, seen = [], []
    for line in text.split(b"\n"):
        words = [w for w in re.split(rb"[\x20\t-\r]+", bytes(b + 32 if 65 <= b <= 90 else b for b in line)) if w]
        n, letters, marks, digits, odds = max(len(words), 1), sum(map(letter, line)), sum(map(mark, line)), sum(map(digit, line)), sum(map(odd, line))
        all_seen = max(letters + marks + digits, 1)
        rows.append([
            np.log1p(len(words)), np.log1p(len(line)), sum(65 <= b <= 90 for b in line) / max(letters, 1), digits / all_seen, marks / all_seen, odds / all_seen,
            len(set(words)) / n if words else 1, sum(a == b for a, b in zip(words, words[1:])) / n, np.log1p(sum(map(len, words)) / n),
            sum(not any(letter(b) or digit(b) for b in w) for w in words) / n, sum(odd(w[-1]) for w in words) / n, float(bool(words) and words in seen),
            float(bool(line) and 65 <= line[0] <= 90), float(bool(line) and line[-1] in ends),
        ])
        seen.append(words)
    near = [[r[k] for k in quality.NEAR] for r in rows]
    zero = [0.0] * len(quality.NEAR)
    return np.array([r + (near[k - 1] if k else zero) + (near[k + 1] if k + 1 < len(rows) else zero) + [float(k == 0), float(k == len(rows) - 1), 1.0] for k, r in enumerate(rows)])


def plain_score(model, text):
    x = plain_features(text)
    emit = np.clip((x - model.mean) / model.scale @ model.weights, -30, 30)
    n, move = len(emit), model.step
    ahead, back = [[0.0, emit[0]]], [[0.0, 0.0]]
    for t in range(1, n):
        ahead.append([np.logaddexp(ahead[-1][0] + move[0, y], ahead[-1][1] + move[1, y]) + y * emit[t] for y in (0, 1)])
    for t in range(n - 1, 0, -1):
        back.insert(0, [np.logaddexp(move[y, 0] + back[0][0], move[y, 1] + emit[t] + back[0][1]) for y in (0, 1)])
    good = [1 / (1 + np.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, back)]
    weight = [max(len(line), 1) for line in text.split(b"\n")]
    mean = np.clip(np.dot(good, weight) / sum(weight), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log(mean / (1 - mean)))))


def test_quality_scores_of_plain_text(spark, odd):
    """Scores of the query's own operator against features, chain and weighting written out."""
    rng = random.Random(14)
    texts = [" ".join(rng.choice(["Alpha", "beta.", "x9", "%%%", "gamma", "gamma", "é!", "$$"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    docs = [(k, "\n".join(rng.sample(texts, rng.randint(1, 6)))) for k in range(120)] + [(500, None), (501, ""), (502, "\n\n"), (503, "same line\nSame  line\n\tother\x0bx\r")]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.where("doc_id is null or doc_id not in (4, 5)").select("doc_id", "text"))
    labels = spark.createDataFrame([(k, int("%%" not in (docs[k][1] or "")), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    assert model.constant is None
    for r in quality.score(df, model).collect():
        assert abs(r.score - plain_score(model, (r.text or "").encode())) < 1e-9


def test_fit_climbs_the_likelihood():
    rng = np.random.default_rng(15)
    n = np.array([3, 1, 4, 2])
    x, y = rng.normal(size=(10, 3)), rng.integers(0, 2, 10)
    model = quality.LineCrf()
    model.weights, model.step = rng.normal(size=3), rng.normal(size=(2, 2))

    def value(w, step):
        score, at, out = x @ w, 0, 0.0
        for m in n:
            ways = [[(z >> t) & 1 for t in range(m)] for z in range(1 << m)]
            weigh = lambda s, at=at: sum(score[at + t] * s[t] for t in range(len(s))) + sum(step[a, b] for a, b in zip(s, s[1:]))
            out += weigh(list(y[at : at + m])) - np.logaddexp.reduce([weigh(s) for s in ways])
            at += m
        return out / len(y)

    got = model._gradient(x, y, n, np.ones(10), 0.0)
    for k in range(3):
        d = np.eye(3)[k] * 1e-5
        assert abs((value(model.weights + d, model.step) - value(model.weights - d, model.step)) / 2e-5 - got[0][k]) < 1e-7
    for k in range(4):
        d = np.eye(4)[k].reshape(2, 2) * 1e-5
        assert abs((value(model.weights, model.step + d) - value(model.weights, model.step - d)) / 2e-5 - got[1].ravel()[k]) < 1e-7


def test_training_is_bounded_by_lines(spark, odd):
    rows = [(k, "good line.\n" * 5 if k % 2 else "%% $$\n" * 5) for k in range(40)] + [(100, "x\n" * 50_000)] + [(101, f"copy {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(100, 1), (101, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.LineCrf.fit
    quality.LineCrf.fit = lambda self, x, length, n, y, **more: seen.append((len(x), len(n))) or fit(self, x, length, n, y, **more)
    try:
        quality.train(docs, labels, lines=120)
    finally:
        quality.LineCrf.fit = fit
    assert 100 <= seen[0][0] <= 120 and seen[0][1] <= 42


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    n = np.array([3, 1, 4])
    score, step = rng.normal(size=8), rng.normal(size=(2, 2))
    good, moved, _ = quality.marginals(score, step, n)
    at = 0
    total = np.zeros((2, 2))
    for m in n:
        ways = list(itertools.product((0, 1), repeat=int(m)))
        weight = np.array([np.exp(sum(score[at + t] * y[t] for t in range(m)) + sum(step[a, b] for a, b in zip(y, y[1:]))) for y in ways])
        weight /= weight.sum()
        assert np.allclose(good[at : at + m], [sum(w for w, y in zip(weight, ways) if y[t]) for t in range(m)])
        for w, y in zip(weight, ways):
            for a, b in zip(y, y[1:]):
                total[a, b] += w
        at += m
    assert np.allclose(moved, total)


# 9

ODD_TEXTS = ["", " ", "Σας ΟΔΥΣΣΕΥΣ İstanbul ß", "a<|endoftext|>b <|startoftext|><|endoftext", "it's we'll 'd 'S x'T", "１２３ ①② ½", "é a\x1cb\x1f c d 　e\x85f\xa0g", "日本語テスト 😀😀👩‍👩‍👧", "\x00\x01 ﻿", "ab" * 900, "!!!???###" * 200, "́abc ́", "Ω Å ẛ̣ K ﬁ", "नमस्ते ก่า"]


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(WORDS_FILE)
    with open(WORDS_FILE) as f:
        mine = bpe.Bpe(json.load(f))
    df = odd.unionByName(spark.createDataFrame([(500 + k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    expected = []
    for i, t in rows_of(df):
        ids = want.encode(t or "", add_special_tokens=False).ids
        assert mine.ids(t or "") == ids and mine.decode(ids) == want.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(want.decode(ids, skip_special_tokens=False))))
    assert bag(bpe.digest(df, WORDS_FILE).collect()) == bag(expected)
    full = bpe.encode(df.select("doc_id", "text", "n"), WORDS_FILE).where("doc_id = 6").first()
    assert full.ids == mine.ids("short text") and full.decoded == mine.decode(full.ids)
    assert bpe.digest(none, WORDS_FILE).count() == 0


def test_long_pieces_merge_alike(monkeypatch):
    with open(WORDS_FILE) as f:
        mine = bpe.Bpe(json.load(f))
    rng = random.Random(6)
    for _ in range(200):
        parts = [rng.choice("theinraous") for _ in range(rng.randint(2, 60))]
        assert mine.merge(parts) == mine._merge_long(parts)


# 10


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate(LOWER)) if x]
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = {i: i for i in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, many in sets.items() if i is not None for s in many if s]
    for a, (i, x) in enumerate(flat):
        for j, y in flat[:a]:
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both) and top(i) != top(j):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return bag((i, len(s) if i is not None else None, top(i) if i is not None else None) for i, many in sets.items() for s in many)


def test_jaccard_join(spark, odd, none):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 6, 9, 30, 80, 200]))]
        for k in range(rng.choice([1, 2, 12])):
            new = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40 + 1))):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(new)))
    df = odd.where("doc_id IS NULL OR doc_id <> 4").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    assert bag(parity.near_duplicates(df).collect()) == brute_components(rows_of(df))
    left = bag(rows_of(parity.deduplicate(df)))
    want = {i for i, _, c in brute_components(rows_of(df)) if i == c}
    assert {i for i, _ in left} == want and parity.deduplicate(df).columns == df.columns
    assert parity.near_duplicates(none).count() == 0 and parity.deduplicate(none).count() == 0


def test_hot_states_in_slices(spark, odd):
    """Documents that share passages but do not all link, under ids that are far apart, with and without pre-aggregation."""
    rng = random.Random(18)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    shared = [[rng.choice(words) for _ in range(60)] for _ in range(3)]
    rows = []
    for k in range(120):
        base = list(rng.choice(shared))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            base[rng.randrange(60)] = rng.choice(words)
        tail = [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 12, 14, 16, 40]))]
        rows.append((rng.choice([k, -k - 1, (1 << 62) + k, (1 << 33) * k]), " ".join(base + tail)))
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 3
    for hot in (2, 4, 1000):
        assert bag(parity.near_duplicates(df, hot_from=hot).collect()) == want


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 700))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.3], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        a, b = parity.bit_sketch(x), parity.bit_sketch(y)
        w = min(len(a), len(b)) // 8
        assert np.bitwise_count(parity.folded(a, w) ^ parity.folded(b, w)).sum() <= len(x) + len(y) - 2 * both
        if 100 * both >= 80 * (len(x) + len(y) - both):
            bands = parity.Bands(80, 2000)
            s, o = parity.postings([x, y], bands)
            assert set(s[o == 0]) & set(s[o == 1])
            assert parity.near_enough(a, b, len(x) + len(y), 80)


def test_words_that_are_opposites(spark, odd):
    a, b = thue_morse(10)
    rows = [(1, a), (2, b), (3, " ".join([a] * 6)), (4, " ".join([b] * 6)), (5, a.upper())]
    got = {r.doc_id: r.component_id for r in parity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    rng = random.Random(12)
    words = {"".join(rng.choice("abcé") for _ in range(n)) for n in range(1, 700) for _ in range(3)}
    hashes = shingles._words(np.frombuffer(" ".join(words).encode(), np.uint8))[0]
    assert len(set(hashes.tolist())) == len(words)


def test_shingles_of_many_texts_are_those_of_each():
    texts = [b"", b"a", b"A b c d", b"a b c d e", b"a b c d e f a b c d e", b" \t x\n", "é ü a b c d".encode()]
    together = shingles.shingle_sets(texts)
    assert [len(s) for s in together] == [0, 1, 1, 1, 6, 1, 2]
    assert all((a == shingles.shingle_sets([t])[0]).all() for a, t in zip(together, texts))


# pipeline


def test_pipeline(spark, odd):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = quality.keep_good(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rows = rows_of(good)
    first = {i for i, _, c in brute_components(rows) if i == c}
    kept = [(i, t) for i, t in rows if i in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    cut = {i: brute_cut(t, items) for i, t in kept}
    cut = {i: t for i, t in cut.items() if t is not None}
    out = corpus_pipeline.run(spark, d)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(cut) and out.count() == len(got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "duplicates", "benchmark", "privacy", "tokens"]
    terms = brute_terms(list(cut.values()))
    with open(WORDS_FILE) as f:
        mine = bpe.Bpe(json.load(f))
    source = {r.doc_id: r for r in docs.collect()}
    for i, t in cut.items():
        want = brute_sanitised(t, terms)
        r = got[i]
        assert r.text == want and r.n_chars == len(want) and (r.lang, r.source) == (source[i].lang, source[i].source)
        ids = mine.ids(want)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha(" ".join(map(str, ids))) and r.decoded_sha256 == sha(mine.decode(ids))


def brute_cut(text, items, n=10):
    """The text without the runs of words that benchmark windows cover; None if no word is left."""
    t = text or ""
    places = [m.span() for m in WORD.finditer(t.translate(LOWER))]
    w = [t.translate(LOWER)[a:b] for a, b in places]
    hit = set()
    for item, body in items:
        x = WORD.findall((body or "").translate(LOWER))
        m = min(n, len(x))
        windows = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if x else set()
        for k in range(len(w) - m + 1) if windows else ():
            if tuple(w[k : k + m]) in windows:
                hit |= set(range(k, k + m))
    if w and len(hit) == len(w):
        return None
    out, at = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += t[at : places[k][0]]
        at = places[k][1]
    return out + t[at:] if hit else text


def brute_spans(text):
    """(start, kind, end, match) of the base kinds."""
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            one = brute_pii(m[0])[0] if kind != "email" else None
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(x) if j % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for j, x in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                assert one is None or one[k]
                found.append((m.start(), k, m.end(), m[0]))
    return sorted(found)


def folded(x):
    return x.lower().replace("ς", "σ")


def brute_terms(texts, threshold=pii.THRESHOLD, support=pii.SUPPORT):
    """Disclosing terms of each entity, from counts over all contexts."""
    copies = collections.Counter(c for t in texts for c in re.findall(pii.STRETCH, t or ""))
    n_e, n_te, n_t = collections.Counter(), collections.Counter(), collections.Counter()
    seen_e, seen_te = collections.Counter(), collections.Counter()
    for c, k in copies.items():
        for w in set(WORD.findall(folded(c))):
            n_t[w] += k
        spans = brute_spans(c)
        rest, at = "", 0
        for a, _, b, _ in spans:
            rest += c[at : max(a, at)] + " "
            at = max(at, b)
        words = {w for w in WORD.findall(folded(rest + c[at:])) if len(w) > 1}
        for e in {(kind, m.translate(LOWER)) for _, kind, _, m in spans}:
            n_e[e] += k
            seen_e[e] += 1
            for w in words:
                n_te[e, w] += k
                seen_te[e, w] += 1
    total, out = sum(copies.values()), collections.defaultdict(set)
    for (e, w), k in n_te.items():
        if seen_te[e, w] >= support and 1 - np.log(max(n_t[w] / k, 1)) / np.log((total + 1) / n_e[e]) >= threshold:
            out[e].add(w)
    return out


def brute_sanitised(text, terms):
    if text is None:
        return None
    spans = [(a, k, b) for a, k, b, _ in brute_spans(text)]
    known = set().union(*(terms.get((k, text[a:b].translate(LOWER)), set()) for a, k, b in spans))
    for m in re.finditer(pii.ANY_WORD, text) if known else ():
        if folded(m[0]) in known and not any(a < m.end() and m.start() < b for a, _, b in spans):
            spans.append((m.start(), 4, m.end()))
    out, at = "", 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += text[at:a] + f"[{[*KINDS, 'term'][k].upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_sanitised_against_counts(spark, odd):
    rng = random.Random(17)
    names = ["Éva", "Zoë Quark", "Ωmega", "smith"]
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5))) for _ in range(40)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 12)))
    rows = []
    for k in range(150):
        lines = [sentence() for _ in range(rng.randint(1, 4))]
        if k % 3 == 0:
            j = rng.randrange(4)
            lines.insert(0, f"{sentence()} {rng.choice([str.lower, str.upper, str])(names[j])} {sentence()}, p{j}@x.org or 10.0.0.{j} {sentence()}")
        if k % 10 == 0:
            lines.append(rng.choice(names) + " " + sentence() * 60)
        rows.append((k, "\n".join(lines)))
    rows += [(200, rows[0][1]), (201, None)]
    terms = brute_terms([t for _, t in rows])
    assert terms
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert got == {i: brute_sanitised(t, terms) for i, t in rows} and any("[TERM]" in (t or "") for t in got.values())


STAGE_ROWS = [(None, None), (None, "a text without an id, and a mail a@b.co"), (1, None), (2, ""), (3, "Plain words of a clean text that nobody else has."), (3, "Plain words of a clean text that nobody else has."), (4, "plain words of a clean text that nobody else has."), (5, "word " * 30_000), (6, "mail joe@x.org now")]


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Every stage keeps the columns, takes null and empty texts, repeated rows and empty tables."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, spans string, id int, key string"
    spark.createDataFrame([(k, 1, 0) for k in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands anywhere else in any of the other texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], STAGE_ROWS):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", 1, "k") for i, t in rows], kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if name != "tokens":
                assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
            else:
                assert set(docs.columns) <= set(out.columns) and all(r.n_tokens == len(r.ids) for r in got)
            want = {"duplicates": len(rows) - (1 if rows else 0)}.get(name, len(rows))
            assert len(got) == want, name
            assert all(r.score == "x" and r.key == "k" for r in got)


def test_queries_on_odd_tables(spark, odd, tmp_path):
    """All queries as they are registered, on empty tables and on odd rows with clashing columns."""
    for k, rows in enumerate(([], STAGE_ROWS)):
        d = f"{tmp_path}/{k}"
        extra = [(i, t, "en", "s", len(t or ""), 1.0, "y", 7) for i, t in rows]
        spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n_words int").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, "u", t, 1.0) for i, t, *_ in extra], "page_id long, url string, html string, k double").write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame([(i, None if t is None else [float(len(t)), 1.0], 1, 2.0) for i, t, *_ in extra], "vec_id long, embedding array<float>, label int, score double").write.parquet(f"{d}/embeddings.parquet")
        spark.createDataFrame([(i, t) for i, t, *_ in extra[:2]], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(i, 1, 0) for i, *_ in extra[:4]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        for name, query in queries.QUERIES.items():
            n = query(spark, d).count()
            assert n == len(rows) or name.startswith(("op1_", "op11_")), name  # searches give rows for their queries alone
