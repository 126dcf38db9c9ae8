"""Archives and GraphML by ranges, against the standard library and other shapes of file."""

import collections
import io
import json
import random
import tarfile
import xml.etree.ElementTree as ET
import zipfile

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from hyperweave.sources import archives, graphml


def contents(rng, n, most=3000):
    return [(f"dir{k % 3}/m{k}.{rng.choice(['json', 'png', 'txt'])}", rng.randbytes(rng.choice([0, 1, 511, 512, 513, rng.randint(1, most)]))) for k in range(n)]


def make_tar(path, members, mode="w", form=tarfile.PAX_FORMAT):
    with tarfile.open(path, mode, format=form) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("dir0")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)


def make_zip(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.mkdir("dir0")
        for name, data in members:
            z.writestr(name, data)


def bag(df):
    return collections.Counter((r.archive.rpartition("/")[2], r.member, r.size, bytes(r.content)) for r in df.collect())


def test_archives_of_all_kinds(spark, tmp_path):
    rng, want = random.Random(1), collections.Counter()
    kinds = {"a.tar": ("w", tarfile.PAX_FORMAT), "b.tar.gz": ("w:gz", tarfile.PAX_FORMAT), "c.tar": ("w", tarfile.GNU_FORMAT), "d.tar.bz2": ("w:bz2", tarfile.PAX_FORMAT), "e.tar.xz": ("w:xz", tarfile.PAX_FORMAT)}
    for name, (mode, form) in kinds.items():
        members = [*contents(rng, 40), ("n" * 150 + "/ümlaut.json", b"{}"), ("twice.txt", b"1"), ("twice.txt", b"22")]
        make_tar(tmp_path / name, members, mode, form)
        want.update((name, m, len(d), d) for m, d in members)
    for name, method in {"s.zip": zipfile.ZIP_STORED, "t.zip": zipfile.ZIP_DEFLATED, "u.zip": zipfile.ZIP_BZIP2, "v.zip": zipfile.ZIP_LZMA}.items():
        members = [*contents(rng, 30), ("ü/x.json", b"{}" * 900)]
        make_zip(tmp_path / name, members, method)
        want.update((name, m, len(d), d) for m, d in members)
    (tmp_path / "w.zip").write_bytes(b"prefix of another program" + (tmp_path / "t.zip").read_bytes())
    want.update(("w.zip", *x[1:]) for x in list(want) if x[0] == "t.zip")
    make_zip(tmp_path / "empty.zip", [])
    make_tar(tmp_path / "empty.tar", [])
    (tmp_path / "none.tar").write_bytes(b"")
    found = archives.index(spark, str(tmp_path))
    assert found.count() == sum(want.values())
    for split in (archives.SPLIT, 700):
        assert bag(archives.read_members(found, split=split)) == want
    some = found.where(F.endswith("member", F.lit(".json")))
    assert bag(archives.read_members(some)) == collections.Counter({x: n for x, n in want.items() if x[1].endswith(".json")})


def test_only_the_members_asked_for_are_read(tmp_path):
    rng = random.Random(2)
    make_tar(tmp_path / "a.tar", [(f"m{k}", rng.randbytes(100_000)) for k in range(20)])
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read(self, n=None):
            out = self.file.read(n)
            read.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    kept = archives.open_ranges
    archives.open_ranges = lambda uri: Counted(kept(uri))
    try:
        entries = list(archives._entries(str(tmp_path / "a.tar")))
    finally:
        archives.open_ranges = kept
    assert len(entries) == 20 and sum(read) < 100_000


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    make_tar(tmp_path / "a.tar", [(f"m{k}", b"x" * 5000) for k in range(200)])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = archives.read_members(archives.index(spark, str(tmp_path / "a.tar")), split=50_000)
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sum(r["count"] for r in tasks) == 200 and len(tasks) > 5


@pytest.mark.parametrize("broken", ["error", "skip"])
def test_damaged_archives(spark, tmp_path, broken):
    make_tar(tmp_path / "good.tar", [("m", b"1")])
    make_zip(tmp_path / "x.zip", [("m", b"1" * 5000)])
    (tmp_path / "x.zip").write_bytes((tmp_path / "x.zip").read_bytes()[:-30])
    (tmp_path / "y.tar").write_bytes(b"no archive" * 200)
    if broken == "skip":
        assert [r.member for r in archives.index(spark, str(tmp_path), broken=broken).collect()] == ["m"]
    else:
        with pytest.raises(Exception, match="cannot be read"):
            archives.index(spark, str(tmp_path)).collect()


def test_check_sums_and_sizes(spark, tmp_path):
    make_zip(tmp_path / "a.zip", [("m", b"abc" * 50)], zipfile.ZIP_STORED)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[data.index(b"abcabc")] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(data))
    found = archives.index(spark, str(tmp_path / "a.zip"))
    with pytest.raises(Exception, match="check sum"):
        archives.read_members(found).collect()
    with pytest.raises(Exception, match="m has 150 bytes"):
        archives.read_members(found, most=1).collect()


def test_written_archives_are_read_back_by_others(spark, tmp_path):
    rows = [(f"p{k}", bytes([k]) * k) for k in range(30)] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, data binary").repartition(3)
    want = {n: d or b"" for n, d in rows}
    for write, read in ((archives.write_tar, lambda p: {m.name: t.extractfile(m).read() for t in [tarfile.open(p)] for m in t}), (archives.write_zip, lambda p: {m: z.read(m) for z in [zipfile.ZipFile(p)] for m in z.namelist()})):
        paths = archives.paths_of(write(df, "name", "data"))
        got = {}
        for p in paths:
            got |= read(fs.FileSystem.from_uri(p)[1])
        assert got == want
        assert {r.member: bytes(r.content) for r in archives.read_members(archives.index(spark, *paths)).collect()} == want


@pytest.mark.parametrize("piece", [1, 7, 100_000])
def test_json_items(piece):
    value = {"a": [1, {"b": "}\",:{"}], "n": -1.5e3, "s": "é \\\"", "deep": {"x": {"y": [[]]}}, "e": {}, "long": "z" * 5000, "t": True, "k": 123456789}
    text = json.dumps(value, indent=1, ensure_ascii=False).encode()
    got = {k: json.loads(v) for k, v in archives.json_items(iter([text[i : i + piece] for i in range(0, len(text), piece)]))}
    assert got == value and list(archives.json_items(iter([b" {} "]))) == []
    for bad in (b"[1]", b'{"a": 1', b'{"a"', b'{"a": [1, }', b"", b'{a: 1}'):
        with pytest.raises(ValueError):
            list(archives.json_items(iter([bad])))


def test_pages_of_a_knowledge_base(spark):
    pages = spark.createDataFrame([(f"https://x.org/{k}", json.dumps({"title": f"T{k}", "section_texts": ["é" * k]})) for k in range(50)], "url string, page string").repartition(2)
    found = archives.index(spark, *archives.paths_of(archives.write_json_zip(pages, "url", "page")))
    got = archives.read_json_items(found)
    assert {(r.key, r.value) for r in got.collect()} == {(r.url, r.page) for r in pages.collect()}
    wanted = spark.createDataFrame([("https://x.org/7",), ("https://x.org/7",), ("absent",)], "u string")
    assert [r.key for r in archives.read_json_items(found, wanted).collect()] == ["https://x.org/7"]


# GraphML


def by_tree(text):
    """Nodes and edges by the standard library's tree."""
    root = ET.fromstring(text)
    ns = f"{{{graphml.NAMESPACE}}}"
    names = {k.get("id"): k.get("attr.name") or k.get("id") for k in root.iter(f"{ns}key")}
    nodes, edges = collections.Counter(), collections.Counter()
    for kind in ("node", "edge"):
        for x in root.iter(f"{ns}{kind}"):
            data = tuple(sorted({names.get(d.get("key"), d.get("key")): d.text or "" for d in x.findall(f"{ns}data")}.items()))
            if kind == "node":
                nodes[x.get("id").strip('"'), data] += 1
            else:
                edges[x.get("source").strip('"'), x.get("target").strip('"'), data] += 1
    return nodes, edges


def by_ranges(spark, path, split):
    nodes, edges = graphml.read_graphml(spark, str(path), split=split)
    return collections.Counter((r.node, tuple(sorted(r.data.items()))) for r in nodes.collect()), collections.Counter((r.source, r.target, tuple(sorted(r.data.items()))) for r in edges.collect())


def graph_text(rng, n, prefix="", keys_last=False):
    p = prefix + ":" if prefix else ""
    keys = f'<{p}key id="d0" for="node" attr.name="role"/>\n<{p}key attr.name = \'why > "not"\' id="d1" for="edge"></{p}key>'
    sign = ["a &lt;node id=\"x\"&gt;", "é & > 'q'".replace("&", "&amp;"), "", "line\nbreak", "x" * 300]
    nodes = "\n".join(f'<{p}node id="n{k} &gt; &quot;"{rng.choice([" ", chr(10), ""])}>{"" if k % 4 else f"<{p}data key=" + chr(39) + f"d0{chr(39)}>{rng.choice(sign)}</{p}data>"}</{p}node>' if k % 3 else f"<{p}node id='n{k}'/>" for k in range(n))
    edges = "".join(f'<{p}edge source="n{rng.randrange(n)}" target="n{rng.randrange(n)}" note=">"><{p}data key="d1">{rng.choice(sign)}</{p}data><{p}data key="d9">7</{p}data></{p}edge>' for _ in range(n))
    nested = f'<{p}node id="outer"><{p}data key="d0">o</{p}data><{p}graph><{p}node id="inner"/></{p}graph></{p}node>'
    space = f'xmlns{":" + prefix if prefix else ""}="{graphml.NAMESPACE}"'
    return f'<?xml version="1.0"?>\n<!-- a comment -->\n<{p}graphml {space}>{"" if keys_last else keys}<{p}graph edgedefault="undirected">{nodes}{nested}{edges}</{p}graph>{keys if keys_last else ""}</{p}graphml>'


@pytest.mark.parametrize("prefix,keys_last", [("", False), ("g", True)])
def test_graphml_by_ranges(spark, tmp_path, prefix, keys_last):
    text = graph_text(random.Random(3), 120, prefix, keys_last)
    (tmp_path / "g.graphml").write_text(text)
    want = by_tree(text)
    assert want[0]["outer", (("role", "o"),)] == 1 and sum(want[1].values()) == 120
    for split in (97, 5000, 1 << 20, None):
        assert by_ranges(spark, tmp_path / "g.graphml", split) == want, split


def test_reads_meet_everywhere(monkeypatch):
    """Elements are whole wherever a read or a range ends."""
    text = graph_text(random.Random(4), 12).encode()
    want = None
    for piece in (1, 2, 5, 64, 100_000):
        monkeypatch.setattr(graphml, "PIECE", piece)
        for size in (1, 13, 700, 10**6):
            got = [x for a in range(0, len(text), size) for x in graphml.elements(io.BytesIO(text), a, min(len(text), a + size))]
            want = want or got
            assert got == want and len(got) == 12 + 2 + 12 + 2


def test_cut_off_graphml(spark, tmp_path):
    text = graph_text(random.Random(5), 30)
    (tmp_path / "g.graphml").write_text(text[: text.index("inner")])
    (tmp_path / "empty.graphml").write_text("")
    (tmp_path / "broken.graphml").write_text("<graphml")
    nodes, edges = graphml.read_graphml(spark, str(tmp_path))
    assert nodes.count() == 30 and edges.count() == 0


def test_node_link(spark):
    nodes = spark.createDataFrame([("a", {"k": "v"})], "node string, data map<string,string>")
    edges = spark.createDataFrame([("a", "b", 0.5, None)], "source string, target string, weight double, data map<string,string>")
    got = {(r.kind, r.value) for r in graphml.to_node_link(nodes, edges).collect()}
    assert got == {("node", '{"data":{"k":"v"},"id":"a"}'), ("edge", '{"source":"a","target":"b","weight":0.5}')}


def test_broken_elements_among_whole_ones():
    """Elements are parsed some at once; one that is broken, or would take the next in, costs itself alone."""
    whole = [f'<node id="{k}"/>'.encode() for k in range(5)]
    ids = lambda texts: [x.get("id") for x in graphml._parsed(texts, b"<g>")]
    assert ids([*whole[:2], b'<node id="x"><data></node>', *whole[2:]]) == list("01234")
    assert ids([whole[0], b'<node id="x"><!-- </node>', b'<node id="y">--></node>', whole[1]]) == list("0y1")


def test_graph_is_written_and_parsed_once(spark, tmp_path):
    """Nodes, edges and keys had been three parses of every element, and what was parsed was dealt by its file."""
    lines = spark.createDataFrame([(o, p, 1.5) for o in range(30) for p in (o % 5, o % 7)], "l_orderkey long, l_partkey long, l_quantity double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    from hyperweave.plans import catalogue

    got = catalogue.QUERIES["graphml_scan"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan[: plan.index("MapInArrow")] and "Union" not in plan
    rows = {(r.kind, r.source, r.target, r.weight, r.role) for r in got.collect()}
    edges = {(f"o{o}", f"p{p}") for o in range(30) for p in (o % 5, o % 7)}
    assert rows == {("edge", *e, 3.0 if int(e[0][1:]) % 5 == int(e[0][1:]) % 7 else 1.5, None) for e in edges} | {("node", x, None, None, "hyper & edge" if x[0] == "o" else "entity") for e in edges for x in e}


def test_nameless_ends_are_not_lost(spark, tmp_path):
    from hyperweave.sources import files

    nodes = spark.createDataFrame([("a", {"k": None, "l": "1"})], "node string, data map<string,string>")
    edges = spark.createDataFrame([("a", None, 1.0, None)], "source string, target string, weight double, data map<string,string>")
    with pytest.raises(Exception, match="edge without a name"):
        files.write_graphml(nodes, edges, str(tmp_path / "x"))
    files.write_graphml(nodes, edges.limit(0), str(tmp_path / "y"))
    assert [(r.node, r.data) for r in graphml.read_graphml(spark, str(tmp_path / "y"))[0].collect()] == [("a", {"l": "1"})]
