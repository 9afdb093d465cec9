"""Record streams, integration, decoding, templates, pipelines."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.functions import text
from heddle.operators import marc, records
from heddle.operators.integrate import Integrator
from heddle.plans import pipeline
from heddle.sinks import files as sinks
from heddle.sources import files, sqltemplate
from heddle.streaming.drops import process_drops


def col(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def frame(spark, ids, depth, name):
    kinds = ["B", "H", "I"][:depth]
    return spark.createDataFrame([(*(i if isinstance(i, tuple) else (i,)), f"{name}{i}") for i in ids], ", ".join(f"{k} long" for k in kinds) + f", p_{name} string")


EVEN, ODD = list(range(0, 21, 2)), list(range(1, 22, 2))
HOLDINGS = [(0, 100), (0, 200), (3, 103), (6, 106), (6, 206), (9, 109), (12, 112), (12, 212), (15, 115), (18, 118), (18, 218), (21, 121)]
ITEMS = [(0, 200, 2000), (0, 200, 2001), (0, 201, 2010), (0, 201, 2011), (4, 400, 4000), (4, 401, 4010)]


@pytest.mark.parametrize("fused", [False, True])
def test_siblings(spark, fused):
    even, odd = frame(spark, EVEN, 1, "m"), frame(spark, ODD, 1, "o")
    tree = lambda: Integrator(fused)
    assert len(tree().add("/r/m", even, ["B"]).add("/r/o", odd, ["B"]).compile().collect()) == 22
    special = frame(spark, [8, 12], 1, "s")
    both = tree().add("/r/m", even, ["B"]).add("/r/s", special, ["B"]).compile()
    assert both.count() == 11 and both.filter("s IS NOT NULL").count() == 2
    empty = even.filter("false").withColumnRenamed("p_m", "p_e")
    assert tree().add("/r/m", even, ["B"]).add("/r/e", empty, ["B"]).compile().count() == 11
    assert tree().add("/r/m", even, ["B"]).add("/r/e", empty, ["B"], True).compile().count() == 0
    assert tree().add("/r/m", empty, ["B"]).add("/r/e", empty, ["B"]).compile().count() == 0
    assert tree().add("/r/m", even, ["B"], True).add("/r/o", odd, ["B"], True).compile().count() == 0


def test_gathered_and_orphans_dropped(spark):
    tree = Integrator().add("/r/m", frame(spark, EVEN, 1, "m"), ["B"]).add("/r/hs/h", frame(spark, HOLDINGS, 2, "h"), ["B", "H"])
    got = {r["B"]: [x["_id"] for x in r["hs"] or []] for r in tree.compile().collect()}
    assert len(got) == 15 and got[0] == [100, 200] and got[2] == [] and got[21] == [121]
    tree.add("/r/hs/h/is/i", frame(spark, ITEMS, 3, "i"), ["B", "H", "I"])
    whole = {r["B"]: {x["_id"]: [i["_id"] for i in x["h"]["is"] or []] for x in r["hs"] or []} for r in tree.compile().collect()}
    assert len(whole) == 15 and whole[0] == {100: [], 200: [2000, 2001]} and whole[4] == {}


def test_three_levels_kept_and_validation(spark):
    a, b = frame(spark, ITEMS, 3, "a"), frame(spark, [(0, 100, 1001), (0, 200, 2000)], 3, "b")
    assert Integrator().add("/r/a", a, ["B", "H", "I"]).add("/r/b", b, ["B", "H", "I"]).compile().count() == 7
    with pytest.raises(ValueError):
        Integrator().add("/r/a", a, ["B"]).add("/r/a", a, ["B"])
    with pytest.raises(ValueError):
        Integrator().add("/r/x/a", a, ["B", "H", "I"]).add("/r/x/b", frame(spark, HOLDINGS, 2, "h"), ["B", "H"]).add("/r/c", a, ["B", "H", "I"]).compile()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6)), st.lists(st.integers(0, 6)), st.booleans(), st.booleans())
def test_siblings_against_sets(spark, a, b, ra, rb):
    a, b = set(a), set(b)
    one = spark.createDataFrame([(x, "x") for x in a], "B long, p string")
    two = spark.createDataFrame([(x, "y") for x in b], "B long, q string")
    want = (a | b) & (a if ra else a | b) & (b if rb else a | b)
    for fused in (False, True):
        got = Integrator(fused).add("/r/p", one, ["B"], ra).add("/r/q", two, ["B"], rb).compile()
        assert {r["B"] for r in got.collect()} == want


@pytest.mark.parametrize(("n", "size", "want"), [(7, 3, [3, 3, 1]), (7, 10, [7]), (6, 3, [3, 3]), (0, 3, [])])
def test_split(spark, n, size, want):
    df = spark.createDataFrame([("d", i * 5) for i in range(n)], "doc string, pos long").repartition(3)
    got = records.split_chunks(df, ["doc"], "pos", size).groupBy("chunk_no").count().orderBy("chunk_no")
    assert [r["count"] for r in got.collect()] == want


def test_split_restarts_and_null_documents(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "doc string, pos long")
    assert col(records.split_chunks(df, ["doc"], "pos", 2), "pos", "chunk_no") == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]
    assert col(records.split_at(df.filter("doc = 'a'"), ["doc"], "pos", F.lit(None).cast("boolean")), "chunk_no") == [(0,), (0,)]


def test_runs(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["A", "A", "B", "A", None, None])], "p int, s string")
    assert [r["run_no"] for r in records.concat_runs(df, "s", "p").orderBy("p").collect()] == [0, 0, 1, 2, 3, 3]


def test_nest_and_failures(spark):
    df = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 11, "z"), (None, 5, "n"), (1, 10, "a")], "a long, b long, v string")
    got = {r["a"]: [(x["b"], [y["v"] for y in x["rows"]]) for x in r["b_list"]] for r in records.nest(df, ["a", "b"]).collect()}
    assert got == {1: [(10, ["a", "x"]), (11, ["y"])], 2: [(11, ["z"])], 0: [(5, ["n"])]}
    good, bad = records.bisect([1, 2, 3, 4, 5], lambda part: 3 not in part)
    assert (good, bad) == ([1, 2, 4, 5], [3])
    assert records.bisect([], lambda part: False) == ([], [])


def test_templates():
    sample = r"something <\ and id in (<\INTEGER*\>)\> else "
    assert sqltemplate.parse(sample).sql == "something  and id in (?,?,?,?,?,?) else "
    assert sqltemplate.parse(sample, suppress=True).sql == "something  else "
    assert sqltemplate.value("float", "1/2") == 0.5
    assert sqltemplate.padded([1, 2, 3], 6) == [[1, 2, 3, 3, 3, 3]]
    for wrong in (r"<\INTEGER\> <\INTEGER*\>", r"<\INTEGER*\> <\BIGINT*\>", r"<\ open", r"shut \>"):
        with pytest.raises(ValueError):
            sqltemplate.parse(wrong)


def test_text(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    L = F.lit
    assert value(text.sanitize(L("a\x01b\U0001F600"))) == "a�b\U0001F600" and value(text.sanitize(L(None).cast("string"))) is None
    assert value(text.init_cap(L("fOO bar"))) == "FOO Bar" and value(text.trim_trailing_period(L("x etc."))) == "x etc." and value(text.trim_trailing_period(L("x."))) == "x"
    assert value(text.substring_from(L("abc"), 0, 1)) == "" and value(text.substring_from(L("abc"), 2, 2)) == "bc"
    assert value(text.substring_before(L("abc"), "x")) == "" and value(text.substring_after(L("a.b"), ".")) == "b"
    assert value(text.trim_trailing(L("a : "), ":")) == "a" and value(text.trim_leading_percent(L(" % a"))) == "a"
    assert [value(text.extension(L(p))) for p in ("a/b.c/d", "a/.hidden", "a/x.tar.gz")] == ["", "", ".gz"]
    assert value(text.fraction(L("1/2"))) == 0.5 and value(text.keywords(F.array(L("the sea on the sea")), ["the", "on"])) == ["Sea"]


def binary(fields, coding="a"):
    body, directory = b"", b""
    for tag, data in fields:
        data += b"\x1e"
        directory += f"{tag}{len(data):04d}{len(body):05d}".encode()
        body += data
    base = 24 + len(directory) + 1
    return f"{base + len(body) + 1:05d}cam {coding}22{base:05d} a 4500".encode() + directory + b"\x1e" + body + b"\x1d"


def test_marc(spark):
    good = binary([("001", b"77"), ("245", "10\x1faTität\x1fbrest".encode()), ("500", b"  lost\x1fakept")])
    assert len(good[:24]) == 24
    bad = [binary([("001", b"\xff\xfe")]), binary([("001", b"1")], " "), binary([("001", b"1")], "z"), b"short"]
    df = spark.createDataFrame([(0, 2, bytearray(good[30:])), (0, 1, bytearray(good[:30])), *[(i + 1, 1, bytearray(b)) for i, b in enumerate(bad)]], "id int, s int, b binary")
    got = {r["id"]: r for r in marc.decode(marc.assemble(df, "id", "s", "b")).collect()}
    rec = got[0]["rec"]
    assert rec["leader"] == good[:24].decode() and rec["controlfield"][0]["value"] == "77"
    assert [(s["code"], s["value"]) for s in rec["datafield"][0]["subfield"]] == [("a", "Tität"), ("b", "rest")]
    assert [(s["code"], s["value"]) for s in rec["datafield"][1]["subfield"]] == [("a", "kept")]
    assert [got[i]["error"] for i in (1, 2, 3, 4)] == ["field is not UTF-8", "unsupported coding", "unknown coding", "record is not terminated"]
    assert all(got[i]["rec"] is None for i in (1, 2, 3, 4))
    up = marc.decode(marc.assemble(df.filter("id = 0"), "id", "s", "b"), modify={"245": F.upper}).first()
    assert up["rec"]["datafield"][0]["subfield"][0]["value"] == "TITÄT"


def test_names_and_documents(spark, tmp_path):
    one = spark.range(1)
    assert one.select(sinks.incrementing_name("/tmp/out.xml", F.lit(0), 5, "", True)).first()[0] == "/tmp/out.xml-00000.gz"
    assert one.select(sinks.incrementing_name("out/marc", F.lit(123456), 5, ".xml", False)).first()[0] == "out/marc-123456.xml"
    assert one.select(sinks.relative_name(F.lit("/in/a/b.xml"), "/in", "/out", ".o")).first()[0] == "/out/a/b.xml.o"
    df = spark.createDataFrame([(str(tmp_path / "o/x.xml"), 2, "<rec>b\x01</rec>"), (str(tmp_path / "o/x.xml"), 1, "<rec>a</rec>"), (str(tmp_path / "o/y.xml.gz"), 1, "<rec>c</rec>")], "p string, n int, x string")
    assert len(sinks.write_documents(df, "p", "x", ["n"], "i:root", {"i": "http://x"})) == 2
    back = files.read_xml(spark, [str(tmp_path / "o/x.xml"), str(tmp_path / "o/y.xml.gz")], "rec", "_VALUE string")
    assert {os.path.basename(r["system_id"]) for r in back.collect()} == {"x.xml", "y.xml.gz"}
    assert "a</rec>\n<rec>b�" in (tmp_path / "o/x.xml").read_text()


def test_tree(spark, tmp_path):
    for p in ("obj/0=dflat_1", "obj/full/d.txt", "other/e.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("t\x01")
    (tmp_path / "obj/loop").symlink_to(tmp_path / "obj")
    entries = files.read_tree(spark, str(tmp_path))
    kinds = {os.path.relpath(r["path"], tmp_path): r["kind"] for r in entries.collect()}
    assert kinds["obj/full/d.txt"] == "file" and kinds["obj/loop"] == "symlink" and kinds["obj"] == "dir" and kinds["."] == "dir"
    assert {r["object_id"] for r in files.object_trees(entries).collect()} == {"obj"}
    assert files.object_trees(entries).filter("name = 'e.txt'").count() == 0
    got = {r["name"]: r["content"] for r in files.with_contents(spark, entries, str(tmp_path)).collect()}
    assert got["d.txt"] == "t�" and got["full"] is None
    assert {r["kind"] for r in files.read_tree(spark, str(tmp_path), follow=True).filter("name = 'loop'").collect()} == {"symlink"}


def test_params_and_pipeline(spark, tmp_path):
    (tmp_path / "p").write_text("a\nb\n")
    assert col(files.read_params(spark, str(tmp_path / "p")), "pos", "value") == [(0, "a"), (1, "b")]
    (tmp_path / "q").write_text("a\0b")
    assert col(files.read_params(spark, str(tmp_path / "q"), "\0"), "value") == [("a",), ("b",)]
    assert files.is_content("<a/>") and not files.is_content("a.xml")
    ops = pipeline.parse_args(["in.xml", "--split", "--chunk-size", "2", "--join", "--all"])
    assert [o.command for o in ops] == ["input", "split", "join", "output"] and ops[0].options == {"input": "in.xml"} and ops[1].options == {"chunk-size": "2"}
    assert pipeline.kind_of(ops) == pipeline.JOIN
    config = pipeline.parse_config('<pipeline><command type="split">chunk-size = 5<property name="position">pos</property></command></pipeline>', {"document": "doc"})
    assert config[0].options == {"chunk-size": "5", "position": "pos", "document": "doc"}
    df = spark.createDataFrame([("d", i) for i in range(7)], "doc string, pos long")
    assert pipeline.run(spark, config, df).agg(F.max("chunk_no")).first()[0] == 1
    with pytest.raises(ValueError):
        pipeline.run(spark, [pipeline.Op("nothing")], df)


def test_stream_of_drops(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    for _ in range(2):
        process_drops(spark, src, "id long", lambda f: f.withColumn("x", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_transform_keeps_nulls_and_isolates_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id long, n int")
    seen = records.transform_records(df, lambda r: {"v": repr(r["n"])}, "v string", ["id"])
    assert {r["id"]: r["v"] for r in seen.collect()} == {1: "None", 2: "5", 3: "7"}
    odd = records.transform_records(df, lambda r: {"v": "x" if r["id"] == 2 else r["n"]}, "v int", ["id"])
    got = {r["id"]: (r["v"], r["error"] is None) for r in odd.collect()}
    assert got == {1: (None, True), 2: (None, False), 3: (7, True)}


def test_integrate_forms_agree_on_repeated_ids(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "I long, x string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, None)], "I long, y string")
    got = [Integrator(fused).add("/r/a", a, ["I"]).add("/r/b", b, ["I"]).compile().selectExpr("I", "a.x", "b.y", "b IS NULL AS none") for fused in (False, True)]
    first, second = (sorted(map(tuple, g.collect()), key=str) for g in got)
    assert first == second and len(first) == 6


def test_runs_over_tasks(spark):
    names = [None, None, "a", "a", "b", "a"] * 40
    df = spark.createDataFrame(list(enumerate(names)), "pos long, sid string").repartition(5)
    want, run = {}, -1
    for i, n in enumerate(names):
        run += i == 0 or n != names[i - 1]
        want[i] = run
    assert {r["pos"]: r["run_no"] for r in records.concat_runs(df, "sid", "pos").collect()} == want
    assert records.concat_runs(df.filter("false"), "sid", "pos").count() == 0


def emitted(tree):
    return [r["rec_xml"] for r in tree.to_xml().orderBy("BIB_ID").collect()]


def keyed(spark, ids, kinds, name):
    rows = [(*(i if isinstance(i, tuple) else (i,)), str(i[-1] if isinstance(i, tuple) else i)) for i in ids]
    return spark.createDataFrame(rows, ", ".join(f"{k} long" for k in kinds) + f", {name} string")


def test_emitted_xml(spark):
    kinds = ["BIB_ID", "HLDG_ID", "ITEM_ID"]
    marc, odd = keyed(spark, [0, 2, 4], kinds[:1], "BIB"), keyed(spark, [1, 2], kinds[:1], "BIB")
    # siblings side by side, in the order they were declared
    tree = Integrator().add("/record/marc", marc, kinds[:1]).add("/record/marcOdd", odd, kinds[:1])
    assert emitted(tree) == [
        '<record id="BIB_ID-0"><marc id="BIB_ID-0"><bib>0</bib></marc></record>', '<record id="BIB_ID-1"><marcOdd id="BIB_ID-1"><bib>1</bib></marcOdd></record>',
        '<record id="BIB_ID-2"><marc id="BIB_ID-2"><bib>2</bib></marc><marcOdd id="BIB_ID-2"><bib>2</bib></marcOdd></record>', '<record id="BIB_ID-4"><marc id="BIB_ID-4"><bib>4</bib></marc></record>']
    # gathered holdings, and items below those that are there; an empty required sibling leaves nothing
    holdings, items = keyed(spark, [(0, 100), (0, 200), (3, 103)], kinds[:2], "hldg"), keyed(spark, [(0, 200, 2000), (0, 201, 2010), (4, 400, 4000)], kinds, "item")
    tree = Integrator().add("/record/marc", marc, kinds[:1]).add("/record/hldgs/hldg", holdings, kinds[:2]).add("/record/hldgs/hldg/items/itemEven", items, kinds)
    assert emitted(tree) == [
        '<record id="BIB_ID-0"><marc id="BIB_ID-0"><bib>0</bib></marc><hldgs id="BIB_ID-0"><hldg id="HLDG_ID-100"><hldg>100</hldg></hldg>'
        '<hldg id="HLDG_ID-200"><hldg>200</hldg><items id="HLDG_ID-200"><itemEven id="ITEM_ID-2000"><item>2000</item></itemEven></items></hldg></hldgs></record>',
        '<record id="BIB_ID-2"><marc id="BIB_ID-2"><bib>2</bib></marc></record>', '<record id="BIB_ID-3"><hldgs id="BIB_ID-3"><hldg id="HLDG_ID-103"><hldg>103</hldg></hldg></hldgs></record>',
        '<record id="BIB_ID-4"><marc id="BIB_ID-4"><bib>4</bib></marc></record>']
    assert emitted(Integrator().add("/record/marc", marc, kinds[:1]).add("/record/none", odd.filter("false"), kinds[:1], True)) == []
    odd_text = spark.createDataFrame([(1, "a<b>&\x01", None)], "BIB_ID long, t string, u string")
    assert emitted(Integrator().add("/r/m", odd_text, kinds[:1])) == ['<r id="BIB_ID-1"><m id="BIB_ID-1"><t>a&lt;b&gt;&amp;�</t></m></r>']


def test_a_truncated_source_fails_the_integration(spark, tmp_path):
    (tmp_path / "whole.xml").write_text("<root><record><B>1</B></record></root>")
    (tmp_path / "cut.xml").write_text("<root><record><B>1</B></record><record><B>2")
    a, b = (files.read_xml(spark, str(tmp_path / n), "record", "B long") for n in ("whole.xml", "cut.xml"))
    tree = Integrator().add("/r/a", a.drop("system_id"), ["B"]).add("/r/b", b.drop("system_id"), ["B"])
    with pytest.raises(Exception):
        tree.to_xml().collect()


def test_integrate_from_configuration_is_strict(spark):
    from heddle.operators.integrate import from_config

    with pytest.raises(ValueError):
        from_config("<x/>", lambda k, p: None)
    with pytest.raises(ValueError):
        from_config('<c:source type="integrate" xmlns:c="urn:heddle:config"><r><c:other/></r></c:source>', lambda k, p: None)


def test_record_paths(spark):
    df = spark.createDataFrame([("<a><b k='v'> 1 </b></a>",), ("<a><b>2</b></a>",)], "xml string")
    assert {r["record_id"] for r in records.record_ids(df, "xml", "/a/b[@k=v]").collect()} == {"1", None}
    assert {r["record_id"] for r in records.record_ids(df, "xml", "/*/b[@k]").collect()} == {"v", None}
    with pytest.raises(Exception):
        records.record_ids(df, "xml", "/a/b[@k=v]", required=True).collect()
    for wrong in ("a/b", "/", "/a[b]", "/a/@k/b", "/a[@k]/b"):
        with pytest.raises(ValueError):
            records.xpath_of(wrong)


def test_output_writes_documents_and_post_retries(spark, tmp_path):
    df = spark.createDataFrame([("/in/a.xml", 0, "<r>1</r>"), ("/in/a.xml", 0, "<r>2</r>"), ("/in/b.xml", 1, "<r>3</r>")], "system_id string, chunk_no long, xml string")
    out = tmp_path / "out"
    out.mkdir()
    pipeline.run(spark, [pipeline.Op("output", {"output": str(out), "documents": "", "input-base": "/in", "output-base-name": "all", "output-extension": ".xml"})], df)
    assert sorted(p.name for p in out.iterdir()) == ["all-00000.xml", "all-00001.xml"]
    assert (out / "all-00000.xml").read_text().split("\n")[1:-1] == ["<root>", "<r>1</r>", "<r>2</r>", "</root>"]
    pipeline.run(spark, [pipeline.Op("output", {"output": str(out), "documents": "", "input-base": "/in", "gzip": ""})], df)
    assert {p.name for p in out.iterdir()} >= {"a-00000.xml.gz", "b-00000.xml.gz"}
    assert pipeline.parse_args(["x.xml", "--output", "-b", "base", "-l", "3", "-z"])[-1].options == {"output-base-name": "base", "suffix-length": "3", "gzip": ""}
    calls = []

    def send(url, body):
        calls.append(body)
        if len(calls) < 3:
            raise OSError("down")

    sinks._tried(send, "http://x.invalid", "[]", 3)
    assert len(calls) == 3
    with pytest.raises(OSError):
        sinks._tried(lambda u, b: (_ for _ in ()).throw(OSError("down")), "http://x.invalid", "[]", 0)


def test_input_is_content_or_a_list_in_order(spark, tmp_path):
    for name, n in (("b.xml", 2), ("a.xml", 1)):
        (tmp_path / name).write_text(f"<root><record><B>{n}</B></record></root>")
    (tmp_path / "list").write_text(f"{tmp_path}/b.xml\n{tmp_path}/a.xml\n")
    got = pipeline.run(spark, [pipeline.Op("input", {"input": str(tmp_path / "list")})])
    assert [(r["doc_pos"], r["B"]) for r in got.orderBy("doc_pos").collect()] == [(0, 2), (1, 1)]
    assert pipeline.run(spark, [pipeline.Op("input", {"input": str(tmp_path / "a.xml")})]).first()["B"] == 1


def test_several_children_gathered(spark):
    kinds = ["BIB_ID", "HLDG_ID"]
    a, b = keyed(spark, [(0, 100), (0, 200)], kinds, "x"), keyed(spark, [(0, 100), (1, 300)], kinds, "y")
    tree = Integrator().add("/record/marc", keyed(spark, [0, 1], kinds[:1], "BIB"), kinds[:1]).add("/record/all/a", a, kinds).add("/record/all/b", b, kinds).flag("/record/all", aggregating=True)
    assert tree.level(tree.root.children[0].child("all")) == 1
    assert emitted(tree) == [
        '<record id="BIB_ID-0"><marc id="BIB_ID-0"><bib>0</bib></marc><all id="BIB_ID-0"><a id="HLDG_ID-100"><x>100</x></a><b id="HLDG_ID-100"><y>100</y></b><a id="HLDG_ID-200"><x>200</x></a></all></record>',
        '<record id="BIB_ID-1"><marc id="BIB_ID-1"><bib>1</bib></marc><all id="BIB_ID-1"><b id="HLDG_ID-300"><y>300</y></b></all></record>']
