"""The text operators: against brute force, round trips and held-out cases."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import forms, leak, mojibake, names, scan, sentences, tokens


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# --- one form

SAME = [
    ("Hospitals--History", "Ηοspitals--Ηistοry"), ("naïve art", "naïve art"), ("Ｉｃｅ－－Ｅ", "Ice--E"), ("flax", "ﬂax"), ("tide tables", "ti­de t​ables"),
    ("Guilds--P", "Guilds‑‑P"), ("école", "е́cole"), ("ё", "ë"), ("a b", " a  b "),
]
OTHER = [("Ice", "ice"), ("resume", "résumé"), ("a-b", "a–b"), ("x2", "x²"), ("ss", "ß"), ("o", "ø")]


def test_reading(spark):
    data = [(i, a, b) for i, (a, b) in enumerate(SAME + OTHER)] + [(90, None, None), (91, "", "")]
    df = spark.createDataFrame(data, "i int, a string, b string").withColumn("reading", F.lit("clash"))
    got = {r["i"]: r for r in forms.reading(df, "a", "b").collect()}
    for i, pair in enumerate(SAME):
        assert got[i]["a"] == got[i]["b"], pair
    for i, pair in enumerate(OTHER, len(SAME)):
        assert got[i]["a"] != got[i]["b"], pair
    assert got[90]["a"] is None and got[91]["a"] == "" and got[0]["reading"] == "clash"
    assert forms.reading(df.filter("false"), "a").count() == 0
    with pytest.raises(TypeError):
        forms.reading(df, "i")


def test_same_reading(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b"), (3, "a b"), (4, None), (5, "c"), (6, "")], "id long, text string")
    assert rows(forms.same_reading(df, df).filter("left_id < right_id").select("left_id", "right_id")) == [(1, 2), (2, 3)]
    assert forms.same_reading(df.filter("false"), df).count() == 0


def test_reading_classes(spark):
    df = spark.createDataFrame([(1, "tide"), (2, "t\u00adide"), (2, "t\u00adide"), (3, "Tide"), (4, None), (5, ""), (None, "tide"), (6, "\u0570and"), (7, "hand")], "id long, text string").withColumn("reading", F.lit("clash"))
    got = forms.reading_classes(df).collect()
    by_id = {r["id"]: (r["class_id"], r["n_ways"]) for r in got}
    assert len(got) == 5 and by_id[1] == by_id[2] and by_id[1][1] == 2 and by_id[3][1] == 1 and by_id[3][0] != by_id[1][0] and by_id[6] == by_id[7]
    assert forms.reading_classes(df.filter("false")).count() == 0


# --- tokens

HARD = ["", None, " ", "a", "it's they'll I'VE 's ''s x's's", "  two\n\n blanks \t", "１２ ٣٤ ½ x²", "中文，測試 한국어", "emoji 👍🏽 ź", "<|endoftext|> ok", "a" * 3000, "x  　 y z", "\r\n\r\n", "don't'd"]


def test_pre_tokens_against_the_pattern():
    import regex

    pattern = regex.compile(tokens.PATTERN)
    draw = random.Random(5)
    texts = [t for t in HARD if t] + ["".join(draw.choice(" '  \n\tasdmtrevlXé12.,!-中😀́") for _ in range(draw.randint(1, 15))) for _ in range(800)]
    words, sizes = tokens._cut(pa.array(texts, pa.string()))
    flat, at = words.cast(pa.large_string()).to_pylist(), 0
    for text, n in zip(texts, sizes):
        assert flat[at : at + n] == pattern.findall(text), text
        at += n
    long, n = tokens._cut_long(pa.array(["ab cd  ef " * 50, "x"]), 20)
    short, m = tokens._cut(pa.array(["ab cd  ef " * 50, "x"]))
    assert list(n) == list(m) and long.cast(pa.large_string()).to_pylist() == short.cast(pa.large_string()).to_pylist()


@pytest.mark.parametrize("block_bytes", [4_000_000, 60])
def test_encode_and_decode(spark, block_bytes):
    path = tokens.tokenizer_file()
    one = tokens.load_encoding(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(None, "null key"), (3, "a")], "doc_id long, text string").withColumn("ids", F.lit(0))
    out = tokens.encode(df, "doc_id", "text", path=path, block_bytes=block_bytes)
    want = sorted((str(k), one.encode_ordinary(t) if t else []) for k, t in [*enumerate(HARD), (None, "null key"), (3, "a")])
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in out.collect()) == want
    back = tokens.decode(out, "doc_id", path=path)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(k), t or "") for k, t in [*enumerate(HARD), (None, "null key"), (3, "a")])
    assert tokens.encode(df.filter("false"), "doc_id", "text", path=path).count() == 0
    bad = spark.createDataFrame([(1, [70000]), (2, None), (3, [255])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokens.decode(bad, "doc_id", path=path).collect()}[1] is None


# --- leaks


def test_leaks_against_brute_force(spark):
    draw = random.Random(7)
    stock = [f"w{i}" for i in range(40)] + ["Straße", "the"]
    passages = [(i, " ".join(draw.choice(stock) for _ in range(30))) for i in range(6)]
    texts = []
    for k in range(60):
        body = [draw.choice(stock) for _ in range(60)]
        if k % 2:
            words, at = draw.choice(passages)[1].split(), draw.randint(0, 15)
            part = [w.upper() for w in words[at : at + draw.choice([12, 13, 14])]]
            if k % 5 == 0:
                part.insert(6, "foreign")
            body[20:20] = part
        texts.append((k, " -- ".join(body)))
    texts += [(100, None), (101, ""), (None, texts[1][1]), (1, texts[1][1])]
    grams = {tuple(w[j : j + 13]): i for i, p in passages for w in [leak.words_of(p)] for j in range(len(w) - 12)}
    want = {(k, grams[g]) for k, t in texts if k is not None and t for w in [leak.words_of(t)] for j in range(len(w) - 12) for g in [tuple(w[j : j + 13])] if g in grams}
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash"))
    items = spark.createDataFrame([*passages, (9, None), (8, "too short")], "item_id long, passage string")
    for shard_bytes in (400, 6_000_000):
        index = leak.build_index(df, "doc_id", "text", shard_bytes=shard_bytes)
        assert set(rows(leak.search(index, items, "item_id", "passage"))) == want
        near = set(rows(leak.search(index, items, "item_id", "passage", near=(12, 3))))
        assert want <= near
    assert leak.search(leak.build_index(df.filter("false"), "doc_id", "text"), items, "item_id", "passage").count() == 0
    assert leak.search(index, items.filter("false"), "item_id", "passage").count() == 0


def near_brute(passage, text, length=13, least=12, slack=3):
    """Whether ``least`` words of a stretch stand in order, from the first to the last of them over at most ``slack`` places more than in the passage."""

    def common(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            last = row
            row = [0]
            for j, b in enumerate(y):
                row.append(max(last[j + 1], row[j], last[j] + (a == b)))
        return row[-1]

    for b in range(len(passage)):
        for m in range(least, min(length, len(passage) - b) + 1):
            for p in range(len(text)):
                for q in range(p + least - 1, min(len(text), p + m + slack)):
                    if text[p] == passage[b] and text[q] == passage[b + m - 1] and common(passage[b + 1 : b + m - 1], text[p + 1 : q]) + 2 >= least:
                        return True
    return False


def test_near_leaks_against_brute_force(spark):
    # the missing word stands again a little later
    passage = "r1 r2 x the b the c d e f g h k"
    cases = [(1000, passage.replace("x the b", "x foreign b")), (1001, passage.replace("the", "o")), (1002, passage.replace("e f", "e o o o f")), (1003, "o o " + passage.replace("e f", "e o o o o f"))]
    # three others on each side are six
    cases.append((1004, passage.replace("x the", "x o o o the").replace("e f", "e o o o f")))
    # a word in the place of a missing one is none of the three
    cases.append((1007, passage.replace("c d", "o d").replace("e f", "e o o o f")))
    # no match across the border of two texts
    cases += [(1005, " ".join(passage.split()[:7])), (1006, " ".join(passage.split()[7:]))]
    draw = random.Random(3)
    stock = ["the", "of", "a"] + [f"w{i}" for i in range(9)]
    passages = [(0, passage)] + [(i, " ".join(draw.choice(stock) for _ in range(20))) for i in range(1, 8)]
    for k in range(200):
        words = draw.choice(passages)[1].split()
        at = draw.randint(0, max(0, len(words) - 13))
        part = words[at : at + 13]
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(part))
            part[i : i + draw.randint(0, 1)] = [draw.choice([*stock, "o"])] * draw.randint(0, 1)
        cases.append((k, " ".join([*(draw.choice(stock) for _ in range(draw.randint(0, 6))), *part, *(draw.choice(stock) for _ in range(draw.randint(0, 6)))])))
    want = {(k, i) for k, t in cases for i, p in passages if near_brute(p.split(), t.split())}
    assert {k for k, i in want if k >= 1000} == {1000, 1002, 1007}
    index = leak.build_index(spark.createDataFrame(cases, "doc_id long, text string").coalesce(1), "doc_id", "text")
    items = spark.createDataFrame(passages, "item_id long, passage string")
    assert set(rows(leak.search(index, items, "item_id", "passage", near=(12, 3)))) == want


def test_words():
    assert leak.words_of("Die STRASSE—3rd, é_x") == ["die", "strasse", "3rd", "é", "x"] and leak.words_of("") == []
    assert scan.code_points("a中".encode()).tolist() == [97, 0x4E2D]


# --- sentences

UNITS = [
    ["1. Hat die Beklagte den Mangel gekannt?", "Geladen waren Kisten usw.", "Sie sagt: „Der Preis betrug 2.095,50 Euro. Mehr nicht.“", "Die Frist lief am 3. Oktober ab, z. B. so.", "Der 2. Zivilsenat (Bl. 25 d. A.) irrt."],
    ["The witness said: “I saw it. Nobody else.”", "No. 7 of the U.K. Mission, J. R. Doe, left at 9 p.m.", "“Who paid?” asked Dr. Roe.", "12 crates were empty!", "It was put so: \"A. The risk was not.\"", "See www.x.invalid/1.2 at 3.60 km."],
    ["III. Costs"], ["Областной суд г. Волев"], ["Суд отказал в иске 5.6.2015 г.", "В 1998 г. Тубрук арендовал 3 кв. м.", "«Где ключ?» — спросил И. П. Пастав."],
    ["被告N. N.认为不成立。", "“钥匙在哪里？”法官问道。", "证人陈述：“没有。不在。”", "已付款……未付。"], ["被告（以下「乙」という。）は契約した。", "「どこか。」と尋ねた。"],
    ["قال الشاهد: «لم أوقع. لم أكن.»", "«أين المفتاح؟» سأل القاضي.", "دفع د. Botus مبلغا."], ["डॉ. Krekum ने कहा, “नहीं। नहीं।”", "“कहां है?” उसने पूछा।"], ["ศาลเห็น", "จำเลย28บาท"], ["Gokux จำกัด กับ Talack"],
]


def test_sentences(spark):
    gaps = random.Random(3)
    text, wanted = "", []
    for block in UNITS:
        thai = block[0] == "ศาลเห็น"
        for i, unit in enumerate(block):
            if i:
                text += " " if thai else gaps.choice([" ", "  ", "\n"]) if unit[0].isascii() or ord(unit[0]) < 0x3000 and unit[0] != "“" or unit[0] in "«“" and "।" in block[0] else "" if "。" in block[0] else " "
            text += unit
            wanted.append(len(text))
        text += gaps.choice(["\n\n", "\n \n", " \n\n\n"])
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n　 "), (5, "\n\n x"), (6, "a. B")], "doc_id long, text string").withColumn("end_pos", F.lit("clash"))
    got = [r["end_pos"] for r in sentences.sentence_ends(df, "doc_id", "text").filter("doc_id = 1").orderBy("end_pos").collect()]
    assert got == wanted
    rest = rows(sentences.sentence_ends(df, "doc_id", "text").filter("doc_id > 1"))
    assert rest == [(5, 4), (6, 5)] or rest == [(5, 4), (6, 3), (6, 5)]
    units = [r["unit"] for r in sentences.sentences(df, "doc_id", "text").filter("doc_id = 1").orderBy("unit_no").collect()]
    assert units == [u for b in UNITS for u in b]


def test_many_sentences(spark):
    n = 3 * sentences.CHUNK + 5
    df = spark.createDataFrame([(1, "Yes it is. " * n)], "doc_id long, text string")
    assert [r["end_pos"] for r in sentences.sentence_ends(df, "doc_id", "text").orderBy("end_pos").collect()] == [10 + 11 * i for i in range(n)]


# --- garbled text

CLEAN = ["Verlag für Heimatbücher", "Edições Maré", "Über Möbel und Flößerei", "Příručka škol a řek", "Dům knihy", "сельские школы и мельницы", "речные суда города", "price £3 – “revised”", "accuracy ±2 m", "ÂMBAR E ÓLEO: NÃO", "Tables of √2", "naïve café", "Łódź źródła książek"]


def test_garbled(spark):
    draw = random.Random(11)
    good = [(" ", draw.choice(CLEAN)) for _ in range(3000)] + [("a", None), (None, ""), ("a", "plain")]
    bad = []
    for text in CLEAN[:7] + CLEAN[11:]:
        for page in ("cp1252", "latin-1", "cp437", "mac_roman"):
            shown = "".join(mojibake._char(page, b) for b in text.encode())
            bad.append((" ", shown, text))
    bad += [(" ", t.encode("cp1251").decode("latin-1"), t) for t in CLEAN[5:7]] + [(" ", t.encode("koi8_r").decode("cp1251"), t) for t in CLEAN[5:7]]
    df = spark.createDataFrame([(s, v, None) for s, v in good] + bad + [(" ", "f�r den", None)], "source string, value string, truth string")
    model, _ = mojibake.learn(df.select("source", "value"))
    out = mojibake.restore(df, model).collect()
    for r in out:
        expected = r["truth"] is not None or (r["value"] or "").startswith("f�r")
        assert r["garbled"] == expected, r
        if r["truth"] is not None:
            assert r["restored"] == r["truth"], r
        elif not r["garbled"]:
            assert r["restored"] == r["value"]
    assert len(out) == df.count()
    empty, _ = mojibake.learn(df.filter("false").select("source", "value"))
    assert mojibake.restore(df.filter("false"), empty).count() == 0


def test_a_page_in_no_list_is_learnt_for_its_source(spark):
    draw = random.Random(5)
    stock = ["Verlag für Bücher", "Über grüne Flößerei und Möbel", "Edições de café e avó", "écoles et forêts régionales", "mère et père fidèles", "schöne Höhlen für Schüler", "sécurité générale des élèves", "grüße aus der Küche"]
    good = [("a", draw.choice(stock)) for _ in range(2500)]
    # a substitution that no code page makes, in one source only
    swap = str.maketrans({"é": "‡", "ü": "¤", "ö": "¬"})
    bad = [("z", t.translate(swap), t) for t in (draw.choice(stock) for _ in range(600)) if t.translate(swap) != t and t[0] not in "éüö"]
    df = spark.createDataFrame([(s, v, None) for s, v in good] + bad, "source string, value string, truth string")
    model, _ = mojibake.learn(df.select("source", "value"))
    assert model.learnt == {"z": {"‡": "é", "¤": "ü", "¬": "ö"}}
    out = mojibake.restore(df, model)
    assert out.filter("garbled AND truth IS NULL").count() == 0
    rest = out.filter("truth IS NOT NULL")
    assert rest.filter("garbled AND restored = truth").count() >= 0.9 * rest.count()


# --- names

PEOPLE = [
    [("Baradufo, Albert Zoë", "1909-1990")] * 3 + [("BARADUFO,ALBERT ZOE", None), ("Albert Zoë Baradufo", None), ("Baradufo, A. Z., ed.", "1909-"), ("Baraddufo, Albert Zoë", "1909-1990"), ("Prof. Albert Baradufo", None)],
    [("Balotratu, Penelope", "1805-1868")] * 2 + [("Balotratu, P.", "b. 1805")],
    [("Balotratu, Penelope", "1836-1886"), ("Penelope Balotratu", "1836-1886.")],
    [("Bibravobo, Harriet Timothy", "1853-1900"), ("Bibravobo, Hattie", "1853-1900"), ("Bibravobo, Hattie Timothy", "1853-1900")],
    [("Titretrehi, Harriet", "1936-")] * 3 + [("Titretrehi, Hattie", "1936-")],
    [("Mulalota, Harriet", "1911-1990")] * 9,  # nicknames are learnt from names that are rarer than the full one
]
BODIES = [
    [("Academy of Comparative Law, Hotenubro", None)] * 2 + [("Acad. of Comp. Law (Hotenubro)", None), ("Hotenubro. Academy of Comparative Law", None), ("Hotenubro Academy of Comparative Law", None), ("Aacdemy of Comparative Law of Hotenubro", None), ("ACL Hotenubro", None), ("THE ACADEMY OF COMPARATIVE LAW AT HOTENUBRO", None)],
    [("Department of Folk Music, Hotenubro", None), ("Dept. of Folk Mus. (Hotenubro)", None)],
    [("Academy of Comparative Law, Tielamu", None)] * 2,
]


def test_names(spark):
    data = [("person", n, d, f"p{i}") for i, group in enumerate(PEOPLE) for n, d in group] + [("body", n, d, f"b{i}") for i, group in enumerate(BODIES) for n, d in group]
    data += [("person", None, None, None), ("person", " ", None, None), ("body", "...", None, None)]
    df = spark.createDataFrame(data, "kind string, name string, dates string, truth string")
    got = names.attribute(df.select("kind", "name", "dates")).collect()
    entity = {(r["kind"], r["name"], r["dates"]): r["entity"] for r in got}
    seen = {}
    for kind, name, dates, truth in data:
        if truth:
            seen.setdefault(truth, set()).add(entity[kind, name, dates])
    assert all(len(v) == 1 for v in seen.values()), seen
    assert len({v for s in seen.values() for v in s}) == len(seen)
    assert names.attribute(df.filter("false").select("kind", "name", "dates")).count() == 0


def test_key_parts_of_equal_frequency(spark):
    data = [("person", "Didikohu, Winifred Natalia", "1811-1869"), ("person", "Didikuhu, Winifred Natalia", "1811-1869"), ("person", "Didikuhx, Albert", "1900-1950")]
    # two ways to read, each spelling is the founder for the other
    data += [("person", "Albert Baradufo", None), ("person", "Baradufo Albert", None)]
    df = spark.createDataFrame(data, "kind string, name string, dates string")
    entity = {r["name"]: r["entity"] for r in names.attribute(df).collect()}
    assert entity["Didikohu, Winifred Natalia"] == entity["Didikuhu, Winifred Natalia"] != entity["Didikuhx, Albert"]
    assert entity["Albert Baradufo"] == entity["Baradufo Albert"]
    read = df.withColumns({"key": F.lower(F.regexp_extract("name", r"^\w+", 0)), "n": F.lit(1), "sure": F.lit(1.0)})
    assert rows(names._neighbours(read).filter("key LIKE 'did%'").select("key", "other")) == [("didikuhu", "didikohu"), ("didikuhx", "didikuhu")]


def test_nicknames_as_frequent_as_the_full_name(spark):
    keys = [f"{a}{b}tra" for a in ("bo", "ki", "lu", "ze") for b in ("da", "fu", "mi", "no", "pe")]
    data = [(k, "1900", g) for k in keys[:3] for g in ("dom", "dominic")] + [("gota", "1900", "dominic"), ("gota", "1901", "ned"), ("gota", "1901", "edgar"), ("gotu", "1902", "ned"), ("gotu", "1902", "edgar")]
    # two common names that meet by accident, as often as each other pair does
    data += [(f"{k}{i}", "1950", g) for i, pair in enumerate([("john", "mary"), ("john", "peter"), ("mary", "peter")]) for k in keys[:6] for g in pair]
    read = spark.createDataFrame([("person", k, [g], y, 1.0, 1) for k, y, g in data], "kind string, key string, parts array<string>, birth string, sure double, n int").withColumn("death", F.lit("1980"))
    assert names.learn_nicknames(read) == {"dom": {"dominic"}, "ned": {"edgar"}, "edgar": {"ned"}}


def test_nickname_beside_the_initial_of_the_full_name(spark):
    data = [("person", f"Bo{k}tra, {g}", "1900-1980") for k in "ad" for g in ("Trudi", "Gertrude")] + [("person", f"Kufo{k}, Gertrude", "1950-") for k in "bdfg"]
    data += [("person", f"Zela, {g}", f"{1900 + i}-1990") for i, g in enumerate(["Albert", "Penelope", "Harriet", "Winifred", "Kamila", "Oliver", "Rosalind", "Matthias", "Zacharias", "Humphrey", "Theresa", "Barnaby"])]
    data += [("person", "Netuboru, Trudi Francoise", "1835-1899"), ("person", "Netuboru, G. F. T.", "1835-1899"), ("person", "Netuboru, H. F. T.", "1835-1899")]
    df = spark.createDataFrame(data, "kind string, name string, dates string")
    entity = {r["name"]: r["entity"] for r in names.attribute(df).collect()}
    assert entity["Netuboru, Trudi Francoise"] == entity["Netuboru, G. F. T."] != entity["Netuboru, H. F. T."]


def test_headings_of_odd_records(spark):
    f = "struct<leader:string,controlfield:array<struct<tag:string,value:string>>,datafield:array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,value:string>>>>>"
    h = lambda n, d=None: ("100", "1", " ", [("a", n), *([("d", d)] if d else [])])
    data = [(1, ("x", None, [h("Doe, Jane", "1900-1950")])), (2, ("x", None, [h("DOE,JANE", "1900-"), h("Other, One")])), (3, None), (4, (None, None, None)), (5, ("x", None, [("100", "1", " ", None)])), (1, ("x", None, [h("Doe, Jane", "1900-1950")])), (6, ("x", None, [h("Doe, Jane", "1950-1990")]))]
    bib = spark.createDataFrame(data, f"bib_id long, marc_record {f}")
    assert rows(names.same_main_entry(bib)) == [(1, 2)]


def test_chains_and_circles_of_attributions(spark):
    chain = [(4, 3), (3, 2), (2, 1), (1, 1), (9, 9)]
    circle = [(20, 21), (21, 22), (22, 20), (30, 21), (31, 30), (10, 31)]
    got = {r["form"]: r["entity"] for r in names.roots(spark.createDataFrame(chain + circle, "form long, entity long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 20: 20, 21: 20, 22: 20, 30: 20, 31: 20, 10: 20}
    assert names.roots(spark.createDataFrame([], "form long, entity long")).count() == 0


def test_short_surnames_and_large_blocks(spark):
    data = [("person", "Lee, Harriet", "1900-1980")] * 3 + [("person", "Leo, Harriet", "1900-1980"), ("person", "Lea, Harriet", "1911-1990"), ("person", "Kim, A.", None)]
    data += [("person", f"Bonufado, A{c}bert", f"{1900 + i}-1990") for i in range(12) for c in "ld"] + [("person", "Bonufado, A.", None)]
    df = spark.createDataFrame(data, "kind string, name string, dates string")
    for most in (2_000, 4):
        entity = {(r["name"], r["dates"]): r["entity"] for r in names.attribute(df, most_in_block=most).collect()}
        assert entity["Lee, Harriet", "1900-1980"] == entity["Leo, Harriet", "1900-1980"] != entity["Lea, Harriet", "1911-1990"]
        pairs = [{entity[f"Bonufado, A{c}bert", f"{1900 + i}-1990"] for c in "ld"} for i in range(12)]
        assert all(len(p) == 1 for p in pairs) and len({v for p in pairs for v in p}) == 12


# --- the subpackage stands apart


def test_nothing_else_imports_this():
    from pathlib import Path

    home = Path(forms.__file__).parent
    for p in home.parent.rglob("*.py"):
        if home not in p.parents:
            assert "heddle.llm" not in p.read_text(), p


def test_stops_in_numbers_and_addresses_are_masked(spark):
    text = "Pay 3.14 at https://x.invalid/a?b=1.2 or mail a.b@c.invalid now. Done."
    row = spark.createDataFrame([(text,)], "t string").select(sentences.marked(F.col("t")).alias("m")).first()["m"]
    assert row.count(sentences.STOP) == 6 and row.replace(sentences.STOP, ".").count(".") == 8
    assert [p for p in row.split(sentences.END) if p] == [row[: row.index("now.") + 4], " Done."]


def test_abbreviations_are_learnt(spark):
    # 'xyzq.' goes on with small letters or numbers and never ends a block; 'usw.' does
    texts = [f"It was xyzq. {n} and xyzq. Later there. Kisten usw. klein\n\nMehr usw.\n\nEnd." for n in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, ""), (97, "no stop")], "doc_id long, text string")
    assert sentences.learn_abbreviations(df, "text") == ["xyzq"]
    ends = [r["end_pos"] for r in sentences.sentence_ends(df.filter("doc_id = 0"), "doc_id", "text", ["xyzq"]).orderBy("end_pos").collect()]
    assert texts[0][: ends[0]].endswith("Later there.")
    assert sentences.learn_abbreviations(df.filter("false"), "text") == []


def test_long_texts_without_blanks_and_many_blocks(spark):
    blocks = 3 * sentences.CHUNK + 2
    df = spark.createDataFrame([(1, "Yes.\n\n" * blocks), (2, "x" * 300_000 + ". Y."), (3, "Ja so. Und.")], "doc_id long, text string")
    got = {}
    for r in sentences.sentence_ends(df, "doc_id", "text", ()).orderBy("end_pos").collect():
        got.setdefault(r["doc_id"], []).append(r["end_pos"])
    assert got == {1: [4 + 6 * i for i in range(blocks)], 2: [300_001, 300_004], 3: [7, 12]}
