"""One form for text that reads the same: DuckDB inside Arrow partitions.

Each task hands its Arrow batches to an embedded DuckDB, whose SQL maps
look-alike letters, width, ligatures, blanks, hyphens and invisible characters
and composes accents. What does not change the reading is mapped; case,
visible accents and other marks are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import stored

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKE = {
    "АВЕЅІЈКМНОРСТУХҮԌԚԜ": "ABESIJKMHOPCTYXYGQW",
    "аеѕіјорсухһԁԛԝӏ": "aesijopcyxhdqwl",
    "ЁЇёї": "ËÏëï",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "νορ": "vop",
    "ΆΈΉΊΌΎό": "ÁÉHÍÓÝó",
    "ɡϳɑ": "gja",
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ": "ABCDEHJKLMPRSTVWZ",
    "ՕՏՍհոսօցզ": "OSUhnuogq",
}
HYPHENS = "‐‑﹣－⁃"
#: General categories without a glyph; soft hyphens, joiners and direction marks are among them.
INVISIBLE = ("Cf",)
BLANKS = ("Zs", "Zl", "Zp")
#: Kinds of compatibility mapping that keep the reading; superscripts, fractions and circled signs are marks of their own.
WIDTH = ("<wide>", "<narrow>")
TOP = 0x30000


@cache
def tables() -> tuple[str, str, str, dict[str, str]]:
    """(from, to) of single characters for translate, the class of invisible characters, and the characters that become several (ligatures)."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    invisible: list[str] = []
    for code in range(0x80, TOP):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in INVISIBLE or 0xFE00 <= code <= 0xFE0F or code == 0x034F or code == 0x115F or code == 0x180E:
            invisible.append(ch)
        elif kind in BLANKS or code == 0x85:
            single[ch] = " "
        else:
            how = unicodedata.decomposition(ch)
            if how.startswith(WIDTH):
                to = unicodedata.normalize("NFKC", ch)
                if len(to) == 1:
                    single[ch] = to
            elif how.startswith("<compat>") and unicodedata.name(ch, "").find("LIGATURE") >= 0:
                several[ch] = unicodedata.normalize("NFKC", ch)
    for ch in HYPHENS:
        single[ch] = "-"
    for a, b in LOOK_ALIKE.items():
        single.update(zip(a, b, strict=True))
    for a, b in list(single.items()):  # a wide look-alike is a look-alike
        single[a] = single.get(b, b)
    a, b = "".join(single), "".join(single.values())
    return a, b, "".join(invisible), several


def _class(chars: str) -> str:
    """A regular-expression class of runs of code points."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def reading_sql(column: str) -> str:
    """DuckDB's expression for the reading of a column; texts of ASCII alone only have their blanks put right."""
    a, b, invisible, several = tables()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    bare = f"regexp_replace({column}, {quote(_class(invisible))}, '', 'g')"
    for ch, to in several.items():
        bare = f"replace({bare}, {quote(ch)}, {quote(to)})"
    # composed first for letters stored with their accent apart, and again for accents on mapped letters
    mapped = f"nfc_normalize(translate(nfc_normalize({bare}), {quote(a)}, {quote(b)}))"
    plain = f"CASE WHEN regexp_full_match({column}, '[\\x00-\\x7F]*') THEN {column} ELSE {mapped} END"
    return rf"trim(regexp_replace({plain}, '[ \t\n\v\f\r]+', ' ', 'g'))"


def _read(columns: list[str], memory: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        picked = None
        for batch in batches:
            if picked is None:
                picked = ", ".join(
                    f'{reading_sql(chr(34) + c + chr(34))} AS "{c}"' if c in columns else f'"{c}"' for c in batch.schema.names
                )
            part = pa.Table.from_batches([batch])
            con.register("part", part)
            out = con.sql(f"SELECT {picked} FROM part").to_arrow_table()
            con.unregister("part")
            yield from out.cast(batch.schema).to_batches()

    return read


def reading(frame: DataFrame, *columns: str, memory: str = "256MB") -> DataFrame:
    """``frame`` with the text columns ``columns`` in their one form.

    Null stays null, empty stays empty, blanks at the ends go and runs of
    blanks become one. Two texts read the same exactly if their forms are
    equal. Rows and other columns are left as they are; columns with the same
    name are not allowed. No row leaves its partition.
    """
    kinds = dict(frame.dtypes)
    if len(kinds) != len(frame.columns):
        raise ValueError("column names must be unique")
    if wrong := [c for c in columns if kinds.get(c) != "string"]:
        raise TypeError(f"not a text column: {', '.join(wrong)}")
    return frame.mapInArrow(_read(list(columns), memory), frame.schema)


def reading_classes(texts: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(id, raw, reading, class_id, n_ways): each distinct (key, text) with the class of texts that read the same.

    A class is named by the hash of its reading; n_ways counts the strings in
    it, of which 1 means that all its texts agree to the letter. Linear in the
    rows, whatever share of them one reading has: only distinct strings are
    read and counted, and the rows meet their string's class by the string.
    Null texts and keys are left out, and so are texts whose reading is empty.
    """
    spelt = texts.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("raw")).filter("raw IS NOT NULL AND id IS NOT NULL").distinct()
    strings = reading(spelt.select("raw").distinct().withColumn("reading", F.col("raw")), "reading").filter("reading <> ''")
    strings = stored(strings, "readings")
    ways = strings.groupBy("reading").agg(F.count(F.lit(1)).alias("n_ways"))
    known = strings.join(ways, "reading").withColumn("class_id", F.xxhash64("reading"))
    return spelt.join(known, "raw").select("id", "raw", "reading", "class_id", "n_ways")


def same_reading(left: DataFrame, right: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(left_id, right_id, reading): every pair whose texts read the same but are not the same string.

    For results that are asked for as pairs; ``reading_classes`` gives the same
    links as classes. Both sides are (key, text); their rows are reduced to
    distinct ones, and readings written in one way only on both sides are left
    out before the join, so frequent texts that all agree make no pair.
    """
    both = left.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("raw"), F.lit(0).alias("side")).unionByName(
        right.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("raw"), F.lit(1).alias("side"))
    )
    spelt = both.filter("raw IS NOT NULL AND id IS NOT NULL").distinct()
    # stored, for the strings are read for their number and again for the rows
    strings = stored(reading(spelt.select("raw").distinct().withColumn("reading", F.col("raw")), "reading").filter("reading <> ''"), "readings")
    several = strings.groupBy("reading").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("reading")
    sides = spelt.join(strings.join(several, "reading", "left_semi"), "raw")
    a = sides.filter("side = 0").select("reading", F.col("id").alias("left_id"), F.col("raw").alias("left_raw"))
    b = sides.filter("side = 1").select("reading", F.col("id").alias("right_id"), F.col("raw").alias("right_raw"))
    return a.join(b, "reading").filter("left_raw <> right_raw").select("left_id", "right_id", "reading").distinct()


def subfields(bib: DataFrame, record: str = "marc_record", key: str = "bib_id") -> DataFrame:
    """(bib_id, field_no, tag, code, value): one row for each subfield, fields numbered from 1."""
    fields = bib.select(F.col(f"`{key}`").alias("bib_id"), F.posexplode(F.col(f"`{record}`.datafield")).alias("pos", "f"))
    return fields.select("bib_id", (F.col("pos") + 1).alias("field_no"), F.col("f.tag").alias("tag"), F.explode("f.subfield").alias("s")).select(
        "bib_id", "field_no", "tag", F.col("s.code").alias("code"), F.col("s.value").alias("value")
    )


def is_subject(tag: Column, code: Column) -> Column:
    return (tag == "650") & (code == "a")
