"""Binary bibliographic records: segments put together and decoded by SQL expressions.

A record is a leader of 24 bytes, a directory of 12-byte entries (tag, length,
start), and fields, each closed by 0x1E, the record by 0x1D. Nothing is decoded
in Python; a record that cannot be decoded keeps its row, with ``rec`` null and
the reason in ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = (
    "struct<leader:string,controlfield:array<struct<tag:string,value:string>>,"
    "datafield:array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,value:string>>>>>"
)


def assemble(segments: DataFrame, record_id: str, sequence: str, segment: str) -> DataFrame:
    """(id, raw, error): the segments of each id in order of ``sequence``; an id whose last byte is not the record terminator is in error."""
    parts = segments.filter(F.col(segment).isNotNull()).groupBy(F.col(record_id).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), F.hex(segment).alias("h")))).alias("parts")
    )
    raw = F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), ""))
    return parts.select("id", raw.alias("raw")).withColumn(
        "error", F.when(F.coalesce(F.hex(F.expr("right(raw, 1)")), F.lit("")) != "1D", "record is not terminated")
    )


def decode(records: DataFrame, raw: str = "raw", modify: dict[str, callable] | None = None) -> DataFrame:
    """Adds rec (a record as struct) and error to ``records``.

    Coding 'a' at leader position 9 is UTF-8 and read strictly; a blank is the
    older coding, which is not supported; others are unknown. Control fields
    have tags that begin with 00. In data fields the first two characters are
    indicators, what stands before the first subfield mark is lost.
    ``modify``: {tag: Column → Column} applied to the text of fields.
    """
    b = F.col(raw)
    head = records.withColumn("__leader", F.when(F.length(b) >= 24, F.decode(F.substring(b, 1, 24), "ISO-8859-1")))
    base = F.expr("try_cast(substring(__leader, 13, 5) AS int)")
    staged = head.withColumns({"__base": base}).withColumn("__n", F.expr("(__base - 25) div 12"))
    text = F.decode(b, "ISO-8859-1")  # one character for each byte, to cut by position
    staged = staged.withColumn("__text", text).withColumn("__dir", F.when(
        F.col("__n") > 0,
        F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.struct(
            F.substring("__text", 25 + i * 12, F.lit(3)).alias("tag"),
            F.expr("1").alias("one"),
            F.try_to_number(F.substring("__text", 28 + i * 12, F.lit(4)), F.lit("9999")).cast("int").alias("length"),
            F.try_to_number(F.substring("__text", 32 + i * 12, F.lit(5)), F.lit("99999")).cast("int").alias("start"),
        )),
    ).otherwise(F.array().cast("array<struct<tag:string,one:int,length:int,start:int>>")))

    def field_text(e: Column) -> Column:
        piece = F.substring("__text", F.col("__base") + e["start"] + 1, e["length"])
        return F.try_validate_utf8(F.encode(piece, "ISO-8859-1").cast("string"))

    staged = staged.withColumn("__fields", F.transform("__dir", lambda e: F.struct(e["tag"].alias("tag"), field_text(e).alias("v"))))
    if modify:
        def changed(f: Column) -> Column:
            out = f["v"]
            for tag, function in modify.items():
                out = F.when(f["tag"] == tag, function(f["v"])).otherwise(out)
            return F.struct(f["tag"].alias("tag"), out.alias("v"))

        staged = staged.withColumn("__fields", F.transform("__fields", changed))
    coding = F.substring("__leader", 10, 1)
    old = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    error = F.coalesce(
        old,
        F.when(F.col("__leader").isNull() | F.col("__base").isNull(), "no leader"),
        F.when(coding == " ", "unsupported coding"),
        F.when(coding != "a", "unknown coding"),
        F.when(F.exists("__dir", lambda e: e["length"].isNull() | e["start"].isNull()), "bad directory"),
        F.when(F.exists("__fields", lambda f: f["v"].isNull()), "field is not UTF-8"),
        F.when(F.exists("__fields", lambda f: ~f["v"].endswith("\x1e")), "field is not terminated"),
    )
    control = F.transform(F.filter("__fields", lambda f: f["tag"].startswith("00")), lambda f: F.struct(f["tag"].alias("tag"), F.rtrim(f["v"], F.lit("\x1e")).alias("value")))
    data = F.transform(
        F.filter("__fields", lambda f: ~f["tag"].startswith("00")),
        lambda f: F.struct(
            f["tag"].alias("tag"), F.substring(f["v"], 1, 1).alias("ind1"), F.substring(f["v"], 2, 1).alias("ind2"),
            F.transform(
                F.slice(F.split(F.rtrim(f["v"], F.lit("\x1e")), "\x1f"), F.lit(2), F.greatest(F.size(F.split(f["v"], "\x1f")) - 1, F.lit(0))),
                lambda s: F.struct(F.substring(s, 1, 1).alias("code"), F.expr("1").alias("one"), s.alias("whole")),
            ).alias("subfield"),
        ),
    )
    data = F.transform(data, lambda d: F.struct(
        d["tag"].alias("tag"), d["ind1"].alias("ind1"), d["ind2"].alias("ind2"),
        F.transform(d["subfield"], lambda s: F.struct(s["code"].alias("code"), F.substring(s["whole"], F.lit(2), F.length(s["whole"])).alias("value"))).alias("subfield"),
    ))
    rec = F.when(error.isNull(), F.struct(F.col("__leader").alias("leader"), control.alias("controlfield"), data.alias("datafield")).cast(RECORD))
    keep = [c for c in records.columns if c != "error"]
    return staged.select(*keep, rec.alias("rec"), error.alias("error"))


def encode(records: DataFrame, rec: str = "rec") -> DataFrame:
    """Adds raw: records as bytes again, the leader's lengths set anew; null for null."""
    r = F.col(rec)
    control = F.transform(F.coalesce(r["controlfield"], F.array()), lambda f: F.struct(f["tag"].alias("tag"), F.concat(F.coalesce(f["value"], F.lit("")), F.lit("\x1e")).alias("v")))
    data = F.transform(F.coalesce(r["datafield"], F.array()), lambda f: F.struct(f["tag"].alias("tag"), F.concat(
        F.coalesce(f["ind1"], F.lit(" ")), F.coalesce(f["ind2"], F.lit(" ")),
        F.array_join(F.transform(F.coalesce(f["subfield"], F.array()), lambda s: F.concat(F.lit("\x1f"), s["code"], F.coalesce(s["value"], F.lit("")))), ""),
        F.lit("\x1e")).alias("v")))
    staged = records.withColumn("__f", F.concat(control, data))
    staged = staged.withColumn("__d", F.aggregate(
        "__f", F.struct(F.lit(0).alias("at"), F.lit("").alias("dir")),
        lambda a, f: F.struct((a["at"] + F.octet_length(f["v"])).alias("at"),
                              F.concat(a["dir"], f["tag"], F.lpad(F.octet_length(f["v"]).cast("string"), 4, "0"), F.lpad(a["at"].cast("string"), 5, "0")).alias("dir"))))
    base = F.lit(25) + F.length("__d.dir")
    total = base + F.col("__d.at") + 1
    leader = F.concat(F.lpad(total.cast("string"), 5, "0"), F.substring(r["leader"], 6, 7), F.lpad(base.cast("string"), 5, "0"), F.substring(r["leader"], 18, 7))
    body = F.concat(leader, F.col("__d.dir"), F.lit("\x1e"), F.array_join(F.transform("__f", lambda f: f["v"]), ""), F.lit("\x1d"))
    return staged.withColumn("raw", F.when(r.isNotNull(), F.encode(body, "UTF-8"))).drop("__f", "__d")
