"""Paths into decoded records: fields by tag and indicator, subfields by code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def control(rec: Column, tag: str) -> Column:
    """The value of the first control field with a tag; null without one."""
    return F.try_element_at(F.filter(rec["controlfield"], lambda f: f["tag"] == tag), F.lit(1))["value"]


def fields(rec: Column, tags: Sequence[str], ind1: str | None = None, ind2: str | None = None) -> Column:
    """The data fields with one of the tags and, if given, the indicators."""

    def wanted(f: Column) -> Column:
        out = f["tag"].isin(*tags)
        if ind1 is not None:
            out = out & (f["ind1"] == ind1)
        return out & (f["ind2"] == ind2) if ind2 is not None else out

    return F.filter(F.coalesce(rec["datafield"], F.array().cast("array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,value:string>>>>")), wanted)


def subfields(field: Column, codes: str | None = None, without: str = "") -> Column:
    """The values of a field's subfields with one of ``codes`` (all if None), in order, without nulls."""

    def wanted(s: Column) -> Column:
        out = s["value"].isNotNull()
        if codes is not None:
            out = out & s["code"].isin(*codes)
        return out & ~s["code"].isin(*without) if without else out

    return F.transform(F.filter(F.coalesce(field["subfield"], F.array().cast("array<struct<code:string,value:string>>")), wanted), lambda s: s["value"])


def values(rec: Column, tags: Sequence[str], codes: str | None = None, without: str = "", separator: str = " ") -> Column:
    """One text for each field: its subfields joined; empty ones are left out."""
    texts = F.transform(fields(rec, tags), lambda f: F.trim(F.array_join(subfields(f, codes, without), separator)))
    return F.filter(texts, lambda t: t != "")


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def sort_title(rec: Column) -> Column:
    """The title without the characters that its second indicator (1 to 9) says are not filed."""
    f = first(fields(rec, ["245"]))
    title = F.array_join(subfields(f, "ab"), " ")
    skip = F.coalesce(F.try_to_number(F.when(f["ind2"].rlike("^[1-9]$"), f["ind2"]), F.lit("9")).cast("int"), F.lit(0))
    return F.substring(title, skip + 1, F.length(title))


def index_document(rec: Column, record_id: Column) -> Column:
    """Fields of a search-index document, in order, from a record: generic groups of tags only."""

    def named(name: str, items: Column) -> Column:
        return F.transform(items, lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))

    def one(name: str, item: Column) -> Column:
        return named(name, F.filter(F.array(item), lambda v: v.isNotNull() & (v != "")))

    return F.concat(
        one("id", record_id.cast("string")), one("title", first(values(rec, ["245"], "ab"))), one("title_sort", sort_title(rec)),
        named("author", values(rec, ["100", "110", "700", "710"], "ad")), named("subject", values(rec, ["650", "651", "655"], without="2", separator="--")),
        named("description", values(rec, ["300"])), named("note", values(rec, ["500", "505"], "a")), one("language", F.substring(control(rec, "008"), 36, 3)),
    )
