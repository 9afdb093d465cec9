"""Scalar text functions of the record transforms, as column expressions.

Where the path language has an empty sequence these take null for ''.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def sanitize(x: ColumnLike) -> Column:
    """Characters that XML 1.0 does not allow become U+FFFD; null stays null."""
    return F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "�")


def normalize_space(x: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"[ \t\r\n]+", " "))


def string_join(parts: ColumnLike, separator: str = " ") -> Column:
    return F.array_join(F.col(parts) if isinstance(parts, str) else parts, separator)


def join_and_trim(parts: ColumnLike, separator: str = " ", drop_period: bool = False) -> Column:
    joined = normalize_space(string_join(parts, separator))
    return F.regexp_replace(joined, r"\.$", "") if drop_period else joined


def strip_hyphen(x: ColumnLike) -> Column:
    return F.replace(_c(x), F.lit("-"), F.lit(""))


def trim_leading_percent(x: ColumnLike) -> Column:
    return F.regexp_replace(_c(x), r"^\s*%\s*", "")


def add_trailing(x: ColumnLike, sign: str) -> Column:
    """The text with ``sign`` at its end, once."""
    return F.when(_c(x).endswith(sign), _c(x)).otherwise(F.concat(_c(x), F.lit(sign)))


# The patterns of the trimming functions below are given by the results they must match.
# A text with this end keeps its period.
KEPT_END = "etc."
# Signs whose patterns take the blanks before them as well; before a comma or an equals sign they stay.
WITH_BLANKS_BEFORE = ";:/"
_S = r"[ \t\r\n]"


def trim_trailing_period(x: ColumnLike, keep_etc: bool = True) -> Column:
    """Without a period and the blanks behind it at the end; a text that ends right with 'etc.' is left as it is."""
    cut = F.regexp_replace(_c(x), rf"\.{_S}*$", "")
    return F.when(_c(x).endswith(KEPT_END), _c(x)).otherwise(cut) if keep_etc else cut


def trim_trailing(x: ColumnLike, sign: str) -> Column:
    """Without one ``sign`` (several characters: a run of any of them) and the blanks behind it at the end."""
    inside = "".join("\\" + s for s in sign)
    before = f"{_S}*" if all(s in WITH_BLANKS_BEFORE for s in sign) else ""
    return F.regexp_replace(_c(x), rf"{before}[{inside}]{'+' if len(sign) > 1 else ''}{_S}*$", "")


def trim_pipes(x: ColumnLike) -> Column:
    """Without a run of pipes and the blanks behind it at the end."""
    return F.regexp_replace(_c(x), rf"\|+{_S}*$", "")


def trim_colon_and_semicolon(x: ColumnLike) -> Column:
    """Without a colon and the blanks behind it at the end, then without a semicolon likewise."""
    return F.regexp_replace(F.regexp_replace(_c(x), rf":{_S}*$", ""), rf";{_S}*$", "")


def convert_quotes(x: ColumnLike) -> Column:
    """Straight double quotation marks become apostrophes."""
    return F.replace(_c(x), F.lit('"'), F.lit("'"))


def convert_amp(x: ColumnLike) -> Column:
    """Ampersands become the word."""
    return F.replace(_c(x), F.lit("&"), F.lit("and"))


def trim_only_spaces(x: ColumnLike) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), rf"{_S}+", " "), "^ +| +$", "")


def trim_whitespace(x: ColumnLike) -> Column:
    """As trim_only_spaces, and without a period at the end."""
    return trim_trailing_period(trim_only_spaces(x), keep_etc=False)


def year(as_of: int | None = None) -> Column:
    """The current year as a number; ``as_of`` fixes it, for runs that must give the same again."""
    return F.lit(as_of) if as_of is not None else F.year(F.current_date())


def verbatim(x: Column, row_tag: str) -> Column:
    """A struct as XML text."""
    return F.to_xml(x, {"rowTag": row_tag})


def cdata(x: ColumnLike) -> Column:
    """The text as character data that needs no escapes; an end mark inside is split over two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(_c(x), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def lookup(frame: DataFrame, key: str, table: DataFrame, *, name: str = "value", most_bytes: int = 64_000_000) -> DataFrame:
    """``frame`` with the value of (key, value) rows of a lookup document under ``name``; null without one, a row for each of several.

    The table is broadcast if it has at most ``most_bytes``, which is measured;
    a larger one is joined by shuffle. Repeated rows of the table count once.
    """
    unique = table.filter("key IS NOT NULL").select(F.col("key").cast("string").alias("__key"), F.col("value").alias(f"__{name}")).distinct()
    size = unique.agg(F.sum(F.octet_length("__key") + F.coalesce(F.octet_length(F.col(f"__{name}").cast("string")), F.lit(0)) + 32).alias("b")).first()["b"] or 0
    side = F.broadcast(unique) if size <= most_bytes else unique
    kept = [F.col(f"`{c}`") for c in frame.columns if c != name]
    return frame.join(side, F.col(f"`{key}`").cast("string") == F.col("__key"), "left").select(*kept, F.col(f"__{name}").alias(name))


def trim_all_but_alphanumeric(x: ColumnLike) -> Column:
    return F.regexp_replace(_c(x), r"[^a-zA-Z0-9_-]+$", "")


def init_cap(x: ColumnLike) -> Column:
    """Each word with a capital first letter, its rest as it is (the built-in lowers the rest)."""
    return F.array_join(F.transform(F.split(_c(x), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def trim_parens(x: ColumnLike) -> Column:
    return F.translate(_c(x), "()", "")


def trim_angle_brackets(x: ColumnLike) -> Column:
    return F.translate(_c(x), "<>", "")


def trim_double_quotes(x: ColumnLike) -> Column:
    return F.translate(_c(x), '"', "")


def substring_from(x: ColumnLike, start: int, length: int) -> Column:
    """substring with positions from 1; positions before 1 hold nothing but count."""
    return F.substring(_c(x), max(start, 1), max(0, length + min(0, start - 1)))


def substring_before(x: ColumnLike, mark: str) -> Column:
    """What stands before the first ``mark``; '' without one."""
    return F.when(F.instr(_c(x), mark) > 0, F.substring(_c(x), F.lit(1), F.instr(_c(x), mark) - 1)).otherwise("")


def substring_after(x: ColumnLike, mark: str) -> Column:
    return F.when(F.instr(_c(x), mark) > 0, F.substring(_c(x), F.instr(_c(x), mark) + len(mark), F.length(_c(x)))).otherwise("")


def matches(x: ColumnLike, pattern: str, ignore_case: bool = False) -> Column:
    return _c(x).rlike(("(?i)" if ignore_case else "") + pattern)


def any_equal(items: ColumnLike, value) -> Column:
    """The comparison of a sequence with a value: true if one of its members is equal."""
    return F.exists(F.col(items) if isinstance(items, str) else items, lambda i: i == F.lit(value))


def same_number(x: ColumnLike, number: int) -> Column:
    """Comparison of text as a number: '020' is 20, what is no number is nothing."""
    return F.coalesce(F.expr(f"try_cast({x} AS int)") == number, F.lit(False)) if isinstance(x, str) else F.coalesce(F.try_to_number(x, F.lit("999999999")) == number, F.lit(False))


def fraction(x: ColumnLike) -> Column:
    """'a/b' or a number as float."""
    parts = F.split(F.col(x) if isinstance(x, str) else x, "/")
    return F.when(F.size(parts) == 2, parts[0].cast("float") / parts[1].cast("float")).otherwise(parts[0].cast("float")).cast("float")


def basename(x: ColumnLike) -> Column:
    return F.regexp_extract(_c(x), r"([^/]*)$", 1)


def extension(x: ColumnLike) -> Column:
    """The last extension with its dot; a name that only begins with a dot has none."""
    return F.regexp_extract(basename(x), r"^.+?(\.[^./]*)$", 1)


def digits_only(x: ColumnLike) -> Column:
    return F.regexp_replace(_c(x), r"\D+", "")


def keywords(parts: ColumnLike, stop: Sequence[str]) -> Column:
    """The distinct words of texts without stop words, capitalised."""
    words = F.flatten(F.transform(F.col(parts) if isinstance(parts, str) else parts, lambda p: F.split(p, r"[^\p{L}\p{N}]+")))
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*stop))
    return F.array_distinct(F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))))
