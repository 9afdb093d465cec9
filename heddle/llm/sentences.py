"""Sentence units across languages and scripts, in SQL expressions.

A text is cut at its blank lines into blocks. A block keeps its length
throughout: whatever might be taken for a sentence end and is none (in
decimals, addresses, abbreviations, initials, ordinals, quotations and
brackets) is replaced by a private-use placeholder of one character, then
terminators of each script end a unit where what follows allows it, and the
units are read from the original text by their positions. Blocks without any
terminator, most of headings and captions, are one unit and skip the passes.

Abbreviations are learnt from all texts: what stands before a full stop and is
followed by a small letter or a number again and again, but hardly ever ends a
block, ends no sentence. A list of common ones serves as seed. Nothing depends
on a column that states the language: rules go by script, words hold for all
languages together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import stored

# Placeholders, one character each: end of a unit, the two sides of a quotation
# whose marks have no side of their own, a stop that ends nothing.
# They are C1 controls (0x91 and 0x92 are the two set aside for private use): a text
# of the lower range keeps one byte a character with them in it. Where a text has
# such a control of its own, it counts as a replacement character here.
END, OPEN, CLOSE, STOP = "\x91", "\x80", "\x81", "\x92"
MASKS = END + OPEN + CLOSE + STOP

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = {
    "titles": "Mr Mrs Ms Dr Prof St Lt Col Gen Capt Sgt Hon Rev Sr Sra Srta Dra Ing Lic Mme Mlle Me Mgr Fr Hr",
    "references": "No Nos Nr Art art Arts arts Abs Ziff Bl Rn Urt Beschl Vgl vgl Az ss Sec sec Fig fig Figs col cols para paras par "
    "Ch ch pp vol Vol ed eds App Ct Cir Rep Harb Tid Bull Rec rec pt pts al env cf Cf cfr Cfr viz ca approx Approx vs bzgl bzw "
    "núm núms pág págs apdo doc incl fs sig sigs vid EE Str str",
    "references in Cyrillic": "ст см См ср Ср стр гл пп п рис Сб сб реш пост др тыс млн млрд ул просп пер пл обл кв им проф акад гр",
    "before a further part of the name": "Bros u",
}
# What ends in one letter and yet may end a sentence: p.m., т. д., кв. м., S.A., S.L., e. V., a year's г.
ENDS_ALL_THE_SAME = r"[aApP]\.[mM]|т\. ?[дп]|кв\. ?м|S\. ?[AL]|e\. ?V|\d г"
# Words that begin a sentence, after initials.
STARTERS = (
    "The This That These Those We It He She They In On At As If But And No Nor By For To What Why Who When Where Whether Did Does Under Section "
    "Der Die Das Ein Eine Es Er Sie Wir Im Am Nach Auch Hat Dem Den "
    "Le La Les Un Une Il Elle Nous Par Tel Sur Aux Attendu "
    "El Los Las Una No Según Consta Así Se"
).split()
# Words before a day or number whose full stop makes it an ordinal.
ORDINAL_BEFORE = "Am am Der der Dem dem Den den Des des Vom vom Zum zum Bis bis Im im Das das Die die Ab ab Seit seit"

# Company forms, and what goes on with the same name behind them.
COMPANY = "Co Corp Inc Ltd Cie"
COMPANY_GOES_ON = "Ltd KG Inc Jr Sr KGaA OHG"

# Blanks, and those within a line. Single signs of the lower range make a bit set; those above stand behind one comparison.
_B = r"\t\n\x0B\f\r \x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
_L = r"\t\x0B\f\r \x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u202F\u205F\u3000]]"



def _signs(latin: str, others: str, negated: bool = False) -> str:
    """A class of signs, those from U+0600 on behind one comparison: the engine asks for the members of a class one by one, and most letters are none of them."""
    inner = "".join("\\" + c if c in '()[]"' else c for c in latin)
    return f"[{'^' * negated}{inner}[\\u0600-\\uFFFF&&[{others}]]]"


# Marks that open and that close a quotation or bracket; apostrophes are left out, they stand in words.
_OPENING, _CLOSING = "“«‹「『（【《([", "”»›」』）】》)]"


def _words(*lists: str) -> str:
    return "|".join(sorted({w for text in lists for w in text.split()}, key=lambda w: (-len(w), w)))


def _choice(words: Iterable[str]) -> str:
    """One of the words, told apart by their first letter first."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(words):
        by_first.setdefault(word[0], []).append(re.escape(word[1:]))
    return "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in by_first.items())


def _behind(words: Iterable[str]) -> str:
    """Looks back for one of the words, length by length, so that each is tried at one place."""
    by_length: dict[int, set[str]] = {}
    for word in words:
        by_length.setdefault(len(word.encode("utf-16-le")) // 2, set()).add(word)
    return "|".join(rf"(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_choice(some)})\.{END})" for _, some in sorted(by_length.items()))


def _marks(signs: str, more: str = "", negated: bool = False) -> str:
    return _signs("".join(c for c in signs if c < "\u0600"), "".join(c for c in signs if c >= "\u0600") + more, negated)


#: The two sides of quotations and brackets, with the placeholders of those that have no side of their own.
_O, _C = _marks(_OPENING + OPEN), _marks(_CLOSING + CLOSE)
#: Quotations that open low and close with a mark that opens others, and those in straight marks.
LOW = rf"„([^„“”{END}]*+)[“”]"
STRAIGHT = rf'"([^"{END}]*+)"'
_FREE = _marks(_OPENING + _CLOSING + OPEN + CLOSE + END, negated=True) + "*+"
_CALM = _marks(".!?…।؟。！？｡" + _OPENING + _CLOSING + OPEN + CLOSE + END, negated=True) + "*+"
#: Terminators inside a quotation or bracket that is closed in the same block (with whole pairs in it at most), one after the other; not the one right before its end.
INSIDE = (
    rf"((?:\G(?<!^)|{_O}(?={_FREE}(?:{_O}{_FREE}{_C}{_FREE})*+{_C})){_CALM}(?:{_O}{_CALM}{_C}{_CALM})*+)"
    rf"{_marks('.!?…।؟。！？｡')}(?![ \xA0\u202F]?{_C})"
)
LEFT_OUT = rf"…(?={_C})"
#: What may stand between a terminator and the blank behind it.
_CLOSERS = rf"(?:[ \xA0\u202F]?{_C}|[’'])"
#: Stops inside decimals, dates, addresses and what is joined by full stops.
JOINED = r"(?=[\p{L}\p{N}/])(?<=[\p{L}\p{N}/][.?!])"
SEED = frozenset(w for text in ABBREVIATIONS.values() for w in text.split())


_NEXT = rf"[\p{{Lu}}\p{{Lt}}\p{{N}}¿¡§_#*\"„█▇■{_O}]"
#: A number, letter or Roman number that begins a block; it is looked for in the first signs alone.
NUMBER = rf"^([{_B}]{{0,8}}{_O}?(?:\d{{1,4}}|[IVXLC]{{1,5}}|\p{{L}}))\.(?=[{_B}])"
NUMBER_WITHIN = 16


#: Ends by script; each match is followed by END. First any script: something that can begin a sentence follows, or a letter of a
#: script without capitals, before which a question at the end of a quotation does not end the sentence around it.
def common(signs: str) -> str:
    return rf"{signs}++(?:{_CLOSERS}*+(?=[{_B}]++(?![a-z,;]){_NEXT})|(?:(?<=\.){_CLOSERS}*+)?(?=[{_B}]++(?![ -~])\p{{Lo}}))"


#: The usual terminators are looked for alone where the others are not there: a class of ASCII is a bit set.
COMMON, COMMON_ALL = common("[.!?]"), common(_signs(".!?", "…؟"))
INDIC = rf"[।॥]++{_CLOSERS}*+|[!?]++(?<=[\u0900-\u0DFF][!?]{{1,3}})(?=[{_B}]++\p{{L}})"
#: Chinese and Japanese: no blank follows; a quotation goes on into a particle, a comma or, after a question, anything.
CHINESE = rf"[。｡！？]++(?!{_C}|[。｡！？])|[。｡]++{_C}++(?![\u3040-\u309F，、,：；:;]|{_C})"
_SOUTHEAST = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF"
#: Thai, Lao, Burmese, Khmer: a blank between two words of the script, not beside the word 'with' of a party line.
THAI = rf"[{_SOUTHEAST}](?<!กับ)(?=[{_B}]++(?!กับ)[{_SOUTHEAST}])"


def no_end(learnt: Iterable[str] = ()) -> str:
    """The pattern of stops that end nothing: in decimals and addresses, and, where COMMON has set an END, of abbreviations, initials and ordinals."""
    return (
        rf"[.?!](?:{JOINED}|(?<=\.){END}(?:(?<=[\p{{L}}\p{{M}}]\.{END})(?:"
        # abbreviations and what is joined by full stops (L.J., z.B., U.K.)
        rf"{_behind(SEED | set(learnt))}"
        rf"|(?<=[ऀ-෿]\.{END})"
        # one letter: initials and the like. Not the last of: p.m., т. д., кв. м., S.A., S.L., e. V., a year's г.
        rf"|(?<=(?:(?<![\p{{L}}\p{{M}}\p{{N}}])|[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF])\p{{L}}\.{END})(?<!(?:{ENDS_ALL_THE_SAME})\.{END})"
        rf"(?![{_B}]++(?:{'|'.join(STARTERS)})(?![\p{{L}}\p{{M}}]))"
        # a year is no end of its sentence before a capital
        rf"|(?<=(?:^|[^\p{{L}}])[Вв] \d{{4}} г\.{END})"
        # company forms with more to come
        rf"|(?<=(?<![\p{{L}}\p{{M}}])(?:{_words(COMPANY)})\.{END})(?=[{_B}]++(?:{_words(COMPANY_GOES_ON)})(?![\p{{L}}\p{{M}}]))"
        r")"
        # ordinals before a capital
        rf"|(?<=\p{{N}}\.{END})(?<=(?<![\p{{L}}\p{{M}}])(?:{_words(ORDINAL_BEFORE)})[{_B}]\d{{1,2}}\.{END})(?=[{_B}]++\p{{Lu}})"
        rf"|(?<=\./\.{END})"
        r"))"
    )


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; a plain column would be worked out again for each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: What begins a block: a line break followed by a blank line.
BLANK_LINE = rf"\n(?=[{_L}]*+\n)"
#: Terminators beyond ASCII; a block without any terminator has one unit.
_OWN = "…।॥؟。！？｡"


def _replaced(pattern: str, by: str, there=None):
    """A step: regexp_replace where ``there`` holds; other blocks are spared the pass."""
    if there is None:
        return lambda t: F.regexp_replace(t, pattern, by)
    return lambda t: F.when(there(t), F.regexp_replace(t, pattern, by)).otherwise(t)


def _any(*signs: str):
    def there(t: Column) -> Column:
        out = F.lit(False)
        for sign in signs:
            out = out | t.contains(sign)
        return out

    return there


def _wide(t: Column) -> Column:
    """Whether a block may have terminators of other scripts, which take three bytes each, or two for the shortest."""
    return F.octet_length(t) > F.length(t)


def _has_terminator(t: Column) -> Column:
    """Whether a block has any sign that may end a unit; the usual ones are looked for first."""
    return _any(".", "?", "!")(t) | (_wide(t) & (_any(*_OWN)(t) | t.rlike(rf"[\u0E00-\u17FF&&[{_SOUTHEAST}]]")))


def steps(learnt: Iterable[str] = (), wide: Column | bool = True) -> list:
    """What a block goes through, one after the other. ``wide``: whether it has more than ASCII."""
    quotations = [
        _replaced(LOW, f"{OPEN}$1{CLOSE}", _any("„")),
        _replaced(STRAIGHT, f"{OPEN}$1{CLOSE}", _any('"')),
        _replaced(INSIDE, f"$1{STOP}"),
        _replaced(LEFT_OUT, STOP, _any("…")),
    ]
    scripts = [_replaced(INDIC, f"$0{END}"), _replaced(CHINESE, f"$0{END}"), _replaced(THAI, f"$0{END}")]
    has = wide if isinstance(wide, Column) else F.lit(wide)
    other = lambda t: has & (_any("।", "॥", "。", "｡", "！", "？")(t) | t.rlike(rf"[\u0E00-\u17FF&&[{_SOUTHEAST}]]"))
    # few projections, so that the code made of them is small enough to be compiled
    return [
        _replaced(NUMBER, f"$1{STOP}", lambda t: F.instr(t, ".").between(2, NUMBER_WITHIN)),
        lambda t: F.when(_any("„", '"', *_OPENING)(t), reduce(_let, quotations, t)).otherwise(t),
        lambda t: F.when(_any("…", "؟")(t), F.regexp_replace(t, COMMON_ALL, f"$0{END}")).otherwise(F.regexp_replace(t, COMMON, f"$0{END}")),
        _replaced(no_end(learnt), STOP),
        lambda t: F.when(other(t), reduce(_let, scripts, t)).otherwise(t),
    ]


def marked(block: Column, learnt: Iterable[str] = ()) -> Column:
    """A block, with placeholders for what ends nothing and END after each unit or more often. Private-use characters of the block itself must have been replaced."""
    return reduce(_let, steps(learnt), block)


#: The characters of _B.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Lengths that are summed at once; more of them take two levels, so that the work stays proportional to the text.
CHUNK = 64


def blocks(text: Column) -> Column:
    """The blocks of a text; private-use characters that serve as placeholders here are replaced."""
    clean = F.when(_any(*MASKS)(text), F.translate(text, MASKS, "\uFFFD" * len(MASKS))).otherwise(text)
    return F.split(clean, BLANK_LINE)


def _bare(block: Column) -> Column:
    """Without the blanks at its end."""
    return F.when(F.right(block, F.lit(1)).isin(*BLANKS), F.rtrim(block, F.lit(BLANKS))).otherwise(block)


def _ends(begin: Column, marked_block: Column) -> Column:
    """Where the units of a marked block end."""
    lengths = F.filter(F.transform(F.split(marked_block, END), F.length), lambda n: n > 0)
    return _let(lengths, lambda n: F.slice(_sums(begin, n), F.lit(2), F.size(n)))


def ends(text: Column, learnt: Iterable[str] = ()) -> Column:
    """The positions (code points from the start) where the units of a text end; empty for texts without any sign but blanks, null for null."""
    learnt = tuple(learnt)

    def block_ends(begin: Column, block: Column) -> Column:
        return _let(_bare(block), lambda b: (
            F.when(b == "", F.array().cast("array<int>")).when(_has_terminator(b), _ends(begin, marked(b, learnt))).otherwise(F.array(begin + F.length(b)))
        ))

    return F.when(text.isNotNull(), _let(blocks(text), lambda bs: F.flatten(F.zip_with(_begins(bs), bs, block_ends))))


def _begins(every: Column) -> Column:
    return F.slice(_sums(F.lit(0), F.transform(every, lambda b: F.length(b) + 1)), F.lit(1), F.size(every))


def _running(start: Column, numbers: Column) -> Column:
    """start, and the sums with each number added; one more than there are numbers."""
    return F.aggregate(numbers, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _sums(start: Column, numbers: Column) -> Column:
    """As _running; long lists are summed within chunks, from where the chunks begin."""

    def chunked(n: Column) -> Column:
        last = F.floor((F.size(n) - 1) / F.lit(CHUNK)).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(n, c * CHUNK + 1, F.lit(CHUNK))), lambda chunks: summed(chunks))

    def summed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        inner = lambda begins: F.flatten(F.zip_with(chunks, F.slice(begins, F.lit(2), F.size(chunks)), lambda c, end: F.slice(
            _running(end - F.aggregate(c, F.lit(0), lambda a, x: a + x), c), F.lit(2), F.size(c))))
        return F.concat(F.array(start), _let(_running(start, totals), inner))

    return _let(numbers, lambda n: F.when(F.size(n) <= CHUNK, _running(start, n)).otherwise(chunked(n)))


#: A word that often stands before a stop: at least this share of all stops, and this often.
LEAST_SHARE, LEAST_TIMES = 1e-4, 20
#: An abbreviation: so many of its stops have a small letter or number behind them, and no more end a block.
GOES_ON, AT_END = 0.25, 0.005
LONGEST = 8


def learn_abbreviations(frame: DataFrame, text: str) -> list[str]:
    """Words whose full stop ends no sentence, from all texts.

    Counted are the words before a full stop and a blank; a word is learnt when
    it makes up LEAST_SHARE of all these stops (so there are 1/LEAST_SHARE of
    them at most), GOES_ON of its stops are followed by a small letter or a
    number and no more than AT_END of them end a block. Counts are combined
    before the shuffle, one row a distinct word of up to LONGEST signs.
    """
    pieces = frame.filter(F.col(f"`{text}`").contains(".")).select(F.split(F.col(f"`{text}`"), rf"\.(?=[{_B}]|$)").alias("p"))
    # a few signs tell what follows: nothing or a blank line, a small letter or a number, or something else
    after = lambda x: F.when(x.rlike(rf"^[{_B}]*$|\n[{_L}]*\n"), 2).when(x.rlike(rf"^[{_B}]+[\p{{Ll}}\p{{N}}]"), 1).otherwise(0)
    # one short string for each stop: the word before it and what follows; long words are counted without their letters
    short = lambda x: F.when(F.octet_length(x) <= 4 * LONGEST, x).otherwise("")
    pairs = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.concat(
        F.substring(b, 1, 3), F.lit(STOP), short(F.substring_index(a, " ", -1))))
    found = pieces.filter(F.size("p") > 1).select(F.explode(pairs).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    found = found.select(F.substring_index(F.substring_index("s", STOP, -1), "\n", -1).alias("word"), F.substring_index("s", STOP, 1).alias("then"), "m")
    m, next_ = F.col("m"), after(F.col("then"))
    counts = found.groupBy("word").agg(F.sum("m").alias("n"), F.sum(F.when(next_ == 1, m).otherwise(0)).alias("on"), F.sum(F.when(next_ == 2, m).otherwise(0)).alias("end"))
    counts = stored(counts, "stops")
    least = max(LEAST_TIMES, LEAST_SHARE * (counts.agg(F.sum("n")).first()[0] or 0))
    sure = counts.filter((F.col("n") >= least) & (F.col("on") >= GOES_ON * F.col("n")) & (F.col("end") <= AT_END * F.col("n")))
    # single letters have a rule of their own
    return sorted(r["word"] for r in sure.filter(F.col("word").rlike(r"^[\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*$") & F.length("word").between(2, LONGEST)).select("word").collect())


def sentence_ends(frame: DataFrame, key: str, text: str, learnt: Iterable[str] | None = None) -> DataFrame:
    """(key, end_pos): one row for each unit of each text, without a shuffle of texts.

    ``learnt``: abbreviations beside the seed; None learns them from ``frame``
    in a pass of its own. Null, empty and blank texts give no row. Repeated
    rows give their units each time. A block (what stands between blank lines)
    without a sentence end is one unit.
    """
    learnt = learn_abbreviations(frame, text) if learnt is None else learnt
    cut = frame.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), blocks(F.col(f"`{text}`")).alias("bs"))
    rows = cut.select("k", F.inline(F.zip_with(_begins(F.col("bs")), "bs", lambda at, b: F.struct(at.alias("at"), b.alias("b")))))
    rows = rows.select("k", "at", _bare(F.col("b")).alias("b")).filter("b <> ''")
    rows = rows.select("k", "at", "b", _has_terminator(F.col("b")).alias("more"), _wide(F.col("b")).alias("wide"))
    # a projection for each step: the expressions run compiled, and none is worked out twice
    for step in steps(tuple(learnt), F.col("wide")):
        rows = rows.select("k", "at", F.when(F.col("more"), step(F.col("b"))).otherwise(F.col("b")).alias("b"), "more", "wide")
    # most blocks have one unit: no END, or one at the very end
    rows = rows.select("k", "at", "b", F.instr("b", END).alias("first"), F.length("b").alias("n"))
    found = F.when(F.col("first") == 0, F.array(F.col("at") + F.col("n"))).when(F.col("first") == F.col("n"), F.array(F.col("at") + F.col("n") - 1)).otherwise(_ends(F.col("at"), F.col("b")))
    return rows.select(F.col("k").alias(key), F.explode(found).alias("end_pos"))


def sentences(frame: DataFrame, key: str, text: str, learnt: Iterable[str] | None = None) -> DataFrame:
    """(key, unit_no, end_pos, unit): the units with their text, numbered from 1, without the blanks around them."""
    learnt = learn_abbreviations(frame, text) if learnt is None else learnt
    t = F.col("t")
    found = frame.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("t"), ends(F.col(f"`{text}`"), learnt).alias("e"))
    parts = found.select(key, "t", "e", F.posexplode("e").alias("i", "end_pos"))
    begin = F.when(F.col("i") > 0, F.try_element_at("e", F.col("i"))).otherwise(0)
    unit = F.regexp_replace(F.substring(t, begin + 1, F.col("end_pos") - begin), rf"^[{_B}]+", "")
    return parts.select(key, (F.col("i") + 1).alias("unit_no"), "end_pos", unit.alias("unit"))
