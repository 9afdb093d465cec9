"""Variant spellings of names of persons and bodies, attributed by a noisy channel.

Every distinct spelling is read as a key part (surname, place of a body), a
list of further parts and life dates. Spellings that can be canonical, being
frequent and complete, found the entities of a block (one key part, one
initial). Each other spelling goes to the entity of the greatest posterior:
the frequency of the entity times the likelihood of the typos, abbreviations,
nicknames, dropped parts and dates between the two; or it founds an entity of
its own if none is likely enough. Key parts with a typo are placed in the
blocks of the more frequent key parts one edit away as well (of two equally
frequent ones, the first in order), and the best place wins.

Work is done on distinct spellings with their frequency, so an entity that
stands on a third of all records costs one row a spelling. Nicknames are
learnt: pairs of first names that stand with the same surname and dates more
often than chance would give.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import forms
from heddle.session import stored

PERSON, BODY = "person", "body"
# Words about a person's part in a work, which are no part of the name.
RELATORS = {"ed", "eds", "editor", "author", "auth", "comp", "tr", "trans", "translator", "ill", "illustrator", "joint", "hrsg"}
# Titles before a name.
TITLES = {"prof", "professor", "sir", "dame", "lady", "lord", "rev", "dr", "mr", "mrs", "ms", "fr", "sr", "hon", "capt", "col", "gen", "saint", "st", "jr"}
# Words that bodies' abbreviations leave out.
SMALL = {"of", "for", "on", "and", "the", "in", "to", "at", "de", "la", "und", "et", "der", "für", "fur", "&"}
# Letters without a decomposition.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})

#: Log likelihoods of the channel.
INITIAL, NICKNAME, ABBREVIATED, TYPO, DROPPED, UNDATED, KEY_TYPO, ACRONYM = -1.0, -1.5, -0.5, -3.0, -0.7, -0.5, -3.0, -1.0
#: Dates that agree are no accident.
SAME_BIRTH, SAME_DATES = 2.5, 4.0
#: A first name that is none of these but begins alike, beside the same surname and full dates; with a typo in the surname, one with two typos.
ODD, TWO_TYPOS = -5.0, -4.0
#: Log score below which a spelling is an entity of its own.
ALONE = -4.0


def _repair(text: str) -> str:
    """UTF-8 that was read as a code page, read rightly, where that is possible without doubt."""
    if text.isascii():
        return text
    words = []
    for word in text.split(" "):
        for page in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
            try:
                once = word.encode(page).decode("utf-8")
            except UnicodeError:
                continue
            word = once if once.isascii() or once == word else _repair(once)
            break
        words.append(word)
    return " ".join(words)


def _folder():
    a, b, invisible, several = forms.tables()
    table = {**dict(zip(map(ord, a), b)), **{ord(c): None for c in invisible}, **{ord(k): v for k, v in several.items()}}

    def fold(text: str) -> str:
        text = _repair(text).translate(table)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
        return text.casefold().translate(PLAIN)

    return fold


_TOKEN = re.compile(r"[^\W\d_]+\.?")
_YEARS = re.compile(r"(?:b\.?\s*)?(\d{4})\s*(?:-\s*(\d{4})?)?")


def years(dates: str | None) -> tuple[str | None, str | None]:
    """Birth and death from a statement of life dates."""
    m = _YEARS.search(dates or "")
    return (m[1], m[2]) if m else (None, None)


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.replace("'", "").replace("-", ""))


def readings(kind: str, folded: str, raw: str) -> list[tuple[str, list[str], float]]:
    """(key part, other parts, certainty) of the ways to read a folded name."""
    if kind == PERSON:
        own = lambda text: [t for t in _tokens(text) if t.rstrip(".") not in RELATORS and t.rstrip(".") not in TITLES]
        head, comma, rest = folded.partition(",")
        if comma and own(head) and own(rest):
            return [("".join(t.rstrip(".") for t in own(head)), own(rest), 1.0)]
        parts = own(folded)
        if not parts:
            return []
        if len(parts) == 1:
            return [(parts[0].rstrip("."), [], 1.0)]
        ways = []
        if len(parts[-1].rstrip(".")) > 2:
            ways.append((parts[-1].rstrip("."), parts[:-1], 0.6))
        if len(parts[0].rstrip(".")) > 2:
            ways.append((parts[0].rstrip("."), parts[1:], 0.3))
        return ways
    text = folded.strip(" .,;")
    m = re.match(r"^(.*)\(([^()]*)\)\W*$", text)
    if m and _tokens(m[2]):
        return [("".join(_tokens(m[2])), _tokens(m[1]), 1.0)]
    parts = _tokens(text)
    if parts[:1] == ["the"]:
        parts = parts[1:]
    if len(parts) > 2 and parts[-2] == "at":
        return [(parts[-1].rstrip("."), parts[:-2], 1.0)]
    if len(parts) < 2:
        return [(parts[0].rstrip("."), [], 1.0)] if parts else []
    head, comma, tail = text.rpartition(",")
    if comma and len(_tokens(tail)) == 1:
        return [(_tokens(tail)[0].rstrip("."), _tokens(head), 1.0)]
    content = [t for t in parts if t not in SMALL]
    last, first = parts[-1].rstrip("."), parts[0].rstrip(".")
    if len(parts) == 2 and raw.split()[0].isupper() and len(raw.split()[0]) <= 6:
        return [(last, [first + "*"], 1.0)]  # an acronym
    ways = []
    if len(parts) > 2 and parts[-2] == "of" or len(content) == 2:
        ways.append((last, parts[:-1], 0.7))
    ways.append((first, parts[1:], 0.6))
    return ways


def content(kind: str, parts: list[str]) -> list[str]:
    return [p for p in parts if p.rstrip(".") not in SMALL] if kind == BODY else parts


def _near(a: str, b: str) -> bool:
    """At most one letter more, less or other, or two neighbours exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and len(y) > 1 and x[2:] == y[2:])


def _distance(a: str, b: str) -> int:
    """Letters to insert, drop or change."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def _part(v: str, c: str, nicknames: dict[str, set[str]], odd: float | None = None) -> float | None:
    """Log likelihood of writing part c as v; None if that does not happen. odd: of parts that only begin alike, where other evidence allows for them."""
    a, b = v.rstrip("."), c.rstrip(".")
    if a == b:
        return 0.0
    if not a or not b:
        return None
    if len(a) == 1 or len(b) == 1:
        if a[0] == b[0]:
            return INITIAL
        letter, name = (a, b) if len(a) == 1 else (b, a)
        return INITIAL + NICKNAME if any(full[0] == letter for full in nicknames.get(name, ())) else None
    if b in nicknames.get(a, ()) or a in nicknames.get(b, ()):
        return NICKNAME
    if v.endswith(".") or c.endswith("."):
        short, long = (a, b) if len(a) < len(b) else (b, a)
        rest = iter(long)
        if short[0] == long[0] and all(ch in rest for ch in short):
            return ABBREVIATED
    if min(len(a), len(b)) > 2:
        if _near(a, b):
            return TYPO
        if odd is not None and a[0] == b[0] and (odd == ODD or _distance(a, b) <= 2):
            return odd
    return None


def parts_cost(kind: str, v: list[str], c: list[str], nicknames: dict[str, set[str]], odd: float | None = None) -> float | None:
    """Log likelihood of the parts of a variant, given those of a canonical form: in order, some dropped on the one side or the other."""
    if kind == BODY and (len(v) == 1 and v[0].endswith("*") or len(c) == 1 and c[0].endswith("*")):
        x, y = (v, c) if v and v[0].endswith("*") else (c, v)
        other = y[0].rstrip("*") if len(y) == 1 and y[0].endswith("*") else "".join(p[0] for p in y)
        return ACRONYM if x[0].rstrip("*") == other else None
    if not v or not c:
        return None if kind == BODY else DROPPED * max(len(v), len(c)) - 1
    short, long = (v, c) if len(v) <= len(c) else (c, v)
    if kind == BODY and len(short) != len(long):
        return None
    total, at = 0.0, 0
    for i, p in enumerate(short):
        best = None
        for j in range(at, len(long) - (len(short) - i) + 1):
            if i == 0 and j > 0:
                break  # the first name stays first
            cost = _part(p, long[j], nicknames, odd)
            if cost is not None:
                best = (cost, j)
                break
        if best is None:
            return None
        total += best[0]
        at = best[1] + 1
    return total + DROPPED * (len(long) - len(short))


def dates_cost(v: tuple, c: tuple) -> float | None:
    """Log likelihood of the dates; None for dates of another person."""
    if v[0] and c[0] and v[0] != c[0] or v[1] and c[1] and v[1] != c[1]:
        return None
    if v[0] and c[0]:
        return SAME_DATES if v[1] and c[1] else SAME_BIRTH
    return UNDATED


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = _folder()
    for batch in batches:
        rows = []
        for form, kind, name, dates, n in zip(*(c.to_pylist() for c in batch.columns)):
            birth, death = years(dates) if kind == PERSON else (None, None)
            for key, parts, sure in readings(kind, fold(name), name):
                rows.append((form, kind, n, key, content(kind, parts), birth, death, sure))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.float64()))],
                names=["form", "kind", "n", "key", "parts", "birth", "death", "sure"],
            )


_READ = "form long, kind string, n long, key string, parts array<string>, birth string, death string, sure double"


def learn_nicknames(read: DataFrame, least: int = 2, lift: float = 5.0) -> dict[str, set[str]]:
    """{name: names it stands for}: first names found with the same surname and dates at least ``least`` times, and ``lift`` times as often as chance would give.

    Chance: all pairs found under one surname and dates, dealt to the names by
    the number of persons each stands with. The less frequent name stands for
    the more frequent one; two equally frequent ones for each other. The pairs
    are made within one person's spellings and summed before they come to the
    driver; their number is bounded by the stock of first names.
    """
    one = read.filter("kind = 'person' AND sure = 1 AND birth IS NOT NULL AND size(parts) > 0").select(
        "key", "birth", F.coalesce("death", F.lit("")).alias("death"), F.regexp_replace(F.col("parts")[0], r"\.$", "").alias("g"), "n"
    ).filter("length(g) > 2").groupBy("key", "birth", "death", "g").agg(F.sum("n").alias("n"))
    stock = one.groupBy("g").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("persons"))
    rare = one.join(stock, "g")
    other = rare.select("key", "birth", "death", F.col("g").alias("h"), F.col("all").alias("all_h"), F.col("persons").alias("persons_h"))
    pairs = stored(
        rare.join(other, ["key", "birth", "death"]).filter("all <= all_h AND g <> h AND levenshtein(g, h) > 1 AND array_sort(split(g, '')) <> array_sort(split(h, ''))")
        .groupBy("g", "h", "all", "all_h", "persons", "persons_h").agg(F.count(F.lit(1)).alias("times")), "pairs"
    )
    # equally frequent names stand in both directions
    met = pairs.agg(F.sum(F.when(F.expr("all = all_h"), F.col("times") / 2).otherwise(F.col("times"))).alias("met"))
    every = stock.agg(F.sum("persons").cast("double").alias("every"))
    chance = F.expr("2 * met * (persons / every) * (persons_h / every)")
    kept = pairs.filter(F.col("times") >= least).crossJoin(F.broadcast(met)).crossJoin(F.broadcast(every)).filter(F.col("times") >= lift * chance)
    out: dict[str, set[str]] = {}
    for r in kept.select("g", "h").collect():
        out.setdefault(r["g"], set()).add(r["h"])
    return out


def _signature(nicknames: dict[str, set[str]]):
    """The initials under which a reading is filed: of the first name, and of what it may be a nickname of; of the words of a body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, parts = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            signs = []
            for kind, p in zip(kinds, parts):
                if kind == BODY:
                    signs.append([p[0].rstrip("*")] if len(p) == 1 and p[0].endswith("*") else ["".join(x[0] for x in p)])
                else:
                    first = p[0].rstrip(".") if p else ""
                    signs.append(sorted({first[:1], *(h[:1] for h in nicknames.get(first, ()))}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.list_(pa.string()))], names=[*batch.schema.names, "signs"])

    return run


def _order(r: tuple) -> tuple:
    """The order in which the spellings of a block come: own ones before moved ones, complete and frequent ones first."""
    form, kind, n, parts, birth, death, sure, typo, brief = r
    return typo, birth is None, -sum(len(p.rstrip(".")) > 1 and not p.endswith("*") for p in parts), -sum(not p.endswith(".") for p in parts), -n, -sure, form


def _block(rows: list[tuple], nicknames: dict[str, set[str]]) -> Iterator[tuple[int, int, float]]:
    """(form, entity, score) of the spellings of a block."""
    entities: list[dict] = []
    by_birth: dict[str | None, list[dict]] = {}
    for form, kind, n, parts, birth, death, sure, typo, brief in sorted(rows, key=_order):
        dates = (birth, death)
        # dated spellings meet their own year and the undated entities only
        near = entities if birth is None else [*by_birth.get(birth, ()), *by_birth.get(None, ())]
        best, at = ALONE, None
        for e in near:
            d = dates_cost(dates, e["dates"])
            if d is None or brief and d < SAME_DATES:
                continue
            p = parts_cost(kind, parts, e["parts"], nicknames, None if d < SAME_DATES else TWO_TYPOS if typo else ODD)
            if p is None:
                continue
            score = math.log(e["n"] + 0.5) + d + p
            if score > best:
                best, at = score, e
        penalty = math.log(sure) + (KEY_TYPO if typo else 0.0)
        if at is not None and best + penalty > ALONE:
            if not typo:
                at["n"] += n
                if at["dates"][0] == birth and not at["dates"][1]:
                    at["dates"] = (at["dates"][0], death)
            yield form, at["form"], best + penalty
        elif not typo:
            e = {"form": form, "dates": dates, "parts": parts, "n": n}
            entities.append(e)
            by_birth.setdefault(birth, []).append(e)
            yield form, form, ALONE + penalty


def _attribute(nicknames: dict[str, set[str]]):
    """The blocks of a partition that is sorted by block, one after the other; a block may reach over several batches."""
    out = pa.schema([("form", pa.int64()), ("entity", pa.int64()), ("score", pa.float64())])

    def made(result: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*result), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, result = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:4]), zip(columns[4], columns[0], *columns[5:])):
                if key != block:
                    result += _block(rows, nicknames)
                    block, rows = key, []
                    if len(result) > 20_000:
                        yield made(result)
                        result = []
                rows.append(row)
        result += _block(rows, nicknames)
        if result:
            yield made(result)

    return run


def _neighbours(read: DataFrame) -> DataFrame:
    """(kind, key, other, brief): key parts and the more frequent ones one edit away, found by the keys they share when a letter is left out.

    Equally frequent ones are taken in the order of their letters, so every close pair stands in one direction. Weights are whole tenths, for sums of fractions would depend on their order.
    brief: one of the two has less than four letters, which are close to many others by chance; such a pair links spellings with the same full dates only.
    """
    keys = read.groupBy("kind", "key").agg(F.sum(F.col("n") * F.round(F.col("sure") * 10).cast("long")).alias("w")).filter("length(key) >= 2")
    cuts = keys.select(
        "kind", "key", "w",
        F.explode(F.array_distinct(F.concat(F.array("key"), F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(
            F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.length("key"))))))).alias("cut"),
    )
    other = cuts.select("kind", "cut", F.col("key").alias("other"), F.col("w").alias("w_other"))
    close = (F.levenshtein("key", "other") <= 1) | (
        (F.length("key") == F.length("other")) & (F.levenshtein("key", "other") == 2) & (F.array_sort(F.split("key", "")) == F.array_sort(F.split("other", "")))
    )
    found = cuts.join(other, ["kind", "cut"]).filter("w < w_other OR w = w_other AND key > other").filter(close)
    return found.select("kind", "key", "other", F.expr("least(length(key), length(other)) < 4").alias("brief")).distinct()


#: Blocks of more spellings are cut by year of birth.
MOST_IN_BLOCK = 2_000
BLOCK = ["kind", "key", "sign", "room"]


def _rooms(placed: DataFrame, most: int) -> DataFrame:
    """Adds the room of each spelling: '' in blocks of up to ``most`` spellings; larger ones have a room for each year of birth, where dated spellings meet those of their year, and undated ones, which may be anybody, stand in all of them and in one of their own."""
    sizes = placed.groupBy("kind", "key", "sign").agg(F.count(F.lit(1)).alias("size"), F.array_append(F.collect_set("birth"), "").alias("years")).filter(F.col("size") > most)
    sizes = stored(sizes.drop("size"), "blocks")
    if sizes.isEmpty():
        return placed.withColumn("room", F.lit(""))
    known = placed.join(sizes, ["kind", "key", "sign"], "left")
    where = F.when(F.col("years").isNull(), F.array(F.lit(""))).when(F.col("birth").isNotNull(), F.array("birth")).otherwise(F.col("years"))
    return known.withColumn("room", F.explode(where)).drop("years")


def roots(best: DataFrame) -> DataFrame:
    """(form, entity) with every chain followed to its end: each entity is its own. Spellings that were attributed in a circle have the least of the circle as entity."""
    best = stored(best, "entities")
    left = None
    while True:
        ends = best.filter("form = entity").select("entity")
        loose = best.filter("form <> entity").join(ends, "entity", "left_anti").count()
        if not loose:
            return best
        if loose == left:
            break
        left = loose
        best = stored(best.join(best.select(F.col("form").alias("entity"), F.col("entity").alias("next")), "entity", "left").select("form", F.coalesce("next", "entity").alias("entity")), "entities")
    # what is left runs into circles: far is a place on the circle after enough doublings, low the least of what was passed from there on
    step = best.filter("form <> entity").join(best.filter("form = entity").select("entity"), "entity", "left_anti").select("form", F.col("entity").alias("far"), F.least("form", "entity").alias("low"))
    same, before = 0, None
    while same < 2:
        step = stored(step, "circles")
        on = step.select(F.col("form").alias("far"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        step = stored(step.join(on, "far").select("form", F.col("far2").alias("far"), F.least("low", "low2").alias("low")), "circles")
        label = step.select("form", "far").join(step.select(F.col("form").alias("far"), F.col("low").alias("entity")), "far").select("form", "entity")
        now = label.agg(F.sum(F.xxhash64("form", "entity").cast("decimal(38,0)"))).first()[0]
        same, before = (same + 1 if now == before else 0), now
    label = stored(label, "circles")
    fixed = best.join(label.withColumnRenamed("entity", "circle"), "form", "left").select("form", F.coalesce("circle", "entity").alias("entity"))
    return roots(fixed)


def attribute(headings: DataFrame, *, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """(kind, name, dates, entity): each distinct spelling with its entity, named by the spelling that founded it.

    headings: (kind, name, dates) with one row for each occurrence; null and
    blank names are left out. Equal entity means the same person or body. A
    task holds one block of spellings at a time; ``most_in_block`` is the size
    from which a block is cut by year of birth.
    """
    spelt = headings.filter("name IS NOT NULL AND trim(name) <> ''").groupBy("kind", "name", "dates").agg(F.count(F.lit(1)).alias("n"))
    spelt = stored(spelt.select(F.xxhash64("kind", "name", "dates").alias("form"), "kind", "name", "dates", "n"), "spellings")
    read = stored(spelt.mapInArrow(_parse, _READ), "readings")
    nicknames = learn_nicknames(read)
    signed = read.mapInArrow(_signature(nicknames), f"{_READ}, signs array<string>")
    own = signed.withColumns({"typo": F.lit(False), "brief": F.lit(False)})
    moved = signed.join(_neighbours(read), ["kind", "key"]).drop("key").withColumnRenamed("other", "key").withColumn("typo", F.lit(True))
    placed = stored(own.unionByName(moved).select("*", F.explode("signs").alias("sign")).drop("signs"), "blocks")
    rows = _rooms(placed, most_in_block).select(*BLOCK, "form", "n", "parts", "birth", "death", "sure", "typo", "brief")
    found = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_attribute(nicknames), "form long, entity long, score double")
    best = stored(found.groupBy("form").agg(F.max_by("entity", F.struct("score", "entity")).alias("entity")), "entities")
    # a founder may itself have been attributed elsewhere; of two spellings attributed to each other, the lesser is the entity
    on = best.select(F.col("form").alias("entity"), F.col("entity").alias("next"))
    back = F.when(F.col("next") == F.col("form"), F.least("form", "entity")).otherwise(F.col("entity"))
    return spelt.join(roots(best.join(on, "entity", "left").select("form", back.alias("entity"))), "form").select("kind", "name", "dates", "entity")


def bib_headings(bib: DataFrame) -> DataFrame:
    """(bib_id, field_no, kind, name, dates) of the headings of persons (100, 700) and bodies (110, 710)."""
    f = F.col("f")
    fields = bib.select("bib_id", F.posexplode("marc_record.datafield").alias("pos", "f")).filter(f["tag"].isin("100", "110", "700", "710"))

    def first(code):
        return F.try_element_at(F.filter(f["subfield"], lambda s: (s["code"] == code) & s["value"].isNotNull()), F.lit(1))["value"]

    return fields.select(
        "bib_id", (F.col("pos") + 1).alias("field_no"), f["tag"].alias("tag"),
        F.when(f["tag"].isin("100", "700"), PERSON).otherwise(BODY).alias("kind"),
        first("a").alias("name"), F.when(f["tag"].isin("100", "700"), first("d")).alias("dates"),
    )


def same_main_entry(bib: DataFrame) -> DataFrame:
    """(bib_id_a, bib_id_b), a < b: records whose first heading of tag 100 or 110 names one entity."""
    every = bib_headings(bib)
    entity = attribute(every.select("kind", "name", "dates"))
    main = every.filter(F.col("tag").isin("100", "110")).groupBy("bib_id").agg(F.min(F.struct("field_no", "kind", "name", "dates")).alias("h")).select("bib_id", "h.*")
    linked = main.join(entity.withColumns({"d": F.coalesce("dates", F.lit(""))}).drop("dates"), (main["kind"] == entity["kind"]) & (main["name"] == entity["name"]) & (F.coalesce(main["dates"], F.lit("")) == F.col("d")), "inner").select("bib_id", "entity")
    a, b = linked.withColumnRenamed("bib_id", "bib_id_a"), linked.withColumnRenamed("bib_id", "bib_id_b")
    return a.join(b, "entity").filter("bib_id_a < bib_id_b").select("bib_id_a", "bib_id_b")


