"""Text that was decoded with a wrong character encoding: found and restored.

A wrong decoding turns letters into other signs by a fixed rule: it is a
substitution cipher, whose symbols are single characters (one code page read as
another) or short sequences (UTF-8 read as a code page). Which swap a record's
text went through is not known. For each source of records, expectation
maximisation learns

* how often each swap occurs there, and
* which letter a damaged symbol stands for, where a byte was lost on the way,

against letter bigrams of the languages in the corpus itself: a word is taken
for garbled when its decipherment is more probable than the word as it stands.
The mapping is applied with ``translate``, after symbols of several characters
were folded to one.

All counts run over the whole corpus; what the driver holds is bounded by the
alphabets (bigrams, symbols), not by the number of records.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import stored

#: Read wrongly as the first what was written as the second.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866")
SINGLE = (("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"))
MARC8 = "marc8"
CLEAN = "clean"
LOST = "�"
# The marks that stand before their letter in the older bibliographic coding, by byte, and the accent they mean.
MARKS_BEFORE = {
    0xE0: "̉", 0xE1: "̀", 0xE2: "́", 0xE3: "̂", 0xE4: "̃", 0xE5: "̄", 0xE6: "̆", 0xE7: "̇",
    0xE8: "̈", 0xE9: "̌", 0xEA: "̊", 0xED: "̕", 0xEE: "̋", 0xF0: "̧", 0xF1: "̨", 0xF2: "̣",
}
# Letters of that coding with a byte of their own.
LETTERS_THERE = {0xA1: "Ł", 0xA2: "Ø", 0xA3: "Đ", 0xA4: "Þ", 0xA5: "Æ", 0xA6: "Œ", 0xB1: "ł", 0xB2: "ø", 0xB3: "đ", 0xB4: "þ", 0xB5: "æ", 0xB6: "œ", 0xB8: "ı", 0xBA: "ð"}
#: Taken off each bigram's count, so that a rare word does not vouch for itself.
DISCOUNT = 1
#: Probability from which the letter behind a lost byte is given.
SURE = 0.9
#: Words of a character that make it part of the alphabet, so that garbled text does not bring in signs of its own; a rarer letter is taken in where others of its block are that frequent.
LEAST_LETTER = 3
#: EM ends when no share of a swap, and no share of a letter behind a damaged symbol, moves by more than this.
SETTLED = 1e-3
#: How much all letters being alike behind a damaged symbol weighs against what is learnt.
EVEN = 0.3
#: A symbol learnt to stand for a letter: in so many words at least, and so much more probable (log, a word) than any sign that is no letter.
LEAST_WORDS, CLEARLY = 20, 2.0
LEARNT = "learnt"
#: Symbols are folded to these before translate.
FOLD = 0xF0000


def _char(page: str, byte: int) -> str:
    """How ``page`` shows a byte; bytes that it leaves open show as control characters of the same number."""
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte)


@dataclass
class Swap:
    """A cipher: symbols and the letters they stand for."""

    name: str
    symbols: dict[str, str]
    #: The swap replaces a whole script: words with other signs beyond ASCII, or of ASCII letters mostly, did not go through it.
    script: bool = False
    pattern: re.Pattern = field(init=False)
    fold: dict[str, str] = field(init=False)
    table: dict[int, str] = field(init=False)
    #: What symbols begin with: a word without any of these did not go through the swap.
    signs: frozenset[str] = field(init=False)

    def __post_init__(self):
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.symbols, key=lambda s: (-len(s), s))))) if self.symbols else re.compile(r"(?!)")
        self.fold = {s: chr(FOLD + i) for i, s in enumerate(self.symbols)}
        self.table = {FOLD + i: to for i, to in enumerate(self.symbols.values())}
        self.signs = frozenset(s[0] for s in self.symbols)

    def decode(self, word: str) -> str:
        if self.signs.isdisjoint(word) or self.script and not self._whole(word):
            return word
        return self.pattern.sub(lambda m: self.fold[m[0]], word).translate(self.table)


    def _whole(self, word: str) -> bool:
        high = [c for c in word if ord(c) >= 0x80]
        return all(c in self.symbols or not c.isalpha() for c in high) and 2 * len(high) >= sum(c.isalpha() for c in word)


def swaps(alphabet: set[str]) -> list[Swap]:
    """The ciphers for the non-ASCII characters that the corpus is known to use."""
    high = sorted(c for c in alphabet if ord(c) >= 0x80 and c != LOST)
    # what was swapped twice passes through the signs of the usual western page
    between = {_char("cp1252", b) for b in range(0x80, 0x100)}
    out = []
    for page in WRONG_FOR_UTF8:
        symbols = {}
        for c in sorted({*high, *(between if page in ("cp1252", "latin-1") else ())}):
            shown = "".join(_char(page, b) for b in c.encode())
            symbols[shown] = c
        out.append(Swap(page, symbols))
    for wrong, right in SINGLE:
        symbols = {}
        for byte in range(0x80, 0x100):
            a, b = _char(wrong, byte), _char(right, byte)
            if a != b and b in alphabet:
                symbols[a] = b
        out.append(Swap(f"{right} as {wrong}", symbols, True))
    marks = {}
    for byte, accent in MARKS_BEFORE.items():
        for base in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
            c = unicodedata.normalize("NFC", base + accent)
            if c in alphabet:
                marks[chr(byte) + base] = c
    for byte, c in LETTERS_THERE.items():
        if c in alphabet:
            marks[chr(byte)] = c
    out.append(Swap(MARC8, marks))
    return out


def lost_symbols(alphabet: set[str]) -> dict[str, list[str]]:
    """What is left of a letter where a byte got lost, and the letters it may have been: shown by a page that has no sign for one of its bytes, or gone altogether."""
    letters = sorted(c for c in alphabet if ord(c) >= 0x80 and c.isalpha())
    out: dict[str, list[str]] = {LOST: letters}
    for page in WRONG_FOR_UTF8:
        for c in letters:
            shown = [_char(page, b) for b in c.encode()]
            damaged = "".join(LOST if 0x80 <= ord(x) < 0xA0 else x for x in shown)
            if damaged.count(LOST) == 1 and len(damaged) > 1:
                out.setdefault(damaged, []).append(c)
    return {u: sorted(set(c)) for u, c in out.items()}


def _kind(c: str) -> str:
    """A character as the model sees it: itself in alphabetic scripts, else a class, so that the number of bigrams is bounded."""
    if c.isdigit():
        return "0"
    code = ord(c)
    return c if code < 0x590 or 0x1E00 <= code < 0x2100 or code in (0xFFFD,) or 0x2200 <= code < 0x2600 else "字"


def alphabet_of(singles: dict[str, float]) -> set[str]:
    """The characters of the corpus: those in LEAST_LETTER words, and letters beside such ones in their block of 128."""
    frequent = {c for c, n in singles.items() if n >= LEAST_LETTER and c not in ("字", LOST)}
    blocks = {ord(c) >> 7 for c in frequent if c.isalpha()}
    return frequent | {c for c, n in singles.items() if n >= 1 and c.isalpha() and c not in ("字", LOST) and ord(c) >> 7 in blocks}


@dataclass
class Model:
    """Letter bigrams with add-one backing off to single letters, and what was learnt of each source."""

    pairs: dict[str, int]
    singles: dict[str, int]
    total: int
    ciphers: list[Swap]
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    #: {source: {damaged symbol: {letter: expected number}}}
    lost: dict[str, dict[str, dict[str, float]]] = field(default_factory=dict)
    #: {source: {symbol: letter}}: substitutions of no known page, learnt from where the symbols stand.
    learnt: dict[str, dict[str, str]] = field(default_factory=dict)

    def __post_init__(self):
        self.candidates = lost_symbols(alphabet_of(self.singles))
        self.own = {source: Swap(LEARNT, mapping) for source, mapping in self.learnt.items() if mapping}
        self.logs: dict[str, float] = {}
        self.damaged = re.compile("|".join(map(re.escape, sorted(self.candidates, key=lambda u: (-len(u), u)))))

    def _given(self, before: str, c: str) -> float:
        single = (self.singles.get(c, 0) + 0.02) / (self.total + 40)
        return (max(self.pairs.get(before + c, 0) - DISCOUNT, 0) + 3 * single) / (self.singles.get(before, 0) + 3)

    def letters(self, text: str, source: str) -> Iterator[tuple[int, int, str, dict[str, float]]]:
        """(begin, end, symbol, {letter: probability}) of each damaged symbol of a word, from its neighbours and what the symbol stood for in this source elsewhere, beside EVEN for all letters alike."""
        known = self.lost.get(source, {})
        for m in self.damaged.finditer(text):
            before = _kind(text[m.start() - 1]) if m.start() else " "
            after = _kind(text[m.end()]) if m.end() < len(text) else " "
            here = self.places(m[0], before, after)
            seen = known.get(m[0], {})
            prior = EVEN * max(sum(seen.values()), 1.0) / len(here)
            odds = {c: x * (seen.get(c, 0.0) + prior) for c, x in here.items()}
            whole = sum(odds.values())
            if whole > 0:
                yield m.start(), m.end(), m[0], {c: x / whole for c, x in odds.items()}

    def places(self, symbol: str, before: str, after: str) -> dict[str, float]:
        """How probable each letter is that a damaged symbol may stand for, by its neighbours alone."""
        return {c: self._given(before, c) * (1.0 if after == LOST else self._given(c, after)) for c in self.candidates[symbol]}

    def fill(self, text: str, source: str) -> str:
        """A word with each damaged symbol whose letter is SURE put right; the others stay, and so do those that begin a word, whose case nothing tells."""
        out, end = [], 0
        for begin, stop, _, odds in self.letters(text, source):
            c = max(odds, key=odds.get)
            if odds[c] >= SURE and begin > 0 and text[begin - 1].isalpha():
                out += [text[end:begin], c]
                end = stop
        return "".join([*out, text[end:]])

    def cost(self, word: str, known: dict[str, float] | None = None) -> float:
        """Minus log probability of a word between two blanks."""
        out, before, logs = 0.0, " ", self.logs
        for c in [*map(_kind, word), " "]:
            pair = before + c
            if pair not in logs:
                logs[pair] = -math.log(self._given(before, c))
            out += logs[pair]
            before = c
        return out

    def readings(self, word: str, source: str, beside: str | None = None) -> list[tuple[float, str, str]]:
        """(cost, swap, text) of the ways to read a word, the best first; a swap may have been applied twice. beside: the swap of the words around it, which then is as likely as none."""
        weights = self.weights.get(source) or self.weights.get("", {})
        if beside:
            weights = {n: x / 2 for n, x in weights.items()} | {beside: 0.5}
        found = {word: (self.cost(word) - math.log(weights.get(CLEAN, 0.97)), CLEAN, word)}
        own = self.own.get(source)
        for swap in [*self.ciphers, own] if own else self.ciphers:
            text = swap.decode(word)
            if text == word:
                continue
            # a learnt substitution has shown itself already
            prior = -math.log(0.5 if swap.name == LEARNT else weights.get(swap.name, 0.001))
            for times, t in ((1, text), (2, swap.decode(text))):
                if times == 2 and (t == text or swap.name in (MARC8, LEARNT)):
                    continue
                cost = self.cost(t) + prior * (1 if times == 1 else 1.3)
                if t not in found or cost < found[t][0]:
                    found[t] = (cost, swap.name, t)
        return sorted(found.values())


def is_damaged(word: str) -> bool:
    """Signs that no text holds: the mark of a lost character, control characters of the upper range."""
    return LOST in word or any(0x80 <= ord(c) < 0xA0 and c != "\x85" for c in word)


_PIECE = re.compile(r"[^ \t\r\n]+")


def _restored(model: Model, value: str, source: str, memo: dict) -> tuple[bool, str | None]:
    """Whether a value is garbled, and its text; None where a byte is lost for good.

    The words are read one by one; where one went through a swap, the others
    are read again with that swap in mind.
    """

    def read(word: str, beside: str | None) -> tuple[float, str, str]:
        key = (source, word, beside)
        if key not in memo:
            memo[key] = model.readings(word, source, beside)[0]
        return memo[key]

    found = [m for m in _PIECE.finditer(value) if not m[0].isascii()]
    first = Counter(swap for m in found if (swap := read(m[0], None)[1]) != CLEAN)
    beside = first.most_common(1)[0][0] if first else None
    parts, lost, end = [], False, 0
    for m in found:
        text = read(m[0], beside)[2]
        if LOST in text:
            text = model.fill(text, source)
        lost |= is_damaged(text)
        parts += [value[end : m.start()], text]
        end = m.end()
    garbled = bool(first) or any(is_damaged(m[0]) for m in found)
    return garbled, None if lost else "".join([*parts, value[end:]])


def _words(frame: DataFrame, source: str, value: str) -> DataFrame:
    """(source, word, n): the words of all values with their number, combined before the shuffle."""
    return (
        frame.filter(F.col(value).isNotNull())
        .select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.explode(F.split(F.col(value), r"[ \t\r\n]+")).alias("word"))
        .filter("word <> ''").groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))
    )


def _ascii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the bigrams in words of ASCII, which no swap touches: they are taken once, over whole buffers."""
    total = np.zeros(128 * 128)
    digits = np.arange(128, dtype=np.int64)
    digits[ord("0") : ord("9") + 1] = ord("0")
    for batch in batches:
        words, numbers = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        data = np.frombuffer((" " + " ".join(words.to_pylist()) + " ").encode(), np.uint8)
        codes = digits[data]
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False) + 1
        total += np.bincount(codes[:-1] * 128 + codes[1:], weights=np.repeat(numbers, lengths), minlength=128 * 128)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_pydict({"name": pa.array([chr(i >> 7) + chr(i & 127) for i in at.tolist()], pa.string()), "n": pa.array(total[at], pa.float64())})


#: Signs that stand inside words of their own right.
_JOINERS = "'’‘ʼ´`-‐‑–—·/.&"


def _inside(word: str) -> Iterator[tuple[str, str, str]]:
    """(before, symbol, after) of signs that are no letters and yet stand between two letters."""
    for i in range(1, len(word) - 1):
        c = word[i]
        if ord(c) >= 0x80 and c != LOST and not c.isalpha() and c not in _JOINERS and not unicodedata.combining(c) and word[i - 1].isalpha() and word[i + 1].isalpha():
            yield _kind(word[i - 1]), c, _kind(word[i + 1])


def _count(model: Model | None):
    """Counts of bigrams, swaps, and places of lost bytes and of odd signs in the other words of a partition, each word weighted by its number and its probability to be clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, float] = defaultdict(float)
        used: dict[tuple[str, str], float] = defaultdict(float)
        lost: dict[tuple[str, str], float] = defaultdict(float)
        odd: dict[tuple[str, str], float] = defaultdict(float)
        for batch in batches:
            for source, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                share = 1.0
                if is_damaged(word):
                    share = 0.0
                    if model is not None and LOST in word:
                        text = model.readings(word, source)[0][2]
                        for m in model.damaged.finditer(text):
                            sides = (_kind(text[m.start() - 1]) if m.start() else " ") + (_kind(text[m.end()]) if m.end() < len(text) else " ")
                            lost[source, sides + m[0]] += n
                elif model is not None:
                    ways = model.readings(word, source)
                    best = ways[0][0]
                    odds = {}
                    for cost, swap, _ in ways:
                        odds[swap] = odds.get(swap, 0) + math.exp(best - cost)
                    whole = sum(odds.values())
                    for swap, x in odds.items():
                        used[source, swap] += n * x / whole
                    share = odds.get(CLEAN, 0) / whole
                elif _suspect(word):
                    share = 0.0
                signs = list(_inside(word))
                if share > 0.5 or odds_of_learnt(model, source, signs):
                    for before, c, after in signs:
                        odd[source, c + before + after] += n
                if share > 0.5 and not signs:
                    before = " "
                    for c in [*map(_kind, word), " "]:
                        pairs[before + c] += n
                        before = c
        keys = [("", k) for k in pairs] + list(used) + list(lost) + list(odd)
        values = [*pairs.values(), *used.values(), *lost.values(), *odd.values()]
        if keys:
            kinds = ["pair"] * len(pairs) + ["swap"] * len(used) + ["lost"] * len(lost) + ["odd"] * len(odd)
            yield pa.RecordBatch.from_pydict({
                "source": pa.array([k[0] for k in keys], pa.string()), "name": pa.array([k[1] for k in keys], pa.string()),
                "kind": pa.array(kinds, pa.string()), "n": pa.array(values, pa.float64()),
            })

    return run


def odds_of_learnt(model: Model | None, source: str, signs: list) -> bool:
    """Whether a word has signs that the model has learnt for this source: their places count on."""
    return model is not None and any(c in model.learnt.get(source, ()) for _, c, _ in signs)


def _settled(likely: np.ndarray, times: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Expectation maximisation of what one symbol stands for: (expected number of each letter, mean log likelihood of a place).

    likely: a row for each place with the letters' likelihoods by its
    neighbours; times: how often it occurs. A place's letter is hidden; its
    probability is its likelihood times the letter's share, to which ``prior``
    is added.
    """
    sums = np.zeros(likely.shape[1])
    whole = times.sum() or 1.0
    while True:
        odds = likely * (sums + prior)
        every = odds.sum(axis=1) + 1e-300
        new = (odds * (times / every)[:, None]).sum(axis=0)
        moved, sums = np.abs(new - sums).max(initial=0.0), new
        if moved <= SETTLED * whole:
            return sums, float((times * np.log(every / (whole + prior * likely.shape[1]) + 1e-300)).sum() / whole)


class _Sides:
    """The likelihoods of letters beside their neighbours, each worked out once."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _of(self, letters: tuple[str, ...], before: str | None, after: str | None) -> np.ndarray:
        key = letters, before, after
        if key not in self.known:
            given = self.model._given
            if after == LOST:
                self.known[key] = np.ones(len(letters))
            else:
                self.known[key] = np.array([given(before, c) if after is None else given(c, after) for c in letters])
        return self.known[key]

    def table(self, letters: tuple[str, ...], where: list[tuple[str, str]]) -> np.ndarray:
        return np.array([self._of(letters, b, None) * self._of(letters, None, a) for b, a in where])


def _behind_lost(model: Model, lost: dict[str, dict[str, float]]) -> dict[str, dict[str, dict[str, float]]]:
    """{source: {damaged symbol: {letter: expected number}}} from where the symbols stand."""
    out: dict[str, dict[str, dict[str, float]]] = {}
    sides = _Sides(model)
    for source, places in lost.items():
        by_symbol: dict[str, list] = defaultdict(list)
        for name, n in places.items():
            if name[2:] in model.candidates:
                by_symbol[name[2:]].append((name[0], name[1], n))
        out[source] = {}
        for symbol, where in by_symbol.items():
            letters, times = tuple(model.candidates[symbol]), np.array([n for _, _, n in where])
            # some weight is on all letters alike, lest one that is common takes all places
            sums, _ = _settled(sides.table(letters, [w[:2] for w in where]), times, EVEN * max(times.sum(), 1.0) / len(letters))
            out[source][symbol] = dict(zip(letters, sums.tolist()))
    return out


def _substitutions(model: Model, odd: dict[str, dict[str, float]]) -> dict[str, dict[str, str]]:
    """{source: {symbol: letter}} from where signs that are no letters stand between letters.

    A symbol of a cipher stands where its letter would stand. A letter that
    takes SURE of a symbol's places, in LEAST_WORDS words and CLEARLY better
    than by chance, is what it stands for.
    """
    letters = tuple(sorted(c for c in alphabet_of(model.singles) if ord(c) >= 0x80 and c.isalpha()))
    chance = math.log(1 / (len(model.singles) + 1)) * 2
    out: dict[str, dict[str, str]] = {}
    sides = _Sides(model)
    for source, places in odd.items():
        by_symbol: dict[str, list] = defaultdict(list)
        for name, n in places.items():
            by_symbol[name[0]].append((name[1], name[2], n))
        for symbol, where in by_symbol.items():
            times = np.array([n for _, _, n in where])
            if times.sum() < LEAST_WORDS or not letters:
                continue
            sums, gain = _settled(sides.table(letters, [w[:2] for w in where]), times, 1e-3)
            best = int(sums.argmax())
            if sums[best] >= SURE * times.sum() and gain - chance >= CLEARLY:
                out.setdefault(source, {})[symbol] = letters[best]
    return out


#: Leads and followers of two-byte sequences in the usual wrong code pages: words with such a pair start out as not clean.
_SUSPECT = re.compile(
    "[Â-ß][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]"
    "|[─-╿][^─-╿\\s]|[A-Za-z][─-╿]|√[^0-9\\s]|[РС][Ђ-Џђ-џҐґ–-›€™ -»]|–[∀-⋿ -ÿ]"
)


def _suspect(word: str) -> bool:
    return bool(_SUSPECT.search(word))


def _moved(old: dict, new: dict) -> float:
    """The greatest change of a share."""
    return max((abs(new.get(k, 0.0) - old.get(k, 0.0)) for k in {*old, *new}), default=0.0)


def learn(values: DataFrame, source: str = "source", value: str = "value", most_rounds: int = 30) -> tuple[Model, DataFrame]:
    """The model of all values, and the words it was learnt from.

    ``source`` names what texts of one origin share; null counts as ''. Every
    round is one pass over the distinct words with other than ASCII signs: the
    expectation is taken word by word in the tasks, summed over the partitions,
    and the sums (bounded by alphabet and number of sources) go to the driver.
    Rounds go on until the shares are SETTLED; a model that has not settled
    after ``most_rounds`` is an error.
    """
    words = stored(_words(values, source, value), "words")
    high = stored(words.filter(F.col("word").rlike(r"[^\x00-\x7F]")), "high")
    plain: Counter = Counter()
    ascii_words = words.filter(~F.col("word").rlike(r"[^\x00-\x7F]")).groupBy("word").agg(F.sum("n").alias("n"))
    for r in ascii_words.mapInArrow(_ascii, "name string, n double").groupBy("name").agg(F.sum("n").alias("n")).collect():
        plain[r["name"]] = r["n"]
    model, before = None, None
    for _ in range(most_rounds):
        sums = high.mapInArrow(_count(model), "source string, name string, kind string, n double").groupBy("source", "name", "kind").agg(F.sum("n").alias("n"))
        pairs: Counter = Counter(plain)
        by_kind: dict[str, dict[str, dict[str, float]]] = {k: defaultdict(dict) for k in ("swap", "lost", "odd")}
        for r in sums.collect():
            if r["kind"] == "pair":
                pairs[r["name"]] += r["n"]
            else:
                by_kind[r["kind"]][r["source"]][r["name"]] = r["n"]
        singles: Counter = Counter()
        for pair, n in pairs.items():
            singles[pair[0]] += n
        weights = {s: _weights(u) for s, u in by_kind["swap"].items()}
        weights[""] = weights.get("", _weights({}))
        now = {(s, n): x for s, w in weights.items() for n, x in w.items()}
        bare = Model(dict(pairs), dict(singles), int(sum(singles.values())), swaps(alphabet_of(singles)), weights)
        first, known = model is None, model.learnt if model else {}
        model = Model(bare.pairs, bare.singles, bare.total, bare.ciphers, weights, {}, _substitutions(bare, by_kind["odd"]))
        if not first and before is not None and _moved(before, now) < SETTLED and model.learnt == known:
            return replace(model, lost=_behind_lost(bare, by_kind["lost"])), words
        before = None if first else now
    raise RuntimeError(f"not settled after {most_rounds} rounds")


#: What a swap counts beforehand, against this many clean words.
PRIOR, CLEAN_PRIOR = 0.5, 500.0


def _weights(used: dict[str, float]) -> dict[str, float]:
    names = [*WRONG_FOR_UTF8, *(f"{b} as {a}" for a, b in SINGLE), MARC8]
    counts = {n: used.get(n, 0.0) + PRIOR for n in names} | {CLEAN: used.get(CLEAN, 0.0) + CLEAN_PRIOR}
    whole = sum(counts.values())
    return {n: c / whole for n, c in counts.items()}


def restore(values: DataFrame, model: Model, source: str = "source", value: str = "value") -> DataFrame:
    """``values`` with ``garbled`` and ``restored``: the text again, the text itself where it is sound, null where bytes are lost.

    Null values are sound and stay null. Rows are kept one to one; only values
    with other than ASCII characters are looked at.
    """
    shared = values.sparkSession.sparkContext.broadcast(model)
    plain = F.col(value).isNull() | ~F.col(value).rlike(r"[^\x00-\x7F]")
    sound = values.filter(plain).withColumns({"garbled": F.lit(False), "restored": F.col(value)})
    at = values.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            texts, sources = batch.column(at.index(value)).to_pylist(), batch.column(at.index(source)).to_pylist()
            out = [_restored(shared.value, t, s or "", memo) for t, s in zip(texts, sources)]
            if len(memo) > 200_000:
                memo.clear()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g for g, _ in out], pa.bool_()), pa.array([t for _, t in out], pa.string())],
                names=[*batch.schema.names, "garbled", "restored"],
            )

    schema = ", ".join(f"`{c}` {k}" for c, k in values.dtypes) + ", garbled boolean, restored string"
    return values.filter(~plain).mapInArrow(run, schema).unionByName(sound)
