"""Quantities recorded in different units, converted to the common unit of their concept.

A unit string is segmented by dynamic programming over three tries (prefixes,
roots, exponents). Its decompositions are scored; which one holds is decided
together with the dimensions that the concept's field can have.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows a table of units may have: it travels with the tasks.
MAX_UNITS = 10_000

# Decimal prefixes by spelling.
PREFIXES = {
    "G": 1e9, "giga": 1e9, "M": 1e6, "mega": 1e6, "k": 1e3, "kilo": 1e3, "h": 1e2, "d": 1e-1, "deci": 1e-1, "c": 1e-2, "centi": 1e-2,
    "m": 1e-3, "milli": 1e-3, "u": 1e-6, "μ": 1e-6, "mc": 1e-6, "micro": 1e-6, "n": 1e-9, "nano": 1e-9, "p": 1e-12, "pico": 1e-12,
}
# Roots as (spellings, dimensions, size in base units, whether a prefix may stand before it). The base units are
# gram, metre, litre, mole, day, pascal, joule, international unit, equivalent, osmole, beat and three scales of temperature
# that no factor joins.
ROOTS = (
    ("g gm gr gram grams gramme grammes", {"mass": 1}, 1.0, True),
    ("kgs kilo kilos", {"mass": 1}, 1000.0, False),
    ("lb lbs pound pounds", {"mass": 1}, 453.592, False),
    ("oz ounce ounces", {"mass": 1}, 28.3495, False),
    ("m metre metres meter meters", {"length": 1}, 1.0, True),
    ('in inch inches " ″', {"length": 1}, 0.0254, False),
    ("ft foot feet", {"length": 1}, 0.3048, False),
    ("cms", {"length": 1}, 0.01, False),
    ("l L litre litres liter liters", {"volume": 1}, 1.0, True),
    ("cmm", {"volume": 1}, 1e-6, False),
    ("cc ccm", {"volume": 1}, 1e-3, False),
    ("mol mole moles", {"amount": 1}, 1.0, True),
    ("M molar", {"amount": 1, "volume": -1}, 1.0, True),
    ("% percent pct per_cent", {}, 0.01, False),
    ("%", {"volume": -1}, 10.0, False),
    ("C celsius centigrade °C degC deg_C deg._C degrees_C degree_C degrees_celsius", {"celsius": 1}, 1.0, False),
    ("F fahrenheit °F degF deg_F deg._F degrees_F degree_F degrees_fahrenheit", {"fahrenheit": 1}, 1.0, False),
    ("mmHg mm_Hg mm_of_mercury torr", {"pressure": 1}, 133.322, False),
    ("Pa pascal pascals", {"pressure": 1}, 1.0, True),
    ("bar", {"pressure": 1}, 1e5, True),
    ("cmH2O cm_H2O", {"pressure": 1}, 98.0665, False),
    ("s sec secs second seconds second(s)", {"time": 1}, 1 / 86_400, True),
    ("min mins minute minutes minute(s)", {"time": 1}, 1 / 1440, False),
    ("h hr hrs hour hours hour(s)", {"time": 1}, 1 / 24, False),
    ("d day days day(s)", {"time": 1}, 1.0, False),
    ("w wk wks week weeks week(s)", {"time": 1}, 7.0, False),
    ("mo mos mth mths month months month(s)", {"time": 1}, 30.4375, False),
    ("y yr yrs year years year(s)", {"time": 1}, 365.25, False),
    ("cell cells", {}, 1.0, False),
    ("IU U unit units international_units", {"activity": 1}, 1.0, True),
    ("kat katal", {"activity": 1}, 6e7, True),
    ("eq equiv equivalent equivalents", {"charge": 1}, 1.0, True),
    ("osm osmol", {"osmoles": 1}, 1.0, True),
    ("J joule joules", {"energy": 1}, 1.0, True),
    ("cal calorie calories", {"energy": 1}, 4.184, True),
    ("K kelvin kelvins", {"kelvin": 1}, 1.0, False),
    ("bpm beats", {"beats": 1}, 1.0, False),
    ("Hz hertz", {"time": -1}, 86_400.0, True),
    ("W watt watts", {"energy": 1, "time": -1}, 86_400.0, True),
)
# Words that are numbers.
MULTIPLIERS = {"K": 1e3, "thou": 1e3, "thousand": 1e3, "thousands": 1e3, "million": 1e6, "mill": 1e6, "G": 1e9, "giga": 1e9, "billion": 1e9}
# Exponents by spelling.
EXPONENTS = {"-1": -1, "^-1": -1, "^1": 1, "2": 2, "^2": 2, "-2": -2, "^-2": -2, "3": 3, "^3": 3, "-3": -3, "^-3": -3}
# Fixed value: a cubic metre in litres.
CUBIC = 1000.0
#: Score a reading gains whose dimensions the field has: a prior that some 100 times outweighs other dimensions (its logarithm).
FIELD_PRIOR = 4.6
#: Characters looked at first behind a number; more follow where a reading goes on.
REACH = 64
# Remarks that say nothing about the unit.
REMARKS = ("(dcct)", "(ngsp)", "(ifcc)", "dcct", "ngsp", "ifcc")

_SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
_RAISED = re.compile("[⁻⁰¹²³⁴⁵⁶⁷⁸⁹]+")
_POWER_OF_TEN = re.compile(r"[x×*]?\s*10\s*[\^*e]\s*(-?\d{1,2})", re.I)
_COUNT = re.compile(r"\d{1,6}(?![\d^*])")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3}){2,}(?:\.\d+)?|\d+(?:[.,]\d+)?)(?:e[-+]?\d{1,3})?", re.I)

Signature = tuple[tuple[tuple[str, int], ...], float, float]


class Trie:
    """Spellings by letter, matched without regard to case; an exact match is told apart."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, spelling: str, value: object) -> None:
        node = self.root
        for letter in spelling.lower():
            node = node.setdefault(letter, {})
        node.setdefault("", []).append((spelling, value))

    def matches(self, text: str, at: int) -> Iterator[tuple[int, object, bool]]:
        """(end, value, exact case) of every spelling that stands at ``at``."""
        node = self.root
        for end in range(at, len(text) + 1):
            for spelling, value in node.get("", ()):
                yield end, value, text[at:end] == spelling
            if end == len(text) or (node := node.get(text[end].lower())) is None:
                return


def _tries() -> tuple[Trie, Trie, Trie, Trie]:
    prefixes, roots, exponents, multipliers = Trie(), Trie(), Trie(), Trie()
    for spelling, factor in PREFIXES.items():
        prefixes.add(spelling, factor)
    for spellings, dimensions, size, prefixed in ROOTS:
        for spelling in spellings.split():
            roots.add(spelling.replace("_", " "), (dimensions, size, prefixed))
    for spelling, power in EXPONENTS.items():
        exponents.add(spelling, power)
    for spelling, factor in MULTIPLIERS.items():
        multipliers.add(spelling, factor)
    return prefixes, roots, exponents, multipliers


_PREFIX, _ROOT, _EXPONENT, _MULTIPLIER = _tries()


def normal_unit(text: str) -> str:
    """One spelling of signs: compatibility letters, raised digits as ^n, single blanks."""
    text = _RAISED.sub(lambda m: "^" + m.group().translate(_SUPERSCRIPT), text)
    text = unicodedata.normalize("NFKC", text).replace("×", "x").replace("µ", "μ").replace("º", "°").replace("−", "-")
    return re.sub(r"\s+", " ", text).strip(" \t.,;")


def _units_at(text: str, at: int) -> Iterator[tuple[int, dict[str, int], float, float]]:
    """(end, dimensions, size, score) of prefix, root and exponent standing at ``at``."""
    starts: list[tuple[int, float, float, bool]] = [(at, 1.0, 0.0, False)]
    starts += [(end, factor, -0.5 if exact else -1.0, True) for end, factor, exact in _PREFIX.matches(text, at) if end > at]
    for start, factor, score, prefixed in starts:
        for end, (dimensions, size, takes_prefix), exact in _ROOT.matches(text, start):
            if end == start or (prefixed and not takes_prefix):
                continue
            value = score + 1.0 + 0.2 * (end - start) - (0.0 if exact else 0.3)
            yield end, dimensions, factor * size, value
            for after, power, _ in _EXPONENT.matches(text, end):
                if after == end or (text[after - 1].isdigit() and text[after : after + 1].isdigit()):
                    continue
                raised, amount = {d: n * power for d, n in dimensions.items()}, (factor * size) ** power
                if abs(raised.get("length", 0)) == 3 and len(raised) == 1:  # a volume, or its inverse
                    raised, amount = {"volume": power // 3}, amount * CUBIC ** (power // 3)
                yield after, raised, amount, value + 0.1


@lru_cache(maxsize=50_000)
def _decomposed(text: str, whole: bool) -> tuple[tuple[tuple[int, Signature, float], ...], int]:
    """The readings of ``decompositions`` and the last place that any of them reached.

    The table holds for each position and pending operator the best score of each
    signature reached. With ``whole``, only readings of the whole string count;
    otherwise those that end where a word ends.
    """
    empty: Signature = ((), 1.0, 1.0)
    # (sign of the next unit, whether a unit was read) -> signature -> score
    table: list[dict[tuple[int, bool], dict[Signature, float]]] = [{} for _ in range(len(text) + 1)]
    table[0][(1, False)] = {empty: 0.0}

    def put(at: int, state: tuple[int, bool], signature: Signature, score: float) -> None:
        cell = table[at].setdefault(state, {})
        if score > cell.get(signature, -math.inf):
            cell[signature] = score

    for at in range(len(text)):
        for (sign, read), cell in list(table[at].items()):
            for signature, score in list(cell.items()):
                dimensions, size, divisor = signature
                rest = text[at:]
                if rest[0] == " ":
                    put(at + 1, (sign, read), signature, score)
                    continue
                if rest[0] == "/" and sign == 1:
                    put(at + 1, (-1, read), signature, score)
                if (m := re.match(r"per\b ?", rest, re.I)) and sign == 1:
                    put(at + m.end(), (-1, read), signature, score)
                if rest[0] in "·*.x" and read:
                    put(at + 1, (1, read), signature, score - 0.2)
                for remark in REMARKS:
                    if rest.lower().startswith(remark):
                        put(at + len(remark), (sign, read), signature, score)
                if m := _POWER_OF_TEN.match(text, at):
                    put(m.end(), (sign, True), (dimensions, size * 10.0 ** (sign * int(m.group(1))), divisor), score + 1.0)
                elif m := _COUNT.match(text, at):
                    put(m.end(), (sign, read), (dimensions, size * float(m.group()) ** sign if float(m.group()) else size, divisor * (float(m.group()) or 1.0) if sign < 0 else divisor), score - 0.2)
                for end, factor, exact in _MULTIPLIER.matches(text, at):
                    if end > at and sign == 1 and not read and (end == len(text) or not text[end].isalpha()):
                        put(end, (sign, True), (dimensions, size * factor, divisor), score + (0.4 if exact else 0.1))
                if at and text[at - 1].isalpha() and rest[0].isalpha():
                    continue
                for end, more, amount, value in _units_at(text, at):
                    if end < len(text) and text[end].isalpha() and text[end - 1].isalpha():
                        continue
                    total = dict(dimensions)
                    for d, n in more.items():
                        total[d] = total.get(d, 0) + sign * n
                    key = tuple(sorted((d, n) for d, n in total.items() if n))
                    put(end, (1, True), (key, size * amount**sign, divisor * amount if sign < 0 else divisor), score + value)
    out: dict[tuple[int, Signature], float] = {}
    for at in [len(text)] if whole else range(1, len(text) + 1):
        if not whole and at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
            continue
        if not whole and text[at - 1] == " ":
            continue
        for (sign, read), cell in table[at].items():
            if sign == 1 and read:
                for (dimensions, size, divisor), score in cell.items():
                    key = (at, (dimensions, float(f"{size:.6g}"), float(f"{divisor:.6g}")))
                    out[key] = max(out.get(key, -math.inf), score)
    reached = max(at for at, cell in enumerate(table) if cell)
    return tuple((at, signature, score) for (at, signature), score in sorted(out.items(), key=lambda x: -x[1])), reached


def decompositions(text: str, whole: bool = True, start: int = 0) -> tuple[tuple[int, Signature, float], ...]:
    """(end, (dimensions, size, size of the divisor), score) of each reading of a unit string, or of what begins at ``start``.

    Of a long text a first stretch is read, and a longer one as long as any reading
    reaches its end: the result is that of the whole text, at the cost of the unit.
    """
    if whole:
        return _decomposed(text, True)[0]
    size = REACH
    while True:
        readings, reached = _decomposed(text[start : start + size], False)
        if start + size >= len(text) or reached < size:
            return readings
        size *= 2


@dataclass(frozen=True)
class Unit:
    concept: str
    code: str
    common: bool
    factor: float
    shift: float
    low: float
    high: float


class UnitBook:
    """The units a concept can be recorded in, and the choice among them."""

    def __init__(self, units: Iterable[Unit], aliases: dict[str, list[str]]):
        self.units: dict[str, list[Unit]] = {}
        self.signatures: dict[tuple[str, str], Signature] = {}
        for unit in units:
            self.units.setdefault(unit.concept, []).append(unit)
            read = decompositions(normal_unit(unit.code.replace("_", " ")))
            if read:
                self.signatures[unit.concept, unit.code] = read[0][1]
        self.aliases = {a.lower(): c for c, listed in aliases.items() if c in self.units for a in [*listed, c.replace("_", " ")]}
        ordered = sorted(self.aliases, key=lambda a: -len(a))
        joined = "|".join(rf"\b{re.escape(a)}\b" if a.isascii() else re.escape(a) for a in ordered)
        self.alias = re.compile(joined or r"(?!)", re.I)
        self._read: dict[tuple[str, str, bool], tuple[Unit | None, int]] = {}

    def read(self, concept: str, text: str, whole: bool = True, start: int = 0) -> tuple[Unit | None, int]:
        """The concept's unit that ``text`` names, or that begins at ``start``, and its length."""
        if len(text) - start > 2 * REACH:
            return self._best(concept, text, whole, start)
        text = text[start:]
        key = (concept, text, whole)
        if key not in self._read:
            if len(self._read) > 100_000:
                self._read.clear()
            self._read[key] = self._best(concept, text, whole)
        return self._read[key]

    def _best(self, concept: str, text: str, whole: bool, start: int = 0) -> tuple[Unit | None, int]:
        """The reading with the largest score and prior; one whose dimensions the field hasn't may win, and then names no unit of it."""
        best: tuple[float, Unit | None, int] = (-math.inf, None, 0)
        field = {known[0] for unit in self.units[concept] if (known := self.signatures.get((concept, unit.code)))}
        for at, (dimensions, size, divisor), score in decompositions(text, whole, start):
            named: Unit | None = None
            value = score + 10.0 * at + (FIELD_PRIOR if dimensions in field else 0.0)
            tie = -1.0
            for unit in self.units[concept]:
                known = self.signatures.get((concept, unit.code))
                # The size must agree; the divisor's size breaks ties between units of one size.
                if known and known[0] == dimensions and abs(size / known[1] - 1) < 0.01:
                    near = 0.5 if abs(divisor / known[2] - 1) < 0.01 else 0.0
                    if near > tie:
                        named, tie = unit, near
            value += max(tie, 0.0) if named else -FIELD_PRIOR
            if value > best[0]:
                best = (value, named, at)
        return best[1], best[2]

    @staticmethod
    def distance(unit: Unit, values: list[float]) -> float:
        """How far the values lie outside the unit's typical bounds, as logarithms."""
        away = 0.0
        for v in values:
            if not unit.low <= v <= unit.high:
                away += min(abs(math.log(max(abs(v), 1e-9) / max(b, 1e-9))) for b in (unit.low, unit.high)) + (10.0 if v <= 0 else 0.0)
        return away

    def by_size(self, concept: str, values: list[float]) -> Unit:
        """The unit in whose typical bounds the values lie, the common one first; else the nearest."""
        return min(self.units[concept], key=lambda u: (self.distance(u, values), not u.common))

    def concept_of(self, concept: object, text: str, source: str) -> str | None:
        """The concept named; where none is, the one the text or the source names."""
        if isinstance(concept, str) and concept.strip():
            name = re.sub(r"[\s-]+", "_", concept.strip().lower())
            return name if name in self.units else self.aliases.get(concept.strip().lower())
        if m := self.alias.search(text):
            return self.aliases[m.group().lower()]
        name = source.rpartition(".")[2].strip().lower()
        return name if name in self.units else None

    @staticmethod
    def numbers(text: str) -> tuple[list[float], int] | None:
        """The readings of the first number in ``text`` and where it ends.

        A comma is a decimal sign; where three digits follow, it may part thousands.
        """
        if not (m := _NUMBER.search(text)):
            return None
        raw = m.group()
        if re.fullmatch(r"[-+]?\d{1,3}(,\d{3}){2,}(\.\d+)?", raw):
            return [float(raw.replace(",", ""))], m.end()
        values = [float(raw.replace(",", "."))]
        if re.fullmatch(r"[-+]?[1-9]\d{0,2},\d{3}", raw):
            values.append(float(raw.replace(",", "")))
        return values, m.end()

    def in_text(self, text: str, concept: str) -> tuple[list[float], str] | None:
        """The readings of the number stated for the concept in a sentence, and what follows it."""
        for m in self.alias.finditer(text):
            if self.aliases[m.group().lower()] == concept:
                behind = re.match(r"[^\d.;,!?\n]*?(?=[-+]?\d)", text[m.end() :])
                if behind:
                    rest = text[m.end() + behind.end() :]
                    if found := self.numbers(rest):
                        return found[0], rest[found[1] :]
        return None


def _blank(value: object) -> str:
    return value if isinstance(value, str) else ""


def _unit_behind(book: UnitBook, concept: str, rest: str) -> Unit | None:
    rest = normal_unit(re.split(r"[;,!?\n]|\. ", rest + " ", maxsplit=1)[0])
    return book.read(concept, rest, whole=False)[0] if rest else None


def measured(book: UnitBook, concept: object, value: object, unit: object, text: object, source: object) -> tuple[str, float, Unit] | None:
    """(concept, number, unit) of a recorded quantity; None if there is none."""
    value, unit, text, source = _blank(value), _blank(unit), _blank(text), _blank(source)
    name = book.concept_of(concept, text, source)
    if name is None:
        return None
    value = re.sub("[<>~=≤≥≈]", " ", value)
    own = book.numbers(value)
    stated = book.in_text(text, name)
    if own is None and stated is None:
        return None
    readings = own[0] if own else stated[0]
    chosen = book.read(name, normal_unit(unit))[0] if unit.strip() else None
    if chosen is None and own and value[own[1] :].strip():
        chosen = book.read(name, normal_unit(value[own[1] :]))[0]
    if chosen is None and stated:
        chosen = _unit_behind(book, name, stated[1])
    if chosen is None:
        chosen = min((book.by_size(name, [v]) for v in readings), key=lambda u: min(book.distance(u, [v]) for v in readings))
    return name, min(readings, key=lambda v: book.distance(chosen, [v])), chosen


def bounded(book: UnitBook, concept: object, lower: object, upper: object, unit: object, source: object) -> tuple[str, float | None, float | None, Unit] | None:
    """(concept, lower, upper, unit) of an interval with at least one bound."""
    values = [None if v is None or math.isnan(v) else float(v) for v in (lower, upper)]
    name = book.concept_of(concept, _blank(source), _blank(source))
    if name is None or values == [None, None]:
        return None
    chosen = book.read(name, normal_unit(_blank(unit)))[0] if _blank(unit).strip() else None
    chosen = chosen or _unit_in_remark(book, name, _blank(source)) or book.by_size(name, [v for v in values if v is not None])
    return name, values[0], values[1], chosen


def _unit_in_remark(book: UnitBook, concept: str, remark: str) -> Unit | None:
    """The longest unit that begins at a word of a remark; the word "in" before another unit is none."""
    found = []
    remark = normal_unit(remark)
    for m in re.finditer(r"(?<!\w)[^\s(]", remark):
        unit, end = book.read(concept, remark, whole=False, start=m.start())
        if unit:
            found.append((m.start(), end, unit))
    if len(found) > 1:
        found = [f for f in found if remark[f[0] : f[0] + 3] != "in "] or found
    return max(found, key=lambda f: f[1])[2] if found else None


def read_units(units: DataFrame) -> list[Unit]:
    """The table of units as a list; it must have at most ``MAX_UNITS`` rows."""
    rows = units.select("concept", "unit_code", "is_common", "factor", "shift_amount", "typical_low", "typical_high").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"a table of units may have {MAX_UNITS} rows at most")
    return [Unit(r[0], r[1], bool(r[2]), float(r[3]), float(r[4] or 0.0), float(r[5]), float(r[6])) for r in rows]


RESULT = "concept string, unit_code string, is_common boolean, lower_value double, upper_value double, lower_common double, upper_common double"


def _common(unit: Unit, value: float | None) -> float | None:
    return None if value is None else value * unit.factor + unit.shift


def to_common_units(
    df: DataFrame,
    key: str,
    units: list[Unit],
    aliases: dict[str, list[str]],
    concept: Column,
    unit: Column,
    source: Column,
    value: Column | None = None,
    text: Column | None = None,
    lower: Column | None = None,
    upper: Column | None = None,
) -> DataFrame:
    """(key, concept, unit_code, is_common, bounds as recorded and in the common unit) of every quantity.

    With ``value``/``text`` a record holds one number (both bounds are equal);
    with ``lower``/``upper`` an interval. The unit is read from the unit field,
    else from the value, else behind the number in the text or in the source's
    remark; where it stands nowhere, the typical bounds decide, the common unit
    first. Records without a number, or of a concept without units, have no row.
    Nulls in any column are as good as blanks; repeated keys are read each by
    itself; columns not named are dropped. One narrow pass, no shuffle.
    """
    single = value is not None
    columns = [concept, unit, source, *((value, text if text is not None else F.lit(None).cast("string")) if single else (lower.cast("double"), upper.cast("double")))]
    narrow = df.select(F.col(key), *[c.alias(f"__{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = UnitBook(units, aliases)
        for batch in batches:
            rows = []
            for k, c, u, s, a, b in batch.itertuples(index=False, name=None):
                if single:
                    if found := measured(book, c, a, u, b, s):
                        name, number, chosen = found
                        rows.append((k, name, chosen.code, chosen.common, number, number, _common(chosen, number), _common(chosen, number)))
                elif found := bounded(book, c, a, b, u, s):
                    name, low, high, chosen = found
                    rows.append((k, name, chosen.code, chosen.common, low, high, _common(chosen, low), _common(chosen, high)))
            yield pd.DataFrame(rows, columns=[key, "concept", "unit_code", "is_common", "lower_value", "upper_value", "lower_common", "upper_common"])

    return narrow.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {RESULT}")
