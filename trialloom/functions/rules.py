"""Score rules written as prose, compiled to one Catalyst expression.

A listed item is read as a row of tokens: its points stand at the end, a
comparison is a comparator with a number behind it (or a number before "or
older"), and what is left of it is the label that names the parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.functions.structured import canonical_parameter
from trialloom.functions.text import to_bool, to_number

# Words and signs that compare a number.
COMPARISONS = {
    ">=": ">=", "<=": "<=", "==": "=", "=": "=", ">": ">", "<": "<",
    "at least": ">=", "greater than or equal to": ">=", "more than or equal to": ">=", "less than or equal to": "<=",
    "less than": "<", "below": "<", "under": "<", "more than": ">", "greater than": ">", "over": ">",
}
# Words behind a number that make it a lower bound, and units that may stand between.
UPWARD = ("or older", "or more", "or greater")
UNITS = ("year", "years", "yr", "yrs", "mg/dl", "mgdl", "g/dl", "gdl", "mg/l", "mgl", "mmol/l", "mmoll", "cm", "mmhg", "%")
# Answers about sex and about ethnicity.
MALE, FEMALE = ("male", "m", "man", "boy"), ("female", "f", "woman", "girl")
WHITE, UNTOLD = ("white", "caucasian"), ("unknown", "declined", "not reported", "unreported")

_TOKENS = re.compile(r">=|<=|==|[<>=:()]|-?\d+(?:\.\d+)?|[^\s<>=:()]+")
_OPERATORS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}


@dataclass(frozen=True)
class Rule:
    parameter: str
    operator: str | None
    value: float | None
    points: float
    answer: str = "truth"  # without operator: "truth", "male" or "non_white"


@dataclass(frozen=True)
class _Token:
    text: str
    start: int

    @property
    def number(self) -> float | None:
        return float(self.text) if re.fullmatch(r"-?\d+(?:\.\d+)?", self.text) else None

    @property
    def word(self) -> str:
        return self.text.lower()


def _tokens(text: str) -> list[_Token]:
    return [_Token(m.group(), m.start()) for m in _TOKENS.finditer(text)]


def _items(prose: str) -> list[str]:
    """The texts of lines that begin with a bullet or a number and a dot."""
    out = []
    for line in prose.splitlines():
        bare = line.strip()
        head = bare[:1] if bare[:1] in ("-", "*", "•") else (re.match(r"\d+\.", bare) or [""])[0]
        if head and (item := bare[len(head) :].strip().rstrip(".")):
            out.append(item)
    return out


def _shared_points(prose: str) -> float | None:
    """The number in "each ... assigned ... N (points) if ..."."""
    tokens = _tokens(prose)
    words = [t.word for t in tokens]
    for each in (i for i, w in enumerate(words) if w == "each"):
        if "assigned" in words[each:]:
            for i in range(words.index("assigned", each) + 1, len(tokens)):
                after = [w for w in words[i + 1 : i + 3] if w not in ("point", "points")]
                if tokens[i].number is not None and after[:1] in (["if"], ["when"]):
                    return tokens[i].number
    return None


def _points(item: str) -> tuple[str, float] | None:
    """An item without its points, and these: ": N points" or "(N points)" at the end."""
    tokens = _tokens(item)
    closed = bool(tokens) and tokens[-1].text == ")"
    tail = tokens[-4:-1] if closed else tokens[-3:]
    if len(tail) == 3 and tail[0].text == ("(" if closed else ":") and tail[1].number is not None and tail[2].word in ("point", "points"):
        return item[: tail[0].start].strip(), tail[1].number
    return None


def _comparison(text: str) -> tuple[str, str, float] | None:
    """(label, operator, number) of the first comparator with a number behind it, or of a number with "or more" behind."""
    text = text.replace("≥", ">=").replace("≤", "<=")
    tokens = _tokens(text)
    words = [t.word for t in tokens]
    found = None
    for i in range(1, len(tokens)):
        for length in (5, 3, 2, 1):
            phrase = " ".join(words[i : i + length])
            behind = tokens[i + length].number if i + length < len(tokens) else None
            if phrase in COMPARISONS and behind is not None:
                sign = not phrase[0].isalpha()
                if found is None or (sign and not found[3]):  # signs go before phrases
                    found = (text[: tokens[i].start].strip(), COMPARISONS[phrase], behind, sign)
                break
    if found and found[3]:
        return found[:3]
    if len(tokens) >= 4 and " ".join(words[-2:]) in UPWARD:
        at = len(tokens) - 3
        at -= words[at] in UNITS
        if at >= 1 and tokens[at].number is not None:
            return text[: tokens[at].start].strip(), ">=", tokens[at].number
    return found[:3] if found else None


def _rule(text: str, points: float) -> Rule:
    compared = _comparison(text)
    parameter = canonical_parameter(compared[0] if compared else text) or "feature"
    if parameter[0].isdigit():
        parameter = f"feature_{parameter}"
    if compared:
        return Rule(parameter, compared[1], compared[2], points)
    lowered = text.lower()
    if parameter == "sex" and "male" in lowered:
        return Rule(parameter, None, None, points, "male")
    return Rule(parameter, None, None, points, "non_white" if re.search("non[- ]white", lowered) else "truth")


def parse_rules(prose: str | None) -> list[Rule] | None:
    """The rules of a list in prose, each with its own points or the shared ones; None without items or if any has none."""
    shared = _shared_points(prose or "")
    rules = []
    for item in _items(prose or ""):
        text, points = _points(item) or (item, shared)
        if points is None:
            return None
        rules.append(_rule(text, points))
    return rules or None


def truth(value: Column) -> Column:
    """Whether a value says yes: a number other than 0, true, or a text that isn't blank or a refusal."""
    return F.when(F.typeof(value) == "string", to_bool(value.cast("string"))).otherwise(F.coalesce(value.try_cast("double") != 0, F.lit(False)))


def male_like(value: Column) -> Column:
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*MALE), True).when(word.isin(*FEMALE), False).otherwise(truth(value))


def non_white_like(value: Column) -> Column:
    word = F.lower(F.trim(value.cast("string")))
    return F.when(F.typeof(value) != "string", truth(value)).otherwise(F.coalesce((word != "") & ~word.isin(*WHITE, *UNTOLD), F.lit(False)))


def score(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The sum of the points of the rules that hold; a missing or null value holds none."""
    answers = {"male": male_like, "non_white": non_white_like, "truth": truth}
    total = F.lit(0.0)
    for rule in rules:
        value = values.get(rule.parameter, F.lit(None).cast("string"))
        if rule.operator is None:
            holds = answers[rule.answer](value)
        else:
            number = F.when(F.typeof(value) == "string", to_number(value.cast("string"))).otherwise(value.try_cast("double"))
            holds = _OPERATORS[rule.operator](number, F.lit(rule.value))
        total = total + F.when(F.coalesce(holds, F.lit(False)), F.lit(rule.points)).otherwise(0.0)
    return total


def with_defaults(values: dict[str, Column], *defaults: dict[str, object]) -> tuple[dict[str, Column], Column]:
    """Values with defaults for blank ones, and the sorted names of the defaults used.

    Several tables of defaults are asked in order, a calculator's own before
    general ones; a name in none stays blank.
    """
    chosen = {k: next(str(d[k]) for d in defaults if k in d) for k in values if any(k in d for d in defaults)}
    blank = {k: F.coalesce(F.trim(v.cast("string")), F.lit("")) == "" for k, v in values.items()}
    filled = {k: F.when(blank[k], F.lit(chosen[k])).otherwise(v.cast("string")) if k in chosen else v for k, v in values.items()}
    used = F.array_sort(F.array_compact(F.array(*[F.when(blank[k], F.lit(k)) for k in chosen], F.lit(None).cast("string"))))
    return filled, used


def run_status(values: dict[str, Column], needed: list[str]) -> Column:
    """'completed' if every needed value is there, else 'missing_inputs'."""
    there = F.lit(True)
    for name in needed:
        there &= F.coalesce(F.trim(values[name].cast("string")), F.lit("")) != "" if name in values else F.lit(False)
    return F.when(there, "completed").otherwise("missing_inputs")
