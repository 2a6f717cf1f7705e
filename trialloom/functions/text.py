"""Text normalization, tokenizing and lenient parsing as Catalyst expressions.

All of it stays in the JVM. Patterns keep to what Java, RE2 and Python agree on;
blanks are spelled out, since Java's ``\\s`` knows only ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blanks, and those that end a line.
BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"[\r\n\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# Fixed value: a token is a run of ASCII letters and digits or of Chinese characters.
TOKEN = r"[a-z0-9]+|[\x{4E00}-\x{9FFF}]+"
#: Longest character sequence that a run of Chinese characters is cut into.
MAX_NGRAM = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    """Every run of blanks as one space, none at the ends; null gives ''."""
    return F.trim(F.regexp_replace(_filled(text), BLANK + "+", " "))


def normalize_block(text: Column) -> Column:
    """Lines joined by a space within a paragraph, paragraphs parted by an empty line; null gives ''.

    A carriage return ends a line by itself, so CR LF ends a paragraph.
    """
    lines = F.transform(F.split(_filled(text), LINE_END), normalize_whitespace)
    joined = F.regexp_replace(F.array_join(lines, "\n"), "^\n+|\n+$", "")
    parted = F.regexp_replace(joined, "\n\n+", "\x01")
    return F.replace(F.replace(parted, F.lit("\n"), F.lit(" ")), F.lit("\x01"), F.lit("\n\n"))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text as an array, empty for a blank text."""
    return F.filter(F.split(normalize_block(text), "\n\n"), lambda p: p != "")


def dedupe(texts: Column, ignore_case: bool = True) -> Column:
    """The texts with blanks collapsed, the first of equal ones kept, empty ones dropped; null gives an empty array.

    For lists of modest length: each text is looked up in the list before it.
    """
    clean = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), normalize_whitespace), lambda t: t != "")
    if not ignore_case:
        return F.array_distinct(clean)

    def first_of_each(pair: Column) -> Column:
        numbered = F.transform(pair["clean"], lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        return F.transform(F.filter(numbered, lambda n: F.array_position(pair["lowered"], F.lower(n["t"])) == n["i"] + 1), lambda n: n["t"])

    return let(clean, lambda c: let(F.struct(c.alias("clean"), F.transform(c, F.lower).alias("lowered")), first_of_each))


def dedupe_columns(columns: list[str]) -> list[Column]:
    """``dedupe`` of many array columns, written as SQL text: building it column by column takes seconds."""
    clean = "filter(transform(coalesce(@, array()), t -> trim(regexp_replace(coalesce(t, ''), r'" + BLANK + "+', ' '))), t -> t <> '')"
    first = "transform(filter(transform(p.c, (t, i) -> struct(t, i)), n -> array_position(p.l, lower(n.t)) = n.i + 1), n -> n.t)"
    form = "transform(transform(array(" + clean + "), c -> struct(c AS c, transform(c, t -> lower(t)) AS l)), p -> " + first + ")[0]"
    return [F.expr(form.replace("@", f"`{c}`")).alias(c) for c in columns]


def tokenize(text: Column) -> Column:
    """Lower-case tokens; a run of Chinese characters as all its sequences of up to 6, and whole if longer."""
    lowered = F.lower(F.replace(_filled(text), F.lit("_"), F.lit(" ")))
    runs = F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))

    def cut(run: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.length(run), F.lit(MAX_NGRAM)))
        pieces = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda at: F.substring(run, at, n))))
        whole = F.when(F.length(run) > MAX_NGRAM, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike("^[a-z0-9]"), F.array(run)).otherwise(F.concat(pieces, whole))

    # Most texts hold no Chinese: their runs are the tokens, and nothing is built token by token.
    return F.when(_filled(text).rlike(r"[\x{4E00}-\x{9FFF}]"), F.flatten(F.transform(runs, cut))).otherwise(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)))


def token_count(text: Column) -> Column:
    """Number of ASCII words plus Chinese characters."""
    return F.regexp_count(_filled(text), F.lit("[A-Za-z0-9]+")) + F.regexp_count(_filled(text), F.lit(r"[\x{4E00}-\x{9FFF}]"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(_filled(text)) / 4)).cast("int")


def first_sentence(text: Column, max_chars: int = 220) -> Column:
    """Up to the first sentence end before a blank; cut with '...' beyond ``max_chars``."""
    flat = normalize_whitespace(text)
    sentence = F.regexp_extract(flat, r"^(.*?[.!?])( |$)", 1)
    sentence = F.when(sentence == "", flat).otherwise(sentence)
    cut = F.concat(F.regexp_replace(F.substring(sentence, 1, max_chars - 3), "[ ,;:]+$", ""), F.lit("..."))
    return F.when(F.length(sentence) <= max_chars, sentence).otherwise(cut)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by '::'."""
    return F.sha2(F.concat_ws("::", *[_filled(p.cast("string")) for p in parts]), 256)


def uuid5(text: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID (version 5) of a text, by default in the URL namespace; blank counts as '__empty__'."""
    name = F.when(F.trim(_filled(text)) == "", F.lit("__empty__")).otherwise(F.trim(text))
    sha = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(sha, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.concat(F.lit("5"), F.substring(sha, 14, 3)), F.concat(variant, F.substring(sha, 18, 3)), F.substring(sha, 21, 12))


def pack(parts: Column, max_chars: int) -> Column:
    """Paragraphs packed in order into pieces of at most ``max_chars``, parted by an empty line.

    A paragraph longer than that stays whole, as a piece of its own.
    """
    none = F.array().cast("array<string>")

    def add(state: Column, part: Column) -> Column:
        grown = F.concat(state["open"], F.lit("\n\n"), part)
        fits = F.length(grown) <= max_chars
        return F.struct(
            F.when(state["open"].isNull() | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"),
            F.when(state["open"].isNull() | ~fits, part).otherwise(grown).alias("open"),
        )

    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(parts, start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def parse_partial_date(text: Column) -> Column:
    """A date from 'Month d, yyyy', 'Month yyyy' or ISO; blank, N/A and anything else give null."""
    flat = normalize_whitespace(text)
    formats = ((r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^[A-Za-z]+ \d{4}$", "MMMM yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"))
    return F.coalesce(*[F.when(flat.rlike(p), F.try_to_timestamp(F.initcap(flat), F.lit(f))) for p, f in formats]).cast("date")


# Years in each unit of an age.
AGE_UNITS = {"year": 1.0, "month": 1 / 12, "week": 1 / 52, "day": 1 / 365, "hour": 1 / (365 * 24)}


def age_years(text: Column) -> Column:
    """Years from '18 Years', '6 Months' and the like, to 4 digits, half to even; N/A, blank and others give null."""
    flat = F.lower(normalize_whitespace(text))
    amount = F.regexp_extract(flat, r"^(\d+(?:\.\d+)?) *([a-z]+)", 1)
    unit = F.regexp_extract(flat, r"^(\d+(?:\.\d+)?) *([a-z]+)", 2)
    factor = F.coalesce(*[F.when(unit.isin(u, u + "s"), F.lit(f)) for u, f in AGE_UNITS.items()])
    return F.bround(F.nullif(amount, F.lit("")).try_cast("double") * factor, 4)


def lenient_json(text: Column) -> Column:
    """The JSON in a reply: a fenced block, else the whole text, else from the first bracket to the last; null without any."""
    bare = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))

    def first_that_parses(t: Column) -> Column:
        candidates = F.array(bare(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)), bare(t), bare(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)))
        return F.get(F.filter(candidates, lambda c: F.try_parse_json(c).isNotNull()), F.lit(0))

    return let(text, first_that_parses)


def code_blocks(text: Column, language: str = "python") -> Column:
    """The fenced blocks of a language, trimmed, joined by an empty line; '' without any."""
    found = F.regexp_extract_all(_filled(text), F.lit(rf"(?is)```{language}\s*(.*?)```"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != ""), "\n\n")


# Words that mean no; any other word means yes.
NO = ("no", "n", "false", "0", "absent", "negative", "neg", "female", "f")


def to_bool(text: Column) -> Column:
    """False for null, blank and words of refusal, true for anything else."""
    flat = F.lower(F.trim(_filled(text)))
    return ~((flat == "") | flat.isin(*NO))


def to_number(text: Column) -> Column:
    """The first number in a text as double, null without any."""
    return F.nullif(F.regexp_extract(_filled(text), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


# Words that negate a clause.
NEGATION = r"(?i)\b(no|not|without|denies|denied|negative|never|none|absent)\b|无|否认|没有"


def clauses(text: Column) -> Column:
    """The clauses of a text: parted at sentence ends, line ends and semicolons, blanks collapsed."""
    marked = F.regexp_replace(_filled(text), r"([.!?。！？])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"[\n\r;]+"), normalize_whitespace), lambda c: c != "")


def negated_clauses(text: Column) -> Column:
    """The clauses with a word that negates, each once."""
    return F.array_distinct(F.filter(clauses(text), lambda c: c.rlike(NEGATION)))


def align_tokens(text: Column) -> Column:
    """Lower-case ASCII tokens of at least 3 letters, plural endings dropped."""
    words = F.regexp_extract_all(F.lower(_filled(text)), F.lit("[a-z0-9]+"), F.lit(0))
    singular = lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y"))).when((F.length(w) > 4) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.filter(F.transform(words, singular), lambda w: F.length(w) >= 3)


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space, pairs of equal ones left out, each once."""
    size = F.greatest(F.size(tokens) - 1, F.lit(0))
    left, right = F.slice(tokens, F.lit(1), size), F.slice(tokens, F.lit(2), size)
    pairs = F.zip_with(left, right, lambda a, b: F.when(a != b, F.concat_ws(" ", a, b)))
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(pairs)))


def alignment(query: Column, candidate: Column, low_signal: tuple[str, ...] = ()) -> Column:
    """Share of a query's weight that a candidate's tokens and bigrams carry, damped for short queries.

    A token weighs 1, a low-signal one .15, a bigram of the others 1.5; below a
    total weight of 4 the share is scaled down. Empty queries give 0.
    """
    low = F.array(*[F.lit(w) for w in low_signal]).cast("array<string>")
    weigh = lambda array: F.aggregate(array, F.lit(0.0), lambda acc, w: acc + F.when(F.array_contains(low, w), 0.15).otherwise(1.0))

    def share(parts: Column) -> Column:
        total = weigh(parts["tokens"]) + F.size(parts["pairs"]) * 1.5
        matched = weigh(F.array_intersect(parts["tokens"], parts["other"])) + F.size(F.array_intersect(parts["pairs"], bigrams(parts["other"]))) * 1.5
        return F.when(total > 0, matched / total * F.least(total / 4, F.lit(1.0))).otherwise(0.0)

    def signature(own: Column) -> Column:
        strong = F.filter(own, lambda w: ~F.array_contains(low, w))
        return let(F.struct(F.array_distinct(own).alias("tokens"), let(strong, bigrams).alias("pairs"), align_tokens(candidate).alias("other")), share)

    return let(align_tokens(query), signature)


# Words that a chosen letter stands behind, and the signs between, in order of trust.
CHOICES = (("Answer", r"\s*:\s*"), ("Final choice", r"\s*:\s*"), ("Selected option", r"\s*:\s*"), ("option|choice", r"\s*"), ("option|choice", r"\s*[:=-]?\s*"))


def choice(text: Column, available: Column) -> Column:
    """The letter a reply settles on, if it is among the ``available`` ones; else null. No match by value.

    A reply of one letter is that letter. Else each form is looked for in turn; the
    first place it stands at counts, and if its letter isn't available the next form does.
    """
    bare = F.upper(F.regexp_replace(_filled(text), r"^\s+|\s+$", ""))
    letters = F.transform(available, F.upper)
    allowed = lambda c: F.when(F.array_contains(letters, c), c)
    forms = [rf"(?i)\b(?:{words.replace(' ', chr(92) + 's+')}){signs}([A-Z])\b" for words, signs in CHOICES]
    return F.coalesce(F.when(F.length(bare) == 1, allowed(bare)), *[allowed(F.upper(F.regexp_extract(_filled(text), p, 1))) for p in forms])


# How lines begin that tell how to answer.
INSTRUCTIONS = ("please compute the answer using the appropriate calculator", "end your final answer with the format", r"answer\s*:\s*<letter>")


def sanitize_question(text: Column) -> Column:
    """A question without its choices: cut at a line 'Choices:', option lines ('A. ...') and instructions dropped, blanks collapsed.

    If nothing is left, the lines before 'Choices:' as they are.
    """
    flat = F.regexp_replace(_filled(text), "\r\n|\r", "\n")
    head = F.regexp_replace(flat, r"(?is)(^|\n)[ \t]*choices[ \t]*:[ \t]*(\n.*)?$", "")
    drop = rf"^\s*[A-Z]\.\s+\S|(?i)^\s*(?:{'|'.join(INSTRUCTIONS)})"
    kept = normalize_whitespace(F.array_join(F.filter(F.split(head, "\n"), lambda line: ~line.rlike(drop)), " "))
    return F.when(kept == "", normalize_whitespace(head)).otherwise(kept)


def split_criteria(text: Column) -> Column:
    """The items of a list: a bullet or an empty line begins a new one; one item with semicolons is parted there.

    Blanks collapsed, equal items (whatever their case) once. Parting at
    semicolons needs three words in every part.
    """
    bullet = r"^\s*(?:[-*•·]|\(?\d{1,3}[.)])\s+"
    lines = F.split(F.regexp_replace(_filled(text), "\r\n|\r", "\n"), "\n")
    marked = F.transform(lines, lambda line: F.when(normalize_whitespace(line) == "", F.lit("\x01")).when(line.rlike(bullet), F.concat(F.lit("\x01"), F.regexp_replace(line, bullet, ""))).otherwise(line))
    items = F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\x01"), normalize_whitespace), lambda i: i != "")
    parts = F.filter(F.transform(F.split(_filled(text), ";"), normalize_whitespace), lambda i: i != "")
    enough = F.forall(parts, lambda p: F.size(F.split(p, " ")) >= 3) & (F.size(parts) > 1)
    return let(items, lambda found: dedupe(F.when((F.size(found) <= 1) & enough, parts).otherwise(found)))
