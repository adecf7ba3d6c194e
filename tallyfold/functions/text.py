"""Text rules of the record model, as column expressions.

Patterns are stated with (?U) where blanks and digits mean Unicode ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that count as equal.
QUOTES_AND_DASHES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
ELLIPSIS = "…"
MARKS_BEGIN = bytearray(b"\xe2\x80")
#: Blanks beyond ASCII, and those of them that composition leaves.
COMPOSED_BLANKS = "\x85\u1680\u2028\u2029"
RARE_BLANKS = COMPOSED_BLANKS + "\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
BETWEEN_OPTIONS = "\ue000"
#: Short words that don't count as letter-spaced fragments.
SHORT_WORDS = ["a", "an", "of", "in", "to", "is", "on", "at", "by", "or", "if", "it", "as", "be", "we"]
#: The patterns of the record model.
NUMERIC_NAME = r"(?U)^[\d\s.\-]+\z"
LEADING_NUMBER = r"(?U)^\s*(\d{1,3}[a-zA-Z]?)[.\):]\s+"
PRINTED_PAGE = r"(?U)^[\[(]?\s*(\d{1,4})\s*[\])]?\z"
OPTION_MARKER = r"^\(?([A-Da-d]|[ivx]{1,4})\)?[.\):]?\z"
OPTION_PREFIX = r"(?U)^\s*\(?([A-Da-d]|[ivx]{1,4})\)?[.\):]\s*(?=\S)"
MARKS_LINE = r"(?U)^[\s\d xX+\-=./,\[\]()]+\z"
YEARS = r"(?:19|20)\d{2}"
DATES = r"(?<!\d)(\d{1,4})[-./](\d{1,2})[-./](\d{1,4})(?!\d)"
#: What a provider says when an account, not a minute, has no calls left.
QUOTA_MARKERS = ["per-day", "per day", "daily", "add credits", "add 10 credits", "credits to unlock"]


def nfkc(text: Column) -> Column:
    """Compatibility composition, text by text inside the JVM: Spark has no such function, but comes with the library that collations use."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNotNull(), composed)


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def composed(text: Column) -> Column:
    """Compatibility composition of texts beyond ASCII, which it leaves as it is."""
    return F.when(beyond_ascii(text), nfkc(text)).otherwise(text)


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replaced(text: Column, marks: dict[str, str]) -> Column:
    """Each of ``marks`` after the other: a search for bytes, which a text without the mark passes quickly."""
    return reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit(marks[mark])), marks, text)


def collapse(text: Column, rare: str = RARE_BLANKS) -> Column:
    """Single plain blanks, none at the ends. The ends of lines go by a search; only texts that still hold a run or another blank meet the pattern."""
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    odd = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in rare])
    left = lambda t: F.contains(t, F.lit("  ")) | t.rlike(r"[\t\x0B\f\r]") | (beyond_ascii(t) & odd(t))
    # No blank but the plain one is left to be taken off the ends.
    return F.trim(once(lines, lambda t: F.when(left(t), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t)))


def exact_text(text: Column, compose: bool = True) -> Column:
    """The form under which two texts count as equal: composed, plain quotes and dashes, single blanks, no final dots, lower case."""
    # The marks have their first two bytes in common; a text without these has no mark.
    marked = lambda t: F.contains(t.cast("binary"), F.lit(MARKS_BEGIN))
    plain = lambda t: F.when(marked(t), replaced(t, QUOTES_AND_DASHES | {ELLIPSIS: "..."})).otherwise(t)
    base = F.when(beyond_ascii(text), once(nfkc(text) if compose else text, plain)).otherwise(text)
    return F.lower(F.rtrim(collapse(base, COMPOSED_BLANKS if compose else RARE_BLANKS), F.lit(".")))


def exact_key(kind: Column, text: Column, options: Column | None = None, compose: bool = True) -> Column:
    """type||stem||option|option; a null list of options is an empty one, a null text has no key."""
    tail = F.lit("")
    if options is not None:
        options = F.coalesce(options, F.array().cast("array<string>"))
        # Options go through the composition together, between marks of private use that it leaves alone.
        joined = F.array_join(F.transform(options, lambda o: F.coalesce(o, F.lit(""))), BETWEEN_OPTIONS)
        each = F.split(composed(joined) if compose else joined, BETWEEN_OPTIONS)
        tail = F.array_join(F.transform(each, lambda o: exact_text(o, False)), "|")
    return F.concat(kind, F.lit("||"), exact_text(text, compose), F.lit("||"), tail)


def embedding_text(kind: Column, text: Column, options: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("["), kind, F.lit("] "), text), options)


def canonical_id(ids: Column) -> Column:
    """canonical_ and the start of the hash of the sorted ids."""
    return F.concat(F.lit("canonical_"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 16))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def job_id(kind: Column, source: Column, folder: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", kind, source, folder), 256), 1, 16)


def is_parseable_year(year: Column) -> Column:
    return year.rlike(r"(?U)^\d{4}")


def year_key(year: Column) -> Column:
    """Sorts years by their first four digits, others behind them; the label itself stays as it is."""
    number = F.when(is_parseable_year(year), F.substring(year, 1, 4).cast("int")).otherwise(0)
    return F.struct(F.when(is_parseable_year(year), 0).otherwise(1).alias("other"), number.alias("number"), year.alias("label"))


def letter_spaced(text: Column) -> Column:
    """True where over two fifths of at least four words with letters are fragments of one or two characters."""
    words = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w.rlike(r"\p{L}"))
    short = F.filter(words, lambda w: (F.length(w) <= 2) & ~F.lower(w).isin(SHORT_WORDS))
    return (F.size(words) >= 4) & (F.size(short) > 0.4 * F.size(words))


def printed_page(text: Column) -> Column:
    found = F.regexp_extract(strip(text), PRINTED_PAGE, 1)
    return F.when(found != "", found.cast("int"))


def digit_groups(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0)))


def filename_metadata(name: Column) -> Column:
    """Years, dates and tokens of a file name without its ending."""
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    parts = [F.regexp_extract_all(stem, F.lit(DATES), F.lit(i)) for i in (1, 2, 3)]
    first_two = F.zip_with(parts[0], parts[1], lambda a, b: F.concat_ws("-", a, b))
    return F.struct(
        F.array_sort(F.array_distinct(F.regexp_extract_all(stem, F.lit(YEARS), F.lit(0)))).alias("years"),
        F.zip_with(first_two, parts[2], lambda a, b: F.concat_ws("-", a, b)).alias("dates"),
        F.filter(F.split(stem, r"[_\-\s]+"), lambda t: t != "").alias("tokens"),
    )


def field_conflict(document: Column, file: Column) -> Column:
    """Both present, different but for case, both with digits, and no group of digits in common."""
    a, b = digit_groups(document), digit_groups(file)
    both = (F.coalesce(document, F.lit("")) != "") & (F.coalesce(file, F.lit("")) != "") & (F.lower(document) != F.lower(file))
    return F.coalesce(both & (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def year_disagrees(year: Column, date: Column) -> Column:
    """The year field and the date field name years, none of them the same."""
    a, b = (F.array_distinct(F.regexp_extract_all(x, F.lit(YEARS), F.lit(0))) for x in (year, date))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def best_of(document: Column, file: Column) -> Column:
    return F.coalesce(F.nullif(document, F.lit("")), file)


def leading_number(text: Column) -> tuple[Column, Column]:
    """A question's number, null without one, and the text behind it."""
    number = F.regexp_extract(text, LEADING_NUMBER, 1)
    return F.nullif(number, F.lit("")), F.when(number != "", F.regexp_replace(text, LEADING_NUMBER, "")).otherwise(text)


def alnum_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def snippets_match(candidate: Column, question: Column) -> Column:
    """Equal starts of 30 characters, or of the shorter text where that has at least 12."""
    n = F.least(F.length(candidate), F.length(question), F.lit(30))
    return (n >= 12) & (F.substr(candidate, F.lit(1), n) == F.substr(question, F.lit(1), n))


def slug(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def topic_slug(name: Column) -> Column:
    base = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("topic"))


def without_json_fence(text: Column) -> Column:
    inner = F.regexp_extract(strip(text), r"(?is)^```(?:json)?\s*\n?(.*?)\n?```\z", 1)
    return F.when(strip(text).rlike(r"(?is)^```(?:json)?\s*\n?(.*?)\n?```\z"), inner).otherwise(text)


def looks_truncated(text: Column) -> Column:
    return (strip(text) != "") & ~F.endswith(strip(text), F.lit("}"))


def is_quota_message(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(m) for m in QUOTA_MARKERS])


def redacted(key: Column) -> Column:
    shown = F.when(F.length(key) > 4, F.concat(F.lit("..."), F.right(key, F.lit(4)))).otherwise(F.lit("***"))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("<missing>")).otherwise(shown)


def flattened_table(rows: Column) -> Column:
    """Rows of cells as lines; blank and 'nan' cells and empty lines go."""
    line = lambda r: F.array_join(F.filter(F.transform(r, strip), lambda c: (c != "") & (F.lower(c) != "nan")), " | ")
    return F.array_join(F.filter(F.transform(rows, line), lambda x: x != ""), "\n")


def occurrence_ids(file_hash: Column, number: Column, suffix: str) -> Column:
    return F.concat(F.substring(file_hash, 1, 12), F.lit(f"_{suffix}"), number.cast("string"))
