"""Column expressions on text; all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029"
LINE_LEAD = " \t\u00a0"
LINE_TAIL = " \t"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`.

    Spark evaluates an expression again wherever it is written, inside a lambda even once per
    element; a lambda variable is the one form that is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    """Lower-cased whitespace tokens, duplicates and punctuation kept."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def raw_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def word_count(c: Column) -> Column:
    return F.size(raw_words(c))


def collapse(c: Column) -> Column:
    """Trim and turn each run of white space into one blank."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def contains_any(c: Column, terms: Iterable[str], whole_word: bool = False) -> Column:
    """True when a lower-cased text holds one of the literal terms."""
    if whole_word:
        body = "|".join(_quote(t) for t in terms)
        return F.coalesce(c.rlike(rf"(?<!\w)(?:{body})(?!\w)"), F.lit(False))
    return F.coalesce(any_of(F.contains(c, F.lit(t)) for t in terms), F.lit(False))


def holds_any(text: Column, terms: Iterable[str], whole_word: bool = False) -> Column:
    """Case-insensitive `contains_any`: the text is lower-cased once for all terms."""
    return let(F.lower(text), lambda t: contains_any(t, terms, whole_word))


def _quote(term: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in term)


def terms_found(c: Column, terms: Iterable[str]) -> Column:
    """The literal terms that occur in the text, in list order."""
    return F.array_compact(
        F.array(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in terms])
    )


def first_term(c: Column, terms: Iterable[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in terms])


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_lines(c: Column) -> Column:
    """Per line: drop leading blank/tab/NBSP and trailing blank/tab."""
    lead = F.regexp_replace(c, r"(^|\n)[ \t\u00a0]+", "$1")
    return F.regexp_replace(lead, r"[ \t]+(?=\n|$)", "")


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])(?U:\s+)")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct-token arrays; NULL when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)
    )


def html_text(c: Column, drop_script: bool = False) -> Column:
    """Character data of an HTML page; script and style bodies stay unless dropped."""
    from deskspark.rules import HTML_ENTITIES, HTML_MARKUP, HTML_SCRIPTS

    if drop_script:
        c = F.regexp_replace(c, HTML_SCRIPTS, "")
    c = F.regexp_replace(c, HTML_MARKUP, "$1$2")
    for entity, char in HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"\n\s*\n", "\n\n")
    return strip(F.regexp_replace(c, " +", " "))


def content_key(category: Column, subject: Column, body: Column, body_chars: int = 500) -> Column:
    """Cache key: md5 of the normalised category, subject and body prefix."""
    joined = F.concat_ws(":", category, subject, F.substring(body, 1, body_chars))
    return F.md5(collapse(F.lower(joined)))
