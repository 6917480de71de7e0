"""Reply text: templates, cleanup, signature, names, feedback digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark.functions import text as X
from deskspark.settings import DEFAULTS, Settings


def render_template(
    category: Column, slots: Mapping[str, Column], templates: Mapping[str, str] = R.TEMPLATES
) -> Column:
    """Category template (general one otherwise) with its slots filled, missing slots defaulted.

    The template is cut at its slots and joined again, so text that comes in through one slot is
    never searched for another slot.
    """
    def filled(template: str) -> Column:
        pieces, rest = [], template
        while "{" in rest:
            literal, tail = rest.split("{", 1)
            name, rest = tail.split("}", 1)
            default = F.lit(R.SLOT_DEFAULTS.get(name, ""))
            value = slots.get(name)
            if literal:
                pieces.append(F.lit(literal))
            pieces.append(default if value is None else F.coalesce(value, default))
        if rest:
            pieces.append(F.lit(rest))
        return F.concat(*pieces)

    out = None
    for name, template in templates.items():
        if name:
            hit = category == name
            out = F.when(hit, filled(template)) if out is None else out.when(hit, filled(template))
    general = filled(templates[""])
    return general if out is None else out.otherwise(general)


def context_or_default(context: Column) -> Column:
    return F.coalesce(X.blank_to_null(context), F.lit(R.SLOT_DEFAULTS["context"]))


def salutation_position(reply: Column, markers: Sequence[str] = R.SALUTATIONS) -> Column:
    """Position of the first marker (list order) that occurs, 0 when none does."""
    return F.coalesce(
        *[F.when(F.contains(reply, F.lit(m)), F.instr(reply, m)) for m in markers], F.lit(0)
    )


def sign_off_position(reply: Column, markers: Sequence[str] = R.SIGN_OFFS) -> Column:
    """Position of the earliest sign-off that does not open the text, NULL when none."""
    return F.least(*[F.when(F.instr(reply, m) > 1, F.instr(reply, m)) for m in markers])


def drop_trailing_notes(reply: Column, notes: Sequence[str] = R.TRAILING_NOTES) -> Column:
    """Drop everything from a blank line that opens one of the note phrases."""
    opening = "|".join(notes)
    return F.regexp_replace(reply, rf"(?is)\n\n(?:{opening}).*$", "")


def clean_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Raw model texts to bare reply bodies.

    Each step is a column of its own so that later steps reuse it instead of repeating it.
    """
    text, spot, cut = F.col(column), F.col("_spot"), F.col("_cut")
    out = replies.withColumn("_spot", salutation_position(text))
    out = out.withColumn("_body", F.when(spot > 101, F.substr(text, spot)).otherwise(text))
    out = out.withColumn("_cut", sign_off_position(F.col("_body")))
    short = F.when(
        cut.isNotNull(), X.rstrip(F.substr(F.col("_body"), F.lit(1), cut - 1))
    ).otherwise(F.col("_body"))
    bare = F.regexp_replace(short, r"\[Your [^\]]+\]|\(optional\)", "")
    tidy = X.strip(X.squeeze_blank_lines(X.trim_lines(drop_trailing_notes(bare))))
    return out.withColumn(column, tidy).drop("_spot", "_body", "_cut")


def add_signature(reply: Column, settings: Settings = DEFAULTS) -> Column:
    """Append the signature unless the text already carries one of its marks."""
    marks = ("Thanks,", settings.team, settings.support_address)
    tidy = X.trim_lines(reply)
    return F.when(X.contains_any(reply, marks), tidy).otherwise(
        F.concat(X.rstrip(tidy), F.lit("\n\n" + settings.signature))
    )


def customer_name(sender: Column, body: Column) -> Column:
    """Name-like line among the last five, read upward; else the address; else a default."""
    lines = F.split(body, "\n")
    start = F.greatest(F.size(lines) - 4, F.lit(1))
    tail = F.reverse(F.transform(F.slice(lines, start, 5), X.strip))

    def looks_like_name(line: Column) -> Column:
        closing = X.any_of(F.startswith(line, F.lit(p)) for p in R.CLOSING_NAME_LINES)
        return (line != "") & ~closing & (X.word_count(line) <= 3) & ~F.contains(line, F.lit("@"))

    from_body = F.get(F.filter(tail, looks_like_name), F.lit(0))
    local = F.translate(F.split_part(sender, F.lit("@"), F.lit(1)), "._-", "   ")
    spaced = F.array_join(F.transform(X.raw_words(local), F.initcap), " ")
    return F.coalesce(from_body, X.blank_to_null(spaced), F.lit("Customer"))


def feedback_digest(body: Column) -> Column:
    """First three '.'-pieces, trimmed, empties dropped."""
    pieces = F.transform(F.slice(F.split(body, r"\."), 1, 3), X.strip)
    return F.concat(F.array_join(F.filter(pieces, lambda p: p != ""), ". "), F.lit("."))


def clean_digest(digest: Column) -> Column:
    """Strip the known lead-ins and one pair of wrapping quotes."""
    c = X.strip(digest)
    for lead in R.DIGEST_LEADS:
        c = X.strip(F.replace(c, F.lit(lead), F.lit("")))
    wrapped = F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"'))
    return F.when(wrapped, F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def feedback_lines(mails: DataFrame, at: Column, digest: Column | None = None) -> DataFrame:
    """One log line per feedback mail: name | time | text."""
    text = feedback_digest(F.col("body")) if digest is None else clean_digest(digest)
    line = F.concat_ws(
        " | ", customer_name(F.col("sender"), F.col("body")),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss"), text,
    )
    return mails.select("id", "category", line.alias("line"))


def prompt_inputs(body: Column, reply: Column, context: Column, settings: Settings = DEFAULTS) -> Column:
    """Struct (body, reply, context) of what a prompt takes of each text: its first characters; a missing text is empty."""
    def first(text: Column, n: int, name: str) -> Column:
        return F.substring(F.coalesce(text, F.lit("")), 1, n).alias(name)

    return F.struct(
        first(body, settings.prompt_body_chars, "body"), first(reply, settings.prompt_reply_chars, "reply"),
        first(context, settings.prompt_context_chars, "context"))
