"""Text cleaning as Column expressions.

Each function maps a Column to a Column and mentions its input once, so chains
stay linear in size.  Whitespace and word classes follow the Unicode notion used
by the corpus format, not Java's ASCII defaults.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Encoding debris left by spreadsheet exports, and what it stands for.
ESCAPED_SPACES = (
    ("_x000D_", "\n"),
    ("_x000A_", "\n"),
    ("_x0009_", "\t"),
)
MISDECODED = "â€"
MISDECODED_QUOTES = (
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ('â€"', "—"),
)

# Unicode white space: Java's Unicode-aware \s plus the four ASCII separators.
SPACE = r"\s\x1c-\x1f"


def _replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for debris, meaning in pairs:
        c = F.replace(c, F.lit(debris), F.lit(meaning))
    return c


def remove_artifacts(c: Column) -> Column:
    """Literal replacements, in the listed order.

    The second group shares a two-letter prefix, so texts without that prefix
    skip its four passes.
    """
    return _replace_all(
        F.when(c.contains(MISDECODED), _replace_all(c, MISDECODED_QUOTES)).otherwise(c), ESCAPED_SPACES
    )


def normalize_newlines(c: Column) -> Column:
    """Blank-line runs to one blank line first, then CRLF and CR to LF."""
    c = F.regexp_replace(c, rf"(?U)\n[{SPACE}]*\n", "\n\n")
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return F.replace(c, F.lit("\r"), F.lit("\n"))


def nfkc(c: Column) -> Column:
    """Unicode NFKC, inside the JVM, through the ICU library Spark ships.

    Null gives the empty string, like every cleaning step.  ASCII texts skip the call, which
    goes by reflection; the planner moves no filter below it, so select rows before cleaning.
    """
    text = F.coalesce(c, F.lit(""))
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7f]"), composed).otherwise(text)


def collapse_ws(c: Column) -> Column:
    """Every run of white space becomes one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U)[{SPACE}]+", " "))


def lowercase(c: Column) -> Column:
    return F.lower(c)


def strip_punct(c: Column) -> Column:
    """Everything but letters, numbers, underscore becomes white space, collapsed."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "))


def trimmed(c: Column) -> Column:
    """Unicode-aware strip of both ends."""
    return F.regexp_replace(c, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def clean_text(
    c: Column,
    *,
    artifacts: bool = True,
    unicode_form: bool = True,
    whitespace: bool = True,
    lower: bool = False,
    punctuation: bool = False,
) -> Column:
    """The composite cleaning; null gives the empty string."""
    c = F.coalesce(c, F.lit(""))
    if artifacts:
        c = remove_artifacts(c)
        if not whitespace:
            # With white space collapsed anyway the newline rules cannot show.
            c = normalize_newlines(c)
    if whitespace:
        c = collapse_ws(c)
    if unicode_form:
        c = nfkc(c)
        if whitespace:
            # Runs are collapsed before NFKC, on fewer characters.  NFKC adds no white
            # space but a plain space in front of a spacing accent, so at most pairs.
            c = F.trim(F.replace(c, F.lit("  "), F.lit(" ")))
    if lower:
        c = lowercase(c)
    if punctuation:
        c = strip_punct(c)
    return c


def fill_template(template: str, **fields: Column) -> Column:
    """``template.format(**fields)`` as one ``concat``.

    The template is parsed once on the driver, so braces inside the data are
    never substituted again.
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if spec or conversion:
                raise ValueError(f"format specifications are not supported: {name}")
            parts.append(fields[name])
    return F.concat(*parts) if parts else F.lit("")


# Markers and wording of an untemplated training prompt.
OPEN_MARK = "[INST]"
CLOSE_MARK = "[/INST]"
PROMPT = "Summarize:\n{text}\nSummary:"


def prompt_text(c: Column) -> Column:
    """Keep text that already carries the instruction marks, wrap the rest."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.contains(OPEN_MARK) & c.contains(CLOSE_MARK), c).otherwise(
        fill_template(PROMPT, text=c)
    )
