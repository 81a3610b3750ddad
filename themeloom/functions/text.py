"""Column -> Column text functions (inventory X1-X22).

Every function here is a composition of built-in Spark SQL expressions, so it
stays inside whole-stage codegen; there is no Python on the row path.

Regex notes (SURVEY P9): Python's ``\\s`` is Unicode-aware, Java's is not, so
patterns that must treat a no-break space as whitespace carry ``(?U)``.
``trim`` only strips U+0020, so a Unicode-aware strip is a regex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Punctuation set of the duplicated-punctuation rule (X2), in its own order:
#   ! ( ) - { } ; : , < > . / ? @ # $ % ^ & * _ ~
# Leading word removed by X4: "Abstract" / "abstract", followed by at most one of
#   , . ! ? ; : -
# HTML tag pattern (X5): "<" then one or more non-">" then ">".
# Heading pattern (X9): digits, ".", optional spaces, then either a **bold**
#   run or a run without ":" and "*", then ":".
# Answer line clean-up (X11): a leading "digits." and every "*".
# ---------------------------------------------------------------------------
PUNCT_CLASS = r"[!()\-{};:,<>./?@#$%\^&*_~]"
DUP_PUNCT = "(" + PUNCT_CLASS + ")" + PUNCT_CLASS + "+"
LEADING_ABSTRACT = r"^[Aa]bstract[,.!?;:\-]?"
HTML_TAG = r"<[^>]+>"
HEADING = r"\d+\.\s*(\*\*.*?\*\*|[^:*]*):"
ANSWER_MARKS = r"^\d+\.|[*]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Unicode-aware strip (Python ``str.strip()``)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def remove_line_breaks(c) -> Column:
    """Drop CR and LF, joining the pieces with no space."""
    return F.regexp_replace(_c(c), r"\r|\n", "")


def collapse_punctuation(c) -> Column:
    """A run of two or more marks from the set becomes its first mark."""
    return F.regexp_replace(_c(c), DUP_PUNCT, "$1")


def collapse_whitespace(c) -> Column:
    """Whitespace runs -> one space, then strip."""
    return strip_ws(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def drop_leading_abstract(c, whole_word: bool = False) -> Column:
    """Remove a leading "Abstract" and one mark after it.

    With the default ``whole_word=False`` the reference behaviour is kept
    ("Abstraction" -> "ion", and a following space stays).
    """
    pat = LEADING_ABSTRACT if not whole_word else r"^[Aa]bstract\b[,.!?;:\-]?"
    return F.regexp_replace(_c(c), pat, "")


def strip_html_tags(c) -> Column:
    """Remove ``<...>`` tags."""
    return F.regexp_replace(_c(c), HTML_TAG, "")


def clean_abstract(c, tags_first: bool = False, whole_word: bool = False) -> Column:
    """X1 -> X2 -> X3 -> X4 -> X5.

    The reference collapses punctuation before it strips tags, which damages
    adjacent tags (``<p>one</p><p>two</p>`` -> ``onep>two``). That order is the
    default; ``tags_first=True`` strips tags first.
    """
    x = _c(c)
    if tags_first:
        x = strip_html_tags(x)
    x = remove_line_breaks(x)
    x = collapse_punctuation(x)
    x = collapse_whitespace(x)
    x = drop_leading_abstract(x, whole_word)
    if not tags_first:
        x = strip_html_tags(x)
    return x


def title_abstract(title, abstract) -> Column:
    """Title + (". " or " " when the title already ends with ".") + abstract."""
    t = _c(title)
    return F.concat(t, F.when(t.endswith("."), F.lit(" ")).otherwise(F.lit(". ")), _c(abstract))


# The byte-pair vocabulary of the reference's tokenizer is not available
# offline, so the count is an estimate: letter runs, digit runs of at most three
# and runs of other non-space marks, the pre-token classes of that tokenizer.
PRETOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def token_count_estimate(c) -> Column:
    """Estimated token count (pre-tokens; a lower bound on BPE tokens)."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(PRETOKEN), 0)).cast("bigint")


def theme_headings(c) -> Column:
    """All ``N. heading:`` headings of a text, bold marks and trailing
    dots / colons removed, stripped, lower-cased."""
    found = F.regexp_extract_all(_c(c), F.lit(HEADING), 1)
    return F.transform(
        found,
        lambda h: F.lower(strip_ws(F.regexp_replace(
            F.regexp_replace(h, r"^\*\*(.*?)\*\*$", "$1"), r"[.:]+$", ""))),
    )


def first_heading(c) -> Column:
    """The first heading or null."""
    return F.try_element_at(theme_headings(c), F.lit(1))


def clean_answer_line(c) -> Column:
    """X11: strip a leading ``N.`` and every asterisk (no trim)."""
    return F.regexp_replace(_c(c), ANSWER_MARKS, "")


def conclusion(lines) -> Column:
    """The last line when it starts with an ASCII letter, else null."""
    last = F.try_element_at(_c(lines), F.lit(-1))
    return F.when(last.rlike("^[A-Za-z]"), last)


def answer_lines(c) -> Column:
    """Split an answer on LF and drop empty lines."""
    return F.filter(F.split(_c(c), "\n"), lambda x: x != "")


def text_from_inverted_index(c) -> Column:
    """Word -> positions map back to text (words ordered by position)."""
    pairs = F.flatten(F.transform(
        F.map_entries(_c(c)),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word"))),
    ))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["word"]), " ")


def parse_list_text(c, element_type: str = "double") -> Column:
    """List stored as text (``"[0.1, 0.2]"``) back to an array."""
    return F.from_json(_c(c), f"array<{element_type}>", {"allowSingleQuotes": "true"})


def citation_band(c, q25, q50, q75, zero_na: bool = False) -> Column:
    """Citation size band from the (int-truncated) quartiles.

    ``5-{a-1}``, ``{a}-{b-1}``, ``{b}-{c-1}``, ``{c}+``; null falls in the last
    band. With ``zero_na`` a count of exactly 0 is ``NA`` and only positive
    counts below ``a`` take the first band (X18).
    """
    x = _c(c)
    a, b, cc = (F.floor(_c(q)).cast("bigint") for q in (q25, q50, q75))
    s = lambda v: v.cast("string")
    first = F.concat(F.lit("5-"), s(a - 1))
    second = F.concat(s(a), F.lit("-"), s(b - 1))
    third = F.concat(s(b), F.lit("-"), s(cc - 1))
    last = F.concat(s(cc), F.lit("+"))
    if zero_na:
        return (F.when(x == 0, F.lit("NA"))
                .when((x > 0) & (x < a), first)
                .when((x >= a) & (x < b), second)
                .when((x >= b) & (x < cc), third)
                .otherwise(last))
    return (F.when(x < a, first)
            .when((x >= a) & (x < b), second)
            .when((x >= b) & (x < cc), third)
            .otherwise(last))


def keyword_list(c, trim_only: bool = False) -> Column:
    """Comma-separated keywords to a list. The reference removes every
    space ("machine learning" -> "machinelearning"); ``trim_only`` keeps inner
    spaces."""
    if trim_only:
        return F.transform(F.split(_c(c), ","), lambda k: strip_ws(k))
    return F.split(F.regexp_replace(_c(c), " ", ""), ",")


def heading_label(heading, model, temperature) -> Column:
    """``heading, (model, temperature)``."""
    return F.format_string("%s, (%s, %s)", _c(heading), _c(model), _c(temperature))


def parse_name_description(c) -> Column:
    """Typed parse of a ``{"name": ..., "description": ...}`` response.
    Input that is not whole gives a null struct, so callers can flag it."""
    p = F.from_json(_c(c), "name string, description string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(p["_bad"].isNull(), F.struct(p["name"].alias("name"), p["description"].alias("description")))


def space_tokens(c) -> Column:
    """Split on single spaces; empty tokens are kept (Python ``split(" ")``)."""
    return F.split(_c(c), " ")


def whitespace_tokens(c) -> Column:
    """Split on whitespace runs, no empty tokens (Python ``split()``)."""
    s = strip_ws(_c(c))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def snake_case(name: str) -> str:
    """F17 for a column name: non-word runs -> ``_``, lower, trim ``_``."""
    import re

    return re.sub(r"\W+", "_", name).lower().strip("_")
