"""Predicates and text transforms over text columns, as Spark SQL expressions.

Each is written once, as SQL text over a column's SQL name, so that a finding's evidence query is the expression the
profile measured with. Use expr(...) or pass the text to F.expr for a Column. Guards keep casts from reading more
into a text than is written there: '12d' is no number, '2024' no date.
"""

from __future__ import annotations

import re
import string

# Texts, and numbers, that stand for a missing value.
TEXT_SENTINELS = ("n/a", "n.a.", "na", "null", "nil", "none", "-", "--", "?", "??", "unknown", "unspecified", "tbd", "tbc",
                  "not applicable", "not available", "#n/a", "missing", ".")
NUMERIC_SENTINELS = ("-1", "-99", "-999", "-9999", "999", "9999", "99999", "999999", "9999999", "0000-00-00")

# Date formats as (label, Spark pattern, shape that a text must have).
DATE_FORMATS = (
    ("ISO 8601 (YYYY-MM-DD)", "yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("day first (DD/MM/YYYY)", "d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("month first (MM/DD/YYYY)", "M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("year first with slashes (YYYY/MM/DD)", "yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"),
    ("day first with dashes (DD-MM-YYYY)", "d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"),
    ("month first with dashes (MM-DD-YYYY)", "M-d-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"),
    ("day first with dots (DD.MM.YYYY)", "d.M.yyyy", r"\d{1,2}\.\d{1,2}\.\d{4}"),
    ("compact (YYYYMMDD)", "yyyyMMdd", r"\d{8}"),
    ("day with short month name", "d MMM yyyy", r"\d{1,2} [A-Z][a-z]{2} \d{4}"),
    ("short month name first", "MMM d, yyyy", r"[A-Z][a-z]{2} \d{1,2}, \d{4}"),
    ("day first, two-digit year", "d/M/yy", r"\d{1,2}/\d{1,2}/\d{2}"),
    ("month first, two-digit year", "M/d/yy", r"\d{1,2}/\d{1,2}/\d{2}"),
)
# The formats that count as a date when kinds are inferred (places in DATE_FORMATS), besides ISO.
INFERENCE_FORMATS = (1, 2, 4, 6, 3, 7)
# Shapes of the letters of a Spark pattern; days and months that no calendar has are left out.
FIELDS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "[A-Z][a-z]{2}", "MM": "(?:0[1-9]|1[0-2])", "M": "(?:0?[1-9]|1[0-2])", "dd": r"(?:0[1-9]|[12]\d|3[01])", "d": r"(?:0?[1-9]|[12]\d|3[01])"}
#: The shape of each of DATE_FORMATS, less days and months that none of its dates has: a failed parse costs an exception, so few get there.
DATE_SHAPES = tuple(re.sub("y+|M+|d+|[^\\w]", lambda m: FIELDS.get(m[0]) or re.escape(m[0]), pattern) for _, pattern, _ in DATE_FORMATS)
DATE = r"\d{4}-\d{1,2}-\d{1,2}"
TIMESTAMP = r"\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?"
NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?"
#: What the cast to boolean takes, with the characters it strips: any other text would cost it an exception.
BOOLEAN = r"(?i)[\x00-\x20\x7f]*(?:t|true|y|yes|1|f|false|n|no|0)[\x00-\x20\x7f]*"
KINDS = ("integer", "decimal", "date", "timestamp", "boolean")


def ident(name: str) -> str:
    """A column or table name quoted for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as a Spark SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def full_match(c: str, pattern: str) -> str:
    return f"{c} RLIKE {literal('^(?:' + pattern + ')$')}"


def non_blank(c: str) -> str:
    return f"({c} IS NOT NULL AND trim({c}) <> '')"


def normalized(c: str) -> str:
    return f"lower(trim({c}))"


def is_sentinel(c: str) -> str:
    return f"lower(trim({c})) IN {in_list(TEXT_SENTINELS)}"


def is_numeric_sentinel(c: str) -> str:
    return f"lower(trim({c})) IN {in_list(NUMERIC_SENTINELS)}"


def is_integer(c: str) -> str:
    return full_match(f"trim({c})", "[+-]?[0-9]{1,18}")


def number(c: str) -> str:
    """The text as a double, null if it is not written as a number."""
    return f"CASE WHEN {full_match(f'trim({c})', NUMBER)} THEN try_cast(trim({c}) AS DOUBLE) END"


def is_decimal(c: str) -> str:
    return f"({number(c)}) IS NOT NULL"


def is_boolean(c: str) -> str:
    return f"({full_match(f'trim({c})', BOOLEAN)} AND try_cast(trim({c}) AS BOOLEAN) IS NOT NULL)"


def parse_date(c: str, i: int) -> str:
    """The text as a timestamp under the i-th of DATE_FORMATS, null if it does not fit."""
    text, pattern = f"trim({c})", DATE_FORMATS[i][1]
    return f"CASE WHEN {full_match(text, DATE_SHAPES[i])} THEN try_to_timestamp({text}, {literal(pattern)}) END"


def iso_date(c: str) -> str:
    return f"CASE WHEN {full_match(f'trim({c})', DATE)} THEN try_cast(trim({c}) AS DATE) END"


def is_date(c: str) -> str:
    any_of = " OR ".join([f"({iso_date(c)}) IS NOT NULL", *(f"({parse_date(c, i)}) IS NOT NULL" for i in INFERENCE_FORMATS)])
    return f"(length(trim({c})) BETWEEN 8 AND 12 AND ({any_of}))"  # 8 to 10, and a line end that the shapes let pass


def timestamp(c: str) -> str:
    return f"CASE WHEN {full_match(f'trim({c})', TIMESTAMP)} THEN try_cast(trim({c}) AS TIMESTAMP) END"


def is_timestamp(c: str) -> str:
    return f"({timestamp(c)}) IS NOT NULL"


def is_ambiguous_date(c: str) -> str:
    """Day first and month first both read it, as different days."""
    return f"coalesce(({parse_date(c, 1)}) <> ({parse_date(c, 2)}), false)"


OF_KIND = {"integer": is_integer, "decimal": is_decimal, "boolean": is_boolean, "date": is_date, "timestamp": is_timestamp}


#: ASCII digits, white space and letters, and what stands for them in a shape.
ASCII_CLASSES = ("012345678\t\n\x0b\f\r" + string.ascii_letters, "9" * 9 + " " * 5 + "X" * 52)


def shape(c: str) -> str:
    """Digits as 9, letters as X, white space as a space. ASCII texts, whose letters are known, go without regular expressions."""
    any_text = rf"regexp_replace(regexp_replace(regexp_replace({c}, '\\p{{Nd}}', '9'), '\\p{{L}}', 'X'), '\\s', ' ')"
    return f"CASE WHEN octet_length({c}) = char_length({c}) THEN translate({c}, {', '.join(map(literal, ASCII_CLASSES))}) ELSE {any_text} END"


#: A word boundary in which only ASCII letters, digits and _ make words, as \\w does; Java's own boundary also counts other letters.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def mask(c: str) -> str:
    """E-mail addresses, US social security numbers and long numbers replaced by their kind."""
    # The three patterns and their names.
    for pattern, name in ((r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}", "[email]"), (r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)", "[national-id]"), (r"(?<!\w)(?:\d[ -]?){12,}\d?" + EDGE, "[long-number]")):
        c = f"regexp_replace({c}, {literal(pattern)}, '{name}')"
    return c


def redacted(c: str, show_values: bool = False, shape_cut: int = 60, value_cut: int = 120) -> str:
    """What may be shown of a cell: its shape between angle brackets, or the masked value where values may be shown."""
    if show_values:
        return f"CASE WHEN length({mask(c)}) > {value_cut} THEN concat(left({mask(c)}, {value_cut}), '…') ELSE {mask(c)} END"
    s = shape(c)
    return f"concat('⟨', CASE WHEN length({s}) > {shape_cut} THEN concat(left({s}, {shape_cut}), '…') ELSE {s} END, '⟩')"


def glob(pattern: str, name: str) -> bool:
    """Whether a name fits a pattern in which * stands for any text; case does not matter."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name, re.IGNORECASE | re.DOTALL) is not None
