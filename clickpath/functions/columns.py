"""Column expressions: cleaning, coercion, URL paths, calendar and segment rules.

Everything here returns a ``pyspark.sql.Column`` built from Spark built-ins, so
it stays inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING = "unknown"

# Whole-value replacements applied to a category after stripping
# (case-sensitive). ``None`` stands for "the missing label".
CATEGORY_REPLACEMENTS = {
    "": None,
    "<Other>": "other",
    "(not set)": "not set",
    "nan": None,
    "None": None,
}

# URL schemes whose last path segment may carry ";params", which
# the standard URL parser splits off the path (Python's urllib.parse list).
SCHEMES_WITH_PARAMS = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps",
    "rtspu", "sip", "sips", "mms", "sftp", "tel",
]

# The seven intent segments, in rule order.
INTENT_SEGMENTS = [
    "Purchasers",
    "Checkout abandoners",
    "Cart abandoners",
    "Product detail browsers",
    "Discovery-only browsers",
    "Shallow low-intent sessions",
    "General visitors",
]

_NUMBER_RE = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
# groups: 1 scheme, 3 network location, 4 path (query / fragment excluded)
_URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters that count as white space at the ends of a text (Unicode, not only ASCII), as a class of a
# regular expression and one by one.
WHITE_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WHITE_SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                      0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space (tabs, newlines and Unicode blanks too, unlike plain ``trim``); looks at the ends only."""
    return F.btrim(col_of(c), F.lit(WHITE_SPACE_CHARS))


def nan_to_null(c: Column | str) -> Column:
    """NaN becomes NULL so that aggregates and sorting treat it as missing."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_number(c: Column | str) -> Column:
    """Parse text as a double; anything unparseable becomes NULL, never an error."""
    s = strip(col_of(c).cast("string"))
    return nan_to_null(F.when(s.rlike(_NUMBER_RE), s.try_cast("double")))


def safe_divide(num: Column, den: Column) -> Column:
    """``num / den``, NULL when the denominator is 0 or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


# Money and durations are summed as decimals, so a sum is exact and the same in whatever
# order partitions arrive (a re-executed task gives identical results), up to 1e29.
# Values that no decimal can hold (infinite ones) count as missing.
EXACT = "decimal(38,9)"


def exact_sum(c: Column | str) -> Column:
    """Order-independent sum of a measure with up to 9 decimals, as double (NULL if no value)."""
    return F.sum(col_of(c).cast("double").try_cast(EXACT)).cast("double")


def exact_avg(c: Column | str) -> Column:
    """Mean of a measure: its exact sum over the number of values."""
    value = col_of(c).cast("double").try_cast(EXACT)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def clean_category(c: Column | str, missing: str = MISSING) -> Column:
    """Null -> missing label; strip; map the whole-value replacement table."""
    c = col_of(c)
    s = strip(c.cast("string"))
    table = F.create_map(*[x for raw, new in CATEGORY_REPLACEMENTS.items()
                           for x in (F.lit(raw), F.lit(missing if new is None else new))])
    return F.when(c.isNull(), F.lit(missing)).otherwise(F.coalesce(F.try_element_at(table, s), s))


def landing_path(c: Column | str, max_len: int = 140) -> Column:
    """Path of a landing URL.

    The parsed path is used only when the text has a scheme or a network
    location; otherwise the stripped raw text (query string included) is kept.
    An empty path becomes ``/``; null or blank input becomes ``(missing)``;
    the result is cut to ``max_len`` characters. One regular expression splits
    scheme, network location and path (query and fragment excluded); ``;params``
    after the last ``/`` are dropped for the schemes that carry them.
    """
    text = strip(col_of(c).cast("string"))
    url = F.regexp_replace(text, "[\t\r\n]", "")
    scheme = F.regexp_extract(url, _URL_RE, 1)
    netloc = F.regexp_extract(url, _URL_RE, 3)
    path = F.regexp_extract(url, _URL_RE, 4)
    path = F.when(F.lower(scheme).isin(SCHEMES_WITH_PARAMS), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    chosen = F.when((scheme != "") | (netloc != ""), F.when(path == "", F.lit("/")).otherwise(path)).otherwise(text)
    return F.when(text.isNull() | (text == ""), F.lit("(missing)")).otherwise(F.substring(chosen, 1, max_len))


def weekday_name(d: Column | str) -> Column:
    d = col_of(d)
    return F.coalesce(F.date_format(d, "EEEE"), F.lit(MISSING))


def month_label(d: Column | str) -> Column:
    d = col_of(d)
    return F.coalesce(F.date_format(d, "yyyy-MM"), F.lit(MISSING))


def is_weekend(d: Column | str) -> Column:
    """Saturday or Sunday -> 1; weekday or missing date -> 0."""
    d = col_of(d)
    return F.coalesce(F.weekday(d).isin(5, 6).cast("int"), F.lit(0))


def intent_segment(
    purchase: Column | str = "converted_purchase",
    checkout: Column | str = "reached_checkout",
    cart: Column | str = "reached_cart",
    detail: Column | str = "reached_product_detail",
    discovery: Column | str = "reached_product_discovery",
    bounce: Column | str = "bounce_like_session",
) -> Column:
    """First matching rule wins, in the order of ``INTENT_SEGMENTS``."""
    rules = [purchase, checkout, cart, detail, discovery, bounce]
    expr = None
    for flag, label in zip(rules, INTENT_SEGMENTS):
        cond = F.coalesce(col_of(flag), F.lit(0)) == 1
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(INTENT_SEGMENTS[-1]))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, NULL counted as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))
