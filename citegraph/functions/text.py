"""String functions F1-F5, F11, F12."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag prefixes of the tagged bibliography format.
TAG_INDEX = "#index"
TAG_TITLE = "#*"
TAG_ABSTRACT = "#!"
TAG_REFERENCE = "#%"

# Words, numbers, or one mark that is neither space nor word nor number.
# Whitespace is spelled out so Java regex and RE2 (DuckDB) agree exactly.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\t\n\f\r \p{L}\p{N}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def record_lines(record) -> Column:
    """split one record into lines (LF or CRLF)."""
    return F.split(_c(record), r"\r?\n")


def tag_values(lines, prefix: str) -> Column:
    """All values of a repeatable tag, prefix cut (F2)."""
    n = len(prefix)
    return F.transform(
        F.filter(_c(lines), lambda x: x.startswith(prefix)),
        lambda x: F.substring(x, n + 1, 1 << 30),
    )


def tag_value(lines, prefix: str) -> Column:
    """Value of the last line carrying ``prefix`` (NULL when absent)."""
    return F.try_element_at(tag_values(lines, prefix), F.lit(-1))


def to_id(x) -> Column:
    """text id → BIGINT, NULL when it is not an integer."""
    return F.trim(_c(x).cast("string")).try_cast("bigint")


def join_text(title, abstract, sep: str = " ") -> Column:
    """``title + sep + abstract`` with absent parts as ''."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(sep), F.coalesce(_c(abstract), F.lit("")))


def tokenize(text) -> Column:
    """lower-case word, number and punctuation tokens."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def capitalize(x) -> Column:
    """first character raised, all others lowered."""
    return F.concat(F.upper(F.substring(_c(x), 1, 1)), F.lower(F.substring(_c(x), 2, (1 << 31) - 1)))


def format_metric(x, places: int = 4) -> Column:
    """metrics shown to 4 decimals."""
    return F.round(_c(x), places)
