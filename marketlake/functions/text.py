"""Text predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space, plus the four separator controls that count as space in text feeds.
_SPACE = r"(?U)^[\s\x1c-\x1f]"


def is_blank(c: Column) -> Column:
    """Empty, or white space only (no-break space and tabs included).

    Most texts show by their first character that they are not blank; only the others are searched whole.
    """
    first = F.substring(c, 1, 1)
    return (first == "") | (first.rlike(_SPACE) & c.rlike(_SPACE + "*$"))
