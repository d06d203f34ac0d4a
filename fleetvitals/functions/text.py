"""Text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_name(name: Column) -> Column:
    """A name in square brackets, closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def base_name(path: Column, separator: str = "\\") -> Column:
    """The part of a path after its last separator; the whole path when there is none."""
    return F.substring_index(path, separator, -1)


def fixed_width(value: Column, width: int) -> Column:
    """Blank-padded text of exactly ``width`` characters; a longer value is an error."""
    text = value.cast("string")
    too_long = F.length(F.rtrim(text)) > width
    message = F.concat(F.lit(f"value longer than {width} characters: "), text)
    return F.when(too_long, F.raise_error(message)).otherwise(F.rpad(text, width, " "))


def format_datetime(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def fill(template: str, **parts: Column | str) -> Column:
    """Text with ``{name}`` places filled from columns; NULL when any filled column is NULL."""
    pieces = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            value = parts[piece[1:-1]]
            pieces.append(value if isinstance(value, Column) else F.lit(value))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)
