"""Text normalisation with a replacement dictionary."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def normalise(text, replacements: dict[str, str] | None = None) -> Column:
    """Fold white space and case, drop end punctuation, then replace whole words in dictionary order.

    White space and word limits follow Unicode.
    """
    out = F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))
    out = F.trim(F.regexp_replace(F.lower(out), r"[?.!]+$", ""))
    for word, full in (replacements or {}).items():
        safe = full.replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, r"(?U)\b" + re.escape(word) + r"\b", safe)
    return out
