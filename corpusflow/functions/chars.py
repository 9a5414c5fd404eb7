"""Unicode facts about characters, as a table made from Python's own database."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _facts() -> pd.DataFrame:
    rows = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Cn":
            continue
        name = unicodedata.name(char, None)
        rows.append((char, category, name.split()[0] if name else None, name or f"{category}:{code:x}"))
    return pd.DataFrame(rows, columns=["char", "category", "script_word", "char_name"])


def characters(spark: SparkSession, columns: list[str]) -> DataFrame:
    """``(char, category, script_word, char_name)`` of every assigned character.

    Its size is that of Unicode, about 300,000 rows, whatever the corpus; private-use
    and unnamed characters have no script word.
    """
    return spark.createDataFrame(_facts()[["char", *columns]])
