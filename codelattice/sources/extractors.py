"""A place for a parser of your own in front of the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codelattice.model import SYMBOLS


def extract_symbols(files: DataFrame, extract: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Symbols from ``extract``, which gets Arrow batches of ``file_path, language, text`` and yields symbol rows.

    For users who have a real parser; ``text_units.symbol_table`` needs no Python.
    """
    return files.select("file_path", "language", "text").mapInPandas(extract, SYMBOLS)
