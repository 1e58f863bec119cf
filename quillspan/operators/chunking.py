"""Word windows that never cross a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import words

#: Variants by name: window size and overlap in words.
VARIANTS = {"c100": (100, 0), "c200": (200, 0), "c200o50": (200, 50), "c300": (300, 0)}


def chunked(pages: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """``key``, ``k`` (from 0), ``n_words`` and ``body`` of every window. Windows start every size - overlap words and
    end with the first that reaches the end of the page; pages without words have none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    split = pages.select(key, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(step))
    windows = F.transform(starts, lambda at: F.slice("w", at + 1, size))
    return split.select(key, F.posexplode(windows).alias("k", "window")).select(key, "k", F.size("window").alias("n_words"), F.array_join("window", " ").alias("body"))
