"""Chunks of tables of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.chunking import CHUNKERS, MOST, TARGET, format_of

SCHEMA = "id {}, mode string, pos int, chunk string, first_line int, last_line int"


def chunked(items: DataFrame, mode: str = "auto", target: int = TARGET, most: int = MOST) -> DataFrame:
    """Chunks of items (id, text): by their format where the mode is "auto", by turns where it is unknown. Items that need no cut give no rows; null texts count as empty."""
    kind = dict(items.dtypes)["id"]
    how = format_of(F.col("text")) if mode == "auto" else F.lit(mode if mode in CHUNKERS else "turns")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, m, n, *c) for i, t, m in zip(pdf["id"], pdf["text"], pdf["mode"], strict=True) for n, c in enumerate(CHUNKERS[m](t or "", target, most))]
            out = pd.DataFrame(rows, columns=["id", "mode", "pos", "chunk", "first_line", "last_line"])
            out[["first_line", "last_line"]] = out[["first_line", "last_line"]].astype("Int32")
            yield out

    return items.select("id", "text", how.alias("mode")).mapInPandas(run, SCHEMA.format(kind))
