"""Cyclic palette assignment: the i-th row in key order gets colour ``i mod 24``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceboard.operators.ranking import id_cell, ordinal, tuning

# --- fixed values: the 24-colour qualitative palette, in cycle order --------------
PALETTE = (
    "#2E91E5", "#E15F99", "#1CA71C", "#FB0D0D", "#DA16FF", "#222A2A", "#B68100", "#750D86",
    "#EB663B", "#511CFB", "#00A08B", "#FB00D1", "#FC0080", "#B2828D", "#6C7C32", "#778AAE",
    "#862A16", "#A777F1", "#620042", "#1616A7", "#DA60CA", "#6C4516", "#0D2A63", "#AF0038",
)
# ----------------------------------------------------------------------------------

KEY_CELL = 1 << 16


def cycle_palette(df: DataFrame, key: str, out: str, palette: tuple[str, ...] = PALETTE) -> DataFrame:
    """Add ``out`` = palette[(rank of ``key`` - 1) mod len(palette)].

    The rank is global (the whole table in key order) but computed with the cell-bucketed
    ``ordinal``, so no single task has to see the table whole.
    """
    ranked = ordinal(df, [], [F.col(key).asc()], "__rank", cells=[(id_cell(key, tuning(df, "idCell", KEY_CELL)), True)])
    colours = F.array(*[F.lit(c) for c in palette])
    return ranked.withColumn(out, F.element_at(colours, (F.col("__rank") - 1) % len(palette) + 1)).drop("__rank")
