"""Rows of two results as comparable text, whatever their order."""

import math


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}"
    return str(x)


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(cell, r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))
