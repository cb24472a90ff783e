"""Rows as order-free, type-tolerant text."""

import numpy as np
import pandas as pd


def text(x) -> str:
    if isinstance(x, list | tuple | np.ndarray):
        return "[" + ",".join(map(text, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{text(v)}" for k, v in sorted(x.items())) + "}"
    if x is None or (not isinstance(x, str) and pd.isna(x)):
        return "-"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, float | np.floating) and float(x).is_integer() or isinstance(x, int | np.integer):
        return str(int(x))
    return str(x)


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted("|".join(text(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert x == y, [(p, q) for p, q in zip(x, y, strict=True) if p != q][:3]
