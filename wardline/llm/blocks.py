"""Rows that meet in a key: a bounded block is held while any number of rows stream past it."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def meetings(batches: Iterator[pd.DataFrame], key: Sequence[str]) -> Iterator[tuple[pd.DataFrame, int, pd.DataFrame]]:
    """(held, role, passing) from rows sorted by ``key`` and ``role``.

    Rows of role 0 are held until their key ends; rows of each other role come past them in
    pieces of at most one batch. Rows that meet no held row are left out."""
    now, parts, held = None, [], None
    for b in batches:
        if b.empty:
            continue
        new = np.zeros(len(b), bool)
        new[0] = True
        for c in (*key, "role"):
            x = b[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
            piece = b.iloc[s:e]
            k, role = tuple(piece[c].iat[0] for c in key), int(piece["role"].iat[0])
            if k != now:
                now, parts, held = k, [], None
            if role == 0:
                parts.append(piece)
            elif parts:
                held = pd.concat(parts, ignore_index=True) if held is None else held
                yield held, role, piece
