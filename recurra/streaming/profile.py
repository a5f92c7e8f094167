"""An incremental nearest-neighbour profile: every arriving sample ends a window, which is compared with all earlier ones of its series.

signal rows (series, dim, t, v) as a stream, in order of t within a series; state per (series, dim): the samples so
far. Result rows in append mode: (series, dim, i, j, d), the nearest earlier window j at least `w` before i.

`keep` bounds the state to that many samples before each batch; rows then also have `since`, the first window that
still could be compared, since nearer ones may have been dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from recurra.functions import kernels

SCHEMA = "series string, dim int, i long, j long, d double"
BLOCK = 512


def incremental_profile(stream: DataFrame, w: int, metric: str = "detrended", keep: int | None = None) -> DataFrame:
    schema = SCHEMA if keep is None else SCHEMA + ", since long"
    names = [x.split()[0] for x in schema.split(", ")]

    def step(key, frames, state):
        t0, old = state.get if state.exists else (0, [])
        new = pd.concat(list(frames)).sort_values("t")
        start = len(old)
        x = np.array([*old, *new["v"]], float)
        if not state.exists and len(new):
            t0 = int(new["t"].iloc[0])
        out = []
        if len(x) >= w:
            s = kernels.Series(x, w)
            first = max(0, start - w + 1)
            for a in range(first, len(s.windows), BLOCK):
                d = np.sqrt(kernels.squared(s, a, min(a + BLOCK, len(s.windows)), metric))
                for k in range(a, a + len(d)):
                    row = np.round(d[k - a, : max(0, k - w + 1)], 6)
                    if len(row) and not np.isnan(row).all():
                        j = int(np.nanargmin(row))
                        out.append((key[0], key[1], t0 + k, t0 + j, float(row[j]), t0))
        gone = 0 if keep is None else max(0, len(x) - keep)
        state.update((t0 + gone, x[gone:].tolist()))
        yield pd.DataFrame(out, columns=["series", "dim", "i", "j", "d", "since"]).astype({"dim": "int32", "i": "int64", "j": "int64", "d": "float64", "since": "int64"})[names]

    return stream.groupBy("series", "dim").applyInPandasWithState(step, schema, "t0 long, x array<double>", "append", "NoTimeout")
