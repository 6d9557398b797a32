"""How many independent bets a set of instruments holds, and a floor that follows the peak."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def effective_bets(cov: DataFrame) -> DataFrame:
    """n long, bets double and mean_vol double of a covariance matrix (code_a, code_b, c): the exponential of the entropy of its
    eigenvalues' shares, beside the mean volatility, which the number of bets doesn't show.

    One task holds the matrix, instruments x instruments, and nothing that grows with the days. Missing and null entries are 0;
    a matrix of zeros has 0 bets; an empty table gives no row.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot_table(index="code_a", columns="code_b", values="c", aggfunc="first", dropna=False).fillna(0.0)
        m = m.reindex(index=m.index.union(m.columns), columns=m.index.union(m.columns), fill_value=0.0).to_numpy()
        share = np.clip(np.linalg.eigvalsh((m + m.T) / 2), 0, None)
        share = share[share > 0] / share.sum() if share.sum() > 0 else share[:0]
        bets = float(np.exp(-(share * np.log(share)).sum())) if len(share) else 0.0
        return pd.DataFrame({"n": [len(m)], "bets": [bets], "mean_vol": [float(np.sqrt(np.clip(np.diag(m), 0, None)).mean())]})

    return cov.where("code_a is not null and code_b is not null").groupBy().applyInPandas(one, "n long, bets double, mean_vol double")


def protect(path: DataFrame, keep: float = 0.9, multiple: float = 3.0) -> DataFrame:
    """A run's returns (run_id, dt, r) behind a floor that follows the peak: run_id, dt, value, floor, exposure.

    The floor is the highest `keep` x value so far. After each day `multiple` times the cushion above it is exposed, between
    nothing and all, and earns the next day's return; the rest is cash. Day one only sets the exposure. A null return is 0.
    """

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt", ignore_index=True)
        value, floor, exposure, out = 1.0, keep, 0.0, []
        for r in np.nan_to_num(g["r"].to_numpy(float)):
            value *= 1 + exposure * r
            floor = max(floor, keep * value)
            exposure = min(1.0, max(0.0, multiple * (value - floor) / value)) if value > 0 else 0.0
            out.append((value, floor, exposure))
        value, floor, exposure = zip(*out)
        return pd.DataFrame({"run_id": key[0], "dt": g["dt"], "value": value, "floor": floor, "exposure": exposure})

    rows = path.where("run_id is not null and dt is not null").select("run_id", "dt", "r")
    return rows.groupBy("run_id").applyInPandas(one, "run_id string, dt date, value double, floor double, exposure double")
