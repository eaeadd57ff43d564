"""Score-driven filters over streams: the state of a series is one number and its last time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.backend import num
from ..functions.families import Copula
from ..operators.recursions import gas_start, gas_update


def gas_stream(df: DataFrame, copula: Copula, key: str, time: str, u: str, v: str, params: tuple[float, float, float], watermark: str = "1 hour") -> DataFrame:
    """``key, time, g, r, log_pdf`` for each row of a stream with pseudo-observations.

    Rows of a series must arrive in order: those at or before the last seen time are left out, as a
    recursion cannot be re-ordered. Within a batch rows are sorted. State survives restarts in the
    checkpoint of the query.
    """
    omega, gamma, beta = params
    link = copula.base.link(copula.link)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g, last = state.get if state.exists else (gas_start(omega, beta), None)
        pdf = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for row in pdf.itertuples(index=False):
            at = getattr(row, time)
            stamp = pd.Timestamp(at).value
            if last is not None and stamp <= last:
                continue
            a, b = getattr(row, u), getattr(row, v)
            r = float(link.forward(num, pd.Series([g]).to_numpy())[0])
            out.append((group[0], at, g, r, float(copula.log_pdf(num, a, b, r))))
            g, last = float(gas_update(num, copula, a, b, g, omega, gamma, beta)), stamp
        state.update((g, last))
        yield pd.DataFrame(out, columns=[key, time, "g", "r", "log_pdf"])

    return df.withWatermark(time, watermark).groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, g double, r double, log_pdf double", "g double, last long", "append", GroupStateTimeout.NoTimeout
    )
