"""State by key: the last events of each correspondent, kept on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "email string, direction string, epoch long, events long, seqs array<long>, times array<long>"
_STATE = "epoch long, seqs array<long>, times array<long>"


def last_events(rows: DataFrame, cap: int = 500) -> DataFrame:
    """For each address and direction of a stream (email, direction, epoch, seq, ts_ms): its last ``cap`` events by seq, after each batch.

    An event that comes again counts once. A later epoch clears what a key has, rows of an earlier one don't count;
    a null epoch is 0. Rows of a key stream through: no more than the state and one Arrow batch is held.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, seqs, times = state.get if state.exists else (-1, [], [])
        held = dict(zip(seqs, times, strict=True))
        for frame in frames:
            rows = [(0 if e is None or e != e else int(e), int(s), t) for e, s, t in zip(*(frame[c].tolist() for c in ("epoch", "seq", "ts_ms")), strict=True) if s is not None and s == s]
            newest = max((e for e, _, _ in rows), default=epoch)
            if newest > epoch:
                epoch, held = newest, {}
            held |= {s: t for e, s, t in rows if e == epoch}
            if len(held) > cap:
                held = {s: held[s] for s in sorted(held)[-cap:]}
        held = dict(sorted(held.items()))
        seqs, times = list(held), [None if t is None or t != t else int(t) for t in held.values()]
        state.update((epoch, seqs, times))
        yield pd.DataFrame({"email": [key[0]], "direction": [key[1]], "epoch": [epoch], "events": [len(seqs)], "seqs": [seqs], "times": [times]})

    return rows.select("email", "direction", "epoch", "seq", "ts_ms").groupBy("email", "direction").applyInPandasWithState(keep, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
