"""Python work on sorted groups inside a task, one group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd


def per_group(
    keys: Sequence[str], answer: Callable[[pd.DataFrame], pd.DataFrame]
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For `mapInPandas` over rows sorted by `keys`: calls `answer` once per group.

    A task holds one group and one Arrow batch, however many groups it is dealt.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            while len(batch):
                first = batch.iloc[0]
                if waiting and any(waiting[0].iloc[0][k] != first[k] for k in keys):
                    yield answer(pd.concat(waiting, ignore_index=True))
                    waiting = []
                same = np.logical_and.reduce([batch[k].to_numpy() == first[k] for k in keys])
                end = len(batch) if same.all() else int(np.argmin(same))
                waiting.append(batch.iloc[:end])
                batch = batch.iloc[end:]
        if waiting:
            yield answer(pd.concat(waiting, ignore_index=True))

    return run
