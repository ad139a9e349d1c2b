"""Reassembly of chunked messages in Structured Streaming: one state a message, ended when it is whole, wrong, or too old."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "message_id string, payload string, error_code int"
STATE = "count int, indexes array<int>, parts array<string>"


def reassemble_stream(frames: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """message_id, payload, error_code as batch reassembly has them; a set that stays incomplete for ttl_ms ends as 1305."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = lambda payload, code: pd.DataFrame({"message_id": [key[0]], "payload": [payload], "error_code": pd.array([code], "Int32")})
        if state.hasTimedOut:
            state.remove()
            yield one(None, 1305)
            return
        count, indexes, parts = state.get if state.exists else (None, [], [])
        indexes, parts = list(indexes), list(parts)
        code = None
        for pdf in pdfs:
            for i, n, p in zip(pdf["chunk_index"], pdf["chunk_count"], pdf["payload"], strict=True):
                if pd.isna(i) or pd.isna(n) or (count is not None and n != count) or i in indexes:
                    code = code or 1302
                    continue
                count = int(n)
                if i >= max(count, 1):
                    code = code or 1003
                indexes.append(int(i))
                parts.append(p)
        if code or (count and len(indexes) == count):
            if state.exists:
                state.remove()
            yield one(None, code) if code else one("".join(p for _, p in sorted(zip(indexes, parts, strict=True))), None)
            return
        state.update((count, indexes, parts))
        state.setTimeoutDuration(ttl_ms)

    return frames.where("kind = 'chunk'").groupBy("message_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
