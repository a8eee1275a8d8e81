"""Operators on a stream: the row-local ones as they are, and scores of pairs whose sides arrive apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veridane.operators.clean import clean
from veridane.operators.extract import decide
from veridane.operators.validate import problems


def started(out: DataFrame, target: str, state: str) -> StreamingQuery:
    """Takes all that lies in the source and ends; run again, with the same state, it takes what is new since."""
    return out.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(target)


def decide_stream(spark: SparkSession, source: str, target: str, state: str, schema: str) -> StreamingQuery:
    """Decisions of responses (column raw)."""
    return started(decide(spark.readStream.schema(schema).parquet(source)), target, state)


def clean_stream(spark: SparkSession, source: str, target: str, state: str, schema: str) -> StreamingQuery:
    """Cleaned records of questions (statements as entries)."""
    return started(clean(spark.readStream.schema(schema).parquet(source)), target, state)


def validate_stream(spark: SparkSession, source: str, target: str, state: str, schema: str) -> StreamingQuery:
    """Problems of questions (statements as entries)."""
    return started(problems(spark.readStream.schema(schema).parquet(source)), target, state)


PAIR = "model string, pair_id long, sides long, passed boolean, flipped boolean"
#: What is known of a pair: right sides so far, and each side's expected label and decision.
KNOWN = "sides long, passed boolean, a_expected string, a_decision string, b_expected string, b_decision string"


def scored(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A pair's score once both sides are there, or, of one that stays alone, once its time is over."""
    sides, passed, *labels = state.get if state.exists else (0, True, None, None, None, None)
    late = state.hasTimedOut
    last = 0
    for frame in frames if not late else ():
        for row in frame.itertuples(index=False):
            at = 0 if row.side == "A" else 2
            labels[at : at + 2] = row.expected, row.decision
            sides, passed = sides + 1, passed and row.decision is not None and row.decision == row.expected
        last = max(last, int(frame["until"].max()))
    if late or sides >= 2:
        if state.exists:
            state.remove()
        a, da, b, db = labels
        flipped = da != db if None not in labels and a != b else None
        yield pd.DataFrame({"model": [key[0]], "pair_id": [key[1]], "sides": [sides], "passed": [passed], "flipped": pd.array([flipped], "boolean")})
    else:
        state.update((sides, passed, *labels))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))


def pair_stream(spark: SparkSession, source: str, target: str, state: str, wait: str = "1 day") -> StreamingQuery:
    """(model, pair_id, sides, passed, flipped) of responses (model, pair_id, side, expected, decision, at) whose sides arrive in any order and in different batches.

    One row of state a pair, kept until its other side comes or the watermark, `wait`
    behind the latest response, is `wait` past its own time; then it is scored by the side
    that came. flipped is null where there is no second side or both expect the same.
    Each side comes once.
    """
    schema = "model string, pair_id long, side string, expected string, decision string, at timestamp"
    responses = spark.readStream.schema(schema).parquet(source).withColumn("until", F.unix_millis(F.expr(f"at + INTERVAL {wait}"))).withWatermark("at", wait)
    pairs = responses.groupBy("model", "pair_id").applyInPandasWithState(scored, PAIR, KNOWN, "append", GroupStateTimeout.EventTimeTimeout)
    return started(pairs, target, state)
