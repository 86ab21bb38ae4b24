"""Requests to a model as a distributed map: render, call, parse, try again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.keep import hash_order


class Retryable(Exception):
    """The call may succeed when it is made again."""


def answered(call: Callable[[str], str], parse: Callable[[str], list[str] | None], prompt: str, calls: int, asks: int, pause: float) -> tuple:
    """``(status, reason, attempts, raw, items)`` of one prompt.

    A retryable error is met with up to ``calls`` calls, twice as long apart each time; an answer
    that can't be parsed (None) is asked for up to ``asks`` times. Failure never looks like an empty list.
    """
    attempts, raw, reason = 0, None, "schema"
    for _ in range(asks):
        for k in range(calls):
            attempts += 1
            try:
                raw = call(prompt)
                break
            except Retryable:
                time.sleep(pause * 2**k)
            except Exception as error:  # not worth another call
                return "failed", type(error).__name__, attempts, raw, None
        else:
            return "failed", "network", attempts, raw, None
        items = parse(raw)
        if items is not None:
            return "ok", None, attempts, raw, items
    return "failed", reason, attempts, raw, None


def completing(call: Callable[[str], str], ask: Callable[[str, str], str], more: Callable[[str, str], str], rounds: int = 2) -> Callable[[str], str]:
    """A call that goes on where an answer isn't complete.

    After each answer ``ask(prompt, so_far)`` is called; unless its answer begins with a Y, in
    either case, the end is reached, else ``more(prompt, so_far)`` is added on a new line, ``rounds`` times at most.
    """

    def run(prompt: str) -> str:
        answer = call(prompt)
        for _ in range(rounds):
            if not (call(ask(prompt, answer)) or "").lstrip().upper().startswith("Y"):
                break
            answer = f"{answer}\n{call(more(prompt, answer))}"
        return answer

    return run


def within_budget(df: DataFrame, key: str, most: int, bins: int = 3) -> DataFrame:
    """The ``most`` rows that come first in hash order of a unique ``key``: what a budget of calls allows, the same in every run.

    Rows are counted in 16 to the power ``bins`` parts of the order, and only those of the part in
    which the budget ends are ranked. A null key comes last.
    """
    order = F.coalesce(hash_order(F.col(key)), F.lit("g"))
    rows = df.withColumn("__order", order).withColumn("__bin", F.substring("__order", 1, bins))
    counts = rows.groupBy("__bin").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__bin")) - F.col("__n")).where(F.col("__before") < most)
    placed = rows.join(F.broadcast(before), "__bin")  # 16 ** bins + 1 rows at most
    whole = placed.where(F.col("__before") + F.col("__n") <= most)
    last = placed.where(F.col("__before") + F.col("__n") > most).withColumn("__place", F.row_number().over(Window.partitionBy("__bin").orderBy("__order")))
    return whole.select(*df.columns).union(last.where(F.col("__before") + F.col("__place") <= most).select(*df.columns))


def label(df: DataFrame, key: str, prompt: str, call: Callable[[str], str], parse: Callable[[str], list[str] | None], parallel: int,
          done: DataFrame | None = None, calls: int = 3, asks: int = 3, pause: float = 1.0, progress: Accumulator | None = None) -> DataFrame:
    """``(key, status, reason, attempts, raw, items)`` for every row whose key isn't ``done``.

    ``parallel`` tasks make calls at a time. A lost task makes its calls again; write the result
    with ``append_missing`` and pass what is there as ``done`` to go on after a stop. ``progress``
    grows by the rows of every task that ends; those of tasks that are repeated may count twice.
    """
    rows = df.select(key, prompt)
    if done is not None:
        rows = rows.join(done.where("status = 'ok'").select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if progress is not None:
                progress.add(len(frame))
            found = [answered(call, parse, p, calls, asks, pause) for p in frame[prompt]]
            yield pd.DataFrame(found, columns=["status", "reason", "attempts", "raw", "items"]).assign(**{key: frame[key].values})[
                [key, "status", "reason", "attempts", "raw", "items"]
            ]

    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(parallel).mapInPandas(run, f"`{key}` {kind}, status string, reason string, attempts int, raw string, items array<string>")
