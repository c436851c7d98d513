"""Calls to a service outside, from a table: a window of calls in flight, a deadline for each, failures as rows.

The service is a function from text to text, or several of them: the next is asked where
one fails, is late or gives nothing that is accepted. Answers come in the order of the
rows; a slow call holds up only what a task has begun after it, up to ``AHEAD`` windows.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ask = Callable[[str], str | None]
#: Calls in flight in a task; seconds of one.
WINDOW, SECONDS = 12, 60.0
#: Rows that a task takes up before the first of them is done, in windows; rows of a result batch.
AHEAD, ROWS = 4, 256


def one_call(ask: Ask, prompt: str, seconds: float) -> tuple[str | None, str | None]:
    """(answer, error) of one call; a call past its deadline is left behind and its answer is not taken."""
    done: Future = Future()

    def call() -> None:
        try:
            done.set_result(ask(prompt))
        except BaseException as e:  # noqa: BLE001  one failed call isn't the job's failure
            done.set_exception(e)

    # not of a pool, which would wait for one that never ends
    threading.Thread(target=call, daemon=True).start()
    try:
        return done.result(seconds), None
    except TimeoutError as e:
        return None, "deadline" if not done.done() else f"{type(e).__name__}: {e}"
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def chained(asks: Sequence[Ask], prompt: str | None, seconds: float, accept: Callable[[str], bool]) -> tuple[str | None, str | None, int | None]:
    """(answer, error, which) of the first function that gives an accepted answer; error: why each one before it didn't."""
    if prompt is None:
        return None, "no prompt", None
    errors = []
    for k, ask in enumerate(asks):
        answer, error = one_call(ask, prompt, seconds)
        if error is None and isinstance(answer, str) and accept(answer):
            return answer, "; ".join(errors) or None, k
        errors.append(error or ("no answer" if not answer else "answer not accepted"))
    return None, "; ".join(errors), None


def in_order(prompts: Iterator, call: Callable, window: int) -> Iterator[tuple]:
    """(key, what call gives) of (key, prompt), in order, with at most window calls at once."""
    with ThreadPoolExecutor(window) as pool:
        begun: deque = deque()
        for key, prompt in prompts:
            begun.append((key, pool.submit(call, prompt)))
            while begun and (begun[0][1].done() or len(begun) >= AHEAD * window):
                key, future = begun.popleft()
                yield key, future.result()
        for key, future in begun:
            yield key, future.result()


def asked(rows: DataFrame, ask: Ask | Sequence[Ask], prompt: str = "prompt", window: int = WINDOW, seconds: float = SECONDS, tasks: int | None = None, accept: Callable[[str], bool] = bool) -> DataFrame:
    """rows with answer, error and asked (the number of the function that answered).

    Each row gives a row. answer is null where every function failed, was late or gave
    nothing accepted, or the prompt is null; error then says why, and also where only a later
    function answered. tasks: partitions, so that at most tasks * window calls are in flight;
    as rows are dealt, if not given. A row may be asked again if its executor is lost.
    """
    asks = list(ask) if isinstance(ask, Sequence) else [ask]
    kept = [c for c in rows.columns if c not in ("answer", "error", "asked")]
    own = rows.select(F.struct(*[rows[c] for c in kept]).alias("row"), F.col(prompt).alias("prompt"))
    own = own.repartition(tasks) if tasks else own

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prompts() -> Iterator[tuple]:
            for batch in it:
                for k, p in enumerate(batch.column(1).to_pylist()):
                    yield batch.column(0).slice(k, 1), p

        def out(found: list[tuple]) -> pa.RecordBatch:
            answers, errors, which = zip(*[x for _, x in found], strict=True)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x for x, _ in found]), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(which, pa.int32())], names=["row", "answer", "error", "asked"])

        found: list[tuple] = []
        for x in in_order(prompts(), lambda p: chained(asks, p, seconds, accept), window):
            found.append(x)
            if len(found) == ROWS:
                yield out(found)
                found = []
        if found:
            yield out(found)

    none = F.lit(None)
    schema = own.select("row", none.cast("string").alias("answer"), none.cast("string").alias("error"), none.cast("int").alias("asked")).schema
    found = own.mapInArrow(run, schema)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "answer", "error", "asked")
