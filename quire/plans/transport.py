"""Calls to a model client from executors: retries, bounded concurrency, structured replies.

No client is bundled. A factory is sent to the executors and makes one client per task;
a client is a function from a prompt to ``(text, finish_reason, usage dict)``.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[str], tuple[str, str, dict]]
ATTEMPTS, LONGEST_WAIT = 10, 60.0
FINISHED, CUT_OFF = "finished", "max_output_reached"


def wait(attempt: int, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before attempt ``attempt + 1``: doubling, with up to a second of jitter, capped."""
    return min(2.0**attempt + jitter(), LONGEST_WAIT)


def retried(client: Client, prompt: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, dict, int]:
    """``(text, finish, usage, attempts)``; after the last failure the text is ``Error`` and the finish ``error``."""
    for i in range(attempts):
        try:
            text, reason, usage = client(prompt)
            return text, CUT_OFF if reason == "length" else FINISHED, usage, i + 1
        except Exception:
            if i + 1 < attempts:
                sleep(wait(i))
    return "Error", "error", {}, attempts


def structured(client: Client, prompt: str, required: list[str], attempts: int = 2) -> dict:
    """A reply that must be a JSON object with the required keys, asked for at most twice.

    The latency is that of all attempts, the usage that of the last one.
    """
    began, value, usage, error = time.perf_counter(), None, {}, "no reply"
    for _ in range(attempts):
        text, _, usage = client(prompt)
        try:
            found = json.loads(text)
            if isinstance(found, dict) and all(k in found for k in required):
                value, error = found, None
                break
            error = "missing keys"
        except ValueError as e:
            error = str(e)
    return {"value": value, "usage": usage, "latency": round(time.perf_counter() - began, 4), "error": error}


def ask(prompts: DataFrame, factory: Callable[[], Client], at_once: int = 8, attempts: int = ATTEMPTS, pause: float = 1.0) -> DataFrame:
    """``prompts(id, prompt)`` -> ``id, reply, finish, attempts, total_tokens``; at most ``at_once`` calls per task.

    A prompt that keeps failing is a row with finish ``error``; it fails no task. Repartition
    the input to bound the calls of the whole cluster. ``pause`` scales the waits between attempts.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        with ThreadPoolExecutor(at_once) as pool:
            for d in it:
                got = list(pool.map(lambda p: retried(client, p, attempts, lambda s: time.sleep(s * pause)), d["prompt"]))
                yield pd.DataFrame({
                    "id": d["id"], "reply": [g[0] for g in got], "finish": [g[1] for g in got],
                    "attempts": [g[3] for g in got], "total_tokens": [int(g[2].get("total_tokens", 0)) for g in got],
                })

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, reply string, finish string, attempts int, total_tokens long")


def ask_structured(prompts: DataFrame, factory: Callable[[], Client], required: list[str], attempts: int = 2) -> DataFrame:
    """``prompts(id, prompt)`` -> ``id, value, error, total_tokens``; ``value`` is the reply's JSON object as text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for d in it:
            got = [structured(client, p, required, attempts) for p in d["prompt"]]
            yield pd.DataFrame({
                "id": d["id"], "value": [None if g["value"] is None else json.dumps(g["value"]) for g in got],
                "error": [g["error"] for g in got], "total_tokens": [int(g["usage"].get("total_tokens", 0)) for g in got],
            })

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, value string, error string, total_tokens long")
