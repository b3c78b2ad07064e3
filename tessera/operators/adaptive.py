"""The deterministic shell around clients that answer questions: rounds, requests, budget, retries, tiers, pools, errors as values."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a client must be: a function from (prompt, round) to {"answer": text, "more": text or None, "tokens": int}; it may raise.
Client = Callable[[str, int], dict]


class Fatal(Exception):
    """A failure after which no further call makes sense, such as a refused key. A client raises it, or `fatal` finds it."""


def converse(
    rows: DataFrame, key: str, prompt: str, client: Client | Sequence[Client], rounds: int = 4, retries: int = 2, budget: int = 100_000, wait: float = 0.0,
    resolve: Callable[[str], str | None] | None = None, workers: int = 1, fatal: Callable[[Exception], bool] | None = None,
) -> DataFrame:
    """Columns `key, answer, rounds, retries, tokens, stopped, error`, one row per row.

    A conversation goes on while the client asks for more, up to `rounds`; it stops once its tokens reach `budget`. What
    it asks for is looked up by `resolve`, and told to be missing where that knows nothing; it stops (`unresolved`) when a
    round brings nothing but that. A failed call is tried again with doubled waiting, then with the next client, if several are
    given. What fails for good is an error of its row, never of the job; after a fatal failure the rows of a task that
    haven't begun are `skipped`. `workers` conversations of a task run at once; rows keep their order. Null prompts are `empty`.
    """
    clients = [client] if callable(client) else list(client)

    def ask(text: str, n: int) -> tuple[dict | None, int, Exception | None]:
        again, failure = 0, None
        for tier in clients:
            for attempt in range(retries + 1):
                try:
                    return tier(text, n), again, None
                except Exception as e:  # noqa: BLE001 - a client may fail in any way
                    failure = e
                    if isinstance(e, Fatal) or fatal and fatal(e):
                        return None, again, Fatal(str(e))
                    if attempt < retries:
                        again += 1
                        time.sleep(wait * 2**attempt)
        return None, again, failure

    def talk(text: str, stop: threading.Event) -> tuple:
        used, again, answer = 0, 0, None
        if stop.is_set():
            return None, 0, 0, 0, "skipped", "a call before failed for good"
        for n in range(1, rounds + 1):
            reply, tried, failure = ask(text, n)
            again += tried
            if failure is not None:
                if isinstance(failure, Fatal):
                    stop.set()
                return answer, n, again, used, "error", str(failure)[:200]
            used, answer = used + reply.get("tokens", 0), reply.get("answer")
            if not reply.get("more"):
                return answer, n, again, used, "answered", None
            if used >= budget:
                return answer, n, again, used, "budget", None
            found = resolve(reply["more"]) if resolve else reply["more"]
            if found is None and text.endswith(f"\nnot available: {reply['more']}"):
                return answer, n, again, used, "unresolved", None
            text = f"{text}\n{found}" if found is not None else text + f"\nnot available: {reply['more']}"
        return answer, rounds, again, used, "rounds", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop = threading.Event()
        one = lambda t: talk(t, stop) if isinstance(t, str) else (None, 0, 0, 0, "empty", None)
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for batch in batches:
                said = list(pool.map(one, batch["prompt"])) if workers > 1 else list(map(one, batch["prompt"]))
                yield pd.DataFrame([(k, *s) for k, s in zip(batch["key"], said)], columns=["key", "answer", "rounds", "retries", "tokens", "stopped", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")).mapInPandas(run, f"key {kind}, answer string, rounds int, retries int, tokens long, stopped string, error string")


def loose_find(text: Column, wanted: Column) -> Column:
    """Where `wanted` stands in `text`: its only exact place, else the only lines that equal it but for blanks around them; null if there are none or several."""

    @F.pandas_udf("struct<start:int,end:int,exact:boolean>")
    def find(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        out = []
        for t, w in zip(texts, parts):
            row = (None, None, None)
            if isinstance(t, str) and isinstance(w, str) and w.strip():
                if t.count(w) == 1:
                    row = (t.index(w), t.index(w) + len(w), True)
                elif not t.count(w):
                    lines, need = t.split("\n"), [x.strip() for x in w.strip("\n").split("\n")]
                    at = [i for i in range(len(lines) - len(need) + 1) if [x.strip() for x in lines[i : i + len(need)]] == need]
                    if len(at) == 1:
                        start = sum(len(x) + 1 for x in lines[: at[0]])
                        row = (start, start + len("\n".join(lines[at[0] : at[0] + len(need)])), False)
            out.append(row)
        return pd.DataFrame(out, columns=["start", "end", "exact"])

    return find(text, wanted)
