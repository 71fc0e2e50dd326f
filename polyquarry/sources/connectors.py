"""Connectors to services: rows go through an injected client, partition by partition, with retries.

The client is a picklable factory that each task calls once, so connections live as long as a task and
no row is called for on the driver. Answers should be written to a cache table keyed by request hash and
joined back (``translation.cache_misses``), as a lost task repeats its calls. Offline stubs stand in
where there is no network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[dict], dict]
#: HTTP states worth another try, besides all of 500 and above.
RETRYABLE = {408, 409, 425, 429}


class ServiceError(Exception):
    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def retryable(status: int) -> bool:
    return status in RETRYABLE or status >= 500


def delay(attempt: int, base: float = 2.0, most: float = 60.0, retry_after: float | None = None) -> float:
    """Seconds before attempt ``attempt + 1``: doubled each time up to a bound; the service's own wish wins."""
    return max(0.0, retry_after) if retry_after is not None else min(most, base * 2 ** (attempt - 1))


def call(client: Client, request: dict, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, int, str | None]:
    """Answer, attempts made and error. Errors that aren't retryable end at once."""
    for n in range(1, attempts + 1):
        try:
            return client(request), n, None
        except ServiceError as e:
            if not retryable(e.status) or n == attempts:
                return None, n, str(e)
            sleep(delay(n, retry_after=e.retry_after))
        except Exception as e:  # noqa: BLE001  (a broken answer counts as an attempt)
            if n == attempts:
                return None, n, repr(e)[:200]
    return None, attempts, "no attempt"


def enrich(rows: DataFrame, key: str, request: str, factory: Callable[[], Client], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``key``, ``answer`` (JSON), ``n_attempts`` and ``error`` for each row's JSON ``request``. Rows
    with the same request are called for once per task. Waits between attempts are as long as the service
    asks; ``sleep`` is for tests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, known = factory(), {}
        for f in frames:
            out = []
            for k, r in zip(f[key], f[request]):
                if r not in known:
                    if len(known) > 10_000:
                        known.clear()
                    answer, n, error = call(client, json.loads(r), attempts, sleep)
                    known[r] = (None if answer is None else json.dumps(answer, ensure_ascii=False, sort_keys=True), n, error)
                out.append((k, *known[r]))
            yield pd.DataFrame(out, columns=[key, "answer", "n_attempts", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, request).mapInPandas(run, f"{key} {kind}, answer string, n_attempts int, error string")


class Rotation:
    """Keys of a service in rotation: every call starts at the next one."""

    def __init__(self, keys: list[str]):
        if not keys:
            raise ValueError("no key")
        self.keys, self.at = keys, 0

    def order(self) -> list[str]:
        out = self.keys[self.at :] + self.keys[: self.at]
        self.at = (self.at + 1) % len(self.keys)
        return out


def chat(post: Callable[[str, dict], dict], keys: list[str], passes: int = 3, sleep: Callable[[float], None] = time.sleep) -> Client:
    """A client of a chat service. ``post`` sends a request with a key. Every key is tried in rotation, the
    whole list up to ``passes`` times with a growing wait between the passes; a service that refuses the
    ``response_format`` (400 or 422) is asked again without it. An answer without text counts as a failure."""
    rotation = Rotation(keys)

    def once(key: str, request: dict) -> dict:
        try:
            return post(key, request)
        except ServiceError as e:
            if e.status not in (400, 422) or "response_format" not in request:
                raise
            return post(key, {k: v for k, v in request.items() if k != "response_format"})

    def ask(request: dict) -> dict:
        last: Exception | None = None
        for n in range(1, passes + 1):
            for key in rotation.order():
                try:
                    answer = once(key, request)
                    if message_text(answer).strip():
                        return answer
                    last = ServiceError(502)
                except ServiceError as e:
                    last = e
            if n < passes:
                sleep(delay(n, retry_after=getattr(last, "retry_after", None)))
        raise last or ServiceError(502)

    return ask


def judge(chat_client: Client, instruction: str) -> Client:
    """A client that has candidates scored: the request as canonical JSON behind the instruction, the
    answer's score checked. An answer that states no score of the five levels is a broken one."""

    def ask(request: dict) -> dict:
        text = message_text(chat_client({"messages": [{"role": "system", "content": instruction}, {"role": "user", "content": json.dumps(request, ensure_ascii=False, sort_keys=True)}], "response_format": {"type": "json_object"}}))
        score = score_of(text)
        if score is None:
            raise ValueError("no score in the answer")
        return {"score": score}

    return ask


def rotate_keys(rows: DataFrame, n_keys: int) -> DataFrame:
    """Each row with the number of the key to use, in rotation within its partition."""
    return rows.withColumn("key_number", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, n_keys))).cast("int"))


def message_text(answer: dict) -> str:
    """The text of a chat answer: plain, or the text parts of a list."""
    content = (answer.get("choices") or [{}])[0].get("message", {}).get("content", answer.get("output_text", ""))
    if isinstance(content, list):
        return "".join(p.get("text", "") for p in content if isinstance(p, dict))
    return content or ""


def message_text_column(answer: Column) -> Column:
    """The same over a column of JSON answers."""
    content = F.get_json_object(answer, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text:string>>")
    listed = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(F.when(F.startswith(F.trim(content), F.lit("[")), listed), content, F.get_json_object(answer, "$.output_text"), F.lit(""))


def score_column(text: Column) -> Column:
    """``score_of`` over a column: a JSON object whose only key is ``score``, a number of the five levels."""
    value = F.get_json_object(text, "$.score")
    number = F.when((F.json_object_keys(text) == F.array(F.lit("score"))) & text.rlike(r'"score"\s*:\s*[0-9.]'), value.try_cast("double"))
    return F.when(number.isin(0.0, 0.25, 0.5, 0.75, 1.0), number)


def score_of(text: str, levels: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> float | None:
    """The score of a judge: a JSON object whose only key is ``score``, a number of the five levels."""
    try:
        v = json.loads(text)
    except ValueError:
        return None
    if not isinstance(v, dict) or list(v) != ["score"] or isinstance(v["score"], bool) or not isinstance(v["score"], (int, float)):
        return None
    return float(v["score"]) if float(v["score"]) in levels else None


def offline_judge() -> Client:
    """A stub judge: the level nearest to the share of common words."""

    def judge(request: dict) -> dict:
        a, b = (set(re.findall(r"\w+", str(request.get(k, "")).lower())) for k in ("expected", "candidate"))
        share = len(a & b) / len(a | b) if a and b else 0.0
        return {"choices": [{"message": {"content": json.dumps({"score": round(share * 4) / 4})}}]}

    return judge


def offline_pages(pages: dict[str, str]) -> Callable[[], Client]:
    """A stub of a page service: plain extracts by title, 404 where there is none."""

    def factory() -> Client:
        def fetch(request: dict) -> dict:
            if request.get("title") not in pages:
                raise ServiceError(404)
            return {"title": request["title"], "extract": pages[request["title"]]}

        return fetch

    return factory
