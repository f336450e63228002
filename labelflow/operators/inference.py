"""Batch text generation as a column: pluggable models, retries, one status per row."""

from __future__ import annotations

import hashlib
import math
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_marked
from ..schemas import REPLY
from .portions import bounds

CALLERS = 16  # concurrent calls of one task, for models that take one prompt at a time
WHOLE_CHARS = 1 << 21  # of whole prompts that a templated model holds at once, unless one has more


REPLY_TYPES = {"reply": pa.string(), "attempts": pa.int32(), "status": pa.string(), "error": pa.string()}


class Model(Protocol):
    """``generate_many(prompts, settings)`` may be added by models that answer batches."""

    def generate(self, prompt: str, **settings) -> str | None: ...


@dataclass(frozen=True)
class RetryPolicy:
    """When to ask again. Waits double per try on transient errors; other errors wait once or stop."""

    tries: int = 5
    base_delay: float = 2.0
    pause: float = 1.0
    transient: tuple[str, ...] = ("empty", "rate_limit", "429", "quota", "exhausted")
    ignore_case: bool = True
    retry_other: bool = True
    retry_blank: bool = True

    def is_transient(self, error: str) -> bool:
        text = error.lower() if self.ignore_case else error
        return any(t in text for t in self.transient)


SCORER_RETRY = RetryPolicy()
# Stops at once on errors that are not rate limits, and takes a null reply as an answer.
JUDGE_RETRY = RetryPolicy(
    transient=("rate_limit_exceeded", "429"), ignore_case=False, retry_other=False, retry_blank=False, pause=0.0
)
GENERATE_ONCE = RetryPolicy(tries=1, retry_other=False, retry_blank=False, pause=0.0)
NO_WAIT = RetryPolicy(base_delay=0.0, pause=0.0)


class Pace:
    """The part that one task has in a rate of ``rate`` calls a second for all tasks together.

    Calls get slots on one time line, a slot every ``1 / rate`` seconds, of which task ``share`` of ``shares`` owns each ``shares``-th. Tasks need
    not talk to each other: whatever their number, no two own one slot. Threads of a task take its slots in turn. A slot that passes
    unused is lost, so as many tasks should run at once as there are shares.
    """

    def __init__(self, rate: float, share: int = 0, shares: int = 1, clock: Callable = time.time, sleep: Callable = time.sleep):
        if rate <= 0 or not 0 <= share < shares:
            raise ValueError("a pace needs a positive rate and a share among all shares")
        self.rate, self.share, self.shares, self.clock, self.sleep = rate, share, shares, clock, sleep
        self.last, self.lock = -1, threading.Lock()

    def wait(self, calls: int = 1) -> None:
        """Return when the time of this task's next ``calls`` slots has come."""
        with self.lock:
            now = self.clock() * self.rate
            first = max(math.ceil(now), self.last + 1)
            first += (self.share - first) % self.shares
            self.last = first + (calls - 1) * self.shares
            until = self.last / self.rate
        left = until - self.clock()
        if left > 0:
            self.sleep(left)


def _settled(reply: str | None, error: str | None, attempt: int, retry: RetryPolicy) -> tuple[tuple | None, str | None]:
    """A row's final ``(reply, attempts, status, error)`` after a try, or None and the error to try again for."""
    if error is None:
        if reply is None and not retry.retry_blank:
            return (None, attempt + 1, "null", None), None
        if not retry.retry_blank or (reply and reply.strip()):
            return (reply, attempt + 1, "ok", None), None
        error = "empty response"
    if retry.is_transient(error) or retry.retry_other:
        return ((None, retry.tries, "exhausted", error) if attempt + 1 >= retry.tries else None), error
    return (None, attempt + 1, "failed", error), error


def _wait(error: str, attempt: int, retry: RetryPolicy) -> float:
    return retry.base_delay * (2**attempt if retry.is_transient(error) else 1)


def ask(
    model: Model, prompt: str, settings: dict, retry: RetryPolicy, sleep: Callable = time.sleep, pace: Pace | None = None
) -> tuple:
    """One row: (reply, attempts, status, error). An error of one row never ends the job."""
    for attempt in range(retry.tries):
        reply, error = None, None
        if pace:
            pace.wait()
        try:
            reply = model.generate(prompt, **settings)
        except Exception as problem:  # noqa: BLE001 - recorded as the row's status
            error = str(problem)
        final, error = _settled(reply, error, attempt, retry)
        if final and final[2] == "ok":
            sleep(retry.pause)
        elif error and not (final and final[2] == "failed"):
            sleep(_wait(error, attempt, retry))
        if final:
            return final
    raise ValueError("a retry policy needs one try at least")


def ask_all(
    model: Model,
    rows: list[tuple[str, dict]],
    retry: RetryPolicy,
    callers: int = CALLERS,
    sleep: Callable = time.sleep,
    pace: Pace | None = None,
) -> list[tuple]:
    """All rows of a batch, in order.

    A model with ``generate_many(prompts, settings)`` gets the rows that still need an answer in one call per try; it returns a
    reply or an exception for each. Any other model is asked by ``callers`` threads at once, so that a row's
    waiting holds up no other row. With a ``pace`` every call, and every prompt of a batch, takes a slot of it.
    """
    if not hasattr(model, "generate_many"):
        with ThreadPoolExecutor(min(callers, max(1, len(rows)))) as pool:
            return list(pool.map(lambda row: ask(model, *row, retry, sleep, pace), rows))
    out: list[tuple | None] = [None] * len(rows)
    left = list(range(len(rows)))
    for attempt in range(retry.tries):
        if pace and left:
            pace.wait(len(left))
        try:
            replies = model.generate_many([rows[i][0] for i in left], [rows[i][1] for i in left])
        except Exception as problem:  # noqa: BLE001 - recorded as the status of the rows
            replies = [problem] * len(left)
        waits = [retry.pause]
        for i, reply in zip(left, replies, strict=True):
            failed = isinstance(reply, Exception)
            out[i], error = _settled(None if failed else reply, str(reply) if failed else None, attempt, retry)
            if error and out[i] is None:
                waits.append(_wait(error, attempt, retry))
        left = [i for i in left if out[i] is None]
        sleep(max(waits))
        if not left:
            break
    return out


# Offline models, for tests, benches and dry runs.
class _Immediate:
    """Models that answer without waiting take a whole batch in one call."""

    def generate_many(self, prompts: list[str], settings: list[dict]) -> list:
        return [self.generate(p, **s) for p, s in zip(prompts, settings, strict=True)]


class HashModel(_Immediate):
    """Marked score that follows from the prompt's digest alone."""

    def generate(self, prompt: str, **settings) -> str:
        nibble = int(hashlib.md5(prompt.encode()).hexdigest()[0], 16)
        return f"【最終分數：{1 + nibble % 4}】"


class EchoModel(_Immediate):
    """A wordy rewrite: the rewrite mark, the last quoted text, and a closing comment."""

    def generate(self, prompt: str, **settings) -> str:
        quoted = prompt.rsplit('"', 2)
        sentence = quoted[1] if len(quoted) == 3 else prompt
        return f"改寫為第 1 級：{sentence}\n以上改自原句，未加內容。"


class FlakyModel:
    """Fails on the first tries of a prompt, as its digest says, then answers like HashModel."""

    def __init__(self, error: str = "429 rate_limit_exceeded", most: int = 3):
        self.error, self.most, self.local = error, most, threading.local()

    def generate(self, prompt: str, **settings) -> str:
        key = hashlib.md5(prompt.encode()).hexdigest()
        seen = self.local.__dict__  # a thread asks for one row until that is settled
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= int(key[1], 16) % (self.most + 1):
            raise RuntimeError(self.error)
        del seen[key]
        return HashModel().generate(prompt)


class NullModel(_Immediate):
    def generate(self, prompt: str, **settings) -> None:
        return None


@dataclass(frozen=True)
class ModelSpec:
    """A backend name and its arguments: small, hashable, and sent to the workers instead of the model."""

    backend: Callable
    arguments: tuple = ()

    def build(self) -> Model:
        return self.backend(*self.arguments)


def _many(model: Model, prompts: list[str], settings: list[dict]) -> list:
    """Replies or exceptions of a model that may lack ``generate_many``."""
    if hasattr(model, "generate_many"):
        return model.generate_many(prompts, settings)

    def one(row: tuple) -> str | None | Exception:
        try:
            return model.generate(row[0], **row[1])
        except Exception as problem:  # noqa: BLE001 - recorded as the row's status
            return problem

    with ThreadPoolExecutor(min(CALLERS, max(1, len(prompts)))) as pool:
        return list(pool.map(one, zip(prompts, settings, strict=True)))


class TemplatedModel:
    """A model that is given the sentence only and puts it between two fixed texts.

    A shared prompt part of many kilobytes is then sent to each worker once instead of once per row. Whole prompts are made for so many
    sentences at a time as ``WHOLE_CHARS`` has room for, and an error of one such part is that of its rows alone.
    """

    def __init__(self, inner: ModelSpec, before: str, after: str):
        self.inner, self.before, self.after = inner.build(), before, after

    def generate(self, prompt: str | None, **settings) -> str | None:
        return self.inner.generate(self._whole(prompt), **settings)

    def generate_many(self, prompts: list[str], settings: list[dict]) -> list:
        out: list = []
        while len(out) < len(prompts):
            at, room = len(out), WHOLE_CHARS
            end = at
            while end < len(prompts) and (end == at or room > 0):
                room -= len(self.before) + len(prompts[end] or "") + len(self.after)
                end += room >= 0 or end == at
            try:
                out += _many(self.inner, [self._whole(p) for p in prompts[at:end]], settings[at:end])
            except Exception as problem:  # noqa: BLE001 - recorded as the status of these rows
                out += [problem] * (end - at)
        return out

    def _whole(self, prompt: str | None) -> str | None:
        return None if prompt is None else self.before + prompt + self.after


def templated(model: ModelSpec, before: str, after: str) -> ModelSpec:
    return ModelSpec(TemplatedModel, (model, before, after))


class RoutedModel:
    """Several models behind one, chosen per row by the setting ``model``; each is built when first asked."""

    def __init__(self, *specs: tuple[str, ModelSpec]):
        self.specs, self.built = dict(specs), {}

    def _named(self, model: str) -> Model:
        if model not in self.built:
            self.built[model] = self.specs[model].build()
        return self.built[model]

    def generate(self, prompt: str, model: str, **settings) -> str | None:
        return self._named(model).generate(prompt, **settings)

    def generate_many(self, prompts: list[str], settings: list[dict]) -> list:
        out: list = [None] * len(prompts)
        for name in dict.fromkeys(s["model"] for s in settings):
            own = [i for i, s in enumerate(settings) if s["model"] == name]
            rest = [{k: v for k, v in settings[i].items() if k != "model"} for i in own]
            for i, reply in zip(own, _many(self._named(name), [prompts[i] for i in own], rest), strict=True):
                out[i] = reply
        return out


def routed(models: dict[str, ModelSpec]) -> ModelSpec:
    """One spec for a table whose ``model`` column (passed as a setting) names the model of each row."""
    return ModelSpec(RoutedModel, tuple(models.items()))


@lru_cache(maxsize=8)
def _built(spec: ModelSpec) -> Model:
    """Models live as long as the Python worker, not just for one task."""
    return spec.build()


@dataclass
class ModelRegistry:
    """Choose a backend by model name: exact short names first, then prefix and substring rules in order."""

    short_names: dict[str, str] = field(default_factory=dict)
    rules: list[tuple[Callable[[str], bool], Callable]] = field(default_factory=list)
    fallback: Callable | None = None

    def alias(self, short: str, full: str) -> None:
        self.short_names[short.lower()] = full

    def prefix(self, start: str, backend: Callable) -> None:
        self.rules.append((lambda name: name.startswith(start), backend))

    def contains(self, part: str, backend: Callable, unless: str | None = None) -> None:
        self.rules.append((lambda name: part in name and not (unless and unless in name), backend))

    def resolve(self, name: str) -> ModelSpec:
        """The rules look at the name as given; the backend receives the full name."""
        lower = name.lower()
        backend = next((b for rule, b in self.rules if rule(lower)), self.fallback)
        if backend is None:
            raise ValueError(f"no backend for model {name!r}")
        return ModelSpec(backend, (self.short_names.get(lower, name),))


def generate(
    df: DataFrame,
    model: ModelSpec,
    prompt: str = "prompt",
    retry: RetryPolicy = SCORER_RETRY,
    settings: tuple[str, ...] = (),
    parallelism: int | None = None,
    callers: int = CALLERS,
    rate: float | None = None,
) -> DataFrame:
    """Add ``reply, attempts, status, error`` for every row.

    ``rate`` is the most calls a second of all tasks together, retries included; it needs a ``parallelism``, whose tasks share it (see :class:`Pace`).

    Only the prompt and the setting columns go to Python; all others stay in the JVM. There, prompts become Python objects in portions of
    limited rows and bytes (see ``portions``), each of which is asked before the next. ``parallelism`` is the
    number of tasks and ``callers`` that of concurrent calls in each, set by the service's rate limit and not by the data size. Replies are costly
    and may differ between calls: write the result, or ``cut_lineage`` it, before using it more than once.
    """
    if rate and not parallelism:
        raise ValueError("a rate is shared by a known number of tasks: set parallelism")
    spread = df.repartition(parallelism) if parallelism else df
    names = tuple(settings)

    @F.arrow_udf(REPLY)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = _built(model)
        pace = Pace(rate, TaskContext.get().partitionId(), parallelism) if rate else None
        for batch in batches:
            prompts, *given = batch.flatten()
            replies = []
            for at, n in bounds(prompts):
                values = zip(*[c.slice(at, n).to_pylist() for c in given], strict=True) if given else [()] * n
                rows = [(p, dict(zip(names, v, strict=True))) for p, v in zip(prompts.slice(at, n).to_pylist(), values, strict=True)]
                replies += ask_all(client, rows, retry, callers, pace=pace)
            columns = zip(*replies, strict=True) if replies else [()] * len(REPLY_TYPES)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, REPLY_TYPES.values(), strict=True)]
            yield pa.StructArray.from_arrays(arrays, names=list(REPLY_TYPES))

    asked = run.asNondeterministic()(F.struct(F.col(prompt), *[F.col(c) for c in names]))
    return spread.withColumn("_a", asked).select("*", "_a.*").drop("_a")


def predict_class(df: DataFrame, logits: str = "logits", out: str = "pred") -> DataFrame:
    """Position of the largest logit, the first one on ties."""
    return df.withColumn(out, (F.array_position(F.col(logits), F.array_max(logits)) - 1).cast("int"))


def score_table(
    df: DataFrame,
    model: ModelSpec,
    prompt: Callable[[DataFrame], DataFrame] | str,
    parser: Callable[[DataFrame], DataFrame] = parse_marked,
    retry: RetryPolicy = SCORER_RETRY,
    parallelism: int | None = None,
    ask: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Prompt, reply and parsed score for every row; a failed call scores -3.

    ``prompt`` renders a prompt column or names an existing one. Rows are spread over ``parallelism`` tasks
    before their prompts are rendered, so prompts are not shuffled. ``ask(df, prompt column)`` replaces the plain call of the
    model, e.g. by one with a shared rate or a reply ledger.
    """
    spread = df.repartition(parallelism) if parallelism and not ask else df
    column = prompt if isinstance(prompt, str) else "prompt"
    rendered = spread if isinstance(prompt, str) else prompt(spread)
    answered = ask(rendered, column) if ask else generate(rendered, model, column, retry)
    parsed = parser(answered)
    score = parsed.schema["predicted_score"].dataType if "predicted_score" in parsed.columns else None
    if score is None:
        return parsed
    failed = F.col("status").isin("failed", "exhausted")
    return parsed.withColumn(
        "predicted_score", F.when(failed, F.lit(-3).cast(score)).otherwise(F.col("predicted_score"))
    )
