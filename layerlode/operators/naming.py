"""Names of topics: the namer's interface, an offline namer, reading its replies, and telling alike names apart."""

from __future__ import annotations

import asyncio
import inspect
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlode.schemas import UNLABELLED

_ENDS = r'"topic_specificity"\s*:\s*[^\s{}]+\s*\}'
NAME_REPLY = r'(?s)\{\s*"topic_name".*?' + _ENDS
SUMMARY_REPLY = r'(?s)\{\s*"topic_analysis".*?"topic_name".*?' + _ENDS
#: Escapes that JSON knows, each held by a control character while other backslashes are doubled.
ESCAPES = tuple((f"\\{c}", chr(i)) for i, c in enumerate('\\"/bfnrtu', 1))
MOST_TOPICS_PER_PROMPT, MOST_ALIKE, FAR = 12, 4, 0.2
_NEAR = 1e-6


class InvalidInput(ValueError):
    """The prompt itself is at fault; asking again can't help."""


class FailFast(RuntimeError):
    """The service can't be used (credentials, quota); the run ends."""


class Namer(Protocol):
    """A reply to each prompt, in order. Called in tasks: it must be picklable and bound its own concurrency."""

    def reply(self, prompts: list[str]) -> list[str]: ...


class TemplateNamer:
    """Deterministic and offline: a name of the prompt's first keywords, or of its main subtopics."""

    def __init__(self, words: int = 3):
        self.words = words

    def reply(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        if '"new_topic_name_mapping"' in prompt:
            blocks = re.findall(r"(?m)^(\d+)\. (.*)\n(?:Keywords: (.*))?", prompt)
            mapping = {f"{i}. {old}": ", ".join(dict.fromkeys([old, *(k.split(", ")[: int(i)] if k else [f"no. {i}"])])) for i, old, k in blocks}
            return json.dumps({"new_topic_name_mapping": mapping, "topic_specificities": [0.5] * len(mapping)}, ensure_ascii=False)
        found = re.search(r"(?m)^Keywords: (.*)$", prompt) or re.search(r"(?m)^Main subtopics: (.*)$", prompt)
        name = " / ".join(re.split(r"[,;] ", found.group(1))[: self.words]) if found else "Topic"
        if '"topic_summary"' in prompt:
            return json.dumps({"topic_analysis": f"Keywords were read for {name}.", "topic_summary": f"A group on {name}.", "topic_name": name, "topic_specificity": 0.5}, ensure_ascii=False)
        return json.dumps({"topic_name": name, "topic_specificity": 0.5}, ensure_ascii=False)


class CallableNamer:
    """Any function of one prompt, plain or a coroutine, as a namer; at most ``concurrency`` calls run at once."""

    def __init__(self, call: Callable, concurrency: int = 10):
        self.call, self.concurrency = call, concurrency

    def reply(self, prompts: list[str]) -> list[str]:
        if not inspect.iscoroutinefunction(self.call):
            with ThreadPoolExecutor(self.concurrency) as pool:
                return list(pool.map(self.call, prompts))

        async def every() -> list[str]:
            gate = asyncio.Semaphore(self.concurrency)

            async def one(prompt: str) -> str:
                async with gate:
                    return await self.call(prompt)

            return list(await asyncio.gather(*map(one, prompts)))

        return asyncio.run(every())


class BatchNamer:
    """A service that takes prompts in bulk: ``submit(prompts)`` gives a ticket, ``status(ticket)`` says "done" in the end,
    ``results(ticket)`` gives replies by position. An item that failed (None) is an empty reply."""

    def __init__(self, submit: Callable, status: Callable, results: Callable, cancel: Callable | None = None, poll: float = 60.0, timeout: float = 7200.0):
        self.submit, self.status, self.results, self.cancel, self.poll, self.timeout = submit, status, results, cancel, poll, timeout

    def reply(self, prompts: list[str]) -> list[str]:
        ticket, began = self.submit(prompts), time.monotonic()
        while self.status(ticket) != "done":
            if time.monotonic() - began > self.timeout:
                if self.cancel is not None:
                    self.cancel(ticket)
                raise TimeoutError(f"the batch {ticket} wasn't done in {self.timeout} seconds")
            time.sleep(self.poll)
        return [r or "" for r in self.results(ticket)]


def ask(namer: Namer, prompts: list[str], attempts: int = 3, wait: Callable[[int], float] = lambda i: min(10.0, 2.0**i)) -> list[tuple[str, str | None]]:
    """(reply, error) of each prompt. A batch is tried again whole, then prompt by prompt; what fails is empty with its error.

    ``FailFast`` ends the run and ``InvalidInput`` isn't tried again.
    """

    def once(own: list[str]) -> list[str]:
        out = namer.reply(own)
        if len(out) != len(own):
            raise ValueError(f"{len(out)} replies to {len(own)} prompts")
        return out

    def tried(own: list[str]) -> list[str]:
        for i in range(attempts):
            try:
                return once(own)
            except (FailFast, InvalidInput):
                raise
            except Exception:
                if i + 1 == attempts:
                    raise
                time.sleep(wait(i))
        raise ValueError("attempts must be at least 1")

    try:
        return [(r, None) for r in tried(prompts)]
    except FailFast:
        raise
    except Exception as whole:
        if len(prompts) == 1:
            return [("", f"{type(whole).__name__}: {whole}")]
        return [x for p in prompts for x in ask(namer, [p], attempts, wait)]


def replies(prompts: DataFrame, namer: Namer, text: Column, keys: list[str], batch: int = 32, attempts: int = 3) -> DataFrame:
    """(keys..., reply, error): ``namer`` asked within tasks, ``batch`` prompts at once; the partitions bound concurrency.

    A task that is run again asks again: write the result before it is read twice.
    """
    own = prompts.select(*keys, text.alias("_prompt"))
    kinds = ", ".join(f"{c} {t}" for c, t in own.drop("_prompt").dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                found = ask(namer, part["_prompt"].tolist(), attempts)
                yield part[keys].assign(reply=[r for r, _ in found], error=[e for _, e in found])

    return own.mapInPandas(run, f"{kinds}, reply string, error string")


def connected(namer: Namer) -> str:
    """A reply to a short request, or "<error>" with what went wrong."""
    reply, error = ask(namer, ["Say hello."], attempts=1)[0]
    return f"<error> {error}" if error else reply


def repaired_backslashes(text: Column) -> Column:
    """Backslashes that begin no JSON escape are doubled."""
    for escape, held in ESCAPES:
        text = F.replace(text, F.lit(escape), F.lit(held))
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for escape, held in ESCAPES:
        text = F.replace(text, F.lit(held), F.lit(escape))
    return text


def parsed_field(reply: Column, field: str, pattern: str = NAME_REPLY) -> Column:
    """A field of the first JSON object in a reply that ``pattern`` finds; lone backslashes are repaired where the object
    isn't JSON without it. Null where there is none."""
    found = F.regexp_extract(reply, pattern, 0)
    path = f"$.{field}"
    return F.when(found == "", F.lit(None).cast("string")).otherwise(F.coalesce(F.get_json_object(found, path), F.get_json_object(repaired_backslashes(found), path)))


def renamed(reply: Column, old_names: Column) -> Column:
    """New names by position: the mapping's value for "i. old", else for "i.", else the old name. Null where the reply has
    no mapping, or one of another length whose values can't be matched up."""
    mapping = F.from_json(F.get_json_object(reply, "$.new_topic_name_mapping"), "map<string,string>")
    by_key = F.transform(old_names, lambda old, i: F.coalesce(F.element_at(mapping, F.concat((i + 1).cast("string"), F.lit(". "), old)), F.element_at(mapping, F.concat((i + 1).cast("string"), F.lit("."))), old))
    inner = F.regexp_extract(reply, r'"new_topic_name_mapping"\s*:\s*\{([^{}]*)\}', 1)
    values = F.regexp_extract_all(inner, F.lit(r'"[^"]*"\s*:\s*"([^"]*)"'), F.lit(1))
    return F.when(F.size(mapping) == F.size(old_names), by_key).when(F.size(values) == F.size(old_names), values)


def apply_renames(names: DataFrame, renames: DataFrame) -> DataFrame:
    """``names(layer, cluster, name)`` with names from ``renames(layer, clusters, new_names)`` where there are any."""
    pairs = renames.where("new_names is not null").select("layer", F.explode(F.arrays_zip("clusters", "new_names")).alias("p"))
    new = pairs.groupBy("layer", F.col("p.clusters").alias("cluster")).agg(F.min("p.new_names").alias("_new"))
    return names.join(new, ["layer", "cluster"], "left").select("layer", "cluster", F.coalesce(F.when(F.col("_new") != "", F.col("_new")), F.col("name")).alias("name"))


def repeated_names(names: DataFrame, least: int = 3) -> DataFrame:
    """(layer, name, n): names that ``least`` clusters of a layer or more share; they ask for another round of renaming."""
    return names.groupBy("layer", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def names_of_objects(assignments: DataFrame, names: DataFrame) -> DataFrame:
    """(object_id, layer, name), "Unlabelled" for noise and for clusters without a name."""
    own = assignments.join(names.select("layer", "cluster", "name"), ["layer", "cluster"], "left")
    return own.select("object_id", "layer", F.coalesce("name", F.lit(UNLABELLED)).alias("name"))


def names_wide(assignments: DataFrame, names: DataFrame, layers: int) -> DataFrame:
    """object_id and a column layer_0, layer_1, ... of names."""
    long = names_of_objects(assignments, names)
    return long.groupBy("object_id").pivot("layer", list(range(layers))).agg(F.first("name")).select("object_id", *[F.col(str(i)).alias(f"layer_{i}") for i in range(layers)])


def complete_linkage(distances: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) in order; rows are numbered first, merges after them. Ties: the lower pair.

    Each row keeps the nearest of the rows after it; a merge only raises distances, so no row is searched again but those
    whose nearest was merged.
    """
    n = len(distances)
    own = distances.astype(float).copy()
    own[np.tril_indices(n)] = np.inf  # a pair is held by its lower row
    near = own.argmin(axis=1) if n else np.zeros(0, dtype=np.int64)
    least = own[np.arange(n), near]
    number, sizes, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i = int(np.argmin(least))
        j = int(near[i])
        d = float(own[i, j])
        out.append((min(number[i], number[j]), max(number[i], number[j]), d, sizes[i] + sizes[j]))
        # Distances of the merged row i: the larger of both, in whichever half of the table they lie.
        own[:i, i] = np.maximum(own[:i, i], own[:i, j])
        own[i, i + 1 : j] = np.maximum(own[i, i + 1 : j], own[i + 1 : j, j])
        own[i, j + 1 :] = np.maximum(own[i, j + 1 :], own[j, j + 1 :])
        own[:, j] = np.inf
        own[j, :] = np.inf
        least[j] = np.inf
        again = np.flatnonzero((near == i) | (near == j))
        for r in {i, *again[np.isfinite(least[again])].tolist()} - {j}:
            near[r] = int(own[r].argmin())
            least[r] = own[r, near[r]]
        sizes[i] += sizes[j]
        number[i] = n + step
    return out


def rename_threshold(distances: np.ndarray, most: int = MOST_ALIKE, far: float = FAR, merges: list[tuple[int, int, float, int]] | None = None) -> float:
    """Where to cut a complete linkage: before a group gets more than ``most`` members, duplicates not counting, or at the
    first merge farther than ``far``, else at the last."""
    merges = complete_linkage(distances) if merges is None else merges
    for i, (_, _, d, size) in enumerate(merges):
        before = merges[i - 1][2] if i else merges[-1][2]
        if size > most and before > _NEAR:
            return before if i else d
        if d > far:
            return d
    return merges[-1][2] if merges else 0.0


def rename_groups_of(vectors: np.ndarray, most: int = MOST_ALIKE, far: float = FAR) -> np.ndarray:
    """A group number for each row, -1 for rows alone, from merges under the threshold."""
    n = len(vectors)
    if n < 2:
        return np.full(n, -1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors, dtype=float), where=norms > 0)
    distances = np.clip(1 - unit @ unit.T, 0, 2)
    merges = complete_linkage(distances)
    cut = rename_threshold(distances, most, far, merges)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    for step, (a, b, d, _) in enumerate(merges):
        if d >= cut and d > _NEAR:
            break
        members[n + step] = members.pop(a) + members.pop(b)
    out = np.full(n, -1)
    for k, own in enumerate(sorted((sorted(m) for m in members.values() if len(m) > 1), key=lambda m: m[0])):
        out[own] = k
    return out


def rename_groups(names: DataFrame, vectors: DataFrame, most: int = MOST_ALIKE, far: float = FAR) -> DataFrame:
    """(layer, cluster, group_id) of clusters whose names lie so near to others' that they should be told apart.

    ``vectors(layer, cluster, v)`` are the names' embeddings. A layer's topics fit a task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster")
        found = rename_groups_of(np.stack(rows["v"].to_numpy()), most, far)
        return rows[["layer", "cluster"]].assign(group_id=found)[found >= 0]

    joined = names.join(vectors, ["layer", "cluster"]).select("layer", "cluster", "v")
    return joined.groupBy("layer").applyInPandas(run, "layer int, cluster int, group_id int")


def chunked_groups(groups: DataFrame, most: int = MOST_TOPICS_PER_PROMPT) -> DataFrame:
    """``groups(layer, group_id, cluster)`` with chunk and position (from 1): at most ``most`` topics in a prompt."""
    r = F.row_number().over(Window.partitionBy("layer", "group_id").orderBy("cluster")) - 1
    return groups.withColumn("_r", r).select("layer", "group_id", F.floor(F.col("_r") / most).cast("int").alias("chunk"), (F.col("_r") % most + 1).alias("position"), "cluster")
