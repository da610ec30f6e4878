"""Models that are not part of this package, behind batches of rows: speech, conversion of voices, chat.

A speech model takes a batch of lines and gives the samples of each; a chat model takes a prompt. Models are made once
for each task. Stubs of each are deterministic."""

from __future__ import annotations

import hashlib
import multiprocessing
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import numbered_replies
from ..schema import SPOKEN_CPS

_SAMPLES = T.ArrayType(T.FloatType())


class Renderer(ABC):
    """Samples for batches of lines. A batch has the columns text, voice, speed and emotion."""

    #: Part of the clips' keys: a model of another name has other clips.
    model = "none"
    #: Samples a second.
    rate = 24_000
    #: Whether speed is done by the model, and whether voices are clips to speak like.
    measures_speed = True
    takes_clips = False

    @abstractmethod
    def render(self, batch: pd.DataFrame) -> list[np.ndarray]:
        """One array for each row."""

    def catalogue(self) -> pd.DataFrame:
        """The voices: gender, name and ord. No rows: any name goes."""
        return pd.DataFrame({"gender": [], "name": [], "ord": []})


class SilentRenderer(Renderer):
    """Silence of the length that a line takes."""

    model = "silent"

    def __init__(self, rate: int = 100):
        self.rate = rate

    def render(self, batch: pd.DataFrame) -> list[np.ndarray]:
        return [np.zeros(int(len(t) / SPOKEN_CPS / v * self.rate), np.float32) for t, v in zip(batch["text"], batch["speed"])]

    def catalogue(self) -> pd.DataFrame:
        return pd.DataFrame({"gender": ["F", "M"], "name": ["af_stub", "am_stub"], "ord": [1, 1]})


class Converter(ABC):
    """Turns samples into the voice of a reference clip."""

    @abstractmethod
    def convert(self, samples: np.ndarray, rate: int, reference: str) -> np.ndarray: ...


class Unchanged(Converter):
    def convert(self, samples: np.ndarray, rate: int, reference: str) -> np.ndarray:
        return samples


class ChatEngine(ABC):
    @abstractmethod
    def ask(self, prompt: str) -> str: ...


class EchoChat(ChatEngine):
    def ask(self, prompt: str) -> str:
        return prompt[::-1]


def _serve(make: Callable[[], Renderer], pipe) -> None:
    model = make()
    while (batch := pipe.recv()) is not None:
        try:
            pipe.send(("samples", model.render(batch)))
        except Exception as e:  # goes to the asking side as it is
            pipe.send(("error", repr(e)))


class Watched(Renderer):
    """A model in a process of its own. One that does not answer in time, or dies, is started again for the next batch;
    the batch that it was at fails, and after `restarts` of them in a row so do all further ones."""

    def __init__(self, make: Callable[[], Renderer], seconds: float, restarts: int = 2):
        inner = make()
        self.model, self.rate, self.measures_speed, self.takes_clips = inner.model, inner.rate, inner.measures_speed, inner.takes_clips
        self.catalogue = inner.catalogue  # type: ignore[method-assign]
        self._make, self._seconds, self._left, self._most = make, seconds, restarts, restarts
        self._process = self._pipe = None

    def _stop(self) -> None:
        if self._process is not None:
            self._process.kill()
            self._process.join()
            self._process = self._pipe = None

    def render(self, batch: pd.DataFrame) -> list[np.ndarray]:
        if self._left < 0:
            raise RuntimeError("the model was started again too often")
        if self._process is None:
            context = multiprocessing.get_context("fork")
            self._pipe, theirs = context.Pipe()
            self._process = context.Process(target=_serve, args=(self._make, theirs), daemon=True)
            self._process.start()
            theirs.close()
        try:
            self._pipe.send(batch)
            if not self._pipe.poll(self._seconds):
                raise TimeoutError(f"no answer in {self._seconds} s")
            kind, got = self._pipe.recv()
        except (TimeoutError, EOFError, OSError) as e:
            self._left -= 1
            self._stop()
            raise RuntimeError(f"the model was stopped: {e!r}") from e
        if kind == "error":
            raise RuntimeError(got)
        self._left = self._most
        return got

    def __del__(self) -> None:
        self._stop()


def clip_name(model: str, voice: str | None, speed: float, text: str) -> str:
    return hashlib.sha1(f"{model}|{voice}|{speed:.4f}|{text}".encode()).hexdigest()[:20]


def spoken(lines: DataFrame, make: Callable[[], Renderer], batch: int = 32) -> DataFrame:
    """lines(track_id, idx, text, voice, speed[, emotion]) with samples, rate, rendered_dur and clip_key. Lines are rendered
    some at a time; where that fails one by one, and a line that fails alone has an error instead."""
    fields = [("samples", _SAMPLES), ("rate", T.IntegerType()), ("rendered_dur", T.DoubleType()), ("clip_key", T.StringType()), ("error", T.StringType())]
    schema = T.StructType([*[lines.schema[c] for c in ("track_id", "idx")], *[T.StructField(n, k) for n, k in fields]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def one_by_one(rows: pd.DataFrame) -> Iterator[tuple]:
            for k in range(len(rows)):
                try:
                    yield model.render(rows.iloc[k : k + 1])[0], None
                except Exception as e:  # a failure is that line's, not the track's
                    yield None, repr(e)

        for part in parts:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                try:
                    got = [(s, None) for s in model.render(rows)]
                except Exception:
                    got = [*one_by_one(rows)]
                keys = [clip_name(model.model, v, s, t) for v, s, t in zip(rows["voice"], rows["speed"], rows["text"])]
                yield pd.DataFrame({
                    "track_id": rows["track_id"].to_numpy(), "idx": rows["idx"].to_numpy(), "samples": [s for s, _ in got], "rate": model.rate,
                    "rendered_dur": [None if s is None else len(s) / model.rate for s, _ in got], "clip_key": keys, "error": [e for _, e in got],
                })

    emotion = F.col("emotion") if "emotion" in lines.columns else F.lit(0.5)
    return lines.select("track_id", "idx", "text", "voice", "speed", emotion.alias("emotion")).mapInPandas(run, schema)


def converted(clips: DataFrame, make: Callable[[], Converter]) -> DataFrame:
    """clips(track_id, idx, samples, rate, reference) in the voices of their references; a clip without one, or whose
    conversion fails, stays as it is, the latter with an error."""
    schema = T.StructType([*[clips.schema[c] for c in ("track_id", "idx")], T.StructField("samples", _SAMPLES), T.StructField("error", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                samples, error = r.samples, None
                if samples is not None and r.reference:
                    try:
                        samples = model.convert(np.asarray(samples, np.float32), r.rate, r.reference)
                    except Exception as e:
                        error = repr(e)
                out.append((r.track_id, r.idx, samples, error))
            yield pd.DataFrame(out, columns=schema.names)

    return clips.select("track_id", "idx", "samples", "rate", "reference").mapInPandas(run, schema)


def asked(prompts: DataFrame, make: Callable[[], ChatEngine]) -> DataFrame:
    """prompts(…, prompt) with reply."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for p in parts:
            yield p.assign(reply=[engine.ask(x) for x in p["prompt"]])

    return prompts.mapInPandas(run, schema)


def numbered_prompts(lines: DataFrame, head: str, size: int, around: int = 3) -> DataFrame:
    """lines(track_id, idx, text[, limit, translated]) as prompts of `size` numbered lines, in order: track_id, batch, prompt
    and the idx of each. Before the lines stand the `around` lines before them, translated where they are, and after
    them, in the original; limit: characters that a reply may have."""
    order = Window.partitionBy("track_id").orderBy("idx")
    flat = F.regexp_replace("text", r"\s+", " ")
    done = F.coalesce(F.col("translated"), flat) if "translated" in lines.columns else flat
    limit = F.concat(F.lit("(at most "), F.col("limit").cast("string"), F.lit(") ")) if "limit" in lines.columns else F.lit("")
    near = lambda c, a, b: F.collect_list(c).over(order.rowsBetween(a, b))
    rows = lines.select("track_id", "idx", F.concat(limit, flat).alias("line"), near(done, -around, -1).alias("before"), near(flat, 1, around).alias("after"), (F.row_number().over(order) - 1).alias("_at"))
    rows = rows.withColumn("batch", F.floor(F.col("_at") / size)).withColumn("_k", F.pmod("_at", F.lit(size)) + 1)
    by = rows.groupBy("track_id", "batch").agg(F.array_sort(F.collect_list(F.struct("_k", "idx", "line", "before", "after"))).alias("l"))
    scene = F.array_join(F.transform(F.concat(F.col("l")[0]["before"], F.element_at("l", -1)["after"]), lambda x: F.concat(F.lit("- "), x)), "\n")
    numbered = F.array_join(F.transform("l", lambda x: F.concat(x["_k"].cast("string"), F.lit(". "), x["line"])), "\n")
    return by.select("track_id", "batch", F.concat_ws("\n", F.lit(head), F.when(scene != "", F.concat(F.lit("Around them:\n"), scene)), F.lit("Lines:"), numbered).alias("prompt"), F.transform("l", lambda x: x["idx"]).alias("idxs"))


def asked_in_batches(lines: DataFrame, make: Callable[[], ChatEngine], head: str, size: int = 12) -> DataFrame:
    """track_id, idx and reply of each line, asked for `size` lines at a time; null where a reply has no line of its number."""
    got = asked(numbered_prompts(lines, head, size), make)
    return got.withColumn("r", numbered_replies(F.col("reply"), F.size("idxs"))).select("track_id", "r", F.posexplode("idxs").alias("k", "idx")).select("track_id", "idx", F.try_element_at("r", F.col("k") + 1).alias("reply"))


def uncached(lines: DataFrame, cache: DataFrame) -> DataFrame:
    """Lines whose clip is not in the cache."""
    return lines.join(cache.select("clip_key"), "clip_key", "left_anti")


def unknown(voices: DataFrame, model: Renderer) -> DataFrame:
    """Voices a model does not have; none where it takes any."""
    have = model.catalogue()["name"].tolist()
    return voices.where(~F.col("voice").isin(have)) if have else voices.limit(0)
