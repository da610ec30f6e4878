"""Records of pictures and sound: face scans, WAV files of clips, metadata of a source."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACES = "path string, face int, t double, bbox array<double>, face_size double, frontality double, sface array<double>, mouth double"


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Rows of scans in .npz files, a file a source: FACES. A file that is no scan is an error."""
    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, content in zip(p["path"], p["content"]):
                with np.load(io.BytesIO(content)) as z:
                    n = len(z["track_id"])
                    wide = {k: list(z[k].astype(float)) for k in ("bbox", "sface")}
                    yield pd.DataFrame({"path": [name] * n, "face": z["track_id"].astype("int32"), "t": z["t"].astype(float), "bbox": wide["bbox"], "face_size": z["face_size"].astype(float), "frontality": z["frontality"].astype(float), "sface": wide["sface"], "mouth": z["mouth"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, FACES)


def write_faces(faces: DataFrame, path: str) -> None:
    """The faces table of many tracks."""
    faces.repartition("track_id").sortWithinPartitions("track_id", "t").write.mode("overwrite").partitionBy("track_id").parquet(path)


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Clips of -1 to 1 as WAV files of 16 bits and one channel; louder samples are held at the limits."""
    def one(x, r) -> bytes | None:
        if x is None:
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(int(r))
            f.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(x, r) for x, r in zip(samples, rate)], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def wav_samples(content: pd.Series) -> pd.Series:
    """Samples of WAV files of 16 bits, channels averaged."""
    def one(data) -> list[float] | None:
        if data is None:
            return None
        with wave.open(io.BytesIO(data)) as f:
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
        return (x.mean(1) / 32767).tolist()

    return content.map(one)


def source_metadata(c: Column) -> Column:
    """title, license, duration and the codes of subtitles, made by hand and automatic, of a source's JSON; null where it
    is none."""
    got = F.from_json(c, "title string, license string, duration double, subtitles map<string,string>, automatic_captions map<string,string>, language string")
    codes = lambda m: F.coalesce(F.array_sort(F.map_keys(m)), F.array().cast("array<string>"))
    found = F.struct(got["title"].alias("title"), got["license"].alias("license"), got["duration"].alias("duration"), got["language"].alias("language"), codes(got["subtitles"]).alias("manual"), codes(got["automatic_captions"]).alias("automatic"))
    return F.when(got["title"].isNotNull() | got["duration"].isNotNull(), found)
