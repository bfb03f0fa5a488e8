"""Lines of a text file and their segmentation into random chunks."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words, and lines.
BLANK = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
LABELS = ("intro", "body", "conclusion")
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def text_lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """sample_id and text of the first ``n`` non-blank lines, stripped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", LINE_BREAKS)).alias("line", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    lines = lines.orderBy("line")
    return (lines.limit(n) if n is not None else lines).select(F.col("line").alias("sample_id"), "text")


def chunk_lengths(n_tokens: int, rng: random.Random) -> list[int]:
    out = []
    while n_tokens > 0:
        size = rng.randint(1, max(1, n_tokens // 2))
        out.append(size)
        n_tokens -= size
    return out


def segment_tokens(n_tokens: int, rng: random.Random) -> list[dict]:
    """Chunks of random length with labels in turn; a text without tokens is one ``empty`` chunk."""
    if n_tokens == 0:
        return [{"label": "empty", "start": 0, "end": 0}]
    out, at = [], 0
    for k, size in enumerate(chunk_lengths(n_tokens, rng)):
        out.append({"label": LABELS[k % len(LABELS)], "start": at, "end": at + size})
        at += size
    return out


SEGMENTS = "segments array<struct<label:string,start:bigint,end:bigint>>, label_lengths map<string,bigint>, num_segments bigint"


def segment_texts(df: DataFrame, key: str, text: str, seed: int = 42, per_row: bool = True) -> DataFrame:
    """(key, segments, label_lengths, num_segments) of every text.

    ``per_row`` draws from a generator seeded by the row's key, so rows don't depend on each other. Otherwise
    one generator serves all rows in order of their key, which is inherently one task over (key, token count).
    """
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()
    words = F.trim(F.regexp_replace(F.col(text), BLANK, " "))
    n = F.when(words == "", 0).otherwise(F.size(F.split(words, " ")))
    counts = df.select(F.col(key).alias("__key"), F.coalesce(n, F.lit(0)).alias("__n"))

    def rows(pdf: pd.DataFrame, shared: random.Random | None) -> pd.DataFrame:
        out = []
        for k, size in zip(pdf["__key"], pdf["__n"], strict=True):
            parts = segment_tokens(int(size), shared or random.Random(f"{seed}:{k}"))
            lengths = Counter()
            for p in parts:
                lengths[p["label"]] += p["end"] - p["start"]
            out.append((k, parts, dict(lengths), len(parts)))
        return pd.DataFrame(out, columns=["__key", "segments", "label_lengths", "num_segments"])

    def spread(batches):
        for b in batches:
            yield rows(b, None)

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return rows(pdf.sort_values("__key", kind="stable"), random.Random(seed))

    schema = f"__key {kind}, {SEGMENTS}"
    made = counts.mapInPandas(spread, schema) if per_row else counts.withColumn("__g", F.lit("all")).groupBy("__g").applyInPandas(ordered, schema)
    return made.withColumnRenamed("__key", key)
