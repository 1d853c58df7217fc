"""Streams of vectors: encoded, or matched against fixed queries, with a model from batch training. Stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismframe.operators.encoder import Model


def encode_stream(stream: DataFrame, model: Model, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, codes) of a streaming DataFrame."""
    return model.encode(stream, id_col, vector)


def match_stream(stream: DataFrame, model: Model, queries: DataFrame, most: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, dist_q, dist) of streamed vectors within ``most`` of a query by their codes."""
    return model.transform(encode_stream(stream, model, id_col, vector), queries, id_col).filter(F.col("dist") <= most)


def write_codes(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends codes to a Parquet table, each input once (the checkpoint folder remembers what was read)."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
