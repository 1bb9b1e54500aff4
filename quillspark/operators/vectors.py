"""Nearest neighbours by cosine distance, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.util import spread

#: Vectors to a block; a pair of blocks is one row of work.
BLOCK = 2048


def _blocks(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors each: ids and their vectors, unit length, end to end."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BLOCK):
                part = frame.iloc[start : start + BLOCK]
                vectors = np.stack(part["v"].tolist()).astype("float64")
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                yield pd.DataFrame({f"{name}_ids": [part["id"].tolist()], f"{name}_vectors": [vectors.ravel().tolist()]})

    cleaned = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("aggregate(v, 0D, (a, x) -> a + x * x) > 0")
    return cleaned.mapInPandas(pack, f"{name}_ids array<bigint>, {name}_vectors array<double>")


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int = 5) -> DataFrame:
    """(query_id, rank, id, distance) of the ``k`` rows nearest to each query by cosine distance.

    Exact, in blocks: each pair of a query block and a row block is one matrix product that leaves k rows per query. Of
    these each task keeps the best k of a query before the shuffle (the window's group limit), so a query's group holds k
    rows per task, however many rows there are. Ties go to the smaller id; null and zero vectors take no part; all
    vectors have the same length.
    """
    pairs = _blocks(spread(rows, id_col), id_col, vector_col, "r").crossJoin(_blocks(queries, id_col, vector_col, "q"))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r_ids, r_flat, q_ids, q_flat in zip(frame["r_ids"], frame["r_vectors"], frame["q_ids"], frame["q_vectors"]):
                r_ids, q_ids = np.asarray(r_ids), np.asarray(q_ids)
                far = np.round(1 - np.asarray(q_flat).reshape(len(q_ids), -1) @ np.asarray(r_flat).reshape(len(r_ids), -1).T, 9)
                edge = np.partition(far, min(k, len(r_ids)) - 1, axis=1)[:, min(k, len(r_ids)) - 1]
                at, hit = np.nonzero(far <= edge[:, None])  # ties at the edge are kept, and settled by id
                yield pd.DataFrame({"query_id": q_ids[at], "id": r_ids[hit], "distance": far[at, hit]})

    near = pairs.mapInPandas(multiply, "query_id bigint, id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
