"""fvecs and ivecs records, and JSON results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance
from ..operators.knn import knn_join


PIECE = 64 << 20
"""Bytes of a file that one task reads."""


def _records(spark: SparkSession, path: str, dim: int, kind: str, name: str, sql: str) -> DataFrame:
    """Fixed-length records, cut into splits of about PIECE bytes, so a file of any size is read by many tasks."""
    size = 4 + 4 * dim
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    for f in where.getFileSystem(conf).globStatus(where) or []:
        for g in [f] if f.isFile() else where.getFileSystem(conf).listStatus(f.getPath()):
            if g.isFile() and g.getLen() % size:
                raise ValueError(f"a length of {g.getLen()} bytes is no multiple of a record's {size}")
    options = {"mapreduce.input.fileinputformat.split.maxsize": str(PIECE), "fixedlengthinputformat.record.length": str(size)}
    found = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=options
    )
    raw = found.map(lambda x: (x[0] // size, bytes(x[1]))).toDF("id long, data binary")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column("data").to_pylist()), dtype=np.dtype([("dim", "<i4"), ("v", kind, (dim,))]))
            if (rows["dim"] != dim).any():
                raise ValueError(f"expected {dim} dimensions, not {rows['dim'][rows['dim'] != dim][0]}")
            flat = pa.array(np.ascontiguousarray(rows["v"]).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", name])

    return raw.mapInArrow(run, f"id long, {name} array<{sql}>")


def read_fvecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, embedding): ids from 0 in file order, for one file."""
    return _records(spark, path, dim, "<f4", "embedding", "float")


def read_ivecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, neighbours): true neighbours, nearest first."""
    return _records(spark, path, dim, "<i4", "neighbours", "int")


def read_vector_csv(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    """CSV with one quoted ``[1,2,3]`` a line."""
    from ..functions.types import vector_in

    return spark.read.csv(path, quote='"').select(vector_in(F.col("_c0")).alias(column))


def check_truth(truth: DataFrame, base: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", sample: int = 100) -> DataFrame:
    """(qid, stored, found): stored neighbours, (id, neighbours) as ``read_ivecs`` gives them, of the first ``sample`` queries whose k nearest aren't the exact ones at equal distances.

    No row: the stored truth holds.
    """
    asked = queries.where(F.col("id") < sample)
    mine = truth.where(F.col("id") < sample).select(F.col("id").alias("qid"), F.slice("neighbours", 1, k).alias("stored"))
    exact = knn_join(base, asked, vec, "id", k).groupBy("qid").agg(F.max("distance").alias("edge"), F.sort_array(F.collect_list("id")).alias("found"))
    q = asked.select(F.col("id").alias("qid"), F.col(vec).alias("__q"))
    held = mine.select("qid", F.explode("stored").alias("id")).join(base.select("id", F.col(vec).alias("__v")), "id").join(q, "qid")
    far = held.groupBy("qid").agg(F.max(l2_distance(F.col("__v"), F.col("__q"))).alias("worst"), F.count_distinct("id").alias("n"))
    both = mine.join(exact, "qid").join(far, "qid", "left")
    return both.where(F.coalesce("n", F.lit(0)) < F.size("found")).unionByName(both.where(F.col("worst") > F.col("edge") * (1 + 1e-6))).select("qid", "stored", "found").distinct()


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pack_fvecs(vectors: np.ndarray, kind: str = "<f4") -> bytes:
    dim = vectors.shape[1]
    out = np.empty(len(vectors), dtype=np.dtype([("dim", "<i4"), ("v", kind, (dim,))]))
    out["dim"], out["v"] = dim, vectors
    return out.tobytes()
