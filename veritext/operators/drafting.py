"""What an opponent would say of a draft, and the passage window that a reader is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions.lexicon import ATTACKS, HIGH_COURTS, MIN_CITED_SHARE
from veritext.functions.text import py_tokens, sentences

WINDOW_CHARS = 1800


def high_courts(spark) -> DataFrame:
    """prefix, court, seat of neutral citations: a dimension of a few dozen rows."""
    rows = []
    for line in HIGH_COURTS.strip().splitlines():
        prefix, _, name = line.partition(": ")
        court, _, seat = name.partition(", ")
        rows.append((prefix, court, seat or None))
    return spark.createDataFrame(rows, "prefix string, court string, seat string")


def attacks(points: DataFrame, edges: DataFrame, cases: DataFrame, field: DataFrame | None = None, contrary: DataFrame | None = None) -> DataFrame:
    """point, kind, against, place: attacks on a draft's points, gravest kind first.

    points: point, case (null without authority), status; edges: citing, cited,
    treatment; cases: case, bench, decided_on; field: point, case (what the same
    search finds); contrary: point, case. A case that nobody cites is an attack
    only where most cases are cited. At most two larger or later cases a point."""
    cited = points.where("case is not null")
    bare = points.where("case is null").select("point", F.lit("unsupported").alias("kind"), F.lit(None).cast("string").alias("against"))
    told = cited.join(edges.where("treatment = 'distinguished'"), F.col("case") == F.col("cited")).select("point", F.lit("distinguished").alias("kind"), F.col("citing").alias("against"))
    narrow = cited.where("status = 'narrowed'").select("point", F.lit("narrowed").alias("kind"), F.col("case").alias("against"))
    share = edges.agg(F.countDistinct("cited").alias("c")).join(cases.agg(F.count(F.lit(1)).alias("n")), F.lit(True)).select((F.col("c") / F.col("n")).alias("share"))
    thin = cited.join(edges.select(F.col("cited").alias("case")).distinct(), "case", "left_anti").join(F.broadcast(share), F.col("share") >= MIN_CITED_SHARE).select("point", F.lit("thin").alias("kind"), F.col("case").alias("against"))
    out = bare.unionByName(told).unionByName(narrow).unionByName(thin)
    if contrary is not None:
        out = out.unionByName(contrary.join(cited.select("point", F.col("case").alias("own")), "point").where("case <> own").select("point", F.lit("contrary").alias("kind"), F.col("case").alias("against")))
    if field is not None:
        mine = cited.join(cases, "case").select("point", F.col("case").alias("own"), F.coalesce("bench", F.lit(0)).alias("b"), F.col("decided_on").alias("d"))
        other = field.join(cases, "case").select("point", F.col("case").alias("against"), F.coalesce("bench", F.lit(0)).alias("bench"), "decided_on")
        above = other.join(mine, "point").where("against <> own and (bench > b or (bench = b and decided_on > d))")
        w = Window.partitionBy("point").orderBy(F.desc("bench"), F.desc("decided_on"), "against")
        out = out.unionByName(above.withColumn("n", F.row_number().over(w)).where("n <= 2").select("point", F.lit("outranked").alias("kind"), "against"))
    order = F.array_position(F.array(*[F.lit(k) for k in ATTACKS]), F.col("kind"))
    return out.distinct().withColumn("place", F.row_number().over(Window.partitionBy("point").orderBy(order, "against")))


def window(body: str, claim: str, size: int = WINDOW_CHARS) -> str:
    """At most size characters of a paragraph around the sentence that shares most with a claim, a third of them before it."""
    if len(body) <= size:
        return body
    wanted = set(py_tokens(claim))
    at = max(((len(wanted & set(py_tokens(s))), -place) for s, place in sentences(body)), default=(0, 0))[1]
    start = max(0, min(-at - size // 3, len(body) - size))
    return body[start : start + size]


def encode(rows: DataFrame, encoder, key: str, text: str = "body", batch: int = 2048) -> DataFrame:
    """key and unit vector of each text by an encoder that workers load: a function from a list of texts to a float matrix. Zero vectors stay zero."""
    import numpy as np
    import pyarrow as pa

    kind = rows.schema[key].dataType

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                m = np.asarray(encoder([t or "" for t in part.column(1).to_pylist()]), dtype=np.float32)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(m / np.where(norm == 0, 1, norm)), pa.list_(pa.float32()))], [key, "vector"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, vector array<float>")
