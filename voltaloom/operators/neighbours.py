"""Exact nearest neighbours within groups of any size, by cells around pivots and the triangle inequality.

A group of more than CELL rows gets pivots, and each row belongs to the cell of its nearest one. Blocks of a cell are first searched among themselves, which
bounds each row's distance to its k-th neighbour; a cell is then compared with another only if the distance of their pivots less both radii is within the
cell's greatest bound, and of the other cell only rows that the bound of some row reaches. No pair of rows becomes a row of a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaloom.staging import written

#: Rows of a cell and of a block of it, about, and the most pivots of a group.
CELL, MAX_PIVOTS = 512, 1024
#: Rows that meet the pivots in one task's memory, about.
SHARE = 4096


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def nearest_of(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k nearest rows of x of each row of q, itself left out, at most `limit` away; ties go to smaller ids."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    rough = qq[:, None] + xx - 2 * q @ x.T
    slack = 1e-9 * (qq[:, None] + xx.max(initial=0)) + 1e-12  # what the product may be off by
    rough[q_id[:, None] == x_id] = np.inf
    top = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1 : min(k, len(x))]
    near = rough <= top + 2 * slack
    if limit is not None:
        near &= rough <= (limit**2)[:, None] * (1 + 1e-9) + slack
    i, j = np.nonzero(near & np.isfinite(rough))
    d = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
    by = np.lexsort((x_id[j], d, i))
    i, j, d = i[by], j[by], d[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    kept = place < k
    return i[kept], x_id[j[kept]], d[kept]


def nearest(vectors: DataFrame, group: str, item: str, vector: str, k: int, cell: int = CELL) -> DataFrame:
    """(group, item, neighbour, d, r): the k nearest other items of each item in its group, r from 1; ties of distance go to the smaller item.

    vectors (group, item long, vector array of one length, without nulls); rows without one of the three take no part. Items are unique in a group.
    """
    label = vectors.schema[group].dataType.simpleString()
    rows = vectors.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy("g").agg(F.least(F.ceil(F.count("*") / cell), F.lit(MAX_PIVOTS)).alias("p"))
    share = rows.join(sizes, "g").withColumn("h", F.xxhash64("i"))
    # Pivots: the rows of least hash; a threshold on the hash leaves few rows to be ordered.
    total = rows.groupBy("g").agg(F.count("*").alias("n"))
    few = share.join(total, "g").where((F.col("n") <= 4 * cell) | (F.pmod("h", F.lit(1 << 20)) < 4 * F.col("p") / F.col("n") * (1 << 20) + 16))
    order = Window.partitionBy("g").orderBy("h", "i")
    pivots = few.withColumn("c", F.row_number().over(order)).where(F.col("c") <= F.col("p")).select("g", "c", "v")
    pivots = written(pivots, "pivots")
    # Rows meet their group's pivots a share at a time, so pivots travel once a share and not once a row.
    shares = total.select("g", F.ceil(F.col("n") / SHARE).alias("shares"))
    own = rows.join(shares, "g").select("g", F.pmod(F.xxhash64("i"), F.col("shares")).alias("s"), "i", F.lit(0).cast("long").alias("c"), "v")  # pivots count from 1
    given = pivots.join(shares, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("s"), F.lit(0).cast("long").alias("i"), F.col("c").cast("long").alias("c"), "v")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, pdf = pdf[pdf.c > 0].sort_values("c"), pdf[pdf.c == 0]
        if not len(pdf):
            return pd.DataFrame({"g": [], "i": [], "v": [], "c": [], "far": []})
        v, p = _stack(pdf.v), _stack(pivot.v)
        best = np.argmin((p * p).sum(1) - 2 * v @ p.T, axis=1)
        return pd.DataFrame({"g": pdf.g, "i": pdf.i, "v": pdf.v, "c": pivot.c.to_numpy()[best], "far": np.sqrt(((v - p[best]) ** 2).sum(1))})

    dealt = written(own.unionByName(given).groupBy("g", "s").applyInPandas(deal, f"g {label}, i long, v array<double>, c long, far double"), "cells")
    blocks_of = dealt.groupBy("g", "c").agg(F.ceil(F.count("*") / (2 * cell)).alias("blocks"))
    numbered = dealt.join(blocks_of, ["g", "c"]).withColumn("b", F.pmod(F.xxhash64("i"), F.col("blocks")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = _stack(pdf.v), pdf.i.to_numpy()
        i, _, d = nearest_of(v, ids, v, ids, k)
        bound = np.full(len(v), np.inf)  # of the distance to the k-th neighbour, from the block alone
        np.maximum.at(got := np.zeros(len(v)), i, d)
        full = np.bincount(i, minlength=len(v)) >= k
        bound[full] = got[full]
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "c": [pdf.c.iloc[0]], "b": [pdf.b.iloc[0]], "ids": [ids], "x": [v.ravel()], "far": [pdf.far.to_numpy()], "bound": [bound], "radius": [pdf.far.max()], "most": [bound.max()]})

    form = f"g {label}, c long, b long, ids array<long>, x array<double>, far array<double>, bound array<double>, radius double, most double"
    blocks = written(numbered.groupBy("g", "c", "b").applyInPandas(pack, form), "blocks")
    ends = blocks.groupBy("g", "c", "b").agg(F.max("radius").alias("radius"), F.max("most").alias("most")).join(pivots, ["g", "c"])
    q, x = (ends.select("g", *(F.col(n).alias(f"{n}{side}") for n in ("c", "b", "radius", "most", "v"))) for side in "qx")
    apart = F.sqrt(F.aggregate(F.zip_with("vq", "vx", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y))
    pairs = q.join(x, "g").withColumn("apart", apart).where(F.col("apart") - F.col("radiusq") - F.col("radiusx") <= F.col("mostq") * (1 + 1e-9) + 1e-9)
    pairs = pairs.select("g", "cq", "bq", "cx", "bx", "apart")
    left = blocks.select("g", F.col("c").alias("cq"), F.col("b").alias("bq"), F.col("ids").alias("q_ids"), F.col("x").alias("q"), F.col("far").alias("q_far"), "bound")
    right = blocks.select("g", F.col("c").alias("cx"), F.col("b").alias("bx"), "ids", "x", "far")

    def compare(batches):
        for pdf in batches:
            for r in pdf.itertuples():  # blocks are large; what is found goes on at once
                q_ids, ids = np.asarray(r.q_ids), np.asarray(r.ids)
                q, x, bound, q_far, far = np.asarray(r.q).reshape(len(q_ids), -1), np.asarray(r.x).reshape(len(ids), -1), np.asarray(r.bound), np.asarray(r.q_far), np.asarray(r.far)
                asked = r.apart - q_far - far.max() <= bound * (1 + 1e-9) + 1e-9
                given = r.apart - far - q_far.max() <= bound.max() * (1 + 1e-9) + 1e-9
                if asked.any() and given.any():
                    i, near, d = nearest_of(q[asked], q_ids[asked], x[given], ids[given], k, bound[asked])
                    yield pd.DataFrame({"g": r.g, "i": q_ids[asked][i], "neighbour": near, "d": d}).astype({"i": "int64", "neighbour": "int64", "d": "float64"})

    found = pairs.join(left, ["g", "cq", "bq"]).join(right, ["g", "cx", "bx"]).select("g", "q_ids", "q", "q_far", "bound", "ids", "x", "far", "apart").mapInPandas(compare, f"g {label}, i long, neighbour long, d double")
    best = Window.partitionBy("g", "i").orderBy("d", "neighbour")
    ranked = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "neighbour", "d", "r")
