"""Vectors in cells: a stored index of the rows by their nearest centroid, searched near a query first and as far as an exact answer needs.

Centroids are fitted on a bounded sample; every row is in the index. A search reads the cells nearest to each query. The largest angle
between a cell's rows and its centroid bounds how similar any of its rows can be, so an exact search then opens just those
further cells whose bound is not below what the first cells gave.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that centroids are fitted on, about, and cells, at most.
SAMPLE, MOST_CELLS = 20_000, 4_096
#: Rows, and queries, that are compared at once as matrices; rows, and queries, that meet in one task; rows found that a task holds before it keeps only the best.
BLOCK, PART_ROWS, PART_QUERIES, MOST_HELD = 2_048, 50_000, 20_000, 1_000_000


def fitted(vectors, cells: int, rounds: int = 12):
    """Unit centroids of unit vectors: spherical k-means from rows spread over the sample."""
    import numpy as np

    centroids = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(vectors[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(vectors), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(sizes > 0, sums / np.where(sizes > 0, sizes, 1), centroids)
    return centroids


def unit(vectors: list):
    import numpy as np

    m = np.array([np.asarray(v, np.float64) for v in vectors])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def probes_needed(vectors, centroids, k: int, recall: float, asked: int = 200) -> int:
    """How many of the nearest cells hold that share of the k nearest other vectors, measured on the sample with some of its vectors as queries."""
    import numpy as np

    if len(vectors) < 2:
        return 1
    queries = np.unique(np.linspace(0, len(vectors) - 1, asked).astype(int))
    similarity = vectors[queries] @ vectors.T
    similarity[np.arange(len(queries)), queries] = -2
    nearest = np.argsort(-similarity, axis=1)[:, : min(k, len(vectors) - 1)]
    cell = np.concatenate([(vectors[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(vectors), 4096)])
    place = np.argsort(np.argsort(-(vectors[queries] @ centroids.T), axis=1), axis=1)
    at = np.sort(place[np.arange(len(queries))[:, None], cell[nearest]].ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def build(df: DataFrame, path: str, id_col: str = "id", vector_col: str = "vector", cells: int | None = None, sample: int = SAMPLE, salts: int = 8, recall: float = 0.95, k: int = 10) -> None:
    """Stores rows (id, unit, angle) by cell, centroids, and each cell's size and largest angle. Null vectors are left out; a vector of zeros is similar to none and kept. Vectors have one length.

    cells: by default the root of the number of rows. The sample is chosen by a hash of the id. recall: what share of the k nearest a search
    should find; how many cells that takes is measured on the sample and stored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n = rows.count()
    scale = 1 << 20
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < max(1, int(scale * min(1.0, sample / max(n, 1))))).orderBy("id")
    vectors = [r["v"] for r in chosen.select("v").limit(2 * sample).collect()] or [r["v"] for r in rows.select("v").limit(1).collect()]
    known = unit(vectors or [[1.0]])
    centroids = fitted(known, max(1, min(cells or math.isqrt(n), MOST_CELLS, len(known))))
    spark.createDataFrame([(probes_needed(known, centroids, k, recall),)], "probes int").coalesce(1).write.parquet(f"{path}/settings")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centroids)  # MOST_CELLS vectors at most

    def placed(v: pd.Series) -> pd.DataFrame:
        import numpy as np

        u = unit(v.tolist())
        similarity = u @ shared.value.T
        cell = similarity.argmax(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "unit": list(u), "angle": np.arccos(np.clip(similarity[np.arange(len(u)), cell], -1, 1))})

    where = F.pandas_udf(placed, "cell int, unit array<double>, angle double")(F.col("v"))
    stored = rows.select("id", where.alias("p")).select("id", "p.unit", "p.angle", "p.cell")
    by_cell = ["cell"] if n else []
    salts = max(1, min(salts, n // (len(centroids) * BLOCK)))  # files of few rows cost more than they spare
    stored.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(salts))).write.partitionBy(*by_cell).parquet(f"{path}/rows")
    spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).coalesce(1).write.parquet(f"{path}/cells")


def best_of(query, place, similarity, k: int):
    """The k first of each query by similarity, then place."""
    import numpy as np

    order = np.lexsort((place, -similarity, query))
    query, place, similarity = query[order], place[order], similarity[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    kept = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) < k
    return query[kept], place[kept], similarity[kept]


def compared(units, rows, k: int, least):
    """Query, row and similarity (rounded to nine digits) of each query's k first rows, by similarity, then place, of those that are not below its least."""
    import numpy as np

    similarity = np.round(units @ rows.T, 9)
    floor = np.maximum(least, np.partition(similarity, len(rows) - k, axis=1)[:, len(rows) - k]) if len(rows) > k else least
    query, place = np.nonzero(similarity >= floor[:, None])
    return best_of(query, place, similarity[query, place], k)  # equal similarities may be many


def first_k(scored: DataFrame, k: int) -> DataFrame:
    """The k most similar rows of each query, first within parts of them."""
    part = F.pmod(F.xxhash64("id"), F.lit(16))
    for window in (Window.partitionBy("query", part), Window.partitionBy("query")):
        scored = scored.withColumn("rank", F.row_number().over(window.orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
    return scored


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, vector_col: str = "vector") -> DataFrame:
    """query, id, similarity (cosine, rounded to nine digits) and rank: the k most similar rows of each query (columns query, unique, and a vector).

    probes: cells read for each query, nearest first; by default as many as the index was measured to need. exact: also all cells that may hold a row among the first k. Equal similarities go by
    id. Null query vectors find nothing; a query of zeros is similar to none, by 0.
    """
    import numpy as np

    probes = probes or spark.read.parquet(f"{path}/settings").first()["probes"]
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    facts = {r["cell"]: (r["n"], r["widest"]) for r in spark.read.parquet(f"{path}/cells").collect()}
    matrix = np.array([r["centroid"] for r in centroids])
    widest = np.array([facts.get(r["cell"], (0, -1.0))[1] for r in centroids])
    # neighbouring cells make a part until it has PART_ROWS rows; a larger cell makes several
    places, part, held = [], 0, 0
    for cell, (n, _) in sorted(facts.items()):
        if held and held + n > PART_ROWS:
            part, held = part + 1, 0
        splits = -(-n // PART_ROWS)
        places.append((cell, part, splits))
        part, held = (part + splits, 0) if splits > 1 else (part, held + n)
    shared = spark.sparkContext.broadcast((matrix, widest))

    def open_cells(u, least, further: bool):
        """Whether each query has to see each cell: the nearest ones, or beyond them those that may hold a row not below its least."""
        m, wide = shared.value
        near = u @ m.T
        ranked = np.where(wide >= 0, near, -np.inf)
        at = np.argsort(np.argsort(-ranked, axis=1, kind="stable"), axis=1)
        if not further:
            return (at < probes) & (wide >= 0)
        bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - wide))
        return (at >= probes) & (wide >= 0) & (bound >= least[:, None] - 1e-6)

    asked = queries.select("query", F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    unit_of = F.pandas_udf(lambda v: pd.Series(list(unit(v.tolist()))), "array<double>")
    n_asked = asked.count()
    groups = max(1, -(-n_asked // PART_QUERIES))
    grouped = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")
    asked = asked.select("query", unit_of("v").alias("u"), grouped.alias("asked"))
    layout = spark.createDataFrame(places, "cell int, first int, splits int")  # MOST_CELLS rows at most
    stored = spark.read.parquet(f"{path}/rows").join(F.broadcast(layout), "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("splits"))).cast("int"))
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, similarity double"

    def scored(queries: DataFrame, further: bool) -> DataFrame:
        """The k first of each part's rows for each query, among the cells that it has to see; at most PART_ROWS rows and about PART_QUERIES queries meet, in blocks."""

        def cells_of(batches):
            for b in batches:
                opened = open_cells(np.array(b["u"].tolist()), b["least"].to_numpy(), further).any(axis=0)
                yield pd.DataFrame({"cell": np.flatnonzero(opened).astype("int32")})

        def meet(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query": some["query"][:0], "id": rows["id"][:0], "similarity": np.zeros(0)})
            if rows.empty or some.empty:
                return none
            rows = rows.sort_values(["cell", "id"], ignore_index=True)
            by_id = np.empty(len(rows), np.int64)
            by_id[rows["id"].argsort(kind="stable").to_numpy()] = np.arange(len(rows))
            units, cell = np.array(rows["unit"].tolist()), rows["cell"].to_numpy()
            u, least = np.array(some["u"].tolist()), some["least"].to_numpy().copy()
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            found, n = [], 0
            for q in range(0, len(u), BLOCK):
                opened = open_cells(u[q : q + BLOCK], least[q : q + BLOCK], further)
                for a, z in zip(starts, [*starts[1:], len(cell)]):
                    who = q + np.flatnonzero(opened[:, cell[a]])
                    for r in range(a, z, BLOCK) if len(who) else ():
                        query, place, similarity = compared(u[who], units[r : min(r + BLOCK, z)], k, least[who])
                        found.append((who[query], by_id[place + r], similarity))
                        n += len(query)
                    if n > MOST_HELD:
                        found = [best_of(*map(np.concatenate, zip(*found)), k)]
                        n = len(found[0][0]) // 2  # what is kept may be as much again
            if not found:
                return none
            query, place, similarity = best_of(*map(np.concatenate, zip(*found)), k)
            ids = rows["id"].to_numpy()[np.argsort(by_id)]
            return pd.DataFrame({"query": some["query"].to_numpy()[query], "id": ids[place], "similarity": similarity})

        seen = [r["cell"] for r in queries.select("u", "least").mapInPandas(cells_of, "cell int").distinct().collect()]  # MOST_CELLS rows at most
        parts = sorted({p for c, first, splits in places if c in set(seen) for p in range(first, first + splits)})
        left = stored.where(F.col("cell").isin(seen)).withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("part", "asked", "cell", "id", "unit")
        right = queries.select("asked", "query", "u", "least").crossJoin(F.broadcast(spark.createDataFrame([(p,) for p in parts], "part int")))
        return left.groupBy("part", "asked").cogroup(right.groupBy("part", "asked")).applyInPandas(meet, kinds)

    near = first_k(scored(asked.withColumn("least", F.lit(-2.0)), False), k).persist()
    if not exact:
        return near.select("query", "id", "similarity", "rank")
    reached = near.groupBy("query").agg(F.min("similarity").alias("least"), F.count("*").alias("found")).where(F.col("found") >= k).select("query", "least")
    further = scored(asked.join(reached, "query", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), True)
    return first_k(near.drop("rank").unionByName(further), k).select("query", "id", "similarity", "rank")
