"""Exact top-k search by pivot-table elimination.

Vectors are quantised to integers floor(scale * x); the score is the integer inner product. Euclidean distances of every
vector to ``pivots`` pivots are computed once. For a query q and a candidate v the largest |d(q, p) - d(v, p)| over the
pivots bounds their distance from below, hence their inner product (|q|^2 + |v|^2 - d^2) / 2 from above; candidates are
evaluated in order of that bound until the k-th best score exceeds every bound left, so the result is exact.

Elimination works on blocks first. Vectors are grouped in cells by their nearest pivot (of as many as there are blocks to fill; in
a large cell also by the second nearest), cells are cut into blocks of about ``rows`` rows, and a block keeps the range of its distances to each pivot and
its largest norm. In a first round each query searches one block of its own cell; its k-th best score there travels with it
as a threshold. Then the queries of neighbouring homes are grouped, the ranges of data blocks and of query groups are compared,
in chunks, and only pairs whose bound reaches the least threshold are joined; inside a pair a query skips the block, or ends
its search, at its own threshold. The data of a dropped pair is never moved. Neither side is broadcast or gathered; cells are counted, at most pivots^2 a vector
length. Pivots are far-apart vectors of a bounded sample: they only steer the bounds, never the result.

Null vectors and vectors with null or non-finite components, or a null id, take no part. Vectors of different length are
not compared. Repeated ids: rows stand for themselves, and no row of the query's id is a candidate for it but those of
equal id and different content (a repeated row is another row). Ties go to the smaller id. Fewer than k candidates: all.
Components beyond 2^20 after scaling are multiplied with Python integers; a score beyond a long is held at its limit.
Empty table: no rows. Other columns are never read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stockgrid.llm.common import pick, stored

SAFE = float(1 << 20)
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``v`` (array of floor(scale * x) as doubles), ``dim`` for rows that take part."""
    d = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"),
                                                    F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    d = d.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).where(fine)
    return d.select("vec_id", F.transform("e", lambda x: _floor(x * scale)).alias("v"),
                    F.size("e").alias("dim"))


def _floor(x):
    """Floor that stays a double beyond the range of long."""
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first vectors of the sample."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(0.0, (m * m).sum(axis=1)[:, None] - 2 * (m @ pivots.T) + (pivots * pivots).sum(axis=1)))


def inner(m: np.ndarray, q: np.ndarray) -> np.ndarray | list[int]:
    """Exact integer products: doubles hold them while every partial sum stays below 2^53."""
    if max(np.abs(m).max(initial=0), np.abs(q).max(initial=0)) <= SAFE and m.shape[1] <= 1 << 12:
        return (m @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, whole)))) for row in m], dtype=np.int64)


def upper_bounds(gap: np.ndarray, norms: np.ndarray, q_norms) -> np.ndarray:
    """Bounds of inner products from lower bounds of distances and squared norms, with room for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(0.0, gap - 1e-6 * (1.0 + gap))                       # rounding of the distances
        upper = (q_norms + norms - gap * gap) / 2
        upper = upper + 1.0 + 1e-9 * (np.abs(upper) + norms + q_norms)
    return np.where(np.isfinite(upper), upper, np.inf)


def apart(low: np.ndarray, high: np.ndarray, q_low: np.ndarray, q_high: np.ndarray) -> np.ndarray:
    """How far two ranges of distances lie apart, at most over the pivots (last axis); 0 where a range is no number."""
    with np.errstate(invalid="ignore"):
        gap = np.maximum(low - q_high, q_low - high)
    return np.maximum(0.0, np.nan_to_num(gap, nan=0.0, posinf=0.0, neginf=0.0).max(axis=-1, initial=0.0))


def search(q: np.ndarray, q_id: int, q_twin: int, q_table: np.ndarray, ids: np.ndarray, twins: np.ndarray, m: np.ndarray,
           table: np.ndarray, norms: np.ndarray, k: int, step: int = 32, least: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) for one query among the rows of one block that reach ``least``, by elimination, and how many
    candidates were evaluated for it."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.abs(table - q_table).max(axis=1) if table.shape[1] else np.zeros(len(m))
        upper = upper_bounds(gap, norms, q @ q)
    upper[(ids == q_id) & (twins == q_twin)] = -np.inf                        # the query's own row
    order = np.flatnonzero((upper >= least) & (upper > -np.inf))
    order = order[np.argsort(-upper[order], kind="stable")]
    best: list[tuple[int, int]] = []
    done, i = 0, 0
    while i < len(order):
        part = order[i:i + step]
        if len(best) == k and upper[part[0]] < best[-1][0]:
            break
        scores = inner(m[part], q)
        i, done, step = i + step, done + len(part), min(2 * step, 512)
        floor = max(least, best[-1][0]) if len(best) == k else least
        part, scores = part[scores >= floor], scores[scores >= floor]
        top = np.lexsort((ids[part], -scores))[:k]
        best = sorted(best + [(int(scores[j]), int(ids[part[j]])) for j in top], key=lambda x: (-x[0], x[1]))[:k]
    return best, done


def _packed(frame: pd.DataFrame, pivots: np.ndarray) -> dict:
    """A block's rows with their distances, as bytes, and its ranges."""
    m = np.array(frame["v"].tolist(), np.float64)
    table = distances(m, pivots)
    with np.errstate(over="ignore"):
        norms = (m * m).sum(axis=1)
    blobs = {"ids": frame["vec_id"].to_numpy("<i8"), "twins": frame["twin"].to_numpy("<i4"), "m": m, "tab": table, "norms": norms,
             "low": table.min(axis=0), "high": table.max(axis=0)}
    return {"dim": int(frame["dim"].iloc[0]), "block": int(frame["block"].iloc[0]), "top_norm": float(norms.max()),
            **{c: b.tobytes() for c, b in blobs.items()}}


class _Rows:
    """A packed block again as arrays."""

    def __init__(self, r, prefix: str = ""):
        get = lambda c: getattr(r, prefix + c)
        self.ids, self.twins = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("twins"), "<i4")
        self.m, self.tab = np.frombuffer(get("m")).reshape(len(self.ids), -1), np.frombuffer(get("tab")).reshape(len(self.ids), -1)
        self.norms, self.low, self.high = (np.frombuffer(get(c)) for c in ("norms", "low", "high"))


def _first_round(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                data, q = None if r.ids is None else _Rows(r), _Rows(r, "q_")
                found, least = [], np.full(len(q.ids), -np.inf)
                for i in range(len(q.ids) if data else 0):
                    best, done = search(q.m[i], q.ids[i], q.twins[i], q.tab[i], data.ids, data.twins, data.m, data.tab, data.norms, k)
                    found.append({"query_id": int(q.ids[i]), "twin": int(q.twins[i]), "evaluated": done,
                                  "best": [{"vec_id": v, "score": s} for s, v in best]})
                    if len(best) == k:
                        least[i] = best[-1][0]
                yield pd.DataFrame([{"dim": r.dim, "home": r.block, "least": least.tobytes(), "least_of_all": float(least.min()),
                                     "found": found}])
    return run


def _regrouped(frame: pd.DataFrame) -> pd.DataFrame:
    """Packed query blocks as one, with each query's threshold and home."""
    parts = [_Rows(r) for r in frame.itertuples(index=False)]
    least = np.concatenate([np.frombuffer(x) for x in frame["least"]])
    homes = np.repeat(frame["block"].to_numpy("<i4"), [len(p.ids) for p in parts])
    blobs = {c: np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "twins", "m", "tab", "norms")}
    low, high = np.min([p.low for p in parts], axis=0), np.max([p.high for p in parts], axis=0)
    return pd.DataFrame([{"dim": frame["dim"].iloc[0], "group": frame["group"].iloc[0], "q_top_norm": float(frame["top_norm"].max()),
                          **{f"q_{c}": b.tobytes() for c, b in blobs.items()}, "q_low": low.tobytes(), "q_high": high.tobytes(),
                          "least": least.tobytes(), "homes_of": homes.tobytes(), "least_of_all": float(least.min())}])


def _kept_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a data block and a query group that may hold a better candidate, from two chunks of ranges."""
    for frame in frames:
        for r in frame.itertuples(index=False):
            low, high = np.array([np.frombuffer(x) for x in r.low]), np.array([np.frombuffer(x) for x in r.high])
            out = []
            for j, group in enumerate(r.groups):
                gap = apart(low, high, np.frombuffer(r.q_low[j]), np.frombuffer(r.q_high[j]))
                keep = upper_bounds(gap, np.asarray(r.top_norm, float), r.q_top_norm[j]) >= r.least_of_all[j]
                out += [(r.dim, int(r.blocks[i]), int(group)) for i in np.flatnonzero(keep)]
            yield pd.DataFrame(out, columns=["dim", "block", "group"])


def _second_round(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                data, q, least = _Rows(r), _Rows(r, "q_"), np.frombuffer(r.least)
                gap = apart(data.low, data.high, q.tab, q.tab)
                reach = upper_bounds(gap, np.full(len(q.ids), r.top_norm), q.norms) >= least
                reach &= np.frombuffer(r.homes_of, "<i4") != r.block    # searched in the first round
                out = []
                for i in np.flatnonzero(reach):
                    best, done = search(q.m[i], q.ids[i], q.twins[i], q.tab[i], data.ids, data.twins, data.m, data.tab, data.norms,
                                        k, least=least[i])
                    out.append({"query_id": int(q.ids[i]), "twin": int(q.twins[i]), "evaluated": done,
                                "best": [{"vec_id": v, "score": s} for s, v in best]})
                yield pd.DataFrame(out, columns=["query_id", "twin", "evaluated", "best"])
    return run


GROUPED = ("dim int, group int, q_top_norm double, q_ids binary, q_twins binary, q_m binary, q_tab binary, q_norms binary, "
           "q_low binary, q_high binary, least binary, homes_of binary, least_of_all double")
FOUND = "query_id long, twin int, evaluated long, best array<struct<vec_id long, score long>>"
CHUNK = 256  # blocks whose ranges travel as one row
LARGE = 8  # cells of more blocks are divided by the second nearest pivot before they are cut by hash


def searched(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 128, sample: int = 2048,
             rows: int = 2048) -> DataFrame | None:
    """Both rounds: for each query (``query_id``, ``twin``) and block searched the ``best`` candidates found there and how many
    were ``evaluated``. ``sample`` bounds the rows that pivots are chosen from, ``rows`` the rows of a block; None without
    queries."""
    spark = vectors.sparkSession
    # rows that repeat an id are told apart by their number among the id's rows
    twin = F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) - 1
    d = stored(quantised(vectors, scale).withColumn("twin", twin.cast("int")), "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    sizes = d.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).where("q > 0").collect()
    if not sizes:
        return None
    dims = [r["dim"] for r in sizes]    # one row a vector length
    # as many cells as blocks are needed, around the first pivots, which are the farthest apart; bounds use all pivots
    centres = {r["dim"]: min(pivots, -(-r["n"] // rows)) for r in sizes}
    chosen = {}
    for dim in dims:
        some = d.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "twin"), "vec_id", "twin").limit(sample).select("v").collect()
        chosen[dim] = choose_pivots(np.array([r["v"] for r in some], np.float64), pivots)
    shared = spark.sparkContext.broadcast(chosen)  # pivots x length numbers for each vector length

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = np.zeros((len(frame), 2), np.int32)
            for dim, at in frame.groupby("dim").indices.items():
                table = np.nan_to_num(distances(np.array(frame["v"].iloc[at].tolist(), np.float64), shared.value[int(dim)][:centres[int(dim)]]), nan=np.inf)
                first = table.argmin(axis=1)
                table[np.arange(len(at)), first] = np.inf
                near[at, 0], near[at, 1] = first, table.argmin(axis=1)
            yield frame.assign(near=near[:, 0], second=near[:, 1])

    placed = stored(d.where(F.col("dim").isin(dims)).mapInPandas(
        place, "vec_id long, v array<double>, dim int, twin int, near int, second int"), "topk-placed")
    # cells with their blocks: counts of at most pivots^2 cells a vector length
    counts = placed.groupBy("dim", "near", "second").agg(F.count("*").alias("n")).collect()
    whole: dict[tuple[int, int], int] = {}
    for r in counts:
        whole[r["dim"], r["near"]] = whole.get((r["dim"], r["near"]), 0) + r["n"]
    start, blocks_of, cells = {}, {}, []
    for r in sorted(counts, key=lambda r: (r["dim"], r["near"], r["second"])):
        large = whole[r["dim"], r["near"]] > LARGE * rows
        key = (r["dim"], r["near"], r["second"] if large else -1)
        if key not in start:
            n_sub = -(-(r["n"] if large else whole[r["dim"], r["near"]]) // rows)
            start[key] = (blocks_of.get(r["dim"], 0), n_sub)
            blocks_of[r["dim"]] = start[key][0] + n_sub
        cells.append((r["dim"], r["near"], r["second"], *start[key]))
    cells = F.broadcast(spark.createDataFrame(cells, "dim int, near int, second int, start int, n_sub int"))
    dealt = lambda salt: (F.col("start") + F.pmod(F.xxhash64(F.lit(salt), "vec_id", "twin"), F.col("n_sub"))).cast("int")
    placed = placed.join(cells, ["dim", "near", "second"]).select("vec_id", "v", "dim", "twin", dealt("v").alias("block"),
                                                                  dealt("q").alias("home"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_packed(frame, shared.value[int(frame["dim"].iloc[0])])])

    data = stored(placed.groupBy("dim", "block").applyInPandas(pack, PACKED), "topk-blocks")
    queries = stored(placed.where(is_query).drop("block").withColumnRenamed("home", "block").groupBy("dim", "block").applyInPandas(
        pack, PACKED), "topk-queries")
    blobs = ["ids", "twins", "m", "tab", "norms", "low", "high"]
    as_query = [F.col(c).alias(f"q_{c}") for c in blobs]
    # a small block may have got no row: its queries go on without a threshold
    home = queries.select("dim", "block", *as_query).join(data, ["dim", "block"], "left")
    first = stored(home.mapInPandas(_first_round(k), f"dim int, home int, least binary, least_of_all double, found array<struct<{FOUND}>>"),
                   "topk-first")

    # neighbouring homes' queries together, about a block full, so that a data block is moved once for all of them
    per_group = spark.createDataFrame([(r["dim"], max(1, r["n"] // r["q"]), -(-blocks_of[r["dim"]] // CHUNK)) for r in sizes],
                                      "dim int, homes int, n_chunks int")
    small = F.broadcast(per_group)  # one row a vector length
    with_least = queries.join(first.select("dim", F.col("home").alias("block"), "least"), ["dim", "block"]).join(small, "dim")
    grouped = stored(with_least.withColumn("group", (F.col("block") / F.col("homes")).cast("int")).groupBy("dim", "group").applyInPandas(
        _regrouped, GROUPED), "topk-groups")

    # ranges of data blocks against ranges of query groups, a chunk of each at a time
    left = _chunked(data.select("dim", (F.col("block") / CHUNK).cast("int").alias("dc"), F.struct("block", "low", "high", "top_norm").alias("s")),
                    "dc", {"block": "blocks", "low": "low", "high": "high", "top_norm": "top_norm"})
    right = _chunked(grouped.select("dim", (F.col("group") / CHUNK).cast("int").alias("qc"),
                                    F.struct("group", "q_low", "q_high", "q_top_norm", "least_of_all").alias("s")), "qc",
                     {c: c for c in ("q_low", "q_high", "q_top_norm", "least_of_all")} | {"group": "groups"})
    all_chunks = lambda name: F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias(name)
    left = left.join(small, "dim").select("dim", "dc", "blocks", "low", "high", "top_norm", all_chunks("qc"))
    right = right.join(small, "dim").select("dim", "qc", "groups", "q_low", "q_high", "q_top_norm", "least_of_all", all_chunks("dc"))
    pairs = stored(left.join(right, ["dim", "dc", "qc"]).mapInPandas(_kept_pairs, "dim int, block int, group int"), "topk-pairs")
    # both sides are dealt by pair, so that neither many blocks of one group nor many groups of one block share a task
    asked = lambda by, other: pairs.groupBy("dim", by).agg(F.collect_list(other).alias("to"))
    left = data.join(asked("block", "group"), ["dim", "block"]).withColumn("group", F.explode("to")).drop("to")
    right = grouped.join(asked("group", "block"), ["dim", "group"]).withColumn("block", F.explode("to")).drop("to")
    second = left.hint("shuffle_hash").join(right, ["dim", "block", "group"]).mapInPandas(_second_round(k), FOUND)
    return first.select(F.inline("found")).unionByName(second)


def _chunked(df: DataFrame, chunk: str, names: dict[str, str]) -> DataFrame:
    """Structs ``s`` of a chunk as parallel arrays; a chunk holds ``CHUNK`` of them at most."""
    packed = df.groupBy("dim", chunk).agg(F.collect_list("s").alias("s"))
    return packed.select("dim", chunk, *[F.col(f"s.{c}").alias(a) for c, a in names.items()])


def top_k(vectors: DataFrame, k: int = 5, **how) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best rows for each row whose id is divisible by ``every``. For the
    other parameters see ``searched``."""
    found = searched(vectors, k, **how)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = found.select("query_id", "twin", F.inline("best"))
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: DataFrame, k: int = 5, every: int = 50, **how) -> float:
    """The share of all (query, candidate) pairs whose score was computed."""
    found = searched(vectors, k, every, **how)
    if found is None:
        return 0.0
    sizes = quantised(vectors, how.get("scale", 256)).groupBy("dim").agg(
        F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    pairs = sizes.agg(F.sum(F.col("q") * (F.col("n") - 1))).first()[0]
    return found.agg(F.sum("evaluated")).first()[0] / pairs if pairs else 0.0


PACKED = ("dim int, block int, top_norm double, ids binary, twins binary, m binary, tab binary, norms binary, low binary, "
          "high binary")

TOP_K_SQL = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
