"""Near-duplicate vectors with randomised-rotation binary codes.

Vectors are turned by seeded random rotations; the signs are binary codes. Groups of code bits are the keys of an index
that holds every row: as many bits as keep buckets small at the row count, as many tables as give a stated recall for
pairs right at the threshold. A bucket proposes all its pairs where it is small, else pairs with a centre and the
neighbour; the members of such over-full buckets are then held against each other by components: each component that the
proposed pairs give is a ball (mean direction, largest angle to it), balls of a bucket that come within the threshold
angle are compared member by member, all others are excluded by that bound. For a proposed pair the stored correction
factor of one side (the inner product of the vector with its code) gives the unbiased estimate <code, q> / factor of its
cosine; its error is of the order sqrt(1 - factor^2) / (factor sqrt(d - 1)), and CONFIDENCE times that is the confidence
bound. Estimates that lie below the threshold by more than the bound decide against the pair, all others are recomputed
exactly in double precision. Equal vectors are one row with a weight from the start.

Direct links are then counted within the components. By the angles to a component's mean direction, vectors within
half the threshold angle (the core) link with each other for certain and are only counted; all others (the rim) are held
against the whole component in blocks of bounded size.

Defined results: null, zero and non-finite vectors link with nothing; vectors link only within one dimension; repeated
rows with one id are one vector (the smallest array); a null id links with nothing and gets component null, kept false.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, load

RECALL, CONFIDENCE, SMALL, RIM_BLOCK, MEMBER_BLOCK = 0.95, 4.0, 8, 256, 1024
# SLACK is above what single precision does to an angle; components above PAIRWISE are compared in blocks.
BALL_BLOCK, PAIRWISE, SLACK = 1024, 64, 2e-3


@functools.lru_cache(64)
def rotation(dim: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, k, 17]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan(rows: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits a key, tables): about one stranger in a bucket, and the recall at the threshold itself."""
    bits = min(40, max(8, math.ceil(math.log2(max(rows, 2)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _matrix(col) -> np.ndarray:
    """A batch column of equally long double arrays as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _by_dim(batch, at: int):
    dims = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _signs(x: np.ndarray, k: int) -> np.ndarray:
    return x @ rotation(x.shape[1], k).T >= 0


def _indexer(bits: int, tables: int):
    def run(batches):
        for batch in batches:
            for d, part in _by_dim(batch, 1):
                x, ids = _matrix(part.column(1)), part.column(0)
                signs, turns = _signs(x, 0), 1
                factor = np.abs(x @ rotation(d, 0).T).sum(1) / math.sqrt(d)
                code = np.packbits(signs, axis=1)
                while signs.shape[1] < bits * tables:
                    signs = np.hstack([signs, _signs(x, turns)])
                    turns += 1
                weights = np.int64(1) << np.arange(bits, dtype=np.int64)
                for t in range(tables):
                    key = signs[:, t * bits:(t + 1) * bits] @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d << 20 | t), pa.int64()), pa.array(key), ids, pa.array(list(map(bytes, code)), pa.binary()), pa.array(factor)], names=["place", "key", "id", "code", "factor"])

    return run


def _propose(batches):
    """Pairs (q, id, code, factor) from rows sorted by bucket, and (id, null, place, key) for each row of an over-full one.

    The bucket's state goes on from batch to batch.
    """
    now, held, n = None, [], 0
    for batch in batches:
        out: list[tuple] = []
        for place, key, i, code, factor in zip(*(c.to_pylist() for c in batch.columns)):
            if (place, key) != now:
                now, held, n = (place, key), [], 0
            if n < SMALL:
                out += [(q, i, code, factor, None, None) for q in held]
                held.append(i)
            else:
                out += [(q, None, None, None, place, key) for q in (held if n == SMALL else []) + [i]]
                out += [(held[0], i, code, factor, None, None), (held[-1], i, code, factor, None, None)]
                held[-1] = i
            n += 1
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], names=["a", "b", "code", "factor", "place", "key"])


def estimate(code: np.ndarray, factor: np.ndarray, q: np.ndarray, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimate of <o, q> from o's code and factor, and how far from it the value lies at that confidence."""
    d = q.shape[1]
    signs = np.unpackbits(code, axis=1)[:, :d].astype(np.float64) * 2 - 1
    s = (signs * (q @ rotation(d, 0).T)).sum(1) / math.sqrt(d)
    return s / factor, confidence * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * math.sqrt(max(1, d - 1)))


def _bounded(cosine: float):
    """Keeps proposed pairs whose estimate doesn't decide against them; columns a, b, code, factor, x (of a)."""
    def run(batches):
        for batch in batches:
            for _, part in _by_dim(batch, 4):
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                about, bound = estimate(code, part.column(3).to_numpy(), _matrix(part.column(4)))
                yield part.select([0, 1]).filter(pa.array(about + bound >= cosine - 1e-9))

    return run


def _exact(cosine: float):
    def run(batches):
        for batch in batches:
            for _, part in _by_dim(batch, 2):
                dot = (_matrix(part.column(2)) * _matrix(part.column(3))).sum(1)
                yield part.select([0, 1]).filter(pa.array(dot >= cosine))

    return run


def _placed(cosine: float):
    """core: within half the threshold angle of the component's mean direction."""
    half = math.acos(cosine) / 2 - 1e-7

    def run(batches):
        for batch in batches:
            for _, part in _by_dim(batch, 2):
                x, m = _matrix(part.column(2)), _matrix(part.column(3))
                norm = np.linalg.norm(m, axis=1)
                cos = np.clip((x * m).sum(1) / np.where(norm > 0, norm, 1), -1, 1)
                core = (np.arccos(cos) <= half) & (norm > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(core), part.column(4)], names=["comp", "id", "x", "core", "w"])

    return run


def _count_block(cosine: float):
    def run(pdf):
        import pandas as pd

        rim, mem = pdf[pdf.rim], pdf[~pdf.rim]
        if rim.empty or mem.empty:
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        hit = np.vstack(rim.x.to_numpy()) @ np.vstack(mem.x.to_numpy()).T >= cosine
        hit &= rim.id.to_numpy()[:, None] != mem.id.to_numpy()[None, :]
        core = mem.core.to_numpy()
        return pd.DataFrame({"id": np.concatenate([rim.id.to_numpy(), mem.id.to_numpy()[core]]), "n": np.concatenate([hit @ mem.w.to_numpy(), rim.w.to_numpy() @ hit[:, core]])})

    return run


def _angles(batches):
    """Angle of each member to its component's mean direction; a component without one is a ball of half a turn."""
    for batch in batches:
        for _, part in _by_dim(batch, 2):
            x, m = _matrix(part.column(2)), _matrix(part.column(3))
            norm = np.linalg.norm(m, axis=1)
            angle = np.where(norm > 0, np.arccos(np.clip((x * m).sum(1) / np.where(norm > 0, norm, 1), -1, 1)), math.pi)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(angle)], names=["comp", "id", "x", "angle"])


def _meet(cosine: float):
    """(a, b, angle of the means) of components in one bucket whose balls come within the threshold angle; rows sorted by bucket."""
    reach = math.acos(cosine) + SLACK

    def close(part):
        comp, r, m = part.column(5).to_numpy(), part.column(6).to_numpy(), _matrix(part.column(7).combine_chunks())
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        angle = np.arccos(np.clip(m @ m.T, -1, 1))
        i, j = np.nonzero(np.triu(angle <= reach + r[:, None] + r[None, :], 1))
        return np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]), angle[i, j].astype(np.float64)

    def emit(table):
        keys = np.column_stack([table.column(k).to_numpy() for k in range(5)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        found = [close(table.slice(s, e - s)) for s, e in zip(cuts, cuts[1:]) if e - s > 1]
        a, b, angle = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(angle)], names=["a", "b", "angle"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = np.column_stack([table.column(k).to_numpy() for k in range(5)])
            before = np.flatnonzero((keys != keys[-1]).any(1))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield emit(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield emit(rest)

    return run


def _link_block(cosine: float):
    """One link of each small component to the large one that has any in this block."""
    def run(pdf):
        import pandas as pd

        big, small = pdf[pdf.large], pdf[~pdf.large]
        if big.empty or small.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        hit = np.vstack(big.x.to_numpy()) @ np.vstack(small.x.to_numpy()).T >= cosine
        found = pd.DataFrame({"a": big.id.to_numpy()[hit.argmax(0)], "b": small.id.to_numpy(), "comp": small.comp.to_numpy()})[hit.any(0)]
        return found.drop_duplicates("comp")[["a", "b"]]

    return run


def _across(sc: Scratch, unit: DataFrame, full: DataFrame, links: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) that join components which share an over-full bucket; full has its rows (place, key, id).

    Pairs within a component need no look, as links are counted within components afterwards.
    """
    of = sc.table(components(links, sc, "first"), "first").select("id", F.col("component_id").alias("comp"))
    held = sc.table(full.join(of, "id", "left").select("place", "key", F.coalesce("comp", "id").alias("comp")).distinct(), "held")
    many = held.groupBy("place", "key").agg(F.count("*").alias("n")).filter("n > 1").select("place", "key", F.ceil(F.col("n") / BALL_BLOCK).cast("int").alias("blocks"))
    mixed = sc.table(held.join(many, ["place", "key"]), "mixed")
    members = unit.join(of, "id", "left").select(F.coalesce("comp", "id").alias("comp"), "id", "x").join(mixed.select("comp").distinct(), "comp", "left_semi")
    members = sc.table(members, "across-members")
    means = sc.table(members.groupBy("comp").agg(Summarizer.mean(array_to_vector("x")).alias("m")).select("comp", vector_to_array("m").alias("m")), "across-means")
    turned = sc.table(members.join(means, "comp").select("comp", "id", "x", "m").mapInArrow(_angles, "comp long, id long, x array<double>, angle double"), "turned")
    balls = turned.groupBy("comp").agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.max("angle") + 1e-7).otherwise(0.0).alias("r"))
    balls = sc.table(balls.join(means, "comp").select("comp", "n", "r", F.col("m").cast("array<float>").alias("m")), "balls")

    at = ["place", "key", "p", "q", "dim"]
    side = mixed.withColumn("s", F.pmod(F.xxhash64("comp"), F.col("blocks")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = side.select("place", "key", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"), "comp").join(balls, "comp").withColumn("dim", F.size("m"))
    met = rows.select(*at, "comp", "r", "m").repartition(*at).sortWithinPartitions(*at).mapInArrow(_meet(cosine), "a long, b long, angle double")
    met = sc.table(met.groupBy("a", "b").agg(F.min("angle").alias("angle")), "met")

    a, b = (balls.select(F.col("comp").alias(c), F.col("n").alias(f"n_{c}"), F.col("r").alias(f"r_{c}")) for c in "ab")
    first = F.col("n_a") >= F.col("n_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    gap = F.col("angle") - math.acos(cosine) - pick("r_b", "r_a") - SLACK
    sided = sc.table(met.join(a, "a").join(b, "b").select(pick("a", "b").alias("big"), pick("b", "a").alias("small"), F.greatest("n_a", "n_b").alias("n"), gap.alias("gap")), "sided")
    # a member nearer to its mean than the gap can't reach the other ball
    near = turned.select(F.col("comp").alias("big"), F.col("id").alias("a"), "x", "angle")
    far = turned.select(F.col("comp").alias("small"), F.col("id").alias("b"), F.col("x").alias("y"))
    pairs = sided.filter(F.col("n") <= PAIRWISE).join(near, "big").filter("angle >= gap").join(far, "small")
    few = pairs.select("a", "b", "x", "y").mapInArrow(_exact(cosine), "a long, b long")

    large = sided.filter(F.col("n") > PAIRWISE)
    edge = sc.table(near.join(large.groupBy("big").agg(F.min("gap").alias("gap")), "big").filter("angle >= gap").select("big", F.col("a").alias("id"), F.col("big").alias("comp"), "x"), "edge")
    other = sc.table(large.select("big", "small").join(far, "small").select("big", F.col("b").alias("id"), F.col("small").alias("comp"), F.col("y").alias("x")), "other")
    count = lambda t, name: t.groupBy("big").agg(F.ceil(F.count("*") / BALL_BLOCK).cast("int").alias(name))
    sizes = count(edge, "u_n").join(count(other, "v_n"), "big")
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = edge.join(sizes, "big").select("big", block("u_n", 3).alias("u"), each("v_n").alias("v"), "id", "comp", "x", F.lit(True).alias("large"))
    right = other.join(sizes, "big").select("big", each("u_n").alias("u"), block("v_n", 4).alias("v"), "id", "comp", "x", F.lit(False).alias("large"))
    return few.union(left.union(right).groupBy("big", "u", "v").applyInPandas(_link_block(cosine), "a long, b long"))


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept), one row per distinct id."""
    sc = Scratch(spark, "embeddings")
    rows = vectors.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vec_col).cast("array<double>")).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))
    good = "id is not null and norm > 0 and norm < double('inf') and forall(v, e -> e is not null and not isnan(e))"
    rows = sc.table(rows.withColumn("x", F.when(F.expr(good), F.transform("v", lambda e: e / F.col("norm")))).select("id", "x"), "rows")
    # equal vectors are one class: its least id, and its size as weight
    classes = sc.table(rows.filter("x is not null and exists(x, e -> e <> 0)").groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("w")), "classes")
    unit = classes.select("id", "x")
    bits, tables = plan(unit.count(), cosine, recall)
    index = unit.mapInArrow(_indexer(bits, tables), "place long, key long, id long, code binary, factor double")
    near = index.repartition("place", "key").sortWithinPartitions("place", "key", "id").mapInArrow(_propose, "a long, b long, code binary, factor double, place long, key long")
    near = sc.table(near.groupBy("a", "b", "place", "key").agg(F.first("code").alias("code"), F.first("factor").alias("factor")), "proposed")
    full = near.filter("b is null").select("place", "key", F.col("a").alias("id"))
    bounded = near.filter("b is not null").join(unit.select(F.col("id").alias("a"), "x"), "a").select("a", "b", "code", "factor", "x").mapInArrow(_bounded(cosine), "a long, b long")
    both = bounded.join(unit.select(F.col("id").alias("a"), "x"), "a").join(unit.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").filter(F.size("x") == F.size("y"))
    links = sc.table(both.select("a", "b", "x", "y").mapInArrow(_exact(cosine), "a long, b long"), "links")
    if full.limit(1).count():
        links = links.union(sc.table(_across(sc, unit, full, links, cosine), "across"))
    comps = sc.table(components(links, sc), "comps")

    members = sc.table(comps.select("id", F.col("component_id").alias("comp")).join(classes, "id").select("comp", "id", "x", "w"), "members")
    means = sc.table(members.groupBy("comp").agg(Summarizer.mean(array_to_vector("x")).alias("m")).select("comp", vector_to_array("m").alias("m")), "means")
    placed = sc.table(members.join(means, "comp").select("comp", "id", "x", "m", "w").mapInArrow(_placed(cosine), "comp long, id long, x array<double>, core boolean, w long"), "placed")
    in_core = F.coalesce(F.sum(F.when(F.col("core"), F.col("w"))), F.lit(0)).alias("core_w")
    sizes = sc.table(placed.groupBy("comp").agg(in_core, F.count("*").alias("all_n"), F.count_if(~F.col("core")).alias("rim_n")), "sizes")
    blocks = sizes.filter("rim_n > 0").select("comp", F.ceil(F.col("rim_n") / RIM_BLOCK).cast("int").alias("rims"), F.ceil(F.col("all_n") / MEMBER_BLOCK).cast("int").alias("mems"))
    held = placed.join(blocks, "comp")
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rim = held.filter("not core").select("comp", block("rims", 1).alias("r"), each("mems").alias("m"), "id", "x", "core", "w", F.lit(True).alias("rim"))
    mem = held.select("comp", each("rims").alias("r"), block("mems", 2).alias("m"), "id", "x", "core", "w", F.lit(False).alias("rim"))
    exact = rim.union(mem).groupBy("comp", "r", "m").applyInPandas(_count_block(cosine), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # a class links with its own copies; those of the core are in the core's weight already
    own = F.when(F.col("core"), F.col("core_w")).otherwise(F.col("w")) - 1
    counted = placed.drop("x").join(sizes, "comp").join(exact, "id", "left").select("id", "comp", (own + F.coalesce("n", F.lit(0))).alias("n"))
    alone = classes.join(counted.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp"), (F.col("w") - 1).alias("n"))
    known = classes.select("x", "id").join(counted.union(alone), "id").select("x", "comp", "n")
    linked = rows.filter("x is not null and exists(x, e -> e <> 0)").join(known, "x").select("id", F.col("comp").alias("component_id"), F.col("n").alias("n_links"))
    out = rows.select("id").join(linked, "id", "left")
    comp = F.coalesce("component_id", "id")
    found = sc.table(out.select(F.col("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(False)).alias("kept")), "out")
    sc.drop("rows", "classes", "proposed", "links", "comps", "members", "means", "placed", "sizes")
    return found


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def brute_force(vectors: dict, cosine: float) -> dict:
    """id -> (n_links, component_id) from all pairs, for tests."""
    ids = sorted(i for i, v in vectors.items() if v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v) and any(v))
    comp, n = {i: i for i in vectors}, dict.fromkeys(vectors, 0)
    x = {i: np.array(vectors[i], float) / np.linalg.norm(np.array(vectors[i], float)) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if len(x[a]) == len(x[b]) and x[a] @ x[b] >= cosine:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return {i: (n[i], comp[i]) for i in vectors}
