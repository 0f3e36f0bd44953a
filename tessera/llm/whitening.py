"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

Vectors become whole numbers x = floor(1024 c) + 100000 and are packed once into
blocks of rows, written to the shared checkpoint folder. The centred rows are the
matrix A (n x d). From a seeded random direction v each step of the bidiagonalisation
makes one distributed product Av, orthogonalises it against all earlier left
vectors, and takes Aᵀ of the result, which, orthogonalised against all earlier
right vectors, is the next direction. Both products of a step are sums over the
blocks and share one pass.

A left vector has n entries, so none is ever stored: u = Aw for a direction w of
d entries, and the tasks make u anew from their rows (``w`` of all earlier steps:
d x k numbers). Inner products of left vectors are sums over the rows too: the
reorthogonalisation is a full one, a step whose products were not orthogonal is
repeated. The small matrix R with AV = UR (bidiagonal but for rounding and for
restarts) is decomposed on the driver: its singular values are deviations, the
right vectors the components. Steps end when the wanted ones are exact to double
precision by their residuals AᵀAy - s²y, and a restart from a random direction
outside the space seen so far finds nothing larger (several components of one
deviation show up only so), or after d steps, when the space is whole.

The driver holds d x k numbers, tasks one block and d x k numbers; no row leaves
its partition, so a common vector or hot key has no effect.

Defined results: rows whose vector is null, empty, of another length than the
most frequent one (of several, the longest), or holds null or non-finite entries
are dropped; all others are rows of their own, whatever their id (null and
repeated ids stay). Components of no deviation (beyond the rank of the rows)
are left out, so equal vectors, a single row and an empty table give an empty
result. A ``deviation`` beyond 64 bits is null; ``deviation_exact`` always
holds it. Entries of which x is beyond 2^52 raise an error. Only the id and vector
columns are read, other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.steps import settle

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
BLOCK_BYTES = 2 << 20
#: Steps after a restart before the components count as confirmed.
CONFIRM = 16


def usable(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """((id, v) of the rows with a vector that counts, its length)."""
    v = F.col(vector_col)
    rows = table.select(F.col(id_col).alias("id"), v.alias("v")).where(
        F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = first["d"] if first else 0
    return rows.where(F.size("v") == d), d


def packed(rows: DataFrame, d: int) -> DataFrame:
    """(ids array, x binary): blocks of rows, x as 64-bit numbers row by row."""
    id_type = rows.schema["id"].dataType.simpleString()
    height = max(1, BLOCK_BYTES // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, height):
                part = b.slice(at, height)
                m = part.num_rows
                c = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(SCALE * c) + SHIFT
                if len(x) and np.abs(x).max() > 2.0**52:
                    raise ValueError("an entry is too large for a whole number of 52 bits")
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), part.column(0)),
                     pa.array([x.astype(np.int64).tobytes()], pa.binary())], names=["ids", "x"])

    return rows.mapInArrow(run, f"ids array<{id_type}>, x binary")


def total(blocks: DataFrame, d: int, size: int, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of the vector (of ``size`` entries) that
    ``part`` makes of a block's rows; summed in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            for x in b.column(0).to_pylist():
                v = part(np.frombuffer(x, dtype=np.int64).reshape(-1, d))
                acc = v if acc is None else acc + v
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(acc)], names=["pos", "v"])

    out = np.zeros(size, dtype=np.float64 if kind == "double" else np.int64)
    for r in blocks.select("x").mapInArrow(run, f"pos int, v {kind}").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[r["pos"]] = r["v"]
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact (Python numbers where 64 bits are too few)."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, s), default=0) < 2**62:
        return n * x - np.array(s, dtype=np.int64)
    return n * x.astype(object) - np.array(s, dtype=object)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    return deviations(x, n, s).astype(np.float64) / n


def lanczos(product: Callable, d: int, wanted: int, seed: int, tol: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors d x c) of the largest ``wanted``, falling.
    ``product(w, W)`` is ((AW)ᵀAw, |Aw|², AᵀAw)."""
    rng = np.random.default_rng(seed)
    V, W, G = (np.zeros((d, 0)) for _ in range(3))  # right vectors, U = AW, G = AᵀU
    R = np.zeros((0, 0))

    def outside(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - V @ (V.T @ r)
        return r

    def start() -> np.ndarray:
        r = outside(rng.standard_normal(d))
        return r / np.linalg.norm(r)

    v, top, since = start(), None, 0
    while True:
        k = V.shape[1]
        c = G.T @ v  # UᵀAv
        w = v - W @ c
        for _ in range(3):
            s, q, g = product(w, W)
            if np.linalg.norm(s) <= 1e-10 * np.sqrt(q):
                break
            w, c = w - W @ s, c + s
        a = np.sqrt(max(q - s @ s, 0.0))
        scale = max(a, np.abs(R).max(initial=0.0))
        if a > 1e-13 * scale:
            w, g, c = (w - W @ s) / a, (g - G @ s) / a, c + s
        else:  # no row has a part in this direction but through earlier ones
            w, g, a = np.zeros(d), np.zeros(d), 0.0
        R = np.block([[R, c[:, None]], [np.zeros((1, k)), np.array([[a]])]])
        V, W, G = (np.column_stack([m, x]) for m, x in ((V, v), (W, w), (G, g)))
        _, sv, Qt = np.linalg.svd(R)
        y = V @ Qt.T[:, :wanted]
        rest = G @ (R @ Qt.T[:, :wanted]) - y * sv[:wanted] ** 2
        if k + 1 == d or sv[0] == 0:
            break
        r = outside(g)
        b, since = np.linalg.norm(r), since + 1
        done = k + 1 >= wanted and np.abs(rest).max() <= tol * sv[0] ** 2
        if done and since >= CONFIRM and top is not None and np.allclose(top, sv[:wanted], rtol=1e-12, atol=0):
            break
        if done and (top is None or since >= CONFIRM):
            top, since, v = sv[:wanted], 0, start()
        else:
            v = r / b if b > 1e-13 * sv[0] else start()
    keep = sv[:wanted] > 1e-10 * sv[0] if sv[0] > 0 else np.zeros(len(sv[:wanted]), bool)
    y = y[:, keep] / np.linalg.norm(y[:, keep], axis=0)
    sign = np.sign(y[np.abs(y).argmax(axis=0), np.arange(y.shape[1])]) if y.shape[1] else np.ones(0)
    return sv[:wanted][keep], y * sign


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           seed: int = 1) -> DataFrame:
    """One row for each remaining row and component: (id, component int, n,
    deviation, whitened, explained, identity_error, deviation_exact)."""
    rows, d = usable(table, id_col, vector_col)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, deviation_exact decimal(38,0)")
    empty = rows.select("id").limit(0).selectExpr(
        "id", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (f.strip().split(" ") for f in schema.split(", ")[1:]))).withColumnRenamed("id", id_col)
    if not d:
        return empty
    blocks = settle(packed(rows, d))
    sums = total(blocks, d, d + 1, "bigint", lambda x: np.append(x.sum(axis=0), len(x)))
    n, s = int(sums[d]), sums[:d].tolist()

    def product(w: np.ndarray, W: np.ndarray):
        k = W.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            a = centred(x, n, s)
            u = a @ w
            return np.concatenate([(a @ W).T @ u, [u @ u], a.T @ u])

        out = total(blocks, d, k + 1 + d, "double", part)
        return out[:k], out[k], out[k + 1:]

    trace = total(blocks, d, 1, "double", lambda x: np.array([(centred(x, n, s) ** 2).sum()]))[0] / n
    if trace == 0:
        return empty
    sigma, y = lanczos(product, d, min(components, d), seed)
    e = sigma**2 / n
    c, to = len(e), y / np.sqrt(e)

    def second(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, s) @ to
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    m = total(blocks, d, c + c * c, "double", second) / n
    error = float(np.abs(m[c:].reshape(c, c) - np.outer(m[:c], m[:c]) - np.eye(c)).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                ids, x = b.column(0).slice(j, 1).flatten(), np.frombuffer(b.column(1)[j].as_py(), dtype=np.int64).reshape(-1, d)
                z, dev = centred(x, n, s) @ to, deviations(x, n, s)
                if dev.dtype == object or d * int(np.abs(dev).max(initial=0)) ** 2 >= 2**63:
                    dev = dev.astype(object)
                whole = [int(t) for t in (dev * dev).sum(axis=1)]
                row = np.repeat(np.arange(len(ids)), c)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(ids))),
                     pa.array(np.full(len(row), n, dtype=np.int64)),
                     pa.array([t if t < 2**63 else None for t in whole], pa.int64()).take(at), pa.array(z.ravel()),
                     pa.array(np.tile(explained, len(ids))), pa.array(np.full(len(row), error)),
                     pa.array([Decimal(t) for t in whole], pa.decimal128(38, 0)).take(at)],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return blocks.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
