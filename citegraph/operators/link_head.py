"""A trained logistic head over the embedding of a link (``hadamard``, ``l1``, ``l2``, ``avg`` or ``concat`` of its
ends' vectors), with the gradient for the head and, through both ends, for the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators.cells import SLICE, _arrow, add_to, add_up, cells_for, column, over_links, vector_table
from citegraph.operators.gnn import AdamState, added, glorot
from citegraph.session import RunTables

OPS = ("hadamard", "l1", "l2", "avg", "concat")


def combine(a: np.ndarray, b: np.ndarray, op: str) -> np.ndarray:
    """Link embeddings of rows of vectors."""
    return {"hadamard": lambda: a * b, "l1": lambda: np.abs(a - b), "l2": lambda: (a - b) ** 2, "avg": lambda: (a + b) / 2,
            "concat": lambda: np.hstack([a, b])}[op]()


def through(a: np.ndarray, b: np.ndarray, w: np.ndarray, op: str) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of ``w · combine(a, b)`` at a and at b."""
    half = a.shape[1]
    one = np.ones_like(a)
    return {"hadamard": lambda: (w * b, w * a), "l1": lambda: (w * np.sign(a - b), w * np.sign(b - a)),
            "l2": lambda: (2 * w * (a - b), 2 * w * (b - a)), "avg": lambda: (one * w / 2, one * w / 2),
            "concat": lambda: (one * w[:half], one * w[half:])}[op]()


ENDS = ("source array<long>, target array<long>, label array<double>, a_ids array<long>, a array<double>, a_at array<long>, "
        "b_ids array<long>, b array<double>, b_at array<long>")


def with_ends(links: DataFrame, emb: DataFrame, id_col: str = "id", vec_col: str = "h") -> DataFrame:
    """Links (source, target, label) with both ends' vectors, a row a cell (:mod:`citegraph.operators.cells`): the vector of a node
    stands once in a cell, however many links it ends there. A link stands once for each vector of an id that repeats; an end
    without one is an error. Both tables should be stored."""
    vectors = emb.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(id_col, vec_col)
    if vectors.groupBy(id_col).count().where("count > 1").isEmpty():
        return _dealt(links, vectors, id_col, vec_col)
    out = links.select("source", "target", "label")
    for end, name in (("source", "a"), ("target", "b")):
        out = out.join(vectors.select(F.col(id_col).alias(end), F.col(vec_col).cast("array<double>").alias(name)), end, "left")
    out = out.where(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(True)).otherwise(F.raise_error(
        F.concat_ws(" ", F.lit("link end without a vector:"), "source", "target")).cast("boolean")))

    def as_cells(batches):  # every vector as often as links have it
        for batch in batches:
            row = lambda x, t: pa.array([x], t)
            at = np.arange(batch.num_rows)
            flat = {n: column(pa.table([batch.column(n)], names=[n]), n) for n in ("source", "target", "a", "b")}
            values = {"source": flat["source"], "target": flat["target"], "label": batch.column("label").to_numpy(zero_copy_only=False),
                      "a_ids": flat["source"], "a": flat["a"], "a_at": at, "b_ids": flat["target"], "b": flat["b"], "b_at": at}
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([row(values[n], t) for n, t in _arrow(ENDS)], names=[n for n, _t in _arrow(ENDS)])

    return out.select("source", "target", F.col("label").cast("double").alias("label"), "a", "b").mapInArrow(as_cells, ENDS)


def _dealt(links: DataFrame, emb: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    def pack(source, target, label, a, b) -> pa.Table:
        values = {"source": source, "target": target, "label": label}
        for name, (ids, x, at) in (("a", a), ("b", b)):
            used, at = np.unique(at, return_inverse=True)
            values |= {f"{name}_ids": ids[used], name: x[used].ravel(), f"{name}_at": at}
        return pa.table({n: pa.array([values[n]], t) for n, t in _arrow(ENDS)})

    return over_links(links, emb, cells_for(emb, links), pack, ENDS, id_col=id_col, vec_col=vec_col)


def _cells(batches):
    """The cells of an Arrow stream: ({column: numpy}, slices of bounded size (ends' vectors a and b, labels, part))."""
    for batch in batches:
        for r in range(batch.num_rows):
            c = {n: batch.column(n)[r].values.to_numpy(zero_copy_only=False) for n in batch.schema.names}
            a, b = (c[n].reshape(len(c[f"{n}_ids"]), -1) for n in ("a", "b"))
            parts = [slice(s, s + SLICE) for s in range(0, len(c["label"]), SLICE)]
            yield c, ((a[c["a_at"][part]], b[c["b_at"][part]], c["label"][part], part) for part in parts)


def head_gradients(ends: DataFrame, n_links: int, op: str, w: np.ndarray, bias: float):
    """(mean cross-entropy, slopes of w, slope of the bias) over links with their ends (:func:`with_ends`)."""

    def part(batches):
        total = np.zeros(2 + len(w))
        for _c, slices in _cells(batches):
            for a, b, y, _part in slices:
                f = combine(a, b, op)
                p = 1 / (1 + np.exp(-(f @ w + bias)))
                q = np.clip(p, 1e-7, 1 - 1e-7)
                total += np.concatenate([[-(y * np.log(q) + (1 - y) * np.log(1 - q)).sum(), (p - y).sum()], (p - y) @ f]) / n_links
        yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    total = added({"v": ends.mapInArrow(part, "v array<double>")})["v"]
    return float(total[0]), total[2:], float(total[1])


def end_gradients(ends: DataFrame, n_links: int, op: str, w: np.ndarray, bias: float) -> DataFrame:
    """(id, g): the mean loss' slope at every vector that ends a link, summed over its links: in a cell first, then over cells."""

    def messages(batches):
        for c, slices in _cells(batches):
            sums = [np.zeros((len(c[f"{n}_ids"]), len(c[n]) // max(1, len(c[f"{n}_ids"])))) for n in ("a", "b")]
            for a, b, y, part in slices:
                slope = ((1 / (1 + np.exp(-(combine(a, b, op) @ w + bias)))) - y)[:, None] / n_links
                for total, n, d in zip(sums, ("a", "b"), through(a, b, w, op)):
                    order = np.argsort(c[f"{n}_at"][part], kind="stable")
                    add_to(total, c[f"{n}_at"][part][order], (slope * d)[order])
            for total, n in zip(sums, ("a", "b")):
                yield from vector_table(c[f"{n}_ids"], total, "id", "g").to_batches()

    parts = ends.mapInArrow(messages, "id long, g array<double>")
    return add_up(parts, None, "id", "g", groups=max(1, ends.count()))


def train_link_head(links: DataFrame, emb: DataFrame, *, op: str = "hadamard", epochs: int = 20, lr: float = 0.01, seed: int = 42,
                    id_col: str = "id", vec_col: str = "h"):
    """Full-batch Adam on the head alone, from Glorot weights → (w, bias, losses by epoch). Links repeat as they stand."""
    run = RunTables(links.sparkSession)
    ends = run.put(with_ends(links, emb, id_col, vec_col))
    n = links.count()
    size = int(ends.select(F.size("a") / F.size("a_ids")).first()[0]) * (2 if op == "concat" else 1)
    params, losses = [glorot(seed, f"head_{op}", size, 1)[:, 0], np.zeros(1)], []
    opt = AdamState([p.shape for p in params], lr)
    for _ in range(epochs):
        loss, gw, gb = head_gradients(ends, n, op, params[0], float(params[1][0]))
        losses.append(loss)
        params = opt.step(params, [gw, np.array([gb])])
    run.drop(ends)
    return params[0], float(params[1][0]), losses


def score_head(links: DataFrame, emb: DataFrame, op: str, w: np.ndarray, bias: float, *, id_col: str = "id", vec_col: str = "h") -> DataFrame:
    """(source, target, label, score) by a trained head."""
    def run(batches):
        for c, slices in _cells(batches):
            for a, b, y, part in slices:
                score = 1 / (1 + np.exp(-(combine(a, b, op) @ w + bias)))
                yield pa.RecordBatch.from_pydict({"source": c["source"][part], "target": c["target"][part],
                                                  "label": pa.array(y, from_pandas=True).cast(pa.int32()), "score": score})

    return with_ends(links, emb, id_col, vec_col).mapInArrow(run, "source long, target long, label int, score double")
