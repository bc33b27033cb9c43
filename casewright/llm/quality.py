"""Quality classifier: passages of a document are weighted by learned gated attention, then scored as one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from casewright.llm.common import mix, remainder, steps, whole

PASSAGE = 64  # words
STEP = 1_500_000  # bytes of text encoded at once
BUCKETS = 192  # hashed words
#: Byte classes: lower, upper, digit, each common mark of its own, other marks, first and further bytes beyond ASCII.
MARKS = ".,;:!?|*$#%&@/\\-_=+<>()[]{}\"'~^"
CLASSES = 3 + len(MARKS) + 3
SHAPES = 13
FEATURES = CLASSES + SHAPES + BUCKETS


def _class_table() -> np.ndarray:
    table = np.full(256, 3 + len(MARKS), dtype=np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    for place, mark in enumerate(MARKS):
        table[ord(mark)] = 3 + place
    table[0xC0:], table[0x80:0xC0] = 4 + len(MARKS), 5 + len(MARKS)
    return table


CLASS = _class_table()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``PASSAGE`` words in order, and each text's number of passages (1 if it has no word)."""
    with np.errstate(over="ignore"):
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first_byte = np.cumsum(sizes + 1) - sizes - 1
        blank = SPACE[data]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        lengths = ends - starts
        upto = np.searchsorted(starts, first_byte)
        words = np.diff(np.concatenate([upto, [len(starts)]]))
        passages = np.maximum(1, -(-words // PASSAGE))
        base = np.cumsum(passages) - passages
        place = np.arange(len(starts)) - np.repeat(upto, words)
        of_word = np.repeat(base, words) + place // PASSAGE
        total = int(passages.sum())

        byte_at = np.flatnonzero(~blank)
        of_byte = np.repeat(of_word, lengths)
        kinds = CLASS[data[byte_at]]
        marks = np.bincount(of_byte * CLASSES + kinds, minlength=total * CLASSES).reshape(total, CLASSES)

        count = np.bincount(of_word, minlength=total).astype(np.float64)
        many = np.maximum(count, 1)

        def share(weights: np.ndarray) -> np.ndarray:
            return np.bincount(of_word, weights=weights, minlength=total) / many

        if len(starts):
            within = byte_at - np.repeat(starts, lengths)
            powers = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
            hashes = mix(np.add.reduceat((data[byte_at].astype(np.uint64) + np.uint64(1)) * powers[within % 64], np.cumsum(lengths) - lengths))
            at = np.cumsum(lengths) - lengths
            lower = np.add.reduceat((kinds == 0).astype(np.int64), at)
            upper = np.add.reduceat((kinds == 1).astype(np.int64), at)
            letters = lower + upper + np.add.reduceat((kinds >= 4 + len(MARKS)).astype(np.int64), at)
        else:
            hashes, lower, upper, letters = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
        first, last = CLASS[data[starts]], CLASS[data[ends - 1]] if len(ends) else np.zeros(0, dtype=np.int64)
        mean = share(lengths)
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (np.diff(of_word) == 0)]) if len(hashes) else np.zeros(0, dtype=bool)
        seen = np.unique(of_word.astype(np.uint64) << np.uint64(40) ^ hashes >> np.uint64(24))
        distinct = np.bincount((seen >> np.uint64(40)).astype(np.int64), minlength=total) / many
        lines = np.searchsorted(starts, np.flatnonzero(data == 10)) - 1
        lines = np.bincount(of_word[lines[lines >= 0]], minlength=total) / many if len(starts) else np.zeros(total)
        shapes = np.stack(
            [
                count / PASSAGE,
                count == 0,
                mean / 8,
                np.sqrt(np.maximum(share(lengths.astype(np.float64) ** 2) - mean**2, 0)) / 8,
                share(first == 1),
                share((upper > 1) & (lower == 0)),
                share(letters == 0),
                share((last >= 3) & (last <= 3 + len(MARKS))),
                share(lengths > 16),
                distinct,
                share(again),
                lines,
                np.repeat(np.log1p(words) / 8, passages),
            ],
            axis=1,
        )
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        bags = np.bincount(of_word * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS)
        bytes_ = np.maximum(1, marks.sum(axis=1, keepdims=True))
        # square roots: a rare mark says as much by its presence as by its share
        return np.concatenate([np.sqrt(marks / bytes_), shapes, np.sqrt(bags / many[:, None])], axis=1).astype(np.float32), passages


@dataclass
class AttentionModel:
    """Gated attention pooling over encoded passages (Ilse, Tomczak and Welling, 2018)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(sizes) - sizes
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s}

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.forward(x, sizes)["s"] if len(sizes) else np.zeros(0)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy."""
        p, f = self.p, self.forward(x, sizes)
        out = (f["s"] - y) * weight / weight.sum()
        dz = out[:, None] * p["c"]
        each = np.repeat(dz, sizes, axis=0)
        da = (each * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, np.cumsum(sizes) - sizes), sizes))
        gate = de[:, None] * p["w"]
        dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
        dh = (each * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh,
            "b": dh.sum(axis=0),
            "V": f["h"].T @ dt,
            "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ out,
            "d": out.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 16) -> AttentionModel:
    """Adam on mini-batches of bags; the same bags give the same model."""
    everything = np.concatenate(bags)
    mean = everything.mean(axis=0)
    scale = 1 / np.maximum(everything.std(axis=0), 0.02)
    draw = np.random.default_rng(7)
    shape = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
    p = {k: (draw.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    model = AttentionModel(mean, scale, p)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(rounds):
        order = draw.permutation(len(bags))
        for at in range(0, len(bags), 48):
            chosen = order[at : at + 48]
            sizes = np.array([len(bags[i]) for i in chosen])
            grads = model.gradients(np.concatenate([bags[i] for i in chosen]), sizes, y[chosen], weight[chosen])
            step += 1
            for k, g in grads.items():
                g = g + (1e-3 * p[k] if k in ("W", "V", "U", "c") else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _encoded(docs: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """``doc_id, bag``: the passages' features, evenly thinned to ``longest`` (for fitting only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            x, sizes = encode(batch.column("text").cast(pa.binary()).to_pylist())
            bags = np.split(x, np.cumsum(sizes)[:-1])
            thin = [b if len(b) <= longest else b[np.linspace(0, len(b) - 1, longest).astype(int)] for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b.astype("<f2").tobytes() for b in thin], pa.binary())], ["doc_id", "bag"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, bag binary")


def train(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, longest: int = 24, folds: int = 5
) -> AttentionModel | None:
    """Fit on a bounded sample of the labelled rows whose crc32(id) mod ``folds`` is not 0.

    The sample has ``per_class`` documents of each class, those with the smallest hash of their id, weighted back to
    the classes' shares, and ``longest`` passages of each at most: what reaches the driver is bounded whatever the
    input. Of rows that share an id, the one of the fewest passages is taken. Rows without an id or label are left out; several labels of a document are averaged. None without a label.
    """
    mean = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    good = F.col("y") >= 0.5
    parts = [mean.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (good, ~good)]
    counted = {r["good"]: r["n"] for r in mean.groupBy(good.alias("good")).agg(F.count("*").alias("n")).collect()}
    sample = docs.select(id_col, text_col).join(
        F.broadcast(parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "_id")), F.col(id_col) == F.col("_id")
    )
    encoded = _encoded(sample, id_col, text_col, longest)
    # of the rows that share an id, one stands for them: the bound holds for rows too
    rows = encoded.groupBy("doc_id").agg(F.min_by("bag", F.struct(F.length("bag"), F.xxhash64("bag"), "bag")).alias("bag")).toPandas()
    if rows.empty:
        return None
    known = {r["doc_id"]: r["y"] for r in parts[0].unionByName(parts[1]).collect()}
    rows = rows.assign(size=rows["bag"].map(len)).sort_values(["doc_id", "size"], kind="stable")
    y = np.array([known[i] for i in rows["doc_id"]], dtype=np.float32)
    taken = {k: max(1, int(((y >= 0.5) == k).sum())) for k in (True, False)}
    weight = np.array([counted[bool(v >= 0.5)] / taken[bool(v >= 0.5)] for v in y], dtype=np.float32)
    bags = [np.frombuffer(b, dtype="<f2").reshape(-1, FEATURES).astype(np.float32) for b in rows["bag"]]
    return fit(bags, y, weight / weight.mean())


def quality_scores(docs: DataFrame, model: AttentionModel | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds a score (0 to 1) to the documents, from their whole texts alone; 0.5 without a model.

    Null texts count as empty; an empty text is one passage without words. Rows are scored where they are read, some
    megabytes at a time. Repeated rows get equal scores; a column with the score's name is replaced; an empty table
    gives an empty result.
    """
    kept = docs.drop(score_col)
    schema = StructType([*kept.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col, STEP):
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            scores = np.full(len(texts), 0.5) if model is None else model.score(*encode(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores.astype(np.float64))], [*batch.schema.names, score_col])

    return kept.mapInArrow(run, schema)
