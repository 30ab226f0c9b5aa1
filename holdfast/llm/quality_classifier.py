"""Quality classification with a factorisation machine.

A text's features are its hashed words (counts of unit length), structure statistics and
its declared length. The score is the logistic of

    bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

linear in the number of features. The machine is fitted with Adagrad on at most
``LEARNING_ROWS`` labelled rows, chosen by a hash of the id; all rows are scored.

Defined results: a null or empty text has no words and is scored by its statistics; a
missing declared length counts as zero; rows without a label teach nothing; with no
labelled row every score is one half; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import byte_lengths, text_slices
from holdfast.llm.words import sums_by_text, word_codes

BLOCK_BYTES = 8 << 20
LEARNING_ROWS = 12_000
BUCKETS = 1 << 16
RANK = 8
EPOCHS = 6
BATCH = 256
RATE = 0.1
PENALTY = 1e-5
BYTE_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|", b"#*$%&<>", b"\n", bytes(range(128, 256)))
STATISTICS = len(BYTE_CLASSES) + 7


def statistics(text: pa.Array, n_chars: np.ndarray, codes: np.ndarray, bounds: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Shares of byte classes, word and repetition measures, lengths; one row a text."""
    text = text.fill_null("")
    lengths = byte_lengths(text)
    data = np.frombuffer(b"".join(x.encode("utf-8") for x in text.to_pylist()), np.uint8)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    size = np.maximum(lengths, 1)
    columns = []
    for members in BYTE_CLASSES:
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        columns.append((total[ends[1:]] - total[ends[:-1]]) / size)
    words = np.diff(bounds)
    same = np.zeros(len(codes))
    same[1:] = codes[1:] == codes[:-1]
    same[bounds[:-1][words > 0]] = 0  # the first word of a text follows none
    many = np.maximum(words, 1)
    columns += [
        sums_by_text(same, bounds) / many,
        distinct / many,
        lengths / many / 10,
        np.log1p(words) / 10,
        np.log1p(lengths) / 10,
        np.log1p(np.maximum(n_chars, 0)) / 10,
        np.ones(len(words)),
    ]
    return np.stack(columns, axis=1)


def features(text: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and value of each word feature, and the statistics of each text."""
    words, codes, bounds = word_codes(text)
    buckets = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(text)), np.diff(bounds))
    pairs, counts = np.unique(owner * BUCKETS + (buckets[codes] if len(codes) else codes), return_counts=True)
    owner, bucket = pairs // BUCKETS, pairs % BUCKETS
    length = np.sqrt(np.bincount(owner, weights=counts.astype(float) ** 2, minlength=len(text)))
    distinct = np.bincount(owner, minlength=len(text))
    return owner, bucket, counts / length[owner], statistics(text, n_chars, codes, bounds, distinct)


@dataclass
class Machine:
    """The statistics follow the buckets in ``linear`` and ``factors``; they are centred and scaled first."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def margins(self, owner, bucket, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The margin of each text, the sums over its features by factor, and its scaled statistics."""
        n, stats = len(stats), np.clip((stats - self.centre) / self.scale, -5, 5)
        v = self.factors[bucket]
        sums = stats @ self.factors[BUCKETS:]
        squares = (stats**2) @ (self.factors[BUCKETS:] ** 2)
        for f in range(RANK):
            sums[:, f] += np.bincount(owner, weights=v[:, f] * value, minlength=n)
            squares[:, f] += np.bincount(owner, weights=(v[:, f] * value) ** 2, minlength=n)
        margin = self.bias + stats @ self.linear[BUCKETS:]
        margin += np.bincount(owner, weights=self.linear[bucket] * value, minlength=n)
        return margin + 0.5 * (sums**2 - squares).sum(axis=1), sums, stats

    def scores(self, text: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        margin, _, _ = self.margins(*features(text, n_chars))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def learn(rows: list, seed: int = 7) -> Machine:
    """rows: (label, buckets, values, statistics)."""
    random = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    machine = Machine(0.0, np.zeros(size), random.normal(0, 0.01, (size, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if not rows:
        machine.factors[:] = 0
        return machine
    labels = np.array([r[0] for r in rows], dtype=float)
    stats = np.array([r[3] for r in rows])
    machine.centre, machine.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    share = np.clip(labels.mean(), 0.01, 0.99)
    machine.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    whole = np.arange(BUCKETS, size)
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            counts = [len(rows[i][1]) for i in part]
            owner = np.repeat(np.arange(len(part)), counts)
            bucket = np.concatenate([rows[i][1] for i in part]).astype(np.int64)
            value = np.concatenate([rows[i][2] for i in part]).astype(float)
            margin, sums, scaled = machine.margins(owner, bucket, value, stats[part])
            error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels[part]) / len(part)
            # Gradients of the word buckets in this batch, then of the statistics.
            touched, place = np.unique(bucket, return_inverse=True)
            pull = error[owner] * value
            own = machine.factors[touched]
            g_w = np.bincount(place, weights=pull, minlength=len(touched))
            spread = np.bincount(place, weights=pull * value, minlength=len(touched))
            g_v = np.stack([np.bincount(place, weights=pull * sums[owner, f], minlength=len(touched)) for f in range(RANK)], 1)
            g_v -= spread[:, None] * own
            s_v = (scaled * error[:, None]).T @ sums - ((scaled**2 * error[:, None]).sum(axis=0))[:, None] * machine.factors[BUCKETS:]
            index = np.concatenate((touched, whole))
            g_w = np.concatenate((g_w, scaled.T @ error)) + PENALTY * machine.linear[index]
            g_v = np.concatenate((g_v, s_v)) + PENALTY * machine.factors[index]
            seen_w[index] += g_w**2
            seen_v[index] += g_v**2
            machine.linear[index] -= RATE * g_w / np.sqrt(seen_w[index])
            machine.factors[index] -= RATE * g_v / np.sqrt(seen_v[index])
            seen_b += error.sum() ** 2
            machine.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return machine


def fit(labelled: DataFrame) -> Machine:
    """From rows (doc_id, text, n_chars, label 0 or 1); nulls in ``label`` are left out."""
    labelled = labelled.where(F.col("label").isNotNull())
    share = min(1.0, LEARNING_ROWS / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            owner, bucket, value, stats = features(block.column(0), _numbers(block.column(1)))
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=block.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.record_batch(
                [block.column(2), block.column(3), *lists, pa.array(stats.tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "label", "buckets", "values", "stats"],
            )

    rows = sample.select("text", "n_chars", "doc_id", F.col("label").cast("int").alias("label")).mapInArrow(
        run, "doc_id long, label int, buckets array<int>, values array<float>, stats array<double>"
    )
    table = rows.toArrow().sort_by("doc_id")  # the same order, and machine, at every run
    columns = [table[name] for name in ("label", "buckets", "values", "stats")]
    return learn([tuple(c.as_py() if i in (0, 3) else c.values.to_numpy() for i, c in enumerate(row)) for row in zip(*columns)])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0).to_numpy()


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of (doc_id, text, n_chars)."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            scores = sent.value.scores(block.column(0), _numbers(block.column(1)))
            yield pa.record_batch([block.column(2), pa.array(scores)], names=["doc_id", "score"])

    return docs.select("text", F.col("n_chars").cast("long").alias("n_chars"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        run, "doc_id long, score double"
    )
