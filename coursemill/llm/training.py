"""Labelled samples and calibration shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def fold(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id as text, by a modulus; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y, part) of labelled rows that `learn` (over id) allows: all of them, or the `most` that a hash picks.

    A doc that is labelled twice counts as 1 if any label is 1. `part` is a hash of the id from 0 to 99 for splits.
    The picked ids are at most `most` rows and therefore broadcast; texts are not shuffled.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).filter("id is not null and y is not null").filter(learn)
    picked = named.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    picked = picked.select("id", "y", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(100)).cast("int").alias("part"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("text", "y", "part")


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by Newton's steps on smoothed targets."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, b


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y to score, by pooling neighbours that fall."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, lowest and highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            v1, n1, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v1, blocks[-1][1] + n1, blocks[-1][2], high]
    x = np.array([e for b in blocks for e in (b[2], b[3])])
    p = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return (x, p) if len(x) else (np.zeros(1), np.zeros(1))
