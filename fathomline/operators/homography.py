"""Homographies of frames from matched points, by consensus over random quadruples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.frames import top_k

#: The best-scored pairs of a frame that take part: a frame is worked on as one small table.
PAIRS = 1000


def fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 map from src to dst in least squares, with both point sets normalised."""

    def unit(p: np.ndarray) -> np.ndarray:
        centre = p.mean(0)
        size = np.sqrt(((p - centre) ** 2).sum(1)).mean()
        s = np.sqrt(2) / size if size > 0 else 1.0
        return np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])

    a, b = unit(src), unit(dst)
    p, q = (np.c_[x, np.ones(len(x))] @ t.T for x, t in ((src, a), (dst, b)))
    zero = np.zeros_like(p)
    rows = np.concatenate([np.hstack([p, zero, -q[:, :1] * p]), np.hstack([zero, p, -q[:, 1:2] * p])])
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def errors(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.c_[src, np.ones(len(src))] @ h.T
    ok = np.abs(p[:, 2]) > 1e-12
    out = np.full(len(src), np.inf)
    out[ok] = np.hypot(*(p[ok, :2] / p[ok, 2:] - dst[ok]).T)
    return out


def consensus(src: np.ndarray, dst: np.ndarray, limit: float, rounds: int, sure: float, seed: int) -> tuple[np.ndarray | None, np.ndarray]:
    """Homography and inlier mask; none with fewer than four pairs or inliers."""
    n, best = len(src), np.zeros(len(src), bool)
    if n < 4:
        return None, best
    rng, done, wanted = np.random.default_rng(seed), 0, rounds
    while done < wanted:
        done += 1
        pick = rng.choice(n, 4, replace=False)
        h = fit(src[pick], dst[pick])
        if h is None:
            continue
        mask = errors(h, src, dst) <= limit
        if mask.sum() > best.sum():
            best = mask
            miss = 1 - (mask.mean()) ** 4
            wanted = done if miss <= 0 else min(rounds, int(np.ceil(np.log(1 - sure) / np.log(miss))) if miss < 1 else rounds)
    if best.sum() < 4:
        return None, np.zeros(n, bool)
    h = fit(src[best], dst[best])
    return h, (errors(h, src, dst) <= limit) if h is not None else best


def estimate(pairs: DataFrame, limit: float = 5.0, rounds: int = 2000, sure: float = 0.995, by: str = "frame_id") -> DataFrame:
    """by, n, inliers and h (nine numbers by rows, null without a homography); pairs: by, number, x, y, u, v, score."""
    kind = pairs.schema[by].dataType.simpleString()

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        h, mask = consensus(frame[["x", "y"]].to_numpy(float), frame[["u", "v"]].to_numpy(float), limit, rounds, sure, 12345)
        return pd.DataFrame({by: [frame[by].iloc[0]], "n": [len(frame)], "inliers": [int(mask.sum())], "h": [None if h is None else h.reshape(-1).tolist()]})

    best = top_k(pairs, [F.desc("score"), F.col("number")], PAIRS, by)
    return best.groupBy(by).applyInPandas(work, f"{by} {kind}, n bigint, inliers bigint, h array<double>")
