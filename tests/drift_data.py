"""Raw predictions from a seeded generator, and the statistics documents made of them."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np

from tidemark.plans.statistics import Bins, statistics

START = datetime(2026, 9, 1, tzinfo=timezone.utc)
KEYS = ["modelName", "modelVersion", "task", "mode", "gbm", "process", "productId"]


def day(i: int) -> datetime:
    return START + timedelta(days=i)


def raw(means, n=600, share=0.05, products=1, threshold=0.8, task="cls", seed=11, backend="a", classes=("ok", "ng"), boxes=None, first=0):
    """Rows of predictions, or of boxes with their images; one entry of `means` a day."""
    rng = np.random.default_rng(seed)
    pick = lambda x, i: x[i] if isinstance(x, (list, tuple)) and not isinstance(x, str) else x
    rows, images, image = [], [], seed * 1_000_000 + first * 10_000
    for i, m in enumerate(means):
        for k in range(n):
            at = day(first + i) + timedelta(seconds=int(k * 86000 / n))
            key = ("m", "1", task, "production", "g", "p", f"p{k % products}")
            image += 1
            number = 1 if task == "cls" else max(1, round(rng.normal(pick(boxes, i), 0.7)))
            images.append((*key, at, f"e{k % 2}", image, 0.1, pick(backend, i)))
            for _ in range(number):
                label = classes[1] if rng.random() < pick(share, i) else classes[0]
                rows.append((*key, at, f"e{k % 2}", image, label, float(np.clip(rng.normal(m, 0.05), 0, 1)), pick(threshold, i), 0.1,
                             pick(backend, i), image))
    return rows, images


def documents(spark, rows, images, granularity="daily", bins=Bins(), task="cls"):
    head = ", ".join(f"{k} string" for k in KEYS) + ", ts timestamp, equipment string, image long"
    df = spark.createDataFrame(rows, head + ", class string, confidence double, threshold double, elapsed double, backend string, inspection long")
    pictures = spark.createDataFrame(images, head + ", elapsed double, backend string") if task == "det" else None
    return statistics(df, KEYS, granularity, bins, pictures)
