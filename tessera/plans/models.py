"""The boundary to encoders and mask models: pluggable callables with fixed schemas and error policies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[list[bytes]], list[np.ndarray]]
MaskModel = Callable[[bytes, str, list[tuple[float, float]]], list[tuple[np.ndarray, float]]]


def encode_images(images: DataFrame, load: Callable[[], Encoder], batch: int = 4) -> DataFrame:
    """(image_id, row, col, embedding) from (image_id, content). load() makes the encoder once per task; it maps a batch of
    images to grids [rows, cols, d]. An image on which the encoder fails gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for x in batches:
            for i in range(0, len(x), batch):
                part, out = x.iloc[i : i + batch], []
                try:
                    grids = list(encoder(list(part["content"])))
                except Exception:
                    grids = [_one(encoder, b) for b in part["content"]]
                for image, g in zip(part["image_id"], grids, strict=True):
                    if g is not None:
                        unit = g / np.maximum(np.linalg.norm(g, axis=2, keepdims=True), 1e-12)
                        out += [(image, r, c, unit[r, c].astype(np.float32)) for r in range(g.shape[0]) for c in range(g.shape[1])]
                yield pd.DataFrame(out, columns=["image_id", "row", "col", "embedding"])

    return images.select("image_id", "content").mapInPandas(run, "image_id long, row int, col int, embedding array<float>")


def _one(encoder: Encoder, content: bytes) -> np.ndarray | None:
    try:
        return next(iter(encoder([content])))
    except Exception:
        return None


def predict_masks(requests: DataFrame, load: Callable[[], MaskModel]) -> DataFrame:
    """Run-length predictions for (image_id, class_id, content, prompt, points array<struct<x,y>>). Empty masks drop out. With
    no points, or if the model fails on them, the text alone is asked (used_text_only_fallback, combined_prediction_error);
    if that fails too there is no prediction."""
    from ..operators.masks import counts_to_text, encode_runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for x in batches:
            out = []
            for image, cls, content, prompt, points in zip(x["image_id"], x["class_id"], x["content"], x["prompt"], x["points"], strict=True):
                at = [(p["x"], p["y"]) for p in points] if points is not None else []
                error, found = None, None
                if at:
                    try:
                        found = model(content, prompt, at)
                    except Exception as e:
                        error = str(e)
                fallback = found is None
                if fallback:
                    try:
                        found = model(content, prompt, [])
                    except Exception:
                        found = []
                out += [(image, cls, float(s), list(m.shape), counts_to_text(encode_runs(m)), fallback, error) for m, s in found if m.any()]
            yield pd.DataFrame(out, columns=["image_id", "class_id", "score", "size", "counts", "used_text_only_fallback", "combined_prediction_error"])

    return requests.mapInPandas(run, "image_id long, class_id int, score double, size array<int>, counts string, used_text_only_fallback boolean, combined_prediction_error string")
