"""The raw bank from image files and annotations: masks to patch coverage, quotas, encoder, vectors of the covered patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bank as banks
from ..operators import geometry, masks
from ..operators.running import numbered
from ..sources.stored import stored
from .models import Encoder, encode_images

COVERED = "image_id long, class_id int, ann_id long, row int, col int, coverage double"


def coverages(annotations: DataFrame, size: int = 1536, patch: int = 16, least: float = banks.BANK_COVERAGE) -> DataFrame:
    """COVERED: the patches of which an annotation covers more than least, once its mask is resized to size x size.

    annotations: (image_id, class_id, ann_id, segmentation, height, width); those that cannot be read or are empty give no rows.
    A mask is decoded, resized and averaged in one step; pixels never become rows."""
    side = size // patch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for image, cls, ann, text, h, w in zip(x["image_id"], x["class_id"], x["ann_id"], x["segmentation"], x["height"], x["width"], strict=True):
                mask = masks.decode(text, int(h), int(w))
                if mask is None or not mask.any():
                    continue
                flat = geometry.resized((mask > 0).astype(np.uint8), size, size)[: side * patch, : side * patch]
                share = flat.reshape(side, patch, side, patch).mean(axis=(1, 3))
                out += [(image, cls, ann, int(r), int(c), float(share[r, c])) for r, c in zip(*np.nonzero(share > least), strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COVERED.split(", ")])

    known = annotations.where("segmentation is not null and height > 0 and width > 0")
    return known.select("image_id", "class_id", "ann_id", "segmentation", "height", "width").mapInPandas(run, COVERED)


def built(images: DataFrame, annotations: DataFrame, load: Callable[[], Encoder], max_images: int | None = None, max_features: int | None = None, size: int = 1536, patch: int = 16, least: float = banks.BANK_COVERAGE, batch: int = 4) -> DataFrame:
    """A bank (vec_id, class_id, image_id, ann_id, patch_no, row, col, file_key, coverage, embedding) from images (image_id,
    content) and annotations as coverages() takes them.

    Quotas are those of banks.quota(): an image that is missing or that the encoder cannot read takes no place in one. An image
    is encoded once and only if a quota asks for it; where one has failed, the images that take its place are encoded next."""
    cover = stored(coverages(annotations, size, patch, least), "cover")
    anns = stored(cover.groupBy("class_id", "image_id", "ann_id").agg(F.count("*").alias("n_patches")), "anns")
    asked, cells = None, None
    while True:
        left = anns
        if asked is not None:  # without the images that were asked for and gave nothing
            failed = asked.join(cells.select("image_id").distinct(), "image_id", "left_anti")
            left = anns.join(failed, "image_id", "left_anti")
        kept = left if max_images is None and max_features is None else banks.quota(left, max_images, max_features)
        wanted = kept.select("image_id").distinct()
        wanted = stored(wanted if asked is None else wanted.join(asked, "image_id", "left_anti"), "wanted")
        if asked is not None and wanted.isEmpty():
            break
        got = stored(encode_images(images.where("content is not null").join(wanted, "image_id", "left_semi"), load, batch), "cells")
        asked, cells = (wanted, got) if asked is None else (asked.unionByName(wanted), cells.unionByName(got))
    own = cover.join(kept.select("class_id", "image_id", "ann_id"), ["class_id", "image_id", "ann_id"], "left_semi")
    ids = numbered(own, "image_id", "ann_id", "class_id", "row", "col", name="vec_id")
    out = ids.join(cells, ["image_id", "row", "col"])
    key = banks.file_key(F.col("image_id"), F.col("ann_id"))
    return out.select("vec_id", "class_id", "image_id", "ann_id", (F.col("row") * (size // patch) + F.col("col")).alias("patch_no"), "row", "col", key.alias("file_key"), "coverage", "embedding")
