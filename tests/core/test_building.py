"""The bank from image files: coverage, quotas and images that cannot be read."""

import json

import numpy as np
import pytest

from tessera.operators import masks
from tessera.plans import building

ANNS = "image_id long, class_id int, ann_id long, segmentation string, height int, width int"


def a_load():
    """Nested, so that it travels to the workers by value."""

    def load():
        def encoder(batch):
            if any(b == b"bad" for b in batch):
                raise ValueError("bad")
            return [np.full((2, 2, 3), float(len(b))) for b in batch]

        return encoder

    return load


def rle(*rows):
    return json.dumps(masks.encode(np.array(rows)))


FULL, LEFT, PART, NONE = rle([1, 1], [1, 1]), rle([1, 0], [1, 0]), "[[0, 0, 3, 0, 3, 1, 0, 1]]", rle([0, 0], [0, 0])


@pytest.fixture
def given(spark):
    images = spark.createDataFrame([(1, bytearray(b"bad")), (2, bytearray(b"x")), (3, None), (4, bytearray(b"xx")), (5, bytearray(b"y"))], "image_id long, content binary")
    anns = [(i, 1, i * 10, FULL, 2, 2) for i in (1, 2, 3, 4, 5, 6)] + [(2, 2, 21, LEFT, 2, 2), (2, 3, 22, NONE, 2, 2), (4, 3, 41, "{", 2, 2), (5, 3, 51, None, 2, 2), (4, 4, 42, LEFT, 2, 2)]
    return images, spark.createDataFrame(anns, ANNS)


def test_images_that_give_nothing_take_no_place_in_a_quota(given):
    images, anns = given
    rows = building.built(images, anns, a_load(), max_images=2, size=8, patch=4).collect()
    assert {(r.class_id, r.image_id) for r in rows} == {(1, 2), (1, 4), (2, 2), (4, 4)}
    assert len({r.vec_id for r in rows}) == len(rows) == 12
    assert sorted((r.row, r.col, r.patch_no) for r in rows if r.class_id == 2) == [(0, 0, 0), (1, 0, 2)]
    assert all(r.file_key == f"{r.image_id}_{r.ann_id}.pt" and sum(x * x for x in r.embedding) == pytest.approx(1) for r in rows)


def test_both_quotas_and_none(given):
    images, anns = given
    count = lambda **q: {(r.class_id, r.image_id) for r in building.built(images, anns, a_load(), size=8, patch=4, **q).collect()}
    assert count() == {(1, 2), (1, 4), (1, 5), (2, 2), (4, 4)}
    assert count(max_images=3, max_features=4) == {(1, 2), (2, 2), (4, 4)}


def test_a_patch_counts_only_above_the_share(spark):
    half = spark.createDataFrame([(1, 1, 1, rle([1, 0, 1, 1], [1, 1, 1, 1]), 2, 4)], ANNS)
    got = lambda least: sorted((r.row, r.col, r.coverage) for r in building.coverages(half, 8, 4, least).collect())
    assert got(0.9) == [(0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]
    assert got(0.4) == [(0, 0, 0.5), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]


def test_nothing_to_build(given):
    images, anns = given
    assert building.built(images, anns.where("false"), a_load(), max_images=2, size=8, patch=4).count() == 0
