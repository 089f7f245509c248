"""Prediction and evaluation of masks on hand-worked cases."""

import json

import numpy as np
import pytest

from tessera.operators import masks
from tessera.plans import evaluation
from tessera.plans.engine import Config, Engine

IMAGES = "image_id long, content binary, height int, width int"
PROMPTS = "image_id long, class_id int, rank int, x double, y double, score double"


def a_model():
    """Nested, so that it travels to the workers by value."""

    def load():
        def run(content, prompt, points):
            if content == b"bad" and points:
                raise RuntimeError("points")
            grid = np.zeros((1, 4, 4))  # an extra axis, half the image's size
            if points:
                out = []
                for x, y in points:
                    one = grid.copy()
                    if x >= 0:
                        one[0, int(y) // 2, int(x) // 2] = 3.0
                    out.append((one, 0.5))
                return out
            grid[0, 0, 0] = 1.0
            return [(grid, 0.25), (np.zeros((4, 4)), 0.75)]

        return run

    return load


@pytest.fixture
def given(spark):
    images = spark.createDataFrame([(1, bytearray(b"ok"), 8, 8), (2, bytearray(b"bad"), 8, 8), (3, None, 8, 8)], IMAGES)
    asked = spark.createDataFrame([(i, c, "a leaf") for i in (1, 2, 3) for c in (1, 2)], "image_id long, class_id int, prompt string")
    points = [(1, 1, 1, -1.0, 0.0, 0.9), (1, 1, 2, 2.0, 2.0, 0.8), (1, 1, 3, 6.0, 6.0, 0.4), (2, 1, 1, 0.0, 0.0, 0.6)]
    return images, asked, spark.createDataFrame(points, PROMPTS)


def found(answers):
    return {(r.image_id, r.class_id): r for r in answers.collect()}


def test_point_masks_take_the_scores_at_their_place_and_unknown_pairs_are_not_asked(given):
    images, asked, prompts = given
    answers = evaluation.predicted(evaluation.requests(images, asked, prompts), a_model(), "point")
    got = found(answers)
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}  # no content, no row
    assert [m.score for m in got[1, 1].masks] == [0.5 * 0.9, 0.5 * 0.8]  # the first point gave an empty mask
    assert [[tuple(r) for r in m.runs] for m in got[1, 1].masks] == [[(2 * 8 + 2, 2), (3 * 8 + 2, 2)], [(6 * 8 + 6, 2), (7 * 8 + 6, 2)]]
    assert got[2, 1].masks == [] and not got[1, 2].cached
    n = evaluation.counters(answers, "point").first()
    assert (n.pairs, n.missing_prompts, n.skipped_prediction_errors, n.text_only_fallbacks) == (4, 2, 1, 0)
    assert {r.class_id: r.missing for r in evaluation.missing_prompts(answers).collect()} == {2: 2}


def test_text_unites_masks_and_takes_the_models_best_score(given):
    images, asked, _ = given
    got = found(evaluation.predicted(evaluation.requests(images, asked), a_model(), "text"))
    assert [(m.score, [tuple(r) for r in m.runs]) for m in got[2, 2].masks] == [(0.75, [(0, 2), (8, 2)])]


def test_both_fall_back_to_the_text(given):
    images, asked, prompts = given
    answers = evaluation.predicted(evaluation.requests(images, asked, prompts, max_points=2), a_model(), "text_point")
    got = found(answers)
    assert (len(got[1, 1].masks), got[1, 1].points, got[1, 1].used_text_only_fallback) == (1, 2, False)
    assert (got[2, 1].used_text_only_fallback, got[2, 1].combined_prediction_error) == (True, True)
    assert (got[2, 2].used_text_only_fallback, got[2, 2].combined_prediction_error) == (True, False)
    assert [m.score for m in got[2, 1].masks] == [0.25]


def test_a_pair_that_loses_all_prompts_misses_all(given, spark):
    images, asked, prompts = given
    answers = Engine(Config(segmentation="point", hybrid_threshold=0.7)).predict(images, asked, a_model(), prompts)
    got = found(answers)
    assert got[2, 1].cached and got[2, 1].points == 0 and len(got[1, 1].masks) == 1
    truth = spark.createDataFrame([(1, 1, 5, 18, 2), (1, 1, 5, 26, 2), (2, 1, 6, 0, 3), (2, 2, 7, 0, 9)], "image_id long, class_id int, inst int, start long, len long")
    counts, records, instances = evaluation.evaluated(answers, truth, "point")
    assert [(r.class_id, r.tp, r.fp, r.fn) for r in counts.collect()] == [(1, 4, 0, 3)]  # pair (2, 2) was not asked
    assert [(r.class_id, r.score, r.is_tp, r.rec_id) for r in records.collect()] == [(1, 0.45, 1, 1)]
    row = evaluation.class_results(counts, records, instances).first()
    assert (row.gt_count, row.ap) == (2, 0.5)


def test_saved_lines_decode_to_the_same_masks(given, spark):
    images, asked, prompts = given
    answers = evaluation.predicted(evaluation.requests(images, asked, prompts), a_model(), "text_point")
    names = spark.createDataFrame([(1, "leaf"), (2, "stem")], "class_id int, class_name string")
    files = spark.createDataFrame([(1, "one.png", 8, 8), (2, "two.png", 8, 8)], "image_id long, file_name string, height int, width int")
    lines = evaluation.saved(answers, files, names, "text_point").collect()
    want = sorted((r.image_id, r.class_id, sum(s.len for s in m.runs)) for r in answers.collect() for m in r.masks)
    got = sorted((r.image_id, r.category_id, int(masks.decode(json.dumps(r.segmentation.asDict()), 8, 8).sum())) for r in lines)
    assert got == want and {r.category for r in lines} == {"leaf", "stem"}


def test_nothing_asked_gives_no_rows(given):
    images, asked, prompts = given
    answers = evaluation.predicted(evaluation.requests(images, asked.where("false"), prompts), a_model(), "point")
    assert answers.count() == 0 and evaluation.counters(answers, "point").first().pairs == 0
    with pytest.raises(ValueError):
        evaluation.predicted(answers, a_model(), "voice")
