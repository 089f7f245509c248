import io

import numpy as np
import pytest

from tessera.sources import mat


@pytest.mark.parametrize("compressed", (False, True))
@pytest.mark.parametrize("order", "<>")
def test_matrices_come_back(compressed, order):
    rng = np.random.default_rng(1)
    made = {
        "LabelMap": rng.integers(0, 460, (7, 5)).astype(np.uint16), "d": rng.normal(size=(3, 4)), "whole": np.array([[1.0, 2.0], [300.0, 4.0]]), "i": np.array([[-5, 7]], np.int32),
        "flag": np.array([[True, False], [False, True]]), "cube": rng.integers(0, 9, (2, 3, 4)).astype(np.uint8), "a_name_of_many_letters": np.zeros((0, 3)), "f": np.float32([[1.5]]), "big": np.array([[2**60 + 1]], np.int64),
    }
    got = mat.variables(mat.encoded(made, compressed, order))
    assert set(got) == set(made)
    for k, m in made.items():
        assert got[k].dtype == m.dtype and got[k].shape == m.shape and (got[k] == m).all()


def test_bytes_written_by_hand():
    """A 2 x 3 uint8 matrix "L" as the format's description lays it out."""
    body = bytes.fromhex("0600000008000000" "0900000000000000" "0500000008000000" "0200000003000000" "010001004c000000" "0200000006000000" "0102030405060000")
    data = b"x" * 124 + b"\0\1IM" + bytes.fromhex("0e000000") + len(body).to_bytes(4, "little") + body
    assert mat.variables(data)["L"].tolist() == [[1, 3, 5], [2, 4, 6]]
    text = bytearray(data)
    text[128 + 8 + 8] = 4  # a character matrix is left out
    assert mat.variables(bytes(text)) == {}


def test_what_cannot_be_read():
    good = mat.encoded({"LabelMap": np.ones((40, 40), np.uint8)}, True)
    for bad in (b"", b"x" * 200, good[:150], good[:140] + b"\0" * (len(good) - 140), mat.encoded({"m": np.ones((40, 40))}, False)[:-64]):
        with pytest.raises(ValueError):
            mat.variables(bad)


def test_label_masks(spark):
    from tessera.sources import readers

    grid = np.array([[1, 1, 300], [1, 2, 300]], np.uint16)
    buf = io.BytesIO()
    np.save(buf, grid)
    files = spark.createDataFrame([("a.mat", bytearray(mat.encoded({"LabelMap": grid}))), ("b.mat", bytearray(mat.encoded({"Other": grid}))), ("c.mat", bytearray(b"?")), ("d.npy", bytearray(buf.getvalue()))], "path string, content binary")
    rows = {}
    for r in readers.label_masks(files).collect():
        rows.setdefault(r.path, []).append((r.label, r.start, r.len))
    assert sorted(rows["a.mat"]) == sorted(rows["d.npy"]) == [(1, 0, 3), (2, 3, 1), (300, 4, 2)] and set(rows) == {"a.mat", "d.npy"}
