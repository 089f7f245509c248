import pytest

from tessera.sources import exports, keyed
from tessera.sources.keyed import Keyed
from tessera.sources.versions import Versions
from tessera.streaming import resume


class Dead(Exception):
    pass


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, seq int, v string").coalesce(1)


def found(cache):
    return sorted((r.k, r.seq, r.v) for r in cache.rows().collect()) if cache.exists() else []


def test_newest_row_of_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MERGE_AT", 3)
    cache = Keyed(spark, str(tmp_path), ("k",), order=("seq",))
    with pytest.raises(LookupError):
        cache.rows()
    cache.put(table(spark, (1, 2, "late"), (1, 1, "early"), (2, 1, "a"), (2, 1, "b"), (5, 0, None)))
    first = found(cache)
    assert first[0] == (1, 2, "late") and first[1][:2] == (2, 1) and len(first) == 3
    cache.put(table(spark, (1, 0, "new"), (3, 0, "c")))
    assert found(cache) == [(1, 0, "new"), first[1], (3, 0, "c"), first[2]]
    cache.put(table(spark, (3, 9, "d")))
    assert len(cache.versions.latest()[1]["layers"]) == 1  # merged
    assert found(cache) == [(1, 0, "new"), first[1], (3, 9, "d"), first[2]]
    many = Keyed(spark, str(tmp_path / "many"), ("k",), one=False)
    many.put(table(spark, (1, 0, "x"), (1, 1, "y"), (2, 0, "z")))
    many.put(table(spark, (1, 5, "w"), (1, 6, "w")))
    assert found(many) == [(1, 5, "w"), (1, 6, "w"), (2, 0, "z")]


def test_a_death_between_any_two_steps_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MERGE_AT", 2)  # a put writes, commits, merges, commits
    write, commit = Versions.write, Versions.commit
    for at in range(9):
        cache, left = Keyed(spark, str(tmp_path / str(at)), ("k",)), [10**9]
        cache.put(table(spark, (1, 0, "old"), (2, 0, "kept")))

        def step(real):
            def run(self, *a, real=real, left=left):
                left[0] -= 1
                if left[0] == -1:
                    raise Dead
                out = real(self, *a)
                left[0] -= 1
                if left[0] == -1:
                    raise Dead
                return out

            return run

        monkeypatch.setattr(Versions, "write", step(write))
        monkeypatch.setattr(Versions, "commit", step(commit))
        left[0] = at
        try:
            cache.put(table(spark, (1, 0, "new")))
            died = False
        except Dead:
            died = True
        left[0] = 10**9
        assert found(cache) in ([(1, 0, "old"), (2, 0, "kept")], [(1, 0, "new"), (2, 0, "kept")]) and died == (at < 8)
        cache.put(table(spark, (1, 0, "new")))  # the writer comes again
        assert found(cache) == [(1, 0, "new"), (2, 0, "kept")]
        cache.versions.prune()
        assert found(cache) == [(1, 0, "new"), (2, 0, "kept")]


def test_writers_at_once_and_repeated_batches(spark, tmp_path, monkeypatch):
    cache, other = (Keyed(spark, str(tmp_path), ("k",)) for _ in range(2))
    commit, first = Versions.commit, [True]

    def late(self, number, entry):
        if first[0]:
            first[0] = False
            other.put(table(spark, (2, 0, "other")))  # takes the number that this one is about to use
        commit(self, number, entry)

    monkeypatch.setattr(Versions, "commit", late)
    cache.put(table(spark, (1, 0, "mine")))
    assert found(cache) == [(1, 0, "mine"), (2, 0, "other")]
    cache.put(table(spark, (1, 1, "batch")), "s", 4)
    for again in (4, 3):
        cache.put(table(spark, (1, 2, "again")), "s", again)
    assert found(cache)[0] == (1, 1, "batch")


def test_caches_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", 1, 0.5), ("a.jpg", 1, 0.7), ("b.jpg", 1, 0.1)], "file_name string, class_id int, score double")
    exports.merged_prompts(rows, str(tmp_path / "p"), "hybrid", "f0")
    exports.merged_prompts(rows.where("score = 0.1").selectExpr("file_name", "class_id", "0.2D score"), str(tmp_path / "p"), "hybrid", "f0")
    hit = exports.prompt_lookup(spark.createDataFrame([("a.jpg", 1), ("b.jpg", 1), ("c.jpg", 1)], "file_name string, class_id int"), str(tmp_path / "p"), "hybrid", "f0")
    assert sorted(map(str, ((r.file_name, r.score) for r in hit.collect()))) == ["('a.jpg', 0.5)", "('a.jpg', 0.7)", "('b.jpg', 0.2)", "('c.jpg', None)"]
    source = str(tmp_path / "in")
    table(spark, (7, 1, "x"), (7, 3, "z"), (7, 2, "y"), (8, 1, "q")).write.parquet(source)
    for _ in range(2):
        resume.upsert_available(spark, source, "k long, seq int, v string", ("k",), str(tmp_path / "out"), str(tmp_path / "chk"), order=("seq",))
    assert sorted((r.k, r.v) for r in resume.latest(spark, str(tmp_path / "out"), ("k",)).collect()) == [(7, "z"), (8, "q")]
