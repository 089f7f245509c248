import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=20):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, c.total()) for d, c in found if c]
    n, total = len(found), sum(k for *_, k in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c, k in found:
            m = 75 + 25 * k * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def made(seed, n, vocabulary, longest):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeÉé9") for _ in range(rng.randrange(1, 6))) for _ in range(vocabulary)]
    text = lambda k: " ".join(words[min(int(rng.paretovariate(0.4)), vocabulary) - 1] + rng.choice(("", ",", "-X")) for _ in range(k))
    docs = [(i, text(rng.randrange(longest))) for i in range(n)]
    return docs, [(i, text(rng.randrange(12))) for i in range(12)]


def answers(spark, docs, items, top=20, batch_items=256, **sizes):
    frame = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, terms string, item long").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return lexical.search(lexical.index(frame, **sizes), asked, top=top, batch_items=batch_items)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_in_every_tier(spark, seed):
    sizes = {"block_docs": (7, 40, 400, 90)[seed], "cuts": ((1, 3), (2, 5), (3, 30), (16, 256))[seed]}
    docs, items = made(seed, 300, (30, 300, 2000, 400)[seed], 40)
    docs += [(None, docs[0][1]), (1, docs[1][1]), (-5, docs[2][1]), (900, None), (901, ""), (902, "-- , ."), (903, "abc " * 30_000)]
    items += [(50, None), (51, ""), (52, docs[5][1]), (52, docs[5][1]), (53, "nowhere zzzz"), (None, docs[9][1]), (54, "abc ABC abc")]
    got = answers(spark, docs, items, batch_items=(256, 5)[seed % 2], **sizes).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items)


def test_items_are_proven_early_and_fall_through(spark):
    docs = [(i, "common words") for i in range(200)] + [(900 + i, f"rare{i} common, longer text") for i in range(5)]
    items = [(0, "rare1 rare2 rare3"), (1, "common"), (2, "rare1 common")]
    tiers = {}
    for r in answers(spark, docs, items, top=3, cuts=(2, 8)).collect():
        tiers.setdefault(r.item_id, set()).add(r.tier)
    assert tiers[0] == {0} and tiers[1] == {2} and len(tiers[2]) == 1
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in answers(spark, docs, items, top=3, cuts=(2, 8)).collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert answers(spark, [], [(1, "a")]).count() == 0 and answers(spark, [(1, "a")], []).count() == 0
    assert answers(spark, [(1, None)], [(1, "a")]).count() == 0


def test_query_equals_sql(spark):
    dir_ = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{dir_}/{t}.parquet'")
    got = lexical.QUERIES["op11_tiered_search"](spark, dir_)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = con.execute(lexical.SEARCH_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
