"""Spelling variants grouped without pairs.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Words of equal length that differ at
one position share exactly one wildcard group, (position, prefix, suffix): the word with that position left open. A group keeps
its size and its two largest words, which is all that a member needs: the others are size - 1, and the largest of them is the
first word, or the second for the first itself. A group has at most one word per code point of the alphabet. For insertions and
deletions, each word's distinct deletions are joined to the vocabulary, which gives one row per such link, at most as many as a
word has code points. Counts and largest neighbours of both kinds are added up per word, partly before the shuffle.

Forms point to words at least RATIO times as frequent, so chains of forms are short and have no cycles; their ends are found by
pointer doubling.

Defined results: null and empty texts have no words; very long texts and runs are read whole; a null doc_id counts as an empty id;
repeated rows count again (each takes part by its own id); ties go to the smallest word in code-point order; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, memo_of, table

#: Least code points and occurrences of a word; a form's least frequency as a multiple of the word's; one in DAMAGE runs loses a code point.
LENGTH, LEAST, RATIO, DAMAGE = 6, 5, 5, 199
#: Distinct words that a task holds before it gives its counts out.
HELD = 1 << 18
OPEN = "\0"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(doc_id: int | None, text: bytes, pattern: re.Pattern, damage: int = DAMAGE) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, one in `damage` runs with one code point deleted, chosen by the crc32 of id and run."""
    prefix = crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(pattern.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
        h = crc32(run.encode(), prefix)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(word, n): words of at least `length` code points that occur at least `least` times in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("spelling")
        pattern = re.compile(f"[a-zÀ-ÿ]{{{length},}}")  # no shorter run gives a word
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return b

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words(i, x.as_py(), pattern):
                    seen[word] += n
                if len(seen) > held:
                    yield out()
        yield out()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) & (F.length("word") >= length))


def _without(word: Column, at: Column, fill: str = "") -> Column:
    return F.concat(F.substring(word, F.lit(1), at - 1), F.lit(fill), F.substring(word, at + 1, F.length(word)))


def _places(word: Column) -> Column:
    return F.sequence(F.lit(1), F.length(word))


def replaced(vocab: DataFrame) -> DataFrame:
    """(word, near, best): per wildcard group of a word that others share, how many they are and the largest."""
    keys = vocab.select("word", "n", F.explode(F.transform(_places(F.col("word")), lambda i: _without(F.col("word"), i, OPEN))).alias("key"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("less"), "word")
    groups = keys.select(
        "word", F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(whole).alias("size"),
        F.first(entry).over(whole).alias("first"), F.nth_value(entry, 2).over(whole).alias("second"),
    )
    best = F.when(F.col("place") > 1, F.col("first")).otherwise(F.col("second"))
    return groups.where("size > 1").select("word", (F.col("size") - 1).alias("near"), best.alias("best"))


def indels(vocab: DataFrame) -> DataFrame:
    """(word, near, best): one row for either side of each link by an inserted or deleted code point."""
    longer = vocab.select(F.col("word").alias("longer"), F.col("n").alias("longer_n"))
    cut = longer.withColumn("word", F.explode(F.array_distinct(F.transform(_places(F.col("longer")), lambda i: _without(F.col("longer"), i)))))
    links = cut.join(vocab, "word")
    sides = F.array(
        F.struct(F.col("word").alias("word"), F.struct((-F.col("longer_n")).alias("less"), F.col("longer").alias("word")).alias("best")),
        F.struct(F.col("longer").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("best")),
    )
    return links.select(F.explode(sides).alias("side")).select("side.word", F.lit(1).cast("long").alias("near"), "side.best")


def forms(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): how many words are near, and the largest if it is `ratio` times as frequent."""
    near = replaced(vocab).unionByName(indels(vocab)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    return vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )


def rooted(found: DataFrame) -> DataFrame:
    """found with root: the end of each word's chain of forms. Each round doubles the steps that a pointer covers."""
    pointers = durable(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(pointers.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        pointers = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return found.join(pointers, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = durable(vocabulary(table(spark, sf_dir, "documents")), "words")
    return rooted(durable(forms(vocab), "forms")).select("word", "form", "root", "n", "n_near", "form_n")


#: The crc32 of id and run from the table of its 256 single bytes, then the near words by joins on open positions and on deletions.
FORMS_SQL = """
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY doc_id, run),
hexed AS (SELECT run, n, hex(encode(coalesce(cast(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) AS h FROM hexed, bits),
words AS (SELECT word, cast(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
keys AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: substr(word, 1, i) || '*' || substr(word, i + 2))) AS k FROM words),
cuts AS (SELECT word, n, unnest(list_distinct(list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)))) AS k FROM words),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.k
  UNION ALL SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.k),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.form_n >= 5 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 5 * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS here, 0 AS steps FROM forms UNION ALL SELECT k.word, f.form, steps + 1 FROM walk k JOIN forms f ON f.word = k.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
QUERIES = {"op12_spelling_forms": op12_spelling_forms}
SQL = {"op12_spelling_forms": FORMS_SQL}
