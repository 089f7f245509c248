"""Encoding and decoding with a SentencePiece model through a table of distinct chunks.

White space becomes a marker in front of a word, and no piece of the model may cross from a word into the next marker (checked
when the model is read). Texts are therefore cut before every run of markers and before every line feed, which is part of no
piece, and each chunk is segmented without its neighbours. The table of distinct chunks has two levels:

* Over the whole corpus, chunks are counted (in tasks first, then by a shuffle of distinct chunks); the most frequent, at most
  SHARED of at most CHUNK bytes, are segmented once each and broadcast. That bounds the broadcast at every size of the corpus.
* The other chunks of a block of texts form the block's own table and are segmented once in the block. Joining those back
  through a shuffle would move every text; a block's table is emptied at OWN entries and begun anew.

Ids are joined back by position: a text is the sequence of its chunks, looked up in the two levels. decode() joins the bytes of
pieces by id in the same way.

Defined results: null and empty texts have only the begin and end ids and decode to an empty text; null ids arrays decode to
null; very long texts and chunks are encoded whole; repeated rows are encoded row by row; null doc_ids stay null; an empty table
gives an empty result; encode() ignores extra columns, decode() keeps them (a column named like its output is replaced).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import durable, memo_of, table

MODEL = "piece_bpe_32k.model"
SHARED, CHUNK, OWN = 1 << 18, 32, 1 << 18
MARK = "▁"
#: Steps per doubling in the histogram of counts from which the bound on frequent chunks is read.
STEPS = 16
_TOKEN = re.compile(rb" +[^ \n]*|\n[^ \n]*")
_loaded: dict = {}


class Model:
    """A model whose pieces cross neither into a marker nor over a line feed."""

    def __init__(self, path: str | None) -> None:
        from sentencepiece import SentencePieceProcessor

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        self.sp = sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in every]
        probe = "  ﬁ Å "
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("pieces cross white space, or the model changes texts: chunks cannot be segmented alone")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.bytes = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in zip(every, pieces, strict=True)]
        self.silent = {i for i in every if sp.is_control(i)}
        self.plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in every]

    def segment(self, chunk: bytes) -> bytes:
        """Ids of a chunk as little-endian unsigned 32-bit integers. The library puts a marker before what it is given unless
        that is empty: it is the first marker of a chunk with markers, and is taken off before a line feed."""
        ids = self.sp.encode(chunk or b"\n")
        return array("I", ids[:1] if not chunk else ids[1:] if chunk.startswith(b"\n") else ids).tobytes()

    def text(self, ids: bytes) -> str:
        """What the library's decode() gives."""
        found = array("I", ids).tolist()
        raw = b"".join(map(self.bytes.__getitem__, found))
        first = next((i for i in found if i not in self.silent), None)
        try:
            return raw[first is not None and self.plain[first] and raw[:1] == b" " :].decode()
        except UnicodeDecodeError:  # byte pieces that form no character
            return self.sp.decode(found)


def chunks(raw: bytes) -> list[bytes]:
    """A text cut before each run of markers and each line feed; the first of a chunk's markers is left out. Empty for an empty text."""
    if not raw:
        return []
    if b"  " in raw or raw[:1] == b" " or b"\xe2\x96\x81" in raw:
        return [t if t[:1] == b"\n" else t[1:] for t in _TOKEN.findall(b" " + raw.replace(b"\xe2\x96\x81", b" "))]
    return raw.replace(b"\n", b" \n").split(b" ")


def _model(path: str | None) -> Model:
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def _raw(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))


def counted(docs: DataFrame, text: str = "text", own: int = OWN) -> DataFrame:
    """(chunk, n): how often each distinct chunk stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("pieces", _loaded.clear)
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"])
            seen.clear()
            return b

        for batch in batches:
            for x in batch.column(0):
                seen.update(chunks(x.as_py()))
                if len(seen) > own:
                    yield out()
        yield out()

    return _raw(docs, text).mapInArrow(run, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def segmented(distinct: DataFrame, path: str | None = None) -> DataFrame:
    """(chunk, ids): each row's chunk segmented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("pieces", _loaded.clear)
        m = _model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.segment(c) for c in batch.column(0).to_pylist()], pa.binary())], ["chunk", "ids"])

    return distinct.select("chunk").mapInArrow(run, "chunk binary, ids binary")


def frequent(distinct: DataFrame, most: int = SHARED) -> DataFrame:
    """The chunks of at most CHUNK bytes that occur oftenest, at most `most`: those whose count reaches the least bound that so
    many pass, read from a histogram of counts."""
    step = F.floor(F.log2("n") * STEPS)
    short = distinct.where(F.length("chunk") <= CHUNK).withColumn("step", step)
    bound, total = None, 0
    for at, k in sorted(((r[0], r[1]) for r in short.groupBy("step").count().collect()), reverse=True):
        total += k
        if total > most:
            break
        bound = at
    return short.where(F.col("step") >= bound).drop("step") if bound is not None else short.where("false").drop("step")


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", most: int = SHARED, own: int = OWN) -> DataFrame:
    """(doc_id, ids binary): each text's ids between the begin and the end id, little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    distinct = durable(counted(docs, text, own), "chunks")
    shared = spark.sparkContext.broadcast({bytes(r[0]): bytes(r[1]) for r in durable(segmented(frequent(distinct, most), path), "segmented").toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("pieces", _loaded.clear)
        m = _model(path)

        class Rest(dict):
            """The block's own table."""

            def __missing__(self, chunk: bytes) -> bytes:
                self[chunk] = ids = m.segment(chunk)
                return ids

        rest, level = Rest(), shared.value.get
        begin, end = array("I", [m.begin]).tobytes(), array("I", [m.end]).tobytes()
        for batch in batches:
            for i in range(0, len(batch), 256):
                part, ids = batch.slice(i, 256), []
                for x in part.column(1):
                    found = chunks(x.as_py())
                    ids.append(b"".join([begin, *[level(c) or rest[c] for c in found], end]))
                    if len(rest) > own:
                        rest.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the column ids replaced by the decoded text."""
    others = [c for c in encoded.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("pieces", _loaded.clear)
        m = _model(path)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [None if b is None else m.text(b) for b in part.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(texts, pa.string())], [*others, text])

    rows = encoded.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids}`"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(text, StringType())]))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"))
    digest = encoded.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(digest).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op13_piece_codec": op13_piece_codec}
SQL: dict[str, str] = {}
