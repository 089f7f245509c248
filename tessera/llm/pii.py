"""Personal data in whole texts: exact patterns, and spans added by a character-level BiLSTM-CRF.

The patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers. The tagger reads
every character of every text in overlapping windows, which are decoded and reconciled over the whole text. Its spans are
credentials (kind secret) and personal data in forms that the patterns miss (kind other: a domestic phone number, an account
number, an address written out, say). Base spans stay: of a tagger's span that overlaps one, only the parts outside are added
(all of a credential's, those of four letters or digits of others); white space at its ends goes.

Defined results: null and empty texts have no spans; repeated rows are judged row by row; null ids stay null; an empty table
gives an empty result; extra columns are kept by redact() and ignored by find().
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tagger
from .common import memo_of, table

BASE = ("email", "ip", "card", "phone")
ADDED = tagger.KINDS
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
#: Characters of texts that are read side by side, a bound on memory.
PART = 1_500_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# The look-behinds change no match (a match starts where a run of digits does) and keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: one @ each, with all that may be a local part directly before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def added_spans(text: str, tagged: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The tagger's spans without what base spans cover and without white space at the ends."""
    out = []
    for s, e, kind in tagged:
        parts = [(s, e)]
        for a, b, _ in base:
            parts = [p for x, y in parts for p in ((x, min(y, a)), (max(x, b), y)) if p[0] < p[1]] if a < e and s < b else parts
        whole, least = parts == [(s, e)], 1 if kind == "secret" else 4
        for x, y in parts:
            while x < y and text[x].isspace():
                x += 1
            while x < y and text[y - 1].isspace():
                y -= 1
            if x < y and (whole or sum(c.isalnum() for c in text[x:y]) >= least):
                out.append((x, y, kind))
    return out


def find_spans(texts: list[str | None], model: tagger.Tagger) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) per text."""
    base = [base_spans(t) if t and _MAYBE.search(t) else [] for t in texts]  # every pattern has a digit or an @
    tagged = tagger.tag_texts(model, [t or "" for t in texts])
    out = []
    for k, (t, own) in enumerate(zip(texts, base, strict=True)):
        more = added_spans(t, tagger.spans_of(tagged[k]), own) if k in tagged else []
        out.append((own, sorted([*own, *more], key=lambda x: (x[0], ORDER[x[2]]))))
    return out


def _by_parts(texts: list[str | None], model: tagger.Tagger) -> Iterator[tuple[str | None, list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(text, base spans, all spans), about PART characters at a time."""
    memo_of("pii")
    ends = np.cumsum([len(t or "") for t in texts]) // PART
    for lo, hi in itertools.pairwise(np.searchsorted(ends, np.arange(ends[-1] + 2)).tolist() if len(texts) else [0]):
        own = texts[lo:hi]
        for t, (base, every) in zip(own, find_spans(own, model), strict=True):
            yield t, base, every


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_other) per row."""
    model = tagger.trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [(b, a) for _, b, a in _by_parts(x.column(1).to_pylist(), model)]
            count = lambda k: pa.array([sum(s[2] == k for s in a) for _, a in found], pa.int64())
            out = {"doc_id": x.column(0)} | {f"n_{k}": count(k) for k in BASE}
            out["base_sha256"] = pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b, _ in found], pa.string())
            out["spans"] = pa.array([_digest(a) for _, a in found], pa.string())
            yield pa.RecordBatch.from_pydict(out | {f"n_{k}": count(k) for k in ADDED})

    columns = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {columns}, base_sha256 string, spans string, n_secret long, n_other long")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span (overlapping spans as one) replaced by the kind of its first in angle brackets."""
    out, at, end = [], 0, -1
    for s, e, k in spans:
        if s >= end:
            out += [text[at:s], f"<{k}>"]
        at = end = max(e, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with the spans in text masked (and n_chars made to fit); all columns and all rows are kept."""
    model = tagger.trained()

    @F.pandas_udf("string")
    def mask(x: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not a else masked(t, a) for t, _, a in _by_parts(x.tolist(), model)], dtype=object)

    out = docs.withColumn(text, mask(F.col(text)))
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def op10_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pii_tagger": op10_pii_tagger}
SQL: dict[str, str] = {}
