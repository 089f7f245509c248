"""A trigram language model in an Elias-Fano trie, built and queried in Spark.

The trie has three levels. The first is the vocabulary: words are numbered by their hashes and cut into shards by ranges of
them. The second holds the successors of each word, the third those of each pair; both are Elias-Fano sequences whose upper
parts are the pointers from their contexts and whose lower parts are the words (elias_fano). A query starts at the word's
own place in its shard, follows the pointers to the range of its successors, finds the pair there, follows the pair's
pointers to the next range, and finds the third word in it.

A shard of the trie has the pairs of its range's words. The pairs of frequent words (more than a quarter of an average shard
of tokens; there are at most four times as many of them as shards) and of the beginning of texts are dealt over all shards
by a hash of the pair, in each of which such a word is one more context after the range's own: no shard holds all
successors of a frequent word.

Counting: each task numbers its words, counts pairs and their successors over chunks of tokens, and sends one packed block
per shard. A shard's task merges its blocks and its own words' counts and writes the levels to the shared folder, with
quantised smoothed probabilities and back-off weights. Files are written aside and renamed, so a repeated task does no harm,
and readers map them into memory; nothing is broadcast.

Smoothing: p(w) = (c(w) + 1) / (N + V + 1); a context's counts and a prior of MU times the lower order's probability give
p(w|h) = (c(hw) + MU p(w|h')) / (c(h) + MU). The discounted parts and back-off weights are kept in 16 bits of log10.

Words are known by 64-bit hashes. The shared folder must be reachable as a path on every executor (file: scheme or mounted).

Defined results: null and empty texts have the end token only; a null id counts as the text "" for the split; repeated rows
are separate texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import memo_of, shared_dir, swept, table
from .elias_fano import EliasFano

MU2, MU3, CHUNK, SCORE_CHUNK, WORD_CHUNK, DOCS_PER_SHARD, HELD_OUT = 2000.0, 10.0, 600_000, 1_000_000, 2_000_000, 4000, (7, 2)
LOWEST, STEPS = -12.0, 65535
#: Bytes of texts that are split at a time.
PIECE = 1 << 20
END = xxhash.xxh3_64_intdigest(b" end")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_open: dict = {}


class _Words:
    """Distinct words of a chunk by number: hashes and, once looked up, vocabulary ids and counts. Number 0 is the end token."""

    def __init__(self, distinct: pa.Array) -> None:
        self.hashes = np.fromiter(chain([END], map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_numpy(zero_copy_only=False))), np.uint64, len(distinct) + 1)

    def look(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) by number."""
        order = np.argsort(self.hashes)
        self.ids, self.counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.ids[order], self.counts[order] = vocabulary.look(self.hashes[order])
        return self.ids, self.counts


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, words of each): A-Z lower-cased, cut at runs of the bytes \\x20 and \\x09-\\x0D."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)  # none at the ends of texts
    return words.filter(some), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(lists))


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, _Words]]:
    """(other columns' values per row, word numbers of all tokens, their text's number, words) over whole texts, about size
    tokens at a time. The last column of a batch is the text."""
    memo_of("ngram_lm")
    rows, parts, lengths, n = [], [], [], 0

    def chunk() -> tuple[list[tuple], np.ndarray, np.ndarray, _Words]:
        coded, tokens = pa.concat_arrays(parts).dictionary_encode(), np.concatenate(lengths) + 1
        numbers, inner = np.zeros(int(tokens.sum()), np.int32), np.ones(int(tokens.sum()), bool)
        inner[np.cumsum(tokens) - 1] = False
        numbers[inner] = coded.indices.to_numpy() + 1
        return rows, numbers, np.repeat(np.arange(len(tokens), dtype=np.int32), tokens), _Words(coded.dictionary)

    for x in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(x.column(x.num_columns - 1)), 0).to_numpy(zero_copy_only=False)) // PIECE
        cuts = np.flatnonzero(np.diff(upto, prepend=-1, append=np.iinfo(np.int64).max))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            *others, texts = x.slice(lo, hi - lo).columns
            words, each = _split(texts)
            rows += zip(*(o.to_pylist() for o in others), strict=True) if others else [()] * len(each)
            parts.append(words)
            lengths.append(each)
            n += len(words) + len(each)
            if n >= size:
                yield chunk()
                rows, parts, lengths, n = [], [], [], 0
    if rows:
        yield chunk()


def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance: sorted keys and small counts then compress well in the shuffle."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a JSON line with places, then the arrays; written aside and renamed."""
    at, head = 0, {}
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    first = json.dumps(head).encode()
    first += b" " * (-(len(first) + 1) % 8) + b"\n"
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        f.write(first)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(aside, path)


def _mapped(path: str) -> dict[str, np.ndarray]:
    if path not in _open:
        if len(_open) > 4096:
            _open.clear()
        with open(path, "rb") as f:
            first = f.readline()
        whole = np.asarray(np.memmap(path, np.uint8, "r"))
        _open[path] = {k: whole[len(first) + at : len(first) + at + n * np.dtype(d).itemsize].view(d) for k, (d, n, at) in json.loads(first).items()}
    return _open[path]


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(np.log10(p), LOWEST, 0) - LOWEST) * (STEPS / -LOWEST)).astype(np.uint16)


#: Probability of each code.
_CODES = 10.0 ** (np.arange(STEPS + 1) * (-LOWEST / STEPS) + LOWEST)


class Vocabulary:
    """The trie's first level. Word ids are ranks by hash; shard r holds the hashes whose top part is r. Id size = unknown,
    size + 1 = the beginning of a text."""

    def __init__(self, folder: str) -> None:
        with open(f"{folder}/vocabulary.json") as f:
            about = json.load(f)
        self.folder, self.shards, self.starts = folder, about["shards"], np.array(about["starts"], np.int64)
        self.size, self.tokens, self.texts = about["size"], about["tokens"], about["texts"]
        self.sizes, self.number = np.diff(self.starts), np.uint16 if self.shards < 65535 else np.int32
        often = _mapped(f"{folder}/frequent") if os.path.exists(f"{folder}/frequent") else {"id": np.empty(0, np.int64), "count": np.empty(0, np.int64)}
        self.often, self.often_counts = often["id"], often["count"]

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted hashes."""
        ids, counts = np.full(len(hashes), self.size, np.int64), np.zeros(len(hashes), np.int64)
        shard = _range_of(hashes, self.shards)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for r in np.flatnonzero((edges[1:] > edges[:-1]) & (self.sizes > 0)).tolist():
            lo, hi = edges[r], edges[r + 1]
            a = _mapped(f"{self.folder}/words-{r}")
            at = np.minimum(np.searchsorted(a["hash"], hashes[lo:hi]), len(a["hash"]) - 1)
            hit = a["hash"][at] == hashes[lo:hi]
            ids[lo:hi][hit] = self.starts[r] + at[hit]
            counts[lo:hi][hit] = a["count"][at[hit]]
        return ids, counts

    def contexts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, context within it) of the pairs first << 32 | second, ascending; shard = shards where first is unknown."""
        first = (keys >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(keys) else np.empty(0, np.int64)
        word, times = first[cut], np.diff(np.append(cut, len(keys)))
        home = np.searchsorted(self.starts, word, "right") - 1
        row = word - self.starts[np.minimum(home, self.shards)]
        home[word == self.size] = self.shards
        at = np.minimum(np.searchsorted(self.often, word), max(0, len(self.often) - 1))
        hot = (self.often[at] == word) if len(self.often) else np.zeros(len(word), bool)
        row[hot], home[hot] = at[hot], -1
        shard, row = np.repeat(home, times), np.repeat(row, times)
        spread = np.flatnonzero(shard < 0)
        shard[spread] = _shard_of(keys[spread], self.shards)
        row[spread] += self.sizes[shard[spread]]
        return shard.astype(self.number), row  # few bits: sorted by radix

    def counts_of(self, shard: int, contexts: np.ndarray) -> np.ndarray:
        """Counts of a shard's contexts, from its own words and the frequent ones."""
        own = int(self.sizes[shard])
        every = np.concatenate([_mapped(f"{self.folder}/words-{shard}")["count"] if own else np.empty(0, np.int64), self.often_counts])
        return every[contexts]


def _range_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    x = (pairs ^ (pairs >> np.uint64(29))) * _MIX
    return _range_of(x ^ (x >> np.uint64(32)), shards)


def _pairs_of(ids: np.ndarray, first: np.ndarray, v: Vocabulary) -> np.ndarray:
    """first << 32 | second of each token and the one before it."""
    return np.where(first, v.size + 1, np.concatenate([[0], ids[:-1]])).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _ranges(level: EliasFano, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bounds() of contexts of which equal ones stand together, each looked up once."""
    cut = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    times = np.diff(np.append(cut, len(contexts)))
    begin, end = level.bounds(contexts[cut])
    return np.repeat(begin, times), np.repeat(end, times)


class Trie:
    """The second and third levels of one model, by shards."""

    def __init__(self, folder: str) -> None:
        self.vocabulary = Vocabulary(folder)
        self.folder, self.shards = folder, self.vocabulary.shards
        self.made = _mapped(f"{folder}/made")["pairs"] > 0

    def level(self, shard: int, name: str) -> EliasFano:
        a = _mapped(f"{self.folder}/trie-{shard}")
        return EliasFano.load({k: a[f"{name}.{k}"] for k in EliasFano.PARTS})

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, text: np.ndarray) -> np.ndarray:
        """p(token | the two before it) of each token.

        A token's pair is (token before, token); the context of its trigram is the pair of the token before. Distinct pairs
        stand in order of (shard, pair), distinct trigrams in order of (shard, pair, word): levels are read in ascending order."""
        v = self.vocabulary
        first = np.concatenate([[True], text[1:] != text[:-1]])
        keys, back = np.unique(_pairs_of(ids, first, v), return_inverse=True)
        shard, row = v.contexts(keys)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        at, row, second = place[back], row[order], keys[order] & np.uint64(0xFFFFFFFF)
        del back, place, order, shard
        q, weight, rank = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), -1, np.int64)
        del keys
        for s in np.flatnonzero((edges[1:] > edges[:-1]) & self.made).tolist():
            lo, hi = edges[s], edges[s + 1]
            level = self.level(s, "pairs")
            index, hit = level.find(*_ranges(level, row[lo:hi]), second[lo:hi])
            mine, index = lo + np.flatnonzero(hit), index[hit]
            both = _mapped(f"{self.folder}/trie-{s}")["p2back"][index]
            q[mine], weight[mine], rank[mine] = _CODES[both & np.uint32(65535)], _CODES[both >> np.uint32(16)], index
        context = np.where(first, v.texts, np.concatenate([[0], counts[:-1]]))
        p = q[at] + MU2 / (context + MU2) * ((counts + 1) / (v.tokens + v.size + 1))
        inner = np.flatnonzero(~first)
        ctx = at[inner - 1]
        known = rank[ctx] >= 0
        inner, ctx = inner[known], ctx[known]
        third = ctx.astype(np.uint64) << np.uint64(32) | ids[inner].astype(np.uint64)
        order = np.argsort(third)
        third, found = third[order], np.zeros(len(third))
        owner = (third >> np.uint64(32)).astype(np.int64)
        third &= np.uint64(0xFFFFFFFF)
        cuts = np.searchsorted(owner, edges)
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            lo, hi = cuts[s], cuts[s + 1]
            level = self.level(s, "next")
            index, hit = level.find(*_ranges(level, rank[owner[lo:hi]]), third[lo:hi])
            found[order[lo + np.flatnonzero(hit)]] = _CODES[_mapped(f"{self.folder}/trie-{s}")["p3"][index[hit]]]
        p[inner] = found + weight[ctx] * p[inner]
        return p

    def successors(self, first: int, second: int) -> np.ndarray:
        """Word ids that follow the pair in training."""
        shard, row = self.vocabulary.contexts(np.array([first << 32 | second], np.uint64))
        s = int(shard[0])
        if s == self.shards or not self.made[s]:
            return np.empty(0, np.int64)
        pairs, after = self.level(s, "pairs"), self.level(s, "next")
        index, hit = pairs.find(*pairs.bounds(row), np.array([second]))
        if not hit[0]:
            return np.empty(0, np.int64)
        begin, end = after.bounds(index)
        return after.word(np.arange(begin[0], end[0])).astype(np.int64)


def _local(path: str) -> str:
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError(f"the model's folder must be reachable as a path on every executor, not {path}")
    return where.path


def build(train: DataFrame, texts: int) -> str:
    """Folder of the model of train (text). texts: number of all rows, from which the number of shards follows."""
    spark = train.sparkSession
    folder = _local(swept(spark, f"{shared_dir(spark)}/tessera-lm-{uuid.uuid4().hex}"))
    os.makedirs(folder, exist_ok=True)
    shards = max(4, texts // DOCS_PER_SHARD)

    def packed(h: np.ndarray, c: np.ndarray, n: int) -> pd.DataFrame:
        order = np.argsort(h)
        h, c = h[order], c[order]
        edges = np.searchsorted(_range_of(h, shards), np.arange(shards + 1))
        full = [r for r in range(shards) if edges[r] < edges[r + 1]]
        return pd.DataFrame({"shard": np.array(full, np.int32), "n": np.array([n if k == 0 else 0 for k in range(len(full))], np.int64), "a": [h[edges[r] : edges[r + 1]].tobytes() for r in full], "b": [_planes(c[edges[r] : edges[r + 1]].astype("<i8")) for r in full]})

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, numbers, _, words in _chunks(batches, WORD_CHUNK):
            yield pa.RecordBatch.from_pandas(packed(words.hashes, np.bincount(numbers, minlength=len(words.hashes)), len(rows)), preserve_index=False)

    def merge_words(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        r = int(key[0])
        h, back = np.unique(np.concatenate([np.frombuffer(a, "<u8") for a in x["a"]]), return_inverse=True)
        c = np.zeros(len(h), np.int64)
        np.add.at(c, back, np.concatenate([_unplanes(b, "<i8") for b in x["b"]]))
        os.makedirs(folder, exist_ok=True)
        _save(f"{folder}/words-{r}", {"hash": h, "count": c})
        return pd.DataFrame({"shard": [r], "size": [len(h)], "tokens": [int(c.sum())], "texts": [int(x["n"].sum())]})

    blocks = train.select("text").mapInArrow(count_words, "shard int, n long, a binary, b binary")
    made = blocks.groupBy("shard").applyInPandas(merge_words, "shard int, size long, tokens long, texts long").collect()  # one row a shard
    sizes = {m.shard: m.size for m in made}
    starts = np.concatenate([[0], np.cumsum([sizes.get(r, 0) for r in range(shards)])]).tolist()
    about = {"shards": shards, "starts": starts, "size": starts[-1], "tokens": sum(m.tokens for m in made), "texts": sum(m.texts for m in made)}
    with open(f"{folder}/vocabulary.json", "w") as f:
        json.dump(about, f)

    frequent = about["tokens"] // (4 * shards)

    def find_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(folder)
        for x in batches:
            for r in x.column(0).to_pylist():
                if v.sizes[r]:
                    c = np.asarray(_mapped(f"{folder}/words-{r}")["count"])
                    at = np.flatnonzero(c > frequent)
                    yield pa.RecordBatch.from_arrays([pa.array(v.starts[r] + at), pa.array(c[at])], ["id", "count"])

    often = sorted((x.id, x["count"]) for x in spark.range(0, shards, 1, min(shards, 200)).mapInArrow(find_frequent, "id long, count long").collect())  # at most 4 * shards rows
    often.append((about["size"] + 1, about["texts"]))  # the beginning of a text
    _save(f"{folder}/frequent", {"id": np.array([w for w, _ in often], np.int64), "count": np.array([c for _, c in often], np.int64)})

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(folder)
        for _, numbers, text, words in _chunks(batches):
            ids = words.look(v)[0][numbers]
            inner = np.concatenate([[False], text[1:] == text[:-1]])
            # a pair's successors are looked for under the pair, which also occurs as a pair of its own
            keys, back = np.unique(_pairs_of(ids, ~inner, v), return_inverse=True)
            count = np.bincount(back).astype("<u4")
            shard, row = v.contexts(keys)
            keys = row.astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
            order = np.lexsort((keys, shard))
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            place = np.empty(len(keys), np.uint64)
            place[order] = np.arange(len(keys), dtype=np.uint64)
            # in order of the pairs' places, successors come out by shard, pair and word
            follow, times = np.unique(place[np.concatenate([[0], back[:-1]])[inner]] << np.uint64(32) | ids[inner].astype(np.uint64), return_counts=True)
            owner, follow, times = (follow >> np.uint64(32)).astype(np.int64), follow.astype("<u4"), times.astype("<u4")
            edges3 = np.searchsorted(owner, edges)
            out = []
            for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                mine, after = order[edges[s] : edges[s + 1]], slice(edges3[s], edges3[s + 1])
                out.append((s, _planes(keys[mine]), _planes(count[mine]), _planes(np.bincount(owner[after] - edges[s], minlength=len(mine)).astype("<u4")), _planes(follow[after]), _planes(times[after])))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["shard", "a", "b", "c", "d", "e"]).astype({"shard": "int32"}), preserve_index=False)

    def merge_pairs(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        s, v = int(key[0]), Vocabulary(folder)
        keys, back = np.unique(np.concatenate([_unplanes(a, "<u8") for a in x["a"]]), return_inverse=True)
        count = np.bincount(back, np.concatenate([_unplanes(b, "<u4") for b in x["b"]]))
        rank = np.repeat(back, np.concatenate([_unplanes(c, "<u4") for c in x["c"]])).astype(np.uint64)
        third, back3 = np.unique(rank << np.uint64(32) | np.concatenate([_unplanes(d, "<u4") for d in x["d"]]), return_inverse=True)
        times = np.bincount(back3, np.concatenate([_unplanes(e, "<u4") for e in x["e"]])) if len(third) else np.empty(0)
        owner, context, low = (third >> np.uint64(32)).astype(np.int64), (keys >> np.uint64(32)).astype(np.int64), np.uint64(0xFFFFFFFF)
        levels = {"pairs": EliasFano.build(context, keys & low, int(v.sizes[s]) + len(v.often), v.size), "next": EliasFano.build(owner, third & low, len(keys), v.size)}
        arrays = {f"{k}.{n}": a for k, ef in levels.items() for n, a in ef.arrays().items()}
        arrays |= {"p2back": _quantised(count / (v.counts_of(s, context) + MU2)).astype(np.uint32) | _quantised(MU3 / (count + MU3)).astype(np.uint32) << np.uint32(16), "p3": _quantised(times / (count[owner] + MU3)) if len(third) else np.empty(0, np.uint16)}
        _save(f"{folder}/trie-{s}", arrays)
        return pd.DataFrame({"shard": [s], "pairs": [len(keys)], "thirds": [len(third)]})

    blocks = train.select("text").mapInArrow(count_pairs, "shard int, a binary, b binary, c binary, d binary, e binary")
    made = np.zeros(shards, np.int64)
    for m in blocks.groupBy("shard").applyInPandas(merge_pairs, "shard int, pairs long, thirds long").collect():  # one row a shard
        made[m.shard] = m.pairs
    _save(f"{folder}/made", {"pairs": made})
    return folder


def score(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(folder)
        v = trie.vocabulary
        for rows, numbers, text, words in _chunks(batches, SCORE_CHUNK):
            ids, counts = (a[numbers] for a in words.look(v))
            n = len(rows)
            base = np.bincount(text, np.log10((words.counts + 1) / (v.tokens + v.size + 1))[numbers], n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "held_out": pa.array([r[1] for r in rows], pa.bool_()), "n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text, counts > 0, n).astype(np.int64),
                "train_tokens": np.full(n, v.tokens, np.int64), "base_score": base, "score": np.bincount(text, np.log10(trie.probabilities(ids, counts, text)), n),
            })

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: tuple[int, int] = HELD_OUT) -> DataFrame:
    """Learns from the texts whose crc32(id) mod held[0] is not held[1] and scores all."""
    rest = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % held[0]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (rest == held[1]).alias("held_out"), F.col(text).alias("text"))
    return score(rows, build(rows.where("not held_out"), rows.count()))


def op3_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))


QUERIES = {"op3_trie_lm": op3_trie_lm}
SQL: dict[str, str] = {}
