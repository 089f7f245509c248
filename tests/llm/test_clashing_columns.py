"""Every temporary name of an operator's module, in both cases, as an extra column of its input: nothing crashes, no value changes."""

import inspect
import re

import pytest

import corpus_pipeline
from tessera.llm import lexical, minhash, mixing, packing, pieces, pii, quality_ledger, quotes, spelling, url_filter

OWN = {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "conv_id", "turn", "role"}


def names(module):
    """All quoted or assigned words of a module that could name a column."""
    found = {w for w in re.findall(r"""["']([A-Za-z_][A-Za-z0-9_]{0,15})["']""", inspect.getsource(module))} | {w for w in re.findall(r"\b(_[a-z]{1,6})\b", inspect.getsource(module))}
    found = {w for w in found if w.lower() not in OWN}
    seen, out = set(), []
    for k, w in enumerate(sorted(found)):
        if w.lower() not in seen:
            seen.add(w.lower())
            out.append(w.upper() if k % 2 else w)
    return out


def documents(spark, extra):
    text = "the quick brown fox jumps over the lazy dog and then some more words follow here to make it long enough for rules"
    rows = [(i, f"{text} {i // 2} {'x' * (i // 2)}", "en", f"s{i % 2}", 9) for i in range(6)] + [(1, text, "en", "s1", 9), (None, None, None, None, None)]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` string" for c in extra]])
    return spark.createDataFrame([(*r, *[f"v{k}" for k in range(len(extra))]) for r in rows], schema)


def unchanged(rows, columns, extra):
    assert rows.columns == columns
    for r in rows.collect():
        d = r.asDict()
        assert all(d[c] == f"v{k}" for k, c in enumerate(extra))


@pytest.mark.parametrize("stage, module", [(0, quality_ledger), (1, minhash), (2, pii), (3, mixing), (4, packing)])
def test_stages_keep_extra_columns(spark, stage, module):
    extra = names(module)
    docs = documents(spark, extra)
    got = corpus_pipeline.STAGES[stage][1](spark, docs, "")
    assert len(extra) > 5
    if stage < 4:
        unchanged(got, docs.columns, extra)
    assert got.count() > 0


def test_ledger_replaces_only_its_own(spark):
    extra = [c for c in names(quality_ledger) if c.lower() not in (*quality_ledger.MEASURES, "fail_bits")] + ["N_Words"]
    led = quality_ledger.ledger(documents(spark, extra)).collect()
    assert all(all(r[c] == f"v{k}" for k, c in enumerate(extra[:-1])) and isinstance(r["n_words"], int) for r in led)


def test_operators_ignore_extra_columns(spark):
    jobs = {
        mixing: mixing.mix, minhash: minhash.near_duplicates, pii: pii.find, spelling: spelling.vocabulary, pieces: pieces.encode,
        lexical: lambda d: lexical.search(lexical.index(d), d, item_id="doc_id"), packing: lambda d: packing.pack(packing.cut(d)),
    }
    for module, job in jobs.items():
        assert job(documents(spark, names(module))).count() > 0, module.__name__
    extra = names(url_filter)
    pages = documents(spark, extra).selectExpr("doc_id page_id", "concat('http://h', doc_id, '.net/') url", "text html", *[f"`{c}`" for c in extra if c.lower() not in ("page_id", "url", "html")])
    assert url_filter.judge(pages).count() == 8
    extra = names(quotes)
    talk = documents(spark, extra).selectExpr("doc_id conv_id", "cast(1 as long) turn", "'user' role", "text", *[f"`{c}`" for c in extra if c.lower() not in ("conv_id", "turn", "role", "text")])
    assert quotes.link(talk)[1].count() == 8
