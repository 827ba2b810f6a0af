"""The pipeline, stage by stage, against brute force."""

import collections
import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_documents import awkward, brute_components, brute_spans
from tokenizers import Tokenizer

from billstream.llm import secret_ledger
from billstream.llm.bpe_automaton import bpe_digests
from billstream.llm.common import BATCH_BYTES, BATCH_SETTING

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages_on_awkward_rows(spark):
    """Null ids and texts, repeated rows, an id with several texts: each stage on all of them."""
    rows = [(i, t, la, s, len(t or "")) for i, t, la, s in awkward()] + [(7, "another text of this id, which is quite long", "en", "src0", None), (900, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, docs, SF) for name, stage in stages.items()}
    letters = collections.Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert rows_of(out["language ID"]) == letters
    gone = {i for i, n, c in brute_components([(r[0], r[1]) for r in rows]) if n and i is not None and i != c}
    assert gone and rows_of(out["Jaccard join"]) == collections.Counter(r for r in rows if r[0] not in gone)
    scanned = rows_of(out["secret scan"])
    assert sum(scanned.values()) == len(rows) and sum((collections.Counter(r for r in rows if not secret_ledger.finder()(r[1] or "")) - scanned).values()) == 0
    assert not any(secret_ledger.finder()(t or "") for _, t, *_ in scanned)
    mixed = rows_of(out["source mix"])
    assert mixed and not mixed - collections.Counter(rows) and len(mixed) < len(set(rows))
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out["BPE"].collect()) == collections.Counter((r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)


def test_stages_on_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "BPE" or out.columns == empty.columns)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(100_000 + i, t, la or "en", s or "x", len(t or "")) for i, t, la, s in awkward() if i is not None and i != 7]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        after = out.collect()
        ids, kept = {r.doc_id: r for r in before}, {r.doc_id for r in after}
        assert len(after) == len(kept) and kept <= set(ids)
        if name == "language ID":
            assert set(ids) - kept == {100_300, 100_301, 100_302, 100_303}
        elif name == "Jaccard join":
            want = brute_components([(r.doc_id, r.text) for r in before])
            assert kept == {c if n else i for i, n, c in want} and len(kept) < len(ids)
        elif name == "secret scan":
            assert kept == set(ids)
            changed = {r.doc_id for r in after if r.text != ids[r.doc_id].text}
            assert changed >= {i for i, r in ids.items() if brute_spans(r.text)} and all("[secret]" in r.text and len(r.text) == r.n_chars for r in after if r.doc_id in changed)
        elif name == "source mix":
            # Each leaf ends with the document that crosses its budget.
            size = lambda rows: sum(len(r.text.split()) for r in rows)
            longest = {}
            for r in before:
                longest[r.lang, r.source] = max(longest.get((r.lang, r.source), 0), len(r.text.split()))
            share = corpus_pipeline.MIX_SHARE * size(before)
            assert share - len(longest) <= size(after) <= share + sum(longest.values()) and len(kept) < len(ids)
        else:
            lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
            for r in after:
                e = lib.encode(ids[r.doc_id].text, add_special_tokens=False).ids
                assert r.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(ids[r.doc_id].text.encode()).hexdigest()
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(after, docs.schema)


def test_stages_on_clashing_names(spark):
    """Columns named as the stages' own pass through, whatever their kind."""
    names = ["__language", "__blob", "__spans", "__maybe", "__bucket", "__bits", "__place", "__id", "other0", "share", "place", "of"]
    schema = SCHEMA + "".join(f", `{n}` {'array<int>' if i % 2 else 'string'}" for i, n in enumerate(names))
    rows = [(i, t, la, s, len(t or ""), *([i or 0] if k % 2 else f"{n}{i}" for k, n in enumerate(names))) for i, t, la, s in awkward()]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out, want = stage(spark, docs, SF), stage(spark, plain, SF)
        if name == "BPE":
            assert rows_of(out) == rows_of(want)
            continue
        assert out.columns == docs.columns and rows_of(out.select(*plain.columns)) == rows_of(want)
        assert all(r["__id"] == [r.doc_id or 0] and r["__language"] == f"__language{r.doc_id}" and r.other0 == f"other0{r.doc_id}" for r in out.collect())


@pytest.mark.parametrize("size", ["64m", "64MB", "1g", "268435456", "1k"])
def test_batch_limit_in_any_unit(spark, size):
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.set(BATCH_SETTING, size)
        docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
        assert bpe_digests(docs, public_tokenizers.path(corpus_pipeline.VOCABULARY)).count() == 1
        assert spark.conf.get(BATCH_SETTING) == ("1k" if size == "1k" else str(BATCH_BYTES))
    finally:
        spark.conf.set(BATCH_SETTING, before)
