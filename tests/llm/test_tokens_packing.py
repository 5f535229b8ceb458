import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stockflow.llm.packing import best_fit_decreasing, pack_tokens, segments
from stockflow.llm.tokens import load, pieces_of, specials, token_counts, tokenizer_path
from tests.llm.util import ODD, empty_docs, odd_docs, sf_docs

SPACES = [(20 + i, t, "en", "a", 1) for i, t in enumerate([
    " a", "a ", "a  b", "a\n  b", "a \n b", "a\n b", "it's 's a  b", "x<|endoftext|>y", "a\n <|endoftext|> b", "  ", " ", "a\t b\t\tc", "don't  stop"])]


def library(text):
    return load(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab' \n\t é1.<|>", max_size=30))
def test_pieces_are_independent(text):
    parts = pieces_of(text, specials(tokenizer_path()))
    if parts is not None:
        ids = library(parts[0]) + [i for p in parts[1:] for i in library(" " + p)]
        assert ids == library(text)


def test_counts_match_library(spark):
    docs = sf_docs(spark).drop("n_chars").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source")).unionByName(
        spark.createDataFrame(SPACES, "doc_id long, text string, lang string, source string, n_chars long").drop("n_chars"))
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library(r.text))) for r in docs.collect()), key=str)
    got = token_counts(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts(empty_docs(spark)).collect() == []


def naive_best_fit(lengths, capacity):
    rows = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rows if sum(r) + n <= capacity]
        if fit:
            max(fit, key=sum).append(n)
        else:
            rows.append([n])
    return sorted(sorted(r) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_fills_rows_like_brute_force(lengths):
    rows = best_fit_decreasing(lengths, 32)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 32 for r in rows)
    assert len(rows) == len(naive_best_fit(lengths, 32))


def test_packing_round_trip(spark):
    docs = sf_docs(spark).select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    packed = pack_tokens(docs, capacity=512).cache()
    for r in packed.collect():
        assert len(r.input_ids) == 1024 and r.cu_seqlens[-1] == r.n_tokens <= 512
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.position_resets)
    back = {}
    for r in segments(packed).collect():
        back.setdefault((r.doc_id, r.n_doc_tokens), []).append((r.doc_offset, list(np.frombuffer(r.ids, "<u2"))))
    want = {}
    for r in docs.collect():
        if r.text:
            ids = library(r.text)
            want.setdefault((r.doc_id, len(ids)), []).extend((at, ids[at:at + 512]) for at in range(0, len(ids), 512))
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in want.items()}
    assert pack_tokens(empty_docs(spark)).collect() == []
    assert len({r.doc_id for r in docs.collect() if r.text}) == len({k[0] for k in back}) and len(ODD)
