"""Repeated rows and null ids: mixing by leaf against plain Python, encoding and counting row by row against the libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import bpe, mixing, token_counts
from tallyframe.llm.common import work_path

from .common_fixtures import odd_documents


def _copies(rows: list[tuple], quotas: dict[tuple, tuple[int, int]]) -> Counter:
    """(leaf, id, tokens) and copies of every row: whole epochs, and one more up to the row that reaches the rest of the quota (rows
    of one id and size go together)."""
    leaves = defaultdict(list)
    for leaf, i, n in rows:
        leaves[leaf].append((i, n))
    out = Counter()
    for leaf, held in leaves.items():
        quota, tokens = quotas[leaf]
        epochs = quota // tokens if tokens else mixing.MAX_EPOCHS
        rest = quota - epochs * tokens if tokens else 0
        key = lambda r: (hashlib.md5(f"{mixing.SEED}:{epochs}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
        order, before, cut = sorted(held, key=key), 0, None
        for r in order:
            if before < rest:
                cut = key(r)
            before += r[1]
        for r in order:
            out[leaf, r[0], r[1], epochs + (cut is not None and key(r) <= cut)] += 1
    return out


@pytest.mark.parametrize("budget", [0, 5000, 21000, 60000, 10**7])
def test_mixing_of_repeated_rows(spark, budget):
    docs = odd_documents(spark, repeats=True)
    sizes = mixing.sizes_of(docs)
    got = mixing.mixed(sizes, budget=budget, **mixing.query_weights()).collect()
    rows = [((r.domain, r.lang, r.source), r.doc_id, r.n_tokens) for r in sizes.collect()]
    tokens = Counter()
    for leaf, _, n in rows:
        tokens[leaf] += n
    quotas = {(r.domain, r.lang, r.source): (r.quota, tokens[r.domain, r.lang, r.source]) for r in got}
    assert set(quotas) == set(tokens) and len(got) == len(rows)
    assert Counter(((r.domain, r.lang, r.source), r.doc_id, r.n_tokens, r.copies) for r in got) == _copies(rows, quotas)
    if budget == 10**7:
        assert {r.copies for r in got} == {mixing.MAX_EPOCHS}


def test_mixed_documents_keep_their_rows(spark):
    docs = odd_documents(spark, repeats=True)
    found = mixing.mix_documents(docs, whole=True, **mixing.query_weights())
    assert found.columns == docs.columns
    want, got = Counter(tuple(r) for r in docs.collect()), Counter(tuple(r) for r in found.collect())
    assert set(want) == set(got) and all(got[r] >= n for r, n in want.items())


def test_encoding_and_counting_of_repeated_rows(spark):
    docs = odd_documents(spark, repeats=True)
    word, byte = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    ids = [(i, word.encode(t, add_special_tokens=False).ids) for i, t in rows]
    want = Counter((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digest_documents(docs, bpe.default_tokenizer()).collect()) == want
    whole = bpe.encode_documents(docs, bpe.default_tokenizer()).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in whole) == Counter((i, tuple(x), word.decode(x, skip_special_tokens=False)) for i, x in ids)
    counts = token_counts.count_tokens(docs, token_counts.default_tokenizer(), work_path(spark, "test-cache")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counts) == Counter(
        (i, len(t.encode()), len(byte.encode(t, add_special_tokens=False).ids)) for i, t in rows)
