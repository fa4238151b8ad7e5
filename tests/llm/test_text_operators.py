"""Operators on single documents: BPE, token counts, token files, quality classifier, page text; against brute force."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import bpe, html_blocks, line_crf, pieces, token_counts, token_files
from tallyframe.llm.common import work_path

from .common_fixtures import empty_documents, odd_documents, texts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_safe_character_splits_as_in_the_library(word):
    ours = bpe.WordBpe(WORD)
    lib = Tokenizer.from_file(BYTE)
    for start in range(0, len(pieces.SAFE), 16):
        chars = [chr(c) for c in sorted(pieces.SAFE)[start : start + 16]]
        text = " ".join(f"a{c}b{c}{c.upper()} {c}1 {c}  {c}\n{c}'s" for c in chars)
        assert ours.encode_batch([text])[0] == word.encode(text, add_special_tokens=False).ids
        split = [i for e in lib.encode_batch(pieces.BYTE_LEVEL.findall(text), add_special_tokens=False) for i in e.ids]
        assert split == lib.encode(text, add_special_tokens=False).ids


def test_merge_rounds_and_decoding_equal_the_library(word):
    ours = bpe.WordBpe(WORD)
    cases = [*texts().values(), "aaaaaaaaaaaaaaab", "I'LL don't", "x" * 3000, "<|startoftext|>a<|endoftext|>", "ΣΑΣ Σίσυφος"]
    for text, ids in zip(cases, ours.encode_batch(cases), strict=True):
        assert ids == word.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == word.decode(ids, skip_special_tokens=False)


def test_bpe_query_columns(spark, word):
    got = {r.doc_id: r for r in bpe.digest_documents(odd_documents(spark), WORD).collect()}
    for i, text in texts().items():
        ids = word.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), _sha(" ".join(map(str, ids))), _sha(word.decode(ids, skip_special_tokens=False)))
    full = bpe.encode_documents(odd_documents(spark, extra=False), WORD).collect()
    assert {r.doc_id: list(r.ids) for r in full} == {i: word.encode(t, add_special_tokens=False).ids for i, t in texts().items()}
    assert bpe.digest_documents(empty_documents(spark), WORD).collect() == []


def test_token_counts_and_their_cache(spark, tmp_path, monkeypatch):
    lib, cache = Tokenizer.from_file(BYTE), str(tmp_path / "cache")
    want = {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in texts().items()}
    for _ in range(2):  # from an empty cache, then from a full one
        got = token_counts.count_tokens(odd_documents(spark, repeats=True), BYTE, cache).collect()
        assert len(got) == len(texts()) + 4
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got if r.doc_id is not None} == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts().values())) + 1  # each distinct content once, the second run added nothing
    assert token_counts.count_tokens(empty_documents(spark), BYTE, str(tmp_path / "none")).collect() == []


def test_token_files_round_trip(spark, word, tmp_path):
    folder = str(tmp_path / "files")
    files = token_files.write_token_files(odd_documents(spark), WORD, folder, docs_per_file=7)
    files.write.parquet(str(tmp_path / "list"))
    files = spark.read.parquet(str(tmp_path / "list"))
    assert files.count() > 3
    got = {r.doc_id: r for r in token_files.read_token_files(files, folder).collect()}
    start = 0
    for i, text in sorted(texts().items()):
        ids = [*word.encode(text, add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)
    one = token_files.TokenFile(folder, 0, 0)
    assert one.tokens(one.ids[0]).tolist()[-1] == 1
    token_files.drop_drafts(folder)
    path = sorted(os.listdir(folder))[0]
    damaged = bytearray((tmp_path / "files" / path).read_bytes())
    damaged[12] ^= 1
    (tmp_path / "files" / path).write_bytes(bytes(damaged))
    with pytest.raises(Exception):  # noqa: B017 - the frame's checksum or zstandard itself
        token_files.TokenFile(folder, 0, 0).raw(0)
    assert token_files.write_token_files(empty_documents(spark), WORD, str(tmp_path / "no")).collect() == []


@pytest.mark.parametrize("docs_per_file,files_per_part", [(3, 2), (100, 100)])
def test_rows_without_id_and_repeated_rows_are_spread_over_parts(spark, word, tmp_path, docs_per_file, files_per_part):
    rows = [(None, f"no id {k} {'x' * (k % 5)}") for k in range(60)] + [(5, f"same id {k}") for k in range(40)]
    rows += [(k, f"own id {k}") for k in range(-10, 30)] + [(7, "a repeat")] * 4 + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = str(tmp_path / "files")
    token_files.write_token_files(docs, WORD, folder, docs_per_file=docs_per_file, files_per_part=files_per_part).write.parquet(str(tmp_path / "list"))
    files = spark.read.parquet(str(tmp_path / "list"))
    got = sorted(token_files.read_token_files(files, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted((str(i), zlib.crc32(np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    sizes = {(r.part, r.file): r.n_docs for r in files.collect()}
    if docs_per_file == 3:
        assert max(sizes.values()) == 3 and len({p for p, _ in sizes}) > 20


def test_line_field_learns_and_scores_odd_rows(spark):
    rows, labels = [], []
    for k in range(120):
        good = k % 2 == 0
        rows.append((k, f"Plain words of line {k}.\nAnother plain one, here.\n" if good else "BUY!! NOW!!\n*** ### $$$ buy*** now###\n", "en", "s", 1))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    field = line_crf.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=40)
    scores = {r.doc_id: r.score for r in line_crf.score(docs, field).collect()}
    assert all((scores[k] >= 0.5) == (k % 2 == 0) for k in range(120))
    odd = line_crf.score(odd_documents(spark, repeats=True), field).collect()
    assert len(odd) == len(texts()) + 4 and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in odd if r.doc_id in (4, 5, 6)} == {field.prior}
    assert line_crf.score(empty_documents(spark), field).collect() == []
    blank = line_crf.train(empty_documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert blank.prior == 0.5


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    score, chain = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    starts = np.array([1, 0, 0, 0, 1, 0, 1], bool)
    zero = np.zeros((line_crf.N_FEATURES, 2))
    good, pairs = line_crf.LineField(zero, zero, zero, chain, 0.5).marginals(score, starts)
    want, want_pairs = np.zeros(7), np.zeros((2, 2))
    for a, b in ((0, 4), (4, 6), (6, 7)):
        total = 0
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + k, y] for k, y in enumerate(labels)) + sum(chain[x, y] for x, y in itertools.pairwise(labels)))
            total += w
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + k, y] for k, y in enumerate(labels)) + sum(chain[x, y] for x, y in itertools.pairwise(labels))) / total
            for k, y in enumerate(labels):
                want[a + k] += w * y
            for x, y in itertools.pairwise(labels):
                want_pairs[x, y] += w
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


PAGE = """<html><body><nav><ul><li>Home<li>About</ul></nav><!-- <p>hidden</p> --><article><h1>Title &amp; more</h1>
<p>First <b>para</b>graph,   with text.<br>Second line.<p>Unclosed &copy; one</p></article><div class="ad">Buy now</div>
<script>var t = "</p>";</script><footer>The end &am"""


def test_blocks_and_their_labels():
    blocks = html_blocks.blocks_of(PAGE)
    assert [b[1] for b in blocks] == ["Home", "About", "Title & more", "First paragraph, with text. Second line.", "Unclosed © one", "Buy now",
                                      "The end &am"]
    assert html_blocks._labels(blocks) == [False, False, True, True, True, False, False]
    assert html_blocks.blocks_of("") == [] and html_blocks.blocks_of("<p>a<p") == [(("p",), "a", 0.0)]


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(1)
    lstm = html_blocks.Lstm(*html_blocks.BlockLabeller.fresh().weights[:3])
    x = rng.normal(size=(4, 2, html_blocks.INPUT))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    out, tape = lstm.run(x, mask, True)
    aim = rng.normal(size=out.shape) * mask[:, :, None]
    d_in, d_across, d_bias = lstm.slopes(x, tape, aim)
    for weights, slope in ((lstm.inward, d_in), (lstm.across, d_across), (lstm.bias, d_bias)):
        for _ in range(5):
            at = tuple(rng.integers(s) for s in weights.shape)
            old = weights[at]
            weights[at] = old + 1e-5
            up = (lstm.run(x, mask) * aim).sum()
            weights[at] = old - 1e-5
            down = (lstm.run(x, mask) * aim).sum()
            weights[at] = old
            assert np.isclose((up - down) / 2e-5, slope[at], atol=1e-6)


def test_page_text_from_the_trained_network(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_blocks.train_on(pages, sample=40, epochs=24)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "v", "<nav>Menu</nav>")], "page_id long, url string, html string")
    got = html_blocks.extract(pages.unionByName(odd).withColumn("text", F.lit("mine")), model).collect()
    by = {r.page_id: r for r in got if r.url not in (None, "u", "v")}
    for p in pages.collect():
        blocks = html_blocks.blocks_of(p.html)
        want = " ".join(b[1] for b, y in zip(blocks, html_blocks._labels(blocks), strict=True) if y)
        assert by[p.page_id].text == want and by[p.page_id].n_chars == len(want)
    assert {r.text for r in got if r.url in (None, "u", "v")} == {""}


@pytest.mark.parametrize("limit", [0, 3000, 1 << 20])
def test_piece_cache_of_any_size_gives_the_same(word, limit):
    """Old and new generation, taken over or learned again; what is kept stays within bounds."""
    rng = np.random.default_rng(limit)
    made: list[str] = []
    cache = pieces.PieceCache(pieces.WORD_LEVEL, lambda ws: (made.extend(ws), [len(w) for w in ws])[1], (), lower=True, limit=limit)
    for _ in range(40):
        block = [" ".join(f"{'abc'[i % 3]}{'x' * (i // 3)}" for i in rng.zipf(1.5, 30) % 90) for _ in range(3)]
        split = cache.pieces(block)
        assert all(cache.known[w] == len(w) for words in split for w in words)
        assert cache.size <= limit // 2 + 100 * 400 and len(cache.known) + len(cache.old) <= 2 * 90
    assert len(made) == len(set(made)) or limit < 1 << 20


def test_slices_of_a_batch_cover_it():
    texts = ["", None, "a" * 50, "é" * 30, "b", "", "c" * 200, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    for limit in (1, 10, 60, 1000):
        got = [(k, t) for part, found in pieces.text_slices(batch, "t", limit) for k, t in zip(part.column("k").to_pylist(), found, strict=True)]
        assert got == list(enumerate(texts))
        assert all(len(found) == 1 or sum(len((t or "").encode()) for t in found) <= limit for _, found in pieces.text_slices(batch, "t", limit))
    assert list(pieces.text_slices(batch.slice(0, 0), "t")) == []
