"""Operator 5, BPE encoding and decoding: batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks up the rank of every
neighbouring pair by binary search over the sorted pair keys, takes each word's lowest
rank, and merges all places of that pair in the word at once (left to right, without
overlap). Words without a mergeable pair leave the array. One rank goes per word and round,
so a word of n symbols takes at most n rounds. Lowest rank first is what the tokenizer file
prescribes: a rule can only use symbols of earlier rules, so merging all places at once gives
the same symbols as one at a time.

Encoding and decoding are per document, so the job is one pass without a shuffle. A task
remembers the ids of the pre-tokens it has met (a bounded number) and merges only new ones.

Cases: null and empty text give no ids and an empty decoded text; repeated rows, extra
columns and null ids need nothing special; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow, task_cache, text_or_empty
from .pieces import WORD_LEVEL, PieceCache, text_slices

#: Words merged together in one flat array.
WORDS_PER_ROUND = 50_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(shifted)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizers file: BPE with an end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)  # normaliser and pre-tokenizer of unusual texts
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.byte_symbol = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.last_symbol = np.array([self.vocab[c + end] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = len(self.tokens)
        keys = np.array([self.vocab[a] * self.base + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.made = keys[order], order.astype(np.int64), made
        self.unranked = len(pairs)
        #: Of each known pre-token: its ids, their decimal text, and the text they decode to.
        self.cache = PieceCache(WORD_LEVEL, self._forms, tuple(self.special), lower=True,
                                weight=lambda values: sum(250 + 36 * len(ids) + len(shown) + len(text) for ids, shown, text in values))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], self.unranked)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each pre-token (already normalised)."""
        out: list = []
        for k in range(0, len(words), WORDS_PER_ROUND):
            out += self._merge([w.encode("utf-8") for w in words[k : k + WORDS_PER_ROUND]])
        return out

    def _forms(self, words: list[str]) -> list[tuple[tuple[int, ...], str, str]]:
        return [(ids, " ".join(map(str, ids)), self.decode(ids)) for ids in self.encode_words(words)]

    def _merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        sizes = np.array([len(w) for w in words], np.int64)
        out: list = [()] * len(words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.byte_symbol[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last_symbol[raw[ends]]
        while len(symbols):
            inside = np.zeros(len(symbols), bool)  # a pair starts here
            inside[:-1] = word[:-1] == word[1:]
            rank = np.full(len(symbols), self.unranked, np.int64)
            at = np.flatnonzero(inside)
            rank[at] = self._ranks(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            done = lowest == self.unranked
            if done.any():
                ids, bounds = symbols.tolist(), starts.tolist()
                which = word[starts].tolist()
                for k in np.flatnonzero(done).tolist():
                    out[which[k]] = tuple(ids[bounds[k] : bounds[k] + int(counts[k])])
                keep = np.repeat(~done, counts)
                symbols, word, rank, lowest, counts = symbols[keep], word[keep], rank[keep], lowest[~done], counts[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, counts)
            places = np.flatnonzero(hit)
            # Of touching places (the pair of a symbol with itself) every other one merges.
            first = np.r_[True, np.diff(places) != 1]
            run_start = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            symbols[places] = self.made[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = self.cache.pieces(texts)
        known = self.cache.known
        return [self._encode_unusual(text) if words is None else [i for w in words for i in known[w][0]]
                for text, words in zip(texts, split, strict=True)]

    def digest_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: the number of ids, and the sha256 of their decimal text and of the decoded text.

        Ids decode one by one, joined by a blank, so a text decodes to its pre-tokens' decoded texts joined.
        """
        split, out = self.cache.pieces(texts), []
        known = self.cache.known
        for text, words in zip(texts, split, strict=True):
            if words is None:
                ids = self._encode_unusual(text)
                shown, decoded = " ".join(map(str, ids)), self.decode(ids)
            else:
                forms = [known[w] for w in words]
                shown, decoded = " ".join([f[1] for f in forms]), " ".join([f[2] for f in forms])
            out.append((shown.count(" ") + 1 if shown else 0, hashlib.sha256(shown.encode()).hexdigest(),
                        hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
        return out

    def _encode_unusual(self, text: str) -> list[int]:
        """A text with special tokens or rare characters: the library splits it, the merges are ours."""
        ids: list[int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                back = _byte_of()
                for i in self._merge([bytes(back[c] for c in p) for p, _ in pieces if p]):
                    ids.extend(i)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids as the file's settings give it: no decoder, tokens joined by a blank."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(path)


task_cache(word_bpe.cache_clear)


def encode_documents(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` and ``decoded`` of every document's whole text."""
    from pyspark.sql import types as T

    rows = docs.select(*keep, text_or_empty().alias("_text"))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                # Copies that stand together (as epochs leave them) are encoded once.
                place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
                ids = bpe.encode_batch(list(place))
                which = pa.array([place[t] for t in texts], pa.int64())
                decoded = pa.array(list(map(bpe.decode, ids)), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.drop_columns(["_text"]).columns, pa.array(ids, pa.list_(pa.int32())).take(which), decoded.take(which)],
                    [*keep, "ids", "decoded"])

    return map_arrow(rows, run, schema)


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encode_documents``, digested where it is made."""
    rows = docs.select("doc_id", text_or_empty().alias("_text"))

    def run(batches):
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                counts, ids_sha, text_sha = zip(*bpe.digest_batch(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir), default_tokenizer())
