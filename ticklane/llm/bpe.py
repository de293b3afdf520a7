"""BPE encoding and decoding of whole texts with a public vocabulary file.

Encoding follows the merge ranks of the file: each pre-token is a doubly linked list of symbols; a priority queue holds
the mergeable neighbours by (rank, position); an entry whose symbols have since changed is stale and skipped. Decoding
concatenates the vocabulary strings of the ids.

Rows: one output row per input row. Null text encodes as the empty text (no ids), and the empty list decodes to the
empty string. Very long texts are encoded whole, in time that grows with their length. Of equal ranks the
leftmost pair merges first. Repeated rows give repeated results, an empty table an empty one. Input columns named like an
output column are replaced; all others pass through.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RecentCache, arrow_column, extend, texts_of, vocabulary_path


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class BpeCodec:
    """Encoder for vocabulary files with byte letters, NFC, lower case and a suffix at word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings: list[str] = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for word, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = word
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.vocab[left], self.vocab[right]), (rank, self.vocab[left + right]))
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.words = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self.cache = RecentCache(lambda words: [*map(self.merged, words)], limit=150_000)

    def merged(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        data = word.encode()
        ids = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*found, i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, new, i = heappop(queue)
            if ids[i] < 0 or (j := after[i]) < 0 or (now := merges.get((ids[i], ids[j]))) is None or now[1] != new:
                continue  # stale: one of the two symbols has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heappush(queue, (*found, i))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heappush(queue, (*found, h))
        return tuple(x for x in ids if x >= 0)

    def plain(self, text: str) -> list[int]:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter, so without the final sigma
        return list(chain.from_iterable(self.cache.many(self.words.findall(text))))

    def encode(self, text: str) -> list[int]:
        if self.between is None or "<|" not in text:
            return self.plain(text)
        parts = self.between.split(text)
        return list(chain.from_iterable([self.special[x]] if i % 2 else self.plain(x) for i, x in enumerate(parts)))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text as array<int>."""

    def start():
        codec = BpeCodec(vocabulary_path(vocabulary))

        def batch(texts: pa.Array) -> pa.Array:
            rows = [np.array(codec.encode((x or b"").decode("utf-8", "replace")), np.int32) for x in texts_of(texts)]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))

        return batch

    return extend(docs, **{ids: arrow_column(start, "array<int>")(F.col(text))})


def decode(encoded: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """encoded with the vocabulary strings of the ids joined by one space, as files without a decoder are read. Null ids decode as the empty list."""

    def start():
        strings = pa.array(BpeCodec(vocabulary_path(vocabulary)).strings)

        def batch(rows: pa.Array) -> pa.Array:
            rows = pc.fill_null(rows, pa.scalar([], rows.type)) if rows.null_count else rows
            words = strings.take(rows.flatten())
            ends = np.cumsum([0, *pc.list_value_length(rows).to_pylist()], dtype=np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ")

        return batch

    return extend(encoded, **{text: arrow_column(start, "string")(F.col(ids))})
