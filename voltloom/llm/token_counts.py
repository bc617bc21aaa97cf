"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol per byte. A heap holds the adjacent pairs that
have a merge rule; the pair of lowest rank (leftmost on ties) is popped and its
right symbol is unlinked from a doubly linked list, until no rule applies. The
count is the number of initial symbols minus the merges; no identifier leaves
the operator.

Whitespace never lies inside a pre-token of the vocabulary this module is used
with, so a text's count is the sum over its whitespace-separated words, and
both words and pre-tokens are remembered per worker in dictionaries of bounded
size. Texts with characters whose normalisation is not plainly one-to-one go
through the library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.durable import small_batches

_SHIFT = 17
_POS = (1 << 32) - 1
#: Entries of a worker's word memory before it is emptied, and characters of a word or part
#: that is remembered; longer ones are counted each time (both bound memory, not results).
MEMORY_WORDS, MEMORY_CHARS = 1_000_000, 64
#: Characters outside these ranges send a text through the library's normaliser:
#: ASCII white space and printables, Latin letters without U+0130, dashes, quotes, euro.
PLAIN_ONLY = re.compile("[^\t\n\x0b\x0c\r -~\xa1-\xac\xae-įı-ɏ‐-‧‰-⁞€]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class MergeCounter:
    """Counts the tokens of texts under a ``tokenizers`` JSON byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path} is no BPE vocabulary")
        vocab, self.suffix = dict(model["vocab"]), model.get("end_of_word_suffix") or ""
        self.vocab = vocab
        self.rank: dict[int, int] = {}
        self.product: list[int] = []
        for order, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << _SHIFT | vocab[right], order)
            self.product.append(vocab[left + right])
        self.inner = {ch: vocab[ch] for ch in byte_letters().values() if ch in vocab}
        self.final = {ch: vocab[ch + self.suffix] for ch in byte_letters().values() if ch + self.suffix in vocab}
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = pre[0].get("pattern", {}).get("Regex", "")
        # white space, removed by the pattern, parts the text into words that are split alike alone
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and pre[0].get("invert") is True and r"[^\s" in split
        self.pattern = regex.compile(split) if self.by_words else None
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token, given in byte letters."""
        inner = self.inner
        sym = [inner[ch] for ch in piece]
        n = len(sym)
        if self.suffix:
            sym[-1] = self.final[piece[-1]]
        if n == 1:
            return 1
        find = self.rank.get
        heap = []
        for i in range(n - 1):
            r = find(sym[i] << _SHIFT | sym[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left, product = n, self.product
        while heap:
            top = heappop(heap)
            i = top & _POS
            j = after[i]
            r = top >> 32
            if j >= n or sym[i] < 0 or find(sym[i] << _SHIFT | sym[j]) != r:
                continue  # an entry that an earlier merge made stale
            made = sym[i] = product[r]
            sym[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = find(made << _SHIFT | sym[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            k = before[i]
            if k >= 0:
                r = find(sym[k] << _SHIFT | made)
                if r is not None:
                    heappush(heap, r << 32 | k)
        return left

    def _part(self, part: str) -> int:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= MEMORY_WORDS:
                self.parts.clear()
            letters = self.letters
            got = self.merge(part if part.isascii() and part.isalnum() else "".join([letters[b] for b in part.encode()]))
            if len(part) <= MEMORY_CHARS:
                self.parts[part] = got
        return got

    def _word(self, word: str) -> int:
        if len(self.words) >= MEMORY_WORDS:
            self.words.clear()
        got = sum([self._part(p) for p in self.pattern.findall(word)])
        if len(word) <= MEMORY_CHARS:
            self.words[word] = got
        return got

    def _slow(self, text: str) -> int:
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        total = 0
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            total += self.merge(piece) if piece else 0
        return total

    def _segment(self, text: str) -> int:
        if not self.by_words or PLAIN_ONLY.search(text):
            return self._slow(text)
        total, find, new = 0, self.words.get, self._word
        for word in text.lower().split():
            got = find(word)
            total += new(word) if got is None else got
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings in it count as one token each."""
        if self.special_split is not None and any(s in text for s in self.specials):
            parts = self.special_split.split(text)
            return len(parts) - 1 + sum(self._segment(p) for p in parts if p)
        return self._segment(text) if text else 0


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def bpe_token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Count the tokens of every whole text.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (more tokens than ``limit``), one row per input row. A null text counts as
    empty: 0 bytes and 0 tokens. A null id is kept as null. Repeated rows give
    repeated results, an empty table an empty one, and other columns of the
    input, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in batches:
            sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            tokens = [count(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
