"""Token counts by heap-and-linked-list byte-pair merging, without token ids.

A word's bytes are a linked list of symbols. A heap holds the rank of every adjacent pair that the vocabulary merges; the
lowest rank, and the leftmost of equals, is popped, the pair becomes one symbol, and the pairs it makes with its
neighbours are pushed. What is popped but no longer there is skipped. When the heap is empty the word has as many tokens
as it had bytes less the merges done. A word of n bytes takes some n log n steps, so one word may be as long as a text.

Every text is counted whole in its own row, without a shuffle. Words of up to ``SHORT`` characters are remembered, up to
``MEMO`` of them, which bounds what a task holds beside one slice of texts; longer words are merged anew each time.

Null texts count as empty. Empty texts have no bytes and no tokens. Rows that repeat are counted each. Special tokens
written out in a text count one each, as the library counts them. Columns of ``docs`` named like a new one are replaced,
all others are kept whatever their names.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType

from .bpe import byte_alphabet
from .common import extended

LIMIT = 1024
MEMO, SHORT = 500_000, 64
#: Words taken from a text at a time, and the length from which a text's words are taken so.
RUN, LONG = 1 << 18, 1 << 20
#: Fixed value: how byte-level vocabularies of this kind split a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters alone, spelled out for the quicker of two expression engines.
LATIN = "\x00-\u02af"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u02af", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Characters beyond these may be letters to one Unicode version and unassigned to another: such texts are split by the library.
STABLE = "\x00-\u0557\u2010-\u2064\u20a0-\u20c0\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff"


class TokenCounter:
    """Counts the tokens of texts under a byte-level vocabulary, read from the JSON text of a ``tokenizers`` file."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        splitter, model = parts["pre_tokenizer"], parts["model"]
        if parts["normalizer"] or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without normalizer and prefix space are counted")
        self.spec, self.splitter = spec, None
        vocab = model["vocab"]
        self.first = [0] * 256
        for char, byte in byte_alphabet().items():
            self.first[byte] = vocab[char]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocab[x] << 32 | vocab[y]: r for r, (x, y) in enumerate(merges)}
        self.product = [vocab[x + y] for x, y in merges]
        special = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.word, self.unstable = regex.compile(WORD), re.compile(f"[^{STABLE}]")
        self.latin_word, self.foreign = re.compile(LATIN_WORD), re.compile(f"[^{LATIN}]")
        self.memo: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """How many symbols are left of ``word`` when no adjacent pair can be merged."""
        n = len(word)
        symbol, after, before = [self.first[b] for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
        rank, product = self.rank.get, self.product
        heap = [r * n + i for i in range(n - 1) if (r := rank(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            lowest, i = divmod(heappop(heap), n)
            j = after[i]
            if symbol[i] < 0 or j == n or rank(symbol[i] << 32 | symbol[j]) != lowest:
                continue  # merged away since it was pushed
            merges += 1
            symbol[i], symbol[j] = product[lowest], -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank(symbol[i] << 32 | symbol[k])) is not None:
                    heappush(heap, r * n + i)
            if h >= 0 and (r := rank(symbol[h] << 32 | symbol[i])) is not None:
                heappush(heap, r * n + h)
        return n - merges

    def _words(self, text: str):
        """The words of ``text`` in runs, each with how often it occurs in the run."""
        word = self.latin_word
        if not text.isascii() and self.foreign.search(text):
            word = self.word
        if word is self.word and self.unstable.search(text):
            if self.splitter is None:
                from tokenizers import Tokenizer

                self.splitter = Tokenizer.from_str(self.spec).pre_tokenizer
            yield Counter(text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text))
        elif len(text) < LONG:
            yield Counter(word.findall(text))
        else:
            found = word.finditer(text)
            while run := Counter(m[0] for m in islice(found, RUN)):
                yield run

    def count(self, text: str) -> int:
        """Tokens of one text."""
        if self.special is not None and (parts := self.special.split(text))[1:]:
            return len(parts) - 1 + sum(map(self.count, parts))
        memo, total = self.memo, 0
        for run in self._words(text):
            for word, times in run.items():
                tokens = memo.get(word)
                if tokens is None:
                    tokens = self.merged(word.encode())
                    if len(word) <= SHORT:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[word] = tokens
                total += times * tokens
        return total


def counts(docs: DataFrame, vocab: Broadcast, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``, which says that there are more than ``limit`` tokens."""

    def make():
        counter = TokenCounter(vocab.value)

        def work(texts: list[str | None]) -> list[list]:
            tokens = [counter.count(t or "") for t in texts]
            return [[len((t or "").encode()) for t in texts], tokens, [n > limit for n in tokens]]

        return work

    return extended(docs, text, {"n_bytes": (LongType(), pa.int64()), "n_tokens": (LongType(), pa.int64()), "over_limit": (BooleanType(), pa.bool_())}, make)
