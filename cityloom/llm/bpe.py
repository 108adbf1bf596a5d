"""Byte-pair encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so a word may be cut
there for certain. The fragments of many words are encoded side by side, each on its own, and their ids concatenated.
Words repeat far more often than texts, so each task keeps the ids of those it has met in a memo of bounded size. The memo
is searched by a hash, and every word found there is compared letter by letter; one that only shares the hash is encoded
by itself.

Null texts count as empty. An empty text has no tokens and decodes to an empty text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import slices

#: Letters of the words whose ids a task remembers (ids are no more), and slots of the pair table: both fixed, whatever the data.
MEMO = 6_000_000
TABLE = 1 << 18
TABLE_SHIFT, TABLE_MASK, SPREAD = np.uint32(14), np.uint32(TABLE - 1), np.uint32(0x9E3779B1)
SLICE = 4 << 20
#: Words compared with the memo at a time.
AT_ONCE = 1 << 16
NEVER = np.int32(2**31 - 1)
#: Below this the characters are precomposed, and Python and the tokenizer agree on letters, digits and lower case.
PLAIN_BELOW = 0x180


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


SPACE, LETTER, DIGIT, OTHER = range(4)


def _plain_tables() -> tuple[np.ndarray, np.ndarray, re.Pattern]:
    """Kind and lower case of each plain character, and a pattern that finds any other one."""
    chars = [chr(c) for c in range(PLAIN_BELOW)]
    kinds = [SPACE if c in "\t\n\v\f\r \x85\xa0" else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER) for c in chars]
    lower = [ord(c.lower()) if len(c.lower()) == 1 else 0 for c in chars]
    return np.array(kinds, np.uint8), np.array(lower, np.uint32), re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]|İ")


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, …`` of every run, one run after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from the JSON text of a ``tokenizers`` file."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        model, alphabet = parts["model"], byte_alphabet()
        self.spec = spec
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.special = {k: int(v).to_bytes(4, "little") for k, v in added.items()}
        self.is_special = re.compile("|".join(map(re.escape, added))) if added else None
        self.tokens = [""] * (max([*self.vocab.values(), *added.values()]) + 1)
        for token, i in (self.vocab | added).items():
            self.tokens[i] = token
        self.joined = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = [alphabet[c] for c in token.removesuffix(self.end)]
            self.joined[body[:-1], body[1:]] = True
        self.single, self.single_end = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
        for char, byte in alphabet.items():
            self.single[byte], self.single_end[byte] = self.vocab[char], self.vocab[char + self.end]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.product = np.array([self.vocab[x + y] for x, y in merges], np.uint32)
        self.slot_key, self.slot_rank = np.zeros(TABLE, np.uint32), np.full(TABLE, NEVER, np.int32)
        for rank, (x, y) in enumerate(merges):
            key = self.vocab[x] << 16 | self.vocab[y]
            slot = (key * int(SPREAD) & 0xFFFFFFFF) >> int(TABLE_SHIFT)
            while self.slot_rank[slot] != NEVER:
                slot = (slot + 1) % TABLE
            self.slot_key[slot], self.slot_rank[slot] = key, rank
        self.kinds, self.lower, self.other = _plain_tables()
        spread = np.random.default_rng(7)
        self.letter_hash = spread.integers(0, 2**64, PLAIN_BELOW, np.uint64)
        self.forget()
        self.slow = None

    def forget(self) -> None:
        """An empty memo: of each word its hash, where its ids and letters lie, and how many they are."""
        self.memo_hash, self.memo_ids, self.memo_letters = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.memo_start, self.memo_count, self.memo_at, self.memo_size = (np.zeros(0, np.int64) for _ in range(4))

    def encode_points(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that begin at ``starts``, and how many each has; all letters are plain ones."""
        chars = points[ragged(starts, sizes)]
        wide = chars >= 0x80
        ends = np.cumsum(1 + wide)
        flat = np.zeros(ends[-1], np.uint8)
        flat[ends - 1] = np.where(wide, 0x80 | chars & 0x3F, chars)
        flat[ends[wide] - 2] = 0xC0 | chars[wide] >> np.uint32(6)
        return self.encode_words(flat, ends[np.cumsum(sizes) - 1])

    def others(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The words that are not those of the memo's ``rows``, though their hashes are."""
        wrong = self.memo_size[rows] != sizes
        for i in range(0, len(starts), AT_ONCE):
            part = np.arange(i, min(i + AT_ONCE, len(starts)))
            part = part[~wrong[part]]
            if len(part):
                apart = points[ragged(starts[part], sizes[part])] != self.memo_letters[ragged(self.memo_at[rows[part]], sizes[part])]
                if apart.any():
                    wrong[part[np.unique(np.searchsorted(np.cumsum(sizes[part]), np.flatnonzero(apart), side="right"))]] = True
        return np.flatnonzero(wrong)

    def encode_words(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose bytes lie end to end, and how many each has: cut into fragments at word ends and forced pairs."""
        begins = np.zeros(len(flat), bool)
        begins[0] = True
        begins[ends[:-1]] = True
        begins[1:] |= ~self.joined[flat[:-1], flat[1:]]
        symbols = self.single[flat]
        symbols[ends - 1] = self.single_end[flat[ends - 1]]
        ids, counts = self.merge(symbols, np.flatnonzero(begins))
        upto = np.cumsum(counts)[np.cumsum(begins)[ends - 1] - 1]
        return ids, np.diff(upto, prepend=0)

    def ranks(self, symbols: np.ndarray) -> np.ndarray:
        """The merge rank of each symbol with the one after it, by open addressing."""
        keys = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        slot = (keys * SPREAD) >> TABLE_SHIFT
        found = self.slot_rank[slot]
        todo = np.flatnonzero((self.slot_key[slot] != keys) & (found != NEVER))
        found[todo] = NEVER
        while len(todo):
            slot[todo] = (slot[todo] + np.uint32(1)) & TABLE_MASK
            here = slot[todo]
            same, free = self.slot_key[here] == keys[todo], self.slot_rank[here] == NEVER
            found[todo[same]] = self.slot_rank[here[same]]
            todo = todo[~(same | free)]
        return found

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments in their order, and how many each has: in each, the lowest-ranked pair is joined first.

        One round joins the best pair of every fragment that still has one, wherever it occurs without overlap.
        """
        sizes = np.diff(np.append(starts, len(symbols)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        done_ids, done_owner = [], []
        while len(symbols):
            rank = np.full(len(symbols), NEVER, np.int32)
            rank[:-1] = self.ranks(symbols)
            rank[:-1][owner[1:] != owner[:-1]] = NEVER
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(symbols))))
            over = best == NEVER
            if over.any():
                done_ids.append(symbols[over])
                done_owner.append(owner[over])
                going = ~over
                symbols, owner, rank, best = symbols[going], owner[going], rank[going], best[going]
                if not len(symbols):
                    break
            hit = rank == best
            twice = hit[1:] & hit[:-1]
            if twice.any():  # one symbol three times or more in a row: join from the left
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
                hit &= (place - run) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.product[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        ids, owners = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(starts))

    def words(self, text: str) -> list[str]:
        """Normalized words of any text, by the tokenizer's own normalizer and splitter."""
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.spec)
        normal = self.slow.normalizer.normalize_str(text)
        back = byte_alphabet()
        return [bytes(back[c] for c in w).decode() for w, _ in self.slow.pre_tokenizer.pre_tokenize_str(normal)]

    def _other(self, text: str) -> np.ndarray:
        """Ids of a text with characters beyond the plain ones."""
        words = [w.encode() for w in self.words(text)]
        if not words:
            return np.zeros(0, np.uint32)
        return self.encode_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))[0]

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case code points of a plain text without white space, where words begin in them, and at which place of the text."""
        points = np.frombuffer(text.encode("utf-32-le") + bytes(12), np.uint32)
        kind, low = self.kinds[points], self.lower[points]
        kind[-3:] = SPACE
        begin = (kind != SPACE) & ((kind != np.append(SPACE, kind[:-1])) | (kind == DIGIT))
        mark = np.flatnonzero((points == ord("'")) & begin)
        mark = mark[kind[mark + 1] == LETTER]
        one, two = low[mark + 1], low[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in ("re", "ve", "ll")])
        begin[mark[short | long] + 1] = False
        after = np.concatenate([mark[short] + 2, mark[long] + 3])
        begin[after[kind[after] == LETTER]] = True
        solid = kind != SPACE
        return low[solid], np.flatnonzero(begin[solid]), np.flatnonzero(begin)

    def _plain(self, texts: list[str]) -> list[bytes]:
        points, starts, places = self._tokens("\n".join(texts))
        if not len(starts):
            return [b""] * len(texts)
        sizes = np.diff(np.append(starts, len(points)))
        power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        inside = np.arange(len(points), dtype=np.int64) - np.repeat(starts, sizes)
        hashes = np.add.reduceat(self.letter_hash[points] * power[inside], starts)
        del inside
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.memo_hash, unique)
        known = at < len(self.memo_hash)
        known[known] = self.memo_hash[at[known]] == unique[known]
        if not known.all():
            if len(self.memo_letters) > MEMO:
                self.forget()
                known[:] = False
            new = first[~known]
            ids, counts = self.encode_points(points, starts[new], sizes[new])
            hashed = np.concatenate([self.memo_hash, unique[~known]])
            order = np.argsort(hashed)
            self.memo_start = np.concatenate([self.memo_start, len(self.memo_ids) + np.cumsum(counts) - counts])[order]
            self.memo_count = np.concatenate([self.memo_count, counts])[order]
            self.memo_at = np.concatenate([self.memo_at, len(self.memo_letters) + np.cumsum(sizes[new]) - sizes[new]])[order]
            self.memo_size = np.concatenate([self.memo_size, sizes[new]])[order]
            self.memo_ids = np.concatenate([self.memo_ids, ids])
            self.memo_letters = np.concatenate([self.memo_letters, points[ragged(starts[new], sizes[new])].astype(np.uint16)])
            self.memo_hash = hashed[order]
            at = np.searchsorted(self.memo_hash, unique)
        rows = at[which]
        begin, counts, held = self.memo_start[rows], self.memo_count[rows], self.memo_ids
        alone = self.others(points, starts, sizes, rows)
        if len(alone):
            ids, own = self.encode_points(points, starts[alone], sizes[alone])
            begin[alone], counts[alone] = len(held) + np.cumsum(own) - own, own
            held = np.concatenate([held, ids])
        raw = held[ragged(begin, counts)].astype("<u4").tobytes()
        upto = np.append(0, np.cumsum(counts))
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bound = (4 * upto[np.searchsorted(places, edges)]).tolist()
        return [raw[x:y] for x, y in zip(bound, bound[1:])]

    def _stretches(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, text in enumerate(texts) if not text.isascii() and self.other.search(text)]
        if not odd:
            return self._plain(texts)
        skip = set(odd)
        out = self._plain(["" if i in skip else t for i, t in enumerate(texts)]) if len(odd) < len(texts) else [b""] * len(texts)
        for i in odd:
            out[i] = self._other(texts[i]).astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Special tokens written out in a text are their ids."""
        texts = [t or "" for t in texts]
        if not any(token in text for token in self.special for text in texts):
            return self._stretches(texts)
        out = []
        for text in texts:
            found = list(self.is_special.finditer(text))
            between = self._stretches([text[x:y] for x, y in zip([0, *(f.end() for f in found)], [*(f.start() for f in found), len(text)])])
            out.append(b"".join([*(x + self.special[f[0]] for x, f in zip(between, found)), between[-1]]))
        return out

    def decode(self, ids: list[bytes | None]) -> list[str]:
        """The tokens of each row with a space between: this vocabulary comes without a decoder."""
        token = self.tokens.__getitem__
        return [" ".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (a few MB, whatever the data) for every executor."""
    return spark.sparkContext.broadcast(Path(path).read_text())


def encode(docs: DataFrame, vocab: Broadcast, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as bytes in the new column ``to``, in one pass over whole texts."""
    return _added(docs, text, to, "binary", lambda: WordBpe(vocab.value).encode)


def decode(docs: DataFrame, vocab: Broadcast, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for in the new column ``to``."""
    return _added(docs, ids, to, "string", lambda: WordBpe(vocab.value).decode)


def _added(docs: DataFrame, column: str, to: str, kind: str, make) -> DataFrame:
    """``docs`` with one more column, the function's value for each row's ``column``; a column of that name is replaced."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != to])
    schema = StructType([*kept.schema.fields, StructField(to, StringType() if kind == "string" else BinaryType())])
    arrow = {"binary": pa.binary(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, column, SLICE):
            values = work(part.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow)], names=[*part.schema.names, to])

    return kept.mapInArrow(run, schema)
