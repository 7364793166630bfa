"""Byte-level BPE by rank-synchronous array merging.

Pre-tokens wait in a batch as one ragged numpy array of symbols. Each round looks up the rank of every adjacent pair,
takes the lowest rank of each sequence, and replaces all places of that pair in all sequences at once; sequences
without a mergeable pair leave the batch. Merges are learnt in order of rank, so a pair that holds a merged symbol always
ranks after the merge that made the symbol, and replacing every place of the lowest pair at once gives the same symbols as
replacing them one by one. Pre-tokens repeat, so results are kept in a bounded dictionary of each worker.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable

import numpy as np
import regex
import tiktoken

#: Fixed value: how byte-level vocabularies of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's dictionary; beyond it the dictionary starts anew.
KEEP = 400_000
_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary file of the `tokenizers` library (.json, byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path} has added tokens that take more than their own text")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(self.size, *(i + 1 for i in special.values())) if special else self.size
        self.special = special
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.bytes_of = np.zeros(256, np.int64)
        for char, b in byte_alphabet().items():
            self.bytes_of[b] = vocab[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        self.slots = 1 << max(4, (8 * len(keys)).bit_length())
        self.pairs, self.ranks, self.made = self._table(keys, made)
        self.split = regex.compile(SPLIT)
        self._vocab = vocab

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def _table(self, keys: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An open hash table of the pairs with linear probing, as arrays."""
        pairs = np.full(self.slots, -1, np.int64)
        ranks, result = np.full(self.slots, _NONE, np.int32), np.zeros(self.slots, np.int64)
        for rank, slot in enumerate(self._slot(keys).tolist()):
            while pairs[slot] >= 0:
                slot = (slot + 1) % self.slots
            pairs[slot], ranks[slot], result[slot] = keys[rank], rank, made[rank]
        return pairs, ranks, result

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair, or an empty one."""
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.pairs[slot] != keys) & (self.pairs[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.slots
            there = self.pairs[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return slot

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.bytes_of[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        n = len(symbols)
        last = np.ones(n, bool)  # the last symbol of a sequence starts no pair
        last[:-1] = owner[1:] != owner[:-1]
        slot = np.zeros(n, np.int64)
        slot[:-1] = self._look_up(symbols[:-1] * self.size + symbols[1:])
        rank = np.where(last, _NONE, self.ranks[slot])
        done_ids, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, last[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            best = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            live = best != _NONE
            if not live.all():
                rest = ~live
                done_ids.append(symbols[rest])
                done_owner.append(owner[rest])
            hit = np.flatnonzero((rank == best) & live)
            if not len(hit):
                break
            # the pair of a symbol with itself can overlap: in a run of hits every second one counts, from the left
            new_run = np.r_[True, hit[1:] != hit[:-1] + 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbols[hit] = self.made[slot[hit]]
            last[hit] = last[hit + 1]
            keep = live
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, last, rank, slot = symbols[keep], owner[keep], last[keep], rank[keep], slot[keep]
            hit = place[hit]
            before = hit[hit > 0] - 1
            changed = np.concatenate([hit, before[~last[before]]])
            open_ = changed[~last[changed]]
            slot[open_] = self._look_up(symbols[open_] * self.size + symbols[open_ + 1])
            rank[changed] = np.where(last[changed], _NONE, self.ranks[slot[changed]])
        if not done_ids:
            return symbols, np.zeros(len(words), np.int64)
        ids, of = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def ranks_by_bytes(self) -> dict[bytes, int]:
        """Token bytes to ids, for a merger that takes ids as ranks; merges must be numbered in their order."""
        byte_of = byte_alphabet()
        made = self.made[self.pairs >= 0][np.argsort(self.ranks[self.pairs >= 0])]
        if not (np.diff(made) > 0).all():
            raise ValueError("ids of merges don't follow their ranks")
        return {bytes(byte_of[c] for c in token): i for token, i in self._vocab.items() if token not in self.special}

    def parts(self, text: str) -> Iterable[tuple[str, int | None]]:
        """The text between special strings, and after each such part the id of the special string that follows it."""
        if self.special_at is None or not self.special_at.search(text):
            yield text, None
            return
        start = 0
        for m in self.special_at.finditer(text):
            yield text[start : m.start()], self.special[m[0]]
            start = m.end()
        yield text[start:], None


class Cache(dict):
    """Texts to what `make` gives for them; make takes many at once. Two generations bound it: the older one goes when the
    younger is full, and what is still in use moves over."""

    def __init__(self, make: Callable[[list[str]], Iterable]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def learn(self, words: set[str]) -> None:
        if len(self) > KEEP:
            self.old = dict(self)
            self.clear()
        new = words.difference(self)
        known = new.intersection(self.old)
        self.update((w, self.old[w]) for w in known)
        rest = list(new - known)
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            self.update(zip(some, self.make(some)))


@functools.cache
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.cache
def _counts(path: str) -> Cache:
    bpe = vocabulary(path)
    return Cache(lambda words: bpe.merge([w.encode() for w in words])[1].tolist())


def id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if vocabulary(path).size <= 1 << 16 else "<u4")


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """How many ids each text has: its pre-tokens' counts, and one for each special string."""
    bpe, counts = vocabulary(path), _counts(path)
    found = [[(bpe.split.findall(part), special) for part, special in bpe.parts(t)] for t in texts]
    counts.learn({w for parts in found for words, _ in parts for w in words})
    get = counts.__getitem__
    return [sum(sum(map(get, words)) + (special is not None) for words, special in parts) for parts in found]


@functools.cache
def _encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=vocabulary(path).ranks_by_bytes(), special_tokens={})


def encode(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text, as bytes of id_type(path).

    Where ids are wanted and not counts, the ranks go to tiktoken's merger, which gives the same ids in less time.
    """
    bpe, kind, ordinary = vocabulary(path), id_type(path), _encoder(path).encode_ordinary
    out = []
    for t in texts:
        ids: list[int] = []
        for part, special in bpe.parts(t):
            ids += ordinary(part)
            if special is not None:
                ids.append(special)
        out.append(np.array(ids, kind).tobytes())
    return out
