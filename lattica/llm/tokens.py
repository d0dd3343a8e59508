"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens that a task has not met yet are held together as one flat array of symbols. In each round
every pre-token finds its own lowest-ranked adjacent pair, all of them are merged at once, and merged
symbols are squeezed out; what survives when no pair has a rank is the number of tokens. Pre-tokens that
are not done after ROUNDS rounds are long: they go on together, rank by rank, and only the pairs beside a
merged one are ranked anew, so a word of any length takes n log n steps.

Cases: null text is empty and has no tokens; special strings count one token each, as the library
takes them by default; repeated rows are counted each; texts and words of any length are counted whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import documents, each_slice

#: Tokens above which a document counts as too long.
LIMIT = 2048
#: Words whose counts a task keeps; a fuller memory starts anew.
REMEMBERED = 400_000
TOKENIZER = "word_bpe_49k.json"
#: Rounds over all symbols before the rest is merged through its ranks.
ROUNDS = 48

#: White space as the tokenizer's own patterns read it, and its pre-token pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
_SPACES = regex.compile(f"[{SPACE}]+")
_PRE = regex.compile(PRE_TOKEN)
#: str.split() also splits at these, which are no white space here.
_ODD = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next code from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with an end-of-word suffix, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]) or "(?!)")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (non-empty, lower case)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), size)
        sym = self.inner[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[flat[ends]]
        out = size.copy()
        none = len(self.keys)
        for _ in range(ROUNDS):
            if len(sym) < 2:
                return out
            key = sym[:-1] * self.base + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            # The last symbol of an owner starts no pair; its place holds the pair with the next owner, which has no rank.
            least = np.minimum.reduceat(np.r_[rank, none], begin)
            best = np.repeat(least, np.diff(np.r_[begin, len(sym)]))[:-1]
            hit = (rank == best) & (rank < none)
            if not hit.any():
                return out
            # Of overlapping occurrences (a a a) every second one counts, from the left.
            chain = hit & np.r_[False, hit[:-1]]
            place = np.arange(len(hit))
            since = place - np.maximum.accumulate(np.where(hit & ~chain, place, 0))
            where = np.flatnonzero(hit & (since % 2 == 0))
            sym[where] = self.made[rank[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            # Pre-tokens without a merge are final: they leave with their counts.
            alive = np.repeat(least < none, np.diff(np.r_[begin, len(sym)]))
            out -= np.bincount(owner[where], minlength=len(out))
            stay &= alive
            sym, owner = sym[stay], owner[stay]
        self._finish(sym, owner, out)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def _finish(self, sym: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Merge what is left, all pre-tokens together, in the order of ranks; ``out`` gets the final counts.

        Symbols form linked lists. A pair is known by its place among the sorted keys; pairs that
        changed since they were listed are passed over.
        """
        n = len(sym)
        if n < 2:
            return
        same = owner[1:] == owner[:-1]
        after = np.r_[np.where(same, np.arange(1, n), -1), -1]
        before = np.r_[-1, np.where(same, np.arange(n - 1), -1)]
        alive, flag = np.ones(n, bool), np.zeros(n + 1, bool)  # the last flag stands for no symbol
        pair = np.full(n, -1, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def listed(places: np.ndarray) -> None:
            has = after[places] >= 0
            pair[places[~has]] = -1
            places = places[has]
            found = self._ranks(sym[places], sym[after[places]])
            pair[places] = found
            places, found = places[found >= 0], found[found >= 0]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            edge = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True]).tolist() if len(found) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                rank = int(self.ranks[found[a]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(places[a:b])

        listed(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (pair[places] >= 0)]
            places = places[self.ranks[pair[places]] == rank]
            if not len(places):
                continue
            flag[places] = True
            follows = flag[before[places]]
            flag[places] = False
            at = np.arange(len(places))
            places = places[(at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0]
            gone = after[places]
            sym[places] = self.made[rank]
            alive[gone] = False
            behind = after[gone]
            after[places] = behind
            before[behind[behind >= 0]] = places[behind >= 0]
            left = before[places]
            listed(np.unique(np.r_[places, left[left >= 0]]))
        out -= np.bincount(owner[~alive], minlength=len(out))

    def learn(self, chunks: list[str]) -> None:
        """Counts of chunks without white space; pre-tokens not met before are merged in one batch."""
        parts = [_PRE.findall(c) for c in chunks]
        known = self.parts
        if new := list({p for ps in parts for p in ps if p not in known}):
            known.update(zip(new, self.merge(new).tolist(), strict=True))
        self.known.update((c, sum(map(known.__getitem__, ps))) for c, ps in zip(chunks, parts, strict=True))

    def chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters change case one by one, so no final sigma
        text = text.lower()
        return [c for c in _SPACES.split(text) if c] if _ODD.search(text) else text.split()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Between calls, memories that have grown too large start anew."""
        for memory in (self.known, self.parts):
            if len(memory) > REMEMBERED:
                memory.clear()
        pieces = [self.special.split(t) if "<" in t else [t] for t in texts]
        split = [[c for p in ps for c in self.chunks(p)] if len(ps) > 1 else self.chunks(ps[0]) for ps in pieces]
        known = self.known
        if new := list({c for cs in split for c in cs if c not in known}):
            self.learn(new)
        return [sum(map(known.__getitem__, cs)) + len(ps) - 1 for cs, ps in zip(split, pieces, strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """Read once a Python worker."""
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; ``path`` must be readable on the executors."""

    def make():
        bpe = vocabulary(path)
        return lambda texts: [(len(t.encode("utf-8", "surrogatepass")), n, n > limit) for t, n in zip(texts, bpe.count(texts), strict=True)]

    return each_slice(docs, make, "n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
