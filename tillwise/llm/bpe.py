"""Rank-synchronous merging of byte-pair symbols over ragged numpy arrays."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: distinct words whose ids a task remembers; beyond, the older half goes, so memory is bounded
TABLE_WORDS = 400_000
#: below this code point every character is its own composed form, and Python's lower case and
#: character classes agree with the tokenizer library's, so its slower path is spared
SIMPLE = 0x250

_BEYOND = re.compile(f"[^\\x00-{chr(SIMPLE - 1)}]")
_BLANKS = "\t\n\x0b\x0c\r\x85\xa0"
_KIND = {k: "".join(re.escape(chr(c)) for c in range(SIMPLE) if unicodedata.category(chr(c))[0] == k) for k in "LN"}


class PairRanks:
    """Open-addressing table from a pair of symbol ids to its merge rank and the id it makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, width: int):
        self.width, self.made = width, np.append(made, -1)
        keys = left * width + right
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, len(made), dtype=np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.rank[slot] = key, rank
        self.none = len(made)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        keys = left * self.width + right
        slot = self._slot(keys)
        seen = self.keys[slot]
        rank = np.where(seen == keys, self.rank[slot], self.none)
        rest = np.flatnonzero((seen != keys) & (seen != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            seen = self.keys[slot[rest]]
            rank[rest] = np.where(seen == keys[rest], self.rank[slot[rest]], self.none)
            rest = rest[(seen != keys[rest]) & (seen != -1)]
        return rank


def merge_lowest(symbols: np.ndarray, owner: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge the sequences in `symbols` (int64 ids; `owner` ascending names each id's sequence) to the end.

    In each round every sequence looks at the ranks of its adjacent pairs and merges all occurrences of its
    lowest-ranked pair at once, left to right. Sequences that are done leave the working arrays. Ranks are
    looked up anew only beside a merge."""
    none = pairs.none
    done_symbols, done_owner = [], []
    rank = np.full(len(symbols), none, dtype=np.int64)
    if len(symbols) > 1:
        rank[:-1] = np.where(owner[:-1] == owner[1:], pairs.of(symbols[:-1], symbols[1:]), none)
    while len(symbols):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(first, len(symbols)))
        lowest = np.repeat(np.minimum.reduceat(rank, first), size)
        live = lowest < none
        if not live.all():
            done_symbols.append(symbols[~live])
            done_owner.append(owner[~live])
            symbols, owner, rank, lowest = symbols[live], owner[live], rank[live], lowest[live]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == lowest)
        # a run of touching hits (as in "aaa") merges every other one, from its left end
        run = np.append(True, np.diff(at) != 1)
        if not run.all():
            begin = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
        symbols[at] = pairs.made[rank[at]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        spot = at - np.arange(len(at))  # where the merged symbols stand once the right halves are gone
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        beside = np.zeros(len(symbols), dtype=bool)
        beside[spot] = True
        beside[spot[spot > 0] - 1] = True
        look = np.flatnonzero(beside)
        tail = look == len(symbols) - 1
        rank[look[tail]] = none
        look = look[~tail]
        rank[look] = np.where(owner[look] == owner[look + 1], pairs.of(symbols[look], symbols[look + 1]), none)
    if not done_symbols:
        return symbols, owner
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return symbols[order], owner[order]


class WordEncoder:
    """Ids of whole texts for a tokenizer file whose words end in a suffix and never hold white space.

    The file's normalizer and pre-tokenizer rules give the pre-tokens; merging is done here. The ids of
    each distinct word are kept as bytes of unsigned 16-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[f(a, b)] for a, b in merges], dtype=np.int64)
                             for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
        self.pairs = PairRanks(left, right, made, len(vocab))
        self.inner, self.last = np.full(256, -1, dtype=np.int64), np.full(256, -1, dtype=np.int64)
        for byte, sign in enumerate(byte_signs()):
            self.inner[byte], self.last[byte] = vocab.get(sign, -1), vocab.get(sign + suffix, -1)
        self.sign_byte = {sign: byte for byte, sign in enumerate(byte_signs())}
        rule = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        simple = rule.replace("[\\p{L}]", f"[{_KIND['L']}]").replace("\\p{L}", _KIND["L"]).replace("[\\p{N}]", f"[{_KIND['N']}]")
        self.rule = re.compile(simple.replace("\\p{N}", _KIND["N"]).replace("\\s", " ") + "| ")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of the words' pre-tokens, each pre-token's length in bytes, and its word."""
        text = " ".join(words)
        if not _BEYOND.search(text):
            found = self.rule.findall(text)
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[np.append(0, np.cumsum(size))]
            blank = data[at[:-1]] == 0x20
            return data[np.repeat(~blank, np.diff(at))], np.diff(at)[~blank], np.cumsum(blank)[~blank]
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        size = np.fromiter((len(p) for p, _ in found), dtype=np.int64, count=len(found))
        data = np.fromiter((self.sign_byte[c] for p, _ in found for c in p), dtype=np.uint8, count=int(size.sum()))
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        begin = np.fromiter((o[0] for _, o in found), dtype=np.int64, count=len(found))
        return data, size, np.searchsorted(starts, begin, side="right") - 1

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of each normalized word, as bytes of uint16."""
        data, size, word = self._pieces(words)
        if not len(size):
            return [b""] * len(words)
        end = np.cumsum(size) - 1
        symbols = self.inner[data]
        symbols[end] = self.last[data[end]]
        symbols, owner = merge_lowest(symbols, np.repeat(np.arange(len(size)), size), self.pairs)
        cut = (np.searchsorted(word[owner], np.arange(len(words) + 1)) * 2).tolist()
        ids = symbols.astype("<u2").tobytes()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def normalized(self, text: str) -> list[str]:
        """The words of the normalized text."""
        if _BEYOND.search(text):
            return self.tokenizer.normalizer.normalize_str(text).split(" ")
        for blank in _BLANKS:
            if blank in text:
                text = text.replace(blank, " ")
        return text.lower().split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as bytes of little-endian uint16; new words of all texts are merged together."""
        parts: list[list[list[str] | bytes]] = []
        for text in texts:
            row: list[list[str] | bytes] = []
            for part in self.split.split(text) if "<|" in text else (text,):
                if part in self.special:
                    row.append(np.array([self.special[part]], dtype="<u2").tobytes())
                elif part:
                    row.append(self.normalized(part))
            parts.append(row)
        if len(self.table) > TABLE_WORDS // 2:
            self.older, self.table = self.table, {}
        used = set().union(*(p for row in parts for p in row if isinstance(p, list)))
        fresh = used.difference(self.table)
        known = fresh.intersection(self.older)
        self.table.update(zip(known, map(self.older.__getitem__, known)))
        fresh.difference_update(known)
        odd = {w for w in fresh if not w.isascii() and _BEYOND.search(w)}
        for some in (list(fresh - odd), list(odd)):
            if some:
                self.table.update(zip(some, self.segment(some)))
        find = self.table.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(find, p)) for p in row) for row in parts]


def byte_signs() -> list[str]:
    """The visible sign that byte-level vocabularies use for each byte: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
