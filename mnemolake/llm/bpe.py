"""BPE encoding and decoding: greedy longest matches are proposed, adjacent pairs verified, only failing words merged."""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.registry import query, table

# Code points that the tokenizer does not yet take for letters or numbers, as first and last of each range.
NOT_LETTERS = (
    "558 558 58b 58c 88f 88f c5c c5c cdc cdc 208f 208f 209d 209f a7ce a7cf a7d2 a7d2 a7d4 a7d4 a7dd a7dd a7e2 a7e2 a7f1 a7f1 "
    "ab6c ab6d 107bb 107bf 10940 10959 10ec5 10ec7 10ed9 10eee 11b0a 11b0a 11db0 11ddb 11df1 11df1 16ea0 16eb8 16ebb 16ed3 "
    "16ff2 16ff3 187f8 187ff 18cd6 18cda 18d09 18d20 18d80 18df2 18e00 19191 191a0 191d2 1b123 1b128 1b168 1b168 1d6a6 1d6a6 "
    "1df1f 1df24 1df2b 1df81 1df90 1df96 1dfcd 1dfff 1e6c0 1e6de 1e6e0 1e6e2 1e6e4 1e6e5 1e6e7 1e6ed 1e6f0 1e6f4 1e6fe 1e6ff "
    "2b73a 2b73f 2b81e 2b81e 2cea2 2cead 323b0 33479 3d000 3fc3f"
)
NOT_NUMBERS = "11de0 11de9 1246f 1246f 12475 1247f 12550 12686 16ff4 16ff6"
# First and last capital of a range and its first small letter, where str.lower() may not know them yet.
NEW_CAPITALS = (
    "1c89 1c89 1c8a a7cb a7cb 264 a7cc a7cc a7cd a7ce a7ce a7cf a7d2 a7d2 a7d3 a7d4 a7d4 a7d5 a7da a7da a7db a7dc a7dc 19b "
    "10d50 10d65 10d70 16ea0 16eb8 16ebb"
)


def _codes(text: str, width: int) -> list[tuple[int, ...]]:
    codes = [int(x, 16) for x in text.split()]
    return list(zip(*[codes[i::width] for i in range(width)]))


def _class(text: str) -> str:
    return "[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in _codes(text, 2)) + "]"


# Capitals letter by letter: a final sigma is not a case of its own here.
LOWER = {a + i: small + i for a, z, small in _codes(NEW_CAPITALS, 3) for i in range(z - a + 1)} | {ord("Σ"): "σ"}
LETTER, NUMBER = rf"[\p{{L}}--{_class(NOT_LETTERS)}]", rf"[\p{{N}}--{_class(NOT_NUMBERS)}]"
# Fixed values of the tokenizer's file: what it splits a text into, and the white space that its first step folds.
PIECES = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|[^\s||{LETTER}||{NUMBER}]+")
NOT_PLAIN = regex.compile(r"[^\t-\r -~¡-¬®-ɏ]|<\|")  # beyond Latin letters, or perhaps a special token
BLANK, ALPHA, DIGIT, OTHER = range(4)  # what a plain text's characters are
KINDS = np.full(0x251, OTHER, np.uint8)
KINDS[[*range(9, 14), 32]] = BLANK
KINDS[[i for i in range(0x250) if regex.match(r"\p{L}", chr(i))]] = ALPHA
KINDS[[i for i in range(0x250) if regex.match(r"\p{N}", chr(i))]] = DIGIT
WORD_END = "</w>"
CACHE = 50_000  # entries of a generation of a worker's caches, which keep the one before
PAIRS = 800_000  # verdicts that a worker keeps
NEVER = 1 << 62
ID_BITS, NO_ID = 20, (1 << 20) - 1  # of a token's number; the number that none has
SEGMENT = 1 << 19  # characters that are worked on at a time
BASE = 0x9E3779B97F4A7C15
LONG = 64  # bytes of a word from which on it is merged by a heap at once


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Pairs:
    """Verdicts on pairs of tokens, as sorted codes with the verdict in the last bit: a large array and one of late ones."""

    def __init__(self):
        self.old, self.late = np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _look(held: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not len(held):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(held, codes << 1), len(held) - 1)
        return np.where(held[at] >> 1 == codes, held[at] & 1, -1)

    def look(self, codes: np.ndarray) -> np.ndarray:
        """1: apart, 0: not, -1: unknown."""
        out = self._look(self.old, codes)
        open_ = np.flatnonzero(out < 0)
        out[open_] = self._look(self.late, codes[open_])
        return out

    def learn(self, codes: np.ndarray, verdicts: np.ndarray) -> None:
        self.late = np.sort(np.concatenate([self.late, codes << 1 | verdicts]))
        if len(self.late) > 50_000:
            if len(self.old) > PAIRS:
                self.old = np.empty(0, np.int64)
            self.old, self.late = np.sort(np.concatenate([self.old, self.late]), kind="stable"), np.empty(0, np.int64)


class WordBpe:
    """The vocabulary and merges of a tokenizers JSON file with word-end BPE, lower case and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.vocab: dict[str, int] = held["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in held["model"]["merges"]]
        self.texts = {i: t.encode("utf-8") for i, t in self.names.items()}
        # Rank and merged token of a pair in one number, so that the least number is the pair to merge first.
        self.ranks = {(self.vocab[a], self.vocab[b]): r << 32 | self.vocab[a + b] for r, (a, b) in enumerate(merges)}
        codes = np.array([a << ID_BITS | b for a, b in self.ranks], np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], np.fromiter(self.ranks.values(), np.int64, len(codes))[order]
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab.get(x, NO_ID) for x in letters], np.int64)
        self.final = np.array([self.vocab.get(x + WORD_END, NO_ID) for x in letters], np.int64)
        self._token_tables({x: b for b, x in enumerate(letters)})
        self.apart = Pairs()
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _token_tables(self, byte_of: dict[str, int]) -> None:
        """First symbols of every token as rows, and a trie over the bytes of those tokens that merges really build; others
        are never proposed. Nodes with children have a row of 256 in `step`, the others only a number."""
        names = [t for t in self.vocab if all(x in byte_of for x in t.removesuffix(WORD_END))]
        symbols = [self.symbols(t) for t in names]
        ids = np.array([self.vocab[t] for t in names], np.int64)
        size = np.fromiter(map(len, symbols), np.int64, len(symbols))
        width = int(size.max(initial=1))
        self.first = np.full((max(self.names) + 1, width), NO_ID, np.int64)
        self.first_size = np.zeros(max(self.names) + 1, np.int64)
        rows = np.repeat(ids, size)
        self.first[rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)] = [i for s in symbols for i in s]
        self.first_size[ids] = size
        merged, left = self.merge_rows(self.first[ids], size)
        built = (left == 1) & (merged[:, 0] == ids)
        nodes: dict[bytes, int] = {b"": 0}
        tokens = []
        for name, number, good in zip(names, ids.tolist(), built.tolist()):
            if good:
                ends = name.endswith(WORD_END) and name != WORD_END
                spelled = bytes([byte_of[x] for x in (name.removesuffix(WORD_END) if ends else name)])
                tokens.append((spelled, ends, number))
                for n in range(1, len(spelled) + 1):
                    nodes.setdefault(spelled[:n], len(nodes))
        parents = {p[:-1] for p in nodes if p}
        order = {p: i for i, p in enumerate(sorted(nodes, key=lambda p: p not in parents))}
        root = order[b""]
        self.step = np.full((len(parents), 256), -1, np.int32)
        for p, at in order.items():
            if p:
                self.step[order[p[:-1]], p[-1]] = at
        self.root = root
        self.inside, self.ending = np.full(len(order), NO_ID, np.int64), np.full(len(order), NO_ID, np.int64)
        for spelled, ends, number in tokens:
            (self.ending if ends else self.inside)[order[spelled]] = number

    def symbols(self, token: str) -> list[int]:
        """The first symbols of a token: its letters, the last one with the word end if the token has it. Unknown letters
        give none, as the model has no unknown token."""
        ends = token.endswith(WORD_END) and token != WORD_END
        letters = list(token.removesuffix(WORD_END)) if ends else list(token)
        if ends and letters:
            letters[-1] += WORD_END
        return [self.vocab[x] for x in letters if x in self.vocab]

    def merge(self, symbols: list[int]) -> tuple[int, ...]:
        """Exact merging of one word: the pair of lowest rank first, the leftmost of equal ones."""
        if len(symbols) > LONG:
            return self.merge_long(symbols)
        rows, size = self.merge_rows(np.array([symbols], np.int64), np.array([len(symbols)]))
        return tuple(rows[0, : size[0]].tolist())

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], NEVER)

    def merge_rows(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once, one per row and filled up with NO_ID: each round makes the merge of lowest
        rank, the leftmost of equal ones, in every row that has one. Gives rows and sizes after the last merge."""
        out, left = np.full_like(ids, NO_ID), size.copy()
        rows, held = np.arange(len(ids)), ids
        rank = self.pair_rank(held[:, :-1], held[:, 1:]) if held.shape[1] > 1 else np.empty((len(ids), 0), np.int64)
        while True:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            at = np.arange(len(rows))
            low = rank[at, best] if rank.shape[1] else np.full(len(rows), NEVER)
            done = low == NEVER
            if done.any():
                out[rows[done], : held.shape[1]] = held[done]
                live = ~done
                rows, held, rank, best, low = rows[live], held[live], rank[live], best[live], low[live]
                at = np.arange(len(rows))
            if not len(rows):
                return out, left
            held[at, best] = low & 0xFFFFFFFF
            place = np.arange(held.shape[1] - 1)
            held = np.take_along_axis(held, place + (place > best[:, None]), 1)
            left[rows] -= 1
            place = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, place + (place >= best[:, None]), 1)
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < rank.shape[1])
            rank[before, best[before] - 1] = self.pair_rank(held[before, best[before] - 1], held[before, best[before]])
            rank[after, best[after]] = self.pair_rank(held[after, best[after]], held[after, best[after] + 1])

    def merge_long(self, symbols: list[int]) -> tuple[int, ...]:
        """The same by a heap over a linked list, in time that is not quadratic in the word's length."""
        n = len(symbols)
        ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (found := self.ranks.get((ids[i], ids[i + 1]))) is not None:
                heap.append((found, i, ids[i], ids[i + 1]))
        heapify(heap)
        while heap:
            found, i, a, b = heappop(heap)
            new = found & 0xFFFFFFFF
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (found := self.ranks.get((new, ids[after[i]]))) is not None:
                    heappush(heap, (found, i, new, ids[after[i]]))
            if before[i] >= 0 and (found := self.ranks.get((ids[before[i]], new))) is not None:
                heappush(heap, (found, before[i], ids[before[i]], new))
        return tuple(x for x in ids if x >= 0)

    def propose(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match from the left for words that stand one after the other in `flat`, `ends` being where each
        stops: the places where tokens start, and the tokens (NO_ID for a letter that the vocabulary lacks).

        The longest token at every place is found by all places walking the trie together; then words go from token to
        token together."""
        begins = np.concatenate([[0], ends[:-1]])
        last = np.repeat(ends - 1, ends - begins)
        at, node, depth = np.arange(len(flat)), np.full(len(flat), self.root), 0
        best, size = np.full(len(flat), NO_ID), np.ones(len(flat), np.int64)
        while len(at):
            node = self.step[node, flat[at + depth]]
            good = node >= 0
            at, node = at[good], node[good]
            stops = at + depth == last[at]
            token = np.where(stops, self.ending[node], self.inside[node])
            found = token != NO_ID
            best[at[found]], size[at[found]] = token[found], depth + 1
            more = ~stops & (node < len(self.step))
            at, node, depth = at[more], node[more], depth + 1
        starts, now = np.zeros(len(flat), bool), begins
        while len(now):
            starts[now] = True
            now, ends = now + size[now], ends
            more = now < ends
            now, ends = now[more], ends[more]
        places = np.flatnonzero(starts)
        return places, best[places]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the two tokens' text gives just these two tokens, for all pairs at once. Unknown pairs are merged
        once and remembered."""
        codes = left << ID_BITS | right
        verdict = self.apart.look(codes)
        open_ = verdict < 0
        if open_.any():
            new, back = np.unique(codes[open_], return_inverse=True)
            fresh = self._apart(new)
            self.apart.learn(new, fresh.astype(np.int64))
            verdict[open_] = fresh[back]
        return verdict == 1

    def _apart(self, codes: np.ndarray) -> np.ndarray:
        a, b = codes >> ID_BITS, codes & (1 << ID_BITS) - 1
        size = self.first_size[a] + self.first_size[b]
        ids = np.full((len(codes), int(size.max())), NO_ID)
        for i in range(int(self.first_size[a].max())):
            ids[:, i] = np.where(i < self.first_size[a], self.first[a, i], ids[:, i])
        for i in range(int(self.first_size[b].max())):
            row = np.flatnonzero(i < self.first_size[b])
            ids[row, self.first_size[a[row]] + i] = self.first[b[row], i]
        merged, left = self.merge_rows(ids, size)
        second = merged[:, 1] if merged.shape[1] > 1 else np.full(len(codes), NO_ID)
        return (left == 2) & (merged[:, 0] == a) & (second == b)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of words. A tokenisation whose tokens are all built by merges and whose adjacent pairs are all
        compatible is the merged one; words with a pair that is not are merged exactly, as are very long ones at once."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                found = np.append(self.inner[np.frombuffer(w[:-1], np.uint8)], self.final[w[-1]])
                out[i] = np.array(self.merge(found[found != NO_ID].tolist()), np.int64)
        if not short:
            return out
        flat = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        size = np.array([len(words[i]) for i in short])
        ends = np.cumsum(size)
        places, ids = self.propose(flat, ends)
        owner = np.searchsorted(ends, places, "right")
        real = ids != NO_ID
        ids, owner = ids[real], owner[real]
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.zeros(len(short), bool)
        wrong[owner[pair[~self.compatible(ids[pair], ids[pair + 1])]]] = True
        stops = np.searchsorted(owner, np.arange(len(short)), "right").tolist()
        at = 0
        for i, stop in zip(short, stops):
            out[i] = ids[at:stop]
            at = stop
        for least, most in ((1, 8), (8, 12), (12, 20), (20, LONG)):  # words of like length share rows
            few = np.flatnonzero(wrong & (size > least) & (size <= most))
            if len(few):
                width, begin = size[few], ends[few] - size[few]
                place = np.arange(most)
                inside = place < width[:, None]
                letters = flat[np.where(inside, begin[:, None] + place, 0)]
                rows = np.where(place == width[:, None] - 1, self.final[letters], self.inner[letters])
                rows[~inside] = NO_ID
                if ((rows == NO_ID) & inside).any():  # letters that the vocabulary lacks leave no gap
                    rows = np.take_along_axis(rows, np.argsort(rows == NO_ID, 1, kind="stable"), 1)
                merged, left = self.merge_rows(rows, (rows != NO_ID).sum(1))
                for k, row, n in zip(few.tolist(), merged, left.tolist()):
                    out[short[k]] = row[:n]
        return out

    def pieces(self, text: str) -> list[str | int]:
        """A text as words, and the ids of special tokens in it."""
        out, at = [], 0
        for found in [*(self.splitter.finditer(text) if self.splitter else ()), None]:
            part = text[at : found.start() if found else len(text)]
            out += PIECES.findall(unicodedata.normalize("NFC", part).translate(LOWER).lower())
            if found:
                out.append(self.special[found[0]])
                at = found.end()
        return out

    def look_up(self, words: list[str | int]) -> list[tuple[bytes, bytes]]:
        """Ids (as bytes) and decoded text of distinct words, by way of the cache."""
        if len(self.words) > CACHE:
            self.words, self.older = {}, self.words
        known, older, texts = self.words, self.older, self.texts
        found = list(map(known.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        unknown = []
        for at, held in zip(missing, map(older.get, map(words.__getitem__, missing))):
            word = words[at]
            if held is not None:
                found[at] = known[word] = held
            elif isinstance(word, int):
                found[at] = word.to_bytes(4, "little"), texts[word]
            else:
                unknown.append(at)
        ids = self.encode_words([words[i].encode("utf-8", "surrogatepass") for i in unknown])
        stops = np.cumsum([len(i) for i in ids]).tolist()
        flat = np.concatenate([*ids, np.empty(0, np.int64)])
        packed, names, start = flat.astype("<u4").tobytes(), list(map(texts.__getitem__, flat.tolist())), 0
        for at, stop in zip(unknown, stops):
            found[at] = known[words[at]] = packed[4 * start : 4 * stop], b" ".join(names[start:stop])
            start = stop
        return found

    def encode_texts(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids as little-endian 32-bit numbers, decoded UTF-8) of each whole text; null counts as empty."""
        parts = [(i, part) for i, text in enumerate(texts) for part in segments(text or "")]
        plain = [not NOT_PLAIN.search(part) for _, part in parts]
        found: list[tuple[bytes, bytes]] = [(b"", b"")] * len(parts)
        group, size = [], 0
        for at, (_, part) in enumerate(parts):
            if plain[at]:
                group.append(at)
                size += len(part)
            if group and (size > SEGMENT or at + 1 == len(parts)):
                for k, own in zip(group, self._plain([parts[k][1].lower() for k in group])):
                    found[k] = own
                group, size = [], 0
        for at, own in zip(other := [k for k, is_plain in enumerate(plain) if not is_plain], self._any([parts[k][1] for k in other])):
            found[at] = own
        held: list[list[tuple[bytes, bytes]]] = [[] for _ in texts]
        for (i, _), own in zip(parts, found):
            held[i].append(own)
        packed = [b"".join([ids for ids, _ in own]) for own in held]
        return [(len(p) // 4, p, b" ".join([d for _, d in own if d])) for p, own in zip(packed, held)]

    def _any(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        number: defaultdict[str | int, int] = defaultdict(count().__next__)
        numbered = [np.fromiter(map(number.__getitem__, self.pieces(t)), np.int64) for t in texts]
        names = np.concatenate([*numbered, np.empty(0, np.int64)])
        return _joined(self.look_up(list(number)), names, np.array([len(n) for n in numbered], np.int64))

    def _plain(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Plain texts in lower case, as arrays throughout; only words that differ become objects."""
        whole = "\n".join([*texts, ""])
        chars = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        start, end = word_spans(chars)
        first, name = distinct(chars, start, end)
        words = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        stops = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        return _joined(self.look_up(words), name, np.diff(stops, prepend=0))


def segments(text: str) -> list[str]:
    """A text in pieces of about SEGMENT characters that end before a space; most texts are one."""
    out, at = [], 0
    while len(text) - at > SEGMENT and (stop := text.find(" ", at + SEGMENT)) >= 0:
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:] if at else text]


def word_spans(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of plain text start and end: runs of letters or of signs, single digits, and the fixed endings after an
    apostrophe. The text ends with a blank."""
    kind = KINDS[np.minimum(chars, len(KINDS) - 1)]
    change = np.ones(len(kind), bool)
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((chars[:-2] == ord("'")) & change[:-2] & (kind[1:-1] == ALPHA))
    one, two = chars[quote + 1], chars[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    quote, length = quote[short | long], np.where(short, 1, 2)[short | long]
    change[quote + 1] = False
    change[quote + 1 + length] = True
    at = np.flatnonzero(change)
    word = kind[at] != BLANK
    return at[word], np.append(at[1:], len(chars))[word]


def distinct(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each distinct word, and which of these every word is. Words are grouped by a hash and then compared character by
    character; a word that is not like the one that stands for its group stands for itself."""
    power = _powers(len(chars))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * power[0])])
    hashed = (total[end] - total[start]) * power[1][start] + (end - start).astype(np.uint64)
    _, first, name = np.unique(hashed, return_index=True, return_inverse=True)
    like = start[first][name]
    size = end - start
    same = size == (end - start)[first][name]
    size = np.where(same, size, 0)
    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    differs = np.flatnonzero(chars[place] != chars[place + np.repeat(like - start, size)])
    if len(differs):
        same[np.searchsorted(np.cumsum(size), differs, "right")] = False
    odd = np.flatnonzero(~same)
    name[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), name


_POWERS = [np.ones((2, 1), np.uint64)]


def _powers(size: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64 and of its inverse, at least `size` of them."""
    while _POWERS[0].shape[1] < size:
        held = _POWERS[0]
        more = np.array([[pow(BASE, held.shape[1], 2**64)], [pow(BASE, -held.shape[1], 2**64)]], np.uint64)
        _POWERS[0] = np.concatenate([held, held * more], 1)
    return _POWERS[0][:, :size]


def _joined(words: list[tuple[bytes, bytes]], name: np.ndarray, often: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Ids and decoded text of texts, given those of the distinct words, the word at every place, and the words per text."""
    ids, decoded = zip(*words) if words else ((), ())
    texts = np.repeat(np.arange(len(often)), often)
    out = []
    for held, kind, spare in ((ids, "<u4", 0), ([d + b" " if d else d for d in decoded], np.uint8, 1)):
        pool = np.frombuffer(b"".join(held), kind)
        size = np.fromiter(map(len, held), np.int64, len(held)) // pool.itemsize
        begin, size = (np.cumsum(size) - size)[name], size[name]
        flat = pool[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        stops = np.cumsum(np.bincount(texts, size, len(often)).astype(np.int64)).tolist()
        out.append([flat[a : max(a, b - spare)].tobytes() for a, b in zip([0, *stops], stops)])
    return list(zip(*out))


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
])
TOKENS = T.StructType([*ENCODED.fields[:2], T.StructField("decoded_sha256", T.StringType())])
DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])
STEP = 128  # texts that are encoded together


def _stepwise(path: str | None, texts: pd.Series) -> Iterator[tuple[int, bytes, bytes]]:
    model = word_bpe(path or vocabulary_path())
    held = texts.tolist()
    gc.disable()  # no cycles arise here, and each collection would walk through the caches
    try:
        for at in range(0, len(held), STEP):
            yield from model.encode_texts(held[at : at + STEP])
    finally:
        gc.enable()


def encode_udf(path: str | None = None):
    """A column of whole texts to n_tokens, ids (little-endian 32-bit numbers) and decoded (UTF-8).

    `path`: a tokenizers JSON file that every worker can read; by default the public 49k vocabulary on each machine. Null
    and empty texts have no ids; equal rows give equal results; a text of any length is encoded whole.
    """

    @F.pandas_udf(ENCODED)
    def encode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_stepwise(path, texts), columns=ENCODED.names)

    return encode


def tokens_udf(path: str | None = None):
    """As `encode_udf`, with the SHA-256 of the decoded text in its place, so that the text stays in the worker."""

    @F.pandas_udf(TOKENS)
    def tokens(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(((n, i, hashlib.sha256(d).hexdigest()) for n, i, d in _stepwise(path, texts)), columns=TOKENS.names)

    return tokens


def digest_udf(path: str | None = None):
    """As `encode_udf`, but the SHA-256 of ids and decoded text in hex, so that only digests leave the worker."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    @F.pandas_udf(DIGESTS)
    def digest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(((n, sha(i), sha(d)) for n, i, d in _stepwise(path, texts)), columns=DIGESTS.names)

    return digest


def decode_udf(path: str | None = None):
    """A column of ids, as `encode_udf` gives them, to text: the tokens' names with spaces between; unknown ids are left out."""

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        names = word_bpe(path or vocabulary_path()).names
        return pd.Series([None if b is None else " ".join([names[i] for i in np.frombuffer(b, "<u4").tolist() if i in names]) for b in ids])

    return decode


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id with n_tokens, ids_sha256 and decoded_sha256 for every row of `documents`."""
    return documents.select("doc_id", digest_udf(path)(F.col("text")).alias("d")).select("doc_id", "d.*")


@query("op4_bpe")
def op4_bpe(spark, folder):
    return encode_documents(table(spark, folder, "documents"))
