"""Byte-level BPE encoding by a pair occurrence index, and decoding.

Texts of a partition are cut into chunks at single spaces between other
characters (no token spans such a place), equal chunks are kept once, and the
pieces of the distinct chunks once more. Their bytes lie in one array of symbols
with links to the neighbours. An index maps each pair that has a merge to all its
positions; the active ranks are applied in ascending order, each to all its
positions at once, and the pairs that it makes or breaks update the lists of
their neighbours. Since a merge can only make pairs of higher rank, this gives
what merging each word on its own by lowest rank gives.

Works on BATCH_BYTES of text at a time, so memory is bounded (a longer text is
one unit). Defined results: null text counts as empty; an empty text has no ids
and decodes to an empty one; the string of a special token is that token, as in
the tokenizers library; repeated rows give equal results; an empty table gives
no rows."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

BATCH_BYTES = 32 << 20
#: Chunks of texts whose ids are put together at a time.
PART_CHUNKS = 1 << 18
#: Fixed value: the pieces of byte-level BPE that merges don't cross.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts with a space at an end or beside other white space have spaces at which they are not cut.
UNSAFE = f" {_WHITE}|{_WHITE} |^ | $"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_settings(d: dict) -> None:
    """ValueError where a tokenizer file asks for something that cutting texts at single
    spaces, or the merges here, would not heed."""
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    odd = [k for k, v in plain.items() if (model.get(k) or None) != (v or None)]
    if odd or d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"no plain byte-level BPE: {odd or 'normalizer or pre_tokenizer'}")
    for t in d.get("added_tokens", []):
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or regex.search(r"\s", t["content"]):
            raise ValueError(f"the added token {t['content']!r} depends on its surroundings or holds white space")


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        check_settings(d)
        letters, vocab = byte_letters(), d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for t, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        first = dict.fromkeys(pairs.tolist())
        assert len(first) == len(pairs), "a pair has two ranks"
        self.left, self.right = pairs // self.size, pairs % self.size
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.order = np.argsort(pairs)
        self.keys = pairs[self.order]
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 for those without a merge."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.order[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


class PairIndex:
    """Positions of every mergeable pair among the symbols of many words."""

    def __init__(self, v: Vocabulary, data: bytes, lengths: np.ndarray) -> None:
        n = len(data)
        self.v = v
        self.symbol = v.of_byte[np.frombuffer(data, np.uint8)]
        self.live = np.ones(n, bool)
        self.next = np.arange(1, n + 1)
        self.before = np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        self.next[ends - 1] = -1
        self.before[ends - lengths] = -1
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        at = np.flatnonzero(self.next >= 0)
        self.add(at, v.rank(self.symbol[at], self.symbol[self.next[at]]))

    def add(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Enters the positions under their ranks."""
        found = rank >= 0
        at, rank = at[found], rank[found]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cut.tolist(), len(at)]
        for s, e in zip(bounds, bounds[1:], strict=False):
            r = int(rank[s])
            if r in self.lists:
                self.lists[r].append(at[s:e])
            else:
                self.lists[r] = [at[s:e]]
                heapq.heappush(self.active, r)

    def run(self) -> None:
        v = self.v
        while self.active:
            r = heapq.heappop(self.active)
            lists = self.lists.pop(r)
            at = np.unique(np.concatenate(lists) if len(lists) > 1 else lists[0])
            left, right = v.left[r], v.right[r]
            at = at[self.live[at] & (self.symbol[at] == left)]
            after = self.next[at]
            good = after >= 0
            good[good] = self.symbol[after[good]] == right
            at, after = at[good], after[good]
            if not len(at):
                continue
            if left == right and len(at) > 1:  # in a run of equal symbols, every second pair from the left
                joined = np.append(False, after[:-1] == at[1:])
                begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                odd = (np.arange(len(at)) - begin) % 2 == 1
                at, after = at[~odd], after[~odd]
            beyond = self.next[after]
            self.symbol[at] = v.made[r]
            self.live[after] = False
            self.next[at] = beyond
            has = beyond >= 0
            self.before[beyond[has]] = at[has]
            prior = self.before[at]
            prior = prior[prior >= 0]
            touched = np.concatenate([prior, at[has]])
            if len(touched):
                self.add(touched, v.rank(self.symbol[touched], self.symbol[self.next[touched]]))


def merged(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, and how many each has. Words are not empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not len(words):
        return np.zeros(0, np.int64), lengths
    index = PairIndex(v, b"".join(words), lengths)
    index.run()
    starts = np.cumsum(lengths) - lengths
    return index.symbol[index.live], np.add.reduceat(index.live.astype(np.int64), starts)


#: Encodes distinct chunks, given without the spaces before them and with which of them
#: have one: their ids one after another, and how many each has.
ChunkEncoder = Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]


def by_index(v: Vocabulary) -> ChunkEncoder:
    """An encoder by the pair occurrence index."""

    def encode(strings: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunks = [" " + s if f else s for s, f in zip(strings.to_pylist(), spaced.tolist(), strict=True)]
        pieces: dict[str, int] = {}
        order: list[int] = []  # a piece's number, or -1 - id of a special token
        counts = np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            had = len(order)
            if v.specials is not None and (cuts := list(v.specials.finditer(chunk))):
                at = 0
                for m in cuts:
                    order += [pieces.setdefault(p, len(pieces)) for p in v.pieces.findall(chunk[at : m.start()])]
                    order.append(-1 - v.special[m[0]])
                    at = m.end()
                chunk = chunk[at:]
            order += [pieces.setdefault(p, len(pieces)) for p in v.pieces.findall(chunk)]
            counts[k] = len(order) - had
        ids, n = merged(v, [p.encode() for p in pieces])
        seq = np.array(order, np.int64)
        plain = seq >= 0
        starts = np.append(np.cumsum(n) - n, len(ids) + np.arange(len(v.special)))
        number = {i: len(n) + k for k, i in enumerate(v.special.values())}
        for i in np.unique(seq[~plain]).tolist():
            seq[seq == i] = number[-1 - i]
        ids = np.append(ids, np.array(list(v.special.values()), np.int64))
        n = np.append(n, np.ones(len(v.special), np.int64))
        flat, ends = gather(ids, starts, n, seq)
        edges = np.append(0, np.cumsum(counts))
        return flat, ends[edges[1:]] - ends[edges[:-1]]

    return encode


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[i] : starts[i] + lengths[i]] for i in order, one
    after another, and the edges between them (from 0)."""
    n = lengths[order]
    edges = np.append(0, np.cumsum(n))
    return values[np.repeat(starts[order] - edges[:-1], n) + np.arange(edges[-1])], edges


def at_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut at every space: their parts one after another, and how many each has."""
    cut = pc.split_pattern(texts, " ")
    return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)


def at_single_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As at_spaces(), but only where no white space is on either side, nor an end of the text."""
    values, counts = at_spaces(texts)
    first = np.cumsum(counts) - counts
    white_end = pc.match_substring_regex(values, _WHITE + r"\z|^\z").to_numpy(zero_copy_only=False)
    white_start = pc.match_substring_regex(values, f"^{_WHITE}|" + r"^\z").to_numpy(zero_copy_only=False)
    begins = np.append(True, ~white_end[:-1] & ~white_start[1:])
    begins[first] = True
    edges = np.append(np.flatnonzero(begins), len(values)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), values), " "), np.add.reduceat(begins.astype(np.int64), first)


class Encoded:
    """Texts as runs of distinct chunks, each of which is encoded once.

    A chunk after a space has that space and goes on with another character. What is
    kept is a number per chunk of the texts; ids of whole texts are made for
    PART_CHUNKS chunks at a time."""

    def __init__(self, texts: pa.Array, encode: ChunkEncoder) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        #: Numbers of the texts in the order in which parts() gives them.
        self.order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        values, counts = at_spaces(texts.filter(pa.array(~odd)) if odd.any() else texts)
        if odd.any():
            more, n = at_single_spaces(texts.filter(pa.array(odd)))
            values, counts = pa.concat_arrays([values, more]), np.append(counts, n)
        parts = values.dictionary_encode()
        del values
        #: Where each text's chunks begin.
        self.edges = np.append(0, np.cumsum(counts))
        variant = parts.indices.to_numpy(zero_copy_only=False) * 2
        variant[self.edges[:-1]] += 1  # the first chunk of a text has no space before it
        used = np.flatnonzero(np.bincount(variant)) if len(variant) else np.zeros(0, np.int64)
        strings = parts.dictionary.take(pa.array(used // 2))
        number = np.zeros((int(used[-1]) + 1) if len(used) else 0, np.int32)
        number[used] = np.arange(len(used), dtype=np.int32)
        self.chunk = number[variant]
        del parts, variant, number
        self.ids, self.lengths = encode(strings, used % 2 == 0)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of some texts, their ids one after another, the edges between them)."""
        i, n = 0, len(self.order)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.edges, self.edges[i] + PART_CHUNKS, side="right")) - 1)
            ids, at = gather(self.ids, self.starts, self.lengths, self.chunk[self.edges[i] : self.edges[j]])
            yield self.order[i:j], ids, at[self.edges[i : j + 1] - self.edges[i]]
            i = j


def encode_all(texts: pa.Array, encode: ChunkEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another and the edges between them, in the order of the texts."""
    found: dict[int, np.ndarray] = {}
    for which, ids, at in Encoded(texts, encode).parts():
        found |= {int(k): ids[s:e] for k, s, e in zip(which, at, at[1:], strict=False)}
    return np.concatenate([np.zeros(0, np.int64), *(found[k] for k in range(len(found)))]), np.append(0, np.cumsum([len(found[k]) for k in range(len(found))])).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Batches joined or cut to tables of about so many bytes of text."""
    held, size = [], 0
    for b in batches:
        col = b.column(text)
        n = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(n), 0
        while start < len(n):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most - size, side="right")))
            held.append(b.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= most or start < len(n):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
    table = v.bytes
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", errors="replace")
