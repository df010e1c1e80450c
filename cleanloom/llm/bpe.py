"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from cleanloom.llm.common import kind, map_rows, quoted

# A worker remembers up to REMEMBERED chunks and as many pre-tokens (about 60 MB each), then the first LASTING of them, and
# RESTING between tasks: the first ones seen are the common ones. Longer ones than LONG are never kept.
REMEMBERED, LASTING, RESTING, LONG = 300_000, 100_000, 50_000, 48
# Pre-tokens share a queue up to about this many bytes; a longer one has it alone.
QUEUE_BYTES = 65_536
# Texts of a batch are encoded together up to this many characters.
TOGETHER = 4_000_000


class RankQueue:
    """Buckets of list positions per merge rank; three bitmap levels of 64-bit words tell the first non-empty one."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def put(self, rank: int, positions: list[int]) -> None:
        found = self.buckets.get(rank)
        if found is not None:
            found.extend(positions)
            return
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its positions: find-first-set on each level."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Codec:
    """Ranks of one vocabulary; encodes texts and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.vocab: list[bytes] = [b""] * self.width
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        # Every split of a token into two tokens is a pair that merges at its rank.
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        self.first = np.full((256, 256), -1, np.int32)
        for a in range(256):
            for b in range(256):
                rank = ranks.get(bytes([a, b]))
                if rank is not None:
                    self.first[a, b] = rank
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "Codec":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token; all pre-tokens share one queue and never merge with each other.

        The queue gives the lowest rank; its positions are taken from left to right. An entry is stale if its pair
        has changed since. If a merge brings up a lower rank, the rest of the bucket goes back and that rank is next.
        """
        data = b"".join(pieces)
        n = len(data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(data, np.uint8)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[(ends - sizes)] = -1
        start = np.full(n, -1, np.int32)
        start[:-1] = self.first[raw[:-1], raw[1:]]
        start[ends - 1] = -1
        tok = list(map(self.bytes.__getitem__, data))
        nxt, prv = after.tolist(), before.tolist()
        queue = RankQueue(self.width)
        at = np.flatnonzero(start >= 0)
        at = at[np.argsort(start[at], kind="stable")]
        ranks, cuts = np.unique(start[at], return_index=True)
        for rank, positions in zip(ranks.tolist(), np.split(at, cuts[1:])):
            queue.put(rank, positions.tolist())
        pair, width, put, buckets = self.pairs.get, self.width, queue.put, queue.buckets
        while (popped := queue.pop()) is not None:
            rank, positions = popped
            positions.sort()
            for done, i in enumerate(positions, 1):
                j = nxt[i]
                left = tok[i]
                if j < 0 or left < 0 or pair(left * width + tok[j]) != rank:
                    continue
                tok[i], tok[j] = rank, -1
                lower = False
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    new = pair(rank * width + tok[k])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            put(new, [i])
                        lower = new < rank
                h = prv[i]
                if h >= 0:
                    new = pair(tok[h] * width + rank)
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            put(new, [h])
                        lower = lower or new < rank
                if lower:
                    if positions[done:]:
                        put(rank, positions[done:])
                    break
        out = []
        begin = 0
        for end in ends.tolist():
            out.append([t for t in tok[begin:end] if t >= 0])
            begin = end
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of texts that the pattern splits on their own. A pre-token that is a token stays whole."""
        if len(self.words) > REMEMBERED:
            self.words = first(self.words, LASTING)
        words = self.words
        spans = [self.split(chunk) for chunk in chunks]
        fresh: dict[str, bytes] = {p: b"" for parts in spans for p in parts if p not in words}
        group: list[str] = []
        raws: list[bytes] = []
        size = 0
        for p in fresh:
            raw = p.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                fresh[p] = pack([rank])
                continue
            group.append(p)
            raws.append(raw)
            size += len(raw)
            if size > QUEUE_BYTES:
                fresh.update(zip(group, map(pack, self.merge(raws))))
                group, raws, size = [], [], 0
        if group:
            fresh.update(zip(group, map(pack, self.merge(raws))))
        out = [b"".join([words.get(p) or fresh[p] for p in parts]) for parts in spans]
        words.update((p, ids) for p, ids in fresh.items() if len(p) <= LONG)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit numbers.

        No alternative of the pattern continues from other characters into white space, so a text may be cut before
        every space that follows a character other than white space. Chunks that occur again are looked up.
        """
        if len(self.known) > REMEMBERED:
            self.known = first(self.known, LASTING)
        known = self.known
        cut, fresh = [], {}
        for text in texts:
            parts = text.split(" ")
            got = list(map(known.get, parts[1:]))
            odd = None in got and any(p == "" or p[-1].isspace() for p, g in zip(parts[1:], got) if g is None)
            if odd or (parts[0] != "" and parts[0][-1].isspace()):
                parts = joined(parts)
                got = list(map(known.get, parts[1:]))
            head = parts[0]
            cut.append((head, parts, got))
            for p, g in zip(parts[1:], got):
                if g is None:
                    fresh[" " + p] = None
            if head:
                fresh[head] = None
        keys = list(fresh)
        fresh = dict(zip(keys, self.encode_chunks(keys)))
        out = []
        for head, parts, got in cut:
            if None in got:
                got = [g if g is not None else fresh[" " + p] for p, g in zip(parts[1:], got)]
            out.append(b"".join([fresh[head], *got] if head else got))
        for chunk, ids in fresh.items():
            if chunk[0] == " " and 1 < len(chunk) <= LONG and not chunk[-1].isspace():
                known[chunk[1:]] = ids
        return out

    def rest(self) -> None:
        """Forget most of what is remembered: workers live on and serve other tasks."""
        self.known, self.words = first(self.known, RESTING), first(self.words, RESTING)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def first(items: dict, n: int) -> dict:
    return dict(islice(items.items(), n))


def joined(parts: list[str]) -> list[str]:
    """Parts between spaces, glued again where a part ends with white space, so that no run of it is cut.

    The first part keeps its text, each later one lacks its leading space.
    """
    out, first = [], True
    now = parts[0]
    for p in parts[1:]:
        if (now == "" and not first) or (now != "" and now[-1].isspace()):
            now = f"{now} {p}"
        else:
            out.append(now)
            now, first = p, False
    out.append(now)
    return out


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    return np.asarray(packed, "<u4").tobytes() if sys.byteorder == "big" else packed.tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of one vocabulary file; every machine has the file at this path."""
    found = _CODECS.get((path, pattern))
    if found is None:
        found = _CODECS[path, pattern] = Codec.load(path, pattern)
    return found


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text: ``id, ids`` (binary, little-endian 32-bit) and ``decoded`` text bytes.

    With ``digests`` the result is ``id, n_tokens, ids_sha256, decoded_sha256``. Ids are those of the merge ranks in
    ``path``, pre-tokens those of ``pattern``; special tokens do not exist. A null text counts as empty: no ids. Ids are
    kept as they are, null and repeated ones too; other columns are ignored. Long texts are encoded whole.
    """
    def make():
        tool = codec(path, pattern)

        def step(ids: list, texts: list) -> dict[str, list]:
            packed: list[bytes] = []
            group: list[str] = []
            size = 0
            for text in texts:
                group.append(text or "")
                size += len(text or "")
                if size > TOGETHER:
                    packed += tool.encode(group)
                    group, size = [], 0
            packed += tool.encode(group)
            if not digests:
                return {id_col: ids, "ids": packed, "decoded": [tool.decode(x) for x in packed]}
            return {id_col: ids, "n_tokens": [len(x) // 4 for x in packed], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
                    "decoded_sha256": [hashlib.sha256(tool.decode(x)).hexdigest() for x in packed]}
        step.done = tool.rest
        return step

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return map_rows(df, [id_col, text_col], f"{quoted(id_col)} {kind(df, id_col)}, {rest}", make)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of packed ids: ``id, decoded``. Null ids decode to nothing; ids outside the vocabulary raise."""
    def make():
        tool = codec(path, pattern)
        return lambda ids, packed: {id_col: ids, "decoded": [tool.decode(x or b"") for x in packed]}

    return map_rows(df, [id_col, ids_col], f"{quoted(id_col)} {kind(df, id_col)}, decoded binary", make)
