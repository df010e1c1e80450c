"""Benchmark decontamination: pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import free_name, kind, map_rows, quoted, ref

# Share of an item's characters that may be edited, and the length below which an item is sought between word boundaries only.
ERROR_RATE, SHORT = 0.1, 32
# Short items of at most this many words must equal the whole text.
FEW_WORDS = 2
# Letters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
# Items are handled in blocks of about this many characters; only one block is broadcast and indexed at a time.
BLOCK_CHARS = 2_000_000


def canonical(text: str | None) -> str:
    """Lower case, any white space as one space."""
    return " ".join((text or "").lower().split())


def words(text: str) -> int:
    """White-space pieces with a letter or digit; letters of scripts without spaces count as half a word each."""
    dense = len(UNSPACED.findall(text))
    return sum(any(c.isalnum() for c in piece) for piece in UNSPACED.sub(" ", text).split()) + (dense + 1) // 2


def is_boundary(text: str, at: int) -> bool:
    """Whether no word of ``text`` goes on across position ``at``."""
    if not 0 < at < len(text):
        return True
    a, b = text[at - 1], text[at]
    return not (a.isalnum() and b.isalnum()) or bool(UNSPACED.match(a) or UNSPACED.match(b))


class Pattern:
    """Bit masks of one text for Myers' edit distance."""

    def __init__(self, text: str):
        self.size = len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> tuple[int, int]:
        """Least edit distance to any substring of ``text``, and the first end of such a substring."""
        best, end = self.size, 0
        for j, score in self.scores(text):
            if score < best:
                best, end = score, j
        return best, end

    def scores(self, text: str) -> Iterator[tuple[int, int]]:
        """Each end in ``text`` with the least edit distance to a substring that ends there."""
        m = self.size
        full, high = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        get = self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            d = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(d | plus))
            down = plus & d
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            # No carry comes in below: a match may start anywhere in the text.
            up = up << 1 & full
            plus = (down << 1 & full) | (full & ~(d | up))
            minus = up & d
            yield j, score


class Item:
    """A test item, cut into budget + 1 pieces: with at most ``budget`` edits one of them stays whole.

    The pieces are the leaves of a binary tree. By the same argument a leaf exists of which every enclosing node of p
    pieces has at most p - 1 edits, so a hit whose small enclosing nodes fail need not be looked at further.
    """

    def __init__(self, item_id: int, text: str, rate: float, short: bool = False):
        self.item_id, self.text, self.short = item_id, text, short
        self.budget = int(len(text) * rate)
        self.whole = Pattern(text)
        k = self.budget + 1
        self.cuts = [len(text) * i // k for i in range(k + 1)]
        self.around: list[list[tuple[int, int, int, Pattern, list[str]]]] = [[] for _ in range(k)]
        todo = [(0, k)]
        while todo:
            low, high = todo.pop()
            if high - low < 2:
                continue
            mid = (low + high) // 2
            todo += [(low, mid), (mid, high)]
            if high - low <= 6 and high - low < k:
                a, b = self.cuts[low], self.cuts[high]
                pattern = Pattern(text[a:b])
                for leaf in range(low, high):
                    # Beside the whole leaf at most p - 1 edits are left: one of p parts of the rest is whole too.
                    left, right, p = text[a:self.cuts[leaf]], text[self.cuts[leaf + 1]:b], high - low
                    rest = [r for r in (left, right) if r]
                    parts = [r[len(r) * i // p:len(r) * (i + 1) // p] for r in rest for i in range(p)]
                    self.around[leaf].insert(0, (a, b, p - 1, pattern, parts))

    def between_words(self, text: str, end: int) -> int:
        """Least edit distance to a substring that ends at ``end`` and starts at a word boundary, or more than the budget."""
        best, item = self.budget + 1, self.text[::-1]
        before = list(range(len(item) + 1))
        for k in range(1, min(end, len(item) + self.budget) + 1):
            c, now = text[end - k], [k]
            for i, a in enumerate(item, 1):
                now.append(min(before[i - 1] + (a != c), before[i] + 1, now[i - 1] + 1))
            before = now
            if now[-1] < best and is_boundary(text, end - k):
                best = now[-1]
        return best

    def nearest(self, text: str, a: int, b: int) -> tuple[int, int]:
        """Least edit distance to a substring of ``text[a:b]`` and its first end; of a short item between word boundaries."""
        if not self.short:
            distance, end = self.whole.distance(text[a:b])
            return distance, a + end
        best = (self.budget + 1, a)
        for j, score in self.whole.scores(text[a:b]):
            if score < best[0] and is_boundary(text, a + j):
                best = min(best, (self.between_words(text, a + j), a + j), key=lambda x: x[0])
                if best[0] == 0:
                    break
        return best

    def plausible(self, leaf: int, text: str, start: int) -> bool:
        """Whether the nodes around a leaf that occurs at ``start`` keep their budgets, small ones first."""
        origin = start - self.cuts[leaf]
        for a, b, budget, pattern, parts in self.around[leaf]:
            window = text[max(0, origin + a - budget):origin + b + budget]
            for part in parts:
                if part in window:
                    break
            else:
                return False
            if pattern.distance(window)[0] > budget:
                return False
        return True


class Matcher:
    """All pieces of a block of items in one exact-match automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, short: int):
        self.whole: dict[str, list[int]] = {}
        self.items: list[Item] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if len(text) < short and words(text) <= FEW_WORDS:
                self.whole.setdefault(text, []).append(item_id)
                continue
            item = Item(item_id, text, rate, len(text) < short)
            for leaf, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])):
                where.setdefault(text[a:b], []).append((len(self.items), leaf))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the canonical text) of each item that occurs within its budget."""
        out = [(i, 0, len(text)) for i in self.whole.get(text, [])]
        if not self.any or not text:
            return out
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, leaf in places:
                item = self.items[k]
                if not item.plausible(leaf, text, end + 1 - size):
                    continue
                start = end + 1 - size - item.cuts[leaf]
                a, b = start - item.budget, start + len(item.text) + item.budget
                runs = windows.setdefault(k, [])
                # Hits come in order of their end; those whose windows touch are verified together.
                if runs and a <= runs[-1][1]:
                    runs[-1][0] = min(runs[-1][0], a)
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
        for k, runs in windows.items():
            item, best = self.items[k], None
            for a, b in runs:
                distance, end = item.nearest(text, max(0, a), b)
                if distance <= item.budget and (best is None or distance < best[0]):
                    best = (distance, end)
                    if distance == 0:
                        break
            if best:
                out.append((item.item_id, *best))
        return sorted(out)


def with_matches(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                 rate: float = ERROR_RATE, short: int = SHORT, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str]:
    """The table with one more column, an array of (item_id, distance, end), and that column's name.

    An item of n canonical characters (lower case, single spaces) occurs in a text if some substring is within
    ``floor(rate * n)`` edits. It is cut into one piece more than that; an Aho-Corasick automaton finds every exact piece,
    and Myers' bit vectors verify the windows around the hits, so no occurrence is lost. The substring of an item
    below ``short`` characters must start and end at word boundaries, and one of at most FEW_WORDS words must equal the whole text. Null and empty items match nothing; null texts hold nothing; repeated items and rows
    each count; long texts are scanned whole.

    The items are broadcast in blocks of about ``block_chars`` characters, one pass over the texts a block, so memory
    stays bounded for a benchmark of any size.
    """
    items = benchmark.select(ref(item_id_col).cast("long").alias("item_id"), F.trim(ref(item_text_col)).alias("text"))
    items = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    blocks = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    name = free_name(df, "matches")
    out = df.withColumn(name, F.expr("cast(array() as array<struct<item_id: bigint, distance: int, end: int>>)"))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = [(r[0], t) for r in part.toLocalIterator() if (t := canonical(r[1]))]
        shared = df.sparkSession.sparkContext.broadcast(block)
        more = free_name(out, "matches_now")

        def make(shared=shared, more=more):
            tool = Matcher(shared.value, rate, short)
            return lambda texts: {more: [[{"item_id": i, "distance": d, "end": e} for i, d, e in tool.find(canonical(t))] for t in texts]}

        out = map_rows(out, [text_col], f"{quoted(more)} array<struct<item_id: bigint, distance: int, end: int>>", make, keep=True)
        out = out.withColumn(name, F.concat(ref(name), ref(more))).drop(more)
    return out, name


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``id, contaminated, n_items, item_ids`` (text, ascending) and ``distance`` (least) of every document; see `with_matches`."""
    text_col = options.get("text_col", "text")
    rows = df.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    out, name = with_matches(rows, benchmark, **{**options, "text_col": "text"})
    ids = F.array_sort(F.transform(ref(name), lambda m: m["item_id"]))
    return out.select(F.col("id").alias(id_col), (F.size(ref(name)) > 0).alias("contaminated"), F.size(ref(name)).cast("long").alias("n_items"),
                      F.array_join(ids, ",").alias("item_ids"), F.array_min(F.transform(ref(name), lambda m: m["distance"])).alias("distance"))
