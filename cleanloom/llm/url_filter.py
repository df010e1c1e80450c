"""URL filter: glob rules as one bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import kind, quoted, ref

# Rules of the query: (host and path, verdict). The longest fitting rule decides.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# Globs that decide where no rule fits: one hit blocks. `*` stands for any text, `?` for one byte.
GLOBS = ["*free-bets*", "*casino*", "*/ads/*", "*.onion/*"]


@dataclass
class Automaton:
    """Shift-And masks of all patterns, packed into 64-bit words.

    Each pattern has a start bit and one bit per literal byte, placed one after the other across word borders.
    ``shift[c]`` has the bits that byte ``c`` may move into, ``stay[c]`` the bits that a star keeps alive on ``c``.
    """

    start: np.ndarray
    shift: np.ndarray
    stay: np.ndarray
    final: list[int]

    @classmethod
    def build(cls, patterns: list[str]) -> "Automaton":
        """Pattern syntax: ``*`` any bytes, ``?`` one byte, ``^`` (only in front) any bytes but ``/``."""
        bits = sum(len(p.encode()) + 1 for p in patterns)
        words = max(1, -(-bits // 64))
        start = np.zeros(words, np.uint64)
        shift = np.zeros((256, words), np.uint64)
        stay = np.zeros((256, words), np.uint64)
        final, at = [], 0
        for p in patterns:
            start[at // 64] |= np.uint64(1) << np.uint64(at % 64)
            for k, c in enumerate(p.encode()):
                if c in b"*^" and (c == 42 or k == 0):
                    stay[:, at // 64] |= np.uint64(1) << np.uint64(at % 64)
                    if c == 94:
                        stay[47, at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
                    continue
                at += 1
                one = np.uint64(1) << np.uint64(at % 64)
                if c == 63:
                    shift[:, at // 64] |= one
                else:
                    shift[c, at // 64] |= one
            final.append(at)
            at += 1
        return cls(start, shift, stay, final)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which pattern matches which whole text: all texts advance together, one byte a step.

        Texts are ordered by length, so that the live rows are always a prefix of the state table.
        """
        n, words = len(texts), len(self.start)
        lengths = np.fromiter((len(t) for t in texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
        state = np.tile(self.start, (n, 1))
        live = n
        for step in range(int(sizes[0]) if n else 0):
            while live and sizes[live - 1] <= step:
                live -= 1
            c = flat[begin[:live] + step]
            now = state[:live]
            moved = now << np.uint64(1)
            if words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.shift[c]) | (now & self.stay[c])
        hit = np.zeros((n, len(self.final)), bool)
        for k, bit in enumerate(self.final):
            hit[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return hit


def host_path(url: str) -> tuple:
    """Columns of host and path: after the first ``://`` up to ``/``, ``?``, ``#``; only A-Z are lower-cased."""
    rest = F.regexp_extract(F.coalesce(ref(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None,
                globs: list[str] | None = None) -> DataFrame:
    """Judge every URL: ``id, host, path, rule, verdict, globs_hit``.

    A URL is brought to the form ``.host/path``. A rule ``host/path`` becomes the pattern ``^.host/path*``, which fits the
    host and its subdomains; the longest fitting rule gives the verdict, the earlier one on equal length. Without a rule
    a fitting glob blocks, anything else is allowed. All patterns run in one automaton; tables of rules only cost more words.

    A null URL, or one without ``://``, has empty host and path, hits no rule and is judged by the globs over ``.``.
    Repeated rows give repeated results; other columns of any name are ignored; long URLs are matched whole.
    """
    rules = RULES if rules is None else rules
    globs = GLOBS if globs is None else globs
    # Characters of a rule are literal; only globs have wildcards.
    if any(ch in r for r, _ in rules for ch in "*?^"):
        raise ValueError("Rules are plain host/path texts; wildcards belong into globs.")
    automaton = Automaton.build([f"^.{r}*" for r, _ in rules] + list(globs))
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][0]), k))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hit = automaton.match([f".{h}{p}".encode() for h, p in zip(f["host"], f["path"])])
            rule = np.full(len(f), None, object)
            verdict = np.where(hit[:, len(rules):].any(axis=1), "block", "allow").astype(object)
            for k in reversed(ranked):
                rule[hit[:, k]], verdict[hit[:, k]] = rules[k]
            f["rule"], f["verdict"], f["globs_hit"] = rule, verdict, hit[:, len(rules):].sum(axis=1)
            yield f

    host, path = host_path(url_col)
    return df.select(ref(id_col).alias(id_col), host.alias("host"), path.alias("path")).mapInPandas(
        judge, f"{quoted(id_col)} {kind(df, id_col)}, host string, path string, rule string, verdict string, globs_hit long")
