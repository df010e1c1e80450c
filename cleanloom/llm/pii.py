"""Personal data: pattern matches, extended by a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cleanloom.llm.common import free_name, kind, map_rows, quoted, ref, spread_sample

KINDS = ("email", "ip", "card", "phone")
# Label 0 is "no personal data", label i + 1 is KINDS[i].
LABELS = len(KINDS) + 1
# Documents that fit the random field, at most twice as many.
TRAIN_ROWS = 4_000
ROUNDS = 6

# Possessive forms of the contract's patterns: same matches, linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRACE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the pattern matches: leftmost, non-overlapping per kind, failing ones dropped."""
    if not _TRACE.search(text):
        return []
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- tokens and features -------------------------------------------------------------------------------------------

FEATURES = 40


def features(token: str, before: str) -> list[int]:
    """Numbers of the active shape features of a token, given the token before it."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = token.count(".")
    out = [0, 1 + min(digits, 20) * 2 // 5, 10 + min(dots, 4), 15 + min(letters, 9) // 3, 19 + min(len(token) // 6, 4)]
    for k, on in enumerate(("@" in token, "@" in token and "." in token.split("@", 1)[1][1:-1], token[:1] == "+", "(" in token or ")" in token,
                            "-" in token, "=" in token or '"' in token, digits == len(token), 12 <= digits <= 19, 9 <= digits <= 11,
                            token[-1:] in ".,;:", before[-1:] == ":", before[:1] == "+" and digits > 2, letters > 0 and digits > 3)):
        if on:
            out.append(24 + k)
    return out


def skip_key(token: str) -> str | None:
    """Tokens of one document with the same key share a potential: same digits at the end, same mailbox, or same text."""
    bare = token.strip(".,;:()[]<>\"'!?").lower()
    if "@" in bare:
        return "@" + bare
    digits = _NOT_DIGITS.sub("", bare)
    if len(digits) >= 7:
        return digits[-7:]
    return "=" + bare if len(bare) >= 5 else None


@dataclass
class Nodes:
    """Candidate tokens of a batch of documents. A token without digit and ``@`` is surely label 0 and cuts the chain."""

    doc: list[int]
    start: list[int]
    end: list[int]
    order: list[int]
    active: list[list[int]]
    key: list[int]


def candidates(texts: list[str]) -> Nodes:
    nodes = Nodes([], [], [], [], [], [])
    keys: dict[tuple[int, str], int] = {}
    for d, text in enumerate(texts):
        if not text or not _TRACE.search(text):
            continue
        before = ""
        for n, m in enumerate(_TOKEN.finditer(text)):
            token = m.group()
            if _TRACE.search(token):
                nodes.doc.append(d)
                nodes.start.append(m.start())
                nodes.end.append(m.end())
                nodes.order.append(n)
                nodes.active.append(features(token, before))
                key = skip_key(token)
                nodes.key.append(-1 if key is None else keys.setdefault((d, key), len(keys)))
            before = token
    return nodes


def labels(nodes: Nodes, known: list[list[Span]]) -> np.ndarray:
    """Label of each candidate by the base span that overlaps it."""
    out = np.zeros(len(nodes.doc), np.int64)
    at, doc = 0, -1
    for i, (d, s, e) in enumerate(zip(nodes.doc, nodes.start, nodes.end)):
        if d != doc:
            doc, at, spans = d, 0, known[d]
        while at < len(spans) and spans[at][2] <= s:
            at += 1
        for start, what, end in spans[at:at + 4]:
            if start < e and end > s:
                out[i] = what + 1
                break
    return out


# --- the random field ------------------------------------------------------------------------------------------------

@dataclass
class Field:
    """Weights: features x labels, transitions label x label, and the bonus for equal labels of similar tokens."""

    emission: np.ndarray
    transition: np.ndarray
    bond: float

    @classmethod
    def fit(cls, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, agree: float, steps: int = 300) -> "Field":
        """Pseudo-likelihood: a softmax of features and neighbour labels, by full-batch gradient steps.

        ``rows``/``cols`` are the active features; ``left``/``right`` the true label of the chain neighbour or -1. The
        bond is the log odds that similar tokens of one document carry the same label, held within 0 and 3. Tokens of
        label -1 are left out: the patterns missed them, but a token like them in their document matched.
        """
        n = len(y)
        emission = np.zeros((FEATURES, LABELS))
        transition = np.zeros((LABELS, LABELS))
        truth = np.zeros((n, LABELS))
        sure = np.flatnonzero(y >= 0)
        truth[sure, y[sure]] = 1
        has_left, has_right = left >= 0, right >= 0
        for step in range(steps if n else 0):
            z = np.stack([np.bincount(rows, emission[cols, k], n) for k in range(LABELS)], 1)
            z[has_left] += transition[left[has_left]]
            z[has_right] += transition.T[right[has_right]]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.where(y[:, None] >= 0, truth - p, 0.0) / n
            ge = np.stack([np.bincount(cols, g[rows, k], FEATURES) for k in range(LABELS)], 1)
            gt = np.zeros_like(transition)
            np.add.at(gt, left[has_left], g[has_left])
            np.add.at(gt.T, right[has_right], g[has_right])
            emission += 4.0 * (ge - 1e-4 * emission)
            transition += 2.0 * (gt - 1e-3 * transition)
        return cls(emission, transition, float(np.clip(np.log((agree + 0.01) / (1 - agree + 0.01)), 0, 3)))

    def decode(self, nodes: Nodes, clamp: np.ndarray) -> np.ndarray:
        """Labels by loopy message passing over chain edges and one hub for each group of similar tokens.

        A hub is a hidden label that every member of its group wants to equal: the messages of a group of n tokens
        are n, not n * n. ``clamp`` fixes the label of tokens inside base spans (-1: free).
        """
        n = len(nodes.doc)
        sizes = np.fromiter(map(len, nodes.active), np.int64, n)
        rows = np.repeat(np.arange(n), sizes)
        cols = np.fromiter((c for a in nodes.active for c in a), np.int64, int(sizes.sum()))
        local = np.stack([np.bincount(rows, self.emission[cols, k], n) for k in range(LABELS)], 1)
        fixed = clamp >= 0
        local[fixed] = -30.0
        local[fixed, clamp[fixed]] = 30.0
        doc, order, key = np.array(nodes.doc), np.array(nodes.order), np.array(nodes.key)
        link = np.flatnonzero((doc[1:] == doc[:-1]) & (order[1:] == order[:-1] + 1)) if n > 1 else np.zeros(0, np.int64)
        member = np.flatnonzero(key >= 0)
        hubs = int(key.max()) + 1 if n else 0
        forward, backward = np.zeros((len(link), LABELS)), np.zeros((len(link), LABELS))
        down = np.zeros((n, LABELS))
        for _ in range(ROUNDS):
            belief = local + down
            np.add.at(belief, link + 1, forward)
            np.add.at(belief, link, backward)
            up = self._softened(belief - down)[member]
            total = np.zeros((hubs, LABELS))
            np.add.at(total, key[member], up)
            new_down = np.zeros_like(down)
            new_down[member] = self._softened(total[key[member]] - up)
            to_right = self._pass(belief[link] - backward, self.transition)
            backward = self._pass(belief[link + 1] - forward, self.transition.T)
            forward = to_right
            down = 0.5 * down + 0.5 * new_down
        belief = local + down
        np.add.at(belief, link + 1, forward)
        np.add.at(belief, link, backward)
        return belief.argmax(1)

    def _softened(self, message: np.ndarray) -> np.ndarray:
        """A message through the equality potential, normalised in log space."""
        if not len(message):
            return message
        m = message - message.max(1, keepdims=True)
        e = np.exp(m)
        total = e.sum(1, keepdims=True)
        out = np.log(total + (np.exp(self.bond) - 1) * e)
        return out - out.max(1, keepdims=True)

    @staticmethod
    def _pass(message: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(message):
            return message
        m = message - message.max(1, keepdims=True)
        out = np.log(np.exp(m) @ np.exp(weights) + 1e-300)
        return out - out.max(1, keepdims=True)


def neighbours(nodes: Nodes, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.full(len(y), -1), np.full(len(y), -1)
    for i in range(1, len(y)):
        if nodes.doc[i] == nodes.doc[i - 1] and nodes.order[i] == nodes.order[i - 1] + 1:
            left[i], right[i - 1] = y[i - 1], y[i]
    return left, right


def fit_field(df: DataFrame, id_col: str, text_col: str, train_rows: int = TRAIN_ROWS) -> Field:
    """Fit on about ``train_rows`` documents by hash of the id, labelled by their own base spans.

    Executors turn texts into features and labels; only those of the sampled candidates reach the driver.
    """
    def make():
        def step(texts: list) -> dict[str, list]:
            texts = [t or "" for t in texts]
            known = [base_spans(t) for t in texts]
            nodes = candidates(texts)
            y = labels(nodes, known)
            left, right = neighbours(nodes, y)
            matched = {k for k, v in zip(nodes.key, y) if v > 0}
            y = np.array([-1 if v == 0 and k >= 0 and k in matched else v for k, v in zip(nodes.key, y)], np.int64)
            out: dict[str, list] = {"active": [[] for _ in texts], "sizes": [[] for _ in texts], "y": [[] for _ in texts],
                                    "l": [[] for _ in texts], "r": [[] for _ in texts], "key": [[] for _ in texts]}
            for i, d in enumerate(nodes.doc):
                out["active"][d] += nodes.active[i]
                for name, value in (("sizes", len(nodes.active[i])), ("y", int(y[i])), ("l", int(left[i])), ("r", int(right[i])), ("key", nodes.key[i])):
                    out[name][d].append(value)
            return out
        return step

    sample = spread_sample(df.select(ref(id_col).alias("id"), ref(text_col).alias("text")), train_rows, df.count())
    got = map_rows(sample, ["text"], ", ".join(f"{c} array<int>" for c in ("active", "sizes", "y", "l", "r", "key")), make).toPandas()
    join = {c: np.concatenate([np.asarray(x, np.int64) for x in got[c]] or [np.zeros(0, np.int64)]) for c in got.columns}
    rows = np.repeat(np.arange(len(join["sizes"])), join["sizes"])
    same = seen = 0
    for ys, ks in zip(got["y"], got["key"]):
        groups: dict[int, list[int]] = {}
        for y, k in zip(ys, ks):
            if k >= 0 and y >= 0:
                groups.setdefault(k, []).append(y)
        for ys_of in groups.values():
            if len(ys_of) > 1:
                seen += len(ys_of)
                same += max(ys_of.count(v) for v in set(ys_of))
    return Field.fit(rows, join["active"], join["y"], join["l"], join["r"], same / seen if seen else 0.9)


def all_spans(texts: list[str], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added spans of each text. Added ones never touch a base span."""
    known = [base_spans(t) for t in texts]
    nodes = candidates(texts)
    added: list[list[Span]] = [[] for _ in texts]
    if nodes.doc:
        y = labels(nodes, known)
        found = field.decode(nodes, np.where(y > 0, y, -1))
        last = -2
        for i in np.flatnonzero((y == 0) & (found > 0)).tolist():
            d, what = nodes.doc[i], int(found[i]) - 1
            raw = texts[d][nodes.start[i]:nodes.end[i]]
            start = nodes.start[i] + len(raw) - len(raw.lstrip(".,;:\"'([<"))
            end = nodes.end[i] - (len(raw) - len(raw.rstrip(".,;:\"')]>!?")))
            if start >= end:
                continue
            if last == i - 1 and added[d] and added[d][-1][1] == what and nodes.doc[last] == d and nodes.order[last] + 1 == nodes.order[i]:
                added[d][-1] = (added[d][-1][0], what, end)
            else:
                added[d].append((start, what, end))
            last = i
    return known, added


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every whole text.

    Base spans come from the patterns. A skip-chain random field then labels the remaining tokens with digits or ``@``:
    chain edges join neighbours, and tokens of one document with equal ends of digits, mailboxes or texts share a
    potential, so that a number written once in full marks its later short forms. Base spans are fixed evidence and stay.

    A null text counts as empty: no spans, the digest of the empty text. Null and repeated ids are kept as they are,
    other columns are ignored, long texts are read whole, an empty table gives no rows.
    """
    field = fit_field(df, id_col, text_col, train_rows)

    def make():
        def step(ids: list, texts: list) -> dict[str, list]:
            known, added = all_spans([t or "" for t in texts], field)
            out: dict[str, list] = {id_col: ids}
            for k, name in enumerate(KINDS):
                out[f"n_{name}"] = [sum(s[1] == k for s in spans) for spans in known]
            out["base_sha256"] = [hashlib.sha256(shown(spans).encode()).hexdigest() for spans in known]
            out["spans"] = [shown(a + b) for a, b in zip(known, added)]
            out["n_added"] = list(map(len, added))
            return out
        return step

    return map_rows(df, [id_col, text_col], f"{quoted(id_col)} {kind(df, id_col)}, n_email long, n_ip long, n_card long, n_phone long, "
                                            "base_sha256 string, spans string, n_added long", make)


def mask_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The table with every span of ``text`` replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``.

    Overlapping spans become one mark, that of the first. Null texts stay null; all other columns stay as they are.
    """
    field = fit_field(df, id_col, text_col, train_rows)
    name = free_name(df, "masked")

    def make():
        def step(texts: list) -> dict[str, list]:
            known, added = all_spans([t or "" for t in texts], field)
            out = []
            for text, a, b in zip(texts, known, added):
                if text is None or not (a or b):
                    out.append(text)
                    continue
                parts, at = [], 0
                for s, k, e in sorted(a + b):
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]))
            return {name: out}
        return step

    masked = map_rows(df, [text_col], f"{quoted(name)} string", make, keep=True)
    return masked.select([ref(name).alias(c) if c == text_col else ref(c) for c in df.columns])
