"""Secret scans: all rules in one deterministic automaton over bytes.

Rule regexes (literals, classes, groups, alternation, ? * + {m} {m,} {m,n}) become one automaton by subset
construction and partition refinement; its transitions are arrays, and one pass over the bytes of a batch of
texts notes for each byte which rules accept there. Texts are cut into lanes that advance together; a lane's
first state is guessed from the bytes before it and the lane is run again where the guess was wrong, so the
result is that of one pass from start to end. Only around accepted bytes are the exact spans worked out.

Spans of a rule: leftmost, non-overlapping, greedy. `assign`, `access` and `hex` are the base rules; the others
add spans. Offsets are code points, ends exclusive. Null and empty texts have no span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column_udf

#: kind, pattern, letters in either case, least length: of the value for assign, of the match for the others (0: no test).
#: Most counts are tested after the match: counted loops of several rules would multiply the automaton's states.
RULES = [
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", True, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0),
    ("repository_token", r"gh[opsur]_[A-Za-z0-9]+", False, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
    ("payment_key", r"[rs]k_live_[A-Za-z0-9]+", False, 32),
]
BASE = ("assign", "access", "hex")


class _Nfa:
    """Thompson construction. rank orders the states of one repeated class: a higher one accepts whatever a lower one does."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []
        self.rank: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        self.rank.append(None)
        return len(self.free) - 1


class _Parser:
    def __init__(self, pattern: str, either_case: bool, nfa: _Nfa):
        self.p, self.at, self.fold, self.nfa = pattern, 0, either_case, nfa

    def alternation(self, start: int) -> int:
        ends = [self.sequence(start)]
        while self.at < len(self.p) and self.p[self.at] == "|":
            self.at += 1
            ends.append(self.sequence(start))
        if len(ends) == 1:
            return ends[0]
        out = self.nfa.state()
        for e in ends:
            self.nfa.free[e].append(out)
        return out

    def sequence(self, start: int) -> int:
        first = self.nfa.state()
        self.nfa.free[start].append(first)
        at = first
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            at = self.repeated(at)
        return at

    def _bytes(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha()}
        return frozenset(chars)

    def _char(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self) -> frozenset[int] | int:
        """A set of bytes, or where a group starts in the pattern."""
        c = self.p[self.at]
        if c == "(":
            return self.at
        if c != "[":
            return self._bytes({self._char()})
        self.at += 1
        chars: set[int] = set()
        while self.p[self.at] != "]":
            a = self._char()
            if self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                chars |= set(range(a, self._char() + 1))
            else:
                chars.add(a)
        self.at += 1
        return self._bytes(chars)

    def once(self, what: frozenset[int] | int, start: int) -> int:
        if isinstance(what, frozenset):
            out = self.nfa.state()
            hold = self.nfa.state()
            self.nfa.free[start].append(hold)
            self.nfa.step[hold] = (what, out)
            return out
        self.at = what + 1
        end = self.alternation(start)
        self.at += 1
        return end

    def repeated(self, start: int) -> int:
        what = self.atom()
        if not isinstance(what, frozenset):
            end = self.once(what, self.nfa.state())  # to learn where the group ends
        low, high = 1, 1
        c = self.p[self.at] if self.at < len(self.p) else ""
        if c in ("?", "*", "+"):
            low, high = {"?": (0, 1), "*": (0, -1), "+": (1, -1)}[c]
            self.at += 1
        elif c == "{":
            stop = self.p.index("}", self.at)
            a, comma, b = self.p[self.at + 1 : stop].partition(",")
            low, high = int(a), int(b) if b else (-1 if comma else int(a))
            self.at = stop + 1
        after, at, chain = self.at, start, len(self.nfa.free)
        for k in range(low):
            at = self.once(what, at)
            if high < 0 and isinstance(what, frozenset):
                self.nfa.rank[at] = (chain, k)
        if high < 0:
            loop = self.nfa.state()
            self.nfa.free[at].append(loop)
            end = self.once(what, loop)
            if isinstance(what, frozenset):
                self.nfa.rank[end] = (chain, low)
            self.nfa.free[end].append(loop)
            at = loop
        else:
            out = self.nfa.state()
            for _ in range(high - low):
                self.nfa.free[at].append(out)
                at = self.once(what, at)
            self.nfa.free[at].append(out)
            at = out
        self.at = after
        return at


@dataclass
class Automaton:
    table: np.ndarray  # states x classes
    classes: np.ndarray  # byte to class
    accepts: np.ndarray  # state to a bit for each rule
    start: int

    @property
    def states(self) -> int:
        return len(self.accepts)


def compile_rules(rules: list[tuple[str, bool]], anchored: bool = False) -> Automaton:
    """One automaton for all (pattern, either case); it searches (any start) unless anchored."""
    nfa = _Nfa()
    root = nfa.state()
    finals = {}
    for k, (pattern, fold) in enumerate(rules):
        own = nfa.state()
        nfa.free[root].append(own)
        finals[_Parser(pattern, fold, nfa).alternation(own)] = k
    sets = {s[0] for s in nfa.step if s}
    signs = np.array([[b in s for s in sets] for b in range(256)])
    _, classes = np.unique(signs, axis=0, return_inverse=True)
    classes = classes.ravel()
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]

    def close(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def thinned(states: set[int]) -> set[int]:
        """Without states that another of their chain stands for."""
        top: dict[int, int] = {}
        for s in states:
            if r := nfa.rank[s]:
                top[r[0]] = max(top.get(r[0], -1), r[1])
        return {s for s in states if not nfa.rank[s] or nfa.rank[s][1] == top[nfa.rank[s][0]]}

    first = close({root})
    index, order, rows = {first: 0}, [first], []
    for subset in order:  # grows meanwhile
        row = []
        for b in sample:
            to = {nfa.step[s][1] for s in subset if nfa.step[s] and b in nfa.step[s][0]}
            nxt = close(thinned(to) | (set() if anchored else {root}))
            if nxt not in index:
                index[nxt] = len(order)
                order.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    accepts = np.array([sum(1 << k for k in {finals[s] for s in subset if s in finals}) for subset in order])
    return _minimised(np.array(rows), classes, accepts)


def _minimised(table: np.ndarray, classes: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merges states that no input tells apart: blocks are refined by the blocks of their successors until none splits."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.array([int(np.flatnonzero(block == k)[0]) for k in range(block.max() + 1)])
    return Automaton(block[table[first]].astype(np.int32), classes.astype(np.uint8), accepts[first], int(block[0]))


LANE, BEFORE = 2048, 48
_LANES = 2048


def scan(texts: list[bytes], dfa: Automaton) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the bytes at which a rule accepts, rising, and the bits of the rules."""
    flat = dfa.table.ravel()
    width = dfa.table.shape[1]
    lanes = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), LANE)]
    lanes.sort(key=lambda x: -min(LANE, len(texts[x[0]]) - x[1]))
    hits: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    ends: dict[tuple[int, int], int] = {}
    guess: dict[tuple[int, int], int] = {}

    def run(group: list[tuple[int, int]], states: np.ndarray, back: int) -> tuple[np.ndarray, np.ndarray]:
        """back 0: from at over the lane; else over the `back` bytes before it. All states by step, and lengths."""
        spans = [(texts[k], at - back if back else at, at if back else min(at + LANE, len(texts[k]))) for k, at in group]
        size = np.array([b - a for _, a, b in spans])
        most = int(size.max())
        data = np.zeros((len(group), most), np.uint8)
        for i, (t, a, b) in enumerate(spans):
            data[i, : b - a] = np.frombuffer(t, np.uint8, b - a, a)
        cls = dfa.classes[data.T]
        trace = np.empty((most, len(group)), np.int32)
        live = np.searchsorted(-size, -np.arange(most), side="left")  # lanes are sorted by length, falling
        s = states.copy()
        for i in range(most):
            n = live[i]
            s[:n] = flat[s[:n] * width + cls[i, :n]]
            trace[i] = s
        return trace, size

    def keep(group: list[tuple[int, int]], trace: np.ndarray, size: np.ndarray) -> None:
        acc = dfa.accepts[trace]
        acc[np.arange(len(trace))[:, None] >= size] = 0
        lane, step = np.nonzero(acc.T)
        cut = np.searchsorted(lane, np.arange(len(group) + 1))
        for i, key in enumerate(group):
            ends[key] = int(trace[size[i] - 1, i])
            own = step[cut[i] : cut[i + 1]]
            hits[key] = (own + key[1], acc[own, i]) if len(own) else _NONE

    for g in range(0, len(lanes), _LANES):
        group = lanes[g : g + _LANES]
        states = np.full(len(group), dfa.start, np.int64)
        later = [i for i, (_, at) in enumerate(group) if at]
        if later:
            trace, _ = run([group[i] for i in later], np.full(len(later), dfa.start, np.int64), BEFORE)
            states[later] = trace[-1]
        guess.update(zip(group, states.tolist()))
        keep(group, *run(group, states, 0))
    out = []
    for k, t in enumerate(texts):
        where, which = [], []
        for at in range(0, len(t), LANE):
            key = (k, at)
            if at and guess[key] != ends[k, at - LANE]:
                keep([key], *run([key], np.array([ends[k, at - LANE]], np.int64), 0))
            if len(hits[key][0]):
                where.append(hits[key][0])
                which.append(hits[key][1])
        out.append((np.concatenate(where), np.concatenate(which)) if where else _NONE)
    return out


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


class Scanner:
    def __init__(self, rules=tuple(RULES)):
        self.rules = rules
        self.dfa = compile_rules([(p, f) for _, p, f, _ in rules])
        self.single = [compile_rules([(p, f)], anchored=True) for _, p, f, _ in rules]
        self.firsts = [frozenset(b for b in range(256) if self._survives(a, b)) for a in self.single]

    @staticmethod
    def _survives(a: Automaton, b: int) -> bool:
        """Whether a match can begin with this byte."""
        seen, todo = set(), [int(a.table[a.start, a.classes[b]])]
        while todo:
            s = todo.pop()
            if a.accepts[s]:
                return True
            if s not in seen:
                seen.add(s)
                todo += set(a.table[s].tolist())
        return False

    def _match(self, rule: int, t: bytes, at: int) -> int:
        """Where the longest match that starts at `at` ends, -1 without one."""
        a = self.single[rule]
        s, best, dead = a.start, -1, self._dead(rule)
        for i in range(at, len(t)):
            s = int(a.table[s, a.classes[t[i]]])
            if s == dead:
                break
            if a.accepts[s]:
                best = i + 1
        return best

    @lru_cache(None)  # noqa: B019  as many entries as rules
    def _dead(self, rule: int) -> int:
        a = self.single[rule]
        return next((s for s in range(a.states) if not a.accepts[s] and (a.table[s] == s).all()), -1)

    def spans(self, t: bytes, where: np.ndarray, which: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and rule; matches that are too short take up their text, but are left out."""
        out = []
        for r, (kind, _, _, least) in enumerate(self.rules):
            ends = where[(which >> r) & 1 == 1]
            if not len(ends):
                continue
            done = 0
            for run in np.split(ends, np.flatnonzero(np.diff(ends) != 1) + 1):
                first, last = int(run[0]), int(run[-1])
                at = self._earliest(r, t, done, first)
                while at <= last:
                    end = self._match(r, t, at) if t[at] in self.firsts[r] else -1
                    if end < 0:
                        at += 1
                        continue
                    if (self._value(t, at, end) if kind == "assign" else end - at) >= least:
                        out.append((at, end, r))
                    at = done = end
        return sorted(out, key=lambda x: (x[0], x[2]))

    def _earliest(self, rule: int, t: bytes, done: int, first: int) -> int:
        """A place at or before the first start whose match takes in byte `first`, not before `done`: back over bytes that a match can hold."""
        reach = self._alphabet(rule)
        at = first
        while at > done and t[at - 1] in reach:
            at -= 1
        return at

    @lru_cache(None)  # noqa: B019
    def _alphabet(self, rule: int) -> frozenset[int]:
        """Bytes that can stand inside a match of the rule."""
        a, dead = self.single[rule], self._dead(rule)
        live = [s for s in range(a.states) if s != dead]
        return frozenset(b for b in range(256) if any(a.table[s, a.classes[b]] != dead for s in live))

    @staticmethod
    def _value(t: bytes, start: int, end: int) -> int:
        """Length of the value of an assignment: what follows the sign, blanks and a quote."""
        sign = next(i for i in range(start, end) if t[i] in b":=")
        value = sign + 1
        while t[value] == 32:
            value += 1
        return end - value - (t[value] in b"\"'")

    def texts(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text, in code points, by start and then as the rules are listed."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        out = []
        for t, (where, which) in zip(raw, scan(raw, self.dfa), strict=True):
            found = self.spans(t, where, which) if len(where) else []
            if found and not t.isascii():
                starts = np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)
                before = lambda i: int(starts[i - 1]) if i else 0
                found = [(before(a), before(b), r) for a, b, r in found]
            out.append([(self.rules[r][0], a, b) for a, b, r in found])
        return out


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def _batched(s: pd.Series, most: int = 4 << 20) -> Iterator[list[str | None]]:
    batch, size = [], 0
    for t in s:
        batch.append(t)
        size += len(t or "")
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


@column_udf("array<struct<kind string, start long, end long>>")
def secret_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All spans of each text."""
    for s in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in found] for batch in _batched(s) for found in scanner().texts(batch)])


@column_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
def _report(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        rows = []
        for batch in _batched(s):
            for found in scanner().texts(batch):
                named = [(k, f"{k}:{a}:{b}") for k, a, b in found]
                base = ",".join(x for k, x in named if k in BASE)
                rows.append((*(sum(k == kind for k, _ in named) for kind in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in named)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of secrets in every text of docs (doc_id, text)."""
    return docs.select("doc_id", _report("text").alias("r")).select("doc_id", "r.*")


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced; of overlapping spans the first counts."""

    @F.pandas_udf("string")
    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for batch in _batched(s):
                for text, found in zip(batch, scanner().texts(batch), strict=True):
                    parts, at = [], 0
                    for _, a, b in found:
                        if a >= at:
                            parts += [text[at:a], mask]
                        at = max(at, b)
                    out.append(text if text is None else "".join(parts) + text[at:])
            yield pd.Series(out)

    return docs.withColumn("text", redact("text"))
