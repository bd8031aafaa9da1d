r"""Secret scans by grammar inference.

Labelled credentials of a format become a prefix tree; states whose outgoing and
final frequencies and whose distributions of the length still to come are
compatible (Hoeffding bound at ``ALPHA``) are merged, red and blue states, the
most visited first and each with the likest red one, into a probabilistic
automaton.  So positions of a fixed length stay apart and runs of any length
become loops.  An end in a state that no credential ended in is impossible.  In every
run of a text each format's automaton goes forward from each of its prefixes, or
without one from each separator, to the longest end that it accepts by bits of
likelihood against prose and by mean bits a symbol against what the format's own
credentials reach, and on behind that end.  Symbols are character classes; the characters that all labelled
credentials of a format begin with stay literal.

Three plain patterns always hold beside it (kinds ``assign``, ``access``,
``hex``); the automata add spans outside of theirs.

Defined results: a null text is empty; spans count code points, end exclusive,
ordered by start, then kind as listed in ``KINDS``; where automata of two formats
accept parts of one run, the format listed first names it; repeated rows get equal
results, and no row is compared with another; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ALPHA = 0.05
SAMPLES = 500
#: Symbols that a comparison of two states looks ahead; lengths to come are compared whole.
AHEAD = 2
#: Bits of likelihood over prose that a candidate needs.
BITS = 24.0
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SEPARATORS = "+/_.=-"
GAP = re.compile(r"^[+/_.=-]*|[+/_.=-]+")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT
_HEX = "0123456789abcdef"
#: Format: parts of (alphabet, least and greatest length), a literal, or a list of literals.
FORMATS: dict[str, list[str | list[str] | tuple[str, int, int]]] = {
    "aws": ["AKIA", (_UPPER + "234567", 16, 16)],
    "github": ["gh", ["p", "o", "u", "s", "r"], "_", (_ALNUM, 36, 36)],
    "github_fine": ["github_pat_", (_ALNUM, 22, 22), "_", (_ALNUM, 59, 59)],
    "gitlab": ["glpat-", (_ALNUM + "_-", 20, 20)],
    "slack": ["xox", ["b", "p", "a", "r", "s"], "-", (_DIGIT, 10, 13), "-", (_DIGIT, 10, 13), "-", (_ALNUM, 24, 32)],
    "stripe": ["sk_", ["live", "test"], "_", (_ALNUM, 24, 32)],
    "stripe_restricted": ["rk_", ["live", "test"], "_", (_ALNUM, 24, 32)],
    "sk48": ["sk-", (_ALNUM, 48, 48)],
    "google": ["AIza", (_ALNUM + "_-", 35, 35)],
    "npm": ["npm_", (_ALNUM, 36, 36)],
    "huggingface": ["hf_", (_UPPER + _LOWER, 34, 34)],
    "sendgrid": ["SG.", (_ALNUM + "_-", 22, 22), ".", (_ALNUM + "_-", 43, 43)],
    "digitalocean": ["dop_v1_", (_HEX, 64, 64)],
    "jwt": ["eyJ", (_ALNUM + "_-", 20, 60), ".", (_ALNUM + "_-", 30, 120), ".", (_ALNUM + "_-", 43, 43)],
    "random40": [(_ALNUM + "+/", 40, 40)],
}
KINDS = ("assign", "access", "hex", *FORMATS)

#: Shares of the classes in prose.
_PROSE = {"l": 0.62, "h": 0.25, "U": 0.02, "H": 0.01, "0": 0.03}
_class = {c: "h" if c in "abcdef" else "l" for c in _LOWER} | {c: "H" if c in "ABCDEF" else "U" for c in _UPPER} | dict.fromkeys(_DIGIT, "0")


def symbols(text: str) -> list[str]:
    return [_class.get(c, c) for c in text]


def made(kind: str, r: random.Random) -> str:
    """One credential of a format."""
    one = lambda p: p if isinstance(p, str) else r.choice(p) if isinstance(p, list) else "".join(r.choice(p[0]) for _ in range(r.randint(p[1], p[2])))
    return "".join(map(one, FORMATS[kind]))


def labelled(kind: str, count: int = SAMPLES) -> list[str]:
    """Labelled credentials of a format, always the same ones."""
    r = random.Random(f"terravane {kind}")
    return [made(kind, r) for _ in range(count)]


class Automaton:
    """A probabilistic deterministic automaton inferred from symbol sequences; state 0 is the start."""

    def __init__(self, words: list[list[str]], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.hits: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.visits = [0]
        #: Of each state, how many words had how many symbols still to come.
        self.rest: list[dict[int, int]] = [{}]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for w in words:
            at = 0
            self._meet(0, len(w))
            for i, s in enumerate(w, 1):
                if s not in self.next[at]:
                    for table in (self.next, self.hits, self.rest):
                        table.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                    self.next[at][s] = len(self.next) - 1
                self.hits[at][s] = self.hits[at].get(s, 0) + 1
                at = self.next[at][s]
                self._meet(at, len(w) - i)
            self.ends[at] += 1
        self._compact(self._merge_states())

    def _meet(self, state: int, rest: int) -> None:
        self.visits[state] += 1
        self.rest[state][rest] = self.rest[state].get(rest, 0) + 1

    def _apart(self, p: int, q: int) -> float:
        """The greatest gap between the distributions of the lengths to come."""
        n, m, gap, most = self.visits[p], self.visits[q], 0.0, 0.0
        for k in sorted({*self.rest[p], *self.rest[q]}):
            gap += self.rest[p].get(k, 0) / n - self.rest[q].get(k, 0) / m
            most = max(most, abs(gap))
        return most

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue, AHEAD)]
        while todo:
            p, q, ahead = todo.pop()
            n, m = self.visits[p], self.visits[q]
            near = (1 / math.sqrt(n) + 1 / math.sqrt(m)) * self.bound
            if abs(self.ends[p] / n - self.ends[q] / m) >= near or self._apart(p, q) >= near:
                return False
            for s in {*self.next[p], *self.next[q]}:
                if abs(self.hits[p].get(s, 0) / n - self.hits[q].get(s, 0) / m) >= near:
                    return False
                if ahead and s in self.next[p] and s in self.next[q]:
                    todo.append((self.next[p][s], self.next[q][s], ahead - 1))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for k, c in self.rest[q].items():
                self.rest[p][k] = self.rest[p].get(k, 0) + c
            for s, q2 in self.next[q].items():
                self.hits[p][s] = self.hits[p].get(s, 0) + self.hits[q][s]
                if s in self.next[p]:
                    todo.append((self.next[p][s], q2))
                else:
                    self.next[p][s] = q2

    def _merge_states(self) -> list[int]:
        red = [0]
        while True:
            known = set(red)
            blue = [(-self.visits[t], t, p, s) for p in red for s, t in self.next[p].items() if t not in known]
            if not blue:
                return red
            _, b, parent, sym = min(blue)
            # a state met seldom is compatible with many: it goes to the one whose lengths are likest
            fits = [(self._apart(r, b), i) for i, r in enumerate(red) if self._compatible(r, b)]
            if fits:
                r = red[min(fits)[1]]
                self.next[parent][sym] = r
                self._fold(r, b)
            else:
                red.append(b)

    def _compact(self, red: list[int]) -> None:
        number = {r: i for i, r in enumerate(red)}
        self.next = [{s: number[t] for s, t in self.next[r].items()} for r in red]
        self.hits, self.ends, self.visits = ([table[r] for r in red] for table in (self.hits, self.ends, self.visits))
        self.states = list(range(len(red)))
        del self.rest

    def end_bits(self, state: int) -> float:
        return math.log2(self.ends[state] / (self.visits[state] + 1)) if self.ends[state] else -math.inf

    def bits(self, word: list[str]) -> float:
        """log2 of the probability; a step or an end never met is impossible."""
        at, total = 0, 0.0
        for s in word:
            if s not in self.next[at]:
                return -math.inf
            total += math.log2(self.hits[at][s] / (self.visits[at] + 1))
            at = self.next[at][s]
        return total + self.end_bits(at)


class Format:
    def __init__(self, kind: str):
        words = labelled(kind)
        prefix = words[0]
        for w in words:
            while not w.startswith(prefix):
                prefix = prefix[:-1]
        learn, check = words[: len(words) * 3 // 4], words[len(words) * 3 // 4 :]
        self.kind, self.prefix = kind, prefix
        self.machine = Automaton([symbols(w[len(prefix) :]) for w in learn])
        each = [self.machine.bits(symbols(w[len(prefix) :])) / len(w) for w in check]
        each = [e for e in each if e > -math.inf]
        mean = sum(each) / len(each)
        self.least = mean - 4 * (sum((e - mean) ** 2 for e in each) / len(each)) ** 0.5 - 0.05

        n = [v + 1 for v in self.machine.visits]
        known = {x for q in self.machine.states for x in self.machine.next[q]}
        #: The most bits that a symbol, or the end, brings in any state.
        self.most = {x: max(math.log2(self.machine.hits[q][x] / n[q]) for q in self.machine.states if x in self.machine.next[q]) for x in known}
        self.end_bits = {q: self.machine.end_bits(q) for q in self.machine.states}
        chars = "".join(c for c in _ALNUM + SEPARATORS if _class.get(c, c) in known)
        self.body = re.compile(f"[{re.escape(chars)}]*")

    def fits(self, text: str) -> bool:
        if not text.startswith(self.prefix):
            return False
        own = symbols(text[len(self.prefix) :])
        got = self.machine.bits(own)
        prose = sum(math.log2(_PROSE.get(s, 0.005)) for s in symbols(text))
        return got / len(text) >= self.least and got - prose >= BITS

    def _bounds(self, own: list[str]) -> tuple[list[float], list[float]]:
        """At each place of a body, the most that the rest can still add to the bits over prose and over ``least``."""
        over, spare = [0.0], [0.0]
        for s in reversed(own):
            over.append(max(0.0, over[-1] + self.most[s] - math.log2(_PROSE.get(s, 0.005))))
            spare.append(max(0.0, spare[-1] + self.most[s] - self.least))
        return over[::-1], spare[::-1]

    def starts(self, part: str) -> Iterator[int]:
        """Where a credential may start: at the prefix, else after separators, then at those separators from the last back."""
        at = part.find(self.prefix) if self.prefix else -1
        while at >= 0:
            yield at
            at = part.find(self.prefix, at + 1)
        if not self.prefix:
            for m in GAP.finditer(part):
                yield from range(m.end(), m.start() - 1, -1)

    def spans(self, part: str) -> Iterator[tuple[int, int]]:
        """The credentials in a run: from each start the longest end accepted; the search goes on after it."""
        m, done, a, b = self.machine, 0, 0, -1
        for start in self.starts(part):
            i = start + len(self.prefix)
            if start < done:
                continue
            if not a <= i <= b:
                a, b = self.body.match(part, i).span()
                own = symbols(part[a:b])
                over, spare = self._bounds(own)
            state, got, prose, end = 0, 0.0, sum(math.log2(_PROSE.get(s, 0.005)) for s in symbols(self.prefix)), -1
            while True:
                total = got + self.end_bits[state]
                if total - prose >= BITS and total / (i - start) >= self.least:
                    end = i
                if i == b or got - prose + over[i - a] < BITS - 1e-6 or got - self.least * (i - start) + spare[i - a] < -1e-6:
                    break
                s = own[i - a]
                if s not in m.next[state]:
                    break
                got += math.log2(m.hits[state][s] / (m.visits[state] + 1))
                prose += math.log2(_PROSE.get(s, 0.005))
                state = m.next[state][s]
                i += 1
            if end >= 0:
                bare = start + len(part[start:end].rstrip("./="))  # what closes a sentence or a path is not the credential's
                end = bare if bare < end and self.fits(part[start:bare]) else end
                yield start, end
                done = end


@cache
def formats() -> tuple[Format, ...]:
    return tuple(Format(k) for k in FORMATS)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):
        a, part = run.start(), run[0]
        if "AKIA" in part:
            out += [(a + m.start(), "access", a + m.end()) for m in ACCESS.finditer(part) if len(m[0]) >= 16]
        if len(part) >= 32:
            out += [(a + m.start(), "hex", a + m.end()) for m in HEX.finditer(part)]
    return out


def inferred_spans(text: str, base: list[tuple[int, str, int]], machines: tuple[Format, ...]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates that an automaton accepts, outside of the base spans."""
    out: list[tuple[int, str, int]] = []
    for run in RUN.finditer(text):
        known = [(s, t) for s, _, t in base if s < run.end() and t > run.start()]
        for f in machines:
            for a, e in f.spans(run[0]):
                a, e = run.start() + a, run.start() + e
                # a part of a credential that another format names is not one more
                if not any(s <= a and e <= t for s, t in known):
                    out.append((a, f.kind, e))
                    if f.prefix:
                        known.append((a, e))
    return out


def scan(text: str | None, machines: tuple[Format, ...] | None = None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans, each in order."""
    text = text or ""
    base = base_spans(text)
    order = lambda spans: sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))
    return order(base), order(base + inferred_spans(text, base, machines or formats()))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{e}" for a, k, e in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    ship(docs.sparkSession)
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    schema = T.StructType([plain.schema[0], *counts, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    machines = formats()  # inferred once, here; a few hundred states go along with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, every = scan(t, machines)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=schema.names)

    return plain.mapInArrow(run, schema)
