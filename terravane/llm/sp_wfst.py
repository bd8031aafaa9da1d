"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file:

* the normaliser, a transducer of the model's own replacement rules (longest
  match first), which then marks spaces and the beginning of a text;
* the lexicon of pieces, with byte arcs (or the unknown one) for characters that
  no piece covers; user-defined pieces cut a text first (merge models) or weigh
  less than any way through their characters (unigram models);
* the acceptor of piece pairs.

Weights are tropical: a path's weight is the sum of its arcs', and the least one
wins.  For a unigram model a lexicon arc weighs minus the piece's score and the
acceptor weighs nothing.  For a merge model lexicon arcs weigh nothing, and the
acceptor's arc from piece u to piece v weighs 0 if merging the characters of
``uv`` by the model's scores yields exactly ``u, v``, and infinity otherwise: the
one sequence whose neighbours all weigh 0 is the model's own encoding.  The
composition with a text is lazy: arcs are weighed when first met, and as a merge
model has one state of finite weight at a position, the search goes depth first
there.  Where no piece can span a space, texts are cut there and the paths of the
parts are remembered in a bounded table.

Defined results: a null or empty text has no ids; U+2581 in a text decodes as a
space, as in the model; byte pieces that are not UTF-8 decode as U+FFFD; a model
of words or characters, or with whitespace as a suffix, is refused when it is
read; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hold, ship

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGE = 1, 2
#: What an unknown character weighs beyond the worst piece of a unigram model.
UNKNOWN_WEIGHT = 10.0
PARTS_KEPT, PAIRS_KEPT = 300_000, 250_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = s = 0
        while True:
            b = raw[i]
            i += 1
            v |= (b & 127) << s
            s += 7
            if b < 128:
                return v

    while i < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, raw[i : i + n]
        i += n


def replacements(table: bytes) -> dict[bytes, bytes]:
    """The rules of a compiled character map: a double-array trie of UTF-8 prefixes, then the replacements, each ended by a zero.

    The units are the public double-array format: label in the low byte, offset
    above bit 10 (shifted on by bit 9 into the high range), a leaf flag in bit 8.
    """
    if len(table) < 4:
        return {}
    size = int.from_bytes(table[:4], "little")
    units, text = np.frombuffer(table[4 : 4 + size], "<u4").tolist(), table[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules: dict[bytes, bytes] = {}
    stack = [(offset(units[0]), b"")]
    while stack:
        node, key = stack.pop()
        for c in range(1, 256):
            at = node ^ c
            if at < len(units) and units[at] & (1 << 31 | 255) == c:
                unit, longer = units[at], key + bytes([c])
                child = at ^ offset(unit)
                if unit >> 8 & 1:
                    value = units[child] & ((1 << 31) - 1)
                    rules[longer] = text[value : text.index(b"\0", value)]
                stack.append((child, longer))
    return rules


class Normaliser:
    """Replaces the longest rule that fits at each place; what none fits stays."""

    def __init__(self, rules: dict[bytes, bytes]):
        self.rules = {k.decode("utf-8", "surrogateescape"): v.decode() for k, v in rules.items()}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True)))) if self.rules else None

    def __call__(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.rules[m[0]], text) if self.pattern else text


class Transducer:
    """Compiled from a SentencePiece model of merge (BPE) or unigram type."""

    def __init__(self, path: str | bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        norm = {1: b"identity", 2: b"", 3: 1, 4: 1, 5: 1}
        trainer: dict[int, int | bytes] = {}
        if isinstance(path, bytes):
            model = path
        else:
            with open(path, "rb") as f:
                model = f.read()
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                scores.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), np.float32)[0]))
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm |= dict(_fields(value))
        self.type = trainer.get(3, UNIGRAM)
        if self.type not in (UNIGRAM, MERGE) or trainer.get(24) or not norm[5]:
            raise ValueError("only unigram and merge models with escaped spaces in front of words are compiled")
        self.rules, self.dummy, self.squeeze = Normaliser(replacements(norm[2])), bool(norm[3]), bool(norm[4])
        usable = (NORMAL, USER) if self.type == MERGE else (NORMAL, USER, UNUSED)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in usable and k != UNUSED}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.single = [np.float32(x) for x in scores]
        normal = [scores[i] for p, i in self.ids.items() if self.kinds[i] == NORMAL]
        self.worst, self.best = (min(normal), max(normal)) if normal else (0.0, 0.0)
        own = [p for p, i in self.ids.items() if self.kinds[i] == USER]
        for p in own if self.type == UNIGRAM else ():
            # a user-defined piece outweighs any way through its characters
            self.single[self.ids[p]] = np.float32(len(p) * self.best - 0.1)
        self.user = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own and self.type == MERGE else None
        #: every beginning of a piece; the piece's id where it ends, else -1
        self.arcs = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids) or self.user is not None
        self.cut = None if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._pairs: dict[int, bool] = {}
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._bytes = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def normalise(self, text: str) -> str:
        if self.rules.pattern:
            text = self.rules(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged by score, leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weigh(self, u: int, v: int) -> bool:
        """Whether the pair acceptor's arc from u (-1 at a beginning or after bytes) to v weighs 0."""
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        left, right = self.pieces[u] if u >= 0 else "", self.pieces[v]
        free = self._pairs[(u + 1) * len(self.pieces) + v] = self.merged(left + right) == ([left, right] if left else [right])
        return free

    def lone(self, text: str) -> list[int]:
        """The ids of characters that no piece covers."""
        return [self.byte[b] for b in text.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def lightest(self, text: str) -> list[int]:
        """The ids on the path of least weight through one normalised part, by a unigram model's scores.

        Every prefix keeps its lightest path, of equal ones the one met first.
        """
        n, arcs = len(text), self.arcs.get
        # single precision, as the model's scores: ties of reordered pieces fall as they do in the library
        weight, back = [np.float32(0)] + [np.float32(np.inf)] * n, [(0, -1)] * (n + 1)
        far = np.float32(UNKNOWN_WEIGHT) - np.float32(self.worst)
        for at in range(n):
            here, j, single = weight[at], at + 1, False
            while j <= n:
                v = arcs(text[at:j])
                if v is None:
                    break
                if v >= 0:
                    w = here - self.single[v]
                    if w < weight[j]:
                        weight[j], back[j] = w, (at, v)
                    single |= j == at + 1
                j += 1
            if not single and here + far < weight[at + 1]:
                weight[at + 1], back[at + 1] = here + far, (at, -1)
        spans, j = [], n
        while j:
            at, v = back[j]
            spans.append((at, j, v))
            j = at
        out: list[int] = []
        for at, j, v in reversed(spans):
            if v >= 0:
                out.append(v)
            elif self.byte or not (out and out[-1] == self.unknown):
                out += self.lone(text[at:j])
        return out

    def path(self, text: str) -> list[int]:
        """The ids of one normalised part; user-defined pieces cut it first."""
        find = self.lightest if self.type == UNIGRAM else self.shortest_path
        if self.user is None:
            return find(text)
        out: list[int] = []
        at = 0
        for m in self.user.finditer(text):
            out += [*find(text[at : m.start()]), self.ids[m[0]]]
            at = m.end()
        return out + find(text[at:])

    def shortest_path(self, text: str) -> list[int]:
        """The ids on the path of weight 0 through the composition with one normalised part.

        Depth first, longest arcs first; as each position has one state of finite
        weight, a position left without a way on is never entered again.
        """
        n, size = len(text), len(self.pieces)
        arcs, known, weigh = self.arcs.get, self._pairs.get, self.weigh

        def leaving(at: int) -> list[tuple[int, int]]:
            out, j = [], at + 1
            while j <= n:
                v = arcs(text[at:j])
                if v is None:
                    break
                if v >= 0:
                    out.append((j, v))
                j += 1
            # the bytes of a character that is no piece: last, after the longer pieces that it begins
            return out if out and out[0][0] == at + 1 else [(at + 1, -1), *out]

        path, dead = [(0, leaving(0) if n else [], -1)], set()
        while (top := path[-1])[0] < n:
            at, ways, last = top
            while ways:
                end, v = ways.pop()
                if end not in dead:
                    free = v < 0 or known((last + 1) * size + v)
                    if free or free is None and weigh(last, v):
                        path.append((end, leaving(end) if end < n else ways, v))
                        break
            else:
                dead.add(at)
                path.pop()
                if not path:  # pairs of neighbours do not decide this text: its characters are merged as a whole
                    return [i for p in self.merged(text) for i in ([self.ids[p]] if p in self.ids else self.lone(p))]
        out: list[int] = []
        for k in range(1, len(path)):
            end, _, v = path[k]
            if v >= 0:
                out.append(v)
            elif self.byte or not (out and out[-1] == self.unknown):
                out += self.lone(text[end - 1])
        return out

    def _part(self, part: str) -> bytes:
        got = self._older.get(part)
        if got is None:
            got = np.array(self.path(part), np.int32).tobytes()
        if len(part) <= 64:
            if len(self._parts) >= PARTS_KEPT // 2:  # what was not met lately goes
                self._parts, self._older = {}, self._parts
            self._parts[part] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        text = self.normalise(text or "")
        if self.cut is None:
            return np.array(self.path(text), np.int32)
        return np.frombuffer(b"".join([self._parts.get(p) or self._part(p) for p in self.cut.findall(text)]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        pieces = self._bytes
        text = b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    hold("sp_wfst", _compiled.clear)
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """The rows of ``docs`` with the ids of each whole text as array<int>."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                ids = [machine.encode(t) for t in part.column(at).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def encoding_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_bytes, ids_sha256, round_trip): ids hashed as little-endian int32, and whether they decode to the text."""
    ship(docs.sparkSession)
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([plain.schema[0], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_bytes", T.LongType()), ("ids_sha256", T.StringType()), ("round_trip", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        is_byte = np.array(machine.kinds) == BYTE
        for batch in batches:
            n, low, sha, same = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids = machine.encode(t)
                n.append(len(ids))
                low.append(int(is_byte[ids].sum()))
                sha.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                same.append(machine.decode(ids) == (t or "").replace(SPACE, " "))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return plain.mapInArrow(run, schema)
