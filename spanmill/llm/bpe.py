"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The transducer reads the bytes of one pre-token from left to right. A chain of tokens is the BPE
encoding of its bytes exactly if every two neighbours are "compatible", that is if no merge ever
crosses the seam between them, so for every prefix the last token is unique. A state holds the places
where an unfinished token may have started - the place in the trie of the vocabulary, and the token
before it - and the last token of the prefix read so far, which is what the state puts out. States and
transitions are made when first met; when MAX_STATES are kept all are forgotten and made anew as
needed, whatever the pre-token. Tokens are emitted as soon as the chains to all places that are still
open share them: the lookahead is bounded by the longest entries.

The decoder runs a UTF-8 state machine over all bytes, in lockstep from every lead byte.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import drop_clashing, trim

#: States, compatible pairs and pre-tokens kept per Python worker while a task runs.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 100_000, 100_000, 120_000
#: Bytes of one pre-token after which what is decided is emitted.
FLUSH = 4096
#: Rank of a pair that never merges.
NONE = 1 << 60
#: In place of a token: nothing before (at the start), no chain ends here.
START, OPEN = -1, -2
#: Rows a returned Arrow batch holds at most, and characters after which one is sent earlier.
OUT_ROWS, OUT_CHARS = 1_000, 8_000_000
#: Pre-tokens, and ids, handled at a time within one text.
CHUNK = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Transducer:
    """BPE of one pre-token at a time; ids come packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.pairs: dict[int, bool] = {}
        self.steps = 0
        top = max(self.tokens, default=0) + 1
        self.left, self.right, self.length = [-1] * top, [-1] * top, [0] * top
        self.ordered, reached = True, []
        for i in sorted(self.tokens):
            token = self.tokens[i]
            self.length[i] = len(token)
            if len(token) == 1 or self._split(i, token):
                reached.append(token)
            elif self.merge(token) == [token]:  # made of tokens of a higher rank: seams can't be told by ranks
                self.ordered = False
                reached.append(token)
        if not self.ordered:
            reached = [t for t in ranks if self.merge(t) == [t]]
        self.pairs.clear()
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node; the root is 0
        self.token_at, self.inner, self.depth = [-1], bytearray(1), [0]
        for token in reached:
            node = 0
            for d, b in enumerate(token, 1):
                self.inner[node] = 1
                key = node << 8 | b
                node = self.trie.get(key, 0)
                if not node:
                    node = self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.depth.append(d)
            self.token_at[node] = ranks[token]
        self.reset()

    def _split(self, i: int, token: bytes) -> bool:
        """Finds the two tokens of lower rank that the merge of rank i joins."""
        rank = self.ranks.get
        for k in range(1, len(token)):
            a, b = rank(token[:k], NONE), rank(token[k:], NONE)
            if a < i and b < i and self._seam(a, b, i):
                self.left[i], self.right[i] = a, b
                return True
        return False

    def reset(self) -> None:
        """Forget all states but the start, which is 0."""
        self.ids: dict[tuple, int] = {(START,): 0}
        self.keys: list[tuple] = [(START,)]  # the last token, then node and token before it of every open place
        self.last: list[int] = [START]
        self.goto: dict[int, int] = {}  # state << 8 | byte -> state

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE: merge the adjacent pair of lowest rank, leftmost first, while there is one."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        ranks = [rank(a + b, NONE) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NONE)
        return parts

    def _seam(self, a: int, b: int, below: int = NONE) -> bool:
        """Whether no merge of a rank lower than `below` ever joins what stands on both sides of the seam of a and b.

        Merges happen in the order of rank. Going back in time, a falls apart to its right part and b to its left one;
        neighbours x, y join if their merge comes before those that took x and y away. Of equal ranks the left goes first.
        """
        rank, tokens, left, right = self.ranks.get, self.tokens, self.left, self.right
        end_a = end_b = below
        while True:
            m = rank(tokens[a] + tokens[b], NONE)
            if m < end_a and (m < end_b or m == end_b != below):
                return False
            if a > b and right[a] >= 0 or left[b] < 0:
                if right[a] < 0:
                    return True
                end_a, a = a, right[a]
            else:
                end_b, b = b, left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            x, y = self.tokens[a], self.tokens[b]
            ok = self.pairs[key] = self._seam(a, b) if self.ordered else self.merge(x + y) == [x, y]
        return ok

    def step(self, s: int, byte: int) -> int:
        """Makes the transition from state s on byte, and its state if that is new."""
        self.steps += 1
        key = self.keys[s]
        child, token_at, inner, pairs = self.trie.get, self.token_at, self.inner, self.pairs.get
        here, live = OPEN, []
        for k in range(1, len(key), 2):
            node = child(key[k] << 8 | byte)
            if node is not None:
                before = key[k + 1]
                if here == OPEN and (token := token_at[node]) >= 0:
                    ok = True if before < 0 else pairs(before << 32 | token)
                    if ok or ok is None and self.compatible(before, token):
                        here = token
                if inner[node]:
                    live += (node, before)
        if key[0] != OPEN and (node := child(byte)) is not None:  # a token may start here
            before = key[0]
            if here == OPEN and (token := token_at[node]) >= 0:
                ok = True if before < 0 else pairs(before << 32 | token)
                if ok or ok is None and self.compatible(before, token):
                    here = token
            if inner[node]:
                live += (node, before)
        key = (here, *live)
        found = self.goto[s << 8 | byte] = self.state(key)
        return found

    def state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.last.append(key[0])
        return found

    def decided(self, s: int, labels: list[int]) -> int:
        """The place up to which the chains to all open places of state s agree; labels are the last tokens so far."""
        key, end, length = self.keys[s], len(labels), self.length
        open_ = {end - self.depth[n] for n in key[1::2]}
        if key[0] != OPEN:
            open_.add(end)
        while len(open_) > 1:
            far = max(open_)
            open_.remove(far)
            open_.add(far - length[labels[far - 1]])
        return open_.pop()

    def chain(self, labels: list[int], end: int) -> bytes:
        """The tokens up to a place, packed."""
        out, length, packed = [], self.length, self.packed
        while end:
            token = labels[end - 1]
            out.append(packed[token])
            end -= length[token]
        out.reverse()
        return b"".join(out)

    def encode(self, data: bytes) -> bytes:
        """Ids of one pre-token of any length. States are forgotten between pre-tokens, and within long ones."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        if len(data) > FLUSH:
            return self._encode_long(data)
        s, states, goto = 0, [], self.goto.get
        for b in data:
            n = goto(s << 8 | b)
            s = self.step(s, b) if n is None else n
            states.append(s)
        out, end, last, length, packed = [], len(states), self.last, self.length, self.packed
        while end:
            token = last[states[end - 1]]
            out.append(packed[token])
            end -= length[token]
        out.reverse()
        return b"".join(out)

    def _encode_long(self, data: bytes) -> bytes:
        s, labels, out = 0, [], []
        for b in data:
            n = self.goto.get(s << 8 | b)
            s = self.step(s, b) if n is None else n
            labels.append(self.last[s])
            if len(labels) >= FLUSH and (cut := self.decided(s, labels)) > FLUSH // 2:
                out.append(self.chain(labels, cut))
                del labels[:cut]
            if len(self.keys) > MAX_STATES:
                key = self.keys[s]
                self.reset()
                s = self.state(key)
        out.append(self.chain(labels, len(labels)))
        return b"".join(out)


class Pieces(dict):
    """Pre-token -> packed ids, filled through the transducer. When full it becomes the elder table, from
    which pieces that are still in use come back."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst, self.elder, self.cold = fst, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.elder.get(piece)
        if ids is None:
            self.cold += 1
            ids = self.fst.encode(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > MAX_PIECES:
            self.elder = dict(self)
            self.clear()


def narrow(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of code points below 256, for the standard library's faster engine."""
    sets = {name: "".join(re.escape(c) for c in map(chr, range(256)) if regex.fullmatch(rx, c)) for name, rx in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s"))}
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{sets['s']}{sets['L']}{sets['N']}]")
    out = out.replace(r"\p{L}", f"[{sets['L']}]").replace(r"\p{N}", f"[{sets['N']}]").replace(r"\s", f"[{sets['s']}]").replace(r"\S", f"[^{sets['s']}]")
    return None if re.search(r"\\[pPwWdDbBhX]", out) else re.compile(out)


class Codec:
    """Encoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.wide, self.narrow = regex.compile(pattern), narrow(pattern)
        self.fst = Transducer(read_ranks(path))
        self.pieces = Pieces(self.fst)

    def pattern(self, text: str):
        """The splitter for a text; both give the same pieces."""
        if self.narrow is None:
            return self.wide
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide
        return self.narrow

    def encode(self, text: str) -> bytes:
        self.pieces.turn()
        look, split = self.pieces.__getitem__, self.pattern(text)
        if len(text) <= CHUNK:
            return b"".join(map(look, split.findall(text)))
        found, out = (m.group() for m in split.finditer(text)), []
        while part := list(islice(found, CHUNK)):
            out.append(b"".join(map(look, part)))
            self.pieces.turn()
        return b"".join(out)


def decode_ids(ids: bytes, bytes_of: dict[int, bytes]) -> str:
    """Text of packed ids. Ids outside the vocabulary and bytes that are not UTF-8 become U+FFFD."""
    stream, out = Utf8Stream(), []
    codes = np.frombuffer(ids, "<u4")
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK].tolist()
        try:
            data = b"".join(map(bytes_of.__getitem__, part))
        except KeyError:
            data = b"".join(bytes_of.get(i, b"\xef\xbf\xbd") for i in part)
        out.append(stream.feed(data))
    out.append(stream.close())
    return "".join(out)


#: Classes of bytes: (low, high, class). Fixed values of UTF-8 (RFC 3629).
BYTE_CLASSES = [
    (0x00, 0x7F, 0),
    (0x80, 0x8F, 1),
    (0x90, 0x9F, 2),
    (0xA0, 0xBF, 3),
    (0xC2, 0xDF, 4),
    (0xE0, 0xE0, 5),
    (0xE1, 0xEC, 6),
    (0xED, 0xED, 7),
    (0xEE, 0xEF, 6),
    (0xF0, 0xF0, 8),
    (0xF1, 0xF3, 9),
    (0xF4, 0xF4, 10),
]
#: state -> {byte class: next state}. 0: between characters; what is missing is an error.
MOVES = {
    0: {0: 0, 4: 1, 5: 2, 6: 3, 7: 4, 8: 5, 9: 6, 10: 7},
    1: {1: 0, 2: 0, 3: 0},
    2: {3: 1},
    3: {1: 1, 2: 1, 3: 1},
    4: {1: 1, 2: 1},
    5: {2: 3, 3: 3},
    6: {1: 3, 2: 3, 3: 3},
    7: {1: 3},
}


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte, and the next state by state and class; state 8 is an error, class 11 no byte of UTF-8."""
    kinds, moves = np.full(256, 11, np.uint8), np.full((9, 12), 8, np.uint8)
    for low, high, kind in BYTE_CLASSES:
        kinds[low : high + 1] = kind
    for state, ways in MOVES.items():
        for kind, to in ways.items():
            moves[state, kind] = to
    return kinds, moves


class Utf8Stream:
    """Incremental UTF-8: what a chunk leaves unfinished (three bytes at most) waits for the next one.

    The machine is started at every byte that no character before it has taken and run in lockstep, which takes as many
    steps as a character has bytes. An error puts out U+FFFD for the longest start of a character and goes on behind it.
    """

    def __init__(self):
        self.rest = b""

    def feed(self, chunk: bytes, last: bool = False) -> str:
        data = self.rest + chunk
        self.rest = b""
        if data.isascii():  # the machine stays in state 0
            return data.decode("ascii")
        kinds, moves = _machine()
        raw = np.frombuffer(data, np.uint8)
        kind = kinds[raw]
        starts = np.flatnonzero((kind == 0) | (kind >= 4))
        state = moves[0, kind[starts]]
        code = np.where(kind[starts] == 0, raw[starts], raw[starts] & np.array([0] * 4 + [0x1F] + [0xF] * 3 + [7] * 3 + [0], np.uint8)[kind[starts]]).astype(np.uint32)
        size = np.ones(len(starts), np.int64)
        going = np.flatnonzero((state != 0) & (state != 8))
        for k in range(1, 4):
            at = starts[going] + k
            inside = at < len(raw)
            going, at = going[inside], at[inside]
            to = moves[state[going], kind[at]]
            good = to != 8
            state[going[~good]] = 8
            going, at, to = going[good], at[good], to[good]
            code[going] = code[going] << 6 | raw[at] & 0x3F
            size[going] += 1
            state[going] = to
            going = going[to != 0]
        if len(starts) and not last and 0 < state[-1] < 8:  # unfinished at the end
            cut = int(starts[-1])
            self.rest = data[cut:]
            starts, state, code, size, end = starts[:-1], state[:-1], code[:-1], size[:-1], cut
        else:
            end = len(raw)
        code = np.where(state == 0, code, 0xFFFD)
        gaps = np.diff(np.append(starts, end)) - size  # bytes that nothing has taken: an error each
        if len(starts) == 0 or starts[0] > 0 or gaps.any():
            first = int(starts[0]) if len(starts) else end
            code = np.concatenate([np.full(first, 0xFFFD, np.uint32), np.repeat(code, 1 + gaps)])
            heads = np.concatenate([np.arange(first), first + np.cumsum(np.append(0, 1 + gaps))[:-1]]).astype(np.int64)
            own = np.zeros(len(code), bool)
            own[heads[first:]] = True
            code[~own] = 0xFFFD
        return code.astype("<u4").tobytes().decode("utf-32-le")

    def close(self) -> str:
        return self.feed(b"", last=True)


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    gc.set_threshold(100_000, 50, 50)  # the tables hold many small objects, none of them garbage
    return Codec(path, pattern)


@lru_cache(2)
def bytes_of(path: str) -> dict[int, bytes]:
    return {i: t for t, i in read_ranks(path).items()}


def release() -> None:
    """At the end of a task: a worker that goes on to other work keeps no tables, and gives its memory back."""
    codec.cache_clear()
    bytes_of.cache_clear()
    trim()


def _with_columns(batch: pa.RecordBatch, **new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def _slices(batch: pa.RecordBatch, sizes) -> Iterator[pa.RecordBatch]:
    at = total = 0
    for i, k in enumerate(sizes):
        total += k or 0
        if i + 1 - at >= OUT_ROWS or total >= OUT_CHARS:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", n: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """All columns of df, with `ids` (packed little-endian uint32) and `n` (their number, long).

    With `decoded`, the ids are decoded again in the same pass, into a column of that name.
    A null or empty text has no tokens. Columns of df named like a result column give way to it.
    Rows are independent: repeated rows stay, an empty table stays empty, nothing is shuffled.
    """
    df = drop_clashing(df, ids, n, *([decoded] if decoded else []))
    extra = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n, T.LongType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        try:
            for whole in batches:
                col = whole.column(whole.schema.names.index(text))
                for batch in _slices(whole, pc.utf8_length(col).to_pylist()):
                    texts = batch.column(batch.schema.names.index(text)).to_pylist()
                    out = [c.encode(t) if t else b"" for t in texts]
                    new = {ids: pa.array(out, pa.binary()), n: pa.array([len(x) // 4 for x in out], pa.int64())}
                    if decoded:
                        new[decoded] = pa.array([decode_ids(x, c.fst.tokens) for x in out], pa.string())
                    yield _with_columns(batch, **new)
        finally:
            del c
            release()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """All columns of df, with the text `decoded` from the packed `ids`; null ids give an empty text."""
    df = drop_clashing(df, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_of(path)
        try:
            for whole in batches:
                col = whole.column(whole.schema.names.index(ids))
                for batch in _slices(whole, pc.binary_length(col).to_pylist()):
                    packed = batch.column(batch.schema.names.index(ids)).to_pylist()
                    yield _with_columns(batch, **{decoded: pa.array([decode_ids(x, table) if x else "" for x in packed], pa.string())})
        finally:
            del table
            release()

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts: encoded, and decoded from the ids."""
    done = encode(df.select("doc_id", "text"), path, pattern, decoded="decoded").drop("text")
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
