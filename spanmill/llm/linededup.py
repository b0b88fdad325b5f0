"""Line dedup by a set-similarity join.

A line is the set of its lower-cased words. A line is removed if an earlier one - by doc_id, then by its place
- has a Jaccard similarity of LEAST or more with it, whether or not the earlier one stays itself.

1. One pass reads the texts and writes for each line its tokens and their digest. Equal lines of one block of documents
   are told apart there, before anything is shuffled.
2. Counts of the tokens of these lines, in a sketch of fixed size (a hash table of 2^BITS sums), give the global order,
   rarest first (by classes of an eighth of an octave, then by hash). Any fixed order gives the same result; the counts
   only make the lists short. Cells that hold a frequent word stand out at any size of the corpus. Each line has its
   prefix n - ceil(LEAST n) + 1 in that order. Lines with equal sets meet by digest, sorted, so that no group has to fit
   into memory; all but the first are removed.
3. The prefixes of first lines are dealt by token in packed form. The list of a token that occurs more than HOT times is
   dealt in as many parts. Pairs in a list pass the length, the positional and a filter by counters. Each list gives every
   line with its head, the earliest line of the list, and with the earlier line whose counters are nearest, to verify on
   their whole sets; and the postings that have any other partner than the head. Within a group of copies, exact or near,
   these two settle almost every line without pairing the group's members.
4. Postings with partners are joined by token, for pairs whose later line is not settled and that a bitmap of 256 bits,
   which goes with the postings, does not tell apart. These are verified.

Words are compared by 40 bits of their hash: two different words are taken for one with a chance of 1e-12.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import Marks, cut, discard, summed, trimmed, unused

#: Least similarity, as a fraction; size of the table of word counts, as a power of two.
LEAST_NUM, LEAST_DEN, BITS = 4, 5, 20
#: Lines sorted at a time, as a power of two.
LINE_BITS = 18
#: Bits of the class of a token's count; bytes of its hash that are stored.
CLASS_BITS, WIDTH = 8, 5
#: Postings of a list, or of a part of a hot one.
HOT = 4096
#: First lines whose postings are packed at a time; packs of postings for each shuffle partition, at least, and postings of a pack, about;
#: lines whose prefixes are made at a time.
PACK, PACKS, PACK_POSTINGS, PREFIXED = 40_000, 4, 1 << 20, 5_000
U = np.uint64
GAMMA, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: A posting: token, part of a hot list (0: of none), words, place in the prefix; the line: order of its document, row,
#: number, counters.
POSTING = np.dtype([("token", "<u4"), ("part", "<u4"), ("n", "<u4"), ("i", "<u4"), ("line", "<i4"), ("ord", "<i8"), ("row", "<i8"), ("bits", "<u8")])
#: Pairs of postings compared at a time.
STEP = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 (public domain)."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def hashes(words, n: int) -> np.ndarray:
    """XXH64, the same on every machine."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U, n)


def prefix_size(n):
    """n - ceil(4 n / 5) + 1, exactly."""
    return n - (LEAST_NUM * n + LEAST_DEN - 1) // LEAST_DEN + 1


def _lines(texts: list) -> Iterator[tuple]:
    """Blocks of non-blank lines: text's number, line number, size, digests, bitmap, tokens; and texts without any."""
    owner, number, parts = [], [], []
    for i, t in enumerate(texts):
        for j, line in enumerate((t or "").lower().split("\n")):
            ws = line.split()
            if ws:
                owner.append(i)
                number.append(j)
                parts.append(ws)
                if len(parts) == 1 << LINE_BITS:
                    yield np.array(owner), np.array(number), *_block(parts)
                    owner, number, parts = [], [], []
    if parts:
        yield np.array(owner), np.array(number), *_block(parts)


def _binaries(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes cut into values of the given sizes."""
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])


def _stored(tokens: np.ndarray) -> np.ndarray:
    """The WIDTH bytes of each token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])


def _joined(col: pa.Array) -> np.ndarray:
    """All bytes of a column of binaries, one after another."""
    col = col.drop_null()
    _, cuts, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros(0, np.uint8)
    cuts = np.frombuffer(cuts, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]


def _loaded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens, and all tokens, of a column of them."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) // WIDTH
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :WIDTH] = _joined(col).reshape(-1, WIDTH)
    return sizes, raw.view("<u8")[:, 0].astype(U)


def _block(parts: list) -> tuple:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    h = mix(hashes(chain.from_iterable(parts), int(sizes.sum())))
    line, tokens = _distinct(np.repeat(np.arange(len(parts), dtype=U), sizes), h >> U(64 - 8 * WIDTH))
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    n = np.diff(np.append(starts, len(line)))
    mixed = mix(tokens)
    d1, d2 = np.add.reduceat(mixed, starts), np.add.reduceat(mix(mixed ^ MIX1), starts)
    cells = np.bincount(line * 16 + (mixed & U(15)).astype(np.int64), minlength=16 * len(parts)).astype(np.uint8).reshape(-1, 16) & 15
    bits = np.ascontiguousarray(cells[:, ::2] | cells[:, 1::2] << 4).view("<u8")[:, 0]
    return n, d1.view(np.int64), d2.view(np.int64), bits.view(np.int64), _binaries(_stored(tokens), n * WIDTH)


def _distinct(line: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = line << U(64 - LINE_BITS) | tokens
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> U(64 - LINE_BITS)).astype(np.int64), key & U((1 << (64 - LINE_BITS)) - 1)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank lines: doc (key), node (digest of the text), ord (place of the key in their order), row, line; and n, d1, d2,
    bits and tokens, but for those (dup) that equal an earlier line of the same block of documents. A text without words
    has one row, whose line is null.

    bits are 16 counters of words, modulo 16: two lines differ in at least as many words as their counters differ by in sum.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("node"), F.col("__ord").alias("ord"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc", "node", "ord", "row", "line", "dup", "n", "d1", "d2", "bits", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # lists of words have no cycles; trimmed() collects at the end
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                order, row = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                blank = np.ones(b.num_rows, bool)
                for owner, number, n, d1, d2, bits, tokens in _lines(b.column(4).to_pylist()):
                    blank[owner] = False
                    by = np.lexsort((number, row[owner], order[owner], d2, d1))
                    dup = np.zeros(len(by), bool)
                    dup[by[1:]] = (d1[by[1:]] == d1[by[:-1]]) & (d2[by[1:]] == d2[by[:-1]])
                    take, gone = pa.array(owner), pa.array(dup)
                    own = [pa.array(n.astype(np.int32)), pa.array(d1), pa.array(d2), pa.array(bits), tokens]
                    own = [pc.if_else(gone, pa.nulls(len(by), t), c) for c, t in zip(own, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(4)], pa.array(number.astype(np.int32)), gone, *own], names=names)
                if blank.any():
                    few, k = pa.array(np.flatnonzero(blank)), int(blank.sum())
                    yield pa.RecordBatch.from_arrays([*[b.column(i).take(few) for i in range(4)], pa.nulls(k, pa.int32()), pa.array(np.ones(k, bool)), *[pa.nulls(k, t) for t in kinds]], names=names)

    return rows.mapInArrow(trimmed(run), f"doc {kind}, node string, ord long, row long, line int, dup boolean, n int, d1 long, d2 long, bits long, tokens binary")


def token_places(col: pa.Array) -> np.ndarray:
    return (mix(_loaded(col)[1]) & U((1 << BITS) - 1)).astype(np.int64)


def parts_of(kind: np.ndarray, hot: int) -> np.ndarray:
    """Parts in which the lists of tokens of these classes are dealt."""
    return np.ceil(2.0 ** (kind / 8) / hot).astype(U)


def prefixes(col: pa.Array, classes: np.ndarray, hot: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For lines given by their tokens: how many tokens of class 0 come first, which occur once; the rest of the prefix, four
    bytes of each token's hash; and the classes of its hot tokens, which are the last ones. Sets of up to three words are only
    similar to equal ones: they have none."""
    n, tokens = _loaded(col)
    line = np.repeat(np.arange(len(n)), n)
    mixed = mix(tokens)
    kind = classes[(mixed & U((1 << BITS) - 1)).astype(np.int64)]
    short = (mixed >> U(32)).astype(np.uint32)
    by = np.argsort(line.astype(U) << U(40) | kind.astype(U) << U(32) | short, kind="stable")
    starts = np.cumsum(n) - n
    inside = np.arange(len(line)) - starts[line] < np.where(n > 3, prefix_size(n), 0)[line]
    kind, short = kind[by], short[by]
    shared = inside & (kind > 0)
    many = shared & (parts_of(kind, hot) > 1)
    skip, few, last = (np.bincount(line[m], minlength=len(n)) for m in (inside & (kind == 0), shared, many))
    return pa.array(skip.astype(np.int32)), _binaries(short[shared].astype("<u4"), few * 4), _binaries(kind[many].astype(np.uint8), last)


def _packed(b: pa.RecordBatch, packs: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings of first lines (ord, row, line, n, bits, skip, prefix, hot) and the packs they go to, in order of the packs."""
    order, row, line, n, bits, skip = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
    sizes, last = (pc.binary_length(b.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (6, 7))
    sizes //= 4
    own = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(own), POSTING)
    out["token"] = _joined(b.column(6)).view("<u4")
    for name, x in (("n", n), ("line", line), ("ord", order), ("row", row), ("bits", bits.view(U))):
        out[name] = x[own]
    place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out["i"] = skip[own] + place
    many = place >= (sizes - last)[own]
    parts = parts_of(_joined(b.column(7)), hot)
    out["part"][many] = 1 + mix(out["row"][many].view(U) * GAMMA + out["line"][many].astype(U)) % parts
    pack = (mix(out["token"].astype(U) + out["part"].astype(U) * GAMMA) % U(packs)).astype(np.int32)
    by = np.argsort(pack, kind="stable")
    return out[by], pack[by]


def _planes(p: np.ndarray) -> bytes:
    """p in order of ord and row, ord and row - ord as differences, byte by byte, compressed; its length first."""
    p = p[np.lexsort((p["row"], p["ord"]))]
    p["row"] -= p["ord"]
    for name in ("ord", "row"):
        p[name][1:] = np.diff(p[name])
    planes = np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T)
    return len(p).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def _unplaned(raw) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], n * POSTING.itemsize, codec="zstd"), np.uint8)
    p = np.ascontiguousarray(planes.reshape(POSTING.itemsize, -1).T).view(POSTING)[:, 0].copy()
    for name in ("ord", "row"):
        p[name] = np.cumsum(p[name])
    p["row"] += p["ord"]
    return p


#: The low half of each byte, the bit above it, and the lowest bit of each byte.
HALF, ABOVE, ONES = 0x0F0F0F0F0F0F0F0F, 0x1010101010101010, 0x0101010101010101


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of the differences of 16 counters modulo 16, each taken the shorter way round; eight at a time."""
    total = U(0)
    for shift in (U(0), U(4)):
        d = ((a >> shift & U(HALF) | U(ABOVE)) - (b >> shift & U(HALF))) & U(HALF)
        far = d >> U(3) & U(ONES)
        total = total + (d ^ far * U(15)) + far
    return ((total * U(ONES)) >> U(56)).astype(np.int64)


def _apart_sql(a: str, b: str) -> str:
    """The same as SQL, without overflow."""
    total = []
    for shift in (0, 4):
        d = f"((((shiftrightunsigned({a}, {shift}) & {HALF}L) | {ABOVE}L) - (shiftrightunsigned({b}, {shift}) & {HALF}L)) & {HALF}L)"
        far = f"(shiftrightunsigned({d}, 3) & {ONES}L)"
        total.append(f"({d} ^ ({far} * 15L)) + {far}")
    quarters = " + ".join(f"(shiftrightunsigned({t}, {k}) & {0x000000FF000000FF}L)" for t in [f"({' + '.join(total)})"] for k in (0, 8, 16, 24))
    return f"(({quarters}) % {0xFFFFFFFF}L)"


def _fits(n, i, bits, m, j, others) -> np.ndarray:
    """Length, positional and counter filter, exact in whole numbers; equal sets have been merged, so of equal sizes one word differs."""
    both = n + m
    ok = (LEAST_DEN * n >= LEAST_NUM * m) & (LEAST_DEN * m >= LEAST_NUM * n) & ((LEAST_NUM + LEAST_DEN) * np.minimum(n - i, m - j) >= LEAST_NUM * both)
    ok &= (n != m) | ((LEAST_NUM + LEAST_DEN) * (n - 1) >= 2 * LEAST_NUM * n)
    at = np.flatnonzero(ok)
    ok[at] = (LEAST_NUM + LEAST_DEN) * apart(bits[at], others[at]) <= (LEAST_DEN - LEAST_NUM) * both[at]
    return ok


#: The same as SQL, of postings x and y.
FITS = (
    f"{LEAST_DEN} * x.n >= {LEAST_NUM} * y.n and {LEAST_DEN} * y.n >= {LEAST_NUM} * x.n"
    f" and {LEAST_NUM + LEAST_DEN} * least(x.n - x.i, y.n - y.i) >= {LEAST_NUM} * (x.n + y.n)"
    f" and {LEAST_NUM + LEAST_DEN} * {_apart_sql('x.bits', 'y.bits')} <= {LEAST_DEN - LEAST_NUM} * (x.n + y.n)"
    f" and (x.n <> y.n or {LEAST_NUM + LEAST_DEN} * (x.n - 1) >= {2 * LEAST_NUM} * x.n)"
)
#: The wide bitmaps do not tell x and y apart.
NEAR = f"{LEAST_NUM + LEAST_DEN} * ({' + '.join(f'bit_count(x.w{i} ^ y.w{i})' for i in range(4))}) <= {LEAST_DEN - LEAST_NUM} * (x.n + y.n)"
EARLIER = "struct(x.ord, x.row, x.line) < struct(y.ord, y.row, y.line)"


def partners(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """compared() without the nearest lines."""
    return compared(p)[:3]


def compared(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the postings of whole lists: numbers of heads and lines that pass the filters together, of postings with a partner
    other than the head, and of earlier lines and lines that are nearer to them than their head.

    All postings of hot lists count as having a partner, as it may be in another part.
    """
    key = p["token"].astype(U) << U(32) | p["part"].astype(U)
    by = np.lexsort((p["n"], key))
    p, key = p[by], key[by]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(p) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(p)))
    which = np.repeat(np.arange(len(starts)), sizes)
    n, i, bits = p["n"].astype(np.int64), p["i"].astype(np.int64), p["bits"].copy()
    met, sizes = np.flatnonzero(sizes[which] > 1), sizes[sizes > 1]  # postings that are not alone in their lists
    by = met[np.lexsort((p["line"][met], p["row"][met], p["ord"][met], which[met]))]
    head = np.arange(len(p))
    head[met] = np.repeat(by[np.cumsum(sizes) - sizes], sizes)
    order = np.zeros(len(p), np.int64)
    order[by] = np.arange(len(by))
    tried = met[head[met] != met]
    tried = tried[_fits(n[tried], i[tried], bits[tried], n[head[tried]], i[head[tried]], bits[head[tried]])]
    near, far = head.copy(), np.full(len(p), 255)
    far[tried] = apart(bits[tried], bits[head[tried]])
    live = p["part"] > 0
    left = met[~live[met]]
    # sizes ascend in a list: the last one that fits
    place = which << 32 | n
    many = np.searchsorted(place, which[left] << 32 | LEAST_DEN * n[left] // LEAST_NUM, "right") - left - 1
    total, at = np.cumsum(many), 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + STEP, "right")))
        few = many[at:end]
        j = np.repeat(left[at:end], few)
        k = j + 1 + np.arange(len(j)) - np.repeat(np.cumsum(few) - few, few)
        others = (head[j] != j) & (head[j] != k)
        j, k = j[others], k[others]
        good = _fits(n[j], i[j], bits[j], n[k], i[k], bits[k])
        j, k = j[good], k[good]
        live[j] = live[k] = True
        swap = order[j] < order[k]
        early, late = np.where(swap, j, k), np.where(swap, k, j)
        d = apart(bits[early], bits[late])
        nearer = np.flatnonzero(d < far[late])
        nearer = nearer[np.lexsort((-d[nearer], late[nearer]))]  # the last one of each line is the nearest
        near[late[nearer]], far[late[nearer]] = early[nearer], d[nearer]
        at = end
    close = np.flatnonzero(near != head)
    return p, np.column_stack([head[tried], tried]), np.flatnonzero(live), np.column_stack([near[close], close])


#: What the lists give: kind 0: pairs of head or nearest line (x) and line (y); 1: lines that equal an earlier one; 2: postings with another partner.
FOUND = "kind int, token long, n int, i int, bits long, ord long, row long, line int, x_ord long, x_row long, x_line int"


def found(stored: DataFrame, classes) -> DataFrame:
    spark = stored.sparkSession
    # a task holds one pack at a time: its size stays the same, however many postings there are
    most = stored.filter("not dup and n > 3").agg(F.sum(F.expr(f"n - ({LEAST_NUM} * n + {LEAST_DEN - 1}) div {LEAST_DEN} + 1"))).head()[0] or 0
    packs, hot = max(PACKS * int(spark.conf.get("spark.sql.shuffle.partitions")), most // PACK_POSTINGS), HOT
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PREFIXED):
                b = whole.slice(at, PREFIXED)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *prefixes(b.column(b.num_columns - 1), classes.value, hot)], names=[*b.schema.names[:-1], "skip", "prefix", "hot"])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, n = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            p, pack = _packed(t, packs, hot)
            if not len(p):  # no line of these shares a word of its prefix
                return
            at = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]]))
            planes = pa.array([_planes(p[i:j]) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(p)], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(pack[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), planes], names=["pack", "row", "line", "postings"])

        for b in batches:
            if not b.num_rows:
                continue
            d = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            same = np.zeros(len(d), bool)
            same[1:] = (d[1:] == d[:-1]).all(1)
            same[0] = last is not None and (d[0] == last).all()
            last = d[-1].copy()
            gone = b.filter(pa.array(same))
            if gone.num_rows:
                row = gone.column(3).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array((mix(row.view(U)) % U(packs)).astype(np.int32)), gone.column(3), gone.column(4), pa.nulls(gone.num_rows, pa.binary())], names=["pack", "row", "line", "postings"])
            held.append(b.filter(pa.array(~same)).select(["ord", "row", "line", "n", "bits", "skip", "prefix", "hot"]))
            n += held[-1].num_rows
            if n >= PACK:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> Iterator[pa.RecordBatch]:
            p, heads, live, nearest = compared(np.concatenate(held))
            pairs = np.concatenate([heads, nearest])
            for a, x in ((p[pairs[:, 1]], p[pairs[:, 0]]), (p[live], None)):
                if len(a):
                    cols = [np.full(len(a), 0 if x is not None else 2), a["token"], a["n"], a["i"], a["bits"].view(np.int64), a["ord"], a["row"], a["line"]]
                    more = [x[k] for k in ("ord", "row", "line")] if x is not None else [None] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(t.to_pandas_dtype())) if c is not None else pa.nulls(len(a), t) for c, t in zip([*cols, *more], kinds, strict=True)], names=names)

        pack, held = None, []
        for b in batches:
            same = b.filter(pc.is_null(b.column(3)))
            if same.num_rows:
                k = same.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), *[pa.nulls(k, t) for t in kinds[1:6]], same.column(1), same.column(2), *[pa.nulls(k, t) for t in kinds[8:]]], names=names)
            b = b.filter(pc.is_valid(b.column(3)))
            for own, raw in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                if own != pack and held:
                    yield from out(held)
                    held = []
                pack = own
                held.append(_unplaned(raw.as_py()))
        if held:
            yield from out(held)

    own = stored.filter("not dup").select("d1", "d2", "ord", "row", "line", "n", "bits", "tokens")
    own = own.mapInArrow(trimmed(prefixed), "d1 long, d2 long, ord long, row long, line int, n int, bits long, skip int, prefix binary, hot binary")
    dealt = own.repartition("d1").sortWithinPartitions("d1", "d2", "ord", "row", "line").mapInArrow(trimmed(firsts), "pack int, row long, line int, postings binary")
    return dealt.repartition("pack").sortWithinPartitions("pack").mapInArrow(trimmed(match), FOUND)


def wide(col: pa.Array) -> list[pa.Array]:
    """Number of tokens, and a bitmap of 256 bits in four numbers, of lines given by their tokens."""
    n, tokens = _loaded(col)
    spot = np.repeat(np.arange(len(n)), n) * 256 + ((mix(tokens) >> U(8)) & U(255)).astype(np.int64)
    bits = np.packbits((np.bincount(spot, minlength=256 * len(n)) & 1).astype(np.uint8)).view("<i8").reshape(-1, 4)
    return [pa.array(n.astype(np.int32)), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]]


def _sides(pairs: DataFrame, few: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns of few for both lines, those of x as x_*."""
    x = pairs.select(F.col("x_row").alias("row"), F.col("x_line").alias("line"))
    few = few.select("row", "line", *columns)
    # dealt by the keys of the joins, which need no exchange of their own then; and no task needs two Python workers
    other = Marks(x).picked(few).select(*[F.col(c).alias(f"x_{c}") for c in few.columns]).repartition("x_row", "x_line")
    mine = Marks(pairs.select("row", "line")).picked(few).repartition("row", "line")
    return pairs.join(mine, ["row", "line"]).join(other, ["x_row", "x_line"])


def with_wide(df: DataFrame, marks: Marks) -> DataFrame:
    """row, line and tokens with n and the wide bitmap w0 to w3, of the lines that marks let through; one Python worker a task does both."""
    test = marks.tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                b = whole.slice(at, 5000)
                b = b.filter(pa.array(test(b.column(3)))).select(["row", "line", "tokens"])
                yield pa.RecordBatch.from_arrays([*b.columns, *wide(b.column(2))], names=["row", "line", "tokens", "n", "w0", "w1", "w2", "w3"])

    return df.select("row", "line", "tokens", F.xxhash64("row", "line").alias("id")).mapInArrow(run, "row long, line int, tokens binary, n int, w0 long, w1 long, w2 long, w3 long")


def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the sets of tokens in two columns are similar enough, row by row."""

    def keys(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes, tokens = _loaded(col)
        return sizes, tokens | np.repeat(np.arange(len(sizes), dtype=U), sizes) << U(8 * WIDTH)

    (n, x), (m, y) = keys(a), keys(b)
    both = np.sort(np.concatenate([x, y]))
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> U(8 * WIDTH)).astype(np.int64), minlength=len(n))
    return LEAST_DEN * shared >= LEAST_NUM * (n + m - shared)


def _similar(pairs: DataFrame, few: DataFrame) -> DataFrame:
    """row and line of those lines y of pairs (x_row, x_line, row, line) whose sets are similar enough to that of x."""
    both = _sides(pairs, few, "tokens").select("row", "line", "tokens", "x_tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                yield b.select(["row", "line"]).filter(pa.array(alike(b.column(2), b.column(3))))

    return both.mapInArrow(trimmed(verify), "row long, line int").distinct()


def _ordered(docs: DataFrame, key: str) -> DataFrame:
    """docs with __ord, a number in the order of the key, null first."""
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return docs.withColumn("__ord", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    keys = docs.select(F.col(key).alias("__key")).distinct().orderBy("__key").withColumn("__ord", F.monotonically_increasing_id())
    return docs.join(cut(keys, "keys"), F.col(key).eqNullSafe(F.col("__key")))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, node, row, n_lines (with a word) and the sorted numbers of removed lines, for every document.

    Order is by the key (null first), then by place. Blank lines have no words and always stay; null, empty and blank texts
    have no lines. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = _ordered(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key)
    stored = cut(lines(docs, key, text), "lines")
    counts = summed(stored, "tokens", BITS, token_places)
    octaves = np.log2(np.maximum(counts, 1)) * 8
    classes = spark.sparkContext.broadcast(np.minimum(np.where(counts > 1, octaves, 0), (1 << CLASS_BITS) - 1).astype(np.uint8))  # 2^BITS bytes
    lists = cut(found(stored, classes), "lists")
    head, live = lists.filter("kind = 0"), lists.filter("kind = 2")
    spots = head.select("row", "line").unionByName(head.select(F.col("x_row").alias("row"), F.col("x_line").alias("line"))).unionByName(live.select("row", "line"))
    few = cut(with_wide(stored.filter("not dup"), Marks(spots)), "few")
    tries = cut(head.select("x_row", "x_line", "row", "line").distinct(), "tries")
    early = cut(_similar(tries, few), "early")
    # the rest against all: pairs whose later line is not settled
    bitmaps = few.select("row", "line", "w0", "w1", "w2", "w3")
    told = live.join(bitmaps, ["row", "line"]).join(early.withColumn("m", F.lit(-1)), ["row", "line"], "left").withColumn("m", F.coalesce("m", "n"))
    open_ = cut(told.select("token", "n", "i", "bits", "ord", "row", "line", "m", "w0", "w1", "w2", "w3"), "open")
    # m: -1 for settled lines. The condition names both sides, so that both read one exchange
    met = open_.alias("y").join(open_.alias("x"), F.expr(f"x.token = y.token and y.m + 0 * x.m > 0 and {EARLIER} and {FITS} and {NEAR}"))
    pairs = cut(met.select(F.col("y.row").alias("row"), F.col("y.line").alias("line"), F.col("x.row").alias("x_row"), F.col("x.line").alias("x_line")).distinct(), "pairs")
    late = cut(_similar(pairs, few), "late")
    gone = lists.filter("kind = 1").select("row", "line").unionByName(early).unionByName(late)
    every = stored.groupBy("row").agg(F.first("doc").alias("doc"), F.first("node").alias("node"), F.count("line").alias("n_lines"), F.collect_list(F.when(F.col("dup"), F.col("line"))).alias("d"))
    more = gone.groupBy("row").agg(F.collect_list("line").alias("g"))
    none = F.array().cast("array<int>")
    out = cut(every.join(more, "row", "left").select("row", "doc", "node", "n_lines", F.array_sort(F.concat("d", F.coalesce("g", none))).alias("removed")), "removed")
    classes.unpersist()
    discard(stored, lists, few, tries, early, open_, pairs, late)
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_removed, removed_lines (numbers from 0, comma-joined) of every document.

    Null, empty and blank texts have none of them; repeated rows are judged each by itself; an empty table gives no rows.
    """
    out = removed(docs.select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


#: A character of a word.
WORDY = r"(?U)[^\s\x1c-\x1f]"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later matches removed from the texts; documents all stay, a text may become empty.

    Only documents that lose a line are shuffled; a filter by marks lets the others pass where they are. Of rows equal in key and
    text one keeps what the others lose, which keep blank lines alone. Columns of any name stay.
    """
    node, name, list_, flags, copies, row, least = unused(docs, "__node", "__key", "__list", "__gone", "__many", "__row", "__first")
    own = removed(docs, key, text)
    # of rows equal in key and text all but the first lose every line with a word
    lists = own.groupBy("doc", "node").agg(F.min_by("removed", "row").alias("removed"), F.count(F.lit(1)).alias("many")).filter("size(removed) > 0 or many > 1")
    lists = cut(lists.select("doc", "node", "many", "removed").mapInArrow(_gone, f"doc {own.schema['doc'].dataType.simpleString()}, node string, many long, gone array<boolean>"), "lists")
    discard(own)
    marks = Marks(lists, "doc", "node")
    marked = docs.withColumn(node, F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    met = marks.maybe(F.col(f"`{key}`"), F.col(node))
    same = (F.col(node) == F.col(list_)) & F.col(f"`{key}`").eqNullSafe(F.col(name))
    known = lists.select(F.col("doc").alias(name), F.col("node").alias(list_), F.col("gone").alias(flags), F.col("many").alias(copies))
    both = marked.filter(met).join(known, same, "left").drop(list_, name)
    later = F.lit(False)
    if lists.filter("many > 1").limit(1).count():
        held = cut(both.withColumn(row, F.monotonically_increasing_id()), "held")
        first = held.filter(F.col(copies) > 1).groupBy(F.col(f"`{key}`").alias(name), F.col(node).alias(list_)).agg(F.min(row).alias(least))
        both = held.join(first, same, "left")
        later = F.coalesce(F.col(row) > F.col(least), F.lit(False))
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    left = F.when(later, F.filter(lines, lambda x: ~x.rlike(WORDY))).otherwise(F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(flags), i), F.lit(False))))
    new = F.when(F.col(copies).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
    rewritten = both.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
    return marked.filter(~met).drop(node).unionByName(rewritten)


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, node and many with the numbers of removed lines as an array that tells of each line whether it goes."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            flags = []
            for numbers in b.column(3).to_pylist():
                f = np.zeros(max(numbers, default=-1) + 1, bool)
                f[numbers] = True
                flags.append(f.tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(flags, pa.list_(pa.bool_()))], names=["doc", "node", "many", "gone"])


ORACLE_SQL = r"""
WITH cuts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
flat AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM cuts),
words AS (SELECT doc_id, pos, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '\s+'), lambda w: w <> ''))) AS k FROM flat),
lines AS (SELECT doc_id, pos, k, len(k) AS n, row_number() OVER (ORDER BY doc_id, pos) AS id FROM words WHERE len(k) > 0),
firsts AS (SELECT *, min(id) OVER (PARTITION BY k) AS first FROM lines),
reps AS (SELECT id, k, n FROM firsts WHERE id = first),
tokens AS (SELECT id, n, unnest(k) AS w FROM reps),
ranked AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS rn FROM tokens JOIN (SELECT w, count(*) AS c FROM tokens GROUP BY w) USING (w)),
prefix AS (SELECT id, n, w FROM ranked WHERE rn <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
alike AS (SELECT DISTINCT y FROM (SELECT y, a.n + b.n AS s, len(list_intersect(a.k, b.k)) AS m FROM pairs JOIN reps a ON a.id = x JOIN reps b ON b.id = y) WHERE 5 * m >= 4 * (s - m)),
judged AS (SELECT doc_id, pos, id <> first OR id IN (SELECT y FROM alike) AS gone FROM firsts),
held AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (gone), '') AS removed_lines FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM documents LEFT JOIN held USING (doc_id)
"""
