"""Sort-means, the prefix trie and source mixing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import common, mixing, sortmeans, trie

# ---- running numbers ----


def test_running_equals_plain_numbering(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    got = {r["o"]: (r["n"], r["s"]) for r in common.running(df, ["k"], [F.col("o")], "n", s="v").collect()}
    seen, expected = defaultdict(lambda: (0, 0)), {}
    for k, o, v in rows:
        seen[k] = expected[o] = (seen[k][0] + 1, seen[k][1] + v)
    assert got == expected
    assert sorted(r["n"] for r in common.running(df.select("o"), [], [F.col("o").desc()], "n").collect()) == list(range(1, 501))


# ---- 11 ----


def plain_clusters(rows, k, rounds):
    """rows: (row number, key, list of numbers); everything in Python's whole numbers."""
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    by = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{r[1]}".encode()).hexdigest() if r[1] is not None else "~", r[2]))
    cents = [r[2] for r in by[:k]]
    for number in range(rounds + 1):
        got = {i: min((far(x, c), j) for j, c in enumerate(cents)) for i, _, x in rows}
        if number < rounds:
            new = []
            for j, c in enumerate(cents):
                own = [x for i, _, x in rows if got[i][1] == j]
                new.append([sum(col) // len(own) for col in zip(*own, strict=True)] if own else c)
            cents = new
    return got, cents


@pytest.mark.parametrize("spread", [0.0, 0.3, 3.0])
def test_sort_means_equals_brute_force(spark, spread):
    rng = np.random.default_rng(int(spread * 10))
    middle = rng.normal(size=(7, 64))
    v = [(int(i), (middle[i % 7] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(150)]
    v += [(3, v[3][1]), (3, v[4][1]), (None, v[5][1]), (-4, [1e30] * 63 + [-1e30])]  # repeated, null and far away
    bad = [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [0.0] * 63 + [None]), (905, [0.0] * 63 + [float("nan")]), (906, [float("-inf")] + [0.0] * 63)]
    df = spark.createDataFrame(v + bad, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "KEY": F.lit(1), "x": F.lit(2), "n": F.lit(3)})
    limit = sortmeans.LIMIT
    rows = [(i, k, [max(-limit, min(limit, int(np.floor(np.float64(np.float32(e)) * 256)))) for e in x]) for i, (k, x) in enumerate(v)]
    expected, cents = plain_clusters(rows, 40, 5)
    by = defaultdict(int)
    for d, j in expected.values():
        by[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    want = Counter((rows[i][1], j, d, by[j], sum(by.values()), digest[j]) for i, (d, j) in expected.items())
    out = sortmeans.report(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, out.collect())) == want


def test_scan_stops_early_and_takes_the_smallest_of_equals():
    rng = np.random.default_rng(1)
    cents = rng.integers(-3000, 3000, (40, 64))
    cents[20:25] = cents[3]  # equal centroids
    x = cents[rng.integers(0, 40, 5000)] + rng.integers(-40, 40, (5000, 64))
    whole = ((x[:, None, :] - cents) ** 2).sum(2)
    scan = sortmeans.Scan(cents)
    got, near = scan.assign(x, np.zeros(len(x), np.int64))
    assert (got == whole.argmin(1)).all() and (near == whole.min(1)).all()
    scan.tried = 0
    again, _ = scan.assign(x, got)
    assert (again == got).all() and scan.tried < 5000 * 40 / 5
    # midpoints: a bound that is not strict would miss the smaller number
    line = sortmeans.Scan(np.array([[10], [0]]))
    assert line.assign(np.array([[5]]), np.array([1]))[0].tolist() == [0]


def test_sort_means_of_few_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in sortmeans.report(df).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert sortmeans.report(df.limit(0)).collect() == []


# ---- 12 ----


def plain_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t))


def plain_trie(rows, build=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:]) if build else tuple(ts)
    nodes = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * (plain_words(k[-1][1]) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed):
    rng = random.Random(seed)
    said = [("user", "hello there"), ("assistant", "how may I help"), ("user", ""), (None, None), ("user", None), ("tool", " \t x  y\x0b")]
    rows = []
    for c in [*range(-25, 45), *rng.sample(range(1000), 30)]:
        for turn in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, *rng.choice(said)))
    rows += [(c, t, "user", f"w{t} of a copy") for c in range(2000, 2130) for t in range(5)]  # copies
    rows += [(c, t, "user", f"{t} of a deep pair" + (" end" if t == 11 and c == 3001 else "")) for c in (3000, 3001) for t in range(12)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (None, 0, "user", "lost"), (5, 9, "user", "x " * 20_000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 50)  # ids of a node in many pieces
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "CONV": F.lit(1), "n": F.lit(2)})
    out = trie.report(df)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=str) == plain_trie(rows)
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == plain_trie(rows, build=False)


def test_trie_of_one_and_none(spark):
    df = spark.createDataFrame([(3, 0, "user", "a b")], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.report(df).collect()), key=str) == plain_trie([(3, 0, "user", "a b")])
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == plain_trie([(3, 0, "user", "a b")], build=False)
    assert trie.report(df.limit(0)).collect() == [] and trie.report(df.limit(0)).columns == COLUMNS


# ---- 13 ----


def plain_mix(rows):
    """Targets by source, and the words taken of each source by whole documents in order of their hashes."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += plain_words(text or "")
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else w[s] * (left / sum(w[x] for x in free)) for s in names}
        more = {s for s in free if target[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    by = defaultdict(list)
    for i, text, source in rows:
        h = hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:15]
        by[source].append((int(h, 16), plain_words(text or "")))
    for s, docs in by.items():
        base = int(target[s] > sizes[s])
        budget, spent = target[s] - base * sizes[s], 0
        for _, size in sorted(docs):
            if spent + size <= budget or (spent <= budget and 2 * (budget - spent) >= size):
                spent += size
            elif size:
                break
        taken[s] = base * sizes[s] + spent
    return sizes, target, taken


def mixed_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["a", "b", "b", "b", "é", "Z", "\U0001f600", None])) for i in range(400)]
    rows += [(None, None, "a"), (None, "same words of copies here", "copies"), (1, None, "nothing")] + [(5000, "one more of very many copies", "copies")] * 333 + [(5001, "x " * 30_000, "long")]
    return rows


@pytest.mark.parametrize("seed,buckets", [(1, 4096), (2, 4)])
def test_mix_equals_brute_force(spark, monkeypatch, seed, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rows = mixed_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "__row": F.lit(1), "KEY": F.lit(2), "h": F.lit(3)})
    out = mixing.report(df)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = mixing.plan(df).collect()
    sizes, target, taken = plain_mix(rows)
    own = Counter()
    for r in got:
        own[r["source"]] += r["size"] * r["copies"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
    assert len(got) == len(rows) and own == taken
    assert own["copies"] == pytest.approx(target["copies"], abs=6)
    again = mixing.report(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out.collect()))
    made = mixing.mix(df.drop("__row"))
    assert made.columns == ["doc_id", "text", "source", "size", "KEY", "h"] and made.count() == sum(r["copies"] for r in got)


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.report(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in mixing.report(spark.createDataFrame([(1, "", None)], schema)).collect()] == [(1, 0, 0, 0.0, 0)]
    assert sorted(r["taken"] for r in mixing.report(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], schema)).collect()) == [2, 4]
