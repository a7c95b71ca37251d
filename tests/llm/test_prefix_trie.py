import hashlib
import random
import zlib

import pytest

from rastertab.llm import prefix_trie as p
from rastertab.llm import scans

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, v string"


def slow_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + mine[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        inside = [q for q in nodes if q[: len(path)] == path]
        kids = [q for q in inside if len(q) == len(path) + 1]
        leaves = [q for q in inside if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in inside)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode().split()) for q in inside if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, block=scans.BLOCK):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = p.prefix_trie(df, block)
    return sorted(tuple(r)[:8] for r in found.collect())


def scene(seed, convs):
    rng = random.Random(seed)
    texts = ["hi there", "a b  c\td", "", None, " one word still", "x y z"]
    rows = []
    for c in range(convs):
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # a base that is absent
        for t in range(rng.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, rng.choice((None, t, t)) if t else 0, rng.choice(("user", "assistant", None)), rng.choice(texts[: 2 + c % 5])))
    return rows


@pytest.mark.parametrize("seed,block", [(1, scans.BLOCK), (2, 16)])
def test_trie_equals_brute_force(spark, seed, block):
    rows = scene(seed, 90)
    # ties of turn are ordered by a hash here: leave one text per (conv_id, turn, role)
    seen, kept = set(), []
    for r in rows:
        if r[:3] not in seen:
            seen.add(r[:3])
            kept.append(r)
    kept += [(None, 0, "user", "nobody"), (500, 0, "user", "alone"), (500, 0, "user", "alone"), (10**12, 0, "", "")]
    assert got(spark, kept, block) == slow_trie(kept)


def test_one_conversation_holds_most_turns(spark):
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(400)] + [(c, t, "user", f"turn {t}") for c in range(1, 30) for t in range(3)]
    assert got(spark, rows, 64) == slow_trie(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_running_lanes_and_sums_cross_partitions(spark):
    rows = [(g, i, (g * 31 + i * 7) % 100) for g in (-5, 1, 2, 9) for i in range(300 if g == 1 else 3)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, x bigint")
    want, base = [], 12345
    for g in (-5, 1, 2, 9):
        total, lane = 0, 0
        for k, (_, i, x) in enumerate([r for r in rows if r[0] == g], 1):
            total, lane = total + x, (lane + x * pow(base, k, scans.PRIME)) % scans.PRIME
            want.append((g, i, k, total, lane))
    both = df.withColumn("y", df.x)
    found = scans.running(both, ["g", "i"], ["g"], sums=["x"], lanes={"y": base})
    assert sorted(tuple(r) for r in found.select("g", "i", "seq", "run_x", "run_y").collect()) == sorted(want)


@pytest.mark.parametrize("block", [4, 50, 1000])
def test_list_rank(spark, block):
    rng = random.Random(block)
    order = list(range(300))
    rng.shuffle(order)
    rows = [(a, b) for a, b in zip(order, [*order[1:], None])]
    left = {a: len(order) - k for k, a in enumerate(order)}
    found = scans.list_rank(spark.createDataFrame(rows, "arc bigint, next bigint"), block)
    assert {r.arc: r.left for r in found.collect()} == left
