import random

import pytest
import xxhash

from quillon.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted([(d, f"{prints[k]:016x}", least.get(find(k))) for k, (d, _) in enumerate(rows)], key=repr)


def texts(n=120):
    draw = random.Random(5)
    rows = []
    for d in range(n):
        if rows and draw.random() < 0.6:
            words = (draw.choice(rows)[1] or "").split()
            for _ in range(draw.randrange(3)):
                if words:
                    words[draw.randrange(len(words))] = f"W{draw.randrange(9999)}"
            rows.append((d, " ".join(words)))
        else:
            rows.append((d, " ".join(f"w{draw.randrange(400)}" for _ in range(draw.randrange(0, 300)))))
    return rows


def test_agrees_with_brute_force(spark):
    rows = [*texts(), (None, None), (None, "a b c d"), (900, ""), (901, "a b"), (901, "a b"), (902, "A B"), (903, "x " * 60_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_one_of_each_group_stays(spark):
    draw = random.Random(2)
    rows, groups = [], []
    for g in range(40):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(150, 500))]
        group = []
        for _ in range(draw.randrange(1, 5)):
            own = list(words)
            for _ in range(len(own) // 150):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(10**6)}"
            group.append(len(rows))
            rows.append((len(rows), " ".join(own)))
        groups.append(group)
    rows += [(1000, "a b"), (1000, "a b"), (None, "a b"), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1000) == 1 and ids.count(None) == 1
    ids = [d for d in ids if d is not None and d < 1000]
    assert all(group[0] in ids for group in groups)
    assert len(ids) <= len(groups) * 1.1


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1), ("", "x", 0), ("a b c d e f", "a b c d e f", 1), ("a b c d e f", "a b c d e g", 1 / 3)])
def test_likeness(a, b, want):
    import numpy as np

    sketch = lambda t: np.unique((simhash._shingles(t.encode().split(), 5) >> np.uint64(32)).astype("<u4")).tobytes()
    assert simhash.likeness(sketch(a), sketch(b)) == pytest.approx(want)


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def groups(rows):
    """Kept ids, when texts of a five-word likeness of 0.8 are linked one by one."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


def test_copies_behind_strangers_are_linked(spark):
    """Under one key, many texts that are no copies of each other come before and between the copies."""
    import numpy as np

    uids = list(range(60))
    copies = [(40 + k, 50 + k) for k in range(10)]
    met = simhash.meetings(spark.createDataFrame([(u, 7) for u in uids], "uid long, key long"))
    wanted = spark.createDataFrame(copies, "u long, v long")
    found = simhash.verified(met, lambda pairs: pairs.join(wanted, ["u", "v"], "left_semi"))
    assert sorted((r.u, r.v) for x in found for r in x.collect()) == copies
    few = simhash.meetings(spark.createDataFrame([(u, int(k)) for k in np.arange(3) for u in (1, 2, 3)], "uid long, key long"))
    chain = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    found = simhash.verified(few, lambda pairs: pairs.join(chain, ["u", "v"], "left_semi"))
    assert sorted((r.u, r.v) for x in found for r in x.collect()) == [(1, 2), (2, 3)]


def test_copies_are_told_by_their_whole_texts(spark):
    """Pairs around the least likeness, by scattered edits and by a replaced block, as brute force has them."""
    draw = random.Random(8)
    rows = []
    for g in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(400)]
        rows.append((2 * g, " ".join(words)))
        n = draw.randrange(5, 12) if g % 2 else draw.randrange(25, 60)
        for k in draw.sample(range(400), n) if g % 2 else range(200, 200 + n):
            words[k] = f"edit{draw.randrange(10**6)}"
        rows.append((2 * g + 1, " ".join(words)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    want = groups(rows)
    assert 65 < len(want) < 115
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_twins_among_many_texts_that_are_no_copies_of_their_base(spark):
    """Large groups whose members differ from the representative are split, and links inside them found."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for _ in range(60):
        words = list(base)
        for k in draw.sample(range(150), 6):
            words[k] = f"edit{draw.randrange(10**6)}"
        rows.append((len(rows), " ".join(words)))
        words[draw.randrange(150)] = f"edit{draw.randrange(10**6)}"
        rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    want = groups(rows)
    assert 40 < len(want) < 70
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_pairs_by_rarest_numbers(spark):
    """Every pair of like sets of two components is found, and what a group has in common makes hardly any others."""
    import numpy as np

    draw = random.Random(3)
    base = draw.sample(range(2**31), 100)
    sets = {}
    for u in range(120):
        own = set(draw.sample(base, 100 - draw.randrange(8, 30))) | {2**31 + draw.randrange(2000) for _ in range(draw.randrange(8, 30))}
        sets[3 * u] = own
        if u % 3 == 0:
            sets[3 * u + 1] = own - set(draw.sample(sorted(own), 3)) | {2**32 - 1 - u}
    sets[1000] = set()
    left = [u for u in sets if u % 2 == 0]
    frame = [(u, bytearray(np.sort(np.array(sorted(x), "<u4")).tobytes())) for u, x in sets.items()]
    found = simhash.prefix_pairs(
        spark.createDataFrame(frame, "uid long, shingles binary"),
        spark.createDataFrame([(u,) for u in left], "uid long"),
        spark.createDataFrame([(u, u % 5) for u in sets], "uid long, root long"),
        0.8,
    )
    found = {(r.u, r.v) for r in found.collect()}
    asked = {(a, b) for a in sets for b in sets if a < b and a % 5 != b % 5 and (a in left or b in left)}
    want = {(a, b) for a, b in asked if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert len(want) > 20 and want <= found <= asked
    assert len(found) < len(asked) / 10
