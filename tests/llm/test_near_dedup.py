import random

import numpy as np

from procweave.llm import near_dedup
from procweave.llm.common import identified


def brute(rows, k=5):
    """rows: (row, id, text); component and set size of each row by all pairs."""
    sets = []
    for _, _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [len(s) for s in sets], [find(i) for i in range(len(rows))]


def rows_of(docs):
    rows = [(r["__r"], r["doc_id"], r["text"]) for r in identified(docs, "__r").select("__r", "doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[1] is None, r[1], r[0]))


def check(docs):
    rows = rows_of(docs)
    sizes, heads = brute(rows)
    got = {r["rid"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for (rid, i, _), size, head in zip(rows, sizes, heads):
        r = got[rid]
        assert (r["n_shingles"], r["component_id"], r["first"]) == (size, rows[head][1], rows[head][0] == rid)
        assert r["kept"] == (i == rows[head][1])


def test_odd_rows(odd):
    check(odd)


def test_repeated_rows_and_null_ids(repeated):
    check(repeated)


def test_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_groups_of_many_sizes_and_a_dense_star(write):
    """Near copies of one text that link to it but hardly to each other, chains, and texts that share a passage only."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(5000)}"
    centre = [word() for _ in range(150)]
    texts = [" ".join(centre)]
    for _ in range(300):
        copy = list(centre)
        for at in rng.sample(range(0, 150, 6), 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    for size in (2, 3, 9, 30):
        last = [word() for _ in range(80)]
        for _ in range(size):
            texts.append(" ".join(last))
            last = list(last)
            last[rng.randrange(80)] = word()
    passage = [word() for _ in range(40)]
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(200)]
    rng.shuffle(texts)
    check(write([(i, t, "en", "s") for i, t in enumerate(texts)]))


def test_neighbours_are_taken_between_regions_only(spark):
    """Three hundred nodes of one prefix and forty of others in a head: each region looks back once, not each node."""
    rows = [(1, 5, i, 10, 340) for i in range(300)] + [(1, (i + 10) << 32, 300 + i, 10, 340) for i in range(40)]
    pairs = near_dedup.candidates(spark.createDataFrame(rows, "head long, rest long, node long, n int, c long")).collect()
    inner = [(p["a"], p["b"]) for p in pairs if p["b"] < 300]
    # A star around one node of the dense prefix, and nothing else within it.
    assert len(inner) == 299 and len(set.intersection(*map(set, inner))) == 1
    outer = [(p["a"], p["b"]) for p in pairs if p["b"] >= 300]
    assert {b for _, b in outer} == set(range(300, 340)) and len(outer) == 40 * near_dedup.NEAR


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    whole = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    signs = near_dedup.signatures(np.concatenate((np.sort(whole[:800]), np.sort(whole[200:]))), np.array([0, 800, 1600]))
    assert abs((signs[0] == signs[1]).mean() - 0.6) < 0.12


def test_first_of_each_group_stays(odd):
    kept = near_dedup.drop_near_duplicates(odd)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == odd.columns and 7 in ids and not ids & {8, 9} and {0, 1, 2} <= ids


def test_dense_regions_lose_no_pair(write):
    """A star of 4,000 copies at exactly 0.75 of their centre only, and 1,000 pairs at exactly 0.75 in a family that shares 0.70."""
    rng = random.Random(5)
    new = iter(f"n{i}" for i in range(10**7))
    take = lambda n: [next(new) for _ in range(n)]
    centre = take(144)
    texts, group = [" ".join(centre)], [0]
    for _ in range(4_000):
        copy = list(centre)
        for at in rng.sample(range(4, 144, 5), 4):
            copy[at] = next(new)
        texts.append(" ".join(copy))
        group.append(0)
    passage = take(119)
    for i in range(1_000):
        shared = take(5)
        texts += [" ".join(passage + shared + take(20)) for _ in range(2)]
        group += [len(texts) - 2] * 2
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(write([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [i for i, g in enumerate(group) if got[i] != g] == []
