"""SimHash: fingerprints, index and components against brute force."""

import random
import re

import xxhash

from quarryline.llm import simhash
from quarryline.llm.graph import components


def brute_fingerprint(text, width):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    out = [None, "", " \t\n", "One", "A b\tC", "a  b c", "x" * 70 + " y", *base, *base[:10]]
    for t in base[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


def test_fingerprints_and_components(spark):
    for width in (4, 5):
        docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts())], "doc_id long, text string, fp int").repartition(3)
        got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, width=width).collect()}
        want = [brute_fingerprint(t, width) for t in texts()]
        assert [got[i]["fingerprint"] % 2**64 for i in range(len(want))] == want
        pairs = [(i, j) for i in range(len(want)) for j in range(i) if (want[i] ^ want[j]).bit_count() <= 4]
        assert {i: r["component_id"] for i, r in got.items()} == brute_components(pairs, range(len(want)))


def test_dense_group_of_near_fingerprints(spark):
    rng = random.Random(4)
    fps = [0]
    for _ in range(400):
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    fps = [f - 2**64 if f >= 2**63 else f for f in dict.fromkeys(fps)]
    import numpy as np

    a, b = simhash.forest(np.array(fps, np.int64).view(np.uint64), 4)
    links = list(zip(a.tolist(), b.tolist()))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 4]
    assert brute_components(links, range(len(fps))) == brute_components(pairs, range(len(fps)))
    assert len(links) < len(fps)


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_representatives(spark):
    t = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(3, t, "a"), (1, t, "b"), (1, t, "c"), (2, "other text here", "d"), (None, t, "e"), (None, None, "f"), (9, "", "g")], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(docs).collect()), key=str)
    assert got == sorted([(1, t), (2, "other text here"), (9, "")], key=str)
    assert simhash.representatives(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def brute_kept(texts):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    return sorted(set(brute_components(pairs, range(len(sets))).values())), len([1 for i, j in pairs if sets[i] != sets[j]])


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_representatives_reach_similarity(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 400)))
        texts += [base, *(edited(rng, base, rng.randrange(1, 2 + len(base.split()) // 25)) for _ in range(4))]
    # One dense group around the limit, and texts that share a long head but not enough.
    base = " ".join(f"g{rng.randrange(5000)}" for _ in range(200))
    texts += [edited(rng, base, rng.randrange(1, 8)) for _ in range(60)]
    texts += [" ".join([f"h{i}" for i in range(150)] + [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 60))]) for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, pairs = brute_kept(texts)
    assert pairs > 300
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == want
    # With few sketches a common shingle, the dense groups are compared exactly in blocks.
    assert sorted(r["doc_id"] for r in simhash.representatives(docs, common=20).collect()) == want
    # Candidate components too large to be compared whole fall apart into their lists.
    least = {}
    for r in simhash.similar(docs, whole_blocks=0).collect():
        least[r["component"]] = min(r["i"], least.get(r["component"], r["i"]))
    assert sorted(least.values()) == want


def test_exact_forest_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = random.Random(3)
    sets = [sorted(rng.sample(range(40), rng.randrange(28, 40))) for _ in range(150)] + [[999], [999, *range(5)]]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len({*sets[i]} & {*sets[j]}) >= 8 * len({*sets[i]} | {*sets[j]})]
    want = brute_components(pairs, range(len(sets)))
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 40)
    members = spark.createDataFrame([(7, i, len(s)) for i, s in enumerate(sets)], "c long, g long, n long")
    table = spark.createDataFrame(list(enumerate(sets)), "g long, s array<long>")
    leaders = simhash._leaders_and_all(simhash._placed(members))
    assert leaders.select("k").distinct().count() == 4  # as many as blocks
    none = spark.createDataFrame([], "a long, b long")
    links = [(r["a"], r["b"]) for r in simhash._group_links(members, table, none, 0.8).where("a <> b").collect()]
    assert brute_components(links, range(len(sets))) == want and set(links) | {(b, a) for a, b in links} <= {*pairs, *((j, i) for i, j in pairs)}
    values, counts = np.concatenate([np.array(s) for s in sets]), np.array([len(s) for s in sets])
    all_ = np.ones(len(sets), bool)
    assert len(simhash.exact_forest(values, counts, all_, all_, 0.8)) == len(sets) - len(set(want.values()))


def test_groups_of_near_copies_cost_a_few_rows_a_text(spark, monkeypatch):
    """Two chains of near copies that only found texts join, a dense group, and one without links."""
    rng = random.Random(6)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 30)
    chain = [list(range(i, i + 20)) for i in range(0, 120, 2)]  # neighbours share 18 of 22
    dense = [sorted(rng.sample(range(1000, 1042), 40)) for _ in range(400)]
    apart = [sorted(rng.sample(range(5000), 20)) for _ in range(100)]
    sets = [*chain, *dense, *apart]
    group = [0] * len(chain) + [1] * len(dense) + [2] * len(apart)
    members = spark.createDataFrame([(c, i, len(s)) for i, (c, s) in enumerate(zip(group, sets))], "c long, g long, n long")
    table = spark.createDataFrame(list(enumerate(sets)), "g long, s array<long>")
    none = spark.createDataFrame([], "a long, b long")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if group[i] == group[j] and 10 * len({*sets[i]} & {*sets[j]}) >= 8 * len({*sets[i]} | {*sets[j]})]
    links = [(r["a"], r["b"]) for r in simhash._group_links(members, table, none, 0.8).collect()]
    assert brute_components(links, range(len(sets))) == brute_components(pairs, range(len(sets)))
    alone = simhash._placed(members.where("c = 1"))
    first = simhash._leaders_and_all(alone)
    assert first.count() <= 2 * len(dense) + 14 * 60
    comp = simhash.components(simhash._exact_links(first, table, 0.8))
    assert simhash._rest_and_all(alone, comp).count() <= 2 * len(dense)


def test_long_lists_are_dealt_out_again(spark):
    rng = random.Random(8)
    fps = {0}
    while len(fps) < 500:  # many with bytes in common, most of them not alike
        fps.add(rng.choice([*fps][:50]) ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(1, 9))))
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    for most in (0, 4, 6):
        pairs = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= most]
        table = spark.createDataFrame([(f,) for f in fps], "fp long")
        links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(table, most, long_list=20).collect()]
        assert brute_components(links, fps) == brute_components(pairs, fps)


def test_null_ids_link_and_names_do_not_clash(spark):
    t = " ".join(f"word{i}" for i in range(60))
    near = t + " end"
    fp = lambda x: brute_fingerprint(x, 5)
    assert 0 < (fp(t) ^ fp(near)).bit_count() <= 7
    docs = spark.createDataFrame([(1, t, "a", 5), (None, near, "b", 6), (None, "alone here", "c", 7)], "doc_id long, text string, gi string, gx int")
    got = {r["fingerprint"] % 2**64: r["component_id"] for r in simhash.near_duplicates(docs, max_bits=7).collect()}
    assert got == {fp(t): 1, fp(near): 1, fp("alone here"): None}
    left = simhash.representatives(docs)
    assert left.columns == docs.columns and sorted(r["gi"] for r in left.collect()) == ["a", "c"]


def test_similar_takes_the_links_of_the_fingerprint_index(spark, monkeypatch):
    def nothing(similarity):
        def run(batches):
            for _ in batches:
                pass
            yield from ()

        return run

    # Without what follows the index, near copies within its radius are linked, and they alone; those below the similarity are not.
    monkeypatch.setattr(simhash, "_candidate_batches", nothing)
    monkeypatch.setattr(simhash, "_exact_batches", nothing)
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(250))
        texts += [base, base.upper() + " " + base.split()[0], edited(rng, base, 1), edited(rng, base, 30)]
    fps, sets = [brute_fingerprint(t, 5) for t in texts], [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    alike = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4 and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j)]
    assert len(pairs) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in simhash.similar(docs).collect():
        got.setdefault(r["component"], []).append(r["i"])
    want = {}
    for i, c in brute_components(pairs, range(len(texts))).items():
        want.setdefault(c, []).append(i)
    assert sorted(sorted(x) for x in got.values()) == sorted(want.values())
