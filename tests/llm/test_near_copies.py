"""Near copies within a MinHash key that many texts share: every pair is decided, not only those that look most alike."""

import random

import numpy as np

from quillet.llm import shingles, simhash


def rooted(n, linked):
    """The least place each of n places reaches over linked pairs."""
    root = list(range(n))
    for a, b in linked:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def brute_kept(texts):
    """Places that stay: one for each component of fingerprints, then one for each of texts that share a key and are alike."""
    fps = [simhash.fingerprint_of(t.encode()) for t in texts]
    root = rooted(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS])
    left = [i for i, r in enumerate(root) if i == r]
    sets = [shingles.shingle_set(texts[i].encode()) for i in left]
    keys = [set(shingles.signature(s)[0].tolist()) for s in sets]

    def alike(a, b):
        both = len(np.intersect1d(a, b))
        return both >= shingles.SIMILARITY * (len(a) + len(b) - both)

    linked = [(i, j) for i in range(len(left)) for j in range(i) if keys[i] & keys[j] and alike(sets[i], sets[j])]
    return [left[i] for i, r in enumerate(rooted(len(left), linked)) if i == r]


def crowd(seed, n=80, words=200):
    """Pairs of texts just alike enough, in a crowd of texts that are almost as like each of them: a sketch cannot tell which is which."""
    rnd = random.Random(seed)

    def changed(text, k):
        out = list(text)
        for at in rnd.sample(range(len(out)), k):
            out[at] = f"w{rnd.randrange(10**6)}"
        return out

    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    first = [changed(base, 3) for _ in range(n)]
    texts = first + [changed(t, 4) for t in first]
    rnd.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_all_pairs_of_a_key_are_decided(spark):
    texts = crowd(4)
    want = brute_kept(texts)
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want and 1 < len(want) < len(texts)
