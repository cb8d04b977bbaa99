"""SimHash groups against all pairs."""

import random
import re

import pytest
import xxhash

from spendgrid.llm.simhash import _connect, fingerprint, keep_representatives, simhash_groups


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    known = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            known[find(i)] = min(known.get(find(i), d), d)
    return sorted(((d, format(p, "016x"), known.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def rows_of(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    out = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 400]))]
        out.append((len(out), " ".join(words)))
        for _ in range(rng.randint(0, 2)):  # near copies
            words[rng.randrange(len(words))] = "X"
            out.append((len(out), "\t".join(words).upper()))
    return out + [(900, None), (901, ""), (902, " \n "), (None, "w1 w2"), (None, "lonely text here"), (903, "Ä É w1"), (903, "Ä É w1"), (904, "long " * 70_000)]


def test_groups_match_all_pairs(make_docs):
    rows = rows_of()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(make_docs(rows)).collect()), key=str)
    assert got == brute_groups(rows)


@pytest.mark.parametrize("n", [2, 20, 33, 500])
def test_list_links_connect_what_all_pairs_connect(n):
    rng = random.Random(n)
    values = rng.sample(range(4096), n)

    def parts(links):
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in links:
            root[find(i)] = find(j)
        return {frozenset(i for i in range(n) if find(i) == r) for r in map(find, range(n))}

    every = [(i, j) for i in range(n) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    links = _connect(values, 2)
    assert parts(links) == parts(every) and set(map(frozenset, links)) <= set(map(frozenset, every))


def test_fingerprint_edges():
    assert fingerprint(None, 3) == fingerprint(" \t", 3) == 0
    assert fingerprint("One two", 3) == xxhash.xxh64_intdigest(b"one two", 42)


def test_empty_table_and_columns(make_docs):
    assert simhash_groups(make_docs([])).collect() == []
    docs = make_docs([(2, "same text of words"), (1, "same text of words"), (1, "same text of words"), (3, "another one entirely")])
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def two_bits_off(words, rng):
    """A copy of the words with one changed, whose fingerprint is near but not the same."""
    for _ in range(10_000):
        other = list(words)
        other[rng.randrange(len(words))] = "X%d" % rng.randrange(10**6)
        if 0 < (brute_fingerprint(" ".join(words)) ^ brute_fingerprint(" ".join(other))).bit_count() <= 2:
            return other
    raise AssertionError("no near copy found")


def test_null_and_repeated_ids_keep_each_different_text(make_docs):
    rng = random.Random(1)
    a, b, c, d = ([f"{v}{rng.randrange(10**6)}" for _ in range(400)] for v in "abcd")
    near_a, near_d = two_bits_off(a, rng), two_bits_off(d, rng)
    rows = [(7, a), (None, near_a), (None, b), (None, b), (None, c), (5, ["same", "id", "one"]), (5, ["same", "id", "two", "other"]), (None, d), (None, near_d)]
    rows = [(i, " ".join(t)) for i, t in rows]
    kept = [(r.doc_id, r.text) for r in keep_representatives(make_docs(rows)).collect()]
    want = [rows[0], rows[2], rows[4], rows[5], rows[6]]
    assert sorted((x for x in kept if x not in rows[7:]), key=str) == sorted(want, key=str)
    assert len([x for x in kept if x in rows[7:]]) == 1  # two near copies without an id: one of them
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(make_docs(rows)).collect()), key=str)
    assert got == brute_groups(rows)


def test_one_id_does_not_merge_groups(make_docs):
    rng = random.Random(2)
    a, b = ([f"{v}{rng.randrange(10**6)}" for _ in range(400)] for v in "ab")
    rows = [(i, " ".join(t)) for i, t in [(4, a), (4, b), (2, two_bits_off(a, rng))]]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(make_docs(rows)).collect()}
    assert got == {(i, format(brute_fingerprint(t), "016x"), c) for (i, t), c in zip(rows, [2, 4, 2])}
    assert {(r.doc_id, r.text) for r in keep_representatives(make_docs(rows)).collect()} == {rows[1], rows[2]}


def test_more_bits_than_the_index_covers(make_docs):
    with pytest.raises(ValueError):
        simhash_groups(make_docs([]), max_bits=3)
