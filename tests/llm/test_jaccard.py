import random
import re

import numpy as np
import pytest
from rows import docs_of, mirrored

from skillbridge.llm import jaccard
from skillbridge.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return sorted(((i, len(s), ids.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    for _ in range(40):  # a shared passage in texts of all lengths
        add([rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))] + passage)
    for size in (6, 12, 40, 120, 400):  # families around the threshold
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4, 6):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            add(words)
        add(base[: int(size * 0.8)])
        add(base[: int(size * 0.82)] + ["more"])
        add([w.upper() for w in base])
    for _ in range(60):  # a chain: each drops a word in front and gains one at the end
        add(rows[-1][1].split()[1:] + [rng.choice(vocabulary)])
    for k in range(90):  # near copies of one text
        words = list(passage) * 3
        words[k % 100] = f"v{k}"
        add(words)
    rows += [(900, ""), (901, None), (902, " \n\t "), (903, "one two"), (904, "ONE\ttwo"), (None, "one  two"), (905, "x"), (906, "y")]
    rows += [(None, "nobody knows this one here at all"), (1, rows[1][1]), (1, rows[1][1]), (1, "another text of the same id as it is")]
    return rows


def got(spark, rows, **kw):
    out = jaccard.similar(docs_of(spark, rows), **kw)
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()], key=str)


def test_components_as_by_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_components_when_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_NODES", 4)
    monkeypatch.setattr(jaccard, "WALK_NODES", 16)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3)
    monkeypatch.setattr(jaccard, "FAN_OUT", 2)
    rows = corpus(8)
    assert got(spark, rows) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(11)
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "node", "source": "size"})
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    sets = {i: shingles(t) for i, t in kept if i is not None}
    comps = brute(rows)
    # one row for every component with words, under its least id
    with_words = [i for i, t in kept if shingles(t)]
    assert set(with_words) == {c for _, n, c in comps if n}
    assert len(with_words) == len(set(with_words)) + 1  # id 1 names a text of its own as well
    assert {i for i, s in sets.items() if not s} == {900, 901, 902}
    same_id = docs_of(spark, [(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "A b c"), (3, None), (3, None), (None, "a b c")])
    left = sorted([(r.doc_id, r.text) for r in jaccard.one_of_each(same_id).collect()], key=str)
    assert left == [(1, "a b c"), (1, "d e f"), (3, None)]


def test_empty_table(spark):
    assert got(spark, []) == []
    assert jaccard.one_of_each(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("fan_out", [2, 8])
def test_tree_loses_no_pair(fan_out, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN_OUT", fan_out)
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (3, 30, 33, 200, 240)]
    sets = []
    for k in range(70):
        keep = base[k % 5][rng.random(len(base[k % 5])) < rng.choice([0.85, 0.95, 1])]
        sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 62, 1 + k % 4).astype(np.uint64))))
    size = np.array([len(s) for s in sets])
    comp = rng.integers(0, 60, len(sets))
    tree = jaccard.SignatureTree(size, [jaccard.bitmap(s).tobytes() for s in sets], comp, 80)
    found = {(i, j) for a, b, _ in tree.pairs() for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    every = np.ones(len(sets), dtype=bool)
    for i in range(len(sets)):
        near = set(tree.near(i, every)[0].tolist())
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and 100 * both >= 80 * (size[i] + size[j] - both):
                assert (i, j) in found and j in near
    assert len(found) < len(sets) ** 2 / 4


def test_components_of_a_graph(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 1), (20, 21), (21, 20), (30, 30), (7, 20)] + [(100 + k, 101 + k) for k in range(60)]
    out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: out[k] for k in (1, 3, 4, 5, 9)} == dict.fromkeys((1, 3, 4, 5, 9), 1)
    assert out[7] == out[20] == out[21] == 7 and out[30] == 30
    assert {out[100 + k] for k in range(61)} == {100}


def components_of(spark, rows):
    out = jaccard.similar(docs_of(spark, rows)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def test_sets_that_hashes_may_confuse(spark, monkeypatch):
    rows = [(k, f"{word} b c d e") for k, word in enumerate([*mirrored(1024), *mirrored(4096)])]
    assert components_of(spark, rows) == brute(rows)
    # all sets of an even size share their first hash
    own = jaccard._set_hash

    def blunt(tokens, count, seed):
        out = own(tokens, count, seed)
        if seed == 0xA5A5A5A5A5A5A5A5:
            out[(count > 0) & (count % 2 == 0)] = 77
        return out

    monkeypatch.setattr(jaccard, "_set_hash", blunt)
    rows = [(10 * k + n, f"{k} " * 6 + " ".join(f"v{k}w{j}" for j in range(40 - n % 3))) for k in range(6) for n in range(5)]
    rows += [(k, "very short") for k in range(100, 104)] + [(200, "long text of many words " + "x y z " * 30_000)]
    assert components_of(spark, rows) == brute(rows)


def test_a_pair_is_met_at_its_first_common_root():
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(40, rng.integers(1, jaccard.ROOTS + 1), replace=False)) for _ in range(60)]
    padded = jaccard._padded(lists)
    pairs = np.array([(a, b) for a in range(60) for b in range(a)])
    met = {}
    for root in range(40):
        here = np.array([root in lists[a] and root in lists[b] for a, b in pairs])
        found = iter([(pairs[here, 0], pairs[here, 1], np.ones(here.sum()))])
        for a, b, _ in jaccard._at_first_root(found, padded, root):
            for pair in zip(a.tolist(), b.tolist(), strict=True):
                assert pair not in met
                met[pair] = root
    assert met == {(a, b): min(both) for a, b in pairs.tolist() if (both := set(lists[a]) & set(lists[b]))}


def test_nearest_partner_of_each_leaf():
    rng = np.random.default_rng(6)
    share = {(a, b): rng.random() for a in range(12) for b in range(a) if rng.random() < 0.4}
    rows = [(np.array([a]), np.array([b]), np.array([s])) for (a, b), s in share.items()]
    (some, partner, best), = list(jaccard._nearest(iter(rows), 12))
    for a, b, s in zip(some.tolist(), partner.tolist(), best.tolist(), strict=True):
        assert s == max(v for pair, v in share.items() if a in pair) == share[max(a, b), min(a, b)]


def test_roots_are_streamed():
    """Tokens that go on over many batches, with repeated nodes."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.randrange(30), rng.randrange(12)) for _ in range(600)) + [(50, 1), (51, 2), (51, 2)]
    for size in (1, 7, 1000):
        batches = [
            pa.RecordBatch.from_pydict({"token": [t for t, _ in rows[k : k + size]], "node": [n for _, n in rows[k : k + size]]})
            for k in range(0, len(rows), size)
        ]
        got = {p for b in jaccard._roots(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        want = set()
        for token in {t for t, _ in rows}:
            nodes = {n for t, n in rows if t == token}
            want |= {(min(nodes), n) for n in nodes} if len(nodes) > 1 else set()
        assert got == want


def near_copies(count, size=60, seed=4):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(1000)}" for _ in range(size)]
    return [" ".join(base[:k] + [f"v{n}"] + base[k + 1 :]) for n, k in enumerate(rng.randrange(size) for _ in range(count))]


def rows_made(spark, rows, monkeypatch):
    """Rows of each intermediate table of the join, by name."""
    made, own = {}, jaccard.written

    def counted(df, name):
        out = own(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    assert got(spark, rows) == brute(rows)
    monkeypatch.setattr(jaccard, "written", own)
    return made


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Near copies in two families that share a passage: no pairs leave a task, but links that span the groups."""
    most = []
    for count in (40, 160):
        texts = near_copies(count) + [t + " w" * 30 + f" x{k}" for k, t in enumerate(near_copies(count))]
        # texts that overlap by a little less than it takes, each with each
        texts += [" ".join([*(f"c{j}" for j in range(60)), *(f"d{k}e{j}" for j in range(9))]) for k in range(count)]
        made = rows_made(spark, list(enumerate(texts)), monkeypatch)
        # of all the steps after the roots
        most.append(max(n for name, counts in made.items() for n in counts if name not in ("shingles", "shingle-roots")))
        assert sum(made["shingle-links"]) < 2 * len(texts)
        assert len([name for counts in made.values() for name in counts]) < 20
    assert most[1] < 6 * most[0]


def test_parts_of_a_large_root(spark, monkeypatch):
    """Of near copies in parts, only those outside of the largest component meet all others."""
    for name, value in (("STAR_NODES", 16), ("WALK_NODES", 32)):
        monkeypatch.setattr(jaccard, name, value)
    texts = near_copies(150, 200)
    texts += [" ".join(texts[0].split()[:170] + [f"z{k}y{j}" for j in range(5 + k)]) for k in range(12)]
    made = rows_made(spark, list(enumerate(texts)), monkeypatch)
    assert "shingle-large" in made and sum(made["shingle-links"]) < 3 * len(texts)


def test_links_span_what_is_linked():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (4, 40, 44, 300)]
    for _ in range(5):
        sets = [
            np.unique(np.append(b[rng.random(len(b)) < rng.choice([0.8, 0.9, 0.97])], rng.integers(0, 1 << 62, 1 + k % 3).astype(np.uint64)))
            for k, b in ((k, base[k % 4]) for k in range(60))
        ]
        comp = rng.integers(0, 50, len(sets))
        linked = [(i, j) for i in range(60) for j in range(i) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - o)]

        def groups(links):
            label = comp.copy()
            for i, j in links:
                label[label == label[i]] = label[j]
            return {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}

        links = jaccard._spanning(sets, comp, 80)
        assert {(max(p), min(p)) for p in links} <= set(linked)
        assert groups(links) == groups(linked) and len(links) == len(set(comp.tolist())) - len(groups(linked))


def test_a_small_set_does_not_blunt_the_others():
    """Sets of one cell that overlap little, with a very small one: only the near copies may have a link."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    shared = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = [np.append(shared, rng.integers(0, 1 << 62, 300 + 9 * k).astype(np.uint64)) for k in range(20)]
    sets += [sets[4][1:], shared[:5]]
    count = len(sets)
    batch = pa.RecordBatch.from_pydict(
        {
            "cell": [1] * count,
            "root": [1] * count,
            "node": list(range(count)),
            "size": [len(x) for x in sets],
            "data": [jaccard.bitmap(x).tobytes() for x in sets],
            "roots": [[1]] * count,
        }
    )
    out = [n for b in jaccard._sieved(iter([batch]), 80) for n in b.column("node").to_pylist()]
    assert sorted(out) == [4, 20]
