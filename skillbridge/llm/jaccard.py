"""Exact n-gram Jaccard join by signature trees.

Two documents are linked when the Jaccard similarity of their sets of word 5-grams reaches a
threshold. All links count, none is estimated, and no pairs are made within a group of
copies.

* Documents with equal sets are one *node* from the start, by a partial aggregate.
* **Roots.** With one order of all tokens, two similar sets share a token among the first
  ``n - ceil(t * n) + 1`` of each. So the nodes that have such a token there make a tree, and
  only nodes of one tree are compared. Tokens whose least node is the same share a tree, as
  those of a family of near copies mostly do. Tokens that are frequent come
  last in the order. How frequent is counted over all documents, exactly for any token that
  a task meets twice; the order steers the work and can't change the result.
* **Trees.** Below a root, nodes are leaves with their size and a bitmap of their tokens;
  inner nodes hold the OR and AND of the bitmaps and the range of sizes. Two trees are walked
  together from the top: a set that has ``x`` bits outside of another's bitmap has at least
  ``x`` tokens outside, which bounds the overlap of all leaves below, and so do the sizes. A
  pair of inner nodes is left as soon as the bound is below what the threshold asks for, or
  when all leaves below are of one component.
* **Sieve.** A tree's walk returns no pairs but its nodes that may have a link below this root; a pair
  counts at the first root that both have. The walk is repeated with larger bitmaps of the nodes left.
* **Check.** Whole sets of the nodes that remain are compared where the trees are, and a task returns links
  that span the components it finds: fewer than it has nodes, however many pairs are linked. A leaf is first
  compared with all that may be similar and have no partner yet, then with the leaf of another component
  that it may share most with, and last with all of other components.

A root too large for a task is cut into parts by a hash of the node. Nodes that a part leaves alone (in a sieve:
without a partner; in the check, where parts have one node in common: outside of the root's largest component)
are then compared with all nodes of the root; of a group of near copies these are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.components import components
from skillbridge.llm.spans import Texts, chunks, mix, span_hashes, spans, windows
from skillbridge.llm.store import batches_of, bit_filter, may_hold, same, small_batches, tidied, unused, written

WORDS = 5
PERCENT = 80
FREQUENT = 1 << 18  # tokens that the order puts last; the table is sent to all tasks
FREQUENT_FROM = 32  # documents that make a token frequent
COUNTED_TOKENS = 8_000_000  # tokens over which a task counts before it sends
FAN_OUT = 8
# Roots are named by 48 bits of their token: tokens that share them share a root, which costs
# a comparison and no link.
_ROOT_BITS = np.uint64((1 << 48) - 1)
_MET = 100_000  # sets that a task remembers to have sent
SKETCH_BITS = 8  # bits per token of the bitmaps that pairs are checked by, at least
_CELLS = 1 << 20  # words of bitmaps compared at once
STAR_NODES = 4096  # nodes of a root whose whole sets one group takes, about
WALK_NODES = 1 << 16  # and whose bitmaps; beyond it a root is cut into parts
CELL_BYTES = 16 << 20  # of sets or bitmaps in a part, about

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def token_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as hashes in order, and how many each text has."""
    found = spans(texts, _WORD)
    words = span_hashes(_LOWER[texts.data], found.start, found.stop)
    shingles, at = windows(words, found.text, size)
    text = found.text[at]
    # texts with fewer words: their whole sequence is one shingle
    per_text = np.bincount(found.text, minlength=len(texts))
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        first = np.searchsorted(found.text, short)
        whole = np.array([_sequence(words[a : a + n]) for a, n in zip(first, per_text[short], strict=True)], np.uint64)
        shingles, text = np.concatenate([shingles, whole]), np.concatenate([text, short])
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    if len(text):
        new = np.ones(len(text), dtype=bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
        shingles, text = shingles[new], text[new]
    return shingles, np.bincount(text, minlength=len(texts))


def _sequence(words: np.ndarray) -> np.uint64:
    out = np.full(1, 1 + len(words), dtype=np.uint64)
    for w in words:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + w)
    return out[0]


def _set_hash(tokens: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set, whatever the order of its tokens; 0 for an empty set."""
    out = np.zeros(len(count), dtype=np.uint64)
    some = count > 0
    first = (np.cumsum(count) - count)[some]
    if len(first):
        out[some] = mix(np.add.reduceat(mix(tokens ^ np.uint64(seed)), first) + count[some].astype(np.uint64))
    return out


def _node_ids(tokens: np.ndarray, count: np.ndarray, twins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of each set, and a second hash of it.

    The name is a hash, too; where it is one of ``twins``, which several sets of the corpus have,
    it is made of both hashes. So sets are told apart by 128 bits.
    """
    node, check = (_set_hash(tokens, count, seed) for seed in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B))
    if len(twins):
        both = np.isin(node, twins)
        node[both] = mix(node[both] + check[both])
    return node.view(np.int64), check.view(np.int64)


def _renamed(batches: Iterator[pa.RecordBatch], twins: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``_shingled`` whose nodes are twins, under the names that ``_node_ids`` gives these."""
    for batch in batches:
        at, check = (batch.schema.names.index(c) for c in ("node", "check"))
        node = pc.fill_null(batch.column(at), 0).to_numpy(zero_copy_only=False).view(np.uint64).copy()
        other = pc.fill_null(batch.column(check), 0).to_numpy(zero_copy_only=False).view(np.uint64)
        both = np.isin(node, twins) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)
        node[both] = mix(node[both] + other[both])
        columns = list(batch.columns)
        columns[at] = pa.array(node.view(np.int64), mask=batch.column(at).is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Columns ``doc, th, text`` to rows of nodes, and rows of counted tokens.

    Counted are tokens that several documents of the task's share contain.
    """
    held, total, doc_type = [], 0, None

    def flush():
        token, count = np.unique(np.concatenate(held), return_counts=True)
        token, count = token[count > 1].view(np.int64), count[count > 1]
        nothing = [pa.nulls(len(token), t) for t in (doc_type, *[pa.int64()] * 4, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(count), *nothing], _SHINGLED)

    for batch in batches:
        doc_type = batch.schema.field(0).type
        for texts in chunks(batch.column(2)):
            tokens, count = token_sets(texts, size)
            first = np.cumsum(count) - count
            bits = [bitmap(tokens[a : a + n]).tobytes() if n else b"" for a, n in zip(first, count, strict=True)]
            node, check = _node_ids(tokens, count, _NO_TWINS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(texts), pa.int64()),
                    pa.nulls(len(texts), pa.int64()),
                    batch.column(0).slice(texts.first, len(texts)),
                    batch.column(1).slice(texts.first, len(texts)),
                    pa.array(node),
                    pa.array(check),
                    pa.array(count.astype(np.int64)),
                    pa.array(bits, pa.binary()),
                ],
                _SHINGLED,
            )
            held.append(tokens)
            total += len(tokens)
            if total >= COUNTED_TOKENS:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


_SHINGLED = ["token", "n", "doc", "th", "node", "check", "size", "bits"]
_NO_TWINS = np.empty(0, dtype=np.uint64)


def _prefixes(
    batches: Iterator[pa.RecordBatch], size: int, percent: int, frequent, twins: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Column ``text`` to ``token, node`` of the first tokens of each set.

    A set that the task has just met, as copies have, is not sent again.
    """
    hot, rank = frequent.value
    met = np.empty(0, dtype=np.int64)
    for batch in batches:
        for texts in chunks(batch.column(0)):
            tokens, count = token_sets(texts, size)
            text = np.repeat(np.arange(len(count)), count)
            late = np.zeros(len(tokens), dtype=np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                late = np.where(hot[at] == tokens, rank[at], 0)
            order = np.lexsort((tokens, late, text))
            first = np.cumsum(count) - count
            within = np.arange(len(tokens)) - np.repeat(first, count)
            node, _ = _node_ids(tokens, count, twins)
            once = np.zeros(len(node), dtype=bool)
            once[np.unique(node, return_index=True)[1]] = True
            once &= (count > 0) & ~np.isin(node, met)
            met = np.concatenate([met, node[once]])[-_MET:]
            length = np.where(once, count + (-percent * count) // 100 + 1, 0)
            prefix = tokens[order][within < np.repeat(length, count)] & _ROOT_BITS
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix.view(np.int64)), pa.array(np.repeat(node, length))], ["token", "node"]
            )


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``token, node`` in this order to ``root, node`` of tokens with several nodes.

    The root is the least of the token's nodes: tokens with much the same nodes have the same
    one, and share a tree. Only the last token and its root are held, however many nodes it has.
    """
    last_token, last_node, last_root = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        new = np.ones(len(token), dtype=bool)
        new[1:] = token[1:] != token[:-1]
        again = np.zeros(len(token), dtype=bool)
        again[1:] = ~new[1:] & (node[1:] == node[:-1])
        first = np.flatnonzero(new)
        roots = node[first].copy()
        if last_token is not None and token[0] == last_token:
            roots[0] = last_root
            again[0] = node[0] == last_node
        root = np.repeat(roots, np.diff(np.append(first, len(token))))
        others = (node != root) & ~again
        # the root is a node of its tree as well
        pairs = np.stack([np.concatenate([root[others], root[others]]), np.concatenate([node[others], root[others]])])
        last_token, last_node, last_root = token[-1], node[-1], roots[-1]
        if pairs.shape[1]:
            pairs = np.unique(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["root", "node"])


def bitmap(tokens: np.ndarray, per_token: int = 2) -> np.ndarray:
    """Which of ``2 ** k`` values the low bits of the tokens take, ``per_token`` bits or more."""
    bits = max(64, 1 << int(per_token * len(tokens) - 1).bit_length())
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap in ``width`` words: equal low bits stay equal."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width), axis=0)


def _sets(
    batches: Iterator[pa.RecordBatch], size: int, picks, nodes, sketch: bool, twins: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Columns ``pick, text`` to ``node, size, data`` of those that the bit sets let pass.

    ``data`` are the tokens, in order, or a bitmap of them.
    """
    for batch in batches:
        batch = batch.filter(pa.array(may_hold(picks.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
        for texts in chunks(batch.column(1)):
            tokens, count = token_sets(texts, size)
            node, _ = _node_ids(tokens, count, twins)
            first = np.cumsum(count) - count
            rows = np.flatnonzero((count > 0) & may_hold(nodes.value, node.view(np.uint64)))
            sets = [tokens[first[r] : first[r] + count[r]] for r in rows]
            data = [(bitmap(x, SKETCH_BITS) if sketch else x).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[rows]), pa.array(count[rows].astype(np.int64)), pa.array(data, pa.binary())],
                ["node", "size", "data"],
            )


class SignatureTree:
    """Sets under one root, as leaves of a tree of bitmaps and ranges of sizes."""

    def __init__(self, size: np.ndarray, bits: list[bytes], comp: np.ndarray, percent: int) -> None:
        self.percent = percent
        width = min(map(len, bits)) // 8
        leaves = np.array([folded(b, width) for b in bits])
        self.levels = [(leaves, leaves, size, size, comp)]
        while len(self.levels[-1][2]) > 1:
            above, below, least, most, comps = self.levels[-1]
            at = np.arange(0, len(least), FAN_OUT)
            one = np.minimum.reduceat(comps, at) == np.maximum.reduceat(comps, at)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(above, at, axis=0),
                    np.bitwise_and.reduceat(below, at, axis=0),
                    np.minimum.reduceat(least, at),
                    np.maximum.reduceat(most, at),
                    # the component of all leaves below, or no component's number
                    np.where(one & (comps[at] != _MIXED), comps[at], _MIXED),
                )
            )

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of nodes of a level may have linked leaves of different components.

        Their places, and the most that two such leaves can overlap.
        """
        any_bit, all_bits, least, most, comp = self.levels[level]
        t = self.percent
        ok = (comp[a] != comp[b]) | (comp[a] == _MIXED)
        ok &= (100 * most[a] >= t * least[b]) & (100 * most[b] >= t * least[a])
        at = np.flatnonzero(ok)
        a, b = a[at], b[at]
        # an overlap must reach t / (100 + t) of both sizes together
        need = -((-t * (least[a] + least[b])) // (100 + t))
        outside_b = np.bitwise_count(all_bits[a] & ~any_bit[b]).sum(axis=1, dtype=np.int64)
        outside_a = np.bitwise_count(all_bits[b] & ~any_bit[a]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(most[a] - outside_b, most[b] - outside_a)
        fits = bound >= need
        return at[fits], bound[fits]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of leaves that may be linked, from a walk of the tree against itself.

        With the share of the two sizes that they overlap by at most.
        """
        top, size = len(self.levels) - 1, self.levels[0][2]
        zero = np.zeros(1, dtype=np.int64)
        todo = [(top, zero, zero)]
        step = max(64, _CELLS // self.levels[0][0].shape[1])
        while todo:
            level, a, b = todo.pop()
            if len(a) > step:
                todo += [(level, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]
                continue
            if level == 0:
                apart = a < b
                a, b = a[apart], b[apart]
            at, bound = self.may_link(level, a, b)
            a, b = a[at], b[at]
            if not len(a):
                continue
            if level == 0:
                yield a, b, bound / (size[a] + size[b])
                continue
            todo.append((level - 1, *self._below(level - 1, a, b)))

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(self.levels[level][2])
        step = np.arange(FAN_OUT)
        x = (a[:, None, None] * FAN_OUT + step[None, :, None] + 0 * step).reshape(-1)
        y = (b[:, None, None] * FAN_OUT + step[None, None, :] + 0 * step[:, None]).reshape(-1)
        ok = (x < count) & (y < count) & (x <= y)
        return x[ok], y[ok]

    def near(self, leaf: int, open_: np.ndarray, behind: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (``behind``: those behind ``leaf``) that may be linked with it and are open; as ``pairs``."""
        any_bit, _, size, _, comp = self.levels[0]
        mine, n, t = any_bit[leaf], int(size[leaf]), self.percent
        at = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            above, below, least, most, comps = self.levels[level]
            need = -((-t * (n + least[at])) // (100 + t))
            ok = (comps[at] != comp[leaf]) & (100 * most[at] >= t * n) & (100 * n >= t * least[at])
            at, need = at[ok], need[ok]
            out = np.bitwise_count(mine & ~above[at]).sum(axis=1, dtype=np.int64)
            over = np.bitwise_count(below[at] & ~mine).sum(axis=1, dtype=np.int64)
            bound = np.minimum(n - out, most[at] - over)
            at, bound = at[bound >= need], bound[bound >= need]
            if level:
                at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                at = at[at < len(self.levels[level - 1][2])]
                if behind:
                    at = at[(at + 1) * FAN_OUT ** (level - 1) > leaf]
        good = ((at > leaf) if behind else (at != leaf)) & open_[at]
        return at[good], bound[good] / (n + size[at[good]])


_MIXED = np.iinfo(np.int64).min

ROOTS = 16  # of its least roots that a leaf carries
_DENSE = 256  # leaves of a tree whose pairs are all looked at


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that start with ``cell, root``, in order of cell: the root and the other columns of each cell."""
    cell, root, rows = None, 0, []
    for batch in batches:
        cells, roots = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(cells)), strict=True):
            if cells[lo] != cell:
                if rows:
                    yield root, rows
                cell, root, rows = cells[lo], int(roots[lo]), []
            rows.append(tuple(batch.column(k).slice(lo, hi - lo) for k in range(2, batch.num_columns)))
    if rows:
        yield root, rows


def _numbers(rows: list[tuple], column: int) -> np.ndarray:
    return np.concatenate([r[column].to_numpy(zero_copy_only=False) for r in rows])


def _sieved(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``cell, root, node, size, data, roots`` to ``root, node, size`` of nodes that may have a link.

    ``data`` are bitmaps. A pair counts in the cells of the first root that both have.
    """
    for root, rows in _cell_rows(batches):
        node, once = np.unique(_numbers(rows, 0), return_index=True)
        if len(node) < 2:
            continue
        size = _numbers(rows, 1)[once]
        order = np.lexsort((node, size))
        node, size, once = node[order], size[order], once[order]
        data = [x for r in rows for x in r[2].to_pylist()]
        data = [data[k] for k in once]
        roots = _padded([x.values.to_numpy(zero_copy_only=False) for r in rows for x in r[3]])[once]
        some = np.zeros(len(node), dtype=bool)
        for part, comp in _of_one_width(size, np.array([len(x) for x in data]), percent):
            tree = SignatureTree(size[part], [data[k] for k in part], comp, percent)
            some[part] |= _partnered(tree, roots[part], root)
        if some.any():
            columns = [pa.array(np.full(int(some.sum()), root, dtype=np.int64)), pa.array(node[some]), pa.array(size[some])]
            yield pa.RecordBatch.from_arrays(columns, ["root", "node", "size"])


def _of_one_width(size: np.ndarray, width: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of leaves that a tree compares, and components for it: those of one width with each other and
    with wider ones that are not too large. Only these are folded, and not all to the least width of the cell.
    """
    for w in np.unique(width):
        own = width == w
        wider = (width > w) & (percent * size <= 100 * size[own].max())
        part = np.flatnonzero(own | wider)
        if len(part) > 1:
            yield part, np.where(own[part], part, -1)


def _partnered(tree: SignatureTree, roots: np.ndarray, root: int) -> np.ndarray:
    """Which leaves may be linked with another one that has no common root with it below ``root``."""
    met = np.zeros(len(roots), dtype=bool)
    if len(roots) <= _DENSE:
        for a, b, _ in _at_first_root(tree.pairs(), roots, root):
            met[a] = met[b] = True
        return met
    every = np.ones(len(roots), dtype=bool)
    for leaf in range(len(roots)):
        if not met[leaf]:
            near, share = tree.near(leaf, every, behind=False)
            for a, b, _ in _at_first_root(iter([(np.full(len(near), leaf), near, share)]), roots, root):
                met[a] = met[b] = True
    return met


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``cell, root, node, size, data, comp`` to links ``a, b`` that span the components in each cell.

    ``data`` are whole sets. Nodes of one ``comp`` are linked already.
    """
    for _, rows in _cell_rows(batches):
        node, once = np.unique(_numbers(rows, 0), return_index=True)
        comp = _numbers(rows, 3)[once]
        if (comp == comp[0]).all():
            continue
        data = [x for r in rows for x in r[2].to_pylist()]
        sets = [np.frombuffer(data[k], np.uint64) for k in once]
        found = _spanning(sets, comp, percent)
        if found:
            a, b = node[np.array(found).T]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _overlaps(sets: list[np.ndarray], one: int, others: np.ndarray) -> np.ndarray:
    """How many tokens the set ``one`` shares with each of ``others``."""
    own, out = sets[one], []
    step = max(1, _CELLS // len(own))
    for lo in range(0, len(others), step):
        held = [sets[k] for k in others[lo : lo + step]]
        tokens = np.concatenate(held)
        at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
        first = np.cumsum([0, *(len(x) for x in held[:-1])])
        out.append(np.add.reduceat((own[at] == tokens).astype(np.int64), first))
    return np.concatenate(out)


def _spanning(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components: as many as it takes to connect all that links connect."""
    size = np.array([len(x) for x in sets])
    bits = [bitmap(x, SKETCH_BITS).tobytes() for x in sets]
    width = np.array([len(x) for x in bits])
    label = np.unique(comp, return_inverse=True)[1].astype(np.int64)
    links: list[tuple[int, int]] = []

    def connect(one: int, others: np.ndarray) -> None:
        others = others[label[others] != label[one]]
        if not len(others):
            return
        both = _overlaps(sets, one, others)
        hits = others[100 * both >= percent * (size[one] + size[others] - both)]
        if len(hits):
            new, at = np.unique(label[hits], return_index=True)
            links.extend((one, int(k)) for k in hits[at])
            label[np.isin(label, new)] = label[one]

    def trees():
        order = np.lexsort((size, label))
        for part, own in _of_one_width(size[order], width[order], percent):
            at = order[part]
            comps = np.where(own >= 0, label[at], -1)
            if (comps != comps[0]).any():
                yield at, SignatureTree(size[at], [bits[k] for k in at], comps, percent)

    for at, tree in trees():
        open_ = np.ones(len(at), dtype=bool)
        for leaf in range(len(at) - 1):
            if open_[leaf]:
                near, _ = tree.near(leaf, open_)
                if len(near):
                    connect(int(at[leaf]), at[near])
                    open_[near[label[at[near]] == label[at[leaf]]]] = False
    for complete in (False, True):
        if (label == label[0]).all():
            break
        for at, tree in trees():
            found = tree.pairs()
            for a, b, _ in found if complete else _nearest(found, len(at)):
                by = np.argsort(a, kind="stable")
                a, b = at[a[by]], at[b[by]]
                cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                for lo, hi in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
                    connect(int(a[lo]), b[lo:hi])
    return links


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), ROOTS), np.iinfo(np.int64).max)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _at_first_root(found, roots: np.ndarray, root: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs without a common root below ``root``: each pair of leaves once over all trees.

    Leaves know their least :data:`ROOTS` roots only; pairs that have no common one among these may
    be returned by several trees.
    """
    step = max(1, _CELLS // ROOTS**2)
    for a, b, share in found:
        for lo in range(0, len(a), step):
            x, y = roots[a[lo : lo + step]], roots[b[lo : lo + step]]
            below = ((x[:, :, None] == y[:, None, :]) & (x < root)[:, :, None]).any(axis=(1, 2))
            first = lo + np.flatnonzero(~below)
            if len(first):
                yield a[first], b[first], share[first]


def _nearest(found, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of all pairs the one with the greatest share for each leaf."""
    best, with_ = np.full(count, -1.0), np.zeros(count, dtype=np.int64)
    for a, b, share in found:
        for own, other in ((a, b), (b, a)):
            order = np.lexsort((-share, own))
            first = order[np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])]
            better = first[share[first] > best[own[first]]]
            best[own[better]], with_[own[better]] = share[better], other[better]
    some = np.flatnonzero(best >= 0)
    if len(some):
        yield some, with_[some], best[some]


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int, sketch: bool, twins: np.ndarray) -> DataFrame:
    """``node, size, data`` of the nodes in ``wanted``, from one document each; a node may come twice."""
    spark = docs.sparkSession
    one = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc", "th")).alias("d"))
    picked = written(one.select("node", F.xxhash64("d.doc", "d.th").alias("pick")), "shingle-picks")
    picks = spark.sparkContext.broadcast(bit_filter(picked, "pick"))
    some = spark.sparkContext.broadcast(bit_filter(picked, "node"))
    rows = docs.select(F.xxhash64("doc", "th").alias("pick"), "text")
    return rows.mapInArrow(tidied(lambda b: _sets(b, size, picks, some, sketch, twins)), "node long, size long, data binary")


def _count(limit: int, token_bytes: float) -> Column:
    """How many parts some nodes make."""
    return F.greatest(F.ceil(F.count("*") / limit), F.ceil(F.sum("size") * token_bytes / CELL_BYTES))


def _parts(live: DataFrame, limit: int, token_bytes: float) -> DataFrame:
    """``root, parts, pivot``: how many parts the nodes of each root make, and one of its nodes."""
    return live.groupBy("root").agg(_count(limit, token_bytes).alias("parts"), F.min("node").alias("pivot"))


def _part() -> Column:
    return F.pmod(F.xxhash64("node"), "parts")


def _numbers_below(count: str) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)


def _outside(rows: DataFrame, limit: int, token_bytes: float) -> DataFrame:
    """``in`` for rows ``root, node, size, parts, outside``: each node outside with all nodes of its root.

    A cell has a part of all nodes and a part of those outside, so a row of the others has a copy for each part
    of those outside only.
    """
    counted = rows.filter("outside").groupBy("root").agg(_count(limit, token_bytes).alias("others"))
    rows = rows.join(counted, "root")
    other = F.pmod(F.xxhash64(F.lit(1), "node"), "others")
    cell = lambda a, b: F.struct(F.xxhash64("root", a, b).alias("cell"), "root")
    cells = F.transform(_numbers_below("others"), lambda k: cell(_part(), k))
    more = F.transform(_numbers_below("parts"), lambda k: cell(k, other))
    return rows.withColumn("in", F.when(F.col("outside"), F.array_distinct(F.concat(cells, more))).otherwise(cells))


def _by_cell(cells: DataFrame, data: DataFrame, *more: str) -> DataFrame:
    """Rows ``node, in`` (cells and roots) with the node's ``size, data`` as rows of cells, in their order."""
    rows = cells.join(data, "node").select(F.inline("in"), "node", "size", "data", *more)
    return rows.repartition("cell").sortWithinPartitions("cell")


def _sieve(live: DataFrame, data: DataFrame, token_bytes: float, percent: int) -> DataFrame:
    """The rows ``root, node, size`` of ``live`` that may have a link there, by the bitmaps in ``data``.

    A root too large for a task is cut into parts; nodes that have no partner in their own part are then
    compared with all parts.
    """
    # a node has no more roots than tokens that come first
    least = F.slice(F.array_sort(F.collect_set("root")), 1, ROOTS).alias("roots")

    def sieved(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
        cells = rows.groupBy("node").agg(F.flatten(F.collect_list("in")).alias("in"), least)
        if more is not None:
            cells = cells.drop("roots").join(more, "node")
        found = _by_cell(cells, data, "roots").mapInArrow(
            tidied(lambda b: _sieved(b, percent)), "root long, node long, size long"
        )
        return written(found, "shingle-live")

    parts = _parts(live, WALK_NODES, token_bytes)
    own = F.array(F.struct(F.xxhash64("root", _part()).alias("cell"), "root"))
    found = sieved(live.join(parts, "root").withColumn("in", own))
    large = parts.filter("parts > 1").select("root", "parts")
    if large.isEmpty():
        return found
    met = found.select("root", "node", F.lit(False).alias("outside"))
    rows = live.join(large, "root").join(met, ["root", "node"], "left").fillna(True, "outside")
    rows = _outside(written(rows, "shingle-large"), WALK_NODES, token_bytes)
    return found.union(sieved(rows, live.groupBy("node").agg(least))).distinct()


def _set_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` from rows ``node, comp, in``."""
    rows = _by_cell(cells, sets, "comp")
    return written(rows.mapInArrow(tidied(lambda b: _linked(b, percent)), "a long, b long"), "shingle-links")


def _first_cells(live: DataFrame) -> DataFrame:
    """Whole roots; a large one is cut into parts that all have its pivot."""
    rows = live.join(_parts(live, STAR_NODES, 8), "root")
    own = F.when(F.col("node") == F.col("pivot"), _numbers_below("parts")).otherwise(F.array(_part()))
    cells = F.transform(own, lambda k: F.struct(F.xxhash64("root", k).alias("cell"), "root"))
    cells = rows.select("node", cells.alias("in")).groupBy("node").agg(F.flatten(F.collect_list("in")).alias("in"))
    return cells.withColumn("comp", F.col("node"))


def _last_cells(live: DataFrame, comps: DataFrame) -> DataFrame:
    """Of roots in several parts: each node outside of the root's largest component with all nodes of it."""
    large = _parts(live, STAR_NODES, 8).filter("parts > 1").select("root", "parts")
    rows = live.join(large, "root").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = written(rows, "shingle-large")
    by = rows.groupBy("root", "comp").agg(F.count("*").alias("n"))
    main = by.groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    rows = rows.join(main, "root").withColumn("outside", F.col("comp") != F.col("main"))
    rows = _outside(rows, STAR_NODES, 8)
    return rows.groupBy("node").agg(F.first("comp").alias("comp"), F.flatten(F.collect_list("in")).alias("in"))


def similar_nodes(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``doc, th, node, size`` of all rows and ``node, comp`` of the nodes that have a link.

    ``docs`` has columns ``doc, th, text``; a node stands for all rows with its set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc"].dataType.simpleString()
    columns = f"token long, n long, doc {kind}, th long, node long, check long, size long, bits binary"
    shingled = docs.select("doc", "th", "text").mapInArrow(tidied(lambda b: _shingled(b, size)), columns)
    shingled = written(shingled, "shingles")
    # names that several sets have: none, but for one in some billions of sets
    several = shingled.filter("size > 0").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
    twins = several.filter("lo <> hi").select("node").toPandas()["node"].to_numpy(np.int64).view(np.uint64)
    if len(twins):
        shingled = written(shingled.mapInArrow(lambda b: _renamed(b, twins), columns), "shingles")
    nodes = shingled.filter("n IS NULL").select("doc", "th", "node", "size")
    counts = shingled.filter("n IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    # the most frequent last; tokens as frequent in the order of their hashes
    top = top.assign(token=top["token"].to_numpy(np.int64).view(np.uint64)).sort_values("token")
    frequent = spark.sparkContext.broadcast((top["token"].to_numpy(), top["n"].to_numpy(np.int64)))

    tokens = docs.select("text").mapInArrow(
        tidied(lambda b: _prefixes(b, size, percent, frequent, twins)), "token long, node long"
    )
    dealt = tokens.repartition("token").sortWithinPartitions("token", "node")
    with batches_of(spark, 2000):
        roots = written(dealt.mapInArrow(_roots, "root long, node long").dropDuplicates(), "shingle-roots")
    leaves = (
        shingled.filter("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("data"))
    )
    sizes = nodes.filter("size > 0").select("node", "size").distinct()
    # bitmaps of 2 to 4 bits a token, and of four times as many
    live = _sieve(written(roots.join(sizes, "node"), "shingle-trees"), leaves, 0.5, percent)
    live = _sieve(live, _sets_of(docs, nodes, live, size, True, twins), 2, percent)
    links = _set_links(_first_cells(live), _sets_of(docs, nodes, live, size, False, twins), percent)
    comps = components(links)
    if not _parts(live, STAR_NODES, 8).filter("parts > 1").isEmpty():
        cells = written(_last_cells(live, comps), "shingle-cells")
        more = _set_links(cells, _sets_of(docs, nodes, cells, size, False, twins), percent)
        comps = components(links.union(more))
    return nodes, comps


def similar(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, th, component`` of every row.

    A text's words are runs of characters other than blanks (ASCII), in lower case A-Z; its
    set are its ``size``-word shingles, or its whole sequence if it has fewer words. Rows
    link when ``100 * intersection >= percent * union``; ``component_id`` is the least id
    reachable by links. Texts that are NULL, empty or without words have no shingles and are
    components of their own. Repeated rows and ids are legal and give a row each; a NULL id
    is never a component's id unless nothing else is. ``th`` is a hash of the text and ``component`` another name of the component (NULL
    without shingles). Texts of any length count whole. An empty
    table gives an empty one; other columns are not read.
    """
    source = docs.select(
        F.col(f"`{doc_id}`").alias("doc"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"),
        F.col(f"`{text}`").alias("text"),
    )
    nodes, comps = similar_nodes(source, size, percent)
    # nodes without a link to another text are components by themselves
    labelled = nodes.filter("size > 0").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = labelled.groupBy("comp").agg(F.min("doc").alias("least"))
    some = labelled.join(least, "comp").select("doc", "th", "size", "least", "comp")
    none = nodes.filter("size = 0").select("doc", "th", "size", F.col("doc").alias("least"))
    return some.unionByName(none, allowMissingColumns=True).select(
        F.col("doc").alias(doc_id),
        F.col("size").alias("n_shingles"),
        F.col("least").alias("component_id"),
        "th",
        F.col("comp").alias("component"),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the least id (NULL last).

    Of rows that share that id the text with the least hash stays, and of rows equal in id
    and text one. Texts without words all stay, but for such repeats. All columns are kept, whatever
    their names; an empty table gives an empty one.
    """
    groups = written(similar(docs, text, doc_id).withColumnRenamed(doc_id, "doc"), "near-groups")
    rows = groups.groupBy("doc", "th", "component").agg(F.count("*").alias("n"))
    order = F.struct(F.isnull("doc").alias("unnamed"), "doc", "th")
    best = F.min_by(F.struct("doc", "th", "n"), order).alias("best")
    keep = rows.filter("component IS NOT NULL").groupBy("component").agg(best).select("best.*")
    keep = keep.unionByName(rows.filter("component IS NULL").select("doc", "th", "n"))
    doc, th, count = unused(docs.columns, "_doc", "_th", "_n")
    keep = written(keep.toDF(doc, th, count), "near-kept")
    here = same(F.col(f"`{doc_id}`"), F.col(doc)) & (
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col(th)
    )
    once = docs.join(keep.filter(F.col(count) == 1).hint("shuffle_hash"), here, "left_semi")
    several = keep.filter(F.col(count) > 1)
    if several.isEmpty():
        return once
    more = docs.join(several.hint("shuffle_hash"), here).dropDuplicates([doc, th])
    return once.unionByName(more.select(*[F.col(f"`{c}`") for c in docs.columns]))


def oracle(size: int = WORDS, percent: int = PERCENT) -> str:
    """DuckDB SQL for the query over ``documents``: all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END)) AS s
  FROM worded
), sizes AS (
  SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN sets USING (doc_id) GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= {percent} * (x.n + y.n - o)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sizes"""
