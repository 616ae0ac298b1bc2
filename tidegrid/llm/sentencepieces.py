"""SentencePiece encoding and decoding with sampled segmentations by Gumbel top-k without replacement.

Encoding. Pieces never cross the start of a word, so a text is encoded word by word, each distinct
word of a task once. Decoding joins the pieces' bytes.

Sampling. A word's lattice has a node for each of its characters and an arc for every vocabulary
piece that stands there (bytes where no piece does); a path is a segmentation, its probability
proportional to the product of its pieces' weights. Backward log-sums turn the weights into the
probability of each arc given its node: an exact bound for the search, as they are the mass of
everything behind a node. A text's lattice is its words' lattices in a row. A best-first (A-star)
search draws the top k perturbed log-probabilities from the top down: a search node is a set of
paths with a common beginning, its key the maximum of their Gumbel-perturbed log-probabilities. The
maximum of a search node runs along a path drawn arc by arc; at each word, the paths that write it
otherwise form a search node whose maximum is a Gumbel truncated at its parent's. Popping the best
one k times yields k distinct segmentations, sampled without replacement. With kappa, the (k+1)-th
key, a segmentation's inclusion score is 1 - exp(-exp(log p - kappa)). Every draw is a hash of the
row's key and its place, so samples don't depend on how rows are batched.

Edge cases: null and empty texts have no pieces, decode to the empty text and have one (empty)
segmentation; texts with fewer than k segmentations return all of them with score 1; ties: equal
rows, and rows of one doc_id, draw from equal hashes, so equal rows get equal samples; a null doc_id
seeds like 0; U+2581 is a blank to the vocabulary and decodes to a space; a very long text is worked
through alone, with memory in proportion to it; empty tables give empty results; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 3
#: Sharpness of the distribution over segmentations: log p is proportional to it.
ALPHA = 0.6
SEED = 20240
#: Texts that are worked on at once: rows, and characters beyond which no further row joins them.
ROWS, CHARS = 256, 1 << 19
#: Words that a task keeps for texts to come, and lattice arcs for each of them; beyond, it starts afresh. Memory against time: results don't depend on it.
KEPT, ARCS = 400_000, 22
#: Words that are learnt at once.
LEARNT = 4000
_BLANK = "▁"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_bytes(processor) -> list[bytes]:
    """What each piece stands for in a text."""
    out = []
    for i in range(processor.vocab_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[1:-1], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace(_BLANK, " ").encode())
    return out


def words_of(text: str) -> list[str]:
    """The text cut before each run of blanks, with the blank that encoding puts in front."""
    parts = text.replace(_BLANK, " ").split(" ")
    if "" not in parts[:-1] and parts[-1] != "":
        return parts
    out, blanks = [], 0
    for i, p in enumerate(parts):
        if p == "" and i < len(parts) - 1:
            blanks += 1
        else:
            out.append(" " * blanks + p)
            blanks = 0
    return out


class Grown:
    """An array that grows at its end, of rows of `width` numbers if one is given; `room` rows are set aside at first, and no memory is used for them before they are written."""

    def __init__(self, kind: type, room: int = 1024, width: int = 0) -> None:
        self.held, self.n = np.empty((room, width) if width else room, kind), 0

    def add(self, *values: np.ndarray) -> None:
        """Adds the numbers, or a row's numbers as so many columns."""
        n = self.n + len(values[0])
        if n > len(self.held):
            held = np.empty((max(n, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        if self.held.ndim == 1:
            self.held[self.n : n] = values[0]
        else:
            for i, column in enumerate(values):
                self.held[self.n : n, i] = column
        self.n = n

    def clear(self) -> None:
        """The memory stays, for the next ones."""
        self.n = 0


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges (start, size), one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(seed: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """A random long for each seed and place."""
    if isinstance(place, int):
        return _scrambled(seed + np.uint64((place + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return _scrambled(seed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _key(seed: int, place: int) -> int:
    """The same for a single one."""
    x = (seed + (place + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def _unit(key: int) -> float:
    return ((key >> 11) + 0.5) * 2.0**-53


def unit(keys: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both left out."""
    return ((keys >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattice:
    """The lattices of words, side by side. Arcs of a node lie together, the longest piece first; -1 ends a word.

    p and logp are an arc's probability given its node, other is that of the node's other arcs, cum
    the running sum of p (infinite at the node's last arc): four numbers side by side, as a walk needs them together. Pieces are found by a 64-bit hash of
    their characters, by the hash's leading bits first.
    """

    BASE = np.uint64(0x100000001B3)

    def __init__(self, processor, alpha: float = ALPHA, room: int = 1024) -> None:
        size = processor.vocab_size()
        weight = -alpha * np.log(np.arange(size) + 3.0)
        plain = [i for i in range(size) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
        # Every beginning of a piece, so that a search ends where no piece goes on; only whole pieces have an id.
        held: dict[int, int] = {}
        for i in plain:
            h = 0
            for c in processor.id_to_piece(i):
                h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                held.setdefault(h, -1)
            held[h] = i
        hashes = np.fromiter(held, np.uint64, len(held))
        slots = self._slot(hashes)
        order = np.argsort(slots, kind="stable")
        self.hashes, self.ids, self.weight = hashes[order], np.fromiter(held.values(), np.int32, len(held))[order], weight
        self.at, self.crowd = np.full(1 << 22, -1, np.int32), int(np.bincount(slots.astype(np.int64)).max())
        self.at[slots[order][::-1]] = np.arange(len(held))[::-1]
        self.longest = max(len(processor.id_to_piece(i)) for i in plain)
        self.of_byte = np.zeros(256, np.int32)
        for i in range(size):
            if processor.is_byte(i):
                self.of_byte[int(processor.id_to_piece(i)[1:-1], 16)] = i
        self.first, self.last, self.to, self.piece = (Grown(np.int32, room) for _ in range(4))
        self.chances = Grown(np.float64, room, 4)

    def clear(self) -> None:
        for held in (self.first, self.last, self.to, self.piece, self.chances):
            held.clear()

    @property
    def p(self) -> np.ndarray:
        return self.chances.held[:, 1]

    @property
    def logp(self) -> np.ndarray:
        return self.chances.held[:, 2]

    @property
    def other(self) -> np.ndarray:
        return self.chances.held[:, 3]

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def _pieces(self, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, length, ids) of the vocabulary pieces, by length; left: characters to the end of the word."""
        h, live = np.zeros(len(codes), np.uint64), np.arange(len(codes))
        for n in range(1, self.longest + 1):
            some = np.flatnonzero(left[live] >= n)
            live = live[some]
            h = h[some] * self.BASE + codes[live + (n - 1)] + np.uint64(1)
            found = self.at[self._slot(h)]
            some = np.flatnonzero(found >= 0)
            live, h, found = live[some], h[some], found[some]
            right = self.hashes[found] == h
            for _ in range(self.crowd - 1):  # of several beginnings in a slot the next
                wrong = np.flatnonzero(~right)
                if not len(wrong):
                    break
                found[wrong] = np.minimum(found[wrong] + 1, len(self.hashes) - 1)
                right[wrong] = self.hashes[found[wrong]] == h[wrong]
            live, h, ids = live[right], h[right], self.ids[found[right]]
            if not len(live):
                return
            whole = ids >= 0
            yield live[whole], n, ids[whole]

    def _bytes(self, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, byte pieces of each) of characters that no piece writes, by their number of bytes."""
        text = [chr(c).encode() for c in codes[at].tolist()]
        sizes = np.array([len(x) for x in text], np.int64)
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            yield at[rows], self.of_byte[np.frombuffer(b"".join(text[i] for i in rows.tolist()), np.uint8).reshape(-1, n)]

    def add(self, words: list[str]) -> np.ndarray:
        """The root node of each word (written with its blanks)."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n, ends = len(codes), np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)
        start, step, piece, weight, to = ([] for _ in range(5))
        chain_to, chain_piece, nodes = [], [], n
        written = np.zeros(n, bool)
        for at, size, ids in self._pieces(codes, left):
            start.append(at)
            step.append(np.full(len(at), size))
            piece.append(ids)
            weight.append(self.weight[ids])
            to.append(np.where(left[at] == size, -1, at + size))
            if size == 1:
                written[at] = True
        for at, ids in self._bytes(codes, np.flatnonzero(~written)):
            start.append(at)
            step.append(np.ones(len(at), np.int64))
            piece.append(ids[:, 0])
            weight.append(self.weight[ids].sum(axis=1))
            after = np.where(left[at] == 1, -1, at + 1)
            # One node of its own before each further byte.
            chain = nodes + np.arange(len(at) * (ids.shape[1] - 1)).reshape(len(at), -1)
            to.append(chain[:, 0] if chain.shape[1] else after)
            chain_to.append(np.hstack([chain[:, 1:], after[:, None]]).ravel() if chain.shape[1] else after[:0])
            chain_piece.append(ids[:, 1:].ravel())
            nodes += chain.size
        start, step, piece, weight, to = (np.concatenate(x[::-1]) for x in (start, step, piece, weight, to))
        order = np.argsort(start, kind="stable")
        start, step, piece, weight, to = (x[order] for x in (start, step, piece, weight, to))
        group = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
        each = np.diff(np.append(group, len(start)))
        # Backward sums, from the last character of all words to the first: nodes by their distance to the end.
        most = int(left.max())
        far = left.astype(np.uint16) if most < 1 << 16 else left
        nodes_by = np.argsort(far, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=most + 1)[1:])])
        behind, ahead = np.zeros(n + 1), np.where(left[start] == step, n, np.minimum(start + step, n))
        value = np.empty(len(start))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            here = nodes_by[lo:hi]
            size = each[here]
            arcs = spread(group[here], size)
            v = weight[arcs] + behind[ahead[arcs]]
            at = np.cumsum(size) - size
            top = np.maximum.reduceat(v, at)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size)), at))
            behind[here] = total
            value[arcs] = v - np.repeat(total, size)
        logp, p = value, np.exp(value)
        running = np.cumsum(p)
        cum = running - np.repeat(running[group] - p[group], each)
        cum[group + each - 1] = np.inf
        # Beside a node's likeliest arc the others are summed up, so that little mass isn't lost in rounding.
        likely = np.maximum.reduceat(logp, group)
        best = np.flatnonzero(logp == np.repeat(likely, each))
        best = best[np.concatenate([[True], start[best[1:]] != start[best[:-1]]])]
        other, lesser = 1.0 - p, p.copy()
        lesser[best] = 0.0
        other[best] = np.add.reduceat(lesser, group)
        more = nodes - n
        base, arcs = self.first.n, self.chances.n
        self.first.add(arcs + np.concatenate([group, len(p) + np.arange(more)]))
        self.last.add(arcs + np.concatenate([group + each, len(p) + 1 + np.arange(more)]))
        ahead = np.concatenate([to, *chain_to])
        self.to.add(np.where(ahead < 0, -1, ahead + base))
        self.piece.add(np.concatenate([piece, *chain_piece]))
        self.chances.add(cum, p, logp, other)
        if more:
            self.chances.add(np.full(more, np.inf), np.ones(more), np.zeros(more), np.zeros(more))
        return ends - sizes + base

    def walk(self, roots: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A path drawn for each word: all arcs, how many each has, its log-probability, the mass of the word's other paths."""
        first, chances, to = self.first.held, self.chances.held, self.to.held
        n = len(roots)
        sizes, out_total, out_beside = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        live, node, total, prefix, beside, steps = np.arange(n), roots, np.zeros(n), np.ones(n), np.zeros(n), []
        while len(live):
            u, arc = unit(keys_of(keys, len(steps))), first[node].astype(np.int64)
            here = chances.take(arc, axis=0)
            over = np.flatnonzero(u > here[:, 0])
            while len(over):
                arc[over] += 1
                here[over] = next_ = chances.take(arc[over], axis=0)
                over = over[u[over] > next_[:, 0]]
            steps.append((live, arc))
            beside += prefix * here[:, 3]
            prefix *= here[:, 1]
            total += here[:, 2]
            node = to[arc]
            done, on = np.flatnonzero(node < 0), np.flatnonzero(node >= 0)
            ended = live[done]
            sizes[ended], out_total[ended], out_beside[ended] = len(steps), total[done], beside[done]
            live, node, keys, total, prefix, beside = live[on], node[on], keys[on], total[on], prefix[on], beside[on]
        begin, arcs = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.int64)
        for i, (live, arc) in enumerate(steps):
            arcs[begin[live] + i] = arc
        return arcs, sizes, out_total, out_beside

    def _trie(self, root: int, taken: list[tuple[int, ...]]) -> tuple[list[int], list[dict[int, int]], list[float]]:
        """Nodes that the taken paths pass, their children by arc, and the mass that the paths leave behind each."""
        node, kids = [root], [{}]
        for path in taken:
            at = 0
            for arc in path:
                if arc not in kids[at]:
                    kids[at][arc] = len(node)
                    node.append(int(self.to.held[arc]))
                    kids.append({})
                at = kids[at][arc]
        left = [0.0] * len(node)
        for i in range(len(node) - 1, -1, -1):
            if node[i] >= 0:
                left[i] = sum(w for _, w in self._weights(node[i], kids[i], left))
        return node, kids, left

    def _weights(self, node: int, kids: dict[int, int], left: list[float]) -> list[tuple[int, float]]:
        lo, hi = int(self.first.held[node]), int(self.last.held[node])
        return [(a, x * left[kids[a]] if a in kids else x) for a, x in zip(range(lo, hi), self.p[lo:hi].tolist(), strict=True)]

    def other_path(self, root: int, taken: list[tuple[int, ...]], key: int) -> tuple[tuple[int, ...], float, float]:
        """A path of the word drawn from those not taken, its log-probability, and the mass that is left beside it."""
        node, kids, left = self._trie(root, taken)
        at, here, out = 0, root, []
        while here >= 0:
            inside = at >= 0
            choices = self._weights(here, kids[at] if inside else {}, left)
            u = _unit(_key(key, len(out))) * sum(w for _, w in choices)
            arc = next(a for a, w in reversed(choices) if w > 0)
            for a, w in choices:
                if w > 0 and u < w:
                    arc = a
                    break
                u -= w
            out.append(arc)
            at = kids[at].get(arc, -1) if inside else -1
            here = int(self.to.held[arc])
        logp = float(self.logp[out].sum())
        return tuple(out), logp, self.mass_beside(root, [*taken, tuple(out)])

    def mass_beside(self, root: int, taken: list[tuple[int, ...]]) -> float:
        return self._trie(root, taken)[2][0]

    def turn_offs(self, roots: np.ndarray, arcs: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word and a path of it, where a path drawn from the others turns off.

        How many arcs it shares, the arc it then takes, the log-probability up to there, and the mass of all others.
        """
        begin = np.cumsum(sizes) - sizes
        logp, p, to = self.logp, self.p, self.to.held
        running = np.concatenate([[0.0], np.cumsum(logp[arcs])])
        before = running[:-1] - np.repeat(running[begin], sizes)
        weight = np.exp(before) * self.other[arcs]
        mass = np.add.reduceat(weight, begin)
        # The place is drawn within each word's own sums, free of what lies before.
        at, u = begin.copy(), unit(keys_of(keys, 0)) * mass
        live = np.arange(len(roots))
        while len(live):
            u[live] -= weight[at[live]]
            live = live[(u[live] >= 0) & (at[live] + 1 < begin[live] + sizes[live])]
            at[live] += 1
        while len(live := np.flatnonzero(weight[at] <= 0)):
            at[live] -= 1  # rounding ran past the last place with any mass
        node = np.where(at == begin, roots, to[arcs[np.maximum(at - 1, 0)]])
        lo, hi = self.first.held[node].astype(np.int64), self.last.held[node].astype(np.int64)
        arc, u = lo.copy(), unit(keys_of(keys, 1)) * self.other[arcs[at]]
        live, last = np.arange(len(roots)), np.full(len(roots), -1)
        while len(live):
            free = arc[live] != arcs[at[live]]
            u[live] -= np.where(free, p[arc[live]], 0.0)
            last[live[free]] = arc[live[free]]
            live = live[((u[live] >= 0) | ~free) & (arc[live] + 1 < hi[live])]
            arc[live] += 1
        return at - begin, last, before[at] + logp[last], mass


def _log(mass: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(mass)


def _truncated(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Maxima of Gumbels at phi, given that they lie under top; -inf where there are no paths."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where(np.isfinite(phi), phi - np.log(np.exp(phi - top) - np.log(u)), -np.inf)


class Path:
    """A segmentation of a text: arcs, their number and log-probability by word, and the search nodes that turn off it.

    These begin at the word `begin`; the one there also leaves out the paths of that word in `off`.
    """

    __slots__ = ("arcs", "begin", "keys", "logp", "off", "sizes")

    def __init__(self, arcs, sizes, logp, keys, begin, off) -> None:
        self.arcs, self.sizes, self.logp, self.keys, self.begin, self.off = arcs, sizes, logp, keys, begin, off


def sample_segmentations(lattice: Lattice, roots: np.ndarray, lengths: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each row up to k (piece ids, log-probability, inclusion score), distinct and in order of their keys.

    roots: the words' root nodes of all rows, one row after the other; lengths: words by row.
    """
    row, begin = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    word = np.arange(len(roots)) - begin[row]
    found: list[list[Path]] = [[] for _ in lengths]
    kappa = np.full(len(lengths), -np.inf)
    # What is drawn in a round: (row, first word, path to turn off and its arcs before, that word's path, top, paths taken there).
    todo: list[tuple] = [(r, 0, None, (), -np.log(-np.log(u)), frozenset()) for r, u in enumerate(unit(keys_of(seeds, 2)).tolist())]
    for round_ in range(k + 1):
        if round_:
            todo = []
            for r, paths in enumerate(found):
                if len(paths) < round_:
                    continue
                best, at, of = max(((float(p.keys[i]), i, p) for p in paths if len(p.keys) for i in (int(p.keys.argmax()),)), key=lambda x: x[0], default=(-np.inf, 0, None))
                if best == -np.inf:
                    continue
                if round_ == k:
                    kappa[r] = best
                    continue
                of.keys[at] = -np.inf
                at += of.begin
                edge = int(of.sizes[:at].sum())
                mine = tuple(of.arcs[edge : edge + of.sizes[at]].tolist())
                todo.append((r, at, (of, edge), mine, best, frozenset({mine} | (of.off if at == of.begin else frozenset()))))
        if not todo:
            continue
        rows, turned = np.array([t[0] for t in todo]), np.array([t[2] is not None for t in todo])
        at = np.array([t[1] for t in todo])
        # The word where a search node turns off: words of one path taken together, others one by one.
        heads: list[tuple[list[int], float, float, int]] = [([], 0.0, 0.0, -1)] * len(todo)
        alone = np.array([i for i, t in enumerate(todo) if t[2] is not None and len(t[5]) == 1], np.int64)
        seeds_of = keys_of(seeds, 3 * round_)
        if len(alone):
            taken = np.array([a for i in alone for a in todo[i][3]], np.int64)
            sizes = np.array([len(todo[i][3]) for i in alone], np.int64)
            shared, arc, logp, mass = lattice.turn_offs(roots[begin[rows[alone]] + at[alone]], taken, sizes, seeds_of[rows[alone]])
            for i, n, a, lp, m, to in zip(alone.tolist(), shared.tolist(), arc.tolist(), logp.tolist(), mass.tolist(), lattice.to.held[arc].tolist(), strict=True):
                heads[i] = [*todo[i][3][:n], a], lp, m, to
        for i, t in enumerate(todo):
            if len(t[5]) > 1:
                path, lp, m = lattice.other_path(int(roots[begin[t[0]] + t[1]]), sorted(t[5]), int(seeds_of[t[0]]))
                heads[i] = list(path), lp, m, -2
        # Everything drawn freely: the rest of that word, if any, and all words behind it.
        rest = np.array([h[3] for h in heads])
        open_ = rest >= 0
        many = lengths[rows] - at - turned
        place = spread(begin[rows] + at + turned, many)
        first = np.cumsum(many + open_) - (many + open_)
        where = np.empty(int((many + open_).sum()), np.int64)
        free = np.ones(len(where), bool)
        free[first[open_]] = False
        where[free], where[~free] = roots[place], rest[open_]
        keys = np.empty(len(where), np.uint64)
        keys[free], keys[~free] = keys_of(keys_of(seeds, 3 * round_ + 1)[row[place]], word[place]), keys_of(seeds_of[rows[open_]], 1 << 40)
        arcs, sizes, logp, beside = lattice.walk(where, keys)
        arc_at, word_at = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([first, [len(where)]])
        # Log-probability of what stands before the first whole word drawn in each row, then before each word.
        own = np.array([h[1] for h in heads])
        own[open_] += logp[~free]
        before = np.array([0.0 if of is None else float(of[0].logp[: t].sum()) for _, t, of, _, _, _ in todo])
        sizes_free, logp_free = sizes[free], logp[free]
        edge_free = np.concatenate([[0], np.cumsum(many)])
        running = np.concatenate([[0.0], np.cumsum(logp_free)])
        phi = running[:-1] + np.repeat(before + own - running[edge_free[:-1]], many) + _log(beside[free])
        cuts = _truncated(phi, np.repeat([t[4] for t in todo], many), unit(keys_of(keys[free], 1 << 40)))
        for i, (r, at_, base, _, top, taken) in enumerate(todo):
            lo, hi = edge_free[i], edge_free[i + 1]
            drawn = arcs[arc_at[word_at[i]] : arc_at[word_at[i + 1]]]
            if base is None:
                found[r].append(Path(drawn, sizes_free[lo:hi], logp_free[lo:hi], cuts[lo:hi], at_, taken))
                continue
            of, edge = base
            head, _, mass, _ = heads[i]
            mine = len(head) + (int(sizes[word_at[i]]) if open_[i] else 0)
            if len(taken) == 1:
                # What is left beside both paths of the word: the difference unless rounding would show in it.
                less = mass - math.exp(own[i])
                if less < 1e-4 * mass:
                    less = lattice.mass_beside(int(roots[begin[r] + at_]), [*taken, (*head, *drawn[: mine - len(head)].tolist())])
                mass = less
            # The search node of that word, without the paths taken there.
            cut = -math.inf
            if mass > 0:
                cut = before[i] + math.log(mass)
                cut -= math.log(math.exp(min(cut - top, 700.0)) - math.log(_unit(_key(int(seeds[r]), 3 * round_ + 2))))
            found[r].append(
                Path(
                    np.concatenate([of.arcs[:edge], head, drawn]),
                    np.concatenate([of.sizes[:at_], [mine], sizes_free[lo:hi]]),
                    np.concatenate([of.logp[:at_], [own[i]], logp_free[lo:hi]]),
                    np.concatenate([[cut], cuts[lo:hi]]),
                    at_,
                    taken,
                )
            )
    out = []
    with np.errstate(over="ignore"):
        for paths, most in zip(found, kappa.tolist(), strict=True):
            out.append([(lattice.piece.held[p.arcs], lp := float(p.logp.sum()), float(-np.expm1(-np.exp(min(lp - most, 700.0)))) if np.isfinite(most) else 1.0) for p in paths])
    return out


class Numbers(dict):
    """Words numbered as they are met; the new ones are listed."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes and decodes texts and draws segmentations; each distinct word is worked out once until the cache is full."""

    def __init__(self, model: bytes, kept: int = KEPT) -> None:
        self.kept, self.processor = kept, _processor(model)
        self.lattice = Lattice(self.processor, room=ARCS * min(kept, KEPT))
        pieces = piece_bytes(self.processor)
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(pieces), np.uint8)
        self.known = Numbers()
        self.roots, self.at, self.many, self.ids = Grown(np.int64), Grown(np.int64), Grown(np.int64), Grown(np.int32)

    def clear(self) -> None:
        self.known = Numbers()
        for held in (self.roots, self.at, self.many, self.ids, self.lattice):
            held.clear()

    def _learn(self, words: list[str]) -> None:
        # An empty last word is the blank alone, which the processor would drop.
        ids = [found if w and w[-1] != " " else self._one(w) for w, found in zip(words, self.processor.encode(words, num_threads=1), strict=True)]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        self.at.add(self.ids.n + np.cumsum(many) - many)
        self.many.add(many)
        self.ids.add(np.fromiter(chain.from_iterable(ids), np.int32, int(many.sum())))
        self.roots.add(self.lattice.add([_BLANK + (w.replace(" ", _BLANK) if " " in w else w) for w in words]))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers of all texts, and how many each text has."""
        split = [words_of(t) if t else [] for t in texts]
        if self.lattice.chances.n > ARCS * self.kept or len(self.known) > self.kept:
            self.clear()
        found = np.array(list(map(self.known.__getitem__, chain.from_iterable(split))), np.int64)
        for lo in range(0, len(self.known.new), LEARNT):
            self._learn(self.known.new[lo : lo + LEARNT])
        self.known.new = []
        return found, np.fromiter(map(len, split), np.int64, len(split))

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids.held[spread(self.at.held[numbers], self.many.held[numbers])]

    def encode(self, text: str) -> np.ndarray:
        return self.ids_of(self.numbers([text])[0])

    def _one(self, blanks: str) -> list[int]:
        """Ids of a run of blanks at the end: the longest pieces first."""
        out, left = [], len(blanks) + 1
        while left:
            n = min(left, 16)
            while self.processor.piece_to_id(_BLANK * n) == self.processor.unk_id():
                n -= 1
            out.append(self.processor.piece_to_id(_BLANK * n))
            left -= n
        return out

    def decoded(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts given their ids, one text after the other, and where each text begins and the last ends."""
        sizes = self.sizes[ids]
        out = self.bytes[spread(self.starts[ids], sizes)]
        edge = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
        # The blank that encoding puts in front of a text goes.
        front = edge[:-1][(edge[1:] > edge[:-1])]
        front = front[out[front] == 32]
        gone = np.zeros(len(out) + 1, np.int64)
        gone[front + 1] = 1
        return np.delete(out, front), edge - np.cumsum(gone)[edge]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decoded(ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")

    def samples(self, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        numbers, lengths = self.numbers(texts)
        return sample_segmentations(self.lattice, self.roots.held[numbers], lengths, seeds, k)


def row_seeds(doc_ids: list[int | None]) -> np.ndarray:
    return keys_of(_scrambled(np.array([(d or 0) & 0xFFFFFFFFFFFFFFFF for d in doc_ids], np.uint64)), SEED)


def _pieces_of_work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows that end where they hold CHARS characters."""
    at = size = 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        size += n or 0
        if i + 1 - at >= ROWS or size >= CHARS:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(docs: DataFrame, path: str | None = None, samples: int = SAMPLES, kept: int = KEPT) -> DataFrame:
    """doc_id, ids, decoded and samples (ids, log_p, inclusion) for each row of docs (doc_id, text); kept: words that a task remembers."""
    with open(path or model_path(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, text string, ids array<int>, decoded string, samples array<struct<ids:array<int>,log_p:double,inclusion:double>>"

    def lists(parts: list[np.ndarray]) -> pa.Array:
        edge = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(edge, np.concatenate([np.empty(0, np.int32), *parts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, kept)
        for whole in batches:
            for b in _pieces_of_work(whole):
                texts = [t or "" for t in b.column("text").to_pylist()]
                numbers, lengths = encoder.numbers(texts)
                ids, many = encoder.ids_of(numbers), np.zeros(len(texts), np.int64)
                np.add.at(many, np.repeat(np.arange(len(texts)), lengths), encoder.many.held[numbers])
                out, edge = encoder.decoded(ids, many)
                decoded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(out))
                drawn = sample_segmentations(encoder.lattice, encoder.roots.held[numbers], lengths, row_seeds(b.column("doc_id").to_pylist()), samples)
                every = [x for d in drawn for x in d]
                fields = pa.StructArray.from_arrays([lists([x[0] for x in every]), pa.array([x[1] for x in every], pa.float64()), pa.array([x[2] for x in every], pa.float64())], names=["ids", "log_p", "inclusion"])
                held = pa.ListArray.from_arrays(np.cumsum([0, *map(len, drawn)]).astype(np.int32), fields)
                encoded = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), encoded, decoded, held], ["doc_id", "text", "ids", "decoded", "samples"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def report(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """One row for each document: pieces, whether decoding restores the text, and the sampled segmentations in short."""
    plain = F.coalesce(F.translate("text", _BLANK, " "), F.lit(""))
    return encode(docs, kept=kept).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == plain).alias("restored"),
        F.transform("samples", lambda s: F.struct(F.size(s["ids"]).alias("n_pieces"), F.xxhash64(s["ids"]).alias("ids_hash"), s["log_p"].alias("log_p"), s["inclusion"].alias("inclusion"))).alias("samples"),
    )
