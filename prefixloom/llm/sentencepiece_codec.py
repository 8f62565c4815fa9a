"""SentencePiece encoding and decoding by the best path through the piece lattice.

The pieces come from a model file; bytes stand for characters that no piece
covers, so decoding gives back every text exactly.  A path's weight is the sum
of its pieces' scores.  A model made for merging allows a step from one piece to
the next only where merging the two pieces' characters gives just these two: a
text's own merges are then the one path that is allowed throughout (no merge
crosses a border of the result, and the first that did would do so in the two
pieces alone as well), so the ids are the library's.  Other models allow every
step.  No piece has a space mark inside, so the lattice falls apart at each run
of spaces, and ordinary words are solved once and remembered.

A giant document is split into chunks.  A boundary's state is the piece that
ends at it or crosses it: how far it reaches back and beyond.  A chunk's
transfer matrix holds the weight of the best way from each state before it to
each state after it.  The matrices are combined by the associative max-plus
product, within groups of chunks and then over the groups' products, which
fixes the state at every boundary, and each chunk is backtraced on its own.
"""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, table, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 of a text; a lone surrogate cannot occur in one.
LITERAL = "\udfff"
CHUNK = 16_384
#: Letters whose runs are segments of their own if the model joins them to nothing else.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Fixed-point factor of the scores.
SCALE = 1 << 12
#: Chunks whose matrices are multiplied by one task.
GROUP = 256

#: (characters before the boundary, characters beyond it) of the piece there; nothing matters where a segment starts.
State = tuple[int, int]
Matrix = dict[tuple[State, State], int]
FRESH: State = (0, 0)
#: (text before, own text, text beyond, how far the chunk's start lies in its segment)
Chunk = tuple[str, str, str, int]
NEVER = -(1 << 60)


@dataclass
class Vocabulary:
    """Pieces of a model: ``tree`` leads from letter to letter, and holds a piece's weight under 0; ``first_byte`` is the id of the byte piece 0."""

    ids: dict[str, int]
    weights: dict[str, int]
    merging: bool
    tree: dict
    texts: list[bytes]
    first_byte: int
    unknown: int
    longest: int
    pattern: re.Pattern
    edges: tuple[np.ndarray, ...]
    in_turn: bool = False
    known: dict[tuple[str, str], bool] = field(default_factory=dict)
    lives: dict[str, tuple[list, list, bool]] = field(default_factory=dict)
    room: int = 1_000_000

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "lives": {}}

    def merged(self, text: str) -> list[str]:
        """What merging makes of characters: always the pair of the best score, the first of equals."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], list, list, bool]:
        """``merged``, the symbols that stood at the first and at the last place with their times (of birth and end), and whether times only rose.

        A merge's time is its score's rank: the lower the score, the later.
        """
        parts, get = list(text), self.weights.get
        born = [NEVER] * len(parts)
        first, last, now, rising = [], [], NEVER, True
        while True:
            best = at = None
            for k in range(len(parts) - 1):
                w = get(parts[k] + parts[k + 1])
                if w is not None and (best is None or w > best):
                    best, at = w, k
            if at is None:
                first.append((parts[0], born[0], -NEVER))
                last.append((parts[-1], born[-1], -NEVER))
                return parts, first, last, rising
            rising, now = rising and -best >= now, -best
            if at == 0:
                first.append((parts[0], born[0], now))
            if at == len(parts) - 2:
                last.append((parts[-1], born[-1], now))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            born[at : at + 2] = [now]

    def life(self, piece: str) -> tuple[list, list, bool]:
        """Symbols at a piece's first and last place with their times, and whether merging its characters gives the piece, in rising times."""
        found = self.lives.get(piece)
        if found is None:
            parts, first, last, rising = self._merge(piece)
            found = self.lives[piece] = first, last, rising and len(parts) == 1
        return found

    def follows(self, before: str, piece: str) -> bool:
        """Whether a path may go from a piece (nothing: from a segment's start) to another."""
        if not self.merging:
            return True
        if not before and self.in_turn:
            return True
        key = before, piece
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.room:
                self.known.clear()
            if self.in_turn:
                found = self._apart(before, piece)
            else:
                found = self.merged(before + piece) == ([before, piece] if before else [piece])
            self.known[key] = found
        return found

    def _apart(self, before: str, piece: str) -> bool:
        """Whether no merge crosses the border of two pieces, for models whose pieces all come about in rising times.

        Two symbols at the border merge as soon as both stand there and their
        time has come, if neither has been merged with its other neighbour by
        then; of equal times the one to the left goes first.
        """
        get = self.weights.get
        for x, x_born, x_ends in self.life(before)[1]:
            for y, y_born, y_ends in self.life(piece)[0]:
                w = get(x + y)
                if w is not None and (when := max(-w, x_born, y_born)) < x_ends and when <= y_ends:
                    return False
        return True

    def segments(self, marked: str) -> list[str]:
        """The parts of a marked text that no piece joins: runs of letters, and of other characters, with the space marks before them."""
        return self.pattern.findall(marked)

    def starts(self, marked: str) -> list[int]:
        """Places after the first where a segment starts."""
        return [m.start() for m in self.pattern.finditer(marked)][1:]

    @classmethod
    def load(cls, path: str = MODEL, merging: bool | None = None) -> Vocabulary:
        """Reads a model on the driver; what is sent to executors is bounded by the model's size.

        A model whose scores are whole numbers, as ranks are, is one for merging.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, weights, out, tree = {}, {}, [], {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                out.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                out.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece has a space mark inside")
                ids[piece], weights[piece] = k, round(model.get_score(k) * SCALE)
                out.append(piece.replace(SPACE, " ").encode())
                node = tree
                for c in piece:
                    node = node.setdefault(c, {})
                node[0] = weights[piece]
        first = next(k for k in range(len(out)) if model.is_byte(k))
        joins = re.compile(f"[{LATIN}][^{LATIN}]|[^{SPACE}{LATIN}][{LATIN}]")
        apart = not any(joins.search(p) for p in ids)
        if merging is None:
            merging = all(w % SCALE == 0 for w in weights.values())
        if merging and any(c not in ids for c in set().union(*ids)):
            raise ValueError("a letter of a piece is no piece")
        edges = _edges_of(tree, ids)
        pattern = f"{SPACE}*[{LATIN}]+|{SPACE}*[^{SPACE}{LATIN}]+|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        own = cls(ids, weights, merging, tree, out, first, min(weights.values()) - 10 * SCALE, max(map(len, ids)), re.compile(pattern), edges)
        own.in_turn = merging and all(own.life(p)[2] for p in ids)
        return own

    def of(self, piece: str) -> list[int]:
        """A piece's id, or the ids of its bytes."""
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        return [self.first_byte + b for b in piece.replace(LITERAL, SPACE).encode()]

    def decode(self, ids) -> str:
        """The text of ids; the mark before the first word goes."""
        return b"".join([self.texts[i] for i in ids])[1:].decode("utf-8", "replace")


def _edges_of(tree: dict, ids: dict[str, int]) -> tuple[np.ndarray, ...]:
    """The letter tree as arrays: (node and letter, node below) of each edge; (id or -1, weight) of each node."""
    piece, keys, child, nodes, score = [-1], [], [], [("", tree)], [0]
    number = 0
    while number < len(nodes):
        prefix, node = nodes[number]
        for c, below in node.items():
            if c:
                keys.append(number << 21 | ord(c))
                child.append(len(nodes))
                nodes.append((prefix + c, below))
                piece.append(ids.get(prefix + c, -1))
                score.append(below.get(0, 0))
        number += 1
    return np.array(keys, np.uint64), np.array(child, np.int32), np.array(piece, np.int32), np.array(score, np.int64)


def solve(v: Vocabulary, word: str, start: int = 0, before: str = "", stop: int | None = None) -> tuple[list[int], list[int]]:
    """Best weight from ``start`` to each position of a word, and the start of the last piece of that way.

    ``before`` is the piece that ends at ``start``, if that is not a segment's
    start; no piece starts at or after ``stop``.
    """
    n = len(word)
    best, back = [NEVER] * (n + 1), [-1] * (n + 1)
    best[start] = 0
    tree, unknown, follows = v.tree, v.unknown, v.follows
    for at in range(start, n if stop is None else min(n, stop)):
        here = best[at]
        if here == NEVER:
            continue
        last = before if at == start else word[back[at] : at]
        node, end = tree, at
        reached = []
        while end < n:
            node = node.get(word[end])
            if node is None:
                break
            end += 1
            if 0 in node:
                reached.append((end, node[0]))
        if not reached or reached[0][0] != at + 1:
            reached.append((at + 1, unknown))
        for end, w in reached:
            if here + w > best[end] and follows(last, word[at:end]):
                best[end], back[end] = here + w, at
    return best, back


def walk(v: Vocabulary, word: str, back: list[int], start: int, end: int) -> list[int]:
    cuts = [end]
    while cuts[-1] > start:
        cuts.append(back[cuts[-1]])
    cuts.reverse()
    return [i for a, b in itertools.pairwise(cuts) for i in v.of(word[a:b])]


def marked_text(text: str) -> str:
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""


class Encoder:
    """Encodes whole texts word by word, remembering at most ``room`` words; new words are solved many at a time."""

    def __init__(self, v: Vocabulary, room: int = 500_000):
        self.v, self.room = v, room
        self.known: dict[str, bytes] = {}
        self.lookup = Lookup(v)

    def learn(self, words: set[str]) -> None:
        """Solves those words that are not known yet."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = words
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for n, group in sorted(by_length.items()):
            done = self.lookup.solve(group, n) if n <= Lookup.LONGEST else [None] * len(group)
            for w, found in zip(group, done, strict=True):
                if found is None:
                    found = np.array(walk(self.v, w, solve(self.v, w)[1], 0, n), "<i4").tobytes()
                self.known[w] = found

    def packed(self, bodies: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        split = [self.v.segments(marked_text(x)) for x in bodies]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text or ""])[0], "<i4").tolist()


#: In place of an id: a letter without a piece that needs several bytes.
MANY_BYTES = -2


class Lookup:
    """Solves words of one length together: from each place the letter tree, kept as hash tables of its edges, is followed for all words at once."""

    #: Longer words are solved one by one, with the same result.
    LONGEST = 64
    BITS = 19
    #: Slots of the memory of allowed steps.
    STEP_BITS = 20
    MULTIPLIER = 0xD6E8FEB86659FD93

    def __init__(self, v: Vocabulary):
        self.v = v
        keys, child, piece, self.score = v.edges
        self.piece = piece.astype(np.int64)
        keys, child = keys + np.uint64(1), child.astype(np.int64)
        self.tables = []
        while len(keys):  # an edge whose slot is taken goes to the next table
            multiplier = np.uint64(self.MULTIPLIER * (2 * len(self.tables) + 1) & 0xFFFFFFFFFFFFFFFF)
            slot = (keys * multiplier) >> np.uint64(64 - self.BITS)
            _, first = np.unique(slot, return_index=True)
            key, what = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1)
            key[slot[first]], what[slot[first]] = keys[first], child[first]
            self.tables.append((multiplier, key, what))
            keys, child = np.delete(keys, first), np.delete(child, first)
        self.names = [""] * len(v.texts)
        for name, k in v.ids.items():
            self.names[k] = name
        self.whole = np.array([bool(x) for x in self.names])  # pieces, not bytes
        self.step_key, self.step_good = np.zeros(1 << self.STEP_BITS, np.int64), np.zeros(1 << self.STEP_BITS, bool)

    def follows(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Vocabulary.follows for many pairs of ids; -1 stands for a segment's start, and, before, for a letter without a piece, which joins nothing."""
        if not self.v.merging:
            return np.ones(len(after), bool)
        keys = (before + 1) * (1 << 31) + after + 1
        slots = ((keys.astype(np.uint64) * np.uint64(self.MULTIPLIER)) >> np.uint64(64 - self.STEP_BITS)).astype(np.int64)
        known, good = self.step_key[slots] == keys, self.step_good[slots]
        missing = np.flatnonzero(~known)
        if len(missing):
            new, where = np.unique(keys[missing], return_inverse=True)
            pairs = zip((new >> 31).tolist(), (new & 0x7FFFFFFF).tolist())
            found = np.array([self.v.follows(self.names[a - 1] if a else "", self.names[b - 1]) for a, b in pairs], bool)
            good[missing] = found[where]
            self.step_key[slots[missing]], self.step_good[slots[missing]] = keys[missing], good[missing]
        return good

    def follow(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node below each node by a letter, -1 where there is none."""
        keys = (node.astype(np.uint64) << np.uint64(21) | code) + np.uint64(1)
        out, rows = np.full(len(keys), -1), None
        for multiplier, key, what in self.tables:
            slot = (keys * multiplier) >> np.uint64(64 - self.BITS)
            there = key[slot]
            hit = there == keys
            if rows is None:
                out = np.where(hit, what[slot], -1)
            else:
                out[rows[hit]] = what[slot[hit]]
            go = np.flatnonzero(~hit & (there > 0))  # an empty slot ends the search
            if not len(go):
                break
            rows = go if rows is None else rows[go]
            keys = keys[go]
        return out

    def solve(self, words: list[str], n: int) -> list[bytes | None]:
        """The ids of each word; None where a character needs several bytes."""
        m = len(words)
        codes = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n).T).astype(np.uint64)
        best = np.full((n + 1, m), NEVER, np.int64)
        last = np.full((n + 1, m), -1, np.int64)
        size = np.ones((n + 1, m), np.int64)
        best[0] = 0
        everyone = np.arange(m)

        def reach(end, rows, total, ids, length):
            better = total > best[end, rows]
            rows = rows[better]
            best[end, rows], last[end, rows], size[end, rows] = total[better], ids[better], length

        for at in range(n):
            rows, node = everyone, np.zeros(m, np.int64)
            for end in range(at + 1, min(n, at + self.v.longest) + 1):
                node = self.follow(node, codes[end - 1][rows])
                alive = node >= 0
                if end == at + 1:  # a letter without a piece: its byte, or several
                    other = np.flatnonzero(~alive | (self.piece[node] < 0))
                    if len(other):
                        letter = codes[at][other].astype(np.int64)
                        reach(end, other, best[at][other] + self.v.unknown, np.where(letter < 128, self.v.first_byte + letter, MANY_BYTES), 1)
                if not alive.all():
                    rows, node = rows[alive], node[alive]
                    if not len(rows):
                        break
                ids = self.piece[node]
                full = np.flatnonzero(ids >= 0)
                if len(full):
                    before = last[at][rows[full]]
                    full = full[self.follows(np.where((before >= 0) & self.whole[before], before, -1), ids[full])]
                    some = rows[full]
                    reach(end, some, best[at][some] + self.score[node[full]], ids[full], end - at)
        pieces = np.zeros((m, n), np.int64)
        count, at, open_ = np.zeros(m, np.int64), np.full(m, n), np.arange(m)
        while len(open_):
            pieces[open_, n - 1 - count[open_]] = last[at[open_], open_]
            count[open_] += 1
            at[open_] -= size[at[open_], open_]
            open_ = open_[at[open_] > 0]
        packed = pieces.astype("<i4")
        good = ((pieces >= 0) | (np.arange(n)[None, :] < (n - count)[:, None])).all(axis=1).tolist()
        count = count.tolist()
        return [packed[k, n - count[k] :].tobytes() if good[k] else None for k in range(m)]


def _cuts(v: Vocabulary, own: str, halo: str, place: int) -> list[int]:
    """Where segments start in a chunk or beyond; the text's end counts as such."""
    return [*([] if place else [0]), *v.starts(own + halo), *([] if halo else [len(own)])]


def _entering(v: Vocabulary, chunk: Chunk, limit: int) -> dict[State, str]:
    """The states that a chunk may be entered in, each with its piece; no piece crosses ``limit``."""
    ahead, own, halo, place = chunk
    if not place:
        return {FRESH: ""}
    text, at = ahead + (own + halo)[:limit], len(ahead)
    out: dict[State, str] = {}
    for back in range(1, min(place, v.longest, at) + 1):
        node, end = v.tree, at - back
        while end < len(text) and (node := node.get(text[end])) is not None:
            end += 1
            if 0 in node and end >= at:
                out[back, end - at] = text[at - back : end]
    if text[at - 1] not in v.ids:
        out[1, 0] = text[at - 1]
    return {state: piece for state, piece in out.items() if v.follows("", piece)}


def transfer(v: Vocabulary, chunk: Chunk) -> Matrix:
    """A chunk's matrix: the best weight from each state before to each state after it; a piece counts where it starts.

    All ways go through the start of the chunk's first segment and through that
    of its last, so what stands between adds the same to every entry and is left
    out; what stands before the first is solved once for each state.
    """
    _, own, halo, place = chunk
    n = len(own)
    cuts = _cuts(v, own, halo, place)
    inside = [k for k in cuts if k < n]
    until = next((k for k in cuts if k >= n), n + len(halo))
    entering = _entering(v, chunk, next((k for k in cuts if k > 0), n + len(halo)))
    leaves = lambda start, end: FRESH if end == n and n in cuts else (n - start, end - n)
    if not inside:
        word = (own + halo)[:until]
        out: Matrix = {}
        for state, piece in entering.items():
            if state[1] >= n:
                out[state, leaves(-state[0], state[1])] = 0
                continue
            best, back = solve(v, word, state[1], piece, n)
            out |= {(state, leaves(back[c], c)): best[c] for c in range(n, until + 1) if best[c] != NEVER}
        return out
    first, last = inside[0], inside[-1]
    heads = {FRESH: 0} if first == 0 else {}
    for state, piece in entering.items() if first else ():
        best, _ = solve(v, own[:first], state[1], piece)
        if best[first] != NEVER:
            heads[state] = best[first]
    best, back = solve(v, (own + halo)[last:until], 0, "", n - last)
    tails = {leaves(last + back[c], last + c): best[c] for c in range(n - last, until - last + 1) if best[c] != NEVER}
    return {(r, c): a + b for r, a in heads.items() for c, b in tails.items()}


def inner_words(v: Vocabulary, chunks: list[Chunk]) -> set[str]:
    """The segments that lie whole in chunks."""
    return {own[a:b] for _, own, _, place in chunks for a, b in itertools.pairwise(([] if place else [0]) + v.starts(own))}


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    rows: dict[State, list[tuple[State, int]]] = {}
    for (k, c), w in b.items():
        rows.setdefault(k, []).append((c, w))
    out: Matrix = {}
    for (r, k), x in a.items():
        for c, w in rows.get(k, ()):
            if (r, c) not in out or x + w > out[r, c]:
                out[r, c] = x + w
    return out


def scan(matrices: list[Matrix]) -> list[Matrix]:
    """Inclusive prefix products, by pairs: products of neighbours are scanned first, then filled in."""
    if len(matrices) <= 1:
        return list(matrices)
    paired = scan([product(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(paired[k // 2] if k % 2 else product(paired[k // 2 - 1], matrices[k]))
    return out


def boundaries(matrices: list[Matrix], enter: State = FRESH, leave: State = FRESH) -> list[State]:
    """The best path's state at the start of each chunk and at the end, given the first and the last.

    The scan gives the best weight from every state to the end; of equal ways
    the one with the least states counts, and each state is chosen after the one
    before, so that ties cannot mix.
    """
    flipped = [{(c, r): w for (r, c), w in m.items()} for m in reversed(matrices)]
    after = scan(flipped)[::-1]
    out = [enter]
    for k in range(len(matrices) - 1):
        at = {c: w + after[k + 1][leave, c] for (r, c), w in matrices[k].items() if r == out[-1] and (leave, c) in after[k + 1]}
        out.append(min(at, key=lambda c: (-at[c], c)))  # noqa: B023
    return [*out, leave]


def split(v: Vocabulary, marked: str, size: int = CHUNK) -> list[Chunk]:
    at = np.array([0, *v.starts(marked)])
    places = [int(a - at[np.searchsorted(at, a, "right") - 1]) for a in range(0, len(marked), size)]
    return [(marked[max(0, a - v.longest) : a], marked[a : a + size], marked[a + size : a + size + v.longest], p) for a, p in zip(range(0, len(marked), size), places)]


def chunk_ids(e: Encoder, chunk: Chunk, enter: State, leave: State) -> list[int]:
    """The ids of the pieces that start in a chunk, given the states before and after it."""
    v, (ahead, own, halo, place) = e.v, chunk
    n, start = len(own), enter[1]
    if start >= n:
        return []
    marked, end = own + halo, n + leave[1]
    before = ahead[len(ahead) - enter[0] :] + own[:start] if enter[0] else ""
    cuts = [k for k in _cuts(v, own, halo, place) if k < n]
    edges = sorted({start, *(k for k in cuts if k > start), end})
    out: list[int] = []
    if start not in cuts:  # the rest of a segment
        word = marked[: edges[1]]
        out += walk(v, word, _forced(v, word, start, before, n, leave), start, len(word))
        edges = edges[1:]
    if len(edges) < 2:
        return out
    words = [own[a:b] for a, b in itertools.pairwise(edges[:-1])]
    e.learn(set(words))
    out += np.frombuffer(b"".join(map(e.known.__getitem__, words)), "<i4").tolist()
    a = edges[-2]
    return out + walk(v, marked[a:end], _forced(v, marked[a:end], 0, "", n - a, leave), 0, end - a)


def _forced(v: Vocabulary, word: str, start: int, before: str, stop: int, leave: State) -> list[int]:
    """As ``solve``'s second result; the last piece is the leaving state's if it crosses the chunk's end, which is at ``stop``."""
    back = solve(v, word, start, before, stop)[1]
    if leave != FRESH and len(word) == stop + leave[1]:
        back[len(word)] = stop - leave[0]
    return back


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether decoding gives the text back) of every document.

    Null and empty texts have no ids; repeated rows and null ids keep their own
    rows.  Documents of more than ``chunk`` characters go through the scan.
    """
    v = Vocabulary.load(model)
    rows = texts(docs)
    small = rows.where(F.length("text") <= chunk).mapInArrow(_encoder(v), "doc_id long, n_tokens int, ids array<int>, round_trip boolean")
    return small.unionByName(_giants(rows.where(F.length("text") > chunk), v, chunk))


def _encoder(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                small = batch.slice(at, 1024)
                bodies = small.column(1).to_pylist()
                packed = encoder.packed(bodies)
                ids = [np.frombuffer(p, "<i4") for p in packed]
                sizes = np.array([len(p) for p in ids], np.int32)
                same = [v.decode(p.tolist()) == x for p, x in zip(ids, bodies, strict=True)]
                flat = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([small.column(0), pa.array(sizes), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return run


def _giants(rows: DataFrame, v: Vocabulary, size: int) -> DataFrame:
    """Giant documents: chunks with matrices, scans over matrices alone, chunks backtraced apart.

    A document is one row of at most 2 GB, so it has at most some 500 groups of
    GROUP chunks; no task holds more matrices than that.
    """

    small = "<u2" if len(v.texts) <= 1 << 16 else "<i4"
    state_names = ["enter", "enter_beyond", "leave", "leave_beyond"]
    state_types = [pa.int32()] * 4

    def chunks(batches):
        for batch in batches:
            for uid, i, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for n, chunk in enumerate(split(v, marked_text(x), size)):
                    yield _rows([(uid, i, n, _pack(chunk))], [pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["uid", "doc_id", "no", "chunk"])

    def measure(batches):
        for batch in batches:
            for at in range(0, len(batch), 128):
                columns = [c.to_pylist() for c in batch.slice(at, 128).columns]
                yield _rows([(u, n, pickle.dumps(transfer(v, _unpack(c)))) for u, n, c in zip(*columns, strict=True)], [pa.int64(), pa.int32(), pa.binary()], ["uid", "no", "matrix"])

    def ordered(group: pa.Table, number: str) -> tuple[list[int], list[Matrix]]:
        order = np.argsort(group.column(number).to_numpy())
        return group.column(number).to_numpy()[order].tolist(), [pickle.loads(group.column("matrix")[int(k)].as_py()) for k in order]

    def multiply(group: pa.Table) -> pa.Table:
        numbers, matrices = ordered(group, "no")
        one = group.column("uid")[0].as_py(), numbers[0] // GROUP, pickle.dumps(reduce(product, matrices))
        return pa.Table.from_batches([_rows([one], [pa.int64(), pa.int32(), pa.binary()], ["uid", "part", "matrix"])])

    def between_groups(group: pa.Table) -> pa.Table:
        numbers, matrices = ordered(group, "part")
        uid = group.column("uid")[0].as_py()
        rows = [(uid, n, *a, *b) for n, (a, b) in zip(numbers, itertools.pairwise(boundaries(matrices)), strict=True)]
        return pa.Table.from_batches([_rows(rows, [pa.int64(), pa.int32(), *state_types], ["its", "part", *state_names])])

    def within_group(group: pa.Table) -> pa.Table:
        numbers, matrices = ordered(group, "no")
        uid, a, c, b, d = (group.column(x)[0].as_py() for x in ("uid", *state_names))
        states = itertools.pairwise(boundaries(matrices, (a, c), (b, d)))
        return pa.Table.from_batches([_rows([(uid, n, *x, *y) for n, (x, y) in zip(numbers, states, strict=True)], [pa.int64(), pa.int32(), *state_types], ["its", "at", *state_names])])

    def trace(batches):
        encoder = Encoder(v)
        for batch in batches:
            for at in range(0, len(batch), 128):
                columns = [c.to_pylist() for c in batch.slice(at, 128).columns]
                loaded = [_unpack(c) for c in columns[3]]
                encoder.learn(inner_words(v, loaded))
                for u, i, n, chunk, a, b, c, d in zip(*columns[:3], loaded, *columns[4:], strict=True):
                    ids = chunk_ids(encoder, chunk, (a, b), (c, d))
                    text = (chunk[1] + chunk[2])[b : len(chunk[1]) + d].replace(SPACE, " ").replace(LITERAL, SPACE)
                    same = b"".join([v.texts[k] for k in ids]) == text.encode("utf-8", "surrogatepass")
                    yield _rows([(u, i, n, np.array(ids, small).tobytes(), same)], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()], ["uid", "doc_id", "no", "ids", "same"])

    def join(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("no").to_numpy()).tolist()
        ids = np.concatenate([np.frombuffer(group.column("ids")[k].as_py(), small) for k in order]).tolist()
        one = _rows([(group.column("doc_id")[0].as_py(), len(ids), ids, all(group.column("same").to_pylist()))], [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_()], ["doc_id", "n_tokens", "ids", "round_trip"])
        return pa.Table.from_batches([one])

    # cut here: the row numbers must be the same for the matrices and for the backtrace
    dealt = cut(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(chunks, "uid long, doc_id long, no int, chunk binary").repartition("uid", "no"))
    matrices = cut(dealt.select("uid", "no", "chunk").mapInArrow(measure, "uid long, no int, matrix binary")).withColumn("part", F.floor(F.col("no") / GROUP).cast("int"))
    four = "enter int, enter_beyond int, leave int, leave_beyond int"
    products = matrices.groupBy("uid", "part").applyInArrow(multiply, "uid long, part int, matrix binary")
    outer = products.groupBy("uid").applyInArrow(between_groups, f"its long, part int, {four}").withColumnRenamed("part", "its_part")
    both = matrices.join(outer, (F.col("uid") == F.col("its")) & (F.col("part") == F.col("its_part"))).select("uid", "part", "no", "matrix", *state_names)
    states = both.groupBy("uid", "part").applyInArrow(within_group, f"its long, at int, {four}")
    joined = dealt.join(states, (F.col("uid") == F.col("its")) & (F.col("no") == F.col("at"))).select("uid", "doc_id", "no", "chunk", *state_names)
    traced = joined.mapInArrow(trace, "uid long, doc_id long, no int, ids binary, same boolean")
    return traced.groupBy("uid").applyInArrow(join, "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def _pack(chunk: Chunk) -> bytes:
    return zlib.compress(pickle.dumps(chunk), 1)


def _unpack(data: bytes) -> Chunk:
    return pickle.loads(zlib.decompress(data))


def _rows(rows, types, names) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``ids``; null ids are an empty text."""
    v = Vocabulary.load(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
