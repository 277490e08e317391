"""Token counts by finite-state machines compiled from a byte-level BPE vocabulary.

Two deterministic transducers. The first reads character classes and emits where pre-tokens begin.
Each chunk of text gives a map from entry state to exit state; the maps compose associatively, so
a parallel prefix scan gives every chunk's entry state. The second reads a pre-token's bytes; its
transitions carry the change in the number of emitted BPE tokens. Its states are built when first
met: the longest suffix that a token may still extend, with the last token and relative count at
each place in it. A token may follow another if no merge crosses the seam, so exactly one token
ends each prefix. Counts equal the library's; special strings inside texts count as one token.

Pre-tokens are walked side by side. One longer than LONG bytes is cut into chunks that are walked at
once, each from the state that the WARM bytes before it lead to; a scan over the chunks composes
their maps, and a chunk whose predecessor ends in another state than it began with is walked again
from that one. The transition table is bounded: before a column could fill it up, it is emptied and
the states in use are entered anew.

Defined cases: null and empty texts have 0 bytes and 0 tokens; rows are independent, so repeated
ids, null ids and ties need no rule; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytebpe import DEFAULT, LETTER, NUMBER, OTHER, SPACE, WHITE, char_classes, tokenizer_path, vocabulary
from .common import documents
from .textbytes import blocks, utf8

#: Symbols of the first machine: the classes, then the characters that contractions need, and the end of a text.
APOSTROPHE, STMD, R, V, L, E, END = range(5, 12)
LETTERS = (LETTER, STMD, R, V, L, E)
FRESH, IN_L, IN_N, IN_O, S1, S2, W1, W2, AP, AP_R, AP_V, AP_L = range(12)
CHUNK = 64
#: Bytes of a pre-token that one lane walks, bytes before a chunk that guess its entry state, lanes at a time.
LONG, WARM, LANES = 512, 64, 1 << 16


def pretoken_machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol]; emits[state, symbol]: 1 a pre-token begins here, 2 one began at the symbol before."""
    nxt, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    begin = {OTHER: IN_O, NUMBER: IN_N, WHITE: W1, SPACE: S1, APOSTROPHE: AP, END: FRESH} | dict.fromkeys(LETTERS, IN_L)
    after_space = begin | {APOSTROPHE: IN_O}
    for s in range(12):
        for c in range(12):
            to, emit = begin[c], 1
            if s == IN_L and c in LETTERS or s == IN_N and c == NUMBER or s == IN_O and c in (OTHER, APOSTROPHE):
                to, emit = s, 0
            elif s in (S1, S2, W1, W2):
                if c in (SPACE, WHITE):
                    to, emit = (S2 if c == SPACE else W2), 0
                elif c != END:
                    to, emit = (after_space[c], 0) if s in (S1, S2) else (begin[c], 1)
                    emit |= 2 * (s in (S2, W2))
            elif s == AP:
                if c == STMD:
                    to, emit = FRESH, 0
                elif c in (R, V, L):
                    to, emit = {R: AP_R, V: AP_V, L: AP_L}[c], 0
                elif c in (OTHER, APOSTROPHE):
                    to, emit = IN_O, 0
            elif s in (AP_R, AP_V, AP_L):
                if c == (L if s == AP_L else E):
                    to, emit = FRESH, 0
                else:
                    emit = 2 | (c not in LETTERS)
            nxt[s, c], out[s, c] = to, emit
    return nxt, out


def prefix_states(nxt: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from FRESH: chunk maps, their prefix scan, then one pass from known entries."""
    n = len(symbols)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, END, np.uint8)
    grid[:n] = symbols
    grid, states, flat = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T), nxt.shape[0], nxt.reshape(-1)
    maps = np.tile(np.arange(states, dtype=np.uint8), (lanes, 1))
    for row in grid:
        maps = flat[maps.astype(np.int16) * 12 + row[:, None]]
    step = 1
    while step < lanes:  # Hillis-Steele scan; composition is associative
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.concatenate((np.array([FRESH], np.uint8), maps[:-1, FRESH]))
    seen = np.empty((CHUNK, lanes), np.uint8)
    for i, row in enumerate(grid):
        seen[i] = state
        state = flat[state.astype(np.int16) * 12 + row]
    return seen.T.reshape(-1)[:n]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the characters of valid UTF-8 bytes, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    cp = lead.copy()
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    for k, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        pick = np.flatnonzero(size == k)
        if len(pick):
            v = lead[pick] & mask
            for j in range(1, k):
                v = (v << 6) | (data[at[pick] + j] & 0x3F)
            cp[pick] = v
    return at, cp


class TokenCounter:
    """Counts tokens of UTF-8 texts under a byte-level BPE vocabulary file."""

    def __init__(self, path: str, max_transitions: int = 1 << 20):
        self.tokens, self.merges, self.added = vocabulary(path)
        self.by_id = {i: b for b, i in self.tokens.items()}
        self.parts = {made: (pair, rank) for pair, (rank, made) in sorted(self.merges.items(), key=lambda x: -x[1][0])}
        self.open = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.nxt, self.out = pretoken_machine()
        self.symbols = char_classes().copy()
        for c, kind in (("'", APOSTROPHE), *((c, STMD) for c in "stmd"), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.symbols[ord(c)] = kind
        self.bits = int(max_transitions - 1).bit_length()
        self.reset()

    def reset(self) -> None:
        """Forget built states; they are rebuilt when met again."""
        size = 1 << self.bits
        self.keys, self.to, self.add = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.states: list[tuple] = [(b"", (-1,), (0,))]
        self.ids = {self.states[0]: 0}
        self.built = 0
        self.pairs.clear()

    def make_room(self, lanes: int, held: tuple[np.ndarray, ...]) -> None:
        """Empty the table if this many more transitions could fill it; held: arrays of states, which are renumbered."""
        if self.built + lanes <= 5 << (self.bits - 3):
            return
        keep = np.unique(np.concatenate(held))
        states = [self.states[i] for i in keep.tolist()]
        self.reset()
        for x in states:
            if x not in self.ids:
                self.ids[x] = len(self.states)
                self.states.append(x)
        new = np.array([self.ids[x] for x in states], np.int32)
        for a in held:
            a[:] = new[np.searchsorted(keep, a)]

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token and its outer parts on one side, down to a byte, each with the rank of the merge that consumes it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.parts:
                return out
            pair, ends = self.parts[token]
            token = pair[side]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes together is the two tokens: no merge crosses the seam."""
        if a < 0:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            left, right = self.spine(a, 1), self.spine(b, 0)
            i, j, known = len(left) - 1, len(right) - 1, True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                m = self.merges.get((x, y))
                if m and m[0] < x_ends and m[0] <= y_ends:
                    known = False
                    break
                if not i and not j:
                    break
                if x_ends <= y_ends:
                    i -= 1
                else:
                    j -= 1
            self.pairs[a, b] = known
        return known

    def build(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state on a byte: the next state, and the change in emitted tokens."""
        text, last, count = self.states[state]
        text += bytes([byte])
        for s in range(len(text)):
            t = self.tokens.get(text[s:])
            if t is not None and self.follows(last[s], t):
                break
        else:
            raise ValueError("the vocabulary doesn't cover all bytes")
        add = count[s] + 1
        last, count, cut = (*last, t), (*count, add), 0
        while cut < len(text) and text[cut:] not in self.open:
            cut += 1
        key = (text[cut:], last[cut:], tuple(c - add for c in count[cut:]))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        return to, add

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transitions of many lanes at once, through a hash table; missing ones are built."""
        key = state.astype(np.int64) * 256 + byte
        mask = (1 << self.bits) - 1
        slot = ((key * 0x9E3779B1) >> 7) & mask
        found = self.keys[slot]
        wrong = np.flatnonzero(found != key)
        while len(wrong):
            free = found[wrong] == -1
            if free.any():
                for k in np.unique(key[wrong[free]]).tolist():
                    at = ((k * 0x9E3779B1) >> 7) & mask
                    while self.keys[at] not in (-1, k):
                        at = (at + 1) & mask
                    if self.keys[at] == -1:
                        self.to[at], self.add[at] = self.build(k >> 8, k & 255)
                        self.keys[at] = k
                        self.built += 1
            slot[wrong] = np.where(free | (found[wrong] == key[wrong]), slot[wrong], (slot[wrong] + 1) & mask)
            found[wrong] = self.keys[slot[wrong]]
            wrong = wrong[found[wrong] != key[wrong]]
        return self.to[slot], self.add[slot]

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start, byte end and row of each pre-token."""
        at, cp = code_points(data)
        row = np.searchsorted(offsets, at, side="right") - 1
        n = len(offsets) - 1
        place = np.arange(len(at)) + row
        symbols = np.full(len(at) + n, END, np.uint8)
        symbols[place] = self.symbols[cp]
        state = prefix_states(self.nxt, symbols)
        emit = self.out.reshape(-1)[state.astype(np.int16) * 12 + symbols]
        begins = (emit & 1).astype(bool)
        begins[:-1] |= (emit[1:] & 2).astype(bool)
        begins = begins[place]
        starts = at[begins]
        rows = row[begins]
        ends = np.concatenate((starts[1:], offsets[-1:]))
        return starts, np.minimum(ends, offsets[rows + 1]), rows

    def walk(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, held: tuple[np.ndarray, ...] = ()) -> np.ndarray:
        """Tokens emitted by each lane over its size bytes from at on; state is changed from entry to exit states."""
        total = np.zeros(len(at), np.int64)
        order = np.argsort(-size, kind="stable")
        most = min(LANES, 1 << (self.bits - 1))
        for a in range(0, len(order), most):
            pick = order[a : a + most]
            begin, now, sums = at[pick], state[pick], np.zeros(len(pick), np.int64)
            live = len(pick) - np.cumsum(np.bincount(size[pick]))  # lanes longer than k
            for k in range(int(size[pick[0]])):
                m = int(live[k])
                self.make_room(m, (now, state, *held))
                to, add = self.step(now[:m], data[begin[:m] + k])
                now[:m] = to
                sums[:m] += add
            state[pick], total[pick] = now, sums
        return total

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row, special strings not looked for."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        starts, ends, rows = self.pretokens(data, offsets)
        chunks = np.maximum(1, -(-(ends - starts) // LONG))
        nth = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = np.repeat(starts, chunks) + nth * LONG
        size, rows = np.minimum(np.repeat(ends, chunks) - at, LONG), np.repeat(rows, chunks)
        entry, later = np.zeros(len(at), np.int32), np.flatnonzero(nth)
        if len(later):
            guess = np.zeros(len(later), np.int32)
            self.walk(data, at[later] - WARM, np.full(len(later), WARM), guess, (entry,))
            entry[later] = guess
        leave = entry.copy()
        total = self.walk(data, at, size, leave, (entry,))
        while len(wrong := later[entry[later] != leave[later - 1]]):  # the first wrong one of a pre-token is right next time
            entry[wrong] = leave[wrong - 1]
            again = entry[wrong]
            total[wrong] = self.walk(data, at[wrong], size[wrong], again, (entry, leave))
            leave[wrong] = again
        out = np.zeros(n, np.int64)
        np.add.at(out, rows, total)
        return out

    def count_column(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row of a string column as the library counts them; special strings are one token each."""
        special = [c for c, _ in self.added]
        assert len(special) <= 1, "one added string at most"
        data, offsets = utf8(column)
        if special and special[0].encode() in data.tobytes():
            parts = [t.split(special[0]) for t in column.fill_null("").to_pylist()]
            sizes = np.array([len(p) for p in parts])
            data, offsets = utf8(pa.array([x for p in parts for x in p], pa.large_string()))
            return np.add.reduceat(self.counts(data, offsets), np.concatenate(([0], np.cumsum(sizes)[:-1]))) + sizes - 1
        return self.counts(data, offsets)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of a vocabulary file, kept by the worker."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; one narrow pass, nothing is shuffled."""
    path = path or tokenizer_path(f"{DEFAULT}.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for b in blocks(batch, "text"):
                _, offsets = utf8(b.column("text"))
                n = own.count_column(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
