"""Byte-pair tokenizers compiled to deterministic finite-state transducers.

Two machines run one after the other over whole batches of UTF-8 bytes:

* a character-class machine finds the pre-token boundaries (contractions, runs
  of letters, digits, other signs, white space with one character of lookahead);
* a byte machine, reset at each boundary, carries in its state every way in
  which a later vocabulary entry could still reach back over the bytes just
  read.  Its transitions are annotated with the change in the number of tokens
  of the best segmentation so far, and each state with the last token of it.

A state is the tuple of open trie nodes (longest first) with, for each, what the
token that ends where the node starts allows below it and the token count there
relative to the count at the state.  Exactly one vocabulary entry that ends at a
byte is compatible with the token before it, so the machine is deterministic.
Nodes under which the token before allows nothing are closed, and tokens that
allow the same entries below a node are not told apart, which keeps the states
few.  Only transitions that a text takes are compiled, in a table with a column for
each byte value met; past ``max_states`` the
table is dropped and begun again, so memory is bounded whatever the texts are.

Text is cut into chunks of equal size which are stepped in lockstep.  The state
map of a chunk that holds a boundary is constant, so composing the maps is a
forward fill of the last constant one (a prefix scan); the head of a chunk, up to
its first boundary, is then run from the state that the scan gives it.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from .textbatch import Texts

CHUNK = 256
#: Rounds in which all chunks without a boundary are asked at once.
SCAN_ROUNDS = 6
FEW = 48  # so many tokens below a node are looked at one by one
_NONE = -1

# The character classes of the pre-token pattern.
LETTER, NUMBER, OTHER, SPACE, BLANK, UNKNOWN = 0, 1, 2, 3, 4, 9
_EDGE = 8

#: What may follow an apostrophe as a token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by id, the merge that makes each, and the special strings."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], specials: dict[str, int]):
        self.size = max([*tokens, *specials.values()]) + 1
        self.tokens, self.specials = tokens, specials
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = dict.fromkeys(tokens, -1)
        for r, (left, right, made) in enumerate(merges):
            self.rank[left, right] = r
            self.parts.setdefault(made, (left, right))
            self.born[made] = r if self.born[made] < 0 else self.born[made]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their texts meet.

        Both are taken apart again, the merge done last first.  Whatever pair
        faces the cut at some time must not have a merge that comes before the
        one that in fact happened to either side; of equal merges the one
        further left happens first.
        """
        gone_left = gone_right = len(self.rank) + 1
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < gone_left and r <= gone_right:
                return False
            a, b = self.born[left], self.born[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                gone_left, left = a, self.parts[left][1]
            else:
                gone_right, right = b, self.parts[right][0]


def load_json(path: str) -> Vocabulary:
    """A vocabulary file of the ``tokenizers`` library (byte-level BPE)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_alphabet()
    vocab = spec["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in specials}
    merges = []
    for m in spec["model"]["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    return Vocabulary(tokens, merges, specials)


def load_ranks(path: str) -> Vocabulary:
    """A rank file of the ``tiktoken`` library; each token's merge is found by merging its bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    merges = []
    for token, r in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            merges.append((ranks[parts[0]], ranks[parts[1]], r))
    return Vocabulary({r: t for t, r in ranks.items()}, merges, {})


class Transducer:
    def __init__(self, vocab: Vocabulary, classify, max_states: int = 120_000):
        self.vocab, self.classify, self.max_states = vocab, classify, max_states
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [_NONE]
        grows = bytearray(1)
        for t, text in vocab.tokens.items():
            node = 0
            for b in text:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(_NONE)
                    grows.append(0)
                    grows[node] = 1
                node = nxt
            self.token_at[node] = t
        self.grows = grows
        self._number()
        self.length = np.ones(vocab.size + 1, dtype=np.int32)
        for t, text in vocab.tokens.items():
            self.length[t] = len(text)
        self.cls = np.full(0x110000, UNKNOWN, dtype=np.int8)
        self._clear()

    def _number(self) -> None:
        """Give the tokens their order in the trie, so that a node's are a range of it."""
        below: dict[int, list[int]] = {}
        for key, nxt in self.child.items():
            below.setdefault(key >> 8, []).append(nxt)
        self.low, self.high = [0] * len(self.token_at), [0] * len(self.token_at)
        self.order: list[int] = []
        todo = [0]
        while todo:
            node = todo.pop()
            if node < 0:
                self.high[~node] = len(self.order)
                continue
            self.low[node] = len(self.order)
            if self.token_at[node] >= 0:
                self.order.append(self.token_at[node])
            todo += [~node, *below.get(node, ())]

    def _allowed(self, before: int, node: int):
        """What may follow below a node: None for all, a token if there are many, else a tuple."""
        if before < 0:
            return None
        lo, hi = self.low[node], self.high[node]
        if hi - lo > FEW:
            return before
        got = self.allows.get((before, node))
        if got is None:
            own = self.token_at[node]
            got = tuple(i for i in range(lo, hi) if self.order[i] != own and self.vocab.compatible(before, self.order[i]))
            self.allows[before, node] = got = self.interned.setdefault(got, got)
        return got

    # -- the byte machine ------------------------------------------------

    def _clear(self) -> None:
        # a column for each byte value that texts have had
        self.column = np.full(256, -1, dtype=np.int32)
        self.value: list[int] = []
        self.next = np.full((2048, 32), -1, dtype=np.int32)
        self.next[1] = 1 << 8 | 128  # state 1: what came before is not known yet
        self.last = np.zeros(2048, dtype=np.int32)
        start = ((0, None, 0),)
        self.allows: dict[tuple[int, int], tuple] = {}
        self.interned: dict[tuple, tuple] = {}
        self.states: list[tuple] = [start, ()]
        self.known: dict[tuple, int] = {start: 0}

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte; the table is widened for values not met before."""
        for b in np.flatnonzero(np.bincount(data, minlength=256) * (self.column < 0)).tolist():
            self.column[b] = len(self.value)
            self.value.append(b)
        states, width = self.next.shape
        if len(self.value) > width:
            wide = np.full((states, min(256, -(-len(self.value) // 32) * 32)), -1, dtype=np.int32)
            wide[:, :width] = self.next
            wide[1] = 1 << 8 | 128
            self.next = wide
        return self.column[data]

    def _compile(self, state: int, column: int) -> None:
        byte = self.value[column]
        best, open_ = None, []
        for node, allowed, count in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            t, before = self.token_at[nxt], allowed
            if isinstance(allowed, tuple):
                # a node's own token comes first in its range
                own = t >= 0 and self.low[nxt] in allowed
                lo, hi = self.low[nxt] + (t >= 0), self.high[nxt]
                before = tuple(i for i in allowed if lo <= i < hi)
            else:
                own = t >= 0 and (allowed is None or self.vocab.compatible(allowed, t))
                if allowed is not None and self.grows[nxt]:
                    before = self._allowed(allowed, nxt)
            if own and best is None:
                best = (t, count + 1)
            if self.grows[nxt] and before != ():
                open_.append((nxt, before, count))
        t, delta = best
        key = (*((node, before, count - delta) for node, before, count in open_), (0, t, 0))
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.last):
                more = min(len(self.last), 8192)
                self.next = np.concatenate([self.next, np.full((more, self.next.shape[1]), -1, dtype=np.int32)])
                self.last = np.concatenate([self.last, np.zeros(more, dtype=np.int32)])
            self.last[to] = t
        self.next[state, column] = to << 8 | delta + 128

    def _step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Packed (next state, change of count + 128) of each lane."""
        width = self.next.shape[1]
        at = state * width + column
        got = self.next.ravel()[at]
        if len(got) and got.min() < 0:
            for key in np.unique(at[got < 0]):
                self._compile(*divmod(int(key), width))
            got = self.next.ravel()[at]
        return got

    def _run(self, data: np.ndarray, reset: np.ndarray, out: np.ndarray, want_last: bool) -> None:
        """Fill out with each byte's change of count, or its state's last token."""
        n = len(data)
        lanes = -(-n // CHUNK)
        size = lanes * CHUNK
        column = np.zeros(size, dtype=np.int32)
        column[:n] = self._columns(data)
        go_on = np.ones(size, dtype=np.int32)
        go_on[:n] -= reset
        go_on[n:] = 0
        column = np.ascontiguousarray(column.reshape(lanes, CHUNK).T)
        go_on = np.ascontiguousarray(go_on.reshape(lanes, CHUNK).T)
        result = np.zeros((CHUNK, lanes), dtype=out.dtype)

        def emit(k: int, lane, got: np.ndarray) -> np.ndarray:
            state = got >> 8
            result[k, lane] = self.last[state] if want_last else (got & 255) - 128
            return state

        every = slice(None)
        state = np.ones(lanes, dtype=np.int32)  # unknown until the first boundary
        for k in range(CHUNK):
            state = emit(k, every, self._step(state * go_on[k], column[k]))
        # a chunk with a boundary has a constant map, which carries over to the next one's head
        head = np.where((go_on == 0).any(axis=0), (go_on == 0).argmax(axis=0), CHUNK)
        self._scan(column, np.flatnonzero(head == CHUNK), state)
        lane = np.flatnonzero(head > 0)
        now = state[lane - 1]
        for k in range(int(head[lane].max()) if len(lane) else 0):
            live = head[lane] > k
            lane, now = lane[live], now[live]
            now = emit(k, lane, self._step(now, column[k, lane]))
        out[:] = result.T.ravel()[:n]

    def _scan(self, column: np.ndarray, lanes: np.ndarray, state: np.ndarray) -> None:
        """Set the states after chunks without a boundary, by composing their state maps.

        A map is known where it was asked for, and equal chunks share theirs.  All
        chunks are asked at once: at first for what follows a boundary, then for
        the states that the chunks before them gave.  Few such rounds leave little
        unknown, as states soon forget where they began; the maps are then
        composed in order, and only what is still unknown is run by itself.
        """
        if not len(lanes):
            return
        content = np.unique(column[:, lanes].T, axis=0, return_inverse=True)[1].ravel().tolist()
        maps: dict[tuple[int, int], int] = {}

        def ask(places: Sequence[int], states: list[int]) -> None:
            new = {(content[i], s): i for i, s in zip(places, states, strict=True) if (content[i], s) not in maps}
            if new:
                lane, now = lanes[list(new.values())], np.array([s for _, s in new], dtype=np.int32)
                for k in range(CHUNK):
                    now = self._step(now, column[k, lane]) >> 8
                maps.update(zip(new, now.tolist(), strict=True))

        chained = np.append(False, lanes[1:] - 1 == lanes[:-1])
        given = [0] * len(lanes)
        for _ in range(SCAN_ROUNDS):
            ask(range(len(lanes)), given)
            after = np.array([maps[c, s] for c, s in zip(content, given, strict=True)])
            before = np.where(chained, np.append(0, after[:-1]), state[lanes - 1]).tolist()
            if before == given:
                break
            given = before
        for i, lane in enumerate(lanes.tolist()):
            s = int(state[lane - 1])
            ask([i], [s])
            state[lane] = maps[content[i], s]

    # -- the class machine -------------------------------------------------

    def boundaries(self, t: Texts) -> np.ndarray:
        """For each byte, whether a pre-token begins there."""
        data = t.data
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at].astype(np.int32)
        code = lead.copy()
        padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
        wide = np.flatnonzero(lead >= 0xC0)
        if len(wide):
            p, b = at[wide], lead[wide]
            c1, c2, c3 = (padded[p + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
            code[wide] = np.where(b < 0xE0, (b & 0x1F) << 6 | c1, np.where(b < 0xF0, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        k = self.cls[code]
        if (k == UNKNOWN).any():
            for c in np.unique(code[k == UNKNOWN]):
                self.cls[c] = self.classify(chr(c))
            k = self.cls[code]
        n = len(k)
        first = np.zeros(n + 1, dtype=bool)  # the first character of a row
        first[np.searchsorted(at, t.off[:-1])] = True
        first[n] = True
        before = np.empty(n, dtype=np.int8)
        before[1:], before[first[:n]] = k[:-1], _EDGE
        after = np.empty(n, dtype=np.int8)
        after[:-1], after[first[1:]] = k[1:], _EDGE
        blank = (k == SPACE) | (k == BLANK)
        was_blank = (before == SPACE) | (before == BLANK)
        text_follows = (after != SPACE) & (after != BLANK) & (after != _EDGE)
        begin = np.where(blank, text_follows | ~was_blank, (before != k) & (before != SPACE))
        quote = np.flatnonzero(begin & (code == ord("'")) & (after == LETTER))
        for short in CONTRACTIONS if len(quote) else ():
            ok = quote[quote + len(short) < n]
            for i, c in enumerate(short, 1):
                ok = ok[(code[ok + i] == ord(c)) & ~first[ok + i]]
            begin[ok + 1] = False
            end = ok + 1 + len(short)
            begin[end[end < n]] = True
        out = np.zeros(len(data), dtype=bool)
        out[at[begin]] = True
        return out

    # -- whole texts -------------------------------------------------------

    def _pieces(self, t: Texts) -> tuple[Texts, list | None]:
        """Split rows at special strings; None if there are none."""
        raw = t.data.tobytes() if self.vocab.specials else b""
        if not any(s.encode() in raw for s in self.vocab.specials):
            return t, None
        off, plan = [0], []
        keep: list[bytes] = []
        for i in range(t.n):
            rest, row = t.row_text(i), []
            while True:
                found = min(((rest.find(s.encode()), -len(s), s) for s in self.vocab.specials if s.encode() in rest), default=None)
                head = rest if found is None else rest[: found[0]]
                keep.append(head)
                off.append(off[-1] + len(head))
                if found is None:
                    break
                row.append(self.vocab.specials[found[2]])
                rest = rest[found[0] + len(found[2].encode()) :]
            plan.append(row)
        return Texts(np.frombuffer(b"".join(keep), dtype=np.uint8), np.array(off, dtype=np.int64)), plan

    def _room(self) -> None:
        if len(self.states) > self.max_states:
            self._clear()

    def counts(self, t: Texts) -> np.ndarray:
        """Tokens of each row."""
        self._room()
        t, plan = self._pieces(t)
        delta = np.zeros(len(t.data), dtype=np.int8)
        if len(t.data):
            self._run(t.data, self.boundaries(t), delta, False)
        per = t.sums(delta)
        if plan is None:
            return per
        ends = np.cumsum([len(row) + 1 for row in plan])
        extra = np.array([len(row) for row in plan])
        return np.diff(np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], ends])]) + extra

    def ids(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, where each row's begin and the end)."""
        self._room()
        t, plan = self._pieces(t)
        n = len(t.data)
        if not n:
            ids, off = np.zeros(0, dtype=np.int32), np.zeros(t.n + 1, dtype=np.int64)
        else:
            last = np.zeros(n, dtype=np.int32)
            begin = self.boundaries(t)
            self._run(t.data, begin, last, True)
            start = np.flatnonzero(begin)
            pos = np.append(start[1:], n) - 1
            ends = np.zeros(n, dtype=bool)
            while len(pos):
                ends[pos] = True
                pos = pos - self.length[last[pos]]
                going = pos >= start
                pos, start = pos[going], start[going]
            where = np.flatnonzero(ends)
            ids, off = last[where], np.searchsorted(where, t.off)
        if plan is None:
            return ids, off
        parts, sizes, k = [], [], 0
        for row in plan:
            size = 0
            for special in [*row, None]:
                parts.append(ids[off[k] : off[k + 1]])
                size += len(parts[-1])
                k += 1
                if special is not None:
                    parts.append(np.array([special], dtype=np.int32))
                    size += 1
            sizes.append(size)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def _classifier(tokenizer):
    split = tokenizer.pre_tokenizer.pre_tokenize_str

    def of(c: str) -> int:
        if c == " ":
            return SPACE
        for sample, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(split(sample + c)) == 1:
                return k
        return BLANK

    return of


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache(maxsize=4)
def _compiled(path: str, classes_of: str) -> Transducer:
    from tokenizers import Tokenizer

    of = _classifier(Tokenizer.from_file(classes_of))
    made = Transducer(load_ranks(path) if path.endswith(".tiktoken") else load_json(path), of)
    _trim()
    return made


def compiled(path: str, classes_of: str | None = None) -> Transducer:
    """The transducer of a vocabulary file, one for all operators, kept until ``release``.

    classes_of: the ``tokenizers`` file whose pre-tokenizer tells letters,
    digits and white space apart; by default the file itself.
    """
    return _compiled(path, classes_of or path)


def release() -> None:
    """Free the transducers that this worker keeps.

    Workers outlive a stage; an operator without tokenizers calls this when its
    task begins, so that in a chain of stages it doesn't pay for their memory.
    """
    if _compiled.cache_info().currsize:
        _compiled.cache_clear()
        _trim()


def encode_all(transducer: Transducer, texts: Sequence[str | None]) -> list[list[int]]:
    """Ids of each text: the plain form of ``ids``, for tests and small use."""
    ids, off = transducer.ids(Texts.of(list(texts)))
    return [ids[off[i] : off[i + 1]].tolist() for i in range(len(off) - 1)]
