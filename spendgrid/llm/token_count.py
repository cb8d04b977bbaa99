"""Exact token counts of a byte-level BPE vocabulary by finite-state transducers.

The tokenizer file is compiled to two deterministic transducers. The first splits a text into
pieces: its transitions carry where pieces start. It runs over many chunks at once: each chunk
yields the map from entry state to exit state, the maps compose by a parallel prefix scan, and a
second pass with the entry states known reads off the starts. The second walks the bytes of each
piece; its transitions carry how many tokens the byte adds to the piece's BPE encoding (which may
be negative, when tokens merge). Its states are made as texts reach them. Nothing is encoded:
counts come from transitions alone.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that the splitter reads at a time, and characters in a chunk of the prefix scan.
GROUP_CHARS = 1 << 20
CHUNK = 256
#: Pieces longer than this leave the lockstep walk and go byte by byte.
LOCKSTEP = 64
#: States and looked-up pairs of tokens kept; full tables are dropped and made again as needed, which bounds memory only.
MAX_STATES = 1 << 18
MAX_PAIRS = 1 << 20

# Character classes of the splitter. S1 are letters that end a contraction alone ('s 't 'm 'd).
LETTER, S1, R, V, LL, E, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, END = range(12)
N_CLASSES = 12
# Its states: START also stands after a finished contraction. Runs of white space: one or more
# characters, ending in a space or not. AP: a piece that is an apostrophe so far, then r, v or l.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, AP, AP_R, AP_V, AP_L = range(12)
N_STATES = 12
#: What a transition says: a piece starts at this character, or at the one before, or both.
HERE, BEFORE = 1, 2

# Unicode's White_Space characters beyond U+0009 to U+000D and the space.
WHITE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """Class of every code point."""
    major = {"L": LETTER, "N": NUMBER}
    table = np.array([major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    table[[*range(9, 14), *WHITE_SPACE]] = WHITE
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    for letters, cls in (("stmd", S1), ("r", R), ("v", V), ("l", LL), ("e", E)):
        table[[ord(c) for c in letters]] = cls
    return table


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of each (state, class) of the splitting transducer."""
    letters = (LETTER, S1, R, V, LL, E)
    fresh = dict.fromkeys(letters, IN_LETTERS) | {NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, APOSTROPHE: AP, OTHER: IN_OTHER}
    attach = dict.fromkeys(letters, IN_LETTERS) | {NUMBER: IN_NUMBERS, APOSTROPHE: IN_OTHER, OTHER: IN_OTHER}
    to = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)
    out = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)

    def rule(state, cls, target, said=0):
        to[state, cls], out[state, cls] = target, said

    for state in range(N_STATES):  # unless said otherwise, a character starts a piece, and the end resets
        for cls, target in fresh.items():
            rule(state, cls, target, HERE)
        rule(state, END, START)
    for cls in letters:
        rule(IN_LETTERS, cls, IN_LETTERS)
    rule(IN_NUMBERS, NUMBER, IN_NUMBERS)
    for cls in (OTHER, APOSTROPHE):
        rule(IN_OTHER, cls, IN_OTHER)
        rule(AP, cls, IN_OTHER)
    for state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        rule(state, SPACE, RUN_SPACE)
        rule(state, WHITE, RUN_WHITE)
    for cls, target in attach.items():  # a last space goes with what follows; the run before it is a piece
        rule(ONE_SPACE, cls, target)
        rule(RUN_SPACE, cls, target, BEFORE)
    for cls in attach:
        rule(RUN_WHITE, cls, fresh[cls], BEFORE | HERE)
    rule(AP, S1, START)
    for cls, state, last in ((R, AP_R, E), (V, AP_V, E), (LL, AP_L, LL)):
        rule(AP, cls, state)
        for c in range(N_CLASSES):  # no contraction after all: the letter starts a run of its own
            rule(state, c, to[IN_LETTERS, c], out[IN_LETTERS, c] | BEFORE)
        rule(state, last, START)
    return to, out


def piece_starts(cls: np.ndarray, to: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Where pieces start in a sequence of classes, by composed chunk state maps."""
    n = len(cls)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, dtype=np.uint8)
    padded[:n] = cls
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.intp)  # a column is a chunk
    flat_to, flat_out = to.reshape(-1).astype(np.intp) * N_CLASSES, out.reshape(-1)
    # exit state of every chunk for every entry state
    maps = np.repeat(np.arange(N_STATES, dtype=np.intp)[:, None] * N_CLASSES, chunks, axis=1)
    for row in grid:
        maps = flat_to[maps + row]
    maps = (maps // N_CLASSES).T  # chunk x entry state
    # inclusive prefix scan by composition: log2(chunks) rounds
    step = 1
    while step < chunks:
        earlier = maps[:-step]
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], earlier, axis=1)])
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]) * N_CLASSES
    said = np.empty((CHUNK, chunks), dtype=np.uint8)
    for j, row in enumerate(grid):
        at = state + row
        said[j] = flat_out[at]
        state = flat_to[at]
    said = said.T.reshape(-1)
    starts = (said[:n] & HERE).astype(bool)
    starts[:-1] |= (said[1:n] & BEFORE).astype(bool)
    if len(said) > n and said[n] & BEFORE:
        starts[n - 1] = True
    return starts


def compile_tokenizer(path: str) -> dict:
    """What the tasks need of a byte-level BPE tokenizer file: plain tables, ready to be sent."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError("only byte-level BPE without normaliser and prefix space can be compiled")
    # the file writes each byte as a printable character: those that are one stand for themselves
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    as_bytes = lambda s: bytes(byte_of[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return {
        "ranks": {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)},
        "special": [t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]],
        "classes": character_classes(),
        "made": {},  # a worker keeps the transducer that it has built here, for its later tasks
    }


class Counter:
    """The byte transducer of a BPE merge list.

    After some bytes of a piece, every way to end the next token is known by the vocabulary
    prefixes that end here: the prefix, the last token before it, and how many tokens stood there
    against now. That set is a state. Reading a byte extends each prefix; exactly one that is
    now a whole token is a valid neighbour of the token before it, and becomes the last token of
    the encoding so far. The change in the number of tokens is the transition's output.
    """

    def __init__(self, ranks: dict):
        self.ranks = ranks
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in ranks}
        self.tokens = {t for t in tokens if self.encode(t) == [t]}
        self.inner = {t[:i] for t in self.tokens for i in range(1, len(t))}  # prefixes that can still grow
        self.reset()

    def reset(self) -> None:
        """An empty transducer: the start state, no table column, and no pair of neighbours looked up."""
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.ids = {((b"", None, 0),): 0}
        self.states = [((b"", None, 0),)]
        self.columns = np.full(256, -1, dtype=np.int32)
        self.bytes: list[int] = []
        self.width = 64
        self.to = np.full((1024, self.width), -1, dtype=np.int32)
        self.adds = np.zeros((1024, self.width), dtype=np.int16)

    def columns_of(self, data: np.ndarray) -> np.ndarray:
        """The table column of each byte."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.columns[byte] < 0:
                self.columns[byte] = len(self.bytes)
                self.bytes.append(int(byte))
                if len(self.bytes) > self.width:
                    self.to = np.concatenate([self.to, np.full_like(self.to, -1)], axis=1)
                    self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)], axis=1)
                    self.width *= 2
        return self.columns[data]

    def encode(self, data: bytes) -> list[bytes]:
        """BPE by its definition: the lowest-ranked merge first, then the leftmost."""
        parts: list = [data[i : i + 1] for i in range(len(data))]
        after = list(range(1, len(parts) + 1))
        prior = list(range(-1, len(parts) - 1))
        heap = [(self.ranks[p], i, p) for i in range(len(parts) - 1) if (p := (parts[i], parts[i + 1])) in self.ranks]
        heapify(heap)
        while heap:
            _, i, (a, b) = heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                prior[after[i]] = i
            for x, y in ((prior[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (p := (parts[x], parts[y])) in self.ranks:
                    heappush(heap, (self.ranks[p], x, p))
        return [p for p in parts if p is not None]

    def follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether ``b`` may stand after ``a`` (None: nothing) in an encoding."""
        if a is None:
            return True
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self.encode(a + b) == [a, b]
        return known

    def make(self, at: int) -> None:
        """Make the transition ``at = state * width + column``."""
        k, column = divmod(at, self.width)
        byte = bytes([self.bytes[column]])
        grown = [(p + byte, last, back) for p, last, back in self.states[k]]
        token, adds = next((w, back + 1) for w, last, back in grown if w in self.tokens and self.follows(last, w))
        state = (*((w, last, back - adds) for w, last, back in grown if w in self.inner), (b"", token, 0))
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
        self.to.reshape(-1)[at], self.adds.reshape(-1)[at] = k, adds

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[start:end]``."""
        if len(self.states) > MAX_STATES or len(self.pairs) > MAX_PAIRS:
            self.reset()
        column = self.columns_of(data)
        total = np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        size = (ends - starts)[order]
        at, state = starts[order], np.zeros(len(starts), dtype=np.int32)
        got = np.zeros(len(starts), dtype=np.int32)
        for k in range(min(LOCKSTEP, int(size[0]) if len(size) else 0)):
            live = int(np.searchsorted(-size, -k, side="left"))
            step = state[:live].astype(np.int64) * self.width + column[at[:live] + k]
            to = self.to.reshape(-1)[step]
            if len(missing := step[to < 0]):
                for x in np.unique(missing).tolist():
                    self.make(x)
                to = self.to.reshape(-1)[step]
            got[:live] += self.adds.reshape(-1)[step]
            state[:live] = to
        for i in range(int(np.searchsorted(-size, -LOCKSTEP, side="left"))):  # what long pieces have left
            s, n = int(state[i]), 0
            for c in column[at[i] + LOCKSTEP : at[i] + size[i]].tolist():
                if self.to[s, c] < 0:
                    self.make(s * self.width + c)
                s, n = int(self.to[s, c]), n + int(self.adds[s, c])
            got[i] += n
        total[order] = got
        return total


def _cut(text: str) -> list[str]:
    """A long text in parts of about GROUP_CHARS, cut only where a piece always starts: at white
    space after something else. A text without such a place stays whole."""
    parts, at = [], 0
    while len(text) - at > GROUP_CHARS:
        k = text.find(" ", at + GROUP_CHARS)
        while k > 0 and text[k - 1].isspace():
            k = text.find(" ", k + 1)
        if k < 0:
            break
        parts.append(text[at:k])
        at = k
    return [*parts, text[at:]]


def count_texts(texts: list[str], tables: dict) -> list[int]:
    """Tokens of each text. Special strings count one token and split the text around them."""
    made = tables["made"]
    if not made:
        made["counter"], (made["to"], made["out"]) = Counter(tables["ranks"]), splitter()
    counts = [0] * len(texts)
    group: list[tuple[int, str]] = []

    def flush():
        points = np.frombuffer("\0".join(t for _, t in group).encode("utf-32-le"), dtype="<u4")
        lengths = np.array([len(t) for _, t in group])
        firsts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        cls = tables["classes"][points]
        cls[firsts[1:] - 1] = END
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer("\0".join(t for _, t in group).encode("utf-8"), dtype=np.uint8)
        starts = np.flatnonzero(piece_starts(cls, made["to"], made["out"]))
        owner = np.searchsorted(firsts, starts, side="right") - 1
        stops = np.minimum(np.concatenate([starts[1:], [len(points)]]), (firsts + lengths)[owner])
        tokens = made["counter"].count(data, byte_at[starts], byte_at[stops])
        for i, n in enumerate(np.bincount(owner, weights=tokens, minlength=len(group))):
            counts[group[i][0]] += int(n)
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        parts = [text]
        for special in tables["special"]:
            counts[i] += sum(p.count(special) for p in parts)
            parts = [q for p in parts for q in p.split(special)]
        for part in (q for p in parts for q in _cut(p)):
            if part:
                group.append((i, part))
                held += len(part)
            if held >= GROUP_CHARS:
                flush()
                held = 0
    if group:
        flush()
    return counts


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = pa.array(count_texts(texts, shared.value), pa.int64())
            size = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, tokens], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, over whole texts (null: empty, 0 tokens).

    Counts equal the tokenizer library's for the same file, without begin, end or added special
    tokens; the file's special strings inside a text are one token each, as by its default. The
    work is one pass without a shuffle. Rows stay rows; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(tokenizer_path))  # bounded by the vocabulary
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_counts(shared), "id bigint, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
