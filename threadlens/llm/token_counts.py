"""Token counts by a tokenizer compiled into deterministic transducers.

Two machines stand for the library's byte-level BPE. Both are deterministic, and their transitions carry the output:

* The *cutting* machine reads classes of characters and marks where a match of the byte-level pattern begins. It has 13
  states. The maps from state to state that its symbols generate are a finite monoid, so what a chunk of text does is
  one element of it. Chunks are folded side by side, a parallel prefix scan composes their maps by table lookup, and
  the scan gives every chunk the state it is entered in. Only then are the marks read off, again side by side.
* The *counting* machine reads the bytes of one match. A prefix of a match has exactly one last token, and two tokens may
  stand side by side only if no merge across their border would have come first. A state is the set of tokens that
  are begun but not ended, each with the token before it and the number of tokens since; a transition carries
  the change in the number of tokens. States and transitions are compiled when they are first needed and kept, up to
  ``MAX_TRANSITIONS``; beyond that the tables start anew, which costs time and changes no result.

Each different match of a slice of texts is counted once, and the last ``MAX_MATCHES`` counts are kept. Texts never leave their row, nothing is shuffled, and memory is
bounded by an Arrow batch, a slice and the tables. The character classes are read off the library itself.

Edge cases: null counts as empty, and an empty text has no tokens. Strings of special tokens in a text are one token each, as
the library has it by default. Texts of any length are processed whole, slice by slice of whole texts. A column with the
output's name is replaced; all others are handed through.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points folded in one chunk, code points per slice, and transitions and counted matches kept.
CHUNK = 256
SLICE_POINTS = 4_000_000
MAX_TRANSITIONS = 600_000
MAX_MATCHES = 300_000

# Symbols of the cutting machine: letters that may end a contraction are symbols of their own.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, ONE, R, V, L, E, RESET = range(12)
LETTERS = (LETTER, ONE, R, V, L, E)
# States: after a letter, a number, another character, a quote that begins a match, that quote and r, v or l, a whole
# contraction, and a run of white space of length one or more that ends in a blank or another space.
START, IN_L, IN_N, IN_O, Q, QR, QV, QL, DONE, BLANK1, SPACE1, BLANKS, SPACES = range(13)
HERE, BEFORE = 1, 2


def _cutting_step(state: int, symbol: int) -> tuple[int, int]:
    """Next state, and whether a match begins at this symbol (HERE) or at the one before it (BEFORE)."""
    late = BEFORE if state in (QR, QV, QL) else 0
    if symbol == RESET:
        return START, HERE | late
    if (state, symbol) in ((Q, ONE), (QR, E), (QV, E), (QL, L)):
        return DONE, 0
    if state == Q and symbol in (R, V, L):
        return {R: QR, V: QV, L: QL}[symbol], 0
    if late:
        state = IN_L
    if symbol in (BLANK, SPACE):
        if state in (BLANK1, SPACE1, BLANKS, SPACES):
            return (BLANKS if symbol == BLANK else SPACES), 0
        return (BLANK1 if symbol == BLANK else SPACE1), HERE | late
    kind = IN_L if symbol in LETTERS else IN_N if symbol == NUMBER else IN_O
    if state in (BLANK1, BLANKS):
        return kind, BEFORE if state == BLANKS else 0
    if state == kind or (state == Q and kind == IN_O):
        return kind, late
    return (Q if symbol == QUOTE else kind), HERE | late | (BEFORE if state == SPACES else 0)


class Cutter:
    """The cutting machine: step and mark tables, and the monoid of its state maps."""

    def __init__(self) -> None:
        steps = [[_cutting_step(s, c) for c in range(12)] for s in range(13)]
        self.step = np.array([[to for to, _ in row] for row in steps], dtype=np.uint8)
        self.mark = np.array([[mark for _, mark in row] for row in steps], dtype=np.uint8)
        maps = {tuple(range(13)): 0}
        todo, of_symbol = [tuple(range(13))], []
        for c in range(12):
            m = tuple(self.step[:, c].tolist())
            if m not in maps:
                maps[m] = len(maps)
                todo.append(m)
            of_symbol.append(maps[m])
        generators = todo[1:]
        while todo:
            m = todo.pop()
            for g in generators:
                then = tuple(g[s] for s in m)
                if then not in maps:
                    maps[then] = len(maps)
                    todo.append(then)
        self.maps = np.array(list(maps), dtype=np.uint8)
        self.of_symbol = np.array(of_symbol, dtype=np.uint16)
        self.then = np.array([[maps[tuple(b[s] for s in a)] for b in maps] for a in maps], dtype=np.uint16)

    def entry_states(self, folded: np.ndarray) -> np.ndarray:
        """State in which each chunk is entered: an exclusive prefix scan over the maps of the chunks."""
        scan, reach = folded.copy(), 1
        while reach < len(scan):
            scan[reach:] = self.then[scan[:-reach], scan[reach:]]
            reach *= 2
        before = np.concatenate([np.zeros(1, np.uint16), scan[:-1]])
        return self.maps[before, START]

    def cuts(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a match begins at each symbol. The first symbol must be RESET."""
        n, chunks = len(symbols), -(-len(symbols) // CHUNK)
        grid = np.full(chunks * CHUNK, RESET, dtype=np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        folded = np.zeros(chunks, dtype=np.uint16)
        for column in grid:
            folded = self.then[folded, self.of_symbol[column]]
        state = self.entry_states(folded)
        marks = np.empty_like(grid)
        for k, column in enumerate(grid):
            marks[k] = self.mark[state, column]
            state = self.step[state, column]
        marks = marks.T.reshape(-1)[:n]
        begins = (marks & HERE) > 0
        begins[:-1] |= (marks[1:] & BEFORE) > 0
        return begins


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Counter:
    """The counting machine of a merge list, compiled as it is used."""

    def __init__(self, vocab: dict[str, int], merges: list):
        alphabet = byte_alphabet()
        token = {bytes(alphabet[c] for c in name): i for name, i in vocab.items()}
        name = {i: b for b, i in token.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank, made = {}, {}
        for r, (a, b) in enumerate(pairs):
            if a + b in made:
                raise ValueError(f"two merges make {a + b!r}")
            made[a + b] = (vocab[a], vocab[b], r)
            self.rank[vocab[a], vocab[b]] = r
        parts = {vocab[t]: m for t, m in made.items()}
        self.right_edge = {t: self._edge(t, parts, 1) for t in name}
        self.left_edge = {t: self._edge(t, parts, 0) for t in name}
        self.children: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for text, t in token.items():
            node = 0
            for b in text:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][b]
            self.ends[node] = t
        self.kept: dict[bytes, int] = {}
        self._start_anew()

    @staticmethod
    def _edge(t: int, parts: dict, side: int) -> list[tuple[int, int]]:
        """Tokens that stood at one edge of ``t`` on the way to it, each with the rank that ended its time there."""
        out, until = [], 1 << 40
        while True:
            out.append((t, until))
            if t not in parts:
                return out
            until = parts[t][2]
            t = parts[t][side]

    def _start_anew(self) -> None:
        self.state_of: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.next: dict[int, int] = {}
        self.beside: dict[int, bool] = {}

    def may_stand(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side: no merge across the border comes before theirs.

        Of equal pairs the leftmost merges first, so one across the border loses a tie against ``a`` and wins it against ``b``.
        """
        key = a << 20 | b
        found = self.beside.get(key)
        if found is None:
            found = not any(
                r < until_x and r <= until_y
                for x, until_x in self.right_edge[a] for y, until_y in self.left_edge[b]
                if (r := self.rank.get((x, y))) is not None
            )
            self.beside[key] = found
        return found

    def _compile(self, state: int, byte: int) -> int:
        """Add one transition: next state in the high bits, change of the count plus 2^15 in the low 16."""
        begun, last = [], None
        for node, before, since in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if last is None and self.ends[child] >= 0 and (before < 0 or self.may_stand(before, self.ends[child])):
                last = (self.ends[child], since + 1)
            if self.children[child]:
                begun.append((child, before, since))
        token, change = last
        to = (*((node, before, since - change) for node, before, since in begun), (0, token, 0))
        if to not in self.state_of:
            self.state_of[to] = len(self.states)
            self.states.append(to)
        value = self.state_of[to] << 16 | change + 32768
        self.next[state << 8 | byte] = value
        return value

    def _run(self, match: bytes) -> int:
        if len(self.next) > MAX_TRANSITIONS:
            self._start_anew()
        get, state, total = self.next.get, 0, -32768 * len(match)
        for b in match:
            value = get(state << 8 | b)
            if value is None:
                value = self._compile(state, b)
            total += value & 65535
            state = value >> 16
        return total

    def count(self, matches: list[bytes]) -> np.ndarray:
        """Number of tokens of each match."""
        if len(self.kept) > MAX_MATCHES:
            self.kept = {}
        out = list(map(self.kept.get, matches))
        for i, found in enumerate(out):
            if found is None:
                out[i] = self.kept[matches[i]] = self._run(matches[i])
        return np.array(out, dtype=np.int64)


def character_symbols(pre_tokenizer) -> bytes:
    """Symbol of every code point, read off the library: one cut of all characters, one look at each run."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in (32, 39)])
    spans = [span for _, span in pre_tokenizer.pre_tokenize_str("".join(map(chr, points)))]
    symbols = np.full(0x110000, OTHER, dtype=np.uint8)
    for begin, end in spans:
        first = chr(points[begin])
        symbols[points[begin:end]] = next(
            (k for k, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(pre_tokenizer.pre_tokenize_str(c + first)) == 1),
            SPACE)
    for c, k in (" ", BLANK), ("'", QUOTE), ("s", ONE), ("t", ONE), ("m", ONE), ("d", ONE), ("r", R), ("v", V), ("l", L), ("e", E):
        symbols[ord(c)] = k
    return symbols.tobytes()


class Transducer:
    """Both machines, the character classes and the special tokens of one tokenizer."""

    def __init__(self, blob: str, symbols: bytes):
        spec = json.loads(blob)
        self.symbols = np.frombuffer(symbols, dtype=np.uint8)
        self.cutter = Cutter()
        self.counter = Counter(spec["model"]["vocab"], spec["model"]["merges"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _slice(self, texts: list[str]) -> np.ndarray:
        joined = "\0" + "\0".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        borders = np.cumsum(lengths) - lengths
        symbols = self.symbols[points]
        symbols[borders] = RESET
        single = []
        if self.special is not None:
            for found in self.special.finditer(joined):
                symbols[found.start():found.end()] = RESET
                single.append(found.start())
        starts = np.flatnonzero(self.cutter.cuts(symbols))
        ends = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)
        offsets = np.concatenate([[0], ends])[np.concatenate([starts, [len(points)]])]
        data = joined.encode()
        matches = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        counts = self.counter.count(matches.dictionary.to_pylist())[np.asarray(matches.indices)]
        # Borders of texts and the characters of special tokens were cut one by one.
        counts[symbols[starts] == RESET] = 0
        counts[np.searchsorted(starts, np.array(single, dtype=np.int64))] = 1
        return np.add.reduceat(counts, np.searchsorted(starts, borders))

    def count(self, texts: pa.Array) -> pa.Array:
        """Number of tokens of each text."""
        out, part, size = [], [], 0
        for text in pc.fill_null(texts, "").to_pylist():
            if part and size + len(text) > SLICE_POINTS:
                out.append(self._slice(part))
                part, size = [], 0
            part.append(text)
            size += len(text)
        if part:
            out.append(self._slice(part))
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())


@lru_cache(maxsize=2)
def _transducer(blob: str, symbols: bytes) -> Transducer:
    return Transducer(blob, symbols)


def _check(spec: dict) -> None:
    """Refuse what the machines do not stand for."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not plain or odd:
        raise ValueError("only plain byte-level BPE tokenizers can be compiled")


def with_token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out`` (bigint): the number of tokens that the tokenizer's library gives for the whole text."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        blob = f.read()
    _check(json.loads(blob))
    context = df.sparkSession.sparkContext
    shared = context.broadcast((blob, character_symbols(Tokenizer.from_str(blob).pre_tokenizer)))

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        return _transducer(*shared.value).count(texts)

    return df.withColumn(out, counted(F.col(text_col)))
