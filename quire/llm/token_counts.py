"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

1. Splitting.  The tokenizer's pattern (contractions, letters, numbers, other
   characters, white space) becomes an automaton of twelve states over twelve
   character classes; a transition says whether a piece starts at this or at the
   previous character.  Texts are cut into chunks; each chunk's state map (end
   state for every start state) is computed for all chunks at once, the maps are
   composed by a parallel prefix scan, and with the true start states known a
   second sweep emits the piece starts.

2. Merging.  Inside a piece the BPE result of every prefix is followed byte by
   byte: the last token of a prefix is the one token that ends there and stays
   apart from the last token before it.  Only the tail that is still the start
   of some token matters later, so the states (tail, last tokens along it) are
   finite; they are compiled when first reached, and each transition is
   annotated with the change of the token count.

Special strings in a text are one token each, as the library has it by default.

Cases: a null text counts as empty (0 bytes, 0 tokens); texts of any length are
counted whole, very long ones in parts cut where a piece surely starts; repeated
rows get a row each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: characters in a chunk, in one sweep, and in one part of a long text
CHUNK = 512
SWEEP = 1 << 20
PART = 1 << 22
#: pieces and states kept by a worker before it starts afresh
MAX_PIECES = 1_000_000
MAX_STATES = 300_000

# classes of characters
OTHER_LETTER, S_T_M_D, R, E, V, EL, NUMBER, BLANK, SPACE, QUOTE, OTHER, END, PAD = range(13)
_LETTERS = (OTHER_LETTER, S_T_M_D, R, E, V, EL)
# states: what the current piece is
START, LETTERS, NUMBERS, OTHERS, Q, Q_R, Q_V, Q_L, ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE = range(12)
N_STATES = 12
# fixed values: the code points of Unicode's White_Space property
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes(splits=None) -> np.ndarray:
    """Class of every code point.  Code points that Python does not know are
    asked of the tokenizer (``splits``: its splitting function), whose Unicode
    tables may be newer."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    first = np.frombuffer(kinds.encode(), np.uint8)
    out = np.full(0x110000, OTHER, np.uint8)
    out[first == ord("L")] = OTHER_LETTER
    out[first == ord("N")] = NUMBER
    out[_WHITE] = SPACE
    for char, kind in ((" ", BLANK), ("'", QUOTE), ("r", R), ("e", E), ("v", V), ("l", EL),
                       *((c, S_T_M_D) for c in "stmd")):
        out[ord(char)] = kind
    if splits is not None:
        unknown = [c for c in np.flatnonzero(first == ord("C")).tolist()
                   if c < 0x40000 and unicodedata.category(chr(c)) == "Cn"]
        begins = {a for _, (a, _) in splits("".join(f"a{chr(c)}1 " for c in unknown))}
        for k, c in enumerate(unknown):
            if 4 * k + 1 not in begins:
                out[c] = OTHER_LETTER
            elif 4 * k + 2 not in begins:
                out[c] = NUMBER
    return out


def split_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts) by class and state, flat; starts has bit 1 if a
    piece starts at this character and bit 2 if one starts at the one before."""
    begin = {**{c: LETTERS for c in _LETTERS}, NUMBER: NUMBERS, BLANK: ONE_BLANK, SPACE: ONE_SPACE, QUOTE: Q,
             OTHER: OTHERS, END: START}
    goes, starts = np.zeros((13, N_STATES), np.uint8), np.zeros((13, N_STATES), np.uint8)

    def new(c: int, before: int = 0) -> tuple[int, int]:
        return begin[c], before | (c != END)

    for c in range(12):
        letter, white = c in _LETTERS, c in (BLANK, SPACE)
        at = {START: new(c), LETTERS: (LETTERS, 0) if letter else new(c),
              NUMBERS: (NUMBERS, 0) if c == NUMBER else new(c),
              OTHERS: (OTHERS, 0) if c in (QUOTE, OTHER) else new(c)}
        at[Q] = {S_T_M_D: (START, 0), R: (Q_R, 0), V: (Q_V, 0), EL: (Q_L, 0)}.get(c) or (
            (OTHERS, 0) if c in (QUOTE, OTHER) else new(c))
        for state, last in ((Q_R, E), (Q_V, E), (Q_L, EL)):  # 're, 've, 'll, or a quote and a word
            at[state] = (START, 0) if c == last else (LETTERS, 2) if letter else new(c, 2)
        more = (RUN_BLANK if c == BLANK else RUN_SPACE, 0)
        joined = {**{k: LETTERS for k in _LETTERS}, NUMBER: NUMBERS, QUOTE: OTHERS, OTHER: OTHERS}.get(c)
        for state, late in ((ONE_BLANK, 0), (RUN_BLANK, 2)):  # the blank goes with what follows
            at[state] = more if white else (START, 0) if c == END else (joined, late)
        for state, late in ((ONE_SPACE, 0), (RUN_SPACE, 2)):  # the last space stands alone
            at[state] = more if white else (START, 0) if c == END else new(c, late)
        for state, (to, mark) in at.items():
            goes[c, state], starts[c, state] = to, mark
    goes[PAD] = np.arange(N_STATES)
    return goes.ravel(), starts.ravel()


class Splitter:
    """The first transducer: piece starts of many texts at once."""

    def __init__(self, splits=None):
        self.classes = character_classes(splits)
        self.goes, self.starts = split_machine()

    def chunk_maps(self, cols: np.ndarray) -> np.ndarray:
        """End state of every chunk for every start state; ``cols`` is class
        times N_STATES, by place and chunk.  Chunks whose states have run
        together go on as one."""
        width, n = cols.shape
        cur = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (n, N_STATES))
        out = np.empty((n, N_STATES), np.uint8)
        rows, at = np.arange(n), 0
        while at < width and len(rows):
            to = min(at + 16, width)
            part = cols[at:to, rows] if len(rows) < n else cols[at:to]
            for line in part:
                cur = self.goes[line[:, None] + cur]
            at = to
            one = (cur == cur[:, :1]).all(axis=1)
            if one.any():
                single = cur[one, 0]
                alone = rows[one]
                for line in cols[at:, alone] if at < width else ():
                    single = self.goes[line + single]
                out[alone] = single[:, None]
                rows, cur = rows[~one], cur[~one]
        out[rows] = cur
        return out

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions of state maps, in log steps."""
        step, n = 1, len(maps)
        while step < n:
            later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            maps = np.concatenate((maps[:step], later))
            step *= 2
        return maps

    def piece_starts(self, texts: list[str]) -> list[np.ndarray]:
        """Places in each text where a piece starts, ascending."""
        sizes = np.array([len(t) + 1 for t in texts])  # with an end mark
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.classes[points]
        ends = np.cumsum(sizes)
        kinds[ends - 1] = END
        chunks = -(-sizes // CHUNK)
        first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
        padded = np.full(int(chunks.sum()) * CHUNK, PAD, np.uint8)
        shift = np.repeat(first * CHUNK - (ends - sizes), sizes)
        places = np.arange(len(kinds)) + shift
        padded[places] = kinds
        cols = np.ascontiguousarray(padded.reshape(-1, CHUNK).T).astype(np.int16) * N_STATES
        n = cols.shape[1]
        state = np.zeros(n, np.uint8)
        if (chunks > 1).any():
            maps = self.chunk_maps(cols)
            maps[first] = maps[first, START][:, None]  # a text starts in START, whatever came before
            state[1:] = self.scan(maps)[:-1, 0]
            state[first] = START
        marks = np.empty((CHUNK, n), np.uint8)
        for line, mark in zip(cols, marks):
            at = line + state
            mark[:] = self.starts[at]
            state = self.goes[at]
        flat = np.ascontiguousarray(marks.T).ravel()[places]
        begins = (flat & 1).astype(bool)
        begins[:-1] |= (flat[1:] & 2).astype(bool)
        at = np.flatnonzero(begins)
        cut = np.searchsorted(at, ends)
        low = np.concatenate(([0], cut[:-1]))
        return [at[a:b] - e for a, b, e in zip(low.tolist(), cut.tolist(), (ends - sizes).tolist())]


def byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class MergeMachine:
    """The second transducer: token count of a piece, compiled as it is used."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte_of = byte_characters()
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.heads = {t[:k] for t in self.ids for k in range(len(t))}  # proper beginnings of tokens
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, pair in enumerate(merges):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right = self.ids[a], self.ids[b]
            self.rank[left, right] = rank
            self.made.setdefault(self.ids[a + b], (rank, left, right))
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.tails: dict[bytes, tuple[list[tuple[int, int]], int]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}  # 256 * state + byte: state, change of the count
        self.state((b"", (-1,), (0,)))

    def state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.known)
            self.known.append(key)
        return found

    def endings(self, tail: bytes) -> tuple[list[tuple[int, int]], int]:
        """The tokens that end a tail, the longest first, as (length, token),
        and how much of the tail can still be the beginning of a token."""
        found = self.tails.get(tail)
        if found is None:
            if len(self.tails) > MAX_STATES:
                self.tails.clear()
            ends = [(k, self.ids[tail[-k:]]) for k in range(len(tail), 0, -1) if tail[-k:] in self.ids]
            keep = next(k for k in range(len(tail), -1, -1) if tail[len(tail) - k:] in self.heads)
            found = self.tails[tail] = (ends, keep)
        return found

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The parts along one edge of a token's merge tree, the byte first,
        each with the rank of the merge that swallows it."""
        found = self.edges.get((token, right))
        if found is None:
            found, swallowed, t = [], float("inf"), token
            while True:
                found.append((t, swallowed))
                if t not in self.made:
                    break
                swallowed, left, end = self.made[t]
                t = end if right else left
            found = self.edges[token, right] = found[::-1]
        return found

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay as they are: no merge across
        the border comes before the parts beside it are swallowed on their own
        side (on a tie the merge further left comes first)."""
        if (a, b) in self.rank:
            return False
        found = self.apart.get((a, b))
        if found is None:
            left, right, i, j, found = self.edge(a, True), self.edge(b, False), 0, 0, True
            while True:
                (x, x_gone), (y, y_gone) = left[i], right[j]
                m = self.rank.get((x, y))
                if m is not None and m < x_gone and m <= y_gone:
                    found = False
                    break
                if x_gone == y_gone == float("inf"):
                    break
                if x_gone <= y_gone:
                    i += 1
                else:
                    j += 1
            if len(self.apart) > MAX_PIECES:
                self.apart.clear()
            self.apart[a, b] = found
        return found

    def compile(self, at: int, byte: int) -> tuple[int, int]:
        """The transition from a state on a byte."""
        tail, last, counts = self.known[at]
        tail += bytes((byte,))
        ends, keep = self.endings(tail)
        for k, token in ends:
            if last[k - 1] < 0 or self.stay_apart(last[k - 1], token):
                break
        else:
            raise ValueError(f"no token ends {tail!r}")
        change = counts[k - 1] + 1
        key = (tail[len(tail) - keep:], (token, *last[:keep]), (0, *[c - change for c in counts[:keep]]))
        move = self.moves[256 * at + byte] = (self.state(key), change)
        return move

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Token count of every piece; ``pieces`` sorted, so that each goes on
        from the state after what it shares with the one before."""
        if len(self.known) > MAX_STATES:
            self.reset()
        out, path, sums, prev, moves = [], [0], [0], b"", self.moves.get
        for piece in pieces:
            k = 0
            for x, y in zip(piece, prev):
                if x != y:
                    break
                k += 1
            del path[k + 1:], sums[k + 1:]
            at, n = path[k], sums[k]
            for byte in piece[k:]:
                at, change = moves(256 * at + byte) or self.compile(at, byte)
                n += change
                path.append(at)
                sums.append(n)
            out.append(n)
            prev = piece
        return out


_SURE = re.compile("[A-Za-z](?= [A-Za-z])")


def parts(text: str) -> list[str]:
    """A long text in parts, cut where a piece surely starts: at a blank between letters."""
    if len(text) <= PART:
        return [text]
    out, at = [], 0
    while at < len(text):
        cut = _SURE.search(text, at + PART)
        end = cut.end() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


def cut(text: str, starts: np.ndarray) -> list[str]:
    """The pieces of a text."""
    at = starts.tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


def sweeps(texts: list[str | None], specials: re.Pattern | None, most: int = SWEEP) -> Iterator[list[tuple[int, str]]]:
    """(row, text to split) in groups of about ``most`` characters, without the
    special strings."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for run in (specials.split(text) if specials and text else [text or ""]):
            for part in parts(run):
                if part:
                    group.append((row, part))
                    size += len(part)
                if size >= most:
                    yield group
                    group, size = [], 0
    if group:
        yield group


class TokenCounts:
    """Both transducers, for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.splitter = Splitter(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        self.machine = MergeMachine(spec["model"]["vocab"], spec["model"]["merges"])
        self.pieces: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.array([len(self.specials.findall(t)) if self.specials and t else 0 for t in texts], np.int64)
        for group in sweeps(texts, self.specials):
            if len(self.pieces) > MAX_PIECES:
                self.pieces.clear()
            unknown = []
            for (row, text), at in zip(group, self.splitter.piece_starts([t for _, t in group])):
                pieces = cut(text, at)
                n = np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))
                miss = np.flatnonzero(n < 0)
                out[row] += n.sum() + len(miss)
                unknown += [(row, pieces[i]) for i in miss.tolist()]
            new = {p: p.encode("utf-8", "surrogatepass") for _, p in unknown}
            order = sorted(new, key=new.__getitem__)
            self.pieces.update(zip(order, self.machine.counts([new[p] for p in order])))
            for row, piece in unknown:
                out[row] += self.pieces[piece]
        return out


_LOADED: dict[str, TokenCounts] = {}


def counter(path: str | None = None) -> TokenCounts:
    """The worker's compiled tokenizer; without a path, the public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _LOADED:
        _LOADED[path] = TokenCounts(path)
    return _LOADED[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["id", "b", "n"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"),
                     F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("b"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, b long, n long").select(
        F.col("id").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"),
        (F.col("n") > limit).alias("over_limit"))
