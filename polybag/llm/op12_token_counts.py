"""How many tokens a byte-level BPE vocabulary gives for each text, by finite-state transducers.

Two deterministic transducers are compiled from a vocabulary file:

* ``WordCutter`` reads characters and marks where the pieces begin that merges never leave.  Its
  twelve states look back at most two characters, so a mark may also fall on the character just
  before.  A block of text is cut into chunks of equal length; every chunk is run from all states
  at once and becomes a map from state to state, the maps are composed by a parallel prefix scan,
  and a second run from the now known states yields the marks.
* ``MergeTransducer`` reads the bytes of a piece.  A transition carries the change in the number
  of tokens, which may be negative: ``h e`` are two tokens, with one more byte all three may be
  one.  A state holds what can still matter: for each beginning of a token that ends here, the
  last token before it and the number of tokens up to it.  That is enough because a sequence of
  tokens is what the merges give exactly if that holds for each two neighbours in it, so one last
  token fits every prefix (Berglund, van der Merwe, 2023).  States are made when first reached,
  up to ``STATES``; then the table starts anew, with equal results and bounded memory.

What a character is to the cutter (letter, number, white space, other) is asked of the tokenizer
library once, on the driver, so both always agree.  Special strings in a text count one each and
part the text, as the library does by default.

Work is a map over the rows of a scan, without a shuffle.  Only the vocabulary file and a byte per
character are broadcast, both of fixed size.  Within a task, texts are joined to blocks of
``BLOCK`` characters; a longer text is read block by block, each beginning where the last whole
piece ended, so the memory follows the block and the longest piece.

A null text counts as empty and an empty text has no tokens.  Repeated rows are counted alike, ids
may be null, an empty table stays empty, and other columns are neither read nor changed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polybag.llm.common import ROW, kept_whole, text_of
from polybag.session import ship_package

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BLOCK = 1 << 21
CHUNK = 256
STATES = 150_000
# Counts of pieces remembered by a worker, and the longest piece worth it.
PIECES, PIECE = 500_000, 64
NEVER = 1 << 60

# Kinds of characters.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, ONE, R, V, L, E, END = range(12)
LETTERS = {LETTER, ONE, R, V, L, E}
# States: which piece the last character belongs to.  SPACE1 and BLANK1 end a run of white space
# of length one, SPACE2 and BLANK2 a longer one; QUOTED began a piece with an apostrophe.
(FRESH, WORD, DIGITS, SIGNS, SPACE1, BLANK1, SPACE2, BLANK2,
 QUOTED, QUOTED_R, QUOTED_V, QUOTED_L) = range(12)
HERE, BEFORE = 1, 2


def _begin(kind: int) -> int:
    """State after a character that begins a piece."""
    if kind in LETTERS:
        return WORD
    return {NUMBER: DIGITS, OTHER: SIGNS, SPACE: SPACE1, BLANK: BLANK1, QUOTE: QUOTED, END: FRESH}[kind]


def cut_step(state: int, kind: int) -> tuple[int, int]:
    """The cutter's transition: (state, marks)."""
    white = kind in (SPACE, BLANK)
    sign = kind in (OTHER, QUOTE)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L if state == QUOTED_L else E):
            return FRESH, 0
        # No contraction: the letter before begins a word.
        state, marks = cut_step(WORD, kind)
        return state, marks | BEFORE
    if state == QUOTED and kind in (ONE, R, V, L):
        return {ONE: FRESH, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
    if (state == WORD and kind in LETTERS or state == DIGITS and kind == NUMBER
            or state in (SIGNS, QUOTED) and sign):
        return _begin(kind) if state != QUOTED and kind != QUOTE else SIGNS, 0
    if state in (SPACE1, BLANK1, SPACE2, BLANK2):
        if white:
            return (SPACE2 if kind == SPACE else BLANK2), 0
        if kind == END:
            return FRESH, HERE
        # The last of several white characters leaves the run; a space joins what follows.
        late = BEFORE if state in (SPACE2, BLANK2) else 0
        if state in (SPACE1, SPACE2):
            return (SIGNS if sign else _begin(kind)), late
        return _begin(kind), late | HERE
    return _begin(kind), HERE


class WordCutter:
    """Where pieces begin in a string of kinds."""

    def __init__(self) -> None:
        steps = [cut_step(s, k) for s in range(12) for k in range(12)]
        # A state is stored times twelve: adding the kind gives the next index.
        self.next = np.array([s * 12 for s, _ in steps], dtype=np.uint8)
        self.marks = np.array([m for _, m in steps], dtype=np.uint8)

    def maps(self, lanes: np.ndarray) -> np.ndarray:
        """(chunks, 12): the state each chunk leads to, from every state."""
        now = np.tile(np.arange(12, dtype=np.uint8) * 12, (lanes.shape[1], 1))
        for kinds in lanes:
            now = self.next[now + kinds[:, None]]
        return now

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Composition of each chunk's map after all before it, in log2(chunks) rounds."""
        maps, reach = maps // 12, 1
        while reach < len(maps):
            maps = np.concatenate([maps[:reach], np.take_along_axis(
                maps[reach:], maps[:-reach].astype(np.intp), axis=1)])
            reach *= 2
        return maps * 12

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """Positions where a piece begins (also those of END, which are no pieces)."""
        chunks = -(-len(kinds) // CHUNK)
        padded = np.full(chunks * CHUNK, END, dtype=np.uint8)
        padded[:len(kinds)] = kinds
        lanes = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        after = self.scan(self.maps(lanes))
        now = np.zeros(chunks, dtype=np.uint8)
        now[1:] = after[:-1, FRESH]
        marks = np.empty_like(lanes)
        for t, kind in enumerate(lanes):
            index = now + kind
            marks[t] = self.marks[index]
            now = self.next[index]
        # What the padding marks is no answer: the string may go on otherwise.
        marks = np.ascontiguousarray(marks.T).ravel()[:len(kinds)]
        found = marks & HERE
        found[:-1] |= marks[1:] >> 1
        return np.flatnonzero(found)


class MergeTransducer:
    """Bytes of a piece to its number of tokens, by states that are made when first reached.

    Tokens are numbered: bytes first, then in the order of the merges, which is their rank.
    """

    def __init__(self, merges: Iterable[tuple[bytes, bytes]], states: int = STATES) -> None:
        self.ids = {bytes([b]): b for b in range(256)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[int, int] = {}
        for left, right in merges:
            a, b, token = self.ids.get(left), self.ids.get(right), len(self.ids)
            if a is None or b is None or left + right in self.ids:
                raise ValueError("a merge comes before its parts, or twice")
            self.ids[left + right] = token
            self.parts[token], self.joins[a << 32 | b] = (a, b), token
        self.starts = {t[:n] for t in self.ids for n in range(len(t) + 1)}
        self.rights: dict[int, list] = {}
        self.lefts: dict[int, list] = {}
        self.wholes: dict[int, bool] = {}
        self.states = states
        self._clear()

    def _clear(self) -> None:
        # A state: the longest suffix read that starts a token; for each of its own suffixes that
        # start a token, where it begins, the last token before (-1 at the piece's start) and the
        # number of tokens there against the number here.
        first = (b"", ((0, -1, 0),))
        self.numbered, self.known = {first: 0}, [first]
        self.moves: dict[int, int] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a short piece, merge by merge."""
        parts = list(piece)
        while True:
            ranks = [self.joins.get(a << 32 | b, NEVER) for a, b in pairwise(parts)]
            best = min(ranks, default=NEVER)
            if best == NEVER:
                return parts
            out, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best and self.parts[best] == (parts[i], parts[i + 1]):
                    out.append(best)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at an edge of a token while it is made, with the merge that takes it away."""
        out = [(token, NEVER)]
        while token >= 256:
            outer, token = token, self.parts[token][side]
            out.append((token, outer))
        return out

    def fits(self, before: int, token: int) -> bool:
        """Whether two whole tokens side by side stay as they are.

        They do unless a merge across comes up while both its sides stand at the edge: before
        the merge that takes the left one away, and no later than that which takes the right one,
        as the leftmost of equal merges is first.
        """
        right = self.rights.get(before)
        if right is None:
            right = self.rights[before] = self._edge(before, 1)
        left = self.lefts.get(token)
        if left is None:
            left = self.lefts[token] = self._edge(token, 0)
        joins = self.joins
        for a, until_a in right:
            for b, until_b in left:
                rank = joins.get(a << 32 | b)
                if rank is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def _whole(self, token: int, piece: bytes) -> bool:
        """Whether the merges of a token's own bytes lead to it."""
        found = self.wholes.get(token)
        if found is None:
            found = self.wholes[token] = self.merged(piece) == [token]
        return found

    def _make(self, state: int, byte: int) -> int:
        """The transition as ``state * 4096 + change + 2048``."""
        tail, chain = self.known[state]
        text = tail + bytes((byte,))
        for at, last, count in chain:
            piece = text[at:]
            token = self.ids.get(piece)
            if token is not None and (last < 0 or self.fits(last, token)) and self._whole(token, piece):
                break
        else:
            raise ValueError(f"no token ends {text!r}")
        change = count + 1
        starts = self.starts
        kept = [(at, b, c - change) for at, b, c in chain if text[at:] in starts]
        off = kept[0][0] if kept else len(text)
        if off:
            kept = [(at - off, b, c) for at, b, c in kept]
        kept.append((len(text) - off, token, 0))
        target = text[off:], tuple(kept)
        number = self.numbered.get(target)
        if number is None:
            number = self.numbered[target] = len(self.known)
            self.known.append(target)
        move = self.moves[state << 8 | byte] = number << 12 | change + 2048
        return move

    def count(self, piece: bytes) -> int:
        if len(self.known) > self.states:
            self._clear()
        state = total = 0
        moves = self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.known) > 2 * self.states:  # a single piece of very many states
                    here = self.known[state]
                    self._clear()
                    moves, state = self.moves, 1
                    self.numbered[here] = 1
                    self.known.append(here)
                move = self._make(state, byte)
            state = move >> 12
            total += (move & 4095) - 2048
        return total


class _Pieces(dict):
    """Counts of pieces met before."""

    def __init__(self, merges: MergeTransducer) -> None:
        self.merges = merges

    def __missing__(self, piece: bytes) -> int:
        n = self.merges.count(piece)
        if len(piece) <= PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = n
        return n


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts the tokens of texts; made from a vocabulary file and the kinds of characters."""

    def __init__(self, file: str, kinds: np.ndarray, block: int = BLOCK) -> None:
        spec, letters = json.loads(file), byte_letters()
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = MergeTransducer(
            tuple(bytes(letters[c] for c in part) for part in pair) for pair in merges)
        self.pieces = _Pieces(self.merges)
        self.cutter, self.kinds, self.block = WordCutter(), kinds, block
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _read(self, text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(beginnings, tokens) of the whole pieces of ``text`` and where the rest begins.

        A part ends at each of ``ends``; what follows the last end is left open.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kinds = self.kinds[codes]
        kinds[ends] = END
        begins = self.cutter.begins(kinds)
        raw = text.encode()
        if len(raw) == len(codes):
            at = begins
        else:
            width = 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int8) + (codes >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[begins]
        cuts = at.tolist()
        real = kinds[begins[:-1]] != END
        tokens = np.zeros(len(begins) - 1, dtype=np.int64)
        tokens[real] = np.fromiter(
            (self.pieces[raw[a:b]] for (a, b), ok in zip(pairwise(cuts), real.tolist()) if ok),
            np.int64)
        return begins[:-1], tokens, int(begins[-1])

    def _long(self, part: str) -> int:
        """Tokens of one long part, read in blocks that begin where a piece begins."""
        total, at, size = 0, 0, self.block
        while at < len(part):
            text = part[at:at + size]
            last = at + size >= len(part)
            _, tokens, rest = self._read(text + "\n" if last else text,
                                         np.array([len(text)] if last else [], dtype=np.int64))
            total += int(tokens.sum())
            if last:
                break
            at, size = (at + rest, self.block) if rest else (at, 2 * size)
        return total

    def _short(self, parts: list[str]) -> np.ndarray:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        begins, tokens, _ = self._read("\n".join(parts) + "\n", ends)
        sums = np.concatenate([[0], np.cumsum(tokens)])
        return np.diff(sums[np.searchsorted(begins, ends)], prepend=0)

    def counts(self, texts: Iterable[str]) -> np.ndarray:
        """Number of tokens of each text."""
        texts = list(texts)
        totals = np.zeros(len(texts), dtype=np.int64)
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            cut = self.special.split(text) if self.special else [text]
            totals[i] += len(cut) - 1
            for part in cut:
                if len(part) > self.block:
                    totals[i] += self._long(part)
                    continue
                if size + len(part) > self.block:
                    np.add.at(totals, owners, self._short(parts))
                    parts, owners, size = [], [], 0
                parts.append(part)
                owners.append(i)
                size += len(part) + 1
        if parts:
            np.add.at(totals, owners, self._short(parts))
        return totals


def character_kinds(tokenizer) -> np.ndarray:
    """The kind of every code point, as the library's own splitting shows it.

    ``a?1!?1`` is cut before the first ``?`` unless it is a letter, after it unless a number, and
    between ``!`` and ``?`` only if it is white space.  Planes without letters are OTHER.
    """
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    planes = [*range(0x40000), *range(0xE0000, 0xF0000)]
    points = [c for c in planes if not 0xD800 <= c < 0xE000 and c != 0x20]
    for first in range(0, len(points), 20_000):
        some = points[first:first + 20_000]
        probe = "".join(f"a{c}1!{c}1" for c in map(chr, some))
        cut = np.zeros(len(probe) + 1, dtype=bool)
        cut[[a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]] = True
        before, after, between = (cut[np.arange(len(some)) * 6 + k] for k in (1, 2, 4))
        kinds[some] = np.select([~before, ~after, between], [LETTER, NUMBER, BLANK], OTHER)
    for kind, characters in {SPACE: " ", QUOTE: "'", ONE: "stmd", R: "r", V: "v", L: "l", E: "e"}.items():
        kinds[[ord(c) for c in characters]] = kind
    return kinds


def compiled(path: str) -> tuple[str, bytes]:
    """What a worker needs of a vocabulary file; refuses files the transducers do not cover."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as source:
        file = source.read()
    spec = json.loads(file)
    model, cutting = spec["model"], spec["pre_tokenizer"] or {}
    plain = all(not t[flag] for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word"))
    if not (plain and not spec["normalizer"] and cutting.get("type") == "ByteLevel"
            and cutting.get("use_regex", True) and not cutting["add_prefix_space"]
            and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    return file, character_kinds(Tokenizer.from_str(file)).tobytes()


_COUNTERS: dict[int, TokenCounter] = {}


def _counter(shared) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    file, kinds = shared.value
    key = hash((file, kinds))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(file, np.frombuffer(kinds, dtype=np.uint8))
    return _COUNTERS[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_count(spark: SparkSession, path: str | None = None) -> Column:
    """Column function: a text column to its number of tokens."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(compiled(path or default_path()))

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(shared)
        for texts in batches:
            yield pd.Series(counter.counts(texts))

    return run


def with_token_counts(docs: DataFrame, path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The rows with a column of token counts; one of that name is replaced."""
    return docs.withColumn(name, token_count(docs.sparkSession, path)(text_of()))


def token_digest(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes, tokens and whether there are more than ``limit`` of them."""
    counted = kept_whole(docs, F.octet_length(text_of()).cast("bigint").alias("n_bytes"),
                         token_count(docs.sparkSession, path)(text_of()).alias("n_tokens"))
    return counted.select(f"{ROW}.doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
