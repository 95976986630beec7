"""Byte-level BPE over whole corpora, with boundaries found by an associative scan instead of a regular expression.

A batch of texts is one array of code points. Each becomes a symbol (letter, number, blank, other white space, other, or an
apostrophe that begins a contraction), each symbol a function on the states of a small automaton, and a
prefix scan of their compositions gives the state at every position at once. The functions form a finite monoid, so that a
composition is one table look-up; the scan is blocked, one numpy call for a row of all blocks.
State before a character, its symbol and the next one's decide whether a piece starts there. Pieces go through a cache of
merged pairs; identifiers are put together with array operations, and byte offsets come from the tokens' lengths.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.shared import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

LETTER, NUMBER, BLANK, SPACE, OTHER, SHORT, LONG, EDGE = range(8)
# States after a character: in a run of letters, numbers or others; after a blank; after other white space; at the edge of a text or after a contraction; one or
# two letters of a contraction still to come.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, FRESH, ONE_MORE, TWO_MORE = range(8)

# Letters and numbers that Unicode 16 has beyond 15.1, as the public tokenizer classes them.
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Unicode's White_Space.
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """Symbol of every code point, apostrophes as OTHER."""
    of = np.full(0x110000, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = kind.get(unicodedata.category(chr(c))[0])
        if k is not None:
            of[c] = k
    for ranges, k in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            of[a : b + 1] = k
    of[list(WHITE)] = SPACE
    of[0x20] = BLANK
    return of


def step(symbol: int, state: int) -> int:
    if symbol == EDGE:
        return FRESH
    if state == TWO_MORE:
        return ONE_MORE
    if state == ONE_MORE:
        return FRESH
    if symbol in (SHORT, LONG):
        return IN_OTHERS if state in (IN_OTHERS, AFTER_BLANK) else (ONE_MORE if symbol == SHORT else TWO_MORE)
    return (IN_LETTERS, IN_NUMBERS, AFTER_BLANK, AFTER_SPACE, IN_OTHERS)[symbol]


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table [first, then], value of each function at each state); function 0 is the identity."""
    members = [tuple(range(8))]
    number = {members[0]: 0}
    generators = []
    for symbol in range(8):
        f = tuple(step(symbol, s) for s in range(8))
        if f not in number:
            number[f] = len(members)
            members.append(f)
        generators.append(number[f])
    i = 0
    while i < len(members):
        for g in generators:
            h = tuple(members[g][s] for s in members[i])
            if h not in number:
                number[h] = len(members)
                members.append(h)
        i += 1
    table = np.array(members, np.uint8)
    together = np.array([[number[tuple(b[s] for s in a)] for b in members] for a in members], np.uint16)
    return np.array(generators, np.uint16), together, table


def prefix(f: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the functions numbered in ``f``."""
    n = len(f)
    if n <= 64:
        out = np.empty_like(f)
        acc = 0
        for i in range(n):
            acc = together[acc, f[i]]
            out[i] = acc
        return out
    rows = max(2, int(np.sqrt(n / 4)))
    columns = -(-n // rows)
    grid = np.zeros(rows * columns, f.dtype)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(columns, rows).T)
    for i in range(1, rows):
        grid[i] = together[grid[i - 1], grid[i]]
    before = np.zeros(columns, f.dtype)
    before[1:] = prefix(grid[-1], together)[:-1]
    return together[before[None, :], grid].T.reshape(-1)[:n]


def symbols(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sym = classes()[codes]
    at = np.flatnonzero(codes == 0x27)
    if len(at):
        pad = np.append(codes, np.zeros(3, codes.dtype))
        a, b = pad[at + 1], pad[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[at[one]] = SHORT
        sym[at[two]] = LONG
    sym[edges] = EDGE
    return sym


#: Whether a piece starts at a character, by the state before it and its symbol.
STARTS = np.array(
    [[{LETTER: s not in (IN_LETTERS, AFTER_BLANK, ONE_MORE, TWO_MORE), NUMBER: s not in (IN_NUMBERS, AFTER_BLANK), BLANK: s not in (AFTER_BLANK, AFTER_SPACE), SPACE: s not in (AFTER_BLANK, AFTER_SPACE), EDGE: True}.get(x, s not in (IN_OTHERS, AFTER_BLANK)) for x in range(8)] for s in range(8)]
)


def boundaries(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions at which a piece or an edge starts. ``edges``: positions of the characters that separate texts."""
    generators, together, table = monoid()
    sym = symbols(codes, edges)
    state = table[:, FRESH][prefix(generators[sym], together)]
    before = np.empty_like(state)
    before[0], before[1:] = FRESH, state[:-1]
    starts = STARTS[before, sym]
    white = (sym == BLANK) | (sym == SPACE)
    # the last of several white characters goes by itself, unless the text ends there
    starts[:-1] |= white[:-1] & ~white[1:] & (sym[1:] != EDGE)
    return np.flatnonzero(starts)


class Encoder:
    """Byte-pair encoder over a vocabulary of ranks (base64 token and rank on each line)."""

    LIMIT = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.tokens = [b""] * len(self.lengths)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
            self.tokens[rank] = token
        self.forget()

    def forget(self) -> None:
        self.cached: dict[str, int] = {}
        self.pool: list[int] = []
        self.pool_at: list[int] = [0]

    def merge(self, piece: bytes) -> list[int]:
        """The lowest-ranked neighbouring pair is merged, the leftmost of equals, until none is in the vocabulary; n log n for long pieces too."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        part = [piece[i : i + 1] for i in range(len(piece))]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or len(part[i]) != a or len(part[j]) != b or not a:
                continue
            part[i] += part[j]
            part[j] = b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if (k := after[i]) < n and (r := self.ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]), len(part[k])))
            if (k := before[i]) >= 0 and (r := self.ranks.get(part[k] + part[i])) is not None:
                heapq.heappush(heap, (r, k, len(part[k]), len(part[i])))
        return [self.ranks[p] for p in part if p]

    def number(self, piece: str) -> int:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        self.pool += ids
        self.pool_at.append(len(self.pool))
        if len(piece) > 64:  # long pieces hardly repeat
            return len(self.pool_at) - 2
        self.cached[piece] = at = len(self.pool_at) - 2
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of all texts, where each text's begin, with the end)."""
        if len(self.cached) > self.LIMIT or len(self.pool) > 8 * self.LIMIT:
            self.forget()
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([len(t) + 1 for t in texts]) - 1
        at = boundaries(codes, edges)
        ends = np.append(at[1:], len(codes))
        is_edge = np.zeros(len(codes), bool)
        is_edge[edges] = True
        real = ~is_edge[at]
        at, ends = at[real], ends[real]
        get, number = self.cached.get, self.number
        found = [get(p) if p in self.cached else number(p) for p in map(joined.__getitem__, map(slice, at.tolist(), ends.tolist()))]
        pool, pool_at = np.array(self.pool, np.int32), np.array(self.pool_at, np.int64)
        which = np.array(found, np.int64)
        begin, size = pool_at[which], pool_at[which + 1] - pool_at[which]
        total = np.cumsum(size)
        ids = pool[np.repeat(begin - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        pieces = np.searchsorted(at, np.append(0, edges))
        return ids, np.append(0, total)[pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(located(path))


def located(path: str) -> str:
    """Where a vocabulary lies; on workers without the file, the copy that went along with the plan."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def ship_with(spark: SparkSession, vocabulary: str) -> None:
    """Sends the package and the vocabulary to the workers, each once for a Spark context."""
    ship(spark)
    sent = spark.sparkContext.__dict__.setdefault("_tideline_vocabularies", set())
    if vocabulary not in sent:
        spark.sparkContext.addFile(vocabulary)
        sent.add(vocabulary)


def portions(texts: list[str], characters: int = 1_000_000) -> Iterator[list[str]]:
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= characters:
            yield some
            some, n = [], 0
    if some:
        yield some


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    enc = encoder(path)
    ids, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    done = 0
    for some in portions(texts):
        i, a = enc.encode(some)
        ids.append(i)
        at.append(a[1:] + done)
        done += len(i)
    return np.concatenate(ids), np.concatenate(at)


def _mapped(df: DataFrame, vocabulary: str, id_column: str, text_column: str, extra: str, make):
    kind = df.schema[id_column].dataType.simpleString()
    schema = T._parse_datatype_string(f"`{id_column}` {kind}, {extra}")

    def run(batches):
        for batch in batches:
            yield make(batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()])

    ship_with(df.sparkSession, vocabulary)
    return df.select(F.col(id_column), F.col(text_column).cast("string").alias("_text")).mapInArrow(run, schema)


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", offsets: bool = True) -> DataFrame:
    """id, ids (array<int>), and with ``offsets`` the byte at which each token starts in the UTF-8 text.

    One row per row of ``documents``, repeated rows and null identifiers included. A null and an empty text have the empty list. Strings that look like control words are
    ordinary text. Texts of any length are whole; no shuffle. An empty table gives no rows.
    """

    def make(keys, texts):
        ids, at = encode_texts(texts, vocabulary)
        columns = [keys, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
        if offsets:
            end = np.append(0, np.cumsum(encoder(vocabulary).lengths[ids]))
            start = end[:-1] - np.repeat(end[at[:-1]], np.diff(at))
            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(start, pa.int32())))
        return pa.RecordBatch.from_arrays(columns, [id_column, "ids", "offsets"][: len(columns)])

    return _mapped(documents, vocabulary, id_column, text_column, "ids array<int>" + (", offsets array<int>" if offsets else ""), make)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens: the length of encoded()'s ids; 0 for null and empty texts."""

    def make(keys, texts):
        _, at = encode_texts(texts, vocabulary)
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at), pa.int64())], [id_column, "n_tokens"])

    return _mapped(documents, vocabulary, id_column, text_column, "n_tokens long", make)


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """id, text: the text that the ids stand for; empty for a null or empty list. Bytes that are no UTF-8 become the replacement character."""
    schema = T._parse_datatype_string(f"`{id_column}` {ids.schema[id_column].dataType.simpleString()}, text string")

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [enc.decode(i or []).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    ship_with(ids.sparkSession, vocabulary)
    return ids.select(id_column, "ids").mapInArrow(run, schema)
