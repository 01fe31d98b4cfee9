"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The encoding of a string is the one path of tokens from the vocabulary in which every two neighbours are
stable: merging their bytes by rank gives these two tokens back. That makes encoding a transduction: a
hypothesis is (last token, place in the trie of tokens), and a determinised state is the set of hypotheses that
the bytes so far allow, without their outputs, so that states recur in other words. A transition names for each hypothesis of the next state the one
it came from and the token it completed. Since every prefix has one encoding only, hypotheses differ in no token that
ended further back than the longest token is long: what lies before is emitted, and the rest when the string ends.
States and transitions are made when first needed and kept for the task.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import process_cache, table, without

#: Bounds of the tables a task fills; a full table is started anew, which costs time only.
MAX_STATES = 250_000
MAX_WORDS = 300_000
#: Rows that are coded and passed on at once.
ROWS = 500
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        # trie of the tokens that encode to themselves: children and token (or None) by node, the root first
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.parts: dict[int, list[bytes]] = {}
        self.edges_of: dict[int, tuple[list, list]] = {}
        for b, i in ranks.items():
            parts = self.last_merge(b)
            if len(parts) == 2:
                self.parts[i] = parts
            if len(parts) <= 2:
                node = 0
                for byte in b:
                    if byte not in self.kids[node]:
                        self.kids[node][byte] = len(self.kids)
                        self.kids.append({})
                        self.ends.append(None)
                    node = self.kids[node][byte]
                self.ends[node] = i
        self.bits = len(self.kids).bit_length()
        self.stable_pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """A state is (transitions by byte, hypotheses); a transition is (next state, where each hypothesis comes from)."""
        self.states: dict[tuple, tuple] = {}
        self.origins: dict[tuple, tuple] = {}
        gc.collect()  # states refer to each other
        self.stable_pairs.clear()
        self.start = self.state((0,))

    def last_merge(self, piece: bytes) -> list[bytes]:
        """Plain merging by rank down to two parts, or as far as it goes."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list, list]:
        """What stands at the left and the right edge while the token is merged: (bytes, rank of what it becomes)."""
        known = self.edges_of.get(token)
        if known is None:
            piece = self.token[token]
            parts, left, right = self.parts.get(token), [], []
            if parts:
                left = self.edges(self.ranks[parts[0]])[0][:-1] + [(parts[0], token)]
                right = self.edges(self.ranks[parts[1]])[1][:-1] + [(parts[1], token)]
            known = self.edges_of[token] = ([*left, (piece, NEVER)], [*right, (piece, NEVER)])
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether no merge across the border of the two tokens comes before those inside them.

        Merges are applied in order of rank, the leftmost first among equals.
        """
        left, right, i, j = self.edges(a)[1], self.edges(b)[0], 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < x_until and rank <= y_until and rank != NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            i, j = (i + 1, j) if x_until <= y_until else (i, j + 1)

    def follows(self, last: int, token: int) -> bool:
        """stable() of the token numbered last - 1 and `token`, to be kept; nothing (0) comes before a string's first token."""
        if len(self.stable_pairs) >= MAX_STATES:
            self.stable_pairs.clear()
        found = self.stable_pairs[last << 32 | token] = not last or self.stable(last - 1, token)
        return found

    def state(self, hypotheses: tuple) -> tuple:
        """hypotheses: last token plus 1 (0 at the start) and trie node, as one number, those whose unfinished token began first coming first."""
        known = self.states.get(hypotheses)
        if known is None:
            known = self.states[hypotheses] = ({}, hypotheses)
        return known

    def step(self, state: tuple, byte: int) -> tuple:
        hypotheses, back, ended = [], [], None
        kids, ends, bits, pairs = self.kids, self.ends, self.bits, self.stable_pairs
        mask = (1 << bits) - 1
        for k, h in enumerate(state[1]):
            child = kids[h & mask].get(byte)
            if child is None:
                continue
            if kids[child]:
                hypotheses.append(h & ~mask | child)
                back.append((k, None))
            token = ends[child]
            if token is not None and ended is None:
                last = h >> bits
                stable = pairs.get(last << 32 | token)
                if self.follows(last, token) if stable is None else stable:
                    ended = k, token  # at most one: a prefix has one encoding
        if ended:
            hypotheses.append((ended[1] + 1) << bits)
            back.append(ended)
        origin = tuple(back)
        move = state[0][byte] = (self.state(tuple(hypotheses)), self.origins.setdefault(origin, origin))
        return move

    @staticmethod
    def trace(path: list, k: int) -> list[int]:
        """Tokens completed on the way to hypothesis k at the end of the path."""
        out = []
        for back in path[::-1]:
            k, token = back[k]
            if token is not None:
                out.append(token)
        return out[::-1]

    def settled(self, path: list, n: int) -> tuple[list[int], list]:
        """Tokens that all n hypotheses have in common so far, and the path after the last of them."""
        at = list(range(n))
        same = None
        for i in range(len(path) - 1, -1, -1):
            came = {path[i][k] for k in at}
            if len(came) == 1 and next(iter(came))[1] is not None:
                same = i
                break
            at = list({k for k, _ in came})
        if same is None:
            return [], path
        k, token = path[same][at[0]]
        rest = path[same + 1 :]
        if rest:  # what remains starts with the one hypothesis after that token
            rest = [[(0, t) if k == at[0] else (-1, t) for k, t in rest[0]], *rest[1:]]
        return [*self.trace(path[:same], k), token], rest

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token stays one
            return [whole]
        if len(self.states) >= MAX_STATES:
            self.reset()
        out: list[int] = []
        path: list = []
        state = self.start
        for at in range(0, len(piece), 4 * self.longest):
            if path:
                some, path = self.settled(path, len(state[1]))
                out += some
            for byte in piece[at : at + 4 * self.longest]:
                state, back = state[0].get(byte) or self.step(state, byte)
                path.append(back)
        return out + self.trace(path, len(state[1]) - 1)


class Utf8Stream:
    """Bytes in any portions, text out: an incremental UTF-8 state machine.

    The state is the unfinished character at the end of what was fed: at most three bytes. Bytes that
    can't be part of UTF-8 read as U+FFFD.
    """

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many last bytes begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF5 else 1
                if need <= back:
                    return 0
                if back > 1:  # the second byte decides about overlong forms, surrogates and the upper end
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                    if not low <= data[1 - back or None :][0] <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        back = self.unfinished(data)
        self.rest = data[len(data) - back :]
        return data[: len(data) - back].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Encoder and decoder of whole texts; keeps the encodings of the pieces it has met."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 1 + max(self.transducer.token)
        self.bytes_of = [self.transducer.token.get(i, b"") for i in range(self.size)]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.size)]

    def forget(self) -> None:
        """Frees the tables a task filled, so that a waiting process holds little beside the ranks."""
        self.words, self.older = {}, {}
        self.transducer.reset()

    def piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = b"".join([self.id_bytes[i] for i in self.transducer.encode(piece.encode("utf-8"))])
        if len(self.words) >= MAX_WORDS:
            self.older, self.words = self.words, {}
        if len(piece) <= 64:
            self.words[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.words
        return b"".join([words.get(x) or self.piece(x) for x in self.split(text)])

    def decode(self, ids: np.ndarray, portion: int = 65536) -> Iterator[str]:
        """Text of ids, in portions; a character may be split between tokens and portions."""
        stream, of = Utf8Stream(), self.bytes_of
        for at in range(0, len(ids), portion):
            yield stream.feed(b"".join([of[i] for i in ids[at : at + portion].tolist()]))
        yield stream.close()


def codec(path: str, pattern: str) -> Codec:
    return process_cache(f"bpe {path} {pattern}", lambda: Codec(path, pattern))


SCHEMA = "n_tokens long, ids binary, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenize(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Columns `keep`, then n_tokens, ids (u32 little-endian) and decoded text; or the digests of the two.

    `path` is the rank file, found on every executor. A null or empty text has no tokens. Rows are handled
    alone, so ties and repeated rows need no rule; an empty table gives an empty result; texts of any length are coded whole.
    Kept columns with a result's name give way.
    """
    keep = without(keep if keep is not None else ["doc_id"], DIGESTS if digests else SCHEMA)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    out = StructType(rows.drop("_text").schema.fields + StructType.fromDDL(DIGESTS if digests else SCHEMA).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        gc.disable()  # tens of thousands of live states make its passes the largest cost; reset() collects
        try:
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                n, first, second = [], [], []
                for text in batch.column(batch.num_columns - 1):
                    ids = coder.encode(text.as_py())
                    n.append(len(ids) // 4)
                    decoded = coder.decode(np.frombuffer(ids, "<u4"))
                    if digests:
                        read = hashlib.sha256()
                        for part in decoded:
                            read.update(part.encode("utf-8"))
                        first.append(hashlib.sha256(ids).hexdigest())
                        second.append(read.hexdigest())
                    else:
                        first.append(ids)
                        second.append("".join(decoded))
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.binary()), pa.array(second, pa.string())], names=out.names)
        finally:
            coder.forget()
            gc.enable()

    return rows.mapInArrow(run, out)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
