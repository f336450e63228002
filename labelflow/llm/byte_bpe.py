"""Byte-level BPE without merge loops.

The vocabulary's tokens, read as Latin-1 strings so that one character is one byte, form an Aho-Corasick automaton. A
piece is encoded from the left by its longest match; a match is taken only if it is compatible with the token before it,
that is, if the two would also come out of merging their own bytes; otherwise a shorter match is tried, and where
none fits the last token is taken back. Ends that were given up are marked, so each is tried once and the work is
linear in the piece. The outcome is exactly that of applying the merges in rank order. Compatibility of token pairs is
memoised, and so are the pieces of a text, since most repeat; both memos are bounded.

The texts run through ``mapInArrow`` in Arrow batches, one text at a time, and nothing is shuffled.

Defined cases: a null text is an empty text and has no tokens; a text of any length is encoded whole; repeated rows each get their result;
an empty table gives an empty result; text outside all matches of the pattern is left out, as the usual tokenisers do. Only
the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

MEMO_PIECES = 500_000  # pieces remembered per Python worker; longer ones than MEMO_CHARS never are
MEMO_CHARS = 48
MEMO_PAIRS = 1_000_000
BATCH_ROWS = 256


class Vocabulary:
    """Tokens by rank, and what is needed to choose among them."""

    def __init__(self, ranks: bytes):
        import ahocorasick

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.size = {rank: len(token) for rank, token in self.token.items()}
        self.shorter: dict[int, int] = {}  # rank of the longest proper prefix that is a token
        self.halves: dict[int, tuple[int, int]] = {}  # the two tokens whose merge gives this one; single bytes: itself
        self.merged: dict[tuple[int, int], int] = {}  # and the other way round
        self.compatible = lru_cache(MEMO_PAIRS)(self._compatible)
        for rank in sorted(self.token):
            self._add(rank)

    def _add(self, rank: int) -> None:
        """Tokens come in rank order, so that all that a new one can consist of is known."""
        token = self.token[rank]
        prefixes = [p for n in range(len(token) - 1, 0, -1) if (p := self.rank.get(token[:n])) is not None]
        if prefixes:
            self.shorter[rank] = prefixes[0]
        for left in prefixes:
            right = self.rank.get(token[self.size[left] :])
            if right is not None and max(left, right) < rank and self._compatible(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return
        self.halves[rank] = (rank, rank)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two.

        The tokens on both sides of the border are undone merge by merge, always the one that was made last. If the two that
        then meet at the border have a merge that ranks before the one just undone, it would have come first.
        """
        before = len(self.token) + max(left, right) + 2
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            can_left, can_right = inner_left != left, inner_right != right
            if not (can_left or can_right):
                return True
            # Of two equal ranks the merge on the left comes first, so the one on the right is undone first.
            if can_left and (left > right or not can_right):
                before, left = left, inner_left
            else:
                before, right = right + 1, inner_right

    def longest_at(self, piece: str) -> list[int]:
        """Rank of the longest token that starts at each byte. Matches come by their ends, so the last one is the longest."""
        best = [-1] * len(piece)
        for end, (rank, before) in self.automaton.iter(piece):
            best[end - before] = rank
        return best

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        text = piece.decode("latin-1")
        greedy = [rank for _, (rank, _) in self.automaton.iter_long(text)]
        if all(map(self.compatible, greedy, greedy[1:])):
            return greedy  # nothing to take back
        longest = self.longest_at(text)
        out: list[int] = []
        at, end = 0, len(piece)
        given_up = bytearray(end + 1)
        rank: int | None = longest[0] if end else None
        while at < end:
            last = out[-1] if out else None
            while rank is not None:
                stop = at + self.size[rank]
                if not given_up[stop] and (last is None or self.compatible(last, rank)):
                    break
                rank = self.shorter.get(rank)
            if rank is None:
                given_up[at] = 1
                rank = out.pop()
                at -= self.size[rank]
                rank = self.shorter.get(rank)
            else:
                out.append(rank)
                at = stop
                rank = longest[at] if at < end else None
        return out


class _Pieces(dict):
    """Encoded pieces as little-endian bytes, forgotten all at once when there are too many."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def _tables(ranks: bytes, pattern: str) -> tuple[_Pieces, Callable, list]:
    """Built once per Python worker."""
    import regex

    vocabulary = Vocabulary(ranks)
    tokens = [vocabulary.token.get(i, b"") for i in range(max(vocabulary.token) + 1)]
    matcher = regex.compile(pattern)
    pieces = (lambda text: [m[0] for m in matcher.finditer(text)]) if matcher.groups else matcher.findall
    return _Pieces(vocabulary), pieces, tokens


def encode_text(text: str, ranks: bytes, pattern: str) -> bytes:
    """Ids of a text as little-endian 32-bit integers."""
    encoded, pieces, _ = _tables(ranks, pattern)
    return b"".join(map(encoded.__getitem__, pieces(text)))


def decode_ids(ids: bytes, ranks: bytes, pattern: str) -> bytes:
    tokens = _tables(ranks, pattern)[2]
    return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver; it travels to the workers with the function (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode_table(
    df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """``(id, n_tokens, ids, ids_sha256, decoded_sha256)`` of every row; ``ids`` is an array of integers.

    ``with_ids=False`` leaves the array out where only the digests are wanted.
    """
    kind = df.schema[id_col].dataType
    slim = df.select(named(df, id_col).alias("id"), named(df, text_col).alias("text"))
    vocabulary = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                encoded = [encode_text(text or "", table, pattern) for text in part["text"].to_pylist()]
                columns = {
                    "id": part["id"],
                    "n_tokens": pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded]),
                    "decoded_sha256": pa.array(
                        [hashlib.sha256(decode_ids(ids, table, pattern)).hexdigest() for ids in encoded]
                    ),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(ids, dtype="<i4") for ids in encoded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    done = slim.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
    return done.withColumnRenamed("id", id_col)
