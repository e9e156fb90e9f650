"""Byte-level BPE by longest-match backtracking over the token trie of pyahocorasick.

Token bytes are mapped to Latin-1 characters so that the trie works on str; only its longest-prefix query is used, so no failure links are built. An encoding is grown from the longest
token at each place; a token may follow another only if merging their joint bytes would leave exactly that border
(adjacent-token compatibility, memoised). Where no token fits, the last one is shortened to its longest proper prefix
token and the search goes on. Each place of a piece is given up at most once, so the time is linear in the piece.

Edge cases: null and empty texts give no tokens (n_tokens 0, ids "" and decoded bytes b""); very long pieces take the
same path; repeated rows are encoded independently; extra columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tracewell.llm.common import map_texts

#: Entries of a generation of a worker's memo of pieces (there are two), and of its memo of token pairs.
MEMO_PIECES, MEMO_PAIRS = 160_000, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encodes and decodes with a table of ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.rank_of = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.widest = max(map(len, ranks), default=1)
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), rank)
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self._derive()

    def _derive(self) -> None:
        """For each token in order of rank: its longest proper prefix token and the two tokens it is merged from."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            for cut in range(len(token) - 1, 0, -1):
                if (head := self.ranks.get(token[:cut])) is not None:
                    self.shorter[rank] = head
                    break
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._border_holds(a, b, rank):
                    self.halves[rank] = (a, b)
                    self.joined[a, b] = rank
                    break

    def _border_holds(self, left: int, right: int, below: int = 1 << 62) -> bool:
        """True if merging the bytes of both tokens with ranks under `below` leaves them apart.

        Undoes the merges along the border, latest first: a pair of neighbours that meets there and has a rank under
        that of the merges still to come would have been merged across the border.
        """
        limit = below
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                return False
            # the later of the two merges is undone; on equal ranks the left one was made first
            if left > right:
                limit, parts = left, self.halves.get(left)
                if parts is None:
                    if (parts := self.halves.get(right)) is None:
                        return True
                    limit, right = right + 1, parts[0]
                else:
                    left = parts[1]
            else:
                limit, parts = right + 1, self.halves.get(right)
                if parts is None:
                    if (parts := self.halves.get(left)) is None:
                        return True
                    limit, left = left, parts[1]
                else:
                    right = parts[0]

    def _compatible(self, left: int, right: int) -> bool:
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            got = self.fits[left, right] = self._border_holds(left, right)
        return got

    def _longest(self, text: str, at: int) -> int:
        """The longest token that begins at a place."""
        head = text[at : at + self.widest]
        n = self.trie.longest_prefix(head)
        rank = self.rank_of.get(head[:n])
        while rank is None:
            n -= 1
            rank = self.rank_of.get(head[:n])
        return rank

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, as exact merges give them. A piece that is a token itself is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text, end = piece.decode("latin-1"), len(piece)
        size_of, shorter, fits, longest = self.size_of, self.shorter, self.fits, self._longest
        out: list[int] = []
        dead = bytearray(end + 1)
        at, token = 0, longest(text, 0)
        while at < end:
            stop = at + size_of[token]
            if not dead[stop]:
                if not out or (known := fits.get((out[-1], token))) or known is None and self._compatible(out[-1], token):
                    out.append(token)
                    at = stop
                    if at < end:
                        token = longest(text, at)
                    continue
            token = shorter.get(token)
            while token is None:  # nothing fits here: give the place up and shorten the token before it
                dead[at] = 1
                last = out.pop()
                at -= size_of[last]
                token = shorter.get(last)
        return out

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by commas."""
        memo, out = self.pieces, []
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO_PIECES:  # pieces that stay in use move on from the older generation
                    self.older, self.pieces = memo, {}
                    memo = self.pieces
                ids = self.older.get(piece)
                if ids is None:
                    ids = ",".join(map(str, self.encode_piece(piece.encode())))
                if len(piece) <= 64:
                    memo[piece] = ids
            out.append(ids)
        return ",".join(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(load_ranks(path), pattern)


def digest_documents(
    df: DataFrame, path: str, pattern: str, text: str = "text",
    names: tuple[str, str, str] = ("n_tokens", "ids_sha256", "decoded_sha256"), with_ids: bool = False,
) -> DataFrame:
    """Encodes and decodes each text; adds the number of tokens and digests of the ids and of the decoded bytes. with_ids adds the ids (token_ids)."""

    def make():
        own = codec(path, pattern)
        shown = {str(k): v for k, v in own.bytes_of.items()}

        def run(texts):
            counts, ids, back, own_ids = [], [], [], []
            for t in texts:
                joined = own.encode_joined(t or "")
                tokens = joined.split(",") if joined else []
                counts.append(len(tokens))
                if with_ids:
                    own_ids.append([int(x) for x in tokens])
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(shown.__getitem__, tokens))).hexdigest())
            return (counts, ids, back, own_ids) if with_ids else (counts, ids, back)

        return run

    return map_texts(df, text, [*zip(names, ("long", "string", "string")), *([("token_ids", "array<int>")] if with_ids else [])], make)
