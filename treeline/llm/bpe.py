"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The ids are exactly those of merging pairs by rank within each piece of the split pattern.
A sequence of tokens is that encoding if and only if every two neighbours are compatible,
that is, if encoding the two tokens' bytes together gives these two tokens again. So no
merge is ever carried out: at each place the longest token that an Aho-Corasick automaton
found there is tried, then the next shorter one that begins it; a place from which nothing
fits is marked and never tried again, which keeps the time linear in the text.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Pieces and pairs kept by a worker; when full they are forgotten, which costs time only.
MOST_PIECES = 300_000
MOST_PAIRS = 1_000_000
#: Longer pieces are rarely met again and aren't kept.
LONGEST_KEPT = 48
NEVER = 1 << 60

# Code points that are letters or numbers only since Unicode 17 and later. The libraries
# for which the public tokenizers are made know Unicode 16, where these are unassigned.
NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 "
    "\U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 "
    "\U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 "
    "\U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de "
    "\U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff "
    "\U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)
_NEWER = re.compile(f"[{NEWER.replace(' ', '')}]")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """The place of a public tokenizer's file; ``folder`` overrides that of the installed package."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id (the id is the rank) and the pair each longer token is merged from. Picklable, a few MB."""

    tokens: list[bytes]
    halves: list[tuple[int, int] | None]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str | None = None) -> Vocabulary:
        """From a file of ranks: a token in base 64 and its rank on each line."""
        with open(path, "rb") as f:
            pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
        if [i for i, _ in pairs] != list(range(len(pairs))):
            raise ValueError(f"ranks of {path} aren't 0, 1, 2...")
        tokens = [t for _, t in pairs]
        single = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        merged: dict[tuple[int, int], int] = {}
        halves: list[tuple[int, int] | None] = []
        for i, t in enumerate(tokens):
            parts = [single[t[k : k + 1]] for k in range(len(t))]
            while len(parts) > 2:
                rank, at = min(((merged.get((a, b), NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [rank]
            if len(parts) == 2:
                merged.setdefault((parts[0], parts[1]), i)
            halves.append((parts[0], parts[1]) if len(parts) == 2 else None)
        return cls(tokens, halves, pattern or split_pattern())


class Encoder:
    """Encodes texts with a :class:`Vocabulary`; one for each worker process."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick
        import regex

        tokens, halves = vocabulary.tokens, vocabulary.halves
        self.length = [len(t) for t in tokens]
        self.split = regex.compile(vocabulary.pattern).findall
        self.find = regex.compile(vocabulary.pattern).finditer
        self.merged = {pair: i for i, pair in enumerate(halves) if pair}
        # a token's last (first) parts from the single byte up to the token itself
        self.ends: list[tuple[int, ...]] = []
        self.begins: list[tuple[int, ...]] = []
        for i, pair in enumerate(halves):
            self.ends.append((*self.ends[pair[1]], i) if pair else (i,))
            self.begins.append((*self.begins[pair[0]], i) if pair else (i,))
        usable = [i for i, pair in enumerate(halves) if pair or self.length[i] == 1]
        by_bytes = {tokens[i]: i for i in usable}
        self.shorter = [-1] * len(tokens)
        self.matches = ahocorasick.Automaton()
        for i in usable:
            t = tokens[i]
            self.shorter[i] = next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1)
            self.matches.add_word(t.decode("latin-1"), (i, len(t)))
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens ``a`` and ``b`` together are encoded as these two.

        The merges inside both happen from the border outwards; at each moment two parts face
        each other across the border. They stay apart unless their own merge would come before
        the merge that takes in the left one, and no later than that which takes in the right one.
        """
        left, right = self.ends[a], self.begins[b]
        i = j = 0
        while True:
            rank = self.merged.get((left[i], right[j]), NEVER)
            up_left = left[i + 1] if i + 1 < len(left) else NEVER
            up_right = right[j + 1] if j + 1 < len(right) else NEVER
            if rank < up_left and rank <= up_right and rank != NEVER:
                return False
            if up_left == up_right == NEVER:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        n, length, shorter, pairs = len(piece), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, (token, size) in self.matches.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends rise, so the last token noted for a place is its longest
        if longest and length[longest[0]] == n:
            return [longest[0]]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            before = out[-1] if out else -1
            while token >= 0:
                if not dead[at + length[token]]:
                    if before < 0:
                        break
                    key = before << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= MOST_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers one after the other."""
        if not text.isascii() and _NEWER.search(text):  # split as if they were unassigned
            return b"".join(self.pieces[text[m.start() : m.end()]] for m in self.find(_NEWER.sub("\uffff", text)))
        if len(text) > 1_000_000:  # no list of all pieces of a huge text
            return b"".join(self.pieces[m.group()] for m in self.find(text))
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist() if text else []

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4 if text else 0


class _Pieces(dict):
    """Encodings of pieces met before."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encoder.encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@dataclass
class Decoder:
    """All tokens' bytes one after the other, with the offset of each id."""

    vocabulary: Vocabulary
    blob: np.ndarray = field(init=False)
    offsets: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.blob = np.frombuffer(b"".join(self.vocabulary.tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.vocabulary.tokens])]).astype(np.int64)

    def decode_bytes(self, ids: Iterable[int] | np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.offsets) - 1:
            raise ValueError("an id isn't of this vocabulary")
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: Iterable[int] | None) -> str | None:
        """The text of ids; null for null. Bytes that aren't UTF-8 become replacement characters."""
        return None if ids is None else self.decode_bytes(ids).decode("utf-8", "replace")
