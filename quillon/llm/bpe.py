"""Byte-level BPE ids of whole texts, each distinct word encoded once.

The pattern that precedes the merges never joins characters over a single space
between two other characters: the space always leads the next piece. So a text
is cut at its spaces, distinct words are encoded together, and the ids of a text
are gathered from those of its words. Texts with white space next to a space, or
with an added token, are encoded whole.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import tiktoken

#: Ranks of the vocabulary of byte_bpe_50k.json.
RANKS = "byte_bpe_50k.tiktoken"
#: The added token of byte_bpe_50k.json and its id. Texts are cut at it before they are split into pieces.
ADDED, ADDED_ID = "<|endoftext|>", 50256


class _Index(dict):
    """Numbers keys as they are first asked for."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


@functools.lru_cache(maxsize=4)
def loaded(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a file of ranks, and how many bytes each id has; read once in a process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, number in ranks.items():
        bytes_of[number] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bytes_of


def encoded(bpe: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text, added tokens apart, without a list of them where the text is well formed."""
    try:
        return bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    except UnicodeEncodeError:
        return np.array(bpe.encode_ordinary(text), np.int32)


def cut(bpe: tiktoken.Encoding, bytes_of: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that a space leads, one word after the other, and how many each has. No word may be empty,
    hold a space or have white space at an end."""
    text = "".join([" " + w for w in words])
    ids = encoded(bpe, text)
    # no word has a space, so the words end where the spaces before the next ones are
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) == 32)
    ends = np.cumsum(bytes_of[ids])
    cuts = np.append(0, np.searchsorted(ends, np.append(spaces[1:], ends[-1]), side="left") + 1)
    return ids, np.diff(cuts)


class Encoder:
    """Encodes lists of texts; keeps at most about ``most`` words between calls."""

    def __init__(self, path: str | None = None, most: int = 250_000) -> None:
        self.bpe, self.bytes_of = loaded(path or public_tokenizers.path(RANKS))
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.words = _Index()
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)
        self.names: list[str] = []

    def whole(self, text: str) -> list[int]:
        """Ids of one text, without the words that are known."""
        first, *rest = text.split(ADDED)
        ids = self.bpe.encode_ordinary(first)
        for part in rest:
            ids.append(ADDED_ID)
            ids += self.bpe.encode_ordinary(part)
        return ids

    def _learn(self) -> None:
        """Encode the words that were met first just now."""
        new, self.words.new = self.words.new, []
        if not new:
            return
        self.names += [w if type(w) is str else w[0] for w in new]
        added = ADDED in " ".join(self.names[-len(new) :])
        # what the pattern would join to its neighbours: nothing, white space at an end, an added token
        odd = np.array([(type(w) is str and (not w or len(w.strip()) < len(w))) or (added and ADDED in (w if type(w) is str else w[0])) for w in new])
        tuples = np.fromiter((type(w) is tuple for w in new), bool, len(new))
        plain = np.flatnonzero(~odd & ~tuples)
        start, length = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        size = len(self.flat)
        parts = [self.flat]
        if len(plain):
            ids, sizes = cut(self.bpe, self.bytes_of, [new[k] for k in plain.tolist()])
            start[plain], length[plain] = size + np.cumsum(sizes) - sizes, sizes
            parts.append(ids)
            size += len(ids)
        for k in np.flatnonzero(tuples).tolist():
            ids = np.array(self.bpe.encode_ordinary(new[k][0]), np.int32)
            start[k], length[k] = size, len(ids)
            parts.append(ids)
            size += len(ids)
        self.start = np.concatenate([self.start, start])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate(parts)
        self.odd = np.concatenate([self.odd, odd])

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, one text after the other, and how many each
        text has. The first word, which no space leads, is numbered as a 1-tuple."""
        if len(self.words) > self.most:
            self._clear()
        of = self.words.__getitem__
        numbers: list[int] = []
        counts = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            first, *rest = text.split(" ")
            numbers.append(of((first,)))
            numbers.extend(map(of, rest))
            counts[k] = len(rest) + 1
        self._learn()
        return np.array(numbers, np.int64), counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        numbers, counts = self.number(texts)
        return self.gather(texts, numbers, counts)

    def gather(self, texts: list[str], numbers: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts that ``number`` gave these numbers."""
        length = self.length[numbers]
        total = int(length.sum())
        at = np.repeat(self.start[numbers] - (np.cumsum(length) - length), length) + np.arange(total)
        ids = self.flat[at]
        ends = np.cumsum(counts)
        cuts = np.cumsum(length)[ends - 1]
        found = np.split(ids, cuts[:-1])
        for k in np.flatnonzero(np.add.reduceat(self.odd[numbers], ends - counts)).tolist():
            found[k] = np.array(self.whole(texts[k]), np.int32)
        return found

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        numbers, counts = self.number(texts)
        first = np.cumsum(counts) - counts
        found = np.add.reduceat(self.length[numbers], first)
        for k in np.flatnonzero(np.add.reduceat(self.odd[numbers], first)).tolist():
            found[k] = len(self.whole(texts[k]))
        return found


def slices(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items with about ``most`` characters each, at least one item."""
    found, first, size = [], 0, 0
    for k, n in enumerate(lengths):
        if k > first and size + n > most:
            found.append((first, k))
            first, size = k, 0
        size += n
    if first < len(lengths):
        found.append((first, len(lengths)))
    return found
