"""Byte-level BPE from a tokenizer file, with exact encoding of long texts by tree concatenation.

The vocabulary file is the ``tokenizers`` JSON; its merges are ranked by token id, so the same
tokens come out of a faster encoder built from that file. Only byte-level BPE files without a
normaliser are accepted.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters of a leaf of the tree; texts up to this length are one leaf.
LEAF = 65_536
#: How far from the middle a cut between two pieces may lie.
RADIUS = 4_096

# Fixed value: the splitting pattern of byte-level BPE vocabularies of this family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A place that every scan of the pattern stops at: white space after something else.
GAP = regex.compile(r"(?<=\S)(?=\s)")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


@dataclass
class Codec:
    fast: tiktoken.Encoding
    path: str
    pieces: regex.Pattern
    special: dict[str, int]
    special_pattern: regex.Pattern | None
    table: list[bytes]
    widths: np.ndarray
    letters: list[str]

    def sections(self, text: str) -> list[str | int]:
        """Ordinary stretches of a text and the ids of special tokens written out in it."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return [text] if text else []
        out: list[str | int] = []
        for part in self.special_pattern.split(text):
            if part:
                out.append(self.special.get(part, part))
        return out

    def encode_leaf(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        if len(text) <= LEAF and not any(s in text for s in self.special):
            return np.array(self.encode_leaf(text), dtype="<u4")
        leaves = [(leaf, self.leaf_ids(leaf)) for leaf in self.split(text)]
        return self.concatenate(leaves)

    def leaf_ids(self, leaf: Leaf) -> np.ndarray:
        if leaf.token >= 0:
            return np.array([leaf.token], dtype="<u4")
        return np.array(self.encode_leaf(leaf.text), dtype="<u4")

    def split(self, text: str) -> list[Leaf]:
        """Halve a text again and again until every part fits a leaf."""
        leaves: list[Leaf] = []
        offset = 0
        for section in self.sections(text):
            if isinstance(section, int):
                leaves.append(Leaf("", section, 0, False, 0, 0))
                offset += len(self.table[section])
                continue
            offset = self._halve(section, offset, leaves)
        return leaves

    def _halve(self, text: str, offset: int, leaves: list[Leaf]) -> int:
        cuts: list[tuple[int, int, bool, int, int]] = []  # place, depth, inside, piece start, end
        bounds: np.ndarray | None = None
        todo = [(0, len(text), 1)]
        while todo:
            lo, hi, depth = todo.pop()
            if hi - lo <= LEAF:
                continue
            mid = (lo + hi) // 2
            found = GAP.search(text, mid, min(hi, mid + RADIUS))
            if found and found.start() > lo:
                cut = (found.start(), depth, False, 0, 0)
            else:
                if bounds is None:  # no gap near: look at the pieces of the pattern, once
                    bounds = np.array([m.start() for m in self.pieces.finditer(text)] + [len(text)])
                k = int(np.searchsorted(bounds, mid, side="right"))
                start, end = int(bounds[k - 1]), int(bounds[k])
                near = start if mid - start <= end - mid else end
                if lo < near < hi and abs(near - mid) <= RADIUS:
                    cut = (near, depth, False, 0, 0)
                else:  # one long piece: cut it in its middle
                    cut = (mid, depth, True, start, end)
            cuts.append(cut)
            todo += [(lo, cut[0], depth + 1), (cut[0], hi, depth + 1)]
        cuts.sort()
        places = [0, *(c[0] for c in cuts), len(text)]
        spans = [text[a:b] for a, b in zip(places, places[1:], strict=False)]
        at = np.cumsum([0] + [len(s.encode()) for s in spans]) + offset
        for i, part in enumerate(spans):
            if i == 0 or not cuts[i - 1][2]:
                leaves.append(Leaf(part, -1, cuts[i - 1][1] if i else 0, False, 0, 0))
                continue
            place, depth, _, start, end = cuts[i - 1]
            left = int(at[i]) - len(text[start:place].encode())
            right = int(at[i]) + len(text[place:end].encode())
            leaves.append(Leaf(part, -1, depth, True, left, right))
        return int(at[-1])

    def concatenate(self, leaves: list[tuple[Leaf, np.ndarray]]) -> np.ndarray:
        """Join encoded leaves: plain borders by appending, cuts inside pieces as a tree."""
        done: list[np.ndarray] = []
        chain: list[tuple[Leaf, Part]] = []
        at = 0
        for leaf, ids in leaves:
            part = Part(ids, at + np.concatenate([[0], np.cumsum(self.widths[ids])]))
            at = int(part.ends[-1])
            # a cut of smaller depth encloses deeper ones: those on its left are joined first
            while len(chain) > 1 and (not leaf.inside or chain[-1][0].depth > leaf.depth):
                self._fold(chain)
            if chain and not leaf.inside:
                done.append(chain.pop()[1].ids)
            chain.append((leaf, part))
        while len(chain) > 1:
            self._fold(chain)
        done += [part.ids for _, part in chain]
        return np.concatenate(done) if done else np.zeros(0, dtype="<u4")

    def _fold(self, chain: list[tuple[Leaf, Part]]) -> None:
        cut, right = chain.pop()
        before, left = chain.pop()
        chain.append((before, self.join(left, right, cut)))

    def join(self, left: Part, right: Part, cut: Leaf) -> Part:
        """Join two encoded neighbours at a cut inside a piece.

        A window around the cut is encoded anew and grows until its first token is the one the
        left side has there and its last the one the right side has there (or it reaches the
        piece's ends): then all neighbouring tokens also stand side by side in a valid encoding,
        which makes the whole the one valid encoding.
        """
        k = 8
        start = int(np.searchsorted(left.ends, cut.left))
        stop = int(np.searchsorted(right.ends, cut.right, side="right")) - 1
        while True:
            i, j = max(start, len(left.ids) - k), min(stop, k)
            window = np.concatenate([left.ids[i:], right.ids[:j]])
            new = self.encode_piece(b"".join(self.table[t] for t in window))
            left_agrees = i == start or new[0] == left.ids[i]
            right_agrees = j == stop or new[-1] == right.ids[j - 1]
            if left_agrees and right_agrees:
                break
            k *= 2
        ids = np.concatenate([left.ids[:i], new, right.ids[j:]])
        return Part(ids, left.ends[0] + np.concatenate([[0], np.cumsum(self.widths[ids])]))

    def encode_piece(self, piece: bytes) -> np.ndarray:
        """Tokens of bytes that lie within one piece of the pattern."""
        found = _reference(self.path).model.tokenize("".join(self.letters[b] for b in piece))
        return np.array([t.id for t in found], dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@dataclass
class Leaf:
    """A stretch of text (or one special token) and the cut at its left end."""

    text: str
    token: int
    depth: int
    inside: bool
    left: int
    right: int


@dataclass
class Part:
    """Token ids and the byte positions of their borders."""

    ids: np.ndarray
    ends: np.ndarray


@functools.cache
def _reference(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.cache
def load(path: str) -> Codec:
    """The codec of a vocabulary file; kept for the life of a Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("only byte-level BPE vocabularies without a normaliser are supported")
    if pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("the vocabulary must split with its pattern and add no prefix space")
    added = spec["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens must match exactly")
    letters = byte_letters()
    code = {c: b for b, c in enumerate(letters)}
    vocab = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items()
             if all(c in code for c in t)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {b: i for b, i in vocab.items() if i not in special.values()}
    table = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for b, i in ranks.items():
        table[i] = b
    for s, i in special.items():
        table[i] = s.encode()
    names = sorted(special, key=len, reverse=True)
    return Codec(
        tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}),
        path,
        regex.compile(PIECES),
        special,
        regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None,
        table,
        np.array([len(b) for b in table], dtype=np.int64),
        letters,
    )
