"""Token counts under a unigram model by trie-shared dynamic programming.

A text is cut at white space; a pre-token is a word-start mark and the word. A pre-token's segmentation is the one with the
largest sum of log scores (then the fewest tokens); a character in no piece costs as many tokens as it has UTF-8 bytes.
The distinct pre-tokens of a task go into a trie; each node keeps the best score of its prefix and the number of tokens in it, worked out once
from the nodes above when the node is made, so a prefix that any words of the task share is scored once. The count of a word is what its
last node stores. A trie of NODES nodes is dropped and begun anew, which bounds memory and changes no result.

The vocabulary is a published piece list, in rank order; nothing is trained. Its pieces carry no unigram probabilities, so scores follow
Zipf's law over the rank: counts are those of this stated model, not of a published unigram tokenizer.
Null and blank texts have 0 pre-tokens and 0 tokens. Repeated rows and ties in the key have no influence.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import map_slices

#: Nodes of a task's trie, and distinct pre-tokens whose counts it remembers.
NODES, CACHE_WORDS = 1_000_000, 400_000
#: Fixed value: the word-start mark of the piece list.
MARK = "▁"
#: Log score of one byte of a character that no piece covers.
BYTE_SCORE = -20.0


def read_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model file in rank order (field 1 of the message: piece = 1, score = 2, type = 3)."""
    with open(path, "rb") as f:
        data = f.read()

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at, end):
        while at < end:
            tag, at = varint(at)
            if tag & 7 == 0:
                value, at = varint(at)
            elif tag & 7 == 2:
                n, at = varint(at)
                value, at = (at, at + n), at + n
            else:
                n = 4 if tag & 7 == 5 else 8
                value, at = (at, at + n), at + n
            yield tag >> 3, value

    pieces = []
    for number, span in fields(0, len(data)):
        if number == 1:
            got = dict(fields(*span))
            if got.get(3, 1) == 1:
                a, b = got[1]
                pieces.append(data[a:b].decode())
    return pieces


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(pieces)}


class Trie:
    """Words by their characters; a node has the best score of its prefix and the number of tokens in it."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.made = 0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node and character to node
        self.best, self.used = [0.0], [0]

    def add(self, word: str) -> int:
        """The number of tokens of a word, which joins the trie."""
        if len(self.best) > NODES:
            self.clear()
        child, best, used, scores, longest = self.child, self.best, self.used, self.scores, self.longest
        node, path = 0, [0]
        for end, char in enumerate(word, 1):
            step = node << 21 | ord(char)
            node = child.get(step, 0)
            if not node:
                raw = len(char.encode("utf-8", "surrogatepass"))
                top, n = best[path[-1]] + BYTE_SCORE * raw, used[path[-1]] + raw
                for start in range(max(0, end - longest), end):
                    s = scores.get(word[start:end])
                    if s is not None:
                        total, k = best[path[start]] + s, used[path[start]] + 1
                        if total > top or total == top and k < n:
                            top, n = total, k
                node = child[step] = len(best)
                best.append(top)
                used.append(n)
                self.made += 1
            path.append(node)
        return used[node]

    def count(self, words) -> dict[str, int]:
        return {w: self.add(w) for w in words}


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pretokens, n_tokens) for each row."""
    shipped = df.sparkSession.sparkContext.broadcast(read_pieces(path))
    src = df.select(key, text)

    def state():
        return Trie(zipf_scores(shipped.value)), {}

    def run(cols, own):
        trie, known = own
        split = [(t or "").split() for t in cols[text]]
        if len(known) > CACHE_WORDS:
            known.clear()
        new = {w for words in split for w in words if w not in known}
        counted = trie.count(MARK + w for w in new)
        known.update((w[1:], n) for w, n in counted.items())
        return {key: cols[key], "n_pretokens": [len(w) for w in split], "n_tokens": [sum(map(known.__getitem__, w)) for w in split]}

    return map_slices(src, run, f"`{key}` {dict(df.dtypes)[key]}, n_pretokens long, n_tokens long", state)
