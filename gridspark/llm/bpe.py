"""BPE encoding and decoding with a published merge list.

Each short word is held as a contiguous array of parts and the rank of every adjacent pair; the lowest rank is found by
scanning, its boundary is deleted, and only the two neighbouring ranks are refreshed. Words beyond SHORT parts go through a
heap over linked parts instead, because repeated scans of one very long word would take quadratic time; both give the same
merges (lowest rank first, leftmost on ties).

Null texts count as empty and give no ids; repeated rows and ties have no influence, as each row stands alone. A text may hold
the strings of special tokens: as in the tokenizer file, they become the special ids. The file is read by the driver and sent
to the executors as a broadcast variable (a few MB, whatever the size of the data).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame

from .common import map_slices

#: Parts up to which the scanned array is used.
SHORT = 64
#: Words that a task remembers; beyond that it starts anew (this bounds memory, not results).
CACHE_WORDS = 250_000
#: The characters that count as white space in the tokenizer's patterns (Unicode White_Space).
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE_RUN = regex.compile(f"[{SPACES}]+")
_OTHER_SPACE = regex.compile("[\x1c-\x1f]")
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in stays else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one tokenizer file of the word-end kind."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left = self.ids[a]
            self.pairs[left, self.ids[b]] = (rank, self.ids[a + b])
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [self.ids.get(c) for c in letters]
        self.last = [self.ids.get(c + self.suffix) for c in letters]
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", regex.escape(SPACES, special_only=False))
        self.pieces = regex.compile(split)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [i for i in ids if i is not None]
        if len(ids) > SHORT:
            return self._long(ids)
        pairs = self.pairs
        none = (NEVER, 0)
        found = [pairs.get(p, none) for p in zip(ids, ids[1:])]
        ranks = [f[0] for f in found]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            ids[i] = pairs[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((ids[i], ids[i + 1]), none)[0]
            if i:
                ranks[i - 1] = pairs.get((ids[i - 1], ids[i]), none)[0]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i] = pairs[a, b][1]
            gone[j] = 1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in pairs:
                heapq.heappush(heap, (pairs[p][0], before[i], *p))
        return [t for t, g in zip(ids, gone) if not g]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a run without white space."""
        return [i for piece in self.pieces.findall(chunk) for i in self.word(piece.encode())]

    def chunks(self, text: str) -> list[str]:
        """Normalised text, cut at white space."""
        text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return list(filter(None, _SPACE_RUN.split(text))) if _OTHER_SPACE.search(text) else text.split()

    def spans(self, text: str):
        """(special?, string) pieces of a raw text."""
        if self.specials is None or "<|" not in text and not self.specials.search(text):
            yield False, text
            return
        for k, part in enumerate(self.specials.split(text)):
            if part:
                yield bool(k % 2), part

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, part in self.spans(text or ""):
            if special:
                out.append(self.special[part])
            else:
                for c in self.chunks(part):
                    out += self.chunk(c)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so tokens are joined by one space; unknown ids are left out."""
        return " ".join(t for i in ids if (t := self.tokens.get(i)) is not None)


class _Memo(dict):
    """chunk -> (its ids joined by a space, its decoded text, its number of ids)"""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str):
        ids = self.bpe.chunk(chunk)
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = (" ".join(map(str, ids)), self.bpe.decode(ids), len(ids))
        if len(chunk) <= 256:
            self[chunk] = got
        return got


_LOADED: dict[str, WordBpe] = {}


def _load(spec: str) -> WordBpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def _shipped(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with one more column, an array of ids. All other columns stay; an existing column `out` is replaced."""
    spec = _shipped(df, path)
    kept = [c for c in df.columns if c != out]
    at = f"{df.select(kept).schema.simpleString()[7:-1]},{out}:array<int>"

    def run(cols, bpe):
        cols[out] = [bpe.encode(t) for t in cols[text]]
        return cols

    return map_slices(df.select(kept), run, at, lambda: _load(spec.value))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with one more column, the text of an array of ids (null: empty)."""
    spec = _shipped(df, path)
    kept = [c for c in df.columns if c != out]
    at = f"{df.select(kept).schema.simpleString()[7:-1]},{out}:string"

    def run(cols, bpe):
        cols[out] = [bpe.decode(i or []) for i in cols[ids]]
        return cols

    return map_slices(df.select(kept), run, at, lambda: _load(spec.value))


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_decoded: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One pass that encodes and decodes each text: (key, n_tokens, ids_sha256, decoded_sha256), with `decoded` if asked for.

    `carry` names further columns to hand through. Ids and decoded text never leave the worker unless asked for.
    """
    spec = _shipped(df, path)
    types = dict(df.dtypes)
    src = df.select(key, text, *carry)
    schema = ", ".join([f"`{key}` {types[key]}", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["decoded string"] if keep_decoded else []), *(f"`{c}` {types[c]}" for c in carry)])

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def one(value, memo: _Memo):
        bpe, got = memo.bpe, []
        for special, part in bpe.spans(value or ""):
            if special:
                got.append((str(bpe.special[part]), part, 1))
            else:
                got += [memo[c] for c in bpe.chunks(part)]
        return sum(g[2] for g in got), " ".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def run(cols, memo):
        n, a, b, full = [], [], [], []
        for value in cols[text]:
            count, ids, decoded = one(value, memo)
            n.append(count)
            a.append(sha(ids))
            b.append(sha(decoded))
            full.append(decoded)
        out = {key: cols[key], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
        if keep_decoded:
            out["decoded"] = full
        return out | {c: cols[c] for c in carry}

    return map_slices(src, run, schema, lambda: _Memo(_load(spec.value)))
