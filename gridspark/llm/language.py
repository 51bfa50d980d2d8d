"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector of DIMENSIONS components; a trigram's vector binds (multiplies) the vectors of its letters,
each permuted by the letter's place; a document's vector bundles (adds) the vectors of its trigrams; a language's prototype
bundles those of its training documents. The prediction is the prototype with the largest cosine, ties going to the
alphabetically first language.

Letters are lower-cased, and each code point has a letter vector of its own, drawn by a hash of it, whatever the script; everything that isn't
a letter is one space, and runs of spaces count once. Trigrams are counted sparsely and exactly, and the work for a document is linear in
its length. At most LABELS labels are learned, those with the most rows, then the alphabetically first; rows of others aren't trained on.

Null texts and texts without a letter get `und` and score 0. With no labelled document at all every text is `und`.
Repeated rows each count in training. Columns other than the key, the text and the label are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, trim

#: Components of a vector: the bits of a SHA-512.
DIMENSIONS = 512
SEED = 7
#: Labels that are learned at most.
LABELS = 256
#: Trigram and letter vectors that a task keeps, trigrams that are bound at once, and trigram counts that a task holds before it bundles
#: them (these bound memory, not results).
KEPT_VECTORS, KEPT_LETTERS, BOUND, HELD_COUNTS = 10_000, 4096, 1024, 200_000
#: Bits of a code point in a trigram's code.
POINT = 21


def _letter_table() -> np.ndarray:
    """The lower-cased letter of each code point; 0, the space, for what isn't one."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = ord(chr(c).lower()[0])
    return out


_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0]


def letter_vector(point: int) -> np.ndarray:
    """+-1 by the bits of a hash of the code point."""
    bits = np.unpackbits(np.frombuffer(hashlib.sha512(f"{SEED}:{point}".encode()).digest(), np.uint8))
    return bits.astype(np.float32) * 2 - 1


def trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of a text, with a space at either end."""
    sym = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sym = np.concatenate([[0], sym, [0]])
    sym = sym[np.concatenate([[True], (sym[1:] != 0) | (sym[:-1] != 0)])]
    if len(sym) < 3:
        return np.zeros(0, np.int64)
    return sym[:-2] << 2 * POINT | sym[1:-1] << POINT | sym[2:]


class Vectors:
    """Vectors of trigrams, bound on first use."""

    def __init__(self):
        self.letter: dict[int, int] = {}
        self.letters = np.zeros((3, 0, DIMENSIONS), np.float32)  # by place: its permutation is a rotation of the components
        self.row: dict[int, int] = {}
        self.held = np.zeros((256, DIMENSIONS), np.float32)  # with room for more

    def _letters(self, points: list[int]) -> np.ndarray:
        """Rows of the letters in `letters`."""
        new = [p for p in points if p not in self.letter]
        if new:
            if len(self.letter) + len(new) > KEPT_LETTERS:
                self.letter, self.letters, new = {}, self.letters[:, :0], points
            base = np.stack([letter_vector(p) for p in new])
            self.letter |= {p: len(self.letter) + i for i, p in enumerate(new)}
            self.letters = np.concatenate([self.letters, np.stack([np.roll(base, place, axis=1) for place in range(3)])], axis=1)
        return np.array([self.letter[p] for p in points], np.int64)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of at most BOUND codes."""
        parts = np.stack([codes >> 2 * POINT, codes >> POINT & (1 << POINT) - 1, codes & (1 << POINT) - 1])
        points, at = np.unique(parts, return_inverse=True)
        a, b, c = self._letters(points.tolist())[at.reshape(parts.shape)]
        return self.letters[0][a] * self.letters[1][b] * self.letters[2][c]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of at most BOUND codes without repeats, kept for the next document."""
        rows = [self.row.get(c, -1) for c in codes.tolist()]
        if -1 in rows:
            new = codes[np.array(rows) < 0]
            if len(self.row) + len(new) > KEPT_VECTORS:
                self.row, new = {}, codes
            first, end = len(self.row), len(self.row) + len(new)
            while end > len(self.held):
                self.held = np.concatenate([self.held, np.zeros_like(self.held)])
            self.held[first:end] = self.bind(new)
            self.row |= {c: first + i for i, c in enumerate(new.tolist())}
            rows = [self.row[c] for c in codes.tolist()]
        return self.held[rows]

    def bundle(self, codes: np.ndarray, n: np.ndarray, keep: bool = True) -> np.ndarray:
        """The sum of the codes' vectors, n times each, exactly: in single precision as long as its whole numbers suffice."""
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(codes), BOUND):
            times, vectors = n[at : at + BOUND], (self.of if keep else self.bind)(codes[at : at + BOUND])
            total += times.astype(np.float32) @ vectors if times.sum() < 1 << 24 else times.astype(np.float64) @ vectors.astype(np.float64)
        return total

    def document(self, text: str) -> np.ndarray | None:
        """The bundled vector; None without letters."""
        codes = trigrams(text)
        return self.bundle(*np.unique(codes, return_counts=True)) if len(codes) else None


def train(df: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each learned label, from every row with a text and such a label.

    Trigram counts are summed per task, bound and bundled there, and then added up by Spark per (label, component); the driver
    gets DIMENSIONS numbers for each of at most LABELS labels. Sums are whole numbers, so their order doesn't matter.
    """
    counted = df.select(F.col(label).alias("l")).filter("l IS NOT NULL").groupBy("l").agg(F.count("*").alias("n"))
    learned = frozenset(r.l for r in counted.orderBy(F.desc("n"), "l").limit(LABELS).collect())
    src = df.select(text, label).filter(F.col(text).isNotNull() & F.col(label).isNotNull())

    def bundle(batches):
        counts: dict[str, dict[int, int]] = {}
        totals: dict[str, np.ndarray] = {}
        vectors, held = Vectors(), 0

        def add() -> None:
            for lang, c in counts.items():
                codes = np.fromiter(c.keys(), np.int64, len(c))
                totals[lang] = totals.get(lang, 0) + vectors.bundle(codes, np.fromiter(c.values(), np.int64, len(c)), keep=False)
            counts.clear()

        for part in slices(batches):
            for value, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if lang not in learned:
                    continue
                own = counts.setdefault(lang, {})
                before = len(own)
                for code, n in zip(*(x.tolist() for x in np.unique(trigrams(value), return_counts=True))):
                    own[code] = own.get(code, 0) + n
                held += len(own) - before
                if held > HELD_COUNTS:
                    add()
                    held = 0
        add()
        for lang, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "v": [total.tolist()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))
        vectors = None
        trim()

    sums = src.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, i, x in sums.collect():
        out.setdefault(lang, np.zeros(DIMENSIONS))[i] = x
    return dict(sorted(out.items()))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """df with lang_pred and score (existing columns of these names are replaced); the score is the cosine, or 0 where that is
    below 0. The other columns pass through as they are."""
    names = list(prototypes)
    unit = np.stack([v / max(np.linalg.norm(v), 1e-12) for v in prototypes.values()]) if names else np.zeros((0, DIMENSIONS))
    src = df.select(*[c for c in df.columns if c not in ("lang_pred", "score")])
    at = src.columns.index(text)
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        vectors = Vectors()
        for part in slices(batches):
            langs, scores = [], []
            for value in part.column(at).to_pylist():
                v = vectors.document(value) if value and names else None
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cos = unit @ v / max(np.linalg.norm(v), 1e-12)
                best = int(np.argmax(cos))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cos[best]))))
            cols = [c.cast(f.type) for c, f in zip(part.columns, arrow)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=arrow)
        vectors = None
        trim()

    return src.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """The fold that training leaves out; a row without an id isn't in it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) over a documents table, trained on the rows outside the held-out fold."""
    prototypes = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
