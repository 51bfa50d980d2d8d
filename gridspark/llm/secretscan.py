"""Secret scans with corpus-wide ownership frequency.

Texts are matched by kind, and every match is a candidate with a hash of its secret part; secrets themselves are never stored. Hashes are
aggregated over the whole corpus by distinct repositories and owners. A candidate is

- `copied`, where COPIED_OWNERS owners or COPIED_REPOS repositories hold it: an example that people paste;
- `live`, where one owner alone holds it and it looks drawn at random: varied, and without a placeholder's words;
- `unclear` otherwise.

Matches of the BASE kinds are always spans. Those of the MORE kinds, which are looser, become spans only where they are live and touch no
match of a kind before theirs. Offsets are code points, ends exclusive; spans are ordered by start, then kind.

Hashes are counted in three steps, each with partial sums: a hash that a third of all rows hold is a row for each task, then for
each repository, then for each owner. Verdicts go back to documents by a join on the hash; hashes with so many occurrences that there are at most
HEAVY_ROWS of them are joined by broadcast, so that no task gets a hot one.

Null and empty texts have no spans. A null owner or repository counts as one of its own. Rows that repeat an id are rows like any other;
copies within a repository or of one owner don't make a secret widely copied. An empty table gives no rows. Texts are read whole, and extra columns
aren't read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written

#: Kinds in the order of spans: pattern, group that holds the secret, least length of that group.
BASE = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # the run has 16 characters or more, so a shorter one needn't match
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
MORE = {
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", 0, 80),
    "vendor": (r"gh[opusr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}", 0, 16),
    "random": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
KINDS = {k: (re.compile(p), g, n) for k, (p, g, n) in {**BASE, **MORE}.items()}
#: `random` holds letters of both cases, a digit, and this many different characters.
VARIED = 12
#: A live secret has this many different characters and none of these words.
LIVE_VARIED = 8
PLACEHOLDERS = re.compile(r"(?ai:example|sample|dummy|placeholder|changeme|your|xxxx|1234567|abcdef)")
COPIED_OWNERS, COPIED_REPOS = 3, 10
HEAVY_ROWS, LEAST_HEAVY = 100_000, 1000

FOUND = "array<struct<kind: int, start: int, stop: int, h: string, varied: boolean>>"
MATCHED = f"uid long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"


class Covered:
    """What of a text is covered so far, as sorted disjoint stretches."""

    def __init__(self):
        self.starts: list[int] = []
        self.stops: list[int] = []

    def touches(self, start: int, stop: int) -> bool:
        i = bisect_left(self.starts, stop)
        return i > 0 and self.stops[i - 1] > start

    def add(self, spans: list[tuple[int, int]]) -> None:
        merged: list[list[int]] = []
        for a, b in sorted([*zip(self.starts, self.stops), *spans]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.starts, self.stops = [a for a, _ in merged], [b for _, b in merged]


def plausible(secret: str) -> bool:
    return bool(len(set(secret)) >= VARIED and re.search("[A-Z]", secret) and re.search("[a-z]", secret) and re.search("[0-9]", secret))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, secret) of a text, in the order of kinds."""
    out, covered = [], Covered()
    for k, (name, (pattern, group, least)) in enumerate(KINDS.items()):
        spans = []
        for m in pattern.finditer(text):
            secret, (start, stop) = m.group(group), m.span()
            if len(secret) < least or name == "random" and not plausible(secret) or name in MORE and covered.touches(start, stop):
                continue
            spans.append((start, stop))
            out.append((k, start, stop, secret))
        covered.add(spans)
    return out


def _match(cols: dict) -> dict:
    names = list(KINDS)
    out: dict[str, list] = {c: cols[c] for c in ("uid", "doc_id", "owner", "repo")}
    out |= {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
    for text in cols["text"]:
        found = candidates(text or "")
        base = sorted((a, k, b) for k, a, b, _ in found if k < len(BASE))
        for k, name in enumerate(BASE):
            out[f"n_{name}"].append(sum(x[1] == k for x in base))
        out["base_sha256"].append(hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
        out["found"].append([{"kind": k, "start": a, "stop": b, "h": hashlib.sha256(s.encode()).hexdigest()[:32],
                              "varied": len(set(s)) >= LIVE_VARIED and not PLACEHOLDERS.search(s)} for k, a, b, s in found])
    return out


def matched(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """Each document's matches, written once: everything after reads these narrow rows, and texts are read once."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), "text")
    return written(map_slices(rows, _match, MATCHED))


def ownership(occurrences: DataFrame) -> DataFrame:
    """(h, n, owners, repos, verdict) of each hash, over all documents."""
    keyed = occurrences.withColumns({c: F.struct(c) for c in ("owner", "repo")})  # a null one groups like a value
    by_repo = keyed.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"), F.bool_or("varied").alias("varied"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"), F.bool_or("varied").alias("varied"))
    by_hash = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"), F.bool_or("varied").alias("varied"))
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS)
    verdict = F.when(copied, "copied").when((F.col("owners") == 1) & F.col("varied"), "live").otherwise("unclear")
    return by_hash.select("h", "n", "owners", "repos", verdict.alias("verdict"))


def scan(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_unclear) of every document."""
    rows = matched(docs, owner, repo)
    each = rows.select("uid", "owner", "repo", F.inline("found"))
    hashes = written(ownership(each.select("h", "owner", "repo", "varied")))
    total = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    heavy = F.col("n") >= max(LEAST_HEAVY, -(-total // HEAVY_ROWS))  # no more than HEAVY_ROWS hashes are that frequent
    hot, cold = F.broadcast(hashes.filter(heavy).select("h", "verdict")), hashes.filter(~heavy).select("h", "verdict")
    judged = each.join(hot, "h").unionByName(each.join(hot, "h", "left_anti").join(cold, "h"))
    added = (F.col("verdict") == "live") & (F.col("kind") >= len(BASE))
    told = judged.groupBy("uid").agg(F.collect_list(F.when(added, F.struct("start", "kind", "stop"))).alias("added"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "copied", "unclear")))
    base = F.transform(F.filter("found", lambda x: x.kind < len(BASE)), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.stop.alias("stop")))
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start: int, kind: int, stop: int>>"))))
    spans = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start, x.stop)), ",")
    return rows.join(told, "uid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), *(F.coalesce(f"n_{v}", F.lit(0)).alias(f"n_{v}") for v in ("live", "copied", "unclear")))


def by_source(docs: DataFrame) -> DataFrame:
    """The scan of the documents table: a source is an owner, and 500 documents of it in a row of ids are a repository."""
    return scan(docs, F.col("source"), F.concat_ws("/", "source", (F.col("doc_id") / 500).cast("long")))
