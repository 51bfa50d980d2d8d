"""License scans: headers and licence files against templates, then inheritance down the directory tree.

Every line of a file is a sparse TF-IDF vector over word terms, and so is the text of a licence file. Document frequencies are counted over all
files; the templates count as PRIOR files besides, so that weights mean something for a handful of files, too. A licence is known by its
templates (headers, and the wording of its grant) and by what decides: terms that a text has to have and terms that it may not have, such
as the name and version of a licence. Of the licences whose deciding terms fit, the one with the largest cosine is taken, if that is at least
`least`, and if no other licence that fits is within MARGIN of it; then the text says too little, and it has none.

A file with a licence of its own keeps it ("header", or "file" for a licence file); any other file inherits from the licence file in the
nearest ancestor directory, by equi-joins of directory paths. A file's own licence is that of its line with the largest cosine; a licence file's is
that of its whole text, if that has one, else of its best line.

Lines in which no licence's deciding terms occur are skipped; they can't have a licence.

Null texts count as empty. A file without a path has no ancestors. Ties between lines go to the alphabetically first licence, and between
licence files of one directory to the larger cosine, then the smaller path. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, slices, written


class Licence(NamedTuple):
    """Templates; groups of terms of which a text has to have one each; terms that it may not have. Terms are as `terms` gives them."""

    templates: tuple[str, ...]
    needs: tuple[tuple[str, ...], ...]
    bars: tuple[str, ...] = ()


def _family(name: str, short: str, needs: tuple[tuple[str, ...], ...], versions: tuple[str, ...], bars: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> dict[str, Licence]:
    """Licences that differ in their version, which decides."""
    out = {}
    for v in versions:
        whole, spdx = v.removesuffix(".0"), f"{short}-{v}"
        lines = (f"Licensed under the {name}, version {v}.", f"This work is licensed under the {name}, version {whole}.", f"{name} version {whole}", f"{name} v{v}", f"This program is distributed under the terms of the {name} version {whole}",
                 f"SPDX-License-Identifier: {spdx}", f"SPDX-License-Identifier: {spdx}-only", f"SPDX-License-Identifier: {spdx}-or-later", *(x.format(v=v, whole=whole) for x in extra))
        others = tuple(o for w in versions if w != v for o in {w, w.removesuffix(".0")} - {v, whole})
        out[spdx] = Licence(lines, (*needs, (v, whole)), (*bars, *others))
    return out


def _creative(kind: str, words: tuple[str, ...], bars: tuple[str, ...]) -> Licence:
    long = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}[kind]
    lines = (f"Licensed under CC {kind} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"Creative Commons {long} 4.0 International", f"SPDX-License-Identifier: CC-{kind}-4.0")
    return Licence(lines, (("cc", "creative"), ("by", "attribution"), ("4.0",), *(((w, {"sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}[w])) for w in words)), bars)


_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")
_BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = _BSD2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {whole} of the License, or (at your option) any later version.",)
_PUBLIC = (("gpl", "general"), ("gpl", "public"))
_NC, _SA, _ND = ("nc", "noncommercial"), ("sa", "sharealike"), ("nd", "noderivatives")


def _named(name: str, spdx: str, needs: tuple[tuple[str, ...], ...], *wording: str, bars: tuple[str, ...] = ()) -> Licence:
    return Licence((f"Released under the {name}.", f"Licensed under the {name}.", f"Distributed under the {name}", f"The {name}", f"SPDX-License-Identifier: {spdx}", *wording), needs, bars)


#: Wordings of common licences, by SPDX identifier, and what decides between them.
LICENCES: dict[str, Licence] = {
    "MIT": _named("MIT License", "MIT", (("mit", "furnished", "obtaining"),), *_MIT, f"MIT License {_MIT[1]} {_WARRANTY}", bars=("no", "attribution-free")),
    "MIT-0": _named("MIT No Attribution License", "MIT-0", (("mit",), ("0", "no")), bars=("substantial",)),
    "ISC": _named("ISC License", "ISC", (("isc", "fee"),), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", bars=("0bsd", "zero")),
    "0BSD": _named("Zero-Clause BSD License", "0BSD", (("0bsd", "zero"),), "BSD Zero Clause License"),
    "BSD-2-Clause": _named("BSD 2-Clause License", "BSD-2-Clause", (("bsd", "redistributions"), ("2", "simplified")), _BSD2, bars=("3", "4", "zero", "endorse")),
    "BSD-3-Clause": _named("BSD 3-Clause License", "BSD-3-Clause", (("bsd", "redistributions"), ("3", "new", "revised")), _BSD3, bars=("2-clause", "4", "zero", "simplified")),
    "Apache-2.0": Licence(("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "Apache License 2.0", "Apache 2.0 License", "SPDX-License-Identifier: Apache-2.0"), (("apache",), ("2.0", "2")), ("1.1",)),
    **_family("GNU General Public License", "GPL", _PUBLIC, ("2.0", "3.0"), ("lesser", "lgpl", "affero", "agpl", "library"), tuple(x.replace("{name}", "GNU General Public License") for x in _GNU)),
    **_family("GNU Lesser General Public License", "LGPL", (("lgpl", "lesser", "library"),), ("2.1", "3.0"), ("affero",), tuple(x.replace("{name}", "GNU Lesser General Public License") for x in _GNU)),
    **_family("GNU Affero General Public License", "AGPL", (("agpl", "affero"),), ("3.0",), ("lesser",), tuple(x.replace("{name}", "GNU Affero General Public License") for x in _GNU)),
    **_family("Mozilla Public License", "MPL", (("mpl", "mozilla"),), ("1.1", "2.0"), (), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.", "This Source Code Form is subject to the terms of the Mozilla Public License, version {v}.")),
    **_family("Eclipse Public License", "EPL", (("epl", "eclipse"),), ("1.0", "2.0"), (), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}",)),
    **_family("European Union Public Licence", "EUPL", (("eupl", "european"),), ("1.1", "1.2")),
    "Zlib": _named("zlib License", "Zlib", (("zlib", "misrepresented"),), "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    "BSL-1.0": _named("Boost Software License, Version 1.0", "BSL-1.0", (("boost", "bsl"), ("1.0",)), "Boost Software License - Version 1.0 - August 17th, 2003"),
    "Unlicense": _named("Unlicense", "Unlicense", (("unlicense", "unencumbered"),), "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "WTFPL": _named("WTFPL", "WTFPL", (("wtfpl",),), "Do What The F*ck You Want To Public License (WTFPL)"),
    "CC0-1.0": Licence(("Released under CC0 1.0.", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "SPDX-License-Identifier: CC0-1.0"), (("cc0", "zero"), ("1.0", "cc0")), ("by", "attribution", "bsd")),
    "CC-BY-4.0": _creative("BY", (), (*_NC, *_SA, *_ND)), "CC-BY-SA-4.0": _creative("BY-SA", ("sa",), (*_NC, *_ND)), "CC-BY-NC-4.0": _creative("BY-NC", ("nc",), (*_SA, *_ND)), "CC-BY-ND-4.0": _creative("BY-ND", ("nd",), (*_NC, *_SA)),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", ("nc", "sa"), _ND), "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", ("nc", "nd"), _SA),
}
#: Names of licence files.
LICENCE_FILES = ("LICENSE", "LICENCE", "COPYING", "UNLICENSE")
LEAST, MARGIN, PRIOR, DIGITS = 0.75, 0.02, 1000, 9
_TERM = re.compile(r"cc0|0bsd|[a-z]+|[0-9]+(?:\.[0-9]+)*")


def terms(line: str) -> Counter:
    return Counter(_TERM.findall(line.lower()))


class Matcher:
    def __init__(self, licences: dict[str, Licence], df: dict[str, int], files: int, least: float):
        self.least, self.licences = least, licences
        lines = [(name, terms(t)) for name, x in sorted(licences.items()) for t in x.templates]
        held = Counter(t for _, c in lines for t in c)
        self.idf = {t: math.log((1 + files + PRIOR) / (1 + df.get(t, 0) + PRIOR * n / len(lines))) + 1 for t, n in held.items()}
        self.unseen = math.log(1 + files + PRIOR) + 1
        self.templates: dict[str, list[dict[str, float]]] = {}
        for name, c in lines:
            vector = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in vector.values()))
            self.templates.setdefault(name, []).append({t: w / norm for t, w in vector.items()})
        # A licence's rarest group of deciding terms stands for it: a line without one of these can't be its.
        self.anchored: dict[str, list[str]] = {}
        for name, x in sorted(licences.items()):
            for t in max(x.needs, key=lambda g: min(self.idf.get(t, 0.0) for t in g)):
                self.anchored.setdefault(t, []).append(name)
        self.anchors = sorted((t.encode(), t.isalpha()) for t in self.anchored)

    def lines(self, text: str) -> list[str]:
        """The lines with a deciding term that stands for a licence. Words stand between other signs; numbers may touch letters, as terms
        are cut there. Terms are searched one by one in the text's bytes, as that is many times faster than a pattern of all."""
        raw = text.encode("utf-8", "surrogatepass")
        low, found = raw.lower(), {}  # bytes.lower() changes ASCII letters only
        for t, word in self.anchors:
            at = low.find(t)
            while at >= 0:
                end = at + len(t)
                if not word or not (low[at - 1 : at].isalpha() or low[end : end + 1].isalpha()):
                    start, end = low.rfind(b"\n", 0, at) + 1, low.find(b"\n", end)
                    found[start] = end = end if end >= 0 else len(low)
                at = low.find(t, end)
        return [raw[start:found[start]].decode("utf-8", "surrogatepass") for start in sorted(found)]

    def fits(self, name: str, got: Counter) -> bool:
        x = self.licences[name]
        return all(any(t in got for t in group) for group in x.needs) and not any(t in got for t in x.bars)

    def best(self, line: str) -> tuple[str | None, float]:
        """The licence of a text and its cosine; (None, the largest cosine) where none is sure. Only licences that fit are compared."""
        counted = terms(line)
        fitting = {name for t in counted if t in self.anchored for name in self.anchored[t] if self.fits(name, counted)}
        if not fitting:
            return None, 0.0
        got = {t: n * self.idf.get(t, self.unseen) for t, n in counted.items()}
        norm = math.sqrt(sum(w * w for w in got.values()))
        top: dict[str, float] = {}
        for licence in fitting:
            cos = max(sum(w * got[t] for t, w in vector.items() if t in got) for vector in self.templates[licence]) / norm
            top[licence] = round(min(cos, 1.0), DIGITS)  # equal texts, equal cosines
        ranked = sorted(top.items(), key=lambda x: (-x[1], x[0]))
        if not ranked or ranked[0][1] < self.least or len(ranked) > 1 and ranked[1][1] > ranked[0][1] - MARGIN:
            return None, ranked[0][1] if ranked else 0.0
        return ranked[0]

    def scan(self, text: str, whole: bool) -> tuple[str | None, float]:
        lines = self.lines(text)
        if whole and lines and (got := self.best(text))[0]:
            return got
        name, top = None, 0.0
        for line in lines:
            got = self.best(line)
            if got[0] and (got[1] > top or got[1] == top and got[0] < (name or "~")):
                name, top = got
        return (name, top) if name else (None, 0.0)


def document_frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Of the templates' terms, over all files; the driver gets one row per term."""
    wanted = frozenset(vocabulary)

    def run(batches):
        seen: Counter = Counter()
        n = 0
        for batch in slices(batches):
            for value in batch.column(0).to_pylist():
                n += 1
                seen.update(wanted.intersection(_TERM.findall((value or "").lower())))
        seen[""] = n
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {t: n for t, n in rows}
    return {t: got.get(t, 0) for t in vocabulary}, got.get("", 0)


def scan(files: DataFrame, licences: dict[str, Licence] = LICENCES, least: float = LEAST, key: str = "doc_id") -> DataFrame:
    """(key, path, licence, score, via, licence_path) for each row of files (key, path, text). Texts are read twice: for the frequencies, and
    for the matches, which are written."""
    src = files.select(key, "path", "text")
    vocabulary = {t for x in licences.values() for w in x.templates for t in terms(w)}
    df, n = document_frequencies(src, vocabulary)

    def run(cols, matcher):
        got = [matcher.scan(t or "", (p or "").rsplit("/", 1)[-1].split(".")[0].upper() in LICENCE_FILES) for p, t in zip(cols["path"], cols["text"], strict=True)]
        return {key: cols[key], "path": cols["path"], "own": [g[0] for g in got], "own_score": [g[1] for g in got]}

    kind = dict(files.dtypes)[key]
    found = written(map_slices(src, run, f"`{key}` {kind}, path string, own string, own_score double", lambda: Matcher(licences, df, n, least)))
    name = F.upper(F.substring_index(F.substring_index("path", "/", -1), ".", 1))
    found = found.withColumn("is_file", F.coalesce(name.isin(*LICENCE_FILES), F.lit(False))).withColumn(
        "folder", F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"(?s)\A(.*)/", 1)).otherwise(F.when(F.col("path").isNotNull(), "")))
    # One licence per directory, then one per directory that has files: files meet their directory's answer only at the end.
    declared = found.filter(F.col("is_file") & F.col("own").isNotNull()).groupBy(F.col("folder").alias("at")).agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own")).alias("top")).select("at", F.col("top.own").alias("inherited"), F.col("top.path").alias("licence_path"))
    steps = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    folders = found.select("folder").filter("folder is not null").distinct()
    nearest = folders.select("folder", F.posexplode(F.array_distinct(ups)).alias("depth", "at")).join(declared, "at").groupBy("folder").agg(
        F.max_by(F.struct("inherited", "licence_path"), "depth").alias("up")).select("folder", "up.*")
    via = F.when(F.col("own").isNotNull() & F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited")
    return found.join(nearest, "folder", "left").select(
        key, "path", F.coalesce("own", "inherited").alias("licence"), F.when(F.col("own").isNotNull(), F.col("own_score")).alias("score"), via.alias("via"),
        F.when(F.col("own").isNull(), F.col("licence_path")).alias("licence_path"))


def with_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as the files of one repository per source, three directories deep.

    Every fiftieth document is the licence file of its directory, every five-hundredth that of the directory above.
    """
    d = F.col("doc_id")
    part = lambda n: (d / n).cast("long").cast("string")
    path = F.when(d % 500 == 0, F.concat_ws("/", "source", part(5000), part(500), F.lit("LICENSE"))).when(
        d % 50 == 0, F.concat_ws("/", "source", part(5000), part(500), part(50), F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", "source", part(5000), part(500), part(50), F.concat(d.cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", path.alias("path"), "text")
