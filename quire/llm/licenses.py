"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are lower-cased and lose outer punctuation; shingles have five words. Windows have 64 or 8 shingles: a template
uses the largest size that fits it; templates of fewer shingles are looked up by their single shingles.

1. Positions of a document whose shingle is in any template are found with a bit table of hashed shingles (a false hit
   costs time only). Windows hold the hits of size consecutive positions and begin at every STRIDES-th hit, template
   windows at every shingle. Words that are in no template leave the window, which only makes it more like a template's.
   A window with hits at under LEAST of its positions cannot have a similarity of LEAST to any template window.
2. A window's signature has BANDS bands of ROWS rows: the smallest hashes under as many orderings (hash xor mask), in
   one pass over its hits. Two windows of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: over
   0.9999 at 0.7, 0.99 at 0.5, 0.15 at 0.1. A template has many windows, of which one that meets is enough.
3. Documents with such a window or hit are written with their band keys, and keys joined to the templates' keys
   (broadcast if they are few, counted). Every document and template that meet are verified.

A match is a template of which at least 0.8 of the shingles are in the document, compared as text. Templates shorter
than five words have one shingle, of all their words; it is looked for among the document's shingles of that length.

Nulls: a null or empty text has no windows and matches nothing; a null doc_id is reported as null. Repeated rows are
reported repeatedly. Very long texts are scanned whole. Further columns are not read. Templates may be any number; their
shingles are hashed on the driver, so a pack has to fit there.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SPACES, let, small, staged, table, text_or_empty

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 16, 2
#: Window sizes in shingles, with the step between windows in hits.
STRIDES = {64: 8, 8: 1}
LEAST = 0.3
#: Bits of the bit tables for each shingle, and log2 of their bits at least and at most.
SPARSE = 128
TABLE_BITS = (20, 26)
#: Orderings of hashes: fixed odd constants (powers of the golden ratio's 64-bit multiplier).
MASKS = [((0x9E3779B97F4A7C15 ** (k + 1)) % 2**64) - 2**63 for k in range(BANDS * ROWS)]

#: Fixed texts: short statements and notices of common licences.
NOTICES = (
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc-notice",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "gpl-2.0-notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl-2.1-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "lgpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "agpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2.0-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("bsd-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
    ("public-domain-notice", "This work has been released into the public domain by its author."),
)

#: Names by which statements call a licence. The full texts are the files of TEXTS.
SPOKEN = {
    "mit": ("MIT License", "Expat License", "X11 License"),
    "isc": ("ISC License",),
    "zlib": ("zlib License",),
    "unlicense": ("The Unlicense", "Unlicense License"),
    "bsd": ("BSD License",),
    "bsd-2-clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"),
    "bsd-3-clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"),
    "apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License"),
    "gpl": ("GNU General Public License", "GPL License"),
    "gpl-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL v2", "GNU GPL version 2", "GPL version 2", "GPL v2 License", "GPL-2.0 License", "GPLv2 License"),
    "gpl-3.0": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL v3", "GNU GPL version 3", "GPL version 3", "GPL v3 License", "GPL-3.0 License", "GPLv3 License"),
    "lgpl": ("GNU Lesser General Public License", "LGPL License"),
    "lgpl-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL version 2.1", "LGPL-2.1 License", "LGPLv2.1 License"),
    "lgpl-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL version 3", "LGPL-3.0 License", "LGPLv3 License"),
    "agpl-3.0": ("GNU Affero General Public License", "GNU AGPL v3", "AGPL version 3", "AGPL-3.0 License", "AGPLv3 License"),
    "mpl-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0 License", "MPL-2.0 License"),
    "epl-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL-1.0 License"),
    "epl-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "EPL-2.0 License"),
    "bsl-1.0": ("Boost Software License",),
    "artistic": ("Artistic License",),
    "wtfpl": ("WTFPL License",),
    "ofl-1.1": ("SIL Open Font License", "OFL-1.1 License"),
    "gfdl": ("GNU Free Documentation License",),
    "psf-2.0": ("Python Software Foundation License", "PSF License"),
    "cc0-1.0": ("Creative Commons Zero", "Creative Commons CC0", "CC0 1.0 Universal", "CC0 1.0 license", "CC0 license"),
    **{
        f"cc-{k}-{v}": (f"Creative Commons {long} {v}", f"CC {k.upper()} {v}", f"CC-{k.upper()} {v} license")
        for k, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
        for v in ("3.0", "4.0")
    },
}
VERBS = ("licensed", "released", "distributed", "available", "provided")
TEXTS = Path(__file__).parent / "license_texts"


def _plain(text: str) -> tuple[str, ...]:
    """Words of a fixed text, as words_of has them."""
    return tuple(x for w in text.lower().split() if (x := w.strip(OUTER)))


def _statements() -> list[tuple[str, str]]:
    """One-line forms. Forms of five words have one shingle; a name of more needs no verb."""
    seen, out = {_plain(t) for _, t in NOTICES}, []
    for license_id, names in SPOKEN.items():
        n = 0
        for name in names:
            the = name if name.startswith("The ") else f"the {name}"
            forms = [f"terms of {the}", f"under {the}", f"under {name}", *([f"under a {name}"] if name.startswith("Creative") else [])]
            forms = [x for f in forms for x in ([f] if len(_plain(f)) >= SHINGLE else [f"the {f}"] if f.startswith("terms") else [f"{v} {f}" for v in VERBS])]
            for form in forms:
                words = _plain(form)
                if len(words) >= SHINGLE and words not in seen:
                    seen.add(words)
                    n += 1
                    out.append((f"{license_id}-line-{n}", form))
    return out


#: Outer punctuation of a word that does not count.
OUTER = "[]().,;:!?'\"`*_<>{}"

TEMPLATES = (*NOTICES, *_statements(), *((f"{p.stem}-text", p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))))


def words_of(text: Column) -> Column:
    """Words in lower case without outer punctuation; words of punctuation only are dropped."""
    one = F.lower(F.translate(text, SPACES, " " * len(SPACES)))
    return F.filter(F.transform(F.split(one, " +"), lambda w: F.btrim(w, F.lit(OUTER))), lambda w: w != "")


def shingles_of(words: Column, length: Column | int = SHINGLE) -> Column:
    """Shingles of a length as text; none if there are fewer words."""
    k = F.lit(length) if isinstance(length, int) else length
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, length: int) -> Column:
    """A hash of each shingle, from the hashes of its words."""
    n = F.size(hashes)
    at = lambda i: F.xxhash64(F.lit(length), *[F.get(hashes, i + k) for k in range(length)])
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), F.greatest(n - length, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))


class _BitTable:
    """A set of hashes as bits: members are in it, others seldom."""

    def __init__(self, members: np.ndarray) -> None:
        low, high = TABLE_BITS
        self.bits = int(min(high, max(low, np.ceil(np.log2(max(1, len(members)) * SPARSE)))))
        words = np.zeros(1 << (self.bits - 6), np.uint64)
        at = members.view(np.uint64) >> np.uint64(64 - self.bits)
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        # One string literal, which the optimizer turns into an array once.
        self.words = F.split(F.lit(",".join(map(str, words.view(np.int64).tolist()))), ",").cast("array<bigint>")

    def has(self, h: Column) -> Column:
        word = F.get(self.words, F.shiftrightunsigned(h, 70 - self.bits).cast("int"))
        return F.getbit(word, F.shiftrightunsigned(h, 64 - self.bits).bitwiseAND(F.lit(63)).cast("int")) == 1


def band_keys(lows: list[Column], size: int) -> list[Column]:
    return [F.xxhash64(F.lit(size), F.lit(b), *lows[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]


def _lowest(hashes: Column, mask: int) -> Column:
    """The smallest hash under the ordering of mask."""
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask))))


def _signature(hashes: Column, size: int) -> Column:
    """Band keys of a window with these hashes."""
    return F.array(*band_keys([_lowest(hashes, m) for m in MASKS], size))


def _window_keys(hashes: Column, hits: Column, size: int) -> Column:
    """Band keys of the windows of size positions that begin at a hit and have enough hits."""
    enough, step = int(np.ceil(LEAST * size)), STRIDES[size]
    none = F.array().cast("array<int>")
    starts = F.when(F.size(hits) >= enough, F.sequence(F.lit(0), F.greatest(F.size(hits) - enough, F.lit(0)), F.lit(step))).otherwise(none)
    dense = F.filter(starts, lambda k: F.get(hits, k + enough - 1) - F.get(hits, k) < size)

    def keys(k: Column) -> Column:
        own = F.filter(F.slice(hits, k + 1, size), lambda p: p < F.get(hits, k) + size)
        return let(F.transform(own, lambda p: F.get(hashes, p)), lambda x: _signature(x, size))

    return F.flatten(F.transform(dense, keys))


def _known(templates: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray], np.ndarray]:
    """Keys of all templates (template_id, key); hashes of shingles that are looked up alone, by their length; hashes of those in windows.

    Templates are few and bounded: the windows' minima are taken on the driver, from hashes that Spark made.
    """
    spark = templates.sparkSession
    alone: dict[int, list[int]] = {}
    exact, lows, windowed = [], [], []
    n = F.size("words")
    hashed = templates.select("template_id", words_of(text_or_empty("text")).alias("words")).filter("size(words) > 0")
    by_length = F.coalesce(*[F.when(n == k, shingle_hashes(F.col("hashes"), k)) for k in range(1, SHINGLE)], shingle_hashes(F.col("hashes"), SHINGLE))
    for r in hashed.withColumn("hashes", word_hashes(F.col("words"))).select("template_id", F.least(n, F.lit(SHINGLE)).alias("length"), by_length.alias("h")).collect():
        h = np.array(r["h"], np.int64)
        size = max((size for size in STRIDES if size <= len(h)), default=0)
        if not size:
            exact += [(r["template_id"], int(x)) for x in np.unique(h)]
            alone.setdefault(r["length"], []).extend(h.tolist())
            continue
        windowed.append(h)
        low = np.stack([np.lib.stride_tricks.sliding_window_view(h ^ np.int64(m), size).min(1) for m in MASKS], 1)
        for b in range(BANDS):
            lows += [(r["template_id"], size, b, *x) for x in np.unique(low[:, b * ROWS : (b + 1) * ROWS], axis=0).tolist()]
    names = [f"low{i}" for i in range(ROWS)]
    keys = spark.createDataFrame(lows, "template_id string, size int, band int, " + ", ".join(f"{x} bigint" for x in names)).select("template_id", F.xxhash64("size", "band", *names).alias("key"))
    keys = keys.unionByName(spark.createDataFrame(exact, "template_id string, key bigint")).distinct()
    return keys, {k: np.unique(np.array(v, np.int64)) for k, v in alone.items()}, np.unique(np.concatenate(windowed)) if windowed else np.zeros(0, np.int64)


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template_id, containment, n_shingles (of the template) of every match of docs (doc_id, text)."""
    spark = docs.sparkSession
    t = templates.select("template_id", "text") if templates is not None else spark.createDataFrame(list(TEMPLATES), "template_id string, text string")
    keys, alone, windowed = _known(t)
    d = docs.select("doc_id", words_of(text_or_empty("text")).alias("words"))
    none = F.array().cast("array<bigint>")
    five = alone.get(SHINGLE, windowed[:0])
    known, single = _BitTable(np.union1d(windowed, five)), _BitTable(five)

    def of_hits(h: Column, hits: Column) -> Column:
        """Keys of shingles that stand alone, and of windows, from the positions of hits among hashes h."""
        own = let(F.transform(hits, lambda p: F.get(h, p)), lambda x: F.filter(x, single.has))
        return F.concat(own, *[_window_keys(h, hits, size) for size in STRIDES if len(windowed)])

    def of_shingles(h: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))), lambda i: known.has(F.get(h, i)))
        return let(hits, lambda p: F.when(F.size(p) > 0, of_hits(h, p)).otherwise(none))

    def found(w: Column) -> Column:
        """Keys of a document with word hashes w."""
        shorter = [F.filter(shingle_hashes(w, length), _BitTable(members).has) for length, members in sorted(alone.items()) if length < SHINGLE]
        return F.concat(none, *shorter, let(shingle_hashes(w, SHINGLE), lambda h: F.when(F.size(h) > 0, of_shingles(h)).otherwise(none)))

    d = d.withColumn("keys", F.array_distinct(let(word_hashes(F.col("words")), found))).filter(F.size("keys") > 0)
    d = staged(d.withColumn("_row", F.monotonically_increasing_id()), "license_hits")
    bands = small(staged(keys, "license_bands"))
    met = d.select("_row", F.explode("keys").alias("key")).join(bands, "key").groupBy("_row").agg(F.collect_set("template_id").alias("ids"))
    met = small(staged(met, "license_pairs"))
    length = F.least(F.size("own"), F.lit(SHINGLE))
    want = t.select("template_id", words_of(text_or_empty("text")).alias("own")).select("template_id", length.alias("length"), F.array_distinct(shingles_of(F.col("own"), length)).alias("want"))
    want = small(staged(want, "license_templates"))
    pairs = d.select("_row", "doc_id", "words").join(met, "_row").withColumn("have", shingles_of(F.col("words")))
    pairs = pairs.select("doc_id", "words", "have", F.explode("ids").alias("template_id")).join(want, "template_id")
    have = F.when(F.col("length") < SHINGLE, shingles_of(F.col("words"), F.col("length"))).otherwise(F.col("have"))
    share = F.size(F.array_intersect("want", have)) / F.size("want")
    return pairs.select("doc_id", "template_id", share.alias("containment"), F.size("want").alias("n_shingles")).filter(F.col("containment") >= containment)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
