"""License scans: an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm._text import documents, per_row
from rangeloom.shared import stored

#: Phrases and their labels (fixed values).
PHRASES: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Label and wording of well-known notices (fixed values): short lines first, then whole notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("gpl", "Licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
        more details.""",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
        more details.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
        is furnished to do so, all subject to the following:""",
    ),
)

#: Words are runs of anything but ASCII characters that are neither digits nor letters; A-Z count as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class LicenseSpec:
    """``threshold``: least |block and template| / |template| of distinct words.

    Blocks of a template have ``width``: ``stretch`` times its words. They stand at every place of a text, so a notice is found
    wherever it begins, with up to ``stretch - 1`` of its length in other words between its own.
    """

    threshold: float = 0.9
    stretch: float = 1.25
    templates: tuple[tuple[str, str], ...] = TEMPLATES

    def width(self, words: int) -> int:
        return -int(-words * self.stretch // 1)


def folded_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _need(n: int, threshold: float) -> int:
    return max(1, -int(-n * round(threshold * 1000) // 1000))


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """``(start, label)`` of all places of the phrases."""
    out = []
    for phrase, label in PHRASES:
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[-1], at + 1)
            except ValueError:
                break
            start = at - len(want) + 1
            if start >= 0 and words[start : at + 1] == want:
                out.append((start, label))
    return out


def token_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """``(token, n)``: how often each template word stands in all texts; summed in the task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(filter(vocabulary.__contains__, folded_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in n]), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def template_tokens(spark: SparkSession, counts: DataFrame, spec: LicenseSpec) -> DataFrame:
    """``template, label, token, rank, size, need, width``: a template's distinct words from the globally rarest on."""
    rows = []
    for i, (label, t) in enumerate(spec.templates):
        words = folded_words(t)
        own = sorted(set(words))
        rows += [(i, label, w.decode(), len(own), _need(len(own), spec.threshold), spec.width(len(words))) for w in own]
    df = spark.createDataFrame(rows, "template int, label string, token string, size int, need int, width int").join(counts, "token", "left")
    order = Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "token")
    return df.withColumn("rank", F.row_number().over(order) - 1).select("template", "label", "token", "rank", "size", "need", "width")


@dataclass(frozen=True)
class Family:
    """The templates with blocks of one width: their words, the words of their prefixes, the least number of words."""

    width: int
    vocabulary: frozenset[bytes]
    prefix: frozenset[bytes]
    least: int


def families(prefixes: DataFrame, spec: LicenseSpec) -> list[Family]:
    """By width; the given templates alone decide their number and size."""
    prefix: dict[int, set[bytes]] = {}
    for width, token in prefixes.select("width", "token").distinct().collect():
        prefix.setdefault(width, set()).add(token.encode())
    by_width: dict[int, list[list[bytes]]] = {}
    for _, t in spec.templates:
        words = folded_words(t)
        if words:
            by_width.setdefault(spec.width(len(words)), []).append(words)
    return [Family(w, frozenset(x for t in ts for x in t), frozenset(prefix[w]), min(_need(len(set(t)), spec.threshold) for t in ts)) for w, ts in sorted(by_width.items())]


def regions(words: list[bytes], family: Family) -> list[list[tuple[int, bytes]]]:
    """Stretches of a text whose blocks may match, as the places and words of the family's vocabulary in them.

    A block is a run of ``width`` words. One may match if it has a word of a prefix and (length filter) at least
    ``least`` distinct words of the vocabulary. Blocks that overlap make one region.
    """
    at = [(i, w) for i, w in enumerate(words) if w in family.vocabulary]
    out: list[tuple[int, int]] = []
    n: Counter[bytes] = Counter()
    lo = led = 0
    for hi, (i, w) in enumerate(at):
        n[w] += 1
        led += w in family.prefix
        while i - at[lo][0] >= family.width:
            old = at[lo][1]
            n[old] -= 1
            led -= old in family.prefix
            if not n[old]:
                del n[old]
            lo += 1
        if led and len(n) >= family.least:
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return [at[a : b + 1] for a, b in out]


def in_order(block: list[bytes], template: list[bytes]) -> int:
    """Longest common subsequence of two word lists, by bit rows."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(template):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for w in block:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(template) - row.bit_count()


def best_block(region: list[tuple[int, bytes]], template: list[bytes], spec: LicenseSpec) -> float:
    """Best share of the template's words that a block of the region has in their order, 0 if none meets the threshold.

    A block meets it if it has ``threshold`` of the template's distinct words, and of all its words in their order.
    """
    own = set(template)
    at = [(i, w) for i, w in region if w in own]
    need, least, width = _need(len(own), spec.threshold), _need(len(template), spec.threshold), spec.width(len(template))
    n: Counter[bytes] = Counter()
    lo, best = 0, 0
    for hi, (i, w) in enumerate(at):
        n[w] += 1
        while i - at[lo][0] >= width:
            n[at[lo][1]] -= 1
            if not n[at[lo][1]]:
                del n[at[lo][1]]
            lo += 1
        # A block with more words of the template to come is judged with them.
        if len(n) >= need and (hi + 1 == len(at) or at[hi + 1][0] - at[lo][0] >= width):
            best = max(best, in_order([x for _, x in at[lo : hi + 1]], template))
    return best / len(template) if best >= least else 0.0


_BLOCK = "struct<width: int, place: array<int>, words: array<string>>"
_BLOCK_TYPE = pa.struct([("width", pa.int32()), ("place", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])


def blocks(docs: DataFrame, spec_families: list[Family]) -> DataFrame:
    """A row per document: base columns and ``blocks``, the regions of each family that may match."""
    fields = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("blocks", pa.list_(_BLOCK_TYPE))]

    def make() -> Callable:
        def row(doc_id, text_key, text):
            words = folded_words(text)
            places = phrase_places(words)
            starts = [s for s, _ in places]
            there = set(words)
            found = []
            for family in spec_families:
                if len(words) >= family.least and not family.prefix.isdisjoint(there):
                    for r in regions(words, family):
                        found.append({"width": family.width, "place": [i for i, _ in r], "words": [w.decode() for _, w in r]})
            return doc_id, text_key, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), found

        return row

    out = f"doc_id long, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels string, blocks array<{_BLOCK}>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(per_row(pa.schema(fields), make), out)


def verified(pairs: DataFrame, spec: LicenseSpec) -> DataFrame:
    """``doc_id, text_key, label, share`` of the pairs of region and template whose best block meets the threshold."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("label", pa.string()), ("share", pa.float64())])
    templates = [folded_words(t) for _, t in spec.templates]

    def make() -> Callable:
        return lambda doc_id, text_key, template, label, b: (doc_id, text_key, label, best_block([(i, w.encode()) for i, w in zip(b["place"], b["words"], strict=True)], templates[template], spec))

    found = pairs.select("doc_id", "text_key", "template", "label", "block").mapInArrow(per_row(schema, make), "doc_id long, text_key long, label string, share double")
    return found.where("share > 0")


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: LicenseSpec = LicenseSpec()) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    The join, for containment ``t`` in templates of ``size`` distinct words: words are ordered by how often they stand in
    the whole corpus, rarest first. A block that holds ``need = ceil(t * size)`` words of a template holds one of
    the template's first ``size - need + 1`` (prefix filter); it has at least ``need`` template words (length
    filter); and counting from the first shared word at ``rank``, no more than ``size - rank`` words can be shared
    (positional filter). What is left is verified, so every block that meets the threshold is found; blocks whose words
    are the template's in another order are not taken. ``score`` is the highest share of a template's words that
    stand in order in one block, 1 if a phrase was found, else 0.

    Null and empty texts have no words and no labels. Repeated rows give a row each; an empty table gives an
    empty one; other columns are not read. The template table is as small as ``spec.templates``.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    vocabulary = frozenset(w for _, t in spec.templates for w in folded_words(t))
    templates = stored(template_tokens(spark, token_counts(docs, vocabulary), spec), "license-templates")
    prefixes = templates.where(F.col("rank") <= F.col("size") - F.col("need"))
    rows = stored(blocks(docs, families(prefixes, spec)), "license-blocks")
    block = stored(rows.select("doc_id", "text_key", F.explode("blocks").alias("block")).distinct().withColumn("tokens", F.array_distinct("block.words")), "license-regions")
    probes = block.select("doc_id", "text_key", "block", "tokens", F.col("block.width").alias("width"), F.explode("tokens").alias("token"))
    first = probes.join(prefixes, ["width", "token"]).groupBy("doc_id", "text_key", "block", "template").agg(F.first("tokens").alias("tokens"), F.first("label").alias("label"), F.min("rank").alias("rank"), F.first("need").alias("need"), F.first("size").alias("size"))
    possible = first.where((F.size("tokens") >= F.col("need")) & (F.col("size") - F.col("rank") >= F.col("need")))
    by_doc = verified(possible, spec).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("share").alias("best"))
    joined = rows.drop("blocks").join(by_doc.withColumnsRenamed({"doc_id": "__d", "text_key": "__t"}), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__t")), "left")
    base = F.when(F.col("base_labels") != "", F.split("base_labels", ",")).otherwise(F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op4_containment_join(spark, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir))
