"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines between blank ones, hard-wrapped or not.  It is looked at in
windows: each of its lines, and 40 words at a time over the whole paragraph, as a licence's
text may run over lines or stand in one of them.  Windows are classified by multinomial
logistic regression over hashed word 1-, 2- and 3-grams.  The weights are learned, in one
task, from windows of public licence texts and notices, varied by rule, against a bounded
sample of the corpus's own lines; licences that nobody named (made-up names and terms) teach
the unknown class.  A temperature and the least probability for a named family are set on
templates that were held out from training.

Most windows are no licences, and for these one number is enough: for each n-gram the
largest weight that any licence class has over the class "none".  Their running sum bounds
every licence's margin from above; where it is negative, "none" has won.  Only the other
windows are scored class by class, and a named family must then also share word 3-grams with
one of its templates.
"""

from __future__ import annotations

import pickle
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, byte_lengths, hash52, hash_sample, mix64, slices, table

BITS = 21
WINDOW, STRIDE = 40, 20
#: The bound of the training sample: lines of the corpus, and documents they come from.
SAMPLE_LINES, SAMPLE_DOCS, SAMPLE_BYTES = 4000, 400, 50_000
SIMILARITY = 0.5
NONE, UNKNOWN = "none", "unknown"

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."


def _gnu(name: str, version: str, short: str) -> list[str]:
    """The notices of the GNU licences, which differ by their names."""
    return [
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>.",
        f"This work is licensed under the GNU {name}, version {version}.",
        f"Licensed under the GNU {name}, version {version}.",
        f"SPDX-License-Identifier: {short}-{version}-or-later",
        f"SPDX-License-Identifier: {short}-{version}-only",
    ]


def _commons(name: str, short: str) -> list[str]:
    return [
        f"Licensed under {short} 4.0.",
        f"This work is licensed under a Creative Commons {name} 4.0 International License.",
        f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit the Creative Commons website or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        f"SPDX-License-Identifier: {short.replace(' ', '-')}-4.0",
    ]


# Paragraphs of public licence texts and short notices, by family.
TEMPLATES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS,
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "GPL": [*_gnu("General Public License", "3", "GPL"), "This work is licensed under the GNU General Public License, version 2."],
    "LGPL": [*_gnu("Lesser General Public License", "2.1", "LGPL"), "This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL": _gnu("Affero General Public License", "3", "AGPL"),
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": _commons("Attribution", "CC BY"),
    "CC-BY-SA": _commons("Attribution-ShareAlike", "CC BY-SA"),
    "CC-BY-NC": _commons("Attribution-NonCommercial", "CC BY-NC"),
    "CC0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "Released under the Unlicense.",
    ],
}
FAMILIES = [NONE, UNKNOWN, *TEMPLATES]
#: Notices of licences that nobody knows: {} is a made-up name.
FRAMES = [
    "Licensed under the {} License.",
    "Released under the {} Public License, version 2.",
    "This work is licensed under the {} Community License 1.0.",
    "Distributed under the terms of the {} licence.",
    "Use of this file is governed by the {} Software License Agreement.",
    "Proprietary and confidential. Licensed to {} only.",
    "Licensed under {} Terms, version 3.1.",
    "SPDX-License-Identifier: {}-1.0",
    "This program is made available under the {} Source Licence, version 4; see the file COPYING for its conditions.",
    "You may use, copy and share this work only as the {} Open Licence allows. All other rights are reserved.",
]

_TOKEN = re.compile(r"[a-z]+|\d+")
_BLANKS = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(line: str) -> list[str]:
    """Lower-case runs of Latin letters, and every number as 0."""
    return ["0" if t[0].isdigit() else t for t in _TOKEN.findall(line.lower())]


class TokenHashes(WordHashes):
    """A token between blanks -> the hashes of its words."""

    LIMIT = 150_000

    def __missing__(self, token: bytes) -> list[int]:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[token] = [xxhash.xxh64_intdigest(w) for w in tokens(token.decode("utf-8", "replace"))]
        return value


_tokens = TokenHashes()


def grams(words: np.ndarray, block: np.ndarray) -> list[np.ndarray]:
    """The features of the 1-, 2- and 3-grams that end at each word; -1 where one would reach over its block's start."""
    out, h = [], np.zeros(len(words), np.uint64)
    for n in range(3):
        h = h[: max(len(words) - n, 0)] * np.uint64(0x9E3779B97F4A7C15) + words[n:]
        f = np.full(len(words), -1, np.int64)
        f[n:] = np.where(block[n:] == block[: max(len(words) - n, 0)], (mix64(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), -1)
        out.append(f)
    return out


def hashed(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, number of its line)."""
    per = [[h for t in x.split() for h in _tokens[t]] for x in lines]
    lengths = np.array([len(p) for p in per], np.int64)
    return np.fromiter((h for p in per for h in p), np.uint64, int(lengths.sum())), np.repeat(np.arange(len(per)), lengths)


def features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, line) of whole lines."""
    words, line = hashed(lines)
    found = grams(words, line)
    f, at = np.concatenate(found), np.tile(line, 3)
    return f[f >= 0], at[f >= 0]


def shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


_template_shingles = {family: [shingles(tokens(t)) for t in lines] for family, lines in TEMPLATES.items()}


def similarity(words: list[str], family: str) -> float:
    """The largest share that the words and a template of the family hold of the smaller's 3-grams."""
    a = shingles(words)
    return max((len(a & b) / max(1, min(len(a), len(b))) for b in _template_shingles[family]), default=0.0)


def variants(seed: int = 7, each: int = 14) -> list[tuple[str, int, int]]:
    """(line, class, template): windows of every template, some varied; notices of made-up licences as unknown."""
    rnd, out = random.Random(seed), []
    for family, lines in TEMPLATES.items():
        for number, line in enumerate(lines):
            y, whole = FAMILIES.index(family), line.split()
            for k in range(each + len(whole) // 4):
                n = len(whole) if len(whole) <= WINDOW and rnd.random() < 0.6 else min(len(whole), rnd.randint(min(8, len(whole)), WINDOW))
                at = rnd.randint(0, len(whole) - n)
                words = whole[at : at + n]
                if k and len(words) > 5 and rnd.random() < 0.5:
                    words.pop(rnd.randrange(len(words)))
                lead = rnd.choice(("", "", "All code here is ", "Copyright (c) 2021 The Authors. ", "Note: ")) if n == len(whole) and k else ""
                tail = rnd.choice(("", "", " See LICENSE for details.", " All rights reserved.", " No warranty.")) if n == len(whole) and k else ""
                out.append((lead + " ".join(words) + tail, y, number))
    syllables = ("zor", "bel", "quan", "tri", "mo", "xen", "la", "pud", "ster", "vik", "na", "rho", "dil", "gar", "pe")
    for k in range(each * 30):
        name = " ".join("".join(rnd.choices(syllables, k=rnd.choice((2, 3)))).title() for _ in range(rnd.choice((1, 1, 2))))
        out.append((FRAMES[k % len(FRAMES)].format(name), 1, k % len(FRAMES)))
    return out


class Model:
    """Weights (a row for each feature that has any), bias, temperature, least probability, and the bound for "none"."""

    def __init__(self, features, weights, bias, temperature=1.0, least=0.5):
        self.features, self.bias, self.temperature, self.least = features, bias, temperature, least
        self.weights = np.concatenate((np.zeros((1, weights.shape[1])), weights)).astype(np.float32)
        self.row = np.zeros((1 << BITS) + 1, np.int32)  # the last, at -1, is of no feature
        self.row[features] = np.arange(1, len(features) + 1)
        self.margin = (self.weights[:, 1:] - self.weights[:, :1]).max(1)[self.row].astype(np.float64)
        self.edge = float((bias[1:] - bias[0]).max())

    def packed(self) -> bytes:
        return pickle.dumps((self.features, self.weights[1:], self.bias, self.temperature, self.least))

    def scores(self, feature, line, n: int) -> np.ndarray:
        z = np.tile(self.bias, (n, 1))
        np.add.at(z, line, self.weights[self.row[feature]])
        return z

    def probabilities(self, feature, line, n: int) -> np.ndarray:
        return softmax(self.scores(feature, line, n) / self.temperature)

    def windows(self, found: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which windows (of one block each) have a licence class whose margin over "none" can be positive."""
        per = [self.margin[f] for f in found]
        upto = np.concatenate(([0.0], np.cumsum(per[0] + per[1] + per[2])))
        two, three = np.append(per[1], 0.0), np.append(per[2], [0.0, 0.0])
        # without the n-grams that begin before the window
        across = np.where(stop > start, two[start] + three[start], 0) + np.where(stop > start + 1, three[start + 1], 0)
        return upto[stop] - upto[start] - across + self.edge > -1e-6


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _learned(feature, line, y, share, turns: int) -> Model:
    """Multinomial logistic regression by AdaGrad over the rows that have a share."""
    known_to = np.zeros(1 << BITS, bool)
    known_to[feature[(y[line] > 0) & (share[line] > 0)]] = True  # sparse: what no licence has, has no weight
    keep = known_to[feature]
    feature, line = feature[keep], line[keep]
    used, column = np.unique(feature, return_inverse=True)
    w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    square_w, square_b = np.full(w.shape, 1e-4), np.full(b.shape, 1e-4)
    order = np.argsort(column, kind="stable")
    first, rows_of = np.searchsorted(column[order], np.arange(len(used))), line[order]
    by_line = np.argsort(line, kind="stable")
    sorted_line = line[by_line]
    heads = np.flatnonzero(np.concatenate(([True], sorted_line[1:] != sorted_line[:-1])))
    for _ in range(turns):
        z = np.tile(b, (len(y), 1))
        z[sorted_line[heads]] += np.add.reduceat(w[column[by_line]], heads, axis=0)
        p = softmax(z)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None] / share.sum() * 100
        slope = np.add.reduceat(p[rows_of], first, axis=0) + 0.002 * w
        square_w += slope**2
        w -= 0.5 * slope / np.sqrt(square_w)
        slope = p.sum(0)
        square_b += slope**2
        b -= 0.5 * slope / np.sqrt(square_b)
    return Model(used, w, b)


def train(background: list[str]) -> Model:
    """background: lines of the corpus; those like a template are left out.

    Every template is held out once: two models learn from the templates of even and of odd
    number, and what each says of the other's sets the temperature and the least
    probability.  The model itself then learns from all.
    """
    rest = [b for b in background if not any(similarity(tokens(b), f) >= SIMILARITY for f in TEMPLATES)]
    plain = [*rest, "license", "version", "the public library", "under the terms of the agreement of the parties", "open source", ""]
    rows = variants() + [(b, 0, i) for i, b in enumerate(plain)]
    y, half = np.array([r[1] for r in rows]), np.array([r[2] % 2 for r in rows])
    feature, line = features([r[0].encode() for r in rows])
    share = np.where(y == 0, 1.0, 2.0)
    held = np.zeros((len(rows), len(FAMILIES)))
    for side in (0, 1):
        z = _learned(feature, line, y, share * (half != side), 40).scores(feature, line, len(rows))
        held[half == side] = z[half == side]
    model = _learned(feature, line, y, share, 100)

    def loss(t: float) -> float:
        return -np.log(softmax(held / t)[np.arange(len(y)), y] + 1e-12).mean()

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    p = softmax(held / model.temperature)
    best, chance = p.argmax(1), p.max(1)
    # the least probability from which nineteen of twenty confirmed predictions of held-out windows are right;
    # what two families' texts share is right for either
    like = np.zeros((len(rows), 2))
    for i in np.flatnonzero(best > 1):
        words = tokens(rows[i][0])
        like[i] = similarity(words, FAMILIES[best[i]]), similarity(words, FAMILIES[y[i]]) if y[i] > 1 else 0
    named = (best > 1) & (like[:, 0] >= SIMILARITY)
    right = named & ((best == y) | ((y > 1) & (like[:, 0] >= like[:, 1])))
    good = [t for t in np.linspace(0.3, 0.9, 25) if right[named & (chance >= t)].sum() >= 0.95 * (named & (chance >= t)).sum()]
    model.least = float(good[0]) if good else 0.9
    return model


def background(docs: DataFrame) -> DataFrame:
    """(place, text) of about SAMPLE_DOCS documents, those with the least hashes of id and text, each text once."""
    place = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    some = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("text", place.alias("place"))
    return hash_sample(some, F.col("place"), docs.count(), SAMPLE_DOCS).groupBy(hash52(F.col("place")).alias("place")).agg(F.min("text").alias("text"))


def fitted(docs: DataFrame) -> bytes:
    """A model packed; at most SAMPLE_LINES lines of the sample are its background.  One task trains."""

    def learn(batches):
        rows = sorted((p, t) for batch in batches for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train([x for _, t in rows for x in t.split("\n") if x.strip()][:SAMPLE_LINES]).packed()], pa.binary())], ["model"])

    found = background(docs).select("place", "text").coalesce(1).mapInArrow(learn, "model binary").collect()
    return bytes(found[0]["model"]) if found else train([]).packed()


_models: dict[int, tuple[bytes, Model]] = {}


def paragraph_windows(size: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop), in words, of the windows of lines of these sizes and blocks: short lines, and WINDOW words of each block at a time."""
    ends = np.cumsum(size)
    line = (size > 0) & (size <= WINDOW)
    start, stop = [ends[line] - size[line]], [ends[line]]
    heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
    a, n = (ends - size)[heads], np.add.reduceat(size, heads) if len(heads) else heads
    lines = np.diff(np.append(heads, len(block)))
    more = (n > 0) & ((lines > 1) | (n > WINDOW))
    a, n = a[more], n[more]
    count = np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1
    which = np.repeat(np.arange(len(a)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(step * STRIDE, np.maximum(n[which] - WINDOW, 0))
    start.append(a[which] + first)
    stop.append(a[which] + np.minimum(first + WINDOW, n[which]))
    return np.concatenate(start), np.concatenate(stop)


def scanned(docs: DataFrame, model: Model | bytes) -> DataFrame:
    """(doc_id, text) -> a row for each licence paragraph and family.

    doc_id, paragraph (its number, from 0), start and stop (bytes of the windows that say
    so), family, probability (of the best window), similarity, confirmed.  A family that the
    templates do not confirm, or whose probability is below the calibrated least, is
    "unknown", and so is what the unknown class itself claims, in paragraphs without a
    confirmed family.  Of families of one probability the first of FAMILIES stands.  Null
    and empty texts have no rows, an empty table gives none; texts of any length are scanned
    whole; repeated rows give theirs each; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else model.packed())
    names = ["doc_id", "paragraph", "start", "stop", "family", "probability", "similarity", "confirmed"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        data = shared.value
        if id(data) not in _models:
            _models.clear()
            _models[id(data)] = (data, Model(*pickle.loads(data)))
        m = _models[id(data)][1]
        for batch in batches:
            ids, texts = batch.columns
            for a, b in slices(byte_lengths(texts), 1 << 19):
                out = [(ids[a + i].as_py(), *row) for i, row in _scan(m, [x or b"" for x in texts[a:b].to_pylist()])]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, paragraph int, start long, stop long, family string, probability double, similarity double, confirmed boolean")


def _scan(m: Model, texts: list[bytes]):
    """(text, (paragraph, start, stop, family, probability, similarity, confirmed)) of some texts."""
    owner, block, at, lines, n = [], [], [], [], 0
    for i, text in enumerate(texts):
        place, gap = 0, True
        for x in text.split(b"\n"):
            filled = bool(x) and not x.isspace()
            n += gap and filled
            gap = not filled
            if filled:
                owner.append(i)
                block.append(n)
                at.append(place)
                lines.append(x)
            place += len(x) + 1
        n += 1
    if not lines:
        return
    block = np.array(block)
    words, line = hashed(lines)
    size = np.bincount(line, minlength=len(lines))
    found = grams(words, block[line])
    start, stop = paragraph_windows(size, block)
    hit = np.flatnonzero(m.windows(found, start, stop))
    if not len(hit):
        return
    start, stop = start[hit], stop[hit]
    feature = [np.concatenate([f[min(a + k, b) : b] for k, f in enumerate(found)]) for a, b in zip(start, stop, strict=True)]
    p = m.probabilities(np.concatenate(feature), np.repeat(np.arange(len(hit)), [len(f) for f in feature]), len(hit))
    # a word that is repeated again and again is no more evidence than once
    once = [np.unique(f) for f in feature]
    alone = m.probabilities(np.concatenate(once), np.repeat(np.arange(len(hit)), [len(f) for f in once]), len(hit))[:, 0]
    ends, rows = np.cumsum(size), {}
    for k in np.argsort(line[start], kind="stable").tolist():
        best = int(p[k].argmax())
        if not best or max(p[k, 0], alone[k]) >= 0.5:
            continue
        one, last = int(line[start[k]]), int(line[stop[k] - 1])
        spot = _bytes_of(lines, at, int(start[k] - (ends[one] - size[one])), int(stop[k] - (ends[last] - size[last])), one, last)
        text = tokens(texts[owner[one]][spot[0] : spot[1]].decode("utf-8", "replace"))
        family, like = FAMILIES[best], max(similarity(text, f) for f in ([FAMILIES[best]] if best > 1 else TEMPLATES))
        sure = best > 1 and p[k, best] >= m.least and like >= SIMILARITY
        if not sure and max(p[k, 1:]) < m.least:
            continue
        key = (int(block[one]), best if sure else 1)
        old = rows.get(key)
        new = (one, min(spot[0], old[1]) if old else spot[0], max(spot[1], old[2]) if old else spot[1], family if sure else UNKNOWN, float(p[k, best]), like, sure, text)
        rows[key] = new if old is None or p[k, best] > old[4] else (*old[:1], *new[1:3], *old[3:])
    # in a paragraph, what a likelier family's templates hold as well says nothing of a further one
    kept: dict[int, list[str]] = {}
    for (number, best), row in sorted(rows.items(), key=lambda r: (r[0][0], -r[1][6], -r[1][4], r[0][1])):
        others = kept.setdefault(number, [])
        if others and (best == 1 or max(similarity(row[7], f) for f in others) >= row[5] - 0.05):
            del rows[number, best]
        elif best > 1:
            others.append(row[3])
    for (number, _), (one, first, last, family, chance, like, sure, _) in sorted(rows.items()):
        head = block[np.searchsorted(np.array(owner), owner[one])]  # the text's first paragraph
        yield owner[one], (number - int(head), first, last, family, round(chance, 6), round(like, 6), sure)


def _bytes_of(lines, at, word: int, end: int, one: int, last: int) -> tuple[int, int]:
    """The bytes, in their text, from a word of one line up to a word of another."""

    def places(i: int) -> list[tuple[int, int]]:
        return [(t.start(), t.end()) for t in _BLANKS.finditer(lines[i]) for _ in _tokens[t[0]]]

    return at[one] + places(one)[word][0], at[last] + places(last)[end - 1][1]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scanned(docs, fitted(docs))
