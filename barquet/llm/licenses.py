"""License scans by conditional compression.

Words that speak of licensing, with as many words around them as a template has, are candidate blocks (in four
lengths, for short and long templates); where they run into each other, a block is cut into pieces that overlap by a
template's length. A piece is compressed on its own and once with each template as a zstandard raw dictionary: the share of their own information that the piece saves
ranks the templates. Each one that saves enough is compared word by word with the piece, a stretch of about its length at
a time, and is confirmed wherever a stretch has few words missing or put in between, none of which tells licenses apart. Of confirmed stretches that
overlap, the one that explains most words best is told. If a block has none, the template that saves most is named as
unconfirmed.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Licenses as files are tagged with them.
TAGS = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense",
)

#: Wordings of license notices and whole texts, or how long texts begin. A license may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("GPL-3.0", 'The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.'),
    ("GPL-2.0", 'The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.'),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    *((name, f"SPDX-License-Identifier: {name}") for name in TAGS),
)

#: Words that tell a license from its neighbours. So do numbers of versions, see ``decides``.
DECISIVE = frozenset(
    "affero lesser sharealike share-alike attribution-sharealike noncommercial attribution-noncommercial noderivatives noderivs attribution-noderivatives "
    "apache artistic bsd cc0 eclipse eupl isc mit mozilla only".split()
)

#: What makes a word a candidate; the same pattern runs in Spark, to skip texts without one, and in tasks. Every template
#: has such a word.
TRIGGER = r"(?i)licen[cs]|copyright|redistribut"
LEAST_GAIN = 0.1  #: share of a template's information that a piece must save for the template to be compared
LEAST_NAMED = 0.5  #: and to be named where none is confirmed
MOST_DIFFERENT = 0.1
LEVEL = 9
SHORT = (8, 20, 64)  #: templates of at most so many words are looked for in pieces of their own, in which they weigh more

FOUND = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("license", T.StringType()),
        T.StructField("confirmed", T.BooleanType()),
        T.StructField("gain", T.DoubleType()),
        T.StructField("missing", T.StringType()),
        T.StructField("extra", T.StringType()),
    ]
)


def placed(text: str) -> list[tuple[str, int, int]]:
    """Words as they are compared - lower case, without punctuation at their ends - and where they begin and end."""
    found = ((x[0].strip("\"'.,;:()[]*#/!->|").lower(), x.start(), x.end()) for x in re.finditer(r"\S+", text))
    return [x for x in found if x[0]]


def words(text: str) -> list[str]:
    return [w for w, _, _ in placed(text)]


@lru_cache
def _judges() -> list[tuple[str, list[str], zstandard.ZstdCompressor, int]]:
    out = []
    for name, text in TEMPLATES:
        plain = " ".join(words(text))
        body = zstandard.ZstdCompressionDict(plain.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        body.precompute_compress(level=LEVEL)
        out.append((name, words(text), zstandard.ZstdCompressor(dict_data=body, level=LEVEL), _size(plain)))
    return out


@lru_cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


def _size(text: str) -> int:
    return len(_plain().compress(text.encode("utf-8", "replace")))


@lru_cache
def classes() -> list[tuple[int, list[int]]]:
    """Templates by length: words of the longest stretch that one of them can be confirmed for, and their numbers."""
    out, lengths = [], [len(template) for _, template, _, _ in _judges()]
    for least, most in zip((0, *SHORT), (*SHORT, max(lengths)), strict=True):
        mine = [k for k, n in enumerate(lengths) if least < n <= most]
        longest = max(lengths[k] for k in mine)
        out.append((longest + int(MOST_DIFFERENT * longest) + 1, mine))
    return out


def aligned(template: list[str], block: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that the block lacks, words that the block puts in between, and which words of the block
    this is about: of the stretches that both share, the run with the fewest differences."""
    same = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return template, [], 0, 0
    least = None
    for i in range(len(same)):
        shared = between = 0
        for j in range(i, len(same)):
            shared += same[j].size
            between += same[j].b - same[j - 1].b - same[j - 1].size if j > i else 0
            cost = (len(template) - shared + between, i - j)
            if least is None or cost < least[0]:
                least = cost, i, j
    run = same[least[1] : least[2] + 1]
    missing, extra, at = [], [], 0
    for k, m in enumerate(run):
        missing += template[at : m.a]
        extra += block[run[k - 1].b + run[k - 1].size : m.b] if k else []
        at = m.a + m.size
    return missing + template[at:], extra, run[0].b, run[-1].b + run[-1].size


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words that the block puts in between."""
    return aligned(template, block)[:2]


def _stretches(template: list[str], block: list[str], license: str) -> Iterator[tuple[list[str], list[str], int, int]]:
    """Each stretch of the block that differs little from the template, and in no word that decides, as ``aligned``."""
    most = MOST_DIFFERENT * len(template)
    bag = Counter(template)
    if (bag - Counter(block)).total() > most:
        return
    size, step = len(template) + len(template) // 2, max(1, len(template) // 4)
    for at in range(0, max(1, len(block) - size + step), step):
        part = block[at : at + size]
        if (bag - Counter(part)).total() <= most:
            missing, extra, a, b = aligned(template, part)
            if len(missing) + len(extra) <= most and not any(decides(w, license) for w in (*missing, *extra)):
                yield missing, extra, at + a, at + b


def decides(word: str, license: str) -> bool:
    """Whether a word that is missing or put in between makes it another license: a name of one, or a number of a version.

    Numbers without a point number sections too, so they only count for the licenses that name versions by them.
    """
    return word in DECISIVE or bool(re.fullmatch(r"v?\d+\.\d[\d.]*", word)) or "GPL" in license and bool(re.fullmatch(r"v?\d", word))


def blocks(found: list[str], reach: int) -> list[tuple[int, int]]:
    """Candidate blocks among the words of a text: all words within reach of a trigger."""
    spans: list[list[int]] = []
    for i, word in enumerate(found):
        if re.search(TRIGGER, word):
            a, b = max(0, i - reach), min(len(found), i + reach + 1)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
    return [(a, b) for a, b in spans]


def pieces(found: list[str], reach: int) -> Iterator[tuple[int, int]]:
    """The blocks in pieces of bounded length; whatever is within reach of a trigger lies in one of them."""
    size, step = 4 * reach, 3 * reach
    for a, b in blocks(found, reach):
        for at in range(a, max(a + 1, b - size + step), step):
            yield at, min(b, at + size)


def _gains(piece: list[str], templates: list[int]) -> list[tuple[float, int]]:
    """Gain and number of these templates, largest gain first."""
    plain = " ".join(piece)
    alone, body = _size(plain), plain.encode("utf-8", "replace")
    gains = []
    for at in templates:
        _, _, packer, own = _judges()[at]
        gains.append(((alone - len(packer.compress(body))) / max(1, min(alone, own)), at))
    return sorted(gains, key=lambda g: (-g[0], _judges()[g[1]][0], g[1]))


def _apart(matches: list[tuple]) -> list[tuple]:
    """The matches (-worth, start, end, ...) without those that overlap a better one, in order of place."""
    told: list[tuple] = []
    for match in sorted(matches):
        at = bisect(told, match[1], key=lambda t: t[1])
        if (at == 0 or told[at - 1][2] <= match[1]) and (at == len(told) or match[2] <= told[at][1]):
            told.insert(at, match)
    return told


def licenses(text: str) -> Iterator[tuple[int, int, str, bool, float, str, str]]:
    """Place, license, confirmed, gain, missing and extra words of all that is found in a text."""
    around = placed(text)
    mine = [w for w, _, _ in around]
    place = lambda i, j: (around[i][1], around[j - 1][2])
    matches, likely = [], []
    for reach, templates in classes():
        for x, y in pieces(mine, reach):
            gains = _gains(mine[x:y], templates)
            likely.append((gains[0][0], -gains[0][1], x, y))
            for gain, at in gains:
                if gain < LEAST_GAIN:
                    break
                name, template = _judges()[at][:2]
                for missing, extra, i, j in _stretches(template, mine[x:y], name):
                    worth = len(template) - 5 * (len(missing) + len(extra))
                    matches.append((-worth, x + i, x + j, name, gain, missing, extra))
    told = _apart(matches)
    for _, i, j, name, gain, missing, extra in told:
        yield *place(i, j), name, True, round(gain, 6), " ".join(missing), " ".join(extra)
    for a, b in blocks(mine, classes()[-1][0]):
        gain, at, x, y = max(c for c in likely if a <= c[2] and c[3] <= b)
        if gain >= LEAST_NAMED and not any(a <= t[1] < b for t in told):
            name, template = _judges()[-at][:2]
            missing, extra, i, j = aligned(template, mine[x:y])
            if j > i:
                yield *place(x + i, x + j), name, False, round(gain, 6), " ".join(missing), " ".join(extra)


def judge(text: str) -> list[tuple[str, bool, float, str, str]]:
    """License, confirmed, gain, missing and extra words of all that is found in a text."""
    return [row[2:] for row in licenses(text)]


def scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row for each license notice found: the columns ``keep`` (all, if None) and those of ``FOUND``.

    ``start`` and ``end`` are the place of the notice in the text, in characters; ``missing`` and ``extra`` its wording
    differences from the template. An unconfirmed row names the template that explains most of a block none fits. A map
    over rows without a shuffle: texts without a trigger word never leave the JVM. Pieces of text are bounded, so the
    time for a text grows with its length.

    Defined cases: null and empty texts, and blocks that neither hold a template nor are compressed much better by one,
    give no row; repeated rows give repeated results; a notice that stands twice in a text is told twice; equal ranks go
    by place and name. Columns of ``keep`` named like a result are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FOUND.names]
    source = docs.where(F.col(f"`{text}`").rlike(TRIGGER)).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*(source.schema[c] for c in keep), *FOUND.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [(i, *found) for i, t in enumerate(part["__text"].to_pylist()) for found in licenses(t)]
                if not rows:
                    continue
                index, *made = zip(*rows, strict=True)
                kept = part.take(pa.array(index, pa.int32()))
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.string(), pa.string())
                columns = [pa.array(x, t) for x, t in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(keep))), *columns], schema.names)

    return source.mapInArrow(run, schema)
