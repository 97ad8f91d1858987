"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Templates are of two kinds: sentences by which a licence is declared, and whole licence
texts. Every line of a file, and every line with its neighbours, is compared with the
sentences; a licence file is also compared as a whole with the whole texts. Vectors are
sparse: a term weighs its count times its inverse document frequency among the templates,
a term of no template as one that is in none. Where the terms that any template knows are
too small a part of a passage's length for the threshold, no cosine is worked out: that
loses nothing. A file's own licence is the template of its best passage, if that is near
enough. A licence file also covers its directory: a file without a licence of its own takes
that of the nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import stored, text_of

#: Cosine from which a passage is a template's, and lines on either side that belong to a line's wider passage.
NEAR, AROUND = 0.5, 1
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# The sentences that licences are declared with, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software. SPDX-License-Identifier: MIT",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. SPDX-License-Identifier: Apache-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License. SPDX-License-Identifier: GPL-3.0-or-later",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3. SPDX-License-Identifier: LGPL-3.0-or-later",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. SPDX-License-Identifier: BSD-3-Clause",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. SPDX-License-Identifier: MPL-2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License. SPDX-License-Identifier: CC-BY-4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. SPDX-License-Identifier: CC-BY-NC-4.0",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal. SPDX-License-Identifier: CC0-1.0",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
# Whole licence texts, and of longer licences the notice that stands in for them.
TEXTS = {
    "MIT": f'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}',
    "ISC": 'ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": f"BSD 2-Clause License. {_BSD_START} {_BSD_END}",
    "BSD-3-Clause": f"BSD 3-Clause License. {_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "Unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. {_AS_IS}",
    "Zlib": "zlib License. This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Matcher:
    """Templates as sparse unit vectors: of a sentence each, and of a whole text each."""

    def __init__(self, sentences: dict[str, str], texts: dict[str, str]):
        units = [(name, s, False) for name, t in sentences.items() for s in t.replace("SPDX-", ". SPDX-").split(". ") if s.strip(" .")]
        units += [(name, t, True) for name, t in texts.items()]
        self.names, self.whole = [u[0] for u in units], [u[2] for u in units]
        counts = [Counter(terms(u[1])) for u in units]
        df = Counter(w for c in counts for w in c)
        self.idf = {w: math.log((1 + len(units)) / (1 + n)) + 1 for w, n in df.items()}
        self.unknown = math.log(1 + len(units)) + 1
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            for w, n in c.items():
                self.postings.setdefault(w, []).append((i, n * self.idf[w] / norm))

    def lengths(self, tokens: list[str]) -> tuple[float, float]:
        """The squared lengths of a passage's vector over terms that templates know and over others."""
        known = others = 0.0
        for w, n in Counter(tokens).items():
            if (idf := self.idf.get(w)) is None:
                others += n * n
            else:
                known += (n * idf) ** 2
        return known, others * self.unknown**2

    def best(self, tokens: list[str], whole: bool) -> tuple[float, str] | None:
        """The nearest template of its kind: minus the cosine, and the licence (of equals the first by name)."""
        known, others = self.lengths(tokens)
        if not known or known < NEAR * NEAR * (known + others):
            return None
        sims: dict[int, float] = {}
        for w, n in Counter(tokens).items():
            for i, v in self.postings.get(w, ()):
                if self.whole[i] == whole:
                    sims[i] = sims.get(i, 0.0) + n * self.idf[w] * v
        length = math.sqrt(known + others)
        return min(((-round(min(s / length, 1.0), 9), self.names[i]) for i, s in sims.items() if s >= (NEAR - 1e-12) * length), default=None)

    def own(self, text: str, licence_file: bool) -> tuple[float, str] | None:
        """The best of all a text's passages."""
        found = []
        lines = [terms(line) for line in re.split(r"\r\n|\r|\n", text)]
        sizes = [self.lengths(tokens) if tokens else (0.0, 0.0) for tokens in lines]
        for i, tokens in enumerate(lines):
            if not sizes[i][0]:
                continue
            found.append(self.best(tokens, False))
            around = slice(max(0, i - AROUND), i + AROUND + 1)
            # together, known terms are at most as long as their lengths' sum, and others at least as long as their squares' sum
            known = sum(math.sqrt(k) for k, _ in sizes[around]) ** 2
            if known >= NEAR * NEAR * (known + sum(u for _, u in sizes[around])):
                found.append(self.best([w for line in lines[around] for w in line], False))
        if licence_file:
            found.append(self.best([w for line in lines for w in line], True))
        return min((f for f in found if f), default=None)


def own_licences(files: DataFrame, path: str = "path", text: str = "text", sentences: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """files with `own`, a struct of licence and cosine: each file's nearest template, null without one near enough. A null text has none."""
    shared = files.sparkSession.sparkContext.broadcast((sentences or TEMPLATES, TEXTS if texts is None else texts))

    @F.pandas_udf("licence string, cosine double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(*shared.value)
        for names, contents in batches:
            found = [matcher.own(t, bool(n)) for n, t in zip(names, contents, strict=True)]
            yield pd.DataFrame([(f[1], -f[0]) if f else (None, None) for f in found], columns=["licence", "cosine"])

    named = F.coalesce(F.element_at(F.split(F.col(path), "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    return files.withColumn("own", run(named, text_of(text)))


def _home(path: Column) -> Column:
    """The directory of a path, the root ('') for a path without one; null for null."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def _upwards(directory: Column) -> Column:
    """A directory and all above it from the nearest up, the root ('') last."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"))


def scan(files: DataFrame, path: str = "path", text: str = "text", sentences: dict[str, str] | None = None, texts: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of files: path, licence, cosine, origin ('own', 'inherited' or 'none'), inherited_from, and the columns `keep`.

    Of a directory's licence files the one of the largest cosine counts, then of the first
    path, then of the first licence. Rows that repeat a path are files by themselves; a row
    without a path has only a licence of its own; an empty table gives an empty result; other
    columns are ignored. Each text is read once, in its task; what was found, without texts, is
    a table in the shared folder, and paths alone are joined.
    """
    columns = files.select(F.col(path).alias("path"), F.col(text).alias("text"), *keep)
    # stored, since each use of it would otherwise work out paths and licences again
    marked = stored(own_licences(columns, sentences=sentences, texts=texts).select("path", *keep, "own.licence", "own.cosine")).withColumn("home", _home(F.col("path")))
    covering = marked.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE) & F.col("licence").isNotNull())
    covering = covering.groupBy(F.col("home").alias("directory")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("from"), "licence")).alias("top"))
    # distinct directories alone meet those above them, then the nearest one's licence files win
    homes = marked.select("home").where("home is not null").distinct().select("home", F.posexplode(_upwards(F.col("home"))).alias("far", "directory"))
    nearest = homes.join(covering, "directory").groupBy("home").agg(F.min(F.struct("far", "top")).alias("n")).select("home", "n.top")
    rest = marked.join(nearest, "home", "left")
    inherited = F.col("licence").isNull() & F.col("top").isNotNull()
    return rest.select(
        *keep,
        "path",
        F.coalesce("licence", "top.licence").alias("licence"),
        F.coalesce("cosine", -F.col("top.c")).alias("cosine"),
        F.when(F.col("licence").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("top.from")).alias("inherited_from"),
    )
