"""Licence scans by canonical digest lookup, with DataFrame operations only.

A text is normalised (letter case, copyright lines, punctuation, white space, equivalent spellings) and its
SHA-256 digest is looked up among those of known licence texts: entire documents by a hash join, and every
entire line by the same digests in a table that each task holds. Nothing is compared by parts.

Defined cases: a null text has no digest and no licence; an empty one has the digest of nothing, which is no
licence's; repeated rows are looked up each; a null doc_id stays; an empty table gives no rows; the
other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licences use for the same word, as the normalised text has them.
EQUIVALENTS = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("honour", "honor"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencee", "licensee"), ("licencees", "licensees"), ("licencing", "licensing"), ("licencor", "licensor"), ("licencors", "licensors"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("offence", "offense"), ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("sublicenced", "sublicensed"), ("sublicences", "sublicenses"), ("sublicencing", "sublicensing"), ("unlicence", "unlicense"), ("whilst", "while"), ("wilful", "willful"),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Public licence texts and notices.
KNOWN = {
    "MIT": f"""MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "Released under CC0 1.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This work is licensed under the Mozilla Public License, version 2.0.",
}
# The lines that speak of the licence in standard headers of source files, and SPDX tags.
KNOWN |= {
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "GPL-header": "it under the terms of the GNU General Public License as published by",
    "LGPL-header": "it under the terms of the GNU Lesser General Public License as published by",
    "AGPL-header": "it under the terms of the GNU Affero General Public License as published by",
    "MPL-2.0-header": "License, v. 2.0. If a copy of the MPL was not distributed with this",
}
SPDX = (
    "AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
KNOWN |= {f"{x}-tag": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Where the terms end in texts that tell after them how to apply them; many copies end there.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
for _file in sorted(resources.files("kymo.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
    _name, _text = _file.name.removesuffix(".txt"), _file.read_text(encoding="utf-8")
    KNOWN[_name] = _text
    if _text.partition(END_OF_TERMS)[2].strip():
        KNOWN[f"{_name}-terms"] = _text.partition(END_OF_TERMS)[0] + END_OF_TERMS
#: Lines that claim a copyright, with a year or the sign; a claim of all rights; runs of what is neither letter nor digit, but for line ends.
COPYRIGHT_LINE, ALL_RIGHTS, GAPS = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|\(c\)|©)[^\n]*$", r"all rights reserved", r"[^\p{L}\p{N}\n]+"


def _spelled(text: Column, pairs: tuple) -> Column:
    """Equivalent spellings replaced. Each word has two spaces around it, one of its own on either side, so that neighbours are found as well."""
    for spelling, word in pairs:
        text = F.replace(text, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {word.replace(' ', '  ')} "))
    return text


def _lines(text: Column) -> Column:
    """Normalised lines, their words two spaces apart, each line in spaces, with a line end between them."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, ALL_RIGHTS, " ")
    out = F.replace(F.regexp_replace(out, GAPS, "  "), F.lit("\n"), F.lit(" \n "))
    return _spelled(F.concat(F.lit(" "), out, F.lit(" ")), EQUIVALENTS)


def _canonical(lines: Column) -> Column:
    """The normalised text of normalised lines, its words one space apart; spellings of several words may span lines."""
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, "[ \n]+", "  ")), F.lit(" "))
    return F.trim(F.replace(_spelled(text, tuple(p for p in EQUIVALENTS if " " in p[0])), F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The normalised text."""
    return _canonical(_lines(text))


def canonical_of(text: str) -> str:
    """canonical() for one Python string of the known texts."""
    out = re.sub(COPYRIGHT_LINE, " ", text.lower())
    words = re.sub(r"[\W_]+", " ", re.sub(ALL_RIGHTS, " ", out)).split()
    single = dict(p for p in EQUIVALENTS if " " not in p[0])
    out = "  ".join(single.get(w, w) for w in words)
    out = f" {out} "
    for spelling, word in EQUIVALENTS:
        if " " in spelling:
            out = out.replace(f" {spelling.replace(' ', '  ')} ", f" {word.replace(' ', '  ')} ")
    return out.strip().replace("  ", " ")


def digests() -> dict[str, str]:
    """Digest of each known text -> its name."""
    return {hashlib.sha256(canonical_of(t).encode()).hexdigest(): name for name, t in KNOWN.items()}


def scanned(docs: DataFrame, text_col: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """A struct column row with the columns of docs, digest, licence (of the entire text, or null) and notices (of entire lines, sorted).

    known: digest of each text's canonical form -> its name; digests() unless given.
    """
    known = digests() if known is None else known
    table = docs.sparkSession.createDataFrame(sorted(known.items()), "digest string, licence string")
    names = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lined = packed.select("row", _lines(F.col(f"row.{text_col}").cast("string")).alias("lines"))
    found = F.transform(F.split("lines", "\n", -1), lambda x: F.element_at(names, F.sha2(F.replace(F.trim(x), F.lit("  "), F.lit(" ")), 256)))
    notices = F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), F.array().cast("array<string>"))
    rows = lined.select("row", F.sha2(_canonical(F.col("lines")), 256).alias("digest"), notices.alias("notices"))
    return rows.join(F.broadcast(table), "digest", "left").select("row", "digest", "licence", "notices")  # as many rows as known
