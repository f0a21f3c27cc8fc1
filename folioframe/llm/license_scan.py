"""Licence scans by sentence rules.

A text is lower-cased and cut into segments at line ends, at ``.!?:;)``
before white space and at ``|``; other characters than a-z and 0-9 are blanks.
So comment leaders, list marks, indents and quotes vanish, and a copyright
line, a program's name or a list number is a segment of its own.  A known
sentence is recognised where its words stand from the beginning of a segment
to the end of one, over as many segments as it takes: it may be wrapped, hold
abbreviations or go on below a blank line.  Of several known sentences that
begin at a segment the longest counts.  Ordered rules are then matched with
the sequence of identifiers (longer rules come first); what a rule has matched
is not there for the rules after it.

All of it happens within the row, whatever its length, and nothing is
shuffled: a text of megabytes is one string that is rewritten three times, or
not at all if it has none of the words that known sentences are made of.

Defined results: null and empty texts, texts without a known sentence and rows
without an id give their row with empty lists; repeated sentences are repeated
identifiers; ties between sentences can't be, as equal sentences are one;
repeated rows are scanned each; empty tables give empty results; extra columns
of any name are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices and their identifiers.
SENTENCES = {
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-under": "Licensed under the Apache License, Version 2.0",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "as-is-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "see-license": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-under": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-name": "The MIT License",
    "mit-name-marked": "The MIT License (MIT)",
    "mit-name-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-author": "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl3-under": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-missing": "If not, see <https://www.gnu.org/licenses/>",
    "gpl-missing-http": "If not, see <http://www.gnu.org/licenses/>",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-missing": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-missing-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-full": "Boost Software License - Version 1.0 - August 17th, 2003",
    "artistic2-name": "The Artistic License 2.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc0-name": "CC0 1.0 Universal",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "reserved": "All rights reserved",
}
# Identifiers that a line "SPDX-License-Identifier: ..." may name.
TAGS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib"]
# Rules, tried in this order; each names a licence and the identifiers that must follow one another.
RULES = [
    ("Apache-2.0", ["apache-notice", "apache-copy", "as-is-basis", "see-license"]),
    ("Apache-2.0", ["apache-notice", "apache-copy-https", "as-is-basis", "see-license"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse-university"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-author"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-university"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-software", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-software"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-warranty", "agpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-warranty", "lgpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty", "gpl-details"]),
    ("MPL-2.0", ["mpl-notice", "mpl-missing"]),
    ("MPL-2.0", ["mpl-notice", "mpl-missing-https"]),
    ("Unlicense", ["unlicense", "unlicense-anyone"]),
    ("ISC", ["isc-grant", "isc-disclaimer"]),
    ("ISC", ["isc-grant-and", "isc-disclaimer"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-under"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-under"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-name-marked"]),
    ("MIT", ["mit-name-short"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-3.0-only", ["gpl3-under"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("BSL-1.0", ["boost-full"]),
    ("Artistic-2.0", ["artistic2-name"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-long"]),
    ("CC0-1.0", ["cc0"]),
    ("CC0-1.0", ["cc0-name"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]
#: Words of which each known sentence has one at least: a text without any is not rewritten.
TRIGGERS = ["licen", "software", "redistribution", "endorse", "warranty", "mozilla", "waived", "cc0", "reserved", "gnu"]
DOTTED = "\u0130"  # the one letter that engines lower-case to different letters of a-z
#: The three rewrites: segment ends, other characters, one mark between segments.
CUT, OTHER, GAP = "[.!?:;)]*\\n|[.!?:;)]+[ \\t\\r]", "[^a-z0-9|]+", " ?[|][ |]*"
MARK = "||"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {normal(s): k for k, s in SENTENCES.items()} | {normal(f"SPDX-License-Identifier: {t}"): f"tag-{t}" for t in TAGS}


def rules() -> list[tuple[str, list[str]]]:
    """RULES, and each tag for its licence."""
    return RULES + [(t, [f"tag-{t}"]) for t in TAGS]


def pattern() -> str:
    """One expression for all known sentences, longest first; a sentence begins and ends at a mark, whose halves go to either side."""
    ways = sorted(known(), key=lambda s: (-len(s), s))
    return "[|](?:" + "|".join(s.replace(" ", "(?: |[|][|])") for s in ways) + ")[|]"


def lowered(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(DOTTED), F.lit("I")))


def segments(low: Column) -> Column:
    """||segment||segment||...|| of a lower-case text."""
    return F.regexp_replace(F.concat(F.lit("|"), F.regexp_replace(F.regexp_replace(low, CUT, "|"), OTHER, " "), F.lit("|")), GAP, MARK)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, identifiers (in text order) and licenses (distinct, in the order in which the text has them) of each row."""
    table = F.create_map(*(F.lit(x) for pair in known().items() for x in pair))
    hits = F.regexp_extract_all(segments(F.col("_low")), F.lit(pattern()), F.lit(0))
    ids = F.transform(hits, lambda h: F.element_at(table, F.trim(F.regexp_replace(h, "[ |]+", " "))))
    some = reduce(or_, (F.contains("_low", F.lit(t)) for t in TRIGGERS))
    df = docs.select("doc_id", lowered(F.col("text")).alias("_low")).select("doc_id", F.coalesce(F.when(some, ids), F.array().cast("array<string>")).alias("identifiers"))
    left = F.concat(F.lit("|"), F.array_join("identifiers", MARK), F.lit("|"))
    for k, (_, sequence) in enumerate(rules()):
        left = F.replace(left, F.lit("|" + MARK.join(sequence) + "|"), F.lit(f"<{k}>"))
    names = F.array(*(F.lit(name) for name, _ in rules()))
    found = F.transform(F.regexp_extract_all(left, F.lit("<([0-9]+)>"), F.lit(1)), lambda k: F.get(names, k.cast("int")))
    return df.select("doc_id", "identifiers", F.array_distinct(found).alias("licenses"))
