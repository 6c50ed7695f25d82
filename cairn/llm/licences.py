"""Licence scan by canonical digests: whole texts, and single lines that give notice of a licence.

Canonical form: lower case, everything but letters, digits and line feeds as one space, equivalent spellings made one,
lines of a copyright holder and blank lines dropped, the rest joined by spaces. Its MD5 digest is looked up by an equi-
join in a constant table of known licences, whose size is fixed in this module, so that side is broadcast. Short licences
are given as texts, long ones by the digests of their canonical forms. Each single canonical line is looked up in the
constant table of notices in the same way.

Defined results: a null or empty text has the digest of the empty text and no licence; repeated rows are reported each;
a text equal to several known entries takes the name that sorts first; very long texts are read whole; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of well-known licences (without their copyright lines), notices, and equivalent spellings.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = [
    ("MIT", f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT", f"MIT License\n{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT-0", f"{_GRANT}.\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n{_GRANT}.\n{_AS_IS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
]
#: Name, part (the whole file, or its terms without the appendix on their use), and MD5 digest of the canonical form of full texts.
DIGESTS = [
    ("Apache-2.0", "whole", "8f86909a6dbf3a124c7a7d11b3aaf31f"),
    ("Apache-2.0", "terms", "c13f45eb6f6ea48b718436651bf73c9a"),
    ("Artistic-1.0-Perl", "whole", "a8b0fb0c6e43a3b36bdc159e59dbfd1e"),
    ("BSD-3-Clause", "whole", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", "whole", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "whole", "4bbab0d4e64504f528d413862633310b"),
    ("GFDL-1.2", "terms", "a2e7a97edc0e1b26aa69f13d2996ed03"),
    ("GFDL-1.3", "whole", "204a478b6b11f1e58812d18f6c6e320c"),
    ("GFDL-1.3", "terms", "856575ab6f1c63b6481a8c01f7e3fcf5"),
    ("GPL-1.0", "whole", "b04f20be4ff1f1212c27d60027ac4f6d"),
    ("GPL-1.0", "terms", "d1ffc0b604c16cbd51e98de83767c6f5"),
    ("GPL-2.0", "whole", "09176540c2e9c2f4136ddfe8bcbd6cb6"),
    ("GPL-2.0", "terms", "c363704d7a69ed0f8787b4a7c37b7489"),
    ("GPL-3.0", "whole", "e030ad3d1f023c35ea5a1f8ce63bbd13"),
    ("GPL-3.0", "terms", "c8f8417bcfb24fb1bb053e565ecb74fc"),
    ("LGPL-2.0", "whole", "72417a1bf516192ba2d219a5291c48b3"),
    ("LGPL-2.0", "terms", "48ea78bd6dd95bb0fa6062876ff0131f"),
    ("LGPL-2.1", "whole", "f0346207e3aa8cfa8c614db9a7aa9c78"),
    ("LGPL-2.1", "terms", "c87263f0eba1131827be55f7be53ca11"),
    ("LGPL-3.0", "whole", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "whole", "4ed6600fcf5321eb9dcd2181cde18632"),
    ("MPL-1.1", "terms", "18ec000b14af8d9cee2c6f5c54be50ed"),
    ("MPL-2.0", "whole", "b5b7a0cf4994910cd0204fba4637d6ec"),
    ("MPL-2.0", "terms", "310bebfffc41fb4428c07a91abbe6c86"),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
]
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("copyright holders", "copyright holder"), ("https", "http"),
    ("51 franklin st", "51 franklin street"), ("59 temple place suite 330", "51 franklin street fifth floor"), ("02111 1307", "02110 1301"), ("675 mass ave cambridge ma 02139", "51 franklin street fifth floor boston ma 02110 1301"),
]
#: Of a canonical line: a holder's line, in the common syntax of Java, RE2 and Python.
HOLDER = r"^(copyright (c )?([0-9]{4}|by |the regents )|c [0-9]{4}|all rights reserved$)"


def _spaced() -> list[tuple[str, str]]:
    return [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in SPELLINGS]


def canonical_lines_py(text: str | None) -> list[str]:
    # two spaces between words, so that neighbours do not share one
    t = " " + re.sub(r"(?:(?!\n)[\W_])+", "  ", (text or "").lower()).replace("\n", " \n ") + " "
    for a, b in _spaced():
        t = t.replace(a, b)
    return [s for x in t.replace("  ", " ").split("\n") if (s := x.strip(" ")) and not re.search(HOLDER, s)]


def canonical_py(text: str | None) -> str:
    return " ".join(canonical_lines_py(text))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text column, as an array."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", "  ")
    t = F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in _spaced():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.filter(F.transform(F.split(F.replace(t, F.lit("  "), F.lit(" ")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(HOLDER))


def canonical_sql(column: str) -> str:
    """canonical_lines in DuckDB's SQL."""
    t = rf"(' ' || replace(regexp_replace(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}\n]+', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' ')"
    for a, b in _spaced():
        t = f"replace({t}, '{a}', '{b}')"
    return f"list_filter(list_transform(string_split(replace({t}, '  ', ' '), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and not regexp_matches(x, '{HOLDER}'))"


def oracle(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The SQL that scan must equal."""
    values = lambda known: ", ".join(f"('{d}', '{n}')" for d, n in sorted(known.items()))
    return f"""WITH texts(digest, licence) AS (VALUES {values(texts_py())}), notices(digest, name) AS (VALUES {values(known_py(NOTICES))}),
lines AS (SELECT {key}, {canonical_sql(text)} AS lines FROM {table}),
each_line AS (SELECT DISTINCT {key}, md5(unnest(lines)) AS digest FROM lines),
named AS (SELECT {key}, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM each_line JOIN notices USING (digest) GROUP BY {key}),
whole AS (SELECT {key}, md5(array_to_string(lines, ' ')) AS digest FROM lines)
SELECT {key}, digest, licence, notices FROM whole LEFT JOIN texts USING (digest) LEFT JOIN named USING ({key})"""


def known_py(entries: list[tuple[str, str]]) -> dict[str, str]:
    digests: dict[str, str] = {}
    for name, text in entries:
        d = hashlib.md5(canonical_py(text).encode()).hexdigest()
        digests[d] = min(name, digests.get(d, name))
    return digests


def texts_py() -> dict[str, str]:
    """The names of all known whole texts by digest."""
    return {digest: name for name, _, digest in DIGESTS} | known_py(TEXTS)


def known(spark: SparkSession) -> DataFrame:
    """(digest, licence) of known whole texts."""
    return spark.createDataFrame(sorted(texts_py().items()), "digest string, licence string")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, digest, licence (of the whole text, or null), notices (names, sorted and joined by commas, or null)."""
    spark = docs.sparkSession
    notices = F.map_from_entries(F.array(*[F.struct(F.lit(d), F.lit(n)) for d, n in sorted(known_py(NOTICES).items())]))
    lines = docs.select(F.col(f"`{key}`").alias(key), canonical_lines(F.col(f"`{text}`").cast("string")).alias("lines"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: F.try_element_at(notices, F.md5(x))), lambda x: x.isNotNull())))
    digests = lines.select(key, F.md5(F.array_join("lines", " ")).alias("digest"), F.when(F.size(found) > 0, F.array_join(found, ",")).alias("notices"))
    return digests.join(F.broadcast(known(spark)), "digest", "left").select(key, "digest", "licence", "notices")
