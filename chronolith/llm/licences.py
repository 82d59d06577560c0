"""Licence scans by canonical digest lookup, in DataFrame operations only.

A text is made canonical: lower case, copyright lines dropped, punctuation and repeated spaces dropped, equivalent spellings folded. The
SHA-256 of the whole canonical text (its lines joined by spaces, so wrapping doesn't matter) and of each of its lines is looked up among
the digests of known licences and licence notices, made canonical by the same expressions. Only entire texts match: a document that is a
licence, or a line that is a licence notice or a licence, never a part of a sentence.

Only what has the length of a known text, give or take what foldings may change, is folded and digested; the lengths come from the known
texts, so nothing is lost. The table of known texts is a parameter; it is broadcast while small and joined by shuffle beyond. Documents
aren't shuffled: each document's own matches are found through its lines, and only matches (document, licence) are grouped.

Defined results: null and empty texts have no licence. Repeated rows and null ids get one result each (rows are known by id and text
hash). A line that is repeated counts once a document; a digest that two licences share counts as the first by name. Long texts are read
whole. An empty table of documents or of known texts finds nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, table

#: Equivalent spellings, folded in this order in canonical text.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("share alike", "sharealike"), ("copyright holder", "copyright owner"), ("organisation", "organization"), ("behaviour", "behavior"), ("favour", "favor"), ("analogue", "analog"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("http ", "https "))
PUNCTUATION = "!\"#$%'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»–—•©®"
#: A line that is a copyright notice, after a line end: the word with a year or a sign, or the sign with a year.
COPYRIGHT = r"\n[ *#/;-]*(copyright[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\]|\[yyyy\])|(\(c\)|©) *[0-9])[^\n]*"
RESERVED = "all rights reserved"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2, BSD_3 = BSD_TERMS + BSD_DISCLAIMER, BSD_TERMS + BSD_THIRD + BSD_DISCLAIMER
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details.
You should have received a copy of the GNU {0} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


def _bulleted(text: str) -> str:
    """The same with bullets for numbers."""
    return text.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")


#: Licence, text.
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("0BSD", ZERO_BSD), ("0BSD", "BSD Zero Clause License\n" + ZERO_BSD),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", _bulleted(BSD_2)), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2), ("BSD-2-Clause", "BSD 2-Clause License\n" + _bulleted(BSD_2)),
    ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", _bulleted(BSD_3)), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_3), ("BSD-3-Clause", "BSD 3-Clause License\n" + _bulleted(BSD_3)),
    ("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"), ("Unlicense", UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB), ("BSL-1.0", BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + BOOST),
    ("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER), ("GPL-3.0", GNU_HEADER.format("General")), ("LGPL-3.0", GNU_HEADER.format("Lesser General")), ("AGPL-3.0", GNU_HEADER.format("Affero General")),
)
#: Fixed values of long licences: licence, least and largest length before folding, SHA-256 of the canonical text. Apache and GNU licences
#: count with their appendix, up to the line that ends the terms, and without that line.
DIGESTS = (
    ("Apache-2.0", 8866, 8874, "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Apache-2.0", 9882, 9891, "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Artistic-1.0-Perl", 5823, 5833, "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", 6692, 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19576, 19588, "dc0a69dd77c36ecefaab939fe6f1fe20d430b27b4bba90820623760aadc9d0be"),
    ("GFDL-1.3", 22004, 22024, "bab72bc77c1e88bca693141f12e74f26975745ac5dd1bbb063b19944ce5e4558"),
    ("GPL-1.0", 9384, 9390, "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0"),
    ("GPL-1.0", 9412, 9418, "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-1.0", 11762, 11768, "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", 14451, 14458, "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef"),
    ("GPL-2.0", 14479, 14486, "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0", 17113, 17120, "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", 30929, 30943, "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153"),
    ("GPL-3.0", 30957, 30971, "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("GPL-3.0", 33395, 33412, "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1"),
    ("LGPL-2.0", 22245, 22253, "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c"),
    ("LGPL-2.0", 22273, 22281, "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.0", 24126, 24134, "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", 23333, 23339, "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30"),
    ("LGPL-2.1", 23361, 23367, "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", 25213, 25219, "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", 7104, 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22447, 22452, "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", 14341, 14345, "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
)


def base_lines(text: Column) -> Column:
    """The lines of a text that aren't empty or copyright notices: lower case, without punctuation, not folded yet."""
    t = F.replace(F.concat(F.lit("\n"), F.lower(F.coalesce(text.cast("string"), F.lit("")))), F.lit("&"), F.lit(" and "))
    t = F.translate(t, "\t\u00a0\r\x0b\x0c", "  \n\n\n")

    def noticed(t: Column) -> Column:
        may = F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©"))
        return F.when(may, F.regexp_replace(t, COPYRIGHT, "\n")).otherwise(t)

    t = F.get(F.transform(F.array(t), noticed), F.lit(0))  # so that the text is made once
    t = F.regexp_replace(F.translate(t, PUNCTUATION, " " * len(PUNCTUATION)), " {2,}", " ")
    t = F.replace(F.replace(t, F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n"))
    return F.filter(F.split(F.rtrim(t), "\n"), lambda x: (x != "") & (x != RESERVED))


def folded(line: Column) -> Column:
    for old, new in SPELLINGS:
        line = F.replace(line, F.lit(old), F.lit(new))
    return line


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | DataFrame = KNOWN, digests: tuple[tuple[str, int, int, str], ...] = DIGESTS) -> DataFrame:
    """(digest, licence, low, high) of known texts, from pairs or from a table (licence, text), and of digests known as such.

    A text with this digest had from low to high characters before it was folded."""
    df = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "licence string, text string")
    t = folded(F.array_join(base_lines(F.col("text")), " "))
    texts = df.select("licence", t.alias("t")).where("t != ''")
    low = high = F.length("t")
    for old, new in SPELLINGS:
        n = (F.length("t") - F.length(F.replace("t", F.lit(new)))) / len(new) * (len(old) - len(new))
        low, high = low + F.least(n, F.lit(0.0)), high + F.greatest(n, F.lit(0.0))
    rows = texts.select("licence", low.cast("int").alias("low"), high.cast("int").alias("high"), F.sha2("t", 256).alias("digest"))
    if digests:
        rows = rows.union(spark.createDataFrame(list(digests), "licence string, low int, high int, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.min("low").alias("low"), F.max("high").alias("high"))


def scan_licences(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_lengths: int = 100_000) -> DataFrame:
    """(id, text_hash, licences, whole) of the distinct rows with a licence: sorted licence names; whether all the text is one.

    Beyond `most_lengths` different lengths of known texts, every line is digested."""
    known = checkpointed(known)
    lengths = known.select(F.explode(F.sequence("low", "high")).alias("n")).distinct().limit(most_lengths + 1).collect()
    fits = [r["n"] for r in lengths] if len(lengths) <= most_lengths else None

    def may(x: Column) -> Column:
        return F.lit(True) if fits is None else F.length(x).isin(fits)

    text = F.col(text_col).cast("string")
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), base_lines(text).alias("l"))

    def entry(scope: str, x: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), F.sha2(folded(x), 256).alias("digest"))

    some = F.transform(F.array_distinct(F.filter("l", may)), lambda x: entry("line", x))
    whole = F.transform(F.filter(F.array(F.array_join("l", " ")), may), lambda x: entry("document", x))
    # the outer kind: for the other, Spark would make the lines a second time to see whether there are any
    each = lines.select("_id", "_th", F.explode_outer(F.concat(whole, some)).alias("d")).select("_id", "_th", "d.scope", "d.digest")
    found = each.join(broadcast_if_small(known.select("digest", "licence")), "digest").groupBy("_id", "_th")
    found = found.agg(F.array_sort(F.collect_set("licence")).alias("licences"), F.max(F.col("scope") == "document").alias("whole"))
    return found.withColumnsRenamed({"_id": id_col, "_th": "text_hash"})


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"), known_digests(spark))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "whole")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    marks = _quoted(PUNCTUATION)
    t = f"replace(chr(10) || lower(coalesce({text}, '')), '&', ' and ')"
    t = f"translate({t}, chr(9) || chr(160) || chr(13) || chr(11) || chr(12), '  ' || chr(10) || chr(10) || chr(10))"
    t = f"regexp_replace({t}, {_quoted(COPYRIGHT)}, chr(10), 'g')"
    t = f"regexp_replace(translate({t}, {marks}, '{' ' * len(PUNCTUATION)}'), ' +', ' ', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> '{RESERVED}')"


def _sql_folded(text: str) -> str:
    for old, new in SPELLINGS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


def oracle() -> str:
    """DuckDB digests every line, whatever its length."""
    texts = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)
    digests = ", ".join(f"({_quoted(a)}, {_quoted(d)})" for a, _, _, d in DIGESTS)
    more = f" UNION ALL SELECT * FROM (VALUES {digests}) v(licence, digest)" if DIGESTS else ""
    return f"""
WITH k AS (SELECT min(licence) AS licence, digest FROM (
  SELECT licence, sha256({_sql_folded(f"array_to_string({_sql_lines('text')}, ' ')")}) AS digest FROM (VALUES {texts}) v(licence, text){more}) GROUP BY digest),
d AS (SELECT doc_id, {_sql_lines('text')} AS w FROM documents),
e AS (SELECT doc_id, sha256({_sql_folded("array_to_string(w, ' ')")}) AS digest, true AS whole FROM d WHERE len(w) > 0
  UNION ALL SELECT doc_id, sha256({_sql_folded('x')}), false FROM (SELECT doc_id, unnest(w) AS x FROM d))
SELECT doc_id, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences, bool_or(whole) AS whole FROM e JOIN k USING (digest) GROUP BY doc_id
"""
