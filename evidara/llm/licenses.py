"""Licence scans: canonical digests of entire texts, looked up among known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.scratch import free_names, others

# Spellings taken as equivalent (the second stands for the first), as whole words after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("merchantibility", "merchantability"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("honour", "honor"),
    ("fulfil", "fulfill"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"),
    ("noninfringement", "non infringement"), ("sub license", "sublicense"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("version 2 0", "version 2"), ("version 3 0", "version 3"), ("https", "http"),
)

# Entire texts of short licences.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Copyright (c) <year>, <owner>
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3_MIDDLE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
ZLIB = """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD0 = """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# Titles under which the texts go, beside none at all and the first line above.
TITLES = (
    ("MIT", MIT, ("The MIT License", "The MIT License (MIT)", "MIT")),
    ("ISC", ISC, ("The ISC License", "ISC")),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD2}{BSD_END}", ("The BSD 2-Clause License", "Simplified BSD License", "FreeBSD License")),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD2}{BSD3_MIDDLE}{BSD_END}", ("The BSD 3-Clause License", "New BSD License", "Modified BSD License")),
    ("0BSD", BSD0, ("Zero-Clause BSD",)),
    ("Zlib", ZLIB, ("The zlib License", "zlib/libpng License")),
    ("BSL-1.0", BOOST, ("Boost Software License", "Boost Software License 1.0")),
    ("Unlicense", f"The Unlicense\n\n{UNLICENSE}", ("Unlicense",)),
    ("Unlicense", f"The Unlicense\n\n{UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>", ("Unlicense",)),
)
KNOWN = tuple((i, t) for i, text, titles in TITLES for body in [text.split("\n", 1)[1]] for t in (text, body, *(f"{x}\n{body}" for x in titles)))
# One-line notices that stand for longer texts.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


# Canonical digests of long licences as published, whole and, where there is one, without the appendix.
DIGESTS = (
    ("Apache-2.0", "383108d907616895332d8117617a0f6912e2d7006251811eb3470d0bdbc31391"),
    ("Apache-2.0", "505d0bcde4b3f1e36672aeef5d9e1204a43221f11d0db61c257049dabfb786be"),
    ("Apache-2.0", "ff709fcd432fa9a0172124d10a76038f529c5575a47e7d267d4a72c9a9a29de1"),
    ("Artistic-1.0", "2f167bea4d7639ee1f5ffbcbba2bb4bf72ff80c3110eea9e21bf6668fc99e8f8"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "84d1ed915e17aaa5b82f4ee40ec049ee8ad206bf2e5d2d146d1218be88602bbd"),
    ("GFDL-1.3", "d4a4f0fa89572488be676840e1bf655767a7dc5085a138f4abd486d1c1f5ae67"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-1.0", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0"),
    ("GPL-2.0", "5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a"),
    ("GPL-2.0", "5e9874a182b8e50f136aed39c11d5b872aaa6c94c59b0780c37559869ffd0faa"),
    ("GPL-2.0", "86098a2eb6cf32b7d85f76517aa2010296c2522588f6d7676bde1230c5ac9041"),
    ("GPL-3.0", "43953244a50a8d661a10c68647c60eb8039eb5306b9336c785f4fb9acb1a0c76"),
    ("GPL-3.0", "ed1c85858baf2b42a8ed0fc28f7a7e9e23af7d85338ae49fcc5b66d156f86489"),
    ("GPL-3.0", "f931edefd868cfed47e0f947217d67388e8a7a00ac6c29751339a1c19652313f"),
    ("LGPL-2.0", "3bb3f2f987ac797968f7655d8946e3fb45c8ed8e489b8090b8c2957416070991"),
    ("LGPL-2.0", "82b9c718a1edbbe60a4f5828e6e8c8390d714f09bfee18638761bb3f8fdff504"),
    ("LGPL-2.0", "c2cefe189596f86dbbdab4ca8b161c6262f8b0d574184ce87144b676eb4e7d0a"),
    ("LGPL-2.1", "0948f7f91046d0736fbe4b1285c1418c43656d51b8a98c2690fd48e68a51284e"),
    ("LGPL-2.1", "14d2766e74523a520125045c7df201c048aea2169d95faf662634c49a477ae7d"),
    ("LGPL-2.1", "8972cc10118fe8a142e8b2d34ba122d3a2c710126a256b6786246af9ae4cd5a6"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "4e8846f73619955307f302e00350d36240da6319b9a40e68e67486570e5a137e"),
)


def canonical(text: Column) -> Column:
    """Lower case, copyright lines away, everything but letters and digits to single spaces, equivalent spellings to one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, r"(?m)^[^\S\n]*(copyright|\(c\)|©)[^\n]*$", " ")
    low = F.regexp_replace(low, r"all rights reserved", " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def digests_of(texts: DataFrame) -> DataFrame:
    """(digest, license_id) of a table (license_id, text) of known texts; of equal texts the smallest license_id."""
    return texts.groupBy(canonical_digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_digests(spark: SparkSession, known=KNOWN + NOTICES, digests=DIGESTS) -> DataFrame:
    """(digest, license_id) of the library's own list, one row a digest."""
    rows = digests_of(spark.createDataFrame(list(known), "license_id string, text string"))
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: Rows of known digests that are broadcast at most (about 100 bytes each); a larger table is joined by shuffle.
BROADCAST_DIGESTS = 50_000


def lookup(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``texts`` (with a column text) and two more: digest, and license_id of the licence that the entire text is, or null.

    known: (digest, license_id), a row a digest, as ``known_digests`` or ``digests_of`` give it. A null or empty text has
    the digest of the empty text, which is no licence. Rows that repeat have equal results; there are no ties, as a
    digest is known once. Empty tables, also of known ones, are fine; other columns pass through, whatever their names
    (digest and license_id are replaced, in whatever case). Documents aren't shuffled while the known are few.
    """
    columns = others(texts, "digest", "license_id")
    key, name = free_names(texts, "digest_", "license_")
    right = known.select(F.col("digest").alias(key), F.col("license_id").alias(name))
    right = F.broadcast(right) if known.count() <= BROADCAST_DIGESTS else right
    left = texts.select(*columns, canonical_digest(F.col("text")).alias("digest"))
    return left.join(right, F.col("digest") == F.col(key), "left").select(*columns, "digest", F.col(name).alias("license_id"))


#: Every notice has one of these; lines without are no notice, and needn't be brought to canonical form.
MAY_BE_NOTICE = "(?i)licen|cc"


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: the licence that its entire text is, and those that entire lines of it are (sorted, distinct). Cases as ``lookup`` states them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # The fixed list of notices, as a literal map: lines are looked up in their row.
    by_digest = {r["digest"]: r["license_id"] for r in known_digests(spark, NOTICES, ()).collect()}
    pairs = [F.lit(x) for kv in sorted(by_digest.items()) for x in kv]
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(MAY_BE_NOTICE))
    names = F.transform(lines, lambda x: F.element_at(F.create_map(*pairs), canonical_digest(x)))
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), ",")
    notices = F.when(F.col("text").rlike(MAY_BE_NOTICE), names).otherwise("")
    return lookup(docs, known_digests(spark)).select("doc_id", "digest", "license_id", notices.alias("notices"))


def _sql(text: str) -> str:
    out = rf"""' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '(?m)^[^\S\n]*(copyright|\(c\)|©)[^\n]*$', ' ', 'g'), 'all rights reserved', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"""
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"sha256(trim({out}))"


def _values(rows) -> str:
    return ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in rows)


OP9_SQL = f"""
WITH notice AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql("t")} AS digest FROM (VALUES {_values(NOTICES)}) AS k(license_id, t)) GROUP BY digest),
known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql("t")} AS digest FROM (VALUES {_values(KNOWN)}) AS k(license_id, t)
  UNION ALL SELECT license_id, t FROM (VALUES {_values(DIGESTS)}) AS k(license_id, t) UNION ALL SELECT license_id, digest FROM notice) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, {_sql("line")} AS digest FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)),
n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN notice USING (digest) GROUP BY r),
w AS (SELECT r, doc_id, {_sql("text")} AS digest FROM d)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices FROM w LEFT JOIN known USING (digest) LEFT JOIN n USING (r)
"""
