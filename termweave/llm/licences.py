"""Licence scan by canonical digest; DataFrame functions only.

A text is normalised (lower case, copyright lines dropped, equivalent spellings made one, punctuation
and white space made single spaces) and its digest looked up among those of known licence texts in a
hash join.  Two grains are looked up entire: the document, and each of its lines, since notices are
mostly a line of a longer document.  Only lines with a word that every known text has are digested.
A row's digests stay with the row: they are joined to the known ones, which are broadcast, and come
together again by the row, not by its id.

Cases: null and empty texts match nothing; a null id keeps its row; repeated rows and rows of one id are
reported each by itself; texts and lines of any length are digested whole; an empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public licence texts and notices, without copyright lines.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]
#: SHA-256 of the normal forms of published texts too long to be repeated here.
KNOWN_DIGESTS = [
    ("Apache-2.0", "120193fe5c5356c17f45be727726cb0a8c6fd7d78112df6f95e1ff070755e007"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "6e96a68ec7c6417d2040ed977d08017fa4fb477dd7770f2602ed60f1499d5fc1"),
    ("GPL-2.0", "fca9d0597eee5ef85465916ba61b41fd1ec4ba0a53efd599baa65c1a5b426a9b"),
    ("GPL-3.0", "ae4b99738073ffde61412ab13252e0ed47e0d29b0cd510ed5c8d9a494f7c159d"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a69f78b3fa716bfc2bb9c1eff3c08dbb50f7cf3bfbea31a2bddabc95124d1fb0"),
    ("MPL-2.0", "58a6c909694812d00109a5caa87aae719fa5d888b14b95fb748c38b5437cb9d9"),
]
#: Spellings that count as one, applied in this order to lower-case ASCII.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("noninfringement", "non infringement"), ("and/or", "and or"), ("&", " and "), ("(c)", " "), ("https", "http")]
#: A copyright line names a sign or a year; a clause numbered (c) is none.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright[ \t:]*(\(c\)|\x{a9}|[0-9<\[{])|(\(c\)|\x{a9})[ \t]*[0-9<\[{]|all rights reserved)[^\n]*$"
#: Every known text has one of these words.
WORDS = "(?i)licen[sc]e|permission|redistribution"


def canonical_sql(text: str) -> str:
    """The normal form of a text as a SQL expression."""
    # only ASCII letters change case
    x = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    x = f"regexp_replace({x}, r'{COPYRIGHT}', ' ')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(BOTH ' ' FROM regexp_replace({x}, r'[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' '))"


def known_texts(spark) -> DataFrame:
    """digest, license_id: a fixed table of a few rows."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs)
    texts = spark.sql(f"SELECT * FROM VALUES {rows(KNOWN)} AS t(license_id, text)").selectExpr(f"sha2({canonical_sql('text')}, 256) AS digest", "license_id")
    whole = spark.sql(f"SELECT digest, license_id FROM VALUES {rows(KNOWN_DIGESTS)} AS t(license_id, digest)")
    return texts.unionByName(whole).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_digest, document_license, n_notices, notice_licenses (distinct, sorted, comma-joined)."""
    known = F.broadcast(known_texts(docs.sparkSession))  # a fixed list
    digest = lambda text: F.expr(f"sha2({canonical_sql(text)}, 256)")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORDS))
    # numbered before lines are dealt, in the one pass that the result is made of; a row's parts are one partition's
    lines = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest("text").alias("text_digest"), lines.alias("lines"))
    own = F.expr(f"transform(lines, x -> sha2({canonical_sql('x')}, 256))")
    each = lines.select("row", "doc_id", "text_digest", F.posexplode(F.concat(F.array("text_digest"), own)).alias("line", "digest"))
    hits = each.join(known, "digest", "left")
    notice = F.when(F.col("line") > 0, F.col("license_id"))
    out = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_digest").alias("text_digest"), F.max(F.when(F.col("line") == 0, F.col("license_id"))).alias("document_license"), F.count(notice).alias("n_notices"), F.array_join(F.array_sort(F.collect_set(notice)), ",").alias("notice_licenses"))
    return out.drop("row")


def scan_sql() -> str:
    """The same in DuckDB by a way of its own: lines are dropped from a list, words are extracted and joined."""

    def norm(text: str) -> str:
        kept = rf"""array_to_string([x FOR x IN string_split(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))
          IF NOT regexp_matches(x, '^[ \t#*/;-]*(all rights reserved|copyright[ \t:]*(\(c\)|©|[0-9<\[{{])|(\(c\)|©)[ \t]*[0-9<\[{{])')], chr(10))"""
        spelt = f"regexp_replace(regexp_replace(replace(replace({kept}, 'noninfringement', 'non infringement'), 'and/or', 'and or'), 'sub-licen[cs]e', 'sublicense', 'g'), 'licence', 'license', 'g')"
        spelt = f"replace(replace(replace({spelt}, '&', ' and '), '(c)', ' '), 'https', 'http')"
        return rf"array_to_string(regexp_extract_all({spelt}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'), ' ')"

    rows = lambda pairs: ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in p)) for p in pairs)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT sha256({norm('text')}) AS digest, license_id FROM (VALUES {rows(KNOWN)}) AS t(license_id, text)
    UNION ALL SELECT digest, license_id FROM (VALUES {rows(KNOWN_DIGESTS)}) AS t(license_id, digest)) GROUP BY 1
), lines AS (
  SELECT rid, sha256({norm('line')}) AS digest FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
), per AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN known USING (digest) GROUP BY rid
)
SELECT w.doc_id, w.digest AS text_digest, k.license_id AS document_license, coalesce(p.n, 0) AS n_notices, coalesce(p.ids, '') AS notice_licenses
FROM (SELECT rid, doc_id, sha256({norm('text')}) AS digest FROM d) w
LEFT JOIN known k ON k.digest = w.digest LEFT JOIN per p ON p.rid = w.rid
"""
