"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent
spellings normalised) and its SHA-256 is hash-joined with the digests of known licences.
Whole texts are looked up, and so is every line, because a notice in a source file is one line.
Long licence texts are known by their digests (license_texts), notices by their names' forms. Only DataFrame operations are used; the digest table is a parameter
of as many rows as there are known licences, which bounds the broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table, whole
from .license_texts import TEXTS

#: Spellings that count as equal, after lower-casing.
SPELLINGS = {"licence": "license", "licenced": "licensed", "sub-license": "sublicense", "&": " and ", "http:": "https:", "merchantibility": "merchantability", "noninfringement": "non infringement",
             " v1": " version 1", " v2": " version 2", " v3": " version 3", " v4": " version 4",
             "released under": "licensed under", "distributed under": "licensed under", "available under": "licensed under", "published under": "licensed under",
             "this work is licensed": "licensed", "this software is licensed": "licensed", "this project is licensed": "licensed", "this program is licensed": "licensed", "this file is licensed": "licensed", "this code is licensed": "licensed",
             "licensed under the ": "licensed under ", "licensed under a ": "licensed under ", "licensed under an ": "licensed under "}
#: A copyright line: it starts with the word or the sign and names a year, a sign, or "by" a holder; a sentence that is wrapped before "copyright notice" is none.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:(?:copyright|\(c\)|©)[^\n]*(?:[12][0-9]{3}|\(c\)|©|yyyy|<year>|\[year\])[^\n]*|(?:copyright|\(c\)|©)[ \t]+by[ \t][^\n]*|all rights reserved[^\n]*|(?:copyright|©)[^a-z0-9\n]*)$"
#: No more known texts than this: the digest table is broadcast.
MOST_KNOWN = 100_000

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Public licence texts and one-line notices, by SPDX identifier.
KNOWN = [
    ("MIT", _GRANT),
    ("MIT", "MIT License " + _GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]


def _versions(names: list[str], number: str) -> list[str]:
    """The names with a version in its usual spellings; 'v3' is 'version 3' in the canonical form."""
    short = number.removesuffix(".0")
    return [n + x for n in names for v in dict.fromkeys([number, short]) for x in (f", version {v}", f" {v}")] + [n + "v" + short for n in names if n.isupper()]


_GNU = {"": ["GNU General Public License", "GNU GPL", "GPL", "General Public License"], "L": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "Lesser General Public License"], "A": ["GNU Affero General Public License", "GNU AGPL", "AGPL", "Affero General Public License"]}
#: Names of licences in notices, by SPDX identifier.
NAMES = {
    "Apache-2.0": _versions(["Apache License", "Apache"], "2.0"), "MIT": ["MIT", "Expat"], "ISC": ["ISC"], "Unlicense": ["Unlicense"], "Zlib": ["zlib"], "0BSD": ["0BSD", "Zero-Clause BSD", "BSD Zero Clause"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD", "BSD-2-Clause \"Simplified\""], "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD", "BSD 3-Clause \"New\" or \"Revised\""],
    "BSL-1.0": _versions(["Boost Software License", "Boost"], "1.0") + ["Boost Software"], "MPL-1.1": _versions(["Mozilla Public License", "MPL"], "1.1"), "MPL-2.0": _versions(["Mozilla Public License", "MPL"], "2.0"),
    "EPL-1.0": _versions(["Eclipse Public License", "EPL"], "1.0"), "EPL-2.0": _versions(["Eclipse Public License", "EPL"], "2.0"), "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"],
}
for _a, _v in [("", "1.0"), ("", "2.0"), ("", "3.0"), ("L", "2.0"), ("L", "2.1"), ("L", "3.0"), ("A", "3.0")]:
    _forms = _versions(_GNU[_a], _v)
    NAMES[f"{_a}GPL-{_v}-only"] = [*_forms, *[f"{x} only" for x in _forms]]
    NAMES[f"{_a}GPL-{_v}-or-later"] = [x + y for x in _forms for y in (" or later", " or any later version", " or (at your option) any later version")]
for _k, _long in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    for _v, _area in [("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")]:
        NAMES[f"CC-{_k}-{_v}"] = [x + y for x in (f"CC {_k} {_v}", f"Creative Commons {_k} {_v}", f"Creative Commons {_long} {_v}") for y in ("", f" {_area}")]
KNOWN += [(k, f"Licensed under {name}{end}") for k, names in NAMES.items() for name in dict.fromkeys(names) for end in (("",) if "License" in name else ("", " License"))]
KNOWN += [(k, f"SPDX-License-Identifier: {k}") for k in NAMES] + [(k.removesuffix("-only"), f"SPDX-License-Identifier: {k.removesuffix('-only')}") for k in NAMES if k.endswith("-only")]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, only letters and digits, single spaces."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def canonical_text(text: str) -> str:
    """The same on the driver, for the known texts (ASCII letters)."""
    out = re.sub(COPYRIGHT, "", text.lower())
    for a, b in SPELLINGS.items():
        out = out.replace(a, b)
    return re.sub("[^a-z0-9]+", " ", out).strip(" ")


def _rows(known: list[tuple[str, str]], shipped: list[tuple[str, str]]) -> dict[str, str]:
    """Name by digest; of equal digests the first name counts, texts before shipped digests."""
    return {d: n for n, d in reversed(shipped)} | {hashlib.sha256(canonical_text(t).encode()).hexdigest(): n for n, t in reversed(known)}


def digests(spark, known: list[tuple[str, str]], shipped: list[tuple[str, str]] = ()) -> DataFrame:
    """_digest, _license: the known texts. Of texts with one canonical form the first name counts."""
    if len(known) + len(shipped) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences: write the digests to a table and join that")
    rows = _rows(known, list(shipped))
    return spark.createDataFrame(sorted(rows.items()), T.StructType([T.StructField("_digest", T.StringType()), T.StructField("_license", T.StringType())]))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text", shipped: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """One row for each row of docs: id, digest of the canonical whole text, license (of the
    whole text, or null), n_notices (lines that are a known text), notices (their names, distinct,
    sorted, joined by commas; empty if none).

    Null texts count as empty; an empty canonical form matches nothing unless a known text is
    empty. Repeated rows each get their row. Other columns of docs are ignored."""
    known_digests = F.broadcast(digests(docs.sparkSession, known, shipped))
    base = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    found = base.select("_id", "_text", F.sha2(canonical(F.col("_text")), 256).alias("digest")).join(known_digests, F.col("digest") == F.col("_digest"), "left")
    # Every line's digest is looked up in place: the digest list is as bounded as the broadcast.
    by_digest = _rows(known, list(shipped))
    names = F.from_json(F.lit(json.dumps(by_digest)), "map<string,string>")  # one constant
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda x: F.sha2(canonical(x), 256)), lambda d: d.isin(sorted(by_digest)))
    hits = F.transform(lines, lambda d: F.element_at(names, d))
    return found.withColumn("_hits", hits).select(
        F.col("_id").alias(id_col), "digest", F.col("_license").alias("license"), F.size("_hits").cast("long").alias("n_notices"), F.concat_ws(",", F.sort_array(F.array_distinct("_hits"))).alias("notices")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'), ' ')"


ORACLE = f"""
WITH k(d, l) AS (VALUES {", ".join(f"('{hashlib.sha256(canonical_text(t).encode()).hexdigest()}', '{n}')" for n, t in {canonical_text(t): (n, t) for n, t in reversed(KNOWN)}.values())}),
b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, sha256({_sql_canonical("t")}) AS digest FROM b),
x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM b),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT l, ',' ORDER BY l) AS names FROM x JOIN k ON k.d = sha256({_sql_canonical("line")})
      WHERE regexp_matches(lower(line), 'licen[sc]e') GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.l AS license, coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notices
FROM w LEFT JOIN k ON k.d = w.digest LEFT JOIN n ON n.doc_id = w.doc_id
"""
