"""License scan by canonical digest.

A text is brought into a canonical form (case, copyright lines, equivalent spellings,
punctuation and white space) and hashed; the digest of the whole text is joined to the digests
of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

# Whole words that count as the same (left becomes right).
SPELLINGS = (
    ("acknowledgment", "acknowledgement"),
    ("acknowledgments", "acknowledgements"),
    ("analog", "analogue"),
    ("analogs", "analogues"),
    ("analyze", "analyse"),
    ("artifact", "artefact"),
    ("artifacts", "artefacts"),
    ("authorization", "authorisation"),
    ("authorizations", "authorisations"),
    ("authorize", "authorise"),
    ("authorized", "authorised"),
    ("authorizing", "authorising"),
    ("behavior", "behaviour"),
    ("catalog", "catalogue"),
    ("center", "centre"),
    ("centered", "centred"),
    ("centers", "centres"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("defense", "defence"),
    ("favor", "favour"),
    ("fulfill", "fulfil"),
    ("fulfills", "fulfils"),
    ("fulfillment", "fulfilment"),
    ("initialize", "initialise"),
    ("judgment", "judgement"),
    ("labeled", "labelled"),
    ("labor", "labour"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("modeled", "modelled"),
    ("noncommercial", "non commercial"),
    ("organization", "organisation"),
    ("organizations", "organisations"),
    ("organize", "organise"),
    ("per cent", "percent"),
    ("practice", "practise"),
    ("program", "programme"),
    ("programs", "programmes"),
    ("recognize", "recognise"),
    ("sublicense", "sub license"),
    ("sublicence", "sub license"),
    ("unauthorized", "unauthorised"),
    ("utilization", "utilisation"),
    ("while", "whilst"),
    ("wilful", "willful"),
)
# Places where licences name a holder, in canonical form; the name may have so many characters.
NAMED = (
    (r"\bneither the names? of .{1,120}? nor the names? of (?:its|their) contributors\b", "neither the name of the copyright owner nor the names of its contributors"),
    (r"\bthis product includes software developed by .{1,120}? 4 neither the name of the copyright owner nor the names of its contributors\b", "this product includes software developed by the copyright owner 4 neither the name of the copyright owner nor the names of its contributors"),
    (r"\bthis software is provided by .{1,120}? and contributors as is\b", "this software is provided by the copyright owners and contributors as is"),
    (r"\bin no event shall .{1,120}? or contributors be liable\b", "in no event shall the copyright owner or contributors be liable"),
)
# A line that only names a copyright holder, or reserves all rights.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|:|[0-9<\[])|\(c\)[ \t]|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
# The usual headings of the licences below.
HEADINGS = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "ISC": ("ISC License", "The ISC License"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution",),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License", "The zlib License"),
}


def _notices() -> list[tuple[str, str]]:
    """Standard notices of licences that come in families: free software licences by version, shared works by terms."""
    out = []
    families = (("GPL", "GNU General Public License", "program", (("2", "2.0"), ("3", "3.0"))), ("AGPL", "GNU Affero General Public License", "program", (("3", "3.0"),)), ("LGPL", "GNU Lesser General Public License", "library", (("2.1", "2.1"), ("3", "3.0"))))
    for short, long, what, versions in families:
        for version, name in versions:
            for thing in {what, "program"}:
                for colon in (":", ";"):
                    grant = f"This {thing} is free software{colon} you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation{colon.replace(':', ',')} either version {version} of the License, or (at your option) any later version."
                    rest = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {long} for more details. You should have received a copy of the {long} along with this {thing}. If not, see"
                    out += [(f"{short}-{name}-or-later", f"{grant} {rest} <https://www.gnu.org/licenses/>."), (f"{short}-{name}-or-later", f"{grant} {rest} https://www.gnu.org/licenses")]
    terms = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    for short, long in terms.items():
        for version, place in (("4.0", "International"), ("3.0", "Unported")):
            license_id = f"CC-{short}-{version}"
            for article in ("a", "the"):
                notice = f"This work is licensed under {article} Creative Commons {long} {version} {place} License."
                link = f"http://creativecommons.org/licenses/{short.lower()}/{version}/"
                out += [(license_id, notice), (license_id, f"{notice} To view a copy of this license, visit {link}."), (license_id, f"{notice} To view a copy of this license, visit {link} or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")]
            out += [(license_id, f"Licensed under CC {short} {version}."), (license_id, f"This work is licensed under CC {short} {version}.")]
    return out


# Texts and standard notices of known licences.
TEXTS = (
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_WARRANTY}"),
    ("BSD-4-Clause", f"{_BSD_HEAD} {_BSD_ADVERTISING} {_BSD_WARRANTY}"),
    ("BSL-1.0", _BOOST),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT-0", f"{_MIT_GRANT}. {_MIT_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at: https://scripts.sil.org/OFL"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def _variants() -> tuple[tuple[str, str], ...]:
    """All known texts: with each usual heading before them, the notices of families, and both spellings of a link."""
    texts = [*TEXTS, *((name, f"{heading}\n\n{text}") for name, text in TEXTS if len(text) > 200 for heading in HEADINGS.get(name, ())), *_notices()]
    links = [(name, text.replace(old, new)) for name, text in texts for old, new in (("https://", "http://"), ("http://", "https://")) if old in text]
    return tuple(sorted({*texts, *links}))


KNOWN = _variants()
# Digests of the canonical form of complete licences, whose texts are not kept here.
COMPLETE = (
    ("Apache-2.0", "6a2b385728fc3ce16ad82373ee2a285c95bdda612e21b12737a0a8f1635a882c"),
    ("Artistic-1.0-Perl", "a75491f92d778a49986448552ba445f84eaf73e7420e7d7a2e2b775abce055bb"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "8efefefd57cbdf18792ea07015a7d752495ec849a5f73fb0282b3539870adbc6"),
    ("GFDL-1.3", "01956c72e438963c9b3c93274615d7137119e5a7b3fc52335952662c93c7f4c8"),
    ("GPL-1.0", "75861864828ddf22451f95a69662530fe0da10b6c740275fa62ae786b88f3879"),
    ("GPL-2.0", "9c9e5e5d8cbf4b874a65be305d9ed24405b10646220d3702d3d0073bec35ae9a"),
    ("GPL-3.0", "a82aa8fc19feee755f6712318be778b15404a721db5c17293e3243823adcd3a3"),
    ("LGPL-2.0", "986434b9c9969d8bb579036700a6e4c0c549d80770fc06a906c2b12564e6a00d"),
    ("LGPL-2.1", "8f1bd503c397b33952151c784d2fea3540c1121a2a6622ffb12ccd45557b92a6"),
    ("LGPL-3.0", "115a35581f94838e88c3d19d0e554a67e6ae8e24eecba6fb65a7930a7c55fd85"),
    ("MPL-1.1", "af7037174ac592ca60ccb52d0953977740bfdaefc373daae18a413ee42787279"),
    ("MPL-2.0", "f9bf8fe494af7d2ad5844019173c3900fc0b1452cebce7e24057a41ee841c86c"),
)


def _any_spelling() -> str:
    """One pattern for the left side of every rule, branched by first letter so that most words fail at once."""
    heads = sorted({left[0] for left, _ in SPELLINGS})
    branches = (f"{h}(?:{'|'.join(left[1:] for left, _ in SPELLINGS if left[0] == h)})" for h in heads)
    return rf"\b(?:{'|'.join(branches)})\b"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null and texts without a word become the empty string."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " "), NOT_WORD, " "))
    spelled = bare
    for left, right in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"\b{left}\b", right)
    spelled = F.when(bare.rlike(_any_spelling()), spelled).otherwise(bare)
    named = spelled
    for pattern, right in NAMED:
        named = F.regexp_replace(named, pattern, right)
    return F.when(spelled.contains("contributors"), named).otherwise(spelled)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN, complete=COMPLETE) -> DataFrame:
    """(digest, license_id), one row per digest, of licences given as (license_id, text) and (license_id, digest)."""
    rows = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(list(complete), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest and license_id (null: none) of every row of `docs(doc_id, text)`.

    `known(digest, license_id)` has one row per digest; the physical join follows its size.
    Null or wordless texts match nothing. Repeated rows give repeated results; other columns
    are ignored; an empty table gives an empty result.
    """
    keyed = docs.select("doc_id", canonical(F.col("text")).alias("canonical"))
    keyed = keyed.select("doc_id", F.when(F.col("canonical") != "", F.sha2("canonical", 256)).alias("digest"))
    return keyed.join(known.select("digest", "license_id"), "digest", "left").select("doc_id", "digest", "license_id")


def oracle() -> str:
    """The same over a `documents` view, in DuckDB SQL."""
    body = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    body = f"trim(regexp_replace(regexp_replace({body}, '{COPYRIGHT_LINE}', ' ', 'g'), '{NOT_WORD}', ' ', 'g'))"
    for left, right in SPELLINGS:
        body = rf"regexp_replace({body}, '\b{left}\b', '{right}', 'g')"
    for pattern, right in NAMED:
        body = f"regexp_replace({body}, '{pattern}', '{right}', 'g')"
    values, complete = (", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in rows) for rows in (KNOWN, COMPLETE))
    return f"""
with known as (select digest, min(license_id) as license_id from (select sha256({body}) as digest, license_id from (values {values}) v(license_id, text) union all select digest, license_id from (values {complete}) c(license_id, digest)) group by 1),
docs as (select doc_id, {body} as body from documents)
select d.doc_id, case when body <> '' then sha256(body) end as digest, k.license_id
from docs d left join known k on k.digest = case when body <> '' then sha256(body) end"""
