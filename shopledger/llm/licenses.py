"""Licence scan by canonical digest: whole texts, and whole lines, against known licences.

Canonical form: lower case, lines that only state a copyright are dropped, everything
that is no letter or digit becomes one space, equivalent spellings become one. The SHA-256
of that form is joined by equality with the digests of known licences and notices, which
go through the same form. A line states a copyright if it begins with the word and its sign,
or with either and a year, also behind "Portions". As a holder's name may go on in further lines,
a whole text has a second form, in which such a line takes the rest of its paragraph with it. Known texts are a table given by the caller; Spark joins it by
its size. No digest of a document leaves the tasks unless it is known.

``KNOWN`` holds each text once for every usual form: with and without its title line, list
marks as numbers, letters or bullets, with and without the appendix behind the terms, and
the placeholders of an appendix in both kinds of brackets or filled in with a year. The long
texts lie in ``known_licenses``. Texts with a name filled in elsewhere are not known.

A null text is empty, and an empty canonical form is never a licence. Repeated ids give
one row with the findings of all their rows; rows without id are one such id.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings that count as one, left to right, as they stand in canonical form.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("fulfilment", "fulfillment"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)

_STATED = (
    r"^[^\p{L}\p{N}\n]*(?:(?:portions|parts)[^\p{L}\p{N}\n]+)?"
    r"(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©)"
    r"|(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|<year>|\[year\]))"
)
COPYRIGHT_LINE = rf"(?dm){_STATED}[^\n]*$"
COPYRIGHT_BLOCK = rf"(?dms){_STATED}.*"
BLANK_LINE = r"\n[^\p{L}\p{N}\n]*\n"
RESERVED_LINE = r"(?dm)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
NO_WORD = r"[^\p{L}\p{N}\n]+"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
    "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# The usual title lines of the short texts.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": (
        "BSD 2-Clause License",
        "The BSD 2-Clause License",
        'BSD 2-Clause "Simplified" License',
        "Simplified BSD License",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "The BSD 3-Clause License",
        'BSD 3-Clause "New" or "Revised" License',
        "New BSD License",
        "Revised BSD License",
    ),
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")


def _forms(name: str, text: str) -> list[str]:
    """A short text without and with its titles, its clauses numbered, lettered or bulleted."""
    marked = [text]
    if re.search(r"(?m)^1\. ", text):
        marked.append(re.sub(r"(?m)^(\d)\. ", lambda m: f"{'abc'[int(m[1]) - 1]}. ", text))
        marked.append(re.sub(r"(?m)^\d\. ", "* ", text))
    return marked + [f"{title}\n{form}" for title in TITLES.get(name, ()) for form in marked]


def _long_forms(name: str) -> list[str]:
    """A text of ``known_licenses`` as it is, without its appendix, and with it filled in."""
    text = files(__package__).joinpath("known_licenses", f"{name}.txt").read_text("utf-8")
    found = [text]
    if END_OF_TERMS in text:
        terms, appendix = text.split(END_OF_TERMS, 1)
        terms += END_OF_TERMS
        found += [terms, terms.removesuffix(END_OF_TERMS)]
        found.append(terms + appendix.replace("<", "{").replace(">", "}"))
        # A filled in copyright line is dropped from a document as any other.
        found.append(terms + appendix.replace("[yyyy]", "2000").replace("{yyyy}", "2000"))
    return list(dict.fromkeys(found))


# Public licence texts and the usual one-line notices.
_TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\nThe above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software.\n" + _AS_IS,
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.\n" + _ISC_WARRANTY,
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted.\n" + _ISC_WARRANTY,
    ),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL,),
    "BSD-3-Clause": (
        _BSD_HEAD
        + "3. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior "
        "written permission.\n" + _BSD_TAIL,
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
}

# The texts themselves come first, then their other forms.
KNOWN: dict[str, tuple[str, ...]] = {
    name: tuple(
        dict.fromkeys(
            [
                *_TEXTS.get(name, ()),
                *(form for text in _TEXTS.get(name, ())[:1] for form in _forms(name, text)),
                *(_long_forms(name) if name in LONG else ()),
            ]
        )
    )
    for name in dict.fromkeys([*_TEXTS, *LONG])
}


def known_texts(spark: SparkSession, known: Mapping[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """The known licences as a table (``license_id``, ``text``)."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    return spark.createDataFrame(rows, "license_id string, text string")


def _spelled(text: Column) -> Column:
    for variant, one in SPELLINGS:
        text = F.replace(text, F.lit(variant), F.lit(one))
    return text


def _lines(dropped: Column) -> Column:
    without = F.regexp_replace(dropped, RESERVED_LINE, "")
    lines = F.split(F.regexp_replace(without, NO_WORD, " "), "\n")
    return F.filter(F.transform(lines, lambda line: F.trim(line)), lambda line: line != "")


def canonical_lines(text: Column) -> Column:
    """The lines of a text that have words, each in lower case with single spaces."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return _lines(F.regexp_replace(lowered, COPYRIGHT_LINE, ""))


def _without_blocks(text: Column) -> Column:
    """The same, where a copyright line takes the rest of its paragraph with it."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    paragraphs = F.transform(
        F.split(lowered, BLANK_LINE), lambda p: F.regexp_replace(p, COPYRIGHT_BLOCK, "")
    )
    return _lines(F.array_join(paragraphs, "\n"))


def license_scan(
    df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """For every id: the licences its whole text is, and those its single lines are.

    ``text_licenses`` and ``line_licenses`` are sorted lists, ``n_lines`` counts lines that
    are a known text. A text of one line is both.
    """

    def digest(words: Column) -> Column:
        return F.sha2(_spelled(words), 256)

    known_forms = (
        known.select("license_id", canonical_lines(F.col("text")).alias("lines"))
        .where(F.size("lines") > 0)
        .select("license_id", digest(F.array_join("lines", " ")).alias("digest"))
        .distinct()
    )
    # Only a text that has such a line has a second form.
    states = F.lower(F.col(text_col)).rlike(COPYRIGHT_LINE)
    lines = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        canonical_lines(F.col(text_col)).alias("lines"),
        F.when(states, _without_blocks(F.col(text_col))).alias("blocks"),
    ).where(F.size("lines") > 0)

    def unit(whole: bool, words: Column) -> Column:
        return F.struct(F.lit(whole).alias("whole"), digest(words).alias("digest"))

    forms = F.array(F.array_join("lines", " "), F.array_join("blocks", " "))
    whole = F.transform(
        F.filter(F.array_distinct(forms), lambda x: x.isNotNull() & (x != "")), lambda x: unit(True, x)
    )
    single = F.transform("lines", lambda x: unit(False, x))
    units = lines.select("doc_id", F.explode(F.concat(whole, single)).alias("unit"))
    found = (
        units.select("doc_id", "unit.*")
        .join(known_forms, "digest")
        .groupBy("doc_id")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("license_id")))).alias("t"),
            F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))).alias("l"),
            F.count(F.when(~F.col("whole"), 1)).alias("n"),
        )
    )
    ids = df.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    nothing = F.array().cast("array<string>")
    return ids.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id",
        F.coalesce("t", nothing).alias("text_licenses"),
        F.coalesce("l", nothing).alias("line_licenses"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"),
    )
