"""License scans with DataFrame functions only.

Templates are a table of license texts, taken as sets of word shingles. A document is cut into overlapping windows; windows and templates that share a MinHash band name a place, and there the exact share
of the template's shingles within its own length of the document is counted.

Windows have three blocks of B shingles for templates of more than B and up to 2 B, B = BLOCK times a power of two, and start at every block, so each stretch of a template's length lies wholly within one. A window
that holds four fifths of a template thus has a Jaccard similarity of at least 0.8 B / (3 B + 0.2 B) = 0.25 to it, in whatever order, and none of BANDS bands of one value meets with a probability of at
most 0.75 ** 48 = 1e-6, though two bands share each hash function. Templates of up to BLOCK shingles are too short for such a bound; each of their shingles is a key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

# License notices and texts to look for.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "public-domain": "This work has been released into the public domain",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
SHINGLE = 3  # words
BLOCK = 32  # shingles of the shortest blocks of which windows are made
BANDS = 48


def shingles(text: Column) -> Column:
    """Hashes of all word shingles in order; a text with fewer words gives its words as one shingle, a text without words none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    words = F.filter(words, lambda w: w != "")
    return F.flatten(
        F.transform(
            F.array(words),
            lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(ws, i + k) for k in range(SHINGLE)))))
            ),
        )
    )


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license, text) of a few templates, by default the notices above."""
    return spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")


def known_templates(templates: DataFrame) -> DataFrame:
    """(license, of, h): each template's distinct shingles and their number; templates without words are left out."""
    sets = templates.select("license", F.array_distinct(shingles(F.col("text"))).alias("h"))
    return sets.filter(F.size("h") > 0).select("license", F.size("h").alias("of"), "h").distinct()


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _minima(h: Column) -> Column:
    """A value for each band; two bands share a hash function. One takes the least of the hashes when they are hashed again, the other the complement of the greatest, so lesser values win in both.

    The first and the last of a random order are two draws without replacement, so the chance that both miss the shared shingles is no more than that of two draws of their own.
    """
    ends = lambda again: F.array(F.array_min(again), F.bitwise_not(F.array_max(again)))
    return F.flatten(F.transform(F.array(*map(F.lit, range(BANDS // 2))), lambda band: _let(F.transform(h, lambda x: F.xxhash64(x, band)), ends)))


def _band_keys(minima: Column, size: Column | int, at: Column | None = None) -> Column:
    """One key per band: the band's number and least value, and the size of the window; with the window's place, where it has one."""
    key = lambda least, band: F.xxhash64(least, band, size if isinstance(size, Column) else F.lit(size))
    return F.transform(minima, key if at is None else lambda least, band: F.struct(at.alias("at"), key(least, band).alias("key")))


def _indexes(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _lesser(one: Column, other: Column) -> Column:
    """The lesser of two lists place by place; the first if the other is null."""
    return F.when(other.isNull(), one).otherwise(F.zip_with(one, other, lambda x, y: F.least(x, y)))


def band_keys(rows: DataFrame, longest: int) -> DataFrame:
    """rows with a column `keys`: (at, key) of each window of column h, for templates of up to `longest` shingles."""
    count = F.ceil(F.size("h") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", F.transform(_indexes(count), lambda i: _let(F.slice("h", i * BLOCK + 1, F.lit(BLOCK)), _minima)))
    rows, size = rows.withColumn("keys", F.array().cast("array<struct<at:int,key:bigint>>")), BLOCK
    while size < longest:
        block = lambda i: F.get("blocks", i)
        window = lambda i: _lesser(_lesser(block(i), block(i + 1)), block(i + 2))
        found = F.flatten(F.transform(_indexes(F.size("blocks")), lambda i: _band_keys(window(i), size, (i * size).cast("int"))))  # noqa: B023
        rows = rows.withColumn("keys", F.concat("keys", found))
        rows = rows.withColumn("blocks", F.transform(_indexes(F.ceil(F.size("blocks") / 2).cast("int")), lambda i: _lesser(block(2 * i), block(2 * i + 1))))  # noqa: B023
        size *= 2
    return rows.drop("blocks")


def template_keys(known: DataFrame, longest: int) -> DataFrame:
    """(key, license, of, width): what retrieves the templates (license, of, h), and how many shingles a hit covers."""
    size = F.lit(BLOCK)
    bound = 2 * BLOCK
    while bound < longest:
        size, bound = F.when(F.col("of") > bound, bound).otherwise(size), 2 * bound
    short = known.filter(F.col("of") <= BLOCK).select(F.explode("h").alias("key"), "license", "of", F.lit(1).alias("width"))
    banded = known.filter(F.col("of") > BLOCK).withColumn("size", size).select(F.explode(_band_keys(_minima(F.col("h")), F.col("size"))).alias("key"), "license", "of", (3 * F.col("size")).alias("width"))
    return short.unionByName(banded)


def candidates(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hits of template keys in windows and shingles: (id, row, license, of, at, piece), the piece being the shingles from `at` on that the hit covers."""
    longest = known.agg(F.coalesce(F.max("of"), F.lit(0))).first()[0]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), shingles(F.col(text_col).cast("string")).alias("h"))
    single = F.transform("h", lambda s, i: F.struct(i.alias("at"), s.alias("key")))
    rows = band_keys(rows, longest).withColumn("keys", F.concat(single, "keys"))
    # Of an inner generator Spark derives a filter below the columns above and would compute them again in it, once per use.
    hits = rows.select("id", "row", "h", F.inline_outer("keys")).join(template_keys(known, longest), "key")
    return hits.select("id", "row", "license", "of", "at", F.slice("h", F.col("at") + 1, F.col("width")).alias("piece"))


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses found: (id, license, containment), one row per row and license, with the largest containment in any window of the template's length.

    templates: license, text; any number of them, of any length. Their keys are broadcast only if Spark finds the table small. The largest containment is a running count: a place counts in all windows that start
    after the last place of the same shingle. The bands are set for a containment of 0.8 and more. Null and empty texts match nothing; a null id is kept; repeated rows give repeated results; texts of any
    length are read whole; templates without words match nothing; other columns, whatever their names, are left out; an empty table gives no rows.
    """
    listed = templates if templates is not None else template_table(docs.sparkSession)
    known = cut(known_templates(listed))
    hits = candidates(docs, known, id_col, text_col).select("id", "row", "license", "of", F.col("at").alias("first"), F.posexplode("piece").alias("on", "s"))
    places = hits.join(known.select("license", "of", F.explode("h").alias("s")), ["license", "of", "s"]).select("id", "row", "license", "of", (F.col("first") + F.col("on")).alias("at"), "s").distinct()
    places = places.withColumn("last", F.lag("at").over(Window.partitionBy("row", "license", "of", "s").orderBy("at")))
    begin = F.greatest(F.col("at") - F.col("of"), F.coalesce("last", F.col("at") - F.col("of"))) + 1
    events = places.select("id", "row", "license", "of", F.inline(F.array(F.struct(begin.alias("start"), F.lit(1).alias("change")), F.struct((F.col("at") + 1).alias("start"), F.lit(-1).alias("change")))))
    held = events.withColumn("held", F.sum("change").over(Window.partitionBy("row", "license", "of").orderBy("start")))
    share = F.round(F.max("held") / F.col("of"), 6)
    return held.groupBy("id", "row", "license", "of").agg(share.alias("containment")).filter(F.col("containment") >= containment).select(F.col("id").alias(id_col), "license", "containment")
