"""License scan by MinHash bands over text windows, DataFrame functions only (dealt
operator 6, native).

A template (a license notice or a paragraph of a license's text, ``license_texts``) is cut
into pieces of at most 24 words; a piece is a set of five-word shingles. A piece that texts of
several licenses hold is named after all of them ("MIT OR Unlicense") or after the family of
three or more (GNU, BSD, Creative Commons), and what a license has alone after itself. Texts are read in
overlapping windows, whose width follows from a piece's size class so that every occurrence of
a piece lies in some window. Windows and pieces get MinHash values; bands of one row each bring
a window to a piece if they share a shingle that is least in both under some hash. The number
of bands of a class follows from the smallest possible similarity of a match, so that a match
is missed with probability under ``MISS``. Candidates are verified by exact containment: at
least ``CONTAINED`` of the piece's shingles are in the window.

Before any hashing, texts must hold as a substring one of a few words that cover all pieces (a
piece is covered by a word without which 80 % of its shingles can't be there), and windows must
hold a shingle of some piece; neither loses a match. The template table is a parameter of at
most ``MAX_TEMPLATES`` rows, so it is broadcast.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered. Defined cases: null
and empty texts and texts of under five words match nothing; equal rows give equal rows; of
several windows the best containment and the earliest window count; an empty table gives no
rows; only the named columns are read."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailcast.llm.license_texts import all_texts
from trailcast.llm.scratch import prepare
from trailcast.llm.textops import word_list

#: Texts and notices that are in common use (license id, text).
TEMPLATES = all_texts()
#: Families: a piece that three or more licenses hold, all of one family, gets its name.
FAMILIES = {"GNU": ("GPL-", "LGPL-", "AGPL-"), "BSD": ("BSD-",), "Creative Commons": ("CC-", "CC0-")}
SHINGLE, CONTAINED, MISS, MAX_TEMPLATES, LONG_WORD = 5, 0.8, 1e-6, 2000, 7
#: Size classes: most words of a piece, window width, step.
CLASSES = ((8, 10, 2), (16, 20, 4), (24, 32, 8))
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def anchor_words(words: list[str]) -> list[str]:
    """The words whose absence breaks more shingles than a match may miss; the long ones if
    there are any, else the longest."""
    n = len(words) - SHINGLE + 1
    may_miss = n - math.ceil(CONTAINED * n)
    cover: dict[str, set] = {}
    for p, w in enumerate(words):
        cover.setdefault(w, set()).update(range(max(0, p - SHINGLE + 1), min(p, n - 1) + 1))
    able = sorted((w for w, c in cover.items() if len(c) > may_miss), key=lambda w: (-len(w), w))
    return [w for w in able if len(w) >= LONG_WORD] or able[:1]


def anchors_of(pieces: list[dict]) -> list[str]:
    """Few words, so that every piece has one of its anchor words among them."""
    left, out = [p["anchors"] for p in pieces], []
    while left:
        number = Counter(w for own in left for w in own)
        out.append(max(number, key=lambda w: (number[w], len(w), w)))
        left = [own for own in left if out[-1] not in own]
    return out


def name_of(holders: set[str]) -> str:
    """The license id of a piece that all of ``holders`` contain."""
    for family, starts in FAMILIES.items():
        if len(holders) > 2 and all(h.startswith(starts) for h in holders):
            return family
    return " OR ".join(sorted(holders))


def pieces_of(templates=TEMPLATES) -> list[dict]:
    """Pieces: license, size class, their distinct shingles and anchor words. A piece that another
    license's text would match too is named after all of them, once."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    out, most = {}, CLASSES[-1][0]
    held: dict[str, dict[str, set]] = {}               # shingle -> license -> its texts
    cuts = []
    for at_text, (license_id, text) in enumerate(templates):
        words = word_list(text)
        for s in shingles(words):
            held.setdefault(s, {}).setdefault(license_id, set()).add(at_text)
        n = max(1, -(-len(words) // most))
        size = -(-len(words) // n)
        cuts += [(license_id, words[at:at + size]) for at in range(0, len(words), size)]
    for license_id, own in cuts:
        if len(own) < SHINGLE:
            continue
        wanted = shingles(own)
        shared: dict[tuple, int] = {}
        for s in wanted:
            for other, texts in held[s].items():
                for t in texts:
                    shared[other, t] = shared.get((other, t), 0) + 1
        holders = {license_id} | {other for (other, _), n in shared.items() if n >= CONTAINED * len(wanted)}
        key = (name_of(holders), tuple(wanted))
        out.setdefault(key, {"license_id": key[0], "class": next(k for k, c in enumerate(CLASSES) if len(own) <= c[0]), "shingles": wanted, "anchors": anchor_words(own)})
    return list(out.values())


def bands_needed(pieces: list[dict], k: int) -> int:
    """Bands of one row after which a match in class k is missed with probability < MISS."""
    width = CLASSES[k][1] - SHINGLE + 1
    least = 1.0
    for p in pieces:
        if p["class"] == k:
            n = len(p["shingles"])
            shared = math.ceil(CONTAINED * n)
            least = min(least, shared / (width + n - shared))
    return math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1


def _windows(words: Column, known: list[str], classes: list[int]) -> Column:
    """Windows (class, start, words) that hold a known shingle."""
    def cut(at, k):
        _, width, step = CLASSES[k]
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - width) / step)).cast("int")
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - 1 - (width - SHINGLE)) / step)).cast("int")
        numbers = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(first(p), F.least(last, F.floor((p - 1) / step).cast("int"))))))
        return F.transform(numbers, lambda j: F.struct(F.lit(k).alias("class"), (j * step).alias("start"), F.slice(words, j * step + 1, width).alias("words")))

    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    at = F.filter(places, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ").isin(known))
    return F.element_at(F.transform(F.array(at), lambda a: F.when(F.size(a) > 0, F.concat(*(cut(a, k) for k in classes)))), 1)


def _shingle_hashes(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))).otherwise(F.array().cast("array<bigint>"))


def _bands(hashes: Column, size_class: Column, numbers: list[int]) -> Column:
    """(class, band, least hash under the band's hash function) of a set of shingle hashes."""
    number = F.get(F.array(*map(F.lit, numbers)), size_class)
    return F.transform(F.sequence(F.lit(0), number - 1), lambda b: F.xxhash64(size_class, b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(b, h)))))


def scan(docs: DataFrame, templates=TEMPLATES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` and license it holds: id, license_id, containment (of the
    best piece and window), first_word (the earliest matching window's first word)."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = pieces_of(templates)
    classes = sorted({p["class"] for p in pieces})
    numbers = [bands_needed(pieces, k) if k in classes else 1 for k in range(len(CLASSES))]
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    low = F.lower("text")
    holds = F.lit(False)
    for a in anchors_of(pieces):
        holds = holds | F.contains(low, F.lit(a))
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0))
    known = sorted({s for p in pieces for s in p["shingles"]})
    # one-element transform: the words are made once
    windows = F.element_at(F.transform(F.array(words), lambda w: _windows(w, known, classes)), 1)
    held = (narrow.where(holds).select("row", "id", F.explode(windows).alias("w"))
            .select("row", "id", "w.class", "w.start", _shingle_hashes(F.col("w.words")).alias("held"))
            .withColumn("band", F.explode(_bands(F.col("held"), F.col("class"), numbers))))
    rows = [F.struct(F.lit(p["license_id"]).alias("license_id"), F.lit(p["class"]).alias("class"), F.lit("\n".join(p["shingles"])).alias("wanted")) for p in pieces]
    wanted = (spark.range(1).select(F.explode(F.array(*rows)).alias("p"))
              .select("p.license_id", "p.class", F.transform(F.split("p.wanted", "\n"), lambda s: F.xxhash64(s)).alias("wanted"))
              .withColumn("band", F.explode(_bands(F.col("wanted"), F.col("class"), numbers))))
    hits = (held.join(F.broadcast(wanted), ["class", "band"])
            .withColumn("shared", F.size(F.array_intersect("held", "wanted")))
            .where(F.col("shared") >= CONTAINED * F.size("wanted"))
            .select("row", "id", "license_id", "start", (F.col("shared") / F.size("wanted")).alias("containment")))
    return (hits.groupBy("row", "id", "license_id").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"))
            .select(F.col("id").alias(id_col), "license_id", "containment", "first_word"))


def oracle_sql(templates=TEMPLATES) -> str:
    """The same matches in DuckDB SQL: every window against every piece, by exact containment."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(p['license_id'])}, {CLASSES[p['class']][1]}, [{', '.join(map(quote, p['shingles']))}])" for p in pieces_of(templates))
    classes = ", ".join(f"({w}, {s})" for _, w, s in CLASSES)
    return f"""
WITH piece(license_id, width, wanted) AS (VALUES {rows}),
class(width, step) AS (VALUES {classes}),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM documents WHERE text IS NOT NULL),
win AS (SELECT r, doc_id, width, unnest(range(0, greatest(0, ceil((len(words) - width) / step::DOUBLE)::BIGINT) + 1)) * step AS start, words FROM doc, class),
cut AS (SELECT r, doc_id, width, start, words[start + 1:start + width] AS w FROM win),
held AS (SELECT r, doc_id, width, start, list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM cut WHERE len(w) >= {SHINGLE}),
hit AS (SELECT r, doc_id, license_id, start, len(list_intersect(s, wanted)) / len(wanted)::DOUBLE AS containment FROM held JOIN piece USING (width) WHERE list_has_any(s, wanted))
SELECT doc_id, license_id, max(containment) AS containment, min(start)::BIGINT AS first_word FROM hit
WHERE containment >= {CONTAINED} GROUP BY r, doc_id, license_id"""
