"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs: what stands between line breaks and, as
paragraphs may be long, between sentences.  Each paragraph is hashed to a wide vector and
the fingerprint is the sum of the vectors, modulo a power of two in each place:

* ``n``: 1 for each paragraph, modulo 2^32;
* ``wide``: ``WIDE`` places, each filled by a hash of its own (the place's number is hashed with the
  paragraph), modulo 2^62; they make equality sure;
* ``lanes``: 2^30 places, modulo 2^32, of which a paragraph has 1 or -1 in one, both by further hashes;
  places that are 0 aren't kept, so at most one for each different paragraph is.

Sums don't depend on order, so texts with the same paragraphs have the same fingerprint, and
paragraphs are added or removed without reading the rest.

Likeness of two texts, with a and b their counts of every paragraph, is 2 a.b / (a.a + b.b): 1 for equal texts, 0 for
texts without a common paragraph, and without repeats twice the common paragraphs by all of both.
All three products are taken from ``lanes``.  The estimate has no bias and a standard error of 2^-14 at
most; two different paragraphs meet in a place, and count as one or cancel, with a chance of 2^-30.

DataFrame operations only.  A null text is empty; an empty text has the zero
fingerprint.  Repeated rows are rows; among equal ids the text with the larger XXH64 comes first; null
ids come last.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDE, LANE_BITS = 16, 30
PARAGRAPH_END = r"\n+|(?<=[.!?])\x20+"
#: Rows of a range that one window puts in order, about; beyond ``RANGES`` ranges, each further one is for ``MORE_ROWS``.
RANGE_ROWS, RANGES, MORE_ROWS = 512, 4096, 65_536

_MASK32, _MASK62 = (1 << 32) - 1, (1 << 62) - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, also where f has lambdas that use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(values: Column, mask: int) -> Column:
    return F.aggregate(values, _long(0), lambda a, x: (a + x.bitwiseAND(_long(mask))).bitwiseAND(_long(mask)))


def _place(entry: Column) -> Column:
    return F.shiftright(entry, 32)


def _lanes(entries: Column) -> Column:
    """Entries (place << 32 | value) in order with one a place: values of the same place are added modulo 2^32."""

    def merged(s: Column) -> Column:
        first = F.transform(s, lambda x, i: F.when(F.coalesce(_place(F.get(s, i - 1)) != _place(x), F.lit(True)), i + 1))
        return _let(F.filter(first, lambda i: i.isNotNull()), lambda starts: F.transform(starts, lambda a, j: run(s, a, F.get(starts, j + 1))))

    def run(s: Column, a: Column, b: Column) -> Column:
        same = F.slice(s, a, F.coalesce(b, F.size(s) + 1) - a)
        return F.shiftleft(_place(F.get(s, a - 1)), 32).bitwiseOR(_sum(same, _MASK32))

    return F.filter(_let(F.sort_array(entries), merged), lambda x: x.bitwiseAND(_long(_MASK32)) != 0)


def of_paragraphs(paragraphs: Column) -> Column:
    """The fingerprint (a struct) of an array of paragraphs."""
    hashed = lambda p, name: F.xxhash64(F.concat(F.lit(f"{name}:"), p))

    def entry(p: Column) -> Column:
        h = hashed(p, "lane")
        sign = F.when(h.bitwiseAND(_long(1)) == 0, _long(1)).otherwise(_long(_MASK32))
        return F.shiftleft(F.shiftrightunsigned(h, 64 - LANE_BITS), 32).bitwiseOR(sign)

    def fingerprint(ps: Column) -> Column:
        place = lambda j: F.aggregate(
            ps, _long(0), lambda a, p: (a + hashed(p, j).bitwiseAND(_long(_MASK62))).bitwiseAND(_long(_MASK62))
        )
        wide = F.array(*[place(j) for j in range(WIDE)])
        return F.struct(F.size(ps).cast("long").alias("n"), wide.alias("wide"), _lanes(F.transform(ps, entry)).alias("lanes"))

    return _let(paragraphs, fingerprint)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_END), lambda p: p != "")


def of_text(text: Column) -> Column:
    return of_paragraphs(paragraphs(F.coalesce(text, F.lit(""))))


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return F.struct(
        (a["n"] + b["n"]).bitwiseAND(_long(_MASK32)).alias("n"),
        F.zip_with(a["wide"], b["wide"], lambda x, y: (x + y).bitwiseAND(_long(_MASK62))).alias("wide"),
        _lanes(F.concat(a["lanes"], b["lanes"])).alias("lanes"),
    )


def _negated(lanes: Column) -> Column:
    value = lambda x: (F.lit(0) - x.bitwiseAND(_long(_MASK32))).bitwiseAND(_long(_MASK32))
    return F.transform(lanes, lambda x: F.shiftleft(_place(x), 32).bitwiseOR(value(x)))


def negate(a: Column) -> Column:
    """What takes the paragraphs of ``a`` away when combined."""
    return F.struct(
        (F.lit(0) - a["n"]).bitwiseAND(_long(_MASK32)).alias("n"),
        F.transform(a["wide"], lambda x: (F.lit(0) - x).bitwiseAND(_long(_MASK62))).alias("wide"),
        _negated(a["lanes"]).alias("lanes"),
    )


def add(fingerprint: Column, paragraph: Column) -> Column:
    return combine(fingerprint, of_paragraphs(F.array(paragraph)))


def remove(fingerprint: Column, paragraph: Column) -> Column:
    return combine(fingerprint, negate(of_paragraphs(F.array(paragraph))))


def as_hex(a: Column) -> Column:
    """n (8 digits), the wide places (16 digits each), then place and value (16 digits) of each lane that isn't 0."""
    digits = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: digits(x, 16)), "")
    return F.concat(digits(a["n"], 8), joined(a["wide"]), joined(a["lanes"]))


def _square(lanes: Column) -> Column:
    """Sum of the squared values, which are signed."""

    def step(acc: Column, x: Column) -> Column:
        v = x.bitwiseAND(_long(_MASK32))
        v = F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("double")
        return acc + v * v

    return F.aggregate(lanes, F.lit(0.0), step)


def likeness(a: Column, b: Column) -> Column:
    """2 a.b / (a.a + b.b) for the counts of all paragraphs, 0 to 1, from the fingerprints alone."""
    same = (a["n"] == b["n"]) & (a["wide"] == b["wide"]) & (a["lanes"] == b["lanes"])
    apart = _square(_lanes(F.concat(a["lanes"], _negated(b["lanes"]))))
    both = _square(a["lanes"]) + _square(b["lanes"])
    share = F.when(both == 0, F.lit(0.0)).otherwise(1 - apart / F.when(both != 0, both))
    return F.when(same, F.lit(1.0)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the ordered cuts are at most the id, by binary search; -1 for a null id."""
    size = 1 << max(1, len(cuts).bit_length())
    end = (1 << 63) - 1
    padded = F.lit([*cuts, *[end] * (size - len(cuts))]).cast("array<bigint>")
    steps = F.lit([size >> k for k in range(1, size.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(padded, at + s) <= doc_id, at + s).otherwise(at))
    return F.when(doc_id.isNull(), -1).otherwise(found)


def _ranges(d: DataFrame) -> DataFrame:
    """Columns ``rng`` and ``sub``: ranges of about RANGE_ROWS rows in the order of (doc_id, h).

    Ids are cut at approximate quantiles.  An id that takes several quantiles for itself is a range of its own
    and, like the null ids, cut further by the hash of the text.
    """
    n, null_ids = d.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    k = max(1, min(n // RANGE_ROWS, RANGES + n // MORE_ROWS))
    quantiles = d.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k)).first()[0] if k > 1 else []
    times = Counter(quantiles or [])
    hot = {i: t for i, t in times.items() if t > 1}
    cuts = sorted({*times, *(i + 1 for i in hot if i < (1 << 63) - 1)})
    d = d.withColumn("rng", _range_of(F.col("doc_id"), cuts))
    parts = {-1: max(1, null_ids * k // max(n, 1)), **{cuts.index(i) + 1: 2 * t for i, t in hot.items()}}
    several = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    share = F.col("h").cast("double") / float(1 << 64) + 0.5
    sub = F.floor(share * F.coalesce(F.try_element_at(several, F.col("rng")), F.lit(1)))
    return d.withColumn("sub", sub.cast("int"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp of every row, and next_text, next_fp of the next row in descending order of ids (after the last: the first).

    A window puts one range of ids in order, and only the last row of a range takes the
    first row of the next from a table with a row a range.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = _ranges(d.withColumn("h", F.xxhash64("text")))
    top = F.max_by("text", F.struct(F.coalesce("doc_id", _long(-(1 << 63))), "h", "text"))
    tops = d.groupBy("rng", "sub").agg(top.alias("top_text")).withColumn("top_fp", of_text(F.col("top_text")))
    by = W.orderBy(F.desc("rng"), F.desc("sub"))
    here, there = F.struct("rng", "sub"), lambda c: F.col(f"there.{c}").alias(f"of_{c}")
    order = d.select("rng", "sub").distinct().withColumn("there", F.coalesce(F.lead(here).over(by), F.first(here).over(by)))
    order = order.select(F.col("rng").alias("at_rng"), F.col("sub").alias("at_sub"), there("rng"), there("sub"))
    tops = order.join(tops, (F.col("of_rng") == F.col("rng")) & (F.col("of_sub") == F.col("sub"))).drop("rng", "sub", "of_rng", "of_sub")
    inside = W.partitionBy("rng", "sub").orderBy(F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("text"))
    d = d.withColumn("fp", of_text(F.col("text")))
    d = d.withColumn("next", F.lead(F.struct("text", "fp")).over(inside))
    d = d.join(tops, (F.col("rng") == F.col("at_rng")) & (F.col("sub") == F.col("at_sub")) & F.col("next").isNull(), "left")
    return d.select(
        "doc_id",
        "text",
        "fp",
        F.coalesce("next.text", "top_text").alias("next_text"),
        F.coalesce("next.fp", "top_fp").alias("next_fp"),
    )


def fingerprint_and_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of the text whose second half is the next document's start."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = with_next(docs).withColumn("edited", edited).withColumn("edited_fp", of_text(F.col("edited")))
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
