"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is a bag of words weighted by their counts.  For sample k every word
has numbers drawn from its hash: r and c from Gamma(2, 1), b uniform.  With

    t = floor(ln(weight) / r + b),   ln a = ln c - r * (t - b + 1)

the word of least a is sampled together with t.  Two bags sample the same
(word, t) with a chance equal to their generalised Jaccard similarity, the sum
of the smaller weights over the sum of the larger.

A Gamma(2, 1) number times a uniform one is exponential, and what is left of it
is another, independent one.  So the three numbers are made of three exponential
ones x, y and z: c = x + y, r * (1 - b) = ln(c / x), r * b = z.  Then t is 0 where
(weight - 1) * x < y, as it is for every word that occurs once, and a = x; else
a = x * exp(-t * r).  What is compared is 1 - exp(-a), which for t = 0 is a
uniform number: the word's hash itself.  Only repeated words take logarithms.  It
is held in 63 bits, of which the lower ones tell (word, t) apart: a sample is
their minimum, one long, so that the aggregation stays in fixed-size buffers and
in generated code, and what is kept of it are its lower 32 bits.  A likeness from
SAMPLES samples has a standard error of at most 0.5 / sqrt(SAMPLES), 0.0625.

Neighbours (the next document in descending doc_id order) come from windows
over ranges of doc_id whose bounds are quantiles, so that no task sorts all;
the first document of the next range is handed over as a row of its own.  The
shuffle by range is the only one: terms and samples are grouped inside it.

Defined results: a null text is empty; an empty bag samples nothing, has a
fingerprint of zeros, and equals another empty bag; a null doc_id comes after
all others; rows that repeat are neighbours of each other; one document alone
is its own neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import words_of

SAMPLES = 64
#: Rows of a range aimed at, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1500, 65536


def sample(term: Column, weight: Column, k: int) -> Column:
    """1 - exp(-a) in 63 bits: less is nearer."""
    plain = F.shiftrightunsigned(F.xxhash64(term, F.lit(k)), 1)
    more = F.xxhash64(term, F.lit(k + 1_000_000))
    x = -F.log1p(-(plain + 0.5) * 2.0**-63)
    y = -F.ln((F.shiftrightunsigned(more, 32) + 0.5) * 2.0**-32)
    z = -F.ln((more.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) * 2.0**-32)
    r = F.log1p(y / x) + z
    t = F.floor((F.ln(weight) + z) / r)
    again = F.least(-F.expm1(-x * F.exp(-t * r)), F.lit(1 - 2.0**-53)) * 2.0**63
    return F.when(weight == 1, plain).when((weight - 1) * x < y, plain).otherwise(again.cast("long"))


def terms(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Rows (keep, term, weight): hashed words of a text with their counts.

    Counting is done inside the row, on the sorted array of hashes: a word's
    count is the distance to the start of the next run.
    """
    hashed = df.select(*keep, F.sort_array(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))).alias("_h"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", i - 1)))
    runs = hashed.select(*keep, "_h", F.when(F.size("_h") > 0, starts).alias("_s"))
    each = runs.select(*keep, "_h", "_s", F.posexplode_outer("_s").alias("_k", "_i"))
    count = F.coalesce(F.get("_s", F.col("_k") + 1), F.size("_h")) - F.col("_i")
    return each.select(*keep, F.get("_h", F.col("_i")).alias("term"), count.alias("weight"))


def code_text(codes: list[Column]) -> Column:
    """Eight hexadecimal digits a sample."""
    return F.lower(F.concat(*[F.lpad(F.hex(c), 8, "0") for c in codes]))


def fingerprints(df: DataFrame, text: Column, *key: str, samples: int = SAMPLES) -> DataFrame:
    """key and fingerprint; rows of one key share a text."""
    drawn = terms(df, text, *key).groupBy(*key).agg(*[F.min(sample(F.col("term"), F.col("weight"), k)).alias(f"_{k}") for k in range(samples)])
    return drawn.select(*key, code_text([F.coalesce(F.col(f"_{k}"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples)]).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    same = [(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def _ranges(df: DataFrame, id_col: str) -> list[int]:
    """Bounds of ranges: one pass over the ids, a bounded list."""
    rows = df.count()
    n = min(MOST_RANGES, max(1, rows // RANGE_ROWS))
    if n == 1:
        return []
    bounds = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 20 * n + 10_000)).first()[0]
    return sorted(set(bounds or []))


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most doc_id, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    step = lambda at, s: F.when(F.get(table, at + s - 1) <= doc_id, at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text, and for later windows: range, place (in it), extra.

    The last row of a range sees the first of the next, which is added to its
    range as an extra row; callers drop extra rows in the end.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    bounds = _ranges(ids, "doc_id")
    place = range_of(F.col("doc_id"), bounds).alias("range")
    # a row a range, at most MOST_RANGES: its first document, downwards
    firsts = ids.groupBy(place).agg(F.max("doc_id").alias("first")).orderBy(F.desc("range")).collect()
    heads = df.sparkSession.createDataFrame([(row["first"], firsts[k - 1]["range"]) for k, row in enumerate(firsts)], "_first long, range int")
    extra = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_first"))).select("doc_id", "text", "range", F.lit(1).alias("extra"))
    every = docs.select("doc_id", "text", place, F.lit(0).alias("extra")).unionByName(extra)
    down = W.partitionBy("range").orderBy("extra", F.desc_nulls_last("doc_id"), "text")
    return every.select("range", "extra", "doc_id", "text", F.lead("text").over(down).alias("next_text"), F.row_number().over(down).alias("place"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and both likenesses."""
    rows = with_next(df, id_col, text_col).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    texts = F.when(F.col("extra") == 1, F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"))))
    key = ("range", "extra", "place", "doc_id", "n_chars", "edited_sha256")
    sides = rows.select(*key, F.explode(texts).alias("_x")).select(*key, "_x.side", F.col("_x.t").alias("t"))
    marked = fingerprints(sides, F.col("t"), *key, "side", samples=samples)
    # a text's row, its edited text's row, then the next document's
    down = W.partitionBy("range").orderBy("place", "side")
    marked = marked.select(*key, "side", "fingerprint", F.lead("fingerprint", 1).over(down).alias("edited_fingerprint"), F.lead("fingerprint", 2).over(down).alias("next_fingerprint"))
    return marked.where("side = 0 and extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
