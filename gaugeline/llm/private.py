"""Personal data: fixed patterns, and contexts that find what the patterns miss.

DataFrame functions alone.  The four base kinds are read by regular expressions
in the Java engine, written so that no text makes them backtrack or recurse:
runs are bounded by lookbehind, possessive, or single characters under a
lookahead; each gives the leftmost non-overlapping matches of its plain form.

Bootstrapping starts from seeds: the base spans, and as seeds of one more kind,
secrets, hexadecimal strings of the three usual digest lengths.  Candidates are
other tokens with a digit or an at sign.  A mention has lexical patterns: the
word before it, the two words before it, and the word after it.  Mentions make
a graph of patterns and instances.  In each round a pattern is scored for a kind
by the share of its occurrences that known instances of the kind follow (or
precede): known mentions over all occurrences of its words in the corpus, but
those that candidates of no known kind hold, which are what it may reveal.  So
words that ordinary text holds as well score low, however many instances they
meet.  A candidate is scored by its good patterns together,
1 - prod(1 - score), and becomes known over a mark; rounds go on until none does.

Work is linear in the length of a text: what lies between matches is cut out by
one split, places are running sums of lengths, and words are looked up by
number.  Texts are read for mentions and for counts of words, and shuffled once
into buckets by a key of each row; tables between rounds hold sums.

Defined results: null and empty texts have no spans and the digest of an empty
list; repeated rows have equal spans; doc_id may be null or shared, as rows have
a key of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import scratch, settle, with_rows

#: The base kinds, and the kind that has seeds but no base spans.
KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Plain forms: see the contract of op7.  A local part starts where its run
#: starts or where the match before it ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?=(?:[ -]?[0-9]){11})(?:(?=[ -]?[0-9])[0-9 -])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])",
}
#: What a text must hold for a kind to be looked for.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "secret": "[0-9a-f]{32}"}
#: Least score of a good pattern, least known instances of it, least score of a new instance, least length of a candidate.
GOOD_CONTEXT, LEAST_KNOWN, GOOD_INSTANCE, LEAST_LENGTH = 0.8, 3, 0.9, 4
#: Signs at a token's ends that are not part of a candidate.
_ENDS = " \t\n\x0b\x0c\r\"'`.,;:!?()[]{}<>*#%&$|=~^/\\"
#: Stands for a character of a seed while candidates are looked for.
_MASK = "\ue000"
SPAN = "array<struct<start:int,kind:int,end:int>>"
MENTION = "array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for all its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(lengths: Column, block: int = 256) -> Column:
    """The sum of all lengths before each, by blocks, so that no long array grows by steps."""
    grown = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(block)), lambda i: F.slice(lengths, i + 1, F.lit(block)))

    def sums(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return _let(F.aggregate(totals, F.array(F.lit(0)), grown), lambda firsts: F.flatten(F.transform(blocks, lambda b, k: F.slice(F.aggregate(b, F.array(F.get(firsts, k)), grown), 1, F.size(b)))))

    return _let(parts, sums)


def _located(text: Column, kind: int, made) -> Column:
    """made(start, match, gap before, gap after) of the matches of a kind that fit."""
    pattern = PATTERNS[NAMES[kind]]

    def cut(x):
        sizes = F.flatten(F.transform(x["gaps"], lambda g, k: F.array(F.length(g), F.coalesce(F.length(F.get(x["found"], k)), F.lit(0)))))
        fit = F.filter(F.sequence(F.lit(0), F.size(x["found"]) - 1), lambda k: F.coalesce(_FITS[NAMES[kind]](F.get(x["found"], k)), F.lit(False)))
        return _let(_places(sizes), lambda at: F.transform(fit, lambda k: made(F.get(at, 2 * k + 1), F.get(x["found"], k), F.get(x["gaps"], k), F.get(x["gaps"], k + 1))))

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _let(found, lambda x: F.when(F.size(x["found"]) > 0, cut(x)))


def _likely(text: Column, kind: int) -> Column:
    return F.rlike(text, F.lit(_HINTS[NAMES[kind]]))


def _small_parts(ip: Column) -> Column:
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
    return F.forall(F.split(ip, r"\."), part)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(card: Column) -> Column:
    back = F.reverse(_digits(card))
    n = F.length(back)

    def step(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0)


_FITS = {
    "email": lambda m: m.isNotNull(),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "secret": lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[a-f]")),
}


def _spans(text: Column, kind: int) -> Column:
    made = lambda at, m, before, after: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("end"))
    return F.coalesce(F.when(_likely(text, kind), _located(text, kind, made)), F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end) of the four kinds, by start and then kind."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in range(len(KINDS))]))


def secret_spans(text: Column) -> Column:
    """Spans of the seeds of the further kind."""
    return _spans(text, SECRET)


def _plain(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[0-9]+", "9")


def _patterns(second: Column, before: Column, after: Column) -> Column:
    """Lexical patterns from the words around a mention; what lacks a word is null."""
    some = lambda w: F.when(w != "", _plain(w))
    return F.array(F.concat(F.lit("<"), some(before)), F.concat(F.lit("<"), some(second), F.lit(" "), some(before)), F.concat(F.lit(">"), some(after)))


def _seed_mentions(text: Column, kind: int) -> Column:
    # signs that touch the mention are passed over, as they are at a candidate's ends
    back = r"""^["'`.,;:!?()\[\]{}<>*#%&$|=~^/\\]*+\s*+(\S++)(?:\s++(\S++))?"""

    def made(at, m, before, after):
        words = _let(F.reverse(before), lambda b: F.struct(F.reverse(F.regexp_extract(b, back, 2)).alias("second"), F.reverse(F.regexp_extract(b, back, 1)).alias("first")))
        around = _let(words, lambda w: _patterns(w["second"], w["first"], F.regexp_extract(after, back, 1)))
        return F.struct(at.alias("start"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind"), F.lower(m).alias("instance"), around.alias("patterns"))

    return F.coalesce(F.when(_likely(text, kind), _located(text, kind, made)), F.array().cast(MENTION))


def _masked(text: Column, kind: int) -> Column:
    """The text with the matches of a kind that fit as runs of _MASK, in place."""
    pattern = PATTERNS[NAMES[kind]]
    held = lambda m: F.when(F.coalesce(_FITS[NAMES[kind]](m), F.lit(False)), F.repeat(F.lit(_MASK), F.length(m))).otherwise(F.coalesce(m, F.lit("")))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(_likely(text, kind), F.array_join(F.transform(parts, lambda z: F.concat(z["gap"], held(z["m"]))), "")).otherwise(text)


def _candidates(masked: Column) -> Column:
    """Mentions of no known kind: tokens with a digit or an at sign that hold no seed."""
    token = lambda ps, i: F.coalesce(F.regexp_extract(F.get(ps, i), r"^\S*", 0), F.lit(""))
    core = lambda ps, i: F.btrim(F.get(ps, i), F.lit(_ENDS))

    def found(ps):
        some = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: F.rlike(F.get(ps, i), F.lit("[0-9@]")) & ~F.contains(F.get(ps, i), F.lit(_MASK)) & (F.length(core(ps, i)) >= LEAST_LENGTH))

        def made(at):
            def one(i):
                first = F.get(at, i) + F.length(F.get(ps, i)) - F.length(F.ltrim(F.get(ps, i), F.lit(_ENDS)))
                around = _patterns(token(ps, i - 2), token(ps, i - 1), token(ps, i + 1))
                return F.struct(first.alias("start"), (first + F.length(core(ps, i))).alias("end"), F.lit(None).cast("int").alias("kind"), F.lower(core(ps, i)).alias("instance"), around.alias("patterns"))

            return F.transform(some, one)

        return _let(_places(F.transform(ps, lambda p: F.length(p))), made)

    # a piece is a token and the white space after it
    pieces = F.split(masked, r"(?<=\s)(?=\S)", -1)
    return F.when(F.rlike(masked, F.lit("[0-9@]")), _let(pieces, found)).otherwise(F.array().cast(MENTION))


def mentions(text: Column) -> Column:
    """Seeds and candidates (kind null) with their instance and patterns."""
    masked = text
    for k in range(len(NAMES)):
        masked = _let(masked, (lambda kind: lambda t: _masked(t, kind))(k))
    return F.concat(*[_seed_mentions(text, k) for k in range(len(NAMES))], _let(masked, _candidates))


def _occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern and n: how often its rarest word occurs in all texts, at least as often as the pattern itself."""
    words = texts.select(F.explode(F.transform(F.split(_plain(F.col("text")), r"\s+", -1), lambda w: F.xxhash64(w))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    parts = wanted.select("pattern", "times", F.explode(F.transform(F.split(F.substring("pattern", 2, 1 << 30), " ", -1), lambda w: F.xxhash64(w))).alias("word"))
    return parts.join(counted, "word", "left").groupBy("pattern").agg(F.greatest(F.min(F.coalesce("n", F.lit(0))), F.max("times")).alias("n"))


def bootstrap(mention: DataFrame, texts: DataFrame) -> DataFrame:
    """instance and kind of what the patterns reveal, round by round until a round reveals nothing.

    ``mention`` has instance, kind (null: unknown) and patterns; ``texts`` is
    what ordinary words are counted in.
    """
    every = mention.select("instance", "kind", F.explode("patterns").alias("pattern")).where("pattern is not null")
    every = settle(every.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("times")), "patterns")
    # a pattern with fewer instances can never be good and reveal another
    wanted = every.groupBy("pattern").agg(F.countDistinct("instance").alias("instances"), F.sum("times").alias("times")).where(F.col("instances") > LEAST_KNOWN)
    wanted = settle(wanted.select("pattern", "times"), "wide-patterns", few=True)
    total = settle(_occurrences(texts, wanted), "occurrences", few=True)
    seen = settle(every.join(total.select("pattern"), "pattern", "left_semi"), "pattern-graph")
    seeds = settle(seen.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")), "seeds", few=True)
    known = seeds.withColumn("seed", F.lit(True))
    while True:  # each round but the last adds an instance, and there are no more than candidates
        held = seen.drop("kind").join(known.drop("seed"), "instance", "left")
        # distinct instances, so that a passage copied a thousand times is one
        sums = held.groupBy("pattern", "kind").agg(F.sum("times").alias("times"), F.countDistinct("instance").alias("known"))
        free = sums.where("kind is null").select("pattern", F.col("times").alias("free"))
        scores = sums.where("kind is not null").join(total, "pattern").join(free, "pattern").withColumn("score", F.col("times") / (F.col("n") - F.col("free") + 1))
        good = settle(scores.where((F.col("score") >= GOOD_CONTEXT) & (F.col("known") >= LEAST_KNOWN)).select("pattern", F.col("kind").alias("as"), F.least("score", F.lit(0.9999)).alias("score")), "good-patterns", few=True)
        scored = held.where("kind is null").select("instance", "pattern").distinct().join(good, "pattern").groupBy("instance", "as").agg((1 - F.exp(F.sum(F.ln(1 - F.col("score"))))).alias("score"))
        new = scored.where(F.col("score") >= GOOD_INSTANCE).groupBy("instance").agg(F.max_by("as", F.struct("score", -F.col("as"))).alias("kind"))
        new = settle(new, "revealed", few=True)
        if new.isEmpty():
            return known.where("not seed").select("instance", "kind")
        known = settle(known.unionByName(new.withColumn("seed", F.lit(False))), "known", few=True)


def find_rows(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """_row, base (spans), seeds (of further kinds) and revealed (by patterns) of a table ``with_rows``."""
    docs = rows.select("_row", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = settle(docs.select("_row", base_spans(F.col("text")).alias("base"), secret_spans(F.col("text")).alias("seeds"), mentions(F.col("text")).alias("mentions")), "mentions")
    mention = read.select("_row", F.explode("mentions").alias("m")).select("_row", "m.*")
    with scratch():
        revealed = mention.where("kind is null").select("_row", "start", "end", "instance").join(bootstrap(mention, docs), "instance")
        revealed = settle(revealed.groupBy("_row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("revealed")), "revealed-spans", keep=True)
    return read.select("_row", "base", "seeds").join(revealed, "_row", "left").select("_row", "base", "seeds", F.coalesce("revealed", F.array().cast(SPAN)).alias("revealed"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans), added (spans that the method adds) and how many of these patterns revealed, of every row."""
    rows = with_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("_row", "doc_id").join(find_rows(rows), "_row").select("doc_id", "base", F.concat("seeds", "revealed").alias("added"), F.size("revealed").cast("long").alias("n_revealed"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{k}>") for k in NAMES])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        taken = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.get(names, s["kind"]))).alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, end)).otherwise(text)


def redacted_documents(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with personal data replaced in their texts."""
    rows = with_rows(df)
    found = find_rows(rows).select("_row", F.concat("base", "seeds", "revealed").alias("_spans"))
    out = rows.join(found.hint("shuffle_hash"), "_row").withColumn("text", F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col("_spans"))))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*df.columns)
