"""Document fingerprints: one-permutation MinHash as Column expressions.

Each five-word shingle is hashed once; eight bits of the hash choose one of 256 bins and
the rest is its value there. A bin keeps its least value. Empty bins borrow by optimal
densification: bin i looks at a fixed random sequence of bins and takes the first that is
filled, the same sequence in every document; what it stores is that value hashed with i. The sequence is eight probes and then, for
the few bins that are still empty, the filled bin of least hashed rank, which is the
first of a random order of all bins. Four low-order bits of each bin are stored, packed
into sixteen longs; likeness subtracts the share of bins that agree by chance.

Edge cases: a null text counts as empty; an empty text has the all-zero fingerprint and
likeness 1 with another empty text; fewer than five words make one shingle of all of
them. Documents are ordered by id with nulls first and several texts of an id by their
hash; repeated rows fold into one place of that order and each gets the same result. A
single document is its own next. An empty table gives an empty result; columns other
than the id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.llm.common import let, saved

BINS = 256
BITS = 4
WORDS = 5
PROBES = 8
_SHIFT = 55
_VALUE = (1 << _SHIFT) - 1
_LOW = (1 << BITS) - 1
_PER_LONG = 64 // BITS


def _probe_tables() -> list[list[int]]:
    """Fixed pseudo-random probe targets, from a multiplicative rule over (bin, round)."""
    mix = lambda x: ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 40
    return [[mix(mix(i * 977 + t * 7919 + 1) * 0xBF58476D1CE4E5B9 % (1 << 64)) % BINS for i in range(BINS)] for t in range(PROBES)]


_PROBE = _probe_tables()


def _longs(values: list[int], kind: str = "bigint") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """One 64-bit hash per run of ``words`` words."""

    def runs(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    tokens = F.split(F.trim(F.regexp_replace(text, r"[\s\x{85}\x{A0}]+", " ")), " ")
    return let(F.transform(F.filter(tokens, lambda w: w != ""), lambda w: F.xxhash64(w)), runs)


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """array<bigint> of packed low-order bits."""
    bin_of = lambda c: F.shiftright(c, _SHIFT)
    code = lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1).cast("long")), _SHIFT).bitwiseOR(F.shiftrightunsigned(h, 64 - _SHIFT))
    # one sentinel above all values of each bin: after the sort, the first code of a bin is its least value or the sentinel
    sentinels = _longs([(b << _SHIFT) | _VALUE for b in range(BINS)])
    codes = F.sort_array(F.concat(F.transform(shingle_hashes(text, words), code), sentinels))
    bins = let(codes, lambda s: F.filter(s, lambda c, i: (i == 0) | (bin_of(c) != bin_of(F.get(s, i - 1)))))
    low = lambda c: c.bitwiseAND(F.lit(_LOW).cast("long"))
    filled = lambda c: c.bitwiseAND(F.lit(_VALUE)) != _VALUE

    def densify(b: Column) -> Column:
        # a borrowed value is hashed with the bin it fills, so that bins of one donor don't agree by chance all at once
        lent = lambda c, i: low(F.xxhash64(c, i))

        def fill(own: Column, kept: Column) -> Column:
            def rest(i: Column) -> Column:
                ranked = F.transform(kept, lambda c: F.xxhash64(bin_of(c), i).bitwiseAND(F.lit(~_LOW)).bitwiseOR(lent(c, i)))
                return low(F.array_min(ranked))

            probes = lambda i: F.coalesce(*[F.get(own, F.get(_longs(t, "int"), i)) for t in _PROBE])
            return F.transform(own, lambda v, i: F.coalesce(low(v), lent_or_none(probes(i), i), rest(i), F.lit(0).cast("long")))

        def lent_or_none(c: Column, i: Column) -> Column:
            return let(c, lambda d: F.when(d.isNotNull(), lent(d, i)))

        own = F.transform(b, lambda c: F.when(filled(c), c))
        return let(own, lambda o: let(F.filter(b, filled), lambda k: fill(o, k)))

    def pack(d: Column) -> Column:
        terms = lambda s: [F.shiftleft(F.get(d, s + k), BITS * k) for k in range(_PER_LONG)]
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - _PER_LONG), F.lit(_PER_LONG)), lambda s: reduce(lambda a, b: a.bitwiseOR(b), terms(s)))

    return let(let(bins, densify), pack)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, corrected for chance agreement of the stored bits."""
    ones = F.lit(int("1" * _PER_LONG, 16)).cast("long")

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), [z, *[F.shiftrightunsigned(z, k) for k in range(1, BITS)]]).bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, d: s + d)
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), ((1.0 - apart / BINS) - chance) / (1.0 - chance))


def as_text(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


KEY = ("k0", "k1", "kh")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).isNotNull().alias("k0"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("k1"), F.xxhash64(text).alias("kh"), text.alias("text"))


def neighbours(keyed: DataFrame) -> DataFrame:
    """Each key with the keys before and after it in the cyclic order; no ordering of all rows in one task.

    Keys are cut into ranges; inside a range a window finds the neighbour, and the ends of
    ranges meet in a table of one row per range.
    """
    key = F.struct(*KEY)
    narrow = keyed.groupBy(*KEY).agg(F.max(F.length("text")).alias("n"))
    line = saved(narrow.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    ends = line.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(*KEY, "n")).alias("last"))
    order = Window.orderBy("part")  # one row per range
    whole = Window.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(order), F.min("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(order), F.max("last").over(whole)).alias("before"),
    )
    w = Window.partitionBy("part").orderBy(*KEY)
    inside = line.select("part", *KEY, "n", F.lead(key).over(w).alias("lead"), F.lag(F.struct(*KEY, "n")).over(w).alias("lag"))
    out = inside.join(F.broadcast(ends), "part")  # as many rows as shuffle partitions
    return out.select(*KEY, "n", F.coalesce("lead", "after").alias("next"), F.coalesce("lag", "before").alias("prev"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter comes from the next document."""
    keyed = _keyed(docs, id_col, text_col)
    plan = saved(neighbours(keyed))
    placed = keyed.join(plan, [*KEY])
    quarter = lambda n: F.floor(n / 4).cast("int")
    heads = placed.select(*[F.col(f"prev.{k}").alias(k) for k in KEY], F.substr("text", F.lit(1), quarter(F.col("prev.n"))).alias("head"))
    heads = heads.groupBy(*KEY).agg(F.first("head").alias("head"))  # repeated rows give one head
    edited = F.concat(F.substr("text", F.lit(1), F.col("n") - quarter(F.col("n"))), F.col("head"))
    both = placed.join(heads, [*KEY]).select(*KEY, "next", "n", "text", edited.alias("edited"))
    done = both.select(*KEY, "next", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("fp_edited"))
    done = saved(done)
    following = done.select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("fp").alias("fp_next")).groupBy(*[f"next_{k}" for k in KEY]).agg(F.first("fp_next").alias("fp_next"))
    out = done.select("*", *[F.col(f"next.{k}").alias(f"next_{k}") for k in KEY]).join(following, [f"next_{k}" for k in KEY])
    return out.select(F.when(F.col("k0"), F.col("k1")).alias(id_col), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("fp_edited")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp"), F.col("fp_next")).alias("near_next"))
