"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A text is a bag of words, each weighing its count times the square of its length, so that long words, which are rarer, count
for more. For each of `samples` draws a word has, from its hash and the draw's number, r and c from Gamma(2, 1) and b uniform on
[0, 1). Its weight w is rounded down to the grid t = floor(ln w / r + b), and the word with the least ln c - r (t - b) - r is the
draw's sample, together with t (Ioffe, 2010). Two texts agree in a sample with the probability of their weights' generalised Jaccard
similarity, so the share of agreeing samples estimates it.

One hash of word and draw gives all three numbers: r and c come from tables of `LEVELS` quantiles of the distribution, which costs a
fifth of logarithms, b from the bits left. Each draw keeps one 64-bit integer whose upper half orders the values and whose lower half
tells word and t; the least per text and draw is a hash aggregate. Neighbours are found without a window over the table: quantiles of the id cut it into ranges, each
text moves once, to its range, and the first row of each range also goes to the range before. Words are counted and drawn
behind that exchange, where a text's words already are, without another one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Draws; ranges of ids found by quantiles, and the rows and bytes above which a range is cut further.
SAMPLES, RANGES, PER_RANGE, BYTES = 64, 512, 100_000, 64 << 20
#: Steps of the quantile tables: a power of two. They stand in the plan as constants, for each draw anew, so they must be short.
LEVELS = 128


def gamma_quantile(p: float) -> float:
    """The value below which a share p of Gamma(2, 1) lies: 1 - (1 + x) exp(-x) = p, by bisection."""
    low, high = 0.0, 60.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
    return low


def _table(values: list[float]) -> Column:
    """Numbers as one constant array."""
    return F.split(F.lit(",".join(f"{x:.7g}" for x in values)), ",").cast("array<double>")


def _tables() -> tuple[Column, Column]:
    """r, and the logarithm of c, at the middles of LEVELS equal shares of the distribution."""
    steps = [gamma_quantile((k + 0.5) / LEVELS) for k in range(LEVELS)]
    return _table(steps), _table([math.log(x) for x in steps])


def draw(word: Column, log_weight: Column, number: int, tables: tuple[Column, Column]) -> Column:
    """The packed value of a word (its hash) in one draw: 32 bits that order ln a, then 32 bits that tell word and t."""
    bits, level = F.xxhash64(word, F.lit(number)), F.lit(LEVELS - 1).cast("long")
    step = LEVELS.bit_length() - 1
    r = F.get(tables[0], bits.bitwiseAND(level).cast("int"))
    log_c = F.get(tables[1], F.shiftrightunsigned(bits, step).bitwiseAND(level).cast("int"))
    b = F.shiftrightunsigned(bits, 32).cast("double") / float(1 << 32)
    t = F.floor(log_weight / r + b)
    # ln a lies between about -50 and 4: 24 bits after the point keep the order
    value = F.floor((log_c - r * (t.cast("double") - b) - r) * float(1 << 24)).cast("long")
    return F.shiftleft(value, 32).bitwiseOR(word.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def sketch(texts: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """(key, s0..): the least packed value of each draw, for each key whose `text` has words. No exchange if `texts` is dealt out by some of `key`."""
    words = texts.select(*key, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counted = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    weight = F.col("n").cast("double") * F.char_length("word") * F.char_length("word")
    weighed = counted.select(*key, F.xxhash64("word").alias("h"), F.ln(weight).alias("w"))
    tables = _tables()
    return weighed.groupBy(*key).agg(*(F.min(draw(F.col("h"), F.col("w"), k, tables)).alias(f"s{k}") for k in range(samples)))


def _ranges(rows: DataFrame) -> tuple[Column, DataFrame]:
    """The range of each id as an expression, and (first id, range before it) of each range."""
    spark = rows.sparkSession
    cuts = F.percentile_approx("id", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), F.lit(20_000))
    n, size, low, high, found = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("id"), F.max("id"), cuts).first()
    bounds = sorted(set(found or []))
    edges = [low if low is not None else 0, *bounds, (high if high is not None else 0) + 1]
    each = max(1, -(-n // (RANGES * PER_RANGE)), -(-size // (RANGES * BYTES)))
    part = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    at = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), part + 1)
    inner = F.floor((F.col("id").cast("double") - at(edges[:-1])) / (at(edges[1:]) - at(edges[:-1])) * each) if each > 1 else F.lit(0)
    place = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(part * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), inner))).cast("long")
    firsts = sorted(((r["place"], r["first"]) for r in rows.select("id", place.alias("place")).groupBy("place").agg(F.min("id").alias("first")).collect()), key=lambda r: r[0])
    before = [(firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))]
    return place, spark.createDataFrame(before, "first long, place long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of `docs`.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    row, by ascending id (integers; null first, rows that share an id by a hash of the text; the first row follows the last).
    Null texts are empty. near_* are shares of agreeing samples: 1 for two texts without words, 0 if one of two has words; their
    standard error is at most half the root of 1 / samples. A fingerprint is 8 hexadecimal digits per sample, all zeros for a text
    without words. Equal values in a draw, of one word in both texts by construction, count as agreement; ties between words go to
    the lower hash. A text of any length is split whole, its distinct words in a hash table that may spill. Repeated rows give
    repeated rows, an empty table none. Other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    place, heads = _ranges(rows)
    own = rows.select(place.alias("place"), F.lit(0).alias("tail"), "id", "text")
    # one row for each of some hundred ranges: small by construction
    ends = rows.join(F.broadcast(heads), rows["id"].eqNullSafe(heads["first"])).select("place", F.lit(1).alias("tail"), "id", "text")
    inside = W.partitionBy("place").orderBy("tail", F.asc_nulls_first("id"), F.xxhash64("text"))
    lined = own.unionByName(ends).select("*", F.lead("text").over(inside).alias("after"), F.row_number().over(inside).alias("row"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("tail") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("after", F.lit(1), half)))
    ready = lined.select("place", "row", "tail", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # texts and edited texts apart, though they share an exchange: a task's table of words is half as large
    kinds = [ready.select("place", "row", F.lit(k).alias("kind"), F.col(c).alias("text")).where("text is not null") for k, c in enumerate(("text", "edited"))]
    drawn = sketch(kinds[0], ["place", "row", "kind"], samples).unionByName(sketch(kinds[1], ["place", "row", "kind"], samples))
    # rows without words have no sketch: each row's facts join in as one more line of the aggregate
    facts = ready.select("place", "row", F.lit(-1).alias("kind"), "id", "tail", "n_chars", F.sha2("edited", 256).alias("sha"))
    names = [f"s{k}" for k in range(samples)]
    lines = drawn.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("id", "long"), ("tail", "int"), ("n_chars", "long"), ("sha", "string")))).unionByName(facts.select("*", *(F.lit(None).cast("long").alias(c) for c in names)))
    pick = lambda kind, c, name: F.min(F.when(F.col("kind") == kind, F.col(c))).alias(name)
    wide = lines.groupBy("place", "row").agg(F.min("id").alias("id"), F.min("tail").alias("tail"), F.min("n_chars").alias("n_chars"), F.max("sha").alias("sha"), *(pick(0, c, f"o_{c}") for c in names), *(pick(1, c, f"e_{c}") for c in names))
    mine, changed = F.array(*(F.col(f"o_{c}") for c in names)), F.array(*(F.col(f"e_{c}") for c in names))
    packed = wide.select("place", "row", "id", "tail", "n_chars", "sha", mine.alias("mine"), changed.alias("changed"))
    packed = packed.withColumn("next", F.lead("mine").over(W.partitionBy("place").orderBy("row"))).where("tail = 0")

    def near(other: str) -> Column:
        return F.expr(f"size(filter(zip_with(mine, {other}, (x, y) -> x <=> y), z -> z)) / double({samples})")

    def digits(column: str) -> Column:
        return F.array_join(F.transform(F.col(column), lambda x: F.lower(F.lpad(F.hex(F.coalesce(x, F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")

    return packed.select(F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), digits("mine").alias("fingerprint"), digits("changed").alias("edited_fingerprint"), near("changed").alias("near_edited"), near("next").alias("near_next"))
