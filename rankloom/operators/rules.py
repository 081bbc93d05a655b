"""Classification by a table of rules of any size: the first rule whose text stands in a value gives its label.

A chain of conditions tries every rule on every value. Here values are cut up instead: at each place, the first bytes
tell how long the rules are that begin so, and the run of that length is then a rule's text or not. Both are asked in
bit tables of a fixed size, so of all places only those that hold a rule, but for chance hits, leave the task that
reads them. Rules meet these runs in an equi-join, so no rule is tried on a value that does not hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that tell the lengths of the rules; shorter rules go by all of theirs.
START = 3
#: Bytes that a rule is looked up by, a bit for each length. A longer rule is looked up by one block, then verified.
HEAD = 64
#: Words of 64 bits in a bit table, a power of two.
WORDS = 1 << 14
#: Places of a value that are listed at once, so that a long value takes little more memory than a short one.
PLACES = 4096

# where a start and a head have their bits, in one table behind the other, and what follows them
START_WORD, START_BIT = f"xxhash64(start) & {WORDS - 1}", "octet_length(head) - 1"
HEAD_WORD, HEAD_BIT = f"{WORDS} + (shiftright(xxhash64(head), 6) & {WORDS - 1})", "int(xxhash64(head) & 63)"
SIZES, LENGTHS, LONG = range(2 * WORDS, 2 * WORDS + 3)


def _key(text: Column) -> Column:
    """A text itself if it is below 32 bytes, else its hash of 256 bits, so both kinds are never alike."""
    return F.when(F.octet_length(text) < 32, text.cast("binary")).otherwise(F.unhex(F.sha2(text, 256)))


def _looked_up(rules: DataFrame) -> DataFrame:
    """(start, head, whole, first) of the rules (text, first): the run of bytes that each is looked up by, its start,
    and for rules beyond HEAD the whole text. Of these, that block counts which the fewest of them have, since many may
    begin alike."""
    short = rules.where(f"octet_length(text) <= {HEAD}").selectExpr("text AS head", "cast(NULL AS binary) AS whole", "first")
    last = f"octet_length(text) - {HEAD - 1}"
    places = f"explode(concat(sequence(1, {last}, {HEAD}), array({last}))) AS at"
    blocks = rules.where(f"octet_length(text) > {HEAD}").selectExpr("*", places)
    blocks = blocks.selectExpr("text", "first", f"substring(text, at, {HEAD}) AS head")
    blocks = blocks.withColumn("n", F.count("*").over(Window.partitionBy("head")))
    own = F.min_by(F.struct("head", F.col("text").alias("whole"), "first"), F.struct("n", "head")).alias("own")
    return short.union(blocks.groupBy("text").agg(own).select("own.*")).selectExpr(f"substring(head, 1, {START}) AS start", "*")


def _tables(own: DataFrame) -> Column:
    """One struct. bits: a word for each start, with a bit a length that it may have, then words with a bit for each head;
    their number does not depend on the rules. sizes and lengths: of starts and heads. long: whether rules go beyond HEAD."""
    marks = own.selectExpr(
        f"stack(5, {START_WORD}, {START_BIT}, {HEAD_WORD}, {HEAD_BIT}, {SIZES}L, octet_length(start) - 1, "
        f"{LENGTHS}L, octet_length(head) - 1, {LONG}L, int(whole IS NOT NULL)) AS (word, bit)"
    )
    every = own.sparkSession.range(LONG + 1).selectExpr("id AS word", "0L AS bits")
    words = marks.selectExpr("word", "shiftleft(1L, bit) AS bits").union(every)
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("bits"))
    set_in = lambda word, most: f"filter(sequence(1, {most}), n -> getbit(bits[{word}], n - 1) = 1)"
    found = f"{set_in(SIZES, START)} AS sizes, {set_in(LENGTHS, HEAD)} AS lengths, getbit(bits[{LONG}], 1) = 1 AS long"
    return words.selectExpr(f"struct(bits, {found}) AS tables").scalar()


def classify_by_rules(df: DataFrame, value: str, rules: DataFrame, default: str, label: str = "label") -> DataFrame:
    """`df` with a column `label`: the label of the first rule, by `priority`, whose `text` stands in `value` in any case.

    rules: (priority, text, label). Of equal priorities the lesser label counts. Null texts, labels or priorities drop
    the rule, an empty text stands in every value that is not null. Values that no rule fits, and null ones, get the
    default. Rules of one text count as the first of them. Each different value is classified once, under a hash of 256
    bits unless it is short, and its rows meet the answer in a plain join, so a value that many rows share is split.
    """
    rules = rules.select("priority", F.lower("text").cast("binary").alias("text"), "label").dropna()
    best = F.min(F.struct("priority", "label")).alias("first")
    # a rule without a text fits all values: the first of them is one row
    always = rules.where("octet_length(text) = 0").agg(best).scalar()
    own = _looked_up(rules.where("octet_length(text) > 0").groupBy("text").agg(best))
    tables = _tables(own)
    word = lambda place: F.get(tables.getField("bits"), F.expr(f"int({place})"))

    text = F.col(value).cast("string")
    keyed = lambda text: [_key(text).alias("_value"), F.lower(text).cast("binary").alias("text")]
    values = df.select(text.alias("value")).where("value IS NOT NULL").distinct().select(*keyed(F.col("value")))
    # texts hold each other as letters where they do as bytes, of which a run is cut in one step
    at = values.select("*", F.explode(tables.getField("sizes")).alias("size"))
    end = "greatest(octet_length(text), 1)"
    at = at.selectExpr("*", f"explode(sequence(1, {end}, {PLACES})) AS some")
    at = at.selectExpr("*", f"explode(sequence(some, least(some + {PLACES - 1}, {end}))) AS at")
    at = at.withColumn("start", F.expr("substring(text, at, size)"))
    at = at.withColumn("fit", word(START_WORD)).where("fit <> 0").drop("start", "size", "some")
    at = at.select("*", F.explode(tables.getField("lengths")).alias("length")).where("getbit(fit, length - 1) = 1")
    held = at.selectExpr("_value", "substring(text, at, length) AS head")
    held = held.where(F.getbit(word(HEAD_WORD), F.expr(HEAD_BIT)) == 1).distinct()
    met = held.join(own.drop("start"), "head")
    # only rules beyond HEAD need the texts once more; without any no text is moved again
    texts = df.where(tables.getField("long")).select(*keyed(text)).groupBy("_value").agg(F.any_value("text").alias("text"))
    met = met.join(texts, "_value", "left").where("whole IS NULL OR contains(text, whole)")
    found = met.groupBy("_value").agg(F.min("first").alias("_first"))
    # a copy of the key hides that answers lie by it already: only what comes straight from a shuffle is split
    found = found.withColumn("_value", F.concat("_value", F.lit(b"")))

    done = df.withColumn("_value", _key(text)).join(found, "_value", "left")
    first = F.when(F.col("_value").isNotNull(), F.least("_first", always))  # skips nulls
    return done.withColumn(label, F.coalesce(first.getField("label"), F.lit(default))).drop("_value", "_first")
