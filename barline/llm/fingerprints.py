"""Document fingerprints: threshold-scaled sketches of word shingles, mergeable and comparable by containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import written

#: A shingle's hash is the first 8 hexadecimal digits of the MD5 of its words joined by one space. At the coarse level, which every text has, those
#: below BELOW are retained (six in 16); at the complete level, which texts of at most FEW distinct hashes have too, all are, behind COMPLETE.
BELOW, DIGITS, FEW, COMPLETE = "6", 8, 128, "*"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Maximal runs outside ASCII blanks; none for a null or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def _once(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def _hashes(w: Column, size: int) -> Column:
    """The hashes of all shingles of these words, or of the whole sequence if it is shorter."""

    def of(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - (size - 1), F.lit(1))), lambda i: F.left(F.md5(F.concat_ws(" ", F.slice(v, i, size)).cast("binary")), F.lit(DIGITS)))

    return _once(w, of)


def _retained(every: Column) -> Column:
    """The sketch of these distinct hashes."""
    return F.when(F.size(every) == 0, F.array().cast("array<string>")).when(F.size(every) <= FEW, F.concat(F.array(F.lit(COMPLETE)), F.array_sort(every))).otherwise(F.array_sort(F.filter(every, lambda h: h < BELOW)))


def sketch(text: Column, size: int = 5) -> Column:
    """Retained hashes, ascending, of the distinct shingles of `size` words, or of the whole sequence if it is shorter; empty for a text without words
    (and for a longer one with no hash below the threshold, once in 10**26).
    """
    return _once(words(text), lambda w: F.when(F.size(w) > 0, _once(F.array_distinct(_hashes(w, size)), _retained)).otherwise(F.array().cast("array<string>")))


def sketches(text: Column, edited: Column, shared: Column, size: int = 5) -> Column:
    """The sketches of two texts, as a struct of own and edited, that begin with the same `shared` code points: shingles of the words that end
    in these are hashed once.
    """

    def of(s: Column) -> Column:
        whole = s.m >= size
        start = F.when(whole, s.m - (size - 2)).otherwise(1)
        common = F.when(whole, _hashes(F.slice(s.w, 1, s.m), size)).otherwise(F.array().cast("array<string>"))

        def one(c: Column, w: Column) -> Column:
            rest = _hashes(F.slice(w, start, F.size(w)), size)
            return F.when(F.size(w) > 0, _once(F.array_distinct(F.concat(c, rest)), _retained)).otherwise(F.array().cast("array<string>"))

        return _once(common, lambda c: F.struct(one(c, s.w).alias("own"), one(c, s.e).alias("edited")))

    ended = F.greatest(F.size(words(F.left(text, shared))) - 1, F.lit(0))  # the last word may go on
    return _once(F.struct(words(text).alias("w"), words(edited).alias("e"), ended.alias("m")), of)


def _complete(x: Column) -> Column:
    return F.coalesce(F.get(x, F.lit(0)) == COMPLETE, F.lit(False)) | (F.size(x) == 0)


def _level(x: Column, complete: Column) -> Column:
    """The hashes of a sketch at the level to compare at."""
    return F.filter(x, lambda h: (h != COMPLETE) & (complete | (h < BELOW)))


def merged(x: Column, y: Column) -> Column:
    """The sketch of two texts' shingles together: complete if both are and few enough remain, else coarse."""
    every = F.array_union(_level(x, _complete(x) & _complete(y)), _level(y, _complete(x) & _complete(y)))
    coarse = F.array_sort(_level(every, F.lit(False)))
    return F.when(_complete(x) & _complete(y), _retained(every)).otherwise(coarse)


def containment(x: Column, y: Column) -> Column:
    """Estimated share of the shingles of the text with fewer that the other has too, at the finest level that both have: exact for two complete
    sketches. 1 for two empty sketches, 0 for one. A complete sketch of k shingles has none at the coarse level, and then shows 0 beside a
    coarse one, with a chance of (10 / 16) ** k: once in 1,800 at 16 shingles.
    """
    both = _complete(x) & _complete(y)

    def at(s: Column) -> Column:
        least = F.least(F.size(s.x), F.size(s.y))
        return F.when(least > 0, F.size(F.array_intersect(s.x, s.y)) / least).otherwise(0.0)

    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(_once(F.struct(_level(x, both).alias("x"), _level(y, both).alias("y")), at))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids: doc_id, others. Adds next_id, the next larger doc_id (after the largest: the smallest), without one task over all rows.

    Rows are dealt by ranges of doc_id; only each range's first id is carried over to the range before.
    """
    ranged = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")  # a row for each range
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("beyond"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("next_id", inside).join(firsts, "part").withColumn("next_id", F.coalesce("next_id", "beyond")).drop("part", "beyond")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (others ignored). Returns a row for each row: doc_id, n_chars, edited, sketch, edited_sketch, near_edited,
    near_next.

    edited: the text's last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document, in
    ascending doc_id; after the last comes the first. near_*: containment of the sketches.

    Null or empty text: empty, with an empty sketch. Null doc_id: no next document, whose text counts as empty. Rows of one doc_id
    have the next doc_id's document as their next; of several rows with that doc_id, the smallest text's head and the shortest one's sketch. A single
    document follows itself. No rows: no rows.
    """
    docs = docs.select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    held = docs.where("doc_id is not null")  # both joins below share one exchange of it
    ids = held.groupBy("doc_id").agg(F.max(F.char_length(text)).alias("most"))
    links = written(next_ids(ids), "links")
    behind = links.select(F.col("doc_id").alias("before"), "next_id", "most")
    met = held.join(behind, held.doc_id == behind.next_id)
    first = F.struct(F.char_length(text), F.xxhash64(text))
    heads = met.groupBy("before").agg(F.min(F.left(text, F.floor(F.col("most") / 4).cast("int"))).alias("head"), F.min_by(sketch(F.col("text")), first).alias("next_sketch"))
    every = held.join(heads.withColumnRenamed("before", "doc_id"), "doc_id", "left")
    every = every.unionByName(docs.where("doc_id is null"), allowMissingColumns=True).withColumn("n", F.char_length(text))
    quarter = F.floor(F.col("n") / 4).cast("int")
    edited = F.concat(F.left(text, F.col("n") - quarter), F.left(F.coalesce("head", F.lit("")), quarter))
    every = every.select("doc_id", text.alias("text"), F.col("n").cast("long").alias("n_chars"), edited.alias("edited"), F.coalesce("next_sketch", F.array().cast("array<string>")).alias("next_sketch"))
    shared = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    made = every.withColumn("made", sketches(F.col("text"), F.col("edited"), shared)).select("*", F.col("made.own").alias("sketch"), F.col("made.edited").alias("edited_sketch"))
    return made.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
