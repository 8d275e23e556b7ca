"""Line dedup: exact set-similarity join of lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from strandlake.llm.common import scratch, sized, stored

#: Words of a token; lines match when NUM / DEN <= intersection / union of their tokens.
WIDTH, NUM, DEN = 5, 75, 100
#: Lines of one list up to which it counts as rare; tokens of a set from which two, not one, must be met in the prefixes, which are longer by one for it.
RARE, TWO_FROM = 50, 8
#: Runs of a line that are hashed by compiled expressions, so many at once; those after them by a lambda, which Spark interprets.
COMPILED, BLOCK = 128, 16

_BLANKS = "[ \\t\\x0B\\f\\r]+"


def bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(line: Column) -> Column:
    """Words of a line; one without tabs and the like is cut at spaces, which needs no regular expression."""
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\f") | line.contains("\r")
    return F.array_remove(F.when(odd, F.split(line, _BLANKS)).otherwise(F.split(line, " ")), "")


def hashed(line: Column) -> Column:
    """Hashes of the words of a line, in order."""
    return F.transform(words(line), lambda word: F.xxhash64(word))


def tokens(hashes: str, width: int = WIDTH) -> Column:
    """Sorted distinct hashes of the ``width``-word runs of a line, by the column of its words' hashes; fewer words are one run; none give an empty array.

    No array here may hold nulls by its type, so that it is sorted as plain numbers.
    The lambda also keeps the step out of whole-stage code, which would put all
    runs into one method, too long to be compiled by the machine.
    """
    n = F.size(hashes)
    none = F.array().cast(ArrayType(LongType(), False))

    def run(i: Column | int) -> Column:
        return F.xxhash64(*(F.get(hashes, i + k if isinstance(i, Column) else F.lit(i + k)) for k in range(width)))

    blocks = [F.when(n >= at + width, F.array(*(run(at + k) for k in range(BLOCK)))).otherwise(none) for at in range(0, COMPILED, BLOCK)]
    rest = F.when(n >= COMPILED + width, F.transform(F.sequence(F.lit(COMPILED), n - width), run)).otherwise(none)
    runs = F.slice(F.concat(*blocks, rest), F.lit(1), n - width + 1)  # the last block goes beyond the line
    return F.sort_array(F.array_distinct(F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(none)))


def marks(s: Column, half: int) -> Column:
    """64 of the 128 marks of a set: each token sets one."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(s, F.lit(0).cast("bigint"), lambda acc, x: F.when(x.bitwiseAND(64) == 64 * half, acc.bitwiseOR(F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int")))).otherwise(acc))


def least_common(n: Column, num: int = NUM, den: int = DEN) -> Column:
    """Items that a set of ``n`` shares at least with a set that it matches."""
    return F.ceil(n * num / den)


def can_match(n: Column, m: Column, i: Column, j: Column, before: int, num: int = NUM, den: int = DEN) -> Column:
    """Length and positional filter of two sets whose items i and j (from 0), in the common order, are equal, after at most ``before`` other equal ones."""
    most = F.least(n - i, m - j) + before
    return (num * F.greatest(n, m) <= den * F.least(n, m)) & (den * most >= num * (n + m - most))


def marks_allow(x: Column, y: Column, num: int, den: int) -> Column:
    """Whether two nodes (n, b0, b1) can match by their marks: each mark that one set has alone stands for a token that it has alone."""

    def alone(p: Column, q: Column) -> Column:
        return F.bit_count(p["b0"].bitwiseAND(F.bitwise_not(q["b0"]))) + F.bit_count(p["b1"].bitwiseAND(F.bitwise_not(q["b1"])))

    most = F.least(x["n"] - alone(x, y), y["n"] - alone(y, x))
    return den * most >= num * (x["n"] + y["n"] - most)


def prefix_pairs(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b, of nodes with an equal item in their prefixes that pass the filters, once an item; postings: h, i, p, n."""
    x, y = postings.select("h", *(F.col(c).alias(f"{c}1") for c in ("i", "p", "n"))), postings.select("h", *(F.col(c).alias(f"{c}2") for c in ("i", "p", "n")))
    met = x.join(y, (x.h == y.h) & (F.col("p1") < F.col("p2")) & can_match(F.col("n1"), F.col("n2"), F.col("i1"), F.col("i2"), 1, num, den))
    return met.select(F.col("p1").alias("a"), F.col("p2").alias("b"))


def _worded(text: Column) -> Column:
    """Whether a text has a word, which null has not."""
    return F.coalesce(F.ltrim(text, F.lit(" \t\n\x0b\f\r")) != "", F.lit(False))


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, keep) -> DataFrame:
    """id, th, n_lines, copies, removed and worded (numbers of lines) for each distinct row (id and text, whose hash is th) that has a word."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(_worded(F.col("text"))).withColumn("th", F.xxhash64("text"))
    broken = texts.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    tokenized = broken.select("id", "th", "no", hashed(F.col("line")).alias("h")).select("id", "th", "no", tokens("h", width).alias("s")).withColumn("n", F.size("s"))
    n = F.col("n")
    few = n < TWO_FROM
    prefix = F.when(n >= 3, F.slice("s", 1, (n - least_common(n, num, den) + F.when(few, 1).otherwise(2)).cast("int")))  # smaller sets match equal ones only
    node = F.xxhash64("s").bitwiseAND(~1).bitwiseOR(few.cast("bigint"))  # odd: a set of few
    lines = stored(tokenized.select("id", "th", "no", "n", F.when(n > 0, node).alias("p"), F.when(n > 0, F.xxhash64("s", F.lit(1))).alias("q"), prefix.alias("prefix")), "lines")
    at = F.struct("id", "no", "th")

    posted = lines.where("prefix is not null").select("p", "n", F.posexplode("prefix").alias("i", "h"))
    lists = stored(posted.groupBy("h").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("c")).where("a != b"), "lists")
    shared = stored(posted.join(sized(lists.where("c > 2").select("h")), "h").dropDuplicates(["h", "p"]), "postings")
    sizes = shared.groupBy("h").agg(F.count("*").alias("g"))
    rare = shared.join(sizes.where(F.col("g") <= RARE).select("h"), "h", "left_semi")
    hot = stored(shared.join(sizes.where(F.col("g") > RARE).select("h"), "h", "left_semi").select("h", "p"), "hot")
    many = hot.select("p").distinct()
    needed = F.when((F.col("a") % 2 != 0) | (F.col("b") % 2 != 0), 1).otherwise(2)
    pairs = stored(lists.where("c = 2").select("a", "b").union(prefix_pairs(rare, num, den)).groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= needed).select("a", "b"), "pairs")

    # what a pair is judged by: place, size, marks and set of its nodes
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("p")).union(many).distinct()
    known = lines.where("prefix is not null").join(sized(wanted), "p", "left_semi")
    firsts = stored(known.groupBy("p").agg(F.min(at).alias("first")), "firsts")
    asked = firsts.groupBy(F.col("first.id").alias("of"), F.col("first.th").alias("of_th")).agg(F.collect_list(F.struct("first.no", "p")).alias("nos"))
    found = texts.join(sized(asked), (F.col("th") == F.col("of_th")) & F.col("id").eqNullSafe(F.col("of")))
    parts = bound(F.split("text", "\n"), lambda part: F.transform("nos", lambda x: F.struct(x["p"].alias("p"), x["no"].alias("no"), F.get(part, x["no"]).alias("line"))))
    read = found.select("id", F.explode(parts).alias("x")).select("id", "x.no", "x.p", hashed(F.col("x.line")).alias("h")).select("id", "no", "p", tokens("h", width).alias("s"))
    sets = stored(read.select("id", "no", "p", F.size("s").alias("n"), *(marks(F.col("s"), k).alias(f"b{k}") for k in (0, 1)), "s"), "sets")
    if sets.count() > firsts.count():  # rows equal in id and text
        sets = stored(sets.dropDuplicates(["p"]), "sets")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("p").alias(name), F.struct("id", "no", "p", "n", "b0", "b1").alias(f"{name}_"))

    def place(node: str) -> Column:
        return F.struct(F.col(f"{node}.id"), F.col(f"{node}.no"), F.col(f"{node}.p"))

    allowed = marks_allow(F.col("a_"), F.col("b_"), num, den)
    turned = place("a_") < place("b_")
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(allowed).select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("later"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.least(place("a_"), place("b_")).alias("first"))
    heads = hot.join(side("p"), "p").groupBy("h").agg(F.min("p_").alias("b_"))
    stars = hot.join(side("p").withColumnRenamed("p_", "a_"), "p").join(heads, "h").where((F.col("p") != F.col("b_.p")) & allowed).select(F.col("p").alias("later"), F.col("b_.p").alias("earlier"), place("b_").alias("first"))
    candidates = stored(met.union(stars).distinct(), "candidates")

    def verified(c: DataFrame) -> DataFrame:
        """Later nodes of pairs that match."""
        c = stored(c, "asked")
        one = sets.select(F.col("p").alias("later"), F.col("s").alias("s1")).join(sized(c), "later")
        two = sets.select(F.col("p").alias("earlier"), F.col("s").alias("s2")).join(sized(c.select("earlier").distinct()), "earlier", "left_semi")
        overlap = F.size(F.array_intersect("s1", "s2"))
        return one.join(two, "earlier").where(den * overlap >= num * (F.size("s1") + F.size("s2") - overlap)).select("later").distinct()

    # what decides is whether a node has one earlier match, so each is held against its earliest candidate before the others
    matched = stored(verified(candidates.groupBy("later").agg(F.min_by("earlier", "first").alias("earlier"))), "matched")
    matched = stored(matched.union(verified(candidates.join(sized(matched), "later", "left_anti").select("later", "earlier"))), "matched")

    # nodes of long lists: tokens in order of rarity among them; those without a match so far look the first of theirs up among the first of all
    common = sets.join(sized(many), "p", "left_semi")
    listed = common.repartition("p").select("p", "n", F.explode("s").alias("h"))  # one shuffle of sets: the rows of a node meet again below without another
    counts = stored(common.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    unseen = n - F.size("o")  # tokens that no other such node has come first
    first_ones = F.slice("o", 1, F.greatest(n - least_common(n, num, den) + 1 - unseen, F.lit(0)).cast("int"))
    ranked = listed.join(sized(counts), "h").groupBy("p").agg(F.min("n").alias("n"), F.array_sort(F.collect_set(F.struct("c", "h"))).alias("o"))
    ordered = ranked.select("p", "n", unseen.alias("unseen"), F.posexplode(first_ones).alias("k", "x")).select(F.col("x.h").alias("h"), (F.col("unseen") + F.col("k")).alias("i"), "p", "n")
    ordered = stored(ordered, "ordered")
    open_ones = ordered.join(sized(matched), F.col("p") == F.col("later"), "left_anti")
    x, y = (df.select("h", F.col("p").alias(c), F.col("n").alias(f"n_{c}"), F.col("i").alias(f"i_{c}")) for df, c in ((open_ones, "a"), (ordered, "b")))
    late = x.join(y, "h").where((F.col("a") != F.col("b")) & can_match(F.col("n_a"), F.col("n_b"), F.col("i_a"), F.col("i_b"), 0, num, den)).select("a", "b").distinct()
    late = late.join(side("a"), "a").join(side("b"), "b").where(allowed & (place("b_") < place("a_"))).select(F.col("a").alias("later"), F.col("b").alias("earlier"))
    matched = stored(matched.union(verified(late.join(candidates, ["later", "earlier"], "left_anti"))), "matched")

    # only lines that another equals, or whose set matches another, can go
    worded = lines.where("p is not null")
    several = worded.groupBy("p", "q").agg(F.count("*").alias("c")).where("c > 1").select("p", "q", F.lit(False).alias("matches"))
    single = worded.join(sized(matched.select(F.col("later").alias("p")).distinct()), "p").select("p", "q", F.lit(True).alias("matches"))
    touched = several.union(single).groupBy("p", "q").agg(F.max("matches").alias("matches"))
    held = stored(worded.select("id", "th", "no", "p", "q").join(sized(touched), ["p", "q"]), "held")
    kept_at = held.where("not matches").groupBy("p", "q").agg(F.min(at).alias("kept_at"))
    gone = held.join(sized(kept_at), ["p", "q"], "left").where(~at.eqNullSafe(F.col("kept_at"))).select("id", "th", "no")
    removed = gone.groupBy(F.col("id").alias("of"), F.col("th").alias("of_th")).agg(F.array_sort(F.collect_set("no")).alias("removed"))
    every = lines.groupBy("id", "th").agg((F.max("no") + 1).cast("bigint").alias("n_lines"), F.count_if(F.col("no") == 0).alias("copies"))
    every = keep(stored(every, "every"))
    repeated = sized(every.where("copies > 1").select("id", "th").withColumnsRenamed({"id": "of", "th": "of_th"}))
    here = (F.col("th") == F.col("of_th")) & F.col("id").eqNullSafe(F.col("of"))
    numbers = worded.join(repeated, here).groupBy("of", "of_th").agg(F.array_sort(F.collect_set("no")).alias("worded"))
    answered = every.join(keep(stored(removed, "gone")), here, "left").drop("of", "of_th").join(sized(keep(stored(numbers, "copies"))), here, "left")
    return answered.select("id", "th", "n_lines", "copies", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "worded")


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_lines, n_removed, removed: the numbers of a document's lines that match an earlier line, one row a row of ``docs``.

    Lines are parts between line feeds, numbered from 0, in the order of (doc_id,
    number). A line's set is its distinct ``width``-word runs, or all its words
    where they are fewer; lines match when den * intersection >= num * union. A
    line goes if any earlier line matches, whether that stays or goes. Lines
    without a word never match. Null text has no lines; lines of rows with a null
    id come first; lines of one id and number, from rows that repeat an id, come
    in the order of a hash; of rows equal in id and text, all but one lose every
    line with a word; an empty table gives no rows; other columns are not read.

    Equal sets fall together by hash. Of the others, tokens are ordered by rarity:
    a first pass over prefixes in hash order finds every list of few lines, which
    are rare by that measure. A line of a longer list is held against the list's
    first line; if that and its other candidates fail, its rarest tokens, by their
    exact number of lines, are looked up among the rarest of all lines of such
    lists. Both passes take the prefix that a match can't avoid, filter by length
    and position, then by marks (bits that tokens set: those that one set has
    alone bound the intersection), and verify on the sets.
    """
    with scratch(docs.sparkSession) as keep:
        judged = _judged(docs, id_col, text_col, width, num, den, keep)
    none = F.array().cast("array<int>")
    wordless = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(~_worded(F.col("text"))).select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"), none.alias("removed"))
    wordless = wordless.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("bigint")))
    each = judged.select("id", "n_lines", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"), "removed", "worded").withColumn("removed", F.when(F.col("copy") == 1, F.col("removed")).otherwise(F.col("worded")))
    return each.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed").union(wordless)


def without_later_matches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the matching later lines taken out of their texts; all rows and columns stay.

    A text without a kept line is empty, null stays null. Lines are judged as by
    ``removed_lines``: row by row, also where ids are null or repeat; of rows
    equal in id and text one keeps its lines.
    """
    with scratch(docs.sparkSession) as keep:
        judged = _judged(docs, id_col, text_col, WIDTH, NUM, DEN, keep)
        gone = keep(stored(judged.where((F.size("removed") > 0) | (F.col("copies") > 1)).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("copies").alias("__copies"), F.col("removed").alias("__removed"), F.when(F.col("copies") > 1, F.col("worded")).alias("__worded")), "removed"))
        key = (F.xxhash64(text_col) == F.col("__th")) & docs[id_col].eqNullSafe(F.col("__id"))
        joined = docs.join(sized(gone), key, "left")
        several = gone.where("__copies > 1")
        repeated = None
        if not several.isEmpty():  # one row of each class of equal rows keeps its lines
            repeated = keep(stored(docs.join(sized(stored(several, "several")), key).withColumn("__row", F.monotonically_increasing_id()), "repeated"))
            leads = repeated.groupBy("__id", "__th").agg(F.min("__row").alias("__lead")).withColumnsRenamed({"__id": "__of", "__th": "__of_th"})
            leads = sized(keep(stored(leads, "leads")))
            repeated = repeated.join(leads, (F.col("__th") == F.col("__of_th")) & F.col("__id").eqNullSafe(F.col("__of"))).withColumn("__removed", F.when(F.col("__row") == F.col("__lead"), F.col("__removed")).otherwise(F.col("__worded")))

    def cleaned(df: DataFrame) -> DataFrame:
        kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda line, k: ~F.array_contains("__removed", k)), "\n")
        return df.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)

    single = cleaned(joined.where("__copies is null or __copies = 1"))
    return single if repeated is None else single.union(cleaned(repeated))
