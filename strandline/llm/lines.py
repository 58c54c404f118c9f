"""Line deduplication by a deletion-neighbourhood join.

A line is its characters, with every run of blanks made one space and none at
the ends.  Two lines are near if one character changed, added or removed turns
one into the other and both have at least ``LEAST`` characters; shorter lines
repeat exactly or not at all, for one character is too large a share of them.

Lines emit the hashed key of every variant with one character deleted: equal
variants with the deletion at one place are a changed character, a variant
equal to a whole line is an added one.  Such groups hold lines that differ in
one place, so they are no larger than the alphabet allows, however often a
line occurs.

One edit leaves the first or the last half of a line as it is.  So only lines
that share a half with another line go on, with the rest outside that half,
and of these only those whose rest shares a half again; neighbourhoods are
emitted for what is left, about a quarter of the line.  Nothing is lost by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import durable, small

#: Blanks inside lines other than the space.
BLANKS = "\t\x0b\x0c\r"
#: Characters that a line needs for near matches.
LEAST = 16
#: Times that halves are set aside.
LEVELS = 3


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of all lines that aren't blank."""
    text = F.col("text")
    other = text.contains(BLANKS[0])
    for blank in BLANKS[1:]:
        other = other | text.contains(blank)
    plain = F.when(other, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)
    single = F.when(plain.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain)
    cut = docs.select("doc_id", F.posexplode(F.split(single, "\n")).alias("line_no", "line"))
    return cut.withColumn("line", F.trim("line")).filter("line <> ''")


def _halves(text: Column, n: Column, group: Column) -> Column:
    """(group, from, size) for each half of ``text``: its hash and where the rest outside it lies.

    Texts one edit apart, of n and n or n - 1 characters, have equal first or
    last parts of any size up to floor((n - 1) / 2).  Sizes are multiples of 4,
    so most texts have one, and those at a step also that of the text below.
    """
    sizes = F.array_distinct(F.array(F.floor(n / 8).cast("int") * 4, F.floor((n - 1) / 8).cast("int") * 4))

    def both(h: Column) -> Column:
        first = F.struct(F.xxhash64(group, F.lit(0), h, F.substring(text, F.lit(1), h)).alias("group"), (h + 1).alias("from"), (n - h).alias("size"))
        last = F.struct(F.xxhash64(group, F.lit(1), h, F.substring(text, n - h + 1, h)).alias("group"), F.lit(1).alias("from"), (n - h).alias("size"))
        return F.when(h > 0, F.array(first, last)).otherwise(F.array(first))

    return F.flatten(F.transform(sizes, both))


def _shared(entries: DataFrame, name: str) -> DataFrame:
    """Entries (line, group, ...) whose ``group`` an entry of another line has too."""
    groups = entries.groupBy("group").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a < b").select("group")
    return entries.join(small(durable(groups, name)), "group", "left_semi")


def _variants(entries: DataFrame) -> DataFrame:
    """(line, group, size, at, variant): each entry's rest with one character deleted, and whole (``at`` -1).

    The hash of a text is the exclusive or of one hash for each character and
    its place, so the variants of a rest of n characters take n steps in all.
    """
    c = F.col
    cut = entries.select("line", "group", F.split("rest", "").alias("chars"))
    chars = cut.select("line", "group", F.size("chars").alias("size"), F.posexplode("chars").alias("at", "char"))
    chars = chars.withColumns({"here": F.xxhash64("char", "at"), "moved": F.xxhash64("char", c("at") - 1)})
    order = Window.partitionBy("line", "group").orderBy("at")
    whole = Window.partitionBy("line", "group")
    before = F.coalesce(F.bit_xor("here").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    after = F.bit_xor("moved").over(whole).bitwiseXOR(F.bit_xor("moved").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hashed = chars.select("line", "group", "size", "at", before.bitwiseXOR(after).alias("variant"), before.bitwiseXOR(c("here")).alias("upto"))
    one = F.struct((c("size") - 1).alias("size"), "at", "variant")
    every = F.struct("size", F.lit(-1).alias("at"), c("upto").alias("variant"))
    return hashed.select("line", "group", F.explode(F.when(c("at") == c("size") - 1, F.array(one, every)).otherwise(F.array(one))).alias("v")).select("line", "group", "v.*")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether different texts are equal but for one character, in a number of steps that grows with their length."""
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    at = F.array_position(F.zip_with(F.split(long, ""), F.split(short, ""), lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    more = F.length(long) - F.length(short)
    return (more <= 1) & (F.substring(long, at + 1, F.length(long)) == F.substring(short, at + 1 - more, F.length(short)))


def first_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of each id, and the first occurrence of each distinct line with its near flag.

    The first table holds (doc_id, n_lines); the second (doc_id, line_no, near)
    where ``near`` says that an earlier line is one edit away.  Earlier means
    smaller (doc_id, line_no), null ids last; where rows repeat an id with other
    texts, lines of equal place are ordered by digest.  Blank lines are no lines.
    """
    c = F.col
    n = F.length("line")
    rows = docs.select("doc_id", "text")
    key = F.unhex(F.md5("line"))
    lines = durable(_lines(rows).select("doc_id", "line_no", key.alias("key"), F.when(n >= LEAST, _halves(c("line"), n, F.lit(0))).alias("halves")), "lines")
    place = F.struct(c("doc_id").isNull().alias("absent"), "doc_id", "line_no", "key")
    unique = durable(lines.groupBy("key").agg(F.min(place).alias("place")), "lines-unique")
    halves = lines.select("key", F.xxhash64("key").alias("line"), F.explode("halves").alias("half")).select("key", "line", "half.*")
    halves = durable(_shared(halves, "lines-shared").distinct(), "lines-halves")
    wanted = durable(unique.join(small(durable(halves.select("key").distinct(), "lines-able")), "key", "left_semi"), "lines-wanted")
    # Only the lines that go on are cut again, each from the row of its first place.
    owners = small(durable(wanted.select("place.doc_id").distinct().withColumnRenamed("doc_id", "owner"), "lines-owners"))
    again = _lines(rows.join(owners, c("doc_id").eqNullSafe(c("owner")), "left_semi")).withColumn("digest", key)
    same = (c("digest") == c("key")) & (c("line_no") == c("place.line_no")) & again["doc_id"].eqNullSafe(c("place.doc_id"))
    held = durable(again.join(small(wanted), same).select("key", "place", c("line").alias("whole")).dropDuplicates(["key"]), "lines-held")
    # Numbers in the order of places, so that the least number is the earliest line.
    held = durable(held.orderBy("place").withColumn("line", F.monotonically_increasing_id()), "lines-ranked")
    entries = halves.drop("line").join(held.select("key", "line", "whole"), "key").select("line", "group", F.substring(c("whole"), c("from"), c("size")).alias("rest"))
    for _ in range(LEVELS - 1):
        pieces = entries.select("line", "rest", F.explode(_halves(c("rest"), F.length("rest"), c("group"))).alias("half"))
        pieces = durable(pieces.select("line", "half.group", F.substring(c("rest"), c("half.from"), c("half.size")).alias("rest")), "lines-pieces")
        entries = durable(_shared(pieces, "lines-groups"), "lines-entries")
    variants = _variants(entries)
    # Deleted at one place: a changed character.  Deleted against whole: an added one.
    same_text = Window.partitionBy("group", "size", "variant")
    same_place = Window.partitionBy("group", "size", "variant", "at")
    is_whole = c("at") == -1
    change = F.when(~is_whole, F.min("line").over(same_place))
    added = F.when(is_whole, F.min(F.when(~is_whole, c("line"))).over(same_text)).otherwise(F.min(F.when(is_whole, c("line"))).over(same_text))
    met = variants.select("line", F.array(change, added).alias("firsts")).select("line", F.explode("firsts").alias("first")).filter("first < line").distinct()
    mine, other = held.select("line", "place", "whole"), held.select(c("line").alias("first"), c("whole").alias("first_whole"))
    near = met.join(mine, "line").join(other, "first").filter(_one_edit(c("whole"), c("first_whole"))).select("place", F.lit(True).alias("near")).distinct()
    firsts = unique.join(small(durable(near, "lines-near")), "place", "left").select("place.doc_id", "place.line_no", F.coalesce("near", F.lit(False)).alias("near"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines")), firsts


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, n_kept) for each id of ``docs``.

    ``n_lines`` counts lines that aren't blank; ``n_exact`` those that repeat an
    earlier line, ``n_near`` first occurrences one edit from an earlier line.
    Null and empty texts have no lines.  Rows of one id count together.  Lines
    of any length are compared whole.  Extra columns are ignored.
    """
    lines, firsts = first_lines(docs)
    counts = firsts.groupBy("doc_id").agg(F.count("*").alias("n_first"), F.count_if("near").alias("n_near"))
    both = lines.join(counts, lines["doc_id"].eqNullSafe(counts["doc_id"]), "left").select(lines["doc_id"].alias("d"), "n_lines", F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    ids = docs.select("doc_id").distinct()
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ids.join(both, ids["doc_id"].eqNullSafe(F.col("d")), "left").select(
        ids["doc_id"], n("n_lines").alias("n_lines"), n(F.col("n_lines") - F.col("n_first")).alias("n_exact"), n("n_near").alias("n_near"), n(F.col("n_first") - F.col("n_near")).alias("n_kept"))


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with only the lines that are kept in ``text``; blank lines go.

    All columns stay, whatever their names.  A document without kept lines has
    an empty text; a null text stays null.  Rows that repeat an id keep the
    lines of that id.
    """
    _, firsts = first_lines(docs)
    kept = firsts.filter(~F.col("near")).groupBy("doc_id").agg(F.collect_set("line_no").alias("kept"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = held.join(kept, F.col("row.doc_id").eqNullSafe(kept["doc_id"]), "left")
    text = F.array_join(F.filter(F.split("row.text", "\n"), lambda line, i: F.array_contains(F.coalesce(F.col("kept"), F.array().cast("array<int>")), i)), "\n")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


#: The same in DuckDB: pairs of lines that share a half, compared in full.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
k AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS key FROM l),
u AS (SELECT key, length(key) AS n, min(row(doc_id, line_no)) AS place FROM k WHERE key <> '' GROUP BY key),
h AS (SELECT key, n, place, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM u WHERE n >= 16),
s AS (SELECT *, 0 AS side, left(key, h) AS half FROM h UNION ALL SELECT *, 1, right(key, h) FROM h),
p AS (SELECT DISTINCT x.key AS a, y.key AS b, x.n AS an, y.n AS bn FROM s x JOIN s y ON x.side = y.side AND x.half = y.half AND abs(x.n - y.n) <= 1 AND y.place < x.place),
near AS (SELECT DISTINCT a AS key FROM p WHERE len(list_filter(range(0, greatest(an, bn)), lambda i: left(a, i) = left(b, i)
  AND substr(a, i + CASE WHEN an < bn THEN 1 ELSE 2 END) = substr(b, i + CASE WHEN bn < an THEN 1 ELSE 2 END))) > 0),
f AS (SELECT place[1] AS doc_id, count(*) AS n_first, count(near.key) AS n_near FROM u LEFT JOIN near USING (key) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_lines FROM k WHERE key <> '' GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (coalesce(n_lines, 0) - coalesce(n_first, 0))::BIGINT AS n_exact,
  coalesce(n_near, 0)::BIGINT AS n_near, (coalesce(n_first, 0) - coalesce(n_near, 0))::BIGINT AS n_kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN t USING (doc_id) LEFT JOIN f USING (doc_id)
"""
